"""Time-window and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from ..streaming import intervals as S
from .views import genotypes, table


def event_islands(spark, d):
    return S.event_islands(table(spark, d, "events"), gap="30 minutes")


def event_windows(spark, d):
    x = S.windowed_counts(table(spark, d, "events"), "6 hours")
    return x.select("event_type", "start", "n", F.round("value", 2).alias("value"))


def event_sliding(spark, d):
    x = S.windowed_counts(table(spark, d, "events"), "2 hours", "1 hour")
    return x.select("event_type", "start", "n")


def homozygous_runs(spark, d):
    return models.runs_of_homozygosity(genotypes(spark, d), enter=1e-3, leave=1e-3).select("sample", "chrom", "start", "end", "sites", F.round("quality", 3).alias("quality"))


def copy_number(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).cast("int").alias("sample"), F.concat(F.lit("c"), F.col("l_orderkey") % 20).alias("chrom"), F.col("l_partkey").alias("pos"), (F.floor(F.col("l_partkey") / 500) % 3 * -0.45 + (F.col("l_discount") - 0.05)).cast("double").alias("lrr"))
    return models.copy_number(x.groupBy("sample", "chrom", "pos").agg(F.avg("lrr").alias("lrr")))


def self_organising_map(spark, d):
    x = models.self_organising_map(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return x.select("p_partkey", "unit", F.round("distance", 6).alias("distance"))


QUERIES = {
    "event_islands": (event_islands, """SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
      SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, k"""),
    "event_windows": (event_windows, """SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL"""),
    "event_sliding": (event_sliding, """SELECT event_type, start, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(k) AS start FROM events, range(2) t(k)) GROUP BY ALL"""),
    "homozygous_runs": (homozygous_runs, None),
    "copy_number": (copy_number, None),
    "self_organising_map": (self_organising_map, None),
}
