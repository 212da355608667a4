"""Alignment queries over the alignment view, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignments as A
from .views import al_sql, alignments

_r = lambda c, n=6: F.round(F.col(c).cast("double"), n).alias(c)


def _genome(spark):
    return spark.range(20).select(F.concat(F.lit("c"), F.col("id")).alias("chrom"), F.lit(40_000).cast("long").alias("length"))


def view(spark, d):
    return A.view(alignments(spark, d), require=3, exclude=0x904, not_all=0x50, min_mapq=20).select("id", "qname", "pos", "mapq")


def flag_statistics(spark, d):
    return A.flag_statistics(alignments(spark, d))


def index_statistics(spark, d):
    return A.index_statistics(alignments(spark, d))


def depth(spark, d):
    return A.depth(alignments(spark, d)).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"), F.sum("depth").cast("long").alias("depth"), F.max("depth").cast("long").alias("most"))


def contig_coverage(spark, d):
    return A.contig_coverage(alignments(spark, d), _genome(spark)).select("chrom", "reads", F.col("covered").cast("long").alias("covered"), _r("percent"), _r("mean_depth"), _r("mean_mapq"))


def mark_duplicates(spark, d):
    x = alignments(spark, d).withColumns({"start5": F.floor(F.col("pos") / 50), "score": F.col("quality")})
    return A.mark_duplicates(x).select("id", "is_duplicate")


def window_depth(spark, d):
    return A.window_depth(alignments(spark, d), _genome(spark), 500).select("chrom", "start", "end", _r("mean"))


def quantized_depth(spark, d):
    return A.quantized_depth(alignments(spark, d), _genome(spark), [0, 1, 4, None])


def depth_distribution(spark, d):
    return A.depth_distribution(alignments(spark, d), _genome(spark)).select("chrom", F.col("depth").cast("long").alias("depth"), _r("share", 9))


def summary_numbers(spark, d):
    return A.summary_numbers(alignments(spark, d))


def length_histogram(spark, d):
    return A.histogram(alignments(spark, d), "len")


def mapq_histogram(spark, d):
    return A.histogram(alignments(spark, d), "mapq")


def alignment_intervals(spark, d):
    return A.to_bed(alignments(spark, d))


def fix_mates(spark, d):
    # Two reads of each order: the first line with the bit of read 1, and one with that of read 2.
    x = alignments(spark, d).filter(A.none_of(0x900))
    one = x.groupBy("qname", A.has(64).alias("first")).agg(F.min_by(F.struct("id", "flag", "rname", "pos", "mapq", "len"), "id").alias("x")).select("qname", "x.*")
    return A.fix_mates(one).select("id", "mate_pos", "mate_mapq", F.col("template").cast("long").alias("template"))


_RUNS = """rd AS (SELECT rname AS chrom, pos - 1 AS start, pos - 1 + len AS "end", mapq FROM al WHERE flag & 1796 = 0),
ev AS (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, start AS pos, 1 AS d FROM rd UNION ALL SELECT chrom, "end", -1 FROM rd) GROUP BY ALL HAVING sum(d) <> 0),
g AS (SELECT 'c' || range AS chrom, 40000 AS length FROM range(20)),
rr AS (SELECT * FROM (SELECT chrom, pos AS start, lead(pos) OVER w AS "end", sum(d) OVER w AS depth FROM ev WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE "end" IS NOT NULL),
runs AS (SELECT chrom, start, least("end", length) AS "end", depth FROM rr JOIN g USING (chrom)
  UNION ALL SELECT g.chrom, 0, coalesce(f, length), 0 FROM g LEFT JOIN (SELECT chrom, min(start) AS f FROM rr GROUP BY chrom) USING (chrom) WHERE coalesce(f, length) > 0
  UNION ALL SELECT g.chrom, l, length, 0 FROM g JOIN (SELECT chrom, max("end") AS l FROM rr GROUP BY chrom) USING (chrom) WHERE l < length)"""
_P = "flag & 2304 = 0"
_COUNTERS = {
    "total": "TRUE", "primary": _P, "secondary": "flag & 256 <> 0", "supplementary": "flag & 2304 = 2048", "duplicates": "flag & 1024 <> 0", "primary_duplicates": f"{_P} AND flag & 1024 <> 0", "mapped": "flag & 4 = 0",
    "primary_mapped": f"{_P} AND flag & 4 = 0", "paired": f"{_P} AND flag & 1 <> 0", "read1": f"{_P} AND flag & 65 = 65", "read2": f"{_P} AND flag & 129 = 129", "properly_paired": f"{_P} AND flag & 7 = 3",
    "with_mate_mapped": f"{_P} AND flag & 13 = 1", "singletons": f"{_P} AND flag & 13 = 9", "mate_elsewhere": "FALSE", "mate_elsewhere_mapq5": "FALSE",
}
_NUMBERS = {
    "sequences": f"count(*) FILTER ({_P})", "first_fragments": f"count(*) FILTER ({_P} AND flag & 64 <> 0)", "last_fragments": f"count(*) FILTER ({_P} AND flag & 128 <> 0)", "mapped": f"count(*) FILTER ({_P} AND flag & 4 = 0)",
    "mapped_and_paired": f"count(*) FILTER ({_P} AND flag & 13 = 1)", "unmapped": f"count(*) FILTER ({_P} AND flag & 4 <> 0)", "properly_paired": f"count(*) FILTER ({_P} AND flag & 7 = 3)", "paired": f"count(*) FILTER ({_P} AND flag & 1 <> 0)",
    "duplicated": f"count(*) FILTER ({_P} AND flag & 1024 <> 0)", "mq0": f"count(*) FILTER ({_P} AND flag & 4 = 0 AND mapq = 0)", "qc_failed": f"count(*) FILTER ({_P} AND flag & 512 <> 0)", "non_primary": "count(*) FILTER (flag & 256 <> 0)",
    "supplementary": "count(*) FILTER (flag & 2048 <> 0)", "total_length": f"sum(len) FILTER ({_P})", "bases_mapped": f"sum(len) FILTER ({_P} AND flag & 4 = 0)", "max_length": f"max(len) FILTER ({_P})",
}

QUERIES = {
    "alignment_view": (view, al_sql("SELECT id, qname, pos, mapq FROM al WHERE flag & 3 = 3 AND flag & 2308 = 0 AND flag & 80 <> 80 AND mapq >= 20")),
    "flag_statistics": (flag_statistics, al_sql(" UNION ALL ".join(f"SELECT '{k}' AS counter, count(*) FILTER ({c} AND flag & 512 = 0) AS passed, count(*) FILTER ({c} AND flag & 512 <> 0) AS failed FROM al" for k, c in _COUNTERS.items()))),
    "index_statistics": (index_statistics, al_sql("SELECT rname, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 <> 0) AS unmapped FROM al GROUP BY rname")),
    "position_depth": (depth, al_sql("""SELECT chrom, count(*) AS n, sum(pos)::BIGINT AS pos, sum(depth)::BIGINT AS depth, max(depth) AS most FROM (
      SELECT chrom, pos + 1 AS pos, count(*) AS depth FROM (SELECT chrom, unnest(range(start, "end")) AS pos FROM rd) GROUP BY ALL) GROUP BY chrom""", _RUNS)),
    "contig_coverage": (contig_coverage, al_sql("""SELECT g.chrom, coalesce(reads, 0) AS reads, coalesce(covered, 0)::BIGINT AS covered, round(100.0 * coalesce(covered, 0) / length, 6) AS percent,
      round(coalesce(bases, 0) / length, 6) AS mean_depth, round(mean_mapq, 6) AS mean_mapq FROM g LEFT JOIN (SELECT chrom, count(*) AS reads, avg(mapq) AS mean_mapq FROM rd GROUP BY chrom) USING (chrom)
      LEFT JOIN (SELECT chrom, sum("end" - start) AS covered, sum(("end" - start) * depth) AS bases FROM rr WHERE depth > 0 GROUP BY chrom) USING (chrom)""", _RUNS)),
    "mark_duplicates": (mark_duplicates, al_sql("""SELECT x.id, CASE WHEN pair THEN coalesce(lost, FALSE) WHEN seen THEN anypair OR rk > 1 ELSE FALSE END AS is_duplicate FROM (
      SELECT *, bool_or(pair) OVER (PARTITION BY rname, start5, rev) AS anypair, row_number() OVER (PARTITION BY rname, start5, rev ORDER BY CASE WHEN seen AND NOT pair THEN 0 ELSE 1 END, quality DESC, id) AS rk FROM e) x
      LEFT JOIN (SELECT qname, row_number() OVER (PARTITION BY key ORDER BY total DESC, qname) > 1 AS lost FROM (
        SELECT qname, list_sort(list((rname, start5, rev))) AS key, sum(quality) AS total FROM e WHERE pair GROUP BY qname HAVING count(*) = 2)) l USING (qname)""",
      "e AS (SELECT *, pos // 50 AS start5, flag & 16 <> 0 AS rev, flag & 2820 = 0 AS seen, flag & 2820 = 0 AND flag & 9 = 1 AS pair FROM al)")),
    "window_depth": (window_depth, al_sql("""SELECT chrom, w * 500 AS start, max(pos) + 1 AS "end", round(avg(depth), 6) AS mean FROM (
      SELECT g.chrom, g.pos, g.pos // 500 AS w, coalesce(depth, 0) AS depth FROM (SELECT chrom, unnest(range(0, length)) AS pos FROM g) g LEFT JOIN (
        SELECT chrom, pos, count(*) AS depth FROM (SELECT chrom, unnest(range(start, "end")) AS pos FROM rd) GROUP BY ALL) d ON g.chrom = d.chrom AND g.pos = d.pos) GROUP BY chrom, w""", _RUNS)),
    "quantized_depth": (quantized_depth, al_sql("""SELECT chrom, min(start) AS start, max("end") AS "end", bin FROM (
      SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY start) AS run FROM (
        SELECT *, CASE WHEN bin = lag(bin) OVER (PARTITION BY chrom ORDER BY start) THEN 0 ELSE 1 END AS f FROM (SELECT *, CASE WHEN depth < 1 THEN 0 WHEN depth < 4 THEN 1 ELSE 2 END AS bin FROM runs)))
      GROUP BY chrom, run, bin""", _RUNS)),
    "depth_distribution": (depth_distribution, al_sql("""SELECT chrom, depth, round(sum(n) OVER (PARTITION BY chrom ORDER BY depth DESC) / sum(n) OVER (PARTITION BY chrom), 9) AS share FROM (
      SELECT chrom, depth::BIGINT AS depth, sum("end" - start) AS n FROM (SELECT * FROM runs UNION ALL SELECT 'total', start, "end", depth FROM runs) GROUP BY ALL)""", _RUNS)),
    "summary_numbers": (summary_numbers, al_sql(" UNION ALL ".join(f"SELECT '{k}' AS key, ({c})::BIGINT AS value FROM al" for k, c in _NUMBERS.items()))),
    "length_histogram": (length_histogram, al_sql("SELECT len AS value, count(*) AS n FROM al WHERE flag & 2304 = 0 GROUP BY len")),
    "mapq_histogram": (mapq_histogram, al_sql("SELECT mapq AS value, count(*) AS n FROM al WHERE flag & 2304 = 0 GROUP BY mapq")),
    "alignment_intervals": (alignment_intervals, al_sql("""SELECT rname AS chrom, pos - 1 AS start, pos - 1 + len AS "end", qname AS name, mapq AS score, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand FROM al WHERE flag & 4 = 0""")),
    "fix_mates": (fix_mates, al_sql("""SELECT x.id, y.pos AS mate_pos, y.mapq AS mate_mapq, CASE WHEN y.id IS NULL THEN 0
      WHEN x.pos < y.pos OR x.pos = y.pos AND x.k THEN greatest(x.pos + x.len, y.pos + y.len) - least(x.pos, y.pos) ELSE least(x.pos, y.pos) - greatest(x.pos + x.len, y.pos + y.len) END AS template
      FROM o x LEFT JOIN o y ON x.qname = y.qname AND x.k <> y.k""",
      "o AS (SELECT *, flag & 64 <> 0 AS k FROM al WHERE flag & 2304 = 0 QUALIFY row_number() OVER (PARTITION BY qname, flag & 64 <> 0 ORDER BY id) = 1)")),
}
