"""Mixing sources to target weights by Pareto order sampling.

Every document gets an expected number of copies; the whole part is certain, and the rest is
drawn by ranking random odds divided by inclusion odds.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import packed, running, space_word_count, text_key, unpacked, written

#: Buckets of the ranking inside a source; a source of any size spreads over them.
BUCKETS = 1024
#: Most rows of the plan, a few tens for each source, that are broadcast.
MAX_BROADCAST_ROWS = 100_000


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), the number of sources being moderate.

    Sources sorted by code point, null last, take the weights in turn and share the total size
    by weight; a target stops at ``most`` times the source's size and the excess is shared again
    by weight among the others, until none is above.  In closed form: with the sources sorted by
    most * size / weight, the first k are at their stop, where k is the least number for which
    the others' share fits.
    """
    name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(name) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sources.withColumn("weight", weight).withColumn("stop", most * F.col("source_size"))
    before = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source")).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    x = x.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.col("level") <= F.col("stop") / F.col("weight") * (1 + 1e-12)
    x = x.withColumn("level", F.max_by("level", F.struct(fits.cast("int"), -F.col("stop") / F.col("weight"))).over(whole))
    return x.select("source", F.col("source_size").cast("long").alias("source_size"), F.least("stop", F.col("level") * F.col("weight")).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that the key decides."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, slope: float = 0.25, seed: int = 11) -> DataFrame:
    """One row per document: id, tk, source, size, source_size, target, copies, taken (size * copies).

    Size is the number of white-space separated words.  Inside a source, expected copies are
    proportional to (1 + slope / sqrt(1 + log2 size)): shorter documents are a little likelier,
    which makes inclusion probabilities unequal, up to ``most``.  They are scaled so that the
    expected words of the source are its target.  The fractional parts are drawn in the order of
    u / (1 - u) divided by p / (1 - p) until the source's words are as near to the target as
    whole documents allow.  Documents without words are never taken.  Repeated rows share their
    random number and stand side by side in that order; the same ``seed`` gives the same result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_key(F.col(text_col)).alias("tk"), space_word_count(F.col(text_col)).alias("size"))
    rows = rows.withColumn("level", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    rows = written(rows, "sizes")
    levels = rows.groupBy("source", "level").agg(F.sum("size").alias("words"))
    targets = source_targets(levels.groupBy("source").agg(F.sum("words").alias("source_size")), weights, float(most))
    # Scale of each source: with m falling over the levels, the first k levels are at ``most`` copies.
    m = 1 + slope / F.sqrt(1 + F.col("level"))
    x = levels.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("m", m)
    before = Window.partitionBy("source").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("source").orderBy("level").rowsBetween(0, Window.unboundedFollowing)
    scale = (F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.nullif(F.sum(F.col("words") * F.col("m")).over(after), F.lit(0.0))
    x = x.withColumn("scale", scale)
    fits = F.col("scale") * F.col("m") <= most + 1e-9
    x = x.withColumn("scale", F.max_by("scale", F.struct(fits.cast("int"), -F.col("level"))).over(Window.partitionBy("source")))
    x = x.withColumn("expected", F.least(F.lit(float(most)), F.coalesce(F.col("scale"), F.lit(0.0)) * F.col("m")))
    x = x.withColumns({"sure": F.floor(F.col("expected") + 1e-9), "part": F.greatest(F.lit(0.0), F.col("expected") - F.floor(F.col("expected") + 1e-9))})
    whole = Window.partitionBy("source")
    need = F.col("target") - F.sum(F.col("sure") * F.col("words")).over(whole)
    drawn_from = F.sum(F.when(F.col("part") > 1e-9, F.col("words")).otherwise(0)).over(whole)
    x = x.withColumns({"need": need, "mean": F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.coalesce(need / F.nullif(drawn_from, F.lit(0)), F.lit(0.5))))})
    plan = written(x.select(F.col("source").alias("_source"), F.col("level").alias("_level"), "source_size", "target", "sure", "part", "need", "mean"), "plan")
    small = F.broadcast if plan.count() <= MAX_BROADCAST_ROWS else lambda df: df
    drawn = rows.join(small(plan), rows["source"].eqNullSafe(plan["_source"]) & (rows["level"] == plan["_level"]))
    u, p = uniform(F.struct("id", "tk"), seed), F.col("part")
    drawn = drawn.withColumn("rank", F.when((p > 1e-9) & (F.col("size") > 0), (u / (1 - u)) / (p / (1 - p))))
    # Ranks relative to the source's mean odds spread evenly over the buckets.
    relative = F.col("rank") * F.col("mean") / (1 - F.col("mean"))
    bucket = F.least(F.lit(BUCKETS - 1), F.floor(relative / (1 + relative) * BUCKETS)).cast("int")
    drawn = drawn.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("none")))
    ranked = running(drawn.filter("rank is not null"), ["key"], bucket, [F.col("rank"), F.col("id"), F.col("tk")], F.col("size"), "before")
    # The document that crosses the need is taken where at least half of it fits.
    taken = ranked.withColumn("extra", (F.col("before") + F.col("size") / 2 <= F.col("need")).cast("int")).drop("before")
    every = taken.unionByName(drawn.filter("rank is null").withColumn("extra", F.lit(0)))
    copies = F.when(F.col("size") > 0, F.col("sure") + F.col("extra")).otherwise(0).cast("int")
    return every.select("id", "tk", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with all its columns."""
    n = mix(docs, id_col, source_col, text_col, **options).filter("copies > 0").groupBy("id", "source", "tk").agg(F.sum("copies").alias("_copies"))
    n = n.select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("tk").alias("_mix"), F.col("_copies").cast("int").alias("_copies"))
    keyed = packed(docs, _i=F.col(id_col), _s=F.col(source_col), _t=text_key(F.col(text_col)))
    same = keyed["_i"].eqNullSafe(n["_id"]) & keyed["_s"].eqNullSafe(n["_source"]) & (keyed["_t"] == n["_mix"])
    # Equal rows share a key and its copies: the first of them carries all.
    nth = F.row_number().over(Window.partitionBy("_id", "_source", "_mix").orderBy("_copies"))
    one = keyed.join(n, same).withColumn("_nth", nth).filter("_nth = 1")
    return unpacked(one.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_copies")))))
