"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

DataFrame operations only.  Documents are linked where their texts are equal.  The propagation
runs on cells (group, shard, number of documents): documents of one group in one shard are
interchangeable, so a group of any size is 40 rows at most, and no pairs are ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import forget, running, text_key, written

#: Buckets of the running sums; each holds that share of a shard's or of all groups.
BUCKETS = 1024


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _literals(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _first_cells(groups: DataFrame, shards: int) -> DataFrame:
    """Deals all linked documents round robin, in hash order of their groups: sizes start even, links are cut."""
    dealt = running(groups, [], _bucket("g"), [F.col("g")], F.col("n"), "at")
    k = F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(shards)).cast("int") - 1))
    cells = dealt.select("g", "n", "at", k.alias("k"))
    share = F.floor(F.col("n") / shards) + (F.col("k") < F.pmod(F.col("n"), F.lit(shards))).cast("long")
    return cells.select("g", F.pmod(F.col("at") + F.col("k"), F.lit(shards)).cast("int").alias("shard"), share.cast("long").alias("n"))


def _loads(cells: DataFrame, shards: int) -> list[int]:
    """Documents of each shard; one row a shard comes to the driver."""
    by = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [by.get(j, 0) for j in range(shards)]


def _moves(cells: DataFrame, free: list[int], capacity: int) -> DataFrame:
    """One round: (g, shard, target, n) of the documents that move.

    In each group the largest cells of shards with room attract the smaller cells; a group
    larger than a shard has as many attracting cells as it needs shards.  A target admits
    movers up to its free quota, in hash order.
    """
    rank = Window.partitionBy("g").orderBy(F.desc("n"), F.xxhash64("g", "shard"), "shard")
    whole = Window.partitionBy("g")
    room = F.element_at(_literals(free), F.col("shard") + 1) > 0
    x = cells.withColumns({"r": F.row_number().over(rank), "room": room.cast("int"), "need": F.ceil(F.sum("n").over(whole) / capacity)})
    x = x.withColumn("pulls", (F.col("room") == 1) & (F.sum("room").over(rank) <= F.col("need")))
    x = x.withColumns({
        "last": F.max(F.when(F.col("pulls"), F.col("r"))).over(whole),
        "targets": F.array_sort(F.collect_list(F.when(F.col("pulls"), F.struct("r", "shard"))).over(whole)),
    })
    wants = x.filter(F.col("r") > F.col("last")).select("g", "shard", "n", F.get("targets", F.pmod(F.col("r"), F.size("targets")).cast("int"))["shard"].alias("target"))
    queued = running(wants, ["target"], _bucket("g"), [F.col("g"), F.col("shard")], F.col("n"), "before")
    admitted = F.least(F.col("n"), F.element_at(_literals(free), F.col("target") + 1) - F.col("before"))
    return queued.withColumn("n", admitted).filter("n > 0").select("g", "shard", "target", "n")


def propagate(groups: DataFrame, total: int, shards: int, rounds: int) -> DataFrame:
    """Cells (g, shard, n) of the linked documents after at most ``rounds`` rounds; no shard exceeds its final row count."""
    quota = [total // shards + (j < total % shards) for j in range(shards)]
    cells = written(_first_cells(groups, shards), "cells")
    for _ in range(rounds):
        free = [q - used for q, used in zip(quota, _loads(cells, shards), strict=True)]
        moves = _moves(cells, free, max(1, total // shards))
        both = cells.select("g", "shard", "n").unionByName(moves.select("g", "shard", (-F.col("n")).alias("n"))).unionByName(moves.select("g", F.col("target").alias("shard"), "n"))
        after = written(both.groupBy("g", "shard").agg(F.sum("n").alias("n"), F.count("n").alias("parts")).filter("n > 0"), "cells")
        forget(cells)
        cells = after
        if after.filter("parts > 1").isEmpty():  # nothing moved
            break
    return cells.select("g", "shard", "n")


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, rounds: int = 40, overhead: int = 16, salts: int = 256) -> DataFrame:
    """Shard and slot of every document under the law ``rows``: shard counts differ by one at most.

    Returns id, size (UTF-8 bytes plus ``overhead``; null text: no bytes), text_crc32, law,
    shard, slot (gapless from 0 in each shard), grown_shard (null: this law has none).  Null and
    empty texts are one group of equal texts.  Repeated rows get a slot each; an empty table
    gives an empty result.  Propagation ends when nothing moves, or after ``rounds`` rounds; links that
    are cut then stay cut, and sizes are even in any case.  Documents without links fill what room the linked ones leave.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("crc"), text_key(F.col(text_col)).alias("g"))
    rows = written(rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")), "rows")
    parts = rows.groupBy("g", "salt").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("g").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("g", "salt", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy("g")).alias("all"))
    parts = written(parts, "parts")
    total = rows.count()
    groups = parts.filter((F.col("all") > 1) & (F.col("ahead") == 0)).select("g", F.col("all").alias("n"))
    cells = propagate(groups, total, shards, rounds)
    load = _loads(cells, shards)
    fill = [total // shards + (j < total % shards) - load[j] for j in range(shards)]
    start = [sum(fill[:j]) for j in range(shards)]

    # Linked documents: each cell is a range of ranks in its group and a range of slots in its shard.
    cells = running(cells, ["shard"], _bucket("g"), [F.col("g")], F.col("n"), "slot0")
    inside = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("rank0", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    of_group = cells.groupBy("g").agg(F.collect_list(F.struct("rank0", "n", "shard", "slot0")).alias("cells"))
    linked = parts.filter("all > 1").join(of_group, "g")
    linked = linked.select("g", "salt", "ahead", F.filter("cells", lambda c: (c["rank0"] < F.col("ahead") + F.col("n")) & (c["rank0"] + c["n"] > F.col("ahead"))).alias("cells"))

    # The others: shards are filled one after another, in hash order.
    single = running(parts.filter("all = 1").select("g", "salt"), [], _bucket("g"), [F.col("g")], F.lit(1), "at")
    shard = F.size(F.filter(_literals(start), lambda s: s <= F.col("at"))) - 1
    full = F.element_at(_literals(load), shard + 1) + F.col("at") - F.element_at(_literals(start), shard + 1)
    one = F.array(F.struct(F.lit(0).cast("long").alias("rank0"), F.lit(1).cast("long").alias("n"), shard.cast("int").alias("shard"), full.cast("long").alias("slot0")))
    single = single.select("g", "salt", F.lit(0).cast("long").alias("ahead"), one.alias("cells"))

    place = linked.unionByName(single)
    within = Window.partitionBy("g", "salt").orderBy("id")
    ranked = rows.withColumn("nth", F.row_number().over(within) - 1)
    rank = F.col("nth") + F.col("ahead")
    own = F.filter("cells", lambda c: (c["rank0"] <= rank) & (rank < c["rank0"] + c["n"]))[0]
    return ranked.join(place, ["g", "salt"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
        own["shard"].cast("int").alias("shard"), (own["slot0"] + rank - own["rank0"]).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
