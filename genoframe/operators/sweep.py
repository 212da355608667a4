"""Sweeps: islands, depth runs, complements and other results of one ordered pass over a chromosome.

Ordered passes are windows over tiles of a chromosome; what a tile needs from the tiles before it
(furthest end, last island, depth at its border) comes from one row for each tile, so a
chromosome of any length spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import TILE, ahead_of, running_sum


def islands(df: DataFrame, gap: int = 0, by: tuple[str, ...] = ("chrom",), order: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """Adds ``island``: the start of the run of intervals that touch or lie within ``gap``, which names the run within ``by``."""
    keys = [*by, "_tile"]
    x = df.withColumn("_tile", F.floor(F.col("start") / tile))
    tops = x.groupBy(*keys).agg(F.max("end").alias("_top")).select(*keys, F.max("_top").over(ahead_of(by)).alias("_before"))
    w = Window.partitionBy(*keys).orderBy("start", "end", *order)
    x = x.join(tops, keys)
    reach = F.greatest(F.col("_before"), F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_reach", reach).withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap), F.col("start")))
    heads = x.groupBy(*keys).agg(F.max("_new").alias("_head")).select(*keys, F.max("_head").over(ahead_of(by)).alias("_last"))
    # Rows of one start are of one run; the frame takes them together, as ties may come in another order than above.
    own = F.max("_new").over(Window.partitionBy(*keys).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return x.join(heads, keys).withColumn("island", F.greatest(F.col("_last"), own)).drop("_tile", "_before", "_reach", "_new", "_last")


def merge(df: DataFrame, gap: int = 0, by_strand: bool = False, strand: str | None = None, aggs: list[Column] | None = None) -> DataFrame:
    """Merged intervals (chrom[, strand], start, end) and aggregates over each; by strand, unknown strands are dropped."""
    by = ("chrom", "strand") if by_strand else ("chrom",)
    if by_strand:
        df = df.filter(F.col("strand").isin("+", "-"))
    if strand:
        df = df.filter(F.col("strand") == strand)
    return islands(df, gap, by).groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *(aggs or [])).drop("island")


def cluster(df: DataFrame, gap: int = 0, by_strand: bool = False) -> DataFrame:
    """The intervals with a cluster number, counted in (chrom[, strand], start) order over all chromosomes."""
    by = ("chrom", "strand") if by_strand else ("chrom",)
    if by_strand:
        df = df.filter(F.col("strand").isin("+", "-"))
    local = islands(df, gap, by)
    heads = running_sum(local.select(*by, "island").distinct(), by, F.floor(F.col("island") / TILE), [F.col("island")], F.lit(1), "_nth")
    counts = heads.groupBy(*by).agg(F.count("*").alias("_n"))
    before = counts.select(*by, F.coalesce(F.sum("_n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    numbered = heads.join(before, list(by)).select(*by, "island", (F.col("_earlier") + F.col("_nth") + 1).alias("cluster"))
    return local.join(numbered, [*by, "island"]).drop("island")


def depth_runs(df: DataFrame, by: tuple[str, ...] = ("chrom",), weight: Column | None = None, tile: int = TILE) -> DataFrame:
    """Maximal runs (by, start, end, depth) of equal depth between the first and last end of each chromosome.

    Each interval is two events; events of one place are summed before the running sum.
    """
    weight = F.lit(1) if weight is None else weight
    events = df.select(*by, F.explode(F.array(F.struct(F.col("start").alias("pos"), weight.alias("delta")), F.struct(F.col("end").alias("pos"), (-weight).alias("delta")))).alias("e")).select(*by, "e.pos", "e.delta")
    net = events.groupBy(*by, "pos").agg(F.sum("delta").alias("delta")).filter("delta != 0").withColumn("_tile", F.floor(F.col("pos") / tile))
    keys = [*by, "_tile"]
    after = Window.partitionBy(*by).orderBy("_tile")
    tiles = net.groupBy(*keys).agg(F.sum("delta").alias("_sum"), F.min("pos").alias("_first"))
    tiles = tiles.select(*keys, F.coalesce(F.sum("_sum").over(ahead_of(by)), F.lit(0)).alias("_base"), F.lead("_first").over(after).alias("_next"))
    w = Window.partitionBy(*keys).orderBy("pos")
    depth = F.col("_base") + F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = net.join(tiles, keys).select(*by, F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(w), F.col("_next")).alias("end"), depth.alias("depth"))
    return runs.filter(F.col("end").isNotNull())


def genome_coverage(df: DataFrame, genome: DataFrame, how: str = "bg", scale: float = 1.0, end: str | None = None) -> DataFrame:
    """Depth over a genome (chrom, length).

    bg: runs of positive depth; bga: also of zero, over whole chromosomes; hist: bases of each
    depth by chromosome and for the genome, with fractions; d: 1-based positions, zeros too;
    dz: 0-based positions of positive depth.  ``end`` '5' or '3' counts that base of each interval alone.
    """
    if end:
        first = (F.col("strand") != "-") if end == "5" else (F.col("strand") == "-")
        df = df.select("chrom", F.when(first, F.col("start")).otherwise(F.col("end") - 1).alias("start")).withColumn("end", F.col("start") + 1)
    inside = df.join(genome, "chrom").select("chrom", F.greatest("start", F.lit(0)).alias("start"), F.least("end", "length").alias("end")).filter("start < end")
    whole = genome.select("chrom", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))
    # A zero-weight cover of each chromosome makes the runs without depth appear.
    runs = depth_runs(inside)
    edges = whole.join(runs.groupBy("chrom").agg(F.min("start").alias("first"), F.max("end").alias("last")), "chrom", "left")
    head = edges.select("chrom", F.lit(0).cast("long").alias("start"), F.coalesce("first", "end").alias("end"), F.lit(0).cast("long").alias("depth"))
    tail = edges.filter(F.col("last").isNotNull()).select("chrom", F.col("last").alias("start"), "end", F.lit(0).cast("long").alias("depth"))
    every = runs.unionByName(head).unionByName(tail).filter("start < end")
    if how == "bg":
        return runs.filter("depth > 0").withColumn("depth", F.col("depth") * scale)
    if how == "bga":
        return every.withColumn("depth", F.col("depth") * scale)
    if how == "hist":
        bases = every.groupBy("chrom", "depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
        total = bases.groupBy("depth").agg(F.sum("bases").alias("bases")).select(F.lit("genome").alias("chrom"), "depth", "bases")
        size = genome.unionByName(genome.agg(F.sum("length").alias("length")).select(F.lit("genome").alias("chrom"), "length"))
        return bases.unionByName(total).join(size, "chrom").withColumn("fraction", F.col("bases") / F.col("length"))
    shift = 1 if how == "d" else 0
    runs = every if how == "d" else every.filter("depth > 0")
    each = runs.select("chrom", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "depth")
    return each.withColumn("pos", F.col("pos") + shift)


def complement(df: DataFrame, genome: DataFrame, only_present: bool = False) -> DataFrame:
    """Gaps (chrom, start, end) that no interval covers; absent chromosomes are whole gaps unless only present ones count."""
    merged = merge(df.join(genome, "chrom").withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", "length")}).filter("start <= end"))
    ends = genome.select("chrom", F.col("length").alias("start"), F.col("length").alias("end"))
    if only_present:
        ends = ends.join(df.select("chrom").distinct(), "chrom", "left_semi")
    w = Window.partitionBy("chrom").orderBy("start", "end")
    both = merged.select("chrom", "start", "end").unionByName(ends)
    return both.select("chrom", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("gap_start"), F.col("start").alias("gap_end")).filter("gap_start < gap_end").select("chrom", F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))


def spacing(df: DataFrame, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Distance to the interval before in (start, end) order: null for the first, -1 overlapping, 0 touching."""
    w = Window.partitionBy("chrom").orderBy("start", "end", *order)
    before = F.lag("end").over(w)
    return df.withColumn("spacing", F.when(F.col("start") < before, F.lit(-1)).otherwise(F.col("start") - before))


def subtract(a: DataFrame, b: DataFrame, whole: bool = False, f: float | None = None, n: float | None = None, strand: str | None = None) -> DataFrame:
    """Parts of A (id, chrom, start, end) that B leaves.

    ``whole``: A with any hit goes; ``f``: a hit counts from that share of A on; ``n``: A goes if
    the union of hits is more than that share.
    """
    from .overlap import intersect_pairs

    pairs = intersect_pairs(a, b, f=f, strand=strand)
    if whole:
        return a.join(pairs.select(F.col("a_id").alias("id")).distinct(), "id", "left_anti").select("id", "chrom", "start", "end")
    cut = pairs.select(F.col("a_id").alias("id"), "start", "end")
    if n is not None:
        covered = islands(cut, 0, ("id",)).groupBy("id", "island").agg((F.max("end") - F.min("start")).alias("bp")).groupBy("id").agg(F.sum("bp").alias("bp"))
        return a.join(covered, "id", "left").filter(F.coalesce("bp", F.lit(0)) <= n * (F.col("end") - F.col("start"))).select("id", "chrom", "start", "end")
    own = a.select("id", "chrom", "start", "end")
    stops = own.select("id", F.col("end").alias("start"), "end")
    w = Window.partitionBy("id").orderBy("start", "end")
    pieces = cut.unionByName(stops).join(own.select("id", "chrom", F.col("start").alias("a_start")), "id")
    left = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("a_start"))
    return pieces.select("id", "chrom", left.alias("s"), F.col("start").alias("e")).filter("s < e").select("id", "chrom", F.col("s").alias("start"), F.col("e").alias("end"))


def multi_intersect(sets: dict[str, DataFrame]) -> DataFrame:
    """Segments (chrom, start, end, n, names) that one or more sets cover, cut wherever any set starts or ends."""
    merged = [merge(df).select("chrom", "start", "end", F.lit(name).alias("name")) for name, df in sets.items()]
    every = merged[0]
    for m in merged[1:]:
        every = every.unionByName(m)
    flags = {name: f"in_{name}" for name in sets}
    points = every.select("chrom", "name", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e")).select("chrom", "name", "e.pos", "e.d")
    net = points.groupBy("chrom", "pos").agg(*[F.sum(F.when(F.col("name") == k, F.col("d")).otherwise(0)).alias(v) for k, v in flags.items()])
    w = Window.partitionBy("chrom").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    seg = net.select("chrom", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), *[F.sum(v).over(run).alias(v) for v in flags.values()])
    n = sum((F.col(v) for v in flags.values()), F.lit(0))
    names = F.concat_ws(",", *[F.when(F.col(v) > 0, F.lit(k)) for k, v in sorted(flags.items())])
    return seg.filter(F.col("end").isNotNull() & (n > 0)).withColumns({"n": n, "names": names})


def union_bedgraph(graphs: dict[str, DataFrame], filler: float = 0.0, value: str = "value") -> DataFrame:
    """Segments with the value of each non-overlapping graph (chrom, start, end, value); ``filler`` where a graph has none."""
    events = None
    for name, df in graphs.items():
        e = df.select("chrom", F.lit(name).alias("name"), F.explode(F.array(F.struct(F.col("start").alias("pos"), F.col(value).cast("double").alias("v"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), (-F.col(value)).cast("double").alias("v"), F.lit(-1).alias("d")))).alias("e"))
        events = e if events is None else events.unionByName(e)
    events = events.select("chrom", "name", "e.pos", "e.v", "e.d")
    pick = lambda name, c: F.sum(F.when(F.col("name") == name, F.col(c)).otherwise(0))
    net = events.groupBy("chrom", "pos").agg(*[pick(n, "v").alias(f"v_{n}") for n in graphs], *[pick(n, "d").alias(f"d_{n}") for n in graphs])
    w = Window.partitionBy("chrom").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    seg = net.select("chrom", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), *[F.sum(f"v_{n}").over(run).alias(f"v_{n}") for n in graphs], *[F.sum(f"d_{n}").over(run).alias(f"d_{n}") for n in graphs])
    some = F.lit(False)
    for n in graphs:
        some = some | (F.col(f"d_{n}") > 0)
    return seg.filter(F.col("end").isNotNull() & some).select("chrom", "start", "end", *[F.when(F.col(f"d_{n}") > 0, F.col(f"v_{n}")).otherwise(filler).alias(n) for n in graphs])
