"""Overlap joins: interval pairs by shared bins, with fraction and strand predicates.

An interval is put into every bin that it touches; the join is an equi-join on (chrom, bin) with
the overlap as residual predicate, and a pair that shares several bins is kept in the first one
alone.  Bin width follows the data where it is not given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import TILE, running_sum

STRAND_POLICIES = ("strict", "nonempty", "plain", "lenient")


def strand_predicate(policy: str, mode: str | None, a: Column, b: Column) -> Column:
    """Whether two strands agree (``mode`` same) or disagree (opposite).

    Policies differ on unknown strands ('.', empty, null): strict: never pass; nonempty: only
    empty and null fail; plain: compared as they are; lenient: always pass.
    """
    if mode is None:
        return F.lit(True)
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    test = a == b if mode == "same" else a != b
    known = lambda x: x.isin("+", "-")
    if policy == "strict":
        return known(a) & known(b) & test
    if policy == "nonempty":
        return (a != "") & (b != "") & test
    if policy == "plain":
        return test
    if policy == "lenient":
        return ~known(a) | ~known(b) | test
    raise ValueError(f"unknown strand policy {policy!r}")


def fraction_predicate(overlap: Column, a_len: Column, b_len: Column, f: float | None = None, F_: float | None = None, reciprocal: bool = False, either: bool = False) -> Column:
    """Overlap fractions: ``f`` of A and ``F_`` of B; reciprocal: B's is A's where it is not set; either: one suffices if both are set."""
    if reciprocal and F_ is None:
        F_ = f
    tests = [overlap >= share * length for share, length in ((f, a_len), (F_, b_len)) if share]
    if not tests:
        return F.lit(True)
    if len(tests) == 2:
        return tests[0] | tests[1] if either else tests[0] & tests[1]
    return tests[0]


def widened(start: Column, end: Column) -> tuple[Column, Column]:
    """Zero-length intervals grow by one base on each side, for detection only."""
    empty = start == end
    return F.when(empty, start - 1).otherwise(start), F.when(empty, end + 1).otherwise(end)


def bin_width(df: DataFrame) -> int:
    """Four times the median length, as a power of two from 16 to 2^20: one small aggregate."""
    median = df.agg(F.percentile_approx(F.col("end") - F.col("start"), 0.5)).first()[0] or 1
    width = 16
    while width < 4 * median and width < 1 << 20:
        width *= 2
    return width


def overlap_pairs(a: DataFrame, b: DataFrame, width: int | None = None, left: int = 0, right: int = 0) -> DataFrame:
    """Overlapping pairs with a's columns prefixed ``a_`` and b's prefixed ``b_``, plus ``overlap`` (un-widened bp).

    Both frames need chrom, start, end.  ``left`` and ``right`` extend A for detection.
    """
    width = width or bin_width(b)
    a_s, a_e = widened(F.col("a_start") - left, F.col("a_end") + right)
    b_s, b_e = widened(F.col("b_start"), F.col("b_end"))

    def bins(df: DataFrame, prefix: str, s: Column, e: Column) -> DataFrame:
        df = df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns]).withColumns({f"{prefix}_s": s, f"{prefix}_e": e})
        return df.withColumn(f"{prefix}_bin", F.explode(F.sequence(F.floor(F.col(f"{prefix}_s") / width), F.floor((F.col(f"{prefix}_e") - 1) / width))))

    x, y = bins(a, "a", a_s, a_e), bins(b, "b", b_s, b_e)
    first = F.floor(F.greatest("a_s", "b_s") / width)
    met = (F.col("a_chrom") == F.col("b_chrom")) & (F.col("a_bin") == F.col("b_bin")) & (F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e")) & (F.col("a_bin") == first)
    overlap = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return x.join(y, met).withColumn("overlap", overlap).drop("a_bin", "b_bin", "a_s", "a_e", "b_s", "b_e")


def intersect_pairs(a: DataFrame, b: DataFrame, f: float | None = None, F_: float | None = None, reciprocal: bool = False, either: bool = False, strand: str | None = None, policy: str = "strict", width: int | None = None) -> DataFrame:
    """Pairs that pass the fraction and strand predicates, with the clipped interval (start, end)."""
    pairs = overlap_pairs(a, b, width)
    ok = fraction_predicate(F.col("overlap"), F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start"), f, F_, reciprocal, either)
    if strand:
        ok = ok & strand_predicate(policy, strand, F.col("a_strand"), F.col("b_strand"))
    return pairs.filter(ok).withColumns({"start": F.greatest("a_start", "b_start"), "end": F.least("a_end", "b_end")})


def _edges_before(b: DataFrame, edge: str, a: DataFrame, place: str, out: str, closed: bool) -> DataFrame:
    """A with ``out``: how many rows of B have their edge before A's place, or at it where that is closed."""
    points = b.groupBy("chrom", F.col(edge).alias("pos")).agg(F.count("*").alias("n")).withColumn("_turn", F.lit(0 if closed else 1))
    asked = a.select("chrom", F.col(place).alias("pos")).distinct().withColumns({"n": F.lit(0).cast("long"), "_turn": F.lit(1 if closed else 0)})
    ahead = running_sum(points.unionByName(asked).withColumn("_asked", F.col("_turn") == (1 if closed else 0)), ("chrom",), F.floor(F.col("pos") / TILE), [F.col("pos"), F.col("_turn")], F.col("n"), out)
    return a.join(ahead.filter("_asked").select("chrom", F.col("pos").alias(place), out), ["chrom", place])


def count_hits(a: DataFrame, b: DataFrame) -> DataFrame:
    """A with ``hits``, the number of B that overlap each, without going through the pairs.

    B that start before A's end, less those that end at or before A's start; A without a chromosome
    or a place has none.
    """
    a_s, a_e = widened(F.col("start"), F.col("end"))
    b_s, b_e = widened(F.col("start"), F.col("end"))
    x = a.withColumns({"_s": a_s, "_e": a_e})
    y = b.select("chrom", b_s.alias("s"), b_e.alias("e")).filter("chrom is not null and s < e")
    placed = F.col("chrom").isNotNull() & (F.col("_s") < F.col("_e"))
    met = _edges_before(y, "e", _edges_before(y, "s", x.filter(placed), "_e", "_begun", False), "_s", "_over", True)
    rest = x.filter(~F.coalesce(placed, F.lit(False))).select(*a.columns, F.lit(0).cast("long").alias("hits"))
    return met.select(*a.columns, (F.col("_begun") - F.col("_over")).alias("hits")).unionByName(rest)


def intersect(a: DataFrame, b: DataFrame, how: str = "inner", **predicates) -> DataFrame:
    """Intersection forms on frames with a unique ``id``.

    inner: clipped pairs; left: also A without a hit, B null and overlap 0; semi: A with a hit;
    anti: A without; count: A with its number of hits.  Without predicates the last three count
    ends of B and make no pairs.
    """
    if how in ("semi", "anti", "count") and not any(predicates.get(k) for k in ("f", "F_", "strand")):
        x = count_hits(a, b)
        return x if how == "count" else x.filter(F.col("hits") > 0 if how == "semi" else F.col("hits") == 0).drop("hits")
    pairs = intersect_pairs(a, b, **predicates)
    if how == "inner":
        return pairs
    if how == "left":
        right = pairs.drop(*[f"a_{c}" for c in a.columns if c != "id"]).withColumnRenamed("a_id", "id")
        prefixed = a.select("id", *[F.col(c).alias(f"a_{c}") for c in a.columns if c != "id"])
        return prefixed.join(right, "id", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0))).withColumnRenamed("id", "a_id")
    hits = pairs.groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("hits"))
    if how in ("semi", "anti"):
        return a.join(hits, "id", f"left_{how}")
    if how == "count":
        return a.join(hits, "id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    raise ValueError(f"unknown form {how!r}")


def intersect_blocks(a: DataFrame, b: DataFrame, f: float | None = None) -> DataFrame:
    """Block-aware hits: (a_id, b_id, overlap) where blocks of A meet B, overlaps summed over blocks.

    ``a`` has one row for each block (id, chrom, start, end), ``b`` a unique id.  The fraction is
    tested once for each A: the union of all its hits over the length of its blocks.
    """
    from .interval_stats import covered

    pairs = intersect_pairs(a, b)
    hits = pairs.groupBy("a_id", "b_id").agg(F.sum("overlap").alias("overlap"))
    if not f:
        return hits
    size = a.groupBy(F.col("id").alias("a_id")).agg(F.sum(F.col("end") - F.col("start")).alias("_size"))
    enough = covered(pairs).join(size, "a_id").filter(F.col("covered") >= f * F.col("_size")).select("a_id")
    return hits.join(enough, "a_id", "left_semi")


def window(a: DataFrame, b: DataFrame, left: int = 1000, right: int | None = None, by_strand: bool = False, strand: str | None = None, width: int | None = None) -> DataFrame:
    """Pairs within a window around A; by strand: left is upstream, so it swaps on '-'."""
    right = left if right is None else right
    if by_strand:
        minus = F.col("strand") == "-"
        l_, r_ = F.when(minus, right).otherwise(left), F.when(minus, left).otherwise(right)
    else:
        l_, r_ = F.lit(left), F.lit(right)
    grown = a.withColumns({"own_start": F.col("start"), "own_end": F.col("end")}).withColumns({"start": F.greatest(F.lit(0), F.col("start") - l_), "end": F.col("end") + r_})
    pairs = overlap_pairs(grown, b, width)
    if strand:
        pairs = pairs.filter(strand_predicate("plain", strand, F.col("a_strand"), F.col("b_strand")))
    pairs = pairs.withColumns({"a_start": F.col("a_own_start"), "a_end": F.col("a_own_end")}).drop("a_own_start", "a_own_end")
    return pairs.withColumn("overlap", F.least("a_end", "b_end") - F.greatest("a_start", "b_start"))


def multi_count(a: DataFrame, others: dict[str, DataFrame], **predicates) -> DataFrame:
    """A with one column of hit counts for each named B."""
    out = a
    for name, b in others.items():
        hits = intersect_pairs(a, b, **predicates).groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias(name))
        out = out.join(hits, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def tag(a: DataFrame, b: DataFrame, label: str = "name", **predicates) -> DataFrame:
    """A with the sorted distinct labels of overlapping B, comma-joined; null without a hit."""
    predicates.setdefault("policy", "nonempty")
    labels = intersect_pairs(a, b, **predicates).groupBy(F.col("a_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.col(f"b_{label}").cast("string"))), ",").alias("labels"))
    return a.join(labels, "id", "left")


def pair_to_bed(pairs: DataFrame, b: DataFrame, mode: str = "either", f: float = 1e-9, strand: str | None = None) -> DataFrame:
    """Paired intervals (id, chrom1, start1, end1, strand1, ...2) by which ends overlap B.

    either, both, notboth (one or none), neither, xor (exactly one).
    """
    ends = [pairs.select(F.col("id"), F.lit(k).alias("which"), *[F.col(f"{c}{k}").alias(c) for c in ("chrom", "start", "end", "strand")]) for k in (1, 2)]
    met = overlap_pairs(ends[0].unionByName(ends[1]), b)
    ok = F.col("overlap") >= f * (F.col("a_end") - F.col("a_start"))
    met = met.filter(ok & strand_predicate("lenient", strand, F.col("a_strand"), F.col("b_strand")))
    hits = met.groupBy(F.col("a_id").alias("id")).agg(F.bool_or(F.col("a_which") == 1).alias("hit1"), F.bool_or(F.col("a_which") == 2).alias("hit2"))
    joined = pairs.join(hits, "id", "left")
    one, two = F.coalesce("hit1", F.lit(False)), F.coalesce("hit2", F.lit(False))
    keep = {"either": one | two, "both": one & two, "notboth": ~(one & two), "neither": ~(one | two), "xor": one != two}[mode]
    return joined.filter(keep).select(*pairs.columns)


def pair_to_pair(a: DataFrame, b: DataFrame, mode: str = "both", slop: int = 0, f: float = 1e-9, ignore_strand: bool = False) -> DataFrame:
    """Pairs of paired intervals whose ends meet, straight (1-1, 2-2) or crossed (1-2, 2-1).

    both: rows (a_id, b_id) with both ends met in one of the two ways; either: A with an end
    that meets any end; neither and notboth: A without.  Strands have to agree unless ignored;
    unknown strands agree with all.
    """
    a_ends = [a.select("id", F.lit(k).alias("which"), F.col(f"chrom{k}").alias("chrom"), (F.col(f"start{k}") - slop).alias("start"), (F.col(f"end{k}") + slop).alias("end"), F.col(f"strand{k}").alias("strand"), (F.col(f"end{k}") - F.col(f"start{k}")).alias("len")) for k in (1, 2)]
    b_ends = [b.select("id", F.lit(k).alias("which"), F.col(f"chrom{k}").alias("chrom"), F.col(f"start{k}").alias("start"), F.col(f"end{k}").alias("end"), F.col(f"strand{k}").alias("strand")) for k in (1, 2)]
    met = overlap_pairs(a_ends[0].unionByName(a_ends[1]), b_ends[0].unionByName(b_ends[1]))
    met = met.filter(F.col("overlap") >= f * F.col("a_len"))
    if not ignore_strand:
        met = met.filter(strand_predicate("lenient", "same", F.col("a_strand"), F.col("b_strand")))
    bits = F.when(F.col("a_which") == 1, F.when(F.col("b_which") == 1, 1).otherwise(2)).otherwise(F.when(F.col("b_which") == 1, 4).otherwise(8))
    by = met.groupBy("a_id", "b_id").agg(F.bit_or(bits).alias("bits"))
    both = by.filter((F.col("bits").bitwiseAND(9) == 9) | (F.col("bits").bitwiseAND(6) == 6)).select("a_id", "b_id")
    if mode == "both":
        return both
    if mode == "notboth":
        return a.join(both.select(F.col("a_id").alias("id")).distinct(), "id", "left_anti")
    any_end = by.select(F.col("a_id").alias("id")).distinct()
    return a.join(any_end, "id", "left_semi" if mode == "either" else "left_anti")
