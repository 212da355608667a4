"""Sequence and quality functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements.
IUPAC = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
COMPLEMENT = "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"
_KEYS, _VALUES = IUPAC, COMPLEMENT


def complement(seq: Column) -> Column:
    return F.translate(seq, _KEYS, _VALUES)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of ``seq`` are among ``letters``."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_content(seq: Column) -> Column:
    """G and C over A, C, G and T; null without any."""
    gc, all_ = count_of(seq, "GCgc"), count_of(seq, "ACGTacgt")
    return F.when(all_ > 0, gc / all_)


def homopolymer_compressed(seq: Column) -> Column:
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def to_rna(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def qualities(qual: Column, offset: int = 33) -> Column:
    """Array of base qualities."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - offset)


def mean_quality(qual: Column, offset: int = 33) -> Column:
    return F.aggregate(qualities(qual, offset), F.lit(0), lambda a, x: a + x) / F.nullif(F.length(qual), F.lit(0))


def kmers(seq: Column, k: int) -> Column:
    """Array of the k-mers in order; shorter sequences have none.  A look-ahead takes them in one linear pass."""
    return F.regexp_extract_all(F.coalesce(seq, F.lit("")), F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def dust_score(seq: Column) -> Column:
    """Low-complexity score: sum of n (n - 1) / 2 over trimers, by (length - 2), times 10; null under 3 bases."""
    counts = lambda s: F.aggregate(s, F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("sum")), _run)["sum"]
    trimers = F.array_sort(kmers(seq, 3))
    return F.when(F.length(seq) >= 3, counts(trimers) * 10.0 / (F.length(seq) - 2))


def _run(s: Column, x: Column) -> Column:
    same = x == s["last"]
    run = F.when(same, s["run"] + 1).otherwise(1)
    return F.struct(x.alias("last"), run.alias("run"), (s["sum"] + run - 1).cast("long").alias("sum"))


def entropy_score(seq: Column) -> Column:
    """Shannon entropy of the trimers in percent of the most that the length allows for 64 of them."""
    n = (F.length(seq) - 2).cast("double")
    weigh = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        same = x == s["last"]
        return F.struct(x.alias("last"), F.when(same, s["run"] + 1).otherwise(1.0).alias("run"), F.when(same, s["sum"]).otherwise(s["sum"] + weigh(s["run"])).alias("sum"))

    total = F.aggregate(F.array_sort(kmers(seq, 3)), start, step, lambda s: s["sum"] + weigh(s["run"]))
    return F.when(n > 1, (F.log2(n) - total / n) * 100.0 / F.log2(F.least(n, F.lit(64.0)))).when(n == 1, 0.0)


def changed_fraction(seq: Column) -> Column:
    """Share of bases that differ from the next one."""
    same = F.length(seq) - F.length(homopolymer_compressed(seq))
    return F.when(F.length(seq) > 1, (F.length(seq) - 1 - same) / (F.length(seq) - 1))


def ucsc_bin(start: Column, end: Column) -> Column:
    """Smallest bin of the five-level scheme (128 kb to 512 Mb) that holds an interval."""
    out = F.lit(0)
    for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585)):
        out = F.when(F.shiftright(start, shift) == F.shiftright(end - 1, shift), F.shiftright(start, shift) + offset).otherwise(out)
    return out
