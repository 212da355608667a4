"""Read and sequence operators over frames with id, seq and, where needed, qual (Phred + 33)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import changed_fraction, complement, count_of, dust_score, gc_content, kmers, mean_quality, qualities, reverse_complement


def composition(df: DataFrame) -> DataFrame:
    """For each read: length, A, C, G, T, two-, three- and four-fold codes, CpG, and GC."""
    up = F.upper("seq")
    return df.select(
        "id", F.length("seq").alias("length"), *[count_of(up, b).alias(b.lower()) for b in "ACGT"], count_of(up, "RYSWKM").alias("n2"), count_of(up, "BDHV").alias("n3"), count_of(up, "N").alias("n4"),
        F.regexp_count(up, F.lit("CG")).alias("cpg"), gc_content(F.col("seq")).alias("gc"),
    )


def size(df: DataFrame) -> DataFrame:
    """One row: reads and bases."""
    return df.agg(F.count("*").alias("reads"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))


def per_cycle(df: DataFrame) -> DataFrame:
    """(cycle, bases, a, c, g, t, n, mean_quality, q20, q30) by 1-based position in the read."""
    each = df.select(F.posexplode(F.arrays_zip(F.split(F.upper("seq"), "").alias("b"), qualities(F.col("qual")).alias("q"))).alias("p", "x")).select((F.col("p") + 1).alias("cycle"), "x.b", "x.q").filter("b <> ''")
    is_ = lambda b: F.count_if(F.col("b") == b)
    return each.groupBy("cycle").agg(F.count("*").alias("bases"), *[is_(b).alias(b.lower()) for b in "ACGTN"], F.avg("q").alias("mean_quality"), F.count_if(F.col("q") >= 20).alias("q20"), F.count_if(F.col("q") >= 30).alias("q30"))


def quality_totals(df: DataFrame) -> DataFrame:
    """One row: reads, bases, q20, q30, gc, mean_length."""
    q = qualities(F.col("qual"))
    x = df.select(F.length("seq").alias("n"), F.size(F.filter(q, lambda v: v >= 20)).alias("q20"), F.size(F.filter(q, lambda v: v >= 30)).alias("q30"), count_of(F.upper("seq"), "GC").alias("gc"))
    return x.agg(F.count("*").alias("reads"), F.sum("n").alias("bases"), F.sum("q20").alias("q20"), F.sum("q30").alias("q30"), F.sum("gc").alias("gc"), F.avg("n").alias("mean_length"))


def kmer_counts(df: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """(kmer, n); canonical: a k-mer and its reverse complement count as the smaller of both."""
    each = df.select(F.explode(kmers(F.upper("seq"), k)).alias("kmer"))
    if canonical:
        each = each.select(F.least(F.col("kmer"), reverse_complement(F.col("kmer"))).alias("kmer"))
    return each.groupBy("kmer").agg(F.count("*").alias("n"))


def kmer_neighbours(df: DataFrame, query: str) -> DataFrame:
    """(kmer, n) of a k-mer, its one-base changes, and the reverse complements of all of them."""
    spark, k = df.sparkSession, len(query)
    near = {query} | {query[:i] + b + query[i + 1 :] for i in range(k) for b in "ACGT"}
    near |= {x[::-1].translate(str.maketrans("ACGT", "TGCA")) for x in near}
    wanted = spark.createDataFrame([(x,) for x in sorted(near)], "kmer string")  # 6 k + 2 rows at most
    return wanted.join(kmer_counts(df, k), "kmer", "left").fillna(0, ["n"])


def filter_reason(length: tuple[int, int | None] = (1, None), gc: tuple[float, float] | None = None, max_n: int | None = None, min_quality: float | None = None, max_low: tuple[int, float] | None = None, max_dust: float | None = None, min_changed: float | None = None) -> Column:
    """The first rule that a read fails, in a fixed order, null if it passes.

    length, GC percent, number of N, mean quality, share of bases under a quality, DUST score, share of changing neighbours.
    """
    n = F.length("seq")
    rules = [("length", (n < length[0]) | (n > length[1] if length[1] is not None else F.lit(False)))]
    if gc:
        percent = gc_content(F.col("seq")) * 100
        rules.append(("gc", F.coalesce((percent < gc[0]) | (percent > gc[1]), F.lit(False))))
    if max_n is not None:
        rules.append(("n", count_of(F.col("seq"), "Nn") > max_n))
    if min_quality is not None:
        rules.append(("quality", F.coalesce(mean_quality(F.col("qual")) < min_quality, F.lit(True))))
    if max_low:
        low = F.size(F.filter(qualities(F.col("qual")), lambda q: q < max_low[0]))
        rules.append(("low_bases", low > max_low[1] * n))
    if max_dust is not None:
        rules.append(("dust", F.coalesce(dust_score(F.col("seq")) > max_dust, F.lit(False))))
    if min_changed is not None:
        rules.append(("complexity", F.coalesce(changed_fraction(F.col("seq")) < min_changed, F.lit(False))))
    reason = F.lit(None).cast("string")
    for name, failed in reversed(rules):
        reason = F.when(failed, name).otherwise(reason)
    return reason


def deduplicate(df: DataFrame, reverse: bool = False, keep: int = 1) -> DataFrame:
    """The first ``keep`` reads, by id, of each sequence; with ``reverse`` a sequence and its reverse complement are one."""
    key = F.upper("seq")
    if reverse:
        key = F.least(key, reverse_complement(key))
    x = df.withColumn("_k", F.sha2(key, 256))
    return x.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("id"))).filter(F.col("_r") <= keep).drop("_k", "_r")


def duplication(df: DataFrame) -> DataFrame:
    """(copies, sequences): how many sequences occur so often."""
    return df.groupBy(F.sha2("seq", 256)).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("sequences"))


def assembly_n(df: DataFrame, shares: tuple[int, ...] = (50, 75, 90)) -> DataFrame:
    """(share, length): the length at which reads at least that long hold that percent of the bases.

    Lengths are counted first, so the ordered pass is over distinct lengths.
    """
    by = df.groupBy(F.length("seq").alias("length")).agg(F.sum(F.length("seq")).alias("bases"))
    w = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    x = by.withColumns({"upto": F.sum("bases").over(w), "total": F.sum("bases").over(Window.partitionBy(F.lit(0)))})
    x = x.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).filter(F.col("upto") * 100 >= F.col("share") * F.col("total"))
    return x.groupBy("share").agg(F.max("length").alias("length"))


def runs_of_base(df: DataFrame, pattern: str = "N+", least: int = 1) -> DataFrame:
    """(id, start, end) of maximal runs that a one-letter pattern (such as N+ or (.)\\1+) matches, 0-based half-open."""
    # Runs of equal letters: a boundary before each position whose letter differs from the one before.
    x = df.select("id", F.posexplode(F.split(F.upper("seq"), "")).alias("pos", "b")).filter(F.col("b") != "")
    w = Window.partitionBy("id").orderBy("pos")
    x = x.withColumn("c", (~F.col("b").eqNullSafe(F.lag("b").over(w))).cast("int")).withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = x.groupBy("id", "run", "b").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).filter(F.col("end") - F.col("start") >= least)
    return by.filter(F.repeat("b", (F.col("end") - F.col("start")).cast("int")).rlike(f"^(?:{pattern})$")).select("id", "start", "end", "b")


def subsequences(df: DataFrame, regions: DataFrame) -> DataFrame:
    """(region columns, seq) of regions (chrom, start, end[, strand]) of sequences whose id is the chrom; '-' gives the reverse complement."""
    x = regions.join(df.select(F.col("id").alias("chrom"), F.col("seq").alias("_s")), "chrom")
    part = F.substring("_s", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    if "strand" in regions.columns:
        part = F.when(F.col("strand") == "-", reverse_complement(part)).otherwise(part)
    return x.withColumn("seq", part).drop("_s")


def nucleotides(regions: DataFrame, sequences: DataFrame, pattern: str | None = None) -> DataFrame:
    """Regions with the share of A/T and of G/C, counts of bases, length, and occurrences of a pattern."""
    x = subsequences(sequences, regions)
    up, n = F.upper("seq"), F.nullif(F.length("seq"), F.lit(0))
    out = x.withColumns({"at_share": count_of(up, "AT") / n, "gc_share": count_of(up, "GC") / n, **{f"n_{b.lower()}": count_of(up, b) for b in "ACGTN"}, "length": F.length("seq")})
    return out.withColumn("matches", F.regexp_count(up, F.lit(f"(?=({pattern}))"))) if pattern else out


def merge_sequences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Base-wise union of two sequences of one id: equal bases stay, N yields, others become the two-base code."""
    codes = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}
    x = a.select("id", F.col("seq").alias("x")).join(b.select("id", F.col("seq").alias("y")), "id")

    def one(p: Column, q: Column) -> Column:
        lo, hi = F.least(p, q), F.greatest(p, q)
        out = F.lit("N")
        for pair, code in codes.items():
            out = F.when((lo == pair[0]) & (hi == pair[1]), code).otherwise(out)
        return F.when(p == q, p).when(p == "N", q).when(q == "N", p).otherwise(out)

    return x.select("id", F.array_join(F.zip_with(F.split(F.upper("x"), ""), F.split(F.upper("y"), ""), lambda p, q: F.coalesce(one(p, q), p, q)), "").alias("seq"))


# Trimming: one Arrow-batched pass over reads.


def mott(quals: np.ndarray, error: float = 0.05) -> tuple[int, int]:
    """The stretch with the greatest sum of (error - error probability), as (start, end)."""
    gain = np.concatenate(([0.0], np.cumsum(error - 10.0 ** (-quals / 10.0))))
    low = np.minimum.accumulate(gain)
    end = int(np.argmax(gain - low))
    return int(np.argmin(gain[: end + 1])), end


def sliding(quals: np.ndarray, threshold: float = 20.0, share: float = 0.1) -> tuple[int, int]:
    """Window trimming: the window is ``share`` of the read (one base at least).

    The start is the first good base of the first window whose mean reaches the threshold; the
    end is the first bad base of the first later window whose mean falls below it.
    """
    n = len(quals)
    w = max(1, int(n * share))
    if n == 0:
        return 0, 0
    total = np.concatenate(([0], np.cumsum(quals)))
    means = (total[w:] - total[:-w]) / w
    good = np.flatnonzero(means >= threshold)
    if not len(good):
        return 0, 0
    first = int(good[0])
    start = first + int(np.argmax(quals[first : first + w] >= threshold))
    bad = np.flatnonzero(means[first:] < threshold)
    if not len(bad):
        return start, n
    at = first + int(bad[0])
    return start, max(start, at + int(np.argmax(quals[at : at + w] < threshold)))


def cut_ends(quals: np.ndarray, front: int = 0, tail: int = 0, window: int = 4, mean: float = 20.0) -> tuple[int, int]:
    """Drops windows of low mean quality from the front, then from the tail (0: not)."""
    start, end = 0, len(quals)
    total = np.concatenate(([0], np.cumsum(quals)))
    if front:
        while start + window <= end and total[start + window] - total[start] < mean * window:
            start += 1
    if tail:
        while end - window >= start and total[end] - total[end - window] < mean * window:
            end -= 1
    return start, end


def poly_tail(seq: str, base: str = "G", least: int = 10, one_in: int = 8, most: int = 5) -> int:
    """Length that remains after a tail of one base, allowing one other base in ``one_in`` and ``most`` in all."""
    other, best = 0, len(seq)
    for k in range(len(seq) - 1, -1, -1):
        n = len(seq) - k
        if seq[k] != base:
            other += 1
            if other > most or other > n / one_in and n > least:
                break
        else:
            best = k
    return best if len(seq) - best >= least else len(seq)


def adapter_start(seq: str, adapter: str, least: int = 4, errors: float = 0.125) -> int:
    """Where an adapter begins: the first place from which the read agrees with it but for a share of mismatches; the length if nowhere."""
    n = len(seq)
    for k in range(0, n - least + 1):
        m = min(n - k, len(adapter))
        if sum(a != b for a, b in zip(seq[k : k + m], adapter, strict=False)) <= int(m * errors):
            return k
    return n


def trim(df: DataFrame, method: str = "mott", **options) -> DataFrame:
    """Reads cut by ``method`` (mott, sliding, cut_ends on qualities; poly_tail, adapter on bases), with the kept range (start, end)."""
    on_quality = {"mott": mott, "sliding": sliding, "cut_ends": cut_ends}
    on_bases = {"poly_tail": poly_tail, "adapter": adapter_start}

    @F.pandas_udf("struct<start:int,end:int>")
    def ranges(seq: pd.Series, qual: pd.Series) -> pd.DataFrame:
        out = []
        for s, q in zip(seq, qual, strict=True):
            if s is None:
                out.append((0, 0))
            elif method in on_quality:
                out.append(on_quality[method](np.frombuffer((q or "").encode("latin-1", "replace"), np.uint8).astype(np.int64) - 33, **options))
            else:
                out.append((0, on_bases[method](s, **options)))
        return pd.DataFrame(out, columns=["start", "end"])

    x = df.withColumn("_t", ranges("seq", "qual"))
    n = F.col("_t.end") - F.col("_t.start")
    return x.withColumns({"start": F.col("_t.start"), "end": F.col("_t.end"), "seq": F.substring("seq", F.col("_t.start") + 1, n), "qual": F.substring("qual", F.col("_t.start") + 1, n)}).drop("_t")


def both_mates(df: DataFrame, keep: Column, pair: str = "pair") -> DataFrame:
    """Reads whose pair passes ``keep`` with all its mates."""
    ok = df.groupBy(pair).agg(F.bool_and(keep).alias("_ok")).filter("_ok").select(pair)
    return df.join(ok, pair, "left_semi")


def mate_complement(df: DataFrame) -> DataFrame:
    """Adds the complement and reverse complement of each sequence."""
    return df.withColumns({"complement": complement(F.col("seq")), "reverse_complement": reverse_complement(F.col("seq"))})
