"""Paired reads: overlap analysis, correction and merging, adapter trimming by overlap, UMIs, pairing, and the fixed-order read pipeline."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reads import adapter_start, cut_ends, poly_tail

_FLIP = str.maketrans("ACGTNacgtn", "TGCANtgcan")


def overlap_of(r1: str, r2: str, least: int = 30, most: int = 5, share: float = 0.2) -> tuple[int, int, int] | None:
    """(offset, length, mismatches) of read 1 and the reverse complement of read 2.

    Offsets from 0 up (read 2 begins inside read 1), then below 0 (the insert is shorter than the
    reads); the first within the limits of mismatches.
    """
    b = r2.translate(_FLIP)[::-1]
    for offset in [*range(0, len(r1) - least + 1), *range(-1, -(len(b) - least) - 1, -1)]:
        x, y = (r1[offset:], b) if offset >= 0 else (r1, b[-offset:])
        n = min(len(x), len(y))
        if n < least:
            continue
        wrong = sum(p != q for p, q in zip(x[:n], y[:n], strict=True))
        if wrong <= min(most, int(n * share)):
            return offset, n, wrong
    return None


def corrected(r1: str, q1: str, r2: str, q2: str, good: int = 30, bad: int = 15) -> tuple[str, str, str, str, int]:
    """Mismatches of the overlap where one base is good and the other bad take the good one, with its quality."""
    found = overlap_of(r1, r2)
    if not found or not found[2]:
        return r1, q1, r2, q2, 0
    offset, n, _ = found
    a, qa, b, qb, fixed = list(r1), list(q1), list(r2), list(q2), 0
    for k in range(n):
        i = k + max(0, offset)
        j = len(r2) - 1 - (k + max(0, -offset))
        other = b[j].translate(_FLIP)
        if a[i] != other:
            x, y = ord(qa[i]) - 33, ord(qb[j]) - 33
            if x >= good and y <= bad:
                b[j], qb[j], fixed = a[i].translate(_FLIP), qa[i], fixed + 1
            elif y >= good and x <= bad:
                a[i], qa[i], fixed = other, qb[j], fixed + 1
    return "".join(a), "".join(qa), "".join(b), "".join(qb), fixed


def pair_overlaps(df: DataFrame) -> DataFrame:
    """Adds offset, overlap and mismatches to pairs (id, seq1, qual1, seq2, qual2); null without an overlap."""

    @F.pandas_udf("struct<offset:int,overlap:int,mismatches:int>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [overlap_of(x, y) or (None, None, None) if x is not None and y is not None else (None, None, None) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=["offset", "overlap", "mismatches"]).astype("Int32")

    return df.withColumn("_o", run("seq1", "seq2")).select("*", "_o.*").drop("_o")


def correct_pairs(df: DataFrame) -> DataFrame:
    """Pairs with the bases of their overlaps corrected, and ``fixed``, how many were."""

    @F.pandas_udf("struct<seq1:string,qual1:string,seq2:string,qual2:string,fixed:int>")
    def run(a: pd.Series, qa: pd.Series, b: pd.Series, qb: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([corrected(*r) for r in zip(a, qa, b, qb, strict=True)], columns=["seq1", "qual1", "seq2", "qual2", "fixed"])

    x = df.withColumn("_c", run("seq1", "qual1", "seq2", "qual2"))
    return x.withColumns({c: F.col(f"_c.{c}") for c in ("seq1", "qual1", "seq2", "qual2", "fixed")}).drop("_c")


def merge_pairs(df: DataFrame) -> DataFrame:
    """Overlapping pairs as one read (id, seq, qual): read 1, then what read 2 has beyond it."""

    @F.pandas_udf("struct<seq:string,qual:string>")
    def run(a: pd.Series, qa: pd.Series, b: pd.Series, qb: pd.Series) -> pd.DataFrame:
        out = []
        for x, q, y, r in zip(a, qa, b, qb, strict=True):
            found = overlap_of(x, y)
            if not found:
                out.append((None, None))
                continue
            offset, n, _ = found
            rest, rq = y.translate(_FLIP)[::-1], r[::-1]
            out.append((x[: offset + n] + rest[n:], q[: offset + n] + rq[n:]) if offset >= 0 else (x[:n], q[:n]))
        return pd.DataFrame(out, columns=["seq", "qual"])

    return df.withColumn("_m", run("seq1", "qual1", "seq2", "qual2")).select("id", "_m.seq", "_m.qual").filter("seq is not null")


def interleave(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mates of two frames by id: pairs (id, seq1, qual1, seq2, qual2)."""
    one = lambda df, k: df.select("id", F.col("seq").alias(f"seq{k}"), F.col("qual").alias(f"qual{k}"))
    return one(a, 1).join(one(b, 2), "id")


def drop_unpaired(df: DataFrame, order: str = "n") -> DataFrame:
    """Rows of an interleaved stream whose name equals a neighbour's, mates being taken in twos from the front of each run of a name."""
    name = F.regexp_replace("id", r"/[12]$", "")
    w = Window.partitionBy("_name").orderBy(order)
    x = df.withColumn("_name", name).withColumn("_k", F.row_number().over(w))
    n = F.count("*").over(Window.partitionBy("_name"))
    return x.withColumn("_n", n).filter((F.col("_k") <= F.col("_n") - F.col("_n") % 2)).drop("_name", "_k", "_n")


def extract_umi(df: DataFrame, length: int, skip: int = 0, prefix: str = "") -> DataFrame:
    """The first ``length`` bases go to the name, with ``skip`` more cut."""
    umi = F.substring("seq", 1, length)
    tag = F.concat(F.lit(f":{prefix}_" if prefix else ":"), umi)
    rest = lambda c: F.substring(c, length + skip + 1, 1 << 30)
    return df.withColumns({"id": F.concat("id", tag), "seq": rest("seq"), "qual": rest("qual")})


def read_pipeline(df: DataFrame, cut_front: bool = False, cut_tail: bool = False, poly_g: bool = True, adapter: str | None = None, poly_x: bool = False, quality: int = 15, low_share: float = 0.4, max_n: int = 5, length: int = 15, complexity: float | None = None) -> DataFrame:
    """Reads (id, seq, qual) through the fixed order: windows cut, poly-G tail, adapter, poly-X tail, then filters.

    Adds ``reason``: the first filter that fails (length, low_quality, n, complexity), else null.
    """

    @F.pandas_udf("struct<seq:string,qual:string>")
    def run(seq: pd.Series, qual: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for s, q in zip(seq, qual, strict=True):
            s, q = s or "", q or ""
            if cut_front or cut_tail:
                a, b = cut_ends(np.frombuffer(q.encode("latin-1", "replace"), np.uint8).astype(np.int64) - 33, int(cut_front), int(cut_tail))
                s, q = s[a:b], q[a:b]
            ends = [lambda x: poly_tail(x)] if poly_g else []
            ends += [lambda x: adapter_start(x, adapter)] if adapter else []
            ends += [lambda x: min(poly_tail(x, base) for base in "ACT")] if poly_x else []
            for f in ends:
                k = f(s)
                s, q = s[:k], q[:k]
            out.append((s, q))
        return pd.DataFrame(out, columns=["seq", "qual"])

    x = df.withColumn("_p", run("seq", "qual")).withColumns({"seq": F.col("_p.seq"), "qual": F.col("_p.qual")}).drop("_p")
    return x.withColumn("reason", _failed(quality, low_share, max_n, length, complexity))


def _failed(quality: int, low_share: float, max_n: int, length: int, complexity: float | None) -> Column:
    from ..functions.sequence import changed_fraction, count_of, qualities

    n = F.length("seq")
    low = F.size(F.filter(qualities(F.col("qual")), lambda q: q < quality))
    out = F.when(n < length, "length").when(low > low_share * n, "low_quality").when(count_of(F.col("seq"), "Nn") > max_n, "n")
    return out.when(changed_fraction(F.col("seq")) < complexity, "complexity") if complexity is not None else out
