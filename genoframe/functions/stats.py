"""Exact tests and distributions as Arrow-batched UDFs over columns of counts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_table(a: int, b: int, c: int, d: int) -> tuple[float, float, float]:
    """Left, right and two-tailed p of a 2x2 table, by summing hypergeometric terms over the feasible first cells."""
    row, col, n = a + b, a + c, a + b + c + d
    if n == 0:
        return 1.0, 1.0, 1.0
    lo, hi = max(0, row + col - n), min(row, col)
    base = _log_choose(n, row)
    p = [math.exp(_log_choose(col, x) + _log_choose(n - col, row - x) - base) for x in range(lo, hi + 1)]
    own = p[a - lo]
    left, right = math.fsum(p[: a - lo + 1]), math.fsum(p[a - lo :])
    return min(1.0, left), min(1.0, right), min(1.0, math.fsum(x for x in p if x <= own * (1 + 1e-7)))


def hwe_exact(het: int, hom1: int, hom2: int) -> tuple[float, float, float]:
    """Exact Hardy-Weinberg p: two-sided, heterozygote deficit, heterozygote excess.

    Heterozygote counts of the same parity as the rarer allele are weighted by the recurrence
    of their conditional probabilities, starting from the middle.
    """
    n = het + hom1 + hom2
    if n == 0:
        return 1.0, 1.0, 1.0
    rare = 2 * min(hom1, hom2) + het
    # log P(h) up to a constant: multinomial of genotypes times 2^h.
    counts = range(rare % 2, rare + 1, 2)
    logs = [h * math.log(2) - math.lgamma(h + 1) - math.lgamma((rare - h) // 2 + 1) - math.lgamma(n - (rare + h) // 2 + 1) for h in counts]
    top = max(logs)
    weights = [math.exp(x - top) for x in logs]
    total = math.fsum(weights)
    p = [w / total for w in weights]
    k = (het - rare % 2) // 2
    return min(1.0, math.fsum(x for x in p if x <= p[k] * (1 + 1e-9))), min(1.0, math.fsum(p[: k + 1])), min(1.0, math.fsum(p[k:]))


def chi2_sf(x: float, df: int = 1) -> float:
    """Upper tail of the chi-square distribution, by the regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    if df == 1:
        return math.erfc(math.sqrt(x / 2))
    a, z = df / 2, x / 2
    term = math.exp(-z + a * math.log(z) - math.lgamma(a + 1))
    total, k = term, 0
    while term > total * 1e-16 and k < 10_000:
        k += 1
        term *= z / (a + k)
        total += term
    return max(0.0, 1 - total)


def binomial_two_sided(k: int, n: int, p: float = 0.5) -> float:
    """Two-sided exact binomial p: the outcomes no likelier than the observed."""
    logs = [_log_choose(n, x) + (x * math.log(p) if x else 0) + ((n - x) * math.log1p(-p) if n - x else 0) for x in range(n + 1)]
    own = logs[k]
    return min(1.0, math.fsum(math.exp(x) for x in logs if x <= own + 1e-7))


def _struct(fn, fields: tuple[str, ...]):
    schema = "struct<" + ",".join(f"{f}:double" for f in fields) + ">"

    @F.pandas_udf(schema)
    def run(*columns: pd.Series) -> pd.DataFrame:
        rows = [fn(*map(int, r)) if all(x == x and x is not None for x in r) else (None,) * len(fields) for r in zip(*columns, strict=True)]
        return pd.DataFrame(rows, columns=list(fields), dtype="float64")

    return run


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Struct (left, right, two) of a 2x2 table of counts."""
    return _struct(fisher_table, ("left", "right", "two"))(a, b, c, d)


def hardy_weinberg(het: Column, hom1: Column, hom2: Column) -> Column:
    """Struct (p, p_deficit, p_excess) of genotype counts."""
    return _struct(hwe_exact, ("p", "p_deficit", "p_excess"))(het, hom1, hom2)


def chi_square_p(x: Column, df: int = 1) -> Column:
    """Upper tail p of a chi-square statistic."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v != v else chi2_sf(v, df))

    return run(x)


def binomial_p(k: Column, n: Column, p: float = 0.5) -> Column:
    """Two-sided exact binomial p of k successes in n."""

    @F.pandas_udf("double")
    def run(ks: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else binomial_two_sided(int(a), int(b), p) for a, b in zip(ks, ns, strict=True)], dtype="float64")

    return run(k, n)
