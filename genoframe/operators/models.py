"""Model-based operators: hidden Markov models along a chromosome, one group of (sample, chromosome) at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def viterbi(start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Likeliest states from log start (states), log transitions (n - 1, from, to) and log emissions (n, states)."""
    n, k = emit.shape
    back, score = np.zeros((n, k), np.int64), start + emit[0]
    for t in range(1, n):
        through = score[:, None] + step[t - 1]
        back[t] = through.argmax(axis=0)
        score = through.max(axis=0) + emit[t]
    path = np.empty(n, np.int64)
    path[-1] = int(score.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def posterior(start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """State probabilities (n, states) by the forward-backward recursion in scaled numbers."""
    n, k = emit.shape
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    p = np.exp(step)
    f, b = np.empty((n, k)), np.ones((n, k))
    f[0] = np.exp(start) * e[0]
    f[0] /= f[0].sum()
    for t in range(1, n):
        f[t] = (f[t - 1] @ p[t - 1]) * e[t]
        f[t] /= f[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = p[t] @ (e[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    out = f * b
    return out / out.sum(axis=1, keepdims=True)


def fit_transitions(start: np.ndarray, rate: np.ndarray, gaps: np.ndarray, emit: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Rates of leaving each of two states per base, re-estimated from expected switches (Baum-Welch style) until they settle."""
    for _ in range(rounds):
        step = two_state_steps(rate, gaps)
        post = posterior(start, step, emit)
        p = np.exp(step)
        e = np.exp(emit - emit.max(axis=1, keepdims=True))
        joint = post[:-1, :, None] * p * (e[1:] * 1.0)[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        stay = np.maximum(1.0, (post[:-1] * gaps[:, None]).sum(axis=0))
        fresh = np.clip(np.array([joint[:, 0, 1].sum(), joint[:, 1, 0].sum()]) / stay, 1e-12, 0.5)
        if np.allclose(fresh, rate, rtol=1e-3):
            return fresh
        rate = fresh
    return rate


def two_state_steps(rate: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Log transitions over gaps of two states that are left at the given rates per base."""
    total = rate.sum()
    moved = 1 - np.exp(-total * gaps)
    to = rate / total  # share of time that ends in the other state
    p = np.empty((len(gaps), 2, 2))
    p[:, 0, 1], p[:, 1, 0] = to[0] * moved, to[1] * moved
    p[:, 0, 0], p[:, 1, 1] = 1 - p[:, 0, 1], 1 - p[:, 1, 0]
    return np.log(np.maximum(p, 1e-300))


def runs_of_homozygosity(gt: DataFrame, enter: float = 6.7e-8, leave: float = 5e-9, error: float = 1e-3, train: bool = False) -> DataFrame:
    """(sample, chrom, start, end, sites, quality): autozygous runs of each sample, by a two-state model.

    Genotypes in long form (chrom, pos, sample, a1, a2).  Outside a run genotypes follow
    Hardy-Weinberg proportions of the site's ALT frequency; inside, heterozygotes are errors.
    Rates are per base; ``quality`` is the mean Phred-scaled posterior of the run.
    """
    from .popgen import SITE, site_counts

    c = site_counts(gt).filter("alt > 0 and alt < n").select(*SITE, (F.col("alt") / F.col("n")).alias("af"))
    x = gt.filter("a1 is not null and a2 is not null").join(c, SITE).select("sample", *SITE, "af", (F.col("a1") + F.col("a2")).cast("int").alias("g"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        p, g, pos = pdf["af"].to_numpy(), pdf["g"].to_numpy(), pdf["pos"].to_numpy()
        outside = np.select([g == 0, g == 1], [(1 - p) ** 2, 2 * p * (1 - p)], p**2)
        inside = np.select([g == 0, g == 1], [(1 - p) * (1 - error), error], p * (1 - error))
        emit = np.log(np.maximum(np.stack((outside, inside), axis=1), 1e-300))
        gaps, rate, start = np.diff(pos).astype(float), np.array([enter, leave]), np.log([0.5, 0.5])
        if train and len(gaps):
            rate = fit_transitions(start, rate, gaps, emit)
        step = two_state_steps(rate, gaps)
        state, post = viterbi(start, step, emit), posterior(start, step, emit)[:, 1]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], state, [0]))))
        rows = [(int(pos[a]), int(pos[b - 1]), int(b - a), float(np.mean(-10 * np.log10(np.maximum(1e-10, 1 - post[a:b]))))) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        out = pd.DataFrame(rows, columns=["start", "end", "sites", "quality"])
        out.insert(0, "sample", pdf["sample"].iloc[0])
        out.insert(1, "chrom", pdf["chrom"].iloc[0])
        return out

    kind = gt.schema["sample"].dataType.simpleString()
    return x.groupBy("sample", "chrom").applyInPandas(run, f"sample {kind}, chrom string, start long, end long, sites long, quality double")


def copy_number(df: DataFrame, spread: float = 0.2, change: float = 1e-6) -> DataFrame:
    """(sample, chrom, start, end, copies, sites) from log R ratios (sample, chrom, pos, lrr) by a four-state model (0 to 3 copies)."""
    means = np.array([-2.0, -0.45, 0.0, 0.3])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, r = pdf["pos"].to_numpy(), pdf["lrr"].to_numpy()
        emit = -0.5 * ((r[:, None] - means) / spread) ** 2
        moved = np.clip(1 - np.exp(-change * np.diff(pos).astype(float)), 1e-12, 0.75)
        step = np.log(np.where(np.eye(4, dtype=bool)[None], (1 - moved)[:, None, None], (moved / 3)[:, None, None]))
        state = viterbi(np.log([0.05, 0.05, 0.85, 0.05]), step, emit)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(state)) + 1, [len(state)]))
        rows = [(pdf["sample"].iloc[0], pdf["chrom"].iloc[0], int(pos[a]), int(pos[b - 1]), int(state[a]), int(b - a)) for a, b in zip(cut, cut[1:], strict=False)]
        return pd.DataFrame(rows, columns=["sample", "chrom", "start", "end", "copies", "sites"])

    kind = df.schema["sample"].dataType.simpleString()
    return df.groupBy("sample", "chrom").applyInPandas(run, f"sample {kind}, chrom string, start long, end long, copies int, sites long")


def self_organising_map(df: DataFrame, columns: list[str], side: int = 4, epochs: int = 5, sample: int = 5000, seed: int = 1) -> DataFrame:
    """Adds ``unit`` and ``distance``: the nearest unit of a square map trained on at most ``sample`` rows of least hash; rows with nulls get none."""
    whole = df.na.drop(subset=columns)
    rows = whole.orderBy(F.xxhash64(*columns, F.lit(seed))).limit(sample).select(*[F.col(c).cast("double") for c in columns]).collect()
    if not rows:
        return df.withColumns({"unit": F.lit(None).cast("int"), "distance": F.lit(None).cast("double")})
    data = np.array(rows, float)
    mean, sd = data.mean(axis=0), np.maximum(data.std(axis=0), 1e-9)
    z, rng = (data - mean) / sd, np.random.default_rng(seed)
    units, place = rng.standard_normal((side * side, len(columns))), np.stack(np.divmod(np.arange(side * side), side), axis=1)
    total = epochs * len(z)
    for t, k in enumerate(np.concatenate([rng.permutation(len(z)) for _ in range(epochs)])):
        left = 1 - t / total
        best = ((units - z[k]) ** 2).sum(axis=1).argmin()
        near = np.exp(-((place - place[best]) ** 2).sum(axis=1) / (2 * max(0.5, side / 2 * left) ** 2))
        units += 0.3 * left * near[:, None] * (z[k] - units)

    @F.pandas_udf("struct<unit:int,distance:double>")
    def classify(*values: pd.Series) -> pd.DataFrame:
        x = (np.stack([v.to_numpy(float) for v in values], axis=1) - mean) / sd
        d = ((x[:, None, :] - units) ** 2).sum(axis=2)
        ok = np.isfinite(d).all(axis=1)
        unit = pd.array(np.where(ok, np.where(ok[:, None], d, 0).argmin(axis=1), 0), dtype="Int32")
        unit[~ok] = pd.NA
        return pd.DataFrame({"unit": unit, "distance": np.where(ok, np.sqrt(np.where(ok[:, None], d, 0).min(axis=1)), np.nan)})

    return df.withColumn("_s", classify(*[F.col(c).cast("double") for c in columns])).withColumns({"unit": F.col("_s.unit"), "distance": F.col("_s.distance")}).drop("_s")
