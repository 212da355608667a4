"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

Voters are a lexicon, style patterns, and words and word beginnings mined from a bounded sample of
labelled documents.  The label model estimates each voter's accuracy and the correlations between
voters by expectation maximisation; a logistic classifier on words and word beginnings is trained
on the posterior labels and scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batches, written

#: Labelled documents that are fitted to at most, taken in hash order; all if there are fewer.
SAMPLE = 10_000
#: Mined voters and classifier features at most.
VOTERS, FEATURES = 160, 4096
#: Chi-square that a feature needs; far beyond what chance gives among a million features.
LEAST_CHI = 30.0
#: Beginnings of words that are features, in characters.
STEMS = (3, 4, 5, 6)

#: English words of insult.
LEXICON = tuple("idiot idiots moron morons stupid loser losers scum trash garbage pathetic worthless disgusting clown clowns dumb fool jerk ugly vile filth filthy creep pig scumbag bastard".split())

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Words (marked '=') and word beginnings of a whole text, in lower case; null has none."""
    out = set()
    for w in set(_WORD.findall((text or "").lower())):
        out.add("=" + w)
        for k in STEMS:
            if len(w) < k:
                break
            out.add(w[:k])
    return out


def style_votes(text: str | None) -> tuple[bool, ...]:
    """Pattern voters on a whole text: shouting, many exclamation marks, a lexicon word, two of them."""
    text = text or ""
    capitals, letters = sum(map(str.isupper, text)), sum(map(str.isalpha, text))
    n = sum(w in _LEXICON for w in set(_WORD.findall(text.lower())))
    return (letters > 20 and capitals > 0.5 * letters, text.count("!") > 3, n > 0, n > 1)


_LEXICON = frozenset(LEXICON)


@dataclass
class LabelModel:
    """Rates at which voters fire on label 1 and 0, the weight that correlation leaves each, and the prior."""

    fire1: np.ndarray
    fire0: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Posterior of label 1.  Only votes are evidence: a voter of one language says nothing about texts in another."""
        z = np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * np.log(self.fire1 / self.fire0))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: np.ndarray, start: np.ndarray, anchors: int = 2, most_wrong: float = 0.2, rounds: int = 15) -> LabelModel:
    """Expectation maximisation over votes (n, voters; 1 fires, 0 abstains) from starting posteriors.

    Correlations are those of the votes' residuals given the label; a voter's evidence is
    divided by one plus the sum of its correlations with the others, so that a group that always
    fires together counts about once.  The last ``anchors`` voters are an annotator's yes and no:
    they are wrong at most so often, keep their whole weight, and their balance is the prior, so
    that the posteriors cannot drift away from what labels there are.
    """
    prior = float(np.clip(start.mean(), 1e-3, 1 - 1e-3))
    v, q = votes.astype(np.float64), np.clip(start.astype(np.float64), 0.02, 0.98)
    model = None
    for _ in range(rounds):
        w1, w0 = q.sum() + 1e-9, (1 - q).sum() + 1e-9
        fire1, fire0 = (v.T @ q + 0.5) / (w1 + 1), (v.T @ (1 - q) + 0.1) / (w0 + 1)
        if anchors:
            fire1[-2], fire0[-2] = max(fire1[-2], 1 - most_wrong), min(fire0[-2], most_wrong)
            fire1[-1], fire0[-1] = min(fire1[-1], most_wrong), max(fire0[-1], 1 - most_wrong)
        residual = v - np.outer(q, fire1) - np.outer(1 - q, fire0)
        cov = residual.T @ residual / max(1, len(v))
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(corr, 0)
        corr[corr < 0.1] = 0
        if anchors:
            corr[-anchors:] = corr[:, -anchors:] = 0
        model = LabelModel(np.clip(fire1, 1e-4, 1 - 1e-4), np.clip(fire0, 1e-4, 1 - 1e-4), 1 / (1 + corr.sum(axis=1)), corr, prior)
        q = model.posterior(v)
    return model


def logistic(rows: list[np.ndarray], n: int, target: np.ndarray, steps: int = 600, rate: float = 0.05, ridge: float = 1e-6, keep: float = 0.5, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias over binary features (row lists of indices), by Adam on soft targets.

    Weights are kept at 0 or above: features are evidence of label 1, and no habit of a writer
    or of a kind of page can outweigh it.  Each step sees a random share ``keep`` of the features,
    so that one of them has to be enough.
    """
    sizes = np.array([len(r) for r in rows])
    at = np.concatenate(rows) if sizes.sum() else np.empty(0, np.int64)
    of = np.repeat(np.arange(len(rows)), sizes)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    rng = np.random.default_rng(seed)
    mean = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    w[n] = np.log(mean / (1 - mean))
    for t in range(1, steps + 1):
        some = rng.random(len(at)) < keep
        i, r = at[some], of[some]
        z = np.bincount(r, w[i], len(rows)) + w[n]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        g = np.append(np.bincount(i, error[r], n) + ridge * w[:n], error.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        np.maximum(w[:n], 0, out=w[:n])
    return w[:n], float(w[n])


def calibrated(z: np.ndarray, target: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and bias of the summed weights that fit the soft targets best, by Newton steps on whole texts."""
    x = np.stack((z, np.ones(len(z))), axis=1)
    top = max(1e-9, z.max(initial=0.0))
    x[:, 0] /= top
    b = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b += np.clip(np.linalg.solve(h, x.T @ (target - p) - 1e-3 * b), -2, 2)
    return max(0.0, float(b[0])) / top, float(b[1])


@dataclass
class Classifier:
    """Weights of words and word beginnings, and the bias."""

    weights: dict[str, float]
    bias: float

    def word(self, w: str) -> tuple[str, ...]:
        """The weighted features of a word."""
        return tuple(f for f in ("=" + w, *[w[:k] for k in STEMS if len(w) >= k]) if f in self.weights)

    def score(self, text: str | None, cache: dict[str, tuple[str, ...]]) -> float:
        found: set[str] = set()
        for w in set(_WORD.findall((text or "").lower())):
            got = cache.get(w)
            if got is None:
                got = self.word(w)
                if len(cache) < 200_000:
                    cache[w] = got
            if got:
                found.update(got)
        z = self.bias + sum(sorted(self.weights[f] for f in found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: list[np.ndarray], names: list[str], style: np.ndarray, labels: np.ndarray) -> tuple[Classifier, LabelModel | None]:
    """Classifier and label model from labelled documents: the numbers of their features, whose names are given, and their style votes."""
    if not len(labels) or labels.min() == labels.max():  # nothing to learn from: the lexicon alone
        return Classifier({"=" + w: 4.0 for w in LEXICON}, -3.0), None
    sizes = np.array(list(map(len, docs)))
    at = np.concatenate(docs)
    a = np.bincount(at, np.repeat(labels, sizes), len(names))
    b = np.bincount(at, minlength=len(names)) - a
    n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
    chi = np.where(a + b >= 5, (a * n0 - b * n1) ** 2 / np.maximum(1, (a + b) * (n1 + n0 - a - b)), -1)
    order = [k for k in np.argsort(-chi, kind="stable").tolist() if chi[k] >= 0]
    lift = (a + 0.5) / (n1 + 1) > 8 * (b + 0.5) / (n0 + 1)
    mined = [k for k in order if lift[k]][:VOTERS]

    def picked(chosen: list[int]) -> list[np.ndarray]:
        to = np.full(len(names), -1)
        to[chosen] = np.arange(len(chosen))
        return [np.sort(x[x >= 0]) for x in (to[f] for f in docs)]

    votes = np.zeros((len(docs), len(mined)))
    for r, f in enumerate(picked(mined)):
        votes[r, f] = 1
    annotated = labels.astype(np.float64)[:, None]
    quiet = (votes.sum(axis=1, keepdims=True) + style[:, 2:3] == 0).astype(np.float64)
    votes = np.concatenate((votes, style, quiet, annotated, 1 - annotated), axis=1)
    model = label_model(votes, labels)
    chosen = [k for k in order if chi[k] >= LEAST_CHI and lift[k]][:FEATURES]
    rows = picked(chosen)
    w, bias = logistic(rows, len(chosen), model.posterior(votes))
    scale, shift = calibrated(np.array([w[r].sum() for r in rows]), model.posterior(votes))
    w, bias = w * scale, shift
    return Classifier({names[k]: float(w[j]) for j, k in enumerate(chosen) if abs(w[j]) > 1e-3}, bias), model


def held_out(id_col: Column, mod: int = 5) -> Column:
    """Whether labels of the document are set aside; a null id is."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> tuple[Classifier, LabelModel | None]:
    """Fits to at most ``sample`` labelled documents that are not held out, in hash order of their ids."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    count = known.count()
    if count > sample:  # the ids with the least hashes; a little under the bound, as hashes are even
        share = sample * 0.98 / count
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    known = written(known, "labels").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("id") == F.col("_id")).select("id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), pa.array(["\n".join(sorted(features(t))) for t in texts], pa.string()), pa.array([[*map(int, style_votes(t))] for t in texts], pa.list_(pa.int32()))],
                ["id", "label", "features", "style"],
            )

    schema = rows.select("id", "label", F.col("text").alias("features"), F.array(F.lit(0)).alias("style")).schema
    found = written(rows.mapInArrow(run, schema), "sample")
    number: dict[str, int] = {}
    got = []
    for r in found.toLocalIterator():
        ids = np.array([number.setdefault(x, len(number)) for x in r["features"].split("\n") if x], np.int32)
        got.append((r["id"], ids, r["style"], r["label"]))
    style = np.array([s for _, _, s, _ in got], np.float64).reshape(len(got), len(style_votes(None)))
    return fit([f for _, f, _, _ in got], list(number), style, np.array([y for *_, y in got], np.int64))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Only texts are inputs of a score.  Null and empty texts have the score of the bias.  Where no
    label of both kinds is known, the lexicon alone decides.  Repeated rows get a row each.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    classifier, _ = train(docs, labels, id_col, text_col, label_col, sample)
    shared = spark.sparkContext.broadcast(classifier)
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    schema = rows.select("id", "held_out", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[str, ...]] = {}
        for b in batches:
            scores = [shared.value.score(t.as_py(), cache) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(scores, pa.float64())], ["id", "held_out", "score"])

    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
