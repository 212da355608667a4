"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

Texts are sequences of white-space separated words with A-Z lower-cased, then one end token.
Each word is cut into subwords of a public tokenizer.  A position attends to the ``window`` places
up to and with itself: queries and keys are embeddings of the subwords, with a bias for each
distance, masked beyond the text's start.  What a place at distance k hands over is the
distribution of the subword that follows it k places on, and one more entry, a sink, hands over
what follows the beginning of the present word; both come from counts over all training documents.
The probability of the next subword is the attention-weighted mean of its probabilities there, so
that no sum over the vocabulary is needed and every token of the corpus can be trained on.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER, UPPER, arrow_batches, forget, text_key, written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Words with the highest counts that go to all executors as a table; rarer words are joined.
TABLE_WORDS = 400_000
#: Beginnings of words with the highest counts whose continuations the model knows.
NODES = 1_000_000
#: Words, distinct in each batch, and bytes of them that a worker holds before it adds them up and passes them on.
HELD_WORDS, HELD_BYTES = 1_500_000, 1 << 25
#: Words of the tables of words that go to a worker at once.
WORD_ROWS = 20_000
#: Words of a text that are read at once; longer texts are read in spans that overlap by a window.
SPAN = 50_000
#: Tokens for each trainer at least, where there are so many.
TRAINER_TOKENS = 4_000_000

_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


@dataclass(frozen=True)
class Shape:
    """Sizes of the model: places attended to, width of queries and keys, embedded subwords, single-subword columns, shared columns, distances that are counted for the far places, tokens of a training step."""

    window: int = 16
    width: int = 16
    embedded: int = 256
    single: int = 960
    shared: int = 64
    far: tuple[int, ...] = (4, 6)
    block: int = 8192

    @property
    def columns(self) -> int:
        return self.single + self.shared


@lru_cache(2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # Words come one by one: letters, digits and other characters are pieces of their own.
    pattern = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def subwords(word: bytes, path: str) -> tuple[int, ...]:
    """Subword ids of a word; words over 200 bytes are cut into pieces of 100 characters first."""
    encoder, _ = _encoder(path)
    text = word.decode("utf-8", "replace")
    if len(word) <= 200:
        return tuple(encoder.encode_ordinary(" " + text))
    return tuple(i for k in range(0, len(text), 100) for i in encoder.encode_ordinary((" " if k == 0 else "") + text[k : k + 100]))


@lru_cache(2)
def _begins_word(path: str) -> np.ndarray:
    """Which ids begin with a space, as only the first subword of a word does."""
    encoder, n = _encoder(path)
    out = np.zeros(n, bool)
    for token, i in encoder._mergeable_ranks.items():
        out[i] = token[:1] == b" "
    return out


def subwords_of(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of many words end to end, and their number for each word: what :func:`subwords` gives for each.

    Plain words are encoded in one call, as their first subwords alone begin with a space; words
    that are long or hold white space beyond ASCII go one by one.
    """
    texts = [w.decode("utf-8", "replace") for w in words]
    joined = " ".join(texts)
    if words and max(map(len, words)) <= 200 and b"" not in words and len(joined.split()) == len(words):
        flat = np.array(_encoder(path)[0].encode_ordinary(" " + joined), np.int64)
        first = np.flatnonzero(_begins_word(path)[flat])
        if len(first) == len(words):
            return flat, np.diff(np.append(first, len(flat)))
    plain = np.array([len(w) <= 200 and t.split() == [t] for w, t in zip(words, texts, strict=True)], bool)
    if not plain.any() or plain.all():
        each = [subwords(w, path) for w in words]
        return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)
    sizes = np.empty(len(words), np.int64)
    parts = [(own, *subwords_of([words[k] for k in np.flatnonzero(own)], path)) for own in (plain, ~plain)]
    for own, _, each in parts:
        sizes[own] = each
    flat = np.empty(int(sizes.sum()), np.int64)
    for own, ids, _ in parts:
        flat[np.repeat(own, sizes)] = ids
    return flat, sizes


def subwords_by_text(texts: list[list[bytes]], path: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """:func:`subwords_of` for the words of each text."""
    flat, sizes = subwords_of([w for words in texts for w in words], path)
    stops = np.cumsum([0, *map(len, texts)])
    edges = np.append(0, np.cumsum(sizes))[stops].tolist()
    return [(flat[i:j], sizes[k:n]) for i, j, k, n in zip(edges, edges[1:], stops.tolist(), stops[1:].tolist(), strict=False)]


_FACTOR = 0x2545F4914F6CDD1D
#: Bytes beyond which a word is hashed by itself: sums in 64 bits agree for some regular words of 1,024 bytes, whatever the factor.
LONG = 256
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, factor in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            each = np.full(max(n, 1 << 18), factor, np.uint64)
            each[0] = 1
            _powers[k] = np.cumprod(each, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash that :func:`split` gives each of the words."""
    return split(b" ".join(words))[0]


def split(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, stop) of the white-space separated words: a polynomial in the bytes of each, from running sums over all bytes."""
    buffer = np.frombuffer(joined, np.uint8)
    space = np.ones(len(buffer) + 2, bool)
    np.less(buffer - np.uint8(0x09), 5, out=space[1:-1])
    space[1:-1] |= buffer == 0x20
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, stops = edges[::2], edges[1::2]
    up, down = _grow_powers(len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    each = buffer.astype(np.uint64)
    each += np.uint64(1)
    each *= up
    np.cumsum(each, out=sums[1:])
    h = (sums[stops] - sums[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for k in np.flatnonzero(stops - starts > LONG).tolist():
        h[k] = int.from_bytes(blake2b(joined[starts[k] : stops[k]], digest_size=8).digest(), "little")
    return h, starts, stops


class Places:
    """Places of 64-bit hashes in a sorted array, found by their upper bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bucket = np.searchsorted(hashes >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, want: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where there is none."""
        own = (want >> np.uint64(44)).astype(np.int64)
        low, high = self.bucket[own], self.bucket[own + 1]
        out = np.full(len(want), -1, np.int32)
        left = np.flatnonzero(low < high)
        low, high, want = low[left], high[left], want[left]
        while len(left):
            met = self.hashes[low] == want
            out[left[met]] = low[met]
            low += 1
            more = ~met & (low < high)
            left, low, high, want = left[more], low[more], high[more], want[more]
        return out


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER)


def _batched(texts: list[bytes], size: int = 1 << 17) -> Iterator[list[bytes]]:
    """Texts in groups of about so many bytes; a longer text is a group of its own."""
    group = np.cumsum(list(map(len, texts))) // size
    for g in np.unique(group):
        yield [texts[k] for k in np.flatnonzero(group == g)]


def _held_out(id_col: Column, mod: int = 10) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == 0


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, the first place of each, the number of the distinct hash at each place)."""
    encoded = pa.array(h).dictionary_encode()
    own = encoded.indices.to_numpy()
    first = np.empty(len(encoded.dictionary), np.int64)
    first[own[::-1]] = np.arange(len(own) - 1, -1, -1)
    return encoded.dictionary.to_numpy(), first, own


def _gathered(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, some: int = 1 << 16) -> np.ndarray:
    """The bytes of words end to end, from places in a buffer; so many words at once, as indices take eight times the bytes."""
    out, at = np.empty(int(sizes.sum()), np.uint8), 0
    for k in range(0, len(starts), some):
        own, stops = sizes[k : k + some], np.cumsum(sizes[k : k + some], dtype=np.int64)
        index = np.repeat(starts[k : k + some] - (stops - own), own) + np.arange(stops[-1])
        buffer.take(index, out=out[at : at + len(index)], mode="clip")
        at += len(index)
    return out


def _distinct(joined: bytes) -> tuple[np.ndarray, ...]:
    """(hash, count, bytes end to end, number of bytes) of the distinct words."""
    h, starts, stops = split(joined)
    hashes, first, own = _groups(h)
    sizes = (stops - starts)[first].astype(np.int32)
    return hashes, np.bincount(own, minlength=len(first)).astype(np.int32), _gathered(np.frombuffer(joined, np.uint8), starts[first], sizes), sizes


def _added_up(held: list[tuple[np.ndarray, ...]]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of several parts of :func:`_distinct`, which are emptied, with the sums of their counts."""
    h, counts, data, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    _, first, own = _groups(h)
    counts = np.bincount(own, counts, len(first)).astype(np.int64)
    del h, own
    starts, sizes = (np.cumsum(sizes, dtype=np.int64) - sizes)[first], sizes[first]
    data, offsets = _gathered(data, starts, sizes), np.append(0, np.cumsum(sizes, dtype=np.int64)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words.cast(pa.string()), counts


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, c) over all training documents; the empty word stands for the end token."""
    rows = docs.filter(~_held_out(F.col(id_col))).select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, held = 0, []

        def flush() -> pa.RecordBatch:
            nonlocal ends
            words, counts = _added_up(held)
            out = [pa.concat_arrays([words, pa.array([""])]), pa.array(np.append(counts, ends))]
            ends = 0
            return pa.RecordBatch.from_arrays(out, ["word", "c"])

        for b in batches:
            ends += b.num_rows
            for texts in _batched(list(map(_lowered, b.column("text").to_pylist()))):
                held.append(_distinct(b" ".join(texts)))
            if sum(len(x[0]) for x in held) > HELD_WORDS or sum(len(x[2]) for x in held) > HELD_BYTES:
                yield flush()
        if ends:
            yield flush()

    # Workers have added up what they can, so that adding up before the shuffle would find little.
    return rows.mapInArrow(run, "word string, c long").repartition("word").groupBy("word").agg(F.sum("c").alias("c"))


# The model.


@dataclass(frozen=True)
class Classes:
    """Tables of the subword ids, the start entry last: column, share inside the column, embedding row, whether the id begins a word."""

    column: np.ndarray
    inside: np.ndarray
    embed: np.ndarray
    begins: np.ndarray


def classes_of(id_counts: np.ndarray, begins: np.ndarray, shape: Shape) -> Classes:
    """The most frequent ids have columns of their own; the others, those that begin words apart from continuations, fill the shared columns evenly by mass.

    Inside a shared column ids have shares by their counts smoothed by a twentieth.  The start
    entry, which is never predicted, gets a column number of its own.
    """
    order = np.argsort(-id_counts, kind="stable")
    smooth = id_counts + 0.05
    column = np.empty(len(order), np.int32)
    column[order[: shape.single]] = np.arange(min(shape.single, len(order)))
    rest, half, at = order[shape.single :], shape.shared // 2, shape.single
    for ids, n in ((rest[begins[rest]], half), (rest[~begins[rest]], shape.shared - half)):
        mass = np.cumsum(smooth[ids])
        if len(ids):
            column[ids] = at + np.minimum(n - 1, (mass - smooth[ids]) * n / mass[-1]).astype(np.int32)
        at += n
    total = np.bincount(column, smooth, shape.columns)
    embed = np.full(len(order) + 1, shape.embedded - 2, np.int32)
    embed[order[: shape.embedded - 2]] = np.arange(min(shape.embedded - 2, len(order)))
    embed[-1] = shape.embedded - 1
    return Classes(np.append(column, np.int32(shape.columns)), np.append(smooth / total[column], 0.0).astype(np.float32), embed, np.append(begins, True))


def prefix_hashes(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's subwords up to each of them, for words end to end."""
    mix = lambda a: (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((a * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29))
    own, out = mix(flat.astype(np.uint64) + np.uint64(1)), np.zeros(len(flat), np.uint64)
    first = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        at = first[sizes > k] + k
        out[at] = own[at] if k == 0 else mix(out[at - 1] ^ own[at])
    return out


@dataclass(frozen=True)
class Nodes:
    """Beginnings of words by hash: how often one occurs, how often it is the whole word, and the sum of the latter and its known continuations."""

    hash: np.ndarray
    count: np.ndarray
    ends: np.ndarray
    known: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray, ends: np.ndarray, parents: np.ndarray) -> Nodes:
        order = np.argsort(hashes)
        hashes, counts, ends, parents = (x[order] for x in (hashes, counts, ends, parents))
        at = np.minimum(np.searchsorted(hashes, parents), max(0, len(hashes) - 1))
        real = hashes[at] == parents if len(hashes) else np.zeros(0, bool)
        kids = np.bincount(at[real], counts[real], len(hashes)) if len(hashes) else np.zeros(0)
        return Nodes(hashes, counts.astype(np.float32), ends.astype(np.float32), (ends + kids).astype(np.float32))

    def look(self, flat: np.ndarray, sizes: np.ndarray, places: Places) -> np.ndarray:
        """(n, 3): count, ends and known of the beginnings of words end to end; 0 where one is not kept."""
        at = places.find(prefix_hashes(flat, sizes))
        out = np.zeros((len(flat), 3), np.float32)
        met = np.flatnonzero(at >= 0)
        at = at[met]
        out[met] = np.stack((self.count[at], self.ends[at], self.known[at]), axis=1)
        return out


def follows(counts: np.ndarray, c: Classes, id_counts: np.ndarray, shape: Shape, weight: float = 20.0) -> np.ndarray:
    """P(column | column some places before) from counts (distances, columns + 1, columns), smoothed towards all columns by ``weight`` observations."""
    every = np.bincount(c.column[:-1], id_counts + 0.05, shape.columns)
    p = counts + weight * every / every.sum()
    p /= p.sum(axis=2, keepdims=True)
    return p.astype(np.float32)


def parameters(shape: Shape, seed: int = 5) -> dict[str, np.ndarray]:
    """Fresh parameters: query and key embeddings, a bias for each distance, for the sink by subword, and by how well the word's beginning is known."""
    rng = np.random.default_rng(seed)
    normal = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    e = shape.embedded
    return {"query": normal(e, shape.width), "key": normal(e, shape.width), "near": (-1 - 0.3 * np.arange(shape.window)).clip(-5).astype(np.float32), "sink": np.zeros(e, np.float32), "trust": np.zeros(24, np.float32)}


@dataclass
class Tokens:
    """Sequences end to end, one entry for each id: column, embedding row, share inside the column, whether it begins a word, the three counts of the word's beginning and the logarithm of the last, entries before it in its sequence, whether it is predicted, its sequence."""

    column: np.ndarray
    embed: np.ndarray
    inside: np.ndarray
    begins: np.ndarray
    nodes: np.ndarray
    place: np.ndarray
    scored: np.ndarray
    owner: np.ndarray


@dataclass
class Model:
    """A model with the tables that turn subword ids into columns."""

    shape: Shape
    classes: Classes
    follow: np.ndarray
    params: dict[str, np.ndarray]
    weight: float = 16.0

    def __post_init__(self) -> None:
        c = self.classes
        # In memory the column that follows comes first: what precedes one entry lies near each other then.
        self.tables = np.ascontiguousarray(self.follow.transpose(0, 2, 1))
        self.follow = self.tables.transpose(0, 2, 1)
        # Share of each row's next subwords that begin a word.
        self.starts = (self.follow[0] @ np.bincount(c.column[:-1], c.inside[:-1] * c.begins[:-1], self.shape.columns)).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: x for k, x in vars(self).items() if k not in ("_held", "follow")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state, follow=state["tables"].transpose(0, 2, 1))

    def _room(self, n: int) -> tuple[np.ndarray, ...]:
        """Arrays (window, n) that calls share, which saves fresh memory each time: weights, values and pairs, and one of cells."""
        held = getattr(self, "_held", None)
        if held is None or held[0].shape != (self.shape.window, n):
            held = self._held = (*(np.empty((self.shape.window, n), kind) for kind in (np.float32, np.float32, np.intp)), np.empty(n, np.intp))
        return held

    @staticmethod
    def affinities(p: dict[str, np.ndarray]) -> np.ndarray:
        """Weights of all pairs of embedding rows, before the distance counts."""
        return np.exp(np.minimum(p["query"] @ p["key"].T, 40)).ravel()

    def attend(self, p: dict[str, np.ndarray], t: Tokens, a: int, b: int, score: np.ndarray) -> tuple[np.ndarray, ...]:
        """Batched masked attention for the entries a..b - 1 (a > 0), each over the places before it: unnormalised weights (window, n), values without their share inside the column, pairs of embedding rows, weights and values of the sink, sums of the weights, probabilities.

        Entries at the first place of a sequence come out too and mean nothing.  ``score``: the
        affinities of ``p``.  The first three arrays hold until the next call.
        """
        shape, n, window = self.shape, b - a, self.shape.window
        # The start entry is never predicted; its cells lie outside and are clipped.
        place, target, query = t.place[a - 1 : b - 1], t.column[a:b] * (shape.columns + 1), t.embed[a - 1 : b - 1] * shape.embedded
        lo = max(0, a - window)
        of_value, of_pair = t.column[lo : b - 1], t.embed[lo : b - 1]
        weight, value, pairs, cells = self._room(n)
        near, tables = np.exp(p["near"]), self.tables.reshape(len(self.tables), -1)
        for k in range(window):
            first = a - 1 - k - lo  # the entry k places before the one that predicts a
            pad = min(n, max(0, -first))
            if pad:
                weight[k, :pad] = value[k, :pad] = pairs[k, :pad] = 0
            if pad == n:
                continue
            np.add(of_value[first + pad : first + n], target[pad:], out=cells[pad:])
            np.add(of_pair[first + pad : first + n], query[pad:], out=pairs[k, pad:])
            tables[min(k, len(tables) - 1)].take(cells[pad:], out=value[k, pad:], mode="clip")
            score.take(pairs[k, pad:], out=weight[k, pad:], mode="clip")
            weight[k] *= near[k]
        early = np.flatnonzero(place < window - 1)
        weight[:, early] *= np.arange(window)[:, None] <= place[early]
        # What follows the beginning of the word: known continuations or its end, the rest by the place before.
        inside, node = t.inside[a:b], t.nodes[a - 1 : b - 1]
        last = value[0] * inside
        met = np.where(t.begins[a:b], node[:, 1] * last / self.starts[t.column[a - 1 : b - 1]], t.nodes[a:b, 0])
        of_sink = (met + self.weight * last) / (node[:, 2] + self.weight)
        sink = np.exp(np.minimum(p["sink"][t.embed[a - 1 : b - 1]] + p["trust"][node[:, 3].astype(np.intp)], 40))
        total = weight.sum(axis=0) + sink
        return weight, value, pairs, sink, of_sink, total, (np.einsum("kt,kt->t", weight, value) * inside + sink * of_sink) / total

    def blocks(self, t: Tokens) -> Iterator[tuple[int, int]]:
        """Ranges of entries, all but the first."""
        for a in range(1, len(t.column), self.shape.block):
            yield a, min(len(t.column), a + self.shape.block)

    def gradients(self, p: dict[str, np.ndarray], t: Tokens, a: int, b: int) -> tuple[float, dict[str, np.ndarray]]:
        """Loss summed over the predicted entries among a..b - 1, divided by the tokens of a step, and its gradient."""
        e, share = self.shape.embedded, t.scored[a:b] / np.float32(self.shape.block)
        weight, value, pairs, sink, of_sink, total, prob = self.attend(p, t, a, b, self.affinities(p))
        prob = np.maximum(prob, 1e-30)
        loss = -float((np.log(prob) * share).sum())
        ratio, own = share / (total * prob), share / total
        value *= ratio * t.inside[a:b]
        np.subtract(own, value, out=value)
        value *= weight
        of = sink * (own - of_sink * ratio)
        pair = np.zeros(e * e)
        np.add.at(pair, pairs.ravel(), value.ravel().astype(np.float64))
        pair = pair.reshape(e, e).astype(np.float32)
        before = t.embed[a - 1 : b - 1]
        return loss, {
            "query": pair @ p["key"], "key": pair.T @ p["query"], "near": value.sum(axis=1), "sink": np.bincount(before, of, e).astype(np.float32),
            "trust": np.bincount(t.nodes[a - 1 : b - 1, 3].astype(np.intp), of, len(p["trust"])).astype(np.float32),
        }

    def log10(self, t: Tokens) -> np.ndarray:
        """Log10 probability of each entry that is predicted, 0 elsewhere."""
        out, score = np.zeros(len(t.column)), self.affinities(self.params)
        for a, b in self.blocks(t):
            out[a:b] = np.log10(np.maximum(self.attend(self.params, t, a, b, score)[-1], 1e-30)) * t.scored[a:b]
        return out


class Trainer:
    """Adam over the blocks of a stream of tokens; the rate falls with the share of the stream that is done."""

    def __init__(self, model: Model, tokens: float, rate: float = 0.02):
        self.model, self.steps, self.rate, self.step, self.seen = model, max(1.0, tokens / model.shape.block), rate, 0, 0
        self.p = {k: x.copy() for k, x in model.params.items()}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))

    def read(self, t: Tokens) -> None:
        """One step for each block: every token is trained on once."""
        for a, b in self.model.blocks(t):
            _, g = self.model.gradients(self.p, t, a, b)
            self.step += 1
            now = self.rate * max(0.1, 1 - 0.9 * self.step / self.steps)
            for k, x in self.p.items():
                self.m[k] += 0.1 * (g[k] - self.m[k])
                self.v[k] += 0.01 * (g[k] * g[k] - self.v[k])
                x -= (now * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.99**self.step)) + 1e-8)).astype(np.float32)
        self.seen += int(t.scored.sum())


class Lexicon:
    """Words by number, with their subword ids end to end and the counts of their beginnings.

    Words that are not in the table are read into room behind it and forgotten again.
    """

    def __init__(self, path: str, words: list[bytes], values: np.ndarray, classes: Classes, nodes: Nodes):
        self.path, self.end = path, _encoder(path)[1]
        self.words = b" ".join(w for w in words if w)  # as objects they would take ten times the room in each worker
        self.values, self.classes, self.nodes = values, classes, nodes
        self.start, self.stop_word = len(words), words.index(b"")  # the numbers of the start and of the end

    def _open(self) -> None:
        """Cuts the words and looks their beginnings up, once in each process."""
        at, words = self.stop_word, np.frombuffer(self.words, np.uint8)
        breaks = np.flatnonzero(words == 0x20)[WORD_ROWS - 1 :: WORD_ROWS].tolist()
        parts = []
        for i, j in zip([0, *(k + 1 for k in breaks)], [*breaks, len(words)], strict=True):
            own = self.words[i:j].split()
            flat, sizes = subwords_of(own, self.path)
            parts.append((flat.astype(np.int32), sizes.astype(np.int32), word_hashes(own)))
        flat, sizes, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes).astype(np.int32)
        self.places, self.beginnings = Places(hashes[order]), Places(self.nodes.hash)
        self.order = np.append(order + (order >= at), np.int32(-1))  # the end has a number and no hash; the last is for words outside
        self.sizes = np.concatenate((sizes[:at], [1], sizes[at:], [1])).astype(np.int32)
        split = int(sizes[:at].sum())
        self.flat = np.concatenate((flat[:split], [self.end], flat[split:], [self.end + 1])).astype(np.intp)
        self.first = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.counts = self._looked(self.flat, self.sizes)
        self.counts[-1] = 0
        self.stop = len(self.flat)
        c = self.classes
        self.packed = (c.column << 16 | c.embed << 1 | c.begins).astype(np.intp)

    def _looked(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The counts of beginnings of words and the logarithm of the last, four numbers as one of 16 bytes, which is quick to take."""
        out = np.empty((len(flat), 4), np.float32)
        out[:, :3] = self.nodes.look(flat, sizes, self.beginnings)
        out[:, 3] = np.minimum(np.log2(out[:, 2] + 1), 23).astype(np.int32)
        return out.view(np.complex128).ravel()

    def number(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """For each text the numbers of its words, -1 for those outside the table, which are listed too."""
        if not hasattr(self, "flat"):
            self._open()
        for some in _batched(texts):
            joined = b" ".join(some)
            h, starts, stops = split(joined)
            out = self.order[self.places.find(h)]
            edges = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in some)]))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                at = out[i:j]
                rare = np.flatnonzero(at < 0) + i
                yield at, [joined[x:y] for x, y in zip(starts[rare].tolist(), stops[rare].tolist(), strict=True)]

    def _add(self, flat: np.ndarray, sizes: np.ndarray, counts: bool) -> None:
        """Puts words, cut into subwords, behind the table, in place of those that were there."""
        base = self.start + 1
        new = {"sizes": (base, sizes), "first": (base, self.stop + np.cumsum(sizes) - sizes), "flat": (self.stop, flat)}
        if counts:
            new["counts"] = self.stop, self._looked(flat, sizes)
        for name, (at, values) in new.items():
            held, n = getattr(self, name), len(values)
            if len(held) < at + n:
                grown = np.zeros(at + 2 * n, held.dtype)
                grown[:at] = held[:at]
                setattr(self, name, held := grown)
            held[at : at + n] = values

    def _read(self, parts: list[tuple[np.ndarray, ...]], words: list[int], owners: list[int], context: int, counts: bool) -> Tokens:
        """The entries of sequences of so many words, from parts (numbers, sizes and ids of words outside the table); the first ``context`` words are not predicted."""
        numbers, sizes, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        self._add(ids.astype(np.int64), sizes.astype(np.int64), counts)
        outside = np.flatnonzero(numbers < 0)
        numbers[outside] = self.start + 1 + np.arange(len(outside))
        each = self.sizes[numbers]
        stop = np.cumsum(each, dtype=np.int64)
        take = np.repeat(self.first[numbers] - (stop - each), each) + np.arange(stop[-1])
        edges = np.concatenate(([0], stop[np.cumsum(words) - 1]))  # of the sequences
        lengths = np.diff(edges)
        place = np.arange(stop[-1]) - np.repeat(edges[:-1], lengths)
        own = self.flat.take(take)
        scored = own != self.end + 1
        if context:
            scored[: stop[context - 1]] = False
        packed = self.packed.take(own)
        if not counts:
            return Tokens(packed >> 16, *[packed[:0]] * 4, place, scored, packed[:0])
        nodes = self.counts.take(take).view(np.float32).reshape(-1, 4)
        return Tokens(packed >> 16, packed >> 1 & 0x7FFF, self.classes.inside.take(own), (packed & 1).astype(bool), nodes, place, scored, np.repeat(owners, lengths))

    def tokens(self, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], window: int, counts: bool = True) -> Iterator[Tokens]:
        """The entries of the texts with start and end, in parts of about ``SPAN`` words.

        A text is given as its numbers, and the subwords of its words outside the table as their
        numbers and ids.  Longer texts come in spans that overlap by a window; what is context
        there is not scored.  Without ``counts`` they have columns, places and what is scored alone.
        """
        if not hasattr(self, "flat"):
            self._open()
        start, end = np.array([self.start], np.int32), np.array([self.stop_word], np.int32)
        parts: list[tuple[np.ndarray, ...]] = []
        lengths: list[int] = []
        owners: list[int] = []
        held = 0
        for k, (numbers, sizes, ids) in enumerate(texts):
            if len(numbers) < SPAN:
                parts += [(start, sizes, ids), (numbers, sizes[:0], ids[:0]), (end, sizes[:0], ids[:0])]
                lengths.append(len(numbers) + 2)
                owners.append(k)
                held += len(numbers)
                if held >= SPAN:
                    yield self._read(parts, lengths, owners, 0, counts)
                    parts, lengths, owners, held = [], [], [], 0
                continue
            whole = np.concatenate((start, numbers, end))
            outside, stops = np.flatnonzero(whole < 0), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            for lo in range(0, len(whole), SPAN):
                first = max(0, lo - window)
                i, j = np.searchsorted(outside, (first, lo + SPAN))
                own = whole[first : lo + SPAN]
                yield self._read([(own, sizes[i:j], ids[stops[i] : stops[j]])], [len(own)], [k], lo - first, counts)
        if parts:
            yield self._read(parts, lengths, owners, 0, counts)


# Training over all training documents.


def _cut(counts: DataFrame, path: str) -> DataFrame:
    """(word, c, ids): the counted words with their subword ids; the end token is an id of its own, the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = _encoder(path)[1]
        for b in batches:
            words = [w.encode("utf-8", "surrogatepass") for w in b.column("word").to_pylist()]
            flat, some = subwords_of([w for w in words if w], path)
            empty, sizes = np.array([not w for w in words], bool), np.ones(len(words), np.int64)
            sizes[~empty] = some
            values = np.full(int(sizes.sum()), end, np.int32)
            values[np.repeat(~empty, sizes)] = flat
            offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.ListArray.from_arrays(offsets, pa.array(values))], ["word", "c", "ids"])

    return counts.mapInArrow(run, "word string, c long, ids array<int>")


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids end to end, their number for each word, its count) of a batch."""
    column = b.column("ids")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy(zero_copy_only=False)).astype(np.int64), b.column("c").to_numpy(zero_copy_only=False)


def _id_counts(cut: DataFrame, path: str) -> np.ndarray:
    """Counts of all subword ids, from the counted words; one row an id comes to the driver."""
    size = _encoder(path)[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                flat, sizes, c = _lists(b)
                total += np.bincount(flat, np.repeat(c, sizes), size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], ["id", "n"])

    out = np.zeros(size)
    for i, n in cut.mapInArrow(run, "id long, n double").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def least_count(df: DataFrame, column: str, most: int) -> int:
    """The least value of ``column`` for which the rows of at least that value are ``most`` at most."""
    size, least = 0, None
    for r in df.groupBy(F.col(column).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(most).toLocalIterator():
        size += r["n"]
        if size > most:
            return least if least is not None else r["c"] + 1
        least = r["c"]
    return 0 if least is None else least


def _nodes(cut: DataFrame, most: int = NODES) -> Nodes:
    """The ``most`` most frequent beginnings of words; all are counted, over all distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat, sizes, c = _lists(b)
                own = prefix_hashes(flat, sizes)
                first = np.cumsum(sizes) - sizes
                parent = np.zeros(len(own), np.uint64)
                parent[1:] = own[:-1]
                parent[first] = 0
                last = np.zeros(len(flat), bool)
                last[first + sizes - 1] = True
                n = np.repeat(c, sizes)
                hashes, at, group = _groups(own)
                sums = [np.bincount(group, x, len(at)).astype(np.int64) for x in (n, np.where(last, n, 0))]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(parent[at].view(np.int64)), *map(pa.array, sums)], ["h", "parent", "n", "ends"])

    every = written(cut.filter("word <> ''").mapInArrow(run, "h long, parent long, n long, ends long").groupBy("h").agg(F.max("parent").alias("parent"), F.sum("n").alias("n"), F.sum("ends").alias("ends")), "nodes")
    table = every.filter(F.col("n") >= least_count(every, "n", most)).toArrow()
    forget(every)
    h, parent, n, ends = (table.column(k).to_numpy() for k in ("h", "parent", "n", "ends"))
    return Nodes.of(h.view(np.uint64), n, ends, parent.view(np.uint64))


def _texts(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of a batch of the read table, as numbers and the subwords of words outside the table."""
    column = lambda name: b.column(name).to_pylist()
    return [(np.frombuffer(w, np.int32), np.frombuffer(n, np.uint32), np.frombuffer(i, np.int32)) for w, n, i in zip(column("words"), column("sizes"), column("ids"), strict=True)]


class Follow:
    """Counts of what follows each column at distance 1, 2, 3 and at the ``far`` distances together, inside and between words."""

    def __init__(self, shape: Shape, tables: int = 4):
        self.size, self.distances, self.tables = shape.columns, (*range(1, tables), *shape.far), tables
        self.n = np.zeros((tables, (self.size + 1) * self.size + 1), np.int32)  # a task has fewer tokens than that holds

    def read(self, t: Tokens) -> None:
        out, nowhere = np.flatnonzero(~t.scored), (self.size + 1) * self.size
        row = t.column * self.size
        for k in (k for k in self.distances if k < len(row)):
            cells = row[:-k] + t.column[k:]
            cells[np.flatnonzero(t.place[k:] < k)] = nowhere
            cells[out[np.searchsorted(out, k) :] - k] = nowhere
            np.add.at(self.n[min(k, self.tables) - 1], cells, np.int32(1))

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(row, columns, counts) of the rows that are not empty."""
        every = self.n[:, :-1].reshape(-1, self.size)
        for k in np.flatnonzero(every.any(axis=1)).tolist():
            at = np.flatnonzero(every[k])
            yield k, at.astype(np.uint16).tobytes(), every[k][at].tobytes()


def _follow_counts(parts: DataFrame, shape: Shape, kept=None, tables: int = 4) -> np.ndarray:
    """(distances, columns + 1, columns): the sums of the workers' counts (at, columns, n), a row for each distance and column before.

    ``kept``: a broadcast that workers used before and will use again; they drop those that a task does not name.
    """
    size = shape.columns

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, _ = -1, np.zeros(size), kept
        out = lambda: pa.RecordBatch.from_arrays([pa.array([own]), pa.array([held.astype(np.float32).tobytes()], pa.binary())], ["at", "n"])
        for b in batches:  # sorted by row
            for row, at, n in zip(b.column("at").to_pylist(), b.column("columns").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if row != own:
                    if own >= 0:
                        yield out()
                    own, held = row, np.zeros(size)
                held[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int32)
        if own >= 0:
            yield out()

    counts = np.zeros((tables * (size + 1), size), np.float32)
    for row, n in parts.repartition("at").sortWithinPartitions("at").mapInArrow(total, "at long, n binary").collect():
        counts[row] = np.frombuffer(n, np.float32)
    return counts.reshape(tables, size + 1, size)


def _trained(rows: DataFrame, model: Model, shared, of_model, tokens: int) -> dict[str, np.ndarray]:
    """Parameters after one pass over all tokens of the training documents.

    Trainers start from common parameters; their results are averaged by the tokens they read.
    """
    trainers = max(1, tokens // TRAINER_TOKENS)
    names, sizes = list(model.params), [x.size for x in model.params.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(of_model.value, tokens / trainers)
        for b in batches:
            for t in shared.value.tokens(_texts(b), trainer.model.shape.window):
                trainer.read(t)
        if trainer.seen:
            flat = np.concatenate([trainer.p[k].ravel() for k in names]).astype(np.float64) * trainer.seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), trainer.seen))], ["at", "value", "seen"])

    parts = rows.coalesce(trainers).mapInArrow(run, "at long, value double, seen long")
    flat = np.concatenate([model.params[k].ravel() for k in names])
    for at, value in parts.groupBy("at").agg((F.sum("value") / F.sum("seen")).alias("value")).collect():
        flat[at] = value
    return {k: x.reshape(model.params[k].shape) for k, x in zip(names, np.split(flat, np.cumsum(sizes)[:-1]), strict=True)}


def read(docs: DataFrame, shared, shape: Shape, id_col: str, text_col: str) -> DataFrame:
    """All texts as numbers of words, a row each, and behind them the counts of what follows in the training texts of each task.

    (id, tk, held, n, known, base, words, rare, sizes, ids): the number of words, number and summed
    values of those in the table, their numbers, the words outside it and their subwords.  Rows
    with a place ``at`` are counts (at, columns, counts) and hold no text.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tk"), _held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("text"))
    zero, none = F.lit(0).cast("long"), F.lit(b"")
    schema = rows.select("id", "tk", "held", zero.alias("n"), zero.alias("known"), F.lit(0.0).alias("base"), none.alias("words"), F.array(F.lit("")).alias("rare"), none.alias("sizes"), none.alias("ids"), zero.alias("at"), none.alias("columns"), none.alias("counts")).schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, follow, kind = shared.value, Follow(shape), pa.int64()
        for b in batches:
            kind = b.schema.field("id").type
            out = list(lexicon.number(list(map(_lowered, b.column("text").to_pylist()))))
            texts = [(at, sizes, ids) for (at, _), (ids, sizes) in zip(out, subwords_by_text([r for _, r in out], lexicon.path), strict=True)]
            for t in lexicon.tokens([x for x, held in zip(texts, b.column("held").to_pylist(), strict=True) if not held], shape.window, counts=False):
                follow.read(t)
            inside = [at[at >= 0] for at, _ in out]
            packed = lambda k, kind: pa.array([x[k].astype(kind).tobytes() for x in texts], pa.binary())
            nothing = [pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.binary()), pa.nulls(b.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("tk"), b.column("held"), pa.array([len(at) for at, _ in out], pa.int64()), pa.array(list(map(len, inside)), pa.int64()), pa.array([float(lexicon.values[x].sum()) for x in inside], pa.float64()),
                 packed(0, np.int32), pa.array([[w.decode("utf-8", "replace") for w in r] for _, r in out], pa.list_(pa.string())), packed(1, np.uint32), packed(2, np.int32), *nothing],
                schema.names,
            )
        rows = list(follow.rows())
        for k in range(0, len(rows), 256):
            at, columns, counts = zip(*rows[k : k + 256], strict=True)
            kinds = (kind, pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), x) for x in kinds] + [pa.array(at, pa.int64()), pa.array(columns, pa.binary()), pa.array(counts, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, shape: Shape | None = None) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score``: unigram word model with counts over all training documents, smoothed by 0.1.
    ``score``: log10 probability under the attention model.  Null and empty texts are the end
    token alone; a null id is held out; repeated rows get a row each.  Without training
    documents the counts are 0 and the model is untrained.
    """
    spark, shape = docs.sparkSession, shape or Shape()
    arrow_batches(spark, 500)
    counts = written(word_counts(docs, id_col, text_col), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, distinct = int(total[0]), int(total[1])
    denominator = float(np.log10(tokens + 0.1 * (distinct + 1)))
    least = least_count(counts, "c", TABLE_WORDS) if tokens else 1
    top = counts.filter(F.col("c") >= least).toArrow()
    table = dict(zip((w.encode("utf-8", "surrogatepass") for w in top.column("word").to_pylist()), top.column("c").to_pylist(), strict=True))
    if b"" not in table:
        found = counts.filter(F.col("word") == "").first()
        table[b""] = found["c"] if found else 0
    ends = table[b""]
    arrow_batches(spark, WORD_ROWS)  # words, not texts
    cut = written(_cut(counts, path), "subwords")
    id_counts = _id_counts(cut, path)
    classes = classes_of(id_counts, np.append(_begins_word(path), True), shape)
    lexicon = Lexicon(path, list(table), np.log10(np.array(list(table.values()), np.float64) + 0.1), classes, _nodes(cut))
    arrow_batches(spark, 500)
    forget(cut)
    shared = spark.sparkContext.broadcast(lexicon)
    both = written(read(docs, shared, shape, id_col, text_col), "read")
    follow = _follow_counts(both.filter("at is not null").select("at", "columns", "counts"), shape, shared)
    rows = both.filter("at is null")
    learn = rows.filter(~F.col("held")).select("words", "sizes", "ids")
    model = Model(shape, classes, follows(follow, classes, id_counts, shape), parameters(shape))
    of_model = spark.sparkContext.broadcast(model)
    params = _trained(learn, model, shared, of_model, int(id_counts.sum()))
    schema = rows.select("id", "tk", "held", "n", "known", "base", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = replace(of_model.value, params=params)
        for b in batches:
            out = np.zeros(b.num_rows)
            for t in shared.value.tokens(_texts(b), model.shape.window):
                out += np.bincount(t.owner, model.log10(t), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in ("id", "tk", "held", "n", "known", "base")] + [pa.array(out)], schema.names)

    scored = written(rows.select("id", "tk", "held", "n", "known", "base", "words", "sizes", "ids").mapInArrow(run, schema), "scored")
    of_model.destroy()
    shared.destroy()
    # Words outside the table: joined with their counts, summed for each document.  The empty entry counts equal rows.
    words = rows.select("id", "tk", F.explode(F.concat(F.array(F.lit("")), "rare")).alias("word"))
    met = words.join(counts.filter((F.col("c") < least) & (F.col("word") != "")), "word", "left")
    rare = F.col("word") != ""
    sums = met.groupBy(F.col("id").alias("_id"), F.col("tk").alias("_tk")).agg(
        F.sum(F.when(rare, F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.1)).otherwise(0.0)).alias("rare_base"),
        F.sum((rare & F.col("c").isNotNull()).cast("long")).alias("rare_known"),
        F.sum((~rare).cast("long")).alias("copies"),
    )
    joined = scored.join(sums, scored["id"].eqNullSafe(sums["_id"]) & (scored["tk"] == sums["_tk"]))
    own = F.lit(float(np.log10(ends + 0.1))) - (F.col("n") + 1) * denominator
    return joined.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), (F.col("n") + 1).alias("n_tokens"), (F.col("known") + int(ends > 0) + F.expr("rare_known div copies")).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + own + F.col("rare_base") / F.col("copies")).alias("base_score"), "score",
    )
