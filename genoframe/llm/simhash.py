"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The perfect Golay code
[23, 12, 7] decodes a segment to its nearest codeword (at most 3 bits away) and, for segments
exactly 3 bits away, to 5 more at 4 bits.  Two segments that differ in 2 bits or fewer share one
of these codewords: the nearest codeword of a word half way between them is 4 bits from either
at most.  Of fingerprints that differ in 4 bits or fewer, three segments leave two cases:

* one segment is equal and another differs in 2 bits or fewer: keys (equal segment, codeword);
* two segments differ in 1 bit each: then the nearest codeword of one side is among the near
  codewords of the other, for both segments: keys (nearest, near) and (near, nearest).

So every linked pair meets in a bucket, and buckets are verified bit by bit.

Copies of a shingle similarity of 0.8 or more differ in far more bits.  For them there is a wide
form: 128 bits, cut into five segments of 23 and a rest; for each two segments the keys (nearest
codeword of one, near codewords of the other).  Pairs meet where one side's nearest codewords are
near ones of the other in two segments, which is likely and not certain; :data:`WIDE_BITS` bits
decide.  Keys have 24 bits, so buckets stay small up to some ten million distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, arrow_batches, packed, text_key, unpacked, written
from .components import connected_components

SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Buckets with more distinct fingerprints are compared in pairs of blocks, each a task of its own.
BLOCK = 2048

#: Differing bits of 128 up to which the wide form links.  A shingle similarity of 0.8 gives 19 on average, 0.7 gives 25, unrelated texts 64.
WIDE_BITS = 22

_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over the word shingles of a text: XXH64, a bit is 1 if set in over half of them.

    Fewer words than a shingle has: the whole sequence is the only shingle; none or null: zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[len(parts) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts, view = np.zeros(64, np.int64), memoryview(joined)
    for k in range(0, n, 1 << 16):
        h = np.array([digest(view[a:b], seed) for a, b in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, tk, fp): the fingerprint of each document as a signed long; ``tk`` is a digest of the text."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    schema = rows.select("id", "tk", F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tk"), pa.array(fps.view(np.int64))], ["id", "tk", "fp"])

    return rows.mapInArrow(run, schema)


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and for each syndrome up to 6 error patterns of 4 bits or fewer, lightest first."""

    def syndrome(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    bits = [syndrome(1 << k) for k in range(23)]
    table = lambda lo, n: np.array([np.bitwise_xor.reduce([0] + [bits[lo + k] for k in range(n) if v >> k & 1]) for v in range(1 << n)], np.int64)
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for at in combinations(range(23), weight):
            s = 0
            for k in at:
                s ^= bits[k]
            patterns[s].append(sum(1 << k for k in at))
    filled = np.array([(p * 6)[:6] if len(p) < 6 else p for p in patterns], np.int64)
    return table(0, 12), table(12, 11), filled


def near_codewords(segment: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit segment: n x 6, nearest first, padded by repeats."""
    low, high, patterns = _golay()
    s = low[segment & 0xFFF] ^ high[segment >> 12]
    return (segment[:, None] ^ patterns[s]) >> 11


def bucket_keys(fps: np.ndarray) -> np.ndarray:
    """Bucket keys of each unsigned fingerprint: n x 72, with repeats."""
    segment = [((fps >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    near = [near_codewords(s) for s in segment]
    keys, tag = [], 0
    for i in range(3):
        for j in range(3):
            if i != j:
                keys.append((tag << 48) | (segment[i][:, None] << 12) | near[j])
                tag += 1
    for i, j in combinations(range(3), 2):
        keys.append((tag << 48) | (near[i][:, :1] << 12) | near[j])
        keys.append((tag << 48) | (near[i] << 12) | near[j][:, :1])
        tag += 1
    return np.concatenate(keys, axis=1)


def forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links of ``bits`` or fewer differing bits connect among distinct fingerprints.

    Each component becomes a star around its least fingerprint.
    """
    left, a, b = fps, [], []
    while len(left) > 1:
        queue, left, at = [left[0]], left[1:], 0
        while at < len(queue) and len(left):
            near = np.bitwise_count(left ^ queue[at]) <= bits
            at += 1
            if near.any():
                queue.extend(left[near])
                left = left[~near]
        if len(queue) > 1:
            group = np.array(queue, fps.dtype)
            a.append(group[group != group.min()])
            b.append(np.full(len(group) - 1, group.min()))
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a, b) connect: each node keeps the one to its least lower neighbour and hands the others to that neighbour, until none is left."""
    kept: list[np.ndarray] = []
    left = np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1)
    while len(left):
        left = left[np.lexsort((left[:, 1], left[:, 0]))]
        first = np.concatenate(([True], left[1:, 0] != left[:-1, 0]))
        kept.append(left[first])
        low = np.repeat(left[first, 1], np.diff(np.append(np.flatnonzero(first), len(left))))
        other = ~first & (left[:, 1] != low)
        left = np.stack((left[other, 1], low[other]), axis=1)
    every = np.unique(np.concatenate(kept), axis=0) if kept else left
    return np.ascontiguousarray(every[:, 0]), np.ascontiguousarray(every[:, 1])


def _verify(batches: Iterator[pa.RecordBatch], bits: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Edges of each bucket, from rows (key..., fp) sorted by their key; buckets over ``most`` pass on with edges null.

    Rows out: (a, b, key).  An edge has a null key; a row of a large bucket has its fingerprint in ``a`` and a null ``b``.
    """
    kept_key, kept_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
    passed: int | None = None  # the key whose rows have begun to pass on

    def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
        n = len(a)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), none if b is None else pa.array(b.view(np.int64)), none if key is None else pa.array(key)], ["a", "b", "key"])

    def settle(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        sizes = stops - starts
        size_of = np.repeat(sizes, sizes)
        edges_a, edges_b = [], []
        for d in range(1, 8):  # buckets of up to 8 rows: all at once
            i = np.flatnonzero((key[d:] == key[:-d]) & (size_of[:-d] <= 8)) if len(key) > d else np.empty(0, np.int64)
            x, y = fp[i], fp[i + d]
            ok = (np.bitwise_count(x ^ y) <= bits) & (x != y)
            edges_a.append(x[ok])
            edges_b.append(y[ok])
        for g in np.flatnonzero((sizes > 8) | (key[starts] == passed)) if passed is not None else np.flatnonzero(sizes > 8):
            own = np.unique(fp[starts[g] : stops[g]])
            if key[starts[g]] == passed or most is not None and len(own) > most:
                yield out(own, None, np.full(len(own), key[starts[g]]))
            else:
                x, y = forest(own, bits)
                edges_a.append(x)
                edges_b.append(y)
        x, y = contract(np.concatenate(edges_a), np.concatenate(edges_b))
        if len(x):
            yield out(x, y, None)

    for batch in batches:
        key, fp = batch.column("key").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        kept_key, kept_fp = np.concatenate((kept_key, key)), np.concatenate((kept_fp, fp))
        last = np.searchsorted(kept_key, kept_key[-1]) if len(kept_key) else 0  # keys are sorted
        if last == 0 and most is not None and len(kept_key) > 64 * most:  # one key fills the buffer: pass it on
            passed = int(kept_key[0])
            yield out(kept_fp, None, kept_key)
            kept_key, kept_fp = kept_key[:0], kept_fp[:0]
            continue
        yield from settle(kept_key[:last], kept_fp[:last])
        kept_key, kept_fp = kept_key[last:], kept_fp[last:]
    yield from settle(kept_key, kept_fp)


def links(fps: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect exactly what links of ``bits`` or fewer bits connect.

    ``bits`` can be 4 at most: the keys are made for that.
    """
    if bits > 4:
        raise ValueError("the bucket keys find pairs of 4 differing bits or fewer")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                fp = b.column("fp").to_numpy(zero_copy_only=False)[k : k + 4096]
                keys = np.sort(bucket_keys(fp.view(np.uint64)), axis=1)
                new = np.concatenate((np.ones((len(fp), 1), bool), keys[:, 1:] != keys[:, :-1]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(np.repeat(fp, new.sum(axis=1)))], ["key", "fp"])

    keyed = fps.mapInArrow(spread, "key long, fp long")
    sorted_ = keyed.repartition("key").sortWithinPartitions("key")
    first = written(sorted_.mapInArrow(lambda it: _verify(it, bits, block), "a long, b long, key long"), "links")
    edges = first.filter("key is null").select("a", "b")
    large = first.filter("key is not null").select("key", F.col("a").alias("fp")).distinct()
    counts = large.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    if not counts.isEmpty():
        cut = large.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        pairs = cut.select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        pairs = pairs.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
        again = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _verify(it, bits, None), "a long, b long, key long")
        edges = edges.unionByName(again.select("a", "b"))
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """(id, tk, fp, class, component): the component is the smallest id reachable over links of ``bits`` or fewer differing bits.

    ``class`` is the component's smallest fingerprint.
    Texts without words (null, empty, blank) have fingerprint zero and link like any other.
    Repeated rows get a row each; null ids never name a component unless all its ids are null.
    """
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    labels = connected_components(links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    linked = distinct.join(labels, "fp")
    least = linked.groupBy("label").agg(F.min("least").alias("component"))
    linked = linked.select("fp", "label").join(least, "label").select("fp", "label", "component")
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("label", "fp").alias("class"), F.coalesce("component", "least").alias("component"))
    return rows.join(named, "fp").select("id", "tk", "fp", "class", "component")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(docs, id_col, text_col, words, bits)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def wide_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bucket keys of unsigned 128-bit fingerprints, given as halves: n x 120, with repeats."""
    mask = np.uint64((1 << 23) - 1)
    middle = low >> np.uint64(46) | high << np.uint64(18)
    segment = [x.astype(np.int64) for x in (low & mask, low >> np.uint64(23) & mask, middle & mask, high >> np.uint64(5) & mask, high >> np.uint64(28) & mask)]
    near, keys = [near_codewords(s) for s in segment], []
    for tag, (i, j) in enumerate(combinations(range(5), 2)):
        keys += [tag << 24 | near[i][:, :1] << 12 | near[j], tag << 24 | near[i] << 12 | near[j][:, :1]]
    return np.concatenate(keys, axis=1)


def wide_forest(low: np.ndarray, high: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between nodes that connect what links of ``bits`` or fewer differing bits of 128 connect."""
    left, a, b = np.arange(len(node)), [], []
    while len(left) > 1:
        queue, left, at = [left[0]], left[1:], 0
        while at < len(queue) and len(left):
            near = np.bitwise_count(low[left] ^ low[queue[at]]) + np.bitwise_count(high[left] ^ high[queue[at]]) <= bits
            at += 1
            if near.any():
                queue.extend(left[near])
                left = left[~near]
        if len(queue) > 1:
            group = np.unique(node[queue])
            a.append(group[1:])
            b.append(np.full(len(group) - 1, group[0]))
    return (np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])


def wide_links(fps: DataFrame, bits: int = WIDE_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the nodes of distinct wide fingerprints (node, low, high) that meet in a bucket and differ in ``bits`` or fewer bits.

    A bucket of more than ``block`` fingerprints is compared in pairs of blocks, each a group of its own.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                b = whole.slice(k, 4096)
                column = lambda name, b=b: b.column(name).to_numpy(zero_copy_only=False)
                keys = np.sort(wide_keys(column("low").view(np.uint64), column("high").view(np.uint64)), axis=1)
                new = np.concatenate((np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]), axis=1)
                times = new.sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[new].astype(np.int32)), *(pa.array(np.repeat(column(x), times)) for x in ("node", "low", "high"))], ["key", "node", "low", "high"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ("part", "key", "node", "low", "high"), None

        def edges(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, node, low, high = x["key"], x["node"], x["low"].view(np.uint64), x["high"].view(np.uint64)
            cut = np.flatnonzero((key[1:] != key[:-1]) | (x["part"][1:] != x["part"][:-1])) + 1
            starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
            sizes = stops - starts
            size_of = np.repeat(sizes, sizes)
            a, b = [], []
            for d in range(1, 8):  # buckets of up to 8 rows: all at once
                i = np.flatnonzero((np.repeat(starts, sizes)[d:] == np.repeat(starts, sizes)[:-d]) & (size_of[:-d] <= 8)) if len(key) > d else np.empty(0, np.int64)
                ok = np.bitwise_count(low[i] ^ low[i + d]) + np.bitwise_count(high[i] ^ high[i + d]) <= bits
                a.append(node[i[ok]])
                b.append(node[i[ok] + d])
            for g in np.flatnonzero(sizes > 8):
                own = slice(starts[g], stops[g])
                p, q = wide_forest(low[own], high[own], node[own], bits)
                a.append(p)
                b.append(q)
            p, q = contract(np.concatenate(a), np.concatenate(b))
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], ["a", "b"])

        for batch in batches:
            own = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            held = own if held is None else {k: np.concatenate((held[k], own[k])) for k in names}
            if len(held["key"]):
                last = int(np.flatnonzero((held["key"] != held["key"][-1]) | (held["part"] != held["part"][-1])).max(initial=-1)) + 1
                if last:
                    yield from edges({k: x[:last] for k, x in held.items()})
                    held = {k: x[last:] for k, x in held.items()}
        if held is not None and len(held["key"]):
            yield from edges(held)

    keyed = written(fps.select("node", "low", "high").mapInArrow(spread, "key int, node long, low long, high long"), "keys")
    large = written(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block).select(F.col("key").alias("_key"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o))
    parts = keyed.join(large, F.col("key") == F.col("_key"), "left").select(F.explode(F.coalesce(pairs, F.array(F.lit(0)))).alias("part"), "key", "node", "low", "high")
    return parts.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(settle, "a long, b long")


def keep_first_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bits: int = WIDE_BITS) -> DataFrame:
    """One document of each group of near copies in shingles of ``words`` words, the one with the smallest id; all its columns stay.

    Texts link where their wide fingerprints meet and differ in ``bits`` of 128 or fewer.  Texts
    without words (null, empty, blank) are one group; repeated rows are copies; null ids come last.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    schema = rows.select("id", "tk", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            halves = [pa.array(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)) for seed in (42, 43)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tk"), *halves], ["id", "tk", "low", "high"])

    found = written(rows.mapInArrow(run, schema), "wide")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tk")).alias("first")
    distinct = written(found.groupBy("low", "high").agg(first).withColumn("node", F.xxhash64("low", "high")), "distinct")
    labels = connected_components(wide_links(distinct, bits))
    named = distinct.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn("label", F.coalesce("label", "node"))
    pick = named.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.id").alias("_id"), F.col("first.tk").alias("_pick")).distinct()
    keyed = packed(docs, _i=F.col(id_col), _t=text_key(F.col(text_col)))
    kept = keyed.join(pick, keyed["_i"].eqNullSafe(pick["_id"]) & (keyed["_t"] == pick["_pick"]), "left_semi")
    return unpacked(kept.dropDuplicates(["_i", "_t"]))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One document of each component, the one with the smallest id; all its columns stay."""
    found = near_duplicates(docs, id_col, text_col, words, bits)
    # Where several texts have the least id of their component, the one of the least digest stays.
    first = found.filter(F.col("id").eqNullSafe(F.col("component"))).groupBy("class", "component").agg(F.min("tk").alias("_pick"))
    pick = first.select(F.col("component").alias("_id"), "_pick").distinct()
    keyed = packed(docs, _i=F.col(id_col), _t=text_key(F.col(text_col)))
    kept = keyed.join(pick, keyed["_i"].eqNullSafe(pick["_id"]) & (keyed["_t"] == pick["_pick"]), "left_semi")
    return unpacked(kept.dropDuplicates(["_i", "_t"]))
