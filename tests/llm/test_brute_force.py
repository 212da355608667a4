"""Operators that SQL cannot express, against plain Python over the smallest shared tables."""

import math
import os
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from genoframe.llm import decontaminate, html, lm, mixing, quality, sharding, simhash, toxicity
from genoframe.llm.components import connected_components, contracted

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables are not here")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def plain_fingerprint(t):
    w = words(lower(t))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits):
    left, out = set(fps), {}
    while left:
        seed = left.pop()
        group, queue = [seed], [seed]
        while queue:
            x = queue.pop()
            near = {y for y in left if bin(x ^ y).count("1") <= bits}
            left -= near
            group += near
            queue += near
        for x in group:
            out[x] = min(group)
    return out


def test_simhash(docs, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    label = components(fps.values(), 4)
    least = {}
    for i, f in fps.items():
        least[label[f]] = min(i, least.get(label[f], i))
    got = {r["doc_id"]: r for r in simhash.report(docs).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: least[label[f]] for i, f in fps.items()}


@pytest.mark.parametrize("block", [4, 16, 2048])
def test_links_of_clustered_fingerprints(spark, block):
    """Clusters with many members a few bits apart, so that buckets are large; small blocks take the second path."""
    rng = np.random.default_rng(block)
    fps = set()
    for _ in range(6):
        centre = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        for _ in range(60):
            x = centre
            for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r["node"]: r["label"] for r in connected_components(simhash.links(df, 4, block)).collect()}
    want = components(fps, 4)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    mine = {signed(x): got.get(signed(x), signed(x)) for x in fps}
    assert groups(mine) == groups({signed(x): signed(v) for x, v in want.items()})


def test_golay_keys_meet():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    y = x.copy()
    for k in range(len(x)):
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            y[k] ^= np.uint64(1 << int(b))
    a, b = simhash.bucket_keys(x), simhash.bucket_keys(y)
    assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("n", [250, 1000, 4000])
def test_a_cluster_has_hardly_more_edges_than_nodes(spark, n):
    rng = np.random.default_rng(n)
    centre = int(rng.integers(1 << 62))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False)) for _ in range(n)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = contracted(simhash.links(df, 4))
    assert len(fps) - 1 <= edges.count() <= 2 * len(fps)
    labels = connected_components(edges)
    assert labels.count() == len(fps) and labels.select("label").distinct().count() == 1


def test_contracted_edges_connect_the_same_nodes():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 400, 500).astype(np.uint64), rng.integers(0, 400, 500).astype(np.uint64)

    def label(x, y):
        own = {k: k for k in map(int, {*x, *y})}
        changed = True
        while changed:
            changed = False
            for p, q in zip(map(int, x), map(int, y), strict=True):
                least = min(own[p], own[q])
                changed |= own[p] != least or own[q] != least
                own[p] = own[q] = least
        return own

    few = simhash.contract(a, b)
    assert label(*few) == label(a, b) and len(few[0]) < 500


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 501), (501, 501)], "a long, b long"))
    got = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def test_sharding(docs, texts):
    got = sharding.shard_rows(docs, shards=40).collect()
    by = Counter(r["shard"] for r in got)
    assert len(got) == len(texts) and set(by) <= set(range(40)) and max(by.values()) - min(by.get(k, 0) for k in range(40)) <= 1
    for s in by:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by[s]))
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    # No group of equal texts that fits one shard is cut.
    groups = {}
    for r in got:
        groups.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    room = len(texts) // 40
    sizes = Counter(texts.values())
    assert all(len(s) <= -(-sizes[t] // room) for t, s in groups.items())


def test_a_group_larger_than_a_shard(spark):
    rows = [(k, "same" if k < 400 else f"own {k}") for k in range(1200)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), shards=12, salts=8).collect()
    by = Counter(r["shard"] for r in got)
    assert set(by.values()) == {100}
    assert len({r["shard"] for r in got if r["doc_id"] < 400}) <= 6
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(100)) for s in by)


def plain_targets(sizes):
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes))}
    target, fixed, total = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(3 * sizes[s] for s in fixed)
        target = {s: 3 * sizes[s] if s in fixed else left * weight[s] / sum(weight[x] for x in free) for s in sizes}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        fixed |= over


def test_mixing_targets_and_taken(spark, docs):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    want = plain_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]] + 1e-9
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    skewed = spark.createDataFrame([("a", 1), ("b", 1000), ("c", 10), (None, 5)], "source string, source_size long")
    assert {r["source"]: r["target"] for r in mixing.source_targets(skewed).collect()} == pytest.approx({"a": 3, "b": 968, "c": 30, None: 15})


def test_the_mix_has_its_copies(docs):
    n = {r["id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert Counter(r["doc_id"] for r in mixing.mixed(docs).collect()) == Counter({i: k for i, k in n.items() if k})


def test_lm_base_and_order(docs, texts):
    tokens = {i: [*words(lower(t)), None] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    for i, ws in tokens.items():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(ws), sum(w in c for w in ws))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), abs=1e-6)
        assert r["score"] < 0


def test_rare_words_join(docs, monkeypatch):
    few = {r["doc_id"]: r["base_score"] for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "TABLE_WORDS", 50)
    many = {r["doc_id"]: r["base_score"] for r in lm.score(docs).collect()}
    assert many == pytest.approx(few, abs=1e-6)


def small_model(spark, texts, shape, steps=0):
    """A lexicon of some of the words, and a model from counts over the texts with random parameters."""
    c = Counter(w.encode() for t in texts for w in t.split())
    counts = spark.createDataFrame([("", len(texts)), *((w.decode(), n) for w, n in c.items())], "word string, c long")
    cut = lm.written(lm._cut(counts, lm.TOKENIZER), "t")
    id_counts = lm._id_counts(cut, lm.TOKENIZER)
    classes = lm.classes_of(id_counts, np.append(lm._begins_word(lm.TOKENIZER), True), shape)
    table = [b"", *sorted(c)[::2]]
    lexicon = lm.Lexicon(lm.TOKENIZER, table, np.zeros(len(table)), classes, lm._nodes(cut, 60))
    follow = np.zeros((4, shape.columns + 1, shape.columns))
    for t in texts:
        x = [shape.columns, *(classes.column[i] for w in t.split() for i in lm.subwords(w.encode(), lm.TOKENIZER)), classes.column[lexicon.end]]
        for k in (1, 2, 3, *shape.far):
            for i, j in zip(x, x[k:], strict=False):
                follow[min(k, 4) - 1, i, j] += 1
    rng = np.random.default_rng(3)
    params = {k: x + rng.normal(0, 0.5, x.shape).astype(np.float32) for k, x in lm.parameters(shape).items()}
    return lexicon, lm.Model(shape, classes, lm.follows(follow, classes, id_counts, shape), params)


def as_read(lexicon, text):
    ((numbers, rare),) = lexicon.number([text.encode()])
    ids, sizes = lm.subwords_of(rare, lm.TOKENIZER)
    return numbers, sizes, ids


def plain_next(model, head, words_before, node):
    """Probabilities of all ids after the entries ``head``, entry by entry; ``node``: counts of a beginning of a word, as a function of its ids."""
    c, p, shape = model.classes, model.params, model.shape
    n = len(c.column) - 1
    weights, values = [], []
    for k in range(min(shape.window, len(head))):
        i = head[-1 - k]
        weights.append(math.exp(min(40, float(p["query"][c.embed[head[-1]]] @ p["key"][c.embed[i]]) + p["near"][k])))
        values.append(model.follow[min(k, 3), c.column[i], c.column[:n]] * c.inside[:n])
    count, ends, known = node(words_before)
    met = np.array([ends * values[0][s] / model.starts[c.column[head[-1]]] if c.begins[s] else (node([*words_before, s])[0] if words_before else 0) for s in range(n)])
    weights.append(math.exp(p["sink"][c.embed[head[-1]]] + p["trust"][min(23, int(math.log2(known + 1)))]))
    values.append((met + model.weight * values[0]) / (known + model.weight))
    return sum(w * v for w, v in zip(weights, values, strict=True)) / sum(weights)


TINY = ["anblewh sttible tion the of the anbleth stti", "the of tion anblewh anble", "sttible sttibles the", "of"]


def test_lm_against_a_plain_loop(spark, monkeypatch):
    shape = lm.Shape(window=5, width=4, embedded=8, single=12, shared=4, far=(4, 5, 6), block=7)
    lexicon, model = small_model(spark, TINY, shape)
    places = lm.Places(lexicon.nodes.hash)
    node = lambda ids: lexicon.nodes.look(np.array(ids), np.array([len(ids)]), places)[-1].astype(float) if ids else np.zeros(3)
    want = []
    texts = [*TINY, "anblewhx unseen of the", "", " ".join(TINY)]
    for t in texts:
        head, word, total = [lexicon.end + 1], [], 0.0
        for ids in [*(lm.subwords(w.encode(), lm.TOKENIZER) for w in t.split()), (lexicon.end,)]:
            for i in ids:
                p = plain_next(model, head, word, node)
                assert p.sum() == pytest.approx(1, abs=1e-4)
                total += math.log10(p[i])
                word = [i] if i == ids[0] and model.classes.begins[i] else [*word, i]
                head.append(i)
        want.append(total)
    for span in (50_000, 3):
        monkeypatch.setattr(lm, "SPAN", span)
        read, got = [as_read(lexicon, t) for t in texts], np.zeros(len(texts))
        if span == 3:
            model.shape = lm.Shape(**{**vars(shape), "block": 4})
        for part in lexicon.tokens(read, 5):
            got += np.bincount(part.owner, model.log10(part), len(texts))
        assert got == pytest.approx(np.array(want), rel=1e-4)


def test_lm_gradients(spark):
    shape = lm.Shape(window=5, width=4, embedded=8, single=12, shared=4, far=(4, 5, 6))
    lexicon, model = small_model(spark, TINY, shape)
    (t,) = lexicon.tokens([as_read(lexicon, x) for x in TINY], 5)
    p = {k: x.astype(np.float64) for k, x in model.params.items()}
    _, g = model.gradients(p, t, 1, len(t.column))
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        loss = []
        for step in (1e-3, -2e-3):
            p[k][at] += step
            loss.append(model.gradients(p, t, 1, len(t.column))[0])
        p[k][at] += 1e-3
        assert (loss[0] - loss[1]) / 2e-3 == pytest.approx(float(g[k][at]), rel=3e-2, abs=1e-6)


def test_words_by_hash():
    joined = "  the Über the\n\tof x\x0b".encode() + b"y" * 300 + b" \xff\xfe the"
    h, starts, stops = lm.split(joined)
    got = [joined[i:j] for i, j in zip(starts, stops, strict=True)]
    assert got == joined.split() and len({*h.tolist()}) == len({*got}) and (h == lm.word_hashes(got)).all()
    assert len(lm.split(b"")[0]) == len(lm.split(b" \n ")[0]) == 0


def test_subwords_in_bulk():
    plain = [b"the", b"thtion,", b"caf\xc3\xa9", b"12ab!"]
    odd = [*plain, b"x" * 500, "a b".encode(), "　z".encode()]
    for ws in (plain, odd):
        flat, sizes = lm.subwords_of(ws, lm.TOKENIZER)
        assert [tuple(x) for x in np.split(flat, np.cumsum(sizes)[:-1])] == [lm.subwords(w, lm.TOKENIZER) for w in ws]


def test_one_odd_word_leaves_the_others_together(monkeypatch):
    """Words that must be cut one by one do not make the plain words of a batch go one by one too."""
    encoder, n = lm._encoder(lm.TOKENIZER)
    asked = []

    class Counting:
        _mergeable_ranks = encoder._mergeable_ranks

        def encode_ordinary(self, text):
            asked.append(text)
            return encoder.encode_ordinary(text)

    texts = [[b"the", b"caf\xc3\xa9"], [], [b"x" * 500, b"12ab!", "a\u3000b".encode()], [b"of"] * 50]
    want = [[lm.subwords(w, lm.TOKENIZER) for w in ws] for ws in texts]
    monkeypatch.setattr(lm, "_encoder", lambda path: (Counting(), n))
    got = lm.subwords_by_text(texts, lm.TOKENIZER)
    assert [[tuple(x) for x in np.split(flat, np.cumsum(sizes)[:-1])] if len(sizes) else [] for flat, sizes in got] == want
    assert len(asked) == 1 + 5 + 1  # the plain words at once, five pieces of the long one, one with a space of its own


def test_words_of_a_worker_are_added_up():
    texts = [b"the of the", b"", b" of \xc3\xbcber\tof ", b"y" * 300 + b" the"]
    held = [lm._distinct(t) for t in texts]
    words, counts = lm._added_up(held)
    assert dict(zip((w.encode() for w in words.to_pylist()), counts.tolist(), strict=True)) == Counter(b" ".join(texts).split()) and not held
    assert [len(x) for x in lm._added_up([lm._distinct(b" \n")])] == [0, 0]


def test_long_words_with_equal_sums_are_told_apart():
    bits = [i.bit_count() % 2 for i in range(2048)]
    one, other = bytes(97 + x for x in bits), bytes(98 - x for x in bits)
    words, counts = lm._added_up([lm._distinct(one + b" the"), lm._distinct(other + b" " + other)])
    assert dict(zip((w.encode() for w in words.to_pylist()), counts.tolist(), strict=True)) == {one: 1, b"the": 1, other: 2}


def test_counting_looks_no_beginnings_up(spark, monkeypatch):
    """What follows what is counted without the tables that only probabilities need; a model that was sent keeps its numbers."""
    shape = lm.Shape(window=5, width=4, embedded=8, single=12, shared=4, far=(4, 5, 6), block=7)
    lexicon, model = small_model(spark, TINY, shape)
    read = [as_read(lexicon, x) for x in [*TINY, "anblewhx unseen of the"]]
    (whole,) = lexicon.tokens(read, 5)
    sent = pickle.loads(pickle.dumps(model))
    assert (sent.log10(whole) == model.log10(whole)).all() and (sent.follow == model.follow).all()
    monkeypatch.setattr(lm.Nodes, "look", None)
    (light,) = lexicon.tokens(read, 5, counts=False)
    follows = [lm.Follow(shape), lm.Follow(shape)]
    for f, t in zip(follows, (whole, light), strict=True):
        f.read(t)
    assert (follows[0].n == follows[1].n).all() and follows[0].n[0, :-1].sum() == whole.scored.sum()


def test_toxicity_finds_held_out_words():
    rng = np.random.default_rng(2)
    vocabulary, bad = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], ["vexor", "vexil", "vexam", "grumble"]
    docs, labels = [], []
    for k in range(900):
        y = k % 8 == 0
        ws = list(rng.choice(vocabulary, 60)) + ([str(rng.choice(bad))] if y else [])
        rng.shuffle(ws)
        docs.append(" ".join(ws))
        labels.append(int(y))
    number: dict = {}
    ids = [np.array([number.setdefault(x, len(number)) for x in sorted(toxicity.features(t))], np.int32) for t in docs[:600]]
    style = np.array([toxicity.style_votes(t) for t in docs[:600]], float)
    classifier, model = toxicity.fit(ids, list(number), style, np.array(labels[:600]))
    scores = [classifier.score(t, {}) >= 0.5 for t in docs[600:]]
    assert sum(a and b for a, b in zip(scores, labels[600:], strict=True)) >= 0.95 * sum(labels[600:])
    assert sum(a and not b for a, b in zip(scores, labels[600:], strict=True)) == 0
    assert model is not None and np.allclose(model.correlation, model.correlation.T)


def test_repeated_words_against_counting():
    rng = np.random.default_rng(3)
    for n in (0, 4, 5, 6, 30, 200):
        for width in (2, 3, 5, 7):
            w = rng.integers(0, 3, n).tolist()
            grams = Counter(tuple(w[k : k + width]) for k in range(n - width + 1))
            hit = {k + j for k in range(n - width + 1) if grams[tuple(w[k : k + width])] > 1 for j in range(width)}
            assert quality.repeated_words(w, width) == len(hit)


def test_style_tree_removes_what_repeats(spark):
    pages = [(k, "http://h.example/p", f"<body><div class='pad'><p>same words on all pages</p></div><div class='main-text'><p>own words {k} of the page</p></div></body>") for k in range(12)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "own words 3 of the page"
    # One page of a host has nothing to compare with.
    one = html.main_text(spark.createDataFrame(pages[:1], "page_id long, url string, html string")).first()
    assert one["text"] == "same words on all pages\nown words 0 of the page"


def wide_components(texts, bits):
    """A label for each text: pairs link that share a key and differ in so few of 128 bits."""
    halves = {i: [simhash.fingerprint(t, 5, seed) for seed in (42, 43)] for i, t in texts.items()}
    keys = {i: set(simhash.wide_keys(*(np.array([x], np.uint64) for x in h))[0].tolist()) for i, h in halves.items()}
    label = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and keys[i] & keys[j] and sum((x ^ y).bit_count() for x, y in zip(halves[i], halves[j], strict=True)) <= bits and label[i] != label[j]:
                old, new = label[j], label[i]
                label = {k: new if v == old else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_wide_near_copies(spark, block, monkeypatch):
    monkeypatch.setattr(simhash.wide_links, "__defaults__", (simhash.WIDE_BITS, block))
    rng = np.random.default_rng(6)
    texts = {}
    for k in range(60):
        own = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for c in range(1 + 3 * (k % 5)):
            copy = list(own)
            for at in rng.choice(120, c % 4, replace=False):
                copy[at] = f"x{rng.integers(9999)}"
            texts[len(texts)] = " ".join(copy)
    texts |= {len(texts): "", len(texts) + 1: None, len(texts) + 2: "two words"}
    docs = spark.createDataFrame([(i, t, "z") for i, t in texts.items()] + [(None, texts[0], "z")], "doc_id long, text string, node string")
    label, least = wide_components(texts, simhash.WIDE_BITS), {}
    for i in sorted(texts):
        least.setdefault(label[i], i)
    kept = [r["doc_id"] for r in simhash.keep_first_similar(docs).collect()]
    assert sorted(kept) == sorted(least.values()) and len(kept) < len(texts) / 2
    assert simhash.keep_first_similar(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, texts):
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns
    want = {r["id"] for r in quality.judge(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts == {r["id"]: r["clean_text"] for r in quality.judge(docs).filter("kept").collect()}
    first = corpus_pipeline.near_dedup(spark, kept, SF)
    label, ids = wide_components({i: texts[i] for i in want}, simhash.WIDE_BITS), sorted(want)
    least = {}
    for i in ids:
        least.setdefault(label[i], i)
    assert {r["doc_id"] for r in first.collect()} == set(least.values())
    clean = corpus_pipeline.decontamination(spark, first, SF)
    bad = {r["doc_id"] for r in decontaminate.report(first, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == set(least.values()) - bad
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == corpus_pipeline.source_mixing(spark, clean, SF).count()


def test_lm_trains_on_and_counts_every_token(spark, docs, texts, monkeypatch):
    held = {}
    monkeypatch.setattr(lm, "_follow_counts", lambda *x, f=lm._follow_counts: held.setdefault("follow", f(*x)))
    monkeypatch.setattr(lm, "_trained", lambda rows, model, shared, of, n, f=lm._trained: held.setdefault("seen", (rows.collect(), model, shared.value, n)) and f(rows, model, shared, of, n))
    lm.score(docs).collect()
    training = [words(lower(t)) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    cut = [[x for w in ws for x in lm.subwords(w.encode(), lm.TOKENIZER)] for ws in training]
    tokens = sum(len(x) + 1 for x in cut)
    rows, model, lexicon, n = held["seen"]
    assert n == tokens and held["follow"][0].sum() == tokens
    assert sum(int(t.scored.sum()) for r in rows for t in lexicon.tokens([(np.frombuffer(r["words"], np.int32), np.frombuffer(r["sizes"], np.uint32), np.frombuffer(r["ids"], np.int32))], 16)) == tokens
    want = Counter()
    for x in cut:
        ids = np.append(x, lexicon.end).astype(int)
        want += Counter(zip([model.shape.columns, *model.classes.column[ids[:-1]].tolist()], model.classes.column[ids].tolist(), strict=True))
    assert {(a, b): held["follow"][0][a, b] for a, b in np.argwhere(held["follow"][0]).tolist()} == want


def test_toxicity_query_on_the_tables(spark):
    """Held-out rows, predictions, accuracy on held-out labels, and that labels of held-out rows, languages and sources decide nothing."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == docs.count()
    held = {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in got.items() if r["held_out"]} == held
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    truth = {r["doc_id"]: r["toxic"] for r in labels.filter("toxic IS NOT NULL").collect() if r["doc_id"] in held}
    right = sum(got[i]["predicted"] == y for i, y in truth.items())
    assert right >= 0.95 * len(truth) and len(truth) > 10
    turned = labels.withColumn("toxic", F.when(F.col("doc_id").isin(*held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = {r["doc_id"]: r["score"] for r in toxicity.score(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), turned).collect()}
    assert other == pytest.approx({i: r["score"] for i, r in got.items()})


def test_html_against_pages_put_together(spark):
    """Pages whose article is known, in several kinds of markup, with boilerplate around it."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9999, n))
    pages, want = [], {}
    for k in range(60):
        paragraphs = [words(rng.integers(3, 30)) for _ in range(rng.integers(1, 6))]
        body = "".join(f"<p>{p.replace('w', '&#119;', 1)}<!-- x -->" for p in paragraphs)
        core = [f"<article><h1>{words(3)}</h1>{body}</article>", f"<main><h1>{words(3)}</h1><div>{body}</div></main>", f"<div><h1>{words(3)}</h1>{body}</div>"][k % 3]
        title = re.search("<h1>(.*)</h1>", core)[1]
        noise = f"<nav><ul><li>home<li>about</ul></nav><script>var a = '<p>no</p>';</script><header>site</header><div class='ad-box'>{words(4)}</div>"
        pages.append((k, f"http://h{k % 3}.example/{k}", f"<!DOCTYPE html><html><head><title>t</title></head><body>{noise}{core}<section id=comments><p>{words(5)}</section><footer>end</footer></body></html>"))
        want[k] = "\n".join([title, *paragraphs])
    got = {r["page_id"]: r for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {k: r["text"] for k, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_style_tree_alone_removes_what_no_name_gives_away(spark):
    pages = [(k, "http://h.example/x", f"<body><div><span>Made with care in one place</span></div><div><p>text {k} of its own {k * k}</p></div></body>") for k in range(12)]
    layout = [(k, u, p.replace("<div><span>", '<div class="zq"><span>').replace("<div><p>", '<div class="zr"><p>')) for k, u, p in pages]
    got = html.main_text(spark.createDataFrame(layout, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"text {k} of its own {k * k}" for k in range(12)}
