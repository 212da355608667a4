"""Every operator over odd rows and over an empty table."""

import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from genoframe.llm import chat, decontaminate, html, licenses, lm, mixing, quality, sharding, simhash, toxicity


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog while seven"), (2, "two words"), (3, None), (4, ""), (None, "lost item")], "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def counts_of(df, *keys):
    return sorted(map(str, df.select(*keys).collect()))


OPERATORS = {
    "licenses": lambda d, b, y: licenses.scan(d),
    "sharding": lambda d, b, y: sharding.shard_rows(d, shards=4, salts=4),
    "quality": lambda d, b, y: quality.judge(d).withColumnRenamed("id", "doc_id"),
    "simhash": lambda d, b, y: simhash.report(d),
    "mixing": lambda d, b, y: mixing.mix(d).withColumnRenamed("id", "doc_id"),
    "decontaminate": lambda d, b, y: decontaminate.report(d, b),
    "toxicity": lambda d, b, y: toxicity.score(d, y),
    "lm": lambda d, b, y: lm.score(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document(name, odd_docs, benchmark, labels):
    out = OPERATORS[name](odd_docs, benchmark, labels)
    assert counts_of(out, "doc_id") == counts_of(odd_docs, "doc_id")


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_an_empty_result(name, no_docs, benchmark, labels):
    assert OPERATORS[name](no_docs, benchmark, labels).count() == 0


@pytest.mark.parametrize("name", ["decontaminate", "toxicity"])
def test_empty_side_tables(name, odd_docs, benchmark, labels):
    out = OPERATORS[name](odd_docs, benchmark.limit(0), labels.limit(0))
    assert out.count() == odd_docs.count()
    if name == "decontaminate":
        assert out.filter("contaminated").isEmpty()


def test_filters_keep_all_columns(odd_docs, benchmark):
    for out in (quality.keep_good(odd_docs), simhash.keep_first(odd_docs), decontaminate.remove_documents(odd_docs, benchmark), mixing.mixed(odd_docs)):
        assert out.columns == odd_docs.columns
        assert out.filter("_tk is not null and _tk <> 'z'").isEmpty()
        out.collect()


def test_near_dedup_keeps_one_of_each_group(odd_docs):
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_first(odd_docs).collect()]
    assert [i for i, t in kept if t and t.startswith("the quick")] == [1]
    assert len([1 for i, _ in kept if i == 8]) == 2
    assert len([1 for _, t in kept if not (t or "").strip()]) == 1


def test_simhash_of_odd_texts(odd_docs):
    got = {(r["doc_id"]): r for r in simhash.report(odd_docs).collect()}
    assert got[4]["fingerprint"] == got[5]["fingerprint"] == got[6]["fingerprint"] == "0" * 16
    assert got[4]["component_id"] == got[6]["component_id"] == 4
    assert got[1]["component_id"] == got[2]["component_id"] == 1


def test_shard_slots_are_gapless(odd_docs):
    out = sharding.shard_rows(odd_docs, shards=4, salts=4).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] is None and r["law"] == "rows"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, [])) for k in range(4)]
    assert max(sizes) - min(sizes) <= 1
    for r in out:
        text = {x["doc_id"]: x["text"] for x in odd_docs.collect()}.get(r["doc_id"])
        if r["doc_id"] not in (None, 8):
            assert r["text_crc32"] == zlib.crc32((text or "").encode()) and r["size"] == len((text or "").encode()) + 16


def test_mix_bounds(odd_docs):
    for r in mixing.mix(odd_docs).collect():
        assert 0 <= r["taken"] <= 3 * r["size"] and r["copies"] <= 3


def test_quality_base_rules(odd_docs):
    for r in quality.judge(odd_docs).collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_contamination_of_odd_rows(odd_docs, benchmark):
    got = {r["doc_id"]: r for r in decontaminate.report(odd_docs, benchmark).collect()}
    assert got[1]["n_hit"] == 11 and got[1]["n_items"] == 1 and got[7]["n_hit"] == 2
    assert got[4]["n_hit"] == 0 and got[4]["n_words"] == 0 and not got[4]["contaminated"]


def test_spans_are_removed(odd_docs, benchmark):
    got = {r["doc_id"]: r["clean_text"] for r in decontaminate.remove_spans(odd_docs.drop("_tk"), benchmark).collect()}
    assert got[1].startswith("wise owls watch") and got[7] == "" and got[5] == "" and got[4] is None


def test_frequent_lines_are_removed(spark):
    rows = [(k, f"shared banner line\nown text {'abcdef'[k]} stands here" + "\nagain" * (k % 2), "h") for k in range(6)] + [(9, None, "h"), (None, "shared banner line", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["clean_text"] for r in quality.without_frequent_lines(docs, percent=50, least=4).collect()}
    assert got[0] == "own text a stands here" and got[1] == "own text b stands here\nagain" and got[9] is None and got[None] == "shared banner line"


def test_depleted_documents_are_rejected(spark):
    # One line in 300 documents; documents with little else are depleted, the one with a long text of its own is not.
    word = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    tail = F.when(F.col("id") == 5, "a long tail of words that no other document of the host has at all").otherwise("")
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six seven eight nine ten eleven twelve\n"), word, F.lit(" "), tail).alias("text"), F.lit("h").alias("source"))
    judged = {r["id"]: r for r in quality.judge(many).collect()}
    assert judged[0]["removed"] == 12 and not judged[0]["kept"] and not judged[0]["base_failed"]
    assert judged[5]["removed"] == 12 and judged[5]["kept"]
    assert all(r["kept"] for r in quality.judge(many, least=301).collect())


def test_frequent_lines_are_joined_beyond_the_bound(spark, monkeypatch):
    rows = [(k, f"shared banner line\nown text {'abcdef'[k]} stands here", None if k % 2 else "h") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = sorted(map(repr, quality.judge(docs, percent=50, least=3).collect()))
    assert sum("removed=3" in r for r in few) == 6
    monkeypatch.setattr(quality, "MAX_BROADCAST_LINES", 0)
    assert sorted(map(repr, quality.judge(docs, percent=50, least=3).collect())) == few


def test_copies_do_not_make_lines_frequent(spark):
    copies = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("one two three four five six seven eight nine ten eleven\ntwelve thirteen").alias("text"), F.lit("h").alias("source"))
    assert quality.judge(copies).filter("kept").count() == 300


def test_lm_scores_are_negative_and_counts_right(odd_docs):
    for r in lm.score(odd_docs).collect():
        text = next((x["text"] for x in odd_docs.filter(F.col("doc_id").eqNullSafe(F.lit(r["doc_id"]))).collect()), None) if r["doc_id"] not in (None, 8) else None
        if text is not None:
            assert r["n_tokens"] == len([w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]) + 1
        assert r["score"] < 0 and r["base_score"] < 0 and r["n_known"] <= r["n_tokens"]


def test_chat_rotation_of_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello <|im_end|> there"), (1, 1, "assistant", "hello <|im_end|> there"), (1, None, "system", "rules"), (2, 0, None, None), (None, 0, "user", "lost"), (3, 0, "system", "alone"), (4, 0, "user", ""), (None, None, None, None)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("k")).withColumn("seq", F.lit("s"))
    out = chat.rotate(t).collect()
    by = {}
    for r in sorted(out, key=lambda r: (str(r["conv_id"]), r["perspective"], r["seq"])):
        by.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(by) == {(1, "user"), (1, "assistant"), (2, ""), (None, "user"), (None, ""), (4, "user")}
    for rs in by.values():
        whole, at = "".join(r["segment"] for r in rs), 0
        for r in rs:
            assert r["start"] == at and whole[r["start"] : r["stop"]] == r["segment"]
            at = r["stop"]
            if r["role"] == "assistant":
                assert r["name"] is None and whole[r["mask_start"] : r["mask_stop"]].endswith("<|im_end|>")
            else:
                assert r["mask_start"] is None
    assert [r["role"] for r in by[1, "user"]] == ["system", "assistant", "user", "user"]
    assert chat.rotate(t.limit(0)).count() == 0


def test_html_of_odd_rows(spark):
    pages = [
        (1, "http://a.example/x", "<html><body><nav>menu</nav><article><h1>T&amp;A</h1><p>one  <b>two</b><p>three&nbsp;four</article><footer>f</footer>"), (1, "http://a.example/x", None), (None, None, ""), (2, "no host", "plain &lt;text&gt;"),
        (3, "http://b.example/", "<div class='comments'><p>bad</p></div><div><p>good</p><form>f</form><aside>s</aside><script>x('</p>')</script></div><p"), (4, "http://c.example", "<p>" + "word " * 50_000),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html.main_text(df).collect()
    got = {(r["page_id"], r["url"] is None or r["n_chars"] > 0): r["text"] for r in out}
    assert len(out) == 6 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert got[1, True] == "T&A\none two\nthree four" and got[2, True] == "plain <text>" and got[3, True] == "good"
    assert got[4, True] == " ".join(["word"] * 50_000)
    assert html.main_text(df.limit(0)).count() == 0


def test_license_places(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License. mit-license"), (2, "GNU General Public License general public license"), (3, "mit the license"), (4, None), (5, "licensed under the Apache License, Version 2.0")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 3, 5, "mit")
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 1, 4)
    assert got[3]["n_base"] == 0 and got[3]["first_word"] is None and got[3]["labels"] == "" and got[4]["score"] == 0.0
    assert got[5]["labels"] == "apache" and got[5]["score"] == 1.0


def test_many_benchmark_windows_are_joined_with_the_same_result(spark, odd_docs, monkeypatch):
    prose = odd_docs.filter("doc_id = 1").first()["text"]
    benchmark = spark.createDataFrame([(1, prose), (2, "two words"), (3, "Lazy"), (4, None), (None, "quiet river"), (5, " ".join(f"w{k * 7919 % 5003}" for k in range(100, 130)))], "item_id long, text string")
    few = sorted(map(repr, decontaminate.report(odd_docs, benchmark).collect()))
    assert sum("contaminated=True" in r for r in few) > 3
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_KEYS", 0)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_TEXTS", 0)
    assert sorted(map(repr, decontaminate.report(odd_docs, benchmark).collect())) == few


def test_spans_go_beside_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", "y")], "doc_id long, text string, _clean string, clean_text string")
    benchmark = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert decontaminate.remove_spans(docs, benchmark).collect()[0].asDict() == {"doc_id": 1, "text": "a b c d", "_clean": "x", "clean_text": "a d"}


@pytest.mark.parametrize("page", [
    '<a x="bbb' + "<div " * 200_000, "<div>" * 200_000, "<div>" * 100_000 + "</p>" * 100_000, "<li>" * 200_000, "<a 'x" * 200_000, "<" * 1_000_000, "<!--" * 250_000, "<a '\"" * 200_000, "</script " * 100_000, "<dt><dd>" * 100_000, '<p a="' * 150_000 + ">",
])
def test_hostile_pages_take_no_time(page):
    began = time.time()
    html.extract(page)
    assert time.time() - began < 3


def test_tags_whose_quotes_never_close_are_text():
    assert html.extract('<p>one</p><p title="x>two</p><p>three') == "one\n<p title=\"x>two\nthree"
    assert html.extract('<p title="a>b">one</p><script>var t="</p>";</SCRIPT ><p>a < b <3</p><!-- x --><p>two<br>three</p><b') == "one\na < b <3\ntwo three"
