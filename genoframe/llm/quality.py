"""Quality rules: lines that many documents of a host share are removed, depleted documents are rejected.

Line statistics are DataFrame operations; the repeat statistics inside one text are an Arrow batch function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_GAP, arrow_batches, packed, text_key, unpacked, written

#: Most frequent lines (host, hash) that are broadcast; beyond it they are joined by a shuffle.
MAX_BROADCAST_LINES = 200_000

_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the sequence, each word once.

    Windows are numbered by ranking pairs of shorter windows, so equal numbers mean equal windows.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    rank, span = ids, 1
    while span < width:  # the span doubles while it can, then grows by single words
        step, tail = (span, rank) if 2 * span <= width else (1, ids)
        left, right = rank[: len(ids) - span - step + 1], tail[span : len(ids) - step + 1]
        rank = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]
        span += step
    twice = np.bincount(rank)[rank] > 1
    change = np.zeros(len(ids) + 1, np.int64)
    change[:n] += twice
    change[width : n + width] -= twice
    return int((np.cumsum(change[:-1]) > 0).sum())


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return (
        len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words),
    )


def _normal(line: Column) -> Column:
    """Trimmed, white space runs to one space, digits to 0, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(line, SPACE_GAP, " ")), "[0-9]+", "0"))


def lines_of(text: Column) -> Column:
    """The lines of a text as (raw, line, hash, words): as they are, normalised, its hash, its words; lines without a word have a null hash."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(x.alias("raw"), _normal(x).alias("line")))
    return F.transform(lines, lambda x: F.struct(
        x["raw"].alias("raw"), x["line"].alias("line"), F.when(x["line"] != "", F.xxhash64(x["line"])).alias("hash"),
        F.when(x["line"] != "", F.length(x["line"]) - F.length(F.replace(x["line"], F.lit(" "))) + 1).otherwise(0).alias("words"),
    ))


def frequent_lines(docs: DataFrame, host_col: str, text_col: str, percent: int, least: int) -> DataFrame:
    """(host, hashes): lines that stand in over ``percent`` of the distinct documents of a host, and in ``least`` or more.

    Copies count once: documents are distinct if their texts are.  A host has at most
    100 / percent times as many such lines as its documents have on average.
    """
    hashes = F.array_compact(F.array_distinct(F.transform(lines_of(F.col(text_col)), lambda x: x["hash"])))
    rows = docs.select(F.col(host_col).alias("host"), text_key(F.col(text_col)).alias("tk"), hashes.alias("hashes"))
    once = rows.groupBy("host", "tk").agg(F.first("hashes").alias("hashes"))
    # An entry without a hash counts the documents.
    each = once.select("host", F.explode(F.concat("hashes", F.array(F.lit(None).cast("long")))).alias("hash"))
    counts = written(each.groupBy("host", "hash").agg(F.count("*").alias("n")).filter((F.col("n") >= least) | F.col("hash").isNull()), "lines")
    totals = counts.filter("hash is null").select(F.col("host").alias("_host"), F.col("n").alias("total"))
    met = counts.filter("hash is not null").join(totals, F.col("host").eqNullSafe(F.col("_host"))).filter(100 * F.col("n") > percent * F.col("total"))
    return met.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def with_frequent_lines(docs: DataFrame, host_col: str, text_col: str, percent: int, least: int, **columns: Column) -> DataFrame:
    """``columns`` of the documents, and ``met``: their lines, each with whether it is frequent on the document's host."""
    frequent = written(frequent_lines(docs, host_col, text_col, percent, least), "frequent").select(F.col("host").alias("_host"), F.col("hashes").alias("_hashes"))
    if frequent.agg(F.coalesce(F.sum(F.size("_hashes")), F.lit(0))).first()[0] <= MAX_BROADCAST_LINES:
        frequent = F.broadcast(frequent)
    base = docs.select(F.col(host_col).alias("_of"), F.col(text_col).alias("_text"), *[c.alias(name) for name, c in columns.items()])
    joined = base.join(frequent, F.col("_of").eqNullSafe(F.col("_host")), "left")
    met = F.transform(lines_of(F.col("_text")), lambda x: F.struct(x["raw"].alias("raw"), x["words"].alias("words"), F.coalesce(F.array_contains("_hashes", x["hash"]), F.lit(False)).alias("frequent")))
    return joined.select(*columns, F.when(F.col("_hashes").isNotNull(), met).alias("met"))


def _removed(met: str = "met") -> Column:
    """Words in frequent lines."""
    return F.coalesce(F.aggregate(met, F.lit(0).cast("long"), lambda a, x: a + F.when(x["frequent"], x["words"]).otherwise(0)), F.lit(0).cast("long"))


def _clean(text: Column, met: str = "met") -> Column:
    """The text without its frequent lines, the others as they are."""
    return F.when(F.col(met).isNull(), text).when(text.isNotNull(), F.array_join(F.transform(F.filter(met, lambda x: ~x["frequent"]), lambda x: x["raw"]), "\n"))


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", percent: int = 2, least: int = 5, least_share: float = 0.2) -> DataFrame:
    """One row per document: id, tk, host, the five statistics, removed words, clean_text, base_failed, kept.

    ``base_failed``: fewer than 10 words, or over 20 % of the words in repeated 5-word windows.
    ``clean_text``: the text without the lines that are frequent on its host, which is those in
    over ``percent`` of its distinct texts and ``least`` of them or more.  A document is depleted,
    and not kept, if under ``least_share`` of its words are left.  Null and empty texts have no
    words and fail; a null host is a host of its own; repeated rows get a row each.
    """
    arrow_batches(docs.sparkSession)
    text = F.col(text_col)
    rows = with_frequent_lines(docs, host_col, text_col, percent, least, id=F.col(id_col), host=F.col(host_col), tk=text_key(text), text=text)
    rows = rows.select("id", "host", "tk", "text", _removed().alias("removed"), _clean(F.col("text")).alias("clean_text"))
    names = [x.split()[0] for x in _STATS.split(", ")]
    schema = rows.select("id", "host", "tk", "removed", "clean_text", *[F.lit(0).cast("long").alias(n) for n in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array([text_statistics(t.as_py()) for t in b.column("text")], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in ("id", "host", "tk", "removed", "clean_text")] + [pa.array(np.ascontiguousarray(stats[:, k])) for k in range(len(names))], ["id", "host", "tk", "removed", "clean_text", *names])

    stats = rows.mapInArrow(run, schema)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed") < least_share * F.col("n_words")
    return stats.select("id", "tk", "host", *names, "removed", "clean_text", base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", **rules) -> DataFrame:
    """The documents that :func:`judge` keeps, with all their columns, their texts without frequent lines."""
    good = judge(docs, id_col, host_col, text_col, **rules).filter("kept").select(F.col("id").alias("_id"), F.col("host").alias("_host"), F.col("tk").alias("_good"), F.col("clean_text").alias("_clean"))
    good = good.dropDuplicates(["_id", "_host", "_good"])
    keyed = packed(docs, _i=F.col(id_col), _h=F.col(host_col), _t=text_key(F.col(text_col)))
    same = keyed["_i"].eqNullSafe(good["_id"]) & keyed["_h"].eqNullSafe(good["_host"]) & (keyed["_t"] == good["_good"])
    return unpacked(keyed.join(good, same).withColumn("_row", F.col("_row").withField(text_col, F.col("_clean"))))


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", percent: int = 2, least: int = 5) -> DataFrame:
    """(id, clean_text): each text without its frequent lines, the other lines as they are; null stays null."""
    rows = with_frequent_lines(docs, host_col, text_col, percent, least, **{id_col: F.col(id_col), "text": F.col(text_col)})
    return rows.select(id_col, _clean(F.col("text")).alias("clean_text"))
