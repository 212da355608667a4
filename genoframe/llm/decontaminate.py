"""Benchmark decontamination: a broadcast hash set of normalised test windows, scanned over all documents.

Main path: DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import alnum_word_count, alnum_words, packed, text_key, unpacked, written

#: Most distinct windows whose 8-byte keys are broadcast (about 64 MB); beyond it the keys are joined by a shuffle.
MAX_BROADCAST_KEYS = 1_000_000
#: Most windows whose texts are broadcast to verify hits.
MAX_BROADCAST_TEXTS = 20_000


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _key(hashes: Column, pos: Column, length: int) -> Column:
    """Key of the window of ``length`` words at ``pos``, from the hashes of the words; null where the words end before it does."""
    return F.when(F.get(hashes, pos + (length - 1)).isNotNull(), F.xxhash64(F.lit(length), *[F.get(hashes, pos + k) for k in range(length)]))


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """Distinct windows of a benchmark: (key, length, window, items).

    An item with fewer than ``n`` words is one window; an item with none has no window.  Items
    without an id count as no item.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), alnum_words(F.col(text_col)).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(n))).withColumn("hashes", _hashes(F.col("words")))
    each = items.select("item", "words", "hashes", "length", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("pos"))
    key = F.lit(None).cast("long")
    for length in range(1, n + 1):
        key = F.when(F.col("length") == length, _key(F.col("hashes"), F.col("pos"), length)).otherwise(key)
    each = each.select("item", "length", key.alias("key"), F.array_join(F.slice("words", F.col("pos") + 1, F.col("length")), " ").alias("window"))
    return each.groupBy("key", "length", "window").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """Every verified occurrence of a benchmark window: (id, tk, pos, length, items).

    ``tk`` is a digest of the text, so that documents sharing an id stay apart.  Words are hashed
    once; the keys of all window lengths come from one scan.  Few keys are broadcast, and the
    words stand by to verify a hit; many are joined by a shuffle of the keys alone, and the words
    are fetched again for the documents that have a hit.
    """
    wins = written(windows(benchmark, "item_id", "text", n), "windows")
    lengths = sorted(r[0] for r in wins.select("length").distinct().collect()) or [n]  # n values at most
    keys = wins.select("key").distinct()
    few = keys.count() <= MAX_BROADCAST_KEYS
    words = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tk"), alnum_words(F.col(text_col)).alias("words"))
    at = words.withColumn("hashes", _hashes(F.col("words")))
    at = at.select("id", "tk", *(["words"] if few else []), "hashes", F.posexplode("hashes").alias("pos", "hash"))
    each = F.explode(F.array(*[F.struct(F.lit(length).alias("length"), _key(F.col("hashes"), F.col("pos"), length).alias("key")) for length in lengths]))
    probes = at.select("id", "tk", *(["words"] if few else []), "pos", each.alias("probe")).select("*", "probe.length", "probe.key").drop("probe").filter("key is not null")
    text = F.array_join(F.slice("words", F.col("pos") + 1, F.col("length")), " ").alias("window")
    if few:
        found = probes.join(F.broadcast(keys), "key", "left_semi").select("id", "tk", "pos", "key", "length", text)
    else:
        found = written(probes.join(keys, "key", "left_semi").distinct(), "candidates")
        some = found.groupBy(F.col("id").alias("_id"), F.col("tk").alias("_tk")).agg(F.collect_set(F.struct("pos", "key", "length")).alias("at"))
        texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
        met = texts.join(some, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk"))).dropDuplicates(["id", "tk"])
        found = met.select("id", "tk", alnum_words(F.col("text")).alias("words"), F.explode("at").alias("at")).select("id", "tk", "words", "at.*").select("id", "tk", "pos", "key", "length", text)
    return found.join(F.broadcast(wins) if wins.count() <= MAX_BROADCAST_TEXTS else wins, ["key", "length", "window"]).select("id", "tk", "pos", "length", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """Contaminated documents alone: (id, tk, n_hit, items).

    ``n_hit`` counts the words inside any occurrence of a window, each once; ``items`` are the
    sorted ids of the items that have an occurring window.  Repeated rows give one row.
    """
    each = written(hits(docs, benchmark, id_col, text_col, n), "hits")
    covered = each.select("id", "tk", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("length") - 1)).alias("pos"), F.lit(None).cast("string").alias("item"))
    items = each.select("id", "tk", F.lit(None).cast("int").alias("pos"), F.explode("items").alias("item"))
    parts = covered.unionByName(items).distinct()
    return parts.groupBy("id", "tk").agg(F.count("pos").alias("n_hit"), F.array_sort(F.collect_list("item")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are never contaminated; an empty benchmark leaves
    all documents clean; repeated rows get a row each.
    """
    found = contamination(docs, benchmark, id_col, text_col, n).withColumnRenamed("id", "_id")
    base = docs.select(F.col(id_col), text_key(F.col(text_col)).alias("_tk"), alnum_word_count(F.col(text_col)).alias("n_words"))
    joined = base.join(found, base[id_col].eqNullSafe(found["_id"]) & (base["_tk"] == found["tk"]), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return joined.select(
        base[id_col], "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """The documents without any occurrence of a benchmark window; columns and repeated rows stay."""
    found = contamination(docs, benchmark, id_col, text_col, n).select(F.col("id").alias("_bad_id"), F.col("tk").alias("_bad_tk"))
    keyed = packed(docs, _i=F.col(id_col), _t=text_key(F.col(text_col)))
    return unpacked(keyed.join(found, keyed["_i"].eqNullSafe(found["_bad_id"]) & (keyed["_t"] == found["_bad_tk"]), "left_anti"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """Adds ``clean_text``: the normalised words outside all hit spans, joined by one space, for documents with hits; other texts unchanged.  It takes the place of a column of that name."""
    each = hits(docs, benchmark, id_col, text_col, n)
    covered = each.select("id", "tk", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("length") - 1)).alias("pos")).distinct()
    spans = covered.groupBy(F.col("id").alias("_bad_id"), F.col("tk").alias("_bad_tk")).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.lit(True)))).alias("_hit"))
    keyed = packed(docs.drop("clean_text"), _i=F.col(id_col), _t=text_key(F.col(text_col)), _text=F.col(text_col))
    joined = keyed.join(spans, keyed["_i"].eqNullSafe(spans["_bad_id"]) & (keyed["_t"] == spans["_bad_tk"]), "left")
    kept = F.filter(F.transform(alnum_words(F.col("_text")), lambda w, i: F.when(F.element_at("_hit", i).isNull(), w)), lambda w: w.isNotNull())
    clean = F.when(F.col("_hit").isNull(), F.col("_text")).otherwise(F.array_join(kept, " "))
    return joined.select("_row.*", clean.alias("clean_text"))
