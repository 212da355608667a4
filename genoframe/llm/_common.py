"""Pieces that several operators share: word patterns, lineage cuts and scalable running sums."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of letters and digits; everything outside ASCII counts as a letter.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACE_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone.  Pure ASCII texts take the byte-wise built-in, the rest a translation."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _pieces(text: Column, gap: str) -> Column:
    """Splitting at the gaps costs half of extracting the words; only the first and last piece can be empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def alnum_words(text: Column) -> Column:
    """The alphanumeric words of a text with A-Z lower-cased; null gives an empty array."""
    return _pieces(lower_ascii(text), ALNUM_GAP)


def alnum_word_count(text: Column) -> Column:
    """Number of alphanumeric words of a lower-cased text; capitals need no lower-casing to be counted."""
    return F.size(_pieces(text, ALNUM_GAP.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))).cast("long")


def space_words(text: Column) -> Column:
    """The white-space separated words of a text; null gives an empty array."""
    return _pieces(text, SPACE_GAP)


def space_word_count(text: Column) -> Column:
    """Number of white-space separated words; null gives 0."""
    return F.size(space_words(text)).cast("long")


def text_key(text: Column) -> Column:
    """64-bit digest that tells rows with the same id but other texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows of ``docs`` as one column ``_row`` beside key columns, so that no column of theirs can clash."""
    return docs.select(F.struct("*").alias("_row"), *[c.alias(name) for name, c in keys.items()])


def unpacked(df: DataFrame) -> DataFrame:
    """The rows behind :func:`packed`, with their own columns."""
    return df.select("_row.*")


_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: the session's checkpoint folder.

    Only where the session has none and runs in one process (tests) a temporary one is set; on a
    cluster that would be a folder of one machine, so there its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="genoframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again, which cuts the lineage.

    Lost executors cost nothing: the table is on shared storage.  :func:`forget` removes a table
    that a later one replaces; the rest go when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._genoframe_path = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the table behind a frame that :func:`written` returned."""
    _remove(df.sparkSession, df._genoframe_path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)


def running(df: DataFrame, by: list[str], bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one, within ``by``.

    Rows are ordered by (bucket, order).  Bucket totals are summed first, so that no task ever
    holds more than one bucket of one ``by`` value; ``bucket`` must have few distinct values.
    """
    keys = [*by, "_bucket"]
    df = df.withColumns({"_bucket": bucket, "_value": value})
    totals = df.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, keys)
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_bucket", "_value", "_offset")
    )


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps Arrow batches of whole texts small enough for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
