"""Writers: BED, VCF, SAM, FASTA and FASTQ text, partitioned tables, and exports for other programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(*columns: Column) -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(".")) for c in columns])


def bed_lines(df: DataFrame, columns: tuple[str, ...] = ("name", "score", "strand")) -> DataFrame:
    return df.select(_line(F.col("chrom"), F.col("start"), F.col("end"), *[F.col(c) for c in columns if c in df.columns]).alias("value"))


def vcf_lines(df: DataFrame) -> DataFrame:
    """Body lines of a VCF; FORMAT has GT and the keys of the first sample's data in order."""
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    keys = F.array_distinct(F.concat(F.array(F.lit("GT")), F.array_sort(F.map_keys(F.get("samples", F.lit(0))["data"]))))
    cells = F.transform("samples", lambda s: F.array_join(F.transform(keys, lambda k: F.when(k == "GT", F.coalesce(s["gt"], F.lit("."))).otherwise(F.coalesce(F.element_at(s["data"], k), F.lit(".")))), ":"))
    site = [F.col("chrom"), F.col("pos"), F.col("id"), F.col("ref"), F.array_join("alt", ","), F.col("qual"), F.array_join("filter", ";"), info]
    return df.select(F.when(F.size("samples") > 0, F.concat_ws("\t", _line(*site), F.array_join(keys, ":"), F.array_join(cells, "\t"))).otherwise(_line(*site)).alias("value"))


def fasta_lines(df: DataFrame, width: int = 60) -> DataFrame:
    """Records as text values, sequences wrapped."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.col("id"), F.lit("\n"), body).alias("value"))


def fastq_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("@"), F.col("id"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual")).alias("value"))


def write_text(lines: DataFrame, path: str, compression: str | None = None) -> None:
    lines.write.text(path, compression=compression)


def write_sorted(df: DataFrame, path: str, chrom: str = "chrom", order: tuple[str, ...] = ("start", "end")) -> None:
    """Parquet by chromosome, sorted inside: region filters then prune folders and row groups, which stands for an index."""
    df.repartitionByRange(chrom, *order).sortWithinPartitions(chrom, *order).write.partitionBy(chrom).parquet(path)


def write_by(df: DataFrame, path: str, column: str) -> None:
    """One folder for each value: read groups, samples or chunks."""
    df.write.partitionBy(column).parquet(path)


def split_evenly(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """Adds ``part``: rows dealt to ``n`` parts by hash."""
    return df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def plink_rows(df: DataFrame) -> DataFrame:
    """Transposed PED text: chrom, id, 0, pos, then two alleles for each sample, 0 where missing."""
    letters = F.concat(F.array("ref"), F.col("alt"))
    cell = lambda s: F.array_join(F.transform(F.split(s["gt"], r"[/|]"), lambda x: F.coalesce(F.get(letters, x.try_cast("int")), F.lit("0"))), " ")
    name = F.coalesce("id", F.concat_ws(":", "chrom", "pos"))
    return df.select(F.concat_ws(" ", "chrom", name, F.lit("0"), "pos", F.array_join(F.transform("samples", cell), " ")).alias("value"))


def dosage_rows(df: DataFrame) -> DataFrame:
    """(sample, values): each sample's ALT counts (0, 1, 2; -1 missing) over the sites in (chrom, pos) order."""
    x = df.select("chrom", "pos", F.explode("samples").alias("s"))
    g = F.split(F.col("s.gt"), r"[/|]")
    n = F.when(F.exists(g, lambda v: v == "."), -1).otherwise(F.size(F.filter(g, lambda v: v != "0")))
    return x.groupBy(F.col("s.name").alias("sample")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chrom", "pos", n.alias("n")))), lambda e: e["n"].cast("string")), "\t").alias("values"))
