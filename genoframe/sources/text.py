"""Text formats as DataFrames: BED, BEDPE, bedGraph, GFF, VCF, SAM, FASTA, FASTQ, and side tables.  Gzip is read by extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _fields(spark: SparkSession, path: str, comment: str = r"^(#|track\b|browser\b)") -> DataFrame:
    """Rows of tab-separated fields (column f), without blank and comment lines."""
    rows = _lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").rlike(comment))
    return rows.select(F.split(F.regexp_replace("value", r"\r$", ""), "\t").alias("f"))


def _at(k: int) -> Column:
    return F.get("f", F.lit(k))


def _text(k: int) -> Column:
    """Field k, null where it is absent or '.'."""
    return F.nullif(_at(k), F.lit("."))


def _long(k: int) -> Column:
    return _at(k).cast("long")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name, score (text), strand, extra (fields beyond the sixth)."""
    return _fields(spark, path).select(_at(0).alias("chrom"), _long(1).alias("start"), _long(2).alias("end"), _at(3).alias("name"), _at(4).alias("score"), _at(5).alias("strand"), F.slice("f", 7, F.greatest(F.size("f") - 6, F.lit(0))).alias("extra"))


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    """The first six fields, thick range, colour and block lists of a BED12 file."""
    return read_bed(spark, path).filter(F.size("extra") >= 6).select(
        "chrom", "start", "end", "name", "score", "strand", F.col("extra")[0].cast("long").alias("thick_start"), F.col("extra")[1].cast("long").alias("thick_end"), F.col("extra")[2].alias("item_rgb"),
        F.col("extra")[4].alias("block_sizes"), F.col("extra")[5].alias("block_starts"),
    )


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    """chrom1, start1, end1, chrom2, start2, end2, name, score, strand1, strand2."""
    names = ["chrom1", "start1", "end1", "chrom2", "start2", "end2", "name", "score", "strand1", "strand2"]
    return _fields(spark, path).select(*[(_long(k) if n.startswith(("start", "end")) else _at(k)).alias(n) for k, n in enumerate(names)])


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, value (text)."""
    return _fields(spark, path).select(_at(0).alias("chrom"), _long(1).alias("start"), _long(2).alias("end"), _at(3).alias("value"))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length, from chromosome sizes or a FASTA index."""
    return _fields(spark, path).select(_at(0).alias("chrom"), _long(1).alias("length"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """chrom, source, type, start (0-based), end, score, strand, phase, attributes (map)."""
    pairs = F.filter(F.transform(F.split(F.coalesce(_at(8), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x.contains("="))
    attributes = F.str_to_map(F.array_join(pairs, ";"), F.lit(";"), F.lit("="))
    return _fields(spark, path, r"^#").select(_at(0).alias("chrom"), _text(1).alias("source"), _at(2).alias("type"), (_long(3) - 1).alias("start"), _long(4).alias("end"), _text(5).cast("double").alias("score"), _at(6).alias("strand"), _text(7).alias("phase"), attributes.alias("attributes"))


def vcf_header(spark: SparkSession, path: str) -> tuple[list[str], set[str], set[str]]:
    """(sample names, declared INFO tags, declared FORMAT tags); the header's lines come to the driver."""
    lines = [r["value"] for r in _lines(spark, path).filter(F.col("value").startswith("#")).collect()]
    names = next((x.rstrip("\r").split("\t")[9:] for x in lines if x.startswith("#CHROM")), [])
    declared = lambda kind: {x.split("ID=", 1)[1].split(",", 1)[0].split(">", 1)[0] for x in lines if x.startswith(f"##{kind}=<") and "ID=" in x}
    return names, declared("INFO"), declared("FORMAT")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos (1-based), id, ref, alt (array), qual, filter (array), info (map; flags have empty text), samples (array of name, gt, data)."""
    names, _, _ = vcf_header(spark, path)
    split = lambda k, sep: F.when(_text(k).isNull(), F.array().cast("array<string>")).otherwise(F.split(_at(k), sep))
    pairs = F.transform(split(7, ";"), lambda x: F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))))
    info = F.str_to_map(F.array_join(pairs, ";"), F.lit(";"), F.lit("="))
    keys = F.split(F.coalesce(_at(8), F.lit("")), ":")
    samples = []
    for k, name in enumerate(names):
        values = F.split(F.coalesce(_at(9 + k), F.lit("")), ":")
        data = _format_map(keys, values)
        samples.append(F.struct(F.lit(name).alias("name"), F.element_at(data, "GT").alias("gt"), data.alias("data")))
    rows = F.array(*samples) if samples else F.array().cast("array<struct<name:string,gt:string,data:map<string,string>>>")
    return _fields(spark, path, "^#").select(_at(0).alias("chrom"), _long(1).alias("pos"), _text(2).alias("id"), _at(3).alias("ref"), split(4, ",").alias("alt"), _text(5).cast("double").alias("qual"), split(6, ";").alias("filter"), F.when(_text(7).isNull(), F.create_map().cast("map<string,string>")).otherwise(info).alias("info"), rows.alias("samples"))


def _format_map(keys: Column, values: Column) -> Column:
    """FORMAT keys with a sample's values; trailing values may be absent."""
    return F.map_from_arrays(F.slice(keys, 1, F.least(F.size(keys), F.size(values))), F.slice(values, 1, F.least(F.size(keys), F.size(values))))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, rname, pos, mapq, cigar, mate_rname, mate_pos, template, seq, qual, tags (map of name to typed text)."""
    tags = F.filter(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:"))
    entries = F.transform(tags, lambda x: F.struct(F.left(x, F.lit(2)).alias("k"), F.right(x, F.length(x) - 5).alias("v")))
    mate = F.when(_at(6) == "=", _at(2)).when(_at(6) != "*", _at(6))
    star = lambda k: F.nullif(_at(k), F.lit("*"))
    return _fields(spark, path, "^@").select(
        _at(0).alias("qname"), _at(1).cast("int").alias("flag"), star(2).alias("rname"), _long(3).alias("pos"), _at(4).cast("int").alias("mapq"), star(5).alias("cigar"), mate.alias("mate_rname"), _long(7).alias("mate_pos"),
        _long(8).alias("template"), star(9).alias("seq"), star(10).alias("qual"), F.map_from_entries(entries).alias("tags"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, description, seq, by records that a '>' at the start of a line opens; a record is held whole."""
    records = spark.read.option("lineSep", "\n>").text(path).filter(F.trim("value") != "")
    records = records.select(F.regexp_replace("value", "^>", "").alias("value"))  # the first of a file
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")
    return records.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), body.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """id, description, seq, qual of four-line records.

    Lines of a file are numbered by their place in it: a whole file is one stream, read by one
    task, so large inputs should be many files.
    """
    import pyarrow as pa

    files = spark.read.text(path, wholetext=True)

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for text in b.column("value").to_pylist():
                lines = text.replace("\r\n", "\n").split("\n")
                for k in range(0, len(lines) - 3, 4):
                    name, _, more = lines[k][1:].partition(" ")
                    out.append((name, more, lines[k + 1], lines[k + 3]))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["id", "description", "seq", "qual"])

    return files.mapInArrow(run, "id string, description string, seq string, qual string")


def read_pedigree(spark: SparkSession, path: str) -> DataFrame:
    """family, child, father, mother, of rows with both parents."""
    rows = _lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    return rows.select(_at(0).alias("family"), _at(1).alias("child"), _at(2).alias("father"), _at(3).alias("mother")).filter((F.col("father") != "0") & (F.col("mother") != "0"))


def region(text: str) -> tuple[str, int, int]:
    """chrom, start, end (0-based half-open) of 'chrom', 'chrom:beg' or 'chrom:beg-end' (1-based, commas allowed); an open end is 2^30."""
    name, _, span = text.rpartition(":")
    if not name or not span.replace(",", "").replace("-", "").isdigit():
        return text, 0, 1 << 30
    begin, _, end = span.replace(",", "").partition("-")
    return name, max(0, int(begin) - 1), int(end) if end else 1 << 30


def in_regions(df: DataFrame, regions: list[str], chrom: str = "chrom", start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows that overlap any region literal; the test is a plain predicate, so a partitioned source prunes by chromosome."""
    s, e = (F.col("start") if start is None else start), (F.col("end") if end is None else end)
    test = F.lit(False)
    for name, b, x in map(region, regions):
        test = test | ((F.col(chrom) == name) & (s < x) & (e > b))
    return df.filter(test)


def sniff(head: bytes) -> str:
    """A format name from the first bytes of a file."""
    for magic, name in ((b"BAM\x01", "bam"), (b"CRAM", "cram"), (b"BCF\x02", "bcf"), (b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"##fileformat=VCF", "vcf"), (b"##gff-version", "gff"), (b"@HD\t", "sam"), (b"@SQ\t", "sam"), (b">", "fasta"), (b"@", "fastq"), (b"PAR1", "parquet")):
        if head.startswith(magic):
            return name
    line = head.split(b"\n", 1)[0].split(b"\t")
    if len(line) >= 9 and line[3].isdigit() and line[4].isdigit():
        return "gff"
    if len(line) >= 10 and line[1].isdigit() and line[4].isdigit() and not line[3].isdigit():
        return "bedpe"
    return "bed" if len(line) >= 3 and line[1].isdigit() and line[2].isdigit() else "unknown"
