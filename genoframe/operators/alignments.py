"""Alignment operators over frames with qname, flag, rname, pos (1-based), mapq and len (reference bases)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .sweep import depth_runs, genome_coverage

#: Bits of the FLAG field.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = (1 << k for k in range(12))


def has(bits: int, flag: str = "flag") -> Column:
    """All of the bits are set."""
    return F.col(flag).bitwiseAND(F.lit(bits)) == bits


def none_of(bits: int, flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(F.lit(bits)) == 0


def view(df: DataFrame, require: int = 0, exclude: int = 0, not_all: int = 0, min_mapq: int = 0, fraction: float | None = None, seed: int = 0, names: DataFrame | None = None) -> DataFrame:
    """Rows with all bits of ``require``, none of ``exclude``, not all of ``not_all``, and the least mapping quality.

    ``fraction`` keeps read names by hash, so pairs stay together; ``names`` keeps the listed ones.
    """
    out = df.filter(has(require) & none_of(exclude) & (F.col("mapq") >= min_mapq))
    if not_all:
        out = out.filter(~has(not_all))
    if fraction is not None:
        out = out.filter(F.pmod(F.xxhash64("qname", F.lit(seed)), F.lit(1 << 40)) < int(fraction * (1 << 40)))
    return out.join(names.select("qname").distinct(), "qname", "left_semi") if names is not None else out


def flag_statistics(df: DataFrame) -> DataFrame:
    """(counter, passed, failed): 16 counters over reads that pass and fail quality control."""
    primary = none_of(SECONDARY | SUPPLEMENTARY)
    paired = primary & has(PAIRED)
    mapped, both = ~has(UNMAPPED), ~has(UNMAPPED) & ~has(MATE_UNMAPPED)
    counters = {
        "total": F.lit(True), "primary": primary, "secondary": has(SECONDARY), "supplementary": has(SUPPLEMENTARY) & ~has(SECONDARY), "duplicates": has(DUPLICATE), "primary_duplicates": primary & has(DUPLICATE),
        "mapped": mapped, "primary_mapped": primary & mapped, "paired": paired, "read1": paired & has(READ1), "read2": paired & has(READ2),
        "properly_paired": paired & has(PROPER) & mapped, "with_mate_mapped": paired & both, "singletons": paired & mapped & has(MATE_UNMAPPED),
        "mate_elsewhere": paired & both & (F.col("mate_rname") != F.col("rname")), "mate_elsewhere_mapq5": paired & both & (F.col("mate_rname") != F.col("rname")) & (F.col("mapq") >= 5),
    }
    if "mate_rname" not in df.columns:
        df = df.withColumn("mate_rname", F.col("rname"))
    row = df.agg(*[F.struct(F.count_if(c & ~has(QC_FAIL)).alias("passed"), F.count_if(c & has(QC_FAIL)).alias("failed")).alias(k) for k, c in counters.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("counter"), F.col(f"{k}.passed").alias("passed"), F.col(f"{k}.failed").alias("failed")) for k in counters])).alias("x")).select("x.*")


def index_statistics(df: DataFrame, genome: DataFrame | None = None) -> DataFrame:
    """(rname, mapped, unmapped)."""
    out = df.groupBy("rname").agg(F.count_if(~has(UNMAPPED)).alias("mapped"), F.count_if(has(UNMAPPED)).alias("unmapped"))
    if genome is None:
        return out
    return genome.withColumnRenamed("chrom", "rname").join(out, "rname", "left").fillna(0, ["mapped", "unmapped"])


def counted_reads(df: DataFrame, exclude: int = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE, min_mapq: int = 0) -> DataFrame:
    """Reads that depth counts, as intervals (chrom, start, end)."""
    x = df.filter(none_of(exclude) & (F.col("mapq") >= min_mapq))
    return x.select(F.col("rname").alias("chrom"), (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.col("len")).alias("end"), "mapq")


def depth(df: DataFrame, **gates) -> DataFrame:
    """(chrom, pos, depth) of covered positions, 1-based."""
    runs = depth_runs(counted_reads(df, **gates)).filter("depth > 0")
    return runs.select("chrom", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("pos"), "depth")


def contig_coverage(df: DataFrame, genome: DataFrame, **gates) -> DataFrame:
    """(chrom, reads, covered, percent, mean_depth, mean_mapq) for each contig."""
    reads = counted_reads(df, **gates)
    n = reads.groupBy("chrom").agg(F.count("*").alias("reads"), F.avg("mapq").alias("mean_mapq"))
    runs = depth_runs(reads).filter("depth > 0").groupBy("chrom").agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.sum((F.col("end") - F.col("start")) * F.col("depth")).alias("bases"))
    x = genome.join(n, "chrom", "left").join(runs, "chrom", "left").fillna(0, ["reads", "covered", "bases"])
    return x.select("chrom", "reads", "covered", (100.0 * F.col("covered") / F.col("length")).alias("percent"), (F.col("bases") / F.col("length")).alias("mean_depth"), "mean_mapq")


def mark_duplicates(df: DataFrame) -> DataFrame:
    """Adds ``is_duplicate`` by read ends.  Needs id, start5 (unclipped 5' place), score and pair columns.

    Examined: not secondary, supplementary, unmapped or failed.  Pairs (both mates mapped): key is
    both ends' contigs, 5' places and strands; the highest score stays, ties by the smaller name.
    Reads alone: key is own contig, 5' place and strand; any paired read there beats them all,
    else the highest score stays, ties by order.  The two levels are separate.
    """
    seen = none_of(SECONDARY | SUPPLEMENTARY | UNMAPPED | QC_FAIL)
    pairs = seen & has(PAIRED) & ~has(MATE_UNMAPPED)
    own = F.struct("rname", "start5", has(REVERSE).alias("rev"))
    x = df.withColumns({"_seen": seen, "_pair": pairs, "_own": own})
    ends = x.filter("_pair").groupBy("qname").agg(F.array_sort(F.collect_list("_own")).alias("key"), F.sum("score").alias("total"), F.count("*").alias("n")).filter("n = 2")
    best = Window.partitionBy("key").orderBy(F.desc("total"), "qname")
    losers = ends.withColumn("r", F.row_number().over(best)).filter("r > 1").select("qname", F.lit(True).alias("_lost"))
    place = Window.partitionBy("_own")
    first = place.orderBy(F.col("_alone").desc(), F.desc("score"), "id")
    y = x.join(losers, "qname", "left").withColumn("_alone", F.col("_seen") & ~F.col("_pair"))
    # Reads that are not examined have no place, and would all meet in one window.
    seen = y.filter("_seen").withColumns({"_any": F.max(F.col("_pair").cast("int")).over(place), "_rank": F.row_number().over(first)})
    y = seen.unionByName(y.filter("NOT _seen").withColumns({"_any": F.lit(0), "_rank": F.lit(1)}))
    lost = F.col("_pair") & F.coalesce("_lost", F.lit(False)) | F.col("_alone") & ((F.col("_any") == 1) | (F.col("_rank") > 1))
    return y.withColumn("is_duplicate", lost).drop("_seen", "_pair", "_own", "_lost", "_alone", "_any", "_rank")


def library_size(pairs: int, unique: int) -> float | None:
    """Distinct molecules for which ``unique`` of ``pairs`` draws are expected, by bisection in 40 halvings."""
    import math

    if not 0 < unique < pairs:
        return None
    gap = lambda x: unique / x - 1 + math.exp(-pairs / x)
    low, high = 1.0, 100.0
    while gap(high * unique) > 0:
        high *= 10
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if gap(mid * unique) > 0 else (low, mid)
    return unique * (low + high) / 2


def fix_mates(df: DataFrame) -> DataFrame:
    """Primary reads with the fields of their mates (mate_rname, mate_pos, mate_reverse, mate_mapq) and the template length.

    The template runs from the leftmost to the rightmost base of a pair on one contig; its length is
    negative on the right read, and 0 across contigs or without a mate.
    """
    x = df.filter(none_of(SECONDARY | SUPPLEMENTARY))
    mate = x.select("qname", has(READ1).alias("_m1"), F.col("rname").alias("mate_rname"), F.col("pos").alias("mate_pos"), has(REVERSE).alias("mate_reverse"), F.col("mapq").alias("mate_mapq"), F.col("len").alias("_mlen"))
    one = mate.groupBy("qname", "_m1").agg(F.min_by(F.struct("mate_rname", "mate_pos", "mate_reverse", "mate_mapq", "_mlen"), "mate_pos").alias("m"))
    y = x.drop("mate_rname", "mate_pos", "mate_reverse", "mate_mapq").withColumn("_m1", ~has(READ1)).join(one, ["qname", "_m1"], "left").select("*", "m.*").drop("m", "_m1")
    left, right = F.least("pos", "mate_pos"), F.greatest(F.col("pos") + F.col("len"), F.col("mate_pos") + F.col("_mlen"))
    size = F.when(F.col("rname") == F.col("mate_rname"), F.when((F.col("pos") < F.col("mate_pos")) | ((F.col("pos") == F.col("mate_pos")) & has(READ1)), right - left).otherwise(left - right)).otherwise(0)
    return y.withColumn("template", F.coalesce(size, F.lit(0))).drop("_mlen")


def window_depth(df: DataFrame, genome: DataFrame, width: int, **gates) -> DataFrame:
    """(chrom, start, end, mean) of depth over fixed windows of each contig."""
    every = genome_coverage(counted_reads(df, **gates), genome, "bga")
    cut = every.withColumn("w", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    s, e = F.greatest("start", F.col("w") * width), F.least("end", (F.col("w") + 1) * width)
    by = cut.withColumns({"n": e - s, "stop": e}).groupBy("chrom", "w").agg(F.sum(F.col("n") * F.col("depth")).alias("b"), F.sum("n").alias("n"), F.max("stop").alias("end"))
    return by.select("chrom", (F.col("w") * width).alias("start"), "end", (F.col("b") / F.col("n")).alias("mean"))


def quantized_depth(df: DataFrame, genome: DataFrame, edges: list[int | None], **gates) -> DataFrame:
    """(chrom, start, end, bin): runs of depth in the same bin edges[i] <= depth < edges[i + 1]; outside depths are left out.

    A last edge of None leaves the top bin open.
    """
    every = genome_coverage(counted_reads(df, **gates), genome, "bga")
    b = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = F.col("depth") >= lo
        b = F.when(inside if hi is None else inside & (F.col("depth") < hi), i).otherwise(b)
    w = Window.partitionBy("chrom").orderBy("start")
    x = every.withColumn("bin", b).filter("bin is not null")
    fresh = (F.col("bin") != F.lag("bin").over(w)) | (F.col("start") != F.lag("end").over(w))
    x = x.withColumn("f", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("run", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("chrom", "run", "bin").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("chrom", "start", "end", "bin")


def depth_distribution(df: DataFrame, genome: DataFrame, **gates) -> DataFrame:
    """(chrom, depth, share): share of bases with at least that depth; chrom 'total' is the genome."""
    every = genome_coverage(counted_reads(df, **gates), genome, "bga").select("chrom", "depth", (F.col("end") - F.col("start")).alias("n"))
    both = every.unionByName(every.withColumn("chrom", F.lit("total"))).groupBy("chrom", "depth").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("chrom").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    return both.select("chrom", "depth", (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy("chrom"))).alias("share"))


def summary_numbers(df: DataFrame) -> DataFrame:
    """(key, value): headline numbers of an alignment set, one row each."""
    primary, mapped = none_of(SECONDARY | SUPPLEMENTARY), ~has(UNMAPPED)
    table = {
        "sequences": F.count_if(primary), "first_fragments": F.count_if(primary & has(READ1)), "last_fragments": F.count_if(primary & has(READ2)), "mapped": F.count_if(primary & mapped),
        "mapped_and_paired": F.count_if(primary & mapped & has(PAIRED) & ~has(MATE_UNMAPPED)), "unmapped": F.count_if(primary & ~mapped), "properly_paired": F.count_if(primary & mapped & has(PAIRED | PROPER)),
        "paired": F.count_if(primary & has(PAIRED)), "duplicated": F.count_if(primary & has(DUPLICATE)), "mq0": F.count_if(primary & mapped & (F.col("mapq") == 0)), "qc_failed": F.count_if(primary & has(QC_FAIL)),
        "non_primary": F.count_if(has(SECONDARY)), "supplementary": F.count_if(has(SUPPLEMENTARY)), "total_length": F.sum(F.when(primary, F.col("len")).otherwise(0)),
        "bases_mapped": F.sum(F.when(primary & mapped, F.col("len")).otherwise(0)), "max_length": F.max(F.when(primary, F.col("len"))),
    }
    row = df.agg(*[c.cast("long").alias(k) for k, c in table.items()])
    return row.unpivot([], list(table), "key", "value")


def histogram(df: DataFrame, column: str, exclude: int = SECONDARY | SUPPLEMENTARY) -> DataFrame:
    """(value, n) of a column over primary reads: lengths, mapping qualities, insert sizes."""
    return df.filter(none_of(exclude)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def sort_alignments(df: DataFrame, by: str = "coordinate", rank: DataFrame | None = None, tag: str | None = None) -> DataFrame:
    """coordinate: contig rank, place, strand, name; name: name with digit runs compared as numbers; tag: a column, then coordinate."""
    if by == "name":
        padded = F.array_join(F.transform(F.regexp_extract_all("qname", F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 20, "0")).otherwise(x)), "")
        return df.orderBy(padded, "qname", F.col("flag").bitwiseAND(READ1 | READ2), "flag")
    x = df.join(F.broadcast(rank.withColumnRenamed("chrom", "rname")), "rname", "left") if rank is not None else df.withColumn("rank", F.col("rname"))
    keys = [F.col("rank").asc_nulls_last(), "pos", has(REVERSE), "qname", "flag"]
    return x.orderBy(*([tag] if by == "tag" else []), *keys).drop("rank")


def to_bed(df: DataFrame) -> DataFrame:
    """Mapped reads as intervals with name, score (mapping quality) and strand."""
    return df.filter(none_of(UNMAPPED)).select(F.col("rname").alias("chrom"), (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.col("len")).alias("end"), F.col("qname").alias("name"), F.col("mapq").alias("score"), F.when(has(REVERSE), "-").otherwise("+").alias("strand"))


def to_fastq(df: DataFrame, skip: int = SECONDARY | SUPPLEMENTARY) -> DataFrame:
    """(id, mate, line): primary reads as FASTQ records in the direction they were sequenced, mates numbered by their flags."""
    back = F.col("flag").bitwiseAND(REVERSE) != 0
    seq, qual = F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")), F.when(back, F.reverse("qual")).otherwise(F.col("qual"))
    mate = F.when(F.col("flag").bitwiseAND(0x40) != 0, 1).when(F.col("flag").bitwiseAND(0x80) != 0, 2).otherwise(0)
    name = F.concat(F.col("qname"), F.when(mate > 0, F.concat(F.lit("/"), mate)).otherwise(""))
    record = F.concat(F.lit("@"), name, F.lit("\n"), F.coalesce(seq, F.lit("N")), F.lit("\n+\n"), F.coalesce(qual, F.lit("!")))
    return df.filter(F.col("flag").bitwiseAND(skip) == 0).select("id", mate.alias("mate"), record.alias("line"))
