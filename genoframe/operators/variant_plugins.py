"""Further per-site and per-sample variant operators, on the frames of :mod:`genoframe.operators.variants`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filter_lang import alleles
from ..functions.sequence import reverse_complement
from ..functions.stats import binomial_p
from .overlap import overlap_pairs
from .variants import SITE, genotype_rows


def differing_to_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` with genotypes that are not the same, alleles unordered, in ``b`` (by site and sample) set to missing."""
    other = genotype_rows(b).select(*SITE, F.map_from_entries(F.array(F.struct("sample", F.array_sort("alleles").alias("g")))).alias("m"))
    by = other.select(*SITE, F.explode("m").alias("k", "v")).groupBy(*SITE).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_other"))
    x = a.join(by, SITE, "left")
    same = lambda s: F.coalesce(F.array_sort(alleles(s["gt"])) == F.element_at("_other", s["name"]), F.lit(False))
    blank = lambda s: F.regexp_replace(s["gt"], r"[0-9]+", ".")
    return x.withColumn("samples", F.transform("samples", lambda s: F.struct(s["name"].alias("name"), F.when(same(s), s["gt"]).otherwise(blank(s)).alias("gt"), s["data"].alias("data")))).drop("_other")


def reference_bases(df: DataFrame, reference: DataFrame, tag: str = "REF") -> DataFrame:
    """INFO tag with the reference bases under REF; with tag REF the column itself is replaced."""
    x = df.join(reference.select("chrom", F.col("seq").alias("_s")), "chrom", "left")
    bases = F.upper(F.substring("_s", F.col("pos").cast("int"), F.length("ref")))
    if tag == "REF":
        return x.withColumn("ref", F.coalesce(F.nullif(bases, F.lit("")), F.col("ref"))).drop("_s")
    kept = F.map_filter("info", lambda k, v: k != tag)
    return x.withColumn("info", F.when(bases.isNull(), F.col("info")).otherwise(F.map_concat(kept, F.create_map(F.lit(tag), bases)))).drop("_s")


def fix_strand(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Biallelic SNPs brought to the reference strand: (chrom, pos, ref, alt, action, samples).

    ok: REF agrees; swap: ALT is the reference base, so alleles and genotypes change places; flip
    and flip_swap: after complementing; ambiguous: A/T and C/G pairs that disagree either way;
    unresolved otherwise.
    """
    x = df.filter(F.size("alt") == 1).join(reference.select("chrom", F.col("seq").alias("_s")), "chrom")
    base, r, a = F.upper(F.substring("_s", F.col("pos").cast("int"), F.lit(1))), F.upper("ref"), F.upper(F.get("alt", F.lit(0)))
    cr, ca = reverse_complement(r), reverse_complement(a)
    pair = F.concat(F.least(r, a), F.greatest(r, a)).isin("AT", "CG")
    action = F.when(r == base, "ok").when((a == base) & ~pair, "swap").when(pair, F.when(a == base, "ambiguous").otherwise("unresolved")).when(cr == base, "flip").when(ca == base, "flip_swap").otherwise("unresolved")
    x = x.withColumn("action", action)
    swapped = F.col("action").isin("swap", "flip_swap")
    ref = F.when(F.col("action") == "swap", a).when(F.col("action") == "flip", cr).when(F.col("action") == "flip_swap", ca).otherwise(r)
    alt = F.when(F.col("action") == "swap", r).when(F.col("action") == "flip", ca).when(F.col("action") == "flip_swap", cr).otherwise(a)
    samples = F.transform("samples", lambda s: F.struct(s["name"].alias("name"), F.when(swapped, F.translate(s["gt"], "01", "10")).otherwise(s["gt"]).alias("gt")))
    return x.select("chrom", "pos", ref.alias("ref"), F.array(alt).alias("alt"), "action", samples.alias("samples"))


def guess_sex(gt: DataFrame, regions: DataFrame, error: float = 1e-2) -> DataFrame:
    """(sample, sites, heterozygous, log_ratio, guess): likelihoods of one and of two copies in regions that males have once.

    Genotypes in long form (chrom, pos, sample, a1, a2).  With one copy heterozygotes are errors;
    with two they follow Hardy-Weinberg proportions.  M where one copy is likelier.
    """
    from .popgen import site_counts

    sites = gt.select(*SITE).distinct().select("chrom", "pos", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    inside = overlap_pairs(sites, regions).select(F.col("a_chrom").alias("chrom"), F.col("a_pos").alias("pos")).distinct()
    c = site_counts(gt).filter("alt > 0 and alt < n").select(*SITE, (F.col("alt") / F.col("n")).alias("p"))
    x = gt.filter("a1 is not null and a2 is not null").join(inside, SITE).join(c, SITE)
    p, het = F.col("p"), F.col("a1") != F.col("a2")
    one = F.when(het, error).otherwise((1 - error) * F.when(F.col("a1") > 0, p).otherwise(1 - p))
    two = F.when(het, 2 * p * (1 - p)).otherwise(F.when(F.col("a1") > 0, p * p).otherwise((1 - p) * (1 - p)))
    by = x.groupBy("sample").agg(F.count("*").alias("sites"), F.count_if(het).alias("heterozygous"), F.sum(F.log10(one) - F.log10(F.greatest(two, F.lit(1e-12)))).alias("log_ratio"))
    return by.withColumn("guess", F.when(F.col("log_ratio") > 0, "M").otherwise("F"))


def frequency_distribution(df: DataFrame, bins: int = 10, tag: str = "AF") -> DataFrame:
    """(bin, n): sites by the first value of an INFO frequency, in equal bins of 0 to 1."""
    af = F.get(F.split(F.element_at("info", tag), ","), F.lit(0)).try_cast("double")
    return df.select(F.least(F.lit(bins - 1), F.floor(af * bins)).cast("int").alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def parental_origin(df: DataFrame, child: str, father: str, mother: str, kind: str = "dup") -> DataFrame:
    """One row: sites, paternal, maternal and p for a duplicated or deleted region of a trio.

    Informative sites have parents homozygous for different alleles.  Duplication: the child's
    ALT share (FORMAT AD 'ref,alt') beyond one half counts for the ALT parent; deletion: the
    child's one allele counts for the other parent.
    """
    of = lambda name: F.get(F.filter("samples", lambda s: s["name"] == name), F.lit(0))
    x = df.select(of(child).alias("c"), alleles(of(father)["gt"]).alias("f"), alleles(of(mother)["gt"]).alias("m"))
    hom = lambda g, alt: (F.size(g) == 2) & ~F.exists(g, lambda v: v.isNull()) & (~F.exists(g, lambda v: v == 0) if alt else ~F.exists(g, lambda v: v > 0))
    x = x.filter(hom("f", True) & hom("m", False) | hom("f", False) & hom("m", True)).withColumn("father_alt", hom("f", True))
    if kind == "dup":
        ad = F.split(F.element_at(F.col("c.data"), "AD"), ",")
        r, a = F.get(ad, F.lit(0)).try_cast("double"), F.get(ad, F.lit(1)).try_cast("double")
        x = x.filter((r + a > 0) & (r != a)).withColumn("paternal", (a > r) == F.col("father_alt"))
    else:
        g = alleles(F.col("c.gt"))
        only_alt, only_ref = ~F.exists(g, lambda v: v == 0), ~F.exists(g, lambda v: v > 0)
        x = x.filter(~F.exists(g, lambda v: v.isNull()) & (only_alt | only_ref)).withColumn("paternal", only_alt != F.col("father_alt"))
    row = x.agg(F.count("*").alias("sites"), F.count_if("paternal").alias("paternal"), F.count_if(~F.col("paternal")).alias("maternal"))
    return row.withColumn("p", binomial_p(F.col("paternal"), F.col("sites")))


def frameshifts(df: DataFrame, exons: DataFrame) -> DataFrame:
    """Indels inside coding exons (chrom, start, end) with ``frameshift``: whether a length change is no multiple of three; ends beyond the exon count to its border."""
    indel = df.select("chrom", "pos", "ref", F.explode("alt").alias("alt")).filter(F.length("ref") != F.length("alt"))
    iv = indel.withColumns({"start": F.col("pos") - 1, "end": F.col("pos") - 1 + F.length("ref")})
    met = overlap_pairs(iv, exons)
    cut = F.least("a_end", "b_end") - F.greatest(F.col("a_start") + 1, F.col("b_start"))
    change = F.when(F.length("a_alt") > F.length("a_ref"), F.length("a_alt") - F.length("a_ref")).otherwise(F.least(F.length("a_ref") - F.length("a_alt"), F.greatest(cut, F.lit(0))))
    by = met.groupBy(F.col("a_chrom").alias("chrom"), F.col("a_pos").alias("pos"), F.col("a_ref").alias("ref"), F.col("a_alt").alias("alt"))
    return by.agg(F.bool_or(change % 3 != 0).alias("frameshift"))


def haplotype_counts(gt: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, haplotypes, chromosomes): distinct phased haplotypes of each region (id, chrom, start, end) over samples without missing calls there."""
    sites = gt.select("chrom", "pos", "sample", "a1", "a2", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    met = overlap_pairs(sites, regions).select(F.col("b_id").alias("id"), F.col("a_sample").alias("sample"), F.col("a_pos").alias("pos"), F.posexplode(F.array("a_a1", "a_a2")).alias("phase", "a"))
    rows = met.groupBy("id", "sample", "phase").agg(F.array_sort(F.collect_list(F.struct("pos", "a"))).alias("h"), F.count_if(F.col("a").isNull()).alias("missing")).filter("missing = 0")
    text = F.array_join(F.transform("h", lambda x: F.concat(x["pos"].cast("string"), F.lit(":"), x["a"].cast("string"))), " ")
    return rows.groupBy("id").agg(F.count_distinct(text).alias("haplotypes"), F.count("*").alias("chromosomes"))


def name_sites(df: DataFrame, template: str = "chrom_pos_ref_alt") -> DataFrame:
    """Missing ids become the named fields joined by underscores."""
    parts = {"chrom": F.col("chrom"), "pos": F.col("pos").cast("string"), "ref": F.col("ref"), "alt": F.array_join("alt", ",")}
    return df.withColumn("id", F.coalesce("id", F.concat_ws("_", *[parts[p] for p in template.split("_")])))


def sort_sites(df: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Order by contig rank (chrom, rank), place, REF and ALTs."""
    x = df.join(F.broadcast(contigs), "chrom", "left") if contigs is not None else df.withColumn("rank", F.col("chrom"))
    return x.orderBy(F.col("rank").asc_nulls_last(), "chrom", "pos", "ref", F.array_join("alt", ",")).drop("rank")


def concatenate(parts: list[DataFrame], deduplicate: bool = False) -> DataFrame:
    """Site frames with one layout after another; without repeats of (place, REF, ALTs), the first part's row staying."""
    every = None
    for k, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(k))
        every = p if every is None else every.unionByName(p)
    if not deduplicate:
        return every.drop("_part")
    from pyspark.sql import Window

    w = Window.partitionBy(*SITE, "ref", F.array_join(F.array_sort("alt"), ",")).orderBy("_part")
    return every.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_part")
