"""Population genetics over genotypes in long form: chrom, pos, sample, a1, a2 (null: missing), and dp where needed.

Every statistic is one or two aggregations by site, sample or bin; pairs of sites or samples are
joined on the sample or site that they share, within a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hardy_weinberg

SITE = ["chrom", "pos"]


def _dosage() -> Column:
    return (F.col("a1") > 0).cast("int") + (F.col("a2") > 0).cast("int")


def _diploid() -> Column:
    return F.col("a1").isNotNull() & F.col("a2").isNotNull()


def site_counts(gt: DataFrame) -> DataFrame:
    """For each site: samples, called, n (chromosomes), alt (ALT chromosomes), het, hom_ref, hom_alt."""
    ok = _diploid()
    het, ref = F.col("a1") != F.col("a2"), (F.col("a1") == 0) & (F.col("a2") == 0)
    return gt.groupBy(*SITE).agg(
        F.count("*").alias("samples"), F.count_if(ok).alias("called"), (2 * F.count_if(ok)).alias("n"), F.coalesce(F.sum(F.when(ok, _dosage())), F.lit(0)).alias("alt"),
        F.count_if(ok & het).alias("het"), F.count_if(ok & ref).alias("hom_ref"), F.count_if(ok & ~het & ~ref).alias("hom_alt"),
    )


def allele_frequencies(gt: DataFrame) -> DataFrame:
    """(site, allele, count, n, frequency), missing alleles left out."""
    each = gt.select(*SITE, F.explode(F.array("a1", "a2")).alias("allele")).filter("allele is not null")
    by = each.groupBy(*SITE, "allele").agg(F.count("*").alias("count"))
    n = F.sum("count").over(Window.partitionBy(*SITE))
    return by.withColumn("n", n).withColumn("frequency", F.col("count") / F.col("n"))


def site_depth(gt: DataFrame) -> DataFrame:
    """(site, sum, mean, variance) of depth; the variance is the sample's."""
    return gt.groupBy(*SITE).agg(F.sum("dp").alias("sum_depth"), F.avg("dp").alias("mean_depth"), F.var_samp("dp").alias("var_depth"))


def sample_depth(gt: DataFrame) -> DataFrame:
    return gt.groupBy("sample").agg(F.count("dp").alias("sites"), F.avg("dp").alias("mean_depth"))


def missing_by_sample(gt: DataFrame) -> DataFrame:
    """Missing: the first allele is."""
    miss = F.count_if(F.col("a1").isNull())
    return gt.groupBy("sample").agg(F.count("*").alias("n"), miss.alias("missing"), (miss / F.count("*")).alias("fraction"))


def missing_by_site(gt: DataFrame) -> DataFrame:
    miss = F.count_if(F.col("a1").isNull())
    return gt.groupBy(*SITE).agg(F.count("*").alias("n"), miss.alias("missing"), (miss / F.count("*")).alias("fraction"))


def hardy(gt: DataFrame) -> DataFrame:
    """Observed and expected genotypes, chi-square and exact p of biallelic, fully diploid sites."""
    c = site_counts(gt).filter("called > 0")
    n, p = F.col("called"), (F.col("n") - F.col("alt")) / F.col("n")
    e1, e2, e3 = p * p * n, 2 * p * (1 - p) * n, (1 - p) * (1 - p) * n
    term = lambda o, e: F.when(e > 0, (F.col(o) - e) * (F.col(o) - e) / e).otherwise(0.0)
    x = c.withColumns({"e_hom_ref": e1, "e_het": e2, "e_hom_alt": e3, "chi2": term("hom_ref", e1) + term("het", e2) + term("hom_alt", e3)})
    x = x.withColumn("x", hardy_weinberg(F.col("het"), F.col("hom_ref"), F.col("hom_alt")))
    return x.select(*SITE, "hom_ref", "het", "hom_alt", "e_hom_ref", "e_het", "e_hom_alt", "chi2", "x.p", "x.p_deficit", "x.p_excess")


def heterozygosity(gt: DataFrame) -> DataFrame:
    """(sample, observed, expected, sites, f): homozygous sites observed and expected, monomorphic sites left out."""
    c = site_counts(gt).filter("alt > 0 and alt < n")
    p = F.col("alt") / F.col("n")
    c = c.select(*SITE, (1 - 2 * p * (1 - p) * F.col("n") / (F.col("n") - 1)).alias("e"))
    x = gt.filter(_diploid()).join(c, SITE).groupBy("sample").agg(F.count_if(F.col("a1") == F.col("a2")).alias("observed"), F.sum("e").alias("expected"), F.count("*").alias("sites"))
    return x.withColumn("f", (F.col("observed") - F.col("expected")) / (F.col("sites") - F.col("expected")))


def site_pi(gt: DataFrame) -> DataFrame:
    """(site, pi): (n^2 - sum of squared allele counts) / (n (n - 1)) over called chromosomes, n at least 2."""
    f = allele_frequencies(gt).groupBy(*SITE).agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("sq"))
    return f.filter("n >= 2").select(*SITE, ((F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") * (F.col("n") - 1))).alias("pi"))


def window_pi(gt: DataFrame, width: int, step: int | None = None) -> DataFrame:
    """(chrom, bin_start, bin_end, variants, pi): mismatching pairs over all pairs, monomorphic places counted with all samples."""
    step = step or width
    f = allele_frequencies(gt).groupBy(*SITE).agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("sq"))
    total = gt.agg((2 * F.count_distinct("sample")).alias("all"))
    mism = (F.col("n") * F.col("n") - F.col("sq"))
    x = f.withColumn("mism", mism).filter("mism > 0").crossJoin(F.broadcast(total))
    first, last = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("pos") - width) / step)), F.ceil(F.col("pos") / step) - 1
    x = x.withColumn("idx", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    y = x.groupBy("chrom", "idx").agg(F.count("*").alias("variants"), F.sum("mism").alias("mism"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), F.max("all").alias("all"))
    pairs = F.col("pairs") + (width - F.col("variants")) * F.col("all") * (F.col("all") - 1)
    return y.select("chrom", (F.col("idx") * step + 1).alias("bin_start"), (F.col("idx") * step + width).alias("bin_end"), "variants", (F.col("mism") / pairs).alias("pi"))


def tajima_d(gt: DataFrame, width: int) -> DataFrame:
    """(chrom, bin_start, sites, d) over bins of biallelic polymorphic sites; n is the commonest number of chromosomes."""
    c = site_counts(gt).filter("alt > 0 and alt < n")
    c = c.withColumns({"bin_start": F.floor((F.col("pos") - 1) / width) * width, "pi": 2 * F.col("alt") * (F.col("n") - F.col("alt")) / (F.col("n") * (F.col("n") - 1))})
    modal = c.groupBy("chrom", "bin_start", "n").agg(F.count("*").alias("k")).groupBy("chrom", "bin_start").agg(F.max(F.struct("k", "n"))["n"].alias("m"))
    x = c.groupBy("chrom", "bin_start").agg(F.count("*").alias("sites"), F.sum("pi").alias("pi")).join(modal, ["chrom", "bin_start"])
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("m") - 1).cast("int"))
    total = lambda fn: F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + fn(i.cast("double")))
    x = x.withColumns({"a1": total(lambda i: 1 / i), "a2": total(lambda i: 1 / (i * i))})
    n, a1, a2, s = F.col("m").cast("double"), F.col("a1"), F.col("a2"), F.col("sites").cast("double")
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1, c2 = b1 - 1 / a1, b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)
    var = c1 / a1 * s + c2 / (a1 * a1 + a2) * s * (s - 1)
    return x.select("chrom", F.col("bin_start").cast("long").alias("bin_start"), "sites", F.when((s >= 2) & (n >= 3) & (var > 0), (F.col("pi") - s / a1) / F.sqrt(F.when(var > 0, var))).alias("d"))


def singletons(gt: DataFrame) -> DataFrame:
    """(site, allele, kind, sample): S for an allele seen once, D for one seen twice in one homozygous sample; the reference allele too."""
    each = gt.select(*SITE, "sample", F.explode(F.array("a1", "a2")).alias("allele")).filter("allele is not null")
    by = each.groupBy(*SITE, "allele").agg(F.count("*").alias("k"), F.count_distinct("sample").alias("carriers"), F.min("sample").alias("sample"))
    kind = F.when(F.col("k") == 1, "S").when((F.col("k") == 2) & (F.col("carriers") == 1), "D")
    return by.withColumn("kind", kind).filter("kind is not null").select(*SITE, "allele", "kind", "sample")


def weir_cockerham(gt: DataFrame, populations: DataFrame) -> DataFrame:
    """(site, a, abc, fst) with populations (sample, pop): variance components summed over alleles; undefined terms are left out."""
    x = gt.filter(_diploid()).join(F.broadcast(populations), "sample")
    alleles = x.select(*SITE, F.explode(F.array("a1", "a2")).alias("allele")).distinct()
    # Homozygotes and heterozygotes of each allele in each population; populations without the allele count with zeros.
    sizes = x.groupBy(*SITE, "pop").agg(F.count("*").cast("double").alias("n"))
    het = x.filter("a1 <> a2").select(*SITE, "pop", F.explode(F.array("a1", "a2")).alias("allele")).groupBy(*SITE, "pop", "allele").agg(F.count("*").alias("het"))
    hom = x.filter("a1 = a2").groupBy(*SITE, "pop", F.col("a1").alias("allele")).agg(F.count("*").alias("hom"))
    t = alleles.join(sizes, SITE).join(het, [*SITE, "pop", "allele"], "left").join(hom, [*SITE, "pop", "allele"], "left").fillna(0, ["het", "hom"])
    t = t.withColumn("p", (F.col("het") + 2 * F.col("hom")) / (2 * F.col("n")))
    by = t.groupBy(*SITE, "allele").agg(F.count("*").cast("double").alias("r"), F.sum("n").alias("sn"), F.sum(F.col("n") * F.col("n")).alias("sn2"), F.sum(F.col("n") * F.col("p")).alias("snp"), F.sum(F.col("n") * F.col("p") * F.col("p")).alias("snp2"), F.sum("het").cast("double").alias("sh"))
    r, nbar = F.col("r"), F.col("sn") / F.col("r")
    pbar, hbar = F.col("snp") / F.col("sn"), F.col("sh") / F.col("sn")
    div = lambda x, y: x / F.nullif(y, F.lit(0.0))
    nc = div(F.col("sn") - F.col("sn2") / F.col("sn"), r - 1)
    s2 = div(F.col("snp2") - F.col("sn") * pbar * pbar, (r - 1) * nbar)
    core = pbar * (1 - pbar) - (r - 1) * s2 / r
    a = div(nbar, nc) * (s2 - div(core - hbar / 4, nbar - 1))
    b = div(nbar, nbar - 1) * (core - hbar * (2 * nbar - 1) / (4 * nbar))
    y = by.withColumns({"a": a, "abc": a + b + hbar / 2}).filter("a is not null and abc is not null")
    return y.groupBy(*SITE).agg(F.sum("a").alias("a"), F.sum("abc").alias("abc")).withColumn("fst", F.col("a") / F.nullif("abc", F.lit(0.0)))


def windowed_fst(fst: DataFrame, width: int) -> DataFrame:
    """(chrom, bin_start, sites, weighted, mean) of per-site components; sites without a value are left out."""
    x = fst.filter("fst is not null").withColumn("bin_start", F.floor((F.col("pos") - 1) / width) * width + 1)
    return x.groupBy("chrom", "bin_start").agg(F.count("*").alias("sites"), (F.sum("a") / F.sum("abc")).alias("weighted"), F.avg("fst").alias("mean"))


def linkage(gt: DataFrame, max_bp: int, min_r2: float | None = None) -> DataFrame:
    """(chrom, pos1, pos2, n, r2) of genotype dosages for pairs of sites at most ``max_bp`` apart.

    Sites are joined by blocks of ``max_bp`` positions, each with its own and the next block.
    """
    x = gt.filter(_diploid()).select("chrom", "pos", "sample", _dosage().cast("double").alias("g")).withColumn("block", F.floor(F.col("pos") / max_bp))
    left = x.select("chrom", "sample", F.col("pos").alias("pos1"), F.col("g").alias("g1"), F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    right = x.select("chrom", "sample", "block", F.col("pos").alias("pos2"), F.col("g").alias("g2"))
    pairs = left.join(right, ["chrom", "sample", "block"]).filter((F.col("pos1") < F.col("pos2")) & (F.col("pos2") - F.col("pos1") <= max_bp))
    s = pairs.groupBy("chrom", "pos1", "pos2").agg(F.count("*").alias("n"), F.sum("g1").alias("x"), F.sum("g2").alias("y"), F.sum(F.col("g1") * F.col("g1")).alias("xx"), F.sum(F.col("g2") * F.col("g2")).alias("yy"), F.sum(F.col("g1") * F.col("g2")).alias("xy"))
    n = F.col("n")
    cov, vx, vy = F.col("xy") / n - F.col("x") * F.col("y") / (n * n), F.col("xx") / n - F.col("x") * F.col("x") / (n * n), F.col("yy") / n - F.col("y") * F.col("y") / (n * n)
    out = s.filter((n >= 2) & (vx > 1e-12) & (vy > 1e-12)).select("chrom", "pos1", "pos2", "n", (cov * cov / (vx * vy)).alias("r2"))
    return out.filter(F.col("r2") >= min_r2) if min_r2 is not None else out


def haplotype_linkage(gt: DataFrame, max_bp: int) -> DataFrame:
    """(chrom, pos1, pos2, n, r2, d, d_prime) of phased alleles, from the frequencies of allele 0."""
    x = gt.filter(_diploid()).select("chrom", "pos", "sample", F.posexplode(F.array("a1", "a2")).alias("phase", "a")).withColumn("block", F.floor(F.col("pos") / max_bp))
    left = x.select("chrom", "sample", "phase", F.col("pos").alias("pos1"), (F.col("a") == 0).cast("double").alias("x"), F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    right = x.select("chrom", "sample", "phase", "block", F.col("pos").alias("pos2"), (F.col("a") == 0).cast("double").alias("y"))
    pairs = left.join(right, ["chrom", "sample", "phase", "block"]).filter((F.col("pos1") < F.col("pos2")) & (F.col("pos2") - F.col("pos1") <= max_bp))
    s = pairs.groupBy("chrom", "pos1", "pos2").agg(F.count("*").alias("n"), F.avg("x").alias("pa"), F.avg("y").alias("pb"), F.avg(F.col("x") * F.col("y")).alias("pab"))
    pa, pb = F.col("pa"), F.col("pb")
    s = s.withColumn("d", F.col("pab") - pa * pb).filter((pa > 0) & (pa < 1) & (pb > 0) & (pb < 1))
    d = F.col("d")
    dmax = F.when(d >= 0, F.least(pa * (1 - pb), (1 - pa) * pb)).otherwise(F.least(pa * pb, (1 - pa) * (1 - pb)))
    return s.select("chrom", "pos1", "pos2", "n", (d * d / ((pa - pa * pa) * (pb - pb * pb))).alias("r2"), "d", (d / F.nullif(dmax, F.lit(0.0))).alias("d_prime"))


def relatedness(gt: DataFrame) -> DataFrame:
    """(s1, s2, a_jk) for s1 <= s2 over polymorphic sites, joined by site."""
    c = site_counts(gt).filter("alt > 0 and alt < n").select(*SITE, (F.col("alt") / F.col("n")).alias("p"))
    x = gt.filter(_diploid()).join(c, SITE).select(*SITE, "sample", "p", _dosage().cast("double").alias("g"))
    y = x.select(*SITE, F.col("sample").alias("s2"), F.col("g").alias("g2"))
    pairs = x.withColumnRenamed("sample", "s1").join(y, SITE).filter("s1 <= s2")
    p, g, h = F.col("p"), F.col("g"), F.col("g2")
    own = 1 + (g * g - (1 + 2 * p) * g + 2 * p * p) / (2 * p * (1 - p))
    other = (g - 2 * p) * (h - 2 * p) / (2 * p * (1 - p))
    return pairs.groupBy("s1", "s2").agg(F.count("*").alias("sites"), F.avg(F.when(F.col("s1") == F.col("s2"), own).otherwise(other)).alias("a_jk"))


def kinship(gt: DataFrame) -> DataFrame:
    """(s1, s2, phi) of all ordered pairs: (both heterozygous - 2 opposite homozygotes) / (sum of heterozygous sites)."""
    x = gt.filter(_diploid()).select(*SITE, "sample", _dosage().alias("g"))
    y = x.select(*SITE, F.col("sample").alias("s2"), F.col("g").alias("g2"))
    pairs = x.withColumnRenamed("sample", "s1").join(y, SITE)
    s = pairs.groupBy("s1", "s2").agg(F.count_if((F.col("g") == 1) & (F.col("g2") == 1)).alias("hh"), F.count_if(F.abs(F.col("g") - F.col("g2")) == 2).alias("opp"), F.count_if(F.col("g") == 1).alias("h1"), F.count_if(F.col("g2") == 1).alias("h2"))
    return s.withColumn("phi", (F.col("hh") - 2 * F.col("opp")) / F.nullif(F.col("h1") + F.col("h2"), F.lit(0)))


def density(gt: DataFrame, width: int) -> DataFrame:
    """(chrom, bin_start, sites, per_kb), bins from the first with a site to the last, empty ones too."""
    by = gt.select(*SITE).distinct().groupBy("chrom", F.floor(F.col("pos") / width).alias("bin")).agg(F.count("*").alias("sites"))
    every = by.groupBy("chrom").agg(F.explode(F.sequence(F.min("bin"), F.max("bin"))).alias("bin"))
    return every.join(by, ["chrom", "bin"], "left").select("chrom", (F.col("bin") * width).alias("bin_start"), F.coalesce("sites", F.lit(0)).alias("sites"), (F.coalesce("sites", F.lit(0)) * 1000.0 / width).alias("per_kb"))


def burden(gt: DataFrame) -> DataFrame:
    """(sample, hom_ref, het, hom_alt, missing)."""
    ok, het = _diploid(), F.col("a1") != F.col("a2")
    return gt.groupBy("sample").agg(F.count_if(ok & ~het & (F.col("a1") == 0)).alias("hom_ref"), F.count_if(ok & het).alias("het"), F.count_if(ok & ~het & (F.col("a1") > 0)).alias("hom_alt"), F.count_if(~ok).alias("missing"))


def transitions(variants: DataFrame, width: int) -> DataFrame:
    """(chrom, bin_start, ts, tv, ratio) of biallelic base changes (chrom, pos, ref, alt); bins are dense from 0; ratio 0 without transversions."""
    pair = F.concat("ref", "alt")
    x = variants.filter(F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$") & (F.col("ref") != F.col("alt"))).withColumns({"bin": F.floor(F.col("pos") / width), "is_ts": pair.isin("AG", "GA", "CT", "TC")})
    by = x.groupBy("chrom", "bin").agg(F.count_if("is_ts").alias("ts"), F.count_if(~F.col("is_ts")).alias("tv"))
    every = by.groupBy("chrom").agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("bin"))).alias("bin"))
    ts, tv = F.coalesce("ts", F.lit(0)), F.coalesce("tv", F.lit(0))
    return every.join(by, ["chrom", "bin"], "left").select("chrom", (F.col("bin") * width).alias("bin_start"), ts.alias("ts"), tv.alias("tv"), F.when(tv > 0, ts / tv).otherwise(0.0).alias("ratio"))


def mendel_errors(gt: DataFrame, trios: DataFrame) -> DataFrame:
    """(site, child, father, mother) where the child's alleles cannot come one from each parent; trios: (child, father, mother)."""
    g = gt.filter(_diploid())
    one = lambda who: g.select(*SITE, F.col("sample").alias(who), F.col("a1").alias(f"{who}1"), F.col("a2").alias(f"{who}2"))
    x = one("child").join(F.broadcast(trios), "child").join(one("father"), [*SITE, "father"]).join(one("mother"), [*SITE, "mother"])
    from_ = lambda c, who: (F.col(c) == F.col(f"{who}1")) | (F.col(c) == F.col(f"{who}2"))
    ok = from_("child1", "father") & from_("child2", "mother") | from_("child2", "father") & from_("child1", "mother")
    return x.filter(~ok).select(*SITE, "child", "father", "mother")


def compare_sites(a: DataFrame, b: DataFrame) -> DataFrame:
    """(site, in_a, in_b) of two genotype sets."""
    x = a.select(*SITE).distinct().withColumn("in_a", F.lit(True))
    return x.join(b.select(*SITE).distinct().withColumn("in_b", F.lit(True)), SITE, "full").select(*SITE, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def discordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sample, shared, discordant) of genotypes called in both sets, unordered alleles compared."""
    key = lambda: F.struct(F.least("a1", "a2").alias("lo"), F.greatest("a1", "a2").alias("hi"))
    x = a.filter(_diploid()).select(*SITE, "sample", key().alias("x"))
    y = b.filter(_diploid()).select(*SITE, "sample", key().alias("y"))
    return x.join(y, [*SITE, "sample"]).groupBy("sample").agg(F.count("*").alias("shared"), F.count_if(F.col("x") != F.col("y")).alias("discordant"))


def principal_components(gt: DataFrame, k: int = 2) -> DataFrame:
    """(sample, component, value): eigenvectors of the samples' covariance of standardised dosages.

    The covariance is summed by site in Spark; only the samples' square matrix comes to the driver.
    """
    import numpy as np

    r = relatedness_matrix(gt)
    spark = gt.sparkSession
    names = sorted({x["s1"] for x in r} | {x["s2"] for x in r})
    at = {s: i for i, s in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for x in r:
        m[at[x["s1"]], at[x["s2"]]] = m[at[x["s2"]], at[x["s1"]]] = x["c"]
    if not names:
        return spark.createDataFrame([], "sample string, component int, value double")
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values)[:k]
    out = []
    for c, j in enumerate(order):
        v = vectors[:, j] * (1 if vectors[np.argmax(np.abs(vectors[:, j])), j] > 0 else -1)
        out += [(s, c + 1, float(v[i])) for i, s in enumerate(names)]
    return spark.createDataFrame(out, f"sample {gt.schema['sample'].dataType.simpleString()}, component int, value double")


def relatedness_matrix(gt: DataFrame) -> list:
    """Rows (s1, s2, c) of the samples' covariance; one row for each pair of samples."""
    c = site_counts(gt).filter("alt > 0 and alt < n").select(*SITE, (F.col("alt") / F.col("n")).alias("p"))
    p = F.col("p")
    x = gt.filter(_diploid()).join(c, SITE).select(*SITE, "sample", ((_dosage() - 2 * p) / F.sqrt(2 * p * (1 - p))).alias("z"))
    y = x.select(*SITE, F.col("sample").alias("s2"), F.col("z").alias("z2"))
    return x.withColumnRenamed("sample", "s1").join(y, SITE).filter("s1 <= s2").groupBy("s1", "s2").agg(F.avg(F.col("z") * F.col("z2")).alias("c")).collect()
