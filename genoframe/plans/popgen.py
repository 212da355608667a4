"""Population-genetics queries over the genotype view, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import popgen as P
from .views import genotypes, gt_sql, table

_r = lambda c, n=6: F.round(F.col(c).cast("double"), n).alias(c)


def frequencies(spark, d):
    return P.allele_frequencies(genotypes(spark, d)).select("chrom", "pos", "allele", "count", "n", _r("frequency"))


def site_depth(spark, d):
    return P.site_depth(genotypes(spark, d)).select("chrom", "pos", "sum_depth", _r("mean_depth"), _r("var_depth"))


def sample_depth(spark, d):
    return P.sample_depth(genotypes(spark, d)).select("sample", "sites", _r("mean_depth"))


def missing_samples(spark, d):
    return P.missing_by_sample(genotypes(spark, d)).select("sample", "n", "missing", _r("fraction"))


def missing_sites(spark, d):
    return P.missing_by_site(genotypes(spark, d)).select("chrom", "pos", "n", "missing", _r("fraction"))


def hardy_chi2(spark, d):
    return P.hardy(genotypes(spark, d)).select("chrom", "pos", "hom_ref", "het", "hom_alt", _r("e_hom_ref"), _r("e_het"), _r("e_hom_alt"), _r("chi2"))


def hardy_exact(spark, d):
    return P.hardy(genotypes(spark, d)).select("chrom", "pos", _r("p", 9), _r("p_deficit", 9), _r("p_excess", 9))


def heterozygosity(spark, d):
    return P.heterozygosity(genotypes(spark, d)).select("sample", "observed", _r("expected", 4), "sites", _r("f"))


def site_pi(spark, d):
    return P.site_pi(genotypes(spark, d)).select("chrom", "pos", _r("pi"))


def window_pi(spark, d):
    return P.window_pi(genotypes(spark, d), 200, 100).select("chrom", "bin_start", "bin_end", "variants", _r("pi", 9))


def tajima_d(spark, d):
    return P.tajima_d(genotypes(spark, d), 200).select("chrom", "bin_start", "sites", _r("d", 5))


def singletons(spark, d):
    return P.singletons(genotypes(spark, d))


def _pops(spark):
    return spark.range(12).select(F.col("id").cast("int").alias("sample"), (F.col("id") < 6).cast("int").alias("pop"))


def fst(spark, d):
    return P.weir_cockerham(genotypes(spark, d), _pops(spark)).select("chrom", "pos", _r("a"), _r("abc"), _r("fst", 5))


def fst_windows(spark, d):
    return P.windowed_fst(P.weir_cockerham(genotypes(spark, d), _pops(spark)), 500).select("chrom", "bin_start", "sites", _r("weighted", 5), _r("mean", 5))


def linkage(spark, d):
    return P.linkage(genotypes(spark, d), 60).select("chrom", "pos1", "pos2", "n", _r("r2", 12))


def haplotype_linkage(spark, d):
    return P.haplotype_linkage(genotypes(spark, d), 40).select("chrom", "pos1", "pos2", "n", _r("r2", 12), _r("d"), _r("d_prime", 5))


def relatedness(spark, d):
    return P.relatedness(genotypes(spark, d)).select("s1", "s2", "sites", _r("a_jk", 5))


def kinship(spark, d):
    return P.kinship(genotypes(spark, d)).select("s1", "s2", "hh", "opp", _r("phi"))


def snp_density(spark, d):
    return P.density(genotypes(spark, d), 150).select("chrom", "bin_start", "sites", _r("per_kb", 4))


def burden(spark, d):
    return P.burden(genotypes(spark, d))


def _variants(spark, d):
    """Parts as base changes: chrom, pos, ref, alt."""
    base = lambda c: F.expr(f"substring('ACGT', CAST({c} % 4 + 1 AS INT), 1)")
    return table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_size") % 20).alias("chrom"), F.col("p_partkey").alias("pos"), base("p_size").alias("ref"), base("p_partkey").alias("alt"))


def transitions(spark, d):
    return P.transitions(_variants(spark, d), 100).select("chrom", "bin_start", "ts", "tv", _r("ratio"))


def mendel_errors(spark, d):
    trios = spark.createDataFrame([(0, 1, 2), (3, 4, 5), (6, 7, 8)], "child int, father int, mother int")
    return P.mendel_errors(genotypes(spark, d), trios)


def _halves(spark, d):
    g = genotypes(spark, d)
    return g.filter("pos % 3 <> 0"), g.filter("pos % 3 <> 1").withColumn("a2", F.when(F.col("gq") > 50, 1 - F.col("a2")).otherwise(F.col("a2")))


def compare_sites(spark, d):
    return P.compare_sites(*_halves(spark, d))


def discordance(spark, d):
    return P.discordance(*_halves(spark, d))


def pca(spark, d):
    return P.principal_components(genotypes(spark, d))


_C = """c AS (SELECT chrom, pos, count(*) AS samples, count(a1) AS called, 2 * count(a1) AS n, coalesce(sum(a1 + a2), 0)::BIGINT AS alt,
  count(*) FILTER (a1 <> a2) AS het, count(*) FILTER (a1 = 0 AND a2 = 0) AS hom_ref, count(*) FILTER (a1 = 1 AND a2 = 1) AS hom_alt FROM v GROUP BY chrom, pos)"""
_AL = "al AS (SELECT chrom, pos, sample, unnest([a1, a2]) AS allele FROM v WHERE a1 IS NOT NULL)"
_POP = "pop AS (SELECT *, CASE WHEN sample < 6 THEN 1 ELSE 0 END AS pop FROM v WHERE a1 IS NOT NULL)"
_FST = """t AS (SELECT s.chrom, s.pos, s.allele, p.pop, p.n::DOUBLE AS n, p.het, (p.het + 2.0 * CASE s.allele WHEN 0 THEN p.h0 ELSE p.h1 END) / (2.0 * p.n) AS p
  FROM (SELECT DISTINCT chrom, pos, allele FROM al) s
  JOIN (SELECT chrom, pos, pop, count(*) AS n, count(*) FILTER (a1 <> a2) AS het, count(*) FILTER (a1 = 0 AND a2 = 0) AS h0, count(*) FILTER (a1 = 1 AND a2 = 1) AS h1 FROM pop GROUP BY ALL) p USING (chrom, pos)),
u AS (SELECT chrom, pos, allele, count(*)::DOUBLE AS r, sum(n) AS sn, sum(n) / count(*) AS nb, sum(n * n) AS sn2, sum(n * p) / sum(n) AS pb, sum(n * p * p) AS snp2, sum(het) / sum(n) AS hb FROM t GROUP BY ALL),
w AS (SELECT *, (sn - sn2 / sn) / nullif(r - 1, 0) AS nc, (snp2 - sn * pb * pb) / nullif((r - 1) * nb, 0) AS s2 FROM u),
x AS (SELECT *, nb / nullif(nc, 0) * (s2 - (pb * (1 - pb) - (r - 1) * s2 / r - hb / 4) / nullif(nb - 1, 0)) AS a,
  nb / nullif(nb - 1, 0) * (pb * (1 - pb) - (r - 1) * s2 / r - hb * (2 * nb - 1) / (4 * nb)) AS b FROM w),
f AS (SELECT chrom, pos, sum(a) AS a, sum(a + b + hb / 2) AS abc, sum(a) / nullif(sum(a + b + hb / 2), 0) AS fst FROM x WHERE a IS NOT NULL AND a + b + hb / 2 IS NOT NULL GROUP BY ALL)"""
_BIN = """bn AS (SELECT chrom, ((pos - 1) // 200) * 200 AS bin_start, n, 2.0 * alt * (n - alt) / (n * (n - 1)) AS pi FROM c WHERE alt > 0 AND alt < n),
md AS (SELECT chrom, bin_start, arg_max(n, [k, n]) AS m FROM (SELECT chrom, bin_start, n, count(*) AS k FROM bn GROUP BY ALL) GROUP BY ALL),
tj AS (SELECT chrom, bin_start, count(*) AS sites, count(*)::DOUBLE AS s, sum(pi) AS pi, any_value(m)::DOUBLE AS n,
  list_sum([1.0::DOUBLE / i for i in range(1, any_value(m))]) AS a1, list_sum([1.0::DOUBLE / (i * i) for i in range(1, any_value(m))]) AS a2 FROM bn JOIN md USING (chrom, bin_start) GROUP BY ALL),
tk AS (SELECT *, (n + 1) / (3 * (n - 1)) - 1 / a1 AS c1, 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1) AS c2 FROM tj),
tl AS (SELECT *, c1 / a1 * s + c2 / (a1 * a1 + a2) * s * (s - 1) AS var FROM tk)"""
_LD = """ld AS (SELECT x.chrom, x.pos AS pos1, y.pos AS pos2, x.a1 + x.a2 AS g, y.a1 + y.a2 AS h FROM v x JOIN v y ON x.chrom = y.chrom AND x.sample = y.sample AND x.pos < y.pos AND y.pos - x.pos <= 60
  WHERE x.a1 IS NOT NULL AND y.a1 IS NOT NULL)"""
_HAP = """hp AS (SELECT chrom, pos, sample, 0 AS ph, a1 AS a FROM v WHERE a1 IS NOT NULL UNION ALL SELECT chrom, pos, sample, 1, a2 FROM v WHERE a1 IS NOT NULL),
hh AS (SELECT x.chrom, x.pos AS pos1, y.pos AS pos2, count(*) AS n, avg(CAST(x.a = 0 AS INT)) AS pa, avg(CAST(y.a = 0 AS INT)) AS pb, avg(CAST(x.a = 0 AND y.a = 0 AS INT)) AS pab
  FROM hp x JOIN hp y ON x.chrom = y.chrom AND x.sample = y.sample AND x.ph = y.ph AND x.pos < y.pos AND y.pos - x.pos <= 40 GROUP BY ALL),
hd AS (SELECT *, pab - pa * pb AS d FROM hh WHERE pa > 0 AND pa < 1 AND pb > 0 AND pb < 1)"""
_TWO = """ga AS (SELECT * FROM v WHERE pos % 3 <> 0), gb AS (SELECT chrom, pos, sample, a1, CASE WHEN gq > 50 THEN 1 - a2 ELSE a2 END AS a2 FROM v WHERE pos % 3 <> 1)"""
_TS = "vr AS (SELECT 'p' || (p_size % 20) AS chrom, p_partkey AS pos, substring('ACGT', p_size % 4 + 1, 1) AS ref, substring('ACGT', p_partkey % 4 + 1, 1) AS alt FROM part)"

QUERIES = {
    "allele_frequencies": (frequencies, gt_sql("""SELECT chrom, pos, allele, count(*) AS count, sum(count(*)) OVER (PARTITION BY chrom, pos)::BIGINT AS n,
      round(count(*) / sum(count(*)) OVER (PARTITION BY chrom, pos), 6) AS frequency FROM al GROUP BY chrom, pos, allele""", _AL)),
    "site_depth": (site_depth, gt_sql("SELECT chrom, pos, sum(dp)::BIGINT AS sum_depth, round(avg(dp), 6) AS mean_depth, round(var_samp(dp), 6) AS var_depth FROM v GROUP BY chrom, pos")),
    "sample_depth": (sample_depth, gt_sql("SELECT sample, count(dp) AS sites, round(avg(dp), 6) AS mean_depth FROM v GROUP BY sample")),
    "missing_samples": (missing_samples, gt_sql("SELECT sample, count(*) AS n, count(*) - count(a1) AS missing, round((count(*) - count(a1)) / count(*), 6) AS fraction FROM v GROUP BY sample")),
    "missing_sites": (missing_sites, gt_sql("SELECT chrom, pos, count(*) AS n, count(*) - count(a1) AS missing, round((count(*) - count(a1)) / count(*), 6) AS fraction FROM v GROUP BY chrom, pos")),
    "hardy_chi2": (hardy_chi2, gt_sql("""SELECT chrom, pos, hom_ref, het, hom_alt, round(e1, 6) AS e_hom_ref, round(e2, 6) AS e_het, round(e3, 6) AS e_hom_alt,
      round(CASE WHEN e1 > 0 THEN (hom_ref - e1) ** 2 / e1 ELSE 0 END + CASE WHEN e2 > 0 THEN (het - e2) ** 2 / e2 ELSE 0 END + CASE WHEN e3 > 0 THEN (hom_alt - e3) ** 2 / e3 ELSE 0 END, 6) AS chi2
      FROM (SELECT *, p * p * called AS e1, 2 * p * (1 - p) * called AS e2, (1 - p) * (1 - p) * called AS e3 FROM (SELECT *, (n - alt) / n AS p FROM c WHERE called > 0))""", _C)),
    "hardy_exact": (hardy_exact, gt_sql("""SELECT chrom, pos, round(least(1, sum(w) FILTER (w <= own * (1 + 1e-9)) / sum(w)), 9) AS p, round(least(1, sum(w) FILTER (h <= het) / sum(w)), 9) AS p_deficit,
      round(least(1, sum(w) FILTER (h >= het) / sum(w)), 9) AS p_excess FROM (SELECT *, max(w) FILTER (h = het) OVER (PARTITION BY chrom, pos) AS own FROM (
        SELECT *, exp(x - max(x) OVER (PARTITION BY chrom, pos)) AS w FROM (SELECT *, h * ln(2) - lgamma(h + 1) - lgamma((rare - h) // 2 + 1) - lgamma(called - (rare + h) // 2 + 1) AS x FROM (
          SELECT *, 2 * least(hom_ref, hom_alt) + het AS rare, unnest(range((2 * least(hom_ref, hom_alt) + het) % 2, 2 * least(hom_ref, hom_alt) + het + 1, 2)) AS h FROM c WHERE called > 0)))) GROUP BY chrom, pos""", _C)),
    "heterozygosity": (heterozygosity, gt_sql("""SELECT sample, observed, round(expected, 4) AS expected, sites, round((observed - expected) / (sites - expected), 6) AS f FROM (
      SELECT sample, count(*) FILTER (a1 = a2) AS observed, sum(e) AS expected, count(*) AS sites FROM v JOIN (
        SELECT chrom, pos, 1 - 2 * (alt / n) * (1 - alt / n) * n / (n - 1) AS e FROM c WHERE alt > 0 AND alt < n) USING (chrom, pos) WHERE a1 IS NOT NULL GROUP BY sample)""", _C)),
    "site_pi": (site_pi, gt_sql("SELECT chrom, pos, round(2.0 * alt * (n - alt) / (n * (n - 1)), 6) AS pi FROM c WHERE n >= 2", _C)),
    "window_pi": (window_pi, gt_sql("""SELECT chrom, idx * 100 + 1 AS bin_start, idx * 100 + 200 AS bin_end, count(*) AS variants,
      round(sum(2 * alt * (n - alt)) / (sum(n * (n - 1)) + (200 - count(*)) * any_value(k) * (any_value(k) - 1)), 9) AS pi FROM (
        SELECT *, (SELECT 2 * count(DISTINCT sample) FROM v) AS k, unnest(range(greatest(0, CAST(ceil((pos - 200) / 100) AS BIGINT)), CAST(ceil(pos / 100) AS BIGINT))) AS idx FROM c WHERE alt > 0 AND alt < n) GROUP BY chrom, idx""", _C)),
    "tajima_d": (tajima_d, gt_sql("""SELECT chrom, bin_start, sites, round(CASE WHEN s >= 2 AND n >= 3 AND var > 0 THEN (pi - s / a1) / sqrt(CASE WHEN var > 0 THEN var END) END, 5) AS d FROM tl""", _C, _BIN)),
    "singletons": (singletons, gt_sql("""SELECT chrom, pos, allele, CASE WHEN count(*) = 1 THEN 'S' ELSE 'D' END AS kind, min(sample) AS sample FROM al GROUP BY chrom, pos, allele
      HAVING count(*) = 1 OR count(*) = 2 AND count(DISTINCT sample) = 1""", _AL)),
    "weir_cockerham_fst": (fst, gt_sql("SELECT chrom, pos, round(a, 6) AS a, round(abc, 6) AS abc, round(fst, 5) AS fst FROM f", _AL, _POP, _FST)),
    "fst_windows": (fst_windows, gt_sql("""SELECT chrom, ((pos - 1) // 500) * 500 + 1 AS bin_start, count(*) AS sites, round(sum(a) / sum(abc), 5) AS weighted, round(avg(fst), 5) AS mean
      FROM f WHERE fst IS NOT NULL GROUP BY ALL""", _AL, _POP, _FST)),
    "linkage_r2": (linkage, gt_sql("""SELECT chrom, pos1, pos2, n, round(cov * cov / (vx * vy), 12) AS r2 FROM (
      SELECT chrom, pos1, pos2, count(*) AS n, covar_pop(g, h) AS cov, var_pop(g) AS vx, var_pop(h) AS vy FROM ld GROUP BY ALL) WHERE n >= 2 AND vx > 1e-12 AND vy > 1e-12""", _LD)),
    "haplotype_linkage": (haplotype_linkage, gt_sql("""SELECT chrom, pos1, pos2, n, round(d * d / ((pa - pa * pa) * (pb - pb * pb)), 12) AS r2, round(d, 6) AS d,
      round(d / nullif(CASE WHEN d >= 0 THEN least(pa * (1 - pb), (1 - pa) * pb) ELSE least(pa * pb, (1 - pa) * (1 - pb)) END, 0), 5) AS d_prime FROM hd""", _HAP)),
    "relatedness": (relatedness, gt_sql("""SELECT s1, s2, count(*) AS sites, round(avg(CASE WHEN s1 = s2 THEN 1 + (g * g - (1 + 2 * p) * g + 2 * p * p) / (2 * p * (1 - p)) ELSE (g - 2 * p) * (h - 2 * p) / (2 * p * (1 - p)) END), 5) AS a_jk
      FROM (SELECT x.sample AS s1, y.sample AS s2, x.a1 + x.a2 AS g, y.a1 + y.a2 AS h, alt / n AS p FROM v x JOIN v y USING (chrom, pos) JOIN c USING (chrom, pos)
        WHERE x.sample <= y.sample AND x.a1 IS NOT NULL AND y.a1 IS NOT NULL AND alt > 0 AND alt < n) GROUP BY s1, s2""", _C)),
    "kinship": (kinship, gt_sql("""SELECT s1, s2, hh, opp, round((hh - 2 * opp) / nullif(h1 + h2, 0), 6) AS phi FROM (
      SELECT x.sample AS s1, y.sample AS s2, count(*) FILTER (x.a1 <> x.a2 AND y.a1 <> y.a2) AS hh, count(*) FILTER (abs(x.a1 + x.a2 - y.a1 - y.a2) = 2) AS opp,
        count(*) FILTER (x.a1 <> x.a2) AS h1, count(*) FILTER (y.a1 <> y.a2) AS h2 FROM v x JOIN v y USING (chrom, pos) WHERE x.a1 IS NOT NULL AND y.a1 IS NOT NULL GROUP BY s1, s2)""")),
    "snp_density": (snp_density, gt_sql("""SELECT chrom, bin * 150 AS bin_start, coalesce(sites, 0) AS sites, round(coalesce(sites, 0) * 1000.0 / 150, 4) AS per_kb FROM (
      SELECT chrom, unnest(range(min(pos // 150), max(pos // 150) + 1)) AS bin FROM c GROUP BY chrom) LEFT JOIN (SELECT chrom, pos // 150 AS bin, count(*) AS sites FROM c GROUP BY ALL) USING (chrom, bin)""", _C)),
    "individual_burden": (burden, gt_sql("""SELECT sample, count(*) FILTER (a1 = 0 AND a2 = 0) AS hom_ref, count(*) FILTER (a1 <> a2) AS het, count(*) FILTER (a1 = 1 AND a2 = 1) AS hom_alt,
      count(*) - count(a1) AS missing FROM v GROUP BY sample""")),
    "transitions": (transitions, gt_sql("""SELECT chrom, bin * 100 AS bin_start, coalesce(ts, 0) AS ts, coalesce(tv, 0) AS tv, round(CASE WHEN tv > 0 THEN ts / tv ELSE 0 END, 6) AS ratio FROM (
      SELECT chrom, unnest(range(0, max(pos // 100) + 1)) AS bin FROM vr WHERE ref <> alt GROUP BY chrom) LEFT JOIN (
      SELECT chrom, pos // 100 AS bin, count(*) FILTER (ref || alt IN ('AG', 'GA', 'CT', 'TC')) AS ts, count(*) FILTER (ref || alt NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv FROM vr WHERE ref <> alt GROUP BY ALL) USING (chrom, bin)""", _TS)),
    "mendel_errors": (mendel_errors, gt_sql("""SELECT chrom, pos, c.sample AS child, f.sample AS father, m.sample AS mother FROM v c JOIN v f USING (chrom, pos) JOIN v m USING (chrom, pos)
      WHERE (c.sample, f.sample, m.sample) IN ((0, 1, 2), (3, 4, 5), (6, 7, 8)) AND c.a1 IS NOT NULL AND f.a1 IS NOT NULL AND m.a1 IS NOT NULL
      AND NOT (c.a1 IN (f.a1, f.a2) AND c.a2 IN (m.a1, m.a2) OR c.a2 IN (f.a1, f.a2) AND c.a1 IN (m.a1, m.a2))""")),
    "compare_sites": (compare_sites, gt_sql("""SELECT chrom, pos, bool_or(k = 1) AS in_a, bool_or(k = 2) AS in_b FROM (SELECT chrom, pos, 1 AS k FROM ga UNION ALL SELECT chrom, pos, 2 FROM gb) GROUP BY chrom, pos""", _TWO)),
    "discordance": (discordance, gt_sql("""SELECT sample, count(*) AS shared, count(*) FILTER (least(x.a1, x.a2) <> least(y.a1, y.a2) OR greatest(x.a1, x.a2) <> greatest(y.a1, y.a2)) AS discordant
      FROM ga x JOIN gb y USING (chrom, pos, sample) WHERE x.a1 IS NOT NULL AND y.a1 IS NOT NULL GROUP BY sample""", _TWO)),
    "sample_components": (pca, None),
}
