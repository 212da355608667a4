"""Variant queries: parts as sites, their line items as genotypes; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import variant_filters as VF
from ..operators import variants as V
from .views import genotypes, gt_sql, table

_r = lambda c, n=6: F.round(F.col(c).cast("double"), n).alias(c)


def sites(spark, d):
    """Parts as variants without samples."""
    base = lambda e: F.expr(f"substring('ACGT', CAST(({e}) % 4 + 1 AS INT), 1)")
    first = F.when(F.col("p_partkey") % 5 == 0, F.concat(base("p_size"), base("p_partkey"))).otherwise(base("p_size + 1 + p_partkey % 3"))
    alt = F.when(F.col("p_partkey") % 7 == 0, F.array(first, F.concat(base("p_size"), F.lit("TT")))).otherwise(F.array(first))
    return table(spark, d, "part").select(
        F.concat(F.lit("p"), F.col("p_size") % 20).alias("chrom"), (F.col("p_partkey") + 1).alias("pos"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("rs"), F.col("p_partkey"))).alias("id"),
        base("p_size").alias("ref"), alt.alias("alt"), F.when(F.col("p_size") % 11 != 0, F.round("p_retailprice", 1)).alias("qual"),
        F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 2 == 0, F.array(F.lit("PASS"))).otherwise(F.array(F.lit("q10"), F.lit("s50"))).alias("filter"),
        F.map_filter(F.create_map(F.lit("DP"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_size").cast("string")), F.lit("BR"), F.col("p_brand"), F.lit("AFS"), F.concat((F.col("p_size") % 10).cast("string"), F.lit(","), (F.col("p_partkey") % 10).cast("string"))), lambda k, v: v.isNotNull()).alias("info"),
    )


def variants(spark, d):
    """The sites with their samples, in order of the sample number; sites without genotypes have an empty list."""
    g = genotypes(spark, d)
    gt = F.concat(F.coalesce(F.col("a1").cast("string"), F.lit(".")), F.when(F.col("dp") % 2 == 0, "|").otherwise("/"), F.coalesce(F.col("a2").cast("string"), F.lit(".")))
    data = F.map_filter(F.create_map(F.lit("DP"), F.col("dp").cast("string"), F.lit("GQ"), F.when(F.col("gq") > 10, F.col("gq").cast("string")), F.lit("AD"), F.concat(F.col("dp").cast("string"), F.lit(","), F.col("gq").cast("string"))), lambda k, v: v.isNotNull())
    one = F.struct(F.format_string("s%02d", "sample").alias("name"), gt.alias("gt"), data.alias("data"))
    lists = g.select("chrom", "pos", one.alias("s")).groupBy("chrom", "pos").agg(F.collect_list("s").alias("samples"))
    ordered = F.array_sort("samples", lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    empty = F.array().cast("array<struct<name:string,gt:string,data:map<string,string>>>")
    return sites(spark, d).join(lists, ["chrom", "pos"], "left").withColumn("samples", F.coalesce(ordered, empty))


def filter_sites(spark, d):
    return V.view(sites(spark, d).withColumn("samples", F.array()), 'QUAL>950 && INFO/DP!=5 && FILTER="PASS" || ID~"rs1.*7$"').select("chrom", "pos")


def filter_missing(spark, d):
    return V.view(sites(spark, d).withColumn("samples", F.array()), 'INFO/DP!=12 && !(INFO/AFS>7) && (REF="A" || N_ALT=2)').select("chrom", "pos")


def filter_samples(spark, d):
    return V.view(variants(spark, d), 'FMT/DP>45 && GT="het"').select("chrom", "pos")


def filter_quality(spark, d):
    return V.view(variants(spark, d), exclude='FMT/GQ!=50 || GT="mis"').select("chrom", "pos")


def query_lines(spark, d):
    return V.query(sites(spark, d).withColumn("samples", F.array()), r"%CHROM:%POS0\t%REF>%ALT\t%QUAL\t%FILTER\t%INFO/DP\t%ID")


def query_samples(spark, d):
    return V.query(variants(spark, d), r"%CHROM:%POS[ %SAMPLE=%GT/%DP]")


def soft_filter(spark, d):
    return V.soft_filter(sites(spark, d).withColumn("samples", F.array()), "INFO/DP<20", "LowDP").select("chrom", "pos", F.array_join("filter", ";").alias("filter"))


def counts(spark, d):
    return V.counts(variants(spark, d))


def transition_ratio(spark, d):
    return V.transition_ratio(sites(spark, d)).select("ts", "tv", "ts_first", "tv_first", _r("ratio"))


def indel_lengths(spark, d):
    return V.indel_lengths(sites(spark, d))


def allele_lengths(spark, d):
    return V.allele_lengths(sites(spark, d))


def split_alleles(spark, d):
    x = V.split_alleles(variants(spark, d), ("AFS",))
    return x.select("chrom", "pos", F.get("alt", F.lit(0)).alias("alt"), F.element_at("info", "AFS").alias("afs"), F.size(F.filter("samples", lambda s: s["gt"].contains("1"))).alias("carriers"))


def join_alleles(spark, d):
    one = sites(spark, d).withColumn("a", F.explode("alt")).withColumn("alt", F.array("a")).withColumn("pos", F.floor(F.col("pos") / 3))
    return V.join_alleles(one).select("chrom", "pos", "ref", F.array_join(F.array_sort("alt"), ",").alias("alt"), "n")


def fill_tags(spark, d):
    x = V.fill_tags(variants(spark, d))
    return x.select("chrom", "pos", F.col("an").cast("long").alias("an"), F.get("ac", F.lit(0)).cast("long").alias("ac"), F.round(F.get("af", F.lit(0)), 6).alias("af"), _r("maf"), F.col("ns").cast("long").alias("ns"), F.col("ac_het").cast("long").alias("ac_het"), F.col("ac_hom").cast("long").alias("ac_hom"))


def sample_statistics(spark, d):
    return V.sample_statistics(variants(spark, d))


def genotype_intersections(spark, d):
    return V.genotype_intersections(variants(spark, d))


def genotype_check(spark, d):
    return V.genotype_check(variants(spark, d))


def missing_to_reference(spark, d):
    x = V.missing_to_reference(variants(spark, d))
    return x.select("chrom", "pos", F.array_join(F.transform("samples", lambda s: s["gt"]), ",").alias("gts"))


def nearest_variant(spark, d):
    return V.distance_to_nearest(sites(spark, d)).select("chrom", "pos", "nearest")


def near_indels(spark, d):
    return V.indel_gap(sites(spark, d), 30).select("chrom", "pos", "near_indel")


def prune_windows(spark, d):
    return V.prune_windows(sites(spark, d), 100, 2).select("chrom", "pos")


def scatter(spark, d):
    return V.scatter(sites(spark, d), 25).select("chrom", "pos", "chunk")


def site_sets(spark, d):
    x = sites(spark, d)
    return V.intersection({"all": x, "named": x.filter("id IS NOT NULL"), "passed": x.filter(F.array_contains("filter", "PASS")), "scored": x.filter("qual IS NOT NULL")}, "all", least=2).select("chrom", "pos", F.array_join("sets", ",").alias("sets"), F.col("n").cast("int").alias("n"))


def merged_sets(spark, d):
    x = variants(spark, d)
    names = F.array(*[F.lit(f"s{k:02d}") for k in range(12)])

    def named(df, p):
        found = lambda n: F.get(F.filter("samples", lambda s: s["name"] == n), F.lit(0))
        return df.withColumn("samples", F.transform(names, lambda n: F.struct(F.concat(F.lit(p), n).alias("name"), F.coalesce(found(n)["gt"], F.lit("./.")).alias("gt"), found(n)["data"].alias("data"))))

    y = V.merge_sets(named(x, "x"), named(x.withColumn("alt", F.array(F.concat("ref", F.lit("G")), F.get("alt", F.lit(0)))), "y"))
    return y.select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), F.array_join(F.transform("samples", lambda s: F.concat(s["name"], F.lit("="), s["gt"])), " ").alias("gts"))


def annotate_sites(spark, d):
    t = table(spark, d, "lineitem").groupBy((F.col("l_partkey") + 1).alias("pos"), "l_returnflag").agg(F.count("*").alias("n"))
    x = V.annotate(sites(spark, d), t, {"FLAGS": "l_returnflag", "N": "n"}, on=("pos",), rule="append")
    return x.select("chrom", "pos", F.element_at("info", "FLAGS").alias("flags"), F.element_at("info", "DP").alias("dp"))


def trio_statistics(spark, d):
    return V.trio_statistics(variants(spark, d), "s00", "s01", "s02").select("sites", "errors", "tested", "transmitted")


def group_contrast(spark, d):
    x = V.contrast(variants(spark, d), ["s00", "s01", "s02"], ["s03", "s04", "s05"])
    return x.select("chrom", "pos", F.col("case_alt").cast("long").alias("case_alt"), F.col("control_alt").cast("long").alias("control_alt"), "novel", _r("p", 9))


def switch_rate(spark, d):
    return V.switch_rate(variants(spark, d), "s00", "s01", "s02")


def ploidy_runs(spark, d):
    return V.ploidy_runs(variants(spark, d))


def variant_keys(spark, d):
    return sites(spark, d).select("chrom", "pos", V.variant_key(F.concat(F.lit("chr"), F.substring("chrom", 2, 2)), F.col("pos"), F.col("ref"), F.get("alt", F.lit(0))).alias("key"))


def reference_blocks(spark, d):
    g = genotypes(spark, d).withColumn("chrom", F.lit("x"))
    return V.reference_blocks(g).select("sample", "chrom", "start", "end", F.col("band").cast("int").alias("band"), "least")


def site_bounds(spark, d):
    return VF.filter_sites(variants(spark, d), alleles_between=(2, 2), maf_between=(0.2, 0.5), call_rate=0.9, quality=905.0, indels=False).select("chrom", "pos")


def site_names(spark, d):
    named = table(spark, d, "part").filter("p_size <= 25").select(F.concat(F.lit("rs"), F.col("p_partkey")).alias("id"))
    return VF.filter_sites(variants(spark, d), ids=named, mac_between=(2, None), passed=True).select("chrom", "pos")


def allele_summary(spark, d):
    return VF.allele_summary(variants(spark, d)).select("chrom", "pos", "an", "ac", _r("maf"), _r("call_rate"))


def genotype_bounds(spark, d):
    x = VF.filter_genotypes(variants(spark, d), quality=30, depth=(10, 40))
    return VF.format_table(x, "GT").select("chrom", "pos", "sample", F.col("value").alias("gt"))


def sample_subset(spark, d):
    x = VF.select_samples(variants(spark, d), ["s01", "s04", "s07", "s10"], variable=True)
    return x.select("chrom", "pos", F.col("info")["AC"].alias("ac"), F.col("info")["AN"].alias("an"), F.array_join(F.transform("samples", lambda s: s["name"]), ",").alias("samples"))


def info_table(spark, d):
    return VF.info_table(sites(spark, d), ["DP", "AFS"]).withColumnsRenamed({"DP": "dp", "AFS": "afs"})


def format_table(spark, d):
    return VF.format_table(variants(spark, d), "GQ")


_B = "substring('ACGT', CAST(({0}) % 4 + 1 AS INT), 1)".format
_VS = f"""vs AS (SELECT 'p' || (p_size % 20) AS chrom, p_partkey + 1 AS pos, CASE WHEN p_partkey % 2 = 0 THEN 'rs' || p_partkey END AS id, {_B('p_size')} AS ref,
  CASE WHEN p_partkey % 5 = 0 THEN {_B('p_size')} || {_B('p_partkey')} ELSE {_B('p_size + 1 + p_partkey % 3')} END AS alt1,
  CASE WHEN p_partkey % 7 = 0 THEN {_B('p_size')} || 'TT' END AS alt2, CASE WHEN p_size % 11 <> 0 THEN round(p_retailprice, 1) END AS qual,
  CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'PASS' ELSE 'q10;s50' END AS filter, CASE WHEN p_partkey % 13 <> 0 THEN p_size END AS dp, p_size % 10 AS af1, p_partkey % 10 AS af2 FROM part)"""
_AL = "va AS (SELECT chrom, pos, ref, alt1 AS alt, af1 AS af, 1 AS k FROM vs UNION ALL SELECT chrom, pos, ref, alt2, af2, 2 FROM vs WHERE alt2 IS NOT NULL)"
_SG = """sg AS (SELECT v.*, 's' || lpad(sample::VARCHAR, 2, '0') AS name, coalesce(a1::VARCHAR, '.') || CASE WHEN dp % 2 = 0 THEN '|' ELSE '/' END || coalesce(a2::VARCHAR, '.') AS gt FROM v)"""


def _sql(body: str, *more: str) -> str:
    return gt_sql(body, _VS, _AL, _SG, *more)


_TRIO = """tr AS (SELECT c.chrom, c.pos, c.a1 AS c1, c.a2 AS c2, f.a1 AS f1, f.a2 AS f2, m.a1 AS m1, m.a2 AS m2, c.gt FROM sg c JOIN v f USING (chrom, pos) JOIN v m USING (chrom, pos)
  WHERE c.sample = 0 AND f.sample = 1 AND m.sample = 2 AND c.a1 IS NOT NULL AND f.a1 IS NOT NULL AND m.a1 IS NOT NULL),
tq AS (SELECT *, c1 IN (f1, f2) AND c2 IN (m1, m2) OR c2 IN (f1, f2) AND c1 IN (m1, m2) AS good, f1 <> f2 AND m1 + m2 = 0 OR m1 <> m2 AND f1 + f2 = 0 AS tested FROM tr)"""

QUERIES = {
    "filter_sites": (filter_sites, _sql("SELECT chrom, pos FROM vs WHERE coalesce(qual > 950, FALSE) AND (dp IS NULL OR dp <> 5) AND coalesce(filter = 'PASS', FALSE) OR coalesce(regexp_matches(id, 'rs1.*7$'), FALSE)")),
    "filter_missing": (filter_missing, _sql("SELECT chrom, pos FROM vs WHERE (dp IS NULL OR dp <> 12) AND NOT (af1 > 7 OR af2 > 7) AND (ref = 'A' OR alt2 IS NOT NULL)")),
    "filter_samples": (filter_samples, _sql("SELECT chrom, pos FROM v GROUP BY chrom, pos HAVING bool_or(dp > 45) AND bool_or(coalesce(a1 <> a2, FALSE))")),
    "filter_quality": (filter_quality, _sql("""SELECT chrom, pos FROM vs LEFT JOIN (SELECT chrom, pos, bool_or(gq <= 10 OR gq <> 50 OR a1 IS NULL) AS bad FROM v GROUP BY chrom, pos) USING (chrom, pos) WHERE NOT coalesce(bad, FALSE)""")),
    "query_lines": (query_lines, _sql("""SELECT chrom || ':' || (pos - 1) || chr(9) || ref || '>' || concat_ws(',', alt1, alt2) || chr(9) || coalesce(qual::VARCHAR, '.') || chr(9) || coalesce(filter, '.') || chr(9) || coalesce(dp::VARCHAR, '.') || chr(9) || coalesce(id, '.') AS line FROM vs""")),
    "query_samples": (query_samples, _sql("""SELECT vs.chrom || ':' || vs.pos || coalesce(string_agg(' ' || name || '=' || gt || '/' || sg.dp, '' ORDER BY name), '') AS line FROM vs LEFT JOIN sg USING (chrom, pos) GROUP BY vs.chrom, vs.pos""")),
    "soft_filter": (soft_filter, _sql("""SELECT chrom, pos, CASE WHEN dp < 20 THEN CASE WHEN filter = 'q10;s50' THEN 'q10;s50;LowDP' ELSE 'LowDP' END ELSE coalesce(filter, 'PASS') END AS filter FROM vs""")),
    "variant_counts": (counts, _sql("""SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM v GROUP BY chrom, pos))::INT AS samples, count(*) AS sites, count(*) FILTER (length(alt1) = 1) AS snps, count(*) FILTER (length(alt1) > 1 OR alt2 IS NOT NULL) AS indels,
      0 AS mnps, 0 AS others, count(alt2) AS multiallelic FROM vs""")),
    "transition_ratio": (transition_ratio, _sql("""SELECT ts, tv, ts AS ts_first, tv AS tv_first, round(ts / tv, 6) AS ratio FROM (
      SELECT count(*) FILTER (ref || alt IN ('AG', 'GA', 'CT', 'TC')) AS ts, count(*) FILTER (ref || alt NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv FROM va WHERE length(alt) = 1 AND alt <> ref)""")),
    "indel_lengths": (indel_lengths, _sql("SELECT length(alt) - length(ref) AS length, count(*) AS n FROM va WHERE length(alt) <> length(ref) GROUP BY 1")),
    "allele_lengths": (allele_lengths, _sql("""SELECT length, count(*) FILTER (k = 'r') AS ref, count(*) FILTER (k = 'a') AS alt, count(*) FILTER (k = 'b') AS "both" FROM (
      SELECT length(ref) AS length, 'r' AS k FROM va UNION ALL SELECT length(alt), 'a' FROM va UNION ALL SELECT length(ref) + length(alt), 'b' FROM va) GROUP BY length""")),
    "split_alleles": (split_alleles, _sql("""SELECT va.chrom, va.pos, va.alt, va.af::VARCHAR AS afs, CASE WHEN va.k = 1 THEN coalesce(n, 0) ELSE 0 END AS carriers FROM va
      LEFT JOIN (SELECT chrom, pos, count(*) FILTER (a1 = 1 OR a2 = 1) AS n FROM v GROUP BY chrom, pos) USING (chrom, pos)""")),
    "join_alleles": (join_alleles, _sql("SELECT chrom, pos // 3 AS pos, ref, string_agg(DISTINCT alt, ',' ORDER BY alt) AS alt, count(*) AS n FROM va GROUP BY chrom, pos // 3, ref")),
    "fill_tags": (fill_tags, _sql("""SELECT chrom, pos, coalesce(an, 0) AS an, coalesce(ac, 0) AS ac, round(ac / nullif(an, 0), 6) AS af, round(least(ac / nullif(an, 0), 1 - ac / nullif(an, 0)), 6) AS maf, coalesce(ns, 0) AS ns, coalesce(het, 0) AS ac_het, coalesce(2 * hom, 0) AS ac_hom
      FROM vs LEFT JOIN (SELECT chrom, pos, 2 * count(a1) AS an, coalesce(sum(a1 + a2), 0)::BIGINT AS ac, count(a1) AS ns, count(*) FILTER (a1 <> a2) AS het, count(*) FILTER (a1 = 1 AND a2 = 1) AS hom FROM v GROUP BY chrom, pos) USING (chrom, pos)""")),
    "sample_statistics": (sample_statistics, _sql("""SELECT 's' || lpad(sample::VARCHAR, 2, '0') AS sample, count(*) AS sites, count(*) FILTER (a1 + a2 = 0) AS hom_ref, count(*) FILTER (a1 <> a2) AS het, count(*) FILTER (a1 + a2 = 2) AS hom_alt, count(*) - count(a1) AS missing,
      count(*) FILTER (a1 + a2 > 0 AND length(alt1) = 1) AS snps, count(*) FILTER (a1 + a2 > 0 AND length(alt1) > 1) AS indels, count(*) FILTER (a1 + a2 > 0 AND length(alt1) = 1 AND ref || alt1 IN ('AG', 'GA', 'CT', 'TC')) AS ts,
      count(*) FILTER (a1 + a2 > 0 AND length(alt1) = 1 AND ref || alt1 NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv, count(*) FILTER (a1 + a2 > 0 AND ac = 1) AS singletons
      FROM v JOIN vs USING (chrom, pos) JOIN (SELECT chrom, pos, sum(a1 + a2) AS ac FROM v GROUP BY chrom, pos) USING (chrom, pos) GROUP BY sample""")),
    "genotype_intersections": (genotype_intersections, _sql("""SELECT coalesce(x, '') AS samples, count(*) AS n FROM vs LEFT JOIN (SELECT chrom, pos, string_agg(name, ',' ORDER BY name) FILTER (a1 + a2 > 0) AS x FROM sg GROUP BY chrom, pos) USING (chrom, pos) GROUP BY 1""")),
    "genotype_check": (genotype_check, _sql("""SELECT x.name AS s1, y.name AS s2, count(*) AS sites, count(*) FILTER (x.a1 + x.a2 <> y.a1 + y.a2) AS discordant FROM sg x JOIN sg y USING (chrom, pos)
      WHERE x.name < y.name AND x.a1 IS NOT NULL AND y.a1 IS NOT NULL GROUP BY ALL""")),
    "missing_to_reference": (missing_to_reference, _sql("""SELECT chrom, pos, coalesce(g, '') AS gts FROM vs LEFT JOIN (SELECT chrom, pos, string_agg(replace(gt, '.', '0'), ',' ORDER BY name) AS g FROM sg GROUP BY chrom, pos) USING (chrom, pos)""")),
    "nearest_variant": (nearest_variant, _sql("SELECT chrom, pos, least(pos - lag(pos) OVER w, lead(pos) OVER w - pos) AS nearest FROM vs WINDOW w AS (PARTITION BY chrom ORDER BY pos)")),
    "near_indels": (near_indels, _sql("""SELECT x.chrom, x.pos, bool_or(coalesce(y.pos <> x.pos AND (length(y.alt1) > 1 OR y.alt2 IS NOT NULL), FALSE)) AS near_indel FROM vs x LEFT JOIN vs y ON x.chrom = y.chrom AND abs(x.pos - y.pos) <= 30 GROUP BY ALL""")),
    "prune_windows": (prune_windows, _sql("SELECT chrom, pos FROM vs QUALIFY row_number() OVER (PARTITION BY chrom, (pos - 1) // 100 ORDER BY qual DESC NULLS LAST, pos) <= 2")),
    "scatter": (scatter, _sql("SELECT chrom, pos, (row_number() OVER (PARTITION BY chrom ORDER BY pos, ref) - 1) // 25 AS chunk FROM vs")),
    "site_sets": (site_sets, _sql("""SELECT chrom, pos, concat_ws(',', 'all', CASE WHEN id IS NOT NULL THEN 'named' END, CASE WHEN filter = 'PASS' THEN 'passed' END, CASE WHEN qual IS NOT NULL THEN 'scored' END) AS sets,
      1 + CAST(id IS NOT NULL AS INT) + CAST(coalesce(filter = 'PASS', FALSE) AS INT) + CAST(qual IS NOT NULL AS INT) AS n FROM vs WHERE id IS NOT NULL OR filter = 'PASS' OR qual IS NOT NULL""")),
    "merged_sets": (merged_sets, None),
    "annotate_sites": (annotate_sites, _sql("""SELECT chrom, vs.pos, flags, dp::VARCHAR AS dp FROM vs LEFT JOIN (SELECT pos, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM (SELECT DISTINCT l_partkey + 1 AS pos, l_returnflag FROM lineitem) GROUP BY pos) f ON vs.pos = f.pos""")),
    "trio_statistics": (trio_statistics, _sql("SELECT count(*) AS sites, count(*) FILTER (NOT good) AS errors, count(*) FILTER (tested AND good) AS tested, count(*) FILTER (tested AND good AND c1 + c2 > 0) AS transmitted FROM tq", _TRIO)),
    "group_contrast": (group_contrast, None),
    "switch_rate": (switch_rate, _sql("""SELECT chrom, count(*) AS informative, coalesce(sum(CAST(pf <> b AS INT)), 0)::BIGINT AS switches FROM (SELECT *, lag(pf) OVER (PARTITION BY chrom ORDER BY pos) AS b FROM (
      SELECT chrom, pos, c1 IN (f1, f2) AND c2 IN (m1, m2) AS pf, c2 IN (f1, f2) AND c1 IN (m1, m2) AS mf FROM tr WHERE gt LIKE '%|%' AND c1 <> c2) WHERE pf <> mf) GROUP BY chrom""", _TRIO)),
    "ploidy_runs": (ploidy_runs, _sql("SELECT name AS sample, chrom, min(pos) AS start, max(pos) AS \"end\", 2 AS ploidy FROM sg GROUP BY name, chrom")),
    "variant_keys": (variant_keys, None),
    "site_bounds": (site_bounds, _sql("""SELECT chrom, pos FROM vs JOIN (SELECT chrom, pos, count(a1) AS c, count(*) AS n, sum(a1 + a2) AS ac FROM v GROUP BY chrom, pos) USING (chrom, pos)
      WHERE alt2 IS NULL AND length(alt1) = 1 AND qual >= 905 AND c / n >= 0.9 AND least(ac / (2 * c), 1 - ac / (2 * c)) BETWEEN 0.2 AND 0.5""")),
    "site_names": (site_names, _sql("""SELECT chrom, pos FROM vs JOIN (SELECT chrom, pos, 2 * count(a1) AS an, sum(a1 + a2) AS ac FROM v GROUP BY chrom, pos) USING (chrom, pos)
      WHERE id IN (SELECT 'rs' || p_partkey FROM part WHERE p_size <= 25) AND coalesce(filter, 'PASS') = 'PASS' AND least(ac, an - ac) >= 2""")),
    "allele_summary": (allele_summary, _sql("""SELECT chrom, pos, coalesce(an, 0) AS an, coalesce(ac, 0) AS ac, round(least(ac / nullif(an, 0), 1 - ac / nullif(an, 0)), 6) AS maf, round(c / n, 6) AS call_rate
      FROM vs LEFT JOIN (SELECT chrom, pos, 2 * count(a1) AS an, coalesce(sum(a1 + a2), 0)::BIGINT AS ac, count(a1) AS c, count(*) AS n FROM v GROUP BY chrom, pos) USING (chrom, pos)""")),
    "genotype_bounds": (genotype_bounds, _sql("""SELECT chrom, pos, name AS sample, CASE WHEN gq >= 30 AND gq > 10 AND dp BETWEEN 10 AND 40 THEN gt ELSE CASE WHEN dp % 2 = 0 THEN '.|.' ELSE './.' END END AS gt FROM sg""")),
    "sample_subset": (sample_subset, _sql("""SELECT vs.chrom, vs.pos, n || CASE WHEN alt2 IS NOT NULL THEN ',0' ELSE '' END AS ac, k::VARCHAR AS an, samples FROM vs JOIN (
      SELECT chrom, pos, sum(a1 + a2)::BIGINT AS n, 2 * count(a1) AS k, string_agg(name, ',' ORDER BY name) AS samples FROM sg WHERE name IN ('s01', 's04', 's07', 's10') GROUP BY chrom, pos HAVING sum(a1 + a2) > 0) USING (chrom, pos)""")),
    "info_table": (info_table, _sql("SELECT chrom, pos, ref, concat_ws(',', alt1, alt2) AS alt, coalesce(dp::VARCHAR, '?') AS dp, af1 || ',' || af2 AS afs FROM vs")),
    "format_table": (format_table, _sql("SELECT chrom, pos, name AS sample, CASE WHEN gq > 10 THEN gq::VARCHAR ELSE '.' END AS value FROM sg")),
    "reference_blocks": (reference_blocks, _sql("""SELECT sample, 'x' AS chrom, min(pos) AS start, max(pos) AS "end", band, min(dp) AS least FROM (
      SELECT *, pos - row_number() OVER (PARTITION BY sample, band ORDER BY pos) AS k FROM (SELECT sample, pos, dp, CASE WHEN dp >= 40 THEN 4 WHEN dp >= 20 THEN 3 WHEN dp >= 10 THEN 2 WHEN dp >= 1 THEN 1 ELSE 0 END AS band FROM v)) GROUP BY sample, band, k""")),
}
