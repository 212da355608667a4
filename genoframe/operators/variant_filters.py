"""Site, genotype and sample filters of variant frames (chrom, pos, id, ref, alt, qual, filter, info, samples), and their fields as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filter_lang import alleles


def _called(samples: Column) -> Column:
    """All called alleles of a list of samples."""
    return F.filter(F.flatten(F.transform(samples, lambda s: alleles(s["gt"]))), lambda a: a.isNotNull())


def allele_summary(df: DataFrame) -> DataFrame:
    """Adds ``an`` (called alleles), ``ac`` (those that are not the reference), ``maf`` and ``call_rate`` (samples with no missing allele); the last two are null without any."""
    called = _called(F.col("samples"))
    whole = F.size(F.filter("samples", lambda s: ~F.exists(alleles(s["gt"]), lambda a: a.isNull())))
    x = df.withColumns({"an": F.size(called).cast("long"), "ac": F.size(F.filter(called, lambda a: a > 0)).cast("long"), "call_rate": whole / F.nullif(F.size("samples"), F.lit(0))})
    share = F.col("ac") / F.nullif(F.col("an"), F.lit(0))
    return x.withColumn("maf", F.least(share, 1 - share))


def filter_sites(
    df: DataFrame, ids: DataFrame | None = None, exclude_ids: DataFrame | None = None, alleles_between: tuple[int, int | None] = (0, None), maf_between: tuple[float, float] | None = None,
    mac_between: tuple[int, int | None] | None = None, call_rate: float | None = None, quality: float | None = None, indels: bool | None = None, passed: bool = False,
) -> DataFrame:
    """Sites that meet all bounds; a site without the value that a bound is about fails it.

    ``ids`` and ``exclude_ids`` are tables with a column id; ``indels``: True keeps sites with an
    allele of another length than REF, False those without; ``passed`` keeps PASS and no filters.
    """
    if ids is not None:
        df = df.join(ids.select("id").distinct(), "id", "left_semi").select(df.columns)
    if exclude_ids is not None:
        df = df.join(exclude_ids.select("id").distinct(), "id", "left_anti").select(df.columns)
    own = df.columns
    df = allele_summary(df)
    n, (fewest, most) = F.size("alt") + 1, alleles_between
    ok = n >= fewest
    if most is not None:
        ok &= n <= most
    if maf_between:
        ok &= F.col("maf").between(*maf_between)
    if mac_between:
        minor = F.least(F.col("ac"), F.col("an") - F.col("ac"))
        ok &= (F.col("an") > 0) & (minor >= mac_between[0])
        if mac_between[1] is not None:
            ok &= minor <= mac_between[1]
    if call_rate is not None:
        ok &= F.col("call_rate") >= call_rate
    if quality is not None:
        ok &= F.col("qual") >= quality
    if indels is not None:
        ok &= F.exists("alt", lambda a: F.length(a) != F.length(F.col("ref"))) == indels
    if passed:
        ok &= ~F.exists(F.coalesce("filter", F.array().cast("array<string>")), lambda x: ~x.isin("PASS", "."))
    return df.filter(F.coalesce(ok, F.lit(False))).select(own)


def filter_genotypes(df: DataFrame, quality: float | None = None, depth: tuple[float, float | None] = (0, None)) -> DataFrame:
    """Genotypes under ``quality`` (GQ) or outside ``depth`` (DP) become missing, as do those that lack the field of a bound."""

    def good(s: Column) -> Column:
        ok = F.lit(True)
        gq, dp = s["data"]["GQ"].try_cast("double"), s["data"]["DP"].try_cast("double")
        if quality is not None:
            ok &= gq >= quality
        if depth[0] > 0:
            ok &= dp >= depth[0]
        if depth[1] is not None:
            ok &= dp <= depth[1]
        return F.coalesce(ok, F.lit(False))

    cut = lambda s: F.struct(s["name"].alias("name"), F.when(good(s), s["gt"]).otherwise(F.regexp_replace(s["gt"], "[^/|]+", ".")).alias("gt"), s["data"].alias("data"))
    return df.withColumn("samples", F.transform("samples", cut))


def select_samples(df: DataFrame, names: list[str], exclude: bool = False, recount: bool = True, variable: bool = False) -> DataFrame:
    """Keeps (or drops) the named samples, in their order; AC and AN in INFO are counted again, and ``variable`` keeps sites with a non-reference allele left."""
    chosen = F.filter("samples", lambda s: ~s["name"].isin(names) if exclude else s["name"].isin(names))
    x = df.withColumn("samples", chosen)
    if not recount and not variable:
        return x
    called = _called(F.col("samples"))
    each = F.transform("alt", lambda _, i: F.size(F.filter(called, lambda a: a == i + 1)).cast("string"))
    if recount:
        counted = F.create_map(F.lit("AC"), F.array_join(each, ","), F.lit("AN"), F.size(called).cast("string"))
        x = x.withColumn("info", F.map_concat(F.map_filter("info", lambda k, _: ~k.isin("AC", "AN")), counted))
    return x.filter(F.exists(called, lambda a: a > 0)) if variable else x


def info_table(df: DataFrame, tags: list[str]) -> DataFrame:
    """(chrom, pos, ref, alt, a column for each INFO tag; '?' where a site has none)."""
    return df.select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), *[F.coalesce(F.col("info")[t], F.lit("?")).alias(t) for t in tags])


def format_table(df: DataFrame, tag: str) -> DataFrame:
    """(chrom, pos, sample, value) of a FORMAT tag or GT; '.' where a sample has none."""
    each = df.select("chrom", "pos", F.explode("samples").alias("s"))
    value = F.col("s.gt") if tag == "GT" else F.col("s.data")[tag]
    return each.select("chrom", "pos", F.col("s.name").alias("sample"), F.coalesce(value, F.lit(".")).alias("value"))
