"""Variant operators over frames with chrom, pos (1-based), id, ref, alt (array), qual, filter (array), info (map) and samples (array of name, gt, data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filter_lang import alleles, compile_filter, compile_format
from ..functions.stats import binomial_p, fisher_exact, hardy_weinberg

SITE = ["chrom", "pos"]


# Filters and projections.


def view(df: DataFrame, include: str | None = None, exclude: str | None = None, info: set[str] | None = None, fmt: set[str] | None = None) -> DataFrame:
    """Sites that pass the ``include`` and fail the ``exclude`` expression."""
    if include:
        df = df.filter(compile_filter(include, info, fmt).site)
    if exclude:
        df = df.filter(~compile_filter(exclude, info, fmt).site)
    return df


def query(df: DataFrame, fmt: str) -> DataFrame:
    """One text column ``line`` in a query format."""
    return df.select(compile_format(fmt).alias("line"))


def soft_filter(df: DataFrame, expression: str, name: str, exclude: bool = True, mode: str = "+") -> DataFrame:
    """Marks failing sites with ``name`` in FILTER: '+' appends, '' replaces; others pass."""
    site = compile_filter(expression).site
    failed = site if exclude else ~site
    kept = F.filter(F.coalesce("filter", F.array()), lambda x: (x != "PASS") & (x != "."))
    marked = F.array_distinct(F.concat(kept, F.array(F.lit(name)))) if mode == "+" else F.array(F.lit(name))
    return df.withColumn("filter", F.when(failed, marked).when(F.size(kept) == 0, F.array(F.lit("PASS"))).otherwise(F.col("filter")))


def set_genotypes(df: DataFrame, target: Column | str, new: str = "./.") -> DataFrame:
    """Genotypes of a class (./x partial, ./. whole missing, or a per-sample expression) become ``new``; '0' keeps ploidy with reference alleles."""
    expression = compile_filter(target).samples if target not in ("./x", "./.") else None

    def hit(s: Column) -> Column:
        a = alleles(s["gt"])
        miss = F.exists(a, lambda x: x.isNull())
        return miss & F.exists(a, lambda x: x.isNotNull()) if target == "./x" else miss & ~F.exists(a, lambda x: x.isNotNull())

    mask = expression if expression is not None else F.transform("samples", hit)
    value = lambda s: F.regexp_replace(s["gt"], r"[^/|]+", "0") if new == "0" else F.lit(new)
    changed = F.zip_with("samples", mask, lambda s, m: F.struct(s["name"].alias("name"), F.when(m, value(s)).otherwise(s["gt"]).alias("gt"), s["data"].alias("data")))
    return df.withColumn("samples", changed)


def missing_to_reference(df: DataFrame, major: bool = False) -> DataFrame:
    """Missing alleles become 0, or the commonest allele of the site (the smaller of equals)."""
    called = F.filter(F.flatten(F.transform("samples", lambda s: alleles(s["gt"]))), lambda x: x.isNotNull())
    counts = F.transform(F.array_sort(F.array_distinct(called)), lambda a: F.struct((-F.size(F.filter(called, lambda x: x == a))).alias("n"), a.alias("a")))
    allele = F.coalesce(F.array_min(counts)["a"], F.lit(0)) if major else F.lit(0)
    x = df.withColumn("_a", allele.cast("string"))
    return x.withColumn("samples", F.transform("samples", lambda s: F.struct(s["name"].alias("name"), F.replace(s["gt"], F.lit("."), F.col("_a")).alias("gt"), s["data"].alias("data")))).drop("_a")


def variant_class(ref: Column, alt: Column) -> Column:
    """ref, snp, mnp, indel or other of one pair of alleles."""
    plain = ref.rlike("^[ACGTNacgtn]+$") & alt.rlike("^[ACGTNacgtn]+$")
    return F.when(alt.isin(".", "*", "<*>", "<NON_REF>"), "ref").when(~plain, "other").when(F.upper(ref) == F.upper(alt), "ref").when(F.length(ref) != F.length(alt), "indel").when(F.length(ref) == 1, "snp").otherwise("mnp")


def is_transition(ref: Column, alt: Column) -> Column:
    return F.upper(F.concat(ref, alt)).isin("AG", "GA", "CT", "TC")


# Representation.


def split_alleles(df: DataFrame, per_allele: tuple[str, ...] = ()) -> DataFrame:
    """One row for each ALT; INFO tags of one value an allele are cut, other ALT alleles in genotypes become 0."""
    rows = df.select("*", F.posexplode("alt").alias("_k", "_alt"))

    def recode(s: Column) -> Column:
        one = F.regexp_replace(F.regexp_replace(F.regexp_replace(s["gt"], r"[0-9]+", "<$0>"), F.concat(F.lit("<"), F.col("_k") + 1, F.lit(">")), F.lit("@")), r"<[0-9]+>", "0")
        return F.struct(s["name"].alias("name"), F.replace(one, F.lit("@"), F.lit("1")).alias("gt"), s["data"].alias("data"))

    info = F.transform_values("info", lambda k, v: F.when(k.isin(*per_allele), F.get(F.split(v, ","), F.col("_k"))).otherwise(v)) if per_allele else F.col("info")
    return rows.withColumns({"samples": F.transform("samples", recode), "info": info, "alt": F.array("_alt")}).drop("_k", "_alt")


def join_alleles(df: DataFrame) -> DataFrame:
    """Biallelic rows of one place and REF together, ALTs in order: (chrom, pos, ref, alt, n)."""
    return df.groupBy(*SITE, "ref").agg(F.array_distinct(F.flatten(F.array_sort(F.collect_list("alt")))).alias("alt"), F.count("*").alias("n"))


def atomize(df: DataFrame) -> DataFrame:
    """Rows of equal-length alleles cut into one-base changes (chrom, pos, ref, alt); other rows stay."""
    one = df.select(*SITE, "ref", F.explode("alt").alias("alt"))
    same = one.filter((F.length("ref") == F.length("alt")) & (F.length("ref") > 1))
    bases = same.select("chrom", "pos", F.posexplode(F.arrays_zip(F.split("ref", "").alias("r"), F.split("alt", "").alias("a"))).alias("k", "x"))
    cut = bases.filter(F.col("x.r") != F.col("x.a")).select("chrom", (F.col("pos") + F.col("k")).alias("pos"), F.col("x.r").alias("ref"), F.col("x.a").alias("alt"))
    return cut.unionByName(one.filter((F.length("ref") != F.length("alt")) | (F.length("ref") == 1)))


def left_aligned(pos: int, ref: str, alt: str, before: str) -> tuple[int, str, str]:
    """A pair of alleles moved left through ``before`` (the bases that end just before pos) and cut to its shortest form."""
    r, a, at = ref, alt, len(before)
    while r and a and r[-1].upper() == a[-1].upper() and (len(r) > 1 or len(a) > 1 or at > 0):
        if r.upper() == a.upper():
            break
        r, a = r[:-1], a[:-1]
        if not r or not a:
            if at == 0:
                r, a = ref, alt  # no room: as it was
                return pos, r, a
            at -= 1
            r, a, pos = before[at] + r, before[at] + a, pos - 1
    while len(r) > 1 and len(a) > 1 and r[0].upper() == a[0].upper():
        r, a, pos = r[1:], a[1:], pos + 1
    return pos, r, a


def left_align(df: DataFrame, reference: DataFrame, reach: int = 1000) -> DataFrame:
    """Biallelic rows (chrom, pos, ref, alt as text) left-aligned against a reference (chrom, seq), looking ``reach`` bases back."""
    import pandas as pd

    @F.pandas_udf("struct<pos:long,ref:string,alt:string>")
    def run(pos: pd.Series, ref: pd.Series, alt: pd.Series, before: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([left_aligned(int(p), r, a, b or "") for p, r, a, b in zip(pos, ref, alt, before, strict=True)], columns=["pos", "ref", "alt"])

    x = df.join(reference.select("chrom", F.col("seq").alias("_seq")), "chrom")
    first = F.greatest(F.lit(1), F.col("pos").cast("int") - reach)
    before = F.substring("_seq", first, F.col("pos").cast("int") - first)
    return x.withColumn("_n", run("pos", "ref", "alt", before)).withColumns({"pos": F.col("_n.pos"), "ref": F.col("_n.ref"), "alt": F.col("_n.alt")}).drop("_n", "_seq")


def reference_check(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows whose REF disagrees with the reference."""
    x = df.join(reference.select("chrom", F.col("seq").alias("_seq")), "chrom")
    return x.filter(F.upper(F.substring("_seq", F.col("pos").cast("int"), F.length("ref"))) != F.upper("ref")).drop("_seq")


# Set operations between files.


def _key(mode: str) -> list[Column]:
    kind = F.array_join(F.array_sort(F.array_distinct(F.transform("alt", lambda a: variant_class(F.col("ref"), a)))), ",")
    base = [F.col("chrom"), F.col("pos")]
    return {"none": [*base, F.col("ref"), F.array_join(F.array_sort("alt"), ",").alias("alts")], "all": base, "type": [*base, kind.alias("kind")], "id": [F.col("id")]}[mode]


def intersection(sets: dict[str, DataFrame], mode: str = "none", least: int | None = None, exactly: int | None = None, only: set[str] | None = None) -> DataFrame:
    """(key..., sets, n): which sets hold each key; keep keys of ``least`` or ``exactly`` so many sets, or of just the sets ``only``.

    Keys by mode: none: place, REF and ALTs; all: place; type: place and variant classes; id.
    """
    every = None
    for name, df in sets.items():
        one = df.select(*_key(mode), F.lit(name).alias("_set"))
        every = one if every is None else every.unionByName(one)
    keys = [c for c in every.columns if c != "_set"]
    by = every.groupBy(*keys).agg(F.array_sort(F.collect_set("_set")).alias("sets")).withColumn("n", F.size("sets"))
    if least is not None:
        by = by.filter(F.col("n") >= least)
    if exactly is not None:
        by = by.filter(F.col("n") == exactly)
    if only is not None:
        by = by.filter(F.col("sets") == F.array(*[F.lit(x) for x in sorted(only)]))
    return by


def merge_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge by place and REF: ALTs united in order, genotypes renumbered to them, absent samples missing.

    Returns chrom, pos, ref, alt, samples (a's, then b's); both frames have the same sample list in all rows.
    """
    keys = [*SITE, "ref"]
    one = lambda df, p: df.groupBy(*keys).agg(F.first("alt").alias(f"{p}alt"), F.first("samples").alias(f"{p}samples"))
    sa, sb = (df.select(F.transform("samples", lambda s: s["name"]).alias("n")).limit(1) for df in (a, b))
    roster = sa.withColumnRenamed("n", "na").crossJoin(sb.withColumnRenamed("n", "nb"))
    x = one(a, "a").join(one(b, "b"), keys, "full").crossJoin(F.broadcast(roster))
    alts = F.array_distinct(F.concat(F.coalesce("aalt", F.array().cast("array<string>")), F.coalesce("balt", F.array().cast("array<string>"))))
    x = x.withColumn("alt", alts)

    def side(p: str) -> Column:
        def recode(s: Column) -> Column:
            def one_allele(t: Column) -> Column:
                k = t.try_cast("int")
                return F.when(k.isNull() | (k == 0), t).otherwise(F.array_position("alt", F.get(F.col(f"{p}alt"), k - 1)).cast("string"))

            new = F.transform(F.split(s["gt"], r"[/|]"), one_allele)
            return F.struct(s["name"].alias("name"), F.when(s["gt"].contains("|"), F.array_join(new, "|")).otherwise(F.array_join(new, "/")).alias("gt"))

        none = F.transform(F.col(f"n{p}"), lambda n: F.struct(n.alias("name"), F.lit("./.").alias("gt")))
        return F.coalesce(F.transform(f"{p}samples", recode), none)

    return x.select(*keys, "alt", F.concat(side("a"), side("b")).alias("samples"))


def annotate(df: DataFrame, table: DataFrame, columns: dict[str, str], on: tuple[str, ...] = ("chrom", "pos"), rule: str = "first") -> DataFrame:
    """INFO tags from a table's columns, matched on ``on``; several matches are merged by rule (first, append, unique, sum, avg, min, max)."""

    def merged(c: str) -> Column:
        v = F.col(c)
        text = lambda x: x.cast("string")
        return {
            "first": lambda: F.min(F.struct("_o", text(v).alias("v")))["v"], "append": lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", text(v).alias("v")))), lambda s: s["v"]), ","),
            "unique": lambda: F.array_join(F.array_sort(F.collect_set(text(v))), ","), "sum": lambda: text(F.sum(v)), "avg": lambda: text(F.avg(v)), "min": lambda: text(F.min(v)), "max": lambda: text(F.max(v)),
        }[rule]()

    t = table.withColumn("_o", F.struct(*[c for c in table.columns if c not in on])).groupBy(*on).agg(*[merged(c).alias(f"_{tag}") for tag, c in columns.items()])
    x = df.join(t, list(on), "left")
    added = F.map_filter(F.create_map(*[y for tag in columns for y in (F.lit(tag), F.col(f"_{tag}"))]), lambda k, v: v.isNotNull())
    kept = F.map_filter("info", lambda k, v: ~F.map_contains_key(added, k))
    return x.withColumn("info", F.map_concat(kept, added)).drop(*[f"_{tag}" for tag in columns])


# Neighbours along a chromosome.


def distance_to_nearest(df: DataFrame) -> DataFrame:
    """Adds ``nearest``: bases to the nearest variant at another place of the chromosome, null without one."""
    w = Window.partitionBy("chrom").orderBy("pos")
    places = df.select(*SITE).distinct()
    near = F.least(F.col("pos") - F.lag("pos").over(w), F.lead("pos").over(w) - F.col("pos"))
    return df.join(places.withColumn("nearest", near), SITE)


def mark_overlaps(df: DataFrame) -> DataFrame:
    """Adds ``overlaps``: whether the bases of REF overlap those of another variant."""
    start, end = F.col("pos"), F.col("pos") + F.length("ref")
    w = Window.partitionBy("chrom").orderBy("pos", "ref", F.array_join("alt", ","))
    x = df.withColumns({"_end": end, "_reach": F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_next": F.lead(start).over(w)})
    return x.withColumn("overlaps", F.coalesce(start < F.col("_reach"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("_end"), F.lit(False))).drop("_end", "_reach", "_next")


def indel_gap(df: DataFrame, gap: int) -> DataFrame:
    """Adds ``near_indel``: an indel lies within ``gap`` bases."""
    indel = F.exists("alt", lambda a: variant_class(F.col("ref"), a) == "indel").cast("int")
    w = Window.partitionBy("chrom").orderBy("pos").rangeBetween(-gap, gap)
    x = df.withColumn("_i", indel)
    return x.withColumn("near_indel", F.sum("_i").over(w) - F.col("_i") > 0).drop("_i")


def prune_windows(df: DataFrame, width: int, most: int, key: str = "qual") -> DataFrame:
    """At most ``most`` sites in each window of ``width`` bases, those of the greatest ``key``; ties by place."""
    w = Window.partitionBy("chrom", F.floor((F.col("pos") - 1) / width)).orderBy(F.desc_nulls_last(key), "pos")
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def scatter(df: DataFrame, sites: int) -> DataFrame:
    """Adds ``chunk``: consecutive chunks of ``sites`` variants within each chromosome, numbered from 0."""
    w = Window.partitionBy("chrom").orderBy("pos", "ref")
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / sites))


def reference_blocks(df: DataFrame, depth: str = "dp", edges: tuple[int, ...] = (1, 10, 20, 40)) -> DataFrame:
    """Runs of adjacent reference places in one depth band: (chrom, start, end, band, least); for each sample, named first, where there is that column."""
    keys = ["sample", "chrom"] if "sample" in df.columns else ["chrom"]
    band = F.lit(0)
    for i, e in enumerate(edges):
        band = F.when(F.col(depth) >= e, i + 1).otherwise(band)
    w = Window.partitionBy(*keys).orderBy("pos")
    x = df.withColumn("band", band)
    x = x.withColumn("_f", F.coalesce((F.col("pos") != F.lag("pos").over(w) + 1) | (F.col("band") != F.lag("band").over(w)), F.lit(True)).cast("int"))
    x = x.withColumn("_run", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "_run", "band").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.min(depth).alias("least")).drop("_run")


# Statistics and tags.


def genotype_rows(df: DataFrame) -> DataFrame:
    """Long form: site columns, sample, gt, allele array and data."""
    x = df.select("chrom", "pos", "ref", "alt", F.explode("samples").alias("s"))
    return x.select("chrom", "pos", "ref", "alt", F.col("s.name").alias("sample"), F.col("s.gt").alias("gt"), alleles(F.col("s.gt")).alias("alleles"), F.col("s.data").alias("data"))


def fill_tags(df: DataFrame) -> DataFrame:
    """Adds AN, AC, AF, MAF, NS, AC_Het, AC_Hom, HWE and ExcHet of the first ALT as columns."""
    lists = F.transform("samples", lambda s: alleles(s["gt"]))
    called = F.filter(F.flatten(lists), lambda x: x.isNotNull())
    x = df.withColumns({"_l": lists, "an": F.size(called), "_c": called, "ns": F.size(F.filter(lists, lambda a: F.exists(a, lambda v: v.isNotNull())))})
    x = x.withColumn("ac", F.transform(F.sequence(F.lit(1), F.greatest(F.size("alt"), F.lit(1))), lambda k: F.size(F.filter("_c", lambda v: v == k))))
    whole = F.filter("_l", lambda a: (F.size(a) == 2) & ~F.exists(a, lambda v: v.isNull()))
    one = lambda a: F.size(F.filter(a, lambda v: v == 1))
    x = x.withColumns({"_het": F.size(F.filter(whole, lambda a: one(a) == 1)), "_hom": F.size(F.filter(whole, lambda a: one(a) == 2)), "_ref": F.size(F.filter(whole, lambda a: one(a) == 0))})
    af = F.transform("ac", lambda c: c / F.nullif("an", F.lit(0)))
    test = hardy_weinberg(F.col("_het"), F.col("_ref"), F.col("_hom"))
    x = x.withColumns({"af": af, "maf": F.least(F.get(af, F.lit(0)), 1 - F.get(af, F.lit(0))), "ac_het": F.col("_het"), "ac_hom": 2 * F.col("_hom"), "_t": test})
    return x.withColumns({"hwe": F.col("_t.p"), "exc_het": F.col("_t.p_excess")}).drop("_l", "_c", "_het", "_hom", "_ref", "_t")


def counts(df: DataFrame) -> DataFrame:
    """One row: samples, sites, snps, indels, mnps, others, multiallelic sites."""
    kinds = F.array_distinct(F.transform("alt", lambda a: variant_class(F.col("ref"), a)))
    n = lambda k: F.count_if(F.array_contains(kinds, k))
    return df.agg(F.coalesce(F.max(F.size("samples")), F.lit(0)).alias("samples"), F.count("*").alias("sites"), n("snp").alias("snps"), n("indel").alias("indels"), n("mnp").alias("mnps"), n("other").alias("others"), F.count_if(F.size("alt") > 1).alias("multiallelic"))


def transition_ratio(df: DataFrame) -> DataFrame:
    """One row: transitions, transversions, ratio over all SNP alleles, and over the first ALT alone."""
    x = df.select("ref", F.posexplode("alt").alias("k", "a")).filter(variant_class(F.col("ref"), F.col("a")) == "snp")
    ts = is_transition(F.col("ref"), F.col("a"))
    row = x.agg(F.count_if(ts).alias("ts"), F.count_if(~ts).alias("tv"), F.count_if(ts & (F.col("k") == 0)).alias("ts_first"), F.count_if(~ts & (F.col("k") == 0)).alias("tv_first"))
    return row.withColumn("ratio", F.col("ts") / F.nullif("tv", F.lit(0)))


def indel_lengths(df: DataFrame) -> DataFrame:
    """(length, n): ALT minus REF length of indels."""
    return df.select("ref", F.explode("alt").alias("a")).filter(variant_class(F.col("ref"), F.col("a")) == "indel").groupBy((F.length("a") - F.length("ref")).alias("length")).agg(F.count("*").alias("n"))


def allele_lengths(df: DataFrame) -> DataFrame:
    """(length, ref, alt, both): how many alleles have that length."""
    x = df.select("ref", F.explode("alt").alias("a"))
    rows = x.select(F.explode(F.array(F.struct(F.length("ref").alias("length"), F.lit("r").alias("k")), F.struct(F.length("a").alias("length"), F.lit("a").alias("k")), F.struct((F.length("ref") + F.length("a")).alias("length"), F.lit("b").alias("k")))).alias("x")).select("x.*")
    n = lambda k: F.count_if(F.col("k") == k)
    return rows.groupBy("length").agg(n("r").alias("ref"), n("a").alias("alt"), n("b").alias("both"))


def sample_statistics(df: DataFrame) -> DataFrame:
    """(sample, sites, hom_ref, het, hom_alt, missing, snps, indels, ts, tv, singletons) for each sample."""
    ac = F.filter(F.flatten(F.transform("samples", lambda s: alleles(s["gt"]))), lambda x: x > 0)
    x = df.withColumn("single", F.size(ac) == 1).select("chrom", "pos", "ref", "alt", "single", F.explode("samples").alias("s"))
    a = alleles(F.col("s.gt"))
    x = x.withColumns({"a": a, "full": ~F.exists(a, lambda v: v.isNull())})
    some, ref = F.exists("a", lambda v: v > 0), F.exists("a", lambda v: v == 0)
    same = F.size(F.array_distinct("a")) == 1
    first = F.get("alt", F.array_max("a") - 1)
    kind = F.when(F.col("full") & some, variant_class(F.col("ref"), first))
    ts = is_transition(F.col("ref"), first)
    return x.groupBy(F.col("s.name").alias("sample")).agg(
        F.count("*").alias("sites"), F.count_if(F.col("full") & ~some).alias("hom_ref"), F.count_if(F.col("full") & some & ~same).alias("het"), F.count_if(F.col("full") & some & same).alias("hom_alt"),
        F.count_if(~F.col("full")).alias("missing"), F.count_if(kind == "snp").alias("snps"), F.count_if(kind == "indel").alias("indels"), F.count_if((kind == "snp") & ts).alias("ts"), F.count_if((kind == "snp") & ~ts).alias("tv"),
        F.count_if(some & F.col("single")).alias("singletons"),
    )


def genotype_intersections(df: DataFrame) -> DataFrame:
    """(samples, n): for each set of samples, how often just these carry a non-reference genotype."""
    carriers = F.array_sort(F.transform(F.filter("samples", lambda s: F.exists(alleles(s["gt"]), lambda v: v > 0)), lambda s: s["name"]))
    return df.groupBy(F.array_join(carriers, ",").alias("samples")).agg(F.count("*").alias("n"))


def genotype_subset(df: DataFrame, names: list[str]) -> DataFrame:
    """Sites where the named samples share one genotype that no other sample has."""
    own = F.array_distinct(F.transform(F.filter("samples", lambda s: s["name"].isin(*names)), lambda s: s["gt"]))
    other = F.transform(F.filter("samples", lambda s: ~s["name"].isin(*names)), lambda s: s["gt"])
    return df.filter((F.size(own) == 1) & ~F.exists(other, lambda g: g == F.get(own, F.lit(0))))


def contrast(df: DataFrame, cases: list[str], controls: list[str]) -> DataFrame:
    """Adds the ALT and REF counts of two groups, the exact two-sided p, and whether cases have an allele that no control has."""
    n = lambda group, alt: F.size(F.filter(F.flatten(F.transform(F.filter("samples", lambda s: s["name"].isin(*group)), lambda s: alleles(s["gt"]))), lambda v: v > 0 if alt else v == 0))
    seen = lambda group: F.array_distinct(F.filter(F.flatten(F.transform(F.filter("samples", lambda s: s["name"].isin(*group)), lambda s: alleles(s["gt"]))), lambda v: v.isNotNull()))
    x = df.withColumns({"case_alt": n(cases, True), "case_ref": n(cases, False), "control_alt": n(controls, True), "control_ref": n(controls, False), "novel": F.size(F.array_except(seen(cases), seen(controls))) > 0})
    return x.withColumn("p", fisher_exact("case_alt", "case_ref", "control_alt", "control_ref")["two"])


def allele_bias(df: DataFrame, first: str, second: str, tag: str = "AD") -> DataFrame:
    """Sites with the REF and ALT read counts of two samples (FORMAT tag 'ref,alt') and Fisher's p."""
    value = lambda name, k: F.get(F.split(F.element_at(F.get(F.filter("samples", lambda s: s["name"] == name), F.lit(0))["data"], tag), ","), F.lit(k)).try_cast("long")
    x = df.withColumns({"r1": value(first, 0), "a1": value(first, 1), "r2": value(second, 0), "a2": value(second, 1)}).filter("r1 is not null and a1 is not null and r2 is not null and a2 is not null")
    return x.withColumn("p", fisher_exact("r1", "a1", "r2", "a2")["two"])


def trio_statistics(df: DataFrame, child: str, father: str, mother: str) -> DataFrame:
    """One row of a trio: sites with three diploid calls, Mendelian errors, and transmissions of the ALT of one heterozygous parent with its two-sided p."""
    of = lambda name: alleles(F.get(F.filter("samples", lambda s: s["name"] == name), F.lit(0))["gt"])
    x = df.select(of(child).alias("c"), of(father).alias("f"), of(mother).alias("m"))
    ok = lambda k: (F.size(k) == 2) & ~F.exists(k, lambda v: v.isNull())
    x = x.filter(ok("c") & ok("f") & ok("m"))
    has = lambda who, allele: F.array_contains(who, allele)
    c0, c1 = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    good = has("f", c0) & has("m", c1) | has("f", c1) & has("m", c0)
    het = lambda who: F.size(F.array_distinct(who)) == 2
    hom_ref = lambda who: ~F.exists(who, lambda v: v > 0)
    tested = (het("f") & hom_ref("m")) | (het("m") & hom_ref("f"))
    passed = tested & F.exists("c", lambda v: v > 0)
    row = x.agg(F.count("*").alias("sites"), F.count_if(~good).alias("errors"), F.count_if(tested & good).alias("tested"), F.count_if(passed & good).alias("transmitted"))
    return row.withColumn("p", binomial_p(F.col("transmitted"), F.col("tested")))


def switch_rate(df: DataFrame, child: str, father: str, mother: str) -> DataFrame:
    """(chrom, informative, switches): phase switches of a phased child between sites where the father's origin of its alleles is certain."""
    of = lambda name: F.get(F.filter("samples", lambda s: s["name"] == name), F.lit(0))["gt"]
    x = df.select(*SITE, of(child).alias("g"), alleles(of(child)).alias("c"), alleles(of(father)).alias("f"), alleles(of(mother)).alias("m"))
    c0, c1 = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    has = lambda who, v: F.array_contains(who, v)
    first = has("f", c0) & has("m", c1)
    second = has("f", c1) & has("m", c0)
    x = x.filter(F.col("g").contains("|") & (c0 != c1) & (first != second)).withColumn("paternal_first", first)
    w = Window.partitionBy("chrom").orderBy("pos")
    x = x.withColumn("_s", F.coalesce((F.col("paternal_first") != F.lag("paternal_first").over(w)).cast("int"), F.lit(0)))
    return x.groupBy("chrom").agg(F.count("*").alias("informative"), F.sum("_s").alias("switches"))


def ploidy_runs(df: DataFrame) -> DataFrame:
    """(sample, chrom, start, end, ploidy): runs of consecutive sites where a sample's ploidy is the same."""
    x = genotype_rows(df).select("sample", *SITE, F.size("alleles").alias("ploidy"))
    w = Window.partitionBy("sample", "chrom").orderBy("pos")
    x = x.withColumn("_f", F.coalesce((F.col("ploidy") != F.lag("ploidy").over(w)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("sample", "chrom", "_run", "ploidy").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).drop("_run")


def sparse_samples(df: DataFrame, least: int = 1) -> DataFrame:
    """(chrom, sample) with fewer than ``least`` called genotypes on the chromosome."""
    x = genotype_rows(df)
    return x.groupBy("chrom", "sample").agg(F.count_if(F.exists("alleles", lambda v: v.isNotNull())).alias("called")).filter(F.col("called") < least)


def genotype_check(df: DataFrame) -> DataFrame:
    """(s1, s2, sites, discordant): pairwise comparison of dosages over shared calls."""
    x = genotype_rows(df).filter(~F.exists("alleles", lambda v: v.isNull())).select(*SITE, "sample", F.size(F.filter("alleles", lambda v: v > 0)).alias("g"))
    y = x.select(*SITE, F.col("sample").alias("s2"), F.col("g").alias("h"))
    return x.withColumnRenamed("sample", "s1").join(y, SITE).filter("s1 < s2").groupBy("s1", "s2").agg(F.count("*").alias("sites"), F.count_if(F.col("g") != F.col("h")).alias("discordant"))


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """64-bit key: 5 bits of chromosome (1-25 for 1-22, X, Y, MT), 28 of the 0-based place, 31 of the alleles.

    Short alleles (11 bases together at most, ACGT) are packed reversibly with their lengths;
    others are hashed, with the lowest bit set.
    """
    bare = F.regexp_replace(F.upper(chrom), "^CHR", "")
    code = F.when(bare.rlike("^[0-9]+$"), bare.try_cast("long")).when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).otherwise(0).cast("long")
    r, a = F.upper(ref), F.upper(alt)
    short = (F.length(r) + F.length(a) <= 11) & F.concat(r, a).rlike("^[ACGT]+$")
    digits = F.split(F.translate(F.concat(r, a), "ACGT", "0123"), "")
    bits = F.aggregate(F.filter(digits, lambda x: x != ""), F.lit(0).cast("long"), lambda acc, x: acc * 4 + x.cast("long"))
    packed = F.shiftleft(F.length(r).cast("long"), 27).bitwiseOR(F.shiftleft(F.length(a).cast("long"), 23)).bitwiseOR(F.expr("CAST(0 AS BIGINT)") + _shifted(bits, 22 - 2 * (F.length(r) + F.length(a))) * 2)
    hashed = F.xxhash64(F.concat_ws("_", r, a)).bitwiseAND(F.lit((1 << 31) - 1)).bitwiseOR(F.lit(1).cast("long"))
    return F.shiftleft(code, 59).bitwiseOR(F.shiftleft(pos.cast("long") - 1, 31)).bitwiseOR(F.when(short, packed).otherwise(hashed))


def _shifted(x: Column, n: Column) -> Column:
    """x times 2 to the n."""
    return (x * F.pow(F.lit(2.0), n).cast("long")).cast("long")


def consequences(df: DataFrame, tag: str = "CSQ", fields: tuple[str, ...] = ("Allele", "Consequence", "Gene")) -> DataFrame:
    """One row for each comma-separated record of a bar-separated INFO tag, with its fields as columns."""
    x = df.select(*SITE, "ref", "alt", F.explode(F.split(F.element_at("info", tag), ",")).alias("_r"))
    cut = F.split("_r", r"\|")
    return x.select("*", *[F.get(cut, F.lit(k)).alias(f) for k, f in enumerate(fields)]).drop("_r")


def likelihoods_to_probabilities(pl: Column) -> Column:
    """Genotype probabilities of Phred-scaled likelihoods (text 'a,b,c'); null where missing."""
    p = F.transform(F.split(pl, ","), lambda x: F.pow(F.lit(10.0), -x.try_cast("double") / 10))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(p, lambda x: x / total)


def dosage(gp: Column) -> Column:
    """Expected ALT alleles of three genotype probabilities."""
    return F.get(gp, F.lit(1)) + 2 * F.get(gp, F.lit(2))


def imputation_info(gp: Column) -> Column:
    """1 - mean(genotype variance) / (2 p (1 - p)) over an array of sample probabilities; 1 for monomorphic sites."""
    n = F.size(gp)
    e = F.transform(gp, dosage)
    f = F.transform(gp, lambda g: F.get(g, F.lit(1)) + 4 * F.get(g, F.lit(2)))
    p = F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / (2 * n)
    var = F.aggregate(F.zip_with(f, e, lambda a, b: a - b * b), F.lit(0.0), lambda a, x: a + x)
    return F.when((p > 0) & (p < 1), 1 - var / (2 * n * p * (1 - p))).otherwise(1.0)
