"""Read queries over the read view, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import reads as R
from .views import rd_sql, reads

_r = lambda c, n=6: F.round(F.col(c).cast("double"), n).alias(c)


def composition(spark, d):
    return R.composition(reads(spark, d)).select("id", "length", "a", "c", "g", "t", "n4", "cpg", _r("gc"))


def read_size(spark, d):
    return R.size(reads(spark, d))


def per_cycle(spark, d):
    return R.per_cycle(reads(spark, d)).select("cycle", "bases", "a", "c", "g", "t", "n", _r("mean_quality"), "q20", "q30")


def quality_totals(spark, d):
    return R.quality_totals(reads(spark, d)).select("reads", "bases", "q20", "q30", "gc", _r("mean_length"))


def kmer_counts(spark, d):
    return R.kmer_counts(reads(spark, d), 5)


def canonical_kmers(spark, d):
    return R.kmer_counts(reads(spark, d), 4, canonical=True)


def kmer_neighbours(spark, d):
    return R.kmer_neighbours(reads(spark, d), "ACGTA")


def read_filter(spark, d):
    x = reads(spark, d).withColumn("reason", R.filter_reason((200, 20_000), gc=(30, 52), max_n=400, min_quality=24.0, max_low=(15, 0.12), min_changed=0.5))
    return x.select("id", "reason")


def deduplicate(spark, d):
    return R.deduplicate(reads(spark, d), reverse=True).select("id")


def duplication(spark, d):
    return R.duplication(reads(spark, d))


def assembly_n(spark, d):
    return R.assembly_n(reads(spark, d))


def runs_of_base(spark, d):
    return R.runs_of_base(reads(spark, d), "N+", 2)


def reverse_complements(spark, d):
    return R.mate_complement(reads(spark, d)).select("id", F.md5("reverse_complement").alias("reverse_complement"), F.md5(S.homopolymer_compressed(F.col("seq"))).alias("compressed"))


def subsequences(spark, d):
    x = reads(spark, d)
    regions = x.filter(F.length("seq") >= 60).select(F.col("id").alias("chrom"), F.lit(10).cast("long").alias("start"), F.lit(50).cast("long").alias("end"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"))
    return R.subsequences(x, regions).select("chrom", "start", "end", "seq")


def nucleotides(spark, d):
    x = reads(spark, d)
    regions = x.filter(F.length("seq") >= 60).select(F.col("id").alias("chrom"), F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("end"))
    return R.nucleotides(regions, x, "ACA").select("chrom", _r("at_share"), _r("gc_share"), "n_n", "length", "matches")


def dust(spark, d):
    return reads(spark, d).select("id", F.round(S.dust_score(F.col("seq")), 6).alias("dust"))


def mott_trim(spark, d):
    return R.trim(reads(spark, d), "mott", error=0.01).select("id", "start", "end")


def sliding_trim(spark, d):
    return R.trim(reads(spark, d), "sliding", threshold=26.0, share=0.02).select("id", "start", "end")


def adapter_trim(spark, d):
    return R.trim(reads(spark, d), "adapter", adapter="ACGTACGTACGT").select("id", "end")


def poly_trim(spark, d):
    return R.trim(reads(spark, d), "poly_tail", base="A", least=3).select("id", "end")


_EACH = "e AS (SELECT id, unnest(string_split(seq, '')) AS b, unnest(string_split(qual, '')) AS q, generate_subscripts(string_split(seq, ''), 1) AS cycle FROM rd WHERE seq <> '')"
_K = "k AS (SELECT id, substring(seq, i, {k}) AS kmer FROM (SELECT id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM rd WHERE length(seq) >= {k}))"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_NEAR = """nb AS (SELECT DISTINCT x FROM (SELECT substring('ACGTA', 1, i - 1) || b || substring('ACGTA', i + 1) AS x FROM range(1, 6) t(i), (SELECT unnest(['A', 'C', 'G', 'T']) AS b))),
nn AS (SELECT x AS kmer FROM nb UNION SELECT reverse(translate(x, 'ACGT', 'TGCA')) FROM nb)"""

QUERIES = {
    "composition": (composition, rd_sql("""SELECT id, length(seq) AS length, length(seq) - length(replace(seq, 'A', '')) AS a, length(seq) - length(replace(seq, 'C', '')) AS c,
      length(seq) - length(replace(seq, 'G', '')) AS g, length(seq) - length(replace(seq, 'T', '')) AS t, length(seq) - length(replace(seq, 'N', '')) AS n4, (length(seq) - length(replace(seq, 'CG', ''))) // 2 AS cpg,
      round((length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / nullif(length(replace(seq, 'N', '')), 0), 6) AS gc FROM rd""")),
    "read_size": (read_size, rd_sql("SELECT count(*) AS reads, sum(length(seq))::BIGINT AS bases FROM rd")),
    "per_cycle": (per_cycle, rd_sql("""SELECT cycle, count(*) AS bases, count(*) FILTER (b = 'A') AS a, count(*) FILTER (b = 'C') AS c, count(*) FILTER (b = 'G') AS g, count(*) FILTER (b = 'T') AS t,
      count(*) FILTER (b = 'N') AS n, round(avg(ascii(q) - 33), 6) AS mean_quality, count(*) FILTER (ascii(q) >= 53) AS q20, count(*) FILTER (ascii(q) >= 63) AS q30 FROM e GROUP BY cycle""", _EACH)),
    "quality_totals": (quality_totals, rd_sql("""SELECT (SELECT count(*) FROM rd) AS reads, count(*) AS bases, count(*) FILTER (ascii(q) >= 53) AS q20, count(*) FILTER (ascii(q) >= 63) AS q30,
      count(*) FILTER (b IN ('G', 'C')) AS gc, round(count(*) / (SELECT count(*) FROM rd), 6) AS mean_length FROM e""", _EACH)),
    "kmer_counts": (kmer_counts, rd_sql("SELECT kmer, count(*) AS n FROM k GROUP BY kmer", _K.format(k=5))),
    "canonical_kmers": (canonical_kmers, rd_sql(f"SELECT least(kmer, {_RC.format('kmer')}) AS kmer, count(*) AS n FROM k GROUP BY 1", _K.format(k=4))),
    "kmer_neighbours": (kmer_neighbours, rd_sql("SELECT nn.kmer, count(k.id) AS n FROM nn LEFT JOIN k USING (kmer) GROUP BY nn.kmer", _K.format(k=5), _NEAR)),
    "read_filter": (read_filter, rd_sql("""SELECT id, CASE WHEN n < 200 OR n > 20000 THEN 'length' WHEN 100.0 * gc / acgt < 30 OR 100.0 * gc / acgt > 52 THEN 'gc' WHEN n - acgt > 400 THEN 'n' WHEN sq / n < 24 THEN 'quality'
      WHEN low > 0.12::DOUBLE * n THEN 'low_bases' WHEN (n - 1 - same) / (n - 1) < 0.5 THEN 'complexity' END AS reason FROM (
      SELECT rd.id, length(seq) AS n, length(replace(seq, 'N', '')) AS acgt, length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')) AS gc, sq, low, same FROM rd LEFT JOIN (
        SELECT id, sum(ascii(q) - 33) AS sq, count(*) FILTER (ascii(q) < 48) AS low, count(*) FILTER (b = p) AS same FROM (SELECT *, lag(b) OVER (PARTITION BY id ORDER BY cycle) AS p FROM e) GROUP BY id) USING (id))""", _EACH)),
    "deduplicate_reads": (deduplicate, rd_sql(f"SELECT min(id) AS id FROM rd GROUP BY least(seq, {_RC.format('seq')})")),
    "duplication": (duplication, rd_sql("SELECT copies, count(*) AS sequences FROM (SELECT count(*) AS copies FROM rd GROUP BY seq) GROUP BY copies")),
    "assembly_n": (assembly_n, rd_sql("""SELECT share, max(n) AS length FROM (SELECT n, sum(b) OVER (ORDER BY n DESC) AS upto, (SELECT sum(length(seq)) FROM rd) AS total FROM (
      SELECT length(seq) AS n, sum(length(seq)) AS b FROM rd GROUP BY 1)), (SELECT unnest([50, 75, 90]) AS share) WHERE upto * 100 >= share * total GROUP BY share""")),
    "runs_of_base": (runs_of_base, rd_sql("""SELECT id, min(cycle) - 1 AS start, max(cycle) AS "end", 'N' AS b FROM (
      SELECT *, cycle - row_number() OVER (PARTITION BY id ORDER BY cycle) AS k FROM e WHERE b = 'N') GROUP BY id, k HAVING count(*) >= 2""", _EACH)),
    "reverse_complements": (reverse_complements, rd_sql(f"SELECT id, md5({_RC.format('seq')}) AS reverse_complement, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g'), 'N+', 'N', 'g')) AS compressed FROM rd")),
    "subsequences": (subsequences, rd_sql(f"""SELECT id AS chrom, 10 AS start, 50 AS "end", CASE WHEN id % 2 = 0 THEN substring(seq, 11, 40) ELSE {_RC.format('substring(seq, 11, 40)')} END AS seq FROM rd WHERE length(seq) >= 60""")),
    "nucleotides": (nucleotides, rd_sql("""SELECT id AS chrom, round((length(seq) - length(replace(replace(seq, 'A', ''), 'T', ''))) / length(seq), 6) AS at_share,
      round((length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq), 6) AS gc_share, length(seq) - length(replace(seq, 'N', '')) AS n_n, length(seq) AS length, coalesce(m, 0) AS matches
      FROM rd LEFT JOIN (SELECT id, count(*) AS m FROM k WHERE kmer = 'ACA' GROUP BY id) USING (id) WHERE length(seq) >= 60""", _K.format(k=3))),
    "dust": (dust, rd_sql("""SELECT rd.id, round(CASE WHEN length(seq) >= 3 THEN s * 10.0 / (length(seq) - 2) END, 6) AS dust FROM rd LEFT JOIN (
      SELECT id, sum(n * (n - 1) / 2) AS s FROM (SELECT id, kmer, count(*) AS n FROM k GROUP BY ALL) GROUP BY id) USING (id)""", _K.format(k=3))),
    "mott_trim": (mott_trim, None),
    "sliding_trim": (sliding_trim, None),
    "adapter_trim": (adapter_trim, None),
    "poly_trim": (poly_trim, None),
}
