"""Interval queries over the shared tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import colops, interval_stats, nearest, overlap, sweep, transform
from .views import genome, intervals_a, intervals_b, sql

_r = lambda c, n=6: F.round(F.col(c).cast("double"), n).alias(c)


def overlap_join(spark, d):
    """Overlapping pairs with their clipped interval and overlap."""
    return overlap.intersect(intervals_a(spark, d), intervals_b(spark, d)).select("a_id", "b_id", F.col("a_chrom").alias("chrom"), "start", "end", "overlap")


def left_overlap(spark, d):
    x = overlap.intersect(intervals_a(spark, d), intervals_b(spark, d), "left")
    return x.select("a_id", "b_id", "overlap")


def semi_overlap(spark, d):
    return overlap.intersect(intervals_a(spark, d), intervals_b(spark, d), "semi").select("id", "chrom", "start", "end")


def anti_overlap(spark, d):
    return overlap.intersect(intervals_a(spark, d), intervals_b(spark, d), "anti").select("id", "chrom", "start", "end")


def count_overlap(spark, d):
    return overlap.intersect(intervals_a(spark, d), intervals_b(spark, d), "count").select("id", "hits")


def fraction_overlap(spark, d):
    return overlap.intersect(intervals_a(spark, d), intervals_b(spark, d), f=0.5, reciprocal=True).select("a_id", "b_id", "overlap")


def either_fraction_overlap(spark, d):
    return overlap.intersect(intervals_a(spark, d), intervals_b(spark, d), f=0.9, F_=0.9, either=True).select("a_id", "b_id")


def same_strand_overlap(spark, d):
    return overlap.intersect(intervals_a(spark, d), intervals_b(spark, d), strand="same").select("a_id", "b_id")


def opposite_strand_overlap(spark, d):
    return overlap.intersect(intervals_a(spark, d), intervals_b(spark, d), strand="opposite").select("a_id", "b_id")


def window_join(spark, d):
    return overlap.window(intervals_a(spark, d), intervals_b(spark, d), left=15, right=40, by_strand=True).select("a_id", "b_id")


def multi_count(spark, d):
    b = intervals_b(spark, d)
    sets = {f"n_{k}": b.filter(F.col("strand") == s) for k, s in (("plus", "+"), ("minus", "-"), ("none", "."))}
    return overlap.multi_count(intervals_a(spark, d), sets).select("id", *sets)


def tag_labels(spark, d):
    return overlap.tag(intervals_a(spark, d), intervals_b(spark, d)).select("id", "labels")


def merge_intervals(spark, d):
    return sweep.merge(intervals_a(spark, d), aggs=[F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score")])


def merge_gap_strand(spark, d):
    return sweep.merge(intervals_a(spark, d), gap=25, by_strand=True, aggs=[F.count("*").alias("n")])


def cluster_intervals(spark, d):
    return sweep.cluster(intervals_a(spark, d)).select("id", "cluster")


def complement_intervals(spark, d):
    return sweep.complement(intervals_a(spark, d), genome(spark, d))


def spacing_intervals(spark, d):
    return sweep.spacing(intervals_a(spark, d)).select("id", "spacing")


def subtract_intervals(spark, d):
    return sweep.subtract(intervals_a(spark, d), intervals_b(spark, d))


def subtract_whole(spark, d):
    return sweep.subtract(intervals_a(spark, d), intervals_b(spark, d), whole=True, f=0.5)


def subtract_union(spark, d):
    return sweep.subtract(intervals_a(spark, d), intervals_b(spark, d), n=0.5)


def depth_bedgraph(spark, d):
    return sweep.genome_coverage(intervals_a(spark, d), genome(spark, d), "bg").select("chrom", "start", "end", F.col("depth").cast("long").alias("depth"))


def depth_bedgraph_all(spark, d):
    return sweep.genome_coverage(intervals_a(spark, d), genome(spark, d), "bga").select("chrom", "start", "end", F.col("depth").cast("long").alias("depth"))


def depth_histogram(spark, d):
    return sweep.genome_coverage(intervals_a(spark, d), genome(spark, d), "hist").select("chrom", "depth", "bases", "length", _r("fraction", 9))


def depth_positions(spark, d):
    return sweep.genome_coverage(intervals_b(spark, d), genome(spark, d), "dz").groupBy("chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"), F.sum("depth").alias("depth"))


def depth_five_prime(spark, d):
    return sweep.genome_coverage(intervals_a(spark, d), genome(spark, d), "bg", end="5").select("chrom", "start", "end", F.col("depth").cast("long").alias("depth"))


def multi_intersect(spark, d):
    b = intervals_b(spark, d)
    x = sweep.multi_intersect({"a": intervals_a(spark, d), "p": b.filter("strand = '+'"), "m": b.filter("strand = '-'")})
    return x.select("chrom", "start", "end", F.col("n").cast("int").alias("n"), "names")


def union_bedgraph(spark, d):
    depth = lambda x: sweep.depth_runs(x).filter("depth > 0").withColumnRenamed("depth", "value")
    return sweep.union_bedgraph({"x": depth(intervals_a(spark, d)), "y": depth(intervals_b(spark, d))}).select("chrom", "start", "end", "x", "y")


def slop_intervals(spark, d):
    return transform.slop(intervals_a(spark, d), genome(spark, d), 30, 100, by_strand=True).select("id", "start", "end")


def flank_intervals(spark, d):
    return transform.flank(intervals_a(spark, d), genome(spark, d), 20, 50).select("id", "start", "end")


def shift_intervals(spark, d):
    return transform.shift(intervals_a(spark, d), genome(spark, d), 500, minus=-700).select("id", "start", "end")


def make_windows(spark, d):
    return transform.make_windows(intervals_a(spark, d), width=10, step=7).select("id", "start", "end", "nth")


def make_windows_number(spark, d):
    return transform.make_windows(intervals_a(spark, d), number=4, reverse=True).select("id", "start", "end", "nth")


def closest_intervals(spark, d):
    return nearest.closest(intervals_a(spark, d), intervals_b(spark, d)).select("a_id", "b_id", "distance")


def closest_three(spark, d):
    return nearest.closest(intervals_a(spark, d), intervals_b(spark, d), k=3, same_strand=True, ignore_overlaps=True).select("a_id", "b_id", "distance")


def closest_first(spark, d):
    return nearest.closest(intervals_a(spark, d), intervals_b(spark, d), ties="first", ignore_right=True).select("a_id", "b_id", "distance")


def relative_distance(spark, d):
    return nearest.relative_distance(intervals_a(spark, d), intervals_b(spark, d))


def coverage(spark, d):
    return interval_stats.coverage(intervals_a(spark, d), intervals_b(spark, d)).select("id", "hits", "covered", _r("fraction"))


def coverage_depth(spark, d):
    return interval_stats.depth_summary(intervals_a(spark, d), intervals_b(spark, d)).select("id", _r("mean"), _r("median"), F.col("min").cast("long").alias("min"), F.col("max").cast("long").alias("max"), F.col("sum").cast("long").alias("sum"))


def coverage_histogram(spark, d):
    return interval_stats.coverage_histogram(intervals_a(spark, d), intervals_b(spark, d)).select(F.col("depth").cast("long").alias("depth"), "bases", "length", _r("fraction", 9))


def jaccard(spark, d):
    return interval_stats.jaccard(intervals_a(spark, d), intervals_b(spark, d)).select("intersection", "union", _r("jaccard", 9), "n")


def fisher(spark, d):
    return interval_stats.fisher(intervals_a(spark, d), intervals_b(spark, d), genome(spark, d))


def interval_summary(spark, d):
    x = interval_stats.summary(intervals_a(spark, d), genome(spark, d))
    return x.select("chrom", "n", "bp", "min", "max", _r("mean"), _r("n_fraction", 9), _r("bp_fraction", 9))


def annotate(spark, d):
    b = intervals_b(spark, d)
    return interval_stats.annotate(intervals_a(spark, d), {"plus": b.filter("strand = '+'"), "minus": b.filter("strand = '-'")}).select("id", _r("plus"), _r("minus"))


_OPS = [("score", o) for o in ("sum", "mean", "min", "max", "median", "stdev", "sstdev", "absmin", "absmax")] + [
    ("name", o) for o in ("count", "count_distinct", "distinct", "distinct_only", "first", "last", "freqasc", "freqdesc", "sum")
] + [("len", o) for o in ("mode", "antimode", "distinct_sort_num", "collapse", "cat_uniq")]


def column_operations(spark, d):
    b = intervals_b(spark, d).withColumn("len", F.col("end") - F.col("start"))
    x = colops.column_operations(b, ["chrom"], _OPS, "id")
    return x.select("chrom", *[F.round(F.col(f"{c}_{o}").cast("double"), 4).alias(f"{c}_{o}") if c == "score" or o in ("mode", "antimode") or (c, o) == ("name", "sum") else F.col(f"{c}_{o}") for c, o in _OPS if o != "distinct_sort_num"])


def map_scores(spark, d):
    x = colops.map_columns(intervals_a(spark, d), intervals_b(spark, d), [("score", "sum"), ("score", "max"), ("name", "count"), ("name", "collapse")])
    return x.select("id", _r("score_sum", 2), _r("score_max", 2), "name_count", "name_collapse")


def _pairs(df):
    """Intervals with their shifted twin as paired intervals."""
    return df.select("id", F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), F.col("end").alias("end1"), F.col("strand").alias("strand1"), F.col("chrom").alias("chrom2"), (F.col("start") + 200).alias("start2"), (F.col("end") + 200).alias("end2"), F.col("strand").alias("strand2"))


def pair_to_bed(spark, d):
    return overlap.pair_to_bed(_pairs(intervals_a(spark, d)), intervals_b(spark, d), "xor").select("id")


def pair_to_pair(spark, d):
    return overlap.pair_to_pair(_pairs(intervals_a(spark, d)), _pairs(intervals_b(spark, d)), "both", slop=5)


def block_intervals(spark, d):
    a = intervals_a(spark, d)
    size = F.floor((F.col("end") - F.col("start") + 1) / 2)
    a = a.withColumns({"block_sizes": F.concat(size, F.lit(","), size, F.lit(",")), "block_starts": F.concat(F.lit("0,"), F.col("end") - F.col("start") - size, F.lit(","))})
    return transform.blocks(a).select("id", "start", "end", "nth")


def block_overlap(spark, d):
    """Two outer blocks of each interval, a gap between them."""
    a = intervals_a(spark, d).filter(F.col("end") - F.col("start") >= 6)
    n = F.floor((F.col("end") - F.col("start")) / 3)
    a = a.withColumns({"block_sizes": F.concat(n, F.lit(","), n), "block_starts": F.concat(F.lit("0,"), F.col("end") - F.col("start") - n)})
    return overlap.intersect_blocks(transform.blocks(a), intervals_b(spark, d), f=0.5)


def consecutive_groups(spark, d):
    """Runs of equal strand within a chromosome in (start, id) order, with their sums."""
    a = intervals_a(spark, d).withColumn("ord", F.struct("start", "id"))
    runs = colops.runs_of(a, ["strand"], "ord", ["chrom"])
    return runs.groupBy("chrom", "run").agg(F.first("strand").alias("strand"), F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score"))


_ISLAND = """i AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, "end", id) AS island FROM (
  SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM a))"""
_SWEEP = """ev AS (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, start AS pos, 1 AS d FROM a UNION ALL SELECT chrom, "end", -1 FROM a) GROUP BY ALL HAVING sum(d) <> 0),
runs AS (SELECT * FROM (SELECT chrom, pos AS start, lead(pos) OVER w AS "end", sum(d) OVER w AS depth FROM ev WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE "end" IS NOT NULL),
allruns AS (SELECT chrom, start, "end", depth FROM runs
  UNION ALL SELECT g.chrom, 0, coalesce(f, length), 0 FROM g LEFT JOIN (SELECT chrom, min(start) AS f FROM runs GROUP BY chrom) USING (chrom) WHERE coalesce(f, length) > 0
  UNION ALL SELECT g.chrom, l, length, 0 FROM g JOIN (SELECT chrom, max("end") AS l FROM runs GROUP BY chrom) USING (chrom) WHERE l < length)"""
_SLOT = 'SELECT a_id, count(*) AS hits, sum(overlap) AS bp FROM p GROUP BY a_id'
_COVERED = """pc AS (SELECT a_id, sum(e - s) AS covered FROM (SELECT a_id, island, min(start) AS s, max("end") AS e FROM (
   SELECT *, sum(fresh) OVER (PARTITION BY a_id ORDER BY start, "end", b_id) AS island FROM (
     SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY a_id ORDER BY start, "end", b_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM p))
   GROUP BY ALL) GROUP BY a_id)"""
#: Depth of B at every base of A.
_BASES = """base AS (SELECT a.id, count(b.id) AS depth FROM (SELECT id, chrom, unnest(range(start, "end")) AS pos FROM a) a LEFT JOIN
  (SELECT id, chrom, unnest(range(start, "end")) AS pos FROM b) b ON a.chrom = b.chrom AND a.pos = b.pos GROUP BY a.id, a.pos)"""
_PAIRS = """pa AS (SELECT id, chrom, start, "end", strand, w FROM (SELECT *, 1 AS w FROM a UNION ALL SELECT id, chrom, start + 200, "end" + 200, strand, score, name, 2 FROM a)),
pb AS (SELECT id, chrom, start, "end", strand, w FROM (SELECT *, 1 AS w FROM b UNION ALL SELECT id, chrom, start + 200, "end" + 200, strand, score, name, 2 FROM b))"""
_FREQ = """fq AS (SELECT chrom, name, count(*) AS n FROM b GROUP BY ALL),
ln AS (SELECT chrom, "end" - start AS len, count(*) AS n, min(id) AS o FROM b GROUP BY ALL),
ls AS (SELECT chrom, string_agg(CAST("end" - start AS VARCHAR), ',' ORDER BY id) AS len_collapse FROM b GROUP BY chrom),
lu AS (SELECT chrom, string_agg(CAST(len AS VARCHAR), '' ORDER BY o) AS len_cat_uniq, CAST(arg_min(len, [-n, o]) AS DOUBLE) AS len_mode, CAST(arg_min(len, [n, o]) AS DOUBLE) AS len_antimode FROM ln GROUP BY chrom),
fs AS (SELECT chrom, string_agg(name || ':' || n, ',' ORDER BY n, name) AS name_freqasc, string_agg(name || ':' || n, ',' ORDER BY n DESC, name) AS name_freqdesc,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (n = 1), '') AS name_distinct_only, string_agg(name, ',' ORDER BY name) AS name_distinct FROM fq GROUP BY chrom)"""


#: The sets' bases, one row each; runs of equal values at consecutive bases are the segments.
_FLAGS = """fl AS (SELECT chrom, pos, bool_or(k = 'a') AS a, bool_or(k = 'm') AS m, bool_or(k = 'p') AS p FROM (
  SELECT chrom, 'a' AS k, unnest(range(start, "end")) AS pos FROM a UNION ALL
  SELECT chrom, CASE strand WHEN '+' THEN 'p' ELSE 'm' END, unnest(range(start, "end")) FROM b WHERE strand <> '.') GROUP BY chrom, pos),
fs AS (SELECT *, concat_ws(',', CASE WHEN a THEN 'a' END, CASE WHEN m THEN 'm' END, CASE WHEN p THEN 'p' END) AS names, CAST(a AS INT) + CAST(m AS INT) + CAST(p AS INT) AS n FROM fl)"""
_XY = """xy AS (SELECT chrom, pos, count(*) FILTER (k = 'x')::DOUBLE AS x, count(*) FILTER (k = 'y')::DOUBLE AS y FROM (
  SELECT chrom, 'x' AS k, unnest(range(start, "end")) AS pos FROM a UNION ALL SELECT chrom, 'y', unnest(range(start, "end")) FROM b) GROUP BY chrom, pos)"""


def _merged(name: str, source: str) -> str:
    return f"""{name} AS (SELECT chrom, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, "end", id) AS island FROM (
      SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source}))
      GROUP BY chrom, island)"""


def _near(k: int, pred: str = "TRUE", overlaps: bool = True, right: bool = True) -> str:
    keep = [x for x, on in (("d = 0", overlaps), ("d < 0", True), ("d > 0", right)) if on]
    return f"""n AS (SELECT a_id, b_id, d, b_start, b_end, rank() OVER (PARTITION BY a_id ORDER BY abs(d)) AS r FROM (
  SELECT a.id AS a_id, b.id AS b_id, b.start AS b_start, b."end" AS b_end, CASE WHEN b."end" <= a.start THEN -(a.start - b."end" + 1) WHEN b.start >= a."end" THEN b.start - a."end" + 1 ELSE 0 END AS d
  FROM a JOIN b ON a.chrom = b.chrom AND {pred}) WHERE {' OR '.join(keep)} QUALIFY r <= {k})"""


QUERIES = {
    "overlap_join": (overlap_join, sql('SELECT a_id, b_id, chrom, start, "end", overlap FROM p')),
    "left_overlap": (left_overlap, sql("SELECT a.id AS a_id, b_id, coalesce(overlap, 0) AS overlap FROM a LEFT JOIN p ON a.id = a_id")),
    "semi_overlap": (semi_overlap, sql('SELECT id, chrom, start, "end" FROM a WHERE id IN (SELECT a_id FROM p)')),
    "anti_overlap": (anti_overlap, sql('SELECT id, chrom, start, "end" FROM a WHERE id NOT IN (SELECT a_id FROM p)')),
    "count_overlap": (count_overlap, sql(f"SELECT id, coalesce(hits, 0) AS hits FROM a LEFT JOIN ({_SLOT}) ON id = a_id")),
    "fraction_overlap": (fraction_overlap, sql("SELECT a_id, b_id, overlap FROM p WHERE overlap >= 0.5 * (a_end - a_start) AND overlap >= 0.5 * (b_end - b_start)")),
    "either_fraction_overlap": (either_fraction_overlap, sql("SELECT a_id, b_id FROM p WHERE overlap >= 0.9::DOUBLE * (a_end - a_start) OR overlap >= 0.9::DOUBLE * (b_end - b_start)")),
    "same_strand_overlap": (same_strand_overlap, sql("SELECT a_id, b_id FROM p WHERE a_strand = b_strand AND a_strand <> '.'")),
    "opposite_strand_overlap": (opposite_strand_overlap, sql("SELECT a_id, b_id FROM p WHERE a_strand <> b_strand AND a_strand <> '.' AND b_strand <> '.'")),
    "window_join": (window_join, sql("""SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.chrom = b.chrom
      AND greatest(0, a.start - CASE WHEN a.strand = '-' THEN 40 ELSE 15 END) < b."end" AND b.start < a."end" + CASE WHEN a.strand = '-' THEN 15 ELSE 40 END""")),
    "multi_count": (multi_count, sql("""SELECT a.id, count(*) FILTER (b_strand = '+') AS n_plus, count(*) FILTER (b_strand = '-') AS n_minus, count(*) FILTER (b_strand = '.') AS n_none
      FROM a LEFT JOIN p ON a.id = a_id GROUP BY a.id""")),
    "tag_labels": (tag_labels, sql("SELECT a.id, string_agg(DISTINCT b_name, ',' ORDER BY b_name) AS labels FROM a LEFT JOIN p ON a.id = a_id GROUP BY a.id")),
    "merge_intervals": (merge_intervals, sql('SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n, round(sum(score), 2) AS score FROM i GROUP BY chrom, island', _ISLAND)),
    "merge_gap_strand": (merge_gap_strand, sql("""SELECT chrom, strand, min(start) AS start, max("end") AS "end", count(*) AS n FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY chrom, strand ORDER BY start, "end", id) AS island FROM (
        SELECT *, CASE WHEN start <= 25 + max("end") OVER (PARTITION BY chrom, strand ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
        FROM a WHERE strand <> '.')) GROUP BY chrom, strand, island""")),
    "cluster_intervals": (cluster_intervals, sql("SELECT id, dense_rank() OVER (ORDER BY chrom, island) AS cluster FROM i", _ISLAND)),
    "complement_intervals": (complement_intervals, sql('SELECT chrom, start, "end" FROM allruns WHERE depth = 0', _SWEEP)),
    "spacing_intervals": (spacing_intervals, sql("""SELECT id, CASE WHEN start < b THEN -1 ELSE start - b END AS spacing FROM (
      SELECT *, lag("end") OVER (PARTITION BY chrom ORDER BY start, "end", id) AS b FROM a)""")),
    "subtract_intervals": (subtract_intervals, sql("""SELECT id, chrom, s AS start, e AS "end" FROM (
      SELECT id, chrom, coalesce(max("end") OVER (PARTITION BY id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a_start) AS s, start AS e FROM (
        SELECT a_id AS id, chrom, a_start, start, "end" FROM p UNION ALL SELECT id, chrom, start, "end", "end" FROM a)) WHERE s < e""")),
    "subtract_whole": (subtract_whole, sql('SELECT id, chrom, start, "end" FROM a WHERE id NOT IN (SELECT a_id FROM p WHERE overlap >= 0.5 * (a_end - a_start))')),
    "subtract_union": (subtract_union, sql('SELECT id, chrom, start, "end" FROM a LEFT JOIN pc ON id = a_id WHERE coalesce(covered, 0) <= 0.5 * ("end" - start)', _COVERED)),
    "depth_bedgraph": (depth_bedgraph, sql('SELECT chrom, start, "end", depth::BIGINT AS depth FROM runs WHERE depth > 0', _SWEEP)),
    "depth_bedgraph_all": (depth_bedgraph_all, sql('SELECT chrom, start, "end", depth::BIGINT AS depth FROM allruns', _SWEEP)),
    "depth_histogram": (depth_histogram, sql(f"""SELECT chrom, depth, bases, length, round(bases / length, 9) AS fraction FROM (
      SELECT chrom, depth::BIGINT AS depth, sum("end" - start)::BIGINT AS bases, 40000 AS length FROM allruns GROUP BY chrom, depth
      UNION ALL SELECT 'genome', depth::BIGINT, sum("end" - start)::BIGINT, 40000 * 200 FROM allruns GROUP BY depth)""", _SWEEP)),
    "depth_positions": (depth_positions, sql("""SELECT chrom, count(*) AS n, sum(pos)::BIGINT AS pos, sum(depth)::BIGINT AS depth FROM (
      SELECT chrom, pos, count(*) AS depth FROM (SELECT chrom, unnest(range(start, "end")) AS pos FROM b) GROUP BY ALL) GROUP BY chrom""")),
    "depth_five_prime": (depth_five_prime, sql("""SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", depth FROM (
      SELECT *, pos - row_number() OVER (PARTITION BY chrom, depth ORDER BY pos) AS k FROM (
        SELECT chrom, CASE WHEN strand = '-' THEN "end" - 1 ELSE start END AS pos, count(*) AS depth FROM a GROUP BY ALL)) GROUP BY chrom, depth, k""")),
    "multi_intersect": (multi_intersect, sql("""SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", n, names FROM (
      SELECT *, pos - row_number() OVER (PARTITION BY chrom, names ORDER BY pos) AS k FROM fs) GROUP BY chrom, n, names, k""", _FLAGS)),
    "union_bedgraph": (union_bedgraph, sql("""SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", x, y FROM (
      SELECT *, pos - row_number() OVER (PARTITION BY chrom, x, y ORDER BY pos) AS k FROM xy) GROUP BY chrom, x, y, k""", _XY)),
    "slop_intervals": (slop_intervals, sql("""SELECT id, greatest(0, least(start - CASE WHEN strand = '-' THEN 100 ELSE 30 END, 39999)) AS start,
      least(40000, greatest("end" + CASE WHEN strand = '-' THEN 30 ELSE 100 END, 1)) AS "end" FROM a""")),
    "flank_intervals": (flank_intervals, sql("""SELECT * FROM (SELECT id, greatest(0, start - 20) AS start, start AS "end" FROM a
      UNION ALL SELECT id, least("end", 40000), least("end" + 50, 40000) FROM a) WHERE start < "end" """)),
    "shift_intervals": (shift_intervals, sql("""SELECT id, greatest(0, least(start + d, 39999)) AS start, least(40000, greatest("end" + d, 1)) AS "end" FROM (
      SELECT *, CASE WHEN strand = '-' THEN -700 ELSE 500 END AS d FROM a)""")),
    "make_windows": (make_windows, sql("""SELECT id, start + k * 7 AS start, least(start + k * 7 + 10, "end") AS "end", k + 1 AS nth FROM (
      SELECT *, unnest(range(0, ("end" - start - 1) // 7 + 1)) AS k FROM a)""")),
    "make_windows_number": (make_windows_number, sql("""SELECT id, start + k * s AS start, CASE WHEN k = 3 THEN "end" ELSE start + (k + 1) * s END AS "end", 4 - k AS nth FROM (
      SELECT *, ("end" - start) // 4 AS s, unnest(range(0, 4)) AS k FROM a WHERE "end" - start >= 4)""")),
    "closest_intervals": (closest_intervals, sql("SELECT a.id AS a_id, b_id, d AS distance FROM a LEFT JOIN n ON a.id = a_id", _near(1))),
    "closest_three": (closest_three, sql("SELECT a.id AS a_id, b_id, d AS distance FROM a LEFT JOIN n ON a.id = a_id", _near(3, "a.strand = b.strand AND a.strand <> '.'", overlaps=False))),
    "closest_first": (closest_first, sql("""SELECT a.id AS a_id, b_id, d AS distance FROM a LEFT JOIN (
      SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY b_start, b_end, b_id) = 1) ON a.id = a_id""", _near(1, right=False))),
    "relative_distance": (relative_distance, sql("""SELECT least(50, floor(least(m - l, r - m) / (r - l) * 100 + 1e-9))::BIGINT AS bin, count(*) AS n FROM (
      SELECT m, (SELECT max(x) FROM mb WHERE mb.chrom = ma.chrom AND x <= m) AS l, (SELECT min(x) FROM mb WHERE mb.chrom = ma.chrom AND x > m) AS r FROM ma)
      WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY ALL""",
      'ma AS (SELECT chrom, (start + "end") // 2 AS m FROM a)', 'mb AS (SELECT DISTINCT chrom, (start + "end") // 2 AS x FROM b)')),
    "coverage": (coverage, sql("""SELECT id, coalesce(hits, 0) AS hits, coalesce(covered, 0)::BIGINT AS covered, round(coalesce(covered, 0) / ("end" - start), 6) AS fraction
      FROM a LEFT JOIN pc ON id = pc.a_id LEFT JOIN (SELECT a_id, count(*) AS hits FROM p GROUP BY a_id) h ON id = h.a_id""", _COVERED)),
    "coverage_depth": (coverage_depth, sql("""SELECT id, round(avg(depth), 6) AS mean, round(median(depth)::DOUBLE, 6) AS median, min(depth) AS min, max(depth) AS max, sum(depth)::BIGINT AS sum
      FROM base GROUP BY id""", _BASES)),
    "coverage_histogram": (coverage_histogram, sql("""SELECT depth, count(*) AS bases, (SELECT count(*) FROM base) AS length, round(count(*) / (SELECT count(*) FROM base), 9) AS fraction
      FROM base GROUP BY depth""", _BASES)),
    "jaccard": (jaccard, sql("""SELECT i AS intersection, la + lb - i AS "union", round(i / (la + lb - i), 9) AS jaccard, n FROM
      (SELECT sum(least(ma."end", mb."end") - greatest(ma.start, mb.start))::BIGINT AS i, count(*) AS n FROM ma JOIN mb ON ma.chrom = mb.chrom AND ma.start < mb."end" AND mb.start < ma."end"),
      (SELECT sum("end" - start)::BIGINT AS la FROM ma), (SELECT sum("end" - start)::BIGINT AS lb FROM mb)""", _merged("ma", "a"), _merged("mb", "b"))),
    "fisher": (fisher, None),
    "interval_summary": (interval_summary, sql("""SELECT chrom, n, bp, min, max, round(mean, 6) AS mean, round(n / (SELECT count(*) FROM a), 9) AS n_fraction,
      round(bp / (SELECT sum("end" - start) FROM a), 9) AS bp_fraction FROM (
      SELECT g.chrom, count(start) AS n, coalesce(sum("end" - start), 0)::BIGINT AS bp, min("end" - start) AS min, max("end" - start) AS max, avg("end" - start) AS mean FROM g LEFT JOIN a USING (chrom) GROUP BY g.chrom
      UNION ALL SELECT 'all', count(*), sum("end" - start)::BIGINT, min("end" - start), max("end" - start), avg("end" - start) FROM a)""")),
    "annotate": (annotate, sql("""SELECT a.id, round(coalesce(plus, 0) / ("end" - start), 6) AS plus, round(coalesce(minus, 0) / ("end" - start), 6) AS minus FROM a LEFT JOIN (
      SELECT a_id, count(DISTINCT CASE WHEN b_strand = '+' THEN pos END) AS plus, count(DISTINCT CASE WHEN b_strand = '-' THEN pos END) AS minus
      FROM (SELECT a_id, b_strand, unnest(range(start, "end")) AS pos FROM p) GROUP BY a_id) ON a.id = a_id""")),
    "column_operations": (column_operations, sql("""SELECT b.chrom, round(sum(score), 4) AS score_sum, round(avg(score), 4) AS score_mean, round(min(score), 4) AS score_min, round(max(score), 4) AS score_max,
      round(median(score), 4) AS score_median, round(stddev_pop(score), 4) AS score_stdev, round(stddev_samp(score), 4) AS score_sstdev, round(min(abs(score)), 4) AS score_absmin,
      round(max(abs(score)), 4) AS score_absmax, count(*) AS name_count, count(DISTINCT name) AS name_count_distinct, any_value(name_distinct) AS name_distinct, any_value(name_distinct_only) AS name_distinct_only,
      arg_min(name, id) AS name_first, arg_max(name, id) AS name_last, any_value(name_freqasc) AS name_freqasc, any_value(name_freqdesc) AS name_freqdesc, NULL::DOUBLE AS name_sum,
      any_value(len_mode) AS len_mode, any_value(len_antimode) AS len_antimode, any_value(len_collapse) AS len_collapse, any_value(len_cat_uniq) AS len_cat_uniq
      FROM b JOIN fs USING (chrom) JOIN lu USING (chrom) JOIN ls USING (chrom) GROUP BY b.chrom""", _FREQ)),
    "map_scores": (map_scores, sql("""SELECT a.id, round(sum(b_score), 2) AS score_sum, round(max(b_score), 2) AS score_max, count(b_id) AS name_count,
      string_agg(b_name, ',' ORDER BY b_start, b_end, b_id) AS name_collapse FROM a LEFT JOIN p ON a.id = a_id GROUP BY a.id""")),
    "pair_to_bed": (pair_to_bed, sql("""SELECT id FROM (SELECT pa.id, bool_or(w = 1) AS h1, bool_or(w = 2) AS h2 FROM pa JOIN b ON pa.chrom = b.chrom AND pa.start < b."end" AND b.start < pa."end" GROUP BY pa.id)
      WHERE coalesce(h1, FALSE) <> coalesce(h2, FALSE)""", _PAIRS)),
    "pair_to_pair": (pair_to_pair, sql("""SELECT a_id, b_id FROM (SELECT pa.id AS a_id, pb.id AS b_id, bit_or(CASE WHEN pa.w = 1 THEN CASE WHEN pb.w = 1 THEN 1 ELSE 2 END ELSE CASE WHEN pb.w = 1 THEN 4 ELSE 8 END END) AS bits
      FROM pa JOIN pb ON pa.chrom = pb.chrom AND pa.start - 5 < pb."end" AND pb.start < pa."end" + 5 AND (pa.strand = '.' OR pb.strand = '.' OR pa.strand = pb.strand) GROUP BY ALL)
      WHERE bits & 9 = 9 OR bits & 6 = 6""", _PAIRS)),
    "block_intervals": (block_intervals, sql("""SELECT id, start + CASE WHEN k = 1 THEN 0 ELSE "end" - start - s END AS start, start + CASE WHEN k = 1 THEN s ELSE "end" - start END AS "end", k AS nth
      FROM (SELECT *, ("end" - start + 1) // 2 AS s, unnest([1, 2]) AS k FROM a)""")),
    "block_overlap": (block_overlap, sql("""SELECT a_id, b_id, sum(o)::BIGINT AS overlap FROM bo WHERE a_id IN (SELECT a_id FROM bu WHERE n >= 0.5 * 2 * size) GROUP BY a_id, b_id""",
      """bl AS (SELECT id, chrom, (("end" - start) // 3) AS size, CASE WHEN k = 1 THEN start ELSE "end" - ("end" - start) // 3 END AS start, CASE WHEN k = 1 THEN start + ("end" - start) // 3 ELSE "end" END AS "end"
        FROM (SELECT *, unnest([1, 2]) AS k FROM a WHERE "end" - start >= 6))""",
      """bo AS (SELECT bl.id AS a_id, b.id AS b_id, size, greatest(bl.start, b.start) AS s, least(bl."end", b."end") AS e, least(bl."end", b."end") - greatest(bl.start, b.start) AS o
        FROM bl JOIN b ON bl.chrom = b.chrom AND bl.start < b."end" AND b.start < bl."end")""",
      "bu AS (SELECT a_id, size, count(DISTINCT q) AS n FROM (SELECT a_id, size, unnest(range(s, e)) AS q FROM bo) GROUP BY a_id, size)")),
    "consecutive_groups": (consecutive_groups, sql("""SELECT chrom, run, any_value(strand) AS strand, count(*) AS n, round(sum(score), 2) AS score FROM (
      SELECT *, sum(c) OVER (PARTITION BY chrom ORDER BY start, id)::BIGINT AS run FROM (
        SELECT *, CASE WHEN strand IS DISTINCT FROM lag(strand) OVER (PARTITION BY chrom ORDER BY start, id) THEN 1 ELSE 0 END AS c FROM a)) GROUP BY chrom, run""")),
}
