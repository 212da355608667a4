"""Projections of the shared star-schema tables into interval, genotype, alignment and read shapes, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHROMS, LENGTH = 200, 40_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(c: str):
    return F.datediff(F.col(c), F.lit("1992-01-01").cast("date"))


def _line_id(lines: DataFrame):
    """A number that tells line items apart: order, line, part, supplier and quantity together.

    64 bits hold it for orders up to some 1.4 million.  Where the greatest keys need more (one small
    aggregate), all ids are decimals, so that none wraps and their order stays.
    """
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    order, line, part, supplier, quantity = (int(x or 0) for x in lines.agg(*[F.max(F.abs(k)) for k in keys]).first())
    line_no, rest = F.col("l_orderkey") * 10 + F.col("l_linenumber"), (F.col("l_partkey") * 10_000 + F.col("l_suppkey")) * 64 + F.col("l_quantity").cast("long")
    scale = 1_000_000 * 10_000 * 64
    if (order * 10 + line) * scale + (part * 10_000 + supplier) * 64 + quantity < 1 << 63:
        return line_no * scale + rest
    wide = lambda c: c.cast("decimal(19,0)")
    return (wide(line_no) * F.lit(scale).cast("decimal(12,0)") + wide(rest)).cast("decimal(38,0)")


_LINE_ID = "(((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT)"


def intervals_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as intervals: id, chrom, start, end, strand, score, name."""
    start = (_days("l_shipdate") * 10).cast("long")
    strand = F.when(F.col("l_returnflag") == "R", "+").when(F.col("l_returnflag") == "A", "-").otherwise(".")
    a = table(spark, sf_dir, "lineitem")
    return a.select(
        _line_id(a).alias("id"), F.concat(F.lit("c"), F.col("l_orderkey") % CHROMS).alias("chrom"),
        start.alias("start"), (start + F.col("l_quantity").cast("int")).cast("long").alias("end"), strand.alias("strand"),
        F.col("l_extendedprice").alias("score"), F.col("l_linestatus").alias("name"),
    )


def intervals_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals: id, chrom, start, end, strand, score, name."""
    start = (_days("o_orderdate") * 10).cast("long")
    strand = F.when(F.col("o_orderstatus") == "F", "+").when(F.col("o_orderstatus") == "O", "-").otherwise(".")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("id"), F.concat(F.lit("c"), F.col("o_custkey") % CHROMS).alias("chrom"),
        start.alias("start"), (start + 1 + F.floor(F.col("o_totalprice") / 10000)).cast("long").alias("end"), strand.alias("strand"),
        F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("name"),
    )


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(CHROMS).select(F.concat(F.lit("c"), F.col("id")).alias("chrom"), F.lit(LENGTH).cast("long").alias("length"))


_A = f"""a AS (SELECT {_LINE_ID} AS id, 'c' || (l_orderkey % {CHROMS}) AS chrom,
  date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 10 AS start,
  date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 10 + CAST(l_quantity AS INT) AS "end",
  CASE l_returnflag WHEN 'R' THEN '+' WHEN 'A' THEN '-' ELSE '.' END AS strand, l_extendedprice AS score, l_linestatus AS name FROM lineitem)"""
_B = f"""b AS (SELECT o_orderkey AS id, 'c' || (o_custkey % {CHROMS}) AS chrom,
  date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 10 AS start,
  date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 10 + 1 + CAST(floor(o_totalprice / 10000) AS BIGINT) AS "end",
  CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '.' END AS strand, o_totalprice AS score, o_orderpriority AS name FROM orders)"""
_G = f"g AS (SELECT 'c' || range AS chrom, {LENGTH}::BIGINT AS length FROM range({CHROMS}))"
#: Pairs of overlapping intervals by a plain range join; no interval of the views is empty.
_P = """p AS (SELECT a.id AS a_id, a.chrom, a.start AS a_start, a."end" AS a_end, a.strand AS a_strand, b.id AS b_id, b.start AS b_start, b."end" AS b_end,
  b.strand AS b_strand, b.score AS b_score, b.name AS b_name, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end",
  least(a."end", b."end") - greatest(a.start, b.start) AS overlap
  FROM a JOIN b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end")"""


def sql(body: str, *more: str) -> str:
    """A query over the views a, b, g (genome) and p (overlapping pairs), with further common table expressions."""
    return "WITH " + ",\n".join([_A, _B, _G, _P, *more]) + "\n" + body


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of parts as genotypes: chrom, pos, sample, a1, a2 (null: missing), dp, gq; the first line of each site and sample."""
    from pyspark.sql import Window

    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.select(
        F.concat(F.lit("p"), F.col("p_size") % 20).alias("chrom"), (F.col("p_partkey") + 1).alias("pos"), (F.col("l_suppkey") % 12).cast("int").alias("sample"),
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.floor(F.col("l_discount") * 1000 + 0.5).cast("int").alias("gq"),
    )
    first = Window.partitionBy("chrom", "pos", "sample").orderBy("l_orderkey", "l_linenumber")
    x = x.withColumn("r", F.row_number().over(first)).filter("r = 1")
    called = F.col("q") <= 47
    return x.select("chrom", "pos", "sample", F.when(called, F.col("l_linenumber") % 2).cast("int").alias("a1"), F.when(called, F.col("q") % 2).cast("int").alias("a2"), F.col("q").alias("dp"), "gq")


_GT = """v AS (SELECT chrom, pos, sample, CASE WHEN q <= 47 THEN l_linenumber % 2 END AS a1, CASE WHEN q <= 47 THEN q % 2 END AS a2, q AS dp, gq FROM (
  SELECT 'p' || (p_size % 20) AS chrom, p_partkey + 1 AS pos, CAST(l_suppkey % 12 AS INT) AS sample, l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q,
         CAST(floor(l_discount * 1000 + 0.5) AS INT) AS gq, row_number() OVER (PARTITION BY p_size % 20, p_partkey, l_suppkey % 12 ORDER BY l_orderkey, l_linenumber) AS r
  FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE r = 1)"""


def gt_sql(body: str, *more: str) -> str:
    """A query over the genotype view v."""
    return "WITH " + ",\n".join([_GT, *more]) + "\n" + body


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as alignments: id, qname, flag, rname, pos (1-based), mapq, len, tlen, mate_pos, quality (sum)."""
    a = table(spark, sf_dir, "lineitem")
    start = (_days("l_shipdate") * 10).cast("long")
    q = F.col("l_quantity").cast("int")
    flag = (
        F.lit(1) + F.when(F.col("l_linenumber") % 3 != 0, 2).otherwise(0) + F.when(q % 17 == 0, 4).otherwise(0) + F.when(q % 19 == 0, 8).otherwise(0)
        + F.when(F.col("l_returnflag") == "A", 16).otherwise(0) + F.when(F.col("l_returnflag") == "R", 32).otherwise(0)
        + F.when(F.col("l_linenumber") % 2 == 1, 64).otherwise(128) + F.when(q % 23 == 0, 256).otherwise(0) + F.when(q % 29 == 0, 512).otherwise(0)
        + F.when(q % 13 == 0, 1024).otherwise(0) + F.when(q % 31 == 0, 2048).otherwise(0)
    )
    return a.select(
        _line_id(a).alias("id"), F.concat(F.lit("r"), F.col("l_orderkey")).alias("qname"), flag.cast("int").alias("flag"),
        F.concat(F.lit("c"), F.col("l_orderkey") % 20).alias("rname"), (start + 1).alias("pos"), F.floor(F.col("l_tax") * 750 + 0.5).cast("int").alias("mapq"),
        q.alias("len"), (start + F.col("l_suppkey") % 300).alias("mate_pos"), F.floor(F.col("l_extendedprice")).cast("long").alias("quality"),
    )


_AL = f"""al AS (SELECT {_LINE_ID} AS id, 'r' || l_orderkey AS qname,
  1 + CASE WHEN l_linenumber % 3 <> 0 THEN 2 ELSE 0 END + CASE WHEN q % 17 = 0 THEN 4 ELSE 0 END + CASE WHEN q % 19 = 0 THEN 8 ELSE 0 END
  + CASE WHEN l_returnflag = 'A' THEN 16 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 32 ELSE 0 END
  + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN q % 23 = 0 THEN 256 ELSE 0 END + CASE WHEN q % 29 = 0 THEN 512 ELSE 0 END
  + CASE WHEN q % 13 = 0 THEN 1024 ELSE 0 END + CASE WHEN q % 31 = 0 THEN 2048 ELSE 0 END AS flag,
  'c' || (l_orderkey % 20) AS rname, d * 10 + 1 AS pos, CAST(floor(l_tax * 750 + 0.5) AS INT) AS mapq, q AS len, d * 10 + l_suppkey % 300 AS mate_pos,
  CAST(floor(l_extendedprice) AS BIGINT) AS quality
  FROM (SELECT *, CAST(l_quantity AS INT) AS q, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem))"""


def al_sql(body: str, *more: str) -> str:
    """A query over the alignment view al."""
    return "WITH " + ",\n".join([_AL, *more]) + "\n" + body


_BASES = ("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTNCGTACGTACGTAC")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reads: id, seq (letters of the whole text as bases), qual (characters '!' to 'I' from the same letters)."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.translate(letters, *_BASES).alias("seq"), F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "IHGFEDCBA@?>=<;:9876543210").alias("qual"),
    )


_RD = f"""rd AS (SELECT doc_id AS id, translate(x, '{_BASES[0]}', '{_BASES[1]}') AS seq, translate(x, '{_BASES[0]}', 'IHGFEDCBA@?>=<;:9876543210') AS qual
  FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS x FROM documents))"""


def rd_sql(body: str, *more: str) -> str:
    """A query over the read view rd."""
    return "WITH " + ",\n".join([_RD, *more]) + "\n" + body
