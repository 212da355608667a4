"""Column layouts of the data model; coordinates are 0-based half-open LONGs once ingested."""

from __future__ import annotations

from pyspark.sql import types as T

INTERVAL = T.StructType(
    [
        T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("name", T.StringType()), T.StructField("score", T.StringType()), T.StructField("strand", T.StringType()),
    ]
)
GENOME = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("length", T.LongType())])
READ = T.StructType([T.StructField("id", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType())])
#: One row for each site and sample; a null allele is missing.
GENOTYPE = T.StructType(
    [
        T.StructField("chrom", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("ref", T.StringType()), T.StructField("alt", T.StringType()),
        T.StructField("sample", T.StringType()), T.StructField("a1", T.IntegerType()), T.StructField("a2", T.IntegerType()), T.StructField("dp", T.IntegerType()),
    ]
)
