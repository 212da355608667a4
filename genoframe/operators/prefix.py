"""Running sums and maxima that spread one key over many tasks, by tiles whose totals are carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a tile; no task has to hold more than one tile of one key.
TILE = 1 << 20


def ahead_of(by: tuple[str, ...]):
    """Window over tile totals: the tiles before this one."""
    return Window.partitionBy(*by).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, by: tuple[str, ...], tile: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in (tile, order), within ``by``."""
    keys = [*by, "_tile"]
    df = df.withColumns({"_tile": tile, "_value": value})
    totals = df.groupBy(*keys).agg(F.sum("_value").alias("_total")).select(*keys, F.coalesce(F.sum("_total").over(ahead_of(by)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(totals, keys).withColumn(out, F.col("_base") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_tile", "_value", "_base")
