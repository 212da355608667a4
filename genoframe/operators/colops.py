"""Column operations of grouped rows: 25 aggregates, numeric ones null where any value is not a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = ("sum", "mean", "min", "max", "absmin", "absmax", "median", "stdev", "sstdev", "mode", "antimode", "distinct_sort_num", "distinct_sort_num_desc")
TEXT = ("count", "count_distinct", "distinct", "distinct_only", "collapse", "concat", "cat", "cat_uniq", "freqasc", "freqdesc", "first", "last")
_NUMBER = r"^[0-9+\-.eE]+$"


def _number(x: Column) -> Column:
    return F.when(x.cast("string").rlike(_NUMBER), x.cast("string").try_cast("double"))


def _guarded(x: Column, agg: Column) -> Column:
    return F.when(F.count_if(x.isNotNull() & _number(x).isNull()) == 0, agg)


def simple(op: str, x: Column, order: Column, delimiter: str = ",") -> Column:
    """Aggregate for the operations that one groupBy can do; ``order`` is the input order."""
    n, text = _number(x), x.cast("string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("x")))), lambda s: s["x"])
    table = {
        "sum": lambda: _guarded(x, F.sum(n)), "mean": lambda: _guarded(x, F.avg(n)), "min": lambda: _guarded(x, F.min(n)), "max": lambda: _guarded(x, F.max(n)),
        "absmin": lambda: _guarded(x, F.min(F.abs(n))), "absmax": lambda: _guarded(x, F.max(F.abs(n))), "median": lambda: _guarded(x, F.median(n)),
        "stdev": lambda: _guarded(x, F.stddev_pop(n)), "sstdev": lambda: _guarded(x, F.stddev_samp(n)),
        "count": lambda: F.count(F.lit(1)), "count_distinct": lambda: F.count_distinct(text),
        "distinct": lambda: F.array_join(F.array_sort(F.collect_set(text)), delimiter),
        "distinct_sort_num": lambda: _guarded(x, F.array_join(F.transform(F.array_sort(F.collect_set(n)), lambda v: v.cast("string")), delimiter)),
        "distinct_sort_num_desc": lambda: _guarded(x, F.array_join(F.transform(F.sort_array(F.collect_set(n), False), lambda v: v.cast("string")), delimiter)),
        "collapse": lambda: F.array_join(ordered, delimiter), "concat": lambda: F.array_join(ordered, ""), "cat": lambda: F.array_join(ordered, ""),
        "cat_uniq": lambda: F.array_join(F.array_distinct(ordered), ""), "first": lambda: F.min_by(text, order), "last": lambda: F.max_by(text, order),
    }
    return table[op]()


TWO_STAGE = ("distinct_only", "freqasc", "freqdesc", "mode", "antimode")


def counted(df: DataFrame, keys: list[str], x: str, order: str, ops: list[str], delimiter: str = ",") -> DataFrame:
    """The operations over value counts: values are counted for each key first, then aggregated."""
    per = df.groupBy(*keys, F.col(x).cast("string").alias("_v")).agg(F.count("*").alias("_n"), F.min(order).alias("_o"))
    pair = F.concat(F.col("_v"), F.lit(":"), F.col("_n"))
    listed = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("_v").alias("v"), pair.alias("p")))), lambda s: s["p"]), delimiter)
    numeric = F.count_if(F.col("_v").isNotNull() & _number(F.col("_v")).isNull()) == 0
    table = {
        "distinct_only": F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") == 1, F.col("_v")))), delimiter),
        "freqasc": listed(F.col("_n")), "freqdesc": listed(-F.col("_n")),
        "mode": F.when(numeric, F.min_by(_number(F.col("_v")), F.struct(-F.col("_n"), "_o"))), "antimode": F.when(numeric, F.min_by(_number(F.col("_v")), F.struct("_n", "_o"))),
    }
    return per.groupBy(*keys).agg(*[table[op].alias(f"{x}_{op}") for op in ops])


def column_operations(df: DataFrame, keys: list[str], ops: list[tuple[str, str]], order: str, delimiter: str = ",") -> DataFrame:
    """One row for each key with a column ``<column>_<op>`` for each (column, op); groups are global."""
    one = [(c, o) for c, o in ops if o not in TWO_STAGE]
    out = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *[simple(o, F.col(c), F.col(order), delimiter).alias(f"{c}_{o}") for c, o in one])
    for column in dict.fromkeys(c for c, o in ops if o in TWO_STAGE):
        more = counted(df, keys, column, order, [o for c, o in ops if c == column and o in TWO_STAGE], delimiter)
        out = out.join(more, keys)
    return out.select(*keys, *[f"{c}_{o}" for c, o in ops])


def runs_of(df: DataFrame, keys: list[str], order: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``run``: the number of the run of equal consecutive keys in ``order``, within ``by`` where given."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    change = F.lit(False)
    for k in keys:
        change = change | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    return df.withColumn("_c", change.cast("int")).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def map_columns(a: DataFrame, b: DataFrame, ops: list[tuple[str, str]], order: str = "b_order", **predicates) -> DataFrame:
    """A (id) with operations over the columns of overlapping B, in B's (start, end, id) order; counts of no match are 0, others null."""
    from .overlap import intersect_pairs

    predicates.setdefault("policy", "nonempty")
    pairs = intersect_pairs(a, b, **predicates).withColumn(order, F.struct("b_start", "b_end", "b_id"))
    pairs = pairs.select(F.col("a_id").alias("id"), order, *[F.col(f"b_{c}").alias(c) for c in dict.fromkeys(c for c, _ in ops)])
    out = a.select("id").join(column_operations(pairs, ["id"], ops, order), "id", "left")
    return out.select("id", *[F.coalesce(f"{c}_{o}", F.lit(0)).alias(f"{c}_{o}") if o.startswith("count") else f"{c}_{o}" for c, o in ops])
