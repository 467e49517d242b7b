"""Order-dependent operators: islands, running totals, first crossings, gaps, latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive integers: keys, ``first``, ``last``, ``n``. Repeated numbers count once."""
    one = df.select(*keys, number).filter(F.col(number).isNotNull()).distinct()
    marked = one.withColumn("__i", F.col(number) - F.row_number().over(W.partitionBy(*keys).orderBy(number)))
    return marked.groupBy(*keys, "__i").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("__i")


def run_strings(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """``1-3, 7`` for the numbers of each key."""
    piece = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    runs = islands(df, keys, number).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", piece.alias("p")))).alias("r"), F.sum("n").cast("bigint").alias("n"))
    return runs.select(*keys, F.array_join("r.p", ", ").alias("runs"), "n")


def flagged_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` flagged rows on end: keys, run length, first and last order value."""
    w = W.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__g", F.sum(F.when(~F.col("__f"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.filter("__f").groupBy(*keys, "__g").agg(F.count("*").alias("length"), F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last")).drop("__g").filter(F.col("length") >= least)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "running") -> DataFrame:
    """Running total of a value, nulls as nothing."""
    return df.withColumn(name, F.sum(F.coalesce(F.col(value), F.lit(0))).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def first_crossing(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, limit: float) -> DataFrame:
    """The row at which each key's running total first reaches the limit."""
    t = running(df, keys, order, value).filter(F.col("running") >= limit)
    return t.withColumn("__i", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__i = 1").drop("__i")


def gaps(df: DataFrame, keys: Sequence[str], low: str, high: str, least: float) -> DataFrame:
    """Whitespace between spans: from the furthest end so far to the next start, if wider than ``least``; cut at the middle."""
    w = W.partitionBy(*keys).orderBy(low, high).rowsBetween(W.unboundedPreceding, -1)
    t = df.withColumn("__e", F.max(high).over(w)).filter(F.col(low) - F.col("__e") > least)
    return t.select(*keys, F.col("__e").alias("gap_from"), F.col(low).alias("gap_to"), F.floor((F.col("__e") + F.col(low)) / 2).alias("cut"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__i", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__i = 1").drop("__i")


def upper_median(values: Column) -> Column:
    """Element ``n // 2`` of the sorted values, 1 at least; null for none."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.greatest(F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")), F.lit(1)))
