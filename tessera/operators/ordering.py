"""Sorts in unsigned, pair and custom order, order statistics and arg-min."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import Scratch

_SIGN = -(1 << 63)


def unsigned(x: Column) -> Column:
    """A sort key that orders BIGINT values as unsigned 64-bit numbers."""
    return x.bitwiseXOR(F.lit(_SIGN))


def sort_unsigned(df: DataFrame, *columns: str) -> DataFrame:
    """By columns as unsigned numbers, in their order: a pair (x, y) sorts by x, then y."""
    return df.orderBy(*(unsigned(F.col(c)) for c in columns))


def ranked(df: DataFrame, *keys: Column, name: str = "rank") -> DataFrame:
    """df with the rank of each row, from 0, in the order of the keys; rows equal in all keys may swap.

    Rows are dealt by range and sorted where they are; a partition's first rank
    is the count of the rows before it, so no task sees the whole table.
    """
    scratch = Scratch(df.sparkSession, "ranked")
    taken = [f"_key{i}" for i in range(len(keys))]
    rows = df.select("*", *(k.alias(t) for k, t in zip(keys, taken, strict=True)))
    rows = rows.repartitionByRange(*taken).sortWithinPartitions(*taken).withColumn("_at", F.monotonically_increasing_id())
    rows = scratch.write(rows.drop(*taken).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "rows")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition goes through the unpartitioned window, and is sent to every task
    starts = rows.groupBy("_part").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_start", "_at")


def sort_array_by(array: Column, less: Callable[[Column, Column], Column]) -> Column:
    """An array in the order of less(a, b), which says that a comes before b."""
    return F.array_sort(array, lambda a, b: F.when(less(a, b), F.lit(-1)).when(less(b, a), F.lit(1)).otherwise(F.lit(0)))


def kth_smallest(df: DataFrame, column: str, k: int) -> DataFrame:
    """One row with the k-th smallest value (k from 0); none beyond the last.

    Partitions are sorted by range; a count of each finds the one to look in,
    so no task ranks the whole table. The ranges are written once: two readings
    of one exchange may be dealt out differently.
    """
    x = F.col(column)
    values = df.where(x.isNotNull()).groupBy(column).count()
    ranges = Scratch(df.sparkSession, "kth").write(values.repartitionByRange(x).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(x)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition goes through the unpartitioned window
    parts = ranges.groupBy("_part").agg(F.sum("count").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).where((F.col("start") <= k) & (F.col("start") + F.col("n") > k))
    found = ranges.join(F.broadcast(parts.select("_part", "start")), "_part").withColumn("end", F.col("start") + F.sum("count").over(inside))
    return found.where((F.col("end") > k) & (F.col("end") - F.col("count") <= k)).select(x.alias(column))


def smallest(df: DataFrame, k: int, *columns: str) -> DataFrame:
    """The k first rows in order: a bounded heap in each partition, then a merge."""
    return df.orderBy(*columns).limit(k)


def median(column: str) -> Column:
    """Exact median: the mean of the two middle values."""
    return F.median(column)


def arg_min(name: Column, value: Column) -> Column:
    """The name with the smallest value; of equals, the smallest name."""
    return F.min_by(name, F.struct(value, name))
