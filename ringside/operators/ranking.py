"""A global order as columns: places from range partitions, and the value of the row before.

Rows are dealt to range partitions of the order and sorted there; a part's first place is the sum of the
parts before it, and its first row's predecessor the last row of the part before (a boundary record).
Nothing is ordered in one task, and one key with very many rows spreads over several parts.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from ringside.session import cut_lineage


def _dealt(rows: DataFrame, order, parts) -> DataFrame:
    """Rows with _part and _nth: their range partition, and their place in it from 0."""
    columns = {f"_o{i}": x if isinstance(x, Column) else F.col(x) for i, x in enumerate(order)}
    keyed = rows.withColumns(columns)
    dealt = keyed.repartitionByRange(parts, *columns) if parts else keyed.repartitionByRange(*columns)
    dealt = dealt.sortWithinPartitions(*columns).drop(*columns)
    return cut_lineage(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))


def placed(rows: DataFrame, order, column="position", parts=None) -> DataFrame:
    """`rows` with their place in the order, from 0. The order should be total, so that places are the same each time."""
    dealt = _dealt(rows, order, parts)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # one row a part
    counts = dealt.groupBy("_part").agg((F.max("_nth") + 1).alias("_n"))
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(counts), "_part").withColumn(column, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def with_previous(rows: DataFrame, order, value, column="before", parts=None) -> DataFrame:
    """`rows` with the value of the row before in the order; null for the first row."""
    dealt = _dealt(rows.withColumn("_value", value), order, parts)
    last = dealt.groupBy("_part").agg(F.max_by("_value", "_nth").alias("_last"))
    edges = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_edge"))       # one row a part
    inside = F.lag("_value").over(Window.partitionBy("_part").orderBy("_nth"))
    return dealt.withColumn("_inside", inside).join(F.broadcast(edges), "_part").withColumn(
        column, F.when(F.col("_nth") == 0, F.col("_edge")).otherwise(F.col("_inside"))).drop("_part", "_nth", "_value", "_inside", "_edge")
