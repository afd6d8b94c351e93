"""Places in an order and running counts that no single task has to sort all rows for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.tables import materialize


def _ranged(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """df by ranges of keys of any type, sorted, with the range (_part) and the place within it (_in)."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(placed.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)


def _before(df: DataFrame, by: Sequence[str], size) -> DataFrame:
    """(by, _part, _base): what the parts before have; as many rows as there are parts and groups in them."""
    parts = df.groupBy(*by, "_part").agg(size.alias("_all"))
    w = Window.partitionBy(*by).orderBy("_part") if by else Window.orderBy("_part")
    return parts.select(*by, "_part", (F.sum("_all").over(w) - F.col("_all")).alias("_base"))


def running_counts(df: DataFrame, by: Sequence[str], order: str, to: str) -> DataFrame:
    """(by, order, to): for each value of order, how many rows of its group have it or a lower one."""
    each = _ranged(df.groupBy(*by, order).agg(F.count("*").alias("_n")), [*by, order], "running-counts")
    within = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy(order))
    return each.withColumn("_upto", within).join(_before(each, by, F.sum("_n")), [*by, "_part"]).select(*by, order, (F.col("_base") + F.col("_upto")).alias(to))


def numbered(df: DataFrame, order: str, to: str = "doc_pos") -> DataFrame:
    """Adds the row's place by order, from 0, nulls first. Rows that are equal in order are placed by a hash of all their columns."""
    placed = _ranged(df.withColumn("_tie", F.xxhash64(*df.columns)), [order, "_tie"], "numbered")
    return placed.join(F.broadcast(_before(placed, [], F.count("*"))), "_part").withColumn(to, F.col("_base") + F.col("_in")).select(*df.columns, to)
