"""Places of rows in an order, whatever the size of a group."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

_ROW = (1 << 33) - 1  # monotonically_increasing_id: the task above the lower 33 bits, the row of the task in them


def number_rows(df: DataFrame, order: Iterable[Column | str], within: Iterable[str] = (), name: str = "place") -> DataFrame:
    """df with each row's place, from 0, in `order` among the rows of its group (`within`; nulls are a group; none: all rows).

    The rows are dealt into ranges of (group, order) by sampled bounds, sorted there and written to the shared folder. A place is
    the row's own inside its range, plus the counts of the group's ranges before it. So a group of any size, or of equal keys as
    long as `order` ends in something that differs, is as many tasks as it needs; only a row for each range and group is summed
    up. Rows that tie in the whole order get neighbouring places, either way round.
    """
    within, order = list(within), list(order)
    keys = [*(F.col(c) for c in within), *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = staged(ranged, "ranges").withColumn("_range", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit(_ROW)))
    counts = ranged.groupBy(*within, "_range").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    offsets = counts.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_g{k}") for k, c in enumerate(within)), offset.alias("_offset"))
    same = F.col("_range") == F.col("_r")
    for k, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return ranged.join(offsets, same).select(*df.columns, (F.col("_row") + F.col("_offset")).alias(name))
