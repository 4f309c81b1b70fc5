"""Places in a sorted order, found by ranges: no single task sees all rows, no value passes the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewright.sources.tables import written


def ranked(values: DataFrame, order: Sequence[str], rank: str = "rank", following: str | None = None) -> DataFrame:
    """Rows with their place, from 0, in ascending order of the columns ``order`` (NULL first).

    ``following`` names a column for the value of the first of ``order`` in the next row, for values without NULL.

    Meant for distinct rows, written before. They are dealt into ranges, each range is counted, the counts of the ranges before it give
    its offset, and the place inside the range comes from a window over that range alone.
    """
    dealt = written(values.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_rows"), F.min(order[0]).alias("_least"))
    ranges = Window.orderBy("_range")
    offsets = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"), F.lead("_least").over(ranges).alias("_next"))
    sorted_range = Window.partitionBy("_range").orderBy(*order)
    inside = F.row_number().over(sorted_range) - 1
    placed = dealt.join(F.broadcast(offsets), "_range")  # as many rows as shuffle partitions
    places = {rank: (F.col("_offset") + inside).cast("long")}
    if following:
        places[following] = F.coalesce(F.lead(order[0]).over(sorted_range), "_next")
    return placed.withColumns(places).select(*values.columns, *places)


def level_table(df: DataFrame, col: str, weight: str | None = None) -> DataFrame:
    """The levels of a column: value, ``position`` from 1 in sorted order, ``rows``. NULL is no level. Small, read from written ranges.

    ``weight`` sums a column instead of counting rows.
    """
    rows = (F.count("*") if weight is None else F.sum(weight)).alias("rows")
    levels = written(df.filter(F.col(col).isNotNull()).groupBy(col).agg(rows))
    return ranked(levels, [col], "position").withColumn("position", F.col("position") + 1)
