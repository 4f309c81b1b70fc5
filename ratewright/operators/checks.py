"""Checks that report instead of hiding: coverage, overlaps, unmatched rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.sources.tables import union_by_name


def join_coverage(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with their rows on each side.

    Both sides are counted per key before they meet, so a key that holds most
    rows is one row in the shuffle.
    """
    return _rows_per_key(left, right, keys).filter((F.col("left_rows") == 0) | (F.col("right_rows") == 0))


def coverage_summary(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and rows by where the key is found: both, left or right."""
    side = F.when(F.col("right_rows") == 0, "left").when(F.col("left_rows") == 0, "right").otherwise("both")
    return (
        _rows_per_key(left, right, keys)
        .groupBy(side.alias("side"))
        .agg(
            F.count("*").alias("keys"),
            F.sum("left_rows").alias("left_rows"),
            F.sum("right_rows").alias("right_rows"),
        )
    )


def _rows_per_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    sides = [
        left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")),
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")),
    ]
    return union_by_name(sides).groupBy(*keys).agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"))


def source_overlap(df: DataFrame, period: Column | str, source: str) -> DataFrame:
    """Rows per period and source, with the number of sources the period occurs in.

    A period in two sources may be counted twice.
    """
    period = F.col(period) if isinstance(period, str) else period
    counts = df.groupBy(period.alias("period"), F.col(source).alias("source")).agg(F.count("*").alias("n"))
    return counts.withColumn("sources", F.count("*").over(Window.partitionBy("period")))


def null_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows and NULLs per column, one pass, one output row per column."""
    counted = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(c)).alias(c) for c in cols])
    return counted.unpivot(["_rows"], list(cols), "column", "_known").select(
        "column", F.col("_rows").alias("n"), (F.col("_rows") - F.col("_known")).alias("n_null")
    )
