"""Column-set operators: names, empty columns, matching columns, keys."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.functions.text import snake_names, united


def clean_names(df: DataFrame) -> DataFrame:
    """Columns renamed to unique ASCII snake case."""
    return df.toDF(*snake_names(df.columns))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed old -> new."""
    return df.withColumnsRenamed(names)


def rename_at(df: DataFrame, first: int, names: Sequence[str]) -> DataFrame:
    """Consecutive columns renamed by position, starting at ``first`` (0-based)."""
    if first + len(names) > len(df.columns):
        raise ValueError("more names than columns")
    return df.toDF(*df.columns[:first], *names, *df.columns[first + len(names) :])


def crossed_names(labels: Sequence[str], years: Sequence[int], sep: str = "_") -> list[str]:
    """label_year names, labels running fastest."""
    return [f"{label}{sep}{year}" for year in years for label in labels]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value in any row (one aggregate pass)."""
    filled = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c, any_value in zip(df.columns, filled) if not any_value])


def across(df: DataFrame, pattern: str, change: Callable[[Column], Column], suffix: str = "") -> DataFrame:
    """Apply one expression to every column whose name matches a pattern."""
    return df.withColumns({c + suffix: change(F.col(f"`{c}`")) for c in df.columns if re.search(pattern, c)})


def unite(df: DataFrame, cols: list[str], out: str, sep: str = "_", remove: bool = False) -> DataFrame:
    """Join columns into one key. The inputs stay unless ``remove`` is set."""
    df = df.withColumn(out, united(cols, sep))
    return df.drop(*[c for c in cols if c != out]) if remove else df
