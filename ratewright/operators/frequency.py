"""Counts, shares, cross tables and the independence test.

Records are always counted per group first (with map-side combine); shares,
margins and tests are then computed on the counts. Every table also takes rows
that are counts already (``weight``), so many tables can share one pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewright.functions.text import percent_text
from ratewright.operators.joins import keyed_join, look_up
from ratewright.operators.reshape import expand_levels
from ratewright.sources.tables import written


# Column of the values that are missing or not listed.
MISSING = "NA"


def count_by(df: DataFrame, *keys: Column | str, name: str = "n", weight: str | None = None) -> DataFrame:
    """Rows per observed key combination, or the sum of ``weight`` where rows are counts already."""
    return df.groupBy(*keys).agg((F.count("*") if weight is None else F.sum(weight)).alias(name))


def weighted_count(df: DataFrame, keys: Sequence[Column | str], weight: Column | str, name: str = "n") -> DataFrame:
    """Sum of a weight per key combination; keys may be expressions."""
    return df.groupBy(*keys).agg(F.sum(weight).alias(name))


def without_margins(df: DataFrame, margins: dict[str, str]) -> DataFrame:
    """Rows without total members such as ``sex = 'Total'``, which would be counted twice."""
    for col, member in margins.items():
        df = df.filter(F.coalesce(F.col(col) != member, F.lit(True)))
    return df


def total_of(counts: DataFrame, n: Column | str = "n") -> Column:
    """Grand total as a scalar subquery; it reuses the shuffle of ``counts`` when that holds only counts."""
    return counts.agg(F.sum(n)).scalar()


def share_of_total(counts: DataFrame, n: str = "n", out: str = "pct") -> DataFrame:
    return counts.withColumn(out, F.col(n) / total_of(counts, n))


def share_within(counts: DataFrame, stratum: Sequence[str], n: str = "n", out: str = "pct") -> DataFrame:
    """Share of a count in the total of its stratum.

    Meant for counts: a window partition then holds one row per category, however
    many records the stratum has.
    """
    return counts.withColumn(out, F.col(n) / F.sum(n).over(Window.partitionBy(*stratum)))


def frequency(df: DataFrame, col: str, digits: int = 1, weight: str | None = None) -> DataFrame:
    """One-way table: n, share of all rows, share of rows with a value, share as text."""
    counts = count_by(df, col, weight=weight)
    valid = total_of(counts, F.when(F.col(col).isNotNull(), F.col("n")))
    shares = share_of_total(counts).withColumn(
        "valid_pct", F.when(F.col(col).isNotNull(), F.col("n") / valid)
    )
    return shares.withColumn("pct_text", percent_text("pct", digits))


def free_name(name: str, taken: Sequence) -> str:
    """``name``, with as many ``_`` behind it as make it none of the taken ones."""
    while name in taken:
        name += "_"
    return name


def cross_table(
    df: DataFrame,
    row: str,
    col: str,
    levels: Sequence[str] | None = None,
    total: str | None = None,
    weight: str | None = None,
    margin: str | None = None,
) -> DataFrame:
    """Two-way table: one row per level of ``row``, one zero-filled column per level of ``col``.

    ``n_<level>`` counts and ``p_<level>`` shares of the row; ``total`` adds a
    row of column sums under that label, told apart by the boolean column
    ``margin``. Without that column a level of the same name is an error. The
    records are scanned and shuffled once: the margin is a rollup of the counts,
    not a second pass. Every row is counted: those whose ``col`` is NULL or not
    listed are in ``n_NA`` (``n_NA_`` if ``NA`` is a level), and those whose
    ``row`` is NULL are a row of the table. Without ``levels`` the table is
    long, as ``cross_cells`` gives it.
    """
    if levels is None:
        return cross_cells(df, row, col, total, weight, margin or "margin")
    counts = count_by(df, row, col, weight=weight)
    missing = free_name(MISSING, levels)
    listed = F.coalesce(F.col(col).isin(list(levels)), F.lit(False)) if levels else F.lit(False)
    cells = [F.sum(F.when(F.col(col) == v, F.col("n")).otherwise(0)).alias(f"n_{v}") for v in levels]
    cells.append(F.sum(F.when(listed, 0).otherwise(F.col("n"))).alias(f"n_{missing}"))
    levels = [*levels, missing]
    if total is None:
        wide = counts.groupBy(row).agg(*cells)
    else:
        wide = _with_total(counts.rollup(row).agg(*cells, F.grouping(row).alias("_margin")), row, total, margin)
    row_sum = reduce(add, [F.col(f"`n_{v}`") for v in levels])
    return wide.select("*", *[(F.col(f"`n_{v}`") / row_sum).alias(f"p_{v}") for v in levels])


def _with_total(rolled: DataFrame, row: str, total: str, margin: str | None) -> DataFrame:
    """Rows of a rollup with the total's label; ``_margin`` is 1 on them."""
    is_total = F.col("_margin") == 1
    if margin is None:
        clash = F.raise_error(F.lit(f"a level of {row} is called like the total row, {total}; name a margin column")).cast("string")
        level = F.when(F.col(row).cast("string") == total, clash).otherwise(F.col(row).cast("string"))
        return rolled.withColumn(row, F.when(is_total, F.lit(total)).otherwise(level)).drop("_margin")
    labelled = F.when(is_total, F.lit(total)).otherwise(F.col(row).cast("string"))
    return rolled.withColumn(row, labelled).withColumn(margin, is_total).drop("_margin")


def cross_cells(
    df: DataFrame,
    row: str,
    col: str,
    total: str | None = None,
    weight: str | None = None,
    margin: str = "margin",
) -> DataFrame:
    """Long two-way table: a row per level of ``row`` and level of ``col``, ``n`` (zero-filled) and ``pct``, its share of the row.

    For levels that are not known beforehand, or are more than a table can have
    columns: none passes the driver. Missing values stay NULL, so a level called
    ``NA`` is a level like any other. ``total`` adds the column sums under that
    label; ``margin`` is true on those rows and false on a level of that name.
    """
    counts = written(count_by(df, row, col, weight=weight))
    sums = counts.groupBy(row).agg(F.sum("n").alias("_row_n"))
    cells = keyed_join(expand_levels(sums, counts, col), counts, [row, col])
    table = cells.select(row, col, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "_row_n", F.lit(False).alias(margin))
    if total is not None:
        table = table.withColumn(row, F.col(row).cast("string"))
        grand = total_of(counts).cast("long")
        bottom = counts.groupBy(col).agg(F.sum("n").cast("long").alias("n"))
        table = table.unionByName(bottom.select(F.lit(total).alias(row), col, "n", grand.alias("_row_n"), F.lit(True).alias(margin)))
    return table.withColumn("pct", F.col("n") / F.col("_row_n")).drop("_row_n")


def summary_by_group(df: DataFrame, by: str, include: str, digits: int = 1, weight: str | None = None) -> DataFrame:
    """Levels of ``include`` within each group of ``by``: n, column share, group size and share.

    Combinations that do not occur are listed with zero. ``pct`` is the share of
    the whole group, ``valid_pct`` that of the rows with a known level; a
    missing level is a row of its own, without ``valid_pct``. The counts are
    written first, so the records are read once for the cells and their levels.
    """
    counts = written(count_by(df, by, include, weight=weight))
    known = F.col(include).isNotNull()
    groups = counts.groupBy(by).agg(F.sum("n").alias("group_n"), F.sum(F.when(known, F.col("n"))).alias("_known"))
    groups = groups.withColumn("group_pct", F.col("group_n") / total_of(groups, "group_n"))
    cells = expand_levels(groups, counts, include)
    table = keyed_join(cells, counts, [by, include]).select(
        by, include, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "group_n", "group_pct", "_known"
    )
    valid = F.when(known & (F.col("_known") > 0), F.col("n") / F.col("_known"))
    table = table.withColumns({"pct": F.col("n") / F.col("group_n"), "valid_pct": valid}).drop("_known")
    return table.withColumn("group_text", percent_text("group_pct", digits)).withColumn(
        "pct_text", percent_text("pct", digits)
    )


def top_k(df: DataFrame, keys: Sequence[str], k: int, digits: int = 1, weight: str | None = None) -> DataFrame:
    """The k most frequent key combinations with their share; ties in key order."""
    counts = share_of_total(count_by(df, *keys, weight=weight))
    ranked = counts.orderBy(F.desc("n"), *keys).limit(k)
    return ranked.withColumn("pct_text", percent_text("pct", digits))


def chi_square(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Pearson independence test of two categorical columns, one row.

    ``statistic``, ``df``, ``p_value`` and ``n``, without continuity
    correction. Only observed cells are needed: a cell that does not occur adds
    its expected count, and those add up to n minus the expected counts of the
    observed cells.
    """
    counts = written(count_by(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b, weight=weight))
    cells = _with_margin(_with_margin(counts, a, "_row"), b, "_col")
    expected = F.col("_row").cast("double") * F.col("_col") / total_of(counts)
    residual = F.col("n") - expected
    sums = cells.agg(
        F.sum(residual * residual / expected).alias("_observed"),
        F.sum(expected).alias("_expected"),
        F.sum("n").alias("n"),
        F.count("*").alias("_cells"),
        F.sum(1 / F.col("_row_cells")).alias("_row_share"),
        F.sum(1 / F.col("_col_cells")).alias("_col_share"),
    )
    # Every member adds one over its number of cells as often as it has cells: the sum is the number of members.
    rows, cols = F.round("_row_share").cast("long"), F.round("_col_share").cast("long")
    sums = sums.withColumns({"_rows": rows, "_cols": cols})
    empty = F.when(F.col("_cells") < F.col("_rows") * F.col("_cols"), F.col("n") - F.col("_expected")).otherwise(0.0)
    test = sums.select(
        (F.col("_observed") + empty).alias("statistic"),
        ((F.col("_rows") - 1) * (F.col("_cols") - 1)).alias("df"),
        "n",
    )
    return test.withColumn("p_value", chi_square_tail("statistic", "df"))


def _with_margin(counts: DataFrame, member: str, name: str) -> DataFrame:
    """Counts with the total of their member and its number of cells; a member with very many cells is broadcast."""
    margin = counts.groupBy(member).agg(F.sum("n").alias(name), F.count("*").alias(f"{name}_cells"))
    margin = written(margin.withColumn("_rows", F.col(f"{name}_cells")).withColumnRenamed(member, "_member"))
    keyed = counts.withColumn("_member", F.col(member))
    return look_up(keyed, "_member", margin, "_rows").drop("_member")


@F.pandas_udf(T.DoubleType())
def chi_square_tail(statistic: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution (called on one row per test)."""
    return pd.Series([_tail(x, int(k)) for x, k in zip(statistic, df)])


def _tail(x: float, df: int) -> float:
    """Regularised upper incomplete gamma function Q(df / 2, x / 2), in log space at any size.

    A series below the mean, a continued fraction (Lentz) above it; both need about the square root of ``df`` terms.
    """
    if df < 1 or not x >= 0:
        return float("nan")
    if x == 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    a, y = df / 2, x / 2
    front = a * math.log(y) - y - math.lgamma(a)
    if y < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= y / k
            total += term
        return min(max(1 - math.exp(front + math.log(total)), 0.0), 1.0)
    tiny = 1e-300
    b = y + 1 - a
    c, d = 1 / tiny, 1 / b
    fraction, i = d, 0
    while True:
        i += 1
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        fraction *= d * c
        if abs(d * c - 1) < 1e-15:
            return min(max(math.exp(front + math.log(fraction)), 0.0), 1.0)
