"""Long and wide tables, grids, interpolation, keyed column binding."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.sources.tables import union_by_name, written


def wide_to_long(
    df: DataFrame, values: Sequence[str], ids: Sequence[str] | None = None, name: str = "name", value: str = "value"
) -> DataFrame:
    """One row per id and value column."""
    ids = list(ids) if ids is not None else [c for c in df.columns if c not in values]
    return df.unpivot(ids, list(values), name, value)


def long_to_wide(
    df: DataFrame, ids: Sequence[str], name: str, value: str, levels: Sequence[str]
) -> DataFrame:
    """One column per level of ``name``; keys must be unique per level."""
    return df.groupBy(*ids).agg(*[F.max(F.when(F.col(name) == v, F.col(value))).alias(str(v)) for v in levels])


def split_name(df: DataFrame, col: str, into: Sequence[str], sep: str = "_") -> DataFrame:
    """Split a text column into fields; a wrong number of pieces is an error."""
    parts = F.split(F.col(col), re.escape(sep))
    wrong = F.concat(F.lit(f"{col} does not have {len(into)} pieces: "), F.col(col))
    checked = F.when((F.size(parts) == len(into)) | F.col(col).isNull(), parts).otherwise(
        F.raise_error(wrong).cast("array<string>")
    )
    return (
        df.withColumn("_parts", checked)
        .withColumns({n: F.col("_parts")[i] for i, n in enumerate(into)})
        .drop("_parts", *([] if col in into else [col]))
    )


def complete_grid(
    df: DataFrame,
    nest: Sequence[str],
    cross: dict[str, Sequence | None],
    dates: tuple[str, Column, Column, str] | None = None,
) -> DataFrame:
    """Observed ``nest`` combinations x all levels of each ``cross`` column x a date sequence.

    Levels come from the list given, or are the observed ones when it is None;
    then the distinct combinations are written first and read for both. Each
    factor is expanded in place by a generator, so the grid is built without a
    shuffle beyond the distinct combinations. ``dates`` is (column, first, last,
    step) with a step such as ``1 month``.
    """
    observed = [col for col, levels in cross.items() if levels is None]
    if observed:
        df = written(df.select(*nest, *observed).distinct())
    grid = df.select(*nest).distinct()
    for col, levels in cross.items():
        if levels is not None:
            grid = grid.withColumn(col, F.explode(F.array(*[F.lit(v) for v in levels])))
        else:
            grid = expand_levels(grid, df, col)
    if dates is not None:
        col, first, last, step = dates
        grid = grid.withColumn(col, F.explode(F.sequence(first, last, F.expr(f"interval {step}"))))
    return grid


def expand_levels(grid: DataFrame, df: DataFrame, col: str) -> DataFrame:
    """Each grid row once per distinct value of ``df``'s ``col``; ``df`` is written or cheap to read.

    The levels are packed into chunks of about a thousand, and the grid rows
    meet every chunk through an equi join. The number of chunks is a scalar
    subquery: no level passes the driver, and nothing runs before the table does.
    """
    levels = df.select(col).distinct()
    chunks = F.greatest(F.lit(1), F.floor(levels.agg(F.count("*")).scalar() / 1000)).cast("int")
    packed = (
        levels.groupBy(F.pmod(F.xxhash64(col), chunks).cast("int").alias("_chunk"))
        .agg(F.collect_list(F.struct(col)).alias("_levels"))
    )
    spread = grid.withColumn("_chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return (
        spread.join(packed, "_chunk")
        .withColumn("_level", F.explode("_levels"))
        .withColumn(col, F.col(f"_level.{col}"))
        .drop("_chunk", "_levels", "_level")
    )


def interpolate(
    df: DataFrame, series: Sequence[str], at: str, value: str, out: str
) -> DataFrame:
    """Fill NULLs of a dated series on the line between its neighbours by days.

    NULL before the first and after the last known value. Both windows share
    one shuffle by ``series``; the second only re-sorts, because a frame that
    runs to the end of the partition would cost a rescan per row.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).cast("double").alias("v")))
    back = Window.partitionBy(*series).orderBy(F.col(at)).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*series).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumn("_before", F.last(known, ignorenulls=True).over(back)).withColumn(
        "_after", F.last(known, ignorenulls=True).over(ahead)
    )
    span = F.datediff("_after.t", "_before.t")
    line = F.col("_before.v") + (F.col("_after.v") - F.col("_before.v")) * F.datediff(F.col(at), "_before.t") / span
    result = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(span > 0, line)
    return filled.withColumn(out, result).drop("_before", "_after")


def bind_keyed(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Columns of several same-keyed tables side by side.

    Rows are matched by key, not by position. Every table contributes its value
    columns to one union that is grouped once, so binding n tables costs one
    shuffle rather than n - 1 full joins. A key that occurs twice in a table is
    an error.
    """
    marked = [p.withColumn(f"_rows_{i}", F.lit(1)) for i, p in enumerate(parts)]
    values = [c for p in parts for c in p.columns if c not in keys]
    if len(values) != len(set(values)):
        raise ValueError("value columns must differ between the tables")
    counts = [F.sum(f"_rows_{i}").alias(f"_rows_{i}") for i in range(len(parts))]
    bound = union_by_name(marked).groupBy(*keys).agg(*[F.max(F.col(f"`{v}`")).alias(v) for v in values], *counts)
    most = [F.coalesce(F.col(f"_rows_{i}"), F.lit(0)) for i in range(len(parts))]
    repeated = F.greatest(*most, F.lit(0)) > 1
    guard = F.when(repeated, F.raise_error(F.lit("a key occurs twice in one table")).cast("boolean")).otherwise(True)
    return bound.filter(guard).select(*keys, *values)


def bind_slices(
    df: DataFrame, keys: Sequence[str], by: str, slices: Sequence, values: Sequence[str], sep: str = "_"
) -> DataFrame:
    """Slices of one table side by side: per key the ``values`` of every slice, named ``value_slice``; NULL where it has none.

    What ``bind_keyed`` gives for the filtered slices, from one scan and one
    grouping. A key that occurs twice in a slice is an error; rows of other
    slices are left out.
    """
    cells = [F.max(F.when(F.col(by) == v, F.col(c))).alias(f"{c}{sep}{v}") for v in slices for c in values]
    counts = [F.count_if(F.col(by) == v) for v in slices]
    bound = df.filter(F.col(by).isin(list(slices))).groupBy(*keys).agg(*cells, F.greatest(*counts, F.lit(0)).alias("_most"))
    guard = F.when(F.col("_most") > 1, F.raise_error(F.lit("a key occurs twice in one slice")).cast("boolean")).otherwise(True)
    return bound.filter(guard).drop("_most")
