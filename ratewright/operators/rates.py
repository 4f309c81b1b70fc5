"""Directly age-standardised rates with confidence limits."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.fixed_values import RATE_MULTIPLIER
from ratewright.operators.joins import keyed_join
from ratewright.sources.tables import written


def rate_cells(
    counts: DataFrame,
    population: DataFrame,
    standard: DataFrame,
    population_keys: Sequence[str],
    standard_keys: Sequence[str],
    zero_fill: dict[str, Sequence[str]] | None = None,
    events: str = "n",
) -> DataFrame:
    """Event counts joined to their population and standard weight, keys explicit.

    All three inputs are already aggregated, so both joins work on counts; the
    optimizer broadcasts them when small; a missing key meets a missing key.
    Cells without events do not occur in ``counts``; ``zero_fill`` (cell column
    -> levels) adds them with zero, which keeps the standard weights complete.
    Cells of other levels, and those with a missing key, keep their events.
    """
    if zero_fill:
        counts = written(counts)  # read for the grid and for the cells
        keys = [c for c in counts.columns if c != events and c not in zero_fill]
        grid = counts.select(*keys).distinct()
        for col, levels in zero_fill.items():
            grid = grid.withColumn(col, F.explode(F.array(*[F.lit(v) for v in levels])))
        empty = grid.withColumn(events, F.lit(0).cast(counts.schema[events].dataType))
        cells = counts.unionByName(empty).groupBy(*keys, *zero_fill)
        counts = cells.agg(F.sum(events).alias(events)).select(*counts.columns)
    return keyed_join(keyed_join(counts, population, population_keys), standard, standard_keys)


def standardised_rate(
    cells: DataFrame,
    keys: Sequence[str],
    events: str = "n",
    population: str = "pop",
    weight: str = "weight",
    multiplier: float = RATE_MULTIPLIER,
    confidence: float = 0.95,
    min_events: int = 10,
) -> DataFrame:
    """Directly standardised rate per key with Dobson limits (Byar's interval for the count).

    One hash aggregation of five sums, then a closed form. Rate and limits are
    NULL below ``min_events`` events (0 switches this off) and where a cell has
    no population or weight, so a failed join cannot pass as a low rate.
    """
    x, n, w = (F.col(c).cast("double") for c in (events, population, weight))
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    sums = cells.groupBy(*keys).agg(
        F.sum(F.col(events)).alias("total_count"),
        F.sum(F.col(population)).alias("total_pop"),
        F.sum(w * x / n).alias("_wr"),
        F.sum(w).alias("_w"),
        F.sum(w * w * x / (n * n)).alias("_wv"),
        F.max(n.isNull() | w.isNull() | (n <= 0)).alias("_gap"),
    )
    o = F.col("total_count").cast("double")
    low = o * F.pow(1 - 1 / (9 * o) - z / (3 * F.sqrt(o)), F.lit(3))
    high = (o + 1) * F.pow(1 - 1 / (9 * (o + 1)) + z / (3 * F.sqrt(o + 1)), F.lit(3))
    spread = F.sqrt(F.col("_wv") / (F.col("_w") * F.col("_w") * o))
    rate = F.col("_wr") / F.col("_w")
    usable = ~F.col("_gap") & (F.col("total_count") >= min_events)
    limits = usable & (F.col("total_count") > 0)
    return sums.select(
        *keys,
        "total_count",
        "total_pop",
        F.when(usable, multiplier * rate).alias("value"),
        F.when(limits, multiplier * (rate + spread * (low - o))).alias("lowercl"),
        F.when(limits, multiplier * (rate + spread * (high - o))).alias("uppercl"),
    )
