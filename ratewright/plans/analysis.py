"""Analysis job: exploratory tables, standardised rates, joinpoint trends, plot feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright import fixed_values as fixed
from ratewright.operators.checks import join_coverage
from ratewright.operators.columns import unite
from ratewright.operators.frequency import (
    chi_square,
    count_by,
    cross_table,
    frequency,
    summary_by_group,
    top_k,
    weighted_count,
    without_margins,
)
from ratewright.operators.rates import rate_cells, standardised_rate
from ratewright.operators.recode import level_order, set_recode
from ratewright.operators.trend import (
    average_change,
    density_feed,
    joinpoint_trend,
    trend_points,
    trend_summary,
)
from ratewright.sources.tables import written


def case_counts(records: DataFrame) -> DataFrame:
    """Records per sex, age, code and cause, written: the one pass behind all tables."""
    return written(count_by(records, "sex", "age_band", "code", "group_1", "group_2"))


def exploratory_tables(counts: DataFrame) -> dict[str, DataFrame]:
    """Frequencies by sex, age and cause, the most frequent ill-defined codes, and the age test (from ``case_counts``)."""
    ill_defined = counts.filter(F.col("group_2").isin("GC1", "GC2"))
    return {
        "sex": frequency(counts, "sex", weight="n"),
        "age": frequency(counts, "age_band", weight="n"),
        "codes": top_k(ill_defined, ["code"], 15, weight="n"),
        "age_by_group": cross_table(counts, "age_band", "group_1", fixed.BROAD_GROUPS, "Total", "n"),
        "age_test": chi_square(counts, "age_band", "group_1", "n"),
    }


def cause_by_age(counts: DataFrame) -> DataFrame:
    """Causes within age bands: n, column percent, order of the causes (from ``case_counts``)."""
    causes = counts.withColumn("cause", set_recode("group_2", fixed.SUMMARY_GROUPS))
    table = summary_by_group(causes, "age_band", "cause", weight="n")
    return table.withColumn("position", level_order("cause", fixed.SUMMARY_CAUSES))


def january_population(monthly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Population in January per key, both sexes; total rows would count everyone twice."""
    january = without_margins(monthly.filter(F.col("month") == 1), {"sex": "Total"})
    return weighted_count(january, list(keys), "population", "pop")


def ill_defined_rates(
    records: DataFrame,
    monthly: DataFrame,
    standard: DataFrame,
    by: Sequence[str] = (),
    cause: str = "group_2",
    zero_fill: bool = False,
) -> DataFrame:
    """Yearly standardised rates of the ill-defined causes, national or per ``by`` (such as region).

    With ``by`` the keys are also united into ``series``, and stay beside it.
    """
    cells = count_by(
        records.filter(F.col("group_1").rlike(fixed.ILL_DEFINED)), "year", *by, "age_band", cause
    )
    rates = standardised_rate(
        rate_cells(
            cells,
            january_population(monthly, ["year", *by, "age_band"]),
            standard,
            ["year", *by, "age_band"],
            ["age_band"],
            {"age_band": fixed.AGE_BANDS} if zero_fill else None,
        ),
        ["year", *by, cause],
        weight="standard",
    )
    return unite(rates, [*by, cause], "series") if by else rates


def population_gaps(records: DataFrame, monthly: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Year, ``by`` and age cells that only the records or only the population have."""
    keys = ["year", *by, "age_band"]
    return join_coverage(records, january_population(monthly, keys), keys)


def trends(rates: DataFrame, group: Sequence[str], max_joinpoints: int = fixed.MAX_JOINPOINTS) -> dict[str, DataFrame]:
    """Segments, summary table, average changes and fitted points of one set of rates."""
    segments = joinpoint_trend(rates, group, "year", "value", max_joinpoints)
    return {
        "segments": segments,
        "summary": trend_summary(segments, {g: F.col(g) for g in group}),
        "average": average_change(segments, group),
        "points": trend_points(rates, segments, group, "year", "value"),
    }


def rate_density(rates: DataFrame, group: Sequence[str]) -> DataFrame:
    """Density of the yearly rates per group inside the plotted range."""
    return density_feed(rates, group, "value", limits=fixed.DENSITY_LIMITS)
