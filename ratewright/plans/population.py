"""Population job: standard population and monthly population by region, sex and age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright import fixed_values as fixed
from ratewright.functions.predicates import one_of, unless
from ratewright.functions.text import parse_number, remove_first, title_case
from ratewright.operators.columns import crossed_names, rename_at
from ratewright.operators.frequency import weighted_count
from ratewright.operators.joins import keyed_join
from ratewright.operators.recode import band_recode, pattern_recode
from ratewright.operators.reshape import complete_grid, interpolate, split_name, wide_to_long
from ratewright.sources.tables import write_table, written


def standard_population(cells: DataFrame, age: str = "age", cases: str = "cases", oldest: str | None = None) -> DataFrame:
    """Standard population per wide age band from its five-year bands.

    All bands are listed, the oldest too. Labels outside them stay NULL unless
    ``oldest`` names a catch-all, so a total row cannot slip into a band unseen.
    """
    band = band_recode(age, fixed.STANDARD_AGES, oldest)
    return weighted_count(cells, [band.alias("age_band")], cases, "standard")


def annual_population(
    wide: DataFrame,
    province: str = "province",
    age: str = "age",
    sexes: Sequence[str] = fixed.SEXES,
    years: Sequence[int] = fixed.PROJECTION_YEARS,
) -> DataFrame:
    """Wide projections (province, age, then sex x year columns) to yearly population.

    The value columns are named by position, sexes running fastest. Total and
    empty age rows are left out.
    """
    names = crossed_names(sexes, years)
    df = rename_at(wide.select(province, age, *[c for c in wide.columns if c not in (province, age)]), 2, names)
    df = df.filter(unless(one_of(age, ["Total", None])))
    region = pattern_recode(province, fixed.PROVINCE_REGIONS)
    own_name = F.when(F.col(province) == fixed.CAPITAL_LABEL, fixed.CAPITAL_NAME).otherwise(
        title_case(remove_first(province, "^.{0,3}"))
    )
    whole = region.rlike(fixed.REGIONS_TAKEN_WHOLE) & ~F.col(province).rlike(fixed.PROVINCES_KEPT)
    df = df.select(
        region.alias("region"),
        F.when(whole, region).otherwise(own_name).alias("jurisdiction"),
        band_recode(age, fixed.PROJECTION_AGES, fixed.OLDEST_BAND).alias("age_band"),
        *names,
    )
    long = split_name(wide_to_long(df, names), "name", ["sex", "year"])
    return weighted_count(
        long,
        ["region", "jurisdiction", parse_number("year").cast("int").alias("year"), "sex", "age_band"],
        parse_number("value"),
        "projected",
    )


def monthly_population(
    annual: DataFrame,
    first_year: int = fixed.FIRST_YEAR,
    last_year: int = fixed.LAST_YEAR,
    anchor_year: int | None = None,
    step: str = "1 month",
) -> DataFrame:
    """Yearly population (January anchors) interpolated to every month.

    The grid runs to the anchor after ``last_year`` and is trimmed afterwards,
    so the months of the last year are interpolated as well. With ``step="1 year"``
    only the Januaries are built, with the same values.
    """
    end = anchor_year or last_year + 1
    annual = written(annual)  # read for the grid and for the anchors
    grid = complete_grid(
        annual,
        ["region", "jurisdiction"],
        {"sex": None, "age_band": None},
        ("date", F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(end), F.lit(1), F.lit(1)), step),
    )
    anchors = annual.withColumn("date", F.make_date("year", F.lit(1), F.lit(1))).drop("year")
    series = ["region", "jurisdiction", "sex", "age_band"]
    dense = keyed_join(grid, anchors, series, ["date"])
    filled = interpolate(dense, series, "date", "projected", "population")
    return filled.filter(F.col("date") < F.make_date(F.lit(last_year + 1), F.lit(1), F.lit(1))).select(
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        *series,
        "population",
    )


def run(spark: SparkSession, wide: DataFrame, standard_cells: DataFrame, folder: str) -> None:
    """Both population tables, written for the analysis job."""
    write_table(monthly_population(annual_population(wide)), f"{folder}/population_monthly")
    write_table(standard_population(standard_cells), f"{folder}/standard_population")
