"""Record job: clean event records, recode their codes, redistribute ill-defined causes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewright import fixed_values as fixed
from ratewright.functions.text import normalise_code, remove_all, remove_first, strip_digits_and_marks
from ratewright.operators.columns import rename
from ratewright.operators.frequency import count_by, frequency
from ratewright.operators.recode import pattern_recode, range_recode, relabel_levels, two_way
from ratewright.operators.redistribute import Stage, redistribute
from ratewright.sources.losses import Losses
from ratewright.sources.rules import Rule
from ratewright.sources.tables import write_table, written

RAW_SCHEMA = T.StructType(
    [
        T.StructField("anio_def", T.IntegerType()),
        T.StructField("mes_def", T.IntegerType()),
        T.StructField("region", T.StringType()),
        T.StructField("jurisdiccion", T.StringType()),
        T.StructField("sexo_id", T.IntegerType()),
        T.StructField("grupo_etario", T.StringType()),
        T.StructField("cod_causa_muerte_CIE10", T.StringType()),
    ]
)

RAW_NAMES = {
    "anio_def": "year",
    "mes_def": "month",
    "jurisdiccion": "jurisdiction",
    "sexo_id": "sex",
    "grupo_etario": "age_band",
    "cod_causa_muerte_CIE10": "code",
}

# What each step does to the ill-defined labels, in order. Targets are matched
# by pattern inside the sex and age stratum.
STAGES = (
    Stage("group_2_2", (fixed.PNEUMONIA,), keep=fixed.CHRONIC, split=(0.5, "CMNN")),
    Stage("group_2_3", ("GC2-ECV",), value="ECV"),
    Stage("group_2_3", ("GC2-CE",), keep=fixed.EXTERNAL),
    Stage("group_2_3", ("GC2-TSH",), keep="Tr|Sui|Hom"),
    Stage("group_2_3", ("GC2-SHCE",), keep="Sui|Hom|CE"),
    Stage("group_2_3", ("GC2-CEEC",), drop="GC|" + fixed.CHRONIC),
    Stage("group_2_3", ("GC2",), drop=fixed.ILL_DEFINED),
    Stage("group_2_4", ("GC1-ERC",), value="ERC"),
    Stage("group_2_4", ("GC1-HSCE",), keep="Sui|Hom|CE"),
    Stage("group_2_4", ("GC1",), drop=fixed.ILL_DEFINED),
)
# With the level-1 residual these two stages find no row.
STAGES_ON_LEVEL_ONE = tuple(replace(s, labels=()) if s.labels in ((fixed.PNEUMONIA,), ("GC2",)) else s for s in STAGES)
STRATA = ("sex", "age_band")


def quality_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """Frequency of period, region, age and sex, each within the records kept so far.

    The records are read once, into the counts of the four columns together.
    """
    counts = written(count_by(raw, "anio_def", "region", "grupo_etario", "sexo_id"))
    in_period = counts.filter(F.col("anio_def").between(fixed.FIRST_YEAR, fixed.LAST_YEAR))
    with_region = in_period.filter(~F.col("region").rlike(fixed.MISSING_REGION_PATTERN))
    with_age = with_region.filter(F.col("grupo_etario") != fixed.MISSING_AGE)
    return {
        "year": frequency(counts, "anio_def", 2, "n"),
        "region": frequency(in_period, "region", 1, "n"),
        "age": frequency(with_region, "grupo_etario", 2, "n"),
        "sex": frequency(with_age, "sexo_id", 2, "n"),
    }


def clean_records(
    raw: DataFrame, age_levels: Sequence[str] | None = None, pad: str = "", losses: Losses | None = None
) -> DataFrame:
    """Complete records of the study period with normalised code and uniform labels.

    ``losses`` counts, in the same pass, what each condition drops of the
    records that the earlier ones keep. Pass ``age_levels`` to spare the passes
    that find and number the age labels.
    """
    df = rename(raw, RAW_NAMES)
    conditions = {
        "period": F.col("year").between(fixed.FIRST_YEAR, fixed.LAST_YEAR),
        "region": F.col("region") != fixed.MISSING_REGION,
        "age": F.col("age_band") != fixed.MISSING_AGE,
        "sex": F.col("sex").between(1, 2),
    }
    met = {name: F.coalesce(c, F.lit(False)) for name, c in conditions.items()}
    if losses is not None:
        so_far, dropped = F.lit(True), {"records": F.count("*")}
        for name, c in met.items():
            dropped[f"no_{name}"] = F.count_if(so_far & ~c)
            so_far = so_far & c
        df = losses.watch(df, "clean", dropped)
    df = df.filter(reduce(and_, conditions.values()))
    df = relabel_levels(df, "age_band", fixed.AGE_BANDS, age_levels)
    region = pattern_recode("region", fixed.RECORD_REGIONS, remove_first(F.substr("region", F.lit(3)), r"\."))
    df = df.withColumns(
        {
            "code": normalise_code("code", pad),
            "sex": two_way(F.col("sex") == 1, fixed.MALE, fixed.FEMALE),
            "region": region,
        }
    )
    jurisdiction = pattern_recode(
        "jurisdiction",
        (*fixed.RECORD_JURISDICTIONS, (fixed.REST_OF_REGION, F.col("region"))),
        strip_digits_and_marks("jurisdiction"),
    )
    extra = [c for c in df.columns if c not in ("year", "month", "region", "jurisdiction", "sex", "age_band", "code")]
    return df.select(
        "year", "month", "region", jurisdiction.alias("jurisdiction"), "sex", "age_band", "code", *extra
    )


def level_one(label: Column) -> Column:
    """Broad group of a cause label."""
    return pattern_recode(label, fixed.LEVEL_ONE, label)


def level_two(label: Column) -> Column:
    """Cause label without the suffix of ill-defined and external groups."""
    return F.when(label.rlike(fixed.LEVEL_TWO_CUT), remove_all(label, "(?s)-.*$")).otherwise(label)


def specific_reassign(label: Column, residual: Column) -> Column:
    """Ill-defined labels that name their target get it; the others get ``residual``."""
    return (
        F.when(label.rlike(fixed.RESIDUAL_PATTERN), residual)
        .when(label.rlike(fixed.SPECIFIC_PATTERN), remove_first(label, "^.*-"))
        .otherwise(label)
    )


def recode_records(df: DataFrame, rules: Sequence[Rule] | DataFrame, residual: str = "group_2") -> DataFrame:
    """Cause label, its two levels and the value before redistribution (``group_2_1``).

    ``residual`` is the level given to ill-defined rows that wait for a stage:
    ``group_2`` lets every stage find its rows, ``group_1`` leaves unspecific
    pneumonia and general GC2 rows as "GC".
    """

    def levels(label: Column) -> dict[str, Column]:
        groups = {"group_1": level_one(label), "group_2": level_two(label)}
        return {**groups, "group_2_1": specific_reassign(label, groups[residual])}

    return range_recode(df, "code", rules, "label", levels)


def redistribute_records(
    df: DataFrame, key: str, stages: Sequence[Stage] = STAGES, method: str = "draw", seed: str = "123"
) -> DataFrame:
    """Columns ``group_2_2`` to ``group_2_4``: the cause after each redistribution step."""
    return redistribute(df, key, STRATA, "label", "group_2_1", stages, method, seed)


def run(
    spark: SparkSession,
    raw: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    key: str,
    path: str,
    age_levels: Sequence[str] | None = None,
) -> None:
    """Clean, recode, redistribute and write the records, partitioned by year.

    The keyed records are written first: they are read more than once, and
    numbering copies is a shuffle. ``age_levels`` spares the scan that finds the
    age labels.
    """
    raw = written(raw)
    df = redistribute_records(recode_records(clean_records(raw, age_levels), rules), key)
    write_table(df.drop("label", "group_2_1"), path, ["year"])
