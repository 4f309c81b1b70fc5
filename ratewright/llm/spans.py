"""Places of pattern matches as DataFrame expressions (code points, end exclusive)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_matches(df: DataFrame, text: str, into: str, pattern: str, guard: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """Adds ``into``: array<struct<start int, text string>> of the leftmost, non-overlapping matches that satisfy ``keep``.

    The text between the matches and the matches themselves come from the same pattern, so running lengths give the places.
    ``guard`` is a cheap test that is true for every text with a match; other texts, and NULL, get an empty array.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    between = F.split(F.col(text), pattern, -1)
    pieces = f"__{into}"
    df = df.withColumn(pieces, F.when(guard, F.arrays_zip(found.alias("found"), between.alias("between"))))
    none = F.array().cast("array<struct<start:int,text:string>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["between"])
        match = F.array(F.struct(start.alias("start"), piece["found"].alias("text")))
        kept = F.when(piece["found"].isNotNull() & keep(piece["found"]), F.concat(state["out"], match)).otherwise(state["out"])
        return F.struct((start + F.coalesce(F.length(piece["found"]), F.lit(0))).alias("at"), kept.alias("out"))

    many = F.size(F.col(pieces)) > 1
    walked = F.aggregate(F.col(pieces), begin, step, lambda state: state["out"])
    return df.withColumn(into, F.when(many, walked).otherwise(none)).drop(pieces)


def letters_of(text: Column) -> Column:
    """The code points of a text as an array."""
    return F.split(text, "")


def nearby(text: Column, start: Column, end: Column, reach: int) -> tuple[Column, Column]:
    """The code points before and after a span."""
    first = F.greatest(start - reach, F.lit(0))
    return F.substring(text, first + 1, start - first), F.substring(text, end + 1, F.lit(reach))
