"""Predicates with the NULL rules of the analysis.

A plain ``filter`` drops rows whose predicate is NULL. The helpers here cover
the cases where NULL must be kept or must count as a member.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def unless(condition: Column) -> Column:
    """Keep every row but those where ``condition`` is true (NULL is kept)."""
    return ~F.coalesce(condition, F.lit(False))


def one_of(col: Column | str, values: Iterable) -> Column:
    """Set membership in which a None among ``values`` matches NULL.

    Never NULL itself, so its negation keeps what it should keep.
    """
    col = F.col(col) if isinstance(col, str) else col
    values = list(values)
    known = [v for v in values if v is not None]
    found = F.coalesce(col.isin(known), F.lit(False)) if known else F.lit(False)
    return found | col.isNull() if len(known) < len(values) else found


def in_band(col: Column | str, members: Iterable[str] | None, span: tuple[str, str] | None) -> Column:
    """True for listed labels or labels inside an inclusive text range."""
    col = F.col(col) if isinstance(col, str) else col
    tests = []
    if members:
        tests.append(col.isin(list(members)))
    if span:
        tests.append(col.between(*span))
    test = tests[0]
    for other in tests[1:]:
        test = test | other
    return test
