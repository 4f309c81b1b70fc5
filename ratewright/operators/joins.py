"""Equi joins: NULL-safe keys, look-ups that stand hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    equal: Sequence[str] = (),
    residual: Column | None = None,
    how: str = "left",
) -> DataFrame:
    """Join on ``keys`` (NULL matches NULL) and ``equal`` (NULL matches nothing).

    ``residual`` is a further condition on columns of either side. The key
    columns of the left side are kept; all other names must differ.
    """
    shared = [*equal, *keys]
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in shared})
    test = residual
    for k in shared:
        r = F.col(f"_right_{k}")
        same = F.col(k) == r if k in equal else F.col(k).eqNullSafe(r)
        test = same if test is None else test & same
    return left.join(right, test, how).drop(*[f"_right_{k}" for k in shared])


#: Keys that hold more than this share of the rows are fewer than as many.
HOT_KEYS = 20_000
SPREAD = 1_024


def look_up(df: DataFrame, key: str, table: DataFrame, rows: str) -> DataFrame:
    """``df`` with the columns of the row of ``table`` that has its ``key``; NULL where there is none.

    ``table`` is written, has one row per key, and says in ``rows`` how many rows of ``df`` hold the key. Keys with more than a 20,000th
    of all rows are broadcast, fewer than 20,000 whatever the size; Spark joins the others by their size. Rows that are served already,
    or have no key, are dealt evenly if that join shuffles, so no task gets a hot key. ``df`` is read once.
    """
    values = [c for c in table.columns if c not in (key, rows)]
    often = F.col(rows) * HOT_KEYS > table.agg(F.sum(rows)).scalar()
    hot = table.filter(often).select(F.col(key).alias("_hot_key"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    cold = table.filter(~often).select(F.col(key).alias("_cold_key"), F.lit(0).alias("_cold_place"), *[F.col(v).alias(f"_cold_{v}") for v in values])
    first = df.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    served = F.col(key).isNull() | F.col("_hot_key").isNotNull()
    dealt = first.withColumn("_place", F.when(served, F.monotonically_increasing_id() % SPREAD + 1).otherwise(0).cast("int"))
    both = dealt.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_place") == F.col("_cold_place")), "left")
    return both.select(*df.columns, *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values])
