"""Redistribution of ill-defined categories over target categories inside strata.

All methods work from one small aggregate, the counts per stratum and label; the
records are then touched by one join against a table written from it. Shares are computed
once from the state before any stage and never refreshed in between.

* ``redistribute(..., method="draw")``: every eligible row draws a category with
  a uniform fixed by its key (any partitioning and any re-run gives the same).
* ``redistribute(..., method="quota")``: exact shares per stratum by largest
  remainder, no sampling noise.
* ``expected_counts``: fractional counts without touching rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.functions.hashing import HASH_BITS, key_hash, uniform
from ratewright.operators.joins import keyed_join
from ratewright.sources.tables import written

# Hash buckets per pool and stratum in which quota cuts are located.
QUOTA_BUCKETS = 1024
ROWS_PER_BUCKET = 100_000


@dataclass(frozen=True)
class Stage:
    """What happens to the rows that carry one of ``labels``.

    ``result`` names the column that first shows the outcome. Rows get ``value``,
    or a category from the pool of their stratum: the target values that match
    ``keep`` and do not match ``drop`` (patterns). ``split`` is
    (fraction, category): that part of the rows takes the category first.
    """

    result: str
    labels: tuple[str, ...]
    value: str | None = None
    keep: str | None = None
    drop: str | None = None
    split: tuple[float, str] | None = None


def label_counts(df: DataFrame, strata: Sequence[str], label: str, start: str) -> DataFrame:
    """Rows per stratum, label and starting value: the one pass all methods share."""
    return df.groupBy(*strata, F.col(label).alias("_label"), F.col(start).alias("_start")).agg(
        F.count("*").alias("_n")
    )


def _check(stages: Sequence[Stage]) -> None:
    listed = [label for stage in stages for label in stage.labels]
    if len(listed) != len(set(listed)):
        raise ValueError("a label may occur in one stage only")


def _stage_no(label: Column, stages: Sequence[Stage], which) -> Column:
    """Index of the stage that takes a label, among the stages ``which`` selects."""
    branch = F
    for i, stage in enumerate(stages):
        if which(stage):
            branch = branch.when(label.isin(list(stage.labels)), F.lit(i))
    return branch if branch is not F else F.lit(None).cast("int")


def _pooled(stage: Stage) -> bool:
    return stage.value is None


def pool_shares(counts: DataFrame, strata: Sequence[str], stages: Sequence[Stage]) -> DataFrame:
    """Shares of the target values in each pool and stratum.

    One row per (pool, stratum, value) with its count ``n``, the pool ``total``,
    the share ``p`` and the interval [``below``, ``upto``) of cumulative counts.
    A window partition holds one row per target value.
    """
    start = F.col("_start")
    member = []
    for i, stage in enumerate(stages):
        if _pooled(stage):
            test = start.isNotNull()
            if stage.keep:
                test = test & start.rlike(stage.keep)
            if stage.drop:
                test = test & ~start.rlike(stage.drop)
            member.append(F.when(test, F.lit(i)))
    targets = counts.groupBy(*strata, "_start").agg(F.sum("_n").alias("n"))
    pools = targets.withColumn("_pool", F.explode(F.array_compact(F.array(*member))))
    whole = Window.partitionBy("_pool", *strata)
    upto = F.sum("n").over(whole.orderBy("_start").rowsBetween(Window.unboundedPreceding, 0))
    return pools.select(
        "_pool",
        *strata,
        start.alias("_value"),
        "n",
        F.sum("n").over(whole).alias("total"),
        (upto - F.col("n")).alias("below"),
        upto.alias("upto"),
    ).withColumn("p", F.col("n") / F.col("total"))


def redistribute(
    df: DataFrame,
    key: str,
    strata: Sequence[str],
    label: str,
    start: str,
    stages: Sequence[Stage],
    method: str = "draw",
    seed: str = "123",
) -> DataFrame:
    """Add one column per stage result: ``start`` with the rows of the stages so far reassigned.

    ``label`` decides which stage takes a row, ``start`` is the value a row has
    before the first stage and, counted per stratum, the weight of the targets.
    A row belongs to one stage at most, so all stages cost one join. Rows whose
    pool is empty in their stratum keep their value. ``key`` must identify rows.
    """
    _check(stages)
    staged = df.withColumn("_stage", _stage_no(F.col(label), stages, lambda s: True))
    if method == "draw":
        given = _draw(staged, label_counts(df, strata, label, start), key, strata, stages, seed)
    elif method == "quota":
        given = _quota(staged, key, strata, label, start, stages, seed)
    else:
        raise ValueError(f"unknown method {method!r}")
    results = list(dict.fromkeys(s.result for s in stages))
    last = {r: max(i for i, s in enumerate(stages) if s.result == r) for r in results}
    return given.withColumns(
        {
            r: F.when(F.col("_stage") <= last[r], F.coalesce(F.col("_given"), F.col(start))).otherwise(F.col(start))
            for r in results
        }
    ).drop("_stage", "_given")


def _fixed_value(stages: Sequence[Stage]) -> Column:
    branch = F
    for i, stage in enumerate(stages):
        if not _pooled(stage):
            branch = branch.when(F.col("_stage") == i, F.lit(stage.value))
    return branch if branch is not F else F.lit(None).cast("string")


def _split(stages: Sequence[Stage], key: str, seed: str) -> Column:
    """Category of the rows that a split takes out before the pool, else NULL."""
    branch = F
    for i, stage in enumerate(stages):
        if stage.split:
            fraction, category = stage.split
            chosen = (F.col("_stage") == i) & (uniform(key, seed, "split") < F.lit(fraction))
            branch = branch.when(chosen, F.lit(category))
    return branch if branch is not F else F.lit(None).cast("string")


def _pool_no(stages: Sequence[Stage]) -> Column:
    pools = [i for i, s in enumerate(stages) if _pooled(s)]
    return F.when(F.col("_split").isNull() & F.col("_stage").isin(pools), F.col("_stage"))


def _draw(
    df: DataFrame, counts: DataFrame, key: str, strata: Sequence[str], stages: Sequence[Stage], seed: str
) -> DataFrame:
    """Interval lookup of each row's uniform in the cumulative shares of its pool.

    The intervals of a pool and stratum are disjoint, so the left join keeps
    the row count; rows outside every stage have a NULL pool and match nothing.
    """
    rows = df.withColumn("_split", _split(stages, key, seed)).withColumn("_pool", _pool_no(stages))
    rows = rows.withColumn("_u", F.when(F.col("_pool").isNotNull(), uniform(key, seed, "pool")))
    shares = written(
        pool_shares(counts, strata, stages).select(
            "_pool",
            *strata,
            "_value",
            (F.col("below") / F.col("total")).alias("_from"),
            (F.col("upto") / F.col("total")).alias("_to"),
        )
    )
    inside = (F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to"))
    given = F.coalesce(_fixed_value(stages), F.col("_split"), F.col("_value"))
    return keyed_join(rows, shares, strata, ["_pool"], inside).select(*df.columns, given.alias("_given"))


def _quota(df: DataFrame, key: str, strata: Sequence[str], label: str, start: str, stages: Sequence[Stage], seed: str) -> DataFrame:
    """Exact quotas: rows of a pool and stratum in hash order, cut at cumulative quotas.

    The records are never ranked as a whole. Counts per hash bucket tell in
    which bucket a cut falls; only the rows of those buckets are ranked to find
    the exact (hash, key) of the cut; the records then look their place up
    between the cuts as in a draw. A hash spreads evenly whatever the stratum,
    so a stratum that holds most rows is spread over all its buckets. The
    eligible rows' hashes are written once; their number sets that of the
    buckets, so a bucket stays small however many rows there are.
    """
    h = F.when(F.col("_pool").isNotNull(), key_hash(key, seed, "pool"))
    rows = df.withColumn("_split", F.lit(None).cast("string")).withColumn("_pool", _pool_no(stages)).drop("_split")
    rows = rows.withColumn("_h", h)
    place = ["_pool", *strata]
    counts = written(
        rows.groupBy(*strata, F.col(label).alias("_label"), F.col(start).alias("_start")).agg(F.count("*").alias("_n"))
    )
    quotas = _quotas(counts, strata, stages)

    eligible = written(rows.filter(F.col("_pool").isNotNull()).select(*place, "_h", F.col(key).alias("_key")))
    buckets = max(QUOTA_BUCKETS, -(-eligible.count() // ROWS_PER_BUCKET))
    bucket = F.shiftright(F.col("_h") * F.lit(buckets).cast("bigint"), HASH_BITS).alias("_bucket")
    filled = eligible.groupBy(*place, bucket).agg(F.count("*").alias("_size"))
    run = Window.partitionBy(*place).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    filled = filled.withColumn("_upto", F.sum("_size").over(run))
    both = F.explode(
        F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("rank")) for side in ("_from", "_to")])
    )
    sides = quotas.select(*place, "_value", both.alias("_cut")).select(
        *place, "_value", F.col("_cut.side").alias("_side"), F.col("_cut.rank").alias("_rank")
    )
    in_bucket = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_size"))
    # The cut behind the last row lies in no bucket and stays open.
    cuts = written(
        keyed_join(sides, filled, strata, ["_pool"], in_bucket, "inner").select(
            *place, "_value", "_side", "_bucket", (F.col("_rank") - F.col("_upto") + F.col("_size")).alias("_offset")
        )
    )
    hashed = eligible.select(*place, "_h", "_key", bucket)
    near = keyed_join(hashed, cuts.select(*place, "_bucket"), strata, ["_pool", "_bucket"], how="left_semi")
    order = Window.partitionBy(*place, "_bucket").orderBy("_h", "_key")
    near = near.withColumn("_offset", F.row_number().over(order) - 1)
    ends = keyed_join(cuts, near, strata, ["_pool", "_bucket", "_offset"], how="inner")
    end = F.struct("_h", "_key")
    spans = written(
        ends.groupBy(*place, "_value").agg(
            F.max(F.when(F.col("_side") == "_from", end)).alias("_first"),
            F.max(F.when(F.col("_side") == "_to", end)).alias("_beyond"),
        )
    )
    own = F.struct(F.col("_h"), F.col(key).alias("_key"))
    inside = (own >= F.col("_first")) & (F.col("_beyond").isNull() | (own < F.col("_beyond")))
    given = F.coalesce(_fixed_value(stages), F.col("_value"))
    return keyed_join(rows, spans, strata, ["_pool"], inside).select(*df.columns, given.alias("_given"))


def _quotas(counts: DataFrame, strata: Sequence[str], stages: Sequence[Stage]) -> DataFrame:
    """Rank intervals per pool, stratum and value by largest remainder.

    Whole-number arithmetic in DECIMAL(38), exact for any row count. A split
    takes the first ranks; the pool shares the rest.
    """
    splits = {i: s.split for i, s in enumerate(stages) if s.split}
    stage = _stage_no(F.col("_label"), stages, _pooled)
    asked = (
        counts.withColumn("_pool", stage)
        .filter(F.col("_pool").isNotNull())
        .groupBy("_pool", *strata)
        .agg(F.sum("_n").alias("_asked"))
    )
    taken = F
    for i, (fraction, _) in splits.items():
        taken = taken.when(F.col("_pool") == i, F.round(F.col("_asked") * fraction).cast("bigint"))
    taken = taken.otherwise(F.lit(0)) if splits else F.lit(0)
    asked = asked.withColumn("_taken", taken.cast("bigint"))
    shares = pool_shares(counts, strata, stages)
    cells = keyed_join(asked, shares, strata, ["_pool"], how="inner").withColumn(
        "_rows", F.col("_asked") - F.col("_taken")
    )
    product = "cast(_rows as decimal(19,0)) * cast(n as decimal(19,0))"
    cells = cells.withColumn("_floor", F.expr(f"({product}) div total")).withColumn(
        "_rest", F.expr(f"({product}) % cast(total as decimal(19,0))")
    )
    whole = Window.partitionBy("_pool", *strata)
    spare = F.col("_rows") - F.sum("_floor").over(whole)
    order = F.row_number().over(whole.orderBy(F.desc("_rest"), "_value"))
    cells = cells.withColumn("_quota", F.col("_floor") + F.when(order <= spare, 1).otherwise(0))
    upto = F.col("_taken") + F.sum("_quota").over(
        whole.orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    )
    cut = cells.select("_pool", *strata, "_value", (upto - F.col("_quota")).alias("_from"), upto.alias("_to"))
    for i, (_, category) in splits.items():
        first = asked.filter(F.col("_pool") == i).select(
            "_pool", *strata, F.lit(category).alias("_value"), F.lit(0).cast("bigint").alias("_from"), F.col("_taken").alias("_to")
        )
        cut = cut.unionByName(first)
    return cut.filter(F.col("_to") > F.col("_from"))


def expected_counts(
    df: DataFrame,
    strata: Sequence[str],
    label: str,
    start: str,
    stages: Sequence[Stage],
    counts: DataFrame | None = None,
) -> DataFrame:
    """Counts per stratum and final value with ill-defined rows spread by their shares.

    ``n_start`` are the rows that had the value before, ``n_expected`` the
    (fractional) rows after all stages; the stratum totals are kept. Values of
    rows with an empty pool stay where they were.
    """
    _check(stages)
    if counts is None:
        counts = written(label_counts(df, strata, label, start))
    cells = counts.withColumn("_stage", _stage_no(F.col("_label"), stages, lambda s: True))
    pooled = [i for i, s in enumerate(stages) if _pooled(s)]
    split_part, split_value = F, F
    for i, s in enumerate(stages):
        if s.split:
            split_part = split_part.when(F.col("_stage") == i, F.lit(float(s.split[0])))
            split_value = split_value.when(F.col("_stage") == i, F.lit(s.split[1]))
    part = split_part.otherwise(F.lit(0.0)) if split_part is not F else F.lit(0.0)
    cells = cells.withColumn("_part", part).withColumn(
        "_split", split_value if split_value is not F else F.lit(None).cast("string")
    )
    cells = cells.withColumn("_pool", F.when(F.col("_stage").isin(pooled), F.col("_stage")))
    zero = F.lit(0).cast("bigint")
    before = cells.select(*strata, F.col("_start").alias("value"), F.col("_n").alias("n_start"), F.lit(0.0).alias("n_expected"))
    fixed = F.coalesce(_fixed_value(stages), F.col("_start"))
    unpooled = cells.filter(F.col("_pool").isNull()).select(
        *strata, fixed.alias("value"), zero.alias("n_start"), F.col("_n").cast("double").alias("n_expected")
    )
    split = cells.filter(F.col("_part") > 0).select(
        *strata, F.col("_split").alias("value"), zero.alias("n_start"), (F.col("_n") * F.col("_part")).alias("n_expected")
    )
    asked = cells.filter(F.col("_pool").isNotNull())
    shares = pool_shares(counts, strata, stages)
    pool = keyed_join(asked, shares, strata, ["_pool"]).select(
        *strata,
        F.coalesce("_value", "_start").alias("value"),
        zero.alias("n_start"),
        (F.col("_n") * (1 - F.col("_part")) * F.coalesce("p", F.lit(1.0))).alias("n_expected"),
    )
    moved = before.unionByName(unpooled).unionByName(split).unionByName(pool)
    return moved.groupBy(*strata, "value").agg(
        F.sum("n_start").alias("n_start"), F.sum("n_expected").alias("n_expected")
    )


def empty_pools(counts: DataFrame, strata: Sequence[str], stages: Sequence[Stage]) -> DataFrame:
    """Strata in which eligible rows find no target value, with their rows."""
    asked = (
        counts.withColumn("_pool", _stage_no(F.col("_label"), stages, _pooled))
        .filter(F.col("_pool").isNotNull())
        .groupBy("_pool", *strata)
        .agg(F.sum("_n").alias("n"))
    )
    shares = pool_shares(counts, strata, stages).select("_pool", *strata).distinct()
    names = F.element_at(F.array(*[F.lit(", ".join(s.labels)) for s in stages]), F.col("_pool") + 1)
    return keyed_join(asked, shares, strata, ["_pool"], how="left_anti").select(
        names.alias("labels"), *strata, "n"
    )


def number_copies(df: DataFrame, out: str = "copy", chunk: int = 1_000_000) -> DataFrame:
    """Rows numbered among their exact copies, for tables without an identifier.

    Copies are counted (combined map-side) and written out again instead of
    being ranked in a window. Only records with more than ``chunk`` copies are
    shuffled once more, to be written out by several tasks, so a record that
    makes up a third of the table is no hot spot.
    """
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    few = counts.filter(F.col("_copies") <= chunk)
    few = few.withColumn(out, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).drop("_copies")
    chunks = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_copies - 1) div {chunk}"))
    many = counts.filter(F.col("_copies") > chunk).withColumn("_chunk", F.explode(chunks))
    first = F.col("_chunk") * chunk
    copies = F.sequence(first + 1, F.least(first + chunk, F.col("_copies")))
    many = many.repartition(*df.columns, "_chunk").select(*df.columns, F.explode(copies).alias(out))
    return few.unionByName(many)


def row_key(cols: Sequence[str]) -> Column:
    """Text key from all listed columns, one-to-one: each value follows its length, NULL is a dash."""

    def part(value: Column) -> Column:
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit("="), value), F.lit("-"))

    return F.concat_ws("|", *[part(F.col(c).cast("string")) for c in cols])
