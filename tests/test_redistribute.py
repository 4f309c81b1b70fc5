from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratewright.operators import redistribute as module
from ratewright.operators.redistribute import (
    Stage,
    empty_pools,
    expected_counts,
    label_counts,
    number_copies,
    redistribute,
    row_key,
)
from ratewright.plans.records import STAGES, STAGES_ON_LEVEL_ONE

STAGE = (Stage("after", ("ill",), drop="ill"),)


def records(spark, rows):
    """(stratum, label) pairs with a running key."""
    return spark.createDataFrame([(i, s, lb) for i, (s, lb) in enumerate(rows)], "key long, stratum string, label string")


def run(df, stages=STAGE, method="quota", **more):
    return redistribute(df, "key", ["stratum"], "label", "label", stages, method, **more)


def counts(df, col="after"):
    return Counter((r["stratum"], r[col]) for r in df.collect())


def test_quota_is_exact(spark):
    df = records(spark, [("s", "a")] * 3 + [("s", "b")] * 3 + [("s", "ill")] * 10)
    assert counts(run(df)) == {("s", "a"): 8, ("s", "b"): 8}


def test_quota_by_largest_remainder(spark):
    df = records(spark, [("s", "a")] * 5 + [("s", "b")] * 3 + [("s", "c")] * 2 + [("s", "ill")] * 7)
    # 3.5, 2.1 and 1.4 rows: one row left after 3, 2, 1 goes to a.
    assert counts(run(df)) == {("s", "a"): 9, ("s", "b"): 5, ("s", "c"): 3}


@pytest.mark.parametrize("buckets", [1, 2, 7, 1024, 1 << 20])
def test_quota_does_not_depend_on_buckets(spark, monkeypatch, buckets):
    df = records(spark, [("s", "a")] * 5 + [("s", "b")] * 3 + [("t", "c")] * 2 + [("s", "ill")] * 57 + [("t", "ill")] * 9)
    monkeypatch.setattr(module, "QUOTA_BUCKETS", 1)
    want = {(r["key"], r["after"]) for r in run(df).collect()}
    monkeypatch.setattr(module, "QUOTA_BUCKETS", buckets)
    assert {(r["key"], r["after"]) for r in run(df).collect()} == want


def test_empty_pool_keeps_the_label_and_is_reported(spark):
    df = records(spark, [("s", "a"), ("s", "ill"), ("t", "ill"), ("t", "ill"), (None, "ill"), (None, "b")])
    for method in ("draw", "quota"):
        assert counts(run(df, method=method)) == {("s", "a"): 2, ("t", "ill"): 2, (None, "b"): 2}
    report = empty_pools(label_counts(df, ["stratum"], "label", "label"), ["stratum"], STAGE).collect()
    assert [tuple(r) for r in report] == [("ill", "t", 2)]


def test_draw_is_fixed_by_key_and_seed(spark):
    df = records(spark, [("s", "a")] * 50 + [("s", "b")] * 50 + [("s", "ill")] * 400)
    first = {r["key"]: r["after"] for r in run(df, method="draw").collect()}
    again = {r["key"]: r["after"] for r in run(df.repartition(7, "label"), method="draw").collect()}
    other = {r["key"]: r["after"] for r in run(df, method="draw", seed="9").collect()}
    assert first == again
    assert first != other
    drawn = Counter(first[k] for k in range(100, 500))
    assert set(drawn) == {"a", "b"} and 150 < drawn["a"] < 250


def test_split_takes_its_part_first(spark):
    stages = (Stage("after", ("ill",), keep="a|b", split=(0.5, "c")),)
    df = records(spark, [("s", "a")] * 30 + [("s", "b")] * 10 + [("s", "ill")] * 400)
    assert counts(run(df, stages)) == {("s", "a"): 180, ("s", "b"): 60, ("s", "c"): 200}
    drawn = counts(run(df, stages, "draw"))
    assert 150 < drawn[("s", "c")] < 250 and sum(drawn.values()) == 440
    expected = {r["value"]: r["n_expected"] for r in expected_counts(df, ["stratum"], "label", "label", stages).collect()}
    assert expected == {"a": 180.0, "b": 60.0, "c": 200.0, "ill": 0.0}


def test_stages_show_one_after_the_other(spark):
    stages = (
        Stage("one", ("x",), value="a"),
        Stage("two", ("y",), keep="^b$"),
        Stage("three", (), keep="^b$"),
    )
    df = records(spark, [("s", "x"), ("s", "y"), ("s", "b"), ("s", None)])
    got = {r["label"]: (r["one"], r["two"], r["three"]) for r in run(df, stages, "draw").collect()}
    assert got == {"x": ("a",) * 3, "y": ("y", "b", "b"), "b": ("b",) * 3, None: (None,) * 3}


def test_a_label_belongs_to_one_stage(spark):
    with pytest.raises(ValueError, match="one stage"):
        run(records(spark, [("s", "a")]), (Stage("x", ("a",), value="b"), Stage("y", ("a",), value="c")))


def test_stage_table():
    assert [s.labels[0] for s in STAGES] == [
        "GC4-Neumonías NE",
        "GC2-ECV",
        "GC2-CE",
        "GC2-TSH",
        "GC2-SHCE",
        "GC2-CEEC",
        "GC2",
        "GC1-ERC",
        "GC1-HSCE",
        "GC1",
    ]
    assert [s.labels for s in STAGES_ON_LEVEL_ONE if not s.labels] == [(), ()]


rows = st.lists(st.tuples(st.sampled_from("st"), st.sampled_from(["a", "b", "c", "ill", "ill", None])), min_size=1, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows)
def test_redistribution_keeps_totals_and_other_rows(spark, data):
    df = records(spark, data).cache()
    before = Counter(s for s, _ in data)
    for method in ("draw", "quota"):
        out = run(df, method=method).collect()
        assert Counter(r["stratum"] for r in out) == before
        for r in out:
            if r["label"] != "ill":
                assert r["after"] == r["label"]
            elif any(s == r["stratum"] and lb in ("a", "b", "c") for s, lb in data):
                assert (r["stratum"], r["after"]) in set(data)
            else:
                assert r["after"] == "ill"
    expected = expected_counts(df, ["stratum"], "label", "label", STAGE).collect()
    for s in before:
        assert sum(r["n_expected"] for r in expected if r["stratum"] == s) == pytest.approx(before[s])
    # Quotas differ from the exact shares by less than one row.
    quota = Counter((r["stratum"], r["after"]) for r in run(df).collect())
    for r in expected:
        assert abs(Fraction(quota[(r["stratum"], r["value"])]) - Fraction(r["n_expected"])) < 1 + Fraction(1, 10**6)


def test_draw_joins_without_shuffling_records(spark, sf, plan):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    out = redistribute(orders, "o_orderkey", ["o_orderpriority"], "o_orderstatus", "o_orderstatus", (Stage("s", ("P",), drop="P"),))
    for df in (out, redistribute(orders, "o_orderkey", ["o_orderpriority"], "o_orderstatus", "o_orderstatus", (Stage("s", ("P",), drop="P"),), "quota")):
        text = plan(df)
        assert "BroadcastHashJoin" in text and "NestedLoop" not in text
        assert text.count("Exchange") == text.count("BroadcastExchange")


def test_shuffled_pools_give_the_same_draw(spark):
    df = records(spark, [("s", "a")] * 5 + [("t", "b")] * 3 + [("s", "ill")] * 40 + [("t", "ill")] * 9)
    want = {(r["key"], r["after"]) for r in run(df, method="draw").collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {(r["key"], r["after"]) for r in run(df, method="draw").collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_copies_are_numbered(spark, chunk):
    df = spark.createDataFrame([("a", 1)] * 7 + [("b", None)] * 2 + [(None, 1)], "x string, y int")
    out = [tuple(r) for r in number_copies(df, chunk=chunk).collect()]
    assert Counter(out) == Counter([("a", 1, i) for i in range(1, 8)] + [("b", None, 1), ("b", None, 2), (None, 1, 1)])
    keys = number_copies(df, chunk=chunk).select(row_key(["x", "y", "copy"]).alias("k"))
    assert keys.select(F.count_distinct("k")).first()[0] == 10
