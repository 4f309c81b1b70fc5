"""Sources, reshaping, grids, interpolation, frequencies, checks."""

import datetime as dt
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewright.operators.checks import coverage_summary, join_coverage, null_report, source_overlap
from ratewright.operators.columns import (
    across,
    clean_names,
    crossed_names,
    drop_empty_columns,
    rename_at,
    unite,
)
from ratewright.operators.frequency import (
    chi_square,
    cross_table,
    frequency,
    share_within,
    summary_by_group,
    top_k,
    without_margins,
)
from ratewright.operators.reshape import (
    bind_keyed,
    bind_slices,
    complete_grid,
    interpolate,
    long_to_wide,
    split_name,
    wide_to_long,
)
from ratewright.sources.losses import Losses
from ratewright.sources.tables import (
    read_csv_union,
    read_sheets,
    read_table,
    shared_folder,
    sheet_range,
    union_by_name,
    union_with_source,
    write_table,
    written,
)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_csv_files_meet_by_name(spark, tmp_path):
    one, two = tmp_path / "a.csv", tmp_path / "b.csv"
    one.write_text("year,code\n2010,A1\n2011,B2\n")
    two.write_text("code,extra,year\nC3,9,2011\nD4,9,bad\n")
    schema = T.StructType(
        [T.StructField("code", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("sex", T.StringType())]
    )
    df = read_csv_union(spark, [str(one), str(two)], schema, "file")
    assert rows(df, "code") == [
        ("A1", 2010, None, "a.csv"),
        ("B2", 2011, None, "a.csv"),
        ("C3", 2011, None, "b.csv"),
        ("D4", None, None, "b.csv"),
    ]
    overlap = source_overlap(df.filter("year is not null"), "year", "file").select("period", "source", "n", "sources")
    assert rows(overlap, "period", "source") == [(2010, "a.csv", 1, 1), (2011, "a.csv", 1, 2), (2011, "b.csv", 1, 2)]


def test_sheets_keep_their_name_and_range(spark, tmp_path):
    for name in ("02-CABA", "06-Buenos Aires"):
        (tmp_path / f"{name}.csv").write_text("row,A,B,C\n1,title,,\n2,age,x,y\n3,0-4,1,2\n4,5-9,3,4\n5,note,,\n")
    schema = "row int, A string, B string, C string"
    df = read_sheets(spark, str(tmp_path), schema, "province")
    part = sheet_range(df, "A2:B4", ["age", "x"])
    assert rows(part, "province", "age") == [
        ("02-CABA", "0-4", "1"),
        ("02-CABA", "5-9", "3"),
        ("06-Buenos Aires", "0-4", "1"),
        ("06-Buenos Aires", "5-9", "3"),
    ]
    with pytest.raises(ValueError, match="2 columns"):
        sheet_range(df, "A2:B4", ["age"])


def test_tables_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(2010, "a"), (2011, "b")], "year int, x string")
    path = str(tmp_path / "t")
    write_table(df, path, ["year"])
    write_table(df, path, ["year"])
    assert {"year=2010", "year=2011"} <= set(os.listdir(path))
    assert sorted(rows(read_table(spark, path).select("year", "x"))) == [(2010, "a"), (2011, "b")]
    assert rows(written(df), "year") == rows(df, "year")


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, k int")
    assert rows(union_by_name([a, b]), "k") == [(1, "x", None), (2, None, "y")]
    assert rows(union_with_source({"a": a, "b": b}, "src").select("src", "k"), "k") == [("a", 1), ("b", 2)]


def test_column_sets(spark):
    df = spark.createDataFrame([("x", None, 1.0)], "`Edad (años)` string, `vacía` string, `Rate n2` double")
    df = drop_empty_columns(clean_names(df))
    assert df.columns == ["edad_anos", "rate_n2"]
    assert across(df, "_n2", lambda c: c * 2).first()["rate_n2"] == 2.0
    assert rename_at(df, 1, ["v"]).columns == ["edad_anos", "v"]
    assert crossed_names(["a", "b"], [1, 2]) == ["a_1", "b_1", "a_2", "b_2"]
    assert unite(df, ["edad_anos", "rate_n2"], "k").columns == ["edad_anos", "rate_n2", "k"]
    assert unite(df, ["edad_anos", "rate_n2"], "k", remove=True).columns == ["k"]


def test_wide_and_long_are_inverse(spark):
    wide = spark.createDataFrame([(1, 10, None), (2, 30, 40)], "id int, a_1 int, a_2 int")
    long = split_name(wide_to_long(wide, ["a_1", "a_2"]), "name", ["what", "n"])
    assert rows(long, "id", "n") == [(1, 10, "a", "1"), (1, None, "a", "2"), (2, 30, "a", "1"), (2, 40, "a", "2")]
    back = long_to_wide(long, ["id"], "n", "value", ["1", "2"])
    assert rows(back, "id") == [(1, 10, None), (2, 30, 40)]
    with pytest.raises(Exception, match="does not have 2 pieces"):
        split_name(spark.createDataFrame([("a_b_c",)], "name string"), "name", ["x", "y"]).collect()


def test_grid(spark):
    """Observed combinations, all levels, a month sequence."""
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", 2, None)], "p string, q int, s string")
    grid = complete_grid(
        df, ["p", "q"], {"s": None, "t": ["u", "v"]}, ("d", F.to_date(F.lit("2010-11-01")), F.to_date(F.lit("2011-01-01")), "1 month")
    )
    got = rows(grid)
    assert len(got) == len(set(got)) == 2 * 3 * 2 * 3
    assert {r[:2] for r in got} == {("a", 1), ("b", 2)}
    assert {r[2] for r in got} == {"x", "y", None}
    assert {r[4] for r in got} == {dt.date(2010, 11, 1), dt.date(2010, 12, 1), dt.date(2011, 1, 1)}


def test_interpolation(spark):
    anchors = {dt.date(2010, 1, 1): 10.0, dt.date(2010, 6, 1): 20.0}
    months = [dt.date(2009, 12, 1)] + [dt.date(2010, m, 1) for m in range(1, 13)]
    df = spark.createDataFrame([("s", m, anchors.get(m)) for m in months], "s string, t date, v double")
    got = dict(rows(interpolate(df, ["s"], "t", "v", "f").select("t", "f")))
    assert got[dt.date(2010, 1, 1)] == 10.0 and got[dt.date(2010, 6, 1)] == 20.0
    assert got[dt.date(2010, 2, 1)] == pytest.approx(10 + 10 * 31 / 151)
    assert got[dt.date(2009, 12, 1)] is None
    assert all(got[dt.date(2010, m, 1)] is None for m in range(7, 13))


def test_bind_by_key(spark):
    a = spark.createDataFrame([("x", 1), ("y", None)], "k string, a int")
    b = spark.createDataFrame([("y", 2.5), (None, 0.5)], "k string, b double")
    assert rows(bind_keyed([a, b], ["k"]), "k") == [(None, None, 0.5), ("x", 1, None), ("y", None, 2.5)]
    with pytest.raises(Exception, match="occurs twice"):
        bind_keyed([a.union(a), b], ["k"]).collect()
    with pytest.raises(ValueError, match="must differ"):
        bind_keyed([a, a], ["k"])


def test_frequency_with_missing_values(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    assert rows(frequency(df, "x"), "x") == [
        (None, 1, 0.25, None, "25.0%"),
        ("a", 2, 0.5, 2 / 3, "50.0%"),
        ("b", 1, 0.25, 1 / 3, "25.0%"),
    ]


def test_shares_sum_to_one(spark, sf):
    counts = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    sums = share_within(counts, ["o_orderpriority"]).groupBy("o_orderpriority").agg(F.sum("pct").alias("s"))
    assert all(r["s"] == pytest.approx(1) for r in sums.collect())
    one = spark.createDataFrame([("s", "a", 1), ("s", "b", 3)], "s string, c string, n int")
    assert [r["pct"] for r in share_within(one, ["s"]).orderBy("c").collect()] == [0.25, 0.75]


def test_cross_table(spark):
    df = spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "a"), (None, "a"), ("s", None)], "x string, y string")
    assert rows(cross_table(df, "x", "y", ["a", "b"], total="Total"), "x") == [
        (None, 1, 0, 0, 1.0, 0.0, 0.0),
        ("Total", 3, 1, 1, 0.6, 0.2, 0.2),
        ("r", 1, 1, 0, 0.5, 0.5, 0.0),
        ("s", 1, 0, 1, 0.5, 0.0, 0.5),
    ]
    only = [r.asDict() for r in cross_table(df.filter("y is null"), "x", "y", []).collect()]
    assert only == [{"x": "s", "n_NA": 1, "p_NA": 1.0}]
    listed = rows(cross_table(df, "x", "y", ["b"], total="Total"), "x")
    assert listed[1] == ("Total", 1, 4, 0.2, 0.8)


def test_slices_of_one_table_are_bound_in_one_scan(spark, plan, tmp_path):
    rows_ = [("a", 1, 5, "x"), ("a", 2, 6, None), ("b", 2, 7, "y"), (None, 1, 8, "z"), ("c", 9, 1, "w")]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows_, "k string, y int, n int, s string").write.parquet(path)
    df = read_table(spark, path)
    bound = bind_slices(df, ["k"], "y", [1, 2, 3], ["n", "s"])
    assert plan(bound).count("FileScan") == 1
    slices = [df.filter(F.col("y") == v).select("k", F.col("n").alias(f"n_{v}"), F.col("s").alias(f"s_{v}")) for v in (1, 2, 3)]
    assert rows(bound, "k") == rows(bind_keyed(slices, ["k"]), "k") == [
        (None, 8, "z", None, None, None, None), ("a", 5, "x", 6, None, None, None), ("b", None, None, 7, "y", None, None)
    ]
    with pytest.raises(Exception, match="twice in one slice"):
        bind_slices(df.unionByName(df), ["k"], "y", [1], ["n"]).collect()


def test_long_cross_table_of_unknown_levels(spark):
    df = spark.createDataFrame([("r", "a"), ("r", "b"), ("Total", "NA"), (None, "a"), ("r", None)], "x string, y string")
    got = {(r["x"], r["y"], r["margin"]): (r["n"], r["pct"]) for r in cross_table(df, "x", "y", total="Total").collect()}
    assert len(got) == 16  # three rows and the total, by three levels and the missing one
    assert got[("r", "a", False)] == got[("r", None, False)] == (1, pytest.approx(1 / 3))
    assert got[("Total", "NA", False)] == (1, 1.0) and got[("Total", "NA", True)] == (1, 0.2)
    assert got[(None, "b", False)] == (0, 0.0) and got[("Total", "a", True)] == (2, 0.4)
    assert {r["margin"] for r in cross_table(df, "x", "y").collect()} == {False}
    assert cross_table(df.limit(0), "x", "y", total="Total").count() == 0


def test_wide_cross_table_with_levels_called_like_its_own_names(spark):
    df = spark.createDataFrame([("Total", "NA"), ("r", None), ("r", "NA")], "x string, y string")
    got = cross_table(df, "x", "y", ["NA"], "Total", margin="sum")
    assert sorted((r["x"], r["sum"], r["n_NA"], r["n_NA_"]) for r in got.collect()) == [("Total", False, 1, 0), ("Total", True, 2, 1), ("r", False, 1, 1)]
    with pytest.raises(Exception, match="called like the total row"):
        cross_table(df, "x", "y", ["NA"], "Total").collect()


def test_long_cross_table_has_more_levels_than_a_table_has_columns(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("x"), (F.col("id") % 15_000).alias("y"))
    table = cross_table(df, "x", "y")
    assert table.count() == 30_000
    assert [tuple(r) for r in table.groupBy("n").count().orderBy("n").collect()] == [(0, 15_000), (2, 15_000)]


def test_losses_are_counted_in_the_pass_that_reads(spark, tmp_path):
    one, two = tmp_path / "a.csv", tmp_path / "b.csv"
    one.write_text("year,code\n2010,A1\nx,B2\n,C\n")
    two.write_text("code,year\nC3,2011\nD4,bad\n")
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("year", T.IntegerType())])
    losses = Losses()
    kept = written(read_csv_union(spark, [str(one), str(two)], schema, losses=losses))
    assert kept.count() == 5
    assert losses.counts() == [("read", "rows", 5), ("read", "code", 0), ("read", "year", 2)]
    assert rows(losses.table(spark).filter("n > 0"), "metric") == [("read", "rows", 5), ("read", "year", 2)]


def test_partitions_are_replaced_one_by_one_and_pruned(spark, tmp_path, plan):
    path = str(tmp_path / "facts")
    facts = spark.range(0, 9000, 1, 8).select("id", (F.col("id") % 1000).alias("who"), (F.lit(2000) + F.col("id") % 3).alias("year"))
    write_table(facts, path, ["year"], ["who"])
    write_table(facts.filter("year = 2001 and who < 10").withColumn("id", -F.col("id")), path, ["year"], ["who"], replace="partitions")
    back = read_table(spark, path)
    assert rows(back.groupBy("year").agg(F.count("*"), F.min("id")), "year") == [(2000, 3000, 0), (2001, 30, -8008), (2002, 3000, 2)]
    one = back.filter("year = 2002 and who = 5")
    text = plan(one)
    assert "PartitionFilters: [isnotnull(year" in text and "(year" in text.split("PartitionFilters")[1] and "EqualTo(who,5)" in text.split("PushedFilters")[1]
    # Each file of a partition holds a span of its own.
    spans = back.filter("year = 2002").groupBy(F.input_file_name().alias("f")).agg(F.min("who").alias("a"), F.max("who").alias("b")).orderBy("a").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(spans, spans[1:]))
    write_table(facts.filter("year = 2000"), path, ["year"])
    assert read_table(spark, path).count() == 3000
    with pytest.raises(ValueError, match="without partitions"):
        write_table(facts, path, replace="partitions")
    with pytest.raises(ValueError, match="table or partitions"):
        write_table(facts, path, ["year"], replace="all")


def test_written_tables_lie_in_the_folder_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named
    assert f"{named}/{spark.sparkContext.applicationId}/" in written(spark.range(3)).inputFiles()[0]
    unset = SimpleNamespace(conf={"spark.sql.warehouse.dir": "file:/data/warehouse/"})  # a setting the session does not let go of
    assert shared_folder(unset) == "/data/warehouse/_written"
    assert shared_folder(SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://store/own/"})) == "hdfs://store/own"


def test_sheets_written_as_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "02-CABA"), (2, "y", "06 B A")], "row int, A string, sheet string")
    df.write.partitionBy("sheet").option("header", True).csv(str(tmp_path / "s"))
    schema = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("A", T.StringType())])
    assert rows(read_sheets(spark, str(tmp_path / "s"), schema, folders=True), "row") == [(1, "x", "02-CABA"), (2, "y", "06 B A")]


def test_margins_of_the_independence_test_need_no_window(spark, plan):
    df = spark.range(20_000).select((F.col("id") % 7).alias("a"), (F.col("id") % 1000).alias("b"))
    test = chi_square(df, "a", "b")
    assert "Window" not in plan(test)
    got = test.first()
    assert got["n"] == 20_000 and got["df"] == 6 * 999
    counts = {}
    for i in range(20_000):
        counts[i % 7, i % 1000] = counts.get((i % 7, i % 1000), 0) + 1
    r = {a: sum(n for (x, _), n in counts.items() if x == a) for a in range(7)}
    want = sum((counts.get((a, b), 0) - r[a] * 20 / 20_000) ** 2 / (r[a] * 20 / 20_000) for a in range(7) for b in range(1000))
    assert got["statistic"] == pytest.approx(want)


def test_summary_lists_empty_cells(spark):
    df = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a"), ("h", "a")], "by string, x string")
    table = summary_by_group(df, "by", "x").select("by", "x", "n", "pct_text", "group_n", "group_text")
    assert rows(table, "by", "x") == [
        ("g", "a", 1, "50.0%", 2, "50.0%"),
        ("g", "b", 1, "50.0%", 2, "50.0%"),
        ("h", "a", 2, "100.0%", 2, "50.0%"),
        ("h", "b", 0, "0.0%", 2, "50.0%"),
    ]


def test_summary_shares_of_known_levels(spark):
    df = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", None), ("h", None)], "by string, x string")
    got = {(r["by"], r["x"]): (r["n"], r["pct"], r["valid_pct"]) for r in summary_by_group(df, "by", "x").collect()}
    assert got[("g", "a")] == (1, pytest.approx(1 / 3), 0.5) and got[("g", None)] == (1, pytest.approx(1 / 3), None)
    assert got[("h", "a")] == (0, 0.0, None) and got[("h", None)] == (1, 1.0, None)


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(c,) for c in "cabcabd"], "x string")
    assert [r["x"] for r in top_k(df, ["x"], 3).orderBy(F.desc("n"), "x").collect()] == ["a", "b", "c"]


@pytest.mark.parametrize(
    "cells, statistic, p",
    [
        # Textbook values: 2 x 2 (one degree of freedom), 2 x 3 with an empty cell.
        ({("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 40}, 0.793650793650794, 0.3729984836),
        ({("a", "x"): 5, ("a", "y"): 5, ("b", "x"): 2, ("b", "z"): 8}, 14.285714285714, 0.0007905),
    ],
)
def test_chi_square(spark, cells, statistic, p):
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "a string, b string")
    test = chi_square(df, "a", "b").first()
    assert test["statistic"] == pytest.approx(statistic, rel=1e-9)
    assert test["p_value"] == pytest.approx(p, rel=1e-3)


def test_chi_square_tail_against_known_quantiles():
    from ratewright.operators.frequency import _tail

    # Upper 5 % points of the chi-square distribution.
    for df, x in {1: 3.841459, 2: 5.991465, 3: 7.814728, 4: 9.487729, 7: 14.067140, 18: 28.869299}.items():
        assert _tail(x, df) == pytest.approx(0.05, abs=1e-7)
    # Near the mean of many degrees of freedom the tail is a little below one half.
    for df in (1490, 1500, 13_924, 100_000, 1_000_001):
        assert _tail(df, df) == pytest.approx(0.5 - 1 / (3 * (3.141592653589793 * df) ** 0.5), abs=1e-6)
    assert _tail(13_674, 13_924) == pytest.approx(0.933, abs=2e-3)
    assert _tail(0, 5) == 1.0 and _tail(float("inf"), 5) == 0.0 and _tail(1e6, 5) == 0.0


def test_margins_are_left_out(spark):
    df = spark.createDataFrame([("Total", 3), ("m", 1), (None, 2)], "sex string, n int")
    assert sorted(r["n"] for r in without_margins(df, {"sex": "Total"}).collect()) == [1, 2]


def test_coverage(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    right = spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(join_coverage(left, right, ["k"]), "k") == [(1, 2, 0), (3, 0, 1)]
    assert rows(coverage_summary(left, right, ["k"]), "side") == [("both", 1, 1, 1), ("left", 1, 2, 0), ("right", 1, 0, 1)]
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert rows(null_report(df, ["a", "b"]), "column") == [("a", 2, 1), ("b", 2, 2)]
