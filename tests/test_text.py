from pyspark.sql import functions as F

from ratewright.functions.text import (
    normalise_code,
    number_text,
    parse_number,
    percent_text,
    remove_first,
    replace_first,
    snake_names,
    strip_digits_and_marks,
    title_case,
    united,
)


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr.alias("x")).collect()]


def test_normalise_code(spark):
    codes = ["i64x", "E10", "J189", "X84X", "i641x", None]
    assert values(spark, codes, normalise_code("t")) == ["I64.0", "E10.", "J18.9", "X84.0", "I641.0", None]
    assert values(spark, ["E10", "J189"], normalise_code("t", pad="0")) == ["E10.0", "J18.9"]


def test_first_match_edits(spark):
    assert values(spark, ["a-b-c", "abc", None], replace_first("t", "-", "+")) == ["a+b-c", "abc", None]
    assert values(spark, ["GC3-Otras ENT", "a-b-c"], remove_first("t", "^.*-")) == ["Otras ENT", "c"]
    assert values(spark, ["x\ny.z."], remove_first("t", r"\.")) == ["x\nyz."]
    assert values(spark, ["14.Córdoba (1)"], strip_digits_and_marks("t")) == ["Córdoba "]


def test_title_case_splits_at_hyphens(spark):
    assert values(spark, ["BUENOS AIRES", "alta-GRACIA", "ñandú"], title_case("t")) == ["Buenos Aires", "Alta-Gracia", "Ñandú"]


def test_parse_number(spark):
    texts = ["1,234.5", "x2010", "-7 kg", "none", None, "12."]
    assert values(spark, texts, parse_number("t")) == [1234.5, 2010.0, -7.0, None, None, 12.0]
    assert values(spark, ["1.234,5"], parse_number("t", ".", ",")) == [1234.5]


def test_number_labels(spark):
    row = spark.range(1).select(
        percent_text(F.lit(0.12345)).alias("a"),
        percent_text(F.lit(0.125), 0).alias("tie"),
        number_text(F.lit(1234567.891), 2).alias("b"),
    ).first()
    assert tuple(row) == ("12.3%", "12%", "1.234.567,89")


def test_united_writes_missing_values(spark):
    df = spark.createDataFrame([("a", None), (None, "b")], "x string, y string")
    assert [r[0] for r in df.select(united(["x", "y"])).collect()] == ["a_NA", "NA_b"]


def test_snake_names():
    assert snake_names(["Edad (años)", "x2010", "Edad años", "2010", "casosTotales", "%"]) == [
        "edad_anos",
        "x2010",
        "edad_anos_2",
        "x2010_2",
        "casos_totales",
        "percent",
    ]
