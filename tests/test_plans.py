"""The three jobs on small hand-made inputs, and the stateless recodes on a stream."""

import pytest
from pyspark.sql import functions as F

from catalog.tables import AGE_CODES, cause_rules
from ratewright import fixed_values as fixed
from ratewright.operators.redistribute import number_copies, row_key
from ratewright.plans import analysis, population, records
from ratewright.sources.losses import Losses
from ratewright.sources.tables import read_table, written

RAW = [
    # year, month, region, jurisdiction, sex, age, code
    (2010, 1, "5.Cuyo.", "50.Mendoza", 1, "02.x", "i64x"),
    (2010, 2, "3.NOA1.", "90.Tucumán", 2, "01.x", "E109"),
    (2011, 3, "4.NOA2.", "10.Catamarca", 1, "02.x", "E10"),
    (2011, 3, "1.Centro.", "06.BsAs", 1, "02.x", "J189"),
    (2011, 4, "8.Pat.N", "99.Resto", 2, "01.x", "I509"),
    (2011, 4, "1.Centro.", "26.Chubut", 2, "01.x", "X84X"),
    (2009, 1, "1.Centro.", "14.Cba", 1, "01.x", "E109"),
    (2010, 1, "10.sin especificar.", "14.Cba", 1, "01.x", "E109"),
    (2010, 1, "1.Centro.", "14.Cba", 1, "08.sin especificar", "E109"),
    (2010, 1, "1.Centro.", "14.Cba", 9, "01.x", "E109"),
]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(RAW, records.RAW_SCHEMA)


def levels(n):
    """The age labels of the fixture, filled up to the seven levels of the data."""
    return ["01.x", "02.x"] + [f"{i:02d}.y" for i in range(3, 8)]


def test_clean_records(raw):
    got = {tuple(r) for r in records.clean_records(raw, levels(7)).collect()}
    assert got == {
        (2010, 1, "Cuyo", "Mendoza", "Masculino", "20-39 años", "I64.0"),
        (2010, 2, "NOA1", "Tucumán", "Femenino", "<20 años", "E10.9"),
        (2011, 3, "NOA2", "Catamarca", "Masculino", "20-39 años", "E10."),
        (2011, 3, "Centro", "Buenos Aires", "Masculino", "20-39 años", "J18.9"),
        (2011, 4, "Patagonia Norte", "Patagonia Norte", "Femenino", "<20 años", "I50.9"),
        (2011, 4, "Centro", "Chubut", "Femenino", "<20 años", "X84.0"),
    }
    with pytest.raises(ValueError, match="levels for 7 labels"):
        records.clean_records(raw)


def test_clean_records_report_what_they_drop(raw):
    losses = Losses()
    more = raw.unionByName(raw.limit(1).withColumn("sexo_id", F.lit(None).cast("int")))
    assert written(records.clean_records(more, levels(7), losses=losses)).count() == 6
    assert losses.counts() == [("clean", "records", 11), ("clean", "no_period", 1), ("clean", "no_region", 1), ("clean", "no_age", 1), ("clean", "no_sex", 2)]


def test_januaries_are_those_of_the_monthly_population(spark):
    rows = [("r", "j", y, "Femenino", "20-39 años", float(v)) for y, v in ((2010, 100), (2012, 130), (2024, 400))]
    annual = spark.createDataFrame(rows, "region string, jurisdiction string, year int, sex string, age_band string, projected double")
    monthly = population.monthly_population(annual).filter("month = 1")
    yearly = population.monthly_population(annual, step="1 year")
    key = lambda df: sorted((r["year"], r["month"], r["population"]) for r in df.collect())
    assert key(monthly) == key(yearly) and len(key(yearly)) == 14


def test_quality_tables(raw):
    tables = {k: {r[0]: r["n"] for r in t.collect()} for k, t in records.quality_tables(raw).items()}
    assert tables["year"] == {2009: 1, 2010: 5, 2011: 4}
    assert tables["region"]["10.sin especificar."] == 1 and sum(tables["region"].values()) == 9
    assert tables["age"]["08.sin especificar"] == 1 and sum(tables["age"].values()) == 8
    assert tables["sex"] == {1: 3, 2: 3, 9: 1}


def test_residual_label_decides_whether_late_stages_fire(raw):
    df = records.clean_records(raw, levels(7)).withColumn("key", F.col("code"))

    def final(residual, stages):
        coded = records.recode_records(df, cause_rules(), residual)
        out = records.redistribute_records(coded, "key", stages, "quota")
        return {r["code"]: (r["group_2_1"], r["group_2_4"]) for r in out.collect()}

    intended = final("group_2", records.STAGES)
    # Pneumonia is split between CMNN and chronic causes; general GC2 goes to the defined causes of its stratum.
    assert intended["J18.9"][0] == "GC4" and intended["J18.9"][1] in ("CMNN", "ECV")
    assert intended["I50.9"][0] == "GC2" and intended["I50.9"][1] in ("Diabetes", "Suicidio")
    assert intended["I64.0"] == ("ECV", "ECV") and intended["E10."] == (None, None)
    literal = final("group_1", records.STAGES_ON_LEVEL_ONE)
    assert literal["J18.9"] == ("GC", "GC") and literal["I50.9"] == ("GC", "GC")
    assert literal["X84.0"] == ("Suicidio", "Suicidio")


def wide_population(spark):
    """Two provinces, two ages, 45 text columns: province factor x age factor x sex factor x year offset."""
    names = [f"c{i}" for i in range(45)]
    rows = []
    for prov, p in (("02-CABA", 1), ("46-LA RIOJA", 2)):
        for age, a in (("0-4", 10), ("15-19", 10), ("80-84", 5), ("Total", 999), (None, 999)):
            values = [f"{p * a * s * 1000 * (1 + y):,}" for y in range(15) for s in (3, 1, 2)]
            rows.append((prov, age, *values))
    return spark.createDataFrame(rows, "province string, age string, " + ", ".join(f"{n} string" for n in names))


def test_population_job(spark, tmp_path):
    standard = spark.createDataFrame([("00 a 04", 5), ("15 a 19", 7), ("70 a 74", 2), ("Total", 99)], "age string, cases long")
    population.run(spark, wide_population(spark), standard, str(tmp_path))
    weights = {r[0]: r[1] for r in read_table(spark, f"{tmp_path}/standard_population").collect()}
    assert weights == {"<20 años": 12, "70-79 años": 2, None: 99}
    monthly = read_table(spark, f"{tmp_path}/population_monthly")
    assert monthly.count() == 2 * 3 * 2 * 168
    assert {tuple(r) for r in monthly.select("region", "jurisdiction").distinct().collect()} == {("Centro", "CABA"), ("Cuyo", "Cuyo")}

    def at(year, month, sex="Masculino", region="Cuyo", age="<20 años"):
        keep = (F.col("year") == year) & (F.col("month") == month) & (F.col("sex") == sex) & (F.col("region") == region)
        return monthly.filter(keep & (F.col("age_band") == age)).first()["population"]

    assert at(2010, 1) == 40_000 and at(2011, 1) == 80_000
    assert at(2010, 7) == pytest.approx(40_000 + 40_000 * 181 / 365)
    # The last year is filled up to December from the anchor that follows it.
    assert at(2023, 12) == pytest.approx(14 * 40_000 + 40_000 * 334 / 365)
    assert monthly.filter("population is null").count() == 0


def test_record_and_analysis_jobs(spark, tmp_path):
    """Many records through all jobs: totals are kept and the tables come out complete."""
    codes = ["E109", "I219", "J449", "C509", "V031", "X702", "X954", "A419", "I509", "J189", "X599", "Y209", "R999", "W760", "J961", "ZZ9"]
    rows = [
        (2010 + i % 14, 1 + i % 12, "1.Centro." if i % 3 else "5.Cuyo.", "14.Cba", 1 + i % 2, f"{1 + i % 7:02d}.x", codes[i * 7 % 16])
        for i in range(4000)
    ]
    raw = spark.createDataFrame(rows, records.RAW_SCHEMA)
    keyed = number_copies(raw).withColumn("key", row_key([*raw.columns, "copy"]))
    path = str(tmp_path / "records")
    records.run(spark, keyed, cause_rules(), "key", path)
    df = read_table(spark, path)
    assert df.count() == 4000
    left = {r[0] for r in df.select("group_2_4").distinct().collect()}
    assert not any(v and v.startswith("GC") for v in left)
    again = records.redistribute_records(
        records.recode_records(records.clean_records(keyed), cause_rules()), "key"
    ).select("key", "group_2_4")
    assert again.join(df.select("key", F.col("group_2_4").alias("g")), "key").filter(~F.col("g").eqNullSafe(F.col("group_2_4"))).count() == 0

    cube = analysis.case_counts(df)
    tables = {k: t.collect() for k, t in analysis.exploratory_tables(cube).items()}
    assert len(tables["sex"]) == 2 and len(tables["age"]) == 7 and tables["age_test"][0]["n"] > 0
    assert {r["age_band"] for r in tables["age_by_group"]} == {*fixed.AGE_BANDS, "Total"}
    assert sum(r["n"] for r in analysis.cause_by_age(cube).collect()) == 4000

    monthly = spark.createDataFrame(
        [(2010 + y, 1, r, s, a, 1e6 + y) for y in range(14) for r in ("Centro", "Cuyo") for s in fixed.SEXES for a in fixed.AGE_BANDS],
        "year int, month int, region string, sex string, age_band string, population double",
    )
    standard = spark.createDataFrame([(a, 100 + i) for i, a in enumerate(fixed.AGE_BANDS)], "age_band string, standard long")
    rates = analysis.ill_defined_rates(df, monthly, standard)
    first = rates.filter("year = 2010").orderBy("group_2").first()
    # Both sexes and both regions, without the total rows.
    assert first["total_pop"] % 4e6 == 0
    out = analysis.trends(rates.cache(), ["group_2"], 2)
    assert out["segments"].count() >= out["average"].count() > 0
    assert out["points"].filter("fit is null").count() == 0
    assert analysis.rate_density(rates, ["group_2"]).groupBy("group_2").count().filter("count != 512").count() == 0
    assert analysis.rate_density(rates.filter("value < 0"), ["group_2"]).count() == 0
    assert analysis.population_gaps(df, monthly).filter("right_rows = 0").count() == 0
    gaps = analysis.population_gaps(df, monthly.filter("year > 2010"), ("region",))
    assert {r["year"] for r in gaps.filter("right_rows = 0").collect()} == {2010}
    regional = analysis.ill_defined_rates(df, monthly, standard, ("region",))
    assert {"region", "group_2", "series"} <= set(regional.columns)


def test_recodes_run_on_a_stream(spark, tmp_path, raw):
    """Cleaning and recoding keep no state, so the same functions take a streaming table."""
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(records.RAW_SCHEMA).parquet(str(tmp_path / "in"))
    coded = records.recode_records(records.clean_records(stream, levels(7)), cause_rules())
    query = (
        coded.writeStream.format("memory")
        .queryName("coded")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = {r["code"]: r["label"] for r in spark.table("coded").collect()}
    assert got == {"I64.0": "GC4-ECV", "E10.9": "Diabetes", "E10.": None, "J18.9": "GC4-Neumonías NE", "I50.9": "GC2", "X84.0": "GC4-Suicidio"}


def test_age_codes_match_bands():
    assert len(AGE_CODES) == len(fixed.AGE_BANDS)
