"""The three jobs end to end on tables derived from the given ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.rates import limits_sql
from catalog.redistribution import recoded
from catalog.tables import AGE_CODES, CLEAN_RECORDS_SQL, RAW_RECORDS_SQL, raw_records, recoded_sql, rounded, table
from ratewright import fixed_values as fixed
from ratewright.plans.analysis import case_counts, cause_by_age, exploratory_tables, ill_defined_rates, trends
from ratewright.plans.population import annual_population, monthly_population, run, standard_population
from ratewright.plans.records import clean_records, quality_tables
from ratewright.sources.losses import Losses
from ratewright.sources.tables import read_table, shared_folder, written

PROVINCES = (
    "02-CABA",
    "06-BUENOS AIRES",
    "10-CATAMARCA",
    "14-CÓRDOBA",
    "18-CORRIENTES",
    "38-JUJUY",
    "42-LA PAMPA",
    "50-MENDOZA",
    "66-SALTA",
    "70-SAN JUAN",
    "78-SANTA CRUZ",
    "90-TUCUMÁN",
)
AGES = ("0-4", "5-9", "15-19", "20-24", "35-39", "40-44", "50-54", "55-59", "65-69", "70-74", "75-79", "80-84", "100 y más", "Total")
STANDARD_LABELS = ("00 a 04", "05 a 09", "10 a 14", "15 a 19", "20 a 24", "35 a 39", "40 a 44", "50 a 54", "65 a 69", "70 a 74", "80 a 84")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _list_sql(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def projections(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as wide projections: province x age rows, sex x year text columns."""
    c = table(spark, sf, "customer")
    balance = F.sum(F.round(F.abs("c_acctbal")).cast("bigint"))
    cells = [
        F.format_string("%,d", balance * (year - 2000) * (i + 1)).alias(f"v{year}_{i}")
        for year in fixed.PROJECTION_YEARS
        for i in range(3)
    ]
    age = F.when(F.col("c_custkey") % 97 != 0, _pick(AGES, F.col("c_custkey") % 14))
    return c.groupBy(_pick(PROVINCES, F.col("c_nationkey") % 12).alias("province"), age.alias("age")).agg(*cells)


ANNUAL_SQL = f"""
base AS (SELECT ({_list_sql(PROVINCES)})[c_nationkey % 12 + 1] AS province, CASE WHEN c_custkey % 97 <> 0 THEN ({_list_sql(AGES)})[c_custkey % 14 + 1] END AS age,
  CAST(round(abs(c_acctbal)) AS BIGINT) AS b FROM customer),
placed AS (SELECT CASE WHEN province[1:2] IN ('02', '06', '14') THEN 'Centro' WHEN province[1:2] = '18' THEN 'NEA' WHEN province[1:2] IN ('38', '66', '90') THEN 'NOA1'
    WHEN province[1:2] = '10' THEN 'NOA2' WHEN province[1:2] IN ('50', '70') THEN 'Cuyo' WHEN province[1:2] = '42' THEN 'Patagonia Norte' ELSE 'Patagonia Sur' END AS region,
  CASE province WHEN '02-CABA' THEN 'CABA' WHEN '06-BUENOS AIRES' THEN 'Buenos Aires' WHEN '10-CATAMARCA' THEN 'NOA2' WHEN '14-CÓRDOBA' THEN 'Córdoba' WHEN '18-CORRIENTES' THEN 'Corrientes'
    WHEN '38-JUJUY' THEN 'NOA1' WHEN '42-LA PAMPA' THEN 'Patagonia Norte' WHEN '50-MENDOZA' THEN 'Mendoza' WHEN '66-SALTA' THEN 'NOA1' WHEN '70-SAN JUAN' THEN 'Cuyo'
    WHEN '78-SANTA CRUZ' THEN 'Patagonia Sur' ELSE 'Tucumán' END AS jurisdiction,
  CASE WHEN age IN ('0-4', '5-9', '15-19') THEN '<20 años' WHEN age IN ('20-24', '35-39') THEN '20-39 años' WHEN age = '40-44' THEN '40-49 años' WHEN age IN ('50-54', '55-59') THEN '50-59 años'
    WHEN age = '65-69' THEN '60-69 años' WHEN age IN ('70-74', '75-79') THEN '70-79 años' ELSE '≥80 años' END AS age_band, b
  FROM base WHERE age IS NOT NULL AND age <> 'Total'),
annual AS (SELECT region, jurisdiction, CAST(y AS INTEGER) AS year, sex, age_band, CAST(sum(b * (y - 2000) * k) AS DOUBLE) AS projected
  FROM placed, (SELECT unnest(range(2010, 2025)) AS y), (VALUES ('Total', 1), ('Masculino', 2), ('Femenino', 3)) s(sex, k) GROUP BY ALL)
"""


def population_annual(spark: SparkSession, sf: str) -> DataFrame:
    return annual_population(projections(spark, sf))


POPULATION_ANNUAL = f"WITH {ANNUAL_SQL} SELECT * FROM annual"


def population_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(monthly_population(annual_population(projections(spark, sf))), "population")


POPULATION_MONTHLY = f"""
WITH {ANNUAL_SQL},
seg AS (SELECT *, make_date(year, 1, 1) AS a, make_date(year + 1, 1, 1) AS b, lead(projected) OVER (PARTITION BY region, jurisdiction, sex, age_band ORDER BY year) AS next FROM annual),
grid AS (SELECT region, jurisdiction, sex, age_band, CAST(m AS DATE) AS m FROM (SELECT DISTINCT region, jurisdiction FROM annual), (SELECT DISTINCT sex FROM annual), (SELECT DISTINCT age_band FROM annual),
  (SELECT unnest(generate_series(DATE '2010-01-01', DATE '2023-12-01', INTERVAL 1 MONTH)) AS m))
SELECT CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, region, jurisdiction, sex, age_band,
  round(projected + (next - projected) * date_diff('day', a, m) / date_diff('day', a, b), 6) AS population
FROM grid LEFT JOIN seg USING (region, jurisdiction, sex, age_band) WHERE seg.year IS NULL OR seg.year = year(m)
"""


def standard_cells(spark: SparkSession, sf: str) -> DataFrame:
    age = _pick(STANDARD_LABELS, F.col("c_custkey") % 11)
    return table(spark, sf, "customer").groupBy(age.alias("age")).agg(
        F.sum(F.round(F.abs("c_acctbal")).cast("bigint")).alias("cases")
    )


STANDARD_SQL = f"""
standard AS (SELECT CASE WHEN age IN ('00 a 04', '05 a 09', '10 a 14', '15 a 19') THEN '<20 años' WHEN age IN ('20 a 24', '35 a 39') THEN '20-39 años' WHEN age = '40 a 44' THEN '40-49 años'
    WHEN age = '50 a 54' THEN '50-59 años' WHEN age = '65 a 69' THEN '60-69 años' WHEN age = '70 a 74' THEN '70-79 años' ELSE '≥80 años' END AS age_band,
  CAST(sum(b) AS BIGINT) AS standard FROM (SELECT ({_list_sql(STANDARD_LABELS)})[c_custkey % 11 + 1] AS age, CAST(round(abs(c_acctbal)) AS BIGINT) AS b FROM customer) GROUP BY 1)
"""


def population_standard(spark: SparkSession, sf: str) -> DataFrame:
    return standard_population(standard_cells(spark, sf))


POPULATION_STANDARD = f"WITH {STANDARD_SQL} SELECT * FROM standard"


def records_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The four quality tables in one."""
    tables = quality_tables(raw_records(spark, sf))
    parts = [
        t.select(F.lit(name).alias("variable"), F.col(t.columns[0]).cast("string").alias("level"), "n", "pct_text")
        for name, t in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


RECORDS_QUALITY = f"""
WITH {RAW_RECORDS_SQL},
q AS (SELECT 'year' AS variable, CAST(anio_def AS VARCHAR) AS level, count(*) AS n, 2 AS d FROM raw GROUP BY ALL
  UNION ALL SELECT 'region', region, count(*), 1 FROM raw WHERE anio_def BETWEEN 2010 AND 2023 GROUP BY ALL
  UNION ALL SELECT 'age', grupo_etario, count(*), 2 FROM raw WHERE anio_def BETWEEN 2010 AND 2023 AND region NOT LIKE '10.%' GROUP BY ALL
  UNION ALL SELECT 'sex', CAST(sexo_id AS VARCHAR), count(*), 2 FROM raw WHERE anio_def BETWEEN 2010 AND 2023 AND region NOT LIKE '10.%' AND grupo_etario <> '08.sin especificar' GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY variable) * 100 AS p FROM q)
SELECT variable, level, n, CASE d WHEN 1 THEN printf('%.1f%%', round_even(p, 1)) ELSE printf('%.2f%%', round_even(p, 2)) END AS pct_text FROM p
"""


def records_clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_records(raw_records(spark, sf), AGE_CODES)


RECORDS_CLEAN = f"WITH {CLEAN_RECORDS_SQL} SELECT * FROM records"


def records_losses(spark: SparkSession, sf: str) -> DataFrame:
    """What each condition drops, counted by the pass that writes the clean records."""
    losses = Losses()
    written(clean_records(raw_records(spark, sf), AGE_CODES, losses=losses))
    return losses.table(spark)


RECORDS_LOSSES = f"""
WITH {RAW_RECORDS_SQL},
m AS (SELECT anio_def BETWEEN 2010 AND 2023 AS p, region <> '10.sin especificar.' AS r, grupo_etario <> '08.sin especificar' AS a, sexo_id BETWEEN 1 AND 2 AS s FROM raw)
SELECT 'clean' AS step, 'records' AS metric, count(*) AS n FROM m UNION ALL SELECT 'clean', 'no_period', count(*) FILTER (NOT p) FROM m
UNION ALL SELECT 'clean', 'no_region', count(*) FILTER (p AND NOT r) FROM m UNION ALL SELECT 'clean', 'no_age', count(*) FILTER (p AND r AND NOT a) FROM m
UNION ALL SELECT 'clean', 'no_sex', count(*) FILTER (p AND r AND a AND NOT s) FROM m
"""


def records_by_cause(spark: SparkSession, sf: str) -> DataFrame:
    """Causes within age bands, ill-defined groups merged, in reporting order."""
    df = cause_by_age(case_counts(recoded(spark, sf)))
    return rounded(df.select("age_band", "cause", "n", "group_n", "pct", "position"), "pct")


def records_by_cause_sql() -> str:
    return (
        "WITH "
        + recoded_sql()
        + """, c AS (SELECT age_band, CASE WHEN group_2 IN ('GC1', 'GC2') THEN 'GC1-GC2' WHEN group_2 IN ('GC3', 'GC4') THEN 'GC3-GC4' ELSE group_2 END AS cause FROM recoded),
g AS (SELECT age_band, count(*) AS group_n FROM c GROUP BY 1), k AS (SELECT DISTINCT cause FROM c), n AS (SELECT age_band, cause, count(*) AS n FROM c GROUP BY ALL)
SELECT g.age_band, k.cause, coalesce(n.n, 0) AS n, group_n, round(coalesce(n.n, 0) / group_n, 6) AS pct,
  CAST(nullif(list_position(['CMNN', 'Diabetes', 'ECV', 'ERC', 'Neoplasias', 'Otras ENT', 'Homicidio', 'Suicidio', 'Tránsito', 'Otras CE', 'GC1-GC2', 'GC3-GC4'], k.cause), 0) AS INTEGER) AS position
FROM g CROSS JOIN k LEFT JOIN n ON n.age_band = g.age_band AND n.cause IS NOT DISTINCT FROM k.cause
"""
    )


def records_top_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The fifteen most frequent ill-defined codes."""
    return rounded(exploratory_tables(case_counts(recoded(spark, sf)))["codes"], "pct")


def records_top_codes_sql() -> str:
    return (
        "WITH "
        + recoded_sql()
        + """, c AS (SELECT code, count(*) AS n FROM recoded WHERE group_2 IN ('GC1', 'GC2') GROUP BY 1)
SELECT code, n, round(n / t, 6) AS pct, printf('%.1f%%', round_even(n / t * 100, 1)) AS pct_text FROM c, (SELECT sum(n) AS t FROM c) ORDER BY n DESC, code LIMIT 15
"""
    )


def records_age_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(exploratory_tables(case_counts(recoded(spark, sf)))["age_by_group"], "p_CE", "p_CMNN", "p_ENT", "p_GC", "p_NA")


def records_age_by_group_sql() -> str:
    counts = ", ".join(f"count(*) FILTER (group_1 = '{g}') AS n_{g}" for g in ("CE", "CMNN", "ENT", "GC"))
    counts += ", count(*) FILTER (group_1 IS NULL OR group_1 NOT IN ('CE', 'CMNN', 'ENT', 'GC')) AS n_NA, count(*) AS total"
    shares = ", ".join(f"round(n_{g} / total, 6) AS p_{g}" for g in ("CE", "CMNN", "ENT", "GC", "NA"))
    return (
        "WITH "
        + recoded_sql()
        + f""", w AS (SELECT CASE WHEN grouping(age_band) = 1 THEN 'Total' ELSE age_band END AS age_band, {counts} FROM recoded GROUP BY ROLLUP (age_band))
SELECT * EXCLUDE (total), {shares} FROM w
"""
    )


def rates(spark: SparkSession, sf: str, by: tuple[str, ...]) -> DataFrame:
    monthly = monthly_population(annual_population(projections(spark, sf)), step="1 year")  # the rates are by January
    return ill_defined_rates(recoded(spark, sf), monthly, population_standard(spark, sf), by)


def ill_defined_rates_year(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates(spark, sf, ()), "total_pop", "value", "lowercl", "uppercl")


def ill_defined_rates_region(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates(spark, sf, ("region",)), "total_pop", "value", "lowercl", "uppercl")


def rates_sql(by: str, series: str, digits: int = 6) -> str:
    least = 10
    return (
        "WITH "
        + recoded_sql()
        + f""", {ANNUAL_SQL}, {STANDARD_SQL},
cells AS (SELECT year, {by} age_band, group_2, count(*) AS n FROM recoded WHERE group_1 LIKE '%GC%' GROUP BY ALL),
pop AS (SELECT year, {by} age_band, sum(projected) AS pop FROM annual WHERE sex <> 'Total' GROUP BY ALL),
joined AS (SELECT cells.*, pop, CAST(standard AS DOUBLE) AS w FROM cells LEFT JOIN pop USING (year, {by} age_band) LEFT JOIN standard USING (age_band)),
s AS (SELECT year, {by} group_2, CAST(sum(n) AS DOUBLE) AS o, sum(pop) AS p, sum(w * n / pop) AS wr, sum(w) AS w, sum(w * w * n / (pop * pop)) AS wv, bool_or(pop IS NULL OR w IS NULL) AS gap FROM joined GROUP BY ALL)
SELECT year, {by} group_2, {series} CAST(o AS BIGINT) AS total_count, round(p, 6) AS total_pop,
  CASE WHEN o >= {least} AND NOT gap THEN round(1e5 * wr / w, {digits}) END AS value,
  CASE WHEN o >= {least} AND NOT gap THEN round(1e5 * (wr / w + sqrt(wv / (w * w * o)) * (o * pow(1 - 1 / (9 * o) - 1.959963984540054 / (3 * sqrt(o)), 3) - o)), {digits}) END AS lowercl,
  CASE WHEN o >= {least} AND NOT gap THEN round(1e5 * (wr / w + sqrt(wv / (w * w * o)) * ((o + 1) * pow(1 - 1 / (9 * (o + 1)) + 1.959963984540054 / (3 * sqrt(o + 1)), 3) - o)), {digits}) END AS uppercl
FROM s
"""
    )


def population_to_rates(spark: SparkSession, sf: str) -> DataFrame:
    """The documented flow: the population job writes its files, the analysis reads them back and gives rates."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/population-{uuid.uuid4().hex}"
    run(spark, projections(spark, sf), standard_cells(spark, sf), folder)
    monthly, weights = read_table(spark, f"{folder}/population_monthly"), read_table(spark, f"{folder}/standard_population")
    return rounded(ill_defined_rates(recoded(spark, sf), monthly, weights), "total_pop", "value", "lowercl", "uppercl")


def ill_defined_trends(spark: SparkSession, sf: str) -> DataFrame:
    """Joinpoint trends of the yearly rates per ill-defined level, with limits."""
    lines = trends(rates(spark, sf, ()), ["group_2"])["segments"].drop("knot", "sse", "bic")
    numbers = ("intercept", "slope", "slope_se", "apc", "apc_low", "apc_high", "aapc", "aapc_low", "aapc_high")
    return rounded(lines, *numbers)


def ill_defined_trends_sql() -> str:
    series = f"""rates AS ({rates_sql("", "", 15)}),
s AS (SELECT group_2 AS g, CAST(year AS DOUBLE) AS t, ln(value) AS y FROM rates WHERE value > 0)"""
    return (
        limits_sql(series)
        + """
SELECT p.g AS group_2, p.m AS points, CAST(p.j AS INTEGER) AS joinpoints, CAST(p.segment AS INTEGER) AS segment, p.first, p.last,
  round(c.f0 - p.slope * p.first, 6) AS intercept, round(p.slope, 6) AS slope, round(p.se, 6) AS slope_se, round(p.change, 6) AS apc, round(p.low, 6) AS apc_low, round(p.high, 6) AS apc_high,
  round(a.change, 6) AS aapc, round(a.low, 6) AS aapc_low, round(a.high, 6) AS aapc_high
FROM pct p JOIN pct a ON a.g = p.g AND a.segment = 0 JOIN cut c ON c.g = p.g AND c.segment = p.segment WHERE p.segment > 0
"""
    )


QUERIES = {
    "population_annual": (population_annual, POPULATION_ANNUAL),
    "population_monthly": (population_monthly, POPULATION_MONTHLY),
    "population_standard": (population_standard, POPULATION_STANDARD),
    "records_quality": (records_quality, RECORDS_QUALITY),
    "records_clean": (records_clean, RECORDS_CLEAN),
    "records_losses": (records_losses, RECORDS_LOSSES),
    "records_by_cause": (records_by_cause, records_by_cause_sql),
    "records_top_codes": (records_top_codes, records_top_codes_sql),
    "records_age_by_group": (records_age_by_group, records_age_by_group_sql),
    "ill_defined_rates_year": (ill_defined_rates_year, lambda: rates_sql("", "")),
    "ill_defined_rates_region": (ill_defined_rates_region, lambda: rates_sql("region,", "region || '_' || group_2 AS series,")),
    "population_to_rates": (population_to_rates, lambda: rates_sql("", "")),
    "ill_defined_trends": (ill_defined_trends, ill_defined_trends_sql),
}
