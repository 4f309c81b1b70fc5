"""Code ranges, patterns, bands, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import cause_rules, labelled_sql, rules_sql, table
from ratewright.operators.recode import (
    band_recode,
    level_order,
    pattern_recode,
    range_recode,
    relabel_levels,
    set_recode,
    two_way,
)
from ratewright.operators.ranks import level_table
from ratewright.plans.records import level_one, level_two, specific_reassign


def part_codes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(
            F.chr(65 + F.col("p_partkey") % 26), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("."), (F.col("p_partkey") % 10).cast("string")
        ).alias("code"),
    )


PART_CODES = """part_codes AS (SELECT p_partkey, chr(CAST(65 + p_partkey % 26 AS INTEGER)) || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || p_partkey % 10 AS code FROM part)"""


def priority_range_recode(spark: SparkSession, sf: str) -> DataFrame:
    return range_recode(part_codes(spark, sf), "code", cause_rules(), "label")


def priority_range_recode_sql() -> str:
    return f"""WITH {rules_sql()}, {PART_CODES}, {labelled_sql('part_codes')}
SELECT p_partkey, code, label FROM part_codes JOIN labelled USING (code)"""


def item_codes(spark: SparkSession, sf: str) -> DataFrame:
    """A code from each line item, spread over all letters and numbers."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    digits = F.lpad(F.expr("cast((cents div 26) % 1000 as string)"), 3, "0")
    code = F.concat(F.chr(F.expr("65 + cents % 26")), F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 1))
    return table(spark, sf, "lineitem").withColumn("cents", cents).select(code.alias("code"), "l_quantity")


ITEM_CODES = """cents AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
digits AS (SELECT cents, lpad(CAST((cents // 26) % 1000 AS VARCHAR), 3, '0') AS d FROM cents),
items AS (SELECT chr(CAST(65 + cents % 26 AS INTEGER)) || substr(d, 1, 2) || '.' || substr(d, 3, 1) AS code FROM digits)"""


def range_recode_all_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Items per code and label over the whole code space, unmatched codes included."""
    recoded = range_recode(item_codes(spark, sf).select("code"), "code", cause_rules(), "label")
    return recoded.groupBy("code", "label").agg(F.count("*").alias("n"))


def range_recode_all_codes_sql() -> str:
    return f"""WITH {rules_sql()}, {ITEM_CODES}, {labelled_sql('items')}
SELECT code, label, count(*) AS n FROM items JOIN labelled USING (code) GROUP BY ALL"""


def cents_code(cents: str) -> Column:
    """A letter and five digits from an amount in cents."""
    return F.concat(F.chr(F.expr(f"65 + {cents} % 26")), F.lpad(F.expr(f"cast(({cents} div 26) % 100000 as string)"), 5, "0"))


def range_recode_rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """Orders labelled by as many overlapping rules as there are line items; a third of the orders have one code.

    A line item gives the codes from its price up to a span of its quantity to its part; the line number is the block.
    """
    items = table(spark, sf, "lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    rules = items.select(
        F.col("l_linenumber").alias("block"),
        F.col("l_suppkey").cast("int").alias("rule"),
        cents_code("cents").alias("lo"),
        cents_code("(cents + 26 * cast(l_quantity as bigint))").alias("hi"),
        F.when(F.col("l_partkey") % 50 > 0, F.col("l_partkey").cast("string")).alias("label"),
    )
    orders = table(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    coded = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "K50000").when(F.col("o_orderkey") % 100 != 1, cents_code("cents")).alias("code"))
    return range_recode(coded, "code", rules, "label", lambda label: {"short": F.substring(label, 1, 1)})


RANGE_RECODE_RULE_TABLE = """
WITH i AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
rules AS (SELECT l_linenumber AS block, l_suppkey AS rule, chr(CAST(65 + cents % 26 AS INTEGER)) || lpad(CAST((cents // 26) % 100000 AS VARCHAR), 5, '0') AS lo,
  chr(CAST(65 + (cents + 26 * q) % 26 AS INTEGER)) || lpad(CAST(((cents + 26 * q) // 26) % 100000 AS VARCHAR), 5, '0') AS hi,
  CASE WHEN l_partkey % 50 > 0 THEN CAST(l_partkey AS VARCHAR) END AS label FROM i),
o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'K50000' WHEN o_orderkey % 100 <> 1
  THEN chr(CAST(65 + cents % 26 AS INTEGER)) || lpad(CAST((cents // 26) % 100000 AS VARCHAR), 5, '0') END AS code FROM o),
l AS (SELECT code, label FROM (SELECT DISTINCT code FROM c) d JOIN rules ON code BETWEEN lo AND hi
  QUALIFY row_number() OVER (PARTITION BY code ORDER BY block DESC, rule, label NULLS FIRST) = 1)
SELECT o_orderkey, c.code, label, substr(label, 1, 1) AS short FROM c LEFT JOIN l ON l.code = c.code
"""


def two_level_label(spark: SparkSession, sf: str) -> DataFrame:
    def levels(label):
        one, two = level_one(label), level_two(label)
        return {
            "group_1": one,
            "group_2": two,
            "reassigned": specific_reassign(label, two),
            "reassigned_n1": specific_reassign(label, one),
        }

    return range_recode(part_codes(spark, sf), "code", cause_rules(), "label", levels).drop("code")


def two_level_label_sql() -> str:
    return f"""WITH {rules_sql()}, {PART_CODES}, {labelled_sql('part_codes')},
l AS (SELECT p_partkey, label,
  CASE WHEN label LIKE '%GC%' THEN 'GC' WHEN regexp_matches(label, 'Dia|ECV|ERC|Neo|ENT') THEN 'ENT' WHEN regexp_matches(label, 'Hom|Sui|Trá|CE') THEN 'CE' ELSE label END AS group_1,
  CASE WHEN regexp_matches(label, 'GC|CE') THEN regexp_replace(label, '-.*', '') ELSE label END AS group_2
  FROM part_codes JOIN labelled USING (code))
SELECT *, CASE WHEN regexp_matches(label, 'Neum|GC1|GC2') THEN group_2 WHEN regexp_matches(label, 'GC3-|GC4-') THEN regexp_replace(label, '^.*-', '') ELSE label END AS reassigned,
  CASE WHEN regexp_matches(label, 'Neum|GC1|GC2') THEN group_1 WHEN regexp_matches(label, 'GC3-|GC4-') THEN regexp_replace(label, '^.*-', '') ELSE label END AS reassigned_n1 FROM l"""


def regex_recode(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return docs.select(
        "doc_id",
        pattern_recode("source", [("src1", "one"), ("src1?[0-4]$", "low"), ("9", F.col("lang"))], F.col("source")).alias("source_group"),
        pattern_recode("text", [("(?i)license", "license"), ("[0-9]{3}", "numbers"), ("é|ñ|ü", "accents")]).alias("text_group"),
    )


REGEX_RECODE = """
SELECT doc_id, CASE WHEN regexp_matches(source, 'src1') THEN 'one' WHEN regexp_matches(source, 'src1?[0-4]$') THEN 'low'
  WHEN regexp_matches(source, '9') THEN lang ELSE source END AS source_group,
  CASE WHEN regexp_matches(text, 'license', 'i') THEN 'license' WHEN regexp_matches(text, '[0-9]{3}') THEN 'numbers'
  WHEN regexp_matches(text, 'é|ñ|ü') THEN 'accents' END AS text_group FROM documents
"""


def bands(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("size", F.lpad(F.col("p_size").cast("string"), 2, "0"))
    size_bands = [(["01", "02"], ("03", "10"), "small"), (None, ("11", "30"), "middle"), (["50"], None, "top")]
    return p.select(
        "p_partkey",
        band_recode("size", size_bands).alias("band"),
        band_recode("size", size_bands, "rest").alias("band_or_rest"),
        set_recode("p_type", [(("ECONOMY", "SMALL"), "low"), (("PROMO",), "sale")]).alias("kind"),
        two_way(F.nullif("p_size", F.lit(7)) > 25, "big", "little").alias("two_way"),
    )


BANDS = """
SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'middle' WHEN p_size = 50 THEN 'top' END AS band,
  CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'middle' WHEN p_size = 50 THEN 'top' ELSE 'rest' END AS band_or_rest,
  CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'low' WHEN p_type = 'PROMO' THEN 'sale' ELSE p_type END AS kind,
  CASE WHEN p_size = 7 THEN NULL WHEN p_size > 25 THEN 'big' ELSE 'little' END AS two_way FROM part
"""


def level_relabel(spark: SparkSession, sf: str) -> DataFrame:
    labels = ["now", "soon", "normal", "unknown", "later"]
    df = relabel_levels(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", labels)
    return df.withColumn("position", level_order("o_orderpriority", ["unknown", "later", "normal", "soon", "now"]))


LEVEL_RELABEL = """
WITH lv AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) AS k FROM (SELECT DISTINCT o_orderpriority FROM orders)),
r AS (SELECT o_orderkey, (['now', 'soon', 'normal', 'unknown', 'later'])[k] AS o_orderpriority FROM orders JOIN lv ON o_orderpriority = p)
SELECT o_orderkey, o_orderpriority, CAST(list_position(['unknown', 'later', 'normal', 'soon', 'now'], o_orderpriority) AS INTEGER) AS position FROM r
"""

def level_relabel_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer of an order, in sorted order, gets the label of the same place in a table of labels."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.nullif(F.col("o_custkey") % 1000, F.lit(7)).cast("string")).alias("customer"))
    labels = level_table(orders.select(F.reverse("customer").alias("customer")), "customer")
    return relabel_levels(orders, "customer", labels.select("position", F.col("customer").alias("label")))


LEVEL_RELABEL_TABLE = """
WITH o AS (SELECT o_orderkey, 'c' || nullif(o_custkey % 1000, 7) AS c FROM orders),
lv AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT c FROM o WHERE c IS NOT NULL)),
lb AS (SELECT c AS label, row_number() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT reverse(c) AS c FROM o WHERE c IS NOT NULL))
SELECT o_orderkey, label AS customer FROM o LEFT JOIN (lv JOIN lb USING (k)) ON lv.c = o.c
"""

QUERIES = {
    "priority_range_recode": (priority_range_recode, priority_range_recode_sql),
    "range_recode_all_codes": (range_recode_all_codes, range_recode_all_codes_sql),
    "range_recode_rule_table": (range_recode_rule_table, RANGE_RECODE_RULE_TABLE),
    "two_level_label": (two_level_label, two_level_label_sql),
    "regex_recode": (regex_recode, REGEX_RECODE),
    "band_recode": (bands, BANDS),
    "level_relabel": (level_relabel, LEVEL_RELABEL),
    "level_relabel_table": (level_relabel_table, LEVEL_RELABEL_TABLE),
}
