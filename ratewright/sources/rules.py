"""Rule tables for the prioritised range recode.

A rule gives ``label`` to the codes from ``lo`` to ``hi`` (text order, both
ends included). Among the rules that hold a code the highest ``block`` wins,
then the lowest ``rule`` inside it. The table is always a parameter: a CSV or
Parquet table, a list of ``Rule``, or a text outline.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Rule(NamedTuple):
    block: int
    rule: int
    lo: str
    hi: str
    label: str


RULE_SCHEMA = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("rule", T.IntegerType()),
        T.StructField("lo", T.StringType()),
        T.StructField("hi", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)


def read_rules(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Rule table with the columns of ``RULE_SCHEMA``."""
    return spark.read.schema(RULE_SCHEMA).option("header", True).format(fmt).load(path)


def parse_rule_outline(text: str) -> list[Rule]:
    """Rules from an outline of blocks and numbered labels.

    ``**Block 2, name**`` opens a block; ``1. `label` (note): A00.0, B10.0–B12.9``
    gives single codes and inclusive ranges to a label. Later blocks win over
    earlier ones, earlier labels over later ones in a block.
    """
    rules, block = [], 0
    for line in text.splitlines():
        head = re.match(r"\*\*Block (\d+)", line)
        item = re.match(r"(\d+)\. `([^`]+)` \([^)]*\): (.+)$", line)
        if head:
            block = int(head.group(1))
        elif item and block:
            for span in item.group(3).split(","):
                lo, _, hi = span.strip().partition("–")
                rules.append(Rule(block, int(item.group(1)), lo, hi or lo, item.group(2)))
    return rules


def read_rule_outline(spark: SparkSession, path: str) -> list[Rule]:
    """``parse_rule_outline`` of a text file on any file system Spark can read."""
    return parse_rule_outline(spark.read.text(path, wholetext=True).first()[0])


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as a literal table whose size the optimizer knows."""
    columns = list(zip(*rules)) or [[]] * 5
    arrow = pa.table(
        {
            "block": pa.array(columns[0], pa.int32()),
            "rule": pa.array(columns[1], pa.int32()),
            "lo": pa.array(columns[2], pa.string()),
            "hi": pa.array(columns[3], pa.string()),
            "label": pa.array(columns[4], pa.string()),
        }
    )
    return spark.createDataFrame(arrow)
