import bisect
import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalog.tables import cause_rules
from ratewright import fixed_values as fixed
from ratewright.functions.predicates import one_of, unless
from ratewright.operators import intervals, joins, recode
from ratewright.operators.intervals import disjoint_pieces
from ratewright.operators.joins import look_up
from ratewright.operators.ranks import ranked
from ratewright.operators.recode import (
    band_recode,
    level_order,
    moved_levels,
    pattern_recode,
    range_recode,
    relabel_levels,
    resolve,
    two_way,
)
from ratewright.plans.records import level_one, level_two, specific_reassign
from ratewright.sources.rules import Rule, parse_rule_outline, read_rules, rules_frame
from ratewright.sources.tables import written


def cascade(code, rules):
    """The rules one after the other: later blocks override, the first match of a block wins."""
    label = None
    for block in sorted({r.block for r in rules}):
        held = [r for r in rules if r.block == block and r.lo <= code <= r.hi]
        if held:
            label = min(held, key=lambda r: r.rule).label
    return label


def frame(spark, codes):
    return spark.createDataFrame([(c,) for c in codes], "code string")


def labels(df):
    return {r["code"]: r["label"] for r in df.collect()}


def test_outline_has_the_whole_cause_list():
    rules = cause_rules()
    assert len({r.block for r in rules}) == 12
    assert len({r.label for r in rules}) == 35
    assert sum(r.lo != r.hi for r in rules) == 497
    assert sum(r.lo == r.hi for r in rules) == 324


def test_priority_of_overlapping_rules(spark):
    want = {
        "I27.2": "GC2-ECV",
        "J65.0": "ERC",
        "B94.0": "GC1",
        "R58.0": "GC1",
        "X46.3": "GC1",
        "N84.5": "GC3-Otras ENT",
        "G01.1": "GC4-Otras ENT",
        "Y29.1": "GC2-CE",
        "E10.": None,
        "": None,
        None: None,
    }
    assert labels(range_recode(frame(spark, want), "code", cause_rules(), "label")) == want


def test_every_code_as_the_cascade(spark):
    """All well-formed codes and a few malformed ones, against the rules applied one by one."""
    codes = [f"{chr(65 + i // 1000)}{i // 10 % 100:02d}.{i % 10}" for i in range(26_000)]
    odd = ["E10.", "E1", "e10.0", "E10.00", "ZZZ", "X9", "É10.0", "A00", "Y98.05", "I64.0 "]
    got = labels(range_recode(frame(spark, codes + odd), "code", cause_rules(), "label"))
    want = {c: cascade(c, cause_rules()) for c in codes + odd}
    assert got == want
    assert sum(want[c] is None for c in codes) == 4605
    assert sum(len({r.label for r in cause_rules() if r.lo <= c <= r.hi}) > 1 for c in codes) == 69


text = st.text("ABZ019.é", min_size=1, max_size=4)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3), text, text, st.sampled_from("pqr")), max_size=8), st.lists(text, max_size=20))
def test_resolved_pieces_equal_the_cascade(raw, codes):
    # One label per (block, rule), as in a rule table.
    names = {}
    rules = [Rule(b, r, *sorted((lo, hi)), names.setdefault((b, r), label)) for b, r, lo, hi, label in raw]
    pieces = resolve(rules)
    assert all(a[1] <= b[0] for a, b in zip(pieces, pieces[1:]))
    starts = [p[0] for p in pieces]
    for code in codes:
        i = bisect.bisect_right(starts, code) - 1
        got = pieces[i][2] if i >= 0 and code < pieces[i][1] else None
        assert got == cascade(code, rules)


@pytest.mark.parametrize("max_heads", [50_000, 300, 10, 1])
def test_head_length_does_not_change_labels(spark, monkeypatch, max_heads):
    monkeypatch.setattr(recode, "MAX_HEADS", max_heads)
    codes = ["I27.2", "J65.0", "Y05.3", "W99.5", "O99.9", "P01.0", "C07.1", "E10.", "x", "Z9", "V89.95"]
    got = labels(range_recode(frame(spark, codes), "code", cause_rules(), "label"))
    assert got == {c: cascade(c, cause_rules()) for c in codes}


def test_rules_as_data_give_the_same_labels(spark):
    codes = ["I27.2", "J65.0", "X90.1", "Y05.3", "E10.", None]
    derived = lambda label: {"two": level_two(label)}
    small = range_recode(frame(spark, codes), "code", cause_rules(), "label", derived)
    large = range_recode(frame(spark, codes), "code", rules_frame(spark, cause_rules()), "label", derived)
    assert sorted(large.collect(), key=repr) == sorted(small.collect(), key=repr)
    assert large.columns == small.columns


def test_both_paths_give_incomplete_and_equal_rules_the_same_meaning(spark):
    rules = [
        Rule(1, 1, "", "Z", "empty start"),
        Rule(1, 1, None, "Z", "no start"),
        Rule(1, 1, "A", None, "no end"),
        Rule(None, 1, "A", "Z", "no block"),
        Rule(1, None, "A", "Z", "no number"),
        Rule(2, 1, "B10.0", "B19.9", "y"),
        Rule(2, 1, "B10.0", "B19.9", "x"),
        Rule(1, 1, "B00.0", "C99.9", "wide"),
        Rule(3, 1, "B15.0", "B15.9", None),
        Rule(1, 1, "D", "\uffff", "open end"),
    ]
    codes = ["A10.0", "B05.0", "B12.3", "B15.5", "C00.0", "D50.0", "é", "", None]
    want = {"A10.0": None, "B05.0": "wide", "B12.3": "x", "B15.5": None, "C00.0": "wide", "D50.0": "open end", "é": "open end", "": None, None: None}
    assert labels(range_recode(frame(spark, codes), "code", rules, "label")) == want
    assert labels(range_recode(frame(spark, codes), "code", rules_frame(spark, rules), "label")) == want


def test_overlapping_rules_of_any_text_meet_codes_as_the_cascade_does(spark):
    """Random ends over letters of one to four bytes, equal ranges, shared starts and stops; crossed and open rules."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ABé\uffff\U0001f389") for _ in range(rng.randint(1, 5)))
    shared = [word() for _ in range(6)]
    rules = []
    for _ in range(300):
        lo, hi = sorted((rng.choice(shared) if rng.random() < 0.4 else word(), rng.choice(shared) if rng.random() < 0.4 else word()))
        lo, hi = (hi, lo) if rng.random() < 0.1 else (lo, hi)
        rules.append(Rule(rng.randint(1, 4), rng.randint(1, 30), lo, hi, rng.choice(["x", "y", "z", None])))
    codes = {word() for _ in range(400)} | set(shared)
    df = frame(spark, [*codes, *codes, None, ""])
    got = range_recode(df, "code", rules_frame(spark, rules), "label")
    assert got.count() == df.count()
    want = {c: r[0].label if (r := sorted((r for r in rules if r.lo <= c <= r.hi), key=lambda r: (-r.block, r.rule, r.label is not None, r.label or ""))) else None for c in codes}
    assert labels(got) == want | {None: None, "": None}


def test_rules_over_many_blocks_and_covers(spark, monkeypatch):
    """Thousands of ends: parts of blocks, whole blocks under wide rules, ends on the borders of blocks."""
    monkeypatch.setattr(intervals, "TOP", 1)
    rng = random.Random(8)
    number = lambda: f"{rng.randint(0, 99_999):05d}"
    rules = [Rule(rng.randint(1, 9), i, *sorted((number(), number())), f"w{i}") for i in range(40)]
    rules += [Rule(rng.randint(1, 9), 100 + i, f"{i * 30:05d}", f"{i * 30 + rng.randint(0, 60):05d}", rng.choice(["x", "y", None])) for i in range(3000)]
    rules += [Rule(5, 9000 + i, "50000", f"{50_000 + 7 * i:05d}", "same start") for i in range(400)]
    codes = frame(spark, [number() for _ in range(4000)])
    got = range_recode(codes, "code", rules_frame(spark, rules), "label")
    assert labels(got) == labels(range_recode(codes, "code", rules, "label"))
    parts = spark.range(1).select(F.lit(5).cast("long").alias("a"), F.lit(3072).cast("long").alias("b"))
    assert [tuple(r[0]) for r in parts.select(F.explode(intervals.block_parts("a", "b"))).collect()] == [(0, 5, 1024)]
    spread = lambda a, b: [tuple(r[0]) for r in spark.range(1).select(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")).select(F.explode(intervals.block_parts("a", "b"))).collect()]
    assert spread(1024, 2048) == [] and spread(1024, 2047) == [(1, 0, 1023)] and spread(1000, 2049) == [(0, 1000, 1024), (2, 0, 1)]


def test_dyadic_nodes_are_the_run(spark):
    for first, last in [(0, 1), (3, 11), (0, 16), (5, 6), (7, 9), (1, 15)]:
        rows_ = spark.range(1).select(F.lit(first).cast("long").alias("a"), F.lit(last).cast("long").alias("b")).select(F.explode(intervals.dyadic_nodes("a", "b", 4)).alias("n")).collect()
        held = sorted(x for r in rows_ for x in range(r.n.node << r.n.level, (r.n.node + 1) << r.n.level))
        assert held == list(range(first, last)) and len(rows_) <= 8


def test_no_rules_and_no_codes(spark):
    none = rules_frame(spark, [])
    assert labels(range_recode(frame(spark, ["A", None]), "code", none, "label")) == {"A": None, None: None}
    assert range_recode(frame(spark, ["A"]).limit(0), "code", rules_frame(spark, [Rule(1, 1, "A", "B", "x")]), "label").count() == 0
    one = rules_frame(spark, [Rule(1, 1, "A", "A", "x")])
    assert labels(range_recode(frame(spark, ["A", "A0", "B"]), "code", one, "label")) == {"A": "x", "A0": None, "B": None}


def test_a_wide_rule_is_not_spread_over_what_it_holds(spark):
    """A rule over all characters is a few nodes and pieces, not one row per character."""
    rules = [Rule(1, 1, "A", "\uffff", "all")] + [Rule(2, i, f"K{i:03d}", f"K{i:03d}", "one") for i in range(0, 400, 2)]
    pieces = disjoint_pieces(rules_frame(spark, rules))
    assert pieces.count() == 401
    heads = {r["head"]: r["n"] for r in pieces.groupBy("head").agg(F.count("*").alias("n")).collect()}
    assert max(heads.values()) <= 20
    got = labels(range_recode(frame(spark, ["K000", "K001", "K398", "K399", "Z", "é"]), "code", rules_frame(spark, rules), "label"))
    assert got == {"K000": "one", "K001": "all", "K398": "one", "K399": "all", "Z": "all", "é": "all"}


def test_hot_code_and_missing_codes_are_dealt_evenly(spark, plan, monkeypatch):
    """Half of the rows have one code and a quarter none; the others are joined by shuffle, as if their labels were many."""
    monkeypatch.setattr(joins, "HOT_KEYS", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    codes = F.when(F.col("id") % 2 == 0, "K5").when(F.col("id") % 4 == 1, None).otherwise(F.concat(F.lit("K"), F.col("id").cast("string")))
    df = spark.range(0, 40_000, 1, 4).select("id", codes.alias("code"))
    rules = rules_frame(spark, [Rule(1, 1, "K1", "K3", "low"), Rule(1, 2, "K5", "K5", "hot")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = range_recode(df, "code", rules, "label")
        text = plan(got)
        assert {r["label"]: r["n"] for r in got.groupBy("label").agg(F.count("*").alias("n")).collect()} == {
            "hot": 20_000, "low": sum(1 for i in range(3, 40_000, 4) if "1" <= str(i) <= "3"), None: 20_000 - sum(1 for i in range(3, 40_000, 4) if "1" <= str(i) <= "3"),
        }
        sizes = got.repartition(1).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sizes == 40_000
    assert "BroadcastHashJoin" in text and "SortMergeJoin" in text and "_place" in text
    spread = look_up(df.withColumn("k", F.col("code")), "k", written(spark.createDataFrame([("K5", 20_000, "x"), ("K7", 1, "y")], "k string, n long, v string")), "n")
    assert {r["v"]: r["count"] for r in spread.groupBy("v").count().collect()} == {"x": 20_000, "y": 1, None: 19_999}


def test_rules_and_codes_are_computed_once_a_row(spark, plan, monkeypatch):
    """No filter below the first groups of rules and of codes repeats the expressions they come from."""
    asked = []
    keep = lambda df: asked.append(plan(df)) or written(df)
    monkeypatch.setattr(intervals, "written", keep)
    monkeypatch.setattr(recode, "written", keep)
    text = lambda x: F.concat(F.lit("K"), F.lpad(x.cast("string"), 5, "0"))
    ids = spark.range(0, 3000, 1, 2)
    rules = ids.select(F.lit(1).alias("block"), F.col("id").cast("int").alias("rule"), text(F.col("id")).alias("lo"), text(F.col("id") + 2).alias("hi"), F.col("id").cast("string").alias("label"))
    got = range_recode(ids.select(text(F.col("id")).alias("code")), "code", rules, "label")
    codes, spans = (next(p for p in asked if p.count("lpad(") and f"{ends}#" in p.split("lpad(")[0]) for ends in ("code", "stop"))
    assert codes.count("lpad(") == 1 and spans.count("lpad(") == 2
    assert {r["code"]: r["label"] for r in got.collect()} == {f"K{i:05d}": str(max(i - 2, 0)) for i in range(3000)}


def test_shared_prefix_of_short_and_long_texts(spark):
    rng = random.Random(5)
    pairs = [sorted("".join(rng.choice("Aé\U0001f389") for _ in range(rng.randint(0, 4))) for _ in "ab") for _ in range(200)]
    pairs += [(x + a, x + b) for x in ("é" * 11, "é" * 12, "A" * 13, "A\U0001f389" * 20) for a, b in pairs[:40]]
    pairs += [("K12345", "K12345\x00"), ("K1", "K1")]
    got = spark.createDataFrame([tuple(p) for p in pairs], "a string, b string").select("a", "b", intervals.shared_prefix("a", "b").alias("p")).collect()
    assert [r["p"] for r in got] == [os.path.commonprefix([r["a"], r["b"]]) for r in got]


def test_strongest_part_of_a_block_wins(spark):
    rng = random.Random(6)
    rows = []
    for i in range(700):
        first, last = sorted(rng.sample(range(intervals.BLOCK + 1), 2)) if i % 3 else (i, i + 1)
        rows.append((7, first, last, -rng.randint(1, 3), rng.randint(1, 40), rng.choice(["x", "é", "\U0001f389", "\uffff", None])))
    names = ["at", "first", "last", "block", "rule", "label"]
    got = intervals.paint(pa.table({n: list(c) for n, c in zip(names, zip(*rows))})).to_pydict()
    best = {}
    for i in range(intervals.BLOCK):
        held = [(r[3], r[4], r[5] is not None, (r[5] or "").encode()) for r in rows if r[1] <= i < r[2]]
        if held and min(held)[2]:
            best[7 * intervals.BLOCK + i] = min(held)[3].decode()
    assert dict(zip(got["rank"], got["label"])) == best


def test_next_of_many_values(spark):
    values = written(spark.range(0, 4000, 1, 7).select((F.col("id") * 3).alias("x")))
    got = sorted((r["rank"], r["x"], r["y"]) for r in ranked(values, ["x"], following="y").collect())
    assert [g[1] for g in got[1:]] == [g[2] for g in got[:-1]] and got[-1][2] is None and len(got) == 4000


def test_ranks_of_many_values(spark):
    values = written(spark.range(5000).select(F.format_string("%05d", F.pmod(F.col("id") * 7919, F.lit(5000))).alias("x")))
    got = ranked(values, ["x"]).collect()
    assert sorted((r["x"], r["rank"]) for r in got) == [(f"{i:05d}", i) for i in range(5000)]
    assert ranked(values.limit(0), ["x"]).count() == 0


def test_many_overlapping_rules_are_resolved_in_one_sweep():
    rules = [Rule(i % 7, i, f"A{i:05d}", f"A{i + 5000:05d}", str(i % 3)) for i in range(8000)]
    assert recode.resolve(rules)  # the time would grow with rules x cuts


def test_recode_does_not_shuffle_records(spark, sf, plan):
    df = spark.read.parquet(f"{sf}/orders.parquet").withColumn("code", F.concat(F.lit("I27."), F.col("o_orderkey").cast("string")))
    text = plan(range_recode(df, "code", cause_rules(), "label"))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text
    assert text.count("Exchange") == text.count("BroadcastExchange")


def test_rules_from_csv(spark, tmp_path):
    path = str(tmp_path / "rules")
    rules_frame(spark, [Rule(1, 1, "A00.0", "A09.9", "x"), Rule(1, 2, "B00.0", "B00.0", "y")]).write.option(
        "header", True
    ).csv(path)
    got = labels(range_recode(frame(spark, ["A05.5", "B00.0", "C"]), "code", read_rules(spark, path), "label"))
    assert got == {"A05.5": "x", "B00.0": "y", "C": None}


def test_outline_format():
    rules = parse_rule_outline("**Block 2, t**\n\n1. `a` (1/1; note): A00.0–A01.0, B10.0\n2. `b c` (x): C1\n")
    assert rules == [Rule(2, 1, "A00.0", "A01.0", "a"), Rule(2, 1, "B10.0", "B10.0", "a"), Rule(2, 2, "C1", "C1", "b c")]


def test_two_levels_and_reassignment(spark):
    cases = {
        "GC3-ECV": ("GC", "GC3", "ECV"),
        "GC4-Neumonías NE": ("GC", "GC4", "GC4"),
        "GC2-CE": ("GC", "GC2", "GC2"),
        "GC1-ERC": ("GC", "GC1", "GC1"),
        "GC3-Otras ENT": ("GC", "GC3", "Otras ENT"),
        "Otras CE": ("CE", "Otras CE", "Otras CE"),
        "Tránsito": ("CE", "Tránsito", "Tránsito"),
        "Otras ENT": ("ENT", "Otras ENT", "Otras ENT"),
        "CMNN": ("CMNN", "CMNN", "CMNN"),
        None: (None, None, None),
    }
    df = frame(spark, cases).withColumn("n2", level_two(F.col("code")))
    df = df.select("code", level_one(F.col("code")).alias("n1"), "n2", specific_reassign(F.col("code"), F.col("n2")).alias("r"))
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == cases


def test_pattern_and_band_recode(spark):
    df = frame(spark, ["00 a 04", "15 a 19", "75 a 79", "80 y más", None])
    got = df.select("code", band_recode("code", fixed.STANDARD_AGES).alias("b"), band_recode("code", fixed.STANDARD_AGES, "x").alias("d"))
    assert [tuple(r) for r in got.collect()] == [
        ("00 a 04", "<20 años", "<20 años"),
        ("15 a 19", "<20 años", "<20 años"),
        ("75 a 79", "70-79 años", "70-79 años"),
        ("80 y más", "≥80 años", "≥80 años"),
        (None, None, "x"),
    ]
    regions = frame(spark, ["06-Buenos Aires", "26-Chubut", "62-RN", "46-LR", "99"])
    got = regions.select(pattern_recode("code", fixed.PROVINCE_REGIONS).alias("r"))
    assert [r[0] for r in got.collect()] == ["Centro", "Patagonia Sur", "Patagonia Norte", "Cuyo", None]


def test_relabel_levels(spark):
    df = frame(spark, ["02.b", "01.a", "02.b", None])
    assert sorted(map(str, [r[0] for r in relabel_levels(df, "code", ["first", "second"]).collect()])) == ["None", "first", "second", "second"]
    assert [r[0] for r in relabel_levels(df, "code", ["first", "second"], ["01.a", "02.b"]).collect()] == ["second", "first", "second", None]
    with pytest.raises(ValueError, match="2 levels for 3 labels"):
        relabel_levels(df, "code", ["a", "b", "c"])
    with pytest.raises(ValueError, match="2 levels for 1 labels"):
        relabel_levels(df, "code", ["a"], ["01.a", "02.b"])


def test_relabel_more_levels_than_a_driver_should_hold(spark):
    """Levels and labels are tables; numbers keep their own order."""
    df = spark.range(0, 30_000).select((F.col("id") % 12_000).alias("x"))
    labels_ = spark.range(1, 12_001).select(F.col("id").alias("position"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("label"))
    got = relabel_levels(df.withColumn("y", F.col("x")), "x", labels_)
    assert got.filter(F.col("x") != F.concat(F.lit("l"), (F.col("y") + 1).cast("string"))).count() == 0
    assert got.count() == 30_000


def test_level_order(spark):
    order = moved_levels(["a", "b", "c"], ["c"])
    assert order == ["c", "a", "b"]
    assert moved_levels(["a", "b", "c"], ["a"], to_end=True) == ["b", "c", "a"]
    got = frame(spark, ["a", "c", "z", None]).select(level_order("code", order).alias("k")).collect()
    assert [r[0] for r in got] == [2, 1, None, None]


def test_null_aware_predicates(spark):
    df = frame(spark, ["Total", None, "0-4"])
    kept = lambda c: [r[0] for r in df.filter(c).collect()]
    assert kept(unless(one_of("code", ["Total", None]))) == ["0-4"]
    assert kept(unless(F.col("code") == "Total")) == [None, "0-4"]
    assert kept(F.col("code") != "Total") == ["0-4"]
    assert kept(one_of("code", [None])) == [None]
    assert [r[0] for r in df.select(two_way(F.col("code") == "Total", "y", "n")).collect()] == ["y", None, "n"]
