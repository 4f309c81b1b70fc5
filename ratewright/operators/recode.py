"""Recodes: prioritised code ranges, ordered patterns, bands, level labels."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.functions.predicates import in_band
from ratewright.operators.intervals import disjoint_pieces, labelled_codes
from ratewright.operators.joins import look_up
from ratewright.operators.ranks import level_table
from ratewright.sources.rules import Rule
from ratewright.sources.tables import written

MAX_HEADS = 50_000


def range_recode(
    df: DataFrame,
    code: str,
    rules: Sequence[Rule] | DataFrame,
    out: str,
    derived: Callable[[Column], dict[str, Column]] | None = None,
) -> DataFrame:
    """Label every row by the winning rule for its code; NULL where no rule holds it.

    The highest block wins, then the lowest rule, then the first label in text
    order (a missing one before all); rules that are not ``usable`` and empty
    codes match nothing. Overlapping rules are first resolved into disjoint
    half-open pieces, so a code lies in at most one and the row count stays.
    ``derived`` maps the label to more columns; they are computed on the pieces
    or the distinct codes, not per record.

    Rules in hand (a list) become a literal table: one hash join on the head of
    the code with the range as residual, no grouping, and no shuffle of the
    records while the table is small enough to be broadcast. Rules as data (a DataFrame of any size)
    never pass the driver: they are resolved in Spark, meet the distinct codes
    in an interval join, and the labels are looked up by code.
    """
    if isinstance(rules, DataFrame):
        return _recode_by_data(df, code, rules, out, derived)
    rules = [r for r in rules if usable(r)]
    heads = code_heads(rules)
    pieces = _labelled(_pieces_frame(df, resolve(rules), heads), out, derived)
    # Empty text matches no piece. Without the NULL the optimizer has no reason to test the
    # expression behind the code for NULL once more when a later filter drops unlabelled rows.
    text = F.coalesce(code, F.lit(""))
    hit = (_head_of(text, heads) == F.col("_head")) & (text >= F.col("_start")) & (text < F.col("_stop"))
    return df.join(pieces, hit, "left").drop("_head", "_start", "_stop")


def _labelled(table: DataFrame, out: str, derived: Callable[[Column], dict[str, Column]] | None) -> DataFrame:
    table = table.withColumnRenamed("_label", out)
    return table.withColumns(derived(F.col(out))) if derived else table


def usable(rule: Rule) -> bool:
    """A rule without block, number or one of its ends holds nothing, nor does one whose ends are empty or crossed."""
    return None not in (rule.block, rule.rule, rule.lo, rule.hi) and "" != rule.lo <= rule.hi


def after(text: str) -> str:
    """The next text in binary order, which turns an inclusive end into an exclusive one."""
    return text + "\x00"


def resolve(rules: Iterable[Rule]) -> list[tuple[str, str, str]]:
    """Disjoint (start, stop, label) pieces, stop exclusive, of overlapping rules."""
    rules = sorted((r for r in rules if usable(r)), key=lambda r: r.lo)
    cuts = sorted({r.lo for r in rules} | {after(r.hi) for r in rules})
    # Sweep over the cuts: the open rules wait in a heap, strongest first, and leave it when they have ended.
    waiting: list[tuple[int, int, bool, str, str]] = []
    opened = 0
    pieces: list[tuple[str, str, str]] = []
    for start, stop in zip(cuts, cuts[1:]):
        while opened < len(rules) and rules[opened].lo <= start:
            r = rules[opened]
            heapq.heappush(waiting, (-r.block, r.rule, r.label is not None, r.label or "", after(r.hi)))
            opened += 1
        while waiting and waiting[0][4] <= start:
            heapq.heappop(waiting)
        if not waiting or not waiting[0][2]:
            continue
        label = waiting[0][3]
        if pieces and pieces[-1][1] == start and pieces[-1][2] == label:
            start = pieces.pop()[0]
        pieces.append((start, stop, label))
    return pieces


def code_heads(rules: Sequence[Rule]) -> list[list[str]]:
    """Characters the rule ends use at the first places of a code, for heads of that many places.

    Three places if that gives at most ``MAX_HEADS`` heads, else fewer.
    """
    places: list[list[str]] = []
    heads = 1
    for i in range(3):
        chars = sorted({end[i] for r in rules for end in (r.lo, r.hi) if len(end) > i})
        heads *= len(chars)
        if not chars or heads > MAX_HEADS:
            break
        places.append(chars)
    return places


def _head_of(text: Column, heads: list[list[str]]) -> Column:
    """Join key: the long head of a well-formed code, the first character of any other."""
    first = F.substring(text, 1, 1)
    if not heads:
        return first
    pattern = "^" + "".join(_char_class(chars) for chars in heads)
    return F.when(text.rlike(pattern), F.substring(text, 1, len(heads))).otherwise(first)


def _char_class(chars: list[str]) -> str:
    """Regex class of sorted characters, runs written as ranges."""
    runs: list[list[int]] = []
    for point in map(ord, chars):
        if runs and runs[-1][1] == point - 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def _pieces_frame(df: DataFrame, pieces: list[tuple[str, str, str]], heads: list[list[str]]) -> DataFrame:
    """Pieces under every head they reach into, as a literal table."""
    rows = {
        (chr(first), start, stop, label)
        for start, stop, label in pieces
        for first in range(ord(start[0]), ord(stop[0]) + 1)
        if not 0xD800 <= first < 0xE000  # surrogates are no characters
    }
    starts = [p[0] for p in pieces]
    for chars in product(*heads) if heads else ():
        head = "".join(chars)
        beyond = head[:-1] + chr(0xE000 if head[-1] == "\ud7ff" else min(ord(head[-1]) + 1, 0x10FFFF))
        i = max(bisect_right(starts, head) - 1, 0)
        while i < len(pieces) and pieces[i][0] < beyond:
            if pieces[i][1] > head:
                rows.add((head, *pieces[i]))
            i += 1
    names = ("_head", "_start", "_stop", "_label")
    cols = list(zip(*sorted(rows))) or [[]] * 4
    return df.sparkSession.createDataFrame(pa.table({n: pa.array(c, pa.string()) for n, c in zip(names, cols)}))


def _recode_by_data(
    df: DataFrame, code: str, rules: DataFrame, out: str, derived: Callable[[Column], dict[str, Column]] | None
) -> DataFrame:
    """Rules as data: resolved and matched to the distinct codes in Spark, then looked up by code, hot codes included."""
    # Empty codes are left out of the written groups: a filter before would compute the code of every row again.
    codes = written(df.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("_rows"))).filter("code != ''")
    found = labelled_codes(codes, disjoint_pieces(rules)).withColumnRenamed("label", "_label")
    labels = written(_labelled(found, out, derived).withColumnRenamed("code", "_code"))
    marked = look_up(df.withColumn("_code", F.col(code)), "_code", labels, "_rows")
    return marked.drop("_code")


def pattern_recode(
    text: Column | str, cases: Iterable[tuple[str, str | Column]], default: Column | str | None = None
) -> Column:
    """Value of the first pattern found in a text; ``default`` when none is."""
    text = F.col(text) if isinstance(text, str) else text
    branch = F
    for pattern, value in cases:
        branch = branch.when(text.rlike(pattern), value if isinstance(value, Column) else F.lit(value))
    if default is None:
        return branch
    return branch.otherwise(default if isinstance(default, Column) else F.lit(default))


def band_recode(
    text: Column | str,
    bands: Iterable[tuple[Sequence[str] | None, tuple[str, str] | None, str]],
    default: str | None = None,
) -> Column:
    """Band label of a text given (members, inclusive range, label) in order.

    Without ``default`` an unlisted label stays NULL and can be counted, where a
    catch-all would hide a total row or a typing error.
    """
    branch = F
    for members, span, label in bands:
        branch = branch.when(in_band(text, members, span), F.lit(label))
    return branch if default is None else branch.otherwise(F.lit(default))


def set_recode(
    text: Column | str, groups: Iterable[tuple[Sequence[str], str]], default: Column | None = None
) -> Column:
    """Label of the first set that holds the value; the value itself by default."""
    text = F.col(text) if isinstance(text, str) else text
    branch = F
    for members, label in groups:
        branch = branch.when(text.isin(list(members)), F.lit(label))
    return branch.otherwise(text if default is None else default)


def two_way(condition: Column, yes: str, no: str) -> Column:
    """Two labels from a predicate; NULL stays NULL."""
    return F.when(condition, F.lit(yes)).when(~condition, F.lit(no))


def relabel_levels(
    df: DataFrame, col: str, labels: Sequence[str] | DataFrame, levels: Sequence[str] | None = None
) -> DataFrame:
    """Give the k-th sorted level the k-th label; NULL stays NULL.

    The number of levels must equal the number of labels. ``labels`` is a list,
    or a table (position from 1, label). With known ``levels`` the labels are
    one expression. Without, the levels are found, sorted and numbered in Spark
    and the labels looked up, however many there are; none passes the driver.
    """
    if levels is not None:
        levels = sorted(v for v in levels if v is not None)
        if len(levels) != len(labels):
            raise ValueError(f"{col} has {len(levels)} levels for {len(labels)} labels")
        return df.withColumn(col, set_recode(col, [((lv,), lb) for lv, lb in zip(levels, labels)], F.lit(None)))
    if not isinstance(labels, DataFrame):
        labels = df.sparkSession.createDataFrame(list(enumerate(labels, 1)), "position long, label string")
    labels = labels.select(F.col("position").alias("_position"), F.col("label").alias("_label"), F.lit(1).alias("_listed"))
    named = written(level_table(df, col).join(labels, F.col("position") == F.col("_position"), "full"))
    counted = named.agg(F.count("position").alias("levels"), F.count("_listed").alias("labels")).first()
    if counted["levels"] != counted["labels"]:
        raise ValueError(f"{col} has {counted['levels']} levels for {counted['labels']} labels")
    named = named.drop("position", "_position", "_listed")
    named = named.withColumnsRenamed({col: "_level", "rows": "_rows"})
    marked = look_up(df.withColumn("_level", F.col(col)), "_level", named, "_rows")
    return marked.withColumn(col, F.col("_label")).drop("_level", "_label")


def level_order(col: Column | str, levels: Sequence[str], offset: int = 1) -> Column:
    """Position of a value in an explicit level order (NULL when unlisted)."""
    col = F.col(col) if isinstance(col, str) else col
    found = F.array_position(F.array(*[F.lit(v) for v in levels]), col)
    return F.nullif(found, F.lit(0)).cast("int") + F.lit(offset - 1)


def moved_levels(observed: Sequence[str], moved: Sequence[str], to_end: bool = False) -> list[str]:
    """Level order with some levels moved to the front or the end."""
    rest = [v for v in observed if v not in moved]
    front = [v for v in moved if v in observed]
    return rest + front if to_end else front + rest
