"""Interval join of codes with overlapping, prioritised ranges given as data; any number of rules, any length of code.

1. The ends of the rules cut the order of all texts into elementary intervals, numbered by rank, a thousand to a block.
2. A rule holds a run of intervals: part of a block at either end, and whole blocks between. The whole blocks are cut into dyadic nodes (at
   most two of each size), and each node keeps its strongest rule; the strongest of the nodes above a block covers it. In a block the
   strongest of the parts and the cover wins each interval. No rule is spread over the intervals it holds.
3. Texts between two ends begin with the prefix both ends share, so an interval is kept under that prefix, its head. Neighbouring
   intervals that share a head differ in the next character, so a head has no more intervals than there are characters.
4. A code meets the heads among its own prefixes, and of the intervals there the one that holds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.operators.joins import look_up
from ratewright.operators.ranks import ranked
from ratewright.sources.tables import written

BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS
#: Nodes above 2^TOP of their size are few and broadcast; the others hold few blocks each.
TOP = 10
#: Heads of more than this share of all probes are fewer than as many, so their intervals are broadcast.
HOT_HEADS = 2_000
#: So many characters of two texts are compared in compiled code, those after them one by one.
SHORT = 12


def usable(block: Column, rule: Column, lo: Column, hi: Column) -> Column:
    """A rule without block, number or one of its ends holds nothing, nor does one whose ends are empty or crossed."""
    return block.isNotNull() & rule.isNotNull() & (lo != "") & (lo <= hi)


def dyadic_nodes(first: str, stop: str, levels: int) -> Column:
    """The run [first, stop) of integers as dyadic nodes: an array of (level, node), node n of level k being [n 2^k, (n + 1) 2^k)."""
    lo, hi = f"shiftright({first} + shiftleft(1L, k) - 1, k)", f"shiftright({stop}, k)"
    left = f"if({lo} < {hi} and {lo} % 2 = 1, named_struct('level', k, 'node', {lo}), null)"
    right = f"if({lo} + {lo} % 2 < {hi} and {hi} % 2 = 1, named_struct('level', k, 'node', {hi} - 1), null)"
    both = f"transform(sequence(0, {levels}), k -> filter(array({left}, {right}), x -> x is not null))"
    return F.expr(f"flatten({both})")


def shared_prefix(a: str, b: str) -> Column:
    """What two texts begin with alike."""
    parts = [f"when not startswith({b}, substring({a}, 1, {k + 1})) then substring({a}, 1, {k})" for k in range(SHORT)]
    shorter = f"least(length({a}), length({b}))"
    differs = f"filter(sequence(1, {shorter}), i -> substring({a}, i, 1) <> substring({b}, i, 1))"
    long = f"substring({a}, 1, coalesce(get({differs}, 0) - 1, {shorter}))"
    return F.expr(f"case when startswith({b}, {a}) then {a} {' '.join(parts)} else {long} end")


def block_parts(first: str, last: str) -> Column:
    """The parts of blocks that a run [first, last) of ranks holds at its ends, as (block, first, last) inside the block."""
    here, there, within = f"shiftright({first}, {BLOCK_BITS})", f"shiftright({last} - 1, {BLOCK_BITS})", BLOCK - 1
    begin, end = f"cast({first} & {within} as int)", f"cast((({last} - 1) & {within}) + 1 as int)"
    struct = "named_struct('block', {}, 'first', {}, 'last', {})"
    one = struct.format(here, begin, end)
    left = f"if({begin} > 0, {struct.format(here, begin, BLOCK)}, null)"
    right = f"if({end} < {BLOCK}, {struct.format(there, 0, end)}, null)"
    inside = f"if({begin} = 0 and {end} = {BLOCK}, null, {one})"
    return F.expr(f"filter(if({here} = {there}, array({inside}), array({left}, {right})), x -> x is not null)")


def _covers(placed: DataFrame, blocks: int) -> DataFrame:
    """block, first, last, best: the strongest of the rules that hold a whole block."""
    levels = max(blocks - 1, 0).bit_length()
    whole = placed.select(
        F.shiftright(F.col("first") + (BLOCK - 1), BLOCK_BITS).alias("_from"), F.shiftright("last", BLOCK_BITS).alias("_to"), "best"
    ).filter("_from < _to")
    nodes = whole.withColumn("at", F.explode(dyadic_nodes("_from", "_to", levels))).groupBy("at.level", "at.node")
    nodes = written(nodes.agg(F.min("best").alias("best")))
    above = F.expr(f"transform(sequence(0, {levels}), k -> named_struct('level', k, 'node', shiftright(block, k)))")
    asked = placed.sparkSession.range(blocks).select(F.col("id").alias("block")).withColumn("at", F.explode(above))
    asked = asked.select("block", "at.level", "at.node")
    high = levels - TOP
    found = asked.filter(F.col("level") > high).join(F.broadcast(nodes.filter(F.col("level") > high)), ["level", "node"])
    low = asked.filter(F.col("level") <= high).join(nodes.filter(F.col("level") <= high), ["level", "node"])
    best = found.unionByName(low).groupBy("block").agg(F.min("best").alias("best"))
    return best.select("block", F.lit(0).alias("first"), F.lit(BLOCK).alias("last"), "best")


def paint(parts: pa.Table) -> pa.Table:
    """rank, label of the intervals of one block, from the parts rules hold of it; intervals of a missing label are left out."""
    # Texts in the order of their UTF-8 bytes, a missing one before all; the strongest comes first.
    keys = [(name, "ascending") for name in ("block", "rule", "label")]
    order = pc.sort_indices(parts, sort_keys=keys, null_placement="at_start").to_numpy()
    first, last = (parts[name].to_numpy()[order] for name in ("first", "last"))
    # A run is two runs of a power of two, which may overlap; best[k, i] is the place of the strongest part that holds [i, i + 2^k).
    power = np.frexp(last - first)[1] - 1
    place, best = np.arange(len(order)), np.full((BLOCK_BITS + 1, BLOCK), len(order))
    np.minimum.at(best, (power, first), place)
    np.minimum.at(best, (power, last - (1 << power)), place)
    for k in range(BLOCK_BITS, 0, -1):
        half = 1 << (k - 1)
        best[k - 1] = np.minimum(best[k - 1], best[k])
        best[k - 1, half:] = np.minimum(best[k - 1, half:], best[k, :-half])
    held = np.flatnonzero(best[0] < len(order))
    rank = pa.array(held + parts["at"][0].as_py() * BLOCK, pa.int64())
    found = pa.table({"rank": rank, "label": parts["label"].take(order[best[0, held]])})
    return found.filter(pc.is_valid(found["label"]))


def _spans(rules: DataFrame) -> DataFrame:
    """lo, stop, best: the strongest of the usable rules of each range; stop exclusive."""
    best = F.struct((-F.col("block")).alias("block"), F.col("rule").alias("rule"), F.col("label").alias("label"))
    # The next text in binary order turns an inclusive end into an exclusive one.
    span = F.struct("block", "rule", "lo", "hi", F.concat("hi", F.lit("\x00")).alias("stop"), best.alias("best"))
    # A filter on the columns of the rules would move below the expressions they come from and compute them again, twice
    # the time over a large table; it stays above a generator, so each is computed once a row.
    made = rules.select(F.explode(F.array(span)).alias("span")).select("span.*")
    whole = made.filter(usable(F.col("block"), F.col("rule"), F.col("lo"), F.col("hi")))
    return whole.groupBy("lo", "stop").agg(F.min("best").alias("best"))


def _parts(placed: DataFrame) -> DataFrame:
    """block, first, last, best: the parts of blocks held by placed ranges. Ranges differ, so only parts cut at the border of a block may be alike."""
    block, within = F.shiftright("first", BLOCK_BITS), F.lit(BLOCK - 1)
    here = block == F.shiftright(F.col("last") - 1, BLOCK_BITS)
    first, last = F.col("first").bitwiseAND(within), (F.col("last") - 1).bitwiseAND(within) + 1
    inside = placed.filter(here & (F.col("last") - F.col("first") < BLOCK))
    inside = inside.select(block.alias("block"), first.cast("int").alias("first"), last.cast("int").alias("last"), "best")
    cut = placed.filter(~here).select(F.explode(block_parts("first", "last")).alias("part"), "best").groupBy("part.block", "part.first", "part.last")
    return inside.unionByName(cut.agg(F.min("best").alias("best")))


def disjoint_pieces(rules: DataFrame) -> DataFrame:
    """head, start, stop, label: what overlapping rules (block, rule, lo, hi, label) give to each interval; stop exclusive.

    The highest block wins, then the lowest rule, then the first label in text order, a missing one before all; where that is missing
    the interval has no piece. Equal ranges are reduced to their strongest rule before anything is joined.
    """
    spans = written(_spans(rules))
    # Each end once, with the number of ranges that have it: an end that most ranges share is no hot spot of the look-ups.
    starts = spans.select(F.col("lo").alias("cut"), F.lit(1).alias("starts"), F.lit(0).alias("stops"))
    stops = spans.select(F.col("stop").alias("cut"), F.lit(0).alias("starts"), F.lit(1).alias("stops"))
    ends = written(starts.unionByName(stops).groupBy("cut").agg(F.sum("starts").alias("starts"), F.sum("stops").alias("stops")))
    cuts = written(ranked(ends, ["cut"], following="next"))
    blocks = -(-max(cuts.count() - 1, 0) // BLOCK)
    firsts = cuts.filter("starts > 0").select(F.col("cut").alias("lo"), F.col("rank").alias("first"), "starts")
    lasts = cuts.filter("stops > 0").select(F.col("cut").alias("stop"), F.col("rank").alias("last"), "stops")
    placed = look_up(look_up(spans, "lo", firsts, "starts"), "stop", lasts, "stops")
    placed = written(placed.select("first", "last", "best"))
    painted = _parts(placed).unionByName(_covers(placed, blocks)).select("block", "first", "last", "best.block", "best.rule", "best.label")
    painted = painted.toDF("at", "first", "last", "block", "rule", "label")
    winners = painted.groupBy("at").applyInArrow(paint, "rank long, label string")
    pieces = cuts.select(F.col("cut").alias("start"), F.col("next").alias("stop"), "rank").join(winners, "rank")
    return written(pieces.select(shared_prefix("start", "stop").alias("head"), "start", "stop", "label"))


def labelled_codes(codes: DataFrame, pieces: DataFrame) -> DataFrame:
    """``codes`` (distinct, column ``code``) that lie in a piece, with its label.

    Only prefixes as long as some head are tried. A short head is a prefix of very many codes; such heads are found by counting, and
    their pieces are broadcast.
    """
    lengths = pieces.agg(F.collect_set(F.length("head"))).scalar()  # no more than the longest end has characters
    tried = codes.withColumn("_length", F.explode(lengths)).filter(F.col("_length") <= F.length("code"))
    probes = tried.withColumn("head", F.substring("code", F.lit(1), F.col("_length")))
    heads = probes.groupBy("head").agg(F.count("*").alias("n"))
    hot = written(heads.filter(F.col("n") * HOT_HEADS > heads.agg(F.sum("n")).scalar()).select("head"))
    inside = (F.col("code") >= F.col("start")) & (F.col("code") < F.col("stop"))
    few = F.broadcast(pieces.join(hot, "head", "left_semi"))
    common = probes.join(few, "head").filter(inside)
    rare = probes.join(F.broadcast(hot), "head", "left_anti").join(pieces, "head").filter(inside)
    return common.unionByName(rare).select(*codes.columns, "label")
