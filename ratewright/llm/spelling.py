"""Spelling variants by finite-state composition.

Two words are near if one edit (a code point inserted, deleted or replaced) separates them. The pairs are the language of a composed
machine: the vocabulary's minimised acceptor, a transducer that makes exactly one edit, and the acceptor again. Its runs are enumerated
partition by partition of its initial states.

A partition belongs to a length and a range of edit places ``[lo, hi)``. Both words of a pair share what precedes ``lo`` and what follows
``hi``, so the partition's part of the acceptor holds only words with this head and this tail, and the edit happens inside the range. At
first the range is one half of a word or the other; a partition with too many words is cut at the middle of its range, until at last
its words differ in one place and are few. A pair has one edit place (the last one, where several insertions give the same word), so it
is found exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewright.sources.tables import union_by_name, written

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
DAMAGED_SHARE = 31
LONGEST_RANGE = 64
PARTITION_WORDS = 5_000
MOST_LARGE = 50_000


# acceptor and composition, in tasks


def minimised(words: list[str]) -> tuple[list[dict[str, int]], list[bool], int]:
    """The minimal acceptor of sorted distinct words: transitions and finality by state, and the initial state.

    States are merged from the end as words are added in order: once a word leaves a branch, nothing more is added to it, and its states
    are replaced by equal ones that exist already.
    """
    register: dict[tuple, int] = {}
    transitions: list[dict[str, int]] = []
    final: list[bool] = []
    path: list[tuple[dict[str, int], str]] = []  # open states from the initial one: transitions so far, symbol that leads on
    ends = [False]  # finality of the open states, one more than path
    last_transitions: dict[str, int] = {}
    before = ""

    def settled(moves: dict[str, int], end: bool) -> int:
        key = (end, *moves.items())
        state = register.get(key)
        if state is None:
            state = register[key] = len(transitions)
            transitions.append(moves)
            final.append(end)
        return state

    def close(depth: int) -> None:
        nonlocal last_transitions
        while len(path) > depth:
            state = settled(last_transitions, ends.pop())
            last_transitions, symbol = path.pop()
            last_transitions[symbol] = state

    for word in words:
        shared = 0
        while shared < len(before) and shared < len(word) and before[shared] == word[shared]:
            shared += 1
        close(shared)
        for symbol in word[shared:]:
            path.append((last_transitions, symbol))
            last_transitions = {}
            ends.append(False)
        ends[-1] = True
        before = word
    close(0)
    return transitions, final, settled(last_transitions, ends.pop())


def one_edit_pairs(words: list[str], length: int, places: int) -> list[tuple[str, str]]:
    """Pairs (u, v), one edit apart at a place before ``places``: u of ``length``, v as long and later in order, or one longer.

    Runs of the composed machine: before the edit both acceptors are in one state, after it they go on in step.
    """
    transitions, final, initial = minimised(words)
    common: dict[tuple[int, int, str], list[str]] = {}

    def endings(p: int, q: int, barred: str = "") -> list[str]:
        """What both states accept, not beginning with ``barred``."""
        key = (p, q, barred)
        if key not in common:
            here, there = transitions[p], transitions[q]
            out = [""] if final[p] and final[q] else []
            for symbol, after in here.items():
                if symbol in there and symbol != barred:
                    out += [symbol + rest for rest in endings(after, there[symbol])]
            common[key] = out
        return common[key]

    out = []
    waiting = [(initial, "")]
    while waiting:
        state, head = waiting.pop()
        moves = list(transitions[state].items())
        for i, (a, one) in enumerate(moves):  # a replaced by a later symbol
            for b, other in moves[i + 1 :]:
                out += [(head + a + rest, head + b + rest) for rest in endings(one, other) if len(head) + 1 + len(rest) == length]
        for b, after in moves:  # b inserted; the next symbol differs from it, so no later place gives the same word
            out += [(head + rest, head + b + rest) for rest in endings(state, after, b) if len(head) + len(rest) == length]
        if len(head) + 1 < places:
            waiting += [(after, head + symbol) for symbol, after in moves]
    return out


def pairs_within(words: list[str], length: int, lo: int, hi: int) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart at a place in [lo, hi) among words of ``length`` or one more, from what lies between shared heads and tails.

    Very long words share long heads and tails, so their range is narrowed before an acceptor is built.
    """
    tail = max(length - hi, 0)
    sharing: dict[tuple[str, str], list[str]] = {}
    for word in words:
        sharing.setdefault((word[:lo], word[len(word) - tail :]), []).append(word)
    for (head, end), held in sharing.items():
        if len(held) < 2:
            continue
        if hi - lo > LONGEST_RANGE:
            middle = (lo + hi) // 2
            yield from pairs_within(held, length, lo, middle)
            yield from pairs_within(held, length, middle, hi)
        else:
            middles = sorted(word[lo : len(word) - tail] for word in held)
            for u, v in one_edit_pairs(middles, length - lo - tail, hi - lo):
                yield head + u + end, head + v + end


def near_words(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """word, n_near, best_n, best: each word's near words of one partition, counted, and the best of them."""
    out: dict[str, list] = {}

    def note(word: str, near: str, n: int) -> None:
        found = out.get(word)
        if found is None:
            out[word] = [1, n, near]
        else:
            found[0] += 1
            if (-n, near) < (-found[1], found[2]):
                found[1], found[2] = n, near

    def table() -> pd.DataFrame:
        return pd.DataFrame([(w, *f) for w, f in out.items()], columns=["word", "n_near", "best_n", "best"])

    def finish(name: tuple, held: dict[str, int]) -> None:
        if len(held) > 1:
            for u, v in pairs_within(list(held), *name[1:]):
                note(u, v, held[v])
                note(v, u, held[u])

    name, held = None, {}
    for batch in groups:
        for *now, word, n in zip(batch["key"], batch["length"], batch["lo"], batch["hi"], batch["word"], batch["n"]):
            if now != name:
                finish(name, held)
                name, held = now, {}
            held[word] = n
        if len(out) > 20_000:
            yield table()
            out.clear()
    finish(name, held)
    yield table()


# in Spark


def words_of(documents: DataFrame, id_col: str, text_col: str, least: int = LEAST_LENGTH, damaged: int = DAMAGED_SHARE) -> DataFrame:
    """word, n: how often each word of at least ``least`` code points occurs in all texts.

    Words are maximal runs of letters, A-Z lower-cased. Where ``damaged`` divides the crc32 h of ``<doc_id>:<run>``, the run loses the code
    point at h modulo its length (0: no run does).
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0)))
    runs = documents.select(documents[id_col].cast("string").alias("doc_id"), run.alias("run"))
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    word = F.col("run")
    if damaged:
        h = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        rest = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(h % damaged == 0, rest).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def partition_key(word: Column, length: Column, lo: Column, hi: Column) -> Column:
    """Hash of what the words of a partition share; equal hashes of different partitions only put them together."""
    tail = F.greatest(length - hi, F.lit(0))
    end = F.when(tail > 0, F.substring(word, F.length(word) - tail + 1, tail)).otherwise(F.lit(""))
    return F.xxhash64(length, lo, hi, F.substring(word, F.lit(1), lo), end)


def in_ranges(rows: DataFrame, ranges: Column) -> DataFrame:
    """Rows once per range of edit places, with the key of its partition."""
    spread = rows.withColumn("range", F.explode(ranges)).select("word", "n", "length", F.col("range.lo").alias("lo"), F.col("range.hi").alias("hi"))
    return spread.withColumn("key", partition_key(F.col("word"), F.col("length"), F.col("lo"), F.col("hi")))


def halves(lo: Column, hi: Column) -> Column:
    middle = F.floor((lo + hi) / 2).cast("int")
    first, second = F.struct(lo.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.alias("hi"))
    return F.array(first, second)


def partitions(vocabulary: DataFrame, most: int = PARTITION_WORDS) -> DataFrame:
    """key, length, lo, hi, word, n: the words of every partition with two words or more.

    A word is in the partitions of its own length and, as the longer one of a pair, in those of the length before. Partitions beyond
    ``most`` words, or a 50,000th of all rows if that is more, are cut until none is left or a range is one place; their keys are fewer
    than 50,000 whatever the size of the vocabulary, so they are broadcast.
    """
    size = F.length("word")
    lengths = F.explode(F.array(size, size - 1))
    rows = vocabulary.withColumn("length", lengths)
    rows = written(in_ranges(rows, halves(F.lit(0), F.col("length") + 1)))
    most = max(most, rows.count() // MOST_LARGE)
    done = []
    while True:
        counts = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most))
        large = F.broadcast(counts.select("key"))
        wide = F.col("hi") - F.col("lo") > 1
        cut = rows.where(wide).join(large, "key", "left_semi")
        if counts.isEmpty() or cut.isEmpty():
            return union_by_name([*done, rows])
        narrow = rows.where(~wide).join(large, "key", "left_semi")
        done.append(rows.join(large, "key", "left_anti").unionByName(narrow))
        rows = written(in_ranges(cut.select("word", "n", "length", "lo", "hi"), halves(F.col("lo"), F.col("hi"))))


def variants(
    documents: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    damaged: int = DAMAGED_SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """word, n, n_near, form, form_n, root: every word of at least ``least_length`` code points that occurs ``least_count`` times or more.

    Near words differ by exactly one inserted, deleted or replaced code point. ``form`` is the commonest near word (ties: the first in
    code-point order) if it is ``ratio`` times as common as the word, else NULL; ``root`` is reached by following forms to the last. NULL
    and empty texts have no words; repeated rows and ids count each time; an id that is NULL is empty in the hash that damages words. An
    empty table gives an empty result. Other columns are ignored.
    """
    counted = words_of(documents, id_col, text_col, least_length, damaged)
    vocabulary = written(counted.where(F.col("n") >= least_count))
    spark = documents.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lined_up = partitions(vocabulary).select("key", "length", "lo", "hi", "word", "n").repartition(tasks, "key")
    lined_up = lined_up.sortWithinPartitions("key", "length", "lo", "hi")
    found = lined_up.mapInPandas(near_words, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("near"))
    near = near.select("word", "n_near", F.col("near.best").alias("best"), (-F.col("near.less")).alias("best_n"))
    common = F.col("best_n") >= ratio * F.col("n")
    known = written(
        vocabulary.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common, F.col("best")).alias("form"),
            F.when(common, F.col("best_n")).alias("form_n"),
        )
    )
    roots = last_forms(known.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "n", "n_near", "form", "form_n", "root")


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last. A form is much commoner than its word, so chains are short and have an end.

    Every round doubles the steps taken and is written to the shared folder.
    """
    now = written(forms)
    while True:
        onward = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        further = written(now.join(onward, F.col("root") == F.col("via"), "left").select("word", "root", "further"))
        if further.where(F.col("further").isNotNull()).isEmpty():
            return further.select("word", "root")
        now = further.select("word", F.coalesce("further", "root").alias("root"))
