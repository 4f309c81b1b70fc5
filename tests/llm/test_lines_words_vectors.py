"""Line dedup, spelling variants and centroid clusters against brute force."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ratewright.llm import centroids, line_dedup, spelling
from llm_documents import frame, prose

# lines


def brute_lines(rows, least=40, least_documents=5):
    """Per row: text, lines before, lines dropped."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\x20\t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        lost = [i is not None and len(held := holders.get(key(line), ())) >= least_documents and i != max(held) for line in lines]
        out.append((i, "\n".join(line for line, gone in zip(lines, lost) if not gone), len(lines), sum(lost)))
    return out


def line_rows():
    rng = random.Random(2)
    shared = [prose(rng, "aa", 30)[:n] for n in (39, 40, 41, 60, 200)] + ["É" * 39, "É" * 40, "世" * 41, "x" * 39 + "  y"]
    rows = []
    for i in range(80):
        lines = [prose(rng, "bb", rng.randint(1, 14)) for _ in range(rng.randint(0, 4))]
        for k, line in enumerate(shared):
            if rng.random() < 0.05 * (k + 1):
                lines += [rng.choice(["", " ", "\t"]) + (line.upper() if line.isascii() and rng.random() < 0.3 else line) + rng.choice(["", " \r", "\x0c"])] * rng.randint(1, 2)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    hot = "this very line stands in more documents than any other line does"
    rows += [(1000 + i, f"{hot}\n{prose(rng, 'cc', 5)}") for i in range(120)]
    long = "\n".join(prose(rng, "aa", 12) for _ in range(4000)) + "\n" + hot + "\n" + "z" * 300_000
    rows += [(2000, long), (2001, "\n" * 5), (2002, ""), (2003, None), (2004, hot), (2004, f"{hot}\n{hot}"), (7, rows[7][1]), (None, hot), (None, None), (2005, "z" * 300_000)]
    rows += [(3000 + i, "only four documents have this line, which is one too few\nrest") for i in range(4)] * 2
    return rows


def all_ones(packed, segments, folder):
    """A filter that is full: every line is suspected."""
    full = bytes([255]) * (line_dedup.SEGMENT_BITS // 8)
    packed.sparkSession.createDataFrame([(i, full) for i in range(segments)], "segment int, bits binary").write.parquet(folder)


@pytest.mark.parametrize("full, hot_keys", [(False, 20_000), (True, 30)])
def test_lines_are_dropped_as_brute_force_does(spark, nothing, monkeypatch, full, hot_keys):
    """Also when every line is suspected, and when some repeated lines are hot and others are not."""
    if full:
        monkeypatch.setattr(line_dedup, "twice_seen", all_ones)
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot_keys)
    rows = line_rows()
    docs = frame(spark, [(i, t, None) for i, t in rows]).repartition(7)
    kept = line_dedup.without_repeated_lines(docs, into="__lines")
    assert kept.columns == [*docs.columns, "__lines"] and line_dedup.without_repeated_lines(docs, into="found").columns == docs.columns
    got = Counter((r.doc_id, r.text, r["__lines"].n_lines, r["__lines"].n_dropped) for r in kept.collect())
    want = Counter(brute_lines(rows))
    assert got == want and sum(n for (*_, dropped), n in want.items() if dropped) > 100
    assert line_dedup.without_repeated_lines(nothing).count() == 0
    assert line_dedup.without_repeated_lines(docs.where("doc_id < 0 or doc_id is null")).count() == 2


def test_few_unrepeated_lines_are_suspected(spark):
    rng = random.Random(3)
    docs = frame(spark, [(i, "\n".join(f"{rng.getrandbits(200):x}" for _ in range(20)), None) for i in range(1000)]).repartition(5)
    packed = line_dedup.line_digests(docs, "doc_id", "text", 40)
    assert packed.count() < 100  # many documents to a row
    segments = 20_000 * line_dedup.BITS_PER_LINE // line_dedup.SEGMENT_BITS + 1
    folder = line_dedup.run_folder(spark, "filter")
    line_dedup.twice_seen(packed, segments, folder)
    assert line_dedup.suspects(packed, segments, folder).count() < 400  # of 20,000


def test_merging_filters_loses_no_repeat():
    rng = np.random.default_rng(4)
    lines = rng.integers(0, 2**32, 3000).astype("<u4")
    messages = [(lines[:1500].tobytes(), lines[:10].tobytes()), (lines[1000:].tobytes(), b"")]
    for order in itertools.permutations(messages):
        twice = line_dedup.seen_twice(list(order))
        seen = twice[line_dedup.probes(lines.astype(np.uint64))].all(axis=1)
        assert seen[:10].all() and seen[1000:1500].all() and seen[10:1000].mean() < 0.02


# words


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute_variants(rows, least=7, least_count=2, ratio=10, damaged=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if damaged and h % damaged == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= least_count}
    links = {w: [v for v in words if v != w and near(w, v)] for w in words}
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (n, len(links[w]), form.get(w), words.get(form.get(w)), root)
    return out


def variants(df, **options):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df, **options).collect()}


def word_rows():
    rng = random.Random(6)
    base = ["".join(rng.choice("abcÀéÿ") for _ in range(rng.randint(7, 12))) for _ in range(60)]
    words = []
    for k, word in enumerate(base):
        words += [word] * (2 * 3 ** (k % 6))
        for _ in range(4):
            i = rng.randint(0, len(word) - 1)
            changed = rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abcX") + word[i + 1 :], word[:i] + rng.choice("abc") + word[i:]])
            words += [changed] * rng.randint(1, 40)
    words += [w.upper() for w in base[:20]] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"] * 3 + ["chainaa"] * 2 + ["chainab"] * 20 + ["chainbb"] * 200
    rng.shuffle(words)
    rows = [(i, "\n".join(words[i::50]) + " 1_2 ×÷ ok") for i in range(50)]
    long = "x" * 70_000 + "a" + "y" * 60_000
    rows += [(100 + i, f"{long} {long.replace('a', 'b')} {long.replace('a', '')} short") for i in range(2)]
    return rows + [(200, None), (201, ""), (None, "nameless nameless"), (3, rows[3][1])]


@pytest.mark.parametrize("most", [5_000, 3])
def test_variants_equal_brute_force(spark, nothing, monkeypatch, most):
    """Also when nearly every partition is too large and is cut down to single places."""
    monkeypatch.setattr(spelling, "MOST_LARGE", 5_000_000)
    whole = spelling.partitions
    monkeypatch.setattr(spelling, "partitions", lambda vocabulary: whole(vocabulary, most))
    rows = word_rows()
    docs = frame(spark, [(i, t, None) for i, t in rows]).repartition(5)
    want = brute_variants(rows)
    assert variants(docs) == want
    assert sum(f is not None for _, _, f, _, _ in want.values()) > 20 and max(map(len, want)) > 100_000
    if most == 5_000:
        assert variants(docs, least_length=4, least_count=1, ratio=3, damaged=0) == brute_variants(rows, 4, 1, 3, 0)
        assert variants(nothing) == {} and variants(docs.where("doc_id in (200, 201)")) == {}


def test_forms_are_followed_to_the_last(spark):
    rows = [(1, " ".join(["chainaa"] * 2 + ["chainab"] * 20 + ["chainbb"] * 200 + ["chainba"] * 2))]
    got = variants(frame(spark, [(i, t, None) for i, t in rows]), damaged=0)
    assert got["chainaa"][2:] == ("chainab", 20, "chainbb") and got["chainab"][2:] == ("chainbb", 200, "chainbb")
    assert got["chainbb"] == (200, 2, None, None, "chainbb") and got["chainba"][2:] == ("chainbb", 200, "chainbb")


def test_every_pair_is_enumerated_once_in_every_cut():
    rng = random.Random(1)
    for _ in range(200):
        words = list({"".join(rng.choice("aab") for _ in range(rng.randint(3, 6))) for _ in range(rng.randint(2, 40))})
        got = []
        for m in range(2, 8):
            mine, k = [w for w in words if len(w) in (m, m + 1)], rng.randint(1, m)
            for lo, hi in ((0, k), (k, m + 1)):
                got += [tuple(sorted(p)) for p in spelling.pairs_within(mine, m, lo, hi)]
        assert sorted(got) == sorted(tuple(sorted(p)) for p in itertools.combinations(words, 2) if near(*p))


def test_acceptor_is_minimal_and_accepts_the_words():
    words = sorted({"".join(p) for n in (3, 4) for p in itertools.product("ab", repeat=n)} - {"abab"})
    transitions, final, initial = spelling.minimised(words)

    def language(state):
        return ([""] if final[state] else []) + [s + rest for s, after in transitions[state].items() for rest in language(after)]

    assert sorted(language(initial)) == words
    assert len({tuple(sorted(language(s))) for s in range(len(final))}) == len(final)  # no two states accept the same


# vectors


def brute_clusters(rows, size=64, clusters=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    middle = [v for _, v in first]
    for step in range(rounds + 1):
        found = []
        for _, v in kept:
            gaps = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in middle]
            found.append((min(gaps), gaps.index(min(gaps))))
        if step < rounds:
            for k in range(len(middle)):
                mine = [v for (_, v), (_, c) in zip(kept, found) if c == k]
                if mine:
                    middle[k] = [sum(x) // len(mine) for x in zip(*mine)]
    own = Counter()
    for gap, k in found:
        own[k] += gap
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return Counter((i, k, gap, own[k], sum(own.values()), said[k]) for (i, _), (gap, k) in zip(kept, found))


VECTORS = "vec_id long, embedding array<float>, cluster int, distance string, inertia int"


def clustered(spark, rows, **options):
    found = centroids.clustered(spark.createDataFrame([(i, v, 1, "d", 2) for i, v in rows], VECTORS).repartition(4), **options)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize("size, chunk", [(64, 16_384), (64, 7), (5, 16_384)])
def test_clusters_equal_brute_force(spark, monkeypatch, size, chunk):
    monkeypatch.setattr(centroids, "encoded", functools.partial(centroids.encoded, chunk=chunk))
    rng = np.random.default_rng(size)
    rows = [(i, rng.normal(size=size).astype(np.float32).tolist()) for i in range(200)]
    rows += [(300 + i, [0.5] * size) for i in range(60)] + [(400 + i, [-1000.25 * i] * size) for i in range(5)]  # equal vectors, far ones
    rows += [(500, None), (501, []), (502, [1.0] * (size - 1)), (503, [1.0] * (size - 1) + [None]), (504, [float("nan")] * size), (505, [float("inf")] * size)]
    rows += [(None, [1.0] * size), (3, rows[3][1]), (3, [2.0] * size), (506, [-0.0] * size)]
    assert clustered(spark, rows, size=size) == brute_clusters(rows, size)


def test_few_no_or_enormous_vectors(spark):
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])]
    assert clustered(spark, few, size=2) == brute_clusters(few, 2)
    assert clustered(spark, [], size=2) == Counter() == clustered(spark, [(1, None)], size=2)
    huge = [*few, (4, [3e38, 0.0])]  # its squared distance is no long
    assert clustered(spark, huge, size=2) == brute_clusters(few, 2)


def test_blocks_are_encoded_without_loss():
    rng = np.random.default_rng(9)
    matrix = np.concatenate([rng.integers(-4, 5, (500, 7)), np.array([[centroids.LARGEST, -centroids.LARGEST, 0, 1, -1, 2, -centroids.LARGEST]])]).astype(np.int64)
    dictionaries, codes = centroids.encode_blocks(matrix)
    row = type("Row", (), {"dictionaries": dictionaries, "codes": codes})
    back, places = centroids.unpacked(row, 7)
    assert (np.hstack([d[c] for d, c in zip(back, places)]) == matrix).all()
    assert len(back[0]) <= 82  # distinct pairs, not rows
    middle = matrix[:3]
    assert (centroids.distances(back, places, middle) == ((matrix[:, None, :] - middle[None]) ** 2).sum(axis=2)).all()
