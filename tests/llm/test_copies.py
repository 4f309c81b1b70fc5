"""Fingerprints and near duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest

from ratewright.llm import near_duplicates as near
from ratewright.llm import sketches
from ratewright.llm.components import components
from llm_documents import frame, prose


def shingle_set(text, n=3):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute_components(rows, percent=85):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i in parent}


def test_components_and_sizes(awkward, awkward_rows, nothing):
    got = near.near_duplicates(awkward).collect()
    rows = [(i, t) for i, t, _ in awkward_rows]
    want = brute_components(rows)
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted((i, len(shingle_set(t))) for i, t in rows if i is not None)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert len(set(want.values())) < len(want)
    assert near.near_duplicates(nothing).count() == 0


def test_large_group_of_near_copies_in_small_blocks(spark, monkeypatch):
    """Chains and stars of copies around the threshold, more than a block holds."""
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = random.Random(9)
    base = prose(rng, "aa", 120).split()
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(len(words)), rng.randint(0, 9)):
            words[k] = f"w{rng.randint(0, 50)}"
        rows.append((i, " ".join(words), None))
    rows += [(100 + i, prose(rng, "bb", 60), None) for i in range(30)]
    got = {r.doc_id: r.component_id for r in near.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components([(i, t) for i, t, _ in rows])


def test_no_pair_of_thousands_is_left_to_a_bucket_it_does_not_share(spark):
    """Two-member groups at 0.85 to 0.95: each is linked by a single pair, which no other link makes up for."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    rng, rows = random.Random(21), []
    for i in range(3000):
        words = [f"{rng.getrandbits(40):x}" for _ in range(62)]  # 60 shingles, 3 to 9 of them in one text alone
        rows += [(2 * i, " ".join(words), None), (2 * i + 1, " ".join(words[: 62 - (9, 9, 9, 6, 3)[i % 5]]), None)]
    try:
        got = near.near_duplicates(frame(spark, rows).repartition(8)).where("component_id <> doc_id - doc_id % 2").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == 0


@pytest.mark.parametrize("size", [1, 2, 5, 100, 3000])
def test_sketch_coordinates_agree_as_often_as_the_sets_do(size):
    rng = np.random.default_rng(size)
    shares, wanted = [], []
    for _ in range(30):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        b = np.concatenate([a[: size * 4 // 5], rng.integers(0, 2**63, size - size * 4 // 5).astype(np.uint64)])
        x, y = near.fast_similarity_sketch(np.unique(a)), near.fast_similarity_sketch(np.unique(b))
        assert len(x) == near.COORDINATES and (x != near.EMPTY).all()
        shares.append((x == y).mean())
        wanted.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert np.mean(shares) == pytest.approx(np.mean(wanted), abs=0.03)


def test_sketch_rounds_taken_together_change_nothing(monkeypatch):
    a = np.random.default_rng(1).integers(0, 2**63, 40).astype(np.uint64)
    filled = np.full(near.COORDINATES, near.EMPTY)
    for i in range(2 * near.COORDINATES):  # one round at a time, as the method is stated
        x = near.mix(a + np.uint64(i + 1) * near.GOLDEN)
        bins = (x & np.uint64(near.COORDINATES - 1)).astype(int) if i < near.COORDINATES else np.full(len(a), i - near.COORDINATES)
        np.minimum.at(filled, bins, (np.uint64(i) << np.uint64(54)) | (x >> np.uint64(10)))
        if (filled != near.EMPTY).all():
            break
    assert (filled == near.fast_similarity_sketch(a)).all()


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    links = spark.createDataFrame([*path, *star, (7, 7), (3, 2)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 200)}}
    assert components(links.limit(0)).count() == 0


def test_fingerprints_of_edited_texts(awkward, awkward_rows, nothing):
    got = sketches.fingerprint_edits(awkward).collect()
    rows = sorted([(i, t or "") for i, t, _ in awkward_rows if i is not None], key=lambda r: (-r[0], r[1]))
    rows += sorted([(i, t or "") for i, t, _ in awkward_rows if i is None], key=lambda r: r[1])
    want = []
    for k, (doc_id, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    by_text = {}
    texts = dict(rows)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id is not None:
            assert by_text.setdefault(texts[r.doc_id].lower(), r.fingerprint) == r.fingerprint
    long = next(r for r in got if r.doc_id == 205)
    assert 0.4 < long.near_edited <= 1 and len(long.fingerprint) > 16 * 2000
    assert sketches.fingerprint_edits(nothing).count() == 0


def plain_sketch(text, size=5, fraction=8):
    """The retained hashes by their definition, one shingle after the other."""
    mask = 2**64 - 1
    hashes = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in text.lower().split()]
    size, out = min(size, len(hashes)), set()
    for k in range(len(hashes) - size + 1 if hashes else 0):
        x = size
        for h in hashes[k : k + size]:
            x = ((x ^ h) * 0x100000001B3) & mask
            x ^= x >> 29
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        out.add(x ^ (x >> 31))
    kept = {x for x in out if x < 2**64 // fraction - 1}
    return kept or set(sorted(out)[:1])


def test_likeness_equals_its_definition(spark):
    """Containment of the smaller set of retained hashes, against the edited text and the next document."""
    rng = random.Random(44)
    texts = [prose(rng, "aa", rng.choice([0, 1, 4, 5, 30, 400])) for _ in range(40)]
    texts += [texts[5], " ".join([texts[6], texts[7], prose(rng, "bb", 200)])] + [" ".join(texts[i].split()[:-3] + ["new"]) for i in range(8, 20)]
    got = {r.doc_id: r for r in sketches.fingerprint_edits(frame(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}

    def like(a, b):
        return len(a & b) / min(len(a), len(b)) if a and b else float(len(a) == len(b))

    for i, text in enumerate(texts):
        other = texts[i - 1]  # descending ids; after the last the first
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        own = plain_sketch(text)
        assert got[i].fingerprint == "".join(f"{x:016x}" for x in sorted(own))
        assert got[i].near_edited == pytest.approx(like(own, plain_sketch(edited))) and got[i].near_next == pytest.approx(like(own, plain_sketch(other)))


def test_one_document_is_its_own_next(spark):
    row = sketches.fingerprint_edits(frame(spark, [(1, "a b c d e f g h", None)])).first()
    assert row.near_next == 1.0 and row.n_chars == 15


def test_sketches_merge_and_contain():
    known = sketches.WordHashes()
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(20_000)]
    whole, part = sketches.sketch(" ".join(words), known), sketches.sketch(" ".join(words[:2000]), known)
    rest = sketches.sketch(" ".join(words[1996:]), known)
    assert sketches.likeness(whole, part) > 0.99
    assert (sketches.merged(part, rest) == whole).all()
    assert len(whole) == pytest.approx(19_996 / 8, rel=0.1)
    assert len(sketches.sketch("one two", known)) == 1 and len(sketches.sketch("", known)) == 0


def test_sketch_table(awkward, awkward_rows):
    got = {r.doc_id: r.sketch for r in sketches.fingerprints(awkward.where("doc_id >= 200")).collect()}
    assert got[202] == got[203] == [] and got[200] == got[201] and len(got[205]) > 2000
