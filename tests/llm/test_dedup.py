"""Near duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from evigrain.llm import dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, keys string, rep int, _kept_id int, kept_id int"


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, percent):
    sets = {d: shingles(t, k) for d, t in rows}
    ids = sorted(sets)
    label = {i: i for i in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = r.choices(vocabulary, k=45)
    rows = []
    for i in range(60):  # groups of near copies of many lengths
        base = r.choices(vocabulary, k=r.choice([3, 5, 8, 20, 60, 75, 90, 200, 400]))
        for _ in range(r.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 25))):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            rows.append(" ".join(t))
    for _ in range(60):  # short texts around one common passage, alike but not near
        rows.append(" ".join(r.choices(vocabulary, k=12) + passage + r.choices(vocabulary, k=8)))
    chain = r.choices(vocabulary, k=120)
    for i in range(12):  # a chain whose ends are far apart
        rows.append(" ".join(chain[i * 4 :] + r.choices(vocabulary, k=i * 4)))
    rows += ["", None, "one", "One", "one two", " ONE\ttwo ", "\x00", "a\x00b c", "é É"]
    r.shuffle(rows)
    return list(enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 7, "x", 1, 2, 3) for d, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("k", [4, 5])
def test_components_equal_brute_force(spark, k):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(frame(spark, rows), k=k, percent=80).collect()}
    assert got == brute(rows, k, 80)


def test_empty_table_and_repeated_rows(spark):
    assert dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    out = dedup.near_duplicates(frame(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert len(out) == 4 and {r.component_id for r in out} == {5}
    assert sum(r.kept for r in out) == 2  # both rows of document 5


def test_first_copies_keeps_columns_and_nulls(spark):
    rows = [(1, "x y z a b c"), (2, "x y z a b c"), (3, None), (4, ""), (None, "q")]
    out = dedup.first_copies(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "n", "keys", "rep", "_kept_id", "kept_id"]
    assert sorted(r.doc_id is None and -1 or r.doc_id for r in out.collect()) == [-1, 1, 3, 4]


def test_estimate_is_near_the_similarity():
    r = np.random.default_rng(1)
    shared, a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    reg = dedup.registers([np.unique(np.r_[shared, a]), np.unique(np.r_[shared, b])])
    assert abs(float(dedup.estimate(reg[:1].reshape(1, -1), reg[1:].reshape(1, -1), np.array([900]), np.array([900]))[0]) - 0.8) < 0.15


def test_prefixes_meet_whatever_the_order():
    r = np.random.default_rng(2)
    for _ in range(200):
        n = int(r.integers(3, 64))
        a = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
        drop = int(r.integers(0, max(1, len(a) // 10) + 1))
        b = np.unique(np.r_[a[drop:], r.integers(0, 1 << 62, drop, dtype=np.uint64)])
        counts = r.integers(0, 5, 1 << dedup.COUNT_BITS).astype(np.int32)
        both, every = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * both >= 80 * every:
            assert len(np.intersect1d(dedup.prefix(a, counts, 80), dedup.prefix(b, counts, 80)))


def test_intersections_and_joining_links():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[base[r.random(60) < 0.8], r.integers(0, 1 << 62, 9, dtype=np.uint64)]) for _ in range(90)] + [np.zeros(0, np.uint64)]
    got = dedup.common(sets)
    for i in range(len(sets)):
        for j in range(len(sets)):
            assert i == j or got[i, j] == len(np.intersect1d(sets[i], sets[j]))
    near = r.random((40, 40)) < 0.03
    near |= near.T
    label = np.arange(40) // 2
    links = dedup.joining(label, near)
    assert all(near[a, b] for a, b in links)

    def parts(pairs):
        own = list(range(40))
        root = lambda x: x if own[x] == x else root(own[x])
        for a, b in pairs:
            own[root(a)] = root(b)
        return [root(i) for i in range(40)]

    same = [(2 * i, 2 * i + 1) for i in range(20)]
    want, have = parts(same + list(zip(*np.nonzero(near)))), parts(same + links)
    assert {(want[i] == want[j]) for i in range(40) for j in range(40) if have[i] == have[j]} <= {True}
    assert {(have[i] == have[j]) for i in range(40) for j in range(40) if want[i] == want[j]} <= {True}


def test_groups_larger_than_a_block(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(3):
            t[r.randrange(70)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    sets = {d: shingles(t, 4) for d, t in rows}
    import struct

    codes = {}
    packed = [(d, b"".join(struct.pack("<Q", v) for v in sorted(codes.setdefault(x, len(codes)) for x in s))) for d, s in sets.items()]
    full = spark.createDataFrame(packed, "id long, full binary")
    members = spark.createDataFrame([(1, d, d) for d, _ in rows], "key long, id long, label long")
    links = {tuple(sorted((x.a, x.b))) for x in dedup._linked_in_groups(members, full, 80, block_rows=7).collect()}
    own = {d: d for d, _ in rows}
    root = lambda x: x if own[x] == x else root(own[x])
    for a, b in links:
        assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        p, q = sorted((root(a), root(b)))
        own[q] = p
    want = brute(rows, 4, 80)
    assert {d: root(d) for d, _ in rows} == {d: v[1] for d, v in want.items()}


@pytest.mark.parametrize("lo, hi", [(64, 80), (80, 200)])
def test_bands_meet_at_the_threshold(lo, hi):
    """Sets that leave registers empty, or nearly, at a similarity of just 0.8."""
    r = np.random.default_rng(lo)
    left, right = [], []
    for _ in range(3000):
        n = int(r.integers(lo, hi))
        both = next(c for c in range(n) if 100 * c >= 80 * (2 * n - c))
        x = r.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
        left.append(np.sort(x[:n]))
        right.append(np.sort(x[-n:]))
    a, b = (dedup.band_keys(dedup.registers(s)) for s in (left, right))
    assert (a == b).any(axis=1).all()


def test_long_sets_go_by_size(spark, monkeypatch):
    """Links between sets of every size, with size classes from 20 elements on."""
    monkeypatch.setattr(dedup, "LONG_BYTES", 160)
    r = np.random.default_rng(5)
    pool = np.unique(r.integers(0, 1 << 62, 400, dtype=np.uint64))
    sets = [np.sort(pool[: int(n)]) for n in r.integers(8, 400, 120)] + [np.sort(pool[:n]) for n in (16, 20, 25, 80, 100, 125)]
    full = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "id long, full binary")
    members = spark.createDataFrame([(1, i, i) for i in range(len(sets))], "key long, id long, label long")
    links = [(x.a, x.b) for x in dedup._linked_in_groups(members, full, 80, block_rows=10, block_bytes=4000).collect()]
    near = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    assert all(near(a, b) for a, b in links)

    def parts(pairs):
        own = list(range(len(sets)))
        root = lambda x: x if own[x] == x else root(own[x])
        for a, b in pairs:
            p, q = sorted((root(a), root(b)))
            own[q] = p
        return [root(i) for i in range(len(sets))]

    assert parts(links) == parts([(a, b) for a in range(len(sets)) for b in range(a) if near(a, b)])


def test_very_long_texts(spark):
    r = random.Random(4)
    long = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    other = list(long)
    for i in range(0, 60_000, 90):
        other[i] = "changed"
    out = {x.doc_id: x for x in dedup.near_duplicates(frame(spark, [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[::-1]))])).collect()}
    assert [out[i].component_id for i in (1, 2, 3)] == [1, 1, 3] and out[1].n_shingles > 59_000
