"""Hard negatives, repeated passages and periodic runs against brute force, and on odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import negatives, periodic, substrings

VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string"


# Hard negatives


def mined_plainly(rows, every, positives, negatives_):
    sound = set()
    for key, vec, label in rows:
        if key is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        sound.add((key, label, tuple(max(-(1 << 22), min(1 << 22, math.floor(256 * float(np.float32(x))))) for x in vec)))
    out = Counter()
    for key, label, vec in sound:
        if key % every:
            continue
        scored = [(-sum(a * b for a, b in zip(vec, v)), k, other) for k, other, v in sound]
        for s, p, _ in sorted(x for x in scored if x[2] == label and x[1] != key)[:positives]:
            fit = sorted((n, k) for n, k, other in scored if other != label and 30 * -s <= 100 * -n <= 90 * -s)[:negatives_]
            out.update((key, p, i + 1, k, -s, -n) for i, (n, k) in enumerate(fit))
    return out


def mined(spark, rows, schema=VECTORS, **more):
    got = negatives.mine(spark.createDataFrame(rows, schema), **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("part, block", [(8192, 8192), (40, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, part, block):
    monkeypatch.setattr(negatives, "PART", part)
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=6)
    rows = [(i, [float(x) for x in (hot + rng.normal(size=6) * 0.01 if i % 3 == 0 else rng.normal(size=6))], int(rng.integers(4))) for i in range(400)]
    rows += [(1000 + i, [1.0] * 6, i % 2) for i in range(90)]  # ties everywhere
    assert mined(spark, rows, every=10) == mined_plainly(rows, 10, 5, 10)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (3, [1.0, 1.5], 1), (4, [1.0], 2), (5, [0.5, 0.5], 2), (6, None, 1), (8, [nan, 1.0], 2), (9, [1.0, None], 2), (10, [inf, 1.0], 2), (11, [1.0, 1.0], None)]
    rows += [(None, [1.0, 1.0], 2), (12, [], 2), (20, [-1.0, -2.0], 1), (30, [1e30, 1e30], 3), (33, [1e30, 1e30], 3), (40, [0.0, 0.0], 1)]
    assert mined(spark, rows, every=10) == mined_plainly(rows, 10, 5, 10)
    assert not mined(spark, [])
    assert not mined(spark, [(1, [1.0], 1)])
    assert not mined(spark, [(0, [], 1), (1, [], 2)], every=1)
    more = [(*r, 1, 2, "x") for r in rows]
    assert mined(spark, more, VECTORS + ", id int, pivot int, code string", every=10) == mined_plainly(rows, 10, 5, 10)


@pytest.mark.parametrize("same", [True, False])
def test_a_tree_of_small_leaves_finds_what_a_scan_finds(monkeypatch, same):
    monkeypatch.setattr(negatives, "LEAF", 4)
    rng = np.random.default_rng(2)
    rows, labels, ids = rng.integers(-9, 9, size=(300, 3)), rng.integers(3, size=300), rng.permutation(300)
    tree = negatives.BallTree(ids, labels, rows)
    queries, lo = rng.integers(-9, 9, size=(30, 3)), rng.integers(-60, 60, size=(30, 2))
    asks, hi = rng.integers(3, size=30), lo + rng.integers(0, 60, size=(30, 2))
    best, found = tree.search(np.arange(30), asks, queries, lo, hi, 7, same)
    for q in range(30):
        for w in range(2):
            fit = [(-s, i) for s, i, x in zip((queries[q] @ rows.T).tolist(), ids.tolist(), labels) if lo[q, w] <= s <= hi[q, w] and (x == asks[q]) == same and i != q]
            assert [(-s, i) for s, i in zip(best[q, w].tolist(), found[q, w].tolist()) if s > negatives.LEAST] == sorted(fit)[:7]


def test_a_ball_bounds_what_it_holds():
    rng = np.random.default_rng(1)
    rows = rng.integers(-300, 300, size=(500, 8))
    tree = negatives.BallTree(np.arange(500), np.zeros(500, np.int64), rows)
    queries = rng.integers(-300, 300, size=(20, 8))
    lower, upper = tree.bounds(queries)
    scores = queries @ tree.rows.T
    for n, (a, b) in enumerate(zip(tree.start, tree.end)):
        assert (lower[:, n] <= scores[:, a:b].min(axis=1)).all() and (upper[:, n] >= scores[:, a:b].max(axis=1)).all()


# Repeated passages


def cleaned_plainly(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    times = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = Counter()
    for (key, _), words in zip(rows, texts):
        gone = set()
        for i in range(len(words) - window + 1):
            if times[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[(key, len(words), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def cleaned(spark, rows, schema=DOCS, **more):
    got = substrings.remove_repeats(spark.createDataFrame(rows, schema), **more)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("window", [1, 2, 4, 9, 35])
def test_repeats_equal_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(substrings, "AT_ONCE", 200)
    rng = random.Random(window)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(window, 3 * window + 1))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(4)):
            words += rng.choice(passages) if rng.random() < 0.5 else [str(rng.randrange(40)) for _ in range(rng.randrange(2 * window))]
        rows.append((i % 100, rng.choice([" ", "\n", " \t"]).join(words)))
    assert cleaned(spark, rows, window=window) == cleaned_plainly(rows, window)


def test_repeats_of_odd_rows(spark):
    long = " ".join(str(i) for i in range(60))
    rows = [(1, long), (1, long), (2, None), (None, ""), (None, " \n\t "), (3, "x " + long + " y"), (4, "é ü " * 40), (5, "a " * 20_000), (6, "b " * 34), (7, long.replace(" ", " ")), (8, "c " * 36)]
    assert cleaned(spark, rows) == cleaned_plainly(rows, 35)
    assert not cleaned(spark, [])
    assert cleaned(spark, [(1, None)]) == cleaned_plainly([(1, None)], 35)
    names = "id long, id2 string, places string, copies int, n_removed int, whole string, key int"
    more = [(*r, 1, "x", "y", 2, 3, "z", 4) for r in rows]
    assert cleaned(spark, more, f"{DOCS}, {names}") == cleaned_plainly(rows, 35)


def test_shifts_meet_on_the_cover():
    for v, cover in substrings.COVERS.items():
        assert all(any((i + d) % v in cover and (j + d) % v in cover for d in range(v)) for i in range(v) for j in range(v))


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 20))
def test_rolling_hashes_tell_windows_apart(h, words):
    got = substrings.rolling(np.array(h, np.uint64) * np.uint64(0xD1342543DE82EF95), words, substrings.BASES[0]).tolist()
    windows = [tuple(h[i : i + words]) for i in range(len(h) - words + 1)]
    assert len(got) == len(windows) and len(set(zip(windows, got))) == len(set(windows)) == len(set(got))


# Periodic runs


def runs_plainly(ids, least=12):
    found = []
    n = len(ids)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            length = j + q - i
            word = ids[i : i + length]
            if length >= max(least, 2 * q) and not any(all(word[k] == word[k + p] for k in range(length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 12)), max_size=6), st.sampled_from([2, 5, 12, 13]))
def test_runs_equal_brute_force(parts, least):
    ids = [x for word, times in parts for x in word * times]
    assert periodic.runs(np.array(ids, np.int64), least) == runs_plainly(ids, least)


def test_runs_of_long_periods():
    rng = random.Random(3)
    for n, p in ((900, 100), (700, 333), (1000, 1), (64, 32), (65, 33), (400, 7)):
        word = [rng.randrange(1000) for _ in range(p)]
        ids = [rng.randrange(1000) for _ in range(20)] + (word * n)[:n] + [rng.randrange(1000) for _ in range(20)]
        assert periodic.runs(np.array(ids, np.int64)) == runs_plainly(ids)


def test_a_very_long_run_takes_linear_time():
    assert periodic.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    ids = np.tile(np.arange(500), 400)
    assert periodic.runs(ids) == [(0, 200_000, 500)]


def described_plainly(key, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(key).encode()) if key is not None else 1, len(words)
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_plainly(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    most = (*top[0], 1000 * top[0][1] // top[0][2]) if top else (None,) * 4
    return (
        key,
        len(found),
        *most,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_periodic_rows_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(120)))) for i in range(150)]
    rows += [(7, "x y z\n" * 8 + "w"), (7, "x y z\n" * 8 + "w"), (None, "a " * 50), (-3, None), (5, ""), (6, " \t"), (8, "é ü " * 9)]
    got = periodic.periodic_runs(spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", start int, found string"), plant=True)
    assert got.columns == ["doc_id", *periodic.COLUMNS]
    assert Counter(map(tuple, got.collect())) == Counter(described_plainly(*r) for r in rows)
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows)
    assert not periodic.periodic_runs(spark.createDataFrame([], DOCS)).collect()


def test_spans_of_runs(spark):
    docs = spark.createDataFrame([(1, "a b " * 8, "k"), (2, None, "k")], DOCS + ", runs string")
    assert [[tuple(x) for x in r._runs] for r in periodic.find_runs(docs).orderBy("doc_id").collect()] == [[(0, 16, 2)], []]
