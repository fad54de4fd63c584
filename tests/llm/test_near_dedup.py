"""Near-duplicate links pair by pair, and what the de-duplicating stage keeps."""

import random

import numpy as np
import pyarrow as pa

from ledgerlens.llm import simhash


def test_trie_pairs_match_brute_force_down_to_bit_zero():
    r = random.Random(11)
    bases = [r.getrandbits(63) << 1 for _ in range(6)]
    near = [b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 6))) for b in bases for _ in range(12)]
    twins = [x for b in bases for x in (b, b | 1)]
    for values in ([0, 1], [0, 1, 6], [4, 5, 1 << 63, 1 << 63 | 1], twins, near + twins):
        for budget in (1, 4, 8):
            fp = np.array(sorted(set(values)), dtype=np.uint64)
            a, b = simhash.trie_pairs(fp, np.array([0]), np.array([len(fp)]), budget)
            want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= budget}
            assert sorted((min(x), max(x)) for x in zip(a.tolist(), b.tolist())) == sorted(want)


def test_rows_that_share_a_key_are_judged_by_their_texts(spark):
    r = random.Random(7)
    a, b, c, d, e = [" ".join(f"w{r.randrange(5000)}" for _ in range(400)) for _ in range(5)]
    # a2's key is also that of c, which is kept; a2 is a copy of a and must go all the same.
    made = [(1, a), (5, a.upper()), (5, c), (1, b), (2, b.upper()), (None, d), (None, e), (None, e), (None, b), (5, c)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    kept = sorted((x.doc_id or 0, x.text) for x in simhash.one_of_each(docs).collect())
    assert kept == sorted([(1, a), (5, c), (1, b), (0, d), (0, e)])


def near_pair(r, n, share):
    """Two texts of about n words whose five-word shingles have about this Jaccard similarity."""
    words = [f"w{r.randrange(50_000)}" for _ in range(n)]
    other, changed = words[:], set()
    while True:
        a = {tuple(words[i : i + 5]) for i in range(n - 4)}
        b = {tuple(other[i : i + 5]) for i in range(n - 4)}
        if len(a & b) / len(a | b) <= share + 0.005:
            return " ".join(words), " ".join(other)
        i = r.choice([x for x in range(n) if x not in changed])
        changed.add(i)
        other[i] = f"x{r.randrange(50_000)}"


def test_several_fingerprints_find_more_near_copies():
    r = random.Random(2)
    for share, least in ((0.8, 0.85), (0.85, 0.95), (0.9, 0.99)):
        found = 0
        for _ in range(150):
            a, b = (simhash.fingerprints(t, 5, several=6) for t in near_pair(r, 400, share))
            found += any(((x ^ y) & (2**64 - 1)).bit_count() <= 8 for x, y in zip(a, b))
        assert found >= least * 150


def test_one_of_each_matches_brute_force_over_all_fingerprints(spark):
    r = random.Random(13)
    base = [" ".join(f"w{r.randrange(3000)}" for _ in range(200)) for _ in range(6)]
    texts = [None, "", "a b"]
    for t in base:
        for _ in range(6):
            words = t.split()
            for _ in range(r.randint(0, 12)):
                words[r.randrange(200)] = f"y{r.randrange(3000)}"
            texts.append(" ".join(words))
    fps = [simhash.fingerprints(t, 5, several=3) for t in texts]
    near = lambda i, j: any(((x ^ y) & (2**64 - 1)).bit_count() <= 8 for x, y in zip(fps[i], fps[j]))
    root = list(range(len(texts)))
    for _ in texts:
        for i in root[:]:
            for j in range(len(texts)):
                if near(i, j):
                    root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([(i, t, 1, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, fps int, node int, h1 string")
    kept = simhash.one_of_each(docs, budget=8, several=3)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted({root[i] for i in range(len(texts))})
    assert simhash.one_of_each(docs.filter("false"), several=3).count() == 0


def test_links_are_verified(spark):
    """Near copies go whatever connects them; texts that are only somewhat alike stay, even where their fingerprints are near."""
    r = random.Random(21)
    made, gone = [], set()
    for g in range(12):
        base = [f"g{g}w{r.randrange(50_000)}" for _ in range(300)]
        texts = [base]
        for changes, share in ((3, True), (5, True), (20, False), (25, False)):
            other = base[:]
            for i in range(changes):
                other[(i * 300) // changes + r.randrange(300 // changes)] = f"x{r.randrange(10**9)}"
            texts.append(other)
        order = r.sample(range(5), 5)
        for place, k in enumerate(order):
            made.append((g * 10 + place, " ".join(texts[k])))
        alike = {(i, j) for i in range(5) for j in range(5) if i < j and jaccard(texts[order[i]], texts[order[j]]) >= 0.8}
        root = list(range(5))
        for _ in range(5):
            for i, j in alike:
                root[i] = root[j] = min(root[i], root[j])
        gone |= {g * 10 + i for i in range(5) if root[i] != i}
    docs = spark.createDataFrame(made, "doc_id long, text string")
    kept = {x.doc_id for x in simhash.one_of_each(docs, budget=8, several=6, least=0.8).collect()}
    assert {i for i, _ in made} - kept == gone and gone


def jaccard(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_a_nearest_forest_joins_over_the_shortest_links():
    r = random.Random(5)
    for _ in range(60):
        n = r.randrange(2, 14)
        pairs = [(i, j, r.randrange(5)) for i in range(n) for j in range(i) if r.random() < 0.4]
        a, b, d = (np.array([p[k] for p in pairs], dtype=np.int64) for k in range(3))
        kept = simhash.nearest_forest(n, a, b, d)
        for longest in range(5):
            within = lambda own: simhash.forest(n, a[own], b[own]).tolist()
            own = kept[d[kept] <= longest]
            assert within(own) == within(np.flatnonzero(d <= longest)) and len(own) == n - len(set(within(own)))


def test_several_fingerprints_of_gigabytes_have_few_keys_and_wide_cells_lose_no_pair():
    assert [len(simhash.block_masks(n, 8, simhash.WIDE)) for n in (10, 4_000_000, 30_000_000)] == [9, 9, 9]
    r = np.random.default_rng(3)
    agreed = 0b1111111 << 57
    for n, near, whole in ((300, 40, False), (6000, 400, False), (6000, 5000, True)):  # the last one has a group that no split would divide
        fp = r.integers(0, 1 << 57, n, dtype=np.uint64)
        for i in range(near):
            base = 0 if whole else r.integers(n)
            fp[r.integers(1, n)] = fp[base] ^ np.uint64(sum(1 << int(x) for x in r.choice(57, r.integers(1, 9 - 5 * whole), replace=False)))
        fp = np.unique(fp)
        want = {(a, b) for i in range(0, len(fp), 1000) for a, b in zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(fp[i : i + 1000, None] ^ fp) <= 8))) for a in [a + i] if a < b}
        got = {(min(x), max(x)) for a, b in simhash.cell_pairs(fp, 8, agreed) for x in zip(a.tolist(), b.tolist())}
        assert got == want and want
        pairs = np.array(sorted(want))
        u, v = simhash.cell_links(fp, 8, agreed)
        assert {(min(x), max(x)) for x in zip(u.tolist(), v.tolist())} <= want and len(u) <= simhash.FORESTS * len(fp)
        assert (simhash.forest(len(fp), u, v) == simhash.forest(len(fp), pairs[:, 0], pairs[:, 1])).all()


def test_all_near_pairs_of_a_fingerprint_with_few_are_handed_on():
    r = random.Random(4)
    base = r.getrandbits(50)
    fp = np.array(sorted({base ^ (1 << i) ^ (1 << (i + 9)) for i in range(3)} | {r.getrandbits(50) for _ in range(100)}), dtype=np.uint64)
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 8}
    got = {(min(x), max(x)) for x in zip(*(x.tolist() for x in simhash.cell_links(fp, 8, 0)))}
    assert len(want) == 3 and got == want


def test_links_do_not_hang_on_the_order_of_rows():
    r = np.random.default_rng(9)
    fp = np.unique(np.uint64(12345) ^ np.array([sum(1 << int(x) for x in r.choice(57, 3, replace=False)) for _ in range(200)], dtype=np.uint64))
    run = simhash._near_cell_links(8, simhash.block_masks(len(fp), 8, simhash.WIDE))

    def links(order):
        cols = [np.zeros(len(fp), np.int64)] * 3 + [fp[order].view(np.int64)]
        return [x.to_pydict() for x in run([pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=list("bpcf"))])]

    assert links(np.arange(len(fp))) == links(r.permutation(len(fp)))


def test_hot_cells_of_several_fingerprints_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_HOT", 20)
    monkeypatch.setattr(simhash, "TIMES_HOT", 0)
    r = random.Random(6)
    fps = {(i, b ^ sum(1 << x for x in r.sample(range(63), r.randint(0, 5)))) for i in range(2) for b in [r.getrandbits(63)] for _ in range(90)}
    found = simhash.near_links(spark.createDataFrame(sorted(fps), "i int, fp long"), 8, 2).distinct().collect()
    for i in range(2):
        own = sorted(f for k, f in fps if k == i)
        at = {f: n for n, f in enumerate(own)}
        links = [(at[x.u], at[x.v]) for x in found if x.i == i]
        want = [(a, b) for a in range(len(own)) for b in range(a) if (own[a] ^ own[b]).bit_count() <= 8]
        assert {(max(x), min(x)) for x in links} <= set(want)
        roots = [simhash.forest(len(own), *(np.array(x) for x in zip(*pairs))).tolist() for pairs in (links, want)]
        assert roots[0] == roots[1]
