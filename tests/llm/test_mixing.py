"""Targets, the flow and the choice of documents against plain versions."""

import random
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.llm import mixing

SCHEMA = "doc_id long, text string, source string, own array<string>, id string, u string, pattern string, taken string, size string, times string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, o, "x", "x", "x", "x", "x", "x") for i, t, s, o in rows], SCHEMA)


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        per = (sum(sizes.values()) - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if per * weight[s] > most * sizes[s]]
        if not over:
            return fixed | {s: per * weight[s] for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def test_targets_match_a_plain_version(spark):
    r = random.Random(4)
    for sizes in ({"a": 100, "b": 100, None: 10}, {"a": 0}, {f"s{i}": r.choice([0, 1, 5, 1000, 10**6]) for i in range(50)} | {None: 7, "": 3}):
        made = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {x.source: x.target for x in mixing.targets(made).collect()}
        want = plain_targets(sizes)
        assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_flow_repeats_no_more_than_needed():
    """Against all ways to send whole units: as much as fits, and no repetition that a first use could save."""
    sent = mixing.route({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 60, "b": 100})
    assert sum(sent.values()) == 160 and sent[("b",)] <= 30 and sent[("a", "b")] <= 150
    patterns, quotas = {("a",): 2, ("a", "b"): 2, ("b",): 1}, {"a": 3, "b": 4}
    best = None
    for x in range(7):
        for ya in range(7):
            for yb in range(7 - ya):
                for z in range(4):
                    if x + ya <= 3 and yb + z <= 4:
                        cost = sum(max(0, n - size) + max(0, n - 2 * size) for n, size in ((x, 2), (ya + yb, 2), (z, 1)))
                        best = max(best or (-1, 0), (x + ya + yb + z, -cost))
    got = mixing.route(patterns, quotas)
    cost = sum(max(0, got[p] - patterns[p]) + max(0, got[p] - 2 * patterns[p]) for p in patterns)
    assert (sum(got.values()), -cost) == best


def test_overlapping_sources_through_the_mix(spark):
    r = random.Random(9)
    kinds = [["a"], ["b"], ["a", "b"], ["b", "c"], [None], [], None]
    rows = [(i, " ".join("w" * r.randint(1, 30)), "x", kinds[i % 7]) for i in range(2100)]
    got = {x.doc_id: x for x in mixing.mix(docs_of(spark, rows), sources=F.col("own")).collect()}
    size = {i: len(t.split()) for i, t, _, _ in rows}
    by_pattern = Counter()
    for i, _, _, o in rows:
        if o:
            by_pattern[tuple(sorted(o, key=str))] += size[i]
        else:
            assert got[i].taken == 0 and got[i].target is None
    sizes = Counter()
    for p, n in by_pattern.items():
        for s in p:
            sizes[s] += n
    want = mixing.route(dict(by_pattern), plain_targets(sizes))
    taken = Counter()
    for i, _, _, o in rows:
        assert got[i].size == size[i] and got[i].taken % size[i] == 0 and got[i].taken <= 3 * size[i]
        if o:
            taken[tuple(sorted(o, key=str))] += got[i].taken
    assert all(abs(taken[p] - want[p]) <= 30 for p in want)


def test_rows_that_share_a_key_and_hot_patterns(spark, monkeypatch):
    """Repeated rows, null keys, null and blank texts; with a small last range the hash ranges are refined many times."""
    monkeypatch.setattr(mixing, "LAST_RANGE", 3)
    rows = [(i, "w w w w", "big", None) for i in range(3000)] + [(i, "w", None, None) for i in range(40)]
    rows += [(1, "", "big", None), (2, None, "small", None), (None, "w w", "small", None), (None, "w w", "small", None), (5, "w " * 50_000, "big", None)]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total, target = Counter(), {}
    for x in got:
        total[x.source_size, x.target] += x.taken
        assert x.taken <= 3 * x.size
    assert all(abs(n - t) <= 8 or t == 3 * s for (s, t), n in total.items() if s > 100_000 or t == 3 * s)
    times = Counter((x.doc_id, x.size) for x in got for _ in range(x.taken // x.size if x.size else 0))
    kept = Counter((x.doc_id, len(x.text.split())) for x in mixing.mixed_documents(docs).collect())
    assert kept == times
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(docs_of(spark, [])).count() == 0


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 5), f"site{i % 1500}", None) for i in range(4500)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    sizes = Counter()
    for i, t, s, _ in rows:
        sizes[s] += len(t.split())
    want = plain_targets(sizes)
    source = {i: s for i, _, s, _ in rows}
    assert all(abs(x.target - want[source[x.doc_id]]) < 1e-6 * x.target for x in got)


def test_a_key_with_a_third_of_all_rows_is_not_taken_all_or_none(spark):
    """Once with different texts, once with the same row again and again: every source's words come near its target."""
    r = random.Random(6)
    for same in (False, True):
        rows = [(7 if i % 3 == 0 else i, "w w w w" if same else " ".join(f"w{r.randrange(99)}" for _ in range(r.randint(1, 8))), "ab"[i % 2], None) for i in range(6000)]
        docs = docs_of(spark, rows).repartition(5)
        got = mixing.mix(docs).collect()
        total = Counter()
        for x in got:
            total[x.source_size, x.target] += x.taken
        assert len(got) == 6000 and all(abs(n - t) <= 0.02 * t for (_, t), n in total.items())
        times = lambda rows: Counter((x.doc_id, x.taken) for x in rows)
        assert times(got) == times(mixing.mix(docs.repartition(3)).collect())
        kept = Counter(x.doc_id for x in mixing.mixed_documents(docs).collect())
        assert kept == Counter({k: n for k, n in Counter(x.doc_id for x in got for _ in range(x.taken // x.size)).items()})
