"""Merges of subjects against a plain walk, neighbours over many ranges, and the context window's scenarios."""

import random
from datetime import datetime


from ledgerlens.operators import merging
from ledgerlens.operators.context_window import context_window
from ledgerlens.operators.ordering import neighbours

PAIR, ALIAS = "project_id string, source string, target string", "project_id string, alias_kind string, alias_value string, canonical_subject_id string"


def planned(spark, pairs, aliases=()):
    judged, ends = merging.plan_merges(spark.createDataFrame([("p", *x) for x in pairs], PAIR), spark.createDataFrame([("p", *x) for x in aliases], ALIAS))
    return {(r.source, r.target): r.error for r in judged.collect()}, {r.source: r.target for r in ends.collect()}


def test_a_chain_of_merges_ends_at_its_last_target(spark):
    errors, ends = planned(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "c")], [("email", "a@x", "a"), ("merged", "old", "a")])
    assert set(errors.values()) == {None} and ends == dict.fromkeys("abcdex", "f")


def test_what_cannot_merge_is_refused(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("t", "a"), ("s", "s"), ("", "z"), ("y", None), ("k", "m"), ("k", "l"), ("k", "l"), ("dead", "q"), ("n", "dead"), ("heir", "dead")]
    errors, ends = planned(spark, pairs, [("merged", "dead", "heir")])
    assert errors == {("a", "b"): "circular_merge", ("b", "c"): "circular_merge", ("c", "a"): "circular_merge", ("t", "a"): "circular_merge", ("s", "s"): "invalid_merge", ("", "z"): "invalid_merge", ("y", None): "invalid_merge", ("k", "m"): "already_merged", ("k", "l"): None, ("dead", "q"): "already_merged", ("n", "dead"): None, ("heir", "dead"): "circular_merge"}
    assert ends == {"k": "l", "n": "heir"}
    assert planned(spark, []) == ({}, {})


def test_merges_match_a_plain_walk(spark):
    r = random.Random(8)
    step = {f"s{i}": f"s{r.randrange(120)}" for i in r.sample(range(120), 80)}
    step = {a: b for a, b in step.items() if a != b}

    def walk(a):
        seen = set()
        while a in step and a not in seen:
            seen.add(a)
            a = step[a]
        return None if a in step else a

    errors, ends = planned(spark, list(step.items()))
    assert ends == {a: walk(a) for a in step if walk(a)} and {a for (a, _), e in errors.items() if e} == {a for a in step if not walk(a)}
    aliases = spark.createDataFrame([("p", "email", f"{a}@x", a) for a in list(step)[:20]] + [("q", "email", "o", "s1")], ALIAS)
    rows = spark.createDataFrame([("p", f"s{i % 120}") for i in range(500)] + [("q", "s1")], "project_id string, subject_id string")
    to = spark.createDataFrame([("p", a, b) for a, b in ends.items()], PAIR)
    after = merging.moved(rows, to).groupBy("project_id", "subject_id").count().collect()
    assert sum(x["count"] for x in after) == 501 and not {x.subject_id for x in after if x.project_id == "p"} & set(ends)
    names = {(x.project_id, x.alias_kind, x.alias_value): x.canonical_subject_id for x in merging.repointed(aliases, to).collect()}
    assert names["q", "email", "o"] == "s1" and all(names["p", "merged", a] == b for a, b in ends.items()) and all(names["p", "email", f"{a}@x"] == ends.get(a, a) for a in list(step)[:20])
    got = {x.source: (x.rows_moved, x.aliases_repointed) for x in merging.receipts(to, {"rows": rows}, aliases).collect()}
    assert got == {a: (500 // 120 + (int(a[1:]) < 500 % 120), int(a in list(step)[:20])) for a in ends}


def test_neighbours_over_the_borders_of_ranges(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), i // 3, i) for i in range(300)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "scope string, at long, id long").repartition(7)
    got = {x.id: (x.before and x.before.id, x.after and x.after.id) for x in neighbours(df, "scope", ["at", "id"], ["id"]).collect()}
    want = {}
    for s in {x[0] for x in rows}:
        own = [None, *sorted(i for scope, _, i in rows if scope == s), None]
        want |= {own[k]: (own[k - 1], own[k + 1]) for k in range(1, len(own) - 1)}
    assert got == want


CHUNK = "scope string, id long, event_id string, ordinal long, occurred_at timestamp, cost long, words array<string>, trusted boolean"


def window(spark, packed, facts=(), budget=100, as_of=9, chunks=None):
    day = lambda d: datetime(2026, 1, d)
    rows = chunks or [("s", 1, "e1", 0, day(1), 10, ["red", "tea"], True), ("s", 2, "e1", 1, day(1), 10, ["tea", "cup"], True), ("s", 3, "e2", 0, day(2), 10, ["tea"], True), ("s", 4, "e3", 0, day(3), 10, ["tea", "cup"], False), ("s", 5, "e4", 0, day(4), 10, [], True), ("t", 6, "e5", 0, day(2), 10, [], True)]
    asked = spark.createDataFrame([(1, "s", day(as_of)), (2, "t", day(as_of))], "query_id long, scope string, as_of timestamp")
    out = context_window(spark.createDataFrame(packed, "query_id long, kind string, id long, used long"), spark.createDataFrame(list(facts), "id long, chunk_id long, event_id string, words array<string>"), spark.createDataFrame(rows, CHUNK), asked, budget)
    return [(r.id, r.action, r.reason_code, r.used) for r in out.orderBy("query_id", "place").collect()]


def test_an_episode_brings_its_neighbours(spark):
    beside = [(2, "included", "episode_neighbor", 30), (5, "included", "episode_neighbor", 40)]
    assert window(spark, [(1, "episode", 3, 20)]) == beside
    assert window(spark, [(1, "episode", 3, 20)], as_of=3) == beside[:1]  # the next turn hasn't happened yet
    assert window(spark, [(1, "episode", 3, 20), (1, "episode", 2, 20)]) == [(1, "included", "episode_neighbor", 30), (5, "included", "episode_neighbor", 40)]
    assert window(spark, [(2, "episode", 6, 20)]) == []


def test_a_fact_brings_the_turn_it_comes_from(spark):
    fact = [(7, None, "e1", ["tea", "cup", "blue"])]
    assert window(spark, [(1, "fact", 7, 20)], fact) == [(2, "included", "fact_source_turn", 30)]
    assert window(spark, [(1, "fact", 7, 20)], [(7, None, "e1", ["none"])]) == [(1, "included", "fact_source_turn", 30)]  # of equals the first
    assert window(spark, [(1, "fact", 7, 20)], [(7, 5, "e1", ["tea"])]) == [(5, "included", "fact_source_turn", 30)]
    assert window(spark, [(1, "fact", 7, 20)], [(7, None, "e3", ["tea"])]) == []  # an untrusted turn is never served
    assert window(spark, [(1, "fact", 7, 20)], [(7, None, None, None)]) == []
    assert window(spark, [(1, "episode", 3, 20), (1, "fact", 7, 20)], fact) == [(2, "included", "episode_neighbor", 30), (5, "included", "episode_neighbor", 40)]


def test_the_window_keeps_to_the_budget(spark):
    assert window(spark, [(1, "episode", 3, 20)], budget=35) == [(2, "included", "episode_neighbor", 30), (5, "excluded", "over_budget", 30)]
    assert window(spark, [(1, "episode", 3, 20)], budget=20) == []
    assert window(spark, []) == []


def test_equal_facts_of_one_event_are_told_apart(spark):
    facts = [(7, None, "e1", ["tea", "cup"]), (8, None, "e1", ["red"])]
    assert window(spark, [(1, "fact", 7, 20), (1, "fact", 8, 20)], facts) == [(1, "included", "fact_source_turn", 30), (2, "included", "fact_source_turn", 40)]
