"""The engine's calls one after the other, over a ledger that is opened again midway."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerlens.engine import EVENT, Engine
from ledgerlens.functions.messages import pseudo_embedding
from ledgerlens.sources.store import Store, Table

NOW = "2026-08-01 00:00:00"


def event(i, subject, value=None, predicate="language", action="create", **more):
    facts = [{"predicate": predicate, "value": value, "confidence": 0.9, "action": action}] if value else []
    row = {"project_id": "p", "subject_id": subject, "event_id": None, "kind": "chat", "occurred_at": datetime(2026, 7, 28) + timedelta(hours=i), "payload": json.dumps({"mock_facts": facts, "n": i}), "actor_type": "user", "actor_id": None, "origin_trust": None, "idempotency_key": None} | more
    return tuple(row[x.split()[0]] for x in EVENT.split(", "))


def test_a_ledger_from_capture_to_forgetting(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/ledger", NOW)
    rows = [event(0, "ann", {"value": "fr"}), event(0, "ann", {"value": "fr"}), event(1, "ann", {"value": "en"}), event(2, "bob", {"value": "tea"}, "drink"), event(3, "bob", {"value": "mate"}, "drink", "supersede"), event(4, "eve", origin_trust="untrusted")]
    requests = spark.createDataFrame(rows, EVENT)
    first = engine.capture(requests)
    assert sorted(r.deduplicated for r in first.collect()) == [False] * 5 + [True]
    assert all(r.deduplicated for r in engine.capture(requests).collect()) and engine.table("events").count() == 5
    assert sorted(r.outcome for r in engine.consolidate().collect()) == ["conflict", "created", "created", "superseded"]
    again = Engine(spark, f"file://{tmp_path}/ledger", NOW)
    assert {(f.subject_id, f.value, f.status) for f in again.facts().collect()} == {("ann", '{"value":"fr"}', "active"), ("ann", '{"value":"en"}', "candidate"), ("bob", '{"value":"tea"}', "superseded"), ("bob", '{"value":"mate"}', "active")}
    queries = spark.createDataFrame([(1, "p", "ann", "which language"), (2, "p", "bob", "what drink"), (3, "p", "nobody", "x")], "query_id long, project_id string, subject_id string, text string")
    served = again.context(queries, pseudo_embedding).collect()
    assert {(r.query_id, r.value, r.action, r.reason_code) for r in served if r.kind == "fact"} == {(1, '{"value":"fr"}', "included", "conflict_disputed"), (1, '{"value":"en"}', "included", "conflict_disputed"), (2, '{"value":"mate"}', "included", "top_score")}
    assert {(r.query_id, json.loads(r.text.removeprefix("chat "))["n"], r.action) for r in served if r.kind == "episode"} == {(1, 0, "included"), (1, 1, "included"), (2, 2, "included"), (2, 3, "included")}
    assert again.inspect(next(r.trace_id for r in served if r.query_id == 2)).count() == 3 and again.traces().count() == 7
    assert {(r.kind) for r in again.graph().collect()} == {"has_fact", "supersedes", "derived_from"}
    assert [tuple(r) for r in again.projects().collect()] == [("p", 3, 5)]
    assert {(r.subject_id, r.facts, r.recalls) for r in again.subjects().collect()} == {("ann", 1, 1), ("bob", 1, 1), ("eve", 0, 0)}
    assert [(r.facts, r.active, r.open_sets, r.traces, r.included) for r in again.stats().collect()] == [(4, 2, 1, 2, 1.0)]
    conflict = again.conflicts().first()
    newer = again.facts("candidate").first().fact_id
    again.resolve(spark.createDataFrame([(conflict.set_id, newer)], "set_id string, keep string"))
    assert again.conflicts().count() == 0 and {(f.value, f.status) for f in again.facts().filter("subject_id = 'ann'").collect()} == {('{"value":"en"}', "active"), ('{"value":"fr"}', "superseded")}
    given = spark.createDataFrame([(1, "p", newer, None, "incorrect"), (2, "p", "none", None, "useful")], "feedback_id long, project_id string, fact_id string, trace_id string, rating string")
    assert {(r.feedback_id, r.error) for r in again.feedback(given).collect()} == {(1, None), (2, "fact_not_found")}
    assert again.facts("disputed").count() == 1
    before = sorted(map(str, again.facts().collect()))
    again.consolidate()
    assert sorted(map(str, again.facts().collect())) == before and again.conflicts().count() == 0
    again.merge_subjects(spark.createDataFrame([("p", "ann", "anna")], "project_id string, subject_id string, into string"))
    assert {r.subject_id for r in again.timeline().collect()} == {"anna", "bob", "eve"}
    again.capture(spark.createDataFrame([event(9, "ann")], EVENT))
    assert again.table("events").filter("subject_id = 'anna'").count() == 3
    clash = spark.createDataFrame([("p", "merged", "ann", "zoe"), ("p", "email", "a@x", "anna")], "project_id string, alias_kind string, alias_value string, canonical_subject_id string")
    assert {(r.alias_value, r.error) for r in again.register_alias(clash).collect()} == {("ann", "alias_conflict"), ("a@x", None)}
    receipt = again.forget(spark.createDataFrame([("p", "bob"), ("p", "gone")], "project_id string, subject_id string")).collect()
    assert {(r.subject_id, r.events, r.facts, r.traces) for r in receipt} == {("bob", 2, 2, 1), ("gone", 0, 0, 0)}
    assert again.table("facts").filter("subject_id = 'bob'").count() == 0 and again.table("events").count() == 4


def test_a_store_merges_by_commit_and_loses_nothing(spark, tmp_path):
    tables = {"last": Table("key string, n long", ("key",)), "kept": Table("key string, n long", ("key",), first=True)}
    rows = lambda *x: spark.createDataFrame(list(x), "key string, n long")
    one, two = (Store(spark, f"file://{tmp_path}/s", tables) for _ in range(2))
    one.commit(last=rows(("a", 1), ("b", 1)), kept=rows(("a", 1)))
    log = one.log
    one.log = lambda seen=log(): seen  # a writer that hasn't seen the other's commit
    two.commit(last=rows(("a", 2), ("c", 2)), kept=rows(("a", 2), ("d", 2)))
    one.commit(last=rows(("e", 3)), kept=rows(("d", 3)))
    del one.log
    read = lambda name: sorted(map(tuple, two.merged(name).collect()))
    assert read("last") == [("a", 2), ("b", 1), ("c", 2), ("e", 3)] and [k for k, _ in read("kept")] == ["a", "d"] and dict(read("kept"))["a"] == 1
    two.commit(last=rows(("b", 0)).withColumn("_gone", F.lit(True)))
    before = two.live("last")
    one.commit(last=rows(("a", 9)))  # while the compaction below has read what was before
    two.live = lambda name: before if name == "last" else Store.live(two, name)
    two.compact("last")
    del two.live
    assert read("last") == [("a", 9), ("c", 2), ("e", 3)] and len(two.live("last")) == 2
    two.commit(last=rows(("b", 5)))
    assert dict(read("last"))["b"] == 5
    paths = two.stored("last", rows(("a", 0))).select("_b").distinct().count()
    assert paths == 1 and two.stored("last").select("_b").distinct().count() > 1


def test_episodes_sources_and_indexes_in_context(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/ledger", NOW)
    turns = [{"role": "user", "content": "My sister Ann moved to Lyon"}, {"role": "assistant", "content": "How nice"}, {"role": "user", "content": "She plays the violin every evening"}]
    facts = [{"predicate": "plays", "value": {"value": "violin"}, "confidence": 0.9, "evidence_span": "plays the  violin"}, {"predicate": "city", "value": {"value": "Lyon"}, "confidence": 0.9, "evidence_span": "nowhere"}, {"predicate": "trip", "value": {"on": "2026-05-01"}, "confidence": 0.9, "temporal_range": {"start": "2026-05-02", "end": "2026-05-03"}}]
    rows = [event(0, "ann", payload=json.dumps({"messages": turns, "mock_facts": facts})), event(5, "ann", payload=json.dumps({"note": "later"})), event(6, "ann", origin_trust="untrusted", payload="{}")]
    engine.capture(spark.createDataFrame(rows, EVENT))
    engine.consolidate()
    chunks = {(r.ordinal, r.text): r.index_text for r in engine.table("chunks").collect()}
    assert len(chunks) == 5 and chunks[2, "user: She plays the violin every evening"] == 'user: She plays the violin every evening FACTS: plays {"value":"violin"}'
    assert sum("FACTS" in x for x in chunks.values()) == 1
    assert {f.observed_at for f in engine.facts().collect()} == {None, "2026-05-02T00:00:00+00:00"}
    log = len(engine.store.log())
    engine.consolidate()
    engine.consolidate(everything=True)
    assert sorted(r.index_text for r in engine.table("chunks").collect()) == sorted(chunks.values())
    assert engine.store.stored("facts").count() == 3 and engine.store.stored("chunks").count() == 6 and len(engine.store.log()) > log  # replays add no row
    asked = spark.createDataFrame([(1, "p", "ann", "who plays violins")], "query_id long, project_id string, subject_id string, text string")
    told = lambda rows: sorted((r.place, r.kind, r.item_id, r.action, r.reason_code) for r in rows.collect())
    served = told(engine.context(asked, pseudo_embedding))
    assert told(engine.context(asked, pseudo_embedding, indexed=True)) == served
    assert sum(k == "episode" for _, k, *_ in served) == 4 and sum(k == "fact" for _, k, *_ in served) == 3
    narrow = engine.context(asked, pseudo_embedding, budget=22, k=1).collect()
    assert {(r.kind, r.reason_code) for r in narrow if r.action == "included"} >= {("fact", "top_score")} or {r.reason_code for r in narrow if r.action == "included"} & {"top_score"}
    early = engine.context(asked, pseudo_embedding, as_of="2026-07-28 03:00:00").collect()
    assert not any("later" in (r.text or "") for r in early) and len(early) == 6
    packet = engine.packets().filter(F.col("trace_id") == early[0].trace_id).first()
    fact = next(f for f in packet.facts if f.predicate == "trip")
    assert (fact.observed_at_relative, fact.freshness, fact.contested, len(packet.episodes), packet.status) == ("91 days (~3 months) before the question", "current", False, 3, "ok")
    health = engine.health().first()
    assert (health.injection_rate, health.contradiction_leakage, health.open_conflicts, health.health_score, health.write_rejection_rate) == (1.0, 0.0, 0, 100.0, 0.0)
    engine.compact()
    assert len(engine.store.live("traces")) == 1 and told(engine.context(asked, pseudo_embedding)) == served


def test_merges_carry_everything_along(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/ledger", NOW)
    engine.capture(spark.createDataFrame([event(i, s, {"value": s}) for i, s in enumerate("abcd")], EVENT))
    engine.consolidate()
    into = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "d", "d")], "project_id string, subject_id string, into string")
    assert {(r.source, r.error) for r in engine.merge_subjects(into).collect()} == {("a", None), ("b", None), ("d", "invalid_merge")}
    assert {t: {r.subject_id for r in engine.table(t).collect()} for t in ("events", "facts", "chunks")} == dict.fromkeys(("events", "facts", "chunks"), {"c", "d"})
    assert {(r.source, r.target, r.events_moved, r.facts_moved) for r in engine.table("merges").collect()} == {("a", "c", 1, 1), ("b", "c", 1, 1)}
    again = spark.createDataFrame([("p", "c", "e"), ("p", "a", "x")], "project_id string, subject_id string, into string")
    assert {(r.source, r.error) for r in engine.merge_subjects(again).collect()} == {("c", None), ("a", "already_merged")}
    assert {r.alias_value: r.canonical_subject_id for r in engine.table("aliases").collect()} == {"a": "e", "b": "e", "c": "e"}
    assert {r.subject_id for r in engine.table("events").collect()} == {"e", "d"}


def test_meaning_and_echoes_in_the_engine(spark, tmp_path):
    """Equal texts have equal vectors, so a value under another name is met by its text alone; a served fact echoes afterwards."""
    embed = lambda text: pseudo_embedding(F.regexp_replace(text, r"^\S+ ", ""))  # noqa: E731  of the value alone
    engine = Engine(spark, f"file://{tmp_path}/ledger", "2026-07-28 04:00:00")
    engine.capture(spark.createDataFrame([event(0, "ann", {"v": "fr"}), event(1, "ann", {"v": "fr"}, "tongue"), event(2, "ann", {"v": "en"}, "tongue", "supersede")], EVENT))
    assert sorted(r.outcome for r in engine.consolidate(embed=embed).collect()) == ["created", "reinforced", "superseded"]
    assert {(f.predicate, f.status) for f in engine.facts().collect()} == {("language", "superseded"), ("tongue", "active")}
    asked = spark.createDataFrame([(1, "p", "ann", "which")], "query_id long, project_id string, subject_id string, text string")
    served = engine.context(asked, embed).collect()
    prompt = engine.prompts().first().prompt
    assert 'tongue = {"v":"en"}' in prompt and "2026-07-28 00:00 chat" in prompt and prompt.index("Known facts") < prompt.index("Past episodes") and len(served) == 4
    engine.capture(spark.createDataFrame([event(9, "ann", {"v": "en"}, "speaks"), event(10, "ann", {"v": "de"}, "drinks")], EVENT))
    assert sorted(r.outcome for r in engine.consolidate(embed=embed).collect()) == ["created", "created", "echo_of_context", "reinforced", "superseded"]
    assert {r.outcome: r.n for r in engine.counters().collect()} == {"created": 2, "reinforced": 1, "superseded": 1, "echo_of_context": 1}


def test_a_second_hop_and_people_in_the_engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/ledger", NOW)
    facts = [("met", {"value": "saw Berta twice, Berta again"}), ("job", {"value": "berta is a nurse"}), ("likes", {"value": "tea", "person": "Ann"}), ("hates", {"value": "tea", "person": "Carl"})]
    engine.capture(spark.createDataFrame([event(i, "ann", v, p, payload=json.dumps({"mock_facts": [{"predicate": p, "value": v, "confidence": 0.9}]}), origin_trust=None) for i, (p, v) in enumerate(facts)], EVENT))
    engine.consolidate()
    embed = lambda text: F.when(text.contains("nurse"), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).cast("array<float>")
    asked = spark.createDataFrame([(1, "p", "ann", "does Ann like tea")], "query_id long, project_id string, subject_id string, text string")
    rows = engine.context(asked, embed, k=3, floor=0.5).orderBy("place").collect()
    told = [(r.predicate, r.reason_code) for r in rows if r.kind == "fact"]
    assert told.index(("likes", "top_score")) < told.index(("hates", "top_score")) and ("job", "multi_hop_expansion") in told and ("met", "top_score") in told
