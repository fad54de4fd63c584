"""Streams against their batch twins, and the loaders on small files."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from ledgerlens.plans.catalogue import QUERIES
from ledgerlens.sources import datasets
from ledgerlens.streaming import capture

SF = "/root/testdata/sf0.001"


def in_steps(spark, folder, frame, parts, columns):
    """A stream that reads ``parts`` files, one in each micro-batch, in the order of time."""
    rows = frame.orderBy(*columns).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], frame.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_consolidation_stream_is_the_batch_query(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long")).select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), "k").filter("user_id < 40")
    drain(capture.consolidate(in_steps(spark, tmp_path / "in", events, 3, ["ts", "event_id"])), "decided")
    want = QUERIES["c24_consolidate"](spark, SF).filter("user_id < 40")
    columns = ["event_id", "decision", "active_id", "supersedes_id", "reinforced"]
    got = sorted(map(tuple, spark.table("decided").select(columns).collect()), key=str)
    assert got == sorted(map(tuple, want.select(columns).collect()), key=str) and len(got) > 50


def test_late_events_change_nothing(spark, tmp_path):
    schema = "user_id long, event_type string, event_id long, ts timestamp, k long"
    rows = [(1, "a", 1, datetime(2024, 1, 5), 7), (1, "a", 2, datetime(2024, 1, 2), 9), (1, "a", 3, datetime(2024, 1, 6), 7), (1, "a", 4, datetime(2024, 1, 7), None)]
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"p{row[2]}"))
    for i, row in enumerate(rows):
        spark.read.parquet(str(tmp_path / f"p{row[2]}")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = capture.consolidate(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    out = {r.event_id: (r.decision, r.active_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {1: ("create", 1), 2: ("late", 1), 3: ("reinforce", 1), 4: ("supersede", 4)}


def test_capture_appends_each_key_once(spark, tmp_path):
    sink, rows = capture.append_new(str(tmp_path / "t"), "key"), spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, n int")
    sink(rows, 0)
    sink(rows, 0)  # a batch that is run again
    sink(spark.createDataFrame([("b", 9), ("c", 4)], "key string, n int"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_stream_drops_repeats_and_counts_days(spark, tmp_path):
    rows = [(1, "x", datetime(2024, 1, 1, 5)), (1, "x", datetime(2024, 1, 1, 6)), (2, "x", datetime(2024, 1, 1, 7)), (3, "y", datetime(2024, 1, 9))]
    frame = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp")
    drain(capture.capture_once(in_steps(spark, tmp_path / "a", frame, 2, ["ts", "event_id"]), "event_id"), "once")
    assert sorted(r.event_id for r in spark.table("once").collect()) == [1, 2, 3]
    drain(capture.daily_counts(in_steps(spark, tmp_path / "b", frame, 2, ["ts", "event_id"])), "days", "update")
    assert {(r.day, r.event_type): r.n for r in spark.table("days").orderBy("n").collect()}[(datetime(2024, 1, 1), "x")] == 3


def test_loaders(spark, tmp_path):
    one = {"question_id": "q1_abs", "question_type": "single", "question": "?", "answer": ["a", "b"], "question_date": "2023/06/01 (Thu) 10:00", "haystack_session_ids": [["s1"], ["s2", "s3"]], "haystack_dates": ["2023/05/01 (Mon) 09:00", "odd"], "haystack_sessions": [[{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], [{"role": "user", "content": "x"}]], "answer_session_ids": ["s1"]}
    (tmp_path / "s.json").write_text(json.dumps([one, {**one, "question_id": "q2", "answer": "plain"}]))
    q = {r.question_id: r for r in datasets.session_questions(spark, str(tmp_path / "s.json")).collect()}
    assert (q["q1_abs"].answer, q["q1_abs"].abstention, q["q1_abs"].asked_at) == ("a; b", True, datetime(2023, 6, 1, 10))
    assert (q["q2"].answer, q["q2"].abstention) == ("plain", False)
    turns = sorted((r.question_id, r.session, r.turn, r.content, r.occurred_at) for r in datasets.session_turns(spark, str(tmp_path / "s.json")).collect())
    assert turns[:3] == [("q1_abs", 0, 0, "hi", datetime(2023, 5, 1, 9)), ("q1_abs", 0, 1, "yo", datetime(2023, 5, 1, 9)), ("q1_abs", 1, 0, "x", datetime(2023, 5, 1, 1))]
    assert {r.session_id for r in datasets.session_turns(spark, str(tmp_path / "s.json")).collect()} == {"s1", "s2+s3"}
    talk = lambda n: [{"speaker": "A", "dia_id": f"D{n}:1", "text": f"t{n}"}]
    sample = {"sample_id": "c1", "conversation": {"speaker_a": "A", "speaker_b": "B", "session_1_date_time": "1:56 pm on 8 May, 2023", "session_1": talk(1), "session_2": talk(2), "session_4": talk(4)}, "qa": [{"question": "?", "answer": 7, "category": 2, "evidence": ["D2:1", "D1:3; D4:9", "x D7:1"]}, {"question": "!", "category": 5}, {"question": "0", "answer": None, "category": 4}]}
    (tmp_path / "d.json").write_text(json.dumps([sample]))
    got = sorted((r.session, r.text, r.occurred_at) for r in datasets.dialogue_turns(spark, str(tmp_path / "d.json")).collect())
    assert got == [(1, "t1", datetime(2023, 5, 8, 13, 56)), (2, "t2", datetime(2023, 5, 8, 2, 56))]
    qa = sorted(datasets.dialogue_questions(spark, str(tmp_path / "d.json")).collect(), key=lambda r: r.number)
    assert [(r.kind, r.answer, r.abstention, r.evidence_sessions) for r in qa] == [("temporal", "7", False, [1, 2]), ("adversarial", "", True, []), ("single-hop", "unanswerable", True, [])]
    assert qa[0].speakers == ["A", "B"]


def test_carried_facts(spark):
    payload = json.dumps({"mock_facts": [{"predicate": "language", "value": {"to": "fr"}, "confidence": 0.9, "action": "create"}, {"value": {}}]})
    rows = datasets.carried_facts(spark.createDataFrame([(1, payload), (2, "{}"), (3, None), (4, "broken")], "event_id long, payload string")).collect()
    assert [(r.event_id, r.predicate, r.value, r.confidence) for r in rows] == [(1, "language", '{"to":"fr"}', 0.9)]


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_id").filter("user_id < 60")
    end = spark.createDataFrame([(datetime(2030, 1, 1), -1, -1)], events.schema)  # moves the watermark past all others
    drain(capture.sessions(in_steps(spark, tmp_path / "in", events.unionByName(end), 4, ["ts", "event_id"])), "sat")
    want = capture.sessions(events, delay=None)
    got = sorted(map(tuple, spark.table("sat").filter("user_id >= 0").collect()))
    assert got == sorted(map(tuple, want.collect())) and any(r[3] > 1 for r in got)


def test_a_late_event_opens_no_session(spark, tmp_path):
    schema = "ts timestamp, user_id long"
    for i, (day, hour) in enumerate([(1, 0), (9, 0), (1, 3), (8, 20), (20, 0)]):
        spark.createDataFrame([(datetime(2024, 1, day, hour), 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = capture.sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted((r.start, r.end, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(datetime(2024, 1, 1), datetime(2024, 1, 1, 6), 1), (datetime(2024, 1, 8, 20), datetime(2024, 1, 9, 6), 2)]


def test_the_keyed_sink_stores_each_key_once_and_survives_replays(spark, tmp_path):
    schema = "key long, n long"
    for part in ([(1, 0), (1, 1), (2, 0)], [(2, 1), (3, 0)], [(1, 2), (4, 0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = capture.capture_ever(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "key")
        query = stream.writeStream.foreachBatch(capture.batches_to(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.key for r in stored.collect()) == [1, 2, 3, 4]
    again = spark.createDataFrame([(3, 0)], schema)
    number = stored.filter("key = 3").first().batch
    capture.batches_to(str(tmp_path / "out"))(again, number)  # the batch is run again
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4]
