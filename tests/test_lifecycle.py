"""Lifecycle operators on small tables, pinned inputs and reports."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import lifecycle
from ledgerlens.sources import reports


def test_feedback_in_order(spark):
    facts = spark.createDataFrame([(1, "p", "active"), (2, "p", "deleted")], "fact_id long, project_id string, status string")
    rows = [(1, "p", 1, None, "useful"), (2, "p", 1, None, "incorrect"), (3, "p", 1, None, "useful"), (4, "q", 1, None, "incorrect"), (5, "p", 2, None, "incorrect"), (6, "p", 1, 9, "useful"), (7, "p", None, 9, "useful"), (8, "p", None, 9, None)]
    out = lifecycle.judge_feedback(spark.createDataFrame(rows, "feedback_id long, project_id string, fact_id long, trace_id long, rating string"), facts)
    assert {r.feedback_id: (r.error, r.fact_status) for r in out.collect()} == {1: (None, "active"), 2: (None, "disputed"), 3: (None, "disputed"), 4: ("fact_not_found", None), 5: (None, "deleted"), 6: ("not_one_target", None), 7: (None, None), 8: ("invalid_rating", None)}


def test_org_ids(spark):
    ids = ["org_12345678-1234-1234-1234-1234567890AB", "org_{12345678123412341234123456789012}", "org_cursor_dev", "12345678123412341234123456789012", None]
    out = spark.createDataFrame([(x,) for x in ids], "o string").select(lifecycle.org_uuid(F.col("o")).alias("u")).collect()
    assert [r.u for r in out] == ["12345678-1234-1234-1234-1234567890ab", "12345678-1234-1234-1234-123456789012", None, None, None]


def test_erase_of_nothing_and_of_the_unknown(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "s long, x string")
    left, receipts = lifecycle.erase({"t": t}, spark.createDataFrame([(1,), (9,), (1,)], "s long"), "s")
    assert left["t"].collect() == [(2, "c")] and sorted(receipts.collect()) == [(1, 2), (9, 0)]
    assert lifecycle.erase({"t": t}, spark.createDataFrame([], "s long"), "s")[0]["t"].count() == 3


def test_pinned_file(spark, tmp_path):
    (tmp_path / "d.json").write_bytes(b"{}")
    assert reports.verified(spark, str(tmp_path / "d.json"), hashlib.sha256(b"{}").hexdigest())
    with pytest.raises(ValueError, match="sha256"):
        reports.verified(spark, str(tmp_path / "d.json"), "0" * 64)


def test_shards_merge_or_are_refused(spark, tmp_path):
    def shard(name, seed, *qids):
        body = {"dataset": "d", "config": {"dataset": {"sha256": "x"}, "selection": {"subset": 4, "seed": seed, "types": ["b", "a"]}}, "questions": [{"qid": q, "qtype": "t"} for q in qids]}
        (tmp_path / name).write_text(json.dumps(body, indent=1))
        return str(tmp_path / name)

    a, b = shard("a.json", 42, "1", "2"), shard("b.json", 42, "3")
    merged = reports.merged_shards(spark, [a, b])
    assert sorted(r.qid for r in merged.collect()) == ["1", "2", "3"]
    with pytest.raises(ValueError, match="samples"):
        reports.merged_shards(spark, [a, shard("c.json", 7, "9")])
    with pytest.raises(ValueError, match="more than one"):
        reports.merged_shards(spark, [a, shard("d.json", 42, "2")])
    reports.write_report(merged, merged.groupBy("qtype").count(), str(tmp_path / "out"), "Run")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out/summary"), wholetext=True).collect())
    assert text.splitlines() == ["# Run", "", "| qtype | count |", "| - | - |", "| t | 3 |"] and spark.read.json(str(tmp_path / "out/records")).count() == 3
