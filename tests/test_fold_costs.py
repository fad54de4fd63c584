"""The fold costs the same for each candidate and hands on only what is asked for."""

import time
from datetime import datetime

import pyarrow as pa

from ledgerlens.operators import consolidation as K
from ledgerlens.plans import rules

SF = "/root/testdata/sf0.001"
BASE = {"project_id": "p", "subject_id": "u", "ordinal": 0, "origin_trust": "trusted", "actor_id": None, "predicate": "x", "qualifiers": {}, "confidence": 0.9, "action": "create", "supersedes_predicate": None, "evidence_span": None, "fact_kind": None, "volatility": None, "memory_form": None, "temporal_range": None}


def test_values_that_keep_coming_back_take_linear_time():
    own, start = K.Identity(), time.perf_counter()
    for i in range(30_000):
        own.apply(BASE | {"value": {"v": i % 2}, "event_id": str(i), "occurred_at": f"{i:09d}", "action": "supersede"})
    assert time.perf_counter() - start < 8
    assert len(own.facts) == 30_000 and [f["status"] for f in own.facts[-2:]] == ["superseded", "active"]


def test_an_active_state_is_found_before_older_ones_and_no_event_is():
    own = K.Identity()
    told = [own.apply(BASE | {"value": {"v": v}, "event_id": str(i), "occurred_at": str(i), "action": action}) for i, (v, action) in enumerate([(0, "create"), (1, "supersede"), (0, "create"), (0, "create"), (1, "create"), (2, "create"), (3, "create"), (2, "create")])]
    assert [outcome for outcome, _ in told] == ["created", "superseded", "superseded", "reinforced", "superseded", "conflict", "reclassified_event", "created"]
    assert told[3][1] == told[2][1] and not any(key[0] == "said" and places for key, places in own.live.items())


def test_only_the_rows_asked_for_leave_the_fold(spark):
    for kind in K.KINDS[:2] + K.KINDS[3:]:
        assert [r.kind for r in rules.folded(spark, SF, kind).select("kind").distinct().collect()] == [kind]
    assert "from_json" not in rules.c24_state_machine(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_moments_are_the_same_text_from_arrow_and_pandas():
    moments = [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 7, 2, 3, 4, 5, 60), None]
    for zone in (None, "UTC", "America/New_York"):
        column = pa.array(moments, pa.timestamp("us")) if zone is None else pa.array(moments, pa.timestamp("us", zone))
        batch = pa.RecordBatch.from_arrays([column, pa.array([1, None, 3], pa.int32()), pa.array(["a", None, ""])], ["occurred_at", "n", "s"])
        pandas = column.to_pandas()
        local = pandas if zone is None else pandas.dt.tz_localize(None)
        rows = list(K.plain_rows(batch))
        assert rows == [K.plain({"occurred_at": at, "n": n, "s": s}) for at, n, s in zip(local, [1, None, 3], ["a", None, ""])]
