"""Capture, facts over time, consolidation, lifecycle, identity, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import transcripts as T
from ..functions.text import canonical_json
from ..operators import merging
from ..operators.lifecycle import ALLOWED, is_legal
from ..sources.tables import chunks, events, facts, read, twin
from ..streaming.capture import sessions
from .registry import register

c = F.col


@register("s1_dedup_capture", """WITH again AS (SELECT *, 0 AS batch FROM events UNION ALL SELECT *, 1 FROM events WHERE event_id % 7 = 0),
 keyed AS (SELECT *, user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS idempotency_key FROM again)
 SELECT idempotency_key, event_id FROM keyed QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY batch, event_id) = 1""")
def s1_dedup_capture(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    again = e.withColumn("batch", F.lit(0)).unionByName(e.filter("event_id % 7 = 0").withColumn("batch", F.lit(1)))
    key = F.concat_ws("|", c("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    # min_by combines before the shuffle, unlike a window
    return again.withColumn("idempotency_key", key).groupBy("idempotency_key").agg(F.min_by("event_id", F.struct("batch", "event_id")).alias("event_id"))


@register("s2_event_hash", """SELECT event_id, 'sha256:' || sha256('{"kind":"' || event_type || '","occurred_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","subject_id":"' || user_id || '"}') AS hash FROM events""")
def s2_event_hash(spark, sf_dir):
    body = F.to_json(F.struct(c("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("occurred_at"), c("user_id").cast("string").alias("subject_id")))
    return read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("hash"))


@register("s3_default_trust", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'semi_trusted' ELSE 'trusted' END AS origin_trust FROM events")
def s3_default_trust(spark, sf_dir):
    actor = F.when(c("event_type") == "error", "system")
    return read(spark, sf_dir, "events").select("event_id", F.when(actor.isin("agent", "tool", "system"), "semi_trusted").otherwise("trusted").alias("origin_trust"))


@register("s4_bounded_payload", "SELECT doc_id, strlen(text) AS size, strlen(text) > 8192 AS rejected FROM documents")
def s4_bounded_payload(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", size.alias("size"), (size > 8192).alias("rejected"))


@register("s6_timeline", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def s6_timeline(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@register("s7_facts_list", twin("facts", "SELECT event_id, user_id, event_type, value FROM facts WHERE status = 'active' ORDER BY valid_from DESC, event_id DESC LIMIT 200"))
def s7_facts_list(spark, sf_dir):
    return facts(spark, sf_dir).filter("status = 'active'").orderBy(F.desc("valid_from"), F.desc("event_id")).limit(200).select("event_id", "user_id", "event_type", "value")


@register("s8_traces_list", "SELECT o_orderkey AS trace_id, o_custkey AS subject_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def s8_traces_list(spark, sf_dir):
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select(c("o_orderkey").alias("trace_id"), c("o_custkey").alias("subject_id"))


@register("s13_session_events", "SELECT conv_id, 'run:' || (conv_id % 10) || ':' || conv_id AS event_key, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def s13_session_events(spark, sf_dir):
    turn = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    sessions = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return sessions.select("conv_id", F.concat_ws(":", F.lit("run"), (c("conv_id") % 10).cast("string"), c("conv_id").cast("string")).alias("event_key"), F.concat_ws("\n", c("t.line")).alias("transcript"), F.size("t").cast("long").alias("n_turns"))


@register("f_transcripts", """WITH s AS (SELECT conv_id, conv_id % 10 AS subject, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) AS moment FROM conversations GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY conv_id) AS number FROM s)
 SELECT conv_id, number, '--- session ' || conv_id || ' (' || strftime(moment, '%Y-%m-%d %H:%M') || ' UTC) ---' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS plain,
  string_agg(strftime(moment, '%Y-%m-%dT%H:%M:%S') || ' | ' || role || ': ' || text, chr(10) ORDER BY turn) AS dated,
  chr(10) || '### Session ' || number || ':' || chr(10) || 'Session Date: ' || strftime(moment, '%Y-%m-%dT%H:%M:%S') || chr(10) || 'Session Content:' || chr(10) || chr(10) || '[' || string_agg('{"role": ' || to_json(role)::VARCHAR || ', "content": ' || to_json(text)::VARCHAR || '}', ', ' ORDER BY turn) || ']' || chr(10) AS history
 FROM n JOIN conversations USING (conv_id) GROUP BY conv_id, number, moment""")
def f_transcripts(spark, sf_dir):
    """Each session's transcript in three forms; sessions are numbered within their subject."""
    turns = chunks(spark, sf_dir).select("conv_id", "turn", "occurred_at").join(read(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    said = F.array_sort(F.collect_list(F.struct("turn", c("role").alias("speaker"), c("text").alias("content"))))
    sessions = turns.groupBy("conv_id", "occurred_at").agg(said.alias("turns"))  # a session is bounded, a subject is not
    number = read(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.row_number().over(W.partitionBy(c("conv_id") % 10).orderBy("conv_id")).cast("long").alias("number"))
    shown = [T.plain_transcript(c("conv_id").cast("string"), c("occurred_at"), c("turns")).alias("plain"), T.dated_transcript(c("occurred_at"), c("turns")).alias("dated"), T.session_history(c("number"), c("occurred_at"), c("turns")).alias("history")]
    return sessions.join(number, "conv_id").select("conv_id", "number", *shown)


@register("s14_mirrored_projection", twin("chunks", "SELECT s.speaker, c.conv_id, c.turn, CASE WHEN c.role = s.speaker THEN 'user' ELSE 'assistant' END AS as_role FROM chunks c, (VALUES ('user'), ('assistant')) s(speaker)"))
def s14_mirrored_projection(spark, sf_dir):
    return chunks(spark, sf_dir).withColumn("speaker", F.explode(F.array(F.lit("user"), F.lit("assistant")))).select("speaker", "conv_id", "turn", F.when(c("role") == c("speaker"), "user").otherwise("assistant").alias("as_role"))


@register("s17_unchunked_antijoin", "SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 3 <> 0)")
def s17_unchunked_antijoin(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return turns.join(turns.filter("conv_id % 3 <> 0").withColumnRenamed("conv_id", "done"), c("conv_id") == c("done"), "left_anti")


@register("p2_as_of_valid", twin("facts", "SELECT event_id, user_id, event_type, value FROM facts WHERE valid_from <= TIMESTAMP '2024-01-15 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 00:00:00')"))
def p2_as_of_valid(spark, sf_dir):
    at = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    return facts(spark, sf_dir).filter((c("valid_from") <= at) & (c("valid_to").isNull() | (c("valid_to") > at))).select("event_id", "user_id", "event_type", "value")


@register("p7_identity_qualifiers", twin("ev", "SELECT user_id, event_type, k % 3 AS bucket, count(*) AS n, max(ts) AS last FROM ev GROUP BY ALL"))
def p7_identity_qualifiers(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", "event_type", (c("k") % 3).alias("bucket")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@register("p8_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def p8_json_path(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@register("p9_row_compare", twin("chunks", "SELECT conv_id, turn FROM chunks WHERE (occurred_at, turn) < (TIMESTAMP '2024-01-03 00:00:00', 2)"))
def p9_row_compare(spark, sf_dir):
    return chunks(spark, sf_dir).filter(F.struct("occurred_at", "turn") < F.struct(F.to_timestamp_ntz(F.lit("2024-01-03 00:00:00")).alias("occurred_at"), F.lit(2).cast("long").alias("turn"))).select("conv_id", "turn")


@register("f_canonical_json", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events")
def f_canonical_json(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", canonical_json(c("props")).alias("canonical"))


@register("w1_active_dedup", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) > 1 THEN 'superseded' ELSE 'active' END AS status FROM events")
def w1_active_dedup(spark, sf_dir):
    w = W.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, sf_dir, "events").select("event_id", F.when(F.row_number().over(w) > 1, "superseded").otherwise("active").alias("status"))


@register("w2_active_dedup_qualifiers", twin("ev", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type, k % 3 ORDER BY ts DESC, event_id DESC) > 1 THEN 'superseded' ELSE 'active' END AS status FROM ev"))
def w2_active_dedup_qualifiers(spark, sf_dir):
    w = W.partitionBy("user_id", "event_type", c("k") % 3).orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, sf_dir).select("event_id", F.when(F.row_number().over(w) > 1, "superseded").otherwise("active").alias("status"))


@register("w5_scd2", twin("facts", "SELECT event_id, user_id, event_type, value, valid_from, valid_to, supersedes_id, status FROM facts"))
def w5_scd2(spark, sf_dir):
    return facts(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "valid_from", "valid_to", "supersedes_id", "status")


def c7_duplicates_of(e: DataFrame) -> DataFrame:
    """Events that state a value again that their identity already has, with the first to state it."""
    first = e.groupBy("user_id", "event_type", "k").agg(F.min("event_id").alias("first_id"))
    return e.join(first, ["user_id", "event_type", "k"]).filter("event_id > first_id")


@register("c7_duplicates", twin("ev", "SELECT event_id, first_id FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type, k) AS first_id FROM ev) WHERE event_id > first_id"))
def c7_duplicates(spark, sf_dir):
    return c7_duplicates_of(events(spark, sf_dir)).select("event_id", "first_id")


@register("c9_ambiguous_qualifiers", twin("ev", """SELECT user_id, event_type, count(*) FILTER (k % 3 = 0) AS bare, count(*) FILTER (k % 3 <> 0) AS qualified FROM ev GROUP BY ALL
 HAVING count(*) FILTER (k % 3 = 0) > 0 AND count(*) FILTER (k % 3 <> 0) > 0"""))
def c9_ambiguous_qualifiers(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count_if(c("k") % 3 == 0).alias("bare"), F.count_if(c("k") % 3 != 0).alias("qualified")).filter("bare > 0 and qualified > 0")


@register("c10_reinforce", twin("ev", "SELECT user_id, event_type, k, count(*) - 1 AS reinforcement_count, max(ts) AS last_reinforced_at FROM ev GROUP BY ALL"))
def c10_reinforce(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", "event_type", "k").agg((F.count("*") - 1).alias("reinforcement_count"), F.max("ts").alias("last_reinforced_at"))


@register("c15_quarantine", twin("ev", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'candidate' ELSE 'active' END AS status, CASE WHEN event_type = 'error' THEN 'quarantine' END AS set_kind FROM ev"))
def c15_quarantine(spark, sf_dir):
    trust = F.when(c("event_type") == "error", 0).otherwise(3)  # ranks of untrusted and trusted
    return events(spark, sf_dir).select("event_id", F.when(trust == 0, "candidate").otherwise("active").alias("status"), F.when(trust == 0, "quarantine").alias("set_kind"))


@register("c16_supersede", twin("facts", "SELECT f.event_id AS winner, o.event_id AS loser, o.valid_to, round(f.value - o.value, 6) AS change FROM facts f JOIN facts o ON f.supersedes_id = o.event_id"))
def c16_supersede(spark, sf_dir):
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    pairs = events(spark, sf_dir).select(c("event_id").alias("winner"), F.lag("event_id").over(w).alias("loser"), c("ts").alias("valid_to"), F.round(c("value") - F.lag("value").over(w), 6).alias("change"))
    return pairs.filter("loser is not null")


CONFLICT = """SELECT user_id, event_type, k % 3 AS bucket, count(DISTINCT k) AS n_values,
 CASE WHEN count(DISTINCT k) = 1 THEN 'active' WHEN count(DISTINCT k) = 2 THEN 'conflict' ELSE 'reclassified_event' END AS outcome FROM ev GROUP BY ALL"""


def conflict_outcomes(e: DataFrame) -> DataFrame:
    """Of each identity: one value is active, two contradict each other, a third makes all of them events."""
    n = F.count_distinct("k")
    return e.groupBy("user_id", "event_type", (c("k") % 3).alias("bucket")).agg(n.alias("n_values"), F.when(n == 1, "active").when(n == 2, "conflict").otherwise("reclassified_event").alias("outcome"))


@register("c18_conflicts", twin("ev", f"SELECT * FROM ({CONFLICT}) WHERE outcome = 'conflict'"))
def c18_conflicts(spark, sf_dir):
    return conflict_outcomes(events(spark, sf_dir)).filter("outcome = 'conflict'")


@register("c19_reclassify", twin("ev", CONFLICT))
def c19_reclassify(spark, sf_dir):
    return conflict_outcomes(events(spark, sf_dir))


@register("c24_consolidate", twin("ev", """, v AS (SELECT user_id, event_type, event_id, ts, coalesce(k, -1) AS k, lag(event_id) OVER w AS before, lag(coalesce(k, -1)) OVER w AS last_k FROM ev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
 r AS (SELECT *, CASE WHEN before IS NULL THEN 'create' WHEN k = last_k THEN 'reinforce' ELSE 'supersede' END AS decision FROM v),
 a AS (SELECT *, last_value(CASE WHEN decision <> 'reinforce' THEN event_id END IGNORE NULLS) OVER w AS active_id FROM r WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT user_id, event_type, event_id, decision, active_id, CASE WHEN decision = 'supersede' THEN lag(active_id) OVER w END AS supersedes_id,
   row_number() OVER (PARTITION BY user_id, event_type, active_id ORDER BY ts, event_id) - 1 AS reinforced FROM a WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)"""))
def c24_consolidate(spark, sf_dir):
    """What each event does to its identity's fact; the stream in ``streaming.capture`` decides alike."""
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = events(spark, sf_dir).withColumn("k", F.coalesce("k", F.lit(-1)))
    decision = F.when(F.lag("event_id").over(w).isNull(), "create").when(c("k") == F.lag("k").over(w), "reinforce").otherwise("supersede")
    a = e.withColumn("decision", decision).withColumn("active_id", F.last(F.when(c("decision") != "reinforce", c("event_id")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    before = F.when(c("decision") == "supersede", F.lag("active_id").over(w))
    # An active fact's rows lie in a row, so their number is the difference of two counts over the same window.
    start = F.last(F.when(c("decision") != "reinforce", c("place")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return a.withColumn("place", F.row_number().over(w).cast("long")).select("user_id", "event_type", "event_id", "decision", "active_id", before.alias("supersedes_id"), (c("place") - start).alias("reinforced"))


@register("c22_key_merge",twin("chunks", "SELECT conv_id, min(text) || ' FACTS: ' || string_agg(role, '; ' ORDER BY turn, role) AS index_text FROM chunks GROUP BY conv_id"))
def c22_key_merge(spark, sf_dir):
    merged = chunks(spark, sf_dir).groupBy("conv_id").agg(F.min("text").alias("head"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return merged.select("conv_id", F.concat("head", F.lit(" FACTS: "), F.concat_ws("; ", c("t.role"))).alias("index_text"))


@register("l1_transitions", twin("facts", "SELECT event_id, status, target, status || '>' || target IN (" + ", ".join(f"'{x}'" for x in ALLOWED) + ") AS legal FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'superseded' WHEN 2 THEN 'disputed' ELSE 'deleted' END AS target FROM facts)"))
def l1_transitions(spark, sf_dir):
    target = F.element_at(F.array(*map(F.lit, ("active", "superseded", "disputed", "deleted"))), (c("event_id") % 4 + 1).cast("int"))
    return facts(spark, sf_dir).withColumn("target", target).select("event_id", "status", "target", is_legal(c("status"), c("target")).alias("legal"))


@register("l4_resolve", twin("ev", "SELECT event_id, keep, CASE WHEN event_id = keep THEN 'active' ELSE 'superseded' END AS status FROM (SELECT event_id, max(event_id) OVER (PARTITION BY user_id, event_type, k % 3) AS keep FROM ev)"))
def l4_resolve(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", (c("k") % 3).alias("b"))
    keep = e.groupBy("user_id", "event_type", "b").agg(F.max("event_id").alias("keep"))
    return e.join(keep, ["user_id", "event_type", "b"]).select("event_id", "keep", F.when(c("event_id") == c("keep"), "active").otherwise("superseded").alias("status"))


@register("l7_forget", twin("facts", "SELECT (SELECT count(*) FROM events WHERE user_id = 7) AS events, (SELECT count(*) FROM facts WHERE user_id = 7) AS facts, (SELECT count(*) FROM facts WHERE user_id <> 7) AS kept"))
def l7_forget(spark, sf_dir):
    own = c("user_id") == 7
    return facts(spark, sf_dir).agg(F.count_if(own).alias("events"), F.count_if(own).alias("facts"), F.count_if(~own).alias("kept"))


#: Requests to merge: a subject into the one before it, up to the next tenth; those of every seventh ten also go round in a circle.
MERGES = """req AS (SELECT DISTINCT user_id AS source, user_id - 1 AS target FROM events WHERE user_id % 10 BETWEEN 1 AND 6 UNION SELECT DISTINCT user_id, user_id + 1 FROM events WHERE user_id % 70 = 0),
 walk(source, place, steps) AS (SELECT source, target, 1 FROM req UNION ALL SELECT w.source, r.target, steps + 1 FROM walk w JOIN req r ON r.source = w.place WHERE steps < 12),
 ends AS (SELECT source, max_by(place, steps) AS target FROM walk GROUP BY source HAVING max(steps) < 12)"""


def merges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The requests as judged, and where each merged subject ends."""
    user = c("user_id").cast("string")
    ids = read(spark, sf_dir, "events").select("user_id").distinct()
    before = ids.filter((c("user_id") % 10).between(1, 6)).select(user.alias("source"), (c("user_id") - 1).cast("string").alias("target"))
    circle = ids.filter(c("user_id") % 70 == 0).select(user.alias("source"), (c("user_id") + 1).cast("string").alias("target"))
    pairs = before.unionByName(circle).withColumn("project_id", F.lit("p"))
    return merging.plan_merges(pairs, spark.createDataFrame([], "project_id string, alias_kind string, alias_value string, canonical_subject_id string"))


@register("i1_alias_resolve", f"WITH RECURSIVE {MERGES} SELECT event_id, coalesce(target, user_id) AS canonical FROM events LEFT JOIN ends ON source = user_id")
def i1_alias_resolve(spark, sf_dir):
    """Every event's subject after all merges: chains are followed to their end, circles are refused."""
    rows = read(spark, sf_dir, "events").select("event_id", F.lit("p").alias("project_id"), c("user_id").cast("string").alias("subject_id"))
    return merging.moved(rows, merges(spark, sf_dir)[1]).select("event_id", c("subject_id").cast("long").alias("canonical"))


@register("i2_merge", f"""WITH RECURSIVE {MERGES}, n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
 SELECT r.source, CASE WHEN e.source IS NULL THEN 'circular_merge' END AS error, e.target AS ends_at, CASE WHEN e.source IS NOT NULL THEN n.n END AS events_moved FROM req r LEFT JOIN ends e USING (source) LEFT JOIN n ON n.user_id = r.source""")
def i2_merge(spark, sf_dir):
    """Every merge request with its error, or where its subject ends and how many events go along."""
    judged, ends = merges(spark, sf_dir)
    rows = read(spark, sf_dir, "events").select(F.lit("p").alias("project_id"), c("user_id").cast("string").alias("subject_id"))
    names = spark.createDataFrame([], "project_id string, canonical_subject_id string")
    done = merging.receipts(ends, {"events": rows}, names).select("source", c("target").cast("long").alias("ends_at"), "events_moved")
    return judged.select("source", "error").join(done, "source", "left").select(c("source").cast("long").alias("source"), "error", "ends_at", "events_moved")


@register("w_sessions", """WITH e AS (SELECT user_id, ts, ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
 SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s.n""")
def w_sessions(spark, sf_dir):
    """Each subject's sessions, as the stream has them."""
    return sessions(read(spark, sf_dir, "events"), delay=None)


@register("g1_graph", twin("facts", "SELECT 'has_fact' AS kind, 's' || user_id AS a, 'f' || event_id AS b FROM facts UNION ALL SELECT 'supersedes', 'f' || event_id, 'f' || supersedes_id FROM facts WHERE supersedes_id IS NOT NULL UNION ALL SELECT 'derived_from', 'f' || event_id, 'e' || event_id FROM facts"))
def g1_graph(spark, sf_dir):
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    s, f, e = F.concat(F.lit("s"), "user_id"), F.concat(F.lit("f"), "event_id"), F.concat(F.lit("e"), "event_id")
    return facts(spark, sf_dir).select(F.explode(F.array(edge("has_fact", s, f), edge("supersedes", f, F.concat(F.lit("f"), "supersedes_id")), edge("derived_from", f, e))).alias("x")).select("x.*").filter("b is not null")


@register("j8_supersedes_edges", twin("facts", "SELECT event_id AS source, supersedes_id AS target FROM facts WHERE supersedes_id IS NOT NULL"))
def j8_supersedes_edges(spark, sf_dir):
    return facts(spark, sf_dir).filter("supersedes_id is not null").select(c("event_id").alias("source"), c("supersedes_id").alias("target"))


@register("b2_running_balance", twin("ev", "SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN k ELSE -1 END AS delta, CAST(sum(CASE WHEN event_type = 'purchase' THEN k ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS balance_after FROM ev"))
def b2_running_balance(spark, sf_dir):
    delta = F.when(c("event_type") == "purchase", c("k")).otherwise(F.lit(-1)).cast("long")
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return events(spark, sf_dir).withColumn("delta", delta).select("event_id", "user_id", "delta", F.sum("delta").over(w).alias("balance_after"))
