"""Feedback, forgetting, credits, policy, packet status and look-ups on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle
from ..sources.tables import chunks, events, facts, read, twin
from .registry import register

c = F.col
NOW = "2024-03-01 00:00:00"


def now():
    return F.to_timestamp_ntz(F.lit(NOW))


def ledger(spark, sf_dir):
    """Facts with a project, a version and an open recording interval."""
    return facts(spark, sf_dir).select(c("event_id").alias("fact_id"), c("user_id").alias("subject_id"), (c("user_id") % 3).alias("project_id"), "status", F.lit(1).alias("version"), F.lit(None).cast("timestamp_ntz").alias("recorded_to"))


@register("l1_change_status", twin("facts", f""", w AS (SELECT event_id AS fact_id, status, CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'disputed' WHEN 2 THEN 'deleted' END AS target FROM facts),
 j AS (SELECT *, coalesce(status || '>' || target IN ({", ".join(f"'{x}'" for x in lifecycle.ALLOWED)}), false) AS legal FROM w)
 SELECT fact_id, CASE WHEN legal THEN target ELSE status END AS status, CAST(1 + legal::INT AS INTEGER) AS version, CASE WHEN legal AND target = 'deleted' THEN TIMESTAMP '{NOW}' END AS recorded_to,
   CASE WHEN target IS NOT NULL AND NOT legal THEN 'illegal_status_transition' END AS error FROM j"""))
def l1_change_status(spark, sf_dir):
    f = ledger(spark, sf_dir)
    wanted = read(spark, sf_dir, "events").filter("event_id % 4 < 3").select(c("event_id").alias("fact_id"), F.element_at(F.array(F.lit("active"), F.lit("disputed"), F.lit("deleted")), (c("event_id") % 4 + 1).cast("int")).alias("target"))
    return lifecycle.change_status(f, wanted, now()).select("fact_id", "status", "version", "recorded_to", "error")


@register("l3_feedback", twin("facts", """SELECT x.doc_id AS feedback_id, error, CASE WHEN error IS NULL AND x.fact_id IS NOT NULL THEN CASE WHEN rating = 'incorrect' THEN 'disputed' ELSE status END END AS fact_status FROM
 (SELECT d.*, f.status, CASE WHEN rating NOT IN ('useful', 'irrelevant', 'incorrect') THEN 'invalid_rating' WHEN (fact_id IS NULL) = (trace_id IS NULL) THEN 'not_one_target' WHEN fact_id IS NOT NULL AND project_id IS DISTINCT FROM user_id % 3 THEN 'fact_not_found' END AS error
  FROM (SELECT doc_id, doc_id % 2 AS project_id, CASE WHEN doc_id % 5 > 0 THEN doc_id END AS fact_id, CASE WHEN doc_id % 5 < 2 AND doc_id % 10 <> 5 THEN doc_id END AS trace_id, CASE doc_id % 4 WHEN 0 THEN 'useful' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'irrelevant' ELSE 'odd' END AS rating FROM documents) d
  LEFT JOIN facts f ON f.event_id = d.fact_id) x"""))
def l3_feedback(spark, sf_dir):
    d = c("doc_id")
    rating = F.when(d % 4 == 0, "useful").when(d % 4 == 1, "incorrect").when(d % 4 == 2, "irrelevant").otherwise("odd")
    given = read(spark, sf_dir, "documents").select(d.alias("feedback_id"), (d % 2).alias("project_id"), F.when(d % 5 > 0, d).alias("fact_id"), F.when((d % 5 < 2) & (d % 10 != 5), d).alias("trace_id"), rating.alias("rating"))
    return lifecycle.judge_feedback(given, ledger(spark, sf_dir))


@register("l6_disable_subjects", twin("facts", "SELECT event_id AS fact_id, CASE WHEN user_id % 10 = 3 AND status = 'active' THEN 'disabled' ELSE status END AS status, CAST(CASE WHEN user_id % 10 = 3 AND status = 'active' THEN 2 ELSE 1 END AS INTEGER) AS version FROM facts"))
def l6_disable_subjects(spark, sf_dir):
    f = ledger(spark, sf_dir)
    return lifecycle.disable_subjects(f, f.filter("subject_id % 10 = 3"), now()).select("fact_id", "status", "version")


def _erased(spark, sf_dir):
    subject = c("user_id").alias("subject_id")
    traces = read(spark, sf_dir, "orders").select(c("o_custkey").alias("subject_id"), c("o_orderkey").alias("id"))
    sessions = chunks(spark, sf_dir).select(c("conv_id").alias("subject_id"), c("turn").alias("id"))
    e = read(spark, sf_dir, "events")
    gone = e.filter("user_id % 10 = 7").select(subject)
    return lifecycle.erase({"events": e.select(subject, c("event_id").alias("id")), "chunks": sessions, "traces": traces}, gone, "subject_id")


@register("l8_receipts", """SELECT g.user_id AS subject_id, (SELECT count(*) FROM events e WHERE e.user_id = g.user_id) AS events, (SELECT count(*) FROM conversations k WHERE k.conv_id = g.user_id) AS chunks,
 (SELECT count(*) FROM orders o WHERE o.o_custkey = g.user_id) AS traces FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 7) g""")
def l8_receipts(spark, sf_dir):
    return _erased(spark, sf_dir)[1]


@register("l7_forget_delete", """WITH g AS (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 10 = 7) SELECT 'events' AS kind, user_id AS subject_id, event_id AS id FROM events WHERE user_id NOT IN (FROM g)
 UNION ALL SELECT 'chunks', conv_id, turn FROM conversations WHERE conv_id NOT IN (FROM g) UNION ALL SELECT 'traces', o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (FROM g)""")
def l7_forget_delete(spark, sf_dir):
    """What is left of each table."""
    left = [t.select(F.lit(name).alias("kind"), "subject_id", "id") for name, t in _erased(spark, sf_dir)[0].items()]
    return left[0].unionByName(left[1]).unionByName(left[2])


@register("b2_debit", """WITH RECURSIVE r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN event_type = 'purchase' THEN 2 ELSE 0 END AS g FROM events),
 f(user_id, i, event_id, debited, balance_after) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST(0 AS BIGINT) FROM r
   UNION ALL SELECT r.user_id, r.i, r.event_id, f.balance_after + r.g >= 1, greatest(f.balance_after + r.g - 1, 0) FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
 SELECT event_id, debited, balance_after FROM f WHERE i > 0""")
def b2_debit(spark, sf_dir):
    captures = read(spark, sf_dir, "events").withColumn("grant", F.when(c("event_type") == "purchase", 2).otherwise(0))
    return lifecycle.debit_captures(captures, "user_id", ["ts", "event_id"], "grant").select("event_id", "debited", "balance_after")


@register("b3_lazy_grants", """WITH RECURSIVE e AS (SELECT user_id, ts FROM events WHERE user_id % 4 <> 0), g(user_id, t) AS (SELECT user_id, min(ts) FROM e GROUP BY 1
   UNION ALL SELECT g.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = g.user_id AND e.ts >= g.t + INTERVAL 10 DAY) FROM g WHERE g.t IS NOT NULL) SELECT user_id, t AS granted_at FROM g WHERE t IS NOT NULL""")
def b3_lazy_grants(spark, sf_dir):
    """Those without a subscription; ten days instead of thirty, as the table spans a month."""
    return lifecycle.lazy_grants(read(spark, sf_dir, "events").filter("user_id % 4 <> 0"), "user_id", "ts", days=10)


@register("b4_org_uuid", """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21) END AS org FROM (SELECT event_id, md5(user_id || '') AS h FROM events)""")
def b4_org_uuid(spark, sf_dir):
    h = F.md5(c("user_id").cast("string").cast("binary"))
    org = F.when(c("event_id") % 3 == 0, "org_cursor_dev").when(c("event_id") % 3 == 1, F.concat(F.lit("org_"), h)).otherwise(F.concat(F.lit("org_{"), F.upper(h), F.lit("}")))
    return read(spark, sf_dir, "events").select("event_id", lifecycle.org_uuid(org).alias("org"))


@register("q1_policy", """SELECT decision, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 AND o_custkey % 5 <> o_orderkey % 5 THEN 'deny: forbidden_scope' WHEN o_custkey % 11 = 0 THEN 'deny: missing_scope'
 WHEN o_orderstatus = 'O' THEN 'warn: missing_purpose' ELSE 'allow' END AS decision FROM orders) GROUP BY decision""")
def q1_policy(spark, sf_dir):
    """The decision log by outcome."""
    text = lambda x: x.cast("string")
    project = F.when(c("o_orderkey") % 7 != 0, text(c("o_custkey") % 5))
    subject = F.when(c("o_custkey") % 11 == 0, "").otherwise(text(c("o_custkey")))
    decision = lifecycle.judge_scope(project, text(c("o_orderkey") % 5), subject, F.when(c("o_orderstatus") != "O", "support"))
    return read(spark, sf_dir, "orders").groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


@register("r16_packet_status", twin("ev", """, d AS (SELECT user_id, count(*) FILTER (k % 5 = 1) AS n, count(*) FILTER (k % 5 = 0) AS hidden, count(*) FILTER (k % 5 > 1) AS below FROM ev WHERE user_id % 2 = 0 OR k % 5 <> 1 GROUP BY 1),
 w AS (SELECT *, concat_ws(' / ', CASE WHEN n = 0 AND user_id % 3 = 0 THEN 'identity_fragmentation: email alias of ' || (user_id + 1) END, CASE WHEN hidden > 0 THEN 'open_conflict: ' || hidden || ' fact(s) hidden' END,
   CASE WHEN n > 0 THEN 'open_conflict: ' || n || ' fact(s) served with an unresolved value' END) AS warnings FROM d)
 SELECT user_id AS query_id, n AS n_included, warnings, CASE WHEN warnings = '' THEN 'ok' ELSE 'degraded' END AS status, CASE WHEN n = 0 AND below > 0 THEN 'no_relevant_memory' END AS empty_reason FROM w"""))
def r16_packet_status(spark, sf_dir):
    k = c("k") % 5
    e = events(spark, sf_dir).filter("user_id % 2 = 0 or k % 5 <> 1")
    reason = F.when(k == 0, "conflict_open").when(k == 1, "conflict_disputed").when(k > 1, "below_relevance_floor")
    decisions = e.select(c("user_id").alias("query_id"), c("user_id").alias("subject_id"), F.when(k == 1, "included").otherwise("excluded").alias("action"), reason.alias("reason_code"))
    aliases = e.filter("user_id % 3 = 0").select(c("user_id").alias("alias_value"), F.lit("email").alias("alias_kind"), (c("user_id") + 1).alias("canonical_subject_id"))
    return lifecycle.packet_status(decisions, aliases, floor=0.75).select("query_id", "n_included", F.concat_ws(" / ", "warnings").alias("warnings"), "status", "empty_reason")


@register("s9_point_lookup", twin("facts", "SELECT 7 * d.doc_id AS fact_id, f.status, CASE WHEN f.event_id IS NULL THEN 'fact_not_found' END AS error FROM documents d LEFT JOIN facts f ON f.event_id = 7 * d.doc_id AND f.user_id % 3 = d.doc_id % 3"))
def s9_point_lookup(spark, sf_dir):
    requests = read(spark, sf_dir, "documents").select((7 * c("doc_id")).alias("fact_id"), (c("doc_id") % 3).alias("project_id"))
    return lifecycle.look_up(requests, ledger(spark, sf_dir), "fact_id", "project_id", "fact_not_found").select("fact_id", "status", "error")


@register("s18_index_backfill", twin("chunks", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN CASE WHEN conv_id % 4 > 0 THEN text END ELSE role END AS index_text FROM chunks"))
def s18_index_backfill(spark, sf_dir):
    """Chunks that have an embedding but no index text get their own text."""
    c0 = chunks(spark, sf_dir).withColumn("index_text", F.when(c("turn") % 3 != 0, c("role"))).withColumn("embedded", c("conv_id") % 4 > 0)
    return c0.select("conv_id", "turn", F.coalesce("index_text", F.when(c("embedded"), c("text"))).alias("index_text"))


@register("s19_project_wipe", """SELECT p AS project_id, (SELECT count(*) FROM documents d WHERE d.doc_id % 10 = p) AS documents, (SELECT count(*) FROM events e WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = p) AS jobs FROM (VALUES (2), (5)) v(p)""")
def s19_project_wipe(spark, sf_dir):
    """Counts of what a wipe of two projects takes; a job's project lies in its JSON payload."""
    documents = read(spark, sf_dir, "documents").select((c("doc_id") % 10).cast("int").alias("project_id"))
    jobs = read(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("int").alias("project_id"))
    return lifecycle.erase({"documents": documents, "jobs": jobs}, spark.createDataFrame([(2,), (5,)], "project_id int"), "project_id")[1]
