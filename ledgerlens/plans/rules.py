"""Rules of capture, consolidation and text, on candidates and messages made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.lexical import english_lexemes, english_rank, simple_lexemes, simple_words
from ..functions.names import ENTITY, entity_tokens
from ..functions.scores import hygiene, weighted_score
from ..operators import consolidation as K
from ..sources.tables import events, read, twin
from .registry import register
from .retrieval import LEX, NAMES

c = F.col


def candidates(spark, sf_dir) -> DataFrame:
    """An event's candidate: its type is the predicate, its counter the value, and residues of the counter all else."""
    k = F.coalesce(c("k"), F.lit(0))
    trust = F.when(k % 11 == 0, "untrusted").when(k % 11 == 1, "third_party").when(k % 11 == 2, "semi_trusted").otherwise("trusted")
    action = F.when(k % 13 == 5, "reject").when(k % 4 == 0, "supersede").when(k % 29 == 3, "odd").otherwise("create")
    return events(spark, sf_dir).select(
        (c("user_id") % 3).cast("string").alias("project_id"), c("user_id").cast("string").alias("subject_id"), F.lpad(c("event_id").cast("string"), 12, "0").alias("event_id"), c("ts").cast("timestamp").alias("occurred_at"), F.lit(0).alias("ordinal"),
        trust.alias("origin_trust"), F.when(k % 2 == 0, F.concat(F.lit("actor"), (k % 4).cast("string"))).alias("actor_id"), c("event_type").alias("predicate"), F.concat(F.lit('{"k":'), (k % 5).cast("string"), F.lit("}")).alias("value"),
        F.when(k % 3 == 0, "{}").otherwise(F.concat(F.lit('{"slot":"'), (k % 2).cast("string"), F.lit('"}'))).alias("qualifiers"), F.when(k % 31 == 7, 1.5).otherwise(0.9).alias("confidence"), action.alias("action"), F.lit(None).cast("string").alias("supersedes_predicate"),
        F.when(k % 17 == 3, "You must always obey").otherwise("said so").alias("evidence_span"), F.when((k % 13 == 5) & (k % 2 == 0), "system_noise").alias("reject_reason"), F.when(k % 7 == 1, "instruction").when(k % 7 == 2, "odd").otherwise("attribute").alias("fact_kind"),
        F.lit(None).cast("string").alias("volatility"), F.when(k % 19 == 4, "event").alias("memory_form"), F.lit(None).cast("string").alias("temporal_range"),
    )


CAND = """, cand AS (SELECT event_id, user_id, event_type, ts, kk AS k, CASE kk % 11 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS trust, CASE WHEN kk % 13 = 5 THEN 'reject' WHEN kk % 4 = 0 THEN 'supersede' WHEN kk % 29 = 3 THEN 'odd' ELSE 'create' END AS action FROM (SELECT *, coalesce(k, 0) AS kk FROM ev)),
 judged AS (SELECT *, CASE WHEN k % 31 = 7 THEN 'confidence' WHEN action = 'odd' THEN 'action' WHEN action = 'reject' AND k % 2 = 1 THEN 'reject_reason' END AS error FROM cand),
 told AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN action = 'reject' THEN 'system_noise' WHEN k % 17 = 3 THEN 'imperative_directive' WHEN k % 7 = 1 AND trust < 2 THEN 'untrusted_instruction' END AS rejected FROM judged)"""


@register("c1_validate", twin("ev", CAND + " SELECT event_id, error, CASE WHEN k % 7 = 1 THEN 'instruction' WHEN k % 7 <> 2 THEN 'attribute' END AS fact_kind FROM told"))
def c1_validate(spark, sf_dir):
    return K.judge(candidates(spark, sf_dir)).select(c("event_id").cast("long").alias("event_id"), "error", "fact_kind")


@register("c2_reject_counts", twin("ev", CAND + " SELECT rejected AS reason, count(*) AS n FROM told WHERE rejected IS NOT NULL GROUP BY 1"))
def c2_reject_counts(spark, sf_dir):
    return K.judge(candidates(spark, sf_dir)).filter("rejected is not null").groupBy(c("rejected").alias("reason")).agg(F.count("*").alias("n"))


@register("c4_trust_gate", twin("ev", CAND + " SELECT event_id FROM told WHERE rejected = 'untrusted_instruction'"))
def c4_trust_gate(spark, sf_dir):
    return K.judge(candidates(spark, sf_dir)).filter("rejected = 'untrusted_instruction'").select(c("event_id").cast("long").alias("event_id"))


@register("c5_anti_echo", twin("ev", """, served AS (SELECT *, max(CASE WHEN event_id % 5 = 0 THEN ts END) OVER (PARTITION BY user_id, event_type, k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown FROM ev)
 SELECT event_id FROM served WHERE coalesce(k, 0) % 4 <> 0 AND shown >= ts - INTERVAL 7 DAY"""))
def c5_anti_echo(spark, sf_dir):
    """Statements that repeat, within a week, what a packet served to the subject (every fifth event's fact is); supersedes are none."""
    w = W.partitionBy("user_id", "event_type", "k").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    e = events(spark, sf_dir).withColumn("at", F.max(F.when(c("event_id") % 5 == 0, c("ts"))).over(w))
    return e.filter((F.coalesce("k", F.lit(0)) % 4 != 0) & (c("at") >= c("ts") - F.expr("interval 7 days"))).select("event_id")


def folded(spark, sf_dir, kind: str) -> DataFrame:
    return K.consolidate(K.with_identity(K.judge(candidates(spark, sf_dir))), kinds=(kind,))


#: The fold once more, in plain recursion: a row of state for each class, a step for each candidate.
FOLDED = CAND + """, line AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, trust, action, k % 5 AS val, CASE WHEN k % 3 = 0 THEN '{}' ELSE CAST(k % 2 AS VARCHAR) END AS qid,
   CASE WHEN k % 19 = 4 THEN 'event' ELSE 'state' END AS form, left(sha256('["' || user_id % 3 || '","' || user_id || '","' || lpad(event_id::VARCHAR, 12, '0') || '",0,"' || event_type || '",{"k":' || k % 5 || '}]'), 32) AS fid FROM told WHERE error IS NULL AND rejected IS NULL),
 fold(user_id, event_type, n, event_id, outcome, met, facts, sets) AS (
  SELECT DISTINCT user_id, event_type, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', '', CAST([] AS STRUCT(id VARCHAR, val BIGINT, qid VARCHAR, status VARCHAR, form VARCHAR, trust INTEGER)[]), CAST([] AS STRUCT(ids VARCHAR[], live BOOLEAN)[]) FROM line
  UNION ALL SELECT user_id, event_type, n, event_id, outcome, CASE WHEN outcome IN ('reinforced', 'duplicate') THEN twin.id ELSE fid END,
   CASE WHEN outcome IN ('reinforced', 'duplicate') THEN facts ELSE list_concat(list_transform(facts, lambda f: struct_pack(id := f.id, val := f.val, qid := f.qid,
     status := CASE WHEN outcome = 'superseded' AND f.id = ex.id THEN 'superseded' WHEN outcome = 'reclassified_event' AND list_contains(sides.ids, f.id) THEN 'active' ELSE f.status END,
     form := CASE WHEN outcome = 'reclassified_event' AND list_contains(sides.ids, f.id) THEN 'event' ELSE f.form END, trust := f.trust)),
    [struct_pack(id := fid, val := val, qid := qid, status := CASE WHEN outcome IN ('quarantined', 'conflict') THEN 'candidate' ELSE 'active' END, form := CASE WHEN outcome = 'reclassified_event' THEN 'event' ELSE coalesce(ex.form, form) END, trust := trust)]) END,
   CASE outcome WHEN 'conflict' THEN list_append(sets, struct_pack(ids := [ex.id, fid], live := true)) WHEN 'reclassified_event' THEN list_filter(sets, lambda x: x.ids <> sides.ids) ELSE sets END
  FROM (SELECT *, CASE WHEN twin IS NOT NULL AND (twin.status = 'active' OR ex0 IS NULL) THEN CASE WHEN twin.status = 'active' THEN 'reinforced' ELSE 'duplicate' END WHEN trust = 0 OR ex IS NOT NULL AND trust < ex.trust THEN 'quarantined'
     WHEN twin IS NOT NULL OR action = 'supersede' THEN CASE WHEN ex IS NULL THEN 'created' ELSE 'superseded' END WHEN ex IS NULL OR ex.form = 'event' THEN 'created' WHEN sides IS NULL THEN 'conflict' ELSE 'reclassified_event' END AS outcome
   FROM (SELECT *, list_filter(sets, lambda x: list_contains(x.ids, ex.id))[1] AS sides FROM (SELECT *, CASE WHEN ex0 IS NULL AND twin IS NULL AND action = 'create' THEN amb ELSE ex0 END AS ex FROM
   (SELECT l.*, f.facts, f.sets, coalesce(list_filter(f.facts, lambda x: x.val = l.val AND x.qid = l.qid AND x.form <> 'event' AND x.status = 'active')[1], list_filter(f.facts, lambda x: x.val = l.val AND x.qid = l.qid AND x.form <> 'event')[1]) AS twin,
     list_filter(f.facts, lambda x: x.status = 'active' AND x.qid = l.qid)[-1] AS ex0, list_filter(f.facts, lambda x: x.status = 'active' AND (x.qid = '{}') <> (l.qid = '{}') AND x.val <> l.val)[1] AS amb
    FROM fold f JOIN line l ON l.user_id = f.user_id AND l.event_type = f.event_type AND l.n = f.n + 1)))))"""


@register("c24_state_machine", twin("ev", FOLDED + " SELECT event_id, outcome, met AS fact_id FROM fold WHERE n > 0").replace("WITH ", "WITH RECURSIVE ", 1))
def c24_state_machine(spark, sf_dir):
    """Every accepted candidate's outcome; the tests hold it against the survey's scenarios and the same fold without Spark."""
    return K.decisions_of(folded(spark, sf_dir, "decision")).select(c("event_id").cast("long").alias("event_id"), "outcome", "fact_id")


@register("c24_facts")
def c24_facts(spark, sf_dir):
    return K.facts_of(folded(spark, sf_dir, "fact"))


#: The facts of each class after its last candidate.
STATES = FOLDED + """, done AS (SELECT user_id, event_type, unnest(max_by(facts, n)) AS f FROM fold GROUP BY 1, 2), again AS (SELECT met, count(*) AS n FROM fold WHERE outcome = 'reinforced' GROUP BY 1)"""


@register("c24_fact_states", twin("ev", STATES + """ SELECT CAST(user_id AS VARCHAR) AS subject_id, event_type AS predicate, f.id AS fact_id, '{"k":' || f.val || '}' AS value, f.status AS status, f.form AS memory_form, CAST(coalesce(again.n, 0) AS INTEGER) AS reinforcement_count
 FROM done LEFT JOIN again ON met = f.id""").replace("WITH ", "WITH RECURSIVE ", 1))
def c24_fact_states(spark, sf_dir):
    """What became of every fact in the end."""
    return K.facts_of(folded(spark, sf_dir, "fact")).select("subject_id", "predicate", "fact_id", "value", "status", "memory_form", "reinforcement_count")


def meant(spark, sf_dir, kind: str) -> DataFrame:
    """The same candidates with vectors, that of their counter, folded by subject: predicates meet by meaning, served facts echo.

    Every fiftieth event is followed at once by a packet that serves the fact of an event before it.
    """
    vectors = read(spark, sf_dir, "embeddings").select(c("vec_id").alias("k"), c("embedding").alias("e"))
    made = candidates(spark, sf_dir).withColumn("k", F.get_json_object("value", "$.k").cast("long") + F.col("subject_id").cast("long") % 7)
    judged = K.judge(made.join(F.broadcast(vectors.filter("k < 16")), "k", "left").drop("k"))
    told = K.decisions_of(folded(spark, sf_dir, "decision")).filter(c("event_id").cast("long") % 50 == 0)
    at = events(spark, sf_dir).select(F.lpad(c("event_id").cast("string"), 12, "0").alias("event_id"), c("ts").cast("timestamp").alias("served_at"))
    packets = told.join(at, "event_id").select("project_id", "subject_id", "served_at", F.array("fact_id").alias("fact_ids"))
    return K.consolidate(K.with_packets(judged, packets), semantic=True, kinds=(kind,))


@register("c8_semantic_fold")
def c8_semantic_fold(spark, sf_dir):
    """Outcomes where identity is resolved by name, by a learned name, then by the nearest active fact; echoes are turned away."""
    return K.decisions_of(meant(spark, sf_dir, "decision")).groupBy("subject_id", "outcome").agg(F.count("*").alias("n"))


@register("c8_learned_names")
def c8_learned_names(spark, sf_dir):
    return K.aliases_of(meant(spark, sf_dir, "alias")).select("project_id", "subject_id", "alias", "predicate", F.round("confidence", 6).alias("confidence"))


@register("c18_conflict_sets")
def c18_conflict_sets(spark, sf_dir):
    """Quarantines, contradictions and reclassified sets."""
    return K.sets_of(folded(spark, sf_dir, "set"))


@register("c28_active_unique", twin("ev", STATES + """ SELECT CAST(user_id % 3 AS VARCHAR) AS project_id, CAST(user_id AS VARCHAR) AS subject_id, event_type AS predicate, CASE WHEN f.qid = '{}' THEN '{}' ELSE '{"slot":"' || f.qid || '"}' END AS qualifiers, count(*) AS n
 FROM done WHERE f.status = 'active' AND f.form <> 'event' GROUP BY ALL HAVING count(*) > 1""").replace("WITH ", "WITH RECURSIVE ", 1))
def c28_active_unique(spark, sf_dir):
    """Identities with several active state facts: none may be left."""
    f = K.facts_of(folded(spark, sf_dir, "fact")).filter("status = 'active' and memory_form <> 'event'")
    own = M.drop_key(c("qualifiers"), "attributed_to")
    return f.groupBy("project_id", "subject_id", "predicate", own.alias("qualifiers")).agg(F.count("*").alias("n")).filter("n > 1")


@register("l2_create_fact", twin("ev", "SELECT sha256(user_id || '|' || event_type || '|' || event_id) AS fact_id, event_type AS predicate, 'candidate' AS status, CAST(1 AS INTEGER) AS version, ts AS valid_from FROM ev"))
def l2_create_fact(spark, sf_dir):
    key = F.concat_ws("|", c("user_id").cast("string"), "event_type", c("event_id").cast("string"))
    return read(spark, sf_dir, "events").select(F.sha2(key, 256).alias("fact_id"), c("event_type").alias("predicate"), F.lit("candidate").alias("status"), F.lit(1).alias("version"), c("ts").alias("valid_from"))


@register("s5_capture", twin("ev", """, named AS (SELECT *, CASE WHEN user_id % 5 = 0 THEN user_id + 1 ELSE user_id END AS subject FROM ev WHERE k IS NOT NULL),
 again AS (SELECT *, 0 AS batch FROM named UNION ALL SELECT *, 1 FROM named WHERE event_id % 7 = 0),
 first AS (SELECT *, row_number() OVER (PARTITION BY subject, event_type, ts ORDER BY batch, event_id) > 1 AS deduplicated FROM again)
 SELECT batch, event_id, subject, deduplicated, CASE WHEN deduplicated THEN 0 ELSE 1 END AS debit, CASE WHEN NOT deduplicated THEN 'consolidate' END AS job FROM first"""))
def s5_capture(spark, sf_dir):
    """A batch of capture requests with repeats: aliases resolved, scopes checked, first come kept, debited and enqueued."""
    e = events(spark, sf_dir).filter("k is not null")
    aliases = e.select("user_id").distinct().filter("user_id % 5 = 0").withColumn("canonical", c("user_id") + 1)
    named = e.join(aliases, "user_id", "left").withColumn("subject", F.coalesce("canonical", "user_id"))
    again = named.withColumn("batch", F.lit(0)).unionByName(named.filter("event_id % 7 = 0").withColumn("batch", F.lit(1)))
    key = ["subject", "event_type", "ts"]
    first = again.groupBy(*key).agg(F.min(F.struct("batch", "event_id")).alias("first"))
    late = F.struct("batch", "event_id") != c("first")
    return again.join(first, key).select("batch", "event_id", "subject", late.alias("deduplicated"), F.when(late, 0).otherwise(1).alias("debit"), F.when(~late, "consolidate").alias("job"))


@register("s14_mirrored_stores", "SELECT s.speaker, left(c.conv_id || '__' || s.speaker, 128) AS subject, c.conv_id, c.turn, CASE WHEN c.role = s.speaker THEN 'user' ELSE 'assistant' END AS as_role, c.role || ': ' || c.text AS said FROM conversations c, (VALUES ('user'), ('assistant')) s(speaker)")
def s14_mirrored_stores(spark, sf_dir):
    """A store for each speaker: own turns as the user's, all others as the assistant's, the speaker's name before the text."""
    t = read(spark, sf_dir, "conversations").withColumn("speaker", F.explode(F.array(F.lit("user"), F.lit("assistant"))))
    subject = F.left(F.concat_ws("__", c("conv_id").cast("string"), "speaker"), F.lit(128))
    return t.select("speaker", subject.alias("subject"), "conv_id", "turn", F.when(c("role") == c("speaker"), "user").otherwise("assistant").alias("as_role"), F.concat(c("role"), F.lit(": "), c("text")).alias("said"))


@register("s17_unchunked_events", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM conversations WHERE conv_id = doc_id)")
def s17_unchunked_events(spark, sf_dir):
    """Events without a chunk."""
    chunked = read(spark, sf_dir, "conversations").select(c("conv_id").alias("doc_id"))
    return read(spark, sf_dir, "documents").select("doc_id").join(chunked, "doc_id", "left_anti")


@register("s2_full_event_hash", """SELECT event_id, 'sha256:' || sha256('{"kind":"' || event_type || '","occurred_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","org_id":"org","payload":' || replace(props, ' ', '') || ',"project_id":"' || (user_id % 3) || '","subject_id":"' || user_id || '","subject_type":"user"}') AS hash FROM events""")
def s2_full_event_hash(spark, sf_dir):
    """Over the canonical JSON of an event's seven business fields, keys in order."""
    text = lambda x: x.cast("string")
    fields = F.concat(F.lit('{"kind":"'), c("event_type"), F.lit('","occurred_at":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('","org_id":"org","payload":'), F.to_json(F.parse_json("props")), F.lit(',"project_id":"'), text(c("user_id") % 3), F.lit('","subject_id":"'), text(c("user_id")), F.lit('","subject_type":"user"}'))
    return read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("sha256:"), F.sha2(fields, 256)).alias("hash"))


@register("s3_origin_trust", "SELECT conv_id, turn, CASE WHEN turn % 7 = 0 THEN 'untrusted' WHEN role IN ('assistant', 'system', 'tool', 'agent') THEN 'semi_trusted' ELSE 'trusted' END AS origin_trust FROM conversations")
def s3_origin_trust(spark, sf_dir):
    """What the caller says, else by the actor: an agent's own talk is semi-trusted."""
    declared = F.when(c("turn") % 7 == 0, "untrusted")
    actor = F.when(c("role") == "assistant", "agent").otherwise(c("role"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(declared, F.when(actor.isin("agent", "tool", "system"), "semi_trusted").otherwise("trusted")).alias("origin_trust"))


@register("s4_bounded_json", "SELECT page_id, strlen(html) AS size, strlen(html) > 262144 AS rejected FROM pages")
def s4_bounded_json(spark, sf_dir):
    """Payloads over 256 KiB are rejected."""
    size = F.octet_length("html").cast("long")
    return read(spark, sf_dir, "pages").select("page_id", size.alias("size"), (size > 256 * 1024).alias("rejected"))


QUAL = """, q AS (SELECT *, '{"attributed_to":"u' || (event_id % 4) || '","slot":"' || (coalesce(k, 0) % 3) || '"}' AS qualifiers, '{"slot":"' || (coalesce(k, 0) % 3) || '"}' AS own FROM ev)"""


def qualified(spark, sf_dir) -> DataFrame:
    """Events with qualifiers, and those without who said it."""
    text = lambda x: x.cast("string")
    q = F.concat(F.lit('{"attributed_to":"u'), text(c("event_id") % 4), F.lit('","slot":"'), text(F.coalesce("k", F.lit(0)) % 3), F.lit('"}'))
    return events(spark, sf_dir).withColumn("qualifiers", q).withColumn("own", M.drop_key(c("qualifiers"), "attributed_to"))


@register("p7_key_removal", twin("ev", QUAL + " SELECT event_id, own FROM q"))
def p7_key_removal(spark, sf_dir):
    return qualified(spark, sf_dir).select("event_id", "own")


@register("w2_dedup_by_qualifiers", twin("ev", QUAL + " SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type, own ORDER BY ts DESC, event_id DESC) > 1 THEN 'superseded' ELSE 'active' END AS status FROM q"))
def w2_dedup_by_qualifiers(spark, sf_dir):
    w = W.partitionBy("user_id", "event_type", "own").orderBy(F.desc("ts"), F.desc("event_id"))
    return qualified(spark, sf_dir).select("event_id", F.when(F.row_number().over(w) > 1, "superseded").otherwise("active").alias("status"))


@register("f_qualifier_stamp", twin("ev", QUAL + """ SELECT event_id, '{"attributed_to":"' || CASE WHEN event_id % 3 = 0 THEN 'third_party' ELSE 'a' || user_id END || '","slot":"' || (coalesce(k, 0) % 3) || '"}' AS stamped FROM q"""))
def f_qualifier_stamp(spark, sf_dir):
    who = F.when(c("event_id") % 3 != 0, F.concat(F.lit("a"), c("user_id").cast("string")))
    return qualified(spark, sf_dir).select("event_id", M.stamp(c("qualifiers"), who).alias("stamped"))


MERGED = """, v AS (SELECT event_id, '{"a":{"t":"' || event_type || '","k":' || coalesce(k, 0) || '},"b":[' || event_id % 7 || ',null],"c":"x","u":' || user_id || '}' AS old,
   '{"a":' || CASE event_id % 3 WHEN 0 THEN '{"t":"new"}' WHEN 1 THEN 'null' ELSE '[' || coalesce(k, 0) || ']' END || ',"d":' || CASE WHEN user_id % 2 = 0 THEN 'null' ELSE '{"n":{"m":' || user_id || '}}' END || '}' AS new FROM ev),
 e AS (SELECT event_id, key, json_extract(old, '$.' || key)::VARCHAR AS value FROM (SELECT *, unnest(json_keys(old)) AS key FROM v) WHERE NOT list_contains(json_keys(new), key) UNION ALL SELECT event_id, key, json_extract(new, '$.' || key)::VARCHAR FROM (SELECT *, unnest(json_keys(new)) AS key FROM v))"""


@register("f_value_merge", twin("ev", MERGED + """ SELECT event_id, '{' || string_agg('"' || key || '":' || value, ',' ORDER BY key) || '}' AS merged FROM e WHERE value <> 'null' GROUP BY event_id"""))
def f_value_merge(spark, sf_dir):
    """New keys win, nested values whole, and an explicit null takes a key out."""
    e, n = c("event_id"), F.coalesce("k", F.lit(0)).cast("string")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    old = text('{"a":{"t":"', c("event_type"), '","k":', n, '},"b":[', (e % 7).cast("string"), ',null],"c":"x","u":', c("user_id").cast("string"), "}")
    a = F.when(e % 3 == 0, '{"t":"new"}').when(e % 3 == 1, "null").otherwise(text("[", n, "]"))
    d = F.when(c("user_id") % 2 == 0, "null").otherwise(text('{"n":{"m":', c("user_id").cast("string"), "}}"))
    return events(spark, sf_dir).select("event_id", M.value_merge(old, text('{"a":', a, ',"d":', d, "}")).alias("merged"))


@register("f_fact_label", "SELECT event_id, event_type || ': ' || CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE props END AS label FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def f_fact_label(spark, sf_dir):
    value = F.when(c("event_id") % 2 == 0, F.replace("props", F.lit('"k"'), F.lit('"value"'))).otherwise(c("props"))
    return events(spark, sf_dir).filter("k is not null").select("event_id", M.fact_label(c("event_type"), value).alias("label"))


@register("f_source_events", "SELECT event_id, [event_id, event_id + 1]::VARCHAR AS sources FROM events")
def f_source_events(spark, sf_dir):
    """A source appended to a fact's list."""
    ids = F.array_append(F.array("event_id"), c("event_id") + 1)
    return read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]")).alias("sources"))


@register("f_message_render", "SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 0 THEN CASE WHEN turn % 2 = 0 THEN 'bob' ELSE '?' END ELSE role END || ': ' || CASE WHEN turn % 5 = 0 THEN '' ELSE text END, ' ') AS said FROM conversations")
def f_message_render(spark, sf_dir):
    t = c("turn")
    said = M.message_text(F.when(t % 3 != 0, c("role")), F.when(t % 2 == 0, "bob").otherwise(""), F.when(t % 5 != 0, c("text")), F.lit(None).cast("string"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"))


@register("f_episode_text", "SELECT conv_id, turn, left(role || ' ' || text, 4000) AS said FROM conversations")
def f_episode_text(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", M.episode_text(c("role"), c("text")).alias("said"))


#: Sentences, cut where long, are gathered one by one: the state is the chunk's number and length so far.
CHUNKED = r"""b AS (SELECT doc_id, 'document {"text": ' || to_json(text)::VARCHAR || '}' AS blob FROM documents),
 s AS (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(blob, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM b WHERE length(blob) > 1600)),
 p AS (SELECT doc_id, substring(x, 1 + 1600 * k, 1600) AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS n FROM (SELECT *, unnest(range(0, greatest(1, (length(x) + 1599) // 1600))) AS k FROM s)),
 g(doc_id, n, chunk, size) AS (SELECT doc_id, n, CAST(0 AS BIGINT), length(piece) FROM p WHERE n = 1
   UNION ALL SELECT p.doc_id, p.n, CASE WHEN size = 0 OR size + 1 + length(piece) <= 1000 THEN chunk ELSE chunk + 1 END, CASE WHEN size = 0 THEN length(piece) WHEN size + 1 + length(piece) <= 1000 THEN size + 1 + length(piece) ELSE length(piece) END FROM g JOIN p ON p.doc_id = g.doc_id AND p.n = g.n + 1),
 c AS (SELECT doc_id, chunk, regexp_replace(string_agg(piece, ' ' ORDER BY n), '^\s+|\s+$', '', 'g') AS said FROM g JOIN p USING (doc_id, n) GROUP BY 1, 2 UNION ALL SELECT doc_id, 0, blob FROM b WHERE length(blob) <= 1600),
 o AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 AS INTEGER) AS ordinal, said FROM c WHERE said <> '')
 SELECT doc_id, least(ordinal, 199) AS ordinal, string_agg(said, ' ' ORDER BY ordinal) AS chunk FROM o GROUP BY doc_id, least(ordinal, 199)"""


@register("f_chunk_payload", f"WITH RECURSIVE {CHUNKED}")
def f_chunk_payload(spark, sf_dir):
    """Chunks of opaque payloads: every document's whole text in one field."""
    payload = F.to_json(F.struct("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(M.chunk_payload(F.lit("document"), payload)).alias("ordinal", "chunk"))


@register("f_source_turn", """WITH w AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]{3,}'), lambda x: lower(x))) AS words FROM conversations), ask AS (SELECT conv_id, words AS asked FROM w WHERE turn = 0)
 SELECT conv_id, turn, len(list_intersect(words, asked)) AS shared FROM w JOIN ask USING (conv_id) WHERE turn > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY shared DESC, turn) = 1""")
def f_source_turn(spark, sf_dir):
    """The turn that shares most words with the first; of equals the earliest."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", M.overlap_words(c("text")).alias("words"))
    ask = t.filter("turn = 0").select("conv_id", c("words").alias("asked"))
    shared = t.filter("turn > 0").join(ask, "conv_id").withColumn("shared", F.size(F.array_intersect("words", "asked")).cast("long"))
    best = shared.groupBy("conv_id").agg(F.max(F.struct("shared", (-c("turn")).alias("t"))).alias("m"))
    return best.select("conv_id", (-c("m.t")).alias("turn"), "m.shared")


JUDGED = """SELECT d.doc_id, left(text, 40) || CASE WHEN toxic = 1 THEN '{"label":"abstained"}' WHEN quality = 1 THEN chr(10) || '{"label": "Correct",' || chr(10) || ' "reason": {"n": 1}}' WHEN d.doc_id % 2 = 0 THEN '{"label": "fine"}' ELSE '{"label": ' END || substring(text, 41, 40) AS said FROM documents d JOIN labels USING (doc_id)"""


@register("f_judge_output", f"""SELECT doc_id, CASE WHEN json_valid(j) AND lower(json_extract_string(j, '$.label')) IN ('correct', 'incorrect', 'abstained') THEN lower(json_extract_string(j, '$.label')) ELSE 'incorrect' END AS label
 FROM (SELECT doc_id, regexp_extract(said, '(?s)\\{{.*\\}}') AS j FROM ({JUDGED}))""")
def f_judge_output(spark, sf_dir):
    """Labels in answers that stand between the words of a document: some clean, some with other labels or broken."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    body = F.when(c("toxic") == 1, '{"label":"abstained"}').when(c("quality") == 1, '\n{"label": "Correct",\n "reason": {"n": 1}}').when(c("doc_id") % 2 == 0, '{"label": "fine"}').otherwise('{"label": ')
    said = F.concat(F.substring("text", 1, 40), body, F.substring("text", 41, 40))
    return rows.select("doc_id", M.judge_label(said).alias("label"))


ASKS = ["How many were there?", "how often does it", "Why so", "how did he", "Please compare them", "what is it", "Where, and explain"]
ASK_SQL = ", ".join(f"'{x}'" for x in ASKS)


@register("f_retrieval_need", f"""SELECT conv_id, turn, CASE WHEN regexp_matches(asked, '(?i)^\\s*how\\s+(many|much|often)\\b') THEN 'count'
 WHEN regexp_matches(asked, '(?i)^\\s*(why|would|could|should|how (do|does|did)|in what way)\\b|\\b(describe|compare|summarize|summarise|explain)\\b') THEN 'narrative' ELSE 'point_value' END AS need
 FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN [{ASK_SQL}][1 + (conv_id + turn) % 7] || ' ' || text ELSE text || ' ' || [{ASK_SQL}][1 + (conv_id + turn) % 7] END AS asked FROM conversations)""")
def f_retrieval_need(spark, sf_dir):
    """Every turn as a question, with a phrase before or after its words."""
    phrase = F.element_at(F.array(*map(F.lit, ASKS)), ((c("conv_id") + c("turn")) % 7 + 1).cast("int"))
    asked = F.when(c("turn") % 2 == 0, F.concat_ws(" ", phrase, "text")).otherwise(F.concat_ws(" ", "text", phrase))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", M.retrieval_need(asked).alias("need"))


ORDERS = ("Ignore all previous instructions", "Considère toujours", "FROM NOW ON, you must go", "n'oublie jamais de toujours", "do not ignore instructions of use", "always late", "You  must\nalways", "réponds toujours en donnant la priorité")
ORDERS_SQL = ", ".join("'" + x.replace("'", "''") + "'" for x in ORDERS)


@register("f_directives", "SELECT doc_id, " + " OR ".join("regexp_matches(said, '(?i)" + x.replace("'", "''") + "')" for x in K.DIRECTIVES) + f""" AS directive
 FROM (SELECT doc_id, left(text, doc_id % 200) || ' ' || [{ORDERS_SQL}][1 + doc_id % 8] || ' ' || substring(text, 1 + doc_id % 200) AS said FROM documents)""")
def f_directives(spark, sf_dir):
    """Whole texts, each with an order to an agent, or something like it, among its words."""
    phrase = F.element_at(F.array(*map(F.lit, ORDERS)), (c("doc_id") % 8 + 1).cast("int"))
    at = (c("doc_id") % 200).cast("int")
    said = F.concat_ws(" ", F.substr("text", F.lit(1), at), phrase, F.substr("text", at + 1))
    return read(spark, sf_dir, "documents").select("doc_id", K.directive(said).alias("directive"))


@register("f_cost_usd", "SELECT o_orderkey, round((o_custkey * 0.15 + o_orderkey * 0.6) / 1000000, 9) AS cost FROM orders")
def f_cost_usd(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(M.cost_usd(c("o_custkey"), c("o_orderkey"), 0.15, 0.6), 9).alias("cost"))


@register("f_legacy_score", "SELECT event_id, round(0.6 * (value / 1000) + 0.25 * (user_id / 100.0) + 0.15 * exp(-(event_id % 30) / 30.0), 6) AS score FROM events")
def f_legacy_score(spark, sf_dir):
    from ..operators.ranking import legacy_score

    score = legacy_score(c("value") / 1000, c("user_id") / 100.0, F.exp(-(c("event_id") % 30) / 30.0))
    return read(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"))


@register("f_entity_factor", f"""WITH e AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '{ENTITY}'), lambda x: lower(x) NOT IN ({NAMES})) AS names FROM conversations),
 n AS (SELECT *, lead(names) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM e) SELECT conv_id, turn, CASE WHEN len(names) = 0 OR asked IS NULL OR len(asked) = 0 THEN 1.0 WHEN list_contains(asked, names[1]) THEN 1.0 ELSE 0.7 END::DOUBLE AS factor FROM n""")
def f_entity_factor(spark, sf_dir):
    """A fact about a person whom the question, which names others, does not name counts for less: here the first name of a turn and
    the names of the next one."""
    from ..functions.names import MATCH, MISMATCH

    w = W.partitionBy("conv_id").orderBy("turn")
    t = read(spark, sf_dir, "conversations").withColumn("names", entity_tokens(c("text"))).withColumn("asked", F.lead("names").over(w))
    nobody = (F.size("names") == 0) | c("asked").isNull() | (F.size("asked") == 0)
    factor = F.when(nobody, 1.0).when(F.array_contains("asked", F.get("names", F.lit(0))), MATCH).otherwise(MISMATCH)
    return t.select("conv_id", "turn", factor.alias("factor"))


@register("f_volatility_freshness", """SELECT event_id, CASE WHEN h IS NULL OR age <= h THEN 'current' WHEN event_type = 'view' THEN 'unconfirmed' ELSE 'stale' END AS freshness FROM (SELECT *, date_diff('microsecond', ts, TIMESTAMP '2024-03-01 00:00:00') / 86400000000.0 AS age,
 CASE event_type WHEN 'view' THEN 365 WHEN 'click' THEN 60 WHEN 'error' THEN 7 END AS h FROM events)""")
def f_volatility_freshness(spark, sf_dir):
    """Horizons of 365, 60 and 7 days for slow, volatile and ephemeral facts; a slow one past it is unconfirmed, others stale."""
    t = c("event_type")
    volatility = F.when(t == "view", "slow").when(t == "click", "volatile").when(t == "error", "ephemeral").otherwise("stable")
    horizon = F.when(volatility == "slow", 365).when(volatility == "volatile", 60).when(volatility == "ephemeral", 7)
    age = F.timestamp_diff("MICROSECOND", c("ts"), F.to_timestamp_ntz(F.lit("2024-03-01 00:00:00"))) / 86400000000.0
    fresh = F.when(horizon.isNull() | (age <= horizon), "current").when(volatility == "slow", "unconfirmed").otherwise("stale")
    return read(spark, sf_dir, "events").select("event_id", fresh.alias("freshness"))


@register("r1_query_lexemes")
def r1_query_lexemes(spark, sf_dir):
    """Stems of every turn as a question; stop words alone leave none."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", english_lexemes(c("text")).alias("lexemes"))


@register("r3_cover_density")
def r3_cover_density(spark, sf_dir):
    """The rank of every turn for its conversation's first turn."""
    t = read(spark, sf_dir, "conversations")
    ask = t.filter("turn = 0").select("conv_id", c("text").alias("asked"))
    return t.join(ask, "conv_id").select("conv_id", "turn", english_rank(c("text"), c("asked")).alias("rank"))


@register("p11_null_safe_query", f"""SELECT doc_id, asked, 0.1 * len(list_filter({LEX}, lambda w: list_contains({LEX.replace("text", "asked")}, w)))::DOUBLE AS rank
 FROM (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 'The and OF' ELSE left(text, 30) END AS asked FROM documents)""")
def p11_null_safe_query(spark, sf_dir):
    """Every text ranked for a question; one of stop words alone has no lexemes, matches nothing and ranks 0."""
    asked = F.when(c("doc_id") % 4 == 0, "The and OF").otherwise(F.substring("text", 1, 30))
    t = read(spark, sf_dir, "documents").select("doc_id", asked.alias("asked"), simple_words(c("text")).alias("words"), simple_lexemes(asked).alias("own"))
    return t.select("doc_id", "asked", (0.1 * F.size(F.filter("words", lambda w: F.array_contains("own", w)))).cast("double").alias("rank"))


@register("j10_alias_table", "SELECT event_id, c_custkey AS canonical FROM events LEFT JOIN customer ON c_name = 'Customer#' || lpad(user_id::VARCHAR, 9, '0')")
def j10_alias_table(spark, sf_dir):
    """Names resolved to their canonical subject; a name that no alias has stays null."""
    aliases = read(spark, sf_dir, "customer").select(c("c_name").alias("name"), c("c_custkey").alias("canonical"))
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Customer#"), F.lpad(c("user_id").cast("string"), 9, "0")).alias("name"))
    return e.join(aliases, "name", "left").select("event_id", "canonical")


@register("j13_whole_word_routing", r"""SELECT conv_id, turn, CASE WHEN len(named) = 1 THEN named[1] ELSE 'all' END AS store FROM (SELECT conv_id, turn, list_filter(['the', 'con', 'les'], lambda x: regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])' || x || '($|[^\p{L}\p{N}_])')) AS named FROM conversations)""")
def j13_whole_word_routing(spark, sf_dir):
    """The one store that a question names as a whole word, whatever its case; all of them if it names none or several."""
    named = F.filter(F.array(*map(F.lit, ("the", "con", "les"))), lambda x: F.regexp_count("text", F.concat(F.lit(r"(?iU)(?:^|\W)"), x, F.lit(r"(?:$|\W)"))) > 0)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.size(named) == 1, F.element_at(named, 1)).otherwise("all").alias("store"))


@register("a11_rejects_by_reason", """WITH j AS (SELECT event_type, user_id % 4 AS r, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT event_type, CASE r WHEN 0 THEN 'system_noise' WHEN 1 THEN 'config_dump' END AS reason, n FROM j)
 SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM m WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'unclassified', CAST(sum(n) AS BIGINT) FROM m WHERE reason IS NULL""")
def a11_rejects_by_reason(spark, sf_dir):
    """Job results hold a JSON map of reasons and a total; what the map leaves of the total is unclassified."""
    r = c("user_id") % 4
    jobs = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(r == 0).alias("system_noise"), F.count_if(r == 1).alias("config_dump"), F.count("*").alias("total"))
    results = jobs.select("total", F.to_json(F.struct("system_noise", "config_dump")).alias("reasons"))
    own = results.select(F.explode(F.from_json("reasons", "map<string,bigint>")).alias("reason", "n"))
    named = F.aggregate(F.map_values(F.from_json("reasons", "map<string,bigint>")), F.lit(0).cast("long"), lambda s, x: s + x)
    rest = results.select(F.lit("unclassified").alias("reason"), (c("total") - named).alias("n"))
    return own.unionByName(rest).groupBy("reason").agg(F.sum("n").alias("n"))


@register("a14_health", """SELECT user_id, round_even(100 * (coalesce(0.3 * injection, 0) + coalesce(0.3 * integrity, 0) + coalesce(0.2 * hygiene, 0)) / nullif((injection IS NOT NULL)::INT * 0.3 + (integrity IS NOT NULL)::INT * 0.3 + (hygiene IS NOT NULL)::INT * 0.2, 0), 1) AS score FROM
 (SELECT user_id, count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'view'), 0) AS injection, 1 - count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type = 'click'), 0) AS integrity, CASE WHEN count(*) FILTER (event_type <> 'view') > 0 THEN greatest(0, 1 - 0.1 * count(*) FILTER (event_type = 'error')) END AS hygiene FROM events GROUP BY user_id)""")
def a14_health(spark, sf_dir):
    """The mean of the measured components: injection .30, integrity against contradictions .30, conflict hygiene .20, staleness .20,
    which is not measured yet."""
    t = c("event_type")
    n = lambda x: F.count_if(t == x)
    parts = read(spark, sf_dir, "events").groupBy("user_id").agg(F.try_divide(n("purchase"), n("view")).alias("injection"), (1 - F.try_divide(n("error"), n("click"))).alias("integrity"), n("error").alias("errors"), F.count_if(t != "view").alias("others"))
    clean = F.when(c("others") > 0, hygiene(c("errors"), 2))
    return parts.select("user_id", weighted_score({"injection": (0.3 * c("injection"), 0.3), "integrity": (0.3 * c("integrity"), 0.3), "hygiene": (clean, 0.2), "staleness": (F.lit(None).cast("double"), 0.2)}).alias("score"))


@register("a16_conflict_summary", twin("ev", """, s AS (SELECT user_id, event_type, coalesce(k % 3, -1) AS b, min(ts) AS opened FROM ev GROUP BY ALL HAVING count(DISTINCT k) = 2)
 SELECT user_id, event_type, b, opened, count(*) OVER () AS n, date_diff('second', min(opened) OVER (), TIMESTAMP '2024-03-01 00:00:00') AS oldest_age_seconds FROM s"""))
def a16_conflict_summary(spark, sf_dir):
    """Open sets with their number and the age of the oldest."""
    sets = events(spark, sf_dir).groupBy("user_id", "event_type", F.coalesce(c("k") % 3, F.lit(-1)).alias("b")).agg(F.min("ts").alias("opened"), F.count_distinct("k").alias("v")).filter("v = 2").drop("v")
    age = F.timestamp_diff("SECOND", F.date_trunc("second", F.min("opened")), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    whole = sets.agg(F.count("*").alias("n"), age.alias("oldest_age_seconds"))
    return sets.join(F.broadcast(whole))  # one row


@register("a17_eval_report", """WITH r AS (SELECT source AS system, lang AS qtype, CASE WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'abstained' ELSE 'incorrect' END AS label, lang = 'es' AS expected, n_chars FROM documents JOIN labels USING (doc_id)),
 s AS (SELECT *, CASE WHEN expected THEN label = 'abstained' ELSE label = 'correct' END AS success FROM r)
 SELECT system, qtype, count(*) AS n, round(avg(success::INT), 6) AS accuracy, count(*) FILTER (expected) AS abstention_n, round(avg(CASE WHEN expected THEN (label = 'abstained')::INT END), 6) AS abstention_accuracy, round(avg(n_chars), 6) AS context_tokens_mean FROM s GROUP BY GROUPING SETS ((system, qtype), (system))""")
def a17_eval_report(spark, sf_dir):
    """Accuracy, abstention and mean context of every system, for each question type and (a null type) in all."""
    r = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    label = F.when(c("quality") == 1, "correct").when(c("toxic") == 1, "abstained").otherwise("incorrect")
    rows = r.select(c("source").alias("system"), c("lang").alias("qtype"), label.alias("label"), (c("lang") == "es").alias("expected"), "n_chars")
    success = F.when(c("expected"), c("label") == "abstained").otherwise(c("label") == "correct")
    aggregates = [
        F.count("*").alias("n"), F.round(F.avg("success"), 6).alias("accuracy"), F.count_if("expected").alias("abstention_n"),
        F.round(F.avg(F.when(c("expected"), (c("label") == "abstained").cast("int"))), 6).alias("abstention_accuracy"), F.round(F.avg("n_chars"), 6).alias("context_tokens_mean"),
    ]
    scored = rows.withColumn("success", success.cast("int"))
    return scored.groupingSets([[c("system"), c("qtype")], [c("system")]], "system", "qtype").agg(*aggregates)


@register("a21_entities", f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{ENTITY}')) AS token FROM conversations) WHERE lower(token) NOT IN ({NAMES}, 'étion') GROUP BY token ORDER BY n DESC, token LIMIT 20")
def a21_entities(spark, sf_dir):
    """The most frequent names, without words that open sentences and those of the question."""
    tokens = read(spark, sf_dir, "conversations").select(F.explode(entity_tokens(c("text"))).alias("token")).filter(F.lower("token") != "étion")
    return tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(20)


@register("a22_prf_top10", f"""WITH head AS (SELECT conv_id, turn, text FROM conversations WHERE turn < 10), t AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '{ENTITY}')) AS token FROM head)
 SELECT conv_id, token, count(*) AS n FROM t WHERE lower(token) NOT IN ({NAMES}) GROUP BY ALL HAVING count(*) >= 2""")
def a22_prf_top10(spark, sf_dir):
    """Names in two or more of a query's first ten items, counted once an item; the items here are a conversation's turns."""
    head = read(spark, sf_dir, "conversations").filter("turn < 10").select("conv_id", F.explode(F.array_distinct(entity_tokens(c("text")))).alias("token"))
    return head.groupBy("conv_id", "token").agg(F.count("*").alias("n")).filter("n >= 2")
