"""Retrieval: candidates on two axes, fusion, floor, packing, neighbours; all queries of a run in one plan.

Facts are the vectors with the document of the same number as text, scoped by label; episodes are the turns of conversations, with
the vector of their conversation's number. Every vector whose number is divisible by 20 is a query, asked after the last turn. The
lexical axis is the cover density of a query's lexemes in an item, that is, a constant for each occurrence of any of them. Two facts
of a scope with neighbouring numbers (2n and 2n + 1) are the sides of an open contradiction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexical import STOP_WORDS, simple_words
from ..functions.messages import overlap_words
from ..functions.names import ENTITY, NO_NAMES, entity_tokens, person_factor
from ..functions.text import normalise_span, relative_day, token_estimate
from ..operators.candidates import candidates as scan
from ..operators.context_window import context_window
from ..operators.ordering import neighbours
from ..operators.expansion import HEAD, second_hop
from ..operators.ranking import legacy_score, pack_packets, relevance, rerank_block, top_k
from ..sources.scratch import written
from ..sources.tables import chunks, events, read, twin
from .registry import register

c = F.col
TOP_K, BUDGET, FLOOR, EVERY, BLOCK = 64, 2000, 0.9, 20, 50
#: Facts nearer than this, by cosine distance, state the same identity.
SAME = 0.28
NAMES = ", ".join(f"'{w}'" for w in NO_NAMES)
STOPS = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
LEX = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'), lambda x: x NOT IN ({STOPS}))"
ORDER = "recency DESC, tie_a, tie_b, id"

#: An episode's id: its conversation, then its turn in the lower 32 bits.
TURNS = 1 << 32
ITEMS = f"""f AS (SELECT vec_id AS id, label AS scope, CAST(embedding AS DOUBLE[]) AS e, text, source, lang, (vec_id * 7) % 97 AS recency, coalesce(source, '') AS tie_a, md5(coalesce(text, '')) AS tie_b, {LEX} AS lex, greatest(1, length(coalesce(text, '')) // 4) AS cost
   FROM embeddings JOIN documents ON vec_id = doc_id),
 ep AS (SELECT conv_id * {TURNS} + turn AS id, conv_id % 10 AS scope, CAST(embedding AS DOUBLE[]) AS e, conv_id AS recency, printf('%010d', 1000000 - turn) AS tie_a, md5(text) AS tie_b, {LEX} AS lex, greatest(1, (length(text) + 17 + length(role)) // 4) AS cost
   FROM conversations JOIN embeddings ON vec_id = conv_id WHERE role <> 'system')"""
AXES = lambda items, name: f"""{name}_all AS (SELECT q.id AS query_id, x.*, round(list_cosine_distance(q.e, x.e), 6) AS distance, len(list_filter(x.lex, lambda w: list_contains(q.lex, w))) AS overlap FROM f q JOIN {items} x ON q.scope = x.scope AND q.id <> x.id WHERE q.id % {EVERY} = 0),
 {name} AS (SELECT query_id, id, distance, overlap, recency, tie_a, tie_b, cost, CASE WHEN v <= {TOP_K} AND distance IS NOT NULL THEN v END AS by_vector, CASE WHEN l <= {TOP_K} AND overlap > 0 THEN l END AS by_lexemes
   FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, {ORDER}) AS v, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, {ORDER}) AS l FROM {name}_all) WHERE v <= {TOP_K} AND distance IS NOT NULL OR l <= {TOP_K} AND overlap > 0)"""  # noqa: E731
FACTS = f"{ITEMS}, {AXES('f', 'facts')}"
POOL = f"""{FACTS}, {AXES('ep', 'episodes')}, pool AS (SELECT 'fact' AS kind, 0 AS place, * FROM facts UNION ALL SELECT 'episode', 1, * FROM episodes)"""
SAID = f"list_filter(regexp_extract_all(coalesce(text, ''), '{ENTITY}'), lambda x: lower(x) NOT IN ({NAMES}))"
FUSED = POOL + f""", who AS (SELECT id, {SAID} AS names FROM f), passed AS (SELECT *, 1 - distance AS similarity FROM pool WHERE distance <= {FLOOR}),
 scaled AS (SELECT *, coalesce((similarity - min(similarity) OVER q) / nullif(max(similarity) OVER q - min(similarity) OVER q, 0), 0) AS s, coalesce((overlap - min(overlap) OVER q) / nullif(max(overlap) OVER q - min(overlap) OVER q, 0), 0) AS l FROM passed WINDOW q AS (PARTITION BY query_id)),
 fused AS (SELECT x.*, round((0.65 * s + 0.35 * l) * CASE WHEN x.kind = 'fact' AND w.names[1] IS NOT NULL AND len(q.names) > 0 AND NOT list_contains(q.names, w.names[1]) THEN 0.7 ELSE 1.0 END, 6) AS score
   FROM scaled x JOIN who q ON q.id = x.query_id LEFT JOIN who w ON x.kind = 'fact' AND w.id = x.id),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, recency DESC, place, tie_a, tie_b, id) AS rank FROM fused)"""
PACKED = FUSED + f""", conf AS (SELECT a.id, b.id AS side, b.cost AS side_cost FROM f a JOIN f b ON a.scope = b.scope AND a.id // 2 = b.id // 2 AND a.id <> b.id),
 line AS (SELECT r.query_id, r.rank, r.kind, r.id, r.cost, c.side, c.side_cost FROM ranked r LEFT JOIN conf c ON r.kind = 'fact' AND c.id = r.id),
 fold(query_id, rank, kind, id, cost, side, side_cost, again, kept, piled, spent, tried, side_kept, used, in_episodes, episodes, packed) AS (
   SELECT DISTINCT query_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), true, false, false, CAST(0 AS BIGINT), false, false, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, CAST([] AS BIGINT[]) FROM ranked
   UNION ALL SELECT query_id, rank, kind, id, cost, side, side_cost, again, kept, piled, spent, tried, side_kept, spent + CASE WHEN side_kept THEN side_cost ELSE 0 END, in_episodes + CASE WHEN kept AND kind = 'episode' THEN cost ELSE 0 END, episodes + (kept AND kind = 'episode')::INT,
     packed || CASE WHEN kept AND kind = 'fact' THEN [id] ELSE [] END || CASE WHEN side_kept THEN [side] ELSE [] END FROM
   (SELECT *, tried AND spent + side_cost <= {BUDGET} AS side_kept FROM (SELECT *, used + CASE WHEN kept THEN cost ELSE 0 END AS spent, kept AND side IS NOT NULL AND NOT list_contains(packed, side) AS tried FROM
   (SELECT *, NOT again AND NOT piled AND used + cost <= {BUDGET} AS kept FROM
   (SELECT l.*, f.used, f.in_episodes, f.episodes, f.packed, l.kind = 'fact' AND list_contains(f.packed, l.id) AS again, l.kind = 'episode' AND f.episodes > 0 AND f.in_episodes + l.cost > {BUDGET} / 2 AS piled
     FROM fold f JOIN line l ON l.query_id = f.query_id AND l.rank = f.rank + 1))))),
 told AS (SELECT query_id, rank, 0 AS sub, kind, id, cost, CASE WHEN kept THEN 'included' ELSE 'excluded' END AS action, CASE WHEN kept AND side IS NOT NULL THEN 'conflict_disputed' WHEN kept THEN 'top_score' WHEN piled THEN 'over_episode_budget' ELSE 'over_budget' END AS reason_code, spent AS used FROM fold WHERE NOT again
   UNION ALL SELECT query_id, rank, 1, 'fact', side, side_cost, CASE WHEN side_kept THEN 'included' ELSE 'excluded' END, CASE WHEN side_kept THEN 'conflict_disputed' ELSE 'over_budget' END, used FROM fold WHERE tried),
 decided AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, sub) AS place FROM told)"""


def facts_of(spark, sf_dir) -> DataFrame:
    """Items of the scan: facts, newest by a made-up clock, tied by source and a hash of their text."""
    docs = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    f = read(spark, sf_dir, "embeddings").join(docs, c("vec_id") == c("doc_id"))
    return f.select(c("label").alias("scope"), c("vec_id").alias("id"), c("embedding").alias("e"), simple_words(c("text")).alias("lex"), ((c("vec_id") * 7) % 97).alias("recency"), F.coalesce("source", F.lit("")).alias("tie_a"), F.md5("text").alias("tie_b"), token_estimate(c("text")).alias("cost"))


def episodes_of(spark, sf_dir) -> DataFrame:
    """Items of the scan: turns with a vector, not from an untrusted origin; later turns first among equals."""
    e = read(spark, sf_dir, "embeddings").select(c("vec_id").alias("conv_id"), c("embedding").alias("e"))
    said = F.greatest(F.lit(1), F.floor((F.length("text") + 17 + F.length("role")) / 4)).cast("long")
    turns = read(spark, sf_dir, "conversations").filter("role <> 'system'").join(e, "conv_id")
    return turns.select((c("conv_id") % 10).alias("scope"), (c("conv_id") * TURNS + c("turn")).alias("id"), "e", simple_words(c("text")).alias("lex"), c("conv_id").alias("recency"), F.lpad((1_000_000 - c("turn")).cast("string"), 10, "0").alias("tie_a"), F.md5("text").alias("tie_b"), said.alias("cost"))


def asked(facts: DataFrame) -> DataFrame:
    return facts.filter(c("id") % EVERY == 0).select("scope", "id", "e", F.array_distinct("lex").alias("lex"))


def fact_candidates(spark, sf_dir) -> DataFrame:
    f = facts_of(spark, sf_dir)
    return scan(f, asked(f), TOP_K)


def episode_candidates(spark, sf_dir) -> DataFrame:
    return scan(episodes_of(spark, sf_dir), asked(facts_of(spark, sf_dir)), TOP_K)


def pool_of(spark, sf_dir) -> DataFrame:
    """Facts and episodes in one pool; ``place`` puts facts first among equals, as their content key does."""
    facts = fact_candidates(spark, sf_dir).select(F.lit("fact").alias("kind"), F.lit(0).alias("place"), "*")
    return facts.unionByName(episode_candidates(spark, sf_dir).select(F.lit("episode").alias("kind"), F.lit(1).alias("place"), "*"))


def names_of(spark, sf_dir) -> DataFrame:
    """(id, names) of every text; a fact is about the first person that it names."""
    return read(spark, sf_dir, "documents").select(c("doc_id").alias("id"), entity_tokens(F.coalesce("text", F.lit(""))).alias("names"))


def fused(spark, sf_dir, pool: DataFrame) -> DataFrame:
    """The pool that passes the recall floor, scored over both kinds together, facts about others than asked for less, and ranked."""
    passed = pool.filter(c("distance") <= FLOOR).withColumn("similarity", 1 - c("distance"))
    named = names_of(spark, sf_dir)
    people = named.select(F.lit("fact").alias("kind"), "id", F.get("names", F.lit(0)).alias("person"))
    asked_for = named.filter(c("id") % EVERY == 0).select(c("id").alias("query_id"), c("names").alias("asked"))
    told = passed.join(people, ["kind", "id"], "left").join(asked_for, "query_id")
    scored = told.withColumn("score", F.round(relevance("similarity", "overlap", "query_id") * person_factor(c("person"), c("asked")), 6)).drop("person", "asked")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("recency"), "place", "tie_a", "tie_b", "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long"))


def contested(spark, sf_dir) -> DataFrame:
    """Facts with the other sides of their open contradictions, (id, siblings)."""
    text = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)).cast("long")
    docs = read(spark, sf_dir, "documents").select(c("doc_id").alias("id"), text.alias("cost"))
    f = read(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), "label", F.floor(c("vec_id") / 2).alias("pair")).join(docs, "id")
    sides = f.groupBy("label", "pair").agg(F.array_sort(F.collect_list(F.struct("id", "cost"))).alias("sides")).filter(F.size("sides") > 1)
    return sides.select(F.explode("sides").alias("own"), "sides").select("own.id", F.filter("sides", lambda x: x.id != c("own.id")).alias("siblings"))


def packed(spark, sf_dir, pool: DataFrame) -> DataFrame:
    """Every candidate's decision; contested facts bring their other sides."""
    ranked = fused(spark, sf_dir, pool).select("query_id", "rank", "kind", "id", "cost")
    sides = contested(spark, sf_dir).withColumn("kind", F.lit("fact"))
    return pack_packets(ranked.join(sides, ["kind", "id"], "left"), BUDGET)


@register("t1_vector_topk", f"WITH {FACTS} SELECT query_id, id AS fact_id, distance, by_vector AS rank FROM facts WHERE by_vector IS NOT NULL")
def t1_vector_topk(spark, sf_dir):
    return fact_candidates(spark, sf_dir).filter("by_vector is not null").select("query_id", c("id").alias("fact_id"), "distance", c("by_vector").alias("rank"))


@register("t2_lexical_topk", f"WITH {FACTS} SELECT query_id, id AS fact_id, overlap, by_lexemes AS rank FROM facts WHERE by_lexemes IS NOT NULL")
def t2_lexical_topk(spark, sf_dir):
    return fact_candidates(spark, sf_dir).filter("by_lexemes is not null").select("query_id", c("id").alias("fact_id"), "overlap", c("by_lexemes").alias("rank"))


@register("t3_episode_topk", f"WITH {ITEMS}, {AXES('ep', 'episodes')} SELECT query_id, id AS episode_id, by_vector, by_lexemes FROM episodes")
def t3_episode_topk(spark, sf_dir):
    return episode_candidates(spark, sf_dir).select("query_id", c("id").alias("episode_id"), "by_vector", "by_lexemes")


@register("r6_episode_candidates", f"WITH {ITEMS}, {AXES('ep', 'episodes')} SELECT query_id, conv_id, turn, distance, overlap, length(text) AS n_chars FROM episodes JOIN conversations ON id = conv_id * {TURNS} + turn")
def r6_episode_candidates(spark, sf_dir):
    """Episode candidates with what their events hold: only ids are ranked, texts are joined afterwards."""
    turns = read(spark, sf_dir, "conversations").select((c("conv_id") * TURNS + c("turn")).alias("id"), "conv_id", "turn", F.length("text").cast("long").alias("n_chars"))
    return episode_candidates(spark, sf_dir).join(turns, "id").select("query_id", "conv_id", "turn", "distance", "overlap", "n_chars")


@register("o1_union_distinct", f"WITH {FACTS} SELECT query_id, id AS fact_id FROM facts")
def o1_union_distinct(spark, sf_dir):
    """Candidates by either axis, once each."""
    return fact_candidates(spark, sf_dir).select("query_id", c("id").alias("fact_id"))


@register("r5_hydrated_axes", f"WITH {FACTS} SELECT query_id, id AS fact_id, distance, overlap, round(exp(-recency / 720.0), 6) AS recency, source FROM facts JOIN documents ON doc_id = id")
def r5_hydrated_axes(spark, sf_dir):
    """Candidates with all their axes; hours of age decay over thirty days."""
    source = read(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "source")
    return fact_candidates(spark, sf_dir).join(source, "id").select("query_id", c("id").alias("fact_id"), "distance", "overlap", F.round(F.exp(-c("recency") / 720.0), 6).alias("recency"), "source")


def below_floor(pool: DataFrame) -> DataFrame:
    return pool.select("query_id", "kind", "id", F.when(c("distance").isNull() | (c("distance") > FLOOR), "below_relevance_floor").alias("reason"))


@register("p5_recall_floor", f"WITH {POOL} SELECT query_id, kind, id, CASE WHEN distance IS NULL OR distance > {FLOOR} THEN 'below_relevance_floor' END AS reason FROM pool")
def p5_recall_floor(spark, sf_dir):
    return below_floor(pool_of(spark, sf_dir))


@register("t4_fusion_order", f"WITH {FUSED} SELECT query_id, kind, id, score, rank FROM ranked")
def t4_fusion_order(spark, sf_dir):
    return fused(spark, sf_dir, pool_of(spark, sf_dir)).select("query_id", "kind", "id", "score", "rank")


@register("t5_rerank_block", f"WITH {FUSED} SELECT query_id, kind, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= {BLOCK} THEN 0 ELSE 1 END, CASE WHEN rank <= {BLOCK} THEN overlap END DESC NULLS LAST, rank) AS place FROM ranked")
def t5_rerank_block(spark, sf_dir):
    """The word-overlap reranker over the first fifty."""
    return rerank_block(fused(spark, sf_dir, pool_of(spark, sf_dir)).drop("place"), "query_id", "rank", c("overlap"), BLOCK).select("query_id", "kind", "id", "place")


@register("w3_minmax", f"WITH {FUSED} SELECT query_id, kind, id, round(s, 6) AS similarity, round(l, 6) AS lexical FROM scaled")
def w3_minmax(spark, sf_dir):
    from ..operators.ranking import min_max

    passed = pool_of(spark, sf_dir).filter(c("distance") <= FLOOR).withColumn("similarity", 1 - c("distance"))
    return passed.select("query_id", "kind", "id", F.round(min_max("similarity", "query_id"), 6).alias("similarity"), F.round(min_max("overlap", "query_id"), 6).alias("lexical"))


@register("r12_greedy_pack", f"WITH RECURSIVE {PACKED} SELECT query_id, kind, id, used FROM decided WHERE action = 'included'")
def r12_greedy_pack(spark, sf_dir):
    return packed(spark, sf_dir, pool_of(spark, sf_dir)).filter("action = 'included'").select("query_id", "kind", "id", "used")


def context(spark, sf_dir) -> DataFrame:
    """Every candidate of every query, fact or episode, with its decision, the reason, and the budget used by then.

    The pool is written once; packing and the recall floor read it.
    """
    pool = written(pool_of(spark, sf_dir), "pool")
    decided = packed(spark, sf_dir, pool).select("query_id", "kind", "id", "action", "reason_code", (c("place") + 1).alias("rank"), "used")
    below = below_floor(pool).filter("reason is not null").select("query_id", "kind", "id", F.lit("excluded").alias("action"), c("reason").alias("reason_code"))
    return decided.unionByName(below, allowMissingColumns=True)


@register("r20_context", f"""WITH RECURSIVE {PACKED} SELECT query_id, kind, id, action, reason_code, place AS rank FROM decided
 UNION ALL SELECT query_id, kind, id, 'excluded', 'below_relevance_floor', NULL FROM pool WHERE distance IS NULL OR distance > {FLOOR}""")
def r20_context(spark, sf_dir):
    """Every candidate of every query, fact or episode, with its decision and the reason; contested facts with both sides."""
    return context(spark, sf_dir).drop("used")


SERVED = f"WITH RECURSIVE {PACKED}, served AS (SELECT query_id, id FROM decided WHERE action = 'included' AND kind = 'fact')"


@register("a23_gold_served", SERVED + """, hit AS (SELECT q.id, q.lang, coalesce(max((x.source IS NOT DISTINCT FROM q.source)::INT), 0) AS hit FROM f q LEFT JOIN served s ON s.query_id = q.id LEFT JOIN f x ON x.id = s.id AND s.query_id IS NOT NULL WHERE q.id % 20 = 0 GROUP BY 1, 2)
 SELECT lang, count(*) AS questions, round(avg(hit), 6) AS rate FROM hit GROUP BY lang""")
def a23_gold_served(spark, sf_dir):
    """The share of questions, by language, that were served one of their gold facts: those from the same source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    ids = read(spark, sf_dir, "embeddings").select(c("vec_id").alias("doc_id"))
    q = docs.join(ids, "doc_id").filter(c("doc_id") % EVERY == 0).withColumnsRenamed({"doc_id": "query_id", "source": "gold"})
    served = r12_greedy_pack(spark, sf_dir).filter("kind = 'fact'").join(docs.select(c("doc_id").alias("id"), "source"), "id")
    hits = served.join(q, "query_id").groupBy("query_id").agg(F.max(c("source").eqNullSafe(c("gold")).cast("int")).alias("hit"))
    scored = q.join(hits, "query_id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return scored.groupBy("lang").agg(F.count("*").alias("questions"), F.round(F.avg("hit"), 6).alias("rate"))


@register("a24_token_coverage", SERVED + """, own AS (SELECT id AS query_id, unnest(list_distinct(lex)) AS word FROM f WHERE id % 20 = 0), said AS (SELECT DISTINCT query_id, unnest(f.lex) AS word FROM served JOIN f USING (id))
 SELECT query_id, round(count(said.word) / count(*), 6) AS coverage FROM own LEFT JOIN said USING (query_id, word) GROUP BY query_id""")
def a24_token_coverage(spark, sf_dir):
    """The share of a question's own lexemes that the facts served to it hold."""
    f = facts_of(spark, sf_dir).select("id", "lex")
    own = f.filter(c("id") % EVERY == 0).select(c("id").alias("query_id"), F.explode(F.array_distinct("lex")).alias("word"))
    said = r12_greedy_pack(spark, sf_dir).filter("kind = 'fact'").join(f, "id").select("query_id", F.explode("lex").alias("word")).distinct().withColumn("hit", F.lit(1))
    return own.join(said, ["query_id", "word"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("coverage"))


@register("j7_nearest", f"""WITH {ITEMS} SELECT q.id AS query_id, x.id AS fact_id, round(list_cosine_distance(q.e, x.e), 6) AS distance, round(list_cosine_distance(q.e, x.e), 6) <= {SAME} AS same FROM f q JOIN f x ON q.scope = x.scope AND q.source IS NOT DISTINCT FROM x.source AND q.id <> x.id
 WHERE q.id % {EVERY} = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY distance, x.recency DESC, x.tie_a, x.tie_b, x.id) = 1""")
def j7_nearest(spark, sf_dir):
    """The nearest fact with equal qualifiers, and whether it is near enough to be the same: these are part of the scope, so that no other fact takes its place."""
    f = facts_of(spark, sf_dir).withColumn("scope", F.concat_ws("|", "scope", "tie_a"))
    return scan(f, asked(f), 1).filter("by_vector = 1").select("query_id", c("id").alias("fact_id"), "distance", (c("distance") <= SAME).alias("same"))


@register("t6_shortlist", f"""WITH {ITEMS} SELECT q.id AS query_id, x.id AS fact_id FROM f q JOIN f x ON q.scope = x.scope AND q.id <> x.id
 WHERE q.id % {EVERY} = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_distance(q.e, x.e), 6), x.recency DESC, x.tie_a, x.tie_b, x.id) <= 40""")
def t6_shortlist(spark, sf_dir):
    """All facts of a scope if they are forty at most, else the nearest forty: a rank says both."""
    f = facts_of(spark, sf_dir)
    return scan(f, asked(f), 40).filter("by_vector is not null").select("query_id", c("id").alias("fact_id"))


TOP_ENTITIES = f"""tok AS (SELECT unnest(regexp_extract_all(text, '{ENTITY}')) AS token FROM documents), top AS (SELECT token, count(*) AS n FROM tok WHERE lower(token) NOT IN ({NAMES}) GROUP BY token ORDER BY n DESC, token LIMIT 20)"""


@register("t7_per_entity_topk", f"""WITH {TOP_ENTITIES}, hit AS (SELECT token, doc_id, len(list_filter(regexp_extract_all(text, '{ENTITY}'), lambda x: x = token)) AS n FROM top, documents WHERE contains(text, token))
 SELECT token AS entity, doc_id, row_number() OVER (PARTITION BY token ORDER BY n DESC, doc_id) AS rank FROM hit WHERE n > 0 QUALIFY rank <= 5""")
def t7_per_entity_topk(spark, sf_dir):
    """The five facts that name each of the twenty most frequent entities most often."""
    tokens = read(spark, sf_dir, "documents").select("doc_id", F.explode(entity_tokens(c("text"))).alias("entity"))
    named = tokens.groupBy("entity", "doc_id").agg(F.count("*").alias("n"))
    top = named.groupBy("entity").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "entity").limit(20)
    return top_k(named.join(F.broadcast(top.select("entity")), "entity"), ["entity"], [F.desc("n"), c("doc_id")], 5).select("entity", "doc_id", "rank")


SPAN = lambda x: f"trim(regexp_replace(lower(replace({x}, '’', chr(39))), '\\s+', ' ', 'g'))"


@register("j12_span_containment", f"""WITH spans AS (SELECT conv_id, turn AS span_turn, text FROM conversations UNION ALL SELECT conv_id, turn + 1000, substring(text, 1, 12) FROM conversations UNION ALL SELECT conv_id, turn + 2000, ' ' FROM conversations),
 n AS (SELECT conv_id, count(*) AS turns, min(turn) AS first FROM conversations GROUP BY 1)
 SELECT s.conv_id, s.span_turn, CASE WHEN max(n.turns) = 1 THEN max(n.first) WHEN count(k.turn) = 1 THEN max(k.turn) END AS turn FROM spans s JOIN n USING (conv_id)
 LEFT JOIN conversations k ON k.conv_id = s.conv_id AND {SPAN('s.text')} <> '' AND contains({SPAN('k.text')}, {SPAN('s.text')}) GROUP BY 1, 2""")
def j12_span_containment(spark, sf_dir):
    """The chunk that a span quotes: the only chunk of its event, or the one that contains it, both normalised; else null.

    Spans are whole turns, their beginnings and blanks. A span meets the chunks of its own event only, by an equi join.
    """
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    made = lambda shift, text: F.struct((c("turn") + shift).alias("span_turn"), text.alias("span"))
    spans = turns.select("conv_id", F.explode(F.array(made(0, c("text")), made(1000, F.substring("text", 1, 12)), made(2000, F.lit(" ")))).alias("s")).select("conv_id", "s.*")
    n = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("turn").alias("first"))
    span = normalise_span(c("span"))
    held = (span != "") & F.contains(normalise_span(c("text")), span)
    found = spans.join(turns, "conv_id").groupBy("conv_id", "span_turn").agg(F.count_if(held).alias("hits"), F.max(F.when(held, c("turn"))).alias("hit"))
    return found.join(n, "conv_id").select("conv_id", "span_turn", F.when(c("turns") == 1, c("first")).when(c("hits") == 1, c("hit")).alias("turn"))


MULTI_HOP = PACKED + f""", inc AS (SELECT * FROM decided WHERE action = 'included'), spent AS (SELECT query_id, max(used) AS used FROM inc GROUP BY query_id),
 kept AS (SELECT DISTINCT query_id, id FROM inc WHERE kind = 'fact'),
 eps AS (SELECT conv_id * {TURNS} + turn AS id, {SAID} AS names FROM conversations),
 head AS (SELECT r.query_id, r.rank, unnest(list_distinct(coalesce(w.names, e.names))) AS entity FROM ranked r LEFT JOIN who w ON r.kind = 'fact' AND w.id = r.id LEFT JOIN eps e ON r.kind = 'episode' AND e.id = r.id WHERE r.rank <= 10),
 seeds AS (SELECT query_id, unnest(names) AS entity FROM kept JOIN who USING (id) UNION ALL SELECT query_id, entity FROM head WHERE query_id IN (SELECT query_id FROM kept) GROUP BY 1, 2 HAVING count(*) >= 2),
 ents AS (SELECT s.query_id, s.entity, row_number() OVER (PARTITION BY s.query_id ORDER BY count(*) DESC, s.entity) AS hop FROM seeds s JOIN who q ON q.id = s.query_id JOIN spent p ON p.query_id = s.query_id
   WHERE p.used < {BUDGET} AND NOT list_contains(list_transform(q.names, lambda x: lower(x)), lower(s.entity)) GROUP BY s.query_id, s.entity QUALIFY hop <= 2),
 hits AS (SELECT e.query_id, e.hop, e.entity, x.id, x.cost, row_number() OVER (PARTITION BY e.query_id, e.hop ORDER BY len(list_filter(x.lex, lambda w: w = lower(e.entity))) DESC, x.id) AS r
   FROM ents e JOIN f q ON q.id = e.query_id JOIN f x ON x.scope = q.scope AND x.id <> q.id AND list_contains(x.lex, lower(e.entity)) QUALIFY r <= 5),
 fresh AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.query_id = h.query_id AND k.id = h.id) AND h.id NOT IN (SELECT id FROM conf) QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY hop) = 1),
 more AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, r) AS n FROM fresh),
 fill(query_id, n, used, fits) AS (SELECT query_id, CAST(0 AS BIGINT), used, false FROM spent
   UNION ALL SELECT l.query_id, l.n, CASE WHEN g.used + l.cost <= {BUDGET} THEN g.used + l.cost ELSE g.used END, g.used + l.cost <= {BUDGET} FROM fill g JOIN more l ON l.query_id = g.query_id AND l.n = g.n + 1)
 SELECT l.query_id, l.hop, l.entity, l.id AS fact_id, g.used FROM fill g JOIN more l USING (query_id, n) WHERE g.fits"""


@register("r13_multi_hop", f"WITH RECURSIVE {MULTI_HOP}")
def r13_multi_hop(spark, sf_dir):
    """Facts that name what the packed facts and the pool's head name most, in what the one budget has left; contested facts stay out."""
    pool = written(pool_of(spark, sf_dir), "pool")
    named, facts = names_of(spark, sf_dir), facts_of(spark, sf_dir)
    turns = read(spark, sf_dir, "conversations").select((c("conv_id") * TURNS + c("turn")).alias("id"), entity_tokens(c("text")).alias("names"))
    every = named.withColumn("kind", F.lit("fact")).unionByName(turns.withColumn("kind", F.lit("episode")))
    decided = written(packed(spark, sf_dir, pool).filter("action = 'included'").select("query_id", "kind", "id", "used"), "packed")
    head = written(fused(spark, sf_dir, pool).filter(c("rank") <= HEAD).select("query_id", "rank", "kind", "id"), "head")
    queries = facts.filter(c("id") % EVERY == 0).select(c("id").alias("query_id"), "scope").join(named.withColumnRenamed("id", "query_id"), "query_id")
    words = facts.select("scope", "id", "cost", c("lex").alias("words"))
    own = queries.select("query_id", c("query_id").alias("id"))
    found = second_hop(decided.join(every, ["kind", "id"]), head.join(every, ["kind", "id"]), queries, words, BUDGET, own, contested(spark, sf_dir))
    return found.select("query_id", "hop", "entity", c("id").alias("fact_id"), "used")


@register("t4_legacy_order", f"""WITH {FUSED} SELECT query_id, kind, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, tie_a, tie_b, id) AS rank
 FROM (SELECT x.*, round((0.6 * x.similarity + 0.25 * 0.1 * x.overlap + 0.15 * exp(-x.recency / 720.0)) * CASE WHEN x.kind = 'fact' AND w.names[1] IS NOT NULL AND len(q.names) > 0 AND NOT list_contains(q.names, w.names[1]) THEN 0.7 ELSE 1.0 END, 6) AS score
   FROM passed x JOIN who q ON q.id = x.query_id LEFT JOIN who w ON x.kind = 'fact' AND w.id = x.id)""")
def t4_legacy_order(spark, sf_dir):
    """The older order: a sum of raw similarity, cover density and recency."""
    named = names_of(spark, sf_dir)
    people = named.select(F.lit("fact").alias("kind"), "id", F.get("names", F.lit(0)).alias("person"))
    asked_for = named.filter(c("id") % EVERY == 0).select(c("id").alias("query_id"), c("names").alias("asked"))
    pool = pool_of(spark, sf_dir).filter(c("distance") <= FLOOR).join(people, ["kind", "id"], "left").join(asked_for, "query_id")
    raw = legacy_score(1 - c("distance"), 0.1 * c("overlap"), F.exp(-c("recency") / 720.0))
    scored = pool.withColumn("score", F.round(raw * person_factor(c("person"), c("asked")), 6))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "place", "tie_a", "tie_b", "id")
    return scored.select("query_id", "kind", "id", F.row_number().over(w).cast("long").alias("rank"))


WORDS = "list_distinct(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]{{3,}}'), lambda w: lower(w)))"
WINDOW = PACKED + f""", ch AS (SELECT conv_id * {TURNS} + turn AS id, conv_id, conv_id % 10 AS scope, turn, greatest(1, (length(text) + 17 + length(role)) // 4) AS cost, {WORDS.format(x='text')} AS words FROM conversations WHERE role <> 'system'),
 side AS (SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM ch WINDOW w AS (PARTITION BY scope ORDER BY conv_id, turn)),
 inc AS (SELECT * FROM decided WHERE action = 'included'), spent AS (SELECT query_id, max(used) AS used FROM inc GROUP BY query_id HAVING max(used) < {BUDGET}),
 near AS (SELECT i.query_id, unnest([before, after]) AS id FROM inc i JOIN side USING (id) WHERE i.kind = 'episode'),
 src AS (SELECT i.query_id, ch.id, row_number() OVER (PARTITION BY i.query_id, i.id ORDER BY len(list_intersect(ch.words, fw.words)) DESC, ch.turn) AS r FROM inc i JOIN (SELECT id, {WORDS.format(x="coalesce(text, '')")} AS words FROM f) fw USING (id) JOIN ch ON ch.conv_id = i.id WHERE i.kind = 'fact' AND i.id % 4 <> 0),
 named AS (SELECT query_id, (id * {TURNS}) AS id FROM inc WHERE kind = 'fact' AND id % 4 = 0),
 wanted AS (SELECT query_id, id, min(reason) AS reason FROM (SELECT query_id, id, 'episode_neighbor' AS reason FROM near UNION ALL SELECT query_id, id, 'fact_source_turn' FROM src WHERE r = 1 UNION ALL SELECT query_id, id, 'fact_source_turn' FROM named) WHERE id IS NOT NULL GROUP BY 1, 2),
 more AS (SELECT w.query_id, w.id, w.reason, ch.cost, row_number() OVER (PARTITION BY w.query_id ORDER BY ch.conv_id, ch.turn) AS n FROM wanted w JOIN ch USING (id) WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.kind = 'episode' AND i.query_id = w.query_id AND i.id = w.id)),
 fill(query_id, n, id, reason, fits, used) AS (SELECT query_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', false, used FROM spent
   UNION ALL SELECT m.query_id, m.n, m.id, m.reason, g.used + m.cost <= {BUDGET}, CASE WHEN g.used + m.cost <= {BUDGET} THEN g.used + m.cost ELSE g.used END FROM fill g JOIN more m ON m.query_id = g.query_id AND m.n = g.n + 1)
 SELECT query_id, n - 1 AS place, id, CASE WHEN fits THEN 'included' ELSE 'excluded' END AS action, CASE WHEN fits THEN reason ELSE 'over_budget' END AS reason_code, used FROM fill WHERE n > 0"""


def turns_of(spark, sf_dir) -> DataFrame:
    """All turns as chunks, with or without a vector; those of the system are not trusted."""
    said = F.greatest(F.lit(1), F.floor((F.length("text") + 17 + F.length("role")) / 4)).cast("long")
    turns = read(spark, sf_dir, "conversations")
    return turns.select((c("conv_id") % 10).alias("scope"), (c("conv_id") * TURNS + c("turn")).alias("id"), c("conv_id").alias("event_id"), c("turn").alias("ordinal"), c("conv_id").alias("occurred_at"), said.alias("cost"), overlap_words(c("text")).alias("words"), (c("role") != "system").alias("trusted"))


@register("r14_context_window", f"WITH RECURSIVE {WINDOW}")
def r14_context_window(spark, sf_dir):
    """What surrounds every packet: turns next to its episodes, and the turns that its facts come from, in the budget left.

    A fact comes from the conversation of its number; every fourth one knows its turn, the first, the others have the turn with most
    of their words. The asking is after the last turn.
    """
    kept = written(packed(spark, sf_dir, pool_of(spark, sf_dir)).filter("action = 'included'").select("query_id", "kind", "id", "used"), "packed")
    texts = read(spark, sf_dir, "documents").select(c("doc_id").alias("id"), overlap_words(F.coalesce("text", F.lit(""))).alias("words"))
    own = texts.withColumn("chunk_id", F.when(c("id") % 4 == 0, c("id") * TURNS)).withColumn("event_id", c("id"))
    chunks = turns_of(spark, sf_dir)
    last = chunks.agg(F.max("occurred_at")).first()[0]
    queries = facts_of(spark, sf_dir).filter(c("id") % EVERY == 0).select(c("id").alias("query_id"), "scope", F.lit(last).cast("long").alias("as_of"))
    return context_window(kept, own, chunks, queries, BUDGET).drop("cost")


@register("j1_chunk_event", "SELECT c.conv_id, c.turn, d.source FROM conversations c JOIN documents d ON c.conv_id = d.doc_id")
def j1_chunk_event(spark, sf_dir):
    return read(spark, sf_dir, "conversations").join(read(spark, sf_dir, "documents").select("doc_id", "source"), c("conv_id") == c("doc_id")).select("conv_id", "turn", "source")


@register("j2_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j2_semi(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi")


@register("j3_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j3_anti(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


@register("j6_neighbours", twin("chunks", "SELECT subject, conv_id, turn, lag(conv_id) OVER w AS before_conv, lead(conv_id) OVER w AS after_conv FROM chunks WINDOW w AS (PARTITION BY subject ORDER BY occurred_at, conv_id, turn)"))
def j6_neighbours(spark, sf_dir):
    turns = chunks(spark, sf_dir).select("subject", "occurred_at", "conv_id", "turn")
    near = neighbours(turns, "subject", ["occurred_at", "conv_id", "turn"], ["conv_id"])
    return near.select("subject", "conv_id", "turn", c("before.conv_id").alias("before_conv"), c("after.conv_id").alias("after_conv"))


@register("o3_mixed_pool", twin("chunks", "SELECT 'fact' AS kind, event_id AS id, CAST(NULL AS BIGINT) AS ordinal FROM events UNION ALL SELECT 'episode', conv_id, turn FROM chunks"))
def o3_mixed_pool(spark, sf_dir):
    pool = read(spark, sf_dir, "events").select(F.lit("fact").alias("kind"), c("event_id").alias("id"))
    return pool.unionByName(chunks(spark, sf_dir).select(F.lit("episode").alias("kind"), c("conv_id").alias("id"), c("turn").alias("ordinal")), allowMissingColumns=True)


@register("o5_packet_merge", f"""WITH RECURSIVE {PACKED}, q AS (SELECT id AS query_id, scope FROM f WHERE id % {EVERY} = 0), inc AS (SELECT * FROM decided JOIN q USING (query_id) WHERE action = 'included'),
 pk AS (SELECT q.scope, q.query_id, coalesce(max(used), 0) AS used, count(i.id) AS n FROM q LEFT JOIN inc i USING (query_id) GROUP BY 1, 2),
 it AS (SELECT scope, kind, CASE WHEN kind = 'fact' THEN id ELSE id // {TURNS} END AS item, min(query_id) AS first_query FROM inc GROUP BY 1, 2, 3),
 n AS (SELECT scope, count(*) FILTER (kind = 'fact') AS facts, count(*) FILTER (kind = 'episode') AS episodes, sum(first_query) AS first_queries FROM it GROUP BY 1)
 SELECT pk.scope, count(*) AS packets, CAST(sum(used) AS BIGINT) AS tokens, max_by(CASE WHEN pk.n > 0 THEN 'ok' ELSE 'degraded' END, query_id) AS status, coalesce(any_value(facts), 0) AS facts, coalesce(any_value(episodes), 0) AS episodes, CAST(coalesce(any_value(first_queries), 0) AS BIGINT) AS first_queries FROM pk LEFT JOIN n USING (scope) GROUP BY pk.scope""")
def o5_packet_merge(spark, sf_dir):
    """A scope's packets in one: each fact and each episode's event once, from the first packet that has it; tokens summed, the last status."""
    q = facts_of(spark, sf_dir).filter(c("id") % EVERY == 0).select(c("id").alias("query_id"), "scope")
    kept = written(packed(spark, sf_dir, pool_of(spark, sf_dir)).filter("action = 'included'").select("query_id", "kind", "id", "used").join(q, "query_id"), "packed")
    sizes = kept.groupBy("query_id").agg(F.max("used").alias("used"), F.count("*").alias("n"))
    status = F.when(c("n") > 0, "ok").otherwise("degraded")
    packets = q.join(sizes, "query_id", "left").groupBy("scope").agg(F.count("*").alias("packets"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max_by(status, "query_id").alias("status"))
    item = F.when(c("kind") == "fact", c("id")).otherwise(F.floor(c("id") / TURNS))
    items = kept.groupBy("scope", "kind", item.alias("item")).agg(F.min("query_id").alias("first_query")).groupBy("scope").agg(F.count_if(c("kind") == "fact").alias("facts"), F.count_if(c("kind") == "episode").alias("episodes"), F.sum("first_query").alias("first_queries"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return packets.join(items, "scope", "left").select("scope", "packets", "tokens", "status", zero("facts"), zero("episodes"), zero("first_queries"))


#: Rows that are hydrated for a query at most; two axes of two kinds never have more.
HYDRATED = 256


@register("t8_hydrated", f"""WITH {POOL} SELECT query_id, kind, id, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY least(coalesce(by_vector, {HYDRATED}), coalesce(by_lexemes, {HYDRATED})), place, recency DESC, tie_a, tie_b, id) AS n FROM pool) WHERE n <= {HYDRATED}""")
def t8_hydrated(spark, sf_dir):
    """The rows whose texts are read: the best on either axis first, up to a cap."""
    best = F.least(F.coalesce("by_vector", F.lit(HYDRATED)), F.coalesce("by_lexemes", F.lit(HYDRATED)))
    return top_k(pool_of(spark, sf_dir), ["query_id"], [best, c("place"), F.desc("recency"), c("tie_a"), c("tie_b"), c("id")], HYDRATED, "n").select("query_id", "kind", "id", "n")


@register("f_chunk_messages", twin("chunks", "SELECT conv_id, turn, text FROM chunks"))
def f_chunk_messages(spark, sf_dir):
    return chunks(spark, sf_dir).select("conv_id", "turn", "text")


@register("f_relative_date", """SELECT event_id, CASE WHEN d = 0 THEN 'the day of the question' WHEN abs(d) >= 60 THEN abs(d) || ' days (~' || CAST(round_even(abs(d) / 30, 0) AS BIGINT) || ' months) ' || side || ' the question'
 WHEN abs(d) >= 14 AND abs(d) % 7 = 0 THEN abs(d) || ' days (' || abs(d) // 7 || ' weeks) ' || side || ' the question' ELSE abs(d) || CASE WHEN abs(d) = 1 THEN ' day ' ELSE ' days ' END || side || ' the question' END AS said
 FROM (SELECT event_id, d, CASE WHEN d > 0 THEN 'before' ELSE 'after' END AS side FROM (SELECT event_id, CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') AS BIGINT) * (1 + event_id % 4) AS d FROM events))""")
def f_relative_date(spark, sf_dir):
    d = F.date_diff(F.lit("2024-01-20").cast("date"), c("ts").cast("date")).cast("long") * (1 + c("event_id") % 4)
    return read(spark, sf_dir, "events").withColumn("d", d).select("event_id", relative_day(c("d")).alias("said"))


@register("f_recency", "SELECT event_id, round(exp(-greatest(date_diff('microsecond', ts, TIMESTAMP '2024-02-01 00:00:00'), 0) / 2592000000000.0), 6) AS recency FROM events")
def f_recency(spark, sf_dir):
    age = F.greatest(F.timestamp_diff("MICROSECOND", c("ts"), F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))), F.lit(0))
    return read(spark, sf_dir, "events").select("event_id", F.round(F.exp(-age / 2592000000000.0), 6).alias("recency"))


@register("f_freshness", """SELECT event_id, CASE WHEN horizon IS NULL OR age <= horizon THEN 'current' WHEN age <= 2 * horizon THEN 'unconfirmed' ELSE 'stale' END AS freshness FROM (SELECT event_id, date_diff('microsecond', ts, TIMESTAMP '2024-02-01 00:00:00') / 86400000000.0 AS age,
 CASE event_type WHEN 'click' THEN 7 WHEN 'view' THEN 10 END AS horizon FROM events)""")
def f_freshness(spark, sf_dir):
    age = F.timestamp_diff("MICROSECOND", c("ts"), F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))) / 86400000000.0
    horizon = F.when(c("event_type") == "click", 7).when(c("event_type") == "view", 10)
    return read(spark, sf_dir, "events").select("event_id", F.when(horizon.isNull() | (age <= horizon), "current").when(age <= 2 * horizon, "unconfirmed").otherwise("stale").alias("freshness"))


@register("f_directive_filter", "SELECT doc_id, regexp_matches(text, '(?i)(ignore|forget) (all|the|previous)|you must|from now on') AS directive FROM documents")
def f_directive_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", c("text").rlike("(?i)(ignore|forget) (all|the|previous)|you must|from now on").alias("directive"))


@register("f_need_classifier", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'how many|count|number of') THEN 'count' WHEN regexp_matches(lower(text), 'why|how|describe') THEN 'narrative' ELSE 'point_value' END AS need FROM conversations")
def f_need_classifier(spark, sf_dir):
    t = F.lower("text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(t.rlike("how many|count|number of"), "count").when(t.rlike("why|how|describe"), "narrative").otherwise("point_value").alias("need"))


@register("f_entity_adjust", "SELECT event_id, round(CASE WHEN user_id % 3 = 0 THEN value ELSE value * 0.7 END, 6) AS adjusted FROM events")
def f_entity_adjust(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(F.when(c("user_id") % 3 == 0, c("value")).otherwise(c("value") * 0.7), 6).alias("adjusted"))
