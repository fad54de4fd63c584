"""Statistics over events, traces and evaluation records; sampling and sharding."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import hygiene, weighted_score
from ..operators.ordering import dense_place, values_at
from ..sources.tables import chunks, events, read, twin
from .registry import register

c = F.col


@register("a1_filtered_counts", twin("facts", "SELECT count(*) AS facts, count(*) FILTER (status = 'active') AS active FROM facts"))
def a1_filtered_counts(spark, sf_dir):
    """An identity has one active fact, so actives need no window."""
    return read(spark, sf_dir, "events").agg(F.count("*").alias("facts"), F.count_distinct("user_id", "event_type").alias("active"))


@register("a2_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS subjects FROM events GROUP BY event_type")
def a2_count_distinct(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("subjects"))


@register("a4_group_count_max", "SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id")
def a4_group_count_max(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@register("a6_daily_zero_filled", "SELECT d.day, count(e.event_id) AS n FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-28', TIMESTAMP '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN events e ON CAST(e.ts AS DATE) = d.day GROUP BY d.day")
def a6_daily_zero_filled(spark, sf_dir):
    days = spark.sql("select explode(sequence(date'2024-01-28', date'2024-02-03')) as day")
    n = read(spark, sf_dir, "events").groupBy(c("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@register("a7_percentiles", "SELECT round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders")
def a7_percentiles(spark, sf_dir):
    """Between the two nearest ranks; null without traces."""
    o = read(spark, sf_dir, "orders").select(F.lit(0).alias("g"), "o_totalprice")
    n = o.groupBy("g").agg(F.count("o_totalprice").alias("n"))
    place = lambda p: (c("n") - 1) * F.lit(p)
    asked = n.select("g", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.floor(place(p)) + up).cast("long").alias("rank"), (F.lit(1 - up) + (2 * up - 1) * (place(p) - F.floor(place(p)))).alias("share")) for name, p in (("p50", 0.5), ("p99", 0.99)) for up in (0, 1)])).alias("x")).select("g", "x.name", (c("x.rank") + 1).alias("rank"), "x.share")
    found = values_at(o, ["g"], "o_totalprice", asked).filter("share > 0")
    part = lambda name: F.round(F.sum(F.when(c("name") == name, c("at_rank") * c("share"))), 6).alias(name)
    return found.agg(part("p50"), part("p99"))


@register("a8_null_safe_ratios", "SELECT user_id, round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'view'), 0), 6) AS ratio FROM events GROUP BY user_id")
def a8_null_safe_ratios(spark, sf_dir):
    t = c("event_type")
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.try_divide(F.count_if(t == "purchase"), F.count_if(t == "view")), 6).alias("ratio"))


@register("a10_json_sums", twin("ev", "SELECT event_type, CAST(sum(k) AS BIGINT) AS total FROM ev GROUP BY event_type"))
def a10_json_sums(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.sum("k").alias("total"))


@register("a11_reason_breakdown", "SELECT CASE WHEN event_type IN ('error', 'click') THEN event_type ELSE 'unclassified' END AS reason, count(*) AS n FROM events GROUP BY 1")
def a11_reason_breakdown(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.when(c("event_type").isin("error", "click"), c("event_type")).otherwise("unclassified").alias("reason")).agg(F.count("*").alias("n"))


LEAK = "WITH moment AS (SELECT l_partkey, min(l_shipdate) AS superseded_at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), leak AS (SELECT DISTINCT l.l_orderkey FROM lineitem l JOIN moment m USING (l_partkey) WHERE l.l_shipdate >= m.superseded_at AND l.l_linestatus = 'O')"


def leaked_traces(spark, sf_dir):
    """Traces that serve a part after it was superseded: an equi join with a residual on time."""
    lines = read(spark, sf_dir, "lineitem")
    moment = lines.filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.min("l_shipdate").alias("superseded_at"))
    return lines.filter("l_linestatus = 'O'").join(moment, "l_partkey").filter("l_shipdate >= superseded_at").select("l_orderkey").distinct()


@register("j4_leakage_join", LEAK + " SELECT l_orderkey FROM leak")
def j4_leakage_join(spark, sf_dir):
    return leaked_traces(spark, sf_dir)


@register("a13_leakage", LEAK + " SELECT round((SELECT count(*) FROM leak) / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 6) AS leakage")
def a13_leakage(spark, sf_dir):
    packets = read(spark, sf_dir, "lineitem").agg(F.count_distinct("l_orderkey").alias("n"))
    return leaked_traces(spark, sf_dir).agg(F.count("*").alias("leaked")).join(packets).select(F.round(F.try_divide("leaked", "n"), 6).alias("leakage"))


@register("a14_health_score", """SELECT user_id, round_even(100 * (coalesce(0.3 * injection, 0) + coalesce(0.3 * density, 0) + coalesce(0.4 * hygiene, 0)) / nullif((injection IS NOT NULL)::INT * 0.3 + (density IS NOT NULL)::INT * 0.3 + (hygiene IS NOT NULL)::INT * 0.4, 0), 1) AS score FROM
 (SELECT user_id, count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'view'), 0) AS injection, count(DISTINCT event_type) / count(*) AS density, greatest(0, 1 - 0.1 * count(*) FILTER (event_type = 'error')) AS hygiene FROM events GROUP BY user_id)""")
def a14_health_score(spark, sf_dir):
    """Weighted mean of the components that are known."""
    t = c("event_type")
    parts = read(spark, sf_dir, "events").groupBy("user_id").agg(F.try_divide(F.count_if(t == "purchase"), F.count_if(t == "view")).alias("injection"), (F.count_distinct("event_type") / F.count("*")).alias("density"), F.count_if(t == "error").alias("errors"))
    return parts.select("user_id", weighted_score({"injection": (0.3 * c("injection"), 0.3), "density": (0.3 * c("density"), 0.3), "hygiene": (hygiene(c("errors"), 4), 0.4)}).alias("score"))


@register("a16_open_conflicts", twin("ev", "SELECT count(*) AS n, min(first) AS oldest FROM (SELECT min(ts) AS first FROM ev GROUP BY user_id, event_type, k % 3 HAVING count(DISTINCT k) = 2)"))
def a16_open_conflicts(spark, sf_dir):
    sets = events(spark, sf_dir).groupBy("user_id", "event_type", c("k") % 3).agg(F.min("ts").alias("first"), F.count_distinct("k").alias("n")).filter("n = 2")
    return sets.agg(F.count("*").alias("n"), F.min("first").alias("oldest"))


@register("a17_eval_aggregate", "SELECT lang AS qtype, count(*) AS n, round(avg(quality), 6) AS accuracy, round(avg(n_chars), 6) AS mean_tokens FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def a17_eval_aggregate(spark, sf_dir):
    records = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return records.groupBy(c("lang").alias("qtype")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("accuracy"), F.round(F.avg("n_chars"), 6).alias("mean_tokens"))


@register("a18_nearest_rank", "SELECT o_orderpriority, list_sort(list(o_totalprice))[CAST(greatest(1, round_even(count(*) * 95 / 100.0, 0)) AS BIGINT)] AS p95 FROM orders GROUP BY 1")
def a18_nearest_rank(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    rank = F.greatest(F.lit(1.0), F.bround(F.count("*") * 95 / 100.0, 0)).cast("long")
    asked = o.groupBy("o_orderpriority").agg(rank.alias("rank"))
    return values_at(o, ["o_orderpriority"], "o_totalprice", asked).select("o_orderpriority", c("at_rank").alias("p95"))


@register("a20_composition", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def a20_composition(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@register("a21_entity_frequency", "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS token FROM conversations) GROUP BY token ORDER BY n DESC, token LIMIT 20")
def a21_entity_frequency(spark, sf_dir):
    tokens = read(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{2,})"), F.lit(1))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(20)


@register("a22_prf_document_frequency", twin("chunks", "SELECT token, count(DISTINCT conv_id) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS token FROM chunks) GROUP BY token HAVING count(DISTINCT conv_id) >= 2"))
def a22_prf_document_frequency(spark, sf_dir):
    tokens = chunks(spark, sf_dir).select("conv_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{2,})"), F.lit(1)))).alias("token"))
    return tokens.groupBy("token").agg(F.count_distinct("conv_id").alias("n")).filter("n >= 2")


@register("a27_identity_violations", twin("ev", "SELECT user_id, event_type, k, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1"))
def a27_identity_violations(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", "event_type", "k").agg(F.count("*").alias("n")).filter("n > 1")


@register("a28_subject_rollup", "SELECT c_custkey AS subject, count(o_orderkey) AS recalls, max(o_orderdate) AS last_seen FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def a28_subject_rollup(spark, sf_dir):
    """Aggregated before the join."""
    recalls = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_seen"))
    return read(spark, sf_dir, "customer").join(recalls, c("c_custkey") == c("o_custkey"), "left").select(c("c_custkey").alias("subject"), F.coalesce("n", F.lit(0)).alias("recalls"), "last_seen")


@register("w6_apportion", """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, n * 100 // sum(n) OVER () AS quota, n * 100 % sum(n) OVER () AS rest FROM n)
 SELECT lang, CAST(quota + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= 100 - sum(quota) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q""")
def w6_apportion(spark, sf_dir):
    return apportion(read(spark, sf_dir, "documents"), "lang", 100)


def apportion(df, stratum: str, size: int):
    """Largest remainders; one row for each stratum, so its windows are small."""
    n = df.groupBy(stratum).agg(F.count("*").alias("n"))
    q = n.join(n.agg(F.sum("n").alias("all"))).select(stratum, F.expr(f"n * {size} div all").alias("quota"), F.expr(f"n * {size} % all").alias("rest"))
    left = size - F.sum("quota").over(W.partitionBy(F.lit(0)))
    more = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("rest"), stratum)) <= left
    return q.select(stratum, (c("quota") + more.cast("int")).alias("quota"))


@register("w7_stratified_sample", """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, n * 100 // sum(n) OVER () AS quota, n * 100 % sum(n) OVER () AS rest FROM n),
 a AS (SELECT lang, quota + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= 100 - sum(quota) OVER () THEN 1 ELSE 0 END AS quota FROM q)
 SELECT doc_id, lang FROM (SELECT doc_id, d.lang, quota, row_number() OVER (PARTITION BY d.lang ORDER BY sha1('42:' || doc_id)) AS r FROM documents d JOIN a USING (lang)) WHERE r <= quota""")
def w7_stratified_sample(spark, sf_dir):
    """The rank filter by the whole sample's size comes first: it lets Spark limit each group before the shuffle."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("key", F.sha1(F.concat(F.lit("42:"), c("doc_id").cast("string"))))
    ranked = docs.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("key"))).filter("r <= 100")
    return ranked.join(F.broadcast(apportion(docs, "lang", 100)), "lang").filter("r <= quota").select("doc_id", "lang")


@register("w8_shard", "SELECT source, (dense_rank() OVER (ORDER BY first, source) - 1) % 4 AS shard FROM (SELECT source, min(doc_id) AS first FROM documents GROUP BY source)")
def w8_shard(spark, sf_dir):
    """Histories dealt in the order in which they first appear."""
    first = read(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))
    return dense_place(first, ["first", "source"], "place").select("source", (c("place") % 4).cast("long").alias("shard"))


@register("w9_suffix_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(greatest(1, length(text) // 4)) OVER w AS used, row_number() OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE used <= 200 OR r = 1")
def w9_suffix_budget(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    cost = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(cost).over(w).alias("used"), F.row_number().over(w).alias("r")).filter("used <= 200 or r = 1").select("conv_id", "turn")
