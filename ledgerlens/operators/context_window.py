"""The context window: what surrounds a packed packet, in what its budget has left.

Two kinds of chunks surround it: the turns next to each packed episode, and for each packed fact the turn that it was extracted
from: the chunk it names or else, of the chunks of its event, the one that shares most words with it. They never compete with
scored items; they come after them in the order of time and are included while they fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import neighbours

c = F.col


def source_turns(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id): the chunk that each packed fact (query_id, as_of, chunk_id, event_id, words) comes from.

    A fact without a chunk of its own has the chunk of its event with most of its words; of equals the first. Chunks after
    ``as_of`` don't count.
    """
    exact = facts.filter("chunk_id is not null").select("query_id", c("chunk_id").alias("id"))
    open_ = facts.filter("chunk_id is null and event_id is not null").select("query_id", "as_of", "event_id", "words")
    met = open_.join(chunks.select("event_id", "id", "ordinal", "occurred_at", c("words").alias("said")), "event_id").filter("occurred_at <= as_of")
    shared = F.size(F.array_intersect("words", "said"))
    best = met.groupBy("query_id", "event_id", "words").agg(F.min(F.struct((-shared).alias("n"), "ordinal", "id")).alias("m"))
    return exact.unionByName(best.select("query_id", "m.id"))


def context_window(packed: DataFrame, facts: DataFrame, chunks: DataFrame, queries: DataFrame, budget: int) -> DataFrame:
    """What is decided beyond the packed items: query_id, place, id, cost, action, reason_code, used.

    ``packed``: query_id, kind, id and used of the items included; ``facts``: id, chunk_id (null if unknown), event_id, words;
    ``chunks``: scope, id, event_id, ordinal, occurred_at, cost, words and trusted; ``queries``: query_id, scope, as_of. Neighbours
    stand next to an episode by (occurred_at, ordinal, id) among the trusted chunks of its scope, whether these have vectors or not;
    none is later than ``as_of``. A chunk that is packed already isn't decided again; one that is both a neighbour and a
    source is a neighbour. A query with no packed item, or no budget left, has no window.
    """
    trusted = chunks.filter("trusted")
    spent = packed.groupBy("query_id").agg(F.max("used").alias("used"))
    asked = queries.join(spent.filter(c("used") < budget), "query_id")
    episodes = packed.filter("kind = 'episode'").select("query_id", "id")
    near = neighbours(trusted.select("scope", "id", "ordinal", "occurred_at"), "scope", ["occurred_at", "ordinal", "id"], ["id"])
    sides = F.array_compact(F.array("before.id", "after.id"))
    beside = episodes.join(near, "id").select("query_id", F.explode(sides).alias("id"), F.lit("episode_neighbor").alias("reason"))
    own = packed.filter("kind = 'fact'").select("query_id", "id").join(facts, "id").join(asked.select("query_id", "as_of"), "query_id").drop("id")
    sources = source_turns(own, trusted).withColumn("reason", F.lit("fact_source_turn"))
    wanted = beside.unionByName(sources).groupBy("query_id", "id").agg(F.min("reason").alias("reason"))
    new = wanted.join(episodes, ["query_id", "id"], "left_anti").join(asked, "query_id").join(trusted.select("id", "occurred_at", "ordinal", "cost"), "id").filter("occurred_at <= as_of")
    line = new.groupBy("query_id", "used").agg(F.array_sort(F.collect_list(F.struct("occurred_at", "ordinal", "id", F.col("cost").cast("long").alias("cost"), "reason"))).alias("line"))
    # A query's window is bounded by its packet, so its fold runs inside one row.
    decision = "array<struct<id:bigint,cost:bigint,action:string,reason_code:string,used:bigint>>"
    start = F.struct(c("used").cast("long").alias("used"), F.array().cast(decision).alias("out"))

    def step(s, x):
        fits = s.used + x.cost <= budget
        told = lambda action, reason, used: F.struct(x.id.alias("id"), x.cost.alias("cost"), F.lit(action).alias("action"), reason.alias("reason_code"), used.alias("used"))
        kept = F.struct((s.used + x.cost).alias("used"), F.array_append(s.out, told("included", x.reason, s.used + x.cost)).alias("out"))
        left = F.struct(s.used.alias("used"), F.array_append(s.out, told("excluded", F.lit("over_budget"), s.used)).alias("out"))
        return F.when(fits, kept).otherwise(left)

    folded = line.select("query_id", F.posexplode(F.aggregate("line", start, step).out).alias("place", "d"))
    return folded.select("query_id", c("place").cast("long").alias("place"), "d.*")
