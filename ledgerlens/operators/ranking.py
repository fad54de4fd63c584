"""Ranking operators: fusion of relevance axes, top K for each query, packing under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of the two relevance axes, and the share of a budget that episodes may fill from the second one on.
W_SIMILARITY, W_LEXICAL, EPISODE_SHARE = 0.65, 0.35, 0.5
#: Weights of similarity, lexical rank and recency in the older sum of raw scores.
LEGACY = (0.6, 0.25, 0.15)


def min_max(value: str, query: str) -> Column:
    """Scaled to 0..1 within a query's pool; 0 where the pool is flat."""
    w = W.partitionBy(query)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0))


def relevance(similarity: str, lexical: str, query: str) -> Column:
    """The two axes, each scaled within its query's pool, in one score."""
    return W_SIMILARITY * min_max(similarity, query) + W_LEXICAL * min_max(lexical, query)


def legacy_score(similarity: Column, lexical: Column, recency: Column) -> Column:
    return LEGACY[0] * similarity + LEGACY[1] * lexical + LEGACY[2] * recency


def top_k(df: DataFrame, query: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each query; a total order makes it deterministic."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*query).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)


def rerank_block(pool: DataFrame, query: str, rank: str, again: Column, block: int = 50) -> DataFrame:
    """``place``: the first ``block`` of each query ordered anew by ``again``, highest first, then by rank; the rest stay behind."""
    head = F.col(rank) <= block
    w = W.partitionBy(query).orderBy(F.when(head, 0).otherwise(1), F.when(head, again).desc_nulls_last(), rank)
    return pool.withColumn("place", F.row_number().over(w).cast("long"))


def greedy_pack(ranked: DataFrame, query: str, rank: str, key: str, cost: str, budget: int) -> DataFrame:
    """In rank order, every item that still fits; one that does not is skipped, not an end.

    The pool of a query is bounded by its top K, so its fold runs inside one row.
    """
    pool = ranked.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(rank, key, cost))).alias("pool"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(ranked.dtypes)[key]}>").alias("kept"))
    step = lambda s, x: F.when(s.used + x[cost] <= budget, F.struct((s.used + x[cost]).alias("used"), F.array_append(s.kept, x[key]).alias("kept"))).otherwise(s)
    return pool.select(query, F.aggregate("pool", start, step).alias("s")).select(query, F.col("s.used").alias("used"), F.posexplode("s.kept").alias("place", key)).withColumn("place", F.col("place").cast("long"))


def pack_packets(pool: DataFrame, budget: int, query: str = "query_id", share: float = EPISODE_SHARE) -> DataFrame:
    """Every item's decision: query, place, kind, id, cost, action, reason_code, used (of the budget, after it).

    ``pool``: query, rank, kind (fact or episode), id, cost and siblings (array of struct<id, cost>, the other sides of an open
    contradiction; null or empty for none). In rank order what fits is included and what doesn't is skipped. From the second
    episode on, episodes together may fill ``share`` of the budget. A contested fact's siblings follow right after it. A budget of
    zero or less is an error.
    """
    if budget <= 0:
        raise ValueError("invalid_budget: a budget must be positive")
    siblings = F.coalesce("siblings", F.array().cast("array<struct<id:bigint,cost:bigint>>"))
    rows = pool.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", "kind", F.col("id").cast("long").alias("id"), F.col("cost").cast("long").alias("cost"), siblings.alias("siblings")))).alias("pool"))
    decision = "array<struct<kind:string,id:bigint,cost:bigint,action:string,reason_code:string,used:bigint>>"
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("used"), zero.alias("in_episodes"), F.lit(0).alias("episodes"), F.array().cast("array<bigint>").alias("packed"), F.array().cast(decision).alias("out"))

    def state(used, in_episodes, episodes, packed, out):
        return F.struct(used.alias("used"), in_episodes.alias("in_episodes"), episodes.alias("episodes"), packed.alias("packed"), out.alias("out"))

    def told(kind, x, action, reason, used):
        return F.struct(kind.alias("kind"), x.id.alias("id"), x.cost.alias("cost"), F.lit(action).alias("action"), reason.alias("reason_code"), used.alias("used"))

    def sibling(s, y):
        fits = s.used + y.cost <= budget
        kept = state(s.used + y.cost, s.in_episodes, s.episodes, F.array_append(s.packed, y.id), F.array_append(s.out, told(F.lit("fact"), y, "included", F.lit("conflict_disputed"), s.used + y.cost)))
        left = state(s.used, s.in_episodes, s.episodes, s.packed, F.array_append(s.out, told(F.lit("fact"), y, "excluded", F.lit("over_budget"), s.used)))
        return F.when(F.array_contains(s.packed, y.id), s).when(fits, kept).otherwise(left)

    def step(s, x):
        episode = x.kind == "episode"
        piled = episode & (s.episodes > 0) & (s.in_episodes + x.cost > share * budget)
        skip = lambda reason: state(s.used, s.in_episodes, s.episodes, s.packed, F.array_append(s.out, told(x.kind, x, "excluded", F.lit(reason), s.used)))
        reason = F.when(F.size(x.siblings) > 0, "conflict_disputed").otherwise("top_score")
        kept = state(s.used + x.cost, s.in_episodes + F.when(episode, x.cost).otherwise(zero), s.episodes + episode.cast("int"), F.when(episode, s.packed).otherwise(F.array_append(s.packed, x.id)), F.array_append(s.out, told(x.kind, x, "included", reason, s.used + x.cost)))
        with_siblings = F.aggregate(x.siblings, kept, sibling)
        again = ~episode & F.array_contains(s.packed, x.id)  # it came as another fact's sibling
        return F.when(again, s).when(piled, skip("over_episode_budget")).when(s.used + x.cost > budget, skip("over_budget")).otherwise(with_siblings)

    folded = rows.select(query, F.posexplode(F.aggregate("pool", start, step).out).alias("place", "d"))
    return folded.select(query, F.col("place").cast("long").alias("place"), "d.*")
