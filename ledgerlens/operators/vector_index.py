"""An inverted-file index over the vectors of many scopes, partitioned by scope and list.

Each scope's vectors are dealt to lists around centroids, a list for about ``LIST`` rows and ``MOST_LISTS`` at most; the centroids
are fitted by a few k-means steps on a bounded sample of the scope (``SAMPLE`` rows for each list, those of least hash), and then
every row is dealt to its nearest one. A scope of one list needs no centroid. For each list the index keeps its ball: centroid,
radius and number of rows, from which the similarity of any of its rows to a query is bounded.

A search takes the lists of a query's scope in the order of their centroids. With a number of ``probes`` it reads that many; how
many are needed for a recall is measured by ``probes_for`` on a bounded sample of rows against the exact search. Without, it is
exact: a first round reads as many lists as hold ``k`` rows, a second one those whose balls may hold a row at least as near as the
k-th found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .candidates import candidates

LIST, MOST_LISTS, SAMPLE, STEPS = 256, 1024, 32, 8
#: Rows by which probes are chosen, at most.
TRIED = 200
#: Room for rounding: similarities are compared after rounding to six places.
ROOM = 2e-6


@dataclass
class VectorIndex:
    """``lists``: rows with scope and list; ``balls``: scope, list, centre (null in a scope of one list), radius, n."""

    lists: DataFrame
    balls: DataFrame


def unit_rows(vectors, width: int | None = None) -> np.ndarray:
    """Rows of length one; null and zero vectors, and those of another width, are zero."""
    width = width or max((len(v) for v in vectors if v is not None), default=1)
    out = np.array([v if v is not None and len(v) == width else np.zeros(width) for v in vectors], float).reshape(len(vectors), width)
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def fitted(rows: np.ndarray, k: int) -> np.ndarray:
    """k-means on the sphere; the first centroids are rows far from those before them, and an empty cell keeps its centroid.

    Rows without a direction don't count; there are fewer centroids where there are fewer other rows.
    """
    if not (rows := rows[(rows != 0).any(axis=1)]).size:
        return np.zeros((1, rows.shape[1]))
    chosen, far = [0], 1 - rows @ rows[0]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 1 - rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(STEPS):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.divide(sums, size, out=centres.copy(), where=size > 1e-12)
    return centres


def _centroids(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """(scope, centres) of the scopes with several lists, each fitted in a task of its own on its bounded sample."""
    several = sizes.filter("lists > 1")
    hashed = F.xxhash64(F.lit(17), "id")
    sampled = items.join(several, "scope").select("scope", "lists", "id", "e")
    sampled = sampled.withColumn("r", F.row_number().over(W.partitionBy("scope").orderBy(hashed, "id"))).filter((F.col("r") <= SAMPLE * MOST_LISTS) & (F.col("r") <= SAMPLE * F.col("lists")))

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        rows = unit_rows(own.sort_values("r")["e"].tolist())
        return pd.DataFrame({"scope": [own["scope"].iloc[0]], "centres": [[c.tolist() for c in fitted(rows, int(own["lists"].iloc[0]))]]})

    kind = dict(items.dtypes)["scope"]
    return sampled.select("scope", "lists", "r", "e").groupBy("scope").applyInPandas(fit, f"scope {kind}, centres array<array<double>>")


def build(items: DataFrame) -> VectorIndex:
    """The index of items (scope, id, e and any others), written. Rows with a null scope are left out; null vectors are in list 0."""
    items = items.filter("scope is not null")
    counted = items.groupBy("scope").agg(F.count("*").alias("n"))
    sizes = written(counted.select("scope", F.least(F.lit(MOST_LISTS), F.ceil(F.col("n") / LIST)).cast("int").alias("lists"), F.ceil(F.col("n") / (LIST * MOST_LISTS)).cast("int").alias("shares")), "sizes")
    centres = written(_centroids(items, sizes), "centres")
    # A scope's rows are dealt to as many tasks as it has shares of rows, each of which reads the scope's centroids first.
    spread = items.join(sizes, "scope").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares") * 8).cast("int"))
    heads = centres.join(sizes, "scope").select("scope", "centres", F.explode(F.sequence(F.lit(0), F.col("shares") * 8 - 1)).alias("share"))
    keys = spread.select("scope", "share", "id", "e", F.lit(True).alias("is_item"))
    dealt = keys.unionByName(heads.withColumn("is_item", F.lit(False)), allowMissingColumns=True).repartition("scope", "share").sortWithinPartitions("scope", "share", "is_item")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, own = None, None
        for batch in batches:
            keys = list(zip(batch["scope"], batch["share"], batch["is_item"]))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for at, end in zip(starts, [*starts[1:], len(keys)]):
                part, (scope, share, is_item) = batch.iloc[at:end], keys[at]
                if (scope, share) != place:
                    place, own = (scope, share), None
                if not is_item:
                    own = np.array([list(c) for c in part["centres"].iloc[0]])
                    continue
                near, away = np.zeros(len(part), int), np.full(len(part), 2.0)
                if own is not None:
                    rows = unit_rows(part["e"].tolist(), own.shape[1])
                    similar = rows @ own.T
                    near = similar.argmax(axis=1)
                    away = np.sqrt(np.maximum(0, (rows * rows).sum(axis=1) + (own[near] ** 2).sum(axis=1) - 2 * similar[np.arange(len(rows)), near]))
                yield pd.DataFrame({"scope": part["scope"], "id": part["id"], "list": near.astype(np.int32), "away": away})

    kinds = dict(items.dtypes)
    placed = dealt.mapInPandas(deal, f"scope {kinds['scope']}, id {kinds['id']}, list int, away double")
    lists = written(items.join(placed, ["scope", "id"]), "lists")
    balls = lists.groupBy("scope", "list").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    balls = balls.join(centres, "scope", "left").select("scope", "list", F.get("centres", F.col("list")).alias("centre"), "radius", "n")
    return VectorIndex(lists.drop("away"), written(balls, "balls"))


def ranked_lists(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(scope, id, list) of queries (scope, id, e) and the lists of their scope: ``place`` from 1 by the centroid's similarity, ``bound``, ``before`` rows."""
    size = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    dot = F.aggregate(F.zip_with(F.col("e").cast("array<double>"), "centre", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    length = size(F.col("e").cast("array<double>"))
    similar = F.when(F.col("centre").isNull(), 0.0).when(F.coalesce(length, F.lit(0.0)) > 0, dot / length).otherwise(0.0)
    met = queries.join(index.balls, "scope").withColumn("similar", similar).withColumn("bound", F.when(F.col("centre").isNull(), 1.0).otherwise(F.col("similar") + F.col("radius")))
    met = met.select("scope", "id", "list", "n", "similar", "bound")
    w = W.partitionBy("scope", "id").orderBy(F.desc("similar"), "list")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return met.withColumn("place", F.row_number().over(w)).withColumn("before", before).drop("similar", "n")


def _scan(index: VectorIndex, queries: DataFrame, probed: DataFrame, k: int, both: bool = False) -> DataFrame:
    """The best ``k`` by vector of the lists that each query probes; many lists are scanned by one task, so that it hands on ``k`` for all of them."""
    lex = F.col("lex") if both else F.array().cast("array<string>").alias("lex")
    items = index.lists.select("scope", "id", "e", lex, F.col("list").cast("long").alias("cell"), "recency", "tie_a", "tie_b", "cost")
    cells = probed.groupBy("scope", "id").agg(F.collect_list(F.col("list").cast("long")).alias("cells"))
    asked = queries.select("scope", "id", "e", lex).join(cells, ["scope", "id"])
    return candidates(items, asked, k, ("distance",)).filter("by_vector is not null")


def nearest(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, both: bool = False) -> DataFrame:
    """The ``k`` nearest items of each query's scope, as ``candidates`` has them: those of ``probes`` lists, else exactly.

    Items need recency, tie_a, tie_b and cost. An item isn't found by the query with its own id. With ``both`` items and queries
    have lexemes, and what is found has its overlap.
    """
    lists = written(ranked_lists(index, queries), "probes")
    if probes is not None:
        return _scan(index, queries, lists.filter(F.col("place") <= probes), k, both)
    first = lists.filter(F.col("before") <= k)  # one row more than k, as the query's own may be among them
    found = written(_scan(index, queries, first, k, both), "first")
    floor = found.groupBy("query_id").agg(F.max(F.when(F.col("by_vector") == k, 1 - F.col("distance"))).alias("kth"))
    needed = lists.join(floor, lists.id == floor.query_id, "left").filter((F.col("before") <= k) | F.col("kth").isNull() | (F.col("bound") + ROOM >= F.col("kth")))
    if needed.filter(F.col("before") > k).isEmpty():
        return found
    return _scan(index, queries, needed.drop("query_id", "kth"), k, both)


def list_places(index: VectorIndex, queries: DataFrame, exact: DataFrame) -> DataFrame:
    """(place, n): of the exact results, how many lie in a query's first, second, ... list."""
    own = index.lists.select("id", "list")
    found = exact.select("query_id", "id").join(own, "id").select(F.col("query_id").alias("id"), "list")
    return found.join(ranked_lists(index, queries).select("id", "list", "place"), ["id", "list"]).groupBy("place").agg(F.count("*").alias("n"))


def probes_for(index: VectorIndex, queries: DataFrame, k: int, recall: float = 0.95) -> int:
    """The fewest lists with which a bounded sample of the queries (``TRIED`` of least hash) finds that share of its exact results."""
    sample = queries.orderBy(F.xxhash64(F.lit(23), "id"), "id").limit(TRIED)
    counts = sorted(list_places(index, sample, nearest(index, sample, k)).collect())  # MOST_LISTS rows at most
    total, met = sum(n for _, n in counts), 0
    for place, n in counts:
        met += n
        if met >= recall * total:
            return place
    return 1


def recalls(found: DataFrame, exact: DataFrame, column: Column | str = "query_id") -> DataFrame:
    """(query_id, hits, of): how many of each query's exact results a search has found."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.select("query_id", "id").join(hit, ["query_id", "id"], "left").groupBy(column).agg(F.count("hit").alias("hits"), F.count("*").alias("of"))
