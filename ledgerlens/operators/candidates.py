"""Candidates of many queries at once: the nearest items of a query's scope, and those that share most of its lexemes.

Every query meets every item of its scope, in blocks: items and queries of a scope are dealt by hash into blocks of a bounded
number of rows, and each task holds one block of queries while the items of one block stream by, so a scope of a third of all
items is shared by many tasks. A task multiplies whole blocks and hands on the best ``k`` of each axis for each of its queries;
only those are shuffled and ranked again. Ties are broken by the items' own order in both steps. Rows reach Python a chunk at a
time, and of a chunk a query keeps ``k`` items at most, so a task's memory does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BLOCK, ITEM_BLOCK, CHUNK = 1_000, 50_000, 1_000
#: Columns of an item beside its vector and lexemes: newest first, then these two texts, then the id.
TIES = ("recency", "tie_a", "tie_b", "id")
SCHEMA = "query_id long, id long, distance double, overlap long, recency long, tie_a string, tie_b string, cost long"
ARROW = pa.schema([(name, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])
#: The axes, and whether the least value is the best.
BEST = {"distance": True, "overlap": False}


class Block:
    """One block of queries and the best items that it has met."""

    def __init__(self, k: int, axes: tuple = tuple(BEST)):
        self.k, self.ids, self.vectors, self.lexemes, self.cells, self.best = k, [], [], [], [], {axis: [] for axis in axes}
        self.matrix = None

    def add_queries(self, rows: pd.DataFrame) -> None:
        self.ids += rows["id"].tolist()
        self.vectors += rows["e"].tolist()
        self.lexemes += rows["lex"].tolist()
        self.cells += rows["cells"].tolist()

    def ready(self) -> None:
        self.matrix, self.known = _unit(self.vectors)
        self.vectors = []
        self.postings = _inverted(self.lexemes)
        self.readers = None if all(own is None for own in self.cells) else _inverted(self.cells)
        self.query_ids = np.array(self.ids, dtype=np.int64)
        #: The k-th value that a query has found so far: what lies behind it need not be kept.
        self.limit = {axis: np.full(len(self.ids), np.inf) for axis in BEST}

    def add_items(self, rows: pd.DataFrame) -> None:
        """Items come in runs of one cell, of which only the queries that read it need to see any."""
        if self.matrix is None:
            self.ready()
        rows = rows.sort_values(list(TIES), ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        cells, mask = rows["cell"].to_numpy(), None
        readers = np.arange(len(self.ids))
        if self.readers is not None:
            own = {cell: self.readers.get(cell, np.zeros(0, int)) for cell in set(cells.tolist())}
            readers = np.unique(np.concatenate(list(own.values())))
            if not len(readers):
                return
            mask = np.zeros((len(rows), len(readers)), bool)
            for cell, some in own.items():
                mask[np.ix_(cells == cell, np.searchsorted(readers, some))] = True
        vectors, known = _unit(rows["e"].tolist())
        apart = rows["id"].to_numpy()[:, None] == self.query_ids[None, readers]
        if mask is not None:
            apart |= ~mask
        if vectors.shape[1] and self.matrix.shape[1]:
            distance = np.round(1 - vectors @ self.matrix[readers].T, 6)
            distance[~(known[:, None] & self.known[None, readers])] = np.nan
        else:
            distance = np.full(apart.shape, np.nan)
        overlap = np.zeros(apart.shape)
        if self.postings:
            for i, lexemes in enumerate(rows["lex"]):
                if lexemes is not None and (hits := [self.postings[x] for x in lexemes if x in self.postings]):
                    overlap[i] = np.bincount(np.concatenate(hits), minlength=len(self.ids))[readers]
        for axis, values in (("distance", distance), ("overlap", -overlap)):
            values = np.where(apart | np.isnan(values) | (values == 0 if axis == "overlap" else False), np.inf, values)
            if axis in self.best:
                self.keep(axis, rows, readers, values, distance, overlap)

    def keep(self, axis: str, rows: pd.DataFrame, readers: np.ndarray, values: np.ndarray, distance: np.ndarray, overlap: np.ndarray) -> None:
        """Values are best where least, infinite ones are no candidates; rows are in the order of their ties, so each query hands on ``k`` at most."""
        values = np.where(values <= self.limit[axis][None, readers], values, np.inf)
        if len(rows) > self.k:
            kth = np.partition(values, self.k - 1, axis=0)[self.k - 1][None, :]
            below = values < kth
            level = (values == kth) & np.isfinite(values)
            kept = below | level & (np.cumsum(level, axis=0) <= self.k - below.sum(axis=0)[None, :])
        else:
            kept = np.isfinite(values)
        item, query = np.nonzero(kept)
        if not len(item):
            return
        found = rows[["id", "recency", "tie_a", "tie_b", "cost"]].iloc[item].reset_index(drop=True)
        found["query"], found["distance"], found["overlap"] = readers[query], distance[item, query], overlap[item, query].astype(np.int64)
        self.best[axis].append(found)
        if sum(map(len, self.best[axis])) > 2 * self.k * len(self.ids):
            self.cut(axis)

    def cut(self, axis: str) -> None:
        ordered = pd.concat(self.best[axis]).sort_values(["query", axis, *TIES], ascending=[True, BEST[axis], False, True, True, True])
        place = ordered.groupby("query", sort=False).cumcount()
        self.best[axis] = [ordered[place < self.k].reset_index(drop=True)]
        last = ordered[place == self.k - 1]
        self.limit[axis][last["query"].to_numpy()] = last[axis] if BEST[axis] else -last[axis]

    def finish(self) -> Iterator[pd.DataFrame]:
        for axis, own in self.best.items():
            if own:
                self.cut(axis)
        if found := [x for own in self.best.values() for x in own]:
            rows = pd.concat(found).drop_duplicates(["query", "id"])
            rows["query_id"] = self.query_ids[rows["query"].to_numpy()]
            yield rows[["query_id", "id", "distance", "overlap", "recency", "tie_a", "tie_b", "cost"]]


def _inverted(lists: list) -> dict:
    """For each value the places of the lists that hold it, ascending."""
    places: dict = {}
    for i, own in enumerate(lists):
        for x in own if own is not None else ():
            places.setdefault(x, []).append(i)
    return {x: np.array(at) for x, at in places.items()}


def _unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which of them have a direction; a null or zero vector has none."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            out[i] = v
    norms = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norms > 0, norms, 1)[:, None], norms > 0


def candidates(items: DataFrame, queries: DataFrame, k: int, axes: tuple = tuple(BEST)) -> DataFrame:
    """query_id, id, distance, overlap, recency, tie_a, tie_b, cost, by_vector, by_lexemes: the best ``k`` on either axis.

    ``items``: scope, id, e, lex, recency (long), tie_a, tie_b, cost; ``queries``: scope, id, e, lex. An item is no candidate of
    the query with its own id. The two ranks are null beyond ``k``; an item without a vector has no rank by vector, one that
    shares no lexeme none by lexemes. Null scopes meet nothing. If queries have ``cells`` (array<long>), they only meet the items
    whose ``cell`` (long) is among these. With one of ``axes`` only its best are sought; the other rank is then of no use.
    """
    if not (probing := "cells" in queries.columns):
        items, queries = items.withColumn("cell", F.lit(0).cast("long")), queries.withColumn("cells", F.lit(None).cast("array<long>"))
    parts = lambda df, size: F.ceil(F.col(df) / size).cast("int")
    counts = items.groupBy("scope").agg(F.count("*").alias("f")).join(queries.groupBy("scope").agg(F.count("*").alias("q")), "scope")
    counts = counts.select("scope", parts("f", ITEM_BLOCK).alias("fs"), parts("q", QUERY_BLOCK).alias("qs"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A cell's items stay together, so that a query goes only where it reads any.
    block = lambda cell, n: F.pmod(F.xxhash64(cell), F.col(n)).cast("int")
    facts = items.join(counts, "scope").withColumn("fb", block("cell", "fs") if probing else own("fs")).withColumn("qb", all_of("qs")).withColumn("is_item", F.lit(True))
    asked = queries.join(counts, "scope").withColumn("qb", own("qs")).withColumn("is_item", F.lit(False))
    if probing:
        where = asked.select("scope", "id", F.explode(F.array_distinct("cells")).alias("cell")).join(counts.select("scope", "fs"), "scope")
        where = where.groupBy("scope", "id", block("cell", "fs").alias("fb")).agg(F.collect_list("cell").alias("cells"))
        asked = asked.drop("cells").join(where, ["scope", "id"])
    else:
        asked = asked.withColumn("fb", all_of("fs"))
    both = facts.unionByName(asked, allowMissingColumns=True).select("scope", "qb", "fb", "is_item", "id", "e", "lex", "cell", "cells", F.coalesce("recency", F.lit(0)).alias("recency"), F.coalesce("tie_a", F.lit("")).alias("tie_a"), F.coalesce("tie_b", F.lit("")).alias("tie_b"), F.coalesce("cost", F.lit(0)).cast("long").alias("cost"))
    dealt = both.repartition("scope", "qb", "fb").sortWithinPartitions("scope", "qb", "fb", "is_item", "cell")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block = None, None
        told = lambda rows: pa.RecordBatch.from_pandas(rows, schema=ARROW, preserve_index=False)
        for batch in (whole.slice(at, CHUNK).to_pandas() for whole in batches for at in range(0, whole.num_rows, CHUNK)):
            keys = list(zip(batch["scope"], batch["qb"], batch["fb"], batch["is_item"]))
            # Runs by plain comparison: pandas takes texts for equal that differ behind a zero character.
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for at, end in zip(starts, [*starts[1:], len(keys)]):
                *key, is_item = keys[at]
                if key != place:
                    if block:
                        yield from map(told, block.finish())
                    place, block = key, Block(k, axes)
                (block.add_items if is_item else block.add_queries)(batch.iloc[at:end])
        if block:
            yield from map(told, block.finish())

    found = dealt.mapInArrow(scan, SCHEMA).withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))
    ties = [F.desc("recency"), F.col("tie_a"), F.col("tie_b"), F.col("id")]
    w = W.partitionBy("query_id")
    near = F.row_number().over(w.orderBy(F.col("distance").asc_nulls_last(), *ties))
    shared = F.row_number().over(w.orderBy(F.desc("overlap"), *ties))
    ranked = found.withColumn("by_vector", near.cast("long")).withColumn("by_lexemes", shared.cast("long"))
    ranked = ranked.withColumn("by_vector", F.when((F.col("by_vector") <= k) & F.col("distance").isNotNull(), F.col("by_vector")))
    ranked = ranked.withColumn("by_lexemes", F.when((F.col("by_lexemes") <= k) & (F.col("overlap") > 0), F.col("by_lexemes")))
    return ranked.filter("by_vector is not null or by_lexemes is not null")
