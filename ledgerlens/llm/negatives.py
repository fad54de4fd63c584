"""Hard-negative mining by ball trees and branch-and-bound.

Rows are dealt to cells: to the nearest of a bounded number of pivots, and a pivot's rows to parts of about ``PART`` by a hash
of their id, so that a cell fits one task whatever the shape of the data. A search sends each query to the cells that the
pivots' balls leave open, in blocks. There the task builds a ball tree of the cell's rows: a ball (centre c, radius r) bounds the
inner product of a query q with any row inside by q.c - |q| r and q.c + |q| r. Nodes are pruned level by level when their bounds
miss every window of the query or when their labels can't serve; leaves left over are visited best bound first, and a leaf is
pruned when its upper bound is strictly beneath the current kth score (an equal score may still win by its smaller id). The best
k of each cell meet in one ranking. All scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, materialise, unit_hash

#: Rows of a cell, about; rows of a leaf, at most; pivots, at most; queries of a block, about.
PART, LEAF, PIVOTS, BLOCK = 8192, 128, 256, 8192
#: Components are clamped to this size, so that sums of up to 4,096 products, and 90 times them, fit a long.
LARGEST = 1 << 22
LEAST = np.iinfo(np.int64).min


def scaled(vector: Column, by: int = 256) -> Column:
    """Integer components floor(by * x), clamped to +-``LARGEST``; null for a null vector or one with a null or non-finite component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * by))).cast("int"))
    return F.when(sound, whole)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of integers; shorter vectors are filled with zeros."""
    ends = vectors.offsets.to_numpy()
    lengths, flat = np.diff(ends), vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; in doubles where every partial sum is below 2^53."""
    most = lambda x: int(np.abs(x).max(initial=0))
    if most(a) * most(b) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class BallTree:
    """Nodes in breadth-first order: rows [start, end), children 2i+1 and 2i+2 of the same list, centre, radius, label range."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = np.arange(len(ids))
        self.start, self.end, self.child, self.centre, self.radius = [0], [len(ids)], [], [], []
        at = 0
        while at < len(self.start):
            lo, hi = self.start[at], self.end[at]
            own = rows[order[lo:hi]].astype(np.float64)
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            self.centre.append(centre)
            self.radius.append(away.max())
            if hi - lo <= LEAF:
                self.child.append(-1)
            else:
                one = own[away.argmax()]
                other = own[((own - one) ** 2).sum(axis=1).argmax()]
                middle = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own @ (other - one), middle)]
                self.child.append(len(self.start))
                self.start += [lo, lo + middle]
                self.end += [lo + middle, hi]
            at += 1
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.start, self.end, self.child = np.array(self.start), np.array(self.end), np.array(self.child)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.low = np.array([self.labels[a:b].min() for a, b in zip(self.start, self.end)])
        self.high = np.array([self.labels[a:b].max() for a, b in zip(self.start, self.end)])

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ball_bounds(queries, self.centre, self.radius)

    def search(self, own: np.ndarray, labels: np.ndarray, queries: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids, (queries, windows, k), of the best rows in each window [lo, hi]; scores without a row are ``LEAST``.

        ``own``: ids that a query does not find. ``same``: rows of the query's label, else rows of any other.
        """
        best, found = np.full((*lo.shape, k), LEAST), np.full((*lo.shape, k), np.iinfo(np.int64).max)
        lower, upper = self.bounds(queries)
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        leaf_q, leaf_n = [], []
        while len(q):
            fits = ((upper[q, node, None] >= lo[q]) & (lower[q, node, None] <= hi[q])).any(axis=1)
            fits &= serves(labels[q], self.low[node], self.high[node], same)
            q, node = q[fits], node[fits]
            inner = self.child[node] >= 0
            leaf_q.append(q[~inner])
            leaf_n.append(node[~inner])
            q, node = np.tile(q[inner], 2), np.concatenate((self.child[node[inner]], self.child[node[inner]] + 1))
        q, node = np.concatenate(leaf_q), np.concatenate(leaf_n)
        order = np.lexsort((-upper[q, node], q))
        q, node = q[order], node[order]
        turn = np.arange(len(q)) - np.searchsorted(q, q)
        for t in range(turn.max(initial=-1) + 1):
            q_t, n_t = q[turn == t], node[turn == t]
            floor = np.maximum(best[q_t, :, -1], lo[q_t])
            open_ = (upper[q_t, n_t, None] >= floor).any(axis=1)
            q_t, n_t = q_t[open_], n_t[open_]
            for n in np.unique(n_t):
                self._leaf(n, q_t[n_t == n], own, labels, queries, lo, hi, same, best, found)
        return best, found

    def _leaf(self, n, sel, own, labels, queries, lo, hi, same, best, found) -> None:
        part = slice(self.start[n], self.end[n])
        ids, scores = self.ids[part], dots(queries[sel], self.rows[part])
        fit = (self.labels[part] == labels[sel, None]) == same
        fit &= ids != own[sel, None]
        inside = fit[:, None] & (scores[:, None] >= np.maximum(lo[sel], best[sel, :, -1])[:, :, None]) & (scores[:, None] <= hi[sel][:, :, None])
        hit = inside.any(axis=(1, 2))
        if not hit.any():
            return
        sel, inside, scores = sel[hit], inside[hit], scores[hit]
        both = np.concatenate((best[sel], np.where(inside, scores[:, None], LEAST)), axis=2)
        names = np.concatenate((found[sel], np.broadcast_to(ids, inside.shape)), axis=2)
        first = np.lexsort((names, -both.astype(np.float64) if np.abs(scores).max() < 1 << 53 else ~both), axis=2)[:, :, : best.shape[2]]
        best[sel], found[sel] = np.take_along_axis(both, first, 2), np.take_along_axis(names, first, 2)


def ball_bounds(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Below and above every inner product of a query with a row of the ball, with room for rounding: (queries, balls)."""
    size = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))[:, None]
    middle, reach = queries.astype(np.float64) @ centre.T, size * radius
    room = 1e-6 + 1e-9 * size * (radius + np.sqrt((centre**2).sum(axis=1)))
    return middle - reach - room, middle + reach + room


def serves(label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> np.ndarray:
    """Whether a node with labels in [low, high] may hold a row of the query's label, or one of another."""
    return (low <= label) & (label <= high) if same else (low != label) | (high != label)


def _nearest(pivots: np.ndarray):
    """(pivot, distance) of each vector."""

    @F.pandas_udf("pivot int, away double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        frugal()
        for batch in batches:
            rows = matrix(pa.array(batch, pa.list_(pa.int32())), pivots.shape[1]).astype(np.float64)
            square = (rows**2).sum(axis=1)[:, None] - 2 * rows @ pivots.T + (pivots**2).sum(axis=1)
            near = square.argmin(axis=1)
            yield pd.DataFrame({"pivot": near.astype(np.int32), "away": np.sqrt(((rows - pivots[near]) ** 2).sum(axis=1))})

    return udf


class Cells:
    """Rows (id, label, vec) dealt to cells, with what is known of each pivot's rows."""

    def __init__(self, rows: DataFrame):
        told = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
        self.n, self.width = told[0], max(1, told[1] or 0)
        k = min(PIVOTS, max(1, -(-self.n // PART)))
        pivots = rows.select("vec").orderBy(unit_hash("id", 11), "id", "vec").limit(k).collect()  # PIVOTS at most
        self.pivots = np.array([list(p.vec) + [0] * (self.width - len(p.vec)) for p in pivots], np.float64).reshape(len(pivots), self.width)
        self.rows = rows
        if self.n:
            dealt = materialise(rows.withColumn("near", _nearest(self.pivots)("vec")).select("id", "label", "vec", "near.*"), "dealt")
            balls = dealt.groupBy("pivot").agg(F.max("away").alias("radius"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).orderBy("pivot").collect()
            self.own = [b.pivot for b in balls]
            self.radius, self.low, self.high = (np.array([b[c] for b in balls]) for c in ("radius", "low", "high"))
            self.radius = self.radius * (1 + 1e-9) + 1e-6
            self.parts = np.array([-(-b.n // PART) for b in balls])
            parts = F.element_at(F.create_map(*[F.lit(int(x)) for p, n in zip(self.own, self.parts) for x in (p, n)]), F.col("pivot"))
            self.rows = dealt.select("pivot", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "label", "vec")

    def route(self, windows: str, same: bool):
        """The cells (pivot, part) that a query's windows leave open."""
        own, centre, width = np.array(self.own), self.pivots[self.own], self.width
        radius, low, high, parts = self.radius, self.low, self.high, self.parts

        @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("part", T.IntegerType())])))
        def udf(label: pd.Series, vec: pd.Series, against: pd.Series) -> pd.Series:
            queries = matrix(pa.array(vec, pa.list_(pa.int32())), width)
            lo, hi = window_bounds(pa.array(against, pa.list_(pa.int64())))
            lower, upper = ball_bounds(queries, centre, radius)
            fits = ((upper[:, :, None] >= lo[:, None]) & (lower[:, :, None] <= hi[:, None])).any(axis=2)
            fits &= serves(label.to_numpy()[:, None], low, high, same)
            return pd.Series([[(int(own[c]), p) for c in np.flatnonzero(row) for p in range(int(parts[c]))] for row in fits], dtype=object)

        return udf("label", "vec", windows)


def window_bounds(against: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Score windows (lo, hi) of each query: 0.3 to 0.9 times each of its positives' scores; without any, all scores.

    ``against`` holds lists of positive scores, null where every score counts.
    """
    lists = against.to_pylist()
    most = max((len(x) for x in lists if x is not None), default=1) or 1
    lo, hi = np.full((len(lists), most), 1), np.zeros((len(lists), most), np.int64)
    for i, x in enumerate(lists):
        if x is None:
            lo[i], hi[i] = LEAST + 1, np.iinfo(np.int64).max
        else:
            scores = np.array(x, np.int64)
            lo[i, : len(x)], hi[i, : len(x)] = -((-30 * scores) // 100), (90 * scores) // 100
    return lo, hi


def _searched(width: int, k: int, same: bool):
    """Over batches sorted by cell and block, a cell's rows before its queries: the best k of the cell for each query and window."""

    def hits(tree: BallTree, batch: pa.RecordBatch) -> pa.RecordBatch:
        own, label, code = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "code"))
        lo, hi = window_bounds(batch.column("against"))
        best, found = tree.search(own, label, matrix(batch.column("vec"), width), lo, hi, k, same)
        q, w, r = np.nonzero(best > LEAST)
        cols = own[q], code[q], w.astype(np.int32), found[q, w, r], best[q, w, r]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "code", "window", "found", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        cell, tree, held = None, None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("pivot", "part", "block", "asks")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                part, here = batch.slice(a, b - a), tuple(keys[a, :3])
                if here != cell:
                    cell, tree, held = here, None, []
                if not keys[a, 3]:
                    held.append(part)
                    continue
                if tree is None and held:
                    ids = np.concatenate([x.column("id").to_numpy() for x in held])
                    labels = np.concatenate([x.column("label").to_numpy() for x in held])
                    rows = np.concatenate([matrix(x.column("vec"), width) for x in held])
                    if len(np.unique(ids)) < len(ids):  # repeated rows count once
                        _, first = np.unique(np.column_stack((ids, labels, rows)), axis=0, return_index=True)
                        ids, labels, rows = ids[first], labels[first], rows[first]
                    tree, held = BallTree(ids, labels, rows), []
                if tree is not None:
                    for at in range(0, len(part), 256):
                        yield hits(tree, part.slice(at, 256))

    return run


def search(cells: Cells, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, code, window, found, score, rank): for each window of each query the first k rows by score, then by id.

    ``queries`` has id, code, label, vec and ``against``, the positive scores that make its windows (null: one window of all scores).
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    block = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int")
    asked = queries.withColumn("cell", F.explode(cells.route("against", same)))
    asked = asked.select("cell.pivot", "cell.part", block.alias("block"), F.lit(1).alias("asks"), "id", "code", "label", "vec", "against")
    rows = cells.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("pivot", "part", "block", F.lit(0).alias("asks"), "id", F.lit(0).cast("long").alias("code"), "label", "vec", F.lit(None).cast("array<long>").alias("against"))
    dealt = rows.unionByName(asked).repartition("pivot", "part", "block").sortWithinPartitions("pivot", "part", "block", "asks")
    near = dealt.mapInArrow(_searched(cells.width, k, same), "anchor long, code long, window int, found long, score long")
    rank = F.row_number().over(W.partitionBy("anchor", "code", "window").orderBy(F.desc("score"), "found"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5, negatives: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of anchors, the rows whose key ``every`` divides.

    An anchor's positives are the first rows of its label with another key; for each, the negatives are the first rows of another
    label that score 0.3 to 0.9 times as high. A positive score of zero or less leaves a window of zero or none. Rows with a null
    key, label or vector, or a null or non-finite component take no part; equal rows (key, label and components) count once; shorter
    vectors are filled with zeros, components beyond +-16,384 are clamped. Empty tables, and anchors without positives, give no rows.
    """
    sound = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled(F.col(vector)).alias("vec"))
    cells = Cells(materialise(sound.dropna(), "vectors"))
    if not cells.n:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = cells.rows.filter(F.col("id") % every == 0).select("id", F.xxhash64("label", "vec").alias("code"), "label", "vec").dropDuplicates(["id", "code"])
    anchors = materialise(anchors, "anchors")
    first = search(cells, anchors.withColumn("against", F.lit(None).cast("array<long>")), positives, same=True)
    pos = materialise(first.groupBy("anchor", "code").agg(F.sort_array(F.collect_list(F.struct("rank", "found", "score"))).alias("pos")), "positives")
    asked = anchors.join(pos, (anchors.id == pos.anchor) & (anchors.code == pos.code)).select("id", anchors.code, "label", "vec", F.col("pos.score").alias("against"))
    found = search(cells, asked, negatives, same=False)
    named = found.join(pos, ["anchor", "code"]).withColumn("p", F.element_at("pos", F.col("window") + 1))
    return named.select(F.col("anchor").alias("anchor_id"), F.col("p.found").alias("positive_id"), "rank", F.col("found").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
