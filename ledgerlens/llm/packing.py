"""Best-fit packing of tokenised documents into sequences of one capacity, by large-item matching.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so the plan is made on the driver from counts
per length, whatever the number of documents: pieces above a third of the capacity go at most two to a sequence, matched
greedily (the largest with the largest that still fits), then smaller pieces fill the smallest gap that holds them, and new
sequences when none does. Equal sequences are planned as one group with a multiplicity, so the plan stays within a few
times ``capacity`` rows. Pieces find their place by their rank among the pieces of the same length; ranks come from counts
per task and length, so no length, however common, meets in one task.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from .common import frugal, materialise
from .tokens import CACHE_SIZE, default_tokenizer, worker_coder


def _bytes_of(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = 2048, separator: int = 0, path: str | None = None, cache: int = CACHE_SIZE) -> DataFrame:
    """Every document's ids and the separator, cut at the capacity: key, piece, start, length, ids_crc32, and the piece's
    rank among those of its length in its task (part, rank)."""
    path = path or default_tokenizer()
    picked = docs.select(key, text)
    schema = StructType([picked.schema[0]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("part", "integer").add("rank", "long")
    arrow, end = to_arrow_schema(schema), np.array([separator], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal(drop=False)
        coder = worker_coder(("ids", path, cache), path, _bytes_of, b"".join, None, cache)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            row, piece, length, crc, rank = array("q"), array("i"), array("q"), array("q"), array("q")
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(coder.code(t) + end)
                for j in range(0, len(ids), 4 * capacity):
                    own = ids[j : j + 4 * capacity]
                    n = len(own) // 4
                    row.append(i)
                    piece.append(j // (4 * capacity))
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    rank.append(seen[n])
                    seen[n] += 1
            piece_np = np.array(piece, dtype=np.int32)
            columns = [batch.column(0).take(pa.array(np.array(row, dtype=np.int64))), piece_np, piece_np.astype(np.int64) * capacity, np.array(length), np.array(crc), np.full(len(row), part, np.int32), np.array(rank)]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return picked.mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """For counts of pieces by length: (length, first rank, first sequence, offset), each for as many pieces as follow up to
    the next first rank of that length; rank r lies in sequence ``first sequence + (r - first rank)``."""
    left = dict(counts)
    groups: list[tuple[int, list[tuple[int, int]]]] = []  # (number of sequences, [(length, times)])
    open_groups: dict[int, list[int]] = defaultdict(list)  # gap -> groups
    gaps: list[int] = []

    def add(n: int, items: list[tuple[int, int]]) -> None:
        groups.append((n, items))
        gap = capacity - sum(a * b for a, b in items)
        if gap and not open_groups[gap]:
            insort(gaps, gap)
        if gap:
            open_groups[gap].append(len(groups) - 1)

    large = sorted(x for x in left if 3 * x > capacity)
    for x in reversed(large):
        while left[x]:
            mate = next((y for y in reversed(large[: bisect_left(large, min(x, capacity - x) + 1)]) if left[y] >= 1 + (y == x)), None)
            n = left[x] if mate is None else left[x] // 2 if mate == x else min(left[x], left[mate])
            add(n, [(x, 1)] if mate is None else [(x, 2)] if mate == x else [(x, 1), (mate, 1)])
            left[x] -= n
            if mate is not None:
                left[mate] -= n
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[x]:
            at = bisect_left(gaps, x)
            if at == len(gaps):
                each = capacity // x
                if full := left[x] // each:
                    add(full, [(x, each)])
                if rest := left[x] % each:
                    add(1, [(x, rest)])
                left[x] = 0
                break
            gap = gaps[at]
            g = open_groups[gap].pop()
            if not open_groups[gap]:
                gaps.pop(at)
            n, items = groups[g]
            groups[g] = (0, [])
            each = min(gap // x, left[x])
            full = min(n, left[x] // each)
            add(full, [*items, (x, each)])
            left[x] -= full * each
            n -= full
            if n and left[x]:  # fewer than one sequence holds
                add(1, [*items, (x, left[x])])
                left[x], n = 0, n - 1
            if n:
                add(n, items)
    out, ranks, sequence = [], defaultdict(int), 0
    for n, items in groups:
        offset = 0
        for x, times in items if n else ():
            for _ in range(times):
                out.append((x, ranks[x], sequence, offset))
                ranks[x] += n
                offset += x
        sequence += n
    return out


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = 2048, separator: int = 0, path: str | None = None, cache: int = CACHE_SIZE) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the separator alone; repeated rows are packed as often as they occur; rows with a null key are
    packed too; an empty table gives no rows. ``cache`` chunks are kept by each worker; fewer take less memory and more time. Other columns are left out, so their names cannot clash.
    """
    cut = materialise(pieces(docs, text, key, capacity, separator, path, cache), "pieces")
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    places = sorted(plan({r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    table = np.array(places or [(0, 0, 0, 0)], dtype=np.int64).T
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, first, sequence, offset = shared.value
        lo, hi = np.searchsorted(lengths, length.values, "left"), np.searchsorted(lengths, length.values, "right")
        at = np.empty(len(length), dtype=np.int64)
        for x in np.unique(length.values):
            own = length.values == x
            a, b = lo[own][0], hi[own][0]
            at[own] = a + np.searchsorted(first[a:b], rank.values[own], "right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.values - first[at], "offset": offset[at]})

    ranked = cut.join(base, ["part", "length"]).withColumn("at", place("length", F.col("base") + F.col("rank")))
    return ranked.select(key, "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
