"""Candidates of both axes from indexes, with each one's value on the other axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import lexical_index, vector_index
from .lexical_index import LexicalIndex
from .vector_index import VectorIndex


def build(items: DataFrame) -> tuple[VectorIndex, LexicalIndex]:
    """Both indexes of items (scope, id, e, lex as words with repeats, recency, tie_a, tie_b, cost)."""
    return vector_index.build(items), lexical_index.build(items)


def indexed_candidates(vectors: VectorIndex, lexemes: LexicalIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """What ``candidates`` gives, found by the indexes; with ``probes`` the vector axis is as good as that many lists."""
    # Each axis is scanned with the other one's values, as filling them in afterwards would carry both texts for each pair.
    near = written(vector_index.nearest(vectors, queries, k, probes, both=True).drop("by_lexemes"), "near")
    said = written(lexical_index.best(lexemes, queries, k, both=True), "said")
    told = ["distance", "overlap", "recency", "tie_a", "tie_b", "cost"]
    pairs = near.alias("n").join(said.alias("s"), ["query_id", "id"], "full")
    return pairs.select("query_id", "id", *[F.coalesce(f"n.{x}", f"s.{x}").alias(x) for x in told], "by_vector", "by_lexemes")
