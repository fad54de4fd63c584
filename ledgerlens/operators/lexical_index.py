"""An inverted index over the lexemes of many scopes, searched by upper bounds.

Items of a scope stand in blocks of about ``BLOCK``, by the magnitude of their length, so that a block's items can score alike. For
each block and lexeme there is one posting row: the largest count in an item and the number of items. An item's score is the number of its words that are lexemes of the query, which is its cover density but for a constant.

A query meets the heads of its lexemes' postings first: the sum of their largest counts bounds every item of a block. The blocks of
the highest bounds that hold enough items are scored, and the k-th score found there is a floor: only blocks whose bound reaches it
are read besides. No other items are touched, and the result is that of scoring all of them. Blocks are scored whole, many in one
task (``candidates``), which hands on the best of each query: a shared lexeme is no row of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .candidates import candidates

BLOCK = 2048


@dataclass
class LexicalIndex:
    """``postings``: scope, lexeme, block, top, n; ``items``: the blocks' rows, with their lexemes and what ranks ties."""

    postings: DataFrame
    items: DataFrame


def build(items: DataFrame) -> LexicalIndex:
    """The index of items (scope, id, lex as words with repeats, recency, tie_a, tie_b, cost), written; null scopes are left out."""
    tier = F.length(F.bin(F.greatest(F.lit(1), F.size("lex"))))
    rows = items.filter("scope is not null and size(lex) > 0").withColumn("tier", tier)
    tiers = rows.groupBy("scope", "tier").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    block = F.col("tier") * (1 << 40) + F.pmod(F.xxhash64("id"), F.col("parts"))
    spread = written(rows.join(tiers, ["scope", "tier"]).select("scope", "id", block.alias("cell"), "lex", *[x for x in rows.columns if x == "e"], "recency", "tie_a", "tie_b", "cost"), "blocks")
    # An item's words are counted within its row, so only blocks' heads are shuffled.
    words = F.array_distinct("lex")
    once = spread.filter(F.size(words) == F.size("lex")).select("scope", F.col("cell").alias("block"), F.explode("lex").alias("lexeme"), F.lit(1).cast("long").alias("n"))
    again = spread.filter(F.size(words) < F.size("lex")).select("scope", "id", F.col("cell").alias("block"), F.explode("lex").alias("lexeme")).groupBy("scope", "block", "id", "lexeme").agg(F.count("*").alias("n")).drop("id")
    postings = once.unionByName(again).groupBy("scope", "lexeme", "block").agg(F.max("n").alias("top"), F.count("*").alias("n"))
    return LexicalIndex(written(postings, "postings"), spread)


def _scores(index: LexicalIndex, queries: DataFrame, blocks: DataFrame, k: int, both: bool = False) -> DataFrame:
    """The first ``k`` by cover density of the blocks (query_id, scope, block) that each query reads."""
    vector = F.col("e") if both else F.lit(None).cast("array<double>").alias("e")
    cells = blocks.groupBy("scope", F.col("query_id").alias("id")).agg(F.collect_list("block").alias("cells"))
    asked = queries.select("scope", "id", vector, F.array_distinct("lex").alias("lex")).join(cells, ["scope", "id"])
    return candidates(index.items.select("scope", "id", "cell", "lex", vector, "recency", "tie_a", "tie_b", "cost"), asked, k, ("overlap",)).filter("by_lexemes is not null")


def touched(index: LexicalIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The lexemes asked (scope, query_id, lexeme), and the blocks (scope, query_id, block, bound) whose items may be among the first k."""
    asked = written(queries.filter("scope is not null").select("scope", F.col("id").alias("query_id"), F.explode(F.array_distinct("lex")).alias("lexeme")), "asked")
    heads = asked.join(index.postings.select("scope", "lexeme", "block", "top", "n"), ["scope", "lexeme"])
    blocks = written(heads.groupBy("scope", "query_id", "block").agg(F.sum("top").alias("bound"), F.max("n").alias("least")), "blocks")
    w = W.partitionBy("scope", "query_id").orderBy(F.desc("bound"), "block").rowsBetween(W.unboundedPreceding, -1)
    first = blocks.withColumn("before", F.coalesce(F.sum("least").over(w), F.lit(0))).filter(F.col("before") <= k)  # the query itself may be one
    found = _scores(index, queries, first, k)
    kth = found.filter(F.col("by_lexemes") == k).select("query_id", F.col("overlap").alias("floor"))
    needed = blocks.join(kth, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
    return asked, written(needed.select("scope", "query_id", "block", "bound", "floor"), "needed")


def best(index: LexicalIndex, queries: DataFrame, k: int, both: bool = False) -> DataFrame:
    """(query_id, id, distance, overlap, recency, tie_a, tie_b, cost, by_lexemes): the first ``k`` of each query's scope by cover density.

    Ties go to the newest, then by the two texts and the id. Items without a lexeme of the query aren't found, nor is an item by
    the query with its own id. With ``both`` items and queries have vectors, else the distance is null.
    """
    blocks = touched(index, queries, k)[1]
    return _scores(index, queries, blocks, k, both).select("query_id", "id", "distance", "overlap", "recency", "tie_a", "tie_b", "cost", "by_lexemes")
