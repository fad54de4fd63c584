"""Retrieval by indexes: the same candidates as by scanning, and the recall of a probed search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lexical_index, vector_index
from ..operators.indexed import indexed_candidates
from ..sources.scratch import written
from ..sources.tables import read
from .registry import register
from .retrieval import EVERY, FACTS, TOP_K, asked, facts_of

c = F.col


@register("r4_indexed_candidates", f"WITH {FACTS} SELECT query_id, id AS fact_id, distance, overlap, by_vector, by_lexemes FROM facts")
def r4_indexed_candidates(spark, sf_dir):
    """Fact candidates of every query from the inverted file and the posting blocks, exactly."""
    facts = written(facts_of(spark, sf_dir), "facts")
    vectors, lexemes = vector_index.build(facts), lexical_index.build(facts)
    return indexed_candidates(vectors, lexemes, asked(facts), TOP_K).select("query_id", c("id").alias("fact_id"), "distance", "overlap", "by_vector", "by_lexemes")


@register("t2_lexical_index", f"WITH {FACTS} SELECT query_id, id AS fact_id, overlap, by_lexemes AS rank FROM facts WHERE by_lexemes IS NOT NULL")
def t2_lexical_index(spark, sf_dir):
    facts = written(facts_of(spark, sf_dir), "facts")
    return lexical_index.best(lexical_index.build(facts), asked(facts), TOP_K).select("query_id", c("id").alias("fact_id"), "overlap", c("by_lexemes").alias("rank"))


def all_vectors(spark, sf_dir) -> DataFrame:
    """Every vector, in one scope."""
    none = F.lit("")
    return read(spark, sf_dir, "embeddings").select(F.lit("all").alias("scope"), c("vec_id").alias("id"), c("embedding").alias("e"), F.array().cast("array<string>").alias("lex"), F.lit(0).cast("long").alias("recency"), none.alias("tie_a"), none.alias("tie_b"), F.lit(1).cast("long").alias("cost"))


@register("t1_probed_recall", None)
def t1_probed_recall(spark, sf_dir):
    """For each query over all vectors: how many of its nearest 64 the probed lists hold, and of how many lists it read."""
    rows = all_vectors(spark, sf_dir)
    index, queries = vector_index.build(rows), asked(rows)
    probes = vector_index.probes_for(index, queries, TOP_K)
    exact = written(vector_index.nearest(index, queries, TOP_K), "exact")
    found = vector_index.recalls(vector_index.nearest(index, queries, TOP_K, probes), exact)
    return found.select("query_id", "hits", "of", F.lit(probes).alias("probes"), F.lit(index.balls.count()).alias("lists"))


@register("t1_vector_index", f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % {EVERY} = 0)
 SELECT query_id, vec_id AS item_id, round(list_cosine_distance(e, CAST(embedding AS DOUBLE[])), 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM q JOIN embeddings ON vec_id <> query_id QUALIFY rank <= {TOP_K}""")
def t1_vector_index(spark, sf_dir):
    """The nearest 64 of all vectors to every query, exactly, by the balls' bounds."""
    rows = all_vectors(spark, sf_dir)
    return vector_index.nearest(vector_index.build(rows), asked(rows), TOP_K).select("query_id", c("id").alias("item_id"), "distance", c("by_vector").alias("rank"))
