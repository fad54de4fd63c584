"""Merging subjects: many requests at once, chained to their last target, with tombstones and receipts.

A subject that is merged leaves its name as an alias of kind ``merged`` (the tombstone), so later captures and questions find the
one that lives on. Chains are followed by pointer jumping: each round doubles the steps that every name has taken, so a chain of n
merges takes log2 n joins, and what still moves after that goes round in a circle, which is refused.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

c = F.col
TOMBSTONE = "merged"
ALIAS_KEY = ["project_id", "alias_kind", "alias_value"]


def followed(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of single steps (project_id, source, target), a source at most once: where each source ends, and the sources that never do."""
    n = steps.count()
    at = written(steps.select("project_id", "source", "target"), "steps")
    for _ in range(ceil(log2(n + 1)) + 1 if n else 0):
        onward = at.select("project_id", c("source").alias("target"), c("target").alias("onward"))
        at = written(at.join(onward, ["project_id", "target"], "left").select("project_id", "source", F.coalesce("onward", "target").alias("target")), "steps")
    moving = at.join(steps.select("project_id", c("source").alias("target")).distinct(), ["project_id", "target"], "left_semi")
    circles = written(moving.select("project_id", "source"), "circles")
    return at.join(circles, ["project_id", "source"], "left_anti"), circles


def plan_merges(pairs: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (project_id, source, target) judged, and the moves (project_id, source, target) of subjects to where they end.

    A target that is itself a tombstone stands for what became of it. Errors are ``invalid_merge`` (an empty name, or the same
    twice), ``already_merged`` (the source is a tombstone, or another request of the batch, first by target, has taken it) and
    ``circular_merge``. A repeated request is the same request.
    """
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    dead = aliases.filter(c("alias_kind") == TOMBSTONE).groupBy("project_id", "alias_value").agg(F.min("canonical_subject_id").alias("heir"))
    asked = pairs.select("project_id", "source", "target").distinct()
    asked = asked.join(dead.select("project_id", c("alias_value").alias("source"), c("heir").alias("_gone")), ["project_id", "source"], "left")
    asked = asked.join(dead.select("project_id", c("alias_value").alias("target"), c("heir").alias("_heir")), ["project_id", "target"], "left").withColumn("to", F.coalesce("_heir", "target"))
    sound = asked.filter(~blank("source") & ~blank("target") & c("_gone").isNull() & (c("source") != c("to")))
    first = sound.groupBy("project_id", "source").agg(F.min(F.struct("to", "target")).alias("_first"))
    steps = written(first.select("project_id", "source", c("_first.to").alias("target")), "merges")
    ends, circles = followed(steps)
    judged = asked.join(first, ["project_id", "source"], "left").join(circles.withColumn("_circle", F.lit(True)), ["project_id", "source"], "left")
    error = (
        F.when(blank("source") | blank("target") | (c("source") == c("target")), "invalid_merge")
        .when(c("_gone").isNotNull(), "already_merged").when(c("source") == c("to"), "circular_merge")
        .when(c("_first.target") != c("target"), "already_merged").when(c("_circle"), "circular_merge")
    )
    return judged.select("project_id", "source", "target", error.alias("error")), ends


def moved(rows: DataFrame, ends: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Rows with the subjects that live on."""
    to = ends.select("project_id", c("source").alias(subject), c("target").alias("_to"))
    return rows.join(to, ["project_id", subject], "left").withColumn(subject, F.coalesce("_to", subject)).select(rows.columns)


def repointed(aliases: DataFrame, ends: DataFrame) -> DataFrame:
    """The aliases with those of a merged subject pointing where it ends, and a tombstone for each merged subject."""
    kept = moved(aliases, ends, "canonical_subject_id")
    graves = ends.select("project_id", F.lit(TOMBSTONE).alias("alias_kind"), c("source").alias("alias_value"), c("target").alias("canonical_subject_id"))
    return kept.unionByName(graves.join(aliases.select(*ALIAS_KEY), ALIAS_KEY, "left_anti"))


def receipts(ends: DataFrame, tables: dict[str, DataFrame], aliases: DataFrame) -> DataFrame:
    """For each move: project_id, source, target, and how many rows of each table, and aliases, it has taken along."""
    out = ends
    counted = {**{f"{name}_moved": (t, "subject_id") for name, t in tables.items()}, "aliases_repointed": (aliases, "canonical_subject_id")}
    for name, (t, subject) in counted.items():
        own = t.groupBy("project_id", c(subject).alias("source")).agg(F.count("*").alias(name))
        out = out.join(own, ["project_id", "source"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.select("project_id", "source", "target", *counted)
