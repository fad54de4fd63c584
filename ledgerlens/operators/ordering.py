"""Ranks and order statistics of whole tables, without gathering a group: by counts in ranges of the sorted values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

RANGES = 64


def values_at(df: DataFrame, groups: list[str], value: str, asked: DataFrame) -> DataFrame:
    """For each row of ``asked`` (groups, ``rank`` from 1), the value of that rank within its group, as ``at_rank``.

    Values are counted by distinct value; ranges of those, whose borders come from a sketch of all values, are counted first, so
    only the range that holds a rank has its distinct values put in order. Nulls are no values.
    """
    borders = df.select(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 2000)).first()[0] or []
    edges = F.array(*[F.lit(b) for b in sorted(set(borders))]).cast(f"array<{dict(df.dtypes)[value]}>")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranged = counts.withColumn("range", F.size(F.filter(edges, lambda e: e < F.col("v"))))
    sums = ranged.groupBy(*groups, "range").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*groups).orderBy("range")  # RANGES rows at most
    starts = sums.select(*groups, "range", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(w).alias("upto"))
    holding = asked.join(starts, groups).filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("upto"))).drop("upto")
    own = ranged.join(holding.select(*groups, "range", "before").distinct(), [*groups, "range"])
    within = own.withColumn("last", F.sum("n").over(W.partitionBy(*groups, "range").orderBy("v")) + F.col("before"))
    placed = holding.join(within.select(*groups, "range", "v", "last", (F.col("last") - F.col("n")).alias("first")), [*groups, "range"])
    return placed.filter((F.col("rank") > F.col("first")) & (F.col("rank") <= F.col("last"))).select(*asked.columns, F.col("v").alias("at_rank"))


def dense_place(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Distinct rows of ``df`` with their place (from 0) by ``order``: sorted in ranges, whose counts give their offsets.

    The ranges are cut once and read twice, so the rows are expected to be stable under recomputation.
    """
    spread = df.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    offsets = spread.groupBy("_part").count()  # a row for each range
    before = F.coalesce(F.sum("count").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifted = spread.join(F.broadcast(offsets.select("_part", before.alias("_before"))), "_part")
    return shifted.withColumn(out, F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_before")).drop("_id", "_part", "_before")


def neighbours(df: DataFrame, scope: str, order: list[str], columns: list[str]) -> DataFrame:
    """``df`` with ``before`` and ``after``: structs of ``columns`` of the rows next to each one within its scope, null at its ends.

    The rows are sorted in ranges, so that a large scope is shared by many tasks. Within a range a window tells the neighbours; at
    its borders they come from the first and last rows of the scope's other ranges, a row for each range and scope. Rows should
    differ in ``order``.
    """
    own = F.struct(*columns)
    rows = written(df.repartitionByRange(scope, *order).withColumn("_part", F.spark_partition_id()), "in-ranges")
    w = W.partitionBy(scope, "_part").orderBy(*order)
    near = rows.withColumn("before", F.lag(own).over(w)).withColumn("after", F.lead(own).over(w))
    ends = rows.groupBy(scope, "_part").agg(F.min_by(own, F.struct(*order)).alias("first"), F.max_by(own, F.struct(*order)).alias("last"))
    across = W.partitionBy(scope).orderBy("_part")
    borders = ends.select(scope, "_part", F.lag("last").over(across).alias("_last"), F.lead("first").over(across).alias("_first"))
    told = near.join(borders, (near[scope].eqNullSafe(borders[scope])) & (near["_part"] == borders["_part"]), "left")
    return told.select(*[near[x] for x in df.columns], F.coalesce("before", "_last").alias("before"), F.coalesce("after", "_first").alias("after"))
