"""Pinned inputs, the merge of evaluation shards, and the report of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def verified(spark: SparkSession, path: str, sha256: str | None) -> str:
    """The path of one pinned file, if its bytes have this digest (or none is pinned); a data set file fits in one row."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()
    if found is None:
        raise ValueError(f"no file at {path}")
    if sha256 and found.h != sha256.lower():
        raise ValueError(f"{path} has sha256 {found.h}, not {sha256}")
    return path


def merged_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The question records of the shards of one run.

    Refuses shards of different data sets or samples (file digest, subset, kinds, seed, stratification) and a question that
    occurs twice.
    """
    shards = spark.read.option("multiLine", True).json(paths)
    sample = F.struct("dataset", *[F.get_json_object(F.to_json("config"), p).alias(n) for n, p in {"sha256": "$.dataset.sha256", "subset": "$.selection.subset", "seed": "$.selection.seed", "stratified": "$.selection.stratified"}.items()], F.array_sort(F.from_json(F.get_json_object(F.to_json("config"), "$.selection.types"), "array<string>")).alias("types"))
    if shards.select(sample.alias("s")).distinct().limit(2).count() > 1:
        raise ValueError("the shards are of different samples")
    records = shards.select(F.explode("questions").alias("q")).select("q.*")
    twice = records.groupBy("qid").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"question {twice[0].qid} is in more than one shard")
    return records


def write_report(records: DataFrame, summary: DataFrame, path: str, title: str) -> None:
    """All records as JSON lines under ``path/records`` and the summary, which has few rows, as a Markdown table under ``path/summary``."""
    records.write.json(f"{path}/records")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c(x).cast("string"), F.lit("-")) for x in summary.columns]), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + " - |" * len(summary.columns)]
    top = summary.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head)], "at int, value string")
    lines = top.unionByName(summary.select(F.lit(len(head)).alias("at"), row.alias("value")))
    lines.coalesce(1).sortWithinPartitions("at", "value").select("value").write.text(f"{path}/summary")
