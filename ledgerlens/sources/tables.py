"""The model's tables (events, facts, chunks, traces) as views over the input folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured events, with the counter ``k`` of their properties."""
    return read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def close_intervals(facts: DataFrame, identity: list[str], at: str, key: str) -> DataFrame:
    """Each fact ends where the next of its identity begins; the last is active, the others superseded by their successor."""
    w = W.partitionBy(*identity).orderBy(at, key)
    return facts.withColumn("valid_to", F.lead(at).over(w)).withColumn("supersedes_id", F.lag(key).over(w)).withColumn("status", F.when(F.lead(key).over(w).isNull(), "active").otherwise("superseded"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state fact for every event: identity (user, event type), valid from the event on."""
    return close_intervals(events(spark, sf_dir).withColumnRenamed("ts", "valid_from"), ["user_id", "event_type"], "valid_from", "event_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for every conversation turn, in ten subjects."""
    turns = read(spark, sf_dir, "conversations")
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=F.col("conv_id").cast("int"))
    return turns.select("conv_id", "turn", "role", (F.col("conv_id") % 10).alias("subject"), at.alias("occurred_at"), F.trim(F.concat_ws(": ", "role", "text")).alias("text"))


#: The same views for the SQL twins.
SQL = {
    "ev": "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)",
    "facts": """facts AS (SELECT event_id, ts AS valid_from, user_id, event_type, value, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        lead(ts) OVER w AS valid_to, lag(event_id) OVER w AS supersedes_id, CASE WHEN lead(event_id) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status
        FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))""",
    "chunks": """chunks AS (SELECT conv_id, turn, role, conv_id % 10 AS subject, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) AS occurred_at,
        trim(role || ': ' || text) AS text FROM conversations)""",
}


def twin(views: str, body: str) -> str:
    """A SQL twin over some of the views."""
    return "WITH " + ", ".join(SQL[v] for v in views.split()) + " " + body
