"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a cluster has its warehouse, and a local session (tests) a folder of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app not in _own:
        local = master.startswith("local") and not master.startswith("local-cluster")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="ledger-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own: computed once, whoever reads it and however often, also when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
