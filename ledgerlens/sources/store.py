"""Tables as base and delta files under one root, merged when they are read.

A commit writes the new rows of some tables, dealt to folders by a hash of their key (``BUCKETS``), and then one file of the log
that names them; a job lost midway leaves the last state. Nobody overwrites anything, so writers need no lock: two that commit
at once both add their rows, and a read merges the rows of a key by the order of their commits (number, then a random name), the
last one or, for tables that keep the first, the first one counting. A row marked as gone hides its key. Readers of a few keys
read those keys' folders only. ``compact`` writes a table's merged rows, each with its own commit, as one base in place of the
commits it has read; commits made meanwhile stay beside it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
LOG = "seq long, commit string, table string, replaces array<string>"

c = F.col


@dataclass(frozen=True)
class Table:
    """``key`` tells rows apart; ``first``: of a key's rows the first commit's counts, else the last one's."""

    schema: str
    key: tuple[str, ...]
    first: bool = False

    @property
    def columns(self) -> list[str]:
        return [x.strip().split()[0] for x in self.schema.split(", ")]


def bucket_of(key: tuple[str, ...]):
    return F.pmod(F.xxhash64(*[c(k).cast("string") for k in key]), F.lit(BUCKETS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def log(self) -> list:
        """The log's rows, one for each commit and table; compaction keeps what is live of it small."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.root}/log").orderBy("seq", "commit").collect()
        except Exception as e:  # a new store has no log yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def live(self, name: str) -> list[str]:
        """The commits that make up a table now."""
        rows = [r for r in self.log() if r.table == name]
        gone = {x for r in rows for x in r.replaces or ()}
        return [r.commit for r in rows if r.commit not in gone]

    def commits(self, name: str) -> list[str]:
        """All commits that have ever brought rows of a table, compactions apart."""
        return [r.commit for r in self.log() if r.table == name and not r.replaces]

    def commit(self, replaces: dict[str, list[str]] | None = None, **rows: DataFrame) -> str:
        """Adds rows; with ``replaces`` they are a table's base in place of those commits and bring their own ``_at``."""
        replaces = replaces or {}
        seq = max((r.seq for r in self.log()), default=0) + 1
        name = f"{seq:012d}-{uuid.uuid4().hex}"
        for table, df in rows.items():
            own = self.tables[table]
            gone = c("_gone") if "_gone" in df.columns else F.lit(False)
            at = c("_at") if table in replaces else F.lit(name)
            made = df.select(*own.columns, gone.alias("_gone"), at.alias("_at"), bucket_of(own.key).alias("_b"))
            made.repartition("_b").write.partitionBy("_b").parquet(f"{self.root}/{table}/commit={name}")
        lines = [(seq, name, table, replaces.get(table)) for table in rows]
        self.spark.createDataFrame(lines, LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return name

    def stored(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        """All stored rows with ``_at`` and ``_gone``, unmerged; with ``keys``, those of the folders in which the keys lie."""
        own = self.tables[name]
        schema = f"{own.schema}, _gone boolean, _at string, _b int"
        commits = self.live(name)
        if not commits:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{name}/commit={x}" for x in commits]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").option("mergeSchema", "false").parquet(*paths)
        if keys is not None:
            wanted = [r[0] for r in keys.select(bucket_of(own.key)).distinct().collect()]  # BUCKETS at most
            rows = rows.filter(c("_b").isin(wanted)) if wanted else rows.filter(F.lit(False))
        return rows

    def merged(self, name: str, keys: DataFrame | None = None, hidden=None, stamps: bool = False) -> DataFrame:
        """The table as it is now. ``hidden``: a function from stored rows to those that may be seen, before they are merged."""
        own = self.tables[name]
        rows = self.stored(name, keys)
        rows = hidden(rows) if hidden else rows
        rest = [x for x in own.columns if x not in own.key]
        pick = F.min_by if own.first else F.max_by
        whole = F.struct(*[c(x) for x in rest], "_gone", "_at")
        one = rows.groupBy(*own.key).agg(pick(whole, F.struct("_at", F.xxhash64(*rest) if rest else F.lit(0))).alias("_row")).select(*own.key, "_row.*")
        return one.filter(~c("_gone")).select(*own.columns, *(["_at"] if stamps else []))

    def compact(self, name: str, hidden=None) -> None:
        """One base in place of a table's commits. Rows that are gone leave for good."""
        read = self.live(name)
        self.commit(replaces={name: read}, **{name: self.merged(name, hidden=hidden, stamps=True)})
