"""Helpers shared by the corpus operators: tables of an input folder, shared scratch storage, fresh column names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Python batches are kept small, as a row may hold a very long text."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a local session (tests) gets a temporary folder; a cluster falls back to its warehouse,
    never to a folder of one machine.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="corpus-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return _own_dirs[app].rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, name))
    return spark.read.schema(df.schema).parquet(path)


#: What a worker keeps from task to task, by name; the tasks of another operator drop it.
kept: dict[tuple, object] = {}


def frugal(drop: bool = True) -> None:
    """Makes a Python worker give freed memory back: large arrays get pages of their own, and what lies free is returned now.

    What another operator's tasks left in ``kept`` goes first, unless ``drop`` is false.

    Workers live on from task to task, and by default the C library keeps what one of them freed. Elsewhere than on glibc
    nothing happens.
    """
    if drop:
        kept.clear()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # the size from which an allocation has pages of its own
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_bucket(key: str | Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n; a null key counts as the text ``null``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % n


def unit_hash(key: str | Column, seed: int) -> Column:
    """Seeded 63-bit hash of a key, the same in every run; nulls hash like the text ``null``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))), 1)


def in_order(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df``, written, with each row's place (from 0) by one column, nulls last: sorted in ranges, whose counts give their offsets."""
    last = [F.col(column).isNull(), F.col(column)]
    spread = df.repartitionByRange(*last).sortWithinPartitions(*last).withColumn(out, F.monotonically_increasing_id())
    placed = materialise(spread, "in-order")
    part, before, offsets = F.shiftright(out, 33), 0, []
    for p, n in sorted(placed.groupBy(part.alias("p")).count().collect()):  # a row for each partition
        offsets.append((p, before))
        before += n
    shift = df.sparkSession.createDataFrame(offsets, "p long, shift long")
    p = fresh(placed, "p")
    moved = placed.withColumn(p, part).join(F.broadcast(shift.withColumnRenamed("p", p)), p)
    return moved.withColumn(out, F.col(out).bitwiseAND((1 << 33) - 1) + F.col("shift")).drop(p, "shift")


#: Most rows of a slim table (a key and a number or two) that is broadcast; a longer one is joined by shuffling.
FEW_ROWS = 300_000


def broadcast_few(slim: DataFrame) -> DataFrame:
    """A slim written table, marked for broadcast if its counted rows are few."""
    return F.broadcast(slim) if slim.count() <= FEW_ROWS else slim
