"""The write path as streams: capture once, consolidate in order for each identity, count by day.

``consolidate`` keeps one small state for each identity (project or user, predicate), whatever the number of its events;
``plans.ledger`` has the same decisions as a batch query, and the tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISIONS = "user_id long, event_type string, event_id long, decision string, active_id long, supersedes_id long, reinforced long"
STATE = "value long, active_id long, at_us long, reinforced long"


def capture_once(events: DataFrame, key: str | list[str], at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events of a stream, each key once while its repeats arrive within ``delay``; keys older than that leave the state."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key] if isinstance(key, str) else key)


def append_new(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends rows with a key the table at ``path`` lacks; a batch that is run again adds nothing.

    Of repeats within a batch the first by all its columns stays.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy(key).agg(F.min(F.struct(*[c for c in batch.columns if c != key])).alias("r")).select(key, "r.*").select(*batch.columns)
        known = spark._jvm.org.apache.hadoop.fs.Path(path)
        if known.getFileSystem(spark._jsc.hadoopConfiguration()).exists(known):
            first = first.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti").select(*batch.columns)
        first.write.mode("append").parquet(path)

    return write


def capture_ever(events: DataFrame, key: str | list[str]) -> DataFrame:
    """Events of a stream, each key once for good: the keys seen are the stream's state, dealt by key, so no stored row is read again."""
    return events.dropDuplicates([key] if isinstance(key, str) else key)


def batches_to(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink with a folder for each batch, written anew if the batch is run again; it reads nothing that is stored.

    With ``capture_ever`` before it every key is stored once, whatever is repeated and whenever a run is taken up again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def sessions(events: DataFrame, at: str = "ts", by: str = "user_id", gap: str = "6 hours", delay: str | None = "1 day") -> DataFrame:
    """Each subject's sessions: ``by``, start, end of the last event's gap, and n events no two neighbours of which are ``gap`` apart or more.

    In a stream a session is final once the watermark has passed its end; an event that comes later than ``delay`` is dropped,
    even if it would have joined two sessions. Over a table give no ``delay``: there is no watermark, and no event is late.
    """
    rows = events.withWatermark(at, delay) if delay else events
    return rows.groupBy(F.session_window(at, gap).alias("s"), by).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def daily_counts(events: DataFrame, at: str = "ts", by: str = "event_type", delay: str = "1 day") -> DataFrame:
    """Events by day and kind; a day is final once the watermark has passed it, and later events are dropped."""
    day = F.window(at, "1 day")
    return events.withWatermark(at, delay).groupBy(day, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), by, "n")


def _decide(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    value, active, at, reinforced = state.get if state.exists else (None, None, None, 0)
    rows = pd.concat(list(batches)).sort_values(["at_us", "event_id"])
    out = []
    for event, own_at, own in zip(rows["event_id"], rows["at_us"], rows["k"]):
        if at is not None and own_at < at:  # an older event changes nothing that is active
            out.append((*key, event, "late", active, None, reinforced))
            continue
        if active is not None and own == value:
            reinforced += 1
            out.append((*key, event, "reinforce", active, None, reinforced))
        else:
            out.append((*key, event, "create" if active is None else "supersede", event, active, 0))
            value, active, reinforced = own, event, 0
        at = own_at
    state.update((int(value), int(active), int(at), int(reinforced)))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])
    frame["supersedes_id"] = frame["supersedes_id"].astype("Int64")
    yield frame


def consolidate(events: DataFrame) -> DataFrame:
    """What each event of a stream does to its identity's fact: create, reinforce, supersede, or late.

    Events have user_id, event_type, event_id, ts and k (the value, a null counting as -1). Within a micro-batch they are
    taken by time, then id; an event older than what its identity has seen is late.
    """
    slim = events.select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.coalesce("k", F.lit(-1)).cast("long").alias("k"))
    return slim.groupBy("user_id", "event_type").applyInPandasWithState(_decide, DECISIONS, STATE, "append", GroupStateTimeout.NoTimeout)
