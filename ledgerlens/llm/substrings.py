"""Repeated passages across and within texts, by difference-cover anchors.

A difference cover of a period v is a set of residues such that any two positions, each shifted by the same amount below v, both
fall on it. So of two equal windows one shift below v leads to anchors, windows of ``window - v + 1`` words that start on cover
positions in both texts: only cover positions are hashed (5 of 21), and equal windows share an anchor. Anchors that occur once
lead nowhere. Around each other anchor the windows that contain it are hashed in full (128 bits), which extends the match to its
exact ends without ever pairing occurrences: a window is repeated if its hash occurs twice.

Equal texts are one class. What many texts share is combined by each task before it is shuffled, so no key gathers them: a task
sends one witness of an anchor that it has seen twice, and full windows are counted by partial aggregation. Only windows that turn
out to be single are sent back to their text, by hash and place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import frugal, materialise

#: Perfect difference sets: every non-zero difference modulo v arises exactly once.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Fewest words of an anchor, where the window allows: shorter ones recur by chance.
ANCHOR = 12
#: Odd multipliers of the two rolling hashes, and seeds of their word hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Anchors that a task combines at once; distinct words whose hashes it keeps.
AT_ONCE, WORDS = 1_000_000, 200_000


def cover(window: int) -> tuple[int, np.ndarray, int]:
    """(v, cover as flags by residue, words of an anchor) for windows of so many words."""
    v = max(v for v in COVERS if v == 1 or window - v + 1 >= min(ANCHOR, window - 1))
    flags = np.zeros(v, bool)
    flags[list(COVERS[v])] = True
    return v, flags, window - v + 1


class _Hashes(dict):
    """64-bit hashes of words, computed once while there is room."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value


def rolling(h: np.ndarray, words: int, base: int) -> np.ndarray:
    """The polynomial hash, modulo 2^64, of each window of so many words."""
    base, done, out, power = np.uint64(base), 0, None, np.uint64(1)
    part, length, scale = h, 1, base  # windows of a power of two, and base to its power
    with np.errstate(over="ignore"):
        while True:
            if words & length:
                if out is None:
                    out, done, power = part, length, scale
                else:
                    n = max(0, len(h) - done - length + 1)
                    out, done, power = out[:n] * scale + part[done : done + n], done + length, power * scale
            if 2 * length > words:
                return out
            n = max(0, len(h) - 2 * length + 1)
            part, length, scale = part[:n] * scale + part[length : length + n], 2 * length, scale * scale


def split(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def identity(text: str) -> list[Column]:
    """What names a class of equal texts: 96 bits of two hashes; null is as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("id"), (F.crc32(whole.cast("binary")) - (1 << 31)).cast("int").alias("id2")]


def _anchors(window: int):
    """Anchors of classes (id, id2, text): (key, sure, id, id2, place). Those that the task has seen twice are sure, but for a witness."""
    v, flags, size = cover(window)

    def combined(key: np.ndarray, id_: np.ndarray, id2: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(key, kind="stable")
        key, id_, id2, place = key[order], id_[order], id2[order], place[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        twice = ~first | ~np.concatenate((first[1:], [True]))
        for sure, sel in ((False, first), (True, twice)):
            cols = np.where(sure, id_[sel], key[sel]), np.full(sel.sum(), sure), id_[sel], id2[sel], place[sel]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "sure", "id", "id2", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        hashes, held, n = _Hashes(1), [], 0
        for batch in batches:
            id_, id2 = (batch.column(c).to_numpy() for c in ("id", "id2"))
            for i, text in enumerate(batch.column("text")):
                words = split(text.as_py())
                if len(words) < window:
                    continue
                h = rolling(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), size, BASES[0]).view(np.int64)
                place = np.flatnonzero(np.resize(flags, len(h)))
                held.append((h[place], np.full(len(place), id_[i]), np.full(len(place), id2[i]), place.astype(np.int32)))
                n += len(place)
                if n >= AT_ONCE:
                    yield from combined(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if held:
            yield from combined(*map(np.concatenate, zip(*held)))

    return run


def starts(n: int, places: np.ndarray, window: int) -> np.ndarray:
    """Where windows of a text of n words start that contain one of the anchors."""
    v = cover(window)[0]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(places - (v - 1), 0), 1)
    np.add.at(change, places + 1, -1)
    return np.flatnonzero(np.cumsum(change)[: n - window + 1] > 0)


def _windows(window: int):
    """Windows around the anchors of suspects (id, id2, text, copies, places): (w1, w2, id, id2, start, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        one, two = _Hashes(2), _Hashes(3)
        for batch in batches:
            id_, id2, copies = (batch.column(c).to_numpy() for c in ("id", "id2", "copies"))
            for i, (text, places) in enumerate(zip(batch.column("text"), batch.column("places"))):
                words = split(text.as_py())
                at = starts(len(words), places.values.to_numpy().astype(np.int64), window)
                for a in range(0, len(at), 50_000):
                    own = at[a : a + 50_000]
                    part = words[own[0] : own[-1] + window]
                    w1, w2 = (rolling(np.fromiter(map(h.__getitem__, part), np.uint64, len(part)), window, b)[own - own[0]].view(np.int64) for h, b in ((one, BASES[0]), (two, BASES[1])))
                    m = len(own)
                    cols = w1, w2, np.full(m, id_[i]), np.full(m, id2[i]), own.astype(np.int32), np.full(m, min(2, copies[i]), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["w1", "w2", "id", "id2", "start", "times"])

    return run


def _cleaned(window: int):
    """Of suspects with the starts of their single windows: (id, id2, n_removed, kept_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            removed, digest = [], []
            for text, places, single in zip(batch.column("text"), batch.column("places"), batch.column("single")):
                words = split(text.as_py())
                at = starts(len(words), places.values.to_numpy().astype(np.int64), window)
                if single.is_valid:
                    at = np.setdiff1d(at, single.values.to_numpy(), assume_unique=True)
                change = np.zeros(len(words) + 1, np.int64)
                change[at] += 1
                change[at + window] -= 1
                gone = np.cumsum(change)[:-1] > 0
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("id2"), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["id", "id2", "n_removed", "kept_sha256"])

    return run


def suspects(docs: DataFrame, text: str, window: int) -> DataFrame:
    """Classes of equal texts with anchors that occur elsewhere too, written: (id, id2, text, copies, places)."""
    named = docs.filter(F.col(text).isNotNull()).select(*identity(text), F.col(text).alias("text"))
    # Both uses below read the same shuffled classes, so the texts move once.
    classes = named.groupBy("id", "id2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    anchors = classes.mapInArrow(_anchors(window), "key long, sure boolean, id long, id2 int, place int")
    times = F.count("*").over(W.partitionBy("key", "sure"))
    shared = anchors.withColumn("times", times).filter((F.col("times") > 1) | F.col("sure")).groupBy("id", "id2").agg(F.collect_set("place").alias("places"))
    return materialise(classes.join(shared, ["id", "id2"]), "suspects")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 35) -> DataFrame:
    """One row per input row: key, ``n_words``, ``n_removed``, ``kept_sha256`` of the words left, joined by a space.

    A word goes if a window of ``window`` words covers it that starts anywhere else too, in another row or in the same text; so the
    words of repeated rows and equal texts of that length all go. Null, empty and blank texts have no words; a null key stays; an
    empty table gives no rows; other columns of the table don't matter. Windows are equal if 128 bits of hashes are.
    """
    found = suspects(docs, text, window)
    hashed = found.mapInArrow(_windows(window), "w1 long, w2 long, id long, id2 int, start int, times int")
    counted = hashed.groupBy("w1", "w2").agg(F.sum("times").alias("n"), F.min("id").alias("id"), F.min("id2").alias("id2"), F.min("start").alias("start"))
    single = counted.filter("n = 1").groupBy("id", "id2").agg(F.collect_list("start").alias("single"))
    rest = found.filter("copies = 1").join(single, ["id", "id2"], "left").select("id", "id2", "text", "places", "single")
    cleaned = materialise(rest.mapInArrow(_cleaned(window), "id long, id2 int, n_removed long, kept_sha256 string"), "cleaned")

    joined = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    words = F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1)
    rows = docs.select(F.col(key).alias("key"), *identity(text), words.cast("long").alias("n_words"), F.sha2(joined.cast("binary"), 256).alias("whole"))
    several = rows.groupBy("id", "id2").agg(F.count("*").alias("n")).filter("n > 1").select("id", "id2", F.lit(None).cast("long").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    changed = cleaned.filter("n_removed > 0").unionByName(several).withColumn("touched", F.lit(True))
    told = rows.join(changed, ["id", "id2"], "left")
    gone = F.col("touched") & (F.col("n_words") >= window)
    return told.select(
        F.col("key").alias(key),
        "n_words",
        F.when(gone, F.coalesce("n_removed", "n_words")).otherwise(0).alias("n_removed"),
        F.when(gone, F.col("kept_sha256")).otherwise(F.col("whole")).alias("kept_sha256"),
    )
