"""Language identification by bit-sliced Bloom filters over character trigrams.

All languages share one table of bit masks: a trigram's language set is written to ``HASHES`` slots, and the AND of those
slots returns every language that contains it (with the filters' usual false positives). A document is decided by one
popcount per language over its trigrams, each corrected by that language's false-positive rate, which follows from the share
of slots where its bit is set. The trigrams of a language come from counts over all learning rows: those whose share within
the language is at least ``KEEP`` of their largest share in any language, so a few foreign passages don't blur the sets.

Counting, choosing and filling the filters are Spark's; the driver gets the finished masks, ``SLOTS`` words for every 64 languages.
However rare a language is, it is learned. More than ``GROUP`` of them are dealt to groups of filters of that size, each of which
finds its best language; the best of those decides, so a worker holds one group's masks at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialise

#: Trigram ids, filter slots (both powers of two), hash functions, and the least relative share of a kept trigram.
IDS, SLOTS, HASHES, KEEP = 1 << 20, 1 << 18, 3, 0.1
UNKNOWN = "und"
#: Languages of a group of filters: 2 MB of masks for every 64.
GROUP = 1024
#: Languages whose counts a task holds at a time.
HELD = 12

_letters: np.ndarray | None = None


def trigrams(text: str) -> np.ndarray:
    """Ids of the trigrams of the lower-cased letters, words set off by single spaces; empty without any letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    known = _letters[points]
    if not known.any():
        return np.empty(0, dtype=np.int64)
    points = np.concatenate(([32], np.where(known, points, 32), [32])).astype(np.uint64)
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    mixed = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 20)).astype(np.int64)


def slots_of(ids: np.ndarray) -> list[np.ndarray]:
    """The filter slots of trigram ids, one array for each hash function."""
    ids = ids.astype(np.uint64) + np.uint64(1)
    return [((ids * np.uint64(m) ^ (ids * np.uint64(m) >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - 18)).astype(np.int64) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[:HASHES]]


@dataclass
class Filters:
    """Languages in order, and masks by slot: one 64-bit word for every 64 languages.

    ``more`` are the further groups.
    """

    languages: list[str]
    masks: np.ndarray
    more: tuple[Filters, ...] = ()

    def rates(self) -> np.ndarray:
        """False-positive rate of each language's filter."""
        return np.array([(((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** HASHES for i in range(len(self.languages))])


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from all rows with a text and a language."""
    rows = rows.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return Filters([], np.zeros((1, SLOTS), dtype=np.uint64))
    number = {language: i for i, language in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frugal()
        sums: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pd.DataFrame]:
            for language, counts in sums.items():
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": number[language], "id": at, "n": counts[at]})
            sums.clear()

        for batch in batches:
            for language, own in batch.groupby("lang")["text"]:
                if language not in sums and len(sums) == HELD:
                    yield from counted()
                counts = sums.setdefault(language, np.zeros(IDS, dtype=np.int64))
                buffer, held = [], 0
                for t in own:
                    buffer.append(trigrams(t))
                    held += len(buffer[-1])
                    if held > 500_000:
                        counts += np.bincount(np.concatenate(buffer), minlength=IDS)
                        buffer, held = [], 0
                if buffer:
                    counts += np.bincount(np.concatenate(buffer), minlength=IDS)
        yield from counted()

    counts = materialise(rows.mapInPandas(count, "lang int, id int, n long").groupBy("lang", "id").agg(F.sum("n").alias("n")), "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "id", (F.col("n") / F.col("all")).alias("share"))
    # A trigram has a row for each language at most.
    kept = shares.groupBy("id").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("own")).select("id", "most", F.explode("own").alias("o"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slots = slots_of(batch["id"].to_numpy())
            bit = np.left_shift(np.uint64(1), (batch["lang"].to_numpy() % 64).astype(np.uint64)).view(np.int64)
            for at in slots:
                yield pd.DataFrame({"word": batch["lang"] // 64, "slot": at, "mask": bit})

    slots = kept.filter(F.col("o.share") >= KEEP * F.col("most")).select("id", "o.lang").mapInPandas(fill, "word int, slot int, mask long")
    slots = slots.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    if len(languages) > GROUP:
        slots = materialise(slots, "slots")
    groups = []
    for first in range(0, len(languages), GROUP):
        own = languages[first : first + GROUP]
        masks = np.zeros((math.ceil(len(own) / 64), SLOTS), dtype=np.uint64)
        filled = slots.filter(F.col("word").between(first // 64, (first + GROUP) // 64 - 1)).toPandas()
        masks[filled["word"].to_numpy() - first // 64, filled["slot"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
        groups.append(Filters(own, masks))
    return Filters(groups[0].languages, groups[0].masks, tuple(groups[1:]))


def decide(text: str | None, filters: Filters, rates: np.ndarray) -> tuple[str, float]:
    """The language with the most trigrams after correction, and the share of the text's trigrams it accounts for."""
    ids = trigrams(text) if text else ()
    if not len(ids) or not filters.languages:
        return UNKNOWN, 0.0
    places = slots_of(ids)
    counts = []
    for word in filters.masks:
        hits = word[places[0]]
        for p in places[1:]:
            hits = hits & word[p]
        counts += [np.count_nonzero(hits & np.uint64(1 << i)) for i in range(min(64, len(filters.languages) - len(counts)))]
    found = (np.array(counts) - len(ids) * rates) / np.maximum(len(ids) * (1 - rates), 1e-9)
    best = int(found.argmax())  # the first in order of those that tie
    return filters.languages[best], float(min(1.0, max(0.0, found[best])))


def predictor(docs: DataFrame, filters: Filters):
    """A Column -> Column function: text to ``struct<lang_pred, score>``, the first of the groups' best scores."""

    def of(group: Filters):
        shared = docs.sparkSession.sparkContext.broadcast(Filters(group.languages, group.masks))  # SLOTS words for every 64 languages

        @F.pandas_udf("lang_pred string, score double")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            frugal()
            rates = shared.value.rates()
            for batch in batches:
                yield pd.DataFrame([decide(t, shared.value, rates) for t in batch], columns=["lang_pred", "score"])

        return predict

    udfs = [of(g) for g in (filters, *filters.more)]
    if len(udfs) == 1:
        return udfs[0]

    def best(text):
        found = [F.struct(f(text).score.alias("score"), F.lit(-i).alias("first"), f(text).lang_pred.alias("lang_pred")) for i, f in enumerate(udfs)]
        top = F.array_max(F.array(*found))
        return F.struct(top.lang_pred.alias("lang_pred"), top.score.alias("score"))

    return lambda text: best(F.col(text) if isinstance(text, str) else text)


def identify(docs: DataFrame, learning: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Per row of ``docs``: key, lang_pred, score.

    ``und`` with score 0 for null texts and texts without a letter, or if nothing could be learned; ties go to the first
    language by code point; repeated rows stay repeated; other columns are left out.
    """
    predict = predictor(docs, learn(learning, text, lang))
    return docs.select(F.col(key), predict(F.col(text)).alias("p")).select(key, "p.*")
