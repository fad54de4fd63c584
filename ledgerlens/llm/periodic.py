"""Runs: maximal stretches of words that repeat with a smallest period, at least twice over, within one text.

A run of period q holds an aligned block of a power of two of words and, q words on, the block again, if the block is at most
half of q: so for each size of block there is a range of distances that it can serve. The blocks of a size are keys, as
sequences of integers, of an Aho-Corasick automaton that searches the whole document; an occurrence at a distance of the block's
range is a seed, which is extended word by word in both directions to the longest stretch that keeps the distance as a period.
Blocks with a word that does not come again within the range can't recur and are no keys, so ordinary prose makes few.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, frugal

#: Fewest words of a run.
LEAST = 12
#: Words compared at first when a seed is extended; doubled until a difference is found.
STEP = 64


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)


def scales(n: int, least: int) -> Iterator[tuple[int, list[int]]]:
    """(block, periods) for every period up to n / 2: the largest power of two that lies aligned in any stretch's first words.

    The first word of each pair q apart makes a stretch of max(least, 2 q) - q words, and of any 2 b - 1 consecutive words b are
    an aligned block.
    """
    most, of = n // 2, {}
    for q in range(1, min(least // 2, most) + 1):
        if max(least, 2 * q) <= n:
            of.setdefault(1 << ((least - q + 1) // 2).bit_length() - 1, []).append(q)
    block, low = 1, least // 2 + 1
    while low <= most:
        if (high := min(4 * block - 2, most)) >= low:
            of.setdefault(block, []).extend(range(low, high + 1))
            low = high + 1
        block *= 2
    yield from sorted(of.items())


def reach(ids: np.ndarray, a: int, q: int) -> int:
    """The first i >= a for which word i differs from word i + q, or has none."""
    n, step = len(ids) - q, STEP
    while a < n:
        b = min(n, a + step)
        differ = ids[a:b] != ids[a + q : b + q]
        if differ.any():
            return a + int(differ.argmax())
        a, step = b, 2 * step
    return max(a, n)


def back(ids: np.ndarray, a: int, q: int) -> int:
    """The first i such that words i to a all equal those q words on."""
    step = STEP
    while a > 0:
        b = max(0, a - step)
        differ = ids[b:a] != ids[b + q : a + q]
        if differ.any():
            return a - int(differ[::-1].argmax())
        a, step = b, 2 * step
    return a


def primes(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return found + [q] * (q > 1)


def smallest(ids: np.ndarray, start: int, q: int) -> bool:
    """Whether a stretch of at least 2 q words with period q has no smaller one: a smaller one would divide q."""
    first = ids[start : start + q]
    return not any(np.array_equal(first, ids[start + q // p : start + q // p + q]) for p in primes(q))


def seeds(ids: np.ndarray, again: np.ndarray, block: int, low: int, high: int, till: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of aligned blocks that occur again low to high words on.

    ``till`` and ``per``: end and period of a known run at each word. A seed inside one whose period divides the distance leads
    to that run again, and is left out.
    """
    count = len(ids) // block
    far = again[: count * block].reshape(count, block).max(axis=1)
    own = np.flatnonzero(far <= high)
    empty = np.empty(0, np.int64)
    if not len(own):
        return empty, empty
    keys = np.full(count, -1)
    found_at, found_key = [], []
    automaton, numbers = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}
    for j in own:
        key = tuple(ids[j * block : (j + 1) * block].tolist())
        if (name := numbers.get(key)) is None:
            name = numbers[key] = len(numbers)
            automaton.add_word(key, name)
        keys[j] = name
    automaton.make_automaton()
    for last, name in automaton.iter(tuple(ids.tolist())):
        found_at.append(last - block + 1)
        found_key.append(name)
    at, name = np.array(found_at, np.int64), np.array(found_key, np.int64)
    starts, distances = [], []
    nearest = (at - low) // block
    for back_by in range((high - low) // block + 1):
        j = nearest - back_by
        ok = (j >= 0) & (at - j * block <= high)
        ok[ok] = keys[j[ok]] == name[ok]
        b, q = j[ok] * block, at[ok] - j[ok] * block
        known = (till[b] >= b + q + block) & (q % per[b] == 0)
        starts.append(b[~known])
        distances.append(q[~known])
    return np.concatenate(starts), np.concatenate(distances)


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and two periods, by start, then period."""
    n, found = len(ids), []
    if n < max(2, least):
        return found
    order = np.argsort(ids, kind="stable")
    again = np.full(n, n)  # words until the same word comes again
    same = ids[order[1:]] == ids[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    till, per = np.zeros(n, np.int64), np.ones(n, np.int64)
    for block, periods in scales(n, least):
        served = np.zeros(periods[-1] + 1, bool)
        served[periods] = True
        b, q = seeds(ids, again, block, periods[0], periods[-1], till, per)
        ok = served[q]
        order = np.lexsort((b[ok], q[ok]))
        b, q = b[ok][order], q[ok][order]
        cuts = np.flatnonzero(np.diff(q)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(q)]):
            at = lo
            while at < hi:
                period = int(q[at])
                if till[b[at]] >= b[at] + period + block and period % per[b[at]] == 0:  # found meanwhile
                    at += 1
                    continue
                start, end = back(ids, int(b[at]), period), reach(ids, int(b[at]) + block, period) + period
                if end - start >= max(least, 2 * period) and smallest(ids, start, period):
                    found.append((start, end - start, period))
                    longer = till[start:end] < end
                    till[start:end][longer], per[start:end][longer] = end, period
                at += int(np.searchsorted(b[at:hi], end - period - block, side="right"))
    return sorted(found, key=lambda r: (r[0], r[2]))


def hash_of(key: int | None) -> int:
    """crc32 of the key's decimal text; a null key never makes its text periodic."""
    return 1 if key is None else zlib.crc32(str(key).encode())


def planted(words: list[bytes], h: int) -> list[bytes]:
    """The words; for a tenth of the hashes those from some word on repeat with a period taken from the hash."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def described(words: list[bytes], least: int = LEAST) -> tuple:
    """All runs, and the digests, of one text."""
    found = runs(numbered(words), least)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = words
    if found:
        kept = [w for w, d in zip(words, np.cumsum(drop)) if not d]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    most = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return len(found), *most, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
KINDS = ", ".join(f"{c} {'string' if c.endswith('256') else 'long'}" for c in COLUMNS)


def _described(key: Column, text: Column, plant: bool, least: int) -> Column:
    @F.pandas_udf(KINDS)
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        frugal()
        for keys, texts in batches:
            rows = []
            for h, t in zip(keys, texts):
                words = t.encode().split() if t else []
                rows.append(described(planted(words, int(h)) if plant else words, least))
            out = pd.DataFrame(rows, columns=COLUMNS)
            yield out.astype({c: "Int64" for c in COLUMNS[:5]})

    return udf(key, text)


def _spans(text: Column, least: int) -> Column:
    @F.pandas_udf("array<struct<start:long,length:long,period:long>>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        frugal()
        for batch in batches:
            yield pd.Series([[tuple(map(int, r)) for r in runs(numbered(t.encode().split() if t else []), least)] for t in batch], dtype=object)

    return udf(text)


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``runs``, all runs of each whole text by start, then period; null and empty texts have none."""
    return docs.withColumn(fresh(docs, "runs"), _spans(F.col(text), least))


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", plant: bool = False, least: int = LEAST) -> DataFrame:
    """One row per input row: key, the number of runs, the longest one, and digests of all runs and of the collapsed text.

    The longest run is that of most words, then of smallest start, then of smallest period; without a run its columns are null.
    The collapsed text has each run's first period only. ``plant`` makes a tenth of the texts periodic first, chosen and shaped by
    crc32 of the key; a text with a null key stays as it is. Null, empty and blank texts have no words and no runs; repeated rows
    stay repeated; an empty table gives no rows; other columns of the table don't matter.
    """
    h = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(1))
    return docs.select(F.col(key), _described(h, F.col(text), plant, least).alias("found")).select(key, "found.*")
