"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table with the token lengths of the corpus's most frequent pre-tokens (at most ``table_size``
entries, so its size has a bound). Tier two is a bounded cache in each Python worker that encodes what tier one lacks.
Pre-tokens are never shuffled: each task only reports a bounded summary of the pre-tokens most frequent in its own rows,
and the summaries are merged to fill tier one. The table decides speed, never a result.

Texts of any script are split alike. Only a chunk (a run without white space) that holds a special token's sign, or a character
that this Python's Unicode tables do not know, is encoded by the library as a whole, so every count is the library's.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from unicodedata import category, normalize

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, kept

TABLE_SIZE = 50_000
TASK_SUMMARY = 4_000
#: Entries of each of a cache's two generations, and the most characters of a chunk that is kept in it.
CACHE_SIZE, LONGEST_KEPT = 300_000, 48


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The tokenizer's own split pattern, for normalised text; then the same for Latin-1 alone, with its letters and numbers listed.
ANY_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
_LETTERS, _NUMBERS = ("".join(re.escape(chr(i)) for i in range(0x100) if category(chr(i))[0] == kind) for kind in "LN")
LATIN_PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+").findall
#: What this library takes for white space; Python's split() also cuts at the four separators below.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
SPECIAL = "<|"


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def chunks_of(text: str) -> list[str]:
    """The text's runs without white space; of Latin-1 texts in lower case, which leaves fewer to tell apart."""
    if (text.isascii() or is_latin(text)) and SPECIAL not in text:
        text = text.lower()
    if any(s in text for s in SEPARATORS):
        return [c for c in SPACE.split(text) if c]
    return text.split()


def pre_tokens(chunk: str) -> list[str] | None:
    """A chunk's pre-tokens, or None if only the library can tell them."""
    if chunk.isascii() and chunk.isalpha():
        return [chunk.lower()]
    if SPECIAL in chunk:
        return None
    if chunk.isascii() or is_latin(chunk):
        return LATIN_PRE_TOKEN(chunk.lower())
    if "Cn" in map(category, chunk):
        return None
    return ANY_PRE_TOKEN("".join([c.lower() for c in normalize("NFC", chunk)]))


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as code points from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


class TextCoder(dict):
    """Whole texts to joined values of their ids, e.g. their number.

    It is itself the worker's cache, of chunks and of pre-tokens: pre-tokens never cross white space, so a chunk is looked up
    first; a new one is split into pre-tokens, which are looked up in the broadcast table, then in the cache, and encoded last.
    At ``size`` entries the present generation becomes the old one, from which what is used again comes back. Long chunks are
    not kept, so the cache's bytes are bounded as well.
    """

    def __init__(self, path: str, value, join, known: dict | None = None, size: int = CACHE_SIZE):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.value, self.join, self.known, self.size, self.old = Tokenizer.from_file(path), value, join, known or {}, size, {}
        self.bpe, self.letters = self.tokenizer.model.tokenize, byte_letters()

    def encode(self, word: str):
        """The value of one pre-token."""
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.letters)
        return self.value([t.id for t in self.bpe(word)])

    def piece(self, word: str):
        out = self.known.get(word)
        if out is None and (out := self.get(word)) is None:
            out = self.keep(word, self.encode(word))
        return out

    def keep(self, key: str, value):
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def __missing__(self, chunk: str):
        out = self.old.get(chunk)
        if out is None and (out := self.known.get(chunk)) is None:
            words = pre_tokens(chunk)
            if words is None:
                out = self.value(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
            elif len(words) == 1:
                out = self.encode(words[0])
            else:
                out = self.join([self.piece(w) for w in words])
        return self.keep(chunk, out)

    def code(self, text: str | None):
        """The joined values of the whole text's ids."""
        return self.join(map(self.__getitem__, chunks_of(text))) if text else self.join(())


def worker_coder(key: tuple, *args) -> TextCoder:
    """The worker's own coder, kept from task to task."""
    if key not in kept:
        kept.clear()
        kept[key] = TextCoder(*args)
    return kept[key]


def frequent_pre_tokens(docs: DataFrame, text: str = "text", size: int = TABLE_SIZE, summary: int = TASK_SUMMARY) -> list[str]:
    """The most frequent pre-tokens of all rows, by summaries of bounded size from each task."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks: Counter = Counter()
        seen: Counter = Counter()

        def split() -> None:
            for chunk, n in chunks.items():
                for word in pre_tokens(chunk) or () if len(chunk) <= LONGEST_KEPT else ():
                    seen[word] += n
            chunks.clear()

        for batch in batches:
            for t in batch[text]:
                if t:
                    chunks.update(chunks_of(t))
                    if len(chunks) > 300_000:
                        split()
                        if len(seen) > 500_000:
                            seen = Counter(dict(seen.most_common(100_000)))
        split()
        yield pd.DataFrame(seen.most_common(summary), columns=["word", "n"])

    counts = docs.select(F.col(text).alias(text)).mapInPandas(summarise, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def token_counter(spark: SparkSession, frequent: list[str], path: str | None = None):
    """A Column -> Column function: tokens of a text, null counting as empty."""
    path = path or default_tokenizer()
    length = TextCoder(path, len, sum).encode
    shared = spark.sparkContext.broadcast({w: length(w) for w in frequent})
    key = ("lengths", path, uuid.uuid4().hex)

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        frugal(drop=False)
        coder = worker_coder(key, path, len, sum, shared.value)
        for batch in batches:
            yield pd.Series([coder.code(t) for t in batch], dtype="int64")

    return count


def count_tokens(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), limit: int = 2048, path: str | None = None) -> DataFrame:
    """Keys with ``n_bytes``, ``n_tokens`` and ``over_limit`` of each whole text.

    Null and empty texts count 0; repeated rows are each counted; an empty table gives no rows; other columns are left out,
    so their names cannot clash.
    """
    count = token_counter(docs.sparkSession, frequent_pre_tokens(docs, text), path)
    n_bytes: Column = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    counted = docs.select(*keys, n_bytes.alias("n_bytes"), count(F.col(text)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
