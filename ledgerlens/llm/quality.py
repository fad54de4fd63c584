"""Quality rules, line first: lines that break a rule go, then documents that lose too much of their text.

Everything is DataFrame and SQL functions. A line breaks a rule if it is boilerplate (it equals an earlier line, or is a
notice by its wording), navigation (bars, arrows or a row of bare links), or bad in its punctuation (many symbols, words in
shouting capitals, or many words without any sentence mark). A document is kept if the lines that stay hold at least
``MIN_KEPT`` of its characters in words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
MIN_KEPT, MAX_SYMBOLS = 0.5, 0.15
#: Wordings of notices, in lower case, and signs between the links of a menu.
NOTICES = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "accept all cookies", "sign up for our newsletter", "subscribe to our newsletter", "lorem ipsum", "enable javascript")
BARS = "|»›·•"


def words_of(text: Column) -> Column:
    """The text's words; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def signs(text: Column, some: str) -> Column:
    """How many of some characters a text has."""
    return F.length(text) - F.length(F.translate(text, some, ""))


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def n_repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words that lie in a window of ``WINDOW`` words found twice or more in the text.

    Windows are compared by 64-bit hashes; only a text whose windows aren't all distinct has them sorted. The starts of repeated
    windows, in order, each add the words up to the next start, ``WINDOW`` at most.
    """
    hashes, pairs, same, starts = (fresh(df, x) for x in ("w_hashes", "w_pairs", "w_same", "w_starts"))
    none = F.array().cast("array<int>")
    # Hashes of 1, 2, 4, then 8 words, each from two of the last; a list ends where its windows no longer fit.
    df = df.withColumn(hashes, F.when(F.size(words) >= WINDOW, F.transform(F.col(words), lambda w: F.xxhash64(w))))
    step = 1
    while step < WINDOW:
        later = F.slice(F.col(hashes), step + 1, F.size(hashes))
        both = F.zip_with(hashes, later, lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(same, F.slice(both, 1, F.size(hashes) - step)).drop(hashes).withColumnRenamed(same, hashes)
        step *= 2
    repeated = F.size(hashes) > F.size(F.array_distinct(hashes))
    df = df.withColumn(pairs, F.when(repeated, F.sort_array(F.transform(F.col(hashes), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    after = F.slice(F.col(pairs), 2, F.greatest(F.size(pairs) - 1, F.lit(1)))
    df = df.withColumn(same, F.when(F.col(pairs).isNotNull(), F.zip_with(pairs, after, lambda a, b: F.coalesce(a.h == b.h, F.lit(False)))))
    before = F.concat(F.array(F.lit(False)), F.col(same))
    marked = F.zip_with(F.zip_with(same, F.slice(before, 1, F.size(same)), lambda a, b: a | b), F.col(pairs), lambda m, p: F.when(m, p.i))
    df = df.withColumn(starts, F.when(F.col(pairs).isNotNull(), F.sort_array(F.array_compact(marked))).otherwise(none))
    gaps = F.zip_with(starts, F.slice(F.col(starts), 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), b - a))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn(out, F.coalesce(total, F.lit(0).cast("long"))).drop(hashes, pairs, same, starts)


def has_notice(text: Column) -> Column:
    low = F.lower(text)
    found = F.contains(low, F.lit(NOTICES[0]))
    for wording in NOTICES[1:]:
        found = found | F.contains(low, F.lit(wording))
    return found


def text_flags(text: Column) -> Column:
    """What a text must hold for some of its lines to break a rule; spares most texts the closer look at each line."""
    return F.struct(text.rlike(rf"[#*$%&<>{BARS}]").alias("signs"), F.contains(text, F.lit("!!")).alias("bangs"), has_notice(text).alias("notice"))


def line_fails(line: Column, n_words: Column, flags: Column) -> Column:
    """Whether a line that isn't blank breaks a rule by itself; ``flags`` are those of its text."""
    navigation = (n_words >= 3) & (signs(line, BARS) * 4 >= n_words)
    symbols = signs(line, "#*$%&|<>") > MAX_SYMBOLS * n_words
    bangs = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit(""))) > n_words
    shouting = (n_words >= 5) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}")
    unmarked = (n_words >= 40) & ~line.rlike(r"[.!?,;:…。！？]")
    return (flags.signs & (symbols | navigation)) | (flags.bangs & bangs) | shouting | unmarked | (flags.notice & has_notice(line))


def rate(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """All rows and columns of ``docs`` with a struct column ``out``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, kept_chars, base_failed, kept.

    Null and blank texts have no words and fail; repeated rows are rated alike; an empty table gives no rows. A column of that name
    in the input is replaced.
    """
    words, lines, unique, repeats, letters, flags = (fresh(docs, x) for x in ("q_words", "q_lines", "q_unique", "q_repeats", "q_letters", "q_flags"))
    t = F.coalesce(F.col(text), F.lit(""))
    df = n_repeat_words(docs.withColumn(words, words_of(F.col(text))), words, repeats)
    df = df.withColumn(letters, F.length(F.array_join(words, "")).cast("long")).withColumn(words, F.size(words).cast("long"))
    df = df.withColumn(lines, F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))).withColumn(flags, text_flags(t))
    split = F.transform(F.array_distinct(lines), lambda x: F.struct(x.alias("line"), words_of(x).alias("words")))
    df = df.withColumn(unique, F.transform(split, lambda x: F.struct(x.line.alias("line"), F.size(x.words).alias("n"), F.length(F.array_join(x.words, "")).alias("chars"))))
    kept = F.aggregate(unique, F.lit(0).cast("long"), lambda s, x: s + F.when(line_fails(x.line, x.n, F.col(flags)), F.lit(0)).otherwise(x.chars))
    facts = [F.col(words).alias("n_words"), F.col(letters).alias("word_chars"), count_of(t, SYMBOLS).alias("n_symbols"), (F.size(lines) - F.size(unique)).cast("long").alias("n_dup_lines"), F.col(repeats).alias("n_repeat_words"), kept.alias("kept_chars")]
    df = df.withColumn(out, F.struct(*facts)).drop(words, lines, unique, repeats, letters, flags)
    q = F.col(out)
    failed = (q.n_words < MIN_WORDS) | (100 * q.n_repeat_words > MAX_REPEATED * q.n_words)
    df = df.withColumn(out, q.withField("base_failed", failed))
    return df.withColumn(out, q.withField("kept", ~q.base_failed & (q.kept_chars >= MIN_KEPT * q.word_chars)))


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept, with their columns.

    Rows go by exploding an empty list: a filter would be pushed below the rating, with a copy of its steps for each use.
    """
    rated, mark = fresh(docs, "rated"), fresh(docs, "mark")
    rows = rate(docs, text, rated)
    return rows.withColumn(mark, F.explode(F.when(F.col(rated).kept, F.array(F.lit(True))))).drop(rated, mark)
