"""The lexical axis: lexemes of a text under a search configuration, and the cover density of a query's lexemes in it.

``simple`` lower-cases and drops stop words, in Spark's own functions. ``english`` also stems, by the published Porter2 rules,
in an Arrow batch with a cache of stems; its results are arrays like the others, so both ways meet in the same joins.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The English stop words of the usual Snowball list.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a
    an the and but if or because as until while of at by for with about against between into through during before after above below to from
    up down in out on off over under again further then once here there when where why how all any both each few more most other some such no
    nor not only own same so than too very s t can will just don should now""".split()
)
WORD = re.compile(r"[^\W_]+")


def simple_words(text: Column) -> Column:
    """Lower-case ASCII words of three letters or more that aren't stop words, as often as they occur; null for a null text."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*sorted(STOP_WORDS)))


def simple_lexemes(text: Column) -> Column:
    """The distinct ones of ``simple_words``."""
    return F.array_distinct(simple_words(text))


# Porter2: a vowel-consonant skeleton decides how much of a word a suffix may leave. Its suffix tables.
_VOWELS = "aeiouy"
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = frozenset("sky news howe atlas cosmos bias andes inning outing canning herring earring proceed exceed succeed".split())
_DOUBLES = frozenset("bb dd ff gg mm nn pp rr tt".split())
_REGION_HEADS = ("gener", "commun", "arsen")


def _regions(word: str) -> tuple[int, int]:
    """Where the regions after the first and the second vowel-consonant begin."""

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
                return i + 1
        return len(word)

    first = next((len(h) for h in _REGION_HEADS if word.startswith(h)), None)
    first = after(0) if first is None else first
    return first, after(first)


def _ends_short(word: str) -> bool:
    """Whether it ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS + "wxY"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(200_000)
def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) <= 2 or word in _KEPT:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in _VOWELS) else c for i, c in enumerate(word))
    r1, r2 = _regions(word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _KEPT:
        return word
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        word = word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    elif end and any(c in _VOWELS for c in word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-2:] in _DOUBLES:
            word = word[:-1]
        elif r1 >= len(word) and _ends_short(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    end = _longest(word, (*_STEP2, "ogi", "li"))
    if end and len(word) - len(end) >= r1:
        rest = word[: -len(end)]
        if end in _STEP2:
            word = rest + _STEP2[end]
        elif end == "ogi" and rest.endswith("l") or end == "li" and rest[-1:] in tuple("cdeghkmnrt"):
            word = word[:-1] if end == "ogi" else rest
    end = _longest(word, (*_STEP3, "ative"))
    if end and len(word) - len(end) >= r1:
        if end in _STEP3:
            word = word[: -len(end)] + _STEP3[end]
        elif len(word) - len(end) >= r2:
            word = word[: -len(end)]
    end = _longest(word, (*_STEP4, "ion"))
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _ends_short(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def positioned(text: str | None) -> list[tuple[str, int]]:
    """Stems with their places among all words, stop words counted but left out."""
    return [(stem(w), i) for i, w in enumerate(WORD.findall((text or "").lower()), 1) if w not in STOP_WORDS]


def cover_density(document: list[tuple[str, int]], query: set[str], weight: float = 0.1) -> float:
    """The density of a query's lexemes, any of which makes a cover: each occurrence is a cover of its own.

    That is what the published cover-density rank gives for a query whose terms are all alternatives: every cover holds one
    lexeme, has no gap, and counts with the weight of an unlabelled lexeme.
    """
    return weight * sum(x in query for x, _ in document)


@F.pandas_udf(T.ArrayType(T.StringType()))
def english_words(text: pd.Series) -> pd.Series:
    """Stems in their order, as often as they occur; empty for null and for stop words alone."""
    return pd.Series([[x for x, _ in positioned(t)] for t in text], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def english_lexemes(text: pd.Series) -> pd.Series:
    """Distinct stems in order of first occurrence; empty for null and for stop words alone."""
    return pd.Series([list(dict.fromkeys(x for x, _ in positioned(t))) for t in text], dtype=object)


@F.pandas_udf(T.DoubleType())
def english_rank(text: pd.Series, query: pd.Series) -> pd.Series:
    """The cover density of the query's lexemes in a text; 0 for a query without any."""
    return pd.Series([cover_density(positioned(t), {x for x, _ in positioned(q)}) for t, q in zip(text, query)], dtype="float64")
