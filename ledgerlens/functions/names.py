"""Names in texts: capitalised words, but for those that only open sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "[A-ZÀ-Ý][a-zà-ÿ]{2,}"
#: Capitalised words that open sentences and are no names.
NO_NAMES = "the this that these those there here and with when where what which who le la les un une des ce cette ces et avec".split()
#: The factors of a fact about a person that the question names, and about another one.
MATCH, MISMATCH = 1.0, 0.7


def entity_tokens(text: Column) -> Column:
    """Capitalised words that may be names, as often as they occur."""
    found = F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(1))
    return F.filter(found, lambda x: ~F.lower(x).isin(NO_NAMES))


def person_factor(person: Column, asked: Column) -> Column:
    """By how much a fact about a person counts for a question that names ``asked``: less if it names others only.

    A person of several words is met by any of them; a name too short to be a token by itself. Without a person, or a question
    without names, nothing changes.
    """
    tokens = F.regexp_extract_all(person, F.lit(f"({ENTITY})"), F.lit(1))
    met = F.when(F.size(tokens) > 0, F.arrays_overlap(tokens, asked)).otherwise(F.array_contains(asked, person))
    return F.when(F.coalesce(person, F.lit("")).eqNullSafe("") | (F.coalesce(F.size(asked), F.lit(0)) <= 0) | met, MATCH).otherwise(MISMATCH)
