"""Text functions: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lexemes(text: Column) -> Column:
    """Distinct lower-case ASCII words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})"), F.lit(1)))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def canonical_json(value: Column) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.parse_json(value))


def cosine_distance(a: Column, b: Column) -> Column:
    """One less the cosine; null for a null or zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def relative_day(days: Column) -> Column:
    """``21 days (3 weeks) before the question``: whole days between a date and the question, signed."""
    n = F.abs(days)
    side = F.when(days > 0, "before").otherwise("after")
    long_ago = F.format_string("%d days (~%d months) %s the question", n, F.bround(n / 30, 0).cast("long"), side)
    weeks = F.format_string("%d days (%d weeks) %s the question", n, F.floor(n / 7).cast("long"), side)
    other = F.format_string("%d %s %s the question", n, F.when(n == 1, "day").otherwise("days"), side)
    return F.when(days == 0, "the day of the question").when(n >= 60, long_ago).when((n >= 14) & (n % 7 == 0), weeks).otherwise(other)


def normalise_span(text: Column) -> Column:
    """A quotation as it is compared: straight apostrophes, single spaces, trimmed, lower case; empty for null."""
    plain = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("’"), F.lit("'")), r"\s+", " ")
    return F.lower(F.trim(plain))
