"""Weighted scores, to the last digit as decimal weights and doubles give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(x: Column, places: int) -> Column:
    """Halves to the even neighbour as the double holds them; ``bround`` rounds a double by its shortest decimal text instead."""
    return F.rint(x * float(10**places)) / float(10**places)


def weighted_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """The weighted mean of the known parts, times 100, with one digit; each part comes already weighted, beside its weight."""
    total = sum((F.coalesce(part, F.lit(0.0)) for part, _ in parts.values()), F.lit(0.0))
    known = sum((F.when(part.isNotNull(), F.lit(str(weight)).cast("decimal(3,1)")).otherwise(F.lit("0").cast("decimal(3,1)")) for part, weight in parts.values()), F.lit("0").cast("decimal(3,1)"))
    return round_even(F.try_divide(100 * total, known.cast("double")), 1)


def hygiene(errors: Column, weight: int) -> Column:
    """``weight`` tenths of what a tenth for each error leaves of one, counted in hundredths: tenths have no exact double."""
    return F.greatest(F.lit(0), 10 - errors) * weight / 100.0
