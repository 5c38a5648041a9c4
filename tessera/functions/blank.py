"""One rule for what counts as missing: null, the empty string, an empty array, zero and false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_text(c: Column) -> Column:
    """True for a string of at least one character; never null."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def has_items(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def has_number(c: Column) -> Column:
    """True for a number other than 0 and NaN; never null."""
    return F.coalesce((c != 0) & ~F.isnan(c.cast("double")), F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c)


def first_filled(*candidates: Column) -> Column:
    """The first candidate that isn't blank, in the order given."""
    return F.coalesce(*[blank_to_null(c) for c in candidates])
