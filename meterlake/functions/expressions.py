"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(name: str) -> Column:
    """Trimmed text; empty counts as null."""
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def parsed_timestamp(column: Column) -> Column:
    """A timestamp from ISO text with or without a zone mark, or with a space; null if it is none of them."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]'Z'", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]")
    return F.coalesce(*(F.try_to_timestamp(column, F.lit(f)) for f in formats), F.try_to_timestamp(column))


def as_double(name: str) -> Column:
    """A number, or null where the text is none."""
    return F.expr(f"try_cast(nullif(trim(`{name}`), '') AS DOUBLE)")


def elapsed(since: Column, until: Column) -> Column:
    """Seconds between two times, exact to the microsecond."""
    return (F.unix_micros(until) - F.unix_micros(since)) / 1e6


def ratio(top: Column, bottom: Column) -> Column:
    """A quotient, null where the divisor is 0 or null."""
    return top / F.nullif(bottom, F.lit(0.0))


def content_hash(names: Sequence[str], mark: str = "~NULL~", separator: str = "||") -> Column:
    """SHA-256 of the columns' texts, nulls by a mark."""
    return F.sha2(F.concat_ws(separator, *(F.coalesce(F.col(n).cast("string"), F.lit(mark)) for n in names)), 256)


def banded(column: Column, *bands: tuple[float, str], otherwise: str) -> Column:
    """The name of the first band whose bound the value is below; ``otherwise`` above all, and for null."""
    out = F.when(column < bands[0][0], bands[0][1])
    for bound, name in bands[1:]:
        out = out.when(column < bound, name)
    return out.otherwise(otherwise)


def graded(column: Column, *grades: tuple[float, str], otherwise: str) -> Column:
    """The name of the first grade that the value reaches; ``otherwise`` below all, and for null."""
    out = F.when(column >= grades[0][0], grades[0][1])
    for bound, name in grades[1:]:
        out = out.when(column >= bound, name)
    return out.otherwise(otherwise)
