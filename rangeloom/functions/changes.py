"""Column functions for the update callbacks of writes, and for keys."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Values = Mapping[str, Column]


def increment(column: str, by: Column | int | float = 1) -> Callable[[Values], Values]:
    """For update_with: add ``by``; null counts as 0."""
    step = by if isinstance(by, Column) else F.lit(by)
    return lambda old: {column: F.coalesce(old[column], F.lit(0)) + step}


def assign(**values: Column | object) -> Callable[[Values], Values]:
    """For update_with: set columns to fixed values or to expressions over no other columns."""
    return lambda old: {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()}


def add_given(*columns: str) -> Callable[[Values, Values], Values]:
    """For add_or_update: the old value plus the given one; null counts as 0."""
    return lambda old, new: {c: F.coalesce(old[c], F.lit(0)) + F.coalesce(new[c], F.lit(0)) for c in columns}


def greatest_of(*columns: str) -> Callable[[Values, Values], Values]:
    """For add_or_update: the greater of old and given."""
    return lambda old, new: {c: F.greatest(old[c], new[c]) for c in columns}


def same_ignoring_case(*columns: str) -> Callable[[Values, Values], Column]:
    """For compare_and_swap: text compared without case."""

    def equal(old: Values, wanted: Values) -> Column:
        out = F.lit(True)
        for c in columns:
            out = out & F.lower(old[c]).eqNullSafe(F.lower(wanted[c]))
        return out

    return equal


#: 100 ns ticks from year 1 to 1970, and in a microsecond.
TICKS_TO_EPOCH, TICKS_A_MICROSECOND = 621_355_968_000_000_000, 10


def ticks(ts: Column) -> Column:
    """A timestamp as 100 ns ticks since year 1, for keys finer than microseconds can be."""
    return (F.unix_micros(ts.cast("timestamp")) * TICKS_A_MICROSECOND + TICKS_TO_EPOCH).cast("long")


def from_ticks(value: Column) -> Column:
    return F.timestamp_micros(F.floor((value - TICKS_TO_EPOCH) / TICKS_A_MICROSECOND).cast("long"))


def uuid_key(value: Column) -> Column:
    """A UUID as lower-case canonical text, which sorts as its bytes do."""
    hexed = F.lower(F.regexp_replace(value, "[^0-9A-Fa-f]", ""))
    part = lambda a, n: F.substring(hexed, a, n)
    return F.when(F.length(hexed) == 32, F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)))


def sort_key(*columns: Column) -> Column:
    """Long, non-negative columns as one text key with their lexicographic order."""
    return F.concat_ws("|", *[F.lpad(c.cast("string"), 19, "0") for c in columns])
