"""Optional filters, visibility predicates and class-gated projections as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_all(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """Keep rows that meet every predicate; a predicate of None is left out of the plan."""
    given = [p for p in predicates if p is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def equals(column: str, value) -> Column | None:
    """``column = value``, or no predicate if no value is asked for."""
    return None if value is None else F.col(column) == F.lit(value)


def one_of(column: str, values) -> Column | None:
    """``column`` in ``values``; an empty list of values matches nothing."""
    if values is None:
        return None
    return F.col(column).isin(list(values)) if values else F.lit(False)


def day_range(column: str, start: str | None, end: str | None) -> Column | None:
    """Whole days from ``start`` to ``end``, both included; the last instant is .999 of the last second."""
    low = F.col(column) >= F.lit(f"{start} 00:00:00").cast("timestamp_ntz") if start else None
    high = F.col(column) <= F.lit(f"{end} 23:59:59.999").cast("timestamp_ntz") if end else None
    if low is None or high is None:
        return low if high is None else high
    return low & high


def escape_like(text: str, escape: str = "!") -> str:
    """``text`` for use inside a LIKE pattern."""
    return "".join(escape + c if c in (escape, "%", "_") else c for c in text)


def contains_text(column: str, text: str | None) -> Column | None:
    """Case-insensitive containment of a literal text."""
    return None if not text else F.contains(F.lower(F.col(column)), F.lit(text.lower()))


def gated(condition: Column, column: Column | str) -> Column:
    """A value where ``condition`` holds, null elsewhere."""
    return F.when(condition, F.col(column) if isinstance(column, str) else column)


def downgraded(own: Column, other: Column, top: str, cap: Column | None = None) -> Column:
    """``own``, unless it is ``top`` while ``other`` is not; then ``other``."""
    return F.when((own == top) & ~other.eqNullSafe(F.lit(top)), other if cap is None else cap).otherwise(own)


def excerpt(column: str, size: int) -> Column:
    """The first ``size`` characters and whether there are more."""
    return F.struct(F.substring(column, 1, size).alias("text"), (F.length(column) > size).alias("truncated"))


def iso_micros(column: str) -> Column:
    """A timestamp as ISO 8601 text with microseconds and Z."""
    return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def public_state(column: str, asked: str | None, public: tuple[str, ...]) -> Column | None:
    """``column`` equals the state asked for; a state that is not public is false for every row, so nothing is read."""
    if asked is None:
        return F.col(column).isin(*public)
    return F.col(column) == asked if asked in public else F.lit(False)
