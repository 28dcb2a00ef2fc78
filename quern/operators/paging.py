"""Keyset pagination over (nullable time, id) and (rank, tie, id)."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cursor:
    """The row a page starts behind."""

    time: str | None
    id: int | str
    backward: bool = False

    def encode(self, binding: str = "") -> str:
        """Opaque text; ``binding`` names the query that the cursor belongs to."""
        raw = json.dumps({"v": 1, "t": self.time, "i": self.id, "b": self.backward, "q": binding}, separators=(",", ":"))
        return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")

    @classmethod
    def decode(cls, text: str, binding: str = "") -> Cursor:
        try:
            raw = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
            cursor = cls(raw["t"], raw["i"], raw["b"])
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError("this is no cursor") from e
        if raw.get("v") != 1 or raw.get("q") != binding:
            raise ValueError("this cursor belongs to another query")
        return cursor


def behind(time: str, id: str, cursor: Cursor, descending: bool) -> Column:
    """Rows after the cursor in the order that is read."""
    t, i = F.col(time), F.col(id)
    if cursor.time is None:
        rest = (t.isNull() & (i < cursor.id)) if descending else ((t.isNull() & (i > cursor.id)) | t.isNotNull())
        return rest
    at = F.lit(cursor.time).cast("timestamp_ntz")
    if descending:
        return (t < at) | ((t == at) & (i < cursor.id)) | t.isNull()
    return (t > at) | ((t == at) & (i > cursor.id))


def page(df: DataFrame, time: str, id: str, size: int, cursor: Cursor | None = None, newest_first: bool = True) -> DataFrame:
    """One page in reading order, with ``more``: whether another row lies beyond it.

    Newest first puts rows without a time last; oldest first puts them first.
    """
    backward = bool(cursor and cursor.backward)
    descending = newest_first != backward
    order = [F.col(time).desc_nulls_last(), F.col(id).desc()] if descending else [F.col(time).asc_nulls_first(), F.col(id).asc()]
    found = (df if cursor is None else df.where(behind(time, id, cursor, descending))).orderBy(*order).limit(size + 1)
    # a page is small: numbering its rows in one task is bounded by the page size
    from pyspark.sql.window import Window

    numbered = found.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("more", F.max("_n").over(Window.partitionBy(F.lit(1))) > size)
    return numbered.where(F.col("_n") <= size).orderBy(F.col("_n").desc() if backward else F.col("_n")).drop("_n")


def ranked_behind(rank: str, tie: str, id: str, at: tuple[int, str, int]) -> Column:
    """Rows after (rank, tie, id) in the order rank descending, tie ascending, id ascending."""
    r, t, i = at
    return (F.col(rank) < r) | ((F.col(rank) == r) & ((F.col(tie) > t) | ((F.col(tie) == t) & (F.col(id) > i))))
