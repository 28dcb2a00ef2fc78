"""Versioned ingest of a stream of observations, one state per item."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "item string, content string, at timestamp, version int, status string"


def fold(rows: list[tuple], seen: dict[str, int]) -> list[tuple]:
    """(item, content, at, version, status) of observations in order; ``seen`` maps content digests to versions."""
    out = []
    for item, content, at in rows:
        h = hashlib.sha256((content or "").encode()).hexdigest()[:16]
        if h in seen:
            out.append((item, content, at, seen[h], "unchanged"))
        else:
            seen[h] = len(seen) + 1
            out.append((item, content, at, seen[h], "new" if seen[h] == 1 else "version_changed"))
    return out


def versioned(stream: DataFrame, item: str, content: str, at: str) -> DataFrame:
    """Streaming form of ``version_history``: each observation with the version of its content and a status.

    The state of an item is the digest of each content it had, in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values([at, content], kind="stable")
        out = fold(list(zip(rows[item], rows[content], rows[at])), seen)
        state.update((json.dumps(seen),))
        yield pd.DataFrame(out, columns=["item", "content", "at", "version", "status"])

    return stream.select(item, content, at).groupBy(item).applyInPandasWithState(step, OUT, "seen string", "append", GroupStateTimeout.NoTimeout)
