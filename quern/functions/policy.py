"""What may be collected and kept: licence permissions, collection policies, robots rules, bounded labels and prefixed ids."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Licence families whose texts may be copied, and those that may be copied unchanged only (fixed values).
COPYABLE = ("cc0", "cc-by", "cc-by-sa")
UNCHANGED_ONLY = ("cc-by-nd",)


def allows_copy(family: Column, unchanged: bool = False) -> Column:
    """Whether texts of a licence family may be kept; unknown families may not."""
    return F.coalesce(family.isin(*COPYABLE, *(UNCHANGED_ONLY if unchanged else ())), F.lit(False))


def collection_policy(enabled: Column, notes: Column, policy: Column, family: Column, now: Column) -> Column:
    """struct(admitted, evidence, extraction, raw_until) of a source.

    ``policy``: struct(admitted, rights_basis, evidence, extraction, expires_at), null where a source has
    none; then an enabled source with rights notes is admitted for everything but raw texts. Without an
    answer, evidence and extraction follow admission. Raw texts need a family that allows copies and an
    expiry behind ``now``.
    """
    said = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    own = policy.isNotNull()
    off = F.coalesce(~enabled, F.lit(False))
    admitted = ~off & F.when(own, F.coalesce(policy["admitted"], F.lit(False)) & said(policy["rights_basis"])).otherwise(F.coalesce(enabled, F.lit(False)) & said(notes))
    evidence = admitted & F.coalesce(policy["evidence"], F.lit(True))
    extraction = evidence & F.coalesce(policy["extraction"], F.lit(True))
    raw = F.when(admitted & own & allows_copy(family, unchanged=True) & (policy["expires_at"] > now), policy["expires_at"])
    return F.struct(admitted.alias("admitted"), evidence.alias("evidence"), extraction.alias("extraction"), raw.alias("raw_until"))


def prefixed_id(value: Column, prefix: str) -> Column:
    """The slug behind ``prefix:``, for ids of lower-case words, digits and hyphens; null for all others."""
    found = F.regexp_extract(F.trim(value), f"^{re.escape(prefix)}:([a-z0-9]+(?:-[a-z0-9]+)*)$", 1)
    return F.nullif(found, F.lit(""))


def bounded_label(value: Column, known: list[str], other: str = "other") -> Column:
    """A metric label out of a bounded vocabulary; everything else, also null, is ``other``."""
    plain = F.regexp_replace(F.lower(F.trim(value)), "[ -]+", "_")
    return F.when(plain.isin(*known), plain).otherwise(F.lit(other))


def robots_rules(body: str, agent: str) -> list[tuple[bool, str]]:
    """(allow, path pattern) of the groups that name ``agent``, or else of those for all agents."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    names: list[str] = []
    open_names = False
    for line in body.splitlines():
        field, _, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [*names, value.lower()] if open_names else [value.lower()]
            open_names = True
            groups.setdefault(value.lower(), [])
        elif field in ("allow", "disallow"):
            open_names = False
            for name in names if value else ():
                groups[name].append((field == "allow", value))
    own = [name for name in groups if name != "*" and name in agent.lower()]
    return groups[max(own, key=len)] if own else groups.get("*", [])


def robots_allow(body: str | None, path: str, agent: str) -> bool:
    """Whether the longest pattern that fits ``path`` allows it; ties allow, and so does silence."""
    return fits(robots_rules(body or "", agent), path)


def fits(rules: list[tuple[bool, str]], path: str) -> bool:
    best = (-1, True)
    for allow, pattern in rules:
        stem = pattern.removesuffix("$")
        form = ".*".join(re.escape(p) for p in stem.split("*")) + ("$" if pattern.endswith("$") else "")
        if re.match(form, path):
            best = max(best, (len(pattern), allow))
    return best[1]


def robots_allows(body: Column, path: Column, agent: str) -> Column:
    """``robots_allow`` for columns, in Arrow batches."""

    @F.pandas_udf(BooleanType())
    def check(bodies: pd.Series, paths: pd.Series) -> pd.Series:
        rules = {b: robots_rules(b or "", agent) for b in set(bodies)}  # a body is read once a batch
        return pd.Series([fits(rules[b], p or "/") for b, p in zip(bodies, paths)], dtype=bool)

    return check(body, path)
