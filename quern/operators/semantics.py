"""Review states and who may see what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VERIFIED, MACHINE, OPEN = "human_verified", "machine_validated", "needs_review"
#: States that the site shows, and those that research output and indexes carry.
PUBLIC = (OPEN, MACHINE, VERIFIED)
RESEARCH = (VERIFIED, MACHINE)


def latest_decisions(decisions: DataFrame, id: str, at: str, key: str) -> DataFrame:
    """The last decision on each statement; the larger key wins a tie of time."""
    w = Window.partitionBy(id).orderBy(F.col(at).desc(), F.col(key).desc())
    return decisions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def effective_states(statements: DataFrame, decisions: DataFrame, id: str, stored: str, claim: str, at: str, key: str, result: str, accepted: str) -> DataFrame:
    """``statements`` with ``effective_state``.

    The latest decision counts if it does not verify, or if it verified just the claim that the
    statement makes now. A stored verification that the latest decision does not cover is stale
    and needs review again. Without a decision the stored state holds.
    """
    d = latest_decisions(decisions, id, at, key).select(id, F.col(result).alias("_result"), F.col(accepted).alias("_accepted"), F.lit(True).alias("_decided"))
    covers = (F.col("_result") != VERIFIED) | (F.col("_accepted") == F.col(claim))
    state = F.when(F.col("_decided") & covers, F.col("_result")).when(F.col("_decided") & (F.col(stored) == VERIFIED), OPEN).otherwise(F.col(stored))
    return statements.join(d, id, "left").withColumn("effective_state", state).drop("_result", "_accepted", "_decided")


def on_site(state: str, source_state: str, evidence_matches: Column) -> Column:
    return F.col(state).isin(*PUBLIC) & evidence_matches & (F.col(source_state) != "rejected")


def in_research(state: str, source_state: str, evidence_matches: Column) -> Column:
    return F.col(state).isin(*RESEARCH) & evidence_matches & F.col(source_state).isin(*RESEARCH)
