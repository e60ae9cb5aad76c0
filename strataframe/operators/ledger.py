"""The ledger of runs and evidence: chains, states, integrity, foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states a run may go to from each state.
TRANSITIONS = {
    "created": ["scanning", "planning", "applying", "verifying", "rolling_back", "cancelled", "failed"], "scanning": ["scanned", "partial", "cancelled", "failed"], "scanned": ["planning", "verifying", "failed"],
    "planning": ["planned", "cancelled", "failed"], "planned": ["applying", "cancelled", "failed"], "applying": ["applied", "partial", "failed"], "applied": ["verifying", "rolling_back", "failed"],
    "verifying": ["verified", "partial", "failed"], "verified": ["rolling_back"], "partial": ["verifying", "rolling_back", "failed"], "failed": ["rolling_back"], "cancelled": [], "rolling_back": ["rolled_back", "partial", "failed"], "rolled_back": [],
}
TERMINAL = ["verified", "failed", "cancelled", "rolled_back"]
# Problems that leave a snapshot usable; every other one makes it invalid.
DEGRADING = ["SNAPSHOT_EVIDENCE_ORPHANED", "SNAPSHOT_INDEX_MISSING", "SNAPSHOT_INDEX_INCOMPLETE", "SNAPSHOT_ENTRY_INDEX_INCOMPLETE", "SNAPSHOT_ENTRY_INDEX_INCONSISTENT"]


def chain(records: DataFrame, key: str, sequence: str, own: str, previous: str) -> DataFrame:
    """Records of each chain with what is wrong with them: codes SEQUENCE_GAP and PREVIOUS_DIGEST_MISMATCH.

    Sequences count up from 1, and each record names the digest of the one before; the first names none.
    """
    w = Window.partitionBy(key).orderBy(sequence, own)
    gap = F.col(sequence) != F.row_number().over(w)
    broken = ~F.col(previous).eqNullSafe(F.lag(own).over(w))
    return records.withColumn("codes", F.array_compact(F.array(F.when(gap, "SEQUENCE_GAP"), F.when(broken, "PREVIOUS_DIGEST_MISMATCH"))))


def replayed_states(transitions: DataFrame, key: str, sequence: str, status: str) -> DataFrame:
    """Last state of each run and the transitions the rules don't allow: key, status, illegal, terminal."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs])
    w = Window.partitionBy(key).orderBy(sequence)
    step = F.concat(F.lag(status, 1, "created").over(w), F.lit(">"), F.col(status))
    judged = transitions.withColumn("_bad", ~F.array_contains(allowed, step) & ~((F.row_number().over(w) == 1) & (F.col(status) == "created")))
    out = judged.groupBy(key).agg(F.max_by(status, sequence).alias("status"), F.count_if("_bad").alias("illegal"))
    return out.withColumn("terminal", F.col("status").isin(TERMINAL))


def severity(code: Column) -> Column:
    """DEGRADED for problems of the index, INVALID for all others, known or not."""
    return F.when(code.isin(DEGRADING), "DEGRADED").otherwise("INVALID")


def classified(snapshots: DataFrame, issues: DataFrame) -> DataFrame:
    """Snapshots with the worst severity of their problems: snapshot_id, integrity, codes.

    ``issues``: code, snapshot_id and evidence_id, either empty for any. Problems with both keys, one or none
    are attached by an equi-join each, so no snapshot is compared with every problem.
    """
    i = issues.select("code", F.coalesce("snapshot_id", F.lit("")).alias("snapshot_id"), F.coalesce("evidence_id", F.lit("")).alias("evidence_id"))
    own = snapshots.select("snapshot_id", "evidence_id")
    both = own.join(i.where("snapshot_id <> '' and evidence_id <> ''"), ["snapshot_id", "evidence_id"]).select("snapshot_id", "code")
    by_id = own.join(i.where("snapshot_id <> '' and evidence_id = ''").select("snapshot_id", "code"), "snapshot_id").select("snapshot_id", "code")
    by_evidence = own.join(i.where("snapshot_id = '' and evidence_id <> ''").select("evidence_id", "code"), "evidence_id").select("snapshot_id", "code")
    attached = both.unionByName(by_id).unionByName(by_evidence).groupBy("snapshot_id").agg(F.collect_set("code").alias("codes"), F.max(F.when(severity(F.col("code")) == "INVALID", 2).otherwise(1)).alias("_w"))
    return own.select("snapshot_id").distinct().join(attached, "snapshot_id", "left").select(
        "snapshot_id", F.when(F.col("_w") == 2, "INVALID").when(F.col("_w") == 1, "DEGRADED").otherwise("HEALTHY").alias("integrity"), F.array_join(F.array_sort(F.coalesce("codes", F.array().cast("array<string>"))), ",").alias("codes")
    )


def duplicates_of(rows: DataFrame, key: str, code: str) -> DataFrame:
    """Keys that several records have, and whether these contradict each other: key, code, records, contents."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("content").alias("contents")).where("records > 1").withColumn("code", F.lit(code))


def disposition(status: Column, has_snapshot: Column, snapshot_status: Column) -> Column:
    """What an acquisition needs next, from its last state."""
    return (
        F.when(status == "created", "RECOVERY_REQUIRED_PRE_SCAN").when((status == "scanning") & has_snapshot, "RECOVERY_REQUIRED_CLOSE_SNAPSHOT").when(status == "scanning", "RECOVERY_REQUIRED_NO_SNAPSHOT")
        .when(status.isin("scanned", "partial", "verifying"), "RECOVERY_REQUIRED_VERIFY").when((status == "verified") & has_snapshot & (snapshot_status == "partial"), "PARTIAL")
        .when((status == "verified") & has_snapshot, "COMPLETE").when(status == "failed", "FAILED").when(status == "cancelled", "CANCELLED").otherwise("INVALID")
    )


def foreign_key_violations(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Children whose known key no parent has."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def append_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that got lost or changed between two states of a ledger; empty for an append."""
    return before.exceptAll(after.select(*before.columns))
