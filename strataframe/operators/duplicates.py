"""Exact duplicates, hard links and conflicting observations within snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.operators.entries import payload_eligible, unknown_reason

HINT = ["snapshot_id", "device_id", "inode"]


def observed_regular(entries: DataFrame) -> DataFrame:
    return entries.where("object_type = 'regular_file' and observation_status = 'observed' and not excluded")


def alias_sets(entries: DataFrame) -> DataFrame:
    """Objects with two or more paths: HINT, paths. Paths are counted, not gathered."""
    return observed_regular(entries).where("device_id is not null and inode is not null").groupBy(*HINT).agg(F.count(F.lit(1)).alias("paths")).where("paths >= 2")


def hint_conflicts(entries: DataFrame, reused_ok: bool = True) -> DataFrame:
    """Contradictions among the paths of one object: HINT, code, members."""
    key = F.when(payload_eligible(reused_ok), F.struct("p_digest", "size_bytes"))
    each = observed_regular(entries).where("device_id is not null and inode is not null").groupBy(*HINT).agg(
        F.count(F.lit(1)).alias("members"), F.min(key).alias("k0"), F.max(key).alias("k1"), F.min("size_bytes").alias("s0"), F.max("size_bytes").alias("s1"),
        F.min("link_count").alias("links"), F.min("allocated_size_bytes").alias("a0"), F.max("allocated_size_bytes").alias("a1"),
    ).where("members >= 2")
    codes = F.array_compact(F.array(
        F.when(F.col("k0") != F.col("k1"), "OBJECT_HINT_PAYLOAD_CONFLICT"), F.when(F.col("s0") != F.col("s1"), "OBJECT_HINT_SIZE_CONFLICT"),
        F.when(F.col("links") < F.col("members"), "LINK_COUNT_CONFLICT"), F.when(F.col("a0") != F.col("a1"), "ALLOCATED_SIZE_CONFLICT"),
    ))
    return each.select(*HINT, F.explode(codes).alias("code"), "members")


def payload_size_conflicts(entries: DataFrame, reused_ok: bool = True) -> DataFrame:
    """Digests of a snapshot that come with more than one size: snapshot_id, p_digest, members."""
    return entries.where(payload_eligible(reused_ok)).groupBy("snapshot_id", "p_digest").agg(
        F.count(F.lit(1)).alias("members"), F.min("size_bytes").alias("s0"), F.max("size_bytes").alias("s1")
    ).where("s0 <> s1").select("snapshot_id", "p_digest", "members")


def payload_groups(entries: DataFrame, reused_ok: bool = True) -> DataFrame:
    """Groups of equal content: snapshot_id, digest, size, members, known_units, unknown_units, is_exact_duplicate, path_bytes, unit_bytes, redundant_bytes.

    A storage unit is a distinct object; members without a known object are unknown units of their own.
    Conflicted objects aren't known units. Redundant bytes are null unless two units are known and none is
    unknown or conflicted. Digests that come with several sizes form no group. Members are summed per object
    before the shuffle, so a digest with a large part of all rows is no hot spot.
    """
    sound = entries.where(payload_eligible(reused_ok)).join(payload_size_conflicts(entries, reused_ok), ["snapshot_id", "p_digest"], "left_anti")
    bad = hint_conflicts(entries, reused_ok).select(*HINT).distinct().withColumn("conflicted", F.lit(True))
    units = sound.groupBy("snapshot_id", "p_digest", "size_bytes", "device_id", "inode").agg(F.count(F.lit(1)).alias("n")).join(bad, HINT, "left")
    known = F.col("device_id").isNotNull() & F.col("inode").isNotNull()
    conflicted = F.coalesce("conflicted", F.lit(False))
    g = units.groupBy("snapshot_id", F.col("p_digest").alias("digest"), F.col("size_bytes").alias("size")).agg(
        F.sum("n").alias("members"), F.count_if(known & ~conflicted).alias("known_units"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unknown_units"), F.count_if(known & conflicted).alias("_bad"),
    ).where("members >= 2")
    return g.select(
        "snapshot_id", "digest", "size", "members", "known_units", "unknown_units", (F.col("known_units") >= 2).alias("is_exact_duplicate"), (F.col("size") * F.col("members")).alias("path_bytes"),
        (F.col("size") * F.col("known_units")).alias("unit_bytes"),
        F.when((F.col("known_units") >= 2) & (F.col("unknown_units") == 0) & (F.col("_bad") == 0), F.col("size") * (F.col("known_units") - 1)).alias("redundant_bytes"),
    )


def duplicate_coverage(entries: DataFrame, reused_ok: bool = True) -> DataFrame:
    """How much of each snapshot could be analysed: counts and bytes of analysable and unknown regular files."""
    ok = payload_eligible(reused_ok)
    size = F.coalesce("size_bytes", F.lit(0))
    return entries.where("object_type = 'regular_file'").groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("regular"), F.count_if(ok).alias("analysable"), F.count_if(~ok).alias("unknown"),
        F.coalesce(F.sum(F.when(ok, size)), F.lit(0)).cast("bigint").alias("analysable_bytes"), F.coalesce(F.sum(F.when(~ok, size)), F.lit(0)).cast("bigint").alias("unknown_bytes"),
    )


def unknown_reasons(entries: DataFrame, reused_ok: bool = True) -> DataFrame:
    """Why regular files couldn't be analysed: snapshot_id, reason, files."""
    return entries.where(F.col("object_type") == "regular_file").where(~payload_eligible(reused_ok)).groupBy("snapshot_id", unknown_reason(reused_ok).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def physical_summary(entries: DataFrame, reused_ok: bool = True) -> DataFrame:
    """Allocated bytes per snapshot: those of objects with one path and a known allocation; all others are unknown units."""
    bad = hint_conflicts(entries, reused_ok).select(*HINT).distinct().withColumn("conflicted", F.lit(True))
    units = observed_regular(entries).groupBy(*HINT).agg(F.count(F.lit(1)).alias("n"), F.max("allocated_size_bytes").alias("a")).join(bad, HINT, "left")
    known = F.col("device_id").isNotNull() & F.col("inode").isNotNull()
    counted = known & (F.col("n") == 1) & F.col("a").isNotNull() & F.col("conflicted").isNull()
    return units.groupBy("snapshot_id").agg(
        F.coalesce(F.sum(F.when(counted, F.col("a"))), F.lit(0)).cast("bigint").alias("known_bytes"), F.count_if(counted).alias("known_units"),
        F.coalesce(F.sum(F.when(known & ~counted, 1).when(~known, F.col("n"))), F.lit(0)).cast("bigint").alias("unknown_units"),
    )
