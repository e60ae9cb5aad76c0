"""What became of objects between snapshots, with the certainty of each statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.operators.entries import relation_digest, sides

LOCATION = ["pair", "scope_id", "relative_path"]
_METADATA = ["mode", "uid", "gid", "size_bytes", "mtime_ns", "ctime_ns", "link_count", "readable", "writable", "executable", "observation_status", "error_code", "error_message", "excluded"]


def same_location(base: DataFrame, target: DataFrame) -> DataFrame:
    """Relation of each location observed on both sides: kind and certainty, by the first rule that holds."""
    columns = ["object_type", "device_id", "inode", "birthtime_ns", "symlink_target_raw", "digest", *_METADATA]
    with_digest = lambda d: d.withColumn("digest", relation_digest())
    both = sides(with_digest(base), with_digest(target), LOCATION, columns, "inner").where("b_observation_status = 'observed' and t_observation_status = 'observed'")
    b, t = (lambda c: F.col(f"b_{c}")), (lambda c: F.col(f"t_{c}"))
    births_differ = F.coalesce(b("birthtime_ns") != t("birthtime_ns"), F.lit(False))
    same_object = F.coalesce((b("device_id") == t("device_id")) & (b("inode") == t("inode")), F.lit(False)) & ~births_differ
    regular = b("object_type") == "regular_file"
    metadata = F.lit(False)
    for c in _METADATA:
        metadata = metadata | ~b(c).eqNullSafe(t(c))
    kind = (
        F.when(b("object_type") != t("object_type"), "SAME_LOCATION_TYPE_CHANGED")
        .when((b("object_type") == "symlink") & ~b("symlink_target_raw").eqNullSafe(t("symlink_target_raw")), "SAME_LOCATION_SYMLINK_TARGET_CHANGED")
        .when(regular & ~same_object, "SAME_LOCATION_OBJECT_HINT_CHANGED")
        .when(regular & (b("digest").isNull() | t("digest").isNull()), "SAME_LOCATION_CONTENT_UNKNOWN")
        .when(regular & (b("digest") != t("digest")), "SAME_LOCATION_CONTENT_CHANGED")
        .when(metadata, "SAME_LOCATION_METADATA_CHANGED").otherwise("SAME_LOCATION_CONTINUITY")
    )
    return both.select(*LOCATION, kind.alias("kind")).withColumn("certainty", F.when(F.col("kind") == "SAME_LOCATION_CONTENT_UNKNOWN", "UNKNOWN").otherwise("FACT"))


def transitions(base: DataFrame, target: DataFrame) -> DataFrame:
    """Objects whose location is only in the base and those whose location is only in the target, by object.

    Columns: pair, device_id, inode, birthtime_ns, kind, certainty, sources, targets. A candidate needs the same object, one
    known digest and no other path of the object on either side; several make it ambiguous, an unknown digest
    silent. Both sides are summed per object before they meet, so no pairs are formed.
    """
    hint, obj = ["pair", "device_id", "inode", "birthtime_ns"], ["pair", "device_id", "inode"]
    movable = "object_type = 'regular_file' and observation_status = 'observed' and not excluded and device_id is not null and inode is not null and birthtime_ns is not null"

    def side(own: DataFrame, other: DataFrame, p: str) -> DataFrame:
        gone = own.join(other.select(*LOCATION), LOCATION, "left_anti").where(movable).withColumn("digest", relation_digest())
        each = gone.groupBy(*hint).agg(
            F.count(F.lit(1)).alias(f"{p}_n"), F.count("digest").alias(f"{p}_known"), F.min("digest").alias(f"{p}_d0"), F.max("digest").alias(f"{p}_d1"), F.min("scope_id").alias(f"{p}_scope")
        )
        paths = own.where("device_id is not null and inode is not null").groupBy(*obj).agg(F.count(F.lit(1)).alias(f"{p}_paths"))
        return each.join(paths, obj)

    both = side(base, target, "b").join(side(target, base, "t"), hint).where("b_known = b_n and t_known = t_n")
    unclear = "b_paths > 1 or t_paths > 1 or b_d0 <> b_d1 or t_d0 <> t_d1 or b_d0 <> t_d0"
    kind = F.when(F.expr(unclear), "AMBIGUOUS_LOCATION_TRANSITION").when(F.col("b_scope") == F.col("t_scope"), "RENAME_CANDIDATE").otherwise("CROSS_SCOPE_TRANSITION_CANDIDATE")
    aliased = F.expr("b_paths > 1 or t_paths > 1")
    return both.select(*hint, kind.alias("kind"), F.when(kind == "AMBIGUOUS_LOCATION_TRANSITION", "AMBIGUOUS").otherwise("CANDIDATE").alias("certainty"), F.when(aliased, F.col("b_paths")).otherwise(F.col("b_n")).alias("sources"), F.when(aliased, F.col("t_paths")).otherwise(F.col("t_n")).alias("targets"))
