"""Differences between snapshots, location by location."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.operators.entries import COMPARABLE, METADATA, sides

LOCATION = ["pair", "scope_id", "relative_path"]


def snapshot_diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """One row per location of a pair: change_type and changed_fields (array, in the fixed order of fields).

    Unknown on both sides is equal, unknown on one side is a difference. One shuffled full join on the location.
    """
    both = sides(base, target, LOCATION, COMPARABLE)
    differs = [F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"t_{c}")), F.lit(c)) for c in COMPARABLE]
    fields = F.when(F.col("in_b") & F.col("in_t"), F.array_compact(F.array(*differs))).otherwise(F.array().cast("array<string>"))
    kind = F.when(~F.col("in_b"), "ADDED").when(~F.col("in_t"), "REMOVED").when(F.size("changed_fields") > 0, "MODIFIED").otherwise("UNCHANGED")
    return both.withColumn("changed_fields", fields).withColumn("change_type", kind)


def change_events(diff: DataFrame) -> DataFrame:
    """CREATED, DELETED and MODIFIED events: size_delta if both sizes are known, hash_changed always null."""
    names = F.create_map(*[F.lit(x) for p in (("ADDED", "FILE_CREATED"), ("REMOVED", "FILE_DELETED"), ("MODIFIED", "FILE_MODIFIED")) for x in p])
    return diff.where("change_type <> 'UNCHANGED'").select(
        *LOCATION, names[F.col("change_type")].alias("event_type"), (F.col("t_size_bytes") - F.col("b_size_bytes")).alias("size_delta"),
        F.lit(None).cast("boolean").alias("hash_changed"), F.exists("changed_fields", lambda f: f.isin(METADATA)).alias("metadata_changed"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """Counts per pair and change type, and changes of each kind of field."""
    has = lambda *names: F.exists("changed_fields", lambda f: f.isin(*names))
    changed = F.col("change_type") != "UNCHANGED"
    return diff.groupBy("pair").agg(
        *[F.count_if(F.col("change_type") == k).alias(k.lower()) for k in ("ADDED", "REMOVED", "MODIFIED", "UNCHANGED")],
        F.count_if(changed & has("object_type")).alias("type_changed"), F.count_if(changed & has("observation_status", "error_code", "error_message")).alias("observation_changed"),
    )


def field_comparison(base: DataFrame, target: DataFrame, fields: list[str]) -> DataFrame:
    """Per common location and field: SAME, DIFFERENT or UNKNOWN (unknown on a side); unpivoted."""
    both = sides(base, target, LOCATION, fields, "inner")
    out = lambda c: F.when(F.col(f"b_{c}").isNull() | F.col(f"t_{c}").isNull(), "UNKNOWN").when(F.col(f"b_{c}") == F.col(f"t_{c}"), "SAME").otherwise("DIFFERENT")
    return both.select(*LOCATION, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), out(c).alias("outcome")) for c in fields])).alias("x")).select(*LOCATION, "x.field", "x.outcome")


def revalidated(base: DataFrame, target: DataFrame) -> DataFrame:
    """Historical candidates against what is there now: METADATA_MATCH, CHANGED, UNKNOWN or GONE."""
    fields = ["device_id", "inode", "size_bytes", "mtime_ns"]
    both = sides(base, target, LOCATION, fields, "left")
    unknown, equal = F.lit(False), F.lit(True)
    for c in fields:
        unknown = unknown | F.col(f"b_{c}").isNull() | F.col(f"t_{c}").isNull()
        equal = equal & F.col(f"b_{c}").eqNullSafe(F.col(f"t_{c}"))
    return both.select(*LOCATION, F.when(~F.col("in_t"), "GONE").when(unknown, "UNKNOWN").when(equal, "METADATA_MATCH").otherwise("CHANGED").alias("state"))
