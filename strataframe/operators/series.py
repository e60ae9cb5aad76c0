"""Snapshots in order, and document locations placed in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.ids import digest_key, instant, key_text, known, known_size, uuid_key
from strataframe.functions.latest import latest


def numbered(df: DataFrame, keys: list[str], bucket: str, order: list, name: str = "pos") -> DataFrame:
    """``df`` with the rank (from 1) of each row within ``keys`` by (``bucket``, ``order``).

    The rank is that within the key's bucket plus the rows of earlier buckets, so a key with a large part
    of all rows is spread over its buckets instead of being sorted in one task.
    """
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(F.col(bucket).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(within))
    on = [ranked[k].eqNullSafe(offsets[f"_k{i}"]) for i, k in enumerate(keys)] + [ranked[bucket].eqNullSafe(offsets["_b"])]
    joined = ranked.join(offsets, on, "inner")
    return joined.select(*df.columns, (F.col("_rank") + F.col("_before")).cast("int").alias(name))


def snapshot_series(snapshots: DataFrame) -> DataFrame:
    """Counted snapshots with their place in the series of one installation and scope.

    Columns: snapshot_id, series (16 bytes that stand for config_digest and scope), scope_id, pos (from 1, by
    the instant of completed_at, then snapshot_id), prev_snapshot_id, last_pos. Counted are snapshots whose
    latest delivery has status ``complete`` and no deleted_at. A completed_at that can't be read sorts last;
    a null snapshot_id or an empty scope list drops the row.
    """
    rows = snapshots.select(
        uuid_key(F.col("snapshot_id")).alias("snapshot_id"), digest_key(F.col("config_digest")).alias("config_digest"),
        F.get(F.col("scope_ids"), F.lit(0)).alias("scope_id"), F.lower(known(F.col("status"))).alias("status"),
        instant(F.col("completed_at")).alias("completed_at"), "deleted_at", "recorded_at",
    ).where("snapshot_id is not null")
    counted = latest(rows, ["snapshot_id"], ["config_digest", "scope_id", "status", "completed_at", "deleted_at"]).where(
        "status = 'complete' and deleted_at is null and scope_id is not null"
    )
    keyed = counted.select(
        "snapshot_id", "scope_id", "completed_at",
        F.unhex(F.md5(F.concat_ws("\0", F.coalesce("config_digest", F.lit("")), "scope_id"))).alias("series"),
        F.trunc("completed_at", "month").alias("month"),
    )
    ranked = numbered(keyed, ["series"], "month", [F.col("completed_at").asc_nulls_last(), F.col("snapshot_id")])
    # A position and its neighbour meet in one small group each, not in a window over the whole series.
    slots = ranked.select("series", "pos", "snapshot_id", "scope_id", F.lit(None).cast("string").alias("prev")).unionByName(
        ranked.select("series", (F.col("pos") + 1).alias("pos"), F.lit(None).cast("string").alias("snapshot_id"), "scope_id", F.col("snapshot_id").alias("prev"))
    )
    linked = slots.groupBy("series", "pos").agg(
        F.max("snapshot_id").alias("snapshot_id"), F.max("scope_id").alias("scope_id"), F.max("prev").alias("prev_snapshot_id")
    ).where("snapshot_id is not null")
    ends = ranked.groupBy("series").agg(F.max("pos").alias("last_pos"))
    return linked.join(ends, "series")


def placed_identities(identities: DataFrame, entries: DataFrame, series: DataFrame) -> DataFrame:
    """Every counted observation of a document location.

    Columns: series, pos, scope_id, relative_path, digest, size, mtime (null where unknown). The latest
    delivery of an entry counts; a missing path or scope is that of the entry's latest delivery. Rows that no
    snapshot of ``series`` holds, and rows whose path stays unknown, drop out.
    """
    rows = identities.select(
        key_text(F.col("entry_id")).alias("entry_id"), uuid_key(F.col("snapshot_id")).alias("snapshot_id"),
        F.nullif(F.col("scope_id"), F.lit("")).alias("scope_id"), F.nullif(F.col("relative_path"), F.lit("")).alias("relative_path"),
        digest_key(F.col("payload_sha256")).alias("digest"), known_size(F.col("size_bytes")).alias("size"), F.col("mtime_ns").alias("mtime"), "recorded_at",
    ).where("entry_id is not null")
    counted = latest(rows, ["entry_id"], ["snapshot_id", "scope_id", "relative_path", "digest", "size", "mtime"])
    # Only entries of which some delivery lacks a place are looked up; the filter reaches the scan.
    lacking = (
        identities.where("relative_path is null or relative_path = '' or scope_id is null or scope_id = ''")
        .select(key_text(F.col("entry_id")).alias("entry_id")).distinct()
    )
    found = entries.select(
        key_text(F.col("entry_id")).alias("entry_id"), F.col("scope_id").alias("entry_scope"), F.col("relative_path").alias("entry_path"), "recorded_at"
    ).join(lacking, "entry_id", "left_semi")
    places = latest(found, ["entry_id"], ["entry_scope", "entry_path"])
    full = counted.join(places, "entry_id", "left").select(
        "snapshot_id", F.coalesce("scope_id", "entry_scope").alias("scope_id"), F.coalesce("relative_path", "entry_path").alias("relative_path"),
        "digest", "size", "mtime",
    ).where("relative_path is not null and relative_path <> ''")
    where = series.select("snapshot_id", "series", "pos")
    return full.join(where, "snapshot_id").drop("snapshot_id")
