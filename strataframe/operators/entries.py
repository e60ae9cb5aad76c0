"""The relation of snapshot entries, and predicates over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.ids import key_text, uuid_key
from strataframe.functions.latest import latest

# Fixed values, in the order in which changes are reported.
COMPARABLE = [
    "object_type", "device_id", "inode", "mode", "uid", "gid", "size_bytes", "mtime_ns", "ctime_ns", "birthtime_ns", "link_count", "symlink_target_raw",
    "readable", "writable", "executable", "observation_status", "error_code", "error_message", "excluded",
]
METADATA = [c for c in COMPARABLE if c != "size_bytes"]
OBJECT_TYPES = ["regular_file", "directory", "symlink", "fifo", "socket", "block_device", "character_device", "unknown"]
_PAYLOAD = ["status", "algorithm", "algorithm_version", "digest", "bytes_hashed", "provenance", "reused_from_snapshot_id", "failure_code"]


def counted_entries(entries: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """Latest delivery of every entry, with payload fields as ``p_...``; with ``series`` only those of its snapshots.

    Null entry ids drop out. ``snapshot_id`` is in its one spelling.
    """
    columns = ["snapshot_id", "scope_id", "relative_path", *COMPARABLE, "allocated_size_bytes", *[f"p_{c}" for c in _PAYLOAD]]
    rows = entries.select(
        key_text(F.col("entry_id")).alias("entry_id"), uuid_key(F.col("snapshot_id")).alias("snapshot_id"), "scope_id", "relative_path", *COMPARABLE,
        "allocated_size_bytes", *[F.col(f"payload_observation.{c}").alias(f"p_{c}") for c in _PAYLOAD], "recorded_at",
    ).where("entry_id is not null")
    out = latest(rows, ["entry_id"], columns)
    return out if series is None else out.join(series.select("snapshot_id"), "snapshot_id", "left_semi")


def object_type(mode: Column) -> Column:
    """Type of a file from the format bits of its mode."""
    kind = mode.bitwiseAND(F.lit(0xF000))
    names = {0x8000: "regular_file", 0x4000: "directory", 0xA000: "symlink", 0x1000: "fifo", 0xC000: "socket", 0x6000: "block_device", 0x2000: "character_device"}
    out = F.lit("unknown")
    for bits, name in names.items():
        out = F.when(kind == bits, name).otherwise(out)
    return out


def is_regular() -> Column:
    return F.col("object_type") == "regular_file"


def is_special() -> Column:
    return ~F.col("object_type").isin("regular_file", "directory", "symlink")


def known_regular_size() -> Column:
    """Size of an observed regular file; null where unknown or negative."""
    return F.when(is_regular() & (F.col("observation_status") == "observed") & (F.col("size_bytes") >= 0), F.col("size_bytes"))


def _hashed() -> Column:
    return F.coalesce(F.col("p_status").isin("HASHED", "EMPTY_FILE_HASHED"), F.lit(False))


def _sound_digest(reused_ok: bool) -> Column:
    source = F.col("p_provenance") == "DIRECT_READ"
    if reused_ok:
        source = source | ((F.col("p_provenance") == "REUSED_FROM_VERIFIED_SNAPSHOT") & F.col("p_reused_from_snapshot_id").isNotNull())
    return _hashed() & (F.col("p_algorithm") == "sha256") & (F.col("p_algorithm_version") == 1) & F.col("p_digest").rlike("^[0-9a-f]{64}$") & source


def payload_eligible(reused_ok: bool = True) -> Column:
    """Whether an entry's digest may be compared for duplicates: observed, not excluded, hashed whole."""
    return F.coalesce(
        is_regular() & (F.col("observation_status") == "observed") & ~F.col("excluded") & _sound_digest(reused_ok)
        & F.col("size_bytes").isNotNull() & (F.col("p_bytes_hashed") == F.col("size_bytes")), F.lit(False),
    )


def relation_digest(reused_ok: bool = True) -> Column:
    """Digest for relations between snapshots: like payload_eligible, but excluded and unobserved entries count, and unknown sizes if both are."""
    return F.when(F.coalesce(_sound_digest(reused_ok) & F.col("p_bytes_hashed").eqNullSafe(F.col("size_bytes")), F.lit(False)), F.col("p_digest"))


def unknown_reason(reused_ok: bool = True) -> Column:
    """Why a regular entry can't be analysed; the first reason that holds."""
    out = F.when(F.col("excluded"), "ENTRY_EXCLUDED").when(F.col("observation_status") != "observed", F.concat(F.lit("METADATA_"), F.upper("observation_status")))
    if not reused_ok:
        out = out.when(_hashed() & (F.col("p_provenance") == "REUSED_FROM_VERIFIED_SNAPSHOT"), "SOURCE_INVALID_REUSED")
    return out.when(F.col("p_failure_code").isNotNull(), F.col("p_failure_code")).when(_hashed(), "MALFORMED_PAYLOAD_OBSERVATION").otherwise(F.col("p_status"))


def paired(entries: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base and target entries of all consecutive snapshots, with the key ``pair`` (the target's id)."""
    pairs = series.where("prev_snapshot_id is not null")
    base = entries.join(pairs.select(F.col("prev_snapshot_id").alias("snapshot_id"), F.col("snapshot_id").alias("pair")), "snapshot_id")
    target = entries.join(pairs.select("snapshot_id", F.col("snapshot_id").alias("pair")), "snapshot_id")
    return base, target


def sides(base: DataFrame, target: DataFrame, on: list[str], columns: list[str], how: str = "full") -> DataFrame:
    """Base and target rows joined on ``on``; columns ``b_...`` and ``t_...``, presence ``in_b`` and ``in_t``."""
    b = base.select(*on, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("in_b"))
    t = target.select(*on, *[F.col(c).alias(f"t_{c}") for c in columns], F.lit(True).alias("in_t"))
    return b.join(t, on, how).withColumn("in_b", F.coalesce("in_b", F.lit(False))).withColumn("in_t", F.coalesce("in_t", F.lit(False)))
