"""Sizes rolled up over directories, and their growth between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.paths import ancestors_or_self, parent, strict_ancestors
from strataframe.operators.entries import is_regular, is_special, known_regular_size, sides

NODE = ["snapshot_id", "scope_id", "path"]
_MEASURES = ["regular_count", "directory_count", "symlink_count", "special_count", "known_bytes", "unknown_count"]


def rolled_up(contributions: DataFrame, keys: list[str], owner: str, measures: list[str]) -> DataFrame:
    """Direct and recursive sums of ``measures`` for every directory: keys, path, direct_..., recursive_....

    Rows are summed by owner directory first, so what is multiplied by the depth is the number of directories,
    not of files; a second sum goes over the exploded ancestors. No recursion, two shuffles.
    """
    own = contributions.groupBy(*keys, F.col(owner).alias("path")).agg(*[F.sum(m).alias(m) for m in measures])
    up = own.select(*keys, "path", *measures, F.explode(ancestors_or_self(F.col("path"))).alias("node"))
    itself = F.col("node") == F.col("path")
    return up.groupBy(*keys, "node").agg(
        *[F.coalesce(F.sum(F.when(itself, F.col(m))), F.lit(0)).cast("bigint").alias(f"direct_{m}") for m in measures],
        *[F.sum(m).cast("bigint").alias(f"recursive_{m}") for m in measures],
    ).withColumnRenamed("node", "path")


def structure(entries: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """Directory nodes of each snapshot: NODE, observed, direct_... and recursive_... measures.

    Excluded entries don't count. A directory counts on its own node, everything else on its parent's. An
    unknown size counts as unknown, not as zero bytes. Every scope of ``scopes`` (snapshot_id, scope_id) has a
    node ``.`` even without entries.
    """
    active = entries.where("not excluded")
    is_dir = F.col("object_type") == "directory"
    flag = lambda c: F.when(c, 1).otherwise(0)
    rows = active.select(
        "snapshot_id", "scope_id", F.when(is_dir, F.col("relative_path")).otherwise(parent(F.col("relative_path"))).alias("owner"),
        flag(is_regular()).alias("regular_count"), flag(is_dir).alias("directory_count"), flag(F.col("object_type") == "symlink").alias("symlink_count"),
        flag(is_special()).alias("special_count"), F.coalesce(known_regular_size(), F.lit(0)).alias("known_bytes"), flag(is_regular() & known_regular_size().isNull()).alias("unknown_count"),
    )
    if scopes is not None:
        rows = rows.unionByName(scopes.select("snapshot_id", "scope_id", F.lit(".").alias("owner"), *[F.lit(0).alias(m) for m in _MEASURES]))
    nodes = rolled_up(rows, ["snapshot_id", "scope_id"], "owner", _MEASURES)
    return nodes.withColumn("observed", F.col("direct_directory_count") > 0)


def structure_coverage(entries: DataFrame) -> DataFrame:
    """What of each snapshot is known: one row per snapshot."""
    active, regular = ~F.col("excluded"), is_regular()
    known = active & known_regular_size().isNotNull()
    unknown = active & regular & known_regular_size().isNull()
    failed = active & (F.col("observation_status") != "observed")
    total = entries.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(regular).alias("regular"), F.count_if(known).alias("known_regular"), F.count_if(unknown).alias("unknown_regular"),
        F.coalesce(F.sum(F.when(known, known_regular_size())), F.lit(0)).cast("bigint").alias("known_bytes"), F.count_if(F.col("object_type") == "directory").alias("directories"),
        F.count_if(F.col("object_type") == "symlink").alias("symlinks"), F.count_if(is_special()).alias("specials"), F.count_if("excluded").alias("excluded_count"),
        F.count_if(failed).alias("metadata_failed"), F.count_if(active & regular & (F.col("device_id").isNull() | F.col("inode").isNull())).alias("hint_unavailable"),
    )
    hints = entries.where("not excluded and object_type = 'regular_file' and device_id is not null and inode is not null").groupBy("snapshot_id", "device_id", "inode").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("scope_id").alias("scopes")
    ).where("n >= 2").groupBy("snapshot_id").agg(F.sum("n").alias("hint_members"), F.count_if(F.col("scopes") >= 2).alias("scope_overlaps"))
    return total.join(hints, "snapshot_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("hint_members", "scope_overlaps")} | {"complete": (F.col("unknown_regular") == 0) & (F.col("metadata_failed") == 0)}
    )


def directory_summary(entries: DataFrame) -> DataFrame:
    """Entries under each directory, excluded ones too; ``.`` counts itself: NODE, entries, bytes."""
    rows = entries.select("snapshot_id", "scope_id", parent(F.col("relative_path")).alias("owner"), F.lit(1).alias("entries"), F.coalesce(F.when(is_regular(), F.col("size_bytes")), F.lit(0)).alias("bytes"))
    return rolled_up(rows, ["snapshot_id", "scope_id"], "owner", ["entries", "bytes"]).select(*NODE, F.col("recursive_entries").alias("entries"), F.col("recursive_bytes").alias("bytes"))


def growth(base: DataFrame, target: DataFrame) -> DataFrame:
    """Contribution of every location that is a regular file on a side: kind, delta (null where a size is unknown)."""
    keep = lambda d: d.where("not excluded and object_type = 'regular_file'").withColumn("known", known_regular_size())
    both = sides(keep(base), keep(target), ["pair", "scope_id", "relative_path"], ["known"])
    b, t = F.col("b_known"), F.col("t_known")
    unknown = (F.col("in_b") & b.isNull()) | (F.col("in_t") & t.isNull())
    kind = (
        F.when(unknown, "SIZE_UNKNOWN").when(~F.col("in_b"), "ADDED_LOCATION").when(~F.col("in_t"), "REMOVED_LOCATION")
        .when(t > b, "SAME_LOCATION_SIZE_INCREASE").when(t < b, "SAME_LOCATION_SIZE_DECREASE").otherwise("SAME_LOCATION_SIZE_UNCHANGED")
    )
    return both.select(
        "pair", "scope_id", "relative_path", "in_b", "in_t", kind.alias("kind"), F.when(~unknown, F.coalesce(t, F.lit(0)) - F.coalesce(b, F.lit(0))).alias("delta")
    )


def _bytes(kind: str) -> Column:
    return F.when(F.col("kind") == kind, F.abs("delta")).otherwise(0)


_GROWTH = {"added": "ADDED_LOCATION", "removed": "REMOVED_LOCATION", "increase": "SAME_LOCATION_SIZE_INCREASE", "decrease": "SAME_LOCATION_SIZE_DECREASE"}


def growth_nodes(contributions: DataFrame) -> DataFrame:
    """Growth rolled up over directories: pair, scope_id, path, recursive and direct bytes per kind, net and unknown.

    Net is added less removed plus increase less decrease, by construction.
    """
    rows = contributions.select(
        "pair", "scope_id", parent(F.col("relative_path")).alias("owner"), *[_bytes(k).alias(f"{n}_bytes") for n, k in _GROWTH.items()],
        *[F.when(F.col("kind") == k, 1).otherwise(0).alias(f"{n}_count") for n, k in _GROWTH.items()], F.coalesce("delta", F.lit(0)).alias("net_bytes"),
        F.when(F.col("kind") == "SIZE_UNKNOWN", 1).otherwise(0).alias("unknown_count"),
    )
    return rolled_up(rows, ["pair", "scope_id"], "owner", [c for c in rows.columns if c not in ("pair", "scope_id", "owner")])


def growth_coverage(contributions: DataFrame) -> DataFrame:
    """Counts per pair, the net of known bytes, and whether nothing is unknown."""
    kind = F.col("kind")
    same = F.col("in_b") & F.col("in_t")
    return contributions.groupBy("pair").agg(
        *[F.count_if(kind == k).alias(f"{n}_locations") for n, k in _GROWTH.items()], F.count_if(kind == "SAME_LOCATION_SIZE_UNCHANGED").alias("unchanged_locations"),
        F.count_if(same & (kind != "SIZE_UNKNOWN")).alias("comparable"), F.count_if(same & (kind == "SIZE_UNKNOWN")).alias("same_unknown"),
        F.count_if(~F.col("in_b") & (kind == "SIZE_UNKNOWN")).alias("added_unknown"), F.count_if(~F.col("in_t") & (kind == "SIZE_UNKNOWN")).alias("removed_unknown"),
        F.coalesce(F.sum("delta"), F.lit(0)).cast("bigint").alias("known_net"), (F.count_if(kind == "SIZE_UNKNOWN") == 0).alias("complete"),
    )


def strict_ancestor_rows(entries: DataFrame) -> DataFrame:
    """Every entry under each directory strictly above it: snapshot_id, scope_id, relative_path, ancestor."""
    return entries.select("snapshot_id", "scope_id", "relative_path", F.explode(strict_ancestors(F.col("relative_path"))).alias("ancestor"))
