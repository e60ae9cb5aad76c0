"""Changes between consecutive full snapshots, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(attributes: list[str]) -> Column:
    """Hash of a row's attributes, in which an unknown value isn't skipped."""
    return F.xxhash64(*[x for a in attributes for x in (F.col(a).isNull(), F.col(a))])


def intervals(placed: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Islands of unchanged rows: ``keys``, from_pos, to_pos (last position held), adjacent (an island of the key ends at from_pos - 1).

    Two neighbouring rows belong to one island if their positions follow each other and no attribute is known
    on both sides and differs. Equal row hashes end an island's search at once; only unequal ones, which an unknown
    value causes too, compare the attributes.
    Repeated rows of a position count as one. Empty input gives no rows.
    """
    order = Window.partitionBy(*keys).orderBy("pos", *[F.col(a).asc_nulls_last() for a in attributes])
    rows = placed.select(*keys, "pos", *attributes, row_hash(attributes).alias("row_hash"))
    back = rows.select(
        "*", F.lag("pos").over(order).alias("_pos"), F.lag("row_hash").over(order).alias("_hash"),
        *[F.lag(a).over(order).alias(f"_{a}") for a in attributes],
    )
    differs = F.lit(False)
    for a in attributes:
        differs = differs | F.coalesce(F.col(a) != F.col(f"_{a}"), F.lit(False))
    changed = F.when(F.col("row_hash") == F.col("_hash"), False).otherwise(differs)
    gap = F.col("_pos").isNull() | (F.col("_pos") < F.col("pos") - 1)
    change = (F.col("_pos") == F.col("pos") - 1) & changed
    marked = back.withColumn("begins", F.when(gap | change, 1).otherwise(0)).withColumn("next_to", F.when(change, 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(
        F.min("pos").alias("from_pos"), F.max("pos").alias("to_pos"), (F.max("next_to") == 1).alias("adjacent")
    )


def location_changes(placed: DataFrame, series: DataFrame) -> DataFrame:
    """ADDED, REMOVED and MODIFIED locations between consecutive snapshots of a series.

    Columns: base_snapshot_id, target_snapshot_id, scope_id, relative_path, change_type. MODIFIED if digest,
    size or mtime is known on both sides and differs. The first snapshot of a series has no base, so nothing
    is added there; a location in the last one isn't removed.
    """
    keys = ["series", "scope_id", "relative_path"]
    found = intervals(placed, keys, ["digest", "size", "mtime"])
    follows = F.lead("adjacent").over(Window.partitionBy(*keys).orderBy("island"))
    events = found.withColumn("followed", F.coalesce(follows, F.lit(False))).select(
        *keys,
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("from_pos").alias("pos"), F.when(F.col("adjacent"), "MODIFIED").otherwise("ADDED").alias("change_type")),
                    F.when(~F.col("followed"), F.struct((F.col("to_pos") + 1).alias("pos"), F.lit("REMOVED").alias("change_type"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("e"),
    ).select(*keys, "e.pos", "e.change_type")
    pairs = series.where("prev_snapshot_id is not null").select(
        "series", "pos", F.col("prev_snapshot_id").alias("base_snapshot_id"), F.col("snapshot_id").alias("target_snapshot_id")
    )
    return events.join(pairs, ["series", "pos"]).select("base_snapshot_id", "target_snapshot_id", "scope_id", "relative_path", "change_type")
