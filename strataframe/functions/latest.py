"""Keeping the row that counts among several deliveries of a key."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], by: str = "recorded_at", firsts: bool = False
) -> DataFrame:
    """One row per key: ``columns`` of the delivery with the greatest ``by``.

    A null ``by`` counts as earliest; among equal ones the greatest row of ``columns`` counts, so the
    result doesn't depend on the order of rows. With ``firsts`` the column ``first_at`` has the smallest
    ``by`` of the key. It is one aggregation that combines before the shuffle, so a key with very many
    deliveries is no hot spot.
    """
    row = F.struct(*[F.col(c) for c in columns])
    pick: Column = F.max(F.struct(F.col(by).alias("_by"), row.alias("_row"))).alias("_pick")
    more = [F.min(by).alias("first_at")] if firsts else []
    out = df.groupBy(*keys).agg(pick, *more)
    return out.select(*keys, *[F.col(f"_pick._row.{c}").alias(c) for c in columns], *(["first_at"] if firsts else []))


def own_folder(master: str) -> str:
    """A new folder for a session whose executors are threads of this process; an error for any other master."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="strataframe-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage, in the shared checkpoint folder.

    The folder is the one in ``spark.checkpoint.dir``. Where a session has none, one under the temporary directory
    is set if all executors are threads of this process; on a cluster, which can't share such a folder, that is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or own_folder(sc.master))
    return df.checkpoint(eager=True)
