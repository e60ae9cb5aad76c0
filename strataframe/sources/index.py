"""The stored index of snapshots: versions of a dataset behind a pointer file."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from strataframe.functions.canonical import fingerprint


def _identity(df: DataFrame) -> dict:
    row = fingerprint(df).first()
    return {"rows": row["rows"], "total": str(row["total"]), "mix": row["mix"], "columns": sorted(df.columns)}


def write_version(entries: DataFrame, folder: str) -> str:
    """Writes a new version, partitioned by snapshot so that one snapshot is one folder, and checks it against its source."""
    version = uuid.uuid4().hex
    path = f"{folder}/{version}"
    entries.repartition("snapshot_id").sortWithinPartitions("snapshot_id", "scope_id", "relative_path").write.mode("errorifexists").partitionBy("snapshot_id").parquet(f"{path}/entries")
    back = entries.sparkSession.read.schema(entries.schema).parquet(f"{path}/entries").select(*entries.columns)
    found, source = _identity(back), _identity(entries)
    if found != source:
        raise ValueError("the written index differs from its source")
    with open(f"{path}/manifest.json", "w") as f:
        json.dump(found, f)
    return version


def publish(folder: str, version: str, expected: str | None = None) -> str | None:
    """Makes a version the current one by an atomic rename of the pointer; returns the one before. ``expected`` guards against a race."""
    before = current(folder)
    if expected is not None and before != expected:
        raise ValueError("the index was replaced meanwhile")
    if not os.path.exists(f"{folder}/{version}/manifest.json"):
        raise ValueError("the version is not complete")
    temporary = f"{folder}/.current.{uuid.uuid4().hex}"
    with open(temporary, "w") as f:
        f.write(version)
    os.replace(temporary, f"{folder}/CURRENT")
    return before


def current(folder: str) -> str | None:
    try:
        with open(f"{folder}/CURRENT") as f:
            return f.read().strip()
    except FileNotFoundError:
        return None


def read_current(spark: SparkSession, folder: str, snapshot_id: str | None = None) -> DataFrame:
    """Entries of the current version; a snapshot id prunes the scan to its folder."""
    df = spark.read.parquet(f"{folder}/{current(folder)}/entries")
    return df if snapshot_id is None else df.where(df["snapshot_id"] == snapshot_id)


def rollback(folder: str, version: str) -> None:
    """Goes back to an earlier complete version; other data is untouched because only the pointer moves."""
    publish(folder, version)


class GuardedRead:
    """Input files of a DataFrame must be the same before and after: ``with GuardedRead(df): ...``."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @staticmethod
    def _state(df: DataFrame) -> list[tuple]:
        paths = sorted(p.removeprefix("file://") for p in df.inputFiles())
        return [(p, (s := os.stat(p)).st_ino, s.st_size, s.st_mtime_ns) for p in paths]

    def __enter__(self) -> DataFrame:
        self.before = self._state(self.df)
        return self.df

    def __exit__(self, *error) -> None:
        if error[0] is None and self._state(self.df) != self.before:
            raise RuntimeError("input files changed during the read")
