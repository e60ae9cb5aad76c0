"""Evidence files of runs: write once, read with errors as rows."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions.canonical import canonical_json

NAME = r"^[0-9]{8}_[a-z_.]+\.json$"


def write_evidence(folder: str, run_id: str, sequence: int, kind: str, payload: dict, previous: str | None) -> dict:
    """Appends one record to a run and returns it. An existing file is never overwritten; what was written is read back."""
    record = {"run_id": run_id, "sequence": sequence, "evidence_type": kind, "payload": payload, "previous_evidence_digest": previous}
    record["evidence_digest"] = hashlib.sha256(canonical_json(record)).hexdigest()
    target = os.path.join(folder, run_id, f"{sequence:08d}_{kind}.json")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(target), suffix=".tmp")
    with os.fdopen(fd, "wb") as f:
        f.write(canonical_json(record))
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(temporary, target)  # fails if the target exists
    finally:
        os.unlink(temporary)
    with open(target, "rb") as f:
        if json.load(f) != record:
            raise OSError("evidence differs from what was written")
    return record


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """file, run_id, sequence, evidence_type, previous, digest, payload, problem per file; temporary files are left out.

    problem: NAME_INVALID, JSON_INVALID or KEYS_MISSING, null for a sound record.
    """
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("file"), F.col("value")).where(~F.col("file").endswith(".tmp"))
    v = F.try_parse_json("value")
    at = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
    rows = raw.select(
        "file", at("run_id", "string").alias("run_id"), at("sequence", "int").alias("sequence"), at("evidence_type", "string").alias("evidence_type"), at("previous_evidence_digest", "string").alias("previous"),
        at("evidence_digest", "string").alias("digest"), F.to_json(at("payload", "variant")).alias("payload"), v.isNotNull().alias("_json"),
    )
    problem = F.when(~F.col("file").rlike(NAME), "NAME_INVALID").when(~F.col("_json"), "JSON_INVALID").when(F.col("run_id").isNull() | F.col("sequence").isNull() | F.col("digest").isNull(), "KEYS_MISSING")
    return rows.withColumn("problem", problem).drop("_json")
