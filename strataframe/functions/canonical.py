"""Canonical JSON and digests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(value: object) -> bytes:
    """Sorted keys, no white space, no escapes beyond need, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode("utf-8", "surrogateescape")


def digest(value: dict, domain: str) -> str:
    """SHA-256 of the value with its domain as a key."""
    return hashlib.sha256(canonical_json(value | {"domain": domain})).hexdigest()


def prefixed_digest(value: object, domain: str) -> str:
    """SHA-256 of the domain, a zero byte and the value."""
    return hashlib.sha256(domain.encode() + b"\0" + canonical_json(value)).hexdigest()


def json_column(**fields: Column) -> Column:
    """Canonical JSON of an object as a column; control characters come out as Python writes them."""
    made = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    for code in [*range(0x0E, 0x20), 0x0B]:
        made = F.replace(made, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return made


def citation(kind: str, content: Column) -> Column:
    return F.concat(F.lit(f"citation:{kind}:"), F.left(F.sha2(content, 256), F.lit(32)))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that identifies the whole result whatever its order: rows, sum and xor of row hashes."""
    h = F.xxhash64(*[F.col(c).cast("string") if t.startswith(("map", "variant")) else F.col(c) for c, t in sorted(df.dtypes)])
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.bit_xor("h").alias("mix"))
