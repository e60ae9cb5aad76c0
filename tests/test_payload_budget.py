from __future__ import annotations

import hashlib
import random

from strataframe.plans.projections import src_5_payload_hashes
from strataframe.sources import documents


def test_query_hashes_every_document(spark, tmp_path):
    texts = {1: "x" * 5000, 2: "", 3: "é" * 90_000, 4: "y" * 100_000, 5: "short"}  # one source: over 4,096 bytes a file, over 200,000 in all
    spark.createDataFrame([(i, "s", t) for i, t in texts.items()] + [(6, "s", None)], "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {int(r.path): (r.status, r.digest, r.bytes_hashed) for r in src_5_payload_hashes(spark, str(tmp_path)).collect()}
    assert got == {i: ("HASHED" if t else "EMPTY_FILE_HASHED", hashlib.sha256(t.encode()).hexdigest(), len(t.encode())) for i, t in texts.items()}


def test_small_budget_is_used_up_in_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), f"{i:04}", rng.randbytes(rng.choice([0, 100, 3000, 4096, 4097, 9000]))) for i in range(400)]
    plain, left = {}, {"a": 200_000, "b": 200_000}
    for scope, path, content in rows:
        size = len(content)
        status = "FILE_TOO_LARGE" if size > 4096 else "TOTAL_BYTE_BUDGET_EXHAUSTED" if size > left[scope] else "HASHED" if size else "EMPTY_FILE_HASHED"
        if status == "HASHED":
            left[scope] -= size
        plain[scope, path] = status
    shuffled = rng.sample(rows, len(rows))
    files = spark.createDataFrame([(s, p, bytearray(c)) for s, p, c in shuffled], "scope string, path string, content binary")
    got = {(r.scope, r.path): r.status for r in documents.payload_hashes(files, "scope", "path", "content", 4096, 200_000).collect()}
    assert got == plain and set(plain.values()) == {"FILE_TOO_LARGE", "TOTAL_BYTE_BUDGET_EXHAUSTED", "HASHED", "EMPTY_FILE_HASHED"}
