from __future__ import annotations

from strataframe.streaming import ledger as streams

SCHEMA = "run_id string, sequence int, digest string, previous string"


def test_a_record_that_comes_a_batch_late_is_no_gap(spark, tmp_path):
    source = str(tmp_path / "in")
    batches = [[("r", 1, "a", None), ("r", 3, "c", "b"), ("q", 1, "x", None)], [("r", 2, "b", "a"), ("r", 4, "d", "BAD")], [("q", 1, "x", None), ("r", 6, "f", "e")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        live = spark.readStream.schema(SCHEMA).parquet(source)
        q = streams.checked_chain(live).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("q", 1, "SEQUENCE_GAP"), ("r", 4, "PREVIOUS_DIGEST_MISMATCH")]  # 6 still waits for 5
