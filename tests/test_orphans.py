from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from strataframe.operators.orphans import bloom_bits, bloom_filter, orphan_references, orphan_report, parent_keys, perhaps

T = lambda day: datetime(2026, 1, day)
U = "00000000-0000-4000-8000-0000000000{:02d}".format


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("ref"))
    others = spark.range(5000, 15000).select(F.sha2(F.col("id").cast("string"), 256).alias("ref"))
    bits = bloom_bits(5000)
    words = bloom_filter(keys, "ref", bits)
    assert keys.where(~perhaps(words, bits, F.col("ref"))).count() == 0
    assert others.where(perhaps(words, bits, F.col("ref"))).count() < 300


def test_saturated_filter_changes_no_result(spark):
    keys = spark.range(300).select(F.col("id").cast("string").alias("ref"))
    words = bloom_filter(keys, "ref", 1024)
    assert keys.where(perhaps(words, 1024, F.col("ref"))).count() == 300


def test_kinds_of_orphans(spark):
    parents = spark.createDataFrame(
        [(U(1), T(1), None), (U(2), T(1), T(5)), (U(3), T(9), None), (U(4), T(1), T(3)), (U(4), T(8), None), (None, T(1), None)], "id string, recorded_at timestamp_ntz, deleted_at timestamp_ntz"
    )
    children = spark.createDataFrame(
        [
            ("ok", U(1), T(4)), ("spelled", "  " + U(1).upper() + "\t", T(4)), ("bare", U(1).replace("-", ""), T(4)), ("deleted", U(2), T(5)), ("before", U(2), T(4)), ("late", U(3), T(4)), ("revived", U(4), T(4)), ("missing", U(9), T(4)),
            ("corrected", U(9), T(4)), ("corrected", U(1), T(6)), ("again", U(1), T(4)), ("again", U(9), T(6)), ("blank", " ", T(4)), ("null", None, T(4)), (None, U(9), T(4)),
        ],
        "k string, ref string, recorded_at timestamp_ntz",
    ).withColumn("parent_first", F.lit(1))
    found = orphan_references(children, "c", "k", "ref", parent_keys(parents, "id"))
    assert sorted((r.child_key, r.ref_key, r.orphan_kind, r.period) for r in found.collect()) == [
        ("again", U(9), "missing", "2026-01"), ("deleted", U(2), "deleted", "2026-01"), ("late", U(3), "late", "2026-01"), ("missing", U(9), "missing", "2026-01")
    ]
    assert sorted((r.orphan_kind, r.orphans) for r in orphan_report(found).collect()) == [("deleted", 1), ("late", 1), ("missing", 2)]


def test_empty_tables(spark):
    parents = spark.createDataFrame([], "id string, recorded_at timestamp_ntz, deleted_at timestamp_ntz")
    children = spark.createDataFrame([("a", U(1), T(4))], "k string, ref string, recorded_at timestamp_ntz")
    assert [r.orphan_kind for r in orphan_references(children, "c", "k", "ref", parent_keys(parents, "id")).collect()] == ["missing"]
    assert orphan_references(children.limit(0), "c", "k", "ref", parent_keys(parents, "id")).count() == 0
