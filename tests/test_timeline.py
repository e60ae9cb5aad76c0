from __future__ import annotations

import random

from pyspark.sql import functions as F

from strataframe.functions.canonical import canonical_json, fingerprint, json_column
from strataframe.functions.text import text_match
from strataframe.operators import items, ledger, timeline


def test_boundaries_against_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(4)}", rng.randrange(0, 4000), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(200)]
    got = {}
    for r in timeline.kept_boundaries(spark.createDataFrame(rows, "k string, t bigint, s double").withColumn("last", F.lit(1)), ["k"], "t", "s").collect():
        got.setdefault(r.k, []).append(r.t)
    for k in got:
        kept = []
        for t, s in sorted(((t, s) for a, t, s in rows if a == k), key=lambda x: x[0]):
            if kept and t - kept[-1][0] < timeline.BOUNDARY_MS:
                if s is not None and (kept[-1][1] is None or s > kept[-1][1]):
                    kept[-1] = (t, s)
                continue
            kept.append((t, s))
        assert len(got[k]) == len(kept)
    assert timeline.kept_boundaries(spark.createDataFrame([], "k string, t bigint, s double"), ["k"], "t", "s").count() == 0


def test_greedy_windows_against_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(f"k{i % 3}", rng.randrange(0, 60_000), round(rng.random(), 3)) for i in range(120)]
    rows = list({(k, t): (k, t, s) for k, t, s in rows}.values())
    got = {(r.k, r.t) for r in timeline.greedy_windows(spark.createDataFrame(rows, "k string, t bigint, s double"), ["k"], "s", "t", 0.5, 4).collect()}
    want = set()
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
        kept = []
        for _, t, s in own:
            if s >= own[0][2] - 0.5 and all(abs(t - x) >= 2 * timeline.PADDING_MS for x in kept) and len(kept) < 4:
                kept.append(t)
        want |= {(k, t) for t in kept}
    assert got == want


def test_distinct_frames_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [("v", t, [rng.choice([0, 1, (1 << 40) - 1, -1]), rng.choice([0, 3, 1 << 62])]) for t in range(40)]
    got = sorted(r.t for r in timeline.distinct_frames(spark.createDataFrame(rows, "v string, t int, signature array<bigint>"), "v", "t").collect())
    kept = []
    for _, t, s in rows:
        if all(sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(s, x)) > 24 for _, x in kept):
            kept.append((t, s))
    assert got == [t for t, _ in kept]


def test_overlaps_and_unions(spark):
    turns = spark.createDataFrame([("r", 0, 10, "A"), ("r", 5, 12, "B"), ("r", 6, 8, "C"), ("r", 12, 14, "A"), ("r", 20, 20, "B"), ("r", 3, 7, "A"), ("r", 0, 5, None)], "k string, start_ms bigint, end_ms bigint, who string")
    got = sorted((r.start_ms, r.end_ms, r.speakers) for r in timeline.overlap_regions(turns, ["k"], "who").collect())
    assert got == [(5, 6, ["A", "B"]), (6, 8, ["A", "B", "C"]), (8, 10, ["A", "B"])]
    assert sorted((r.start_ms, r.end_ms, r.parts) for r in timeline.merged(turns, ["k"]).collect()) == [(0, 14, 6)]


def test_text_matches():
    assert text_match("co­op", "coop")[:2] == (1, "SUBSTRING_SOFT_HYPHEN_REMOVED")
    assert text_match("exam-\nple", "example")[:2] == (1, "SUBSTRING_LINEBREAK_DEHYPHENATED")
    assert text_match("two\n words", "two words")[:2] == (1, "SUBSTRING_WHITESPACE_NORMALIZED")
    assert text_match("Straße STRASSE", "strasse") == (2, "SUBSTRING_CASEFOLD_NFKC", 0, 6)
    assert text_match(None, "x") is None and text_match("x", "") is None and text_match("", "x") is None


def test_canonical_json_column_equals_python(spark):
    text = "".join(chr(c) for c in range(1, 40)) + 'é"\\/'
    df = spark.createDataFrame([(text, None, 3)], "b string, a string, n int")
    assert df.select(json_column(b=F.col("b"), a=F.col("a"), n=F.col("n")).alias("j")).first().j.encode() == canonical_json({"b": text, "a": None, "n": 3})
    many = spark.range(100).select("id", F.col("id").cast("string").alias("s"))
    assert fingerprint(many.repartition(3)).first() == fingerprint(many.orderBy(F.desc("id"))).first() != fingerprint(many.limit(99)).first()


HAND = [("DOCUMENT", None, 0), ("HEADING", "Part One", 1), ("PARAGRAPH", "Introduction", 2), ("HEADING", "Target Section", 2), ("PARAGRAPH", "The target fact is forty two.", 3), ("PARAGRAPH", "Supporting context.", 3), ("HEADING", "Next Section", 2), ("PARAGRAPH", "Unrelated material.", 3)]


def test_sections_trails_and_windows(spark):
    rows = [("d", i, role.lower(), text, None, f"n{i}", role, level, 1 if i < 6 else 2, None, None) for i, (role, text, level) in enumerate(HAND)]
    df = spark.createDataFrame(rows, "doc string, i int, kind string, text string, parent string, node_id string, role string, level int, page int, start_ms bigint, end_ms bigint")
    assert sorted((r.heading, r.until) for r in items.sections(df).collect()) == [(1, 8), (3, 6), (6, 8)]
    trails = {r.i: r.trail for r in items.heading_trails(df).collect()}
    assert trails[4] == [1, 3] and trails[7] == [1, 6] and trails[0] == []
    near = items.context_window(df, df.where("i = 4").select("doc", "i"), 2)
    assert sorted(r.i for r in near.collect()) == [2, 3, 4, 5]
    packed = df.groupBy("doc").agg(F.collect_list(F.struct(F.abs(F.col("i") - 4).alias("p"), "i", F.coalesce("text", F.lit("")).alias("text"))).alias("e")).select(items.packed_slice(F.col("e"), 40, 30).alias("x")).first().x
    assert sum(len(r.text) for r in packed) <= 40 and packed[0].i in (3, 4)


def test_chain_and_states(spark):
    rows = [("r", 1, "a", None), ("r", 2, "b", "a"), ("r", 4, "c", "x"), ("q", 1, "z", None)]
    codes = {(r.k, r.n): r.codes for r in ledger.chain(spark.createDataFrame(rows, "k string, n int, own string, prev string"), "k", "n", "own", "prev").collect()}
    assert codes == {("r", 1): [], ("r", 2): [], ("r", 4): ["SEQUENCE_GAP", "PREVIOUS_DIGEST_MISMATCH"], ("q", 1): []}
    states = spark.createDataFrame([("r", 1, "created"), ("r", 2, "scanning"), ("r", 3, "verified"), ("q", 1, "created")], "k string, n int, s string")
    assert sorted((r.k, r.status, r.illegal, r.terminal) for r in ledger.replayed_states(states, "k", "n", "s").collect()) == [("q", "created", 0, False), ("r", "verified", 1, True)]
    issues = spark.createDataFrame([("SNAPSHOT_INDEX_MISSING", "1", None), ("NEVER_SEEN", None, "e2"), ("SNAPSHOT_INDEX_MISSING", "3", "e4")], "code string, snapshot_id string, evidence_id string")
    heads = spark.createDataFrame([("1", "e1"), ("2", "e2"), ("3", "e3")], "snapshot_id string, evidence_id string")
    assert {r.snapshot_id: r.integrity for r in ledger.classified(heads, issues).collect()} == {"1": "DEGRADED", "2": "INVALID", "3": "HEALTHY"}
