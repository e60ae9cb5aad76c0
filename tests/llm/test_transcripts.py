from __future__ import annotations

from datetime import datetime

from strataframe.llm import transcripts

SCHEMA = "document_key string, item_index int, kind string, text_or_value string, location struct<ordinal:int,depth:int,page:int,start_ms:bigint,end_ms:bigint>, recorded_at timestamp_ntz, speaker string"
T0 = datetime(2026, 1, 1)


def segments(spark, rows, doc="d"):
    made = [(doc, i, transcripts.KIND, t, (None, None, None, s, None), T0, "clash") for i, t, s in rows]
    filler = [("names", i, transcripts.KIND, f"{n}: yes we do", (None, None, None, i * 1000, None), T0, None) for i, n in enumerate(["Reviewer", "Operator"] * 6)]
    return spark.createDataFrame(made + filler, SCHEMA)


def run(spark, rows):
    got = transcripts.turns(transcripts.speaker_segments(segments(spark, rows))).where("document_key = 'd'").orderBy("turn_no").collect()
    return [(r.speaker, r.start_ms, r.n_words) for r in got]


def test_names_in_all_their_forms(spark):
    forms = ["Speaker 3: a b", "[Speaker 3]: a", "SPEAKER_03: a", "speaker3 - a", "spk3: a", "S3: a", ">> Speaker 3: a", "<v Speaker 3> a", "Speaker three: a", "  Speaker  3:  a"]
    assert run(spark, [(i, f, i * 1000) for i, f in enumerate(forms)]) == [("speaker 3", 0, 11)]
    roles = ["Reviewer: a", "REVIEWER: A", "Reviewer - a", "Reviewer : a", "reviewer> a", "<v Reviewer> a", ">> REVIEWER: a", "Rev.: a", "Reviwer: a"]
    assert run(spark, [(i, f, i * 1000) for i, f in enumerate(roles)]) == [("reviewer", 0, 9)]


def test_order_repeats_and_parts(spark):
    rows = [
        (0, "(00:20) Operator: second one", None), (1, "[00:00:10] Reviewer: first one here", None), (2, "REVIEWER: FIRST ONE HERE", 10_000), (3, "0:00:30 - third, um, goes on [laughter] at 11:45", None), (4, "[40s] Uhm, mhm...", None),
        (5, "00:00:50.000 --> 00:00:55.000 and on\nReviewer: no it was sealed (the second time) (phone rings)\nwith a line more", None), (6, "Operator: (applause) hmm", 60_000), (7, None, 70_000), (8, "", 80_000), (9, "still there", 90_000),
    ]
    assert run(spark, rows) == [("reviewer", 10_000, 3), ("operator", 20_000, 9), ("reviewer", 50_000, 13)]


def test_segments_without_any_time_keep_their_place(spark):
    rows = [(0, "Reviewer: one", 5000), (1, "Operator: two", None), (2, "Reviewer: three", 9000), (3, "Operator: back", 1000)]
    df = transcripts.ordered_segments(segments(spark, rows)).where("doc = 'd'")
    assert [(r.item, r.start, r.dropped) for r in df.orderBy("start", "ord").collect()] == [(3, 1000, ["cue"]), (0, 5000, []), (1, 5000, []), (2, 9000, [])]


def test_long_recordings_cross_blocks(spark):
    rows = [(i, f"Speaker {1 + (i // 3000) % 2}: word" if i % 3000 == 0 else "word", i * 500) for i in range(9000)]
    assert run(spark, rows) == [("speaker 1", 0, 3000), ("speaker 2", 1_500_000, 3000), ("speaker 1", 3_000_000, 3000)]


def test_unnamed_beginning_null_keys_and_empty_table(spark):
    assert run(spark, [(0, "who speaks", 0), (1, "Operator: me", 10)]) == [("", 0, 2), ("operator", 10, 1)]
    df = spark.createDataFrame([(None, 1, transcripts.KIND, "x", None, T0, None), ("d", None, transcripts.KIND, "x", None, T0, None), ("d", 1, "TABLE", "x", None, T0, None)], SCHEMA)
    assert transcripts.speaker_segments(df).count() == 0 and transcripts.speaker_segments(df.limit(0)).count() == 0
