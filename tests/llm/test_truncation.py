from __future__ import annotations

import random

from strataframe.llm import truncation

SUBJECTS, VERBS, PLACES = ["the curator", "the test bench", "the field crew", "an auditor"], ["copied", "sealed", "counted", "checked"], ["in the cold store", "at the river depot", "on the reserve disk", "near the reading room"]


def sentence(rng):
    return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(['records', 'folders', 'budgets'])} {rng.choice(PLACES)}".capitalize()


def corpus():
    rng = random.Random(4)
    return [(i, f"src{i % 3}", ". ".join(sentence(rng) for _ in range(rng.randrange(4, 9))) + ".") for i in range(300)]


CASES = {
    1000: ("The curator copied records in the cold store. The test bench sea", "word"), 1001: ("The curator copied records in the cold store. The field crew counted folders at the", "sentence"),
    1002: ("The curator copied records in the cold store", None), 1003: ("The curator copied records. [cut]", "marker"), 1004: ("An auditor sealed budgets �", "character"), 1005: ("The curator copied &quo", "entity"),
    1006: ('{"a": [1, 2', "structure"), 1007: ('{"a": [1, 2]}', None), 1008: ("The curator sealed records.\n```\nls -l", "fence"), 1009: ("The curator sealed records.\n```\nls -l\n```", None), 1010: ("", None), 1011: ("The field crew ", "sentence"),
    1012: ("The curator sealed records at the...", "sentence"), 1013: ("The curator sealed records.\nMore to follow...", None), 1014: ("The test bench copied folders near the reading room!", None), 1015: ("<p>The curator <b", "tag"),
}


def test_kinds_of_cuts(spark):
    rows = corpus() + [(k, "mixed", t) for k, (t, _) in CASES.items()] + [(2000 + i, "mixed", f"{sentence(random.Random(i))}.\nMore to follow...") for i in range(6)] + [(3000, "mixed", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = {r.doc_id: r.cut_in for r in truncation.cut_texts(df.withColumn("cut_in", df["source"])).collect()}
    assert {k: got[k] for k in CASES} == {k: v for k, (_, v) in CASES.items()}
    assert not any(got[i] for i in range(300)) and 3000 not in got and not any(got[2000 + i] for i in range(6))


def test_field_limit_and_copies(spark):
    rng = random.Random(8)
    long = [(i, "limited", (". ".join(sentence(rng) for _ in range(12)))[:200].rsplit(" ", 1)[0] + " disk") for i in range(40)]
    rows = corpus() + long + [(99, "other", long[0][2])]
    got = truncation.cut_texts(spark.createDataFrame(rows, "doc_id bigint, source string, text string"))
    share = {r.source: r for r in truncation.truncation_by_source(got).collect()}
    assert share["src0"].cut_texts == 0 and 0 < share["limited"].cut_share <= 1


def test_empty_table_and_ties(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert truncation.cut_texts(df).count() == 0
    same = spark.createDataFrame([(1, None, "One two three.")] * 3, "doc_id bigint, source string, text string")
    assert truncation.truncation_by_source(truncation.cut_texts(same)).first().cut_texts == 0
