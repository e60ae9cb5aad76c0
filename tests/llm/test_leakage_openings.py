from __future__ import annotations

from strataframe.llm import leakage as L
from tests.llm.test_leakage import text


def test_long_openings_and_those_in_other_spelling_are_left_out(spark):
    long = " ".join(f"rule{k}" for k in range(400)) + ". "  # over 2,000 characters
    spelled = ["Read the passage below and answer with care. ", "READ the  passage below, and answer with care. ", "\n read The passage below and answer with care! "]
    items = [(i, long + text(20, i) + ".") for i in range(3)] + [(3 + i, s + text(20, 3 + i) + ".") for i, s in enumerate(spelled)]
    docs = [(i, text(30, 50) + " " + text(20, i) + " " + text(30, 51)) for i in range(6)] + [(6, long), (7, spelled[0])]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    held = [dict(b) for b in L._blocks(df, "item_id", "text")]
    assert held == [{i: text(20, i).split() for i in range(6)}]
    got = L.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), df).collect()
    assert sorted(map(tuple, got)) == [(i, i, 1.0) for i in range(6)]
