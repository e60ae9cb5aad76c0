from __future__ import annotations

from strataframe.functions.text import text_match
from strataframe.plans.documents import fn_3_document_matches, fn_5_excerpts

TEXTS = [
    "A snapshot of the index, SNAPSHOT again.", "Ein früher Snapshot — ganz am Ende", "é" * 300 + " snapshot " + "ü" * 700, "snap­shot", "a snap-\nshot and the\n  index", "ﬁle in the index…", "cold store",
    "nothing", "", None, "\U0001d42cnapshot \U0001f600 snapshot", "ＳＮＡＰＳＨＯＴ", "x" * 600 + "the index", "the index\n", "the index, the index: İ snapshot",
]


def excerpt_of(text, query):
    m = text_match(text, query)
    return m and text[max(0, m[2] - 160) : m[3] + 160][:512]


def test_all_documents_are_searched(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    queries = ("snapshot", "the index", "cold store")
    plain = {(i, q, m[0]) for i, t in enumerate(TEXTS) for q in queries if (m := text_match(t, q))}
    assert {tuple(r) for r in fn_3_document_matches(spark, str(tmp_path)).collect()} == plain and {(1, "snapshot", 1), (4, "the index", 1), (6, "cold store", 1)} <= plain
    got = {r.doc_id: r.excerpt for r in fn_5_excerpts(spark, str(tmp_path)).collect()}
    assert got == {i: x for i, t in enumerate(TEXTS) if (x := excerpt_of(t, "snapshot"))} and got.keys() == {0, 1, 2, 3, 4, 10, 11, 14} and len(got[2]) == 328
