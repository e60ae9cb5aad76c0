from __future__ import annotations

from strataframe.llm import truncation
from tests.llm.test_truncation import corpus

TEXTS = [
    "a b", "x", "", "one two\n\n \n three  four", "see 3.5 and 12,40 in a.txt or b.tar.g", "A long" + "er" * 60_000 + " tail", "w" * 100_000, "many words " * 900 + "and the very las", "· … — ‑ 中文 字", "ends\n\n", "dots...", "«Quoted» (end", "été Straße 7",
]


def test_the_end_of_a_text_has_the_last_tokens_of_the_whole(spark):
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(TEXTS)], "doc_id int, source string, text string")
    sql = lambda text, **tables: spark.sql(text, args=truncation.PATTERNS, **tables)
    prepared = sql(truncation._PREPARED, documents=df)
    whole = sql("select doc_id, slice(concat(array('^', '^', '^'), regexp_extract_all(stem, :token, 0)), -3, 3) as w from {p}", p=prepared)
    want = {r.doc_id: r.w for r in whole.collect()}
    got = {r.doc_id: [r.e.a.removeprefix("^") or "^", r.e.b, r.e.c] for r in sql(truncation._SHAPED, prepared=prepared).collect() if r.e is not None}
    plain = lambda w: "0" if w[0].isdigit() else ".0" if w[0] == "." and w[-1].isdigit() else w
    assert got == {k: [plain(w) for w in want[k]] for k in got} and len(got) >= 11


def test_trigrams_decide_and_nothing_is_left_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    cut = [(500, "The curator copied records in the cold store. The test bench sea"), (501, "The curator copied records. The field crew counted folders at the"), (502, "Alone " + "r" * 100_000)]
    df = spark.createDataFrame(corpus() + [(i, "m", t) for i, t in cut], "doc_id bigint, source string, text string")
    got = {r.doc_id: (r.cut_in, r.decided_by) for r in truncation.cut_texts(df).where("doc_id >= 500").collect()}
    assert got == {500: ("word", "trigram"), 501: ("sentence", "trigram"), 502: (None, None)}
    assert {t.name for t in spark.catalog.listTables()} == before
