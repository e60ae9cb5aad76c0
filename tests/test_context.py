from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strataframe.operators import context

FIELDS = "page int, block int, outline int, annotation int, form_field int, sheet string, cell string, `table` string, chart int, comment int, slide int, shape int, notes int, section int, section_title string, ordinal int, row int, start_ms bigint, end_ms bigint, timestamp_ms bigint, stream_index int, footnote int"
CASES = [
    ("PDF", {"page": 3, "block": 2}, ("PDF_PAGE", "page 3, block 2", "page:3/block:2")), ("PDF", {"page": 1, "form_field": 4}, ("PDF_FORM_FIELD", "page 1, form field 4", "page:1/form_field:4")),
    ("PDF", {}, ("DOCUMENT_ITEM", "n", "n")), ("PNG", {}, ("IMAGE_REGION", "page 1", "page:1")), ("XLSX", {"sheet": "A b", "cell": "C3", "table": "T"}, ("WORKBOOK_CELL", 'sheet "A b", cell C3', "sheet:A b/cell:C3")),
    ("XLSX", {"sheet": "S", "comment": 1}, ("WORKBOOK_COMMENT", 'sheet "S", comment 1', "sheet:S/comment:1")), ("PPTX", {"slide": 2, "notes": 1}, ("PRESENTATION_SPEAKER_NOTES", "slide 2, notes 1", "slide:2/notes:1")),
    ("DOCX", {"section": 1, "row": 2}, ("WORD_TABLE_CELL", "section 1, row 2", "section:1/row:2")), ("DOCX", {"footnote": 2}, ("WORD_FOOTNOTE", "footnote 2", "footnote:2")),
    ("EPUB", {"section": 4, "section_title": "One", "ordinal": 9}, ("EPUB_SECTION_ITEM", 'section 4, heading "One", item 9', "section:4/item:9")), ("MP3", {"start_ms": 1500, "end_ms": 2000}, ("AUDIO_TIME_RANGE", "1.500s, to 2.000s", "start_ms:1500/end_ms:2000")),
    ("MKV", {"timestamp_ms": 40, "stream_index": 0}, ("VIDEO_TIME_RANGE", "0.040s, to 0.040s, stream 0", "start_ms:40/end_ms:40/stream_index:0".replace("stream_index", "stream"))), (None, {"ordinal": 7}, ("DOCUMENT_ITEM", "item 7", "item:7")),
]


def test_native_locations_of_all_formats(spark):
    names = [x.strip().split(" ")[0].strip("`") for x in FIELDS.split(",")]
    df = spark.createDataFrame([(i, f, tuple(at.get(n) for n in names), "n") for i, (f, at, _) in enumerate(CASES)], f"i int, f string, location struct<{', '.join(x.strip().replace(' ', ':', 1) for x in FIELDS.split(','))}>, node string")
    kind, label, locator = context.native_location(F.col("f"), F.col("location"), df.schema["location"].dataType, F.col("node"))
    assert [tuple(r)[1:] for r in df.select("i", kind, label, locator).orderBy("i").collect()] == [want for _, _, want in CASES]


def test_pages_that_fit(spark):
    rows = [("a", i, "x" * 100) for i in range(10)] + [("b", 0, "y" * 5000), ("c", 0, None)]
    df = spark.createDataFrame(rows, "k string, i int, t string")
    got = context.fitted_page(df, ["k"], [F.col("i")], "t", 8, 450).collect()
    assert sorted((r.k, r.i) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("c", 0)] and {r.shown for r in got if r.k == "a"} == {4}
    assert context.fitted_page(df.limit(0), ["k"], [F.col("i")], "t", 8).count() == 0
    with pytest.raises(ValueError):
        context.fitted_page(df, ["k"], [F.col("i")], "t", 8, 10, 11)


def test_policies_and_scopes(spark):
    c = spark.createDataFrame([("s1", "x", 1), ("s2", "x", 2), ("s3", "x", 3), ("s4", "x", 3), ("t1", "y", 5)], "snapshot_id string, scope_id string, created int")
    asks = [("EXACT_ID", "s2", "x"), ("EXACT_ID", "s2", "y"), ("TASK_CREATED", "zz", "x"), ("ONLY_COMPATIBLE", None, "x"), ("ONLY_COMPATIBLE", None, "y"), ("LATEST_VALID", None, "x"), ("LATEST_VALID", None, "q"), ("PREVIOUS_VALID", "s3", "x"), ("PREVIOUS_VALID", "s1", "x")]
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "request int, policy string, named string, scope_id string")
    got = [(r.outcome, r.snapshot_id) for r in context.resolved_snapshots(c, df).orderBy("request").collect()]
    assert got == [("RESOLVED", "s2"), ("NOT_FOUND", None), ("NOT_FOUND", None), ("AMBIGUOUS", None), ("RESOLVED", "t1"), ("AMBIGUOUS", None), ("NOT_FOUND", None), ("RESOLVED", "s2"), ("NOT_FOUND", None)]
    scopes = spark.createDataFrame([("b", True, True), ("a", True, True), ("c", False, True), ("d", True, False)], "scope_id string, enabled boolean, managed boolean")
    assert [r[0] for r in context.chosen_scopes(scopes).collect()] == ["a", "b"] and [r[0] for r in context.chosen_scopes(scopes, ["d", "a", "d"]).collect()] == ["a", "d"]
    with pytest.raises(Exception, match="unknown scope"):
        context.chosen_scopes(scopes, ["a", "zz"]).collect()


def test_ranges_words_and_headings(spark):
    df = spark.createDataFrame([(-5, 3, None), (8, 20, "CTC_FORCED_ALIGNED"), (30, 2, "x"), (None, 4, "CTC_FORCED_ALIGNED")], "a int, b int, s string")
    x, y = context.bounded_range(F.col("a"), F.col("b"), F.lit(10))
    assert [tuple(r) for r in df.select(x, y, context.word_class(F.col("a"), F.col("b"), F.col("s"))).collect()] == [(0, 3, "audio_approximate_word"), (8, 10, "audio_aligned_word"), (9, 10, "audio_approximate_word"), (None, None, "audio_unaligned_word")]
    text = "# A\ntext\n### B\n## C\n#### D data:image/png;base64,AAAA=\n#no\n# E"
    rows = context.markdown_blocks(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").orderBy("line").collect()
    assert [(r.line, r.level, r.title, r.parent) for r in rows] == [(0, 1, "A", None), (2, 3, "B", 0), (3, 2, "C", 0), (4, 4, "D ", 3), (6, 1, "E", None)]
