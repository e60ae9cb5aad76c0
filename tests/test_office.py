from __future__ import annotations

import io
import itertools
import zipfile

import numpy as np

from strataframe.functions.alignment import aligned_frames
from strataframe.sources.host import counter_delta, resource_sample
from strataframe.sources.office import office_items, package_items


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


BOOK = package(**{
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="One" r:id="i1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><X Id="i1" Target="worksheets/s.xml"/></R>', "xl/sharedStrings.xml": "<sst><si><t>late</t></si><si><r><t>led</t></r><r><t>ger</t></r></si></sst>",
    "xl/worksheets/s.xml": '<w><sheetData><row><c r="A1" t="s"><v>1</v></c><c r="B1"><f>SUM(A1:A2)</f><v>3</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></w>',
})
TEXT = package(**{
    "word/document.xml": '<d xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a </w:t></w:r><w:ins w:id="7"><w:r><w:t>new</w:t></w:r></w:ins></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></d>',
    "word/comments.xml": '<c xmlns:w="w"><w:comment w:id="1"><w:p><w:r><w:t>why</w:t></w:r></w:p></w:comment></c>',
})
EPUB = package(**{
    "META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/><itemref idref="b"/></p>', "o/b.xhtml": "<h1>Second file first</h1>", "o/a.xhtml": "<p>then this</p>",
})


def test_packages():
    kind, problem, rows = package_items(BOOK)
    assert (kind, problem) == ("XLSX", None) and [r[1:5] for r in rows] == [
        ("xlsx_sheet", "SHEET", "One", "One"), ("xlsx_cell", "TABLE_CELL", "ledger", "One!A1"), ("xlsx_formula", "FORMULA", "=SUM(A1:A2)", "One!B1"), ("xlsx_cell", "TABLE_CELL", "3", "One!B1"), ("xlsx_cell", "TABLE_CELL", "in", "One!C1"), ("xlsx_merged_range", "TABLE", "A1:B1", "One!A1:B1")
    ]
    assert [(r[2], r[3], r[5]) for r in package_items(TEXT)[2]] == [("HEADING", "Top", 2), ("PARAGRAPH", "a new", None), ("TABLE", None, None), ("TABLE_CELL", "x", None), ("COMMENT", "why", None), ("REVISION", "new", None)]
    assert [r[3] for r in package_items(EPUB)[2]] == ["Second file first", "then this"]
    assert [r[3] for r in package_items(BOOK, "LEDG")[2]] == ["ledger"]
    assert package_items(None)[1] == "NOT_A_PACKAGE" and package_items(package(a="x"))[1] == "FORMAT_UNKNOWN" and package_items(package(**{"word/document.xml": "<a"}))[1] == "CONTENT_INVALID"
    assert package_items(package(**{"word/document.xml": "<!DOCTYPE x><a/>"}))[1] == "DOCTYPE_REFUSED"


def test_packages_on_rows(spark):
    df = spark.createDataFrame([(1, BOOK, "x"), (2, None, "x"), (3, b"", "x")], "id bigint, content binary, kind string")
    got = office_items(df, "id", "content").groupBy("id", "format", "problem").count().collect()
    assert sorted((r.id, r.format, r.problem, r["count"]) for r in got) == [(1, "XLSX", None, 6), (2, None, "NOT_A_PACKAGE", 1), (3, None, "NOT_A_PACKAGE", 1)]


def test_alignment_against_all_paths():
    rng = np.random.default_rng(1)
    for tokens in ([1, 2], [1, 1], [2, 1, 2], [1]):
        scores = np.log(rng.dirichlet(np.ones(3), 6))

        def emitted(path):
            return [k for k, _ in itertools.groupby(path) if k != 0]

        paths = [p for p in itertools.product(range(3), repeat=6) if emitted(p) == tokens]
        best = max(paths, key=lambda p: sum(scores[f, t] for f, t in enumerate(p)))
        runs = [list(g) for k, g in itertools.groupby(enumerate(best), key=lambda x: x[1]) if k != 0]
        assert aligned_frames(scores, tokens) == [(r[0][0], r[-1][0]) for r in runs]
    assert aligned_frames(np.log(np.ones((1, 3)) / 3), [1, 2]) is None and aligned_frames(np.zeros((3, 3)), []) == []


def test_host_samples(spark):
    assert [counter_delta(*x) for x in ((1, 5), (5, 1), (None, 1), (1, None), (2, 2))] == [4, None, None, None, 0]
    counters, processes = resource_sample(spark, 0.05)
    assert counters.count() == 6 and processes.where("rss_bytes > 0").count() > 0
