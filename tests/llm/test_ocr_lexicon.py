from __future__ import annotations

from strataframe.llm import ocr
from tests.llm.test_ocr import SCHEMA, T0, _book


def test_words_beyond_the_lexicon_are_looked_up(spark, monkeypatch):
    rows, clean, _ = _book(40)
    at = {(r[0], r[1]): i for i, r in enumerate(rows)}

    def page(doc, item, lines):
        i = at[doc, item]
        old = rows[i][3].split("\n")
        rows[i] = (*rows[i][:3], "\n".join(old[:4] + lines + old[4 + len(lines) :]), *rows[i][4:])

    page("d1", 1, ["thc gallant modem sat", "a rnodem and a vellurn", "zeal-", "ous half-", "timbered vel-", "lum well-"])
    page("d2", 2, ["a modern mo-", "dem, the zea1ous", "half-timbered hal1", "velIum half-", "half-tirnbered well-"])
    clean += [("w", i, "TABLE", "modem zealous half-timbered well-kept gallant", None, T0) for i in range(3)] + [("v", i, "TABLE", "vellum modern", None, T0) for i in range(8)]
    df = spark.createDataFrame(rows + clean, SCHEMA)
    monkeypatch.setattr(ocr, "TRAIN_WORDS", 15)  # the same training, whatever the lexicon holds

    def found():
        return sorted(map(tuple, ocr.page_noise(df).collect())), sorted(map(tuple, ocr.page_paragraphs(df).collect()))

    whole = found()
    monkeypatch.setattr(ocr, "LEXICON", 24)
    assert ocr.fitted(df, ocr.scanned_pages(df), ocr.repeated_lines(ocr.scanned_pages(df))).floor > 0
    assert found() == whole
    text = " ".join(t for d, _, i, _, t in whole[1] if (d, i) in (("d1", 1), ("d2", 2)))
    assert "the gallant modem sat" in text, text
