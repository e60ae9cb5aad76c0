from __future__ import annotations

import random
from datetime import datetime

import pytest

from strataframe.llm import ocr

WORDS = "the curator compared late folders with quarterly budgets while index rebuilt before midnight every ledger catalogue was sealed across both mounts and remains read-only under shared branch their permissions recorded".split()
SCHEMA = "document_key string, item_index int, kind string, text_or_value string, location struct<page:int>, recorded_at timestamp_ntz"
T0 = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def repairer():
    counts = {w: 1000 for w in WORDS}
    return ocr.trained(counts, set(WORDS), sorted(counts.items()), [])


def test_editor_on_words_it_did_not_train_on_with_two_errors(repairer):
    seen = {"thc": "the", "cornpared": "compared", "1ate": "late", "fo1ders": "folders", "wifh": "with", "bcfore": "before", "ancl": "and", "catalogiie": "catalogue", "shai'ed": "shared", "quartcrly": "quarterly", "mounfs": "mounts", "recordecl": "recorded"}
    assert {w: repairer.correction(w) for w in seen} == seen
    assert [repairer.correction(w) for w in ("the", "Ledger", "unrelated", "42", "x", "ext4")] == [None] * 6


def test_editor_accuracy_on_held_out_confusions(repairer):
    rng = random.Random(3)
    right = total = 0
    for _ in range(400):
        word = rng.choice([w for w in WORDS if len(w) > 4 and "-" not in w])
        bad = word
        for _ in range(rng.choice([1, 1, 2])):
            p, r = rng.choice([(p, r) for p, r in ocr.CONFUSIONS if p in bad] or [("", "")])
            bad = bad.replace(p, r, 1)
        if bad != word and bad not in WORDS:
            total += 1
            right += repairer.correction(bad) == word
    assert total > 200 and right / total > 0.9


def test_hyphens(repairer):
    assert repairer.keeps_hyphen("read", "only") and not repairer.keeps_hyphen("cata", "logue") and not repairer.keeps_hyphen("bud", "gets.")
    assert repairer.keeps_hyphen("read", None) and not repairer.keeps_hyphen("cata", None)
    text = "the cura-\ntor compared read-\nonly fo1-\nders while -\nindex rebuilt"
    found, paragraphs, _, _ = ocr.repaired(repairer, text, {}, None, None)
    assert found == [(0, "hyphen_break"), (2, "hyphen_break"), (2, "misread")] and paragraphs == ["the curator compared read-only folders while index rebuilt"]


def _book(pages):
    rng = random.Random(2)
    rows, truth = [], set()
    for doc in range(pages // 5):
        for k in range(5):
            body = []
            for i in range(12):
                body.append(" ".join(rng.choice(WORDS) for _ in range(7)) + ("." if i == 11 else ""))
            lines = (["Chapter 1: Late Folders" if k == 1 else "Budget Ledger Catalogue", ""] if k else []) + body + ["", "Form R-17", f"Page {k + 1}"]
            rows.append((f"d{doc}", k, ocr.KIND, "\n".join(lines), (k + 1,), T0))
            if k:
                truth.add((f"d{doc}", k, 0, "running_line"))
            truth |= {(f"d{doc}", k, len(lines) - 2, "running_line"), (f"d{doc}", k, len(lines) - 1, "page_number")}
    clean = [("c", i, "TABLE", " ".join(WORDS), None, T0) for i in range(50)]
    return rows, clean, truth


def test_furniture_and_misreadings_of_a_book(spark):
    rows, clean, truth = _book(60)
    k = next(i for i, r in enumerate(rows) if r[0] == "d3" and r[1] == 2)
    lines = rows[k][3].split("\n")
    lines[5] = "thc ledger was sealed"
    lines[6] = "and the cata-"
    lines[7] = "logue remains"
    rows[k] = (*rows[k][:3], "\n".join(lines), *rows[k][4:])
    truth |= {("d3", 2, 5, "misread"), ("d3", 2, 6, "hyphen_break")}
    extra = [("d3", 9, ocr.KIND, None, None, T0), ("d3", 10, ocr.KIND, " \n ", None, T0), (None, 1, ocr.KIND, "x", None, T0)]
    df = spark.createDataFrame(rows + clean + extra + rows[:3], SCHEMA)
    got = {tuple(r) for r in ocr.page_noise(df).collect()}
    assert len(got ^ truth) <= 0.02 * len(truth) and {("d3", 2, 5, "misread"), ("d3", 2, 6, "hyphen_break"), ("d3", 1, 0, "running_line")} <= got
    text = " ".join(r.text for r in ocr.page_paragraphs(df).where("document_key = 'd3' and item_index = 2").orderBy("piece_no").collect())
    assert "the ledger was sealed" in text and "catalogue remains" in text and "Form R-17" not in text


def test_empty_table(spark):
    assert ocr.page_noise(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_joins_are_learned(repairer):
    rng = random.Random(9)
    counts = {w: 40 for w in WORDS} | {"read-only": 30, "cross-check": 12, "well-kept": 5, "half-open": 9, "halfopen": 1}
    held = {"pre-war": 7, "archive": 20, "notebook": 6}
    r = ocr.trained(counts, set(counts), sorted(counts.items()), [])
    r.counts |= held
    r.sure |= set(held)
    cases = [(w[:k], w[k:], False) for w in ["archive", "notebook", "curator", "permissions"] for k in range(2, len(w) - 1)] + [tuple(w.split("-")) + (True,) for w in ["pre-war", "read-only", "half-open"]]
    cases += [("unheard", "of", False), ("mar", "ginalia", False), ("rcad", "only", True), ("cross", "chcck", True), ("quar", "tcrly", False)]
    right = sum(r.keeps_hyphen(a, b) == keep for a, b, keep in rng.sample(cases, len(cases)))
    assert right / len(cases) > 0.95
    r.joiner = ocr.Perceptron()
    assert not any(r.keeps_hyphen(a, b) for a, b, _ in cases)  # nothing but the perceptron decides
