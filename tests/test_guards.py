from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strataframe.functions import text
from strataframe.functions.latest import own_folder
from strataframe.operators import changes
from strataframe.sources.documents import git_status, html_block_rows


def test_no_machine_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            own_folder(master)
    assert own_folder("local[4]") != own_folder("local")


def test_equal_row_hashes_end_the_comparison(spark, monkeypatch):
    rows = [("k", 1, "a", 5), ("k", 2, "b", 5), ("k", 3, "b", None), ("k", 4, None, 6), ("k", 6, "b", 6)]
    placed = spark.createDataFrame(rows, "key string, pos int, digest string, size bigint")
    found = lambda: sorted((r.from_pos, r.to_pos, r.adjacent) for r in changes.intervals(placed, ["key"], ["digest", "size"]).collect())
    assert found() == [(1, 1, False), (2, 4, True), (6, 6, False)]
    monkeypatch.setattr(changes, "row_hash", lambda attributes: F.lit(1))
    assert found() == [(1, 4, False), (6, 6, False)]


def test_questions(spark):
    asked = ["What was ＣＯＭＰＡＲＥＤ?", "Folders, please", "最近的演变", "文件夹", "Added or removed?", "", None]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, q string")
    got = [r.p for r in df.select("i", text.question_profile(F.col("q")).alias("p")).orderBy("i").collect()]
    assert got == ["CHANGE_TRIAGE", "STRUCTURE_OVERVIEW", "CHANGE_TRIAGE", "STRUCTURE_OVERVIEW", "GENERAL", None, None]


def test_frames(spark):
    df = spark.createDataFrame([("Ｆull  ﬁle\n", "90", "-90", "30000/1001", "30000/1001"), ("ẞ", "45", None, "25/1", "0/0"), (None, None, None, "25/1", "50/2")], "t string, tag string, side string, a string, r string")
    rows = df.select(text.ocr_key(F.col("t")), text.rotation(F.col("tag"), F.col("side")), text.rate_mode(F.col("a"), F.col("r"))).collect()
    assert [tuple(r) for r in rows] == [("full file", 270, "CONSTANT"), ("ss", None, "UNKNOWN"), (None, None, "CONSTANT")]


def test_pages_and_listings():
    assert html_block_rows("<td>a<p>b<p>c</td>d</p><li>e</p>f</li>") == [(1, "PARAGRAPH", "abc"), (2, "PARAGRAPH", "ef")]
    assert html_block_rows("<p>x<h2>y<li>z") == [(1, "PARAGRAPH", "xyz"), (2, "HEADING", "yz"), (3, "PARAGRAPH", "z")]
    assert git_status(b"") == [] and git_status(b"RM n\0o\n p\0!! x y\0") == [("RM", "o\n p"), ("!!", "x y")]
    for bad in (b"R  new\0", b" M\0", b"xx y\0zz\0"):
        with pytest.raises(ValueError):
            git_status(bad)
