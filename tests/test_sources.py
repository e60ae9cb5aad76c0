from __future__ import annotations

import io
import os
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from strataframe.sources import documents, filesystem, index, ledger
from strataframe.streaming import ledger as streams

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/c.txt").write_text("12345")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/inner.txt").write_text("x")
    os.symlink("c.txt", tmp_path / "a/b/link")
    return tmp_path


def test_scan(spark, tree):
    rows = {r.relative_path: r for r in filesystem.scan(spark, {"s": str(tree)}, "snap", [str(tree / "skip")]).collect()}
    assert set(rows) == {".", "a", "a/b", "a/b/c.txt", "a/b/link", "skip"} and rows["skip"].excluded
    assert rows["a/b/c.txt"].size_bytes == 5 and rows["a/b/link"].object_type == "symlink" and rows["a/b/link"].symlink_target_raw == "c.txt"
    few = filesystem.scan(spark, {"s": str(tree)}, budget=filesystem.Budget(max_entries=3)).collect()
    assert len(few) == 3 and any(r.partial for r in few)
    assert {r.relative_path for r in filesystem.scan(spark, {"s": str(tree)}, budget=filesystem.Budget(max_depth=1)).collect()} == {".", "a", "skip"}
    assert filesystem.scan(spark, {"s": str(tree / "none")}).first().observation_status == "not_found"
    with pytest.raises(ValueError):
        filesystem.scan(spark, {})


def test_ledger_files(spark, tmp_path):
    folder = str(tmp_path / "runs")
    one = ledger.write_evidence(folder, "r1", 1, "run.created", {"x": 1}, None)
    ledger.write_evidence(folder, "r1", 2, "run.state_transition", {"to": "scanning"}, one["evidence_digest"])
    with pytest.raises(FileExistsError):
        ledger.write_evidence(folder, "r1", 1, "run.created", {"x": 2}, None)
    (tmp_path / "runs/r1/00000003_bad.json").write_text("{")
    (tmp_path / "runs/r1/odd.json").write_text("{}")
    got = {r.file: r for r in ledger.read_ledger(spark, folder).collect()}
    assert got["00000002_run.state_transition.json"].previous == one["evidence_digest"] and got["00000001_run.created.json"].problem is None
    assert got["00000003_bad.json"].problem == "JSON_INVALID" and got["odd.json"].problem == "NAME_INVALID"


def test_index_versions(spark, tmp_path):
    df = spark.createDataFrame([("s1", "a", "p", 1), ("s2", "a", "q", None)], "snapshot_id string, scope_id string, relative_path string, size bigint")
    folder = str(tmp_path / "index")
    os.makedirs(folder)
    v1 = index.write_version(df, folder)
    index.publish(folder, v1)
    v2 = index.write_version(df.where("snapshot_id = 's1'"), folder)
    assert index.publish(folder, v2, expected=v1) == v1 and index.read_current(spark, folder).count() == 1
    with pytest.raises(ValueError):
        index.publish(folder, v1, expected=v1)
    index.rollback(folder, v1)
    one = index.read_current(spark, folder, "s2")
    assert one.count() == 1 and "PartitionFilters: [isnotnull" in one._sc._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    with index.GuardedRead(index.read_current(spark, folder)) as g:
        g.count()


def test_html_blocks_and_order(spark):
    html = "<h1>One <b>x</b></h1><p></p><p>a<li>b</p>tail<td>open &amp; end"
    assert documents.html_block_rows(html) == [(1, "HEADING", "One x"), (3, "PARAGRAPH", "ab"), (4, "PARAGRAPH", "open & end")]
    assert documents.html_block_rows(None) == [] and documents.html_block_rows("") == []
    df = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    assert documents.html_blocks(df, "id", "html").count() == 3
    members = spark.createDataFrame([("b", "z.xhtml"), ("b", "a.html"), ("b", "m.htm"), ("b", "x.css"), ("b", "a.html")], "book string, name string")
    spine = spark.createDataFrame([("b", "z.xhtml", 1), ("b", "m.htm", 2), ("b", "z.xhtml", 3)], "book string, name string, place int")
    assert [r.name for r in documents.reading_order(members, spine).orderBy("position").collect()] == ["z.xhtml", "m.htm", "a.html"]


def test_packages_hashes_and_status(spark):
    def package(*names, size=3):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                z.writestr(n, b"x" * size)
        return out.getvalue()

    assert documents.container_problem(package("a", "b")) is None and documents.container_problem(b"") == "NOT_A_PACKAGE" and documents.container_problem(None) == "NOT_A_PACKAGE"
    assert documents.container_problem(package("../a")) == "UNSAFE_PATH" and documents.container_problem(package("a", size=1_000_000)) == "RATIO_TOO_HIGH"
    files = spark.createDataFrame([("s", "alpha", b"12345678"), ("s", "large", b"123456789"), ("s", "zero", b""), ("s", "zz", b"1")], "scope string, path string, content binary")
    got = {r.path: r.status for r in documents.payload_hashes(files, "scope", "path", "content", 8, 8).collect()}
    assert got == {"alpha": "HASHED", "large": "FILE_TOO_LARGE", "zero": "EMPTY_FILE_HASHED", "zz": "TOTAL_BYTE_BUDGET_EXHAUSTED"}
    assert documents.git_status(b" M a.py\0R  new\0old\0?? b\0") == [(" M", "a.py"), ("R ", "old"), ("??", "b")]
    with pytest.raises(ValueError):
        documents.git_status(b"bad\0")
    cues = spark.createDataFrame([(1, "1\n00:00:01,000 --> 00:00:02,500\nHello\nyou\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n")], "id int, t string")
    assert [(r.start_ms, r.end_ms, r.text) for r in documents.subtitle_cues(cues, "id", "t").collect()] == [(1000, 2500, "Hello you"), (3000, 4000, "Bye")]


def test_streams(spark, tmp_path):
    rows = [("r", 1, "a", None), ("r", 2, "b", "a"), ("r", 4, "d", "b"), ("q", 1, "x", "bad")]
    schema = "run_id string, sequence int, digest string, previous string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streams.checked_chain(live, early=0).writeStream.format("memory").queryName("chain").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.run_id, r.sequence, r.code) for r in spark.table("chain").collect()) == [("q", 1, "PREVIOUS_DIGEST_MISMATCH"), ("r", 4, "SEQUENCE_GAP")]
    spark.createDataFrame([("u", 0), ("u", 60), ("u", 4000)], "u string, s int").select("u", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "ev"))
    ev = spark.readStream.schema("u string, ts timestamp").parquet(str(tmp_path / "ev"))
    q = streams.sessions(ev, "u", "ts", "30 minutes", "0 seconds").writeStream.format("memory").outputMode("complete").queryName("ses").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.events for r in spark.table("ses").collect()) == [1, 2]


def test_entry_works_without_the_llm_package():
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('strataframe.llm'): raise ImportError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert 'p1_found' in q and 'p8_found' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
