from __future__ import annotations

from datetime import datetime

from strataframe.functions.text import text_match
from strataframe.plans.projections import prj_13_content_search
from tests.test_document_search import TEXTS, excerpt_of

SCHEMA = "document_key string, item_index int, kind string, text_or_value string, parent string, node_id string, role string, location struct<page:int,start_ms:bigint,end_ms:bigint,depth:int>, recorded_at timestamp_ntz"


def test_all_items_are_searched_and_counted(spark, tmp_path):
    rows = [("d", i, t) for i, t in enumerate(TEXTS * 2)] + [("e", 0, "… the index"), ("f", 0, "none")]
    spark.createDataFrame([(d, i, "paragraph", t, None, None, None, None, datetime(2026, 1, 1)) for d, i, t in rows], SCHEMA).write.parquet(str(tmp_path / "document_items.parquet"))
    hits = {}
    for d, i, t in rows:
        if text_match(t, "the index"):
            hits.setdefault(d, []).append((i, excerpt_of(t, "the index")))
    plain = {(d, i, x, k + 1, len(h)) for d, h in hits.items() for k, (i, x) in enumerate(h[:5])}
    assert {tuple(r) for r in prj_13_content_search(spark, str(tmp_path)).collect()} == plain and ("e", 0, "… the index", 1, 1) in plain and len(hits["d"]) == 12
