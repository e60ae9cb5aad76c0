from __future__ import annotations

import random

from pyspark.sql import functions as F

from strataframe.operators import timeline
from strataframe.operators.blocks import running


def test_a_key_with_most_rows_is_worked_on_in_blocks(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), i, rng.randrange(1000), rng.choice([None, rng.randrange(50)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i int, t int, v int").withColumn("v_", F.lit(1))
    values = {"l": ("last", F.col("v")), "m": ("max", F.col("v")), "s": ("sum", F.col("v"))}
    for itself in (True, False):
        got = {r.i: (r.l, r.m, r.s) for r in running(df, ["k"], F.floor(F.col("t") / 100), [F.col("t"), F.col("i")], values, itself).collect()}
        want = {}
        for key in ("hot", "a", None):
            seen = []
            for k, i, _, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
                now = [*seen, v] if itself else list(seen)
                known = [x for x in now if x is not None]
                want[i] = (known[-1] if known else None, max(known, default=None), sum(known))
                seen.append(v)
        assert got == want
    assert running(df.limit(0), ["k"], F.floor(F.col("t") / 100), [F.col("t")], values).count() == 0


def test_tracks_and_unions_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.9 else "b", rng.randrange(40_000), rng.choice("xy"), i, rng.randrange(0, 900)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, start_ms bigint, label string, id int, n int").withColumn("end_ms", F.col("start_ms") + F.col("n"))

    def found():
        t = timeline.tracks(df, "k", "start_ms", "label", ["id"])
        m, b = timeline.merged(df, ["k"]), timeline.within_budget(df, ["k"], 9_000)
        return [sorted(map(str, x.collect())) for x in (t, m, b)]

    whole = found()
    monkeypatch.setattr(timeline, "BLOCK_MS", 700)
    assert found() == whole
