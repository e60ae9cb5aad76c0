from __future__ import annotations

import math
import random

from strataframe.operators.timeline import nearest
from strataframe.plans.timelines import top_15_vector_rank


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n else None


def test_every_query_row_is_answered(spark, tmp_path):
    rng = random.Random(8)
    rows = {i: [float(rng.randrange(-3, 4)) for _ in range(4)] for i in range(130)} | {40: [0.0] * 4, 41: [0.0] * 4}
    df = spark.createDataFrame([(i, v, i % 7) for i, v in rows.items()], "vec_id bigint, embedding array<float>, label int")
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    plain = set()
    for q in range(0, 130, 20):
        ranked = sorted(((s := cosine(rows[q], v)) is None, -(s or 0.0), k) for k, v in rows.items())
        plain |= {(q, k, k % 7, None if none else -s, r + 1) for r, (none, s, k) in enumerate(ranked[:20])}
    got = top_15_vector_rank(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == plain and len(got) == 140
    blocks = nearest(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 20, block=3)
    assert {tuple(r) for r in blocks.collect()} == {(q, k, s, r) for q, k, _, s, r in plain}
    assert nearest(df, df.limit(0), "vec_id", "embedding", 20).count() == 0
