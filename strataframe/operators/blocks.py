"""Running values over long keys, block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], block: Column, order: list[Column], values: dict[str, tuple[str, Column]], itself: bool = True) -> DataFrame:
    """``df`` with running values up to each row (``itself``) or before it, in ``order`` within ``keys``.

    ``values``: name to (``last``, ``max`` or ``sum``, value); nulls are passed over, and a sum of nothing is 0.
    ``block`` must rise with ``order``. Every block is sorted on its own; what earlier blocks hand on comes from
    one row per block. So a key with a large part of all rows is spread over its blocks. Null keys are keys.
    """
    named = df.withColumn("_block", block).withColumns({f"_v_{n}": v for n, (_, v) in values.items()}).withColumn("_o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    plain = {"max": F.max, "sum": F.sum}
    within = Window.partitionBy(*keys, "_block").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    past = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda fn, c, w: (F.last(c, ignorenulls=True) if fn == "last" else plain[fn](c)).over(w)
    ends = named.groupBy(*keys, "_block").agg(*[
        (F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_o"))) if fn == "last" else plain[fn](f"_v_{n}")).alias(f"_e_{n}") for n, (fn, _) in values.items()
    ])
    handed = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), *[over(fn, f"_e_{n}", past).alias(f"_p_{n}") for n, (fn, _) in values.items()])
    here = named.withColumns({f"_h_{n}": over(fn, f"_v_{n}", within) for n, (fn, _) in values.items()})
    on = [here[k].eqNullSafe(handed[f"_k{i}"]) for i, k in enumerate(keys)] + [here["_block"].eqNullSafe(handed["_b"])]
    both = here.join(handed, on, "left")
    out = []
    for n, (fn, _) in values.items():
        h, p = F.col(f"_h_{n}"), F.col(f"_p_{n}")
        out.append((F.coalesce(h, p) if fn == "last" else F.greatest(h, p) if fn == "max" else F.coalesce(h, F.lit(0)) + F.coalesce(p, F.lit(0))).alias(n))
    return both.select(*[here[c] for c in df.columns], *out)
