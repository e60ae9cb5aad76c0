"""Pages, ranks and bounded selections with full accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order, with has_more. A page never needs more than offset + limit + 1 rows of any task."""
    check_page(limit, offset)
    more = df.orderBy(*order).offset(offset).limit(limit + 1)
    n = Window.orderBy(*order)  # at most limit + 1 rows
    return more.withColumn("_rn", F.row_number().over(n)).withColumn("has_more", F.max("_rn").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("_rn") <= limit).drop("_rn")


def check_page(limit: int, offset: int) -> None:
    """Limits are 1 to 1000 and offsets not negative; booleans are no numbers."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 1000:
        raise ValueError("limit must be an integer from 1 to 1000")
    if isinstance(offset, bool) or not isinstance(offset, int) or offset < 0:
        raise ValueError("offset must be an integer that is not negative")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, with ``rank``. Spark drops other rows before the shuffle (window group limit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def fair_selection(df: DataFrame, group: str, scope: str, channel: str, order: list[str], total: int, per_scope: int = 1) -> DataFrame:
    """At most ``total`` rows of each group: first the best of every scope, then by channel. Adds ``selected_as``.

    Only the first ``total`` rows of a group in channel order, and of a scope, can be chosen; others are
    dropped by rank before the second window.
    """
    by_channel = [F.col(channel), F.col(scope), *[F.col(c) for c in order]]
    ranked = df.withColumn("_s", F.row_number().over(Window.partitionBy(group, scope).orderBy(*by_channel))).where(F.col("_s") <= total)
    first = F.when(F.col("_s") <= per_scope, 0).otherwise(1)
    scope_order = F.when(F.col("_s") <= per_scope, F.col(scope)).otherwise(F.lit(""))
    chosen = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(first, scope_order, *by_channel)))
    return chosen.where(F.col("_r") <= total).withColumn("selected_as", F.when(F.col("_s") <= per_scope, "SCOPE_MINIMUM").otherwise("CHANNEL")).drop("_s", "_r")


def quota_selection(df: DataFrame, group: str, scope: str, channel: str, order: list[str], total: int, per_scope: int, quotas: dict[int, int]) -> DataFrame:
    """Like fair_selection, with a quota per channel that the scope minimum counts against. Adds ``selected_as``."""
    by_channel = [F.col(channel), F.col(scope), *[F.col(c) for c in order]]
    ranked = df.withColumn("_s", F.row_number().over(Window.partitionBy(group, scope).orderBy(*by_channel))).withColumn("_first", F.col("_s") <= per_scope)
    ranked = ranked.where(F.col("_s") <= total + per_scope)
    # Of the scope minimum only the first ``total`` in scope order are taken.
    ranked = ranked.withColumn("_f", F.row_number().over(Window.partitionBy(group, "_first").orderBy(F.col(scope), F.col("_s")))).withColumn("_first", F.col("_first") & (F.col("_f") <= total))
    used = F.count_if("_first").over(Window.partitionBy(group, channel))
    place = F.count_if(~F.col("_first")).over(Window.partitionBy(group, channel).orderBy(*by_channel))
    quota = F.lit(None).cast("int")
    for k, v in quotas.items():
        quota = F.when(F.col(channel) == k, v).otherwise(quota)
    fits = F.col("_first") | quota.isNull() | (place + used <= quota)
    kept = ranked.withColumn("_fits", fits).where("_fits")
    chosen = kept.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.when(F.col("_first"), 0).otherwise(1), *by_channel)))
    return chosen.where(F.col("_r") <= total).withColumn("selected_as", F.when(F.col("_first"), "SCOPE_MINIMUM").otherwise("CHANNEL")).drop("_s", "_f", "_first", "_fits", "_r")


def even_positions(count: Column, limit: int) -> Column:
    """Positions (from 0) of an even sample of ``limit`` of ``count`` things, rounded half to even; the first for one."""
    if limit == 1:
        return F.when(count > 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (count - 1) / F.lit(float(limit - 1)), 0).cast("bigint"))
    return F.when(count <= 0, F.array().cast("array<bigint>")).when(count <= limit, F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)).otherwise(F.array_distinct(spread))


def round_robin(df: DataFrame, group: str, modality: str, order: list[str], quotas: dict[str, int]) -> DataFrame:
    """Rows with the round in which their modality presents them: ``quota`` rows of a modality per round."""
    quota, place = F.lit(1), F.lit(len(quotas))
    for k, (name, q) in enumerate(quotas.items()):
        quota = F.when(F.col(modality) == name, q).otherwise(quota)
        place = F.when(F.col(modality) == name, k).otherwise(place)
    rn = F.row_number().over(Window.partitionBy(group, modality).orderBy(*[F.col(c) for c in order]))
    return df.withColumn("_rn", rn).withColumn("round", F.floor((F.col("_rn") - 1) / quota).cast("int")).withColumn("modality_place", place.cast("int")).drop("_rn")
