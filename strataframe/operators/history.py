"""History of changing attributes, by presence bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per bitmap word. Bit 0 of a word stands for the position before it, bits 1 to 63 for its own.
BITS = 63


def _has(mask: Column, bit: Column | int) -> Column:
    return F.shiftrightunsigned(mask, bit).bitwiseAND(F.lit(1)) == 1 if isinstance(bit, int) else F.call_function("bit_get", mask, bit.cast("int")) == 1


def _up(mask: Column) -> Column:
    return F.shiftleft(mask, 1)


def _flood(start: Column, through: Column) -> Column:
    """``start`` and all bits reached from it upwards over set bits of ``through``, by doubling steps."""
    step = lambda a, s: F.struct(
        a.g.bitwiseOR(a.p.bitwiseAND(F.call_function("shiftleft", a.g, s))).alias("g"),
        a.p.bitwiseAND(F.call_function("shiftleft", a.p, s)).alias("p"),
    )
    return F.aggregate(
        F.array(*[F.lit(s) for s in (1, 2, 4, 8, 16, 32)]),
        F.struct(start.cast("bigint").alias("g"), through.cast("bigint").alias("p")), step, lambda a: a.g,
    )


def _any(masks: Column) -> Column:
    return F.aggregate(masks, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def _values(items: Column, field: str) -> Column:
    """Distinct known values of ``field`` with the bitmap of each."""
    known = F.filter(items, lambda x: x[field].isNotNull())
    return F.transform(
        F.array_distinct(F.transform(known, lambda x: x[field])),
        lambda v: F.struct(v.alias("v"), _any(F.transform(F.filter(known, lambda x: x[field] == v), lambda x: x.bits)).alias("m")),
    )


def _known_bits(values: str) -> Column:
    return _any(F.transform(values, lambda x: x.m))


def _flooded(values: str, through: Column) -> Column:
    return F.transform(values, lambda x: F.struct(x.v.alias("v"), x.m.alias("m"), _flood(x.m, through).alias("e")))


def _with_carry(values: str, carried: Column) -> Column:
    """The bitmaps with bit 0 set in that of the value carried over from the word before."""
    one = F.lit(1).cast("bigint")
    marked = F.transform(values, lambda x: F.struct(x.v.alias("v"), F.when(x.v == carried, x.m.bitwiseOR(one)).otherwise(x.m).alias("m")))
    absent = carried.isNotNull() & ~F.exists(values, lambda x: x.v == carried)
    return F.when(absent, F.concat(marked, F.array(F.struct(carried.alias("v"), one.alias("m"))))).otherwise(marked)


def versions(placed: DataFrame, keys: list[str], attributes: list[str], last_pos: str | None = None) -> DataFrame:
    """Versions of each key: ``keys``, from_pos, to_pos (the first position that no longer shows it) and attributes.

    ``placed`` has one row per key and position (``pos`` from 1). A version begins where the key appears, also
    anew after an absence, or where a known attribute differs from the value last known since it appeared.
    Unknown (null) values change nothing; a version's attribute is the first known value within it, else null.
    An empty input gives no rows; repeated rows count once; null keys are keys like others.

    For each key and attribute value a bitmap has one bit per position. Versions come from bit operations on
    these: a value floods upwards through the positions where the attribute is unknown; where another value's
    bit follows a flooded one, a version starts. Words of 63 positions pass on the presence and the values at
    their end, so a series may have any length. All steps share one shuffle by key.
    """
    w, bit = ((F.col("pos") - 1) / BITS).cast("int"), (F.col("pos") - 1) % BITS + 1
    by_value = (
        placed.select(*keys, *attributes, w.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int")).alias("bit"))
        .repartition(*keys)
        .groupBy(*keys, "word", *attributes)
        .agg(F.bit_or("bit").alias("bits"))
    )
    words = by_value.groupBy(*keys, "word").agg(F.collect_list(F.struct(*attributes, "bits")).alias("items"))
    words = words.select(
        *keys, "word", _any(F.transform("items", lambda x: x.bits)).alias("p"), *[_values(F.col("items"), a).alias(f"v_{a}") for a in attributes]
    )
    run = Window.partitionBy(*keys).orderBy("word")
    words = words.withColumn("island", F.col("word") - F.row_number().over(run))
    # What a word passes on: the value its last position knows; null if it only passes on what it got.
    for a in attributes:
        unknown = F.col("p").bitwiseAND(F.bitwise_not(_known_bits(f"v_{a}")))
        top = F.get(F.filter(_flooded(f"v_{a}", unknown), lambda x: x.e < 0), F.lit(0))
        words = words.withColumn(f"out_{a}", F.when(unknown != F.lit(-2), F.struct(top.v.alias("v"))))
    before = Window.partitionBy(*keys, "island").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    previous = Window.partitionBy(*keys, "island").orderBy("word")
    words = words.select(
        "*", F.coalesce(F.lag("p").over(previous) < 0, F.lit(False)).alias("in_p"),
        *[F.last(f"out_{a}", ignorenulls=True).over(before).v.alias(f"in_{a}") for a in attributes],
    )
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    carry = F.when(F.col("in_p"), one).otherwise(zero)
    full = F.col("p").bitwiseOR(carry)
    starts = F.col("p").bitwiseAND(F.bitwise_not(_up(full)))
    for a in attributes:
        words = words.withColumn(f"w_{a}", _with_carry(f"v_{a}", F.when(F.col("in_p"), F.col(f"in_{a}"))))
        words = words.withColumn(f"f_{a}", _flooded(f"w_{a}", full.bitwiseAND(F.bitwise_not(_known_bits(f"w_{a}")))))
        reached = _any(F.transform(f"f_{a}", lambda x: x.e))
        changed = _any(F.transform(f"f_{a}", lambda x: x.m.bitwiseAND(F.bitwise_not(_up(x.e)))))
        starts = starts.bitwiseOR(changed.bitwiseAND(_up(reached)))
    words = words.select(*keys, "word", "island", "p", *[f"v_{a}" for a in attributes], starts.bitwiseAND(F.lit(-2).cast("bigint")).alias("s"))
    own = F.sequence(F.lit(1), F.lit(BITS))
    words = words.withColumn("stops", F.filter(own, lambda i: _has(F.col("s"), i) | ~_has(F.col("p"), i)))
    after = Window.partitionBy(*keys, "island").orderBy("word").rowsBetween(1, Window.unboundedFollowing)
    island = Window.partitionBy(*keys, "island")
    first = F.when(F.size("stops") > 0, F.col("word") * BITS + F.col("stops")[0])
    words = words.withColumn("_first", first)
    words = words.withColumn("beyond", F.coalesce(F.first("_first", ignorenulls=True).over(after), (F.max("word").over(island) + 1) * BITS + 1))
    # The first value known before a word's first stop belongs to the version that runs into it; a stop ends the search.
    stop = F.coalesce(F.get("stops", F.lit(0)), F.lit(BITS + 1))
    for a in attributes:
        place = lambda m: F.get(F.filter(own, lambda i: (i < stop) & _has(m, i)), F.lit(0))
        head = F.array_min(F.filter(F.transform(f"v_{a}", lambda x: F.struct(place(x.m).alias("at"), x.v.alias("v"))), lambda x: x["at"].isNotNull())).v
        words = words.withColumn(f"_h_{a}", F.when(head.isNotNull() | (F.size("stops") > 0), F.struct(head.alias("v"))))
        words = words.withColumn(f"n_{a}", F.first(f"_h_{a}", ignorenulls=True).over(after).v)
    found = words.withColumn("b", F.explode(F.filter(own, lambda i: _has(F.col("s"), i))))
    end = F.get(F.filter("stops", lambda i: i > F.col("b")), F.lit(0))
    span = lambda m: F.get(
        F.filter(F.sequence(F.col("b"), F.coalesce(F.col("end") - 1, F.lit(BITS))), lambda i: _has(m, i)), F.lit(0)
    )
    first_known = lambda a: F.array_min(F.filter(
        F.transform(f"v_{a}", lambda x: F.struct(span(x.m).alias("at"), x.v.alias("v"))), lambda x: x["at"].isNotNull()
    )).v
    return found.withColumn("end", end).select(
        *keys, (F.col("word") * BITS + F.col("b")).cast("int").alias("from_pos"),
        F.coalesce(F.col("word") * BITS + F.col("end"), F.col("beyond")).cast("int").alias("to_pos"),
        *[F.coalesce(first_known(a), F.when(F.col("end").isNull(), F.col(f"n_{a}"))).alias(a) for a in attributes],
    )


def location_history(placed: DataFrame, series: DataFrame) -> DataFrame:
    """Versions of document locations with the snapshots between which each was valid.

    Columns: scope_id, relative_path, valid_from_snapshot_id, valid_to_snapshot_id (``''`` if it lasts),
    payload_sha256, size_bytes (null where never known in the version).
    """
    found = versions(placed, ["series", "scope_id", "relative_path"], ["digest", "size"])
    begin = series.select("series", F.col("pos").alias("from_pos"), F.col("snapshot_id").alias("valid_from_snapshot_id"))
    stop = series.select("series", F.col("pos").alias("to_pos"), F.col("snapshot_id").alias("_to"))
    return found.join(begin, ["series", "from_pos"]).join(stop, ["series", "to_pos"], "left").select(
        "scope_id", "relative_path", "valid_from_snapshot_id", F.coalesce("_to", F.lit("")).alias("valid_to_snapshot_id"),
        F.col("digest").alias("payload_sha256"), F.col("size").alias("size_bytes"),
    )
