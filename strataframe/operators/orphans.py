"""References to records that don't exist, with a broadcast Bloom filter in front of the exact join."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.ids import key_text, uuid_key
from strataframe.functions.latest import checkpointed, latest

#: Bits that a key sets in its word, bits a filter has per key, and the most bits it may have (8 MiB to broadcast).
#: Beyond that it answers "perhaps" more often; the exact join then has more to do, the result is the same.
HASHES, BITS_PER_KEY, MOST_BITS = 4, 16, 1 << 26
_WORD = 64


def bloom_bits(rows: int) -> int:
    """Bits for ``rows`` keys: a power of two of whole words, at most ``MOST_BITS``."""
    return min(MOST_BITS, max(_WORD * 16, 1 << math.ceil(math.log2(max(1, rows) * BITS_PER_KEY))))


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    """Word of the key, and the bits it sets there: a filter of blocks of one word, so a test reads one word."""
    h, mask = F.xxhash64(key, F.lit(1)), F.lit(0).cast("bigint")
    for i in range(HASHES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(bits // _WORD)).cast("int"), mask


def bloom_filter(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """One row, one column ``words``: the filter's words as an array. Combined before the shuffle, word by word."""
    word, mask = _place(F.col(column), bits)
    empty = keys.sparkSession.range(bits // _WORD).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("bigint").alias("m"))
    words = keys.select(word.alias("w"), mask.alias("m")).unionByName(empty).groupBy("w").agg(F.bit_or("m").alias("m"))
    in_order = F.array_sort(F.collect_list(F.struct("w", "m")))  # bits / 64 entries
    return words.agg(in_order.alias("x")).select(F.col("x.m").alias("words"))


def perhaps(words: DataFrame, bits: int, key: Column) -> Column:
    """False where the filter proves that ``key`` isn't in it. ``words`` goes to the tasks as one value of bounded size."""
    word, mask = _place(key, bits)
    return F.coalesce(F.get(words.scalar(), word).bitwiseAND(mask) == mask, F.lit(True))


def parent_keys(df: DataFrame, key: str, deleted: bool = True) -> DataFrame:
    """Referenced records: ref, parent_first (first recording), parent_deleted (of the latest delivery)."""
    rows = df.select(uuid_key(F.col(key)).alias("ref"), (F.col("deleted_at") if deleted else F.lit(None).cast("timestamp_ntz")).alias("parent_deleted"), "recorded_at").where("ref is not null")
    return latest(rows, ["ref"], ["parent_deleted"], firsts=True).withColumnRenamed("first_at", "parent_first")


@dataclass(frozen=True)
class Parents:
    """Referenced records, kept in the checkpoint folder, with the filter over their keys: made once, used by every referring table."""

    rows: DataFrame
    words: DataFrame
    bits: int


def filtered(parents: DataFrame) -> Parents:
    """``parents`` (see parent_keys) with their filter."""
    rows = checkpointed(parents)
    bits = bloom_bits(rows.count())
    return Parents(rows, checkpointed(bloom_filter(rows, "ref", bits)), bits)


def orphan_references(children: DataFrame, child_table: str, child_key: str, ref: str, parents: DataFrame | Parents) -> DataFrame:
    """Orphan references of one table: child_table, child_key, ref_key, orphan_kind, period.

    ``missing`` if no parent has the key; else ``deleted`` if the parent was deleted at or before the child's
    first recording; else ``late`` if the parent was first recorded after the child was. The latest delivery of
    a child gives its reference; a blank one is unknown and gives no row, as does a null child key. A filter
    over all parent keys proves most missing ones without a join; only references it can't rule out are joined.
    """
    rows = children.select(
        key_text(F.col(child_key)).alias("child_key"), key_text(F.col(ref)).alias("ref_key"), uuid_key(F.col(ref)).alias("ref"), "recorded_at"
    ).where("child_key is not null")
    known = latest(rows, ["child_key"], ["ref_key", "ref"], firsts=True).where("ref_key is not null")
    out = lambda d, kind: d.select(
        F.lit(child_table).alias("child_table"), "child_key", "ref_key", kind.alias("orphan_kind"), F.date_format("first_at", "yyyy-MM").alias("period")
    )
    p = parents if isinstance(parents, Parents) else filtered(parents)
    hit = perhaps(p.words, p.bits, F.col("ref"))
    proven = out(known.where(~hit), F.lit("missing"))
    kind = (
        F.when(F.col("_there").isNull(), "missing")
        .when(F.col("parent_deleted") <= F.col("first_at"), "deleted")
        .when(F.col("parent_first") > F.col("first_at"), "late")
    )
    there = known.where(hit).join(p.rows.withColumn("_there", F.lit(True)), "ref", "left")
    return proven.unionByName(out(there, kind).where("orphan_kind is not null"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, kind and month: child_table, period, orphan_kind, orphans."""
    return found.groupBy("child_table", "period", "orphan_kind").agg(F.count(F.lit(1)).alias("orphans"))
