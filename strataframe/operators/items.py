"""Normalized document items: sections, trails, context windows, slices, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.latest import latest
from strataframe.functions.text import role_of
from strataframe.operators.blocks import running

#: Deepest heading level; deeper ones count as this one.
LEVELS = 6
#: Items of a block; a long document is worked on in many.
ITEM_BLOCK = 4096


def _block(i: Column) -> Column:
    return F.floor(i / ITEM_BLOCK)


def counted_items(items: DataFrame) -> DataFrame:
    """Latest delivery of each item: doc, i, kind, text, parent, node_id, role, level, page, start_ms, end_ms."""
    rows = items.select(
        F.col("document_key").alias("doc"), F.col("item_index").alias("i"), "kind", F.col("text_or_value").alias("text"), F.nullif(F.trim("parent"), F.lit("")).alias("parent"), F.trim("node_id").alias("node_id"),
        role_of(F.col("kind"), F.col("role")).alias("role"), F.coalesce(F.when(F.col("location.depth") >= 0, F.col("location.depth")), F.lit(1)).alias("level"), F.col("location.page").alias("page"),
        F.col("location.start_ms").alias("start_ms"), F.col("location.end_ms").alias("end_ms"), "recorded_at",
    )
    return latest(rows.where("doc is not null and i is not null"), ["doc", "i"], [c for c in rows.columns if c not in ("doc", "i", "recorded_at")])


def sections(items: DataFrame) -> DataFrame:
    """Headings with their extent: doc, heading, level, until (the next heading of the same or a higher level, else the end).

    For each level one running minimum from behind gives the next heading up to that level, so no heading meets
    another one in a join.
    """
    level = F.least(F.col("level"), F.lit(LEVELS))
    heading = F.col("role") == "HEADING"
    ends = items.groupBy("doc").agg((F.max("i") + 1).alias("_end"))
    later = Window.partitionBy("doc").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    h = items.where(heading).select("doc", "i", level.alias("level"))
    out = h.select("*", *[F.min(F.when(F.col("level") <= k, F.col("i"))).over(later).alias(f"_n{k}") for k in range(LEVELS + 1)])
    nxt = F.lit(None).cast("int")
    for k in range(LEVELS + 1):
        nxt = F.when(F.col("level") == k, F.col(f"_n{k}")).otherwise(nxt)
    return out.join(ends, "doc").select("doc", F.col("i").alias("heading"), "level", F.coalesce(nxt, F.col("_end")).alias("until"))


def heading_trails(items: DataFrame) -> DataFrame:
    """The headings above each item by position: doc, i, trail (indexes, ascending).

    Walking back, a heading counts if its level is below all levels met so far, and the walk ends at level 1
    or 0. So the last heading of each level counts unless a later one has a level no deeper.
    """
    level = F.least(F.col("level"), F.lit(LEVELS))
    is_heading = F.col("role") == "HEADING"
    last = {f"_l{k}": ("max", F.when(is_heading & (level == k), F.col("i"))) for k in range(LEVELS + 1)}
    rows = running(items.select("doc", "i", "role", "level"), ["doc"], _block(F.col("i")), [F.col("i")], last, itself=False)
    kept = []
    for k in range(LEVELS + 1):
        higher = [F.coalesce(F.col(f"_l{j}"), F.lit(-1)) for j in range(k)]
        blocked = F.greatest(*higher, F.lit(-1)) > F.col(f"_l{k}") if k else F.lit(False)
        if k == 0:
            blocked = F.coalesce(F.col("_l1") > F.col("_l0"), F.lit(False))
        kept.append(F.when(~blocked, F.col(f"_l{k}")))
    return rows.select("doc", "i", F.array_sort(F.array_compact(F.array(*kept))).alias("trail"))


def titled(items: DataFrame) -> DataFrame:
    """Items with the number and the title of the section they are in: headings count up from 1, titles are cut at 256 characters."""
    opens = (F.col("role") == "HEADING") & (F.coalesce(F.col("text"), F.lit("")) != "")
    values = {"section": ("sum", F.when(opens, 1)), "section_title": ("last", F.when(opens, F.left("text", F.lit(256))))}
    rows = running(items.select("doc", "i", "role", "text"), ["doc"], _block(F.col("i")), [F.col("i")], values)
    return rows.select("doc", "i", F.col("section").cast("int").alias("section"), "section_title")


def context_window(items: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """Items around each anchor: doc, anchor, i. ``anchors``: doc, i.

    Up to ``k`` items with text, or headings, tables and figures, on either side; another page ends the walk,
    an item without a page doesn't.
    """
    counts = F.when(F.col("text").isNotNull() | F.col("role").isin("HEADING", "TABLE", "FIGURE"), 1).otherwise(0)
    w = Window.partitionBy("doc").orderBy("i")
    known = F.last("page", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    turn = F.when(F.col("page").isNotNull() & known.isNotNull() & (F.col("page") != known), 1).otherwise(0)
    rows = items.withColumn("_c", counts).withColumn("_turn", turn)
    rows = rows.withColumn("_n", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mine = rows.select("doc", "i", "page", "_c", "_n", "_run")
    # A counted item lies in the window if at most k counted ones lie between; so anchors meet the counted
    # items by their rank, one equi-join per step.
    a = mine.join(anchors.select("doc", "i"), ["doc", "i"]).select("doc", F.col("i").alias("anchor"), F.col("page").alias("_p"), F.col("_run").alias("_r"), F.explode(F.sequence(F.col("_n") - F.col("_c") - k + 1, F.col("_n") + k)).alias("_n"))
    near = a.join(mine.where("_c = 1"), ["doc", "_n"]).where((F.col("i") == F.col("anchor")) | F.col("_p").isNull() | (F.col("_run") == F.col("_r")))
    return near.select("doc", "anchor", "i").unionByName(anchors.select("doc", F.col("i").alias("anchor"), "i")).distinct()


def quality(items: DataFrame) -> DataFrame:
    """Characters, letters and digits, pages and nearly empty pages per document, with the reasons for doubt."""
    alnum = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]", ""))
    pages = items.groupBy("doc", "page").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.sum(alnum).alias("alnum"))
    paged = F.col("page").isNotNull()
    out = pages.groupBy("doc").agg(
        F.sum("chars").alias("chars"), F.sum("alnum").alias("alnum"), F.count_if(paged).alias("pages"), F.count_if(paged & (F.col("alnum") < 4)).alias("empty_pages")
    )
    reasons = F.array_compact(F.array(F.when(F.col("alnum") == 0, "NO_TEXT"), F.when(F.col("empty_pages") > 0, "EMPTY_PAGES"), F.when(F.col("alnum") * 2 < F.col("chars"), "FEW_LETTERS")))
    return out.withColumn("reasons", F.array_join(reasons, ","))


def packed_slice(entries: Column, total: int, each: int) -> Column:
    """Greedy filling of a slice: ``entries`` is an array of (priority, i, text); returns those that fit, cut to size.

    In order of priority and place each text is cut to ``each`` characters and to what is left of ``total``.
    """
    ordered = F.array_sort(entries)
    start = F.struct(F.lit(total).alias("left"), F.array().cast("array<struct<i:int,text:string,cut:boolean>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        n = F.least(F.length(x.text), F.lit(each), acc.left)
        row = F.struct(x.i.alias("i"), F.left(x.text, n).alias("text"), (n < F.length(x.text)).alias("cut"))
        return F.struct((acc.left - n).alias("left"), F.when((n > 0) & (acc.left > 0), F.concat(acc.out, F.array(row))).otherwise(acc.out).alias("out"))

    return F.aggregate(ordered, start, add, lambda a: F.array_sort(a.out))


def visual_choice(items: DataFrame) -> DataFrame:
    """The item to show for each document: figures, formulas and tables first, then position; a caption leads to the first of its page."""
    visual = F.col("role").isin("FIGURE", "FORMULA", "TABLE")
    first = items.where(visual & F.col("page").isNotNull()).groupBy("doc", "page").agg(F.min("i").alias("_v"))
    j = items.join(first, ["doc", "page"], "left").withColumn("shown", F.when((F.col("role") == "CAPTION") & F.col("_v").isNotNull(), F.col("_v")).otherwise(F.col("i")))
    return j.groupBy("doc").agg(F.min_by("shown", F.struct(F.when(visual, 0).otherwise(1), "i")).alias("i"))
