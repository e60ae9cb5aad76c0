"""Algebra of time intervals and observations: islands, unions, overlaps, tracks, scenes, windows."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.latest import checkpointed
from strataframe.operators.blocks import running

#: Pause that ends a sentence, gap within a track and least overlap of its regions, thresholds of a scene change.
PAUSE_MS, TRACK_GAP_MS, TRACK_IOU, SCENE_BASE, SCENE_RATIO, BOUNDARY_MS, SPEECH_MS, PADDING_MS = 1000, 3000, 0.25, 8.0, 2.5, 250, 720_000, 2_000
#: Milliseconds of a block; a long key is worked on in many.
BLOCK_MS = 86_400_000
TERMINAL = (".", "!", "?", "。", "！", "？")


def _block(time: Column) -> Column:
    return F.floor(time / BLOCK_MS)


def sentence_groups(segments: DataFrame, key: str, order: list[str], start: str = "start_ms", end: str = "end_ms", text: str = "text") -> DataFrame:
    """Sentences of timed segments: key, sentence, start_ms, end_ms, segments, boundary.

    A sentence ends after terminal punctuation (TERMINAL_PUNCTUATION), before a pause of more than a second
    (PAUSE_GT_1000MS) or with the recording (WINDOW_END). A null text ends nothing.
    """
    done = F.coalesce(F.rtrim(F.col(text)).rlike(r"[.!?。！？]$"), F.lit(False))
    at, block = [F.col(c) for c in order], _block(F.col(order[0]))
    flagged = segments.withColumn("_done", done)
    before = running(flagged, [key], block, at, {"_last": ("last", F.struct(F.col(end).alias("e"), F.col("_done").alias("d")))}, itself=False)
    pause = F.coalesce(F.col(start) - F.col("_last.e") > PAUSE_MS, F.lit(False))
    marked = before.withColumn("_pause", pause).withColumn("_b", (F.col("_last").isNull() | F.col("_last.d") | pause).cast("int"))
    numbered = running(marked, [key], block, at, {"sentence": ("sum", F.col("_b"))})
    each = numbered.groupBy(key, "sentence").agg(
        F.min(start).alias("start_ms"), F.count(F.lit(1)).alias("segments"), F.max_by(F.struct("_done", F.col(end).alias("e")), F.struct(*order)).alias("_l"), F.min_by("_pause", F.struct(*order)).alias("_p")
    )
    nxt = each.select(F.col(key).alias("_key"), (F.col("sentence") - 1).alias("_s"), F.col("_p").alias("_next_pause"))
    return each.join(nxt, each[key].eqNullSafe(nxt["_key"]) & (each["sentence"] == nxt["_s"]), "left").select(
        key, F.col("sentence").cast("int").alias("sentence"), "start_ms", F.col("_l.e").alias("end_ms"), "segments",
        F.when(F.col("_l._done"), "TERMINAL_PUNCTUATION").when(F.col("_next_pause"), "PAUSE_GT_1000MS").otherwise("WINDOW_END").alias("boundary"),
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (arrays of left, top, right, bottom); null if either is, or without area."""
    inter = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter / union)


def tracks(observations: DataFrame, key: str, time: str, label: str, order: list[str], box: str | None = None) -> DataFrame:
    """Runs of one label in time: key, track, label, start_ms, end_ms, observations.

    An observation extends only the one just before it: same label, at most three seconds later, and boxes that
    overlap by a quarter, if both are known. So one window with a lag is exact.
    """
    at, block = [F.col(time), *[F.col(c) for c in order]], _block(F.col(time))
    last = F.struct(F.col(label).alias("label"), F.col(time).alias("at"), (F.col(box) if box is not None else F.lit(None).cast("array<double>")).alias("box"))
    rows = running(observations, [key], block, at, {"_last": ("last", last)}, itself=False)
    same = F.col("_last.label").eqNullSafe(F.col(label)) & (F.col(time) - F.col("_last.at") <= TRACK_GAP_MS)
    if box is not None:
        same = same & (F.coalesce(iou(F.col("_last.box"), F.col(box)), F.lit(1.0)) >= TRACK_IOU)
    begins = F.col("_last").isNull() | ~F.coalesce(same, F.lit(False))
    marked = running(rows.withColumn("_b", begins.cast("int")), [key], block, at, {"track": ("sum", F.col("_b"))})
    return marked.groupBy(key, "track", F.col(label).alias("label")).agg(F.min(time).alias("start_ms"), F.max(time).alias("end_ms"), F.count(F.lit(1)).alias("observations"))


def merged(intervals: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Union of intervals per key: keys, start_ms, end_ms, parts; touching ones merge, empty ones drop out."""
    real = intervals.where(F.col(end) > F.col(start))
    at, block = [F.col(start), F.col(end)], _block(F.col(start))
    rows = running(real, keys, block, at, {"_reach": ("max", F.col(end))}, itself=False)
    begins = F.coalesce(F.col(start) > F.col("_reach"), F.lit(True)).cast("int")
    marked = running(rows.withColumn("_b", begins), keys, block, at, {"_i": ("sum", F.col("_b"))})
    return marked.groupBy(*keys, "_i").agg(F.min(start).alias("start_ms"), F.max(end).alias("end_ms"), F.count(F.lit(1)).alias("parts")).drop("_i")


def overlap_regions(turns: DataFrame, keys: list[str], speaker: str, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Regions in which two or more speakers speak: keys, start_ms, end_ms, speakers (sorted).

    A sweep: turns of one speaker are merged first, so that a count of starts less ends tells who speaks after
    each boundary; equal neighbouring sets are one region. No pairs of turns are formed.
    """
    own = merged(turns.where(F.col(speaker).isNotNull()), [*keys, speaker], start, end)
    points = own.select(*keys, speaker, F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("at"), F.lit(-1).alias("d")))).alias("p"))
    at = points.groupBy(*keys, F.col("p.at").alias("at")).agg(
        F.collect_set(F.when(F.col("p.d") == 1, F.col(speaker))).alias("on"), F.collect_set(F.when(F.col("p.d") == -1, F.col(speaker))).alias("off")
    )
    w = Window.partitionBy(*keys).orderBy("at")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows of a partition come sorted by key and time; only the set of who speaks now is kept.
        current, active = None, frozenset()
        for b in batches:
            sets = []
            for row in b[["_key", "on", "off"]].itertuples(index=False):
                if row[0] != current:
                    current, active = row[0], frozenset()
                active = (active - frozenset(row.off)) | frozenset(row.on)
                sets.append(sorted(active))
            b = b.drop(columns=["on", "off"])
            b["speakers"] = sets
            yield b

    named = at.withColumn("until", F.lead("at").over(w)).withColumn("_key", F.to_json(F.struct(*keys))).repartition(*keys).sortWithinPartitions(*keys, "at")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema if f.name not in ("on", "off")) + ", speakers array<string>"
    active = named.mapInPandas(sweep, schema).where("size(speakers) >= 2 and until is not null")
    v = Window.partitionBy(*keys).orderBy("at")
    begins = ~((F.lag("until").over(v) == F.col("at")) & (F.lag("speakers").over(v) == F.col("speakers")))
    regions = active.withColumn("_b", F.coalesce(begins, F.lit(True))).withColumn("_i", F.count_if("_b").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    return regions.groupBy(*keys, "_i", "speakers").agg(F.min("at").alias("start_ms"), F.max("until").alias("end_ms")).drop("_i")


def turn_quality(turns: DataFrame, keys: list[str], speaker: str) -> DataFrame:
    """Turns, covered milliseconds, exact median and short turns per key."""
    length = F.col("end_ms") - F.col("start_ms")
    covered = merged(turns, keys).groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"))
    own = turns.where(length > 0).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("turns"), F.count_distinct(speaker).alias("speakers"), F.percentile(length, F.lit(0.5)).alias("median_ms"), F.count_if(length < 300).alias("short_turns")
    )
    return own.join(covered, keys)


def scene_changes(scores: DataFrame, key: str, time: str, score: str) -> DataFrame:
    """Scores that mark a scene change, with the baseline: the median of up to four neighbours on either side."""
    w = Window.partitionBy(key).orderBy(time)
    near = F.concat(F.collect_list(score).over(w.rowsBetween(-4, -1)), F.collect_list(score).over(w.rowsBetween(1, 4)))
    s = F.array_sort(near)
    n = F.size(s)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0
    base = F.when(n == 0, 0.0).otherwise(middle)
    return scores.withColumn("baseline", base).where((F.col(score) >= SCENE_BASE) | (F.col(score) >= F.col("baseline") * SCENE_RATIO))


def kept_boundaries(changes: DataFrame, keys: list[str], time: str, score: str) -> DataFrame:
    """Boundaries at least 250 ms after the one kept before; of nearer ones the first stands, with the best score's time.

    The comparison is with the survivor, so it is a fold over the ordered boundaries. A fold must see a key in
    order: one task streams a sorted partition and keeps only the last boundary of the current key.
    """
    kind = {f.name: f.dataType.simpleString() for f in changes.schema}
    names = [*keys, time, score]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list | None = None
        for b in batches:
            out = []
            for row in b[names].itertuples(index=False):
                k, t, s = tuple(row[:-2]), row[-2], None if pd.isna(row[-1]) else row[-1]
                if last is not None and last[0] == k and t - last[1] < BOUNDARY_MS:
                    if s is not None and (last[2] is None or s > last[2]):
                        last = [k, t, s, last[3] + 1]
                    else:
                        last[3] += 1
                    continue
                if last is not None:
                    out.append((*last[0], *last[1:]))
                last = [k, t, s, 1]
            yield pd.DataFrame(out, columns=[*names, "merged"])
        if last is not None:
            yield pd.DataFrame([(*last[0], *last[1:])], columns=[*names, "merged"])

    ordered = changes.select(*names).repartition(*keys).sortWithinPartitions(*keys, time, F.col(score).desc_nulls_last())
    return ordered.mapInPandas(fold, ", ".join(f"`{n}` {kind[n]}" for n in names) + ", merged int")


def scenes(boundaries: DataFrame, keys: list[str], time: str, last_end: Column | None = None) -> DataFrame:
    """Consecutive boundaries as scenes: keys, ordinal, start_ms, end_ms, middle_ms; the last has no end unless given."""
    w = Window.partitionBy(*keys).orderBy(time)
    end = F.lead(time).over(w) if last_end is None else F.coalesce(F.lead(time).over(w), last_end)
    out = boundaries.select(*keys, F.row_number().over(w).alias("ordinal"), F.col(time).alias("start_ms"), end.alias("end_ms"))
    return out.withColumn("middle_ms", F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 2).cast("bigint"))


def within_budget(intervals: DataFrame, keys: list[str], budget: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Intervals in order until ``budget`` is used up; the one that goes beyond is shortened."""
    real = intervals.where(F.col(end) > F.col(start))
    rows = running(real, keys, _block(F.col(start)), [F.col(start), F.col(end)], {"_used": ("sum", F.col(end) - F.col(start))}, itself=False)
    return rows.where(F.col("_used") < budget).withColumn(end, F.least(F.col(end), F.col(start) + budget - F.col("_used"))).drop("_used")


def overlapping(windows: DataFrame, items: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Windows and the items that overlap them, ends included: an equi-join on buckets of ``span`` milliseconds.

    ``windows``: keys, w_start, w_end; ``items``: keys, i_start, i_end. A pair meets in every bucket that both
    touch and is kept in the first, so each comes out once and no bucket is joined with another.
    """
    spread = lambda d, a, b: d.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(a) / span), F.floor(F.col(b) / span))))
    j = spread(windows.where("w_end >= w_start"), "w_start", "w_end").join(spread(items.where("i_end >= i_start"), "i_start", "i_end"), [*keys, "_bucket"])
    return j.where("i_start <= w_end and i_end >= w_start").where(F.col("_bucket") == F.floor(F.greatest("w_start", "i_start") / span)).drop("_bucket")


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision, rounded half to even to six places; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.bround(dot(a, b) / norm, 6))


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, n: int, block: int = 512) -> DataFrame:
    """The first ``n`` rows for each query by ``similarity``, then key: query, key, similarity (null ones last), rank.

    Queries are read in blocks of bounded size; a task compares its rows with a block and keeps ``n`` for each.
    Null vectors, and those of another length than the query's, have a null similarity.
    """
    from strataframe.operators.selection import top_per

    def search(held: list[tuple[int, list[float] | None]]) -> DataFrame:
        ids, sides = [k for k, _ in held], [np.array([] if v is None else v, dtype="float64") for _, v in held]

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept: list[list[tuple[bool, float, int]]] = [[] for _ in ids]
            for b in batches:
                keys = b["k"].to_numpy()
                own = [np.array([] if v is None else v, dtype="float64") for v in b["v"]]
                sim = np.full((len(ids), len(keys)), np.nan)
                for size in {len(v) for v in own} & {len(v) for v in sides} - {0}:
                    qs, rs = [i for i, v in enumerate(sides) if len(v) == size], [i for i, v in enumerate(own) if len(v) == size]
                    q, r = np.stack([sides[i] for i in qs]), np.stack([own[i] for i in rs])
                    with np.errstate(divide="ignore", invalid="ignore"):
                        sim[np.ix_(qs, rs)] = np.round(q @ r.T / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(r, axis=1)), 6)
                for i, s in enumerate(sim):
                    order = np.lexsort((keys, -s))[:n]  # NaN comes last
                    kept[i] = sorted([*kept[i], *((bool(np.isnan(s[j])), -s[j] if s[j] == s[j] else 0.0, int(keys[j])) for j in order)])[:n]
            out = [(q, k, None if none else -s) for q, found in zip(ids, kept, strict=True) for none, s, k in found]
            yield pd.DataFrame(out, columns=["query", key, "similarity"]).astype({"query": "int64", key: "int64", "similarity": "float64"})

        return rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("k is not null").mapInPandas(best, f"query bigint, `{key}` bigint, similarity double")

    out, held = None, []
    asked = queries.select(key, vector).where(F.col(key).isNotNull()).toLocalIterator()
    for last, row in itertools.chain(((False, r) for r in asked), [(True, None)]):
        if row is not None:
            held.append((row[0], row[1]))
        if held and (last or len(held) == block):
            part = search(held)
            out, held = part if out is None else out.unionByName(part), []
    if out is None:
        return rows.sparkSession.createDataFrame([], f"query bigint, `{key}` bigint, similarity double, rank int")
    # pandas' missing values come as NaN.
    return top_per(out.withColumn("similarity", F.when(~F.isnan("similarity"), F.col("similarity"))), ["query"], [F.desc("similarity"), F.col(key)], n)


def greedy_windows(ranked: DataFrame, keys: list[str], score: str, time: str, margin: float, most: int) -> DataFrame:
    """Best-scored times whose padded windows don't overlap, within ``margin`` of the best, at most ``most`` per key.

    Each round takes every remaining time's best non-overlapping rival away; a window excludes any that touches
    it. Rounds are ``most``, each a window aggregate, so no key is gathered.
    """
    best = ranked.groupBy(*keys).agg(F.max(score).alias("_best"))
    left = ranked.join(best, keys).where(F.col(score) >= F.col("_best") - margin).drop("_best")
    taken = None
    for k in range(most):
        first = left.groupBy(*keys).agg(F.min_by(time, F.struct(-F.col(score), F.col(time))).alias("_t"))
        chosen = left.join(first, keys).where(F.col(time) == F.col("_t"))
        row = chosen.groupBy(*keys, time).agg(F.max(score).alias(score)).withColumn("rank", F.lit(k + 1))
        taken = row if taken is None else taken.unionByName(row)
        # Each round reads what is left three times, so it is kept; else the plan would triple with every round.
        left = checkpointed(left.join(first, keys).where(F.abs(F.col(time) - F.col("_t")) >= 2 * PADDING_MS).drop("_t"))
    return taken


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two signatures, arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def _unlike_earlier(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    kept: list[int] = []
    keep = []
    for words in pdf["signature"]:
        value = 0
        for w in words:
            value = (value << 64) | (int(w) & (1 << 64) - 1)
        new = all((value ^ k).bit_count() > most for k in kept)
        keep.append(new)
        if new:
            kept.append(value)
    return pdf[keep]


def distinct_frames(frames: DataFrame, key: str, time: str, most: int = 24, bound: int = 48) -> DataFrame:
    """Frames unlike every earlier kept one of their key. Columns key, time, signature (array of words).

    Order-dependent, hence a grouped function; the number of frames of a video is bounded by the scan
    (``bound``) and checked: more frames raise.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    own = frames.select(key, time, "signature").withColumn("_n", F.when(n > bound, F.raise_error(F.lit("too many frames for one key"))).otherwise(n)).where("_n > 0").drop("_n")
    return own.groupBy(key).applyInPandas(lambda pdf: _unlike_earlier(pdf.sort_values(time), most), own.schema)
