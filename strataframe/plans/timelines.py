"""Queries over timed observations: the events of a user as a timeline, vectors, transcripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.operators import selection, timeline
from strataframe.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    """user_id, event_id, start_ms, end_ms, label: an event lasts as many thousand seconds as its value."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(
        "user_id", "event_id", F.floor(start / 1000).alias("start_ms"), (F.floor(start / 1000) + F.floor(F.col("value") * 1_000_000)).alias("end_ms"), F.col("event_type").alias("label"), "value"
    )


_T = "tl as (select user_id, event_id, epoch_us(ts) // 1000 start_ms, epoch_us(ts) // 1000 + floor(value * 1000000)::bigint end_ms, event_type as label, value from events)"
_ISLAND = """r as (select *, max(end_ms) over (partition by {k} order by start_ms, end_ms rows between unbounded preceding and 1 preceding) reach from tl where end_ms > start_ms),
i as (select *, sum(case when start_ms <= reach then 0 else 1 end) over (partition by {k} order by start_ms, end_ms rows unbounded preceding) isl from r),
m as (select {k}, isl, min(start_ms) start_ms, max(end_ms) end_ms, count(*) parts from i group by {k}, isl)"""


@query(f"with {_T}, {_ISLAND.format(k='user_id')} select user_id, start_ms, end_ms, parts from m")
def win_10_interval_union(spark: SparkSession, d: str) -> DataFrame:
    return timeline.merged(_timeline(spark, d).select("user_id", "start_ms", "end_ms"), ["user_id"])


@query(f"""with {_T}, {_ISLAND.format(k='user_id, label')}, p as (select distinct user_id, start_ms t from m union select distinct user_id, end_ms from m),
 g as (select user_id, t, lead(t) over (partition by user_id order by t) u from p), a as (select g.user_id, g.t, g.u, string_agg(distinct m.label, ',' order by m.label) speakers, count(distinct m.label) n from g join m on m.user_id = g.user_id and m.start_ms < g.u and m.end_ms > g.t group by 1, 2, 3),
 b as (select *, case when lag(u) over w = t and lag(speakers) over w = speakers then 0 else 1 end st from a where n >= 2 window w as (partition by user_id order by t)), c as (select *, sum(st) over (partition by user_id order by t rows unbounded preceding) k from b)
 select user_id, min(t) start_ms, max(u) end_ms, speakers from c group by user_id, k, speakers""")
def win_11_overlap_regions(spark: SparkSession, d: str) -> DataFrame:
    return timeline.overlap_regions(_timeline(spark, d).select("user_id", "start_ms", "end_ms", "label"), ["user_id"], "label").withColumn("speakers", F.array_join("speakers", ","))


@query(f"""with {_T}, {_ISLAND.format(k='user_id')}, c as (select user_id, sum(end_ms - start_ms)::bigint covered_ms from m group by 1)
 select t.user_id, count(*) turns, count(distinct label) speakers, quantile_cont(end_ms - start_ms, 0.5) median_ms, count(*) filter (end_ms - start_ms < 300) short_turns, any_value(c.covered_ms) covered_ms
 from tl t join c using (user_id) where end_ms > start_ms group by 1""")
def agg_22_turn_quality(spark: SparkSession, d: str) -> DataFrame:
    return timeline.turn_quality(_timeline(spark, d).select("user_id", "start_ms", "end_ms", "label"), ["user_id"], "label")


@query("""with o as (select user_id % 5 as "key", epoch_us(ts) // 1000 at_ms, event_type as label, event_id from events), f as (select *, case when lag(label) over w = label and at_ms - lag(at_ms) over w <= 3000 then 0 else 1 end st from o window w as (partition by key order by at_ms, event_id)),
 n as (select *, sum(st) over (partition by key order by at_ms, event_id rows unbounded preceding) track from f) select key, track::bigint track, label, min(at_ms) start_ms, max(at_ms) end_ms, count(*) observations from n group by 1, 2, 3""")
def win_6_tracks(spark: SparkSession, d: str) -> DataFrame:
    o = _timeline(spark, d).select((F.col("user_id") % 5).alias("key"), F.col("start_ms").alias("at"), "label", "event_id")
    return timeline.tracks(o, "key", "at", "label", ["event_id"])


@query("""with o as (select user_id, event_id, epoch_us(ts) // 1000 at_ms, value / 10 score from events), n as (select *, list_concat(coalesce(list(score) over (partition by user_id order by at_ms, event_id rows between 4 preceding and 1 preceding), []),
 coalesce(list(score) over (partition by user_id order by at_ms, event_id rows between 1 following and 4 following), [])) nb from o), b as (select *, case when len(nb) = 0 then 0.0 else (list_sort(nb)[(len(nb) - 1) // 2 + 1] + list_sort(nb)[len(nb) // 2 + 1]) / 2.0 end baseline from n)
 select user_id, event_id, at_ms, score, baseline from b where score >= 8.0 or score >= baseline * 2.5""")
def win_7_scene_changes(spark: SparkSession, d: str) -> DataFrame:
    o = _timeline(spark, d).select("user_id", "event_id", F.col("start_ms").alias("at_ms"), (F.col("value") / 10).alias("score"))
    return timeline.scene_changes(o.withColumn("_o", F.struct("at_ms", "event_id")), "user_id", "_o", "score").select("user_id", "event_id", "at_ms", "score", "baseline")


@query("""with recursive o as (select user_id, (epoch_us(ts) // 1000) // 40000 as p, value, row_number() over (partition by user_id order by (epoch_us(ts) // 1000) // 40000, value desc nulls last) rn from events),
 f as (select user_id, rn, p as t, value as s, 1 as m, 1 as c from o where rn = 1 union all select o.user_id, o.rn, case when o.p - f.t >= 250 or o.value > f.s then o.p else f.t end, case when o.p - f.t >= 250 or o.value > f.s then o.value else f.s end,
  case when o.p - f.t < 250 then f.m + 1 else 1 end, case when o.p - f.t < 250 then f.c else f.c + 1 end from f join o on o.user_id = f.user_id and o.rn = f.rn + 1)
 select user_id, arg_max(t, rn) as at, arg_max(s, rn) as value, max(m) merged from f group by user_id, c""")
def win_8_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Order-dependent; checked against a plain loop in the tests too."""
    o = _timeline(spark, d).select("user_id", F.floor(F.col("start_ms") / 40_000).alias("at"), "value")
    return timeline.kept_boundaries(o, ["user_id"], "at", "value")


@query("""with o as (select distinct user_id, epoch_us(ts) // 1000 at_ms from events) select user_id, row_number() over w as ordinal, at_ms start_ms, lead(at_ms) over w as end_ms, at_ms + (lead(at_ms) over w - at_ms) // 2 middle_ms from o window w as (partition by user_id order by at_ms)""")
def win_9_scenes(spark: SparkSession, d: str) -> DataFrame:
    return timeline.scenes(_timeline(spark, d).select("user_id", F.col("start_ms").alias("at")).distinct(), ["user_id"], "at")


@query(f"""with {_T}, u as (select *, coalesce(sum(end_ms - start_ms) over (partition by user_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding), 0) used from tl where end_ms > start_ms)
 select user_id, event_id, start_ms, least(end_ms, start_ms + 500000000 - used)::bigint end_ms from u where used < 500000000""")
def win_15_budget(spark: SparkSession, d: str) -> DataFrame:
    return timeline.within_budget(_timeline(spark, d).select("user_id", "event_id", "start_ms", "end_ms"), ["user_id"], 500_000_000)


@query(f"""with {_T}, w as (select user_id, start_ms - 2000 w_start, start_ms + 2000000 w_end, event_id window_id from tl where label = 'error')
 select w.user_id, w.window_id, t.event_id item_id from w join tl t on t.user_id = w.user_id and t.start_ms <= w.w_end and t.end_ms >= w.w_start""")
def joi_12_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = _timeline(spark, d)
    w = t.where("label = 'error'").select("user_id", (F.col("start_ms") - 2000).alias("w_start"), (F.col("start_ms") + 2_000_000).alias("w_end"), F.col("event_id").alias("window_id"))
    i = t.select("user_id", F.col("start_ms").alias("i_start"), F.col("end_ms").alias("i_end"), F.col("event_id").alias("item_id"))
    return timeline.overlapping(w, i, ["user_id"], 50_000_000).select("user_id", "window_id", "item_id")


@query("""with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings), s as (select q.vec_id as query, v.vec_id, v.label, round_even(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 6) similarity
 from v join v q on q.vec_id % 20 = 0), r as (select *, row_number() over (partition by query order by similarity desc, vec_id)::int rank from s) select query, vec_id, label, similarity, rank from r where rank <= 20""")
def top_15_vector_rank(spark: SparkSession, d: str) -> DataFrame:
    """Top 20 of all rows by cosine for every row whose id is divisible by 20; checked against a plain version in the tests too."""
    e = table(spark, d, "embeddings")
    return timeline.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 20).join(e.select("vec_id", "label"), "vec_id").select("query", "vec_id", "label", "similarity", "rank")


@query("""with recursive e as (select user_id, epoch_us(ts) // 1000 as p, max(value) score from events group by 1, 2), o as (select *, row_number() over (partition by user_id order by score desc, p) rn, max(score) over (partition by user_id) best from e),
 f as (select user_id, rn, [p] as kept, [score] as scores from o where rn = 1 union all select o.user_id, o.rn, case when k.ok then list_append(f.kept, o.p) else f.kept end, case when k.ok then list_append(f.scores, o.score) else f.scores end
  from f join o on o.user_id = f.user_id and o.rn = f.rn + 1, lateral (select len(f.kept) < 4 and o.score >= o.best - 50 and len(list_filter(f.kept, lambda x: abs(x - o.p) < 4000)) = 0 ok) k), l as (select user_id, arg_max(kept, rn) kept, arg_max(scores, rn) scores from f group by 1)
 select user_id, unnest(kept) as at, unnest(scores) score, unnest(range(1, len(kept) + 1))::int rank from l""")
def top_16_greedy_windows(spark: SparkSession, d: str) -> DataFrame:
    """Order-dependent; checked against a plain loop in the tests too."""
    t = _timeline(spark, d).select("user_id", F.col("start_ms").alias("at"), F.col("value").alias("score"))
    return timeline.greedy_windows(t, ["user_id"], "score", "at", 50.0, 4)


@query("""with recursive o as (select vec_id // 40 as video, vec_id as p, list_slice(list_transform(embedding, lambda x: x > 0), -64, -1) as b, row_number() over (partition by vec_id // 40 order by vec_id) rn from embeddings),
 f as (select video, rn, [b] as kept, [p] as ats from o where rn = 1 union all select o.video, o.rn, case when k.ok then list_append(f.kept, o.b) else f.kept end, case when k.ok then list_append(f.ats, o.p) else f.ats end from f join o on o.video = f.video and o.rn = f.rn + 1,
  lateral (select len(list_filter(f.kept, lambda x: len(list_filter(list_zip(x, o.b), lambda z: z[1] <> z[2])) <= 24)) = 0 ok) k)
 select video, unnest(arg_max(ats, rn)) as at from f group by 1""")
def top_19_distinct_frames(spark: SparkSession, d: str) -> DataFrame:
    """Order-dependent; checked against a plain loop in the tests too. Vectors of a label's hundred stand for frames."""
    e = table(spark, d, "embeddings").withColumn("video", F.floor(F.col("vec_id") / 40))
    bits = F.aggregate(F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)), F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("bigint")))
    frames = e.select("video", F.col("vec_id").alias("at"), F.array(bits).alias("signature"))
    return timeline.distinct_frames(frames, "video", "at").select("video", "at")


@query("""with n as (select user_id, count(*) c from events group by 1), p as (select user_id, c, unnest(case when c <= 5 then range(c) else list_distinct(list_transform(range(5), lambda i: round_even(i * (c - 1) / 4.0, 0)::bigint)) end) pos from n)
 select user_id, pos::bigint pos from p""")
def top_12_even_sample(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
    return n.select("user_id", F.explode(selection.even_positions(F.col("c"), 5)).alias("pos"))


@query(f"""with {_T}, l as (select user_id, max(end_ms) - min(start_ms) dur from tl group by 1), k as (select user_id, dur, least(8, greatest(1, ceil(dur / 10000.0)::bigint)) n from l where dur > 0)
 select user_id, least(dur - 1, ((2 * i + 1) * dur) // (2 * n)) at_ms from (select *, unnest(range(n)) i from k)""")
def top_13_midpoints(spark: SparkSession, d: str) -> DataFrame:
    k = _timeline(spark, d).groupBy("user_id").agg((F.max("end_ms") - F.min("start_ms")).alias("dur")).where("dur > 0")
    k = k.withColumn("n", F.least(F.lit(8), F.greatest(F.lit(1), F.ceil(F.col("dur") / 10000.0))))
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i")
    return k.select("user_id", "dur", "n", at).select("user_id", F.least(F.col("dur") - 1, F.expr("((2 * i + 1) * dur) div (2 * n)")).alias("at_ms"))


@query("""select user_id, event_type, arg_max(event_id, struct_pack(a := value, b := -event_id)) best from events group by 1, 2""")
def top_14_best_frame(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"))


@query("""with r as (select user_id, event_id, event_type, row_number() over (partition by user_id, event_type order by event_id) rn from events)
 select user_id, event_id, event_type, ((rn - 1) // case event_type when 'error' then 3 when 'purchase' then 2 else 1 end)::int as round, case event_type when 'error' then 0 when 'purchase' then 1 when 'view' then 2 else 3 end modality_place from r""")
def top_17_round_robin(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return selection.round_robin(e, "user_id", "event_type", ["event_id"], {"error": 3, "purchase": 2, "view": 1})


@query("select user_id, arg_min(event_id, struct_pack(a := (event_type <> 'signup')::int, b := event_id)) as primary_event from events group by 1")
def top_18_primary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct((F.col("event_type") != "signup").cast("int"), "event_id")).alias("primary_event"))


@query("""with s as (select user_id, event_id, value, lag(value) over (partition by user_id order by event_id) before from events) select user_id, count(*) samples, avg(value) mean_value,
 sum(case when before is null or value < before then null else value - before end) advanced, count(*) filter (before is not null and value < before) resets from s group by 1""")
def agg_18_counters(spark: SparkSession, d: str) -> DataFrame:
    """Means, and deltas of counters: a counter that went back was reset and has no delta."""
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    s = table(spark, d, "events").select("user_id", "event_id", "value", before.alias("before"))
    return s.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("value").alias("mean_value"), F.sum(F.when(F.col("value") >= F.col("before"), F.col("value") - F.col("before"))).alias("advanced"), F.count_if(F.col("value") < F.col("before")).alias("resets")
    )


@query("""with r as (select *, row_number() over (partition by event_type order by value desc, user_id desc, event_id) rank from events) select event_type, event_id, value, rank from r where rank <= 10""")
def top_4_processes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", "value", "user_id")
    return selection.top_per(e, ["event_type"], [F.desc("value"), F.desc("user_id"), F.col("event_id")], 10).drop("user_id")


_SEG = """s0 as (select * from document_items where kind = 'audio_transcript_segment' qualify row_number() over (partition by document_key, item_index order by recorded_at desc) = 1),
 sg as (select document_key, item_index, text_or_value text, location.start_ms start_ms, location.end_ms end_ms from s0 where location.start_ms is not null)"""


@query(f"""with {_SEG}, f as (select *, coalesce(regexp_matches(rtrim(text), '[.!?。！？]$'), false) done, coalesce(start_ms - lag(end_ms) over w > 1000, false) pause, row_number() over w rn from sg window w as (partition by document_key order by start_ms, item_index)),
 n as (select *, sum(case when rn = 1 or pause or lag(done) over w then 1 else 0 end) over (partition by document_key order by start_ms, item_index rows unbounded preceding) sentence, lead(pause) over w next_pause from f window w as (partition by document_key order by start_ms, item_index)),
 m as (select document_key, sentence, min(start_ms) start_ms, count(*) segments, max(struct_pack(a := start_ms, b := item_index, d := done, p := coalesce(next_pause, false), e := end_ms)) l from n group by 1, 2)
 select document_key, sentence::int sentence, start_ms, l.e end_ms, segments, case when l.d then 'TERMINAL_PUNCTUATION' when l.p then 'PAUSE_GT_1000MS' else 'WINDOW_END' end boundary from m""".replace("sum(case when rn = 1 or pause or lag(done) over w then 1 else 0 end)", "sum(st)").replace("n as (select *, sum(st)", "f2 as (select *, case when rn = 1 or pause or lag(done) over (partition by document_key order by start_ms, item_index) then 1 else 0 end st from f),\n n as (select *, sum(st)").replace("next_pause from f window", "next_pause from f2 window"))
def win_5_sentences(spark: SparkSession, d: str) -> DataFrame:
    from strataframe.functions.latest import latest

    rows = table(spark, d, "document_items").where("kind = 'audio_transcript_segment'").select(
        "document_key", "item_index", F.col("text_or_value").alias("text"), F.col("location.start_ms").alias("start_ms"), F.col("location.end_ms").alias("end_ms"), "recorded_at"
    )
    one = latest(rows, ["document_key", "item_index"], ["text", "start_ms", "end_ms"]).where("start_ms is not null")
    return timeline.sentence_groups(one, "document_key", ["start_ms", "item_index"])


@query("""select session, user_id, count(*) events, sum(value) total from (select *, sum(st) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session from
 (select *, case when lag(ts) over (partition by user_id order by ts, event_id) >= ts - interval 30 minute then 0 else 1 end st from events)) group by 1, 2""".replace(">= ts - interval 30 minute", "> ts - interval 30 minute"))
def win_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by gap, the batch counterpart of the streaming session window; numbered per user."""
    e = table(spark, d, "events").select("user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return s.select(F.row_number().over(Window.partitionBy("user_id").orderBy("session_window")).cast("bigint").alias("session"), "user_id", "events", "total")
