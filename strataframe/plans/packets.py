"""Queries that shape results for a reader: packets, plans, states, replays; and small scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.functions.canonical import citation
from strataframe.functions.paths import suffix
from strataframe.functions.text import extensions, frame_rate, subtitle_ms
from strataframe.operators import diff, review, selection, structure, timeline
from strataframe.operators.series import numbered
from strataframe.plans.ledgers import _HEAD, _ISSUES, _RUNS, _headers, _issues, _runs
from strataframe.plans.projections import _RISK
from strataframe.plans.snapshots import _DIFF, _E, _GROWN, _entries, _pairs, _series
from strataframe.plans.timelines import _T, _timeline
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


@query(f"""with {_E}, {_DIFF}, {_GROWN}, m as (select pair, coalesce(sum(delta), 0)::bigint net, count(*) filter (kind = 'SIZE_UNKNOWN') unknowns from gr group by 1),
 u as (select pair, 0 rank, 'METRIC' kind, 'net_bytes=' || net content from m union all select pair, 0, 'METRIC', 'unknown_sizes=' || unknowns from m
 union all select pair, 1, 'FACT', change_type || ' ' || scope_id || ' ' || relative_path from d where change_type <> 'UNCHANGED'), r as (select *, row_number() over (partition by pair order by rank, content) n from u)
 select pair, n as position, kind, content, 'citation:' || lower(kind) || ':' || left(sha256(content), 32) as citation from r where n <= 64""")
def prj_4_grounded_packet(spark: SparkSession, d: str) -> DataFrame:
    """Facts and metrics of a pair with their citations: metrics first, at most 64 statements."""
    b, t = _pairs(spark, d)
    grown = structure.growth(b, t).groupBy("pair").agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("net"), F.count_if(F.col("kind") == "SIZE_UNKNOWN").alias("unknowns"))
    metrics = grown.select("pair", F.explode(F.array(F.concat(F.lit("net_bytes="), F.col("net").cast("string")), F.concat(F.lit("unknown_sizes="), F.col("unknowns").cast("string")))).alias("content")).select("pair", F.lit(0).alias("rank"), F.lit("METRIC").alias("kind"), "content")
    facts = diff.snapshot_diff(b, t).where("change_type <> 'UNCHANGED'").select("pair", F.lit(1).alias("rank"), F.lit("FACT").alias("kind"), F.concat_ws(" ", "change_type", "scope_id", "relative_path").alias("content"))
    top = selection.top_per(metrics.unionByName(facts).withColumnRenamed("rank", "first"), ["pair"], [F.col("first"), F.col("content")], 64)
    cited = F.when(F.col("kind") == "FACT", citation("fact", F.col("content"))).otherwise(citation("metric", F.col("content")))
    return top.select("pair", F.col("rank").alias("position"), "kind", "content", cited.alias("citation"))


@query(f"""with {_E}, l as (select snapshot_id from series where next_id is null), c as (select e.snapshot_id, scope_id, relative_path, mtime_ns, upper(replace(replace(regexp_extract(lower(relative_path), '[^./]\\.([a-z0-9]+)$', 1), 'jpg', 'jpeg'), 'tiff', 'tif')) f from e join l using (snapshot_id)
 where object_type = 'regular_file' and not excluded and regexp_matches(lower(relative_path), '[^./]\\.(pdf|docx|xlsx|pptx|epub|png|jpe?g|tiff?)$')), r as (select *, row_number() over (partition by snapshot_id order by mtime_ns desc nulls last, scope_id, relative_path) rank from c)
 select snapshot_id, relative_path, f as format, rank, ((rank - 1) // 20)::int batch from r""")
def prj_6_collection_plan(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each newest snapshot in the order in which they are read, in batches of twenty; one name per format."""
    s = _series(spark, d).where("pos = last_pos").select("snapshot_id")
    kind = F.replace(F.replace(F.substr(suffix(F.col("relative_path")), F.lit(2)), F.lit("jpg"), F.lit("jpeg")), F.lit("tiff"), F.lit("tif"))
    c = _entries(spark, d).join(s, "snapshot_id").where("object_type = 'regular_file' and not excluded").where(suffix(F.col("relative_path")).rlike(r"^\.(pdf|docx|xlsx|pptx|epub|png|jpe?g|tiff?)$"))
    rank = F.row_number().over(Window.partitionBy("snapshot_id").orderBy(F.desc_nulls_last("mtime_ns"), "scope_id", "relative_path"))
    return c.select("snapshot_id", "relative_path", F.upper(kind).alias("format"), rank.alias("rank")).withColumn("batch", F.floor((F.col("rank") - 1) / 20).cast("int"))


@query(f"""with {_E} select pair, scope_id, relative_path, case when b.p_digest is null or t.p_digest is null then 'UNKNOWN' when b.p_digest = t.p_digest then 'SAME' else 'DIFFERENT' end payload,
 case when b.p_digest is null or t.p_digest is null then 'NOT_COMPARABLE' when b.p_digest = t.p_digest and b.mtime_ns is not distinct from t.mtime_ns then 'UNCHANGED' when b.p_digest = t.p_digest then 'TOUCHED' else 'REWRITTEN' end relation
 from b join t using (pair, scope_id, relative_path) where b.object_type = 'regular_file' and t.object_type = 'regular_file'""")
def prj_9_temporal(spark: SparkSession, d: str) -> DataFrame:
    """What a file of a snapshot is to the same file of the next: unchanged, touched, rewritten or not comparable."""
    from strataframe.operators.entries import sides

    b, t = (x.where("object_type = 'regular_file'") for x in _pairs(spark, d))
    j = sides(b, t, diff.LOCATION, ["p_digest", "mtime_ns"], "inner")
    unknown, same = F.col("b_p_digest").isNull() | F.col("t_p_digest").isNull(), F.col("b_p_digest") == F.col("t_p_digest")
    return j.select(
        *diff.LOCATION, F.when(unknown, "UNKNOWN").when(same, "SAME").otherwise("DIFFERENT").alias("payload"),
        F.when(unknown, "NOT_COMPARABLE").when(same & F.col("b_mtime_ns").eqNullSafe(F.col("t_mtime_ns")), "UNCHANGED").when(same, "TOUCHED").otherwise("REWRITTEN").alias("relation"),
    )


@query(f"""with {_E}, {_DIFF}, r as (select pair, scope_id, relative_path, change_type, {_RISK} risk from d where change_type <> 'UNCHANGED'), n as (select *, row_number() over (partition by pair order by case risk when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, scope_id, relative_path) rank from r)
 select pair, scope_id, relative_path, change_type, risk, rank from n where rank <= 10""")
def prj_10_postflight_packet(spark: SparkSession, d: str) -> DataFrame:
    """The ten riskiest changes of each pair."""
    c = diff.snapshot_diff(*_pairs(spark, d)).where("change_type <> 'UNCHANGED'").select(*diff.LOCATION, "change_type", review.risk(review.categories(F.col("relative_path"))).alias("risk"))
    order = F.when(F.col("risk") == "HIGH", 0).when(F.col("risk") == "MEDIUM", 1).otherwise(2)
    return selection.top_per(c, ["pair"], [order, F.col("scope_id"), F.col("relative_path")], 10)


@query(f"""with {_T}, p as (select user_id, event_id, label, start_ms, end_ms, case label when 'view' then 0 when 'click' then 1 when 'error' then 2 when 'purchase' then 3 else 4 end m from tl)
 select user_id, event_id, label modality, start_ms, end_ms, row_number() over (partition by user_id order by start_ms, m, event_id) as position, count(*) over (partition by user_id, label) of_modality from p""")
def prj_11_fusion(spark: SparkSession, d: str) -> DataFrame:
    """All modalities of a timeline in one total order: time, modality, id."""
    t = _timeline(spark, d)
    order = F.when(F.col("label") == "view", 0).when(F.col("label") == "click", 1).when(F.col("label") == "error", 2).when(F.col("label") == "purchase", 3).otherwise(4)
    n = t.groupBy("user_id", "label").agg(F.count(F.lit(1)).alias("of_modality"))
    blocked = t.withColumn("block", F.floor(F.col("start_ms") / timeline.BLOCK_MS))
    p = numbered(blocked, ["user_id"], "block", [F.col("start_ms"), order, F.col("event_id")], "position").join(n, ["user_id", "label"])
    return p.select("user_id", "event_id", F.col("label").alias("modality"), "start_ms", "end_ms", "position", "of_modality")


@query(f"""with {_E} select snapshot_id, case when count(*) filter (observation_status = 'observed') = 0 then 'UNAVAILABLE' when count(*) filter (observation_status <> 'observed' or (object_type = 'regular_file' and size_bytes is null)) = 0 then 'COMPLETE' else 'PARTIAL' end metadata,
 case when count(*) filter (object_type = 'regular_file') = 0 then 'UNAVAILABLE' when count(*) filter (object_type = 'regular_file' and p_digest is null) = 0 then 'COMPLETE' else 'PARTIAL' end payload from e group by 1""")
def agg_15_diagnostic_state(spark: SparkSession, d: str) -> DataFrame:
    regular = F.col("object_type") == "regular_file"
    state = lambda n, bad: F.when(F.count_if(n) == 0, "UNAVAILABLE").when(F.count_if(bad) == 0, "COMPLETE").otherwise("PARTIAL")
    return _entries(spark, d).groupBy("snapshot_id").agg(
        state(F.col("observation_status") == "observed", (F.col("observation_status") != "observed") | (regular & F.col("size_bytes").isNull())).alias("metadata"), state(regular, regular & F.col("p_digest").isNull()).alias("payload")
    )


@query(f"""with {_RUNS}, {_HEAD}, {_ISSUES}, b as (select distinct snapshot_id from iss where code is not null and code not in ('SNAPSHOT_INDEX_MISSING', 'SNAPSHOT_ENTRY_INDEX_INCOMPLETE')), x as (select h.snapshot_id, case when h.deleted_at is not null then 'DELETED' when b.snapshot_id is not null then 'INVALID_EVIDENCE' when h.status <> 'complete' then 'NOT_COMPLETE' else 'ELIGIBLE' end as eligibility from head h left join b using (snapshot_id))
 select eligibility, count(*) snapshots from x group by 1""")
def agg_16_replay_classes(spark: SparkSession, d: str) -> DataFrame:
    """What a replay takes in and what it leaves out, by the first reason (MNT-12: governed exclusions are counted, not lost)."""
    bad = _issues(spark, d).where(~F.col("code").isin("SNAPSHOT_INDEX_MISSING", "SNAPSHOT_ENTRY_INDEX_INCOMPLETE")).select("snapshot_id").distinct().withColumn("bad", F.lit(True))
    j = _headers(spark, d).join(bad, "snapshot_id", "left")
    kind = F.when(F.col("deleted_at").isNotNull(), "DELETED").when(F.col("bad"), "INVALID_EVIDENCE").when(F.col("status") != "complete", "NOT_COMPLETE").otherwise("ELIGIBLE")
    return j.groupBy(kind.alias("eligibility")).agg(F.count(F.lit(1)).alias("snapshots"))


@query(f"with {_E} select scope_id, count(distinct relative_path) paths, count(distinct (device_id, inode)) filter (device_id is not null and inode is not null) objects, count(distinct p_digest) contents from e group by 1")
def agg_24_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts; approximate ones are no substitute."""
    return _entries(spark, d).groupBy("scope_id").agg(
        F.count_distinct("relative_path").alias("paths"), F.count_distinct(F.when(F.col("device_id").isNotNull() & F.col("inode").isNotNull(), F.struct("device_id", "inode"))).alias("objects"), F.count_distinct("p_digest").alias("contents")
    )


@query(f"""with {_RUNS}, {_HEAD} select (select count(*) from head) source, (select count(*) from head where run_id in (select run_id from run)) accepted, (select count(*) from head where run_id is null or run_id not in (select run_id from run)) rejected,
 (select count(*) from head where run_id is null or run_id not in (select run_id from run)) = 0 ready""")
def mnt_2_strict_replay(spark: SparkSession, d: str) -> DataFrame:
    """A strict replay isn't ready if a single record is rejected."""
    j = _headers(spark, d).join(_runs(spark, d).select("run_id", F.lit(True).alias("there")), "run_id", "left")
    out = j.agg(F.count(F.lit(1)).alias("source"), F.count("there").alias("accepted"), F.count_if(F.col("there").isNull()).alias("rejected"))
    return out.withColumn("ready", F.col("rejected") == 0)


#: Columns that stored entries must have, with their types.
ENTRY_SCHEMA = {"entry_id": "string", "snapshot_id": "string", "scope_id": "string", "relative_path": "string", "object_type": "string", "size_bytes": "bigint", "mtime_ns": "bigint", "excluded": "boolean"}


@query("""with want as (select * from (values ('entry_id', 'VARCHAR', 'string'), ('snapshot_id', 'VARCHAR', 'string'), ('scope_id', 'VARCHAR', 'string'), ('relative_path', 'VARCHAR', 'string'), ('object_type', 'VARCHAR', 'string'), ('size_bytes', 'BIGINT', 'bigint'), ('mtime_ns', 'BIGINT', 'bigint'), ('excluded', 'BOOLEAN', 'boolean')) v(c, t, s))
 select w.c as "column", case when i.data_type is null then 'MISSING' when i.data_type = w.t then 'OK' else lower(i.data_type) end verdict from want w left join information_schema.columns i on i.table_name = 'snapshot_entries' and i.column_name = w.c""")
def mnt_8_schema(spark: SparkSession, d: str) -> DataFrame:
    """Every required column with OK, MISSING or the type found instead."""
    found = dict(table(spark, d, "snapshot_entries").dtypes)
    rows = [(c, "OK" if found.get(c) == t else found.get(c, "MISSING")) for c, t in ENTRY_SCHEMA.items()]
    return spark.createDataFrame(rows, "column string, verdict string")


@query("""select event_id, ((l2 - l1) * (t2 - t1))::double / nullif(a + b - (l2 - l1) * (t2 - t1), 0) overlap, bit_count(xor(event_id, user_id)) differing, greatest(0, least(value, 100.0)) clamped from (select event_id, user_id, value,
 (user_id % 7)::double x1, (user_id % 7 + 5)::double x2, (event_id % 5)::double y1, (event_id % 5 + 4)::double y2, 20.0 a, 20.0 b, greatest((user_id % 7)::double, (event_id % 7)::double) l1, greatest(greatest((user_id % 7)::double, (event_id % 7)::double), least((user_id % 7 + 5)::double, (event_id % 7 + 5)::double)) l2,
 greatest((event_id % 5)::double, (user_id % 5)::double) t1, greatest(greatest((event_id % 5)::double, (user_id % 5)::double), least((event_id % 5 + 4)::double, (user_id % 5 + 4)::double)) t2 from events)""")
def fn_10_16_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of boxes, differing bits and clamped ranges."""
    e = table(spark, d, "events")
    box = lambda x, y: F.array(*[v.cast("double") for v in (x, y, x + 5, y + 4)])
    u, i = F.col("user_id"), F.col("event_id")
    return e.select("event_id", timeline.iou(box(u % 7, i % 5), box(i % 7, u % 5)).alias("overlap"), timeline.hamming(F.array(i), F.array(u)).alias("differing"), F.greatest(F.lit(0.0), F.least("value", F.lit(100.0))).alias("clamped"))


@query("""select event_id, (event_id % 100 * 3600000 + 61001)::bigint start_ms, case when event_id % 3 = 0 then null else 30000.0 / (event_id % 3) end rate, '.pdf,.txt' extensions from events""")
def fn_8_9_media_text(spark: SparkSession, d: str) -> DataFrame:
    """Subtitle times, frame rates and extensions as texts, parsed."""
    i = F.col("event_id")
    text = F.format_string("%02d:01:01,001", i % 100)
    rate = F.concat(F.lit("30000/"), (i % 3).cast("string"))
    return table(spark, d, "events").select("event_id", subtitle_ms(text).alias("start_ms"), frame_rate(rate).alias("rate"), F.array_join(extensions(F.array(F.lit("TXT"), F.lit(".pdf"), F.lit("..Pdf"))), ",").alias("extensions"))
