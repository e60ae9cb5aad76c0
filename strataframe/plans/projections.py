"""Queries that put several operators together: bounded projections, packets, status, fusion; and sources as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.functions.paths import strict_ancestors
from strataframe.operators import diff, items, review, selection, structure, timeline
from strataframe.operators.series import numbered
from strataframe.plans.documents import _COUNTED, _REPAIRED, _items
from strataframe.plans.documents import SQL as _DOCUMENT_SQL
from strataframe.plans.ledgers import _HEAD, _RUNS, _headers, _runs
from strataframe.plans.snapshots import _DIFF, _E, _GROWN, _PARENT, _SERIES, _UP, _entries, _pairs, _series, _with_reasons
from strataframe.plans.timelines import _T, _timeline
from strataframe.sources import documents as sources
from strataframe.sources import filesystem
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


_CH = "case when excluded or observation_status <> 'observed' or not readable or (object_type = 'regular_file' and size_bytes is null) or p_status = 'NOT_LOCAL' or (object_type = 'regular_file' and not p_status in ('HASHED', 'EMPTY_FILE_HASHED')) or p_provenance is not null then 0 else 1 end"


@query(f"""with {_E}, c as (select snapshot_id, scope_id, relative_path, row_number() over (partition by snapshot_id order by {_CH}, scope_id, relative_path) r from e), a as (select snapshot_id, scope_id, unnest({_UP.format(_PARENT.format("relative_path"))}) path from c where r <= 12),
 g as (select snapshot_id, scope_id, path, count(*) anchors from a group by 1, 2, 3) select snapshot_id, scope_id, path, anchors from g""")
def top_7_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Directories above the selected entries, all of them required, with the number of entries that need each."""
    rows = _with_reasons(_entries(spark, d)).select("snapshot_id", "scope_id", "relative_path", "channel")
    shown = selection.fair_selection(rows, "snapshot_id", "scope_id", "channel", ["relative_path"], 12, 0)
    return shown.select("snapshot_id", "scope_id", F.explode(strict_ancestors(F.col("relative_path"))).alias("path")).groupBy("snapshot_id", "scope_id", "path").agg(F.count(F.lit(1)).alias("anchors"))


@query("""with g as (select document_key, node_id, count(*) members from content_matches where node_id is not null group by 1, 2), r as (select *, row_number() over (partition by document_key order by members desc, node_id) rank, count(*) over (partition by document_key) components from g)
 select document_key, node_id, members, least(members, 4) shown, rank, components - 8 < 0 or rank <= 8 listed, greatest(0, components - 8) folded from r where rank <= 8""")
def top_8_overlays(spark: SparkSession, d: str) -> DataFrame:
    """The largest components of each document, up to four members of each shown, the rest counted as folded."""
    g = table(spark, d, "content_matches").where("node_id is not null").groupBy("document_key", "node_id").agg(F.count(F.lit(1)).alias("members"))
    total = g.groupBy("document_key").agg(F.count(F.lit(1)).alias("components"))
    r = selection.top_per(g, ["document_key"], [F.desc("members"), F.col("node_id")], 8).join(total, "document_key")
    return r.select("document_key", "node_id", "members", F.least("members", F.lit(4)).alias("shown"), "rank", F.lit(True).alias("listed"), F.greatest(F.lit(0), F.col("components") - 8).alias("folded"))


@query(f"""with {_E}, {_DIFF}, {_GROWN}, c as (select d.pair, change_type, case when coalesce(gr.delta, 0) > 0 then 1 else 0 end up, case when coalesce(gr.delta, 0) < 0 then 1 else 0 end down, gr.delta from d left join gr using (pair, scope_id, relative_path))
 select pair, count(*) locations, count(*) filter (change_type <> 'UNCHANGED') changed, sum(up)::bigint grown, sum(down)::bigint shrunk, coalesce(sum(delta), 0)::bigint net_bytes, case when count(*) filter (change_type <> 'UNCHANGED') > 8 then 'PARTIAL' else 'COMPLETE' end coverage from c group by 1""")
def prj_2_pair_tracking(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of a pair: diff joined with growth by location, summed once."""
    b, t = _pairs(spark, d)
    j = diff.snapshot_diff(b, t).select(*diff.LOCATION, "change_type").join(structure.growth(b, t).select(*diff.LOCATION, "delta"), diff.LOCATION, "left")
    changed = F.col("change_type") != "UNCHANGED"
    out = j.groupBy("pair").agg(
        F.count(F.lit(1)).alias("locations"), F.count_if(changed).alias("changed"), F.count_if(F.col("delta") > 0).alias("grown"), F.count_if(F.col("delta") < 0).alias("shrunk"), F.coalesce(F.sum("delta"), F.lit(0)).alias("net_bytes"),
    )
    return out.withColumn("coverage", F.when(F.col("changed") > 8, "PARTIAL").otherwise("COMPLETE"))


@query(f"""with {_E}, n as (select snapshot_id, scope_id, unnest({_UP.format(_PARENT.format("relative_path"))}) path, case when object_type = 'regular_file' then coalesce(size_bytes, 0) else 0 end s from e), g as (select snapshot_id, scope_id, path, count(*) entries, sum(s)::bigint bytes from n group by 1, 2, 3),
 r as (select *, row_number() over (partition by snapshot_id order by bytes desc, scope_id, path) rank from g) select snapshot_id, scope_id, path, entries, bytes, rank from r where rank <= 20""")
def prj_3_context_overview(spark: SparkSession, d: str) -> DataFrame:
    """The structure overview of a context packet: the twenty heaviest directories of each snapshot, excluded entries counted too."""
    s = structure.directory_summary(_entries(spark, d))
    return selection.top_per(s, ["snapshot_id"], [F.desc("bytes"), F.col("scope_id"), F.col("path")], 20)


@query(f"""with {_RUNS}, {_HEAD}, {_SERIES} select (select count(*) from run) runs, (select count(*) from run where status = 'verified') verified_runs, (select count(*) from head) snapshots, (select count(*) from series) valid_snapshots,
 (select count(distinct config_digest || scope_id) from series) series_count""")
def prj_8_system_status(spark: SparkSession, d: str) -> DataFrame:
    one = lambda df, **k: df.agg(*[v.alias(n) for n, v in k.items()]).select(F.to_json(F.struct(*k)).alias("j"))
    s = _series(spark, d)
    parts = one(_runs(spark, d), runs=F.count(F.lit(1)), verified_runs=F.count_if(F.col("status") == "verified")).unionByName(one(_headers(spark, d), snapshots=F.count(F.lit(1)))).unionByName(
        one(s, valid_snapshots=F.count(F.lit(1)), series_count=F.count_distinct("series"))
    )
    names = ["runs", "verified_runs", "snapshots", "valid_snapshots", "series_count"]
    return parts.agg(*[F.max(F.get_json_object("j", f"$.{n}").cast("bigint")).alias(n) for n in names])


@query()
def prj_13_content_search(spark: SparkSession, d: str) -> DataFrame:
    """Items that match a phrase after all repairs, with excerpts, the first five of each document and the number of all; checked against a plain version in the tests."""
    from strataframe.functions.text import excerpt, located

    rows = _items(spark, d).where("text is not null").select("doc", "i", "text").withColumn("query", F.lit("the index"))
    m = located(rows, "text", "query").select("doc", "i", excerpt(F.col("text"), F.col("source_start"), F.col("source_end")).alias("excerpt"))
    return selection.top_per(m.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("doc"))), ["doc"], [F.col("i")], 5).select("doc", "i", "excerpt", "rank", "total")


@query(f"""with {_REPAIRED.format("r0", "text_or_value", "(select * from document_items qualify row_number() over (partition by document_key, item_index order by recorded_at desc) = 1) where text_or_value is not null")}, r as (select *, trim(regexp_replace(m2, '\\s+', ' ', 'g')) m3 from r0),
 h as (select document_key doc, item_index i, ({_COUNTED.format(q="'the index'")})::int match_count, row_number() over (partition by document_key order by item_index) rank from r where contains(m0, 'the index') or contains(m1, 'the index') or contains(m2, 'the index') or contains(m3, 'the index'))
 select h.doc, h.i, match_count, trail, section, section_title, rank from h join ({_DOCUMENT_SQL["win_12_heading_trails"]}) a using (doc, i) join ({_DOCUMENT_SQL["win_16_titled"]}) b using (doc, i) where rank <= 20""")
def prj_5_evidence_slices(spark: SparkSession, d: str) -> DataFrame:
    """The evidence selection of each document: hits of the whole match cascade with heading trail and section, the first twenty as a page."""
    from strataframe.functions.text import located

    rows = _items(spark, d)
    hits = located(rows.where("text is not null").select("doc", "i", "text").withColumn("query", F.lit("the index")), "text", "query").select("doc", "i", "match_count")
    page = selection.top_per(hits, ["doc"], [F.col("i")], 20)
    return page.join(items.heading_trails(rows), ["doc", "i"]).join(items.titled(rows), ["doc", "i"]).select("doc", "i", "match_count", F.array_join("trail", ",").alias("trail"), "section", "section_title", "rank")


@query(f"""with {_T}, s as (select user_id, event_id scene, start_ms w0, lead(start_ms) over (partition by user_id order by start_ms, event_id) w1 from tl where label = 'view')
 select s.user_id, s.scene, t.label modality, count(*) members from s join tl t on t.user_id = s.user_id and t.start_ms <= s.w1 and t.end_ms >= s.w0 where s.w1 is not null and t.label <> 'view' group by 1, 2, 3""")
def itm_2_scene_groups(spark: SparkSession, d: str) -> DataFrame:
    """Observations of each modality that overlap a scene, by a bucketed interval join."""
    t = _timeline(spark, d)
    w = Window.partitionBy("user_id").orderBy("start_ms", "event_id")
    s = t.where("label = 'view'").select("user_id", F.col("event_id").alias("scene"), F.col("start_ms").alias("w_start"), F.lead("start_ms").over(w).alias("w_end")).where("w_end is not null")
    i = t.where("label <> 'view'").select("user_id", F.col("start_ms").alias("i_start"), F.col("end_ms").alias("i_end"), F.col("label").alias("modality"), "event_id")
    return timeline.overlapping(s, i, ["user_id"], 50_000_000).groupBy("user_id", "scene", "modality").agg(F.count(F.lit(1)).alias("members"))


@query("""with n as (select document_key, 'SEGMENT' kind, location.start_ms at_ms, item_index ord from document_items where kind = 'audio_transcript_segment' and location.start_ms is not null qualify row_number() over (partition by document_key, item_index order by recorded_at desc) = 1),
 r as (select document_key, 'RECORDING' kind, min(location.start_ms) at_ms, -1 ord from document_items where kind = 'audio_transcript_segment' and location.start_ms is not null group by 1), u as (select * from n union all select * from r)
 select document_key, kind, at_ms, row_number() over (partition by document_key order by at_ms, ord) as position from u""")
def prj_12_audio_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a recording in one total order: the recording before its segments."""
    from strataframe.functions.latest import latest

    rows = table(spark, d, "document_items").where("kind = 'audio_transcript_segment' and location.start_ms is not null").select("document_key", "item_index", F.col("location.start_ms").alias("at_ms"), "recorded_at")
    seg = latest(rows, ["document_key", "item_index"], ["at_ms"]).select("document_key", F.lit("SEGMENT").alias("kind"), "at_ms", F.col("item_index").alias("ord"))
    root = rows.groupBy("document_key").agg(F.min("at_ms").alias("at_ms")).select("document_key", F.lit("RECORDING").alias("kind"), "at_ms", F.lit(-1).alias("ord"))
    rows = seg.unionByName(root).withColumn("block", F.floor(F.col("at_ms") / 600_000))
    return numbered(rows, ["document_key"], "block", [F.col("at_ms"), F.col("ord")], "position").select("document_key", "kind", "at_ms", "position")


# The SQL has its own copy of the rules.
_RISK = """case when regexp_matches(lower(relative_path), '^\\.github/workflows/|^\\.git/hooks/|\\.env|credential|secret|token') or regexp_matches(lower(relative_path), 'migration|schema|database|snapshot') or regexp_matches(lower(relative_path), '^config/|\\.(toml|ini|ya?ml|json)$')
 or lower(relative_path) in ('pyproject.toml', 'poetry.lock', 'uv.lock', 'requirements.txt', 'package-lock.json', 'pnpm-lock.yaml', 'yarn.lock', 'cargo.lock') or regexp_matches(lower(relative_path), '^(skills|plugins)/') then 'HIGH' when regexp_matches(lower(relative_path), '\\.(py|js|ts|tsx|java|go|rs)$') then 'MEDIUM' else 'LOW' end"""


@query(f"""with {_E}, {_DIFF}, r as (select pair, {_RISK} risk from d where change_type <> 'UNCHANGED') select pair, count(*) changes, count(*) filter (risk = 'HIGH') high, count(*) filter (risk = 'MEDIUM') as medium, count(*) filter (risk = 'LOW') low,
 arg_max(risk, case risk when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end) risk from r group by 1""")
def agg_21_change_review(spark: SparkSession, d: str) -> DataFrame:
    return review.change_review(diff.snapshot_diff(*_pairs(spark, d)).where("change_type <> 'UNCHANGED'"), "pair", "relative_path")


@query(f"""with {_E} select coalesce(b.pair || ' ' || b.scope_id || ' ' || b.relative_path, t.pair || ' ' || t.scope_id || ' ' || t.relative_path) as location, case when b.entry_id is null then 'APPEARED' when t.entry_id is null then 'DISAPPEARED' else 'CHANGED' end outcome
 from b full join t on b.pair = t.pair and b.scope_id = t.scope_id and b.relative_path = t.relative_path where b.entry_id is null or t.entry_id is null or b.size_bytes is distinct from t.size_bytes or b.p_digest is distinct from t.p_digest""")
def joi_15_postflight(spark: SparkSession, d: str) -> DataFrame:
    at = lambda x: x.select(F.concat_ws(" ", "pair", "scope_id", "relative_path").alias("location"), "size_bytes", "p_digest")
    b, t = _pairs(spark, d)
    return review.postflight(at(b), at(t), "location")


@query()
def src_1_scan(spark: SparkSession, d: str) -> DataFrame:
    """The folder of tables itself, scanned by the file tree source; checked against os.walk in the tests."""
    return filesystem.scan(spark, {"tables": d}, "scan").select("scope_id", "relative_path", "object_type", "size_bytes", "observation_status", "partial")


@query()
def src_14_html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of all documents; one without a bracket has none. Checked against hand cases in the tests."""
    return sources.html_blocks(table(spark, d, "documents").where("contains(text, '<')"), "doc_id", "text")


@query("""select doc_id, upper(hex(encode(left(text, 4)))) head, octet_length(encode(text)) as bytes, sha256(text) digest from documents where text is not null""")
def src_12_signatures(spark: SparkSession, d: str) -> DataFrame:
    """First bytes, size and hash of contents, as the format and hashing sources see them."""
    c = F.encode("text", "UTF-8")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.hex(F.encode(F.left("text", F.lit(4)), "UTF-8")).alias("head"), F.octet_length(c).cast("bigint").alias("bytes"), F.sha2(c, 256).alias("digest"))


@query("""with f as (select source, lpad(doc_id::varchar, 12, '0') path, text, octet_length(encode(text))::bigint n, sum(octet_length(encode(text))) over (partition by source order by doc_id) upto from documents where text is not null)
 select source as scope, path, case when n > 1073741824 then 'FILE_TOO_LARGE' when upto > 8589934592 then 'TOTAL_BYTE_BUDGET_EXHAUSTED' when n = 0 then 'EMPTY_FILE_HASHED' else 'HASHED' end status, case when n <= 1073741824 and upto <= 8589934592 then sha256(text) end digest,
 case when n <= 1073741824 and upto <= 8589934592 then n end bytes_hashed from f""")
def src_5_payload_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashing under the budgets of a scan (1 GiB a file, 8 GiB a scope); documents stand for files. Checked against a plain loop in the tests."""
    files = table(spark, d, "documents").where("text is not null").select(F.col("source").alias("scope"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return sources.payload_hashes(files, "scope", "path", "content")


@query(f"""with {_SERIES} select '{{"command":"snapshots list","errors":[],"result":{{"snapshot_id":"' || snapshot_id || '","scope_id":"' || scope_id || '","pos":' || pos || '}},"run_id":null,"schema_version":1,"status":"OK","warnings":[]}}' as value from series""")
def src_24_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a listing in the JSON output envelope."""
    return sources.envelope(_series(spark, d).select("snapshot_id", "scope_id", "pos"), "snapshots list")
