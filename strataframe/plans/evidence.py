"""Queries over what a reader is shown: places, views, chosen snapshots, bounded pages and packets, replay accounts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions.ids import instant, uuid_key
from strataframe.functions.latest import latest
from strataframe.functions.paths import ancestors_or_self, strict_ancestors
from strataframe.functions.text import role_of
from strataframe.operators import context, diff, duplicates, selection
from strataframe.plans.documents import _I, _items
from strataframe.plans.ledgers import _HEAD, _RUNS, _headers, _runs
from strataframe.plans.problems import _LATEST, _SERIES, _UUID
from strataframe.plans.snapshots import _CHANNEL, _CONF, _DIFF, _E, _OK, _PARENT, _UP, _entries, _pairs, _series, _with_reasons
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


# --- places, views, pages -----------------------------------------------------------------------------------------

_FORMAT = "case when kind = 'audio_transcript_segment' then 'M4A' when kind like 'pdf%' then 'PDF' when kind like 'docx%' then 'DOCX' when kind = 'HEADING' then 'EPUB' when kind = 'TABLE' then 'XLSX' end"
_S = "printf('%.3fs', {0} / 1000.0)"


@query(f"""with i as (select document_key, item_index, kind, location l, node_id, {_FORMAT} f from (select * from document_items qualify row_number() over (partition by document_key, item_index order by recorded_at desc) = 1)),
 p as (select *, case f when 'PDF' then concat_ws(', ', 'page ' || l.page, 'block ' || l.block) when 'DOCX' then concat_ws(', ', 'section ' || l.section, 'block ' || l.block)
  when 'EPUB' then concat_ws(', ', 'section ' || l.section, case when l.section is not null and l.section_title <> '' then 'heading "' || l.section_title || '"' end, 'item ' || l.ordinal)
  when 'M4A' then concat_ws(', ', {_S.format("l.start_ms")}, 'to ' || {_S.format("l.end_ms")}) when 'XLSX' then '' else concat_ws(', ', 'item ' || l.ordinal) end label,
  case f when 'PDF' then concat_ws('/', 'page:' || l.page, 'block:' || l.block) when 'DOCX' then concat_ws('/', 'section:' || l.section, 'block:' || l.block) when 'EPUB' then concat_ws('/', 'section:' || l.section, 'item:' || l.ordinal)
  when 'M4A' then concat_ws('/', 'start_ms:' || l.start_ms, 'end_ms:' || l.end_ms) when 'XLSX' then '' else concat_ws('/', 'item:' || l.ordinal) end place from i)
 select document_key, item_index, case f when 'PDF' then case when l.page is null then 'DOCUMENT_ITEM' else 'PDF_PAGE' end when 'DOCX' then 'WORD_BLOCK' when 'EPUB' then 'EPUB_SECTION_ITEM' when 'M4A' then 'AUDIO_TIME_RANGE' when 'XLSX' then 'WORKBOOK_SHEET' else 'DOCUMENT_ITEM' end place_kind,
  case when label = '' then coalesce(node_id, kind) else label end as label, case when place = '' then coalesce(node_id, kind) else place end locator from p""")
def fn_13_native_locations(spark: SparkSession, d: str) -> DataFrame:
    """Where each item is, in the terms of the format its kind comes from."""
    rows = table(spark, d, "document_items")
    one = latest(rows, ["document_key", "item_index"], ["kind", "location", "node_id"])
    kind, label, locator = context.native_location(F.expr(_FORMAT), F.col("location"), rows.schema["location"].dataType, F.coalesce("node_id", "kind"))
    return one.select("document_key", "item_index", kind.alias("place_kind"), label.alias("label"), locator.alias("locator"))


@query("""with i as (select document_key, coalesce(role, case when contains(lower(kind), 'heading') then 'HEADING' when contains(lower(kind), 'table_cell') then 'TABLE_CELL' when contains(lower(kind), 'table') then 'TABLE' when regexp_matches(lower(kind), 'chart|image|picture') then 'FIGURE'
 when contains(lower(kind), 'sheet') then 'SHEET' when contains(lower(kind), 'slide') then 'SLIDE' when regexp_matches(lower(kind), '(_document|_workbook|_presentation)$') then 'DOCUMENT' else 'PARAGRAPH' end) as role from (select * from document_items qualify row_number() over (partition by document_key, item_index order by recorded_at desc) = 1))
 select document_key, 'READ' as view, count(*) items from i group by 1 union all select document_key, 'TABLES', count(*) from i where role in ('TABLE', 'TABLE_CELL') group by 1 union all select document_key, 'FORMULAS', count(*) from i where role = 'FORMULA' group by 1
 union all select document_key, 'STRUCTURE', count(*) from i where role in ('DOCUMENT', 'SECTION', 'HEADING', 'TABLE', 'FIGURE', 'SHEET', 'SLIDE', 'METADATA') group by 1""")
def fil_13_views(spark: SparkSession, d: str) -> DataFrame:
    one = latest(table(spark, d, "document_items"), ["document_key", "item_index"], ["kind", "role"])
    return one.select("document_key", F.explode(context.in_views(role_of(F.col("kind"), F.col("role"), wide=True))).alias("view")).groupBy("document_key", "view").agg(F.count(F.lit(1)).alias("items"))


@query(f"""with {_I}, r as (select doc, i, '{{"i":' || i || ',"text":' || to_json(text)::varchar || '}}' j from it where text is not null and regexp_full_match(text, '[ -~]*') and not contains(text, '/')), p as (select *, row_number() over (partition by doc order by i) rank from r qualify rank <= 64),
 s as (select doc, list(b order by rank) s from (select doc, rank, sum(strlen(j) + 1) over (partition by doc order by rank) + 1 b from p) group by 1),
 n as (select doc, list_filter([len(s), len(s) // 2, len(s) // 4, len(s) // 8, len(s) // 16, len(s) // 32, len(s) // 64, 0], lambda n: n = 0 or s[n] <= 2000)[1] shown from s) select p.doc, p.i, p.rank, n.shown from p join n using (doc) where p.rank <= n.shown""")
def top_9_fitted_page(spark: SparkSession, d: str) -> DataFrame:
    """The first 64 items of each document as a page of at most 2,000 bytes, halved until it fits. Texts whose JSON both engines write alike."""
    rows = _items(spark, d).where(F.col("text").rlike(r"^[ -~]*\z") & ~F.contains("text", F.lit("/"))).select("doc", "i", F.to_json(F.struct("i", "text")).alias("j"))
    return context.fitted_page(rows, ["doc"], [F.col("i")], "j", 64, 2000).select("doc", "i", "rank", "shown")


@query("""with p as (select doc_id, unnest(string_split(text, chr(10))) t, unnest(range(len(string_split(text, chr(10))))) line from documents where text is not null),
 h as (select doc_id, line::int line, length(regexp_extract(t, '^(#{1,6}) +([^\\s].*)$', 1))::int as level, regexp_replace(trim(regexp_extract(t, '^(#{1,6}) +([^\\s].*)$', 2)), 'data:[a-z/+\\-]+;base64,[A-Za-z0-9+/=]+', '', 'g') title from p where regexp_matches(t, '^(#{1,6}) +[^\\s].*$'))
 select h.*, (select max(k.line) from h k where k.doc_id = h.doc_id and k.line < h.line and k.level < h.level) as parent from h""")
def src_16_markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return context.markdown_blocks(table(spark, d, "documents"), "doc_id", "text")


@query(f"""with {_I}, k as (select doc, page, kind, string_agg(coalesce(text, ''), chr(10) order by i) as text from it where page is not null and kind in ('pdf_page_block', 'pdf_ocr_page_block') group by 1, 2, 3),
 p as (select doc, page, max(text) filter (kind = 'pdf_page_block') n, max(text) filter (kind <> 'pdf_page_block') o from k group by 1, 2)
 select doc, page, case when coalesce(length(trim(n)), 0) < 32 and coalesce(length(trim(o)), 0) > coalesce(length(trim(n)), 0) then o else coalesce(n, '') end as text, case when coalesce(length(trim(n)), 0) < 32 and coalesce(length(trim(o)), 0) > coalesce(length(trim(n)), 0) then 'OCR' else 'NATIVE' end as source from p""")
def itm_6_page_texts(spark: SparkSession, d: str) -> DataFrame:
    return context.page_texts(_items(spark, d), "pdf_page_block", "pdf_ocr_page_block", 32)


@query("""with i as (select document_key, item_index, location.start_ms a, location.end_ms b, json_extract(extension, '$.avg_logprob')::double p from (select * from document_items where kind = 'audio_transcript_segment' qualify row_number() over (partition by document_key, item_index order by recorded_at desc) = 1)),
 n as (select document_key, max(b) n from i group by 1), c as (select i.*, n.n, case when a is not null and b is not null then greatest(0, least(a, n - 1)) end s from i join n using (document_key))
 select document_key, item_index, case when a is null or b is null then 'audio_unaligned_word' when p > -0.3 then 'audio_aligned_word' else 'audio_approximate_word' end word_kind, s start_ms, case when s is not null then greatest(s + 1, least(b, n)) end end_ms from c""")
def itm_5_word_classes(spark: SparkSession, d: str) -> DataFrame:
    """Segments stand for words, clamped to their recording (FN-16); a good score stands for a forced alignment."""
    rows = table(spark, d, "document_items").where("kind = 'audio_transcript_segment'")
    one = latest(rows, ["document_key", "item_index"], ["location", "extension"])
    n = one.groupBy("document_key").agg(F.max("location.end_ms").alias("n"))
    a, b = F.col("location.start_ms"), F.col("location.end_ms")
    status = F.when(F.get_json_object("extension", "$.avg_logprob").cast("double") > -0.3, "CTC_FORCED_ALIGNED")
    s, e = context.bounded_range(a, b, F.col("n"))
    return one.join(n, "document_key").select("document_key", "item_index", context.word_class(a, b, status).alias("word_kind"), s.alias("start_ms"), e.alias("end_ms"))


@query("""select event_id, round(0.55 * greatest(0.0, 1.0 - abs(value - 127.5) / 127.5) + 0.45 * least(1.0, (event_id % 700) / 500.0) - 0.60 * least(1.0, (event_id % 10) / 20.0 + (user_id % 10) / 10.0), 6)::double score from events""")
def fn_10_frame_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", context.frame_score(F.col("value"), (F.col("event_id") % 700).cast("double"), F.col("event_id") % 10 / 20.0, F.col("user_id") % 10 / 10.0).alias("score"))


@query(f"""with {_T} select event_id, unnest(list_distinct([start_ms + (end_ms - start_ms) // 4, start_ms + (end_ms - start_ms) // 2, start_ms + 3 * (end_ms - start_ms) // 4])) at_ms from tl where end_ms > start_ms and start_ms >= 0""")
def top_13_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d).select("event_id", F.explode(context.quartile_times(F.col("start_ms"), F.col("end_ms"))).alias("at_ms"))


# --- scopes, chosen snapshots, areas -------------------------------------------------------------------------------


@query(f"""with {_SERIES} select distinct scope_id from series where starts_with(scope_id, 'managed') order by 1""")
def src_3_chosen_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Scopes without a request: those enabled (with a counted snapshot) and managed."""
    declared = table(spark, d, "snapshots").select(F.get("scope_ids", F.lit(0)).alias("scope_id")).where("scope_id is not null").distinct()
    counted = _series(spark, d).select("scope_id", F.lit(True).alias("there")).distinct()
    rows = declared.join(counted, "scope_id", "left").select("scope_id", F.coalesce("there", F.lit(False)).alias("enabled"), F.col("scope_id").startswith("managed").alias("managed"))
    return context.chosen_scopes(rows)


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = latest(table(spark, d, "snapshots").select(uuid_key(F.col("snapshot_id")).alias("snapshot_id"), instant(F.col("created_at")).alias("created"), "recorded_at"), ["snapshot_id"], ["created"])
    c = _series(spark, d).select("snapshot_id", "scope_id").join(s, "snapshot_id")
    policies = F.explode(F.array(*[F.lit(p) for p in ("EXACT_ID", "TASK_CREATED", "ONLY_COMPATIBLE", "LATEST_VALID", "PREVIOUS_VALID")])).alias("policy")
    return c, c.select(F.col("snapshot_id").alias("named"), "scope_id", policies).withColumn("request", F.concat_ws(" ", "policy", "named"))


@query(f"""with {_SERIES}, c as (select series.snapshot_id, series.scope_id, x.created_at::timestamptz created from series join (select {_UUID.format('snapshot_id')} snapshot_id, created_at from (select * from snapshots {_LATEST.format('lower(trim(snapshot_id))')})) x using (snapshot_id)),
 k as (select scope_id, created, count(*) n, min(snapshot_id) id from c group by 1, 2), q as (select c.*, p.policy from c, (select unnest(['EXACT_ID', 'TASK_CREATED', 'ONLY_COMPATIBLE', 'LATEST_VALID', 'PREVIOUS_VALID']) policy) p),
 r as (select q.policy || ' ' || q.snapshot_id request, q.policy, case when q.policy in ('EXACT_ID', 'TASK_CREATED') then {{'n': 1, 'id': q.snapshot_id}} when q.policy = 'ONLY_COMPATIBLE' then (select {{'n': count(*), 'id': min(z.snapshot_id)}} from c z where z.scope_id = q.scope_id)
  when q.policy = 'LATEST_VALID' then (select arg_max({{'n': k.n, 'id': k.id}}, k.created) from k where k.scope_id = q.scope_id) else (select arg_max({{'n': k.n, 'id': k.id}}, k.created) from k where k.scope_id = q.scope_id and k.created < q.created) end x from q)
 select request, policy, case when x.n = 1 then x.id end snapshot_id, case when x is null or x.n is null then 'NOT_FOUND' when x.n > 1 then 'AMBIGUOUS' else 'RESOLVED' end outcome from r""")
def fil_15_policies(spark: SparkSession, d: str) -> DataFrame:
    """Every counted snapshot named under each policy."""
    return context.resolved_snapshots(*_asked(spark, d))


@query(f"""with {_E}, l as (select unnest(['notes', 'depot/budget', 'conflicts/segment/old']) target) select target, count(*) filter (relative_path = target or starts_with(relative_path, target || '/')) inside, count(*) filter (target <> relative_path and (starts_with(target, relative_path || '/') or relative_path = '.')) above from e, l group by 1""")
def fil_6_containment(spark: SparkSession, d: str) -> DataFrame:
    """Paths that a target contains, and those that contain it: both ways by ancestors, not by comparing every pair."""
    targets = spark.createDataFrame([("notes",), ("depot/budget",), ("conflicts/segment/old",)], "target string")
    e = _entries(spark, d).select("entry_id", "relative_path")
    inside = e.select(F.explode(ancestors_or_self(F.col("relative_path"))).alias("target")).join(targets, "target").select("target", F.lit(1).alias("i"), F.lit(0).alias("a"))
    above = e.join(targets.select("target", F.explode(strict_ancestors(F.col("target"))).alias("relative_path")), "relative_path").select("target", F.lit(0).alias("i"), F.lit(1).alias("a"))
    return targets.join(inside.unionByName(above), "target", "left").groupBy("target").agg(F.coalesce(F.sum("i"), F.lit(0)).alias("inside"), F.coalesce(F.sum("a"), F.lit(0)).alias("above"))


# --- packets and projections -----------------------------------------------------------------------------------------

_SECTION = "select snapshot_id, '{n}' as section, count(*) filter (r <= {k})::bigint shown, count(*) filter (r > {k})::bigint omitted, string_agg(c, chr(10) order by r) filter (r <= {k}) as content from {t} group by 1"
_PACKET = f"""a as (select *, row_number() over (partition by snapshot_id order by {_CHANNEL}, scope_id, relative_path) r, scope_id || ' ' || relative_path c from e), chosen as (select * from a where r <= 12),
 hh as (select snapshot_id, scope_id, unnest({_UP.format(_PARENT.format("relative_path"))}) path from chosen), h1 as (select snapshot_id, scope_id, path, count(*) n from hh group by 1, 2, 3), h as (select *, row_number() over (partition by snapshot_id order by n desc, scope_id, path) r, scope_id || ' ' || path || ' ' || n c from h1),
 o1 as (select snapshot_id, upper(observation_status) || ' ' || coalesce(p_status, '') kind, count(*) n from e group by 1, 2), o as (select *, row_number() over (partition by snapshot_id order by n desc, kind) r, kind || ' ' || n c from o1)"""


@query(f"""with {_E}, {_PACKET} {_SECTION.format(n="EXPLICIT_ENTRY_ANCHORS", k=8, t="chosen")} union all {_SECTION.format(n="HIERARCHY_ITEMS", k=6, t="h")} union all {_SECTION.format(n="OVERLAYS", k=3, t="o")}""")
def prj_7_context_packet(spark: SparkSession, d: str) -> DataFrame:
    """A bounded packet for each snapshot: explicit entries, the directories above them, overlays of states; what a bound leaves out is counted."""
    e = _entries(spark, d)
    rows = _with_reasons(e).select("snapshot_id", "scope_id", "relative_path", "channel")
    chosen = selection.fair_selection(rows, "snapshot_id", "scope_id", "channel", ["relative_path"], 12, 0)
    above = chosen.select("snapshot_id", "scope_id", F.explode(strict_ancestors(F.col("relative_path"))).alias("path")).groupBy("snapshot_id", "scope_id", "path").agg(F.count(F.lit(1)).alias("n"))
    kind = F.concat(F.upper("observation_status"), F.lit(" "), F.coalesce("p_status", F.lit("")))
    states = e.groupBy("snapshot_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    section = lambda x, order, content, name, k: context.packet_section(x, "snapshot_id", order, F.concat_ws(" ", *content), name, k)
    return (
        section(chosen.drop("rank"), [F.col("channel"), F.col("scope_id"), F.col("relative_path")], ["scope_id", "relative_path"], "EXPLICIT_ENTRY_ANCHORS", 8)
        .unionByName(section(above, [F.desc("n"), F.col("scope_id"), F.col("path")], ["scope_id", "path", "n"], "HIERARCHY_ITEMS", 6)).unionByName(section(states, [F.desc("n"), F.col("kind")], ["kind", "n"], "OVERLAYS", 3))
    )


@query(f"""with {_E}, {_PACKET}, s as (select snapshot_id, count(*) source, sum(case when object_type = 'regular_file' then coalesce(size_bytes, 0) else 0 end)::bigint bytes, count(*) filter (observation_status <> 'observed') failed, count(*) filter ({_OK}) analysable, count(*) filter (object_type = 'regular_file') regular from e group by 1),
 x as (select snapshot_id, count(*) explicit_entries, string_agg(c, chr(10) order by r) anchors from chosen group by 1), y as (select snapshot_id, count(*) hierarchy_items from h group by 1)
 select s.snapshot_id, source source_entries, explicit_entries, source - explicit_entries folded_entries, bytes source_bytes, hierarchy_items, analysable, regular - analysable unknown_payloads, case when failed > 0 then 'PARTIAL' else 'COMPLETE' end state,
 sha256(concat_ws('|', s.snapshot_id, source, explicit_entries, hierarchy_items, anchors)) projection_digest from s join x using (snapshot_id) join y using (snapshot_id)""")
def prj_1_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    """The diagnostic projection of each snapshot: selected entries, the hierarchy above them, duplicate coverage, accounts and a digest that binds them."""
    e = _entries(spark, d)
    rows = _with_reasons(e).select("snapshot_id", "scope_id", "relative_path", "channel")
    chosen = selection.fair_selection(rows, "snapshot_id", "scope_id", "channel", ["relative_path"], 12, 0)
    entry = F.struct("channel", "scope_id", "relative_path", F.concat_ws(" ", "scope_id", "relative_path").alias("c"))
    x = chosen.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("explicit_entries"), F.array_join(F.array_sort(F.collect_list(entry)).c, "\n").alias("anchors"))  # twelve at most
    y = chosen.select("snapshot_id", "scope_id", F.explode(strict_ancestors(F.col("relative_path"))).alias("path")).distinct().groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("hierarchy_items"))
    s = e.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("source_entries"), F.coalesce(F.sum(F.when(F.col("object_type") == "regular_file", F.col("size_bytes"))), F.lit(0)).alias("source_bytes"), F.count_if(F.col("observation_status") != "observed").alias("failed")
    )
    z = duplicates.duplicate_coverage(e).select("snapshot_id", "analysable", F.col("unknown").alias("unknown_payloads"))
    j = s.join(x, "snapshot_id").join(y, "snapshot_id").join(z, "snapshot_id", "left")
    digest = F.sha2(F.concat_ws("|", "snapshot_id", "source_entries", "explicit_entries", "hierarchy_items", "anchors"), 256)
    return j.select(
        "snapshot_id", "source_entries", "explicit_entries", (F.col("source_entries") - F.col("explicit_entries")).alias("folded_entries"), "source_bytes", "hierarchy_items", F.coalesce("analysable", F.lit(0)).alias("analysable"),
        F.coalesce("unknown_payloads", F.lit(0)).alias("unknown_payloads"), F.when(F.col("failed") > 0, "PARTIAL").otherwise("COMPLETE").alias("state"), digest.alias("projection_digest"),
    )


_PAGES = """g as (select snapshot_id as key, 'GENERAL' profile, row_number() over (partition by snapshot_id order by scope_id, relative_path) rank, scope_id || ' ' || relative_path as content from e),
 c as (select pair as key, 'CHANGE_TRIAGE' profile, row_number() over (partition by pair order by case change_type when 'REMOVED' then 0 when 'MODIFIED' then 1 else 2 end, scope_id, relative_path) rank, change_type || ' ' || scope_id || ' ' || relative_path as content from d where change_type <> 'UNCHANGED'),
 u as (select *, count(*) over (partition by key, profile) n from (select * from g union all select * from c))"""


@query(f"""with {_E}, {_DIFF}, {_PAGES} select key, profile, rank, content, case when n > 20 then left(sha256(concat_ws('|', key, profile, '20', n)), 32) else '' end continuation from u where rank <= 20""")
def prj_3_context_pages(spark: SparkSession, d: str) -> DataFrame:
    """First pages of the profiles GENERAL and CHANGE_TRIAGE (``prj_3_context_overview`` is the third), with a continuation bound to what it goes on with."""
    general = _entries(spark, d).select(F.col("snapshot_id").alias("key"), F.lit("GENERAL").alias("profile"), F.lit(0).alias("first"), "scope_id", "relative_path", F.concat_ws(" ", "scope_id", "relative_path").alias("content"))
    first = F.when(F.col("change_type") == "REMOVED", 0).when(F.col("change_type") == "MODIFIED", 1).otherwise(2)
    changes = diff.snapshot_diff(*_pairs(spark, d)).where("change_type <> 'UNCHANGED'").select(
        F.col("pair").alias("key"), F.lit("CHANGE_TRIAGE").alias("profile"), first.alias("first"), "scope_id", "relative_path", F.concat_ws(" ", "change_type", "scope_id", "relative_path").alias("content")
    )
    rows = general.unionByName(changes)
    n = rows.groupBy("key", "profile").agg(F.count(F.lit(1)).alias("n"))
    page = selection.top_per(rows, ["key", "profile"], [F.col("first"), F.col("scope_id"), F.col("relative_path")], 20).join(n, ["key", "profile"])
    token = F.when(F.col("n") > 20, F.left(F.sha2(F.concat_ws("|", "key", "profile", F.lit("20"), "n"), 256), F.lit(32))).otherwise("")
    return page.select("key", "profile", "rank", "content", token.alias("continuation"))


# --- reuse, replay, duplicates ---------------------------------------------------------------------------------------

_SAME = " and ".join(f"y.{c} is not distinct from r.{c}" for c in ("device_id", "inode", "size_bytes", "mtime_ns", "ctime_ns", "birthtime_ns"))


@query(f"""with {_E}, heads as (select {_UUID.format('snapshot_id')} id, status, deleted_at, snapshot_schema_version v, started_at::timestamptz started, completed_at::timestamptz completed from (select * from snapshots {_LATEST.format('lower(trim(snapshot_id))')})),
 every as (select x.* replace ({_UUID.format('x.snapshot_id')} as snapshot_id), x.payload_observation p from (select * from snapshot_entries {_LATEST.format('entry_id')}) x), r as (select e.*, {_UUID.format('e.p_reused')} src, h.started from e join heads h on h.id = e.snapshot_id where p_provenance = 'REUSED_FROM_VERIFIED_SNAPSHOT'),
 c as (select r.entry_id, case when h.id is null then 'PAYLOAD_REUSE_SOURCE_MISSING' when h.v <> 2 then 'PAYLOAD_REUSE_SOURCE_SCHEMA_UNSUPPORTED' when h.status <> 'complete' or h.deleted_at is not null then 'PAYLOAD_REUSE_SOURCE_INVALID' when h.completed > r.started then 'PAYLOAD_REUSE_SOURCE_NOT_EARLIER'
  when y.entry_id is null then 'PAYLOAD_REUSE_SOURCE_ENTRY_MISSING' when not coalesce(y.object_type = 'regular_file' and not y.excluded and y.p.provenance = 'DIRECT_READ' and y.p.status in ('HASHED', 'EMPTY_FILE_HASHED') and {_SAME}, false) then 'PAYLOAD_REUSE_SOURCE_METADATA_MISMATCH'
  when y.p.status is distinct from r.p_status or y.p.algorithm is distinct from r.p_algorithm or y.p.algorithm_version is distinct from r.p_algorithm_version or y.p.bytes_hashed is distinct from r.p_bytes_hashed then 'PAYLOAD_REUSE_SOURCE_PAYLOAD_INVALID' when y.p.digest is distinct from r.p_digest then 'PAYLOAD_REUSE_SOURCE_DIGEST_MISMATCH' end code
  from r left join heads h on h.id = r.src left join every y on y.snapshot_id = r.src and y.scope_id = r.scope_id and y.relative_path = r.relative_path) select entry_id, code from c where code is not null""")
def src_7_reuse_references(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose reused digest can't be vouched for, with the first of eight reasons."""
    from strataframe.operators.entries import counted_entries

    h = table(spark, d, "snapshots").select(
        uuid_key(F.col("snapshot_id")).alias("src"), F.lower("status").alias("status"), "deleted_at", "snapshot_schema_version", instant(F.col("started_at")).alias("started"), instant(F.col("completed_at")).alias("completed"), "recorded_at"
    )
    heads = latest(h, ["src"], ["status", "deleted_at", "snapshot_schema_version", "started", "completed"]).where("src is not null")
    all_entries = counted_entries(table(spark, d, "snapshot_entries"))
    match = ["device_id", "inode", "size_bytes", "mtime_ns", "ctime_ns", "birthtime_ns"]
    payload = ["p_status", "p_algorithm", "p_algorithm_version", "p_bytes_hashed", "p_digest"]
    own = all_entries.where("p_provenance = 'REUSED_FROM_VERIFIED_SNAPSHOT'").join(_series(spark, d).select("snapshot_id"), "snapshot_id", "left_semi")
    own = own.join(heads.select(F.col("src").alias("snapshot_id"), F.col("started").alias("own_started")), "snapshot_id")
    own = own.select("entry_id", uuid_key(F.col("p_reused_from_snapshot_id")).alias("src"), "scope_id", "relative_path", "own_started", *match, *payload)
    direct = F.coalesce((F.col("object_type") == "regular_file") & ~F.col("excluded") & (F.col("p_provenance") == "DIRECT_READ") & F.col("p_status").isin("HASHED", "EMPTY_FILE_HASHED"), F.lit(False))
    there = all_entries.select(F.col("snapshot_id").alias("src"), "scope_id", "relative_path", direct.alias("direct"), *[F.col(c).alias(f"s_{c}") for c in match + payload])
    j = own.join(heads, "src", "left").join(there, ["src", "scope_id", "relative_path"], "left")
    same = lambda cs: F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in cs]), lambda x: x)
    code = (
        F.when(F.col("status").isNull(), "MISSING").when(F.col("snapshot_schema_version") != 2, "SCHEMA_UNSUPPORTED").when((F.col("status") != "complete") | F.col("deleted_at").isNotNull(), "INVALID")
        .when(F.col("completed") > F.col("own_started"), "NOT_EARLIER").when(F.col("direct").isNull(), "ENTRY_MISSING").when(~(F.col("direct") & same(match)), "METADATA_MISMATCH")
        .when(~same(payload[:-1]), "PAYLOAD_INVALID").when(~same(payload[-1:]), "DIGEST_MISMATCH")
    )
    return j.select("entry_id", F.concat(F.lit("PAYLOAD_REUSE_SOURCE_"), code).alias("code")).where("code is not null")


_COUNTS = ["runs", "evidence", "snapshots", "entries", "eligible_snapshots", "eligible_entries", "ineligible_snapshots", "ineligible_entries", "other_runs", "other_evidence"]


@query(f"""with {_RUNS}, {_HEAD}, seq as (select {_UUID.format('run_id')} run_id, arg_max(last_sequence, recorded_at)::bigint n from runs group by 1), ent as (select {_UUID.format('snapshot_id')} snapshot_id, count(distinct lower(trim(entry_id))) n from snapshot_entries group by 1),
 x as (select head.snapshot_id, head.run_id, coalesce(ent.n, 0) n, case when run.run_id is null or head.deleted_at is not null then null when run.run_kind = 'filesystem.snapshot' and head.status = 'complete' and run.status = 'verified' then 'ELIGIBLE' when head.status = 'partial' and run.status = 'scanning' then 'INELIGIBLE' end k
  from head left join run using (run_id) left join ent using (snapshot_id)), o as (select * from seq where run_id not in (select run_id from x where run_id is not null)),
 c as (select (select count(*) from seq) runs, (select sum(n)::bigint from seq) evidence, (select count(*) from x) snapshots, (select sum(n)::bigint from x) entries, (select count(*) from x where k = 'ELIGIBLE') eligible_snapshots, (select coalesce(sum(n), 0)::bigint from x where k = 'ELIGIBLE') eligible_entries,
  (select count(*) from x where k = 'INELIGIBLE') ineligible_snapshots, (select coalesce(sum(n), 0)::bigint from x where k = 'INELIGIBLE') ineligible_entries, (select count(*) from o) other_runs, (select coalesce(sum(n), 0)::bigint from o) other_evidence)
 select *, sha256(concat_ws(',', {", ".join(_COUNTS)})) accounting_digest from c""")
def agg_16_replay_plan(spark: SparkSession, d: str) -> DataFrame:
    """Ten counts of what a replay takes in, leaves out and doesn't concern, and their digest."""
    entries = table(spark, d, "snapshot_entries").select(uuid_key(F.col("snapshot_id")).alias("snapshot_id"), F.lower(F.trim("entry_id")).alias("e")).groupBy("snapshot_id").agg(F.count_distinct("e").alias("n"))
    raw = table(spark, d, "runs").select(uuid_key(F.col("run_id")).alias("run_id"), "last_sequence", "recorded_at")
    seq = latest(raw, ["run_id"], ["last_sequence"])
    runs = _runs(spark, d).select("run_id", "run_kind", F.col("status").alias("run_status"))
    x = _headers(spark, d).join(runs, "run_id", "left").join(entries, "snapshot_id", "left")
    k = (
        F.when(F.col("run_kind").isNull() | F.col("deleted_at").isNotNull(), None).when((F.col("run_kind") == "filesystem.snapshot") & (F.col("status") == "complete") & (F.col("run_status") == "verified"), "ELIGIBLE")
        .when((F.col("status") == "partial") & (F.col("run_status") == "scanning"), "INELIGIBLE")
    )
    x = x.select("run_id", F.coalesce("n", F.lit(0)).alias("n"), k.alias("k"))
    other = seq.join(x.select("run_id").where("run_id is not null").distinct(), "run_id", "left_anti")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    of = lambda v: F.when(F.col("k") == v, F.col("n"))
    parts = [
        seq.agg(F.count(F.lit(1)).alias("runs"), total("last_sequence").alias("evidence")), other.agg(F.count(F.lit(1)).alias("other_runs"), total("last_sequence").alias("other_evidence")),
        x.agg(F.count(F.lit(1)).alias("snapshots"), total("n").alias("entries"), *[c for v in ("ELIGIBLE", "INELIGIBLE") for c in (F.count(of(v)).alias(f"{v.lower()}_snapshots"), total(of(v)).alias(f"{v.lower()}_entries"))]),
    ]
    rows = None
    for p in parts:  # one row each
        r = p.select(*[F.col(c) if c in p.columns else F.lit(None).cast("bigint").alias(c) for c in _COUNTS])
        rows = r if rows is None else rows.unionByName(r)
    one = rows.agg(*[F.max(c).alias(c) for c in _COUNTS])
    return one.withColumn("accounting_digest", F.sha2(F.concat_ws(",", *_COUNTS), 256))


def _across(spark: SparkSession, d: str) -> DataFrame:
    """Entries with their series in place of their snapshot: duplicates across the snapshots of a series."""
    s = _series(spark, d).select("snapshot_id", F.lower(F.hex("series")).alias("series"))
    return _entries(spark, d).join(s, "snapshot_id").drop("snapshot_id").withColumnRenamed("series", "snapshot_id")


_ACROSS = _E.replace("b as (select s.snapshot_id pair", "e0 as (select e.* replace (md5(series.config_digest || chr(0) || series.scope_id) as snapshot_id) from e join series using (snapshot_id)), b as (select s.snapshot_id pair")


@query(f"with {_ACROSS} select snapshot_id as series, device_id, inode, count(*) paths from e0 where object_type = 'regular_file' and observation_status = 'observed' and not excluded and device_id is not null and inode is not null group by 1, 2, 3 having count(*) >= 2")
def joi_7_series_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Objects that the snapshots of a series show more than once."""
    return duplicates.alias_sets(_across(spark, d)).withColumnRenamed("snapshot_id", "series")


_CONF0 = _CONF.replace("(select * from e ", "(select * from e0 ")


@query(f"with {_ACROSS}, {_CONF0} select snapshot_id as series, device_id, inode, code, members from cf")
def agg_9_series_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """What the observations of one object contradict each other in, across a series."""
    return duplicates.hint_conflicts(_across(spark, d)).withColumnRenamed("snapshot_id", "series")


@query(f"""with {_ACROSS}, {_CONF0}, pz as (select snapshot_id, p_digest from e0 where {_OK} group by 1, 2 having min(size_bytes) <> max(size_bytes)),
 u as (select e0.snapshot_id, e0.p_digest, e0.size_bytes, e0.device_id, e0.inode, count(*) n, max((c.code is not null)::int) bad from e0 left join (select distinct snapshot_id, device_id, inode, 'x' code from cf) c using (snapshot_id, device_id, inode)
 where {_OK} and not exists (select 1 from pz where pz.snapshot_id = e0.snapshot_id and pz.p_digest = e0.p_digest) group by 1, 2, 3, 4, 5)
 select snapshot_id as series, p_digest digest, size_bytes as size, sum(n)::bigint members, count(*) filter (device_id is not null and inode is not null and bad = 0) known_units, count(*) filter (device_id is not null and inode is not null and bad = 1) conflicted_units from u group by 1, 2, 3 having sum(n) >= 2""")
def dup_2_series_groups(spark: SparkSession, d: str) -> DataFrame:
    """Contents that recur within a series, with the objects that hold them; objects that contradict themselves count apart (JOI-8)."""
    e = _across(spark, d)
    g = duplicates.payload_groups(e).select("snapshot_id", "digest", "size", "members", "known_units")
    bad = duplicates.hint_conflicts(e).select(*duplicates.HINT).distinct()
    from strataframe.operators.entries import payload_eligible

    held = e.where(payload_eligible()).select(*duplicates.HINT, F.col("p_digest").alias("digest"), F.col("size_bytes").alias("size")).distinct().join(bad, duplicates.HINT)
    n = held.groupBy("snapshot_id", "digest", "size").agg(F.count(F.lit(1)).alias("conflicted_units"))
    return g.join(n, ["snapshot_id", "digest", "size"], "left").select(F.col("snapshot_id").alias("series"), "digest", "size", "members", "known_units", F.coalesce("conflicted_units", F.lit(0)).alias("conflicted_units"))


@query(f"""with r as (select {_UUID.format('snapshot_id')} snapshot_id, {_UUID.format('run_id')} run_id, evidence_id, snapshot_digest from snapshots)
 select 'SNAPSHOT_ID_DUPLICATE' code, snapshot_id as key, count(*) records from r where snapshot_id is not null group by 2 having count(*) > 1 union all select 'SNAPSHOT_RUN_DUPLICATE', run_id, count(*) from r where nullif(run_id, '') is not null group by 2 having count(*) > 1
 union all select 'SNAPSHOT_EVIDENCE_ID_CONFLICT', evidence_id, count(*) from r where nullif(evidence_id, '') is not null group by 2 having count(*) > 1 union all select 'SNAPSHOT_EVIDENCE_CONTENT_CONFLICT', evidence_id, count(*) from r where nullif(evidence_id, '') is not null group by 2 having count(distinct snapshot_digest) > 1""")
def mnt_1_delivered_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Keys that several delivered headers have, of all kinds, and evidence whose deliveries differ in content."""
    r = table(spark, d, "snapshots").select(uuid_key(F.col("snapshot_id")).alias("snapshot_id"), uuid_key(F.col("run_id")).alias("run_id"), F.nullif("evidence_id", F.lit("")).alias("evidence_id"), F.col("snapshot_digest").alias("content"))
    from strataframe.operators.ledger import duplicates_of

    found = None
    for key, code in (("snapshot_id", "SNAPSHOT_ID_DUPLICATE"), ("run_id", "SNAPSHOT_RUN_DUPLICATE"), ("evidence_id", "SNAPSHOT_EVIDENCE_ID_CONFLICT")):
        rows = duplicates_of(r, key, code).withColumnRenamed(key, "key")
        found = rows if found is None else found.unionByName(rows)
    differ = found.where("code = 'SNAPSHOT_EVIDENCE_ID_CONFLICT' and contents > 1").withColumn("code", F.lit("SNAPSHOT_EVIDENCE_CONTENT_CONFLICT"))
    return found.unionByName(differ).select("code", "key", "records")
