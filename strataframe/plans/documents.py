"""Queries over document items, matches and documents: search, sections, slices, quality, sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import text as T
from strataframe.operators import items as I
from strataframe.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _items(spark: SparkSession, d: str) -> DataFrame:
    return I.counted_items(table(spark, d, "document_items"))


_I = """it as (select document_key doc, item_index i, kind, text_or_value as text, nullif(trim(parent), '') parent, trim(node_id) node_id,
 coalesce(role, case when contains(lower(kind), 'heading') or lower(kind) like '%\\_title' escape '\\' then 'HEADING' when contains(lower(kind), 'table_cell') or lower(kind) = 'xlsx_cell' then 'TABLE_CELL' when contains(lower(kind), 'table') then 'TABLE' else 'PARAGRAPH' end) as role,
 case when location.depth >= 0 then location.depth else 1 end as level, location.page page from (select * from document_items qualify row_number() over (partition by document_key, item_index order by recorded_at desc) = 1))"""


@query(f"with {_I} select role, count(*) items, count(text) texts, count(distinct doc) documents from it group by 1")
def fil_13_roles(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("items"), F.count("text").alias("texts"), F.count_distinct("doc").alias("documents"))


@query("""select kind, case when contains(lower(kind), 'heading') then 'HEADING' when contains(lower(kind), 'table_cell') then 'TABLE_CELL' when contains(lower(kind), 'table') then 'TABLE' when regexp_matches(lower(kind), 'chart|image|picture') then 'FIGURE'
 when contains(lower(kind), 'sheet') then 'SHEET' when contains(lower(kind), 'slide') then 'SLIDE' when regexp_matches(lower(kind), '(_document|_workbook|_presentation)$') then 'DOCUMENT' else 'PARAGRAPH' end inferred, count(*) items from document_items group by 1, 2""")
def fil_14_inferred_roles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_items").groupBy("kind", T.role_of(F.col("kind"), wide=True).alias("inferred")).agg(F.count(F.lit(1)).alias("items"))


_H = f"{_I}, h as (select doc, i, least(level, 6) as level from it where role = 'HEADING'), e as (select doc, max(i) + 1 e from it group by 1)"


@query(f"with {_H} select h.doc, h.i heading, h.level, coalesce((select min(k.i) from h k where k.doc = h.doc and k.i > h.i and k.level <= h.level), any_value(e.e)) as until from h join e using (doc) group by h.doc, h.i, h.level")
def win_13_sections(spark: SparkSession, d: str) -> DataFrame:
    return I.sections(_items(spark, d))


@query(f"""with {_H}, p as (select it.doc, it.i, h.i hi, h.level from it join h on h.doc = it.doc and h.i < it.i), q as (select *, min(level) over (partition by doc, i order by hi desc rows between unbounded preceding and 1 preceding) lower_later from p)
 select it.doc, it.i, coalesce(string_agg(q.hi::varchar, ',' order by q.hi), '') trail from it left join q on q.doc = it.doc and q.i = it.i and (q.lower_later is null or q.level < q.lower_later and q.lower_later > 1) group by 1, 2""")
def win_12_heading_trails(spark: SparkSession, d: str) -> DataFrame:
    return I.heading_trails(_items(spark, d)).select("doc", "i", F.array_join("trail", ",").alias("trail"))


@query(f"""with {_I} select doc, i, (count(*) filter (role = 'HEADING' and coalesce(text, '') <> '') over w)::int section, last_value(case when role = 'HEADING' and coalesce(text, '') <> '' then left(text, 256) end ignore nulls) over w section_title from it
 window w as (partition by doc order by i rows unbounded preceding)""")
def win_16_titled(spark: SparkSession, d: str) -> DataFrame:
    return I.titled(_items(spark, d))


@query()
def win_14_context(spark: SparkSession, d: str) -> DataFrame:
    """Items around each heading; checked against a plain loop in the tests."""
    rows = _items(spark, d)
    return I.context_window(rows, rows.where("role = 'HEADING'").select("doc", "i"), 2)


@query(f"""with {_I}, p as (select doc, page, sum(length(coalesce(text, '')))::bigint chars, sum(length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')))::bigint alnum from it group by 1, 2),
 q as (select doc, sum(chars)::bigint chars, sum(alnum)::bigint alnum, count(page) pages, count(*) filter (page is not null and alnum < 4) empty_pages from p group by 1)
 select *, concat_ws(',', case when alnum = 0 then 'NO_TEXT' end, case when empty_pages > 0 then 'EMPTY_PAGES' end, case when alnum * 2 < chars then 'FEW_LETTERS' end) reasons from q""")
def agg_19_quality(spark: SparkSession, d: str) -> DataFrame:
    return I.quality(_items(spark, d))


@query("""with m as (select document_key, location.page page, count(*) matches, sum(match_count)::bigint occurrences from content_matches group by 1, 2), s as (select document_key, min(page) p0, max(page) p1 from m where page is not null group by 1)
 select m.document_key, m.page, m.matches, m.occurrences, m.page <= case when p1 - p0 < 8 then p1 else p0 + 7 end targeted from m join s using (document_key)""")
def agg_20_container_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches per page, and whether the page is among the at most eight that are looked at."""
    m = table(spark, d, "content_matches").groupBy("document_key", F.col("location.page").alias("page")).agg(F.count(F.lit(1)).alias("matches"), F.sum("match_count").alias("occurrences"))
    s = m.where("page is not null").groupBy("document_key").agg(F.min("page").alias("p0"), F.max("page").alias("p1"))
    last = F.when(F.col("p1") - F.col("p0") < 8, F.col("p1")).otherwise(F.col("p0") + 7)
    return m.join(s, "document_key").select("document_key", "page", "matches", "occurrences", (F.col("page") <= last).alias("targeted"))


@query("select document_key, query, case count(distinct match_mode) when 0 then 'SUBSTRING_CASEFOLD_NFKC' when 1 then min(match_mode) else 'MIXED_DETERMINISTIC_NORMALIZATION' end as mode, sum(match_count)::bigint occurrences from content_matches group by 1, 2")
def fn_4_packet_mode(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "content_matches").groupBy("document_key", "query").agg(F.collect_set("match_mode").alias("modes"), F.sum("match_count").alias("occurrences"))
    return m.select("document_key", "query", T.packet_mode(F.col("modes")).alias("mode"), "occurrences")


#: A text after each further repair, as far as DuckDB can fold: it knows no compatibility forms.
_REPAIRED = """{0} as (select *, replace(m0, chr(173), '') m1, regexp_replace(replace(m0, chr(173), ''), '([\\p{{L}}\\p{{N}}])[-‐‑][ \\t]*[\\r\\n]+[ \\t]*([\\p{{L}}\\p{{N}}])', '\\1\\2', 'g') m2 from (select *, lower({1}) m0 from {2}))"""
_COUNTED = """case when contains(m0, {q}) then (length(m0) - length(replace(m0, {q}, ''))) // length({q}) when contains(m1, {q}) then (length(m1) - length(replace(m1, {q}, ''))) // length({q})
 when contains(m2, {q}) then (length(m2) - length(replace(m2, {q}, ''))) // length({q}) else (length(m3) - length(replace(m3, {q}, ''))) // length({q}) end"""


@query(f"""with {_REPAIRED.format("r0", "text", "documents where text is not null")}, r as (select *, trim(regexp_replace(m2, '\\s+', ' ', 'g')) m3 from r0), q as (select unnest(['snapshot', 'the index', 'cold store']) q)
 select doc_id, q as query, ({_COUNTED.format(q="q")})::int match_count from r, q where contains(m0, q) or contains(m1, q) or contains(m2, q) or contains(m3, q)""")
def fn_3_document_matches(spark: SparkSession, d: str) -> DataFrame:
    """A stated set of queries against all documents, after all repairs; checked against a plain version in the tests too."""
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text")).withColumn("query", F.explode(F.array(*[F.lit(q) for q in ("snapshot", "the index", "cold store")])))
    return T.located(docs, "text", "query").select("doc_id", "query", "match_count")


@query()
def fn_3_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches of item texts after all repairs, with mode and source span; checked against a plain version in the tests."""
    rows = _items(spark, d).where("text is not null").select("doc", "i", "text", F.explode(F.array(*[F.lit(q) for q in ("the index was rebuilt", "read-only", "retention board")])).alias("query"))
    return rows.withColumn("m", T.match_text("text", "query")).where("m.match_count is not null").select("doc", "i", "query", "m.*")


@query()
def fn_5_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts of all documents that match after all repairs; checked against a plain version in the tests."""
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text")).withColumn("query", F.lit("snapshot"))
    return T.located(docs, "text", "query").select("doc_id", T.excerpt(F.col("text"), F.col("source_start"), F.col("source_end")).alias("excerpt"))


@query("""with p as (select distinct relative_path path, lower(relative_path) p, lower(regexp_extract(relative_path, '[^/]*$')) b from snapshot_entries), r as (select path, case when b = 'index' then 0 when starts_with(b, 'index') then 1 when contains(p, 'index') then 2 end rank from p)
 select path, rank from r where rank is not null""")
def fn_6_path_rank(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "snapshot_entries").select(F.col("relative_path").alias("path")).distinct()
    return p.select("path", T.path_rank(F.col("path"), "index").alias("rank")).where("rank is not null")


@query("""with r as (select relative_path, mtime_ns, case when lower(regexp_extract(relative_path, '[^/]*$')) = 'index' then 0 when starts_with(lower(regexp_extract(relative_path, '[^/]*$')), 'index') then 1 when contains(lower(relative_path), 'index') then 2 end rank,
 row_number() over (partition by relative_path order by mtime_ns desc nulls last) rn from document_identities where relative_path is not null) select relative_path, mtime_ns, rank from r where rank is not null and rn = 1 order by rank, coalesce(mtime_ns, -1) desc, relative_path limit 50""")
def top_11_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "document_identities").where("relative_path is not null").groupBy("relative_path").agg(F.max("mtime_ns").alias("mtime_ns"))
    return p.withColumn("rank", T.path_rank(F.col("relative_path"), "index")).where("rank is not null").orderBy("rank", F.desc(F.coalesce("mtime_ns", F.lit(-1))), "relative_path").limit(50)


@query("""select category, case when regexp_matches(lower(text), 'change|changed|compare|comparison|difference|diff|before|after|变化|变更|差异|比较|对比|更新|新增|删除|演变') then 'CHANGE_TRIAGE' when regexp_matches(lower(text), 'structure|directory|directories|folder|folders|tree|hierarchy|layout|organization|目录|结构|文件夹|层级|树状') then 'STRUCTURE_OVERVIEW' else 'GENERAL' end profile, count(*) items
 from eval_items group by 1, 2""")
def fn_11_profiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").groupBy("category", T.question_profile(F.col("text")).alias("profile")).agg(F.count(F.lit(1)).alias("items"))


@query("select doc_id, 'citation:document:' || left(sha256(text), 32) as citation, left(text, 1024) shown from documents where text is not null")
def fn_14_15_citations(spark: SparkSession, d: str) -> DataFrame:
    from strataframe.functions.canonical import citation

    return table(spark, d, "documents").where("text is not null").select("doc_id", citation("document", F.col("text")).alias("citation"), F.left("text", F.lit(1024)).alias("shown"))


@query("""with c as (select run_id, max_by(metadata_json, recorded_at) m from runs group by 1) select run_id, json_extract_string(m, '$.scope') scope, (json_extract_string(m, '$.try'))::int attempt from c""")
def fn_20_json(spark: SparkSession, d: str) -> DataFrame:
    from strataframe.functions.latest import latest

    r = latest(table(spark, d, "runs"), ["run_id"], ["metadata_json"])
    return r.withColumn("m", F.from_json("metadata_json", "scope string, try int")).select("run_id", F.col("m.scope").alias("scope"), F.col("m.try").alias("attempt"))


@query()
def top_10_slices(spark: SparkSession, d: str) -> DataFrame:
    """The items around each heading packed into a slice of 4,096 characters; checked by invariants in the tests."""
    rows = _items(spark, d)
    near = I.context_window(rows, rows.where("role = 'HEADING'").select("doc", "i"), 2).join(rows.select("doc", "i", "text"), ["doc", "i"]).where("text is not null")
    entry = F.struct(F.when(F.col("i") == F.col("anchor"), 0).otherwise(F.abs(F.col("i") - F.col("anchor"))).alias("p"), F.col("i"), F.col("text"))
    s = near.groupBy("doc", "anchor").agg(F.collect_list(entry).alias("e"))  # at most five items each
    return s.select("doc", "anchor", F.explode(I.packed_slice(F.col("e"), 4096, 2048)).alias("x")).select("doc", "anchor", "x.i", "x.text", "x.cut")


@query(f"""with {_I}, v as (select doc, page, min(i) v from it where role in ('FIGURE', 'FORMULA', 'TABLE') and page is not null group by 1, 2) select it.doc, arg_min(case when it.role = 'CAPTION' and v.v is not null then v.v else it.i end, struct_pack(a := case when it.role in ('FIGURE', 'FORMULA', 'TABLE') then 0 else 1 end, b := it.i)) i
 from it left join v on v.doc = it.doc and v.page = it.page group by 1""")
def itm_1_visual_choice(spark: SparkSession, d: str) -> DataFrame:
    return I.visual_choice(_items(spark, d))


@query("""with s as (select document_key, item_index, query from content_matches) select document_key, item_index, count(distinct query) slices, string_agg(distinct query, ',' order by query) queries from s group by 1, 2""")
def itm_8_shared_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that several slices share appear once, with all slices that show them."""
    return table(spark, d, "content_matches").groupBy("document_key", "item_index").agg(F.count_distinct("query").alias("slices"), F.array_join(F.array_sort(F.collect_set("query")), ",").alias("queries"))


@query("""with d as (select distinct relative_path p from document_identities where relative_path is not null), f as (select p, upper(regexp_extract(lower(p), '[^./]\\.([a-z0-9]+)$', 1)) f from d)
 select f format, case when f in ('PDF', 'PNG', 'JPG', 'JPEG', 'TIF', 'TIFF') then 'PDF_OR_IMAGE' when f in ('DOCX', 'XLSX', 'PPTX', 'EPUB') then 'PACKAGE' else 'OTHER' end as profile, count(*) files from f group by 1, 2""")
def itm_4_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Parser profile by format."""
    p = table(spark, d, "document_identities").where("relative_path is not null").select("relative_path").distinct()
    f = p.select(F.upper(F.regexp_extract(F.lower("relative_path"), r"[^./]\.([a-z0-9]+)$", 1)).alias("format"))
    profile = F.when(F.col("format").isin("PDF", "PNG", "JPG", "JPEG", "TIF", "TIFF"), "PDF_OR_IMAGE").when(F.col("format").isin("DOCX", "XLSX", "PPTX", "EPUB"), "PACKAGE").otherwise("OTHER")
    return f.groupBy("format", profile.alias("profile")).agg(F.count(F.lit(1)).alias("files"))


@query("""select source, count(*) documents, count(*) filter (regexp_matches(text, '^#{1,6} ')) headed, sum(len(regexp_extract_all(text, '(^|\\n)#{1,6} [^\\n]+')))::bigint headings from documents group by 1""")
def src_16_markdown_headings(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(t.rlike("^#{1,6} ")).alias("headed"), F.sum(F.size(F.regexp_extract_all(t, F.lit(r"(?:^|\n)#{1,6} [^\n]+"), F.lit(0)))).alias("headings")
    )


@query("""with w as (select distinct word from (select unnest(string_split(lower(query), ' ')) word from content_matches) where length(word) > 3), x as (select document_key, item_index, unnest(string_split(lower(text_or_value), ' ')) word from document_items where text_or_value is not null)
 select x.document_key, x.item_index, count(*) hits from x semi join w using (word) group by 1, 2""")
def src_20_shared_strings(spark: SparkSession, d: str) -> DataFrame:
    """Match the dictionary of strings first, then only the cells that use a matching one: a left-semi join."""
    words = table(spark, d, "content_matches").select(F.explode(F.split(F.lower("query"), " ")).alias("word")).where("length(word) > 3").distinct()
    cells = table(spark, d, "document_items").where("text_or_value is not null").select("document_key", "item_index", F.explode(F.split(F.lower("text_or_value"), " ")).alias("word"))
    return cells.join(words, "word", "left_semi").groupBy("document_key", "item_index").agg(F.count(F.lit(1)).alias("hits"))


@query(f"""with recursive {_I}, n0 as (select doc, node_id, max(parent) parent, max(role) as role from it where node_id is not null group by 1, 2), n as (select a.doc, a.node_id, p.node_id parent, a.role from n0 a left join n0 p on p.doc = a.doc and p.node_id = a.parent),
 t as (select doc, node_id, role, 0 depth, 0 headings from n where parent is null union all select n.doc, n.node_id, n.role, t.depth + 1, t.headings + (t.role = 'HEADING')::int from n join t on t.doc = n.doc and t.node_id = n.parent)
 select doc, node_id, depth, headings from t""")
def joi_16_parent_trail(spark: SparkSession, d: str) -> DataFrame:
    """Headings above each item by parent links; items on or below a cycle have no trail. The walk is the hierarchy operator's."""
    from strataframe.operators.hierarchy import resolve, tree_nodes

    rows = _items(spark, d).where("node_id is not null")
    one = rows.groupBy("doc", "node_id").agg(F.max("parent").alias("parent"), F.max("role").alias("role")).withColumn("at", F.lit(0))
    solved = resolve(tree_nodes(one, "doc", "node_id", "parent", "at"), paths=True).where("depth >= 0")
    roles = one.where("role = 'HEADING'").select(F.col("doc").alias("tree"), F.col("node_id").alias("ancestor"), F.lit(1).alias("h"))
    up = solved.where("depth > 0").select("tree", "node", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("ancestor")).join(roles, ["tree", "ancestor"])
    counts = up.groupBy("tree", "node").agg(F.sum("h").alias("headings"))
    return solved.join(counts, ["tree", "node"], "left").select(F.col("tree").alias("doc"), F.col("node").alias("node_id"), "depth", F.coalesce("headings", F.lit(0)).cast("int").alias("headings"))
