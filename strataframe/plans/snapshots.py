"""Queries over snapshot entries: listings, predicates, diffs, growth, structure, duplicates, relations, selections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.functions.ids import instant, uuid_key
from strataframe.functions.latest import checkpointed, latest
from strataframe.functions.paths import basename, below, below_ascii_folded, depth, is_valid, parent, suffix
from strataframe.operators import diff, duplicates, entries, relations, selection, series, structure
from strataframe.plans.problems import _LATEST, _SERIES, _UUID
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


def _series(spark: SparkSession, d: str) -> DataFrame:
    return checkpointed(series.snapshot_series(table(spark, d, "snapshots")))  # read several times


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return entries.counted_entries(table(spark, d, "snapshot_entries"), _series(spark, d))


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _series(spark, d)
    return entries.paired(entries.counted_entries(table(spark, d, "snapshot_entries"), s), s)


_E = f"""{_SERIES},
e as (select x.* replace ({_UUID.format("x.snapshot_id")} as snapshot_id), x.payload_observation.status p_status, x.payload_observation.algorithm p_algorithm,
  x.payload_observation.algorithm_version p_algorithm_version, x.payload_observation.digest p_digest, x.payload_observation.bytes_hashed p_bytes_hashed,
  x.payload_observation.provenance p_provenance, x.payload_observation.reused_from_snapshot_id p_reused, x.payload_observation.failure_code p_failure_code
  from (select * from snapshot_entries {_LATEST.format("entry_id")}) x where {_UUID.format("x.snapshot_id")} in (select snapshot_id from series)),
b as (select s.snapshot_id pair, e.* from e join series s on s.prev_id = e.snapshot_id),
t as (select s.snapshot_id pair, e.* from e join series s on s.snapshot_id = e.snapshot_id where s.prev_id is not null)"""
_PARENT = "case when contains({0}, '/') then regexp_replace({0}, '/[^/]*$', '') else '.' end"
_UP = "case when {0} = '.' then ['.'] else list_prepend('.', list_transform(range(1, len(string_split({0}, '/')) + 1), lambda n: array_to_string(list_slice(string_split({0}, '/'), 1, n), '/'))) end"
_KNOWN = "case when {0}object_type = 'regular_file' and {0}observation_status = 'observed' and {0}size_bytes >= 0 then {0}size_bytes end"
_SOUND = """coalesce({0}p_status in ('HASHED', 'EMPTY_FILE_HASHED') and {0}p_algorithm = 'sha256' and {0}p_algorithm_version = 1 and regexp_matches({0}p_digest, '^[0-9a-f]{{64}}$')
 and ({0}p_provenance = 'DIRECT_READ' or {0}p_provenance = 'REUSED_FROM_VERIFIED_SNAPSHOT' and {0}p_reused is not null), false)"""
_OK = f"coalesce(object_type = 'regular_file' and observation_status = 'observed' and not excluded and {_SOUND.format('')} and p_bytes_hashed = size_bytes, false)"
_RELDIGEST = "case when " + _SOUND + " and {0}p_bytes_hashed is not distinct from {0}size_bytes then {0}p_digest end"


# --- listings, predicates, look-ups -------------------------------------------------------------------------------


@query(f"with {_E} select scope_id, count(*) entries from e where object_type = 'regular_file' and observation_status = 'observed' group by 1")
def src_3_scopes(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).where("object_type = 'regular_file' and observation_status = 'observed'").groupBy("scope_id").agg(F.count(F.lit(1)).alias("entries"))


@query(f"""with {_E} select object_type, case (mode | case object_type when 'directory' then 16384 when 'symlink' then 40960 else 32768 end) & 61440
 when 32768 then 'regular_file' when 16384 then 'directory' when 40960 then 'symlink' else 'unknown' end typed, count(*) entries from e group by 1, 2""")
def src_4_object_types(spark: SparkSession, d: str) -> DataFrame:
    # The table has permission bits only; the format bits of the type are put back before they are read again.
    bits = F.when(F.col("object_type") == "directory", 0x4000).when(F.col("object_type") == "symlink", 0xA000).otherwise(0x8000)
    return _entries(spark, d).groupBy("object_type", entries.object_type(F.col("mode").bitwiseOR(bits)).alias("typed")).agg(F.count(F.lit(1)).alias("entries"))


_REUSE = ["device_id", "inode", "size_bytes", "mtime_ns", "ctime_ns"]


@query(f"""with {_E}, c as (select x.snapshot_id, x.scope_id, x.relative_path, y.snapshot_id source_id, y.p_digest,
 row_number() over (partition by x.snapshot_id, x.scope_id, x.relative_path order by sy.completed_at::timestamptz desc, y.snapshot_id desc) rn
 from e x join series sx on sx.snapshot_id = x.snapshot_id join e y on y.scope_id = x.scope_id and y.relative_path = x.relative_path and y.device_id = x.device_id and y.inode = x.inode
   and y.size_bytes = x.size_bytes and y.mtime_ns = x.mtime_ns and y.ctime_ns = x.ctime_ns and y.birthtime_ns is not distinct from x.birthtime_ns
 join series sy on sy.snapshot_id = y.snapshot_id and sy.config_digest = sx.config_digest and sy.pos < sx.pos
 where x.object_type = 'regular_file' and not x.excluded and y.p_provenance = 'DIRECT_READ' and y.p_status in ('HASHED', 'EMPTY_FILE_HASHED'))
 select snapshot_id, scope_id, relative_path, source_id, p_digest as digest from c where rn = 1""")
def src_6_hash_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the newest earlier snapshot in which the file had the same metadata: a latest-version join by one sort per location."""
    s = _series(spark, d)
    e = entries.counted_entries(table(spark, d, "snapshot_entries")).where("object_type = 'regular_file'").join(s.select("snapshot_id", "series", "pos"), "snapshot_id")
    keys = ["series", "scope_id", "relative_path", *_REUSE]
    known = e.where(" and ".join(f"{c} is not null" for c in _REUSE))
    before = Window.partitionBy(*keys, "birthtime_ns").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    direct = F.when((F.col("p_provenance") == "DIRECT_READ") & F.col("p_status").isin("HASHED", "EMPTY_FILE_HASHED"), F.struct("snapshot_id", "p_digest"))
    found = known.withColumn("source", F.last(direct, ignorenulls=True).over(before)).where("source is not null and not excluded")
    return found.select("snapshot_id", "scope_id", "relative_path", F.col("source.snapshot_id").alias("source_id"), F.col("source.p_digest").alias("digest"))


@query(f"""with {_E}, p as (select entry_id, snapshot_id, scope_id, relative_path, row_number() over (order by scope_id, relative_path, snapshot_id) rn from e
 where scope_id = 'managed' and object_type = 'regular_file' and observation_status = 'observed') select entry_id, snapshot_id, scope_id, relative_path, (select count(*) from p) > 300 has_more from p where rn between 201 and 300""")
def fil_1_listing(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).where("scope_id = 'managed' and object_type = 'regular_file' and observation_status = 'observed'").select("entry_id", "snapshot_id", "scope_id", "relative_path")
    return selection.page(e, [F.col("scope_id"), F.col("relative_path"), F.col("snapshot_id")], 100, 200)


@query(f"""with {_E} select root, count(*) filter (relative_path = root or starts_with(lower(relative_path), lower(root || '/'))) folded,
 count(*) filter (relative_path = root or starts_with(relative_path, root || '/')) exact from e, (select unnest(['Depot', 'depot', 'conflicts/segment']) root) group by 1""")
def fil_2_3_prefixes(spark: SparkSession, d: str) -> DataFrame:
    e, out = _entries(spark, d).select("relative_path"), None
    roots = ["Depot", "depot", "conflicts/segment"]
    hits = [F.struct(F.lit(r).alias("root"), below_ascii_folded(F.col("relative_path"), r).alias("a"), below(F.col("relative_path"), r).alias("b")) for r in roots]
    out = e.select(F.explode(F.array(*hits)).alias("h"))
    return out.groupBy("h.root").agg(F.count_if("h.a").alias("folded"), F.count_if("h.b").alias("exact"))


@query(f"with {_E} select case when relative_path = '.' then 0 else len(string_split(relative_path, '/')) end depth, count(*) entries from e group by 1")
def fil_4_depths(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).groupBy(depth(F.col("relative_path")).alias("depth")).agg(F.count(F.lit(1)).alias("entries"))


@query(f"with {_E} select count(*) entries, count(*) filter (relative_path <> '.' and len(list_filter(string_split(relative_path, '/'), lambda x: x in ('', '.', '..'))) > 0 or relative_path is null) invalid from e")
def fil_5_invalid_paths(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).agg(F.count(F.lit(1)).alias("entries"), F.count_if(~is_valid(F.col("relative_path"))).alias("invalid"))


@query(f"""with {_E}, l as (select * from (values ('notes', 'N'), ('depot', 'D'), ('depot/budget', 'DB'), ('conflicts', 'C')) v(root, label))
 select e.entry_id, arg_max(l.label, struct_pack(a := length(root), b := label)) as label from e join l on e.relative_path = root or starts_with(e.relative_path, root || '/') group by 1""")
def fil_6_7_protected_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label of the most specific area that contains a path, by an equi-join on its ancestors instead of a theta join."""
    areas = spark.createDataFrame([("notes", "N"), ("depot", "D"), ("depot/budget", "DB"), ("conflicts", "C")], "ancestor string, label string")
    from strataframe.functions.paths import ancestors_or_self

    up = _entries(spark, d).select("entry_id", F.explode(ancestors_or_self(F.col("relative_path"))).alias("ancestor"))
    return up.join(areas, "ancestor").groupBy("entry_id").agg(F.max_by("label", F.struct(F.length("ancestor"), "label")).alias("label"))


@query(f"""select run_id, run_kind, created_at from (select * from (select * from runs {_LATEST.format("lower(run_id)")}) where status = 'verified' and run_kind = 'filesystem.snapshot')
 order by created_at desc, run_id limit 100""")
def fil_9_runs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "runs").withColumn("run_id", uuid_key(F.col("run_id")))
    r = latest(r, ["run_id"], ["run_kind", "status", "created_at"]).where("status = 'verified' and run_kind = 'filesystem.snapshot'")
    return r.orderBy(F.desc("created_at"), "run_id").limit(100).select("run_id", "run_kind", "created_at")


@query(f"with {_SERIES} select snapshot_id, scope_id, completed_at::timestamptz::timestamp completed from series order by completed desc, snapshot_id limit 100")
def fil_10_snapshots(spark: SparkSession, d: str) -> DataFrame:
    s = latest(table(spark, d, "snapshots").select(uuid_key(F.col("snapshot_id")).alias("snapshot_id"), instant(F.col("completed_at")).alias("completed"), "recorded_at"), ["snapshot_id"], ["completed"])
    return _series(spark, d).join(s, "snapshot_id").orderBy(F.desc("completed"), "snapshot_id").limit(100).select("snapshot_id", "scope_id", F.col("completed").cast("timestamp_ntz").alias("completed"))


@query(f"with {_E}, k as (select min(entry_id) id from e) select e.entry_id, e.relative_path, e.size_bytes from e, k where e.entry_id = k.id")
def fil_11_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    first = e.agg(F.min("entry_id").alias("entry_id"))
    return e.join(first, "entry_id").select("entry_id", "relative_path", "size_bytes")


@query(f"""with {_E} select regexp_extract(lower(relative_path), '[^./](\\.[^./]+)$', 1) extension, count(*) files from e
 where object_type = 'regular_file' and not excluded and regexp_matches(lower(relative_path), '\\.(pdf|docx|xlsx|pptx|epub|png|jpe?g|tiff?)$') group by 1""")
def fil_12_documents(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).where("object_type = 'regular_file' and not excluded").where(
        suffix(F.col("relative_path")).rlike(r"^\.(pdf|docx|xlsx|pptx|epub|png|jpe?g|tiff?)$")
    ).groupBy(suffix(F.col("relative_path")).alias("extension")).agg(F.count(F.lit(1)).alias("files"))


@query(f"""with {_SERIES} select config_digest, scope_id, arg_max(snapshot_id, pos) latest_valid, arg_max(prev_id, pos) previous_valid, case when count(*) = 1 then 'ONLY' else 'AMBIGUOUS' end only_compatible
 from series group by 1, 2""")
def fil_15_selection(spark: SparkSession, d: str) -> DataFrame:
    digest = latest(table(spark, d, "snapshots").select(uuid_key(F.col("snapshot_id")).alias("snapshot_id"), F.lower("config_digest").alias("config_digest"), "recorded_at"), ["snapshot_id"], ["config_digest"])
    return _series(spark, d).join(digest, "snapshot_id").groupBy("config_digest", "scope_id").agg(
        F.max_by("snapshot_id", "pos").alias("latest_valid"), F.max_by("prev_snapshot_id", "pos").alias("previous_valid"), F.when(F.count(F.lit(1)) == 1, "ONLY").otherwise("AMBIGUOUS").alias("only_compatible")
    )


@query(f"with {_E} select snapshot_id, count(*) filter ({_OK}) eligible, count(*) filter ({_RELDIGEST.format('')} is not null) relatable from e group by 1")
def fil_16_eligible(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).groupBy("snapshot_id").agg(F.count_if(entries.payload_eligible()).alias("eligible"), F.count_if(entries.relation_digest().isNotNull()).alias("relatable"))


@query(f"""with {_E} select snapshot_id, case when excluded then 'ENTRY_EXCLUDED' when observation_status <> 'observed' then 'METADATA_' || upper(observation_status)
 when p_failure_code is not null then p_failure_code when p_status in ('HASHED', 'EMPTY_FILE_HASHED') then 'MALFORMED_PAYLOAD_OBSERVATION' else p_status end reason, count(*) files
 from e where object_type = 'regular_file' and not {_OK} group by 1, 2""")
def fil_17_unknown_reasons(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.unknown_reasons(_entries(spark, d))


# --- differences --------------------------------------------------------------------------------------------------

_CHANGED = "concat_ws(',', " + ", ".join(f"case when b.{c} is distinct from t.{c} then '{c}' end" for c in entries.COMPARABLE) + ")"
_DIFF = f"""d as (select coalesce(b.pair, t.pair) pair, coalesce(b.scope_id, t.scope_id) scope_id, coalesce(b.relative_path, t.relative_path) relative_path,
 case when b.entry_id is null or t.entry_id is null then '' else {_CHANGED} end changed, case when b.entry_id is null then 'ADDED' when t.entry_id is null then 'REMOVED' when {_CHANGED} = '' then 'UNCHANGED' else 'MODIFIED' end change_type,
 t.size_bytes - b.size_bytes size_delta from b full join t on b.pair = t.pair and b.scope_id = t.scope_id and b.relative_path = t.relative_path)"""


@query(f"with {_E}, {_DIFF} select pair, scope_id, relative_path, change_type, changed changed_fields from d")
def diff_1_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.snapshot_diff(*_pairs(spark, d)).select(*diff.LOCATION, "change_type", F.array_join("changed_fields", ",").alias("changed_fields"))


@query(f"""with {_E}, {_DIFF} select pair, scope_id, relative_path, case change_type when 'ADDED' then 'FILE_CREATED' when 'REMOVED' then 'FILE_DELETED' else 'FILE_MODIFIED' end event_type,
 size_delta, null::boolean hash_changed, changed not in ('', 'size_bytes') metadata_changed from d where change_type <> 'UNCHANGED'""")
def diff_2_change_events(spark: SparkSession, d: str) -> DataFrame:
    return diff.change_events(diff.snapshot_diff(*_pairs(spark, d)))


@query(f"""with {_E}, {_DIFF} select pair, count(*) filter (change_type = 'ADDED') added, count(*) filter (change_type = 'REMOVED') removed, count(*) filter (change_type = 'MODIFIED') modified,
 count(*) filter (change_type = 'UNCHANGED') as unchanged, count(*) filter (contains(changed, 'object_type')) type_changed, count(*) filter (contains(changed, 'observation_status') or contains(changed, 'error_')) observation_changed
 from d group by 1""")
def agg_11_change_summary(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff_summary(diff.snapshot_diff(*_pairs(spark, d)))


@query(f"""with {_E}, {_DIFF}, r as (select pair, scope_id, relative_path, change_type, row_number() over (partition by pair order by scope_id, relative_path) rank, count(*) over (partition by pair) total from d where change_type <> 'UNCHANGED')
 select pair, scope_id, relative_path, change_type, rank, total from r where rank <= 25""")
def diff_3_review(spark: SparkSession, d: str) -> DataFrame:
    changed = diff.snapshot_diff(*_pairs(spark, d)).where("change_type <> 'UNCHANGED'").select(*diff.LOCATION, "change_type")
    totals = changed.groupBy("pair").agg(F.count(F.lit(1)).alias("total"))
    return selection.top_per(changed, ["pair"], [F.col("scope_id"), F.col("relative_path")], 25).join(totals, "pair")


_FIELDS = ["size_bytes", "mtime_ns", "inode"]


@query(f"with {_E} " + " union all ".join(
    f"""select pair, scope_id, relative_path, '{c}' field, case when b.{c} is null or t.{c} is null then 'UNKNOWN' when b.{c} = t.{c} then 'SAME' else 'DIFFERENT' end outcome
 from b join t using (pair, scope_id, relative_path)""" for c in _FIELDS))
def joi_13_field_comparison(spark: SparkSession, d: str) -> DataFrame:
    return diff.field_comparison(*_pairs(spark, d), _FIELDS)


@query(f"""with {_E} select b.pair, b.scope_id, b.relative_path, case when t.entry_id is null then 'GONE'
 when b.device_id is null or t.device_id is null or b.inode is null or t.inode is null or b.size_bytes is null or t.size_bytes is null or b.mtime_ns is null or t.mtime_ns is null then 'UNKNOWN'
 when b.device_id = t.device_id and b.inode = t.inode and b.size_bytes = t.size_bytes and b.mtime_ns = t.mtime_ns then 'METADATA_MATCH' else 'CHANGED' end state
 from b left join t on b.pair = t.pair and b.scope_id = t.scope_id and b.relative_path = t.relative_path""")
def joi_14_revalidation(spark: SparkSession, d: str) -> DataFrame:
    return diff.revalidated(*_pairs(spark, d))


# --- statistics, structure, growth ----------------------------------------------------------------------------------


@query(f"""with {_E} select snapshot_id, count(*) entries, count(*) filter (observation_status = 'observed') observed, count(*) filter (error_code is not null) errors, count(*) filter (excluded) excluded_count,
 coalesce(sum(size_bytes) filter (object_type = 'regular_file'), 0)::bigint regular_bytes, max(case when relative_path = '.' then 0 else len(string_split(relative_path, '/')) end) max_depth from e group by 1""")
def agg_1_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("observation_status") == "observed").alias("observed"), F.count("error_code").alias("errors"), F.count_if("excluded").alias("excluded_count"),
        F.coalesce(F.sum(F.when(F.col("object_type") == "regular_file", F.col("size_bytes"))), F.lit(0)).alias("regular_bytes"), F.max(depth(F.col("relative_path"))).alias("max_depth"),
    )


@query(f"with {_E} select snapshot_id, p_status status, count(*) entries from e group by 1, 2")
def agg_2_payload_statuses(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).groupBy("snapshot_id", F.col("p_status").alias("status")).agg(F.count(F.lit(1)).alias("entries"))


@query(f"with {_E} select snapshot_id, coalesce(sum(allocated_size_bytes), 0)::bigint allocated, count(*) filter (allocated_size_bytes is null) allocated_unknown from e where object_type = 'regular_file' group by 1")
def agg_3_allocation(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).where("object_type = 'regular_file'").groupBy("snapshot_id").agg(
        F.coalesce(F.sum("allocated_size_bytes"), F.lit(0)).alias("allocated"), F.count_if(F.col("allocated_size_bytes").isNull()).alias("allocated_unknown")
    )


_CONTRIB = f"""c as (select snapshot_id, scope_id, case when object_type = 'directory' then relative_path else {_PARENT.format("relative_path")} end owner, (object_type = 'regular_file')::int r, (object_type = 'directory')::int dd,
 (object_type = 'symlink')::int l, (object_type not in ('regular_file', 'directory', 'symlink'))::int sp, coalesce({_KNOWN.format('')}, 0) kb, (object_type = 'regular_file' and ({_KNOWN.format('')}) is null)::int u from e where not excluded
 union all select snapshot_id, scope_id, '.', 0, 0, 0, 0, 0, 0 from series)"""
_NODES = f"""n as (select snapshot_id, scope_id, owner, unnest({_UP.format("owner")}) path, r, dd, l, sp, kb, u from c)"""
_NODE_COLUMNS = ", ".join(
    f"coalesce(sum({x}) filter (owner = path), 0)::bigint direct_{m}, sum({x})::bigint recursive_{m}"
    for x, m in zip(("r", "dd", "l", "sp", "kb", "u"), ("regular_count", "directory_count", "symlink_count", "special_count", "known_bytes", "unknown_count"))
)


def _scopes(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).select("snapshot_id", "scope_id")


@query(f"with {_E}, {_CONTRIB}, {_NODES} select snapshot_id, scope_id, path, {_NODE_COLUMNS}, coalesce(sum(dd) filter (owner = path), 0) > 0 observed from n group by 1, 2, 3")
def struct_1_rollup(spark: SparkSession, d: str) -> DataFrame:
    return structure.structure(_entries(spark, d), _scopes(spark, d))


@query(f"""with {_E}, {_CONTRIB}, {_NODES}, g as (select snapshot_id, scope_id, path, sum(kb)::bigint bytes from n group by 1, 2, 3), k as (select *, row_number() over (partition by snapshot_id order by bytes desc, scope_id, path) as rank from g where path <> '.' and bytes > 0)
 select snapshot_id, scope_id, path, bytes, rank from k where rank <= 10""")
def top_2_structure_rank(spark: SparkSession, d: str) -> DataFrame:
    nodes = structure.structure(_entries(spark, d)).select(*structure.NODE, F.col("recursive_known_bytes").alias("bytes")).where("path <> '.' and bytes > 0")
    return selection.top_per(nodes, ["snapshot_id"], [F.desc("bytes"), F.col("scope_id"), F.col("path")], 10)


_HINTS = """h as (select snapshot_id, sum(n)::bigint hint_members, count(*) filter (scopes >= 2) scope_overlaps from (select snapshot_id, device_id, inode, count(*) n, count(distinct scope_id) scopes from e
 where not excluded and object_type = 'regular_file' and device_id is not null and inode is not null group by 1, 2, 3 having count(*) >= 2) group by 1)"""


@query(f"""with {_E}, {_HINTS}, k as (select snapshot_id, count(*) entries, count(*) filter (object_type = 'regular_file') regular, count(*) filter (not excluded and {_KNOWN.format('')} is not null) known_regular,
 count(*) filter (not excluded and object_type = 'regular_file' and ({_KNOWN.format('')}) is null) unknown_regular, coalesce(sum({_KNOWN.format('')}) filter (not excluded), 0)::bigint known_bytes, count(*) filter (object_type = 'directory') directories,
 count(*) filter (object_type = 'symlink') symlinks, count(*) filter (object_type not in ('regular_file', 'directory', 'symlink')) specials, count(*) filter (excluded) excluded_count,
 count(*) filter (not excluded and observation_status <> 'observed') metadata_failed, count(*) filter (not excluded and object_type = 'regular_file' and (device_id is null or inode is null)) hint_unavailable from e group by 1)
 select k.*, coalesce(h.hint_members, 0)::bigint hint_members, coalesce(h.scope_overlaps, 0)::bigint scope_overlaps, unknown_regular = 0 and metadata_failed = 0 complete from k left join h using (snapshot_id)""".replace(f"{_KNOWN.format('')} is not null", f"({_KNOWN.format('')}) is not null"))
def agg_5_structure_coverage(spark: SparkSession, d: str) -> DataFrame:
    return structure.structure_coverage(_entries(spark, d))


@query(f"""with {_E}, n as (select snapshot_id, scope_id, unnest({_UP.format(_PARENT.format("relative_path"))}) path, case when object_type = 'regular_file' then coalesce(size_bytes, 0) else 0 end s from e)
 select snapshot_id, scope_id, path, count(*)::bigint entries, sum(s)::bigint bytes from n group by 1, 2, 3""")
def agg_13_directory_summary(spark: SparkSession, d: str) -> DataFrame:
    return structure.directory_summary(_entries(spark, d))


_GROWN = f"""g as (select coalesce(b.pair, t.pair) pair, coalesce(b.scope_id, t.scope_id) scope_id, coalesce(b.relative_path, t.relative_path) relative_path, b.entry_id is not null in_b, t.entry_id is not null in_t, b.k bk, t.k tk
 from (select *, {_KNOWN.format('')} k from b where not excluded and object_type = 'regular_file') b full join (select *, {_KNOWN.format('')} k from t where not excluded and object_type = 'regular_file') t
 on b.pair = t.pair and b.scope_id = t.scope_id and b.relative_path = t.relative_path),
gr as (select pair, scope_id, relative_path, in_b, in_t, case when in_b and bk is null or in_t and tk is null then 'SIZE_UNKNOWN' when not in_b then 'ADDED_LOCATION' when not in_t then 'REMOVED_LOCATION'
 when tk > bk then 'SAME_LOCATION_SIZE_INCREASE' when tk < bk then 'SAME_LOCATION_SIZE_DECREASE' else 'SAME_LOCATION_SIZE_UNCHANGED' end kind,
 case when not (in_b and bk is null or in_t and tk is null) then coalesce(tk, 0) - coalesce(bk, 0) end delta from g)"""


@query(f"with {_E}, {_GROWN} select * from gr")
def joi_2_growth(spark: SparkSession, d: str) -> DataFrame:
    return structure.growth(*_pairs(spark, d))


_GK = {"added": "ADDED_LOCATION", "removed": "REMOVED_LOCATION", "increase": "SAME_LOCATION_SIZE_INCREASE", "decrease": "SAME_LOCATION_SIZE_DECREASE"}
_GM = [f"{n}_bytes" for n in _GK] + [f"{n}_count" for n in _GK] + ["net_bytes", "unknown_count"]


@query(f"""with {_E}, {_GROWN}, o as (select pair, scope_id, {_PARENT.format("relative_path")} as owner, {", ".join(f"case when kind = '{k}' then abs(delta) else 0 end {n}_bytes, (kind = '{k}')::int {n}_count" for n, k in _GK.items())},
 coalesce(delta, 0) net_bytes, (kind = 'SIZE_UNKNOWN')::int unknown_count from gr), n as (select *, unnest({_UP.format("owner")}) path from o)
 select pair, scope_id, path, {", ".join(f"coalesce(sum({m}) filter (owner = path), 0)::bigint direct_{m}, sum({m})::bigint recursive_{m}" for m in _GM)} from n group by 1, 2, 3""")
def agg_6_growth_rollup(spark: SparkSession, d: str) -> DataFrame:
    return structure.growth_nodes(structure.growth(*_pairs(spark, d)))


@query(f"""with {_E}, {_GROWN} select pair, {", ".join(f"count(*) filter (kind = '{k}') {n}_locations" for n, k in _GK.items())}, count(*) filter (kind = 'SAME_LOCATION_SIZE_UNCHANGED') unchanged_locations,
 count(*) filter (in_b and in_t and kind <> 'SIZE_UNKNOWN') comparable, count(*) filter (in_b and in_t and kind = 'SIZE_UNKNOWN') same_unknown, count(*) filter (not in_b and kind = 'SIZE_UNKNOWN') added_unknown,
 count(*) filter (not in_t and kind = 'SIZE_UNKNOWN') removed_unknown, coalesce(sum(delta), 0)::bigint known_net, count(*) filter (kind = 'SIZE_UNKNOWN') = 0 complete from gr group by 1""")
def agg_7_growth_coverage(spark: SparkSession, d: str) -> DataFrame:
    return structure.growth_coverage(structure.growth(*_pairs(spark, d)))


@query(f"""with {_E}, {_GROWN}, n as (select pair, scope_id, unnest({_UP.format(_PARENT.format("relative_path"))}) path, coalesce(delta, 0) delta from gr), s as (select pair, scope_id, path, sum(delta)::bigint net from n group by 1, 2, 3),
 k as (select *, row_number() over (partition by pair order by net desc, scope_id, path) as rank from s where path <> '.' and net > 0) select pair, scope_id, path, net, rank from k where rank <= 5""")
def top_3_growth_rank(spark: SparkSession, d: str) -> DataFrame:
    nodes = structure.growth_nodes(structure.growth(*_pairs(spark, d))).select("pair", "scope_id", "path", F.col("recursive_net_bytes").alias("net")).where("path <> '.' and net > 0")
    return selection.top_per(nodes, ["pair"], [F.desc("net"), F.col("scope_id"), F.col("path")], 5)


# --- duplicates and relations ---------------------------------------------------------------------------------------

_REG = "(select * from e where object_type = 'regular_file' and observation_status = 'observed' and not excluded)"
_CONF = f"""hc as (select snapshot_id, device_id, inode, count(*) members, min(case when {_OK} then p_digest || '|' || size_bytes end) k0, max(case when {_OK} then p_digest || '|' || size_bytes end) k1, min(size_bytes) s0, max(size_bytes) s1,
 min(link_count) links, min(allocated_size_bytes) a0, max(allocated_size_bytes) a1 from {_REG} where device_id is not null and inode is not null group by 1, 2, 3 having count(*) >= 2),
cf as (select snapshot_id, device_id, inode, 'OBJECT_HINT_PAYLOAD_CONFLICT' code, members from hc where k0 <> k1 union all select snapshot_id, device_id, inode, 'OBJECT_HINT_SIZE_CONFLICT', members from hc where s0 <> s1
 union all select snapshot_id, device_id, inode, 'LINK_COUNT_CONFLICT', members from hc where links < members union all select snapshot_id, device_id, inode, 'ALLOCATED_SIZE_CONFLICT', members from hc where a0 <> a1)"""


@query(f"with {_E} select snapshot_id, device_id, inode, count(*) paths from {_REG} where device_id is not null and inode is not null group by 1, 2, 3 having count(*) >= 2")
def joi_7_alias_sets(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.alias_sets(_entries(spark, d))


@query(f"with {_E}, {_CONF} select * from cf")
def agg_9_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.hint_conflicts(_entries(spark, d))


@query(f"""with {_E}, {_CONF}, pz as (select snapshot_id, p_digest from e where {_OK} group by 1, 2 having min(size_bytes) <> max(size_bytes)),
 u as (select e.snapshot_id, e.p_digest, e.size_bytes, e.device_id, e.inode, count(*) n, max((c.code is not null)::int) bad from e left join (select distinct snapshot_id, device_id, inode, 'x' code from cf) c using (snapshot_id, device_id, inode)
 where {_OK} and not exists (select 1 from pz where pz.snapshot_id = e.snapshot_id and pz.p_digest = e.p_digest) group by 1, 2, 3, 4, 5),
 g as (select snapshot_id, p_digest digest, size_bytes as size, sum(n)::bigint members, count(*) filter (device_id is not null and inode is not null and bad = 0) known_units,
 coalesce(sum(n) filter (device_id is null or inode is null), 0)::bigint unknown_units, count(*) filter (device_id is not null and inode is not null and bad = 1) bads from u group by 1, 2, 3 having sum(n) >= 2)
 select snapshot_id, digest, size, members, known_units, unknown_units, known_units >= 2 is_exact_duplicate, size * members path_bytes, size * known_units unit_bytes,
 case when known_units >= 2 and unknown_units = 0 and bads = 0 then size * (known_units - 1) end redundant_bytes from g""")
def dup_1_payload_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.payload_groups(_entries(spark, d))


@query(f"""with {_E} select snapshot_id, count(*) regular, count(*) filter ({_OK}) analysable, count(*) filter (not {_OK}) as unknown, coalesce(sum(size_bytes) filter ({_OK}), 0)::bigint analysable_bytes,
 coalesce(sum(size_bytes) filter (not {_OK}), 0)::bigint unknown_bytes from e where object_type = 'regular_file' group by 1""")
def agg_10_duplicate_coverage(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_coverage(_entries(spark, d))


@query(f"""with {_E}, {_CONF}, u as (select r.snapshot_id, r.device_id, r.inode, count(*) n, max(r.allocated_size_bytes) a, max((c.code is not null)::int) bad from {_REG} r
 left join (select distinct snapshot_id, device_id, inode, 'x' code from cf) c using (snapshot_id, device_id, inode) group by 1, 2, 3), k as (select *, device_id is not null and inode is not null known from u)
 select snapshot_id, coalesce(sum(a) filter (known and n = 1 and a is not null and bad = 0), 0)::bigint known_bytes, count(*) filter (known and n = 1 and a is not null and bad = 0) known_units,
 coalesce(sum(case when not known then n when n = 1 and a is not null and bad = 0 then 0 else 1 end), 0)::bigint unknown_units from k group by 1""")
def agg_10_physical(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.physical_summary(_entries(spark, d))


_BT = "b join t using (pair, scope_id, relative_path)"
_META = " or ".join(f"b.{c} is distinct from t.{c}" for c in relations._METADATA)


@query(f"""with {_E}, r as (select pair, scope_id, relative_path, case when b.object_type <> t.object_type then 'SAME_LOCATION_TYPE_CHANGED'
 when b.object_type = 'symlink' and b.symlink_target_raw is distinct from t.symlink_target_raw then 'SAME_LOCATION_SYMLINK_TARGET_CHANGED'
 when b.object_type = 'regular_file' and not (coalesce(b.device_id = t.device_id and b.inode = t.inode, false) and not coalesce(b.birthtime_ns <> t.birthtime_ns, false)) then 'SAME_LOCATION_OBJECT_HINT_CHANGED'
 when b.object_type = 'regular_file' and (({_RELDIGEST.format("b.")}) is null or ({_RELDIGEST.format("t.")}) is null) then 'SAME_LOCATION_CONTENT_UNKNOWN'
 when b.object_type = 'regular_file' and ({_RELDIGEST.format("b.")}) <> ({_RELDIGEST.format("t.")}) then 'SAME_LOCATION_CONTENT_CHANGED'
 when {_META} then 'SAME_LOCATION_METADATA_CHANGED' else 'SAME_LOCATION_CONTINUITY' end kind from {_BT} where b.observation_status = 'observed' and t.observation_status = 'observed')
 select *, case when kind = 'SAME_LOCATION_CONTENT_UNKNOWN' then 'UNKNOWN' else 'FACT' end certainty from r""")
def rel_1_same_location(spark: SparkSession, d: str) -> DataFrame:
    return relations.same_location(*_pairs(spark, d))


def _gone(a: str, o: str) -> str:
    return f"""select {a}.pair, {a}.device_id, {a}.inode, {a}.birthtime_ns, count(*) n, count({_RELDIGEST.format(a + ".")}) known, min({_RELDIGEST.format(a + ".")}) d0, max({_RELDIGEST.format(a + ".")}) d1, min({a}.scope_id) scope
 from {a} where object_type = 'regular_file' and observation_status = 'observed' and not excluded and device_id is not null and inode is not null and birthtime_ns is not null
 and not exists (select 1 from {o} where {o}.pair = {a}.pair and {o}.scope_id = {a}.scope_id and {o}.relative_path = {a}.relative_path) group by 1, 2, 3, 4"""


@query(f"""with {_E}, gb as ({_gone("b", "t")}), gt as ({_gone("t", "b")}), pb as (select pair, device_id, inode, count(*) c from b group by 1, 2, 3), pt as (select pair, device_id, inode, count(*) c from t group by 1, 2, 3),
 k as (select gb.pair, gb.device_id, gb.inode, gb.birthtime_ns, case when pb.c > 1 or pt.c > 1 or gb.d0 <> gb.d1 or gt.d0 <> gt.d1 or gb.d0 <> gt.d0 then 'AMBIGUOUS_LOCATION_TRANSITION'
 when gb.scope = gt.scope then 'RENAME_CANDIDATE' else 'CROSS_SCOPE_TRANSITION_CANDIDATE' end kind, case when pb.c > 1 or pt.c > 1 then pb.c else gb.n end sources, case when pb.c > 1 or pt.c > 1 then pt.c else gt.n end targets
 from gb join gt using (pair, device_id, inode, birthtime_ns) join pb using (pair, device_id, inode) join pt using (pair, device_id, inode) where gb.known = gb.n and gt.known = gt.n)
 select *, case when kind like 'AMB%' then 'AMBIGUOUS' else 'CANDIDATE' end certainty from k""")
def rel_2_transitions(spark: SparkSession, d: str) -> DataFrame:
    return relations.transitions(*_pairs(spark, d))


@query(f"""with {_E} select pair, 'only_base' side, count(*) n from b where not exists (select 1 from t where t.pair = b.pair and t.scope_id = b.scope_id and t.relative_path = b.relative_path) group by 1
 union all select pair, 'only_target', count(*) from t where not exists (select 1 from b where t.pair = b.pair and t.scope_id = b.scope_id and t.relative_path = b.relative_path) group by 1""")
def joi_4_anti_joins(spark: SparkSession, d: str) -> DataFrame:
    b, t = _pairs(spark, d)
    only = lambda x, y, s: x.join(y.select(*diff.LOCATION), diff.LOCATION, "left_anti").groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(s))
    return only(b, t, "only_base").unionByName(only(t, b, "only_target"))


@query(f"with {_E} select snapshot_id base, next_id target, scope_id from series where next_id is not null")
def win_3_adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).where("prev_snapshot_id is not null").select(F.col("prev_snapshot_id").alias("base"), F.col("snapshot_id").alias("target"), "scope_id")


# --- reasons and bounded selections ---------------------------------------------------------------------------------

_HASHED = "p_status in ('HASHED', 'EMPTY_FILE_HASHED')"
_CHANNEL = "case when excluded or observation_status <> 'observed' or not readable or (object_type = 'regular_file' and size_bytes is null) or p_status = 'NOT_LOCAL' or (object_type = 'regular_file' and not p_status in ('HASHED', 'EMPTY_FILE_HASHED')) or p_provenance is not null then 0 else 1 end"


def _with_reasons(e: DataFrame) -> DataFrame:
    """Why an entry is worth showing, sorted, and the channel that its reasons put it in."""
    regular, hashed = F.col("object_type") == "regular_file", F.col("p_status").isin("HASHED", "EMPTY_FILE_HASHED")
    flags = [
        ("ACCESS_FAILURE", F.col("observation_status") == "permission_denied"), ("EXCLUDED", F.col("excluded")), ("METADATA_FAILURE", F.col("observation_status") != "observed"), ("NON_LOCAL", F.col("p_status") == "NOT_LOCAL"),
        ("PAYLOAD_UNKNOWN", regular & ~hashed & (F.col("p_status") != "NOT_LOCAL")), ("REUSE_PROVENANCE", F.col("p_provenance").isNotNull()), ("UNKNOWN_SIZE", regular & F.col("size_bytes").isNull()), ("UNREADABLE", ~F.col("readable")),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags]))
    return e.withColumn("reasons", reasons).withColumn("channel", F.when(F.size("reasons") > 0, 0).otherwise(1))


@query(f"""with {_E} select snapshot_id, scope_id, relative_path, concat_ws(',', case when observation_status = 'permission_denied' then 'ACCESS_FAILURE' end, case when excluded then 'EXCLUDED' end,
 case when observation_status <> 'observed' then 'METADATA_FAILURE' end, case when p_status = 'NOT_LOCAL' then 'NON_LOCAL' end, case when object_type = 'regular_file' and not {_HASHED} and p_status <> 'NOT_LOCAL' then 'PAYLOAD_UNKNOWN' end,
 case when p_provenance is not null then 'REUSE_PROVENANCE' end, case when object_type = 'regular_file' and size_bytes is null then 'UNKNOWN_SIZE' end, case when not readable then 'UNREADABLE' end) reasons, {_CHANNEL} channel from e""")
def prj_1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _with_reasons(_entries(spark, d)).select("snapshot_id", "scope_id", "relative_path", F.array_join("reasons", ",").alias("reasons"), "channel")


@query(f"""with {_E}, c as (select snapshot_id, scope_id, relative_path, {_CHANNEL} channel from e), s as (select *, row_number() over (partition by snapshot_id, scope_id order by channel, relative_path) s from c),
 r as (select *, row_number() over (partition by snapshot_id order by case when s <= 1 then 0 else 1 end, case when s <= 1 then scope_id else '' end, channel, scope_id, relative_path) r from s)
 select snapshot_id, scope_id, relative_path, channel, case when s <= 1 then 'SCOPE_MINIMUM' else 'CHANNEL' end selected_as from r where r <= 12""")
def top_5_fair_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_reasons(_entries(spark, d)).select("snapshot_id", "scope_id", "relative_path", "channel")
    return selection.fair_selection(rows, "snapshot_id", "scope_id", "channel", ["relative_path"], 12)


_TRACK = "case change_type when 'UNCHANGED' then 3 else 0 end"


@query(f"""with {_E}, {_DIFF}, {_GROWN}, c as (select d.pair, d.scope_id, d.relative_path, case when change_type <> 'UNCHANGED' then 0 when coalesce(gr.delta, 0) <> 0 then 1 else 3 end channel from d left join gr using (pair, scope_id, relative_path)),
 s as (select *, row_number() over (partition by pair, scope_id order by channel, relative_path) s from c), q as (select *, sum((s > 1)::int) over (partition by pair, channel order by channel, scope_id, relative_path) p, sum((s <= 1)::int) over (partition by pair, channel) u from s),
 r as (select *, row_number() over (partition by pair order by case when s <= 1 then 0 else 1 end, channel, scope_id, relative_path) r from q where s <= 1 or channel not in (0, 3) or p + u <= case channel when 0 then 6 else 2 end)
 select pair, scope_id, relative_path, channel, case when s <= 1 then 'SCOPE_MINIMUM' else 'CHANNEL' end selected_as from r where r <= 8""")
def top_6_quota_selection(spark: SparkSession, d: str) -> DataFrame:
    b, t = _pairs(spark, d)
    grown = structure.growth(b, t).select(*diff.LOCATION, "delta")
    rows = diff.snapshot_diff(b, t).join(grown, diff.LOCATION, "left")
    rows = rows.select(*diff.LOCATION, F.when(F.col("change_type") != "UNCHANGED", 0).when(F.coalesce("delta", F.lit(0)) != 0, 1).otherwise(3).alias("channel"))
    return selection.quota_selection(rows, "pair", "scope_id", "channel", ["relative_path"], 8, 1, {0: 6, 3: 2})


@query(f"""with {_E}, c as (select snapshot_id, {_CHANNEL} channel, case when object_type = 'regular_file' then coalesce(size_bytes, 0) else 0 end s, row_number() over (partition by snapshot_id order by {_CHANNEL}, scope_id, relative_path) r from e)
 select snapshot_id, count(*) source_entries, count(*) filter (r <= 12) explicit_entries, count(*) filter (r > 12) folded_entries, sum(s)::bigint source_bytes, coalesce(sum(s) filter (r <= 12), 0)::bigint explicit_bytes, coalesce(sum(s) filter (r > 12), 0)::bigint folded_bytes,
 case when count(*) filter (r > 12) = 0 then 'COMPLETE' else 'PARTIAL' end coverage from c group by 1""")
def agg_14_accounting(spark: SparkSession, d: str) -> DataFrame:
    """What a selection shows and what it folds away: the two always add up to the source."""
    rows = _with_reasons(_entries(spark, d)).select("snapshot_id", "scope_id", "relative_path", "channel", F.coalesce(F.when(F.col("object_type") == "regular_file", F.col("size_bytes")), F.lit(0)).alias("s"))
    shown = selection.fair_selection(rows, "snapshot_id", "scope_id", "channel", ["relative_path"], 12, 0).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("explicit_entries"), F.sum("s").alias("explicit_bytes"))
    total = rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("source_entries"), F.sum("s").alias("source_bytes"))
    return total.join(shown, "snapshot_id").select(
        "*", (F.col("source_entries") - F.col("explicit_entries")).alias("folded_entries"), (F.col("source_bytes") - F.col("explicit_bytes")).alias("folded_bytes"),
        F.when(F.col("source_entries") == F.col("explicit_entries"), "COMPLETE").otherwise("PARTIAL").alias("coverage"),
    )


@query(f"""with {_E}, {_DIFF}, {_GROWN} select d.pair, d.scope_id, d.relative_path, d.change_type, gr.kind growth_kind, gr.delta from d left join gr using (pair, scope_id, relative_path)""")
def joi_11_tracking(spark: SparkSession, d: str) -> DataFrame:
    b, t = _pairs(spark, d)
    grown = structure.growth(b, t).select(*diff.LOCATION, F.col("kind").alias("growth_kind"), "delta")
    return diff.snapshot_diff(b, t).select(*diff.LOCATION, "change_type").join(grown, diff.LOCATION, "left")


@query(f"""with {_E} select entry_id, {_PARENT.format("relative_path")} parent, regexp_extract(relative_path, '[^/]*$') basename, case when relative_path = '.' then 0 else len(string_split(relative_path, '/')) end depth,
 sha256(snapshot_id || chr(0) || scope_id || chr(0) || relative_path) computed_id, sha256(snapshot_id || chr(0) || scope_id || chr(0) || relative_path) = entry_id matches from e""")
def fn_1_12_paths_and_ids(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("relative_path")
    made = F.sha2(F.concat_ws("\0", "snapshot_id", "scope_id", "relative_path"), 256)
    return _entries(spark, d).select("entry_id", parent(p).alias("parent"), basename(p).alias("basename"), depth(p).alias("depth"), made.alias("computed_id"), (made == F.col("entry_id")).alias("matches"))
