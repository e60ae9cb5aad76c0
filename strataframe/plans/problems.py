"""Queries over general training-data operations (problems 1, 3, 5 and 6) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators.changes import location_changes
from strataframe.operators.hierarchy import descendants, resolve, tree_nodes, with_descendant_counts
from strataframe.operators.history import location_history
from strataframe.operators.orphans import filtered, orphan_references, orphan_report, parent_keys
from strataframe.operators.series import placed_identities, snapshot_series
from strataframe.sources.tables import table


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    series = snapshot_series(table(spark, d, "snapshots"))
    return placed_identities(table(spark, d, "document_identities"), table(spark, d, "snapshot_entries"), series), series


def p1_history(spark: SparkSession, d: str) -> DataFrame:
    return location_history(*_placed(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_history(spark, d).select("scope_id", "relative_path", "valid_from_snapshot_id", "valid_to_snapshot_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return location_changes(*_placed(spark, d))


def p3_summary(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("base_snapshot_id", "target_snapshot_id", "scope_id").agg(
        *[F.count_if(F.col("change_type") == k).alias(k.lower()) for k in ("ADDED", "REMOVED", "MODIFIED")]
    )


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return tree_nodes(table(spark, d, "content_matches"), "document_key", "node_id", "parent")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return resolve(_nodes(spark, d)).select(F.col("tree").alias("document_key"), F.col("node").alias("node_id"), F.col("root").alias("root_node_id"), "depth")


def p5_tree(spark: SparkSession, d: str) -> DataFrame:
    return with_descendant_counts(resolve(_nodes(spark, d), paths=True)).select(
        F.col("tree").alias("document_key"), F.col("node").alias("node_id"), F.col("root").alias("root_node_id"), "depth",
        F.coalesce(F.array_join("path", "/"), F.lit("")).alias("path"), "n_descendants",
    )


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(resolve(_nodes(spark, d), paths=True)).select(
        F.col("tree").alias("document_key"), F.col("ancestor").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance"
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    snapshots, runs = table(spark, d, "snapshots"), table(spark, d, "runs")
    of_snapshots = filtered(parent_keys(snapshots, "snapshot_id"))
    found = orphan_references(table(spark, d, "snapshot_entries"), "snapshot_entries", "entry_id", "snapshot_id", of_snapshots)
    found = found.unionByName(orphan_references(snapshots, "snapshots", "snapshot_id", "run_id", parent_keys(runs, "run_id")))
    return found.unionByName(orphan_references(table(spark, d, "snapshot_diffs"), "snapshot_diffs", "diff_id", "base_snapshot_id", of_snapshots))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p6_found(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_history, p3_found, p3_summary, p5_found, p5_tree, p5_descendants, p6_found, p6_report)
}

_UUID = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"
_DIGEST = "nullif(regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '^sha-?256\\s*[:=-]?\\s*', ''), '')"
_LATEST = "qualify row_number() over (partition by {0} order by recorded_at desc nulls last) = 1"

_SERIES = f"""
snaps as (select * from (select {_UUID.format("snapshot_id")} snapshot_id, lower(config_digest) config_digest, scope_ids[1] scope_id,
   lower(trim(status)) status, completed_at, deleted_at from (select * from snapshots {_LATEST.format("lower(trim(snapshot_id))")})) where status = 'complete' and deleted_at is null),
series as (select *, row_number() over s as pos, lag(snapshot_id) over s as prev_id, lead(snapshot_id) over s as next_id
   from snaps window s as (partition by config_digest, scope_id order by completed_at::timestamptz, snapshot_id)),
ids as (select * from document_identities {_LATEST.format("entry_id")}),
ents as (select entry_id, relative_path entry_path from snapshot_entries {_LATEST.format("entry_id")}),
placed as (select s.config_digest || '|' || s.scope_id as series, s.pos, s.snapshot_id, s.prev_id, s.next_id, i.scope_id,
   coalesce(nullif(i.relative_path, ''), e.entry_path) relative_path, {_DIGEST.format("i.payload_sha256")} digest,
   case when i.size_bytes >= 0 then i.size_bytes end size, i.mtime_ns mtime
   from ids i left join ents e using (entry_id) join series s on s.snapshot_id = {_UUID.format("i.snapshot_id")})"""

_P1 = f"""with {_SERIES},
runs_ as (select *, pos - row_number() over w as run from placed window w as (partition by series, scope_id, relative_path order by pos)),
known as (select *, last_value(digest ignore nulls) over b d0, last_value(size ignore nulls) over b s0, lag(pos) over o p0
   from runs_ window o as (partition by series, scope_id, relative_path, run order by pos),
   b as (partition by series, scope_id, relative_path, run order by pos rows between unbounded preceding and 1 preceding)),
marked as (select *, case when p0 is null or coalesce(digest <> d0, false) or coalesce(size <> s0, false) then 1 else 0 end st from known),
numbered as (select *, sum(st) over (partition by series, scope_id, relative_path order by pos) v from marked)
select scope_id, relative_path, arg_min(snapshot_id, pos) valid_from_snapshot_id, coalesce(max_by(coalesce(next_id, ''), pos), '') valid_to_snapshot_id{{more}}
from numbered group by series, scope_id, relative_path, v"""

_P3 = f"""with {_SERIES}
select a.snapshot_id base_snapshot_id, a.next_id target_snapshot_id, a.scope_id, a.relative_path, 'REMOVED' change_type from placed a
 where a.next_id is not null and not exists (select 1 from placed b where b.series = a.series and b.pos = a.pos + 1 and b.scope_id = a.scope_id and b.relative_path = a.relative_path)
union all
select b.prev_id, b.snapshot_id, b.scope_id, b.relative_path, 'ADDED' from placed b
 where b.prev_id is not null and not exists (select 1 from placed a where b.series = a.series and b.pos = a.pos + 1 and b.scope_id = a.scope_id and b.relative_path = a.relative_path)
union all
select a.snapshot_id, b.snapshot_id, a.scope_id, a.relative_path, 'MODIFIED' from placed a join placed b
 on b.series = a.series and b.pos = a.pos + 1 and b.scope_id = a.scope_id and b.relative_path = a.relative_path
 where a.digest <> b.digest or a.size <> b.size or a.mtime <> b.mtime"""

_NODES = """nodes0 as (select coalesce(trim(document_key), '') document_key, trim(node_id) node_id, arg_max(nullif(trim(parent), ''), recorded_at) filter (nullif(trim(parent), '') is not null) parent
   from content_matches where nullif(trim(node_id), '') is not null group by 1, 2),
nodes as (select n.document_key, n.node_id, p.node_id parent from nodes0 n left join nodes0 p on p.document_key = n.document_key and p.node_id = n.parent),
tree as (select document_key, node_id, node_id root, 0 depth, node_id path, [node_id] up from nodes where parent is null
   union all select n.document_key, n.node_id, t.root, t.depth + 1, t.path || '/' || n.node_id, list_append(t.up, n.node_id) from nodes n join tree t on t.document_key = n.document_key and t.node_id = n.parent)"""

_P6 = f"""with snap as (select {_UUID.format("snapshot_id")} k, min(recorded_at) first_at, arg_max(struct_pack(x := deleted_at), recorded_at).x deleted from snapshots group by 1),
run as (select {_UUID.format("run_id")} k, min(recorded_at) first_at, arg_max(struct_pack(x := deleted_at), recorded_at).x deleted from runs group by 1),
kids as (
 select 'snapshot_entries' child_table, lower(trim(entry_id)) child_key, arg_max(struct_pack(x := {_UUID.format("snapshot_id")}), recorded_at).x ref_key, min(recorded_at) first_at from snapshot_entries group by 2
 union all select 'snapshots', lower(trim(snapshot_id)), arg_max(struct_pack(x := {_UUID.format("run_id")}), recorded_at).x, min(recorded_at) from snapshots group by 2
 union all select 'snapshot_diffs', lower(trim(diff_id)), arg_max(struct_pack(x := {_UUID.format("base_snapshot_id")}), recorded_at).x, min(recorded_at) from snapshot_diffs group by 2),
judged as (select c.child_table, c.child_key, c.ref_key, case when p.k is null then 'missing' when p.deleted <= c.first_at then 'deleted' when p.first_at > c.first_at then 'late' end orphan_kind,
 strftime(c.first_at, '%Y-%m') period
 from kids c left join (select 'r' t, * from run union all select 's', * from snap) p on p.k = c.ref_key and p.t = case when c.child_table = 'snapshots' then 'r' else 's' end where nullif(c.ref_key, '') is not null)
"""

SQL = {
    "p1_found": _P1.format(more=""),
    "p1_history": _P1.format(more=", arg_min(digest, pos) filter (digest is not null) payload_sha256, arg_min(size, pos) filter (size is not null) size_bytes"),
    "p3_found": _P3,
    "p3_summary": f"""select base_snapshot_id, target_snapshot_id, scope_id, count(*) filter (change_type = 'ADDED') added,
 count(*) filter (change_type = 'REMOVED') removed, count(*) filter (change_type = 'MODIFIED') modified from ({_P3}) group by 1, 2, 3""",
    "p5_found": f"""with recursive {_NODES} select n.document_key, n.node_id, coalesce(t.root, '') root_node_id, coalesce(t.depth, -1) depth
 from nodes n left join tree t using (document_key, node_id)""",
    "p5_tree": f"""with recursive {_NODES}, c as (select document_key, unnest(list_slice(up, 1, len(up) - 1)) node_id from tree),
 k as (select document_key, node_id, count(*) n from c group by 1, 2)
 select n.document_key, n.node_id, coalesce(t.root, '') root_node_id, coalesce(t.depth, -1) depth, coalesce(t.path, '') path, coalesce(k.n, 0) n_descendants
 from nodes n left join tree t using (document_key, node_id) left join k using (document_key, node_id)""",
    "p5_descendants": f"""with recursive {_NODES} select document_key, node_id, descendant_id, depth - i as distance from
 (select document_key, node_id descendant_id, depth, unnest(list_slice(up, 1, len(up) - 1)) node_id, unnest(range(len(up) - 1)) i from tree)""",
    "p6_found": _P6 + "select * from judged where orphan_kind is not null",
    "p6_report": _P6 + "select child_table, period, orphan_kind, count(*) orphans from judged where orphan_kind is not null group by 1, 2, 3",
}
