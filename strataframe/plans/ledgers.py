"""Queries over runs, snapshot headers and their references: chains, states, integrity, reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.functions.canonical import fingerprint
from strataframe.functions.ids import instant, uuid_key
from strataframe.functions.latest import latest
from strataframe.operators import ledger
from strataframe.plans.problems import _LATEST, _UUID
from strataframe.plans.snapshots import _E, _entries, _series
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


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A hash chain per user over the events: sequence, own digest, previous digest; every 97th link is broken."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.sha2(F.concat_ws("|", "event_id", "event_type"), 256).alias("digest"), F.row_number().over(w).alias("sequence"))
    return e.withColumn("previous", F.when(F.col("event_id") % 97 == 0, F.lit("0")).otherwise(F.lag("digest").over(w)))


_R = """rec as (select user_id, event_id, event_type, digest, sequence, case when event_id % 97 = 0 then '0' else lag(digest) over (partition by user_id order by event_id) end as previous from
 (select user_id, event_id, event_type, sha256(event_id || '|' || event_type) digest, row_number() over (partition by user_id order by event_id) as sequence from events))"""


@query(f"""with {_R}, c as (select *, concat_ws(',', case when sequence <> row_number() over w then 'SEQUENCE_GAP' end, case when previous is distinct from lag(digest) over w then 'PREVIOUS_DIGEST_MISMATCH' end) codes from rec window w as (partition by user_id order by sequence))
 select user_id, sequence, codes from c where codes <> ''""")
def ver_3_chain(spark: SparkSession, d: str) -> DataFrame:
    return ledger.chain(_records(spark, d), "user_id", "sequence", "digest", "previous").where("size(codes) > 0").select("user_id", "sequence", F.array_join("codes", ",").alias("codes"))


_STATE = "case event_type when 'signup' then 'created' when 'view' then 'scanning' when 'click' then 'scanned' when 'purchase' then 'verified' else 'failed' end"
_ALLOWED = ", ".join(f"'{a}>{b}'" for a, bs in ledger.TRANSITIONS.items() for b in bs)


@query(f"""with s as (select user_id, event_id, {_STATE} st from events), g as (select *, lag(st, 1, 'created') over (partition by user_id order by event_id) || '>' || st step, row_number() over (partition by user_id order by event_id) rn from s)
 select user_id, arg_max(st, event_id) as status, count(*) filter (step not in ({_ALLOWED}) and not (rn = 1 and st = 'created')) illegal, arg_max(st, event_id) in ('verified', 'failed', 'cancelled', 'rolled_back') terminal from g group by 1""")
def ver_4_states(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.expr(_STATE).alias("st"))
    return ledger.replayed_states(e, "user_id", "event_id", "st")


_RUNS = f"run as (select {_UUID.format('run_id')} run_id, run_kind, status, terminal, config_digest, deleted_at from (select * from runs {_LATEST.format('lower(trim(run_id))')}))"
_HEAD = f"head as (select {_UUID.format('snapshot_id')} snapshot_id, {_UUID.format('run_id')} run_id, status, evidence_id, entry_count, evidence_relative_path, deleted_at from (select * from snapshots {_LATEST.format('lower(trim(snapshot_id))')}))"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "runs").select(uuid_key(F.col("run_id")).alias("run_id"), "run_kind", "status", "terminal", "config_digest", "deleted_at", "recorded_at")
    return latest(r, ["run_id"], ["run_kind", "status", "terminal", "config_digest", "deleted_at"])


def _headers(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "snapshots").select(uuid_key(F.col("snapshot_id")).alias("snapshot_id"), uuid_key(F.col("run_id")).alias("run_id"), "status", "evidence_id", "entry_count", "evidence_relative_path", "deleted_at", "recorded_at")
    return latest(h, ["snapshot_id"], ["run_id", "status", "evidence_id", "entry_count", "evidence_relative_path", "deleted_at"])


@query(f"with {_RUNS} select run_kind, status, terminal = (status in ('verified', 'failed', 'cancelled', 'rolled_back')) consistent, count(*) runs from run group by 1, 2, 3")
def win_2_run_states(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("terminal") == F.col("status").isin(ledger.TERMINAL)
    return _runs(spark, d).groupBy("run_kind", "status", ok.alias("consistent")).agg(F.count(F.lit(1)).alias("runs"))


_ISSUES = f"""iss as (select head.snapshot_id, case when run.run_id is null then 'SNAPSHOT_RUN_MISSING' when run.run_kind <> 'filesystem.snapshot' then 'SNAPSHOT_RUN_KIND_INVALID' when head.status = 'complete' and run.status <> 'verified' then 'SNAPSHOT_RUN_STATUS_INVALID' end code from head left join run using (run_id)
 union all select head.snapshot_id, case when count(e.snapshot_id) = 0 then 'SNAPSHOT_INDEX_MISSING' when count(e.snapshot_id) <> any_value(entry_count) then 'SNAPSHOT_ENTRY_INDEX_INCOMPLETE' end from head left join (select distinct entry_id, {_UUID.format('snapshot_id')} snapshot_id from snapshot_entries) e using (snapshot_id) group by 1)"""


def _issues(spark: SparkSession, d: str) -> DataFrame:
    """What the index, the headers and the runs say against each other: code, snapshot_id, evidence_id."""
    head, runs = _headers(spark, d), _runs(spark, d).select("run_id", "run_kind", F.col("status").alias("run_status"))
    j = head.join(runs, "run_id", "left")
    run_code = (
        F.when(F.col("run_kind").isNull(), "SNAPSHOT_RUN_MISSING").when(F.col("run_kind") != "filesystem.snapshot", "SNAPSHOT_RUN_KIND_INVALID")
        .when((F.col("status") == "complete") & (F.col("run_status") != "verified"), "SNAPSHOT_RUN_STATUS_INVALID")
    )
    counts = table(spark, d, "snapshot_entries").select("entry_id", uuid_key(F.col("snapshot_id")).alias("snapshot_id")).distinct().groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    i = head.join(counts, "snapshot_id", "left")
    index_code = F.when(F.col("n").isNull(), "SNAPSHOT_INDEX_MISSING").when(F.col("n") != F.col("entry_count"), "SNAPSHOT_ENTRY_INDEX_INCOMPLETE")
    made = lambda x, c: x.select("snapshot_id", c.alias("code"), F.lit("").alias("evidence_id")).where("code is not null")
    return made(j, run_code).unionByName(made(i, index_code))


@query(f"with {_RUNS}, {_HEAD}, {_ISSUES} select code, count(*) snapshots, case when code in ('SNAPSHOT_INDEX_MISSING', 'SNAPSHOT_ENTRY_INDEX_INCOMPLETE') then 'DEGRADED' else 'INVALID' end severity from iss where code is not null group by 1")
def joi_9_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("snapshots")).withColumn("severity", ledger.severity(F.col("code")))


@query(f"""with {_RUNS}, {_HEAD}, {_ISSUES}, a as (select snapshot_id, string_agg(distinct code, ',' order by code) codes, max(case when code in ('SNAPSHOT_INDEX_MISSING', 'SNAPSHOT_ENTRY_INDEX_INCOMPLETE') then 1 else 2 end) w from iss where code is not null group by 1)
 select head.snapshot_id, case w when 2 then 'INVALID' when 1 then 'DEGRADED' else 'HEALTHY' end integrity, coalesce(codes, '') codes from head left join a using (snapshot_id)""")
def agg_12_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Problems attached to snapshots (JOI-10) and the worst severity of each."""
    return ledger.classified(_headers(spark, d), _issues(spark, d))


@query(f"""with {_HEAD} select run_id, count(*) records, count(distinct evidence_id) contents, 'SNAPSHOT_RUN_DUPLICATE' code from head where run_id is not null group by 1 having count(*) > 1""")
def mnt_1_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return ledger.duplicates_of(_headers(spark, d).withColumn("content", F.col("evidence_id")), "run_id", "SNAPSHOT_RUN_DUPLICATE")


@query(f"""with {_E}, n as (select snapshot_id, count(*) c from e group by 1) select (select count(*) from series) snapshots, (select count(*) from e) entries, (select count(*) from e where snapshot_id not in (select snapshot_id from series)) leaked, (select count(*) from series where snapshot_id not in (select snapshot_id from n)) without_entries""")
def mnt_3_replay_plan(spark: SparkSession, d: str) -> DataFrame:
    """Only eligible snapshots are replayed; counts of what is replayed, leaked (none by construction) and missing."""
    s, e = _series(spark, d).select("snapshot_id"), _entries(spark, d).select("snapshot_id")
    parts = s.agg(F.count(F.lit(1)).alias("snapshots")), e.agg(F.count(F.lit(1)).alias("entries")), e.join(s, "snapshot_id", "left_anti").agg(F.count(F.lit(1)).alias("leaked")), s.join(e, "snapshot_id", "left_anti").agg(F.count(F.lit(1)).alias("without_entries"))
    names = ["snapshots", "entries", "leaked", "without_entries"]
    rows = None
    for p, n in zip(parts, names):
        r = p.select(F.lit(n).alias("k"), F.col(n).alias("v"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.agg(*[F.max(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in names])


@query()
def mnt_4_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Identity of the whole index whatever the order of its rows; equal for shuffled input (tests)."""
    return fingerprint(_entries(spark, d))


@query(f"""with {_RUNS}, {_HEAD} select 'snapshots.run_id' edge, count(*) violations from head where run_id is not null and run_id not in (select run_id from run)
 union all select 'snapshot_entries.snapshot_id', count(*) from (select distinct entry_id, {_UUID.format('snapshot_id')} s from snapshot_entries) where s is not null and s not in (select snapshot_id from head)""")
def mnt_9_foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    head, runs = _headers(spark, d), _runs(spark, d)
    e = table(spark, d, "snapshot_entries").select("entry_id", uuid_key(F.col("snapshot_id")).alias("snapshot_id")).distinct()
    n = lambda x, k: x.agg(F.count(F.lit(1)).alias("violations")).withColumn("edge", F.lit(k))
    return n(ledger.foreign_key_violations(head, "run_id", runs, "run_id"), "snapshots.run_id").unionByName(n(ledger.foreign_key_violations(e, "snapshot_id", head, "snapshot_id"), "snapshot_entries.snapshot_id"))


@query(f"""with {_RUNS}, {_HEAD} select run.run_id, case when run.status = 'created' then 'RECOVERY_REQUIRED_PRE_SCAN' when run.status = 'scanning' and head.snapshot_id is not null then 'RECOVERY_REQUIRED_CLOSE_SNAPSHOT' when run.status = 'scanning' then 'RECOVERY_REQUIRED_NO_SNAPSHOT'
 when run.status in ('scanned', 'partial', 'verifying') then 'RECOVERY_REQUIRED_VERIFY' when run.status = 'verified' and head.snapshot_id is not null and head.status = 'partial' then 'PARTIAL' when run.status = 'verified' and head.snapshot_id is not null then 'COMPLETE'
 when run.status = 'failed' then 'FAILED' when run.status = 'cancelled' then 'CANCELLED' else 'INVALID' end disposition from run left join (select run_id, max(snapshot_id) snapshot_id, max(status) status from head group by 1) head using (run_id) where run_kind = 'filesystem.snapshot'""")
def mnt_10_dispositions(spark: SparkSession, d: str) -> DataFrame:
    head = _headers(spark, d).groupBy("run_id").agg(F.max("snapshot_id").alias("snapshot_id"), F.max("status").alias("snapshot_status"))
    j = _runs(spark, d).where("run_kind = 'filesystem.snapshot'").join(head, "run_id", "left")
    return j.select("run_id", ledger.disposition(F.col("status"), F.col("snapshot_id").isNotNull(), F.col("snapshot_status")).alias("disposition"))


@query(f"""with {_RUNS}, {_HEAD} select count(*) headers, count(*) filter (deleted_at is not null) deleted, count(*) filter (status <> 'complete') unfinished, count(*) filter (run_id is null or run_id not in (select run_id from run)) orphaned,
 case when count(*) filter (run_id is null or run_id not in (select run_id from run)) > 0 then 'DEGRADED' else 'HEALTHY' end storage_status from head""")
def agg_17_storage_status(spark: SparkSession, d: str) -> DataFrame:
    j = _headers(spark, d).join(_runs(spark, d).select("run_id", F.lit(True).alias("there")), "run_id", "left")
    out = j.agg(F.count(F.lit(1)).alias("headers"), F.count("deleted_at").alias("deleted"), F.count_if(F.col("status") != "complete").alias("unfinished"), F.count_if(F.col("there").isNull()).alias("orphaned"))
    return out.withColumn("storage_status", F.when(F.col("orphaned") > 0, "DEGRADED").otherwise("HEALTHY"))


@query(f"""with {_E}, c as (select s.snapshot_id, count(e.entry_id) n, s2.entry_count from series s join (select {_UUID.format('snapshot_id')} snapshot_id, entry_count from snapshots {_LATEST.format('lower(trim(snapshot_id))')}) s2 using (snapshot_id) left join e using (snapshot_id) group by 1, 3)
 select snapshot_id, n entries, entry_count declared, case when n = entry_count then 'VALID' else 'INCOMPLETE' end verdict from c""")
def ver_1_verification(spark: SparkSession, d: str) -> DataFrame:
    counted = _series(spark, d).select("snapshot_id").join(_headers(spark, d).select("snapshot_id", "entry_count"), "snapshot_id")
    n = _entries(spark, d).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(n, "snapshot_id", "left").select(
        "snapshot_id", F.coalesce("n", F.lit(0)).alias("entries"), F.col("entry_count").alias("declared"), F.when(F.coalesce("n", F.lit(0)) == F.col("entry_count"), "VALID").otherwise("INCOMPLETE").alias("verdict")
    )


@query(f"""with {_E} select snapshot_id, count(*) entries, count(*) filter (entry_id <> sha256(snapshot_id || chr(0) || scope_id || chr(0) || relative_path)) bad_ids, count(*) filter (size_bytes < 0) bad_sizes,
 count(*) filter (object_type not in ('regular_file', 'directory', 'symlink', 'fifo', 'socket', 'block_device', 'character_device', 'unknown')) bad_types, count(*) - count(distinct (scope_id, relative_path)) repeated from e group by 1""")
def ver_2_evidence_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every check of an entry is a column, so one aggregate answers them all."""
    from strataframe.operators.entries import OBJECT_TYPES

    made = F.sha2(F.concat_ws("\0", "snapshot_id", "scope_id", "relative_path"), 256)
    return _entries(spark, d).groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("entry_id") != made).alias("bad_ids"), F.count_if(F.col("size_bytes") < 0).alias("bad_sizes"), F.count_if(~F.col("object_type").isin(OBJECT_TYPES)).alias("bad_types"),
        (F.count(F.lit(1)) - F.count_distinct("scope_id", "relative_path")).alias("repeated"),
    )


@query(f"""with h as (select scope_ids[1] scope_id, {_UUID.format('snapshot_id')} snapshot_id, completed_at::timestamptz c from (select * from snapshots {_LATEST.format('lower(trim(snapshot_id))')}) where status = 'complete' and deleted_at is null),
 r as (select *, row_number() over (partition by scope_id order by c desc, snapshot_id desc) rn from h) select scope_id, max(snapshot_id) filter (rn = 1) newest, max(snapshot_id) filter (rn = 2) runner_up from r where rn <= 2 group by 1""")
def win_4_recent_pair(spark: SparkSession, d: str) -> DataFrame:
    c = latest(table(spark, d, "snapshots").select(uuid_key(F.col("snapshot_id")).alias("snapshot_id"), instant(F.col("completed_at")).alias("c"), "recorded_at"), ["snapshot_id"], ["c"])
    s = _series(spark, d).join(c, "snapshot_id")
    r = s.withColumn("rn", F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("c"), F.desc("snapshot_id")))).where("rn <= 2")
    return r.groupBy("scope_id").agg(F.max(F.when(F.col("rn") == 1, F.col("snapshot_id"))).alias("newest"), F.max(F.when(F.col("rn") == 2, F.col("snapshot_id"))).alias("runner_up"))
