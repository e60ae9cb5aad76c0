from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions.paths import ancestors_or_self, below, below_ascii_folded, is_valid, parent, suffix
from strataframe.operators import diff, duplicates, relations, selection, structure

FIELDS = (
    "snapshot_id string, pair string, scope_id string, relative_path string, object_type string, device_id bigint, inode bigint, mode int, uid int, gid int, size_bytes bigint, mtime_ns bigint, ctime_ns bigint, birthtime_ns bigint, link_count int, "
    "symlink_target_raw string, readable boolean, writable boolean, executable boolean, observation_status string, error_code string, error_message string, excluded boolean, allocated_size_bytes bigint, p_status string, p_algorithm string, "
    "p_algorithm_version int, p_digest string, p_bytes_hashed bigint, p_provenance string, p_reused_from_snapshot_id string, p_failure_code string"
)
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def entry(path, snapshot="s", scope="managed", digest="a" * 64, **more):
    kind = more.get("object_type", "regular_file")
    size = more.get("size_bytes", 10)
    row = dict(
        snapshot_id=snapshot, pair="t", scope_id=scope, relative_path=path, object_type=kind, device_id=1, inode=10, mode=420, uid=1, gid=2, size_bytes=10, mtime_ns=20, ctime_ns=30, birthtime_ns=5, link_count=1, symlink_target_raw=None,
        readable=True, writable=True, executable=False, observation_status="observed", error_code=None, error_message=None, excluded=False, allocated_size_bytes=16, p_status="HASHED", p_algorithm="sha256", p_algorithm_version=1, p_digest=digest,
        p_bytes_hashed=size, p_provenance="DIRECT_READ", p_reused_from_snapshot_id=None, p_failure_code=None,
    ) | more
    return tuple(row[n] for n in NAMES)


def frame(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def test_paths(spark):
    rows = [(".",), ("a",), ("a/b/C.Txt",), ("/x",), ("a//b",), ("a/../b",), (".hidden",), (None,)]
    p = F.col("p")
    got = spark.createDataFrame(rows, "p string").select(p, parent(p).alias("up"), is_valid(p).alias("ok"), suffix(p).alias("s"), ancestors_or_self(p).alias("all")).collect()
    assert [r.up for r in got[:3]] == [".", ".", "a/b"] and [r.ok for r in got] == [True, True, True, False, False, False, True, False]
    assert got[2].s == ".txt" and got[6].s == "" and got[2]["all"] == [".", "a", "a/b", "a/b/C.Txt"]
    q = spark.createDataFrame([("Depot",), ("Depot/x",), ("depot/x",), ("Depot2",)], "p string")
    assert q.where(below(p, "Depot")).count() == 2 and q.where(below_ascii_folded(p, "Depot")).count() == 3 and q.where(below(p, None)).count() == 4


def test_structure_hand_case(spark):
    rows = [
        entry(".", object_type="directory"), entry("top", size_bytes=5), entry("zero", size_bytes=0), entry("docs", object_type="directory"), entry("docs/paper"), entry("docs/missing", size_bytes=None, observation_status="io_error"),
        entry("docs/link", object_type="symlink"), entry("docs/fifo", object_type="fifo"), entry("docs/excluded", size_bytes=7, excluded=True),
    ]
    got = {r.path: r for r in structure.structure(frame(spark, rows)).collect()}
    root, docs = got["."], got["docs"]
    assert (root.direct_regular_count, root.recursive_regular_count, root.direct_known_bytes, root.recursive_known_bytes, root.recursive_unknown_count, root.recursive_directory_count) == (2, 4, 5, 15, 1, 2)
    assert (docs.direct_regular_count, docs.recursive_known_bytes, docs.recursive_unknown_count, docs.recursive_symlink_count, docs.recursive_special_count) == (2, 10, 1, 1, 1)
    cover = structure.structure_coverage(frame(spark, rows)).first()
    assert (cover.known_bytes, cover.known_regular, cover.unknown_regular, cover.excluded_count, cover.metadata_failed, cover.complete) == (15, 3, 1, 1, 1, False)


def test_synthesised_directories_and_scopes_without_entries(spark):
    rows = frame(spark, [entry("a/b/c.txt", size_bytes=3), entry("unicodé/file.txt", size_bytes=4)])
    scopes = spark.createDataFrame([("s", "managed"), ("s", "empty")], "snapshot_id string, scope_id string")
    got = {(r.scope_id, r.path): (r.observed, r.recursive_known_bytes) for r in structure.structure(rows.repartition(5), scopes).collect()}
    assert got == {("managed", "."): (False, 7), ("managed", "a"): (False, 3), ("managed", "a/b"): (False, 3), ("managed", "unicodé"): (False, 4), ("empty", "."): (False, 0)}


def test_growth_hand_case(spark):
    base = [entry("removed", size_bytes=7), entry("larger", size_bytes=3), entry("smaller", size_bytes=9), entry("same", size_bytes=4), entry("odd", size_bytes=None)]
    target = [entry("added", size_bytes=5), entry("larger", size_bytes=8), entry("smaller", size_bytes=2), entry("same", size_bytes=4), entry("odd", size_bytes=1)]
    grown = structure.growth(frame(spark, base), frame(spark, target))
    kinds = {r.relative_path: (r.kind, r.delta) for r in grown.collect()}
    assert kinds == {
        "removed": ("REMOVED_LOCATION", -7), "added": ("ADDED_LOCATION", 5), "larger": ("SAME_LOCATION_SIZE_INCREASE", 5), "smaller": ("SAME_LOCATION_SIZE_DECREASE", -7), "same": ("SAME_LOCATION_SIZE_UNCHANGED", 0), "odd": ("SIZE_UNKNOWN", None)
    }
    root = structure.growth_nodes(grown).first()
    assert (root.recursive_added_bytes, root.recursive_removed_bytes, root.recursive_increase_bytes, root.recursive_decrease_bytes, root.recursive_net_bytes, root.recursive_unknown_count) == (5, 7, 5, 7, -4, 1)
    assert structure.growth_coverage(grown).first().complete is False


def test_diff_is_symmetric_and_null_safe(spark):
    base, target = frame(spark, [entry("a"), entry("b", size_bytes=None), entry("c")]), frame(spark, [entry("a", size_bytes=11, mode=1), entry("b", size_bytes=None), entry("d")])
    got = {r.relative_path: (r.change_type, r.changed_fields) for r in diff.snapshot_diff(base, target).collect()}
    assert got == {"a": ("MODIFIED", ["mode", "size_bytes"]), "b": ("UNCHANGED", []), "c": ("REMOVED", []), "d": ("ADDED", [])}
    back = {r.relative_path: r.change_type for r in diff.snapshot_diff(target, base).collect()}
    assert back == {"a": "MODIFIED", "b": "UNCHANGED", "c": "ADDED", "d": "REMOVED"}
    events = {r.relative_path: (r.event_type, r.size_delta, r.metadata_changed) for r in diff.change_events(diff.snapshot_diff(base, target)).collect()}
    assert events == {"a": ("FILE_MODIFIED", 1, True), "c": ("FILE_DELETED", None, False), "d": ("FILE_CREATED", None, False)}


def test_duplicates_hand_cases(spark):
    group = lambda rows: duplicates.payload_groups(frame(spark, rows)).collect()
    (g,) = group([entry("a", inode=1), entry("b", inode=2)])
    assert (g.is_exact_duplicate, g.known_units, g.unknown_units, g.redundant_bytes) == (True, 2, 0, 10)
    (g,) = group([entry("a", link_count=2), entry("b", link_count=2)])
    assert (g.is_exact_duplicate, g.known_units, g.redundant_bytes) == (False, 1, None)
    (g,) = group([entry("a", inode=None), entry("b", inode=None)])
    assert (g.known_units, g.unknown_units, g.redundant_bytes) == (0, 2, None)
    assert group([entry("a", inode=1), entry("b", inode=2, size_bytes=11)]) == []  # one digest, two sizes
    codes = {r.code for r in duplicates.hint_conflicts(frame(spark, [entry("a", link_count=1), entry("b", size_bytes=12, allocated_size_bytes=32)])).collect()}
    assert codes == {"OBJECT_HINT_PAYLOAD_CONFLICT", "OBJECT_HINT_SIZE_CONFLICT", "LINK_COUNT_CONFLICT", "ALLOCATED_SIZE_CONFLICT"}
    assert duplicates.alias_sets(frame(spark, [entry("a"), entry("b")])).first().paths == 2


def test_relation_taxonomy_in_its_order(spark):
    cases = {
        "same": ({}, {}, "CONTINUITY"), "meta": ({}, {"mode": 1}, "METADATA_CHANGED"), "content": ({}, {"p_digest": "b" * 64}, "CONTENT_CHANGED"), "unknown": ({}, {"p_status": "NOT_LOCAL", "p_digest": None}, "CONTENT_UNKNOWN"),
        "object": ({}, {"inode": 99, "p_digest": "b" * 64}, "OBJECT_HINT_CHANGED"), "type": ({}, {"object_type": "directory"}, "TYPE_CHANGED"), "born": ({}, {"birthtime_ns": None}, "CONTINUITY"),
        "link": ({"object_type": "symlink", "symlink_target_raw": "x"}, {"object_type": "symlink", "symlink_target_raw": "y"}, "SYMLINK_TARGET_CHANGED"), "failed": ({"observation_status": "io_error"}, {}, None),
    }
    got = {r.relative_path: r.kind for r in relations.same_location(frame(spark, [entry(p, **b) for p, (b, _, _) in cases.items()]), frame(spark, [entry(p, **t) for p, (_, t, _) in cases.items()])).collect()}
    assert got == {p: f"SAME_LOCATION_{k}" for p, (_, _, k) in cases.items() if k}


def test_transitions(spark):
    kind = lambda b, t: [(r.kind, r.sources, r.targets) for r in relations.transitions(frame(spark, b), frame(spark, t)).collect()]
    assert kind([entry("a")], [entry("b")]) == [("RENAME_CANDIDATE", 1, 1)]
    assert kind([entry("a")], [entry("b", scope="other")]) == [("CROSS_SCOPE_TRANSITION_CANDIDATE", 1, 1)]
    assert kind([entry("a"), entry("stays")], [entry("b"), entry("stays")]) == [("AMBIGUOUS_LOCATION_TRANSITION", 2, 2)]
    assert kind([entry("a")], [entry("b", inode=77)]) == [] and kind([entry("a")], [entry("b", p_status="IO_ERROR", p_digest=None)]) == []


def test_selections(spark):
    rows = spark.createDataFrame([("g", s, f"p{i}", c) for i, (s, c) in enumerate([("a", 1), ("a", 0), ("b", 1), ("b", 1), ("c", 3), ("c", 0)])], "g string, scope string, path string, channel int")
    fair = selection.fair_selection(rows, "g", "scope", "channel", ["path"], 4)
    assert sorted((r.path, r.selected_as) for r in fair.collect()) == [("p0", "CHANNEL"), ("p1", "SCOPE_MINIMUM"), ("p2", "SCOPE_MINIMUM"), ("p5", "SCOPE_MINIMUM")]
    quota = selection.quota_selection(rows, "g", "scope", "channel", ["path"], 6, 1, {1: 2, 3: 0})
    assert sorted(r.path for r in quota.collect()) == ["p0", "p1", "p2", "p5"]
    page = selection.page(rows, [F.col("path")], 2, 3).collect()
    assert [(r.path, r.has_more) for r in page] == [("p3", True), ("p4", True)]
    for bad in ((0, 0), (1001, 0), (True, 0), (5, -1)):
        try:
            selection.check_page(*bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert rows.select(selection.even_positions(F.lit(7), 4).alias("x")).first().x == [0, 2, 4, 6] and rows.select(selection.even_positions(F.lit(7), 1).alias("x")).first().x == [0]
