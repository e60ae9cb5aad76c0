from __future__ import annotations

import random

from strataframe.operators.changes import intervals
from strataframe.operators.history import versions

SCHEMA = "k string, pos int, digest string, size bigint, pos_extra string, word int"


def _brute(rows):
    """Versions of one key by a plain walk: {position: (digest, size)} to [(from, to)]."""
    out, last = [], None
    for p in sorted(rows):
        d, s = rows[p]
        if last is None or p - 1 not in rows:
            out.append([p, None])
            last = [d, s]
        else:
            if (d is not None and last[0] is not None and d != last[0]) or (s is not None and last[1] is not None and s != last[1]):
                out[-1][1] = p
                out.append([p, None])
            last = [d if d is not None else last[0], s if s is not None else last[1]]
        if p + 1 not in rows:
            out[-1][1] = p + 1
            last = None
    return [tuple(x) for x in out]


def _random_keys(n, seed, longest):
    rng, keys = random.Random(seed), {}
    for i in range(n):
        length = rng.choice([1, 3, 8, longest])
        keep, known = rng.choice([0.5, 0.9, 1.0]), rng.choice([0.2, 0.7, 1.0])
        pick = lambda v: v if rng.random() < known else None  # noqa: E731, B023
        keys[f"k{i}"] = {p: (pick(rng.choice("ab")), pick(rng.choice([1, 2]))) for p in range(1, length + 1) if rng.random() < keep}
    return keys


def test_versions_equal_a_plain_walk_over_short_and_long_series(spark):
    keys = _random_keys(60, 3, 200)
    rows = [(k, p, d, s, "x", 7) for k, ps in keys.items() for p, (d, s) in ps.items()]
    df = spark.createDataFrame(rows + rows[:50], SCHEMA)  # repeated rows, and columns whose names clash with inner ones
    got = versions(df, ["k"], ["digest", "size"])
    found = {}
    for r in got.collect():
        found.setdefault(r.k, []).append((r.from_pos, r.to_pos))
    assert {k: sorted(v) for k, v in found.items()} == {k: _brute(ps) for k, ps in keys.items() if ps}


def test_versions_do_not_depend_on_partitions(spark):
    rows = [("a", p, "d" if p % 70 < 40 else "e", None, None, None) for p in range(1, 180)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = versions(df.repartition(1), ["k"], ["digest", "size"]), versions(df.repartition(7), ["k"], ["digest", "size"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_unknown_values_change_nothing(spark):
    rows = [("a", 1, None, 5), ("a", 2, "x", None), ("a", 3, None, 5), ("a", 4, "x", 6), (None, 1, None, None)]
    got = versions(spark.createDataFrame(rows, "k string, pos int, digest string, size bigint"), ["k"], ["digest", "size"])
    assert sorted((str(r.k), r.from_pos, r.to_pos, r.digest, r.size) for r in got.collect()) == [("None", 1, 2, None, None), ("a", 1, 4, "x", 5), ("a", 4, 5, "x", 6)]


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "k string, pos int, digest string, size bigint")
    assert versions(df, ["k"], ["digest", "size"]).count() == 0
    assert intervals(df, ["k"], ["digest", "size"]).count() == 0


def test_intervals_by_gaps_and_known_differences(spark):
    rows = [("a", 1, "x", 1), ("a", 2, None, 1), ("a", 3, "y", 1), ("a", 5, "y", 1), ("a", 6, "y", 2), ("a", 6, "y", 2)]
    got = intervals(spark.createDataFrame(rows, "k string, pos int, digest string, size bigint"), ["k"], ["digest", "size"])
    # 2 to 3 is no change: the digest is unknown at 2; 4 is a gap; 6 changes size.
    assert sorted((r.from_pos, r.to_pos, r.adjacent) for r in got.collect()) == [(1, 3, False), (5, 5, False), (6, 6, True)]
