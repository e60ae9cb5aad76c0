from __future__ import annotations

from strataframe.operators.history import versions
from tests.test_history import SCHEMA, _brute, _random_keys


def _first(rows, a, b, k):
    return next((rows[p][k] for p in range(a, b) if rows[p][k] is not None), None)


def test_values_known_only_in_a_later_word(spark):
    keys = _random_keys(60, 11, 300)
    keys |= {
        "late": {p: ("d" if p == 150 else None, 5 if p == 64 else None) for p in range(60, 200)}, "never": {p: (None, None) for p in range(1, 140)},
        "cut": {p: ("d" if p == 70 else None, 5) for p in range(60, 90) if p != 64}, "next": {p: (None if p < 130 else "e", 1 if p < 130 else 2) for p in range(1, 200)},
    }
    rows = [(k, p, d, s, "x", 7) for k, ps in keys.items() for p, (d, s) in ps.items()]
    got = {(r.k, r.from_pos, r.to_pos, r.digest, r.size) for r in versions(spark.createDataFrame(rows, SCHEMA), ["k"], ["digest", "size"]).collect()}
    assert got == {(k, a, b, _first(ps, a, b, 0), _first(ps, a, b, 1)) for k, ps in keys.items() if ps for a, b in _brute(ps)}
    assert {("late", 60, 200, "d", 5), ("never", 1, 140, None, None), ("cut", 60, 64, None, 5)} <= got
