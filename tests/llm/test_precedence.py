from __future__ import annotations

import random

import pytest

from strataframe.llm import transcripts
from tests.llm.test_transcripts import segments


def plain(rows):
    """Edges by priority, each dropped if it closes a cycle with those kept before; then the least item whose sources are all out."""
    rows = sorted(rows)
    time = {i: (int(t[1 : t.index("s]")]) * 1000 if t.startswith("[") else s) for i, t, s in rows}
    place, opens, last = {}, {}, None
    for i, t, _ in rows:
        last = time[i] if time[i] is not None else last
        place[i], opens[i] = last or 0, ":" in t
    timing = [(a, b) for a in place for b in place if place[a] < place[b]]
    cue = [(rows[k][0], rows[k + 1][0]) for k in range(len(rows) - 1)]
    talk = [(max(j for j in opens if j < i and opens[j]), i) for i in opens if not opens[i] and any(opens[j] for j in opens if j < i)]
    kept, dropped = set(timing), {i: [] for i in place}

    def reaches(a, b):
        todo, seen = [a], set()
        while todo:
            x = todo.pop()
            if x == b:
                return True
            todo += [q for p, q in kept if p == x and q not in seen]
            seen |= set(todo)
        return False

    for kind, edges in (("cue", cue), ("dialogue", talk)):
        for a, b in edges:
            if reaches(b, a):
                dropped[b].append(kind)
            else:
                kept.add((a, b))
    return dropped, kept


def test_edges_conflicts_and_order_against_a_plain_graph(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "ITEM_BLOCK", 4)
    for seed in range(3):
        rng = random.Random(seed)
        times = rng.sample(range(1, 90), 24)
        rows = []
        for i in range(24):
            name = rng.choice(["Reviewer: ", "Operator: ", "", ""])
            at = rng.choice([None, times[i], times[i]])
            stamped = at is not None and rng.random() < 0.3
            rows.append((i * 2, (f"[{at}s] " if stamped else "") + name + "word", None if at is None or stamped else at * 1000))
        df = transcripts.ordered_segments(segments(spark, rows)).where("doc = 'd'").orderBy("start", "ord")
        got = df.collect()
        dropped, kept = plain(rows)
        assert {r.item: r.dropped for r in got} == dropped and any(dropped.values())
        at = {r.item: n for n, r in enumerate(got)}
        assert all(at[a] < at[b] for a, b in kept)


def test_topological_order():
    assert transcripts.topological_order([(5, 9, None), (9, None, 7), (7, None, None), (1, 100, None)]) == [1, 7, 9, 5]
    assert transcripts.topological_order([]) == []
    with pytest.raises(ValueError):
        transcripts.topological_order([(1, 2, None), (2, 1, None)])
