from __future__ import annotations

import random

import pytest

from strataframe.operators.hierarchy import descendants, resolve, tree_nodes, with_descendant_counts


def _brute(parents):
    out = {}
    for n in parents:
        seen, at = [n], n
        while parents[at] is not None and parents[at] in parents and parents[at] not in seen:
            at = parents[at]
            seen.append(at)
        root = parents[at] is None or parents[at] not in parents
        out[n] = (at, len(seen) - 1, tuple(reversed(seen))) if root else ("", -1, None)
    return out


@pytest.mark.parametrize("split", [1, 2, 8, 1_000_000])
def test_random_forests_with_cycles(spark, split):
    rng = random.Random(split)
    parents = {f"n{i}": (None if rng.random() < 0.05 else f"n{rng.randrange(400)}") for i in range(300)}
    parents |= {f"c{i}": (f"c{i - 1}" if i else None) for i in range(130)}  # a deep chain
    parents |= {f"z{i}": f"z{(i + 1) % 37}" for i in range(37)} | {"self": "self", "below": "self"}
    df = spark.createDataFrame([("t", n, p, 1, "clash") for n, p in parents.items()], "tree string, node string, parent string, at int, root string")
    got = {r.node: (r.root, r.depth, tuple(r.path) if r.path else None) for r in resolve(tree_nodes(df, "tree", "node", "parent", "at"), paths=True, split=split).collect()}
    assert got == _brute(parents)


def test_nodes_and_their_dirt(spark):
    rows = [("d", " a ", None, 1), ("d", "a", " ", 2), ("d", "b", " a", 1), ("d", "b", None, 9), ("d", None, "a", 1), ("d", "c", "gone", 1), ("e", "b", "a", 1), (None, "x", None, 1)]
    df = spark.createDataFrame(rows, "doc string, n string, p string, at int")
    got = sorted((r.tree, r.node, r.root, r.depth) for r in resolve(tree_nodes(df, "doc", "n", "p", "at")).collect())
    assert got == [("", "x", "x", 0), ("d", "a", "a", 0), ("d", "b", "a", 1), ("d", "c", "c", 0), ("e", "b", "b", 0)]


def test_descendants_and_empty_input(spark):
    df = spark.createDataFrame([("d", "a", None, 1), ("d", "b", "a", 1), ("d", "c", "b", 1)], "doc string, n string, p string, at int")
    solved = resolve(tree_nodes(df, "doc", "n", "p", "at"), paths=True)
    assert sorted((r.ancestor, r.descendant, r.distance) for r in descendants(solved).collect()) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert {r.node: r.n_descendants for r in with_descendant_counts(solved).collect()} == {"a": 2, "b": 1, "c": 0}
    assert resolve(tree_nodes(df.limit(0), "doc", "n", "p", "at"), paths=True).count() == 0
