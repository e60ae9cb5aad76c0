from __future__ import annotations

import random
from collections import Counter, defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from strataframe.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=20))
def test_plan_places_every_item_once_and_fits(histogram):
    rows = packing.plan(histogram, (16, 32, 64), 4)
    placed, used, caps, counts = Counter(), defaultdict(int), {}, defaultdict(int)
    for length, a, b, per, first, cap in rows:
        assert (b - a) % per == 0
        placed[length] += b - a
        counts[first] = (b - a) // per
        used[first] += length * per
        caps[first] = cap
    assert placed == Counter(histogram)
    assert all(used[f] <= caps[f] for f in used) and all(c == 16 or used[f] > c / 2 for f, c in caps.items())
    total, best = sum(k * v for k, v in histogram.items()), sum(counts.values())
    assert best <= 11 / 9 * max(1, -(-total // 64)) * 1.8 + 4


def test_fill_is_high():
    rng = random.Random(1)
    histogram = Counter(min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(20_000))
    rows = packing.plan(histogram)
    space = sum(cap * ((b - a) // per) for first, (a, b, per, cap) in {r[4]: (r[1], r[2], r[3], r[5]) for r in rows}.items())
    assert sum(k * v for k, v in histogram.items()) / space > 0.995


def test_packed_rows(spark):
    rows = [(1, 5000, "x"), (2, 0, "x"), (3, 2048, "x"), (4, 2049, "x"), (5, 7, "x"), (5, 7, "x")] + [(100 + i, 300, "x") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, length string")
    got = packing.packed(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert sorted(r.n_tokens for r in by[1]) == [904, 2048, 2048] and sorted((r.part_no, r.start_token) for r in by[1]) == [(0, 0), (1, 2048), (2, 4096)]
    assert sorted(r.n_tokens for r in by[4]) == [1, 2048] and by[2][0].container_id is None and len(by[5]) == 2
    held = defaultdict(int)
    for r in got:
        if r.container_id is not None:
            held[(r.container_id, r.capacity, r.container_tokens)] += r.n_tokens
    assert all(n == t <= c for (_, c, t), n in held.items()) and len({k[0] for k in held}) == len(held)
    again = packing.packed(df.repartition(7).orderBy("n_tokens")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert packing.packed(df.limit(0)).count() == 0


def test_token_lengths(spark):
    df = spark.createDataFrame([("a", "Hello world"), ("b", None), ("c", ""), ("d", "<|endoftext|>"), (None, "x")], "k string, t string")
    got = {r.doc_id: r.n_tokens for r in packing.token_lengths(df, "k", "t").collect()}
    count = packing.token_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert got == {"a": 2, "b": 0, "c": 0, "d": count(["<|endoftext|>"])[0]} and got["d"] > 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1, max_size=20))
def test_best_plan_is_never_worse_than_one_size_alone(histogram):
    rows = packing.best_plan(histogram, (16, 32, 64), 4)
    placed = Counter()
    for length, a, b, _, _, _ in rows:
        placed[length] += b - a
    space, n = packing.unused(rows)
    alone = packing.unused(packing.plan(histogram, (64,), 0))
    assert placed == Counter(histogram) and 0 <= space <= alone[0] and packing.best_plan({}) == []
