"""Filling containers of fixed capacity with token sequences, by variable-capacity best fit on a histogram."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.functions.latest import checkpointed
from strataframe.operators.series import numbered

#: Permitted container sizes in tokens, the price of a container besides its size, in tokens, and the prices at which containers may be opened.
CAPACITIES, OVERHEAD = (256, 512, 1024, 2048), 64
PRICES = (0, 4, 16, 64, 256, 1024)
#: Parts into which the rows of one length are spread to be counted off.
SPREAD = 256


def token_counter(path: str, pattern: str):
    """A function from texts to their numbers of tokens, for a rank file of a public byte-level tokenizer."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(own.encode_ordinary(t)) for t in texts]


def token_lengths(documents: DataFrame, doc_id: str, text: str, tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens; a null text has 0 tokens.

    ``tokenizer`` and ``pattern``: path of a rank file and its splitting pattern; where one isn't given, that of the
    public 50k one, which the module ``public_tokenizers`` of the installation knows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, splits = tokenizer, pattern
        if path is None or splits is None:
            import public_tokenizers

            path, splits = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), splits or public_tokenizers.PATTERN
        size = token_counter(path, splits)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["d"], "n_tokens": size(b["t"])}).astype({"n_tokens": "int64"})

    kind = documents.schema[doc_id].dataType.simpleString()
    own = documents.select(F.col(doc_id).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("d is not null")
    return own.mapInPandas(count, f"doc_id {kind}, n_tokens bigint")


def plan(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go: (length, from rank, to rank, per container, first container, capacity).

    Best fit in decreasing length, on counts instead of items: containers with the same contents are one group,
    so the work and the plan are bounded by the capacity, not by the data. An item goes to the fullest open
    container it fits in. Where there is none, one opens of the size that would hold all tokens still to place
    at the least cost (size and overhead of each container), of those the item fits in. At the end each
    container shrinks to the least permitted size that holds its contents.
    """
    sizes = sorted(capacities)
    todo = sum(x * n for x, n in histogram.items() if x > 0)
    groups: dict[int, list[list]] = defaultdict(list)  # room left -> [containers, {length: copies}]
    rooms: list[int] = []

    def put(room: int, n: int, held: dict[int, int]) -> None:
        if not groups[room]:
            insort(rooms, room)
        groups[room].append([n, held])

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left = histogram[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                n, held = groups[room].pop()
                if not groups[room]:
                    rooms.pop(k)
            else:
                room = min((c for c in sizes if c >= length), key=lambda c: (-(-todo // c) * (c + overhead), -c))
                # As many at once as can be filled while this size stays the cheapest: all of them, or one.
                n, held = max(1, min(-(-left // (room // length)), todo // room)), {}
            before = left
            fit = room // length
            full = min(n, left // fit)
            if full:
                put(room - fit * length, full, held | {length: held.get(length, 0) + fit})
                left -= full * fit
            n -= full
            if n and left:
                rest = left
                put(room - rest * length, 1, held | {length: held.get(length, 0) + rest})
                left, n = 0, n - 1
            if n and held:
                put(room, n, held)
            todo -= (before - left) * length
    out, first, ranks = [], 0, defaultdict(int)
    final = [(held, n) for room in sorted(groups) for n, held in groups[room] if held]
    for held, n in final:
        used = sum(x * c for x, c in held.items())
        cap = next(c for c in sizes if c >= used)
        for length, c in held.items():
            out.append((length, ranks[length], ranks[length] + c * n, c, first, cap))
            ranks[length] += c * n
        first += n
    return out


def unused(rows: list[tuple[int, int, int, int, int, int]]) -> tuple[int, int]:
    """(tokens of space left empty, containers) of a plan."""
    tokens = sum(length * (b - a) for length, a, b, _, _, _ in rows)
    groups = {first: (cap, (b - a) // per) for _, a, b, per, first, cap in rows}
    return sum(cap * n for cap, n in groups.values()) - tokens, sum(n for _, n in groups.values())


def best_plan(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> list[tuple[int, int, int, int, int, int]]:
    """The plan of least cost: all its containers' sizes, and ``overhead`` for each.

    The price at which containers are opened decides how early small ones come in, and which price does best
    depends on the lengths. So the plans of several prices and that of the largest size alone are made, which
    is little work on a histogram, and compared as they are once downsized. None that leaves more space empty
    than the largest size alone is taken.
    """
    one = plan(histogram, (max(capacities),), 0)
    alone = plan(histogram, capacities, 1 << 40)
    limit = min(unused(one), unused(alone))[0]
    plans = [alone] + [plan(histogram, capacities, p) for p in sorted({*PRICES, overhead})]
    fair = [p for p in plans if unused(p)[0] <= limit] or [one]
    return min(fair, key=lambda p: (unused(p)[0] + overhead * unused(p)[1], unused(p)[1]))


def packed(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """Pieces and their containers: doc_id, part_no, start_token, n_tokens, container_id, capacity, container_tokens.

    A text of more tokens than the largest capacity is cut into full pieces and a rest; no other is split. A
    text without tokens needs no container: container_id is null, capacity 0. The result depends only on the
    rows, not on their order; repeated rows are packed each.

    Only the histogram of lengths (at most one row per possible length) comes to the driver. Every piece gets
    its rank within its length, counted off in parts so that a common length is no hot spot, and meets the
    plan's rows of its length in a join.
    """
    spark, top = lengths.sparkSession, max(capacities)
    pieces = lengths.select("doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / top) - 1).cast("int"))).alias("part_no", "_i")).select(
        "doc_id", "part_no", (F.col("part_no") * top).cast("bigint").alias("start_token"),
        F.least(F.lit(top), F.col("n_tokens") - F.col("part_no") * top).cast("int").alias("length"),
    )
    pieces = checkpointed(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(SPREAD)).cast("int")))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = best_plan(histogram, capacities, overhead)
    used: dict[int, int] = defaultdict(int)
    for length, _, _, c, first, _ in rows:
        used[first] += length * c
    schema = "length int, from_rank bigint, to_rank bigint, per bigint, first bigint, capacity int, container_tokens int"
    table = spark.createDataFrame([(*r, used[r[4]]) for r in rows], schema)
    ranked = numbered(pieces, ["length"], "bucket", [F.col("doc_id"), F.col("part_no")], "rank").withColumn("rank", F.col("rank").cast("bigint") - 1)
    p = F.broadcast(table).alias("p")  # bounded by the capacity, see plan()
    r = ranked.alias("r")
    on = (F.col("r.length") == F.col("p.length")) & (F.col("r.rank") >= F.col("p.from_rank")) & (F.col("r.rank") < F.col("p.to_rank"))
    return r.join(p, on, "left").select(
        "r.doc_id", "r.part_no", "r.start_token", F.col("r.length").alias("n_tokens"),
        (F.col("p.first") + F.floor((F.col("r.rank") - F.col("p.from_rank")) / F.col("p.per"))).cast("bigint").alias("container_id"),
        F.coalesce("p.capacity", F.lit(0)).alias("capacity"), F.coalesce("p.container_tokens", F.lit(0)).alias("container_tokens"),
    )


def fill_report(pieces: DataFrame) -> DataFrame:
    """Containers, their tokens and unused space per capacity."""
    each = pieces.where("container_id is not null").groupBy("container_id", "capacity").agg(F.sum("n_tokens").alias("used"))
    return each.groupBy("capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum(F.col("capacity") - F.col("used")).alias("unused")
    )
