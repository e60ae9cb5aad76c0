"""Evaluation texts leaking into a corpus, by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.functions.latest import checkpointed
from strataframe.llm.textnorm import words

#: Words of a search pattern; words of a block of the shift table; least words of a stretch; least share of an
#: item's words; items that share an opening sentence before it counts as an instruction, and its least words.
PATTERN, BLOCK, STRETCH, SHARE, SHARED_BY, SHARED_WORDS = 5, 2, 10, 0.25, 3, 5
#: Least share of equal words in a stretch; sentences of one pattern with other words in its slots stay below it.
EQUAL = 0.82
#: Words of evaluation items that one search holds; larger sets are searched in blocks of this size.
BLOCK_WORDS = 1_000_000
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]+")


@dataclass
class Matcher:
    """Search tables of a block of items. ``items``: id to word numbers, without the shared instruction."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    items: dict[int, list[int]] = field(default_factory=dict)
    shift: dict[tuple[int, ...], int] = field(default_factory=dict)
    buckets: dict[tuple[int, ...], list[tuple[tuple[int, ...], tuple[int, ...]]]] = field(default_factory=dict)
    triples: dict[tuple[int, ...], int] = field(default_factory=dict)
    places: dict[int, dict[int, list[int]]] = field(default_factory=dict)


def openings(texts: Iterable[str]) -> set[tuple[str, ...]]:
    """Opening sentences, as words, that at least ``SHARED_BY`` items share."""
    seen = Counter(w for text in texts if (w := opening(text)))
    return {w for w, n in seen.items() if n >= SHARED_BY}


def opening(text: str) -> tuple[str, ...] | None:
    """Words of the opening sentence; null if it has too few."""
    m = _SENTENCE.match(text.strip())
    return w if m and len(w := tuple(words(m.group()))) >= SHARED_WORDS else None


def item_words(text: str, instructions: set[tuple[str, ...]]) -> list[str]:
    """Words of an item without its shared opening instruction."""
    w = words(text)
    for i in sorted(instructions, key=len, reverse=True):
        if tuple(w[: len(i)]) == i:
            return w[len(i) :]
    return w


def compile_items(items: Iterable[tuple[int, list[str]]]) -> Matcher:
    """Shift table, suffix buckets and word places of the items."""
    m = Matcher()
    holders: dict[tuple[int, ...], set[int]] = defaultdict(set)
    for key, text in items:
        ids = [m.vocabulary.setdefault(w, len(m.vocabulary)) for w in text]
        m.items[key] = ids
        at: dict[int, list[int]] = defaultdict(list)
        for i in range(len(ids) - 2):
            at[m.triples.setdefault(tuple(ids[i : i + 3]), len(m.triples))].append(i)
        m.places[key] = dict(at)
        for i in range(len(ids) - PATTERN + 1):
            holders[tuple(ids[i : i + PATTERN])].add(key)
    buckets: dict[tuple[int, ...], list[tuple[tuple[int, ...], tuple[int, ...]]]] = defaultdict(list)
    for pattern, keys in holders.items():
        for end in range(BLOCK, PATTERN + 1):
            block, skip = pattern[end - BLOCK : end], PATTERN - end
            if skip < m.shift.get(block, PATTERN - BLOCK + 1):
                m.shift[block] = skip
        buckets[pattern[-BLOCK:]].append((pattern, tuple(sorted(keys))))
    m.buckets = dict(buckets)
    return m


def candidates(m: Matcher, doc: list[int]) -> set[int]:
    """Items of which the document has a pattern. ``doc``: word numbers, -1 for words of no item."""
    found: set[int] = set()
    at, n, most = PATTERN - 1, len(doc), PATTERN - BLOCK + 1
    shift, buckets = m.shift.get, m.buckets
    while at < n:
        w = doc[at]
        if w < 0:  # a word of no item: no pattern reaches over it
            at += PATTERN
            continue
        block = (doc[at - 1], w)
        skip = shift(block, most)
        if skip:
            at += skip
            continue
        window = tuple(doc[at - PATTERN + 1 : at + 1])
        for pattern, keys in buckets.get(block, ()):
            if pattern == window:
                found.update(keys)
        at += 1
    return found


def enough(places: dict[int, list[int]], common: Iterable[int], size: int) -> bool:
    """Whether the item's places of word triples that the document has (``common``) can suffice.

    A stretch of n words has at least EQUAL n equal ones in at most (1 - EQUAL) n + 1 runs, so at least
    (3 EQUAL - 2) n - 2 places of triples; stretches have STRETCH words or more and SHARE of the item in all.
    """
    return sum([len(places[t]) for t in common]) >= SHARE * size * (3 * EQUAL - 2 - 2 / STRETCH)


def _extended(item: list[int], doc: list[int], i: int, shift: int) -> tuple[int, int, int]:
    """From, to and equal words of the stretch around the equal triple at ``i``: over single words that differ if two equal ones follow."""
    a, b, same, n, m = i, i + 3, 3, len(item), len(doc)
    while a and a + shift:
        x = a + shift
        if item[a - 1] == doc[x - 1]:
            a, same = a - 1, same + 1
        elif a > 2 and x > 2 and item[a - 2] == doc[x - 2] and item[a - 3] == doc[x - 3]:
            a, same = a - 3, same + 2
        else:
            break
    while b < n:
        x = b + shift
        if x < m and item[b] == doc[x]:
            b, same = b + 1, same + 1
        elif b + 2 < n and x + 2 < m and item[b + 1] == doc[x + 1] and item[b + 2] == doc[x + 2]:
            b, same = b + 3, same + 2
        else:
            break
    return a, b, same


def stretches(item: list[int], places: dict[int, list[int]], doc: list[int], seen: dict[int, list[int]], common: Iterable[int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """Common stretches in which at most single words differ: (item from, to, document from, to, equal words).

    ``places`` and ``seen``: where the item and the document have the numbered word triples.
    """
    size = len(item)
    if common is None:
        common = places.keys() & seen.keys()
    # Diagonal and place of every equal triple in one number, so that sorting brings each diagonal together.
    hits = sorted([(d - i + size) * size + i for t in common for i in places[t] for d in seen[t]])
    pieces, end = [], len(hits)
    last = here = -2
    k = 0
    while k < end:
        last, here = here, hits[k] // size
        stop = k + 1
        while stop < end and hits[stop] // size == here:
            stop += 1
        # A lone triple without a neighbouring diagonal can't grow to a stretch.
        if stop - k > 1 or last == here - 1 or stop < end and hits[stop] // size == here + 1:
            shift, done = here - size, 0
            for h in hits[k:stop]:
                i = h - here * size
                if i < done:
                    continue
                a, b, same = _extended(item, doc, i, shift)
                if a < done:
                    a = done
                    same = sum(item[x] == doc[x + shift] for x in range(a, b))
                pieces.append([a, b, a + shift, b + shift, same])
                done = b
        k = stop
    # A single word put in or left out moves the rest to a neighbouring diagonal: such pieces are one stretch.
    # Pieces of a diagonal don't overlap, so an end (item, document) is that of one piece only.
    pieces.sort()
    joined: list[list[int]] = []
    ends: dict[tuple[int, int], int] = {}
    for p in pieces:
        i, d = p[0], p[2]
        at = max(ends.get((i, d), -1), ends.get((i, d - 1), -1), ends.get((i - 1, d), -1), ends.get((i - 1, d - 1), -1))
        if at >= 0:
            q = joined[at]
            del ends[q[1], q[3]]
            q[1], q[3], q[4] = p[1], p[3], q[4] + p[4]
        else:
            at = len(joined)
            joined.append(list(p))
        ends[p[1], p[3]] = at
    return [tuple(p) for p in joined if p[1] - p[0] >= STRETCH and p[4] >= EQUAL * (p[1] - p[0])]


def held(found: list[tuple[int, int, int, int, int]]) -> int:
    """Most item words in stretches that follow each other in item and document."""
    found = sorted(found, key=lambda s: (s[2], s[0]))
    best: list[int] = []
    for k, s in enumerate(found):
        most = 0
        for j in range(k):
            over = max(0, found[j][1] - s[0], found[j][3] - s[2])
            if found[j][0] < s[0] and found[j][2] < s[2] and s[1] - s[0] - over > 0:
                most = max(most, best[j] - over)
        best.append(most + s[1] - s[0])
    return max(best, default=0)


def leaks(m: Matcher, folded: list[str]) -> list[tuple[int, float]]:
    """(item, share of its words) of the items that leaked into a text of these folded words."""
    get, triple = m.vocabulary.get, m.triples.get
    doc = [get(w, -1) for w in folded]
    found = candidates(m, doc)
    if not found:
        return []
    seen: dict[int, list[int]] = defaultdict(list)
    for d, t in enumerate(zip(doc, doc[1:], doc[2:])):
        if (k := triple(t)) is not None:
            seen[k].append(d)
    out = []
    for key in sorted(found):
        item, places = m.items[key], m.places[key]
        common = places.keys() & seen.keys()
        if not enough(places, common, len(item)):
            continue
        share = held(stretches(item, places, doc, seen, common)) / len(item)
        if share >= SHARE:
            out.append((key, min(1.0, share)))
    return out


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in blocks of bounded size; each block is one search over the corpus."""
    own = items.select(item_id, text).where(F.col(text).isNotNull())
    # The opening sentences are counted where the items are; only shared ones come here.

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"s": [" ".join(w) for t in b[text] if (w := opening(t))]}, dtype="object")

    shared = own.select(text).mapInPandas(first, "s string").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    instructions = {tuple(row["s"].split(" ")) for row in shared.where(F.col("n") >= SHARED_BY).toLocalIterator()}
    block: list[tuple[int, list[str]]] = []
    size = 0
    for row in own.orderBy(item_id).toLocalIterator():
        w = item_words(row[text], instructions)
        if len(w) < STRETCH:
            continue
        block.append((row[item_id], w))
        size += len(w)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Pairs in which a document holds at least a quarter of an item's words: doc_id, item_id, share.

    The words are those in the item's order, in stretches of ten or more in which single words may differ, put
    in or left out; the opening sentence that three or more items share doesn't count. Case, punctuation,
    spacing, markup and the look of characters don't count. Null and empty texts give no pair; an item of fewer
    than ten words can't leak; a repeated document row counts once per row.

    The corpus isn't shuffled: every task searches its documents for all patterns of five words of the items.
    Windows are skipped by a shift table over blocks of two words; where the shift is 0, the bucket of the
    window's last block gives the patterns to compare directly. Candidates are aligned word by word. Two altered
    words less than five words apart in an otherwise isolated stretch can hide it; a second stretch of the item
    shows the item, and then all its stretches are aligned. Items beyond ``BLOCK_WORDS`` words are searched for
    in blocks of that size; the documents' words are folded once and kept for all of them.
    """
    own = documents.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).where("t is not null and d is not null")
    blocks = _blocks(items, item_id, text)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, share double")
    if second is not None:

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"d": b["d"], "t": [" ".join(words(t)) for t in b["t"]]})

        own = checkpointed(own.mapInPandas(fold, "d bigint, t string"))
    out = None
    for block in itertools.chain([first], [] if second is None else [second], blocks):
        m = compile_items(block)

        def search(batches: Iterator[pd.DataFrame], m: Matcher = m, cut: Callable[[str], list[str]] = words if second is None else str.split) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(d, i, s) for d, t in zip(b["d"], b["t"], strict=True) for i, s in leaks(m, cut(t))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share"]).astype({"doc_id": "int64", "item_id": "int64", "share": "float64"})

        part = own.mapInPandas(search, "doc_id bigint, item_id bigint, share double")
        out = part if out is None else out.unionByName(part)
    return out
