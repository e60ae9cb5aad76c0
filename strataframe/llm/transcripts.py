"""Speech transcripts into clean, ordered speaker turns."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.ids import known
from strataframe.functions.latest import checkpointed, latest

KIND = "audio_transcript_segment"
#: Items, and milliseconds, of a block; a long recording is worked on in many blocks.
ITEM_BLOCK, TIME_BLOCK = 4096, 600_000
#: Occurrences from which a name counts without a better known spelling, and times a spelling must be more frequent.
NAMES, TIMES = 3, 3
# Number words, stems of sounds in round brackets, hesitation sounds.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
SOUNDS = (
    "applau|audience|background|beep|bell|breath|buzz|chatter|cheer|chuckl|clap|clear|click|cough|cross-?talk|cry|door|echo|exhal|feedback|footstep|gasp|giggl|groan|hum|"
    "inaudible|indistinct|inhal|keyboard|knock|laugh|microphone|music|noise|overlapping|paper|pause|phone|ring|rustl|sigh|silence|sings|singing|siren|sneez|sniff|static|throat|typing|"
    "unclear|unintelligible|whisper|whistl|yawn"
)
HESITATION = r"^(u+h+|u+h*m+|e+r+m*|e+h+m*|h+m+|m+h+m*|m{2,}|a+h+m*)$"

_STAMP = r"^[\s ]*(?:\[(\d+)s\]|[\[(]?(?:(\d{1,3}):)?(\d{1,3}):(\d\d)(?:[.,](\d{1,3}))?[\])]?(?:\s*-->\s*[\d:.,]+)?)(?:\s+-)?(?:\s+|$)"
_NUMBERED = r"(?:speaker|spk|sp|s)[ _\-]*(?:\d{1,4}|" + "|".join(NUMBERS) + ")"
_NAME = rf"({_NUMBERED}|\p{{L}}[\p{{L}}'’\-]{{1,24}}\.?)"
_LABEL = rf"(?i)^\s*(?:>>\s*)?(?:<v\s+{_NAME}\s*>|\[{_NAME}\]\s*:|{_NAME}\s*[:>]|{_NAME}\s+-)\s*"


def stamp_ms(text: Column) -> Column:
    """Milliseconds of the timestamp a segment's text begins with; null without one."""
    part = lambda i: F.nullif(F.regexp_extract(text, _STAMP, i), F.lit("")).try_cast("bigint")
    clock = ((F.coalesce(part(2), F.lit(0)) * 60 + part(3)) * 60 + part(4)) * 1000 + F.coalesce(F.rpad(F.nullif(F.regexp_extract(text, _STAMP, 5), F.lit("")), 3, "0").try_cast("bigint"), F.lit(0))
    return F.coalesce(part(1) * 1000, clock)


def without_notes(text: Column) -> Column:
    """The text without notes of sounds: in square, curly or angle brackets, asterisks or music signs, and sounds in round brackets."""
    plain = F.regexp_replace(text, r"\[[^\]]*\]|\{[^}]*\}|<[^>]*>|\*[^*\n]{1,60}\*|♪[^♪]*♪|[♪♫]", " ")
    return F.regexp_replace(plain, rf"(?i)\([^()]*\b(?:{SOUNDS})[^()]*\)", " ")


def spoken(text: Column) -> Column:
    """Blank-separated pieces with a letter or digit that aren't hesitation sounds, as an array."""
    pieces = F.split(without_notes(text), r"[\s ]+")
    bare = lambda x: F.lower(F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(pieces, lambda x: x.rlike(r"[\p{L}\p{N}]") & ~bare(x).rlike(HESITATION))


def carried(df: DataFrame, keys: list[str], block: str, order: list, value: str, name: str, itself: bool) -> DataFrame:
    """``df`` with the last known ``value`` up to each row (``itself``) or before it, in the order of (block, order).

    Every block is sorted on its own; what earlier blocks leave behind comes from one row per block. So a key
    with a large part of all rows isn't sorted in one task.
    """
    within = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    known_at = F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v")))
    last = df.groupBy(*keys, block).agg(F.max(known_at)._v.alias("_last"))
    past = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    left = last.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(block).alias("_block"), F.last("_last", ignorenulls=True).over(past).alias("_left"))
    here = df.withColumn("_here", F.last(value, ignorenulls=True).over(within))
    joined = here.join(left, [here[k] == left[f"_{k}"] for k in keys] + [here[block] == left["_block"]], "left")
    return joined.select(*df.columns, F.coalesce("_here", "_left").alias(name))


def counted_up(df: DataFrame, keys: list[str], block: str, order: list, flag: str, name: str) -> DataFrame:
    """``df`` with the number of set ``flag`` s up to each row, block by block like ``carried``."""
    within = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*keys, block).agg(F.count_if(flag).alias("_n"))
    past = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    left = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(block).alias("_block"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_left"))
    here = df.withColumn("_here", F.count_if(flag).over(within))
    joined = here.join(left, [here[k] == left[f"_{k}"] for k in keys] + [here[block] == left["_block"]], "left")
    return joined.select(*df.columns, (F.col("_here") + F.col("_left")).cast("int").alias(name))


def precedence(segments: DataFrame) -> DataFrame:
    """Segments with the edges that lead to them: doc, item, text, place, cue_from, talk_from, dropped.

    Three kinds of edges say what comes before what. Timing: from each timed segment to the next later one. Cue:
    from each item to the next in delivered order (``cue_from``). Dialogue: from the last item that opens with a
    name to a later one that doesn't and so continues it (``talk_from``). Timing outweighs cue, cue outweighs
    dialogue: an edge that would lead back along stronger ones closes a cycle and is ``dropped`` (its kind is
    listed there, and its end is null). A segment without a time hangs on its cue edge and takes the ``place`` in
    time of the item before it (0 at the beginning); whether an edge leads back is then seen from the places of
    its ends. One pass per block of items, and one row per block for what it hands on.
    """
    opens = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), _STAMP, ""), r"\n[\s\S]*", "").rlike(_LABEL)
    rows = segments.withColumn("block", F.floor(F.col("item") / ITEM_BLOCK)).withColumn("_opens", opens)
    here = Window.partitionBy("doc", "block").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    within = rows.select("*", last("time", here).alias("_t"), last("item", here).alias("_i"))
    ends = within.groupBy("doc", "block").agg(
        F.max_by("time", F.when(F.col("time").isNotNull(), F.col("item"))).alias("t"), F.max("item").alias("i"),
        F.max(F.when(F.col("_opens"), F.struct("item", F.coalesce("time", "_t").alias("at")))).alias("n"),
    )
    past = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("doc", "block", last("t", past).alias("_t0"), last("i", past).alias("_i0"), "n")
    named = F.when(F.col("n").isNotNull(), F.struct(F.col("n.item").alias("item"), F.coalesce("n.at", "_t0", F.lit(0)).alias("at")))
    handed = handed.withColumn("n", named).select("doc", "block", "_t0", "_i0", last("n", past).alias("_n0"))
    both = within.join(handed, ["doc", "block"], "left").withColumn("before", F.coalesce("_t", "_t0"))
    placed = both.withColumn("place", F.coalesce("time", "before", F.lit(0)).cast("bigint"))
    opened = F.when(F.col("_opens"), F.struct("item", F.col("place").alias("at")))
    talk = F.when(~F.col("_opens"), F.coalesce(last(opened, here), F.col("_n0")))
    seen = placed.withColumn("_n", talk).select("*", F.col("_n.item").alias("_talk"), F.col("_n.at").alias("_at"))
    cue_back, talk_back = F.coalesce(F.col("time") < F.col("before"), F.lit(False)), F.coalesce(F.col("place") < F.col("_at"), F.lit(False))
    return seen.select(
        "doc", "item", "text", "time", "place", F.when(~cue_back, F.coalesce("_i", "_i0")).alias("cue_from"), F.when(~talk_back, F.col("_talk")).alias("talk_from"),
        F.array_compact(F.array(F.when(cue_back, "cue"), F.when(talk_back, "dialogue"))).alias("dropped"),
    )


def topological_order(nodes: Iterable[tuple[int, int | None, int | None]]) -> list[int]:
    """Items in an order that follows all edges, the least item first where several may come: (item, sources of its edges).

    Edges from items that aren't among the nodes come from earlier ones and hold anyway.
    """
    nodes = list(nodes)
    inside, after, open_edges = {n[0] for n in nodes}, defaultdict(list), {}
    for item, *sources in nodes:
        real = {s for s in sources if s is not None and s in inside}
        open_edges[item] = len(real)
        for s in real:
            after[s].append(item)
    ready, out = [i for i, n in open_edges.items() if not n], []
    heapify(ready)
    while ready:
        item = heappop(ready)
        out.append(item)
        for nxt in after[item]:
            open_edges[nxt] -= 1
            if not open_edges[nxt]:
                heappush(ready, nxt)
    if len(out) < len(nodes):
        raise ValueError("precedence edges form a cycle")
    return out


def ordered_segments(items: DataFrame) -> DataFrame:
    """Segments of transcripts in their order: doc, start, item, text, dropped, ord.

    The order is a topological one of the precedence edges that are left when conflicts are resolved (see
    ``precedence``). Timing edges order the places of a recording; among the segments of one place, which cue and
    dialogue edges order, it is found by taking whichever segment has all that precede it. ``ord`` is the rank
    within a place. Places are spread over tasks by time and by blocks of items, along which edges only lead
    forward, so a long recording, or one without any times, isn't ordered in one task.
    Of the segments with one start the first item counts; segments without a time of their own are never taken
    for a repetition.
    """
    rows = items.where(F.col("kind") == KIND).select(
        known(F.col("document_key")).alias("doc"), F.col("item_index").alias("item"), F.col("text_or_value").alias("text"), F.col("location.start_ms").alias("at"), "recorded_at"
    ).where("doc is not null and item is not null")
    one = latest(rows, ["doc", "item"], ["text", "at"]).select("doc", "item", "text", F.coalesce(F.when(F.col("at") >= 0, F.col("at")), stamp_ms(F.col("text"))).alias("time"))
    own = F.when(F.col("time").isNull(), F.col("item")).otherwise(-1)
    kept = precedence(checkpointed(one)).groupBy("doc", "place", own.alias("_own")).agg(F.min(F.struct("item", "text", "cue_from", "talk_from", "dropped")).alias("s")).select("doc", "place", "s.*")

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by place; the segments of one place and block are held, at most ITEM_BLOCK.
        held: list[tuple] = []

        def done() -> Iterator[tuple]:
            if len(held) == 1:
                yield (*held[0][3:], 0)
            elif held:
                rank = {item: n for n, item in enumerate(topological_order((x[5], *x[:2]) for x in held))}
                yield from ((*x[3:], rank[x[5]]) for x in held)

        for b in batches:
            out: list[tuple] = []
            edges = b[["cue_from", "talk_from"]].astype(object).where(b[["cue_from", "talk_from"]].notna(), None)
            for cue, talk, doc, place, item, text, dropped in zip(edges["cue_from"], edges["talk_from"], b["doc"], b["place"], b["item"], b["text"], b["dropped"], strict=True):
                key = (doc, place, item // ITEM_BLOCK)
                if held and held[0][2] != key:
                    out += done()
                    held = []
                held.append((cue, talk, key, doc, place, item, text, dropped))
            yield pd.DataFrame(out, columns=["doc", "start", "item", "text", "dropped", "rank"])
        yield pd.DataFrame(list(done()), columns=["doc", "start", "item", "text", "dropped", "rank"])

    block = F.floor(F.col("item") / ITEM_BLOCK)
    spread = kept.repartition("doc", F.floor(F.col("place") / TIME_BLOCK), block).sortWithinPartitions("doc", "place", block, "item")
    out = spread.mapInPandas(ranked, "doc string, start bigint, item int, text string, dropped array<string>, rank int")
    return out.select("doc", "start", "item", "text", "dropped", (block * ITEM_BLOCK + F.col("rank")).cast("bigint").alias("ord"))


def named_parts(segments: DataFrame) -> DataFrame:
    """Parts of segments: doc, start, ord, item, dropped, part, raw (name as written, lower case, or null), strong, text.

    A new part begins with each line that opens with a name; other lines continue the part before them.
    ``strong``: the name is marked as one beyond doubt (a colon, angle or square brackets).
    """
    lines = segments.where("text is not null").select(
        "doc", "start", "ord", "item", "dropped", F.posexplode(F.split(F.regexp_replace("text", r"[ \t ]+", " "), r"\s*\n\s*")).alias("part", "line")
    )
    line = F.regexp_replace("line", _STAMP, "")
    lines = lines.withColumn("line", line)
    hit = lambda i: F.nullif(F.regexp_extract("line", _LABEL, i), F.lit(""))
    return lines.select(
        "doc", "start", "ord", "item", "dropped", "part", F.lower(F.coalesce(hit(1), hit(2), hit(3), hit(4))).alias("raw"), F.coalesce(hit(1), hit(2), hit(3)).isNotNull().alias("strong"), "line",
    )


def _shorter(c: Column) -> Column:
    """The text and all texts with one character less."""
    return F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substr(c, i + 1))))


def names_as_meant(parts: DataFrame) -> DataFrame:
    """raw and name for all names as written, over all transcripts.

    Numbered speakers are ``speaker N``, however written. Other names are looked up among the frequent ones: an
    abbreviation with a full stop by its letters, a misspelling by the texts that both have with at most one
    character left out, if the other is ``TIMES`` times as frequent; of several the most frequent. A name that
    is written as one fewer than ``NAMES`` times and resembles none is no name.
    """
    seen = parts.where("raw is not null").groupBy("raw").agg(F.count(F.lit(1)).alias("n"), F.count_if("strong").alias("strong"))
    digits = F.regexp_extract("raw", r"^(?:speaker|spk|sp|s)[ _\-]*0*(\d+)$", 1)
    word = F.regexp_extract("raw", r"^(?:speaker|spk|sp|s)[ _\-]*([a-z]+)$", 1)
    spelled = F.element_at(F.create_map(*[x for k, v in NUMBERS.items() for x in (F.lit(k), F.lit(str(v)))]), word)
    number = F.when(digits != "", digits).when(F.col("raw").rlike(r"^(?:speaker|spk|sp|s)[ _\-]*0+$"), "0").otherwise(F.when(F.array_contains(F.array(*[F.lit(k) for k in NUMBERS]), word), spelled))
    seen = seen.withColumn("number", number)
    numbered = seen.where("number is not null").select("raw", F.concat(F.lit("speaker "), F.col("number")).alias("name"))
    other = seen.where("number is null")
    full = other.where(~F.col("raw").endswith(".")).select(F.col("raw").alias("full"), F.col("n").alias("m"), F.col("strong").alias("sure"))
    full = full.where(F.col("sure") >= NAMES)
    key_full = full.select("full", "m", F.explode(F.array_distinct(F.concat(_shorter(F.col("full")), F.transform(F.sequence(F.lit(2), F.length("full")), lambda i: F.concat(F.left(F.col("full"), i), F.lit(".")))))).alias("key"))
    key_own = other.select("raw", "n", F.explode(F.when(F.col("raw").endswith("."), F.array("raw")).when(F.length("raw") < 5, F.array("raw")).otherwise(F.array_distinct(_shorter(F.col("raw"))))).alias("key"))
    near = key_own.join(key_full, "key").where((F.col("raw") == F.col("full")) | F.col("raw").endswith(".") | (F.col("m") >= TIMES * F.col("n")))
    best = near.groupBy("raw").agg(F.max(F.struct("m", "full")).full.alias("name"))
    return numbered.unionByName(best)


def speaker_segments(items: DataFrame) -> DataFrame:
    """Clean parts in order with their turns: document_key, turn_no, speaker, start_ms, item_index, part_no, n_words, text, edges_dropped.

    Parts without spoken words drop out first, with their names. A part without a name continues the speaker
    before it; before any name the speaker is ``''``. Rows of other kinds, null keys, null and empty texts give
    nothing; an empty input gives no rows.
    """
    parts = checkpointed(named_parts(ordered_segments(items)))
    meant = names_as_meant(parts)
    parts = parts.join(meant, "raw", "left").withColumn("said", F.when(F.col("name").isNotNull(), F.regexp_replace("line", _LABEL, "")).otherwise(F.col("line")))
    # Lines without a name belong to the part before them in their segment.
    of_segment = Window.partitionBy("doc", "start", "ord").orderBy("part")
    parts = parts.withColumn("part", F.sum(F.when(F.col("name").isNotNull() & (F.col("part") > 0), 1).otherwise(0)).over(of_segment))
    parts = parts.withColumn("words", spoken(F.col("said")))
    whole = checkpointed(parts.groupBy("doc", "start", "ord", "item", "part").agg(
        F.max("dropped").alias("dropped"), F.max("name").alias("name"), F.sum(F.size("words")).alias("n_words"), F.array_join(F.flatten(F.array_sort(F.collect_list(F.struct("line", "words"))).words), " ").alias("text")
    ).where("n_words > 0").withColumn("block", F.floor(F.col("start") / TIME_BLOCK)))
    order = [F.col("start"), F.col("ord"), F.col("part")]
    spoke = carried(whole, ["doc"], "block", order, "name", "speaker", itself=True).withColumn("speaker", F.coalesce("speaker", F.lit("")))
    spoke = checkpointed(spoke)
    after = carried(spoke, ["doc"], "block", order, "speaker", "last_speaker", itself=False)
    marked = checkpointed(after.withColumn("begins", F.col("last_speaker").isNotNull() & (F.col("speaker") != F.col("last_speaker"))))
    turns = counted_up(marked, ["doc"], "block", order, "begins", "turn_no")
    return turns.select(
        F.col("doc").alias("document_key"), "turn_no", "speaker", F.col("start").alias("start_ms"), F.col("item").alias("item_index"), F.col("part").cast("int").alias("part_no"),
        F.col("n_words").cast("int").alias("n_words"), "text",
        F.array_join("dropped", ",").alias("edges_dropped"),
    )


def turns(segments: DataFrame) -> DataFrame:
    """One row per turn: document_key, turn_no, speaker, start_ms, n_words. Combined before the shuffle."""
    return segments.groupBy("document_key", "turn_no", "speaker").agg(F.min("start_ms").alias("start_ms"), F.sum("n_words").cast("int").alias("n_words"))
