"""Texts cut off by field limits, found by how word trigrams occur inside texts and at ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.latest import checkpointed
from strataframe.operators.orphans import bloom_bits, bloom_filter, perhaps

#: Occurrences from which an n-gram counts as known, and the share of them at an end below which it is almost never terminal.
SUPPORT, TERMINAL_SHARE = 8, 0.01
#: Times that words beginning with a text's last one must outnumber it as a word of its own.
PREFIX_TIMES = 20
#: Characters below a source's greatest length that count as its limit, and the least texts and share of texts there.
BAND, BAND_TEXTS, BAND_SHARE = 12, 5, 0.02

#: Patterns and characters of the statements below, passed as parameters.
PATTERNS = {
    # Letters, numbers, the last line feed of several, a full stop with what follows it within a word (3.5, a.txt: no end), other characters.
    "token": r"[\p{L}\p{M}]+|[0-9]+|\n(?!\s*\n)|[.](?:[\p{L}\p{M}]+|[0-9]+)|\S",
    "pieces": r"^(?:\S+\s+){0,7}\S+", "word": r"^[.]?\p{L}", "listed": r"^([-*] |[^|]+ [|] |\S+:|[A-Z][A-Za-z ]*:)",
    # Of reversed texts: an entity without its end, a closing tag without its brackets.
    "entity": r"^([A-Za-z]{1,8}|[0-9A-Fa-f]*x?#)$", "closing": r"^[A-Za-z0-9]*[A-Za-z]/$",
    "blanks": " \t\n\x0b\x0c\r ", "closers": "\"')]»”*_", "dots": ".…�", "half": "�", "more": "…", "open": "{", "close": "}", "json": '["{]',
}
_ENDS = r"('.', '!', '?', '\n', '。')"
_PLAIN = "case when ascii({0}) between 48 and 57 then '0' when ascii({0}) = 46 and ascii(right({0}, 1)) between 48 and 57 then '.0' else {0} end"

#: One row per text, without white space at its end and a note that it was cut; ``stem`` has no dots that trail off either.
_PREPARED = """
with one as (select doc_id, source, text, rtrim(:blanks, text) as t from {documents} where text is not null),
two as (select *, case when endswith(t, '[cut]') then 5 when endswith(t, '[truncated]') or endswith(t, '<truncated>') then 11 when endswith(t, '[snip]') then 6 else 0 end as note from one),
three as (select doc_id, source, text, note > 0 as marked, if(note > 0, rtrim(:blanks, left(t, length(t) - note)), t) as body from two)
select *, endswith(body, '...') or endswith(body, :more) as dots, endswith(body, :half) as half, lower(if(endswith(body, '...') or endswith(body, :more) or endswith(body, :half), rtrim(:dots, body), body)) as stem from three"""

#: What can be seen at the end itself, read off the reversed text from its beginning or off positions, so that no pattern runs over a text.
_SHAPED = rf"""
with p as (select *, reverse(body) as r, ltrim(:blanks, body) as head from {{prepared}}),
q as (select *, instr(r, '<') as lt, instr(r, '>') as gt, instr(r, '&') as amp, left(ltrim(:closers, r), 1) as final, left(head, 1) as opens from p),
f as (select doc_id, source, length(text) as n, md5(text) as copy, marked, half,
  amp > 0 and left(r, amp - 1) rlike :entity as broken_entity,
  lt > 1 and (gt = 0 or lt < gt) and substr(r, lt - 1, 1) rlike '[A-Za-z/]' as open_tag, gt = 1 and lt > 2 and substr(r, 2, lt - 2) rlike :closing as closed_tag,
  final in ('.', '!', '?', '。') and not dots as stopped, (length(body) - length(replace(body, '```', ''))) div 3 % 2 = 1 as open_fence,
  opens in (:open, '[') and not (opens = '[' and instr(head, ']') > 0 and not left(head, instr(head, ']')) rlike :json) as json,
  length(replace(body, :close, '')) > length(replace(body, :open, '')) or length(replace(body, ']', '')) > length(replace(body, '[', '')) as unclosed,
  substring_index(body, '\n', -1) rlike :listed as listed,
  concat(array('^', '^', '^'), regexp_extract_all(reverse(regexp_extract(reverse(stem), :pieces, 0)), :token, 0)) as w from q),
l as (select *, slice(w, -4, 4) as e4, size(w) > 3 as filled from f)
select doc_id, source, n, copy,
  case when marked then 'marker' when half then 'character' when broken_entity then 'entity' when open_tag then 'tag' when open_fence then 'fence' when json and unclosed then 'structure' end as seen,
  stopped or closed_tag or json as closed, listed,
  if(filled and not (stopped or closed_tag or marked or half),
    struct(concat(if(e4[0] in {_ENDS}, '^', ''), {_PLAIN.format("e4[1]")}) as a, {_PLAIN.format("e4[2]")} as b, {_PLAIN.format("e4[3]")} as c), null) as e from l"""

#: Every trigram that something follows, marked where it opens a sentence, and whether an end follows. A text's own end is left out, so that
#: copies of a cut text don't vouch for it. ``@keys`` are hashes to filter by; made by a generator, they are computed once per row.
_GRAMS = rf"""
with t as (select concat(array('^', '^', '^'), regexp_extract_all(stem, :token, 0)) as w from {{prepared}}),
g as (select inline(arrays_zip(w, slice(w, 2, size(w)), slice(w, 3, size(w)), slice(w, 4, size(w)), slice(w, 5, size(w)))) as (p, a, b, c, t) from t),
h as (select concat(if(p in {_ENDS}, '^', ''), {_PLAIN.format("a")}) as a, {_PLAIN.format("b")} as b, {_PLAIN.format("c")} as c, t in {_ENDS} as ends from g where t is not null)
select a, b, c, ends, keys.* from h lateral view inline(array(struct(@keys))) keys"""
#: Hashes of the first two words, and of the first letters of the last.
_PAIR, _STEMS = "xxhash64(a, b) as k", "xxhash64(left(c, 1)) as k1, xxhash64(left(c, 2)) as k2, xxhash64(left(c, 3)) as k3"

#: How often each ending occurs inside texts, and how often as the beginning of a longer word: ``keys`` are the words before the last.
_INSIDE = r"""
with lengths as (select array_sort(collect_set(length(c))) as ls from {endings} where c rlike :word),
longer as (select @keys, left(c, x) as c, sum(seen) as n from (select @keys, c, seen, explode((select ls from lengths)) as x from {grams} where c rlike :word) where x < length(c) group by all)
select e.*, coalesce(g.seen, 0) as seen, coalesce(g.ends, 0) as ends, coalesce(l.n, 0) as longer
from {endings} e left join {grams} g on @on(g) left join longer l on @on(l) and e.c rlike :word"""

_FIRST = f"""select a, b, c, case when seen >= {SUPPORT} then if(ends < seen * {TERMINAL_SHARE}, 'sentence', '') when ends > 0 then '' when longer >= {SUPPORT} then 'word' end as cut from {{inside}}"""

#: The last two words, then the last one, of endings whose trigram is rare inside texts.
_SECOND = f"""
select t.a, t.b, t.c, case when t.seen >= {SUPPORT} then if(t.ends < t.seen * {TERMINAL_SHARE}, 'sentence', '') when t.ends > 0 then ''
    when t.longer >= {SUPPORT} and o.ends <= o.seen * {TERMINAL_SHARE} then 'word'
    when t.seen < 2 and o.longer >= {SUPPORT} and o.longer >= {PREFIX_TIMES} * o.seen then 'word'
    when t.seen > 0 and o.seen >= {SUPPORT} and o.ends < o.seen * {TERMINAL_SHARE} then 'sentence' else '' end as cut,
  if(t.seen >= {SUPPORT} or t.ends > 0 or t.longer >= {SUPPORT} and o.ends <= o.seen * {TERMINAL_SHARE}, 'two words', 'last word') as by
from {{two}} t join {{one}} o on o.c = t.c"""

_VERDICTS = f"""
with lengths as (select source, n, count(*) as texts from {{shaped}} group by 1, 2),
most as (select source, max(n) as top, sum(texts) as texts from lengths group by 1),
limits as (select m.source, m.top from lengths l join most m on m.source <=> l.source and l.n > m.top - {BAND}
  group by m.source, m.top, m.texts having sum(l.texts) >= {BAND_TEXTS} and sum(l.texts) >= m.texts * {BAND_SHARE}),
v as (select s.doc_id, s.source, s.copy, coalesce(s.seen, if(s.closed, null, coalesce(nullif(j.cut, ''), if(l.source is not null and s.n > l.top - {BAND} and not s.listed, 'limit', null)))) as cut_in, j.by
  from {{shaped}} s left join {{judged}} j on j.a = s.e.a and j.b = s.e.b and j.c = s.e.c left join limits l on l.source <=> s.source),
limited as (select distinct copy from v where cut_in = 'limit')
select v.doc_id, v.source, coalesce(v.cut_in, if(m.copy is null, null, 'limit')) as cut_in,
  case when v.cut_in in ('word', 'sentence') then v.by when v.cut_in = 'limit' or m.copy is not null then 'length' when v.cut_in is not null then 'structure' end as decided_by
from v left join limited m on m.copy = v.copy"""


def _inside(endings: DataFrame, grams: DataFrame, keys: list[str]) -> DataFrame:
    on = lambda t: " and ".join(f"{t}.{k} = e.{k}" for k in [*keys, "c"])
    text = _INSIDE.replace("@keys, ", "".join(f"{k}, " for k in keys)).replace("@on(g)", on("g")).replace("@on(l)", on("l"))
    return endings.sparkSession.sql(text, args=PATTERNS, endings=endings, grams=grams)


def _hit(keys: DataFrame, tested: list[str]) -> Column:
    """Whether one of ``tested`` may be among ``keys`` (one column ``k``): a filter of bounded size."""
    rows = checkpointed(keys.distinct())
    bits = bloom_bits(rows.count())
    words = checkpointed(bloom_filter(rows, "k", bits))
    out = F.lit(False)
    for t in tested:
        out = out | perhaps(words, bits, F.col(t))
    return out


def cut_texts(documents: DataFrame) -> DataFrame:
    """Every text with what it was cut in: doc_id, source, cut_in (null for a complete text), decided_by.

    The last trigram of a text decides: it cuts a ``sentence`` if it is frequent inside texts and almost never
    before an end, and a ``word`` if it isn't, but with a longer last word is. Only where the trigram is rare
    inside texts and was never seen before an end its last two words decide in the same way, and where these
    are rare the last one (``decided_by``: trigram, two words, last word); what was never seen inside a text,
    such as a closing formula, cuts nothing. Joined to this is what is seen in the text itself (structure):
    ``marker``, ``character``, ``entity``, ``tag``, ``fence`` and ``structure`` are a note that it was cut, half
    a character or entity, an unclosed tag, code fence or JSON; and (length) ``limit``: the greatest length of a
    source in which suspiciously many texts have it, and copies of these.

    Null texts give no row, an empty one counts as complete; a repeated doc_id is judged by each of its texts.

    Pure SQL over all texts. Each text's end is read once and kept. Trigrams are counted whose first two words
    some text ends with, as a filter tells before the shuffle; shorter n-grams only for the endings that are
    left, told by the first letters of the last word. Copies of an ending are judged once.
    """
    def sql(text: str, **tables: DataFrame) -> DataFrame:
        return documents.sparkSession.sql(text, args=PATTERNS, **tables)

    prepared = sql(_PREPARED, documents=documents.select("doc_id", "source", "text"))
    shaped = checkpointed(sql(_SHAPED, prepared=prepared))
    endings = checkpointed(shaped.where("e is not null").select("e.a", "e.b", "e.c").distinct())
    grams = lambda keys: sql(_GRAMS.replace("@keys", keys), prepared=prepared)
    counts = [F.count(F.lit(1)).alias("seen"), F.count_if("ends").alias("ends")]
    tri = grams(_PAIR).where(_hit(endings.selectExpr(_PAIR), ["k"]))
    tri = checkpointed(tri.groupBy("a", "b", "c").agg(*counts))
    first = checkpointed(sql(_FIRST, inside=_inside(endings, tri, ["a", "b"])))
    left = checkpointed(first.where("cut is null").select("a", "b", "c"))
    two = grams(_STEMS).where(_hit(left.selectExpr("xxhash64(left(c, 3)) as k"), ["k1", "k2", "k3"]))
    two = checkpointed(two.groupBy("b", "c").agg(*counts))
    one = two.groupBy("c").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))
    pairs = _inside(left, two, ["b"])
    second = sql(_SECOND, two=pairs, one=_inside(left.select("c").distinct(), one, []))
    judged = first.where("cut is not null").withColumn("by", F.lit("trigram")).unionByName(second)
    return sql(_VERDICTS, shaped=shaped, judged=checkpointed(judged))


def truncation_by_source(found: DataFrame) -> DataFrame:
    """source, texts, cut_texts and cut_share, and the cut texts by what they were cut in and by what decided."""
    cut = F.col("cut_in").isNotNull()
    by = lambda c, v: F.count_if(cut & (F.col(c) == v))
    each = found.groupBy("source", "doc_id").agg(F.min("cut_in").alias("cut_in"), F.min_by("decided_by", "cut_in").alias("decided_by"))
    return each.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(cut).alias("cut_texts"), by("cut_in", "word").alias("cut_in_word"), by("cut_in", "sentence").alias("cut_in_sentence"),
        by("decided_by", "trigram").alias("by_trigram"), F.count_if(F.col("decided_by").isin("two words", "last word")).alias("by_shorter"), by("decided_by", "structure").alias("by_structure"), by("decided_by", "length").alias("by_length"),
    ).withColumn("cut_share", F.col("cut_texts") / F.col("texts"))
