"""SQL that DuckDB runs beside the llm queries. Written for DuckDB: patterns at ends instead of reversed texts, prefixes by comparison instead of lengths."""

from __future__ import annotations

from strataframe.llm import transcripts as S
from strataframe.llm import truncation as T

_ENDS = "('.', '!', '?', chr(10), '。')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_PLAIN = "case when regexp_matches({0}, '^[0-9]') then '0' when regexp_matches({0}, '^[.][0-9]') then '.0' else {0} end"
_LETTERS = "regexp_matches({0}, '^[.]?\\p{{L}}')"

_P9 = f"""one as (select doc_id, source, text, rtrim(text, {_BLANKS}) t from documents where text is not null),
two as (select *, regexp_matches(t, '(\\[(cut|truncated|snip)\\]|<truncated>)$') marked from one),
three as (select doc_id, source, text, marked, rtrim(regexp_replace(t, '(\\[(cut|truncated|snip)\\]|<truncated>)$', ''), {_BLANKS}) body from two),
four as (select *, regexp_matches(body, '(\\.\\.\\.|…)$') dots, ends_with(body, '�') half from three),
five as (select *, regexp_matches(body, '&([A-Za-z]{{1,8}}|#x?[0-9A-Fa-f]*)$') entity, regexp_matches(body, '<[A-Za-z/][^<>]*$') open_tag, regexp_matches(body, '</[A-Za-z][A-Za-z0-9]*>$') closed_tag,
  regexp_matches(body, '[.!?。]["'')\\]»”*_]*$') and not dots stopped, (length(body) - length(replace(body, '```', ''))) // 3 % 2 = 1 fence, ltrim(body, {_BLANKS}) head,
  length(replace(body, '}}', '')) > length(replace(body, '{{', '')) or length(replace(body, ']', '')) > length(replace(body, '[', '')) unclosed, string_split(body, chr(10))[-1] last_line,
  ['^', '^', '^'] || regexp_extract_all(regexp_replace(lower(case when dots or half then rtrim(body, '.…�') else body end), '\\s*\\n\\s*', chr(10), 'g'), '[\\p{{L}}\\p{{M}}]+|[0-9]+|\\n|[.](?:[\\p{{L}}\\p{{M}}]+|[0-9]+)|[^\\s]') w from four),
shaped as (select *, case when marked then 'marker' when half then 'character' when entity then 'entity' when open_tag then 'tag' when fence then 'fence' when json and unclosed then 'structure' end seen, stopped or closed_tag or json closed,
  case when not (stopped or closed_tag or marked or half) and len(w) > 3 then w[-4:] end e from (select *, regexp_matches(head, '^[{{\\[]') and not regexp_matches(head, '^\\[[^\\]"{{]*\\]') json from five)),
endings as (select doc_id, case when e[1] in {_ENDS} then '^' else '' end || {_PLAIN.format("e[2]")} a, {_PLAIN.format("e[3]")} b, {_PLAIN.format("e[4]")} c from shaped where e is not null),
raw as (select w[i - 3] p, w[i - 2] a, w[i - 1] b, w[i] c, w[i + 1] in {_ENDS} t from (select w, unnest(range(4, len(w))) i from shaped)),
grams as (select case when p in {_ENDS} then '^' else '' end || {_PLAIN.format("a")} a, {_PLAIN.format("b")} b, {_PLAIN.format("c")} c, count(*) n, count(*) filter (t) e from raw group by 1, 2, 3),
pairs as (select b, c, sum(n) n, sum(e) e from grams group by 1, 2), words as (select c, sum(n) n, sum(e) e from pairs group by 1),
different as (select distinct a, b, c from endings),
l3 as (select d.a, d.b, d.c, sum(g.n) n from different d join grams g on g.a = d.a and g.b = d.b and starts_with(g.c, d.c) and g.c <> d.c where {_LETTERS.format("d.c")} and {_LETTERS.format("g.c")} group by 1, 2, 3),
l2 as (select d.b, d.c, sum(g.n) n from (select distinct b, c from different) d join pairs g on g.b = d.b and starts_with(g.c, d.c) and g.c <> d.c where {_LETTERS.format("d.c")} and {_LETTERS.format("g.c")} group by 1, 2),
l1 as (select d.c, sum(g.n) n from (select distinct c from different) d join words g on left(g.c, 1) = left(d.c, 1) and starts_with(g.c, d.c) and g.c <> d.c where {_LETTERS.format("d.c")} and {_LETTERS.format("g.c")} group by 1),
counted as (select d.*, coalesce(g.n, 0) n3, coalesce(g.e, 0) e3, coalesce(l3.n, 0) c3, coalesce(p.n, 0) n2, coalesce(p.e, 0) e2, coalesce(l2.n, 0) c2, coalesce(o.n, 0) n1, coalesce(o.e, 0) e1, coalesce(l1.n, 0) c1
  from different d left join grams g using (a, b, c) left join l3 using (a, b, c) left join pairs p using (b, c) left join l2 using (b, c) left join words o using (c) left join l1 using (c)),
judged as (select a, b, c, case when n3 >= {T.SUPPORT} then case when e3 < n3 * {T.TERMINAL_SHARE} then 'sentence' else '' end when e3 > 0 then '' when c3 >= {T.SUPPORT} then 'word'
  when n2 >= {T.SUPPORT} then case when e2 < n2 * {T.TERMINAL_SHARE} then 'sentence' else '' end when e2 > 0 then '' when c2 >= {T.SUPPORT} and e1 <= n1 * {T.TERMINAL_SHARE} then 'word'
  when n2 < 2 and c1 >= {T.SUPPORT} and c1 >= {T.PREFIX_TIMES} * n1 then 'word' when n2 > 0 and n1 >= {T.SUPPORT} and e1 < n1 * {T.TERMINAL_SHARE} then 'sentence' else '' end cut,
  case when n3 >= {T.SUPPORT} or e3 > 0 or c3 >= {T.SUPPORT} then 'trigram' when n2 >= {T.SUPPORT} or e2 > 0 or c2 >= {T.SUPPORT} and e1 <= n1 * {T.TERMINAL_SHARE} then 'two words' else 'last word' end as by from counted),
most as (select source, max(length(text)) top, count(*) texts from shaped group by 1),
limits as (select m.source, m.top from shaped s join most m on m.source is not distinct from s.source and length(s.text) > m.top - {T.BAND} group by m.source, m.top, m.texts having count(*) >= {T.BAND_TEXTS} and count(*) >= m.texts * {T.BAND_SHARE}),
verdicts as (select s.doc_id, s.source, s.text, coalesce(s.seen, case when not s.closed then coalesce(nullif(j.cut, ''), case when l.top is not null and length(s.text) > l.top - {T.BAND} and not regexp_matches(s.last_line, '^([-*] |[^|]+ [|] |[^\\s]+:|[A-Z][A-Za-z ]*:)') then 'limit' end) end) cut_in, j.by
  from shaped s left join endings e on e.doc_id = s.doc_id left join judged j on j.a = e.a and j.b = e.b and j.c = e.c left join limits l on l.source is not distinct from s.source),
found as (select v.doc_id, v.source, coalesce(v.cut_in, case when v.text in (select text from verdicts where cut_in = 'limit') then 'limit' end) cut_in, case when v.cut_in in ('word', 'sentence') then v.by when v.cut_in = 'limit' or v.cut_in is null then 'length' else 'structure' end decided_by from verdicts v)"""



def _text(pattern: str) -> str:
    """A pattern as a string of SQL."""
    return "'" + pattern.replace("'", "''") + "'"


_STAMPED, _LABELLED = _text(S._STAMP), _text(S._LABEL)


def _part(i: int) -> str:
    return f"try_cast(nullif(regexp_extract(x, {_STAMPED}, {i}), '') as bigint)"


_MS = (
    f"coalesce({_part(1)} * 1000, ((coalesce({_part(2)}, 0) * 60 + {_part(3)}) * 60 + {_part(4)}) * 1000"
    f" + coalesce(try_cast(rpad(nullif(regexp_extract(x, {_STAMPED}, 5), ''), 3, '0') as bigint), 0))"
)
_SHORTER = "list_concat([{0}], list_transform(range(1, length({0}) + 1), lambda i: left({0}, i - 1) || substr({0}, i + 1)))"
_NUMBER_WORDS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in S.NUMBERS.items()) + "}"
_NOTES = r"\[[^\]]*\]|\{[^}]*\}|<[^>]*>|\*[^*\n]{1,60}\*|♪[^♪]*♪|[♪♫]"
_BARE = "lower(regexp_replace({0}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))"

_P2 = f"""items as (select nullif(trim(document_key), '') doc, item_index item, text_or_value x, location.start_ms given from document_items where kind = '{S.KIND}' and nullif(trim(document_key), '') is not null and item_index is not null
  qualify row_number() over (partition by trim(document_key), item_index order by recorded_at desc nulls last, text_or_value desc nulls last, location.start_ms desc nulls last) = 1),
timed as (select *, coalesce(case when given >= 0 then given end, {_MS}) own from items),
placed as (select *, coalesce(last_value(own ignore nulls) over (partition by doc order by item rows unbounded preceding), 0) place from timed),
kept as (select * from placed qualify row_number() over (partition by doc, place, case when own is null then item else -1 end order by item) = 1),
split as (select doc, place, item, unnest(l) line, unnest(range(len(l))) part from (select *, string_split_regex(regexp_replace(x, '[ \\t' || chr(160) || ']+', ' ', 'g'), '\\s*\\n\\s*') l from kept where x is not null)),
lines as (select * replace (regexp_replace(line, {_STAMPED}, '') as line) from split),
hits as (select *, nullif(regexp_extract(line, {_LABELLED}, 1), '') h1, nullif(regexp_extract(line, {_LABELLED}, 2), '') h2, nullif(regexp_extract(line, {_LABELLED}, 3), '') h3, nullif(regexp_extract(line, {_LABELLED}, 4), '') h4 from lines),
parts as (select *, lower(coalesce(h1, h2, h3, h4)) raw, coalesce(h1, h2, h3) is not null strong from hits),
names as (select raw, count(*) n, count(*) filter (strong) sure, regexp_extract(raw, '^(?:speaker|spk|sp|s)[ _\\-]*0*(\\d+)$', 1) digits, regexp_extract(raw, '^(?:speaker|spk|sp|s)[ _\\-]*([a-z]+)$', 1) word from parts where raw is not null group by 1),
numbered as (select *, case when digits <> '' then digits else {_NUMBER_WORDS}[word] end number from names),
others as (select * from numbered where number is null),
whole as (select raw as "full", n m, unnest(list_distinct(list_concat({_SHORTER.format('raw')}, list_transform(range(2, length(raw) + 1), lambda i: left(raw, i) || '.')))) k from others where sure >= {S.NAMES} and not ends_with(raw, '.')),
own as (select raw, n, unnest(case when ends_with(raw, '.') or length(raw) < 5 then [raw] else list_distinct({_SHORTER.format('raw')}) end) k from others),
meant as (select raw, 'speaker ' || number as name from numbered where number is not null union all
  select own.raw, arg_max(w."full", struct_pack(a := w.m, b := w."full")) from own join whole w on w.k = own.k where own.raw = w."full" or ends_with(own.raw, '.') or w.m >= {S.TIMES} * own.n group by 1),
said as (select p.*, m.name, case when m.name is null then line else regexp_replace(line, {_LABELLED}, '') end said from parts p left join meant m using (raw)),
pieces as (select doc, place, item, sum(case when name is not null and part > 0 then 1 else 0 end) over (partition by doc, place, item order by part) piece, name,
  len(list_filter(string_split_regex(regexp_replace(regexp_replace(said, {_text(_NOTES)}, ' ', 'g'), {_text(rf"(?i)\([^()]*\b(?:{S.SOUNDS})[^()]*\)")}, ' ', 'g'), '[\\s' || chr(160) || ']+'), lambda z: regexp_matches(z, '[\\p{{L}}\\p{{N}}]') and not regexp_matches({_BARE.format('z')}, {_text(S.HESITATION)}))) n from said),
spoken as (select doc, place, item, piece, max(name) as name, sum(n) n from pieces group by 1, 2, 3, 4 having sum(n) > 0),
spoke as (select *, coalesce(last_value(name ignore nulls) over (partition by doc order by place, item, piece rows unbounded preceding), '') speaker from spoken),
begun as (select *, case when lag(speaker) over w <> speaker then 1 else 0 end b from spoke window w as (partition by doc order by place, item, piece)),
turns as (select *, sum(b) over (partition by doc order by place, item, piece rows unbounded preceding)::int turn_no from begun)"""

SQL = {
    "p2_found": f"with {_P2} select doc as document_key, turn_no, speaker, min(place) start_ms, sum(n)::int n_words from turns group by 1, 2, 3",
    "p9_found": f"with {_P9} select distinct doc_id from found where cut_in is not null",
    "p9_sources": f"""with {_P9} select source, count(*) texts, count(cut_in) cut_texts, count(*) filter (cut_in = 'word') cut_in_word, count(*) filter (cut_in = 'sentence') cut_in_sentence, count(*) filter (cut_in is not null and decided_by = 'trigram') by_trigram,
 count(*) filter (cut_in is not null and decided_by in ('two words', 'last word')) by_shorter, count(*) filter (cut_in is not null and decided_by = 'structure') by_structure, count(*) filter (cut_in is not null and decided_by = 'length') by_length, count(cut_in) / count(*) cut_share from found group by 1""",
}
