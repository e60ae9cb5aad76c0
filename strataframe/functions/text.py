"""Lexical search: text matches by ordered repairs, path ranks, excerpts, profiles, formats."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the repairs, in the order in which they are tried, and of several in one packet.
MODES = ["SUBSTRING_CASEFOLD_NFKC", "SUBSTRING_SOFT_HYPHEN_REMOVED", "SUBSTRING_LINEBREAK_DEHYPHENATED", "SUBSTRING_WHITESPACE_NORMALIZED"]
MIXED = "MIXED_DETERMINISTIC_NORMALIZATION"
_BREAK = re.compile(r"(?<=[^\W_])[-‐‑][ \t]*[\r\n]+[ \t]*(?=[^\W_])")


def _fold(text: str) -> tuple[str, list[int]]:
    """Each character in compatibility form and folded on its own, and the source position of every result character."""
    if text.isascii():
        return text.lower(), list(range(len(text)))
    out, at = [], []
    for i, c in enumerate(text):
        part = unicodedata.normalize("NFKC", c).casefold()
        out.append(part)
        at += [i] * len(part)
    return "".join(out), at


def _cut(text: str, at: list[int], spans: list[tuple[int, int, str]]) -> tuple[str, list[int]]:
    """Replaces spans by at most one character that keeps the position of the span's first."""
    out, places, here = [], [], 0
    for a, b, new in spans:
        out.append(text[here:a])
        places += at[here:a]
        if new:
            out.append(new)
            places.append(at[a])
        here = b
    return "".join([*out, text[here:]]), places + at[here:]


def _repaired(text: str) -> Iterator[tuple[str, list[int]]]:
    """The text as it is matched, after each further repair."""
    now, at = _fold(text)
    yield now, at
    now, at = _cut(now, at, [(i, i + 1, "") for i, c in enumerate(now) if c == "­"])
    yield now, at
    now, at = _cut(now, at, [(m.start(), m.end(), "") for m in _BREAK.finditer(now)])
    yield now, at
    blanks = [(m.start(), m.end(), "" if m.start() == 0 or m.end() == len(now) else " ") for m in re.finditer(r"\s+", now)]
    yield _cut(now, at, blanks)


def text_match(text: str | None, query: str | None) -> tuple[int, str, int, int] | None:
    """Number of non-overlapping matches, mode, and source span of the first; null without a match or query."""
    if text is None or not query:
        return None
    for mode, (value, at), (q, _) in zip(MODES, _repaired(text), _repaired(query), strict=True):
        if q and at and (first := value.find(q)) >= 0:
            return value.count(q), mode, at[first], at[first + len(q) - 1] + 1
    return None


def _match_batch(text: pd.Series, query: pd.Series) -> pd.DataFrame:
    rows = [text_match(t, q) or (None, None, None, None) for t, q in zip(text, query, strict=True)]
    return pd.DataFrame(rows, columns=["match_count", "match_mode", "source_start", "source_end"]).astype({c: "Int32" for c in ("match_count", "source_start", "source_end")})


def match_text(text: str | Column, query: str | Column) -> Column:
    """``text_match`` over Arrow batches, as a struct; its fields are null without a match. Needs an active session."""
    schema = T.StructType([T.StructField(n, T.StringType() if n == "match_mode" else T.IntegerType()) for n in ("match_count", "match_mode", "source_start", "source_end")])
    return F.pandas_udf(_match_batch, schema)(text, query)


def ascii_match_count(text: Column, query: Column) -> Column:
    """Matches of the first mode where both are ASCII, without Python: non-overlapping, regardless of case."""
    t, q = F.lower(text), F.lower(query)
    return F.when(F.length(q) > 0, ((F.length(t) - F.length(F.replace(t, q, F.lit("")))) / F.length(q)).cast("int"))


def located(df: DataFrame, text: str, query: str) -> DataFrame:
    """The rows of ``df`` whose text matches, with match_count, source_start and source_end, as ``text_match`` has them.

    ASCII texts that hold the query as it stands are matched by expressions; only the others go to Python.
    """
    t, q = F.lower(text), F.lower(query)
    ascii = F.col(text).rlike(r"^[\x00-\x7F]*\z") & F.col(query).rlike(r"^[\x00-\x7F]+\z")
    at = F.when(ascii & (F.instr(t, q) > 0), F.instr(t, q) - 1)
    m = df.withColumn("_at", at).withColumn("_m", match_text(F.when(F.col("_at").isNull(), F.col(text)), F.col(query)))
    found = m.where("_at is not null or _m.match_count is not null")
    return found.select(
        *df.columns, F.when(F.col("_at").isNotNull(), ascii_match_count(F.col(text), F.col(query))).otherwise(F.col("_m.match_count")).alias("match_count"),
        F.coalesce("_at", "_m.source_start").alias("source_start"), F.coalesce(F.col("_at") + F.length(query), F.col("_m.source_end")).alias("source_end"),
    )


def packet_mode(modes: Column) -> Column:
    """Mode of a set of matches: the first mode for none, the one there is, else ``MIXED``."""
    return F.when(F.size(modes) == 0, MODES[0]).when(F.size(modes) == 1, F.element_at(modes, 1)).otherwise(MIXED)


def folded(text: Column) -> Column:
    """Compatibility form, folded: ASCII texts by an expression, only the others in Python. Needs an active session."""
    plain = text.rlike(r"^[\x00-\x7F]*\z")
    other = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold()), T.StringType())
    return F.when(plain, F.lower(text)).otherwise(other(F.when(~plain, text)))


def excerpt(text: Column, start: Column, end: Column, context: int = 160, most: int = 512) -> Column:
    """``context`` characters on either side of a match, at most ``most`` in all."""
    a = F.greatest(F.lit(0), start - context)
    return F.substr(text, a + 1, F.least(F.lit(most), end + context - a))


def path_rank(path: Column, query: str) -> Column:
    """0 if the base name is the query, 1 if it begins so, 2 if the path contains it, 3 if it contains all its words, else null."""
    low = F.lower(path)
    base = F.substring_index(low, "/", -1)
    q = query.lower()
    words = [w for w in re.split(r"[^\w.-]+", q) if w]
    every = F.lit(bool(words))
    for w in words:
        every = every & low.contains(w)
    return F.when(base == q, 0).when(base.startswith(q), 1).when(low.contains(q), 2).when(every, 3)


def normalized_query(query: str, most_bytes: int = 512) -> str:
    """Stripped, compatibility form, folded, slashes forward; blank, control characters and overlong queries are errors."""
    if not isinstance(query, str) or not query.strip():
        raise ValueError("a query is required")
    if any(ord(c) < 32 for c in query) or len(query.encode()) > most_bytes:
        raise ValueError("the query has control characters or is too long")
    return unicodedata.normalize("NFKC", query.strip()).casefold().replace("\\", "/")


def extensions(c: Column) -> Column:
    """Distinct extensions in lower case with one leading dot, sorted."""
    return F.array_sort(F.array_distinct(F.transform(c, lambda x: F.concat(F.lit("."), F.regexp_replace(F.lower(x), r"^\.+", "")))))


# Terms of a question about changes, and about structure.
CHANGE_TERMS = ["change", "changed", "compare", "comparison", "difference", "diff", "before", "after", "变化", "变更", "差异", "比较", "对比", "更新", "新增", "删除", "演变"]
STRUCTURE_TERMS = ["structure", "directory", "directories", "folder", "folders", "tree", "hierarchy", "layout", "organization", "目录", "结构", "文件夹", "层级", "树状"]


def question_profile(question: Column) -> Column:
    """CHANGE_TRIAGE, else STRUCTURE_OVERVIEW, else GENERAL, by the terms a question contains in folded compatibility form.

    A term within a longer word counts, so single words need no test of their own. A blank question is null.
    """
    low = F.nullif(F.trim(folded(question)), F.lit(""))
    has = lambda terms: low.rlike("|".join(re.escape(t) for t in terms))
    return F.when(has(CHANGE_TERMS), "CHANGE_TRIAGE").when(has(STRUCTURE_TERMS), "STRUCTURE_OVERVIEW").when(low.isNotNull(), "GENERAL")


def role_of(kind: Column, role: Column | None = None, wide: bool = False) -> Column:
    """Role inferred from an item's kind where it has none; ``wide`` knows figures, sheets, slides and documents too."""
    k = F.lower(kind)
    out = (
        F.when(k.contains("heading") | k.endswith("_title"), "HEADING").when(k.contains("table_cell") | (k == "xlsx_cell"), "TABLE_CELL").when(k.contains("table"), "TABLE")
    )
    if wide:
        out = (
            out.when(k.rlike("chart|image|picture"), "FIGURE").when(k.contains("sheet"), "SHEET").when(k.contains("slide"), "SLIDE").when(k.rlike("(_document|_workbook|_presentation)$"), "DOCUMENT")
        )
    out = out.otherwise("PARAGRAPH")
    return out if role is None else F.coalesce(role, out)


def document_format(content: Column, name: Column) -> Column:
    """Format by the first bytes; a suffix alone admits only media. ZIP containers are told apart by their members elsewhere."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("255044462D"), "PDF").when(head.startswith("89504E470D0A1A0A"), "PNG").when(head.startswith("FFD8FF"), "JPEG")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "TIFF").when(head.startswith("504B0304"), "ZIP")
        .when(head.startswith("52494646") & F.substr(head, F.lit(17)).startswith("57415645"), "WAV").when(head.startswith("664C6143"), "FLAC").when(head.startswith("4F676753"), "OGG")
        .when(head.startswith("494433"), "MP3").when(F.substr(head, F.lit(9), F.lit(8)) == "66747970", F.when(F.lower(name).rlike(r"\.m4a$"), "M4A").otherwise("MP4"))
    )


def subtitle_ms(text: Column) -> Column:
    """Milliseconds of ``HH:MM:SS,mmm``; null if it can't be read."""
    p = lambda i: F.nullif(F.regexp_extract(text, r"^\s*(\d+):(\d\d):(\d\d)[,.](\d{3})\s*$", i), F.lit("")).try_cast("bigint")
    return ((p(1) * 60 + p(2)) * 60 + p(3)) * 1000 + p(4)


def ocr_key(text: Column) -> Column:
    """Text of a frame as it is compared: compatibility form, folded, white space collapsed."""
    return F.trim(F.regexp_replace(folded(text), r"\s+", " "))


def rotation(tag: Column, side: Column) -> Column:
    """Quarter turns of a stream in degrees, 0 to 270, by its side data, else its tag; null for other angles."""
    turn = F.pmod(F.coalesce(side.try_cast("double"), tag.try_cast("double")), F.lit(360.0))
    return F.when(turn.isin(0.0, 90.0, 180.0, 270.0), turn.cast("int"))


def rate_mode(average: Column, real: Column) -> Column:
    """CONSTANT if both frame rates are equal, VARIABLE_SUSPECTED if not, UNKNOWN if one can't be read."""
    part = lambda c, i: F.split_part(c, F.lit("/"), F.lit(i)).try_cast("bigint")
    known = (part(average, 2) > 0) & (part(real, 2) > 0) & part(average, 1).isNotNull() & part(real, 1).isNotNull()
    same = part(average, 1) * part(real, 2) == part(real, 1) * part(average, 2)
    return F.when(~F.coalesce(known, F.lit(False)), "UNKNOWN").when(same, "CONSTANT").otherwise("VARIABLE_SUSPECTED")


def frame_rate(rate: Column) -> Column:
    """``n/d`` as a number; null for a zero denominator."""
    n, d = F.split_part(rate, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(rate, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(d > 0, n / d)
