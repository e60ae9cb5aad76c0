"""Documents as sources: containers, HTML blocks, reading order, payload hashes, subtitles."""

from __future__ import annotations

import io
import re
import zipfile
from bisect import bisect
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of a package: members, expansion of one, expanded bytes.
MEMBERS, RATIO, EXPANDED = 10_000, 200, 1 << 30
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th")


class _Events(HTMLParser):
    """A page as a flat list: where in its text each tag of a block stands."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[tuple[str, bool, int]] = []
        self.text: list[str] = []
        self.at = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags.append((tag, True, self.at))

    def handle_endtag(self, tag: str) -> None:
        self.tags.append((tag, False, self.at))

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        self.at += len(data)


def _intervals(tags: list[tuple[str, bool, int]], end: int) -> list[tuple[str, int, int]]:
    """(tag, from, to) of the blocks in the order in which they end, by the number of their opening tag.

    A closing tag ends the latest opening one of its name; opening tags after that one are void. What is left
    at the end of the page runs to it.
    """
    opened: dict[str, list[int]] = {t: [] for t in BLOCKS}
    out = []
    for k, (tag, opens, at) in enumerate(tags):
        if tag not in opened:
            continue
        if opens:
            opened[tag].append(k)
        elif opened[tag]:
            first = opened[tag].pop()
            out.append((tag, tags[first][2], at))
            for numbers in opened.values():
                del numbers[bisect(numbers, first) :]
    return out + [(tags[k][0], tags[k][2], end) for k in sorted(k for numbers in opened.values() for k in numbers)]


def html_block_rows(source: str | None) -> list[tuple[int, str, str]]:
    """(ordinal, role, text) of the blocks of a page; a block's text is that of its interval, inner blocks included.

    Empty blocks use an ordinal up. A void block's text stays in those around it.
    """
    events = _Events()
    events.feed(source or "")
    events.close()
    whole = "".join(events.text)
    blocks = ((n, tag, " ".join(whole[a:b].split())) for n, (tag, a, b) in enumerate(_intervals(events.tags, len(whole)), 1))
    return [(n, "HEADING" if tag.startswith("h") else "PARAGRAPH", text) for n, tag, text in blocks if text]


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, ordinal, role, text of all blocks; null pages give none."""
    kind = pages.schema[key].dataType.simpleString()

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *r) for k, h in zip(b["k"], b["h"], strict=True) for r in html_block_rows(h)], columns=[key, "ordinal", "role", "text"])

    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(blocks, f"`{key}` {kind}, ordinal int, role string, text string")


def reading_order(members: DataFrame, spine: DataFrame) -> DataFrame:
    """Members of books in reading order: book, name, position. The spine first, then other pages by name; repeats keep the first place.

    ``members``: book, name; ``spine``: book, name, place.
    """
    pages = members.where(F.lower("name").rlike(r"\.(x?html?)$")).select("book", "name").distinct()
    first = spine.groupBy("book", "name").agg(F.min("place").alias("place"))
    both = pages.join(first, ["book", "name"], "left")
    from pyspark.sql import Window

    w = Window.partitionBy("book").orderBy(F.col("place").asc_nulls_last(), "name")
    return both.select("book", "name", F.row_number().over(w).alias("position"))


def container_problem(content: bytes | None) -> str | None:
    """Why a ZIP package must not be opened; null if it may."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            infos = z.infolist()
    except (zipfile.BadZipFile, ValueError, OSError):
        return "NOT_A_PACKAGE"
    names = [i.filename for i in infos]
    if len(infos) > MEMBERS:
        return "TOO_MANY_MEMBERS"
    if len(set(names)) < len(names):
        return "DUPLICATE_MEMBER"
    if any(i.flag_bits & 1 for i in infos):
        return "ENCRYPTED_MEMBER"
    if any(n.startswith("/") or ".." in n.split("/") for n in names):
        return "UNSAFE_PATH"
    if sum(i.file_size for i in infos) > EXPANDED:
        return "EXPANDED_TOO_LARGE"
    if any(i.file_size > RATIO * max(1, i.compress_size) for i in infos):
        return "RATIO_TOO_HIGH"
    return None


def container_problems(files: DataFrame, key: str, content: str) -> DataFrame:
    kind = files.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b["k"], "problem": [container_problem(c) for c in b["c"]]})

    return files.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(judge, f"`{key}` {kind}, problem string")


def subtitle_cues(files: DataFrame, key: str, text: str) -> DataFrame:
    """Cues of subtitle files: key, start_ms, end_ms, text."""
    from strataframe.functions.text import subtitle_ms

    cue = r"(\d+:\d\d:\d\d[,.]\d{3})\s*-->\s*(\d+:\d\d:\d\d[,.]\d{3})[^\n]*\n([\s\S]*?)(?=\n\s*\n|\s*$)"
    whole = F.explode(F.regexp_extract_all(F.regexp_replace(text, "\r", ""), F.lit(cue), F.lit(0))).alias("c")
    part = lambda i: F.regexp_extract("c", cue, i)
    return files.select(key, whole).select(key, subtitle_ms(part(1)).alias("start_ms"), subtitle_ms(part(2)).alias("end_ms"), F.trim(F.regexp_replace(part(3), r"\s*\n\s*", " ")).alias("text"))


def payload_hashes(files: DataFrame, scope: str, path: str, content: str, per_file: int = 1 << 30, total: int = 8 << 30) -> DataFrame:
    """Digests of files in canonical order until the budget is used up: scope, path, status, digest, bytes_hashed.

    A rejected file uses nothing of the budget, so admission is a fold in the order of paths. It sees sizes only,
    streams a sorted partition and holds one number. The hash itself is the engine's.
    """
    rows = files.select(scope, path, F.octet_length(content).cast("bigint").alias("size"))

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, left = None, total
        for b in batches:
            out = []
            for own, size in zip(b[scope], b["size"], strict=True):
                if own != current:
                    current, left = own, total
                status = "FILE_TOO_LARGE" if size > per_file else "TOTAL_BYTE_BUDGET_EXHAUSTED" if size > left else "HASHED"
                left -= size if status == "HASHED" else 0
                out.append(status)
            yield b.assign(status=out)

    ordered = rows.where("size is not null").repartition(scope).sortWithinPartitions(scope, path)
    admitted = ordered.mapInPandas(admit, f"`{scope}` string, `{path}` string, size bigint, status string")
    done = files.select(scope, path, content).join(admitted, [scope, path])
    ok = F.col("status") == "HASHED"
    status = F.when(ok & (F.col("size") == 0), "EMPTY_FILE_HASHED").otherwise(F.col("status"))
    return done.select(scope, path, status.alias("status"), F.when(ok, F.sha2(content, 256)).alias("digest"), F.when(ok, F.col("size")).alias("bytes_hashed"))


#: A record of a status listing, by its two letters: a rename or copy has a second path, its origin.
_STATUS = re.compile(rb"(?P<two>(?=[^\0]?[RC])[^\0]{2}) [^\0]+\0(?P<origin>[^\0]+)\0|(?P<one>[^\0RC]{2}) (?P<path>[^\0]+)\0", re.S)


def git_status(raw: bytes) -> list[tuple[str, str]]:
    """(status, path) of ``git status --porcelain=v1 -z``; a rename or copy is reported under its second path."""
    found = list(_STATUS.finditer(raw if raw.endswith(b"\0") or not raw else raw + b"\0"))
    if b"".join(m.group() for m in found).strip(b"\0") != raw.strip(b"\0"):
        raise ValueError("malformed or incomplete status record")
    text = lambda b: b.decode("utf-8", "surrogateescape")
    return [(text(m["two"] or m["one"]), text(m["origin"] or m["path"])) for m in found]


def envelope(df: DataFrame, command: str, run_id: str | None = None) -> DataFrame:
    """Rows as JSON objects of the output envelope, one per row."""
    body = F.struct(F.lit(command).alias("command"), F.array().cast("array<string>").alias("errors"), F.struct(*df.columns).alias("result"), F.lit(run_id).cast("string").alias("run_id"), F.lit(1).alias("schema_version"), F.lit("OK").alias("status"), F.array().cast("array<string>").alias("warnings"))
    return df.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))
