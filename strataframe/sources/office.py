"""Office packages as document items, read with the standard library: workbooks, text documents, slides, books."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.sources.documents import container_problem, html_block_rows

ITEM = "item_index int, kind string, role string, text string, place string, level int"
#: Bytes of one XML part, and items of one document, beyond which a package is refused.
PART, ITEMS = 64 << 20, 200_000


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _text(e: ElementTree.Element) -> str:
    return "".join(x.text or ("\t" if _local(x.tag) == "tab" else "") for x in e.iter() if _local(x.tag) in ("t", "tab"))


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        info = z.getinfo(name)
    except KeyError:
        return None
    if info.file_size > PART:
        raise ValueError("PART_TOO_LARGE")
    raw = z.read(info)
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw[:4096]:
        raise ValueError("DOCTYPE_REFUSED")
    return ElementTree.fromstring(raw)


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relations of a part: id to the part it names."""
    folder, name = posixpath.split(part)
    root = _part(z, f"{folder}/_rels/{name}.rels".lstrip("/"))
    return {} if root is None else {e.get("Id", ""): posixpath.normpath(posixpath.join(folder, e.get("Target", "").lstrip("/") if e.get("Target", "").startswith("/") else e.get("Target", ""))) for e in root}


def _workbook(z: zipfile.ZipFile) -> Iterator[tuple]:
    shared = _part(z, "xl/sharedStrings.xml")
    strings = [] if shared is None else [_text(e) for e in shared]
    names, book = _targets(z, "xl/workbook.xml"), _part(z, "xl/workbook.xml")
    for sheet in (e for e in book.iter() if _local(e.tag) == "sheet"):
        title, part = sheet.get("name", ""), names.get(_attribute(sheet, "id") or "", "")
        yield "xlsx_sheet", "SHEET", title, title, 0
        root = _part(z, part)
        if root is None:
            continue
        for c in (e for e in root.iter() if _local(e.tag) == "c"):
            own = {_local(x.tag): x for x in c}
            value = own["v"].text if "v" in own else _text(own["is"]) if "is" in own else None
            if c.get("t") == "s" and value is not None:
                value = strings[int(value)] if int(value) < len(strings) else None
            if "f" in own and own["f"].text:
                yield "xlsx_formula", "FORMULA", "=" + own["f"].text, f"{title}!{c.get('r')}", 1
            if value is not None:
                yield "xlsx_cell", "TABLE_CELL", value, f"{title}!{c.get('r')}", 1
        for e in (e for e in root.iter() if _local(e.tag) == "mergeCell"):
            yield "xlsx_merged_range", "TABLE", e.get("ref"), f"{title}!{e.get('ref')}", 1


def _document(z: zipfile.ZipFile) -> Iterator[tuple]:
    body = next((e for e in _part(z, "word/document.xml").iter() if _local(e.tag) == "body"), ())

    def paragraph(p: ElementTree.Element) -> tuple | None:
        style = next((_attribute(e, "val") or "" for e in p.iter() if _local(e.tag) == "pStyle"), "")
        m = re.match(r"(?i)heading\s*(\d)|title", style)
        text = " ".join(_text(p).split())
        return (("docx_heading", "HEADING", text, None, int(m.group(1) or 1)) if m else ("docx_paragraph", "PARAGRAPH", text, None, None)) if text else None

    tables = 0
    for e in body:
        if _local(e.tag) == "p" and (row := paragraph(e)):
            yield row
        elif _local(e.tag) == "tbl":
            tables += 1
            yield "docx_table", "TABLE", None, f"table {tables}", None
            for r, tr in enumerate(x for x in e if _local(x.tag) == "tr"):
                for c, tc in enumerate(x for x in tr if _local(x.tag) == "tc"):
                    yield "docx_table_cell", "TABLE_CELL", " ".join(_text(tc).split()), f"table {tables} R{r + 1}C{c + 1}", None
    for part, kind in (("comments", "docx_comment"), ("footnotes", "docx_footnote"), ("endnotes", "docx_endnote")):
        root = _part(z, f"word/{part}.xml")
        for e in root if root is not None else ():
            if text := " ".join(_text(e).split()):
                yield kind, "COMMENT" if part == "comments" else "PARAGRAPH", text, _attribute(e, "id"), None
    for e in _part(z, "word/document.xml").iter():
        if _local(e.tag) in ("ins", "del") and _attribute(e, "id"):
            text = "".join(x.text or "" for x in e.iter() if _local(x.tag) in ("t", "delText"))
            yield f"docx_revision_{_local(e.tag)}", "REVISION", text or None, _attribute(e, "id"), None


def _slides(z: zipfile.ZipFile) -> Iterator[tuple]:
    parts = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
    for k, part in enumerate(parts, 1):
        yield "pptx_slide", "SLIDE", None, f"slide {k}", 0
        for p in (e for e in _part(z, part).iter() if _local(e.tag) == "p"):
            if text := " ".join(_text(p).split()):
                yield "pptx_paragraph", "PARAGRAPH", text, f"slide {k}", None


def _book(z: zipfile.ZipFile) -> Iterator[tuple]:
    pack = next(e.get("full-path", "") for e in _part(z, "META-INF/container.xml").iter() if _local(e.tag) == "rootfile")
    root, folder = _part(z, pack), posixpath.dirname(pack)
    files = {e.get("id"): posixpath.normpath(posixpath.join(folder, e.get("href", ""))) for e in root.iter() if _local(e.tag) == "item"}
    spine = [files[e.get("idref")] for e in root.iter() if _local(e.tag) == "itemref" and e.get("idref") in files]
    rest = sorted(n for n in z.namelist() if re.search(r"(?i)\.x?html?$", n))
    for name in dict.fromkeys([*spine, *rest]):
        if name in z.namelist():
            for _, role, text in html_block_rows(z.read(name).decode("utf-8", "replace")):
                yield "epub_section_text", role, text, posixpath.basename(name), 1 if role == "HEADING" else None


_READERS = (("xl/workbook.xml", "XLSX", _workbook), ("word/document.xml", "DOCX", _document), ("ppt/presentation.xml", "PPTX", _slides), ("META-INF/container.xml", "EPUB", _book))


def package_items(content: bytes | None, query: str | None = None) -> tuple[str | None, str | None, list[tuple]]:
    """(format, problem, items) of a package. With ``query`` only items that contain it are kept while reading."""
    problem = container_problem(content)
    if problem:
        return None, problem, []
    low = query.casefold() if query else None
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for member, kind, read in _READERS:
            if member in z.namelist():
                out: list[tuple] = []
                try:
                    for n, row in enumerate(read(z)):
                        if low is None or (row[2] and low in row[2].casefold()):
                            out.append((n, *row))
                        if len(out) > ITEMS:
                            return kind, "TOO_MANY_ITEMS", []
                except (ElementTree.ParseError, ValueError, StopIteration, AttributeError, IndexError, RuntimeError) as e:
                    return kind, str(e) if str(e).isupper() else "CONTENT_INVALID", []
                return kind, None, out
    return None, "FORMAT_UNKNOWN", []


def office_items(files: DataFrame, key: str, content: str, query: str | None = None) -> DataFrame:
    """key, format, problem and the items of each package; one row without an item where there is none."""
    kind = files.schema[key].dataType.simpleString()
    names = [key, "format", "problem", "item_index", "kind", "role", "text", "place", "level"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, c in zip(b["k"], b["c"], strict=True):
                f, p, found = package_items(None if c is None else bytes(c), query)
                rows += [(k, f, p, *r) for r in found] or [(k, f, p, *[None] * 6)]
            yield pd.DataFrame(rows, columns=names).astype({"item_index": "Int32", "level": "Int32"})

    return files.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(read, f"`{key}` {kind}, format string, problem string, {ITEM}")
