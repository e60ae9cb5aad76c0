"""What a reader is shown: places in native terms, views by role, chosen snapshots, pages and packets of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.operators.selection import top_per

# Formats by the way their places are named; fields of a place with their names in a label (quoted ones are texts; of several the first that is there); kinds of place, the
# first whose field is there, else the last.
IMAGES, PDF, AUDIO, VIDEO = ["PNG", "JPEG", "TIFF"], ["PDF"], ["WAV", "FLAC", "MP3", "M4A", "AAC", "OGG", "OPUS"], ["MP4", "MOV", "MKV", "WEBM"]
PLACES = {
    "PAGE": (["page", "block", "outline", "annotation", "form_field"], [("annotation", "PDF_ANNOTATION"), ("form_field", "PDF_FORM_FIELD"), ("outline", "PDF_OUTLINE"), ("page", "PDF_PAGE")], "DOCUMENT_ITEM"),
    "XLSX": (['sheet""', 'cell|table""|chart', "comment"], [("comment", "WORKBOOK_COMMENT"), ("cell", "WORKBOOK_CELL"), ("table", "WORKBOOK_TABLE"), ("chart", "WORKBOOK_CHART")], "WORKBOOK_SHEET"),
    "PPTX": (["slide", "shape", "table", "row", "column", "chart", "notes", "accessibility"], [("notes", "PRESENTATION_SPEAKER_NOTES"), ("chart", "PRESENTATION_CHART"), ("accessibility", "PRESENTATION_ACCESSIBILITY"), ("row", "PRESENTATION_TABLE_CELL")], "PRESENTATION_SLIDE_ITEM"),
    "DOCX": (["section", "block", "table", "row", "column", "comment", "footnote", "endnote", "revision"], [("comment", "WORD_COMMENT"), ("footnote", "WORD_FOOTNOTE"), ("endnote", "WORD_ENDNOTE"), ("revision", "WORD_REVISION"), ("row", "WORD_TABLE_CELL")], "WORD_BLOCK"),
}
# Roles of each view; READ has all.
VIEWS = {"TABLES": ["TABLE", "TABLE_CELL"], "FORMULAS": ["FORMULA"], "STRUCTURE": ["DOCUMENT", "SECTION", "HEADING", "TABLE", "FIGURE", "SHEET", "SLIDE", "METADATA"]}
#: Longest serialized page, in bytes.
PAGE_BYTES = 100_000


def _seconds(ms: Column) -> Column:
    return F.format_string("%.3fs", ms / 1000)


def native_location(source_format: Column, location: Column, fields: T.StructType, fallback: Column) -> tuple[Column, Column, Column]:
    """Kind, label and locator of a place, in the terms of its format. ``fields``: the type of ``location``; fields it lacks are unknown.

    A place none of whose parts is known is named by ``fallback`` (the item's node id, else its kind).
    """
    have = {f.name for f in fields.fields}
    at = lambda n: location[n] if n in have else F.lit(None)
    piece = lambda value, label, place: F.when(value.isNotNull(), F.struct(label.alias("label"), place.alias("place")))
    kinds, parts = F.lit(None).cast("string"), F.lit(None).cast("array<struct<label:string,place:string>>")

    def listed(names: list[str]) -> Column:
        def one(n: str) -> Column:
            name, text = n.strip('"'), at(n.strip('"')).cast("string")
            return piece(text, F.concat(F.lit(name.replace("_", " ") + (' "' if n != name else " ")), text, F.lit('"' if n != name else "")), F.concat(F.lit(name + ":"), text))

        return F.array(*[F.coalesce(*map(one, n.split("|"))) for n in names])

    def branch(test: Column, kind: Column, found: Column) -> None:
        nonlocal kinds, parts
        kinds, parts = F.when(test, kind).otherwise(kinds), F.when(test, F.array_compact(found)).otherwise(parts)

    timed = lambda a, b: [
        piece(a, _seconds(a), F.concat(F.lit("start_ms:"), a.cast("string"))), piece(b, F.concat(F.lit("to "), _seconds(b)), F.concat(F.lit("end_ms:"), b.cast("string")))
    ]
    ordinal = listed(["ordinal"])
    item = F.transform(ordinal, lambda x: F.when(x.isNotNull(), F.struct(F.replace(x.label, F.lit("ordinal"), F.lit("item")).alias("label"), F.replace(x.place, F.lit("ordinal"), F.lit("item")).alias("place"))))
    for family, (names, by_field, other) in PLACES.items():
        kind = F.coalesce(*[F.when(at(n).isNotNull(), k) for n, k in by_field], F.lit(other))
        branch(source_format.isin(PDF) if family == "PAGE" else source_format == family, kind, listed(names))
    page = F.coalesce(at("page").cast("int"), F.lit(1))
    on_image = F.concat(F.array(piece(page, F.concat(F.lit("page "), page.cast("string")), F.concat(F.lit("page:"), page.cast("string")))), listed(PLACES["PAGE"][0][1:]))
    branch(source_format.isin(IMAGES), F.coalesce(*[F.when(at(n).isNotNull(), k) for n, k in PLACES["PAGE"][1][:3]], F.lit("IMAGE_REGION")), on_image)
    title = F.when(at("section").isNotNull() & (F.coalesce(at("section_title").cast("string"), F.lit("")) != ""), F.struct(F.concat(F.lit('heading "'), at("section_title").cast("string"), F.lit('"')).alias("label"), F.lit(None).cast("string").alias("place")))
    branch(source_format == "EPUB", F.lit("EPUB_SECTION_ITEM"), F.concat(listed(["section"]), F.array(title), item))
    branch(source_format.isin(AUDIO), F.lit("AUDIO_TIME_RANGE"), F.array(*timed(at("start_ms").cast("bigint"), at("end_ms").cast("bigint"))))
    start = F.coalesce(at("start_ms").cast("bigint"), at("timestamp_ms").cast("bigint"))
    stream = piece(at("stream_index"), F.concat(F.lit("stream "), at("stream_index").cast("string")), F.concat(F.lit("stream:"), at("stream_index").cast("string")))
    branch(source_format.isin(VIDEO), F.lit("VIDEO_TIME_RANGE"), F.array(*timed(start, F.coalesce(at("end_ms").cast("bigint"), start)), stream))
    parts = F.coalesce(parts, F.array_compact(item))
    none = F.size(parts) == 0
    join = lambda field, by: F.when(none, fallback).otherwise(F.array_join(F.transform(parts, lambda x: x[field]), by))
    return F.coalesce(kinds, F.lit("DOCUMENT_ITEM")), join("label", ", "), join("place", "/")


def in_views(role: Column) -> Column:
    """The views that show an item of this role, as an array."""
    return F.array_compact(F.array(F.lit("READ"), *[F.when(role.isin(roles), F.lit(v)) for v, roles in VIEWS.items()]))


def chosen_scopes(scopes: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """The scopes asked for, or all enabled managed ones, in order. ``scopes``: scope_id, enabled, managed. Unknown ids are an error when read."""
    if ids is None:
        return scopes.where("enabled and managed").select("scope_id").distinct().orderBy("scope_id")
    asked = scopes.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "scope_id string")
    known = scopes.select("scope_id", F.lit(True).alias("_known")).distinct()
    there = F.when(F.col("_known"), F.col("scope_id")).otherwise(F.raise_error(F.concat(F.lit("unknown scope "), F.col("scope_id"))))
    return asked.join(known, "scope_id", "left").select(there.alias("scope_id")).orderBy("scope_id")


def resolved_snapshots(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """Snapshots by policy: request, policy, snapshot_id (null unless found), outcome (RESOLVED, NOT_FOUND, AMBIGUOUS).

    ``candidates``: snapshot_id, scope_id, created (valid snapshots). ``requests``: request, policy, named, scope_id.
    EXACT_ID and TASK_CREATED take the named snapshot if it is one of the scope; ONLY_COMPATIBLE the scope's only
    one; LATEST_VALID its newest; PREVIOUS_VALID the newest created before the named one. Several newest ones are
    ambiguous. An as-of look-up: every instant of a scope knows the one before it, so no request meets all
    candidates.
    """
    instants = candidates.groupBy("scope_id", "created").agg(F.count(F.lit(1)).alias("n"), F.min("snapshot_id").alias("id"))
    order = Window.partitionBy("scope_id").orderBy("created")
    instants = instants.withColumn("before", F.lag(F.struct("n", "id")).over(order))
    newest = instants.groupBy("scope_id").agg(F.max_by(F.struct("n", "id"), "created").alias("newest"), F.sum("n").alias("all"))
    own = candidates.select(F.col("snapshot_id").alias("named"), F.col("scope_id").alias("_scope"), "created")
    found = requests.join(own, "named", "left").join(newest, "scope_id", "left")
    anchors = instants.select(F.col("scope_id").alias("_scope"), "created", "before")
    found = found.join(anchors, ["_scope", "created"], "left")
    fits = F.col("_scope") == F.col("scope_id")
    pick = (
        F.when(F.col("policy").isin("EXACT_ID", "TASK_CREATED"), F.when(fits, F.struct(F.lit(1).cast("bigint").alias("n"), F.col("named").alias("id"))))
        .when(F.col("policy") == "ONLY_COMPATIBLE", F.when(F.col("all").isNotNull(), F.struct(F.col("all").alias("n"), F.col("newest.id").alias("id"))))
        .when(F.col("policy") == "LATEST_VALID", F.col("newest")).when(F.col("policy") == "PREVIOUS_VALID", F.when(fits, F.col("before")))
    )
    return found.withColumn("_p", pick).select(
        "request", "policy", F.when(F.col("_p.n") == 1, F.col("_p.id")).alias("snapshot_id"), F.when(F.col("_p.n").isNull(), "NOT_FOUND").when(F.col("_p.n") > 1, "AMBIGUOUS").otherwise("RESOLVED").alias("outcome")
    )


def fitted_page(rows: DataFrame, keys: list[str], order: list[Column], content: str, limit: int, most: int = PAGE_BYTES, envelope: int = 2) -> DataFrame:
    """The first rows of each key that fit into a page: rows with ``rank``, and ``shown``, the number on the page.

    A page has at most ``limit`` rows; while its serialized ``content`` with separators and ``envelope`` bytes is
    longer than ``most``, it is halved. An envelope that is too long on its own is an error.
    """
    if envelope > most:
        raise ValueError("the envelope alone exceeds the page")
    page = top_per(rows, keys, order, limit)
    upto = Window.partitionBy(*keys).orderBy("rank")  # at most ``limit`` rows
    size = page.withColumn("_bytes", F.sum(F.octet_length(content) + 1).over(upto) - 1 + envelope)
    sizes = size.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "_bytes"))).alias("s"))
    halves = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(max(1, limit).bit_length())), lambda k: F.floor(F.size("s") / F.pow(F.lit(2.0), k)).cast("int")))
    shown = F.get(F.filter(halves, lambda n: (n == 0) | (F.coalesce(F.get(F.col("s"), n - 1)._bytes, F.lit(0)) <= most)), F.lit(0))
    return size.drop("_bytes").join(sizes.select(*keys, shown.alias("shown")), keys).where("rank <= shown")


def packet_section(rows: DataFrame, key: str, order: list[Column], content: Column, name: str, most: int) -> DataFrame:
    """One section of a context packet: key, section, shown, omitted, content (the first ``most`` of each key, in order)."""
    made = rows.withColumn("_c", content)
    first = top_per(made, [key], order, most).groupBy(key).agg(F.count(F.lit(1)).alias("shown"), F.array_sort(F.collect_list(F.struct("rank", "_c"))).alias("_l"))
    total = made.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return total.join(first, key).select(key, F.lit(name).alias("section"), "shown", (F.col("_n") - F.col("shown")).alias("omitted"), F.array_join(F.col("_l")["_c"], "\n").alias("content"))


def bounded_range(start: Column, end: Column, duration: Column) -> tuple[Column, Column]:
    """A time range within ``[0, duration)`` that is at least one wide; null if either end is."""
    a = F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0), F.least(start, duration - 1)))
    return a, F.when(a.isNotNull(), F.greatest(a + 1, F.least(end, duration)))


def word_class(start: Column, end: Column, status: Column) -> Column:
    """Kind of a transcript's word: unaligned without a time, aligned by force, else approximate."""
    return F.when(start.isNull() | end.isNull(), "audio_unaligned_word").when(status == "CTC_FORCED_ALIGNED", "audio_aligned_word").otherwise("audio_approximate_word")


def frame_score(luminance: Column, sharpness: Column, dark: Column, light: Column) -> Column:
    """How well a frame is exposed and focused, less what is clipped, to six places."""
    exposure = F.greatest(F.lit(0.0), 1.0 - F.abs(luminance - 127.5) / 127.5)
    return F.round(0.55 * exposure + 0.45 * F.least(F.lit(1.0), sharpness / 500.0) - 0.60 * F.least(F.lit(1.0), dark + light), 6)


def quartile_times(start: Column, end: Column) -> Column:
    """A quarter, half and three quarters into a range, each once; null for an empty one."""
    length = end - start
    at = lambda k: start + F.floor(length * k / 4).cast("bigint")
    return F.when((start >= 0) & (length > 0), F.array_distinct(F.array(at(1), at(2), at(3))))


def page_texts(items: DataFrame, native: str, scanned: str, least: int) -> DataFrame:
    """Text of each page: doc, page, text, source. Scanned text stands in where native text has fewer than ``least`` characters and it has more."""
    kept = items.where(F.col("page").isNotNull() & F.col("kind").isin(native, scanned))
    texts = kept.groupBy("doc", "page", "kind").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", F.coalesce("text", F.lit("")).alias("t")))).t, "\n").alias("text"))  # the items of one page
    page = texts.groupBy("doc", "page").agg(F.max(F.when(F.col("kind") == native, F.col("text"))).alias("n"), F.max(F.when(F.col("kind") == scanned, F.col("text"))).alias("o"))
    size = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0))
    scan = (size("n") < least) & (size("o") > size("n"))
    return page.select("doc", "page", F.when(scan, F.col("o")).otherwise(F.coalesce("n", F.lit(""))).alias("text"), F.when(scan, "OCR").otherwise("NATIVE").alias("source"))


def markdown_blocks(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Headings of Markdown texts: key, line, level, title, parent (line of the heading above it by level, null at the top).

    A heading's parent is the last one before it with a lower level. Embedded data is left out of titles.
    """
    heading = r"^(#{1,6}) +(\S.*)$"
    lines = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line", "_t"))
    title = F.regexp_replace(F.trim(F.regexp_extract("_t", heading, 2)), r"data:[a-z/+\-]+;base64,[A-Za-z0-9+/=]+", "")
    rows = lines.where(F.col("_t").rlike(heading)).select(key, "line", F.length(F.regexp_extract("_t", heading, 1)).alias("level"), title.alias("title"))
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.max(F.when(F.col("level") < k, F.col("line"))).over(before) for k in range(2, 7)]
    parent = F.lit(None).cast("int")
    for k, c in zip(range(2, 7), above):
        parent = F.when(F.col("level") == k, c).otherwise(parent)
    return rows.withColumn("parent", parent)
