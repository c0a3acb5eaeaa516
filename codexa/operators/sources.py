"""Operators on structured source texts: page marks, block kinds, metadata, paragraph numbering."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.functions import text as X

#: Context kinds of the source format (fixed values).
CONTEXTS = {
    "man_biography": "BIO_MAN", "woman_biography": "BIO_WOMAN", "cross_reference_biography": "BIO_REF", "names_list": "BIO_NAMELIST", "historical_events": "EVENT", "historical_events_batch": "EVENT_BATCH",
    "dictionary_nis": "DIC_NISBA", "dictionary_top": "DIC_TOPONYM", "dictionary_lex": "DIC_LEXICAL", "dictionary_bib": "DIC_BOOK", "dox_pos": "DOX_POSITION", "dox_sec": "DOX_SECT", "editorial": "APPARATUS_NOTE",
}
HEMISTICH = r"[%\x{066a}]\s*~\s*[%\x{066a}]"
NOTE_START = r"^(?:حديث|أثر|تنبيه|قلت|قال المحقق)(?U)\b"
#: Stands for a cut inside a line; no text has it.
CUT = "\u0001"
HEADINGS = ["title", "category", "header-1", "header-2", "header-3", "header-4", "header-5"]


def optional_int(c: Column) -> Column:
    """A whole number that a text is, null for any other."""
    return F.when(F.trim(c).rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*$"), F.replace(F.trim(c), F.lit("_"), F.lit("")).try_cast("int"))


def coerced_text(value) -> str:
    """Text of a JSON value: lists and the values of objects are joined by spaces, without the blank ones."""
    if isinstance(value, dict):
        value = [*value.values()]
    if isinstance(value, list):
        return " ".join(t for t in map(coerced_text, value) if t)
    return "" if value is None else str(value).strip()


def number_of(value) -> int | None:
    try:
        return int(str(value).strip())
    except ValueError:
        return None


BLOCK = "array<struct<kind:string,text:string,parts:array<string>,level:int,context:string,volume:int,page:int>>"


def payload_blocks(source: str | None) -> list[dict]:
    """Blocks of a parser's JSON: a list, or an object with ``content`` or ``blocks``; sections begin with a page mark if they have one.

    A payload of any other shape is an error.
    """
    data = json.loads(source or "null")
    if isinstance(data, dict):
        data = data["blocks"] if data.get("content") is None and isinstance(data.get("blocks"), list) else data.get("content")
    if not isinstance(data, list):
        raise TypeError("a payload must be a list of blocks, or have one under 'content' or 'blocks'")
    out = []
    for item in filter(lambda x: isinstance(x, dict), data):
        section = "blocks" in item and "type" not in item
        if section and type(item.get("volume")) is int and type(item.get("page")) is int:
            out.append(dict(kind="pageNumber", text="", parts=[], level=None, context=None, volume=item["volume"], page=item["page"]))
        for block in item["blocks"] or [] if section else [item]:
            if not isinstance(block, dict):
                continue
            content = block.get("content")
            kind = str(block.get("type") or "").strip()
            mark = content if kind == "pageNumber" and isinstance(content, dict) else {}
            page = (number_of(mark.get("page")) or 1) if kind == "pageNumber" else None
            parts = [t for t in map(coerced_text, content if isinstance(content, list) else [content]) if t]
            out.append(dict(kind=kind, text=coerced_text(content), parts=parts, level=number_of(block.get("level")), context=block.get("extraContext"), volume=number_of(mark.get("volume")), page=page))
    return out


def parsed_blocks(docs: DataFrame, payload: str = "payload", key: str = "id") -> DataFrame:
    """``(key, ord, kind, text, parts, level, context, volume, page)`` of parsed payloads; JSON is read in Arrow batches."""

    @F.pandas_udf(BLOCK)
    def blocks(s: pd.Series) -> pd.Series:
        return s.map(payload_blocks)

    return docs.select(key, F.posexplode(blocks(F.col(payload))).alias("ord", "b")).select(key, "ord", "b.*")


def normal_blocks(docs: DataFrame, payload: str = "payload", key: str = "id") -> DataFrame:
    """``(key, ord, page, volume, type, text)``: parsed blocks as semantic ones, on the page of the last mark before them."""
    rows = with_pages(parsed_blocks(docs, payload, key), [key])
    verse = (F.col("kind") == "verse") & (F.size("parts") > 1)
    text = F.when(verse, F.array_join("parts", " // ")).otherwise(labelled(F.col("kind"), F.col("text")))
    return rows.filter("text <> ''").select(key, "ord", "page", "volume", normal_kind(F.col("kind"), F.col("text")).alias("type"), text.alias("text"))


def page_lists(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """``(key, pages, title)``: pages in the order in which they first occur, and the first title if there is one."""
    first = rows.groupBy(key, "page").agg(F.min(order).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "page"))), lambda x: x["page"]).alias("pages"))


def first_title(docs: DataFrame, payload: str = "payload", key: str = "id") -> DataFrame:
    """``(key, title)``: the first title block's text, empty if there is none."""
    titles = parsed_blocks(docs, payload, key).filter("kind = 'title'").groupBy(key).agg(F.min_by("text", "ord").alias("title"))
    return docs.select(key).join(titles, key, "left").select(key, F.coalesce("title", F.lit("")).alias("title"))


def layout_rows(docs: DataFrame, payload: str = "payload", key: str = "id") -> DataFrame:
    """``(key, ord, part, kind, text, part_a, part_b, level, volume, page)``: a payload's blocks in order, for layout.

    Prose and quotes are cut at page marks, inline titles and notes, and classified; other blocks are as the parser says.
    """
    rows = parsed_blocks(docs, payload, key).withColumn("line", F.array_join("parts", " "))
    named = F.create_map(*[F.lit(x) for kv in CONTEXTS.items() for x in kv])[F.col("context")]
    own = F.col("kind").isin("pageNumber", "title", "header", "verse", "category")
    told = ~own & (F.col("kind") != "blockquote") & named.isNotNull()
    nothing, none = F.lit(""), F.lit(None).cast("int")
    pair = (F.col("kind") == "verse") & (F.size("parts") == 2)
    kind = F.when(F.col("kind") == "pageNumber", "PAGE_REF").when(F.col("kind") == "title", "TITLE").when(F.col("kind") == "header", F.concat(F.lit("HEADING_"), F.when(F.coalesce("level", F.lit(1)).between(1, 5), F.coalesce("level", F.lit(1))).otherwise(5).cast("string")))
    kind = kind.when(pair, "VERSE_PAIR").when(F.col("kind") == "verse", "VERSE_LINE").when(F.col("kind") == "category", "MORPHO_TAG").otherwise(named)
    text = F.when(pair | F.col("kind").isin("category", "pageNumber"), nothing).when(told, X.strip_markers(F.col("line"))).otherwise(F.col("line"))
    half = lambda k: F.when(pair, F.col("parts")[k]).otherwise(nothing)
    plain = rows.filter(own | told).select(key, "ord", F.lit(0).alias("part"), kind.alias("kind"), text.alias("text"), half(0).alias("part_a"), half(1).alias("part_b"), "level", "volume", "page").filter("kind not in ('VERSE_LINE') or text <> '' or kind is null")
    plain = plain.filter("text <> '' or kind in ('PAGE_REF', 'VERSE_PAIR', 'MORPHO_TAG', 'TITLE') or kind like 'HEADING%'")
    prose = rows.filter(~own & ~told & ~X.strip_markers(F.col("line")).isin("", "#", "##", "###")).withColumn("at", F.struct(key, "ord"))
    cut = inline_parts(prose.select("at", "line"), "line", "at")
    kinds = cut.join(prose.select("at", "context"), "at").withColumn("c", classified(F.col("text"), F.col("context")))
    body = F.col("kind") == "BODY"
    # pairs and reports have no text of their own, and go with the blank ones
    found = kinds.select(F.col(f"at.{key}").alias(key), "at.ord", "part", F.when(body, F.col("c.kind")).otherwise(F.col("kind")).alias("kind"), F.when(body, F.col("c.text")).otherwise(F.col("text")).alias("text"), nothing.alias("part_a"), nothing.alias("part_b"), F.when(F.col("kind") == "TITLE", 2).alias("level"), "volume", "page")
    return plain.unionByName(found.filter("text <> '' or kind = 'PAGE_REF'"))


def block_text(kind: Column, text: Column, part_a: Column, part_b: Column) -> Column:
    """A block's text; the halves of a verse are joined."""
    halves = F.array_join(F.filter(F.array(part_a, part_b), lambda p: F.coalesce(p, F.lit("")) != ""), " ")
    return F.trim(F.when(kind == "VERSE_PAIR", halves).otherwise(F.coalesce(text, F.lit(""))))


def with_pages(blocks: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Blocks with the page and volume of the last mark before them (page 1 at first); marks go. ``keys`` name a document."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("kind") == "pageNumber"
    # a mark sets both, also to null
    last = F.last(F.when(mark, F.struct("page", "volume")), ignorenulls=True).over(by)
    filled = blocks.withColumn("at", last).withColumns({"at_page": F.coalesce("at.page", F.lit(1)), "at_volume": F.col("at.volume")}).drop("at")
    return filled.filter(~mark).drop("page", "volume").withColumnsRenamed({"at_page": "page", "at_volume": "volume"})


def normal_kind(kind: Column, text: Column) -> Column:
    """Kinds of parsed blocks as kinds of semantic blocks."""
    return F.when(kind.isin(HEADINGS), "heading").when(kind == "verse", "verse").when((kind == "blockquote") & X.is_arabic(text), "verse").otherwise("paragraph")


def labelled(kind: Column, text: Column) -> Column:
    """Text of a block; years and ages with their labels."""
    label = F.when(kind == "year_of_birth", "Year of birth: ").when(kind == "year_of_death", "Year of death: ").when(kind == "year", "Year: ").when(kind == "age", "Age: ").otherwise("")
    return F.concat(label, text)


def classified(c: Column, context: Column | None = None) -> Column:
    """``struct(kind, text, part_a, part_b, part_c)`` of a content string, by the first rule that holds."""
    hadith = X.split_hadith(c)
    halves = F.filter(F.transform(F.split(c, HEMISTICH), lambda p: F.trim(p)), lambda p: p != "")
    none = F.lit("")
    row = lambda kind, text=None, a=none, b=none, d=none: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), (c if text is None else text).alias("text"), a.alias("part_a"), b.alias("part_b"), d.alias("part_c"))
    out = F.when(c.startswith("$RWY$"), row("HADITH_UNIT", none, hadith["isnad"], hadith["matn"], hadith["hukm"]))
    pair = c.rlike(HEMISTICH)
    out = out.when(pair & (F.size(halves) == 2), row("VERSE_PAIR", none, halves[0], halves[1])).when(pair, row("VERSE_LINE"))
    out = out.when(c.rlike(r"^بسم الله الرحمن الرحيم\s*$"), row("BASMALA")).when(c.startswith("الحمد لله رب العالمين"), row("HAMDALA"))
    out = out.when(c.rlike(r"^\.{6,}$"), row("LACUNA", none)).when(c.rlike("[«»﴿﴾]"), row("QURAN_CITATION"))
    if context is not None:
        named = F.create_map(*[F.lit(x) for kv in CONTEXTS.items() for x in kv])[context]
        out = out.when(named.isNotNull(), row(named))
    return out.otherwise(row("PARAGRAPH"))


def inline_parts(lines: DataFrame, text: str = "line", order: str = "ord") -> DataFrame:
    """Lines cut at page marks, inline titles and notes: ``(order, part, kind, text, volume, page)``."""
    marked = F.regexp_replace(text, r"\s*\bPageV(\d+)P(\d+)\b\s*", f"{CUT}PageV$1P$2{CUT}")
    parts = lines.select(order, F.posexplode(F.split(marked, CUT)).alias("p", "piece"))
    page = F.regexp_extract("piece", r"^PageV(\d+)P(\d+)$", 2)
    parts = parts.withColumns({"page": F.when(page != "", page.cast("int")), "volume": F.when(page != "", F.regexp_extract("piece", r"^PageV(\d+)P(\d+)$", 1).cast("int"))})
    parts = parts.select(order, "p", "page", "volume", F.posexplode(F.filter(F.split("piece", f"{X.WS}+[$]{X.WS}+"), lambda x: F.trim(x) != "")).alias("t", "piece"))
    # only what precedes the first title has notes
    notes = F.when(F.col("t") == 0, F.filter(F.split("piece", f"{X.WS}+[+]{X.WS}+"), lambda x: F.trim(x) != "")).otherwise(F.array("piece"))
    parts = parts.select(order, "p", "t", "page", "volume", F.posexplode(notes).alias("n", "piece"))
    cleaned = F.when(F.col("page").isNotNull(), "").otherwise(X.strip_markers(F.col("piece")))
    kind = F.when(F.col("page").isNotNull(), "PAGE_REF").when(F.col("t") > 0, "TITLE").when((F.col("n") > 0) & cleaned.rlike(NOTE_START), "APPARATUS_NOTE").otherwise("BODY")
    seq = F.row_number().over(Window.partitionBy(order).orderBy("p", "t", "n")) - 1
    out = parts.withColumn("part", seq).select(order, "part", kind.alias("kind"), cleaned.alias("text"), "volume", "page")
    return out.filter((F.col("text") != "") | (F.col("kind") == "PAGE_REF"))


def header_metadata(lines: DataFrame, text: str = "line") -> DataFrame:
    """``(key, value)`` of header lines; null where there is no usable value."""
    own = lines.filter(F.col(text).startswith("#META#"))
    pair = F.regexp_extract(text, r"^#META#\s*(.*?)\s*::", 1)
    value = F.regexp_extract(text, r"::\s*(.*)$", 1)
    return own.select(F.when(pair != "", pair).otherwise("notes").alias("key"), X.usable(F.when(pair != "", value).otherwise(F.trim(F.regexp_replace(text, "^#META#", "")))).alias("value"))


def prefixed(c: Column) -> Column:
    """Lines that start with no known mark become paragraph lines."""
    return F.when(X.known_line(c), c).otherwise(F.concat(F.lit("# "), F.regexp_replace(c, f"^{X.WS}+|{X.WS}+\\z", "")))


#: Where a public-domain edition's own text begins and ends, and how its footnotes do (fixed values).
BODY_START, BODY_END = (rf"(?iU)^\*{{3}}\s*{word} OF (?:THE )?PROJECT GUTENBERG" for word in ("START", "END"))
FOOTNOTE = r"(?iU)^\[\s*footnote\s+\d+\s*:"


def structures(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "en") -> DataFrame:
    """Numbered paragraphs under headings: ``(key, structure, structure_id, sequence, paragraph_id, heading, text, flags)``.

    Paragraphs outside of the edition's body, and footnotes, are flagged and never headings. A text of headings alone is
    one structure of unflagged paragraphs. Numbers begin with 0.
    """
    parts = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), f"\n{X.WS}*\n")).alias("at", "raw"))
    parts = parts.withColumn("text", X.collapse(F.col("raw"))).filter("text <> ''")
    by, whole = Window.partitionBy(key).orderBy("at"), Window.partitionBy(key)
    edge = lambda agg, pattern: agg(F.when(F.col("text").rlike(pattern), F.col("at"))).over(whole)
    parts = parts.withColumns({"lo": edge(F.min, BODY_START), "hi": edge(F.max, BODY_END)})
    outside = F.coalesce(F.col("at") <= F.col("lo"), F.lit(False)) | F.coalesce(F.col("at") >= F.col("hi"), F.lit(False))
    mark = F.when(outside, "gutenberg_boilerplate").when(F.col("text").rlike(FOOTNOTE), "footnote")
    parts = parts.withColumn("mark", mark).withColumn("is_heading", X.looks_like_heading(F.col("text")) & F.col("mark").isNull())
    heads = {"run": F.sum(F.col("is_heading").cast("int")).over(by), "heading": F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(by), "only": F.bool_and("is_heading").over(whole)}
    body = parts.withColumns(heads).filter(~F.col("is_heading") | F.col("only")).withColumn("run", F.when(F.col("only"), 0).otherwise(F.col("run")))
    body = body.withColumn("structure", F.dense_rank().over(Window.partitionBy(key).orderBy("run")) - 1)
    body = body.withColumn("sequence", F.row_number().over(Window.partitionBy(key, "structure").orderBy("at")) - 1)
    sid = F.format_string(f"{lang}:u%04d", F.col("structure"))
    flags = F.when(F.col("mark").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("exclude_from_alignment"), "mark"))
    return body.select(key, "structure", sid.alias("structure_id"), "sequence", F.concat(sid, F.format_string(":p%04d", "sequence")).alias("paragraph_id"), F.when(F.col("only"), "").otherwise(F.coalesce("heading", F.lit(""))).alias("heading"), "text", flags.alias("flags"))


def catalogue_row(catalogue: DataFrame, wanted: str) -> DataFrame:
    """The best catalogue row of a book, version or id: primary first, then by URL."""
    hit = catalogue.filter((F.col("book") == wanted) | (F.col("version") == wanted) | (F.col("id") == wanted))
    return hit.orderBy((F.col("status") != "pri").cast("int"), "url").limit(1)


RAW_HOST = "raw.githubusercontent.com"


def source_url(url: Column, owner: str = "openiti") -> Column:
    """The raw form of an accepted source URL, null for any other: https, a known host and owner, no user, port 443 if any.

    Host and owner are compared in lower case; a query or fragment goes.
    """
    parts = r"^(?i:https)://(?::?@)?([^/?#@:]*)(?::(?:0*443)?)?(?=[/?#]|\z)([^?#]*)"
    host, path = F.lower(F.regexp_extract(F.trim(url), parts, 1)), F.regexp_extract(F.trim(url), parts, 2)
    names = F.filter(F.split(path, "/"), lambda p: p != "")
    page = (F.size(names) >= 5) & (F.lower(names[0]) == owner) & (names[2] == "blob")
    raw = F.concat(F.lit("/"), F.array_join(F.concat(F.slice(names, 1, 2), F.slice(names, 4, 1 << 20)), "/"))
    own = F.when((host == "github.com") & page, raw).when((host == RAW_HOST) & F.lower(path).startswith(f"/{owner}/"), path)
    return F.concat(F.lit(f"https://{RAW_HOST}"), own)
