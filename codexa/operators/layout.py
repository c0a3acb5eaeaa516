"""From words to blocks to Markdown: segmentation by windows, grouped assembly, ordered roll-up.

Everything is keyed by document, so documents spread over tasks; no window spans documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.functions import markup
from codexa.functions import text as X
from codexa.operators import pages, words

GAP_RATIO, DEFAULT_HEIGHT, BUILDER = 1.5, 20.0, "codexa-1"
ORDER = ["block_no", "line_no", "word_no", "ord"]


def page_identity() -> Column:
    return F.coalesce("page", F.when(F.col("block_no") >= 1_000_000, F.floor(F.col("block_no") / 1_000_000)).cast("int"))


def segmented(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """``words`` with ``grp``, the number of the block that a word belongs to."""
    by = Window.partitionBy(key).orderBy(*ORDER)
    whole = Window.partitionBy(key)
    words = words.withColumn("page_id", page_identity())
    gap = F.coalesce(F.avg(F.when(F.col("height") > 0, F.col("height"))).over(whole), F.lit(DEFAULT_HEIGHT)) * GAP_RATIO
    was = lambda c: F.lag(c).over(by)
    changed = lambda c: ~F.col(c).eqNullSafe(was(c))
    other = lambda c: (F.coalesce(F.col(c), F.lit("")) != "") & (F.coalesce(was(c), F.lit("")) != "") & (F.col(c) != was(c))
    cut = (
        changed("page_id")
        | changed("role")
        | (F.col("role").eqNullSafe("quran") & other("verse_key"))
        | (F.col("role").eqNullSafe("hadith") & other("hadith_ref"))
        | changed("section_type")
        | F.coalesce((F.col("y") - was("y")) > gap, F.lit(False))
    )
    flagged = words.withColumn("cut", F.when(F.row_number().over(by) == 1, 0).otherwise(cut.cast("int")))
    return flagged.withColumn("grp", F.sum("cut").over(by)).withColumn("pos", F.row_number().over(by)).drop("cut")


def blocks(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each block with text: type, text, page, references, role and reading order."""
    role = F.coalesce("role", F.lit("body"))
    seg = segmented(words, key).withColumn("r", role)
    by_role = seg.groupBy(key, "grp", "r").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    main = by_role.groupBy(key, "grp").agg(F.max_by("r", F.struct("n", -F.col("first"))).alias("dominant_role"))
    one = lambda c: F.when(F.countDistinct(F.when(F.col(c) != "", F.col(c))) == 1, F.max(F.when(F.col(c) != "", F.col(c))))
    said = F.when(~F.coalesce("is_word_continuation", F.lit(False)), F.struct("pos", F.coalesce(F.when(F.col("spoken_text") != "", F.col("spoken_text")), F.col("text")).alias("w")))
    out = seg.groupBy(key, "grp").agg(
        X.collapse(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["w"]), " ")).alias("text"),
        F.min_by("page_id", F.when(F.col("page_id").isNotNull(), F.col("pos"))).alias("page"),
        F.avg("y").alias("mean_y"),
        one("verse_key").alias("verse_key"),
        one("hadith_ref").alias("hadith_ref"),
        F.bool_or((F.coalesce("section_type", F.lit("")) == "header") | (F.col("r") == "heading")).alias("head"),
        (F.count_if(F.col("r").isin("quran", "quran_arabic")) > F.count("*") * 0.5).alias("verse"),
        F.min("pos").alias("first"),
        F.count("*").alias("n_words"),
    )
    out = out.join(main, [key, "grp"]).filter(F.col("text") != "")
    out = out.withColumn("type", F.when(F.col("head"), "heading").when(F.col("verse"), "verse").otherwise("paragraph"))
    place = Window.partitionBy(key).orderBy(F.coalesce("page", F.lit(0)), F.coalesce("mean_y", F.lit(0.0)), "first")
    return out.withColumn("block_seq", F.row_number().over(place)).select(key, "block_seq", "type", "text", F.coalesce("page", F.lit(0)).alias("page"), "mean_y", "verse_key", "hadith_ref", "dominant_role", "n_words")


def rendered(c: dict[str, Column]) -> tuple[Column, Column]:
    """Markdown and plain form of a block; null for blank text."""
    t, key, ref, role = F.trim(c["text"]), c["verse_key"], c["hadith_ref"], F.coalesce(c["dominant_role"], F.lit("body"))
    has_key, has_ref = F.coalesce(key, F.lit("")) != "", F.coalesce(ref, F.lit("")) != ""
    verse_md = F.concat(F.lit("> "), t, F.when(has_key, F.concat(F.lit(" **["), key, F.lit("]**"))).otherwise(""))
    verse = F.concat(t, F.when(has_key, F.concat(F.lit(" ["), key, F.lit("]"))).otherwise(""))
    hadith_md = F.concat(F.lit("> "), t, F.when(has_ref, F.concat(F.lit(" *("), ref, F.lit(")*"))).otherwise(""))
    hadith = F.concat(t, F.when(has_ref, F.concat(F.lit(" ("), ref, F.lit(")"))).otherwise(""))
    kind = c["type"]
    quran, told = (kind == "verse") | role.isin("quran", "quran_arabic"), role.isin("hadith", "hadith_arabic")
    label = lambda name, mark="": F.concat(F.lit(f"{mark}{name}:{mark} "), t)
    md = (
        F.when(kind == "heading", F.concat(F.lit("## "), t))
        .when(kind == "verse", verse_md)
        .when(kind == "basmala", F.concat(F.lit("> "), t))
        .when(kind == "footnote", F.concat(F.lit("---\n"), t))
        .when(kind == "isnad", label("Isnad", "**"))
        .when(kind == "matn", label("Matn", "**"))
        .when(quran, verse_md)
        .when(told, hadith_md)
        .otherwise(t)
    )
    flat = F.when(kind.isin("heading", "basmala", "footnote"), t).when(kind == "isnad", label("Isnad")).when(kind == "matn", label("Matn")).when(quran, verse).when(told, hadith).otherwise(t)
    return F.when(t != "", md), F.when(t != "", flat)


def rendered_figure(kind: Column, label: Column, caption: Column, description: Column) -> tuple[Column, Column]:
    """Markdown and plain form of a figure."""
    label, caption = F.coalesce(label, F.lit("None")), F.coalesce(caption, F.lit(""))
    more = F.when((description != "") & (description != caption), F.concat(F.lit("\nDescription: "), description, F.lit("\n"))).otherwise("")
    md = F.concat(F.lit("<!-- figure:start type="), kind, F.lit(' label="'), label, F.lit('" -->\n**'), label, F.lit(" ("), kind, F.lit("):** "), caption, F.lit("\n"), more, F.lit("<!-- figure:end -->"))
    shown = F.when(description != "", description).when(caption != "", caption).otherwise(label)
    return md, F.concat(F.lit("[Figure: "), shown, F.lit("]"))


def markdown(block_rows: DataFrame, key: str = "doc_id", title: Column | None = None) -> DataFrame:
    """``(key, markdown, plain_text, n_blocks)``, blocks in order, blank lines between."""
    md, flat = rendered({c: F.col(c) for c in ("type", "text", "verse_key", "hadith_ref", "dominant_role")})
    rows = block_rows.withColumns({"md": md, "flat": flat}).filter(F.col("md").isNotNull())
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_seq", F.col(c).alias("v")))), lambda x: x["v"]), "\n\n")
    return rows.groupBy(key).agg(ordered("md").alias("markdown"), ordered("flat").alias("plain_text"), F.count("*").alias("n_blocks"))


def words_checksum(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """First 16 hex digits of the hash of a document's words in order."""
    line = F.concat_ws("|", F.coalesce("spoken_text", "text"), F.coalesce("role", F.lit("")), F.coalesce("verse_key", F.lit("")), F.col("block_no").cast("string"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(key).agg(F.substring(F.sha2(lines, 256), 1, 16).alias("checksum"))


def cache_key(words: Column, figures: Column) -> Column:
    """First 16 hex digits of the hash of two checksums and the builder's version; no figures: an empty checksum."""
    return F.substring(F.sha2(F.concat_ws("+", words, F.lit(BUILDER), F.coalesce(figures, F.lit(""))), 256), 1, 16)


def from_markdown(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Blocks of Markdown texts: headings, quotes and paragraphs; fenced code is left out and ends no paragraph."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), pages.LINE_ENDS)).alias("line_no", "line"))
    by = Window.partitionBy(key).orderBy("line_no")
    line = F.regexp_replace("line", f"^{X.WS}+|{X.WS}+\\z", "")
    fence = line.startswith("```")
    lines = lines.withColumn("line", line).withColumn("fence", fence)
    lines = lines.withColumn("fenced", F.col("fence") | (F.sum(F.col("fence").cast("int")).over(by) % 2 == 1)).filter("not fenced")
    line = F.col("line")
    lines = lines.withColumn("kind", F.when(line == "", "none").when(line.startswith("#"), "heading").when(line.startswith(">"), "quote").otherwise("text"))
    cut = (F.col("kind") != F.lag("kind", 1, "none").over(by)) | F.col("kind").isin("heading", "quote")
    lines = lines.withColumn("grp", F.sum(cut.cast("int")).over(by)).filter("kind <> 'none'")
    lines = lines.withColumn("line", F.when(F.col("kind") == "heading", F.regexp_replace(line, f"^#+{X.WS}*", "")).when(F.col("kind") == "quote", F.regexp_replace(line, f"^>{X.WS}*", "")).otherwise(line))
    # a paragraph is stripped as a whole: its marks may span lines
    whole = lines.groupBy(key, "grp").agg(F.first("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("raw"))
    # Python gets only texts with code or links, null for all others; without those, emphasis marks simply go
    marked = F.col("raw").rlike(r"[`\[]")
    out = whole.withColumn("text", F.when(marked, markup.strip_markdown(F.when(marked, F.col("raw")))).otherwise(X.collapse(F.regexp_replace("raw", "[*_~]+", ""))))
    kind = F.when(F.col("kind") == "heading", "heading").when((F.col("kind") == "quote") & X.is_arabic(F.col("text")), "verse").otherwise("paragraph")
    seq = F.row_number().over(Window.partitionBy(key).orderBy("grp"))
    return out.filter("text <> ''").withColumn("type", kind).withColumn("block_seq", seq).select(key, "block_seq", "type", "text")


def with_figures(block_rows: DataFrame, figures: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks and figures in order of page and place: ``block_rows`` as from ``blocks``; figures have (key, fig, page, y, kind, label, caption, description).

    A figure's text is its caption and description; at equal places blocks come first.
    """
    both = F.concat(F.col("caption"), F.lit(". "), F.coalesce("description", F.lit("")))
    told = F.when(F.coalesce("caption", F.lit("")) != "", F.regexp_replace(both, r"^[. ]+|[. ]+\z", "")).otherwise(F.coalesce("description", F.lit("")))
    null = lambda c: F.lit(None).cast("string").alias(c)
    own = block_rows.select(key, "page", F.coalesce("mean_y", F.lit(0.0)).alias("y"), F.lit(0).alias("figure"), F.col("block_seq").alias("at"), "type", "text", "verse_key", "hadith_ref", "dominant_role", null("figure_type"), null("label"), null("caption"))
    more = figures.select(key, F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("y", F.lit(0.0)).alias("y"), F.lit(1).alias("figure"), F.col("fig").alias("at"), F.lit("figure").alias("type"), told.alias("text"), null("verse_key"), null("hadith_ref"), null("dominant_role"), F.col("kind").alias("figure_type"), "label", "caption")
    place = Window.partitionBy(key).orderBy("page", "y", "figure", "at")
    return own.unionByName(more).withColumn("block_seq", F.row_number().over(place)).drop("y", "figure", "at")


def document_rows(block_rows: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, language, word_count, block_count, figure_count)`` of documents with their blocks."""
    counts = words.groupBy(key).agg(F.count("*").alias("word_count"))
    letters, arabic = X.count(F.col("text"), r"\p{IsAlphabetic}"), X.count(F.col("text"), f"[{X.AR}]")
    own = block_rows.groupBy(key).agg(F.count("*").alias("block_count"), F.count_if(F.col("type") == "figure").alias("figure_count"), F.sum(arabic).alias("arabic"), F.sum(letters).alias("letters"))
    share = F.coalesce("arabic", F.lit(0)) / F.greatest(F.coalesce("letters", F.lit(0)), F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return counts.join(own, key, "full_outer").select(key, F.when(share > 0.3, "ar").otherwise("en").alias("language"), zero("word_count"), zero("block_count"), zero("figure_count"))


def structured_blocks(docs: DataFrame, key: str = "id") -> DataFrame:
    """Blocks of (key, tree, markdown, plain): the layout tree if it has typed nodes, else the Markdown, else the plain text as one paragraph."""
    typed = F.coalesce(F.col("tree"), F.lit("")).rlike(r'"block_type"\s*:\s*"[^"]')
    marked = F.regexp_replace(F.coalesce("markdown", F.lit("")), X.WS, "") != ""
    plain = F.regexp_replace(F.coalesce("plain", F.lit("")), f"^{X.WS}+|{X.WS}+\\z", "")
    by_tree = words.tree_blocks(docs.filter(typed).select(key, "tree"), "tree", key)
    by_mark = from_markdown(docs.filter(~typed & marked).select(key, F.col("markdown").alias("text")), "text", key)
    by_text = docs.filter(~typed & ~marked & (plain != "")).select(key, F.lit(1).alias("block_seq"), F.lit("paragraph").alias("type"), plain.alias("text"))
    return by_tree.select(key, (F.col("block_seq") + 1).alias("block_seq"), "type", "text").unionByName(by_mark).unionByName(by_text)
