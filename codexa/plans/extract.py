"""From positioned words to Markdown: repair, glyph decoding, honorifics, classification, blocks, roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.functions import text as X
from codexa.operators import layout, pages, words


def repaired_words(boxes: DataFrame, spans: DataFrame) -> DataFrame:
    """Words with font repair and restored ligatures: ``boxes`` and ``fixed``."""
    return pages.fonts_of_words(boxes, spans).withColumn("fixed", X.expand_ligatures(F.col("repaired")))


def page_types(boxes: DataFrame, spans: DataFrame) -> DataFrame:
    """``(page, page_type, force_ocr, ...)`` from the words and fonts of each page."""
    m = pages.page_measures(boxes, ["page"])
    fonts = pages.first_glyph_font(spans).select("page", F.lit(True).alias("glyph_font"))
    kind = pages.page_type(*[F.col(c) for c in ("word_count", "arabic_word_count", "english_word_count", "pua_count")], F.coalesce("glyph_font", F.lit(False)), F.lit(0.0), F.lit(True))
    return pages.with_backend(m.join(fonts, "page", "left").withColumn("page_type", kind))


def native_words(boxes: DataFrame, spans: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Display and spoken text, language and role of every native word; blank ones go."""
    fixed = repaired_words(boxes, spans).select("page", "word_no", "x0", "y0", "x1", "y1", "fixed")
    kinds = page_types(boxes, spans).select("page", "page_type")
    fonts = pages.first_glyph_font(spans).select("page", "glyph_page")
    rows = fixed.join(kinds, "page").join(fonts, "page", "left").withColumn("id", F.struct("page", "word_no"))
    coded = rows.filter(X.has_glyph(F.col("fixed")) & F.col("glyph_page").isNotNull()).select("id", F.col("glyph_page").alias("page"), F.col("fixed").alias("text"))
    decoded = pages.decode_glyphs(coded, glyphs)
    rows = rows.join(decoded, "id", "left").withColumn("plain", F.coalesce("decoded", "fixed"))
    shown = X.show_honorifics(F.col("plain"))
    rows = rows.withColumns({"text": shown, "spoken_text": X.decode_honorifics(shown)["cleaned"]})
    role = F.when(F.col("page_type") == "qcf_quran", "quran").otherwise("body")
    return rows.filter(X.keeps_token(F.col("text"))).select("page", "word_no", "text", F.when(F.col("spoken_text") != "", F.col("spoken_text")).alias("spoken_text"), X.language(F.col("text")).alias("language"), role.alias("role"), "x0", "y0", "x1", "y1")


def extract(boxes: DataFrame, spans: DataFrame, glyphs: DataFrame, doc_id: int = 0) -> dict[str, DataFrame]:
    """Words, blocks, Markdown and statistics of one document's pages."""
    native = native_words(boxes, spans, glyphs)
    null = lambda kind: F.lit(None).cast(kind)
    rows = native.select(
        F.lit(doc_id).cast("long").alias("doc_id"), "page", (F.col("page") * 1_000_000).cast("long").alias("block_no"), F.lit(0).alias("line_no"), "word_no", F.col("word_no").cast("long").alias("ord"), "text", "spoken_text", "role",
        null("string").alias("section_type"), null("string").alias("verse_key"), null("string").alias("hadith_ref"), F.col("y0").alias("y"), (F.col("y1") - F.col("y0")).alias("height"), F.lit(False).alias("is_word_continuation"),
    )
    found = layout.blocks(rows)
    per_page = page_types(boxes, spans).select(F.lit(doc_id).cast("long").alias("doc_id"), "page", "page_type", F.col("word_count").alias("words"), (~F.col("force_ocr")).alias("supported"))
    return {"words": rows, "blocks": found, "markdown": layout.markdown(found), "stats": words.extraction_stats(per_page)}
