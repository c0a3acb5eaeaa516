"""Page-level operators: damage reports, page measures, classification, routing, layout decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.functions import text as X

#: Line ends of plain text.
LINE_ENDS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
MIN_WORDS, IMAGE_HEAVY, ARABIC_SHARE = 10, 0.55, 0.1
#: Extraction settings of each page type (fixed values): OCR, engine, note, fallback.
BACKENDS = [
    ("text_english", False, "pymupdf", "kraken", "High: native text extraction is fastest and cleanest.", "tesseract"),
    ("text_arabic_english", False, "pymupdf", "kraken", "High: native text preserves mixed-language structure.", "tesseract"),
    ("qcf_quran", False, "pymupdf", "kraken", "Critical: native text preserves QCF glyphs for decoding.", None),
    ("table_layout", False, "pymupdf", "kraken", "High: native layout is usually preferable for tables.", "tesseract"),
    ("scanned_arabic", True, "tesseract", "kraken", "Medium: scanned Arabic needs OCR.", "nested"),
    ("scanned_english", True, "tesseract", "kraken", "Medium: scanned English needs OCR.", None),
    ("image_heavy", True, "tesseract", "kraken", "Low: image-heavy pages usually need OCR or human review.", "nested"),
]


def mojibake_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Count, share and length of damage marks in each text; one scan, no shuffle."""
    c = F.coalesce(F.col(text), F.lit(""))
    n, bad = F.length(c), F.length(c) - F.length(F.translate(c, X.MOJIBAKE, ""))
    return docs.select(key, (bad > 0).alias("has_mojibake"), bad.cast("long").alias("mojibake_count"), (bad / F.greatest(n, F.lit(1))).alias("mojibake_rate"), n.cast("long").alias("total_chars"))


def char_counts(docs: DataFrame, chars: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, ch, n)`` of those characters that a text has, without exploding it."""
    each = F.array(*[F.struct(F.lit(ch).alias("ch"), (F.length(text) - F.length(F.translate(text, ch, ""))).cast("long").alias("n")) for ch in chars])
    return docs.select(key, F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("c")).select(key, "c.ch", "c.n")


def samples(docs: DataFrame, most: int = 5, around: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The first places of damage with the characters around them."""
    # the space keeps a match at the start of the text, which a split would pass over
    parts = F.split(F.concat(F.lit(" "), F.col(text)), f"(?=[{X.MOJIBAKE}])", most + 1)
    starts = F.aggregate(F.slice(F.transform(parts, lambda p: F.length(p)), 1, most), F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-1)) + n)))
    hits = docs.filter(F.col(text).rlike(f"[{X.MOJIBAKE}]")).select(key, F.col(text).alias("t"), F.posexplode(F.filter(starts, lambda at: F.substring(F.col(text), at + 1, 1).rlike(f"[{X.MOJIBAKE}]"))).alias("sample", "at"))
    low = F.greatest(F.lit(0), F.col("at") - around)
    return hits.select(key, F.col("sample").cast("long"), F.concat(F.substring("t", low + 1, F.col("at") - low), F.lit("['"), F.substring("t", F.col("at") + 1, 1), F.lit("']"), F.substring("t", F.col("at") + 2, F.lit(around))).alias("context")).filter("sample < 5")


def page_measures(words: DataFrame, keys: list[str]) -> DataFrame:
    """Counts over the words of each page, partially aggregated before the shuffle."""
    t = F.col("text")
    mojibake = F.length(t) - F.length(F.translate(t, X.MOJIBAKE, ""))
    return words.groupBy(*keys).agg(
        F.count("*").alias("word_count"),
        F.count_if(t.rlike(r"[\x{0600}-\x{06FF}]")).alias("arabic_word_count"),
        F.count_if(t.rlike("[A-Za-z]{2,}")).alias("english_word_count"),
        F.count_if(t.rlike(f"[{X.PUA}]")).alias("pua_count"),
        F.sum(mojibake).cast("long").alias("mojibake_count"),
        F.sum(F.length(t)).cast("long").alias("char_count"),
    )


def words_with(c: Column, pattern: str) -> Column:
    """Number of words of a collapsed text in which a pattern occurs.

    The rest of a word is passed over without backtracking, so the time is in proportion to the text at any length of words.
    """
    return X.count(c, f"{pattern}[^ ]*+").cast("long")


def word_counts(c: Column) -> tuple[Column, Column]:
    """Words of a collapsed text and the characters in them."""
    chars = F.length(F.replace(c, F.lit(" "), F.lit("")))
    return (F.length(c) - chars + (c != "").cast("int")).cast("long"), chars.cast("long")


def text_measures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The measures of ``page_measures`` for whole texts, in the row: no explode and no shuffle.

    White space is sought once; all else works on the words with a space between.
    """
    c = F.col("c")
    n_words, n_chars = word_counts(c)
    return docs.select(key, X.collapse(F.coalesce(F.col(text), F.lit(""))).alias("c")).select(
        key,
        n_words.alias("word_count"),
        words_with(c, r"[\x{0600}-\x{06FF}]").alias("arabic_word_count"),
        words_with(c, "[A-Za-z]{2}").alias("english_word_count"),
        words_with(c, f"[{X.PUA}]").alias("pua_count"),
        (F.length(c) - F.length(F.translate(c, X.MOJIBAKE, ""))).cast("long").alias("mojibake_count"),
        n_chars.alias("char_count"),
    )


def token_summary(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Words, lines with words, characters in words and the last block of ``tokens``, in the row; texts without words have no row."""
    c = F.coalesce(F.col(text), F.lit(""))
    filled = F.transform(F.split(c, LINE_ENDS), lambda line, at: F.when(line.rlike(X.NOT_WS), at))
    blocks = F.filter(filled, lambda at: at.isNotNull())
    # texts without words are told by their first visible character; white space is sought once in the others
    row = docs.filter(c.rlike(X.NOT_WS)).select(key, X.collapse(c).alias("w"), blocks.alias("b"))
    n_words, n_chars = word_counts(F.col("w"))
    return row.select(key, n_words.alias("n_words"), F.size("b").cast("long").alias("n_lines"), n_chars.alias("n_chars"), (F.lit(1_000_000) + F.element_at("b", -1)).cast("long").alias("last_block"))


def document_mojibake(words: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The damage report of the words of each document or page, joined by spaces in order.

    No measure depends on the order, and no mark is a space: counts are added up before the shuffle, and no text is moved.
    """
    t = F.col("text")
    bad, n = F.coalesce("bad", F.lit(0)), F.coalesce("chars", F.lit(0)) + F.greatest(F.col("words") - 1, F.lit(0))
    own = words.groupBy(*keys).agg(F.sum(F.length(t) - F.length(F.translate(t, X.MOJIBAKE, ""))).alias("bad"), F.sum(F.length(t)).alias("chars"), F.count(t).alias("words"))
    return own.select(*keys, (bad > 0).alias("has_mojibake"), bad.cast("long").alias("mojibake_count"), (bad / F.greatest(n, F.lit(1))).alias("mojibake_rate"), n.cast("long").alias("total_chars"))


def private_characters(c: Column) -> Column:
    """A map of each private-use character of a text to its number."""
    own = F.regexp_extract_all(c, F.lit(f"([{X.PUA}])"), F.lit(1))
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(own)), lambda ch: F.struct(ch.alias("key"), F.size(F.filter(own, lambda x: x == ch)).alias("value"))))


def health(c: Column) -> Column:
    """``struct(has_mojibake, ftfy_changed, has_double_honorifics, pua_characters, suggested_text)``; no repair library is here, so the text is the suggestion."""
    return F.struct(X.has_mojibake(c).alias("has_mojibake"), F.lit(False).alias("ftfy_changed"), X.has_double_honorifics(c).alias("has_double_honorifics"), private_characters(c).alias("pua_characters"), c.alias("suggested_text"))


def observed(words: DataFrame, keys: list[str]) -> DataFrame:
    """A page's observations from its extracted words: counts, Arabic share and damage."""
    m = page_measures(words.withColumn("text", F.coalesce("text", F.lit(""))), keys)
    share = F.col("arabic_word_count") / F.greatest("word_count", F.lit(1))
    return m.select(*keys, "word_count", (F.col("word_count") > 0).alias("has_text_layer"), share.alias("arabic_ratio"), "mojibake_count", (F.col("mojibake_count") / F.greatest("char_count", F.lit(1))).alias("mojibake_rate"))


def span_rows(pages: DataFrame, payload: str = "payload", key: str = "page") -> DataFrame:
    """``(key, span_no, x0, y0, x1, y1, font, text, size)`` of the text blocks in a page's JSON layout, in order."""
    kind = "struct<blocks:array<struct<type:int,lines:array<struct<spans:array<struct<text:string,font:string,size:double,bbox:array<double>>>>>>>>"
    blocks = F.filter(F.from_json(payload, kind)["blocks"], lambda b: b["type"] == 0)
    spans = F.flatten(F.transform(blocks, lambda b: F.flatten(F.transform(b["lines"], lambda line: line["spans"]))))
    rows = pages.select(key, F.posexplode(spans).alias("span_no", "s"))
    return rows.select(key, "span_no", *[F.coalesce(F.get("s.bbox", k), F.lit(0.0)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))], F.coalesce("s.font", F.lit("")).alias("font"), F.coalesce("s.text", F.lit("")).alias("text"), "s.size")


def glyph_regions(spans: DataFrame) -> DataFrame:
    """Spans that hold glyphs in a glyph font, with the glyph page that the font names."""
    own = X.has_glyph(F.col("text")) & F.upper("font").rlike("QCF|KFGQPC")
    return spans.filter(own).withColumn("mushaf_page", X.glyph_page(F.col("font")))


def page_type(words: Column, arabic: Column, english: Column, pua: Column, fonts: Column, image: Column, present: Column) -> Column:
    """The kind of a page from its measures."""
    sparse = F.when(image >= IMAGE_HEAVY, "image_heavy").when(arabic > english, "scanned_arabic").otherwise("scanned_english")
    rich = F.when(arabic / words >= ARABIC_SHARE, "text_arabic_english").otherwise("text_english")
    return F.when(~present, "scanned_english").when(fonts | (pua > 0), "qcf_quran").when(words < MIN_WORDS, sparse).otherwise(rich)


def observed_type(words: Column, arabic_ratio: Column, qcf: Column) -> Column:
    """The kind of a page as the router sees it."""
    return F.when(qcf, "qcf_quran").when(words == 0, "scanned").when(words < MIN_WORDS, "sparse").when(arabic_ratio > ARABIC_SHARE, "text_arabic_english").otherwise("text_english")


def backends(spark) -> DataFrame:
    return spark.createDataFrame(BACKENDS, "page_type string, force_ocr boolean, ocr_backend string, arabic_engine string, note string, fallback string")


def with_backend(pages: DataFrame) -> DataFrame:
    """Extraction settings joined to ``page_type``; the dimension has seven rows."""
    return pages.join(F.broadcast(backends(pages.sparkSession)), "page_type", "left")


def route(o: dict[str, Column], visual: bool = False, roles: bool = False, fidelity: bool = False) -> Column:
    """``struct(action, reasons, confidence)`` by the first rule that holds; ``mojibake_percent`` is for rates known more exactly as a quotient."""
    say = lambda *parts: F.array(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    rule = lambda action, reasons, sure: F.struct(F.lit(action).alias("action"), reasons.alias("reasons"), F.lit(sure).alias("confidence"))
    words = o["word_count"].cast("string")
    kept = F.filter(
        F.array(
            F.lit("local processing sufficient for requested task"),
            F.when(o["qcf"], F.lit("QCF/local decoders handle Quran text and honorifics locally")),
            F.when(o["word_count"] > 50, F.concat(F.lit("clean native extraction available ("), words, F.lit(" words)"))),
        ),
        lambda r: r.isNotNull(),
    )
    out = F.when(o["word_count"] == 0, rule("enrich_vision", say("no native text layer (word_count=", words, ")"), 0.95))
    if visual:
        out = out.when(o["table"], rule("enrich_vision", say("table detected and visual descriptions requested"), 0.90))
        out = out.when(o["images"] > 0, rule("enrich_vision", say(o["images"].cast("string"), " image(s) detected and visual descriptions requested"), 0.85))
    thin = (o["text_coverage"] < 0.05) & (o["image_ratio"] > 0.5) & (o["word_count"] < 30)
    # format_number rounds the exact value, halves to even, as SQL and Python do; Java's format strings round halves up
    measures = F.format_string("low text coverage (%s%%) + high image area (%s%%) + low word_count (%d)", F.format_number(o["text_coverage"] * 100, 1), F.format_number(o["image_ratio"] * 100, 0), o["word_count"])
    out = out.when(thin, rule("enrich_vision", F.array(measures), 0.80))
    percent = o.get("mojibake_percent", o["mojibake_rate"] * 100)
    damage = F.format_string("extraction corruption detected (mojibake_count=%d, mojibake_rate=%s%%)", o["mojibake_count"], F.format_number(percent, 2))
    out = out.when((o["mojibake_count"] >= 3) | (o["mojibake_rate"] > 0.005), rule("enrich_text", F.array(damage), 0.80))
    if roles:
        out = out.when(~o["qcf"], rule("enrich_text", say("semantic roles requested and page is not QCF-structured"), 0.70))
    if fidelity:
        return out.otherwise(rule("enrich_text", say("high-fidelity mode requested"), 0.65))
    return out.otherwise(rule("skip", kept, 0.85))


def tokens(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Words of plain texts: ``(key, page, block_no, line_no, word_no, text)``; a text is page 1."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), LINE_ENDS)).alias("line_no", "line"))
    words = lines.select(key, "line_no", F.posexplode(X.words(F.col("line"))).alias("word_no", "text"))
    return words.select(key, F.lit(1).alias("page"), (F.lit(1_000_000) + F.col("line_no")).cast("long").alias("block_no"), F.lit(0).alias("line_no"), "word_no", "text")


# -- joins by place ------------------------------------------------------------------------------
def fonts_of_words(boxes: DataFrame, spans: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """``boxes`` with the font of the best overlapping repairable span, and the repaired text.

    A range join inside an equi-join on the page; the first span wins a tie.
    """
    spans = spans.filter(X.is_repairable_font(F.col("font"))).select("page", "span_no", "font", *[F.col(c).alias(f"s{c}") for c in ("x0", "y0", "x1", "y1")])
    mid = (F.col("y0") + F.col("y1")) / 2
    near = mid.between(F.col("sy0") - tolerance, F.col("sy1") + tolerance) & (F.col("x1") >= F.col("sx0") - tolerance) & (F.col("x0") <= F.col("sx1") + tolerance)
    overlap = F.least("x1", "sx1") - F.greatest("x0", "sx0")
    met = boxes.join(spans, "page").filter(near).withColumn("overlap", overlap).filter("overlap > -1")
    best = met.groupBy("page", "word_no").agg(F.max_by("font", F.struct("overlap", -F.col("span_no"))).alias("font"))
    return boxes.join(best, ["page", "word_no"], "left").withColumn("repaired", F.when(F.col("font").isNotNull(), X.repair(F.col("text"))).otherwise(F.col("text")))


def first_glyph_font(spans: DataFrame) -> DataFrame:
    """``(page, font, glyph_page)`` of the first glyph font on each page."""
    own = spans.filter(F.col("font").startswith("QCF_") | F.col("font").startswith("KFGQPC"))
    return own.groupBy("page").agg(F.min_by("font", "span_no").alias("font")).withColumn("glyph_page", X.glyph_page(F.col("font")))


def decode_glyphs(texts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """``(id, decoded)``: glyphs as words by an equi-join on (page, glyph); unknown ones stay."""
    chars = texts.select("id", "page", F.posexplode(F.filter(F.split("text", ""), lambda ch: ~ch.rlike(f"^{X.WS}?\\z"))).alias("at", "glyph"))
    met = chars.join(glyphs.select("page", "glyph", "arabic"), ["page", "glyph"], "left")
    joined = met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("arabic", "glyph").alias("w")))), lambda x: x["w"]), " ").alias("decoded"))
    return texts.select("id").join(joined, "id", "left").select("id", F.coalesce("decoded", F.lit("")).alias("decoded"))


def glyph_totals(glyphs: DataFrame, verses: DataFrame) -> DataFrame:
    """Pages, glyphs and verses of a glyph map."""
    return glyphs.agg(F.countDistinct("page").alias("pages"), F.count("*").alias("glyphs")).crossJoin(verses.agg(F.count("*").alias("verses")))


def plain(c: Column) -> Column:
    """Arabic without marks, spaces and tatweel, letters folded."""
    return F.regexp_replace(X.normalize_arabic(F.regexp_replace(c, r"\p{Mn}", "")), X.WS, "")


PIECE = 3


def pieces(c: Column) -> Column:
    """All runs of up to ``PIECE`` characters of a text, each once."""

    def runs(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substring(c, i, k))

    return F.array_distinct(F.concat(F.array(F.lit("")), *map(runs, range(1, PIECE + 1))))


def verse_of(texts: DataFrame, verses: DataFrame) -> DataFrame:
    """The first verse that contains a text or that it contains; null if none does.

    What contains a string contains its first ``PIECE`` characters, so both directions are equi-joins on pieces.
    """
    v = verses.select("ord", "verse_key", plain(F.col("arabic")).alias("v"))
    t = texts.select("id", plain(F.col("text")).alias("t"))
    lead = lambda c: F.substring(c, 1, PIECE)
    holds = t.select("id", "t", F.explode(pieces(F.col("t"))).alias("p")).join(v.withColumn("p", lead(F.col("v"))), "p").filter(F.col("t").contains(F.col("v")))
    held = t.withColumn("p", lead(F.col("t"))).join(v.select("ord", "verse_key", "v", F.explode(pieces(F.col("v"))).alias("p")), "p").filter(F.col("v").contains(F.col("t")))
    met = holds.select("id", "ord", "verse_key").unionByName(held.select("id", "ord", "verse_key"))
    best = met.groupBy("id").agg(F.min_by("verse_key", "ord").alias("verse_key"))
    return texts.select("id").join(best, "id", "left")
