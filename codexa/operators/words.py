"""Operators on word rows: transliteration lookups, hyphen and honorific joining, box checks, block trees."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.functions import markup
from codexa.functions import text as X


def transliterated(words: DataFrame, dictionary: DataFrame, text: str = "text") -> DataFrame:
    """``words`` with ``arabic``: an exact look-up of the normalised word, then without digits at its edges.

    ``dictionary`` has word and arabic; both look-ups are equi-joins.
    """
    book = dictionary.select(markup.normalize(F.col("word")).alias("k"), F.col("arabic")).filter("k <> ''").dropDuplicates(["k"])
    key = markup.normalize(F.col(text))
    out = words.withColumn("k1", key).withColumn("k2", F.trim(F.regexp_replace("k1", r"^\d+|\d+$", "")))
    first, second = (book.select(F.col("k").alias(k), F.col("arabic").alias(a)) for k, a in (("k1", "a1"), ("k2", "a2")))
    return out.join(first, "k1", "left").join(second, "k2", "left").withColumn("arabic", F.coalesce("a1", "a2")).drop("k1", "k2", "a1", "a2")


def annotated(texts: DataFrame, dictionary: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """Texts in which each parenthesised word that the dictionary knows has its Arabic form added."""
    parts = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"(\([^)]+\)|[^(]+|\()"), F.lit(1))).alias("at", "part"))
    inner = F.regexp_extract("part", r"^\(([^)]+)\)$", 1)
    met = transliterated(parts.withColumn("inner", inner), dictionary, "inner")
    known = F.col("arabic").isNotNull() & (F.col("inner") != "") & ~F.col("inner").contains(F.col("arabic"))
    done = F.when(known, F.concat(F.lit("("), "inner", F.lit(" "), "arabic", F.lit(")"))).otherwise(F.col("part"))
    joined = met.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", done.alias("v")))), lambda x: x["v"]), "").alias("annotated"))
    return texts.select(key).join(joined, key, "left").select(key, F.coalesce("annotated", F.lit("")).alias("annotated"))


JOINED = "line string, ord int, original string, normalized string, honorific string, hyphen_start boolean, hyphen_end boolean"


def joined_words(words: DataFrame) -> DataFrame:
    """Words of each line with leading honorifics moved to the word before and hyphenated halves joined.

    ``words``: (line, ord, text). The steps depend on one another, so a line is one group in Python.
    """
    symbols = {s: a for s, _, a in X.HONORIFICS}

    def run(own: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        held: dict | None = None
        for line, at, text in own.sort_values("ord")[["line", "ord", "text"]].itertuples(index=False):
            lead = text[:1]
            if lead in symbols and out:
                out[-1]["honorific"] = symbols[lead]
                text = text.lstrip("".join(symbols)).strip()
                if not text:
                    continue
            kinds = [symbols[c] for c in text if c in symbols]
            plain = " ".join("".join(" " if c in symbols else c for c in text).split())
            row = dict(line=line, ord=at, original=text, normalized=plain, honorific=kinds[0] if kinds else None, hyphen_start=plain.endswith("-"), hyphen_end=False)
            if held is not None:
                held["normalized"] = held["normalized"][:-1] + plain
                held["hyphen_end"] = True
                held = None
                continue
            out.append(row)
            held = row if row["hyphen_start"] and len(plain) > 1 else None
        return pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in JOINED.split(",")])

    return words.groupBy("line").applyInPandas(run, JOINED)


def batch_reversed(words: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Whether a batch's marked Arabic words look reversed, from the orphan rates of the first 30."""
    marked = words.filter(X.is_arabic(F.col("text")) & F.col("text").rlike(r"[\x{064B}-\x{0658}\x{0670}]")).withColumn("rate", X.orphan_rate(F.col("text")))
    first = marked.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("k <= 30")
    agg = first.groupBy(*keys).agg(F.count("*").alias("n"), F.max("rate").alias("most"), F.avg((F.col("rate") > 0.1).cast("int")).alias("share"), F.avg("rate").alias("mean"))
    verdict = (F.col("n") >= 3) & ((F.col("most") >= 0.4) | (F.col("share") >= 0.3) | (F.col("mean") > 0.15))
    return words.select(*keys).distinct().join(agg.select(*keys, verdict.alias("is_reversed")), keys, "left").fillna(False, ["is_reversed"])


def glyph_faults(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Pages of undecoded glyphs (over a fifth private characters) or of collapsed boxes (over a half)."""
    private, size = X.count(F.col("text"), f"[{X.PUA}]"), F.length("text")
    out = boxes.groupBy(*keys).agg(F.sum(private).alias("pua"), (F.sum(size) + F.count("*") - 1).alias("chars"), F.count_if(F.col("height") <= 0.1).alias("flat"), F.count("*").alias("n"))
    return out.select(*keys, ((F.col("pua") > F.col("chars") * 0.2) | (F.col("flat") > F.col("n") * 0.5)).alias("has_issues"))


def real_boxes(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes without ghosts (private text that is neither an honorific nor a decoded glyph), and the ghosts' number."""
    t = F.col("text")
    ghost = X.is_private(t) & ~X.is_honorific(t) & ~(X.is_glyph(t) & (F.col("arabic").isNotNull() | F.col("verse_key").isNotNull()))
    return boxes.filter(~ghost), boxes.agg(F.count_if(ghost).alias("ghosts"))


#: Leaf types of layout trees (fixed values).
LEAVES = {"SectionHeader": "heading", "Text": "paragraph", "TextInlineMath": "paragraph", "ListItem": "paragraph", "Footnote": "footnote", "Caption": "paragraph", "Equation": "verse", "Code": "paragraph"}


def typed_nodes(tree) -> list[dict]:
    """All nodes of a JSON layout tree that have a type, depth first."""
    if isinstance(tree, list):
        return [n for child in tree for n in typed_nodes(child)]
    if not isinstance(tree, dict):
        return []
    return [tree][: "block_type" in tree] + typed_nodes(tree.get("children") or [])


def node_text(node: dict) -> str:
    return " ".join(str(node.get("text") or markup.plain_html(node.get("html"))).split())


def leaves_of(source: str | None) -> list[dict]:
    """Blocks of a tree: its leaves of known types that have text, else the text of all nodes as one paragraph."""
    try:
        nodes = typed_nodes(json.loads(source or "null"))
    except ValueError:
        return []
    out = [{"type": LEAVES[n["block_type"]], "text": node_text(n)} for n in nodes if n["block_type"] in LEAVES and not n.get("children")]
    rest = " ".join(filter(None, map(node_text, nodes)))
    return [b for b in out if b["text"]] or ([{"type": "paragraph", "text": rest}] if rest else [])


def tree_blocks(docs: DataFrame, tree: str = "tree", key: str = "id") -> DataFrame:
    """``(key, block_seq, type, text)`` of JSON layout trees, read in Arrow batches."""

    @F.pandas_udf("array<struct<type:string,text:string>>")
    def blocks(s: pd.Series) -> pd.Series:
        return s.map(leaves_of)

    return docs.select(key, F.posexplode(blocks(F.col(tree))).alias("block_seq", "b")).select(key, "block_seq", "b.type", "b.text")


def heading_evidence(structures: DataFrame) -> DataFrame:
    """``(work, sequence, mass, marks)``: what the headings of structures of equal number share."""
    side = lambda lang: structures.filter(F.col("lang") == lang).select("work", "sequence", F.col("heading").alias(lang))
    met = side("ar").join(side("en"), ["work", "sequence"]).withColumn("e", markup.evidence(F.col("ar"), F.col("en")))
    marks = F.concat(F.transform("e.names", lambda n: F.concat(F.lit("name:"), n)), F.transform("e.numbers", lambda n: F.concat(F.lit("number:"), n)))
    return met.select("work", "sequence", "e.mass", marks.alias("marks"))


def structural_links(structures: DataFrame, least: int = 4) -> DataFrame:
    """``(work, pair, ar_ids, en_ids, method, confidence, flags, evidence)``: pairs of structures of equal number if their headings confirm the order, else one link a work.

    ``structures``: (work, lang, sequence, id, heading).
    """
    seen = heading_evidence(structures).withColumn("marks", F.when(F.col("mass") >= least, F.col("marks")).otherwise(F.array().cast("array<string>")))
    per = structures.groupBy("work").agg(F.count_if(F.col("lang") == "ar").alias("a"), F.count_if(F.col("lang") == "en").alias("e"))
    strong = seen.groupBy("work").agg(F.count_if(F.size("marks") > 0).alias("strong"))
    gate = per.join(strong, "work", "left").withColumn("paired", (F.col("a") == F.col("e")) & (F.col("a") >= 2) & (F.coalesce("strong", F.lit(0)) >= F.greatest(F.lit(2), F.ceil(F.col("a") / 4))))
    side = lambda lang, name: structures.filter(F.col("lang") == lang).select("work", F.col("sequence").alias("pair"), F.array("id").alias(name))
    pairs = side("ar", "ar_ids").join(side("en", "en_ids"), ["work", "pair"]).join(gate.filter("paired").select("work"), "work").join(seen.select("work", F.col("sequence").alias("pair"), F.col("marks").alias("evidence")), ["work", "pair"])
    every = lambda lang: F.transform(F.array_sort(F.collect_list(F.when(F.col("lang") == lang, F.struct("sequence", "id")))), lambda x: x["id"])
    whole = structures.join(gate.filter("not paired").select("work"), "work").groupBy("work").agg(every("ar").alias("ar_ids"), every("en").alias("en_ids"))
    none, doubts = F.array().cast("array<string>"), F.array(F.lit("unanchored_structure"), F.lit("review_required"))
    row = lambda df, pair, method, sure, flags, evidence: df.select("work", pair.cast("int").alias("pair"), "ar_ids", "en_ids", F.lit(method).alias("method"), F.lit(sure).alias("confidence"), flags.alias("flags"), evidence.alias("evidence"))
    return row(pairs, F.col("pair"), "bilateral_structure_sequence", 0.92, none, F.col("evidence")).unionByName(row(whole, F.lit(0), "whole_book_unanchored", 0.2, doubts, none))


def extraction_stats(pages: DataFrame) -> DataFrame:
    """Totals of a document's pages: (doc_id, page, page_type, words, supported)."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"),
        F.array_sort(F.collect_list(F.when(~F.col("supported"), F.col("page")))).alias("unsupported_pages"),
        F.array_sort(F.collect_list(F.when(F.col("page_type").isin("scanned_arabic", "scanned_english", "image_heavy"), F.col("page")))).alias("ocr_pages"),
        F.sum("words").alias("word_count"),
    )


def repaired_pages(words: DataFrame, fixed: str = "repaired") -> DataFrame:
    """Original and repaired text of each page, words in order."""
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", F.col(c).alias("v")))), lambda x: x["v"]), " ")
    return words.groupBy("page").agg(ordered("text").alias("original_text"), ordered(fixed).alias("repaired_text"), F.count("*").alias("word_count"))


def coerced(rows: DataFrame, box: str = "bbox") -> DataFrame:
    """Word rows of loose records: coordinates from a box struct if there is one, defaults for what is missing."""
    of = lambda c, default=None, kind="string": F.coalesce(F.col(c).cast(kind), F.lit(default).cast(kind)) if c in rows.columns else F.lit(default).cast(kind)
    place = lambda c: (F.when(F.col(box).isNotNull(), F.col(f"{box}.{c}")).otherwise(of(c, None, "double")) if box in rows.columns else of(c, None, "double")).cast("double").alias(c)
    text = of("text", "")
    return rows.select(
        text.alias("text"), F.coalesce(of("spoken_text"), text).alias("spoken_text"), of("language", "en").alias("language"), of("role", "body").alias("role"), of("section_type", "body").alias("section_type"), of("verse_key").alias("verse_key"), of("hadith_ref").alias("hadith_ref"),
        of("block_no", 0, "long").alias("block_no"), of("line_no", 0, "int").alias("line_no"), of("word_no", 0, "int").alias("word_no"), *(place(c) for c in ("x", "y", "width", "height")), of("page", None, "int").alias("page"), of("is_word_continuation", False, "boolean").alias("is_word_continuation"),
    )
