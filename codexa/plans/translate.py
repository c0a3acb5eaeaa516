"""A pair of texts to checked links: numbering, alignment, review, corrections, metrics, bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexa.operators import align, sources
from codexa.sources import files


def paragraphs_of(texts: DataFrame) -> DataFrame:
    """``(work, lang, structure, heading, seq, text, flags)`` of all paragraphs, from (work, lang, text)."""
    out = None
    for lang in ("ar", "en"):
        own = sources.structures(texts.filter(F.col("lang") == lang), key="work", lang=lang)
        rows = own.select("work", F.lit(lang).alias("lang"), "structure", "heading", F.col("sequence").alias("seq"), "text", "flags")
        out = rows if out is None else out.unionByName(rows)
    return out


def gold_metrics(found: DataFrame, gold: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Metrics of each work: by sentence if the gold has sentence ids, else by passage region.

    ``gold``: (work, id, ar_ids, en_ids), or (work, region, arabic, english) with the texts of passages.
    """
    if "ar_ids" in gold.columns:
        return align.sentence_metrics(found, gold)
    units = align.numbered(paragraphs).filter(~F.array_contains("flags", align.EXCLUDED))
    pos = (F.row_number().over(Window.partitionBy("work", "lang").orderBy("structure", "seq")) - 1).alias("pos")
    order = units.select("work", "lang", "id", "text", pos)
    sides = {}
    for lang, column in (("ar", "arabic"), ("en", "english")):
        own = order.filter(F.col("lang") == lang)
        passages = gold.select(F.struct("work", "region").alias("region"), F.col(column).alias("text"))
        met = align.region_matches(own.select(F.col("work").alias("doc"), "pos", "text"), passages).filter("doc = region.work")
        ids = met.select("region", "doc", F.explode(F.sequence("first_pos", "last_pos")).alias("pos")).join(own.select(F.col("work").alias("doc"), "pos", "id"), ["doc", "pos"])
        sides[lang] = ids.groupBy("region.work", "region.region").agg(F.collect_list("id").alias(f"{lang}_ids"))
    none = F.array().cast("array<string>")
    mapped = gold.select("work", "region").join(sides["ar"], ["work", "region"], "left").join(sides["en"], ["work", "region"], "left")
    mapped = mapped.select("work", "region", F.coalesce("ar_ids", none).alias("ar_ids"), F.coalesce("en_ids", none).alias("en_ids"))
    return align.region_metrics(align.region_predictions(found, mapped, order.filter("lang = 'en'").select("work", "id", "pos")), "work")


def translate(paragraphs: DataFrame, verdicts: DataFrame | None = None, corrections: DataFrame | None = None, gold: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of an alignment. Stale or doubled corrections are in ``faults``; the others are applied. With gold there are ``metrics``."""
    paragraphs = align.numbered(paragraphs)
    found = align.links(paragraphs)
    rec = align.recommended(found)
    hashes = paragraphs.groupBy("work").agg(*[F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("lang") == lang, F.struct("structure", "seq", "text")))), lambda x: x["text"]), "\n"), 256).alias(f"{lang}_hash") for lang in ("ar", "en")])
    queue = align.review_queue(rec.join(hashes, "work"), F.col("ar_hash"), F.col("en_hash"))
    out = {"links": found, "recommended": rec, "queue": queue, "faults": align.faults(paragraphs, found, rec, queue).filter("n > 0"), "sentences": align.sentence_rows(found)}
    if verdicts is not None:
        out["queue"] = queue = align.judged(queue, verdicts)
    if corrections is not None:
        bad = align.stale(queue, corrections)
        out["faults"] = out["faults"].unionByName(bad.groupBy("fault").agg(F.count("*").alias("n")))
        out["recommended"], out["queue"] = align.corrected(rec, queue, corrections.join(bad.select("review_id"), "review_id", "left_anti"))
    if gold is not None:
        out["metrics"] = gold_metrics(found, gold, paragraphs)
    out["diagnostics"] = align.diagnostics(paragraphs, found, rec, queue)
    return out


#: Tables of a bundle.
MEMBERS = ["links", "sentences", "recommended", "queue", "diagnostics"]


def save(tables: dict[str, DataFrame], work: str, path: str, force: bool = False) -> DataFrame:
    """The tables as a bundle; returns the manifest."""
    return files.write_bundle({k: tables[k] for k in MEMBERS}, work, path, force)
