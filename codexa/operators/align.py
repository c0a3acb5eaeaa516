"""Text-pair alignment as DataFrames: links, recommendations, review, corrections, metrics, checks.

The unit of parallelism is an interval between landmarks of a structural pair; only landmarks and the path search
run in Python, one group for each pair and interval. All else is joins and grouped aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.functions import alignment as A
from codexa.functions import text as X
from codexa.operators import words
from codexa.sources.store import keep

PARAGRAPH_DETAIL, SENTENCE_DETAIL = 0.45, 0.60
LINK = "work string, pair int, interval int, level string, own int, parent_own int, ar_ids array<string>, en_ids array<string>, operation string, score double, confidence double, radius int, flags array<string>, ar_all array<string>, en_all array<string>, coarse boolean, waypoints int"
ANCHOR = "work string, pair int, a int, e int, score int, marks array<string>"
EXCLUDED = "exclude_from_alignment"


def numbered(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` (work, lang, seq, text) with the columns that may be missing: structure 0, no heading, no flags."""
    for name, value in (("structure", 0), ("heading", "")):
        if name not in paragraphs.columns:
            paragraphs = paragraphs.withColumn(name, F.lit(value))
    if "flags" not in paragraphs.columns:
        paragraphs = paragraphs.withColumn("flags", F.array().cast("array<string>"))
    return paragraphs.withColumn("id", paragraph_id(F.col("lang"), F.col("structure"), F.col("seq")))


def structure_id(lang: Column, structure: Column) -> Column:
    return F.concat(lang, F.format_string(":u%04d", structure))


def paragraph_id(lang: Column, structure: Column, seq: Column) -> Column:
    return F.concat(structure_id(lang, structure), F.format_string(":p%04d", seq))


def structures_of(paragraphs: DataFrame) -> DataFrame:
    """``(work, lang, sequence, id, heading)`` of numbered paragraphs."""
    return paragraphs.groupBy("work", "lang", F.col("structure").alias("sequence")).agg(F.max("heading").alias("heading")).withColumn("id", structure_id(F.col("lang"), F.col("sequence")))


def placed(paragraphs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Paragraphs that take part, with their structural pair and their place in it."""
    ids = pairs.select("work", "pair", F.explode(F.concat("ar_ids", "en_ids")).alias("structure_id"))
    own = paragraphs.filter(~F.array_contains("flags", EXCLUDED)).withColumn("structure_id", structure_id(F.col("lang"), F.col("structure")))
    at = F.row_number().over(Window.partitionBy("work", "pair", "lang").orderBy("structure", "seq")) - 1
    return own.join(ids, ["work", "structure_id"]).withColumn("at", at)


def anchors(units: DataFrame) -> DataFrame:
    """``(work, pair, a, e, score, marks)``: landmarks of each structural pair, one group for each."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("at")
        text = {lang: own[own.lang == lang].text.tolist() for lang in ("ar", "en")}
        found = A.landmarks(A.Side(text["ar"], True), A.Side(text["en"], False))
        return pd.DataFrame([(own.work.iloc[0], own.pair.iloc[0], *p) for p in found], columns=[c.split()[0] for c in ANCHOR.split(", ")])

    return units.select("work", "pair", "lang", "at", "text").groupBy("work", "pair").applyInPandas(run, ANCHOR)


def intervals(units: DataFrame, found: DataFrame) -> DataFrame:
    """``units`` with the number of the interval between landmarks that each is in; a landmark begins its interval."""
    marks = found.select("work", "pair", F.lit("ar").alias("lang"), F.col("a").alias("at"), "marks").unionByName(found.select("work", "pair", F.lit("en").alias("lang"), F.col("e").alias("at"), "marks"))
    by = Window.partitionBy("work", "pair", "lang").orderBy("at")
    return units.join(marks, ["work", "pair", "lang", "at"], "left").withColumn("interval", F.sum(F.col("marks").isNotNull().cast("int")).over(by).cast("int"))


def span_rows(own: pd.DataFrame, most_cells: int) -> pd.DataFrame:
    """Paragraph and sentence links of one interval."""
    own = own.sort_values("at")
    side = {lang: own[own.lang == lang] for lang in ("ar", "en")}
    text, ids = {k: v.text.tolist() for k, v in side.items()}, {k: v.id.tolist() for k, v in side.items()}
    begin = own.marks.dropna()
    vectors = None
    if "vector" in own and len(side["ar"]) and len(side["en"]):
        vectors = tuple(np.array(side[k].vector.tolist(), float) for k in ("ar", "en"))
    path, coarse, met = A.align_interval(text["ar"], text["en"], [*begin.iloc[0]] if len(begin) else None, most_cells, vectors)
    split = {"ar": A.arabic_sentences, "en": A.english_sentences}
    head, out = [own.work.iloc[0], own.pair.iloc[0], own.interval.iloc[0]], []
    for at, x in enumerate(path):
        span = {"ar": slice(x["a0"], x["a1"]), "en": slice(x["e0"], x["e1"])}
        parts = {k: [(f"{p}:s{n:04d}", s) for p, t in zip(ids[k][span[k]], text[k][span[k]], strict=True) for n, s in enumerate(split[k](t))] for k in span}
        every = [[i for i, _ in parts[k]] for k in ("ar", "en")]
        row = lambda level, own_no, parent, a, e, y: (*head, level, own_no, parent, a, e, y["op"], y["score"], y["confidence"], y["radius"], y["flags"], *every, coarse, met)
        out.append(row("paragraph", at, at, ids["ar"][span["ar"]], ids["en"][span["en"]], x))
        if parts["ar"] and parts["en"] and x["confidence"] >= PARAGRAPH_DETAIL and not {"coarse_interval", "skip"} & set(x["flags"]):
            steps = A.align([s for _, s in parts["ar"]], [s for _, s in parts["en"]], most_cells=most_cells) or []
            out += [row("sentence", k, at, every[0][y["a0"] : y["a1"]], every[1][y["e0"] : y["e1"]], y) for k, y in enumerate(steps)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in LINK.split(", ")])


def links(paragraphs: DataFrame, most_cells: int = A.MOST_CELLS, pairs: DataFrame | None = None) -> DataFrame:
    """Paragraph and sentence links of each work.

    ``paragraphs`` has work, lang, seq and text, and may have structure, heading, flags, and a vector, which then scores paragraph
    spans. Structural pairs come from the headings, or from ``pairs`` as ``words.structural_links`` gives them. A group is an
    interval between landmarks of a structural pair, so a long work is many groups. Numbers run through a work, in order of
    pair, interval and step. The links are written to the shared folder: all that follows reads them from there.
    """
    paragraphs = numbered(paragraphs)
    if pairs is None:
        pairs = words.structural_links(structures_of(paragraphs))
    pairs = keep(pairs, "pairs")
    units = placed(paragraphs, pairs)
    marked = intervals(units, anchors(units))
    kept = ["work", "pair", "interval", "lang", "at", "id", "text", "marks", *(["vector"] if "vector" in paragraphs.columns else [])]
    raw = keep(marked.select(kept).groupBy("work", "pair", "interval").applyInPandas(lambda own: span_rows(own, most_cells), LINK), "spans")
    order = Window.partitionBy("work").orderBy("pair", "interval").rowsBetween(Window.unboundedPreceding, -1)
    before = raw.groupBy("work", "pair", "interval").agg(F.count_if(F.col("level") == "paragraph").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).select("work", "pair", "interval", "base")
    out = raw.join(before, ["work", "pair", "interval"])
    number = lambda c: (F.col("base") + F.col(c)).cast("int")
    own = F.when(F.col("level") == "paragraph", number("own")).otherwise(F.col("own"))
    out = out.select("work", "pair", "interval", "level", own.alias("link"), number("parent_own").alias("parent"), *[c.split()[0] for c in LINK.split(", ")[6:]])
    told = pairs.select("work", "pair", F.col("ar_ids").alias("pair_ar"), F.col("en_ids").alias("pair_en"), F.col("confidence").alias("pair_confidence"), F.col("flags").alias("pair_flags"))
    return keep(out.join(told, ["work", "pair"]), "links")


def sentence_rows(found: DataFrame) -> DataFrame:
    """``(work, lang, id, paragraph, global_sequence)`` of all sentences, numbered through a work in order of the links."""
    own = found.filter("level = 'paragraph'")
    side = lambda lang: own.select("work", F.lit(lang).alias("lang"), "link", F.posexplode(f"{lang}_all").alias("at", "id"))
    by = Window.partitionBy("work", "lang").orderBy("link", "at")
    return side("ar").unionByName(side("en")).select("work", "lang", "id", F.regexp_extract("id", r"^(.*):s\d+$", 1).alias("paragraph"), (F.row_number().over(by) - 1).alias("global_sequence"))


def recommended(found: DataFrame) -> DataFrame:
    """One recommendation for each paragraph link, at the finest level that the evidence allows."""
    own = found.filter("level = 'paragraph'")
    usable = found.filter("level = 'sentence' and size(ar_ids) > 0 and size(en_ids) > 0 and not array_contains(flags, 'skip')")
    fine = usable.groupBy("work", "parent").agg(F.min("confidence").alias("least"), F.round(F.avg("confidence"), 6).alias("mean"), F.max("radius").alias("wide"))
    own = own.join(fine, ["work", "parent"], "left")
    both = (F.size("ar_ids") > 0) & (F.size("en_ids") > 0)
    level = F.when(F.coalesce(F.col("least"), F.lit(0.0)) >= SENTENCE_DETAIL, "sentence").when(both & (F.col("confidence") >= PARAGRAPH_DETAIL), "paragraph").when(both, "region").otherwise("structure")
    own = own.withColumn("resolution", level)
    by = lambda sentence, paragraph, region, structure: F.when(F.col("resolution") == "sentence", sentence).when(F.col("resolution") == "paragraph", paragraph).when(F.col("resolution") == "region", region).otherwise(structure)
    none = F.array().cast("array<string>")
    return own.select(
        "work",
        "link",
        "resolution",
        by(F.col("ar_all"), F.col("ar_ids"), F.col("ar_ids"), F.col("pair_ar")).alias("ar_ids"),
        by(F.col("en_all"), F.col("en_ids"), F.col("en_ids"), F.col("pair_en")).alias("en_ids"),
        by(F.col("mean"), F.col("confidence"), F.col("confidence"), F.col("pair_confidence")).alias("confidence"),
        by(F.col("wide"), F.col("radius"), F.greatest(F.lit(3), "radius"), F.lit(3)).alias("radius"),
        by(F.lit("sentence_path_above_threshold"), F.lit("sentence_evidence_too_weak"), F.lit("paragraph_evidence_too_weak"), F.lit("one_sided_omission_or_addition")).alias("reason"),
        by(none, F.col("flags"), F.array_sort(F.array_union("flags", F.array(F.lit("local_region_fallback")))), F.array_sort(F.array_union("flags", "pair_flags"))).alias("flags"),
    )


def review_queue(rec: DataFrame, ar_hash: Column, en_hash: Column) -> DataFrame:
    """A stable item for each recommendation that leaves a doubt."""
    reasons = F.filter(
        F.array_union(
            "flags",
            F.array(
                F.when(F.col("resolution") != "sentence", F.concat(F.lit("zoomed_out_to_"), "resolution")),
                F.when(F.col("radius") > 0, F.lit("nonzero_uncertainty_radius")),
                F.when(F.col("confidence") < 0.70, F.lit("low_score_confidence")),
            ),
        ),
        lambda r: r.isNotNull(),
    )
    parts = F.concat(F.array(F.col("link").cast("string"), ar_hash, en_hash, F.col("resolution")), "ar_ids", F.array(F.lit("=>")), "en_ids")
    high = F.col("resolution").isin("region", "structure") | F.array_contains("flags", "coarse_interval")
    medium = (F.col("resolution") == "paragraph") | (F.col("confidence") < 0.55)
    out = rec.withColumn("reasons", F.array_sort(F.array_distinct(reasons))).filter(F.size("reasons") > 0)
    return out.select(
        "work",
        F.concat(F.lit("review:"), F.substring(F.sha2(F.array_join(parts, "\0"), 256), 1, 20)).alias("review_id"),
        "link",
        F.when(high, "high").when(medium, "medium").otherwise("low").alias("priority"),
        "ar_ids",
        "en_ids",
        "resolution",
        "confidence",
        "radius",
        "reasons",
        F.lit("pending").alias("status"),
        F.col("reason").alias("evidence"),
    )


def judged(queue: DataFrame, verdicts: DataFrame, sure: float = 0.8) -> DataFrame:
    """Queue statuses from a table of verdicts; links are never changed."""
    status = F.when((F.col("verdict") == "aligned") & (F.col("sure") >= sure), "model_accepted").when((F.col("verdict") == "wrong") & (F.col("sure") >= sure), "model_rejected").when(F.col("verdict").isNotNull(), "needs_review").otherwise(F.col("status"))
    return queue.join(verdicts.select("review_id", "verdict", F.col("confidence").alias("sure")), "review_id", "left").withColumn("status", status)


def stale(queue: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections that name no review item, or that name one twice."""
    twice = corrections.groupBy("review_id").agg(F.count("*").alias("n")).filter("n > 1").select("review_id", F.lit("duplicate").alias("fault"))
    unknown = corrections.join(queue, "review_id", "left_anti").select("review_id", F.lit("stale").alias("fault"))
    return unknown.unionByName(twice)


def corrected(rec: DataFrame, queue: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recommendations and queue after accept, reject and replace actions."""
    act = queue.select("work", "link", "review_id").join(corrections, "review_id")
    out = rec.join(act.drop("review_id"), ["work", "link"], "left")
    new = F.col("action") == "replace"
    out = out.select(
        "work",
        "link",
        F.when(new, F.coalesce("new_resolution", "resolution")).otherwise(F.col("resolution")).alias("resolution"),
        F.when(new, F.coalesce("new_ar", "ar_ids")).otherwise(F.col("ar_ids")).alias("ar_ids"),
        F.when(new, F.coalesce("new_en", "en_ids")).otherwise(F.col("en_ids")).alias("en_ids"),
        F.when(new, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(new, 0).otherwise(F.col("radius")).alias("radius"),
        F.when(F.col("action") == "reject", F.array_union("flags", F.array(F.lit("human_rejected")))).otherwise(F.col("flags")).alias("flags"),
    )
    status = F.when(F.col("action") == "accept", "human_accepted").when(F.col("action") == "reject", "human_rejected").when(F.col("action") == "replace", "human_replaced").otherwise(F.col("status"))
    return out, queue.join(corrections.select("review_id", "action"), "review_id", "left").withColumn("status", status)


def unit_texts(paragraphs: DataFrame) -> DataFrame:
    """``(work, id, text, flags)`` of paragraphs, to resolve the ids of links."""
    return numbered(paragraphs).select("work", "id", "text", "flags")


def resolved(rec: DataFrame, units: DataFrame, side: str) -> DataFrame:
    """Texts of one side of each recommendation, in order; a structure's id stands for all its paragraphs."""
    ids = rec.select("work", "link", F.posexplode(side).alias("at", "id"))
    exact = ids.withColumn("id", F.regexp_extract("id", r"^[a-z]+:u\d+:p\d+", 0)).filter("id <> ''").groupBy("work", "link", "id").agg(F.min("at").alias("at"))
    met = exact.join(units.select("work", "id", "text"), ["work", "id"]).select("work", "link", "at", "id", "text")
    whole = ids.filter(~F.col("id").contains(":p")).withColumnRenamed("id", "structure_id").join(units.withColumn("structure_id", F.substring_index("id", ":p", 1)), ["work", "structure_id"]).select("work", "link", "at", "id", "text")
    both = met.unionByName(whole)
    return both.groupBy("work", "link").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "id", "text"))), lambda x: x["text"]), "\n").alias("text"))


def diagnostics(paragraphs: DataFrame, found: DataFrame, rec: DataFrame, queue: DataFrame) -> DataFrame:
    """Counts and coverage of each work; a paragraph is covered if any link names it."""
    units = unit_texts(paragraphs).filter(~F.array_contains("flags", EXCLUDED)).withColumn("lang", F.substring("id", 1, 2))
    met = found.filter("level = 'paragraph'").select("work", F.explode(F.concat("ar_ids", "en_ids")).alias("id")).distinct()
    share = lambda lang: F.sum(F.when(F.col("lang") == lang, F.coalesce("hit", F.lit(0)))) / F.nullif(F.count_if(F.col("lang") == lang), F.lit(0))
    cover = units.join(met.withColumn("hit", F.lit(1)), ["work", "id"], "left").groupBy("work").agg(F.count_if(F.col("lang") == "ar").alias("arabic_paragraphs"), F.count_if(F.col("lang") == "en").alias("english_paragraphs"), share("ar").alias("ar"), share("en").alias("en"))
    pairs = found.groupBy("work", "pair").agg(F.bool_or("coarse").alias("coarse")).groupBy("work").agg(F.count("*").alias("structural_links"), F.count_if("coarse").alias("coarse_intervals"))
    sentences = found.filter("level = 'sentence'").groupBy("work").agg(F.count("*").alias("sentence_links"))
    per = found.filter("level = 'paragraph'").groupBy("work").agg(F.count("*").alias("paragraph_links"), F.count_if(F.array_contains("flags", "hard_landmark")).alias("hard_landmarks"))
    levels = rec.groupBy("work").agg(*[F.count_if(F.col("resolution") == r).alias(f"{r}_level") for r in ("sentence", "paragraph", "region", "structure")])
    marks = queue.groupBy("work").agg(*[F.count_if(F.col("priority") == p).alias(f"{p}_priority") for p in ("high", "medium", "low")])
    out = cover
    for more in (pairs, per, sentences, levels, marks):
        out = out.join(more, "work", "left")
    return out.withColumns({"arabic_coverage": F.round(F.coalesce("ar", F.lit(1.0)), 6), "english_coverage": F.round(F.coalesce("en", F.lit(1.0)), 6)}).drop("ar", "en").fillna(0)


def faults(paragraphs: DataFrame, found: DataFrame, rec: DataFrame, queue: DataFrame) -> DataFrame:
    """``(fault, n)`` of broken references and crossed clamps; all counts are 0 in a valid result."""
    units = unit_texts(paragraphs).select("work", "id")
    said = sentence_rows(found).select("work", "id")
    ids = lambda df, *keys: df.select("work", *keys, F.explode(F.concat("ar_ids", "en_ids")).alias("id"))
    own, fine = found.filter("level = 'paragraph'"), found.filter("level = 'sentence'")
    # the structures and paragraphs that a link may name
    clamp = found.select("work", "pair", F.explode(F.concat("pair_ar", "pair_en")).alias("structure_id")).distinct()
    unit = lambda df: df.withColumn("structure_id", F.regexp_extract("id", r"^[a-z]+:u\d+", 0))
    parents = own.select("work", F.col("link").alias("parent"), F.explode(F.concat("ar_ids", "en_ids")).alias("paragraph"))
    level = lambda *names: rec.filter(F.col("resolution").isin(*names))
    # a recommendation's structures must all be those of its own link's pair
    home = own.select("work", "link", F.concat("pair_ar", "pair_en").alias("home"))
    crossing = unit(ids(rec, "link")).join(home, ["work", "link"]).filter(~F.array_contains("home", F.col("structure_id"))).select("work", "link").distinct()
    known = rec.select("work", "link", F.struct("ar_ids", "en_ids", "resolution").alias("now"))
    moved = queue.join(known, ["work", "link"], "left").filter(~F.struct("ar_ids", "en_ids", "resolution").eqNullSafe(F.col("now")))
    parts = {
        "paragraph_link": ids(own).join(units, ["work", "id"], "left_anti"),
        "paragraph_clamp": unit(ids(own, "pair")).join(clamp, ["work", "pair", "structure_id"], "left_anti"),
        "sentence_link": ids(fine).join(said, ["work", "id"], "left_anti"),
        "sentence_parent": fine.join(own.select("work", F.col("link").alias("parent")), ["work", "parent"], "left_anti"),
        "sentence_clamp": ids(fine, "parent").withColumn("paragraph", F.substring_index("id", ":s", 1)).join(parents, ["work", "parent", "paragraph"], "left_anti"),
        "recommendation": ids(level("paragraph", "region")).join(units, ["work", "id"], "left_anti").unionByName(ids(level("sentence")).join(said, ["work", "id"], "left_anti")),
        "structure_clamp": crossing,
        "review": moved,
    }
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n") for name, df in parts.items()]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def judge_queue(queue: DataFrame, most: int | None = None) -> DataFrame:
    """The pending items that a judge gets, ``most`` at most for each work, in order of their links."""
    pending = queue.filter("status = 'pending'")
    if most is None:
        return pending
    if most < 0:
        raise ValueError("the number of items must not be negative")
    return pending.withColumn("k", F.row_number().over(Window.partitionBy("work").orderBy("link"))).filter(F.col("k") <= most).drop("k")


def unknown_gold(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Sentence ids of gold rows (work, id, ar_ids, en_ids) that the alignment doesn't have: ``(work, gold, id)``."""
    ids = gold.select("work", F.col("id").alias("gold"), F.explode(F.concat("ar_ids", "en_ids")).alias("id"))
    return ids.join(sentence_rows(found).select("work", "id"), ["work", "id"], "left_anti").select("work", "gold", "id")


def sentence_metrics(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Accuracy of sentence links against gold rows (work, id, ar_ids, en_ids); an unknown sentence id fails the query."""
    order = sentence_rows(found).select("work", "id", F.col("global_sequence").alias("pos"), "paragraph")
    wrong = unknown_gold(found, gold).groupBy("work").agg(F.min("id").alias("unknown"))
    gold = gold.join(wrong, "work", "left").withColumn("id", F.when(F.col("unknown").isNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("gold names unknown sentence "), "unknown")).cast("string"))).drop("unknown")
    told = found.filter("level = 'sentence'").select("work", F.explode("ar_ids").alias("ar"), F.col("en_ids").alias("said"))
    want = gold.select("work", F.col("id").alias("gold"), F.explode("ar_ids").alias("ar"), "en_ids")
    said = want.join(told, ["work", "ar"], "left").groupBy("work", "gold").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("said", F.array().cast("array<string>")))))).alias("said"))
    spot = lambda df, c, name: df.select("work", "gold", F.explode(c).alias("id")).join(order, ["work", "id"]).groupBy("work", "gold").agg(F.min("pos").alias(f"{name}_lo"), F.max("pos").alias(f"{name}_hi"), F.collect_set("paragraph").alias(f"{name}_par"))
    rows = gold.withColumnRenamed("id", "gold")
    out = rows.join(said, ["work", "gold"]).join(spot(rows, "en_ids", "g"), ["work", "gold"], "left").join(spot(said, "said", "p"), ["work", "gold"], "left").join(spot(rows, "ar_ids", "a"), ["work", "gold"], "left")
    exact = F.array_sort("en_ids").eqNullSafe(F.col("said"))
    near = lambda k: exact | F.coalesce((F.col("g_lo") >= F.col("p_lo") - k) & (F.col("g_hi") <= F.col("p_hi") + k), F.lit(False))
    hit = F.coalesce(F.arrays_overlap("g_par", "p_par"), F.lit(False))
    out = out.withColumns({"exact": exact, "b1": near(1), "b2": near(2), "hit": hit})
    ahead = Window.partitionBy("work").orderBy("a_lo", F.col("b2").cast("int"), "gold").rowsBetween(1, Window.unboundedFollowing)
    out = out.withColumn("wait", F.when(~F.col("b2"), F.first(F.when(F.col("b2"), F.col("a_lo")), ignorenulls=True).over(ahead) - F.col("a_lo")))
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return out.groupBy("work").agg(F.count("*").alias("gold_links"), share("exact").alias("exact"), share("b1").alias("buffer_1"), share("b2").alias("buffer_2"), share("hit").alias("paragraph_correct"), F.round(F.avg((~F.col("hit")).cast("int")), 6).alias("catastrophic"), F.round(F.avg("wait"), 3).alias("reanchor_mean"), F.max("wait").alias("reanchor_max"))


#: N-grams of passages that are broadcast at most (some 32 MB).
MOST_GRAMS = 1 << 20


def region_matches(paragraphs: DataFrame, regions: DataFrame, least: float = 0.45) -> DataFrame:
    """The best run of neighbouring paragraphs that a region's n-grams cover.

    ``paragraphs``: (doc, pos, text); ``regions``: (region, text). An equi-join on hashed n-grams, then
    gaps and islands over the positions that match. If the passages' n-grams are counted to be few, they are broadcast, so
    that only hits are shuffled; else the join is by shuffle.
    """
    grams = lambda df, *keys: df.select(*keys, X.grams(X.region_tokens(F.col("text"))).alias("g")).select(*keys, F.size("g").alias("n"), F.explode("g").alias("gram"))
    wanted = grams(regions, "region").select("region", "gram")
    few = wanted.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS
    met = grams(paragraphs, "doc", "pos").join(F.broadcast(wanted) if few else wanted, "gram")
    score = met.groupBy("doc", "region", "pos").agg((F.count("*") / F.first("n")).alias("score")).filter(F.col("score") >= least)
    by = Window.partitionBy("doc", "region").orderBy("pos")
    runs = score.withColumn("run", F.col("pos") - F.row_number().over(by))
    runs = runs.groupBy("doc", "region", "run").agg(F.sum("score").alias("total"), F.count("*").alias("length"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    best = runs.groupBy("doc", "region").agg(F.max_by(F.struct("first", "last", "length", "total"), F.struct("total", "length", -F.col("first"))).alias("b"))
    return best.select("doc", "region", F.col("b.first").alias("first_pos"), F.col("b.last").alias("last_pos"), F.col("b.length").alias("n_paragraphs"), F.round("b.total", 6).alias("total_score"))


def region_predictions(found: DataFrame, gold: DataFrame, order: DataFrame) -> DataFrame:
    """``gold`` (work, region, ar_ids, en_ids) with ``said``, the places that links of its Arabic paragraphs name, and ``want``, its own.

    ``order``: (work, id, pos) of the English paragraphs that take part. A region without paragraphs on a side is unmapped: ``want`` is null.
    """
    told = found.filter("level = 'paragraph'").select("work", F.explode("ar_ids").alias("ar"), "en_ids").select("work", "ar", F.explode("en_ids").alias("id"))
    said = gold.select("work", "region", F.explode("ar_ids").alias("ar")).join(told, ["work", "ar"]).join(order, ["work", "id"]).groupBy("work", "region").agg(F.array_sort(F.collect_set("pos")).alias("said"))
    want = gold.filter("size(ar_ids) > 0").select("work", "region", F.explode("en_ids").alias("id")).join(order, ["work", "id"]).groupBy("work", "region").agg(F.array_sort(F.collect_set("pos")).alias("want"))
    out = gold.select("work", "region").join(said, ["work", "region"], "left").join(want, ["work", "region"], "left")
    return out.withColumn("said", F.coalesce("said", F.array().cast("array<int>")))


def region_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Accuracy of predicted paragraph sets. ``rows``: ``want`` and ``said``, sorted places; ``want`` is null where a region could not be mapped.

    A buffer of k asks that the predicted span, widened by k, holds the wanted one. An empty prediction counts as a miss.
    """
    want, said = F.col("want"), F.col("said")
    mapped, any_ = want.isNotNull(), F.size(said) > 0
    exact, shared = want == said, F.size(F.array_intersect(want, said))
    first, last = F.get(said, 0), F.get(said, F.size(said) - 1)
    low, high = F.get(want, 0), F.get(want, F.size(want) - 1)
    within = lambda k: exact | (any_ & (low >= first - k) & (high <= last + k))
    share = lambda c: F.round(F.coalesce(F.avg(F.when(mapped, F.coalesce(c.cast("double"), F.lit(0.0)))), F.lit(0.0)), 6)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("gold_regions"),
        F.count_if(mapped).alias("scored_regions"),
        F.count_if(~mapped).alias("mapping_failures"),
        share(exact).alias("exact"),
        share(F.size(F.array_except(want, said)) == 0).alias("contains_gold_region"),
        share(within(1)).alias("buffer_1"),
        share(within(2)).alias("buffer_2"),
        share(shared > 0).alias("paragraph_correct"),
        share(shared == 0).alias("catastrophic"),
        share(F.when(any_, shared / F.size(said)).otherwise(0.0)).alias("span_precision_mean"),
        share(shared / F.size(want)).alias("span_recall_mean"),
    )


#: Vectors of a side in a block of the similarity matrix.
MATRIX = 1024


def best_of_blocks(left: DataFrame, right: DataFrame, digits: int = 5) -> DataFrame:
    """``(side, id, other, sim)``: for each vector the two best of the other side inside its group and block, by cosine.

    ``left`` and ``right``: (grp, id, v). Both sides are cut into blocks of about ``MATRIX`` rows; a pair of blocks is one matrix product, and no pair
    of vectors leaves it but the best.
    """
    def blocked(df: DataFrame, name: str, other: DataFrame) -> DataFrame:
        n = df.groupBy("grp").agg(F.ceil(F.count("*") / MATRIX).cast("int").alias("n"))
        m = other.groupBy("grp").agg(F.ceil(F.count("*") / MATRIX).cast("int").alias("m"))
        rows = df.join(n, "grp").join(m, "grp").select("grp", "id", "v", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("across"))
        blocks = ("own", "across") if name == "left" else ("across", "own")
        return rows.select("grp", F.col(blocks[0]).alias("bi"), F.col(blocks[1]).alias("bj"), F.lit(name).alias("side"), "id", "v")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        out = []
        ids, unit = {}, {}
        for name in ("left", "right"):
            part = own[own.side == name].sort_values("id")
            v = np.array(part.v.tolist(), float).reshape(len(part), -1)
            ids[name], unit[name] = part.id.to_numpy(), v / np.maximum(1e-300, np.linalg.norm(v, axis=1, keepdims=True))
        if len(ids["left"]) and len(ids["right"]):
            cosine = np.round(unit["left"] @ unit["right"].T, digits)
            for name, other, m in (("left", "right", cosine), ("right", "left", cosine.T)):
                # stable: of equal similarities the least id comes first
                best = np.argsort(-m, axis=1, kind="stable")[:, :2]
                out += [(name, ids[name][i], ids[other][j], m[i, j]) for i in range(len(m)) for j in best[i]]
        return pd.DataFrame(out, columns=["side", "id", "other", "sim"])

    return blocked(left, "left", right).unionByName(blocked(right, "right", left)).groupBy("grp", "bi", "bj").applyInPandas(run, "side string, id long, other long, sim double")


def mutual_best(best: DataFrame, least: float = A.WAYPOINT_SIMILARITY, margin: float = A.WAYPOINT_MARGIN) -> DataFrame:
    """Pairs (i, j, sim) that are each other's best, with a lead over the left one's second; ties go to the least id.

    ``best``: (side, id, other, sim) as ``best_of_blocks`` gives them.
    """
    by = Window.partitionBy("side", "id").orderBy(F.desc("sim"), "other")
    ranked = best.withColumns({"k": F.row_number().over(by), "second": F.lead("sim").over(by)}).filter("k = 1")
    sure = (F.col("sim") >= least) & (F.coalesce(F.round(F.col("sim") - F.col("second"), 9), F.lit(1.0)) >= margin)
    rows = ranked.filter((F.col("side") == "left") & sure).select(F.col("id").alias("i"), F.col("other").alias("j"), "sim")
    cols = ranked.filter("side = 'right'").select(F.col("id").alias("j"), F.col("other").alias("i"))
    return rows.join(cols, ["i", "j"]).select("i", "j", "sim")


def profile(memory: Column, runtime: Column) -> Column:
    """The alignment mode that a machine can carry: memory in GiB (0 or null: unknown), and whether it can compute vectors."""
    size = F.coalesce(memory, F.lit(0.0))
    return F.when(~runtime, "basic").when((size > 0) & (size < 8), "balanced").when(size >= 12, "thorough").otherwise("balanced")


def advice(memory: Column, runtime: Column, models: Column, judge: Column) -> Column:
    """``struct(profile, scope, judge, notes)``; ``models`` are the names of local models, ``judge``: whether a server of them answers.

    No judge is ever recommended without gold to calibrate it.
    """
    size, mode = F.coalesce(memory, F.lit(0.0)), profile(memory, runtime)
    able = F.exists(models, lambda m: ~F.lower(m).contains("embed") & F.lower(m).rlike("gemma|qwen|llama")) & (size >= 8)
    notes = F.array(
        F.lit("No model is downloaded or started automatically."),
        F.when(~runtime, "Install the optional semantic extra for cross-language retrieval.").when((size > 0) & (size < 8), "Paragraph-only semantic retrieval limits memory use."),
        F.when(able, "Runnable Ollama models were detected, but no judge is recommended without calibration gold.").when(judge, "No suitable installed generative Ollama model was detected."),
    )
    scope = F.when(mode == "basic", "none").when(mode == "thorough", "paragraph_and_sentence").otherwise("paragraph")
    return F.struct(mode.alias("profile"), scope.alias("scope"), F.lit(None).cast("string").alias("judge"), F.filter(notes, lambda n: n.isNotNull()).alias("notes"))
