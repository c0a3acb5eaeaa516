"""Operators with literal inputs, sources and bundles."""

import json
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codexa.operators import align, layout, pages, sources, words
from codexa.plans import fixtures as fx
from codexa.sources import files

WORDS = "doc_id long, page int, block_no long, line_no int, word_no int, ord long, text string, spoken_text string, role string, section_type string, verse_key string, hadith_ref string, y double, height double, is_word_continuation boolean"


def word(n, text, role="body", page=1, section=None, verse=None, y=0.0, cont=False, block=0):
    return (1, page, block, 0, n, n, text, None, role, section, verse, None, y, 10.0, cont)


def test_blocks(spark):
    rows = [
        word(0, "Title", section="header"),
        word(1, "one"),
        word(2, "two"),
        word(3, "far", y=40.0),
        word(4, "near", y=45.0),
        word(5, "آية", role="quran", verse="1:1", y=45.0),
        word(6, "أخرى", role="quran", verse="1:2", y=45.0),
        word(7, "x", page=2),
        word(8, "skip", page=2, cont=True),
    ]
    got = layout.blocks(spark.createDataFrame(rows, WORDS)).orderBy("block_seq").collect()
    assert [(r["type"], r["text"], r["page"], r["verse_key"]) for r in got] == [
        ("heading", "Title", 1, None),
        ("paragraph", "one two", 1, None),
        ("paragraph", "far near", 1, None),
        ("verse", "آية", 1, "1:1"),
        ("verse", "أخرى", 1, "1:2"),
        ("paragraph", "x", 2, None),
    ]
    md = layout.markdown(spark.createDataFrame([r.asDict() for r in got], "doc_id long, block_seq int, type string, text string, page int, verse_key string, hadith_ref string, dominant_role string, n_words long")).first()
    assert md["markdown"].startswith("## Title\n\none two\n\n") and "> آية **[1:1]**" in md["markdown"]


def test_figures(spark):
    md, flat = layout.rendered_figure(F.lit("chart"), F.lit(None).cast("string"), F.lit("cap"), F.lit("more"))
    row = spark.range(1).select(md.alias("m"), flat.alias("f")).first()
    assert row["m"] == '<!-- figure:start type=chart label="None" -->\n**None (chart):** cap\n\nDescription: more\n<!-- figure:end -->'
    assert row["f"] == "[Figure: more]"


def test_markdown_import(spark):
    docs = spark.createDataFrame([(1, "# Head\ntext *one*\ntext two\n\n```\ncode\n```\n> quote\n> آية\nlast [a](b)")], "doc_id long, text string")
    got = layout.from_markdown(docs).orderBy("block_seq").collect()
    assert [(r["type"], r["text"]) for r in got] == [("heading", "Head"), ("paragraph", "text one text two"), ("paragraph", "quote"), ("verse", "آية"), ("paragraph", "last a")]


def test_page_marks(spark):
    got = sources.with_pages(fx.BLOCKS.df(spark).withColumn("doc", F.lit(1)), ["doc"]).orderBy("ord").collect()
    assert [r["page"] for r in got] == [1, 1, 218, 218, 218, 218, 219, 219]


def test_font_ties_go_to_the_first_span(spark):
    spans = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 9.0, "SabondiexA"), (1, 1, 0.0, 0.0, 10.0, 9.0, "SabondiexB")], "page int, span_no int, x0 double, y0 double, x1 double, y1 double, font string")
    boxes = spark.createDataFrame([(1, 0, 1.0, 1.0, 5.0, 8.0, "ß"), (1, 1, 11.5, 1.0, 20.0, 8.0, "ß")], "page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {r["word_no"]: (r["font"], r["repaired"]) for r in pages.fonts_of_words(boxes, spans).collect()}
    assert got == {0: ("SabondiexA", "ṣ"), 1: (None, "ß")}


def test_routing_rules(spark):
    base = {"word_count": F.lit(100), "qcf": F.lit(False), "mojibake_count": F.lit(0), "mojibake_rate": F.lit(0.0), "text_coverage": F.lit(0.9), "image_ratio": F.lit(0.0), "table": F.lit(False), "images": F.lit(0)}
    run = lambda o=None, **kw: tuple(spark.range(1).select(pages.route(base | (o or {}), **kw).alias("r")).first()["r"])
    assert run()[0] == "skip" and run()[2] == 0.85
    assert run({"word_count": F.lit(0)})[::2] == ("enrich_vision", 0.95)
    assert run({"table": F.lit(True)}, visual=True)[::2] == ("enrich_vision", 0.90)
    assert run({"images": F.lit(2)}, visual=True)[1] == ["2 image(s) detected and visual descriptions requested"]
    assert run({"mojibake_count": F.lit(3)})[::2] == ("enrich_text", 0.80)
    assert run(roles=True)[2] == 0.70 and run({"qcf": F.lit(True)}, roles=True)[0] == "skip"
    assert run(fidelity=True)[2] == 0.65
    assert run({"text_coverage": F.lit(0.01), "image_ratio": F.lit(0.6), "word_count": F.lit(20)})[1] == ["low text coverage (1.0%) + high image area (60%) + low word_count (20)"]


def test_transliteration(spark):
    book = spark.createDataFrame([("Qalb", "قلب"), ("hammazan", "هماز")], "word string, arabic string")
    texts = spark.createDataFrame([(1, "the (qalb12) and (hammazan) and (other)"), (2, "none")], "id int, text string")
    got = {r["id"]: r["annotated"] for r in words.annotated(texts, book).collect()}
    assert got == {1: "the (qalb12 قلب) and (hammazan هماز) and (other)", 2: "none"}


def test_joined_words(spark):
    rows = [("a", 0, "Prophet"), ("a", 1, "ﷺ"), ("a", 2, "hy-"), ("a", 3, "phen"), ("a", 4, "ﷺ said")]
    got = words.joined_words(spark.createDataFrame(rows, "line string, ord int, text string")).orderBy("ord").collect()
    assert [(r["normalized"], r["honorific"]) for r in got] == [("Prophet", "SAW"), ("hyphen", "SAW"), ("said", None)]


def test_batch_reversal(spark):
    good, bad = [(1, k, "بِسْمِ") for k in range(4)], [(2, k, "ِبس") for k in range(4)]
    got = {r["page"]: r["is_reversed"] for r in words.batch_reversed(spark.createDataFrame(good + bad + [(3, 0, "abc")], "page int, ord int, text string"), ["page"]).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_boxes(spark):
    rows = [(1, "", 0.0, None, None), (1, "word", 5.0, None, None), (2, "word", 0.0, None, None), (3, "word word", 5.0, None, None)]
    boxes = spark.createDataFrame(rows, "page int, text string, height double, arabic string, verse_key string")
    assert {r["page"]: r["has_issues"] for r in words.glyph_faults(boxes, ["page"]).collect()} == {1: False, 2: True, 3: False}
    kept, ghosts = words.real_boxes(spark.createDataFrame([("", None, None), ("", "كلمة", None), ("x", None, None)], "text string, arabic string, verse_key string"))
    assert kept.count() == 2 and ghosts.first()[0] == 1


def test_trees(spark):
    tree = json.dumps({"children": [{"block_type": "SectionHeader", "html": "<h1>A</h1>"}, {"block_type": "Page", "children": [{"block_type": "Text", "html": "<p>b</p>"}, {"block_type": "Zed", "html": "no"}]}]})
    got = words.tree_blocks(spark.createDataFrame([(1, tree), (2, '{"html": "only"}'), (3, "bad"), (4, None)], "id int, tree string")).orderBy("id", "block_seq").collect()
    assert [(r["id"], r["type"], r["text"]) for r in got] == [(1, "heading", "A"), (1, "paragraph", "b")]


def test_structural_links(spark):
    rows = [(w, lang, k, f"{lang}:u{k}", heading) for w, heads in (("p", ("الباب {}", "Chapter {}")), ("q", ("باب", "Part {}"))) for lang, text in zip(("ar", "en"), heads, strict=True) for k in range(2) for heading in [text.format(k + 1)]]
    got = {(r["work"], r["method"], r["confidence"]) for r in words.structural_links(spark.createDataFrame(rows, "work string, lang string, sequence int, id string, heading string")).collect()}
    assert got == {("p", "bilateral_structure_sequence", 0.92), ("q", "whole_book_unanchored", 0.2)}


def test_stale_corrections(spark):
    queue = spark.createDataFrame([("a",), ("b",)], "review_id string")
    fixes = spark.createDataFrame([("a",), ("a",), ("z",)], "review_id string")
    assert {tuple(r) for r in align.stale(queue, fixes).collect()} == {("z", "stale"), ("a", "duplicate")}


def test_urls(spark):
    urls = ["https://github.com/OpenITI/0505AH/blob/master/x.txt", "https://raw.githubusercontent.com/OpenITI/0505AH/master/x.txt", "http://github.com/OpenITI/a/blob/b", "https://github.com/Other/a/blob/b", "https://u@github.com/OpenITI/a/blob/b", "https://github.com:444/OpenITI/a/blob/b"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(sources.source_url(F.col("u"))).collect()]
    assert got == ["https://raw.githubusercontent.com/OpenITI/0505AH/master/x.txt", urls[1], None, None, None, None]


def test_structures(spark):
    text = "intro before\n\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n\nCHAPTER 1\n\nFirst one.\n\nSecond one here.\n\nCHAPTER 2\n\nCHAPTER 3\n\n[Footnote 1: note]\n\nThird one.\n\n*** END OF THE PROJECT GUTENBERG EBOOK X ***"
    got = sources.structures(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("structure", "sequence").collect()
    body = [(r["structure"], r["heading"], r["text"]) for r in got if "gutenberg_boilerplate" not in r["flags"]]
    assert (body[0][2], body[0][1]) == ("First one.", "CHAPTER 1")
    assert body[-1][1:] == ("CHAPTER 3", "Third one.")
    assert [r["flags"] for r in got if r["text"].startswith("[Footnote")] == [["exclude_from_alignment", "footnote"]]


def test_texts_and_maps(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "b.txt").write_bytes(b"x" * 100)
    assert [r["text"] for r in files.read_texts(spark, str(tmp_path), 50).collect()] == ["hello"]
    assert files.too_large(spark, str(tmp_path), 50).count() == 1
    book = tmp_path / "map" / "m.json"
    book.parent.mkdir()
    book.write_text(json.dumps({"pages": {"1": {"g": "كلمة", "h": {"arabic": "ب", "verse_key": "1:1", "word_position": 2}}}, "verses": {"1:1": "آية"}}))
    glyphs, verses = files.read_glyph_map(spark, str(book))
    assert {(r["glyph"], r["arabic"], r["verse_key"], r["position"]) for r in glyphs.collect()} == {("g", "كلمة", None, None), ("h", "ب", "1:1", 2)}
    assert [tuple(r) for r in verses.collect()] == [(0, "1:1", "آية")]
    files.write_glyphs(glyphs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("page = 1").count() == 2


def test_rows_must_be_objects(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    assert files.read_rows(spark, str(tmp_path / "g.jsonl"), "id string").count() == 2
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        files.read_rows(spark, str(tmp_path / "bad.jsonl"), "id string").collect()


def test_bundles(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "id int, text string")
    path = str(tmp_path / "bundle")
    first = files.write_bundle({"links": rows, "units": rows.select("id")}, "w1", path).collect()
    assert files.bundle_faults(spark, path, ["links", "units"]).count() == 0
    again = files.write_bundle({"links": rows.repartition(7), "units": rows.select("id")}, "w1", str(tmp_path / "again")).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    rows.limit(49).select(F.to_json(F.struct("id")).alias("value")).write.mode("overwrite").text(f"{path}/units")
    assert [tuple(r) for r in files.bundle_faults(spark, path, ["links", "units"]).collect()] == [("units", "row count")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        files.write_bundle({"links": rows}, "w1", path)


def test_extraction(spark):
    from codexa.plans import extract

    out = extract.extract(fx.BOXES.df(spark), fx.SPANS.df(spark), fx.GLYPHS.df(spark), 7)
    assert [r["text"] for r in out["words"].filter("page = 1").orderBy("word_no").collect()] == ["aṣ", "īb", "cß", "d¤"]
    assert out["stats"].first()["total_pages"] == 2
    assert out["markdown"].first()["doc_id"] == 7


def test_translation(spark, tmp_path):
    from codexa.plans import translate

    texts = spark.createDataFrame([("w", "ar", "قال في سنة ٤٣٧ كلاما\n\nثم قال"), ("w", "en", "In 437 he spoke.\n\nThen he said more here.")], "work string, lang string, text string")
    paragraphs = translate.paragraphs_of(texts)
    assert paragraphs.count() == 4
    out = translate.translate(paragraphs, corrections=spark.createDataFrame([("review:none", "accept", None, None, None)], "review_id string, action string, new_resolution string, new_ar array<string>, new_en array<string>"))
    assert [tuple(r) for r in out["faults"].collect()] == [("stale", 1)]
    assert out["links"].filter("array_contains(flags, 'hard_landmark')").count() == 1
    assert translate.save(out, "w", str(tmp_path / "b")).count() == 5
    assert files.bundle_faults(spark, str(tmp_path / "b"), ["links", "sentences", "recommended", "queue", "diagnostics"]).count() == 0


def test_a_long_work_is_many_groups(spark):
    """Landmarks cut a work into intervals, each a group of its own; numbers run through the work."""
    rows = [("w", lang, 0, "", k, text.format(k=k, mark=mark)) for k in range(60) for mark in [f" {1000 + k}" if k % 10 == 5 else ""] for lang, text in (("ar", "نص الفقرة{mark} كلمة"), ("en", "the text{mark} of it"))]
    found = align.links(spark.createDataFrame(rows, "work string, lang string, structure int, heading string, seq int, text string"))
    own = found.filter("level = 'paragraph'").orderBy("link").collect()
    assert {r["interval"] for r in own} == set(range(7))
    assert [r["link"] for r in own] == list(range(60))
    assert [(r["ar_ids"], r["en_ids"]) for r in own] == [([f"ar:u0000:p{k:04d}"], [f"en:u0000:p{k:04d}"]) for k in range(60)]


def test_vectors_score_paragraphs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(8, 16))
    rows = [("w", lang, k, "كلمة" if lang == "ar" else "word", (base[k] + rng.normal(size=16) * 0.05).tolist()) for lang in ("ar", "en") for k in range(8)]
    found = align.links(spark.createDataFrame(rows, "work string, lang string, seq int, text string, vector array<double>")).filter("level = 'paragraph'").orderBy("link").collect()
    assert [r["operation"] for r in found] == ["1-1"] * 8 and found[0]["waypoints"] >= 5


def test_unknown_gold_fails(spark):
    found = spark.createDataFrame([(w, 0, *rest) for w, *rest in fx.GOLD_LINKS], "work string, pair int, level string, link int, ar_ids array<string>, en_ids array<string>, ar_all array<string>, en_all array<string>")
    gold = spark.createDataFrame([("g1", "x", ["ar:u0000:p0000:s0000"], ["en:u0000:p0077:s0000"])], "work string, id string, ar_ids array<string>, en_ids array<string>")
    with pytest.raises(Exception, match="unknown sentence"):
        align.sentence_metrics(found, gold).collect()


def test_payloads_of_other_shapes_fail(spark):
    with pytest.raises(Exception, match="list of blocks"):
        sources.parsed_blocks(spark.createDataFrame([(1, '{"x": 1}')], "id int, payload string")).collect()


def test_elongations():
    from codexa.functions.alignment import elongations

    assert elongations("كتب") == [1, 2]
    assert elongations("دار") == [] and elongations("لا") == [] and elongations("abc") == []


def test_outputs(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# a\n\nb"), (2, None)], "doc_id int, markdown string")
    files.write_texts(docs, str(tmp_path / "md"))
    assert [p.name for p in (tmp_path / "md").iterdir() if p.is_dir()] == ["key=1"]
    files.write_json(docs, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_commands(spark, tmp_path, capsys):
    from codexa.__main__ import main

    assert main(["repair-text", "di|erent ß"]) == 0
    assert capsys.readouterr().out.strip() == "different ṣ"
    (tmp_path / "ar.txt").write_text("قال في سنة ٤٣٧ كلاما\n\nثم قال")
    (tmp_path / "en.txt").write_text("In 437 he spoke.\n\nThen he said more here.")
    assert main(["detect", str(tmp_path / "en.txt")]) == 0 and '"mojibake_count":0' in capsys.readouterr().out
    assert main(["classify", str(tmp_path / "ar.txt")]) == 0 and '"page_type":"scanned_arabic"' in capsys.readouterr().out
    assert main(["align", str(tmp_path / "ar.txt"), str(tmp_path / "en.txt"), "-o", str(tmp_path / "out")]) == 0
    assert '"paragraph_links":2' in capsys.readouterr().out
    assert main(["verify-alignment", str(tmp_path / "out")]) == 0
    assert main(["alignment-doctor", "--memory", "16", "--vectors"]) == 0 and '"profile":"thorough"' in capsys.readouterr().out
    assert main(["detect", str(tmp_path / "none.txt")]) == 2


def test_samples_take_damage_at_the_start(spark):
    docs = spark.createDataFrame([(1, "ßab¬"), (2, "ß"), (3, "ßßßßßßß"), (4, "ab"), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.sample): r.context for r in pages.samples(docs).collect()}
    assert [got[1, 0], got[1, 1], got[2, 0]] == ["['ß']ab¬", "ßab['¬']", "['ß']"]
    assert [got.get((3, k)) for k in range(6)] == ["ß" * k + "['ß']" + "ß" * (6 - k) for k in range(5)] + [None]
    assert len(got) == 8


def test_route_rounds_percent_as_sql(spark, tmp_path):
    from codexa.plans.queries import ORACLES, QUERIES

    sizes = [(n, c) for n in (1, 2, 3, 5, 7, 9) for c in (11, 40, 80, 160, 320, 400, 480, 533, 800, 960, 1000, 1120, 1440)]
    texts = [(k, "ß" * n + "a" * (c - n)) for k, (n, c) in enumerate(sizes)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = dict(con.execute(f"SELECT doc_id, reasons FROM ({ORACLES['route_documents']})").fetchall())
    assert {r.doc_id: r.reasons for r in QUERIES["route_documents"](spark, str(tmp_path)).collect()} == want


def test_measures_of_long_words_take_no_square_of_their_length(spark):
    """A word of 300,000 characters without Arabic took its square in steps."""
    texts = ["-" * 300_000, "a-" * 150_000 + "b", " a　bc\n" + "é" * 300_000 + "م  ", " \n", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.monotonic()
    got = [tuple(r)[1:] for r in pages.text_measures(docs).orderBy("doc_id").collect()]
    assert time.monotonic() - began < 30
    assert got == [(1, 0, 0, 0, 0, 300_000), (1, 0, 0, 0, 0, 300_001), (4, 1, 1, 1, 0, 300_006), *[(0,) * 6] * 3]


def test_token_summary_makes_no_list_of_words(spark):
    docs = spark.createDataFrame([(1, "a b\n\n c　\r\nd\n \n"), (2, " \n"), (3, None), (4, "x")], "doc_id long, text string")
    out = pages.token_summary(docs)
    plan = out._jdf.queryExecution().toString()
    assert "regexp_count" not in plan and "regexp_extract_all" not in plan
    assert sorted(map(tuple, out.collect())) == [(1, 4, 3, 4, 1_000_003), (4, 1, 1, 1, 1_000_000)]


def test_document_mojibake_moves_no_text(spark):
    rows = [(1, 0, 0, "aß"), (1, 0, 1, "�"), (1, 1, 0, "bc"), (2, 0, 0, None), (3, 0, 0, "x"), (3, 0, 1, None)]
    words = spark.createDataFrame(rows, "doc_id long, block_no int, word_no int, text string")
    out = pages.document_mojibake(words, ["doc_id"], ["block_no", "word_no"])
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert sorted(map(tuple, out.collect())) == [(1, True, 2, 2 / 7, 7), (2, False, 0, 0.0, 0), (3, False, 0, 0.0, 1)]


def test_markdown_goes_to_python_only_for_code_and_links(spark, monkeypatch):
    from codexa.functions import markup

    seen = []
    monkeypatch.setattr(layout.markup, "strip_markdown", lambda c: seen.append(c) or F.when(c.isNotNull(), F.lit("PYTHON")))
    docs = spark.createDataFrame([(1, "a *b* _c~\n\n**d**"), (2, "x `y`"), (3, "[l](u) z"), (4, "***")], "doc_id long, text string")
    assert [r.text for r in layout.from_markdown(docs).orderBy("doc_id", "block_seq").collect()] == ["a b c", "d", "PYTHON", "PYTHON"]
    given = spark.createDataFrame([("a *b*",), ("`c`",)], "raw string").select(seen[0].alias("given"))
    assert [r.given for r in given.collect()] == [None, "`c`"]
    assert [markup.plain_markdown(t) for t in ("a *b* _c~", "**d**", "***")] == ["a b c", "d", ""]
