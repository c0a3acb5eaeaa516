"""Small literal tables, the same rows as a Spark DataFrame and as DuckDB VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TYPES = {"int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def quoted(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


class Fixture:
    """Named rows with a schema of simple types."""

    def __init__(self, schema: str, rows: list[tuple]) -> None:
        self.schema, self.rows = schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        names, kinds = zip(*(c.strip().split(" ") for c in self.schema.split(",")), strict=True)
        body = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in self.rows)
        casts = ", ".join(f"CAST({n} AS {TYPES[k]}) AS {n}" for n, k in zip(names, kinds, strict=True))
        return f"(SELECT {casts} FROM (VALUES {body}) AS t({', '.join(names)}))"


TEXTS = Fixture(
    "id int, text string, other string",
    [
        (1, "قال رسول الله ﷺ إنما الأعمال بالنيات", "The Messenger said: actions are by intentions"),
        (2, "بِسْمِ اللَّهِ الرَّحْمَٰنِ", "In the name of God"),
        (3, "Shaykh al-Qushayri wrote 12 chapters", "كتب القشيري ١٢ فصلا"),
        (4, "ْword َanother", "mixed"),
        (5, "ab ﷻ c", "PBUH (saw) x"),
        (6, "", "empty"),
        (7, "plain ASCII text , with . spaces !", "plain"),
        (8, "ﷺ ﷺ twice (pbuh) ﷺ", "SAW ﷺ"),
        (9, "", "glyphs"),
        (10, "مدرسة الحكمة أحمد إلى", "Madrasat al-Hikma"),
        (11, "o|ce di|erent e|ect |table| Shā\x7fʿīs", "marks"),
        (12, "٣٤٥ and 17 and 17", "345 17"),
    ],
)
FONTS = Fixture("id int, font string", [(1, "QCF_P001"), (2, "QCF_P604"), (3, "KFGQPC"), (4, "SabondiexPlain"), (5, "SabondiacriticRoman"), (6, "Times"), (7, "X_12a"), (8, "P1234")])
PAGES = Fixture(
    "page int, words int, arabic int, english int, pua int, fonts boolean, image double, present boolean",
    [(1, 200, 0, 190, 0, False, 0.0, True), (2, 200, 30, 150, 0, False, 0.0, True), (3, 5, 4, 0, 0, False, 0.1, True), (4, 5, 0, 3, 0, False, 0.9, True), (5, 0, 0, 0, 0, False, 0.0, False), (6, 50, 0, 0, 3, False, 0.0, True), (7, 50, 0, 40, 0, True, 0.0, True), (8, 10, 1, 9, 0, False, 0.0, True)],
)
SPANS = Fixture("page int, span_no int, x0 double, y0 double, x1 double, y1 double, font string", [(1, 0, 0.0, 0.0, 50.0, 10.0, "SabondiexPlain"), (1, 1, 40.0, 0.0, 90.0, 10.0, "SabondiacriticRoman"), (1, 2, 0.0, 50.0, 30.0, 60.0, "Times"), (2, 0, 0.0, 0.0, 20.0, 10.0, "QCF_P002")])
BOXES = Fixture("page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string", [(1, 0, 0.0, 1.0, 20.0, 9.0, "aß"), (1, 1, 42.0, 1.0, 60.0, 9.0, "¬b"), (1, 2, 0.0, 51.0, 20.0, 59.0, "cß"), (1, 3, 91.5, 1.0, 99.0, 9.0, "d¤"), (2, 0, 0.0, 0.0, 10.0, 8.0, "ße")])
GLYPHS = Fixture("page int, glyph string, arabic string, verse_key string, position int", [(1, "ﱁ", "بسم", "1:1", 1), (1, "ﱂ", "الله", "1:1", 2), (2, "ﱁ", "الم", "2:1", 1), (2, "ﱃ", "ذلك", "2:2", 1)])
GLYPH_TEXTS = Fixture("id int, page int, text string", [(1, 1, "ﱁ ﱂ"), (2, 2, "ﱁﱃx"), (3, 1, "ﲙ"), (4, 2, "abc")])
VERSES = Fixture("ord int, verse_key string, arabic string", [(1, "1:1", "بسم الله الرحمن الرحيم"), (2, "1:2", "الحمد لله رب العالمين"), (3, "2:1", "الم")])
VERSE_TEXTS = Fixture("id int, text string", [(1, "بِسْمِ الله"), (2, "الحمد لله رب العالمين"), (3, "الم ذلك"), (4, "غير موجود")])
BLOCKS = Fixture(
    "ord int, kind string, text string, volume int, page int",
    [(1, "title", "كتاب", None, None), (2, "pageNumber", None, 1, 1), (3, "paragraph", "نص أول", None, None), (4, "pageNumber", None, 1, 218), (5, "header-1", "باب", None, None), (6, "verse", "بيت أول // بيت ثان", None, None), (7, "blockquote", "English quote", None, None), (8, "blockquote", "اقتباس", None, None), (9, "pageNumber", None, 2, 219), (10, "year_of_death", "505", None, None), (11, "category", "قسم", None, None)],
)
SOURCE_LINES = Fixture(
    "ord int, line string",
    [
        (1, "بسم الله الرحمن الرحيم"),
        (2, "$RWY$ حدثنا فلان @MATN@ قال كذا @HUKM@ صحيح"),
        (3, "شطر أول %~% شطر ثان"),
        (4, "الحمد لله رب العالمين والصلاة"),
        (5, "........"),
        (6, "قال ﴿ألم﴾"),
        (7, "نص PageV01P002 بعده ms12 ثم Milestone300"),
        (8, "متن $ عنوان $ بقية + قلت هذا تعليق"),
        (9, "#META# 010.AuthorNAME :: Ghazali"),
        (10, "#META# 020.BookTITLE :: NODATA"),
    ],
)
CATALOGUE = Fixture("book string, version string, id string, status string, url string", [("0505Ghazali.Ihya", "0505Ghazali.Ihya.A", "A", "sec", "u2"), ("0505Ghazali.Ihya", "0505Ghazali.Ihya.B", "B", "pri", "u1"), ("0911X.Y", "0911X.Y.C", "C", "pri", "u3")])
PARAGRAPHS = Fixture(
    "work string, lang string, structure int, heading string, seq int, text string",
    [
        ("w1", "ar", 0, "", 0, "قال القشيري في سنة ٤٣٧ كلاما طويلا عن الصبر والشكر"),
        ("w1", "ar", 0, "", 1, "ثم ذكر الغزالي والقاضي حديثا آخر"),
        ("w1", "ar", 0, "", 2, "وفي الباب ١٢ مسائل كثيرة"),
        ("w1", "ar", 0, "", 3, "خاتمة الكتاب"),
        ("w1", "en", 0, "", 0, "In the year 437 Qushayri spoke at length about patience and gratitude."),
        ("w1", "en", 0, "", 1, "Then he told another report of Ghazali and the Qadi."),
        ("w1", "en", 0, "", 2, "Chapter 12 has many questions."),
        ("w1", "en", 0, "", 3, "The end of the book."),
        ("w2", "ar", 0, "", 0, "فصل"),
        ("w2", "en", 0, "", 0, "A section without any landmark."),
        ("w2", "en", 0, "", 1, "An addition."),
        ("w3", "ar", 0, "", 0, "واحد"),
        ("w4", "ar", 0, "الباب ١", 0, "ألف"),
        ("w4", "ar", 1, "الباب ٢", 0, "بلغ الفتى ٢١ عاما ثم خرج إلى المدينة."),
        ("w4", "en", 0, "Chapter 1", 0, "A"),
        ("w4", "en", 1, "Chapter 2", 0, "The youth reached 21 years, then left for the city."),
        ("w5", "ar", 0, "", 0, "رأى الفتى النار المضيئة واقترب منها."),
        ("w5", "ar", 0, "", 1, "ثم عاد إلى مأواه في الليل."),
        ("w5", "en", 0, "", 0, "The youth saw the bright fire and approached it."),
        ("w5", "en", 0, "", 1, "He returned home at night."),
    ],
)
EDITS = Fixture(
    "id int, s string, t string",
    [(1, "ABC", "abc"), (2, "kitten", "sitting"), (3, "al-Qushayrī!", "AlQushayrī"), (4, "", "x"), (5, "...", "x"), (6, "مَدْرَسَة", "مدرسه"), (7, "أحمد", "احمد"), (8, "ﬁne", "fine"), (9, "abcd", "efgh"), (10, "a​b", "ab")],
)
BIDI = Fixture(
    "id int, text string",
    [(1, "ربيعة (2) بن حارثة"), (2, "ربيعة ⁦(2)⁩ بن حارثةـ"), (3, "عَلِيّ"), (4, "Ibn Khallikan"), (5, "12 - إبراهيم النخعي"), (6, "7- a 8 - b"), (7, ""), (8, "page 3: a/b_c (x)")],
)
NAMES = Fixture("name string, value string", [("/a/b/0505Ghazali.Ihya.Shamela-ara1", " 12 "), ("single", "x1"), ("0911X.Y", "-3"), ("d/e.f", ""), ("h.", "1.5"), ("x/y/z", "007")])
SENTENCES = Fixture(
    "id int, lang string, text string",
    [
        (1, "en", "He met Mr. Smith. \"Yes,\" he said. then left. See i.e. this! \"Quote.\" End"),
        (2, "en", "Dr. Ali ibn al-Qushayri came to Baghdad. Thaqif fought. ISLAM spread; Ghazali wrote."),
        (3, "en", "No stop here"),
        (4, "en", "The Island contained trees. Abu Khalid and Da'ud saw Qadi-Dhahabi?! Then 'Abd Allah left"),
        (5, "ar", "قال كذا. ثم خرج؟ نعم! انتهى"),
        (6, "ar", " ".join(["كلمة"] * 30) + "، " + " ".join(["لفظ"] * 30) + "؛ ذيل قصير."),
        (7, "ar", ""),
        (8, "en", "  "),
    ],
)
EVIDENCE = Fixture("id int, ar string, en string", [(1, "الباب ١", "Chapter 1"), (2, "قال القشيري في سنة ٤٣٧", "In the year 437 Qushayri spoke"), (3, "هذه جزيرة واسعة", "The Island was wide"), (4, "", "x"), (5, "ذهب إلى مكة", "He went with Ghazali")])
LINES = Fixture("id int, n int, first int, full int, after int", [(1, 5, 3, 40, 2), (2, 4, 3, 40, 2), (3, 41, 40, 40, 2), (4, 44, 2, 40, 2), (5, 32, 30, 30, 6), (6, 0, 5, 40, 2), (7, 7, 9, 40, 2), (8, 9, 4, 0, 2), (9, 5, 1, 2, 2), (10, 90, 30, 40, 2)])
WORDS = Fixture("id int, text string, gap double", [(1, "بيت", 2.5), (2, "سلام", 4.0), (3, "عَلِيّ كتب", 5.0), (4, "دار", 9.0), (5, "Latin word", 9.0), (6, "مكتبة كبيرة", 2.0), (7, "نص", 30.0)])
LAYOUTS = Fixture(
    "page int, payload string",
    [
        (1, '{"blocks": [{"type": 0, "lines": [{"spans": [{"text": "ﱁﱂ", "font": "QCF_P002", "size": 12.5, "bbox": [1.0, 2.0, 30.0, 14.0]}, {"text": "plain", "font": "QCF_P002", "size": 9.0, "bbox": [1, 2, 3, 4]}]}]}, {"type": 1, "lines": [{"spans": [{"text": "ﱁ", "font": "QCF_P003", "size": 1.0, "bbox": [0, 0, 1, 1]}]}]}]}'),
        (2, '{"blocks": [{"type": 0, "lines": [{"spans": [{"text": "aß", "font": "SabondiexPlain", "size": 10.0, "bbox": [5.0, 6.0, 7.0, 8.0]}]}, {"spans": [{"text": "x ﱁ", "font": "kfgqpc_P12", "size": 8.0}]}]}]}'),
        (3, '{"blocks": []}'),
        (4, "not json"),
    ],
)
GHOSTS = Fixture(
    "page int, word_no int, text string, arabic string, verse_key string, y0 double, y1 double",
    [(1, 0, "word", None, None, 0.0, 9.0), (1, 1, "", None, None, 0.0, 9.0), (1, 2, "ﷺ", None, None, 0.0, 9.0), (1, 3, "ﱁ", "بسم", None, 0.0, 9.0), (1, 4, "ﱁ", None, None, 0.0, 9.0), (2, 0, "flat", None, None, 5.0, 5.0), (2, 1, "flat", None, None, 5.0, 5.05), (2, 2, "tall", None, None, 5.0, 9.0), (3, 0, "plain text", None, None, 0.0, 9.0)],
)
LOOSE = Fixture(
    "text string, spoken_text string, role string, block_no long, x double, y double, bx double, by double, page int, is_word_continuation boolean",
    [("a", None, None, None, 1.0, 2.0, None, None, None, None), ("b", "bee", "quran", 7, 1.0, 2.0, 3.0, 4.0, 9, True), (None, None, None, None, None, None, None, None, None, None)],
)
MARKDOWN = Fixture(
    "id int, text string",
    [
        (1, "#Title *here*\nline **one**\nline two\n\n> قال النبي\n>English quote\n```\n# code\n```\nafter"),
        (2, "text\n```\nskipped\n```\nmore [label](url(x)) and ![image](y) `co*de`"),
        (3, "####### deep\n- item _a_\n  > quoted"),
        (4, ""),
        (5, "**spans\nlines** [a] (b)"),
    ],
)
HTML = Fixture(
    "id int, html string",
    [(1, "<p>One <b>two</b></p><p>three &amp; four .</p>"), (2, "a<br>b<div>c</div><script>var x = 1;</script><!-- gone -->d"), (3, "&amp;lt;tag&amp;gt; &nbsp; x"), (4, "<ul><li>x</li><li>y</li></ul><span>z</span>w"), (5, ""), (6, "plain , text")],
)
FIGURE_BLOCKS = Fixture("doc_id long, block_seq int, page int, mean_y double, type string, text string", [(1, 1, 1, 10.0, "paragraph", "first"), (1, 2, 1, 50.0, "paragraph", "second"), (1, 3, 2, None, "heading", "third")])
FIGURES = Fixture(
    "doc_id long, fig int, page int, y double, kind string, label string, caption string, description string",
    [(1, 0, 1, 10.0, "chart", "Fig. 1", "A caption", "More."), (1, 1, 1, 20.0, "photo", None, None, "Only described"), (1, 2, None, None, "table", "T", "Same", "Same"), (2, 0, 3, 1.0, "map", "M", "", "")],
)
RENDER = Fixture(
    "id int, type string, text string, verse_key string, hadith_ref string, dominant_role string",
    [
        (1, "heading", "Title", None, None, "body"),
        (2, "verse", "نص", "2:255", None, "quran"),
        (3, "verse", "نص", None, None, None),
        (4, "basmala", "بسم الله", None, None, None),
        (5, "footnote", "note", None, None, "body"),
        (6, "isnad", "chain", None, None, "body"),
        (7, "matn", "text", None, None, "body"),
        (8, "paragraph", "recited", "1:1", None, "quran_arabic"),
        (9, "paragraph", "told", None, "Bukhari 1", "hadith"),
        (10, "paragraph", "plain", None, None, "body"),
        (11, "paragraph", "  ", None, None, "body"),
    ],
)
STRUCTURED = Fixture(
    "id int, tree string, markdown string, plain string",
    [
        (1, '[{"block_type": "Page", "children": [{"block_type": "SectionHeader", "html": "<h1>Head</h1>"}, {"block_type": "Text", "text": "body  text"}, {"block_type": "Equation", "html": "x = 1"}, {"block_type": "Picture", "html": "ignored"}]}]', "# other", "other"),
        (2, '{"children": []}', "# Head\n\ntext", "other"),
        (3, None, "  ", " only plain \n"),
        (4, None, None, ""),
        (5, '{"block_type": "Page", "text": "loose", "children": [{"block_type": "Picture", "html": "<p>alt</p>"}]}', "md", "p"),
    ],
)
POSITIONED = Fixture(
    "doc_id long, page int, block_no long, line_no int, word_no int, text string, spoken_text string, role string, section_type string, verse_key string, hadith_ref string, y double, height double, is_word_continuation boolean",
    [
        (1, None, 1000001, 0, 0, "Head", None, "body", "header", None, None, 10.0, 10.0, False),
        (1, None, 1000001, 0, 1, "آية", None, "quran", "body", "1:1", None, 20.0, 10.0, False),
        (1, None, 1000001, 0, 2, "ثانية", None, "quran", "body", "1:2", None, 20.0, 10.0, False),
        (1, None, 1000002, 0, 3, "told", "spoken", "hadith", "body", None, "B1", 30.0, 10.0, False),
        (1, None, 1000002, 0, 4, "more", None, "hadith", "body", None, "B1", 30.0, 10.0, True),
        (1, None, 1000002, 0, 5, "other", None, "hadith", "body", None, "B2", 30.0, 10.0, False),
        (1, None, 1000003, 0, 6, "para", None, "body", "body", None, None, 40.0, 10.0, False),
        (1, None, 1000003, 0, 7, "next", None, "body", "body", None, None, 56.0, 10.0, False),
        (1, None, 2000000, 0, 8, "page", None, "body", "body", None, None, 57.0, None, False),
        (2, 7, 1, 0, 0, "b", None, None, None, None, None, None, None, False),
        (2, 7, 1, 0, 1, "c", None, None, None, None, None, None, None, False),
    ],
)
PAYLOADS = Fixture(
    "id int, payload string",
    [
        (1, '{"metadata": {"title": "t"}, "content": [{"type": "title", "content": "كتاب"}, {"type": "pageNumber", "content": {"volume": "1", "page": " 12 "}}, {"type": "verse", "content": ["بيت أول", " ", "بيت ثان"]}, {"type": "year", "content": 505}, {"type": "pageNumber", "content": "bad"}, {"type": "blockquote", "content": {"a": "x", "b": ["y", null]}}, {"type": "age", "content": ""}, {"type": "pageNumber", "content": {"page": "x"}}, {"type": "odd", "content": "rest"}, 5]}'),
        (2, '[{"type": "header-2", "content": "باب"}, {"type": "blockquote", "content": "اقتباس"}]'),
        (3, '{"blocks": [{"type": "paragraph", "content": "p"}, {"type": "pageNumber", "content": {"volume": 2, "page": 3}}, {"type": "year_of_birth", "content": "450"}, {"type": "paragraph", "content": "q"}]}'),
    ],
)
SECTIONS = Fixture(
    "id int, payload string",
    [
        (1, '{"content": [{"volume": 1, "page": 5, "blocks": [{"type": "title", "content": "عنوان"}, {"type": "header", "level": 3, "content": "باب"}, {"type": "header", "level": 9, "content": "عميق"}, {"type": "verse", "content": ["شطر", "آخر"]}, {"type": "verse", "content": "سطر"}, {"type": "category", "content": "صنف"}]}, {"page": 6, "blocks": [{"type": "paragraph", "content": "نص PageV01P007 بقية $ عنوان فرعي + باق"}, {"type": "paragraph", "content": "متن + قلت تعليق + زيادة"}, {"type": "paragraph", "content": "## "}, {"type": "paragraph", "content": "سيرة ms12", "extraContext": "man_biography"}, {"type": "blockquote", "content": "قال ﴿ألم﴾"}, {"type": "paragraph", "content": "ms5"}]}]}'),
    ],
)
URLS = Fixture(
    "id int, url string",
    [
        (1, "https://github.com/OpenITI/0575AH/blob/master/data/book/version-ara1"),
        (2, "http://github.com/OpenITI/0575AH/blob/master/file"),
        (3, "https://example.com/OpenITI/file"),
        (4, "https://raw.githubusercontent.com/someone-else/repo/master/file"),
        (5, "https://GitHub.com:443/openiti/repo/blob/main/x?token=1#f"),
        (6, "https://user@github.com/OpenITI/r/blob/main/x"),
        (7, "https://github.com:8443/OpenITI/r/blob/main/x"),
        (8, "https://github.com/OpenITI/r/tree/main/x"),
        (9, "https://github.com/OpenITI/r/blob/main"),
        (10, "https://raw.githubusercontent.com/OpenITI/r/main/x?y#z"),
        (11, "HTTPS://RAW.GithubUserContent.com/openiti/r/x"),
        (12, None),
        (13, "https://github.com//OpenITI/r/blob/main/x"),
    ],
)
BOOKS = Fixture(
    "id int, text string",
    [
        (1, "CHAPTER 1\n\nThe first passage.\n\nCHAPTER 2\n\nThe second passage."),
        (2, "License preface.\n\n*** START OF THE PROJECT GUTENBERG EBOOK DEMO ***\n\nCHAPTER 1\n\nThe translated body.\n\n[Footnote 1: An editorial note.]\n\n*** END OF THE PROJECT GUTENBERG EBOOK DEMO ***\n\nLicense footer.\n"),
        (3, "A complete English paragraph."),
        (4, "I went home yesterday\n \t\n12 men came to the city\n\nOde to joy\n\n3) next\n\nIV. of things\n\nlast words"),
        (5, "PART ONE\n\nBOOK II"),
        (6, " \n\n "),
        (7, "not *** START OF PROJECT GUTENBERG\n\nShort OF MOSTLY CAPITALS"),
    ],
)
GOLD_LINKS = [
    ("g1", "paragraph", 0, ["ar:u0000:p0000"], ["en:u0000:p0000"], ["ar:u0000:p0000:s0000", "ar:u0000:p0000:s0001"], ["en:u0000:p0000:s0000", "en:u0000:p0000:s0001"]),
    ("g1", "paragraph", 1, ["ar:u0000:p0001"], ["en:u0000:p0001"], ["ar:u0000:p0001:s0000", "ar:u0000:p0001:s0001"], ["en:u0000:p0001:s0000", "en:u0000:p0001:s0001"]),
    ("g1", "sentence", 0, ["ar:u0000:p0000:s0000"], ["en:u0000:p0000:s0000"], [], []),
    ("g1", "sentence", 1, ["ar:u0000:p0000:s0001"], ["en:u0000:p0000:s0001"], [], []),
    ("g1", "sentence", 2, ["ar:u0000:p0001:s0000"], ["en:u0000:p0001:s0001"], [], []),
]
GOLD_ROWS = [
    ("g1", "exact", ["ar:u0000:p0000:s0000"], ["en:u0000:p0000:s0000"]),
    ("g1", "near", ["ar:u0000:p0000:s0001"], ["en:u0000:p0001:s0000"]),
    ("g1", "within", ["ar:u0000:p0001:s0000"], ["en:u0000:p0001:s0000"]),
    ("g1", "none", ["ar:u0000:p0001:s0001"], ["en:u0000:p0001:s0001"]),
]
REGIONS = Fixture(
    "work string, region string, arabic string, english string",
    [
        ("w5", "fire", "رأى الفتى النار المضيئة واقترب منها.", "The youth saw the bright fire and approached it."),
        ("w5", "both", "رأى الفتى النار المضيئة واقترب منها. ثم عاد إلى مأواه في الليل.", "The youth saw the bright fire and approached it. He returned home at night."),
        ("w5", "lost", "لا وجود لهذا النص هنا أبدا", "The youth saw the bright fire and approached it."),
        ("w1", "end", "خاتمة الكتاب", "The end of the book."),
    ],
)
MACHINES = [(1, 4.0, True, [], False), (2, 10.0, True, ["nomic-embed-text"], True), (3, 16.0, True, ["qwen3:4b", "x"], True), (4, None, True, ["llama3"], True), (5, 64.0, False, [], False), (6, 12.0, True, ["Gemma-embed"], True), (7, 0.0, True, [], False)]
