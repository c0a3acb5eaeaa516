"""Scalar functions and the aligner against literal values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexa.functions import alignment as A
from codexa.functions import markup
from codexa.functions import text as X


def one(spark, f, *values):
    cols = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{c} string" for c in cols)
    return spark.createDataFrame([values], schema).select(f(*map(F.col, cols))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("o|ce", "offce"),
        ("di|erent", "different"),
        ("e|", "eff"),
        ("|table|", "|table|"),
        ("a | b", "a | b"),
        ("Shā\x7fʿīs", "Shāfiʿīs"),
        ("\x7fnancial", "financial"),
        ("ﬁn ﬂow ﬀ ﬃ ﬄ ﬅ ﬆ", "fin flow ff ffi ffl ft st"),
        ("a||b", "a||b"),
            ("gender-di|erentiated o|, o|.", "gender-differentiated off, off."),
        ("", ""),
        ("1 \x7f 2", "1 \x7f 2"),
    ],
)
def test_ligatures(spark, text, want):
    assert one(spark, X.expand_ligatures, text) == want


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (X.repair, "ßaß ¬ ¤", "ṣaṣ ī ḥ"),
        (X.orphan_rate, "بِسْمِ", 0.0),
        (X.orphan_rate, "َa ِ", 1.0),
        (X.orphan_rate, "abc", 0.0),
        (X.is_mostly_arabic, "سلام ok", True),
        (X.is_mostly_arabic, "  ", False),
        (X.collapse, " a \x1c b\n", "a b"),
        (X.tighten, "a , b !", "a, b!"),
        (X.arabic_skeleton, "القشيري abc", "lkshr"),
        (X.latin_skeleton, "al-Qushayrī", "lqshr"),
        (X.numbers, "٤٣٧ and 12, 12", ["12", "437"]),
        (X.has_double_honorifics, "ﷺ ﷺ", True),
        (X.fix_double_honorifics, "ﷺ (PBUH)", "ﷺ"),
        (X.entry_heading, "12 - x", "١٢ - x"),
        (X.looks_like_heading, "CHAPTER 3", True),
        (X.looks_like_heading, "an ordinary line of text", False),
        (X.looks_like_heading, "I went home yesterday", False),
        (X.looks_like_heading, "12 men came to the city", False),
        (X.looks_like_heading, "Ode to joy", True),
        (X.looks_like_heading, "3) next", True),
        (X.strip_markers, "forms12 x 12ms PageV01P002 +", "forms12 x"),
        (X.protect_ltr, "ربيعة (2) بن حارثة", "ربيعة \u2066(2)\u2069 بن حارثة"),
        (X.visual_order, "ربيعة \u2066(2)\u2069 بن حارثة\u0640", "ةثراح نب )2( ةعيبر"),
        (X.visual_order, "عَلِيّ", "يّلِعَ"),
        (X.numbers, "१२ ٣ x", ["12", "3"]),
        (X.usable, "NODATA", None),
        (X.work_id, "0505Ghazali.Ihya.Shamela-ara1", "0505Ghazali.Ihya"),
    ],
)
def test_scalars(spark, f, text, want):
    assert one(spark, f, text) == want


def test_similarity(spark):
    assert one(spark, markup.similarity, "abcd", "abxd") == pytest.approx(0.75)
    assert one(spark, markup.similarity, "ABC", "abc") == 1.0
    assert one(spark, markup.similarity, " ", "x") == 0.0


def test_nulls_do_not_fail(spark):
    for f in (X.repair, X.expand_ligatures, X.collapse, X.arabic_skeleton, X.orphan_rate, X.numbers, X.is_arabic, X.has_mojibake, X.show_honorifics):
        one(spark, f, None)


def test_markup(spark):
    assert markup.plain_html("<p>a &amp; b</p><script>x</script><br>c .") == "a & b x c ."
    assert markup.plain_markdown("**a** [b](c(d)) ![e](f) `g_h` ```x``` i") == "a b g_h i"
    assert markup.normal("  Ａl-ﬁ, أَحمد ") == "alfi احمد"
    assert one(spark, markup.html_to_text, "<td>a</td><td>b</td>") == "a b"


def test_sentences():
    assert A.english_sentences("Dr. Who came. He left! then 5.5 more? Yes") == ["Dr. Who came.", "He left! then 5.5 more?", "Yes"]
    assert A.arabic_sentences("قال نعم. ثم ذهب؟ نعم") == ["قال نعم.", "ثم ذهب؟", "نعم"]
    long = " ".join(["كلمة"] * 50) + "، " + " ".join(["كلمة"] * 10) + "، آخر"
    assert [len(s.split()) for s in A.arabic_sentences(long)] == [50, 11]


def test_known_confidences():
    assert A.align(["كلمة"], ["word"])[0]["confidence"] == pytest.approx(0.475)
    assert A.align(["كلمة ١٢"], ["word 12"])[0]["confidence"] == pytest.approx(0.63125)
    assert A.align(["a"] * 3, ["b"] * 3, most_cells=1) is None
    assert [x["op"] for x in A.align(["a"], [])] == ["1-0"]


def test_path_covers_both_sides_in_order():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, e = ([" ".join(["w"] * int(k)) for k in rng.integers(1, 9, rng.integers(1, 8))] for _ in range(2))
        path = A.align(a, e, A.PARAGRAPH_MOVES)
        assert [x["a0"] for x in path[1:]] == [x["a1"] for x in path[:-1]]
        assert [x["e0"] for x in path[1:]] == [x["e1"] for x in path[:-1]]
        assert (path[0]["a0"], path[0]["e0"], path[-1]["a1"], path[-1]["e1"]) == (0, 0, len(a), len(e))


def test_monotone_chain_is_the_heaviest():
    rng = np.random.default_rng(1)
    for _ in range(30):
        points = [(int(x), int(y), int(w)) for x, y, w in rng.integers(1, 7, (7, 3))]
        best = 0
        for mask in range(1 << len(points)):
            own = sorted(p for k, p in enumerate(points) if mask >> k & 1)
            if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(own, own[1:], strict=False)):
                best = max(best, sum(p[2] for p in own))
        assert sum(p[2] for p in A.monotone(points)) == best


def test_waypoint_cost():
    points = [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]
    assert float(A.position_cost(np.array([[2.0]]), np.array([[2.0]]), points)[0, 0]) == 0
    assert float(A.position_cost(np.array([[2.0]]), np.array([[3.5]]), points)[0, 0]) == 1.5
    assert float(A.position_cost(np.array([[9.0]]), np.array([[3.5]]), points)[0, 0]) == 0


def test_line_counts_have_no_lone_lines():
    assert A.balanced_counts(5, 3, 40) == [3, 2] and A.balanced_counts(4, 3, 40) == [0, 4]
    assert A.balanced_counts(41, 40, 40) == [39, 2] and A.balanced_counts(44, 2, 40) == [0, 40, 4]
    assert A.balanced_counts(32, 30, 30, after=6) == [26, 6]
    assert A.balanced_counts(10, 20, 20) == [10]
    for n in range(3, 60):
        counts = A.balanced_counts(n, 5, 20)
        assert sum(counts) == n
        assert all(c != 1 for c in counts)


def test_best_steps_are_those_of_every_cell():
    """Rows filled by whole moves give the path that a search of each cell gives."""
    rng = np.random.default_rng(3)
    for moves in (A.PARAGRAPH_MOVES, A.SENTENCE_MOVES):
        for _ in range(15):
            n, m = (int(x) for x in rng.integers(1, 9, 2))
            scores = {(a, e): rng.integers(-3, 4, (n - a + 1, m - e + 1)) / 4 for a, e in moves if a and e and a <= n and e <= m}
            rank = sorted(range(len(moves)), key=lambda k: (-moves[k][0], -moves[k][1], k))
            best, want = {(0, 0): 0.0}, np.full((n + 1, m + 1), -1)
            for i in range(n + 1):
                for j in range(m + 1):
                    for k in rank:
                        a, e = moves[k]
                        if (i - a, j - e) in best and (a or e):
                            value = best[i - a, j - e] + (scores[a, e][i - a, j - e] if a and e else -1.1)
                            if value > best.get((i, j), -np.inf):
                                best[i, j], want[i, j] = value, k
            assert (A.best_steps(n, m, moves, scores, 1.1) == want).all()


def test_landmarks_from_the_index_are_those_of_all_pairs():
    rng = np.random.default_rng(8)
    names = [("القشيري", "Qushayri"), ("الغزالي", "Ghazali"), ("بغداد", "Baghdad"), ("خالد", "Khalid")]
    for _ in range(30):
        arabic, english = [], []
        for side, out in ((0, arabic), (1, english)):
            for _ in range(int(rng.integers(1, 7))):
                own = [names[k][side] for k in rng.integers(0, 4, int(rng.integers(0, 3)))] + [str(x) for x in rng.integers(10, 16, int(rng.integers(0, 2)))]
                out.append(("قال " if not side else "he saw ") + " ثم ".join(own) if not side else "he saw " + " and ".join(own))
        a, e = A.Side(arabic, True), A.Side(english, False)
        count = lambda s: {x: sum(x in own for own in s.numbers) for own in s.numbers for x in own}
        ca, ce = count(a), count(e)
        anchors = [set(A.name_skeletons(u, strict=True)) for u in english]
        found = {}
        for j in range(e.n):
            scored = []
            for i in range(a.n):
                shared, numbers, _ = A.shared_evidence(arabic[i], english[j])
                unique = [x for x in numbers if ca[x] == 1 and ce[x] == 1]
                rare = [n for n in shared if 1 <= sum(n in own for own in anchors) <= 2]
                mass = sum(map(len, rare))
                if unique or (len(rare) >= 2 and mass >= 7):
                    scored.append((mass + (20 + 6 * len(unique) if unique else 0), i, [f"number:{x}" for x in unique] + [f"name:{n}" for n in rare]))
            scored.sort(key=lambda x: x[:2], reverse=True)
            if scored and (any(m.startswith("number") for m in scored[0][2]) or scored[0][0] - (scored[1][0] if len(scored) > 1 else 0) >= 3):
                score, i, marks = scored[0]
                if i not in found or score > found[i][2]:
                    found[i] = (i, j, score, marks)
        assert A.landmarks(a, e) == A.monotone(list(found.values()))


def test_html_reference_cut_off_is_text(spark):
    cut = lambda end: f"<title>a {end}</title><style>p{{margin:0}}</style><p>x &amp; y&nbsp;&#39;z&#39; &lt;b&gt; &notit; &amp;lt;</p>"
    rest = "p{margin:0} x & y 'z' <b> &notit; &lt;"
    for end in ("&", "&a", "&am", "&amp", "&l", "&lt", "&quot", "&#3", "&#39"):
        assert one(spark, lambda c: markup.html_to_text(c, closed=True), cut(end)) == f"a {end}{rest}"


def test_characters_are_counted_without_lists(spark):
    text = "ab é\U0001d400\U0001d401 مx��" * 3
    assert one(spark, lambda c: X.characters(c, r"[\x{10000}-\x{10ffff}a-b]"), text) == 12
    plan = spark.createDataFrame([("a",)], "c string").select(X.has_mojibake(F.col("c")))._jdf.queryExecution().toString()
    assert "regexp_count" not in plan and "regexp_extract_all" not in plan
    assert [one(spark, X.has_double_honorifics, t) for t in ("ﷺ x ﷺﷺ", "ﷺ (saw)", "ﷺ" + "x" * 40 + "(saw)", "(saw)", None)] == [True, True, False, False, None]


def test_english_sentences_without_python(spark):
    from codexa.functions.alignment import english_sentences

    bits = ["Mr.", "St. X", "e.g.", "E.G.", "i.E. A", "x.", "A!", '?"', "”", " ", "\n", "a", "B", "...", "‘C", '"', "no. D", "Ⅳ", "é.É", "(vol.", "1.2", "　", "xMr. Z"]
    rng = np.random.default_rng(3)
    texts = ["", "  ", "no end", "... Mr. Smith came. He left!"] + ["".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", markup.sentences(F.col("t"), "en").alias("s"))
    assert "PythonUDF" not in df._jdf.queryExecution().toString() and "ArrowEval" not in df._jdf.queryExecution().toString()
    assert [(r.t, r.s) for r in df.orderBy("i").collect()] == [(t, [s for s in english_sentences(t)]) for t in texts]


def test_headings_are_counted_by_runs(spark):
    plan = spark.createDataFrame([("a",)], "c string").select(X.looks_like_heading(F.col("c")))._jdf.queryExecution().toString()
    assert "regexp_count" not in plan and "regexp_extract_all" not in plan
    assert [one(spark, X.looks_like_heading, t) for t in ("CHAPTER", "ÉA Bc", "ABCDEFGH i", "A" * 141, "1.", "", "chapter one")] == [True, False, True, False, True, False, True]
