"""Scalar text functions as Catalyst expressions: a Column in, a Column out.

Character classes are spelled out, because Java's ``\\w``, ``\\d`` and ``\\s`` are ASCII-only.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexa.functions.alignment import CONSONANTS

# -- character classes and tables (fixed values) -------------------------------------------
DIACRITICS = "".join(map(chr, [*range(0x064B, 0x0659), 0x0670]))
AR = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}"
AR_WIDE = AR + r"\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
PUA = r"\x{E000}-\x{F8FF}"
GLYPHS = r"\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}" + PUA
PRESENTATION = PUA + r"\x{FB50}-\x{FDEF}\x{FE70}-\x{FEFC}"
LATINISH = r"a-zA-Z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}\x{02BE}\x{02BF}\x{2018}\x{2019}'"
WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = r"[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MOJIBAKE = "\ufffdß¬¤"
REPAIRS = ("ß¬¤", "ṣīḥ")
FONT_PREFIXES = ("Sabondiex", "Sabondiacritic")
LIGATURES = {"ĳ": "ij", "Ĳ": "IJ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
#: Honorific symbols in their order of replacement: (symbol, shown form, abbreviation).
HONORIFICS = [
    ("", "ﷺ", "SAW"),
    ("", "ﷻ", "SWT"),
    ("", "عليه السلام", "AS"),
    ("", "رضي الله عنه", "RA"),
    ("", "ﷺ", "SAW"),
    ("", "ﷺ", "SAW"),
    ("", " ", ""),
    ("ﷺ", "ﷺ", "SAW"),
    ("﵆", "ﷺ", "SAW"),
    ("ﷻ", "ﷻ", "SWT"),
]
#: Vowelled spoken forms and the tokens that stand for them, in their order of replacement.
SAY_SAW, SAY_SWT = "صَلَّى اللهُ عَلَيْهِ وَسَلَّمَ", "سُبْحَانَهُ وَتَعَالَى"
SAY_AS, SAY_RA = "عَلَيْهِ السَّلَامُ", "رَضِيَ اللهُ عَنْهُ"
SAY_TOKENS = [
    *[("ﷺ", SAY_SAW), ("﵆", "صَلَّى اللهُ عَلَيْهِ وَآلِهِ وَسَلَّمَ")],
    *[(t, SAY_SAW) for t in ("", "", "", "PBUH", "pbuh", "(s)", "(S)", "(saw)", "(SAW)", "(PBUH)", "(pbuh)")],
    *[(t, SAY_SWT) for t in ("ﷻ", "ﯲ", "ﯱ", "", "(swt)", "(SWT)")],
    *[(t, SAY_AS) for t in ("", "(as)", "(AS)")],
    *[(t, SAY_RA) for t in ("", "(ra)", "(RA)")],
]
SPOKEN = {"SAW": " صلى الله عليه وسلم", "SWT": " سبحانه وتعالى", "AS": " عليه السلام", "RA": " رضي الله عنه"}
DOUBLED = ["ﷺ", "ﷻ", "﷽", "\ufdf0", "\ufdf1", "\ufdf2"]
ABBREVIATIONS = ["(pbuh)", "(saw)", "(s.a.w)", "(swt)", "(a.s)", "(r.a)", "PBUH", "SAW", "SWT"]
EXPANSIONS = ["صلى الله عليه وسلم", "عليه السلام", "رضي الله عنه", "جل جلاله"]
#: Redundant neighbours of a symbol, in order: (before or after, text, symbol).
REDUNDANT = [
    (r"\(pbuh\)\s*ﷺ", "ﷺ"),
    (r"ﷺ\s*\(pbuh\)", "ﷺ"),
    (r"\(saw\)\s*ﷺ", "ﷺ"),
    (r"ﷺ\s*\(saw\)", "ﷺ"),
    (r"\(swt\)\s*ﷻ", "ﷻ"),
    (r"ﷻ\s*\(swt\)", "ﷻ"),
    (r"ﷺ\s*ﷺ", "ﷺ"),
    (r"ﷻ\s*ﷻ", "ﷻ"),
    (r"ﷺ\s*صلى الله عليه وسلم", "ﷺ"),
    (r"صلى الله عليه وسلم\s*ﷺ", "ﷺ"),
]


def count(c: Column, pattern: str) -> Column:
    """Matches of a pattern; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))


def characters(c: Column, chars: str) -> Column:
    """Characters of a text that are in a character class; whole runs are taken at a time, and no list of matches is made."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{chars}+", ""))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def words(c: Column) -> Column:
    """Tokens between runs of white space."""
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


# -- predicates ------------------------------------------------------------------------------
def is_arabic(c: Column) -> Column:
    return c.rlike(f"[{AR}]")


def is_arabic_wide(c: Column) -> Column:
    return c.rlike(f"[{AR_WIDE}]")


def is_mostly_arabic(c: Column, threshold: float = 0.5) -> Column:
    """Share of Arabic characters among visible ones; false for none."""
    visible = F.length(F.regexp_replace(c, WS, ""))
    return F.when(visible > 0, count(c, f"[{AR}]") / visible >= threshold).otherwise(F.lit(False))


def is_glyph(c: Column) -> Column:
    """Only presentation forms and private-use characters, at least one."""
    return c.rlike(f"^[{GLYPHS}]+\\z")


def has_glyph(c: Column) -> Column:
    return c.rlike(f"[{GLYPHS}]")


def glyph_page(c: Column) -> Column:
    """Page number in a glyph font's name, null if there is none."""
    found = F.regexp_extract(c, r"[_P](\p{Nd}{1,3})(?:\P{Nd}|\z)", 1)
    return F.when(found != "", found.cast("int"))


def is_repairable_font(c: Column) -> Column:
    return c.startswith(FONT_PREFIXES[0]) | c.startswith(FONT_PREFIXES[1])


def is_private(c: Column) -> Column:
    return c.rlike(f"^[{PRESENTATION}]+\\z")


def is_latinish(c: Column) -> Column:
    return c.rlike(f"^[{LATINISH}]\\z")


def is_honorific(c: Column) -> Column:
    """One of the honorific symbols by itself."""
    return F.trim(c).isin([s for s, _, _ in HONORIFICS])


def keeps_token(c: Column) -> Column:
    """Blank tokens go; so would private ones that are neither honorific nor glyphs, of which there are none."""
    blank = F.regexp_replace(c, WS, "") == ""
    return ~blank & ~(is_private(c) & ~is_honorific(c) & ~is_glyph(c))


def has_mojibake(c: Column) -> Column:
    """Heuristic damage test of a whole text."""
    n = F.length(c)
    flood = F.lit(False)
    for ch in ("\ufffd", "□", "■", "\0"):
        flood = flood | (n - F.length(F.replace(c, F.lit(ch), F.lit(""))) > n * 0.05)
    valid = (characters(c, r"[\x{0600}-\x{06FF}]") + characters(c, "[a-zA-Z]")) / n
    foreign = characters(c, r"[\x{00C0}-\x{017F}]") / n
    word = characters(c, r"(?U)[\w\s]") / n
    return F.coalesce(F.when(n < 10, False).when(flood, True).when((valid < 0.2) & (foreign > 0.1), True).otherwise(word < 0.3), F.lit(False))


def has_double_honorifics(c: Column) -> Column:
    """Doubled symbols, a symbol near its abbreviation, or a symbol with a written-out form."""
    out = F.lit(False)
    for s in DOUBLED:
        at = F.instr(c, s)
        near = c.contains(f"{s} {s}") | c.contains(s + s)
        for a in ABBREVIATIONS:
            near = near | ((F.instr(c, a) > 0) & (F.abs(at - F.instr(c, a)) < 30))
        for e in EXPANSIONS:
            near = near | c.contains(e)
        # a text without the symbol is not searched for its neighbours
        out = out | F.when(c.contains(s), near).otherwise(F.lit(False))
    return F.when(c.isNotNull(), out)


def language(c: Column) -> Column:
    """ar if Arabic characters are more than 30 % of letters, else en."""
    letters = count(c, r"\p{IsAlphabetic}")
    return F.when((letters > 0) & (count(c, f"[{AR}]") / letters > 0.3), "ar").otherwise("en")


# -- normalisation and repair ----------------------------------------------------------------
def strip_diacritics(c: Column) -> Column:
    return F.translate(c, DIACRITICS, "")


def orphan_rate(c: Column) -> Column:
    """Share of diacritics without an Arabic character before them."""
    marks = r"[\x{064B}-\x{0658}\x{0670}]"
    orphans = F.aggregate(F.regexp_extract_all(c, F.lit(f"(?:\\A|[^{AR}])({marks}+)"), F.lit(1)), F.lit(0), lambda n, run: n + F.length(run))
    return ratio(orphans, count(c, marks))


def normalize_arabic(c: Column) -> Column:
    """Marks and tatweel go; alef, ta marbuta and alef maqsura are folded."""
    bare = F.regexp_replace(c, r"[\x{064B}-\x{065F}\x{0670}\x{0640}]", "")
    return F.trim(F.translate(bare, "أإآٱةى", "ااااهي"))


def edit_share(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 if either is empty. ``markup.similarity`` normalises both first."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def repair(c: Column) -> Column:
    return F.translate(c, *REPAIRS)


def repair_for_font(c: Column, font: Column) -> Column:
    return F.when(is_repairable_font(font), repair(c)).otherwise(c)


def expand_ligatures(c: Column) -> Column:
    """Ligatures written out; markers of lost ones restored inside words.

    Within a run of word characters that doesn't begin with a bar, a bar after a letter and not
    before another bar is ff, and a DEL beside a letter is fi; neighbours are the original ones.
    """
    for one, many in LIGATURES.items():
        c = F.replace(c, F.lit(one), F.lit(many))
    run = f"[{LATINISH}|\\x{{7f}}-]"
    parts = F.regexp_extract_all(c, F.lit(f"({run}+|[^{LATINISH}|\\x{{7f}}-]+)"), F.lit(1))

    def mended(part: Column) -> Column:
        bars = F.regexp_replace(part, f"(?<=[{LATINISH}])\\|(?!\\|)", "﷐")
        both = F.regexp_replace(bars, f"(?<=[{LATINISH}])\\x{{7f}}|\\x{{7f}}(?=[{LATINISH}])", "﷑")
        return F.when(part.startswith("|"), part).otherwise(F.replace(F.replace(both, F.lit("﷐"), F.lit("ff")), F.lit("﷑"), F.lit("fi")))

    return F.when(c.rlike(r"[|\x{7f}]"), F.array_join(F.transform(parts, mended), "")).otherwise(c)


def fix_double_honorifics(c: Column) -> Column:
    for pattern, symbol in REDUNDANT:
        c = F.regexp_replace(c, "(?iU)" + pattern, symbol)
    return c


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def tighten(c: Column) -> Column:
    """No space before closing punctuation."""
    return F.regexp_replace(c, " +([.,;:!?])", "$1")


def decode_honorifics(c: Column) -> Column:
    """``struct(cleaned, abbreviations)`` in the order of replacement."""
    found = F.filter(F.array(*[F.when(c.contains(s), F.lit(a)) for s, _, a in HONORIFICS]), lambda x: x.isNotNull())
    cleaned = F.translate(c, "".join(s for s, _, _ in HONORIFICS), " " * len(HONORIFICS))
    return F.struct(collapse(cleaned).alias("cleaned"), found.alias("abbreviations"))


def show_honorifics(c: Column) -> Column:
    """Symbols in their shown form; hyphenated line ends and words joined."""
    for symbol, shown, _ in HONORIFICS:
        c = F.replace(c, F.lit(symbol), F.lit(shown))
    c = F.regexp_replace(c, r"(?U)-\s*\n\s*", "")
    return F.regexp_replace(c, r"(?U)(\w)-\s+(\w)", "$1$2")


def say_honorifics(c: Column) -> Column:
    """Honorific tokens as vowelled phrases, which hold no tokens themselves."""
    for token, phrase in SAY_TOKENS:
        c = F.replace(c, F.lit(token), F.lit(phrase))
    return c


def leading_honorific(c: Column) -> Column:
    """``struct(has, abbreviation, rest)``."""
    has, kind, rest = F.lit(False), F.lit(None).cast("string"), c
    symbols = "".join(s for s, _, _ in HONORIFICS)
    for s, _, a in reversed(HONORIFICS):
        kind = F.when(c.startswith(s), F.lit(a)).otherwise(kind)
        has = has | c.startswith(s)
    rest = F.when(has, F.trim(F.regexp_replace(c, f"^[{symbols}]+", ""))).otherwise(c)
    return F.struct(has.alias("has"), kind.alias("kind"), rest.alias("rest"))


def spoken(c: Column, kind: Column) -> Column:
    """Text with the honorific of that kind written out."""
    return F.concat(c, F.coalesce(F.create_map(*[F.lit(x) for kv in SPOKEN.items() for x in kv])[kind], F.lit("")))


# -- skeletons, numbers, evidence --------------------------------------------------------------
def arabic_skeleton(c: Column, ta_marbuta: str = "h") -> Column:
    """Consonants of Arabic text in Latin letters; all else goes; repeats collapse."""
    single = {letter: sound for letter, sound in CONSONANTS.items() if len(sound) == 1} | {"ة": ta_marbuta}
    c = F.regexp_replace(c, f"[^{''.join(CONSONANTS)}ة]", "")
    c = F.translate(c, "".join(single), "".join(single.values()))
    for letter, sound in CONSONANTS.items():
        if letter not in single:
            c = F.replace(c, F.lit(letter), F.lit(sound))
    return F.regexp_replace(c, r"(.)\1+", "$1")


def latin_skeleton(c: Column) -> Column:
    """Consonants of Latin text; repeats collapse."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^b-df-hj-np-tvxz]", ""), r"(.)\1+", "$1")


def variants(c: Column) -> Column:
    """Spellings that one sound may have."""
    pairs = [("dh", "z"), ("dh", "d"), ("th", "t"), ("q", "k")]
    return F.array_distinct(F.array(c, *[F.replace(c, F.lit(a), F.lit(b)) for a, b in pairs]))


@lru_cache(1)
def digits() -> tuple[str, str]:
    """All decimal digits of Unicode but the ASCII ones, and the ASCII digit of each."""
    own = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(own), "".join(str(unicodedata.digit(c)) for c in own)


def numbers(c: Column) -> Column:
    """Distinct digit runs in ASCII, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.translate(c, *digits()), F.lit("([0-9]+)"), F.lit(1))))


def matched_names(names: Column, blob_h: Column, blob_t: Column) -> Column:
    """Those of the names of which a variant is in either skeleton."""
    hit = lambda v: (v != "") & (blob_h.contains(v) | blob_t.contains(v))
    return F.filter(names, lambda n: F.exists(variants(n), hit))


def evidence_mass(names: Column, shared_numbers: Column) -> Column:
    return F.aggregate(names, F.lit(0), lambda n, x: n + F.length(x)) + 6 * F.size(shared_numbers)


def pair_score(names_mass: Column, has_number: Column, source_words: Column, target_words: Column, length_ratio: Column) -> Column:
    """Likeness of a pair from names, numbers and length."""
    expected = F.greatest(F.lit(1.0), source_words * length_ratio)
    observed = F.greatest(F.lit(1.0), target_words.cast("double"))
    length = F.least(observed / expected, expected / observed)
    score = 0.55 * F.least(F.lit(1.0), names_mass / 10.0) + 0.25 * has_number.cast("int") + 0.65 * length - 0.45
    return F.when((source_words == 0) | (target_words == 0), F.lit(-2.4)).otherwise(score)


# -- structure of source texts -------------------------------------------------------------------
#: Page, manuscript and milestone marks (fixed values).
MARKERS = r"(?U)\bPageV\d+P\d+\b", r"(?U)\bms\d+\b|\b\d+ms\b", r"(?U)\bMilestone\d+\b"


def strip_markers(c: Column) -> Column:
    """Page, manuscript and milestone marks go; runs of white space collapse."""
    for mark in MARKERS:
        c = F.regexp_replace(c, mark, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, f"{WS}+\\+{WS}*\\z", ""), WS + "{2,}", " "), f"^{WS}+|{WS}+\\z", "")


def split_hadith(c: Column) -> Column:
    """``struct(isnad, matn, hukm)`` at the first marks of each kind."""
    bare = F.replace(c, F.lit("$RWY$"), F.lit(""))
    parts = F.split(bare, "@MATN@", 2)
    rest = F.split(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), "@HUKM@", 2)
    return F.struct(F.trim(parts[0]).alias("isnad"), F.trim(rest[0]).alias("matn"), F.trim(F.coalesce(F.try_element_at(rest, F.lit(2)), F.lit(""))).alias("hukm"))


def known_line(c: Column) -> Column:
    """Whether a line is blank or starts with a mark of the source format."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+\\z", "").rlike(r"^(?:######OpenITI|#META#|### |# |~~|PageV|ms|Milestone|\z)")


def usable(c: Column) -> Column:
    """A metadata value, null where it says that there is none."""
    value = F.trim(c)
    return F.when((value != "") & ~F.upper(value).isin("NODATA", "NOTGIVEN"), value)


def first_usable(values: Column, *keys: str) -> Column:
    """The first usable value of a metadata map's keys, in the order given; empty if there is none."""
    return F.coalesce(*[usable(F.try_element_at(values, F.lit(k))) for k in keys], F.lit(""))


def work_id(name: Column) -> Column:
    """The first two dotted parts of a file name, else its stem."""
    return F.when(F.size(F.split(name, r"\.")) >= 2, F.substring_index(name, ".", 2)).otherwise(name)


#: Words and ordinals that a heading begins with (fixed values).
HEADING = r"(?iU)^(?:(?:chapter|book|part|section|volume|maqama|ode)\b|(?:[IVXLCDM]+|\d+)\s*[.):-])"


def looks_like_heading(c: Column) -> Column:
    """Short, and either a heading word or ordinal first or mostly capitals."""
    letters = characters(c, r"\p{L}")
    caps = characters(c, r"\p{IsUppercase}")
    heads = n_words(c).between(1, 16) & (c.rlike(HEADING) | ((letters > 0) & (caps / letters >= 0.78)))
    # nothing is sought in longer texts
    return F.when(F.length(c) <= 140, heads).when(F.length(c) > 140, False)


# -- bidirectional display -----------------------------------------------------------------------
ISOLATE, END_ISOLATE, TATWEEL = "\u2066", "\u2069", "\u0640"


def protect_ltr(c: Column) -> Column:
    """Isolates around runs of Latin letters and digits, an opening bracket included; isolated text stays."""
    run = r"([(\[]?[A-Za-z0-9][A-Za-z0-9._/:()\[\]-]*)"
    return F.when(c.contains(ISOLATE), c).otherwise(F.regexp_replace(c, run, f"{ISOLATE}$1{END_ISOLATE}"))


def semantic_text(c: Column) -> Column:
    """Without isolates and tatweel."""
    return F.translate(c, ISOLATE + END_ISOLATE + TATWEEL, "")


@lru_cache(1)
def combining() -> str:
    """Characters of a combining class, and the joiners, as a character class."""
    own = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))] + [0x200C, 0x200D]
    known = set(own)
    starts, ends = ([c for c in own if c + d not in known] for d in (-1, 1))
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(sorted(starts), sorted(ends), strict=True))


def visual_order(c: Column) -> Column:
    """Semantic text; its clusters of a character and its marks in reverse if there is Arabic."""
    plain = semantic_text(c)
    clusters = F.regexp_extract_all(plain, F.lit(f"((?s:.)[{combining()}]*)"), F.lit(1))
    return F.when(plain.rlike(f"[{AR_WIDE}\\x{{08A0}}-\\x{{08FF}}]"), F.array_join(F.reverse(clusters), "")).otherwise(plain)


def entry_heading(c: Column) -> Column:
    """A leading ordinal in Arabic-Indic digits."""
    lead = F.regexp_extract(c, r"^(\d+)\s*-", 1)
    return F.when(lead != "", F.concat(F.translate(lead, "0123456789", "٠١٢٣٤٥٦٧٨٩"), F.substr(c, F.length(lead) + 1))).otherwise(c)


def grams(tokens: Column, width: int = 4) -> Column:
    """Distinct n-grams of min(width, n) tokens, as 64-bit hashes.

    The tokens are bound to a lambda variable, else they would be computed anew for every n-gram.
    """

    def of(t: Column) -> Column:
        size = F.least(F.lit(width), F.size(t))
        starts = F.sequence(F.lit(1), F.size(t) - size + 1)
        return F.when(size > 0, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(t, i, size))))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(tokens), of)[0]


def region_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)([^\W_]+)"), F.lit(1))
