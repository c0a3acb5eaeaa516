"""Functions that need a parser or Unicode normalisation, as Arrow-batched scalar functions."""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from codexa.functions import alignment as A
from codexa.functions import text as X
from codexa.functions.alignment import arabic_sentences, name_skeletons, shared_evidence

#: Tags at which words part (fixed values).
SPACING = {"br", "div", "li", "p", "section", "table", "td", "th", "tr"}
ZERO_WIDTH = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0xFEFF, 0x2060])


class Text(HTMLParser):
    """Collects all data of a document, with a space at spacing tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in SPACING:
            self.out.append(" ")

    handle_endtag = lambda self, tag: self.handle_starttag(tag, None)

    def handle_data(self, data):
        self.out.append(data)


def plain_html(source: str | None) -> str:
    """Text of HTML, white space collapsed; entities that decoding uncovers are decoded too."""
    parser = Text()
    parser.feed(source or "")
    parser.close()
    return " ".join(html.unescape(" ".join("".join(parser.out).split())).split())


#: Character references closed by a semicolon, and a noncharacter that stands for an ampersand while tags are parsed, or for the end of a sentence.
CLOSED, MARK = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);", re.ASCII), "\ufdd0"


def closed_html(source: str | None) -> str:
    """Text of HTML, white space collapsed; only references closed by a semicolon are decoded, once: cut off ones are text."""
    parser = Text()
    parser.feed((source or "").replace("&", MARK))
    parser.close()
    text = "".join(parser.out).replace(MARK, "&")
    return " ".join(CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), text).split())


FENCED = re.compile(r"```.*?(?:(```)|\Z)", re.DOTALL)


def link_end(text: str, at: int) -> int | None:
    """The end of a bracketed URL whose opening bracket precedes ``at``; brackets nest."""
    depth = 1
    for end in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[end], 0)
        if not depth:
            return end + 1
    return None


def plain_markdown(source: str | None) -> str:
    """Text of inline Markdown: no fences, links as labels, images as spaces, code without ticks, no emphasis marks."""
    text = FENCED.sub(lambda m: " " if m[1] else "", source or "")
    out, at = [], 0
    for found in re.finditer(r"`|!?\[|[*_~]", text):
        if found.start() < at:
            continue
        mark, start = found[0], found.start()
        out.append(text[at:start])
        at = found.end()
        if mark == "`":
            if (end := text.find("`", at)) >= 0:
                out.append(text[at:end])
                at = end + 1
        elif mark.endswith("["):
            # a bang by itself is text, and so is a bracket that begins no link
            shut = text.find("](", at)
            end = link_end(text, shut + 2) if shut >= 0 and "]" not in text[at:shut] else None
            out.append(mark if end is None else " " if mark == "![" else text[at:shut])
            at = at if end is None else end
    return " ".join("".join([*out, text[at:]]).split())


#: Invisible marks, old ligatures and punctuation that matching ignores (fixed values).
LIGATURES = str.maketrans({"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"})
IGNORED = dict.fromkeys(map(ord, "'\"`´′″‹›«»\u2018\u2019\u201c\u201d\u02bc\u2032\u2033.,;:!?()[]{}،؛؟–—-"))


def normal(text: str | None) -> str:
    """NFKC without invisible marks and punctuation, Arabic letters folded, lower case."""
    text = unicodedata.normalize("NFKC", text or "").strip().translate(ZERO_WIDTH).translate(LIGATURES).translate(IGNORED)
    text = re.sub("[\u064b-\u065f\u0670\u0640]", "", text).translate(str.maketrans("أإآٱةى", "ااااهي"))
    return text.lower().strip()


def scalar(kind: str):
    """A Python function of one text as an Arrow-batched column function."""

    def wrap(f):
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return s.map(f)

        return run

    return wrap


def html_to_text(c: Column, closed: bool = False) -> Column:
    """Text of HTML; ``closed``: a reference without its semicolon stays as it is."""
    return scalar("string")(closed_html if closed else plain_html)(c)


def strip_markdown(c: Column) -> Column:
    return scalar("string")(plain_markdown)(c)


def normalize(c: Column) -> Column:
    return scalar("string")(normal)(c)


def similarity(a: Column, b: Column) -> Column:
    """Likeness of two normalised texts by edit distance, 0 to 1; 0 if either is blank."""
    return X.edit_share(normalize(a), normalize(b))


def names(c: Column, strict: bool = False) -> Column:
    """Skeletons of capitalised words that may be names; ``strict``: only those that can be landmarks."""
    return scalar("array<string>")(lambda t: name_skeletons(t or "", strict))(c)


def evidence(arabic: Column, english: Column) -> Column:
    """``struct(names, numbers, mass)``: what two texts share, and its mass."""

    @F.pandas_udf("struct<names:array<string>,numbers:array<string>,mass:int>")
    def run(a: pd.Series, e: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared_evidence(x or "", y or "") for x, y in zip(a, e, strict=True)], columns=["names", "numbers", "mass"])

    return run(arabic, english)


def english(c: Column) -> Column:
    """``english_sentences`` as an expression: a noncharacter is set at the ends of sentences, and the text is split there."""
    # what ends with both letters of e.g. in capitals is two sentences before the test, so their second letter is small
    short = r"(?<!(?<![\p{L}\p{N}_])(?:(?iu:Mr|Mrs|Ms|Dr|St|No|vol|pp|cf|viz)|[Ii]\.e|[Ee]\.g)\.)"
    end = f"(?<![.!?])([.!?]++[\"”’]*+){short}(?={X.WS}*+[\"“‘\\p{{IsUppercase}}])"
    strip = lambda t: F.regexp_replace(t, f"^{X.WS}+|{X.WS}++\\z", "")
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), end, f"$1{MARK}"), MARK)
    return F.filter(F.transform(parts, strip), lambda t: t != "")


def sentences(c: Column, lang: str) -> Column:
    """Sentences of a text; English ones without Python."""
    if lang != "ar":
        return english(c)
    return scalar("array<string>")(lambda t: arabic_sentences(t or ""))(c)


def page_lines(n: Column, first: Column, full: Column, after: Column) -> Column:
    """Lines of a paragraph on each page."""

    @F.pandas_udf("array<int>")
    def run(n: pd.Series, first: pd.Series, full: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([A.balanced_counts(*map(int, row[:3]), after=int(row[3])) for row in zip(n, first, full, after, strict=True)])

    return run(n, first, full, after)


def elongations(c: Column) -> Column:
    """Places in an Arabic word where a tatweel may be inserted."""
    return scalar("array<int>")(lambda t: A.elongations(t or ""))(c)


def elongated(c: Column, gap: Column, width: Column) -> Column:
    """Text with as many tatweels of a width as fill a gap."""

    @F.pandas_udf("string")
    def run(c: pd.Series, gap: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([A.elongated(t or "", g, w) for t, g, w in zip(c, gap, width, strict=True)])

    return run(c, gap, width)
