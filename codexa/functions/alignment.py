"""Pure functions of the aligner: names, sentences, landmarks, and the monotone span alignment.

They run inside grouped maps, one group for each interval between landmarks, so memory is bounded by an interval.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable

import numpy as np

# -- fixed values --------------------------------------------------------------------------------
STOPWORDS = frozenset(
    "a an the and or of on in to us by from with for said says related reported ibn bin ben abu abi abd umm bint banu bani al el god allah prophet messenger "
    "chapter book section part page volume one two three four five six seven eight nine ten his her their this that which who was were is are".split()
)
#: Sounds of the Arabic consonants, for matching; letters that are not here have none.
CONSONANTS = {
    "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d",
    "ط": "t", "ظ": "z", "غ": "gh", "ف": "f", "ق": "k", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "پ": "b", "چ": "j", "ژ": "z", "گ": "k",
}
PARAGRAPH_MOVES = [(1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1), (2, 3), (3, 2), (1, 4), (4, 1), (1, 5), (5, 1), (1, 0), (0, 1)]
SENTENCE_MOVES = [(1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1), (1, 4), (4, 1), (1, 5), (5, 1), (1, 0), (0, 1)]
SKIP_COST, VECTOR_SKIP_COST, MOST_CELLS, LONG_CLAUSE, SHORT_TAIL = 1.1, 0.55, 2_000_000, 55, 8
WAYPOINT_SIMILARITY, WAYPOINT_MARGIN, WAYPOINT_WIDTH = 0.62, 0.025, 3
ABBREVIATION_END = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|St|No|vol|pp|cf|viz|i\.e|e\.g)\.\Z", re.IGNORECASE)
OPENING = frozenset('"“‘')
APOSTROPHES = "'’ʿʻ"
NAME_CUE = re.compile(rf"kh|gh|dh|th|sh|q|[{APOSTROPHES}]", re.IGNORECASE)
ANCHOR_CUE = re.compile(rf"kh|gh|dh|q|[{APOSTROPHES}āīū]", re.IGNORECASE)
#: A text up to its next end mark, closing quotes included, or its rest.
PIECE = re.compile(r"[^.!?]*[.!?]+[\"”’]*|[^.!?]+\Z")
#: A Latin word with what stands before it.
WORD = re.compile(rf"([^A-Za-z]*)([A-Za-z][A-Za-z{APOSTROPHES}-]*)")


# -- names and numbers ---------------------------------------------------------------------------
def squeezed(text: str) -> str:
    return re.sub(r"(.)\1+", r"\1", text)


def arabic_blob(text: str, ta_marbuta: str) -> str:
    """Consonant skeleton of Arabic text."""
    return squeezed(text.translate(defaultdict(str, {ord(k): v for k, v in CONSONANTS.items()} | {ord("ة"): ta_marbuta})))


def latin_skeleton(text: str) -> str:
    return squeezed(re.sub("[^b-df-hj-np-tvxz]", "", text.lower()))


def spellings(skeleton: str) -> set[str]:
    return {skeleton, *(skeleton.replace(a, b) for a, b in (("dh", "z"), ("dh", "d"), ("th", "t"), ("q", "k")))}


def digit_runs(text: str) -> set[str]:
    """Numbers in ASCII digits; digits without a decimal value spoil a run."""
    runs = ([unicodedata.digit(c, None) for c in run] for run in re.findall(r"\d+", text))
    return {"".join(map(str, run)) for run in runs if None not in run}


def name_skeletons(text: str, strict: bool = False, least: int = 3) -> list[str]:
    """Skeletons of capitalised words that may be names, in order; ``strict``: only with a strong cue."""
    wanted = anchor_like if strict else name_like
    bones = (latin_skeleton(token) for token, opens in capital_parts(text, strict) if wanted(token, opens))
    return list(dict.fromkeys(b for b in bones if len(b) >= least))


def capital_parts(text: str, whole: bool) -> list[tuple[str, bool]]:
    """Parts of hyphenated Latin words that begin with a capital, and whether the word opens a sentence.

    ``whole``: apostrophes around a part stay.
    """
    out, behind = [], ""
    for gap, word in WORD.findall(text):
        behind = (behind + gap).rstrip()[-1:]
        opens = behind in ("", ".", "!", "?")
        parts = word.split("-") if whole else [p.strip(APOSTROPHES) for p in word.split("-")]
        out += [(p, opens) for p in parts if p[:1].isupper() and p.lower() not in STOPWORDS]
        behind = word[-1]
    return out


def name_like(token: str, opens: bool) -> bool:
    """Inside a sentence any capital will do; at its start a cue or mostly capitals are needed."""
    return not opens or bool(NAME_CUE.search(token)) or sum(map(str.isupper, token)) >= max(2, len(token) // 2)


def anchor_like(token: str, opens: bool) -> bool:
    return bool(ANCHOR_CUE.search(token))


# -- sentences -----------------------------------------------------------------------------------
def cut(text: str, marks: str) -> list[str]:
    """Parts between white space that follows one of the marks."""
    return [part for part in map(str.strip, re.split(rf"(?<=[{marks}])\s+", text)) if part]


def packed(clauses: list[str], most: int) -> list[str]:
    """Neighbouring clauses joined while they have ``most`` words at most."""
    sizes = [len(c.split()) for c in clauses]
    starts, room = [], 0
    for k, size in enumerate(sizes):
        room -= size
        if room < 0:
            starts.append(k)
            room = max(0, most - size)
    return [" ".join(clauses[a:b]) for a, b in zip(starts, [*starts[1:], len(clauses)], strict=True)]


def arabic_sentences(text: str) -> list[str]:
    """Sentences; those of over 55 words are regrouped by clauses, short tails join what precedes."""
    out: list[str] = []
    for sentence in cut(text, ".!?؟۔"):
        long = len(sentence.split()) > LONG_CLAUSE
        out += packed(cut(sentence, "،؛"), LONG_CLAUSE) if long else [sentence]
        if long and len(out) > 1 and len(out[-1].split()) < SHORT_TAIL:
            out[-2:] = [" ".join(out[-2:])]
    return out


def runs_on(before: str, after: str) -> bool:
    """Whether a text goes on after an end mark: after an abbreviation, or before neither a quote nor a capital."""
    first = after.lstrip()[:1]
    return bool(ABBREVIATION_END.search(before.split()[-1])) or not (first in OPENING or first.isupper())


def english_sentences(text: str) -> list[str]:
    """Sentences: pieces up to each end mark, merged where the text runs on."""
    out: list[str] = []
    for piece in PIECE.findall(text.strip()):
        if out and runs_on(out[-1], piece):
            out[-1] += piece
        else:
            out.append(piece)
    return [s.strip() for s in out]


# -- evidence and landmarks ----------------------------------------------------------------------
class Side:
    """Features of one side's units, computed once."""

    def __init__(self, units: list[str], arabic: bool) -> None:
        self.units, self.n = units, len(units)
        self.words = np.concatenate([[0], np.cumsum([len(u.split()) for u in units])]).astype(float)
        self.numbers = [digit_runs(u) for u in units]
        if arabic:
            self.blobs = [(arabic_blob(u, "h"), arabic_blob(u, "t")) for u in units]
        else:
            self.names = [name_skeletons(u) for u in units]


def holders(a: Side, names: Iterable[str]) -> dict[str, list[int]]:
    """Units of the Arabic side whose skeleton holds a spelling of each name."""
    forms = {n: [s for s in spellings(n) if s] for n in names}
    return {n: [i for i, blobs in enumerate(a.blobs) if any(s in b for s in own for b in blobs)] for n, own in forms.items()}


def shared_evidence(arabic: str, english: str) -> tuple[list[str], list[str], int]:
    """Names and numbers that two texts share, and their mass."""
    a, e = Side([arabic], True), Side([english], False)
    where = holders(a, e.names[0])
    names, numbers = [n for n in e.names[0] if where[n]], sorted(a.numbers[0] & e.numbers[0])
    return names, numbers, sum(map(len, names)) + 6 * len(numbers)


def landmarks(a: Side, e: Side) -> list[tuple[int, int, int, list[str]]]:
    """Hard anchors ``(arabic, english, score, marks)``: rare shared numbers or several rare names, in order on both sides.

    Candidates come from an index of names and numbers, so pairs without evidence are never looked at.
    """
    count_a, count_e = (Counter(x for own in side.numbers for x in own) for side in (a, e))
    once = {x for x, n in count_e.items() if n == 1 and count_a[x] == 1}
    home = {x: i for i, own in enumerate(a.numbers) for x in own & once}
    rare = Counter(n for u in e.units for n in set(name_skeletons(u, strict=True)))
    where = holders(a, {n for own in e.names for n in own if 1 <= rare[n] <= 2})
    points = []
    for j in range(e.n):
        numbers, names = defaultdict(list), defaultdict(list)
        for x in sorted(e.numbers[j] & once):
            numbers[home[x]].append(x)
        for n in e.names[j]:
            for i in where.get(n, ()):
                names[i].append(n)
        mass = {i: sum(map(len, names.get(i, ()))) for i in {*numbers, *names}}
        score = {i: m + 20 + 6 * len(numbers[i]) if i in numbers else m for i, m in mass.items() if i in numbers or len(names[i]) >= 2 and m >= 7}
        if score:
            best, *others = sorted(score, key=lambda i: (score[i], i), reverse=True)
            if best in numbers or score[best] - (score[others[0]] if others else 0) >= 3:
                points.append((best, j, score[best], [f"number:{x}" for x in numbers.get(best, ())] + [f"name:{n}" for n in names.get(best, ())]))
    # an Arabic unit anchors its best English unit, the first one of equals
    top = {p[0]: p for p in sorted(points, key=lambda p: (p[2], -p[1]))}
    return monotone([p for p in points if top[p[0]] is p])


def monotone(points: list[tuple]) -> list[tuple]:
    """The heaviest chain of points that rises strictly in both coordinates; points are (x, y, weight, ...)."""
    points = sorted(points, key=lambda p: (p[0], p[1], -p[2]))
    total, before = [], []
    for k, p in enumerate(points):
        heads = [(total[q], -q) for q in range(k) if points[q][0] < p[0] and points[q][1] < p[1] and total[q] > 0]
        weight, at = max(heads, default=(0, 1))
        total.append(weight + p[2])
        before.append(-at)
    out, k = [], int(np.argmax(total)) if total else -1
    while k >= 0:
        out.append(points[k])
        k = before[k]
    return out[::-1]


# -- span scores ---------------------------------------------------------------------------------
Similar = Callable[[int, int, np.ndarray, np.ndarray], np.ndarray]


def span_scores(a: Side, e: Side, moves: list[tuple[int, int]], ratio: float, similar: Similar | None = None) -> dict[tuple[int, int], np.ndarray]:
    """Score of every span pair of each two-sided move, as one matrix a move."""
    out = {}
    for da, de in moves:
        if not (da and de) or da > a.n or de > e.n:
            continue
        source, target = a.words[da:] - a.words[:-da], e.words[de:] - e.words[:-de]
        expected, seen = np.maximum(1, source * ratio)[:, None], np.maximum(1, target)[None, :]
        if similar is not None:
            out[da, de] = similar(da, de, expected, seen) - 0.05 * (da + de - 2)
            continue
        score = 0.65 * np.minimum(seen / expected, expected / seen) - 0.45
        spans_a = [set().union(*a.numbers[i : i + da]) for i in range(a.n - da + 1)]
        blobs = [tuple("".join(b[t] for b in a.blobs[i : i + da]) for t in (0, 1)) for i in range(a.n - da + 1)]
        for j in range(e.n - de + 1):
            names, digits = {n for own in e.names[j : j + de] for n in own}, set().union(*e.numbers[j : j + de])
            if digits:
                score[:, j] += [0.25 * bool(digits & own) for own in spans_a]
            if names:
                forms = {n: [s for s in spellings(n) if s] for n in names}
                mass = [sum(len(n) for n, own in forms.items() if any(s in b for s in own for b in blob)) for blob in blobs]
                score[:, j] += 0.55 * np.minimum(1, np.array(mass) / 10)
        out[da, de] = score - 0.05 * (da + de - 2)
    return out


def length_ratio(source: float, target: float) -> float:
    return min(4.0, max(0.4, target / source)) if source and target else 1.5


# -- alignment -----------------------------------------------------------------------------------
def best_steps(n: int, m: int, moves: list[tuple[int, int]], scores: dict[tuple[int, int], np.ndarray], skip_cost: float) -> np.ndarray:
    """The move that ends the best path at each cell, -1 where there is none.

    A row is filled by whole moves; only steps along the row go cell by cell. Of equal paths the one whose last step
    starts first wins, then the move listed first.
    """
    rank = sorted(range(len(moves)), key=lambda k: (-moves[k][0], -moves[k][1], k))
    best, step = np.full((n + 1, m + 1), -np.inf), np.full((n + 1, m + 1), -1)
    best[0, 0] = 0
    for i in range(n + 1):
        for k in rank:
            da, de = moves[k]
            if da > i or de > m:
                continue
            if da:
                value = best[i - da, : m + 1 - de] + (scores[da, de][i - da] if de else -skip_cost)
                better = value > best[i, de:]
                best[i, de:][better], step[i, de:][better] = value[better], k
            else:
                row, marks = best[i].tolist(), step[i]
                for j in range(de, m + 1):
                    if row[j - de] - skip_cost > row[j]:
                        row[j] = row[j - de] - skip_cost
                        marks[j] = k
                best[i] = row
    return step


def align(arabic: list[str], english: list[str], moves: list[tuple[int, int]] = SENTENCE_MOVES, skip_cost: float = SKIP_COST, most_cells: int = MOST_CELLS, similar: Similar | None = None) -> list[dict] | None:
    """The best monotone path of spans; None if the table would be larger than ``most_cells``."""
    n, m = len(arabic), len(english)
    if not n or not m:
        side = [dict(a0=k if n else 0, a1=k + 1 if n else 0, e0=0 if n else k, e1=0 if n else k + 1) for k in range(n or m)]
        flag, op = ("arabic_omission", "1-0") if n else ("english_addition", "0-1")
        return [s | dict(op=op, score=-skip_cost, confidence=0.12, radius=3, flags=[flag]) for s in side]
    if (n + 1) * (m + 1) > most_cells:
        return None
    a, e = Side(arabic, True), Side(english, False)
    scores = span_scores(a, e, moves, length_ratio(a.words[-1], e.words[-1]), similar)
    step = best_steps(n, m, moves, scores, skip_cost)
    out, i, j = [], n, m
    while i or j:
        da, de = moves[step[i, j]]
        score = float(scores[da, de][i - da, j - de]) if da and de else -skip_cost
        sure = max(0.12, min(0.97, 0.35 + score / 1.6))
        radius = 0 if sure >= 0.88 else 1 if sure >= 0.70 else 2
        flags = ["low_signal"] if sure < 0.55 else []
        if not (da and de):
            radius, flags = max(radius, 2), ["skip"]
        out.append(dict(a0=i - da, a1=i, e0=j - de, e1=j, op=f"{da}-{de}", score=score, confidence=sure, radius=radius, flags=flags))
        i, j = i - da, j - de
    return out[::-1]


def align_interval(arabic: list[str], english: list[str], marks: list[str] | None, most_cells: int = MOST_CELLS, vectors: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[dict], bool, int]:
    """Links of one interval, whether it was too large, and its number of waypoints.

    ``marks``: the interval begins with a landmark, the first unit of both sides.
    """
    own, k, found = [], 0, []
    if marks is not None:
        own.append(dict(a0=0, a1=1, e0=0, e1=1, op="1-1", score=1.0, confidence=0.94, radius=0, flags=["hard_landmark", *marks]))
        k = 1
    similar, skip = None, SKIP_COST
    if vectors is not None and len(arabic) > k and len(english) > k:
        a, e = (v[k:] for v in vectors)
        found = waypoints(a, e)
        similar, skip = embedding_scorer(a, e, found), VECTOR_SKIP_COST
    links = align(arabic[k:], english[k:], PARAGRAPH_MOVES, skip, most_cells, similar)
    coarse = links is None
    if coarse:
        n, m = len(arabic) - k, len(english) - k
        links = [dict(a0=0, a1=n, e0=0, e1=m, op=f"{n}-{m}", score=0.0, confidence=0.2, radius=3, flags=["coarse_interval", "dp_window_too_large"])]
    return own + [x | {c: x[c] + k for c in ("a0", "a1", "e0", "e1")} for x in links], coarse, len(found)


# -- vectors -------------------------------------------------------------------------------------
def span_vectors(v: np.ndarray, width: int) -> np.ndarray:
    """Unit sums of every ``width`` neighbouring vectors."""
    sums = np.concatenate([np.zeros((1, v.shape[1])), np.cumsum(v, axis=0)])
    span = sums[width:] - sums[:-width]
    return span / np.maximum(1e-12, np.linalg.norm(span, axis=1, keepdims=True))


def waypoints(a: np.ndarray, e: np.ndarray, width: int = WAYPOINT_WIDTH, least: float = WAYPOINT_SIMILARITY, margin: float = WAYPOINT_MARGIN) -> list[tuple[float, float]]:
    """Middles of spans that are each other's best match with a lead, as the heaviest rising chain."""
    if len(a) <= width or len(e) <= width:
        return []
    cosine = span_vectors(a, width) @ span_vectors(e, width).T
    two = np.sort(cosine, axis=1)[:, -2:]
    lead, best = two[:, 1] - two[:, 0], cosine.argmax(axis=1)
    good = np.flatnonzero((two[:, 1] >= least) & (lead >= margin) & (cosine.argmax(axis=0)[best] == np.arange(len(best))))
    middle = (width - 1) / 2
    return [(i + middle, j + middle) for i, j, _ in monotone([(int(i), int(best[i]), float(two[i, 1] + lead[i])) for i in good])]


def embedding_scorer(a: np.ndarray, e: np.ndarray, found: list[tuple[float, float]] = ()) -> Similar:
    """A scorer from vectors: cosine of span sums, length ratio, distance from interpolated waypoints."""

    def score(da: int, de: int, expected: np.ndarray, seen: np.ndarray) -> np.ndarray:
        cosine = span_vectors(a, da) @ span_vectors(e, de).T
        i, j = np.arange(cosine.shape[0])[:, None] + (da - 1) / 2, np.arange(cosine.shape[1])[None, :] + (de - 1) / 2
        return 2.7 * cosine - 0.45 * np.abs(np.log(seen / expected)) - 0.08 * position_cost(i, j, found) - 1.0

    return score


def position_cost(i, j, found) -> np.ndarray:
    """Distance of j from the line between the waypoints around i; 0 outside of them."""
    if len(found) < 2:
        return np.zeros(np.broadcast(i, j).shape)
    x, y = (np.array(c, float) for c in zip(*found, strict=True))
    inside = (i >= x[0]) & (i <= x[-1])
    return np.where(inside, np.abs(j - np.interp(i, x, y)), 0.0)


# -- typesetting ---------------------------------------------------------------------------------
def balanced_counts(n: int, first: int, full: int, before: int = 3, after: int = 2) -> list[int]:
    """Lines on each page: ``before`` at least ahead of a break, ``after`` behind it; a leading 0 starts on the next page."""
    if n <= 0 or full <= 0:
        return [n] if n > 0 else []
    out, room = [], max(0, first)
    while n > room:
        take = min(room, n - after)
        if min(room, take) >= before:
            out.append(take)
            n -= take
        elif out:
            break
        else:
            out.append(0)
        room = full
    return [*out, n]


#: Letters that don't join to the next one, and the two halves of the ligature of lam and alef (fixed values).
UNJOINED = set("اأإآدذرزوؤء")
LAM, ALEF = set("لﻝﻞﻟ"), set("اأإآﺍﺎﺃﺄﺇﺈﺁﺂ")
ARABIC_LETTER = re.compile("[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]")
TATWEEL = "ـ"


def elongations(word: str) -> list[int]:
    """Places in an Arabic word where a tatweel may be inserted: where a letter joins to the next character."""
    marked = lambda c: "ً" <= c <= "ٟ" or c == "ٰ"
    joins = lambda c, d: c not in UNJOINED and not marked(d) and not (c in LAM and d in ALEF) and ARABIC_LETTER.search(c + d)
    return [k for k in range(1, len(word)) if joins(word[k - 1], word[k])]


def elongated(text: str, gap: float, width: float, most: int = 10) -> str:
    """``text`` with as many tatweels of a width as fill a gap, dealt over its places in turn."""
    need = min(most, int(-(-gap // width))) if gap > 2 and width > 0 else 0
    words = text.split(" ")
    places = [(w, p) for w, word in enumerate(words) if ARABIC_LETTER.search(word) for p in elongations(word)]
    extra = Counter(places[k % len(places)] for k in range(need)) if places else Counter()
    return " ".join("".join(TATWEEL * extra[w, p] + c for p, c in enumerate(word)) for w, word in enumerate(words))
