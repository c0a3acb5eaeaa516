"""License scans by patience alignment (operator 7).

Words are lower-cased runs of letters and digits. A template is sought where a text has pairs of
neighbouring words that the template has once: hits of rising template order and small distance
form a chain, which stray hits don't end. Every chain whose words could reach the threshold, or exceed the
best coverage so far, is aligned; chains of ``SEED_SHARE`` of the template's pairs bound the ranges of others. Alignment
anchors on words that are unique to both sides, takes the longest increasing subsequence of them, and
recurses into the gaps between; a gap without such words falls back to a longest common subsequence.
Coverage is the share of the template's words that are aligned. One scan, no shuffle; the templates are
a fixed, small list.

Defined results: null and empty text have coverage 0 and no license; a tie goes to the longer template, then to the
one that comes first; repeated rows give repeated rows; an empty table gives an empty result; only the id and
the text are read; a null id passes through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codexa.llm.near_dedup import word_hashes
from codexa.llm.text import U, HashIndex, mix, slices, texts

COVERAGE = 0.8
SEED_SHARE = 0.25

#: Notices of public licenses (fixed values).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("proprietary", "All rights reserved."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, rising in the first place, that also rises in the second."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, second) in enumerate(pairs):
        i = bisect_left(tails, second)
        if i == len(tails):
            tails.append(second)
            at.append(k)
        else:
            tails[i], at[i] = second, k
        before.append(at[i - 1] if i else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places.

    Row i is a number whose bit j is 0 where the longest common subsequence of ``a[:i]`` and ``b[: j + 1]``
    exceeds that of ``a[:i]`` and ``b[:j]``.
    """
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    rows = [row]
    for x in a:
        hit = row & places.get(x, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if rows[i] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


def patience(a: list, b: list, base_a: int = 0, base_b: int = 0) -> list[tuple[int, int]]:
    """Aligned places of two word lists."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(base_a + k, base_b + k) for k in range(head)]
    own, other = a[head : len(a) - tail], b[head : len(b) - tail]
    if own and other:
        in_a, in_b = Counter(own), Counter(other)
        place = {w: j for j, w in enumerate(other) if in_b[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(own) if in_a[w] == 1 and w in place])
        at_a, at_b = base_a + head, base_b + head
        if anchors:
            i0 = j0 = 0
            for i, j in [*anchors, (len(own), len(other))]:
                out += patience(own[i0:i], other[j0:j], at_a + i0, at_b + j0)
                if i < len(own):
                    out.append((at_a + i, at_b + j))
                i0, j0 = i + 1, j + 1
        else:
            out += [(at_a + i, at_b + j) for i, j in common(own, other)]
    return out + [(base_a + len(a) - k, base_b + len(b) - k) for k in range(tail, 0, -1)]


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return mix(words[:-1] * U(0x9E3779B97F4A7C15) + words[1:])


class Scanner:
    """All templates, and an index of the word pairs that each has once."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.names = [name for name, _ in templates]
        flat, offsets = texts(pa.array([text for _, text in templates]))
        hashes, bounds = word_hashes(flat, offsets)
        self.words = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.bags = [np.unique(words, return_counts=True) for words in self.words]
        self.index, self.owners = HashIndex(1 << 12), []
        self.pairs = []
        for t, words in enumerate(self.words):
            pairs = pair_hashes(words)
            value, place, count = np.unique(pairs, return_index=True, return_counts=True)
            value, place = value[count == 1], place[count == 1]
            self.pairs.append(max(1, len(value)))
            number, _ = self.index.number(value)
            self.owners += [[] for _ in range(self.index.n - len(self.owners))]
            for k, q in zip(number.tolist(), place.tolist(), strict=True):
                self.owners[k].append((t, q))

    def places(self, hits: list[tuple[int, int]], t: int) -> Iterator[tuple[int, int, int, int]]:
        """``(begin, end, first hit, last hit)`` where template t may be, most hits first, from (text place, template place) hits in text order."""
        size = len(self.words[t])
        chains: list[list[tuple[int, int]]] = []
        live: list[list[tuple[int, int]]] = []
        for p, q in hits:
            live = [c for c in live if p - c[-1][0] <= size]
            fit = [c for c in live if q > c[-1][1]]
            if fit:
                # the chain that needs the fewest words more or less up to this hit
                min(fit, key=lambda c: abs(p - c[-1][0] - q + c[-1][1])).append((p, q))
            else:
                live.append([(p, q)])
                chains.append(live[-1])
        slack = size // 4 + 2
        firm = [(c[0][0], c[-1][0]) for c in chains if len(c) >= SEED_SHARE * self.pairs[t]]
        for c in sorted(chains, key=len, reverse=True):
            (first, q), (last, r) = c[0], c[-1]
            low = max((e + 2 for _, e in firm if e < first), default=0)
            high = min((b for b, _ in firm if b > last), default=1 << 62)
            yield max(low, first - 2 * q - slack), min(high, last + 2 * (size - r) + slack), first, last

    def bound(self, words: np.ndarray, t: int) -> float:
        """No alignment of ``words`` covers more of template t."""
        known, counts = self.bags[t]
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        return float(np.minimum(np.bincount(at[known[at] == words], minlength=len(known)), counts).sum()) / len(self.words[t])

    def scan(self, words: np.ndarray, found: list[tuple[int, int]], least: float = COVERAGE) -> list[tuple[float, int, int, int]]:
        """``(coverage, template, first word, last word)`` of each place; ``found``: (place, pair number)."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for p, k in found:
            for t, q in self.owners[k]:
                hits.setdefault(t, []).append((p, q))
        tried = [(self.bound(words[a:b], t), t, a, b, first, last) for t, own in hits.items() for a, b, first, last in self.places(own, t)]
        out, best = [], 0.0
        # sorted stably: chains of one template and bound stay in the order of their hits
        for most, t, a, b, first, last in sorted(tried, key=lambda x: -x[0]):
            if most < least and most <= best:
                break
            good = [(x, y) for c, u, x, y in out if u == t and c >= least]
            if any(x <= first and last < y for x, y in good):
                continue
            aligned = patience(words[a:b].tolist(), self.words[t].tolist())
            if not aligned:
                continue
            cover, x, y = len(aligned) / len(self.words[t]), a + aligned[0][0], a + aligned[-1][0]
            if cover < least or not any(x <= d and c <= y for c, d in good):
                out.append((cover, t, x, y))
                best = max(best, cover)
        return out


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = COVERAGE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Best template and coverage of each row, and every place where one is covered well.

    ``(key, license, coverage, n_found, licenses array, spans array<struct>)``.
    """
    span = "array<struct<license:string,first_word:long,last_word:long,coverage:double>>"
    kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for part in slices(batches, text):
            flat, offsets = texts(part[text])
            words, bounds = word_hashes(flat, offsets)
            number = scanner.index.find(pair_hashes(words)) if len(words) > 1 else np.zeros(0, np.int32)
            at = np.flatnonzero(number >= 0)
            owner = np.searchsorted(bounds, at, "right") - 1
            inside = at + 1 < bounds[owner + 1]
            at, owner = at[inside], owner[inside]
            cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
            names, cover, spans = [], [], []
            for row in range(part.num_rows):
                own = at[cut[row] : cut[row + 1]]
                got = scanner.scan(words[bounds[row] : bounds[row + 1]], list(zip((own - bounds[row]).tolist(), number[own].tolist(), strict=True)), least) if len(own) else []
                good = [g for g in got if g[0] >= least]
                # the longer template wins among equally covered ones that say the same
                best = max(got, key=lambda g: (g[0], len(scanner.words[g[1]]), -g[1]), default=(0.0, 0, 0, 0))
                names.append(scanner.names[best[1]] if best[0] >= least else None)
                cover.append(best[0])
                spans.append([{"license": scanner.names[t], "first_word": a, "last_word": b, "coverage": c} for c, t, a, b in sorted(good, key=lambda g: (g[2], g[3], g[1]))])
            found = [sorted({s["license"] for s in own}) for own in spans]
            yield pa.RecordBatch.from_arrays([part[key].cast(pa.int64()), pa.array(names, pa.string()), pa.array(cover), pa.array([len(s) for s in spans], pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, kind)], [key, "license", "coverage", "n_found", "licenses", "spans"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, license string, coverage double, n_found long, licenses array<string>, spans {span}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
