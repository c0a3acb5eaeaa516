"""Near-duplicate classes by Order MinHash and banded alignment (operator 9).

1. Words are lower-cased runs of letters and digits; shingles are ``SHINGLE`` words. Texts of equal
   words become one node, so copies cost nothing further on: one shuffle of identities (128 bits of
   SHA-256), ids and keys. Words stay where the scan wrote them.
2. ``SKETCHES`` keys for each node: the two least occurrence-numbered shingles under one hash
   function, in text order. A bucket is a key and a band of shingle counts; bands overlap so that any
   two texts whose counts allow the similarity share one.
3. ``linking`` compares the nodes of a bucket, first with the bucket's least node, then, where that leaves
   several components, all others in blocks; words are fetched for nodes that share a bucket only. A bound from counts of
   ``BINS`` shingle classes spares most pairs the alignment; it never falls below the similarity.
4. Verification aligns the two shingle sequences inside the diagonal band outside of which the
   similarity can't be reached. similarity = aligned / (n1 + n2 - aligned) >= ``SIMILARITY``. Words are
   16-bit hashes there: a changed word looks unchanged with probability 1 in 65,536.
5. Classes are connected components of verified links.

Defined results: null text is empty text; texts without words are alike only when identical; texts of
fewer words than a shingle are one shingle; a class's id is its least document id (null ids count
as least); repeated rows are members like any other; an empty table gives an empty result; only the id
and the text are read (``deduplicated`` passes all other columns through, whatever their names).
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexa.llm.fingerprints import order_minhash
from codexa.llm.linking import link_classes
from codexa.llm.quality import unused
from codexa.llm.store import drop, keep
from codexa.llm.text import LOWER, U, runs, slices, span_hashes, texts

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 10
#: Classes of shingles that are counted for the bound.
BINS = 1024
NO_ID = -(1 << 63)
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all normalised words and the bounds of each text's words."""
    starts, ends, owner = runs(WORD_BYTE[flat], offsets)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))])
    return span_hashes(LOWER[flat], starts, ends), bounds


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all windows of ``size`` words, or of the whole if it has fewer."""
    size = min(size, len(words))
    out = np.zeros(max(0, len(words) - size + 1) if size else 0, U)
    for k in range(size):
        out = (out * U(0x9E3779B97F4A7C15)) ^ (out >> U(29)) ^ (words[k : k + len(out)].astype(U) * U(0xBF58476D1CE4E5B9) + U(k + 1))
    return out


def identity(content: bytes, words: np.ndarray) -> bytes:
    """Equal for texts of equal words; texts without words are told apart by their bytes."""
    return hashlib.sha256(words.tobytes() if len(words) else b"-" + content).digest()[:16]


def identities(part: pa.RecordBatch, text: str) -> tuple[list[np.ndarray], list[pa.Array]]:
    """Word hashes of each text, and its identity as two numbers."""
    flat, offsets = texts(part[text])
    hashes, bounds = word_hashes(flat, offsets)
    words = [hashes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    both = b"".join(identity(flat[offsets[i] : offsets[i + 1]].tobytes(), own) for i, own in enumerate(words))
    halves = np.frombuffer(both, "<i8").reshape(-1, 2)
    return words, [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]


KEYS = [f"k{i}" for i in range(SKETCHES)]


def described(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``(row, id, high, low, n, words, k0, k1, ...)``: words as 16-bit hashes, for alignment; keys for buckets.

    ``row`` numbers rows without clashes; it is fixed once the table is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches, text):
            every, sig = identities(part, text)
            count, words, keys = [], [], []
            for own in every:
                rows = shingles(own)
                count.append(len(rows))
                words.append((own >> U(48)).astype("<u2").tobytes())
                keys.append(order_minhash(rows, SKETCHES).astype(np.int64) if len(own) > SHINGLE else None)
            columns = [pa.array([None if k is None else int(k[i]) for k in keys], pa.int64()) for i in range(SKETCHES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + part.num_rows)), part[key].cast(pa.int64()), *sig, pa.array(count, pa.int64()), pa.array(words, pa.binary()), *columns], ["row", "id", "high", "low", "n", "words", *KEYS])
            row += part.num_rows

    return docs.select(key, text).mapInArrow(run, "row long, id long, high long, low long, n long, words binary, " + ", ".join(f"{k} long" for k in KEYS))


def signatures(docs: DataFrame, text: str, high: str, low: str) -> DataFrame:
    """``docs`` with the identity of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, *identities(part, text)[1]], [*part.schema.names, high, low])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(high, T.LongType()), T.StructField(low, T.LongType())]))


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Share of shingles that a banded alignment matches; 0 where it can't reach ``least``.

    The alignment is a bit-parallel longest common subsequence whose matches are limited to the band.
    """
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n < least * m or not n:
        return 0.0
    both = n + m
    needed = math.ceil(both * least / (1 + least) - 1e-9)
    # no alignment matches more than the two multisets share
    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    ordered = np.sort(a)
    in_a = np.searchsorted(ordered, values, "right") - np.searchsorted(ordered, values)
    if np.minimum(in_a, counts - in_a).sum() < needed:
        return 0.0
    band = int(both - 2 * needed)
    same = a == b[:n]
    head = int(np.argmin(same)) if not same.all() else n
    tail_same = a[head:][::-1] == b[m - (n - head) :][::-1]
    tail = int(np.argmin(tail_same)) if not tail_same.all() else n - head
    own, other = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    aligned = head + tail
    if own:
        aligned += in_band(own, other, band)
    return aligned / (both - aligned) if aligned >= needed else 0.0


def in_band(own: list[int], other: list[int], band: int) -> int:
    """Length of the longest common subsequence of places that are at most ``band`` apart.

    One bit for each place of the band, 0 where the length grows; the window moves along with the rows, so a row costs
    the band and not the text. Bits that leave the window are final, those that enter are still 1.
    """
    places: dict[int, list[int]] = {}
    for j, x in enumerate(other):
        places.setdefault(x, []).append(j)
    width = 2 * band + 1
    full = row = (1 << width) - 1
    base, out = -band, 0
    for i, x in enumerate(own):
        at = places.get(x)
        if at is None:
            continue
        low = i - band
        marks = 0
        for j in at[bisect_left(at, low) :]:
            if j > i + band:
                break
            marks |= 1 << (j - low)
        if not marks:
            continue
        if (moved := low - base) > 0:
            gone = row & ((1 << moved) - 1) if moved < width else row
            out += min(moved, width) - gone.bit_count()
            row = (row >> moved) | (full ^ (full >> moved))
            base = low
        hit = row & marks
        row = ((row + hit) | (row - hit)) & full
    return out + width - row.bit_count()


def band_of(n: F.Column, similarity: float) -> F.Column:
    """The bands of a shingle count: powers of two, and the next one where a partner may be in it."""
    own = F.floor(F.log2(n)).cast("int")
    return F.array_distinct(F.array(own, F.floor(F.log2(n / similarity)).cast("int")))


def prepared(data: bytes) -> np.ndarray:
    """Shingles of kept words."""
    return shingles(np.frombuffer(data, "<u2"))


def similar_among(data: list[bytes], component: np.ndarray, side: np.ndarray, crossed: bool, least: float) -> list[tuple[int, int]]:
    """Links (places of two members) that join all of the members' components that similar pairs join.

    ``data`` are 16-bit words; if ``crossed``, only pairs of different sides count. Pairs of one component
    are not looked at.
    """
    marks = [np.frombuffer(d, "<u2") for d in data]
    n = np.array([max(len(m) - SHINGLE + 1, min(len(m), 1)) for m in marks])
    bins = np.zeros((len(marks), BINS), np.int32)
    for k, m in enumerate(marks):
        bins[k] = np.bincount((shingles(m) >> U(54)).astype(np.int64), minlength=BINS)
    label, out = component.copy(), []
    for i in range(len(marks)):
        others = np.flatnonzero((label[i + 1 :] != label[i]) & (~crossed | (side[i + 1 :] != side[i]))) + i + 1
        small, large = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
        others = others[small >= least * large]
        needed = np.ceil((n[i] + n[others]) * least / (1 + least) - 1e-9)
        others = others[np.minimum(bins[i], bins[others]).sum(axis=1) >= needed]
        if not others.size:
            continue
        base = shingles(marks[i])
        for j in others.tolist():
            if label[j] != label[i] and similarity(base, shingles(marks[j]), least) >= least:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def near_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``(id, high, low)`` of each row of ``docs`` and ``(high, low, class_id)`` of each node; ids are never null (``NO_ID``). Both are kept."""
    table = keep(described(docs, text, key).withColumn("id", F.coalesce("id", F.lit(NO_ID))), "words")
    # copies of a text have the same count and keys, so any of them will do
    nodes = keep(table.groupBy("high", "low").agg(F.min("row").alias("node"), F.min("id").alias("rep"), *(F.min(c).alias(c) for c in ("n", *KEYS))), "nodes")
    bands = nodes.filter("k0 is not null").select("node", F.array(*KEYS).alias("keys"), F.explode(band_of(F.col("n"), least)).alias("band"))
    buckets = bands.select("node", "band", F.posexplode("keys").alias("place", "own")).select(F.xxhash64("place", "own", "band").alias("key"), F.col("node").alias("id"))
    content = table.select(F.col("row").alias("id"), F.col("words").alias("data"))
    classes = link_classes(buckets, content, prepared, lambda a, b: similarity(a, b, least) >= least, lambda *block: similar_among(*block, least))
    tied = nodes.select("high", "low", "rep", F.col("node").alias("own")).join(classes.hint("merge"), F.col("own") == F.col("node"), "left")
    tied = tied.select("high", "low", "rep", F.coalesce("component", "own").alias("component"))
    least_id = tied.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = keep(tied.join(least_id.hint("merge"), "component").select("high", "low", "class_id"), "classes")
    rows = keep(table.select("id", "high", "low"), "rows")
    drop(table, nodes, classes)
    return rows, named


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """``(key, class_id, class_size, kept)``, one row for each row of ``docs``."""
    rows, named = near_classes(docs, text, key, least)
    classes = keep(rows.join(named.hint("merge"), ["high", "low"]).select("id", "class_id"), "members")
    drop(rows, named)
    # written first: then nothing but the join itself needs a large class together, and Spark splits it
    sizes = keep(classes.groupBy("class_id").agg(F.count("*").alias("class_size")), "sizes")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return classes.join(sizes.hint("merge"), "class_id").select(real("id").alias(key), real("class_id").alias("class_id"), "class_size", (F.col("id") == F.col("class_id")).alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class, the one of the least id, with all its columns."""
    rows, named = near_classes(docs, text, key, least)
    own, high, low = (unused(docs, c) for c in ("kept_id", "kept_high", "kept_low"))
    # of several texts of a class's least id, the one of the least identity
    first = rows.join(named.hint("merge"), ["high", "low"]).filter(F.col("id") == F.col("class_id")).select("class_id", "high", "low").distinct()
    first = first.groupBy("class_id").agg(F.min(F.struct("high", "low")).alias("sig"))
    kept = keep(first.select(F.col("class_id").alias(own), F.col("sig.high").alias(high), F.col("sig.low").alias(low)), "kept")
    drop(rows, named)
    marked = signatures(docs, text, high, low).withColumn(own, F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)))
    return marked.join(kept.hint("merge"), [own, high, low], "left_semi").dropDuplicates([own, high, low]).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
