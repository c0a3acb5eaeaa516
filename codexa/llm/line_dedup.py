"""Line deduplication by a log-template tree (operator 3).

The tree has fixed depth: token count, then the first ``LEADING`` tokens, then groups of alike lines. Tokens with
digits, an at sign or ``://`` are variable fields, unless that is most of the line. Two lines of a leaf (same count, same
leading tokens) are alike if they agree in at least ``CONSTANT`` of their places; lines of ``CONSTANT_TOKENS`` tokens or
more form groups, the connected components of alike lines. A group's template keeps the tokens of the places where
all its lines agree, the other places are variable fields; a line that is alike to none is its own template. A template
recurs if enough different documents have a line of it: ``MIN_DOCS``, or ``LONG_DOCS`` for lines of ``LONG`` tokens
or more. Documents of equal texts count as one: a template that only copies of one text have does not recur. The lines
of a recurring template are dropped from all documents but the one of the least id.

Alike lines are found without loss: lines that differ in v places at most agree in one of the v + 1 segments that the tokens
after the leading ones are cut into, so (leaf, segment, content) is a key that ``linking`` takes candidates from; the
comparison is of all tokens, as 16-bit hashes. Nothing gathers a leaf, no line is written once a token, and no map
of fixed size is kept. One scan reads the texts.

Defined results: null text is empty text; blank lines stay; a line's number counts from 0; rows that
agree in id and text are one document and get the same result; null ids are least; an empty table
gives an empty result; only the id and the text are read (``cleaned`` passes other columns through, whatever
their names). Lines and texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexa.llm.linking import link_classes
from codexa.llm.quality import unused
from codexa.llm.store import drop, keep
from codexa.llm.text import ASCII_SPACE, U, HashIndex, gather, mix, runs, slices, span_hashes, texts

LEADING = 2
MIN_DOCS = 5
LONG, LONG_DOCS = 20, 2
CONSTANT, CONSTANT_TOKENS = 0.8, 5
#: Different lines that a task remembers, so as to hand on a line's tokens once.
REMEMBERED = 1 << 20
NEWLINE = 10
FIELD = U(0xF1E1D)
NO_ID = -(1 << 63)
MARKS = np.zeros(256, bool)
MARKS[[*range(48, 58), ord("@")]] = True


def parse(flat: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All lines with tokens: text, number, leaf, full hash, tokens and where they begin; ``same`` are the hashes of the texts."""
    starts, ends, _ = runs(~ASCII_SPACE[flat], offsets)
    hashes = span_hashes(flat, np.concatenate([offsets[:-1], starts]), np.concatenate([offsets[1:], ends]))
    same, token = hashes[: len(offsets) - 1], hashes[len(offsets) - 1 :]
    marks = np.concatenate([[0], np.cumsum(MARKS[flat])])
    colon = np.zeros(len(flat) + 1, np.int64)
    if len(flat) > 2:
        colon[1:-2] = np.cumsum((flat[:-2] == 58) & (flat[1:-1] == 47) & (flat[2:] == 47))
        colon[-2:] = colon[-3]
    field = (marks[ends] > marks[starts]) | (colon[np.maximum(ends - 2, starts)] > colon[starts])
    breaks = np.cumsum(flat == NEWLINE)
    breaks = np.concatenate([[0], breaks])
    text = np.searchsorted(offsets, starts, "right") - 1
    number = breaks[starts] - breaks[offsets[text]]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (number[1:] != number[:-1])])) if len(starts) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(starts)) if len(first) else first
    n = last - first
    fields = np.concatenate([[0], np.cumsum(field)])
    mostly = np.repeat(2 * (fields[last] - fields[first]) > n, n)
    token = np.where(field & ~mostly, FIELD, token)
    full = span_hashes(token, first, last)
    leaf = mix(span_hashes(token, first, first + np.minimum(n, LEADING)) + mix(n.astype(U)))
    return {"text": text[first], "number": number[first], "n": n, "full": full, "leaf": leaf, "first": first, "token": token, "same": same}


def fields_of(n: np.ndarray) -> np.ndarray:
    """How many places of lines of ``n`` tokens may differ."""
    return np.floor(n * (1 - CONSTANT) + 1e-9).astype(np.int64)


def segments(got: dict[str, np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the segments of the lines ``own``, and how many each has."""
    n = got["n"][own]
    count = fields_of(n) + 1
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    size, parts, base = (np.repeat(x, count) for x in (n - LEADING, count, got["first"][own] + LEADING))
    content = span_hashes(got["token"], base + k * size // parts, base + (k + 1) * size // parts)
    return mix(content + mix(np.repeat(got["leaf"][own], count) + k.astype(U))), count


KIND = "id long, same long, number int, n int, full long, keys array<long>, tokens binary"


def lines_of(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``(id, same, number, n, full, keys, tokens)``, a row for each line with tokens; ``same`` is the text's hash.

    Segment keys and tokens (16-bit hashes) are on one row for each different line that a task meets. A further row for
    each document has number -1 and the number of its lines as ``n``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in KIND.split(", ")]
        long, short = (lambda a: pa.array(a.astype(np.int64))), (lambda a: pa.array(a.astype(np.int32)))
        seen = HashIndex()
        for part in slices(batches, text):
            if seen.n > REMEMBERED:
                seen = HashIndex()
            flat, offsets = texts(part[text])
            got = parse(flat, offsets)
            ids, same, own = part[key].cast(pa.int64()), got["same"], got["text"]
            able = np.flatnonzero(got["n"] >= CONSTANT_TOKENS)
            new = np.sort(able[seen.number(got["full"][able])[1]]) if able.size else able
            hashes, count = segments(got, new) if new.size else (np.zeros(0, U), new)
            size = np.zeros(len(own), np.int64)
            size[new] = count
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), long(hashes))
            size[new] = got["n"][new]
            data = (got["token"][gather(got["first"][new], got["n"][new])] >> U(48)).astype("<u2")
            tokens = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.concatenate([[0], 2 * np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([ids.take(long(own)), long(same[own]), short(got["number"]), short(got["n"]), long(got["full"]), keys, tokens], names)
            breaks = np.concatenate([[0], np.cumsum(flat == NEWLINE)])
            none = lambda kind: pa.nulls(part.num_rows, kind)
            yield pa.RecordBatch.from_arrays([ids, long(same), short(np.full(part.num_rows, -1)), short(breaks[offsets[1:]] - breaks[offsets[:-1]] + 1), none(pa.int64()), none(pa.list_(pa.int64())), none(pa.binary())], names)

    return docs.select(key, text).mapInArrow(run, KIND).withColumn("id", F.coalesce("id", F.lit(NO_ID)))


def prepared(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two lines of one leaf agree in enough places."""
    return len(a) == len(b) and bool((a[:LEADING] == b[:LEADING]).all()) and int((a != b).sum()) <= int(fields_of(np.array(len(a))))


def alike_among(data: list[bytes], component: np.ndarray, side: np.ndarray, crossed: bool) -> list[tuple[int, int]]:
    """Links (places of two lines) that join all components that alike lines join; if ``crossed``, of different sides only."""
    label, out, sizes = component.copy(), [], np.array([len(d) for d in data])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        tokens = np.stack([prepared(data[i]) for i in at])
        most = fields_of(np.array(size // 2))
        for k, i in enumerate(at):
            others = np.arange(k + 1, len(at))
            others = others[(label[at[others]] != label[i]) & (~np.bool_(crossed) | (side[at[others]] != side[i]))]
            differ = tokens[others] != tokens[k]
            for j in at[others[(differ.sum(axis=1) <= most) & ~differ[:, :LEADING].any(axis=1)]]:
                if label[j] != label[i]:
                    out.append((int(i), int(j)))
                    label[label == label[j]] = label[i]
    return out


def enough(docs: str = "docs", n: str = "n") -> F.Column:
    return F.col(docs) >= F.when(F.col(n) >= LONG, LONG_DOCS).otherwise(MIN_DOCS)


def dropped_lines(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """All documents ``(id, n_lines, same)``, and ``(id, same, numbers)`` of the lines that go; both are kept."""
    lines = keep(lines_of(docs, text, key), "lines")
    first = lines.filter(F.size("keys") > 0)
    groups = link_classes(first.select(F.explode("keys").alias("key"), F.col("full").alias("id")), first.select(F.col("full").alias("id"), F.col("tokens").alias("data")), prepared, alike, alike_among)
    real = lines.filter("number >= 0").select("id", "same", "number", "n", "full")
    named = real.join(groups.hint("merge"), F.col("full") == F.col("node"), "left").select("id", "same", "number", "n", F.coalesce("component", "full").alias("template"))
    often = named.groupBy("template", "same").agg(F.min("n").alias("n")).groupBy("template").agg(F.count("*").alias("docs"), F.min("n").alias("n")).filter(enough()).select("template")
    hit = keep(named.join(often.hint("merge"), "template", "left_semi").select("id", "same", "number", "template"), "hits")
    least = hit.groupBy("template").agg(F.min("id").alias("least"))
    mine = hit.join(least.hint("merge"), "template").filter("id = least").groupBy("template").agg(F.min("same").alias("its"), F.min("id").alias("least"))
    gone = hit.join(mine.hint("merge"), "template").filter((F.col("id") != F.col("least")) | (F.col("same") != F.col("its")))
    gone = keep(gone.groupBy("id", "same").agg(F.array_sort(F.collect_set("number")).alias("numbers")), "gone")
    heads = keep(lines.filter("number = -1").select("id", "same", F.col("n").cast("long").alias("n_lines")), "heads")
    drop(lines, groups, hit)
    return heads, gone


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_lines, n_dropped, dropped_lines)``, one row for each row of ``docs``."""
    heads, gone = dropped_lines(docs, text, key)
    numbers = F.coalesce("numbers", F.array().cast("array<int>"))
    real = F.when(F.col("id") != NO_ID, F.col("id")).alias(key)
    return heads.join(gone.hint("merge"), ["id", "same"], "left").select(real, "n_lines", F.size(numbers).cast("long").alias("n_dropped"), numbers.alias("dropped_lines"))


def cleaned(docs: DataFrame, text: str = "text", key: str = "doc_id", length: str | None = "n_chars") -> DataFrame:
    """``docs`` without the dropped lines; documents of which nothing but white space is left go.

    Rows that lose no line stay as they are; ``length``, if there is such a column, is counted anew.
    """
    heads, gone = dropped_lines(docs, text, key)
    drop(heads)
    own, same, numbers, names = unused(docs, "own_id"), unused(docs, "same"), unused(docs, "numbers"), docs.columns
    known = T.StructType([*docs.schema.fields, T.StructField(own, T.LongType()), T.StructField(same, T.LongType())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            flat, offsets = texts(part[text])
            yield pa.RecordBatch.from_arrays([*part.columns, part[key].cast(pa.int64()).fill_null(NO_ID), pa.array(span_hashes(flat, offsets[:-1], offsets[1:]).astype(np.int64))], [*names, own, same])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            out = []
            for own, lost in zip(part[text].to_pylist(), part[numbers].to_pylist(), strict=True):
                if lost:
                    drop = set(lost)
                    own = "\n".join(line for at, line in enumerate(own.split("\n")) if at not in drop)
                out.append(own)
            stay = np.array([not lost or bool(own.strip()) for own, lost in zip(out, part[numbers].to_pylist(), strict=True)], bool)
            columns = {c: part[c] for c in names} | {text: pa.array(out, pa.string())}
            if length in columns:
                fresh = [n if not lost else len(own) for n, own, lost in zip(part[length].to_pylist(), out, part[numbers].to_pylist(), strict=True)]
                columns[length] = pa.array(fresh, part[length].type)
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns]).filter(pa.array(stay))

    marked = docs.mapInArrow(name, known).join(gone.select(F.col("id").alias(own), F.col("same").alias(same), F.col("numbers").alias(numbers)).hint("merge"), [own, same], "left")
    return marked.select(*(F.col(f"`{c}`") for c in names), numbers).mapInArrow(cut, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
