"""Order MinHash fingerprints of documents (operator 1).

A text's k-mers of code points are numbered by occurrence, so that repeats differ. For each of
``SKETCHES`` hash functions the ``TUPLE`` smallest labelled k-mers are selected, put back in text
order, and the tuple is hashed to 32 bits. Two fingerprints' likeness is the share of equal
entries; it falls with edit distance, not only with the overlap of content.

The query pairs each document with the next one in descending id order without a global sort in
one task: ids are cut into ranges at quantiles, one shuffle brings every range together in order, and the
first document of each range also goes to the end of the range before it. Tasks stream rows and keep
one predecessor only.

Defined results: null and empty text have the fingerprint of no k-mers; a text shorter than k is
one k-mer; equal texts have equal fingerprints; null ids come last; rows of one id are ordered by
their text's hash; a single row's next document is itself; an empty table gives an empty result; only
the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.llm.store import partitions
from codexa.llm.text import U, mix, seeds, slices, window_hashes

K = 8
TUPLE = 2
SKETCHES = 64
#: Elements of the block of hash values that is compared at a time.
BLOCK = 1 << 17
#: Id ranges for each shuffle partition.
RANGES = 4
FACTORS, SHIFTS = seeds(SKETCHES, 1).astype(np.uint32), (seeds(SKETCHES, 2) >> U(32)).astype(np.uint32)
LOWEST = -(1 << 63)


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, occurrence number) pairs, in text order; they depend on the k-mer and its number alone."""
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    occurrence = np.zeros(len(hashes), U)
    if twice.size:
        known = np.unique(twice)
        at = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)
        order = at[np.argsort(hashes[at], kind="stable")]
        kmer = hashes[order]
        first = np.concatenate([[True], kmer[1:] != kmer[:-1]])
        occurrence[order] = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return mix(hashes + occurrence * U(0xD1342543DE82EF95))


def few(room: np.ndarray, values: np.ndarray, limit: np.uint32) -> np.ndarray:
    """Places of the few values up to a limit; eight flags at a time are passed over if none is set."""
    np.less_equal(values, limit, out=room[: len(values)])
    room[len(values) :] = False
    eights = np.flatnonzero(room.view(U))
    at, bit = np.nonzero(room.reshape(-1, 8)[eights])
    return eights[at] * 8 + bit


def order_minhash(hashes: np.ndarray, sketches: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """One 64-bit signature entry for each sketch, from the k-mer hashes in text order.

    A sketch's order of labels is a 32-bit multiply-add of their upper halves. Only values below a
    limit that some dozen labels are expected to meet are looked at further.
    """
    n = len(hashes)
    if not n:
        return np.zeros(sketches, U)
    label = labelled(hashes)
    upper, out = (label >> U(32)).astype(np.uint32), np.empty(sketches, U)
    take, limit = min(size, n), np.uint32(min(2**32 - 1, int(9.0 * size / n * 2**32)))
    step = max(1, min(sketches, BLOCK // n))
    room, below = np.empty((step, n), np.uint32), np.zeros(-(-step * n // 8) * 8, bool)
    for at in range(0, sketches, step):
        rows = min(step, sketches - at)
        value = room[:rows]
        np.multiply(upper, FACTORS[at : at + rows, None], out=value)
        np.add(value, SHIFTS[at : at + rows, None], out=value)
        row, col = np.divmod(few(below, value.ravel(), limit), n)
        least = np.bincount(row, minlength=rows)
        if (short := np.flatnonzero(least < take)).size:
            # by chance too few are below the limit: these rows are searched whole
            keep = ~np.isin(row, short)
            more = np.argsort(value[short], axis=1)[:, :take]
            row, col = np.concatenate([row[keep], np.repeat(short, take)]), np.concatenate([col[keep], more.ravel()])
            least = np.bincount(row, minlength=rows)
        order = np.argsort(row.astype(U) << U(32) | value[row, col])
        chosen = col[order][(np.cumsum(least) - least)[:, None] + np.arange(take)]
        tuples = label[np.sort(chosen, axis=1)]
        entry = np.zeros(rows, U)
        for r in range(take):
            entry = mix(entry * U(31) + tuples[:, r] + U(r + 1))
        out[at : at + rows] = entry
    return out


def kmers(units: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all k-mers; a text shorter than k is one."""
    return window_hashes(units, min(k, len(units))) if len(units) else np.zeros(0, U)


def signature(hashes: np.ndarray) -> np.ndarray:
    """A fingerprint from k-mer hashes, 32 bits for each sketch."""
    return (order_minhash(hashes) >> U(32)).astype(np.uint32)


def code_units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fingerprint(text: str, k: int = K) -> np.ndarray:
    """The signature of a text, 32 bits for each sketch."""
    return signature(kmers(code_units(text), k))


def edited_kmers(own: np.ndarray, own_kmers: np.ndarray, third: int, following: np.ndarray, k: int = K) -> np.ndarray:
    """K-mers of a text whose last third is replaced by a start; those that lie before the edit are kept."""
    stay = len(own) - third
    if stay < k:
        return kmers(np.concatenate([own[:stay], following[:third]]), k)
    return np.concatenate([own_kmers[: stay - k + 1], kmers(np.concatenate([own[stay - k + 1 : stay], following[:third]]), k)]) if third and len(following) else own_kmers[: stay - k + 1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries, 0 to 1."""
    return float(np.mean(a == b))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, fingerprint)`` of each row, 8 hex digits for each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            marks = [as_hex(fingerprint(t or "")) for t in part[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([part[key].cast(pa.int64()), pa.array(marks)], [key, "fingerprint"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, fingerprint string")


def as_hex(entries: np.ndarray) -> str:
    return entries.astype(">u4").tobytes().hex()


def with_next(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``(rng, id, carried, text)`` in order within each partition, with each range's successor."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    place = F.coalesce("id", F.lit(LOWEST))
    n = RANGES * partitions(spark)
    cuts = rows.select(place.alias("p")).approxQuantile("p", [i / n for i in range(1, n)], 0.2 / n)
    cuts = np.unique(np.array(cuts, np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def range_of(p):
        import pandas as pd

        return pd.Series(len(cuts) - np.searchsorted(cuts, p.to_numpy(), "right")).astype("int32")

    # one row for each range: its first id in descending order
    heads = sorted((r["rng"], r["top"]) for r in rows.select(place.alias("p")).groupBy(range_of("p").alias("rng")).agg(F.max("p").alias("top")).collect())
    before = {top: heads[i - 1][0] for i, (_, top) in enumerate(heads)}  # the last range ends with the first document
    ranged = rows.select(range_of(place).alias("rng"), "id", F.lit(False).alias("carried"), "text")
    tops = spark.createDataFrame(list(before.items()) or [(0, 0)], "top long, rng int")  # as many rows as ranges
    carried = rows.join(F.broadcast(tops), place == F.col("top")).select("rng", "id", F.lit(True).alias("carried"), "text")
    dealt = ranged.unionByName(carried).repartition(partitions(spark), "rng")
    return dealt.sortWithinPartitions("rng", "carried", F.coalesce("id", F.lit(LOWEST)).desc(), F.xxhash64("text"))


def edited_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to it and the next text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rng, closed = None, None, False
        for part in slices(batches, "text"):
            out = []
            for own_rng, own_id, carried, own in zip(*(part[c].to_pylist() for c in ("rng", "id", "carried", "text")), strict=True):
                if own_rng != rng:
                    last, rng, closed = None, own_rng, False
                if closed:
                    continue  # further rows of a carried id
                units = code_units(own)
                hashes = kmers(units)
                mark = signature(hashes)
                if last is not None:
                    out.append(compared(*last, own, units, mark))
                last, closed = (own_id, own, units, hashes, mark), carried
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], [key, *NAMES])

    return with_next(docs, text, key).mapInArrow(run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def compared(own_id: int | None, own: str, units: np.ndarray, hashes: np.ndarray, mark: np.ndarray, following: str, following_units: np.ndarray, following_mark: np.ndarray) -> tuple:
    """A result row: ``own`` with its last third replaced by the start of ``following``."""
    third = len(own) // 3
    edited = own[: len(own) - third] + following[:third]
    edited_mark = signature(edited_kmers(units, hashes, third, following_units)) if edited != own else mark
    return own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), as_hex(mark), as_hex(edited_mark), likeness(mark, edited_mark), likeness(mark, following_mark)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
