"""Quality classifier: a factorisation machine over hashed words and structure (operator 10).

Inputs of a score are a text's hashed words (log frequency, unit length), one-hot bins of structure
statistics (shares of character kinds, word shapes, repetition) and one-hot bins of length metadata;
never labels, language, source or id. Pairwise interactions have rank ``RANK`` and are summed in linear
time by the sum-of-squares identity. Training uses labelled rows outside the held-out fold, at most
``SAMPLE`` of them, those of the least id hash, whose features alone reach the driver. Scoring is one
scan without a shuffle.

Defined results: null and empty texts score by their structure alone; labels that are null or belong
to no document are ignored, several for one document count by their mean; without usable labels every
score is 0.5; repeated rows give repeated rows; an empty table gives an empty result; only the id
and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexa.llm.text import ASCII_SPACE, LOWER, U, runs, slices, span_hashes, texts

#: Labelled rows that training reads at most.
SAMPLE = 6000
WORD_BITS = 14
BINS = 16
RANK = 8
EPOCHS = 12
#: Small samples are passed over more often, up to this many batches in all.
STEPS = 600
BATCH = 128
RATE = 0.05
DECAY = 1e-5
THRESHOLD = 0.3
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#$%&*+<=>@[]^_`{|}~\\/", np.uint8))
STOPS = np.isin(np.arange(256), np.frombuffer(b".,;:'\"()-", np.uint8))
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
STATS = 12
WIDTH = (1 << WORD_BITS) + STATS * BINS


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offset:next offset]."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of all texts: (bounds, indices, values)."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    starts, ends, owner = runs(~ASCII_SPACE[flat], offsets)
    words = np.bincount(owner, minlength=n)
    hashes = span_hashes(LOWER[flat], starts, ends)
    # word counts of each text
    key = np.sort((owner.astype(U) << U(WORD_BITS)) | (hashes >> U(64 - WORD_BITS)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    text, index = (key[first] >> U(WORD_BITS)).astype(np.int64), (key[first] & U((1 << WORD_BITS) - 1)).astype(np.int64)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(text, value**2, n))
    value = value / np.maximum(norm[text], 1e-9)
    # structure
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    length = ends - starts
    tail = flat[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    caps = sums(UPPER[flat], offsets)
    distinct = np.bincount(text, minlength=n)
    upper_word = np.zeros(len(starts), bool)
    if len(starts):
        ups = np.concatenate([[0], np.cumsum(UPPER[flat])])
        upper_word = (ups[ends] - ups[starts]) * 2 > length
    share = [
        caps * per_byte,
        sums(DIGIT[flat], offsets) * per_byte,
        sums(SYMBOLS[flat], offsets) * per_byte * 2,
        sums(STOPS[flat], offsets) * per_byte * 4,
        sums(flat == 33, offsets) * per_byte * 4,
        sums(flat >= 128, offsets) * per_byte,
        np.bincount(owner, SYMBOLS[tail], n) * per_word,
        np.bincount(owner, upper_word, n) * per_word,
        distinct * per_word,
        np.bincount(owner, length, n) * per_word / 16,
    ]
    bins = [np.minimum(BINS - 1, (np.sqrt(s) * BINS).astype(np.int64)) for s in share]
    bins += [np.minimum(BINS - 1, np.log2(words + 1).astype(np.int64)), np.minimum(BINS - 1, (np.log2(sums(flat == 10, offsets) + 1) * 1.5).astype(np.int64))]
    base = (1 << WORD_BITS) + np.arange(STATS) * BINS
    stat = np.stack(bins, axis=1) + base
    # one flat table, by text
    rows = np.concatenate([text, np.repeat(np.arange(n), STATS)])
    index, value = np.concatenate([index, stat.ravel()]), np.concatenate([value, np.full(n * STATS, 0.5)])
    order = np.argsort(rows, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return bounds, index[order], value[order]


class Machine:
    """Bias, linear weights and factors of a factorisation machine with a logistic loss."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bias, self.linear = 0.0, np.zeros(WIDTH, np.float64)
        self.factors = rng.normal(0, 0.02, (WIDTH, RANK))

    def margins(self, bounds: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margin of each row and its factor sums: half of (sum of v x) squared less the sum of squares."""
        weighted = self.factors[index] * value[:, None]
        linear = np.add.reduceat(self.linear[index] * value, bounds[:-1])
        total = np.add.reduceat(weighted, bounds[:-1], axis=0)
        squares = np.add.reduceat((weighted**2).sum(axis=1), bounds[:-1])
        return self.bias + linear + 0.5 * ((total**2).sum(axis=1) - squares), total

    def scores(self, bounds: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        if len(bounds) == 1:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margins(bounds, index, value)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11) -> None:
        """AdaGrad over shuffled small batches."""
        rng = np.random.default_rng(seed)
        rate = np.clip(labels.mean(), 0.01, 0.99)
        self.bias = float(np.log(rate / (1 - rate)))
        seen_linear, seen_factors, seen_bias = np.full(WIDTH, 1e-6), np.full((WIDTH, RANK), 1e-6), 1e-6
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)))):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                index, value = (np.concatenate([rows[i][k] for i in own]) for k in (0, 1))
                bounds = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in own])])
                margin, total = self.margins(bounds, index, value)
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[own]) / len(own)
                each = np.repeat(error, np.diff(bounds)) * value
                unique, back = np.unique(index, return_inverse=True)
                linear = np.bincount(back, each, len(unique)) + DECAY * self.linear[unique]
                pair = each[:, None] * (np.repeat(total, np.diff(bounds), axis=0) - self.factors[index] * value[:, None])
                factor = np.stack([np.bincount(back, pair[:, f], len(unique)) for f in range(RANK)], axis=1) + DECAY * self.factors[unique]
                seen_linear[unique] += linear**2
                seen_factors[unique] += factor**2
                seen_bias += error.sum() ** 2
                self.linear[unique] -= RATE * linear / np.sqrt(seen_linear[unique])
                self.factors[unique] -= RATE * factor / np.sqrt(seen_factors[unique])
                self.bias -= RATE * error.sum() / np.sqrt(seen_bias)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", folds: int = 5, sample: int = SAMPLE) -> Machine:
    """A machine fitted to at most ``sample`` labelled rows outside fold 0."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key), folds) != 0))
    usable = usable.groupBy(F.col(key).alias("id")).agg(F.round(F.avg(label)).cast("double").alias("label"))
    drawn = usable.orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            bounds, index, value = features(*texts(part["text"]))
            cut = [(index[a:b].astype("<i4").tobytes(), value[a:b].astype("<f4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part["id"], part["label"], pa.array([c[0] for c in cut]), pa.array([c[1] for c in cut])], ["id", "label", "idx", "val"])

    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    got = own.join(F.broadcast(drawn), "id").select("id", "label", "text").mapInArrow(run, "id long, label double, idx binary, val binary")
    # an id that several documents have brings as many rows: the bound holds for them all
    got = got.orderBy("id", "idx").limit(sample).collect()
    got.sort(key=lambda r: (r["id"], r["idx"]))
    machine, marks = Machine(), np.array([r["label"] for r in got])
    if not len(marks) or marks.min() == marks.max():
        machine.factors[:] = 0
        if len(marks):
            machine.bias = 6.0 if marks[0] else -6.0
        return machine
    machine.fit([(np.frombuffer(r["idx"], "<i4"), np.frombuffer(r["val"], "<f4").astype(np.float64)) for r in got], marks)
    return machine


def unused(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores as keep it apart from the columns that are there."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def score(docs: DataFrame, machine: Machine, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, then the score and the prediction; their names are the last two."""
    schema = T.StructType([*docs.schema.fields, T.StructField(unused(docs, "score"), T.DoubleType()), T.StructField(unused(docs, "predicted"), T.IntegerType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            own = machine.scores(*features(*texts(part[text])))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own), pa.array((own >= threshold).astype(np.int32))], names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 5) -> DataFrame:
    """``(key, held_out, score, predicted)`` of each row."""
    machine = train(docs, labels, text, key, folds=folds)
    scored = score(docs.select(key, text), machine, text, key)
    return scored.select(key, (fold(F.col(key), folds) == 0).alias("held_out"), F.col(scored.columns[-2]).alias("score"), F.col(scored.columns[-1]).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, all columns as they were."""
    scored = score(docs, train(docs, labels, text, key), text, key)
    return scored.filter(F.col(scored.columns[-1]) == 1).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
