"""Language-model scores by logistic context mixing, and a unigram base (operator 6).

A text is a string of UTF-8 bytes and an end byte; each byte is eight binary decisions. Bit
predictors of orders 0 to ``ORDER`` look up counts of zeros and ones under a hash of the preceding
bytes and the bits so far. Their stretched probabilities are combined by weights that a gate selects
(bit position and the longest context seen before), and an adaptive probability map, selected by the
bits so far, refines the result. What a byte costs depends on its window of ``ORDER`` + 1 bytes
only, so windows are the unit of counting, training and scoring.

1. One scan of the training texts counts windows and words, first within a task, then by key over the
   whole corpus: what moves grows with the number of distinct windows and words.
2. Windows are added up into ``2**SLOT_BITS`` hashed slots: the one model table, of fixed size.
3. Each task of the window table learns mixing weights online, in small steps, weighted by count;
   an example's own occurrence is taken out of the counts first. Tasks' weights are averaged by how
   much each has seen, twice; then the tasks' probability maps are added up.
4. One scan scores every text. The base looks up the ``HOT_WORDS`` most frequent words in a broadcast
   table of that size at most; all other words go through an exact join with their corpus counts.

Defined results: null and empty text are the end byte and the end token alone; a null id is held out;
repeated rows give repeated rows; without training texts all counts are 0; an empty table gives
an empty result; only the id and the text are read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.llm.quality import fold
from codexa.llm.store import keep
from codexa.llm.text import ASCII_SPACE, LOWER, U, HashIndex, gather, mix, runs, slices, span_hashes, texts

FOLDS = 10
ORDER = 5
INPUTS = ORDER + 2
SLOT_BITS = 23
#: Distinct keys that a counting task holds before it hands them on.
HELD = 1_500_000
#: Words in the broadcast table at most; windows whose cost a worker remembers at most.
HOT_WORDS = 1 << 19
REMEMBERED = 1 << 21
END_BYTE = 0xFF
END_WORD = 1
PRIOR = 0.08
#: Step of the online weights, windows in a step, and passes with averaging between them.
RATES = (0.02, 0.008)
STEP_WINDOWS = 256
#: Weights of orders 0, 1, ... and of the constant input before learning.
FIRST_WEIGHTS = (0.0, 0.0, 0.1, 0.2, 0.35, 0.45, 0.0)
MAP_STEPS = 32
MAP_LIMIT = 8.0
MAP_PRIOR = 30.0
WINDOW, WORD = 0, 1


def windows(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all bytes of all texts, end bytes included, and n+1 bounds."""
    size = np.diff(offsets)
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    padded = np.full(int(bounds[-1]) + ORDER * len(size), END_BYTE, np.uint8)
    into = gather(bounds[:-1] + ORDER * np.arange(1, len(size) + 1), size)
    padded[into] = flat
    out = np.zeros(max(0, len(padded) - ORDER), U)
    for k in range(ORDER + 1):
        out = (out << U(8)) | padded[k : k + len(out)]
    own = gather(bounds[:-1] + ORDER * np.arange(len(size)), size + 1)
    return out[own], bounds


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words and the number of each one's text."""
    starts, ends, owner = runs(~ASCII_SPACE[flat], offsets)
    return span_hashes(LOWER[flat], starts, ends) | U(2), owner


class Counter:
    """Counts by 64-bit key, for whole arrays of keys."""

    def __init__(self) -> None:
        self.index, self.keys, self.counts = HashIndex(1 << 20), [], np.zeros(1 << 16, np.int64)

    def add(self, keys: np.ndarray) -> None:
        number, new = self.index.number(mix(keys))
        self.keys.append(keys[new])
        while len(self.counts) < self.index.n:
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[: self.index.n] += np.bincount(number, minlength=self.index.n)

    def rows(self, kind: int) -> Iterator[pa.RecordBatch]:
        # keys get their numbers in the order of their mixed hashes within each call of add()
        if not self.index.n:
            return
        keys = np.concatenate(self.keys).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(self.counts[: len(keys)])], ["kind", "key", "n"])


def corpus_counts(docs: DataFrame, text: str) -> DataFrame:
    """``(kind, key, n)``: how often each window and each word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter(), Counter()]
        for part in slices(batches, text):
            flat, offsets = texts(part[text])
            held[WINDOW].add(windows(flat, offsets)[0])
            held[WORD].add(np.append(words(flat, offsets)[0], np.full(part.num_rows, END_WORD, U)))
            for kind in (WINDOW, WORD):
                if held[kind].index.n > HELD:
                    yield from held[kind].rows(kind)
                    held[kind] = Counter()
        for kind in (WINDOW, WORD):
            yield from held[kind].rows(kind)

    return docs.select(text).mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def slots(window: np.ndarray, bit: int) -> np.ndarray:
    """Slots of all orders for the given bit of each window's last byte, one row for each order."""
    node = (window & U(0xFF)) >> U(8 - bit) | U(1 << bit)
    out = np.empty((ORDER + 1, len(window)), np.int64)
    for order in range(ORDER + 1):
        context = (window >> U(8)) & U((1 << (8 * order)) - 1)
        out[order] = mix((context << U(8) | node) * U(0x9E3779B97F4A7C15) + U(order + 1)) >> U(64 - SLOT_BITS)
    return out


def slot_counts(counted: DataFrame) -> np.ndarray:
    """Zeros and ones of every slot, as a float16 table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            window, n = batch["key"].to_numpy().astype(U), batch["n"].to_numpy()
            at = np.empty((8, ORDER + 1, len(window)), np.int64)
            for bit in range(8):
                value = ((window >> U(7 - bit)) & U(1)).astype(np.int64)
                at[bit] = slots(window, bit) * 2 + value
            unique, back = np.unique(at.ravel(), return_inverse=True)
            total = np.bincount(back, np.broadcast_to(n, at.shape).ravel(), len(unique))
            yield pa.RecordBatch.from_arrays([pa.array(unique.astype(np.int32)), pa.array(total)], ["slot", "n"])

    rows = counted.mapInArrow(run, "slot int, n double").groupBy("slot").agg(F.sum("n").cast("float").alias("n"))
    table = np.zeros(2 << SLOT_BITS, np.float32)
    got = rows.toArrow()
    table[got["slot"].to_numpy()] = got["n"].to_numpy()
    pairs = table.reshape(-1, 2)
    pairs /= np.maximum(1.0, pairs.max(axis=1) / 60_000)[:, None]
    return pairs.astype(np.float16)


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Mixer:
    """Gated weights over the predictors, and the adaptive probability map."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.weights = np.tile(np.array(FIRST_WEIGHTS), (8, ORDER + 2, 1))
        self.map_sum = np.zeros((256, MAP_STEPS + 1))
        self.map_n = np.zeros((256, MAP_STEPS + 1))

    def inputs(self, window: np.ndarray, bit: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions (rows by windows) and the gate; ``without``: bits to take out once."""
        counts = self.table[slots(window, bit)].astype(np.float32)
        if without is not None:
            counts[..., 0] = np.maximum(0, counts[..., 0] - (1 - without))
            counts[..., 1] = np.maximum(0, counts[..., 1] - without)
        total = counts[..., 0] + counts[..., 1]
        x = np.empty((INPUTS, len(window)))
        x[:-1] = np.log((counts[..., 1] + PRIOR) / (counts[..., 0] + PRIOR))
        x[-1] = 0.3
        return x, (total > 0).sum(axis=0)

    def learn(self, window: np.ndarray, n: np.ndarray, rate: float) -> None:
        """One online step for each bit: the gradient of the coding cost, weighted by count."""
        share = n / n.sum()
        for bit in range(8):
            value = ((window >> U(7 - bit)) & U(1)).astype(np.float64)
            x, gate = self.inputs(window, bit, value)
            mixed = np.clip((self.weights[bit, gate] * x.T).sum(axis=1), -MAP_LIMIT, MAP_LIMIT)
            step = rate * len(n) * share * (value - squash(mixed))
            seen = np.maximum(1e-9, np.bincount(gate, share * len(n), ORDER + 2)) ** 0.5
            for k in range(INPUTS):
                self.weights[bit, :, k] += np.bincount(gate, step * x[k], ORDER + 2) / seen

    def observe(self, window: np.ndarray, n: np.ndarray) -> None:
        """Add to the map what followed each mixed prediction."""
        for bit in range(8):
            value = ((window >> U(7 - bit)) & U(1)).astype(np.float64)
            x, gate = self.inputs(window, bit, value)
            mixed = np.clip((self.weights[bit, gate] * x.T).sum(axis=1), -MAP_LIMIT, MAP_LIMIT)
            node = ((window & U(0xFF)) >> U(8 - bit) | U(1 << bit)).astype(np.int64)
            cell = node * (MAP_STEPS + 1) + np.round((mixed + MAP_LIMIT) * MAP_STEPS / (2 * MAP_LIMIT)).astype(np.int64)
            self.map_sum += np.bincount(cell, n * value, self.map_sum.size).reshape(self.map_sum.shape)
            self.map_n += np.bincount(cell, n, self.map_n.size).reshape(self.map_n.shape)

    def settle(self) -> None:
        """The map as stretched probabilities, drawn towards the step's own value where little was seen."""
        own = squash(np.linspace(-MAP_LIMIT, MAP_LIMIT, MAP_STEPS + 1))
        self.refined = (self.map_sum + MAP_PRIOR * own) / (self.map_n + MAP_PRIOR)

    def cost(self, window: np.ndarray) -> np.ndarray:
        """Bits that each window's last byte costs."""
        out = np.zeros(len(window))
        for bit in range(8):
            value = ((window >> U(7 - bit)) & U(1)).astype(bool)
            x, gate = self.inputs(window, bit)
            mixed = np.clip((self.weights[bit, gate] * x.T).sum(axis=1), -MAP_LIMIT, MAP_LIMIT)
            node = ((window & U(0xFF)) >> U(8 - bit) | U(1 << bit)).astype(np.int64)
            step = (mixed + MAP_LIMIT) * MAP_STEPS / (2 * MAP_LIMIT)
            low = np.minimum(step.astype(np.int64), MAP_STEPS - 1)
            part = step - low
            p = 0.5 * squash(mixed) + 0.5 * ((1 - part) * self.refined[node, low] + part * self.refined[node, low + 1])
            p = np.clip(p, 1e-6, 1 - 1e-6)
            out -= np.log2(np.where(value, p, 1 - p))
        return out


def train(spark: SparkSession, counted: DataFrame) -> tuple[Mixer, Broadcast]:
    """The model of a table of window counts, and its slot table."""
    counted = counted.select("key", "n")
    table = spark.sparkContext.broadcast(slot_counts(counted))

    def passed(weights: np.ndarray, rate: float) -> dict[str, np.ndarray]:
        """What all tasks learned, added up by cell: as many rows reach the driver as the model has cells, whatever the tasks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = Mixer(table.value), 0.0
            own.weights = weights.copy()
            for batch in batches:
                window, n = batch["key"].to_numpy().astype(U), batch["n"].to_numpy().astype(np.float64)
                order = np.argsort(mix(window + U(5)))
                for at in range(0, len(order), STEP_WINDOWS):
                    part = order[at : at + STEP_WINDOWS]
                    if rate:
                        own.learn(window[part], n[part], rate)
                    else:
                        own.observe(window[part], n[part])
                seen += n.sum()
            if seen:
                parts = {"weights": own.weights * seen, "seen": np.array([seen])} if rate else {"map_sum": own.map_sum, "map_n": own.map_n}
                for name, value in parts.items():
                    yield pa.RecordBatch.from_arrays([pa.array([name] * value.size), pa.array(np.arange(value.size, dtype=np.int32)), pa.array(value.ravel().astype(np.float64))], ["part", "cell", "value"])

        # in random order: tables come with frequent windows first; decimal sums don't depend on the order of tasks
        cells = counted.sortWithinPartitions(F.xxhash64("key")).mapInArrow(run, "part string, cell int, value double")
        total: dict[str, np.ndarray] = {}
        for r in cells.groupBy("part", "cell").agg(F.sum(F.col("value").cast("decimal(38,8)")).alias("value")).collect():
            shape = (1,) if r["part"] == "seen" else getattr(model, r["part"]).shape
            total.setdefault(r["part"], np.zeros(shape)).flat[r["cell"]] = float(r["value"])
        return total

    model = Mixer(table.value)
    for rate in RATES:
        if learned := passed(model.weights, rate):
            model.weights = learned["weights"] / learned["seen"][0]
    for name, value in passed(model.weights, 0.0).items():
        setattr(model, name, value)
    model.settle()
    model.table = None  # it goes by its own broadcast
    return model, table


def hot_words(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all words from such a count on that at most ``most`` have it."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(((r["level"], r["words"]) for r in counted.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, total = None, 0
    for at, n in levels:
        if total + n > most:
            break
        least, total = at, total + n
    if least is None:
        return np.zeros(0, U), np.zeros(0, np.int64)
    got = counted.filter(level >= least).select("key", "n").toArrow()
    return got["key"].to_numpy().astype(U), got["n"].to_numpy()


class Scorer:
    """A worker's side of the model: remembered window costs and the table of hot words."""

    def __init__(self, model: Mixer, table: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        model.table = table
        self.model, self.hot = model, HashIndex(1 << 16)
        order = self.hot.number(mix(keys))[0] if len(keys) else np.zeros(0, np.int32)
        self.counts = np.zeros(len(keys) + 1, np.int64)
        self.counts[order] = counts
        self._forget()

    def _forget(self) -> None:
        self.index, self.costs = HashIndex(1 << 20), np.zeros(1 << 16, np.float32)

    def bits(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Cost of each text."""
        if self.index.n > REMEMBERED:
            self._forget()
        window, bounds = windows(flat, offsets)
        number, new = self.index.number(mix(window))
        while len(self.costs) < self.index.n:
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
        for at in range(0, len(new), 1 << 14):
            part = new[at : at + (1 << 14)]
            self.costs[number[part]] = self.model.cost(window[part])
        total = np.concatenate([[0.0], np.cumsum(self.costs[number].astype(np.float64))])
        return total[bounds[1:]] - total[bounds[:-1]]


#: The worker's scorer, by the run that it belongs to.
SCORERS: dict[str, Scorer] = {}


def scored(docs: DataFrame, model: Mixer, table: Broadcast, keys: np.ndarray, counts: np.ndarray, text: str, key: str) -> DataFrame:
    """``(row, id, n_tokens, hot, known, bytes, bits, cold)``; hot: sum of log10(c + 0.1) of hot words."""
    spark = docs.sparkSession
    shared, run_id = spark.sparkContext.broadcast((model, keys, counts)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if run_id not in SCORERS:
            SCORERS.clear()
            own, *hot = shared.value
            SCORERS[run_id] = Scorer(own, table.value, *hot)
        scorer = SCORERS[run_id]
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches, text):
            n = part.num_rows
            flat, offsets = texts(part[text])
            word, owner = words(flat, offsets)
            word, owner = np.append(word, np.full(n, END_WORD, U)), np.append(owner, np.arange(n))
            number = scorer.hot.find(mix(word))
            hot = number >= 0
            logs = np.bincount(owner[hot], np.log10(scorer.counts[number[hot]] + 0.1), n)
            # other words: one entry for each text and word
            cold_owner, cold_word = owner[~hot], word[~hot]
            order = np.lexsort((cold_word, cold_owner))
            cold_owner, cold_word = cold_owner[order], cold_word[order]
            first = np.flatnonzero(np.concatenate([[True], (cold_word[1:] != cold_word[:-1]) | (cold_owner[1:] != cold_owner[:-1])])) if len(order) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(order)))
            at = np.concatenate([[0], np.cumsum(np.bincount(cold_owner[first], minlength=n))])
            cold = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(cold_word[first].astype(np.int64)), pa.array(times, pa.int64())], ["key", "times"]))
            columns = [pa.array(np.arange(row, row + n)), part[key].cast(pa.int64()), pa.array(np.bincount(owner, minlength=n)), pa.array(logs), pa.array(np.bincount(owner[hot], minlength=n)), pa.array(np.diff(offsets)), pa.array(scorer.bits(flat, offsets)), cold]
            row += n
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n_tokens", "hot", "known", "bytes", "bits", "cold"])

    return docs.select(key, text).mapInArrow(run, "row long, id long, n_tokens long, hot double, known long, bytes long, bits double, cold array<struct<key:long,times:long>>")


def lm_scores(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = FOLDS, hot_most: int = HOT_WORDS) -> DataFrame:
    """Base and model scores of each row, in log10, and bits per byte."""
    spark = docs.sparkSession
    counts = keep(corpus_counts(docs.filter(fold(F.col(key), folds) != 0), text), "corpus")
    word_counts = counts.filter(F.col("kind") == WORD).select("key", "n")
    n_all, distinct = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model, table = train(spark, counts.filter(F.col("kind") == WINDOW))
    rows = keep(scored(docs, model, table, *hot_words(word_counts, hot_most), text, key), "scored")
    cold = rows.select("row", F.explode("cold").alias("w")).select("row", "w.key", "w.times").join(word_counts, "key", "left")
    cold = cold.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("cold_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("cold_known"))
    out = rows.drop("cold").join(cold, "row", "left")
    scale = math.log10(n_all + 0.1 * (distinct + 1))
    return out.select(
        F.col("id").alias(key),
        (fold(F.col("id"), folds) == 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("hot") + F.coalesce("cold_log", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("bits") * -math.log10(2)).alias("score"),
        F.col("bytes").alias("n_bytes"),
        (F.col("bits") / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
