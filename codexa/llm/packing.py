"""Best-fit packing of documents into token sequences (operator 8).

Documents are tokenised once, in the scan; only piece descriptions (no text) travel on. Packing is
hierarchical and residual: pieces are dealt into groups of bounded size, each group is packed
best-fit with the longest first, bins that are nearly full are final, and the underfull bins go on
as items of the next round, with an eighth of the groups, until one group is left. A round
is one shuffle of small rows; its result is written to the shared folder, so a lost executor
costs one task. The last group never holds more than ``GROUP_ROWS`` items: if underfull bins
outnumber that and a round no longer lessens them, they are final as they are.

Defined results: null and empty text are one piece, the separator alone; a document longer than
``size`` is cut into full pieces of which the first may be shorter; repeated rows are packed once
each; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.llm.bpe import bpe
from codexa.llm.store import keep
from codexa.llm.text import slices, texts

SIZE = 2048
SEPARATOR = 0
#: A bin with at most this many free places is final.
SLACK = 8
#: Items that one task packs, and the number of groups that become one.
GROUP_ROWS = 100_000
FAN_IN = 8


def pieces(docs: DataFrame, path: str, size: int = SIZE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(item, key, piece, start, length, ids_crc32)`` of every document's pieces.

    ``item`` numbers pieces without gaps inside a task; it stays fixed once the table is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, item = bpe(path), TaskContext.get().partitionId() << 40
        for part in slices(batches, text):
            ids, at = coder.encode(*texts(part[text]))
            ids = ids.astype("<u4")
            rows, piece, start, length, crc = [], [], [], [], []
            for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], np.uint32(SEPARATOR))
                n = -(-len(own) // size)
                cuts = [0, *range(len(own) - (n - 1) * size, len(own) + 1, size)]
                for k in range(n):
                    rows.append(row)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(cuts[k + 1] - cuts[k])
                    crc.append(zlib.crc32(own[cuts[k] : cuts[k + 1]].tobytes()))
            items = np.arange(item, item + len(rows))
            item += len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items), part[key].cast(pa.int64()).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["item", key, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(key, text).mapInArrow(run, f"item long, {key} long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first, each into the fullest bin that still takes it.

    ``open_bits`` has a bit for every residual that some open bin has, so the best bin is the
    lowest set bit at or above the item's length.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    open_bits, made = 0, 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[at])
        fits = open_bits >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            own = stacks[free].pop()
            if not stacks[free]:
                open_bits &= ~(1 << free)
        else:
            free, own = size, made
            made += 1
        bins[at], offsets[at] = own, size - free
        if free - length:
            stacks[free - length].append(own)
            open_bits |= 1 << (free - length)
    return bins, offsets


def pack_round(items: DataFrame, groups: int, round_no: int, size: int = SIZE) -> DataFrame:
    """One round: ``(item, bin, offset, used, head)``; ``head`` marks one item of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        item = np.concatenate([b["item"].to_numpy() for b in got])
        length = np.concatenate([b["length"].to_numpy() for b in got])
        order = np.lexsort((item, length))  # same bins whatever the order of arrival
        item, length = item[order], length[order]
        bins, offsets = best_fit(length, size)
        used = np.bincount(bins, length).astype(np.int64)
        base = (round_no << 56) | (TaskContext.get().partitionId() << 32)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(base + bins), pa.array(offsets), pa.array(used[bins]), pa.array(offsets == 0)], ["item", "bin", "offset", "used", "head"])

    dealt = items.select("item", "length").repartition(groups, F.xxhash64("item"))
    return dealt.mapInArrow(run, "item long, bin long, offset long, used long, head boolean")


def pack(table: DataFrame, size: int = SIZE, slack: int = SLACK, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``table`` (item, length, ...) with ``sequence_id`` and ``offset``; ``table`` must be fixed."""
    left = table.filter(F.col("length") < size).select("item", "length")
    n = left.count()
    groups, rounds = max(1, -(-n // group_rows)), []
    if groups == 1 and n > 4 * FAN_IN:
        groups = FAN_IN
    while n:
        done = keep(pack_round(left, groups, len(rounds) + 1, size), "pack")
        rounds.append(done)
        if groups == 1:
            break
        left = done.filter(F.col("head") & (F.col("used") < size - slack)).select(F.col("bin").alias("item"), F.col("used").alias("length"))
        before, n = n, left.count()
        fewer = max(1, -(-groups // FAN_IN), -(-n // group_rows))
        if fewer >= groups and n > 0.95 * before:
            break
        groups = fewer
    placed = None
    for done in reversed(rounds):
        done = done.select("item", "bin", "offset")
        if placed is not None:
            above = placed.select(F.col("item").alias("bin"), F.col("bin").alias("above"), F.col("offset").alias("up"))
            done = done.join(above, "bin", "left").select("item", F.coalesce("above", "bin").alias("bin"), (F.col("offset") + F.coalesce("up", F.lit(0))).alias("offset"))
        placed = done
    full = table.filter(F.col("length") >= size)
    alone = full.withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("long")})
    if placed is None:
        return alone.drop("item")
    packed = table.filter(F.col("length") < size).join(placed.withColumnRenamed("bin", "sequence_id"), "item")
    return packed.select(*alone.columns).unionByName(alone).drop("item")


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece."""
    return pack(keep(pieces(docs, path, size, text, key), "pieces"), size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
