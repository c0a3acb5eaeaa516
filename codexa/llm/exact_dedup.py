"""Exact deduplication by Grace hash partitioning (operator 5).

1. Each scan task keeps an open-addressing table of the texts it has seen and gives equal ones
   one local group; this lessens hot groups before anything moves. The table is emptied whenever
   its texts exceed ``TASK_BYTES`` or its rows ``TASK_ROWS``. Members (no text) and one representative for each local group
   are written to the shared folder.
2. Representatives are partitioned by content hash into buckets. Buckets whose measured bytes
   exceed ``BUCKET_BYTES`` are partitioned again by further bits of the hash, recursively, until
   each fits; Spark's shuffle files are the spill files. A task sorts its buckets and
   loads one at a time into an open-addressing table that compares complete content.
3. Members find their group's result by their local group, of which no key has more rows than
   one scan task has read, so a text that a third of all rows share loads no task.

Defined results: null text is empty text; the row of the largest doc_id stays (null ids are
smallest); of repeated rows with that id just one is marked kept; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.llm.store import keep, partitions
from codexa.llm.text import slices

#: Bytes of text and rows that a scan task's table holds, and bytes that one bucket may have.
TASK_BYTES = 32 << 20
TASK_ROWS = 1 << 18
BUCKET_BYTES = 32 << 20
#: Further hash bits at each level of partitioning, and levels at most (64 bits in all).
LEVEL_BITS = 4
NO_ID = -(1 << 63)


class ContentTable:
    """Open addressing with linear probing; equal means that hash and complete content agree."""

    def __init__(self) -> None:
        self.slots, self.texts, self.hashes, self.bytes = [-1] * 1024, [], [], 0

    def number(self, h: int, content: str, size: int) -> int:
        """The content's number, a new one if it isn't there; ``size`` are its bytes."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (own := slots[at]) >= 0:
            if self.hashes[own] == h and self.texts[own] == content:
                return own
            at = (at + 1) & mask
        slots[at] = own = len(self.texts)
        self.texts.append(content)
        self.hashes.append(h)
        self.bytes += size
        if 2 * len(self.texts) > len(slots):
            self._grow()
        return own

    def _grow(self) -> None:
        size = 4 * len(self.slots)
        self.slots = [-1] * size
        for own, h in enumerate(self.hashes):
            at = h & (size - 1)
            while self.slots[at] >= 0:
                at = (at + 1) & (size - 1)
            self.slots[at] = own


def local_groups(docs: DataFrame, text: str, key: str, task_bytes: int) -> DataFrame:
    """``(id, grp, sha, lead, n, top, h, content)``; only a group's first row has n, h and content.

    ``top`` (the largest id) is on every group's last-written head row; members carry ``grp``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        table, members, count, top, sha = ContentTable(), [], [], [], []

        def rows() -> Iterator[pa.RecordBatch]:
            # heads carry the content, members their id; two kinds in one file, told by h
            names = ["id", "grp", "sha", "lead", "n", "top", "h", "content"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            led = [False] * len(count)
            out = []
            for own, own_id in members:
                value = NO_ID if own_id is None else own_id
                lead = not led[own] and value == top[own]
                led[own] |= lead
                out.append((own_id, base + own, sha[own], lead, None, None, None, None))
            for own, content in enumerate(table.texts):
                out.append((None, base + own, sha[own], None, count[own], top[own], signed(table.hashes[own]), content))
            for at in range(0, len(out), 4096):
                cols = list(zip(*out[at : at + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for part in slices(batches, text):
            for own_id, content in zip(part[key].cast(pa.int64()).to_pylist(), part[text].to_pylist(), strict=True):
                content = content or ""
                raw = content.encode()
                digest = hashlib.sha256(raw)
                own = table.number(int.from_bytes(digest.digest()[:8], "little"), content, len(raw))
                value = NO_ID if own_id is None else own_id
                if own == len(count):
                    count.append(0)
                    top.append(value)
                    sha.append(digest.hexdigest())
                count[own] += 1
                top[own] = max(top[own], value)
                members.append((own, own_id))
            if table.bytes > task_bytes or len(members) > TASK_ROWS:
                yield from rows()
                base += len(count)
                table, members, count, top, sha = ContentTable(), [], [], [], []
        if members:
            yield from rows()

    return docs.select(key, text).mapInArrow(run, "id long, grp long, sha string, lead boolean, n long, top long, h long, content string")


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def plan_buckets(heads: DataFrame, n: int, bucket_bytes: int) -> Callable[[str], F.Column]:
    """An expression for the final bucket of a hash column, by recursive measurement.

    The plan holds one entry for each bucket that had to be partitioned again; a bucket of
    ``bucket_bytes`` or less needs none. The number of first buckets follows the measured bytes, so
    entries are few at any size.
    """
    size = F.octet_length("content") + 64
    total = heads.agg(F.sum(size)).first()[0] or 0
    first = max(4 * n, -(-3 * total // bucket_bytes))
    bucket, bits, again = F.pmod("h", F.lit(first)), 0, []
    while bits < 48:
        def column(h: str, again=tuple(again), first=first):
            out = F.pmod(h, F.lit(first)).cast("string")
            for shift, large in again:
                out = F.when(out.isin(large), F.concat_ws("/", out, F.shiftrightunsigned(h, 16 + shift).bitwiseAND((1 << LEVEL_BITS) - 1).cast("string"))).otherwise(out)
            return out

        sizes = heads.groupBy(column("h").alias("b")).agg(F.sum(size).alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        large = [r["b"] for r in sizes.filter((F.col("bytes") > bucket_bytes) & (F.col("lo") != F.col("hi"))).select("b").collect()]
        if not large:
            return column
        again.append((bits, large))
        bits += LEVEL_BITS
    return column


def global_groups(heads: DataFrame, n: int, bucket_bytes: int) -> DataFrame:
    """``(grp, keep_id, size, winner)`` for each local group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, table, top, count, own_rows = None, ContentTable(), [], [], []

        def rows() -> Iterator[pa.RecordBatch]:
            # of groups that share the largest id, the one of the lowest number marks the row that stays
            winner: dict[int, int] = {}
            for grp, own, own_top in own_rows:
                if own_top == top[own]:
                    winner[own] = min(winner.get(own, grp), grp)
            for at in range(0, len(own_rows), 65_536):
                out = [(g, top[o], count[o], winner[o] == g) for g, o, _ in own_rows[at : at + 65_536]]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["grp", "keep_id", "size", "winner"])

        for part in slices(batches, "content"):
            cols = (part[c].to_pylist() for c in ("b", "grp", "n", "top", "h", "content"))
            for b, grp, n_own, own_top, h, content in zip(*cols, strict=True):
                if b != bucket:
                    if own_rows:
                        yield from rows()
                    bucket, table, top, count, own_rows = b, ContentTable(), [], [], []
                own = table.number(h & ((1 << 64) - 1), content, 0)
                if own == len(top):
                    top.append(own_top)
                    count.append(0)
                top[own] = max(top[own], own_top)
                count[own] += n_own
                own_rows.append((grp, own, own_top))
        if own_rows:
            yield from rows()

    bucket = plan_buckets(heads, n, bucket_bytes)("h")
    dealt = heads.select(bucket.alias("b"), "grp", "n", "top", "h", "content").repartition(n, "b").sortWithinPartitions("b")
    return dealt.mapInArrow(run, "grp long, keep_id long, size long, winner boolean")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", task_bytes: int = TASK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)``, one row for each row of ``docs``."""
    spark = docs.sparkSession
    rows = keep(local_groups(docs, text, key, task_bytes), "copies")
    groups = global_groups(rows.filter(F.col("h").isNotNull()), partitions(spark), bucket_bytes)
    members = rows.filter(F.col("h").isNull()).select("id", "grp", "sha", "lead")
    return members.join(groups, "grp").select(
        F.col("id").alias(key),
        F.when(F.col("keep_id") != NO_ID, F.col("keep_id")).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("lead") & F.col("winner") & (F.coalesce("id", F.lit(NO_ID)) == F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
