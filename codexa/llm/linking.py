"""Classes of nodes that share a key and are alike, without pairs of whole buckets.

Line deduplication and near-duplicate detection both find candidates by keys and settle them by a comparison
of the nodes' content. A bucket is the nodes of one key.

1. Each bucket's members are compared with the bucket's least node, its leader; a pair that meets in several
   buckets is compared once. Members of one leader are salted over tasks; a task holds one leader at a time.
2. Buckets whose other members are then still in several components are compared in full: in blocks of
   about ``BLOCK`` members, every pair of two components, until the block is one.
3. Classes are connected components of the links found.

Content is fetched only for nodes that share a key. Joins of sides that grow with the data are merge joins at
every size; nothing is broadcast or collected. Each step is written to the shared folder, and its inputs go
when nothing reads them any more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.components import components
from codexa.llm.store import drop, keep, partitions
from codexa.llm.text import slices

#: Members of one leader that one salt gets, and members of a block of an open bucket.
SALT_ROWS = 64
BLOCK = 512

Prepare = Callable[[bytes], np.ndarray]
Alike = Callable[[np.ndarray, np.ndarray], bool]
Among = Callable[[list[bytes], np.ndarray, np.ndarray, bool], list[tuple[int, int]]]


def compared(pairs: DataFrame, content: DataFrame, prepare: Prepare, alike: Alike) -> DataFrame:
    """Those of ``pairs`` (id, leader) that are alike."""
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    member = pairs.join(salts.hint("merge"), "leader").select("id", "leader", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"), F.lit(False).alias("is_leader"))
    leader = salts.select(F.col("leader").alias("id"), "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"), F.lit(True).alias("is_leader"))
    rows = member.unionByName(leader).join(content.hint("merge"), "id").select("leader", "salt", "is_leader", "id", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, None
        for part in slices(batches, "data"):
            ids, leaders = [], []
            for lead, salt, is_leader, own, data in zip(*(part[c].to_pylist() for c in ("leader", "salt", "is_leader", "id", "data")), strict=True):
                mark = prepare(data)
                if is_leader:
                    now, base = (lead, salt), mark
                elif now == (lead, salt) and alike(base, mark):
                    ids.append(own)
                    leaders.append(lead)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(leaders)], ["id", "leader"])

    dealt = rows.repartition(partitions(pairs.sparkSession), "leader", "salt").sortWithinPartitions("leader", "salt", F.desc("is_leader"))
    return dealt.mapInArrow(run, "id long, leader long")


def settled(rest: DataFrame, content: DataFrame, among: Among) -> DataFrame:
    """Links (id, leader) among the members of each bucket of ``rest`` (key, id, component)."""
    open_ = rest.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"))
    # buckets of the same members are settled once
    open_ = open_.filter("low <> high").groupBy("members", "mark").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    member = rest.join(open_.hint("merge"), "key").withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("key", "id", "component", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    rows = member.join(content.hint("merge"), "id").select("key", "low", "high", "side", "id", "component", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> pa.RecordBatch:
            ids, component, side = (np.array(c, np.int64) for c in list(zip(*held, strict=True))[:3])
            got = among([h[3] for h in held], component, side, now[1] != now[2])
            return pa.RecordBatch.from_arrays([pa.array([int(ids[i]) for i, _ in got], pa.int64()), pa.array([int(ids[j]) for _, j in got], pa.int64())], ["id", "leader"])

        for part in slices(batches, "data"):
            for key, low, high, side, own, component, data in zip(*(part[c].to_pylist() for c in ("key", "low", "high", "side", "id", "component", "data")), strict=True):
                if now != (key, low, high):
                    if held:
                        yield links()
                    now, held = (key, low, high), []
                held.append((own, component, side, data))
        if held:
            yield links()

    dealt = rows.repartition(partitions(rest.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(run, "id long, leader long")


def link_classes(keys: DataFrame, content: DataFrame, prepare: Prepare, alike: Alike, among: Among) -> DataFrame:
    """``(node, component)`` of all nodes that are linked with another one, kept.

    ``keys`` (key, id) and ``content`` (id, data) must be fixed; both may have repeated rows.
    """
    lead = keep(keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader <> last"), "leaders")
    met = keep(keys.join(lead.hint("merge"), "key").filter("id <> leader").select("key", "id", "leader").distinct(), "met")
    pairs = keep(met.select("id", "leader").distinct(), "pairs")
    wanted = pairs.select("id").unionByName(pairs.select(F.col("leader").alias("id"))).distinct()
    data = keep(content.join(wanted.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "content")
    drop(lead)
    links = keep(compared(pairs, data, prepare, alike), "links")
    drop(pairs)
    edge = lambda df: df.select(F.col("id").alias("a"), F.col("leader").alias("b"))
    known = components(edge(links))
    # a leader is settled with all of its bucket; the others are with those of their own component
    more = met.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    rest = met.join(more.hint("merge"), "key", "left_semi").join(known.hint("merge"), F.col("id") == F.col("node"), "left")
    rest = keep(rest.select("key", "id", F.coalesce("component", "id").alias("component")), "rest")
    drop(met)
    further = keep(settled(rest, data, among), "links")
    drop(rest, data)
    if further.isEmpty():
        drop(links, further)
        return known
    classes = components(edge(links.unionByName(further)))
    drop(known, links, further)
    return classes
