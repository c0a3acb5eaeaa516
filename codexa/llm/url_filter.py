"""URL filter: a blocked Bloom filter in front of an exact hash join (operator 4, native).

A list of canonical URLs (host, path prefix, verdict) judges pages. A URL's candidates are its
host's suffixes times the path prefixes of the lengths that the list has. The Bloom filter is one
array of 64-bit blocks, of bounded size, built by ``bit_or`` and read as a scalar subquery; it keeps
the candidates that may be listed, and an equi-join with the list removes false positives. The longest
fitting rule wins; of rules of one host and path, block wins. Only DataFrame and SQL functions run.

Defined results: a null URL or one without ``://`` has empty host and path and the default verdict;
each input row gives one row, repeated rows too; empty tables give empty results; only the id and
the URL are read, so other columns of any name do no harm; a null id passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits that a key sets in its block, blocks for each listed key, and blocks at most (8 MB).
BITS = 4
BLOCKS_PER_KEY = 0.25
MOST_BLOCKS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def block_of(key: str, blocks: int) -> Column:
    """1-based block of a key."""
    return F.expr(f"pmod(xxhash64({key}), {blocks}) + 1")


def mask_of(key: str) -> Column:
    """The bits that a key sets in its block."""
    return F.expr(" | ".join(f"shiftleft(1L, cast(pmod(xxhash64({key}, {i + 1}), 64) as int))" for i in range(BITS)))


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """One row, one array of ``blocks`` longs; empty blocks are 0."""
    words = rules.select(block_of("key", blocks).alias("b"), mask_of("key").alias("m")).groupBy("b").agg(F.bit_or("m").alias("m"))
    packed = words.agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("set"))
    return packed.select(F.expr(f"transform(sequence(1L, {blocks}L), i -> coalesce(try_element_at(set, i), 0L))").alias("bloom"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """``(key, host, path, rule, verdict)`` for each row; ``rules`` has host, path and verdict."""
    rules = rules.select(F.concat(F.translate("host", UPPER, LOWER), "path").alias("key"), F.length("path").alias("len"), "verdict").filter("key is not null")
    rules = rules.groupBy("key", "len").agg(F.max("verdict").alias("verdict"))
    sizes = rules.agg(F.count("*"), F.array_sort(F.collect_set("len"))).first()
    blocks = min(MOST_BLOCKS, max(64, int(sizes[0] * BLOCKS_PER_KEY)))
    lengths = ", ".join(map(str, sizes[1])) or "0"

    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    suffixes = "transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))"
    prefixes = f"transform(filter(array({lengths}), l -> l <= length(path)), l -> substring(path, 1, l))"
    candidates = rows.select("id", "host", "path", F.expr(f"explode(flatten(transform({suffixes}, s -> transform({prefixes}, p -> concat(s, p)))))").alias("key"))
    word = F.element_at(bloom_blocks(rules, blocks).scalar(), block_of("key", blocks).cast("int"))
    possible = candidates.filter(word.bitwiseAND(mask_of("key")) == mask_of("key"))
    hits = possible.join(rules, "key").select("id", "host", "path", F.struct(F.length("key").alias("n"), "key", "verdict").alias("hit"), F.lit(0).alias("copies"))
    # every page is there once without a hit, so one partially aggregated shuffle gives all of them
    base = rows.select("id", "host", "path", F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"), F.lit(1).alias("copies"))
    best = base.unionByName(hits).groupBy("id", "host", "path").agg(F.max("hit").alias("hit"), F.sum("copies").alias("copies"))
    return best.select(
        F.col("id").alias(key), "host", "path", F.col("hit.key").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"), F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("one")
    ).drop("one")


#: The list of the query (fixed values).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
