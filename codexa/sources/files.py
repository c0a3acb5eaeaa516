"""Readers and writers: whole texts, JSON lines, catalogues, glyph maps, and checked bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_BYTES, METADATA_BYTES, GOLD_BYTES = 512 << 20, 64 << 20, 32 << 20


def read_texts(spark: SparkSession, path: str, most: int = TEXT_BYTES) -> DataFrame:
    """``(path, text, sha256)`` of whole files, without a byte-order mark; larger files are left to ``too_large``."""
    raw = spark.read.format("binaryFile").load(path).filter(F.col("length") <= most)
    return raw.select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^\\x{FEFF}", "").alias("text"), F.sha2("content", 256).alias("sha256"))


def too_large(spark: SparkSession, path: str, most: int = TEXT_BYTES) -> DataFrame:
    """Files over the limit: ``(path, length)``; their content isn't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length").filter(F.col("length") > most)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as rows of a schema; a line that isn't an object fails the read, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


ENTRY = T.StructType([T.StructField(c, T.StringType()) for c in ("arabic", "verse_key", "word_position", "transliteration")])


def read_glyph_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Glyphs and verses of a JSON map {pages: {page: {glyph: word or object}}, verses: {key: text}}."""
    text = spark.read.text(path, wholetext=True)
    pages = text.select(F.explode(F.from_json(F.get_json_object("value", "$.pages"), "map<string,map<string,string>>")).alias("page", "glyphs"))
    rows = pages.select(F.col("page").cast("int"), F.explode("glyphs").alias("glyph", "word"))
    told = F.from_json("word", ENTRY)
    plain = ~F.col("word").startswith("{")
    field = lambda c: F.when(~plain, told[c])
    glyphs = rows.select("page", "glyph", F.when(plain, F.col("word")).otherwise(told["arabic"]).alias("arabic"), field("verse_key").alias("verse_key"), field("word_position").cast("int").alias("position"), field("transliteration").alias("transliteration"))
    verses = text.select(F.posexplode(F.map_entries(F.from_json(F.get_json_object("value", "$.verses"), "map<string,string>"))).alias("ord", "v")).select("ord", "v.key", "v.value")
    return glyphs, verses.toDF("ord", "verse_key", "arabic")


def glyph_map_of_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Glyphs and verses from (ord, surah, ayah, page, encoded, decoded): the last row of a glyph wins."""
    chars = rows.select("ord", "page", "decoded", F.explode(F.filter(F.split("encoded", ""), lambda c: F.trim(c) != "")).alias("glyph"))
    glyphs = chars.groupBy("page", "glyph").agg(F.max_by("decoded", "ord").alias("arabic"))
    verses = rows.groupBy(F.col("decoded").alias("verse_text")).agg(F.max_by(F.concat_ws(":", "surah", "ayah"), "ord").alias("verse_key"))
    return glyphs, verses


def write_glyphs(glyphs: DataFrame, path: str) -> None:
    """The glyph table by page, so that a page's lookup reads one folder."""
    glyphs.repartition("page").write.mode("overwrite").partitionBy("page").parquet(path)


def write_texts(docs: DataFrame, path: str, text: str = "markdown", key: str = "doc_id", force: bool = False) -> None:
    """Documents' Markdown or plain text, a folder for each key; ``write_json`` writes all columns."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("value"))
    rows.write.mode("overwrite" if force else "errorifexists").partitionBy("key").option("lineSep", "\n").text(path)


def write_json(docs: DataFrame, path: str, force: bool = False) -> None:
    docs.write.mode("overwrite" if force else "errorifexists").json(path)


# -- bundles -----------------------------------------------------------------------------------
SCHEMA = "codexa.alignment.bundle.v1"


def canonical(df: DataFrame) -> DataFrame:
    """Rows as JSON with sorted fields, in order of their text: equal tables give equal lines."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).orderBy("value")


def digest(lines: DataFrame) -> DataFrame:
    """``(rows, sha256)``: a hash over the hashes of all lines, summed by prefix so that no task holds them."""
    parts = lines.select(F.sha2("value", 256).alias("h")).groupBy(F.substring("h", 1, 2).alias("p")).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 3, 15), 16, 10).cast("decimal(38,0)")).alias("s"))
    # 256 rows at most from here on
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", "n", "s"))), "\n"), 256).alias("sha256"))


def write_bundle(tables: dict[str, DataFrame], work: str, path: str, force: bool = False) -> DataFrame:
    """Every table as JSON lines and a manifest of counts and hashes; returns the manifest."""
    mode = "overwrite" if force else "errorifexists"
    rows = None
    for name in sorted(tables):
        canonical(tables[name]).write.mode(mode).text(f"{path}/{name}")
        own = digest(tables[name].sparkSession.read.text(f"{path}/{name}")).select(F.lit(name).alias("name"), "rows", "sha256")
        rows = own if rows is None else rows.unionByName(own)
    manifest = rows.withColumns({"work": F.lit(work), "schema": F.lit(SCHEMA)})
    manifest.coalesce(1).write.mode(mode).json(f"{path}/manifest")
    return manifest


def bundle_faults(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``(name, fault)`` of members that are missing, unknown, or not as the manifest says."""
    manifest = spark.read.schema("name string, rows long, sha256 string, work string, schema string").json(f"{path}/manifest")
    now = None
    for name in names:
        own = digest(spark.read.text(f"{path}/{name}")).select(F.lit(name).alias("name"), F.col("rows").alias("now_rows"), F.col("sha256").alias("now_sha"))
        now = own if now is None else now.unionByName(own)
    met = manifest.join(now, "name", "full_outer")
    fault = F.when(F.col("sha256").isNull(), "unknown").when(F.col("now_sha").isNull(), "missing").when(F.col("rows") != F.col("now_rows"), "row count").when(F.col("sha256") != F.col("now_sha"), "content")
    return met.select("name", fault.alias("fault")).filter("fault is not null")
