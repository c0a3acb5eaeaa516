"""Commands over text files: ``python -m codexa COMMAND ...``.

Each is a composition of the library's operators; results go to standard output as text or JSON lines, or to a folder.
A path that can't be read ends a command with status 2.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.functions import text as X
from codexa.operators import align, pages
from codexa.plans import translate
from codexa.sources import files


def show(df: DataFrame) -> None:
    """Rows as JSON lines, as they come."""
    for row in df.toJSON().toLocalIterator():
        print(row)


def documents(spark: SparkSession, path: str) -> DataFrame:
    return files.read_texts(spark, path).select(F.col("path").alias("doc_id"), "text")


def repair(spark: SparkSession, args: argparse.Namespace) -> None:
    df = spark.createDataFrame([(args.text,)], "text string")
    print(df.select(X.expand_ligatures(X.repair(F.col("text")))).first()[0])


def detect(spark: SparkSession, args: argparse.Namespace) -> None:
    show(pages.mojibake_report(documents(spark, args.input)))


def classify(spark: SparkSession, args: argparse.Namespace) -> None:
    m = pages.text_measures(documents(spark, args.input))
    kind = pages.page_type(*[F.col(c) for c in ("word_count", "arabic_word_count", "english_word_count", "pua_count")], F.lit(False), F.lit(0.0), F.lit(True))
    show(pages.with_backend(m.withColumn("page_type", kind)))


def align_texts(spark: SparkSession, args: argparse.Namespace) -> None:
    sides = [documents(spark, path).select(F.lit(args.work_id).alias("work"), F.lit(lang).alias("lang"), "text") for lang, path in (("ar", args.arabic), ("en", args.english))]
    out = translate.translate(translate.paragraphs_of(sides[0].unionByName(sides[1])))
    translate.save(out, args.work_id, args.output, args.force)
    show(out["diagnostics"])


def verify(spark: SparkSession, args: argparse.Namespace) -> int:
    faults = files.bundle_faults(spark, args.bundle, translate.MEMBERS).collect()
    for row in faults:
        print(f"{row['name']}: {row['fault']}")
    return int(bool(faults))


def doctor(spark: SparkSession, args: argparse.Namespace) -> None:
    row = spark.createDataFrame([(args.memory, args.vectors)], "memory double, runtime boolean")
    show(row.select(align.advice(F.col("memory"), F.col("runtime"), F.array().cast("array<string>"), F.lit(False)).alias("a")).select("a.*"))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="codexa", description=__doc__.split("\n")[0])
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run, *arguments: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name)
        own.set_defaults(run=run)
        for argument in arguments:
            own.add_argument(argument)
        return own

    command("repair-text", repair, "text")
    command("detect", detect, "input")
    command("classify", classify, "input")
    own = command("align", align_texts, "arabic", "english")
    own.add_argument("-o", "--output", required=True)
    own.add_argument("--work-id", default="work")
    own.add_argument("--force", action="store_true")
    command("verify-alignment", verify, "bundle")
    own = command("alignment-doctor", doctor)
    own.add_argument("--memory", type=float)
    own.add_argument("--vectors", action="store_true")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("codexa").getOrCreate()
    try:
        return args.run(spark, args) or 0
    except AnalysisException as error:
        print(error, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
