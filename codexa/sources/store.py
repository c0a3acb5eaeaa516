"""Where intermediate tables go: the folder that driver and executors share.

The cluster names it in ``spark.checkpoint.dir``. Only a session in local mode, as in unit tests, may
leave that unset; its tables go below the SQL warehouse.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Attribute that names the folder of a kept table.
PATH = "_kept_path"
#: Spark's setting to remove the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a trailing slash."""
    set_dir = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_dir = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_codexa"
    return set_dir.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts lineage, lets several readers use one computation, and survives the loss of any
    executor. The folder is unique; ``drop`` removes it, or a cluster's retention rule for its
    checkpoint folder does. The shuffle files of the write go as soon as it is done, as nothing reads
    them again; else those of several steps lie side by side until the driver's JVM collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codexa-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    kept = spark.read.schema(df.schema).parquet(path)
    setattr(kept, PATH, path)
    return kept


def drop(*tables: DataFrame) -> None:
    """Remove kept tables after their last reader has been written itself.

    What was computed from them is in kept tables by then, so a lost executor never needs them again.
    Shuffle files of other finished queries go with them: Spark removes those when the driver's JVM collects the plans.
    """
    for table in tables:
        jvm, spark = table.sparkSession._jvm, table.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(getattr(table, PATH))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
