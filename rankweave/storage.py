"""Tables that are made once and read many times: steps of a plan written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; a session on one machine without it uses its own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/rankweave-{spark.sparkContext.applicationId}"
    return where.rstrip("/")


#: While a table is written: its shuffle files go when it is there, and the driver keeps short descriptions of its plans.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "65536"}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read from there: whatever refers to it reads it and does not make it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder was changed last, as its store says."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()
