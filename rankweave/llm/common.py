"""Shared plumbing of the corpus operators: tables, the shared folder, materialised steps, hot keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key that stands for a null id inside the operators; it sorts before every other id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Without it there is none that can be known to be shared."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/rankweave-{spark.sparkContext.applicationId}"  # one process: its own disk
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/rankweave-{tag}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end(spark: SparkSession):
    """Inside, the shuffle files of a query go when it ends. After it the driver's garbage is collected, as Spark drops the
    broadcasts and plans of past steps from the executors only when nothing on the driver refers to them."""
    # the length: a large literal of a plan would come whole into each of the plan's many descriptions
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "65536"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        give_back()


#: What the innermost ``scratch`` is to delete: folders and tables.
_MADE: list[list[str]] = []


def _note(path: str) -> None:
    if _MADE:
        _MADE[-1].append(path)


@contextmanager
def scratch(spark: SparkSession):
    """On the way out deletes the folders and tables that were made inside, but for those of the tables in the list it yields,
    which pass to the ``scratch`` around it, if there is one."""
    _MADE.append([])
    keep: list[DataFrame] = []
    try:
        yield keep
    finally:
        made, kept = _MADE.pop(), {df.rankweave_path for df in keep}
        for path in made:
            if path in kept:
                _note(path)
            elif path.startswith("table "):
                spark.sql(f"DROP TABLE IF EXISTS {path[6:]}")
            else:
                delete_dir(spark, path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    path = fresh_dir(spark, tag)
    _note(path)
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.rankweave_path = path
    return out


def bucketed(df: DataFrame, n: int, keys: list[str], tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, in ``n`` buckets by ``keys``, sorted: joins on them then move only the other side."""
    name, spark = f"{tag}_{uuid.uuid4().hex}", df.sparkSession
    path = fresh_dir(spark, tag)
    _note(path)
    _note(f"table {name}")
    with shuffles_end(spark):
        df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing will read it again."""
    for df in tables:
        delete_dir(df.sparkSession, df.rankweave_path)


def delete_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Hand memory that this Python process has freed back to the system: a worker what earlier tasks used, the driver a step's plans."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_key(id_col: str) -> Column:
    """The id as a join key that is never null."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def body(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], count_col: str, total: int, parts: int = 1024) -> DataFrame:
    """Inner join of ``left`` with ``right``, where ``right`` has one row a key and ``count_col`` says how many rows of
    ``left`` have that key; the first key is a whole number.

    Keys with over ``total / parts`` rows are broadcast: there are fewer than ``parts`` of them, whatever the size of
    the input. All others go through a shuffled join, in which no key has more rows than that.
    """
    limit = max(1000, total // parts)
    payload = F.struct(*[c for c in right.columns if c not in keys])
    hot = right.filter(F.col(count_col) > limit).select(*keys, payload.alias("__hot"))
    cold = right.filter(F.col(count_col) <= limit).select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], payload.alias("__cold"))
    found = left.join(F.broadcast(hot), keys, "left")
    # rows of hot keys are done: they pass the shuffle spread out and match nothing there
    found = found.withColumn("__spread", F.when(F.col("__hot").isNotNull(), F.xxhash64(*left.columns)).otherwise(F.col(keys[0])))
    match = F.col("__hot").isNull()
    for i, k in enumerate(keys):
        match &= F.col("__spread" if i == 0 else k) == F.col(f"__key{i}")
    found = found.join(cold, match, "left").withColumn("__found", F.coalesce("__hot", "__cold")).filter("__found IS NOT NULL")
    return found.select(*left.columns, "__found.*")


def write_by_part(entries: DataFrame, columns: list[str], n: int) -> str:
    """Write the rows of ``entries`` (``parts``: an array of partition numbers) once for each of their parts, a folder a
    part. A part's rows are what one partition of a scan holds, so no task writes more than that for it."""
    folder = fresh_dir(entries.sparkSession, "parts")
    rows = entries.select(F.explode("parts").alias("part"), *columns).repartition(n, "part")
    with shuffles_end(entries.sparkSession):
        rows.write.partitionBy("part").option("compression", "zstd").parquet(folder)
    return folder


def part_batches(folder: str, part: int, columns: list[str]):
    """Arrow batches of what ``write_by_part`` wrote for ``part``; runs in tasks."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, where = pafs.FileSystem.from_uri(f"{folder}/part={part}")
    if fs.get_file_info(where).type == pafs.FileType.Directory:
        for info in fs.get_file_info(pafs.FileSelector(where)):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as file:
                    yield from pq.ParquetFile(file).iter_batches(20_000, columns=columns)
