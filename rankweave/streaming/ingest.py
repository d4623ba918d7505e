"""Source files that keep coming: each micro-batch is cut into snippets, new ids are appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankweave.schemas import SNIPPET_SCHEMA
from rankweave.sources.chunking import chunk_sources


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, **own: str) -> StreamingQuery:
    """Watches ``source`` for files and appends the snippets that ``target`` (Parquet) does not have; a batch that runs again adds
    nothing twice."""
    files = spark.readStream.format("text").option("wholetext", True).load(source).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("code"))

    def write(batch: DataFrame, _: int) -> None:
        chunks = chunk_sources(batch.withColumns({n: F.lit(v) for n, v in own.items()})).dropDuplicates(["id"])
        try:
            known = batch.sparkSession.read.schema(SNIPPET_SCHEMA).parquet(target)
            chunks = chunks.join(known.select("id"), "id", "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        chunks.select(*[f.name for f in SNIPPET_SCHEMA.fields]).write.mode("append").parquet(target)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
