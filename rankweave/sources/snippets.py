"""Snippets as JSON lines: strict reading, defaults, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.schemas import REQUIRED, SNIPPET_SCHEMA

NAMES = [f.name for f in SNIPPET_SCHEMA.fields]


def with_defaults(df: DataFrame) -> DataFrame:
    """All columns of a snippet: empty texts and lists, line 1, as many lines as the code has, type generic."""
    lines = F.greatest(F.lit(1), F.length("code") - F.length(F.replace("code", F.lit("\n"))) + 1)
    out = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in SNIPPET_SCHEMA.fields if f.name not in df.columns})
    out = out.withColumn("code", F.coalesce("code", F.lit("")))
    fill = {"start_line": F.lit(1), "end_line": lines, "snippet_type": F.lit("generic")}
    default = lambda f: fill.get(f.name, F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(""))
    return out.select(*[F.coalesce(F.col(f.name), default(f)).cast(f.dataType).alias(f.name) for f in SNIPPET_SCHEMA.fields])


def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Snippets of a file of JSON lines. Blank lines are skipped; bad JSON, an unknown field or a missing required one is an
    error that names the file and quotes the line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    keys = F.json_object_keys("value")
    bad = F.when(keys.isNull() | F.try_parse_json("value").isNull(), F.lit("not a JSON object"))
    bad = bad.when(F.size(F.array_except(keys, F.array(*map(F.lit, NAMES)))) > 0, F.lit("an unknown field"))
    bad = bad.when(F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), keys)) > 0, F.lit("a required field is missing"))
    message = F.concat(F.lit("Invalid JSONL at "), F.col("file"), F.lit(": "), bad, F.lit(": "), F.substring("value", 1, 200))
    checked = lines.withColumn("value", F.when(bad.isNotNull(), F.raise_error(message)).otherwise(F.col("value")))
    return with_defaults(checked.select(F.from_json("value", SNIPPET_SCHEMA).alias("s")).select("s.*"))


def save_jsonl(snippets: DataFrame, path: str) -> None:
    """JSON lines with the keys in order."""
    names = sorted(NAMES)
    snippets.select(F.to_json(F.struct(*names)).alias("value")).write.mode("overwrite").text(path)


def check_corpus(snippets: DataFrame) -> int:
    """The number of snippets; an error if there is none or an id comes twice."""
    total, distinct = snippets.agg(F.count("*"), F.countDistinct("id")).first()
    if not total:
        raise ValueError("Cannot build an engine from an empty snippet collection")
    if total != distinct:
        raise ValueError("Snippet IDs must be unique")
    return total
