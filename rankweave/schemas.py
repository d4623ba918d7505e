"""Schemas of the tables that the engine works on."""

from pyspark.sql import types as T

REQUIRED = ["id", "repository", "file_path", "language", "version", "commit_id"]
TEXT = ["function_name", "class_name", "code", "docstring"]
SNIPPET_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in REQUIRED + TEXT]
    + [T.StructField("imports", T.ArrayType(T.StringType())), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
       T.StructField("snippet_type", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("symbol_name", "symbol_type", "parent_symbol")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("decorators", "comments")])

QUERIES = "query_id string, query string"
QRELS = "query_id string, id string, grade double"
STREAM = "query_id string, id string, score double, rank int"
