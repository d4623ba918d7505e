"""Evaluation of an engine on judged queries, and the same under several settings."""

from __future__ import annotations

import dataclasses
import json
import time
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.config import RetrievalConfig
from rankweave.operators.metrics import per_query, summary
from rankweave.plans.engine import Engine
from rankweave.sources.benchmark import Benchmark, payload_of, to_snippets, validate_payload

SETTINGS = {
    "A_bm25_only": {"semantic_candidates": 0}, "B_semantic_only": {"lexical_candidates": 0}, "C_bm25_plus_semantic": {},
    "D_hybrid_plus_filtering": {}, "E_hybrid_plus_filtering_plus_reranking": {"enable_reranking": True}}


def load_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries and judgements of JSON lines {query_id, query, relevance: {id: grade}}."""
    rows = spark.read.schema("query_id string, query string, relevance map<string,double>").json(path)
    return rows.select("query_id", "query"), rows.select("query_id", F.explode("relevance").alias("id", "grade"))


def evaluate(engine: Engine, queries: DataFrame, qrels: DataFrame, k: int = 10, filters: dict | None = None) -> DataFrame:
    run = engine.search(queries, top_k=k, filters=filters).select("query_id", F.col("snippet_id").alias("id"), "rank")
    return summary(per_query(run, qrels, queries, k))


def ablation(snippets: DataFrame, queries: DataFrame, qrels: DataFrame, filters: dict | None = None, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """A row of metrics for each setting; ``filters`` hold in D and E."""
    rows = []
    for name, change in SETTINGS.items():
        engine = Engine(snippets, dataclasses.replace(config, **change))
        rows.append(evaluate(engine, queries, qrels, filters=filters if name[0] in "DE" else None).select(F.lit(name).alias("setting"), "*"))
    return reduce(DataFrame.unionByName, rows)


def run_benchmark(bench: Benchmark, config: RetrievalConfig = RetrievalConfig(), top_k: int = 10) -> tuple[dict, dict | None]:
    """The payload of predictions and, where there are judgements, the metrics."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    engine = Engine(to_snippets(bench.corpus), config)
    run = engine.search(bench.queries.select("query_id", "query"), top_k=min(top_k, engine.size)).select("query_id", F.col("snippet_id").alias("id"), "score", "rank")
    payload = payload_of(run, bench)
    validate_payload(payload, bench, top_k)
    return payload, metrics_of(payload, bench, top_k)


def metrics_of(payload: dict, bench: Benchmark, k: int = 10) -> dict | None:
    if bench.qrels is None:
        return None
    spark = bench.queries.sparkSession
    rows = [(q, d, i) for q, ranking in payload[bench.split].items() for i, d in enumerate(ranking, 1)]
    return summary(per_query(spark.createDataFrame(rows, "query_id string, id string, rank int"), bench.qrels, bench.queries, k)).first().asDict()


def report(metrics: dict, path: str, started: float) -> None:
    Path(path).write_text(json.dumps({**metrics, "seconds": time.perf_counter() - started}, indent=2, sort_keys=True) + "\n")
