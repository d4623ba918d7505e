"""Command line: ``python -m rankweave.cli build|search|evaluate|ablation|benchmark``."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from rankweave.config import RetrievalConfig
from rankweave.plans import evaluate as ev
from rankweave.plans.engine import Engine
from rankweave.sources.benchmark import load_benchmark, write_predictions
from rankweave.sources.snippets import load_jsonl


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="rankweave")
    p.add_argument("command", choices=["build", "search", "evaluate", "ablation", "benchmark"])
    p.add_argument("--snippets", help="JSON lines of snippets")
    p.add_argument("--index", help="folder of a saved index")
    p.add_argument("--queries", help="JSON lines of judged queries")
    p.add_argument("--dataset", help="folder of a benchmark")
    p.add_argument("--output", help="file for predictions or the report")
    p.add_argument("--query")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--rerank", action="store_true")
    p.add_argument("--version", default="all")
    for name in ("language", "repository", "file_path", "snippet_type"):
        p.add_argument("--" + name.replace("_", "-"))
    a = p.parse_args(argv)
    spark, started = SparkSession.builder.getOrCreate(), time.perf_counter()
    config = RetrievalConfig(enable_reranking=a.rerank)
    filters = {n: getattr(a, n) for n in ("language", "repository", "file_path", "snippet_type") if getattr(a, n)}
    if a.command == "benchmark":
        bench = load_benchmark(spark, a.dataset)
        payload, metrics = ev.run_benchmark(bench, config, a.top_k)
        if a.output:
            write_predictions(payload, a.output, bench, a.top_k)
        print(json.dumps(metrics))
        return
    if a.command == "build":
        engine = Engine(load_jsonl(spark, a.snippets), config)
        print(json.dumps(engine.build_index()))
        engine.save_index(a.index)
        return
    engine = Engine.load_index(spark, a.index, config) if a.index else Engine(load_jsonl(spark, a.snippets), config)
    if a.command == "search":
        print(json.dumps(engine.search_one(a.query, top_k=a.top_k, filters=filters, version=a.version), indent=2))
        return
    queries, qrels = ev.load_queries(spark, a.queries)
    if a.command == "ablation":
        ev.ablation(engine.snippets, queries, qrels, filters, config).show(truncate=False)
    else:
        metrics = ev.evaluate(engine, queries, qrels, a.top_k, filters).first().asDict()
        print(json.dumps(metrics))
        if a.output:
            ev.report(metrics, a.output, started)


if __name__ == "__main__":
    main()
