"""Ranking metrics per query and over all queries that have judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(run: DataFrame, qrels: DataFrame, queries: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(query_id, rr, ndcg, recall_5, recall_k) of ``run`` (query_id, id, rank) under ``qrels`` (query_id, id, grade).

    A judged document counts for rr and recall whatever its grade; rr looks at the whole run, the others at its first k. Gains are
    2^grade - 1. Queries come from ``queries``, or else from the judgements: those without a run, or without judgements, have zeros.
    """
    every = (queries if queries is not None else qrels).select("query_id").distinct()
    hits = run.select("query_id", "id", "rank").join(qrels, ["query_id", "id"])
    gain = (F.pow(F.lit(2.0), "grade") - 1.0) / F.log2(F.col("rank") + 1.0)
    found = hits.groupBy("query_id").agg(
        F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, gain)).alias("dcg"),
        F.count_if(F.col("rank") <= 5).alias("in_5"), F.count_if(F.col("rank") <= k).alias("in_k"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    ideal = qrels.withColumn("rank", place).groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, gain)).alias("ideal"), F.count("*").alias("relevant"))
    out = every.join(ideal, "query_id", "left").join(found, "query_id", "left")
    ratio = lambda a, b: F.coalesce(F.col(a) / F.greatest(F.lit(1), F.col(b)), F.lit(0.0))
    ndcg = F.when(F.col("ideal") != 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    return out.select("query_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), ndcg.alias("ndcg"), ratio("in_5", "relevant").alias("recall_5"), ratio("in_k", "relevant").alias("recall_k"))


def summary(metrics: DataFrame) -> DataFrame:
    """One row: mrr, ndcg, recall_5, recall_k; zeros without queries."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9)
    return metrics.agg(mean("rr").alias("mrr"), mean("ndcg").alias("ndcg"), mean("recall_5").alias("recall_5"), mean("recall_k").alias("recall_k"))


def p95(values: list[float]) -> float:
    """The value at place max(1, floor(0.95 n)) of the sorted ones."""
    return sorted(values)[max(0, int(len(values) * 0.95) - 1)]
