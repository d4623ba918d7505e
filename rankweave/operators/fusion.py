"""Fusion of a lexical and a semantic ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.config import RetrievalConfig
from rankweave.operators.lexical import SCALE, top


def minmax(score: Column) -> Column:
    """Between 0 and 1 over a query's own candidates; where all are equal 1 if above 0, else 0."""
    own = Window.partitionBy("query_id")
    low, high = F.min(score).over(own), F.max(score).over(own)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.when(high > 0, 1.0).otherwise(0.0))


def fuse(lexical: DataFrame, semantic: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Candidates of either ranking (query_id, id, score, rank) with lexical_score, semantic_score (normalised; 0 where absent), their
    ranks (null where absent), rrf_score, fusion_score and pool_rank; the best ``fusion_candidates`` of each query.

    ``rrf``: weights over rrf_k + rank; any other method: weights times the normalised scores.
    """
    side = lambda df, name: df.select("query_id", "id", minmax(F.col("score")).alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))
    both = side(lexical, "lexical").join(side(semantic, "semantic"), ["query_id", "id"], "full_outer")
    both = both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("lexical_score", "semantic_score")})
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (config.rrf_k + F.col(rank)), F.lit(0.0))
    rrf = part(config.lexical_weight, "lexical_rank") + part(config.semantic_weight, "semantic_rank")
    weighted = config.lexical_weight * F.col("lexical_score") + config.semantic_weight * F.col("semantic_score")
    both = both.withColumn("rrf_score", rrf).withColumn("fusion_score", F.round(rrf if config.fusion_method == "rrf" else weighted, SCALE))
    return top(both, config.fusion_candidates, "fusion_score", "pool_rank")
