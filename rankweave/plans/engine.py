"""The retrieval engine: index tables, and a batch of queries as one lazy plan over them."""

from __future__ import annotations

import dataclasses
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.config import RetrievalConfig
from rankweave.functions.understand import understand
from rankweave.operators import lexical as lex
from rankweave.operators import vectors as vec
from rankweave.operators.filters import filter_candidates, latest, merge_version
from rankweave.operators.fusion import fuse
from rankweave.operators.rerank import rerank
from rankweave.sources.snippets import check_corpus, with_defaults
from rankweave.storage import stored

#: An encoder takes (id, text) to (id, vector). Others than the hashing one can be registered.
ENCODERS: dict[str, Callable[[DataFrame, RetrievalConfig], DataFrame]] = {
    "hashing": lambda texts, config: vec.hash_encode(texts, dimensions=config.hash_dimensions)}


def encoder(config: RetrievalConfig):
    if config.encoder not in ENCODERS:
        raise ValueError(f"Unknown semantic encoder '{config.encoder}'. Registered: {', '.join(ENCODERS)}")
    return ENCODERS[config.encoder]


def fingerprint(texts: DataFrame) -> str:
    """A digest of all ids and texts that does not depend on how they are dealt: one hash a row, summed in pieces."""
    h = F.sha2(F.concat_ws("\x00", "id", "text"), 256)
    parts = [F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)") for i in range(4)]
    return ":".join(str(x) for x in texts.agg(F.count("*"), *[F.sum(p) for p in parts]).first())


@dataclasses.dataclass
class Engine:
    snippets: DataFrame
    config: RetrievalConfig = RetrievalConfig()
    index: lex.LexicalIndex | None = None
    vectors: DataFrame | None = None
    timings: dict = dataclasses.field(default_factory=dict)

    def __post_init__(self):
        self.snippets = with_defaults(self.snippets)
        self.size = check_corpus(self.snippets)

    @property
    def texts(self) -> DataFrame:
        return self.snippets.select("id", vec.snippet_text(self.snippets).alias("text"))

    def build_index(self) -> dict:
        """Write the tables that every search reads: snippets, the lexical index, vectors."""
        started = time.perf_counter()
        self.snippets = stored(self.snippets, "snippets")
        self.index = lex.build_index(self.snippets, self.config)
        self.vectors = stored(encoder(self.config)(self.texts, self.config), "vectors")
        return {"snippet_count": self.size, "index_seconds": time.perf_counter() - started}

    def save_index(self, path: str) -> None:
        """Tables and a manifest; vectors are valid for the encoder and the texts that the manifest names."""
        if self.index is None:
            self.build_index()
        tables = {"snippets": self.snippets, "vectors": self.vectors} | {f.name: getattr(self.index, f.name) for f in dataclasses.fields(self.index)}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        manifest = {"config": dataclasses.asdict(self.config), "encoder": self.config.encoder, "texts": fingerprint(self.texts)}
        self.snippets.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load_index(cls, spark: SparkSession, path: str, config: RetrievalConfig | None = None) -> Engine:
        """The saved index; its encoder stays. Vectors of other texts or of another encoder are made anew and saved."""
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        saved = {**manifest["config"], "rerank_features": tuple(manifest["config"]["rerank_features"])}
        config = dataclasses.replace(config or RetrievalConfig(**saved), semantic_encoder=manifest["encoder"])
        engine = cls(spark.read.parquet(f"{path}/snippets"), config)
        engine.index = lex.LexicalIndex(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in dataclasses.fields(lex.LexicalIndex)})
        engine.vectors = spark.read.parquet(f"{path}/vectors")
        if manifest["texts"] != fingerprint(engine.texts) or manifest["config"]["hash_dimensions"] != config.hash_dimensions:
            engine.vectors = encoder(config)(engine.texts, config)
            engine.save_index(path)
        return engine

    def candidates(self, understood: DataFrame) -> DataFrame:
        """The fused pool of each query; the lexical side reads the expanded query, the semantic side the one that was asked."""
        if self.index is None:
            self.build_index()
        c = self.config
        terms = understood.withColumn("lexical_text", F.coalesce(F.nullif("lexical_query", F.lit("")), F.col("query")))
        lexical = lex.bm25_search(terms.select("query_id", "lexical_text"), self.index, c, "lexical_text") if c.lexical_candidates else None
        if c.semantic_candidates:
            asked = encoder(c)(understood.select(F.col("query_id").alias("id"), F.col("query").alias("text")), c)
            semantic = vec.dense_search(asked.select(F.col("id").alias("query_id"), "vector"), self.vectors, c.semantic_candidates)
        else:
            semantic = lexical.limit(0)
        return fuse(semantic.limit(0) if lexical is None else lexical, semantic, c)

    def search(self, queries: DataFrame, top_k: int | None = None, filters: dict | None = None, version: str = "all") -> DataFrame:
        """Ranked results of ``queries`` (query_id, query). Filters come after the pool is cut; a query that names a version has it
        filtered unless the filters or ``version`` do."""
        started, k = time.perf_counter(), top_k or self.config.default_top_k
        understood = stored(understand(queries), "queries")
        signals = ["query_id", "primary_intent", "confidence", "intent_scores", "version_intent", F.col("version").alias("requested_version"), "identifiers", "technical_phrases"]
        fused = stored(self.candidates(understood), "pool")  # fusion_candidates rows a query
        retrieved = time.perf_counter()
        pool = fused.join(self.snippets, "id").join(understood.select(*signals), "query_id")
        fixed = merge_version(filters, version)
        if fixed["version"] == "all" and "version" not in (filters or {}) and version == "all":
            pool = filter_candidates(pool, {**fixed, "version": "all"})
            pool = pool.filter((F.col("version_intent") != "specific") | (F.col("version") == F.col("requested_version")))
            pool = latest(pool.filter("version_intent = 'latest'")).unionByName(pool.filter("version_intent <> 'latest'"))
        else:
            pool = filter_candidates(pool, fixed)
        if self.config.enable_reranking:
            ranked = rerank(pool, self.config)
            features = F.struct(F.col("fusion_score").alias("base_hybrid_score"), F.col("semantic_score").alias("semantic_similarity"), "lexical_score", "exact_phrase_match",
                                "distinctive_identifier_match", "intent_compatibility", "version_compatibility", "rerank_adjustment", F.lit(self.config.alpha).alias("alpha"), "final_score")
            score = F.col("final_score")
        else:
            order = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), "pool_rank")
            ranked, features, score = pool.withColumn("final_rank", F.row_number().over(order)), F.lit(None), F.col("fusion_score")
        final = F.col("final_score") if self.config.enable_reranking else F.lit(0.0)
        signals = F.struct(F.bround("semantic_score", 6).alias("semantic"), F.bround("lexical_score", 6).alias("lexical"), F.bround("rrf_score", 6).alias("rrf"), F.bround("fusion_score", 6).alias("fusion"),
                           F.bround(final, 6).alias("rerank"), features.alias("features"), F.col("primary_intent").alias("intent"), "primary_intent", F.col("confidence").alias("intent_confidence"),
                           "intent_scores", "version_intent", "requested_version")
        out = ranked.filter(F.col("final_rank") <= k).select(
            "query_id", F.col("final_rank").alias("rank"), F.col("id").alias("snippet_id"), F.bround(score, 6).alias("score"), "file_path", "function_name", "class_name", "language",
            "version", "repository", "code", signals.alias("retrieval_signals"))
        self.timings = {"retrieval_seconds": retrieved - started, "planning_seconds": time.perf_counter() - retrieved}
        return out

    def search_one(self, query: str, **options) -> list[dict]:
        spark = self.snippets.sparkSession
        started = time.perf_counter()
        rows = self.search(spark.createDataFrame([("q", query)], "query_id string, query string"), **options).orderBy("rank").collect()  # top_k rows
        self.timings["total_seconds"] = time.perf_counter() - started
        return [{k: v for k, v in r.asDict(recursive=True).items() if k != "query_id"} for r in rows]
