"""Bounded reranking: a small adjustment by phrases, identifiers, intent and version. It never adds or drops a candidate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave import vocabulary as V
from rankweave.config import RetrievalConfig
from rankweave.functions import text as X
from rankweave.functions.text import strings
from rankweave.operators.filters import group_key
from rankweave.operators.lexical import Tokens

MOST = 0.01
#: Shares of the features in the adjustment.
SHARES = {"phrase": 0.50, "identifier": 0.30, "intent": 0.15, "version": 0.05}
SURE = 0.80


def candidate_text() -> Column:
    fields = ["file_path", "function_name", "class_name", "symbol_name", "parent_symbol", "docstring"]
    parts = [F.nullif(F.col(n), F.lit("")) for n in fields] + [F.nullif(F.array_join("imports", " "), F.lit("")), F.nullif(F.col("code"), F.lit(""))]
    return F.concat_ws(" ", *parts)


def _bounded(text: Column, words: Column) -> Column:
    """Whether ``words`` stand in ``text`` between what is neither letter nor digit; both are phrase texts."""
    return F.contains(text, words) & F.rlike(text, F.concat(F.lit(r"(?<![a-z0-9])\Q"), words, F.lit(r"\E(?![a-z0-9])")))


def phrase_feature() -> Column:
    return F.when(F.exists("technical_phrases", lambda p: _bounded(F.col("__phrases"), X.phrase_text(p))), 1.0).otherwise(0.0)


def identifier_feature() -> Column:
    """Mean over the telling identifiers: 1 if one is there as it is, half if all its telling parts are."""
    generic = strings(*V.GENERIC_IDENTIFIERS)
    telling = F.filter("identifiers", lambda x: (F.length(x) >= 3) & ~F.array_contains(generic, F.lower(x))
                       & F.exists(X.split_identifier(x), lambda p: (F.length(p) >= 3) & ~F.array_contains(generic, p)))

    def worth(x: Column) -> Column:
        parts = F.array_except(X.split_identifier(x), generic)
        whole = F.array_contains("__words", F.lower(x)) | _bounded(F.col("__phrases"), X.phrase_text(x))
        return F.when(whole, 1.0).when((F.size(parts) > 0) & (F.size(F.array_except(parts, F.col("__words"))) == 0), 0.5).otherwise(0.0)

    total = F.aggregate(F.transform(telling, worth), F.lit(0.0), lambda a, b: a + b)
    return F.least(F.lit(1.0), total / F.greatest(F.lit(1), F.size(telling)))


def intent_feature() -> Column:
    support = F.lit(False)
    for name, words in V.INTENT_SUPPORT.items():
        support |= (F.col("primary_intent") == name) & F.arrays_overlap(F.col("__tokens"), strings(*words))
    return F.when((F.col("confidence") >= SURE) & support, 1.0).otherwise(0.0)


def version_feature() -> Column:
    """Nothing without a wish for a version; else 1 or -1; for the latest also 0 in a group without numbered versions."""
    own = X.version_key(F.col("version"))
    newest = F.max("__version").over(Window.partitionBy("query_id", *group_key()))
    specific = F.when(F.col("version") == F.col("requested_version"), 1.0).otherwise(-1.0)
    latest = F.when(F.lower("version") == "latest", 1.0).when(newest.isNull(), 0.0).when(own == newest, 1.0).otherwise(-1.0)
    return F.when(F.col("version_intent") == "specific", specific).when(F.col("version_intent") == "latest", latest).otherwise(0.0)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, phrase text) to (id, __phrases, __tokens, __words): the distinct tokens of both."""
    tokens = Tokens()

    def lists(texts: pa.Array) -> pa.Array:
        found = [pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(lengths) + 1)), pa.int32()), words) for _, lengths, words, rows, _ in tokens.count(texts)]
        return pa.concat_arrays(found)

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists(batch.column(1)), lists(batch.column(2))], names=["id", "__phrases", "__tokens", "__words"])


def rerank(candidates: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """``candidates`` (with snippet columns, fusion_score, and their query's identifiers, technical_phrases, primary_intent,
    confidence, version_intent, requested_version) with the features, rerank_adjustment, final_score and final_rank."""
    made = {"phrase": ("exact_phrase_match", phrase_feature()), "identifier": ("distinctive_identifier_match", identifier_feature()),
            "intent": ("intent_compatibility", intent_feature()), "version": ("version_compatibility", version_feature())}
    # texts and tokens once for each snippet, however many queries found it
    texts = candidates.select("id", candidate_text().alias("__text")).dropDuplicates(["id"])
    texts = texts.select("id", "__text", X.phrase_text(F.col("__text")).alias("__phrases"))
    texts = texts.mapInArrow(_words, f"id {texts.schema['id'].dataType.simpleString()}, __phrases string, __tokens array<string>, __words array<string>")
    out = candidates.join(texts, "id").withColumn("__version", X.version_key(F.col("version")))
    out = out.withColumns({column: value if name in config.rerank_features else F.lit(0.0) for name, (column, value) in made.items()})
    sum_ = sum((SHARES[name] * F.col(column) for name, (column, _) in made.items()), F.lit(0.0))
    out = out.withColumn("rerank_adjustment", F.greatest(F.lit(-MOST), F.least(F.lit(MOST), MOST * sum_)))
    out = out.withColumn("final_score", F.col("fusion_score") + config.alpha * F.col("rerank_adjustment"))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("fusion_score"), "id")
    return out.withColumn("final_rank", F.row_number().over(order)).drop("__phrases", "__tokens", "__words", "__version")
