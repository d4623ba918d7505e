"""Benchmark folders: corpus, queries and judgements in several formats and layouts; predictions as JSON."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.sources.snippets import with_defaults

# Names that a column may have, the first that is there counts.
CORPUS_ID = ["_id", "corpus-id", "corpus_id", "id"]
QUERY_ID = ["_id", "query-id", "query_id", "id"]
CORPUS_TEXT = ["text", "code", "document"]
QUERY_TEXT = ["text", "query"]
QREL_QUERY = ["query-id", "query_id", "qid", "_id"]
QREL_CORPUS = ["corpus-id", "corpus_id", "doc-id", "doc_id", "did", "id"]
QREL_SCORE = ["score", "relevance", "label"]
SUFFIXES = {".json", ".jsonl", ".tsv", ".txt", ".parquet"}


@dataclass
class Benchmark:
    """corpus(id, title, text), queries(query_id, query), qrels(query_id, id, grade) or None; ``pos`` columns keep the input's order."""

    split: str
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame | None


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file as columns, by its suffix. JSON may be lines, a list, or an object by id with objects or texts in it."""
    suffix = Path(path).suffix.lower()
    if suffix in (".tsv", ".txt"):
        return spark.read.csv(path, sep="\t", header=True)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".jsonl":
        return spark.read.option("mode", "FAILFAST").json(path)
    if suffix != ".json":
        raise ValueError(f"Unsupported file type: {path}")
    whole = spark.read.text(path, wholetext=True)
    if whole.filter(F.col("value").rlike(r"^\s*\[")).count():
        return spark.read.option("mode", "FAILFAST").json(path, multiLine=True)
    entries = whole.select(F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})).alias("_id", "item"))
    objects = entries.filter(F.col("item").rlike(r"^\s*\{"))
    if objects.limit(1).count() == 0:
        return entries.select("_id", F.col("item").alias("text"))
    return objects.select("_id", F.explode(F.from_json("item", "map<string,string>")).alias("key", "value")).groupBy("_id").pivot("key").agg(F.first("value"))


def section_files(root: str, section: str, split: str, optional: bool = False) -> list[str]:
    """Files of a section: itself, in its folder, beside it by name, or in a folder of its name further down. Judgements prefer
    files that name the split."""
    base = Path(root)

    def of(files) -> list[Path]:
        files = sorted(f for f in files if f.is_file() and f.suffix.lower() in SUFFIXES)
        named = [f for f in files if split.lower() in f.stem.lower()]
        return named if section == "qrels" and named else files

    if (base / section).is_file():
        return [str(base / section)]
    names = {section, f"{section}_{split.lower()}", f"{section}-{split.lower()}"}
    for found in (of((base / section).rglob("*")), sorted(f for f in of(base.glob("*")) if f.stem.lower() in names) if section != "qrels" else
                  sorted(f for f in base.glob("*") if f.is_file() and f.suffix.lower() in SUFFIXES and f.stem.lower() in names),
                  of(f for f in base.rglob("*") if section in f.parts[:-1])):
        if found:
            return [str(f) for f in found]
    if optional:
        return []
    raise FileNotFoundError(f"No {section} files below {root}")


def first_of(columns: list[str], names: list[str], what: str) -> Column:
    """The value under the first of ``names`` that is there; none at all, only blank ones, or different ones are errors."""
    there = [F.col(f"`{n}`").cast("string") for n in names if n in columns]
    if not there:
        raise ValueError(f"{what} is missing one of: {', '.join(names)}")
    values = F.array_compact(F.array(*there))
    filled = F.filter(values, lambda x: F.trim(x) != "")
    wrong = (F.when(F.size(values) == 0, f"{what} is missing one of: {', '.join(names)}")
             .when(F.size(filled) == 0, f"{what} is empty").when(F.size(F.array_distinct(filled)) > 1, f"{what} has conflicting fields"))
    return F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(filled[0])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fail(df: DataFrame, message: str) -> None:
    """An error with an example if there is any row."""
    row = df.first()
    if row is not None:
        raise ValueError(f"{message}: {tuple(row)}")


def parse_corpus(frames: list[DataFrame]) -> DataFrame:
    out = _union([f.select(first_of(f.columns, CORPUS_ID, "corpus id").alias("id"), first_of(f.columns, CORPUS_TEXT, "corpus text").alias("text"),
                           (F.coalesce(F.col("title"), F.lit("")) if "title" in f.columns else F.lit("")).alias("title")) for f in frames])
    _fail(out.groupBy("id").count().filter("count > 1"), "Duplicate corpus id")
    if out.limit(1).count() == 0:
        raise ValueError("The corpus is empty")
    return out.withColumn("pos", F.monotonically_increasing_id())


def parse_queries(frames: list[DataFrame]) -> DataFrame:
    out = _union([f.select(first_of(f.columns, QUERY_ID, "query id").alias("query_id"), first_of(f.columns, QUERY_TEXT, "query").alias("query")) for f in frames])
    _fail(out.groupBy("query_id").count().filter("count > 1"), "Duplicate query id")
    if out.limit(1).count() == 0:
        raise ValueError("The query set is empty")
    return out.withColumn("pos", F.monotonically_increasing_id())


def expand_nested(frame: DataFrame) -> DataFrame:
    """Rows {_id: query, document: score, ...} as a row per judgement."""
    if {"text", "score"} & set(frame.columns) or "_id" not in frame.columns:
        return frame
    pairs = [F.struct(F.lit(c).alias("corpus-id"), F.col(f"`{c}`").cast("string").alias("score")) for c in frame.columns if c != "_id"]
    return frame.select(F.col("_id").alias("query-id"), F.inline(F.array(*pairs))).filter("score IS NOT NULL")


def integrity(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judgements that break a rule: (problem, query_id, id). Rules: known query, known document, finite number, no pair twice."""
    grade = F.col("grade").try_cast("double")
    bad = grade.isNull() | F.isnan(grade) | (F.abs(grade) == float("inf"))
    rows = [
        qrels.join(queries.select("query_id"), "query_id", "left_anti").select(F.lit("unknown query").alias("problem"), "query_id", "id"),
        qrels.join(corpus.select("id"), "id", "left_anti").select(F.lit("unknown document").alias("problem"), "query_id", "id"),
        qrels.filter(bad).select(F.lit("score is not a finite number").alias("problem"), "query_id", "id"),
        qrels.groupBy("query_id", "id").count().filter("count > 1").select(F.lit("pair comes twice").alias("problem"), "query_id", "id")]
    return _union(rows)


def parse_qrels(frames: list[DataFrame], queries: DataFrame, corpus: DataFrame) -> DataFrame:
    parts = [f.select(first_of(f.columns, QREL_QUERY, "judged query").alias("query_id"), first_of(f.columns, QREL_CORPUS, "judged document").alias("id"),
                      first_of(f.columns, QREL_SCORE, "judgement").alias("grade")) for f in map(expand_nested, frames)]
    out = _union(parts)
    _fail(integrity(out, queries, corpus), "Invalid judgement")
    return out.withColumn("grade", F.col("grade").cast("double"))


def load_benchmark(spark: SparkSession, folder: str, split: str = "test", require_qrels: bool = False) -> Benchmark:
    if not Path(folder).is_dir():
        raise FileNotFoundError(f"No such folder: {folder}")
    if not split.strip():
        raise ValueError("split must not be empty")
    read = lambda section, optional=False: [read_rows(spark, f) for f in section_files(folder, section, split, optional)]
    corpus, queries = parse_corpus(read("corpus")), parse_queries(read("queries"))
    frames = read("qrels", optional=not require_qrels)
    return Benchmark(split, corpus, queries, parse_qrels(frames, queries, corpus) if frames else None)


def to_snippets(corpus: DataFrame) -> DataFrame:
    """Documents as snippets: the text as code, the title as docstring."""
    return with_defaults(corpus.select("id", F.lit("official").alias("repository"), F.lit("").alias("file_path"), F.lit("unknown").alias("language"), F.lit("official").alias("version"),
                                       F.lit("official").alias("commit_id"), F.col("text").alias("code"), F.col("title").alias("docstring")))


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.join(qrels, "query_id", "left_semi")


def export_benchmark(bench: Benchmark, folder: str) -> None:
    """corpus and queries as JSON lines, judgements as TSV; only queries with judgements."""
    bench.corpus.select(F.col("id").alias("_id"), "title", "text").write.mode("overwrite").json(f"{folder}/corpus")
    judged_queries(bench.queries, bench.qrels).select(F.col("query_id").alias("_id"), F.col("query").alias("text")).write.mode("overwrite").json(f"{folder}/queries")
    named = bench.qrels.select(F.col("query_id").alias("query-id"), F.col("id").alias("corpus-id"), F.col("grade").alias("score"))
    named.write.mode("overwrite").csv(f"{folder}/qrels/{bench.split}", sep="\t", header=True)


def problems(predictions: DataFrame, queries: DataFrame, corpus: DataFrame, top_k: int = 10) -> DataFrame:
    """What is wrong with predictions (query_id, id, score as text): (problem, query_id, id)."""
    none = F.lit(None).cast("string").alias("id")
    score = F.col("score").try_cast("double")
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")) | F.lower("score").isin("true", "false")
    rows = [
        predictions.select("query_id").distinct().join(queries, "query_id", "left_anti").select(F.lit("unknown query").alias("problem"), "query_id", none),
        predictions.groupBy("query_id").count().filter(F.col("count") > top_k).select(F.lit("too many documents").alias("problem"), "query_id", none),
        predictions.join(corpus.select("id"), "id", "left_anti").select(F.lit("unknown document").alias("problem"), "query_id", "id"),
        predictions.groupBy("query_id", "id").count().filter("count > 1").select(F.lit("document comes twice").alias("problem"), "query_id", "id"),
        predictions.filter(bad).select(F.lit("score is not a finite number").alias("problem"), "query_id", "id")]
    return _union(rows)


def validate_payload(payload: dict, bench: Benchmark, top_k: int = 10) -> None:
    """{split: {query: {document: score}}}: exactly this split and these queries, known documents, finite numbers, at most top_k."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    if not isinstance(payload, dict) or set(payload) != {bench.split}:
        raise ValueError(f"The payload must have exactly the split {bench.split!r}")
    rankings = payload[bench.split]
    if not isinstance(rankings, dict) or not all(isinstance(r, dict) for r in rankings.values()):
        raise ValueError("A split maps queries to documents and scores")
    spark = bench.queries.sparkSession
    named = spark.createDataFrame([(q,) for q in rankings], "query_id string")
    _fail(named.join(bench.queries, "query_id", "full_outer").filter("query IS NULL").select("query_id"), "Unknown query")
    _fail(bench.queries.join(named, "query_id", "left_anti").select("query_id"), "Missing query")
    rows = [(q, str(d), str(s)) for q, ranking in rankings.items() for d, s in ranking.items()]
    _fail(problems(spark.createDataFrame(rows, "query_id string, id string, score string"), bench.queries, bench.corpus, top_k), "Invalid prediction")


def payload_of(run: DataFrame, bench: Benchmark) -> dict:
    """The payload of a run (query_id, id, score, rank), queries and documents in order; what comes to the driver is top_k rows a query."""
    out: dict[str, dict[str, float]] = {q: {} for (q,) in bench.queries.orderBy("pos").select("query_id").toLocalIterator()}
    for q, d, s in run.orderBy("query_id", "rank").select("query_id", "id", "score").toLocalIterator():
        if d in out[q]:
            raise ValueError(f"Document {d!r} comes twice for query {q!r}")
        if not math.isfinite(s):
            raise ValueError(f"The score of {q!r}/{d!r} is not finite")
        out[q][d] = s
    return {bench.split: out}


def write_predictions(payload: dict, path: str, bench: Benchmark, top_k: int = 10) -> None:
    validate_payload(payload, bench, top_k)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def load_predictions(path: str, bench: Benchmark, top_k: int = 10) -> dict:
    """A payload from a file; a key that comes twice in an object is an error."""
    def once(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("Duplicate JSON object key")
        return out

    payload = json.loads(Path(path).read_text(encoding="utf-8"), object_pairs_hook=once)
    validate_payload(payload, bench, top_k)
    return payload
