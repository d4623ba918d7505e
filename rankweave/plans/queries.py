"""The registered queries over the test tables, and DuckDB SQL with the same results.

``documents`` are snippets (doc_id as id, text as code, source as repository, lang as language; version and function name follow from
doc_id), ``benchmark`` items are queries, ``embeddings`` are the vectors of the documents and items of the same number. A document is
judged relevant to an item if it holds any 13 consecutive words of it (all of a shorter one); its grade is 1 plus its quality label.

The index of a table is built by the first query that needs it and read by the others, until the table changes.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave import vocabulary as V
from rankweave.config import RetrievalConfig
from rankweave.functions import text as X
from rankweave.functions.understand import PROGRAMMING_TERMS, intent_score, understand
from rankweave.operators import fusion, lexical, metrics, vectors
from rankweave.operators.filters import filter_candidates
from rankweave.operators.rerank import rerank
from rankweave.plans.engine import Engine
from rankweave.sources import benchmark as bm
from rankweave.sources import chunking
from rankweave.sources.snippets import with_defaults
from rankweave.storage import modified, stored

CODE = dataclasses.replace(RetrievalConfig(), field_weights={"code": 1.0})
WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("code"), F.col("lang").alias("language"),
                                               F.col("source").alias("repository"), F.concat(F.lit("v"), F.col("doc_id") % 3 + 1).alias("version"),
                                               F.concat(F.lit("f"), F.floor(F.col("doc_id") / 3)).alias("function_name"))


def snippets(spark, sf):
    return with_defaults(documents(spark, sf))


def items(spark, sf):
    return read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


_BUILT: dict[tuple, lexical.LexicalIndex] = {}


def index(spark, sf):
    """The stored index of the documents."""
    at = (spark.sparkContext.applicationId, sf, modified(spark, f"{sf}/documents.parquet"))
    if at not in _BUILT:
        _BUILT[at] = lexical.build_index(documents(spark, sf).select("id", "code"), CODE)
    return _BUILT[at]


def build_index(spark, sf):
    """Builds the index anew; the size of each of its tables."""
    built = lexical.build_index(documents(spark, sf).select("id", "code"), CODE)
    sizes = [getattr(built, n).agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n in ("postings", "term_stats", "field_stats", "ids")]
    return reduce(DataFrame.unionByName, sizes)


def vector_rows(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))


def lexical_run(spark, sf):
    return lexical.bm25_search(items(spark, sf), index(spark, sf), CODE)


def semantic_run(spark, sf):
    asked = items(spark, sf).join(vector_rows(spark, sf).withColumnRenamed("id", "query_id"), "query_id").select("query_id", "vector")
    return vectors.dense_search(asked, vector_rows(spark, sf))


def fused(spark, sf, method="rrf"):
    return fusion.fuse(lexical_run(spark, sf), semantic_run(spark, sf), dataclasses.replace(CODE, fusion_method=method))


def pool(spark, sf):
    return fused(spark, sf).join(snippets(spark, sf), "id")


def windows(rows, text, sizes):
    """``rows`` with ``w``, the hash of every run of so many words of ``text`` (and of how many), each once."""
    def runs(words: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.xxhash64(F.lit(n), F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))

    found = X.let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: F.array_distinct(F.concat(*[runs(words, n) for n in sizes])))
    return rows.select(*rows.columns, F.explode(found).alias("w"))


def judgements(spark, sf):
    """Documents by the windows of the items that they hold: a join of hashes, of whole texts on both sides. Stored, as metrics read them twice."""
    asked = items(spark, sf).withColumn("n", F.least(F.lit(WINDOW), F.size(F.regexp_extract_all("query", F.lit(WORD), F.lit(0))))).filter("n > 0")
    sizes = sorted(r["n"] for r in asked.select("n").distinct().collect())  # WINDOW numbers at most
    wanted = [windows(asked.filter(F.col("n") == n), F.col("query"), [n]) for n in sizes] or [asked.withColumn("w", F.lit(0).cast("long"))]
    wanted = reduce(DataFrame.unionByName, wanted).select("query_id", "w")
    docs = windows(documents(spark, sf).select("id", "code"), F.col("code"), sizes or [WINDOW]).select("id", "w")
    hits = docs.join(wanted, "w").select("query_id", "id").distinct()
    labels = read(spark, sf, "labels").groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max("quality").alias("quality"))
    return stored(hits.join(labels, "id", "left").select("query_id", "id", (1.0 + F.coalesce("quality", F.lit(0))).alias("grade")), "judgements")


def token_stats(spark, sf):
    docs = documents(spark, sf).withColumn("t", X.tokenize(F.col("code")))
    return docs.select("id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("terms"))


def identifier_split(spark, sf):
    words = documents(spark, sf).select(F.explode(X.items(F.col("code"))).alias("item"))
    return words.groupBy("item").count().select("item", F.array_join(X.split_identifier(F.col("item")), " ").alias("parts"), F.col("count").alias("n"))


def postings_df_idf(spark, sf):
    return index(spark, sf).term_stats.select("term", "df", F.round("idf", 9).alias("idf"))


def field_avgdl(spark, sf):
    return lexical.build_index(snippets(spark, sf)).field_stats.select("field", F.col("n").cast("long").alias("n"), F.round("avgdl", 9).alias("avgdl"))


def bm25_topk(spark, sf):
    return lexical_run(spark, sf)


def bm25_zero_fill(spark, sf):
    """Lists as long as there are documents with a token: every one of them comes, those without a match with nothing."""
    own = index(spark, sf)
    return lexical.bm25_search(items(spark, sf), own, CODE, n=own.ids.count())


def vector_norms(spark, sf):
    return vector_rows(spark, sf).select("id", F.round(vectors.norm(F.col("vector")), 6).alias("norm"))


def minmax_normalize(spark, sf):
    return lexical_run(spark, sf).select("query_id", "id", F.round(fusion.minmax(F.col("score")), 6).alias("normalized"))


def rounded_pool(df):
    return df.select("query_id", "id", F.round("lexical_score", 6).alias("lexical_score"), F.round("semantic_score", 6).alias("semantic_score"), "lexical_rank", "semantic_rank",
                     "fusion_score", "pool_rank")


def rrf_fusion(spark, sf):
    return rounded_pool(fused(spark, sf))


def weighted_fusion(spark, sf):
    return fused(spark, sf, "weighted").select("query_id", "id", F.round("fusion_score", 6).alias("fusion_score"))


def metadata_filter(spark, sf):
    return filter_candidates(pool(spark, sf), {"language": ["en", "fr"], "version": "v2", "snippet_type": "generic"}).select("query_id", "id", "pool_rank")


def latest_version(spark, sf):
    return filter_candidates(pool(spark, sf), {"version": "latest"}).select("query_id", "id", "version", "pool_rank")


def version_order(spark, sf):
    labels = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("v"), (F.col("doc_id") / 100).cast("long"), F.lit("."), F.col("doc_id") % 100).alias("label"))
    order = Window.partitionBy(F.pmod("doc_id", F.lit(50))).orderBy(F.desc("key"), "doc_id")
    return labels.withColumn("key", X.version_key(F.col("label"))).select("doc_id", "label", F.row_number().over(order).alias("place"))


def hybrid_search(spark, sf):
    order = Window.partitionBy("query_id").orderBy("pool_rank")
    return pool(spark, sf).withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("query_id", "rank", "id", F.bround("fusion_score", 6).alias("score"), "language", "version", "repository")


def hybrid_filtered(spark, sf):
    order = Window.partitionBy("query_id").orderBy("pool_rank")
    kept = filter_candidates(pool(spark, sf), {"language": "en", "version": "latest"})
    return kept.withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("query_id", "rank", "id", "version")


def query_metrics(spark, sf):
    run = lexical_run(spark, sf).filter("rank <= 10")
    out = metrics.per_query(run, judgements(spark, sf), items(spark, sf))
    return out.select("query_id", *[F.round(c, 9).alias(c) for c in ("rr", "ndcg", "recall_5", "recall_k")])


def eval_summary(spark, sf):
    run = lexical_run(spark, sf).filter("rank <= 10")
    return metrics.summary(metrics.per_query(run, judgements(spark, sf), items(spark, sf)))


def ablation(spark, sf):
    """Metrics of each ranking by itself and of their fusion. Either ranking is made once."""
    qrels, asked = judgements(spark, sf), items(spark, sf)
    lexical_, semantic = stored(lexical_run(spark, sf), "lexical"), stored(semantic_run(spark, sf), "semantic")
    runs = {"lexical": lexical_, "semantic": semantic, "fused": fusion.fuse(lexical_, semantic, CODE).withColumnRenamed("pool_rank", "rank")}
    rows = [metrics.summary(metrics.per_query(run.filter("rank <= 10"), qrels, asked)).select(F.lit(name).alias("setting"), "*") for name, run in runs.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def version_intent(spark, sf):
    """Intent of item texts to which words about versions are added by number."""
    added = F.element_at(F.array(*[F.lit(x) for x in (" latest version", " version 2", " v3.1", " the current one", "")]), (F.col("item_id") % 5 + 1).cast("int"))
    texts = read(spark, sf, "benchmark").select("item_id", F.concat("text", added).alias("q"))
    return texts.select("item_id", X.version_intent(F.col("q")).alias("v")).select("item_id", "v.*")


def snippet_ids(spark, sf):
    return documents(spark, sf).select("id", X.snippet_id(F.col("repository"), F.lit("a/b.py"), F.col("version"), F.lit(1), F.lit(2), F.col("code")).alias("snippet_id"))


def qrels_integrity(spark, sf):
    """The judgements, and bad ones made of them: each rule finds its own."""
    good = judgements(spark, sf).withColumn("grade", F.col("grade").cast("string"))
    bad = good.withColumn("query_id", F.concat(F.lit("no-"), "query_id")).unionByName(good.withColumn("id", F.concat(F.lit("no-"), "id"))).unionByName(good).unionByName(good.withColumns({"id": F.lit("1"), "grade": F.lit("NaN")}))
    return bm.integrity(good.unionByName(bad), items(spark, sf), documents(spark, sf)).groupBy("problem").agg(F.count("*").alias("n"))


def prediction_validation(spark, sf):
    run = lexical_run(spark, sf).filter("rank <= 12").select("query_id", F.when(F.col("rank") == 5, F.concat(F.lit("no-"), "id")).otherwise(F.col("id")).alias("id"),
                                                            F.when(F.col("rank") == 7, "inf").otherwise(F.col("score").cast("string")).alias("score"))
    return bm.problems(run, items(spark, sf), documents(spark, sf)).groupBy("problem").agg(F.count("*").alias("n"))


def judged(spark, sf):
    return bm.judged_queries(items(spark, sf), judgements(spark, sf)).select("query_id")


def understanding(spark, sf):
    return understand(items(spark, sf)).select("query_id", "lexical_query", "primary_intent", "confidence", "version_intent", F.size("identifiers").alias("identifiers"))


def rerank_scores(spark, sf):
    asked = understand(items(spark, sf)).select("query_id", "identifiers", "technical_phrases", "primary_intent", "confidence", "version_intent", F.col("version").alias("requested_version"))
    out = rerank(pool(spark, sf).join(asked, "query_id"))
    return out.select("query_id", "id", "final_rank", F.round("final_score", 9).alias("final_score"), F.round("rerank_adjustment", 9).alias("rerank_adjustment"))


def hash_embed(spark, sf):
    """A digest of every vector, its values to six decimals."""
    out = vectors.hash_encode(documents(spark, sf).select("id", F.col("code").alias("text")))
    values = F.transform("vector", lambda x: F.format_number(x + 0.0, 6))
    return out.select("id", F.size("vector").alias("dimensions"), F.md5(F.array_join(values, ",")).alias("digest"))


def hash_cells(spark, sf):
    """The cells of every vector that are not zero, with MD5 as the hash."""
    out = vectors.hash_encode(documents(spark, sf).select("id", F.col("code").alias("text")), digest="md5")
    return out.select("id", F.posexplode("vector").alias("cell", "v")).filter("v <> 0").select("id", "cell", F.round("v", 6).alias("value"))


SHAPES = [".py", ".ts", ".java", ".go", ".xyz"]


def code_files(spark, sf):
    """Documents in the shape of source files: lines of code around the text, in a language by number."""
    docs = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in SHAPES]), (F.col("doc_id") % len(SHAPES) + 1).cast("int"))
    code = F.concat(F.lit("import a.b;\n# note\n// remark\n@Inject\nfunction f"), "doc_id", F.lit("() {\n"), "text", F.lit("\n}\n  @Bean\n@Other\nclass C"), "doc_id", F.lit(" {\n}"))
    return docs.select("doc_id", F.concat(F.lit("src/f"), "doc_id", suffix).alias("file_path"), code.alias("code"))


def chunk_documents(spark, sf):
    out = chunking.chunk_sources(code_files(spark, sf).select("file_path", "code"))
    return out.select("file_path", "snippet_type", "function_name", "start_line", "end_line", F.md5("code").alias("code_md5"))


def code_marks(spark, sf):
    """Imports, annotations and comments among the lines of source files, by language."""
    files = code_files(spark, sf).withColumn("language", chunking.infer_language(F.col("file_path")))
    found = {n: F.array_join(f(F.col("code"), F.col("language")), "|") for n, f in (("imports", chunking.imports), ("decorators", chunking.decorators), ("comments", chunking.comments))}
    return files.select("doc_id", "language", *[F.md5(c).alias(n) for n, c in found.items()])


def coded_items(spark, sf):
    """Distinct identifiers of a text that look like code."""
    found = documents(spark, sf).select("id", X.extract_identifiers(F.col("code")).alias("x"))
    return found.select("id", F.size("x").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("x"), " ")).alias("items"))


def phrase_match(spark, sf):
    """Anchor phrases in texts to which one is added by number."""
    known = F.array(*[F.lit(x) for x in V.TECHNICAL_PHRASES])
    docs = read(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.element_at(known, (F.col("doc_id") % len(V.TECHNICAL_PHRASES) + 1).cast("int"))).alias("q"))
    return docs.select("doc_id", F.array_join(X.technical_phrases(F.col("q")), "|").alias("phrases"))


def keyword_count(spark, sf):
    """Distinct keywords of a text: tokens of two characters or more that are no stopwords, and programming terms."""
    tokens = documents(spark, sf).select("id", X.tokenize(F.col("code")).alias("t"))
    kept = F.filter("t", lambda x: ((F.length(x) > 1) & ~x.isin(*V.STOPWORDS)) | x.isin(*PROGRAMMING_TERMS))
    return tokens.select("id", F.size(F.array_distinct(kept)).cast("long").alias("n"))


ASIDES = [" validate jwt token expiration in AuthService", " database connection pool DB_URL query", " unit tests assertion", " api request payload for the python endpoint", " parse_config(x) yaml in java"]


def asides(spark, sf):
    """Items to which words with an intent are added by number."""
    added = F.element_at(F.array(*[F.lit(x) for x in ASIDES]), (F.col("item_id") % len(ASIDES) + 1).cast("int"))
    return read(spark, sf, "benchmark").select("item_id", F.concat(F.coalesce("text", F.lit("")), added).alias("query"))


def intent_scores(spark, sf):
    q = F.col("query")
    rows = asides(spark, sf).select("item_id", X.tokenize(q).alias("t"), X.squeeze(q).alias("s"), X.extract_identifiers(q).alias("i"))
    scores = F.array(*[F.struct(F.lit(n).alias("intent"), intent_score(n, F.col("t"), F.col("s"), F.col("i")).alias("score")) for n in V.INTENTS])
    return rows.select("item_id", F.inline(scores))


def language_hints(spark, sf):
    out = understand(asides(spark, sf))
    return out.select("item_id", F.array_join(F.array_sort("language_hints"), " ").alias("hints"))


def semantic_texts(spark, sf):
    rows = snippets(spark, sf)
    return rows.select("id", F.md5(vectors.snippet_text(rows)).alias("text_md5"))


def engine_search(spark, sf):
    engine = Engine(snippets(spark, sf), RetrievalConfig(enable_reranking=True))
    return engine.search(items(spark, sf)).select("query_id", "rank", "snippet_id", "score")


QUERIES = {f.__name__: f for f in (
    token_stats, identifier_split, postings_df_idf, field_avgdl, bm25_topk, bm25_zero_fill, vector_norms, minmax_normalize, rrf_fusion, weighted_fusion, metadata_filter,
    latest_version, version_order, hybrid_search, hybrid_filtered, query_metrics, eval_summary, ablation, version_intent, snippet_ids, qrels_integrity, prediction_validation, judged,
    understanding, rerank_scores, hash_embed, hash_cells, chunk_documents, engine_search, build_index, code_marks, coded_items, phrase_match, keyword_count, intent_scores,
    language_hints, semantic_texts)} | {"dense_topk": semantic_run}

# --- the same in SQL, put together from named steps ---

IDENT = r"[A-Za-z_$][A-Za-z0-9_$]*(?:[._:/-][A-Za-z0-9_$]+)*"


def _parts(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[_./:$-]+'), lambda p: p <> '')"


def _tokens(x: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({x}, '{IDENT}'), lambda i: list_concat([lower(i)], {_parts('i')})))"


def _scores(query: str = "text", n: int | str = 100) -> str:
    return f"""
docs AS (SELECT doc_id::VARCHAR AS id, {_tokens("coalesce(text, '')")} AS t FROM documents),
posts AS (SELECT id, term, len(t) AS dl, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM docs) GROUP BY id, term, len(t)),
size AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM docs),
idf AS (SELECT term, count(*) AS df, ln(1.0 + ((SELECT n FROM size) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts GROUP BY term),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id::VARCHAR AS query_id, unnest({_tokens(query)}) AS term FROM benchmark) GROUP BY ALL),
matched AS (SELECT query_id, id, round(sum(1.0 * qtf * idf * tf * 2.5 / (tf + 1.5 * (1.0 - 0.75 + 0.75 * dl / greatest(avgdl, 1.0)))), 9) AS score
  FROM posts JOIN asked USING (term) JOIN idf USING (term), size GROUP BY query_id, id),
scored AS (SELECT query_id, id, coalesce(score, 0.0) AS score FROM (SELECT item_id::VARCHAR AS query_id FROM benchmark) CROSS JOIN (SELECT id FROM docs WHERE len(t) > 0) LEFT JOIN matched USING (query_id, id)),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= {n})"""


_DOT = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
SEM = f"""
sem AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT item_id::VARCHAR AS query_id, e.vec_id::VARCHAR AS id, round({_DOT}, 9) AS score FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings e)) WHERE rank <= 100)"""


def _minmax(stream: str) -> str:
    w = "OVER (PARTITION BY query_id)"
    return f"""(SELECT query_id, id, rank, CASE WHEN max(score) {w} > min(score) {w} THEN (score - min(score) {w}) / (max(score) {w} - min(score) {w}) WHEN max(score) {w} > 0 THEN 1.0 ELSE 0.0 END AS s FROM {stream})"""


def _pool(method: str = "rrf") -> str:
    score = "coalesce(0.45 / (60 + l.rank), 0.0) + coalesce(0.55 / (60 + s.rank), 0.0)" if method == "rrf" else "0.45 * coalesce(l.s, 0.0) + 0.55 * coalesce(s.s, 0.0)"
    return f"""{_scores()}, {SEM},
both_ AS (SELECT query_id, id, coalesce(l.s, 0.0) AS lexical_score, coalesce(s.s, 0.0) AS semantic_score, l.rank AS lexical_rank, s.rank AS semantic_rank, round({score}, 9) AS fusion_score
  FROM {_minmax('lex')} l FULL JOIN {_minmax('sem')} s USING (query_id, id)),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, id) AS pool_rank FROM both_) WHERE pool_rank <= 200),
snip AS (SELECT doc_id, doc_id::VARCHAR AS id, lang AS language, source AS repository, 'v' || (doc_id % 3 + 1) AS version, 'f' || (doc_id // 3) AS function_name FROM documents)"""


QRELS = f"""item_words AS (SELECT item_id::VARCHAR AS query_id, regexp_extract_all(text, '{WORD}') AS w FROM benchmark),
item_windows AS (SELECT query_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i : i + least({WINDOW}, len(w)) - 1], ' ') AS g
  FROM (SELECT query_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_windows AS (SELECT DISTINCT id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (
  SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT doc_id::VARCHAR AS id, regexp_extract_all(text, '{WORD}') AS w FROM documents), (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
qrels AS (SELECT query_id, id, 1.0 + coalesce(q, 0) AS grade
  FROM (SELECT DISTINCT query_id, id FROM doc_windows JOIN item_windows USING (n, g)) LEFT JOIN (SELECT doc_id::VARCHAR AS id, max(quality) AS q FROM labels GROUP BY 1) USING (id))"""


def _metrics(run: str) -> str:
    return f"""(WITH hits AS (SELECT query_id, id, rank, grade FROM {run} JOIN qrels USING (query_id, id) WHERE rank <= 10),
  f AS (SELECT query_id, min(rank) AS first, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (rank <= 5) AS a5, count(*) AS ak FROM hits GROUP BY 1),
  i AS (SELECT query_id, count(*) AS n, sum((2 ** grade - 1) / log2(r + 1)) FILTER (r <= 10) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS r FROM qrels) GROUP BY 1)
  SELECT query_id, coalesce(1.0 / first, 0) AS rr, coalesce(dcg / ideal, 0) AS ndcg, coalesce(a5 / n, 0) AS recall_5, coalesce(ak / n, 0) AS recall_k
  FROM (SELECT item_id::VARCHAR AS query_id FROM benchmark) LEFT JOIN i USING (query_id) LEFT JOIN f USING (query_id))"""


_MEANS = "round(avg(rr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg, round(avg(recall_5), 9) AS recall_5, round(avg(recall_k), 9) AS recall_k"
_LATEST = "row_number() OVER (PARTITION BY query_id, repository, function_name ORDER BY version DESC, pool_rank DESC)"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _by_number(column: str, values) -> str:
    return f"{_list(values)}[{column} % {len(values)} + 1]"


def _coded(x: str) -> str:
    return (f"list_distinct(list_filter(regexp_extract_all({x}, '{IDENT}'), lambda i: regexp_matches(i, '[-_$./:]') OR regexp_matches(i, '[a-z][A-Z]') "
            "OR (length(i) > 1 AND regexp_matches(i, '^[A-Z]'))))")


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


def _has(x: str, phrase: str) -> str:
    return f"regexp_matches({x}, '(^|[^a-z0-9_]){phrase}($|[^a-z0-9_])')"


def _intent(name: str) -> str:
    rule = V.INTENTS[name]
    parts = [f"1.0 * len(list_intersect({_list(rule.get('for', ['-']))}, t))", f"- 1.25 * len(list_intersect({_list(rule.get('against', ['-']))}, t))"]
    parts += [f"+ CASE WHEN {_has('s', p)} THEN 3.0 ELSE 0.0 END" for p in rule.get("phrases", ())]
    parts += [f"+ CASE WHEN regexp_matches(concat_ws(' ', array_to_string(i, ' '), s), '(?i){p}') THEN 2.0 ELSE 0.0 END" for p in rule.get("patterns", ())]
    return f"SELECT item_id, '{name}' AS intent, greatest(0.0, {' '.join(parts)})::DOUBLE AS score FROM r"


_ASIDE = f"""asked AS (SELECT item_id, coalesce(text, '') || {_by_number('item_id', ASIDES)} AS q FROM benchmark)"""
_FILES = f"""files AS (SELECT doc_id, 'src/f' || doc_id || {_by_number('doc_id', SHAPES)} AS file_path, {_by_number('doc_id', ['python', 'typescript', 'java', 'go', 'unknown'])} AS language,
  'import a.b;' || chr(10) || '# note' || chr(10) || '// remark' || chr(10) || '@Inject' || chr(10) || 'function f' || doc_id || '() {{' || chr(10) || coalesce(text, '') || chr(10) || '}}' || chr(10)
  || '  @Bean' || chr(10) || '@Other' || chr(10) || 'class C' || doc_id || ' {{' || chr(10) || '}}' AS code FROM documents)"""
_LINES = r"regexp_split_to_array(code, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"

ORACLES = {
    "token_stats": f"SELECT doc_id::VARCHAR AS id, len(t) AS tokens, len(list_distinct(t)) AS terms FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "identifier_split": f"SELECT item, array_to_string({_parts('item')}, ' ') AS parts, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{IDENT}')) AS item FROM documents) GROUP BY item",
    "postings_df_idf": f"WITH {_scores()} SELECT term, df, round(idf, 9) AS idf FROM idf",
    "field_avgdl": f"""WITH d AS (SELECT {_tokens('text')} AS c, {_tokens("'f' || (doc_id // 3)")} AS f FROM documents)
      SELECT 'code' AS field, count(*) AS n, round(sum(len(c)) / count(*), 9) AS avgdl FROM d UNION ALL SELECT 'function_name', count(*), round(sum(len(f)) / count(*), 9) FROM d""",
    "bm25_topk": f"WITH {_scores()} SELECT query_id, id, score, rank::INT AS rank FROM lex",
    "build_index": f"""WITH {_scores()} SELECT 'postings' AS part, count(*) AS n FROM posts UNION ALL SELECT 'term_stats', count(*) FROM idf UNION ALL SELECT 'field_stats', 1
      UNION ALL SELECT 'ids', count(*) FROM docs WHERE len(t) > 0""",
    "bm25_zero_fill": f"WITH {_scores(n='(SELECT count(*) FROM docs WHERE len(t) > 0)')} SELECT query_id, id, score, rank::INT AS rank FROM lex",
    "dense_topk": f"WITH {SEM} SELECT query_id, id, score, rank::INT AS rank FROM sem",
    "vector_norms": "SELECT vec_id::VARCHAR AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings",
    "minmax_normalize": f"WITH {_scores()} SELECT query_id, id, round(s, 6) AS normalized FROM {_minmax('lex')}",
    "rrf_fusion": f"""WITH {_pool()} SELECT query_id, id, round(lexical_score, 6) AS lexical_score, round(semantic_score, 6) AS semantic_score, lexical_rank::INT AS lexical_rank,
      semantic_rank::INT AS semantic_rank, fusion_score, pool_rank::INT AS pool_rank FROM pool""",
    "weighted_fusion": f"WITH {_pool('weighted')} SELECT query_id, id, round(fusion_score, 6) AS fusion_score FROM pool",
    "metadata_filter": f"WITH {_pool()} SELECT query_id, id, pool_rank::INT AS pool_rank FROM pool JOIN snip USING (id) WHERE language IN ('en', 'fr') AND version = 'v2'",
    "latest_version": f"WITH {_pool()} SELECT query_id, id, version, pool_rank::INT AS pool_rank FROM pool JOIN snip USING (id) QUALIFY {_LATEST} = 1",
    "version_order": """WITH l AS (SELECT doc_id, 'v' || (doc_id // 100) || '.' || (doc_id % 100) AS label FROM documents)
      SELECT doc_id, label, (row_number() OVER (PARTITION BY doc_id % 50 ORDER BY list_transform(string_split(substr(label, 2), '.'), lambda x: x::BIGINT) DESC, doc_id))::INT AS place FROM l""",
    "hybrid_search": f"""WITH {_pool()} SELECT query_id, (row_number() OVER w)::INT AS rank, id, round(fusion_score, 6) AS score, language, version, repository
      FROM pool JOIN snip USING (id) WINDOW w AS (PARTITION BY query_id ORDER BY pool_rank) QUALIFY row_number() OVER w <= 10""",
    "hybrid_filtered": f"""WITH {_pool()}, k AS (SELECT * FROM pool JOIN snip USING (id) WHERE language = 'en' QUALIFY {_LATEST} = 1)
      SELECT query_id, (row_number() OVER w)::INT AS rank, id, version FROM k WINDOW w AS (PARTITION BY query_id ORDER BY pool_rank) QUALIFY row_number() OVER w <= 10""",
    "query_metrics": f"WITH {_scores()}, {QRELS} SELECT query_id, round(rr, 9) AS rr, round(ndcg, 9) AS ndcg, round(recall_5, 9) AS recall_5, round(recall_k, 9) AS recall_k FROM {_metrics('lex')}",
    "eval_summary": f"WITH {_scores()}, {QRELS} SELECT {_MEANS} FROM {_metrics('lex')}",
    "ablation": f"""WITH {_pool()}, {QRELS}, fus AS (SELECT query_id, id, pool_rank AS rank FROM pool)
      SELECT 'lexical' AS setting, {_MEANS} FROM {_metrics('lex')} UNION ALL SELECT 'semantic', {_MEANS} FROM {_metrics('sem')} UNION ALL SELECT 'fused', {_MEANS} FROM {_metrics('fus')}""",
    "version_intent": r"""WITH q AS (SELECT item_id, text || (CASE item_id % 5 WHEN 0 THEN ' latest version' WHEN 1 THEN ' version 2' WHEN 2 THEN ' v3.1' WHEN 3 THEN ' the current one' ELSE '' END) AS q FROM benchmark),
      p AS (SELECT item_id, regexp_matches(lower(q), '\b(latest|newest|most recent|current)\b') AS l,
        coalesce(nullif(regexp_extract(q, '(?i)\bv\s*(\d+(?:\.\d+)*)\b|\bversion\s+(\d+(?:\.\d+)*)\b', 1), ''), nullif(regexp_extract(q, '(?i)\bv\s*(\d+(?:\.\d+)*)\b|\bversion\s+(\d+(?:\.\d+)*)\b', 2), '')) AS n FROM q)
      SELECT item_id, CASE WHEN l THEN 'latest' WHEN n IS NOT NULL THEN 'specific' ELSE 'none' END AS version_intent, CASE WHEN NOT l AND n IS NOT NULL THEN 'v' || n END AS version FROM p""",
    "snippet_ids": "SELECT doc_id::VARCHAR AS id, substr(sha1(source || '|a/b.py|v' || (doc_id % 3 + 1) || '|1|2|' || coalesce(text, '')), 1, 16) AS snippet_id FROM documents",
    "qrels_integrity": f"""WITH {QRELS}, g AS (SELECT query_id, id, grade::VARCHAR AS grade FROM qrels),
      a AS (SELECT * FROM g UNION ALL SELECT 'no-' || query_id, id, grade FROM g UNION ALL SELECT query_id, 'no-' || id, grade FROM g UNION ALL SELECT * FROM g UNION ALL SELECT query_id, '1', 'NaN' FROM g)
      SELECT 'unknown query' AS problem, count(*) AS n FROM a WHERE query_id NOT IN (SELECT item_id::VARCHAR FROM benchmark)
      UNION ALL SELECT 'unknown document', count(*) FROM a WHERE id NOT IN (SELECT doc_id::VARCHAR FROM documents)
      UNION ALL SELECT 'score is not a finite number', count(*) FROM a WHERE grade = 'NaN'
      UNION ALL SELECT 'pair comes twice', count(*) FROM (SELECT 1 FROM a GROUP BY query_id, id HAVING count(*) > 1)""",
    "prediction_validation": f"""WITH {_scores()} SELECT 'too many documents' AS problem, count(*) AS n FROM (SELECT 1 FROM lex WHERE rank <= 12 GROUP BY query_id HAVING count(*) > 10)
      UNION ALL SELECT 'unknown document', count(*) FROM lex WHERE rank = 5 UNION ALL SELECT 'score is not a finite number', count(*) FROM lex WHERE rank = 7""",
    "judged": f"WITH {QRELS} SELECT DISTINCT query_id FROM qrels",
    "coded_items": f"SELECT id, len(x) AS n, md5(array_to_string(list_sort(x), ' ')) AS items FROM (SELECT doc_id::VARCHAR AS id, {_coded("coalesce(text, '')")} AS x FROM documents)",
    "phrase_match": f"""WITH q AS (SELECT doc_id, {_squeeze("coalesce(text, '') || ' ' || " + _by_number('doc_id', V.TECHNICAL_PHRASES))} AS s FROM documents)
      SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {_has('s', p)} THEN '{p}' END" for p in sorted(V.TECHNICAL_PHRASES, key=len, reverse=True))}], lambda x: x IS NOT NULL), '|') AS phrases FROM q""",
    "keyword_count": f"""SELECT doc_id::VARCHAR AS id, len(list_distinct(list_filter({_tokens("coalesce(text, '')")}, lambda x: (length(x) > 1 AND NOT list_contains({_list(V.STOPWORDS)}, x))
      OR list_contains({_list(PROGRAMMING_TERMS)}, x)))) AS n FROM documents""",
    "intent_scores": f"WITH {_ASIDE}, r AS (SELECT item_id, {_tokens('q')} AS t, {_squeeze('q')} AS s, {_coded('q')} AS i FROM asked) " + " UNION ALL ".join(map(_intent, V.INTENTS)),
    "language_hints": f"""WITH {_ASIDE}, names AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in V.LANGUAGE_TERMS.items())}) v(token, hint)),
      found AS (SELECT item_id, string_agg(DISTINCT hint, ' ' ORDER BY hint) AS hints FROM (SELECT item_id, unnest({_tokens('q')}) AS token FROM asked) JOIN names USING (token) GROUP BY item_id)
      SELECT item_id, coalesce(hints, '') AS hints FROM asked LEFT JOIN found USING (item_id)""",
    "semantic_texts": "SELECT doc_id::VARCHAR AS id, md5(concat_ws(chr(10), 'f' || (doc_id // 3), nullif(text, ''))) AS text_md5 FROM documents",
    "code_marks": rf"""WITH {_FILES}, l AS (SELECT doc_id, language, list_transform(string_split(code, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS x FROM files)
      SELECT doc_id, language,
        md5(array_to_string(list_filter(x, lambda y: CASE language WHEN 'python' THEN starts_with(y, 'import ') OR starts_with(y, 'from ') WHEN 'typescript' THEN starts_with(y, 'import ') OR (starts_with(y, 'const ') AND contains(y, 'require(')) WHEN 'java' THEN starts_with(y, 'import ') ELSE false END), '|')) AS imports,
        md5(array_to_string(list_filter(x, lambda y: language IN ('python', 'typescript', 'java') AND starts_with(y, '@') AND length(y) > 1), '|')) AS decorators,
        md5(array_to_string(list_filter(x, lambda y: CASE WHEN language = 'python' THEN starts_with(y, '#') WHEN language IN ('typescript', 'java') THEN starts_with(y, '//') OR starts_with(y, '/*') OR starts_with(y, '*')
          ELSE starts_with(y, '#') OR starts_with(y, '//') END), '|')) AS comments FROM l""",
    "hash_cells": f"""WITH t AS (SELECT doc_id::VARCHAR AS id, unnest({_tokens("coalesce(text, '')")}) AS t FROM documents),
      f AS (SELECT id, unnest([t, substr(t, 1, 4), right(t, 4)]) AS feature FROM t),
      c AS (SELECT id, md5(feature) AS h, count(*) AS n FROM f GROUP BY id, feature),
      cells AS (SELECT id, (('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT % 384)::INT AS cell,
        sum(CASE WHEN substr(h, 10, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN n ELSE -n END)::DOUBLE AS v FROM c GROUP BY ALL)
      SELECT id, cell, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY id)), 1e-12), 6) AS value FROM cells WHERE v <> 0""",
    "chunk_documents": f"""WITH {_FILES}, l AS (SELECT file_path, x, len(x) AS n, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT file_path, {_LINES} AS x FROM files WHERE language <> 'python')),
      m AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(line, '{p}') THEN '{kind}'" for p, kind in chunking.DECLARATIONS)} END AS kind,
        CASE {' '.join(f"WHEN regexp_matches(line, '{p}') THEN regexp_extract(line, '{p}', 1)" for p, _ in chunking.DECLARATIONS)} END AS name,
        coalesce(max(CASE WHEN NOT starts_with(trim(line), '@') THEN i END) OVER (PARTITION BY file_path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM l),
      h AS (SELECT *, coalesce(lead(above) OVER (PARTITION BY file_path ORDER BY i), n) AS stop FROM m WHERE kind IS NOT NULL)
      SELECT file_path, kind AS snippet_type, name AS function_name, above + 1 AS start_line, greatest(above + 1, stop) AS end_line, md5(array_to_string(x[above + 1 : stop], chr(10))) AS code_md5 FROM h
      UNION ALL SELECT file_path, 'module', '', 1, len(string_split(code, chr(10))), md5(code) FROM files WHERE language = 'python'""",
}
