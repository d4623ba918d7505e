"""Quality rules: a log-likelihood ratio of hashed n-grams between trusted documents and the whole corpus.

Features are the lower-cased words without the punctuation at their ends, those ends, and pairs of neighbouring words, hashed
into ``BUCKETS``. Two counts for each bucket, over the trusted documents and over all, give it a log ratio, shrunk the more the
less evidence there is. Words and ends are one multinomial, in which a document's distinct words count once, as their
repetitions are no evidence of their own; pairs are another. None is cut off. A document's score is the sum over its features
divided by its words (and ``PRIOR_WORDS``), so that length plays little part, and documents below a fixed threshold are rejected. All counts are whole numbers and all weights millionths,
so that the verdict does not depend on the order of any sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.common import body, id_key, materialize, table

SPACE = " \t\n\x0b\x0c\r"
PUNCTUATION = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, REPEAT_WORDS, REPEAT_PERCENT = 20, 8, 30
BUCKETS = 1 << 18
HALF = BUCKETS // 2  # tokens are hashed into the lower half of the buckets, pairs into the upper one
#: Trusted documents are at most so many (those with the least hash of the id); counts of the corpus are over all of it.
TRUSTED_DOCS = 50_000
#: A log ratio counts by (G / (G + evidence)) ** POWER; G: twice the log likelihood that it explains. Pairs, which count every time, need more.
SMOOTHING, EVIDENCE, PAIR_EVIDENCE, POWER = 0.5, 5.0, 12.0, 3
PRIOR_WORDS = 100  # words without a say that every document has besides its own, so that no single one rejects a short text
THRESHOLD = -0.015
UNIT = 1_000_000


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, window: int = REPEAT_WORDS) -> Column:
    """How many words lie in a run of ``window`` (a power of two) words that occurs at least twice in ``words``.

    The runs are hashed by doubling, and only as far as runs of half a window repeat. Only where two hashes are equal are
    they sorted with their positions (by sort_array: array_sort calls a lambda for every two values it compares).
    """
    def doubled(hashes: Column, size: int) -> Column:
        return _let(hashes, lambda h: F.zip_with(h, F.slice(h, size + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b)))

    def distinct(h: Column) -> Column:
        return F.size(F.array_distinct(h)) == F.size(h)

    def covered(h: Column) -> Column:
        in_order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = _let(in_order, lambda s: F.filter(F.transform(s, lambda x, i: F.when(
            (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]), x["i"])), lambda x: x.isNotNull()))
        return _let(F.sort_array(found), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b))

    def runs(h: Column, size: int) -> Column:
        return F.slice(h, 1, F.greatest(F.size(words) - size + 1, F.lit(0)))

    def at(h: Column, size: int) -> Column:
        """The words covered, from the hashes of the runs of ``size`` words."""
        if size == window:
            return F.when(distinct(h), F.lit(0)).otherwise(covered(h))
        longer = _let(runs(doubled(h, size), 2 * size), lambda x: at(x, 2 * size))
        # from runs of half the window on: where no run repeats, no longer one does
        return F.when(distinct(h), F.lit(0)).otherwise(longer) if 2 * size == window else longer

    return at(words, 1).cast("long")


def base_rules(text: Column) -> dict[str, Column]:
    """The counts that the base rules need, by name; ``__words`` is the list of words."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACE)) != "")
    return {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__words")),
    }


def word_list(text: Column) -> Column:
    """The words of a text, in order."""
    trimmed = F.trim(text, F.lit(SPACE))
    any_space = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    # splitting at one character needs no matching: most texts hold no space but blanks and line breaks
    blanks = F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), "")
    return F.when(text.rlike(r"[\x09\x0B-\x0D]"), any_space).otherwise(blanks)


def _word_buckets(word: Column) -> list[Column]:
    """Buckets of a word without the punctuation at its end, and of that; null where there is nothing."""
    stem = F.rtrim(word, F.lit(PUNCTUATION))
    end = F.substring(word, F.length(stem) + 1, F.length(word))
    return [F.when(x != "", F.xxhash64(F.lit(kind), x).bitwiseAND(HALF - 1).cast("int")) for kind, x in ((1, stem), (2, end))]


def _pair_bucket(a: Column, b: Column) -> Column:
    """The bucket of a pair of words, in the upper half; null without a second word."""
    return F.when(b.isNotNull(), HALF + F.xxhash64(a, b).bitwiseAND(HALF - 1).cast("int"))


def _pairs(words: str) -> Column:
    """The words of a list as structs with the word behind each; ``b`` of the last is null."""
    return F.arrays_zip(F.col(words).alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"))


def _counts(rows: DataFrame) -> DataFrame:
    """``bucket``, ``raw``, ``good``: how many distinct words of documents have a feature, and how often a pair occurs; in all and in
    trusted documents."""
    words = rows.select("__good", word_list(F.lower("__text")).alias("w"))
    # distinct words come without a second one, pairs without the last word
    single = F.arrays_zip(F.array_distinct("w").alias("a"), F.slice("w", F.lit(1), F.lit(0)).alias("b"))
    pairs = F.slice(_pairs("w"), F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))
    both = words.select("__good", F.explode(F.concat(single, pairs)).alias("f")).select("__good", "f.a", "f.b")
    stem, end = _word_buckets(F.col("a"))
    one = F.when(F.col("b").isNotNull(), _pair_bucket(F.col("a"), F.col("b"))).otherwise(stem)
    hits = both.select("__good", F.explode(F.array(one, F.when(F.col("b").isNull(), end))).alias("bucket")).filter("bucket IS NOT NULL")
    return hits.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__good").alias("good"))


def _sums(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` (``__text`` and keys) as the sum of the weights of all features of the texts, ``__sum``, by the keys.

    The weights stand in one array, by bucket, that every task has: at most BUCKETS numbers, so that a feature is looked up in
    place and makes no row of its own.
    """
    keys = [c for c in rows.columns if c != "__text"]
    every = rows.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(weights, "bucket", "left")
    in_order = F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("weight", F.lit(0)).alias("weight"))))
    listed = materialize(every.agg(in_order.alias("x")).select(F.col("x.weight").alias("__weights")), "listed")
    both = rows.select(*keys, word_list(F.lower("__text")).alias("w")).select(*keys, F.explode(_pairs("w")).alias("f"))
    both = both.select(*keys, "f.a", "f.b").crossJoin(F.broadcast(listed))
    found = [F.coalesce(F.get("__weights", bucket), F.lit(0)) for bucket in (*_word_buckets(F.col("a")), _pair_bucket(F.col("a"), F.col("b")))]
    return both.select(*keys, (found[0] + found[1] + found[2]).alias("weight")).groupBy(*keys).agg(F.sum("weight").alias("__sum"))


def trusted_ids(labels: DataFrame, bound: int = TRUSTED_DOCS) -> DataFrame:
    """At most ``bound`` ids whose every label says good and not toxic."""
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return good.filter("q >= 1 AND t = 0").select(F.col("doc_id").cast("long").alias("__k")).orderBy(F.xxhash64("__k"), "__k").limit(bound)


def bucket_weights(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``bucket``, ``weight`` (millionths) of the buckets by how they tell trusted documents from the corpus; at most BUCKETS rows."""
    trusted = F.broadcast(trusted_ids(labels).withColumn("__good", F.lit(1)))
    rows = docs.select(id_key(id_col).alias("__k"), body(text_col).alias("__text")).join(trusted, "__k", "left").select("__good", "__text")
    counts = materialize(_counts(rows), "buckets")
    rates = {above: good / raw for above, raw, good in counts.groupBy(F.col("bucket") >= HALF).agg(F.sum("raw"), F.sum("good")).collect()}
    rate = F.when(F.col("bucket") >= HALF, F.lit(rates.get(True, 0.0))).otherwise(F.lit(rates.get(False, 0.0)))
    expected = F.col("raw") * rate
    good_n = F.col("good").cast("double")
    told = F.greatest(2 * (F.when(good_n > 0, good_n * F.log(good_n / expected)).otherwise(0.0) - good_n + expected), F.lit(0.0))
    doubt = F.when(F.col("bucket") >= HALF, F.lit(PAIR_EVIDENCE)).otherwise(F.lit(EVIDENCE))
    ratio = F.log((good_n + SMOOTHING) / (expected + SMOOTHING)) * F.pow(told / (told + doubt), F.lit(POWER))
    weight = F.round(UNIT * ratio).cast("long")
    return counts.filter(expected > 0).select("bucket", weight.alias("weight"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``score`` (log ratio for each word; 0 without words) and ``kept``; input columns of these names are replaced.

    A null text has no words and fails the base rules, as does an empty one. Without trusted documents every score is 0.
    Rows with equal id and text get equal results. Only DataFrame functions; nothing leaves the JVM.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    kept = [c for c in docs.columns if c not in made]
    weights = materialize(bucket_weights(docs, labels, id_col, text_col), "weights")
    own = docs.select(id_key(id_col).alias("__k"), body(text_col).alias("__text")).withColumn("__x", F.xxhash64("__text"))
    sums = _sums(own.dropDuplicates(["__k", "__x"]) if _repeats(docs, id_col) else own, weights)

    rows = docs.select(*kept, id_key(id_col).alias("__k"), body(text_col).alias("__text"))
    rows = rows.withColumn("__x", F.xxhash64("__text")).withColumn("__words", word_list(F.col("__text")))
    rows = rows.withColumns(base_rules(F.col("__text"))).drop("__words", "__text")
    rows = rows.join(sums, ["__k", "__x"], "left").withColumn("__sum", F.coalesce("__sum", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    passed = F.col("__sum") >= (F.col("n_words") + PRIOR_WORDS) * round(threshold * UNIT)
    score = F.col("__sum") / (F.col("n_words") + PRIOR_WORDS) / UNIT
    rows = rows.withColumns({"base_failed": failed, "score": score, "kept": ~failed & passed})
    return rows.select(*kept, *made)


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether an id has more than one row."""
    return docs.groupBy(F.col(id_col)).count().filter("count > 1").limit(1).count() > 0


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
