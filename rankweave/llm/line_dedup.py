"""Line deduplication with levelled sorted runs of line hashes.

The corpus is taken in batches of ascending ids. A run holds the distinct line keys that earlier batches brought, by
hash, bucketed and sorted, so that a batch's own keys meet it in a merge join that moves only the batch. What the join
leaves over becomes a new run of level 0; ``fanout`` runs of a level are merged into one of the next.
"""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.common import body, delete_dir, fresh_dir, id_key, join_hot, materialize, shuffle_partitions, table

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
KEYS = ["__h", "__g"]


class SortedRuns:
    """The levelled runs: ``add`` brings a new run, ``seen`` says which of a batch's keys an earlier one brought."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.n = spark, fanout, [[]], shuffle_partitions(spark)

    def _write(self, keys: DataFrame) -> str:
        name, path = f"runs_{uuid.uuid4().hex}", fresh_dir(self.spark, "run")
        (keys.repartition(self.n, *KEYS).write.format("parquet").option("path", path)
             .bucketBy(self.n, *KEYS).sortBy(*KEYS).saveAsTable(name))
        return name

    def add(self, keys: DataFrame) -> None:
        self.levels[0].append(self._write(keys))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self._write(reduce(DataFrame.unionByName, [self.spark.table(x) for x in old]))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            self.levels[level] = []
            for x in old:
                self._drop(x)
            level += 1

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def split(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``keys`` that no run has, and those that one has."""
        new = reduce(lambda df, run: df.join(run, KEYS, "left_anti"), self.tables(), keys)
        old = [keys.join(run, KEYS, "left_semi") for run in self.tables()]  # runs share no key
        return new, reduce(DataFrame.unionByName, old, keys.limit(0))

    def _drop(self, name: str) -> None:
        path = self.spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first()[1]
        self.spark.sql(f"DROP TABLE {name}")
        delete_dir(self.spark, path)

    def close(self) -> None:
        for level in self.levels:
            for x in level:
                self._drop(x)


def line_key(line):
    """The line without white space around it, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Drop lines whose key (of at least ``min_chars`` code points) a document with a smaller id has.

    Returns the columns of ``docs`` with ``text_col`` made of the lines that stay, then ``n_lines`` (before dropping)
    and ``n_dropped``; input columns of these two names are replaced. A null or empty text is one empty line and
    comes out empty. A null id counts as one document that precedes all others. Rows that share an id are one
    document: they never drop each other's lines. Line keys are compared by 96 bits of hash.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped", text_col)]
    own = docs.select(id_key(id_col).alias("__k"), body(text_col).alias("__text"))
    lines = own.select("__k", F.xxhash64("__text").alias("__x"),
                       F.posexplode(F.split("__text", "\n", -1)).alias("__pos", "__line"))
    lines = lines.withColumn("__line", line_key(F.col("__line"))).filter(F.length("__line") >= min_chars)
    lines = lines.select("__k", "__x", "__pos", F.xxhash64("__line").alias("__h"), F.hash("__line").alias("__g"))
    bounds = own.agg(F.percentile_approx("__k", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = reduce(lambda a, b: a + b, [(F.col("__k") > b).cast("int") for b in sorted(set(bounds))], F.lit(0))
    lines = materialize(lines.withColumn("__batch", batch), "lines")
    total = lines.count()

    runs, drops = SortedRuns(spark, fanout), []
    for b in range(len(set(bounds)) + 1):
        mine = lines.filter(F.col("__batch") == b).drop("__batch")
        keys = materialize(mine.groupBy(*KEYS).agg(F.min("__k").alias("__first"), F.max("__k").alias("__last"), F.count("*").alias("__n")), "keys")
        new, old = runs.split(keys)
        shared = new.filter(F.col("__last") > F.col("__first")).unionByName(old.withColumn("__first", F.lit(None).cast("long")))
        shared = materialize(shared.drop("__last"), "shared")
        found = join_hot(mine, shared, KEYS, "__n", total)
        drops.append(materialize(found.filter(F.col("__first").isNull() | (F.col("__k") > F.col("__first"))).select("__k", "__x", "__pos"), "drops"))
        if b < len(set(bounds)):
            runs.add(new.select(*KEYS))
    runs.close()

    drops = reduce(DataFrame.unionByName, drops).groupBy("__k", "__x").agg(F.collect_set("__pos").alias("__drop"))
    rows = docs.select(*kept, id_key(id_col).alias("__k"), body(text_col).alias("__text")).withColumn("__x", F.xxhash64("__text"))
    rows = rows.join(drops, ["__k", "__x"], "left")
    parts = F.split("__text", "\n", -1)
    order = [c if c != text_col else "__kept" for c in docs.columns if c not in ("n_lines", "n_dropped")]
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__drop")), lambda i: parts[i])
    rows = rows.withColumn("__kept", F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(F.array_join(stay, "\n")))
    rows = rows.withColumn("n_lines", F.size(parts).cast("long")).withColumn("n_dropped", F.coalesce(F.size("__drop"), F.lit(0)).cast("long"))
    return rows.select(*order, "n_lines", "n_dropped").withColumnRenamed("__kept", text_col)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
first AS (SELECT k, min(doc_id) AS f FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, f IS NOT NULL AND doc_id > f AS gone FROM keyed LEFT JOIN first USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
