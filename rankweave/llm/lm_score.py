"""Language-model scoring with a lattice over subwords.

A word is a path of pieces of an existing vocabulary; its probability is the sum over all paths of the product of their pieces'
unigram probabilities, by a forward recursion in log space. The probabilities start from the vocabulary's own scores and are
estimated from the training documents by expectation maximisation over their distinct words, weighted by how often they occur. The
end of a text is a piece of its own, so the probabilities of all texts sum to at most one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.common import body, discard, materialize, part_batches, shuffle_partitions, table, write_by_part

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
ROUNDS = 2
PRIOR = 1000.0  # occurrences that the vocabulary's own scores count for
GATHER = 600_000  # distinct words that a task holds before it hands them on
BATCH = 4000
SPACE_MARK = chr(0x2581)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Vocabulary:
    """Pieces of a sentencepiece model: their ids, their places in the order of its scores, and those that stand for bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        rank = np.zeros(model.get_piece_size())
        for i in range(len(rank)):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[model.id_to_piece(i)] = i
            rank[i] = max(0.0, -model.get_score(i))
        #: By every beginning of a piece: the piece's id, or -1 where it is only a beginning.
        self.starts = {x[:n]: -1 for x in self.ids for n in range(1, len(x))} | self.ids
        weight = 1.0 / (rank + 10.0)
        used = np.zeros(len(rank), bool)
        used[list(self.ids.values()) + self.bytes] = True
        self.prior = np.where(used, weight, 0.0)
        self.prior /= self.prior.sum()
        self.end = len(rank)  # one more, for the end of a text


class Lattice:
    """The paths of a batch of words, as arcs by where they end."""

    def __init__(self, vocabulary: Vocabulary, batch: list[bytes]):
        known = vocabulary.starts.get
        self.extra: dict[str, int] = {}  # characters without a piece: paths of byte pieces, with ids after all others
        word, start, stop, piece = [], [], [], []
        lengths = []
        for k, w in enumerate(batch):
            s = SPACE_MARK + w.decode("utf-8", "replace")
            n = len(s)
            lengths.append(n)
            for i in range(n):
                before = len(piece)
                for j in range(i + 1, n + 1):
                    p = known(s[i:j])
                    if p is None:
                        p = -1
                        last = True
                    else:
                        last = False
                    if j == i + 1 and p < 0:
                        p = vocabulary.end + 1 + self.extra.setdefault(s[i], len(self.extra))
                    if p >= 0:
                        piece.append(p)
                        stop.append(j)
                    if last:
                        break
                arcs = len(piece) - before
                start += [i] * arcs
            word += [k] * (len(piece) - len(word))
        self.word, self.start, self.stop, self.piece = (np.array(x, np.int64) for x in (word, start, stop, piece))
        self.lengths = np.array(lengths, np.int64)
        self.by_stop = np.lexsort((self.word, self.stop))
        self.by_start = np.lexsort((self.word, self.start))
        self.vocabulary = vocabulary

    def costs(self, log_p: np.ndarray) -> np.ndarray:
        more = [sum(log_p[self.vocabulary.bytes[b]] for b in c.encode("utf-8", "surrogatepass")) for c in self.extra]
        return np.concatenate([log_p, np.array(more)]) if more else log_p

    def _sweep(self, order: np.ndarray, at: np.ndarray, other: np.ndarray, table: np.ndarray, cost: np.ndarray, up: bool) -> None:
        keys = at[order]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        spans = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True))
        for a, b in spans if up else reversed(spans):
            arcs = order[a:b]
            w = self.word[arcs]
            values = table[w, other[arcs]] + cost[arcs]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            table[w[first], keys[a]] = np.logaddexp.reduceat(values, first)

    def forward(self, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probability of every word, and the table and costs it comes from."""
        cost = self.costs(log_p)[self.piece]
        table = np.full((len(self.lengths), self.lengths.max() + 1), -np.inf)
        table[:, 0] = 0.0
        self._sweep(self.by_stop, self.stop, self.start, table, cost, True)
        return table[np.arange(len(self.lengths)), self.lengths], table, cost

    def expected(self, log_p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected occurrences of every piece in ``times`` of each word."""
        total, forward, cost = self.forward(log_p)
        back = np.full(forward.shape, -np.inf)
        back[np.arange(len(self.lengths)), self.lengths] = 0.0
        self._sweep(self.by_start, self.start, self.stop, back, cost, False)
        mass = np.exp(forward[self.word, self.start] + cost + back[self.word, self.stop] - total[self.word]) * times[self.word]
        sums = np.bincount(self.piece, mass, minlength=self.vocabulary.end + 1 + len(self.extra))
        for c, k in self.extra.items():
            for b in c.encode("utf-8", "surrogatepass"):
                sums[self.vocabulary.bytes[b]] += sums[self.vocabulary.end + 1 + k]
        return sums[: self.vocabulary.end + 1]


def _log(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p)


def gather_words(docs: DataFrame) -> DataFrame:
    """``part``, ``word``, ``times`` (in training documents): the distinct words of every partition of ``docs`` (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        train: Counter[bytes] = Counter()
        other: set[bytes] = set()

        def rows():
            rest = other.difference(train)
            names, times = [*train, *rest], [*train.values(), *[0] * len(rest)]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int32()), pa.array(names, pa.binary()), pa.array(times, pa.int64())], names=["part", "word", "times"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held_out(doc_id):
                    other.update(words(text))
                else:
                    train.update(words(text))
                if len(train) + len(other) > GATHER:
                    yield rows()
                    train.clear()
                    other.clear()
        yield rows()

    return docs.mapInArrow(run, "part int, word binary, times long")


def fit_pieces(counts: DataFrame, vocabulary: Vocabulary, n_docs: int, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of the pieces and of the end, from all ``counts`` (word, times). What comes to the driver in a round is one
    number a piece."""
    spark = counts.sparkSession
    ends = np.zeros(vocabulary.end + 1)
    ends[-1] = n_docs
    p = np.append(vocabulary.prior, 0.0) * (1 - 1e-3)
    p[-1] = 1e-3
    for _ in range(rounds):
        now = spark.sparkContext.broadcast((vocabulary, _log(p)))

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            own, log_p = now.value
            sums = np.zeros(own.end + 1)
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    part = batch.slice(at, BATCH)
                    sums += Lattice(own, part.column(0).to_pylist()).expected(log_p, part.column(1).to_numpy())
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["piece", "mass"])

        got = counts.filter("times > 0").select("word", "times").mapInArrow(run, "piece long, mass double").groupBy("piece").agg(F.sum("mass").alias("mass")).toPandas()
        sums = ends + PRIOR * np.append(vocabulary.prior, 0.0)
        sums[got["piece"].to_numpy()] += got["mass"].to_numpy()
        sums[-1] = max(sums[-1], 1.0)
        p = sums / sums.sum()
    return p


def score_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: its id, ``held_out``, ``n_tokens`` (words and the end), ``n_known`` (of them in training documents),
    ``train_tokens``, ``base_score`` (add-one word unigrams) and ``score`` (the lattice), both log10.

    Documents whose crc32(id) mod 7 is 2 are held out of all counts (a null id never is). A null or empty text is the end
    alone. ``docs`` is scanned twice and should be read from files: both scans then have the same partitions, and each
    finds the words of its own in one dictionary. A word that it lacks all the same is an error, not a guess.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    vocabulary = Vocabulary(path)
    n = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism * 2)
    found = gather_words(own).repartition(n, "word").groupBy("word").agg(F.sum("times").alias("times"), F.collect_set("part").alias("parts"))
    found = materialize(found, "words")
    n_docs = own.select(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).alias("fold")).filter(f"fold <> {HELD_OUT}").count()
    total, distinct = found.agg(F.sum("times"), F.count_if(F.col("times") > 0)).first()
    total, distinct = (total or 0) + n_docs, distinct + (n_docs > 0)
    p = fit_pieces(found, vocabulary, n_docs, rounds)
    model = spark.sparkContext.broadcast((vocabulary, _log(p)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, log_p = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                log10 = Lattice(own, part.column(0).to_pylist()).forward(log_p)[0] / math.log(10)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(log10)], names=["word", "times", "parts", "weight"])

    weighed = materialize(found.mapInArrow(weigh, "word binary, times long, parts array<int>, weight double"), "weighed")
    discard(found)
    folder = write_by_part(weighed, ["word", "times", "weight"], n)
    discard(weighed)
    below = math.log10(total + distinct + 1)
    end_base, end_score = math.log10(n_docs + 1) - below, float(_log(p)[-1] / math.log(10))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at: dict[bytes, int] = {}
        times, weights = [], []
        for batch in part_batches(folder, TaskContext.get().partitionId(), ["word", "times", "weight"]):
            at.update(zip(batch.column("word").to_pylist(), range(len(at), len(at) + batch.num_rows), strict=True))
            times.append(batch.column("times").to_numpy())
            weights.append(batch.column("weight").to_numpy())
        c = np.concatenate([*times, np.empty(0, np.int64)])
        base, weight, known = np.log10(c + 1.0) - below, np.concatenate([*weights, np.empty(0)]), c > 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i = np.fromiter(map(at.__getitem__, words(text)), np.int64)
                rows.append((doc_id, held_out(doc_id), len(i) + 1, int(known[i].sum()) + (n_docs > 0), total,
                             math.fsum(base[i].tolist()) + end_base, math.fsum(weight[i].tolist()) + end_score))
            if rows:
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return own.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
