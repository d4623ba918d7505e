"""Byte-level BPE: encoding and decoding.

The distinct pieces (matches of the split pattern) of each scan partition are gathered, every distinct piece of the
corpus is encoded once, by a fold of Spark's higher-order functions over its bytes with a literal table of ranked
merges, and each partition gets the ids of its own pieces as one dictionary file, from which its documents are put
together. The text itself is never shuffled, and no dictionary is larger than what one partition holds.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.common import body, discard, give_back, materialize, part_batches, shuffle_partitions, table, write_by_part

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The fold looks at every pair of a piece for every merge; longer pieces go through a heap instead, with the same result.
FOLD_BYTES = 256
BUCKETS = 1 << 14  # some three tokens each
GATHER = 300_000  # distinct words that a task holds before it hands their pieces on
KEEP = 120_000  # distinct words whose ids a task keeps
SLICE_BYTES = 6 << 20  # of text that is cut at once; a longer text alone


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class RankTable:
    """The ranks of a vocabulary as a literal of a plan: maps from token to rank in an array, by hash.

    Spark looks through a map from end to end, so one map of all tokens would be read whole for every pair. Tokens
    stand in it with a character for each byte.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import xxhash

        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for token, rank in ranks.items():
            chars = token.decode("latin-1")
            buckets[xxhash.xxh64_intdigest(chars.encode(), 42) & BUCKETS - 1][chars] = rank  # as xxhash64() of Spark has it
        self.ranks = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")

    def rank(self, token: Column) -> Column:
        return F.element_at(F.get(self.ranks, F.xxhash64(token).bitwiseAND(BUCKETS - 1).cast("int")), token)

    def encode(self, piece: Column) -> Column:
        """Ids of a piece that is not empty: a fold over its bytes that makes the merge of the lowest rank, the leftmost
        of equals first, until no two neighbours make a token. Every byte has to be a token."""
        chars = F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")
        done = F.lit("")  # stands first once no merge is left

        def step(p: Column, _: Column) -> Column:
            ranks = F.transform(F.transform(p, lambda x, i: F.concat(x, F.get(p, i + 1))), self.rank)
            return F.when(F.get(p, F.lit(0)) == done, p).otherwise(let(ranks, lambda r: let(F.array_position(r, F.array_min(r)).cast("int"), lambda k: (
                F.when(k.isNull(), F.concat(F.array(done), p))
                .otherwise(F.concat(F.slice(p, F.lit(1), k - 1), F.array(F.concat(F.get(p, k - 1), F.get(p, k))), F.slice(p, k + 2, F.size(p))))))))

        merged = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length(chars))), F.split(chars, ""), step)
        return F.transform(F.filter(merged, lambda x: x != done), self.rank)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs, in n log n steps."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the token that starts here; 0 once it is part of another
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] >= n or end[end[i]] != stop:
            continue
        end[end[i]], end[i] = 0, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (b := before[i]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
            heapq.heappush(heap, (r, b, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


def _long(piece: str) -> bool:
    return len(piece) * 4 > FOLD_BYTES and len(piece.encode("utf-8", "surrogatepass")) > FOLD_BYTES


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_chunks = re.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+").findall
_runs = re.compile(rf"[{_WHITE}](?=[{_WHITE}])|[{_WHITE}]\Z").search

_LATIN = chr(0x250)  # which characters below it are letters no version of Unicode has changed


def chunks(text: str) -> list[str]:
    """Cuts a text where no match of the split pattern crosses: before a single space, around a single line break, or around
    runs of white space.

    A space before a chunk is left out: each chunk but the first stands for itself with a space before it. A chunk without
    one is preceded by NUL.
    """
    if not text:
        return []
    if "\0" not in text and not _runs(text):  # a space or line break stands between two others, or begins the text
        chunk = ("\0" + text).replace("\n", " \0\n \0").split(" ")
        return chunk if chunk[0] != "\0" else chunk[1:]
    return ["\0" + x for x in _chunks(text)]


def cut_batch(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts of a batch in one array, and where each text's begin (one more: where the last text's end).
    A text may have an empty chunk (NUL alone) in front."""
    if not texts.null_count and not any("\0" in x or _runs(x) for x in texts.to_pylist()):
        marked = pc.binary_join_element_wise("\0", texts, "")
        lists = pc.split_pattern(pc.replace_substring(marked, "\n", " \0\n \0"), " ")
    else:
        lists = pa.array([chunks(x or "") for x in texts.to_pylist()], pa.list_(pa.string()))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return lists.flatten(), ends


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about SLICE_BYTES of column ``at``."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        done = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, done + SLICE_BYTES, side="right")))
        yield batch.slice(first, last - first)
        first = last


def joined(parts: pa.Array, ends: np.ndarray) -> list[bytes]:
    """The binary values of ``parts`` from each of ``ends`` to the next, joined."""
    offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset: parts.offset + len(parts) + 1]
    data, cuts = parts.buffers()[2], offsets[ends].tolist()
    return [data[a:b].to_pybytes() for a, b in pairwise(cuts)] if data is not None else [b""] * (len(ends) - 1)


def decode_ids(ids: list[bytes], tokens: pa.Array) -> list[bytes]:
    """What each of ``ids`` (packed) stands for: its tokens' bytes, one after the other."""
    every = pa.array(np.frombuffer(b"".join(ids), "<u4"))
    return joined(tokens.take(every), np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64))


def whole(chunk: str) -> str:
    return chunk[1:] if chunk.startswith("\0") else " " + chunk


def cutter(pattern: str):
    """A function from chunks to their pieces, the matches of ``pattern``. For the pattern of the byte-level vocabularies a run
    of plain letters, maybe with a full stop or comma behind it, needs no matching."""
    import public_tokenizers

    find = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return lambda chunk: find(whole(chunk))

    def pieces(chunk: str) -> list[str]:
        word = whole(chunk)
        letters, mark = (chunk[:-1], chunk[-1]) if chunk[-1] in ".," else (chunk, "")
        if letters[:1] == "\0":
            letters = letters[1:]
        if letters.isalpha() and (letters.isascii() or max(letters) < _LATIN):
            return [word[:-1], mark] if mark else [word]
        return find(word)

    return pieces


def piece_dictionaries(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str) -> str:
    """Writes ``part=N/`` for each partition of ``docs``: its distinct pieces and their ids. Returns the folder."""
    spark = docs.sparkSession

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        scan, cut = TaskContext.get().partitionId(), cutter(pattern)
        held: set[str] = set()

        def rows():
            names = list({y for x in held for y in cut(x) if not _long(y)})
            return pa.RecordBatch.from_arrays([pa.array([scan] * len(names), pa.int32()), pa.array(names, pa.string())], names=["part", "piece"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(chunks(text))
                if len(held) > GATHER:
                    yield rows()
                    held.clear()
        yield rows()

    n = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism * 2)
    found = docs.select(body(text_col)).mapInArrow(gather, "part int, piece string")
    words = found.repartition(n, "piece").groupBy("piece").agg(F.collect_set("part").alias("parts"))
    encoded = materialize(words.select("parts", "piece", RankTable(ranks).encode(F.col("piece")).alias("ids")), "encoded")
    folder = write_by_part(encoded, ["piece", "ids"], n)
    discard(encoded)
    return folder


def _dictionary(folder: str, part: int) -> dict[str, bytes]:
    known: dict[str, bytes] = {}
    for batch in part_batches(folder, part, ["piece", "ids"]):
        ids = batch.column("ids")
        packed, ends = ids.values.to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
        known.update(zip(batch.column("piece").to_pylist(), (packed[a:b] for a, b in pairwise(ends)), strict=True))
    return known


def encode_bytes(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit integers) and ``decoded`` (binary: the bytes that the
    ids decode to); input columns of these names are replaced. Each match of ``pattern`` is encoded by itself, no
    special tokens; null and empty texts have no ids. ``path``: lines of base64 token and rank.

    ``docs`` is scanned twice and should be read from files, so that both scans have the same partitions; a piece that a
    partition's dictionary lacks all the same is merged in place, as are pieces of over ``FOLD_BYTES`` bytes.
    """
    ranks = read_ranks(path)
    folder = piece_dictionaries(docs, ranks, pattern, text_col)
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    keep_at, at = [docs.columns.index(f.name) for f in kept], docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([*kept, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        known, cut = _dictionary(folder, TaskContext.get().partitionId()), cutter(pattern)
        names = [b""] * (max(shared.value.values()) + 1)
        for token, rank in shared.value.items():
            names[rank] = token
        tokens = pa.array(names, pa.binary())

        class ByChunk(dict):
            def __missing__(self, x: str) -> bytes:
                ids = b"".join([known.get(y) or _pack(merge_long(y.encode("utf-8", "surrogatepass"), shared.value)) for y in cut(x)])
                if len(self) < KEEP:
                    self[x] = ids
                return ids

        ids_of = ByChunk().__getitem__
        for batch in batches:
            for part in slices(batch, at):
                words, ends = cut_batch(part.column(at))
                words = words.dictionary_encode()
                each = pa.array(list(map(ids_of, words.dictionary.to_pylist())), pa.binary())
                ids = joined(each.take(words.indices), ends)
                cols = [part.column(i) for i in keep_at] + [pa.array(ids, pa.binary()), pa.array(decode_ids(ids, tokens), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens`` and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    out = encode_bytes(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
