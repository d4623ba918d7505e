"""Token ids in sorted-string-table files.

A shard holds documents by key. Records stand in blocks of about ``block_bytes``; inside a block a key shares a prefix
with the one before it and stores only the rest. After the blocks come a Bloom filter over all keys, a sparse index
(the last key, offset and length of every block) and a footer of fixed size, so that a lookup reads the footer, the
filter, the index and, after a binary search, the blocks whose keys include the one that is sought.

    shard  := block* bloom index footer
    block  := record*                     record := shared:u8 rest:u8 key[rest] n_ids:u32 ids:u16[n_ids]
    index  := (n:u8 last_key[n] offset:u64 length:u32 records:u32)*
    footer := bloom_at:u64 index_at:u64 n_records:u64 n_ids:u64 bloom_hashes:u32 width:u32 magic:8s
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.llm.byte_bpe import joined
from rankweave.llm.common import body, fresh_dir, materialize, table

END_ID = 1
VOCABULARY = "word_bpe_49k.json"
BLOCK_BYTES = 64 * 1024
SHARD_BYTES = 32 * 1024 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7  # bits a key; about 1 % of absent keys pass
CACHE_WORDS = 500_000
SLICE_BYTES = 8 << 20  # of text whose words are looked up at once; a longer text alone
MAGIC = b"RWSST001"
_PLAIN = chr(0x130)  # letters below it change neither number nor kind when they are lower-cased or normalised
_FOOTER = struct.Struct("<QQQQII8s")
#: White space as the tokenizer's normaliser has it; no token crosses it.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE = re.compile("[" + "".join(map(chr, _SPACES)) + "]+")
_ODD_SPACE = "[" + "".join(f"\\x{{{x:x}}}" for x in _SPACES if x not in (0x0A, 0x20)) + "]"  # any but a space and a line feed


def encode_key(key: int | None) -> bytes:
    """Bytes that sort as the ids do, null first."""
    return b"\0" if key is None else b"\1" + struct.pack(">Q", key + 2**63)


def decode_key(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - 2**63


def _bloom_bits(key: bytes, hashes: int, size: int) -> Iterator[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    for i in range(hashes):
        yield (a + i * b) % size


class ShardWriter:
    """Writes records in ascending key order to a file; keeps one block, the index and the key hashes in memory."""

    def __init__(self, out, width: int = 2, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.block, self.last, self.at, self.in_block = bytearray(), b"", 0, 0
        self.index, self.keys, self.n, self.ids = [], [], 0, 0

    def add(self, key: bytes, ids: bytes) -> None:
        if len(self.block) >= self.block_bytes:
            self._flush()
        shared = 0
        if self.in_block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += struct.pack("<BB", shared, len(key) - shared) + key[shared:] + struct.pack("<I", len(ids) // self.width)
        self.block += ids
        self.last = key
        self.keys.append(key)
        self.in_block += 1
        self.n += 1
        self.ids += len(ids) // self.width

    def _flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append((self.last, self.at, len(self.block), self.in_block))
            self.at += len(self.block)
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self._flush()
        size = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray((size + 7) // 8)
        for key in self.keys:
            for bit in _bloom_bits(key, BLOOM_HASHES, len(bloom) * 8):
                bloom[bit >> 3] |= 1 << (bit & 7)
        self.out.write(bytes(bloom))
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QII", *x) for k, *x in self.index)
        self.out.write(index)
        self.out.write(_FOOTER.pack(self.at, self.at + len(bloom), self.n, self.ids, BLOOM_HASHES, self.width, MAGIC))


class ShardReader:
    """Reads a shard from a file that can seek."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - _FOOTER.size)
        bloom_at, index_at, self.n, self.ids, self.hashes, self.width, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        file.seek(bloom_at)
        tail = file.read(size - _FOOTER.size - bloom_at)
        self.bloom, index = tail[: index_at - bloom_at], tail[index_at - bloom_at:]
        self.index, at = [], 0
        while at < len(index):
            n = index[at]
            self.index.append((index[at + 1: at + 1 + n], *struct.unpack_from("<QII", index, at + 1 + n)))
            at += 17 + n

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length, records = self.index[i]
        self.file.seek(offset)
        data, at, key = self.file.read(length), 0, b""
        for _ in range(records):
            shared, rest = data[at], data[at + 1]
            key = key[:shared] + data[at + 2: at + 2 + rest]
            at += 2 + rest
            n = struct.unpack_from("<I", data, at)[0] * self.width
            yield key, data[at + 4: at + 4 + n]
            at += 4 + n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, key: bytes) -> list[bytes]:
        """The ids of every record with this key, in the order of the file."""
        size = len(self.bloom) * 8
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key, self.hashes, size)):
            return []
        found, i = [], bisect_left(self.index, key, key=lambda x: x[0])
        while i < len(self.index):
            for k, ids in self._block(i):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
            i += 1
        return found


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def encoder(path: str, end_id: int | None = END_ID, cache_words: int = CACHE_WORDS):
    """A function from texts to their ids as little-endian 16-bit integers.

    No token of this vocabulary crosses white space, so words are encoded once and kept; a slice of texts is cut into words and
    put together from their ids in Arrow, so that only its distinct words pass through Python. The store has two generations
    of ``cache_words``: a full one becomes the old one, whose words move back when they are met again; what is in it
    changes no result. Plain letters, maybe with a full stop or comma behind them, go to the tokenizer's model directly.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    if own.get_vocab_size() > 1 << 16:
        raise ValueError("the ids do not fit 16 bits")
    young: dict[str, bytes] = {}
    old: dict[str, bytes] = {}
    end = b"" if end_id is None else struct.pack("<H", end_id)
    pieces, letters = own.model.tokenize, _byte_letters()

    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}H", *ids)

    marks = {"": b""} | {x: pack(own.encode(x, add_special_tokens=False).ids) for x in ".,"}

    def cut(texts: pa.Array) -> pa.Array:
        """The words of each text; some may be empty."""
        if pc.any(pc.match_substring_regex(texts, _ODD_SPACE)).as_py():
            return pa.array([_SPACE.split(x) for x in texts.to_pylist()], pa.list_(pa.string()))
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def learn(words: list[str]) -> None:
        others = []
        for w in words:
            if (ids := old.get(w)) is not None:
                young[w] = ids
                continue
            stem, mark = (w[:-1], w[-1:]) if w[-1:] in marks else (w, "")
            if not stem.isalpha() or max(stem) >= _PLAIN:
                others.append(w)
                continue
            stem = stem.lower()
            if (ids := young.get(stem) or old.get(stem)) is None:
                ids = pack([x.id for x in pieces(stem if stem.isascii() else stem.encode().decode("latin-1").translate(letters))])
            young[stem] = ids
            young[w] = ids + marks[mark]
        for w, e in zip(others, own.encode_batch_fast(others, add_special_tokens=False), strict=True):
            young[w] = pack(e.ids)

    def encode(texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        nonlocal young, old
        every = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        size = np.cumsum(pc.binary_length(every).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(every):
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + SLICE_BYTES, side="right")))
            lists = cut(every.slice(first, last - first))
            words = lists.flatten().dictionary_encode()
            distinct = words.dictionary.to_pylist()
            if len(young) > cache_words:
                young, old = {}, young
            learn([w for w in distinct if w not in young])
            each = pa.array(list(map(young.__getitem__, distinct)), pa.binary())
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for ids in joined(each.take(words.indices), ends):
                yield ids + end
            first = last

    return encode


def _open(path: str):
    fs, where = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return fs, where


MANIFEST = "part long, path string, bytes long, first_id long, last_id long, n_docs long, n_ids long"


def write_shards(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID,
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode ``docs`` and write them in ascending id order; returns the manifest, one row a shard.

    Ids are dealt to tasks by ranges of them. A task encodes its range and cuts it into shards of about ``shard_bytes``,
    each written under a name of its own attempt; only the names that successful attempts return come into the manifest,
    so that a task may fail and run again. Rows that share an id stand in the order of their texts; a null text has only
    the end id, a null id stands first; without rows there is no shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, int(total // shard_bytes) + 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, where = _open(folder)
        fs.create_dir(where, recursive=True)
        writer = None
        rows = []

        def close():
            writer.close()
            out.close()
            rows[-1][2] = fs.get_file_info(name).size
            rows[-1][5:] = [writer.n, writer.ids]

        encode = encoder(path, end_id)
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                if writer is not None and writer.at >= shard_bytes and key != rows[-1][4]:
                    close()
                    writer = None
                if writer is None:
                    name = f"{where}/{part:06d}-{len(rows):04d}-{uuid.uuid4().hex}.sst"
                    out = fs.open_output_stream(name)
                    writer = ShardWriter(out)
                    rows.append([(part << 32) + len(rows), f"{folder}/{name.rpartition('/')[2]}", 0, key, key, 0, 0])
                writer.add(encode_key(key), ids)
                rows[-1][4] = key
        if writer is not None:
            close()
        if rows:
            types = [pa.int64(), pa.string()] + [pa.int64()] * 5
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    ranged = rows.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return materialize(ranged.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and ``ids`` of every record in the shards of ``manifest``."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard of tens of MB
    shards = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    count = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, size, at in zip(*(batch.column(n).to_pylist() for n in ("path", "bytes", "start")), strict=True):
                fs, where = _open(path)
                rows, held = [], 0
                with fs.open_input_file(where) as file:
                    for key, ids in ShardReader(file, size):
                        n = len(ids) // 2
                        crc = zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                        rows.append((decode_key(key), at, n, crc, ids))
                        at += n
                        held += len(ids)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    dealt = shards.select("path", "bytes", "start").repartition(count, "path")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def lookup(manifest: DataFrame, doc_id: int) -> list[list[int]]:
    """The ids of every record of ``doc_id``: the shards whose range holds it, then their filter, index and block."""
    found = []
    for path, size in manifest.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part").select("path", "bytes").toLocalIterator():
        fs, where = _open(path)
        with fs.open_input_file(where) as file:
            found += [list(struct.unpack(f"<{len(x) // 2}H", x)) for x in ShardReader(file, size).get(encode_key(doc_id))]
    return found


def op10_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    manifest = write_shards(docs, fresh_dir(spark, "tokens"), public_tokenizers.path(VOCABULARY))
    return read_shards(manifest).drop("ids")
