"""Removal of repeated substrings by distributed prefix doubling.

The rank of a position at length L stands for the L bytes that start there. Ranks are names: the name at 2L is mixed from the
names at L of a position and of the one L further on, so that names at 2, 4, ..., 32 bytes come from one sweep over a text, and
those at 20, 35 and 50 bytes from two overlapping names. Eight bytes, scrambled, are their own name, with which the sweep begins.
Positions are grouped by name at the growing lengths 20, 35, 50, and the ones whose name no other document has drop out.

Not every position takes part: of the 31 names of 20 bytes in a string of 50, the least marks an anchor, and equal
strings have equal anchors. One position in 15 is an anchor, and each stands for the strings of 50 bytes around it:

* 20 bytes: anchors whose name is in one document only are dropped. Each part of the texts hands on its distinct names, packed
  and dealt by name, and gets back those that another document has.
* 80 bytes: an anchor whose whole surroundings an earlier document has is settled: all its strings are repeats. Only the first
  document with such surroundings goes on.
* 35 bytes: of its strings, each holds the 15 bytes before the anchor or the 15 behind it; a half that no other document has drops out.
* 65 bytes: a half is settled where an earlier document has all of its strings in one piece.
* 50 bytes: what is left is compared string by string.

(A row for every byte and round, as the textbook has it, would write more than ten times the text.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.common import NULL_ID, body, bucketed, delete_dir, discard, id_key, join_hot, materialize, part_batches, shuffle_partitions, table, write_by_part

THRESHOLD = 50
GRAM, HALF = 20, 15
REACH = THRESHOLD - GRAM  # bytes around an anchor's gram, on either side
SEGMENT = 1 << 17  # bytes whose names are in memory at once; few enough for a processor's cache
GATHER = 1 << 20  # names that a task holds before it hands them on
PER_BUCKET = 400_000  # names that are compared at once, about
MARGIN = 128
_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(2**64 - 1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = b + _C
    x *= _C
    x ^= a * _A
    x ^= x >> np.uint64(32)
    x *= _A
    x ^= x >> np.uint64(29)
    return x


def _double(name: np.ndarray, step: int) -> np.ndarray:
    return _mix(name[:-step], name[step:]) if len(name) > step else name[:0]


def _eights(data: np.ndarray) -> np.ndarray:
    """Names at 8 bytes: the bytes, scrambled one to one, as the names that are mixed have to differ in all their bits."""
    if len(data) < 8:
        return np.empty(0, np.uint64)
    x = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).astype(np.uint64)
    x ^= x >> np.uint64(32)
    x *= _A
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def names(data: np.ndarray, upto: int = 32) -> dict[int, np.ndarray]:
    """Names of all positions at 16 and 32 bytes, by doubling."""
    out, name, size = {}, _eights(data), 8
    while size < upto:
        name, size = _double(name, size), 2 * size
        out[size] = name
    return out


def _slide(a: np.ndarray, width: int, f) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        a, size = f(a[:-size], a[size:]), 2 * size
    return f(a[:len(a) - (width - size)], a[width - size:]) if size < width else a


class Buffer:
    """Texts (or stretches of long ones) of a batch in one run of bytes. A stretch answers for its positions lo..hi-1."""

    def __init__(self, parts: list[tuple[int, int, int, int, int, bytes]]):
        self.row, self.offset, self.lo, self.hi, self.size = (np.array(x, np.int64) for x in list(zip(*parts, strict=True))[:5])
        lengths = np.array([len(p[5]) for p in parts], np.int64)
        self.start = np.cumsum(lengths) - lengths
        self.data = np.frombuffer(b"".join(p[5] for p in parts), np.uint8)
        self.lengths = lengths

    @classmethod
    def of(cls, texts: list[bytes]) -> Iterator[Buffer]:
        parts, held = [], 0
        for row, text in enumerate(texts):
            for at in range(0, max(1, len(text)), SEGMENT):
                lo, hi = at, min(len(text), at + SEGMENT)
                first = max(0, lo - MARGIN)
                piece = text[first: hi + MARGIN]
                parts.append((row, first, lo, hi, len(text), piece))
                held += len(piece)
                if held >= SEGMENT:
                    yield cls(parts)
                    parts, held = [], 0
        if parts:
            yield cls(parts)

    @cached_property
    def n16(self) -> np.ndarray:
        return names(self.data, 16)[16]

    def name(self, at: np.ndarray, size: int) -> np.ndarray:
        """Names of 32, 35 or 65 bytes at some places; of no meaning where a text has ended."""
        if size == 32:
            at = np.clip(at, 0, len(self.n16) - 17)
            return _mix(self.n16[at], self.n16[at + 16])
        if size == 35:
            return _mix(self.name(at, 32), self.name(at + 3, 32))
        return _mix(_mix(self.name(at, 32), self.name(at + 32, 32)), self.name(at + 33, 32))

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the data, stretches and names of the anchors."""
        width = REACH + 1
        gram = _double(self.n16, GRAM - 16)
        if len(self.data) < THRESHOLD:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
        whole = np.ones(len(self.data), bool)
        ends = self.start + self.lengths
        for left in range(1, GRAM):
            whole[np.maximum(ends - left, self.start)[self.lengths > 0]] = False
        whole = whole[: len(gram)]
        order = gram.astype(np.uint32)  # the lower half of a name; the upper one deals the names
        order[~whole] = np.iinfo(np.uint32).max
        if len(gram) >= width:
            least = _slide(order, width, np.minimum)
            none = np.zeros(width - 1, np.uint32)
            most = _slide(np.concatenate([none, least, none]), width, np.maximum)
            whole &= order == most
        at = np.flatnonzero(whole)
        stretch = np.searchsorted(self.start, at, side="right") - 1
        pos = at - self.start[stretch] + self.offset[stretch]
        own = (pos >= self.lo[stretch]) & (pos < self.hi[stretch])
        return at[own], stretch[own], gram[at[own]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, positions and names of the anchors."""
        at, stretch, gram = self.marks()
        return self.row[stretch], at - self.start[stretch] + self.offset[stretch], gram

    def room(self, pos: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes, up to REACH, a text has before and behind the grams at ``pos``."""
        return np.minimum(REACH, pos), np.minimum(REACH, self.size[stretch] - pos - GRAM)

    def places(self, rows: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the given (row, position) pairs those that this buffer answers for: their index, place in the data, stretch."""
        order = np.lexsort((self.lo, self.row))
        key = self.row[order] * (1 << 40) + self.lo[order]
        k = np.searchsorted(key, rows * (1 << 40) + pos, side="right") - 1
        ok = k >= 0
        stretch = order[np.maximum(k, 0)]
        ok &= (self.row[stretch] == rows) & (pos < self.hi[stretch])
        i = np.flatnonzero(ok)
        s = stretch[i]
        return i, self.start[s] + pos[i] - self.offset[s], *self.room(pos[i], s)


def _surroundings(buffer: Buffer, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of all that the strings around an anchor hold: up to REACH bytes before and behind it, and where a text ends."""
    out = np.empty(len(at), np.uint64)
    full = (left == REACH) & (right == REACH)
    a = at[full] - REACH
    out[full] = _mix(_mix(buffer.name(a, 32), buffer.name(a + 32, 32)), buffer.name(a + 2 * REACH + GRAM - 32, 32))
    data = buffer.data.tobytes() if not full.all() else b""
    for i in np.flatnonzero(~full).tolist():
        text = data[at[i] - left[i]: at[i] + GRAM + right[i]]
        out[i] = int.from_bytes(hashlib.blake2b(b"%d,%d," % (left[i], right[i]) + text, digest_size=8).digest(), "little")
    return out


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a column of lists."""
    lists = batch.column(column)
    return np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten()


def _bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _emit(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The values of ``data`` from each of ``bounds`` to the next as one binary value."""
    offsets = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _dealt(name: np.ndarray, buckets: int) -> np.ndarray:
    """Where the names (sorted) of each of ``buckets`` (a power of two) begin, by their upper bits; one more: where the last end."""
    edges = np.arange(1, buckets, dtype=np.uint64) << np.uint64(65 - buckets.bit_length())
    return np.concatenate([[0], np.searchsorted(name, edges), [len(name)]])


def _first_keys(name: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each of the names (sorted) the least of the keys that have it."""
    if not len(name):
        return keys
    first = np.concatenate([[True], name[1:] != name[:-1]])
    return np.minimum.reduceat(keys, np.flatnonzero(first))[np.cumsum(first) - 1]


def _among(some: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``some`` are in ``known`` (sorted)."""
    if not len(known):
        return np.zeros(len(some), bool)
    return known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of the batches, each with rows of one part."""
    for batch in _slices(batches):
        parts = batch.column("part").to_numpy()
        for part in np.unique(parts).tolist():
            yield part, batch if (parts == part).all() else batch.filter(pa.array(parts == part))


def _gather_names(buckets: int):
    """For mapInArrow: the distinct names of the anchors of each part, sorted and packed by bucket (their upper bits), and which
    of them are in several documents of the part. A part's names may come in several pieces."""
    def packed(part: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(gram)
        gram, keys = gram[order], keys[order]
        first = np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)]
        several = np.zeros(int(first.sum()), np.uint8)
        several[(np.cumsum(first) - 1)[1:][~first[1:] & (keys[1:] != keys[:-1])]] = 1
        gram = gram[first]
        bounds = _dealt(gram, buckets)
        columns = [pa.array(np.arange(buckets, dtype=np.int32)), pa.array(np.full(buckets, part, np.int32)), _binaries(gram, bounds), _binaries(several, bounds)]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "part", "names", "several"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last, n = None, 0
        for part, rows_of in _by_part(batches):
            if held and (part != last or n > GATHER):
                yield packed(last, held)
                held, n = [], 0
            last, keys = part, rows_of.column("k").to_numpy()
            for buffer in Buffer.of(_bytes(rows_of)):
                rows, _, gram = buffer.anchors()
                held.append((gram, keys[rows]))
                n += len(gram)
        if held:
            yield packed(last, held)

    return run


def _names_in_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the rows of ``_gather_names``, sorted by bucket, the names of each part that another document has."""
    def found(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        lists = [np.frombuffer(x, np.uint64) for _, x, _ in rows]
        every, several = np.concatenate(lists), np.concatenate([np.frombuffer(x, np.uint8) for _, _, x in rows])
        order = np.sort(every)
        known = np.unique(np.concatenate([order[1:][order[1:] == order[:-1]], every[several > 0]]))
        left = [x[_among(x, known)] for x in lists]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in left])])
        return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in rows], pa.int32()), _binaries(np.concatenate(left), bounds)], names=["part", "names"])

    held, last = [], None
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "names", "several")), strict=True):
            if held and bucket != last:
                yield found(held)
                held = []
            last = bucket
            held.append(row)
    if held:
        yield found(held)


def _name_surroundings(folder: str):
    """For mapInArrow: the anchors whose name ``folder`` has for their part, with the names of what is around them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, none = np.empty(0, np.uint64), None, np.uint64(0)
        for part, rows_of in _by_part(batches):
            if part != last:
                lists = [np.frombuffer(x, np.uint64) for b in part_batches(folder, part, ["names"]) for x in b.column("names").to_pylist()]
                known, last = np.unique(np.concatenate([np.empty(0, np.uint64), *lists])), part
            keys = rows_of.column("k").to_numpy()
            for buffer in Buffer.of(_bytes(rows_of)):
                at, stretch, h = buffer.marks()
                shared = _among(h, known)
                if not shared.any():
                    continue
                at, stretch, h = at[shared], stretch[shared], h[shared]
                pos = at - buffer.start[stretch] + buffer.offset[stretch]
                left, right = buffer.room(pos, stretch)
                around = _surroundings(buffer, at, left, right)
                before = np.where(left >= HALF, buffer.name(at - HALF, 35), none)
                behind = np.where(right >= HALF, buffer.name(at, 35), none)
                all_before = np.where((left == REACH) & (right >= HALF), buffer.name(at - REACH, 65), none)
                all_behind = np.where((left >= HALF) & (right == REACH), buffer.name(at - HALF, 65), none)
                yield _emit({"h": h, "k": keys[buffer.row[stretch]], "pos": pos.astype(np.int32), "cx": around, "before": before, "behind": behind, "all_before": all_before, "all_behind": all_behind})

    return run


def _name_strings(buckets: int):
    """For mapInArrow: the strings around anchors, sorted by name and packed by bucket. Those that an earlier document among the
    texts at hand has are known for repeats and come in a row by themselves, under a bucket below 0."""
    fields = ["names", "keys", "pos", "shifts"]

    def packed(bounds: np.ndarray, numbers: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *(_binaries(x, bounds) for x in columns)], names=["bucket", *fields])

    def told(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, keys, pos, shift = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(name)
        name, keys, pos, shift = (x[order] for x in (name, keys, pos, shift))
        again = keys > _first_keys(name, keys)
        yield packed(np.array([0, again.sum()]), np.array([-1 - TaskContext.get().partitionId()]), name[again], keys[again], pos[again], shift[again])
        name, keys, pos, shift = (x[~again] for x in (name, keys, pos, shift))
        yield packed(_dealt(name, buckets), np.arange(buckets), name, keys, pos, shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, shifts = [], 0, np.arange(REACH + 1)
        in_half = np.where(shifts >= HALF, 1, 0) | np.where(REACH - shifts >= HALF, 2, 0)
        for batch in _slices(batches):
            keys = batch.column("k").to_numpy()
            rows, members = _flat(batch, "at")
            pos, h, halves = members.field("pos").to_numpy().astype(np.int64), members.field("h").to_numpy(), members.field("halves").to_numpy()
            for buffer in Buffer.of(_bytes(batch)):
                i, at, left, right = buffer.places(rows, pos)
                # strings that start so many bytes before the anchor
                j, shift = np.nonzero((shifts <= left[:, None]) & (REACH - shifts <= right[:, None]) & ((in_half & halves[i][:, None]) > 0))
                if not len(j):
                    continue
                start, i = at[j] - shift, i[j]
                n50 = _mix(buffer.name(start, 32), buffer.name(start + THRESHOLD - 32, 32))
                held.append((_mix(n50, h[i].view(np.uint64)), keys[rows[i]], pos[i].astype(np.int32), shift.astype(np.uint8)))
                n += len(j)
                if n > GATHER:
                    yield from told(held)
                    held, n = [], 0
        if held:
            yield from told(held)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the rows of ``_name_strings``, sorted by bucket, the strings that an earlier document has, as masks of their anchors."""
    def masks(rows: list[tuple[bytes, ...]], known: bool) -> pa.RecordBatch:
        name, keys, pos, shift = (np.concatenate([np.frombuffer(x, t) for x in xs]) for xs, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int32, np.uint8), strict=True))
        if not known:
            order = np.argsort(name)
            name, keys, pos, shift = (x[order] for x in (name, keys, pos, shift))
            again = keys > _first_keys(name, keys)
            keys, pos, shift = keys[again], pos[again], shift[again]
        return _emit({"k": keys, "pos": pos, "mask": np.int64(1) << shift.astype(np.int64)})

    held, last = [], None
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "names", "keys", "pos", "shifts")), strict=True):
            if held and (bucket != last or bucket < 0):
                yield masks(held, last < 0)
                held = []
            last = bucket
            held.append(row)
    if held:
        yield masks(held, last < 0)


def _starts(pos: np.ndarray, mask: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits as runs of strings: which hit, and the first and last position at which a string of its starts (``last``: the
    greatest at which one can). Bit ``i`` of a mask stands for the string that starts ``i`` bytes before the anchor."""
    low = mask & -mask
    run = ((mask + low) & mask) == 0  # bits in one piece
    i = np.flatnonzero(run & (mask > 0))
    most, least = np.log2(mask[i] + low[i]).astype(np.int64) - 1, np.log2(low[i]).astype(np.int64)
    found = [(i, pos[i] - most, pos[i] - least)]
    several = np.flatnonzero(~run)
    for shift in range(REACH + 1):
        i = several[(mask[several] >> shift & 1) > 0]
        found.append((i, pos[i] - shift, pos[i] - shift))
    i, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    a, b = np.maximum(a, 0), np.minimum(b, last[i])
    return i[a <= b], a[a <= b], b[a <= b]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, 200):
        rows, members = _flat(batch, "hits")
        texts = _bytes(batch)
        size = np.array([len(x) for x in texts], np.int64)
        ends = np.cumsum(size)
        base, data = ends - size, np.frombuffer(b"".join(texts), np.uint8)
        i, a, b = _starts(members.field("pos").to_numpy().astype(np.int64), members.field("mask").to_numpy(), size[rows] - THRESHOLD)
        first = base[rows[i]]
        n = len(data) + 1
        gone = np.cumsum(np.bincount(first + a, minlength=n) - np.bincount(first + b + THRESHOLD, minlength=n))[:-1] > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[base[size > 0]] = gone[base[size > 0]]  # a run ends with its text
        so_far, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
        removed, spans = so_far[ends] - so_far[base], spans[ends] - spans[base]
        kept = _binaries(data[~gone], np.concatenate([[0], np.cumsum(size - removed)]))
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), kept],
                                         names=["key", "n_bytes", "n_removed", "n_spans", "kept"])


ALL = (1 << (REACH + 1)) - 1
RESULT = "key long, n_bytes long, n_removed long, n_spans long, kept binary"


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The names that several documents have: the first document, and how many rows."""
    found = rows.groupBy(*keys).agg(F.min("k").alias("f"), F.max("k").alias("l"), F.count("*").alias("n")).filter("f < l")
    return materialize(found.drop("l"), "shared")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key`` (the id; null: the least long), ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``
    (binary, as a cut may fall inside a character).

    Texts are UTF-8 bytes, a null one is empty. Every byte goes that is in a string of THRESHOLD bytes which also starts in a
    document with a smaller id, as the documents were given. Rows that share an id are one document in this: none is
    smaller than the other. Names have 64 bits and are compared in pairs of lengths. A step's tables are deleted once they are read.
    """
    spark = docs.sparkSession
    n = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    own = docs.select(id_key(id_col).alias("k"), body(text_col).alias("text")).withColumn("x", F.xxhash64("text"))
    rows = materialize(own.select("k", "x", F.hash("text").alias("y"), F.octet_length("text").cast("long").alias("size")), "rows")
    classes = rows.filter(F.col("size") >= THRESHOLD).groupBy("x", "y", "size").agg(F.min("k").alias("first"), F.count("*").alias("n"))
    classes = materialize(classes, "classes")
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    placed = materialize(join_hot(rows, classes, ["x", "y", "size"], "n", count).select("k", "x", "size", "first"), "placed")
    discard(rows, classes)
    copies = placed.filter("k > first").select(F.col("k").alias("key"), F.col("size").alias("n_bytes"), F.col("size").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    firsts = placed.filter("k = first").select("k", "x").distinct()
    part = F.expr(f"pmod(hash(k), {n})")
    texts = bucketed(own.join(firsts, ["k", "x"]).select("k", "text", part.alias("part")).repartition(n, "k"), n, ["k"], "texts")
    short = own.filter(F.octet_length("text") < THRESHOLD)
    short = short.select(F.col("k").alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))

    def with_texts(members: DataFrame) -> DataFrame:
        listed = members.groupBy("k").agg(F.collect_list("at").alias("at"))
        return texts.join(listed, "k").select("k", "text", "at")

    # 20 bytes
    buckets = 1 << max(n - 1, size // (REACH // 2 + 1) // PER_BUCKET).bit_length()
    packed = texts.select("k", "part", "text").mapInArrow(_gather_names(buckets), "bucket int, part int, names binary, several binary")
    shared = packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_names_in_several, "part int, names binary")
    folder = write_by_part(shared.select(F.array("part").alias("parts"), "names"), ["names"], n)

    # 80 bytes around
    columns = "h long, k long, pos int, cx long, before long, behind long, all_before long, all_behind long"
    around = materialize(texts.select("k", "part", "text").mapInArrow(_name_surroundings(folder), columns), "around")
    delete_dir(spark, folder)
    total = around.count()
    seen = materialize(around.groupBy("h", "cx").agg(F.min("k").alias("f"), F.count("*").alias("n")), "seen")
    names_left = [F.when(F.col("k") == F.col("f"), F.col(c)).alias(c) for c in ("h", "before", "behind", "all_before", "all_behind")]  # a settled anchor needs none
    split = join_hot(around, seen, ["h", "cx"], "n", total).select("k", "pos", (F.col("k") > F.col("f")).alias("settled"), *names_left)
    split = materialize(split, "split")
    discard(around, seen)
    hits = [materialize(split.filter("settled").select("k", "pos", F.lit(ALL).cast("long").alias("mask")), "hits")]

    # 35 bytes before and behind, and where those are shared the 65 that hold all strings with them
    halves = []
    for bit, half, shifts in ((1, "before", range(HALF, REACH + 1)), (2, "behind", range(HALF + 1))):
        several = split.filter(f"NOT settled AND {half} <> 0").select("h", half, "k", "pos", f"all_{half}")
        shared = _shared(several, ["h", half])
        several = materialize(join_hot(several, shared, ["h", half], "n", total).select("h", "k", "pos", f"all_{half}"), "half")
        discard(shared)
        whole = materialize(several.groupBy("h", f"all_{half}").agg(F.min("k").alias("f"), F.count("*").alias("n")), "whole")
        settled = (F.col(f"all_{half}") != 0) & (F.col("k") > F.col("f"))
        told = materialize(join_hot(several, whole, ["h", f"all_{half}"], "n", total).select("h", "k", "pos", settled.alias("settled")), "half")
        discard(several, whole)
        hits.append(materialize(told.filter("settled").select("k", "pos", F.lit(sum(1 << x for x in shifts)).cast("long").alias("mask")), "hits"))
        halves.append(materialize(told.filter("NOT settled").select("h", "k", "pos", F.lit(bit).alias("bit")), "half"))
        discard(told)
    discard(split)
    both = halves[0].unionByName(halves[1]).groupBy("h", "k", "pos").agg(F.bit_or("bit").alias("halves"))

    # 50 bytes
    members = materialize(both.select("k", F.struct("pos", "h", "halves").alias("at")), "halves")
    discard(*halves)
    buckets = 1 << max(n - 1, members.count() * (REACH + 1) // PER_BUCKET).bit_length()
    strings = with_texts(members).mapInArrow(_name_strings(buckets), "bucket int, names binary, keys binary, pos binary, shifts binary")
    again = strings.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "k long, pos int, mask long")
    again = again.groupBy("k", "pos").agg(F.bit_or("mask").alias("mask"))
    again = materialize(again, "again")
    discard(members)
    of_text = materialize(reduce(DataFrame.unionByName, hits, again).groupBy("k").agg(F.collect_list(F.struct("pos", "mask")).alias("hits")), "hits")
    discard(again, *hits)

    listed = F.coalesce("hits", F.array().cast("array<struct<pos:int,mask:long>>"))
    cut = texts.join(of_text, "k", "left").select("k", "text", listed.alias("hits")).mapInArrow(_cut, RESULT)
    return cut.unionByName(copies).unionByName(short)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.when(F.col("key") != NULL_ID, F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
