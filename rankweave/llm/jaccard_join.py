"""N-gram Jaccard join by set relations.

Equal sets are one set from the start. Sets that can link at all share a signature (see ``signatures``) and have sketches that
permit it (see ``sketch``), which gathers them in small groups; a group is joined in memory with index lists of prefix tokens. A list keeps its entries in blocks by what
they are known to be connected with, ascending in size, with the token's position, so that whole blocks are skipped: those
of the component that the set is in already, those too short, those whose position leaves too little. Each set remembers the
set through which it was linked and their overlap; from these and the new set's overlap with that set follow bounds for the new
set's own answer, which is counted only where the bounds leave it open.
"""

from __future__ import annotations

import hashlib
import math
import struct
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.common import NULL_ID, body, bucketed, discard, id_key, join_hot, materialize, scratch, shuffle_partitions, table
from rankweave.llm.components import components

SHINGLE = 4
PERCENT = 85
GROUP_SETS, GROUP_CHARS = 2000, 16_000_000  # a task joins no more sets and no more text than this at once (twice it, across blocks)
GATHER = 1_000_000  # signatures that a task deals out at once
BUCKETS = 8  # of signatures, for each task that reads them
SLACK = 4  # one part in so many is more than are needed
SKETCH_BITS = 1 << 16  # at most
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words; remembers as many as ``keep``."""

    def __init__(self, keep: int):
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.keep:
            self[word] = value
        return value


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, n: int = SHINGLE, keep: int = 500_000):
        self.n, self.hash = n, _Hashes(keep).__getitem__

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the white space of ASCII
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hash, words), np.uint64, len(words))
        n = min(self.n, len(h))
        mixed = np.full(len(h) - n + 1, n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):  # order counts: every step multiplies and turns what came before
                mixed = (mixed ^ h[i:len(h) - n + 1 + i]) * _MIX
                mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def set_id(shingles: np.ndarray) -> int:
    return struct.unpack("<q", hashlib.blake2b(shingles.tobytes(), digest_size=8).digest())[0]


def need(x: int, y: int, percent: int) -> int:
    """Least overlap of linked sets of sizes x and y: 100 * overlap >= percent * union."""
    return -(-percent * (x + y) // (100 + percent))


def _most(x: int, y: int, percent: int) -> int:
    """In how many shingles linked sets of sizes x and y differ at most."""
    return (x + y) * (100 - percent) // (100 + percent)


@lru_cache(100_000)
def _dealing(n: int, percent: int) -> list[tuple[int, int, int]]:
    """How sets of ``n`` shingles are dealt out: the class of sizes (from 2 ** class on), into how many parts, and how many of these
    count. Once for the set's own class; once for the class before it, if a set in that can link with it."""
    own, out = n.bit_length() - 1, []
    for c, partner in ((own, n * 100 // percent), (own - 1, (1 << own) - 1)):
        if c == own or 100 * partner >= percent * n:
            top = (2 << c) - 1
            most = _most(top, top * 100 // percent, percent)
            out.append((c, most + 1 + -(-most // SLACK), _most(n, partner, percent) + 1))
    return out


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of which two different linked sets have at least one in common.

    Linked sets differ in at most d shingles, so if the shingles are dealt by hash into parts, all but d of the parts that are not
    empty are equal in both. Ordered by anything that follows from a part alone, the first part that is equal in both is
    therefore among the first d + 1 of either set. The order is by size: parts of several shingles are seldom equal by chance, as
    those of one shingle of a line that many texts have. The number of parts depends on the class of sizes; of a pair the
    smaller set is in its own class, the larger in the same or the next, and deals itself out for the one before as well.

    Of two sets with no more than d parts that are not empty (rare, as there are a quarter more parts than d + 1 even for the
    largest of a class), both emit the least shingles of which linked sets share one.
    """
    n, out, sparse = len(shingles), [], False
    if not n:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = shingles * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        for c, parts, count in _dealing(n, percent):
            part = ((shingles >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))  # the shingles are sorted, so the parts are
            sums = np.add.reduceat(mixed, first)
            sig = (sums ^ part[first].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) ^ np.uint64((c + 1) << 40)) * _MIX
            sig ^= sig >> np.uint64(32)
            sparse |= len(first) < count
            if len(first) > count:
                sig = sig[np.lexsort((sig, -np.diff(first, append=n)))[:count]]
            out.append(sig)
        if sparse:  # the least common shingle is at most n - overlap places from the start of both
            least = mixed[: n - -(-percent * n // 100) + 1] * _MIX
            out.append(least ^ (least >> np.uint64(32)))
    return np.concatenate(out).view(np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """A bit for each of 64 to SKETCH_BITS hash values, over n of them where possible: whether an odd number of shingles has it.
    Every shingle in which two sets differ turns one bit, so two sketches differ in no more bits than the sets in shingles.
    That holds when the upper half of a sketch is folded onto the lower as well."""
    if not len(shingles):
        return b""
    bits = max(64, min(SKETCH_BITS, 1 << len(shingles).bit_length()))
    with np.errstate(over="ignore"):
        at = (shingles * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64) & bits - 1
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").tobytes()


def _spanning(sizes: np.ndarray, sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Edges that connect every two sets which may link by their sizes and sketches. Each set is compared with those that
    are not reached yet."""
    if len(sizes) == 2:
        (n, a), (m, b) = sorted(zip(sizes.tolist(), sketches, strict=True))
        if 100 * n < percent * m:
            return []
        x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(b) * 8
        while bits > len(a) * 8:
            bits //= 2
            y = y >> bits ^ y & (1 << bits) - 1
        return [(0, 1)] if (x ^ y).bit_count() <= _most(n, m, percent) else []
    order = np.argsort(sizes, kind="stable")
    size, left, edges = sizes[order], np.ones(len(sizes), bool), []
    words = np.array([len(x) // 8 for x in sketches])[order]  # ascending, as the sizes are
    starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])).tolist()
    tables = [(a, b, np.frombuffer(b"".join(sketches[i] for i in order[a:b]), np.uint64).reshape(b - a, -1)) for a, b in zip(starts, [*starts[1:], len(size)], strict=True)]

    def folded(table: np.ndarray, width: int) -> np.ndarray:
        while table.shape[1] > width:
            half = table.shape[1] // 2
            table = table[:, :half] ^ table[:, half:]
        return table

    for seed in range(len(size)):
        if not left[seed]:
            continue
        left[seed], queue = False, [seed]
        while queue:
            x = queue.pop()
            n = int(size[x])
            lo, hi = np.searchsorted(size, [-(-percent * n // 100), n * 100 // percent + 1]).tolist()
            mine = next(t[x - a:x - a + 1] for a, b, t in tables if a <= x < b)
            for a, b, t in tables:
                to = np.flatnonzero(left[max(a, lo):min(b, hi)]) + max(a, lo)
                if len(to):
                    width = min(t.shape[1], mine.shape[1])
                    differ = np.bitwise_count(folded(t[to - a], width) ^ folded(mine, width)).sum(1, dtype=np.int64)
                    to = to[differ <= (n + size[to]) * (100 - percent) // (100 + percent)]
                    left[to] = False
                    queue += to.tolist()
                    edges += [(int(order[x]), y) for y in order[to].tolist()]
    return edges


class GroupJoin:
    """Components of the sets of a group. ``same[i]``: what set i is known to be connected with; with ``sides`` only sets of
    different sides are compared. ``links`` gets an edge for every two components that a link joins."""

    def __init__(self, sets: list[np.ndarray], percent: int, same: list | None = None, sides: list[int] | None = None):
        self.sets, self.percent, self.sides = sets, percent, sides
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []
        self.through: list[tuple[int, int] | None] = [None] * len(sets)
        self.counted = self.derived = 0
        first: dict = {}
        for i, c in enumerate(same or ()):
            self.parent[i] = first.setdefault(c, i)
        self._run()

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def _overlap(self, x: int, y: int) -> int:
        self.counted += 1
        return len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))

    def _run(self):
        sets, percent = self.sets, self.percent
        size = [len(s) for s in sets]
        if not sets:
            return
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        lists: dict[int, dict[int, list[tuple[int, int, int]]]] = {}  # token -> component -> (size, position, set)
        for x in sorted(range(len(sets)), key=lambda i: (size[i], i)):
            n = size[x]
            if not n:
                continue
            at = np.searchsorted(values, sets[x])
            order = np.lexsort((at, counts[at]))  # rare tokens first
            prefix = at[order[: n - -(-percent * n // 100) + 1]]
            least = -(-percent * n // 100)
            prefix = [(i, t) for i, t in enumerate(prefix.tolist()) if counts[t] > 1]
            done: dict[int, int] = {}  # sets compared with x, and the overlap
            for i, t in prefix:
                for root in list(blocks := lists.get(t, {})):
                    top = self.find(root)
                    if top != root:
                        moved = blocks.pop(root)
                        into = blocks.setdefault(top, [])
                        into.extend(moved)
                        into.sort()
                for root, block in blocks.items():
                    if self.find(x) == self.find(root) or block[-1][0] < least:
                        continue
                    for k in range(bisect_left(block, (least,)), len(block)):
                        m, j, y = block[k]
                        if y in done or self.sides and self.sides[x] == self.sides[y]:
                            continue
                        must = need(n, m, percent)
                        if 1 + min(n - i - 1, m - j - 1) < must:
                            continue
                        linked = self._derive(x, y, must, done)
                        if linked is None:
                            done[y] = self._overlap(x, y)
                            linked = done[y] >= must
                        if linked:
                            if self.through[x] is None and y in done:
                                self.through[x] = (y, done[y])
                            self.links.append((x, y))
                            a, b = sorted((self.find(x), self.find(y)))
                            self.parent[b] = a
                            break
            top = self.find(x)
            for i, t in prefix:
                block = lists.setdefault(t, {}).setdefault(top, [])
                block.append((n, i, x))

    def _derive(self, x: int, y: int, must: int, done: dict[int, int]) -> bool | None:
        """Whether x and y link, as far as the set that y was linked through tells."""
        if self.through[y] is None or (z := self.through[y][0]) not in done:
            return None
        with_z, shared = done[z], self.through[y][1]
        if with_z + len(self.sets[y]) - shared < must:  # y's shingles outside z, all of them in x
            self.derived += 1
            return False
        if with_z + shared - len(self.sets[z]) >= must:  # what x and y must share inside z
            self.derived += 1
            return True
        return None


def _group_links(key, members: pa.Table, percent: int, n: int) -> pa.Table:
    rows = members.to_pydict()
    shingle, seen, sets, ids, same, sides = Shingler(n), set(), [], [], [], []
    for sid, comp, side, text in zip(rows["sid"], rows["comp"], rows["side"], rows["text"], strict=True):
        if (sid, side) not in seen:
            seen.add((sid, side))
            sets.append(shingle(text))
            ids.append(sid)
            same.append(comp)
            sides.append(side)
    join = GroupJoin(sets, percent, same, sides if max(sides) >= 0 else None)
    if max(sides) >= 0:
        pairs = [(ids[x], ids[y]) for x, y in join.links]
    else:  # the components themselves: every set with the one of the least id
        least: dict[int, int] = {}
        for i, sid in enumerate(ids):
            root = join.find(i)
            least[root] = min(sid, least.get(root, sid))
        pairs = [(sid, least[join.find(i)]) for i, sid in enumerate(ids)]
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def _links(tasks: DataFrame, keys: list[str], percent: int, n: int) -> DataFrame:
    def run(key, members):
        return _group_links(key, members, percent, n)

    parts = max(shuffle_partitions(tasks.sparkSession), tasks.sparkSession.sparkContext.defaultParallelism * 4)
    return materialize(tasks.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, "a long, b long"), "links")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (sid and others) with ``comp``."""
    roots = components(links).select(F.col("node").alias("sid"), F.col("root").alias("comp0"))
    return nodes.join(roots, "sid", "left").withColumn("comp", F.coalesce("comp0", "sid")).drop("comp0")


def _described(own: DataFrame, n: int) -> DataFrame:
    """``key``, ``hash``, ``n_shingles``, ``sid`` (of the set), ``size`` (of the text) and ``sketch`` of every row."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [shingle(x) for x in texts]
            made = [pa.array(map(len, sets), pa.int64()), pa.array(map(set_id, sets), pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(map(sketch, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], names=["key", "hash", "n_shingles", "sid", "size", "sketch"])

    return own.mapInArrow(describe, "key long, hash long, n_shingles long, sid long, size long, sketch binary")


def _shared(texts: DataFrame, percent: int, n: int) -> DataFrame:
    """``sig``, ``sid``: the signatures that several sets have. They are moved as packed numbers, 16 bytes a signature and set."""
    parts = max(shuffle_partitions(texts.sparkSession), texts.sparkSession.sparkContext.defaultParallelism)
    buckets = BUCKETS * parts

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sigs, sids, held = Shingler(n), [], [], 0

        def dealt() -> pa.RecordBatch:
            sig = np.concatenate(sigs)
            sid = np.repeat(np.array(sids, np.int64), [len(x) for x in sigs])
            bucket = (sig.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            offsets = pa.py_buffer(np.append(first, len(sig)).astype(np.int32) * np.int32(8))
            packed = [pa.Array.from_buffers(pa.binary(), len(found), [None, offsets, pa.py_buffer(x[order])]) for x in (sig, sid)]
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *packed], names=["bucket", "sigs", "sids"])

        for batch in batches:
            for sid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sigs.append(signatures(shingle(text), percent))
                sids.append(sid)
                held += len(sigs[-1])
                if held > GATHER:
                    yield dealt()
                    sigs, sids, held = [], [], 0
        if held:
            yield dealt()

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, sids = [], []
        for batch in batches:
            sigs += batch.column(1).to_pylist()
            sids += batch.column(2).to_pylist()
        sig, sid = (np.frombuffer(b"".join(x), np.int64) for x in (sigs, sids))
        order = np.argsort(sig)
        sig = sig[order]
        same = sig[1:] == sig[:-1]
        several = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(sig) else order
        for at in range(0, len(several), 100_000):
            i = several[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(sig[i]), pa.array(sid[order[i]])], names=["sig", "sid"])

    signed = texts.select("sid", "text").mapInArrow(sign, "bucket int, sigs binary, sids binary")
    return materialize(signed.repartition(parts, "bucket").mapInArrow(share, "sig long, sid long"), "shared")


def _candidates(texts: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """``a``, ``b``: edges that connect all sets that share a signature and may link by their sketches."""
    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sids, sizes, sketches = None, [], [], []

        def edges() -> list[tuple[int, int]]:
            return [(sids[i], sids[j]) for i, j in _spanning(np.array(sizes, np.int64), sketches, percent)] if len(sids) > 1 else []

        for batch in batches:
            found = set()
            for sig, sid, size, bits in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if sig != last:
                    found.update(edges())
                    last, sids, sizes, sketches = sig, [], [], []
                sids.append(sid)
                sizes.append(size)
                sketches.append(bits)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        rest = edges()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rest], pa.int64()), pa.array([y for _, y in rest], pa.int64())], names=["a", "b"])

    shared = _shared(texts, percent, n)
    parts = max(shuffle_partitions(texts.sparkSession), texts.sparkSession.sparkContext.defaultParallelism)
    listed = shared.join(sets.select("sid", "n_shingles", "sketch"), "sid").select("sig", "sid", "n_shingles", "sketch")
    pairs = listed.repartition(parts, "sig").sortWithinPartitions("sig").mapInArrow(connect, "a long, b long")
    edges = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "candidates")
    discard(shared)
    return edges


def _dealt(sets: DataFrame, groups: DataFrame, group_sets: int, group_chars: int) -> DataFrame:
    """The members of the groups with ``blk``, their block, and ``nb``, the number of blocks of the group."""
    members = materialize(sets.join(groups, "sid").select("sid", "key", "hash", "size", "gid"), "members")
    sizes = members.groupBy("gid").agg(F.count("*").alias("m"), F.sum("size").alias("w"))
    blocks = F.greatest(F.ceil(F.col("m") / group_sets), F.ceil(F.col("w") / group_chars)).cast("int")
    sizes = sizes.select("gid", blocks.alias("nb"))
    return members.drop("size").join(sizes, "gid").withColumn("blk", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, n: int = SHINGLE,
                    group_sets: int = GROUP_SETS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """One row per row of ``docs``: ``key`` (the id, a whole number; null: the least long), ``hash`` (xxhash64 of the text),
    ``n_shingles`` and ``component`` (the least key that is reachable by links, its own included).

    A-Z are lower-cased; a set holds the distinct runs of ``n`` words, or all words where there are fewer, as 64-bit hashes.
    Sets link when 100 * overlap >= percent * union. Null and empty texts and those of white space have empty sets and
    are linked with nothing: each is the component of its own id. Rows that share an id and differ in text are sets of their own.

    No step puts more than ``group_sets`` sets or ``group_chars`` of text (a longer text alone) into a task: larger groups are
    joined in blocks, then the first block with every other; then those that are not yet in the group's largest component
    with every block. Pairs that are left out are of one component already, so the components are exact.
    """
    spark = docs.sparkSession
    own = docs.select(id_key(id_col).alias("key"), body(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    with scratch(spark) as keep:
        rows = materialize(_described(own, n), "sets")
        total = rows.count()
        sets = rows.filter("n_shingles > 0").groupBy("sid").agg(F.min(F.struct("key", "hash", "size", "n_shingles", "sketch")).alias("rep"), F.count("*").alias("copies"))
        sets = materialize(sets.select("sid", "rep.*", "copies"), "distinct")
        texts = own.join(sets.select("sid", "key", "hash"), ["key", "hash"]).select("key", "hash", "sid", "text")
        texts = bucketed(texts, shuffle_partitions(spark), ["key", "hash"], "sets")

        edges = _candidates(texts, sets, percent, n)
        groups = components(edges).select(F.col("node").alias("sid"), F.col("root").alias("gid"))
        blocks = materialize(_dealt(sets, groups, group_sets, group_chars), "blocks")
        labels = _class_labels(texts, blocks, percent, n, group_sets)

        least = sets.join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        least = least.groupBy("comp").agg(F.min("key").alias("component")).join(least.select("sid", "comp", "copies"), "comp")
        least = materialize(least.select("sid", "component", "copies"), "classes")
        keep += [rows, least]
    named = join_hot(rows.filter("n_shingles > 0"), least, ["sid"], "copies", total)
    alone = rows.filter("n_shingles = 0").withColumn("component", F.col("key"))
    return named.select("key", "hash", "n_shingles", "component").unionByName(alone.select("key", "hash", "n_shingles", "component"))


def _class_labels(texts: DataFrame, blocks: DataFrame, percent: int, n: int, group_sets: int) -> DataFrame:
    """``sid``, ``comp``: the component of every set in ``blocks``."""
    tasks = texts.select("key", "hash", "text").join(blocks, ["key", "hash"])
    tasks = tasks.select("gid", "blk", "sid", F.col("sid").alias("comp"), F.lit(-1).alias("side"), "text")
    links = _links(tasks, ["gid", "blk"], percent, n)
    big = blocks.filter("nb > 1")
    if big.limit(1).count():
        inside = links.join(big.select(F.col("sid").alias("a")), "a", "left_semi")
        across = components(_across(texts, big, materialize(inside, "links"), percent, n, group_sets))
        links = links.join(across, links.a == across.node, "left").select("a", F.coalesce("root", "b").alias("b"))
    return links.select(F.col("a").alias("sid"), F.col("b").alias("comp"))


def _across(texts: DataFrame, big: DataFrame, links: DataFrame, percent: int, n: int, group_sets: int) -> DataFrame:
    """Links between the blocks of the groups that have several."""
    cols = ["gid", "task", "sid", "comp", "side", "text"]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
        return _links(texts.select("key", "hash", "text").join(both, ["key", "hash"]).select(*cols), ["gid", "task"], percent, n)

    now = materialize(_labelled(big, links), "labelled")
    first = now.filter("blk = 0").withColumn("task", F.explode(F.sequence(F.lit(1), F.col("nb") - 1)))
    rest = now.filter("blk > 0").withColumn("task", F.col("blk"))
    keep = ["gid", "task", "sid", "key", "hash", "comp"]
    links = materialize(links.unionByName(joined(first.select(*keep), rest.select(*keep))), "links")

    now = materialize(_labelled(big, links), "labelled")
    most = now.groupBy("gid", "comp").count().groupBy("gid").agg(F.max_by("comp", F.struct("count", "comp")).alias("most"))
    left = now.join(most, "gid").filter("comp <> most")
    parts = left.groupBy("gid").agg(F.ceil(F.count("*") / group_sets).cast("int").alias("lb"))
    left = left.join(parts, "gid").withColumn("lblk", F.pmod(F.xxhash64("sid"), F.col("lb")).cast("int"))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    every = now.join(parts, "gid").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lb") - 1)))
    left = left.select("gid", (F.col("lblk").cast("long") * F.col("nb") + F.col("j")).alias("task"), "sid", "key", "hash", "comp")
    every = every.select("gid", (F.col("i").cast("long") * F.col("nb") + F.col("blk")).alias("task"), "sid", "key", "hash", "comp")
    return materialize(links.unionByName(joined(left, every)), "links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component; rows without words all stay. Of rows that are equal in
    id and text one stays."""
    classes = jaccard_classes(docs, id_col, text_col, percent, n)
    stay = classes.filter("key = component").select(F.col("key").alias("__k"), F.col("hash").alias("__x")).distinct()
    rows = docs.withColumn("__k", id_key(id_col)).withColumn("__x", F.xxhash64(body(text_col)))
    return rows.join(stay, ["__k", "__x"], "left_semi").drop("__k", "__x")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_classes(table(spark, sf_dir, "documents"))
    return out.select(F.when(F.col("key") != NULL_ID, F.col("key")).alias("doc_id"), "n_shingles",
                      F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"))
