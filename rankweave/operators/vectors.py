"""Dense vectors: the hashing encoder and exact search."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.config import RetrievalConfig
from rankweave.functions.text import IDENTIFIER, let
from rankweave.operators.lexical import KEEP, PAIRS, SCALE, Best, Known, parts, runs, top
from rankweave.storage import stored

#: A product with all vectors goes block by block over the queries.
BLOCK = 2000
#: Rows that a task encodes or compares at once, and hashes that are not as ``hashlib.new`` makes them.
ROWS, DIGESTS = 500, {"blake2b": functools.partial(hashlib.blake2b, digest_size=8)}
TEXT_FIELDS = ["symbol_name", "symbol_type", "parent_symbol", "function_name", "class_name", "docstring", "decorators", "comments", "imports", "file_path", "code"]


def snippet_text(snippets: DataFrame) -> Column:
    """The fields of a snippet that are not empty, a line each."""
    kinds = dict(snippets.dtypes)
    parts = [F.concat_ws(" ", n) if kinds[n].startswith("array") else F.col(n) for n in TEXT_FIELDS if n in kinds]
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def _cells(dimensions: int, digest: str):
    """A function from an identifier to where its tokens, their first and their last four characters count: the first four bytes of a
    feature's hash as a number give the cell, the fifth the sign; a negative one has a place behind all cells."""
    hashed = DIGESTS.get(digest) or functools.partial(hashlib.new, digest)

    def cell(feature: bytes) -> int:
        d = hashed(feature).digest()
        return int.from_bytes(d[:4], "little") % dimensions + (0 if d[4] & 1 else dimensions)

    short = functools.lru_cache(KEEP)(cell)  # the ends of tokens come again and again

    def made(item: bytes) -> list[int]:
        first, *others = parts(item)
        own = [cell(first), short(first[:4]), short(first[-4:])]
        return own + [c for t in others for c in (own if t == first else (cell(t), short(t[:4]), short(t[-4:])))]

    return made


def hash_encode(texts: DataFrame, id_col: str = "id", text_col: str = "text", dimensions: int = 384, digest: str = "blake2b") -> DataFrame:
    """(id, vector array<double>): signed counts of tokens, their first and their last four characters, at length 1.

    Hashes are Python's, and a text is counted where it is: nothing is shuffled. A task hashes an identifier once, as long as it remembers it.
    A text without tokens has the zero vector.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(_cells(dimensions, digest))
        for whole in batches:
            for batch in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                out = np.zeros((batch.num_rows, dimensions))
                for first, items, sizes in runs(batch.column(1).cast(pa.binary()).to_pylist(), re.compile(IDENTIFIER.encode()).findall):
                    if len(known.places) > KEEP:
                        known = Known(known.made)
                    cells, many = known.of(items)
                    rows = np.repeat(np.repeat(np.arange(len(sizes)), sizes), many)
                    n = np.bincount(rows * 2 * dimensions + cells, minlength=len(sizes) * 2 * dimensions).reshape(-1, 2, dimensions)
                    out[first:first + len(sizes)] = n[:, 0] - n[:, 1]
                for v in out:
                    v /= max(math.sqrt(np.dot(v, v)), 1e-12)
                ends = pa.array(np.arange(batch.num_rows + 1) * dimensions, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["id", "vector"])

    rows = texts.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """At length 1; a zero vector stays as it is."""
    return let(a, lambda v: let(F.greatest(norm(v), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n)))


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of ``width`` doubles, short ones with zeros behind, and their lengths; -1 for one that is null or holds a null."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype("q")
    flat = vectors.flatten()
    if not flat.null_count and (lengths == width).all():
        return flat.to_numpy(zero_copy_only=False).astype("d", copy=False).reshape(-1, width), lengths
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors.to_pylist()):
        if v is None or None in v:
            lengths[k] = -1
        elif len(v) <= width:
            out[k, :len(v)] = v
    return out, lengths


def _nearest(asked: pa.Table, n: int):
    """A function from batches (id, vector) to (query_id, id, score): of each query the rows whose rounded product can be among the ``n``
    best of all rows, and others. Matrix products find them; the score is the sum from the first product to the last, as ``dot`` has it."""
    ids, column = asked.column("query_id").combine_chunks(), asked.column("vector").combine_chunks()
    width = max(1, pc.max(pc.list_value_length(column)).as_py() or 0)
    q, sizes = _matrix(column, width)
    long = np.sqrt((q * q).sum(1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, n)
        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                m, lengths = _matrix(batch.column(1), width)
                null = (sizes[:, None] != lengths) | (lengths < 0)

                def exact(k: np.ndarray, r: np.ndarray, m=m, null=null) -> tuple[np.ndarray, np.ndarray]:
                    sums = [np.cumsum(m[r[i:i + PAIRS]] * q[k[i:i + PAIRS]], axis=1)[:, -1] + 0.0 for i in range(0, len(k), PAIRS)]
                    return np.concatenate([np.zeros(0), *sums]), null[k, r]

                with np.errstate(all="ignore"):
                    product = q @ m.T
                    # two scores are equal after rounding only if they are this near; a product of the matrices is off by less than the rest
                    slack = 1.5 * 10.0**-SCALE + width * 1e-15 * long * np.sqrt((m * m).sum(1).max(initial=0.0))
                    yield from best.add(product, null | ~np.isfinite(product), slack, batch.column(0), exact)
        yield from best.rest()

    return search


def dense_search(queries: DataFrame, vectors: DataFrame, n: int = RetrievalConfig().semantic_candidates) -> DataFrame:
    """The ``n`` vectors of the largest product with each query (query_id, vector), ties by id; zero and negative ones stay in.

    Queries are sent out in blocks of about BLOCK, so that what the driver and a task hold of them has a fixed bound, and the vectors stay where
    they are; a task gives up what cannot be among the best by its own rows. Products with a null are null and come last.
    """
    queries = stored(queries.select("query_id", "vector"), "asked")
    blocks = max(1, -(-queries.count() // BLOCK))
    kinds = [f"{c} {t.simpleString()}" for c, t in (("query_id", queries.schema["query_id"].dataType), ("id", vectors.schema["id"].dataType))]
    out = None
    for k in range(blocks):
        block = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        found = vectors.select("id", "vector").mapInArrow(_nearest(block.toArrow(), n), ", ".join([*kinds, "score double"]))
        best = top(found.withColumn("score", F.round("score", SCALE)), n)
        out = best if out is None else out.unionByName(best)
    return out
