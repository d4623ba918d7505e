"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import discard, materialize

#: So many edges (16 bytes each) fit one task, which then finds the components in one pass instead of in rounds of joins.
ONE_TASK = 1_000_000


def _find_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges, which one task has; the root of a component is its smallest node."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for u, v in ends.reshape(2, -1).T.tolist():
        u, v = find(u), find(v)
        if u != v:
            parent[max(u, v)] = min(u, v)
    roots = nodes[[find(i) for i in range(len(nodes))]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``edges`` (materialised; whole numbers) to ``node``, ``root``: for every end of an edge the smallest node that it is connected with.

    Each round takes the least label among a node and its neighbours, then the label of that label; the rounds needed grow with
    the logarithm of a component's diameter. Labels of a round are written to the shared folder, never to the driver.
    """
    if edges.count() <= ONE_TASK:
        return materialize(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v").coalesce(1).mapInArrow(_find_all, "node long, root long"), "components")
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    pairs = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = pairs.join(labels, pairs.v == labels.node).groupBy("u").agg(F.min("root").alias("near"))
        stepped = labels.join(near, labels.node == near.u).select("node", "root", F.least("root", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("root").alias("above"))
        stepped = stepped.join(up, "next").select("node", F.least("next", "above").alias("root"), (F.least("next", "above") < F.col("root")).alias("moved"))
        stepped = materialize(stepped, "labels")
        moved = stepped.filter("moved").limit(1).count()
        discard(labels)
        labels = stepped
        if not moved:
            discard(pairs)
            return labels.select("node", "root")
