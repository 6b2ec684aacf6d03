"""Connected components of a link table, by alternating large and small stars.

Every round attaches each node's larger neighbours to its smallest one (large
star), then its smaller neighbours and itself to the smallest (small star), until
the links are stars around the smallest node of each component. Links are dealt by
node and sorted, so a node's smallest neighbour comes first and the others stream
past it: one shuffle a star, and no node's links are gathered. They are written
between rounds; the driver sees two figures that tell whether a round changed
anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v) with u > v after a large or a small star."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, least, last = None, 0, None
        for batch in batches:
            u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
            if not len(u):
                continue
            new = np.concatenate([[u[0] != node], u[1:] != u[:-1]])
            first = np.flatnonzero(new)
            m = np.minimum(u[first], v[first])
            if not new[0]:
                first, m = np.concatenate([[0], first]), np.concatenate([[least], m])
            m = np.repeat(m, np.diff(np.concatenate([first, [len(u)]])))
            again = np.concatenate([[not new[0] and v[0] == last], ~new[1:] & (v[1:] == v[:-1])])
            keep = ~again & (v > u) if large else ~again & (v != m)
            x, y = v[keep], m[keep]
            if not large:  # and the node itself, once
                x, y = np.concatenate([x, u[new]]), np.concatenate([y, m[new]])
            node, least, last = u[-1], m[-1], v[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["u", "v"])

    return both.repartition("u").sortWithinPartitions("u", "v").mapInArrow(scan, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); ``component`` is the smallest node reachable."""
    edges = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        edges = materialize(_star(_star(edges, large=True), large=False).distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
