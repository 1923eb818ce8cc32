"""Connected components of a graph of any shape, and joins that spread hot keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanforge.llm.common import cut_lineage


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """A join to a side whose keys are unique; the rows of one key are dealt over several tasks."""
    own = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", own).join(copies, [*keys, "_salt"], how).drop("_salt")


class Forest:
    """Union-find over any hashable nodes."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        up = self.up
        root = x
        while (parent := up.get(root, root)) != root:
            root = parent
        while (parent := up.get(x, x)) != root:
            up[x], x = root, parent
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def _spanning(batches):
    """Of a task's edges those of a spanning forest."""
    forest = Forest()
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        keep = np.fromiter((forest.union(x, y) for x, y in zip(a.tolist(), b.tolist())), dtype=bool, count=len(a))
        yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


#: So many edges one task holds; a contracted graph of this size needs no more rounds.
LAST_EDGES = 1 << 20


def _roots(batches):
    """Each node of a task's edges with the first node of its component."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.union(a, b)
    nodes = list(forest.up)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], names=["label", "_next"])


def components(edges: DataFrame, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, label) for each node of the edges (a, b); one label per component.

    Each round moves every node to the neighbour that comes first in an order drawn
    anew, and contracts; a constant share of the nodes goes each time, until a task
    can finish what is left.  The driver reads one number a round.
    """
    edges = cut_lineage(edges.select("a", "b").where("a <> b").mapInArrow(_spanning, "a long, b long"))
    labels = cut_lineage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    rounds = 0
    while left := edges.count():
        if left <= last_edges:
            ends = edges.coalesce(1).mapInArrow(_roots, "label long, _next long")
            return salted_join(labels, ends, ["label"], "left").select("node", F.coalesce("_next", "label").alias("label"))
        rounds += 1
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(rounds)), F.col(c).alias("node"))
        first = both.groupBy("a").agg(F.min(F.least(rank("a"), rank("b"))).alias("first"))
        first = cut_lineage(first.select(F.col("a").alias("label"), F.col("first.node").alias("_next")))
        labels = cut_lineage(salted_join(labels, first, ["label"], "left").select("node", F.coalesce("_next", "label").alias("label")))
        ends = edges
        for end in ("a", "b"):
            ends = salted_join(ends.withColumnRenamed(end, "label"), first, ["label"]).drop("label").withColumnRenamed("_next", end)
        edges = cut_lineage(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
                            .mapInArrow(_spanning, "a long, b long"))
    return labels
