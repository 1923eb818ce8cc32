"""N-gram Jaccard self-join over count vectors, with an R-tree.

A document is the set of its distinct word shingles.  Shingles are hashed into groups;
the counts per group are a point, and for two points the sum of the coordinate minima
bounds the overlap of the sets from above.  An R-tree holds the points with the
coordinate maxima of each node, and a search descends only into nodes whose bound
reaches the overlap that the similarity asks for.  Pairs that survive are verified on
the sets themselves.

A tree over all documents would not prune: the counts of unrelated documents of one
length are alike, and every node overlaps every query.  So the points are first parted
without loss:

1. A frequency sketch of a fixed size counts all shingles of all texts.  It orders the
   shingles: rare ones first, then by hash.  Two sets that are similar enough share one
   of the first floor((1 - t) n) + 1 in this order.
2. A rare shingle is shared by no more documents than the sketch's limit; an R-tree over
   each such list ties the members that the bound allows.  Documents that share a
   frequent one are tied in a star.  The components of both are the parts.
3. In each part the members are compared with a pivot, the member whose shingles are the
   most common: near copies of one text are tied by it in linear work.
4. Members that the pivot does not tie are searched in R-trees over tiles of the part of a
   bounded size, a task for each pair of tiles with such members.
5. The verified links give the components.

Equal sets are one point.  No step draws, caps or drops rows; all work is in bounded
pieces.

Defined cases: null and empty texts have no shingles and no links; null ids sort last
among a component's ids; repeated rows are copies; a text of any length is one set of all its
shingles; among members that could be a part's pivot the first by row is; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from spanforge.llm.common import Scratch, bit_map, bytes_of, cut_lineage, drop_rows, id_and_text, map_bits, numbered, partitions, release, row_base, slices
from spanforge.llm.components import Forest, components, salted_join
from spanforge.llm.shingles import Shingler, mix

SKETCH_BITS = 21
CHUNKS = 32
GROUPS = 256
#: Bytes of sets in a tile, about; a task holds two tiles.
TILE_BYTES = 24 << 20
LEAF = 16


def links(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


# --- the frequency sketch -------------------------------------------------------------

def _count(bits: int):
    def run(batches):
        shingler, counts, task = Shingler(), np.zeros(1 << bits, dtype=np.uint32), row_base() >> 33
        mask = np.uint64((1 << bits) - 1)
        for batch in slices(batches):
            every = np.concatenate(shingler(bytes_of(batch.column(0))) or [np.zeros(0, np.uint64)])
            np.add.at(counts, (every & mask).astype(np.int64), 1)
        if counts.any():
            parts = np.split(counts, CHUNKS)
            yield pa.record_batch([pa.array(np.full(CHUNKS, task, np.int32)), pa.array(np.arange(CHUNKS, dtype=np.int32)),
                                   pa.array([p.tobytes() for p in parts], pa.binary())], names=["task", "chunk", "counts"])
        release()

    return run


def _add(key: tuple, rows: pa.Table) -> pa.Table:
    first, *others = (np.frombuffer(d.as_buffer(), np.uint32) for d in rows.column("counts"))
    total = first.astype(np.uint64)
    for more in others:
        total += more
    total = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def frequency_levels(docs: DataFrame, bits: int = SKETCH_BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """For each bucket of shingles a level, 0 for the rare ones; log2 counts; and the most that a rare one can have."""
    counted = docs.select("text").mapInArrow(_count(bits), "task int, chunk int, counts binary")
    fan = max(4, math.isqrt(partitions(docs.sparkSession)) * 2)
    some = counted.groupBy("chunk", F.pmod("task", F.lit(fan)).alias("s")).applyInArrow(_add, "chunk int, counts binary")
    counts = np.zeros(1 << bits, dtype=np.uint32)
    size = (1 << bits) // CHUNKS
    for chunk, data in some.groupBy("chunk").applyInArrow(_add, "chunk int, counts binary").collect():
        counts[chunk * size:(chunk + 1) * size] = np.frombuffer(data, np.uint32)
    mean = float(np.median(counts))
    limit = int(mean + 6 * math.sqrt(mean) + 8)
    log = np.log2(counts + 1.0)
    return np.where(counts > limit, np.ceil(log), 0).astype(np.uint8), (log * 8).astype(np.uint8), limit


# --- points ---------------------------------------------------------------------------

_POINTS = ("row long, doc_id long, n int, set_id binary, common double, rare array<long>, frequent array<long>, vector binary")


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def vector_of(shingles: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(40)).astype(np.int64) % groups, minlength=groups)


def set_id(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _points(sketch, percent: int, groups: int):
    def run(batches):
        levels, logs = sketch.value
        shingler, mask, row = Shingler(), np.uint64(len(levels) - 1), row_base()
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(6)]
            for every in shingler(bytes_of(batch.column(1))):
                own = np.unique(every)
                n = len(own)
                at = own & mask
                level = levels[at]
                first = np.argsort(level, kind="stable")[:n - -(-percent * n // 100) + 1] if n else np.zeros(0, np.int64)
                hot = level[first] > 0
                for col, v in zip(cols, (n, set_id(own) if n else None, float(logs[at].mean()) if n else 0.0, own[first[~hot]],
                                         own[first[hot]], vector_of(own, groups).astype(np.uint16 if n < 65536 else np.uint32).tobytes())):
                    col.append(v)
            rows = batch.column(2) if batch.num_columns > 2 else pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.record_batch([rows, batch.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()),
                                   pa.array(cols[2], pa.float64()), _list_array(cols[3]), _list_array(cols[4]), pa.array(cols[5], pa.binary())],
                                  names=[f.split()[0] for f in _POINTS.split(", ")])
        release()

    return run


# --- parts ----------------------------------------------------------------------------

def _lists():
    """The members of each run of equal shingles, under a key that equal lists of members share."""

    def members_of(ids, starts, ends):
        sizes = ends - starts
        at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = ids[at]
        key = np.add.reduceat(mix(own.astype(np.uint64)), np.cumsum(sizes) - sizes)
        both = np.unique(np.stack([np.repeat(key.view(np.int64), sizes), own], 1), axis=0)
        return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["list", "rep"])

    def run(batches):
        left = None
        for batch in batches:
            h, ids = (batch.column(i).to_numpy() for i in range(2))
            if left is not None:
                h, ids = (np.concatenate([p, q]) for p, q in zip(left, (h, ids)))
            if not len(h):
                continue
            cuts = np.flatnonzero(np.diff(h)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(h)]])
            left = h[starts[-1]:], ids[starts[-1]:]  # the last run may go on
            many = (ends - starts > 1)[:-1]
            if many.any():
                yield members_of(ids, starts[:-1][many], ends[:-1][many])
        if left is not None and len(left[0]) > 1:
            yield members_of(left[1], np.array([0]), np.array([len(left[0])]))

    return run


def _vector(data: bytes, groups: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * groups else np.uint32)


def _near(percent: int, groups: int):
    """Of each list, sorted together, edges that span the components of what the bound allows."""

    def edges_of(ids, n, vectors):
        v = np.stack([_vector(x, groups) for x in vectors]).astype(np.int32)
        tree, forest, out = RTree(v, n), Forest(), []
        for i in range(len(ids)):
            for j in tree.search(v[i], int(n[i]), percent).tolist():
                if i != j and forest.union(i, j):
                    out.append((ids[i], ids[j]))
        return out

    def run(batches):
        left = None
        for batch in batches:
            key, ids, n = (batch.column(i).to_numpy() for i in range(3))
            rows = (key, ids, n.astype(np.int64), np.array([*batch.column(3).to_pylist(), None], dtype=object)[:-1])
            if left is not None:
                rows = tuple(np.concatenate([p, q]) for p, q in zip(left, rows))
            key, ids, n, vectors = rows
            if not len(key):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist()]
            out = []
            for s, e in zip(cuts, cuts[1:]):
                out += edges_of(ids[s:e], n[s:e], vectors[s:e])
            left = tuple(x[cuts[-1]:] for x in rows)
            yield _edge_batch(out)
        if left is not None:
            yield _edge_batch(edges_of(*left[1:]))
        release()

    return run


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["a", "b"])


def _sets(wanted):
    """(set_id, shingles) of the texts whose set is in the filter, each set once a task."""

    def run(batches):
        mask, shingler, seen = np.frombuffer(wanted.value, np.uint8), Shingler(), set()
        for batch in slices(batches):
            ids, sets = [], []
            for every in shingler(bytes_of(batch.column(0))):
                own = np.unique(every)
                key = set_id(own)
                at = int.from_bytes(key[:8], "big") % (8 * len(mask))
                if len(own) and mask[at >> 3] >> (at & 7) & 1 and key not in seen:
                    seen.add(key)
                    ids.append(key)
                    sets.append(own.tobytes())
            yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(sets, pa.binary())], names=["set_id", "shingles"])
        release()

    return run


def _filter(ids: DataFrame) -> bytes:
    """Set bits of all candidates' sets."""
    size = map_bits(ids.count())

    def bits(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([int.from_bytes(k[:8], "big") % size for k in batch.column(0).to_pylist()], pa.int64())], names=["at"])

    return bit_map(ids.select("set_id").mapInArrow(bits, "at long"), size)


# --- the tree -------------------------------------------------------------------------

class RTree:
    """Points in nodes of LEAF, levels up to one root; a node keeps its coordinate maxima and least size."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        # tiles by size first, then by the leading coordinates: neighbours are then alike
        self.order = np.lexsort((vectors[:, 1], vectors[:, 0], (np.log2(np.maximum(sizes, 1)) * 4).astype(int)))
        self.levels = [(vectors[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > 1:
            v, low, high = self.levels[-1]
            cuts = np.arange(0, len(v), LEAF)
            self.levels.append((np.maximum.reduceat(v, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def search(self, vector: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose bound allows the similarity."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            v, low, high = (x[nodes] for x in self.levels[depth])
            least = np.maximum(low, -(-percent * size // 100))
            fits = (100 * size >= percent * low) & (100 * high >= percent * size)
            fits &= (100 + percent) * np.minimum(v, vector).sum(axis=1) >= percent * (size + least)
            nodes = nodes[fits]
            if depth:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return self.order[nodes]


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _linked_to_pivot(percent: int):
    def run(batches):
        for batch in batches:
            ids, pivots = batch.column(0), batch.column(1)
            same = np.array([links(_overlap(x := np.frombuffer(s, np.uint64), y := np.frombuffer(p, np.uint64)), len(x), len(y), percent)
                             for s, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], dtype=bool)
            yield pa.record_batch([ids, pivots, pa.array(same)], names=["a", "b", "same"])

    return run


def _tile_links(percent: int):
    """Links between two tiles, or within one, found in an R-tree; enough of them to span each component."""

    def run(rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("shingles")]
        ids, tied = rows.column("rep").to_numpy(), rows.column("tied").to_numpy().astype(bool)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        groups = int(min(2048, max(64, 1 << int(np.median(sizes)).bit_length())))
        vectors = np.stack([vector_of(s, groups) for s in sets]).astype(np.int32)
        tree, forest, a, b = RTree(vectors, sizes), Forest(), [], []
        pivot = -1  # all tied members are one component already
        for i in np.flatnonzero(tied):
            forest.union(int(i), pivot)
        for i in np.flatnonzero(~tied).tolist():
            for j in tree.search(vectors[i], int(sizes[i]), percent).tolist():
                if i != j and forest.find(i) != forest.find(j) and links(_overlap(sets[i], sets[j]), len(sets[i]), len(sets[j]), percent):
                    forest.union(i, j)
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
                       percent: int = 80, groups: int = GROUPS, sketch_bits: int = SKETCH_BITS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """One row per document: row, doc_id, n_shingles, component_id, set_id, first_row.

    Two documents link when 100 * overlap >= percent * union.  ``component_id`` is the
    smallest id that links lead to, the own one included; ``first_row`` is the row that
    stands for the component.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col, row_col)
    levels, logs, _ = frequency_levels(docs, sketch_bits)
    sketch = spark.sparkContext.broadcast((levels, logs))
    # a table goes as soon as those that are made of it are written
    every = Scratch(docs.mapInArrow(_points(sketch, percent, groups), _POINTS))
    sketch.destroy()
    points = cut_lineage(every.df.select("row", "doc_id", "n", "set_id"))
    # equal sets are one point, known by the number of one of its rows
    reps = points.where("n > 0").groupBy("set_id").agg(F.min("row").alias("row"))
    # the copies are few and their numbers narrow, so the wide rows of the points need not be shuffled for them
    copies = cut_lineage(salted_join(points.where("n > 0").select("set_id", "row"), reps.withColumnRenamed("row", "_first"), ["set_id"])
                         .where(F.col("row") != F.col("_first")).select("row"))
    distinct = Scratch(every.df.where("n > 0").drop("doc_id").join(copies, "row", "left_anti").withColumnRenamed("row", "rep"))
    every.drop()
    own = distinct.df

    rare = own.select(F.explode("rare").alias("h"), "rep").repartition("h").sortWithinPartitions("h", "rep")
    lists = rare.mapInArrow(_lists(), "list long, rep long").distinct()
    # edges are written first, so that a task of the components has one Python worker and not two
    near = cut_lineage(lists.join(own.select("rep", "n", "vector"), "rep").select("list", "rep", "n", "vector").repartition("list")
                       .sortWithinPartitions("list", "rep").mapInArrow(_near(percent, groups), "a long, b long"))
    frequent = own.select(F.explode("frequent").alias("h"), "rep")
    star = salted_join(frequent, frequent.groupBy("h").agg(F.min("rep").alias("b")), ["h"]).select(F.col("rep").alias("a"), "b")
    parts = components(near.unionByName(star)).withColumnsRenamed({"node": "rep", "label": "part"})
    bare = Scratch(parts.join(own.select("rep", "set_id", "n", "common"), "rep"))
    distinct.drop()
    wanted = spark.sparkContext.broadcast(_filter(bare.df))
    sets = docs.select("text").mapInArrow(_sets(wanted), "set_id binary, shingles binary").groupBy("set_id").agg(F.first("shingles").alias("shingles"))
    full = Scratch(bare.df.join(sets, "set_id"))
    wanted.destroy()
    bare.drop()
    members = full.df

    # each part's pivot, and how many tiles its sets make
    heads = members.groupBy("part").agg(F.max_by("rep", F.struct("common", -F.col("rep"))).alias("pivot"), F.count(F.lit(1)).alias("size"),
                                        F.ceil(F.sum(F.col("n").cast("long") * 8) / tile_bytes).cast("int").alias("tiles"))
    pivots = heads.join(members.select(F.col("rep").alias("pivot"), F.col("shingles").alias("pivot_set")), "pivot")
    tied = cut_lineage(salted_join(members.select("part", "rep", "shingles"), pivots.select("part", "pivot", "pivot_set"), ["part"])
                       .select("rep", "pivot", "shingles", "pivot_set").mapInArrow(_linked_to_pivot(percent), "a long, b long, same boolean"))
    # a part whose members are all tied is done
    rest = members.select("part", "rep").join(tied.where(~F.col("same")).select(F.col("a").alias("rep")), "rep").select("part").distinct()
    undone = cut_lineage(heads.where("size > 2").select("part", "tiles").join(rest, "part"))
    state = salted_join(members.select("part", "rep", "shingles"), undone, ["part"])
    state = state.join(tied.select(F.col("a").alias("rep"), F.col("same").alias("tied")), "rep").withColumn(
        "tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int") * 2 + F.col("tied").cast("int"))
    state = cut_lineage(state)
    full.drop()
    # tiles of tied members meet only those that hold others
    others = state.where(~F.col("tied")).select("part", F.col("tile").alias("other")).distinct()
    tiles = state.select("part", "tile").distinct().join(others, "part").select(
        "part", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")).distinct()
    meets = tiles.unionByName(others.select("part", F.col("other").alias("tile"), F.col("other").alias("i"), F.col("other").alias("j"))).unionByName(
        tiles.select("part", F.when(F.col("tile") == F.col("i"), F.col("j")).otherwise(F.col("i")).alias("tile"), "i", "j")).distinct()
    found = cut_lineage(state.select("part", "tile", "rep", "tied", "shingles").join(meets, ["part", "tile"])
                        .groupBy("part", "i", "j").applyInArrow(_tile_links(percent), "a long, b long"))
    linked = components(tied.where("same").select("a", "b").unionByName(found))

    ids = points
    all_reps = reps.select("set_id", F.col("row").alias("rep")).join(linked.select(F.col("node").alias("rep"), "label"), "rep", "left")
    all_reps = all_reps.select("set_id", F.coalesce("label", "rep").alias("label"))
    labelled = cut_lineage(salted_join(ids.where("n > 0"), all_reps, ["set_id"]))
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    out = salted_join(labelled, first, ["label"]).select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), "set_id", F.col("first.row").alias("first_row"))
    alone = ids.where("n = 0").select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "set_id",
                                      F.col("row").alias("first_row"))
    return out.unionByName(alone).withColumn("n_shingles", F.col("n_shingles").cast("long"))


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns."""
    rows, row_col = numbered(docs)
    found = similar_components(rows, id_col=id_col, text_col=text_col, row_col=row_col, percent=percent)
    return drop_rows(rows, row_col, found.where(F.col("row") != F.col("first_row")))
