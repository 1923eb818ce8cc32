"""Quality classifier on random-indexing word vectors.

Every word has a sparse random index vector; a word's context vector is the sum of the
index vectors of its neighbours over the whole corpus.  A document is pooled from the
context vectors of its words, and a two-layer network with a temperature turns that into
a probability.  Words share a fixed number of rows by their hash, so the model has one
size for any corpus; tasks send sums, and two rounds of adding keep what meets in one
place small.

The network is fitted on the driver on about ``train_rows`` labelled documents, those
under a threshold of the hash of their id and content that is set from their number; the
context vectors come from all documents.

Defined cases: null and empty texts are scored by the network on zeros; null ids have no
label and are not held out; a document with several labels has the largest; repeated rows
count once in the fit and are scored each; texts of any length are pooled whole, in
pieces; without labels of both kinds every score is the share of label 1, or one half
without any; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanforge.llm.common import bytes_of, cut_lineage, drop_rows, id_and_text, numbered, partitions, release, row_base, slices
from spanforge.llm.hashing import WordHasher

ROWS, DIMS, NONZERO, WINDOW = 1 << 15, 64, 4, 2
CHUNKS = 32
TRAIN_ROWS = 20_000
HIDDEN = 32
#: Of each ASCII character: 0 parts words, 1 is of a word, 2 of a run of marks.
_KINDS = np.array([1 if c > 126 or chr(c).isalnum() else 2 if c > 32 else 0 for c in range(256)], np.uint8)
#: Words that are pooled together.
PIECE = 1 << 14
FEATURES = 2 * DIMS + 3


def index_vectors(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each row's index vector."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((ROWS, DIMS)), axis=1)[:, :NONZERO]
    return places, np.where(rng.random((ROWS, NONZERO)) < 0.5, -1.0, 1.0)


def _words(hasher: WordHasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word of all texts, whether it is a run of marks, and how many words each text has."""
    hashes, kinds, sizes = hasher(texts)
    return hashes.view(np.int64), kinds == 2, sizes


def _contexts(batches):
    places, signs = index_vectors()
    # whole numbers below 2^53, so exact; one flat array, to which every count is added in place
    flat, counts, task, hasher = np.zeros(ROWS * DIMS), np.zeros(ROWS, dtype=np.int64), row_base() >> 33, WordHasher(_KINDS, fold=False)
    for batch in slices(batches, 100):
        rows, _, sizes = _words(hasher, bytes_of(batch.column(0)))
        rows &= ROWS - 1
        if not len(rows):
            continue
        doc = np.repeat(np.arange(len(sizes)), sizes)
        for far in range(1, WINDOW + 1):
            near = np.flatnonzero(doc[far:] == doc[:-far])
            for word, other in ((rows[near], rows[near + far]), (rows[near + far], rows[near])):
                for k in range(NONZERO):
                    np.add.at(flat, word * DIMS + places[other, k], signs[other, k])
        counts += np.bincount(rows, minlength=ROWS)
    if counts.any():
        sums = np.concatenate([flat.reshape(ROWS, DIMS).astype(np.int64), counts[:, None]], axis=1)
        parts = np.split(sums.astype("<i4") if np.abs(sums).max() < 2**31 else sums, CHUNKS)
        del flat
        yield pa.record_batch([pa.array(np.full(CHUNKS, task, np.int32)), pa.array(np.arange(CHUNKS, dtype=np.int32)),
                               pa.array([p.tobytes() for p in parts], pa.binary())], names=["task", "chunk", "sums"])
        del sums, parts
    release()


def _add(key: tuple, rows: pa.Table) -> pa.Table:
    cells = ROWS // CHUNKS * (DIMS + 1)
    total = np.zeros(cells, dtype=np.int64)
    for c in rows.column("sums"):
        c = c.as_buffer()
        total += np.frombuffer(c, "<i4" if c.size == 4 * cells else "<i8")
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of unit length and, in the last column, the weight of the word."""
    summed = docs.select("text").mapInArrow(_contexts, "task int, chunk int, sums binary")
    fan = max(4, 2 * math.isqrt(partitions(docs.sparkSession)))
    some = summed.groupBy("chunk", F.pmod("task", F.lit(fan)).alias("s")).applyInArrow(_add, "chunk int, sums binary")
    out = np.zeros((ROWS, DIMS + 1), dtype=np.float32)
    size = ROWS // CHUNKS
    for chunk, data in some.groupBy("chunk").applyInArrow(_add, "chunk int, sums binary").collect():
        out[chunk * size:(chunk + 1) * size] = np.frombuffer(data, "<i8").reshape(size, DIMS + 1)
    vectors, counts = out[:, :DIMS], out[:, DIMS]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    share = counts / max(1.0, counts.sum())
    out[:, :DIMS] = vectors / np.maximum(length, 1e-9)
    out[:, DIMS] = 1e-3 / (1e-3 + share)
    return out


def _pooled(model):
    def run(batches):
        vectors, weight = model.value[:, :DIMS], model.value[:, DIMS:]
        # a document's sums over these are its weighted means and squares
        table = np.concatenate([vectors * weight, vectors ** 2 * weight, weight], axis=1)
        row, hasher = row_base(), WordHasher(_KINDS, fold=False)
        for batch in slices(batches, 100):
            hashes, marks, sizes = _words(hasher, bytes_of(batch.column(1)))
            sums, ends = np.zeros((len(sizes), table.shape[1])), np.cumsum(sizes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            for at in range(0, len(hashes), PIECE):
                own = doc[at:at + PIECE]
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                sums[own[starts]] += np.add.reduceat(table[hashes[at:at + PIECE] & (ROWS - 1)], starts, axis=0)
            out = np.zeros((len(sizes), FEATURES), dtype=np.float32)
            full = np.flatnonzero(sizes)
            if len(full):
                out[full, :2 * DIMS] = sums[full, :2 * DIMS] / sums[full, 2 * DIMS:]
                out[full, DIMS:2 * DIMS] = np.sqrt(out[full, DIMS:2 * DIMS])
                out[full, 2 * DIMS] = np.log1p(sizes[full])
                out[full, 2 * DIMS + 1] = [len(np.unique(hashes[ends[i] - sizes[i]:ends[i]])) / sizes[i] for i in full]
                out[full, 2 * DIMS + 2] = np.bincount(doc[marks], minlength=len(sizes))[full] / sizes[full]
            n = batch.num_rows
            numbers = batch.column(2) if batch.num_columns > 2 else pa.array(np.arange(row, row + n))
            row += n
            yield pa.record_batch([numbers, batch.column(0), pa.array([f.tobytes() for f in out], pa.binary())],
                                  names=["row", "doc_id", "features"])
        del table, vectors
        release()

    return run


class Network:
    """Two layers, fitted by Adam on cross entropy, then one temperature on rows kept apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, hidden: int = HIDDEN, epochs: int = 40, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.weights = None
        if len(np.unique(y)) < 2:
            return
        order = rng.permutation(len(y))
        held, train = order[:len(y) // 5], order[len(y) // 5:]
        self.mean, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        w = [rng.normal(0, 1 / math.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden),
             rng.normal(0, 1 / math.sqrt(hidden), (hidden, 1)), np.array([math.log((self.prior + 1e-3) / (1 - self.prior + 1e-3))])]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            rng.shuffle(train)
            for at in range(0, len(train), 128):
                i = train[at:at + 128]
                a = np.maximum(z[i] @ w[0] + w[1], 0)
                d = (1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -30, 30))) - y[i, None]) / len(i)
                back = (d @ w[2].T) * (a > 0)
                t += 1
                for k, g in enumerate((z[i].T @ back + 1e-3 * w[0], back.sum(axis=0), a.T @ d + 1e-3 * w[2], d.sum(axis=0))):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    w[k] = w[k] - 2e-3 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        if len(held):
            logits, truth = self.logits(x[held]), y[held]
            loss = lambda temp: np.mean(np.logaddexp(0, logits / temp) - truth * logits / temp)
            self.temperature = float(min(np.geomspace(0.25, 8, 121), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return (np.maximum((x - self.mean) / self.scale @ w[0] + w[1], 0) @ w[2] + w[3])[:, 0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
                   train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: row, doc_id, held_out, score, predicted.

    ``labels`` has doc_id and quality; those of held-out documents are never learnt.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col, row_col)
    model = spark.sparkContext.broadcast(word_vectors(docs))
    pooled = cut_lineage(docs.mapInArrow(_pooled(model), "row long, doc_id long, features binary"))
    model.destroy()
    truth = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("quality").alias("quality"))
    labelled = (pooled.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(truth, "doc_id")
                .select("doc_id", "features", "quality").distinct())
    share = min(1.0, train_rows / max(1, labelled.count()))
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", "features"), F.lit(1 << 30)) < int(share * (1 << 30)))
    learnt = sorted(drawn.collect(), key=lambda r: (r.doc_id, bytes(r.features)))
    x = np.array([np.frombuffer(r.features, np.float32) for r in learnt], dtype=np.float64).reshape(-1, FEATURES)
    network = Network(x, np.array([float(r.quality > 0) for r in learnt]))

    @F.arrow_udf("double")
    def score(features: pa.Array) -> pa.Array:
        return pa.array(network.predict(np.frombuffer(b"".join(features.to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)))

    return pooled.select("row", "doc_id", held_out(F.col("doc_id")).alias("held_out"), score("features").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are predicted to have label 1, with all columns."""
    rows, row_col = numbered(docs)
    found = quality_scores(rows, labels, id_col=id_col, text_col=text_col, row_col=row_col)
    return drop_rows(rows, row_col, found.where("predicted = 0"))
