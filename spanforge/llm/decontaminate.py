"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give the TF-IDF weights.
2. A randomised SVD spans the latent space: tasks multiply their TF-IDF passages with a
   random matrix and back, the driver orthogonalises the sum, which has one size for any
   input, and a second round sharpens it.  It is fitted on the benchmark's passages, the
   query set: directions of the corpus that no item has part in would tell nothing.
3. Windows of the documents are projected, and those whose cosine with a passage is a
   given share of what the passage has with itself are candidates.  The weight of a window
   counts up to the passage's, so that neither rare words in the place of an item's nor the
   words around a short item hide it.
4. A candidate is compared with the item word by word: a leak has most of the item as a
   common subsequence; with less, a paraphrase, if it also has the item's answer, its
   last words.

Step 4 asks for a share of an item's words within a stretch of a known length.  Whatever
of them a document lacks, it has some of the item's rarest, so an inverted index from
these to the items and a count of what stands close together name the stretches that can
pass; only their windows are projected.  This drops no window that step 4 would accept.

The items come in blocks of a bounded size, several to a pass over the documents; nothing
of the documents is shuffled or collected.  Equal items are searched once.  An item of more
than ``SECTION`` words is searched in sections, each as an item; its best one is reported.

Defined cases: null and empty texts match nothing, nor do empty items; ids may be null;
repeated rows are each reported, of either side; texts of any length are searched whole; of
two stretches of a document that have as much of an item the first is reported; an empty
table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanforge.llm.common import added, bytes_of, cut_lineage, drop_rows, id_and_text, in_chunks, named, numbered, row_base, slices
from spanforge.llm.hashing import WordHasher

VOCABULARY, RANK, OVERSAMPLE, CHUNKS = 1 << 16, 640, 32, 32
#: A window is short, so that a leak of an item fills it, and moves by less than a passage may shift.
WINDOW, STRIDE, PASSAGE_STRIDE = 16, 4, 16
#: Passages in a block, about.  Passages have little in common, so a space of RANK holds no more of them well.
BLOCK_PASSAGES = 512
#: Blocks that one pass over the documents searches, each some 20 MB in every task.
PASS_BLOCKS = 8
#: Words of an item that are searched as one.
SECTION = 1024
#: The share is far below PARAPHRASE, as the words that a paraphrase keeps may be the light ones of a passage.
SHARE, LEAK, PARAPHRASE, ANSWER = 0.35, 0.8, 0.6, 0.8
#: Rare words of an item that a stretch must have: one in so many of the item's words.
RARE_EACH = 8
#: Words are parted by ASCII characters that are no letters or digits.
_SEPARATORS = bytes(c for c in range(127) if not chr(c).isalnum())
_FOUND = "row long, doc_id long, item long, cosine double, common double, answer double, word_start int, word_end int"
_SECTIONS = "item long, words binary, passages long"


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and how many each text has."""
    if not _HASHER:
        _HASHER.append(WordHasher.of_separators(_SEPARATORS))
    hashes, _, sizes = _HASHER[0](texts)
    return hashes.view(np.int64), sizes


_HASHER: list[WordHasher] = []


def _frequencies(batches):
    counts = np.zeros(VOCABULARY, dtype=np.int64)
    documents = 0
    for batch in slices(batches):
        hashes, sizes = word_hashes(bytes_of(batch.column(0)))
        doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        own = np.sort(doc * np.uint32(VOCABULARY) + (hashes & (VOCABULARY - 1)).astype(np.uint32))
        own = own[np.flatnonzero(np.diff(own, prepend=own[:1] + 1))]
        counts += np.bincount(own & (VOCABULARY - 1), minlength=VOCABULARY)
        documents += len(sizes)
    if documents:
        yield in_chunks(counts, CHUNKS)


def idf_weights(docs: DataFrame) -> np.ndarray:
    counts = added(docs.select("text").mapInArrow(_frequencies, "task int, chunk int, data binary"), "<i8")
    if not len(counts):
        return np.ones(VOCABULARY)
    return np.log1p(max(1, counts.max()) / np.maximum(counts, 1)) + 0.1


def passages_of(n: int) -> list[tuple[int, int]]:
    """Word ranges of an item's passages."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = [*range(0, n - WINDOW, PASSAGE_STRIDE), n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def _sections(batches):
    """The hashed words of items, cut into sections."""
    for batch in slices(batches):
        hashes, sizes = word_hashes(bytes_of(batch.column(1)))
        cols: list[list] = [[], [], []]
        for item, n, end in zip(batch.column(0).to_pylist(), sizes.tolist(), np.cumsum(sizes).tolist()):
            for at in range(0, n, SECTION):
                words = hashes[end - n + at:end - n + min(n, at + SECTION)]
                for col, v in zip(cols, (item, words.tobytes(), len(passages_of(len(words))))):
                    col.append(v)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64()))], names=["item", "words", "passages"])


def _words_of(data: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(d, np.int64) for d in data]


def _passage_rows(words: list[np.ndarray]) -> list[np.ndarray]:
    return [w[s:t] & (VOCABULARY - 1) for w in words for s, t in passages_of(len(w))]


def _multiply(basis, idf):
    """A task's part of A'AX for its TF-IDF passages A."""

    def run(batches):
        (known, x), weight, out = basis.value, idf.value, None
        for batch in slices(batches):
            for rows in _passage_rows(_words_of(batch.column(0).to_pylist())):
                if out is None:
                    out = np.zeros(x.shape, dtype=np.float32)
                w, at = weight[rows].astype(np.float32), np.searchsorted(known, rows)
                np.add.at(out, at, w[:, None] * (w @ x[at])[None, :])
        if out is not None:
            yield in_chunks(out, CHUNKS)

    return run


def latent_basis(sections: DataFrame, known: np.ndarray, idf: np.ndarray, *, rank: int = RANK, oversample: int = OVERSAMPLE,
                 rounds: int = 2, seed: int = 9) -> np.ndarray:
    """Orthonormal columns that span the leading right singular vectors of the items' passages.

    The rows are the hashed words ``known`` that the items have, so its size is the block's.
    """
    sc = sections.sparkSession.sparkContext
    weights, size = sc.broadcast(idf), -(-max(1, len(known)) // CHUNKS) * CHUNKS
    basis = np.random.default_rng(seed).normal(size=(size, rank + oversample)).astype(np.float32)
    for _ in range(rounds):
        total = added(sections.select("words").mapInArrow(_multiply(sc.broadcast((known, basis)), weights), "task int, chunk int, data binary"), "<f4")
        if not len(total):
            return basis[:len(known), :0]
        left, values, _ = np.linalg.svd(total.reshape(size, -1), full_matrices=False)
        basis = (left * (values > values[0] * 1e-5)).astype(np.float32)
    return basis[:len(known), :rank]


def common_words(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item, given as bit masks of its words, and some words."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Items:
    """The query set of one block: words for the comparison, projected passages for the search, rare words for the gate."""

    def __init__(self, ids: list, words: list[np.ndarray], known: np.ndarray, idf: np.ndarray, basis: np.ndarray):
        self.ids, self.idf, self.words = ids, idf, [w.tolist() for w in words]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.first = np.cumsum([0, *(len(passages_of(n)) for n in sizes.tolist())])  # passages of an item are neighbours
        rows = _passage_rows(words)
        #: place of a word in the latent space; words that no item has share a row of zeros
        self.place = np.full(VOCABULARY, len(known), dtype=np.int64)
        self.place[known] = np.arange(len(known))
        weighted = np.vstack([basis * idf[known][:, None].astype(np.float32), np.zeros((1, basis.shape[1]), np.float32)])
        projected = np.array([weighted[self.place[r]].sum(axis=0) for r in rows], dtype=np.float32).reshape(len(rows), basis.shape[1])
        norms = np.array([np.sqrt((idf[r] ** 2).sum()) for r in rows])
        own = (projected ** 2).sum(axis=1) / np.maximum(norms, 1e-9) ** 2  # the cosine of a passage with itself
        # a window's latent vector is a sum over its words, and so is its product with each passage,
        # here in parts of the least product of a window that has the passage's weight
        self.least, self.norms = np.maximum(SHARE * own * norms, 1e-9).astype(np.float32), norms.astype(np.float32)
        self.products = weighted @ (projected / (np.maximum(norms, 1e-9) * self.least)[:, None]).T
        # of the rarest words, as many that at least ``least_rare`` of them are among any PARAPHRASE of the item
        self.least_rare = np.maximum(1, sizes // RARE_EACH)
        #: the longest stretch that is compared with an item
        self.stretch = 2 * sizes + sizes // 2 + WINDOW
        pairs = [(w, i) for i, own in enumerate(words) for w in set(own[np.argsort(-idf[own & (VOCABULARY - 1)], kind="stable")][
            :len(own) - int(np.ceil(PARAPHRASE * len(own))) + int(self.least_rare[i])].tolist())]
        pairs.sort()
        self.rare, starts = np.unique(np.array([w for w, _ in pairs], np.int64), return_index=True)
        self.rare_starts, self.rare_items = np.append(starts, len(pairs)), np.array([i for _, i in pairs], np.int64)
        self.may_be = np.zeros(1 << 18, bool)
        self.may_be[self.rare & (len(self.may_be) - 1)] = True

    def answer(self, i: int) -> list[int]:
        return self.words[i][-max(3, len(self.words[i]) // 4):]

    def stretches(self, hashes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, first, end): words among which enough of the item's rare ones stand close together."""
        at = np.flatnonzero(self.may_be[hashes & (len(self.may_be) - 1)])
        k = np.minimum(np.searchsorted(self.rare, hashes[at]), max(0, len(self.rare) - 1))
        if not len(at):
            return []
        true = self.rare[k] == hashes[at]
        at, k = at[true], k[true]
        n = self.rare_starts[k + 1] - self.rare_starts[k]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        item, at = self.rare_items[np.repeat(self.rare_starts[k], n) + step], np.repeat(at, n)
        doc = np.searchsorted(ends, at, "right")
        order = np.lexsort((at, item, doc))
        doc, item, at = doc[order], item[order], at[order]
        group = doc * len(self.ids) + item
        last = np.arange(len(at)) + self.least_rare[item] - 1
        inside = np.minimum(last, max(0, len(at) - 1))
        enough = (last < len(at)) & (group[inside] == group) & (at[inside] - at < self.stretch[item])
        out: list[list[int]] = []
        for d, i, p in zip(doc[enough].tolist(), item[enough].tolist(), at[enough].tolist()):
            far = 2 * int(self.stretch[i])
            if out and out[-1][:2] == [d, i] and p - far <= out[-1][3]:
                out[-1][3] = p + far
            else:
                out.append([d, i, p - far, p + far])
        return [tuple(x) for x in out]


def _regions(windows: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float]]:
    """Windows that begin within half an item's ``n`` words of the first of them, as one stretch of words."""
    out: list[tuple[int, int, float]] = []
    for s, e, c in windows:
        if out and s <= out[-1][0] + n // 2:
            out[-1] = (out[-1][0], max(out[-1][1], e), max(out[-1][2], c))
        else:
            out.append((s, e, c))
    return out


def _windows(q: Items, i: int, hashes: np.ndarray, low: int, high: int, first: int, end: int) -> list[tuple[int, int, float]]:
    """Windows of a document's words ``low`` to ``high`` that begin from ``first`` to ``end`` and are candidates for an item."""
    starts = np.arange(low + max(0, first - low) // STRIDE * STRIDE, max(high - WINDOW, low) + STRIDE, STRIDE)
    starts = starts[(starts < high) & (starts < end)]
    if not len(starts):
        return []
    stops = np.minimum(starts + WINDOW, high)
    base = int(starts[0])
    rows = hashes[base:int(stops[-1])] & (VOCABULARY - 1)
    mine = slice(int(q.first[i]), int(q.first[i + 1]))
    sums = np.zeros((len(rows) + 1, mine.stop - mine.start))
    np.cumsum(q.products[q.place[rows], mine], axis=0, out=sums[1:])
    squares = np.concatenate([[0.0], np.cumsum(q.idf[rows] ** 2)])
    product = sums[stops - base] - sums[starts - base]
    norm = np.sqrt(np.maximum(squares[stops - base] - squares[starts - base], 1e-9))
    return [(int(starts[w]), int(stops[w]), float(product[w, p] * q.least[mine][p] / norm[w]))
            for w, p in zip(*np.nonzero(product >= np.minimum(norm[:, None] / q.norms[mine], 1) * 0.9999))]


def _search(blocks):
    def run(batches):
        row, known = row_base(), []
        for block in blocks:
            q = block.value
            known.append((q, [_masks(w) for w in q.words], [_masks(q.answer(i)) for i in range(len(q.ids))]))
        for batch in slices(batches, 200):
            hashes, sizes = word_hashes(bytes_of(batch.column(1)))
            ends = np.cumsum(sizes)
            out: list[list] = [[] for _ in range(8)]
            ids = batch.column(0).to_pylist()
            numbers = batch.column(2).to_pylist() if batch.num_columns > 2 else range(row, row + batch.num_rows)
            row += batch.num_rows
            for q, masks, answers in known:
                found: dict[tuple[int, int], set] = {}
                for d, i, first, end in q.stretches(hashes, ends):
                    found.setdefault((d, i), set()).update(_windows(q, i, hashes, int(ends[d] - sizes[d]), int(ends[d]), first, end))
                for (d, i), windows in found.items():
                    n, low = len(q.words[i]), int(ends[d] - sizes[d])
                    best = None
                    for s, e, c in _regions(sorted(windows), n):
                        s, e = max(low, s - n), min(int(ends[d]), e + n)  # a window at either end of the item reaches all of it
                        words = [w for w in hashes[s:e].tolist() if w in masks[i]]
                        if len(words) < PARAPHRASE * n:
                            continue
                        got = common_words(masks[i], n, words) / n
                        if best is None or got > best[0]:
                            best = (got, c, s, e, words)
                    if best is None or best[0] < PARAPHRASE:
                        continue
                    tail = q.answer(i)
                    answer = common_words(answers[i], len(tail), best[4]) / len(tail)
                    if best[0] >= LEAK or answer >= ANSWER:
                        for col, v in zip(out, (numbers[d], ids[d], q.ids[i], best[1], best[0], answer, best[2] - low, best[3] - low)):
                            col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=[f.split()[0] for f in _FOUND.split(", ")])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
          item_col: str = "item_id", item_text_col: str = "text", block_passages: int = BLOCK_PASSAGES) -> DataFrame:
    """One row per document and item it holds: row, doc_id, item_id, cosine, common, answer, word_start, word_end.

    ``common`` is the share of the item's words in the longest common subsequence, over
    the words from ``word_start`` to ``word_end`` of the document.
    """
    spark: SparkSession = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col, row_col)
    items = benchmark.select(named(item_col).cast("long").alias("item_id"), named(item_text_col).cast("string").alias("text")).where(F.col("text") != "")
    items = items.withColumn("digest", F.sha2("text", 256))
    texts = cut_lineage(items.groupBy("digest").agg(F.first("text").alias("text")).withColumn("item", F.monotonically_increasing_id()))
    sections = cut_lineage(texts.select("item", "text").mapInArrow(_sections, _SECTIONS))
    blocks = -(-int(sections.agg(F.sum("passages")).first()[0] or 0) // block_passages)
    idf = idf_weights(docs) if blocks else None
    out, some = None, []
    for b in range(blocks):
        block = sections.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b)
        got = block.select("item", "words").collect()
        words = _words_of([bytes(r.words) for r in got])
        known = np.unique(np.concatenate([*words, np.zeros(0, np.int64)]) & (VOCABULARY - 1))
        some.append(spark.sparkContext.broadcast(Items([r.item for r in got], words, known, idf, latent_basis(block, known, idf))))
        if len(some) == PASS_BLOCKS or b == blocks - 1:
            found = cut_lineage(docs.mapInArrow(_search(some), _FOUND))
            for block in some:
                block.destroy()
            out, some = found if out is None else out.unionByName(found), []
    if out is None:
        return spark.createDataFrame([], _FOUND.replace("item long", "item_id long"))
    best = F.max(F.struct("common", "answer", "cosine", (-F.col("word_start")).alias("ahead"), "word_end")).alias("b")
    return (out.groupBy("row", "doc_id", "item").agg(best).join(texts.select("item", "digest"), "item").join(items.select("item_id", "digest"), "digest")
            .select("row", "doc_id", "item_id", "b.cosine", "b.common", "b.answer", (-F.col("b.ahead")).alias("word_start"), "b.word_end"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all columns."""
    rows, row_col = numbered(docs)
    return drop_rows(rows, row_col, leaks(rows, benchmark, id_col=id_col, text_col=text_col, row_col=row_col).select("row").distinct())
