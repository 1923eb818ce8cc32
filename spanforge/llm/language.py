"""Language identification by error-correcting output codes.

Each language has a codeword of bits, and each bit a binary classifier that tells the
languages whose codewords have it set from the others by character n-grams.  Up to seven
languages have all bits that split them differently; more have random bits, of which the
draw with the largest least distance between two codewords is taken.

1. One pass counts hashed n-grams (one to three letters, with the ends of words) per
   language over all labelled rows; tasks send sums of a fixed size.  A bit's classifier
   is the log ratio of an n-gram's smoothed shares in the languages on either side, so
   all bits come from the same counts.
2. A second pass gives each document its margin per bit, the mean over its n-grams.
3. The share of labelled rows of a language that a bit gets right is the weight of that
   bit for that language.  Decoding adds up exp(-margin) of the bits, signed by the
   codeword and so weighted, and takes the language with the least loss; a document whose
   second language is nearly as near is flagged as ambiguous.

Labels are used of rows with an id whose crc32 (as decimal text) is not divisible by five.

Defined cases: a text that is null or has no letter is ``und`` with score 0, so is all
where nothing was learned; with one language all else is that one with score 1; a null id
is neither learned from nor held out; rows without a language are only predicted; repeated
rows are counted and predicted each; texts of any length are read whole, in pieces; of
languages with equal loss the first by name is taken; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanforge.llm.common import added, cut_lineage, in_chunks, named, slices, texts_of

HELD_OUT = 5
UNKNOWN = "und"
FEATURES, CHUNKS = 1 << 15, 32
#: Added to each count; bound of what one n-gram may say.
SMOOTH, MOST = 0.5, 4.0
#: Sharpness of the score, and the share of the second language's loss that the first must save to be clear.
SHARPNESS, CLEAR = 4.0, 0.15
#: Letters that are looked at together.
PIECE = 1 << 18
_MARGINS = "doc_id long, held_out boolean, lang int, letters long, margins array<float>"
_OUT = "doc_id long, held_out boolean, lang_pred string, score double, second string, ambiguous boolean"


def codewords(k: int, *, seed: int = 3, draws: int = 50) -> np.ndarray:
    """One codeword of +1 and -1 per language; all bits differ, also from each other's opposites."""
    if k < 2:
        return np.zeros((k, 0), np.int8)
    if k <= 7:
        bits = (np.arange(1 << (k - 1), (1 << k) - 1)[None, :] >> np.arange(k)[::-1, None]) & 1
        return (2 * bits - 1).astype(np.int8)
    rng, best, least = np.random.default_rng(seed), None, -1
    for _ in range(draws):
        code = np.where(rng.random((k, int(np.ceil(10 * np.log2(k))))) < 0.5, -1, 1)
        code = np.unique(code * code[0], axis=1)
        code = code[:, np.abs(code.sum(axis=0)) < k]
        near = (code.shape[1] - code @ code.T) // 2
        np.fill_diagonal(near, code.shape[1])
        if near.min() > least:
            best, least = code.astype(np.int8), near.min()
    return best


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point itself if it is a letter or a mark on one, else 0."""
    if not _LETTERS:
        kinds = (c if unicodedata.category(chr(c))[0] in "LM" else 0 for c in range(sys.maxunicode + 1))
        _LETTERS.append(np.fromiter(kinds, np.uint32, sys.maxunicode + 1))
    return _LETTERS[0]


def ngrams(texts: list[str]):
    """Pieces (n-gram rows, document of each): of every letter itself, it and the next, and it between its neighbours."""
    table = letters()
    codes = table[np.frombuffer("\0".join(["", *(t.lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.array([len(t.lower()) + 1 for t in texts], dtype=np.int64)
    at = np.flatnonzero(codes)
    doc = np.searchsorted(np.cumsum(sizes), at - 1, "right")
    shift = np.uint32(32 - 15)
    for lo in range(0, len(at), PIECE):
        p, own = at[lo:lo + PIECE], doc[lo:lo + PIECE]
        a, b, c = codes[p - 1], codes[p], codes[p + 1]
        one = b * np.uint32(0x9E3779B1)
        two = (one ^ c * np.uint32(0x85EBCA77)) * np.uint32(0x27D4EB2F)
        three = (one ^ (c + np.uint32(7)) * np.uint32(0xC2B2AE3D) ^ (a + np.uint32(13)) * np.uint32(0x165667B1)) * np.uint32(0x9E3779B1)
        for h in (one * np.uint32(0x85EBCA77), two, three):
            yield (h >> shift).astype(np.int64), own


def _counts(k: int):
    def run(batches):
        counts = np.zeros(k * FEATURES, dtype=np.int64)
        for batch in slices(batches, 100):
            lang = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            for rows, doc in ngrams(texts_of(batch.column(1))):
                counts += np.bincount(lang[doc] * FEATURES + rows, minlength=k * FEATURES)
        if counts.any():
            yield in_chunks(counts, CHUNKS)

    return run


def bit_weights(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each n-gram row and bit the log ratio of its shares on the bit's two sides."""
    shares = (counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * FEATURES)
    out = np.empty((FEATURES, code.shape[1]), np.float32)
    for j, bit in enumerate(code.T):
        out[:, j] = np.clip(np.log(shares[bit > 0].mean(axis=0) / shares[bit < 0].mean(axis=0)), -MOST, MOST)
    return out


def _margins(weights):
    def run(batches):
        w = weights.value
        for batch in slices(batches, 100):
            texts = texts_of(batch.column(3))
            sums, n = np.zeros((len(texts), w.shape[1])), np.zeros(len(texts), dtype=np.int64)
            for rows, doc in ngrams(texts):
                starts = np.flatnonzero(np.diff(doc, prepend=-1))
                own = doc[starts]
                sums[own] += np.add.reduceat(w[rows], starts, axis=0)
                n[own] += np.diff(starts, append=len(doc))
            for k in np.flatnonzero(n):  # marks alone are no letters
                if not any(map(str.isalpha, texts[k])):
                    n[k] = 0
            mean = (sums / np.maximum(n, 1)[:, None]).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * w.shape[1]), pa.array(mean.ravel()))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(n), flat],
                                  names=["doc_id", "held_out", "lang", "letters", "margins"])

    return run


def losses(margins: np.ndarray, code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each row and language the loss over the bits, weighted by how well each tells that language."""
    return np.stack([(np.exp(-margins * word) * w).sum(axis=1) for word, w in zip(code, weights)], axis=1)


def _decoded(names: list[str], code: np.ndarray, weights: np.ndarray, scale: np.ndarray):
    def run(batches):
        for batch in batches:
            for batch in slices([batch], 5000):
                size, k = batch.num_rows, len(names)
                known = np.array(batch.column(3).to_pylist(), dtype=np.int64) > 0
                flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
                loss = losses(np.clip(flat.reshape(size, -1) / scale, -20, 20), code, weights) if k > 1 else np.zeros((size, k))
                order = np.argsort(loss, axis=1, kind="stable")
                cols: list[list] = [[], [], [], []]
                if k:
                    best = order[:, 0]
                    score = 1 / np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True))).sum(axis=1)
                    near = loss[np.arange(size), order[:, min(1, k - 1)]]
                    clear = loss[np.arange(size), best] <= (1 - CLEAR) * near if k > 1 else np.ones(size, bool)
                for r in range(size):
                    got = bool(known[r]) and k > 0
                    for col, v in zip(cols, (names[best[r]], float(score[r]), names[order[r, 1]] if k > 1 else None, not clear[r]) if got
                                      else (UNKNOWN, 0.0, None, False)):
                        col.append(v)
                types = (pa.string(), pa.float64(), pa.string(), pa.bool_())
                yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types))],
                                      names=[f.split()[0] for f in _OUT.split(", ")])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, second, ambiguous.

    What is kept in memory grows with the number of languages only (256 KB each).
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(lang_col).cast("string").alias("name"), named(text_col).cast("string").alias("text"))
    out = held_out(F.col("doc_id"))
    learned = ~out & F.col("doc_id").isNotNull() & F.col("name").isNotNull()
    names = sorted((r.name for r in rows.where(learned).select("name").distinct().collect()), key=str.encode)
    code = codewords(len(names))
    index = F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("name")) - 1
    counts = np.zeros((len(names), FEATURES))
    if len(names) > 1:
        got = added(rows.where(learned & F.col("text").isNotNull()).select(index.cast("int").alias("lang"), "text")
                    .mapInArrow(_counts(len(names)), "task int, chunk int, data binary"), "<i8")
        counts = got.reshape(len(names), FEATURES) if len(got) else counts
    weights = bit_weights(counts, code)
    table = cut_lineage(rows.select("doc_id", out.alias("held_out"), F.when(learned, index).cast("int").alias("lang"), "text")
                        .mapInArrow(_margins(sc.broadcast(weights)), _MARGINS))
    scale, right = np.ones(code.shape[1]), np.ones(code.shape)
    if len(names) > 1:
        margin = [F.get("margins", F.lit(j)) for j in range(code.shape[1])]
        seen = table.where((F.col("letters") > 0) & F.col("lang").isNotNull())
        stats = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.abs(m)).alias(f"m{j}") for j, m in enumerate(margin)),
                                         *(F.avg((m > 0).cast("double")).alias(f"p{j}") for j, m in enumerate(margin))).collect()
        if stats:  # one row per language
            scale = np.maximum(np.array([sum(r[f"m{j}"] for r in stats) for j in range(len(margin))]) / sum(r.n for r in stats), 1e-6)
        for r in stats:
            share = np.array([r[f"p{j}"] for j in range(len(margin))])
            right[r.lang] = np.where(code[r.lang] > 0, share, 1 - share) + 1e-3
    right /= np.maximum(right.sum(axis=1, keepdims=True), 1e-9)
    return table.mapInArrow(_decoded(names, code.astype(np.float64), right, scale), _OUT)
