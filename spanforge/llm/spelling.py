"""Spelling variants: words one edit apart, found by FM-indexes over the vocabulary.

A word and a near word (one letter more, less or another) agree in the first half of the
word or in the rest of it.  So a search scheme of two searches is whole: match the first
half exactly and go on to the end with one edit, or match the last half exactly and go
back to the start with one.  Each direction has its index over the delimited vocabulary;
a step by a letter takes an interval of suffix ranks to another one, and a word is found
where the interval holds a delimiter.  An edit within a run of equal letters is made at
one place of the run only, and the second search leaves out what the first one finds, so
every near word is found once and can be counted without listing pairs.

The vocabulary is counted by tasks, then by Spark.  Its words are dealt to indexes of a
bounded size by the first letters of the half that must agree, at most ``KEY`` of them.
The words of a key that is too frequent are spread over several indexes, and its searches
go to all of these.  A search returns how many near words it found and the best of them.
Each word points at its best near word if that is frequent enough; as that is always a
more frequent word, there are no circles, and the last word of each chain is found by
pointer doubling.

Defined cases: null and empty texts have no words; the id only matters where letters are
dropped by it, and a null id is then an empty text; repeated rows count each; runs and
texts of any length are whole words, however long; among near words of one frequency the
first in code-point order is taken; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanforge.llm.common import bytes_of, cut_lineage, id_and_text, slices

RUN = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A near word must be so many times as frequent to be a word's form.
TIMES = 2
#: Letters of a half that decide on the index; words in an index, about; words of one key in it, at most.
KEY, INDEX_WORDS, KEY_WORDS = 4, 40_000, 20_000
#: Distinct words that a task holds before it hands them on.
STORE = 200_000
_FOUND = "word string, n_near long, best_n long, best string"


# -- vocabulary

def _words(dropped: int | None, least: int):
    find = re.compile(RUN).findall

    def run(batches):
        store: dict[str, int] = {}

        def rows():
            return pa.record_batch([pa.array(list(store), pa.string()), pa.array(list(store.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches, 200):
            for doc_id, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(find(text.lower().decode())).items():  # of bytes, lower() changes A-Z only
                    if dropped:
                        h = zlib.crc32(word.encode(), start)
                        if not h % dropped:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                    if len(word) >= least:
                        store[word] = store.get(word, 0) + n
            if len(store) >= STORE:
                yield rows()
                store.clear()
        if store:
            yield rows()

    return run


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dropped: int | None = None,
               least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters, A-Z in lower case, that are long and frequent enough.

    With ``dropped``, a run whose crc32 after ``<doc_id>:`` it divides loses the letter at
    that crc32 modulo its length, in all its places in that document.
    """
    parts = id_and_text(docs, id_col, text_col).mapInArrow(_words(dropped, least_length), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# -- one index

def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64),
            np.fromiter(map(len, words), np.int64, len(words)))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of all half-open ranges, and the range of each."""
    n = hi - lo
    of = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


class Index:
    """FM-index over words, each between delimiters, for extending matches forwards."""

    def __init__(self, words: list[str]):
        # steps prepend to a match, so the text has the words backwards
        codes, sizes = _flat([w[::-1] for w in words])
        self.alphabet, codes = np.unique(codes, return_inverse=True)
        ends = np.cumsum(sizes + 1)
        text = np.zeros(int(sizes.sum()) + len(words) + 1, np.int64)
        places, _ = _ranges(ends - sizes, ends)
        text[places] = codes + 1
        self.size, self.words = len(text), len(words)
        order = self._sorted(text, len(self.alphabet) + 1)
        self.before = text[order - 1]  # the letter before each suffix; at 0 that is the last delimiter
        rows = np.argsort(self.before, kind="stable")
        self.steps = self.before[rows] * (self.size + 1) + rows
        self.whole = rows[:len(words) + 1]  # suffixes with a delimiter before them: whole words
        self.word = (np.cumsum(text == 0) - 1)[order[self.whole]]

    @staticmethod
    def _sorted(text: np.ndarray, symbols: int) -> np.ndarray:
        """Places of the suffixes in order; delimiters differ and go by place."""
        size, bits = len(text), max(1, int(symbols - 1).bit_length())
        width = 62 // bits
        key, inner = np.zeros(size, np.int64), np.ones(size, bool)
        for k in range(width):
            here = np.zeros(size, np.int64)
            here[:size - k if k else size] = text[k:]
            inner &= here > 0
            key = key << bits | np.where(inner, here, 0)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | ~inner[order][1:]])
        rank, at = np.empty(size, np.int64), np.arange(size)
        rank[order] = np.maximum.accumulate(np.where(first, at, 0))
        while True:
            alone = first & np.concatenate([first[1:], [True]])
            slots = np.flatnonzero(~alone)
            if not len(slots):
                return order
            some = order[slots]
            key = rank[some] * size + rank[some + width]
            by = np.argsort(key, kind="stable")
            order[slots], key = some[by], key[by]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first[slots] = new
            rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
            width *= 2

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank to which a rank goes by a letter."""
        return np.searchsorted(self.steps, symbol * (self.size + 1) + at)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Letters as the index has them; unknown ones are one more than all."""
        at = np.searchsorted(self.alphabet, codes)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == codes[known]
        return np.where(known, at + 1, len(self.alphabet) + 1)

    def letters(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The letters that can follow in each interval, and the interval of each."""
        many = len(self.alphabet)
        few = np.flatnonzero(hi - lo <= many)
        rows, of = _ranges(lo[few], hi[few])
        key = np.unique(few[of] * (many + 1) + self.before[rows])
        key = key[key % (many + 1) > 0]
        wide = np.flatnonzero(hi - lo > many)
        return (np.concatenate([key % (many + 1), np.tile(np.arange(1, many + 1), len(wide))]),
                np.concatenate([key // (many + 1), np.repeat(wide, many)]))

    def near(self, queries: list[str], exact: np.ndarray, rest_differs: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for each word that is one edit from a query, behind its first ``exact`` letters.

        With ``rest_differs`` not where the edit can also be made before the end of these,
        so that the letters behind them agree.
        """
        codes, sizes = _flat(queries)
        codes = self.symbols(codes)
        starts = np.cumsum(sizes) - sizes
        # where the run of equal letters begins, within the word
        fresh = np.ones(len(codes), bool)
        fresh[1:] = codes[1:] != codes[:-1]
        fresh[starts] = True
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(codes)), 0))
        q, lo, hi = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.full(len(queries), self.words + 1)
        open_ = []  # (query, next letter, lo, hi) after the edit
        i = 0
        while len(q):
            behind = np.flatnonzero(exact[q] <= i)
            open_ += self._edits(codes, starts, sizes, run, exact, q[behind], i, lo[behind], hi[behind], rest_differs)
            q, lo, hi = (x[sizes[q] > i] for x in (q, lo, hi))
            letter = codes[starts[q] + i]
            lo, hi = self.step(letter, lo), self.step(letter, hi)
            q, lo, hi = (x[hi > lo] for x in (q, lo, hi))
            i += 1
        if not open_:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, at, lo, hi = (np.concatenate(x) for x in zip(*open_))
        found = []
        while len(q):
            done = at == sizes[q]
            k = np.searchsorted(self.whole, lo[done])
            k = np.minimum(k, len(self.whole) - 1)
            hit = (self.whole[k] >= lo[done]) & (self.whole[k] < hi[done])
            found.append((q[done][hit], self.word[k[hit]]))
            q, at, lo, hi = (x[~done] for x in (q, at, lo, hi))
            letter = codes[starts[q] + at]
            lo, hi, at = self.step(letter, lo), self.step(letter, hi), at + 1
            q, at, lo, hi = (x[hi > lo] for x in (q, at, lo, hi))
        got, word = (np.concatenate(x) for x in zip(*found))
        return got, word

    def _edits(self, codes, starts, sizes, run, exact, q, i, lo, hi, rest_differs):
        """States after each edit before or at letter ``i`` of the queries."""
        if not len(q):
            return []
        none = len(self.alphabet) + 2
        size, place = sizes[q], starts[q] + i
        last = len(codes) - 1
        here = np.where(i < size, codes[np.minimum(place, last)], none)
        after = np.where(i + 1 < size, codes[np.minimum(place + 1, last)], none)
        less = (here != none) & (here != after)
        if rest_differs:
            less &= run[np.minimum(place, last)] - starts[q] >= exact[q]
        out = [(q[less], np.full(int(less.sum()), i + 1), lo[less], hi[less])]
        letter, of = self.letters(lo, hi)
        other = letter != here[of]
        letter, of = letter[other], of[other]
        lo, hi = self.step(letter, lo[of]), self.step(letter, hi[of])
        q, here = q[of], here[of]
        swap = (here != none) & (hi > lo)
        out.append((q[swap], np.full(int(swap.sum()), i + 1), lo[swap], hi[swap]))
        more = hi > lo
        if rest_differs:
            ahead = np.maximum(starts[q] + i - 1, 0)
            more &= (i > exact[q]) & ((codes[ahead] != letter) | (run[ahead] - starts[q] > exact[q]))
        out.append((q[more], np.full(int(more.sum()), i), lo[more], hi[more]))
        return out


# -- all words

def _search(key: tuple, rows: pa.Table) -> pa.Table:
    """What the searches of one index find: for each word the number of near words and the best one."""
    back = bool(key[0].as_py())
    own: dict[str, list] = {}  # a word may have come by two keys
    for word, n, asks, indexed in zip(*(rows.column(c).to_pylist() for c in ("word", "n", "asks", "indexed"))):
        known = own.setdefault(word, [n, False, False])
        known[1] |= asks
        known[2] |= indexed
    words = sorted(own)
    n, asks, into = (np.array([own[w][k] for w in words], np.int64) for k in range(3))
    turn = (lambda w: w[::-1]) if back else (lambda w: w)
    asks, into = np.flatnonzero(asks), np.flatnonzero(into)  # both in code-point order
    got, word = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(into) and len(asks):
        exact = np.array([(len(words[k]) + back) // 2 for k in asks])
        got, word = Index([turn(words[k]) for k in into]).near([turn(words[k]) for k in asks], exact, back)
        got, word = asks[got], into[word]
    order = np.lexsort((word, -n[word], got))
    got, word = got[order], word[order]
    first = np.flatnonzero(np.diff(got, prepend=-1))
    best = word[first]
    return pa.table({"word": pa.array([words[k] for k in got[first]], pa.string()), "n_near": pa.array(np.diff(first, append=len(got)), pa.int64()),
                     "best_n": pa.array(n[best], pa.int64()), "best": pa.array([words[k] for k in best], pa.string())})


def near_words(words: DataFrame, *, key: int = KEY, index_words: int = INDEX_WORDS, key_words: int = KEY_WORDS) -> DataFrame:
    """word, n_near, best_n, best of all words (word, n) that have near words."""
    size = F.length("word")
    roles = []
    for back in (0, 1):
        text = F.reverse("word") if back else F.col("word")
        # of a word one letter shorter, as long, or one letter longer
        halves = [F.least(F.floor((size + d + back) / 2).cast("int"), F.lit(key)) for d in (-1, 0, 1)]
        roles.append(F.transform(F.array_distinct(F.array(*halves)), lambda h: F.struct(
            F.lit(back).alias("back"), F.substring(text, F.lit(1), h).alias("key"), (h == halves[1]).alias("asks"))))
    roles = words.select("word", "n", F.inline(F.concat(*roles)))
    hot = (roles.groupBy("back", "key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > key_words)
           .select("back", "key", F.ceil(F.col("rows") / key_words).cast("int").alias("parts")))
    indexes = max(1, -(-2 * words.count() // index_words))
    parts = F.coalesce("parts", F.lit(1))

    def place(part):
        return F.pmod(F.xxhash64("back", "key", part), F.lit(indexes)).cast("int")

    own = place(F.pmod(F.xxhash64("word"), parts).cast("int"))
    every = F.transform(F.sequence(F.lit(0), parts - 1), place)
    dealt = (roles.join(hot, ["back", "key"], "left").withColumn("own", own)
             .select("word", "n", "back", "asks", "own", F.explode(F.when(F.col("asks"), F.array_union(F.array("own"), every)).otherwise(F.array("own"))).alias("index"))
             .select("back", "index", "word", "n", "asks", (F.col("index") == F.col("own")).alias("indexed")))
    found = dealt.repartition(2 * indexes, "back", "index").groupBy("back", "index").applyInArrow(_search, _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best")))


def last_of_chain(links: DataFrame) -> DataFrame:
    """word, root: where the links (word, form) lead in the end.  A chain of k links takes log2(k) joins."""
    at = cut_lineage(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not at.where("moved").isEmpty():
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut_lineage(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return at.select("word", "root")


def spelling_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dropped: int | None = None, least_length: int = LEAST_LENGTH,
                    least_count: int = LEAST_COUNT, times: float = TIMES, key: int = KEY, index_words: int = INDEX_WORDS, key_words: int = KEY_WORDS) -> DataFrame:
    """One row per word: word, n, form, form_n, root, n_near."""
    if least_length < 2:
        raise ValueError("a word of one letter has no half to match")
    words = cut_lineage(vocabulary(docs, id_col=id_col, text_col=text_col, dropped=dropped, least_length=least_length, least_count=least_count))
    near = near_words(words, key=key, index_words=index_words, key_words=key_words)
    enough = F.col("best_n") >= times * F.col("n")
    table = cut_lineage(words.join(near, "word", "left").select("word", "n", F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"),
                                                                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))
    roots = last_of_chain(table.where(F.col("form").isNotNull()))
    return table.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
