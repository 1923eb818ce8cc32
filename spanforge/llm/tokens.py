"""Token ids of texts, by a public tokenizer, with the ids of recurring words kept."""

from __future__ import annotations

import functools
import os

import numpy as np


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a vocabulary file of the installed public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes that never join a piece that ends in a letter or an ASCII digit before them.
TAIL = b".,;:!?|#$%&*\"()[]{}"


_MARK, _ALNUM, _SPACE = (np.isin(np.arange(256), list(some)) for some in (b".,;:!?", b"0123456789abcdefghijklmnopqrstuvwxyz", b" \t\n\v\f\r"))


def _chunks(texts: list[bytes]) -> list[list[bytes]]:
    """What white space parts in each text, and last marks as chunks of their own.

    A mark that ends a chunk, behind an ASCII letter or digit or a Latin-1 letter, is a piece
    of its own for the tokenizer.  Cut off, it leaves a word that is known more often than
    the two together.
    """
    # the tokenizer lower-cases anyway, but knows its special tokens by their case
    texts = [t if b"<|" in t else t.lower() for t in texts]
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    at = np.flatnonzero(_MARK[data])
    at = at[_SPACE[data[at + 1]]]
    last = data[at - 1]
    latin = (data[at - 2] == 0xC3) & (last >= 0x80) & (last < 0xC0) & (last != 0x97) & (last != 0xB7)
    at = at[_ALNUM[last] | latin]
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    ends += np.searchsorted(at, ends)
    out = np.insert(data, at, 32).tobytes()
    return [out[s:e].split() for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]


@functools.lru_cache(maxsize=1)
def _tokenizers(path: str, literal_specials: bool) -> tuple:
    """The tokenizer, the same for words of a-z alone, and which ids end a word; a worker reads them once, not for each of its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = literal_specials
    # words of a-z alone need neither normalising nor more splitting; the two share one vocabulary in memory
    plain = Tokenizer(tokenizer.model)
    plain.pre_tokenizer = WhitespaceSplit()
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return tokenizer, plain, ends


class WordIds:
    """Ids of whole texts for a tokenizer with word ends that drops white space.

    Such a tokenizer never merges across white space, so a text is the sequence of its
    space-free chunks, and the ids of a chunk can be kept.  ``limit`` chunks are kept at
    most, in two generations: when the newer one is full it becomes the older one, from
    which what recurs moves on; this changes no result.  Chunks are cut at
    the six ASCII white-space bytes only.  Unknown words of letters are encoded many at a
    time: each is one piece, and the ids of a piece end with one that carries the word end.
    """

    def __init__(self, path: str, *, literal_specials: bool = False, limit: int = 300_000):
        self.tokenizer, self.plain, self.ends = _tokenizers(path, literal_specials)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.limit = limit

    def _encode_each(self, chunks: list[bytes]) -> None:
        for at in range(0, len(chunks), 20_000):
            some = chunks[at:at + 20_000]
            for chunk, got in zip(some, self.tokenizer.encode_batch_fast([c.decode() for c in some], add_special_tokens=False)):
                self.known[chunk] = np.array(got.ids, dtype="<u4").tobytes()

    def _encode_words(self, words: list[bytes], tokenizer) -> None:
        """Words of letters, each one piece for the tokenizer."""
        for at in range(0, len(words), 1_000):
            some = words[at:at + 1_000]
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(some).lower().decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                self._encode_each(some)
                continue
            data, start = ids.tobytes(), 0
            for word, end in zip(some, (4 * cuts).tolist()):
                self.known[word] = data[start:end]
                start = end

    def learn(self, chunks: set[bytes]) -> None:
        known = self.known
        new = chunks.difference(known)
        if 2 * (len(known) + len(new)) > self.limit:
            self.older, self.known = known, {}
            known, new = self.known, set(chunks)
        again = new.intersection(self.older)
        known.update(zip(again, map(self.older.__getitem__, again)))
        new -= again
        plain = set(filter(bytes.isalpha, new))  # of ASCII letters alone
        words, parts, others = set(), [], []
        for c in new.difference(plain):
            core = c.rstrip(TAIL)
            if len(core) < len(c) and core and (core[-1:].isalnum() or core.decode().lower()[-1].isalpha()):
                parts.append((c, core, c[len(core):]))
            elif (s := c.decode()).isalpha() and s.lower().isalpha():
                words.add(c)
            else:
                others.append(c)
        pieces = {core for _, core, _ in parts}.union(tail for _, _, tail in parts).difference(known, plain, words, others)
        for c in pieces:
            if (ids := self.older.get(c)) is not None:
                known[c] = ids
            elif c.isalpha():
                plain.add(c)
            elif (s := c.decode()).isalpha() and s.lower().isalpha():
                words.add(c)
            else:
                others.append(c)
        self._encode_words(list(plain), self.plain)
        self._encode_words(list(words), self.tokenizer)
        self._encode_each(others)
        for c, core, tail in parts:
            known[c] = known[core] + known[tail]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = _chunks(texts)
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]
