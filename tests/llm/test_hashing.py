import random
import re

import numpy as np
import pytest

from spanforge.llm import hashing
from spanforge.llm.hashing import WordHasher


@pytest.mark.parametrize("piece", [3, 64, 1 << 17])
def test_words_and_hashes(monkeypatch, piece):
    monkeypatch.setattr(hashing, "PIECE", piece)
    rng = random.Random(piece)
    kinds = np.ones(256, np.uint8)
    kinds[list(b" \n\t")] = 0
    kinds[list(b".,!")] = 2
    hasher, seen, back = WordHasher(kinds), {}, {}
    for _ in range(30):
        texts = ["".join(rng.choices("abAB \n\t.,!é", k=rng.choice([0, 1, 5, 200]))).encode() for _ in range(rng.randint(0, 6))] + [b"x" * 500, b" ", b""]
        hashes, kind, sizes = hasher(texts)
        words = [re.findall(rb"[^ \n\t.,!]+|[.,!]+", t.lower()) for t in texts]
        assert sizes.tolist() == [len(w) for w in words]
        for h, k, w in zip(hashes.tolist(), kind.tolist(), [x for some in words for x in some]):
            assert seen.setdefault(w, h) == h and back.setdefault(h, w) == w and k == 1 + (w[:1] in b".,!")
    assert all(len(x) == 0 for x in hasher([]))


def test_case_and_separators():
    fold, keep = WordHasher.of_separators(b" "), WordHasher.of_separators(b" ", fold=False)
    a, b = fold([b"Word word"])[0]
    assert a == b and len(set(keep([b"Word word"])[0].tolist())) == 2
    assert len(np.unique(fold([" ".join(f"w{i}" for i in range(200_000)).encode()])[0])) == 200_000
