import random

import numpy as np
import pytest

from spanforge.llm.tokens import WordIds, public_vocabulary


@pytest.mark.parametrize("literal", [False, True])
def test_ids_equal_the_tokenizers(literal):
    rng = random.Random(5)
    alphabet = "aAéÉ ́İΣςß'.,!<|endoftext|>12٣😀\x1c\x85\xa0 \t\n漢字ﬁÅK-_"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(8000)]
    texts += ["<|endoftext|> x <|ENDOFTEXT|>.", "don't. I'S's", "İ. ﬁ.", "", " "]
    ids = WordIds(public_vocabulary(), literal_specials=literal, limit=10_000)
    for at in range(0, len(texts), 500):
        some = texts[at:at + 500]
        for t, got in zip(some, ids.encode([t.encode() for t in some])):
            assert np.frombuffer(got, "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_a_worker_reads_the_vocabulary_once():
    first = WordIds(public_vocabulary())
    some = first.encode([b"Words of one task."])
    second = WordIds(public_vocabulary())
    assert second.tokenizer is first.tokenizer and second.known is not first.known
    assert WordIds(public_vocabulary(), literal_specials=True).tokenizer is not first.tokenizer
    assert second.encode([b"Words of one task."]) == some
