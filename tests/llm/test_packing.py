import zlib
from collections import defaultdict

import numpy as np
import pytest

from spanforge.llm.packing import pack, plan
from spanforge.llm.queries import op2_best_fit_packing
from spanforge.llm.tokens import public_vocabulary

SF = "/root/testdata/sf0.001"


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def assert_packed(rows, ids_by_doc, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == ids_by_doc.keys()
    for doc, ids in ids_by_doc.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            part = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_query_against_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = dict(zip((d.doc_id for d in docs), reference_ids([d.text for d in docs])))
    n = assert_packed(op2_best_fit_packing(spark, SF).collect(), ids, 4096)
    assert n <= -(-sum(map(len, ids.values())) // 4096) + 2


def test_hostile_rows(spark):
    texts = {1: None, 2: "", 3: "a " * 50, 4: "\x1c x\x1d́   İΣς 'S can't \U0001F600 <|endoftext|> á", 5: "same", 6: "same", None: "no id"}
    df = spark.createDataFrame([(k, t, "x", 7) for k, t in texts.items()], "doc_id long, text string, length string, task int").repartition(3)
    out = pack(df, capacity=16)
    ids = dict(zip(texts, reference_ids(texts.values())))
    assert_packed(out.collect(), ids, 16)
    assert out.count() == sum(-(-len(i) // 16) for i in ids.values())
    assert pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 300)))
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    rooms = []  # best fit, one piece at a time
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    used = defaultdict(set)
    for n, lines in plan(counts, capacity).items():
        for k, (lo, first, per, at) in enumerate(lines):
            end = lines[k + 1][0] if k + 1 < len(lines) else counts[n]
            for i in range(end - lo):
                cells = set(range(at + i % per * n, at + i % per * n + n))
                assert not cells & used[first + i // per]
                used[first + i // per] |= cells
    assert all(c == set(range(len(c))) and len(c) <= capacity for c in used.values())
    assert len(used) == len(rooms)
