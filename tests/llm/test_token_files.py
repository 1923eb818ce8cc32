import numpy as np

from spanforge.llm.queries import op5_separator_scan
from spanforge.llm.token_files import document_token_counts, token_counts
from spanforge.llm.tokens import public_vocabulary


def n_tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_vocabulary())
    t.encode_special_tokens = True
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in op5_separator_scan(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip((d.doc_id for d in docs), n_tokens([d.text for d in docs])))


def test_blocks_of_any_size(spark, tmp_path):
    rng = np.random.default_rng(2)
    want, names = [], []
    for f in range(4):
        ids = rng.integers(0, 40, 3000).astype("<u4")
        ids[rng.random(3000) < [0.5, 0.01, 0.001, 0][f]] = 99
        names.append((f"file:{tmp_path}/t{f}.bin",))
        ids.tofile(f"{tmp_path}/t{f}.bin")
        at = [-1, *np.flatnonzero(ids == 99).tolist()]
        want += [(names[-1][0], k, b - a - 1, True) for k, (a, b) in enumerate(zip(at, at[1:]))]
        if at[-1] < 2999:
            want.append((names[-1][0], len(at) - 1, 2999 - at[-1], False))
    files = spark.createDataFrame(names, "file string")
    for size in (7, 500, 4000):
        got = token_counts(files, end_id=99, dtype="<u4", block_tokens=size).collect()
        assert sorted(map(tuple, got)) == sorted(want), size


def test_hostile_rows(spark):
    texts = [None, "", "<|endoftext|> a <|startoftext|>", "b " * 9000, "same", "same"]
    df = spark.createDataFrame([(i if i else None, t, "f", 1) for i, t in enumerate(texts)], "doc_id long, text string, file string, position int").repartition(3)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in document_token_counts(spark, df, block_tokens=1000).collect())
    assert got == list(enumerate(n_tokens(texts)))
    assert document_token_counts(spark, df.limit(0)).count() == 0
