import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from spanforge.llm import golomb
from spanforge.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from spanforge.llm.queries import op6_exact_dedup


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 50000])
def test_codes_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (n + 1, 2**20 + n, 2**48, 2**62):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert (golomb.decode(golomb.encode(values)) == values).all()
    spread = np.unique(rng.integers(0, 2**48, 5000, dtype=np.uint64))
    assert len(golomb.encode(spread)) < 5000 * 5


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    groups = defaultdict(list)
    for d in docs:
        groups[lower(d.text)].append(d.doc_id)
    for r in op6_exact_dedup(spark, "/root/testdata/sf0.001").collect():
        t = lower(next(d.text for d in docs if d.doc_id == r.doc_id))
        ids = groups[t]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), r.doc_id == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_hostile_rows_and_chance_hits(spark):
    rng = random.Random(4)
    texts = [None, "", "A", "a", "Ä", "ä", "x" * 100_000, "hot"] * 3 + [f"t{rng.randrange(60)}" for _ in range(200)] + ["HOT"] * 150
    rows = [(i if i % 7 else None, t, i, "k") for i, t in enumerate(texts)] + [(5, texts[5], 5, "k")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, kept string").repartition(5)
    groups = defaultdict(list)
    for k, t, _, _ in rows:
        groups[lower(t)].append(k)
    for bits in (48, 6):  # six bits: nearly every fingerprint is shared by chance
        out = exact_duplicates(df, owners=3, bits=bits).collect()
        assert len(out) == len(rows)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in out:
            ids = by_sha[r.text_sha256]
            known = [i for i in ids if i is not None]
            assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
            assert not r.kept or r.doc_id == r.keep_id
        assert sum(r.kept for r in out) == len(groups)
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns and sorted(map(lower, (r.text for r in kept.collect()))) == sorted(groups)
    assert exact_duplicates(df.limit(0)).count() == 0
