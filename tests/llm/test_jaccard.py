import random
from collections import defaultdict

import numpy as np
import pytest

from spanforge.llm.components import components
from spanforge.llm.jaccard import RTree, drop_similar, similar_components
from spanforge.llm.queries import op3_count_vector_join


def brute(texts):
    """id: (set size, smallest id reachable), by all pairs that share a shingle."""
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    by = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by[x].append(k)
    label = {k: k for k in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    seen = set()
    for ks in by.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1:]:
                if (a, b) not in seen and find(a) != find(b):
                    seen.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                        x, y = find(a), find(b)
                        label[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_against_all_pairs(spark, sf):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op3_count_vector_join(spark, f"/root/testdata/{sf}").collect()} == brute(docs)


def test_near_copies_common_passages_and_hostile_rows(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    base = rng.choices(words, k=120)
    texts = {}
    for i in range(260):  # around one text, at the threshold
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = f"e{rng.random()}"
        texts[i] = " ".join(t)
    for i in range(260, 460):  # mostly one passage
        texts[i] = " ".join(passage + rng.choices(words, k=rng.randint(0, 40)))
    texts |= {460: None, 461: "", 462: " \t\n", 463: "One two", 464: "one  TWO", 465: "one two three four five", 466: "é" * 9,
              467: "loner " * 30000, 468: texts[0].upper(), 469: texts[0]}
    df = spark.createDataFrame([(k, t, k, "n") for k, t in texts.items()], "doc_id long, text string, rep long, n string").repartition(5)
    want = brute(texts)
    for kw in ({}, {"tile_bytes": 20_000, "sketch_bits": 12}):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(df, **kw).collect()}
        assert got == want
    kept = drop_similar(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
    twice = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, similar_components(twice).select("doc_id", "component_id").collect())) == sorted(
        ["Row(doc_id=None, component_id=3)"] * 2 + ["Row(doc_id=3, component_id=3)", "Row(doc_id=None, component_id=None)"])
    assert similar_components(df.limit(0)).count() == 0


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(4)
    base = rng.poisson(3, (40, 64))
    v = np.concatenate([np.maximum(0, base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.2)) for _ in range(8)]).astype(np.int32)
    sizes = v.sum(axis=1)
    tree = RTree(v, sizes)
    for i in range(0, len(v), 7):
        bound = np.minimum(v, v[i]).sum(axis=1)
        want = np.flatnonzero((180 * bound >= 80 * (sizes + sizes[i])) & (100 * np.minimum(sizes, sizes[i]) >= 80 * np.maximum(sizes, sizes[i])))
        assert sorted(tree.search(v[i], int(sizes[i]), 80)) == want.tolist()


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 120)]
    random.Random(1).shuffle(path)
    edges = path + [(1000, 1001 + i) for i in range(200)] + [(5000, 5000), (6001, 6000)]
    for last in (1 << 20, 0, 40):
        got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6), last).collect()}
        assert len({got[i] for i in range(121)}) == 1 and len({got[1000 + i] for i in range(201)}) == 1
        assert got[6000] == got[6001] and len(set(got.values())) == 3
