import random
import re

import pytest

from spanforge.llm.decontaminate import _masks, common_words, drop_leaks, leaks
from spanforge.llm.queries import op4_latent_decontamination


def words(t):
    return re.findall(rb"[^\x00-/:-@\[-`{-~]+", (t or "").encode().lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + 1 if x == y else 0)
    return row[-1]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_finds_all_whole_items_and_no_clean_document(spark, sf):
    docs = {d.doc_id: b" " + b" ".join(words(d.text)) + b" " for d in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    items = {i.item_id: b" ".join(words(i.text)) for i in spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet").collect()}
    want = {(d, i) for i, t in items.items() for d, x in docs.items() if b" " + t + b" " in x}
    got = {(r.doc_id, r.item_id) for r in op4_latent_decontamination(spark, f"/root/testdata/{sf}").collect()}
    print(len(want), len(got))
    assert want <= got and len(got - want) <= 0.02 * len(want)


def test_paraphrases_and_hostile_rows(spark):
    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(3000)]
    text = lambda n: rng.choices(vocab, k=n)
    items = {i: text(rng.randint(15, 60)) for i in range(40)}
    docs, want = {}, set()
    for i in range(40):
        t = items[i]
        part = [w for k, w in enumerate(t) if k % 6 or k > len(t) * 2 // 3]  # a paraphrase with its answer
        docs[i] = " ".join(text(200) + (t if i % 2 else part) + text(150))
        want.add((i, i))
    for i in range(40, 80):  # the same words, but in another order: clean
        docs[i] = " ".join(text(100) + rng.sample(items[i - 40], len(items[i - 40])) + text(50))
    rows = [(k, t, "x") for k, t in docs.items()] + [(None, None, None), (100, "", ""), (101, "word1 " * 20000, ""), (None, " ".join(items[3]), "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()] + [(None, None), (77, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(df, bench).collect()}
    assert got == want | {(None, 3)}
    assert {(r.doc_id, r.item_id) for r in leaks(df, bench, block_passages=80).collect()} == got
    kept = drop_leaks(df, bench)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, range(40, 80)), "None", "100", "101"])
    assert leaks(df.limit(0), bench).count() == leaks(df, bench.limit(0)).count() == 0


def test_common_words_against_dynamic_programming():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(1, 70))] for _ in range(2))
        assert common_words(_masks(a), len(a), b) == lcs(a, b)


def test_replaced_words_and_short_items(spark):
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(3000)]
    items = {i: rng.sample(vocab, rng.randint(24, 60)) for i in range(60)}
    items |= {60 + i: [f"brief{i}x{k}" for k in range(2 + i % 13)] for i in range(26)}
    docs = {}
    for i, t in items.items():
        part = list(t)
        if i < 60:  # three in ten words are new ones, which weigh more than any other; the answer stays
            for k in rng.sample(range(len(t) - len(t) // 4), len(t) * 3 // 10):
                part[k] = f"new{i}x{k}"
        docs[i] = " ".join(rng.choices(vocab, k=100 + i) + part + rng.choices(vocab, k=80))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(df, bench).collect()} == {(i, i) for i in items}
