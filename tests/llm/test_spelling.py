import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanforge.llm import spelling
from spanforge.llm.queries import op11_spelling_variants
from spanforge.llm.spelling import Index, last_of_chain, spelling_groups


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def neighbours(words):
    """All pairs that are one edit apart, by the strings that one lost letter leaves."""
    left = defaultdict(set)
    for w in words:
        left[w].add(w)
        for i in range(len(w)):
            left[w[:i] + w[i + 1:]].add(w)
    near = {w: set() for w in words}
    for some in left.values():
        for a in some:
            near[a].update(b for b in some if one_edit(a, b))
    return near


def brute(docs, dropped):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if dropped and h % dropped == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], form[w], n.get(form[w]), root, len(near[w])))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.word, r.n, r.form, r.form_n, r.root, r.n_near) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    want = brute(docs, 97)
    assert rows_of(op11_spelling_variants(spark, f"/root/testdata/{sf}")) == want
    assert any(form and root != form for _, _, form, _, root, _ in want)


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_each_near_word_once(seed):
    rng = random.Random(seed)
    letters = "ab" if seed < 2 else "abcdéÿ" + "".join(map(chr, range(500, 500 + 40 * seed)))
    words = sorted({"".join(rng.choices(letters, k=rng.randint(4, 12))) for _ in range(400)} | {"a" * 300, "a" * 301, "b" + "a" * 300, "ab" * 200})
    asks = words[::2] + ["".join(rng.choices(letters + "z", k=rng.randint(4, 12))) for _ in range(200)]
    found = Counter()
    for back in (0, 1):
        turn = (lambda w: w[::-1]) if back else (lambda w: w)
        got = Index([turn(w) for w in words]).near([turn(w) for w in asks], np.array([(len(w) + back) // 2 for w in asks]), bool(back))
        found.update(zip(*(x.tolist() for x in got)))
    assert found == Counter((k, j) for k, a in enumerate(asks) for j, w in enumerate(words) if one_edit(a, w))


def test_spread_keys_and_hostile_rows(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abc", k=rng.randint(4, 9))) for _ in range(300)] + ["hotkeys" + "".join(rng.choices("xyz", k=3)) for _ in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=120)), "x", 0) for i in range(60)]
    docs += [(None, "Hotkeysxyz Hotkeysxyz", "", 1), (None, None, None, None), (70, "", "", 2), (71, "é" * 5 + " Ééééé ÉÉÉÉÉ ééééé×" * 3, "", 1),
             (72, ("q" * 20_000 + " ") * 4 + ("q" * 19_999 + " ") * 9, "", 1), (73, "hotkeysxyz;" * 30_000, "", 1)]
    docs += docs[:7] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, word string, n int").repartition(6)
    want = brute([d[:2] for d in docs], 97)
    assert rows_of(spelling_groups(df, dropped=97)) == want
    assert rows_of(spelling_groups(df, dropped=97, key=2, index_words=50, key_words=10)) == want
    assert rows_of(spelling_groups(df)) == brute([d[:2] for d in docs], None)
    assert spelling_groups(df.limit(0)).collect() == spelling_groups(df.where("doc_id = 70")).collect() == []


def test_small_stores_change_nothing(spark, monkeypatch):
    docs = [(i, "alpha alphas alpha betas " * (i % 4)) for i in range(30)]
    monkeypatch.setattr(spelling, "STORE", 1)
    assert rows_of(spelling_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs, None)


def test_long_chains(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(50)] + [("x", "w3")], "word string, form string")
    assert {r.root for r in last_of_chain(links).collect()} == {"w50"} and last_of_chain(links).count() == 51
