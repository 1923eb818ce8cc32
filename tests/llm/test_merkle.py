import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spanforge.llm import merkle
from spanforge.llm.queries import op13_merkle_manifest

COLUMNS = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root, and for each node its (before, after) level by level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(places):
            lo = at - at % 16
            paths[k].append(("".join(nodes[lo:at]), "".join(nodes[at + 1:lo + 16])))
        nodes = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
        places = [p // 16 for p in places]
    return nodes[0], paths


def brute(rows):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = tree([leaf(r, r["text"]) for r in groups[s]])
    root, over = tree([trees[s][0] for s in order]) if order else (None, [])
    for s, up in zip(order, over):
        for r, path in zip(groups[s], trees[s][1]):
            text = r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = text.translate(str.maketrans(merkle.UPPER, merkle.LOWER))
            whole, folded = path + up, leaf(r, text)
            for before, after in whole:
                folded = h(before, folded, after)
            out.append((r["doc_id"], leaf(r, r["text"]), trees[s][0], root, h(*(x for p in whole for x in p)), folded, folded == root))
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in df.collect()), key=str)


def changed_manifest(docs):
    return merkle.manifest(docs, changed=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                           altered=F.translate("text", merkle.UPPER, merkle.LOWER))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    got = rows_of(op13_merkle_manifest(spark, f"/root/testdata/{sf}"))
    assert got == sorted(brute(docs), key=str)
    assert 0 < sum(not r[-1] for r in got) < len(got) // 3


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, pos long, grp int"


def hostile():
    rng = random.Random(5)
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (1, "-", None, "-", None), (1, "-", None, "-", None), (1, "A", "en", "é", 3),
            (1, "a", "en", "é", 3), (5, "X" * 300_000, "en", "~", 1), (None, "Same", "en", None, 4), *[(9, "Copy", "en", "hot", 4)] * 40]
    return rows + [(i, f"Text {i}", "en", rng.choice(["hot", "hot", "b", None, *map(str, range(40))]), i) for i in range(900)]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_hostile_rows_and_blocks_of_any_depth(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16 ** levels)
    rows = hostile()
    df = spark.createDataFrame([(*r, "x", "y", 0, 1) for r in rows], SCHEMA).repartition(5)
    want = brute([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows])
    assert rows_of(changed_manifest(df)) == sorted(want, key=str)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(7, "One", "en", None, 3, "", "", 0, 0)], SCHEMA)
    assert changed_manifest(df.limit(0)).collect() == []
    assert rows_of(merkle.manifest(df)) == [(7, *[leaf({"doc_id": 7, "source": None, "lang": "en", "n_chars": 3}, "One")] * 3, h(""),
                                             leaf({"doc_id": 7, "source": None, "lang": "en", "n_chars": 3}, "One"), True)]
