import zlib

import numpy as np

from spanforge.llm.quality import Network, drop_low_quality, quality_scores
from spanforge.llm.queries import op10_random_indexing_quality


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op10_random_indexing_quality(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for k, r in rows.items())
    truth = [(rows[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    score, label = np.array([s for s, _ in truth]), np.array([q for _, q in truth])
    right = np.mean((score >= 0.5) == label)
    order = score.argsort().argsort()
    auc = (order[label == 1].sum() - (label == 1).sum() * ((label == 1).sum() - 1) / 2) / ((label == 1).sum() * (label == 0).sum())
    print("accuracy", right, "auc", auc, "recall of 0", np.mean(score[label == 0] < 0.5), "kept of 1", np.mean(score[label == 1] >= 0.5))
    assert right > 0.95 and auc > 0.93


def test_hostile_rows(spark):
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x", 1.0) for i, t in enumerate(
        [None, "", " ", "plain words here", "\x00\x01", "x" * 100_000, "!!! $$$ ###", "plain words here"] * 6)], "doc_id long, text string, row string, score double")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 1), (3, None, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        out = quality_scores(docs, some).collect()
        assert len(out) == 48 and all(0 <= r.score <= 1 for r in out)
    assert drop_low_quality(docs, labels.where("quality = 1")).columns == docs.columns
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))
    y = (rng.random(4000) < p).astype(float)
    got = Network(x, y).predict(x)
    assert np.abs(got - p).mean() < 0.12
