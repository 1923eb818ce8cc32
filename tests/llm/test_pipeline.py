import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
from spanforge.llm import jaccard
from spanforge.llm.common import numbered
from spanforge.llm.components import components
from spanforge.llm.quality import quality_scores

from test_decontaminate import words
from test_jaccard import brute as brute_components
from test_packing import assert_packed, reference_ids

SF = "/root/testdata/sf0.001"


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [b" " + b" ".join(words(i.text)) + b" " for i in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before = {d.doc_id: d.text for d in docs.collect()}
        if name == "packing":
            ids = dict(zip(before, reference_ids(before.values())))
            assert_packed(out.collect(), ids, 4096)
            return
        assert out.columns == docs.columns
        rows = {d.doc_id: d for d in out.collect()}
        assert all(rows[d.doc_id] == d for d in docs.collect() if d.doc_id in rows)
        if name == "quality":
            scores = quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            want = {r.doc_id for r in scores if r.predicted}
        elif name == "exact_dedup":
            best = defaultdict(int)
            for k, t in before.items():
                best[lower(t)] = max(best[lower(t)], k)
            want = set(best.values())
        elif name == "near_dedup":
            want = {c for _, c in brute_components(before).values()}
        else:
            want = {k for k, t in before.items() if not any(i in b" " + b" ".join(words(t)) + b" " for i in items)}
        assert set(rows) == want, name
        docs = out


def test_hostile_rows_pass_every_stage(spark, tmp_path):
    rows = [(None, None, "x", 1), (None, None, "x", 1), (1, "", None, None), (2, "a b c d e f " * 3000, "x", 2), (2, "a b c d e f " * 3000, "x", 2),
            (3, "one two three four five six", "x", 3), (4, "ONE two three four five six", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, score int")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, some, SF).write.parquet(path := f"{tmp_path}/{name}-{some is docs}")
            out = spark.read.parquet(path)
            assert name == "packing" or out.columns == docs.columns


def test_numbers_stay_when_a_scan_is_split_otherwise(spark, tmp_path):
    spark.range(4000).selectExpr("id AS doc_id", "repeat(sha2(string(id), 256), 20) AS text").repartition(8).write.parquet(str(tmp_path / "docs"))
    rows, name = numbered(spark.read.parquet(str(tmp_path / "docs")))
    got = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("16k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got.append(sorted(map(tuple, rows.select("doc_id", name).collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got[0] == got[1] and len({n for _, n in got[0]}) == 4000


def test_a_worker_of_the_stages_holds_no_pandas():
    names = "quality", "exact_dedup", "jaccard", "components", "decontaminate", "packing", "tokens", "hashing", "shingles"
    code = "import sys, pyspark.worker, " + ", ".join(f"spanforge.llm.{n}" for n in names) + "; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2]).returncode == 0


def test_a_task_of_the_components_has_one_python_worker(spark, monkeypatch):
    plans = []

    def seen(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges)

    monkeypatch.setattr(jaccard, "components", seen)
    jaccard.similar_components(spark.read.parquet(f"{SF}/documents.parquet")).count()
    assert len(plans) == 2 and not any("InArrow" in p for p in plans)
