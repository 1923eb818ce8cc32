"""Documents against brute force, and what writing and reading them may cost."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.queries.catalogue import QUERIES
from spanforge.sinks import documents


def lines_of(spark, sizes, known):
    items = spark.createDataFrame([(k, i, f'{{"n":{i}}}') for k, n in sizes.items() for i in range(n)], "session_key string, i int, value string")
    frames = spark.createDataFrame([(k, '{"list":[', f'],"name":{json.dumps(k)}}}') for k in known], "session_key string, head string, foot string")
    return documents.document_lines(items, frames, ["i"])


def read(spark, path):
    texts = {}
    rows = documents.read_document_lines(spark, str(path)).withColumn("at", F.monotonically_increasing_id()).collect()
    for r in sorted(rows, key=lambda r: (r["session_key"], r["part"], r["at"])):
        texts[r["session_key"]] = texts.get(r["session_key"], "") + r["value"]
    return {k: json.loads(t) for k, t in texts.items()}


@pytest.mark.parametrize("tasks", [1, 3, 7])
def test_documents_of_known_sessions_are_whole(spark, tmp_path, tasks):
    """Long, short and empty sessions, odd names, and unknown sessions before, between, behind and across tasks."""
    sizes = {"!long unknown": 500, "a": 400, "b": 1, 'b/"ü=%[x]:': 7, "c unknown": 900, "d": 333, "e": 2, "~": 40, "\u007f unknown": 300}
    known = [k for k in sizes if "unknown" not in k] + ["empty", "zero"]
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        documents.write_documents(lines_of(spark, sizes, known).repartition(5), str(tmp_path))
        got = read(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: {"list": [{"n": i} for i in range(sizes.get(k, 0))], "name": k} for k in known}
    # Spark finds the same sessions in the folders, and nothing of the unknown ones
    assert {r[0] for r in spark.read.text(str(tmp_path / "parts")).select("session_key").distinct().collect()} == set(known)


def test_a_part_is_one_file_and_is_found_without_listing(spark, tmp_path):
    lines = lines_of(spark, {f"s{i}": 3 for i in range(50)}, [f"s{i}" for i in range(50)])
    # the texts of the items meet nothing; only the heads and feet are joined
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    documents.write_documents(lines, str(tmp_path))
    files = [f for f in (tmp_path / "parts").rglob("*") if f.is_file()]
    assert len(files) == spark.read.json(str(tmp_path / "manifest")).count()
    plan = documents.read_document_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan
    with pytest.raises(FileExistsError):
        documents.write_documents(lines, str(tmp_path))


def test_long_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    documents.write_documents(lines_of(spark, {"a": 300, "b": 2}, ["a", "b"]), str(tmp_path))
    names = [tuple(r) for r in spark.read.json(str(tmp_path / "manifest")).select("session_key", "part", "file").collect()]
    batch = pa.record_batch([pa.array(c) for c in zip(*sorted(names))], names=["session_key", "part", "file"])
    want = sorted(line for f in (tmp_path / "parts").rglob("*.txt") for line in f.read_text().splitlines())
    for block in (1, 7, 100, 1 << 22):
        monkeypatch.setattr(documents, "BLOCK", block)
        got = [v for out in documents._reader(str(tmp_path / "parts"))([batch]) for v in out.column(2).to_pylist()]
        assert sorted(got) == want


@pytest.mark.parametrize("name", ["a8_json_documents", "a9_trace_documents"])
def test_a_line_is_parsed_once(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("try_parse_json") <= 1
    assert df.where("broken <> 0").count() == 0
