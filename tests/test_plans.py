"""How often an operator reads the log: the scans in the plans of all that it runs."""

import pytest
from pyspark.sql import functions as F

from spanforge import session_conf
from spanforge.operators import diff, gpu, memory, pairing, sequences, stab, tree
from spanforge.operators.scan import chunk_of
from spanforge.plans import report, rules
from spanforge.queries.catalogue import QUERIES
from spanforge.queries.views import trace_log
from spanforge.sinks import trace

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "the-log")
    trace_log(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def scans(spark, monkeypatch):
    """Counts the scans of the log that a frame needs, tables written for it included."""
    seen = []
    limit = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")

    def plan_of(df):
        return df._jdf.queryExecution().executedPlan().toString().count("/the-log")

    def written(df, **kw):
        seen.append(plan_of(df))
        return session_conf.cut_lineage(df, **kw)

    for module in (gpu, memory, pairing, stab, tree, rules, report, trace):
        if hasattr(module, "cut_lineage"):
            monkeypatch.setattr(module, "cut_lineage", written)

    def count(build):
        seen.clear()
        df = build()
        total = sum(seen) + plan_of(df)
        df.collect()
        return total

    yield count
    spark.conf.set("spark.sql.maxMetadataStringLength", limit)


def test_scans_of_the_log(log, scans):
    chunk = chunk_of("event_ord", 64)
    assert 1 <= scans(lambda: pairing.model_loads(log, chunk=chunk)) <= 2
    assert scans(lambda: memory.scope_heap(log, cell=1 << 40, chunk=chunk)) <= 6
    up, down = F.col("kind") == "MlxEvalEntered", F.col("kind") == "MlxEvalReturned"
    assert scans(lambda: sequences.saturating_depth(log, keys=["session_key"], order="event_ord", up=up, down=down, chunk=chunk)) <= 2
    assert scans(lambda: sequences.islands(log, keys=["session_key"], order="event_ord", ts="ts_mono_ns", keep=up, gap=10**12, chunk=chunk,
                                           aggs=[F.count(F.lit(1)).alias("n")])) <= 2
    assert scans(lambda: pairing.scope_windows(log)) <= 2


def test_scans_of_all_rules(log, scans):
    assert 1 <= scans(lambda: report.analyze(log, cell=1 << 40, chunk=chunk_of("event_ord", 64))) <= 3


def test_scans_of_the_trace_export(log, scans):
    assert 1 <= scans(lambda: trace.trace_rows(log, chunk=chunk_of("event_ord", 64))) <= 4


def test_exploded_spans_are_not_broadcast(spark, tmp_path):
    """Spans cut into tree nodes are many times the table under them, whose size the planner goes by."""
    spark.range(50).selectExpr("id AS k", "id * 3 AS lo", "id * 3 + 900000 AS hi").write.parquet(f"{tmp_path}/spans")
    spark.range(50).selectExpr("id AS k", "id * 1000 AS ts", "id AS v").write.parquet(f"{tmp_path}/points")
    spans, points = spark.read.parquet(f"{tmp_path}/spans"), spark.read.parquet(f"{tmp_path}/points")
    joined = stab.interval_aggregate(spans, points, by=["k"], interval_key=["k"], lo="lo", hi="hi", ts="ts", aggs={"n": ("sum", F.col("v"))}, cell=100, computed=False)
    lines = joined._jdf.queryExecution().executedPlan().toString().splitlines()
    indent = lambda line: len(line) - len(line.lstrip(" +-:"))
    sent = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = lines[i + 1:]
            end = next((j for j, x in enumerate(below) if indent(x) <= indent(line)), len(below))
            sent += [x for x in below[:end] if "Generate" in x and "level" in x]
    assert not sent


@pytest.mark.parametrize("name", ["m4_events_per_second", "a14_snapshot", "a11_folded_stacks"])
def test_tables_by_session_are_not_broadcast(spark, name):
    """A row or more per session grows with the log, so such a table is not sent through the driver."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_the_sides_of_a_pair_read_values_that_are_written_once(spark):
    values = spark.range(8).select(F.concat(F.lit("u"), F.col("id") % 4).alias("session_key"), "id").groupBy("session_key").agg(F.sum("id").alias("n"))
    pairs = spark.createDataFrame([(0, "u0", "u1"), (1, "u2", "u3")], "pair_id bigint, session_a string, session_b string")
    a, b = diff.pair_sides(pairs, values)
    assert "Aggregate" not in a.unionByName(b)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, a.collect())) == [(0, 4), (1, 8)] and sorted(map(tuple, b.collect())) == [(0, 6), (1, 10)]
