"""Work that must not grow faster than its rows."""

import re

from pyspark.sql import functions as F

from spanforge.operators.scan import chunk_of, with_running


def test_next_value_is_scanned_once(spark):
    rows = [(k % 3, o, o * 7 % 11 if o % 4 else None) for o, k in enumerate((n * n for n in range(60)))]
    df = spark.createDataFrame(rows, "k bigint, o bigint, v bigint")
    want = {o: next((w for j, p, w in rows if j == k and p > o and w is not None), None) for k, o, v in rows}
    for chunk in (None, chunk_of("o", 8)):
        got = with_running(df, ["k"], ["o"], {"nxt": ("next", F.col("v")), "sum": ("sum", F.col("v"))}, chunk=chunk)
        assert {r["o"]: r["nxt"] for r in got.collect()} == want
        # Spark goes through a frame up to the end anew for every row
        assert "unboundedfollowing$" not in got._jdf.queryExecution().toString()


def test_folders_are_written_by_many_tasks_and_listed_by_few(spark, tmp_path):
    from spanforge.sinks import documents
    from spanforge.sources.events import read_sessions

    frames = spark.range(40).select(F.concat(F.lit("s"), "id").alias("session_key"), F.lit("[").alias("head"), F.lit("]").alias("foot"))
    items = spark.range(40).select(F.concat(F.lit("s"), "id").alias("session_key"), "id", F.lit("1").alias("value"))
    documents.write_documents(documents.document_lines(items, frames, ["id"]), str(tmp_path))
    files = [f.name for f in (tmp_path / "parts").rglob("*.txt")]
    assert len({re.match("part-[0-9]+", f)[0] for f in files}) > 1 and len(files) <= 43
    spark.conf.unset("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    read_sessions(spark, str(tmp_path / "parts"))
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 8 * spark.sparkContext.defaultParallelism


class _State:
    """State of one key, which counts what is asked of it; every kind of state in one."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _call(self, do):
        self.calls += 1
        return do()

    def getMapState(self, *_):
        return self

    getValueState = getMapState
    containsKey = lambda self, k: self._call(lambda: k in self.held)
    getValue = lambda self, k: self._call(lambda: self.held[k])
    updateValue = lambda self, k, v: self._call(lambda: self.held.__setitem__(k, v))
    removeKey = lambda self, k: self._call(lambda: self.held.pop(k, None))
    exists = lambda self: self.containsKey("value")
    get = lambda self: self.getValue("value")
    update = lambda self, v: self.updateValue("value", v)
    clear = lambda self: self.removeKey("value")
    registerTimer = lambda self, ms: self.updateValue(("timer", ms), True)
    deleteTimer = lambda self, ms: self.removeKey(("timer", ms))


def test_queue_asks_the_state_for_its_buffers_only():
    from pyspark.sql import Row
    from spanforge.streaming.stateful import _Queue

    queue, states = _Queue(), [_State() for _ in range(3)]
    queue.flying, queue.pages, queue.last = states
    row = lambda n, commit, cb: Row(session_key="s", queue_id=0, event_ord=n, commit=commit, cb_id=cb, ts_mono_ns=n, queue_depth=n, status=4, error_code=None)
    for batch, want in (([row(0, True, 1), row(1, True, 2), row(2, False, 1)], (1, 1, 2)), ([row(4, False, 2), row(3, True, 3)], (3, 1, 3))):
        for s in states:
            s.calls = 0
        got = list(queue.handleInputRows(("s", 0), iter(batch), None))
        assert [(r["depth"], r["in_flight"], r["oldest_cb_id"]) for r in got] == [want]
        assert sum(s.calls for s in states) <= 11


def test_overdue_asks_the_state_once_a_batch():
    from pyspark.sql import Row
    from spanforge.streaming.stateful import _Overdue

    state, overdue = _State(), _Overdue(limit_ms=5)
    overdue.init(state)
    rows = [Row(session_key="s", cb_id=1, queue_id=0, event_ord=n, commit=n % 2 == 0, ts_wall_ns=n * (9 if n % 3 else 1) * 1_000_000) for n in range(101)]
    out = list(overdue.handleInputRows(("s", 1), iter(rows[::-1]), None))
    assert out and all(r["commit_ord"] % 2 == 0 for r in out)
    assert state.held["value"][0] == 100 and len([k for k in state.held if k[0] == "timer"]) == 1 and state.calls <= 4


def test_stream_processors_ask_the_state_once_an_entry():
    from spanforge.streaming.stateful import _Clamp, _Feed, _Rolling

    def batch(processor, states, rows):
        for s in states:
            s.calls = 0
        out = [tuple(r) for r in processor.handleInputRows(("s",), iter(("s", *r) for r in rows), None)]
        return out, sum(s.calls for s in states)

    feed, top = _Feed(), _State()
    feed.top = top
    top.get = lambda: top._call(lambda: top.held.get("value"))
    assert [r[1:3] for r in batch(feed, [top], [(9, 9, "z"), (1, 1, "a"), (2, 2, "b")])[0]] == [(1, 1), (2, 1), (9, 0), (9, 1)]
    out, calls = batch(feed, [top], [(n, n, "x") for n in range(12, 60)] + [(60, None, "y")])
    assert [r[1:3] for r in out[:2]] == [(12, 0), (12, 1)] and len(out) == 50 and calls <= 2

    clamp = _Clamp()
    clamp.sched, clamp.window, clamp.done = states = [_State() for _ in range(3)]
    step = lambda n, step, raw=0: (n, n, n, step, 1, 0, raw, "[]")
    rounds = [step(3 * n + i, s, raw) for n in range(40) for i, (s, raw) in enumerate(((1, 0), (2, 0), (3, 4)))]
    out, calls = batch(clamp, states, rounds[::-1])
    assert len(out) == 40 and {r[5] for r in out} == {0.25} and calls <= 8
    assert not states[0].held and not states[1].held and states[2].held == {(0,): (118,)}
    batch(clamp, states, [step(200, 1), step(203, 2)])
    assert [r[5] for r in batch(clamp, states, [step(204, 3, 6), step(205, 3, 6)])[0]] == [0.5, None] and not states[1].held

    rolling = _Rolling(10, 2)
    rolling.samples, rolling.newest = states = [_State(), _State()]
    states[0].put, states[1].get = states[0].update, lambda: states[1]._call(lambda: states[1].held.get("value"))
    assert batch(rolling, states, [(1, "a", 50, 1), (20, "b", 2, 1), (12, "c", 2, 1), (12, "d", 9, 2)])[0] == [("s", 20, 1, "d", 9, 2), ("s", 20, 2, "b", 2, 1)]
    out, calls = batch(rolling, states, [(n % 7, "a", 1, 1) for n in range(3000)] + [(25, "b", 8, 1)])
    assert out == [("s", 25, 1, "b", 10, 2)] and calls <= 4


def test_process_table_looks_for_its_header_once(spark):
    from spanforge.queries.functions_q import a7_process_table
    from spanforge.sources.external import parse_process_table

    text = "PID x\r\n  PID COMMAND %CPU \n 7 a  b 1.5\nPID %CPU\n8 c 2\n9 d x\n99999999999 e 1"
    files = spark.createDataFrame([("f", text), ("none", "1 a 2"), ("last", "PID %CPU"), ("null", None), ("empty", "")], "path string, text string")
    out = parse_process_table(files)
    assert [tuple(r) for r in out.orderBy("line_no").collect()] == [("f", 2, 7, "a b", 1.5), ("f", 4, 8, "c", 2.0)]
    over, generate = out._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)
    assert "array_min" not in over
    assert a7_process_table(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_what_is_known_of_each_node_or_point_is_not_broadcast(spark):
    from spanforge.operators.stab import stab_join
    from spanforge.operators.tree import breakdown_trace

    nodes = spark.range(20).select(
        (F.col("id") % 2).alias("session_key"), F.col("id").alias("node_id"), F.lit(None).cast("bigint").alias("parent_call_id"), F.lit("q").alias("qualname"), F.lit("c").alias("class_name"),
        *[F.lit(1).cast("bigint").alias(c) for c in ("calls", "gpu_ns_self", "gpu_ns_subtree", "eval_count", "cb_count", "depth")])
    ops = spark.range(20).select((F.col("id") % 2).alias("session_key"), F.col("id").alias("node_id"), F.lit("o").alias("name"), F.lit(5000).cast("bigint").alias("gpu_ns"), F.lit(1).alias("count"))
    spans = spark.range(20).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"), (F.col("id") + 3).alias("b"))
    hits = stab_join(spans.select("k", F.col("a").alias("t")), spans, by=["k"], ts="t", lo="a", hi="b", prefer=-F.col("a"), keep=["a"], cell=4)
    for df, n in ((breakdown_trace(nodes, ops), 40), (hits, 20)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == n
