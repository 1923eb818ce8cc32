"""Typed operators on hand-built logs."""

import pytest
from pyspark.sql import functions as F

from logs import Log, frame
from spanforge.operators import gpu, incidents, live, memory, pairing, reports, tree
from spanforge.operators.scan import chunk_of
from spanforge.plans import report, rules

MS = 1_000_000
S = 1000 * MS
FRAME = [dict(filename="/x/run.py", lineno=12, funcname="f")]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def log(spark):
    a = Log("a")
    a.enter(0, 1, "outer").enter(10, 2, "inner", parent=1, fields={"step": ("int", "2")})
    a.eval(20, 60, 7, stack=[1, 2], frames=FRAME)
    # commit inside the eval, window 40 but ops sum 80: clamped by half
    a.commit(50, 5).sched(100, 5).done(140, 5).ops(141, 5, ("p1", "gemm_x", 61, 2), ("p2", None, 19, 1))
    a.leave(200, 2)
    # recycled id, no eval: innermost scope in its tail still shadows the outer
    a.commit(300, 5).done(400, 5).ops(401, 5, ("p3", "vv_Addf", 10, 1))
    # an orphan return changes nothing; a buffer without ops adds no time
    a.leave(420, 99).commit(430, 6).done(440, 6)
    a.leave(500, 1)
    # outside every window: after the grace of both scopes
    a.commit(2 * S, 8).done(2 * S + 5, 8).ops(2 * S + 6, 8, ("p4", None, 7, 1))
    b = Log("b")  # no ops at all: time in flight counts; a re-commit replaces the first
    b.enter(0, 1, "solo").commit(1, 3).commit(5, 3).done(9, 3, in_flight=44).done(10, 3, in_flight=1000)
    c = Log("c")  # unknown parent drops the subtree; lazy eval leaves GPU time unscoped
    c.enter(0, 1, "root").enter(1, 2, "lost", parent=77).enter(2, 3, "below", parent=2)
    c.eval(10, 20, 1).commit(15, 1).done(30, 1, in_flight=500)
    return frame(spark, a, b, c).cache()


@pytest.fixture(scope="module", params=[None, 3])
def breakdown(request, log):
    return report.Breakdown(log, chunk=None if request.param is None else chunk_of("event_ord", request.param))


def test_breakdown_attribution(breakdown):
    got = rows(breakdown.totals, "session_key", "qualname", "gpu_ns_self", "eval_count", "cb_count")
    assert got == [
        ("a", "<unscoped>", 7, 0, 1), ("a", "inner", 39 + 10, 1, 3), ("a", "outer", 0, 0, 0),
        ("b", "solo", 44, 0, 1),
        ("c", "<unscoped>", 500, 1, 1), ("c", "below", 0, 0, 0), ("c", "lost", 0, 0, 0), ("c", "root", 0, 0, 0)]
    d = {r["session_key"]: r for r in breakdown.diagnostics().collect()}
    assert (d["a"]["malformed_returns"], d["a"]["cbs_op_time_clamped"], d["a"]["ops_cbs_without_samples"],
            d["a"]["unmatched_cb_count"], d["a"]["cbs_scope_attributed"]) == (1, 1, 1, 1, 2)
    assert d["c"]["unscoped_gpu_ns"] == 500 and d["c"]["unmatched_cb_count"] == 0 and d["c"]["malformed_returns"] == 3


def test_clamp_truncates_each_op(breakdown):
    ops = breakdown.ops_events.where("event_ord = 8 AND session_key = 'a'").first()["ops"]
    assert [o["gpu_ns"] for o in ops] == [int(61 * (40 / 80)), int(19 * (40 / 80))]


def test_tree_totals_and_lost_subtree(breakdown):
    got = rows(breakdown.tree, "session_key", "qualname", "depth", "gpu_ns_subtree", "grand_total_ns")
    assert got == [("a", "<unscoped>", 0, 7, 56), ("a", "inner", 1, 49, 56), ("a", "outer", 0, 49, 56), ("b", "solo", 0, 44, 44),
                   ("c", "<unscoped>", 0, 500, 500), ("c", "root", 0, 0, 500)]
    assert rows(tree.folded_stacks(breakdown.tree), "session_key", "line") == [
        ("a", "<unscoped> 7"), ("a", "outer;inner 49"), ("b", "solo 44"), ("c", "<unscoped> 500")]
    kept = tree.field_filter(breakdown.tree, {"step": ("int", "2")})
    assert rows(kept, "qualname") == [("inner",), ("outer",)]
    assert tree.field_filter(breakdown.tree, {"step": ("string", "2")}).count() == 0  # typed equality
    pruned = tree.prune(breakdown.tree, max_depth=1, top_n=1)
    assert rows(pruned, "session_key", "qualname") == [("a", "outer"), ("b", "solo"), ("c", "<unscoped>")]


def test_ops_and_origins(breakdown, log):
    got = rows(breakdown.ops.where("session_key = 'a'"), "name", "gpu_ns", "count", "op_kind")
    assert got == [("p1", 30, 2, "Matmul"), ("p2", 9, 1, None), ("p3", 10, 1, "Elementwise"), ("p4", 7, 1, None)]
    o = gpu.dispatch_origins(log)
    assert rows(o, "op_kind", "file_line", "gpu_ns") == [
        ("Elementwise", "scope:inner", 10), ("Matmul", "scope:inner", 30), ("p2", "scope:inner", 9)]


def test_trace_laid_end_to_end(breakdown):
    t = tree.breakdown_trace(breakdown.tree, breakdown.reachable_ops()).where("session_key = 'a' AND cat <> 'op'")
    assert rows(t, "name", "ts", "dur", "tid") == [("<unscoped>", 1, 1, 0), ("inner", 0, 1, 1), ("outer", 0, 1, 0)]


def test_scope_memory_and_heap(spark):
    a = Log("a")
    a.sample(0, 999).enter(1, 1, "f").sample(2, 10).enter(3, 2, "g").sample(4, 30).leave(5, 1)
    a.sample(5 + 500 * MS, 20).sample(6 + 500 * MS, 80)  # edge of f's tail, then past it
    a.enter(2 * S, 3, "f").leave(2 * S + 1, 3)
    b = Log("b")
    b.add("MetalHeapAlloc", 1, heap_id=1, size_bytes=100).enter(2, 1, "h").add("MetalHeapAlloc", 3, heap_id=2, size_bytes=50)
    b.add("MetalHeapAlloc", 4, heap_id=1, size_bytes=10).add("MetalHeapFree", 5, heap_id=9).add("MetalHeapFree", 6, heap_id=2).leave(7, 1)
    e = frame(spark, a, b)
    assert rows(memory.scope_memory(e, cell=16), "session_key", "qualname", "peak_bytes", "avg_bytes", "end_bytes", "sample_count") == [
        ("a", "f", 30, 20, 20, 3), ("a", "g", 80, 43, 80, 3), ("b", "h", 0, 0, 0, 0)]
    heap = memory.scope_heap(e, cell=4, chunk=chunk_of("event_ord", 2)).where("session_key = 'b'")
    assert rows(heap, "qualname", "peak_heap_count", "peak_heap_bytes") == [("h", 2, 150)]


def test_over_budget_windows_merge_and_split(spark):
    a = Log("a")
    a.enter(0, 1, "load").sample(1 * S, 95).sample(2 * S, 10).sample(6 * S, 120).leave(7 * S, 1)
    a.sample(8 * S, 0, budget=0).sample(11 * S, 91).sample(16 * S + 1, 100)
    w = memory.over_budget_windows(frame(spark, a), chunk=chunk_of("event_ord", 2))
    assert rows(w, "start_ts_mono_ns", "end_ts_mono_ns", "peak_bytes", "peak_scope") == [
        (1 * S, 11 * S, 120, "load"), (16 * S + 1, 16 * S + 1, 100, "<unscoped>")]
    f = rules.RULES["memory_pressure"](rules.RuleContext(frame(spark, a))).first()
    assert f["severity"] == "Critical" and "120%" in f["title"]


def test_model_loads(spark):
    a = Log("a")
    load = dict(path="/m/x.bin", size_bytes=5, t_start_ns=100, t_end_ns=400)
    a.add("ModelLoad", 200, **load).add("ModelLoad", 900, **load).add("ModelUnload", 950, path="/m/x.bin", t_ns=1)
    a.add("ModelUnload", 960, path="/m/x.bin", t_ns=1).add("ModelLoad", 999, **load)
    m = pairing.model_loads(frame(spark, a), chunk=chunk_of("event_ord", 2))
    assert rows(m, "load_index", "t_start_ns", "t_end_ns", "duplicate_of", "unloaded_at_ns") == [
        (0, 0, 200, None, None), (1, 600, 900, 0, 950), (2, 699, 999, None, None)]


def test_watchdog_session_report(spark):
    a = Log("a")
    a.add("PythonSidecarHello", 0, python_version="3", argv=[])
    a.eval(1 * S, 2 * S, 4).commit(3 * S, 9, depth=40).commit(4 * S, 10, depth=75).done(5 * S, 10, error=14).done(6 * S, 9, error=3)
    e = frame(spark, a)
    got = report.analyze(e)
    titles = rows(got, "rule_pos", "finding_pos", "rule", "severity", "category")
    assert [t[2:] for t in titles] == [
        ("metal_error", "Critical", "RootCause"), ("metal_error", "Warning", "ContributingFactor"),
        ("queue_depth", "Warning", "ContributingFactor"), ("mlx_timing", "Info", "Timing"), ("mlx_timing", "Info", "Timing")]
    assert "ImpactingInteractivity" in report.root_cause(got).first()["root_cause_title"]
    assert "75" in got.where("rule = 'queue_depth'").first()["title"]
    lines = [r["line"] for r in report.report_lines(got, e).orderBy("section", "rule_pos", "finding_pos", "part").collect()]
    assert lines[0].startswith("session: abababab") and lines.index("ROOT CAUSE") < lines.index("CONTRIBUTING FACTORS") < lines.index("TIMING")


def test_kill_and_crash_reports(spark):
    a = Log("a").add("ProcFootprint", 5, proc_pid=42, name="python3.11", phys_footprint_bytes=10, lifetime_max_phys_footprint_bytes=11, is_traced_root=True)
    a.add("ProcFootprint", 9, proc_pid=42, name="python3.11", phys_footprint_bytes=25, lifetime_max_phys_footprint_bytes=25, is_traced_root=True)
    b = Log("b").add("ProcFootprint", 5, proc_pid=50, name="x", phys_footprint_bytes=10, lifetime_max_phys_footprint_bytes=11, is_traced_root=True)
    b.add("ProcFootprint", 9, proc_pid=50, name="x", phys_footprint_bytes=20, lifetime_max_phys_footprint_bytes=25, is_traced_root=True)
    e = frame(spark, a, b)
    s = spark.createDataFrame(
        [("a", "Scoped", 7, ["/bin/uv"], "2024-01-01T00:00:00Z", "2024-01-01T00:01:00Z", -1, None), ("b", "Scoped", 8, ["/bin/x"], "2024-01-01T00:00:00Z", "2024-01-01T00:01:00Z", -1, None),
         ("c", "Scoped", 9, ["y"], "2024-01-01T00:00:00Z", "2024-01-01T00:01:00Z", 0, None)],
        "session_key string, kind string, kind_pid bigint, kind_argv array<string>, started_rfc3339 string, ended_rfc3339 string, exit_code int, term_signal int")
    t0 = 1704067200 * S
    kills = spark.createDataFrame(
        [("/1", t0 + 70 * S, 42, "python3.11-long", 30, 40, "per-process-limit"), ("/2", t0 + 80 * S, 42, "other", 1, 1, None), ("/3", t0 + 181 * S, 42, "python3.11", 1, 1, None)],
        "path string, mtime_ns bigint, killed_pid bigint, killed_name string, footprint_bytes bigint, lifetime_max_bytes bigint, reason string")
    crashes = spark.createDataFrame(
        [(1, "/u/9", t0 + 10 * S, 9, "SIGABRT", ["c"], "s"), (0, "/s/7", t0 + 10 * S, 7, None, [], ""), (1, "/u/7", t0 + 20 * S, 7, "SIGSEGV", [], "")],
        "dir_rank int, path string, mtime_ns bigint, crashed_pid bigint, signal string, exception_codes array<string>, summary string")
    found = report.session_summary(s, e, crashes, kills, host=None)
    heads = rows(found.where("rule LIKE '%report' OR rule LIKE 'presumed%'"), "session_key", "rule_pos", "rule")
    assert heads == [("a", -2, "kill_report"), ("a", -1, "crash_report"), ("b", 1000, "presumed_memory_death")]
    assert "own limit" in found.where("rule = 'kill_report'").first()["detail"]
    bounds = reports.session_bounds(s, e, host=None)
    assert rows(reports.crash_matches(bounds, crashes, host=None), "session_key", "path") == [("a", "/s/7")]


def test_correlations_rank_and_elide(spark):
    a = Log("a")
    a.done(1000, 1, error=3).add("VmSample", 1001, source="Vm").add("Mark", 1100, label="m").add("VmSample", 1200, source="Vm").add("VmSample", 1201, source="Vm")
    e = frame(spark, a)
    focal = spark.createDataFrame([("a", 1)], "session_key string, focal_seq bigint")
    got = incidents.correlations(e, focal, window_ns=200, max_events=2)
    assert rows(got, "rank", "event_ord") == [(1, 3), (2, 2)]
    assert rows(incidents.elided(e, focal, window_ns=200, max_events=2), "kind", "elided") == [("VmSample", 1)]


def test_queue_state_and_delta(spark):
    a = Log("a").commit(1, 1, depth=1).commit(2, 2, depth=2).done(3, 1, error=None).done(4, 2, queue=1, error=5)
    e = frame(spark, a)
    assert rows(live.queue_state(e), "queue_id", "depth", "in_flight", "oldest_cb_id", "last_completed_error") == [
        (0, 2, 1, 2, None), (1, 0, 0, None, 5)]
    t = live.delta_summary(e, 9)["totals"].first()
    assert (t["prev_cursor"], t["new_events"], t["note"]) == (4, 0, "cursor lies past the end and was set back")


def test_compare_sessions(spark, log):
    pairs = spark.createDataFrame([(1, "a", "b")], "pair_id int, session_a string, session_b string")
    out = report.compare(pairs, log)
    assert rows(out["only_in_a"], "qualname") == [("<unscoped>",), ("inner",), ("outer",)]
    assert rows(out["only_in_b"], "qualname") == [("solo",)]
    assert out["stats"].select("event_count_diff").first()[0] == -19 + log.where("session_key='b'").count() - (log.where("session_key='a'").count() - 19)
    assert rows(out["op_deltas"].where(F.col("op_kind") == "Matmul"), "a_gpu_ns", "b_gpu_ns", "delta_pct") == [(30, 0, -100.0)]
