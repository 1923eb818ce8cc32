"""Sources and sinks: round trips, damaged input, external reports."""

import json
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from logs import Log, frame
from spanforge.functions import text
from spanforge.operators import filters, incidents, sessions as S
from spanforge.sinks import documents, files, trace
from spanforge.sources import events as src, external

FIELDS = {"n": ("int", "5"), "f": ("float", "5.0"), "s": ("string", "5"), "b": ("bool", "true")}


@pytest.fixture(scope="module")
def log(spark):
    a = Log("2024-01-01-000000-aaaa")
    a.enter(0, 1, "outer", fields=FIELDS).commit(50, 5, label="lbl").done(140, 5, error=3).ops(141, 5, ("p1", "gemm_x", 60, 2))
    a.leave(200, 1).add("Mark", 210, label="m", fields=FIELDS).add("VmSample", 220, page_outs_per_sec=float("nan"), wired_bytes=1, active_bytes=2)
    a.add("ModelLoad", 300, path="/m/x.bin", size_bytes=5, t_start_ns=0, t_end_ns=1000).add("ModelUnload", 310, path="/m/x.bin", t_ns=3)
    b = Log("2024-01-02-000000-bbbb").add("Mark", 1, label="quote \" and \\ é")
    return frame(spark, a, b).cache()


def same(a, b):
    cols = a.columns
    # maps do not compare, and null and absent lists are told apart by the reader only
    norm = lambda d: sorted(str([(sorted(v.items()) if isinstance(v, dict) else v) for v in r]) for r in d.select(*cols).collect())
    return norm(a) == norm(b)


def test_raw_json_round_trip(spark, log, tmp_path):
    files.write_raw_json(log.withColumn("session_key", F.col("session_key")), str(tmp_path / "raw"))
    back = src.read_event_json(spark, str(tmp_path / "raw"))
    back = back.withColumn("session_key", F.regexp_replace("session_key", "^session_key=", ""))
    keep = [c for c in log.columns if c != "page_outs_per_sec"]
    assert same(log.select(*keep), back.select(*keep))


def test_dump_and_cut_tail(spark, tmp_path):
    d = tmp_path / "s1"
    d.mkdir()
    ev = lambda n, p: {"ts_mono_ns": n, "ts_wall_ns": n, "session_id": "x", "source": "Mark", "pid": None, "seq": n, "payload": p}
    good = [ev(1, {"kind": "Mark", "label": "a", "fields": {"k": 1.5}}), ev(2, {"kind": "Mark", "label": "b"})]
    (d / "events.json").write_text("\n".join(json.dumps(x) for x in good) + '\n{"ts_mono_ns": 3, "payl')
    got = src.read_event_json(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["session_key"], r["label"]) for r in got] == [("s1", "a"), ("s1", "b")]
    assert got[0]["fields"]["k"].asDict() == {"t": "float", "v": "1.5"}
    (tmp_path / "d" / "s2").mkdir(parents=True)
    (tmp_path / "d" / "s2" / "dump.json").write_text(json.dumps({"metadata": {}, "events": good}, indent=1))
    dump = src.read_event_dump(spark, str(tmp_path / "d")).orderBy("event_ord").collect()
    assert [(r["session_key"], r["event_ord"], r["label"]) for r in dump] == [("s2", 0, "a"), ("s2", 1, "b")]


def test_positions_ids_and_quarantine(spark, tmp_path):
    d = tmp_path / "post-mortem-x"
    d.mkdir()
    line = lambda sid, seq, payload: json.dumps({"ts_mono_ns": seq, "ts_wall_ns": seq, "session_id": sid, "source": "MetalHook", "pid": 1, "seq": seq, "payload": payload})
    big = (1 << 63) + 7
    a = [line("a", n, {"kind": "MetalHeapFree", "heap_id": big + n}) for n in range(3)]
    b = [line("b", n, {"kind": "MetalHeapFree", "heap_id": n}) for n in range(3)]
    (d / "e1.jsonl").write_text("\n".join([a[0], b[0], "{broken}", a[1]]) + "\n")
    (d / "e2.jsonl").write_text("\n".join([b[1], line("a", 9, {"kind": "MetalHeapAlloc", "heap_id": 1, "size_bytes": big}), a[2], b[2]]) + "\n" + '{"ts_mo')
    good, bad = src.read_event_log(spark, str(tmp_path))
    rows = good.orderBy("event_ord").collect()
    assert [(r.session_id, r.seq, r.event_ord) for r in rows] == [("a", 0, 0), ("b", 0, 1), ("a", 1, 3), ("b", 1, 4), ("a", 2, 6), ("b", 2, 7)]
    assert [r.heap_id % (1 << 64) for r in rows if r.session_id == "a"] == [big, big + 1, big + 2]
    assert good.count() == good.select("heap_id").count() == 6 and src.repeated_positions(good).isEmpty()
    assert sorted((r.event_ord, r.reason) for r in bad.collect()) == [(2, "damaged"), (5, "quantity above 2^63-1"), (8, "cut tail")]


def test_pruned_scan_equals_filter(spark, log, tmp_path):
    p = str(tmp_path / "log")
    src.write_events(log, p)
    cols = ["session_key", "event_ord", "kind", "source"]
    for cond in (dict(source="MetalHook"), dict(from_ts=50, to_ts=141), dict(from_ts=140, to_ts=140), dict(from_ts=9, to_ts=3), dict(kind="MARK")):
        pruned = src.read_events(spark, p, **cond)
        assert sorted(map(tuple, pruned.select(*cols).collect())) == sorted(map(tuple, filters.filter_events(log, **cond).select(*cols).collect()))
    plan = src.read_events(spark, p, source="MetalHook", from_ts=50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "GreaterThanOrEqual(ts_mono_ns,50)" in plan
    with pytest.raises(ValueError):
        filters.event_filter(source="Nope")


def test_session_catalog_tolerates_damage(spark, tmp_path):
    for name, body in (("s1", json.dumps({"session_id": "i", "started_rfc3339": "2024-01-01T00:00:00Z", "kind": {"type": "Scoped", "pid": 4, "argv": ["x"]}})), ("s2", "{nope")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(body)
    got = {r["session_key"]: (r["kind"], r["kind_pid"]) for r in src.read_sessions(spark, str(tmp_path)).collect()}
    assert got == {"s1": ("Scoped", 4), "s2": (None, None)}


def test_trace_rows(log):
    rows = trace.trace_rows(log)
    got = sorted((r["ph"], r["name"], r["pid"], r["ts"], r["dur"]) for r in rows.where("ph IN ('X', 'i')").collect())
    assert ("X", "outer", 1, 0.0, 0.2) in got and ("X", "lbl", 2, 0.05, 0.1) in got and ("X", "gemm_x", 3, 0.05, 0.06) in got
    assert ("X", "x.bin", 4, 0.0, 0.3) in got and ("i", "unload:x.bin", 4, 0.31, None) in got
    assert rows.where("name = 'vm_page_outs_per_sec'").count() == 0
    scope = json.loads(trace.trace_json(rows.where("name = 'outer'")).first()["value"])
    assert scope["args"] == {"class_name": "C", "module_call_id": 1, "n": 5, "f": 5.0, "s": "5", "b": True}


def test_post_mortem_slices(spark, log, tmp_path):
    kept, ranges = incidents.recorder(log, incidents.incidents(log, host=None), host=None, window_ns=100)
    files.write_post_mortems(kept, ranges, str(tmp_path / "pm"))
    back = files.read_post_mortems(spark, str(tmp_path / "pm")).collect()
    assert {r.slice[:26] for r in back} == {"post-mortem-metal-error-3-"} and sorted(r["ts_mono_ns"] for r in back) == [50, 140]
    assert files.read_post_mortems(spark, str(tmp_path / "pm"), slices=["none"]).count() == 0


def test_post_mortem_sums_meet_no_pairs(spark, tmp_path, monkeypatch):
    kept = spark.createDataFrame([(h, p, None if p < 5 else 2**61 - p) for h in "ab" for p in range(2, 40)], "host string, position bigint, seq bigint")
    slices = [(h, f"s{f}-{t}", f, t) for h in "ab" for f, t in ((2, 3), (2, 39), (4, 5), (7, 7), (30, 29), (37, 39))]
    kept.write.parquet(f"{tmp_path}/events")
    spark.createDataFrame(slices, "host string, slice string, first bigint, last bigint").write.parquet(f"{tmp_path}/slices")
    monkeypatch.setattr(files, "chunk_of", lambda c: F.call_function("div", F.col(c), F.lit(6)))
    monkeypatch.setattr(files, "events_of", None)
    want = {}
    for h, name, first, last in slices:
        if first <= last and name != "s2-39":  # its sum fits no long
            some = [2**61 - p for p in range(first, last + 1) if p >= 5]
            want[h, name] = last - first + 1, sum(some) if some else None
    names = sorted({n for _, n in want})
    got = files.read_post_mortems(spark, str(tmp_path), slices=names, sums=["seq"]).collect()
    assert {(r["host"], r["slice"]): (r["events"], r["seq"]) for r in got} == want


def test_reports_from_files(spark, tmp_path):
    (tmp_path / "a.ips").write_text('{"bug_type":"309","incident_id":"I1"}\n{"pid":7,\n"procName":"py","exception":{"type":"EXC","subtype":"kIOGPUX (0x0e)","codes":"c","signal":"S1"},"termination":{"signal":"S2"}}')
    (tmp_path / "b.ips").write_text('{"bug_type":"298"}\n{"largestProcess":"big","processes":[{"pid":1,"name":"big","rpages":9},{"pid":2,"name":"v","rpages":3,"killDelta":5}]}')
    (tmp_path / "c.ips").write_text('{"bug_type":"298"}\n{"processes":[{"pid":1,"name":"big","rpages":9}]}')
    (tmp_path / "d.ips").write_text('not json')
    got = {r["path"][-5:]: r for r in external.parse_reports(external.read_report_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.ips", "b.ips"}
    assert (got["a.ips"]["signal"], got["a.ips"]["exception_codes"], got["a.ips"]["summary"]) == ("S2", ["kIOGPUX", "0x0e", "c"], "EXC: kIOGPUX (0x0e)")
    assert (got["b.ips"]["killed_pid"], got["b.ips"]["footprint_bytes"], got["b.ips"]["reason"]) == (2, 3 * 16384, None)


def test_names_and_refs(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first()["v"]
    lit = F.lit
    assert val(text.basename(lit("/a/b/"))) == "b" and val(text.basename(lit("/"))) == "/" and val(text.basename(lit("x"))) == "x"
    assert val(text.truncate(lit("héllo"), 4)) == "hél…" and val(text.truncate(lit("abc"), 0)) == ""
    assert val(text.valid_session_name(lit("  é" + "a" * 300))) == "é" + "a" * 198
    assert val(text.valid_session_name(lit("a/b"))) is None and val(text.valid_session_name(lit(" \t"))) is None
    assert val(text.parse_field(lit("k= 1e3"))).value.t == "float" and val(text.parse_field(lit("nokey"))) is None
    assert val(text.rfc3339_ns(lit("1970-01-01T01:00:00.000000001+01:00"))) == 1 and val(text.rfc3339_ns(lit("bad"))) is None
    assert val(text.binary_bytes(lit(176640))) == "172 KiB" and val(text.binary_bytes(lit(1023))) == "1023 B"
    s = spark.createDataFrame([("d-1-ab", "0" * 32, "2024", "x"), ("d-2-ab", "f" * 32, "2025", "x"), ("d-3", None, "2026", None)],
                              "session_key string, session_id string, started_rfc3339 string, name string")
    got = dict(map(tuple, S.resolve_refs(s, ["ab", "F" * 32, "x", "zz"]).collect()))
    assert got == {"ab": "d-2-ab", "F" * 32: "d-2-ab", "x": "d-2-ab", "zz": None}


def many_marks(key, n):
    log = Log(key)
    for i in range(n):
        log.add("Mark", i, label=f"m{i}")
    return log


def test_documents_are_whole_and_in_order(spark, log, tmp_path):
    """Several parts a session: joined by name they are one JSON text, also by DuckDB's reading."""
    import duckdb

    many = frame(spark, *(many_marks(k, n) for k, n in (("a", 900), ("b/ü", 300), ("c", 1)))).unionByName(
        log.where(F.col("session_key").endswith("aaaa")).withColumn("session_key", F.lit("d")))
    sessions = spark.createDataFrame([(k, f"name {k}", "Scoped", 4) for k in ("a", "b/ü", "c", "d", "empty")], "session_key string, name string, kind string, kind_pid long")
    for kind, lines in (("json", files.event_document_lines(many, sessions)), ("trace", trace.trace_document_lines(trace.trace_rows(many), sessions))):
        path = tmp_path / kind
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the parts were large
        documents.write_documents(lines.repartition(7), str(path))
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        manifest = [json.loads(x) for f in sorted((path / "manifest").glob("part-*")) for x in f.read_text().splitlines()]
        texts = {}
        for row in sorted(manifest, key=lambda r: (r["session_key"], r["part"])):
            part = next(f for f in (path / "parts").glob(f"*/{row['file']}") if unquote(f.parent.name) == f"session_key={row['session_key']}")
            assert part.stat().st_size == row["bytes"]
            texts[row["session_key"]] = texts.get(row["session_key"], "") + part.read_text()
        docs = {k: json.loads(t) for k, t in texts.items()}
        assert set(docs) == {"a", "b/ü", "c", "d", "empty"} and all(d["metadata"] == {"session_key": k, "name": f"name {k}", "kind": {"type": "Scoped", "pid": 4}} for k, d in docs.items())
        assert max(sum(r["session_key"] == k for r in manifest) for k in docs) > 1
        con = duckdb.connect()
        get = lambda k, p: con.execute("SELECT json_extract(?::JSON, ?)", [texts[k], p]).fetchone()[0]
        if kind == "json":
            assert [e["event_ord"] for e in docs["a"]["events"]] == list(range(1, 901)) and docs["empty"]["events"] == []
            assert get("b/ü", "$.events[299].payload.label") == '"m299"' and get("a", "$.metadata.name") == '"name a"'
        else:
            assert docs["a"]["displayTimeUnit"] == "ms" and [e["ph"] for e in docs["a"]["traceEvents"]] == ["M"] * 4 + ["i"] * 900
            assert docs["empty"]["traceEvents"] == [] and get("a", "$.traceEvents[5].name") == '"m1"'
            assert [e["name"] for e in docs["d"]["traceEvents"] if e["ph"] == "X" and e["pid"] == 1] == ["outer"]


def test_session_marks_and_utilisation_lanes(spark):
    a = Log("a")
    a.add("SessionStarted", 1).add("IoReportSample", 2, gpu_residency_pct=float("nan"), ane_residency_pct=5.0, gpu_power_mw=7)
    a.add("IoReportSample", 3, gpu_freq_mhz=900).add("SessionEnded", 4, reason="done")
    got = {(r["ph"], r["name"], r["args"]) for r in trace.trace_rows(frame(spark, a)).where("ph <> 'M'").collect()}
    assert got == {("i", "session-started", None), ("i", "session-ended (done)", None), ("C", "utilization_pct", '{"ane":5.0}'),
                   ("C", "gpu_power_mw", '{"mw":7}'), ("C", "gpu_freq_mhz", '{"mhz":900}')}
