"""Filters, catalog, reports, incidents and live views over the derived log."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from spanforge.operators import diff, filters, incidents, live, pairing, rendering, reports, sequences, sessions as S
from spanforge.operators.scan import chunk_of
from spanforge.plans import report, rules
from spanforge.queries import profile
from spanforge.queries.profile import CELL, GAP
from spanforge.queries.registry import ORACLES, query
from spanforge.queries.views import (ATTRIB, BUFFERS, GRACE_NS, HOST_SQL, HOUR_NS, SESSIONS, TL, WINDOWS, ev, on_host, sessions, table,
                                     trace_log, with_sql)
from spanforge.session_conf import cut_lineage, shared_folder, spread
from spanforge.sinks import documents, files, trace
from spanforge.sources.events import read_event_json, read_events, read_sessions, write_events

DAY = 24 * HOUR_NS
LO, HI = 5 * DAY, 20 * DAY


@query("a1_session_catalog", with_sql(SESSIONS, "SELECT session_key, started_rfc3339, ended_rfc3339, kind, kind_pid, name, exit_code FROM sess"))
def a1_session_catalog(spark, sf):
    return sessions(spark, sf).drop("session_id")


@query("a1_session_files", with_sql(SESSIONS, "SELECT session_key, session_id, started_rfc3339, ended_rfc3339, kind, kind_pid, name, exit_code FROM (SELECT *, printf('%032x', u) AS session_id FROM sess)"))
def a1_session_files(spark, sf):
    """The catalog written as one metadata document per session folder, and read back from the folders."""
    s = sessions(spark, sf)
    path = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    spread(s.select("session_key", documents.metadata_json(s).alias("value")), "session_key").write.partitionBy("session_key").text(path)
    return read_sessions(spark, path).select("session_key", "session_id", "started_rfc3339", "ended_rfc3339", "kind", "kind_pid", "name", "exit_code")


@query("a2_ndjson_round_trip", with_sql(TL, """
  SELECT t.session_key, t.kind, count(*) AS n, CAST(sum(t.seq) AS BIGINT) AS seqs, CAST(coalesce(sum(o.g), 0) AS BIGINT) AS op_ns FROM tl t
  LEFT JOIN (SELECT event_ord, sum(gpu_ns) AS g FROM tl_ops GROUP BY 1) o USING (event_ord) GROUP BY 1, 2"""))
def a2_ndjson_round_trip(spark, sf):
    """The log written as NDJSON, one folder per session, and read back."""
    path = f"{shared_folder(spark)}/ndjson-{uuid.uuid4().hex}"
    files.write_raw_json(trace_log(spark, sf), path)
    back = read_event_json(spark, path)
    op_ns = F.coalesce(F.aggregate("ops", F.lit(0).cast("bigint"), lambda a, o: a + o["gpu_ns"]), F.lit(0))
    return back.groupBy("session_key", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"), F.sum(op_ns).alias("op_ns"))


_HOSTS = TL + f", th AS (SELECT *, {HOST_SQL.format('session_key')} AS host FROM tl)"


@query("a12_post_mortem_slices", with_sql(_HOSTS, f"""
  SELECT i.host, 'metal-error-' || i.error_code AS incident_label, count(DISTINCT i.event_ord) AS slices, count(*) AS events, CAST(sum(e.seq) AS BIGINT) AS seqs
  FROM th i JOIN th e ON e.host=i.host AND e.wall BETWEEN i.wall-{HOUR_NS} AND i.wall WHERE i.kind='MetalCbCompleted' AND i.error_code IS NOT NULL GROUP BY 1, 2"""))
def a12_post_mortem_slices(spark, sf):
    """Trailing windows of all incidents of each host, as ranges of events that are written once, read back from disk."""
    e = on_host(trace_log(spark, sf))
    path = f"{shared_folder(spark)}/post-mortem-{uuid.uuid4().hex}"
    kept, ranges = incidents.recorder(e, incidents.incidents(e, host="host"), host="host", window_ns=HOUR_NS)
    files.write_post_mortems(kept, ranges, path)
    back = files.read_post_mortems(spark, path, sums=["seq"])
    label = F.regexp_extract("slice", "post-mortem-(metal-error-[0-9]+)-", 1)
    return back.groupBy("host", label.alias("incident_label")).agg(
        F.count_distinct("slice").alias("slices"), F.sum("events").alias("events"), F.sum("seq").alias("seqs"))


@query("a3_pruned_scan", with_sql(TL, f"SELECT session_key, event_ord, kind FROM tl WHERE source='MetalHook' AND ts BETWEEN {LO} AND {HI}"))
def a3_pruned_scan(spark, sf):
    """The log written by day and source, and read back with conditions that prune."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    write_events(trace_log(spark, sf), path)
    return read_events(spark, path, source="MetalHook", from_ts=LO, to_ts=HI).select("session_key", "event_ord", "kind")


@query("a2_mixed_slices", with_sql(TL, """
  SELECT 'slice=' || CAST(event_ord//7%3 AS VARCHAR) AS session_key, count(*) AS n, count(*) AS positions, CAST(0 AS BIGINT) AS first_ord, count(*)-1 AS last_ord,
         CAST(coalesce(sum(heap_id), 0) AS BIGINT) AS heap_ids FROM tl GROUP BY 1"""))
def a2_mixed_slices(spark, sf):
    """Events of many sessions in one folder each, without positions, with heap ids past 2^63: all come back, each in a place of its own."""
    wide = (F.col("heap_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)")
    log = trace_log(spark, sf).withColumn("slice", F.call_function("div", "event_ord", F.lit(7)) % 3)
    lines = files.event_json(log.withColumns({"heap_id": wide, "session_key": F.struct("slice"), "event_ord": F.lit(None).cast("bigint")}))
    path = f"{shared_folder(spark)}/slices-{uuid.uuid4().hex}"
    text = lines.select("session_key.slice", F.regexp_replace("json", '"session_key":[^}]*},', "").alias("value"))
    text.repartition("slice").write.partitionBy("slice").text(path)
    back = read_event_json(spark, path)
    low = F.col("heap_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return back.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_ord").alias("positions"), F.min("event_ord").alias("first_ord"),
        F.max("event_ord").alias("last_ord"), F.coalesce(F.sum(low), F.lit(0)).cast("bigint").alias("heap_ids"))


@query("a4_event_count", with_sql(TL, "SELECT session_key, count(*) AS event_count FROM tl GROUP BY 1"))
def a4_event_count(spark, sf):
    return filters.event_counts(trace_log(spark, sf))


@query("a8_raw_json")
def a8_raw_json(spark, sf):
    return files.event_json(trace_log(spark, sf))


@query("a9_trace_rows", with_sql(BUFFERS, """
  SELECT ph, pid, count(*) AS n, CAST(sum(CAST(round(coalesce(dur, 0)) AS BIGINT)) AS BIGINT) AS total_us FROM (
   SELECT 'M' AS ph, unnest([1, 2, 3, 4]) AS pid, NULL::DOUBLE AS dur FROM (SELECT DISTINCT session_key FROM tl)
   UNION ALL SELECT 'X', 1, (ret_ts-t_in)/1000.0 FROM scopes WHERE ret_ts IS NOT NULL
   UNION ALL SELECT 'X', 2, in_flight_ns/1000.0 FROM buf
   UNION ALL SELECT 'X', 3, o.gpu_ns/1000.0 FROM tl_ops o JOIN oe USING (event_ord) WHERE oe.comp_ord IS NOT NULL
   UNION ALL SELECT 'i', 1, NULL FROM tl WHERE kind='Mark'
   UNION ALL SELECT 'i', 4, NULL FROM tl WHERE kind='ModelUnload'
   UNION ALL SELECT 'X', 4, (ts-greatest(0, ts-load_ns))/1000.0 FROM tl WHERE kind='ModelLoad'
   UNION ALL SELECT 'C', 0, NULL FROM tl WHERE kind IN ('MetalDeviceMemSample', 'ModelLoad', 'ThermalState')
   UNION ALL SELECT 'C', 0, NULL FROM tl, (VALUES (1), (2)) WHERE kind='VmSample') GROUP BY 1, 2"""))
def a9_trace_rows(spark, sf):
    rows = trace.trace_rows(trace_log(spark, sf))
    return rows.groupBy("ph", F.col("pid").cast("bigint").alias("pid")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.coalesce("dur", F.lit(0.0))).cast("bigint")).alias("total_us"))


_TRACE = BUFFERS + """,
 tr AS (
   SELECT session_key, 'M' AS ph, 'process_name' AS name, m.pid, '0' AS tid, NULL::DOUBLE AS ts, NULL::DOUBLE AS dur, NULL AS cat, NULL AS s, '{"name":"' || m.n || '"}' AS args
   FROM (SELECT DISTINCT session_key FROM tl), (VALUES (1, 'Python'), (2, 'Metal CBs'), (3, 'Kernels'), (4, 'Model Loads')) m(pid, n)
   UNION ALL SELECT session_key, 'X', qualname, 1, NULL, t_in/1000.0, (ret_ts-t_in)/1000.0, NULL, NULL,
     '{"class_name":"' || class_name || '","module_call_id":' || call_id || ',"step":' || (k%4) || '}' FROM scopes WHERE ret_ts IS NOT NULL
   UNION ALL SELECT b.session_key, 'X', 'cb_' || b.cb_id, 2, 'queue_' || (b.cb_id%2), b.commit_ts/1000.0, b.in_flight_ns/1000.0, NULL, NULL,
     '{"cb_id":' || b.cb_id || ',"status":4,"error_code":' || coalesce(c.error_code::VARCHAR, 'null') || ',"error_domain":null}' FROM buf b JOIN comp c ON c.event_ord=b.comp_ord
   UNION ALL SELECT o.session_key, 'X', coalesce(o.symbol, o.name), 3, 'cb_' || o.cb_id, b.commit_ts/1000.0, o.gpu_ns/1000.0, NULL, NULL,
     '{"raw_name":"' || o.name || '","symbol":' || coalesce('"' || o.symbol || '"', 'null') || ',"count":' || o.cnt || '}' FROM tl_ops o JOIN oe USING (event_ord) JOIN buf b ON b.comp_ord=oe.comp_ord
   UNION ALL SELECT session_key, 'i', label, 1, '0', ts/1000.0, NULL, NULL, 'g', NULL FROM tl WHERE kind='Mark'
   UNION ALL SELECT session_key, 'i', 'unload:' || substr(path, 4), 4, '0', ts/1000.0, NULL, 'model-unload', 'p', '{"path":"' || path || '"}' FROM tl WHERE kind='ModelUnload'
   UNION ALL SELECT session_key, 'X', substr(path, 4), 4, '0', greatest(0, ts-load_ns)/1000.0, (ts-greatest(0, ts-load_ns))/1000.0, 'model-load', NULL,
     '{"path":"' || path || '","size_bytes":' || size_bytes || '}' FROM tl WHERE kind='ModelLoad'
   UNION ALL SELECT session_key, 'C', 'gpu_memory', 0, NULL, ts/1000.0, NULL, NULL, NULL, '{"allocated_bytes":' || allocated || ',"budget_bytes":' || budget || '}' FROM tl WHERE kind='MetalDeviceMemSample'
   UNION ALL SELECT session_key, 'C', 'system_memory', 0, NULL, ts/1000.0, NULL, NULL, NULL,
     '{"wired_bytes":' || cents*10 || ',"active_bytes":' || cents*20 || ',"compressed_bytes":' || k || ',"swap_used_bytes":0}' FROM tl WHERE kind='VmSample'
   UNION ALL SELECT session_key, 'C', 'vm_page_outs_per_sec', 0, NULL, ts/1000.0, NULL, NULL, NULL, '{"rate":' || (cents/100.0::DOUBLE) || '}' FROM tl WHERE kind='VmSample'
   UNION ALL SELECT session_key, 'C', 'thermal_level', 0, NULL, ts/1000.0, NULL, NULL, NULL, '{"level":' || (k%4) || '}' FROM tl WHERE kind='ThermalState'
   UNION ALL SELECT session_key, 'C', 'model:' || substr(path, 4), 0, NULL, ts/1000.0, NULL, NULL, NULL,
     '{"bytes":' || sum(size_bytes) OVER (PARTITION BY session_key, path ORDER BY event_ord) || '}' FROM tl WHERE kind='ModelLoad')"""


@query("a9_trace_lanes", with_sql(_TRACE, "SELECT session_key, ph, name, pid, tid, round(ts, 3) AS ts, round(dur, 3) AS dur, cat, s, args FROM tr"))
def a9_trace_lanes(spark, sf):
    """Every column of every row of the trace export."""
    rows = trace.trace_rows(trace_log(spark, sf))
    return rows.select("session_key", "ph", "name", "pid", "tid", F.round("ts", 3).alias("ts"), F.round("dur", 3).alias("dur"), "cat", "s", "args")


def _metadata(spark, sf):
    """The catalog under the sessions' own keys."""
    return sessions(spark, sf).withColumn("session_key", F.regexp_replace("session_key", "^post-mortem-", ""))


def _document(spark, lines, head):
    """What the lines of written documents are, each parsed once: ``json`` is null for a broken one."""
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    documents.write_documents(lines, path)
    value = F.col("value")
    first, last, comma = value.startswith(head), value.startswith("]"), value.startswith(",")
    bare = F.when(comma, F.substr(value, F.lit(2))).otherwise(value)
    whole = F.when(first, F.concat(value, F.lit("]}"))).when(last, F.concat(F.lit('{"list":['), value)).otherwise(bare)
    return documents.read_document_lines(spark, path).select(
        "session_key", first.alias("first"), last.alias("last"), (~first & ~last).alias("item"), comma.alias("comma"), F.try_parse_json(whole).alias("json"))


def _value(path, kind="string"):
    return F.try_variant_get("json", path, kind)


@query("a8_json_documents", with_sql(SESSIONS, """
  SELECT t.session_key, count(*) AS events, 1 AS without_comma, any_value(s.name) AS name, any_value(s.kind) AS kind, CAST(sum(t.seq) AS BIGINT) AS seqs, count(DISTINCT t.kind) AS kinds, 0 AS broken
  FROM tl t JOIN sess s ON s.s0=t.session_key GROUP BY 1"""))
def a8_json_documents(spark, sf):
    """``{metadata, events}`` of each session, written in parts and read back by the manifest."""
    lines = files.event_document_lines(trace_log(spark, sf), _metadata(spark, sf))
    back = _document(spark, lines, '{"metadata":')
    return back.groupBy("session_key").agg(
        F.count_if("item").alias("events"), F.count_if(F.col("item") & ~F.col("comma")).alias("without_comma"),
        F.max(F.when(F.col("first"), _value("$.metadata.name"))).alias("name"), F.max(F.when(F.col("first"), _value("$.metadata.kind.type"))).alias("kind"),
        F.sum(F.when(F.col("item"), _value("$.seq", "bigint"))).alias("seqs"), F.count_distinct(F.when(F.col("item"), _value("$.payload.kind"))).alias("kinds"),
        F.count_if(F.col("json").isNull()).alias("broken"))


@query("a9_trace_documents", with_sql(_TRACE + SESSIONS.removeprefix(TL), """
  SELECT tr.session_key, count(*) AS rows, count(*) FILTER (WHERE ph='X') AS spans, count(*) FILTER (WHERE args IS NULL) AS without_args, any_value(s.name) AS name, 'ms' AS unit, 0 AS broken
  FROM tr JOIN sess s ON s.s0=tr.session_key GROUP BY 1"""))
def a9_trace_documents(spark, sf):
    """``{traceEvents, displayTimeUnit, metadata}`` of each session, written in parts and read back by the manifest."""
    lines = trace.trace_document_lines(trace.trace_rows(trace_log(spark, sf)), _metadata(spark, sf))
    back = _document(spark, lines, '{"traceEvents":')
    args = _value("$.args", "variant")
    return back.groupBy("session_key").agg(
        F.count_if("item").alias("rows"), F.count_if(F.col("item") & (_value("$.ph") == "X")).alias("spans"),
        F.count_if(F.col("item") & (args.isNull() | F.is_variant_null(args))).alias("without_args"),
        F.max(F.when(F.col("last"), _value("$.metadata.name"))).alias("name"), F.max(F.when(F.col("last"), _value("$.displayTimeUnit"))).alias("unit"),
        F.count_if(F.col("json").isNull()).alias("broken"))


@query("l_trace_json")
def l_trace_json(spark, sf):
    return trace.trace_json(trace.trace_rows(trace_log(spark, sf))).select("session_key", "value")


@query("a10_change_feed", with_sql(TL, """
  SELECT session_key, side, count(*) AS n FROM (
   SELECT session_key, 1 AS side FROM tl UNION ALL
   SELECT session_key, 0 FROM (SELECT session_key, seq, max(seq) OVER (PARTITION BY session_key ORDER BY event_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM tl) WHERE seq>m+1) GROUP BY 1, 2"""))
def a10_change_feed(spark, sf):
    e = trace_log(spark, sf)
    gaps = sequences.sequence_gaps(e, keys=["session_key"], order="event_ord", seq="seq", chunk=chunk_of())
    return files.change_feed(e, gaps).groupBy("session_key", F.col("side").cast("bigint").alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("b3_query_events", with_sql(TL, f"""
  SELECT f.session_key, event_ord, rn AS row, matched, total, matched>3 AS truncated FROM (
   SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY event_ord) AS rn, count(*) OVER (PARTITION BY session_key) AS matched
   FROM tl WHERE lower(kind)='mlxevalentered' AND ts>={LO}) f JOIN (SELECT session_key, count(*) AS total FROM tl GROUP BY 1) t USING (session_key) WHERE rn<=3"""))
def b3_query_events(spark, sf):
    return filters.query_events(trace_log(spark, sf), limit=3, kind="mlxevalENTERED", from_ts=LO).select(
        "session_key", "event_ord", "row", "matched", "total", "truncated")


@query("b4_cb_history", with_sql(TL, """
  SELECT session_key, event_ord, rn AS row, matched, matched>7 AS truncated FROM (
   SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY event_ord) AS rn, count(*) OVER (PARTITION BY session_key) AS matched
   FROM tl WHERE kind IN ('MetalCbCommitted','MetalCbScheduled','MetalCbCompleted','MetalHeapAlloc','MetalHeapFree') AND queue_id=0) WHERE rn BETWEEN 3 AND 7"""))
def b4_cb_history(spark, sf):
    return filters.cb_history(trace_log(spark, sf), queue_id=0, offset=2, limit=5).select(
        "session_key", "event_ord", "row", "matched", "truncated")


@query("b5_resolve_refs", with_sql(SESSIONS, """
  SELECT r.ref, coalesce((SELECT max(session_key) FROM sess WHERE contains(session_key, r.ref)),
    (SELECT arg_max(session_key, (started_rfc3339, session_key)) FROM sess WHERE name=r.ref)) AS session_key
  FROM (VALUES ('u14'), ('run3'), ('mortem'), ('nowhere')) r(ref)"""))
def b5_resolve_refs(spark, sf):
    return S.resolve_refs(sessions(spark, sf), ["u14", "run3", "mortem", "nowhere"])


@query("b6_latest_session", with_sql(SESSIONS, "SELECT arg_max(session_key, (kind<>'Ambient', session_key)) AS session_key FROM sess"))
def b6_latest_session(spark, sf):
    return S.latest_session(sessions(spark, sf))


@query("b7_default_session", with_sql(SESSIONS, """
  SELECT CASE WHEN p IS NOT NULL AND NOT coalesce(ps<ss, false) THEN p ELSE coalesce(sc, nw) END AS session_key FROM (
   SELECT arg_max(session_key, session_key) FILTER (WHERE session_key LIKE 'post-mortem-%') AS p,
     arg_max(started_rfc3339, session_key) FILTER (WHERE session_key LIKE 'post-mortem-%') AS ps,
     arg_max(started_rfc3339, session_key) FILTER (WHERE kind='Scoped' AND session_key NOT LIKE 'post-mortem-%') AS ss,
     max(session_key) FILTER (WHERE kind='Scoped') AS sc, max(session_key) AS nw FROM sess)"""))
def b7_default_session(spark, sf):
    return S.default_session(sessions(spark, sf))


@query("b8_live_session", with_sql(SESSIONS, """
  SELECT session_key, ended_rfc3339 IS NULL AS live FROM sess ORDER BY ended_rfc3339 IS NULL DESC, started_rfc3339 DESC, session_key DESC LIMIT 1"""))
def b8_live_session(spark, sf):
    return S.live_session(sessions(spark, sf))


_ROOT = """ rc AS (SELECT session_key, arg_min('Command buffer ' || cb_id || ' failed with kIOGPUCommandBufferCallbackErrorTimeout (code 1, domain ?)', event_ord) AS root_cause_title
   FROM tl WHERE kind='MetalCbCompleted' AND error_code=1 GROUP BY 1)"""


@query("b9_session_listing", with_sql(SESSIONS + "," + _ROOT, """
  SELECT s.session_key, c.n AS event_count, rc.root_cause_title FROM sess s JOIN (SELECT session_key, count(*) AS n FROM tl GROUP BY 1) c ON c.session_key=s.session_key
  LEFT JOIN rc ON rc.session_key=s.session_key WHERE c.n>=60"""))
def b9_session_listing(spark, sf):
    e = trace_log(spark, sf)
    roots = report.root_cause(report.analyze(e, names=["metal_error"]))
    return S.list_sessions(sessions(spark, sf), filters.event_counts(e), roots, min_events=60).select(
        "session_key", "event_count", "root_cause_title")


@query("b10_notice_search", with_sql(TL, "SELECT session_key, event_ord, label AS summary FROM tl WHERE kind='Mark' AND contains('mark ' || label, 'm1')"))
def b10_notice_search(spark, sf):
    feed = rendering.notice_feed(trace_log(spark, sf))
    return filters.notice_search(feed, "M1").select("session_key", "event_ord", "summary")


@query("b11_notability", with_sql(TL, """
  SELECT session_key, count(*) AS notable FROM tl WHERE (kind='MetalCbCompleted' AND coalesce(error_code, 0)<>0)
    OR kind IN ('Mark','ModelLoad','ModelUnload','ProcFootprint','MetalHookSkipped','MetalHookDropped') GROUP BY 1"""))
def b11_notability(spark, sf):
    return trace_log(spark, sf).where(filters.is_notable()).groupBy("session_key").agg(F.count(F.lit(1)).alias("notable"))


@query("b12_incidents", with_sql(TL, "SELECT session_key, event_ord, 'metal-error-' || error_code AS incident_label FROM tl WHERE kind='MetalCbCompleted' AND error_code<>0"))
def b12_incidents(spark, sf):
    return incidents.incidents(trace_log(spark, sf), host=None).select("session_key", "event_ord", "incident_label")


@query("b13_session_view_summary", with_sql(SESSIONS + ", fd AS (SELECT session_key, rule, severity, title FROM (" + "{metal_error}" + "))", """
  SELECT s.session_key, s.kind, c.n AS event_count, fd.rule, fd.severity, fd.title FROM sess s LEFT JOIN (SELECT session_key, count(*) AS n FROM tl GROUP BY 1) c ON c.session_key=s.session_key
  LEFT JOIN fd ON fd.session_key=s.session_key"""))
def b13_session_view_summary(spark, sf):
    e = trace_log(spark, sf)
    return S.session_view(sessions(spark, sf), e, "summary", report.analyze(e, names=["metal_error"])).select(
        "session_key", "kind", "event_count", "rule", "severity", "title")


@query("b14_notice_feed", with_sql(TL, """
  SELECT session_key, event_ord, ts AS ts_mono_ns, 'mark' AS label, label AS summary FROM tl WHERE kind='Mark'
  UNION ALL SELECT session_key, event_ord, ts, 'metal-hook', 'skipped: ' || CASE k WHEN 10 THEN 'stage sampling disabled' WHEN 40 THEN 'dispatch sampling disabled' ELSE 'ring decode error' END
  FROM tl WHERE kind='MetalHookSkipped'"""))
def b14_notice_feed(spark, sf):
    return rendering.notice_feed(trace_log(spark, sf))


@query("b15_event_lines", with_sql(TL, """
  SELECT session_key, event_ord, '+' || ts || 'ns  seq=' || seq || '  src=' || source || '  ' || CASE kind
    WHEN 'Mark' THEN 'mark    ' || label WHEN 'MetalCbScheduled' THEN 'MetalCbScheduled cb_id=0x' || printf('%x', cb_id) || ' queue_id=' || queue_id
    WHEN 'MlxEvalReturned' THEN 'MlxEvalReturned call_id=' || call_id || ' duration=' || duration_ns//1000000 || 'ms async=' || was_async
    WHEN 'ModuleReturned' THEN 'ModuleReturned call_id=' || module_call_id END AS line
  FROM tl WHERE kind IN ('Mark','MetalCbScheduled','MlxEvalReturned','ModuleReturned')"""))
def b15_event_lines(spark, sf):
    e = trace_log(spark, sf).where(F.col("kind").isin("Mark", "MetalCbScheduled", "MlxEvalReturned", "ModuleReturned"))
    return rendering.render_events(e)


@query("b15_all_event_lines")
def b15_all_event_lines(spark, sf):
    return rendering.render_events(trace_log(spark, sf))


@query("c11_live_snapshot", with_sql(TL, f"""
  SELECT session_key, count(*) AS live_arrays, CAST(sum(size) AS BIGINT) AS total_array_bytes, list_sort(list(DISTINCT stream)) AS streams FROM (
    SELECT session_key, arg_max(kind, event_ord) AS k, arg_max(cents, event_ord) AS size, arg_max('s' || (k%3), event_ord) AS stream FROM tl
    WHERE kind IN ('MetalHeapAlloc','MetalHeapFree') AND ts<={HI} GROUP BY session_key, heap_id) WHERE k='MetalHeapAlloc' GROUP BY 1"""
    .replace("arg_max('s' || (k%3), event_ord)", "arg_max('s' || (cents%3), event_ord)")))
def c11_live_snapshot(spark, sf):
    e = trace_log(spark, sf).where(F.col("kind").isin("MetalHeapAlloc", "MetalHeapFree"))
    arrays = e.withColumns({"kind": F.when(F.col("kind") == "MetalHeapAlloc", "MlxArrayAlive").otherwise("MlxArrayFreed"),
                            "array_id": F.col("heap_id"),
                            "stream": F.concat(F.lit("s"), (F.col("size_bytes") % 3).cast("string"))})
    return pairing.live_snapshot(arrays, HI)


_ATT = """ al AS (SELECT event_ord AS at_ord, ts AS at_ns, CASE WHEN kind='Mark' THEN 'attach' ELSE 'detach' END AS action, k%5 AS pid,
    'sess' || event_ord AS skey FROM tl WHERE kind IN ('Mark','ModelUnload')),
   an AS (SELECT *, lead(action) OVER w AS na, lead(at_ord) OVER w AS no, lead(at_ns) OVER w AS nn FROM al WINDOW w AS (PARTITION BY pid ORDER BY at_ord)),
   att AS (SELECT pid, skey, at_ord AS attach_ord, at_ns AS attach_ns, no AS detach_ord, nn AS detach_ns, na FROM an WHERE action='attach')"""


def _attachments(spark, sf):
    e = ev(spark, sf).withColumn("kind", F.when((F.col("typ") == "signup") & (F.col("k") % 10 == 5), "attach")
                                 .when((F.col("typ") == "signup") & (F.col("k") % 5 == 2), "detach")).where("kind IS NOT NULL")
    log = e.select(F.col("event_ord").alias("at_ord"), (F.col("t") * 1000).alias("at_ns"), F.col("kind").alias("action"),
                   (F.col("k") % 5).alias("pid"), F.concat(F.lit("sess"), F.col("event_ord").cast("string")).alias("session_key"),
                   F.lit(None).cast("string").alias("scope_token"))
    return log


@query("c12_attachments", with_sql(TL + "," + _ATT, """
  SELECT pid, skey AS session_key, attach_ord, detach_ord, CASE na WHEN 'attach' THEN 'superseded' WHEN 'detach' THEN 'record:exit pid=' || pid END AS end_reason FROM att"""))
def c12_attachments(spark, sf):
    return pairing.attachments(_attachments(spark, sf)).select("pid", "session_key", "attach_ord", "detach_ord", "end_reason")


_ATT2 = _ATT.replace("k%5 AS pid", "(k//5)%7 AS pid")


_ROUTE = TL + "," + _ATT2 + """,
   ch AS (SELECT pid, 'tok' || (attach_ord//37) AS tok, attach_ord AS o, 1 AS side, skey FROM att UNION ALL SELECT pid, 'tok' || (attach_ord//37), detach_ord, 0, '' FROM att WHERE detach_ord IS NOT NULL),
   ask AS (SELECT event_ord, source, pid%7 AS pid, CASE WHEN event_ord%4=0 THEN 'tok' || (event_ord//37) END AS tok FROM tl)"""


@query("d5_event_routing", with_sql(_ROUTE, """
  SELECT e.event_ord, coalesce(
     nullif((SELECT arg_max(c.skey, (c.o, c.side)) FROM ch c WHERE c.tok=e.tok AND c.o<=e.event_ord), ''),
     nullif((SELECT arg_max(c.skey, (c.o, c.side)) FROM ch c WHERE c.pid=e.pid AND c.o<=e.event_ord), ''),
     CASE WHEN e.source='Mark' THEN (SELECT arg_max(a.skey, a.attach_ord) FROM att a WHERE a.attach_ord<=e.event_ord AND (a.detach_ord IS NULL OR a.detach_ord>e.event_ord)) END,
     'ambient') AS routed_to FROM ask e"""))
def d5_event_routing(spark, sf):
    """Every event of the log, a quarter of them with a token, by token, process id, mark or none."""
    token = lambda c: F.concat(F.lit("tok"), F.call_function("div", F.col(c), F.lit(37)).cast("string"))
    log = _attachments(spark, sf).drop("pid").join(
        ev(spark, sf).select(F.col("event_ord").alias("at_ord"), (F.call_function("div", F.col("k"), F.lit(5)) % 7).alias("pid")), "at_ord")
    e = trace_log(spark, sf).select("event_ord", (F.col("pid") % 7).alias("pid"), F.when(F.col("event_ord") % 4 == 0, token("event_ord")).alias("scope_token"), "source")
    return S.route_events(e, pairing.attachments(log.withColumn("scope_token", token("at_ord"))), ambient_key="ambient").select("event_ord", "routed_to")


@query("c13_close_orphans", with_sql(SESSIONS, """
  SELECT session_key, CASE WHEN ended_rfc3339 IS NULL AND session_key NOT LIKE 'post-mortem-%' THEN strftime(make_timestamp(z//1000), '%Y-%m-%dT%H:%M:%S.%fZ') ELSE ended_rfc3339 END AS ended_rfc3339,
    CASE WHEN ended_rfc3339 IS NULL AND session_key NOT LIKE 'post-mortem-%' THEN 'recovered-after-crash' END AS end_reason FROM sess"""))
def c13_close_orphans(spark, sf):
    s = sessions(spark, sf).withColumn("end_reason", F.lit(None).cast("string"))
    return pairing.close_orphans(s, trace_log(spark, sf)).select("session_key", "ended_rfc3339", "end_reason")


# failed buffers act as reports: pid = user % 50, written at the failure's wall time
_REPORTS = SESSIONS + f""", rep AS (SELECT event_ord%2 AS dir_rank, '/r/' || event_ord || '.ips' AS path, wall AS mtime_ns, pid, error_code, {HOST_SQL.format('session_key')} AS host FROM tl
    WHERE kind='MetalCbCompleted' AND error_code IS NOT NULL),
   bnd AS (SELECT session_key, 'h' || (u%3) AS host, exit_code, kind_pid, a//1000*1000 AS start_ns, CASE WHEN u%4<>0 THEN z//1000*1000
      WHEN session_key LIKE 'post-mortem-%' THEN NULL ELSE z+120000000000 END AS end_ns FROM sess WHERE kind='Scoped')"""


def _reports(spark, sf):
    bad = on_host(trace_log(spark, sf)).where((F.col("kind") == "MetalCbCompleted") & F.col("error_code").isNotNull())
    return bad.select("host", "error_code", (F.col("event_ord") % 2).alias("dir_rank"), F.concat(F.lit("/r/"), F.col("event_ord").cast("string"), F.lit(".ips")).alias("path"),
                      F.col("ts_wall_ns").alias("mtime_ns"), F.col("pid").alias("crashed_pid"))


def _kills(spark, sf):
    src = ev(spark, sf).select("event_ord", "k")
    return on_host(trace_log(spark, sf)).where(F.col("kind") == "MetalCbCompleted").join(src, "event_ord").select(
        "host", "error_code", F.concat(F.lit("/k/"), F.col("event_ord").cast("string")).alias("path"), F.col("ts_wall_ns").alias("mtime_ns"), (F.col("k") % 4).alias("killed_pid"),
        F.when(F.col("k") % 7 == 0, "").otherwise(F.concat(F.lit("proc"), (F.col("k") % 3).cast("string"), F.lit("x"))).alias("killed_name"))


def _catalog(spark, sf):
    return on_host(sessions(spark, sf)).withColumns({"term_signal": F.lit(None).cast("int"), "kind_argv": F.lit(None).cast("array<string>")})


_CRASH = """SELECT session_key, path FROM (SELECT b.session_key, r.path, row_number() OVER (PARTITION BY b.session_key ORDER BY r.dir_rank, r.mtime_ns DESC, r.path) AS rn
    FROM bnd b JOIN rep r ON r.host=b.host AND r.pid=b.kind_pid AND r.mtime_ns BETWEEN b.start_ns AND coalesce(b.end_ns, 9e18::BIGINT)+120000000000{0} WHERE b.exit_code IS NULL OR b.exit_code<>0) WHERE rn=1"""
_KNOWN = f""", kn AS (SELECT session_key, kind_pid AS pid, NULL::VARCHAR AS name FROM bnd UNION SELECT session_key, proc_pid, name FROM tl WHERE kind='ProcFootprint'),
   kr AS (SELECT '/k/' || event_ord AS path, {HOST_SQL.format('session_key')} AS host, wall AS mtime_ns, k%4 AS pid, error_code, CASE WHEN k%7=0 THEN '' ELSE 'proc' || (k%3) || 'x' END AS kname FROM tl WHERE kind='MetalCbCompleted')"""
_KILL = """SELECT session_key, path FROM (SELECT b.session_key, r.path, row_number() OVER (PARTITION BY b.session_key ORDER BY r.mtime_ns DESC, r.path) AS rn
    FROM bnd b JOIN (SELECT DISTINCT session_key, pid FROM kn) p USING (session_key) JOIN kr r ON r.host=b.host AND r.pid=p.pid AND r.mtime_ns BETWEEN b.start_ns AND coalesce(b.end_ns, 9e18::BIGINT)+120000000000{0}
    WHERE r.kname='' OR NOT EXISTS (SELECT 1 FROM kn n WHERE n.session_key=b.session_key AND n.name IS NOT NULL)
      OR EXISTS (SELECT 1 FROM kn n WHERE n.session_key=b.session_key AND n.name IS NOT NULL AND left(n.name, least(length(n.name), length(r.kname)))=left(r.kname, least(length(n.name), length(r.kname))))) WHERE rn=1"""


@query("d6_crash_report_join", with_sql(_REPORTS, _CRASH.format("").replace("r.host=b.host AND ", "")))
def d6_crash_report_join(spark, sf):
    """All reports against all sessions: the events name no host, so they are of one."""
    bounds = reports.session_bounds(_catalog(spark, sf), trace_log(spark, sf), host=None)
    return reports.crash_matches(bounds, _reports(spark, sf), host=None).select("session_key", "path")


@query("d7_kill_report_join", with_sql(_REPORTS + _KNOWN, _KILL.format("")))
def d7_kill_report_join(spark, sf):
    e, s = trace_log(spark, sf), _catalog(spark, sf)
    bounds = reports.session_bounds(s, e, host="host")
    return reports.kill_matches(bounds, reports.known_processes(s, e), _kills(spark, sf), host="host").select("session_key", "path")


@query("d9_trailing_window", with_sql(_HOSTS, f"""
  SELECT i.host, i.session_key || '-' || i.event_ord AS incident_key, count(*) AS n, arg_min(e.event_ord, (e.wall, e.session_key, e.event_ord)) AS first_ord,
    arg_max(e.event_ord, (e.wall, e.session_key, e.event_ord)) AS last_ord
  FROM th i JOIN th e ON e.host=i.host AND e.wall BETWEEN i.wall-{HOUR_NS} AND i.wall WHERE i.kind='MetalCbCompleted' AND i.error_code IS NOT NULL GROUP BY 1, 2"""))
def d9_trailing_window(spark, sf):
    """The ranges of the recorder, with the events at their ends: linear in events and incidents."""
    e = on_host(trace_log(spark, sf)).select("host", "session_key", "event_ord", "ts_wall_ns", "kind", "error_code", "reason")
    kept, ranges = incidents.recorder(e, incidents.incidents(e, host="host"), host="host", window_ns=HOUR_NS)
    at = kept.select("host", "position", "event_ord")
    return (ranges.join(at.withColumnsRenamed({"position": "first", "event_ord": "first_ord"}), ["host", "first"])
            .join(at.withColumnsRenamed({"position": "last", "event_ord": "last_ord"}), ["host", "last"])
            .select("host", "incident_key", (F.col("last") - F.col("first") + 1).alias("n"), "first_ord", "last_ord"))


_BAND = TL + f""", fo AS (SELECT session_key, seq, ts, source FROM tl WHERE kind='MetalCbCompleted' AND error_code IS NOT NULL),
   bd AS (SELECT f.session_key, f.seq AS focal_seq, e.event_ord, e.kind, row_number() OVER (PARTITION BY f.session_key, f.seq ORDER BY
      NOT ((e.kind='MetalCbCompleted' AND coalesce(e.error_code, 0)<>0) OR e.kind IN ('Mark','ModelLoad','ModelUnload','ProcFootprint','MetalHookSkipped','MetalHookDropped')), abs(e.ts-f.ts), e.event_ord) AS rank
    FROM fo f JOIN tl e ON e.session_key=f.session_key AND e.source<>f.source AND e.seq<>f.seq AND e.ts BETWEEN f.ts-{2 * DAY} AND f.ts+{2 * DAY})"""


def _focal(e):
    return e.where((F.col("kind") == "MetalCbCompleted") & F.col("error_code").isNotNull()).select("session_key", F.col("seq").alias("focal_seq"))


@query("d10_correlations", with_sql(_BAND, "SELECT session_key, focal_seq, event_ord, rank FROM bd WHERE rank<=4"))
def d10_correlations(spark, sf):
    e = trace_log(spark, sf)
    return incidents.correlations(e, _focal(e), window_ns=2 * DAY, max_events=4).select(
        "session_key", "focal_seq", "event_ord", F.col("rank").cast("bigint").alias("rank"))


@query("e21_elided_counts", with_sql(_BAND, "SELECT session_key, focal_seq, kind, count(*) AS elided FROM bd WHERE rank>4 GROUP BY 1, 2, 3"))
def e21_elided_counts(spark, sf):
    e = trace_log(spark, sf)
    return incidents.elided(e, _focal(e), window_ns=2 * DAY, max_events=4)


@query("h1_union_sources", """SELECT source_name, count(*) AS n FROM (SELECT 'documents' AS source_name FROM documents UNION ALL SELECT 'pages' FROM pages
   UNION ALL SELECT 'conversations' FROM conversations) GROUP BY 1""")
def h1_union_sources(spark, sf):
    parts = [table(spark, sf, t).withColumn("source_name", F.lit(t)) for t in ("documents", "pages", "conversations")]
    return filters.union_sources(*parts).groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))


@query("h4_session_set_changes", with_sql(TL, f"""
  SELECT session_key, 'added' AS change FROM (SELECT DISTINCT session_key FROM tl WHERE kind='Mark' AND ts>{HI} EXCEPT SELECT session_key FROM tl WHERE kind='Mark' AND ts<={LO})
  UNION ALL SELECT session_key, 'removed' FROM (SELECT DISTINCT session_key FROM tl WHERE kind='Mark' AND ts<={LO} EXCEPT SELECT session_key FROM tl WHERE kind='Mark' AND ts>{HI})"""))
def h4_session_set_changes(spark, sf):
    m = trace_log(spark, sf).where(F.col("kind") == "Mark")
    return S.session_set_changes(m.where(F.col("ts_mono_ns") <= LO).select("session_key").distinct(),
                                 m.where(F.col("ts_mono_ns") > HI).select("session_key").distinct())


# --- rules and reports -----------------------------------------------------

_COLS = ("session_key", "rule", "finding_pos", "severity", "category", "title")


def _rule(name, sql=None):
    def run(spark, sf):
        return rules.RULES[name](profile._ctx(spark, sf)).select(*_COLS, F.get("evidence", 0)["seq"].alias("ev_seq"))

    query("j_" + name.replace("-", "_"), sql)(run)


_rule("metal_error", with_sql(TL, """SELECT session_key, 'metal_error' AS rule, event_ord AS finding_pos, CASE error_code WHEN 1 THEN 'Critical' ELSE 'Warning' END AS severity,
  CASE error_code WHEN 1 THEN 'RootCause' ELSE 'ContributingFactor' END AS category, 'Command buffer ' || cb_id || ' failed with kIOGPUCommandBufferCallbackError' ||
  CASE error_code WHEN 1 THEN 'Timeout' ELSE 'OutOfMemory' END || ' (code ' || error_code || ', domain ?)' AS title, seq AS ev_seq FROM tl WHERE kind='MetalCbCompleted' AND error_code IS NOT NULL"""))
ORACLES["b13_session_view_summary"] = ORACLES["b13_session_view_summary"].replace("{metal_error}", ORACLES["j_metal_error"])
_FF = TL + """, ff AS (SELECT session_key, arg_min(ts, event_ord) AS ft, min(event_ord) AS fs FROM tl WHERE kind='MetalCbCompleted' AND error_code IS NOT NULL GROUP BY 1)"""
_rule("queue_depth", with_sql(_FF, f"""SELECT session_key, 'queue_depth' AS rule, 0 AS finding_pos, 'Warning' AS severity, 'ContributingFactor' AS category,
  'Queue depth peaked at ' || d || ' buffers in flight' AS title, fs AS ev_seq FROM (SELECT f.session_key, f.fs, max(c.queue_depth) AS d FROM ff f JOIN tl c ON c.session_key=f.session_key
  AND c.kind='MetalCbCommitted' AND c.ts BETWEEN f.ft-{GAP} AND f.ft GROUP BY 1, 2) WHERE d>0"""))
_rule("queue_pressure",
      with_sql(_FF + """, q AS (SELECT session_key, coalesce(max(queue_depth), 0) AS d, coalesce(max(in_flight_ns), 0) AS s,
    arg_max(event_ord, (queue_depth, -event_ord)) FILTER (WHERE queue_depth IS NOT NULL) AS ds, arg_max(event_ord, (in_flight_ns, -event_ord)) FILTER (WHERE in_flight_ns IS NOT NULL) AS ss
    FROM tl WHERE kind IN ('MetalCbCommitted','MetalCbCompleted') AND session_key NOT IN (SELECT session_key FROM ff) GROUP BY 1)""", """
  SELECT session_key, 'queue_pressure' AS rule, 0 AS finding_pos, 'Warning' AS severity, 'ContributingFactor' AS category,
   'Command queue backed up: depth ' || d || ' and longest wait ' || s//1000000 || 'ms' AS title, CASE WHEN d>=32 THEN ds ELSE ss END AS ev_seq FROM q WHERE d>=32 OR s>=1000000000"""))
_rule("mlx_timing", with_sql(_FF + """,
   rt AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY duration_ns) - 1 AS i, count(*) OVER (PARTITION BY session_key) AS n,
      row_number() OVER (PARTITION BY session_key ORDER BY duration_ns DESC, event_ord DESC) AS sl FROM tl WHERE kind='MlxEvalReturned'),
   nr AS (SELECT r.*, row_number() OVER (PARTITION BY r.session_key ORDER BY r.ts DESC, r.event_ord DESC) AS rk FROM tl r JOIN ff USING (session_key) WHERE r.kind='MlxEvalReturned' AND r.ts<=ff.ft)""", """
  SELECT session_key, 'mlx_timing' AS rule, 5-rk AS finding_pos, 'Info' AS severity, 'Timing' AS category, 'eval call_id=' || call_id || ' returned (' ||
    CASE WHEN was_async THEN 'async' ELSE 'sync' END || ', ' || duration_ns//1000000 || 'ms)' AS title, seq AS ev_seq FROM nr WHERE rk<=5
  UNION ALL SELECT session_key, 'mlx_timing', 6, 'Info', 'Timing', 'eval timing: ' || max(n) || ' calls (' || count(*) FILTER (WHERE NOT was_async) || ' sync, ' || count(*) FILTER (WHERE was_async) ||
    ' async), p50 ' || max(CASE WHEN i=floor((n-1)*0.5::DOUBLE+0.5) THEN duration_ns END)//1000000 || 'ms, p95 ' || max(CASE WHEN i=floor((n-1)*0.95::DOUBLE+0.5) THEN duration_ns END)//1000000 ||
    'ms, max ' || max(duration_ns)//1000000 || 'ms', max(CASE WHEN sl=1 THEN seq END) FROM rt GROUP BY 1"""))
_rule("mlx_cache_growth", with_sql(TL, """SELECT session_key, 'mlx_cache_growth' AS rule, 0 AS finding_pos, 'Warning' AS severity, 'ContributingFactor' AS category,
  'Allocator cache exceeds the memory in use' AS title, arg_max(seq, (cache_bytes, -event_ord)) AS ev_seq FROM tl WHERE kind='MlxMemoryPoll' GROUP BY 1
  HAVING max(cache_bytes)>=1000000000 AND max(active_bytes)>0 AND max(cache_bytes)::DOUBLE/max(active_bytes)>=1.25"""))
_rule("memory_pressure", with_sql(profile._OVER, """SELECT session_key, 'memory_pressure' AS rule, 0 AS finding_pos, CASE WHEN r>1.0 THEN 'Critical' ELSE 'Warning' END AS severity, 'ContributingFactor' AS category,
  CASE WHEN r>1.0 THEN 'Device memory over its budget (' ELSE 'Device memory near its budget (' END || CAST(round(r*100) AS BIGINT) || '%) in scope ' || sc AS title, po AS ev_seq
  FROM (SELECT session_key, max(peak_bytes::DOUBLE/500000000) AS r, arg_max(peak_scope, (peak_bytes, island)) AS sc, arg_max(peak_ord, (peak_bytes, island)) AS po FROM ov GROUP BY 1)"""))
_rule("system_pressure", with_sql(TL, """SELECT session_key, 'system_pressure' AS rule, event_ord*4194304 AS finding_pos, 'Warning' AS severity, 'SystemPressure' AS category,
  'spindump using ' || printf('%.1f', (cents/1000.0)::FLOAT::DOUBLE) || '% CPU' AS title, seq AS ev_seq FROM tl WHERE kind='ProcTop' AND (cents/1000.0)::FLOAT>=5.0"""))
_rule("duplicate-model-load", with_sql(TL + """, r AS (SELECT *, lag(kind) OVER (PARTITION BY session_key, path ORDER BY event_ord) AS pk FROM tl WHERE kind IN ('ModelLoad','ModelUnload'))""", """
  SELECT session_key, 'duplicate-model-load' AS rule, event_ord AS finding_pos, 'Warning' AS severity, 'ContributingFactor' AS category,
   'Model ' || substr(path, 4) || ' loaded again without an unload (' || printf('%.1f', size_bytes/1048576.0) || ' MB)' AS title, seq AS ev_seq FROM r WHERE kind='ModelLoad' AND pk='ModelLoad'"""))
_rule("hook_degradation", with_sql(TL, """SELECT session_key, 'hook_degradation' AS rule, p AS finding_pos, 'Warning' AS severity, 'ContributingFactor' AS category, title, ev_seq FROM (
  SELECT session_key, 0 AS p, 'Op timing degraded: stage sampling disabled ' || count(*) || ' time(s)' AS title, min(seq) AS ev_seq FROM tl WHERE kind='MetalHookSkipped' AND k=10 GROUP BY 1
  UNION ALL SELECT session_key, 1, 'Op timing degraded: dispatch sampling disabled ' || count(*) || ' time(s)', min(seq) FROM tl WHERE kind='MetalHookSkipped' AND k=40 GROUP BY 1
  UNION ALL SELECT session_key, 2, 'Damaged frames in the capture ring: ' || count(*) || ' report(s)', min(seq) FROM tl WHERE kind='MetalHookSkipped' AND k=70 GROUP BY 1
  UNION ALL SELECT session_key, 3, 'Capture ring full: ' || sum(k) || ' event(s) dropped', min(seq) FROM tl WHERE kind='MetalHookDropped' GROUP BY 1)"""))
_LAZY = ATTRIB + """,
   lz AS (SELECT session_key, CASE WHEN gpu_ns>0 AND eval_ord IS NOT NULL AND eval_leaf IS NULL THEN eval_ord END AS e, gpu_ns FROM att),
   lg AS (SELECT session_key, CAST(sum(CASE WHEN e IS NOT NULL THEN gpu_ns ELSE 0 END)*100 // sum(gpu_ns) AS BIGINT) AS pct, min(e) AS fs FROM lz GROUP BY 1
     HAVING min(e) IS NOT NULL AND sum(CASE WHEN e IS NOT NULL THEN gpu_ns ELSE 0 END)*100 // sum(gpu_ns) >= 50)"""
_rule("lazy_eval_attribution", with_sql(_LAZY, """SELECT session_key, 'lazy_eval_attribution' AS rule, 0 AS finding_pos, 'Warning' AS severity, 'ContributingFactor' AS category,
  'Attribution gap: ' || pct || '% of GPU time outside scopes' AS title, fs AS ev_seq FROM lg"""))
_SIDE = """ si AS (SELECT session_key, count(*) AS n, count(*) FILTER (WHERE kind='MetalCbCompleted') AS cbs, min(seq) FILTER (WHERE kind='MetalCbCompleted') AS fs
   FROM tl GROUP BY 1 HAVING count(*) FILTER (WHERE kind IN ('ModuleEntered','MlxEvalEntered','PythonSidecarHello'))=0)"""
_rule("sidecar_absent", with_sql(TL + "," + _SIDE, """SELECT session_key, 'sidecar_absent' AS rule, 0 AS finding_pos, 'Info' AS severity, 'ContributingFactor' AS category,
  CASE WHEN cbs=0 THEN 'This session ran no GPU work that was instrumented' ELSE 'No runtime agent was attached, so GPU time has no scopes' END AS title, fs AS ev_seq FROM si"""))


@query("j15_attribution_notices", with_sql(_LAZY + "," + _SIDE, """
  SELECT t.session_key, count(*) FILTER (WHERE kind='MetalHookSkipped' AND k IN (10, 40)) AS sampling_disable_episodes,
    CASE WHEN any_value(lg.pct) IS NOT NULL THEN 'LazyEval' WHEN max(si.cbs)>0 THEN 'SidecarAbsent' END AS gap_kind
  FROM tl t LEFT JOIN lg ON lg.session_key=t.session_key LEFT JOIN si ON si.session_key=t.session_key GROUP BY 1"""))
def j15_attribution_notices(spark, sf):
    return rules.attribution_notices(profile._ctx(spark, sf)).select("session_key", "sampling_disable_episodes", "gap_kind")


@query("e17_sampling_episodes", "SELECT lang AS session_key, count(*) FILTER (WHERE contains(text, 'the') OR contains(text, 'der')) AS episodes FROM documents GROUP BY 1")
def e17_sampling_episodes(spark, sf):
    d = table(spark, sf, "documents")
    marks = F.when(F.col("text").contains("the"), "stage sampling disabled").when(F.col("text").contains("der"), "dispatch sampling disabled")
    return filters.sampling_disable_episodes(d.select(
        F.col("lang").alias("session_key"), F.lit("MetalHookSkipped").alias("kind"), F.concat(F.lit("x "), marks).alias("reason")))


_ALL_FINDINGS = " UNION ALL ".join(f"(SELECT session_key, rule, severity FROM ({ORACLES['j_' + n.replace('-', '_')]}))" for n in rules.RULES)


@query("k1_findings_per_session", f"SELECT session_key, rule, severity, count(*) AS n FROM ({_ALL_FINDINGS}) GROUP BY 1, 2, 3")
def k1_findings_per_session(spark, sf):
    e = trace_log(spark, sf)
    found = report.analyze(e, grace_ns=GRACE_NS, cell=CELL, band_ns=GAP, gap_ns=GAP, chunk=chunk_of())
    return found.groupBy("session_key", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("k2_root_cause", with_sql(TL + "," + _ROOT, "SELECT session_key, root_cause_title FROM rc"))
def k2_root_cause(spark, sf):
    return report.root_cause(report.analyze(trace_log(spark, sf), names=["metal_error"]))


@query("k4_external_findings", with_sql(_REPORTS + _KNOWN + f""",
   cr AS ({_CRASH.format(" AND r.error_code=1")}), ki AS ({_KILL.format(" AND r.error_code=2")}),
   fp AS (SELECT session_key, arg_min(phys, event_ord) AS a, arg_max(phys, event_ord) AS z FROM tl WHERE kind='ProcFootprint' AND is_root GROUP BY 1),
   rcs AS (SELECT session_key FROM tl WHERE kind='MetalCbCompleted' AND error_code=1 UNION SELECT session_key FROM cr UNION SELECT session_key FROM ki)""", f"""
  SELECT session_key, rule, severity, count(*) AS n FROM (
   SELECT * FROM ({_ALL_FINDINGS}) UNION ALL SELECT session_key, 'crash_report' AS rule, 'Critical' AS severity FROM cr UNION ALL SELECT session_key, 'kill_report', 'Critical' FROM ki
   UNION ALL SELECT s.session_key, 'presumed_memory_death', 'Warning' FROM sess s JOIN fp USING (session_key) WHERE s.kind='Scoped' AND fp.a<>0 AND fp.z>=fp.a*2.0
     AND (s.exit_code=-1 OR (s.exit_code IS NULL AND s.ended_rfc3339 IS NOT NULL)) AND s.session_key NOT IN (SELECT session_key FROM rcs)) GROUP BY 1, 2, 3"""))
def k4_external_findings(spark, sf):
    """Findings of all rules with crash reports of timeouts, kill reports of memory failures, and presumed deaths."""
    e, s = trace_log(spark, sf), _catalog(spark, sf)
    crashes = _reports(spark, sf).where("error_code = 1").withColumns({"signal": F.lit("SIGABRT"), "summary": F.lit("gpu"), "exception_codes": F.array(F.lit("c"))})
    kills = _kills(spark, sf).where("error_code = 2").withColumns({"footprint_bytes": F.lit(1).cast("bigint"), "lifetime_max_bytes": F.lit(2).cast("bigint"), "reason": F.lit(None).cast("string")})
    found = report.session_summary(s, e, crashes, kills, host="host", grace_ns=GRACE_NS, cell=CELL, band_ns=GAP, gap_ns=GAP, chunk=chunk_of())
    return found.groupBy("session_key", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("k3_report_sections", with_sql(TL + """,
   r AS (SELECT *, lag(kind) OVER (PARTITION BY session_key, path ORDER BY event_ord) AS pk FROM tl WHERE kind IN ('ModelLoad','ModelUnload')),
   f AS (SELECT session_key, 2 AS section, 2 AS n FROM r WHERE kind='ModelLoad' AND pk='ModelLoad'
     UNION ALL SELECT session_key, 2, 1 FROM tl WHERE kind='MetalCbCompleted' AND error_code=2
     UNION ALL SELECT session_key, 1, 1 FROM tl WHERE kind='MetalCbCompleted' AND error_code=1 GROUP BY 1)""", """
  SELECT session_key, section, CAST(sum(n)+1 AS BIGINT) AS lines FROM f GROUP BY 1, 2 UNION ALL SELECT DISTINCT session_key, 0, 2 FROM tl"""))
def k3_report_sections(spark, sf):
    e = trace_log(spark, sf)
    lines = report.report_lines(report.analyze(e, names=["metal_error", "duplicate-model-load"]), e)
    return lines.groupBy("session_key", F.col("section").cast("bigint").alias("section")).agg(F.count(F.lit(1)).alias("lines"))


@query("k3_report_lines")
def k3_report_lines(spark, sf):
    e = trace_log(spark, sf)
    found = report.analyze(e, names=["metal_error", "queue_depth", "mlx_cache_growth", "duplicate-model-load"], band_ns=GAP)
    return report.report_lines(found, e)


@query("k7_compare_stats", with_sql(TL + "," + profile._PAIRS + "," + _ROOT + """,
   st AS (SELECT session_key, count(*) AS n, arg_max(ts, event_ord)-arg_min(ts, event_ord) AS d FROM tl GROUP BY 1)""", """
  SELECT pair_id, a.n AS a_event_count, b.n AS b_event_count, b.n-a.n AS event_count_diff, b.d-a.d AS duration_diff_ns, ra.root_cause_title IS NOT DISTINCT FROM rb.root_cause_title AS root_cause_match
  FROM pr LEFT JOIN st a ON a.session_key=sa LEFT JOIN st b ON b.session_key=sb LEFT JOIN rc ra ON ra.session_key=sa LEFT JOIN rc rb ON rb.session_key=sb"""))
def k7_compare_stats(spark, sf):
    e = trace_log(spark, sf)
    roots = report.root_cause(report.analyze(e, names=["metal_error"]))
    return diff.compare_sessions(profile.session_pairs(e), diff.session_stats(e), roots).select(
        "pair_id", "a_event_count", "b_event_count", "event_count_diff", "duration_diff_ns", "root_cause_match")


_PARTS = {"scope_deltas": ("d12_scope_deltas", "qualname", "a_gpu_ns", "b_gpu_ns"), "only_in_a": ("d14_scopes_only_in_a", "qualname", "gpu_ns", "gpu_ns"),
          "only_in_b": ("d14_scopes_only_in_b", "qualname", "gpu_ns", "gpu_ns"), "op_deltas": ("d13_op_deltas", "op_kind", "a_gpu_ns", "b_gpu_ns"),
          "memory_deltas": ("d12_memory_deltas", "qualname", "a_peak_bytes", "b_peak_bytes"),
          "origin_deltas": ("d12_origin_deltas", "op_kind || '@' || file_line", "a_gpu_ns", "b_gpu_ns"),
          "stats": ("k7_compare_stats", "CAST(root_cause_match AS VARCHAR)", "a_event_count", "b_event_count")}
_BANNER = """SELECT 'banner' AS part, pair_id, 'figures per op are incomplete' || CASE WHEN a.n>0 THEN chr(10) || 'A: sampling was off ' || a.n || ' time(s)' ELSE '' END
    || CASE WHEN b.n>0 THEN chr(10) || 'B: sampling was off ' || b.n || ' time(s)' ELSE '' END AS name, a.n AS a, b.n AS b FROM pr JOIN ep a ON a.session_key=sa JOIN ep b ON b.session_key=sb WHERE a.n>0 OR b.n>0"""


@query("k7_compare", with_sql(TL + "," + profile._PAIRS + """,
   ep AS (SELECT session_key, count(*) FILTER (WHERE kind='MetalHookSkipped' AND k IN (10, 40)) AS n FROM tl GROUP BY 1)""", " UNION ALL ".join(
    f"SELECT '{part}' AS part, pair_id, {name} AS name, {a} AS a, {b} AS b FROM ({ORACLES[oracle]})" for part, (oracle, name, a, b) in _PARTS.items()) + " UNION ALL " + _BANNER))
def k7_compare(spark, sf):
    """All parts of the comparison of all pairs, with the banner of those whose figures are partial."""
    e = trace_log(spark, sf)
    pairs = cut_lineage(profile.session_pairs(e))
    parts = report.compare(pairs, e, cell=CELL, grace_ns=GRACE_NS)
    names = {"origin_deltas": F.concat_ws("@", "op_kind", "file_line"), "stats": F.col("root_cause_match").cast("string")}
    rows = [parts[part].select(F.lit(part).alias("part"), "pair_id", names.get(part, F.col(name) if "|" not in name and "(" not in name else F.lit(None)).alias("name"),
                               F.col(a).alias("a"), F.col(b).alias("b")) for part, (_, name, a, b) in _PARTS.items()]
    a, b = diff.pair_sides(pairs, filters.sampling_disable_episodes(e))
    both = a.withColumnRenamed("episodes", "a").join(b.withColumnRenamed("episodes", "b"), "pair_id")
    rows.append(parts["banner"].join(both, "pair_id").select(F.lit("banner").alias("part"), "pair_id", F.col("banner").alias("name"), "a", "b"))
    return reduce(DataFrame.unionByName, rows)


# --- live views ------------------------------------------------------------

_DELTA = TL + """, nn AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY event_ord) AS n FROM tl)"""


@query("m2_delta_totals", with_sql(_DELTA + """, dops AS (SELECT o.session_key, sum(o.gpu_ns) AS g FROM tl_ops o JOIN nn USING (event_ord) WHERE nn.n>40 GROUP BY 1)""", """
  SELECT t.session_key, count(*) AS cursor, least(40, count(*)) AS prev_cursor, greatest(0, count(*)-40) AS new_events, arg_max(ts, t.event_ord)-arg_min(ts, t.event_ord) AS elapsed_ns,
   count(*) FILTER (WHERE n>40 AND kind='MetalCbCompleted') AS new_cbs, coalesce(any_value(d.g), 0)::BIGINT AS gpu_ns_added,
   coalesce(arg_max(allocated, t.event_ord) FILTER (WHERE allocated IS NOT NULL), 0) AS current_bytes, coalesce(max(allocated), 0) AS peak_bytes_session,
   CASE WHEN 40>count(*) THEN 'cursor lies past the end and was set back' WHEN count(*)=40 THEN 'nothing new, the session is closed' ELSE 'the session is closed' END AS note
  FROM nn t LEFT JOIN dops d ON d.session_key=t.session_key GROUP BY 1"""))
def m2_delta_totals(spark, sf):
    return live.delta_summary(trace_log(spark, sf), 40)["totals"]


@query("m2_delta_top_ops", with_sql(_DELTA, """
  SELECT session_key, op_kind, count, gpu_ns, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY gpu_ns DESC, op_kind) AS rank FROM (
   SELECT o.session_key, coalesce(o.op_kind, o.symbol, o.name) AS op_kind, CAST(sum(o.cnt) AS BIGINT) AS count, CAST(sum(o.gpu_ns) AS BIGINT) AS gpu_ns
   FROM tl_ops o JOIN nn USING (event_ord) WHERE nn.n>40 GROUP BY 1, 2)) WHERE rank<=8"""))
def m2_delta_top_ops(spark, sf):
    return live.delta_summary(trace_log(spark, sf), 40)["top_ops"].withColumn("rank", F.col("rank").cast("bigint"))


@query("m4_events_per_second", with_sql(TL, """
  SELECT session_key, second, events FROM (SELECT session_key, wall//1000000000 AS second, count(*) AS events, max(wall//1000000000) OVER (PARTITION BY session_key) AS mx FROM tl GROUP BY 1, 2) WHERE second>=mx-86400"""))
def m4_events_per_second(spark, sf):
    return live.events_per_second(trace_log(spark, sf), keep_seconds=86_400)


@query("m5_hot_ops", with_sql(BUFFERS + f""", mx AS (SELECT session_key, max(ts) AS m FROM oe GROUP BY 1),
   ag AS (SELECT c.session_key, c.name, CAST(sum(c.ns) AS BIGINT) AS gpu_ns, CAST(sum(c.cnt) AS BIGINT) AS count FROM cops c JOIN oe USING (event_ord) JOIN mx ON mx.session_key=c.session_key WHERE c.ts>=mx.m-{5 * DAY} GROUP BY 1, 2)""", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY gpu_ns DESC, name) AS rank FROM ag) WHERE rank<=10"""))
def m5_hot_ops(spark, sf):
    return live.hot_ops(trace_log(spark, sf), window_ns=5 * DAY).withColumn("rank", F.col("rank").cast("bigint"))


@query("m8_queue_state", with_sql(TL, """
  SELECT q.session_key, q.queue_id, coalesce(q.depth, 0) AS depth, coalesce(f.n, 0) AS in_flight, f.cb AS oldest_cb_id, f.t AS oldest_commit_ts, q.status AS last_completed_status, q.err AS last_completed_error
  FROM (SELECT session_key, queue_id, arg_max(queue_depth, event_ord) FILTER (WHERE kind='MetalCbCommitted') AS depth, max(4) FILTER (WHERE kind='MetalCbCompleted') AS status,
     arg_max_null(error_code, event_ord) FILTER (WHERE kind='MetalCbCompleted') AS err FROM tl WHERE kind IN ('MetalCbCommitted','MetalCbCompleted') GROUP BY 1, 2) q
  LEFT JOIN (SELECT session_key, queue_id, count(*) AS n, arg_min(cb_id, (ts, cb_id)) AS cb, min(ts) AS t FROM (SELECT session_key, queue_id, cb_id, arg_max(kind, event_ord) AS kd, arg_max(ts, event_ord) AS ts
     FROM tl WHERE kind IN ('MetalCbCommitted','MetalCbCompleted') GROUP BY 1, 2, 3) WHERE kd='MetalCbCommitted' GROUP BY 1, 2) f USING (session_key, queue_id)"""))
def m8_queue_state(spark, sf):
    return live.queue_state(trace_log(spark, sf))


@query("m9_latest_values", with_sql(TL, """
  SELECT session_key, count(*) AS events_total, arg_max(cache_bytes, event_ord) FILTER (WHERE kind='MlxMemoryPoll') AS cache_bytes,
   coalesce(list_sort(list(DISTINCT stream) FILTER (WHERE stream IS NOT NULL)), []) AS streams_seen, max(ts) AS last_ts_mono_ns FROM tl GROUP BY 1"""))
def m9_latest_values(spark, sf):
    return live.latest_values(trace_log(spark, sf)).select(
        "session_key", "events_total", F.col("mlx_memory.cache_bytes").alias("cache_bytes"), "streams_seen", "last_ts_mono_ns")


@query("m10_recent_marks", with_sql(TL, """
  SELECT session_key, event_ord, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY event_ord DESC) AS rank FROM tl WHERE kind='Mark') WHERE rank<=2"""))
def m10_recent_marks(spark, sf):
    return live.recent_lists(trace_log(spark, sf), limits={"marks": 2})["marks"].select(
        "session_key", "event_ord", "label", F.col("rank").cast("bigint").alias("rank"))


@query("m11_state_as_of", with_sql(WINDOWS + f""", px AS (SELECT t.* FROM tl t JOIN (SELECT session_key, min(ts) AS t0 FROM tl GROUP BY 1) z USING (session_key) WHERE t.ts-z.t0<={10 * DAY})""", """
  SELECT session_key, count(*) AS events_total, arg_max(active_bytes, event_ord) FILTER (WHERE kind='MlxMemoryPoll') AS active_bytes, max(ts) AS last_ts_mono_ns FROM px GROUP BY 1"""))
def m11_state_as_of(spark, sf):
    return live.state_as_of(trace_log(spark, sf), 10 * DAY)["values"].select(
        "session_key", "events_total", F.col("mlx_memory.active_bytes").alias("active_bytes"), "last_ts_mono_ns")


_PX = f""", px AS (SELECT t.* FROM tl t JOIN (SELECT session_key, min(ts) AS t0 FROM tl GROUP BY 1) z USING (session_key) WHERE t.ts-z.t0<={10 * DAY})"""


def _as_of(name):
    """An oracle over the prefix instead of the whole log."""
    head, body = ORACLES[name].split(TL, 1)
    return head + TL + _PX + body.replace("FROM tl ", "FROM px ")


@query("m11_queues_as_of", _as_of("m8_queue_state"))
def m11_queues_as_of(spark, sf):
    return live.state_as_of(trace_log(spark, sf), 10 * DAY)["queues"]


@query("m11_marks_as_of", _as_of("m10_recent_marks").replace("<=2", "<=10"))
def m11_marks_as_of(spark, sf):
    return live.state_as_of(trace_log(spark, sf), 10 * DAY)["marks"].select("session_key", "event_ord", "label", F.col("rank").cast("bigint").alias("rank"))


@query("a14_snapshot", with_sql(TL + f""", px AS (SELECT t.* FROM tl t JOIN (SELECT session_key, min(ts) AS t0 FROM tl GROUP BY 1) z USING (session_key) WHERE t.ts-z.t0<={10 * DAY}),
   n AS (SELECT session_key, event_ord, CASE kind WHEN 'MlxEvalEntered' THEN 1 ELSE -1 END AS d, row_number() OVER (PARTITION BY session_key ORDER BY event_ord) AS i
     FROM px WHERE kind IN ('MlxEvalEntered','MlxEvalReturned')),
   walk AS (SELECT session_key, i, greatest(0, d) AS depth FROM n WHERE i=1
     UNION ALL SELECT n.session_key, n.i, greatest(0, w.depth+n.d) FROM walk w JOIN n ON n.session_key=w.session_key AND n.i=w.i+1)""", """
  SELECT p.session_key, count(*) AS events_total, coalesce(any_value(q.n), 0) AS queues, any_value(w.depth)::BIGINT AS mlx_eval_depth FROM px p
  LEFT JOIN (SELECT session_key, count(DISTINCT queue_id) AS n FROM px WHERE kind IN ('MetalCbCommitted','MetalCbCompleted') GROUP BY 1) q USING (session_key)
  LEFT JOIN (SELECT session_key, arg_max(depth, i) AS depth FROM walk GROUP BY 1) w USING (session_key) GROUP BY 1"""))
def a14_snapshot(spark, sf):
    s = live.snapshot(trace_log(spark, sf), 10 * DAY)
    return s.select("session_key", "events_total", F.coalesce(F.size("metal_queues"), F.lit(0)).cast("bigint").alias("queues"), "mlx_eval_depth")


@query("a13_first_report", """SELECT lang AS session_key, arg_min('/r/' || doc_id, '/r/' || doc_id) AS crash_report_path, octet_length(encode(arg_min(text, '/r/' || doc_id))) AS size_bytes FROM documents GROUP BY 1""")
def a13_first_report(spark, sf):
    d = table(spark, sf, "documents")
    s = d.select(F.col("lang").alias("session_key")).distinct()
    r = d.select(F.col("lang").alias("session_key"), F.concat(F.lit("/r/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return reports.first_report(s, r).select("session_key", "crash_report_path", F.col("size_bytes").cast("bigint").alias("size_bytes"))

