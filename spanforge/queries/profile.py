"""Profiling operators over the typed log derived from the events table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from spanforge.operators import diff, filters, gpu, memory, pairing, tree
from spanforge.operators.scan import chunk_of
from spanforge.plans import report, rules
from spanforge.queries.registry import ORACLES, query
from spanforge.queries.views import (ATTRIB, BUFFERS, GRACE_NS, HOUR_NS, TL, TREE, WINDOWS, trace_log, with_sql)

CELL = 8 * HOUR_NS
GAP = 24 * HOUR_NS
BUCKET_S = 86_400


def _breakdown(spark, sf):
    return report.Breakdown(trace_log(spark, sf), grace_ns=GRACE_NS, cell=CELL, chunk=chunk_of())


def _ctx(spark, sf):
    return rules.RuleContext(trace_log(spark, sf), grace_ns=GRACE_NS, cell=CELL, band_ns=GAP, gap_ns=GAP, chunk=chunk_of())


@query("c2_eval_windows", with_sql(WINDOWS, """
  SELECT session_key, call_id, t_in, t_out, enter_ord, ret_ord, frame AS top_frame, leaf FROM evals"""))
def c2_eval_windows(spark, sf):
    w = pairing.eval_windows(trace_log(spark, sf), grace_ns=GRACE_NS, chunk=chunk_of())
    return w.select("session_key", "call_id", "t_in", "t_out", "enter_ord", "ret_ord", "top_frame",
                    F.get("stack", F.size("stack") - 1).alias("leaf"))


@query("c3_scope_windows", with_sql(WINDOWS, "SELECT session_key, call_id, t_in, t_out, qualname, ret_ord FROM scopes"))
def c3_scope_windows(spark, sf):
    return pairing.scope_windows(trace_log(spark, sf)).select("session_key", "call_id", "t_in", "t_out", "qualname", "ret_ord")


@query("c4_malformed_returns", with_sql(WINDOWS, """
  SELECT session_key, CAST(sum(n) AS BIGINT) AS malformed_returns FROM (
    SELECT session_key, count(*) AS n FROM calls WHERE ret_ord IS NULL GROUP BY 1
    UNION ALL SELECT session_key, count(*) FROM tl r WHERE kind='ModuleReturned' AND NOT EXISTS (
      SELECT 1 FROM tl e WHERE e.session_key=r.session_key AND e.kind='ModuleEntered' AND e.module_call_id=r.module_call_id AND e.event_ord<r.event_ord) GROUP BY 1
    UNION ALL SELECT DISTINCT session_key, 0 FROM tl WHERE kind IN ('ModuleEntered','ModuleReturned')) GROUP BY 1"""))
def c4_malformed_returns(spark, sf):
    return pairing.malformed_returns(trace_log(spark, sf))


@query("c5_command_buffers", with_sql(BUFFERS, "SELECT session_key, comp_ord, cb_id, commit_ts, in_flight_ns, gpu_ns FROM buf"))
def c5_command_buffers(spark, sf):
    return gpu.command_buffers(trace_log(spark, sf)).select(
        "session_key", "comp_ord", "cb_id", "commit_ts", "in_flight_ns", "gpu_ns")


@query("c6_ops_attached", with_sql(BUFFERS, "SELECT session_key, event_ord, comp_ord, CAST(raw_ns AS BIGINT) AS raw_ns FROM oe"))
def c6_ops_attached(spark, sf):
    return gpu.clamped_ops(gpu.cb_events(trace_log(spark, sf))).select("session_key", "event_ord", "comp_ord", "raw_ns")


@query("c7_gpu_time_per_queue", with_sql(BUFFERS, """
  SELECT b.session_key, c.queue_id, count(*) AS n, CAST(sum(b.gpu_ns) AS BIGINT) AS gpu_ns FROM buf b JOIN comp c ON c.event_ord=b.comp_ord GROUP BY 1, 2"""))
def c7_gpu_time_per_queue(spark, sf):
    return gpu.command_buffers(trace_log(spark, sf)).groupBy("session_key", "queue_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gpu_ns").alias("gpu_ns"))


@query("f2_serialization_clamp", with_sql(BUFFERS, """
  SELECT event_ord, window_ns, round(scale, 6) AS scale, (SELECT CAST(sum(ns) AS BIGINT) FROM cops c WHERE c.event_ord=oe.event_ord) AS gpu_ns FROM oe"""))
def f2_serialization_clamp(spark, sf):
    return gpu.clamped_ops(gpu.cb_events(trace_log(spark, sf))).select(
        "event_ord", "window_ns", F.round("scale", 6).alias("scale"), "gpu_ns")


@query("c9_model_loads", with_sql(TL + """,
   lo AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY event_ord) - 1 AS idx FROM tl WHERE kind='ModelLoad'),
   r AS (SELECT t.*, lo.idx, lag(t.kind) OVER w AS pk, lag(lo.idx) OVER w AS pi, lead(t.kind) OVER w AS nk, lead(t.ts) OVER w AS nt
         FROM tl t LEFT JOIN lo USING (event_ord) WHERE t.kind IN ('ModelLoad','ModelUnload') WINDOW w AS (PARTITION BY t.session_key, t.path ORDER BY t.event_ord))""".replace("USING (event_ord)", "ON lo.event_ord=t.event_ord"), """
  SELECT session_key, idx AS load_index, path, greatest(0, ts-load_ns) AS t_start_ns, load_ns AS duration_ns,
    CASE WHEN pk='ModelLoad' THEN pi END AS duplicate_of, CASE WHEN nk='ModelUnload' THEN nt END AS unloaded_at_ns FROM r WHERE kind='ModelLoad'"""))
def c9_model_loads(spark, sf):
    return pairing.model_loads(trace_log(spark, sf)).select(
        "session_key", "load_index", "path", "t_start_ns", "duration_ns", "duplicate_of", "unloaded_at_ns")


@query("d4_attributed_buffers", with_sql(ATTRIB, "SELECT session_key, comp_ord, via, node_id, gpu_ns FROM att"))
def d4_attributed_buffers(spark, sf):
    return _breakdown(spark, sf).attributed.select("session_key", "comp_ord", "via", "node_id", "gpu_ns")


@query("e1_scope_totals", with_sql(ATTRIB, "SELECT session_key, node_id, qualname, gpu_ns_self, eval_count, cb_count FROM totals"))
def e1_scope_totals(spark, sf):
    return _breakdown(spark, sf).totals.select("session_key", "node_id", "qualname", "gpu_ns_self", "eval_count", "cb_count")


@query("e2_breakdown_tree", with_sql(TREE, """
  SELECT n.session_key, node_id, qualname, depth, gpu_ns_self, gpu_ns_subtree, g.grand AS grand_total_ns FROM nodes n
  JOIN (SELECT session_key, CAST(sum(gpu_ns_subtree) AS BIGINT) AS grand FROM nodes WHERE depth=0 GROUP BY 1) g USING (session_key)"""))
def e2_breakdown_tree(spark, sf):
    return _breakdown(spark, sf).tree.select(
        "session_key", "node_id", "qualname", "depth", "gpu_ns_self", "gpu_ns_subtree", "grand_total_ns")


@query("e3_ops_per_node", with_sql(TREE, "SELECT session_key, node_id, name, gpu_ns, count, symbol, op_kind FROM nopk"))
def e3_ops_per_node(spark, sf):
    return _breakdown(spark, sf).ops


@query("e4_diagnostics", with_sql(TREE, """
  SELECT s.session_key, coalesce(u.ns, 0)::BIGINT AS unscoped_gpu_ns, coalesce(u.um, 0)::BIGINT AS unmatched_cb_count,
    coalesce(m.n, 0)::BIGINT AS malformed_returns, coalesce(u.ws, 0)::BIGINT AS ops_cbs_without_samples, coalesce(u.sc, 0)::BIGINT AS cbs_scope_attributed,
    coalesce(c.n, 0)::BIGINT AS cbs_op_time_clamped
  FROM (SELECT DISTINCT session_key FROM tl) s
  LEFT JOIN (SELECT session_key, sum(CASE WHEN node_id=-1 THEN gpu_ns ELSE 0 END) AS ns, count(*) FILTER (WHERE via='unmatched') AS um,
     count(*) FILTER (WHERE sampled AND ops_ord IS NULL) AS ws, count(*) FILTER (WHERE via='scope') AS sc FROM att GROUP BY 1) u USING (session_key)
  LEFT JOIN (SELECT session_key, sum(n) AS n FROM (SELECT session_key, count(*) AS n FROM calls WHERE ret_ord IS NULL GROUP BY 1
     UNION ALL SELECT session_key, count(*) FROM tl WHERE kind='ModuleReturned' AND module_call_id=-7 GROUP BY 1) GROUP BY 1) m USING (session_key)
  LEFT JOIN (SELECT session_key, count(*) AS n FROM oe WHERE scale IS NOT NULL GROUP BY 1) c USING (session_key)"""))
def e4_diagnostics(spark, sf):
    return _breakdown(spark, sf).diagnostics()


_FLAT_KIND = TREE + """,
 flat AS (SELECT session_key, coalesce(op_kind, symbol, name) AS key, CAST(sum(gpu_ns) AS BIGINT) AS gpu_ns, CAST(sum(count) AS BIGINT) AS count,
   min(op_kind) AS op_kind FROM nopk GROUP BY 1, 2)"""


@query("e5_ops_flat_by_name", with_sql(TREE, """
  SELECT session_key, name AS key, CAST(sum(gpu_ns) AS BIGINT) AS gpu_ns, CAST(sum(count) AS BIGINT) AS count, min(symbol) AS symbol, min(op_kind) AS op_kind FROM nopk GROUP BY 1, 2"""))
def e5_ops_flat_by_name(spark, sf):
    return gpu.ops_flat(_breakdown(spark, sf).ops)


@query("e5_ops_flat_by_kind", with_sql(_FLAT_KIND, "SELECT session_key, key, gpu_ns, count, op_kind FROM flat"))
def e5_ops_flat_by_kind(spark, sf):
    return gpu.ops_flat(_breakdown(spark, sf).ops, group_by="kind").drop("symbol")


@query("e6_ops_per_node_by_kind", with_sql(TREE, """
  SELECT session_key, node_id, coalesce(op_kind, symbol, name) AS key, CAST(sum(gpu_ns) AS BIGINT) AS gpu_ns, CAST(sum(count) AS BIGINT) AS count, max(op_kind) AS op_kind
  FROM nopk GROUP BY 1, 2, 3"""))
def e6_ops_per_node_by_kind(spark, sf):
    return gpu.node_ops_by_kind(_breakdown(spark, sf).ops)


@query("e7_op_summary", with_sql(_FLAT_KIND, """
  SELECT session_key, key, gpu_ns, rank, round(gpu_ns*100.0::DOUBLE/greatest(1, total), 4) AS pct FROM (
    SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY gpu_ns DESC, key) AS rank, sum(gpu_ns) OVER (PARTITION BY session_key) AS total FROM flat) WHERE rank<=10"""))
def e7_op_summary(spark, sf):
    flat = gpu.ops_flat(_breakdown(spark, sf).ops, group_by="kind")
    return gpu.op_summary(flat).select("session_key", "key", "gpu_ns", F.col("rank").cast("bigint").alias("rank"),
                                       F.round("pct", 4).alias("pct"))


_ORIGINS = BUFFERS + f""",
 he AS (SELECT o.event_ord, arg_max(e.frame, (e.t_in, e.ret_ord)) AS frame FROM oe o JOIN evals e ON e.session_key=o.session_key
    AND e.frame IS NOT NULL AND o.ts BETWEEN e.t_in AND e.t_out GROUP BY 1),
 hs AS (SELECT o.event_ord, arg_max(s.qualname, (s.t_in, s.enter_ord)) AS q FROM oe o JOIN scopes s ON s.session_key=o.session_key
    AND o.ts BETWEEN s.t_in AND s.t_out + {GRACE_NS} GROUP BY 1),
 origins AS (SELECT c.session_key, coalesce(c.op_kind, c.symbol, c.name) AS op_kind, coalesce(he.frame, 'scope:' || hs.q) AS file_line,
    CAST(sum(c.ns) AS BIGINT) AS gpu_ns, CAST(sum(c.cnt) AS BIGINT) AS dispatch_count FROM cops c LEFT JOIN he USING (event_ord) LEFT JOIN hs USING (event_ord)
    WHERE he.frame IS NOT NULL OR hs.q IS NOT NULL GROUP BY 1, 2, 3)"""


@query("e8_dispatch_origins", with_sql(_ORIGINS, "SELECT * FROM origins"))
def e8_dispatch_origins(spark, sf):
    return gpu.dispatch_origins(trace_log(spark, sf), grace_ns=GRACE_NS, cell=CELL, chunk=chunk_of())


_SPANS = WINDOWS + f""",
 spans AS (SELECT session_key, call_id, qualname, enter_ord, t_in, CASE WHEN ret_ts IS NOT NULL THEN ret_ts + {GRACE_NS} ELSE t_out END AS t_end FROM scopes),
 sm AS (SELECT s.session_key, s.call_id, s.qualname, s.enter_ord, coalesce(max(m.allocated), 0) AS peak, coalesce(CAST(sum(m.allocated) // count(m.allocated) AS BIGINT), 0) AS avg,
    coalesce(arg_max(m.allocated, m.event_ord), 0) AS last, count(m.allocated) AS n FROM spans s LEFT JOIN tl m ON m.session_key=s.session_key
    AND m.kind='MetalDeviceMemSample' AND m.event_ord>s.enter_ord AND m.ts<=s.t_end GROUP BY 1, 2, 3, 4),
 smem AS (SELECT session_key, qualname, peak AS peak_bytes, avg AS avg_bytes, last AS end_bytes, n AS sample_count FROM (
    SELECT *, row_number() OVER (PARTITION BY session_key, qualname ORDER BY peak DESC, enter_ord) AS rn FROM sm) WHERE rn=1)"""


@query("e9_scope_memory", with_sql(_SPANS, "SELECT * FROM smem"))
def e9_scope_memory(spark, sf):
    return memory.scope_memory(trace_log(spark, sf), grace_ns=GRACE_NS, cell=CELL)


@query("e10_scope_heap", with_sql(_SPANS + """,
   hr AS (SELECT *, lag(kind) OVER w AS pk, lag(size_bytes) OVER w AS ps FROM tl WHERE kind IN ('MetalHeapAlloc','MetalHeapFree')
          WINDOW w AS (PARTITION BY session_key, heap_id ORDER BY event_ord)),
   st AS (SELECT session_key, event_ord, ts, CAST(sum((kind='MetalHeapAlloc')::INT - coalesce(pk='MetalHeapAlloc', false)::INT) OVER w AS BIGINT) AS n,
     CAST(sum(coalesce(size_bytes, 0) - CASE WHEN pk='MetalHeapAlloc' THEN ps ELSE 0 END) OVER w AS BIGINT) AS b FROM hr WINDOW w AS (PARTITION BY session_key ORDER BY event_ord)),
   pk AS (SELECT s.session_key, s.qualname, s.enter_ord, greatest(coalesce(max(i.n), 0), coalesce((SELECT arg_max(x.n, x.event_ord) FROM st x WHERE x.session_key=s.session_key AND x.event_ord<s.enter_ord), 0)) AS n,
     greatest(coalesce(max(i.b), 0), coalesce((SELECT arg_max(x.b, x.event_ord) FROM st x WHERE x.session_key=s.session_key AND x.event_ord<s.enter_ord), 0)) AS b
     FROM spans s LEFT JOIN st i ON i.session_key=s.session_key AND i.event_ord>s.enter_ord AND i.ts<=s.t_end GROUP BY 1, 2, 3)""", """
  SELECT session_key, qualname, n AS peak_heap_count, b AS peak_heap_bytes FROM (SELECT *, row_number() OVER (PARTITION BY session_key, qualname ORDER BY b DESC, enter_ord) AS rn FROM pk) WHERE rn=1"""))
def e10_scope_heap(spark, sf):
    return memory.scope_heap(trace_log(spark, sf), grace_ns=GRACE_NS, cell=CELL)


@query("e11_allocator_summary", with_sql(TL, """
  SELECT session_key, max(active_bytes) AS peak_active_bytes, max(peak_bytes) AS peak_reported_bytes, max(cache_bytes) AS peak_cache_bytes,
    arg_max(cache_bytes, event_ord) AS end_cache_bytes, count(*) AS sample_count FROM tl WHERE kind='MlxMemoryPoll' GROUP BY 1"""))
def e11_allocator_summary(spark, sf):
    return memory.allocator_summary(trace_log(spark, sf))


@query("e12_footprint_summary", with_sql(TL, """
  SELECT session_key, proc_pid AS pid, arg_min(name, event_ord) AS name, max(phys) AS peak_bytes, max(lifetime_max) AS lifetime_max_bytes,
    arg_min(is_root, event_ord) AS is_traced_root, count(*) AS sample_count FROM tl WHERE kind='ProcFootprint' GROUP BY 1, 2"""))
def e12_footprint_summary(spark, sf):
    return memory.footprint_summary(trace_log(spark, sf))


@query("e13_memory_timeline", with_sql(WINDOWS + f""",
   b AS (SELECT t.session_key, (t.ts-e.t0)//{BUCKET_S * 10**9} AS i, max(active_bytes) AS a, max(cache_bytes) AS c, max(allocated) AS d, max(budget) AS r
      FROM tl t JOIN ends e USING (session_key) WHERE kind IN ('MlxMemoryPoll','MetalDeviceMemSample') GROUP BY 1, 2),
   g AS (SELECT session_key, unnest(generate_series(0, max(i))) AS i FROM b GROUP BY 1)""", f"""
  SELECT g.session_key, g.i*{BUCKET_S} AS t_start_s, (g.i+1)*{BUCKET_S} AS t_end_s, coalesce(a, 0) AS active_bytes, coalesce(c, 0) AS cache_bytes,
    coalesce(d, 0) AS device_alloc_bytes, coalesce(r, 0) AS recommended_max_bytes FROM g LEFT JOIN b ON b.session_key=g.session_key AND b.i=g.i"""))
def e13_memory_timeline(spark, sf):
    return memory.memory_timeline(trace_log(spark, sf), bucket_seconds=BUCKET_S)


_OVER = WINDOWS + f""",
 q AS (SELECT *, lag(ts) OVER (PARTITION BY session_key ORDER BY event_ord) AS p FROM tl WHERE kind='MetalDeviceMemSample' AND allocated::DOUBLE/budget>=0.9),
 g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts-p>{GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY event_ord) AS isl FROM q),
 ov0 AS (SELECT session_key, isl::BIGINT AS island, min(ts) AS t0w, max(ts) AS t1w, max(allocated) AS peak_bytes, arg_max(event_ord, (allocated, -event_ord)) AS peak_ord FROM g GROUP BY 1, 2),
 ov AS (SELECT o.*, coalesce((SELECT arg_max(c.qualname, c.enter_ord) FROM calls c WHERE c.session_key=o.session_key AND c.enter_ord<o.peak_ord
     AND (c.ret_ord IS NULL OR c.ret_ord>o.peak_ord)), '<unscoped>') AS peak_scope FROM ov0 o)"""


@query("f1_over_budget_windows", with_sql(_OVER, """
  SELECT session_key, island, t0w AS start_ts_mono_ns, t1w AS end_ts_mono_ns, peak_bytes, peak_ord AS peak_seq, peak_scope, round(peak_bytes::DOUBLE/500000000, 6) AS peak_ratio FROM ov"""))
def f1_over_budget_windows(spark, sf):
    return memory.over_budget_windows(trace_log(spark, sf), gap_ns=GAP).select(
        "session_key", "island", "start_ts_mono_ns", "end_ts_mono_ns", "peak_bytes", "peak_seq", "peak_scope",
        F.round("peak_ratio", 6).alias("peak_ratio"))


@query("e13_timeline_windows", with_sql(_OVER, """
  SELECT o.session_key, island, (t0w-e.t0)//1000000000 AS t_start_s, (t1w-e.t0)//1000000000 AS t_end_s, peak_bytes,
    CAST(round(peak_bytes::DOUBLE/500000000*100) AS BIGINT) AS peak_pct, peak_scope FROM ov o JOIN ends e USING (session_key)"""))
def e13_timeline_windows(spark, sf):
    return memory.timeline_windows(trace_log(spark, sf), gap_ns=GAP)


@query("e14_session_stats", with_sql(TL, """
  SELECT session_key, count(*) AS event_count, greatest(0, arg_max(ts, event_ord)-arg_min(ts, event_ord)) AS duration_ns FROM tl GROUP BY 1"""))
def e14_session_stats(spark, sf):
    return diff.session_stats(trace_log(spark, sf))


@query("e14_source_counts", with_sql(TL, "SELECT session_key, source, count(*) AS count FROM tl GROUP BY 1, 2"))
def e14_source_counts(spark, sf):
    return diff.source_counts(trace_log(spark, sf))


@query("e15_counts_by_kind", with_sql(TL, "SELECT session_key, kind, count(*) AS count FROM tl GROUP BY 1, 2"))
def e15_counts_by_kind(spark, sf):
    return filters.counts_by_kind(trace_log(spark, sf))


@query("e16_lazy_attribution_gap", with_sql(ATTRIB + """,
   l AS (SELECT a.session_key, CASE WHEN a.gpu_ns>0 AND a.eval_ord IS NOT NULL AND a.eval_leaf IS NULL THEN a.eval_ord END AS e, a.gpu_ns FROM att a)""", """
  SELECT l.session_key, CAST(sum(CASE WHEN e IS NOT NULL THEN gpu_ns ELSE 0 END) AS BIGINT) AS gap_gpu_ns, CAST(sum(gpu_ns) AS BIGINT) AS total_gpu_ns,
    count(DISTINCT e) AS lazy_eval_count, min(e) AS first_seq, coalesce(any_value(m.n), 0) AS module_call_count
  FROM l LEFT JOIN (SELECT session_key, count(*) AS n FROM calls GROUP BY 1) m USING (session_key) GROUP BY 1
  HAVING min(e) IS NOT NULL AND sum(CASE WHEN e IS NOT NULL THEN gpu_ns ELSE 0 END)*100 // sum(gpu_ns) >= 50"""))
def e16_lazy_attribution_gap(spark, sf):
    return rules.lazy_gap(_ctx(spark, sf)).select(
        "session_key", "gap_gpu_ns", "total_gpu_ns", "lazy_eval_count", "first_seq", "module_call_count")


_PAIRS = """ pr AS (SELECT 'u' || (2*i) AS sa, 'u' || (2*i+1) AS sb, i AS pair_id FROM (SELECT DISTINCT CAST(substr(session_key, 2) AS BIGINT)//2 AS i FROM tl))"""


def session_pairs(events):
    """Neighbouring sessions as A/B pairs."""
    i = F.call_function("div", F.substring("session_key", 2, 10).cast("bigint"), F.lit(2))
    return events.select(i.alias("pair_id")).distinct().select(
        "pair_id", F.concat(F.lit("u"), (F.col("pair_id") * 2).cast("string")).alias("session_a"),
        F.concat(F.lit("u"), (F.col("pair_id") * 2 + 1).cast("string")).alias("session_b"))


def _delta_sql(rel, on, value, how="JOIN", unit="ns"):
    keys = ", ".join(on)
    a = f"SELECT pair_id, {keys}, {value} AS v FROM pr JOIN {rel} r ON r.session_key=pr.sa"
    b = f"SELECT pair_id, {keys}, {value} AS v FROM pr JOIN {rel} r ON r.session_key=pr.sb"
    return f"""SELECT pair_id, {keys}, coalesce(a.v, 0) AS a_{value}, coalesce(b.v, 0) AS b_{value}, coalesce(b.v, 0)-coalesce(a.v, 0) AS delta_{unit},
      round(CASE WHEN coalesce(a.v, 0)<>0 THEN (coalesce(b.v, 0)-a.v)::DOUBLE/a.v*100 END, 4) AS delta_pct FROM ({a}) a {how} ({b}) b USING (pair_id, {keys})"""


def _rounded(df):
    return df.withColumn("delta_pct", F.round("delta_pct", 4))


_SCOPEMAP = TREE + "," + _PAIRS + ", smap AS (SELECT session_key, qualname, CAST(sum(gpu_ns_subtree) AS BIGINT) AS gpu_ns FROM nodes GROUP BY 1, 2)"


@query("d12_scope_deltas", with_sql(_SCOPEMAP, _delta_sql("smap", ["qualname"], "gpu_ns")))
def d12_scope_deltas(spark, sf):
    b = _breakdown(spark, sf)
    return _rounded(diff.diff_scopes(session_pairs(b.events), b.tree)["deltas"])


@query("d14_scopes_only_in_a", with_sql(_SCOPEMAP, """
  SELECT pair_id, qualname, gpu_ns FROM pr JOIN smap r ON r.session_key=pr.sa WHERE NOT EXISTS (SELECT 1 FROM smap x WHERE x.session_key=pr.sb AND x.qualname=r.qualname)"""))
def d14_scopes_only_in_a(spark, sf):
    b = _breakdown(spark, sf)
    return diff.diff_scopes(session_pairs(b.events), b.tree)["only_in_a"]


@query("d13_op_deltas", with_sql(TREE + "," + _PAIRS + """, rops AS (SELECT n.* FROM nopk n JOIN nodes d ON d.session_key=n.session_key AND d.node_id=n.node_id),
   omap AS (SELECT session_key, coalesce(op_kind, symbol, name) AS op_kind, CAST(sum(gpu_ns) AS BIGINT) AS gpu_ns FROM rops GROUP BY 1, 2)""",
                                 _delta_sql("omap", ["op_kind"], "gpu_ns", "FULL OUTER JOIN")))
def d13_op_deltas(spark, sf):
    b = _breakdown(spark, sf)
    return _rounded(diff.diff_ops(session_pairs(b.events), b.reachable_ops()))


@query("d12_memory_deltas", with_sql(_SPANS + "," + _PAIRS, _delta_sql("smem", ["qualname"], "peak_bytes", unit="bytes")))
def d12_memory_deltas(spark, sf):
    e = trace_log(spark, sf)
    return _rounded(diff.diff_memory(session_pairs(e), memory.scope_memory(e, grace_ns=GRACE_NS, cell=CELL)))


@query("d12_origin_deltas", with_sql(_ORIGINS + "," + _PAIRS, _delta_sql("origins", ["op_kind", "file_line"], "gpu_ns")))
def d12_origin_deltas(spark, sf):
    e = trace_log(spark, sf)
    return _rounded(diff.diff_origins(session_pairs(e), gpu.dispatch_origins(e, grace_ns=GRACE_NS, cell=CELL, chunk=chunk_of())))


@query("g2_tree_table", with_sql(TREE, """
  SELECT session_key, node_id, depth, rank, rows_total, round(gpu_ns_subtree*100.0::DOUBLE/greatest(1, grand), 4) AS pct FROM (
   SELECT n.*, g.grand, row_number() OVER (PARTITION BY n.session_key ORDER BY gpu_ns_subtree DESC, node_id) AS rank, count(*) OVER (PARTITION BY n.session_key) AS rows_total
   FROM nodes n JOIN (SELECT session_key, sum(gpu_ns_subtree) AS grand FROM nodes WHERE depth=0 GROUP BY 1) g ON g.session_key=n.session_key WHERE depth<=3) WHERE rank<=5"""))
def g2_tree_table(spark, sf):
    return tree.tree_table(_breakdown(spark, sf).tree, top=5).select(
        "session_key", "node_id", "depth", F.col("rank").cast("bigint").alias("rank"), "rows_total", F.round("pct", 4).alias("pct"))


@query("g3_tree_prune", with_sql(TREE + """,
   s0 AS (SELECT * FROM nodes WHERE depth<4),
   low AS (SELECT session_key, node_id FROM s0 WHERE gpu_ns_subtree<1),
   s1 AS (SELECT * FROM s0 s WHERE NOT EXISTS (SELECT 1 FROM low l WHERE l.session_key=s.session_key AND list_contains(s.path, l.node_id))),
   r AS (SELECT *, row_number() OVER (PARTITION BY session_key, coalesce(parent_call_id, -99) ORDER BY gpu_ns_subtree DESC, node_id) AS rn FROM s1),
   cut AS (SELECT session_key, node_id FROM r WHERE rn>2)""", """
  SELECT session_key, node_id, depth, gpu_ns_subtree FROM s1 s WHERE NOT EXISTS (SELECT 1 FROM cut l WHERE l.session_key=s.session_key AND list_contains(s.path, l.node_id))"""))
def g3_tree_prune(spark, sf):
    return tree.prune(_breakdown(spark, sf).tree, max_depth=4, min_ns=1, top_n=2).select(
        "session_key", "node_id", "depth", "gpu_ns_subtree")


@query("g4_field_filter", with_sql(TREE + ", m AS (SELECT session_key, unnest(path) AS node_id FROM nodes WHERE k%4=2)",
    "SELECT DISTINCT n.session_key, n.node_id, n.qualname FROM nodes n JOIN m ON m.session_key=n.session_key AND m.node_id=n.node_id"))
def g4_field_filter(spark, sf):
    return tree.field_filter(_breakdown(spark, sf).tree, {"step": ("int", "2")}).select("session_key", "node_id", "qualname")


@query("g5_top_ops_per_node", with_sql(TREE, """
  SELECT session_key, node_id, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_key, node_id ORDER BY gpu_ns DESC, name) AS rank FROM nopk) WHERE rank<=2"""))
def g5_top_ops_per_node(spark, sf):
    return tree.top_ops_per_node(_breakdown(spark, sf).ops, 2).select(
        "session_key", "node_id", "name", F.col("rank").cast("bigint").alias("rank"))


@query("a11_folded_stacks", with_sql(TREE, """
  SELECT n.session_key, (SELECT string_agg(q.qualname, ';' ORDER BY x.i) FROM (SELECT unnest(n.path) AS id, generate_subscripts(n.path, 1) AS i) x
     JOIN nodes q ON q.session_key=n.session_key AND q.node_id=x.id) || ' ' || n.gpu_ns_self AS line FROM nodes n WHERE gpu_ns_self>0"""))
def a11_folded_stacks(spark, sf):
    return tree.folded_stacks(_breakdown(spark, sf).tree)


@query("l8_breakdown_trace", with_sql(TREE + """,
   d AS (SELECT *, greatest(1, gpu_ns_subtree//1000) AS dur FROM nodes),
   o AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY session_key, coalesce(parent_call_id, -99) ORDER BY gpu_ns_subtree DESC, node_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM d),
   st AS (SELECT n.session_key, n.node_id, any_value(n.qualname) AS qualname, any_value(n.depth) AS depth, any_value(n.dur) AS dur, sum(a.off) AS ts
       FROM (SELECT *, unnest(path) AS anc FROM d) n JOIN o a ON a.session_key=n.session_key AND a.node_id=n.anc GROUP BY 1, 2),
   oo AS (SELECT *, greatest(1, gpu_ns//1000) AS dur, coalesce(sum(greatest(1, gpu_ns//1000)) OVER (PARTITION BY session_key, node_id ORDER BY gpu_ns DESC, name
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM nopk)""", """
  SELECT session_key, qualname AS name, CAST(ts AS BIGINT) AS ts, CAST(dur AS BIGINT) AS dur, CAST(depth AS BIGINT) AS tid FROM st
  UNION ALL SELECT oo.session_key, oo.name, CAST(st.ts+oo.off AS BIGINT), CAST(oo.dur AS BIGINT), CAST(st.depth+1 AS BIGINT) FROM oo JOIN st ON st.session_key=oo.session_key AND st.node_id=oo.node_id"""))
def l8_breakdown_trace(spark, sf):
    b = _breakdown(spark, sf)
    return tree.breakdown_trace(b.tree, b.reachable_ops()).select(
        "session_key", "name", "ts", "dur", F.col("tid").cast("bigint").alias("tid"))


@query("k5_breakdown_response", with_sql(TREE + ", keep AS (SELECT * FROM nodes WHERE depth<1 AND gpu_ns_subtree>=1)", """
  SELECT o.session_key, o.node_id, o.key AS name, o.gpu_ns, o.rank FROM (SELECT *, row_number() OVER (PARTITION BY session_key, node_id ORDER BY gpu_ns DESC, key) AS rank FROM (
    SELECT session_key, node_id, coalesce(op_kind, symbol, name) AS key, CAST(sum(gpu_ns) AS BIGINT) AS gpu_ns FROM nopk GROUP BY 1, 2, 3)) o
  JOIN keep k ON k.session_key=o.session_key AND k.node_id=o.node_id WHERE o.rank<=2"""))
def k5_breakdown_response(spark, sf):
    _, ops = _breakdown(spark, sf).response(max_depth=1, min_ns=1, group_by="kind", top_ops=2)
    return ops.select("session_key", "node_id", "name", "gpu_ns", F.col("rank").cast("bigint").alias("rank"))


@query("k6_memory_notes", with_sql(TL, """
  SELECT session_key, max(CASE WHEN kind='MetalCbCompleted' THEN 1 ELSE 0 END) AS has_gpu FROM tl GROUP BY 1
  HAVING count(*) FILTER (WHERE kind IN ('ModuleEntered','MlxEvalEntered'))=0"""))
def k6_memory_notes(spark, sf):
    notes = report.memory_response(trace_log(spark, sf), cell=CELL, grace_ns=GRACE_NS)["notes"]
    return notes.select("session_key", F.when(F.col("note").contains("captured"), 1).otherwise(0).alias("has_gpu"))


_MEMORY = {"scope_memory": ("e9_scope_memory", "qualname", "peak_bytes"), "heap_memory": ("e10_scope_heap", "qualname", "peak_heap_bytes"),
           "timeline": ("e13_memory_timeline", "t_start_s", "device_alloc_bytes"), "windows": ("e13_timeline_windows", "peak_scope", "peak_bytes"),
           "process_footprint": ("e12_footprint_summary", "name", "peak_bytes"), "allocator": ("e11_allocator_summary", "sample_count", "peak_active_bytes"),
           "notes": ("k6_memory_notes", "'note'", "0")}


@query("k6_memory_response", " UNION ALL ".join(
    f"SELECT '{part}' AS part, session_key, CAST({name} AS VARCHAR) AS name, CAST({value} AS BIGINT) AS value FROM ({ORACLES[oracle]})"
    for part, (oracle, name, value) in _MEMORY.items()))
def k6_memory_response(spark, sf):
    """All seven parts of the memory response: each row's name and main figure."""
    parts = report.memory_response(trace_log(spark, sf), cell=CELL, grace_ns=GRACE_NS, bucket_seconds=BUCKET_S, gap_ns=GAP)
    shown = lambda c: F.lit(c[1:-1]) if c.startswith("'") else F.col(c)
    rows = [parts[part].select(F.lit(part).alias("part"), "session_key", shown(name).cast("string").alias("name"),
                               (F.lit(0) if value == "0" else F.col(value)).cast("bigint").alias("value")) for part, (_, name, value) in _MEMORY.items()]
    return reduce(DataFrame.unionByName, rows)


@query("d14_scopes_only_in_b", with_sql(_SCOPEMAP, """
  SELECT pair_id, qualname, gpu_ns FROM pr JOIN smap r ON r.session_key=pr.sb WHERE NOT EXISTS (SELECT 1 FROM smap x WHERE x.session_key=pr.sa AND x.qualname=r.qualname)"""))
def d14_scopes_only_in_b(spark, sf):
    b = _breakdown(spark, sf)
    return diff.diff_scopes(session_pairs(b.events), b.tree)["only_in_b"]
