"""Views over the driver's tables that the registered queries run on.

``ev`` is the events table as a generic log; ``trace_log`` gives every one of
its rows a profiling role, so the typed operators run over the whole table.
Each view exists twice: as a DataFrame and as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanforge.operators.scan import chunk_of, with_running
from spanforge.schema import EVENT
from spanforge.session_conf import cut_lineage

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01
HOUR_NS = 3_600_000_000_000
HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_key, event_ord, t (microseconds since 2024), cents, k, typ."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("session_key"), F.col("event_id").alias("event_ord"),
        (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US).alias("t"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("k"),
        F.col("event_type").alias("typ"))


EV = f"""ev AS (
  SELECT user_id AS session_key, event_id AS event_ord, epoch_us(ts) - {EPOCH_US} AS t,
         CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, event_type AS typ
  FROM events)"""


def _kind(typ, k, user):
    # one session in ten has no runtime agent, every other of those no GPU either
    return (
        F.when((user % 10 == 9) & (typ == "click"), "VmSample").when((user % 10 == 9) & (typ == "view"), "ThermalState")
        .when((user % 20 == 19) & (typ == "error"), "VmSample")
        .when((typ == "click") & (k % 2 == 0), "ModuleEntered").when(typ == "click", "MlxEvalEntered")
        .when((typ == "view") & (k % 2 == 0), "ModuleReturned").when(typ == "view", "MlxEvalReturned")
        .when((typ == "purchase") & (k % 3 == 0), "MetalCbCommitted")
        .when((typ == "purchase") & (k % 3 == 1), "MetalCbScheduled").when(typ == "purchase", "MetalCbOps")
        .when((typ == "error") & (k % 2 == 0), "MetalCbCompleted")
        .when((typ == "error") & (k % 6 == 5), "MlxMemoryPoll").when(typ == "error", "MetalDeviceMemSample")
        .when(k % 10 == 5, "Mark").when(k % 30 == 0, "ProcTop").when(k % 30 == 10, "MetalHookSkipped")
        .when(k % 5 == 0, "MetalHookDropped").when(k % 5 == 1, "ModelLoad").when(k % 5 == 2, "ModelUnload")
        .when((k % 5 == 3) & (k % 10 == 3), "MetalHeapAlloc").when(k % 5 == 3, "MetalHeapFree")
        .otherwise("ProcFootprint"))


_KIND_SQL = """CASE
  WHEN session_key%10=9 AND typ='click' THEN 'VmSample' WHEN session_key%10=9 AND typ='view' THEN 'ThermalState'
  WHEN session_key%20=19 AND typ='error' THEN 'VmSample'
  WHEN typ='click' AND k%2=0 THEN 'ModuleEntered' WHEN typ='click' THEN 'MlxEvalEntered'
  WHEN typ='view' AND k%2=0 THEN 'ModuleReturned' WHEN typ='view' THEN 'MlxEvalReturned'
  WHEN typ='purchase' AND k%3=0 THEN 'MetalCbCommitted' WHEN typ='purchase' AND k%3=1 THEN 'MetalCbScheduled'
  WHEN typ='purchase' THEN 'MetalCbOps'
  WHEN typ='error' AND k%2=0 THEN 'MetalCbCompleted' WHEN typ='error' AND k%6=5 THEN 'MlxMemoryPoll'
  WHEN typ='error' THEN 'MetalDeviceMemSample'
  WHEN k%10=5 THEN 'Mark' WHEN k%30=0 THEN 'ProcTop' WHEN k%30=10 THEN 'MetalHookSkipped' WHEN k%5=0 THEN 'MetalHookDropped'
  WHEN k%5=1 THEN 'ModelLoad' WHEN k%5=2 THEN 'ModelUnload'
  WHEN k%5=3 AND k%10=3 THEN 'MetalHeapAlloc' WHEN k%5=3 THEN 'MetalHeapFree'
  ELSE 'ProcFootprint' END"""


def _source(kind):
    return (F.when(kind.startswith("Metal"), "MetalHook").when(kind == "Mark", "Mark")
            .when(kind.isin("ProcFootprint", "ProcTop"), "Proc").when(kind == "VmSample", "Vm")
            .when(kind == "ThermalState", "Thermal").otherwise("PythonSidecar"))


_SOURCE_SQL = """CASE WHEN kind LIKE 'Metal%' THEN 'MetalHook' WHEN kind='Mark' THEN 'Mark'
  WHEN kind IN ('ProcFootprint','ProcTop') THEN 'Proc' WHEN kind='VmSample' THEN 'Vm' WHEN kind='ThermalState' THEN 'Thermal' ELSE 'PythonSidecar' END"""


_INGESTED: dict[tuple[str, str], DataFrame] = {}


def trace_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed event log with one row per row of the events table.

    Ingested once per application into the shared folder, as a recorded log is.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INGESTED:
        _INGESTED[key] = cut_lineage(_trace_rows(spark, sf_dir))
    return _INGESTED[key]


def _trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev(spark, sf_dir).withColumn("kind", _kind(F.col("typ"), F.col("k"), F.col("session_key")))
    # the id of the latest scope enter, for returns and eval stacks; of the one
    # before it, for parents
    e = with_running(e, ["session_key"], ["event_ord"], {
        "_open": ("last", F.when(F.col("kind") == "ModuleEntered", F.col("event_ord")))},
        chunk=chunk_of(), before=True)
    k, kind, cents = F.col("k"), F.col("kind"), F.col("cents")
    is_kind = lambda *names: kind.isin(*names)
    lane = F.call_function("div", k, F.lit(6)) % 3
    stack = F.when((k % 4 == 1) | F.col("_open").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("_open"))
    frames = F.when(k % 3 == 0, F.array(F.struct(
        F.concat(F.lit("/src/f"), (k % 4).cast("string"), F.lit(".py")).alias("filename"), k.alias("lineno"),
        F.lit("fn").alias("funcname")))).otherwise(F.array().cast(EVENT["stack_frames"].dataType))
    symbol = (F.when(k % 4 == 0, "steel_gemm_f32").when(k % 4 == 1, F.lit(None).cast("string"))
              .when(k % 4 == 2, "vn_copyfloat32").otherwise(F.concat(F.lit("kern"), (k % 3).cast("string"))))
    ops = F.array(
        F.struct(F.concat(F.lit("p"), (k % 5).cast("string")).alias("name"), symbol.alias("symbol"),
                 (cents * 1_000_000_000).alias("gpu_ns"), (k % 3 + 1).alias("count")),
        F.struct(F.concat(F.lit("q"), (k % 3).cast("string")).alias("name"), F.lit(None).cast("string").alias("symbol"),
                 (cents * 500_000_001).alias("gpu_ns"), F.lit(1).cast("bigint").alias("count")))
    cb = is_kind("MetalCbCommitted", "MetalCbScheduled", "MetalCbCompleted", "MetalCbOps")
    queued = is_kind("MetalCbCommitted", "MetalCbScheduled", "MetalCbCompleted")
    t_ns = F.col("t") * 1000
    cols = {
        "session_key": F.concat(F.lit("u"), F.col("session_key").cast("string")), "event_ord": F.col("event_ord"),
        "ts_mono_ns": t_ns, "ts_wall_ns": t_ns + EPOCH_US * 1000,
        "session_id": F.format_string("%032x", F.col("session_key")), "source": _source(kind),
        "pid": F.col("session_key") % 50, "seq": F.col("event_ord"), "kind": kind,
        "label": F.when(is_kind("Mark"), F.concat(F.lit("m"), (k % 3).cast("string"))),
        "module_call_id": F.when(is_kind("ModuleEntered"), F.col("event_ord")).when(
            is_kind("ModuleReturned"), F.coalesce("_open", F.lit(-7).cast("bigint"))),
        "qualname": F.when(is_kind("ModuleEntered"), F.concat(F.lit("layer"), (k % 7).cast("string"))),
        "class_name": F.when(is_kind("ModuleEntered"), F.concat(F.lit("C"), (k % 3).cast("string"))),
        "parent_call_id": F.when(is_kind("ModuleEntered") & (k % 3 != 0), F.col("_open")),
        "fields": F.when(is_kind("ModuleEntered"), F.create_map(
            F.lit("step"), F.struct(F.lit("int").alias("t"), (k % 4).cast("string").alias("v")))),
        "call_id": F.when(is_kind("MlxEvalEntered", "MlxEvalReturned"), k % 5),
        "array_count": F.when(is_kind("MlxEvalEntered"), k),
        "stream": F.when(is_kind("MlxEvalEntered"), F.concat(F.lit("s"), (k % 3).cast("string"))),
        "module_stack": F.when(is_kind("MlxEvalEntered"), stack),
        "stack_frames": F.when(is_kind("MlxEvalEntered"), frames),
        "duration_ns": F.when(is_kind("MlxEvalReturned"), cents * 1_000_000),
        "was_async": F.when(is_kind("MlxEvalReturned"), k % 3 == 0),
        "cb_id": F.when(cb, lane), "queue_id": F.when(queued, lane % 2),
        "queue_depth": F.when(is_kind("MetalCbCommitted"), k),
        "status": F.when(is_kind("MetalCbCompleted"), F.lit(4).cast("bigint")),
        "error_code": F.when(is_kind("MetalCbCompleted") & (k % 20 == 0), 1).when(
            is_kind("MetalCbCompleted") & (k % 20 == 10), 2).cast("bigint"),
        "in_flight_ns": F.when(is_kind("MetalCbCompleted"), cents * 10_000_000),
        "ops": F.when(is_kind("MetalCbOps"), ops),
        "allocated_bytes": F.when(is_kind("MetalDeviceMemSample"), cents * 100_000),
        "recommended_max_bytes": F.when(is_kind("MetalDeviceMemSample"), F.lit(500_000_000).cast("bigint")),
        "active_bytes": F.when(is_kind("MlxMemoryPoll"), cents * 100_000).when(is_kind("VmSample"), cents * 20),
        "wired_bytes": F.when(is_kind("VmSample"), cents * 10), "compressed_bytes": F.when(is_kind("VmSample"), k),
        "swap_used_bytes": F.when(is_kind("VmSample"), F.lit(0).cast("bigint")),
        "page_outs_per_sec": F.when(is_kind("VmSample"), cents / 100), "level": F.when(is_kind("ThermalState"), k % 4),
        "top": F.when(is_kind("ProcTop"), F.array(
            F.struct(F.lit(1).cast("bigint").alias("pid"), F.lit("spindump").alias("name"), (cents / 1000).cast("float").alias("cpu_pct")),
            F.struct(F.lit(2).cast("bigint").alias("pid"), F.lit("python").alias("name"), F.lit(90.0).cast("float").alias("cpu_pct")))),
        "reason": F.when(is_kind("MetalHookSkipped"), F.when(k == 10, "stage sampling disabled").when(
            k == 40, "dispatch sampling disabled").otherwise("ring decode error")),
        "dropped_count": F.when(is_kind("MetalHookDropped"), k),
        "peak_bytes": F.when(is_kind("MlxMemoryPoll"), cents * 150_000),
        "cache_bytes": F.when(is_kind("MlxMemoryPoll"), (cents * 37 % 20011) * 200_000),
        "heap_id": F.when(is_kind("MetalHeapAlloc", "MetalHeapFree"), F.call_function("div", k, F.lit(10)) % 4),
        "path": F.when(is_kind("ModelLoad", "ModelUnload"), F.concat(F.lit("/m/f"), (F.call_function("div", k, F.lit(5)) % 3).cast("string"), F.lit(".bin"))),
        "size_bytes": F.when(is_kind("ModelLoad", "MetalHeapAlloc"), cents),
        "t_start_ns": F.when(is_kind("ModelLoad"), F.lit(1000).cast("bigint")),
        "t_end_ns": F.when(is_kind("ModelLoad"), 1000 + cents * 1_000_000),
        "t_ns": F.when(is_kind("ModelUnload"), t_ns),
        "proc_pid": F.when(is_kind("ProcFootprint"), k % 3),
        "name": F.when(is_kind("ProcFootprint"), F.concat(F.lit("proc"), (k % 2).cast("string"))),
        "phys_footprint_bytes": F.when(is_kind("ProcFootprint"), cents * 1000),
        "lifetime_max_phys_footprint_bytes": F.when(is_kind("ProcFootprint"), cents * 1100),
        "is_traced_root": F.when(is_kind("ProcFootprint"), k % 3 == 1),
    }
    return e.select(*[(cols[f.name] if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in EVENT.fields])


# The same log for DuckDB: `tl` has the columns the oracles use, `tl_ops` one
# row per op of an ops event.
TL = EV + f""", ek AS (SELECT *, {_KIND_SQL} AS kind FROM ev),
 eo AS (SELECT *, last_value(CASE WHEN kind='ModuleEntered' THEN event_ord END IGNORE NULLS) OVER (
          PARTITION BY session_key ORDER BY event_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opn,
        (k // 6) % 3 AS lane FROM ek),
 tl AS (SELECT 'u' || session_key AS session_key, event_ord, t * 1000 AS ts, t * 1000 + {EPOCH_US} * 1000 AS wall,
   {_SOURCE_SQL} AS source, kind, k, cents, session_key % 50 AS pid, event_ord AS seq,
   CASE WHEN kind='Mark' THEN 'm' || (k%3) END AS label,
   CASE WHEN kind='ModuleEntered' THEN event_ord WHEN kind='ModuleReturned' THEN coalesce(opn, -7) END AS module_call_id,
   CASE WHEN kind='ModuleEntered' THEN 'layer' || (k%7) END AS qualname,
   CASE WHEN kind='ModuleEntered' THEN 'C' || (k%3) END AS class_name,
   CASE WHEN kind='ModuleEntered' AND k%3<>0 THEN opn END AS parent_call_id,
   CASE WHEN kind IN ('MlxEvalEntered','MlxEvalReturned') THEN k%5 END AS call_id,
   CASE WHEN kind='MlxEvalEntered' THEN 's' || (k%3) END AS stream,
   CASE WHEN kind='MlxEvalEntered' AND k%4<>1 THEN opn END AS leaf,
   CASE WHEN kind='MlxEvalEntered' AND k%3=0 THEN 'f' || (k%4) || '.py:' || k END AS frame,
   CASE WHEN kind='MlxEvalReturned' THEN cents*1000000 END AS duration_ns,
   CASE WHEN kind='MlxEvalReturned' THEN k%3=0 END AS was_async,
   CASE WHEN kind IN ('MetalCbCommitted','MetalCbScheduled','MetalCbCompleted','MetalCbOps') THEN lane END AS cb_id,
   CASE WHEN kind IN ('MetalCbCommitted','MetalCbScheduled','MetalCbCompleted') THEN lane%2 END AS queue_id,
   CASE WHEN kind='MetalCbCommitted' THEN k END AS queue_depth,
   CASE WHEN kind='MetalCbCompleted' AND k%20=0 THEN 1 WHEN kind='MetalCbCompleted' AND k%20=10 THEN 2 END AS error_code,
   CASE WHEN kind='MetalCbCompleted' THEN cents*10000000 END AS in_flight_ns,
   CASE WHEN kind='MetalDeviceMemSample' THEN cents*100000 END AS allocated,
   CASE WHEN kind='MetalDeviceMemSample' THEN 500000000 END AS budget,
   CASE WHEN kind='MlxMemoryPoll' THEN cents*100000 END AS active_bytes,
   CASE WHEN kind='MlxMemoryPoll' THEN cents*150000 END AS peak_bytes,
   CASE WHEN kind='MlxMemoryPoll' THEN (cents*37%20011)*200000 END AS cache_bytes,
   CASE WHEN kind IN ('MetalHeapAlloc','MetalHeapFree') THEN (k//10)%4 END AS heap_id,
   CASE WHEN kind IN ('ModelLoad','ModelUnload') THEN '/m/f' || ((k//5)%3) || '.bin' END AS path,
   CASE WHEN kind IN ('ModelLoad','MetalHeapAlloc') THEN cents END AS size_bytes,
   CASE WHEN kind='ModelLoad' THEN cents*1000000 END AS load_ns,
   CASE WHEN kind='ProcFootprint' THEN k%3 END AS proc_pid,
   CASE WHEN kind='ProcFootprint' THEN 'proc' || (k%2) END AS name,
   CASE WHEN kind='ProcFootprint' THEN cents*1000 END AS phys,
   CASE WHEN kind='ProcFootprint' THEN cents*1100 END AS lifetime_max,
   CASE WHEN kind='ProcFootprint' THEN k%3=1 END AS is_root
  FROM eo),
 tl_ops AS (
   SELECT session_key, event_ord, ts, cb_id, 0 AS pos, 'p' || (k%5) AS name,
          CASE k%4 WHEN 0 THEN 'steel_gemm_f32' WHEN 1 THEN NULL WHEN 2 THEN 'vn_copyfloat32' ELSE 'kern' || (k%3) END AS symbol,
          CASE k%4 WHEN 0 THEN 'Matmul' WHEN 2 THEN 'Copy' END AS op_kind,
          cents*1000000000 AS gpu_ns, k%3+1 AS cnt FROM tl WHERE kind='MetalCbOps'
   UNION ALL
   SELECT session_key, event_ord, ts, cb_id, 1, 'q' || (k%3), NULL, NULL, cents*500000001, 1 FROM tl WHERE kind='MetalCbOps')"""

# Eval and scope windows, as an oracle states them: plain nested lookups.
GRACE_NS = 2 * HOUR_NS
WINDOWS = TL + f""",
 ret AS (SELECT r.*, (SELECT max(x.event_ord) FROM tl x WHERE x.session_key=r.session_key AND x.call_id=r.call_id
                      AND x.event_ord<r.event_ord) AS prev FROM tl r WHERE r.kind='MlxEvalReturned'),
 evals AS (SELECT r.session_key, r.call_id, b.ts AS t_in, r.ts + CASE WHEN r.was_async THEN {GRACE_NS} ELSE 0 END AS t_out,
             b.event_ord AS enter_ord, r.event_ord AS ret_ord, b.leaf, b.frame, r.duration_ns, r.was_async
           FROM ret r JOIN tl b ON b.event_ord=r.prev AND b.kind='MlxEvalEntered'),
 ends AS (SELECT session_key, arg_max(ts, event_ord) AS end_ts, arg_min(ts, event_ord) AS t0 FROM tl GROUP BY 1),
 calls AS (SELECT e.session_key, e.module_call_id AS call_id, e.event_ord AS enter_ord, e.ts AS t_in, e.qualname,
             e.class_name, e.parent_call_id, e.k,
             (SELECT min(r.event_ord) FROM tl r WHERE r.session_key=e.session_key AND r.kind='ModuleReturned'
                AND r.module_call_id=e.module_call_id AND r.event_ord>e.event_ord) AS ret_ord
           FROM tl e WHERE e.kind='ModuleEntered'),
 scopes AS (SELECT c.*, r.ts AS ret_ts, coalesce(r.ts, n.end_ts) AS t_out FROM calls c
            LEFT JOIN tl r ON r.event_ord=c.ret_ord JOIN ends n ON n.session_key=c.session_key)"""

# Command buffers with clamped ops, stated with correlated lookups.
BUFFERS = WINDOWS + """,
 cq AS (SELECT c.*,
   (SELECT max(x.event_ord) FROM tl x WHERE x.session_key=c.session_key AND x.cb_id=c.cb_id AND x.event_ord<c.event_ord
      AND x.kind IN ('MetalCbCommitted','MetalCbCompleted')) AS pc,
   (SELECT max(x.event_ord) FROM tl x WHERE x.session_key=c.session_key AND x.cb_id=c.cb_id AND x.event_ord<c.event_ord
      AND x.kind IN ('MetalCbScheduled','MetalCbCompleted')) AS ps,
   (SELECT max(x.event_ord) FROM tl x WHERE x.session_key=c.session_key AND x.queue_id=c.queue_id AND x.event_ord<c.event_ord
      AND x.kind='MetalCbCompleted') AS pq
   FROM tl c WHERE c.kind='MetalCbCompleted'),
 comp AS (SELECT c.session_key, c.event_ord, c.ts, c.cb_id, c.queue_id, c.in_flight_ns, c.error_code,
   m.ts AS commit_ts, (m.kind='MetalCbCommitted') IS TRUE AS paired,
   CASE WHEN s.kind='MetalCbScheduled' THEN greatest(0, c.ts - greatest(s.ts, coalesce(q.ts, 0))) END AS window_ns
   FROM cq c LEFT JOIN tl m ON m.event_ord=c.pc LEFT JOIN tl s ON s.event_ord=c.ps LEFT JOIN tl q ON q.event_ord=c.pq),
 oq AS (SELECT o.session_key, o.event_ord, o.ts, o.cb_id,
   (SELECT sum(p.gpu_ns) FROM tl_ops p WHERE p.event_ord=o.event_ord) AS raw_ns,
   (SELECT max(x.event_ord) FROM comp x WHERE x.session_key=o.session_key AND x.cb_id=o.cb_id AND x.event_ord<o.event_ord
      AND x.paired) AS comp_ord,
   (SELECT max(x.event_ord) FROM tl x WHERE x.session_key=o.session_key AND x.cb_id=o.cb_id AND x.event_ord<o.event_ord
      AND x.kind IN ('MetalCbCompleted','MetalCbOps')) AS before_ord
   FROM tl o WHERE o.kind='MetalCbOps'),
 oe AS (SELECT q.*, c.window_ns,
   CASE WHEN q.raw_ns > c.window_ns THEN c.window_ns::DOUBLE / q.raw_ns::DOUBLE END AS scale
   FROM oq q LEFT JOIN comp c ON c.event_ord=q.before_ord),
 cops AS (SELECT p.*, e.comp_ord, CASE WHEN e.scale IS NULL THEN p.gpu_ns
            ELSE CAST(trunc(p.gpu_ns::DOUBLE * e.scale) AS BIGINT) END AS ns FROM tl_ops p JOIN oe e USING (event_ord)),
 lastops AS (SELECT comp_ord, max(event_ord) AS ops_ord FROM oe WHERE comp_ord IS NOT NULL GROUP BY 1),
 sampled AS (SELECT DISTINCT session_key FROM oe),
 buf AS (SELECT c.session_key, c.event_ord AS comp_ord, c.cb_id, c.commit_ts, c.in_flight_ns, l.ops_ord,
   s.session_key IS NOT NULL AS sampled,
   CASE WHEN l.ops_ord IS NOT NULL THEN (SELECT CAST(sum(ns) AS BIGINT) FROM cops x WHERE x.event_ord=l.ops_ord)
        WHEN s.session_key IS NOT NULL THEN 0 ELSE c.in_flight_ns END AS gpu_ns
   FROM comp c LEFT JOIN lastops l ON l.comp_ord=c.event_ord LEFT JOIN sampled s ON s.session_key=c.session_key
   WHERE c.paired)"""

ATTRIB = BUFFERS + f""",
 hit_e AS (SELECT b.comp_ord, arg_min(e.enter_ord, (e.t_in, e.ret_ord)) AS enter_ord FROM buf b JOIN evals e
   ON e.session_key=b.session_key AND b.commit_ts BETWEEN e.t_in AND e.t_out GROUP BY 1),
 hit_s AS (SELECT b.comp_ord, arg_max(s.call_id, (s.t_in, s.enter_ord)) AS call_id FROM buf b JOIN scopes s
   ON s.session_key=b.session_key AND b.commit_ts BETWEEN s.t_in AND s.t_out + {GRACE_NS} GROUP BY 1),
 att AS (SELECT b.*, CASE WHEN e.enter_ord IS NOT NULL AND k.call_id IS NOT NULL THEN 'eval'
     WHEN e.enter_ord IS NOT NULL THEN 'unscoped_eval' WHEN s.call_id IS NOT NULL THEN 'scope' ELSE 'unmatched' END AS via,
   CASE WHEN e.enter_ord IS NOT NULL THEN coalesce(k.call_id, -1) ELSE coalesce(s.call_id, -1) END AS node_id,
   v.leaf AS eval_leaf, v.enter_ord AS eval_ord
   FROM buf b LEFT JOIN hit_e e USING (comp_ord) LEFT JOIN evals v ON v.enter_ord=e.enter_ord
   LEFT JOIN calls k ON k.session_key=b.session_key AND k.call_id=v.leaf LEFT JOIN hit_s s USING (comp_ord)),
 nself AS (SELECT session_key, node_id, sum(gpu_ns) AS ns, count(*) AS cbs FROM att GROUP BY 1, 2),
 neval AS (SELECT e.session_key, coalesce(c.call_id, -1) AS node_id, count(*) AS evals FROM evals e
   LEFT JOIN calls c ON c.session_key=e.session_key AND c.call_id=e.leaf GROUP BY 1, 2),
 ids AS (SELECT session_key, node_id FROM nself UNION SELECT session_key, node_id FROM neval
   UNION SELECT session_key, call_id FROM calls),
 totals AS (SELECT i.session_key, i.node_id, c.enter_ord, CASE WHEN i.node_id=-1 THEN '<unscoped>' ELSE c.qualname END AS qualname,
   c.parent_call_id, c.k, CAST(coalesce(s.ns, 0) AS BIGINT) AS gpu_ns_self, coalesce(v.evals, 0) AS eval_count,
   coalesce(s.cbs, 0) AS cb_count FROM ids i LEFT JOIN calls c ON c.session_key=i.session_key AND c.call_id=i.node_id
   LEFT JOIN nself s ON s.session_key=i.session_key AND s.node_id=i.node_id
   LEFT JOIN neval v ON v.session_key=i.session_key AND v.node_id=i.node_id)"""

TREE = ATTRIB + """,
 tree AS (
   SELECT session_key, node_id, enter_ord, 0 AS depth, [node_id] AS path FROM totals WHERE node_id<>-1 AND parent_call_id IS NULL
   UNION ALL
   SELECT c.session_key, c.node_id, c.enter_ord, t.depth+1, list_append(t.path, c.node_id)
   FROM totals c JOIN tree t ON c.session_key=t.session_key AND c.parent_call_id=t.node_id AND c.enter_ord>t.enter_ord),
 links AS (SELECT session_key, node_id, unnest(path) AS anc FROM tree),
 sub AS (SELECT l.session_key, l.anc AS node_id, CAST(sum(t.gpu_ns_self) AS BIGINT) AS gpu_ns_subtree FROM links l
   JOIN totals t ON t.session_key=l.session_key AND t.node_id=l.node_id GROUP BY 1, 2),
 nodes AS (
   SELECT t.session_key, t.node_id, t.qualname, t.parent_call_id, t.k, r.depth, r.path, t.gpu_ns_self, s.gpu_ns_subtree,
     t.eval_count, t.cb_count FROM totals t JOIN tree r ON r.session_key=t.session_key AND r.node_id=t.node_id
     JOIN sub s ON s.session_key=t.session_key AND s.node_id=t.node_id
   UNION ALL
   SELECT session_key, node_id, qualname, parent_call_id, k, 0, [node_id], gpu_ns_self, gpu_ns_self, eval_count, cb_count
   FROM totals WHERE node_id=-1),
 nops0 AS (SELECT a.session_key, a.node_id, o.name, o.symbol, o.op_kind, o.ns, o.cnt, o.comp_ord AS co, o.pos
   FROM att a JOIN cops o ON o.event_ord=a.ops_ord),
 nops AS (SELECT session_key, node_id, name, CAST(sum(ns) AS BIGINT) AS gpu_ns, sum(cnt)::BIGINT AS count,
   arg_min(symbol, (co, pos)) FILTER (WHERE symbol IS NOT NULL) AS symbol,
   arg_min(CASE WHEN op_kind IS NULL THEN '' ELSE op_kind END, (co, pos)) FILTER (WHERE symbol IS NOT NULL) AS okind0
   FROM nops0 GROUP BY 1, 2, 3),
 nopk AS (SELECT session_key, node_id, name, gpu_ns, count, symbol, nullif(okind0, '') AS op_kind FROM nops)"""


def on_host(df: DataFrame) -> DataFrame:
    """With the column host: users are spread over three hosts, and users of different hosts share process ids."""
    return df.withColumn("host", F.concat(F.lit("h"), (F.regexp_extract("session_key", "[0-9]+", 0).cast("bigint") % 3).cast("string")))


#: The same of a session key as SQL.
HOST_SQL = "'h' || (CAST(regexp_extract({0}, '[0-9]+') AS BIGINT)%3)"


def with_sql(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes} {body}"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session catalog derived from the events table: one session per user."""
    e = trace_log(spark, sf_dir)
    ends = e.groupBy("session_key").agg(
        F.min("ts_wall_ns").alias("_a"), F.max("ts_wall_ns").alias("_z"), F.min("session_id").alias("session_id"))
    u = F.substring("session_key", 2, 10).cast("bigint")
    stamp = lambda c: F.date_format(F.timestamp_micros(F.call_function("div", F.col(c), F.lit(1000))), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return ends.select(
        F.when(u % 11 == 0, F.concat(F.lit("post-mortem-"), "session_key")).otherwise(F.col("session_key")).alias("session_key"),
        "session_id", stamp("_a").alias("started_rfc3339"),
        F.when(u % 4 != 0, stamp("_z")).alias("ended_rfc3339"),
        F.when(u % 3 == 0, "Ambient").otherwise("Scoped").alias("kind"),
        F.when(u % 3 != 0, u % 50).alias("kind_pid"),
        F.concat(F.lit("run"), (u % 7).cast("string")).alias("name"),
        F.when(u % 5 == 0, 0).when(u % 5 == 1, -1).cast("int").alias("exit_code"))


SESSIONS = TL + """, se AS (SELECT session_key AS s0, min(wall) AS a, max(wall) AS z, CAST(substr(session_key, 2) AS BIGINT) AS u FROM tl GROUP BY 1),
 sess AS (SELECT CASE WHEN u%11=0 THEN 'post-mortem-' || s0 ELSE s0 END AS session_key, s0, u, a, z,
   strftime(make_timestamp(a//1000), '%Y-%m-%dT%H:%M:%S.%fZ') AS started_rfc3339,
   CASE WHEN u%4<>0 THEN strftime(make_timestamp(z//1000), '%Y-%m-%dT%H:%M:%S.%fZ') END AS ended_rfc3339,
   CASE WHEN u%3=0 THEN 'Ambient' ELSE 'Scoped' END AS kind, CASE WHEN u%3<>0 THEN u%50 END AS kind_pid,
   'run' || (u%7) AS name, CASE WHEN u%5=0 THEN 0 WHEN u%5=1 THEN -1 END AS exit_code FROM se)"""


