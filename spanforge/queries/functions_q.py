"""Scalar functions, text sources, trees and allocation over the driver's other tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from spanforge.functions import labels, text
from spanforge.operators import diff, filters, gpu, reports, sessions as S, tree
from spanforge.operators.scan import chunk_of, with_position
from spanforge.queries.registry import query
from spanforge.queries.views import EV, ev, table, trace_log, with_sql, TL
from spanforge.session_conf import shared_folder, spread
from spanforge.sources import external

# part rows turned into shader symbols: a prefix by key, a tail from the row
_PREFIXES = ["steel_gemm_", "affine_qmm_t_", "qmv_fast_", "rms_norm", "layer_normbf", "rope_", "conv2d_", "conv_gen_", "row_reduce_",
             "scan_", "gather_", "rbits", "g2_copy", "vn_copy", "vv_Add", "sv_Power", "vv_add", "zz_copy", "kern_", "dequantize_",
             "block_softmax_", "x_contiguous", "fused_strided", "sdpa_", "g_A"]


def _symbols(spark, sf):
    p = table(spark, sf, "part")
    pref = F.element_at(F.array(*[F.lit(x) for x in _PREFIXES]), (F.col("p_partkey") % len(_PREFIXES) + 1).cast("int"))
    tail = F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise("")
    return p.select("p_partkey", F.concat(pref, tail).alias("symbol"))


_SYM = f"sym AS (SELECT p_partkey, ({_PREFIXES!r})[p_partkey % {len(_PREFIXES)} + 1] || CASE WHEN p_partkey%2=0 THEN lower(p_type) ELSE '' END AS symbol FROM part)"
_KIND_CASE = "CASE " + " ".join(f"WHEN starts_with(symbol, '{p}') THEN '{k}'" for p, k in labels.OP_PREFIXES) + """
  WHEN regexp_matches(symbol, '^[gsvn0-9]+_copy') THEN 'Copy' WHEN regexp_matches(symbol, '^[gsvn0-9]+_[A-Z]') THEN 'Elementwise'
  WHEN suffix(symbol, '_contiguous') OR suffix(symbol, '_strided') THEN 'FusedElementwise' END"""


@query("i1_op_kind", with_sql(_SYM, f"SELECT p_partkey, symbol, {_KIND_CASE} AS op_kind FROM sym"))
def i1_op_kind(spark, sf):
    return _symbols(spark, sf).withColumn("op_kind", labels.op_kind(F.col("symbol")))


@query("i2_op_label", with_sql(_SYM, f"SELECT p_partkey, coalesce({_KIND_CASE}, symbol, 'raw' || p_partkey) AS label FROM (SELECT p_partkey, CASE WHEN p_partkey%7=0 THEN NULL ELSE symbol END AS symbol FROM sym)"))
def i2_op_label(spark, sf):
    s = F.when(F.col("p_partkey") % 7 != 0, F.col("symbol"))
    return _symbols(spark, sf).select("p_partkey", labels.op_label(s, F.concat(F.lit("raw"), F.col("p_partkey").cast("string"))).alias("label"))


@query("i3_error_name", """SELECT o_orderkey, 'kIOGPUCommandBufferCallbackError' || CASE o_orderkey%16 WHEN 1 THEN 'Timeout' WHEN 2 THEN 'OutOfMemory' WHEN 3 THEN 'PageFault'
  WHEN 4 THEN 'AccessViolation' WHEN 5 THEN 'InvalidResource' WHEN 6 THEN 'Blacklisted' WHEN 14 THEN 'ImpactingInteractivity' ELSE 'Unknown' END AS error_name,
  o_orderkey%16 IN (1, 14) AS watchdog FROM orders""")
def i3_error_name(spark, sf):
    c = F.col("o_orderkey") % 16
    return table(spark, sf, "orders").select("o_orderkey", labels.error_name(c).alias("error_name"), labels.is_watchdog(c).alias("watchdog"))


@query("i4_binary_bytes", """SELECT o_orderkey, CASE WHEN b>=1073741824 THEN printf('%.2f GiB', b/1073741824.0::DOUBLE) WHEN b>=1048576 THEN printf('%.1f MiB', b/1048576.0::DOUBLE)
  WHEN b>=1024 THEN printf('%.0f KiB', b/1024.0::DOUBLE) ELSE b || ' B' END AS shown FROM (SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN o_orderkey%1000 WHEN 1 THEN o_orderkey*1021+7 WHEN 2 THEN o_orderkey*99991+3 ELSE o_orderkey*7919777+1073741824 END AS b FROM orders)""")
def i4_binary_bytes(spark, sf):
    k = F.col("o_orderkey")
    b = F.when(k % 4 == 0, k % 1000).when(k % 4 == 1, k * 1021 + 7).when(k % 4 == 2, k * 99991 + 3).otherwise(k * 7919777 + 1073741824)
    return table(spark, sf, "orders").select("o_orderkey", text.binary_bytes(b).alias("shown"))


@query("i5_decimal_gb", "SELECT o_orderkey, round(o_totalprice*1000/1e9, 6) AS gb FROM orders")
def i5_decimal_gb(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(text.decimal_gb(F.col("o_totalprice") * 1000), 6).alias("gb"))


@query("i6_truncate", "SELECT doc_id, CASE WHEN length(text)<=40 THEN text ELSE left(text, 39) || '…' END AS short FROM documents")
def i6_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text"), 40).alias("short"))


@query("i7_basename", "SELECT page_id, CASE WHEN regexp_extract(regexp_replace(url, '(/+\\.?)+$', ''), '([^/]*)$', 1) IN ('', '..') THEN url ELSE regexp_extract(regexp_replace(url, '(/+\\.?)+$', ''), '([^/]*)$', 1) END AS base FROM pages")
def i7_basename(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.basename(F.col("url")).alias("base"))


_D = "(SELECT c_custkey, CAST(round(c_acctbal*100) AS BIGINT)*7919 AS d, c_nationkey AS a FROM customer)"


@query("i8_formats", f"""SELECT c_custkey, printf('%.3fs', abs(d)/1e9) AS secs, CASE WHEN d<0 THEN '-' WHEN d>0 THEN '+' ELSE '' END || printf('%.3fs', abs(d)/1e9) ||
  CASE WHEN a=0 THEN ' (n/a)' ELSE ' (' || printf('%+.1f', d*100.0::DOUBLE/(a*1000003)) || '%)' END AS delta FROM {_D}""")
def i8_formats(spark, sf):
    d = F.round(F.col("c_acctbal") * 100).cast("bigint") * 7919
    a = F.col("c_nationkey")
    pct = F.when(a != 0, d * F.lit(100.0) / (a * 1000003))
    return table(spark, sf, "customer").select("c_custkey", text.fmt_secs(F.abs(d)).alias("secs"), text.fmt_delta(d, pct).alias("delta"))


@query("i9_pct_change", "SELECT s_suppkey, round(CASE WHEN s_nationkey<>0 THEN (s_acctbal-s_nationkey)/s_nationkey*100 END, 6) AS pct FROM supplier")
def i9_pct_change(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.round(text.pct_change(F.col("s_nationkey"), F.col("s_acctbal")), 6).alias("pct"))


@query("i10_mmss", """SELECT o_orderkey, CASE WHEN s//3600>0 THEN printf('%d:%02d:%02d', s//3600, s//60%60, s%60) ELSE printf('%02d:%02d', s//60, s%60) END AS shown
  FROM (SELECT o_orderkey, o_orderkey*37%9000 AS s FROM orders)""")
def i10_mmss(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.mmss(F.col("o_orderkey") * 37 % 9000).alias("shown"))


@query("i11_rfc3339_ns", """SELECT event_id, epoch_us(ts)*1000+789-7200000000000 AS ns FROM events""")
def i11_rfc3339_ns(spark, sf):
    e = table(spark, sf, "events")
    stamp = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789+02:00"))
    return e.select("event_id", text.rfc3339_ns(stamp).alias("ns"))


@query("i12_session_dir_name", "SELECT event_id, strftime(ts, '%Y-%m-%d-%H%M%S') || '-' || left(md5(user_id::VARCHAR), 8) AS dir FROM events")
def i12_session_dir_name(spark, sf):
    e = table(spark, sf, "events")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return e.select("event_id", text.session_dir_name(stamp, F.md5(F.col("user_id").cast("string"))).alias("dir"))


@query("i13_session_name", """SELECT conv_id, turn, CASE WHEN n='' OR regexp_matches(n, '[\\x00-\\x1f\\x7f-\\x9f/]') THEN NULL
  ELSE left(n, list_max(list_filter(range(0, 201), lambda x: strlen(left(n, x))<=200))) END AS name
  FROM (SELECT conv_id, turn, trim(CASE WHEN turn%3=0 THEN '  ' || replace(text, chr(10), ' ') || ' ' ELSE text END) AS n FROM conversations)""")
def i13_session_name(spark, sf):
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" "))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.valid_session_name(raw).alias("name"))


@query("i14_parse_field", """SELECT event_id, 'k' || user_id AS key, CASE event_id%4 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'string' ELSE 'bool' END AS t FROM events""")
def i14_parse_field(spark, sf):
    i = F.col("event_id") % 4
    v = (F.when(i == 0, F.col("event_id").cast("string")).when(i == 1, F.concat(F.col("event_id").cast("string"), F.lit(".25")))
         .when(i == 2, F.col("event_type")).otherwise("TRUE"))
    kv = F.concat(F.lit(" k"), F.col("user_id").cast("string"), F.lit(" = "), v)
    return table(spark, sf, "events").withColumn("p", text.parse_field(kv)).select("event_id", "p.key", F.col("p.value.t").alias("t"))


@query("i16_path_sha8", "SELECT page_id, left(sha256(url), 8) AS sha8 FROM pages")
def i16_path_sha8(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.path_sha8(F.col("url")).alias("sha8"))


@query("i17_likely_async", "SELECT event_id, CAST(round(value*1000000) AS BIGINT)<10000000 AS is_async FROM events")
def i17_likely_async(spark, sf):
    return table(spark, sf, "events").select("event_id", labels.likely_async(F.round(F.col("value") * 1_000_000).cast("bigint")).alias("is_async"))


@query("i18_kernel_fingerprint", "SELECT l_orderkey, l_linenumber, l_partkey, 'K_' || printf('%04x', (l_partkey*7919)%65536) || '_' || l_linenumber || 'x' || CAST(l_quantity AS INT) || 'x1' AS fp FROM lineitem")
def i18_kernel_fingerprint(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", labels.kernel_fingerprint(
        F.col("l_partkey") * 7919, F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.lit(1)).alias("fp"))


@query("i19_budget_ratio", "SELECT c_custkey, round(CASE WHEN c_nationkey=0 THEN 0.0 ELSE c_acctbal/c_nationkey END, 6) AS ratio FROM customer")
def i19_budget_ratio(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(text.budget_ratio(F.col("c_acctbal"), F.col("c_nationkey")), 6).alias("ratio"))


@query("i20_kill_reason", """SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN 'the process passed its own limit' WHEN 1 THEN 'the whole machine ran short of memory' WHEN 2 THEN 'kernel reason: ' || o_orderpriority END AS reason_text FROM orders""")
def i20_kill_reason(spark, sf):
    i = F.col("o_orderkey") % 4
    r = F.when(i == 0, "per-process-limit").when(i == 1, "vm-pageshortage").when(i == 2, F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", labels.kill_reason_text(r).alias("reason_text"))


@query("i21_key_bucket", """SELECT page_id, CAST(list_reduce(list_transform(range(0, strlen(url)), lambda i: CAST(CAST('0x' || substr(hex(encode(url)), 2*i+1, 2) AS INTEGER) AS BIGINT)),
  lambda a, b: (a*31+b) % 4294967296) % 8 AS INTEGER) AS bucket FROM pages""")
def i21_key_bucket(spark, sf):
    return table(spark, sf, "pages").select("page_id", labels.key_bucket(F.col("url")).alias("bucket"))


@query("i22_caller_frames", with_sql(EV, """
  SELECT event_ord, CASE WHEN k%3=0 THEN 1 ELSE 2 END AS n, CASE WHEN k%3=0 THEN '/src/b.py' ELSE '/src/a' || (k%4) || '.py' END AS first_file FROM ev"""))
def i22_caller_frames(spark, sf):
    k = F.col("k")
    own = F.when(k % 3 == 0, "/agent/x.py").otherwise(F.concat(F.lit("/src/a"), (k % 4).cast("string"), F.lit(".py")))
    frames = F.array(F.struct(own.alias("filename"), k.alias("lineno")), F.struct(F.lit("/src/b.py").alias("filename"), k.alias("lineno")))
    e = ev(spark, sf).withColumn("f", labels.caller_frames(frames, "/agent/"))
    return e.select("event_ord", F.size("f").cast("bigint").alias("n"), F.get("f", 0)["filename"].alias("first_file"))


@query("i15_typed_fields", with_sql(TL, "SELECT event_ord, 'int' AS t, CAST(k%4 AS VARCHAR) AS v FROM tl WHERE kind='ModuleEntered'"))
def i15_typed_fields(spark, sf):
    from spanforge.sinks.files import fields_json
    from spanforge.sources.events import typed_fields

    e = trace_log(spark, sf).where(F.col("kind") == "ModuleEntered")
    back = typed_fields(fields_json(F.col("fields")))
    return e.withColumn("f", back["step"]).select("event_ord", "f.t", "f.v")


@query("d8_compatible_names", """SELECT s_suppkey, c_custkey, least(strlen(a), strlen(b))>0 AND left(a, least(length(a), length(b)))=left(b, least(length(a), length(b))) AS ok FROM (
  SELECT s.s_suppkey, c.c_custkey, CASE WHEN s_suppkey%5=0 THEN '' ELSE left(s_name, 1+s_suppkey%9) END AS a, 'Supplier' || (c_custkey%3) AS b
  FROM supplier s JOIN customer c ON s.s_suppkey=c.c_custkey//15)""")
def d8_compatible_names(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    j = c.withColumn("s_suppkey", F.call_function("div", "c_custkey", F.lit(15))).join(s, "s_suppkey")
    a = F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.left("s_name", (F.col("s_suppkey") % 9 + 1).cast("int")))
    return j.select("s_suppkey", "c_custkey", text.names_compatible(a, F.concat(F.lit("Supplier"), (F.col("c_custkey") % 3).cast("string"))).alias("ok"))


# --- reports, logs and process tables written as text ----------------------

def _report_texts(spark, sf):
    """One report per customer: every third a kill, every seventh damaged."""
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    kill = F.concat(F.lit('{"bug_type":"298","incident_id":"i'), s(F.call_function("div", k, F.lit(2))), F.lit('"}\n{"memoryStatus":{"pageSize":4096},"processes":[{"pid":1,"name":"big","rpages":99999},{"pid":'),
                    s(k % 50), F.lit(',"name":"'), F.col("c_name"), F.lit('","rpages":'), s(k), F.lit(',"lifetimeMax":'), s(k + 5), F.lit(',"reason":"per-process-limit"}]}'))
    crash = F.concat(F.lit('{"bug_type":"309","incident_id":"i'), s(F.call_function("div", k, F.lit(2))), F.lit('"}\n{"pid":'), s(k % 50),
                     F.lit(',"procName":"'), F.lower("c_mktsegment"), F.lit('",\n"exception":{"type":"EXC_CRASH","subtype":"kIOGPUError (0x'), s(k), F.lit(') x","codes":"c0","signal":"SIGABRT"}}'))
    body = F.when(k % 3 == 0, kill).otherwise(crash)
    return table(spark, sf, "customer").select(
        F.concat(F.lit("/r/"), s(k), F.lit(".ips")).alias("path"), (k * 1_000_000).alias("mtime_ns"),
        F.when(k % 7 == 0, F.left(body, F.length(body) - 2)).otherwise(body).alias("text"))


_PARSED = """ pr AS (SELECT '/r/' || c_custkey || '.ips' AS path, c_custkey*1000000 AS mtime_ns, 'i' || (c_custkey//2) AS incident_id,
  CASE WHEN c_custkey%3=0 THEN 'JetsamKill' ELSE 'CrashReportEmitted' END AS kind, CASE WHEN c_custkey%3<>0 THEN c_custkey%50 END AS crashed_pid,
  CASE WHEN c_custkey%3<>0 THEN 'SIGABRT' END AS signal, CASE WHEN c_custkey%3<>0 THEN 'EXC_CRASH: kIOGPUError (0x' || c_custkey || ') x' END AS summary,
  CASE WHEN c_custkey%3<>0 THEN ['kIOGPUError', '0x' || c_custkey, 'c0'] END AS exception_codes, CASE WHEN c_custkey%3<>0 THEN lower(c_mktsegment) END AS proc_name,
  CASE WHEN c_custkey%3=0 THEN c_custkey%50 END AS killed_pid, CASE WHEN c_custkey%3=0 THEN c_name END AS killed_name,
  CASE WHEN c_custkey%3=0 THEN c_custkey*4096 END AS footprint_bytes, CASE WHEN c_custkey%3=0 THEN (c_custkey+5)*4096 END AS lifetime_max_bytes,
  CASE WHEN c_custkey%3=0 THEN 4096 END AS page_size, CASE WHEN c_custkey%3=0 THEN 'per-process-limit' END AS reason FROM customer WHERE c_custkey%7<>0)"""


@query("a5_parse_reports", with_sql(_PARSED.strip(), "SELECT * FROM pr"))
def a5_parse_reports(spark, sf):
    return external.parse_reports(_report_texts(spark, sf))


@query("a5c_dedup_reports", with_sql(_PARSED.strip(), """
  SELECT incident_id AS report_key, arg_min(path, (mtime_ns, path)) AS path FROM pr WHERE coalesce(proc_name, '')<>'building' GROUP BY 1"""))
def a5c_dedup_reports(spark, sf):
    return reports.dedup_reports(external.parse_reports(_report_texts(spark, sf)), own_process="building").select("report_key", "path")


@query("a6_system_log_filter", """SELECT doc_id FROM documents WHERE doc_id%5=0 OR contains(text || CASE WHEN doc_id%11=0 THEN ' GPU watchdog' ELSE '' END, 'GPU watchdog')""")
def a6_system_log_filter(spark, sf):
    i = F.col("doc_id")
    sub = F.when(i % 5 == 0, "com.apple.GPUWrangler").otherwise("other")
    msg = F.concat("text", F.when(i % 11 == 0, " GPU watchdog").otherwise(""))
    return table(spark, sf, "documents").where(external.log_filter(sub, msg)).select("doc_id")


@query("a6_system_log", """WITH d AS (SELECT doc_id, CASE WHEN doc_id%5=0 THEN 'com.apple.GPUWrangler' WHEN doc_id%7=0 THEN '' ELSE 'other' END AS sub,
    CASE WHEN doc_id%13=0 THEN '' ELSE text END || CASE WHEN doc_id%11=0 THEN ' GPU watchdog' ELSE '' END AS msg, doc_id%17=0 AS broken FROM documents)
  SELECT CASE WHEN broken THEN 'damaged' WHEN sub='' AND msg='' THEN 'empty' WHEN sub='com.apple.GPUWrangler' OR contains(msg, 'GPU watchdog') THEN 'kept' ELSE 'other' END AS part,
    count(*) AS n, CAST(sum(CASE WHEN broken THEN 0 ELSE length(msg) END) AS BIGINT) AS chars FROM d GROUP BY 1 HAVING part IN ('damaged', 'kept', 'other')""")
def a6_system_log(spark, sf):
    """A system log written as NDJSON, some of it damaged, and read back in full and by the filter."""
    i = F.col("doc_id")
    sub = F.when(i % 5 == 0, "com.apple.GPUWrangler").when(i % 7 == 0, "").otherwise("other")
    msg = F.concat(F.when(i % 13 == 0, "").otherwise(F.col("text")), F.when(i % 11 == 0, " GPU watchdog").otherwise(""))
    line = F.to_json(F.struct(sub.alias("subsystem"), F.lit("c").alias("category"), msg.alias("eventMessage")))
    path = f"{shared_folder(spark)}/syslog-{uuid.uuid4().hex}"
    table(spark, sf, "documents").select(F.when(i % 17 == 0, F.left(line, F.lit(20))).otherwise(line).alias("value")).write.text(path)
    every, bad = external.read_system_log(spark, path, all_lines=True)
    kept = F.col("message")
    part = F.when(external.log_filter(F.col("subsystem"), kept), "kept").otherwise("other")
    sums = lambda df, p, c: df.groupBy(p.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(c).cast("bigint").alias("chars"))
    return sums(every, part, F.length(kept)).unionByName(sums(bad, F.lit("damaged"), F.lit(0)))


@query("a7_process_table", """SELECT '/t/' || c_custkey AS path, n AS line_no, c_custkey+n AS pid, CASE WHEN n=2 THEN 'two words' ELSE c_name END AS name, round((c_custkey%1000)/10.0+n, 4) AS cpu
  FROM customer, (VALUES (2), (3)) v(n)""")
def a7_process_table(spark, sf):
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    cpu = lambda n: s(F.round((k % 1000) / 10.0 + n, 1))
    txt = F.concat(F.lit("Processes: 3\n PID COMMAND %CPU\n"), F.lit("  "), s(k + 2), F.lit("  two  words "), cpu(2), F.lit("\n"),
                   s(k + 3), F.lit(" "), F.col("c_name"), F.lit(" "), cpu(3), F.lit("\nbad line here x\n12 34\n"))
    # the table may be one small file, and its rows make many lines each
    files = spread(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").select(F.concat(F.lit("/t/"), s(k)).alias("path"), txt.alias("text"))
    return external.parse_process_table(files).select("path", "line_no", "pid", "name", F.round(F.col("cpu_pct").cast("double"), 4).alias("cpu"))


# --- trees, allocation, diffs over the star schema -------------------------

def _edges(spark, sf):
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    node = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    row = lambda df, i, par, ord_, val: df.select(F.lit(1).alias("tree"), i.alias("node"), par.cast("string").alias("parent"),
                                                  ord_.cast("bigint").alias("ord"), val.cast("bigint").alias("cents"))
    zero = F.lit(0)
    return (row(r, node("r", "r_regionkey"), F.lit(None), zero, zero)
            .unionByName(row(n, node("n", "n_nationkey"), node("r", "n_regionkey"), F.lit(1), zero))
            .unionByName(row(c, node("c", "c_custkey"), node("n", "c_nationkey"), F.lit(2), zero))
            .unionByName(row(o, node("o", "o_orderkey"), node("c", "o_custkey"), F.lit(3), F.round(F.col("o_totalprice") * 100))))


@query("d11_linked_tree", """SELECT node, depth FROM (SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation JOIN region ON r_regionkey=n_regionkey
  UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey=c_nationkey UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders JOIN customer ON c_custkey=o_custkey)""")
def d11_linked_tree(spark, sf):
    t = tree.linked_tree(_edges(spark, sf), keys=["tree"], node="node", parent="parent", order="ord")
    return t.select("node", F.col("depth").cast("bigint").alias("depth"))


@query("e2_subtree_rollup", """SELECT 'n' || c_nationkey AS node, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1
  UNION ALL SELECT 'r' || n_regionkey, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey GROUP BY 1
  UNION ALL SELECT 'c' || c_custkey, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1
  UNION ALL SELECT 'o' || o_orderkey, CAST(round(o_totalprice*100) AS BIGINT) FROM orders JOIN customer ON c_custkey=o_custkey""")
def e2_subtree_rollup(spark, sf):
    sums = tree.linked_tree(_edges(spark, sf), keys=["tree"], node="node", parent="parent", order="ord", with_path=False,
                            below={"cents": ("sum", F.col("cents"))})
    return sums.where(F.col("cents") > 0).select("node", "cents")


@query("d11_deep_chain", with_sql(EV, "SELECT session_key, event_ord AS node, row_number() OVER (PARTITION BY session_key, k%20 ORDER BY event_ord)-1 AS depth FROM ev"))
def d11_deep_chain(spark, sf):
    t = tree.linked_tree(_chains(spark, sf), keys=["session_key"], node="node_id", parent="parent_call_id", order="node_id", with_path=False)
    return t.select("session_key", F.col("node_id").alias("node"), F.col("depth").cast("bigint").alias("depth"))


def _chains(spark, sf):
    """Events that each hang on the one before of their kind: as deep as the log is long."""
    before = Window.partitionBy("session_key", F.col("k") % 20).orderBy("event_ord")
    return ev(spark, sf).select(
        "session_key", F.col("event_ord").alias("node_id"), F.lag("event_ord").over(before).alias("parent_call_id"), F.col("cents").alias("gpu_ns_self"),
        F.concat(F.lit("e"), F.col("k").cast("string")).alias("qualname"),
        F.create_map(F.lit("step"), F.struct(F.lit("int").alias("t"), (F.col("k") % 4).cast("string").alias("v"))).alias("fields"))


def _chain_tree(spark, sf):
    rows = _chains(spark, sf)
    sums = tree.linked_tree(rows, keys=["session_key"], node="node_id", parent="parent_call_id", order="node_id", with_path=False,
                            below={"gpu_ns_subtree": ("sum", F.col("gpu_ns_self"))})
    return rows.join(sums, ["session_key", "node_id"])


_CHAIN = EV + """,
   ch AS (SELECT *, sum(cents) OVER (PARTITION BY session_key, k%20 ORDER BY event_ord DESC) AS sub, first_value(event_ord) OVER (PARTITION BY session_key, k%20 ORDER BY event_ord) AS top FROM ev),
   lo AS (SELECT *, min(sub) OVER (PARTITION BY session_key, k%20 ORDER BY event_ord) AS least, count(*) FILTER (WHERE k%4=2) OVER (PARTITION BY session_key, k%20 ORDER BY event_ord DESC) AS hits FROM ch)"""


@query("e2_chain_rollup", with_sql(_CHAIN, "SELECT session_key, event_ord AS node_id, CAST(sub AS BIGINT) AS cents FROM ch"))
def e2_chain_rollup(spark, sf):
    rows = _chains(spark, sf)
    return tree.rollup(rows, rows, keys=["session_key"], node="node_id", parent="parent_call_id", value="gpu_ns_self", out="cents")


@query("g3_chain_prune", with_sql(_CHAIN + """, best AS (SELECT session_key, arg_min(event_ord, (-sub, event_ord)) AS top FROM ch WHERE event_ord=top AND sub>=20000 GROUP BY 1)""", """
  SELECT l.session_key, l.event_ord AS node_id FROM lo l JOIN best b ON b.session_key=l.session_key AND b.top=l.top WHERE l.least>=20000"""))
def g3_chain_prune(spark, sf):
    return tree.prune(_chain_tree(spark, sf), min_ns=20000, top_n=1).select("session_key", "node_id")


@query("g4_chain_filter", with_sql(_CHAIN, "SELECT session_key, event_ord AS node_id FROM lo WHERE hits>0"))
def g4_chain_filter(spark, sf):
    return tree.field_filter(_chains(spark, sf), {"step": ("int", "2")}).select("session_key", "node_id")


@query("a11_chain_stacks", with_sql(_CHAIN, """
  SELECT session_key, string_agg('e' || k, ';') OVER (PARTITION BY session_key, k%20 ORDER BY event_ord) || ' ' || cents AS line FROM ev QUALIFY cents>0"""))
def a11_chain_stacks(spark, sf):
    return tree.folded_stacks(_chains(spark, sf))


@query("d15_process_descendants", with_sql(EV + """, p AS (SELECT session_key, row_number() OVER (PARTITION BY session_key ORDER BY event_ord) AS pid FROM ev),
   q AS (SELECT session_key, pid, CASE WHEN pid=5 THEN 11 ELSE pid//2 END AS ppid FROM p),
   d AS (SELECT session_key, pid, 0 AS depth FROM q WHERE pid=1 UNION ALL SELECT q.session_key, q.pid, d.depth+1 FROM q JOIN d ON d.session_key=q.session_key AND q.ppid=d.pid)""",
    "SELECT session_key, pid, depth FROM d"))
def d15_process_descendants(spark, sf):
    p = with_position(ev(spark, sf), ["session_key"], ["event_ord"], "pid", chunk=chunk_of())
    snap = p.select("session_key", "pid", F.when(F.col("pid") == 5, 11).otherwise(F.call_function("div", F.col("pid"), F.lit(2))).alias("ppid"))
    out = tree.descendants(snap, keys=["session_key"], root=F.lit(1), with_path=False)
    return out.select("session_key", "pid", F.col("depth").cast("bigint").alias("depth"))


# repeated (order, line) pairs occur, so children are only summed per order
@query("e20_pro_rata", """WITH ch AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS w, CASE WHEN l_partkey%5=0 THEN CAST(round(l_extendedprice) AS BIGINT) END AS ex FROM lineitem),
  s AS (SELECT l_orderkey, sum(w) FILTER (WHERE ex IS NULL) AS tw, coalesce(sum(ex), 0) AS te FROM ch GROUP BY 1)
  SELECT c.l_orderkey, c.l_partkey, c.l_suppkey, c.l_linenumber, CASE WHEN c.ex IS NOT NULL THEN c.ex WHEN s.tw>0 THEN CAST(greatest(0, CAST(round(o.o_totalprice) AS BIGINT)-s.te)*c.w//s.tw AS BIGINT) ELSE 0 END AS allocated_ns
  FROM ch c JOIN s USING (l_orderkey) JOIN orders o ON o.o_orderkey=c.l_orderkey""")
def e20_pro_rata(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.round("o_totalprice").cast("bigint").alias("total_ns"))
    ch = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("w"),
        F.when(F.col("l_partkey") % 5 == 0, F.round("l_extendedprice").cast("bigint")).alias("exact_ns"))
    out = gpu.allocate_pro_rata(o, ch, parent_key=["l_orderkey"], total="total_ns", weight="w")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "allocated_ns")


@query("e20_two_levels", """WITH ch AS (SELECT l_orderkey, l_suppkey%3 AS g, l_linenumber, CAST(l_quantity AS BIGINT) AS w, CASE WHEN l_partkey%5=0 THEN CAST(round(l_extendedprice) AS BIGINT) END AS ex,
    CAST(round(l_extendedprice) AS BIGINT) AS price FROM lineitem),
  en AS (SELECT l_orderkey, g, sum(w) AS n, CASE WHEN g=1 THEN CAST(sum(price)//3 AS BIGINT) ELSE 0 END AS t FROM ch GROUP BY 1, 2),
  po AS (SELECT l_orderkey, coalesce(sum(t) FILTER (WHERE g=1), 0) AS acc, sum(n) FILTER (WHERE g=0) AS un FROM en GROUP BY 1),
  al AS (SELECT e.l_orderkey, e.g, e.n, CASE WHEN e.g=1 THEN e.t WHEN e.g=0 THEN CAST(greatest(0, CAST(round(o.o_totalprice) AS BIGINT)-p.acc)*e.n//p.un AS BIGINT) END AS a
    FROM en e JOIN po p USING (l_orderkey) JOIN orders o ON o.o_orderkey=e.l_orderkey)
  SELECT c.l_orderkey, c.l_linenumber, c.g AS parent, al.a AS parent_ns, CAST(CASE WHEN al.a IS NULL THEN coalesce(c.ex, 0) ELSE al.a*c.w//al.n END AS BIGINT) AS child_ns
  FROM ch c JOIN al ON al.l_orderkey=c.l_orderkey AND al.g=c.g""")
def e20_two_levels(spark, sf):
    """Orders as buffers, their suppliers in three groups as encoders (untimed, timed, sampled), line items as dispatches."""
    key = ["l_orderkey", "parent"]
    price = F.round("l_extendedprice").cast("bigint")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.round("o_totalprice").cast("bigint").alias("total_ns"))
    ch = table(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_suppkey") % 3).alias("parent"), "l_linenumber", F.col("l_quantity").cast("bigint").alias("w"), price.alias("price"),
        F.when(F.col("l_partkey") % 5 == 0, price).alias("exact_ns"))
    en = ch.groupBy(*key).agg(F.when(F.col("parent") == 1, F.call_function("div", F.sum("price"), F.lit(3))).alias("exact_ns")).withColumn("sampled", F.col("parent") == 2)
    outer, inner = gpu.allocate_levels(o, en, ch.drop("price"), root_key=["l_orderkey"], parent_key=key, total="total_ns", weight="w")
    return inner.join(outer.withColumnRenamed("allocated_ns", "parent_ns"), key).select(
        "l_orderkey", "l_linenumber", "parent", "parent_ns", F.col("allocated_ns").alias("child_ns"))


_OPS = "ops AS (SELECT p_brand AS session_key, p_type AS name, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS gpu_ns, count(*) AS count FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1, 2)"


def _part_ops(spark, sf):
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    j = l.join(p, l["l_partkey"] == p["p_partkey"])
    return j.groupBy(F.col("p_brand").alias("session_key"), F.col("p_type").alias("name")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("gpu_ns"), F.count(F.lit(1)).alias("count"),
        F.first(F.lit(None).cast("string")).alias("symbol"), F.first(F.lit(None).cast("string")).alias("op_kind"))


@query("e7_part_op_percent", with_sql(_OPS, """
  SELECT session_key, name AS key, gpu_ns, rank, round(gpu_ns*100.0::DOUBLE/greatest(1, total), 6) AS pct FROM (
    SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY gpu_ns DESC, name) AS rank, sum(gpu_ns) OVER (PARTITION BY session_key) AS total FROM ops) WHERE rank<=3"""))
def e7_part_op_percent(spark, sf):
    flat = gpu.ops_flat(_part_ops(spark, sf))
    return gpu.op_summary(flat, top_n=3).select("session_key", "key", "gpu_ns", F.col("rank").cast("bigint").alias("rank"), F.round("pct", 6).alias("pct"))


_YEARS = """ y AS (SELECT year(o_orderdate) AS yr, c_nationkey, o_orderpriority, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) AS gpu_ns
   FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1, 2, 3)"""


def _year(spark, sf, year):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.where(F.year("o_orderdate") == year).join(c, o["o_custkey"] == c["c_custkey"])
    return rows.groupBy("c_nationkey", "o_orderpriority").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("gpu_ns"))


@query("d13_yearly_deltas", with_sql(_YEARS.strip(), """
  SELECT c_nationkey, o_orderpriority, coalesce(a.gpu_ns, 0) AS a_gpu_ns, coalesce(b.gpu_ns, 0) AS b_gpu_ns, coalesce(b.gpu_ns, 0)-coalesce(a.gpu_ns, 0) AS delta_ns,
    round(CASE WHEN coalesce(a.gpu_ns, 0)<>0 THEN (coalesce(b.gpu_ns, 0)-a.gpu_ns)::DOUBLE/a.gpu_ns*100 END, 4) AS delta_pct
  FROM (SELECT * FROM y WHERE yr=1997) a FULL OUTER JOIN (SELECT * FROM y WHERE yr=1998) b USING (c_nationkey, o_orderpriority)"""))
def d13_yearly_deltas(spark, sf):
    d = diff.delta(_year(spark, sf, 1997), _year(spark, sf, 1998), on=["c_nationkey", "o_orderpriority"], value="gpu_ns", how="full_outer")
    return d.withColumn("delta_pct", F.round("delta_pct", 4))


@query("g7_largest_changes", with_sql(_YEARS.strip(), """
  SELECT c_nationkey, o_orderpriority, b.gpu_ns-a.gpu_ns AS delta_ns FROM (SELECT * FROM y WHERE yr=1997) a JOIN (SELECT * FROM y WHERE yr=1998) b USING (c_nationkey, o_orderpriority)
  ORDER BY abs(b.gpu_ns-a.gpu_ns) DESC, c_nationkey, o_orderpriority LIMIT 20"""))
def g7_largest_changes(spark, sf):
    d = diff.delta(_year(spark, sf, 1997), _year(spark, sf, 1998), on=["c_nationkey", "o_orderpriority"], value="gpu_ns")
    return d.select("c_nationkey", "o_orderpriority", "delta_ns").orderBy(F.abs("delta_ns").desc(), "c_nationkey", "o_orderpriority").limit(20)


@query("h2_key_difference", "SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def h2_key_difference(spark, sf):
    return diff.only_in(table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")).distinct(),
                        table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey")), ["custkey"])


@query("h2_without_urgent", "SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority='1-URGENT')")
def h2_without_urgent(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderpriority")
    return diff.only_in(o.select("custkey").distinct(), o.where("o_orderpriority = '1-URGENT'"), ["custkey"])


@query("h3_streams_seen", with_sql(TL, "SELECT session_key, list_sort(list(DISTINCT stream)) AS streams FROM tl WHERE stream IS NOT NULL GROUP BY 1"))
def h3_streams_seen(spark, sf):
    e = trace_log(spark, sf).where(F.col("stream").isNotNull())
    return e.groupBy("session_key").agg(F.array_sort(F.collect_set("stream")).alias("streams"))


@query("h5_candidate_processes", with_sql(TL, """
  SELECT DISTINCT session_key, pid, name FROM (SELECT session_key, CAST(substr(session_key, 2) AS BIGINT)%50 AS pid, 'python' AS name FROM tl
   UNION ALL SELECT session_key, proc_pid, name FROM tl WHERE kind='ProcFootprint')"""))
def h5_candidate_processes(spark, sf):
    e = trace_log(spark, sf)
    s = e.select("session_key", F.lit("Scoped").alias("kind"), (F.substring("session_key", 2, 10).cast("bigint") % 50).alias("kind_pid"),
                 F.array(F.lit("/usr/bin/python")).alias("kind_argv")).distinct()
    return reports.known_processes(s, e)


@query("m10_recent_turns", "SELECT conv_id, turn, rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank<=2")
def m10_recent_turns(spark, sf):
    return S.recent(table(spark, sf, "conversations"), ["conv_id"], "turn", 2).select("conv_id", "turn", F.col("rank").cast("bigint").alias("rank"))


@query("b10_text_search", "SELECT doc_id FROM documents WHERE contains(lower(lang || ' ' || text), 'tion de')")
def b10_text_search(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"), F.col("text").alias("summary"))
    return filters.notice_search(d, "TION de").select("doc_id")
