"""Command-buffer lifetimes, the serialization clamp and GPU-time attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanforge.functions.labels import op_kind, op_label
from spanforge.operators import pairing
from spanforge.operators.scan import chunk_of, with_running
from spanforge.operators.stab import stab_join
from spanforge.schema import NS_PER_SEC
from spanforge.session_conf import cut_lineage

UNSCOPED = "<unscoped>"
UNSCOPED_ID = -1
DEFAULT_CELL_NS = NS_PER_SEC

_CB_KINDS = ("MetalCbCommitted", "MetalCbScheduled", "MetalCbCompleted", "MetalCbOps")


def queue_depth(df: DataFrame, *, keys: list[str], order: str, commit: Column, done: Column,
                chunk: Column | None = None) -> DataFrame:
    """Buffers in flight after each commit/completion, per queue."""
    rows = df.where(commit | done)
    return with_running(rows, keys, [order],
                        {"depth": ("sum", F.when(commit, 1).otherwise(-1))}, chunk=chunk)


def cb_events(events: DataFrame, *, chunk: Column | None = None) -> DataFrame:
    """Command-buffer rows with their pairing state.

    Buffer ids are recycled, so everything pairs by log order inside one id:
      * a completion is paired when the last commit/completion before it is a commit,
      * it has a clamp window when the last schedule/completion before it is a schedule,
      * the window starts at the schedule or the queue's previous completion.
    """
    chunk = chunk_of() if chunk is None else chunk
    kind = F.col("kind")
    rows = events.where(kind.isin(*_CB_KINDS)).select(
        "session_key", "event_ord", "ts_mono_ns", "kind", "cb_id", "queue_id", "in_flight_ns",
        "label", "status", "error_code", "error_domain", "ops")
    state = F.struct("kind", "event_ord", "ts_mono_ns", "queue_id", "label")
    rows = with_running(
        rows, ["session_key", "cb_id"], ["event_ord"],
        {"_commit": ("last", F.when(kind.isin("MetalCbCommitted", "MetalCbCompleted"), state)),
         "_sched": ("last", F.when(kind.isin("MetalCbScheduled", "MetalCbCompleted"), state))},
        chunk=chunk, before=True)
    done = events.where(kind == "MetalCbCompleted").select(
        "session_key", "event_ord", "ts_mono_ns", "queue_id")
    done = with_running(done, ["session_key", "queue_id"], ["event_ord"],
                        {"queue_prev_done": ("last", F.col("ts_mono_ns"))}, chunk=chunk, before=True)
    rows = rows.join(done.select("session_key", "event_ord", "queue_prev_done").hint("merge"),
                     ["session_key", "event_ord"], "left")
    completed = kind == "MetalCbCompleted"
    paired = completed & F.coalesce(F.col("_commit.kind") == "MetalCbCommitted", F.lit(False))
    sched_ts = F.when(completed & (F.col("_sched.kind") == "MetalCbScheduled"), F.col("_sched.ts_mono_ns"))
    # the clamp, the buffers and the diagnostics all read this, so it is written once
    return cut_lineage(rows.select(
        "session_key", "event_ord", "ts_mono_ns", "kind", "cb_id", "queue_id", "in_flight_ns",
        "status", "error_code", "error_domain", "ops",
        paired.alias("paired"),
        F.when(paired, F.col("_commit.ts_mono_ns")).alias("commit_ts"),
        F.when(paired, F.col("_commit.event_ord")).alias("commit_ord"),
        F.when(paired, F.col("_commit.queue_id")).alias("commit_queue_id"),
        F.when(paired, F.col("_commit.label")).alias("commit_label"),
        sched_ts.alias("sched_ts"),
        F.when(sched_ts.isNotNull(), F.greatest(F.lit(0), F.col("ts_mono_ns") - F.greatest(
            sched_ts, F.coalesce("queue_prev_done", F.lit(0))))).alias("window_ns")))


def clamped_ops(cbs: DataFrame, *, chunk: Column | None = None) -> DataFrame:
    """Ops events with their times scaled to the buffer's window, never up.

    A window belongs to the first ops event after the completion.  Adds the
    paired completion the ops belong to (``comp_ord``), the raw sum and the scale.
    """
    chunk = chunk_of() if chunk is None else chunk
    kind = F.col("kind")
    rows = cbs.where(kind.isin("MetalCbCompleted", "MetalCbOps")).select(
        "session_key", "event_ord", "ts_mono_ns", "kind", "cb_id", "ops", "paired", "window_ns")
    rows = with_running(
        rows, ["session_key", "cb_id"], ["event_ord"],
        {"_before": ("last", F.struct("kind", "window_ns")),
         "comp_ord": ("last", F.when(F.col("paired"), F.col("event_ord")))},
        chunk=chunk, before=True)
    total = F.aggregate("ops", F.lit(0).cast("bigint"), lambda acc, o: acc + o["gpu_ns"])
    rows = rows.where(kind == "MetalCbOps").select(
        "session_key", "event_ord", "ts_mono_ns", "cb_id", "ops", "comp_ord",
        total.alias("raw_ns"),
        F.when(F.col("_before.kind") == "MetalCbCompleted", F.col("_before.window_ns")).alias("window_ns"))
    rows = rows.withColumn(
        "scale", F.when(F.col("raw_ns") > F.col("window_ns"),
                        F.col("window_ns").cast("double") / F.col("raw_ns")))
    scaled = F.transform("ops", lambda o: F.struct(
        o["name"].alias("name"), o["symbol"].alias("symbol"),
        F.when(F.col("scale").isNull(), o["gpu_ns"])
        .otherwise((o["gpu_ns"].cast("double") * F.col("scale")).cast("bigint")).alias("gpu_ns"),
        o["count"].alias("count")))
    return rows.withColumn("ops", scaled).withColumn(
        "gpu_ns", F.aggregate("ops", F.lit(0).cast("bigint"), lambda acc, o: acc + o["gpu_ns"]))


def command_buffers(events: DataFrame, *, cbs: DataFrame | None = None,
                    ops: DataFrame | None = None, chunk: Column | None = None,
                    sampled: DataFrame | None = None) -> DataFrame:
    """Completed command buffers with the ops of their lifetime and their GPU time.

    GPU time is the op sum; without ops it is 0 when the session sampled ops at
    all, else the time in flight.  ``sampled`` names the sessions that did.
    """
    cbs = cb_events(events, chunk=chunk) if cbs is None else cbs
    ops = clamped_ops(cbs, chunk=chunk) if ops is None else ops
    attached = ops.where(F.col("comp_ord").isNotNull()).groupBy("session_key", "comp_ord").agg(
        F.max_by(F.struct("ops", "gpu_ns"), "event_ord").alias("o"))
    if sampled is None:
        sampled = events.where(F.col("kind") == "MetalCbOps").select("session_key").distinct()
    sampled = sampled.withColumn("sampled", F.lit(True))
    return (cbs.where(F.col("paired"))
            .withColumnRenamed("event_ord", "comp_ord").withColumnRenamed("ts_mono_ns", "done_ts")
            .drop("ops", "kind")
            .join(attached.hint("merge"), ["session_key", "comp_ord"], "left")
            .join(sampled, "session_key", "left")
            .withColumn("sampled", F.coalesce("sampled", F.lit(False)))
            .withColumns({"ops": F.col("o.ops"),
                          "gpu_ns": F.coalesce("o.gpu_ns", F.when(F.col("sampled"), 0)
                                               .otherwise(F.col("in_flight_ns")))})
            .drop("o", "paired"))


def attribute(points: DataFrame, evals: DataFrame, scopes: DataFrame, *, ts: str, grace_ns: int,
              cell: int, latest_eval: bool = False) -> DataFrame:
    """Attribute points to an eval window, else to the innermost scope.

    Both window sets enter one stab join: any eval beats any scope, the
    earliest eval wins (the latest one when ``latest_eval``), and among scopes
    the one entered last.
    """
    sign = 1 if latest_eval else -1
    as_eval = evals.select(
        "session_key", F.lit(1).alias("rank"), (F.lit(sign) * F.col("t_in")).alias("p1"),
        (F.lit(sign) * F.col("ret_ord")).alias("p2"), F.col("t_in").alias("lo"),
        F.col("t_out").alias("hi"), F.col("enter_ord"), F.col("enter_seq"),
        F.try_element_at("stack", F.lit(-1)).alias("call_id") if not latest_eval
        else F.lit(None).cast("bigint").alias("call_id"),
        (F.size("stack") == 0).alias("empty_stack"), "top_frame",
        F.lit(None).cast("string").alias("qualname"))
    as_scope = scopes.select(
        "session_key", F.lit(0).alias("rank"), F.col("t_in").alias("p1"),
        F.col("enter_ord").alias("p2"), F.col("t_in").alias("lo"),
        (F.col("t_out") + grace_ns).alias("hi"), F.col("enter_ord"),
        F.lit(None).cast("bigint").alias("enter_seq"), "call_id",
        F.lit(None).cast("boolean").alias("empty_stack"),
        F.lit(None).cast("string").alias("top_frame"), "qualname")
    return stab_join(
        points, as_eval.unionByName(as_scope), by=["session_key"], ts=ts, lo="lo", hi="hi",
        prefer=F.struct("rank", "p1", "p2"), cell=cell,
        keep=["rank", "lo", "hi", "enter_ord", "enter_seq", "call_id", "empty_stack", "top_frame", "qualname"])


def attributed_buffers(events: DataFrame, *, grace_ns: int = pairing.ASYNC_GRACE_NS,
                       cell: int = DEFAULT_CELL_NS, calls: DataFrame | None = None,
                       evals: DataFrame | None = None, buffers: DataFrame | None = None,
                       scopes: DataFrame | None = None, chunk: Column | None = None) -> DataFrame:
    """Completed buffers with the scope call their GPU time belongs to.

    ``via`` is eval, scope, unscoped_eval (an eval outside any known call) or
    unmatched; ``node_id`` is the call id or -1.
    """
    calls = pairing.scope_calls(events, chunk=chunk) if calls is None else calls
    scopes = pairing.scope_windows(events, calls=calls) if scopes is None else scopes
    evals = pairing.eval_windows(events, grace_ns=grace_ns, chunk=chunk) if evals is None else evals
    buffers = command_buffers(events, chunk=chunk) if buffers is None else buffers
    hit = attribute(buffers, evals, scopes, ts="commit_ts", grace_ns=grace_ns, cell=cell)
    known = calls.select("session_key", F.col("call_id").alias("_leaf")).distinct().withColumn("_known", F.lit(True))
    hit = hit.withColumn("_leaf", F.col("win.call_id")).join(known.hint("merge"), ["session_key", "_leaf"], "left")
    on_node = F.col("_known").isNotNull()
    via = (F.when(F.col("win").isNull(), "unmatched")
           .when((F.col("win.rank") == 1) & on_node, "eval")
           .when(F.col("win.rank") == 1, "unscoped_eval").otherwise("scope"))
    return hit.withColumns({"via": via,
                            "node_id": F.when(via.isin("eval", "scope"), F.col("_leaf")).otherwise(UNSCOPED_ID)}
                           ).drop("_leaf", "_known")


def scope_totals(attributed: DataFrame, evals: DataFrame, calls: DataFrame) -> DataFrame:
    """Own GPU time, eval count and buffer count of every scope call and of <unscoped>."""
    per_buffer = attributed.groupBy("session_key", "node_id").agg(
        F.sum("gpu_ns").alias("gpu_ns_self"), F.count(F.lit(1)).alias("cb_count"))
    known = calls.select("session_key", F.col("call_id").alias("node_id"), F.lit(True).alias("_known")).distinct()
    per_eval = (evals.withColumn("node_id", F.try_element_at("stack", F.lit(-1)))
                .join(known.hint("merge"), ["session_key", "node_id"], "left")
                .groupBy("session_key", F.when(F.col("_known"), F.col("node_id"))
                         .otherwise(UNSCOPED_ID).alias("node_id"))
                .agg(F.count(F.lit(1)).alias("eval_count")))
    nodes = pairing._last_enter_per_id(calls).select(
        "session_key", F.col("call_id").alias("node_id"), "enter_ord", "qualname", "class_name",
        "parent_call_id", "fields")
    zero = F.lit(0).cast("bigint")
    merged = (per_buffer.join(per_eval, ["session_key", "node_id"], "full_outer")
              .join(nodes, ["session_key", "node_id"], "full_outer"))
    unscoped = F.col("node_id") == UNSCOPED_ID
    return merged.select(
        "session_key", "node_id", "enter_ord",
        F.when(unscoped, UNSCOPED).otherwise(F.col("qualname")).alias("qualname"),
        F.when(unscoped, "").otherwise(F.col("class_name")).alias("class_name"),
        "parent_call_id", "fields",
        F.when(unscoped, 0).otherwise(1).alias("calls"),
        F.coalesce("gpu_ns_self", zero).alias("gpu_ns_self"),
        F.coalesce("eval_count", zero).alias("eval_count"),
        F.coalesce("cb_count", zero).alias("cb_count"))


def node_ops(attributed: DataFrame) -> DataFrame:
    """Ops per scope call by op name, with the first known symbol."""
    rows = attributed.where(F.col("ops").isNotNull()).select(
        "session_key", "node_id", "comp_ord", F.posexplode("ops").alias("pos", "o"))
    first = F.min_by("o.symbol", F.when(F.col("o.symbol").isNotNull(), F.struct("comp_ord", "pos")))
    return (rows.groupBy("session_key", "node_id", F.col("o.name").alias("name"))
            .agg(F.sum("o.gpu_ns").alias("gpu_ns"), F.sum("o.count").alias("count"),
                 first.alias("symbol"))
            .withColumn("op_kind", op_kind(F.col("symbol"))))


def node_ops_by_kind(ops: DataFrame) -> DataFrame:
    """Per-node ops regrouped by kind, else symbol, else name."""
    key = F.coalesce("op_kind", "symbol", "name")
    return ops.groupBy("session_key", "node_id", key.alias("key")).agg(
        F.sum("gpu_ns").alias("gpu_ns"), F.sum("count").alias("count"),
        F.max("op_kind").alias("op_kind"))


def ops_flat(ops: DataFrame, *, group_by: str = "name") -> DataFrame:
    """Ops of a whole session by name or by kind.

    In kind mode a row spans many kernels, so it carries no symbol.
    """
    if group_by not in ("name", "kind"):
        raise ValueError(f"group_by must be 'name' or 'kind', got {group_by!r}")
    key = F.col("name") if group_by == "name" else F.coalesce("op_kind", "symbol", "name")
    symbol = F.min("symbol") if group_by == "name" else F.lit(None).cast("string")
    return ops.groupBy("session_key", key.alias("key")).agg(
        F.sum("gpu_ns").alias("gpu_ns"), F.sum("count").alias("count"),
        symbol.alias("symbol"), F.min("op_kind").alias("op_kind"))


def op_summary(flat: DataFrame, *, top_n: int = 10) -> DataFrame:
    """Top ops per session with their share of the session's whole op time."""
    totals = flat.groupBy("session_key").agg(F.sum("gpu_ns").alias("_total"))
    top = top_per_group(flat, ["session_key"], [F.col("gpu_ns").desc(), F.col("key")], top_n)
    return (top.join(totals, "session_key")
            .withColumn("pct", F.col("gpu_ns") / F.greatest(F.lit(1), F.col("_total")) * 100.0)
            .drop("_total"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                  rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group; Spark drops later rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def diagnostics(events: DataFrame, attributed: DataFrame, ops: DataFrame, *,
                chunk: Column | None = None) -> DataFrame:
    """One row per session of what the attribution could not place or had to adjust."""
    buffers = attributed.groupBy("session_key").agg(
        F.sum(F.when(F.col("node_id") == UNSCOPED_ID, F.col("gpu_ns")).otherwise(0)).alias("unscoped_gpu_ns"),
        F.count_if(F.col("via") == "unmatched").alias("unmatched_cb_count"),
        F.count_if(F.col("sampled") & F.col("ops").isNull()).alias("ops_cbs_without_samples"),
        F.count_if(F.col("via") == "scope").alias("cbs_scope_attributed"))
    clamped = ops.groupBy("session_key").agg(
        F.count_if(F.col("scale").isNotNull()).alias("cbs_op_time_clamped"))
    base = events.select("session_key").distinct()
    out = (base.join(buffers, "session_key", "left")
           .join(pairing.malformed_returns(events, chunk=chunk), "session_key", "left")
           .join(clamped, "session_key", "left"))
    cols = ["unscoped_gpu_ns", "unmatched_cb_count", "malformed_returns", "ops_cbs_without_samples",
            "cbs_scope_attributed", "cbs_op_time_clamped"]
    return out.select("session_key", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in cols])


def dispatch_origins(events: DataFrame, *, grace_ns: int = pairing.ASYNC_GRACE_NS,
                     cell: int = DEFAULT_CELL_NS, ops: DataFrame | None = None,
                     evals: DataFrame | None = None, scopes: DataFrame | None = None,
                     chunk: Column | None = None) -> DataFrame:
    """GPU time and dispatches by op kind and source line.

    Ops events are matched on their own time: the latest eval window that has a
    frame, else the innermost scope as ``scope:<name>``; ops in neither drop.
    """
    if ops is None:
        ops = cut_lineage(clamped_ops(cb_events(events, chunk=chunk), chunk=chunk))
    evals = pairing.eval_windows(events, grace_ns=grace_ns, chunk=chunk) if evals is None else evals
    scopes = pairing.scope_windows(events) if scopes is None else scopes
    hit = attribute(ops, evals.where(F.col("top_frame").isNotNull()), scopes, ts="ts_mono_ns", grace_ns=grace_ns, cell=cell, latest_eval=True)
    where = F.coalesce(F.col("win.top_frame"), F.concat(F.lit("scope:"), F.col("win.qualname")))
    rows = hit.where(F.col("win").isNotNull()).select(
        "session_key", where.alias("file_line"), F.explode("ops").alias("o"))
    return rows.groupBy("session_key", op_label(F.col("o.symbol"), F.col("o.name")).alias("op_kind"),
                        "file_line").agg(
        F.sum("o.gpu_ns").alias("gpu_ns"), F.sum("o.count").alias("dispatch_count"))


def allocate_pro_rata(parents: DataFrame, children: DataFrame, *, parent_key: list[str],
                      total: str, weight: str) -> DataFrame:
    """Split a parent's total over its children by weight, in integers.

    Children with a known ``exact_ns`` keep it; the rest share what is left
    (never below 0) by weight.
    """
    sums = children.groupBy(*parent_key).agg(
        F.sum(F.when(F.col("exact_ns").isNull(), F.col(weight))).alias("_w"),
        F.sum("exact_ns").alias("_exact"))
    left = F.greatest(F.lit(0).cast("bigint"), F.col(total) - F.coalesce("_exact", F.lit(0)))
    share = F.call_function("div", left * F.col(weight), F.col("_w"))
    return (children.join(parents.select(*parent_key, total).join(sums, parent_key), parent_key)
            .withColumn("allocated_ns", F.when(F.col("exact_ns").isNotNull(), F.col("exact_ns"))
                        .when(F.col("_w") > 0, share).otherwise(0))
            .drop("_w", "_exact"))


def allocate_levels(roots: DataFrame, parents: DataFrame, children: DataFrame, *, root_key: list[str], parent_key: list[str],
                    total: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """Split a root's total over its parents and each parent's part over its children, in integers.

    A parent with a known ``exact_ns`` above 0 keeps it; what is left of the root's total
    (never below 0) goes to the untimed parents by the weight of their children.  Children
    share their parent's part by weight.  A parent that is ``sampled`` takes no part in this:
    its children have their own ``exact_ns``, or nothing.  ``parent_key`` includes
    ``root_key``; children are ever grouped by parent, so a root may have any number.
    """
    zero = F.lit(0).cast("bigint")
    counts = children.groupBy(*parent_key).agg(F.sum(weight).alias("_n"))
    sampled, exact = F.coalesce("sampled", F.lit(False)), F.coalesce("exact_ns", zero)
    known = parents.join(counts, parent_key, "left").withColumns({"_n": F.coalesce("_n", zero), "_timed": ~sampled & (exact > 0), "_open": ~sampled & (exact <= 0)})
    pools = known.groupBy(*root_key).agg(F.sum(F.when(F.col("_timed"), exact)).alias("_accounted"), F.sum(F.when(F.col("_open"), F.col("_n"))).alias("_untimed"))
    left = F.greatest(zero, F.col(total) - F.coalesce("_accounted", zero))
    share = F.when(F.col("_untimed") > 0, F.call_function("div", left * F.col("_n"), F.col("_untimed"))).otherwise(zero)
    levels = known.join(roots.select(*root_key, total).join(pools, root_key), root_key).withColumn(
        "allocated_ns", F.when(F.col("_timed"), exact).when(F.col("_open"), share))
    outer = levels.select(*parent_key, "allocated_ns")
    inner = children.join(levels.select(*parent_key, F.col("allocated_ns").alias("_part"), "_n"), parent_key).withColumn(
        "allocated_ns", F.when(F.col("_part").isNull(), F.coalesce("exact_ns", zero))
        .when(F.col("_n") > 0, F.call_function("div", F.col("_part") * F.col(weight), F.col("_n"))).otherwise(zero)).drop("_part", "_n")
    return outer, inner
