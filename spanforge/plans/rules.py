"""Diagnostic rules: each turns a session's events into findings.

A rule is registered in report order and run as ``RuleContext -> DataFrame`` of the finding
columns.  All sessions are analysed by one job.

Rules that only filter and aggregate share one conditional aggregate, ``facts``: a row per
session, from which each states its findings as a list of cases.  However many of them run,
the log is aggregated once and their findings come out of one ``inline``.  Rules that pair
or order events read them from ``parts``, the few kinds and columns that rules need, which
is written once, a folder for each group of kinds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from spanforge.functions.labels import error_name, is_watchdog
from spanforge.functions.text import basename, decimal_gb
from spanforge.operators import gpu, memory, pairing, sequences
from spanforge.operators.scan import chunk_of
from spanforge.schema import FINDING_COLUMNS, NS_PER_SEC
from spanforge.session_conf import cut_lineage

RULES: dict[str, Callable[["RuleContext"], DataFrame]] = {}
#: Of the rules that need nothing but the facts, the cases (condition, finding) by name.
FACT_RULES: dict[str, Callable[[], list[tuple[Column, Column]]]] = {}
POSITIONS: dict[str, int] = {}

# Process names (parts) that aggravate crashes when busy.
# an operating system has fewer process ids than this, so a table has fewer rows
TABLE_ROWS = 1 << 22
PRESSURE_NAMES = ("ReportCrash", "diagnosticservicesd", "crashanalyticsd", "spindump", "syslogd")

#: Kinds that rules read row by row, by the part of the log that holds them.
PARTS = {
    "buffers": ("MetalCbCommitted", "MetalCbScheduled", "MetalCbCompleted", "MetalCbOps"),
    "evals": ("MlxEvalEntered", "MlxEvalReturned"),
    "scopes": ("ModuleEntered", "ModuleReturned"),
    "models": ("ModelLoad", "ModelUnload"),
    "samples": ("MetalDeviceMemSample",),
    "processes": ("ProcTop",),
}
_PART_COLUMNS = (
    "session_key", "event_ord", "ts_mono_ns", "seq", "kind", "cb_id", "queue_id", "queue_depth", "in_flight_ns", "label", "status",
    "error_code", "error_domain", "ops", "call_id", "duration_ns", "was_async", "module_stack", "stack_frames", "module_call_id",
    "qualname", "class_name", "parent_call_id", "depth", "fields", "path", "size_bytes", "t_start_ns", "t_end_ns", "sha8", "framework",
    "allocated_bytes", "recommended_max_bytes", "top")


def _register(name: str, run: Callable[["RuleContext"], DataFrame]) -> Callable[["RuleContext"], DataFrame]:
    POSITIONS[name] = len(RULES)

    def placed(ctx: RuleContext) -> DataFrame:
        return run(ctx).withColumns({"rule_pos": F.lit(POSITIONS[name]), "rule": F.lit(name)}).select(*FINDING_COLUMNS)

    RULES[name] = placed
    return placed


def rule(name: str):
    """Register a rule; its position is the registration order."""
    return lambda fn: _register(name, fn)


def fact_rule(name: str):
    """Register a rule that states its cases on the columns of the facts."""

    def add(fn):
        FACT_RULES[name] = fn
        return _register(name, lambda ctx: ctx.facts.select("session_key", F.inline(_held(fn()))))

    return add


def _held(cases: list[tuple[Column, Column]]) -> Column:
    return F.filter(F.array(*(F.when(case, found) for case, found in cases)), lambda f: f.isNotNull())


def fact_findings(ctx: "RuleContext", names: list[str]) -> DataFrame:
    """The findings of several rules on the facts, out of one pass over them."""
    cases = [(case, F.struct(F.lit(POSITIONS[n]).alias("rule_pos"), F.lit(n).alias("rule"), found.alias("f"))) for n in names for case, found in FACT_RULES[n]()]
    return ctx.facts.select("session_key", F.inline(_held(cases))).select("session_key", "rule_pos", "rule", "f.*").select(*FINDING_COLUMNS)


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


@dataclass
class RuleContext:
    """Events of any number of sessions and the intermediates rules share.

    With ``fused`` the facts and the parts are written once, for several rules.
    """

    events: DataFrame
    grace_ns: int = pairing.ASYNC_GRACE_NS
    cell: int = gpu.DEFAULT_CELL_NS
    band_ns: int = 5 * NS_PER_SEC
    gap_ns: int = 5 * NS_PER_SEC
    chunk: Column | None = None
    options: dict = field(default_factory=dict)
    fused: bool = False

    @cached_property
    def _parts(self) -> DataFrame:
        part = F.coalesce(*(F.when(_is(*kinds), name) for name, kinds in PARTS.items()))
        wanted = self.events.where(_is(*(k for kinds in PARTS.values() for k in kinds)))
        return cut_lineage(wanted.select(*_PART_COLUMNS, part.alias("part")), by="part")

    def part(self, name: str) -> DataFrame:
        """The rows of a group of kinds."""
        if self.fused:
            return self._parts.where(F.col("part") == name).drop("part")
        return self.events.where(_is(*PARTS[name]))

    @cached_property
    def facts(self) -> DataFrame:
        """What single rows of a session's log say, one row per session."""
        order, done, commit, poll = F.col("event_ord"), _is("MetalCbCompleted"), _is("MetalCbCommitted"), _is("MlxMemoryPoll")
        failed = done & F.col("error_code").isNotNull() & (F.col("error_code") != 0)
        skipped, lost, reason = _is("MetalHookSkipped"), _is("MetalHookDropped"), F.coalesce("reason", F.lit(""))
        at = F.struct("seq", "ts_mono_ns")
        buffer = F.struct("seq", "ts_mono_ns", "cb_id", "queue_depth", "in_flight_ns")

        def first(value: Column, case: Column) -> Column:
            return F.min_by(value, F.when(case, order))

        def largest(value: Column, metric: str, case: Column) -> Column:
            return F.max_by(value, F.when(case, F.struct(metric, -order)))

        aggs = {
            "event_count": F.count(F.lit(1)), "t0": F.min_by("ts_mono_ns", "event_ord"),
            "end_ts": F.max_by("ts_mono_ns", "event_ord"), "end_ord": F.max("event_ord"),
            "failure": first(F.struct(F.col("ts_mono_ns").alias("fail_ts"), F.col("seq").alias("fail_seq")), failed),
            "deepest": largest(buffer, "queue_depth", commit), "slowest": largest(buffer, "in_flight_ns", done),
            "cache": largest(F.struct("cache_bytes", "seq", "ts_mono_ns"), "cache_bytes", poll),
            "active": F.max(F.when(poll, F.col("active_bytes"))),
            "has_sidecar": F.max(_is("PythonSidecarHello", "ModuleEntered", "MlxEvalEntered")),
            "cb_count": F.count_if(done), "has_footprint": F.max(_is("ProcFootprint")), "first_done": first(at, done),
            "ops_events": F.count_if(_is("MetalCbOps")), "module_call_count": F.count_if(_is("ModuleEntered")),
            "lost": F.sum(F.when(lost, F.col("dropped_count"))), "lost_first": first(F.struct("seq", "ts_mono_ns", "reason"), lost)}
        cases = {"bad": reason.contains("ring decode error")}
        for side in ("stage", "dispatch"):
            off = reason.contains(f"{side} sampling disabled")
            cases |= {f"{side}_off": off, f"{side}_on": reason.contains(f"{side} sampling re-enabled") & ~off}
        for name, case in cases.items():
            aggs[name] = F.count_if((skipped | lost) & case)
            aggs[f"{name}_first"] = first(F.struct("seq", "ts_mono_ns", "reason"), (skipped | lost) & case)
        facts = self.events.groupBy("session_key").agg(*[c.alias(n) for n, c in aggs.items()])
        return cut_lineage(facts) if self.fused else facts

    @cached_property
    def failures(self) -> DataFrame:
        return self.part("buffers").where(_is("MetalCbCompleted") & F.col("error_code").isNotNull() & (F.col("error_code") != 0))

    @cached_property
    def first_failure(self) -> DataFrame:
        return self.facts.where(F.col("failure").isNotNull()).select("session_key", "failure.*")

    @cached_property
    def evals(self) -> DataFrame:
        return pairing.eval_windows(self.part("evals"), grace_ns=self.grace_ns, chunk=self.chunk)

    @cached_property
    def scopes(self) -> DataFrame:
        part = self.part("scopes")
        return pairing.scope_windows(part, calls=pairing.scope_calls(part), ends=self.facts.select("session_key", "end_ts", "end_ord"))

    @cached_property
    def over_budget(self) -> DataFrame:
        return memory.over_budget_windows(self.part("samples"), gap_ns=self.gap_ns, scopes=self.scopes, chunk=self.chunk)

    @cached_property
    def buffers(self) -> DataFrame:
        return cut_lineage(gpu.command_buffers(self.part("buffers"), chunk=self.chunk, sampled=self.facts.where("ops_events > 0").select("session_key")))


def evidence(seq: Column, ts: Column, text: Column) -> Column:
    return F.array(F.struct(seq.cast("bigint").alias("seq"), ts.cast("bigint").alias("ts_mono_ns"),
                            text.alias("description")))


def no_evidence() -> Column:
    return F.array().cast("array<struct<seq:bigint,ts_mono_ns:bigint,description:string>>")


def found(*, severity, category: str, title: Column, detail=None, ev=None, pos=None) -> Column:
    """A finding as a struct."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    cat = F.lit(category) if isinstance(category, str) else category
    return F.struct((F.lit(0) if pos is None else pos).cast("bigint").alias("finding_pos"), sev.alias("severity"), cat.alias("category"),
                    title.alias("title"), (F.lit("") if detail is None else detail).alias("detail"),
                    (no_evidence() if ev is None else ev).alias("evidence"))


def finding(df: DataFrame, **parts) -> DataFrame:
    """One finding for each row."""
    return df.select("session_key", found(**parts).alias("f")).select("session_key", "f.*")


def _gb(c: Column) -> Column:
    return F.format_string("%.2f GB", decimal_gb(c))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


@rule("metal_error")
def metal_error(ctx: RuleContext) -> DataFrame:
    """Every failed completion; watchdog codes are the root cause."""
    code, fatal = F.col("error_code"), is_watchdog(F.col("error_code"))
    return finding(
        ctx.failures, severity=F.when(fatal, "Critical").otherwise("Warning"),
        category=F.when(fatal, "RootCause").otherwise("ContributingFactor"), pos=F.col("event_ord"),
        title=F.concat(F.lit("Command buffer "), F.col("cb_id").cast("string"), F.lit(" failed with "),
                       error_name(code), F.lit(" (code "), code.cast("string"), F.lit(", domain "),
                       F.coalesce("error_domain", F.lit("?")), F.lit(")")),
        ev=evidence(F.col("seq"), F.col("ts_mono_ns"),
                    F.format_string("completion of cb_id=%d, error_code=%d", "cb_id", "error_code")))


@rule("queue_depth")
def queue_depth(ctx: RuleContext) -> DataFrame:
    """Deepest queue shortly before the first failure."""
    band = (ctx.part("buffers").where(_is("MetalCbCommitted")).join(ctx.first_failure, "session_key")
            .where(F.col("ts_mono_ns").between(F.col("fail_ts") - ctx.band_ns, F.col("fail_ts"))))
    top = sequences.first_max(band, keys=["session_key"], metric="queue_depth", order="event_ord").where(
        F.col("queue_depth") > 0)
    return finding(
        top, severity="Warning", category="ContributingFactor",
        title=F.format_string("Queue depth peaked at %d buffers in flight", "queue_depth"),
        detail=F.format_string("Seen at cb_id=%d, %.2fs before the failing buffer", F.col("cb_id"),
                               (F.col("fail_ts") - F.col("ts_mono_ns")) / 1e9),
        ev=evidence(F.col("fail_seq"), F.col("fail_ts"), F.lit("first failed completion")))


@fact_rule("queue_pressure")
def queue_pressure(depth_limit: int = 32, in_flight_limit: int = NS_PER_SEC) -> list[tuple[Column, Column]]:
    """Deep queues or slow buffers in sessions without a failure."""
    depth, slow = F.coalesce("deepest.queue_depth", F.lit(0)), F.coalesce("slowest.in_flight_ns", F.lit(0))
    deep, late = depth >= depth_limit, slow >= in_flight_limit
    ev = F.concat(
        F.when(deep, evidence(F.col("deepest.seq"), F.col("deepest.ts_mono_ns"), F.format_string("commit at queue depth %d", depth)))
        .otherwise(no_evidence()),
        F.when(late, evidence(F.col("slowest.seq"), F.lit(0), F.format_string(
            "cb_id=%d was in flight %dms", F.col("slowest.cb_id"), _div(slow, 1_000_000)))).otherwise(no_evidence()))
    return [(F.col("failure").isNull() & (deep | late), found(
        severity="Warning", category="ContributingFactor",
        title=F.format_string("Command queue backed up: depth %d and longest wait %dms", depth, _div(slow, 1_000_000)),
        detail=F.lit(f"Reported from {depth_limit} waiting buffers, or {in_flight_limit // NS_PER_SEC}s of waiting, on. "
                     "Submit less at once, or wait for the queue between phases."), ev=ev))]


@rule("mlx_timing")
def eval_timing(ctx: RuleContext, adjacent: int = 5, slow_n: int = 5) -> DataFrame:
    """Evals just before the first failure, and one timing summary per session."""
    columns = ("session_key", "event_ord", "seq", "ts_mono_ns", "kind", "call_id", "duration_ns", "was_async")
    # the ranks, the slowest and those near the failure all read this
    recs = cut_lineage(sequences.entered_by_last_seen(
        ctx.part("evals").select(*columns), keys=["session_key"], order="event_ord", ident="call_id", begin=_is("MlxEvalEntered"),
        end=_is("MlxEvalReturned"), value=F.col("ts_mono_ns"), chunk=chunk_of() if ctx.chunk is None else ctx.chunk))
    mode = F.when(F.col("was_async"), "async").otherwise("sync")
    near = sequences.last_before(recs, ctx.first_failure, keys=["session_key"], ts="ts_mono_ns", anchor="fail_ts",
                                 order="event_ord", n=adjacent)
    back = lambda c: (F.col("fail_ts") - c) / 1e9
    per_eval = finding(
        near, severity="Info", category="Timing", pos=F.lit(adjacent) - F.col("rank"),
        title=F.format_string("eval call_id=%d returned (%s, %dms)", F.col("call_id"), mode,
                              _div(F.col("duration_ns"), 1_000_000)),
        detail=F.concat_ws(", ", F.when(F.col("entered").isNotNull(),
                                        F.format_string("entered %.2fs before the failure", back(F.col("entered")))),
                           F.format_string("returned %.2fs before the failure", back(F.col("ts_mono_ns")))),
        ev=evidence(F.col("seq"), F.col("ts_mono_ns"), F.format_string("return of eval call_id=%d", "call_id")))

    ranks = sequences.nearest_rank(recs, keys=["session_key"], value="duration_ns",
                                   probs={"p50": 0.5, "p95": 0.95})
    slow = sequences.slowest(recs, keys=["session_key"], metric="duration_ns", order="event_ord", n=slow_n)
    lines = slow.groupBy("session_key").agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", F.format_string("call_id=%d %dms (%s)", F.col("call_id"), _div(F.col("duration_ns"), 1_000_000),
                                    mode).alias("text")))).alias("l"),
        F.min_by(F.struct("seq", "ts_mono_ns", "call_id"), "rank").alias("worst"))
    counts = recs.groupBy("session_key").agg(F.count_if(F.col("was_async")).alias("n_async"))
    ms = lambda c: _div(F.col(c), 1_000_000)
    summary = ranks.join(lines, "session_key").join(counts, "session_key")
    total = finding(
        summary, severity="Info", category="Timing", pos=F.lit(adjacent + 1),
        title=F.format_string("eval timing: %d calls (%d sync, %d async), p50 %dms, p95 %dms, max %dms", F.col("n"),
                              F.col("n") - F.col("n_async"), F.col("n_async"), ms("p50"), ms("p95"), ms("max_value")),
        detail=F.concat(F.lit("slowest: "), F.array_join(F.transform("l", lambda x: x["text"]), ", ")),
        ev=evidence(F.col("worst.seq"), F.col("worst.ts_mono_ns"),
                    F.format_string("slowest eval call_id=%d", F.col("worst.call_id"))))
    return per_eval.unionByName(total)


@fact_rule("mlx_cache_growth")
def cache_growth(ratio: float = 1.25, floor: int = 1_000_000_000) -> list[tuple[Column, Column]]:
    """Peak cache well above peak active memory."""
    cache, active = F.col("cache.cache_bytes"), F.col("active")
    grown = (cache >= floor) & (active > 0) & (F.try_divide(cache.cast("double"), active) >= ratio)
    return [(grown, found(
        severity="Warning", category="ContributingFactor",
        title=F.lit("Allocator cache exceeds the memory in use"),
        detail=F.concat(F.lit("Cache peaked at "), _gb(cache), F.lit(", active memory at "), _gb(active),
                        F.format_string(" (x%.2f). Freed buffers are being retained; check the cache limit.",
                                        cache.cast("double") / active)),
        ev=evidence(F.col("cache.seq"), F.col("cache.ts_mono_ns"), F.concat(F.lit("cache peak "), _gb(cache)))))]


@rule("memory_pressure")
def memory_pressure(ctx: RuleContext, max_lines: int = 8) -> DataFrame:
    """Device memory near or over its budget, one finding listing the windows."""
    w = ctx.over_budget.join(ctx.facts.select("session_key", "t0"), "session_key")
    rel = lambda c: _div(F.greatest(F.lit(0).cast("bigint"), F.col(c) - F.col("t0")), NS_PER_SEC)
    pct = F.round(F.col("peak_ratio") * 100).cast("bigint")
    w = w.withColumns({"pct": pct, "line": F.concat(
        F.lit("t+"), rel("start_ts_mono_ns").cast("string"), F.lit("s..t+"), rel("end_ts_mono_ns").cast("string"),
        F.lit("s peak "), F.col("peak_bytes").cast("string"), F.lit(" bytes ("), pct.cast("string"),
        F.lit("%) in "), F.col("peak_scope")), "rel_peak": rel("peak_ts_mono_ns")})
    worst = w.groupBy("session_key").agg(
        F.max_by(F.struct("peak_ratio", "pct", "peak_bytes", "recommended_max_bytes", "peak_scope", "peak_seq",
                          "peak_ts_mono_ns", "rel_peak"), F.struct("peak_ratio", "island")).alias("b"),
        F.count(F.lit(1)).alias("n"))
    first = gpu.top_per_group(w, ["session_key"], [F.col("island")], max_lines).groupBy("session_key").agg(
        F.array_sort(F.collect_list(F.struct("island", "line"))).alias("l"))
    j = worst.join(first, "session_key")
    over = F.col("b.peak_ratio") > 1.0
    more = F.when(F.col("n") > max_lines, F.format_string("... %d more", F.col("n") - max_lines))
    return finding(
        j, severity=F.when(over, "Critical").otherwise("Warning"), category="ContributingFactor",
        title=F.concat(F.when(over, "Device memory over its budget (").otherwise("Device memory near its budget ("),
                       F.col("b.pct").cast("string"), F.lit("%) in scope "), F.col("b.peak_scope")),
        detail=F.concat_ws("\n", F.concat(
            F.lit("peak "), F.col("b.peak_bytes").cast("string"), F.lit(" of "),
            F.col("b.recommended_max_bytes").cast("string"), F.lit(" bytes; "), F.col("n").cast("string"),
            F.lit(" window(s)")), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), more),
        ev=evidence(F.col("b.peak_seq"), F.col("b.peak_ts_mono_ns"),
                    F.format_string("worst peak at t+%ds", F.col("b.rel_peak"))))


@rule("system_pressure")
def system_pressure(ctx: RuleContext, cpu: float = 5.0) -> DataFrame:
    """Busy processes known to aggravate crashes."""
    rows = ctx.part("processes").select("session_key", "event_ord", "seq", "ts_mono_ns", F.posexplode("top").alias("i", "p"))
    rows = rows.where((F.col("p.cpu_pct") >= F.lit(cpu).cast("float")) & F.col("p.name").rlike("|".join(PRESSURE_NAMES)))
    return finding(
        rows, severity="Warning", category="SystemPressure", pos=F.col("event_ord") * TABLE_ROWS + F.col("i"),
        title=F.format_string("%s using %.1f%% CPU", F.col("p.name"), F.col("p.cpu_pct")),
        ev=evidence(F.col("seq"), F.col("ts_mono_ns"), F.concat(F.lit("process sample at "), F.col("ts_mono_ns").cast("string"))))


@rule("duplicate-model-load")
def duplicate_model_load(ctx: RuleContext) -> DataFrame:
    """A model file loaded again while still loaded."""
    dup = pairing.model_loads(ctx.part("models"), chunk=ctx.chunk).where(F.col("duplicate_of").isNotNull())
    return finding(
        dup, severity="Warning", category="ContributingFactor", pos=F.col("event_ord"),
        title=F.concat(F.lit("Model "), basename(F.col("path")),
                       F.format_string(" loaded again without an unload (%.1f MB)", F.col("size_bytes") / 1048576.0)),
        detail=F.concat(F.col("path"), F.lit(": first at "), F.col("duplicate_of_ts").cast("string"),
                        F.lit(" ns, again at "), F.col("t_end_ns").cast("string"), F.lit(" ns, "),
                        F.col("size_bytes").cast("string"), F.lit(" bytes")),
        ev=evidence(F.col("seq"), F.col("t_end_ns"), F.concat(F.lit("load of "), F.col("path"))))


@fact_rule("hook_degradation")
def capture_degradation() -> list[tuple[Column, Column]]:
    """Capture gaps: sampling switched off, corrupt frames, dropped events."""
    why = lambda f, head: evidence(F.col(f"{f}.seq"), F.col(f"{f}.ts_mono_ns"),
                                   F.concat_ws(": ", F.lit(head), F.col(f"{f}.reason")))
    out = []
    for i, side in enumerate(("stage", "dispatch")):
        out.append((F.col(f"{side}_off") > 0, found(
            severity="Warning", category="ContributingFactor", pos=F.lit(i),
            title=F.format_string(f"Op timing degraded: {side} sampling disabled %d time(s)", f"{side}_off"),
            detail=F.format_string("Per-op GPU numbers are incomplete over those spans (re-enabled %d time(s)).", f"{side}_on"),
            ev=why(f"{side}_off_first", "first occurrence"))))
    out.append((F.col("bad") > 0, found(
        severity="Warning", category="ContributingFactor", pos=F.lit(2),
        title=F.format_string("Damaged frames in the capture ring: %d report(s)", "bad"),
        detail=F.lit("What those frames held is missing from the log."), ev=why("bad_first", "first occurrence"))))
    out.append((F.col("lost_first").isNotNull(), found(
        severity="Warning", category="ContributingFactor", pos=F.lit(3),
        title=F.format_string("Capture ring full: %d event(s) dropped", "lost"),
        detail=F.lit("The ring filled faster than it was drained."), ev=why("lost_first", "first drop"))))
    return out


def lazy_gap(ctx: RuleContext, threshold_pct: int = 50) -> DataFrame:
    """Share of GPU time in evals made outside any scope, where it passes the threshold."""
    none = ctx.scopes.where(F.lit(False))
    hit = gpu.attribute(ctx.buffers, ctx.evals, none, ts="commit_ts", grace_ns=ctx.grace_ns, cell=ctx.cell)
    lazy = F.coalesce(F.col("win.empty_stack"), F.lit(False)) & (F.col("gpu_ns") > 0)
    per_eval = hit.groupBy("session_key", F.when(lazy, F.col("win.enter_ord")).alias("e")).agg(
        F.sum("gpu_ns").alias("ns"), F.min(F.when(lazy, F.struct("win.enter_seq", "win.lo"))).alias("first"))
    per = per_eval.groupBy("session_key").agg(
        F.sum(F.when(F.col("e").isNotNull(), F.col("ns")).otherwise(0)).alias("gap_gpu_ns"),
        F.sum("ns").alias("total_gpu_ns"), F.count("e").alias("lazy_eval_count"), F.min("first").alias("first"))
    modules = ctx.facts.select("session_key", "module_call_count")
    share = F.col("gap_gpu_ns").cast("decimal(28,0)") * 100 / F.nullif(F.col("total_gpu_ns").cast("decimal(28,0)"), F.lit(0))
    pct = F.coalesce(F.floor(share), F.lit(0)).cast("bigint")
    return (per.where(F.col("first").isNotNull()).join(modules, "session_key", "left")
            .select("session_key", "gap_gpu_ns", "total_gpu_ns", "lazy_eval_count",
                    F.coalesce("module_call_count", F.lit(0).cast("bigint")).alias("module_call_count"),
                    F.col("first.enter_seq").alias("first_seq"), F.col("first.lo").alias("first_ts"),
                    pct.alias("gap_pct"))
            .where(F.col("gap_pct") >= threshold_pct))


def lazy_advice() -> Column:
    cause = F.when(F.col("module_call_count") > 0,
                   "scopes are instrumented but the graph is evaluated outside them").otherwise(
        "evals run with no scope around the work")
    return F.concat(F.col("gap_pct").cast("string"), F.lit("% of GPU time cannot be attributed to scopes: "), cause,
                    F.lit(". Put named scopes around the stages, or capture stacks and use the source-line view."))


@rule("lazy_eval_attribution")
def lazy_eval_attribution(ctx: RuleContext) -> DataFrame:
    return finding(
        lazy_gap(ctx), severity="Warning", category="ContributingFactor",
        title=F.concat(F.lit("Attribution gap: "), F.col("gap_pct").cast("string"), F.lit("% of GPU time outside scopes")),
        detail=lazy_advice(),
        ev=evidence(F.col("first_seq"), F.col("first_ts"), F.format_string(
            "first of %d eval(s) outside scopes; %d scope calls", "lazy_eval_count", "module_call_count")))


def instrumentation(ctx: RuleContext) -> DataFrame:
    """Per session: what produced events at all."""
    return ctx.facts.select("session_key", "event_count", "has_sidecar", "cb_count", "has_footprint", F.col("first_done").alias("first"))


def absent_advice() -> Column:
    return F.format_string("%d command buffer(s) were captured but no scope or eval event, so nothing can be "
                           "attributed. Install the runtime agent in the target's environment.", "cb_count")


def nothing_advice() -> Column:
    return F.concat(
        F.format_string("All %d event(s) come from system probes; there is nothing to break down. ", "event_count"),
        F.when(F.col("has_footprint"), "A process was followed, but neither capture produced events.")
        .otherwise("This is the usual shape of an ambient session."))


@fact_rule("sidecar_absent")
def sidecar_absent() -> list[tuple[Column, Column]]:
    bare = ~F.col("has_sidecar")
    nothing = found(severity="Info", category="ContributingFactor",
                    title=F.lit("This session ran no GPU work that was instrumented"), detail=nothing_advice())
    absent = found(
        severity="Info", category="ContributingFactor",
        title=F.lit("No runtime agent was attached, so GPU time has no scopes"), detail=absent_advice(),
        ev=evidence(F.col("first_done.seq"), F.col("first_done.ts_mono_ns"), F.format_string(
            "first of %d completed buffer(s) without agent events", "cb_count")))
    return [(bare & (F.col("cb_count") == 0), nothing), (bare & (F.col("cb_count") > 0), absent)]


def attribution_notices(ctx: RuleContext) -> DataFrame:
    """Per session: sampling-disable episodes and the reason most time is unscoped, if any."""
    from spanforge.operators.filters import sampling_disable_episodes

    lazy = lazy_gap(ctx).select("session_key", lazy_advice().alias("lazy"))
    absent = instrumentation(ctx).where(~F.col("has_sidecar") & (F.col("cb_count") > 0)).select(
        "session_key", absent_advice().alias("absent"))
    return (sampling_disable_episodes(ctx.events).join(lazy, "session_key", "left").join(absent, "session_key", "left")
            .select("session_key", F.col("episodes").alias("sampling_disable_episodes"),
                    F.coalesce("lazy", "absent").alias("attribution_gap"),
                    F.when(F.col("lazy").isNotNull(), "LazyEval").when(F.col("absent").isNotNull(), "SidecarAbsent").alias("gap_kind"),
                    F.when(F.col("episodes") > 0, F.format_string("figures per op are incomplete: sampling disabled %d time(s)", "episodes")).alias("degraded")))


