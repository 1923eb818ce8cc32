"""Findings of all rules, reports joined from outside, and the text report."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanforge.functions.labels import kill_reason_text
from spanforge.functions.text import decimal_gb
from spanforge.operators import diff, gpu, memory, pairing, reports, sequences, tree
from spanforge.plans import rules as R
from spanforge.schema import FINDING_COLUMNS, NS_PER_SEC
from spanforge.session_conf import cut_lineage

KILL_POS, CRASH_POS, PRESUMED_POS = -2, -1, 1000
SIGINT, SIGTERM = 2, 15

# Report sections in order, and the category each shows.
SECTIONS = (("ROOT CAUSE", "RootCause"), ("CONTRIBUTING FACTORS", "ContributingFactor"),
            ("TIMING", "Timing"), ("SYSTEM PRESSURE", "SystemPressure"))


def analyze(events: DataFrame, *, names: list[str] | None = None, **options) -> DataFrame:
    """Findings of the registered rules, of any number of sessions; ``rule_pos`` and ``finding_pos`` order them."""
    names = list(names or R.RULES)
    ctx = R.RuleContext(events, fused=len(names) > 1, **options)
    on_facts = [n for n in names if n in R.FACT_RULES]
    some = [R.fact_findings(ctx, on_facts)] if on_facts else []
    return reduce(DataFrame.unionByName, some + [R.RULES[n](ctx) for n in names if n not in R.FACT_RULES])


def root_cause(findings: DataFrame) -> DataFrame:
    """Title of each session's first root cause."""
    rows = findings.where(F.col("category") == "RootCause")
    return rows.groupBy("session_key").agg(
        F.min_by("title", F.struct("rule_pos", "finding_pos")).alias("root_cause_title"))


def _placed(df: DataFrame, pos: int, name: str) -> DataFrame:
    return df.withColumns({"rule_pos": F.lit(pos), "rule": F.lit(name)}).select(*FINDING_COLUMNS)


def crash_findings(matches: DataFrame) -> DataFrame:
    codes = F.when(F.size("exception_codes") > 0, F.concat(F.lit("codes: "), F.array_join("exception_codes", ", ")))
    summary = F.when(F.col("summary") != "", F.col("summary"))
    return _placed(R.finding(
        matches, severity="Critical", category="RootCause",
        title=F.concat(F.lit("Crash report found for the recorded process"),
                       F.coalesce(F.concat(F.lit(" ("), F.col("signal"), F.lit(")")), F.lit(""))),
        detail=F.concat_ws("; ", summary, codes, F.concat(F.lit("report "), F.col("path")))), CRASH_POS, "crash_report")


def kill_findings(matches: DataFrame) -> DataFrame:
    gb = lambda c: F.format_string("%.2f GB", decimal_gb(F.col(c)))
    return _placed(R.finding(
        matches, severity="Critical", category="RootCause",
        title=F.lit("Kill report: the system ended the recorded process to reclaim memory"),
        detail=F.concat_ws("; ", F.format_string("pid %d (%s)", "killed_pid", "killed_name"),
                           F.concat(F.lit("footprint "), gb("footprint_bytes")),
                           F.concat(F.lit("lifetime maximum "), gb("lifetime_max_bytes")),
                           kill_reason_text(F.col("reason")), F.concat(F.lit("report "), F.col("path")))),
        KILL_POS, "kill_report")


def presumed_memory_deaths(bounds: DataFrame, events: DataFrame, findings: DataFrame, kills: DataFrame, *,
                           factor: float = 2.0) -> DataFrame:
    """Sessions that ended abnormally while growing, when nothing else explains it."""
    code = F.col("exit_code")
    ended = (code == -1) | (code.isNull() & F.col("ended_rfc3339").isNotNull())
    user_stop = F.coalesce(F.col("term_signal").isin(SIGINT, SIGTERM), F.lit(False))
    cand = bounds.where(ended & ~user_stop)
    cand = cand.join(kills.select("session_key"), "session_key", "left_anti")
    cand = cand.join(findings.where(F.col("category") == "RootCause").select("session_key"), "session_key", "left_anti")
    roots = events.where((F.col("kind") == "ProcFootprint") & F.col("is_traced_root"))
    grown = sequences.rises(roots, keys=["session_key"], order="event_ord", value="phys_footprint_bytes", factor=factor)
    ends = roots.groupBy("session_key").agg(
        F.min_by(F.struct("seq", "ts_mono_ns"), "event_ord").alias("a"), F.max_by(F.struct("seq", "ts_mono_ns"), "event_ord").alias("z"))
    j = cand.join(grown, "session_key").join(ends, "session_key")
    gb = lambda c: F.format_string("%.2f GB", decimal_gb(F.col(c)))
    return _placed(R.finding(
        j, severity="Warning", category="ContributingFactor",
        title=F.lit("Session broke off while its memory use was climbing"),
        detail=F.concat(F.lit("Footprint went from "), gb("first_value"), F.lit(" to "), gb("last_value"),
                        F.lit("; without a matching kill report this is only likely.")),
        ev=F.concat(R.evidence(F.col("a.seq"), F.col("a.ts_mono_ns"), F.concat(F.lit("first "), gb("first_value"))),
                    R.evidence(F.col("z.seq"), F.col("z.ts_mono_ns"), F.concat(F.lit("last "), gb("last_value"))))),
        PRESUMED_POS, "presumed_memory_death")


def session_summary(sessions: DataFrame, events: DataFrame, crash_reports: DataFrame,
                    kill_reports: DataFrame, *, host: str | None, **options) -> DataFrame:
    """Rule findings with crash and kill reports at the head and the presumption at the end."""
    # the findings, the bounds and the matches are each read more than once
    findings = cut_lineage(analyze(events, **options))
    bounds = cut_lineage(reports.session_bounds(sessions, events, host=host))
    crashes = cut_lineage(reports.crash_matches(bounds, crash_reports, host=host))
    kills = cut_lineage(reports.kill_matches(bounds, reports.known_processes(sessions, events), kill_reports, host=host))
    found = findings.unionByName(crash_findings(crashes))
    presumed = presumed_memory_deaths(bounds, events, found, kills)
    return found.unionByName(kill_findings(kills)).unionByName(presumed)


def report_lines(findings: DataFrame, events: DataFrame) -> DataFrame:
    """The report as ordered lines: header, then each section's findings.

    Only the first root cause shows; timing lines carry no severity.
    """
    head = events.groupBy("session_key").agg(
        F.min_by("session_id", "event_ord").alias("sid"), F.count(F.lit(1)).alias("n"))
    header = head.select("session_key", F.lit(0).alias("section"), F.lit(0).alias("rule_pos"),
                         F.lit(0).cast("bigint").alias("finding_pos"), F.posexplode(F.array(
                             F.concat(F.lit("session: "), F.left("sid", F.lit(8))),
                             F.concat(F.lit("events:  "), F.col("n").cast("string")))).alias("part", "line"))
    first = root_cause_row(findings)
    rows = first.unionByName(findings.where(F.col("category") != "RootCause"))
    section, title = None, None
    for i, (name, cat) in enumerate(SECTIONS, start=1):
        hit = F.col("category") == cat
        section = F.when(hit, i) if section is None else section.when(hit, i)
        title = F.when(hit, name) if title is None else title.when(hit, name)
    shown = F.when(F.col("category") == "Timing", F.col("title")).otherwise(
        F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("title")))
    body = rows.select("session_key", section.alias("section"), "rule_pos", "finding_pos", F.posexplode(
        F.filter(F.array(F.concat(F.lit("  "), shown), F.when(F.col("detail") != "", F.concat(F.lit("    "), F.col("detail")))),
                 lambda x: x.isNotNull())).alias("part", "line"))
    titles = rows.select("session_key", section.alias("section"), title.alias("line")).distinct().select(
        "session_key", "section", F.lit(-10_000).alias("rule_pos"), F.lit(0).cast("bigint").alias("finding_pos"),
        F.lit(0).alias("part"), "line")
    return header.unionByName(titles).unionByName(body)


def root_cause_row(findings: DataFrame) -> DataFrame:
    rows = findings.where(F.col("category") == "RootCause")
    best = F.min_by(F.struct(*findings.columns), F.struct("rule_pos", "finding_pos"))
    return rows.groupBy("session_key").agg(best.alias("b")).select("b.*")


class Breakdown:
    """Everything the scope breakdown is made of, for all sessions of a log; each part is made when it is asked for."""

    def __init__(self, events: DataFrame, *, grace_ns: int = pairing.ASYNC_GRACE_NS,
                 cell: int = gpu.DEFAULT_CELL_NS, chunk: Column | None = None):
        self.events, self.grace_ns, self.cell, self.chunk = events, grace_ns, cell, chunk

    @cached_property
    def calls(self) -> DataFrame:
        # the scopes, the totals and the attribution read the calls
        return cut_lineage(pairing.scope_calls(self.events, chunk=self.chunk))

    @cached_property
    def scopes(self) -> DataFrame:
        return pairing.scope_windows(self.events, calls=self.calls)

    @cached_property
    def evals(self) -> DataFrame:
        return cut_lineage(pairing.eval_windows(self.events, grace_ns=self.grace_ns, chunk=self.chunk))

    @cached_property
    def cbs(self) -> DataFrame:
        return gpu.cb_events(self.events, chunk=self.chunk)

    @cached_property
    def ops_events(self) -> DataFrame:
        return gpu.clamped_ops(self.cbs, chunk=self.chunk)

    @cached_property
    def buffers(self) -> DataFrame:
        return cut_lineage(gpu.command_buffers(self.events, cbs=self.cbs, ops=self.ops_events))

    @cached_property
    def attributed(self) -> DataFrame:
        return gpu.attributed_buffers(self.events, grace_ns=self.grace_ns, cell=self.cell, calls=self.calls, evals=self.evals,
                                      buffers=self.buffers, scopes=self.scopes)

    @cached_property
    def totals(self) -> DataFrame:
        return gpu.scope_totals(self.attributed, self.evals, self.calls)

    @cached_property
    def ops(self) -> DataFrame:
        return gpu.node_ops(self.attributed)

    @cached_property
    def tree(self) -> DataFrame:
        # the recursion reads the totals once per level, so they are written first
        return cut_lineage(tree.breakdown_tree(cut_lineage(self.totals)))

    def diagnostics(self) -> DataFrame:
        return gpu.diagnostics(self.events, self.attributed, self.ops_events, chunk=self.chunk)

    def reachable_ops(self, nodes: DataFrame | None = None) -> DataFrame:
        """Ops of the nodes that are part of the tree."""
        nodes = self.tree if nodes is None else nodes
        return self.ops.join(nodes.select("session_key", "node_id").hint("merge"), ["session_key", "node_id"], "left_semi")

    def response(self, *, max_depth=None, top_n=None, min_ns=0, fields=None, group_by="name", include_ops=True,
                 top_ops=5) -> tuple[DataFrame, DataFrame]:
        """Pruned tree and the ops of its nodes."""
        if group_by not in ("name", "kind"):
            raise ValueError(f"group_by must be 'name' or 'kind', got {group_by!r}")
        nodes = self.tree
        if fields:
            nodes = tree.field_filter(nodes, fields)
        nodes = tree.prune(nodes, max_depth=max_depth, min_ns=min_ns, top_n=top_n)
        ops = self.reachable_ops(nodes)
        if group_by == "kind":
            ops = gpu.node_ops_by_kind(ops).withColumnRenamed("key", "name")
        return nodes, tree.top_ops_per_node(ops, top_ops, include=include_ops)


def memory_response(events: DataFrame, *, cell: int = gpu.DEFAULT_CELL_NS, grace_ns: int = pairing.ASYNC_GRACE_NS,
                    bucket_seconds: int = 10, gap_ns: int = 5 * NS_PER_SEC) -> dict[str, DataFrame]:
    """Scope memory, heap, timeline, windows, footprint, allocator, and notes for empty ones."""
    scopes = cut_lineage(pairing.scope_windows(events))
    out = {
        "scope_memory": memory.scope_memory(events, grace_ns=grace_ns, cell=cell, scopes=scopes),
        "heap_memory": memory.scope_heap(events, grace_ns=grace_ns, cell=cell, scopes=scopes),
        "timeline": memory.memory_timeline(events, bucket_seconds=bucket_seconds),
        "windows": memory.timeline_windows(events, scopes=scopes, gap_ns=gap_ns),
        "process_footprint": memory.footprint_summary(events),
        "allocator": memory.allocator_summary(events),
    }
    ctx = R.RuleContext(events)
    bare = R.instrumentation(ctx).where(~F.col("has_sidecar")).join(
        scopes.select("session_key").distinct(), "session_key", "left_anti")
    out["notes"] = bare.select("session_key", F.when(F.col("cb_count") == 0, R.nothing_advice())
                               .otherwise(R.absent_advice()).alias("note"))
    return out


def compare(pairs: DataFrame, events: DataFrame, *, breakdown: Breakdown | None = None,
            cell: int = gpu.DEFAULT_CELL_NS, grace_ns: int = pairing.ASYNC_GRACE_NS) -> dict[str, DataFrame]:
    """All parts of an A/B comparison for the given session pairs."""
    wanted = pairs.select(F.explode(F.array("session_a", "session_b")).alias("session_key")).distinct()
    log = events.join(wanted, "session_key", "left_semi")
    b = breakdown or Breakdown(log, cell=cell, grace_ns=grace_ns)
    nodes = b.tree
    scopes = diff.diff_scopes(pairs, nodes)
    from spanforge.operators.filters import sampling_disable_episodes

    return {
        "stats": diff.compare_sessions(pairs, diff.session_stats(log),
                                       root_cause(analyze(log, names=["metal_error"]))),
        "scope_deltas": scopes["deltas"], "only_in_a": scopes["only_in_a"], "only_in_b": scopes["only_in_b"],
        "op_deltas": diff.diff_ops(pairs, b.reachable_ops(nodes)),
        "memory_deltas": diff.diff_memory(pairs, memory.scope_memory(log, cell=cell, grace_ns=grace_ns, scopes=b.scopes)),
        "origin_deltas": diff.diff_origins(pairs, gpu.dispatch_origins(log, cell=cell, grace_ns=grace_ns, ops=b.ops_events, evals=b.evals, scopes=b.scopes)),
        "banner": diff.degraded_banner(pairs, sampling_disable_episodes(log)),
    }
