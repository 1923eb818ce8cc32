"""Joining external crash and kill reports to recorded sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanforge.functions.text import basename, names_compatible, rfc3339_ns
from spanforge.operators.stab import interval_aggregate
from spanforge.schema import NS_PER_SEC

REPORT_GRACE_NS = 120 * NS_PER_SEC
MAX_NS = (1 << 63) - 1


#: Width of the time cells in which sessions and reports meet.
CELL_NS = 600 * NS_PER_SEC


def session_bounds(sessions: DataFrame, events: DataFrame, *, host: str | None, now_ns: int | None = None) -> DataFrame:
    """Scoped sessions with their wall-clock window, and their ``host`` as in :func:`crash_matches`.

    A session that never ended is bounded by its last event plus the grace; one
    without events ends at ``now_ns``, or has no end when none is given.
    """
    last = events.groupBy("session_key").agg(F.max("ts_wall_ns").alias("_last"))
    now = F.lit(MAX_NS - REPORT_GRACE_NS if now_ns is None else now_ns).cast("bigint")
    scoped = sessions.where((F.col("kind") == "Scoped") & rfc3339_ns(F.col("started_rfc3339")).isNotNull())
    return scoped.join(last, "session_key", "left").select(
        "session_key", *_keys(host, scoped), "exit_code", "term_signal", "ended_rfc3339", "kind_pid", "kind_argv",
        rfc3339_ns(F.col("started_rfc3339")).alias("start_ns"),
        F.coalesce(rfc3339_ns(F.col("ended_rfc3339")), F.col("_last") + REPORT_GRACE_NS, now).alias("end_ns"))


def _keys(host: str | None, *frames: DataFrame) -> list[str]:
    if host is not None and not all(host in f.columns for f in frames):
        raise ValueError(f"sessions and reports need the column {host!r}, or host=None for a single host")
    return [host] if host else []


def _first_in_window(cand: DataFrame, reports: DataFrame, keys: list[str], order: Column, grace_ns: int) -> DataFrame:
    """The first report, by ``order``, of each candidate's keys that lies in its window; its columns, but the keys.

    Reports are points and windows intervals over them, so a process id that a great many
    sessions and reports share is cut by time, and no session meets reports outside its cells.
    """
    payload = [c for c in reports.columns if c not in keys]
    spans = cand.select("session_key", *keys, "start_ns", (F.col("end_ns") + grace_ns).alias("end_ns"))
    best = interval_aggregate(spans, reports, by=keys, interval_key=["session_key"], lo="start_ns", hi="end_ns", ts="mtime_ns",
                              aggs={"best": ("min", F.struct(order.alias("o"), F.struct(*payload).alias("r")))}, cell=CELL_NS)
    return best.select("session_key", *keys, "best.o", "best.r.*")


def crash_matches(bounds: DataFrame, reports: DataFrame, *, host: str | None, grace_ns: int = REPORT_GRACE_NS) -> DataFrame:
    """Crash report of each session that did not exit cleanly.

    ``reports`` has dir_rank, path, mtime_ns, crashed_pid, ...  Process ids and wall clocks
    are a host's own: both sides need the column ``host``; None says that there is but one.
    The first directory with a hit wins, then the newest report in it.
    """
    keys = [*_keys(host, bounds, reports), "crashed_pid"]
    cand = bounds.where(F.col("exit_code").isNull() | (F.col("exit_code") != 0)).withColumn("crashed_pid", F.col("kind_pid"))
    return _first_in_window(cand, reports, keys, F.struct("dir_rank", -F.col("mtime_ns"), "path"), grace_ns).drop("o")


def known_processes(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Pids and names a session is known by: its own and those of its sampled tree."""
    own = sessions.where(F.col("kind") == "Scoped").select(
        "session_key", F.col("kind_pid").alias("pid"), basename(F.get("kind_argv", 0)).alias("name"))
    seen = events.where(F.col("kind") == "ProcFootprint").select(
        "session_key", F.col("proc_pid").alias("pid"), "name")
    return own.unionByName(seen).distinct()


def kill_matches(bounds: DataFrame, known: DataFrame, reports: DataFrame, *, host: str | None, grace_ns: int = REPORT_GRACE_NS) -> DataFrame:
    """Kill report of each session: pid of its process tree, in its window, names compatible.

    The name guard holds only when both the session and the report have names.  Names are
    compared per process id with the distinct names of its reports, not report by report.
    """
    at = [*_keys(host, bounds, reports), "killed_pid"]
    names = known.where((F.col("name") != "") & F.col("name").isNotNull()).select("session_key", "name").distinct()
    pids = known.select("session_key", F.col("pid").alias("killed_pid")).distinct()
    reports = reports.withColumn("_name", F.coalesce("killed_name", F.lit("")))
    cand = bounds.select("session_key", *_keys(host, bounds), "start_ns", "end_ns").join(pids, "session_key")
    named = cand.join(reports.select(*at, "_name").distinct(), at).join(names, "session_key", "left")
    ok = F.max(F.coalesce(names_compatible(F.col("name"), F.col("_name")), F.lit(False))) | (F.first("_name") == "") | (F.count("name") == 0)
    fits = named.groupBy("session_key", *at, "start_ns", "end_ns", "_name").agg(ok.alias("_ok")).where("_ok")
    found = _first_in_window(fits, reports, [*at, "_name"], F.struct(-F.col("mtime_ns"), "path"), grace_ns)
    rest = [c for c in found.columns if c not in ("session_key", "o", "_name")]
    return found.groupBy("session_key").agg(F.min_by(F.struct(*rest), "o").alias("b")).select("session_key", "b.*")


def dedup_reports(reports: DataFrame, *, own_process: str, pids: list[int] | None = None) -> DataFrame:
    """First report of each incident (id, else path), oldest file first."""
    rows = reports.where(~F.coalesce(F.col("proc_name") == own_process, F.lit(False)))
    if pids is not None:
        rows = rows.where(F.coalesce("crashed_pid", "killed_pid").isin(*pids))
    key = F.coalesce("incident_id", "path")
    first = F.min_by(F.struct(*rows.columns), F.struct("mtime_ns", "path"))
    return rows.groupBy(key.alias("report_key")).agg(first.alias("_b")).select("report_key", "_b.*")


def first_report(sessions: DataFrame, reports: DataFrame) -> DataFrame:
    """Lowest-named report kept with each session; nulls when there is none."""
    best = reports.groupBy("session_key").agg(
        F.min_by(F.struct("path", "text", F.octet_length("text").alias("size_bytes")), "path").alias("r"))
    return sessions.select("session_key").join(best, "session_key", "left").select(
        "session_key", F.col("r.path").alias("crash_report_path"), F.col("r.text").alias("text"),
        F.col("r.size_bytes").alias("size_bytes"))
