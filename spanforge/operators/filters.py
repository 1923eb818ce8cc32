"""Event filters, paging, notability and incident classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanforge.operators.scan import chunk_of, with_position
from spanforge.schema import CB_HISTORY_KINDS, ROUTINE_KINDS, SOURCES


def event_filter(*, source: str | None = None, from_ts: int | None = None, to_ts: int | None = None,
                 kind: str | None = None) -> Column:
    """Conjunction of the given conditions; bounds inclusive, kind in any case."""
    if source is not None and source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    cond = F.lit(True)
    if source is not None:
        cond = cond & (F.col("source") == source)
    if from_ts is not None:
        cond = cond & (F.col("ts_mono_ns") >= from_ts)
    if to_ts is not None:
        cond = cond & (F.col("ts_mono_ns") <= to_ts)
    if kind is not None:
        cond = cond & (F.lower("kind") == kind.lower())
    return cond


def filter_events(events: DataFrame, **conditions) -> DataFrame:
    return events.where(event_filter(**conditions))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with their position among their session's rows, for pages of any depth."""
    return with_position(rows, ["session_key"], ["event_ord"], "row", chunk=chunk_of())


def query_events(events: DataFrame, *, limit: int = 1000, **conditions) -> DataFrame:
    """First ``limit`` matching events per session with matched, total and truncated."""
    cond = event_filter(**conditions)
    counts = events.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(cond).alias("matched"))
    page = _numbered(events.where(cond)).where(F.col("row") <= limit)
    return page.join(counts, "session_key").withColumn("truncated", F.col("matched") > limit)


def cb_history(events: DataFrame, *, queue_id: int | None = None, offset: int = 0,
               limit: int = 100) -> DataFrame:
    """One page of the command-buffer history per session, in log order."""
    rows = events.where(F.col("kind").isin(*CB_HISTORY_KINDS))
    if queue_id is not None:
        rows = rows.where(F.col("queue_id") == queue_id)
    total = events.groupBy("session_key").agg(F.count(F.lit(1)).alias("total"))
    matched = rows.groupBy("session_key").agg(F.count(F.lit(1)).alias("matched"))
    page = _numbered(rows).where(F.col("row").between(offset + 1, offset + limit))
    return (page.join(matched, "session_key").join(total, "session_key")
            .withColumn("truncated", F.col("matched") > offset + limit))


def is_notable() -> Column:
    """Not routine telemetry; a completed buffer only when it failed."""
    failed = F.coalesce(F.col("error_code") != 0, F.lit(False))
    return F.when(F.col("kind") == "MetalCbCompleted", failed).otherwise(~F.col("kind").isin(*ROUTINE_KINDS))


def incident_label() -> Column:
    """Label of an event that triggers a post-mortem, null for any other."""
    return (F.when(F.col("kind") == "CrashReportEmitted", "crash-report")
            .when(F.col("kind") == "MachException", "mach-exception")
            .when((F.col("kind") == "MetalCbCompleted") & (F.col("error_code") != 0),
                  F.concat(F.lit("metal-error-"), F.col("error_code").cast("string"))))


def notice_search(notices: DataFrame, text: str) -> DataFrame:
    """Notices whose kind and summary contain the text, in any case."""
    return notices.where(F.lower(F.concat_ws(" ", "label", "summary")).contains(text.lower()))


def counts_by_kind(events: DataFrame) -> DataFrame:
    return events.groupBy("session_key", "kind").agg(F.count(F.lit(1)).alias("count"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session_key").agg(F.count(F.lit(1)).alias("event_count"))


def sampling_disable_episodes(events: DataFrame) -> DataFrame:
    reason = F.col("reason")
    hit = (F.col("kind") == "MetalHookSkipped") & (
        reason.contains("stage sampling disabled") | reason.contains("dispatch sampling disabled"))
    return events.groupBy("session_key").agg(F.count_if(hit).alias("episodes"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """One log from several sources; columns a source lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
