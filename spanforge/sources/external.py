"""Crash/kill reports, system-log lines and process tables written by other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Report bug type of a memory kill, and the page size assumed when absent.
KILL_BUG_TYPE = "298"
DEFAULT_PAGE_SIZE = 16384

# Log subsystems worth keeping, and the text that keeps any line.
LOG_SUBSYSTEMS = ("com.apple.gpurestart", "com.apple.GPUWrangler", "com.apple.coreanalytics")
LOG_TEXT = "GPU watchdog"

_HEADER = "bug_type string, incident_id string"
_BODY = """pid bigint, procName string,
  exception struct<type:string,subtype:string,codes:string,signal:string>,
  termination struct<signal:string>,
  memoryStatus struct<pageSize:bigint>,
  processes array<struct<pid:bigint,name:string,rpages:bigint,lifetimeMax:bigint,reason:string,killDelta:bigint>>"""


def read_report_files(spark: SparkSession, path: str, *, pattern: str = "*.ips") -> DataFrame:
    """Report files as (path, mtime_ns, text)."""
    return (spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
            .text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"),
                    (F.unix_micros("_metadata.file_modification_time") * 1000).alias("mtime_ns"),
                    F.col("value").alias("text")))


def kill_victim(processes: Column) -> Column:
    """First process carrying a kill marker; never a guess from sizes."""
    return F.get(F.filter(processes, lambda p: p["reason"].isNotNull() | p["killDelta"].isNotNull()), 0)


def exception_tokens(subtype: Column, codes: Column) -> Column:
    """Driver error tokens of the subtype, brackets off, then the codes."""
    tokens = F.filter(F.split(F.coalesce(subtype, F.lit("")), r"\s+"), lambda t: t.startswith("kIOGPU") | t.startswith("(0x"))
    bare = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[()]+|[()]+$", ""))
    return F.concat(bare, F.when(codes.isNotNull(), F.array(codes)).otherwise(F.array().cast("array<string>")))


def parse_reports(files: DataFrame) -> DataFrame:
    """Crash and kill reports; files whose header or body does not parse drop out."""
    head, body = F.get(F.split("text", "\n", 2), 0), F.get(F.split("text", "\n", 2), 1)
    opts = {"mode": "PERMISSIVE"}
    rows = files.withColumns({
        "_h": F.from_json(head, _HEADER, opts), "_b": F.from_json(body, _BODY, opts),
        # a text that is no JSON at all parses to an all-null struct, so check it
        "_ok": F.try_parse_json(head).isNotNull() & F.try_parse_json(body).isNotNull()}).where("_ok")
    rows = rows.withColumn("_v", kill_victim(F.col("_b.processes")))
    kill = F.col("_h.bug_type") == KILL_BUG_TYPE
    rows = rows.where(~F.coalesce(kill, F.lit(False)) | F.col("_v").isNotNull())
    page = F.coalesce(F.col("_b.memoryStatus.pageSize"), F.lit(DEFAULT_PAGE_SIZE).cast("bigint"))
    exc = F.col("_b.exception")
    is_kill = F.coalesce(kill, F.lit(False))
    zero = F.lit(0).cast("bigint")
    crash = lambda c: F.when(~is_kill, c)
    killed = lambda c: F.when(is_kill, c)
    summary = F.concat_ws(": ", F.when(exc["type"] != "", exc["type"]), exc["subtype"])
    return rows.select(
        "path", "mtime_ns", F.col("_h.incident_id").alias("incident_id"),
        F.when(is_kill, "JetsamKill").otherwise("CrashReportEmitted").alias("kind"),
        crash(F.col("_b.pid")).alias("crashed_pid"),
        crash(F.coalesce("_b.termination.signal", exc["signal"])).alias("signal"),
        crash(exception_tokens(exc["subtype"], exc["codes"])).alias("exception_codes"),
        crash(summary).alias("summary"), crash(F.col("_b.procName")).alias("proc_name"),
        killed(F.col("_v.pid")).alias("killed_pid"), killed(F.coalesce("_v.name", F.lit(""))).alias("killed_name"),
        killed(F.coalesce("_v.rpages", zero) * page).alias("footprint_bytes"),
        killed(F.coalesce("_v.lifetimeMax", zero) * page).alias("lifetime_max_bytes"),
        killed(page).alias("page_size"), killed(F.col("_v.reason")).alias("reason"))


def log_filter(subsystem: Column, message: Column) -> Column:
    return subsystem.isin(*LOG_SUBSYSTEMS) | message.contains(LOG_TEXT)


def read_system_log(spark: SparkSession, path: str, *, all_lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """NDJSON system log, and the lines that are none (file, line); lines with neither message nor subsystem drop."""
    schema = "subsystem string, category string, eventMessage string, _damaged string"
    text = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    rows = text.withColumn("_doc", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}))
    damaged = F.col("_doc._damaged").isNotNull()
    empty = F.lit("")
    good = rows.where(~damaged).select(F.coalesce("_doc.subsystem", empty).alias("subsystem"), F.coalesce("_doc.category", empty).alias("category"),
                                       F.coalesce("_doc.eventMessage", empty).alias("message"))
    good = good.where((F.col("message") != "") | (F.col("subsystem") != ""))
    return good if all_lines else good.where(log_filter(F.col("subsystem"), F.col("message"))), rows.where(damaged).select("file", F.col("value").alias("line"))


def parse_process_table(files: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """Rows of process tables: pid, name (may hold blanks) and cpu after the header line."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x, i: F.struct(i.alias("line_no"), F.trim(x).alias("l")))
    header = F.array_min(F.transform(lines, lambda x: F.when(x["l"].startswith("PID") & x["l"].contains("%CPU"), x["line_no"])))
    # the lines behind the header are cut out within the generator: beside it, the header would be looked for anew for each line
    behind = F.slice(lines, header + 2, F.size(lines))
    rows = files.select(key, F.explode(behind).alias("_e")).select(key, "_e.line_no", F.col("_e.l").alias("_l"))
    pat = r"^(\d+)\s+(.+?)\s+(\S+)$"
    return (rows.where(F.col("_l").rlike(pat)).select(
        key, "line_no", F.regexp_extract("_l", pat, 1).try_cast("bigint").alias("pid"),
        F.regexp_replace(F.regexp_extract("_l", pat, 2), r"\s+", " ").alias("name"),
        F.regexp_extract("_l", pat, 3).try_cast("float").alias("cpu_pct"))
        .where(F.col("pid").isNotNull() & F.col("cpu_pct").isNotNull() & (F.col("pid") <= 4294967295)))
