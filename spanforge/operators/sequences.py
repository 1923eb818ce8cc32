"""Order-dependent operators over one ordered log per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanforge.operators.scan import CHUNK_ROWS, chunk_of, prefix_scan, ranked, with_running
from spanforge.schema import NS_PER_SEC


def islands(df: DataFrame, *, keys: list[str], order: str, ts: str, keep: Column, gap: int,
            aggs: list[Column], chunk: Column | None = None) -> DataFrame:
    """Runs of qualifying rows whose consecutive distance is at most ``gap``.

    Distances are taken between qualifying rows only, so a short dip below the
    condition does not end a run.
    """
    rows = df.where(keep)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = lambda at, prev: F.when(at - prev > gap, 1).otherwise(0)
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(order)
        rows = rows.withColumn("_prev", F.last(ts, ignorenulls=True).over(earlier(w)))
        rows = rows.withColumn("_new", F.when(F.col("_prev").isNull(), 1).otherwise(far(F.col(ts), F.col("_prev"))))
        return rows.withColumn("island", F.sum("_new").over(so_far(w))).groupBy(*keys, "island").agg(*aggs)
    # within a chunk the first row starts nothing; whether it does depends on the chunk before
    rows = prefix_scan(
        rows, keys, [order], chunk,
        rows=[lambda w: {"_prev": F.last(ts, ignorenulls=True).over(earlier(w))},
              lambda w: {"_new": F.when(F.col("_prev").isNull(), 0).otherwise(far(F.col(ts), F.col("_prev")))},
              lambda w: {"_within": F.sum("_new").over(so_far(w))}],
        totals={"_first": F.min_by(ts, order), "_last": F.max_by(ts, order), "_breaks": F.sum("_new")},
        carry=[lambda w: {"_before": F.lag("_last").over(w)},
               lambda w: {"_starts": F.when(F.col("_before").isNull(), 1).otherwise(far(F.col("_first"), F.col("_before")))},
               lambda w: {"_earlier": F.coalesce(F.sum(F.col("_starts") + F.col("_breaks")).over(earlier(w)), F.lit(0)) + F.col("_starts")}],
        out={"island": F.col("_earlier") + F.col("_within")})
    return rows.groupBy(*keys, "island").agg(*aggs)


def sequence_gaps(df: DataFrame, *, keys: list[str], order: str, seq: str,
                  chunk: Column | None = None) -> DataFrame:
    """Rows whose sequence number skips ahead of the largest one seen before."""
    rows = with_running(df, keys, [order], {"_max": ("max", F.col(seq))}, chunk=chunk, before=True)
    return rows.where(F.col(seq) > F.col("_max") + 1).select(
        *keys, order, (F.col("_max") + 1).alias("expected"), F.col(seq).alias("got"))


def counter_rate(df: DataFrame, *, keys: list[str], order: str, ts: str, counter: str,
                 per: int = NS_PER_SEC, chunk: Column | None = None, name: str = "rate") -> DataFrame:
    """Growth of a counter per second; 0 for the first sample, a reset or no elapsed time."""
    rows = with_running(df, keys, [order], {"_p": ("last", F.struct(F.col(ts).alias("t"), F.col(counter).alias("c")))},
                        chunk=chunk, before=True)
    dt = (F.col(ts) - F.col("_p.t")) / F.lit(float(per))
    grown = F.greatest(F.lit(0).cast("bigint"), F.col(counter) - F.col("_p.c"))
    return rows.withColumn(name, F.when(dt > 0, grown / dt).otherwise(F.lit(0.0))).drop("_p")


def changes_only(df: DataFrame, *, keys: list[str], order: str, value: str,
                 chunk: Column | None = None) -> DataFrame:
    """Rows whose value differs from the row before them."""
    rows = with_running(df, keys, [order], {"_p": ("last", F.struct(F.col(value).alias("v")))},
                        chunk=chunk, before=True)
    return rows.where(F.col("_p").isNull() | ~F.col("_p.v").eqNullSafe(F.col(value))).drop("_p")


def cumulative(df: DataFrame, *, keys: list[str], order: list[str], value: str, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Running sum in any order; chunks are of positions, so a burst in time is cut like any other rows."""
    rows = ranked(df, keys, order, "_pos")
    return with_running(rows, keys, ["_pos"], {name: ("sum", F.col(value))}, chunk=chunk_of("_pos", chunk_rows)).drop("_pos")


def stacked_bands(loads: DataFrame, unloads: DataFrame, *, keys: list[str], band: str, ts: str,
                  order: str, size: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Bytes per band over time: +size at a load, minus the band's last load size at an unload.

    The running sum may dip below 0; only the shown value is floored.
    """
    last = loads.groupBy(*keys, band).agg(F.max_by(size, order).alias("_last"))
    ups = loads.select(*keys, band, ts, order, F.lit(0).alias("_side"), F.col(size).alias("_d"))
    downs = unloads.join(last, keys + [band], "left").select(
        *keys, band, ts, order, F.lit(1).alias("_side"), (-F.coalesce("_last", F.lit(0))).alias("_d"))
    rows = cumulative(ups.unionByName(downs), keys=keys + [band], order=[ts, "_side", order], value="_d", name="_s", chunk_rows=chunk_rows)
    start = rows.groupBy(*keys).agg(F.min(ts).alias("_t0"))
    return rows.join(start, keys).select(
        *keys, band, order, (F.col(ts) - F.col("_t0")).alias("t_rel"),
        F.greatest(F.lit(0), F.col("_s")).cast("bigint").alias("bytes"))


def saturating_depth(df: DataFrame, *, keys: list[str], order: str, up: Column, down: Column,
                     chunk: Column | None = None, name: str = "depth") -> DataFrame:
    """+1/-1 counter that never falls below 0 (running sum minus its running minimum)."""
    rows = df.where(up | down).withColumn("_d", F.when(up, 1).otherwise(-1))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if chunk is None:
        w = so_far(Window.partitionBy(*keys).orderBy(order))
        rows = rows.withColumn("_s", F.sum("_d").over(w)).withColumn("_m", F.min("_s").over(w))
        return rows.withColumn(name, F.col("_s") - F.least(F.lit(0), F.col("_m"))).drop("_d", "_s", "_m")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # a chunk hands on its sum, and how low its running sum gets
    level = F.col("_base") + F.col("_s")
    return prefix_scan(
        rows, keys, [order], chunk,
        rows=[lambda w: {"_s": F.sum("_d").over(so_far(w))}, lambda w: {"_m": F.min("_s").over(so_far(w))}],
        totals={"_sum": F.sum("_d"), "_low": F.min("_s")},
        carry=[lambda w: {"_base": F.coalesce(F.sum("_sum").over(earlier(w)), F.lit(0))},
               lambda w: {"_lowest": F.coalesce(F.min(F.col("_base") + F.col("_low")).over(earlier(w)), F.lit(0))}],
        out={name: level - F.least(F.lit(0), F.col("_lowest"), F.col("_base") + F.col("_m"))}).drop("_d")


def rises(df: DataFrame, *, keys: list[str], order: str, value: str, factor: float = 2.0) -> DataFrame:
    """Groups whose last value is at least ``factor`` times the first, which is not 0."""
    ends = df.groupBy(*keys).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))
    return ends.where((F.col("first_value") != 0) & (F.col("last_value") >= F.col("first_value") * factor))


def last_before(df: DataFrame, anchors: DataFrame, *, keys: list[str], ts: str, anchor: str,
                order: str, n: int = 5) -> DataFrame:
    """The last ``n`` rows at or before each group's anchor, ranked latest first."""
    rows = df.join(anchors.select(*keys, anchor), keys).where(F.col(ts) <= F.col(anchor))
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(order).desc())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_max(df: DataFrame, *, keys: list[str], metric: str, order: str) -> DataFrame:
    """The row with the largest metric, the earliest among equals."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(metric), -F.col(order)))
    return df.where(F.col(metric).isNotNull()).groupBy(*keys).agg(best.alias("_b")).select("_b.*")


def entered_by_last_seen(df: DataFrame, *, keys: list[str], order: str, ident: str, begin: Column,
                         end: Column, value: Column, chunk: Column | None = None,
                         name: str = "entered") -> DataFrame:
    """End rows with the begin's value, only if the latest begin of all has the same id."""
    rows = df.where(begin | end).withColumn("_b", begin)
    rows = with_running(rows, keys, [order],
                        {"_l": ("last", F.when(F.col("_b"), F.struct(F.col(ident).alias("id"), value.alias("v"))))},
                        chunk=chunk)
    return rows.where(~F.col("_b")).withColumn(
        name, F.when(F.col("_l.id") == F.col(ident), F.col("_l.v"))).drop("_b", "_l")


def nearest_rank(df: DataFrame, *, keys: list[str], value: str,
                 probs: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the value at position round((n-1)*p), half away from zero.

    Distinct values are counted first, so a group of any size costs one row per
    distinct value; positions come from a running count over those.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    size = F.floor(F.log2(F.abs(F.col(value).cast("double")) + 1.0) * 64).cast("long")
    bucket = F.when(F.col(value) < 0, -size).otherwise(size)
    runs = with_running(counts, keys, [value], {"_hi": ("sum", F.col("_n"))}, chunk=bucket)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.max(value).alias("max_value"))
    runs = runs.join(totals, keys)
    out = []
    for name, p in probs.items():
        at = F.floor((F.col("_total") - 1) * F.lit(p) + 0.5)
        hit = (F.col("_hi") > at) & (F.col("_hi") - F.col("_n") <= at)
        out.append(F.max(F.when(hit, F.col(value))).alias(name))
    return runs.groupBy(*keys).agg(*out, F.max("max_value").alias("max_value"), F.max("_total").alias("n"))


def slowest(df: DataFrame, *, keys: list[str], metric: str, order: str, n: int = 5) -> DataFrame:
    """Largest ``n``; among equals the one latest in the log comes first."""
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc(), F.col(order).desc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# Process names flagged per tick when busy.
FLAGGED_NAMES = ("ReportCrash", "diagnosticservicesd", "UserNotificationCenter", "spindump")


def top_and_flagged(df: DataFrame, *, keys: list[str], cpu: str, name: str, order: str, n: int = 10,
                    flagged_names=FLAGGED_NAMES, threshold: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Per tick: the ``n`` busiest rows, and the flagged names above the threshold."""
    w = Window.partitionBy(*keys).orderBy(F.col(cpu).desc(), F.col(order))
    top = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    flagged = df.where(F.col(name).isin(*flagged_names) & (F.col(cpu) > F.lit(threshold)))
    return top, flagged.select(*keys, order, name)


def overdue(lifetimes: DataFrame, *, begin: str, end: str, now: Column, limit: int = 5 * NS_PER_SEC,
            tick: int = NS_PER_SEC) -> DataFrame:
    """Lifetimes that reached the age limit, with the first whole tick that saw it."""
    until = F.coalesce(F.col(end), now)
    warn = F.ceil((F.col(begin) + limit) / F.lit(tick)).cast("bigint") * tick
    return lifetimes.withColumn("warn_at", warn).where(F.col("warn_at") <= until)


def ema(df: DataFrame, *, keys: list[str], order: str, value: str, alpha: float = 0.2,
        block: int = 1024) -> DataFrame:
    """Exponential moving average of each group at its end, seeded by its first value.

    A block of consecutive rows maps x to w*x + c, and such maps compose, so a
    group is folded block by block and then over its blocks; no task holds more
    than ``block`` rows of it at once.
    """
    keep = 1.0 - alpha
    pos = with_running(df, keys, [order], {"_pos": ("count", F.lit(1))},
                       chunk=F.floor(F.col(order) / F.lit(block * 1024)).cast("long"))
    v = F.col(value).cast("double")
    first = F.col("_pos") == 1
    pos = pos.withColumns({"_blk": F.floor((F.col("_pos") - 1) / F.lit(block)).cast("long"),
                           "_w": F.when(first, 0.0).otherwise(keep),
                           "_c": F.when(first, v).otherwise(v * alpha)})

    def fold(frame, group, at):
        seq = F.array_sort(F.collect_list(F.struct(at, "_w", "_c")))
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("c"))
        step = lambda acc, x: F.struct((acc["w"] * x["_w"]).alias("w"), (acc["c"] * x["_w"] + x["_c"]).alias("c"))
        return frame.groupBy(*group).agg(F.aggregate(seq, start, step).alias("_m")).select(
            *group, F.col("_m.w").alias("_w"), F.col("_m.c").alias("_c"))

    level = fold(pos, keys + ["_blk"], "_pos")
    for _ in range(2):
        level = level.withColumn("_in", F.col("_blk")).withColumn("_blk", F.floor(F.col("_blk") / F.lit(block)).cast("long"))
        level = fold(level, keys + ["_blk"], "_in")
    seq = F.array_sort(F.collect_list(F.struct("_blk", "_w", "_c")))
    return level.groupBy(*keys).agg(F.aggregate(
        seq, F.lit(0.0), lambda acc, x: acc * x["_w"] + x["_c"]).alias("ema"))
