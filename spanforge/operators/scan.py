"""Running aggregates over ordered groups of any size.

A window partitioned by a session (or a recycled id) alone puts the whole group
into one task.  Here the group is cut into consecutive chunks: each chunk is
scanned by its own window, the chunk totals (one row per chunk) are scanned per
group, and the two are combined.  With ``chunk = event_ord div 2^20`` no window
partition holds more than 2^20 events, nor more than 2^20 chunk totals for a
session of up to 2^40 events.

``prefix_scan`` is that scheme for any state that chunks can hand on.  Its input is read
twice, once for the rows and once, without the columns that no total needs, for the
totals.  An operator whose rows depend on one running value through another (islands,
the saturating depth) states both in one scan rather than scan the result of a scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanforge.session_conf import cut_lineage

CHUNK_ROWS = 1 << 20


def chunk_of(order_column: str = "event_ord", rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a row whose order column is a position in its log."""
    return F.call_function("div", F.col(order_column), F.lit(rows))


def _window_agg(fn: str, value: Column) -> Column:
    return {
        "sum": lambda: F.sum(value),
        "count": lambda: F.count(value),
        "max": lambda: F.max(value),
        "min": lambda: F.min(value),
        "last": lambda: F.last(value, ignorenulls=True),
        "prev": lambda: F.last(value, ignorenulls=True),
        "next": lambda: F.last(value, ignorenulls=True),
    }[fn]()


def _total(fn: str, value: Column, order: list[str]) -> Column:
    at = F.when(value.isNotNull(), F.struct(*order))
    return {
        "sum": lambda: F.sum(value),
        "count": lambda: F.count(value),
        "max": lambda: F.max(value),
        "min": lambda: F.min(value),
        "last": lambda: F.max_by(value, at),
        "prev": lambda: F.max_by(value, at),
        "next": lambda: F.min_by(value, at),
    }[fn]()


def _combine(fn: str, local: Column, carry: Column) -> Column:
    if fn in ("sum", "count"):
        return F.coalesce(local + carry, local, carry)
    if fn == "max":
        return F.greatest(local, carry)
    if fn == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with each row's 1-based position in its group, by any order and for any burst.

    Rows are dealt by ranges of (keys, order) and written once, numbered within their range;
    the ranges' counts, summed per group, are added.  So no chunk of the order has to be
    known beforehand, and a group, or a single value of the order's first column, may be
    spread over any number of tasks.  Rows that tie in ``order`` go in any order.
    """
    by = [*keys, *order]
    dealt = cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    runs = runs.select(*keys, "_part", "_first", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_earlier"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_part"]]
    joined = dealt.alias("d").join(runs.alias("r"), reduce(lambda a, b: a & b, same))
    return joined.select(*[f"d.{c}" for c in df.columns], (F.col("_at") - F.col("_first") + F.col("_earlier") + 1).alias(name))


Columns = dict[str, Column]


def prefix_scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column, *, rows: list[Callable[..., Columns]], totals: Columns,
                carry: list[Callable[..., Columns]], out: Columns) -> DataFrame:
    """Scan each chunk on its own, then the chunks' totals, and put the two together.

    ``rows`` adds columns to the rows of a chunk, step by step; each step gets the chunk's
    window in order.  ``totals`` are aggregates over a chunk's rows with these columns.
    ``carry`` adds columns to the totals, step by step, given the window over a group's
    chunks.  ``out`` are the resulting columns, from those of the rows and the carries.
    """
    parts = [*keys, "_chunk"]
    local = df.withColumn("_chunk", chunk)
    within = Window.partitionBy(*parts).orderBy(*order)
    for step in rows:
        local = local.withColumns(step(within))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carried = local.groupBy(*parts).agg(*[c.alias(n) for n, c in totals.items()])
    for step in carry:
        carried = carried.withColumns(step(across))
    carried = carried.drop(*totals)
    # the rows lie by chunk already; a broadcast of all groups' totals would pass the driver
    return local.join(carried.hint("merge"), parts, "left").select(*(c for c in df.columns if c not in out), *[c.alias(n) for n, c in out.items()])


def with_running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    aggs: dict[str, tuple[str, Column]],
    *,
    chunk: Column | None = None,
    before: bool = False,
) -> DataFrame:
    """Add running aggregates in ``order`` within ``keys``.

    ``aggs`` maps a new column to ``(fn, value)``; fn is sum, count, max, min,
    last (latest non-null value so far), prev (the same before the row) or next (first
    non-null value after the row).  ``before`` leaves the row itself out.  ``chunk`` must be
    non-decreasing in ``order``; without it the group is one window partition,
    which is only right for keys whose groups are small by construction.
    """
    lo, hi = Window.unboundedPreceding, (-1 if before else 0)

    def frame(spec, fn, parts, by, carry=False):
        if fn == "next":  # the rows behind, from the end: a frame up to the end would be gone through again for every row
            return Window.partitionBy(*parts).orderBy(*(F.col(c).desc() for c in by)).rowsBetween(lo, -1)
        return spec.rowsBetween(lo, -1 if carry or fn == "prev" else hi)

    if chunk is None:
        spec = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: _window_agg(fn, v).over(frame(spec, fn, keys, order))
                               for n, (fn, v) in aggs.items()})

    return prefix_scan(
        df, keys, order, chunk,
        rows=[lambda w: {f"_l_{n}": _window_agg(fn, v).over(frame(w, fn, [*keys, "_chunk"], order)) for n, (fn, v) in aggs.items()}],
        totals={f"_t_{n}": _total(fn, v, order) for n, (fn, v) in aggs.items()},
        carry=[lambda w: {f"_c_{n}": _window_agg("sum" if fn == "count" else fn, F.col(f"_t_{n}")).over(frame(w, fn, keys, ["_chunk"], carry=True))
                          for n, (fn, _) in aggs.items()}],
        out={n: _combine(fn, F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, (fn, _) in aggs.items()})


def with_position(df: DataFrame, keys: list[str], order: list[str], name: str,
                  *, chunk: Column | None = None) -> DataFrame:
    """1-based position of each row in its group."""
    return with_running(df, keys, order, {name: ("count", F.lit(1))}, chunk=chunk)
