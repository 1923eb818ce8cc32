"""Point-in-interval joins and interval aggregates without all-pairs work.

Time is cut into cells.  An interval contributes
  * an *edge* row to the (at most two) cells its ends fall into, where the range
    condition is checked row by row, and
  * a few rows of a radix-16 tree of cells for the cells it covers whole.
Covers of one tree node are reduced to the single winner (stab join) or points
of one node to one partial aggregate (interval aggregate) before they meet, so
long intervals never fan out over every cell they span.  Cells with too many
edges (or, for aggregates, points) are cut again into finer cells, so a burst
does not end in one task and no row is compared with more than a fixed number
of others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanforge.session_conf import cut_lineage

RADIX_BITS = 4
REFINE = 4096


def _cell(ts: Column, cell: int) -> Column:
    if cell <= 1:
        return ts.cast("bigint")
    return F.call_function("div", ts - F.pmod(ts, F.lit(cell)), F.lit(cell))


def _tree_nodes(a: Column, b: Column, levels: int) -> Column:
    """Array of (level, node) whose cells tile the half-open cell range [a, b).

    At each level the whole nodes are [ceil(a / 16^l), floor(b / 16^l)); those
    covered by whole nodes of the next level are left to it.
    """
    up = 1 << RADIX_BITS

    def lo(level):
        return -F.call_function("shiftright", -a, (level * RADIX_BITS).cast("int"))

    def hi(level):
        return F.call_function("shiftright", b, (level * RADIX_BITS).cast("int"))

    def seq(first, last):
        # sequence() runs backwards when last < first, hence the guard
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    def at(level):
        first, last = lo(level), hi(level)
        up_first, up_last = lo(level + 1), hi(level + 1)
        coarser = (up_first < up_last) & (level < levels)
        nodes = F.when(coarser, F.concat(seq(first, up_first * up - 1), seq(up_last * up, last - 1))
                       ).otherwise(seq(first, last - 1))
        return F.transform(nodes, lambda n: F.struct(level.alias("level"), n.alias("node")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)),
                                 lambda lv: F.when(lo(lv) < hi(lv), at(lv))
                                 .otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))))


def _ancestors(cell: Column, levels: int) -> Column:
    return F.array(*[F.struct(F.lit(lv).alias("level"),
                              F.shiftright(cell, RADIX_BITS * lv).alias("node"))
                     for lv in range(levels + 1)])


def _hot_cells(rows: DataFrame, keys: list[str], limit: int | None) -> DataFrame | None:
    """Cells holding more than ``limit`` rows, or None when there are none.

    This runs one aggregate (map-side combined, at most one row comes back) so
    that the refining branch exists only where a cell needs it.
    """
    if limit is None:
        return None
    hot = rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return None if hot.isEmpty() else hot.select(*keys, "_cell")


def _candidates(points, spans, keys, cell, levels):
    """Edge rows and, per cell that holds points, the winning whole cover."""
    spans = spans.withColumns({"_c0": _cell(F.col("_lo"), cell), "_c1": _cell(F.col("_hi"), cell)})
    edges = spans.withColumn(
        "_cell", F.explode(F.array_distinct(F.array("_c0", "_c1")))).drop("_c0", "_c1")
    nodes = (spans.withColumn("_n", F.explode(_tree_nodes(F.col("_c0") + 1, F.col("_c1"), levels)))
             .groupBy(*keys, F.col("_n.level").alias("level"), F.col("_n.node").alias("node"))
             .agg(F.max_by(F.struct("_prio", "_lo", "_hi", "_win"), "_prio").alias("_b")))
    cells = (points.select(*keys, "_cell").distinct()
             .withColumn("_n", F.explode(_ancestors(F.col("_cell"), levels)))
             .select(*keys, "_cell", F.col("_n.level").alias("level"), F.col("_n.node").alias("node")))
    covers = (cells.hint("merge").join(nodes, keys + ["level", "node"])
              .groupBy(*keys, "_cell")
              .agg(F.max_by("_b", F.col("_b._prio")).alias("_b"))
              .select(*keys, "_b._prio", "_b._lo", "_b._hi", "_b._win", "_cell"))
    return edges, covers


def _stab(instants, spans, keys, cell, levels, hot_edges):
    """Winning span of each distinct (keys, _ts)."""
    points = instants.withColumn("_cell", _cell(F.col("_ts"), cell))
    edges, covers = _candidates(points, spans, keys, cell, levels)
    hot = _hot_cells(edges, keys, hot_edges) if cell > 1 else None
    found = covers
    refined = None
    if hot is not None:
        outer = f"_outer{len(keys)}"
        hot_points = points.join(hot, keys + ["_cell"], "left_semi")
        hot_spans = _clip(edges.join(hot, keys + ["_cell"], "left_semi"), cell)
        refined = _stab(
            hot_points.withColumnRenamed("_cell", outer),
            hot_spans.withColumnRenamed("_cell", outer).select(
                *keys, outer, "_prio", "_lo", "_hi", "_win"),
            keys + [outer], max(1, cell // REFINE), 3, hot_edges,
        ).drop(outer)
        edges = edges.join(hot, keys + ["_cell"], "left_anti")
    found = edges.unionByName(found)
    # grouped by instant, not by cell: a cell with very many points can then be
    # split by the adaptive skew join, and the result is already placed for the
    # join back to the points
    hits = (points.join(found.hint("merge"), keys + ["_cell"])
            .where(F.col("_ts").between(F.col("_lo"), F.col("_hi")))
            .groupBy(*keys, "_ts").agg(F.max_by(F.struct("_prio", "_win"), "_prio").alias("_b")))
    if refined is not None:
        hits = (hits.unionByName(refined).groupBy(*keys, "_ts")
                .agg(F.max_by("_b", F.col("_b._prio")).alias("_b")))
    return hits


def _clip(edges: DataFrame, cell: int) -> DataFrame:
    """Cut edge intervals to the cell they are listed under."""
    return edges.withColumns({"_hi": F.least("_hi", (F.col("_cell") + 1) * cell - 1),
                              "_lo": F.greatest("_lo", F.col("_cell") * cell)})


def stab_join(
    points: DataFrame,
    windows: DataFrame,
    *,
    by: list[str],
    ts: str,
    lo: str,
    hi: str,
    prefer: Column,
    keep: list[str],
    cell: int,
    levels: int = 4,
    hot_edges: int | None = 4096,
    name: str = "win",
    computed: bool = True,
) -> DataFrame:
    """Attach to each point the preferred window with ``lo <= ts <= hi``.

    The result has all point columns plus ``name``, a struct of the window
    columns ``keep`` (null when no window covers the point).  ``prefer`` orders
    the windows: the largest value wins, so earliest-first is a negated start.
    Points of one instant share one answer, so only distinct instants are
    matched.  ``cell`` is the cell width in units of ``ts``; a value near the
    typical window length is best.  The windows and instants are read several
    times, so they are written once first; pass ``computed=False`` when both
    inputs are plain tables.
    """
    keep_once = cut_lineage if computed else (lambda df: df)
    spans = (windows.where(F.col(lo) <= F.col(hi))
             .select(*by, prefer.alias("_prio"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"),
                     F.struct(*keep).alias("_win")))
    instants = points.where(F.col(ts).isNotNull()).select(*by, F.col(ts).alias("_ts")).distinct()
    hits = _stab(keep_once(instants), keep_once(spans), by, cell, levels, hot_edges)
    hits = hits.select(*by, F.col("_ts").alias(ts), F.col("_b._win").alias(name))
    # hits grow with the points; small ones must not pass the driver
    return points.join(hits.hint("merge"), by + [ts], "left")


def interval_aggregate(
    intervals: DataFrame,
    points: DataFrame,
    *,
    by: list[str],
    interval_key: list[str],
    lo: str,
    hi: str,
    ts: str,
    aggs: dict[str, tuple[str, Column]],
    cell: int,
    levels: int = 4,
    after: tuple[str, str] | None = None,
    hot_rows: int | None = 4096,
    computed: bool = True,
) -> DataFrame:
    """Aggregate the points inside each interval (``lo <= ts <= hi``).

    ``aggs`` maps a column to (max|min|sum, point expression); all of them merge,
    so whole cells are aggregated once and shared by every interval over them.
    ``after=(interval_column, point_column)`` also asks for point > interval in
    that column; it must agree with the time order.  The result has one row per
    interval that holds at least one point.  ``computed`` as in :func:`stab_join`.
    """
    keep_once = cut_lineage if computed else (lambda df: df)
    merge = {"max": F.max, "min": F.min, "sum": F.sum}
    names = list(aggs)
    on_key = list(dict.fromkeys(by + interval_key))
    slim = intervals.where(F.col(lo) <= F.col(hi)).select(
        *on_key, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"),
        *([F.col(after[0]).alias("_after")] if after else []))
    pts = points.select(
        *by, F.col(ts).alias("_ts"), *([F.col(after[1]).alias("_at")] if after else []),
        *[e.alias(n) for n, (_, e) in aggs.items()])
    parts = _interval_parts(keep_once(slim), keep_once(pts), by, on_key, names, aggs, merge, cell,
                            levels, bool(after), hot_rows)
    return parts.groupBy(*on_key).agg(*[merge[aggs[n][0]](n).alias(n) for n in names])


def _interval_parts(slim, pts, by, on_key, names, aggs, merge, cell, levels, after, hot_rows):
    pts = pts.withColumn("_cell", _cell(F.col("_ts"), cell))
    slim = slim.withColumns({"_c0": _cell(F.col("_lo"), cell), "_c1": _cell(F.col("_hi"), cell)})
    keep = on_key + ["_lo", "_hi"] + (["_after"] if after else [])
    edges = slim.withColumn("_cell", F.explode(F.array_distinct(F.array("_c0", "_c1")))).select(*keep, "_cell")

    per_cell = pts.groupBy(*by, "_cell").agg(*[merge[aggs[n][0]](n).alias(n) for n in names])
    tree = (per_cell.withColumn("_n", F.explode(_ancestors(F.col("_cell"), levels)))
            .groupBy(*by, F.col("_n.level").alias("level"), F.col("_n.node").alias("node"))
            .agg(*[merge[aggs[n][0]](n).alias(n) for n in names]))
    # the planner sizes exploded rows by the table under them, which is many times less: left to
    # itself it sends them all through the driver as a broadcast
    nodes = (slim.withColumn("_n", F.explode(_tree_nodes(F.col("_c0") + 1, F.col("_c1"), levels)))
             .select(*on_key, F.col("_n.level").alias("level"), F.col("_n.node").alias("node")))
    whole = nodes.hint("merge").join(tree, by + ["level", "node"]).select(*on_key, *names)
    out = [whole]
    hot = _hot_cells(pts, by, hot_rows) if cell > 1 else None
    if hot is not None:
        hot_edges = _clip(edges.join(hot, by + ["_cell"], "left_semi"), cell)
        hot_pts = pts.join(hot, by + ["_cell"], "left_semi")
        outer = f"_outer{len(by)}"
        finer = _interval_parts(
            hot_edges.withColumnRenamed("_cell", outer),
            hot_pts.withColumnRenamed("_cell", outer),
            by + [outer], on_key + [outer], names, aggs, merge,
            max(1, cell // REFINE), 3, after, hot_rows)
        out.append(finer.select(*on_key, *names))
        edges = edges.join(hot, by + ["_cell"], "left_anti")
    inside = F.col("_ts").between(F.col("_lo"), F.col("_hi"))
    if after:
        inside = inside & (F.col("_at") > F.col("_after"))
    out.append(edges.join(pts, by + ["_cell"]).where(inside).select(*on_key, *names))
    return reduce(DataFrame.unionByName, out)
