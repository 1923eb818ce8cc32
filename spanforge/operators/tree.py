"""Scope trees as adjacency tables: linking, rollup, pruning, rendering order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanforge.operators.gpu import UNSCOPED_ID
from spanforge.operators.scan import CHUNK_ROWS, with_running
from spanforge.session_conf import cut_lineage


def _combined(fn: str, own: Column, more: Column) -> Column:
    if fn == "sum":
        return F.coalesce(own + more, own, more)
    if fn == "any":
        return F.coalesce(own, F.lit(False)) | F.coalesce(more, F.lit(False))
    return F.coalesce(F.concat(more, own), own)  # list: the ancestors come first


def _climb(state: DataFrame, keys: list[str], along: dict[str, str], below: dict[str, str]) -> DataFrame:
    """Follow ``_up`` (null at a root) from every ``_id`` to its root, by pointer doubling.

    In round k the pointer of an open node leads to its ancestor 2^k levels up, and

    * a column of ``along`` (name to sum, any or list) is folded over the node and the
      2^k - 1 ancestors above it; it takes over what the pointer's target has,
    * a column of ``below`` (name to sum or any) is folded over the node and its descendants
      within 2^k - 1 levels; it takes over what the nodes whose pointers lead to it have.

    So a tree of depth d needs log2(d) rounds of one join (and one aggregate, which is
    partial on the map side, so a root over most rows is no hot group), and a node takes
    the same room at any depth, but for lists.  ``_dead`` marks nodes whose way up ends at
    an unknown node.  A round that closes no node shows that what is still open runs in a
    circle; those nodes are left out.  The driver reads one number a round.
    """
    state = cut_lineage(state.withColumn("depth", F.lit(0)))
    still = open_ = state.where(F.col("_up").isNotNull()).count()
    while open_:
        above = state.select(*keys, F.col("_id").alias("_up"), F.col("_up").alias("_next"), F.col("_dead").alias("_lost"),
                             F.col("depth").alias("_far"), *[F.col(n).alias(f"_above_{n}") for n in along], F.lit(True).alias("_hit"))
        # a round's table is as large as the trees; small files of it must not pass the driver in every round
        step = state.join(above.hint("merge"), keys + ["_up"], "left")
        lost = F.coalesce("_lost", F.col("_up").isNotNull() & F.col("_hit").isNull())
        # a pointer spans one level more than the distance to where the ancestor's own pointer starts
        step = step.select(*keys, "_id", F.col("_next").alias("_up"), (F.col("_dead") | lost).alias("_dead"),
                           F.when(F.col("_hit"), F.col("depth") + F.col("_far") + 1).otherwise(F.col("depth")).alias("depth"),
                           *[_combined(fn, F.col(n), F.col(f"_above_{n}")).alias(n) for n, fn in along.items()], *below)
        if below:
            gain = state.where(F.col("_up").isNotNull()).groupBy(*keys, F.col("_up").alias("_id")).agg(
                *[(F.sum(n) if fn == "sum" else F.bool_or(n)).alias(f"_below_{n}") for n, fn in below.items()])
            step = step.join(gain.hint("merge"), keys + ["_id"], "left").withColumns({n: _combined(fn, F.col(n), F.col(f"_below_{n}")) for n, fn in below.items()}).drop(
                *[f"_below_{n}" for n in below])
        state = cut_lineage(step.withColumn("_up", F.when(~F.col("_dead"), F.col("_up"))))
        still, open_ = open_, state.where(F.col("_up").isNotNull()).count()
        if open_ == still:
            break
    return state.where(F.col("_up").isNull() & ~F.col("_dead")).drop("_up", "_dead")


Folds = dict[str, tuple[str, Column]]


def _functions(folds: Folds | None) -> dict[str, str]:
    return {n: fn for n, (fn, _) in (folds or {}).items()}


def linked_tree(nodes: DataFrame, *, keys: list[str], node: str, parent: str, order: str, with_path: bool = True,
                along: Folds | None = None, below: Folds | None = None) -> DataFrame:
    """Nodes reachable from a root with their depth and ancestor path (ids, root first).

    A child hangs on its parent only if the parent was entered earlier; a child
    of an unknown or later parent leaves the result with its subtree.  ``along`` and
    ``below`` name columns that are folded over a node's path and over its subtree, as
    (function, value of a node).  Trees may be of any depth; without paths a node takes the
    same room at any depth.
    """
    along = {**(along or {}), **({"path": ("list", F.array(node))} if with_path else {})}
    values = {**along, **(below or {})}
    flat = nodes.select(*keys, F.col(node).alias("_id"), F.col(parent).alias("_parent"), F.col(order).alias("_ord"),
                        *[v.alias(n) for n, (_, v) in values.items()])
    over = flat.select(*keys, F.col("_id").alias("_parent"), F.col("_ord").alias("_before"))
    linked = flat.join(over.hint("merge"), keys + ["_parent"], "left")
    early = F.coalesce(F.col("_before") < F.col("_ord"), F.lit(False))
    state = linked.select(*keys, "_id", F.when(early, F.col("_parent")).alias("_up"), (F.col("_parent").isNotNull() & ~early).alias("_dead"), *values)
    return _climb(state, keys, _functions(along), _functions(below)).withColumnRenamed("_id", node)


def fold_tree(tree: DataFrame, *, keys: list[str], node: str, parent: str, along: Folds | None = None, below: Folds | None = None) -> DataFrame:
    """Folds over the paths and subtrees of a tree's nodes, as ``linked_tree`` has them: keys, node, depth, folds.

    A node whose parent is not in ``tree`` is left out with its subtree.
    """
    values = {**(along or {}), **(below or {})}
    state = tree.select(*keys, F.col(node).alias("_id"), F.col(parent).alias("_up"), F.lit(False).alias("_dead"), *[v.alias(n) for n, (_, v) in values.items()])
    return _climb(state, keys, _functions(along), _functions(below)).withColumnRenamed("_id", node)


def rollup(tree: DataFrame, values: DataFrame, *, keys: list[str], node: str, parent: str, value: str, out: str) -> DataFrame:
    """Subtree sums: each node's value goes to itself and every ancestor; ``tree`` has the parents."""
    rows = tree.join(values.select(*keys, node, F.col(value).alias("_value")), keys + [node], "left")
    return fold_tree(rows, keys=keys, node=node, parent=parent, below={out: ("sum", F.col("_value"))}).select(*keys, node, out)


def breakdown_tree(totals: DataFrame) -> DataFrame:
    """Scope totals as a tree: depth and subtree GPU time.

    ``<unscoped>`` is a leaf under the root; the grand total is the sum of the
    roots and of it.
    """
    keys = ["session_key"]
    calls = totals.where(F.col("node_id") != UNSCOPED_ID)
    tree = linked_tree(calls, keys=keys, node="node_id", parent="parent_call_id", order="enter_ord", with_path=False,
                       below={"gpu_ns_subtree": ("sum", F.col("gpu_ns_self"))})
    linked = calls.join(tree.hint("merge"), keys + ["node_id"])
    unscoped = totals.where(F.col("node_id") == UNSCOPED_ID).withColumns({
        "depth": F.lit(0), "gpu_ns_subtree": F.col("gpu_ns_self")})
    nodes = linked.unionByName(unscoped)
    grand = nodes.where(F.col("depth") == 0).groupBy(*keys).agg(
        F.sum("gpu_ns_subtree").alias("grand_total_ns"))
    return nodes.join(grand.hint("merge"), keys)


def path_names(tree: DataFrame) -> DataFrame:
    """Add ``path_names``: the qualified names along each node's path."""
    keys = ["session_key"]
    lists = fold_tree(tree, keys=keys, node="node_id", parent="parent_call_id", along={"path_names": ("list", F.array("qualname"))})
    return tree.join(lists.drop("depth").hint("merge"), keys + ["node_id"])


def folded_stacks(tree: DataFrame) -> DataFrame:
    """``a;b;c <ns>`` per node with own time; the root is left out, <unscoped> stays.

    A line names the whole path, so the lines of a chain of n nodes with own time have
    n^2 / 2 names; no other operator of this module takes more room for a deep tree.
    """
    named = path_names(tree)
    return named.where(F.col("gpu_ns_self") > 0).select(
        "session_key", F.concat_ws(" ", F.array_join("path_names", ";"),
                                   F.col("gpu_ns_self").cast("string")).alias("line"))


def prune(tree: DataFrame, *, max_depth: int | None = None, min_ns: int = 0,
          top_n: int | None = None, keys: list[str] | None = None, node: str = "node_id",
          parent: str = "parent_call_id") -> DataFrame:
    """Keep nodes above ``min_ns`` and, per parent, the top children; a dropped node
    takes its subtree with it.  ``max_depth`` counts levels below the root."""
    keys = keys or ["session_key"]
    kept = tree if max_depth is None else tree.where(F.col("depth") < max_depth)
    if min_ns <= 0 and top_n is None:
        return kept
    if min_ns > 0:
        kept = kept.where(F.col("gpu_ns_subtree") >= min_ns)
    if top_n is not None:
        w = Window.partitionBy(*keys, F.coalesce(F.col(parent).cast("string"), F.lit("<root>"))).orderBy(
            F.col("gpu_ns_subtree").desc(), F.col(node))
        kept = kept.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_n).drop("_r")
    reached = fold_tree(kept, keys=keys, node=node, parent=parent).select(*keys, node)
    return kept.join(reached, keys + [node], "left_semi")


def field_filter(tree: DataFrame, wanted: dict[str, tuple[str, str]], *, keys: list[str] | None = None, node: str = "node_id",
                 parent: str = "parent_call_id") -> DataFrame:
    """Keep nodes whose fields hold every wanted (type, text) value, and their ancestors."""
    keys = keys or ["session_key"]
    match = F.lit(True)
    for k, (t, v) in wanted.items():
        have = F.try_element_at(F.col("fields"), F.lit(k))
        match = match & F.coalesce((have["t"] == t) & (have["v"] == v), F.lit(False))
    kept = fold_tree(tree, keys=keys, node=node, parent=parent, below={"_match": ("any", match)}).where("_match")
    return tree.join(kept.select(*keys, node), keys + [node], "left_semi")


def top_ops_per_node(ops: DataFrame, n: int, *, include: bool = True) -> DataFrame:
    w = Window.partitionBy("session_key", "node_id").orderBy(F.col("gpu_ns").desc(), F.col("name"))
    ranked = ops.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked if include else ranked.where(F.lit(False))


def tree_table(tree: DataFrame, *, top: int = 20, max_depth: int = 3) -> DataFrame:
    """Table rows: depth up to ``max_depth``, largest subtree first, share of the grand total."""
    w = Window.partitionBy("session_key").orderBy(F.col("gpu_ns_subtree").desc(), F.col("node_id"))
    rows = tree.where(F.col("depth") <= max_depth)
    shown = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    counts = rows.groupBy("session_key").agg(F.count(F.lit(1)).alias("rows_total"))
    pct = F.col("gpu_ns_subtree") / F.greatest(F.lit(1), F.col("grand_total_ns")) * 100.0
    return shown.join(counts, "session_key").withColumn("pct", pct)


def descendants(snapshots: DataFrame, *, keys: list[str], root: Column, pid: str = "pid", ppid: str = "ppid", with_path: bool = True) -> DataFrame:
    """Each snapshot's root process and all its descendants, with depth and path, root first.

    Processes whose parents run in a circle, or end elsewhere, are none.
    """
    flat = snapshots.select(*keys, F.col(pid).alias("_id"), F.when(F.col(pid) != root, F.col(ppid)).alias("_up"),
                            (F.col(pid).isNull() | (F.col(pid) != root) & F.col(ppid).isNull()).alias("_dead"),
                            *([F.array(pid).alias("path")] if with_path else []))
    return _climb(flat, keys, {"path": "list"} if with_path else {}, {}).withColumnRenamed("_id", pid)


def breakdown_trace(tree: DataFrame, ops: DataFrame) -> DataFrame:
    """Trace rows shaped like the tree: children laid end to end inside their parent.

    A node starts where its parent starts plus the durations of the larger
    siblings before it, so the offset is a running sum over siblings and the
    start is the sum of the offsets along the path.  Durations are whole
    microseconds, at least 1.  Op rows sit one level below, end to end.
    """
    keys = ["session_key"]
    dur = F.greatest(F.lit(1).cast("bigint"), F.call_function("div", F.col("gpu_ns_subtree"), F.lit(1000)))
    timed = tree.withColumns({
        "dur": dur, "_neg": -F.col("gpu_ns_subtree"),
        "_sib": F.coalesce(F.col("parent_call_id").cast("string"), F.lit("<root>"))})
    # a parent may have any number of children: cut them by size, idle ones by id
    size = F.floor(F.log2(F.col("gpu_ns_subtree").cast("double") + 1.0) * 64).cast("long")
    cut = F.struct((-size).alias("s"), F.when(size == 0, F.floor(F.col("node_id") / CHUNK_ROWS)).otherwise(0).alias("i"))
    timed = with_running(timed, keys + ["_sib"], ["_neg", "node_id"], {"_off": ("sum", F.col("dur"))},
                         chunk=cut, before=True)
    timed = timed.withColumn("_off", F.coalesce("_off", F.lit(0).cast("bigint"))).drop("_neg", "_sib")
    starts = fold_tree(timed, keys=keys, node="node_id", parent="parent_call_id", along={"ts": ("sum", F.col("_off"))})
    # what is known of each node grows with the trees and must not pass the driver
    nodes = timed.join(starts.drop("depth").hint("merge"), keys + ["node_id"])
    scope_rows = nodes.select(
        *keys, F.col("qualname").alias("name"), F.col("class_name").alias("cat"), "ts", "dur",
        F.col("depth").alias("tid"),
        F.to_json(F.struct("calls", F.call_function("div", F.col("gpu_ns_self"), F.lit(1000)).alias("gpu_self_us"),
                           "eval_count", "cb_count")).alias("args"))
    op_dur = F.greatest(F.lit(1).cast("bigint"), F.call_function("div", F.col("gpu_ns"), F.lit(1000)))
    w = Window.partitionBy(*keys, "node_id").orderBy(F.col("gpu_ns").desc(), F.col("name")).rowsBetween(
        Window.unboundedPreceding, -1)
    laid = ops.withColumn("dur", op_dur).withColumn(
        "_off", F.coalesce(F.sum("dur").over(w), F.lit(0).cast("bigint")))
    op_rows = laid.join(nodes.select(*keys, "node_id", "ts", "depth").hint("merge"), keys + ["node_id"]).select(
        *keys, "name", F.lit("op").alias("cat"), (F.col("ts") + F.col("_off")).alias("ts"), "dur",
        (F.col("depth") + 1).alias("tid"), F.to_json(F.struct("count", "gpu_ns")).alias("args"))
    return scope_rows.unionByName(op_rows)
