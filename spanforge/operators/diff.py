"""A/B comparison of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanforge.functions.labels import op_kind
from spanforge.functions.text import pct_change
from spanforge.session_conf import cut_lineage


def scope_map(tree: DataFrame) -> DataFrame:
    """Subtree time per name over all nodes; nested same-name nodes count each time."""
    return tree.groupBy("session_key", "qualname").agg(F.sum("gpu_ns_subtree").alias("gpu_ns"))


def op_map(ops: DataFrame) -> DataFrame:
    key = F.coalesce("op_kind", op_kind(F.col("symbol")), "symbol", "name")
    return ops.groupBy("session_key", key.alias("op_kind")).agg(F.sum("gpu_ns").alias("gpu_ns"))


def delta(a: DataFrame, b: DataFrame, *, on: list[str], value: str, how: str = "inner",
          unit: str = "ns") -> DataFrame:
    """Matched values of A and B with difference and percent; how='full_outer' fills 0."""
    zero = F.lit(0).cast("bigint")
    left = a.select(*on, F.col(value).alias(f"a_{value}"))
    right = b.select(*on, F.col(value).alias(f"b_{value}"))
    av, bv = F.coalesce(f"a_{value}", zero), F.coalesce(f"b_{value}", zero)
    return left.join(right, on, how).select(
        *on, av.alias(f"a_{value}"), bv.alias(f"b_{value}"), (bv - av).alias(f"delta_{unit}"),
        pct_change(av, bv).alias("delta_pct"))


def only_in(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on), on, "left_anti")


def by_size(deltas: DataFrame, *, unit: str = "ns", tie: str = "qualname") -> DataFrame:
    """Largest change first."""
    return deltas.orderBy(F.abs(F.col(f"delta_{unit}")).desc(), tie)


def pair_sides(pairs: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of sessions A and B of each pair, keyed by pair_id."""
    # each side reads the values, and they are short against what they are made of
    values = cut_lineage(values)
    a = pairs.select("pair_id", F.col("session_a").alias("session_key")).join(values, "session_key").drop("session_key")
    b = pairs.select("pair_id", F.col("session_b").alias("session_key")).join(values, "session_key").drop("session_key")
    return a, b


def diff_scopes(pairs: DataFrame, tree: DataFrame) -> dict[str, DataFrame]:
    a, b = pair_sides(pairs, scope_map(tree))
    on = ["pair_id", "qualname"]
    return {"deltas": delta(a, b, on=on, value="gpu_ns"), "only_in_a": only_in(a, b, on),
            "only_in_b": only_in(b, a, on)}


def diff_ops(pairs: DataFrame, ops: DataFrame) -> DataFrame:
    a, b = pair_sides(pairs, op_map(ops))
    return delta(a, b, on=["pair_id", "op_kind"], value="gpu_ns", how="full_outer")


def diff_memory(pairs: DataFrame, scope_mem: DataFrame) -> DataFrame:
    a, b = pair_sides(pairs, scope_mem.select("session_key", "qualname", "peak_bytes"))
    return delta(a, b, on=["pair_id", "qualname"], value="peak_bytes", unit="bytes")


def diff_origins(pairs: DataFrame, origins: DataFrame) -> DataFrame:
    a, b = pair_sides(pairs, origins.select("session_key", "op_kind", "file_line", "gpu_ns"))
    return delta(a, b, on=["pair_id", "op_kind", "file_line"], value="gpu_ns")


def session_stats(events: DataFrame) -> DataFrame:
    """Event count and duration from first to last event in log order."""
    span = F.max_by("ts_mono_ns", "event_ord") - F.min_by("ts_mono_ns", "event_ord")
    return events.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("event_count"), F.greatest(F.lit(0).cast("bigint"), span).alias("duration_ns"))


def source_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session_key", "source").agg(F.count(F.lit(1)).alias("count"))


def compare_sessions(pairs: DataFrame, stats: DataFrame, root_causes: DataFrame) -> DataFrame:
    """Per pair: both sessions' stats, their differences, and whether root causes agree."""
    s = cut_lineage(stats.join(root_causes, "session_key", "left"))

    def side(x):
        return pairs.select("pair_id", F.col(f"session_{x}").alias("session_key")).join(s, "session_key", "left").select(
            "pair_id", F.col("session_key").alias(f"session_{x}"), F.col("event_count").alias(f"{x}_event_count"),
            F.col("duration_ns").alias(f"{x}_duration_ns"), F.col("root_cause_title").alias(f"{x}_root_cause"))

    return side("a").join(side("b"), "pair_id").withColumns({
        "event_count_diff": F.col("b_event_count") - F.col("a_event_count"),
        "duration_diff_ns": F.col("b_duration_ns") - F.col("a_duration_ns"),
        "root_cause_match": F.col("a_root_cause").eqNullSafe(F.col("b_root_cause"))})


def degraded_banner(pairs: DataFrame, episodes: DataFrame) -> DataFrame:
    """Pairs with partial op numbers and a notice naming the side and its episodes."""
    a, b = pair_sides(pairs, episodes)
    both = a.withColumnRenamed("episodes", "a").join(b.withColumnRenamed("episodes", "b"), "pair_id")
    lines = [F.when(F.col(x) > 0, F.format_string(f"{x.upper()}: sampling was off %d time(s)", F.col(x))) for x in ("a", "b")]
    return both.where((F.col("a") > 0) | (F.col("b") > 0)).select(
        "pair_id", F.concat_ws("\n", F.lit("figures per op are incomplete"), *lines).alias("banner"))
