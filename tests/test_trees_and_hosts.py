"""Trees of any depth, and joins that keep hosts apart."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import incidents, reports, tree


def test_deep_chain_and_broken_links(spark):
    n = 300
    rows = [("s", i, i - 1 if i else None, i) for i in range(n)]  # one chain
    rows += [("s", 1000, 999, 5), ("s", 1001, 1000, 6)]  # hangs on an unknown node
    rows += [("s", 2000, 2001, 7), ("s", 2001, None, 8)]  # its parent comes later
    nodes = spark.createDataFrame(rows, "k string, id long, parent long, ord long")
    got = {r.id: (r.depth, r.path) for r in tree.linked_tree(nodes, keys=["k"], node="id", parent="parent", order="ord").collect()}
    assert got == {**{i: (i, list(range(i + 1))) for i in range(n)}, 2001: (0, [2001])}
    flat = tree.linked_tree(nodes, keys=["k"], node="id", parent="parent", order="ord", with_path=False)
    assert flat.columns == ["k", "id", "depth"] and {r.id: r.depth for r in flat.collect()} == {k: d for k, (d, _) in got.items()}


@pytest.fixture(scope="module")
def chain(spark):
    """A chain, the even nodes of which have a leaf beside the next node."""
    n = 200
    rows = [("s", i, i - 1 if i else None, 1, f"q{i}", {"step": ("int", str(i))}) for i in range(n)]
    rows += [("s", 1000 + i, i, 10, f"leaf{i}", {"step": ("int", "leaf")}) for i in range(0, n, 2)]
    nodes = spark.createDataFrame([(*r[:5], {k: {"t": t, "v": v} for k, (t, v) in r[5].items()}) for r in rows],
                                  "session_key string, node_id long, parent_call_id long, gpu_ns_self long, qualname string, fields map<string,struct<t:string,v:string>>")
    sums = tree.rollup(nodes, nodes, keys=["session_key"], node="node_id", parent="parent_call_id", value="gpu_ns_self", out="gpu_ns_subtree")
    return nodes.join(sums, ["session_key", "node_id"]).cache()


def test_rollup_and_folds_of_a_deep_chain(chain):
    assert {r.node_id: r.gpu_ns_subtree for r in chain.collect() if r.node_id < 1000} == {i: 200 - i + 10 * len(range(i + i % 2, 200, 2)) for i in range(200)}
    got = tree.fold_tree(chain, keys=["session_key"], node="node_id", parent="parent_call_id",
                         along={"above": ("sum", F.col("node_id"))}, below={"odd": ("any", F.col("node_id") == 199)})
    assert {r.node_id: (r.depth, r.above, r.odd) for r in got.collect()} == {
        **{i: (i, i * (i + 1) // 2, True) for i in range(200)}, **{1000 + i: (i + 1, i * (i + 1) // 2 + 1000 + i, False) for i in range(0, 200, 2)}}


def test_prune_filter_and_stacks_of_a_deep_chain(chain):
    ids = lambda df: {r.node_id for r in df.collect()}
    assert ids(tree.prune(chain, min_ns=11)) == {i for i in range(200) if 200 - i + 10 * len(range(i + i % 2, 200, 2)) >= 11}
    assert ids(tree.prune(chain, top_n=1)) == set(range(199)) | {1198}  # at last the leaf of 10 beats the node of 1
    assert ids(tree.field_filter(chain, {"step": ("int", "120")})) == set(range(121))
    assert ids(tree.field_filter(chain, {"step": ("int", "none")})) == set()
    lines = {r.line for r in tree.folded_stacks(chain).collect()}
    assert lines == {";".join(f"q{k}" for k in range(i + 1)) + " 1" for i in range(200)} | {
        ";".join(f"q{k}" for k in range(i + 1)) + f";leaf{i} 10" for i in range(0, 200, 2)}


def test_descendants_leave_circles_out(spark):
    snap = spark.createDataFrame([(1, 0, 9), (2, 1, 9), (3, 2, 9), (4, 5, 9), (5, 4, 9), (6, 77, 9)], "pid long, ppid long, snap long")
    got = {r.pid: (r.depth, r.path) for r in tree.descendants(snap, keys=["snap"], root=F.lit(1)).collect()}
    assert got == {1: (0, [1]), 2: (1, [1, 2]), 3: (2, [1, 2, 3])}


def test_hosts_are_kept_apart(spark):
    events = spark.createDataFrame([("a", 1, "h1", 100), ("b", 2, "h2", 100), ("a", 3, "h1", 40)], "session_key string, event_ord long, host string, ts_wall_ns long")
    triggers = spark.createDataFrame([("i", "x", 100, "h1")], "incident_key string, incident_label string, incident_ts long, host string")
    near = incidents.trailing_window(events, triggers, host="host", window_ns=60).collect()
    assert sorted(r.event_ord for r in near) == [1, 3]
    assert sorted(r.event_ord for r in incidents.trailing_window(events, triggers, host=None, window_ns=60).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        incidents.trailing_window(events.drop("host"), triggers, host="host", window_ns=60)
    bounds = spark.createDataFrame([("a", "h1", 1, 0, 10, 7), ("b", "h2", 1, 0, 10, 7)], "session_key string, host string, exit_code int, start_ns long, end_ns long, kind_pid long")
    crash = spark.createDataFrame([("h2", 0, "/r", 5, 7)], "host string, dir_rank int, path string, mtime_ns long, crashed_pid long")
    assert [r.session_key for r in reports.crash_matches(bounds, crash, host="host").collect()] == ["b"]
    with pytest.raises(ValueError):
        reports.crash_matches(bounds, crash.drop("host"), host="host")


@pytest.mark.parametrize("chunk_rows", [3, 1 << 20])
def test_recorder_ranges_against_brute_force(spark, chunk_rows):
    """Bursts of one instant, windows that overlap, hosts that share times."""
    rng = random.Random(chunk_rows)
    events = [(f"s{k % 7}", k, f"h{k % 2}", rng.choice([rng.randint(0, 300), 150])) for k in range(400)]
    triggers = [(f"i{k}", "x", rng.choice([rng.randint(0, 330), 150, 170]), f"h{k % 2}") for k in range(40)]
    df = spark.createDataFrame(events, "session_key string, event_ord long, host string, ts_wall_ns long")
    inc = spark.createDataFrame(triggers, "incident_key string, incident_label string, incident_ts long, host string")
    kept, ranges = incidents.recorder(df, inc, host="host", window_ns=20, chunk_rows=chunk_rows)
    order = {h: sorted(((t, s, k) for s, k, x, t in events if x == h)) for h in ("h0", "h1")}
    want = {i: [k for t, _, k in order[h] if at - 20 <= t <= at] for i, _, at, h in triggers}
    place = {k: n for h in order for n, (_, _, k) in enumerate(order[h], 1)}
    assert {r.event_ord: r.position for r in kept.collect()} == {k: place[k] for k in set().union(*want.values())}
    assert all(r.last - r.first + 1 == len(want[r.incident_key]) and (r.first > r.last or (r.first, r.last) == (place[want[r.incident_key][0]], place[want[r.incident_key][-1]]))
               for r in ranges.collect())
    got = incidents.events_of(kept, ranges, host="host", cell=8).collect()
    assert sorted((r.incident_key, r.event_ord) for r in got) == sorted((i, k) for i, ks in want.items() for k in ks)


def test_hot_process_ids_meet_in_time_cells(spark):
    rng = random.Random(4)
    hour = 3600 * 10**9
    bounds = [(f"s{k}", 1, k * hour // 4, k * hour // 4 + hour, 7) for k in range(200)]
    crash = [(rng.randint(0, 1), f"/r{k}", rng.randint(0, 60 * hour), 7) for k in range(300)]
    got = reports.crash_matches(spark.createDataFrame(bounds, "session_key string, exit_code int, start_ns long, end_ns long, kind_pid long"),
                                spark.createDataFrame(crash, "dir_rank int, path string, mtime_ns long, crashed_pid long"), host=None)
    best = lambda a, z: min(((d, -t, p) for d, p, t, _ in crash if a <= t <= z + reports.REPORT_GRACE_NS), default=None)
    want = {s: best(a, z)[2] for s, _, a, z, _ in bounds if best(a, z)}
    assert {r.session_key: r.path for r in got.collect()} == want
