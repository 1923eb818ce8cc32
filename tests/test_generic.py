"""Generic operators against brute force, with chunks and cells small enough to be crossed."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import pairing, scan, sequences, stab


def _log(seed, n=400, users=3):
    r = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += r.choice([0, 1, 1, 2, 5, 30])
        # one user holds most of the rows
        rows.append((0 if r.random() < 0.6 else r.randrange(1, users), i, t, r.randrange(4), r.choice("bep"), r.randrange(50)))
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return _log(request.param)


def _df(spark, rows):
    return spark.createDataFrame(rows, "u int, ord bigint, t bigint, key int, typ string, v bigint")


@pytest.mark.parametrize("before", [False, True])
def test_chunked_running_equals_plain_window(spark, rows, before):
    df = _df(spark, rows)
    aggs = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("count", F.lit(1)), "lo": ("min", F.col("v")),
            "l": ("last", F.when(F.col("typ") == "b", F.col("v"))), "x": ("next", F.when(F.col("typ") == "e", F.col("ord")))}
    plain = scan.with_running(df, ["u"], ["ord"], aggs, before=before)
    cut = scan.with_running(df, ["u"], ["ord"], aggs, before=before, chunk=scan.chunk_of("ord", 7))
    got = lambda d: sorted(map(tuple, d.select("u", "ord", *aggs).collect()))
    fix = lambda r: [tuple(0 if (i == 4 and v is None) else v for i, v in enumerate(x)) for x in r]
    assert fix(got(plain)) == fix(got(cut))


def _pairs(rows):
    open_, out = {}, []
    for u, o, t, key, typ, _ in rows:
        if typ == "b":
            open_[u, key] = (o, t)
        elif typ == "e" and (u, key) in open_:
            b = open_.pop((u, key))
            out.append((u, b[0], o, b[1], t))
    return out


def _paired(spark, rows):
    p = pairing.pair_intervals(_df(spark, rows), keys=["u", "key"], order="ord", begin=F.col("typ") == "b", end=F.col("typ") == "e",
                               carry={"b_ord": F.col("ord"), "b_t": F.col("t")}, chunk=scan.chunk_of("ord", 16))
    return p.select("u", "b_ord", F.col("ord").alias("e_ord"), "b_t", F.col("t").alias("e_t"))


def test_pairing_fold(spark, rows):
    assert sorted(map(tuple, _paired(spark, rows).collect())) == sorted(_pairs(rows))


@pytest.mark.parametrize("cell,hot", [(64, None), (8, None), (4096, 3), (1, None), (10**6, 2)])
@pytest.mark.parametrize("pick", ["earliest", "innermost"])
def test_stab_join_brute_force(spark, rows, cell, hot, pick):
    tail = 4
    wins = [(u, b, e, bt, et + tail) for u, b, e, bt, et in _pairs(rows)]
    w = spark.createDataFrame(wins, "u int, b bigint, e bigint, lo bigint, hi bigint")
    pts = _df(spark, rows).where("typ = 'p'")
    prefer = F.struct(-F.col("lo"), -F.col("e")) if pick == "earliest" else F.struct("lo", "b")
    got = stab.stab_join(pts, w, by=["u"], ts="t", lo="lo", hi="hi", prefer=prefer, keep=["b"], cell=cell, levels=2, hot_edges=hot)
    got = {r["ord"]: r["win"]["b"] if r["win"] else None for r in got.collect()}
    want = {}
    for u, o, t, _, typ, _ in rows:
        if typ == "p":
            hits = [x for x in wins if x[0] == u and x[3] <= t <= x[4]]
            best = (min(hits, key=lambda x: (x[3], x[2])) if pick == "earliest" else max(hits, key=lambda x: (x[3], x[1]))) if hits else None
            want[o] = best[1] if best else None
    assert got == want


@pytest.mark.parametrize("cell,hot", [(64, None), (4096, 5), (1, None), (10**6, 2)])
def test_interval_aggregate_brute_force(spark, rows, cell, hot):
    wins = [(u, b, bt, et + 3) for u, b, e, bt, et in _pairs(rows)]
    w = spark.createDataFrame(wins, "u int, b bigint, lo bigint, hi bigint")
    pts = _df(spark, rows).where("typ = 'p'")
    got = stab.interval_aggregate(
        w.withColumnRenamed("b", "b_ord"), pts, by=["u"], interval_key=["b_ord"], lo="lo", hi="hi", ts="t", after=("b_ord", "ord"),
        cell=cell, levels=2, hot_rows=hot,
        aggs={"peak": ("max", F.col("v")), "total": ("sum", F.col("v")), "n": ("sum", F.lit(1).cast("bigint"))})
    got = {(r["u"], r["b_ord"]): (r["peak"], r["total"], r["n"]) for r in got.collect()}
    want = {}
    for u, b, lo, hi in wins:
        vals = [x[5] for x in rows if x[0] == u and x[4] == "p" and x[1] > b and x[2] <= hi]
        if vals:
            want[u, b] = (max(vals), sum(vals), len(vals))
    assert got == want


def test_saturating_depth_and_islands(spark, rows):
    up, down = F.col("typ") == "b", F.col("typ") == "e"
    got = sequences.saturating_depth(_df(spark, rows), keys=["u"], order="ord", up=up, down=down, chunk=scan.chunk_of("ord", 9))
    got = {r["ord"]: r["depth"] for r in got.collect()}
    d, want = {}, {}
    for u, o, _, _, typ, _ in rows:
        if typ in "be":
            d[u] = max(0, d.get(u, 0) + (1 if typ == "b" else -1))
            want[o] = d[u]
    assert got == want
    isl = sequences.islands(_df(spark, rows), keys=["u"], order="ord", ts="t", keep=F.col("v") >= 25, gap=6,
                            aggs=[F.count(F.lit(1)).alias("n"), F.min("ord").alias("o")], chunk=scan.chunk_of("ord", 9))
    got = sorted((r["u"], r["o"], r["n"]) for r in isl.collect())
    cur, want = {}, []
    for u, o, t, _, _, v in rows:
        if v >= 25:
            if u in cur and t - cur[u][0] <= 6:
                cur[u] = (t, cur[u][1], cur[u][2] + 1)
            else:
                if u in cur:
                    want.append((u, *cur[u][1:]))
                cur[u] = (t, o, 1)
    want += [(u, *x[1:]) for u, x in cur.items()]
    assert got == sorted(want)


def test_sequence_gaps_ignore_regressions(spark):
    df = spark.createDataFrame([("s", i, q) for i, q in enumerate([5, 6, 9, 7, 10, 10, 20])], "k string, ord bigint, seq bigint")
    got = sequences.sequence_gaps(df, keys=["k"], order="ord", seq="seq", chunk=scan.chunk_of("ord", 2)).collect()
    assert sorted((r["ord"], r["expected"], r["got"]) for r in got) == [(2, 7, 9), (6, 11, 20)]


def test_ema_folds_blocks(spark):
    vals = [float((i * 37) % 11) for i in range(50)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(vals)], "k string, ord bigint, v double")
    e = vals[0]
    for v in vals[1:]:
        e = e * 0.8 + v * 0.2
    got = sequences.ema(df, keys=["k"], order="ord", value="v", block=4).first()["ema"]
    assert got == pytest.approx(e)


def test_nearest_rank_rounds_half_up(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([10, 20, 30, 40])], "k string, ord bigint, v bigint")
    r = sequences.nearest_rank(df, keys=["k"], value="v", probs={"p50": 0.5, "p95": 0.95}).first()
    assert (r["p50"], r["p95"], r["max_value"]) == (30, 40, 40)
    neg = spark.createDataFrame([("s", v) for v in (-900, -5, -4, 0, 7)], "k string, v bigint")
    assert sequences.nearest_rank(neg, keys=["k"], value="v", probs={"p50": 0.5}).first()["p50"] == -4


def test_two_level_allocation(spark):
    from spanforge.operators import gpu

    roots = spark.createDataFrame([(1, 1000), (2, 10)], "b long, total long")
    parents = spark.createDataFrame([(1, 0, 400, False), (1, 1, 0, False), (1, 2, None, False), (1, 3, None, True), (2, 0, 50, False), (2, 1, None, False), (2, 9, None, False)],
                                    "b long, e long, exact_ns long, sampled boolean")
    children = spark.createDataFrame([(1, 0, 0, 3, None), (1, 0, 1, 1, 7), (1, 1, 0, 1, None), (1, 2, 0, 1, None), (1, 2, 1, 1, None), (1, 3, 0, 5, 77), (1, 3, 1, 5, None),
                                      (2, 0, 0, 1, None), (2, 1, 0, 1, None)], "b long, e long, d long, n long, exact_ns long")
    outer, inner = gpu.allocate_levels(roots, parents, children, root_key=["b"], parent_key=["b", "e"], total="total", weight="n")
    assert sorted(map(tuple, outer.collect()), key=str) == sorted([(1, 0, 400), (1, 1, 200), (1, 2, 400), (1, 3, None), (2, 0, 50), (2, 1, 0), (2, 9, 0)], key=str)
    got = {(r.b, r.e, r.d): r.allocated_ns for r in inner.collect()}
    assert got == {(1, 0, 0): 300, (1, 0, 1): 100, (1, 1, 0): 200, (1, 2, 0): 200, (1, 2, 1): 200, (1, 3, 0): 77, (1, 3, 1): 0, (2, 0, 0): 50, (2, 1, 0): 0}
