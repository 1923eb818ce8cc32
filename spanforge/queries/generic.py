"""Generic operators over the events table as a plain log."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import gpu, pairing, sequences, stab
from spanforge.operators.scan import chunk_of
from spanforge.queries.registry import query
from spanforge.queries.views import EV, HOUR_US, ev, with_sql

CELL = 8 * HOUR_US
TAIL = 2 * HOUR_US


def _typ(name):
    return F.col("typ") == name


# click -> view intervals per user and lane (a recycled key)
_PAIRS = EV + """,
 ends AS (SELECT v.*, (SELECT max(x.event_ord) FROM ev x WHERE x.session_key=v.session_key AND x.k%5=v.k%5
     AND x.typ IN ('click','view') AND x.event_ord<v.event_ord) AS prev FROM ev v WHERE v.typ='view'),
 pairs AS (SELECT e.session_key, e.k%5 AS lane, b.event_ord AS enter_ord, e.event_ord AS ret_ord, b.t AS t_in, e.t AS t_out, b.k
   FROM ends e JOIN ev b ON b.event_ord=e.prev AND b.typ='click')"""


def _pairs(spark, sf):
    e = ev(spark, sf).withColumn("lane", F.col("k") % 5)
    p = pairing.pair_intervals(e, keys=["session_key", "lane"], order="event_ord", begin=_typ("click"), end=_typ("view"),
                               carry={"t_in": F.col("t"), "enter_ord": F.col("event_ord"), "k_in": F.col("k")},
                               chunk=chunk_of())
    return p.select("session_key", "lane", "enter_ord", F.col("event_ord").alias("ret_ord"), "t_in",
                    F.col("t").alias("t_out"), F.col("k_in").alias("k"))


def _purchases(spark, sf):
    return ev(spark, sf).where(F.col("typ") == "purchase").select("session_key", "event_ord", "t", "cents")


@query("c1_pair_intervals", with_sql(_PAIRS, "SELECT * FROM pairs"))
def c1_pair_intervals(spark, sf):
    return _pairs(spark, sf)


@query("c8_queue_depth", with_sql(EV, """
  SELECT session_key, k%2 AS queue, event_ord,
    CAST(sum(CASE WHEN typ='click' THEN 1 ELSE -1 END) OVER (PARTITION BY session_key, k%2 ORDER BY event_ord) AS BIGINT) AS depth
  FROM ev WHERE typ IN ('click','view')"""))
def c8_queue_depth(spark, sf):
    e = ev(spark, sf).withColumn("queue", F.col("k") % 2)
    return gpu.queue_depth(e, keys=["session_key", "queue"], order="event_ord", commit=_typ("click"), done=_typ("view"),
                           chunk=chunk_of()).select("session_key", "queue", "event_ord", "depth")


@query("c10_live_allocations", with_sql(EV + """,
  r AS (SELECT *, lag(typ) OVER w AS pt, lag(cents) OVER w AS pc FROM ev WHERE typ IN ('click','view')
        WINDOW w AS (PARTITION BY session_key, k%6 ORDER BY event_ord))""", """
  SELECT session_key, event_ord,
   CAST(sum((typ='click')::INT - coalesce(pt='click', false)::INT) OVER w AS BIGINT) AS live_count,
   CAST(sum(CASE WHEN typ='click' THEN cents ELSE 0 END - CASE WHEN pt='click' THEN pc ELSE 0 END) OVER w AS BIGINT) AS live_bytes
  FROM r WINDOW w AS (PARTITION BY session_key ORDER BY event_ord)"""))
def c10_live_allocations(spark, sf):
    e = ev(spark, sf).withColumn("obj", F.col("k") % 6)
    return pairing.live_allocations(e, keys=["session_key"], ident="obj", order="event_ord", alloc=_typ("click"), free=_typ("view"),
                                    size=F.col("cents"), chunk=chunk_of()).select(
        "session_key", "event_ord", "live_count", "live_bytes")


def _stab_sql(pick: str) -> str:
    return with_sql(_PAIRS, f"""
  SELECT p.session_key, p.event_ord, p.cents, {pick} AS enter_ord
  FROM (SELECT * FROM ev WHERE typ='purchase') p LEFT JOIN pairs w
    ON w.session_key=p.session_key AND p.t BETWEEN w.t_in AND w.t_out GROUP BY 1, 2, 3""")


@query("d1_stab_earliest", _stab_sql("arg_min(w.enter_ord, (w.t_in, w.ret_ord))"))
def d1_stab_earliest(spark, sf):
    out = stab.stab_join(_purchases(spark, sf), _pairs(spark, sf), by=["session_key"], ts="t", lo="t_in", hi="t_out",
                         prefer=F.struct(-F.col("t_in"), -F.col("ret_ord")), keep=["enter_ord"], cell=CELL)
    return out.select("session_key", "event_ord", "cents", F.col("win.enter_ord").alias("enter_ord"))


@query("d2_stab_latest_filtered", with_sql(_PAIRS, """
  SELECT p.session_key, p.event_ord, arg_max(w.enter_ord, (w.t_in, w.ret_ord)) AS enter_ord
  FROM (SELECT * FROM ev WHERE typ='purchase') p LEFT JOIN pairs w
    ON w.session_key=p.session_key AND p.t BETWEEN w.t_in AND w.t_out AND w.k%3=0 GROUP BY 1, 2"""))
def d2_stab_latest_filtered(spark, sf):
    framed = _pairs(spark, sf).where(F.col("k") % 3 == 0)
    out = stab.stab_join(_purchases(spark, sf), framed, by=["session_key"], ts="t", lo="t_in", hi="t_out",
                         prefer=F.struct("t_in", "ret_ord"), keep=["enter_ord"], cell=CELL)
    return out.select("session_key", "event_ord", F.col("win.enter_ord").alias("enter_ord"))


def innermost(spark, sf):
    """Purchases with the innermost open interval, tail included."""
    w = _pairs(spark, sf).withColumn("t_end", F.col("t_out") + TAIL)
    return stab.stab_join(_purchases(spark, sf), w, by=["session_key"], ts="t", lo="t_in", hi="t_end",
                          prefer=F.struct("t_in", "enter_ord"), keep=["enter_ord", "k"], cell=CELL)


@query("d3_innermost_interval", with_sql(_PAIRS, f"""
  SELECT p.session_key, p.event_ord, arg_max(w.enter_ord, (w.t_in, w.enter_ord)) AS enter_ord
  FROM (SELECT * FROM ev WHERE typ='purchase') p LEFT JOIN pairs w
    ON w.session_key=p.session_key AND p.t BETWEEN w.t_in AND w.t_out + {TAIL} GROUP BY 1, 2"""))
def d3_innermost_interval(spark, sf):
    return innermost(spark, sf).select("session_key", "event_ord", F.col("win.enter_ord").alias("enter_ord"))


@query("d4_fallback_chain", with_sql(_PAIRS + f""",
   a AS (SELECT p.event_ord, arg_min(w.enter_ord, (w.t_in, w.ret_ord)) AS first_ord FROM ev p JOIN pairs w
     ON w.session_key=p.session_key AND p.t BETWEEN w.t_in AND w.t_out AND w.k%2=0 WHERE p.typ='purchase' GROUP BY 1),
   b AS (SELECT p.event_ord, arg_max(w.enter_ord, (w.t_in, w.enter_ord)) AS inner_ord FROM ev p JOIN pairs w
     ON w.session_key=p.session_key AND p.t BETWEEN w.t_in AND w.t_out + {TAIL} AND w.k%2=1 WHERE p.typ='purchase' GROUP BY 1)""", """
  SELECT p.session_key, p.event_ord, coalesce('eval:' || a.first_ord, 'scope:' || b.inner_ord, '<unscoped>') AS origin
  FROM ev p LEFT JOIN a USING (event_ord) LEFT JOIN b USING (event_ord) WHERE p.typ='purchase'"""))
def d4_fallback_chain(spark, sf):
    w = _pairs(spark, sf)
    even = w.where(F.col("k") % 2 == 0).select("session_key", F.lit(1).alias("rank"), (-F.col("t_in")).alias("p1"),
                                              (-F.col("ret_ord")).alias("p2"), "t_in", F.col("t_out").alias("t_end"), "enter_ord")
    odd = w.where(F.col("k") % 2 == 1).select("session_key", F.lit(0).alias("rank"), F.col("t_in").alias("p1"),
                                             F.col("enter_ord").alias("p2"), "t_in", (F.col("t_out") + TAIL).alias("t_end"), "enter_ord")
    out = stab.stab_join(_purchases(spark, sf), even.unionByName(odd), by=["session_key"], ts="t", lo="t_in", hi="t_end",
                         prefer=F.struct("rank", "p1", "p2"), keep=["rank", "enter_ord"], cell=CELL)
    return out.select("session_key", "event_ord", F.coalesce(
        F.concat(F.when(F.col("win.rank") == 1, "eval:").otherwise("scope:"), F.col("win.enter_ord").cast("string")),
        F.lit("<unscoped>")).alias("origin"))


@query("flagship_innermost_cents", with_sql(_PAIRS + f""",
   h AS (SELECT p.event_ord, p.cents, arg_max(w.k, (w.t_in, w.enter_ord)) AS k FROM ev p LEFT JOIN pairs w
     ON w.session_key=p.session_key AND p.t BETWEEN w.t_in AND w.t_out + {TAIL} WHERE p.typ='purchase' GROUP BY 1, 2)""", """
  SELECT coalesce('scope' || (k%20), '<unscoped>') AS label, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n
  FROM h GROUP BY 1 ORDER BY cents DESC, label LIMIT 20"""))
def flagship(spark, sf):
    """Purchase cents by the innermost interval they fall into, top 20."""
    label = F.coalesce(F.concat(F.lit("scope"), (F.col("win.k") % 20).cast("string")), F.lit("<unscoped>"))
    return (innermost(spark, sf).groupBy(label.alias("label"))
            .agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("cents").desc(), "label").limit(20))


@query("e9_interval_samples", with_sql(_PAIRS, f"""
  SELECT w.session_key, w.enter_ord, w.ret_ord, max(p.cents) AS peak, CAST(sum(p.cents) // count(*) AS BIGINT) AS avg,
    arg_max(p.cents, p.event_ord) AS last, count(*) AS n
  FROM pairs w JOIN ev p ON p.session_key=w.session_key AND p.typ='purchase' AND p.event_ord>w.enter_ord
    AND p.t<=w.t_out + {TAIL} GROUP BY 1, 2, 3"""))
def e9_interval_samples(spark, sf):
    w = _pairs(spark, sf).withColumn("t_end", F.col("t_out") + TAIL)
    c = F.col("cents")
    out = stab.interval_aggregate(
        w, _purchases(spark, sf), by=["session_key"], interval_key=["enter_ord", "ret_ord"], lo="t_in", hi="t_end", ts="t",
        after=("enter_ord", "event_ord"), cell=CELL,
        aggs={"peak": ("max", c), "total": ("sum", c), "n": ("sum", F.lit(1).cast("bigint")),
              "l": ("max", F.struct("event_ord", "cents"))})
    return out.select("session_key", "enter_ord", "ret_ord", "peak", F.call_function("div", F.col("total"), F.col("n")).alias("avg"),
                      F.col("l.cents").alias("last"), "n")


@query("f1_islands", with_sql(EV + f""",
   q AS (SELECT *, lag(t) OVER (PARTITION BY session_key ORDER BY event_ord) AS p FROM ev WHERE cents>=2000),
   g AS (SELECT *, sum(CASE WHEN p IS NULL OR t-p>{12 * HOUR_US} THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY event_ord) AS isl FROM q)""", """
  SELECT session_key, CAST(isl AS BIGINT) AS island, min(t) AS t0, max(t) AS t1, max(cents) AS peak, count(*) AS n,
    arg_max(event_ord, (cents, -event_ord)) AS peak_ord FROM g GROUP BY 1, 2"""))
def f1_islands(spark, sf):
    return sequences.islands(
        ev(spark, sf), keys=["session_key"], order="event_ord", ts="t", keep=F.col("cents") >= 2000, gap=12 * HOUR_US,
        chunk=chunk_of(), aggs=[F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("cents").alias("peak"),
                                F.count(F.lit(1)).alias("n"),
                                F.max_by("event_ord", F.struct("cents", -F.col("event_ord"))).alias("peak_ord")])


_SEQ = "event_ord + (k * 7919) % 5 * 3 + CASE WHEN typ='error' THEN 40 ELSE 0 END"


@query("f3_sequence_gaps", with_sql(EV + f""",
   s AS (SELECT session_key, event_ord, {_SEQ} AS seq FROM ev),
   m AS (SELECT *, max(seq) OVER (PARTITION BY session_key ORDER BY event_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM s)""", """
  SELECT session_key, event_ord, mx+1 AS expected, seq AS got FROM m WHERE seq>mx+1"""))
def f3_sequence_gaps(spark, sf):
    e = ev(spark, sf).withColumn("seq", F.expr(_SEQ))
    return sequences.sequence_gaps(e, keys=["session_key"], order="event_ord", seq="seq", chunk=chunk_of())


@query("f5_counter_rate", with_sql(EV + """,
   s AS (SELECT session_key, event_ord, t, cents, lag(t) OVER w AS pt, lag(cents) OVER w AS pc FROM ev WHERE typ='purchase'
         WINDOW w AS (PARTITION BY session_key ORDER BY event_ord))""", f"""
  SELECT session_key, event_ord, round(CASE WHEN pt IS NULL OR t<=pt THEN 0.0
    ELSE greatest(0, cents-pc)::DOUBLE / ((t-pt)::DOUBLE / {float(HOUR_US)}) END, 6) AS rate FROM s"""))
def f5_counter_rate(spark, sf):
    return sequences.counter_rate(_purchases(spark, sf), keys=["session_key"], order="event_ord", ts="t", counter="cents",
                                  per=HOUR_US, chunk=chunk_of()).select("session_key", "event_ord", F.round("rate", 6).alias("rate"))


@query("f6_changes_only", with_sql(EV + """,
   s AS (SELECT session_key, event_ord, typ, lag(typ) OVER (PARTITION BY session_key ORDER BY event_ord) AS p FROM ev)""",
                                   "SELECT session_key, event_ord, typ FROM s WHERE p IS DISTINCT FROM typ"))
def f6_changes_only(spark, sf):
    return sequences.changes_only(ev(spark, sf), keys=["session_key"], order="event_ord", value="typ",
                                  chunk=chunk_of()).select("session_key", "event_ord", "typ")


@query("f7_cumulative_counter", with_sql(EV, """
  SELECT session_key, k%4 AS model, event_ord, CAST(sum(cents) OVER (PARTITION BY session_key, k%4 ORDER BY t, event_ord) AS BIGINT) AS bytes
  FROM ev WHERE typ='signup'"""))
def f7_cumulative_counter(spark, sf):
    e = ev(spark, sf).where(F.col("typ") == "signup").withColumn("model", F.col("k") % 4)
    return sequences.cumulative(e, keys=["session_key", "model"], order=["t", "event_ord"], value="cents", name="bytes").select("session_key", "model", "event_ord", "bytes")


@query("f8_stacked_bands", with_sql(EV + """,
   l AS (SELECT session_key, k%3 AS band, t, event_ord, cents FROM ev WHERE typ='click'),
   z AS (SELECT session_key, band, arg_max(cents, event_ord) AS lastsize FROM l GROUP BY 1, 2),
   u AS (SELECT e.session_key, e.k%3 AS band, e.t, e.event_ord, -coalesce(z.lastsize, 0) AS d FROM ev e
         LEFT JOIN z ON z.session_key=e.session_key AND z.band=e.k%3 WHERE e.typ='view'),
   a AS (SELECT session_key, band, t, event_ord, 0 AS side, cents AS d FROM l UNION ALL SELECT session_key, band, t, event_ord, 1, d FROM u),
   t0 AS (SELECT session_key, min(t) AS t0 FROM a GROUP BY 1)""", """
  SELECT a.session_key, a.band, a.event_ord, a.t-t0.t0 AS t_rel, CAST(greatest(0, sum(d) OVER (PARTITION BY a.session_key, a.band ORDER BY a.t, side, a.event_ord)) AS BIGINT) AS bytes
  FROM a JOIN t0 USING (session_key)"""))
def f8_stacked_bands(spark, sf):
    e = ev(spark, sf).withColumn("band", F.col("k") % 3)
    return sequences.stacked_bands(e.where(_typ("click")), e.where(_typ("view")), keys=["session_key"], band="band", ts="t", order="event_ord", size="cents")


@query("f9_saturating_depth", with_sql(EV + """,
   n AS (SELECT session_key, event_ord, CASE WHEN typ='click' THEN 1 ELSE -1 END AS d,
           row_number() OVER (PARTITION BY session_key ORDER BY event_ord) AS i FROM ev WHERE typ IN ('click','view')),
   walk AS (SELECT session_key, event_ord, i, greatest(0, d) AS depth FROM n WHERE i=1
            UNION ALL SELECT n.session_key, n.event_ord, n.i, greatest(0, w.depth+n.d) FROM walk w JOIN n ON n.session_key=w.session_key AND n.i=w.i+1)""",
    "SELECT session_key, event_ord, CAST(depth AS BIGINT) AS depth FROM walk"))
def f9_saturating_depth(spark, sf):
    return sequences.saturating_depth(ev(spark, sf), keys=["session_key"], order="event_ord", up=_typ("click"), down=_typ("view"),
                                      chunk=chunk_of()).select("session_key", "event_ord", "depth")


@query("f10_rises", with_sql(EV + """,
   s AS (SELECT session_key, arg_min(cents, event_ord) AS first_value, arg_max(cents, event_ord) AS last_value FROM ev WHERE typ='purchase' GROUP BY 1)""",
    "SELECT * FROM s WHERE first_value<>0 AND last_value>=first_value*2.0"))
def f10_rises(spark, sf):
    return sequences.rises(_purchases(spark, sf), keys=["session_key"], order="event_ord", value="cents")


@query("f11_last_before_anchor", with_sql(EV + """,
   a AS (SELECT session_key, arg_min(t, event_ord) AS at FROM ev WHERE typ='error' AND k%10=0 GROUP BY 1),
   r AS (SELECT e.session_key, e.event_ord, row_number() OVER (PARTITION BY e.session_key ORDER BY e.t DESC, e.event_ord DESC) AS rank
         FROM ev e JOIN a ON a.session_key=e.session_key AND e.t<=a.at WHERE e.typ='view')""",
    "SELECT session_key, event_ord, rank FROM r WHERE rank<=5"))
def f11_last_before_anchor(spark, sf):
    e = ev(spark, sf)
    a = e.where((F.col("typ") == "error") & (F.col("k") % 10 == 0)).groupBy("session_key").agg(F.min_by("t", "event_ord").alias("at"))
    return sequences.last_before(e.where(_typ("view")), a, keys=["session_key"], ts="t", anchor="at", order="event_ord").select(
        "session_key", "event_ord", F.col("rank").cast("bigint").alias("rank"))


@query("f12_entered_by_last_seen", with_sql(EV, """
  SELECT v.session_key, v.event_ord, CASE WHEN b.k%5=v.k%5 THEN b.t END AS entered FROM ev v
  LEFT JOIN ev b ON b.event_ord=(SELECT max(x.event_ord) FROM ev x WHERE x.session_key=v.session_key AND x.typ='click' AND x.event_ord<v.event_ord)
  WHERE v.typ='view'"""))
def f12_entered_by_last_seen(spark, sf):
    e = ev(spark, sf).withColumn("call", F.col("k") % 5)
    return sequences.entered_by_last_seen(e, keys=["session_key"], order="event_ord", ident="call", begin=_typ("click"), end=_typ("view"),
                                          value=F.col("t"), chunk=chunk_of()).select("session_key", "event_ord", "entered")


@query("f13_first_max", with_sql(EV + """,
   r AS (SELECT *, row_number() OVER (PARTITION BY session_key, typ ORDER BY k DESC, event_ord) AS rn FROM ev)""",
    "SELECT session_key, typ, event_ord, k FROM r WHERE rn=1"))
def f13_first_max(spark, sf):
    return sequences.first_max(ev(spark, sf), keys=["session_key", "typ"], metric="k", order="event_ord").select(
        "session_key", "typ", "event_ord", "k")


@query("f14_overdue_lifetimes", with_sql(_PAIRS, f"""
  SELECT session_key, enter_ord, CAST(ceil((t_in + {5 * HOUR_US})::DOUBLE / {HOUR_US}) AS BIGINT) * {HOUR_US} AS warn_at FROM pairs
  WHERE CAST(ceil((t_in + {5 * HOUR_US})::DOUBLE / {HOUR_US}) AS BIGINT) * {HOUR_US} <= t_out"""))
def f14_overdue_lifetimes(spark, sf):
    return sequences.overdue(_pairs(spark, sf), begin="t_in", end="t_out", now=F.lit(1 << 60), limit=5 * HOUR_US,
                             tick=HOUR_US).select("session_key", "enter_ord", "warn_at")


@query("f15_ema", with_sql(EV + """,
   n AS (SELECT session_key, cents::DOUBLE AS v, row_number() OVER (PARTITION BY session_key ORDER BY event_ord) AS i FROM ev WHERE typ='purchase'),
   walk AS (SELECT session_key, i, v AS e FROM n WHERE i=1
            UNION ALL SELECT n.session_key, n.i, w.e*0.8 + n.v*0.2 FROM walk w JOIN n ON n.session_key=w.session_key AND n.i=w.i+1)""",
    "SELECT session_key, round(arg_max(e, i), 4) AS ema FROM walk GROUP BY 1"))
def f15_ema(spark, sf):
    return sequences.ema(_purchases(spark, sf), keys=["session_key"], order="event_ord", value="cents").select(
        "session_key", F.round("ema", 4).alias("ema"))


@query("e18_nearest_rank", with_sql(EV + """,
   r AS (SELECT session_key, cents, row_number() OVER (PARTITION BY session_key ORDER BY cents) - 1 AS i, count(*) OVER (PARTITION BY session_key) AS n FROM ev WHERE typ='view')""", """
  SELECT session_key, max(CASE WHEN i=floor((n-1)*0.5+0.5) THEN cents END) AS p50, max(CASE WHEN i=floor((n-1)*0.95::DOUBLE+0.5) THEN cents END) AS p95,
    max(cents) AS max_value, max(n) AS n FROM r GROUP BY 1"""))
def e18_nearest_rank(spark, sf):
    return sequences.nearest_rank(ev(spark, sf).where(_typ("view")), keys=["session_key"], value="cents",
                                  probs={"p50": 0.5, "p95": 0.95})


@query("g8_slowest", with_sql(EV + """,
   r AS (SELECT session_key, event_ord, cents, row_number() OVER (PARTITION BY session_key ORDER BY cents DESC, event_ord DESC) AS rank FROM ev WHERE typ='view')""",
    "SELECT * FROM r WHERE rank<=5"))
def g8_slowest(spark, sf):
    return sequences.slowest(ev(spark, sf).where(_typ("view")), keys=["session_key"], metric="cents", order="event_ord").select(
        "session_key", "event_ord", "cents", F.col("rank").cast("bigint").alias("rank"))


@query("e19_top_per_tick", with_sql(EV + f""",
   r AS (SELECT t // {24 * HOUR_US} AS tick, event_ord, k, row_number() OVER (PARTITION BY t // {24 * HOUR_US} ORDER BY k DESC, event_ord) AS rank FROM ev)""",
    "SELECT * FROM r WHERE rank<=10"))
def e19_top_per_tick(spark, sf):
    e = ev(spark, sf).withColumn("tick", F.call_function("div", F.col("t"), F.lit(24 * HOUR_US)))
    top, _ = sequences.top_and_flagged(e, keys=["tick"], cpu="k", name="typ", order="event_ord")
    return top.select("tick", "event_ord", "k", F.col("rank").cast("bigint").alias("rank"))


@query("e19_flagged_per_tick", with_sql(EV, f"""
  SELECT t // {24 * HOUR_US} AS tick, event_ord, typ FROM ev WHERE typ IN ('error','signup') AND k>90"""))
def e19_flagged_per_tick(spark, sf):
    e = ev(spark, sf).withColumn("tick", F.call_function("div", F.col("t"), F.lit(24 * HOUR_US)))
    _, flagged = sequences.top_and_flagged(e, keys=["tick"], cpu="k", name="typ", order="event_ord",
                                           flagged_names=("error", "signup"), threshold=90)
    return flagged
