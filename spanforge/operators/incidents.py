"""Correlation around focal events and trailing windows before incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanforge.operators.filters import incident_label, is_notable
from spanforge.operators.scan import chunk_of, ranked, with_running
from spanforge.schema import NS_PER_SEC

DEFAULT_BAND_NS = 200_000_000


def _neighbour_cells(ts: Column, width: int) -> Column:
    c = F.call_function("div", ts, F.lit(width))
    return F.array(c - 1, c, c + 1)


def correlations(events: DataFrame, focal: DataFrame, *, window_ns: int = DEFAULT_BAND_NS,
                 max_events: int = 50) -> DataFrame:
    """Events of other sources near each focal event, notable and close ones first.

    ``focal`` holds (session_key, focal_seq).  Rows past ``max_events`` are left
    to :func:`elided`; the rank limit is applied before the shuffle.
    """
    w = Window.partitionBy("session_key", "focal_seq").orderBy("_routine", "distance_ns", "event_ord")
    return (_in_band(events, focal, window_ns)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_events).drop("_routine"))


def _in_band(events, focal, window_ns):
    f = (events.select("session_key", F.col("seq").alias("focal_seq"), F.col("ts_mono_ns").alias("_fts"),
                       F.col("source").alias("_fsrc"))
         .join(focal.select("session_key", "focal_seq"), ["session_key", "focal_seq"])
         .withColumn("_cell", F.explode(_neighbour_cells(F.col("_fts"), window_ns))))
    rows = events.select("session_key", "event_ord", "seq", "ts_mono_ns", "source", "kind", "error_code",
                         F.call_function("div", F.col("ts_mono_ns"), F.lit(window_ns)).alias("_cell"))
    near = rows.join(f, ["session_key", "_cell"]).where(
        F.col("ts_mono_ns").between(F.col("_fts") - window_ns, F.col("_fts") + window_ns)
        & (F.col("seq") != F.col("focal_seq")) & (F.col("source") != F.col("_fsrc")))
    return near.withColumns({"_routine": ~is_notable(), "distance_ns": F.abs(F.col("ts_mono_ns") - F.col("_fts"))}
                            ).drop("_cell", "_fts", "_fsrc")


def elided(events: DataFrame, focal: DataFrame, *, window_ns: int = DEFAULT_BAND_NS,
           max_events: int = 50) -> DataFrame:
    """How many events of each kind fell past the cap: all in the band minus those shown."""
    keys = ["session_key", "focal_seq", "kind"]
    every = _in_band(events, focal, window_ns).groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    shown = correlations(events, focal, window_ns=window_ns, max_events=max_events).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_shown"))
    out = every.join(shown, keys, "left").withColumn(
        "elided", F.col("_all") - F.coalesce("_shown", F.lit(0)))
    return out.where(F.col("elided") > 0).select(*keys, "elided")


def incidents(events: DataFrame, *, host: str | None) -> DataFrame:
    """Events that trigger the recorder; ``host`` as in :func:`recorder`."""
    return events.withColumn("incident_label", incident_label()).where(
        F.col("incident_label").isNotNull()).select(
        F.concat_ws("-", "session_key", F.col("event_ord").cast("string")).alias("incident_key"),
        "session_key", *([host] if host else []), "event_ord", "incident_label",
        F.col("ts_wall_ns").alias("incident_ts"))


def recorder(events: DataFrame, triggers: DataFrame, *, host: str | None, window_ns: int = 60 * NS_PER_SEC,
             chunk_rows: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """What a recorder per host holds at each incident, as ranges of one order of its events.

    A recorder serves one host, whose sessions share the column ``host``; None says that all
    events are of one host.  Wall time decides, because monotonic clocks of different
    sessions do not compare.

    Returns the events that lie in the window before any incident, each once, with their
    position among the host's events, and the incidents with the ``first`` and ``last``
    position of their window.  So the result grows with the events and the incidents, not
    with their product.  Events and window ends enter one order, so a burst of events or of
    incidents is spread like any other rows.
    """
    if host is not None and not (host in events.columns and host in triggers.columns):
        raise ValueError(f"events and incidents need the column {host!r}, or host=None for a single host")
    place = F.col(host) if host else F.lit("")
    row = F.struct(*events.columns)
    inc = F.struct("incident_key", "incident_label", "incident_ts")
    # a window's start comes before the events of its instant, its end after them
    ends = triggers.select(place.alias("_host"), inc.alias("_inc"), F.explode(F.array(
        F.struct((F.col("incident_ts") - window_ns).alias("t"), F.lit(0).alias("side")),
        F.struct(F.col("incident_ts").alias("t"), F.lit(2).alias("side")))).alias("e"))
    ends = ends.select("_host", F.col("e.t").alias("_t"), F.col("e.side").alias("_side"), F.col("_inc.incident_key").alias("_session"),
                       F.lit(0).cast("bigint").alias("_ord"), F.lit(None).cast(events.select(row.alias("r")).schema["r"].dataType).alias("_event"), "_inc")
    rows = events.select(place.alias("_host"), F.col("ts_wall_ns").alias("_t"), F.lit(1).alias("_side"), F.col("session_key").alias("_session"),
                         F.col("event_ord").alias("_ord"), row.alias("_event"), F.lit(None).cast(ends.schema["_inc"].dataType).alias("_inc"))
    both = ranked(rows.unionByName(ends), ["_host"], ["_t", "_side", "_session", "_ord"], "_pos")
    side = F.col("_side")
    both = with_running(both, ["_host"], ["_pos"], {
        "position": ("count", F.when(side == 1, 1)), "_opened": ("count", F.when(side == 0, 1)), "_closed": ("count", F.when(side == 2, 1))},
        chunk=chunk_of("_pos", chunk_rows))
    kept = both.where((side == 1) & (F.col("_opened") > F.col("_closed"))).select("_event.*", "position")
    ranges = both.where(side != 1).groupBy("_host", "_inc").agg(
        (F.max(F.when(side == 0, F.col("position"))) + 1).alias("first"), F.max(F.when(side == 2, F.col("position"))).alias("last"))
    return kept, ranges.select(*([F.col("_host").alias(host)] if host else []), "_inc.*", "first", "last")


def trailing_window(events: DataFrame, triggers: DataFrame, *, host: str | None, window_ns: int = 60 * NS_PER_SEC) -> DataFrame:
    """For each incident, every event of any session of its host in the time window up to it.

    One row per incident and event; :func:`recorder` holds the same without the repeats.
    """
    kept, ranges = recorder(events, triggers, host=host, window_ns=window_ns)
    return events_of(kept, ranges, host=host)


def events_of(kept: DataFrame, ranges: DataFrame, *, host: str | None, cell: int = 4096) -> DataFrame:
    """The events of each given range; positions are cut into cells, so that only a range's own cells are met."""
    keys = [host] if host else []
    cells = F.sequence(F.call_function("div", F.col("first"), F.lit(cell)), F.call_function("div", F.col("last"), F.lit(cell)))
    wanted = ranges.where(F.col("first") <= F.col("last")).withColumn("_cell", F.explode(cells))
    rows = kept.withColumn("_cell", F.call_function("div", F.col("position"), F.lit(cell)))
    return rows.join(wanted, [*keys, "_cell"]).where(F.col("position").between(F.col("first"), F.col("last"))).drop("_cell", "first", "last")
