"""Live operators that need state of their own.

Each processor gets the rows of one key in a micro-batch, one by one, and carries a small,
bounded state to the next.  They give the same rows as the batch operators over the same
log.  Where only the latest row of something counts, rows are folded as they come, by log
position.  Where the order itself counts, a key's batch is held and sorted; a feed bounds
it by the files it takes at once.  A batch may have few rows for each of very many keys, so
what a key costs by itself counts: no frame is made for it, and its state, which is asked
across a socket, is read and written once for each entry that the batch touches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanforge.schema import NS_PER_SEC

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _skips(rows: list[tuple], top: int | None) -> Iterator[tuple[tuple, int | None, int | None]]:
    """Rows (event_ord, seq, ...) in log order, each with the largest number before it if it skips ahead of that, and up to it."""
    for row in sorted(rows, key=itemgetter(0)):
        seq, before = row[1], None
        if seq is not None:
            before = top if top is not None and seq > top + 1 else None
            top = seq if top is None else max(top, seq)
        yield row, before, top


class _Gaps(StatefulProcessor):
    OUT = Row("session_key", "event_ord", "expected", "got")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("max_seq", "seq bigint")

    def handleInputRows(self, key, rows, timerValues):
        held = self.top.get()
        top = None
        for row, before, top in _skips([tuple(r)[1:] for r in rows], held[0] if held else None):
            yield from self._out(key[0], row, before)
        if top is not None:
            self.top.update((top,))

    def _out(self, session, row, before):
        if before is not None:
            yield self.OUT(session, row[0], before + 1, row[1])

    def close(self) -> None:
        pass


def sequence_gaps(events: DataFrame) -> DataFrame:
    """Gaps in the sequence numbers of each session."""
    return events.select("session_key", "event_ord", "seq").groupBy("session_key").transformWithState(
        _Gaps(), "session_key string, event_ord bigint, expected bigint, got bigint", "Append", "None")


class _Feed(_Gaps):
    """Event lines, and a marker line before each one that skips ahead."""

    OUT = Row("session_key", "event_ord", "side", "line")

    def _out(self, session, row, before):
        ord_, seq, line = row
        if before is not None:
            yield self.OUT(session, ord_, 0, gap_line(session, before + 1, seq))
        yield self.OUT(session, ord_, 1, line)


def gap_line(session_key: str, expected: int, got: int) -> str:
    """The marker for lost events, as ``sinks.files.change_feed`` writes it."""
    return json.dumps({"gap": True, "session_key": session_key, "expected": expected, "got": got, "skipped": got - expected},
                      separators=(",", ":"), ensure_ascii=False)


def change_feed(events: DataFrame) -> DataFrame:
    """Lines of a feed in log order (event_ord, side): a marker, side 0, comes before the event that skips ahead."""
    from spanforge.sinks.files import event_json

    lines = event_json(events.withColumn("_seq", F.col("seq")), keep=["_seq"]).select("session_key", "event_ord", F.col("_seq").alias("seq"), F.col("json").alias("line"))
    return lines.groupBy("session_key").transformWithState(
        _Feed(), "session_key string, event_ord bigint, side int, line string", "Append", "None")


_COMMIT, _SCHED, _DONE, _OPS = range(4)


class _Held:
    """A map state, long to long, of one key for one batch: an entry is read once at most, and written once at the end."""

    def __init__(self, state):
        self.state, self.before, self.now = state, {}, {}

    def get(self, k):
        if k not in self.now:
            value = self.state.getValue((k,)) if self.state.containsKey((k,)) else None
            self.before[k] = self.now[k] = value[0] if value else None
        return self.now[k]

    def put(self, k, value) -> None:
        self.now[k] = value

    def write(self) -> None:
        for k, value in self.now.items():
            if value is None:
                # one that came and went within the batch may be in the state from earlier on
                if self.before[k] is not None if k in self.before else self.state.containsKey((k,)):
                    self.state.removeKey((k,))
            elif k not in self.before or self.before[k] != value:
                self.state.updateValue((k,), (value,))


class _Clamp(StatefulProcessor):
    """Schedule times and windows by buffer, last completion by queue."""

    OUT = Row("session_key", "event_ord", "ts_mono_ns", "event_us", "cb_id", "scale", "ops")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sched = handle.getMapState("sched", "cb bigint", "ts bigint")
        self.window = handle.getMapState("window", "cb bigint", "ns bigint")
        self.done = handle.getMapState("done", "queue bigint", "ts bigint")

    def handleInputRows(self, key, rows, timerValues):
        sched, windows, done = states = _Held(self.sched), _Held(self.window), _Held(self.done)
        batch = sorted((tuple(r)[1:] for r in rows), key=itemgetter(0))
        for ord_, ts, at, step, cb, queue, raw, ops in batch:
            if step == _SCHED:
                sched.put(cb, ts)
            elif step == _DONE:
                start = sched.get(cb)
                sched.put(cb, None)
                if start is None:
                    windows.put(cb, None)
                else:
                    last = done.get(queue)
                    windows.put(cb, max(0, ts - (start if last is None else max(start, last))))
                done.put(queue, ts)
            else:
                window = windows.get(cb)
                windows.put(cb, None)
                yield self.OUT(key[0], ord_, ts, at, cb, window / raw if window is not None and raw > window else None, ops)
        for state in states:
            state.write()

    def close(self) -> None:
        pass


def op_scales(events: DataFrame) -> DataFrame:
    """Scale of each ops event whose times exceed its buffer's window (null: none needed), and its ops as JSON text."""
    steps = F.create_map(*(F.lit(x) for kv in (("MetalCbScheduled", _SCHED), ("MetalCbCompleted", _DONE), ("MetalCbOps", _OPS)) for x in kv))
    # the time goes through the processor as a number, which it only hands on
    rows = events.where(F.col("kind").isin("MetalCbScheduled", "MetalCbCompleted", "MetalCbOps")).select(
        "session_key", "event_ord", "ts_mono_ns", F.unix_micros("event_time").alias("event_us"), steps[F.col("kind")].alias("step"), "cb_id", F.coalesce("queue_id", F.lit(0)).alias("queue_id"),
        F.coalesce(F.aggregate("ops", F.lit(0).cast("bigint"), lambda a, o: a + o["gpu_ns"]), F.lit(0)).alias("raw_ns"),
        F.to_json(F.transform("ops", lambda o: F.struct(o["name"].alias("name"), o["gpu_ns"].alias("gpu_ns"), o["count"].alias("count")))).alias("ops"))
    scales = rows.groupBy("session_key").transformWithState(
        _Clamp(), "session_key string, event_ord bigint, ts_mono_ns bigint, event_us bigint, cb_id bigint, scale double, ops string",
        "Append", "None")
    return scales.select("session_key", "event_ord", "ts_mono_ns", F.timestamp_micros("event_us").alias("event_time"), "cb_id", "scale", "ops")


class _Rolling(StatefulProcessor):
    """Ops of the last window before the newest ops event, added up per event and name."""

    OUT = Row("session_key", "at_ns", "rank", "name", "gpu_ns", "count")

    def __init__(self, window_ns: int, n: int):
        self.window_ns, self.n = window_ns, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "ts bigint, name string, ns bigint, count bigint")
        self.newest = handle.getValueState("newest", "ts bigint")

    def handleInputRows(self, key, rows, timerValues):
        held = self.newest.get()
        newest = held[0] if held else None
        sums: dict[tuple[int, str], tuple[int, int]] = {}
        room = 1024
        for ts, name, ns, count in chain(self.samples.get() if held else (), (tuple(r)[1:] for r in rows)):
            newest = ts if newest is None or ts > newest else newest
            if ts < newest - self.window_ns:
                continue
            a, b = sums.get((ts, name), (0, 0))
            sums[ts, name] = (a + ns, b + count)
            if len(sums) > room:  # what the window has left behind goes before more is held
                sums = self._within(sums, newest)
                room = 2 * len(sums) + 1024
        sums = self._within(sums, newest)
        self.samples.put([(ts, name, ns, count) for (ts, name), (ns, count) in sums.items()])
        if not held or held[0] != newest:
            self.newest.update((newest,))
        names: dict[str, tuple[int, int]] = {}
        for (_, name), (ns, count) in sums.items():
            a, b = names.get(name, (0, 0))
            names[name] = (a + ns, b + count)
        best = sorted(names.items(), key=lambda e: (-e[1][0], e[0] is not None, e[0] or ""))[:self.n]
        for rank, (name, (ns, count)) in enumerate(best, start=1):
            yield self.OUT(key[0], newest, rank, name, ns, count)

    def _within(self, sums, newest):
        return {k: v for k, v in sums.items() if k[0] >= newest - self.window_ns}

    def close(self) -> None:
        pass


def hot_ops(events: DataFrame, *, window_ns: int = 30 * NS_PER_SEC, top_n: int = 10) -> DataFrame:
    """The ops with most clamped time in the window before each session's newest ops event, after every batch with ops.

    The clamp's output feeds the window inside one stream, so both states come from one checkpoint.
    """
    schema = "array<struct<name:string,gpu_ns:bigint,count:bigint>>"
    ops = op_scales(events).select("session_key", F.col("ts_mono_ns").alias("ts"), "scale", F.explode(F.from_json("ops", schema)).alias("o"))
    ns = F.when(F.col("scale").isNull(), F.col("o.gpu_ns")).otherwise((F.col("o.gpu_ns").cast("double") * F.col("scale")).cast("bigint"))
    return ops.select("session_key", "ts", F.col("o.name").alias("name"), ns.alias("ns"), F.col("o.count").alias("count")).groupBy(
        "session_key").transformWithState(
        _Rolling(window_ns, top_n), "session_key string, at_ns bigint, rank int, name string, gpu_ns bigint, count bigint", "Append", "None")


class _Overdue(StatefulProcessor):
    """A timer per committed buffer; it fires unless the completion comes first."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.commit = handle.getValueState("commit", "ord bigint, ms bigint, queue bigint")

    def handleInputRows(self, key, rows, timerValues):
        batch = np.fromiter(((r["event_ord"], r["commit"], r["ts_wall_ns"], r["queue_id"]) for r in rows), dtype="i8,?,i8,i8")
        open_ = tuple(self.commit.get()) if self.commit.exists() else None
        before = open_
        for o, commit, wall, queue in batch[np.argsort(batch["f0"], kind="stable")].tolist():
            ms = wall // 1_000_000
            if open_ is not None:
                first, since, its_queue = open_
                if ms - since >= self.limit_ms:  # it was overdue before this, whether or not the clock has shown it yet
                    yield Row(session_key=key[0], cb_id=key[1], queue_id=its_queue, commit_ord=first)
            open_ = (o, ms, queue) if commit else None
        # only the buffer that stays open needs state and a timer
        if before is not None:
            self.handle.deleteTimer(before[1] + self.limit_ms)
        if open_ is not None:
            self.commit.update(open_)
            self.handle.registerTimer(open_[1] + self.limit_ms)
        elif before is not None:
            self.commit.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.commit.exists():
            first, _, queue = self.commit.get()
            self.commit.clear()
            yield Row(session_key=key[0], cb_id=key[1], queue_id=queue, commit_ord=first)

    def close(self) -> None:
        pass


def open_too_long(events: DataFrame, *, limit_ns: int = 5 * NS_PER_SEC, delay: str = "1 second") -> DataFrame:
    """Buffers still open ``limit_ns`` after their commit, once each.

    A timer tells of those that the feed's clock shows to be late; one whose end arrives in
    the same batch as the clock is told by its end.
    """
    # the filter names the event time so that it stays above the watermark: every
    # event moves the clock, not only commits and completions
    wanted = F.when(F.col("event_time").isNotNull(), F.col("kind").isin("MetalCbCommitted", "MetalCbCompleted"))
    rows = events.withWatermark("event_time", delay).where(wanted).select(
        "session_key", "cb_id", F.coalesce("queue_id", F.lit(0)).alias("queue_id"), "event_ord", (F.col("kind") == "MetalCbCommitted").alias("commit"), "ts_wall_ns", "event_time")
    return rows.groupBy("session_key", "cb_id").transformWithState(
        _Overdue(limit_ns // 1_000_000), "session_key string, cb_id bigint, queue_id bigint, commit_ord bigint",
        "Append", "EventTime")


class _Queue(StatefulProcessor):
    """A queue's buffers in flight, and an index of them in the order of their commits.

    The index is a queue in pages: commits go to the last page, the oldest is looked for from
    the first one on, and entries of buffers that are no longer in flight by that commit go
    as they are met.  So a batch reads and writes its own pages, not the whole map.
    """

    PAGE = 512

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flying = handle.getMapState("flying", "cb bigint", "ord bigint, ts bigint")
        self.pages = handle.getMapState("pages", "page bigint", "entries string")
        self.last = handle.getValueState(
            "last", "head bigint, tail bigint, n bigint, depth_ord bigint, depth bigint, done_ord bigint, status bigint, error bigint")

    def _page(self, k: int) -> list[list[int]]:
        if k not in self.read:
            self.read[k] = json.loads(self.pages.getValue((k,))[0]) if self.pages.containsKey((k,)) else []
        return self.read[k]

    def _flies(self, cb: int) -> tuple[int, int] | None:
        """(ord, ts) of a buffer's commit, if it is in flight; the state is asked once a batch."""
        if cb not in self.known:
            self.known[cb] = tuple(self.flying.getValue((cb,))) if self.flying.containsKey((cb,)) else None
        return self.known[cb]

    def _oldest(self, head: int, tail: int) -> tuple[int, tuple[int, int] | None]:
        """The first page that still counts, and (ts, cb) of the oldest buffer in flight."""
        for k in range(head, tail + 1):
            entries = self._page(k)
            for i, (ord_, cb, ts) in enumerate(entries):
                if (at := self._flies(cb)) is not None and at[0] == ord_:
                    if i:
                        self.read[k], self.changed = entries[i:], self.changed | {k}
                    return k, (ts, cb)
            if k < tail:
                self.pages.removeKey((k,))
                self.changed -= {k}
            elif entries:
                self.read[k], self.changed = [], self.changed | {k}
        return tail, None

    def handleInputRows(self, key, rows, timerValues):
        is_new = not self.last.exists()
        head, tail, n, depth_ord, depth, done_ord, status, error = (0, 0, 0, -1, 0, -1, None, None) if is_new else self.last.get()
        self.known, self.read, self.changed = {}, {0: []} if is_new else {}, set()
        ends: dict[int, tuple[int, bool, int]] = {}  # of each buffer the latest row of the batch
        seen = -1
        for o, commit, cb, ts, its_depth, its_status, its_error in (tuple(r)[2:] for r in rows):
            if cb is not None and (cb not in ends or o > ends[cb][0]):  # rows without a buffer are of none
                ends[cb] = (o, commit, ts)
            if commit and o > depth_ord:
                depth_ord, depth = o, int(its_depth)
            elif not commit and o > done_ord:
                done_ord, status, error = o, its_status, its_error
            seen = max(seen, o)
        for cb, (o, commit, ts) in sorted(ends.items(), key=lambda e: e[1][0]):
            flies = self._flies(cb) is not None
            if commit:
                self.flying.updateValue((cb,), (o, ts))
                self._page(tail).append([o, cb, ts])
                self.changed.add(tail)
                if len(self._page(tail)) >= self.PAGE:
                    tail += 1
                    self.read[tail] = []
            elif flies:
                self.flying.removeKey((cb,))
            self.known[cb] = (o, ts) if commit else None
            n += int(commit) - int(flies)
        head, oldest = self._oldest(head, tail)
        for k in self.changed:
            self.pages.updateValue((k,), (json.dumps(self.read[k]),))
        self.last.update((head, tail, n, depth_ord, depth, done_ord, status, error))
        ts, cb = oldest or (None, None)
        yield Row(session_key=key[0], queue_id=key[1], event_ord=seen, depth=depth, in_flight=n, oldest_cb_id=cb, oldest_commit_ts=ts,
                  last_completed_status=status, last_completed_error=error)

    def close(self) -> None:
        pass


def queue_state(events: DataFrame) -> DataFrame:
    """State of each queue after every micro-batch that touched it."""
    rows = events.where(F.col("kind").isin("MetalCbCommitted", "MetalCbCompleted")).select(
        "session_key", "queue_id", "event_ord", (F.col("kind") == "MetalCbCommitted").alias("commit"), "cb_id", "ts_mono_ns", "queue_depth", "status", "error_code")
    return rows.groupBy("session_key", "queue_id").transformWithState(
        _Queue(), "session_key string, queue_id bigint, event_ord bigint, depth bigint, in_flight bigint, oldest_cb_id bigint, "
        "oldest_commit_ts bigint, last_completed_status bigint, last_completed_error bigint", "Update", "None")


class _Recent(StatefulProcessor):
    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "ord bigint, ts bigint, text string")

    def handleInputRows(self, key, rows, timerValues):
        items = list(self.items.get()) if self.items.exists() else []
        for frame in rows:
            last = frame.nlargest(self.n, "event_ord")
            items += zip(last["event_ord"].tolist(), last["ts_mono_ns"].tolist(), last["text"].tolist())
            items = sorted(items)[-self.n:]
        self.items.put(items)
        out = [(key[0], o, t, x) for o, t, x in items]
        yield pd.DataFrame(out, columns=["session_key", "event_ord", "ts_mono_ns", "text"])

    def close(self) -> None:
        pass


def recent_items(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` items of each session after every batch; rows have event_ord, ts_mono_ns, text."""
    return rows.select("session_key", "event_ord", "ts_mono_ns", "text").groupBy("session_key").transformWithStateInPandas(
        _Recent(n), "session_key string, event_ord bigint, ts_mono_ns bigint, text string", "Update", "None")
