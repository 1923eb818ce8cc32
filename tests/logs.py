"""Hand-built event logs for tests."""

from __future__ import annotations

from spanforge.schema import EVENT

SOURCE_OF = {"Mark": "Mark", "ProcFootprint": "Proc", "ProcTop": "Proc", "VmSample": "Vm"}


class Log:
    """Collects events of one session; seq and event_ord count up from 1."""

    def __init__(self, session="s1", step=1):
        self.session, self.rows, self.step = session, [], step

    def add(self, kind, ts, **cols):
        n = len(self.rows) + 1
        source = SOURCE_OF.get(kind, "MetalHook" if kind.startswith("Metal") else "PythonSidecar")
        row = dict(session_key=self.session, event_ord=n, ts_mono_ns=ts, ts_wall_ns=10**18 + ts, session_id="ab" * 16,
                   source=source, seq=n, kind=kind)
        row.update(cols)
        self.rows.append(row)
        return self

    def enter(self, ts, call, name="m", parent=None, **kw):
        return self.add("ModuleEntered", ts, module_call_id=call, qualname=name, class_name="C", parent_call_id=parent,
                        depth=0, **kw)

    def leave(self, ts, call):
        return self.add("ModuleReturned", ts, module_call_id=call)

    def eval(self, t0, t1, call, stack=(), frames=(), was_async=False):
        self.add("MlxEvalEntered", t0, call_id=call, array_count=1, stream="gpu", module_stack=list(stack), stack_frames=list(frames))
        return self.add("MlxEvalReturned", t1, call_id=call, duration_ns=t1 - t0, was_async=was_async)

    def commit(self, ts, cb, queue=0, depth=1, label=None):
        return self.add("MetalCbCommitted", ts, cb_id=cb, queue_id=queue, queue_depth=depth, label=label)

    def sched(self, ts, cb, queue=0):
        return self.add("MetalCbScheduled", ts, cb_id=cb, queue_id=queue)

    def done(self, ts, cb, queue=0, error=None, in_flight=100):
        return self.add("MetalCbCompleted", ts, cb_id=cb, queue_id=queue, status=4, error_code=error, in_flight_ns=in_flight)

    def ops(self, ts, cb, *ops):
        return self.add("MetalCbOps", ts, cb_id=cb, ops=[dict(name=n, symbol=s, gpu_ns=g, count=c) for n, s, g, c in ops])

    def sample(self, ts, used, budget=100):
        return self.add("MetalDeviceMemSample", ts, allocated_bytes=used, recommended_max_bytes=budget, at_event="commit")


def frame(spark, *logs):
    names = [f.name for f in EVENT.fields]
    rows = [tuple(r.get(n) for n in names) for log in logs for r in log.rows]
    return spark.createDataFrame(rows, EVENT)
