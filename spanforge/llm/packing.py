"""Best-fit packing planned over a histogram of lengths.

Documents become token ids and an end id; those over the capacity are cut.  The
planner sees only how many pieces of each length there are (as many numbers as the
capacity, whatever the corpus): going down from the longest length it puts all pieces
of a length at once, into the open sequences with the least room that still takes
them, then into new ones.  A plan line says that pieces of one length with ranks from
``lo`` on go, ``per`` to a sequence, into sequences from ``first`` on at ``offset``.
Documents then take their places by rank within their length.

Ranks need no sort and no big window: a task numbers its pieces of each length, and a
running sum of the tasks' counts gives the number that each task starts at.  A length
shared by a third of all rows is spread over all tasks.

Defined cases: a null or empty text is one piece that holds the end id; repeated rows
are packed each; ids may be null or repeat; a text of any length is encoded whole and cut into
pieces; pieces of one length take their places in the order of their tasks; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spanforge.llm.common import bytes_of, cut_lineage, id_and_text, release, row_base, slices
from spanforge.llm.tokens import WordIds, public_vocabulary

CAPACITY = 4096
END_ID = 1

_PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, task int, task_rank long"


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its lines (lo, first, per, offset), by lo."""
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, how many)
    has_room = np.zeros(capacity + 1, dtype=bool)
    lines: dict[int, list[tuple[int, int, int, int]]] = {}
    sequences = 0

    def keep(room: int, first: int, n: int) -> None:
        open_[room].append((first, n))
        has_room[room] = True

    for length in sorted(counts, reverse=True):
        left, lo, out = counts[length], 0, []

        def put(room: int, first: int, n: int) -> None:
            """Pieces into up to ``n`` sequences from ``first`` on that have this room."""
            nonlocal left, lo
            per = room // length
            full = min(n, left // per)
            if full:
                out.append((lo, first, per, capacity - room))
                keep(room - per * length, first, full)
                lo, left, first, n = lo + full * per, left - full * per, first + full, n - full
            if n and left and left < per:
                out.append((lo, first, left, capacity - room))
                keep(room - left * length, first, 1)
                lo, left, first, n = lo + left, 0, first + 1, n - 1
            if n:
                keep(room, first, n)

        for room in length + np.flatnonzero(has_room[length:]):
            here, open_[room], has_room[room] = open_[room], [], False
            for first, n in here:
                put(int(room), first, n) if left else keep(int(room), first, n)
            if not left:
                break
        if left:
            per = capacity // length
            new = -(-left // per)
            start, sequences = sequences, sequences + new
            put(capacity, start, new)
        lines[length] = out
    return lines


def _pieces(tokenizer: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        words, task, ranks = WordIds(tokenizer), row_base() >> 33, {}
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(bytes_of(batch.column(1)))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    n = len(part) // 4
                    rank = ranks[n] = ranks.get(n, -1) + 1
                    for col, v in zip(cols, (doc_id, piece, at // 4, n, part, zlib.crc32(part), task, rank)):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)],
                                  names=[f.split()[0] for f in _PIECES.split(", ")])
        del words
        release()

    return run


def _places(lines):
    """(length, rank) to (sequence_id, offset) by the plan."""

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else []:
            size = int(n[some[0]])
            lo, first, per, at = lines.value[size].T
            k = np.searchsorted(lo, r[some], "right") - 1
            i = r[some] - lo[k]
            sequence[some], offset[some] = first[k] + i // per[k], at[k] + i % per[k] * size
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    return place


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit; ``ids_crc32`` is their checksum, taken
    when they were made.  ``tokenizer`` is a file that every machine has.
    """
    spark = docs.sparkSession
    run = _pieces(tokenizer or public_vocabulary(), capacity, end_id)
    pieces = cut_lineage(id_and_text(docs, id_col, text_col).mapInArrow(run, _PIECES))
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # one row per length, so at most as many as the capacity
    counts = {int(r.length): int(r.n) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lines = {n: np.array(ls, dtype=np.int64) for n, ls in plan(counts, capacity).items()}
    place = _places(spark.sparkContext.broadcast(lines))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    placed = (pieces.join(starts, ["length", "task"])
              .withColumn("_place", place("length", F.col("task_rank") + F.col("_start"))))
    return placed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "_place.sequence_id", "_place.offset")
