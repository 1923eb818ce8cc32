"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanforge.session_conf import cut_lineage, delete_tables, owned_tables, shared_folder

__all__ = ["Scratch", "added", "bit_map", "bytes_of", "cut_lineage", "documents", "drop_rows", "id_and_text", "in_chunks", "map_bits", "named",
           "numbered", "partitions", "release", "row_base", "shared_path", "slices", "small_batches", "texts_of"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def named(column: str) -> Column:
    """A top-level column by its exact name."""
    return F.col("`" + column.replace("`", "``") + "`")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Only the columns that operators read, so that other columns cannot clash with theirs."""
    row = [named(row_col).cast("long").alias("row")] if row_col else []
    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"), *row)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """All columns and a number that tells the rows apart wherever the frame is used; the new column's name.

    The rows are written once, and their numbers with them: even a scan may be split
    otherwise when it is read again, as splits depend on settings and on the live cores.
    """
    name = "row"
    while name.lower() in (c.lower() for c in docs.columns):
        name = "_" + name
    return cut_lineage(docs.withColumn(name, F.monotonically_increasing_id())), name


def drop_rows(docs: DataFrame, name: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose numbers ``dropped`` holds in its column row, and without the numbers.

    The numbers are written first, so their size is known when the join is planned: Spark sends
    them to all tasks while they are below its broadcast threshold, and then no text is
    shuffled; beyond it both sides are.
    """
    gone = cut_lineage(dropped.select(F.col("row").alias("_gone")).distinct())
    return docs.join(gone, named(name) == F.col("_gone"), "left_anti").drop(name)


class Scratch:
    """An intermediate table that its operator deletes as soon as the tables after it are written."""

    def __init__(self, df: DataFrame):
        self.tables: list[str] = []
        with owned_tables(self.tables):
            self.df = cut_lineage(df)

    def drop(self) -> None:
        delete_tables(self.df.sparkSession, self.tables)


def map_bits(n: int) -> int:
    """Size of a map of bits for ``n`` things, so that few others hit one: 16 bits for each, 16 MiB at most."""
    return 1 << min(27, max(20, (16 * n).bit_length()))


def bit_map(places: DataFrame, size: int) -> bytes:
    """The bits whose numbers, below ``size``, the column ``at`` has, as little-endian words."""
    words = places.groupBy(F.call_function("div", F.col("at"), F.lit(32)).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 32).cast("int"))).alias("bits"))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        out = np.zeros(_MAP_WORDS, dtype="<u4")
        out[rows.column("word").to_numpy() % _MAP_WORDS] = rows.column("bits").to_numpy()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    parts = words.withColumn("part", F.call_function("div", F.col("word"), F.lit(_MAP_WORDS))).groupBy("part").applyInArrow(packed, "part long, data binary")
    out = bytearray(size // 8)
    for part, data in parts.collect():
        out[4 * _MAP_WORDS * part:4 * _MAP_WORDS * (part + 1)] = data
    return bytes(out[:size // 8])


_MAP_WORDS = 1 << 13


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that Spark reads and hands to Python at once: texts are long, and a batch is held on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, rows: int = 500):
    """The batches in pieces of a few rows, so that a task's own arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def release() -> None:
    """Give the memory that a task has freed back to the system, as workers live on and would keep it from the others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than GNU's
        pass


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def row_base() -> int:
    """First row number of this task; a task has fewer than 2^33 rows."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 33


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the folder that driver and executors share."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster's machines share")
    return f"{folder}/{name}"


def added(parts: DataFrame, dtype: str) -> np.ndarray:
    """Sum of the tasks' arrays, sent as rows (task, chunk, data), and returned as one.

    Each chunk is added in two rounds, so that no task gets the pieces of all others.
    Only for arrays of a size that does not depend on the input.
    """
    fan = max(4, 2 * math.isqrt(partitions(parts.sparkSession)))

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        first, *others = (np.frombuffer(d.as_buffer(), dtype) for d in rows.column("data"))
        total = first.copy()
        for more in others:
            total += more
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    some = parts.groupBy("chunk", F.pmod("task", F.lit(fan)).alias("s")).applyInArrow(add, "chunk int, data binary")
    got = sorted(map(tuple, some.groupBy("chunk").applyInArrow(add, "chunk int, data binary").collect()))
    return np.frombuffer(b"".join(d for _, d in got), dtype)


def in_chunks(values: np.ndarray, chunks: int) -> pa.RecordBatch:
    """A task's array as rows for ``added``."""
    return pa.record_batch([pa.array(np.full(chunks, row_base() >> 33, np.int32)), pa.array(np.arange(chunks, dtype=np.int32)),
                            pa.array([p.tobytes() for p in np.split(values, chunks)], pa.binary())], names=["task", "chunk", "data"])
