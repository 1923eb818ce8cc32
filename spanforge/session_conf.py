"""Session settings used by the bench, the tests and local runs."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "spanforge") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPANFORGE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for cut lineage: the one the session names.

    Only a local session without one gets a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        return _OWN_FOLDERS.setdefault(spark.sparkContext.applicationId, tempfile.gettempdir() + "/spanforge-" + uuid.uuid4().hex)
    raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")


#: Folders of local sessions that name none, by application; Spark takes no such setting while it runs.
_OWN_FOLDERS: dict[str, str] = {}
#: Where the tables that are written now are listed, so that their owner can delete them.
_OWNERS: ContextVar[list[str] | None] = ContextVar("owners", default=None)


def cut_lineage(df: DataFrame, *, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where one intermediate feeds many branches or a recursion.  A table
    rather than a row checkpoint keeps column pruning, filter pushdown and true
    size statistics for the joins after it.  It survives lost executors.  With ``by`` the
    rows lie in a folder for each value of that column, so a filter on it reads these only.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    if (owned := _OWNERS.get()) is not None:
        owned.append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str | Column, ranges: bool = False) -> DataFrame:
    """``df`` dealt by ``by`` over all tasks of a shuffle, for rows that are written to a folder each or a few.

    Such work costs by the number of files, not by bytes.  A number of tasks that is named keeps
    Spark from joining small ones, which would leave all folders to one task.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(tasks, *by) if ranges else df.repartition(tasks, *by)


def use_few_listing_tasks(spark: SparkSession) -> None:
    """Folders are listed by some tasks for each core; by Spark's default by a task each, up to 10,000."""
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(8 * spark.sparkContext.defaultParallelism))


@contextmanager
def owned_tables(tables: list[str]) -> Iterator[list[str]]:
    """Within this, ``tables`` gets the path of every intermediate table that is written.

    They are needed as long as a frame that was made within it is still to be run, or
    run again; ``delete_tables`` is for their owner to call after that.  An owner around
    this one gets them too.
    """
    around = _OWNERS.get()
    token = _OWNERS.set(tables)
    try:
        yield tables
    finally:
        _OWNERS.reset(token)
        if around is not None:
            around += [t for t in tables if t not in around]


def delete_tables(spark: SparkSession, tables: list[str]) -> None:
    """Delete intermediate tables, by the file system that holds them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while tables:
        path = jvm.org.apache.hadoop.fs.Path(tables.pop())
        path.getFileSystem(conf).delete(path, True)
