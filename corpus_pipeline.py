"""The corpus pipeline: stages that each apply one operator to what the one before kept.

A stage's intermediate tables are needed until its output is written, also if tasks of that
write are repeated.  The next stage gets the written output, so it deletes them first; a
run holds the intermediates of one stage at a time.

Defined cases are those of the operators: null and empty texts are scored, are copies of
each other, link with nothing, hold no item and are one end id; null ids are kept apart as
rows; repeated rows are copies, of which one stays; ties go as each operator states; texts
of any length are read whole; other columns come through; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.common import documents, shared_path, small_batches
from spanforge.llm.decontaminate import drop_leaks
from spanforge.llm.exact_dedup import drop_exact_duplicates
from spanforge.llm.jaccard import drop_similar
from spanforge.llm.packing import pack
from spanforge.llm.quality import drop_low_quality
from spanforge.session_conf import delete_tables, owned_tables

_MINE = threading.local()


def _owner(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, as the owner of the intermediate tables that it writes."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        tables = _MINE.__dict__.setdefault("tables", [])
        if tables and not any(t.rsplit("/", 1)[1] in f for f in docs.inputFiles() for t in tables):
            delete_tables(spark, tables)
        with owned_tables(tables):
            return stage(spark, docs, sf_dir)

    return run


@_owner
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_owner
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return drop_exact_duplicates(docs)


@_owner
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id stays."""
    return drop_similar(docs)


@_owner
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_owner
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in training sequences."""
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("packing", packing)]

#: No SQL states the trained stages; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs, written = documents(spark, sf_dir), []
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        delete_tables(spark, written)  # this stage's output is there, so the one before is not needed again
        written = [path]
    delete_tables(spark, _MINE.tables)
    return docs
