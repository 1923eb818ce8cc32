"""Token counts from flat token files, by a separator scan.

A token file is nothing but unsigned 16- or 32-bit ids, each document followed by an
end-of-document id; there is no index.  The scan reads the files in blocks, finds all
end ids of a block in one vectorised search, and reports the documents that end in it
and the tokens before the first and after the last end.  A prefix scan over the blocks'
reports stitches the documents that run over block boundaries.

``write_token_files`` makes such files from a table.  A task's files carry the attempt in
their name and count only once the task has reported them, so a lost or repeated task
leaves no wrong file behind.

Files are read and written by URI through pyarrow's file systems, so the folder must be
one that all machines share and that pyarrow knows (local or NFS paths, hdfs, s3, gs).

Defined cases: a null or empty text is a document of no tokens; ids may be null or
repeat; tokens after the last end of a file are an unfinished document and reported as
such; a document may run over any number of blocks; files without a token, or none at all,
give an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanforge.llm.common import bytes_of, cut_lineage, id_and_text, row_base, shared_path, slices
from spanforge.llm.tokens import WordIds, public_vocabulary

END_ID = 49407
BLOCK_TOKENS = 1 << 20


def _open(uri: str):
    from pyarrow import fs

    if re.match(r"file:/[^/]", uri):
        uri = uri[5:]
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def _write(folder: str, tokenizer: str, end_id: int, dtype: str):
    def run(batches):
        from pyspark import TaskContext

        words, task, position = WordIds(tokenizer, literal_specials=True), row_base() >> 33, 0
        name = f"{folder}/tokens-{task:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.bin"
        system, path = _open(name)
        end, out = np.array([end_id], dtype).tobytes(), None
        try:
            for batch in slices(batches):
                if out is None:
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(path)
                n = batch.num_rows
                for ids in words.encode(bytes_of(batch.column(1))):
                    out.write(np.frombuffer(ids, "<u4").astype(dtype).tobytes() + end)
                yield pa.record_batch([pa.array([name] * n), pa.array(np.arange(position, position + n)), batch.column(0)],
                                      names=["file", "position", "doc_id"])
                position += n
        finally:
            if out is not None:
                out.close()

    return run


def write_token_files(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                      end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """Writes the documents' tokens; (file, position, doc_id) says which document is where."""
    run = _write(folder, tokenizer or public_vocabulary(), end_id, dtype)
    return cut_lineage(id_and_text(docs, id_col, text_col).mapInArrow(run, "file string, position long, doc_id long"))


def blocks_of(files: DataFrame, *, block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2") -> DataFrame:
    """(file, block, first, tokens) of every block of the files named in the column file."""
    width = np.dtype(dtype).itemsize

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(4)]
            for name in batch.column(0).to_pylist():
                system, path = _open(name)
                size = system.get_file_info(path).size
                if size % width:
                    raise ValueError(f"{name} is cut within a token")
                for block, first in enumerate(range(0, size // width, block_tokens)):
                    for col, v in zip(cols, (name, block, first, min(block_tokens, size // width - first))):
                        col.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                                  names=["file", "block", "first", "tokens"])

    return files.select("file").distinct().mapInArrow(run, "file string, block long, first long, tokens long")


_SCAN = "file string, block long, ends long, head long, tail long, inner array<long>"


def _scan(end_id: int, dtype: str):
    width = np.dtype(dtype).itemsize

    def run(batches):
        for batch in batches:
            for name, block, first, tokens in zip(*(batch.column(i).to_pylist() for i in range(4))):
                system, path = _open(name)
                with system.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(tokens * width, first * width), dtype)
                at = np.flatnonzero(ids == end_id)
                head, tail = (int(at[0]), len(ids) - 1 - int(at[-1])) if len(at) else (0, len(ids))
                yield pa.record_batch([pa.array([name]), pa.array([block]), pa.array([len(at)], pa.int64()), pa.array([head], pa.int64()),
                                       pa.array([tail], pa.int64()), pa.array([(np.diff(at) - 1).tolist()], pa.list_(pa.int64()))],
                                      names=["file", "block", "ends", "head", "tail", "inner"])

    return run


def token_counts(files: DataFrame, *, end_id: int = END_ID, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, position, n_tokens, finished) of each document in the files named in the column file."""
    blocks = blocks_of(files, block_tokens=block_tokens, dtype=dtype)
    scanned = cut_lineage(blocks.repartition(F.col("file"), F.col("block")).mapInArrow(_scan(end_id, dtype), _SCAN))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # blocks from one with an end on, up to the next such, carry one unfinished document
    run = scanned.select("*", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("position"),
                         F.coalesce(F.sum((F.col("ends") > 0).cast("int")).over(before), F.lit(0)).alias("stretch"))
    carried = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a block with an end is the last of its stretch and opens the next one with its tail
    opened = run.where("ends > 0").select("file", (F.col("stretch") + 1).alias("stretch"), F.col("tail").alias("opened"))
    run = run.join(opened, ["file", "stretch"], "left").withColumn(
        "carry", F.coalesce("opened", F.lit(0)) + F.sum(F.when(F.col("ends") == 0, F.col("tail")).otherwise(0)).over(carried))
    lengths = F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))
    done = run.where("ends > 0").select("file", "position", F.posexplode(lengths).alias("k", "n_tokens"))
    done = done.select("file", (F.col("position") + F.col("k")).alias("position"), "n_tokens", F.lit(True).alias("finished"))
    last = run.groupBy("file").agg(F.max(F.struct("block", "ends", "position", "carry", "tail")).alias("x")).select(
        "file", (F.col("x.position") + F.col("x.ends")).alias("position"),
        F.when(F.col("x.ends") > 0, F.col("x.tail")).otherwise(F.col("x.carry")).alias("n_tokens"), F.lit(False).alias("finished"))
    return done.unionByName(last.where("n_tokens > 0"))


def document_token_counts(spark: SparkSession, docs: DataFrame, *, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens) of each document, counted in token files that are written for it."""
    written = write_token_files(docs, shared_path(spark, f"tokens-{uuid.uuid4().hex}"))
    return token_counts(written, block_tokens=block_tokens).where("finished").join(written, ["file", "position"]).select("doc_id", "n_tokens")
