"""Line dedup by overlapping windows of three lines.

Every three consecutive lines are a window with a hash.  A window that stands more than
once in the corpus is kept where it stands first, by document id, row and line; all
later places are covered, and a line under any covered window is removed.  Overlapping
windows so merge into one removed stretch.

The first places are a minimum per hash, which tasks reduce before they send it, so a
stretch in a third of all documents sends one line a task.

Defined cases: a null or empty text has no lines to remove and stays as it is; null ids
come first; texts of fewer lines than the window are not touched; repeated rows are
copies, of which the first one by row stays; windows of blank lines alone count as none;
texts and lines of any length are hashed whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from spanforge.llm.common import cut_lineage, id_and_text, row_base, slices
from spanforge.llm.components import salted_join

WIDTH = 3
_STAGE = "row long, doc_id long, text string, windows array<struct<hi:long,lo:long,line:int>>"


def _windows(width: int):
    kind = pa.struct([("hi", pa.int64()), ("lo", pa.int64()), ("line", pa.int32())])

    def run(batches):
        row = row_base()
        for batch in slices(batches):
            hi, lo, at, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                lines = [s.strip() for s in (text or "").split("\n")]
                hashes = [xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")) if s else b"" for s in lines]
                for i in range(len(lines) - width + 1):
                    own = hashes[i:i + width]
                    if any(own):
                        h = xxhash.xxh3_128_digest(b"\n".join(own))
                        hi.append(int.from_bytes(h[:8], "big", signed=True))
                        lo.append(int.from_bytes(h[8:], "big", signed=True))
                        at.append(i)
                ends.append(len(at))
            windows = pa.StructArray.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(at, pa.int32())], fields=list(kind))
            n = batch.num_rows
            yield pa.record_batch([pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1),
                                   pa.ListArray.from_arrays(pa.array(ends, pa.int32()), windows)], names=["row", "doc_id", "text", "windows"])
            row += n

    return run


def _cut(width: int):
    """The text without covered lines, the numbers of the lines removed, and how many there were."""
    schema = ["row", "doc_id", "text", "n_lines", "removed"]

    def run(batches):
        for batch in slices(batches):
            texts, counts, gone = [], [], []
            for text, covered in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lines = (text or "").split("\n")
                out = sorted({i + k for i in covered or () for k in range(width)})
                drop = set(out)
                texts.append("\n".join(s for i, s in enumerate(lines) if i not in drop) if out else text)
                counts.append(len(lines) if text else 0)
                gone.append(out)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int32()),
                                   pa.array(gone, pa.list_(pa.int32()))], names=schema)

    return run


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: row, doc_id, text (what stays), n_lines, removed (numbers of the lines taken out).

    Lines are compared without white space at their ends.
    """
    stage = cut_lineage(id_and_text(docs, id_col, text_col).mapInArrow(_windows(width), _STAGE))
    windows = stage.select("row", "doc_id", F.explode("windows").alias("w")).select("doc_id", "row", "w.*")
    place = F.struct("doc_id", "row", "line")
    repeated = windows.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hi", "lo", "first")
    later = salted_join(windows, cut_lineage(repeated), ["hi", "lo"]).where((F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line")))
    covered = later.groupBy("row").agg(F.collect_set("line").alias("covered"))
    return (stage.select("row", "doc_id", "text").join(covered, "row", "left").select("row", "doc_id", "text", "covered")
            .mapInArrow(_cut(width), "row long, doc_id long, text string, n_lines int, removed array<int>"))
