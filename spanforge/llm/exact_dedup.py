"""Exact dedup by exchanging Golomb-coded fingerprints.

1. Every task hashes its normalised texts and sends, to each owner of a range of
   fingerprints, its sorted distinct fingerprints as Golomb-Rice codes, with a
   bitmap of those that it has more than once.
2. An owner decodes what came for its range and answers each sender with a bitmap
   of the fingerprints that another row shares.
3. Only the rows under a set bit are suspects.  Their texts are grouped by their
   bytes; copies within a task collapse before that shuffle, so a group of copies
   of any size sends one text per task.

What an owner holds is a range of the fingerprints (8 bytes each), never a group of
rows: a hot text is one code per sender.

Defined cases: a null text counts as empty; null ids sort below all others; rows that
repeat an id and a text are copies of each other and one of them stays (the later by row);
texts of any length are hashed and compared whole; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanforge.llm import golomb
from spanforge.llm.common import bit_map, bytes_of, cut_lineage, drop_rows, id_and_text, map_bits, numbered, partitions, row_base

BITS = 48
#: Fingerprints that one owner decodes, about (8 bytes each, for each sender that has them).
OWNER_ROWS = 1 << 22
SALTS = 32

_STAGE = ("row long, doc_id long, text_sha256 string, fp long, sender int, owner int, codes binary, repeats binary")


def _fp(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - bits)


def _senders(owners: int, bits: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("fp", pa.int64()),
                        ("sender", pa.int32()), ("owner", pa.int32()), ("codes", pa.binary()), ("repeats", pa.binary())])

    def run(batches):
        base, seen, n = row_base(), [], 0
        sender = base >> 33
        for batch in batches:
            digests = [hashlib.sha256(t.lower()).digest() for t in bytes_of(batch.column(1))]
            fps = np.fromiter((_fp(d, bits) for d in digests), dtype=np.int64, count=len(digests))
            seen.append(fps)
            m = len(digests)
            yield pa.record_batch([
                batch.column(2) if batch.num_columns > 2 else pa.array(np.arange(base + n, base + n + m)), batch.column(0), pa.array([d.hex() for d in digests], pa.string()),
                pa.array(fps), pa.array(np.full(m, sender, np.int32)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()),
                pa.nulls(m, pa.binary())], schema=schema)
            n += m
        if not n:
            return
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        owner = (values * owners) >> bits if owners < 1 << (62 - bits) else values % owners
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        groups = np.split(order, cuts)
        k = len(groups)
        yield pa.record_batch([
            pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()),
            pa.array(np.full(k, sender, np.int32)), pa.array(np.array([owner[g[0]] for g in groups], np.int32)),
            pa.array([golomb.encode(values[g]) for g in groups], pa.binary()),
            pa.array([np.packbits(counts[g] > 1).tobytes() for g in groups], pa.binary())], schema=schema)

    return run


def _answer(messages: pa.Table) -> pa.Table:
    """An owner's reply: for each sender a bitmap over the fingerprints it sent."""
    lists = [golomb.decode(c) for c in messages.column("codes").to_pylist()]
    own = [np.unpackbits(np.frombuffer(r, np.uint8), count=len(v)).astype(bool) for v, r in zip(lists, messages.column("repeats").to_pylist())]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    bitmaps = [np.packbits(np.isin(v, shared, assume_unique=True) | r).tobytes() for v, r in zip(lists, own)]
    return pa.table({"sender": messages.column("sender"), "owner": messages.column("owner"), "bitmap": pa.array(bitmaps, pa.binary())})


def _suspected(batches):
    for batch in batches:
        senders, fps = [], []
        for sender, codes, bitmap in zip(*(batch.column(i).to_pylist() for i in range(3))):
            values = golomb.decode(codes)
            hit = values[np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(values)).astype(bool)]
            senders.append(np.full(len(hit), sender, np.int32))
            fps.append(hit.astype(np.int64))
        yield pa.record_batch([pa.array(np.concatenate(senders)), pa.array(np.concatenate(fps))], names=["sender", "fp"])


def _texts(filter_, bits: int):
    def run(batches):
        mask = np.frombuffer(filter_.value, np.uint8)
        for batch in batches:
            texts = [t.lower() for t in bytes_of(batch.column(1))]
            fps = np.fromiter((_fp(hashlib.sha256(t).digest(), bits) for t in texts), dtype=np.int64, count=len(texts))
            at = fps % (8 * len(mask))
            hit = np.flatnonzero((mask[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            yield pa.record_batch([pa.array(fps[hit]), pa.array([texts[i] for i in hit], pa.binary())], names=["fp", "bytes"])

    return run


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
                     owners: int | None = None, bits: int = BITS) -> DataFrame:
    """One row per document: row, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row
    with the largest id stays.  ``row`` numbers the rows as this run read them.
    ``bits`` is the width of the exchanged fingerprints; chance hits only cost
    suspects, as texts are compared by bytes.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col, row_col)
    owners = owners or max(partitions(spark), -(-docs.count() // OWNER_ROWS))
    stage = cut_lineage(docs.mapInArrow(_senders(owners, bits), _STAGE))
    rows = stage.where(F.col("row").isNotNull()).select("row", "doc_id", "text_sha256", "fp", "sender")
    messages = stage.where(F.col("owner").isNotNull()).select("sender", "owner", "codes", "repeats")
    answers = messages.groupBy("owner").applyInArrow(_answer, "sender int, owner int, bitmap binary")
    suspected = cut_lineage(messages.join(answers, ["sender", "owner"]).select("sender", "codes", "bitmap")
                            .mapInArrow(_suspected, "sender int, fp long"))
    size = map_bits(suspected.count())
    filter_ = spark.sparkContext.broadcast(bit_map(suspected.select((F.col("fp") % size).alias("at")), size))
    # the byte check: equal bytes fall into one group, which tasks reduce before they send it
    groups = (docs.mapInArrow(_texts(filter_, bits), "fp long, bytes binary").groupBy("fp", "bytes")
              .agg(F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") > 1)
              .select("fp", F.sha2("bytes", 256).alias("text_sha256"), "group_size"))
    mine = rows.join(suspected, ["sender", "fp"], "left_semi")
    stays = (mine.groupBy("fp", "text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("best"))
             .join(groups, ["fp", "text_sha256"]))
    # the rows of a hot group are dealt over several tasks, each with its own copy of the group's line
    salted = stays.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["fp", "text_sha256", "salt"], "left")
    return joined.select(
        "row", "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    rows, row_col = numbered(docs)
    found = exact_duplicates(rows, id_col=id_col, text_col=text_col, row_col=row_col)
    return drop_rows(rows, row_col, found.where(~F.col("kept")))
