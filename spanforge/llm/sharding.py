"""Shards of near equal bytes by sampled splitters.

Rows are ordered by a key: a hash of the text, then the id, then a row number.  Equal
texts are neighbours, and as the rest of the key tells them apart, a group of copies of
any size can still be cut.

1. A sample that draws rows in proportion to their size gives the splitters: its
   quantiles.  Its size depends on the number of ranges only.
2. Each row finds its range by a binary search over the splitters.
3. Ranges that hold more than twice their share are sampled again and subdivided.
4. The ranges' exact sums and a running sum inside each range give every row the bytes
   and rows before it.  Bytes before it decide the shard, rows before it the slot.

All of it is column expressions.  Only splitters and sums of ranges pass through the
driver, a few thousand numbers for any input.

Defined cases: a null text has no bytes and so size 1; null ids sort first; repeated
rows are placed each; a text of any length is one row of that size, also if it is larger
than a shard should be; rows that tie in every key go in any order; an empty table gives an
empty result; other columns are not read.  Equal texts share a shard unless one of the
seven cuts falls into their group.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanforge.llm.common import cut_lineage, id_and_text

KEY = "struct<hash:bigint,id:bigint,row:bigint>"


def _literal(values: list, kind: str) -> Column:
    """A constant array, folded before the query runs."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _range_of(splitters: list[tuple]) -> Column:
    """How many splitters are at or before a row's key, by binary search."""
    if not splitters:
        return F.lit(0)
    keys = _literal([dict(zip(("hash", "id", "row"), s)) for s in splitters], KEY)
    steps, step = [], 1 << (len(splitters).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    own = F.struct("hash", "id", "row")

    def further(at: Column, by: Column) -> Column:
        passed = F.coalesce(F.get(keys, at + by - 1) <= own, F.lit(False))
        return F.when(passed, at + by).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def _sample(rows: DataFrame, rate: float, seed: int) -> list[tuple]:
    """(key, draws) of rows drawn about ``rate`` times a byte; the same rows each time."""
    u = F.pmod(F.xxhash64("row", "id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.select("hash", "id", "row", F.floor(F.col("size") * F.lit(rate) + u).alias("draws")).where("draws > 0")
    return sorted(((r.hash, r.id, r.row), r.draws) for r in drawn.collect())


def _quantiles(sample: list[tuple], n: int) -> list[tuple]:
    """Keys that cut the sample into ``n`` parts of about equal draws."""
    total, seen, out = sum(d for _, d in sample), 0, []
    for key, draws in sample:
        if seen * n // max(total, 1) != (seen + draws) * n // max(total, 1) and (seen + draws) < total:
            out.append(key)
        seen += draws
    return out


def shard_by_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 8,
                   ranges: int = 1024, draws: int = 16, rounds: int = 4, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 1; shards differ by less than two documents.
    ``draws`` is the expected sample per range.  A range that is still overfull after
    ``rounds`` is right all the same, only slower.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut_lineage(id_and_text(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"), F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("id"),
        F.monotonically_increasing_id().alias("row")))
    total = rows.agg(F.sum("size")).first()[0] or 1
    share = total / ranges
    splitters = _quantiles(_sample(rows, draws / share, seed), ranges)
    for again in range(rounds):
        ranged = rows.withColumn("range", _range_of(splitters))
        sums = sorted(map(tuple, ranged.groupBy("range").agg(F.sum("size"), F.count(F.lit(1))).collect()))
        over = {r: b for r, b, n in sums if b > 2 * share and n > 1}
        if not over or again == rounds - 1:
            break
        inside = ranged.where(F.array_contains(_literal(list(over), "int"), F.col("range")))
        finer = set(splitters)
        for r, part in _by_range(_sample(inside, draws / share, seed + again + 1), splitters).items():
            finer.update(_quantiles(part, -(-over.get(r, 0) // int(share + 1))))
        if len(finer) == len(splitters):
            break
        splitters = sorted(finer)
    at_bytes, at_rows, b, n = [0] * (len(splitters) + 1), [0] * (len(splitters) + 1), 0, 0
    have = {r: (x, y) for r, x, y in sums}
    for r in range(len(splitters) + 1):
        at_bytes[r], at_rows[r] = b, n
        b, n = b + have.get(r, (0, 0))[0], n + have.get(r, (0, 0))[1]
    order = Window.partitionBy("range").orderBy("hash", "id", "row")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.get(_literal(at_bytes, "bigint"), F.col("range")) + F.sum("size").over(so_far) - F.col("size")
    rank = F.get(_literal(at_rows, "bigint"), F.col("range")) + F.row_number().over(order) - 1
    shard = F.least(F.lit(shards - 1), F.floor(before / F.lit(total / shards)).cast("int"))
    placed = cut_lineage(ranged.select("doc_id", "size", "text_crc32", shard.alias("shard"), rank.alias("rank")))
    first = dict(map(tuple, placed.groupBy("shard").agg(F.min("rank")).collect()))
    starts = _literal([first.get(s, 0) for s in range(shards)], "bigint")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.get(starts, F.col("shard"))).alias("slot"))


def _by_range(sample: list[tuple], splitters: list[tuple]) -> dict[int, list[tuple]]:
    from bisect import bisect_right

    out: dict[int, list[tuple]] = {}
    for key, draws in sample:
        out.setdefault(bisect_right(splitters, key), []).append((key, draws))
    return out
