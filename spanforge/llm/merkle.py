"""Merkle manifest of a table, with a proof for every row and its check.

Each row is a leaf.  Rows of one group form a tree of fan-out 16 over their order, and
the groups' roots, by group, form one above.  A tree is cut into aligned blocks of 4096
nodes, three levels.  A block is one row that keeps each of its levels as one string of
hex digests.  A parent is the hash of a fixed-width piece of the level below, and the
siblings of a node are the two pieces that flank it, so a proof is cut out of the level
strings where it is hashed and never stored.  The blocks' roots are the nodes of the
next round, 4096 times fewer, until one block is left.

Places within a group need no big window: rows are dealt by ranges of (group, id, leaf),
numbered within their range, and a running sum of the ranges' counts is added.  A group
of any size is spread over many tasks.

Defined cases: a null in any column is its own leaf text, other than an empty one, so a
null group is a group, the first one; null ids come first; rows that share an id go by
leaf, and rows that are repeated are leaves each (with like proofs, so their order does
not matter); a text of any length is one leaf; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanforge.llm.common import cut_lineage, named

FAN, WIDTH = 16, 64
#: Nodes in a block: three levels.
LEVELS = 3
BLOCK = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SEGMENTS = "array<struct<before:binary,after:binary>>"


def encoded(value: Column) -> Column:
    """A field as it is hashed: its byte count and itself, or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def _ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with their place among those of their group ``grp``, by ``order``, and the group's size."""
    # as a last key the number spreads repeated rows over several ranges
    nodes = nodes.withColumn("_any", F.monotonically_increasing_id())
    keys = ["grp", *order, "_any"]
    dealt = cut_lineage(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_any")
                        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    of_group = Window.partitionBy("grp")
    runs = dealt.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = runs.select("grp", "part", "first", F.sum("n").over(of_group).alias("size"), F.coalesce(
        F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    return dealt.join(runs, ["grp", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("earlier")).drop("part", "at", "first", "earlier")


def _parents(level: Column) -> Column:
    """The level above, one digest for each piece of 16."""
    runs = F.ceil(F.octet_length(level) / (FAN * WIDTH)).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * (FAN * WIDTH) + 1, F.lit(FAN * WIDTH)), 256))
    return F.array_join(hashed, "").cast("binary")


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """One row per block: grp, block, size, rows (what the nodes carry, by place), level0 to level3, top.

    A level is null where one node was left below it.
    """
    row = F.struct("pos", "digest", *payload)
    blocks = (nodes.groupBy("grp", "size", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("nodes"))
              .withColumn("level0", F.array_join(F.col("nodes.digest"), "").cast("binary")))
    for k in range(LEVELS):
        below, left = F.col(f"level{k}"), F.col("size") > FAN ** k
        blocks = blocks.withColumn(f"level{k + 1}", F.when(left, _parents(below)))
    levels = [f"level{k}" for k in range(LEVELS + 1)]
    rows = F.transform("nodes", lambda x: F.struct(*(x[p].alias(p) for p in ("pos", *payload))))
    return cut_lineage(blocks.select("grp", "size", "block", rows.alias("rows"), *levels, F.coalesce(*reversed(levels)).alias("top")))


def _segments(i: Column) -> Column:
    """What flanks node ``i`` of a block on each of its levels, from the lowest up."""
    out = []
    for k in range(LEVELS):
        level, at = F.col(f"level{k}"), F.floor(i / FAN ** k).cast("int")
        in_run = at % FAN
        before = F.substring(level, (at - in_run) * WIDTH + 1, in_run * WIDTH)
        after = F.substring(level, (at + 1) * WIDTH + 1, (FAN - 1 - in_run) * WIDTH)
        out.append(F.when(F.col(f"level{k + 1}").isNotNull(), F.struct(before.alias("before"), after.alias("after"))))
    return F.filter(F.array(*out), lambda s: s.isNotNull())


class Tree:
    """Trees over the nodes (grp, pos, size, digest, payload) of all groups."""

    def __init__(self, nodes: DataFrame, payload: list[str]):
        self.rounds = [_blocks(nodes, payload)]
        while True:
            many = self.rounds[-1].where(F.col("size") > BLOCK)
            if many.isEmpty():
                break
            self.rounds.append(_blocks(many.select("grp", F.ceil(F.col("size") / BLOCK).alias("size"), F.col("block").alias("pos"),
                                                   F.col("top").alias("digest")), []))

    def roots(self) -> DataFrame:
        """grp, root of every group."""
        out = None
        for blocks in self.rounds:
            done = blocks.where(F.col("size") <= BLOCK).select("grp", F.col("top").alias("root"))
            out = done if out is None else out.unionByName(done)
        return out

    def lowest(self, above: DataFrame) -> DataFrame:
        """The blocks of the lowest round with the segments above each: grp, block, rows, levels, segments, and what else ``above`` has.

        ``above`` has grp and segments, those of the group's root in what lies over it.
        """
        others = [c for c in above.columns if c not in ("grp", "segments")]
        for blocks in reversed(self.rounds[1:]):
            done = blocks.where(F.col("size") <= BLOCK).join(above, "grp")
            over = done if blocks is self.rounds[-1] else done.unionByName(blocks.where(F.col("size") > BLOCK).join(open_, ["grp", "block"]))
            nodes = over.select("grp", *others, F.inline(F.transform("rows", lambda x, i: F.struct(
                x["pos"].alias("block"), F.concat(_segments(i), F.col("segments")).alias("segments")))))
            open_ = nodes
        lowest = self.rounds[0]
        done = lowest.where(F.col("size") <= BLOCK).join(above, "grp")
        return done if len(self.rounds) == 1 else done.unionByName(lowest.where(F.col("size") > BLOCK).join(open_, ["grp", "block"]))


def _hashed(segments: Column) -> Column:
    """Hash of all siblings, level by level."""
    return F.sha2(F.aggregate(segments, F.lit("").cast("binary"), lambda a, s: F.concat(a, s["before"], s["after"])), 256)


def _folded(leaf: Column, segments: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(segments, leaf.cast("binary"), lambda a, s: F.sha2(F.concat(s["before"], a, s["after"]), 256).cast("binary")).cast("string")


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text",
             changed: Column | None = None, altered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows for which ``changed`` holds are checked with ``altered`` as their text, all others
    as they are: folded_root is what such a row and its siblings of the manifest give.
    """
    here = {c: named(c) for c in fields}
    now = leaf_of([altered if c == text_col and altered is not None else here[c] for c in fields])
    changed = F.lit(False) if changed is None else F.coalesce(changed, F.lit(False))
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), named(group_col).cast("string")), F.lit("")).alias("grp"),  # null first
                         named(id_col).cast("long").alias("doc_id"), leaf_of(list(here.values())).alias("digest"), F.when(changed, now).alias("now"))
    tree = Tree(_ranked(leaves, ["doc_id", "digest"]), ["doc_id", "now"])
    subroots = tree.roots()
    over = Tree(_ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("group"), F.col("root").cast("string").alias("digest")), ["group"]), ["group"])
    top = over.lowest(over.roots().select("grp", F.array().cast(_SEGMENTS).alias("segments"), F.col("root")))
    groups = top.select(F.col("root").cast("string").alias("root"), F.inline(F.transform("rows", lambda x, i: F.struct(
        x["group"].alias("grp"), F.concat(_segments(i), F.col("segments")).alias("segments"), F.substring("level0", i * WIDTH + 1, F.lit(WIDTH)).cast("string").alias("subroot")))))

    def checked(x: Column, i: Column) -> Column:
        segments = F.concat(_segments(i), F.col("segments"))
        leaf = F.substring("level0", i * WIDTH + 1, F.lit(WIDTH)).cast("string")
        return F.struct(x["doc_id"].alias("doc_id"), leaf.alias("leaf"), _hashed(segments).alias("proof_sha256"),
                        _folded(F.coalesce(x["now"], leaf), segments).alias("folded_root"))

    rows = tree.lowest(cut_lineage(groups)).select("subroot", "root", F.inline(F.transform("rows", checked)))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
