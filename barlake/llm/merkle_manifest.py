"""Merkle manifest of a dataset by sibling-shift self-joins.

Rows are leaves, hashed per group (a source) and ranked in it. At every level a node finds the other nodes of its run by
equijoins of the level with itself: a sibling's index is computed from the node's own, by XOR where runs hold two and by
an offset of the slot otherwise. Each node thereby holds what lies left and right of it, which is its part of every proof
below; the nodes of slot zero emit the parents, which are the next level. The roots of the groups are the leaves of one
more tree, built alike. Going down again, a node's proof is its own siblings and then its parent's proof.

A node is one row of keys (group, index), so a group that holds most rows is spread like any other; no tree, level or
proof is gathered anywhere. The driver gets the size of the largest group, and the root.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, shuffle_parts

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A group in two columns that are never null, so that plain equality joins it.
GROUP = ["none", "group"]
NODE = [*GROUP, "idx"]


def leaf_hash(*values: Column) -> Column:
    """SHA-256 of the values' decimal or text forms, each with its bytes' count before it, null being a lone dash."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown)), 256)


def _ranked(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds idx, the place in the group by the order (nulls first), and n, the group's size.

    Rows are sorted by range over all tasks; a row's place is the rows before it in its task and those of its group in
    earlier tasks, of which there is one count for each task and group. Equal rows are told apart by any order.
    """
    spark = leaves.sparkSession
    keys = [F.col("none").desc(), "group", *order, "salt"]
    dealt = leaves.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(shuffle_parts(spark), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    dealt = materialize(dealt.drop("salt").withColumns({"at": at, "task": F.shiftright(at, 33)}), "ranked")
    counts = dealt.groupBy(*GROUP, "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    every = Window.partitionBy(*GROUP)
    before = F.coalesce(F.sum("rows").over(every.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.select(*GROUP, "task", (before - F.col("first")).alias("shift"), F.sum("rows").over(every).alias("n"))
    return dealt.join(runs, [*GROUP, "task"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def _siblings(level: DataFrame, arity: int) -> DataFrame:
    """The level's nodes that have a parent, with left and right: the hashes of their run's others before and after them.

    One equijoin of the level with itself for each other slot of a run, by the sibling's computed index.
    """
    level = level.where("n > 1")
    slot, others = F.pmod("idx", F.lit(arity)), []
    out = level
    for k in range(1, arity):
        sibling = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + F.pmod(slot + k, F.lit(arity))
        near = level.select(*GROUP, F.col("idx").alias(f"at{k}"), F.col("hash").alias(f"hash{k}"))
        out = out.withColumn(f"at{k}", sibling).join(near, [*GROUP, f"at{k}"], "left")
        others.append(F.struct(F.col(f"at{k}").alias("at"), F.coalesce(f"hash{k}", F.lit("")).alias("hash")))
    run = F.array_sort(F.array(*others))
    side = lambda keep: F.array_join(F.transform(F.filter(run, keep), lambda x: x["hash"]), "")
    return out.select(*NODE, "n", "hash", side(lambda x: x["at"] < F.col("idx")).alias("left"), side(lambda x: x["at"] > F.col("idx")).alias("right"))


def _parents(nodes: DataFrame, arity: int) -> DataFrame:
    """What the nodes of slot zero emit: the hash of their run."""
    first = nodes.where(F.pmod("idx", F.lit(arity)) == 0)
    return first.select(*GROUP, F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"), F.sha2(F.concat("hash", "right"), 256).alias("hash"))


@dataclass
class Forest:
    """A tree for each group: levels of nodes that have parents, and the roots (group, depth, hash)."""

    arity: int
    levels: list[DataFrame]
    roots: DataFrame


def _grown(ranked: DataFrame, arity: int) -> Forest:
    """ranked: (group, idx, n, hash)."""
    level, levels, roots = ranked.select(*NODE, "n", "hash"), [], []
    most = level.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(level.where("n = 1").select(*GROUP, F.lit(len(levels)).alias("depth"), "hash"))
        if most <= 1:
            break
        levels.append(materialize(_siblings(level, arity), f"level{len(levels)}"))
        level, most = _parents(levels[-1], arity), -(-most // arity)
    found = roots[0]
    for x in roots[1:]:
        found = found.union(x)
    return Forest(arity, levels, materialize(found, "roots"))


def _proofs(forest: Forest, above: DataFrame) -> DataFrame:
    """(group, idx, subroot, steps) of every leaf: left and right at each level upwards, then the steps of above.

    above: (group, subroot, steps) of the groups' roots.
    """
    tops = forest.roots.select(*GROUP, "depth").join(above, GROUP).withColumn("idx", F.lit(0).cast("long"))
    shape = [*NODE, "subroot", "steps"]
    known = tops.where(F.col("depth") == len(forest.levels)).select(*shape)
    for depth in range(len(forest.levels) - 1, -1, -1):
        own = forest.levels[depth].withColumnRenamed("idx", "own").withColumn("idx", F.floor(F.col("own") / forest.arity))
        step = F.array(F.struct("left", "right"))
        down = own.join(known, NODE).select(*GROUP, F.col("own").alias("idx"), "subroot", F.concat(step, "steps").alias("steps"))
        known = materialize(down.union(tops.where(F.col("depth") == depth).select(*shape)), f"proofs{depth}")
    return known


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda found, s: F.sha2(F.concat(s["left"], found, s["right"]), 256))


def manifest(rows: DataFrame, group: str, order: Sequence[str], arity: int = ARITY) -> DataFrame:
    """The rows with subroot, root and steps, the proof from a row's leaf up to the root: [(left, right), ...].

    rows: has a column leaf; all columns are kept, but none may be named none, group, idx, n, hash, at, task, salt or
    depth. A group's leaves ascend by order, then by leaf, groups by name; nulls come first in both. Equal rows are
    leaves of their own. A group of one row has its leaf as subroot; of one group in all, the subroot is the root. An
    empty table gives an empty one.
    """
    spark = rows.sparkSession
    named = rows.withColumns({"none": F.col(group).isNull(), "group": F.coalesce(F.col(group).cast("string"), F.lit(""))})
    placed = materialize(_ranked(named, [*order, "leaf"]), "leaves")
    low = _grown(placed.withColumnRenamed("leaf", "hash"), arity)
    # the roots of the groups are one more group, in the order of their names
    tops = low.roots.select(*GROUP, F.col("hash").alias("leaf"))
    listed = tops.select(F.lit(False).alias("none"), F.lit("").alias("group"), (~F.col("none")).alias("some"), F.col("group").alias("name"), "leaf")
    ends = materialize(_ranked(listed, ["some", "name"]), "subroots")
    high = _grown(ends.withColumnRenamed("leaf", "hash"), arity)
    root = (high.roots.first() or {"hash": None})["hash"]
    start = spark.createDataFrame([(False, "", root)], "none boolean, group string, subroot string").withColumn("steps", F.expr("cast(array() as array<struct<left: string, right: string>>)"))
    above = ends.join(_proofs(high, start).drop("subroot"), NODE).select((~F.col("some")).alias("none"), F.col("name").alias("group"), F.col("leaf").alias("subroot"), "steps")
    return placed.join(_proofs(low, above), NODE).drop(*NODE, "n").withColumn("root", F.lit(root))


def audit(documents: DataFrame) -> DataFrame:
    """The manifest of documents, held against a copy from which line ends are lost.

    Documents whose doc_id has an even CRC-32 in its decimal form lose every line end of their text; without a doc_id
    nothing is lost. Gives doc_id, leaf, subroot, root, proof_sha256 (of the proof's hashes, upwards, left to right),
    folded_root (of the copy's leaf and the proof) and verified (it is the root). Null fields count as nulls.
    """
    lossy = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    fields = [F.col(c) for c in FIELDS]
    leaf = leaf_hash(*fields)
    copy = F.when(lossy, leaf_hash(*fields[:-1], F.replace("text", F.lit("\n"), F.lit("")))).otherwise(leaf)
    leaves = materialize(documents.select("doc_id", "source", leaf.alias("leaf"), copy.alias("copy")), "hashes")
    found = manifest(leaves, "source", ["doc_id"])
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("copy"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
