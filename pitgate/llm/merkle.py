"""Merkle manifest of a dataset: checkpointed levels, interior nodes recomputed for proofs.

Rows are leaves of one tree per group, ordered by a key; the groups' roots are the leaves of one more
tree, whose root stands for the whole table. Of a tree only every :data:`EVERY`-th level is stored. What
lies between two stored levels is an aligned subtree of at most ``arity ** every`` stored nodes: one
small group of rows, from which a task makes the missing nodes anew, takes the siblings that proofs need,
and forgets them.

* Places in a tree come from a range partitioning by (tree, key, digest), so a tree that holds most
  rows is many tasks; only counts per (partition, tree) meet in a window.
* Proofs are made from the top down: each stored level hands its nodes' paths to the subtrees
  below, one row a subtree, never one a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgate.llm.tables import stored

ARITY = 8
EVERY = 3
PROOF = "array<struct<left: string, right: string>>"
_NODE = "tree string, pos long, digest string, n long"
_PROOF_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values: ``-`` for a null, else the UTF-8 byte count, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its siblings, level by level, give."""
    return F.aggregate(proof, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings_digest(proof: Column) -> Column:
    """Lowercase hex SHA-256 of all siblings of a proof, from the leaf's up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _hash(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _parents(digests: list[str], arity: int) -> list[str]:
    return [_hash(digests[k:k + arity]) for k in range(0, len(digests), arity)]


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0 in their ``tree``, by ``order``) and ``n``, the rows of the tree.

    Rows are written in ranges of the order; a row's place is its place in its partition, counted from
    the partition's first row of the tree, plus the tree's rows in the partitions before.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "merkle-ordered")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    parts = dealt.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.select(
        "tree", "_part", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_c").over(whole).alias("n")), "merkle-parts")
    return dealt.join(parts, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop(
        "_at", "_part", "_shift")


@dataclass
class Manifest:
    """Stored levels of trees, from the leaves up: ``tree, pos, digest, n``; the last has one node a tree."""

    levels: list[DataFrame]
    arity: int
    every: int

    @property
    def roots(self) -> DataFrame:
        """``tree, digest`` of every tree."""
        return self.levels[-1].select("tree", "digest")


def manifest(leaves: DataFrame, order: Sequence[str] = ("key",), arity: int = ARITY, every: int = EVERY) -> Manifest:
    """Trees over ``leaves`` (``tree``, a string that is never null, ``digest``, the columns of ``order``
    and any others, which stay with the leaves).

    Leaves of a tree ascend by ``order``, nulls first, then by digest, so rows that are repeated or share
    a key have a fixed result. While a tree has several nodes, every ``arity`` consecutive ones, the last
    run fewer, become the hash of their digests; a lone leaf is its tree's root.
    """
    width = arity**every
    base = numbered(leaves, [*order, "digest"])
    levels = [base]
    most = base.agg(F.max("n")).first()[0] or 0

    def raise_(table: pa.Table) -> pa.Table:
        pos = table["pos"].to_numpy()
        digests = table["digest"].take(pa.array(np.argsort(pos))).to_pylist()
        n = table["n"][0].as_py()
        for _ in range(every):
            if n > 1:
                digests, n = _parents(digests, arity), -(-n // arity)
        return pa.table({"tree": table["tree"][:1], "pos": pa.array([int(pos[0]) // width], pa.int64()),
                         "digest": pa.array(digests), "n": pa.array([n], pa.int64())})

    while most > 1 or len(levels) == 1:
        below = levels[-1].select("tree", "pos", "digest", "n", F.expr(f"pos div {width}").alias("_block"))
        levels.append(stored(below.groupBy("tree", "_block").applyInArrow(raise_, _NODE), "merkle-level"))
        most = -(-most // width)
    return Manifest(levels, arity, every)


def _paths(tree: Manifest, level: int, above: DataFrame) -> DataFrame:
    """The nodes of a stored level with ``proof`` and the other columns of ``above``: each subtree's missing
    nodes are made anew, their siblings put before the path that ``above`` has for the subtree's top."""
    arity, every = tree.arity, tree.every
    width = arity**every
    nodes = tree.levels[level].withColumn("_block", F.expr(f"pos div {width}"))
    names = [c for c in nodes.columns if c != "_block"]
    given = [f.name for f in above.schema if f.name not in ("tree", "pos", "proof")]
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name != "_block"),
                       *(f"`{c}` {above.schema[c].dataType.simpleString()}" for c in given), f"proof {PROOF}"])

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pa.array(np.argsort(left["pos"].to_numpy()))).select(names)
        n, rows = left["n"][0].as_py(), left.num_rows
        here, steps = left["digest"].to_pylist(), []
        for _ in range(every):
            if n > 1:
                runs = [here[k:k + arity] for k in range(0, len(here), arity)]
                steps.append([("".join(run[:i]), "".join(run[i + 1:])) for run in runs for i in range(len(run))])
                here, n = _parents(here, arity), -(-n // arity)
        upper = [(s["left"], s["right"]) for s in right["proof"][0].as_py()]
        flat = []
        for i in range(rows):
            at = i
            for step in steps:
                flat.append(step[at])
                at //= arity
            flat.extend(upper)
        size = len(steps) + len(upper)
        pairs = pa.StructArray.from_arrays(
            [pa.array([p[k] for p in flat], pa.string()) for k in (0, 1)], ["left", "right"])
        proof = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * size, pa.int32()), pairs).cast(_PROOF_TYPE)
        for c in given:
            left = left.append_column(c, pa.array([right[c][0].as_py()] * rows, right.schema.field(c).type))
        return left.append_column("proof", proof)

    top = above.withColumnRenamed("pos", "_block")
    return nodes.groupBy("tree", "_block").cogroup(top.groupBy("tree", "_block")).applyInArrow(emit, shape)


def extracted(tree: Manifest, tops: DataFrame) -> DataFrame:
    """The leaves with their ``proof``. ``tops`` (``tree, proof``, more) has the path above each tree's root."""
    found = tops.withColumn("pos", F.lit(0).cast("long"))
    for level in range(len(tree.levels) - 1, -1, -1):
        found = _paths(tree, level, found)
        if level:
            found = found.drop("digest", "n")
    return found.drop("pos", "n")


def _label(group: Column) -> Column:
    """A tree's name: never null, a null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def dataset_proofs(rows: DataFrame, group: str, key: str, digest: str, keep: Sequence[str] = (),
                   arity: int = ARITY, every: int = EVERY) -> DataFrame:
    """``group, key, digest, *keep, subroot, root, proof`` for every row of ``rows``.

    One tree for each value of ``group``, its leaves by ``key``; the trees' roots, a null group first, then by
    the group's UTF-8 bytes, are the leaves of the tree whose root is ``root``. ``proof`` lists, from the
    leaf's level to the root's, the digests to the left and to the right in the run, concatenated; levels
    above a lone node have none. ``folded(digest, proof)`` is the root.

    Null keys come first in their tree; rows that share a key follow by digest, and repeated rows are a leaf
    each. An empty table gives no rows. Columns that are not named take no part, whatever their names.
    """
    named = {"tree": _label(F.col(f"`{group}`")), "group": F.col(f"`{group}`"), "key": F.col(f"`{key}`"),
             "digest": F.col(f"`{digest}`")} | {f"keep_{i}": F.col(f"`{c}`") for i, c in enumerate(keep)}
    leaves = stored(rows.select(*[c.alias(n) for n, c in named.items()]), "merkle-leaves")
    trees = manifest(leaves, ["key"], arity, every)
    subs = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest")
    top = manifest(subs, ["key"], arity, every)
    none = F.array().cast(PROOF)
    roots = top.roots.select("tree", F.col("digest").alias("root"), none.alias("proof"))
    tops = extracted(top, roots).select(F.col("key").alias("tree"), F.col("digest").alias("subroot"), "root", "proof")
    found = extracted(trees, stored(tops, "merkle-tops"))
    return found.select(F.col("group").alias(group), F.col("key").alias(key), F.col("digest").alias(digest),
                        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "subroot", "root", "proof")
