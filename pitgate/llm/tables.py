"""Spark helpers of the operators: stored tables, bounded hashed counts, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgate.sources.writers import stored

__all__ = ["components", "hashed_counts", "levels", "small_batches", "stored"]

BLOCK = 1 << 14
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches are limited to about :data:`BATCH_BYTES` bytes.

    Ten thousand rows, the usual limit, are gigabytes where texts are long. A smaller limit that
    is set already stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def hashed_counts(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
                  bits: int) -> np.ndarray:
    """How many hashes fall into each of ``2**bits`` classes, over all rows.

    The table's size is fixed by ``bits``, whatever the input: each task counts into one
    table of its own and sends it in blocks, and the blocks of one number are added as they
    stream past, so no task holds more than a table. ``hashes`` gives arrays for a batch.
    """
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)
        for batch in batches:
            for found in hashes(batch):
                table += np.bincount(found & (size - 1), minlength=size)
        for k in range(0, size, BLOCK):
            part = table[k:k + BLOCK]
            if part.any():
                small = part.astype(np.uint32) if part.max() < 1 << 32 else part
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([k], pa.int64()), "counts": pa.array([small.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                length = min(BLOCK, size)
                part = np.frombuffer(raw, np.uint32 if len(raw) == 4 * length else np.int64)
                sums[k] = sums.get(k, 0) + part.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array(list(sums), pa.int64()),
                 "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    shape = "block long, counts binary"
    added = small_batches(rows).mapInArrow(count, shape).repartition("block").mapInArrow(add, shape)
    out = np.zeros(size, np.int64)
    for row in added.toLocalIterator():
        part = np.frombuffer(row["counts"], np.int64)
        out[row["block"]:row["block"] + len(part)] = part
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of 0 to 127, four steps to a doubling."""
    return np.minimum(4 * np.log2(np.maximum(counts, 1)), 127).astype(np.int8)


def release(df: DataFrame) -> None:
    """Have the driver's JVM collect garbage. Spark removes shuffles and broadcasts that nothing refers to any
    more only after that, and a driver with little garbage of its own may not collect for long."""
    df.sparkSession.sparkContext._jvm.System.gc()


def _stars(edges: DataFrame) -> bool:
    """Whether the distinct edges (a > b) lead from each node to the smallest of its component: no node has two smaller
    ones, or a smaller and a larger one. A further round would leave such edges as they are."""
    ends = (edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return nodes.where("up > 1 or (up > 0 and down > 0)").count() == 0


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b): the smallest node it is joined to.

    Alternates large and small stars until every edge ends at a node that has no smaller one; each round is written
    to the shared folder, and the shuffles before it are released. A node with very many links is a key of joins and combining
    aggregations only, which Spark can split.
    """
    edges = (links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
             .where("a > b").distinct())
    edges = stored(edges, name)
    release(edges)
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.where("a > m").select("a", F.col("m").alias("b")))
                 .where("a > b").distinct())
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(first, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(first.select("a", F.col("m").alias("b"))).where("a > b").distinct())
        edges = stored(small, name)
        release(edges)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
