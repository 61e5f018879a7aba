"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted in numpy on a bounded sample of unit vectors (:data:`SAMPLE`, those with the
smallest hashes of the id); every row is then dealt to a leaf. A query goes down to the
nearest child, keeps the children it passes in a priority queue by distance, and takes up the
best of them next: the order in which leaves are visited. How many leaves are visited is
calibrated: trial queries are answered exactly from all rows, and the number of visits is
widened until their recall is reached; other trial queries then measure the recall.

A leaf is searched where its rows are. Its rows are dealt into parts of about :data:`PART` rows, so a
vector that fills a third of the table is many parts. A task holds one part, and the queries that visit
the leaf stream past it; rows are not copied, whatever the number of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitgate.llm.langid import bounded_sample
from pitgate.llm.tables import stored

SAMPLE = 50_000
BRANCHES = 8
LEAF = 1_500
ROUNDS = 8
TRIALS = 192
LEAST_LEAF = 64
PART = 4_000
TOGETHER = 256
WALKED = 64
SLACK = 1e-9


@dataclass
class Tree:
    """Nodes in one list; ``leaf`` is a leaf's number or -1, ``children`` the rows of a node's children."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max(initial=-1)) + 1


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(ROUNDS):
        owner = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        for j in range(k):
            own = x[owner == j]
            if len(own):
                centres[j] = own.mean(axis=0)
    owner = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
    return centres, owner


def fit_tree(x: np.ndarray, seed: int = 5, leaf_rows: int | None = None) -> Tree:
    """Split by k-means until a node has ``leaf_rows`` (:data:`LEAF`) rows or no two different ones."""
    most = LEAF if leaf_rows is None else leaf_rows
    rng = np.random.default_rng(seed)
    centres = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])]
    children: list[np.ndarray] = [np.zeros(0, np.int64)]
    leaf = [-1]
    todo = [(0, np.arange(len(x)))]
    leaves = 0
    while todo:
        node, rows = todo.pop()
        own = x[rows]
        parts = []
        if len(rows) > most and (own != own[0]).any():
            found, owner = _kmeans(own, BRANCHES, rng)
            parts = [(found[j], rows[owner == j]) for j in range(BRANCHES) if (owner == j).any()]
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        first = len(centres)
        children[node] = np.arange(first, first + len(parts))
        for centre, some in parts:
            centres.append(centre)
            children.append(np.zeros(0, np.int64))
            leaf.append(-1)
            todo.append((len(centres) - 1, some))
    return Tree(np.array(centres), children, np.array(leaf, np.int64))


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf each vector goes down to."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if tree.leaf[node] >= 0:
            out[rows] = tree.leaf[node]
            continue
        below = tree.children[node]
        centres = tree.centres[below]
        nearest = np.argmax(x[rows] @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        todo.extend((int(c), rows[nearest == j]) for j, c in enumerate(below))
    return out


def leaf_order(tree: Tree, query: np.ndarray, visits: int) -> list[int]:
    """The first ``visits`` leaves of a best-bin-first walk."""
    apart = ((tree.centres - query)**2).sum(axis=1)
    queue, out = [(0.0, 0)], []
    while queue and len(out) < visits:
        _, node = heapq.heappop(queue)
        while tree.leaf[node] < 0:
            below = tree.children[node]
            best = below[np.argmin(apart[below])]
            for c in below:
                if c != best:
                    heapq.heappush(queue, (float(apart[c]), int(c)))
            node = int(best)
        out.append(int(tree.leaf[node]))
    return out


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v``: rows whose vector is neither null nor empty nor zero and wholly finite, as doubles."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / size


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best rows of each query by exact cosine, ties to smaller ids.

    A matrix product finds what may be among the best; those are computed one by one, in an order
    of additions that does not depend on the block.
    """
    size, query_size = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    near = (q @ x.T) / query_size[:, None] / size
    out = []
    for i in range(len(q)):
        row = near[i]
        other = ids != query_ids[i]
        own = row[other]
        if not len(own):
            continue
        least = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -np.inf
        some = np.flatnonzero(other & (row >= least - SLACK))
        score = (x[some] * q[i]).sum(axis=1) / (size[some] * query_size[i])
        best = np.lexsort((ids[some], -score))[:k]
        out.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": ids[some][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
        {"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _broadcast(spark: SparkSession, tree: Tree):
    """Plain arrays, which workers without this package can read."""
    return spark.sparkContext.broadcast((tree.centres, tree.children, tree.leaf))


def _index(rows: DataFrame, tree: Tree) -> DataFrame:
    """``leaf, id, v, place`` of every row, ``place`` its number in its task."""
    shared = _broadcast(rows.sparkSession, tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = Tree(*shared.value), 0
        for batch in batches:
            if batch.num_rows:
                leaves = leaf_of(own, _unit(_matrix(batch.column(1))))
                place = np.arange(done, done + batch.num_rows)
                done += batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(leaves), *batch.columns, pa.array(place)],
                                                 ["leaf", "id", "v", "place"])

    return rows.mapInArrow(deal, "leaf long, id long, v array<double>, place long")


def trial_queries(index: DataFrame, fitted: int | None, trials: int) -> pa.Table:
    """``id, v`` of rows by a hash other than the sample's; first those that the tree was not fitted
    on, whose hash is above ``fitted``."""
    rows = index.select("id", "v")
    inside = F.lit(False) if fitted is None else F.xxhash64("id") <= F.lit(fitted)
    return rows.orderBy(inside, F.xxhash64("id", F.lit(7)), "id", F.xxhash64("v")).limit(trials).toArrow()


def calibrate(index: DataFrame, tree: Tree, recall: float, k: int, trials: int = TRIALS,
              fitted: int | None = None) -> tuple[int, float]:
    """``(visits, recall)``: the fewest leaves with which every other trial query finds this share of its
    ``k`` true neighbours, which a search of all rows, block by block, gives; and the share that the
    queries between them, which had no part in the choice, then find."""
    sample = trial_queries(index, fitted, trials)
    ids, q = sample["id"].to_numpy(), _matrix(sample["v"].combine_chunks())
    shared = index.sparkSession.sparkContext.broadcast((ids, q))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = shared.value
        for batch in batches:
            if batch.num_rows:
                own = batch.column(1).to_numpy()
                found = nearest(own, _matrix(batch.column(2)), query_ids, vectors, k)
                leaf = batch.column(0).to_numpy()
                found["leaf"] = leaf[pd.Index(own).get_indexer_for(found["vec_id"])] if own.size == len(
                    np.unique(own)) else pd.Series(leaf, own).groupby(level=0).first().loc[found["vec_id"]].to_numpy()
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    true = _best(index.mapInArrow(exact, "query_id long, vec_id long, score double, leaf long"), k).toPandas()
    place, chooses = {}, {}
    for n, (i, query) in enumerate(zip(ids, _unit(q), strict=True)):
        place[i] = {leaf: at for at, leaf in enumerate(leaf_order(tree, query, tree.leaves))}
        chooses[i] = n % 2 == 0
    needed = np.array([place[a][b] + 1 for a, b in zip(true["query_id"], true["leaf"], strict=True)], np.int64)
    if not len(needed):
        return 1, 1.0
    choosing = np.array([chooses[a] for a in true["query_id"]])
    choice = np.sort(needed[choosing] if choosing.any() else needed)
    visits = int(choice[max(int(np.ceil(recall * len(choice))) - 1, 0)])
    others = needed[~choosing] if not choosing.all() else needed
    return visits, float((others <= visits).mean())


def leaf_rows(rows: int, sampled: int) -> int:
    """How many rows of the sample a leaf may have: :data:`LEAF` rows of the table, as far as the sample
    can tell so many leaves apart (:data:`LEAST_LEAF`)."""
    return max(min(LEAF, LEAST_LEAF), LEAF * sampled // max(rows, 1))


def dealt_parts(index: DataFrame, queries: DataFrame, tree: Tree, visits: int) -> DataFrame:
    """``leaf, part, query_id, id, v``: each row once, in a part of its leaf of about :data:`PART` rows, with a
    null ``query_id``; and each query once for every part of the leaves that it visits, with a null ``id``."""
    spark = index.sparkSession
    sizes = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    many = [-(-sizes.get(leaf, 0) // PART) for leaf in range(tree.leaves)]
    shared, parts = _broadcast(spark, tree), spark.sparkContext.broadcast(many)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree(*shared.value)
        for whole in batches:
            for first in range(0, whole.num_rows, WALKED):
                batch = whole.slice(first, WALKED)
                row, leaf, part = [], [], []
                for i, query in enumerate(_unit(_matrix(batch.column(1)))):
                    for visited in leaf_order(own, query, visits):
                        for p in range(parts.value[visited]):
                            row.append(i)
                            leaf.append(visited)
                            part.append(p)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf, pa.int64()), pa.array(part, pa.int64()), batch.column(0).take(take),
                     batch.column(1).take(take)], ["leaf", "part", "query_id", "v"])

    walked = queries.mapInArrow(walk, "leaf long, part long, query_id long, v array<double>")
    part = F.pmod(F.xxhash64("id", "place"), F.get(F.lit(many), F.col("leaf").cast("int")).cast("long"))
    nothing = F.lit(None).cast("long")
    return index.select("leaf", part.alias("part"), nothing.alias("query_id"), "id", "v").unionByName(
        walked.select("leaf", "part", "query_id", nothing.alias("id"), "v"))


def _searched(parts: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of a part for each query that visits it. Rows come first; they are held, and the
    queries are answered as they stream past."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            asks = np.asarray(batch.column(2).is_valid().to_numpy(zero_copy_only=False), bool)
            cuts = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(part) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if (leaf[a], part[a]) != here:
                    here, held, block = (leaf[a], part[a]), [], None
                run = batch.slice(a, b - a)
                if not asks[a]:
                    held.append((run.column(3).to_numpy(), _matrix(run.column(4))))
                    continue
                if block is None and held:
                    block = [np.concatenate(x) for x in zip(*held, strict=True)]
                for first in range(0, run.num_rows if block else 0, TOGETHER):
                    some = run.slice(first, TOGETHER)
                    found = nearest(*block, some.column(2).to_numpy(), _matrix(some.column(4)), k)
                    yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    together = parts.repartition("leaf", "part").sortWithinPartitions("leaf", "part", F.col("query_id").asc_nulls_first())
    return together.mapInArrow(stream, "query_id long, vec_id long, score double")


def neighbours(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding",
               k: int = 5, recall: float = 0.96) -> DataFrame:
    """``query_id, rank, vec_id, score, visits, trial_recall``: the ``k`` nearest rows found for each query, itself
    excepted. ``visits`` is the number of leaves each query was searched in, ``trial_recall`` the share of their
    true neighbours that trial queries found in so many (see :func:`calibrate`).

    ``rows`` are all candidates, ``queries`` has the same columns. Score is the cosine in double
    precision on the original vectors; ties go to the smaller id. Rows with a null id, or a
    vector that is null, zero or holds null or non-finite components, take no part. Repeated
    rows are candidates of their own, except those with the query's id. All vectors taken
    must be of one length. With fewer than ``k`` candidates all found are returned; an empty table
    gives none. Other columns are not looked at.
    """
    spark = rows.sparkSession
    good = usable(rows, key, vector)
    sample = bounded_sample(good, "id", SAMPLE).select("id", "v", F.xxhash64("id").alias("h")).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visits int, trial_recall double")
    tree = fit_tree(_unit(_matrix(sample["v"].combine_chunks())), leaf_rows=leaf_rows(good.count(), sample.num_rows))
    index = stored(_index(good, tree), "leaves")
    visits, measured = calibrate(index, tree, recall, k, fitted=max(sample["h"].to_pylist()))
    parts = dealt_parts(index, usable(queries, key, vector).select(F.col("id").alias("query_id"), "v"), tree, visits)
    return _best(_searched(parts, k), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(visits).alias("visits"),
        F.lit(measured).alias("trial_recall"))
