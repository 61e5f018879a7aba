"""Hard negatives by a multiway hyperplane tree whose splits know their ranges (GNAT).

A node has several split points, vectors far from each other; a row goes to the nearest. For every two
split points i and j the node holds the least and the greatest distance from i to the rows of j. A query
with a window of distances goes down to a child only if, seen from every split point, the child's range
meets the ring that the window and the query's distance to that point allow. Leaves are searched exactly.

* Scores are inner products. One more component gives all rows the same length, so a score is a distance
  from the query, and a window of scores is an annulus around it.
* Split points are fitted on a bounded sample (:data:`SAMPLE` rows, those with the smallest hashes of the
  id); all rows are dealt to leaves, and the ranges are those of all rows.
* The sample's own scores bound what a query still looks for, before the tree is searched. The result is
  exact, as what is left out lies outside of windows or behind rows already known.
* A leaf is dealt into parts of about :data:`PART` rows. A task holds one part, and the queries that visit it
  stream past; rows are not copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgate.llm.tables import stored

SAMPLE = 16_384
BRANCHES = 16
LEAF = 1_024
PART = 16_384
TOGETHER = 64
SLACK = 1e-7
EXACT = float(1 << 53)


def usable(rows: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """``id, label, v``: components times 256, rounded down. Rows with a null in any of the three, or with a
    null or non-finite component, or none, are left out."""
    x = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.select(F.col(f"`{key}`").cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
    good = good.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & ~odd)
    return good.select("id", "label", F.transform("x", lambda c: F.floor(256 * c)).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` and ``b``; by floating point only where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with one more component, which gives all the squared length ``longest``."""
    x = x.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))))


def apart(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of all rows to all points."""
    squares = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * x @ points.T
    return np.sqrt(np.maximum(squares, 0))


def _far_points(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``k`` different rows, each the farthest from those before among some drawn at random."""
    drawn = x[rng.choice(len(x), min(3 * k, len(x)), replace=False)]
    chosen, left = [0], apart(drawn, drawn[:1])[:, 0]
    while len(chosen) < k and left.max() > SLACK:
        chosen.append(int(left.argmax()))
        left = np.minimum(left, apart(drawn, drawn[chosen[-1:]])[:, 0])
    return drawn[chosen]


def fit_tree(x: np.ndarray, seed: int = 11, leaf_rows: int | None = None, branches: int = BRANCHES) -> dict:
    """``points`` and ``children`` of each inner node; a child is a node's number, or ``-1 - leaf``.

    The root is node 0. A tree of one leaf has no nodes.
    """
    most = LEAF if leaf_rows is None else leaf_rows
    rng = np.random.default_rng(seed)
    points, children, leaves = [], [], 0
    todo = [(None, 0, x)]
    while todo:
        parent, place, rows = todo.pop(0)
        split = _far_points(rows, branches, rng) if len(rows) > most else rows[:0]
        if len(split) < 2:
            child, leaves = -1 - leaves, leaves + 1
        else:
            child = len(points)
            points.append(split)
            children.append(np.zeros(len(split), np.int64))
            owner = apart(rows, split).argmin(axis=1)
            todo.extend((child, j, rows[owner == j]) for j in range(len(split)))
        if parent is not None:
            children[parent][place] = child
    return {"points": points, "children": children, "leaves": leaves}


def _walk(tree: dict, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes from the root down: ``(node, rows there, their distances to its points, the child each takes)``."""
    todo = [(0, np.arange(len(x)))] if len(x) and tree["points"] else []
    while todo:
        node, rows = todo.pop()
        far = apart(x[rows], tree["points"][node])
        owner = far.argmin(axis=1)
        yield node, rows, far, owner
        for j, child in enumerate(tree["children"][node]):
            if child >= 0 and (owner == j).any():
                todo.append((int(child), rows[owner == j]))


def leaf_of(tree: dict, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for node, rows, _, owner in _walk(tree, x):
        child = tree["children"][node][owner]
        out[rows[child < 0]] = -1 - child[child < 0]
    return out


def ranges_of(tree: dict, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per node, the least and greatest distance from point i to rows of child j; inf and -inf without rows."""
    out = [(np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)) for p in tree["points"]]
    for node, _, far, owner in _walk(tree, x):
        low, high = out[node]
        for j in np.unique(owner):
            own = far[owner == j]
            low[:, j], high[:, j] = np.minimum(low[:, j], own.min(axis=0)), np.maximum(high[:, j], own.max(axis=0))
    return out


def visited(tree: dict, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(query, leaf)``: the leaves that may hold rows at a distance of ``near`` to ``far`` from each query."""
    if not tree["points"]:
        return np.arange(len(q)), np.zeros(len(q), np.int64)
    who, where, todo = [], [], [(0, np.arange(len(q)))]
    while todo:
        node, rows = todo.pop()
        low, high = tree["ranges"][node]
        from_points = apart(q[rows], tree["points"][node])[:, :, None]
        least = np.maximum(low - from_points, from_points - high).max(axis=1)
        most = (from_points + high).min(axis=1)
        open_ = (least <= far[rows, None]) & (most >= near[rows, None])
        for j, child in enumerate(tree["children"][node]):
            some = rows[open_[:, j]]
            if not len(some):
                continue
            if child >= 0:
                todo.append((int(child), some))
            else:
                who.append(some)
                where.append(np.full(len(some), -1 - child))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *who]), np.concatenate([none, *where])


def _annulus(q: np.ndarray, low: np.ndarray, high: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """The distances at which rows of scores from ``low`` to ``high`` are."""
    whole = (q.astype(np.float64)**2).sum(axis=1) + longest
    slack = SLACK * np.sqrt(whole)
    near, far = (np.sqrt(np.maximum(whole - 2 * s, 0)) for s in (high, low))
    return near - slack, far + slack


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` best rows, ties to smaller ids."""
    some = np.arange(len(score))
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def _kth(score: np.ndarray, k: int) -> float:
    """The ``k``-th best score, -inf where there are fewer."""
    return float(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else -np.inf


def _indexed(rows: DataFrame, tree, longest: float) -> DataFrame:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = leaf_of(tree.value, lengthened(matrix(batch.column(2)), longest))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "id", "label", "v"])

    return rows.mapInArrow(deal, "leaf long, id long, label long, v array<long>")


def _all_ranges(index: DataFrame, tree, longest: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ranges over all rows. Tasks send a row for each two points of a node at most."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for node, (low, high) in enumerate(ranges_of(tree.value, lengthened(matrix(batch.column(0)), longest))):
                    i, j = np.nonzero(high >= 0)
                    yield pa.RecordBatch.from_pydict({"node": np.full(len(i), node), "i": i, "j": j,
                                                      "low": low[i, j], "high": high[i, j]})

    shape = "node long, i long, j long, low double, high double"
    found = index.select("v").mapInArrow(measure, shape).groupBy("node", "i", "j").agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
    out = ranges_of(tree.value, np.zeros((0, 1)))
    for r in found.toLocalIterator():
        out[r["node"]][0][r["i"], r["j"]], out[r["node"]][1][r["i"], r["j"]] = r["low"], r["high"]
    return out


def _met(index: DataFrame, visits: DataFrame, parts: dict[int, int],
         answer: Callable[[dict, pa.RecordBatch], pa.RecordBatch], shape: str) -> DataFrame:
    """``answer(rows of a part, some of the queries that visit it)`` for every part of a leaf."""
    many = F.element_at(F.create_map(*[F.lit(int(x)) for kv in parts.items() for x in kv]), F.col("leaf").cast("int"))
    own = index.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), many.cast("long")))
    asked = [F.lit(None).cast(f.dataType).alias(f.name) for f in visits.schema if f.name not in ("leaf", "part")]
    rows = own.select("leaf", "part", F.lit(0).alias("tag"), "id", "label", "v", *asked)
    asks = visits.select("leaf", "part", F.lit(1).alias("tag"), F.lit(None).cast("long").alias("id"),
                         F.lit(None).cast("long").alias("label"), F.lit(None).cast("array<long>").alias("v"),
                         *[c for c in visits.columns if c not in ("leaf", "part")])
    both = rows.unionByName(asks).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "tag")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                run = batch.slice(a, b - a)
                if tuple(keys[:2, a]) != here:
                    here, held, block = tuple(keys[:2, a]), [], None
                if keys[2, a] == 0:
                    held.append((run.column(3).to_numpy(), run.column(4).to_numpy(), matrix(run.column(5))))
                    continue
                if block is None and held:
                    block = dict(zip(("id", "label", "v"), (np.concatenate(x) for x in zip(*held, strict=True)), strict=True))
                for first in range(0, run.num_rows if block else 0, TOGETHER):
                    yield answer(block, run.slice(first, TOGETHER).select(list(range(6, run.num_columns))))

    return both.mapInArrow(stream, shape)


_POSITIVES = "anchor_id long, anchor long, anchor_label long, q array<long>, positive_id long, positive_score long"
_NEGATIVES = "anchor_id long, anchor long, positive_rank int, positive_id long, positive_score long, negative_id long, negative_score long"


def hard_negatives(rows: DataFrame, label: Column, anchors: Column, key: str = "vec_id", vector: str = "embedding",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A row is ``floor(256 * x)`` of its components; a score is the integer inner product with the anchor, higher
    first, ties to smaller keys. ``anchors`` is a condition on ``id``. An anchor's positives are its first other
    rows of its label; each with the first rows of other labels that score ``low`` to ``high`` percent of it.

    Rows with a null key, label or vector, an empty vector, or a null or non-finite component take no part. All
    vectors must be of one length. An anchor's other rows are those of another key. Repeated rows are
    candidates of their own; an anchor that is repeated is one, and anchors that share a key but not label and
    vector are answered each. Without candidates, or in an empty table, there are no rows. Other columns are
    not looked at. Scores that 64 bits do not hold are not defined.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    good = stored(usable(rows, key, vector, label), "gnat-rows")
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    longest = good.agg(F.max(squares)).first()[0]
    if longest is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    longest *= 1 + 1e-9
    sample = good.orderBy(F.xxhash64("id", F.lit(2)), "id", F.xxhash64("v")).limit(SAMPLE).toArrow()
    seed_rows = matrix(sample["v"].combine_chunks())
    tree = fit_tree(lengthened(seed_rows, longest))
    seeds = context.broadcast((sample["id"].to_numpy(), sample["label"].to_numpy(), seed_rows))
    index = stored(_indexed(good, context.broadcast(tree), longest), "gnat-leaves")
    tree["ranges"] = _all_ranges(index, context.broadcast(tree), longest)
    parts = {r["leaf"]: -(-r["n"] // PART) for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    shared = context.broadcast((tree, parts))

    def dealt(who: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(query, leaf, part)`` of every part of the leaves."""
        many = np.array([shared.value[1].get(leaf, 0) for leaf in where.tolist()], np.int64)
        first = np.repeat(np.cumsum(many) - many, many)
        return np.repeat(who, many), np.repeat(where, many), np.arange(len(first)) - first

    def ask_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = seeds.value
        for whole in batches:
            for first in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(first, TOGETHER)
                own, tag, q = batch.column(0).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(3))
                score = scores(q, vectors)
                least = np.array([_kth(score[i][(labels == tag[i]) & (ids != own[i])], positives) for i in range(len(q))])
                near, far = _annulus(q, least, np.full(len(q), np.inf), longest)
                who, where, part = dealt(*visited(shared.value[0], lengthened_query(q), near, far))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where), pa.array(part), *[c.take(pa.array(who)) for c in batch.columns],
                     pa.array(least[who])], ["leaf", "part", "anchor_id", "anchor", "anchor_label", "q", "least"])

    def lengthened_query(q: np.ndarray) -> np.ndarray:
        return np.column_stack((q.astype(np.float64), np.zeros(len(q))))

    def find_positives(block: dict, asked: pa.RecordBatch) -> pa.RecordBatch:
        own, tag, least = (asked.column(k).to_numpy() for k in (0, 2, 4))
        score = scores(matrix(asked.column(3)), block["v"])
        who, row = [], []
        for i in range(len(own)):
            fits = np.flatnonzero((block["label"] == tag[i]) & (block["id"] != own[i]) & (score[i] >= least[i]))
            best = fits[best_of(score[i][fits], block["id"][fits], positives)]
            who.extend([i] * len(best))
            row.extend(best)
        who, row = np.array(who, np.int64), np.array(row, np.int64)
        return pa.RecordBatch.from_arrays(
            [*[asked.column(k).take(pa.array(who)) for k in range(4)], pa.array(block["id"][row]),
             pa.array(score[who, row])], ["anchor_id", "anchor", "anchor_label", "q", "positive_id", "positive_score"])

    asking = index.where(anchors).select(
        F.col("id").alias("anchor_id"), F.xxhash64("label", "v").alias("anchor"), F.col("label").alias("anchor_label"),
        F.col("v").alias("q")).distinct()
    visits = asking.mapInArrow(ask_positives, "leaf long, part long, anchor_id long, anchor long, anchor_label long, "
                                              "q array<long>, least double")
    found = _met(index, visits, parts, find_positives, _POSITIVES)
    order = Window.partitionBy("anchor_id", "anchor").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("positive_rank", F.row_number().over(order)).where(F.col("positive_rank") <= positives)
    # At most ``positives`` rows an anchor.
    windows = stored(found.groupBy("anchor_id", "anchor").agg(
        F.any_value("anchor_label").alias("anchor_label"), F.any_value("q").alias("q"),
        F.array_sort(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("w")).select(
        "anchor_id", "anchor", "anchor_label", "q", F.col("w.positive_rank").alias("ranks"),
        F.col("w.positive_id").alias("ids"), F.col("w.positive_score").alias("scores")), "gnat-windows")

    def within(score: np.ndarray, positive: int) -> np.ndarray:
        return (100 * score >= low * positive) & (100 * score <= high * positive)

    def ask_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, vectors = seeds.value
        for whole in batches:
            for first in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(first, TOGETHER)
                tag, q = batch.column(2).to_numpy(), matrix(batch.column(3))
                score = scores(q, vectors)
                at = np.concatenate(([0], np.cumsum([len(x) for x in batch.column(6)])))
                owner = np.repeat(np.arange(len(q)), np.diff(at))
                rank, ids, positive = (batch.column(k).flatten().to_numpy() for k in (4, 5, 6))
                least = np.empty(len(owner))
                for k, i in enumerate(owner):
                    known = score[i][(labels != tag[i]) & within(score[i], positive[k])]
                    least[k] = max(_kth(known, negatives), low * positive[k] / 100)
                near, far = _annulus(q[owner], least, high * positive / 100, longest)
                empty = low * positive > high * positive
                who, where = visited(shared.value[0], lengthened_query(q[owner]), near, far)
                who, where, part = dealt(who[~empty[who]], where[~empty[who]])
                some = pa.array(owner[who])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where), pa.array(part), *[batch.column(k).take(some) for k in range(4)],
                     *[pa.array(x[who]) for x in (rank, ids, positive, least)]],
                    ["leaf", "part", "anchor_id", "anchor", "anchor_label", "q", "rank", "positive_id", "positive_score", "least"])

    def find_negatives(block: dict, asked: pa.RecordBatch) -> pa.RecordBatch:
        tag, least = asked.column(2).to_numpy(), asked.column(7).to_numpy()
        positive = asked.column(6).to_numpy()
        score = scores(matrix(asked.column(3)), block["v"])
        who, row = [], []
        for i in range(len(tag)):
            fits = np.flatnonzero((block["label"] != tag[i]) & (score[i] >= least[i]) & within(score[i], positive[i]))
            best = fits[best_of(score[i][fits], block["id"][fits], negatives)]
            who.extend([i] * len(best))
            row.extend(best)
        who, row = np.array(who, np.int64), np.array(row, np.int64)
        some = pa.array(who)
        return pa.RecordBatch.from_arrays(
            [*[asked.column(k).take(some) for k in (0, 1, 4, 5, 6)], pa.array(block["id"][row]), pa.array(score[who, row])],
            ["anchor_id", "anchor", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"])

    visits = windows.mapInArrow(ask_negatives, "leaf long, part long, anchor_id long, anchor long, anchor_label long, "
                                               "q array<long>, rank int, positive_id long, positive_score long, least double")
    mined = _met(index, visits, parts, find_negatives, _NEGATIVES)
    order = Window.partitionBy("anchor_id", "anchor", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    return (mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                    "positive_score", "negative_score"))
