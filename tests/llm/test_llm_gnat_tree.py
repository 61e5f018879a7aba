import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitgate.llm import gnat_tree
from pitgate.llm.gnat_tree import apart, fit_tree, hard_negatives, leaf_of, lengthened, ranges_of, scores, visited

SHAPE = "vec_id long, embedding array<float>, label int, id string, leaf string, part string, v string, anchor string"


def brute(rows, every=10, positives=5, negatives=10):
    good = []
    for i, x, label in rows:
        if i is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        good.append((i, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for a in {(i, label, tuple(x)) for i, label, x in good if i % every == 0}:
        scored = sorted((-sum(p * q for p, q in zip(a[2], x, strict=True)), i, label) for i, label, x in good if i != a[0])
        for s, p, _ in [r for r in scored if r[2] == a[1]][:positives]:
            fits = [(n, i) for n, i, label in scored if label != a[1] and 30 * -s <= 100 * -n <= 90 * -s]
            out += [(a[0], p, k, i, -s, -n) for k, (n, i) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def found(spark, rows, every=10):
    frame = spark.createDataFrame([(*r, *"abcde") for r in rows], SHAPE)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives(frame, label, F.col("id") % every == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def vectors(n, d=8, seed=0, clusters=0, labels=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if clusters:
        x = x / 20 + rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)]
    return [(i, [float(c) for c in x[i]], int(rng.integers(0, labels))) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(gnat_tree, "LEAF", 16)
    monkeypatch.setattr(gnat_tree, "PART", 24)
    monkeypatch.setattr(gnat_tree, "SAMPLE", 200)
    monkeypatch.setattr(gnat_tree, "BRANCHES", 4)


@pytest.mark.parametrize("clusters", [0, 12])
def test_equals_brute_force(spark, small, clusters):
    rows = vectors(700, seed=clusters, clusters=clusters)
    assert found(spark, rows) == brute(rows)


def test_one_leaf(spark):
    rows = vectors(300)
    assert found(spark, rows) == brute(rows)


def test_a_vector_that_fills_a_third_and_ties(spark, small):
    rows = vectors(400, d=4, labels=2)
    same = rows[5][1]
    rows = [(i, same if i % 3 == 0 else [round(c) for c in x], label) for i, x, label in rows]
    rows = [(i, [float(c) for c in x], label) for i, x, label in rows]
    assert found(spark, rows) == brute(rows)


def test_odd_rows_take_no_part(spark, small):
    rows = vectors(120, d=4)
    odd = [(500, None, 1), (600, [], 1), (700, [1.0, None, 0.0, 0.0], 1), (800, [1.0, float("nan"), 0.0, 0.0], 1),
           (900, [float("inf"), 0.0, 0.0, 0.0], 1), (1000, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1),
           (1100, [0.0] * 4, 1)]
    assert found(spark, rows + odd) == brute(rows + odd)


def test_repeated_rows_and_keys(spark, small):
    rows = vectors(90, d=4)
    rows = rows + rows[:30] + [(20, [1.0, 0.5, -1.0, 2.0], 2)]
    random.Random(1).shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_without_partners_and_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None, None)]) == []
    assert found(spark, [(10, [1.0, 2.0], 1)]) == []
    assert found(spark, [(10, [1.0, 2.0], 1), (11, [1.0, 2.0], 1), (12, [-1.0, 0.0], 2)]) == []


def test_annuli_leave_out_leaves_but_no_row():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 6)) * 300
    x = np.round(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 6)) * 10)
    longest = (x * x).sum(axis=1).max()
    whole = lengthened(x, longest)
    assert np.allclose((whole * whole).sum(axis=1), longest)
    tree = fit_tree(whole[:2000], leaf_rows=60, branches=8)
    tree["ranges"] = ranges_of(tree, whole)
    leaf, q = leaf_of(tree, whole), np.column_stack((x[::40], np.zeros(100)))
    score = scores(x[::40].astype(np.int64), x.astype(np.int64))
    top = score.max(axis=1)
    far = (q * q).sum(axis=1) + longest
    near, wide = (np.sqrt(np.maximum(far - 2 * share * top, 0)) for share in (0.9, 0.6))
    who, where = visited(tree, q, near - 1e-3, wide + 1e-3)
    seen = set(zip(who.tolist(), where.tolist(), strict=True))
    inside = (score >= 0.6 * top[:, None]) & (score <= 0.9 * top[:, None])
    assert inside.any() and all((i, leaf[j]) in seen for i, j in zip(*np.nonzero(inside), strict=True))
    assert len(seen) < 0.6 * 100 * tree["leaves"]


def test_scores_stay_whole_beyond_floating_point():
    a = np.array([[1 << 30, 3]], np.int64)
    assert scores(a, a)[0, 0] == (1 << 60) + 9
    assert apart(np.array([[0.0, 0.0]]), np.array([[3.0, 4.0]]))[0, 0] == 5
