import numpy as np
import pytest

import pitgate.llm.kmeans_tree as module
from pitgate.llm.kmeans_tree import fit_tree, leaf_of, leaf_order, neighbours

SHAPE = "vec_id long, embedding array<float>, id string, leaf string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x", "x", "x") for k, v in rows], SHAPE)


def brute(rows, every, k=5):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v
            and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            scored = sorted((-(q @ v) / np.sqrt(q @ q) / np.sqrt(v @ v), j) for j, v in good if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def found(spark, rows, every):
    df = frame(spark, rows)
    out = {}
    for r in neighbours(df, df.where(f"vec_id % {every} = 0")).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def vectors(n, seed=0, width=16):
    return [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32))]


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(module, "LEAF", 40)
    monkeypatch.setattr(module, "PART", 25)
    rows = vectors(1500)
    got, want = found(spark, rows, 10), brute(rows, 10)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * 5 * len(want)
    by = dict(rows)
    for q, best in got.items():
        for j, s in best:
            a, b = (np.array(by[x], np.float32).astype(float) for x in (q, j))
            assert s == pytest.approx(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), abs=1e-12)


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(30)] + [(100, [3.0, 2.0, 1.0])]
    got = found(spark, rows, 100)
    assert [j for j, _ in got[0]] == [1, 2, 3, 4, 5] and [j for j, _ in got[100]] == [0, 1, 2, 3, 4]


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (5, [1.0, None]), (None, [1.0, 1.0]), (10, [0.5, 0.5]), (11, []), (20, None)]
    assert {q: [j for j, _ in best] for q, best in found(spark, rows, 10).items()} == {0: [10], 10: [0]}


def test_empty_table(spark):
    assert found(spark, [], 10) == {}


def test_walk_visits_every_leaf_once_and_the_own_first(monkeypatch):
    monkeypatch.setattr(module, "LEAF", 20)
    x = np.array([v for _, v in vectors(600, 3, 4)])
    tree = fit_tree(x)
    own = leaf_of(tree, x)
    for i in range(0, 600, 50):
        order = leaf_order(tree, x[i], tree.leaves)
        assert sorted(order) == list(range(tree.leaves)) and order[0] == own[i]


def test_rows_of_a_leaf_are_dealt_into_parts_once_whatever_the_queries(spark, monkeypatch):
    monkeypatch.setattr(module, "LEAF", 100)
    monkeypatch.setattr(module, "PART", 50)
    monkeypatch.setattr(module, "TOGETHER", 25)
    rows = vectors(600) + [(1000 + i, [1.0] * 16) for i in range(200)] + [(5000, [1.0] * 16)] * 100
    got, want = found(spark, rows, 3), brute([r for r in rows if r[0] != 5000], 3)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want if q < 1000)
    assert got.keys() == want.keys() and hits >= 0.9 * 5 * sum(q < 1000 for q in want)
    all_rows = module.usable(frame(spark, rows), "vec_id", "embedding")
    tree = fit_tree(np.array([v for _, v in rows]))
    index = module._index(all_rows, tree)
    for every in (1, 30):
        queries = all_rows.where(f"id % {every} = 0").selectExpr("id as query_id", "v")
        parts = module.dealt_parts(index, queries, tree, tree.leaves)
        own, asks = parts.where("query_id is null"), parts.where("query_id is not null")
        assert own.count() == 900
        assert max(r["count"] for r in own.groupBy("leaf", "part").count().collect()) <= 100
        many = own.select("leaf", "part").distinct().count()
        assert asks.count() == many * queries.count()


def test_trial_recall_is_of_queries_that_did_not_choose(spark, monkeypatch):
    monkeypatch.setattr(module, "LEAF", 40)
    rows = vectors(1500)
    df = frame(spark, rows)
    out = neighbours(df, df.where("vec_id % 10 = 0"))
    (visits, recall), = {(r["visits"], r["trial_recall"]) for r in out.select("visits", "trial_recall").collect()}
    got, want = {}, brute(rows, 10)
    for r in out.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    real = sum(len(got[q] & {j for j, _ in want[q]}) for q in want) / (5 * len(want))
    assert 1 <= visits and abs(recall - real) < 0.08 and recall >= 0.9


def test_broadcasts_are_plain_arrays(spark):
    """A worker that lacks the package must be able to read them."""
    import pickletools
    import pickle

    tree = fit_tree(np.array([v for _, v in vectors(50)]))
    value = module._broadcast(spark, tree).value
    names = [arg for op, arg, _ in pickletools.genops(pickle.dumps(value)) if isinstance(arg, str)]
    assert not any("pitgate" in n for n in names)


def test_leaves_grow_with_the_table_and_trials_are_rows_not_fitted_on(spark, monkeypatch):
    monkeypatch.setattr(module, "LEAF", 100)
    assert [module.leaf_rows(n, min(n, 1000)) for n in (10, 1000, 1250, 10**9)] == [100, 100, 80, 64]
    monkeypatch.setattr(module, "SAMPLE", 400)
    seen = []
    inner = module.trial_queries
    monkeypatch.setattr(module, "trial_queries", lambda index, fitted, trials: seen.append(
        (fitted, inner(index, fitted, trials))) or seen[0][1])
    found(spark, vectors(800), 50)
    (fitted, trials), = seen
    hashes = spark.createDataFrame([(i,) for i in trials["id"].to_pylist()], "id long").selectExpr("xxhash64(id) as h")
    assert trials.num_rows == module.TRIALS and all(r["h"] > fitted for r in hashes.collect())
