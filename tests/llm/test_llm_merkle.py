import hashlib
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from cases import CLASHING, N_CLASHING, odd_rows
from pitgate.llm.merkle import dataset_proofs, folded, leaf_digest, manifest, siblings_digest

SHAPE = f"doc_id long, text string, source string, lang string, {CLASHING}, tree string, digest string, pos string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def first_null(v, low):
    return (v is not None, low if v is None else v)


def grown(nodes, arity, paths):
    """The root of a list of nodes; ``paths[i]`` is extended by the siblings of leaf ``i``."""
    at = list(range(len(paths)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i // arity * arity
            paths[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + arity])))
        nodes = [sha(*nodes[k:k + arity]) for k in range(0, len(nodes), arity)]
        at = [i // arity for i in at]
    return nodes[0]


def brute(rows, arity):
    """``(doc_id, leaf, subroot, root, proof)`` of (doc_id, text, source, lang) rows."""
    leaves = sorted(((r[3], r[0], sha(*map(enc, r))) for r in rows),
                    key=lambda x: (first_null(x[0] and x[0].encode(), b""), first_null(x[1], 0), x[2]))
    trees = []
    for _, group in groupby(leaves, key=lambda x: x[0]):
        group = list(group)
        paths = [[] for _ in group]
        trees.append((grown([x[2] for x in group], arity, paths), group, paths))
    tops = [[] for _ in trees]
    root = grown([t[0] for t in trees], arity, tops) if trees else None
    return sorted(((x[1], x[2], sub, root, tuple(path + top)) for (sub, group, paths), top in zip(trees, tops, strict=True)
                   for x, path in zip(group, paths, strict=True)), key=repr)


def found(spark, rows, arity=8, every=3):
    docs = spark.createDataFrame([(*r, *["x"] * (N_CLASHING + 3)) for r in rows], SHAPE)
    leaf = leaf_digest(*[F.col(c) for c in ("doc_id", "text", "source", "lang")])
    out = dataset_proofs(docs.withColumn("leaf", leaf), "lang", "doc_id", "leaf", keep=["text"], arity=arity, every=every)
    assert out.columns == ["lang", "doc_id", "leaf", "text", "subroot", "root", "proof"]
    out = out.withColumn("again", folded(F.col("leaf"), F.col("proof"))).withColumn("all", siblings_digest(F.col("proof")))
    out = out.collect()
    assert all(r["again"] == r["root"] for r in out)
    assert all(r["all"] == sha(*(x for s in r["proof"] for x in (s["left"], s["right"]))) for r in out)
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["proof"]))
                   for r in out), key=repr)


@pytest.mark.parametrize(("arity", "every", "rows"), [(2, 1, 37), (2, 3, 130), (3, 2, 200), (8, 3, 1300)])
def test_trees_equal_those_made_whole(spark, arity, every, rows):
    rng = random.Random(rows)
    docs = [(i, f"text {i} é", rng.choice(["a", None]), rng.choices(["en", "de", "é", None, "zz"], [90, 3, 3, 3, 1])[0])
            for i in rng.sample(range(10 * rows), rows)]
    assert found(spark, docs, arity, every) == brute(docs, arity)


def test_lone_last_node_is_hashed_and_lone_leaf_is_a_root(spark):
    docs = [(i, "t", "s", "en") for i in range(9)] + [(100, "only", "s", "de")]
    out = found(spark, docs)
    assert out == brute(docs, 8)
    last = next(r for r in out if r[0] == 8)
    assert last[4][0] == ("", "") and next(r for r in out if r[0] == 100)[2] == sha(*map(enc, (100, "only", "s", "de")))


def test_more_trees_than_a_run(spark):
    docs = [(i, "t", None, f"l{i % 75}") for i in range(90)]
    assert found(spark, docs) == brute(docs, 8)


def test_odd_cases(spark):
    rows = [(r + (None,) * 4)[:4] for r in odd_rows()] * 2 + [(None, None, None, None)] * 9
    assert found(spark, rows) == brute(rows, 8)


def test_lone_leaves(spark):
    docs = [(1, "t", None, "en"), (2, "t", None, "de")]
    assert found(spark, docs) == brute(docs, 8)
    assert found(spark, docs[:1]) == brute(docs[:1], 8)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_only_some_levels_are_stored(spark):
    leaves = spark.range(600).selectExpr("'' tree", "id key", "sha2(cast(id as string), 256) digest")
    trees = manifest(leaves, ["key"])
    assert [level.count() for level in trees.levels] == [600, 2, 1]


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    rows = [(i, f"T{i}", "s", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    docs = docs.withColumn("leaf", leaf_digest(F.col("text"))).withColumn("claim", leaf_digest(F.lower("text")))
    out = dataset_proofs(docs, "lang", "doc_id", "leaf", keep=["claim"])
    assert out.where(folded(F.col("claim"), F.col("proof")) == F.col("root")).count() == 0
