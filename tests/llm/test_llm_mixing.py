import re

import pytest
from pyspark.sql import functions as F

from cases import documents, odd_rows, words
from pitgate.llm.mixing import BLOCK, mixed_blocks, mixed_documents, mixed_words, permuted, targets


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_stop_at_three_times_the_size():
    out = targets([1000, 10, 10, 500, 0], [1, 2, 3, 1, 2])
    assert out[1] == 30 and out[2] == 30 and out[4] == 0 and sum(out) == pytest.approx(1520)
    assert out[0] == pytest.approx(out[3]) and targets([], []) == [] and targets([0, 0], [1, 2]) == [0, 0]
    assert targets([7], [1]) == [7]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_hits_every_index_once(spark, n):
    df = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("x"))
    assert sorted(r["x"] for r in df.collect()) == list(range(n))


def corpus():
    rows = [(i, words(20 + i % 90, i), ["a", "b", "c", None, "é"][i % 5]) for i in range(400)]
    return rows + [r[:3] for r in odd_rows()]


def test_words_come_near_their_targets(spark):
    rows = corpus()
    out = mixed_words(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in out), key=repr) == sorted(((k, count(t)) for k, t, _ in rows), key=repr)
    sums = {}
    for r in out:
        assert r["taken"] <= 3 * r["size"]
        s = sums.setdefault((r["source_size"], r["target"]), [0])
        s[0] += r["taken"]
    for (_, target), (taken,) in sums.items():
        assert abs(taken - target) <= 2 * BLOCK
    again = mixed_words(documents(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_blocks_cover_documents_word_by_word(spark):
    docs, placed = mixed_blocks(documents(spark, corpus()))
    per_slot = placed.groupBy("shard", "slot", "number").agg(F.sum("n_words").alias("n")).collect()
    assert max(r["n"] for r in per_slot) <= BLOCK
    bad = (placed.join(docs, ["number", "at"]).where("size > 0")
           .where("first_word < 0 or n_words < 1 or first_word + n_words > size"))
    assert bad.count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    docs = documents(spark, corpus())
    taken = {}
    for r in mixed_words(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    found = {}
    texts = {}
    for k, t, _ in corpus():
        texts.setdefault(k, []).append(re.sub(r"\s+", " ", t or "").strip())
    for r in out.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + count(r["text"])
        assert count(r["text"]) > 0
    assert found == {k: v for k, v in taken.items() if v}


def test_empty_table(spark):
    assert mixed_words(documents(spark, [])).collect() == []
    assert mixed_documents(documents(spark, [])).collect() == []
