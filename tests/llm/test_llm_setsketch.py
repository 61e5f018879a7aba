import random

import numpy as np
import pytest

from cases import documents, odd_rows, words
from pitgate.llm import setsketch
from pitgate.llm.setsketch import BANDS, bands, estimated, forest, likely, merged, registers, sketch_components
from test_llm_ngram_join import brute, grams


def found(spark, rows, n=5, percent=85):
    out = sketch_components(documents(spark, rows), n=n, percent=percent).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=repr)


def sets_of(rng, similarity, size):
    """Two sets of ``size`` members with about this similarity, as hashes."""
    common = round(2 * size * similarity / (1 + similarity))
    x = rng.integers(0, 1 << 56, 2 * size - common)
    return x[:size], np.concatenate((x[:common], x[size:]))


def sketched(*sets):
    return registers(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))))


def counts(a, b):
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    return more, less, a.shape[1] - more - less


def test_sketch_of_a_union_is_the_merged_one():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 1 << 56, 300), rng.integers(0, 1 << 56, 40)
    a, b, both = sketched(x, y, np.concatenate((x, y)))
    assert (merged(a, b) == both).all()
    assert (sketched(x[::-1], y)[0] == a).all()


def test_empty_sets_have_empty_registers():
    out = registers(np.array([5]), np.array([0, 0, 1, 1]))
    assert not out[0].any() and out[1].any() and not out[2].any()


@pytest.mark.parametrize("similarity", [0.1, 0.5, 0.85, 0.95])
def test_likelihood_finds_the_similarity(similarity):
    rng = np.random.default_rng(2)
    pairs = [sets_of(rng, similarity, 300) for _ in range(60)]
    a, b = sketched(*[p[0] for p in pairs]), sketched(*[p[1] for p in pairs])
    size = np.full(60, 300)
    got = estimated(*counts(a, b), size, size)
    assert abs(got.mean() - similarity) < 0.02 and got.std() < 0.07


def test_no_linked_pair_is_dropped_and_far_ones_are():
    rng = np.random.default_rng(3)
    for similarity, keeps in ((0.86, True), (0.4, False)):
        pairs = [sets_of(rng, similarity, 200) for _ in range(200)]
        a, b = sketched(*[p[0] for p in pairs]), sketched(*[p[1] for p in pairs])
        size = np.full(200, 200)
        assert (likely(a, b, size, size, 85)[0] == keeps).all()
        if keeps:
            assert (bands(a) == bands(b)).any(axis=1).all() and bands(a).shape[1] == BANDS


def test_far_sets_share_no_band():
    rng = np.random.default_rng(4)
    keys = bands(sketched(*[rng.integers(0, 1 << 56, 50) for _ in range(400)]))
    assert len(np.unique(keys)) == keys.size


def test_forest_joins_as_all_pairs_do_with_the_best_ones():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 60, 300), rng.integers(0, 60, 300)
    score = rng.random(300)

    def parts(rows):
        root = list(range(60))
        for i in rows:
            a, b = root[x[i]], root[y[i]]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    best, root = [], list(range(60))
    for i in np.argsort(-score):
        if root[x[i]] != root[y[i]]:
            best.append(i)
            root = parts(best)
    assert sorted(forest(x, y, score, 60)) == sorted(best)
    assert parts(best) == parts(range(300))
    assert len(forest(x[:0], y[:0], score[:0], 60)) == 0


@pytest.mark.parametrize(("n", "percent"), [(5, 85), (5, 80), (3, 90)])
def test_chains_and_copies_equal_brute_force(spark, n, percent):
    rng = random.Random(n * percent)
    rows, k = [], 500
    for base in range(10):
        text = words(rng.randrange(20, 300), base).split()
        for _ in range(rng.randrange(1, 12)):
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = f"Edit{rng.randrange(99)}"
            rows.append((k := k - 1, " ".join(text)))
    assert found(spark, rows, n, percent) == brute(rows, n, percent)


def test_large_group_around_the_threshold(spark):
    rng = random.Random(9)
    base = words(120, 50).split()
    rows = []
    for i in range(900):
        text = list(base)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = f"Edit{rng.randrange(9999)}"
        rows.append((i, " ".join(text)))
    assert found(spark, rows) == brute(rows, 5, 85)


def test_codes_bound_the_intersection_closely():
    rng = np.random.default_rng(6)
    sets = [rng.choice(3000, rng.integers(1, 900), replace=False) * np.int64(97_531) for _ in range(30)]
    packed = [np.frombuffer(setsketch.codes(s), np.uint16).astype(np.int64) for s in sets]
    x, y = np.triu_indices(30, 1)
    got = setsketch.most_common(np.concatenate(packed), np.concatenate(([0], np.cumsum([len(s) for s in sets]))), x, y)
    true = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y, strict=True)])
    assert (got >= true).all() and (got - true).mean() < 20
    assert not len(setsketch.most_common(np.zeros(0, np.int64), np.zeros(1, np.int64), x[:0], y[:0]))
    assert setsketch.codes(np.arange(setsketch.CODED + 1)) == b""


def test_copies_just_below_the_threshold_do_not_meet_in_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    base = words(120, 51).split()
    rows = []
    for i in range(300):
        text = list(base)
        for at in rng.sample(range(0, 120, 6), 2):
            text[at] = f"Edit{rng.randrange(9999)}"
        rows.append((i, " ".join(text)))
    made, kept = [], setsketch.stored

    def counted(df, name):
        out = kept(df, name)
        if name == "sketch-cross":
            made.append(out.count())
        return out

    monkeypatch.setattr(setsketch, "stored", counted)
    assert found(spark, rows) == brute(rows, 5, 85)
    assert sum(made) < 600


def test_sets_without_codes_are_judged_by_likelihood(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "codes", lambda members: b"")
    rng = random.Random(12)
    base = words(120, 52).split()
    rows = []
    for i in range(80):
        text = list(base)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = f"Edit{rng.randrange(9999)}"
        rows.append((i, " ".join(text)))
    assert found(spark, rows) == brute(rows, 5, 85)


def test_odd_cases(spark):
    rows = [r[:2] for r in odd_rows()]
    assert found(spark, rows, 5, 85) == brute(rows, 5, 85)


def test_key_of_several_texts_joins_what_they_link(spark):
    one, two = words(60, 1), words(60, 2)
    rows = [(3, one), (5, one), (5, two), (9, two), (None, one)]
    size = len(grams(one, 5)), len(grams(two, 5))
    assert found(spark, rows) == sorted(
        [(3, size[0], 3), (5, size[0], 3), (5, size[1], 3), (9, size[1], 3), (None, size[0], None)], key=repr)


def test_short_texts_compare_as_whole_sequences(spark):
    rows = [(1, "Same words"), (2, "same  WORDS"), (3, "words same"), (4, "same"), (5, "same words again")]
    assert found(spark, rows) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 4), (5, 1, 5)]


def test_empty_table(spark):
    assert found(spark, []) == []
