import hashlib
import random

import numpy as np
import pytest

import pitgate.llm.imatch as module
from cases import documents, odd_rows, words
from pitgate.llm.imatch import edited_likeness, fingerprinted, lexicon


def corpus():
    return [(3 * i, words(60 + i % 50, i, 300)) for i in range(120)]


def run(spark, rows):
    docs = documents(spark, rows)
    return edited_likeness(docs, lexicon(docs)).collect()


@pytest.mark.parametrize("per_deal", [7, 100_000])
def test_edits_equal_brute_force(spark, monkeypatch, per_deal):
    monkeypatch.setattr(module, "PER_DEAL", per_deal)
    rows = corpus()[:60] + [(1000, None), (1001, ""), (1002, "ab"), (-5, "é😀" * 9), (1003, words(20_000, 5))]
    out = {r["doc_id"]: r for r in run(spark, rows)}
    ordered = sorted((k, t or "") for k, t in rows)
    alike = lambda a, b: np.mean([a[i:i + 8] == b[i:i + 8] for i in range(0, len(a), 8)])
    for i, (k, t) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + after[1][:cut]
        assert out[k]["n_chars"] == len(t)
        assert out[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert out[k]["near_edited"] == pytest.approx(alike(out[k]["fingerprint"], out[k]["edited_fingerprint"]))
        assert out[k]["near_next"] == pytest.approx(alike(out[k]["fingerprint"], out[after[0]]["fingerprint"]))


def test_edited_texts_are_nearer_than_others(spark):
    out = run(spark, corpus())
    assert np.median([r["near_edited"] for r in out]) > 0.35 and np.percentile([r["near_next"] for r in out], 95) < 0.2


def test_equal_texts_agree_and_odd_cases_run(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    out = run(spark, [r[:2] for r in rows])
    assert len(out) == len(rows)
    prints = {}
    text_of = {r[0]: r[1] or "" for r in rows}
    for r in fingerprinted(docs, lexicon(docs)).collect():
        prints.setdefault(text_of[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values()) and len({p for x in prints.values() for p in x}) == len(prints)


def test_one_row_and_no_rows(spark):
    only, = run(spark, [(5, "some words of one text")])
    assert only["near_next"] == 1.0
    assert run(spark, []) == []


def test_a_third_of_near_copies_stays_alike(spark):
    group = [f"{words(80, 7)} {words(2, 5000 + i)}" for i in range(80)] + [f"{words(80, 7)} end"] * 40
    rows = [(i, words(60 + i % 50, i, 300)) for i in range(240)] + [(1000 + i, text) for i, text in enumerate(group)]
    out = {r["doc_id"]: r for r in run(spark, rows)}
    assert min(out[1000 + i]["near_next"] for i in range(119)) > 0.5
    assert np.median([out[1000 + i]["near_edited"] for i in range(119)]) > 0.35
    assert np.percentile([out[i]["near_next"] for i in range(240)], 95) < 0.2


def test_texts_of_common_words_are_told_by_their_rarest(spark):
    common = words(30, 9).split()
    rows = [(i, " ".join(random.Random(i).sample(common + words(30, i, 100).split(), 60))) for i in range(120)]
    rows += [(900, " ".join(common)), (901, " ".join(common[::-1][1:]))]
    out = {r["doc_id"]: r for r in run(spark, rows)}
    assert out[900]["near_next"] > 0.5 and out[119]["near_next"] < 0.2
