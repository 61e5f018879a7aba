import random
import re

import pytest

from cases import documents, odd_rows, words
from pitgate.llm.ngram_join import ngram_components


def grams(text, n):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(ws) < n:
        return frozenset([tuple(ws)] if ws else [])
    return frozenset(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))


def brute(rows, n, percent):
    sets = [(k, grams(t, n)) for k, t in rows if k is not None]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return sorted(((k, len(grams(t, n)), None if k is None else find(k)) for k, t in rows), key=repr)


def found(spark, rows, n, percent, **more):
    out = ngram_components(documents(spark, rows), n=n, percent=percent, bits=10, **more)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_chains_and_copies_equal_brute_force(spark, n, percent):
    rng = random.Random(n)
    rows, k = [], 100
    for base in range(12):
        text = words(rng.randrange(20, 200), base).split()
        for _ in range(rng.randrange(1, 9)):
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = f"Edit{rng.randrange(99)}"
            rows.append((k := k - 1, " ".join(text)))
    shared = words(60, 77)
    rows += [(200 + i, f"{shared} {words(rng.randrange(3, 9), i)}") for i in range(25)]
    assert found(spark, rows, n, percent) == brute(rows, n, percent)


def test_odd_cases(spark):
    rows = [r[:2] for r in odd_rows()]
    assert found(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_short_texts_compare_as_whole_sequences(spark):
    rows = [(1, "Same words"), (2, "same  WORDS"), (3, "words same"), (4, "same"), (5, "same words again")]
    assert found(spark, rows, 3, 90) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 4), (5, 1, 5)]


def test_empty_table(spark):
    assert found(spark, [], 3, 90) == []
