import random

import pytest

import pitgate.llm.suffix_dedup as module
from cases import documents, odd_rows, words
from pitgate.llm.suffix_dedup import repeated_offsets, repeated_spans, suffix_order, verified_order


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for s in range(len(b) - length + 1):
            seen[b[s:s + length]] = seen.get(b[s:s + length], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        out.append((len(b), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def check(spark, rows, length=200):
    df = repeated_spans(documents(spark, rows), length=length)
    got = sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in df.collect()), key=repr)
    assert got == sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], length))), key=repr)


def passages():
    rng = random.Random(4)
    shared = [words(rng.randrange(30, 90), 900 + i) for i in range(5)]
    rows = []
    for i in range(60):
        parts = [words(rng.randrange(5, 60), i)]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            a, b = sorted(rng.sample(range(len(s)), 2))
            parts += [s[a:b] if rng.random() < 0.5 else s, words(rng.randrange(0, 9), 1000 + i)]
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("group", [module.GROUP, 12, 1])
def test_passages_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(module, "GROUP", group)
    check(spark, passages())


def test_odd_cases(spark):
    check(spark, [r[:2] for r in odd_rows() if r[0] not in (5, 6)] + [(10, "ab" * 400), (11, words(400, 9) + " " + words(400, 9))])


def test_empty_table(spark):
    check(spark, [])


def test_suffix_order_equals_sorted_bytes():
    import numpy as np

    rng = random.Random(2)
    raw = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    data = np.frombuffer(b"".join(raw) + b"z", np.uint8)
    size = np.array([len(x) for x in raw])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    group = np.sort(np.array([rng.randrange(9) for _ in raw]))
    from pitgate.llm.hashing import prefix_hashes

    order, shared = suffix_order(data, prefix_hashes(data), start, size, group)
    assert [(group[i], raw[i]) for i in order] == sorted(zip(group, raw))
    assert verified_order(data, start, size, group)[1].tolist() == shared.tolist()


def test_a_hash_collision_is_seen(monkeypatch):
    import numpy as np

    contexts = [bytes([97 + i]) * 300 for i in range(3)]
    monkeypatch.setattr(module, "prefix_hashes", lambda data: np.zeros(len(data) + 1, np.uint64))
    left = np.full(3, 100)
    least, most = np.zeros(3, int), np.full(3, 168)
    assert not repeated_offsets(contexts, left, np.zeros(3, int), 200, least, most).any()
