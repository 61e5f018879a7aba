import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from cases import documents, odd_rows, words
from pitgate.llm.packing import nnls, packed_documents, pattern_plan, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def layout_is_sound(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pieces_equal_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [r[:2] for r in odd_rows()] + [
        (20, "It's <|endoftext|> and<|startoftext|>!! 12ab ÀÉ é x y\x85z ??%%%"), (21, "<|x <|endoftext|>")]
    capacity = 512
    out = token_pieces(documents(spark, rows), PATH, capacity=capacity).collect()
    want = []
    for k, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for i, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            want.append((k, i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], list(r["ids"])) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_packing_is_gapless_and_near_the_bound(spark):
    rows = [(i, words(random.Random(i).randrange(0, 120), i)) for i in range(300)] + [r[:2] for r in odd_rows()]
    out = packed_documents(documents(spark, rows), PATH, capacity=256, keep_ids=False).collect()
    n = layout_is_sound(out, 256)
    assert n <= 1.02 * -(-sum(r["length"] for r in out) // 256) + 1
    again = packed_documents(documents(spark, rows), PATH, capacity=256, keep_ids=False).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_empty_table(spark):
    assert packed_documents(documents(spark, []), PATH).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5 + seed / 2, 1.2, 5000).astype(int) + 1, 1, 4096)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = pattern_plan(counts, 4096)
    placed, places = {}, {}
    for length, low, high, base, offset in plan.slots:
        assert low == placed.get(length, 0)
        placed[length] = high
        for i in range(high - low):
            places.setdefault(base + i, []).append((offset, length))
    assert placed == counts and len(places) == plan.sequences
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert plan.sequences <= 1.003 * -(-int(lengths.sum()) // 4096) + 1


def test_least_squares_are_optimal():
    rng = np.random.default_rng(0)
    a, b = rng.random((20, 60)), rng.random(20) * 5
    x = nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-4 and abs(slope[x > 0]).max(initial=0) < 1e-4
