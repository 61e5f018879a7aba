"""Words and shingles of many texts at once, as arrays of 64-bit hashes.

Texts come as Arrow arrays. A chunk of texts is one byte array; every step below works on
the whole chunk, so no Python code runs per word. Hashes are sums of byte codes times
powers of an odd base modulo 2**64, divided by the power of the start, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
SPACES = b" \t\n\x0b\x0c\r"
LOW_56 = (1 << 56) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int, inverse: bool = False, known: dict = {}) -> np.ndarray:  # noqa: B006
    """The first ``n`` powers of the base, or of its inverse; kept between calls."""
    if inverse not in known or len(known[inverse]) < n:
        base = pow(BASE, -1, 1 << 64) if inverse else BASE
        steps = np.full(max(n, CHUNK_BYTES + (1 << 16)), base, np.uint64)
        steps[0] = 1
        known[inverse] = np.cumprod(steps, dtype=np.uint64)
    return known[inverse][:n]


def byte_codes(fold_case: bool) -> np.ndarray:
    """A 64-bit code per byte; with ``fold_case`` A-Z have the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


def prefix_hashes(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """``len(data) + 1`` running sums; see :func:`span_hashes`."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes(fold_case)[data] * powers(len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span; equal bytes have equal hashes wherever they stand."""
    raw = (sums[end] - sums[start]) * powers(len(sums), inverse=True)[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and ``len + 1`` offsets; a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes in a text column, one row at least."""
    _, at = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        end = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        end = min(max(end, first + 1), batch.num_rows)
        yield batch.slice(first, end - first)
        first = end


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and ``len + 1`` offsets
    of the texts' words."""
    solid = np.ones(256, bool)
    solid[list(SPACES)] = False
    inside = solid[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with A-Z lower-cased, and ``len + 1`` offsets of the texts' words."""
    start, end, words_at = word_bounds(data, at)
    return span_hashes(prefix_hashes(data, fold_case=True), start, end), words_at


def shingle_hashes(words: np.ndarray, words_at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """56-bit hashes of the runs of ``n`` words of each text, copies included, and offsets.

    A text with one to ``n - 1`` words has one shingle, its whole sequence.
    """
    counts = np.diff(words_at)
    many = np.maximum(counts - n + 1, (counts > 0).astype(counts.dtype))
    out_at = np.concatenate(([0], np.cumsum(many)))
    if not out_at[-1]:
        return np.zeros(0, np.int64), out_at
    text = np.repeat(np.arange(len(counts)), many)
    start = words_at[text] + np.arange(out_at[-1]) - out_at[text]
    size = np.minimum(counts[text], n)
    total = np.full(len(start), 0x2545F4914F6CDD1D, np.uint64) * size.astype(np.uint64)
    for j in range(n):
        there = j < size
        part = mix(words[np.where(there, start + j, 0)] + np.uint64((j + 1) * 0xE7037ED1A0B428DB & (1 << 64) - 1))
        total += np.where(there, part, np.uint64(0))
    return (mix(total) & np.uint64(LOW_56)).astype(np.int64), out_at


def unique_words(texts: pa.Array, apart: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct lower-cased words of the texts, each word's number in the order of the texts,
    and ``len + 1`` offsets. ``apart``: an RE2 pattern of what stands between words."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    words = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, apart, " "))
    at = words.offsets.to_numpy().astype(np.int64)
    flat = words.flatten()
    real = np.asarray(pc.not_equal(flat, "").to_numpy(zero_copy_only=False), bool)
    coded = flat.filter(pa.array(real)).dictionary_encode()
    counted = np.concatenate(([0], np.cumsum(real)))
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), counted[at - at[0]]


def letter_grams(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-character grams of words between boundary marks, and the number of
    the word each belongs to. A word shorter than its grams has none."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    joined = "\x02" + "\x03\x02".join(words.to_pylist()) + "\x03"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.cumsum(code == 2) - 1
    many = max(len(code) - n + 1, 0)
    total = np.full(many, n, np.uint64)
    for j in range(n):
        total = mix(total + code[j:j + many] * np.uint64(0x9E3779B97F4A7C15))
    inside = owner[:many] == owner[n - 1:n - 1 + many]
    inside &= ~((n == 1) & (code[:many] < 4))
    return total[inside], owner[:many][inside]
