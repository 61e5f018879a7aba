"""Best-fit packing of tokenised documents into sequences, by patterns of lengths.

Only a histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. There,
patterns of few lengths that fill a sequence are enumerated over length classes, their
repeat counts are fitted to the histogram by non-negative least squares and rounded down, and
the pieces left are packed into the space left and into new sequences by best fit, longest
first, all pieces of one length at a time. The outcome is a table of slots ("ranks 500 to 900
of length 117 go to sequences 40 to 440 at offset 3979"), which the pieces are joined to by
their length and their rank within it.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitgate.llm.hashing import chunks, prefix_hashes, span_hashes, text_bytes
from pitgate.llm.tables import small_batches, stored

END_ID = 1
CLASSES = 256
DEPTH = 3
RANKED_TOGETHER = 20_000
TOGETHER = 64
CACHED_WORDS = 1_000_000


class WordTokens:
    """Token ids of words. A word is encoded once while it stays in the cache, which knows words
    by 64-bit hashes; words go to the tokenizer some at a time, and its tokens are told apart by
    where they start."""

    def __init__(self, path: str):
        # Spark's tasks are the parallelism; threads of the tokenizer would come on top of them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [words[k:k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        found = self.tokenizer.encode_batch([" ".join(run) for run in runs], add_special_tokens=False)
        size = np.array([len(w) + 1 for w in words], np.int64)
        counts = []
        for k, e in enumerate(found):
            own = size[k * TOGETHER:(k + 1) * TOGETHER]
            ends = np.cumsum(own)
            first = np.array([start for start, _ in e.offsets], np.int64)
            counts.append(np.bincount(np.searchsorted(ends, first, "right"), minlength=len(own)))
        return np.concatenate([np.array(e.ids, np.uint32) for e in found]), np.concatenate(counts)

    def __call__(self, words: pa.Array) -> np.ndarray:
        """Places of the different ``words`` in the cache (``ids[at[i]:at[i + 1]]``)."""
        if len(self.hashes) > CACHED_WORDS:
            self.clear()
        data, at = text_bytes(words)
        hashes = span_hashes(prefix_hashes(data), at[:-1], at[1:])
        where = np.searchsorted(self.hashes, hashes)
        known = np.append(self.hashes, np.uint64(0))[where] == hashes
        known &= where < len(self.hashes)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            fresh = fresh[np.argsort(hashes[fresh])]
            ids, size = self._encode(words.take(pa.array(fresh)).to_pylist())
            into, first = where[fresh], len(self.hashes)
            self.hashes = np.insert(self.hashes, into, hashes[fresh])
            self.place = np.insert(self.place, into, np.arange(first, first + len(fresh)))
            self.ids = np.concatenate((self.ids, ids))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(size)))
            where = np.searchsorted(self.hashes, hashes)
        return self.place[where]


def _token_ids(tokens: WordTokens, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts and ``len + 1`` offsets, each text ended by ``END_ID``.

    No token crosses ASCII white space, so each word is encoded by itself.
    """
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = words.flatten().dictionary_encode()
    word_at = words.offsets.to_numpy().astype(np.int64)
    word_at -= word_at[0]
    place = tokens(coded.dictionary)
    flat = place[coded.indices.to_numpy()] if len(place) else np.zeros(0, np.int64)
    size = tokens.at[flat + 1] - tokens.at[flat]
    ends = np.concatenate(([0], np.cumsum(size)))
    pick = np.repeat(tokens.at[flat] - ends[:-1], size) + np.arange(ends[-1])
    ids = tokens.ids[pick]
    at = ends[word_at]
    return np.insert(ids, at[1:], END_ID), at + np.arange(len(at))


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                 capacity: int = 4096, keep_ids: bool = True) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` and, if wanted, ``ids``: the pieces of each text.

    A text's ids end with ``END_ID``; a null or empty text has that one only. Only what exceeds
    ``capacity`` is cut. ``tokenizer`` is the path of a ``tokenizers`` file whose
    pre-tokenizer splits at white space; it must exist on every executor. The checksum is over little-endian unsigned 32-bit ids.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(tokenizer)
        for batch in batches:
            for part in chunks(batch, 1, 1 << 20):
                ids, at = _token_ids(tokens, part.column(1))
                size = np.diff(at)
                pieces = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                low = at[row] + start
                raw = ids.astype("<u4")
                sums = [zlib.crc32(raw[a:a + k].tobytes()) for a, k in zip(low, length, strict=True)]
                out = {"id": part.column(0).take(pa.array(row)), "piece": pa.array(piece.astype(np.int32)),
                       "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(sums, pa.int64())}
                if keep_ids:
                    out["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.append(low, low[-1] + length[-1]) if len(low) else [0], pa.int32()),
                        pa.array(raw.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    picked = small_batches(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")))
    kind = picked.schema["id"].dataType.simpleString()
    shape = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return picked.mapInArrow(cut, shape).withColumnRenamed("id", key)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    active = np.zeros(0, np.int64)
    inner = np.zeros((0, 0))  # products of the active columns only: all pairs of patterns would be hundreds of MB
    least = 1e-6 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a[:, active] @ x[active])
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= least or len(active) == len(b):
            break
        cross = a[:, active].T @ a[:, best]
        inner = np.block([[inner, cross[:, None]], [cross[None, :], np.array([[a[:, best] @ a[:, best] + 1e-9]])]])
        active = np.append(active, best)
        while len(active):
            trial = np.linalg.solve(inner, a[:, active].T @ b)
            if (trial > 0).all():
                x[active] = trial
                break
            low = trial <= 0
            now = x[active]
            step = np.min(now[low] / np.maximum(now[low] - trial[low], 1e-300))
            now = now + step * (trial - now)
            x[active] = 0
            stay = now > 1e-9
            active, inner = active[stay], inner[np.ix_(stay, stay)]
            x[active] = now[stay]
    return x


class Plan:
    """Slots of sequences, filled in bulk. A group is a run of sequences filled alike."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = dict(counts)
        self.used = dict.fromkeys(counts, 0)
        self.capacity, self.sequences = capacity, 0
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[list[int]]] = {}
        self.spaces: list[int] = []

    def put(self, length: int, base: int, n: int, offset: int) -> None:
        """The next ``n`` pieces of a length go to ``n`` sequences from ``base``."""
        rank = self.used[length]
        self.slots.append((length, rank, rank + n, base, offset))
        self.used[length] += n
        self.left[length] -= n

    def keep(self, base: int, n: int, offset: int) -> None:
        space = self.capacity - offset
        if n and space:
            if not self.open.get(space):
                bisect.insort(self.spaces, space)
                self.open[space] = []
            self.open[space].append([base, n])

    def new(self, lengths: list[int], n: int) -> None:
        offset = 0
        for length in lengths:
            self.put(length, self.sequences, n, offset)
            offset += length
        self.keep(self.sequences, n, offset)
        self.sequences += n

    def pack_rest(self) -> None:
        """Best fit, longest first: the fullest sequences that have room, else new ones."""
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                at = bisect.bisect_left(self.spaces, length)
                if at == len(self.spaces):
                    each = min(self.capacity // length, self.left[length])
                    self.new([length] * each, self.left[length] // each)
                    continue
                space = self.spaces[at]
                base, n = self.open[space].pop()
                if not self.open[space]:
                    del self.open[space], self.spaces[at]
                take = min(n, self.left[length])
                self.put(length, base, take, self.capacity - space)
                self.keep(base, take, self.capacity - space + length)
                self.keep(base + take, n - take, self.capacity - space)


def pattern_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Fit patterns of at most ``DEPTH`` length classes that fill a sequence, then the rest."""
    plan = Plan(counts, capacity)
    classes = min(CLASSES, capacity)
    of = lambda length: -(-length * classes // capacity)  # noqa: E731  rounded up: a pattern always fits
    lengths: dict[int, list[int]] = {}
    for length in sorted(counts):
        lengths.setdefault(of(length), []).append(length)
    there, sizes = sorted(lengths), sorted(counts)
    patterns = [p for k in range(1, DEPTH + 1) for p in combinations_with_replacement(there, k - 1)
                for p in [(*p, classes - sum(p))] if p[-1] in lengths and (k == 1 or p[-1] >= p[-2])]
    if patterns:
        row = {c: i for i, c in enumerate(there)}
        a = np.zeros((len(there), len(patterns)))
        for j, p in enumerate(patterns):
            for c in p:
                a[row[c], j] += 1
        b = np.array([sum(counts[x] for x in lengths[c]) for c in there], float)
        # Long classes weigh more: short pieces fill what space is left.
        weight = np.sqrt(np.array(there) / classes)
        fitted = nnls(a * weight[:, None], b * weight)
        for j in np.argsort(-fitted):
            todo = int(fitted[j])
            while todo > 0:
                picked: list[int] = []
                free = dict(plan.left)
                for i, c in enumerate(reversed(patterns[j])):
                    length = next((x for x in reversed(lengths[c]) if free[x]), 0)
                    if not length:
                        break
                    if i == len(patterns[j]) - 1:  # the shortest may be longer than its class: what fits best
                        room = bisect.bisect_right(sizes, capacity - sum(picked))
                        length = next(x for x in reversed(sizes[:room]) if free[x])
                    free[length] -= 1
                    picked.append(length)
                if len(picked) < len(patterns[j]):
                    break
                most = min(plan.left[x] // picked.count(x) for x in set(picked))
                n = min(todo, most)
                plan.new(picked, n)
                todo -= n
    plan.pack_rest()
    return plan


def pack(pieces: DataFrame, order: tuple[str, ...], length: str = "length", capacity: int = 4096) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: their places in sequences of ``capacity``.

    Pieces of one length are interchangeable; ``order`` ranks them, so that the same rows get
    the same places again. Rows equal in ``order`` may swap places. No rows give no rows; a
    length of null, below 1 or above ``capacity`` is an error.
    """
    spark = pieces.sparkSession
    found = pieces.groupBy(F.col(length).cast("long").alias("l")).count().collect()
    counts = {r["l"]: r["count"] for r in found}
    if any(x is None or not 0 < x <= capacity for x in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    plan = pattern_plan(counts, capacity)
    slots = spark.createDataFrame(plan.slots or [(0, 0, 0, 0, 0)], "l long, low long, high long, base long, offset long")
    dealt = max(1, -(-sum(counts.values()) // RANKED_TOGETHER))
    rows = pieces.withColumns({
        "l": F.col(length).cast("long"), "deal": F.pmod(F.xxhash64(*order), F.lit(dealt))})
    sizes = rows.groupBy("l", "deal").agg(F.count("*").alias("n"))
    before = Window.partitionBy("l").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("l", "deal").orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(own) - 1).join(starts, ["l", "deal"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(slots, "l").where("rank >= low and rank < high")
    return placed.select(*pieces.columns, (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def packed_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                     capacity: int = 4096, keep_ids: bool = True) -> DataFrame:
    """The pieces of :func:`token_pieces` with their places of :func:`pack`.

    Null and empty texts are pieces of one id; a null key is kept; repeated rows are pieces of
    their own; other columns are not looked at; an empty table gives no rows.
    """
    pieces = stored(token_pieces(docs, tokenizer, key, text, capacity, keep_ids), "token-pieces")
    return pack(pieces, (key, "piece", "ids_crc32"), capacity=capacity)
