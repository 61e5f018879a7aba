"""Toxicity: subword-bag embeddings, averaged into a linear softmax, trained jointly.

A text is the bag of its words' subwords: each word and its character n-grams of 3 to 5
between boundary marks, hashed into :data:`BUCKETS` rows. The text's vector is the mean of its
subwords' embeddings; a softmax over two outputs reads it. Embeddings and output weights are
trained together by stochastic gradient descent in numpy, on a bounded sample of the
labelled rows (:data:`SAMPLE`, those with the smallest hashes). A misspelling shares most
n-grams, and so most of its vector, with the word it comes from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgate.llm.hashing import chunks, letter_grams, unique_words
from pitgate.llm.langid import bounded_sample
from pitgate.llm.tables import small_batches

SAMPLE = 6_000
BUCKETS = 1 << 16
WIDTH = 4
EPOCHS = 16
BATCH = 32
RATE = 4000.0
LEAST_TEXTS = 3
APART = r"[^\p{L}\p{M}\p{N}]+"


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's subwords, and the word each belongs to; sorted by word."""
    found = [letter_grams(words, n) for n in (3, 4, 5)]
    whole = np.array([hash_of for hash_of in _whole(words)], np.uint64)
    hashes = np.concatenate([whole, *[h for h, _ in found]])
    owner = np.concatenate([np.arange(len(words)), *[o for _, o in found]])
    order = np.argsort(owner, kind="stable")
    return (hashes[order] & np.uint64(BUCKETS - 1)).astype(np.int64), owner[order]


def _whole(words: pa.Array) -> np.ndarray:
    """One hash per word: the sum of its letters' hashes at their places."""
    grams, owner = letter_grams(words, 2)
    first = np.searchsorted(owner, np.arange(len(words)))
    place = np.arange(len(grams)) - first[owner]
    with np.errstate(over="ignore"):
        mixed = grams * (2 * place + 0x51ED270B).astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    ends = np.append(first[1:], len(grams))
    out = total[ends] - total[first]
    return out ^ (out >> np.uint64(29))


def _bags(labelled: DataFrame) -> DataFrame:
    """``label, buckets, shares``: each text's subwords and their shares of the bag."""
    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                words, index, at = unique_words(part.column(1), APART)
                bucket, owner = subwords(words)
                starts = np.searchsorted(owner, np.arange(len(words) + 1))
                labels, buckets, shares = [], [], []
                for label, a, b in zip(part.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                    used, many = np.unique(index[a:b], return_counts=True)
                    size = starts[used + 1] - starts[used]
                    pick = np.repeat(starts[used] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    ids, back = np.unique(bucket[pick], return_inverse=True)
                    total = np.bincount(back, weights=np.repeat(many, size), minlength=len(ids))
                    labels.append(label)
                    buckets.append(ids.astype(np.int32))
                    shares.append((total / max(total.sum(), 1)).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels, pa.int32()), pa.array(buckets, pa.list_(pa.int32())),
                     pa.array(shares, pa.list_(pa.float32()))], ["label", "buckets", "shares"])

    return labelled.mapInArrow(bag, "label int, buckets array<int>, shares array<float>")


def fit(labels: np.ndarray, buckets: list[np.ndarray], shares: list[np.ndarray], seed: int = 1) -> tuple[np.ndarray, float]:
    """Joint training; returns what a subword adds to the log odds, per bucket, and the bias.

    Shares of a bag are small numbers, hence the large rate for embeddings. Subwords of fewer
    than :data:`LEAST_TEXTS` texts stay at zero.
    """
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weight = rng.normal(0, 1, (WIDTH, 2)).astype(np.float32)
    texts = np.bincount(np.concatenate(buckets), minlength=BUCKETS)
    common = texts >= LEAST_TEXTS
    shares = [s[common[b]] for s, b in zip(shares, buckets, strict=True)]
    buckets = [b[common[b]].astype(np.int64) for b in buckets]
    embed[~common] = 0
    flat, lanes = embed.reshape(-1), np.arange(WIDTH)
    bias = np.log(np.array([(labels == 0).sum() + 1, (labels == 1).sum() + 1]) / (len(labels) + 2)).astype(np.float32)
    steps, step = EPOCHS * -(-len(labels) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            some = order[k:k + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            ids = np.concatenate([buckets[i] for i in some])
            share = np.concatenate([shares[i] for i in some])[:, None]
            size = np.array([len(buckets[i]) for i in some])
            row = np.repeat(np.arange(len(some)), size)
            ends = np.concatenate(([0], np.cumsum(size)))
            running = np.zeros((len(ids) + 1, WIDTH), np.float64)
            np.cumsum(embed[ids] * share, axis=0, out=running[1:])
            mean = running[ends[1:]] - running[ends[:-1]]
            logits = mean @ weight + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            odds[np.arange(len(some)), labels[some]] -= 1
            slope = odds / len(some)
            to_mean = (slope @ weight.T).astype(np.float32)
            weight -= (min(rate, 0.1) * (mean.T @ slope)).astype(np.float32)
            bias -= (min(rate, 0.1) * slope.sum(axis=0)).astype(np.float32)
            np.add.at(flat, (ids[:, None] * WIDTH + lanes).reshape(-1), (np.float32(-rate) * to_mean[row] * share).reshape(-1))
    return embed @ (weight[:, 1] - weight[:, 0]), float(bias[1] - bias[0])


def train(labelled: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id",
          sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model of a bounded sample of rows with a label of 0 or 1. Without rows: no opinion."""
    rows = labelled.where(F.col(f"`{label}`").isin(0, 1)).select(
        F.col(f"`{label}`").cast("int").alias("label"), F.col(f"`{text}`").alias("text"),
        F.col(f"`{key}`").alias("key"))
    found = _bags(small_batches(bounded_sample(rows, "key", sample)).select("label", "text")).toArrow()
    if not found.num_rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    buckets = [np.asarray(x) for x in found["buckets"].to_numpy()]
    shares = [np.asarray(x) for x in found["shares"].to_numpy()]
    return fit(found["label"].to_numpy(), buckets, shares)


def toxic_scores(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` for every row: how likely label 1 is, on the whole text.

    A null, empty or wordless text is scored by the bias alone. Repeated rows give a row each;
    other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adds, bias = shared.value
        for batch in batches:
            for part in chunks(batch, 1):
                words, index, at = unique_words(part.column(1), APART)
                bucket, owner = subwords(words)
                total = np.bincount(owner, weights=adds[bucket], minlength=len(words))
                many = np.bincount(owner, minlength=len(words))
                sums = []
                for x in (total, many):
                    running = np.concatenate(([0.0], np.cumsum(x[index])))
                    sums.append(running[at[1:]] - running[at[:-1]])
                odds = sums[0] / np.maximum(sums[1], 1) + bias
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(1 / (1 + np.exp(-np.clip(odds, -50, 50))))], ["id", "score"])

    picked = small_batches(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(score, f"id {kind}, score double").withColumnRenamed("id", key)
