"""Language identification: known words first, then ever shorter character n-grams.

A word known from training counts by its log frequency in each language. An unseen word falls
back to its known 4-grams, without any to its 3-grams, and so on to single letters; the mean
of their log frequencies counts. The text's language has the best mean over its words.

Counts are made by Spark on a bounded sample of the labelled rows (:data:`SAMPLE` rows, those
with the smallest hashes); the tables hold the :data:`WORDS` most frequent words and
:data:`GRAMS` most frequent n-grams per language, so their size is bounded too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitgate.llm.hashing import chunks, letter_grams, unique_words
from pitgate.llm.tables import small_batches

SAMPLE = 10_000
LONGEST = 4
APART = r"[^\p{L}\p{M}]+"
UNSEEN = 0.5
SHARPNESS = 4.0


@dataclass
class Model:
    """Log frequencies per language of words, and of n-grams by sorted hash and length."""

    langs: list[str]
    words: pa.Array
    word_scores: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray]]


def bounded_sample(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest hashes of ``order``, at most.

    Rows that share ``order`` follow the hash of the whole row, and equal rows count as one, so a value of
    ``order`` that many rows share, or a null, does not make the sample larger.
    """
    hashed = rows.withColumn("_h", F.xxhash64(order))
    least = hashed.select("_h").orderBy("_h").limit(limit + 1).toArrow()["_h"].to_numpy()
    if len(np.unique(least)) == len(least):
        return hashed.where(F.col("_h") <= F.lit(int(least[:limit].max(initial=-1 << 63)))).drop("_h")
    hashed = hashed.withColumn("_t", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    h, t = (hashed.select("_h", "_t").distinct().orderBy("_h", "_t").limit(limit)
            .agg(F.max(F.struct("_h", "_t"))).first()[0])
    chosen = hashed.where((F.col("_h") < h) | ((F.col("_h") == h) & (F.col("_t") <= t)))
    return chosen.dropDuplicates(["_h", "_t"]).drop("_h", "_t")


def _counts(labelled: DataFrame) -> DataFrame:
    """``lang, n, word, gram, count``: words (n = 0) and n-gram hashes of each language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)):
                own = batch.filter(pc.equal(batch.column(0), lang))
                for part in chunks(own, 1, 2 << 20):
                    words, index, _ = unique_words(part.column(1), APART)
                    many = np.bincount(index, minlength=len(words))
                    for n in range(LONGEST + 1):
                        if n:
                            hashes, owner = letter_grams(words, n)
                            gram, back = np.unique(hashes, return_inverse=True)
                            total = np.bincount(back, weights=many[owner], minlength=len(gram))
                            word = pa.nulls(len(gram), pa.string())
                            gram = pa.array(gram.astype(np.int64))
                        else:
                            word, gram, total = words.cast(pa.string()), pa.nulls(len(words), pa.int64()), many
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang.as_py()] * len(total), pa.string()),
                             pa.array(np.full(len(total), n, np.int32)), word, gram,
                             pa.array(total.astype(np.int64))], ["lang", "n", "word", "gram", "count"])

    made = labelled.mapInArrow(count, "lang string, n int, word string, gram long, count long")
    return made.groupBy("lang", "n", "word", "gram").agg(F.sum("count").alias("count"))


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id",
          sample: int = SAMPLE) -> Model:
    """Fit the tables. Rows without language or text teach nothing; without any rows the model
    knows no language."""
    rows = labelled.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"),
        F.col(f"`{key}`").alias("key"))
    chosen = small_batches(bounded_sample(rows, "key", sample)).select("lang", "text")
    found = _counts(chosen).toArrow()
    langs = sorted(pc.unique(found["lang"]).to_pylist())
    if not langs:
        return Model([], pa.array([], pa.string()), np.zeros((0, 0)), {n: (np.zeros(0, np.uint64), np.zeros((0, 0))) for n in range(1, LONGEST + 1)})

    def scores(part: pa.Table, column: str) -> tuple[pa.Array, np.ndarray]:
        items = pc.unique(part[column])
        row = pc.index_in(part[column], items).to_numpy()
        col = pc.index_in(part["lang"], pa.array(langs)).to_numpy()
        count = part["count"].to_numpy()
        total = np.bincount(col, weights=count, minlength=len(langs))
        out = np.tile(np.log(UNSEEN / (np.maximum(total, 1) + len(items))), (len(items), 1))
        out[row, col] = np.log(count / (total[col] + len(items)))
        return items, out.astype(np.float32)

    words, word_scores = scores(found.filter(pc.equal(found["n"], 0)), "word")
    grams = {}
    for n in range(1, LONGEST + 1):
        items, values = scores(found.filter(pc.equal(found["n"], n)), "gram")
        hashes = items.to_numpy().astype(np.uint64)
        order = np.argsort(hashes)
        grams[n] = hashes[order], values[order]
    return Model(langs, words, word_scores, grams)


def word_scores(model: Model, words: pa.Array) -> np.ndarray:
    """Log frequencies of each word in each language; zero where not even a letter is known."""
    out = np.zeros((len(words), len(model.langs)))
    place = pc.index_in(words, model.words)
    seen = np.asarray(place.is_valid().to_numpy(zero_copy_only=False), bool)
    out[seen] = model.word_scores[place.drop_null().to_numpy()]
    open_ = np.flatnonzero(~seen)
    for n in range(LONGEST, 0, -1):
        if not len(open_):
            break
        table, values = model.grams[n]
        if not len(table):
            continue
        hashes, owner = letter_grams(words.take(pa.array(open_)), n)
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        hit = table[at] == hashes
        many = np.bincount(owner[hit], minlength=len(open_))
        some = many > 0
        for k in range(len(model.langs)):
            total = np.bincount(owner[hit], weights=values[at[hit], k], minlength=len(open_))
            out[open_[some], k] = total[some] / many[some]
        open_ = open_[~some]
    return out


def with_language(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``lang_pred`` and ``score`` for every row.

    ``score`` is the chosen language's share (0 to 1) when each language's mean log frequency
    per word counts with :data:`SHARPNESS`. A text that is null, empty or without letters, and
    any text under a model without languages, is ``und`` with score 0. Ties go to the first
    language by name. Repeated rows give a row each; columns of the two new names are replaced.
    """
    plain = (model.langs, model.words, model.word_scores, model.grams)
    shared = docs.sparkSession.sparkContext.broadcast(plain)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        names = [*own.langs, "und"]
        for batch in batches:
            for part in chunks(batch, 0, 2 << 20):
                words, index, at = unique_words(part.column(0), APART)
                each = word_scores(own, words.cast(pa.string()))
                size = np.diff(at)
                letters = np.asarray(pc.match_substring_regex(words.cast(pa.string()), r"\p{L}").to_numpy(zero_copy_only=False), bool)
                lettered = np.concatenate(([0], np.cumsum(letters[index])))
                mean = np.zeros((len(size), len(own.langs)))
                for k in range(len(own.langs)):
                    running = np.concatenate(([0.0], np.cumsum(each[index, k])))
                    mean[:, k] = (running[at[1:]] - running[at[:-1]]) / np.maximum(size, 1)
                best = np.full(len(size), len(own.langs))
                share = np.zeros(len(size))
                told = np.flatnonzero(lettered[at[1:]] > lettered[at[:-1]]) if own.langs else np.zeros(0, np.int64)
                if len(told):
                    weight = np.exp(SHARPNESS * (mean[told] - mean[told].max(axis=1, keepdims=True)))
                    best[told] = np.argmax(weight, axis=1)
                    share[told] = weight.max(axis=1) / weight.sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array([names[k] for k in best], pa.string()), pa.array(share)],
                    [*fields, "lang_pred", "score"])

    fields = [f"k{i}" for i in range(len(kept))]
    picked = small_batches(docs.select(F.col(f"`{text}`").alias("text"), *[
        F.col(f"`{c}`").alias(f) for c, f in zip(kept, fields, strict=True)]))
    shape = T.StructType([*picked.schema.fields[1:], T.StructField("lang_pred", T.StringType()),
                          T.StructField("score", T.DoubleType())])
    return picked.mapInArrow(predict, shape).select(
        *[F.col(f).alias(c) for c, f in zip(kept, fields, strict=True)], "lang_pred", "score")
