"""N-gram Jaccard self-join: rare-first prefixes with length, positional and suffix filters.

Each text is the set of its distinct word n-grams, ordered from rare to frequent. Two sets
with a Jaccard similarity of ``percent`` or more share an n-gram within their first
``n - ceil(percent * n / 100) + 1``, so texts meet only on the n-grams of these prefixes.

* Equal sets meet as one: the smallest id stands for all.
* How rare an n-gram is comes from a table of hashed counts over all documents. Its size is
  fixed; classes shared by chance can only reorder prefixes, never lose a link.
* Pairs are made in two rounds, since a group of near copies must not meet in all pairs.
  First each text of a prefix n-gram meets one hub, the text with the fewest rarer
  n-grams. Then only texts of different components meet, and of these none within the
  component that is largest in the n-gram. A pair left out is within one component.
* Each pair left by the filters is verified once, on the whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgate.llm.hashing import chunks, mix, shingle_hashes, text_bytes, word_hashes
from pitgate.llm.tables import components, hashed_counts, levels, small_batches, stored

CLASSES = 16


def _rare_first(levels_of, found: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each text; the high bits hold the frequency, so order is rare-first."""
    table = levels_of.value
    keys = (table[found & (len(table) - 1)].astype(np.int64) << 56) | found
    return [np.unique(keys[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def shingle_sets(docs: DataFrame, levels_of, n: int, percent: int) -> DataFrame:
    """``id, n_shingles, h1, h2, classes, prefix``: each text's set in short.

    ``classes`` counts the set's members in 16 hash classes, for the suffix filter.
    """
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                data, at = text_bytes(part.column(1))
                grams = _rare_first(levels_of, *shingle_hashes(*word_hashes(data, at), n))
                size = np.array([len(x) for x in grams], np.int64)
                flat = np.concatenate(grams) if len(grams) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(grams)), size)
                sums = []
                for salt in (1, 2):
                    mixed = mix(flat.astype(np.uint64) ^ np.uint64(salt * 0x9FB21C651E98DF25 & (1 << 64) - 1))
                    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
                    ends = np.concatenate(([0], np.cumsum(size)))
                    total = running[ends[1:]] - running[ends[:-1]]
                    sums.append(mix(total + size.astype(np.uint64)).astype(np.int64))
                counts = np.bincount(owner * CLASSES + (flat >> 21) % CLASSES, minlength=len(grams) * CLASSES)
                take = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
                yield pa.RecordBatch.from_pydict({
                    "id": part.column(0), "n_shingles": pa.array(size), "h1": pa.array(sums[0]),
                    "h2": pa.array(sums[1]),
                    "classes": pa.ListArray.from_arrays(
                        pa.array(np.arange(len(grams) + 1) * CLASSES, pa.int32()), pa.array(counts, pa.int32())),
                    "prefix": pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum(take))), pa.int32()),
                        pa.array(np.concatenate([x[:k] for x, k in zip(grams, take, strict=True)])
                                 if len(grams) else flat, pa.int64()))})

    return docs.mapInArrow(
        sets, "id long, n_shingles long, h1 long, h2 long, classes array<int>, prefix array<long>")


def _need(na: Column, nb: Column, percent: int) -> Column:
    """The smallest intersection with which sets of these sizes link."""
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100.0 + percent) - F.lit(1e-9))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length and positional filter for two prefix rows of one n-gram."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    rest = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (rest >= _need(na, nb, percent))


def _suffix_filter(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose class counts differ by no more than a linked pair's sets could."""
    thin = sets.select("id", "n_shingles", "classes")
    both = (pairs.join(thin.select(*[F.col(c).alias(f"a_{c}") for c in thin.columns]), F.col("a") == F.col("a_id"))
            .join(thin.select(*[F.col(c).alias(f"b_{c}") for c in thin.columns]), F.col("b") == F.col("b_id")))
    apart = F.aggregate(F.zip_with("a_classes", "b_classes", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    na, nb = F.col("a_n_shingles"), F.col("b_n_shingles")
    return both.where(apart <= na + nb - 2 * _need(na, nb, percent)).select("a", "b").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose whole texts reach the similarity."""
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0))

        def grams(packed: bytes) -> np.ndarray:
            data = np.frombuffer(zlib.decompress(packed), np.uint8)
            return np.unique(shingle_hashes(*word_hashes(data, np.array([0, len(data)])), n)[0])

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, za, zb) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                if last[0] != a:
                    last = (a, grams(za))
                other = grams(zb)
                common = len(np.intersect1d(last[1], other, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(last[1]) + len(other) - common)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("za")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("packed").alias("zb")), "b")
    return both.select("a", "b", "za", "zb").mapInArrow(exact, "a long, b long")


def _packed(docs: DataFrame) -> DataFrame:
    """``id, packed``: the texts compressed, as they travel to the verification."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                data, at = text_bytes(part.column(1))
                out = [zlib.compress(data[a:b].tobytes(), 1) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["id", "packed"])

    return docs.mapInArrow(pack, "id long, packed binary")


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5,
                     percent: int = 80, bits: int = 21) -> DataFrame:
    """``key, n_shingles, component_id, n_links`` for every row of ``docs``.

    ``component_id`` is the smallest key that links of ``percent`` or more reach, the own
    included. ``n_links`` counts the verified links to other texts' representatives; links
    inside a component that no round needed are not counted.

    A null or empty text, or one of white space, has no n-grams: 0, its own component. A text
    with fewer than ``n`` words is one n-gram. Repeated rows give a row each; rows that share
    a key are one document. A row without a key has no component (null) and links nothing.
    Other columns of ``docs`` are not looked at, whatever their names. ``bits`` sets the
    size of the frequency table and has no influence on the result.
    """
    plain = small_batches(docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")))

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in chunks(batch, 0):
            yield shingle_hashes(*word_hashes(*text_bytes(part.column(0))), n)[0]

    spark = docs.sparkSession
    counts = hashed_counts(plain.select("text"), hashes, bits)
    levels_of = spark.sparkContext.broadcast(levels(counts))
    sets = stored(shingle_sets(plain, levels_of, n, percent), "shingle-sets")

    full = sets.where("n_shingles > 0 and id is not null")
    same = full.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    # Copies combine in the map tasks, so prefixes are shuffled once for each different set.
    reps = full.groupBy("h1", "h2").agg(
        F.min("id").alias("id"), F.min_by(F.struct("n_shingles", "prefix"), "id").alias("s")).select("id", "s.*")
    rows = reps.select("id", "n_shingles", F.posexplode("prefix").alias("pos", "gram"))
    shared = rows.groupBy("gram").count().where("count > 1").select("gram")
    rows = stored(rows.join(shared, "gram"), "shared-grams")

    active = rows.select("id").distinct()
    texts = stored(_packed(plain.where("id is not null")).join(active, "id"), "active-texts")
    thin = full.select("id", "n_shingles", "classes").distinct()

    hubs = rows.groupBy("gram").agg(F.min(F.struct("pos", "id", "n_shingles")).alias("hub")).select("gram", "hub.*")
    star = (rows.alias("x").join(hubs.alias("y"), "gram").where("x.id <> y.id").where(_may_link("x", "y", percent))
            .select(F.col("y.id").alias("a"), F.col("x.id").alias("b")).distinct())
    tried = stored(_suffix_filter(star, thin, percent), "star-pairs")
    links = stored(_verified(tried, texts, n, percent), "star-links")
    roots = stored(components(links), "star-roots")

    placed = rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "comp", F.coalesce("root", "id")).drop("root")
    sizes = placed.groupBy("gram", "comp").count()
    split = (sizes.groupBy("gram").agg(F.max(F.struct("count", "comp")).alias("m"), F.count("*").alias("k"))
             .where("k > 1").select("gram", F.col("m.comp").alias("main")))
    placed = stored(placed.join(split, "gram"), "split-grams")
    cross = (placed.where("comp <> main").alias("x").join(placed.alias("y"), "gram")
             .where("x.comp <> y.comp and (y.comp = y.main or x.id < y.id)").where(_may_link("x", "y", percent))
             .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(_verified(_suffix_filter(cross.join(done, ["a", "b"], "left_anti"), thin, percent),
                            texts, n, percent), "cross-links")
    at = roots.select("node", "root")
    joined = (more.join(at.toDF("a", "ra"), "a", "left").join(at.toDF("b", "rb"), "b", "left")
              .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    upper = components(joined)

    ends = links.unionByName(more)
    n_links = (ends.select(F.col("a").alias("rep")).unionByName(ends.select(F.col("b").alias("rep")))
               .groupBy("rep").agg(F.count("*").alias("n_links")))
    of_rep = (same.join(at.toDF("rep", "r1"), "rep", "left")
              .withColumn("r1", F.coalesce("r1", "rep"))
              .join(upper.toDF("r1", "r2"), "r1", "left").withColumn("top", F.coalesce("r2", "r1"))
              .join(n_links, "rep", "left").select("h1", "h2", "top", "n_links"))
    keyed = sets.where("id is not null").select("id", "n_shingles", "h1", "h2").join(of_rep, ["h1", "h2"], "left")
    keyed = keyed.select(
        "id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("top", "id")).otherwise(F.col("id")).alias("top"),
        F.when(F.col("n_shingles") > 0, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"))
    loose = sets.where("id is null").select("id", "n_shingles", F.lit(None).cast("long").alias("top"),
                                            F.lit(0).cast("long").alias("n_links"))
    return keyed.unionByName(loose).select(
        F.col("id").alias(key), "n_shingles", F.col("top").alias("component_id"), "n_links")
