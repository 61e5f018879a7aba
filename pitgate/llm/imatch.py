"""I-Match fingerprints: hashes of the terms within a band of document frequency.

The lexicon keeps terms that are neither too rare nor too common. Its size is fixed: a term is
one of ``2**bits`` classes by its hash, and a class's document frequency is counted over all
documents, a large group of near copies being one. Each of :data:`SUBSETS` randomised lexicons is a chain of ever smaller random
subsets; a document uses the smallest that still holds one of its terms, so short and long
texts alike keep few terms. The distinct terms kept are sorted and hashed. The fingerprint is
the list of these hashes; two texts are as alike as the share of hashes they have in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitgate.llm.hashing import chunks, mix, shingle_hashes, text_bytes, word_hashes
from pitgate.llm.tables import hashed_counts, levels, small_batches

SUBSETS = 32
BITS = 20
LEAST_DOCS = 2
MOST_SHARE = 0.02
GROUP_SHARE = 0.001
SKETCHES = 8
COMMON = 3
RAREST = 16
PER_DEAL = 500
MOST_DEALS = 10_000


def terms_of(words: np.ndarray, at: np.ndarray, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct term classes of each text, within the lexicon if given, and offsets."""
    classes = (words & np.uint64((1 << BITS) - 1)).astype(np.int64)
    keys = np.repeat(np.arange(len(at) - 1), np.diff(at)) << BITS | classes
    if table is not None:
        keys = keys[table[classes]]
    keys = np.unique(keys)
    return keys & ((1 << BITS) - 1), np.searchsorted(keys, np.arange(len(at)) << BITS)


def sketches(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """:data:`SKETCHES` least hashes of each text's runs of three words; near copies have most in common.

    Texts without words have none: all zeros.
    """
    grams, gram_at = shingle_hashes(words, at, 3)
    out = np.zeros((len(at) - 1, SKETCHES), np.int64)
    some = np.flatnonzero(np.diff(gram_at))
    for k in range(SKETCHES if len(some) else 0):
        mixed = mix(grams.astype(np.uint64) + np.uint64(((k + 1) * 0xD1342543DE82EF95) & (1 << 64) - 1))
        out[some, k] = (np.minimum.reduceat(mixed, gram_at[some]) >> np.uint64(1)).astype(np.int64)
    return out


def _large_groups(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sketch its values in more than :data:`GROUP_SHARE` of the rows (and in more than
    :data:`LEAST_DOCS`), sorted, and the least hash of the texts that have it."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                own = sketches(*word_hashes(*text_bytes(part.column(1))))
                rid = np.repeat(part.column(0).to_numpy(), SKETCHES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(SKETCHES), len(own))), pa.array(own.ravel()), pa.array(rid)], ["k", "value", "rid"])

    found = rows.mapInArrow(sketch, "k long, value long, rid long").groupBy("k", "value").agg(
        F.count("*").alias("n"), F.min("rid").alias("first"))
    least = max(LEAST_DOCS, GROUP_SHARE * rows.count())
    large = found.where((F.col("n") > least) & (F.col("value") != 0)).orderBy("k", "value").toArrow()
    k, value, first = (large[c].to_numpy() for c in ("k", "value", "first"))
    return [(value[k == j], first[k == j]) for j in range(SKETCHES)]


def _firsts_of(own: np.ndarray, rid: np.ndarray, large: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """How many of a text's sketches are those of large groups, and whether it is the first text of all these."""
    hits, leads = np.zeros(len(own), np.int64), np.ones(len(own), bool)
    for j, (value, first) in enumerate(large):
        if len(value):
            at = np.minimum(np.searchsorted(value, own[:, j]), len(value) - 1)
            hit = value[at] == own[:, j]
            hits += hit
            leads &= ~hit | (first[at] == rid)
    return hits, leads


def lexicon(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of each term class, a byte: 0 in the band, then by document frequency, 255 in one document.

    The band: in :data:`LEAST_DOCS` rows or more, and in no more than :data:`MOST_SHARE` of the
    documents (or :data:`LEAST_DOCS`), where a large group of copies or near copies is one document.
    Near copies are texts that have :data:`COMMON` sketches or more in common with those of large groups.
    """
    rows = small_batches(docs.select(F.xxhash64(f"`{text}`").alias("rid"), F.col(f"`{text}`").alias("text")))
    large = _large_groups(rows)
    leaders = np.unique(np.concatenate([first for _, first in large]))
    shared = docs.sparkSession.sparkContext.broadcast((large, leaders))
    seen = 2 << BITS

    def scan(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        groups, first = shared.value
        for part in chunks(batch, 1):
            words, at = word_hashes(*text_bytes(part.column(1)))
            classes, class_at = terms_of(words, at, None)
            yield classes
            single = np.ones(len(at) - 1, bool)
            if len(first):
                rid = part.column(0).to_numpy()
                single = (_firsts_of(sketches(words, at), rid, groups)[0] < COMMON) & ~np.isin(rid, first)
            yield classes[np.repeat(single, np.diff(class_at))] | 1 << BITS
            yield np.full(single.sum(), seen, np.int64)

    def lead(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in chunks(batch, 1):
            words, at = word_hashes(*text_bytes(part.column(1)))
            _, leads = _firsts_of(sketches(words, at), part.column(0).to_numpy(), shared.value[0])
            classes, class_at = terms_of(words, at, None)
            yield classes[np.repeat(leads, np.diff(class_at))] | 1 << BITS
            yield np.full(leads.sum(), seen, np.int64)

    counts = hashed_counts(rows, scan, BITS + 2)
    if len(leaders):
        few = rows.where(F.col("rid").isin(leaders.tolist())).dropDuplicates(["rid"])
        counts = counts + hashed_counts(few, lead, BITS + 2)
    raw, apart, documents = counts[:1 << BITS], counts[1 << BITS:2 << BITS], int(counts[seen])
    rank = np.where(apart <= max(LEAST_DOCS, MOST_SHARE * documents), 0, 1 + levels(apart).astype(np.int64))
    return np.where(raw < LEAST_DOCS, 255, rank).astype(np.uint8)


def fingerprints(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """One row of :data:`SUBSETS` 32-bit hashes per text.

    In subset k a term's depth is the number of leading zeros of a hash of the term and k; the
    terms of the greatest depth are those in the smallest lexicon of the chain. Of texts without
    a term in the band the :data:`RAREST` terms of the least rank are taken; texts without
    a word are fingerprinted by their bytes, so only equal ones agree.
    """
    data, at = text_bytes(texts)
    words, words_at = word_hashes(data, at)
    terms, term_at = terms_of(words, words_at, table == 0)
    rows = len(at) - 1
    out = np.zeros((rows, SUBSETS), np.uint32)
    poor = np.flatnonzero((np.diff(term_at) == 0) & (np.diff(words_at) > 0))
    if len(poor):
        kept = {}
        for i in poor:
            own = np.unique(words[words_at[i]:words_at[i + 1]] & np.uint64((1 << BITS) - 1)).astype(np.int64)
            kept[i] = own[np.lexsort((own, table[own]))[:RAREST]]
        many = np.diff(term_at)
        many[poor] = [len(kept[i]) for i in poor]
        terms = np.concatenate([kept.get(i, terms[term_at[i]:term_at[i + 1]]) for i in range(rows)])
        term_at = np.concatenate(([0], np.cumsum(many)))
    some = np.flatnonzero(np.diff(term_at))
    if len(some):
        starts = term_at[some]
        owner = np.repeat(np.arange(len(some)), np.diff(term_at)[some])
        for k in range(SUBSETS):
            mixed = mix(terms.astype(np.uint64) + np.uint64(((k + 1) * 0xA24BAED4963EE407) & (1 << 64) - 1))
            depth = 32 - np.frexp((mixed >> np.uint64(32)).astype(np.float64))[1]
            most = np.maximum.reduceat(depth, starts)
            kept = np.where(depth == most[owner], mix(mixed), np.uint64(0))
            running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kept, dtype=np.uint64)))
            out[some, k] = (mix(running[term_at[some + 1]] - running[starts]) >> np.uint64(32)).astype(np.uint32)
    none = np.flatnonzero(np.diff(term_at) == 0)
    for i in none:
        seed = np.uint64(int.from_bytes(blake2b(data[at[i]:at[i + 1]].tobytes(), digest_size=8).digest(), "little"))
        out[i] = (mix(seed + np.arange(SUBSETS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return out


def _hex(row: np.ndarray) -> str:
    return row.astype(">u4").tobytes().hex()


def fingerprinted(docs: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint`` of every row: :data:`SUBSETS` hashes of 8 hex digits.

    Equal texts have equal fingerprints; null and empty texts share one. Repeated rows give a
    row each; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = shared.value
        for batch in batches:
            for part in chunks(batch, 1):
                found = [_hex(x) for x in fingerprints(part.column(1), band)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], ["id", "fingerprint"])

    picked = small_batches(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(make, f"id {kind}, fingerprint string").withColumnRenamed("id", key)


def _bounds(ids: DataFrame) -> np.ndarray:
    """Bounds that deal the ids into ranges of about :data:`PER_DEAL`, :data:`MOST_DEALS` at most."""
    rows, = ids.agg(F.count("id")).first()
    dealt = min(-(-rows // PER_DEAL), MOST_DEALS)
    if dealt < 2:
        return np.zeros(0, np.int64)
    shares = F.array(*[F.lit(i / dealt) for i in range(1, dealt)])
    return np.unique(np.array(ids.agg(F.percentile_approx("id", shares, 10 * dealt)).first()[0], np.int64))


def _firsts(ids: DataFrame, bounds: np.ndarray) -> dict[int, int | None]:
    """The first id of each range that has rows; None where it is null (nulls come first)."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(0).fill_null(0).to_numpy(), "right")
            at[np.asarray(batch.column(0).is_null().to_numpy(zero_copy_only=False), bool)] = 0
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), batch.column(0)], ["deal", "id"])

    found = ids.mapInArrow(deal, "deal long, id long").groupBy("deal").agg(
        F.min("id").alias("first"), F.bool_or(F.col("id").isNull()).alias("null")).collect()
    return {r["deal"]: None if r["null"] else r["first"] for r in sorted(found, key=lambda r: r["deal"])}


def edited_likeness(docs: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text with its end overwritten, and how alike they are.

    Returns ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The edited text has its last floor(n / 4) code points replaced by as many (or all) of the
    next document's first, by ascending key, nulls first, rows of one key by a hash of their
    text; after the last comes the first. Keys are dealt into ranges, and a range's first row is
    also sent to the range before, so each range is one window of bounded size.

    A null text is empty. A single row is its own next.
    """
    spark = docs.sparkSession
    picked = small_batches(docs.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(f"`{text}`", F.lit("")).alias("text")))
    bounds = _bounds(picked.select("id"))
    firsts = _firsts(picked.select("id"), bounds)
    deals = list(firsts)
    host = {firsts[d]: deals[i - 1] for i, d in enumerate(deals)}
    shared = spark.sparkContext.broadcast((table, bounds, host))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, own_bounds, hosts = shared.value
        for batch in batches:
            for part in chunks(batch, 1):
                prints = [x.astype(">u4").tobytes() for x in fingerprints(part.column(1), band)]
                ids = part.column(0).to_pylist()
                deal = [0 if i is None else int(np.searchsorted(own_bounds, i, "right")) for i in ids]
                guests = [k for k, i in enumerate(ids) if i in hosts]
                take = pa.array([*range(len(ids)), *guests], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*deal, *[hosts[ids[k]] for k in guests]], pa.int64()),
                     pa.array([False] * len(ids) + [True] * len(guests)), part.column(0).take(take),
                     part.column(1).take(take), pa.array(prints, pa.binary()).take(take)],
                    ["deal", "guest", "id", "text", "print"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = shared.value[0]
        for batch in batches:
            for part in chunks(batch, 5):
                edited = fingerprints(part.column(5), band)
                own, after = (np.frombuffer(b"".join(part.column(k).to_pylist()), ">u4").reshape(-1, SUBSETS)
                              for k in (3, 4))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([_hex(x) for x in own], pa.string()),
                     pa.array([_hex(x) for x in edited], pa.string()),
                     pa.array((own == edited).mean(axis=1)), pa.array((own == after).mean(axis=1))], names)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    placed = picked.mapInArrow(place, "deal long, guest boolean, id long, text string, print binary")
    order = Window.partitionBy("deal").orderBy("guest", "id", F.xxhash64("text"))
    paired = placed.select("*", F.lead("text").over(order).alias("next"), F.lead("print").over(order).alias("after"))
    cut = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - cut), F.substring("next", F.lit(1), cut))
    rows = paired.where("not guest").withColumn("edited", edited).select(
        "id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "print", "after", "edited")
    return rows.mapInArrow(
        compare, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double").withColumnRenamed("id", key)
