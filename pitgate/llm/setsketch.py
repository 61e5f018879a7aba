"""Near copies by SetSketch registers: banded, judged by a joint likelihood, then verified.

The sketch of a set has :data:`REGISTERS` registers. Each is the least of exponentially distributed
hashes of the set's members, kept as the number of its interval on an exponential scale of base
:data:`BASE` and truncated to 16 bits. The sketch of a union is the larger of two registers, each on its
own; two registers are equal with a chance that rises with the sets' Jaccard similarity.

* The first half of the registers makes :data:`BANDS` bands of five: sets with one band in common are
  candidates. At 85 % a pair misses all bands with a chance of 7e-9.
* A candidate's registers, larger, smaller and equal ones counted, and the two known set sizes give the
  likelihood of each similarity. A pair goes if the threshold is :data:`SIGMAS` standard errors off.
* What is left is verified once, on the whole sets.

Equal sets meet as one. Pairs are made in three rounds, since a group of near copies must not meet in all
pairs. First each member of a bucket meets the one with the smallest id. Then, in buckets that still hold
several components, members of different ones are compared in blocks inside tasks, each pair in its
first common band only, and of the pairs that seem to link no more come out than join the block's
components, likeliest first. Last, the same comparison gives every pair between different components that
it leaves.

Blocks compare sets of up to :data:`CODED` members by the low 16 bits of all their hashes (:func:`most_common`). That
bounds the intersection from above and hardly exceeds it, so no linked pair goes, and pairs just below the threshold do.
The likelihood judges larger sets there, and all sets in the first round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgate.llm.hashing import chunks, mix, shingle_hashes, text_bytes, word_hashes
from pitgate.llm.ngram_join import _packed
from pitgate.llm.tables import components, small_batches, stored

BANDS = 32
WIDTH = 5
BANDED = BANDS * WIDTH
REGISTERS = 2 * BANDED
BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 2
SIGMAS = 5.0
BLOCK = 512
PAIRS = 1 << 17
CODED = 1 << 13
_DRAWN = np.random.default_rng(12).integers(0, 1 << 63, (2, REGISTERS), dtype=np.int64).astype(np.uint64)


def registers(members: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sketches of sets of 56-bit hashes, ``at`` their ``len + 1`` offsets; of an empty set all are 0."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, REGISTERS), np.uint16)
    if not len(full):
        return out
    start, x = at[full], mix(members.astype(np.uint64))
    least = np.empty((len(full), REGISTERS), np.float64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat((x ^ _DRAWN[0, i]) * (_DRAWN[1, i] | np.uint64(1)), start)
    exponential = -np.log1p(-(least + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT + 1)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def bands(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each sketch."""
    parts = sketches[:, :BANDED].reshape(-1, BANDS, WIDTH).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for j in range(WIDTH):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out.astype(np.int64)


def _larger(x: np.ndarray) -> np.ndarray:
    """The chance that a register is the larger one, from the share of the union that only its set has."""
    return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)


def _log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray) -> np.ndarray:
    p, q = _larger(u - (1 - u) * j), _larger(1 - u - u * j)
    return sum(np.where(k > 0, k * np.log(np.maximum(x, 1e-300)), 0) for k, x in ((more, p), (less, q), (same, 1 - p - q)))


def estimated(more: np.ndarray, less: np.ndarray, same: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The most likely similarity of sets of ``na`` and ``nb`` members with so many larger, smaller and
    equal registers. The likelihood has one top, which thirds of the interval close in on."""
    u = na / (na + nb)
    low, high = np.zeros(len(u)), np.minimum(na, nb) / np.maximum(na, nb)
    for _ in range(36):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = _log_likelihood(a, more, less, same, u) < _log_likelihood(b, more, less, same, u)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray,
           percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sketches may have a similarity of ``percent`` or more, and the likeliest one of each."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same, u = REGISTERS - more - less, na / (na + nb)
    found = estimated(more, less, same, na, nb)
    least = np.minimum(percent / 100, np.minimum(na, nb) / np.maximum(na, nb))
    lost = _log_likelihood(found, more, less, same, u) - _log_likelihood(least, more, less, same, u)
    return (found >= least) | (2 * lost <= SIGMAS**2), found


def forest(x: np.ndarray, y: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the pairs that join ``n`` nodes as all pairs (x, y) do, those of high scores first: each
    part takes its best pair to another, until none is left."""
    part, order = np.arange(n), np.argsort(score, kind="stable")
    x, y = x[order], y[order]
    taken = []
    while True:
        apart = np.flatnonzero(part[x] != part[y])
        if not len(apart):
            return order[np.unique(np.concatenate([*taken, np.zeros(0, np.int64)]))]
        best = np.full(n, -1)
        np.maximum.at(best, part[x[apart]], apart)
        np.maximum.at(best, part[y[apart]], apart)
        chosen = np.unique(best[best >= 0])
        taken.append(chosen)
        while True:
            a, b = part[x[chosen]], part[y[chosen]]
            if (a == b).all():
                break
            least = np.arange(n)
            np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
            part = least[part]


def codes(members: np.ndarray) -> bytes:
    """The low 16 bits of each member of a set, sorted; nothing of a set of over :data:`CODED` members."""
    return np.sort(members.astype(np.uint16)).tobytes() if len(members) <= CODED else b""


def most_common(values: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many members the sets x and y of each pair have in common at most, as far as their codes tell.

    ``at`` are the ``len + 1`` offsets of the sets' codes in ``values``, and ``x`` is sorted. Of the classes that
    codes name, both sets' members are counted; the smaller counts add up to no less than the intersection.
    """
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(new)
    # The k-th member of a class only meets a k-th one.
    numbered = values + ((np.arange(len(values)) - begins[np.cumsum(new) - 1]) << 16)
    out = np.zeros(len(x), np.int64)
    own = np.zeros(int(numbered.max(initial=0)) + 1, bool)
    first = np.flatnonzero(np.diff(x, prepend=-1))
    for a, b in zip(first, np.append(first, len(x))[1:], strict=True):
        mine = numbered[at[x[a]]:at[x[a] + 1]]
        own[mine] = True
        for k in range(a, b):
            out[k] = np.count_nonzero(own[numbered[at[y[k]]:at[y[k] + 1]]])
        own[mine] = False
    return out


def _rows(column: pa.Array) -> np.ndarray:
    return text_bytes(column)[0].reshape(-1, 2 * REGISTERS).view(np.uint16)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """``id, n_shingles, h1, h2, sketch`` of each text (id, text); h1 and h2 are equal for equal sets."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                flat, at = shingle_hashes(*word_hashes(*text_bytes(part.column(1))), n)
                sets = [np.unique(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                size = np.array([len(x) for x in sets], np.int64)
                flat, at = np.concatenate([*sets, np.zeros(0, np.int64)]), np.concatenate(([0], np.cumsum(size)))
                sums = []
                for salt in (3, 4):
                    mixed = mix(flat.astype(np.uint64) ^ np.uint64(salt * 0x9FB21C651E98DF25 & (1 << 64) - 1))
                    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
                    sums.append(mix(running[at[1:]] - running[at[:-1]] + size.astype(np.uint64)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size), *map(pa.array, sums),
                     pa.array([x.tobytes() for x in registers(flat, at)], pa.binary())],
                    ["id", "n_shingles", "h1", "h2", "sketch"])

    return docs.mapInArrow(sketch, "id long, n_shingles long, h1 long, h2 long, sketch binary")


def _bucketed(sets: DataFrame) -> DataFrame:
    """``bucket, id, n_shingles``, a row for each band."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = bands(_rows(batch.column(2))).ravel()
                own = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), batch.column(0).take(own), batch.column(1).take(own)], ["bucket", "id", "n_shingles"])

    return sets.select("id", "n_shingles", "sketch").mapInArrow(deal, "bucket long, id long, n_shingles long")


def _likely_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave the similarity possible."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(k).to_numpy() for k in (2, 4))
                keep = pa.array(likely(_rows(batch.column(3)), _rows(batch.column(5)), na, nb, percent)[0])
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    thin = sets.select("id", "n_shingles", "sketch")
    both = pairs.join(thin.toDF("a", "na", "sa"), "a").join(thin.toDF("b", "nb", "sb"), "b")
    return both.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(judge, "a long, b long").distinct()


def _pairs_within(end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with every later one of its group, which ends before ``end``, some :data:`PAIRS` at a time."""
    many = end - np.arange(len(end)) - 1
    total = np.concatenate(([0], np.cumsum(many)))
    first = 0
    while first < len(end):
        last = max(int(np.searchsorted(total, total[first] + PAIRS, "right")) - 1, first + 1)
        left = np.repeat(np.arange(first, last), many[first:last])
        yield left, left + 1 + np.arange(len(left)) - (total[left] - total[first])
        first = last


def _members(texts: DataFrame, n: int) -> DataFrame:
    """``id, n_shingles, members, codes``: the sets of compressed texts, as sorted hashes."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, 1 << 16):
                out = []
                for packed in part.column(1).to_pylist():
                    data = np.frombuffer(zlib.decompress(packed), np.uint8)
                    out.append(np.unique(shingle_hashes(*word_hashes(data, np.array([0, len(data)])), n)[0]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in out], pa.int64()),
                     pa.array([x.tobytes() for x in out], pa.binary()), pa.array(map(codes, out), pa.binary())],
                    ["id", "n_shingles", "members", "codes"])

    return texts.mapInArrow(unpack, "id long, n_shingles long, members binary, codes binary")


def _linked(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    whole = members.select("id", "members")
    both = pairs.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(exact, "a long, b long").distinct()


def _cross_pairs(rows: DataFrame, percent: int, joining: bool) -> DataFrame:
    """``a, b`` of different components in one bucket that are likely to link; with ``joining`` only as many
    as join the components of a block, of pairs whose likeliest similarity reaches the threshold.

    ``rows`` (bucket, id, n_shingles, comp, size, sketch, codes): the members of buckets of ``size`` members. A bucket
    is dealt into blocks of about :data:`BLOCK`, and every two blocks (and each with itself) meet in a task,
    which holds no more than them.
    """
    blocks = rows.withColumn("_blocks", F.expr(f"(size + {BLOCK - 1}) div {BLOCK}"))
    blocks = blocks.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    blocks = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    met = blocks.select("bucket", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"),
                        F.col("_own").alias("own"), "id", "n_shingles", "comp", "sketch", "codes")
    met = met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def likely_pairs(table: pa.Table, end: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        bucket, i, j, own, ids, n, comp = (table[k].to_numpy() for k in range(7))
        sketch = _rows(table["sketch"].combine_chunks())
        raw, ends = text_bytes(table["codes"].combine_chunks())
        coded, at = raw.view(np.uint16).astype(np.int64), ends // 2
        for x, y in _pairs_within(end):
            small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            fits = (comp[x] != comp[y]) & (100 * small >= percent * large) & ((i[x] == j[x]) | (own[x] != own[y]))
            x, y = x[fits], y[fits]
            if not len(x):
                continue
            shared = (sketch[x, :BANDED] == sketch[y, :BANDED]).reshape(-1, BANDS, WIDTH).all(axis=2)
            first = np.take_along_axis(bands(sketch[x]), shared.argmax(axis=1)[:, None], 1)[:, 0]
            here = first == bucket[x]
            x, y = x[here], y[here]
            keep, score = np.zeros(len(x), bool), np.zeros(len(x))
            known = (at[x + 1] > at[x]) & (at[y + 1] > at[y])
            both, rest = np.flatnonzero(known), np.flatnonzero(~known)
            common, sizes = most_common(coded, at, x[both], y[both]), n[x[both]] + n[y[both]]
            keep[both], score[both] = 100 * common >= percent * (sizes - common), common / (sizes - common)
            if len(rest):
                keep[rest], score[rest] = likely(sketch[x[rest]], sketch[y[rest]], n[x[rest]], n[y[rest]], percent)
            keep &= known | (score >= percent / 100) | (not joining)
            yield x[keep], y[keep], score[keep]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table, end: np.ndarray) -> Iterator[pa.RecordBatch]:
            ids, comp = table["id"].to_numpy(), table["comp"].to_numpy()
            found = list(likely_pairs(table, end)) if joining else likely_pairs(table, end)
            if joining and found:
                x, y, score = (np.concatenate(part) for part in zip(*found, strict=True))
                nodes = np.unique(np.stack((end, comp)), axis=1, return_inverse=True)[1].ravel()
                best = forest(nodes[x], nodes[y], score, len(nodes))
                found = [(x[best], y[best], score[best])]
            for x, y, _ in found:
                a, b = ids[x], ids[y]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            keys = np.stack([table[k].to_numpy() for k in ("bucket", "i", "j")])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            cut = int(new[-1]) if len(new) else 0
            if cut:
                yield from pairs(table.slice(0, cut), np.repeat(new, np.diff(np.concatenate(([0], new)))))
            rest = table.slice(cut).combine_chunks()
        if rest is not None:
            yield from pairs(rest, np.full(rest.num_rows, rest.num_rows))

    return met.mapInArrow(compare, "a long, b long").distinct()


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``bucket, id, n_shingles, comp, size`` of the buckets that hold several components."""
    placed = rows.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "bucket", "id", "n_shingles", F.coalesce("root", "id").alias("comp"))
    several = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    return placed.join(several.where("c1 <> c2").select("bucket", "size"), "bucket")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots (node, root) after more links."""
    ends = (links.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    upper = stored(components(ends, "sketch-upper"), "sketch-above")
    moved = roots.join(upper.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = upper.join(roots.select("node"), "node", "left_anti")
    return stored(moved.unionByName(new), "sketch-roots")


def sketch_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5,
                      percent: int = 85) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents whose distinct ``n``-word shingles have a Jaccard similarity of ``percent`` or more link;
    ``component_id`` is the smallest key that links reach, the own included, and ``kept`` marks it.

    A null or empty text, or one of white space, has no shingles: 0, its own component. A text with fewer
    than ``n`` words is one shingle. Repeated rows give a row each; rows that share a key are one
    document, which links what any of its texts links. A row without a key links nothing: its component is
    null, and it is kept. Other columns of ``docs`` are not looked at, whatever their names.
    """
    plain = small_batches(docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")))
    sets = stored(sketches(plain, n), "sketches")
    full = sets.where("n_shingles > 0 and id is not null")
    # Copies combine in the map tasks, so a sketch is shuffled once for each different set.
    reps = stored(full.groupBy("h1", "h2").agg(
        F.min("id").alias("id"), F.min_by(F.struct("n_shingles", "sketch"), "id").alias("s")).select(
        "h1", "h2", "id", "s.*"), "sketch-sets")

    rows = _bucketed(reps)
    shared = rows.groupBy("bucket").agg(F.count("*").alias("c"), F.min("id").alias("hub")).where("c > 1").drop("c")
    rows = stored(rows.join(shared, "bucket"), "sketch-buckets")
    active = _packed(plain.where("id is not null")).join(rows.select("id").distinct(), "id")
    members = stored(_members(active, n), "sketch-members")
    thin = reps.select("id", "n_shingles", "sketch")
    of_sets = members.select("id", "n_shingles", "codes").distinct()

    fits = F.expr(f"100 * least(x.n_shingles, y.n_shingles) >= {percent} * greatest(x.n_shingles, y.n_shingles)")
    star = rows.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    size = reps.select("id", "n_shingles")
    star = (star.join(size.alias("x"), F.col("a") == F.col("x.id")).join(size.alias("y"), F.col("b") == F.col("y.id"))
            .where(fits).select("a", "b").distinct())
    star = stored(_likely_pairs(star, reps, percent), "sketch-star")
    links = _linked(star, members, percent)

    # A key with several texts joins what they link.
    of_text = full.select("id", "h1", "h2").join(reps.select("h1", "h2", F.col("id").alias("rep")), ["h1", "h2"])
    several = of_text.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b <> top")
    same_key = of_text.join(several, "id").select(F.col("rep").alias("a"), "b").where("a <> b")
    roots = stored(components(links.unionByName(same_key)), "sketch-roots")

    tried = star
    for joining in (True, False):
        open_rows = _open(rows, roots).join(thin, ["id", "n_shingles"]).join(of_sets, ["id", "n_shingles"])
        cross = _cross_pairs(open_rows, percent, joining).join(tried, ["a", "b"], "left_anti")
        cross = stored(cross, "sketch-cross")
        roots = _joined(roots, _linked(cross, members, percent))
        tried = tried.unionByName(cross)

    top = (reps.select("h1", "h2", F.col("id").alias("node")).join(roots, "node", "left")
           .select("h1", "h2", F.coalesce("root", "node").alias("top")))
    keyed = sets.where("id is not null").select("id", "n_shingles", "h1", "h2").join(top, ["h1", "h2"], "left").select(
        "id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("top")).otherwise(F.col("id")).alias("top"))
    loose = sets.where("id is null").select("id", "n_shingles", F.lit(None).cast("long").alias("top"))
    return keyed.unionByName(loose).select(
        F.col("id").alias(key), "n_shingles", F.col("top").alias("component_id"), F.col("id").eqNullSafe(F.col("top")).alias("kept"))
