"""Removal of byte strings that occur more than once, by hash-compared suffix sorting.

Suffixes of a whole corpus are never sorted together. Positions are first anchored: in every
string of ``length`` bytes the ``GRAM``-byte grams with the smallest hash are anchors, so two
equal strings hold the same anchors at the same places. Only texts around anchors whose
gram occurs again take part further (an anchor's context: all bytes a string of ``length``
with this gram at this place can hold).

* Equal contexts are one class. A class with two members is repeated as a whole.
* The classes of one gram are sorted by the suffix after the anchor, and by the reversed
  prefix before it: mergesort, in which prefix polynomial hashes and binary search find the
  common extension of two suffixes in logarithmically many steps. The bytes of neighbours
  verify each common extension. At each offset, strings are equal when neither order has a
  shorter extension between them.
* A gram with more than ``GROUP`` different contexts is split: two equal strings around it agree
  in half of the bytes before it or in half of those after it, so its contexts meet by
  either half. What still exceeds ``GROUP`` never meets in one task: its strings are dealt out
  one by one, and counted by two hashes with combining aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgate.llm.hashing import chunks, mix, powers, prefix_hashes, span_hashes, text_bytes
from pitgate.llm.tables import small_batches, stored

GRAM = 32
GROUP = 8192
CHUNK = 1 << 19
CONTEXTS = 1 << 14


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def anchor_positions(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors in a chunk, their texts' numbers, and the running sums."""
    sums = prefix_hashes(data)
    size = np.diff(at)
    if not len(data) or size.max() < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), sums
    n = len(data) - GRAM + 1
    grams = (sums[GRAM:] - sums[:n]) * powers(n, inverse=True)
    small = np.maximum((mix(grams) >> np.uint64(32)).astype(np.uint32), 1)
    width = length - GRAM + 1
    least = _sliding(small, width, np.minimum)
    whole = np.zeros(len(least) + 1, np.int32)
    long = size >= length
    np.add.at(whole, at[:-1][long], 1)
    np.add.at(whole, at[1:][long] - length + 1, -1)
    least[np.cumsum(whole[:-1]) == 0] = 0
    edge = np.zeros(width - 1, np.uint32)
    most = _sliding(np.concatenate((edge, least, edge)), width, np.maximum)
    found = np.flatnonzero(most[:n] == small)
    return found, np.searchsorted(at, found, "right") - 1, sums


def common(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes agree from positions ``a`` and ``b``, up to ``most``: binary search."""
    inverse = powers(len(sums), inverse=True)
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = (sums[a + mid] - sums[a]) * inverse[a] == (sums[b + mid] - sums[b]) * inverse[b]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_order(data: np.ndarray, sums: np.ndarray, start: np.ndarray, size: np.ndarray,
                 group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mergesort of suffixes within their groups: the order, and the bytes each has in common
    with the one before it (-1 at the first of a group). ``group`` does not descend."""
    n = len(start)
    order = np.arange(n)
    first = np.searchsorted(group, group)
    last = np.searchsorted(group, group, "right")

    def before(x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        most = np.minimum(size[x], size[y])
        same = common(sums, start[x], start[y], most)
        inner = same < most
        k = np.where(inner, same, 0)
        cx, cy = data[np.minimum(start[x] + k, len(data) - 1)], data[np.minimum(start[y] + k, len(data) - 1)]
        shorter = (size[x] <= size[y]) if ties else (size[x] < size[y])
        return np.where(inner, cx < cy, shorter)

    width = 1
    slots = np.arange(n)
    while width < (last - first).max(initial=1):
        own = (slots - first) // width
        left = own % 2 == 0
        other = first + (own + np.where(left, 1, -1)) * width
        low = np.minimum(other, last)
        high = np.minimum(other + width, last)
        begin = low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            x, y = order[mid], order[open_]
            smaller = np.where(left[open_], before(x, y, False), before(x, y, True))
            low[open_] = np.where(smaller, mid + 1, low[open_])
            high[open_] = np.where(smaller, high[open_], mid)
        pair = first + own // 2 * 2 * width
        place = pair + (slots - first) % width + (low - begin)
        merged = np.empty_like(order)
        merged[place] = order
        order, width = merged, width * 2
    shared = np.full(n, -1, np.int64)
    inside = np.flatnonzero(slots != first)
    x, y = order[inside - 1], order[inside]
    shared[inside] = common(sums, start[x], start[y], np.minimum(size[x], size[y]))
    return order, shared


def verified_order(data: np.ndarray, start: np.ndarray, size: np.ndarray,
                   group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`suffix_order` with each common extension held against the bytes; a hash
    collision sends the chunk through a plain sort of its bytes."""
    order, shared = suffix_order(data, prefix_hashes(data), start, size, group)
    inside = np.flatnonzero(shared >= 0)
    x, y = order[inside - 1], order[inside]
    span = np.arange(size.max(initial=0))
    good = True
    for k in range(0, len(inside), 4096):
        a, b, m = x[k:k + 4096], y[k:k + 4096], shared[inside[k:k + 4096]]
        most = np.minimum(size[a], size[b])
        take = lambda p: data[np.minimum(start[p][:, None] + span, len(data) - 1)]
        ca, cb = take(a), take(b)
        agree = ((ca == cb) | (span >= m[:, None])).all(axis=1)
        at = np.minimum(m, len(span) - 1)
        rows = np.arange(len(a))
        rising = np.where(m < most, ca[rows, at] < cb[rows, at], size[a] <= size[b])
        good &= bool((agree & rising).all())
    if good:
        return order, shared
    raw = [data[s:s + k].tobytes() for s, k in zip(start, size, strict=True)]
    order = np.array(sorted(range(len(raw)), key=lambda i: (group[i], raw[i])), np.int64)
    for i in inside:
        a, b = raw[order[i - 1]], raw[order[i]]
        shared[i] = next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    return order, shared


def repeated_offsets(contexts: list[bytes], left: np.ndarray, group: np.ndarray, length: int,
                     least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Per context and offset o from ``least`` to ``most``: whether the string that starts o bytes
    before the anchor occurs in another context of the group, at the same offset."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(x) for x in contexts], np.int64)
    anchor = np.concatenate(([0], np.cumsum(size)[:-1])) + left
    after = size - left
    width = length - GRAM + 1
    out = np.zeros((len(contexts), width), bool)
    right, right_shared = verified_order(data, anchor, after, group)
    back, back_shared = verified_order(data[::-1].copy(), len(data) - anchor, left, group)
    longest = []
    for order, shared in ((right, right_shared), (back, back_shared)):
        best = np.empty(len(order), np.int64)
        best[order] = np.maximum(shared, np.append(shared[1:], -1))
        longest.append(best)
    for o in range(width):
        some = np.flatnonzero((longest[1] >= o) & (longest[0] >= length - o) & (least <= o) & (o <= most))
        if len(some) < 2:
            continue
        cluster = np.empty((2, len(contexts)), np.int64)
        cluster[0, right] = np.cumsum(right_shared < length - o)
        cluster[1, back] = np.cumsum(back_shared < o)
        _, which, many = np.unique(cluster[0, some] * len(contexts) + cluster[1, some],
                                   return_inverse=True, return_counts=True)
        out[some, o] = many[which] > 1
    return out


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    """``gram, context, rid, n_bytes, pos`` of every anchor; ``context`` is a hash."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2, CHUNK):
                data, at = text_bytes(part.column(2))
                pos, text, sums = anchor_positions(data, at, length)
                if not len(pos):
                    continue
                low = np.maximum(at[text], pos - (length - GRAM))
                high = np.minimum(at[text + 1], pos + length)
                context = mix(span_hashes(sums, low, high) + (pos - low).astype(np.uint64))
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays([
                    pa.array(span_hashes(sums, pos, pos + GRAM).astype(np.int64)), pa.array(context.astype(np.int64)),
                    part.column(0).take(take), part.column(1).take(take),
                    pa.array((pos - at[text]).astype(np.int32))], ["gram", "context", "rid", "n_bytes", "pos"])

    return rows.select("rid", "n_bytes", "body").mapInArrow(
        find, "gram long, context long, rid long, n_bytes int, pos int")


def _contexts(places: DataFrame, rows: DataFrame, length: int, halves: bool) -> DataFrame:
    """``places`` (gram, context, c, rid, n_bytes, pos) with the contexts' bytes.

    ``part`` is what contexts meet by: the gram, or with ``halves`` a hash of the gram and half of
    the bytes on one side; ``least`` and ``most`` are the offsets to look at, ``lead`` the bytes
    before the anchor.
    """
    listed = places.groupBy("rid", "n_bytes").agg(F.collect_list(F.struct("pos", "gram", "c")).alias("ps"))
    both = rows.join(listed, ["rid", "n_bytes"]).select("rid", "n_bytes", "id", "body", "ps")
    around = length - GRAM
    half = (around + 1) // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digest(side: bytes, text: bytes) -> int:
            return int.from_bytes(blake2b(side + text, digest_size=8).digest(), "little", signed=True)

        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column(3)[i].as_py().encode()
                ps = batch.column(4)[i].values
                pos = ps.field("pos").to_numpy()
                part, which = ps.field("gram").to_numpy(), np.arange(len(pos))
                least, most = np.zeros(len(pos), np.int32), np.full(len(pos), around, np.int32)
                if halves:
                    before = [(digest(b"<", body[p - half:p + GRAM]), k, half, around)
                              for k, p in enumerate(pos) if p >= half]
                    after = [(digest(b">", body[p:p + GRAM + half]), k, 0, half)
                             for k, p in enumerate(pos) if p + GRAM + half <= len(body)]
                    part, which, least, most = (np.array(x, np.int64) for x in zip(*before, *after, strict=True))
                pos = pos[which]
                low = np.maximum(pos - around, 0)
                text = [body[a:b] for a, b in zip(low, pos + length, strict=True)]
                same = pa.array(np.zeros(len(pos), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), ps.field("c").take(pa.array(which)),
                     *[batch.column(k).slice(i, 1).take(same) for k in (0, 1)], pa.array(pos.astype(np.int32)),
                     pa.array((pos - low).astype(np.int32)), pa.array(least.astype(np.int32)),
                     pa.array(most.astype(np.int32)), pa.array(text, pa.binary())],
                    ["part", "c", "rid", "n_bytes", "pos", "lead", "least", "most", "bytes"])

    return both.mapInArrow(cut, "part long, c long, rid long, n_bytes int, pos int, lead int, least int, most int, bytes binary")


def _sorted_groups(contexts: DataFrame, length: int) -> DataFrame:
    """``rid, n_bytes, low, high``: repeated stretches of contexts that occur once."""
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0

        def work(table: pa.Table) -> pa.RecordBatch:
            part = table["part"].to_numpy()
            group = np.concatenate(([0], np.cumsum(part[1:] != part[:-1])))
            lead, least, most = (table[x].to_numpy().astype(np.int64) for x in ("lead", "least", "most"))
            hit = repeated_offsets(table["bytes"].to_pylist(), lead, group, length, least, most)
            hit[table["c"].to_numpy() > 1] = False
            edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, first = np.nonzero(edge == 1)
            last = np.nonzero(edge == -1)[1] - 1
            pos = table["pos"].to_numpy().astype(np.int64)[row]
            one = pa.array(row)
            return pa.RecordBatch.from_arrays(
                [table["rid"].combine_chunks().take(one), table["n_bytes"].combine_chunks().take(one),
                 pa.array((pos - last).astype(np.int32)), pa.array((pos - first + length).astype(np.int32))],
                ["rid", "n_bytes", "low", "high"])

        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= CONTEXTS:
                table = pa.Table.from_batches(waiting).combine_chunks()
                part = table["part"].to_numpy()
                whole = int(np.searchsorted(part, part[-1]))
                if whole:
                    yield work(table.slice(0, whole))
                    waiting = table.slice(whole).to_batches()
                    rows = table.num_rows - whole
        if rows:
            yield work(pa.Table.from_batches(waiting).combine_chunks())

    return (contexts.repartition("part").sortWithinPartitions("part")
            .mapInArrow(sort, "rid long, n_bytes int, low int, high int"))


def _dealt_strings(contexts: DataFrame, length: int) -> DataFrame:
    """As :func:`_sorted_groups`, for parts with very many contexts: each string is a row."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch, 8, CHUNK // 8):
                data, at = text_bytes(some.column(8))
                sums = prefix_hashes(data)
                lead, least, most = (some.column(k).to_numpy().astype(np.int64) for k in (5, 6, 7))
                size = np.minimum(most, lead) - least + 1
                size = np.maximum(size, 0)
                row = np.repeat(np.arange(len(lead)), size)
                o = least[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                start = at[row] + lead[row] - o
                fits = start + length <= at[row + 1]
                row, o, start = row[fits], o[fits], start[fits]
                one = span_hashes(sums, start, start + length)
                half = span_hashes(sums, start, start + length // 2)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(take), pa.array(o.astype(np.int32)), pa.array(one.astype(np.int64)),
                     pa.array(half.astype(np.int64)), *[some.column(k).take(take) for k in (1, 2, 3, 4)]],
                    ["part", "o", "one", "half", "c", "rid", "n_bytes", "pos"])

    strings = contexts.mapInArrow(
        deal, "part long, o int, one long, half long, c long, rid long, n_bytes int, pos int")
    keys = ["part", "o", "one", "half"]
    again = strings.groupBy(*keys).count().where("count > 1").select(*keys)
    return (strings.where("c = 1").join(again, keys)
            .select("rid", "n_bytes", (F.col("pos") - F.col("o")).alias("low"),
                    (F.col("pos") - F.col("o") + length).alias("high")))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """``key, n_bytes, spans, kept`` for every row: what remains after each byte covered by a
    ``length``-byte string that also starts elsewhere in the corpus is removed.

    ``spans`` are the maximal removed runs (start, end) in bytes of the UTF-8 text, ``kept`` the
    bytes left, which may cut a character. A null or empty text has no spans and keeps b"".
    Strings never cross texts; overlaps within one text count. Repeated rows remove each
    other wholly, also with the same or no key. Other columns are not looked at.
    """
    rows = small_batches(docs).select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    rows = rows.select(F.xxhash64("id", "body").alias("rid"), F.octet_length("body").alias("n_bytes"), "id", "body")
    anchors = stored(_anchors(rows, length), "anchors")
    again = anchors.groupBy("gram").count().where("count > 1").select("gram")
    again = stored(anchors.join(again, "gram"), "repeated-anchors")
    classes = again.groupBy("gram", "context").agg(
        F.count("*").alias("c"), F.min(F.struct("rid", "n_bytes", "pos")).alias("one"))
    several = classes.groupBy("gram").count().where("count > 1")
    places = classes.join(several, "gram").select("gram", "c", "one.*", "count")

    whole = again.join(classes.where("c > 1").select("gram", "context"), ["gram", "context"]).select(
        "rid", "n_bytes", F.greatest(F.col("pos") - (length - GRAM), F.lit(0)).alias("low"),
        F.least(F.col("pos") + length, F.col("n_bytes")).alias("high"))
    few = _contexts(places.where(F.col("count") <= GROUP), rows, length, halves=False)
    split = _contexts(places.where(F.col("count") > GROUP), rows, length, halves=True)
    sizes = split.groupBy("part").agg(F.count("*").alias("size")).where("size > 1")
    split = split.join(sizes, "part")
    fields = few.columns
    small = split.where(F.col("size") <= GROUP).select(*fields)
    large = split.where(F.col("size") > GROUP).select(*fields)
    spans = (whole.unionByName(_sorted_groups(few, length)).unionByName(_sorted_groups(small, length))
             .unionByName(_dealt_strings(large, length))
             .groupBy("rid", "n_bytes").agg(F.collect_set(F.struct("low", "high")).alias("found")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of, kept = [], []
            for body, found in zip(batch.column(2), batch.column(3), strict=True):
                raw = body.as_py().encode()
                runs: list[list[int]] = []
                if found.is_valid:
                    low = found.values.field("low").to_numpy()
                    high = found.values.field("high").to_numpy()
                    for a, b in sorted(zip(low.tolist(), high.tolist(), strict=True)):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                ends = [0, *[x for run in runs for x in run], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                spans_of.append([{"start": a, "end": b} for a, b in runs])
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans_of, pa.list_(span)), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "spans", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    out = (rows.join(spans, ["rid", "n_bytes"], "left").select("id", F.col("n_bytes").cast("long"), "body", "found")
           .mapInArrow(cut, f"id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"))
    return out.withColumnRenamed("id", key)
