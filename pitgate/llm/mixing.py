"""Mixing sources to target weights in blocks of words, by indices alone.

The words of a source, document after document, are cut into blocks of fixed length. Each
shard of the output draws multinomial source counts for its slots; the slots of a source,
counted through all shards, run through pseudorandom permutations of its block indices (one
per pass over the source), and blocks are joined by index. Draws fall short of or exceed a
source's due number by chance: what exceeds it is dropped, and a last shard gets the rest.

Everything on rows is DataFrame functions. The driver holds one row per source. Joins of
exploded rows are merge joins by a hint: Spark takes their size from the files before the
explosion, and would broadcast them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgate.llm.tables import release, stored

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 64
SHARD = 1 << 14
ROUNDS = 16
RANKED_TOGETHER = 20_000
MOST_REPEATS = 3


@dataclass(frozen=True)
class Source:
    """``number`` is the place in code point order, null last."""

    number: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of all words by weight; none above ``most`` times its size, and what that cuts off
    goes to the others by weight."""
    out = [0.0] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n]
    left = float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        share = {i: left * weights[i] / total for i in free}
        over = [i for i in free if share[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """``index`` under a pseudorandom permutation of 0 … n - 1 that ``key`` chooses.

    Swap-or-not shuffle: each round pairs x with K - x modulo n and swaps the pair or not.
    """
    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        keep = F.xxhash64(*key, r, F.greatest(x, other)).bitwiseAND(1) == 0
        return F.when(keep, x).otherwise(other)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index, swap)


def _lookup(sources: list[Source], field: str, kind: str) -> Column:
    """A source's figure by its number, as a literal array."""
    values = [getattr(s, field) for s in sorted(sources, key=lambda s: s.number)]
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("number") + 1)


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"),
        F.xxhash64(f"`{text}`").alias("digest"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def _sources(sized: DataFrame, weights: tuple[float, ...], block: int) -> list[Source]:
    found = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted(found, key=lambda s: (s is None, s or ""))
    sizes = [found[s] for s in names]
    due = targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    blocks = [-(-n // block) for n in sizes]
    return [Source(i, s, n, t, b, round(t * b / n) if n else 0)
            for i, (s, n, t, b) in enumerate(zip(names, sizes, due, blocks, strict=True))]


def _offsets(sized: DataFrame, sources: list[Source], rows: int) -> DataFrame:
    """Add ``number`` and ``at``: the words of the source before this document.

    Running sums in two levels, over documents dealt by hash: sums of the deals first, then the
    rows of each deal, so a source with most of the rows is no single window.
    """
    named = [s for s in sources if s.name is not None]
    number = F.lit(len(named)).cast("int")
    if named:
        known = F.create_map(*[F.lit(x) for s in named for x in (s.name, s.number)])
        number = F.coalesce(F.try_element_at(known, F.col("source")), number)
    dealt = max(1, -(-rows // RANKED_TOGETHER))
    keyed = sized.withColumns({"number": number, "deal": F.pmod(F.xxhash64("key", "digest"), F.lit(dealt))})
    sums = keyed.groupBy("number", "deal").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("number").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = (Window.partitionBy("number", "deal").orderBy("key", "size", "digest")
           .rowsBetween(Window.unboundedPreceding, -1))
    return (keyed.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0))).join(starts, ["number", "deal"])
            .withColumn("at", F.col("before") + F.col("inside")).drop("before", "inside", "deal"))


def _slots(docs: DataFrame, sources: list[Source], seed: int) -> DataFrame:
    """``shard, slot, number, index, take, block`` of every slot: which block it holds."""
    spark = docs.sparkSession
    due = sum(s.slots for s in sources)
    shards = -(-due // SHARD)
    so_far, ends = 0, []
    for s in sources[:-1]:
        so_far += s.slots
        ends.append(F.lit(so_far / due if due else 0.0))
    draws = spark.range(shards).withColumn("slot", F.explode(F.sequence(
        F.lit(0), F.least(F.lit(SHARD), F.lit(due) - F.col("id") * SHARD).cast("int") - 1)))
    chance = F.pmod(F.xxhash64(F.lit(seed), "id", "slot"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    passed = F.filter(F.array(*ends), lambda e: e <= chance) if ends else F.array()
    counts = draws.select(F.col("id").alias("shard"), F.size(passed).alias("number")).groupBy("shard", "number").count()
    counts = stored(counts, "shard-draws")
    drawn = {r["number"]: r["n"] for r in counts.groupBy("number").agg(F.sum("count").alias("n")).collect()}
    short = [(shards, s.number, s.slots - drawn.get(s.number, 0)) for s in sources if s.slots > drawn.get(s.number, 0)]
    if short:
        counts = counts.unionByName(spark.createDataFrame(short, "shard long, number int, count long"))
    before = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))
    runs = runs.withColumn("last", F.least(F.col("first") + F.col("count"), _lookup(sources, "slots", "long")) - 1)
    # The number is given, since the few rows of runs would else be merged into one task that explodes them all.
    runs = runs.where("first <= last").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "number")
    index = runs.withColumn("k", F.explode(F.sequence("first", "last"))).withColumns({
        "n": _lookup(sources, "blocks", "long"), "slot": F.col("k") - F.col("first")})
    index = index.withColumns({"take": F.floor(F.col("k") / F.col("n")), "index": F.pmod("k", "n")})
    block = permuted(F.col("index"), F.col("n"), F.lit(seed), F.col("number"), F.col("take"))
    return index.select("shard", "slot", "number", "take", block.alias("block"))


def mixed_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                 weights: tuple[float, ...] = (1, 2, 3), block: int = BLOCK,
                 seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``(documents, placements)``.

    ``documents``: ``key, source, digest, size, number, at, source_size, target``, one row for
    each of ``docs``; ``number, at`` name a document of one word or more. ``placements``: ``shard, slot,
    number, take, at, first_word, n_words``: which words of which document a slot holds (the slots of
    a shard count per source), and in which pass over the source.

    Weights repeat over the sources in code point order, null last. Null and empty texts have
    no words and are never placed; repeated rows are documents of their own; an empty table
    gives no rows; other columns are not looked at. Equal seeds give equal mixes.
    """
    sized = stored(_sized(docs, key, text, source), "sized")
    sources = _sources(sized, weights, block)
    if not sources:
        empty = sized.withColumns({
            "number": F.lit(0), "at": F.lit(0).cast("long"), "source_size": F.lit(0).cast("long"), "target": F.lit(0.0)})
        return empty, empty.select(
            *[F.lit(0).cast("long").alias(c) for c in ("shard", "slot")], "number",
            *[F.lit(0).cast("long").alias(c) for c in ("take", "at", "first_word", "n_words")])
    documents = stored(_offsets(sized, sources, sized.count()), "offsets")
    release(documents)
    documents = documents.withColumns({
        "source_size": _lookup(sources, "size", "long"), "target": _lookup(sources, "target", "double")})
    worded = documents.where("size > 0").select("number", "at", "size").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    low = F.greatest("at", F.col("block") * block)
    high = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    parts = worded.select("number", "block", "at", (low - F.col("at")).alias("first_word"), (high - low).alias("n_words"))
    placements = _slots(docs, sources, seed).hint("merge").join(parts.hint("merge"), ["number", "block"]).select(
        "shard", "slot", "number", "take", "at", "first_word", "n_words")
    return documents, placements


def mixed_words(docs: DataFrame, **options) -> DataFrame:
    """``key, size, source_size, target, taken``: how many words the mix takes of each document."""
    documents, placements = mixed_blocks(docs, **options)
    taken = placements.groupBy("number", "at").agg(F.sum("n_words").alias("taken")).withColumn("worded", F.lit(True))
    out = documents.withColumn("worded", F.col("size") > 0).join(taken.hint("merge"), ["number", "at", "worded"], "left")
    return out.select(F.col("key").alias(options.get("key", "doc_id")), "size", "source_size", "target",
                      F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                    **options) -> DataFrame:
    """The documents of the mix, with all columns of ``docs``: a row for each pass over its source
    that takes words of a document, whose text is these words with the white space between them."""
    documents, placements = mixed_blocks(docs, key, text, source, **options)
    spans = placements.groupBy("number", "at", "take").agg(
        F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("spans"))
    chosen = documents.where("size > 0").join(spans.hint("merge"), ["number", "at"])
    copies = Window.partitionBy("key", "digest", "take").orderBy("number", "at")
    chosen = chosen.withColumn("copy", F.row_number().over(copies)).select(
        F.col("key").alias("_key"), F.col("digest").alias("_digest"), F.col("copy").alias("_copy"), "spans")
    once = Window.partitionBy("_key", "_digest").orderBy(F.lit(0))
    rows = docs.withColumns({"_key": F.col(f"`{key}`"), "_digest": F.xxhash64(f"`{text}`")})
    rows = rows.withColumn("_copy", F.row_number().over(once))
    joined = rows.join(chosen.hint("merge"), rows["_key"].eqNullSafe(chosen["_key"]) & (rows["_digest"] == chosen["_digest"])
                       & (rows["_copy"] == chosen["_copy"])).drop("_key", "_digest", "_copy")
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    # The array of one holds the words, so that the text is split once and not for each span.
    taken = F.transform(F.array(words), lambda w: F.flatten(F.transform("spans", lambda s: F.slice(
        w, s["first_word"].cast("int") + 1, s["n_words"].cast("int")))))
    return joined.withColumn(
        text, F.regexp_replace(F.array_join(F.get(taken, F.lit(0)), ""), r"^[\x20\x09-\x0D]+", "")).select(*docs.columns)
