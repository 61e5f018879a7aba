"""Line deduplication by a log-template tree, with DataFrame functions only.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, in
which a token with a digit is a variable field. Lines of a leaf are held against the line that
most documents of the leaf share: those that agree with it in :data:`ALIKE` tenths of
their tokens or more, fields not counted as agreeing, are one template, and where they differ
is a variable field. A template of ``min_docs`` documents recurs, and its lines are dropped.

Equal texts count as one document, so copying a document makes no template of its lines.
What travels per line is a few hashes; texts are fetched for one line of each different kind in
leaves that many documents share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgate.llm.tables import components, stored

LEADING = 3
ALIKE = 6
LEAST_TOKENS = 3
FIELD = "<*>"
SKETCH = 256
KEYS = 8
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def masked(line: Column) -> Column:
    """The line's tokens with single spaces, and a field where a token holds a digit."""
    uneven = F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r"))
    tidy = F.trim(F.when(uneven, F.regexp_replace(line, r"[ \t\r]+", " ")).otherwise(line))
    return F.when(tidy.rlike("[0-9]"), F.regexp_replace(tidy, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(tidy)


def _placed(texts: DataFrame) -> DataFrame:
    """``rid, pos, leaf, kind`` of every line; the leaf is null below :data:`LEAST_TOKENS` tokens.

    The filter comes after these are stored: before, it would have every line masked twice.
    """
    lines = texts.select("rid", F.posexplode(F.split("body", "\n")).alias("pos", "raw"))
    lines = lines.select("rid", "pos", masked(F.col("raw")).alias("line"))
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    leaf = F.when(n >= LEAST_TOKENS, F.xxhash64(n, F.substring_index("line", " ", LEADING)))
    return lines.select("rid", "pos", leaf.alias("leaf"), F.xxhash64("line").alias("kind"))


def line_table(docs: DataFrame, text: str = "text", min_docs: int = 10) -> tuple[DataFrame, DataFrame]:
    """What :func:`recurring_lines` decides on, both stored: ``leaf, kind, rid, pos`` of the lines in leaves that
    ``min_docs`` texts or more share, and ``leaf, kind, n_docs, line`` with the masked form of each kind."""
    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(
        F.xxhash64(f"`{text}`").alias("rid"), F.col(f"`{text}`").alias("body"))
    thin = stored(_placed(rows), "lines").where("leaf is not null").distinct()
    busy = (thin.select("leaf", "rid").distinct().groupBy("leaf").count()
            .where(F.col("count") >= min_docs).select("leaf"))
    near = stored(thin.join(busy, "leaf"), "busy-leaves")
    kinds = near.groupBy("leaf", "kind").agg(
        F.count_distinct("rid").alias("n_docs"), F.min(F.struct("rid", "pos")).alias("one"))
    wanted = kinds.groupBy("one.rid").agg(F.collect_list(F.struct("leaf", "kind", "n_docs", "one.pos")).alias("ks"))
    once = rows.join(wanted, "rid").dropDuplicates(["rid"])
    found = once.select(F.split("body", "\n").alias("lines"), F.explode("ks").alias("k")).select(
        "k.leaf", "k.kind", "k.n_docs", masked(F.get("lines", F.col("k.pos"))).alias("line"))
    return near, stored(found, "line-kinds")


def recurring_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, groups: DataFrame | None = None,
                    every_kind: bool = False, table: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``rid, drop``: the numbers (from 0) of the lines to drop, by the hash of the text.

    The texts of a group of ``groups`` (rid, grp) count as one document. With ``every_kind`` a line
    also goes if ``min_docs`` documents share its masked form and a token of that is no field, whatever
    else is in the leaf. ``table`` is the :func:`line_table` of these documents where it is there already.
    """
    near, found = table or line_table(docs, text, min_docs)
    if groups is None:
        near = near.withColumn("grp", F.col("rid"))
    else:
        near = stored(near.join(groups, "rid", "left").withColumn("grp", F.coalesce("grp", "rid")), "grouped-lines")
        counts = near.groupBy("leaf", "kind").agg(F.count_distinct("grp").alias("n_docs"))
        found = found.drop("n_docs").join(counts, ["leaf", "kind"])
    modal = found.groupBy("leaf").agg(F.min(F.struct((-F.col("n_docs")).alias("n"), "line")).alias("m")).select(
        "leaf", F.col("m.line").alias("modal"))
    same = F.aggregate(F.zip_with(F.split("line", " "), F.split("modal", " "), lambda x, y: (x == y) & (x != FIELD)), F.lit(0),
                       lambda s, x: s + x.cast("int"))
    members = found.join(modal, "leaf").where(10 * same >= ALIKE * F.size(F.split("line", " "))).select("leaf", "kind")
    belonging = near.join(members, ["leaf", "kind"])
    often = (belonging.select("leaf", "grp").distinct().groupBy("leaf").count()
             .where(F.col("count") >= min_docs).select("leaf"))
    gone = belonging.join(often, "leaf").select("rid", "pos")
    if every_kind:
        shared = found.where((F.col("n_docs") >= min_docs) & F.exists(F.split("line", " "), lambda x: x != FIELD))
        gone = gone.unionByName(near.join(shared.select("leaf", "kind"), ["leaf", "kind"]).select("rid", "pos"))
    return gone.groupBy("rid").agg(F.collect_set("pos").alias("drop"))


def _sketched(texts: DataFrame, n: int) -> DataFrame:
    """``rid, sketch``: the :data:`SKETCH` least hashes of each text's ``n``-word shingles, in order. ``words`` are
    to be stored, as the shingles refer to them one by one; fewer than ``n`` words are one shingle, none have no row."""
    size = F.size("words")
    shingles = F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.xxhash64(F.slice("words", i, n))))
    shingles = shingles.otherwise(F.array(F.xxhash64("words")))
    return texts.where(size > 0).select("rid", F.slice(F.array_sort(F.array_distinct(shingles)), 1, SKETCH).alias("sketch"))


def near_groups(docs: DataFrame, text: str = "text", min_docs: int = 10, share: float = 0.5,
                n: int = 5, percent: int = 80, every_kind: bool = False,
                table: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``rid, grp`` of near copies among the texts of which more than ``share`` of the characters are recurring lines.

    Two texts are near copies if they share ``percent`` of their ``n``-word shingles, estimated from the
    :data:`SKETCH` least hashes of both, which is exact where both together have no more. A text meets, for each of
    its :data:`KEYS` least hashes, the first text that has it among its own, so a group of any size makes a few
    pairs for each text; what these pairs join is a group. Texts that are in none have no row.
    """
    body = F.col(f"`{text}`")
    rows = docs.where(body.isNotNull()).select(F.xxhash64(body).alias("rid"), body.alias("body"))
    rows = rows.join(recurring_lines(docs, text, min_docs, every_kind=every_kind, table=table), "rid")
    less = F.array_join(F.filter(F.split("body", "\n"), lambda x, i: ~F.array_contains("drop", i)), "\n")
    mostly = rows.where(F.char_length("body") - F.char_length(less) > F.lit(share) * F.char_length("body"))
    words = F.filter(F.split(F.translate("body", CAPITALS, CAPITALS.lower()), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    mostly = stored(mostly.dropDuplicates(["rid"]).select("rid", words.alias("words")), "mostly-recurring")
    sketches = stored(_sketched(mostly, n), "line-sketches")
    keys = sketches.select("rid", F.explode(F.slice("sketch", 1, KEYS)).alias("h"))
    first = keys.groupBy("h").agg(F.min("rid").alias("hub"))
    pairs = keys.join(first, "h").where("rid != hub").select("rid", "hub").distinct()
    met = pairs.join(sketches, "rid").join(
        sketches.select(F.col("rid").alias("hub"), F.col("sketch").alias("other")), "hub")
    least = F.slice(F.array_sort(F.array_union("sketch", "other")), 1, SKETCH)
    met = met.select("rid", "hub", F.size(least).alias("all"),
                     F.size(F.array_intersect(least, F.array_intersect("sketch", "other"))).alias("both"))
    links = met.where(100 * F.col("both") >= percent * F.col("all")).select(F.col("rid").alias("a"), F.col("hub").alias("b"))
    return components(links, "line-links").select(F.col("node").alias("rid"), F.col("root").alias("grp"))


def without_templates(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 10,
                      most_share: float = 1.0, groups: DataFrame | None = None, every_kind: bool = False,
                      table: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped from their text, and ``_n_lines`` and
    ``_n_dropped`` added. ``groups``, ``every_kind`` and ``table`` as in :func:`recurring_lines`.

    A document of which more than ``most_share`` of the characters would go keeps them all: it
    is a copy as a whole, and its place is in the deduplication of documents. Null texts stay
    null and have no lines; an empty text has one empty line; lines with fewer than
    :data:`LEAST_TOKENS` tokens are never dropped. Repeated rows are treated alike. All other
    columns are kept as they are; names that clash with ``_n_lines`` and ``_n_dropped`` are replaced.
    """
    columns = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    drops = recurring_lines(docs, text, min_docs, groups, every_kind, table).select(F.col("rid").alias("_rid"), F.col("drop").alias("_drop"))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.xxhash64(f"`{text}`").alias("_rid")).join(drops, "_rid", "left")
    body = F.col(f"`{text}`")
    rows = rows.withColumn("_all", F.split(body, "\n")).withColumn("_kept", F.when(
        F.col("_drop").isNull(), F.col("_all")).otherwise(F.filter("_all", lambda x, i: ~F.array_contains("_drop", i))))
    less = F.array_join("_kept", "\n")
    whole = F.col("_drop").isNull() | (
        F.char_length(body) - F.char_length(less) > F.lit(most_share) * F.char_length(body))
    return rows.select(
        *[F.when(whole, body).otherwise(less).alias(c) if c == text else F.col(f"`{c}`") for c in columns],
        F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("_n_lines"),
        F.when(whole, 0).otherwise(F.size("_all") - F.size("_kept")).cast("long").alias("_n_dropped"))
