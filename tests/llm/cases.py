"""Frames with the odd cases that every operator must take."""

import random

CLASHING = ("id string, rid string, size string, n string, pos string, gram string, count string, leaf string, "
            "rank string, score string, lang_pred string, key string, at string, body string, piece string")
SHAPE = f"doc_id long, text string, source string, lang string, {CLASHING}"
N_CLASHING = CLASHING.count(",") + 1


def words(n, seed=0, vocabulary=4000):
    rng = random.Random(seed)
    letters = str.maketrans("0123456789", "uvwxyzghij")
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(vocabulary)}".translate(letters)
                    for _ in range(n))


def documents(spark, rows):
    """(doc_id, text[, source[, lang]]) rows with clashing extra columns."""
    full = [(*r, *[None] * (4 - len(r)), *["x"] * N_CLASHING) for r in rows]
    return spark.createDataFrame(full, SHAPE)


def odd_rows():
    """Nulls, empty texts, white space, one word, a very long text, repeated rows, ties."""
    long = words(30_000, 1)
    return [
        (1, None, "a", "en"), (2, "", "a", "en"), (3, " \t\n ", None, "en"), (4, "One", "b", None),
        (5, long, "b", "en"), (6, long, "b", "en"), (7, words(80, 2), None, "de"), (7, words(80, 2), None, "de"),
        (None, words(40, 3), "c", "fr"), (8, "é" * 500, "c", "fr"), (9, "a" * 700, "c", "fr")]
