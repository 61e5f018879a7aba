import random

import numpy as np

from cases import documents, odd_rows
from pitgate.llm import langid, toxicity

TONGUES = {"aa": "ka ke ki ko ku ta te", "bb": "zor zur mor mur lor lur", "cc": "éti éto été çan çon"}


def speech(lang, seed, n=40):
    rng = random.Random(seed)
    parts = TONGUES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def spoken(n):
    return [(i, speech(lang, i), "s", lang) for i, lang in zip(range(n), list(TONGUES) * n, strict=False)]


def test_languages_are_told_apart_on_unseen_words(spark):
    model = langid.train(documents(spark, spoken(90)))
    rows = [(1000 + i, speech(lang, 5000 + i), None, lang) for i, lang in enumerate(list(TONGUES) * 20)]
    out = {r["doc_id"]: r for r in langid.with_language(documents(spark, rows), model, keep=["doc_id"]).collect()}
    right = [out[k]["lang_pred"] == lang for k, _, _, lang in rows]
    assert np.mean(right) > 0.97 and all(0 <= r["score"] <= 1 for r in out.values())
    single = [(1, "kakakakokukate!"), (2, "ZORMORLURZUR 123"), (3, "étoçonçané")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.with_language(documents(spark, single), model, keep=["doc_id"]).collect()}
    assert got == {1: "aa", 2: "bb", 3: "cc"}


def test_language_of_odd_cases(spark):
    model = langid.train(documents(spark, spoken(30)))
    rows = [*odd_rows(), (30, "123 !!! 456", None, None), (31, "слово", None, None),
            (32, "\u0301\u0301 \u0902", None, None), (33, "\u0301 e\u0301te", None, None)]
    out = langid.with_language(documents(spark, rows), model).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r["lang_pred"] for r in out}
    assert [by[k] for k in (1, 2, 3, 30, 32)] == ["und"] * 5 and by[31] in TONGUES and by[33] in TONGUES and by[4] in TONGUES


def test_language_without_training_rows_or_documents(spark):
    none = langid.train(documents(spark, []))
    out = langid.with_language(documents(spark, [(1, "some words")]), none).collect()
    assert [(r["lang_pred"], r["score"]) for r in out] == [("und", 0.0)]
    assert langid.with_language(documents(spark, []), none).collect() == []


def rude(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ws = speech("aa", seed * 10_000 + i, 60).split()
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(["blasted", "dolt", "wretched"]))
        out.append((i, " ".join(ws), toxic))
    return out


def test_toxic_words_and_their_misspellings_score_high(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 30)
    rows = rude(400)
    taught = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(taught)
    test = rude(100, 1) + [(500, speech("aa", 1, 30) + " blassted dollt wretchedd blasteed", 1)]
    got = {r["doc_id"]: r["score"] for r in toxicity.toxic_scores(documents(spark, [r[:2] for r in test]), model).collect()}
    high = [got[k] for k, _, t in test if t and k != 500]
    low = [got[k] for k, _, t in test if not t]
    assert min(high) > max(low) and np.mean(np.array(high) >= 0.5) > 0.9 and got[500] > np.median(low)


def test_toxicity_of_odd_cases(spark):
    taught = spark.createDataFrame([*rude(60), (90, None, 1), (91, "no label", None)], "doc_id long, text string, toxic int")
    out = toxicity.toxic_scores(documents(spark, odd_rows()), toxicity.train(taught)).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in out)
    empty = toxicity.train(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert [r["score"] for r in toxicity.toxic_scores(documents(spark, [(1, "x")]), empty).collect()] == [0.5]
    assert toxicity.toxic_scores(documents(spark, []), empty).collect() == []


def test_bounded_sample_is_bounded_when_a_key_or_a_row_repeats(spark):
    many = [(7, f"text {i}") for i in range(300)] + [(8, "same")] * 300 + [(None, f"null {i}") for i in range(300)]
    rows = many + [(100 + i, "x") for i in range(100)]
    df = spark.createDataFrame(rows, "key long, text string")
    distinct = set(rows)
    for limit in (1, 50, 350, 701, 5000):
        got = [tuple(r) for r in langid.bounded_sample(df.repartition(5), "key", limit).collect()]
        assert len(got) == len(set(got)) == min(limit, len(distinct)) and set(got) <= distinct
        assert sorted(got, key=repr) == sorted((tuple(r) for r in langid.bounded_sample(df, "key", limit).collect()), key=repr)
    assert langid.bounded_sample(df.limit(0), "key", 5).collect() == []


def test_rare_words_of_the_sample_count(spark):
    """Every word of the sample is known, however many there are."""
    texts = [(i, " ".join(f"{a}{b}{c}x" for a in "bcdfghjklm" for b in "aeiou" for c in letters), None, lang)
             for i, (letters, lang) in enumerate((("bcdfg", "aa"), ("lmnpq", "bb"), ("rstvw", "aa")))]
    model = langid.train(documents(spark, texts))
    assert len(model.words) == 750
    got = {r["doc_id"]: r["lang_pred"] for r in langid.with_language(
        documents(spark, [(1, "bacx", None, None), (2, "baqx mopx", None, None)]), model, keep=["doc_id"]).collect()}
    assert got == {1: "aa", 2: "bb"}
