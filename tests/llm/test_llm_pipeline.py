import re
from pathlib import Path

import pytest

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cases import documents, words
from pitgate.llm import queries, tables
from pitgate.llm.tables import components, stored
from test_llm_ngram_join import brute


def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf), name))
    return out


@pytest.fixture(scope="module")
def done(spark):
    return stages(spark, "/root/testdata/sf0.001")


def test_stages_keep_the_columns_of_documents(done):
    assert all(x.columns == done[0].columns for x in done[1:-1])
    assert [x.count() > 0 for x in done] == [True] * 6


def test_language_keeps_what_has_letters(done):
    before = {r["doc_id"]: r["text"] for r in done[0].collect()}
    after = {r["doc_id"] for r in done[1].collect()}
    assert all(not re.search(r"[^\W\d_]", before[k] or "") for k in before.keys() - after)


def test_line_dedup_only_drops_lines(done):
    before = {r["doc_id"]: r["text"].split("\n") for r in done[1].collect()}
    for r in done[2].collect():
        lines = iter(before.pop(r["doc_id"]))
        assert all(any(x == y for y in lines) for x in r["text"].split("\n")) and r["n_chars"] == len(r["text"])
    assert not before


def test_one_document_of_each_group_stays(done):
    rows = [(r["doc_id"], r["text"]) for r in done[2].collect()]
    assert {r["doc_id"] for r in done[3].collect()} == {root for _, _, root in brute(rows, 5, 80)}


def test_mix_and_packing(done):
    def words(r):
        return len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))

    assert abs(sum(map(words, done[4].collect())) - sum(map(words, done[3].collect()))) < 64 * 20
    assert done[5].where("piece = 0").count() == done[4].count()


def test_run_takes_an_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    df = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 300), (300, 250), (5, 5)]
    df = components(spark.createDataFrame(links, "a long, b long"))
    got = {r["node"]: r["root"] for r in df.collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {200: 200, 300: 200, 250: 200}


@pytest.mark.parametrize(("links", "rounds"), [([(1, 9), (1, 8), (2, 7)], 0), ([], 0), ([(3, 2), (2, 1)], 1)])
def test_components_makes_no_round_once_edges_are_stars(spark, monkeypatch, links, rounds):
    made = []
    monkeypatch.setattr(tables, "stored", lambda df, name: made.append(name) or stored(df, name))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == ({1: 1, 9: 1, 8: 1, 2: 2, 7: 2} if len(links) == 3 else {1: 1, 2: 1, 3: 1} if links else {})
    assert len(made) == 1 + rounds


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_other_queries_return_a_row_per_document(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).count()
    source = {"op10": "pages", "op3_": "embeddings"}.get(name[:4], "documents")
    assert rows >= (1 if source == "embeddings" else spark.read.parquet(f"{sf}/{source}.parquet").count())


def test_boilerplate_goes_where_it_is_most_of_a_text_and_near_copies_keep_theirs(spark):
    common = "\n".join(words(12, 900 + i) for i in range(4))
    body = [words(14, 700 + i) for i in range(20)]
    rows = [(i, f"{common}\n{words(6, i)}") for i in range(12)]
    rows += [(100 + i, "\n".join([*body, words(5, 300 + i)])) for i in range(12)]
    out = {r["doc_id"]: r["text"] for r in pipeline.repeated_lines(
        spark, documents(spark, rows).withColumn("n_chars", F.lit(0)), "").collect()}
    assert all(out[i] == words(6, i) for i in range(12))
    assert all(out[k] == text for k, text in rows[12:])
