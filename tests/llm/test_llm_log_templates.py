from pyspark.sql import functions as F

from cases import documents, odd_rows, words
from pitgate.llm import log_templates as module
from pitgate.llm.log_templates import masked, near_groups, without_templates
from test_llm_ngram_join import brute


def run(spark, rows, **options):
    docs = documents(spark, rows)
    out = without_templates(docs, min_docs=3, **options)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    return {r["doc_id"]: (r["text"], r["_n_lines"], r["_n_dropped"]) for r in out.collect()}


def test_fields_are_masked(spark):
    df = spark.createDataFrame([("  user a12  took\t3 s\r", ), ("none here", ), ("", )], "x string")
    assert [r[0] for r in df.select(masked(F.col("x"))).collect()] == ["user <*> took <*> s", "none here", ""]


def test_recurring_templates_go_and_others_stay(spark):
    rows = [(i, f"{words(9, i)}\nSent from my phone number {i} by {'abcd'[i % 4]}\n{words(7, 50 + i)}") for i in range(6)]
    rows += [(10, "Sent from my other device altogether today friend thanks\nA line of its own"), (11, "a b\na b\na b")]
    out = run(spark, rows)
    for i in range(6):
        assert out[i] == (f"{words(9, i)}\n{words(7, 50 + i)}", 3, 1)
    assert out[10] == (rows[6][1], 2, 0) and out[11] == (rows[7][1], 3, 0)


def test_copies_make_no_template(spark):
    text = f"{words(9, 1)}\n{words(9, 2)}"
    assert all(x == (text, 2, 0) for x in run(spark, [(i, text) for i in range(9)]).values())


def test_documents_that_are_mostly_templates_may_stay(spark):
    rows = [(i, f"The same line of words here\n{words(2, i)}") for i in range(5)]
    assert run(spark, rows)[0][2] == 1 and run(spark, rows, most_share=0.5)[0] == (rows[0][1], 2, 0)


def test_odd_cases(spark):
    out = run(spark, odd_rows())
    assert out[1] == (None, 0, 0) and out[2] == ("", 1, 0) and out[5][0] == dict((r[0], r[1]) for r in odd_rows())[5]
    assert run(spark, []) == {}


def test_every_shared_masked_form_goes_beside_the_template_of_its_leaf(spark):
    rows = [(i, f"Click here to subscribe to our daily newsletter\n{words(5, i)}") for i in range(4)]
    rows += [(10 + i, f"Click here to view all comments on article\nPage {i} of 17\n{i} {i + 1} {i + 2}\n{words(6, 20 + i)}")
             for i in range(3)]
    out, plain = run(spark, rows, every_kind=True), run(spark, rows)
    assert all(out[i] == (words(5, i), 2, 1) for i in range(4))
    assert all(out[10 + i] == (f"{i} {i + 1} {i + 2}\n{words(6, 20 + i)}", 4, 2) for i in range(3))
    assert all(plain[i][2] == 1 for i in range(4)) and all(plain[10 + i][2] == 0 for i in range(3))


def near_cases():
    """Fifteen near copies, five copies of another text that differ too much, one text alone; all end in a shared line."""
    tail = "this line of eight words is in all"
    base, other = words(150, 1).split(), words(150, 2).split()
    rows = []
    for i in range(15):
        mine = list(base)
        mine[7 * i % 150] = f"Changed{chr(97 + i)}"
        rows.append((i, " ".join(mine) + "\n" + "\n".join([tail] * 40)))
    for i in range(5):
        mine = [w if k % 6 else f"w{chr(97 + i)}{chr(97 + k % 26)}" for k, w in enumerate(other)]
        rows.append((100 + i, " ".join(mine) + "\n" + "\n".join([tail] * 40)))
    return [*rows, (200, "\n".join([tail] * 9))]


def grouped(spark, rows):
    docs = documents(spark, rows)
    groups = {r["rid"]: r["grp"] for r in near_groups(docs, every_kind=True).collect()}
    rid = {r["doc_id"]: r["rid"] for r in docs.select("doc_id", F.xxhash64("text").alias("rid")).collect()}
    return {k: groups.get(v, v) for k, v in rid.items()}


def test_near_groups_equal_brute_force(spark):
    rows = near_cases()
    got = grouped(spark, rows)
    want = {k: root for k, _, root in brute(rows, 5, 80)}
    assert len({want[k] for k in range(15)}) == 1 and len(set(want.values())) > 2
    for a in want:
        assert {b for b in want if got[a] == got[b]} == {b for b in want if want[a] == want[b]}


def test_near_groups_of_odd_texts(spark):
    assert len(grouped(spark, odd_rows())) == len({r[0] for r in odd_rows()}) and grouped(spark, []) == {}


def test_the_line_stage_runs_no_python(spark, monkeypatch):
    plans, inner = [], module.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return inner(df, name)

    monkeypatch.setattr(module, "stored", seen)
    monkeypatch.setattr("pitgate.llm.tables.stored", seen)
    docs = documents(spark, near_cases())
    table = module.line_table(docs)
    out = without_templates(docs, groups=near_groups(docs, every_kind=True, table=table), every_kind=True, table=table)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("InArrow" in p or "Python" in p or "Pandas" in p for p in plans)
    assert max(p.count("Exchange ") for p in plans) < 40
