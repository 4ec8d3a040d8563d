from collections import defaultdict

import duckdb
import pytest

from corvane.llm import mixing


def level(sizes: dict, share=1.5, cap=2):
    """Targets by pouring the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        full = {s for s in open_ if target[s] + part[s] >= cap * sizes[s]}
        if not full:
            for s in open_:
                target[s] += part[s]
            break
        for s in full:
            left -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
        open_ -= full
    return target


def check(rows, docs):
    sizes, source = defaultdict(int), {}
    for i, t, s in docs:
        sizes[s] += len((t or "").split())
    want = level(sizes)
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    return taken, want


def test_against_brute_force(spark):
    docs = [(i, "w " * (i * 37 % 190), f"s{i % 5}" if i % 3 else "big") for i in range(3000)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    taken, want = check(rows, docs)
    assert all(abs(taken[s] - want[s]) < 0.02 * want[s] + 190 for s in want)
    again = mixing.mix(spark.createDataFrame(docs[::-1], "doc_id long, text string, source string").repartition(7)).collect()
    assert {r.doc_id: r.copies for r in rows} == {r.doc_id: r.copies for r in again}


def test_defined_results(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (3, "one two", None), (None, "x y z", "b"), (4, "w " * 100_000, "é"), (5, None, "void")]
    df = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id long, text string, source string, size string, target string")
    rows = mixing.mix(df).collect()
    taken, want = check(rows, docs)
    assert taken["void"] == want["void"] == 0
    assert mixing.mix(df.limit(0)).count() == 0
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in rows)
    assert {(r["size"], r.target) for r in out.collect()} == {("clash", "clash")}
    rows = mixing.sized(spark.createDataFrame([(None, f"w{i} x", "a") for i in range(500)], "doc_id long, text string, source string"))
    assert rows.select("__bin").distinct().count() > 400  # rows without an id aren't one hot bin


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall())
    assert sorted(tuple(r) for r in mixing.op7_mixing(spark, sf).collect()) == want
