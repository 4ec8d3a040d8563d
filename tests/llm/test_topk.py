import math

import duckdb
import numpy as np

from corvane.llm import topk as t


def brute(rows, asked, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if asked(i):
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(ok) if m != n)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def test_blocks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.05 * rng.normal(0, 1, 8)]) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in t.top_k(df, "id % 7 = 0", block=64).collect())
    assert got == brute(rows, lambda i: i % 7 == 0)


def test_search_stops_early():
    rng = np.random.default_rng(3)
    m = np.floor(256 * np.concatenate([c + 0.01 * rng.normal(0, 1, (500, 6)) for c in rng.normal(0, 1, (8, 6))]))
    pivots = m[::500]
    d = np.sqrt(np.square(m[:, None] - pivots).sum(2)).astype(np.float32)
    seen: list = []
    ids = np.arange(len(m))
    found = list(t.search_block(m[:40], d[:40], ids, ids, m, d, 5, np.arange(40), None, seen))
    assert np.mean(seen) < 0.5 * len(m)
    # in two halves with the thresholds of the first: the same results, and the second stops earlier than alone
    floor, halves, alone, after = np.full(40, -np.inf), [], [], []
    for at, counted in ((ids[:2000], None), (ids[2000:], after)):
        halves += list(t.search_block(m[:40], d[:40], at, at, m[at], d[at], 5, np.arange(40), floor, counted))
    list(t.search_block(m[:40], d[:40], ids[2000:], ids[2000:], m[2000:], d[2000:], 5, np.arange(40), None, alone))
    best = {r: sorted((-s, i) for q, i, s in halves if q == r)[:5] for r in range(40)}
    assert best == {r: [(-s, i) for q, i, s in found if q == r] for r in range(40)} and np.mean(after) < 0.5 * np.mean(alone)


def test_defined_results(spark):
    rows = [(0, [1.0, 0.5]), (50, None), (100, []), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, [float("inf"), 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5, 9.0]), (3, [-1.0]), (1, [0.5, 0.5]), (0, [1.0, 0.25]), (None, [1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in t.top_k(df, "id % 50 = 0").collect())
    assert got == brute(rows, lambda i: i % 50 == 0)
    assert [r[1] for r in got if r[0] == 0] == sorted([1, 2, 3, 4, 5] * 2)
    assert t.top_k(df.limit(0), "id % 50 = 0").count() == 0
    assert t.top_k(df.filter("vec_id = 100"), "id % 50 = 0").count() == 0


def test_wide_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 3000).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in t.top_k(df, "id % 10 = 0", block=7).collect()) == brute(rows, lambda i: i % 10 == 0)


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in t.op5_topk(spark, sf).collect()) == sorted(con.execute(f"SELECT * FROM ({t.SQL})").fetchall())
