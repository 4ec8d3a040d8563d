import zlib

import numpy as np
import pytest

from corvane.llm import quality as q


def test_density_ratio_equals_the_definition():
    rng = np.random.default_rng(1)
    d = 5
    groups = {0: rng.normal(1, 2, (40, d)), 1: rng.normal(0, 1, (90, d)) @ rng.normal(0, 1, (d, d))}
    m = q.fit({k: (len(v), v.sum(0), v.T @ v) for k, v in groups.items()}, 0.2, 0.1, 1.0)
    x = rng.normal(0, 1, (7, d))
    whole = np.concatenate(list(groups.values()))
    z = {k: (v - whole.mean(0)) / whole.std(0) for k, v in groups.items()}
    common = sum(len(v) * np.cov(v.T, bias=True) for v in z.values()) / len(whole)
    g = []
    for v in z.values():
        a = 0.2 + 0.8 * d / (d + len(v))
        c = (1 - a) * np.cov(v.T, bias=True) + a * common
        c = 0.9 * c + 0.1 * np.trace(c) / d * np.eye(d) + 1e-9 * np.eye(d)
        e = (x - whole.mean(0)) / whole.std(0) - v.mean(0)
        g.append(np.log(len(v) / len(whole)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(g[0] - g[1])))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in q.op1_quality(spark, d).collect()}
    docs = [r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()]
    assert sorted(got) == sorted(docs)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.3) for i in docs)
    held = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.quality for r in held) > 0.95 * len(held)


def test_defined_results(spark, tmp_path):
    docs = [(i, t, "clash") for i, t in enumerate([None, "", "word", "a b c " * 40_000, "The same text.", "The same text."])] + [(None, "no id", "clash")]
    labels = [(1, 0), (2, 1), (3, 1), (4, None), (5, 7), (2, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = q.op1_quality(spark, str(tmp_path)).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 7 and by[0] == by[1] and by[4] == by[5] and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("labels, share", [([], 0.5), ([(1, 1)], 1.0), ([(1, 0)], 0.0)])
def test_without_both_classes(spark, labels, share):
    df = q.features(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))
    m = q.fit(q.moments(df.join(spark.createDataFrame(labels, "doc_id long, quality int"), "doc_id"), "quality"))
    assert [r.score for r in q.score(df, m).collect()] == [share]
    assert q.score(df.limit(0), m).count() == 0
