import re
import unicodedata
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


TEXTS = [None, "", " \n\t", "one", "a b", "a b c", "a a a", "a a a a", "a b c a b c", "a b c x a b c y b c x", "x|y # $ \n x|y # $ \n\n", "é É 日本 é É 日本 z", "w " * 5000, " ".join(f"w{i % 997}" for i in range(20_000))]


def counted(spark, texts):
    rows = rules.statistics(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, n_words string")).orderBy("doc_id").collect()
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows]


def test_statistics_against_brute_force(spark):
    assert counted(spark, TEXTS) == [brute(t) for t in TEXTS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab \n#é", max_size=40), min_size=20, max_size=60))
def test_statistics_on_random_texts(spark, texts):
    assert counted(spark, texts) == [brute(t) for t in texts]


def test_query_against_brute_force(spark, sf):
    got = {r.doc_id: r for r in rules.op3_quality_rules(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    full, patterns = {}, Counter()
    for d in docs:
        n, chars, sym, dup, rep = brute(d.text)
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text)
        lines = [x for x in d.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        kind = Counter(unicodedata.category(c) for c in d.text)
        letters = sum(v for k, v in kind.items() if k[0] == "L")
        alnum = letters + sum(v for k, v in kind.items() if k[0] == "N")
        bare = sum(not any(unicodedata.category(c)[0] in "LN" for c in x) for x in w)
        r = [sym / n, alnum / chars, bare / n, rep / n, len(set(w)) / n, dup / len(lines), kind["Lu"] / letters, d.text.count("!") / n, chars / n, n]
        good = [r[0] < 0.03, r[1] > 0.92, r[2] < 0.02, r[3] < 0.2, r[4] > 0.35, r[5] < 0.05, r[6] < 0.1, r[7] < 0.02, 3 <= r[8] <= 10, n >= 100]
        bad = [r[0] > 0.1, r[1] < 0.89, r[2] > 0.1, r[3] > 0.4, r[4] < 0.15, r[5] > 0.3, r[6] > 0.3, r[7] > 0.2, r[8] < 2.5 or r[8] > 12, n < 50]
        full[d.doc_id] = tuple(0 if y else 1 if x else None for x, y in zip(good, bad))
        patterns[full[d.doc_id]] += 1
        failed = n < 50 or 100 * rep > 50 * n
        assert (got[d.doc_id].n_words, got[d.doc_id].word_chars, got[d.doc_id].n_symbols, got[d.doc_id].n_dup_lines, got[d.doc_id].n_repeat_words, got[d.doc_id].base_failed) == (n, chars, sym, dup, rep, failed)
    prior, rates = rules.estimate(list(patterns.items()))
    for i, v in full.items():
        assert got[i].kept == (not got[i].base_failed and rules.posterior(v, prior, rates) >= 0.5)


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = rules.op3_quality_rules(spark, sf)
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({rules.SQL})").fetchall())


def test_estimation_finds_a_noisy_rule():
    width = len(rules.RULES)
    clean, junk = (1,) * width, (0, 0, 0) + (1,) * (width - 3)
    noisy = (1,) * (width - 2) + (0, 1)
    prior, rates = rules.estimate([(clean, 800), (junk, 100), (noisy, 100)])
    assert rules.posterior(junk, prior, rates) < 0.01 < 0.99 < rules.posterior(noisy, prior, rates)
    assert 0.85 < prior < 0.95


def test_verdicts_agree_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in rules.op3_quality_rules(spark, d).collect()}
    rows = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if not got[r.doc_id].base_failed]
    assert sum(got[r.doc_id].kept == bool(r.quality) for r in rows) > 0.98 * len(rows)


def test_empty_table(spark):
    voted = rules.votes(rules.statistics(spark.createDataFrame([], "doc_id long, text string")))
    assert rules.judge(voted, rules.fit(voted)).count() == 0
