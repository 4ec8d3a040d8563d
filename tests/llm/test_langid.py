import zlib
from collections import Counter

from corvane.llm import langid


def brute(texts):
    """Profiles and predictions by the definition, with plain strings."""

    def own(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        s = " " + " ".join(words) + " "
        n = Counter(s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1))
        for g in [g for g in n if g == " " or (len(g) == 3 and g[1] == " ")]:
            del n[g]
        return n

    def order(n):
        return sorted(n, key=lambda g: (-n[g], _key(g)))

    return own, order


def _key(g):
    k = 0
    for c in g:
        k = k << 21 | (0 if c == " " else ord(c))
    return k * 3 + len(g) - 1


def test_ranks_against_brute_force(spark, sf):
    own, order = brute(None)
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect():
        assert langid.ranked(langid.letters_of(r.text), 300).tolist() == [_key(g) for g in order(own(r.text))[:300]]


def test_profiles_and_distance_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    own, order = brute(None)
    total = {}
    for d in docs:
        if zlib.crc32(str(d.doc_id).encode()) % 3 != 1:
            total.setdefault(d.lang, Counter()).update(own(d.text))
    profiles = {k: {g: i for i, g in enumerate(order(n)[: langid.PROFILE])} for k, n in total.items()}
    got = {r.doc_id: r for r in langid.op2_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        mine = order(own(d.text))[: langid.DOC_PROFILE]
        far = {k: sum(abs(i - p[g]) if g in p else langid.PROFILE for i, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert got[d.doc_id].lang_pred == best
        assert abs(got[d.doc_id].score - (1 - far[best] / langid.PROFILE / len(mine))) < 1e-12
        assert got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = [r for r in langid.op2_language_id(spark, d).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_defined_results(spark):
    rows = [(1, "the cat sat on the mat", "en"), (1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, None, "en"), (4, "12 !? \n", None), (None, "der Hund", None), (5, "日本語の文章", None), (6, "x" * 100_000, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    model = langid.learn(df)
    assert sorted(model) == ["en", "fr"]
    got = langid.identify(df, model).collect()
    by = {r.text: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(rows) and by[None] == by["12 !? \n"] == ("und", 0.0)
    assert by["the cat sat on the mat"][0] == "en" and by["le chat est sur la table"][0] == "fr"
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(df, langid.learn(df.limit(0))).filter("lang_pred != 'und'").count() == 0
    assert langid.identify(df.limit(0), model).count() == 0
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.score for r in kept.collect()} == {"clash"} and kept.filter("text is null").count() == 0
