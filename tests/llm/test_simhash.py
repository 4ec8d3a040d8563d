import hashlib
import itertools
import random
import re

import pytest

from corvane.llm import simhash as s


def words(rng, n):
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 5))) for _ in range(n)]


def edited(rng, w, share):
    out = list(w)
    for i in rng.sample(range(len(w)), int(share * len(w))):
        out[i] = words(rng, 1)[0]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows, group = [], {}
    for g in range(60):
        base = words(rng, rng.randint(60, 300))
        for k in range(rng.choice([1, 1, 2, 5])):
            group[len(rows)] = g
            rows.append((len(rows), " ".join(base if k == 2 else edited(rng, base, 0.05 * (k > 0)))))
    return rows, group


def test_finds_near_copies_and_leaves_others(spark, corpus):
    rows, group = corpus
    got = {r.doc_id: r for r in s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for g in set(group.values()):
        assert {got[i].class_id for i in group if group[i] == g} == {min(i for i in group if group[i] == g)}
    assert sum(r.kept for r in got.values()) == len(set(group.values()))


def bits_of(texts):
    return {r.id: sum((r[f"s{k}"] % 2**64) << 64 * k for k in range(3)) for r in texts.collect()}


def close(bits):
    return {(a, b) for a, b in itertools.combinations(sorted(bits), 2) if (bits[a] ^ bits[b]).bit_count() <= s.MOST_BITS}


def with_prints(spark, rows):
    ids = spark.createDataFrame(rows, "id long, text string").withColumn("digest", s.digest_of("text"))
    return s.fingerprints(ids, "id").join(ids, "digest").selectExpr("id", "s0", "s1", "s2").dropDuplicates(["s0", "s1", "s2"])


def test_links_equal_brute_force_over_fingerprints(spark, corpus):
    rows, _ = corpus
    texts = with_prints(spark, rows).cache()
    want = close(bits_of(texts))
    found = {tuple(r) for r in s.links(texts).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)


def root_of(pairs):
    root = {i: i for p in pairs for i in p}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in root}


def test_recall_at_the_border_at_every_depth(spark):
    """Pairs that differ in just MOST_BITS places, among prefixes as deep as those of 4e3 to 7e13 texts."""
    rng = random.Random(6)
    rows, want = [], []
    for k in range(150):
        a = rng.getrandbits(192)
        b = a
        for x in rng.sample(range(192), s.MOST_BITS):
            b ^= 1 << x
        want.append((2 * k, 2 * k + 1))
        rows += [(2 * k + j, *[s._signed((v >> 64 * w) & (2**64 - 1)) for w in range(3)]) for j, v in enumerate((a, b))]
    texts = spark.createDataFrame(rows, "id long, s0 long, s1 long, s2 long").cache()
    for depth in (5, 13):
        found = {tuple(r) for r in s.links(texts, depth=depth).collect()}
        assert found <= set(want) and len(found) >= 0.85 * len(want)
    for depth in range(1, 50):
        assert 1 - (1 - s.shared(depth)) ** s.trees_needed(depth) >= s.RECALL


def test_depth_follows_density(spark):
    rng = random.Random(8)
    spread = [(i, *[s._signed(rng.getrandbits(64)) for _ in range(3)]) for i in range(4000)]
    alike = [(i, *[s._signed(rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)) for _ in range(3)]) for i in range(4000)]  # one bit in eight is set
    a, b = (s.depth_for(spark.createDataFrame(rows, "id long, s0 long, s1 long, s2 long"), 4000, 16) for rows in (spread, alike))
    assert a in (8, 9) and b > a + 8


def test_crowded_prefixes_keep_their_groups_together(spark):
    """Two groups of near copies, each far beyond the crowd, among other texts: linear links, and the classes of brute force."""
    rng = random.Random(11)
    bases = [words(rng, 150) for _ in range(2)]
    rows = [(i, " ".join(edited(rng, bases[i % 2], 0.03))) for i in range(240)] + [(1000 + i, " ".join(words(rng, 120))) for i in range(60)]
    rows += [(2000 + i, " ".join(edited(rng, words(random.Random(i // 2), 100), 0.02))) for i in range(40)]
    texts = with_prints(spark, rows).cache()
    want = close(bits_of(texts))
    found = {tuple(r) for r in s.links(texts, crowd=20, leaders=4, depth=1).collect()}
    assert found <= want and len(found) < 0.7 * len(want)
    a, b = root_of(want), root_of(found)
    assert sum(a[i] == b.get(i) for i in a) >= 0.97 * len(a)
    assert [s.trees_needed(s.DEEPER) > 1, 1 - (1 - s.shared(s.DEEPER)) ** s.trees_needed(s.DEEPER) >= s.RECALL] == [True, True]


PRINTS = "id long, s0 long, s1 long, s2 long"


def as_rows(prints):
    return [(i, *[s._signed((v >> 64 * w) & (2**64 - 1)) for w in range(3)]) for i, v in prints.items()]


def flipped(v, places):
    for x in places:
        v ^= 1 << x
    return v


def test_links_depend_on_their_two_texts_alone(spark):
    """The same pairs alone and among many other texts."""
    rng = random.Random(13)
    prints = {}
    for k in range(150):
        prints[2 * k] = rng.getrandbits(192)
        prints[2 * k + 1] = flipped(prints[2 * k], rng.sample(range(192), s.MOST_BITS))
    others = {1000 + i: rng.getrandbits(192) for i in range(20_000)}
    alone, among = ({tuple(r) for r in s.links(spark.createDataFrame(as_rows(x), PRINTS)).collect()} for x in (prints, prints | others))
    assert {p for p in among if p[1] < 1000} == alone and len(alone) >= 0.85 * 150


@pytest.mark.parametrize("seed", range(3))
def test_crowded_prefixes_lose_no_class(spark, seed):
    """Two crowded groups joined only by texts that are near no leader of the other group, texts outside that are near one of a group, and pairs that no leader is near: the classes of all pairs."""
    rng = random.Random(seed)
    prints = {}

    def add(v):
        prints[len(prints)] = v

    for _ in range(2):
        a, apart = rng.getrandbits(192), rng.sample(range(192), 80)
        b = flipped(a, apart)
        for _ in range(60):
            add(flipped(a, rng.sample(range(192), 3)))
            add(flipped(b, rng.sample(range(192), 3)))
        add(flipped(a, apart[:24]))
        add(flipped(b, apart[24:48]))
        out = flipped(a, rng.sample([x for x in range(192) if x not in apart], 34))
        add(out)
        add(flipped(out, rng.sample([x for x in range(192) if x not in apart and (a ^ out) >> x & 1 == 0], 30)))
    for _ in range(40):
        add(rng.getrandbits(192))
        add(flipped(prints[len(prints) - 1], rng.sample(range(192), 20)))
    texts = spark.createDataFrame(as_rows(prints), PRINTS).cache()
    want = {tuple(r) for r in s.links(texts, depth=1).collect()}
    found = {tuple(r) for r in s.links(texts, depth=1, crowd=20, leaders=4).collect()}
    assert found <= want <= close(prints) and len(found) < 0.7 * len(want)
    assert root_of(found) == root_of(want)


def test_fingerprint_by_definition(spark):
    texts = ["Several ordinary words, in 2 or 3 sentences; no 7 of them alike.", "one", "日本 a1", "x y x y x", " ".join(words(random.Random(1), 200))]
    prints = {bytes(r.digest): r for r in s.fingerprints(spark.createDataFrame([(1, t) for t in texts * 2], "doc_id long, text string")).collect()}
    rows = []
    for t in texts:
        w = re.findall(r"[日本]|[a-z0-9]+", t.lower())
        rows += [(t, x, None) for x in dict.fromkeys(w)] + [(t, a, b) for a, b in dict.fromkeys(zip(w, w[1:]))]
    hashed = spark.createDataFrame(rows, "t string, a string, b string").selectExpr("t", "if(b IS NULL, xxhash64(a), xxhash64(xxhash64(a), xxhash64(b))) AS h0").selectExpr("t", "h0", "xxhash64(h0, 1) AS h1", "xxhash64(h0, 2) AS h2").collect()
    assert len(prints) == len(texts)
    for t in texts:
        own = [r for r in hashed if r.t == t]
        row = prints[hashlib.md5(t.encode()).digest()]
        for k in range(3):
            assert row[f"s{k}"] % 2**64 == sum(1 << b for b in range(64) if 2 * sum((r[f"h{k}"] >> b) & 1 for r in own) > len(own))


def test_numbers_short_words_and_order_count(spark):
    rng = random.Random(12)
    w = words(rng, 80)
    base = " ".join(w)
    rows = [(1, base), (2, " ".join(reversed(w))), (3, " ".join(x + str(i) if i % 3 else x for i, x in enumerate(w))), (4, base + " not at all"), (5, " ".join(x if i % 4 else "no" + str(i) for i, x in enumerate(w)))]
    got = {r.doc_id: r.class_id for r in s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5}


def test_query_over_its_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in s.op9_simhash(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = {}
    for d in sorted(texts):
        first.setdefault(texts[d], d)
    prints = {r.digest: r for r in s.fingerprints(docs).collect()}
    of = {r.doc_id: prints.get(r.digest) for r in docs.select("doc_id", s.digest_of("text").alias("digest")).collect()}
    bits = {d: sum((of[d][f"s{k}"] % 2**64) << 64 * k for k in range(3)) for d in first.values() if of[d] and of[d].s0 is not None}
    want = close(bits)
    root = root_of([*want, *[(first[texts[d]], d) for d in texts if texts[d] is not None]])
    assert len(got) == len(texts)
    assert sum(got[d].class_id == root.get(d, d) for d in got) >= 0.99 * len(got)
    assert sum(r.kept for r in got.values()) == len({r.class_id for r in got.values()})


def test_components_against_brute_force(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)]
    root = {i: i for e in edges for i in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["class"] for r in s.components(spark.createDataFrame(edges, "id_a long, id_b long")).collect()}
    linked = {i for a, b in edges if a != b for i in (a, b)}
    assert got == {i: root[i] for i in linked}


def test_defined_results(spark):
    long_ = "alpha bravo charlie delta echoes foxtrot golfing hotels india juliet " * 2000
    rows = [(5, None), (6, None), (7, ""), (8, ""), (9, long_), (3, long_ + "x"), (1, "that it."), (2, "it that."), (4, "that it."), (4, "that it."), (10, "?!"), (None, "that it."), (11, "日本語の文章です"), (12, "one text here"), (12, "quite another document")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, class_id string")
    got = s.near_duplicates(df).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add((r.class_id, r.kept))
    assert of[5] == {(5, True)} and of[6] == {(6, True)} and of[7] == {(7, True)} and of[8] == {(7, False)}
    assert of[9] == {(3, False)} and of[3] == {(3, True)} and of[4] == {(1, False)} and of[2] == {(2, True)} and of[None] == {(None, True)}
    assert of[10] == {(10, True)} and of[11] == {(11, True)} and of[12] == {(12, True)}
    kept = s.one_of_each(df)
    assert kept.columns == df.columns and {r.class_id for r in kept.collect()} == {"clash"}
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 10, 11, 12, 12]
    assert s.near_duplicates(df.limit(0)).count() == 0 and s.one_of_each(df.limit(0)).count() == 0


def test_one_row_of_those_alike_in_id_and_text(spark):
    rows = [(1, "a few words of this text", "z"), (1, "a few words of this text", "b"), (2, "a few words of this text", "a"), (1, "something else altogether 12", "y"), (3, None, "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = s.near_duplicates(df).collect()
    assert sum(r.kept for r in judged) == 4 and sorted(tuple(r) for r in s.one_of_each(df).collect() if r.text) == sorted([rows[1], rows[3]])
    assert s.one_of_each(df).count() == 4
