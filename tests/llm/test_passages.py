import random
import re

from corvane.llm import passages as p


def sentence(rng, n):
    w = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n)]
    return " ".join(w).capitalize() + "."


def paragraph(rng, n):
    return " ".join(sentence(rng, rng.randint(3, 20)) for _ in range(n))


def test_units_do_not_depend_on_what_is_around():
    rng = random.Random(2)
    for _ in range(200):
        passage = paragraph(rng, rng.randint(2, 6))
        own = {u[2:] for u in next(p.units([passage]))}
        mixed = f"{sentence(rng, 9)} some small words {passage} and it goes on."
        base = mixed.index(passage)
        held = {i for s, e, *h in next(p.units([mixed])) if tuple(h) in own for i in range(s - base, e - base)}
        left = "".join(" " if i in held else c for i, c in enumerate(passage)).split()
        assert len(left) < 16 and held <= set(range(len(passage)))  # shorter rests at its ends may stay


def test_units_cover_words_and_offsets():
    text = "One two three four five six seven eight nine. Short one.\nAlpha beta gamma delta epsilon zeta eta theta iota."
    got = next(p.units([text]))
    assert [text[s:e] for s, e, *_ in got] == ["One two three four five six seven eight nine.", *text.split("\n")]
    low = next(p.units([re.sub("[.]", ",", text.lower())]))
    assert [u[2:] for u in low] == [u[2:] for u in got[1:]]
    short = "It is so. We go on. You see it too. They do."
    assert [short[s:e] for s, e, *_ in next(p.units([short]))] == ["It is so. We go on. You see it too.", short]
    assert list(p.units(["", " \n ", "a"])) == [[], [], []]


def brute(docs):
    """Removal by the definition: the first occurrence by (doc_id, start) stays. Per document a set of the code points that go."""
    first, out = {}, {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        gone = set()
        for s, e, *h in next(p.units([t])) if t else []:
            if first.setdefault(tuple(h), (d, s)) != (d, s):
                gone |= set(range(s, e))
        out[d] = gone
    return out


def norm(t):
    return " ".join(w for w in ("".join(c for c in x if c.isalnum()) for x in t.lower().split()) if w)


def check(docs, got):
    """What must hold whatever the units are: texts can be put together again, what goes stands in its keeper, and white space alone goes besides."""
    want, text_of = brute(docs), dict(docs)
    for d, t in docs:
        r = got[d]
        if t is None:
            assert r.text is None and r.removed == []
            continue
        left, whole, at = r.text, [], 0
        for x in r.removed:
            assert at <= x.start < x.end <= len(t)
            whole += [left[: x.start - at], t[x.start : x.end]]
            left, at = left[x.start - at :], x.end
        assert "".join([*whole, left]) == t and r.removed_chars == len(t) - len(r.text)
        spans = {i for x in r.removed for i in range(x.start, x.end)}
        assert want[d] <= spans and not "".join(t[i] for i in spans - want[d]).strip()
        for x in r.removed:
            assert x.first_doc_id <= d
            if x.first_doc_id == d:
                assert norm(t[x.start : x.end]).split()[0] in norm(t[: x.start])


def test_against_brute_force(spark):
    rng = random.Random(5)
    shared = [paragraph(rng, 4) for _ in range(5)]
    docs = []
    for d in range(80):
        parts = [paragraph(rng, 3) for _ in range(3)]
        for s in rng.sample(shared, rng.randint(0, 2)):
            k = rng.randrange(3)
            w = parts[k].split()
            at = rng.randint(1, len(w) - 1)
            parts[k] = " ".join(w[:at] + [s] + w[at:])
        docs.append((d, "\n".join(parts)))
    docs.append((80, docs[3][1]))
    got = {r.doc_id: r for r in p.remove_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) == len(docs)
    check(docs, got)
    for d, t in docs:
        for x in got[d].removed:  # each piece, sentence by sentence, stands before it somewhere
            for piece in re.split(r"(?<=\.)\s+", t[x.start : x.end].strip()):
                assert any(norm(piece) in norm(u) for e, u in docs if e < d) or norm(t).count(norm(piece)) > 1
    assert len(got[80].text) < 0.3 * len(docs[3][1])
    for s in shared:
        long_ = [u for u in re.findall(r"[A-Z][^.]*\.", s) if len(u.split()) > 8]
        for u in long_:
            assert sum(u in t and u in got[d].text for d, t in docs) <= 1


def test_query_against_brute_force(spark, sf):
    got = {r.doc_id: r for r in p.op10_passages(spark, sf).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(got) == len(docs)
    check(docs, got)


def test_defined_results(spark):
    line = "This line has rather more than eight words in it."
    rows = [(1, None), (2, ""), (3, line), (4, line.upper()), (4, line.upper()), (None, line), (5, f"{line}\nrest\n{line}\n"), (6, "tiny"), (7, "tiny"), (8, "w " * 50_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, removed string")
    got = p.remove_passages(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].text is None and by[2].text == "" and by[3].text == line and by[4].text == "" and by[None].text == ""
    assert by[5].text == "rest\n" and by[5].removed_chars == 2 * len(line) + 2 and by[6].text == by[7].text == "tiny" and by[8].text == "w " * 50_000
    assert p.remove_passages(df.limit(0)).count() == 0
    kept = p.without_passages(df)
    assert kept.columns == df.columns and {r.removed for r in kept.collect()} == {"clash"}


GERMAN = "Der Hund des Bauern lief am Morgen durch das Tor zur Straße. Die Frau im Garten sah den Nachbarn mit dem Wagen und rief ihm einen Gruß zu. Am Abend kam der Sohn aus der Stadt mit einem Korb voller Äpfel und setzte sich an den Tisch. Das Fenster zum Hof stand offen und der Wind trug den Geruch von Heu ins Zimmer."
NAMES = "On Monday Anna Jones met Peter in Berlin and went to Paris with Maria. The letter from London reached Tom in March when Susan and Robert sat with Clara near Vienna. In April Henry told Lucy that Oscar of Denmark had left Rome for Madrid and that Emma from Oslo was with George in Lisbon."
LINES = "\n".join(["the river runs below the hill", "a light goes out at night", "no bird is heard till dawn", "the wind has lost its way", "my boat lies on the sand", "her name is in the stone", "we count the days of rain", "old songs come back in spring", "and nobody asks them to stay"])
CHINESE = "昨天下午我们一起去了城外的河边散步。天气很好。孩子们在草地上放风筝。老人坐在树下喝茶聊天，说起了许多从前的故事。后来下起了小雨。大家都跑到桥下躲雨。等到傍晚雨停的时候天边出现了一道彩虹。"


def test_other_kinds_of_text_get_units_and_are_removed(spark):
    rng = random.Random(8)
    for passage in (GERMAN, NAMES, LINES, CHINESE):
        held = {i for s, e, *_ in next(p.units([passage])) if (s, e) != (0, len(passage)) for i in range(s, e)}
        assert len(held) > 0.5 * len(passage)  # not by the passage as a whole alone
        docs = [(d, "\n\n".join([paragraph(rng, 5), passage, paragraph(rng, 5)])) for d in range(3)]
        got = {r.doc_id: r for r in p.remove_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got[0].text == docs[0][1]
        for d in (1, 2):
            assert got[d].removed_chars > 0.9 * len(passage) and len(got[d].text) >= len(docs[d][1]) - len(passage) - 4


def test_borders_depend_on_what_is_near():
    rng = random.Random(3)
    lines = ["\n".join(" ".join(rng.choices(["lake", "tree", "stone", "path", "cloud", "bird", "snow"], k=5)) for _ in range(n)) for n in (40, 11, 14)]
    inner = lambda t: {u[2:] for u in next(p.units([t])) if u[1] - u[0] < len(t)}
    own = inner(lines[0])
    assert len(own) >= 8
    assert len(own & inner(f"{lines[1]}\n{lines[0]}\n{lines[2]}")) >= len(own) - 3
    repeated = next(p.units(["\n".join(["buy one get one free now"] * 30)]))
    assert len({u[2:] for u in repeated}) <= 3 and len(repeated) > 10


def test_unique_words_between_repeats_stay(spark):
    a, b = "Alpha beta gamma delta epsilon zeta eta theta iota.", "Kappa lambda mu nu xi omicron pi rho sigma."
    docs = [(1, f"{a}\n{b}"), (2, f"{a} Unique tiny words here. {b}"), (3, f"It began. {a} So it was. {b} It ended."), (4, f"Elsewhere. {a} So it was. {b} Over."), (5, f"{a} Unique tiny words here. {b}")]
    got = {r.doc_id: r for r in p.remove_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    check(docs, got)
    assert [got[d].text for d in range(1, 6)] == [docs[0][1], "Unique tiny words here. ", "It began. So it was. It ended.", "Elsewhere. Over.", ""]


def test_cuts():
    text = "one two\n  three four \nfive six"
    assert p.cuts(text, [(0, 7, 1)]) == [(0, 8, 1)] and p.cuts(text, [(4, 7, 1)]) == [(4, 7, 1)]
    assert p.cuts(text, [(10, 15, 2), (16, 20, 3)]) == [(10, 16, 2), (16, 22, 3)]
    assert p.cuts(text, [(16, 20, 3), (10, 18, 2)]) == [(10, 22, 2)]
    assert p._without(text, p.cuts(text, [(10, 20, 2)])) == "one two\n  five six"
