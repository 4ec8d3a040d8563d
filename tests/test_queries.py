import pytest

from corvane.functions import columns as C
from corvane.operators import catalog, checks, ingest, library, search, stats
from corvane.plans import catalogue
from corvane.session import scratch
from corvane.sources.entries import entries
from tests.parity import compare, connect


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert compare(spark, connect(sf), name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], sf) == ""


def hits(df):
    return {(r.archive, r.entry_id, r.title_match, r.body_match) for r in df.collect()}


def test_index_finds_what_a_scan_finds(spark, sf):
    rows = entries(spark, sf).cache()
    path = scratch(spark, "index")
    search.write_index(rows, path, 0.3, 20)  # prunes many grams
    posts, pruned = search.read_index(spark, path)
    assert pruned.count() > 100 and posts.join(pruned, ["archive", "idx", "gram"]).isEmpty()
    whole = search.postings(rows).cache()
    for q in ("the of", "THAT", "é la", "the of"):  # asked again, the answer stays
        want = hits(search.scan(rows, q))
        assert hits(search.search_index(whole, q, None)) == want
        # pruned grams don't count: more may be found, never less, unless all of a query's grams are pruned
        least = {h for h in hits(search.search_index(posts, q, None, pruned=pruned))}
        every = search.pruned_grams(whole, 0.3, 20).filter(search.F.col("gram").isin(search.query_grams(q))).groupBy("archive", "idx").count().filter(f"count = {len(search.query_grams(q))}").collect()
        gone = {(r.archive, r.idx) for r in every}
        assert {(a, e) for a, e, t, b in want if (t and (a, "title") not in gone) or (b and (a, "body") not in gone)} <= {(a, e) for a, e, *_ in least}
    for q in ("ab", "", "é"):
        assert search.search_index(posts, q, None).count() == 0 and search.scan(rows, q).count() == 0
    page = [tuple(r) for r in search.search_index(whole, "that", 10).collect()]
    assert page == [tuple(r) for r in search.search(rows, "that", 10).collect()] and len(page) == 10
    assert [r.entry_id for r in search.search_index(whole, "than", 10, titles_only=True).collect()] == [r.entry_id for r in search.search(rows, "than", 10, titles_only=True).collect()]


E = "archive string, entry_id long, path string, title string, mime_type string, is_front boolean, content string, size long"


def test_pruned_grams_do_not_hide_hits(spark):
    rows = spark.createDataFrame([(a, i, f"x/{i}", f"common word{i % 3}", "text/plain", True, "", 1) for i in range(40) for a in "ab"] + [("c", 1, "x", "common word1", "text/plain", True, "", 1)], E)
    posts = search.postings(rows).cache()
    pruned = search.pruned_grams(posts, 0.5, 10)
    assert search.lookup(posts, "common word1", pruned).filter("idx = 'title'").count() == 2 * 13 + 1
    assert [r.archive for r in search.lookup(posts, "common", pruned).filter("idx = 'title'").collect()] == ["c"]  # an archive of one prunes nothing


def test_indexes_of_large_archives_are_whole(spark):
    rows = spark.range(1200).selectExpr("'a' archive", "id entry_id", "concat('x/', id) path", "'common' title", "'text/plain' mime_type", "true is_front", "if(id % 3 = 0, 'common', 'commxmmon') content", "6L size")
    path = scratch(spark, "index")
    search.write_index(rows, path)
    posts, pruned = search.read_index(spark, path)
    assert pruned.isEmpty() and hits(search.search_index(posts, "common", None, pruned=pruned)) == hits(search.scan(rows, "common")) != set()
    assert posts.filter(f"gram = {0x636F6D}").groupBy("idx").count().orderBy("idx").collect() == [("body", 1200), ("title", 1200)]


def test_a_task_holds_few_rows_grams_at_once(monkeypatch):
    b = search.pa.RecordBatch.from_pydict({"archive": ["a", "b", None, "a", "a", "a"], "content": ["x" * 9, None, "", "y" * 9, "z" * 30, "w"]})
    whole = [x.content.tolist() for x in search._slices(b)]
    assert whole == [["x" * 9, "y" * 9, "z" * 30, "w"], [None], [""]]
    monkeypatch.setattr(search, "_SLICE", 10)
    assert [x.content.tolist() for x in search._slices(b)] == [["x" * 9], [None], [""], ["y" * 9], ["z" * 30, "w"]]


def test_non_ascii_case_and_cjk(spark):
    rows = spark.createDataFrame([("a", 1, "p", "École", "text/plain", True, "日本語", 1), ("a", 2, "q", "z", "text/html", True, "<p>中国</p>å本", 1), ("a", 3, "r", "w", "text/plain", True, None, 1), ("b", 1, "s", "日本", "image/png", False, "日本", 1)], E)
    posts = search.postings(rows).cache()
    for q, want in (("École", {("a", 1, True, True)}), ("日本", {("a", 1, False, True)}), ("日国", set()), ("中国", {("a", 2, False, True)}), ("本", {("a", 1, False, True), ("a", 2, False, True)}), ("xyz", set())):
        assert hits(search.search_index(posts, q, None)) == hits(search.scan(rows, q)) == want
    assert [r.entry_id for r in search.search(rows, "日本", verify=True).collect()] == [1]
    assert {r.idx: r.df for r in search.frequencies(rows).filter("gram = " + str(0x51756F)).collect()} == {}


def test_pages_are_parsed_once(spark):
    rows = spark.createDataFrame([("a", 1, "p", "t", "text/html", True, "<p>x</p>", 1)], E)
    plan = search.scan(rows, "that")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_text_of_pages_without_the_parser(spark):
    from corvane.functions import text as T

    for page in ["<p>a<b>b</b> c</p>", "<!doctype html><title>T</title><p class=\"a b\" id='x'>q &amp; r<!-- no --> s</p>", "<script>var a = '</p>';</script>x", "1 < 2 <p>y", "<style>p{}</style><svg><title>k</title></svg>", "<p title=\"a > b\">z</p>", "<P>u<BR/>v</P >", "a<!--->b-->c", "<script>x", "<title>a &lt; b</title><p>c", "<a href=x>y</a><?php z ?>w", ""]:
        assert T.visible_text(page) == T.parsed_text(page), page
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        assert T.visible_text(r.html) == T.parsed_text(r.html)


def test_letters_of_mixed_case(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["Apple", "apple", "Zed", "_x", "9", "", "Apple", "banana", "Éa"])], "entry_id long, title string")
    assert {r.letter: r.entries for r in catalog.letter_counts(rows).collect()} == {"A": 3, "Z": 1, "B": 1, "#": 3}
    assert [r.entry_id for r in catalog.browse_letter(rows, "A").collect()] == [0, 6, 1]


def test_ranks_are_global(spark):
    rows = spark.createDataFrame([((i * 7919) % 5000,) for i in range(5000)], "v long").repartition(8)
    assert all(r.rank == r.v + 1 for r in catalog.ranked(rows, "v").collect())


def test_running_sums_and_greedy_packing(spark):
    import random

    rng = random.Random(4)
    data = [(a, i, f"p{i:04}", rng.choice([0, 10, 100, 5000]), "text/plain") for a in "ab" for i in range(1500)]
    rows = spark.createDataFrame(data, "archive string, entry_id long, path string, size long, mime_type string")
    sums, at = {}, {}
    for a, i, _, size, _ in data:
        sums[a, i] = at.get(a, 0)
        at[a] = sums[a, i] + size
    for parts in (1, 7):
        got = catalog.running(rows.repartition(parts), ("archive",), ("path", "entry_id")).collect()
        assert {(r.archive, r.entry_id): r.before for r in got} == sums
        packed = {(r.archive, r.entry_id): (r.chunk_key, r.chunk, r.blob_offset) for r in ingest.pack_chunks(rows.repartition(parts), 3000).collect()}
        state, want, before = {}, {}, {}
        for a, i, _, size, _ in data:
            key = "other-small" if size < 4096 else "other"
            stretch = before.get((a, key), 0) // (ingest.STRETCH * 3000)
            chunk, used = state.get((a, key, stretch), (0, 0))
            if used >= 3000:
                chunk, used = chunk + 1, 0
            want[a, i] = (key, f"{stretch}-{chunk}", used)
            state[a, key, stretch] = (chunk, used + size)
            before[a, key] = before.get((a, key), 0) + size
        assert packed == want


def test_archives_are_kept_apart(spark):
    """The same numbers in two archives."""
    rows = spark.createDataFrame([(a, i, f"p{i}", f"t{i}", "text/plain", True, f"{a if i == 2 else ''}{i % 2}", 1) for a in "ab" for i in range(4)], E)
    assert {(r.archive, r.entry_id): r.blob_owner for r in ingest.first_occurrences(rows).collect()} == {(a, i): [0, 1, 2, 1][i] for a in "ab" for i in range(4)}
    assert sorted((r.archive, r.id) for r in ingest.assign_ids(rows).collect()) == [(a, i) for a in "ab" for i in range(4)]
    from pyspark.sql import functions as F

    recorded = rows.select("archive", "entry_id", F.sha2("content", 256).alias("digest"))
    assert checks.verify_entries(rows, recorded).filter("ok").count() == 8
    assert checks.verify_entries(rows, recorded.withColumn("archive", F.translate("archive", "ab", "ba"))).filter("ok").count() == 6
    redirects = spark.createDataFrame([("a", 10, "r", 2), ("b", 10, "r", 3), ("b", 11, "s", 10), ("b", 12, "t", 99)], "archive string, redirect_id long, path string, target_id long")
    assert {tuple(r) for r in catalog.resolve(redirects, rows).collect()} == {("a", 10, 2, "resolved"), ("b", 10, 3, "resolved"), ("b", 11, 3, "resolved"), ("b", 12, None, "broken")}
    assert {(r.archive, r.path): r.content for r in catalog.resolved_content(rows, redirects).collect() if r.path in "rst"} == {("a", "r"): "a0", ("b", "r"): "1", ("b", "s"): "1"}
    m = spark.createDataFrame([("a", "main_entry", "p1"), ("b", "main_entry", "p3")], "archive string, key string, value string")
    assert {(r.archive, r.entry_id) for r in catalog.main_entry(rows, m).collect()} == {("a", 1), ("b", 3)}


def test_scalar_functions(spark):
    row = lambda *c: spark.range(1).select(*c).first()
    from pyspark.sql import functions as F

    assert [row(C.mime_group(F.lit(m)))[0] for m in ("text/html; charset=utf-8", "text/css", "text/javascript", "image/svg+xml", "image/png", "font/woff")] == ["html", "css", "js", "svg", "image", "other"]
    assert row(C.chunk_key(F.lit("image/png"), F.lit(5)), C.chunk_key(F.lit("text/css"), F.lit(4095)), C.chunk_key(F.lit("text/css"), F.lit(4096)))[:] == ("image", "css-small", "css")
    assert [row(C.path_tokens(F.lit(p)))[0] for p in ("", "a", "a/b", "a/")] == [[], ["a"], ["a/", "b"], ["a/", ""]]
    assert row(C.parse_uri(F.lit("archive://s/entry/12")))[0][:] == ("s", 12) and row(C.parse_uri(F.lit("x")))[0][:] == (None, None)
    assert row(C.human_bytes(F.lit(1536)), C.human_bytes(F.lit(7)), C.percent_bar(F.lit(0.5), 4))[:] == ("1.5 KB", "7 B", "##..")
    assert [row(C.namespace_path(F.lit(n), F.lit("p")))[0] for n in ("C", "-", "W", "M", "I")] == ["p", "p", "_well_known/p", None, "_other/I/p"]
    assert [row(ingest.shared_prefix(F.lit(a), F.lit(b)))[0] for a, b in (("abc", "abd"), ("", "a"), ("x", "x"), ("q", "r"), ("éa", "éb"), ("é", "è"), ("abc", "ab"))] == [2, 0, 1, 0, 2, 1, 2]
    assert row(C.short_bytes(F.lit(1536)), C.comma_number(F.lit(1234567)), C.uptime(F.lit(93784)), C.uptime(F.lit(245)), C.uptime(F.lit(5)), C.dashed_uuid(F.lit("00112233445566778899AABBCCDDEEFF")))[:] == ("1K", "1,234,567", "1d 2h", "4m 5s", "5s", "00112233-4455-6677-8899-aabbccddeeff")
    assert row(C.flags_line({"minify": F.lit(True), "level": F.lit(6), "search": F.lit(False), "name": F.lit(None).cast("string")}))[0] == "--level=6 --minify"
    assert [row(C.is_binary_mime(F.lit(m)))[0] for m in ("text/css", "application/json", "image/png", "application/pdf")] == [False, False, True, True]
    from corvane.functions import text as T

    assert T.entry_href("a b", "x/ü ?.html#1") == "/a%20b/x/%C3%BC%20%3F.html%231" and T.entry_href("s", "") == "/s/"
    assert row(T.entry_href_udf(F.lit("s"), F.lit("p/q%")))[0] == "/s/p/q%25"
    assert T.markdown_to_html("# T *x*\n\na **b**\nc [l](u) `x<y`\n\n- i\n- j\n\n1. k\n\n> q\n\n```\n<p>\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---") == "<h1>T <em>x</em></h1>\n<p>a <strong>b</strong>\nc <a href=\"u\">l</a> <code>x&lt;y</code></p>\n<ul><li>i</li><li>j</li></ul>\n<ol><li>k</li></ol>\n<blockquote><p>q</p></blockquote>\n<pre><code>&lt;p&gt;</code></pre>\n<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>\n<hr>"
    assert T.minify("  // c\n  let a = 1;\n\n b();", "js") == "let a = 1;\nb();" and T.minify("x = `\n  // no`", "js") == "x = `\n  // no`"


def test_profiles(spark):
    base = dict(text_ratio=0.5, html_ratio=0.2, image_ratio=0.0, pdf_ratio=0.0, video_ratio=0.0, redirect_density=0.2, small_ratio=0.1, avg_bytes=9000.0, mime_types=3, hint="")
    cases = [({"pdf_ratio": 0.4}, "pdf-container"), ({"image_ratio": 0.5, "video_ratio": 0.2}, "media-heavy"), ({"redirect_density": 0.5, "small_ratio": 0.8, "text_ratio": 0.9}, "dictionary"), ({"hint": "stackexchange"}, "qa-forum"),
             ({"avg_bytes": 90000.0, "redirect_density": 0.0, "text_ratio": 0.9}, "books"), ({"text_ratio": 0.9, "redirect_density": 0.01}, "docs"), ({"html_ratio": 0.4}, "encyclopedia"), ({}, "mixed-scrape"),
             ({"text_ratio": -1.0, "hint": "wiktionary"}, "dictionary"), ({"text_ratio": -1.0}, "mixed-scrape")]
    rows = spark.createDataFrame([(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)], ["i", *base])
    got = stats.recommend(stats.classify(rows)).orderBy("i").collect()
    assert [r.profile for r in got] == [w for _, w in cases] and got[4].chunk_size == 8 << 20


def test_checks_and_library(spark):
    m = spark.createDataFrame([("a", "title", "t"), ("a", "title", "u"), ("b", "catalog", "not json")], "archive string, key string, value string")
    assert [(r.archive, r.key) for r in checks.duplicate_keys(m).collect()] == [("a", "title")]
    assert checks.missing_metadata(m).count() == 9
    assert [r.slug for r in library.catalog_items(m).collect()] == [None]
    e = spark.createDataFrame([("a", 1, "p", "T", "text/html", True, "<h2>One</h2><p>x</p><h2>Two</h2><p>y y y</p>", 9)], "archive string, entry_id long, path string, title string, mime_type string, is_front boolean, content string, size long")
    assert library.read_entry(e, "a", 1, section="two", source=True).first().text == "# T\n\nTwo y y y\n\n[source: /a/p]"
    assert library.entry_resource(e, "archive://a/entry/1").first().text.startswith("<h2>") and library.entry_resource(e, "x").count() == 0
    assert library.read_entry(e, "a", 1, section="two").first().text == "# T\n\nTwo y y y"
    assert library.read_entry(e, "a", 1, "markdown", most=8).first().text == "# T\n\n## \n\n[truncated]"


def test_reports(spark, sf):
    import json

    from corvane.operators import reports
    from corvane.sources.entries import redirects

    e, r = entries(spark, sf), redirects(spark, sf)
    rows = reports.listing(e, r).collect()
    assert [x.path for x in rows] == sorted((x.path for x in rows), key=str.encode) and sum(x.kind == "redirect" for x in rows) == r.count()
    lines = reports.search_lines(e, "that").collect()
    assert len(lines) == 20 and all(x.tag in ("T", "B", "TB") and len(x.path) <= 40 for x in lines)
    assert json.loads(reports.info(e, r).first().info)["content_entries"] == e.count()
    m = lambda v: spark.createDataFrame([("title", v)], "key string, value string")
    out = reports.comparison(e.filter("archive = 'src0'"), e.filter("archive = 'src1'"), m("x"), m("y")).collect()
    assert ("metadata", "title", "x", "y") in [tuple(x) for x in out]


def test_chunks_and_dictionaries(spark, sf):
    import zstandard

    e = entries(spark, sf).cache()
    packed = ingest.pack_chunks(e, 1 << 16).cache()
    chunks = {(r.archive, r.chunk_key, r.chunk): zstandard.decompress(bytes(r.data), r["size"]) for r in ingest.compress_chunks(packed, e).collect()}
    text = {(r.archive, r.entry_id): r.content.encode() for r in e.collect()}
    assert all(chunks[r.archive, r.chunk_key, r.chunk][r.blob_offset : r.blob_offset + r.size] == text[r.archive, r.entry_id] for r in packed.collect())
    got = ingest.train_dictionaries(e, 200, 4096).collect()
    assert all(len(r.dictionary) <= 4096 for r in got)
    m = spark.createDataFrame([("a", "Title", "t")], "archive string, key string, value string")
    assert {r.key: r.value for r in ingest.metadata_defaults(m, "2024-01-01").collect()} == {"title": "t", "language": "eng", "creator": "Unknown", "date": "2024-01-01", "source": "a"}


def test_metadata_rules(spark):
    def said(numeric=False, **pairs):
        rows = [("a", k, v) for k, v in (dict(title="t", language="en", creator="c", date="2024-01-02", source="s") | pairs).items() if v is not None]
        return {(r.key, r.message) for r in checks.validate_metadata(spark.createDataFrame(rows, "archive string, key string, value string"), numeric_main_entry=numeric).collect()}

    assert said() == set() and said(title=None) == {("title", "required but not there")}
    for blank in ("", " ", "\t", "\u00a0\u2003"):
        assert said(title=blank) == {("title", "a blank value")}
    assert all(said(favicon_entry=x) == set() for x in ("0", "4294967295", "007")) and all(said(favicon_entry=x) for x in ("9999999999", "4294967296", "x", "-1", "", "1.5", "99999999999999999999"))
    assert said(main_entry="x") == set() and said(main_entry=" ") and said(True, main_entry="x") and not said(True, main_entry="12")
    assert all(said(date=x) == set() for x in ("2024-02-29", "2024-02-29T10:00:00Z", "2024-02-29T10:00:00.5+02:00")) and all(said(date=x) for x in ("2023-02-29", "2024-13-01", "2024-1-1", "now", "2024-02-29T25:00:00Z"))
    assert not said(language="eng-x") and said(language="e") and said(language="EN") and said(language="english")
    m = spark.createDataFrame([("a", "title", "t")], "archive string, key string, value string")
    assert checks.missing_metadata(m, spark.createDataFrame([("a",), ("b",)], "archive string")).count() == 9


def test_trusted_signatures(spark):
    s = spark.createDataFrame([("a", 0, "AA", 7, True), ("a", 1, "aa", 8, False), ("a", 2, "bb", 9, True)], "archive string, nth int, public_key string, key_id long, valid boolean").selectExpr("archive", "nth", "lower(public_key) AS public_key", "key_id", "valid")
    assert [tuple(r) for r in checks.trusted_signatures(s, ["aa"]).collect()] == [("a", "aa", 7, True)]
