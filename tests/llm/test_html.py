import html
import re

from corvane.llm import html as h


def test_query_against_the_articles(spark, sf):
    got = {r.page_id: r for r in h.op6_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"(?s)<article>(.*?)</article>", p.html).group(1)
        want = " ".join(html.unescape(re.sub(r"<(/?)(\w+)[^>]*>", lambda m: "" if m.group(2) in ("b", "a", "i") else " ", article)).split())
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


CASES = [
    (None, ""),
    ("", ""),
    ("plain text &amp; more", "plain text & more"),
    ("<p>a<b>b</b>c<br>d</p><div>e</div>", "abc d e"),
    ("<body><nav>menu<ul><li>x</ul></nav><header>site</header><main><header><h1>T</h1></header><p>x &lt; y</p><aside>s</aside><form>f</form></main><footer>z</footer>", "T x < y"),
    ("<article><p>text<div class='cookie-notice'>no</div><p class=ad>no<p>more<section id=comments><p>no</section><script>var a='</p>'</script></article>", "text more"),
    ("<article><p>unclosed <b>bold <p>next<article class=comment>no</article>", "unclosed bold next"),
    ("<!-- <p>no</p> --><p title='a > b'>yes &copy; &nbsp; &#233;</p><style>p{}</style>", "yes © é"),
    ("<div hidden>no</div><div style='display: none'>no</div><p>1 < 2</p>", "1 < 2"),
]


def test_pages_by_tags_alone():
    for source, want in CASES:
        assert h.main_text(source) == want


def test_template_text_goes_where_no_element_says_what_is_main(spark):
    page = "<html><body><div>Our great site</div><div><p>{}</p><p>{}</p></div><div>All wrongs reserved</div></body></html>"
    rows = [(i, f"http://Host.example/{i}", page.format(f"Story {i} begins", f"and ends {i * 7}"), "clash") for i in range(30)]
    rows += [(100 + i, "http://one.example/x", page.format("Only", "page"), "clash") for i in range(2)] + [(200, None, None, "x"), (201, "nonsense", "<p>q", "x"), (1, rows[1][1], rows[1][2], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for bound in (h.BROADCAST_TOKENS, 0):
        got = h.extract(df, broadcast_tokens=bound).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.page_id < 100:
                assert r.text == f"Story {r.page_id} begins and ends {r.page_id * 7}"
        by = {r.page_id: r.text for r in got}
        assert by[100] == "Our great site Only page All wrongs reserved" and by[200] == "" and by[201] == "q"
    assert h.extract(df.limit(0)).count() == 0


def test_classes_must_be_in_order_and_nest():
    keys = [(k, place) for place, k in enumerate([1, 5, 6, 2, 7, 3])]
    assert h.valid_template(keys, [(9, [1, 2, 3])]) == {0, 3, 5}
    assert h.valid_template(keys, [(9, [2, 1])]) == set()
    assert h.valid_template(keys, [(9, [1, 2, 3]), (5, [5, 6])]) == {0, 1, 2, 3, 5}
    assert h.valid_template(keys, [(9, [1, 2, 3]), (5, [6, 7])]) == {0, 3, 5}
    assert h.valid_template(keys, [(9, [1, 8])]) == set()


def test_template_text_inside_the_main_element_goes(spark):
    page = "<html><body><nav>menu</nav><article><h1>Story {0}</h1><div class='x1'>Read our other stories</div><p>It begins {0}.</p>{1}<div>We like letters</div></article></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i, "<p>Sometimes more.</p>" * (i % 3 == 0))) for i in range(30)]
    # a host of four with two copies keeps them, and so do pages that are nothing but the text of most others
    rows += [(100 + i, f"http://two.example/{i}", f"<article><p>Copy {max(i, 1)}</p></article>") for i in range(4)]
    rows += [(200 + i, f"http://same.example/{i}", "<article><p>All the same</p></article>") for i in range(6)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert got[i] == f"Story {i} It begins {i}." + " Sometimes more." * (i % 3 == 0)
    assert [got[100 + i] for i in range(4)] == ["Copy 1", "Copy 1", "Copy 2", "Copy 3"]
    assert {got[200 + i] for i in range(6)} == {"All the same"}


def test_text_that_pages_repeat_is_template(spark):
    page = "<html><body><div>Subscribe now</div>{2}<p>Story {0}</p><p>ends {1}</p><div>Share it</div><div>Share it</div><div>Rights</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i, 7 * i, "<div>Subscribe now</div>" * (i == 3))) for i in range(30)]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Story {i} ends {7 * i}" for i in range(30)}
    keys = [(k, place) for place, k in enumerate([1, 2, 9, 1, 2, 3, 3])]
    assert h.valid_template(keys, [(9, [1, 2]), (9, [3])]) == {0, 1, 3, 4, 5, 6}
    assert h.valid_template(keys, [(9, [2, 1])]) == set() and h.valid_template(keys, [(9, [2, 3])]) == {1, 4, 5, 6}


def brute_template(pages, share=h.SHARE, min_pages=h.MIN_PAGES):
    """Classes of one host from real occurrence vectors."""
    counts, places = {}, {}
    for n, source in enumerate(pages):
        seen = set()
        for key, place in h.keys_of(h.parse(source)):
            counts.setdefault(key, [0] * len(pages))[n] += 1
            if key not in seen:
                places.setdefault(key, []).append(place)
            seen.add(key)
    by = {}
    for key, v in counts.items():
        if sum(map(bool, v)) >= max(min_pages, share * len(pages)):
            by.setdefault(tuple(v), set()).add(key)
    return {(sum(map(bool, v)), frozenset(keys)) for v, keys in by.items()}, {k: sum(p) / len(p) for k, p in places.items()}


def test_templates_equal_brute_force_over_occurrence_vectors(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    rows += [(10_000 + i, "http://mixed.example/", f"<body><nav>a</nav>{'<div class=box>buy</div>' * (i % 3)}<main><h1>T{i}</h1><p>x{i}</p>{'<p>more</p>' * (i % 2)}</main></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", h.host_of()).cache()
    hosts = {}
    for r in df.collect():
        hosts.setdefault(r.host, []).append(r.html)
    got = {r.host: r.classes for r in h.templates(df).collect()}
    assert len(got) > 2
    for host, pages in hosts.items():
        want, place = brute_template(pages) if len(pages) >= h.MIN_PAGES else (set(), {})
        assert {(c["pages"], frozenset(c["keys"])) for c in got.get(host, [])} == want
        for c in got.get(host, []):
            assert [place[k] for k in c["keys"]] == sorted(place[k] for k in c["keys"])


def extracted(spark, pages, **options):
    rows = [(i, "http://h.example/", p) for i, p in enumerate(pages)]
    return [r.text for r in sorted(h.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect(), key=lambda r: r.page_id)]


def test_without_the_template_the_result_is_worse(spark):
    """Boilerplate under neutral names inside the article, and a layout of divs without an article: the host's template finds both."""
    story = [f"The {n}th story tells of day {n * 7}" for n in range(40)]
    inside = ["<body><nav>m</nav><article><div>Read this first</div><h1>{0}</h1><p>{1} and it goes on for a while.</p><div>Tell your friends</div></article></body>".format(n, s) for n, s in enumerate(story)]
    # one page alone can't tell its side column, here longer than the story, from the story
    divs = ["<body><div class='one'><div>{2}</div></div><div class='two'><h2>{0}</h2><p>{1} and it goes on for a while.</p></div></body>".format(n, s, "Weather for the coming days: rain, then sun, and wind from the west for all of us. " if n % 4 == 0 else f"Now {n}") for n, s in enumerate(story)]
    for pages, want in ((inside, [f"{n} {s} and it goes on for a while." for n, s in enumerate(story)]), (divs, [f"{n} {s} and it goes on for a while." for n, s in enumerate(story)])):
        assert extracted(spark, pages) == want
        off = extracted(spark, pages, min_pages=10**9)
        assert sum(a == b for a, b in zip(off, want)) <= 30 and all(set(w.split()) <= set(o.split()) or "Weather" in o for o, w in zip(off, want))


def test_names_and_broken_markup_lose_no_text(spark):
    for source, want in [
        ("<article><p>One.</p><p class='share-price'>Price rose.</p></article>", "One. Price rose."),
        ("<article><p>One.</p><div class='social history'>Two.</div><section id='related-work'>Three.</section></article>", "One. Two. Three."),
        ("<article><p>So <math><mi>x</mi>=1</math> holds.</p></article>", "So x=1 holds."),
        ("<article><p>One <svg><path d='M0'><p>Two.</p><p>Three.</p></article>", "One Two. Three."),
        ("<article><title>x<p>One.</p></article>", "x One."),
        ("<article><p>One.</p><iframe src=x></iframe><object><p>no</p></object><noscript>no</noscript><p>Two.</p></article>", "One. Two."),
        ("<article><h1>H</h1><p>Quite some text.</p><div class='ad-slot'>no</div><div class='comment-list'>no</div><ul class='share buttons'><li>no</ul></article>", "H Quite some text."),
        ("<body><div class=menu><h1>Menu</h1><p>Soup and bread, fish with rice, cake.</p></div></body>", "Menu Soup and bread, fish with rice, cake."),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<article>x" + "<div>" * 20_000 + "deep", "x deep"),
        ("<article>" + "<p>word</p>" * 50_000 + "</article>", " ".join(["word"] * 50_000)),
    ]:
        assert h.main_text(source) == want, source[:80]


def test_a_large_host_and_a_token_that_one_page_repeats(spark):
    pages = [f"<body><div id=a>Site</div><div class=main{n}><p>Text {n}.</p></div>{'<div id=a>Site</div>' * (n == 5)}</body>" for n in range(200)]
    assert extracted(spark, pages) == [f"Text {n}." for n in range(200)]


def test_pages_are_parsed_once_for_the_main_elements(spark):
    rows = [("a", [(5, [1, 2])], f"<html><body><div>Site</div><article>Page {i}</article></body></html>") for i in range(5)]
    df = spark.createDataFrame(rows, "__host string, __classes array<struct<pages: long, keys: array<long>>>, html string")
    found = h.main_elements(df, "html")
    assert found.count() == 1
    # the join with a host's total would parse them again
    assert "weigh" not in found._jdf.queryExecution().optimizedPlan().toString()
