import hashlib
import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.functions import ed25519
from corvane.session import scratch
from corvane.sources import archive_format as A
from corvane.sources import epub, zim_map
from corvane.sources.archive_source import find, read_archives, write_archives

PAGES = [("index.html", "Main", "text/html", b"<p>quantum gravity</p>" * 30, True), ("a/b.css", "", "text/css", b"p{}", False), ("i.png", "", "image/png", b"\x89PNG", False), ("copy.html", "Copy", "text/html", b"<p>quantum gravity</p>" * 30, True), ("empty", "", "text/plain", b"", True)]


@pytest.fixture(scope="module")
def archive():
    return A.build({"title": b"T", "main_entry": b"index.html"}, PAGES, [("home", "Home", 0, True), ("hop", "", A.REDIRECT_BIT, False)], uuid=bytes(16), secret=bytes(range(32)))


def test_round_trip(archive):
    a = A.Archive(archive)
    assert [(a.paths[i], a.titles[i], a.mime[r.mime], a.blob(r), r.front) for i, r in enumerate(a.entries)] == PAGES
    assert a.redirects == [(1, 0), (0, A.REDIRECT_BIT)] and a.paths[A.REDIRECT_BIT] == "home" and a.metadata["title"] == b"T"
    assert a.entries[0].chunk == a.entries[3].chunk and a.entries[0].offset == a.entries[3].offset  # stored once
    assert all(e == c for *_, e, c in a.verify()) and a.header.front_count == 4
    _, docs, grams = A.parse_postings(a.load(a.section(A.SEARCH_BODY)))
    assert docs == 3 and grams[int.from_bytes(b"qua", "big")] == [0, 3]


def test_signatures(archive):
    assert ed25519.public_key(bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    a = A.Archive(archive)
    key, signature, number = a.signatures()[0]
    digest = hashlib.sha256(archive[: a.header.checksum_offset]).digest()
    assert number == 1 and ed25519.verify(key, digest, signature) and not ed25519.verify(key, digest[::-1], signature)


def test_damage_is_reported(archive):
    with pytest.raises(A.FormatError):
        A.Archive(archive[:100])
    with pytest.raises(A.BadMagic):
        A.Archive(b"x" + archive[1:])
    with pytest.raises(A.UnsupportedVersion):
        A.Archive(archive[:4] + b"\x02" + archive[5:])
    with pytest.raises(A.LimitExceeded):
        A.Archive(archive, A.Limits(section=10))
    end = A.Archive(archive).header.checksum_offset
    at = next(s.offset + s.compressed_size - 1 for s in A.Archive(archive).sections if s.kind == A.CONTENT)
    bad = archive[:at] + bytes([archive[at] ^ 1]) + archive[at + 1 :]
    tiers = {t for t, _, e, c in A.Archive(bad).verify() if e != c}
    assert {"file", "section"} <= tiers and end < len(archive)
    with pytest.raises(A.FormatError):
        A.parse_metadata(A.pack_metadata({"a": b"1"})[:4].replace(b"\x01", b"\x02") + A.pack_metadata({"a": b"1"})[4:] * 2)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_noise_never_escapes_as_another_error(noise):
    for parse in (A.parse_header, A.parse_metadata, A.parse_entries, A.parse_redirects, A.parse_index, A.parse_bitmap, A.parse_postings, A.parse_chunks):
        try:
            parse(noise)
        except (A.FormatError, UnicodeDecodeError):
            pass


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(st.characters(codec="utf-8"), max_size=12).map(lambda t: "a/b/" + t) | st.text("a/", max_size=9), st.integers(0, 2**32 - 1), max_size=200))
def test_index_round_trip(keys):
    assert A.parse_index(A.pack_index(list(keys.items()))) == sorted(keys.items(), key=lambda k: k[0].encode())


def test_bitmaps():
    rng = random.Random(1)
    for ids in ([], [0], [65535, 65536], rng.sample(range(200_000), 9000), list(range(70_000, 76_000))):
        assert A.parse_bitmap(A.pack_bitmap(ids)) == sorted(ids)
    runs = (12347).to_bytes(4, "little") + b"\x01" + b"\x00\x00\x04\x00" + b"\x01\x00" + b"\x05\x00\x04\x00"
    assert A.parse_bitmap(runs) == [5, 6, 7, 8, 9]


def test_dictionaries():
    import zstandard

    d = zstandard.train_dictionary(2048, [(f"<p>sample {i} " * 9).encode() for i in range(400)]).as_bytes()
    small = [(f"{i}", "", "text/html", f"<p>sample {i} ".encode(), True) for i in range(20)]
    a = A.Archive(A.build({}, small, dictionaries={"html-small": (7, d)}))
    assert a.chunks[0].compression == A.ZSTD_DICT and a.blob(a.entries[19]) == b"<p>sample 19 "


def test_data_source(spark, archive, tmp_path):
    (tmp_path / "lib_2024-05.car").write_bytes(archive)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.car").write_bytes(archive)
    read = lambda t, **o: read_archives(spark, str(tmp_path), t, suffix=".car", **o)
    assert len(find(str(tmp_path), ".car")) == 1 and len(find(str(tmp_path), ".car", True)) == 2
    assert read("archives").first().entry_count == 5 and read("archives").first().archive == "lib"
    assert {r.path: bytes(r.content) for r in read("content").collect()} == {p: c for p, _, _, c, _ in PAGES}
    assert read("verify", recursive="true").filter("NOT ok").count() == 0 and read("signatures").first().valid
    assert read("sections").filter("type_name = 'CONTENT'").count() == 1 and read("chunks").filter("size > 0").count() > 0 and read("redirects").count() == 2 and read("mime").count() == 5 and read("chunks").count() > 0
    assert read("postings").filter("idx = 'title'").count() == len("main") - 2 + len("copy") - 2
    with pytest.raises(Exception, match="no table"):
        read("nothing").count()


def test_files_are_read_in_parts(archive):
    class Counting(A.FileRanges):
        read = 0

        def __getitem__(self, part):
            out = super().__getitem__(part)
            self.read += len(out)
            return out

    big = A.build({}, [(f"p{i}", "", "text/html", random.Random(i).randbytes(5000), False) for i in range(200)], chunk_bytes=50_000)
    ranges = Counting(io.BytesIO(big))
    a = A.Archive(ranges)
    assert ranges.read < 2000 and a.blob(a.entries[7]) == random.Random(7).randbytes(5000) and ranges.read < 0.2 * len(big)
    assert [a.chunk_size(c) for c in a.chunks] == [len(a.chunk(c.id)) for c in a.chunks] and all(e == c for *_, e, c in a.verify())
    a.check()
    bad = bytearray(big)
    bad[len(big) // 2] ^= 1
    with pytest.raises(A.ChecksumMismatch):
        A.Archive(bytes(bad)).check()


def test_pruned_grams_are_recorded(spark, tmp_path):
    rows = [(f"p{i}", f"shared title{i % 3}", "text/plain", b"body", True) for i in range(60)]
    (tmp_path / "x.car").write_bytes(A.build({}, rows, prune_least=30))
    read = lambda t: read_archives(spark, str(tmp_path), t)
    from corvane.operators import search

    assert read("pruned").filter("idx = 'title'").count() == len("shared title") - 2 and read("archives").first().title_docs == 60
    assert search.search_index(read("postings"), "shared title1", None, True, read("pruned")).count() == 20
    assert search.search_index(read("postings"), "shared", None, True, read("pruned")).count() == 0


def test_indexes_of_large_files_are_whole():
    rows = [(f"p{i}", "shared", "text/plain", b"%d" % i, True) for i in range(1100)]
    a = A.Archive(A.build({}, rows))
    assert a.pruned() == {} and len(A.parse_postings(a.load(a.section(A.SEARCH_TITLE)))[2][int.from_bytes(b"sha", "big")]) == 1100


def test_parts_make_one_archive(spark, tmp_path, monkeypatch):
    """Rows of an archive are packed in many parts and tasks, and give what one builder gives."""
    from corvane.operators import search
    from corvane.sources import archive_source

    monkeypatch.setattr(archive_source, "_PART", 500)
    rows = [("x", 7 * i, f"d/{i % 7}/{i}", f"title {i % 5}", "text/html" if i % 3 else "text/plain", i % 4 > 0, f"<p>word{i % 40} {'z' * (i % 40)}</p>") for i in range(400)] + [("y", 1, "only", "one", "image/png", False, None)]
    e = spark.createDataFrame(rows, "archive string, entry_id long, path string, title string, mime_type string, is_front boolean, content string").repartition(5)
    r = spark.createDataFrame([("x", 9001, "led", 7 * 399), ("x", 9002, "hop", 9001)], "archive string, redirect_id long, path string, target_id long")
    out = str(tmp_path / "out")
    assert {x.archive for x in write_archives(e, out, redirects=r).collect()} == {"x", "y"} and sorted(f.name for f in (tmp_path / "out").iterdir()) == ["x.car", "y.car"]
    a = A.Archive((tmp_path / "out" / "x.car").read_bytes())
    whole = A.Archive(A.build({}, [(p, t, m, c.encode(), f) for _, _, p, t, m, f, c in rows[:400]], [("led", "", 399, False), ("hop", "", A.REDIRECT_BIT, False)]))
    assert [(x.front, a.mime[x.mime], a.blob(x), x.hash) for x in a.entries] == [(x.front, whole.mime[x.mime], whole.blob(x), x.hash) for x in whole.entries]
    assert len({(x.chunk, x.offset) for x in a.entries}) == len({(x.chunk, x.offset) for x in whole.entries}) == len({c for *_, c in rows[:400]})  # stored once
    assert len(a.chunks) > len(whole.chunks) and a.paths == whole.paths and a.titles == whole.titles and a.redirects == whole.redirects and a.header.front_count == whole.header.front_count == 300
    for kind in (A.SEARCH_TITLE, A.SEARCH_BODY):
        assert A.parse_postings(a.load(a.section(kind))) == A.parse_postings(whole.load(whole.section(kind)))
    assert all(x == y for *_, x, y in a.verify()) and sum(len(list(a.verify(k=k, n=3))) for k in range(3)) == len(list(a.verify()))
    read = lambda t: read_archives(spark, out, t, suffix=".car")
    monkeypatch.setattr(archive_source, "_SPLIT", 1000)
    for name in ("content", "entries", "verify"):
        reader = archive_source._Reader({"path": out, "table": name, "suffix": ".car", "tiers": "entry"})
        parts = [list(reader.read(p)) for p in reader.partitions()]
        assert len(parts) > 5 and sum(map(len, parts)) == 401 > max(map(len, parts))
    assert search.search_index(read("postings"), "word1 ", None).count() == sum(f and "word1 " in c for *_, f, c in rows[:400]) > 0


def test_columns_and_streams_agree_with_records(archive):
    import io

    a = A.Archive(archive)
    assert [a.record(i) for i in range(len(a.entries))] == a.entries
    large = A.Record(0, True, 300, 1 << 31, 1 << 40, 127, bytes(8))
    c = {"front": [True], "mime": [300], "chunk": [1 << 31], "offset": [1 << 40], "size": [127], "hash": [[0] * 8]}
    assert A.parse_entries(A.pack_entries([{k: A.np.array(v, A.np.uint8 if k == "hash" else None) for k, v in c.items()}])) == [large]
    raw = a.load(a.section(A.SEARCH_BODY))
    grams = A.parse_postings(raw)[2]
    assert dict(A.stream_postings(io.BytesIO(raw))) == grams and dict(A.stream_postings(io.BytesIO(raw), {min(grams), -1})) == {min(grams): grams[min(grams)]}


def test_damaged_files(spark, archive, tmp_path):
    (tmp_path / "good.car").write_bytes(archive)
    (tmp_path / "cut.car").write_bytes(archive[:150])
    flipped = bytearray(archive)
    flipped[len(archive) - 300] ^= 255
    (tmp_path / "flipped.car").write_bytes(bytes(flipped))
    with pytest.raises(Exception, match="cut off"):
        read_archives(spark, str(tmp_path), "entries").count()
    rows = read_archives(spark, str(tmp_path), "entries", damaged="skip", verify="true")
    assert {r.archive for r in rows.collect()} == {"good"} and rows.count() == 5
    with pytest.raises(Exception, match="file"):
        read_archives(spark, str(tmp_path / "flipped.car"), "metadata", verify="true").count()
    assert {r.tier for r in read_archives(spark, str(tmp_path / "good.car"), "verify", tiers="section").collect()} == {"section"}


def test_filters_choose_what_is_read(spark, archive, tmp_path):
    (tmp_path / "one.car").write_bytes(archive)
    (tmp_path / "two.car").write_bytes(archive)
    rows = read_archives(spark, str(tmp_path), "content")
    assert [r.archive for r in rows.filter("archive = 'one' AND path = 'a/b.css'").collect()] == ["one"]
    assert rows.filter("entry_id IN (0, 3)").count() == 4 and rows.filter("mime_type = 'image/png'").count() == 2 and rows.filter("archive = 'three'").count() == 0
    (tmp_path / "bad.car").write_bytes(b"x" * 200)
    assert rows.filter("archive = 'one'").count() == 5  # the damaged file isn't opened


def test_write_and_read_back(spark, sf):
    from corvane.sources.entries import entries

    rows = entries(spark, sf).filter("archive LIKE 'src%'")
    out = scratch(spark, "archives")
    assert write_archives(rows, out).count() == rows.select("archive").distinct().count()
    write_archives(rows, out).collect()
    back = read_archives(spark, out, "content", suffix=".car")
    assert {(r.archive, r.path, bytes(r.content).decode()) for r in back.collect()} == {(r.archive, r.path, r.content) for r in rows.collect()}


def test_write_with_metadata_redirects_and_keys(spark):
    e = spark.createDataFrame([(a, i * 3, f"p{i}", f"T{i}", "text/html", i > 0, f"<p>{a}{i}</p>") for a in "ab" for i in range(4)], "archive string, entry_id long, path string, title string, mime_type string, is_front boolean, content string")
    m = spark.createDataFrame([("a", k, k.upper()) for k in ("title", "language", "creator", "date", "source", "main_entry")], "archive string, key string, value string")
    r = spark.createDataFrame([("a", 100, "old", 6), ("a", 101, "older", 100), ("b", 100, "old", 0)], "archive string, redirect_id long, path string, target_id long")
    out = scratch(spark, "archives")
    write_archives(e, out, metadata=m, redirects=r, secrets=[bytes(range(32)), bytes(range(1, 33))], strict=False).collect()
    read = lambda t: read_archives(spark, out, t, suffix=".car")
    from corvane.operators import catalog, library, reports

    assert {x.key: bytes(x.value) for x in read("metadata").filter("archive = 'a'").collect()} == {k: k.upper().encode() for k in ("title", "language", "creator", "date", "source", "main_entry")}
    assert {(x.archive, x.path): bytes(x.content).decode() for x in catalog.resolved_content(read("content"), read("redirects")).collect() if x.path.startswith("old")} == {("a", "old"): "<p>a2</p>", ("a", "older"): "<p>a2</p>", ("b", "old"): "<p>b0</p>"}
    assert [(x.nth, x.valid) for x in read("signatures").filter("archive = 'a'").orderBy("nth").collect()] == [(0, True), (1, True)] and read("verify").filter("NOT ok").count() == 0
    listed = {x.slug: x for x in library.describe_archives(read("archives"), read("metadata"), "http://h").collect()}
    assert listed["a"].title == "TITLE" and listed["a"].url == "http://h/a/" and listed["a"].entries == 4 and listed["b"].redirects == 1 and listed["a"].has_search
    assert '"slug":"a"' in {x.uri: x.text for x in library.resources(read("archives"), read("metadata")).collect()}["archive://a/metadata"]
    info = reports.info(read("entries"), read("redirects"), sections=read("sections"), chunks=read("chunks"))
    assert '"sections"' in info.first().info and '"chunks"' in info.first().info and reports.info_lines(info).count() > 10
    one = lambda t, a: read(t).filter(f"archive = '{a}'")
    rows = reports.comparison(*[one("entries", a) for a in "ab"], *[one("metadata", a).select("key", "value") for a in "ab"], *[one("sections", a) for a in "ab"]).collect()
    assert {x.section for x in rows} == {"size", "mime", "metadata", "budget content", "budget search", "budget overhead"}
    for broken, word in ((dict(redirects=r.union(spark.createDataFrame([("a", 102, "x", 55)], r.schema))), "isn't there"), (dict(metadata=m.union(m)), "twice"), (dict(strict=True), "lacks metadata")):
        with pytest.raises(Exception, match=word):
            write_archives(e, out, **broken).collect()


def book(title="A Book", nav=False):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        toc = '<item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' if nav else '<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
        f.writestr("O/c.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title><dc:creator>C</dc:creator><dc:language>en</dc:language></metadata><manifest><item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="s" href="s.css" media-type="text/css"/><item id="x" href="gone" media-type="text/css"/>{toc}</manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        for name in ("t/a.xhtml", "b.xhtml", "s.css"):
            f.writestr("O/" + name, name)
        f.writestr("O/toc.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="b.xhtml#x"/><navPoint><navLabel><text>In</text></navLabel><content src="t/a.xhtml"/></navPoint></navPoint></navMap></ncx>')
        f.writestr("O/nav.xhtml", '<nav><a href="b.xhtml">One</a></nav>')
    return z.getvalue()


def test_books(spark, tmp_path):
    (tmp_path / "one.epub").write_bytes(book())
    (tmp_path / "two.EPUB").write_bytes(book("Other", nav=True))
    items = epub.read_books(spark, str(tmp_path)).cache()
    got = {(r.book, r.path): r.spine for r in items.collect()}
    assert got["one", "O/b.xhtml"] == 0 and got["one", "O/t/a.xhtml"] == 1 and got["two", "O/s.css"] is None and ("one", "O/gone") not in got
    toc = [tuple(r)[1:] for r in epub.read_contents(spark, str(tmp_path)).filter("book = 'one'").orderBy("ord").collect()]
    assert toc == [(0, 1, None, "One", "O/b.xhtml#x"), (1, 2, 0, "In", "O/t/a.xhtml")]
    rows = {r.path: (r.title, r.is_front) for r in epub.book_entries(items, "lib", collection=True).collect()}
    assert rows["one/O/b.xhtml"] == ("A Book — b", True) and rows["two/O/s.css"] == ("", False)
    assert epub.book_catalog(items).first().value.startswith('[{"title":"A Book","slug":"one"')


def test_namespaces(spark):
    raw = [(1, "C", "A", "A", "text/html", "x", None), (2, "C", "B", "", "", None, 1), (3, "C", "C", "", "", None, 2), (4, "C", "D", "", "", None, 4), (5, "M", "Title", "", "", "T", None), (6, "X", "i", "", "", "", None), (7, "W", "m", "", "text/html", "", None), (8, "C", "E", "", "", None, 99)]
    content, redirects, names = zim_map.map_raw(spark.createDataFrame(raw, "id long, ns string, path string, title string, mime_type string, content string, redirect_to long"), "z")
    assert {(r.path, r.is_front) for r in content.collect()} == {("A", True), ("_well_known/m", False)}
    assert {(r.path, r.target_id) for r in redirects.collect()} == {("B", 1), ("C", 1)} and names.first().key == "title"
