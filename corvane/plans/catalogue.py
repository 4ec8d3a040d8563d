"""The registered queries over the reference operators, and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import columns as C
from corvane.functions import text as T
from corvane.operators import catalog, checks, ingest, library, search, stats
from corvane.session import scratch, table
from corvane.sources import archive_source
from corvane.sources.entries import ENTRIES_SQL, REDIRECTS_SQL, entries, redirects

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_E, _R = f"WITH {ENTRIES_SQL} ", f"WITH {ENTRIES_SQL}, {REDIRECTS_SQL} "


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Scans, lookups and browsing


@query(_E + "SELECT entry_id, path, title, mime_type, is_front, size FROM entries")
def entries_scan(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select("entry_id", "path", "title", "mime_type", "is_front", "size")


@query(f"WITH {REDIRECTS_SQL} SELECT archive, redirect_id, path, target_id FROM redirects")
def redirects_scan(spark: SparkSession, sf: str) -> DataFrame:
    return redirects(spark, sf)


@query(_R + """, a AS (SELECT entry_id, path, mime_type, size FROM entries UNION ALL SELECT redirect_id, path, '', 0 FROM redirects)
SELECT entry_id, path, mime_type, size, row_number() OVER (ORDER BY path, entry_id) AS rank FROM a""")  # fmt: skip
def entries_by_path_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.with_redirects(entries(spark, sf), redirects(spark, sf)).drop("is_redirect")
    return catalog.ranked(rows, "path", "entry_id")


@query(_E + "SELECT entry_id, path, title, size FROM entries WHERE entry_id = 401")
def entry_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_id(entries(spark, sf), 401).select("entry_id", "path", "title", "size")


@query(_E + "SELECT entry_id, path, title, size FROM entries WHERE path = 'conv/3/1'")
def entry_by_path(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_path(entries(spark, sf), "conv/3/1").select("entry_id", "path", "title", "size")


@query(_E + "SELECT entry_id, path, title, size FROM entries WHERE title = 'user' ORDER BY entry_id LIMIT 1")
def entry_by_title(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_title(entries(spark, sf), "user").select("entry_id", "path", "title", "size")


@query(_E + "SELECT archive, entry_id, path FROM entries WHERE is_front")
def front_articles(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.front(entries(spark, sf)).select("archive", "entry_id", "path")


@query(_E + "SELECT entry_id, path FROM entries WHERE mime_type = 'text/html'")
def entries_by_mime(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_mime(entries(spark, sf), "text/html").select("entry_id", "path")


@query(_E + "SELECT mime_type, count(*) AS entries FROM entries GROUP BY 1")
def entry_count_by_mime(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.count_by_mime(entries(spark, sf))


@query(_E + "SELECT entry_id, title FROM entries ORDER BY title, entry_id LIMIT 50 OFFSET 100")
def browse_titles(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.browse_titles(entries(spark, sf).select("entry_id", "title"), 100)


_LETTER = "CASE WHEN title = '' THEN NULL WHEN regexp_matches(substring(title, 1, 1), '^[A-Za-z]$') THEN upper(substring(title, 1, 1)) ELSE '#' END"


@query(_E + f"SELECT letter, count(*) AS entries FROM (SELECT {_LETTER} AS letter FROM entries) WHERE letter IS NOT NULL GROUP BY 1")
def letter_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.letter_counts(entries(spark, sf))


@query(_E + f"SELECT entry_id, title FROM entries WHERE {_LETTER} = 'T' ORDER BY title, entry_id LIMIT 50")
def browse_letter(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.browse_letter(entries(spark, sf).select("entry_id", "title"), "T")


_WALK = """, walk AS (SELECT archive, redirect_id, path, target_id AS t, 0 AS hops FROM redirects
  UNION ALL SELECT w.archive, w.redirect_id, w.path, r.target_id, hops + 1 FROM walk w JOIN redirects r ON w.archive = r.archive AND w.t = r.redirect_id) """
_WALKED = _R.replace("WITH ", "WITH RECURSIVE ", 1) + _WALK


@query(_WALKED + "SELECT w.archive, w.redirect_id, w.t AS entry_id, 'resolved' AS status FROM walk w JOIN entries e ON e.archive = w.archive AND e.entry_id = w.t")
def redirect_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.resolve(redirects(spark, sf), entries(spark, sf))


@query(_WALKED + """SELECT archive, path, entry_id, size, sha256(content) AS digest FROM entries
UNION ALL SELECT w.archive, w.path, e.entry_id, e.size, sha256(e.content) FROM walk w JOIN entries e ON e.archive = w.archive AND e.entry_id = w.t""")  # fmt: skip
def redirect_content(spark: SparkSession, sf: str) -> DataFrame:
    """Every path with its content, those of redirects with that of the entry they lead to."""
    rows = catalog.resolved_content(entries(spark, sf), redirects(spark, sf))
    return rows.select("archive", "path", "entry_id", "size", F.sha2("content", 256).alias("digest"))


_LOOPS = [("a", 101, 102), ("a", 102, 103), ("a", 103, 7), ("a", 104, 104), ("a", 105, 106), ("a", 106, 105), ("a", 107, 105), ("a", 108, 999), ("b", 101, 8), ("b", 102, 101), ("b", 104, 7)]


@query("SELECT * FROM (VALUES ('a', 101, 7, 'resolved'), ('a', 102, 7, 'resolved'), ('a', 103, 7, 'resolved'), ('a', 104, NULL, 'loop'), ('a', 105, NULL, 'loop'), ('a', 106, NULL, 'loop'), ('a', 107, NULL, 'loop'), ('a', 108, NULL, 'broken'), ('b', 101, 8, 'resolved'), ('b', 102, 8, 'resolved'), ('b', 104, NULL, 'broken')) t(archive, redirect_id, entry_id, status)")
def redirect_loops(spark: SparkSession, sf: str) -> DataFrame:
    """A chain, a self loop, a loop of two, one that leads into it and a dangling target; and an archive with the same numbers for others."""
    return catalog.resolve(spark.createDataFrame(_LOOPS, "archive string, redirect_id long, target_id long"), spark.createDataFrame([("a", 7), ("b", 8)], "archive string, entry_id long"))


@query(_R + ", a AS (SELECT archive, entry_id, path, title FROM entries UNION ALL SELECT archive, redirect_id, path, '' FROM redirects) SELECT archive, entry_id, path, title, row_number() OVER (ORDER BY title, path, entry_id) AS rank FROM a")
def entries_by_title_order(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_title_order(entries(spark, sf), redirects(spark, sf))


@query(_E + "SELECT archive, entry_id, path, title, (SELECT count(*) FROM entries) AS total_count FROM entries ORDER BY title, entry_id LIMIT 50 OFFSET 20")
def title_page(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.title_page(entries(spark, sf).drop("content"), 20)


@query()
def random_front(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.random_front(entries(spark, sf).select("archive", "entry_id", "path", "title", "is_front"), 11, per_archive=True)


# Statistics


@query(_E + "SELECT mime_type, count(*) AS entries, sum(size)::BIGINT AS total_bytes, round(avg(size), 4) AS avg_bytes, min(size) AS min_bytes, max(size) AS max_bytes FROM entries GROUP BY 1")
def mime_census(spark: SparkSession, sf: str) -> DataFrame:
    return stats.mime_census(entries(spark, sf))


@query(_R + "SELECT count(*) AS content_entries, count_if(is_front)::BIGINT AS front_articles, sum(size)::BIGINT AS total_bytes, (SELECT count(*) FROM redirects) AS redirects FROM entries")
def entry_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.entry_stats(entries(spark, sf), redirects(spark, sf))


_GROUP = "CASE WHEN mime_type = 'text/html' THEN 'html' ELSE 'other' END"
_KEY = f"CASE WHEN size < 4096 THEN {_GROUP} || '-small' ELSE {_GROUP} END"
_BUCKETS = f""", k AS (SELECT archive, entry_id, path, size, {_KEY} AS chunk_key FROM entries),
c AS (SELECT *, floor(coalesce(sum(size) OVER (PARTITION BY archive, chunk_key ORDER BY path, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / 65536)::BIGINT AS chunk FROM k),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY archive, chunk_key, chunk ORDER BY path, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS blob_offset FROM c) """


@query(_E + f"SELECT mime_type, {_KEY} AS chunk_key, count(*) AS n FROM entries GROUP BY 1, 2")
def chunk_keys(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).groupBy("mime_type", C.chunk_key(F.col("mime_type"), F.col("size")).alias("chunk_key")).agg(F.count("*").alias("n"))


@query(_E + _BUCKETS + "SELECT archive, entry_id, chunk_key, chunk, blob_offset FROM o")
def blob_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.bucket_chunks(entries(spark, sf), 1 << 16).select("archive", "entry_id", "chunk_key", "chunk", "blob_offset")


@query(_E + _BUCKETS + "SELECT count(*) AS chunks, round(avg(n), 4) AS avg_entries, min(n) AS min_entries, max(n) AS max_entries FROM (SELECT count(*) AS n FROM o GROUP BY archive, chunk_key, chunk)")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.bucket_chunks(entries(spark, sf), 1 << 16)
    return stats.chunk_stats(rows.withColumn("chunk", F.struct("archive", "chunk_key", "chunk")))


_GREEDY = _E.replace("WITH ", "WITH RECURSIVE ", 1) + f""", k AS (SELECT archive, entry_id, path, coalesce(size, 0) AS size, {_KEY} AS chunk_key FROM entries),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY archive, chunk_key ORDER BY path, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM k),
s AS (SELECT *, before // (64 * 65536) AS stretch FROM b),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY archive, chunk_key, stretch ORDER BY before, path, entry_id) AS n FROM s),
g AS (SELECT archive, chunk_key, stretch, n, entry_id, size, 0::BIGINT AS c, 0::BIGINT AS blob_offset FROM n WHERE n = 1
  UNION ALL SELECT n.archive, n.chunk_key, n.stretch, n.n, n.entry_id, n.size, CASE WHEN g.blob_offset + g.size >= 65536 THEN c + 1 ELSE c END, CASE WHEN g.blob_offset + g.size >= 65536 THEN 0 ELSE g.blob_offset + g.size END
  FROM g JOIN n ON n.archive = g.archive AND n.chunk_key = g.chunk_key AND n.stretch = g.stretch AND n.n = g.n + 1) """


@query(_GREEDY + "SELECT archive, entry_id, chunk_key, stretch || '-' || c AS chunk, blob_offset, size FROM g")
def chunk_packing(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.pack_chunks(entries(spark, sf), 1 << 16)


@query(_E + f"SELECT archive, entry_id, row_number() OVER (PARTITION BY archive ORDER BY {_KEY}, path, entry_id) - 1 AS id FROM entries")
def entry_ids(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.assign_ids(entries(spark, sf)).select("archive", "entry_id", "id")


@query(_E + """, p AS (SELECT path, row_number() OVER (ORDER BY path) AS n FROM entries), q AS (SELECT path, n, lag(path) OVER (PARTITION BY (n - 1) // 64 ORDER BY n) AS last FROM p),
h AS (SELECT path, n, hex(encode(path)) AS a, hex(encode(last)) AS b FROM q)
SELECT path, coalesce((SELECT max(i) FROM (SELECT unnest(range(1, least(length(a), length(b)) // 2 + 1)) AS i) WHERE substring(a, 1, 2 * i::BIGINT) = substring(b, 1, 2 * i::BIGINT)), 0)::INTEGER AS shared FROM h""")  # fmt: skip
def prefix_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.prefix_lengths(entries(spark, sf).select("path")).select("path", "shared")


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    """A section of content for each MIME group, of paths and of titles, as large as they are here."""
    e = entries(spark, sf)
    content = e.groupBy(F.lit("CONTENT").alias("type_name"), "mime_type").agg(F.sum("size").alias("compressed_size"))
    keys = e.select(F.explode(F.array(F.struct(F.lit("PATH_INDEX").alias("t"), F.octet_length("path").alias("n")), F.struct(F.lit("SEARCH_TITLE").alias("t"), F.octet_length("title").alias("n")))).alias("x"))
    keys = keys.groupBy(F.col("x.t").alias("type_name")).agg(F.sum(F.col("x.n").cast("long")).alias("compressed_size"))
    rows = content.groupBy("type_name").agg(F.sum("compressed_size").alias("compressed_size")).unionByName(keys)
    return rows.withColumn("uncompressed_size", F.col("compressed_size") * 2)


_SECTIONS = _E + """, s AS (SELECT 'CONTENT' AS type_name, sum(size)::BIGINT AS compressed_size FROM entries UNION ALL SELECT 'PATH_INDEX', sum(strlen(path))::BIGINT FROM entries UNION ALL SELECT 'SEARCH_TITLE', sum(strlen(title))::BIGINT FROM entries) """


@query(_SECTIONS + "SELECT sum(compressed_size)::BIGINT AS compressed, sum(2 * compressed_size)::BIGINT AS uncompressed, 0.5::DOUBLE AS ratio FROM s")
def section_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.section_summary(_sections(spark, sf))


@query(_SECTIONS + """, c AS (SELECT *, CASE type_name WHEN 'CONTENT' THEN 'content' WHEN 'SEARCH_TITLE' THEN 'search' ELSE 'overhead' END AS category FROM s)
SELECT type_name, compressed_size, category, round(100 * compressed_size / 1e9::DOUBLE, 4) AS pct_of_file, round(100 * (sum(compressed_size) OVER (PARTITION BY category) / sum(compressed_size) OVER ()::DOUBLE), 4) AS category_pct FROM c""")  # fmt: skip
def size_budget(spark: SparkSession, sf: str) -> DataFrame:
    return stats.size_budget(_sections(spark, sf), 1_000_000_000)


@query(_SECTIONS + "SELECT type_name, coalesce(sum(compressed_size) OVER (ORDER BY type_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 128 AS \"offset\" FROM s")
def section_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.running_offsets(_sections(spark, sf), "type_name", "compressed_size", 128).select("type_name", "offset")


@query(_E + """, a AS (SELECT mime_type, count(*) AS n FROM entries WHERE archive = 'src0' GROUP BY 1), b AS (SELECT mime_type, count(*) AS n FROM entries WHERE archive IN ('src1', 'pages') GROUP BY 1)
SELECT coalesce(a.mime_type, b.mime_type) AS mime_type, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.mime_type = b.mime_type""")  # fmt: skip
def mime_count_compare(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return stats.compare_mime(e.filter("archive = 'src0'"), e.filter("archive IN ('src1', 'pages')"))


_SOURCES = ("en.wiktionary.org", "de.wikiquote.org", "gutenberg.org", "fr.wikisource.org", "askubuntu.stackexchange.com", "my_stack_exchange", "stackoverflow.com", "devdocs.io", "mankier.com", "openwrt.org", "zimit.example", "www.ted.com", "vikidia.org", "en.wikipedia.org", "example.org", "")


def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of each source, some of it wrong on purpose by the source's number."""
    n = F.substring("source", 4, 9).cast("int")
    base = table(spark, sf, "documents").groupBy("source").agg(F.min("lang").alias("lang"), F.count("*").alias("n"))
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), n % len(values) + 1)
    pairs = [
        ("title", F.when(n % 7 == 3, "  ").when(n % 7 == 4, "\t\n").otherwise(F.concat(F.lit("Collection "), "source"))), ("language", F.when(n % 5 == 1, F.upper("lang")).when(n % 5 == 2, "english-x").when(n % 5 == 3, "").otherwise(F.col("lang"))),
        ("creator", F.lit("someone")), ("date", pick("2024-13-45", "2024-02-29", "2024-02-29T10:00:00Z", "2023-02-29", "29.02.2024", "2024-02-29T10:00:00+01:00", "")),
        ("source", F.when(n % 4 == 2, None).otherwise(F.concat(F.lit("https://"), pick(*_SOURCES)))), ("entries", F.col("n").cast("string")),
        ("favicon_entry", pick("7", "4294967295", "4294967296", "x", "", "00000000000012")), ("main_entry", pick("index.html", " ")), ("license", F.when(n % 3 == 1, "").when(n % 3 == 2, "CC0")),
    ]
    rows = base.select(F.col("source").alias("archive"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])).alias("p"))
    return rows.select("archive", "p.*").filter("value IS NOT NULL")


_PICK = lambda *values: f"list_extract([{', '.join(chr(39) + v + chr(39) for v in values)}], k % {len(values)} + 1)"
_METADATA = f"""WITH b AS (SELECT source AS archive, substring(source, 4)::INTEGER AS k, min(lang) AS lang, count(*) AS n FROM documents GROUP BY 1, 2),
m AS (SELECT * FROM (SELECT archive, 'title' AS key, CASE WHEN k % 7 = 3 THEN '  ' WHEN k % 7 = 4 THEN chr(9) || chr(10) ELSE 'Collection ' || archive END AS value FROM b
  UNION ALL SELECT archive, 'language', CASE WHEN k % 5 = 1 THEN upper(lang) WHEN k % 5 = 2 THEN 'english-x' WHEN k % 5 = 3 THEN '' ELSE lang END FROM b
  UNION ALL SELECT archive, 'creator', 'someone' FROM b
  UNION ALL SELECT archive, 'date', {_PICK("2024-13-45", "2024-02-29", "2024-02-29T10:00:00Z", "2023-02-29", "29.02.2024", "2024-02-29T10:00:00+01:00", "")} FROM b
  UNION ALL SELECT archive, 'source', 'https://' || {_PICK(*_SOURCES)} FROM b WHERE k % 4 <> 2
  UNION ALL SELECT archive, 'favicon_entry', {_PICK("7", "4294967295", "4294967296", "x", "", "00000000000012")} FROM b
  UNION ALL SELECT archive, 'main_entry', {_PICK("index.html", " ")} FROM b
  UNION ALL SELECT archive, 'license', CASE k % 3 WHEN 1 THEN '' WHEN 2 THEN 'CC0' END FROM b
  UNION ALL SELECT archive, 'entries', n::VARCHAR FROM b) WHERE value IS NOT NULL) """


@query(_METADATA + """, a AS (SELECT key, value FROM m WHERE archive = 'src0'), c AS (SELECT key, value FROM m WHERE archive = 'src1')
SELECT * FROM (SELECT coalesce(a.key, c.key) AS key, coalesce(a.value, '') AS value_a, coalesce(c.value, '') AS value_b FROM a FULL JOIN c ON a.key = c.key) WHERE value_a <> value_b""")  # fmt: skip
def metadata_compare(spark: SparkSession, sf: str) -> DataFrame:
    m = _metadata(spark, sf)
    return stats.compare_metadata(m.filter("archive = 'src0'"), m.filter("archive = 'src1'"))


@query(_METADATA + """, l AS (SELECT archive, key, value, regexp_full_match(value, '\\s*') AS blank, split_part(value, '-', 1) AS tag FROM m)
SELECT archive, key, message FROM (
  SELECT archive, key, 'a blank value' AS message FROM l WHERE key IN ('title', 'creator', 'source', 'license', 'main_entry') AND blank
  UNION ALL SELECT archive, key, 'neither a day nor a time with its zone' FROM l WHERE key = 'date' AND value <> '' AND NOT (regexp_full_match(value, '\\d{4}-\\d\\d-\\d\\d(T\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:\\d\\d))?') AND try_cast(substring(value, 1, 10) AS DATE) IS NOT NULL)
  UNION ALL SELECT archive, key, 'a language code has two or three letters' FROM l WHERE key = 'language' AND value <> '' AND length(tag) NOT BETWEEN 2 AND 3
  UNION ALL SELECT archive, key, 'a language code has small letters' FROM l WHERE key = 'language' AND length(tag) BETWEEN 2 AND 3 AND NOT regexp_full_match(tag, '[a-z]+')
  UNION ALL SELECT archive, key, 'no entry''s number' FROM l WHERE key = 'favicon_entry' AND NOT (regexp_full_match(value, '[0-9]+') AND coalesce(try_cast(value AS HUGEINT) < 4294967296, false))
  UNION ALL SELECT archive, key, 'required but not there' FROM (SELECT archive, unnest(['title', 'language', 'creator', 'date', 'source']) AS key FROM b) r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.archive = r.archive AND m.key = r.key))""")  # fmt: skip
def validate_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return checks.validate_metadata(_metadata(spark, sf))


_HINT = """CASE WHEN low LIKE '%wiktionary%' THEN 'wiktionary' WHEN low LIKE '%wikiquote%' THEN 'wikiquote' WHEN low LIKE '%gutenberg%' THEN 'gutenberg' WHEN low LIKE '%wikisource%' THEN 'wikisource'
  WHEN low LIKE '%stackexchange%' OR low LIKE '%stack\\_exchange%' ESCAPE '\\' OR low LIKE '%stackoverflow%' THEN 'stackexchange' WHEN low LIKE '%devdocs%' OR low LIKE '%mankier%' OR low LIKE '%openwrt%' THEN 'devdocs'
  WHEN low LIKE '%zimit%' THEN 'zimit' WHEN low LIKE '%ted.com%' THEN 'ted' WHEN low LIKE '%vikidia%' THEN 'vikidia' WHEN low LIKE '%wikipedia%' THEN 'wikipedia' ELSE '' END"""


@query(_METADATA + f"SELECT archive, {_HINT} AS hint FROM (SELECT archive, lower(value) AS low FROM m WHERE key = 'source')")
def source_hint(spark: SparkSession, sf: str) -> DataFrame:
    return _metadata(spark, sf).filter("key = 'source'").select("archive", stats.source_hint("value").alias("hint"))


#: Every archive gets other MIME types and sizes by its number, so that all the classifier's rules are met.
_TYPES = (("text/html", 1), ("image/png", 3), ("application/pdf", 2), ("video/mp4", 2), ("text/plain", 60), ("text/html", 1))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    n = F.coalesce(F.substring("archive", 4, 9).try_cast("int"), F.lit(0))
    kind = F.try_element_at(F.array(*[F.lit(m) for m, _ in _TYPES]), ((F.col("entry_id") / 4).cast("long") % (n % 5 + 1) + n % 3 % len(_TYPES) + 1).cast("int"))
    grown = F.col("size") * F.element_at(F.array(*[F.lit(g) for _, g in _TYPES]), (n % len(_TYPES) + 1).cast("int"))
    return entries(spark, sf).select("archive", F.when(F.col("mime_type") == "text/plain", F.coalesce(kind, F.lit("text/plain"))).otherwise(F.col("mime_type")).alias("mime_type"), grown.cast("long").alias("size"))


_TYPED = f"""SELECT archive, CASE WHEN mime_type = 'text/plain' THEN coalesce(list_extract([{", ".join(f"'{m}'" for m, _ in _TYPES)}], (entry_id // 4) % (k % 5 + 1) + k % 3 % 6 + 1), 'text/plain') ELSE mime_type END AS mime_type,
  size * list_extract([{", ".join(str(g) for _, g in _TYPES)}], k % 6 + 1) AS size FROM (SELECT *, coalesce(try_cast(substring(archive, 4) AS INTEGER), 0) AS k FROM entries)"""
_MEDIA = "(im + vi)"
_RULES = (
    ("pd > 0.30", "pdf-container", "0.6 + pd"), (f"{_MEDIA} > 0.60", "media-heavy", f"0.5 + {_MEDIA} / 2"), ("rd > 0.35 AND sm > 0.5 AND tx > 0.7", "dictionary", "0.5 + rd / 2 + sm / 4"), ("hint = 'stackexchange'", "qa-forum", "0.9"),
    ("av > 50000 AND rd < 0.15 AND tx > 0.5", "books", "0.6 + least(av / 200000, 0.3)"), ("tx > 0.8 AND im < 0.1 AND av < 50000 AND (hint = 'devdocs' OR rd < 0.05)", "docs", "0.6 + tx / 4"),
    ("tx > 0.5 AND im > 0.1 AND im < 0.5 AND types > 5 AND rd < 0.1", "qa-forum", "0.65"), ("ht > 0.3 AND rd > 0.05", "encyclopedia", "0.6 + ht / 4"),
)
_BLIND = (
    ("hint = 'wiktionary'", "dictionary", 0.6), ("hint = 'wikiquote'", "dictionary", 0.55), ("hint IN ('gutenberg', 'wikisource')", "books", 0.5), ("hint = 'stackexchange'", "qa-forum", 0.55), ("hint = 'devdocs'", "docs", 0.55),
    ("hint = 'ted'", "media-heavy", 0.5), ("hint = 'zimit'", "mixed-scrape", 0.5), ("hint IN ('wikipedia', 'vikidia')", "encyclopedia", 0.55), ("rd > 0.35", "dictionary", 0.45),
)


def _cases(rules, k: int, other) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {r[k] if k == 2 else chr(39) + r[k] + chr(39)}" for r in rules) + f" ELSE {other} END"


_CLASSIFIED = (
    _METADATA.rstrip() + f", {ENTRIES_SQL}, {REDIRECTS_SQL}" + f""", y AS ({_TYPED}), c AS (SELECT archive, mime_type, count(*) AS n, sum(size) AS size FROM y GROUP BY 1, 2),
    f AS (SELECT archive, sum(n) AS n, count(*) AS types, sum(size)::DOUBLE AS total, sum(CASE WHEN mime_type LIKE 'text/%' THEN size ELSE 0 END) AS a, sum(CASE WHEN mime_type = 'text/html' THEN size ELSE 0 END) AS b,
      sum(CASE WHEN mime_type LIKE 'image/%' THEN size ELSE 0 END) AS c, sum(CASE WHEN mime_type = 'application/pdf' THEN size ELSE 0 END) AS d, sum(CASE WHEN mime_type LIKE 'video/%' THEN size ELSE 0 END) AS e, sum(CASE WHEN size / n < 4096 THEN n ELSE 0 END) AS small FROM c GROUP BY 1),
    r AS (SELECT f.*, coalesce(x.r, 0) AS red, coalesce(h.hint, '') AS hint FROM f LEFT JOIN (SELECT archive, count(*) AS r FROM redirects GROUP BY 1) x USING (archive) LEFT JOIN (SELECT archive, {_HINT} AS hint FROM (SELECT archive, lower(value) AS low FROM m WHERE key = 'source')) h USING (archive)),
    w AS (SELECT archive, hint, types, a / total AS tx, b / total AS ht, c / total AS im, d / total AS pd, e / total AS vi, red / (red + n)::DOUBLE AS rd, total / n AS av, small / n::DOUBLE AS sm FROM r) """
)


@query(_CLASSIFIED + f"SELECT archive, round(rd, 6) AS redirect_density, {_cases(_RULES, 1, chr(39) + 'mixed-scrape' + chr(39))} AS profile, round(greatest(0, least(1, {_cases(_RULES, 2, 0.5)})), 6) AS confidence FROM w")
def classify_profile(spark: SparkSession, sf: str) -> DataFrame:
    return stats.classify(_features(spark, sf)).select("archive", F.round("redirect_density", 6).alias("redirect_density"), "profile", "confidence")


@query(_CLASSIFIED + f"SELECT archive, {_cases(_BLIND, 1, chr(39) + 'mixed-scrape' + chr(39))} AS profile, round({_cases(_BLIND, 2, 0.4)}, 6)::DOUBLE AS confidence FROM w")
def classify_without_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The rules for archives whose sizes aren't known."""
    blind = _features(spark, sf).withColumns({f"{c}_ratio": F.lit(-1.0) for c in ("text", "html", "image", "pdf", "video")})
    return stats.classify(blind).select("archive", "profile", "confidence")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    hints = _metadata(spark, sf).filter("key = 'source'").select("archive", stats.source_hint("value").alias("hint"))
    return stats.features(_typed(spark, sf), redirects(spark, sf)).join(hints, "archive", "left").fillna("", ["hint"])


# Deduplication, integrity and versions


@query(_E + "SELECT archive, entry_id, min(entry_id) OVER (PARTITION BY archive, sha256(content)) AS blob_owner FROM entries")
def dedup_first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.first_occurrences(entries(spark, sf)).select("archive", "entry_id", "blob_owner")


@query(_E + ", d AS (SELECT mime_type, sha256(content) AS h, count(*) AS n, max(size) AS size FROM entries GROUP BY 1, 2) SELECT mime_type, sum(n)::BIGINT AS entries, count(*) AS contents, sum((n - 1) * size)::BIGINT AS saved_bytes FROM d GROUP BY 1")
def dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.dedup_stats(entries(spark, sf))


@query(_E + "SELECT 'entry' AS tier, sha256(content) = sha256(CASE WHEN entry_id % 10 = 0 THEN content || 'x' ELSE content END) AS ok, count(*) AS n FROM entries GROUP BY 1, 2")
def verify_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth recorded digest is that of other content."""
    e = entries(spark, sf)
    recorded = e.select("archive", "entry_id", F.sha2(F.when(F.col("entry_id") % 10 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")), 256).alias("digest"))
    return checks.verify_summary(checks.verify_entries(e, recorded).withColumn("tier", F.lit("entry")))


@query(_E + ", r AS (SELECT path, entry_id FROM entries) SELECT path, CASE WHEN entry_id % 9 = 0 THEN 'removed' WHEN entry_id % 9 = 1 THEN 'added' WHEN entry_id % 9 = 2 THEN 'modified' ELSE 'unchanged' END AS status FROM (SELECT path, min(entry_id) AS entry_id FROM r GROUP BY 1)")
def incremental_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Extension. The new version lacks some entries, has others besides, and changes some."""
    e = entries(spark, sf).groupBy("path").agg(F.min_by("content", "entry_id").alias("content"), F.min("entry_id").alias("entry_id"))
    new = e.filter("entry_id % 9 != 0").withColumn("content", F.when(F.col("entry_id") % 9 == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return stats.incremental_diff(e.filter("entry_id % 9 != 1"), new)


# Search

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '<script[^>]*>.*?</script>', chr(1), 'gs'), '<style[^>]*>.*?</style>', chr(1), 'gs'), '<!--.*?-->', chr(1), 'gs'), '<[^>]*>', chr(1), 'g')"


def _has(text: str, words: str, verify: bool = False) -> str:
    parts = [words] if verify else [words[i : i + 3] for i in range(len(words) - 2)]
    return " AND ".join(f"contains({_FOLD.format(text)}, '{p}')" for p in dict.fromkeys(parts))


def _hits(words: str, verify: bool = False) -> str:
    return _E + rf""", v AS (SELECT archive, entry_id, title, title || ' ' || path AS head,
      CASE WHEN mime_type = 'text/html' THEN array_to_string(list_filter(string_split({_VISIBLE}, chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''), ' ') ELSE content END AS body FROM entries WHERE is_front),
    h AS (SELECT archive, entry_id, {_has('title', words, verify)} AS title_match, ({_has('head', words, verify)}) OR ({_has('body', words, verify)}) AS body_match FROM v) """


@query(_hits("that") + "SELECT archive, entry_id, title_match, body_match FROM h WHERE title_match OR body_match ORDER BY title_match DESC, archive, entry_id LIMIT 20")
def search_two_tier(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(entries(spark, sf), "that")


@query(_hits("the of") + "SELECT archive, entry_id, title_match, body_match FROM h WHERE title_match OR body_match")
def search_all_hits(spark: SparkSession, sf: str) -> DataFrame:
    return search.scan(entries(spark, sf), "the of")


@query(_hits("the of", True) + "SELECT archive, entry_id, title_match, body_match FROM h WHERE title_match OR body_match")
def search_verified(spark: SparkSession, sf: str) -> DataFrame:
    return search.scan(entries(spark, sf), "The Of", verify=True)


@query(_E + f"SELECT archive, entry_id, true AS title_match, false AS body_match FROM entries WHERE is_front AND {_has('title', 'than')} ORDER BY archive, entry_id LIMIT 20")
def search_title(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(entries(spark, sf), "than", titles_only=True)


@query(_hits("en la") + ", r AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY title_match DESC, entry_id) AS n FROM h WHERE title_match OR body_match) SELECT archive, entry_id, title_match, body_match FROM r WHERE n <= 3 ORDER BY archive, title_match DESC, entry_id LIMIT 40")
def search_federated(spark: SparkSession, sf: str) -> DataFrame:
    return search.federated(entries(spark, sf), "en la", 40, per_archive=3)


def _stored(spark: SparkSession, rows: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    path = scratch(spark, "search")
    search.write_index(rows, path, **options)
    return search.read_index(spark, path)


@query(_hits("the of") + "SELECT archive, entry_id, title_match, body_match FROM h WHERE title_match OR body_match")
def search_index(spark: SparkSession, sf: str) -> DataFrame:
    """All hits through stored postings."""
    posts, pruned = _stored(spark, entries(spark, sf))
    return search.search_index(posts, "the of", None, pruned=pruned)


@query(_hits("that") + "SELECT archive, entry_id, title_match, body_match FROM h WHERE title_match OR body_match ORDER BY title_match DESC, archive, entry_id LIMIT 20")
def search_index_page(spark: SparkSession, sf: str) -> DataFrame:
    """The first hits in rank order through stored postings."""
    posts, pruned = _stored(spark, entries(spark, sf))
    return search.search_index(posts, "that", pruned=pruned)


def _with_cjk(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that end in a few CJK characters, by their number."""
    n = F.floor(F.col("entry_id") / 4) % 6
    tail = F.element_at(F.array(*[F.lit(t) for t in _TAILS]), (n + 1).cast("int"))
    return entries(spark, sf).filter("mime_type = 'text/plain'").withColumn("content", F.concat("content", F.lit(" "), tail))


_TAILS = ("日本語", "本日", "日中本", "東京", "", "ニ日本")
_WITH_CJK = _E + f""", v AS (SELECT archive, entry_id, content || ' ' || list_extract([{", ".join(f"'{t}'" for t in _TAILS)}], (entry_id // 4) % 6 + 1) AS body FROM entries WHERE mime_type = 'text/plain' AND is_front)
SELECT archive, entry_id, false AS title_match, true AS body_match FROM v WHERE contains(body, '日本')"""


@query(_WITH_CJK)
def search_cjk(spark: SparkSession, sf: str) -> DataFrame:
    posts, pruned = _stored(spark, _with_cjk(spark, sf))
    return search.search_index(posts, "日本", None, pruned=pruned)


@query(_WITH_CJK)
def search_cjk_scan(spark: SparkSession, sf: str) -> DataFrame:
    return search.scan(_with_cjk(spark, sf), "日本")


_TITLE_GRAMS = r""", g AS (SELECT DISTINCT archive, entry_id, substring(h, 2 * i - 1, 6) AS gram FROM (SELECT archive, entry_id, hex(encode({0})) AS h, unnest(range(1, strlen(title)::BIGINT - 1)) AS i FROM entries WHERE is_front AND strlen(title) >= 3)) """.format(_FOLD.format("title"))


@query(_E + _TITLE_GRAMS + "SELECT ('0x' || gram)::INTEGER AS gram, count(*) AS df FROM g GROUP BY 1")
def trigram_title_df(spark: SparkSession, sf: str) -> DataFrame:
    return search.frequencies(entries(spark, sf), ("title",)).select("gram", "df")


@query(_E + _TITLE_GRAMS + "SELECT archive, ('0x' || gram)::INTEGER AS gram, count(*) AS df FROM g GROUP BY 1, 2 HAVING count(*) >= 20 AND count(*) >= 0.3 * any_value((SELECT count(DISTINCT entry_id) FROM g d WHERE d.archive = g.archive))")
def trigram_prune(spark: SparkSession, sf: str) -> DataFrame:
    return search.pruned_grams(search.postings(entries(spark, sf), ("title",)), 0.3, 20).select("archive", "gram", "df")


@query(_E + rf""", v AS (SELECT archive, entry_id, title || ' ' || path AS head,
  CASE WHEN mime_type = 'text/html' THEN array_to_string(list_filter(string_split({_VISIBLE}, chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''), ' ') ELSE content END AS body FROM entries WHERE is_front),
  t AS (SELECT archive, entry_id, unnest([head, body]) AS t FROM v), h AS (SELECT archive, entry_id, hex(encode({_FOLD.format('t')})) AS h FROM t WHERE strlen(t) >= 3),
  g AS (SELECT archive, entry_id, unnest(list_distinct(list_transform(range(1, length(h)::BIGINT // 2 - 1), lambda i: substring(h, 2 * i - 1, 6)))) AS gram FROM h)
SELECT 'body' AS idx, ('0x' || gram)::INTEGER AS gram, count(DISTINCT (archive, entry_id)) AS df FROM g GROUP BY 2""")  # fmt: skip
def trigram_body_df(spark: SparkSession, sf: str) -> DataFrame:
    return search.frequencies(entries(spark, sf), ("body",))


_CJK = [("日", [0xE697A5]), ("日本", [0xE697A5, 0xE69CAC, 0xA5E69C]), ("abcd", [0x616263, 0x626364]), ("日abc本", [0xE697A5, 0x616263, 0xE69CAC]), ("ab", [])]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {sorted(g) or 'CAST([] AS INTEGER[])'})" for t, g in _CJK) + ") t(text, grams)")
def cjk_grams(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t, _ in _CJK], "text string")
    grams = F.pandas_udf(lambda s: s.map(T.grams), "array<int>")
    return rows.select("text", grams("text").alias("grams"))


@query()
def search_snippets(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return search.with_snippets(search.search(e, "that"), e, "that")


# Text and name functions


@query(r"""SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gs'), '<style[^>]*>.*?</style>', '', 'gs'), '<!--.*?-->', '', 'gs'),
'</?(p|div|nav|ul|li|h1|article|footer|br)( [^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&') AS t FROM pages)""")  # fmt: skip
def strip_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.strip_html_udf("html").alias("text"))


@query(rf"SELECT page_id, array_to_string(list_filter(string_split({_VISIBLE}, chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''), ' ') AS text FROM (SELECT page_id, html AS content FROM pages)")
def visible_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.visible_text_udf("html").alias("text"))


@query()
def markdown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.markdown_udf("html").alias("text"))


@query(_E + r"SELECT entry_id, CASE WHEN mime_type = 'text/html' THEN strlen(trim(regexp_replace(regexp_replace(content, '<!--.*?-->', '', 'gs'), '\s+', ' ', 'g'))) ELSE size END AS size FROM entries")
def transform_content(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.transform(entries(spark, sf)).select("entry_id", "size")


@query(r"""SELECT path, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[.]html$', ''), '(.)(_[0-9][^_]{3,})+$', '\1') AS slug FROM (SELECT 'lib/' || source || '_all_maxi_2024-0' || (doc_id % 9) || '.html' AS path FROM documents)""")
def archive_slug(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("lib/"), "source", F.lit("_all_maxi_2024-0"), (F.col("doc_id") % 9).cast("string"), F.lit(".html"))
    return table(spark, sf, "documents").select(path.alias("path")).select("path", C.archive_slug(F.col("path"), ".html").alias("slug"))


@query(_E + r"SELECT entry_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[ _.\-]+', '-', 'g'), '[^a-z0-9\-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM entries")
def book_slug(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select("entry_id", C.book_slug(F.col("title")).alias("slug"))


@query(_E + """SELECT entry_id, '"' || substring(sha256(archive || path), 1, 32) || '"' AS etag FROM entries""")
def etag(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select("entry_id", C.etag(F.col("archive"), F.col("path")).alias("etag"))


@query(_E + """, p AS (SELECT string_split(path, '/') AS p FROM entries), t AS (SELECT unnest(list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x || '/' ELSE x END)) AS token FROM p)
SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, token LIMIT 65534""")  # fmt: skip
def token_table(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.token_table(entries(spark, sf))


@query(_E + "SELECT entry_id, regexp_full_match(title, '[\\t\\n\\r\\x20-\\x7e]*') = false AS is_binary FROM entries")
def binary_titles(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select("entry_id", C.is_binary_text(F.col("title")).alias("is_binary"))


@query("SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM documents")
def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", C.html_escape(F.col("text")).alias("escaped"))


# Library


@query(_E + "SELECT archive, count(*) AS entries, count_if(is_front)::BIGINT AS front_articles, sum(size)::BIGINT AS bytes, count_if(is_front) > 0 AS has_search FROM entries GROUP BY 1")
def library_list(spark: SparkSession, sf: str) -> DataFrame:
    return library.list_archives(entries(spark, sf))


@query(_E + "SELECT count(DISTINCT archive) AS archives, count(*) AS entries, sum(size)::BIGINT AS bytes, count(*) * 48 AS index_bytes FROM entries")
def library_totals(spark: SparkSession, sf: str) -> DataFrame:
    return library.totals(library.list_archives(entries(spark, sf)))


@query(_E + "SELECT archive, mime_type, count(*) AS entries, sum(size)::BIGINT AS bytes FROM entries GROUP BY 1, 2")
def archive_stats(spark: SparkSession, sf: str) -> DataFrame:
    return library.archive_stats(entries(spark, sf))


@query("SELECT source AS archive, lang AS slug, count(*) AS entries FROM documents GROUP BY 1, 2")
def catalog_items(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogs are written as JSON, an item a language, and parsed again."""
    per = table(spark, sf, "documents").groupBy(F.col("source").alias("archive"), "lang").agg(F.count("*").alias("entries"))
    metadata = per.groupBy("archive").agg(F.to_json(F.collect_list(F.struct(F.col("lang").alias("slug"), "entries"))).alias("value")).withColumn("key", F.lit("catalog"))
    return library.catalog_items(metadata).select("archive", "slug", "entries")


@query("SELECT coalesce((SELECT lang FROM documents WHERE lang <> '' GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1), 'en') AS language")
def language_mode(spark: SparkSession, sf: str) -> DataFrame:
    return stats.language_mode(table(spark, sf, "documents"))


@query("SELECT base, source, CASE WHEN n > 1 THEN base || '_' || n ELSE base END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY source) AS n FROM (SELECT DISTINCT source, substring(source, 1, 4) AS base FROM documents))")
def unique_slugs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("source", F.substring("source", 1, 4).alias("base")).distinct()
    return library.unique_slugs(rows, "base", "source").select("base", "source", "slug")


# Archives: written to files, and read back


def _archives(spark: SparkSession, sf: str, **options) -> str:
    out = scratch(spark, "archives")
    meta = table(spark, sf, "documents").select(F.col("source").alias("archive")).distinct().select("archive", F.lit("language").alias("key"), F.lit("en").alias("value"))
    archive_source.write_archives(entries(spark, sf), out, metadata=meta, redirects=redirects(spark, sf), **options).collect()
    return out


@query(_E + "SELECT archive, path, title, mime_type, is_front, size, sha256(content) AS digest FROM entries")
def archive_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = archive_source.read_archives(spark, _archives(spark, sf, search=False), "content", suffix=".car")
    return rows.select("archive", "path", "title", "mime_type", "is_front", "size", F.sha2("content", 256).alias("digest"))


@query(_WALKED + """, a AS (SELECT archive, count(*) AS n FROM entries GROUP BY 1)
SELECT 'file' AS tier, true AS ok, count(*) AS n FROM a UNION ALL SELECT 'entry', true, sum(n)::BIGINT FROM a UNION ALL SELECT 'section', true, 8 * count(*) + (SELECT count(DISTINCT archive) FROM redirects) FROM a""")  # fmt: skip
def archive_verify(spark: SparkSession, sf: str) -> DataFrame:
    return checks.verify_summary(archive_source.read_archives(spark, _archives(spark, sf), "verify", suffix=".car"))


@query(_WALKED + "SELECT w.archive, w.path, e.size, sha256(e.content) AS digest FROM walk w JOIN entries e ON e.archive = w.archive AND e.entry_id = w.t")
def archive_redirect_content(spark: SparkSession, sf: str) -> DataFrame:
    """Content of the redirects' paths, from the files alone."""
    out = _archives(spark, sf, search=False)
    led = archive_source.read_archives(spark, out, "redirects", suffix=".car")
    rows = catalog.resolved_content(archive_source.read_archives(spark, out, "content", suffix=".car"), led)
    return rows.join(led.select("archive", "path"), ["archive", "path"], "left_semi").select("archive", "path", "size", F.sha2("content", 256).alias("digest"))


@query(_hits("the of") + "SELECT archive, path, title_match, body_match FROM h JOIN entries USING (archive, entry_id) WHERE title_match OR body_match")
def archive_search(spark: SparkSession, sf: str) -> DataFrame:
    """Hits through the indexes in the files."""
    out = _archives(spark, sf)
    read = lambda t: archive_source.read_archives(spark, out, t, suffix=".car")
    hits = search.search_index(read("postings"), "the of", None, pruned=read("pruned"))
    return hits.join(read("entries").select("archive", "entry_id", "path"), ["archive", "entry_id"]).select("archive", "path", "title_match", "body_match")


@query(_E + "SELECT archive AS slug, count(*) AS entries, count_if(is_front)::BIGINT AS front_articles, sum(size)::BIGINT AS bytes, archive AS title, count_if(is_front) > 0 AS has_search FROM entries GROUP BY 1")
def archive_list(spark: SparkSession, sf: str) -> DataFrame:
    out = _archives(spark, sf)
    read = lambda t: archive_source.read_archives(spark, out, t, suffix=".car")
    return library.describe_archives(read("archives"), read("metadata")).select("slug", "entries", "front_articles", "bytes", "title", "has_search")
