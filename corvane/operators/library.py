"""Many archives as one library, and the tool-shaped queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import catalog, search

#: Content beyond this isn't converted for a reader.
MOST_BYTES = 10 << 20
CATALOG = "array<struct<slug: string, title: string, creator: string, language: string, entry: string, entries: long>>"


def list_archives(entries: DataFrame) -> DataFrame:
    """slug, entries, front articles, bytes and whether there is something to search."""
    return entries.groupBy("archive").agg(F.count("*").alias("entries"), F.count_if("is_front").alias("front_articles"), F.sum("size").alias("bytes")).withColumn("has_search", F.col("front_articles") > 0)


def describe_archives(archives: DataFrame, metadata: DataFrame, base_url: str = "") -> DataFrame:
    """A row for each archive as a tool lists it: slug, title, description, language, uuid, entries, redirects, front_articles, bytes, docs of both search indexes, has_search and url. archives, metadata: the source's tables of those names."""
    keys = ("title", "description", "language")
    meta = metadata.filter(F.col("key").isin(*keys)).groupBy("archive").agg(*[F.max(F.when(F.col("key") == k, F.col("value").cast("string"))).alias(k) for k in keys])
    rows = archives.join(meta, "archive", "left")
    return rows.select(
        F.col("archive").alias("slug"), F.coalesce("title", "archive").alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("language", F.lit("")).alias("language"), "uuid", F.col("entry_count").alias("entries"), F.col("redirect_count").alias("redirects"),
        F.col("front_count").alias("front_articles"), F.col("content_size").alias("bytes"), "title_docs", "body_docs", (F.coalesce("title_docs", "body_docs", F.lit(0)) > 0).alias("has_search"), F.concat(F.lit(base_url + "/"), F.url_encode("archive"), F.lit("/")).alias("url"),
    )


def resources(archives: DataFrame, metadata: DataFrame, scheme: str = "archive") -> DataFrame:
    """uri and text (JSON) of each archive's metadata as a resource: its pairs with slug, uuid and counts. Binary values and icons are left out."""
    pairs = metadata.filter(~F.col("key").startswith("illustration_")).withColumn("v", F.try_validate_utf8(F.col("value").cast("binary").cast("string"))).filter("v IS NOT NULL")
    meta = pairs.groupBy("archive").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v")))).alias("metadata"))  # an archive's keys
    rows = archives.join(meta, "archive", "left")
    text = F.to_json(F.struct(F.col("archive").alias("slug"), "uuid", F.col("entry_count").alias("entries"), F.col("redirect_count").alias("redirects"), "metadata"))
    return rows.select(F.concat(F.lit(f"{scheme}://"), "archive", F.lit("/metadata")).alias("uri"), text.alias("text"))


def entry_resource(entries: DataFrame, uri: str, most_bytes: int = 10 << 20) -> DataFrame:
    """uri, mime_type, text and blob of the entry that a URI names: text for textual types, else bytes; neither for more than ``most_bytes``."""
    from corvane.functions.columns import is_binary_mime, parse_uri

    at = entries.sparkSession.range(1).select(parse_uri(F.lit(uri)).alias("u")).select("u.*").first()
    rows = get_entry(entries, at.archive, -1 if at.entry_id is None else at.entry_id)
    small = F.octet_length("content") <= most_bytes
    binary = is_binary_mime(F.col("mime_type"))
    return rows.select(F.lit(uri).alias("uri"), "mime_type", F.when(small & ~binary, F.col("content").cast("string")).alias("text"), F.when(small & binary, F.col("content").cast("binary")).alias("blob"))


def totals(archives: DataFrame) -> DataFrame:
    return archives.agg(F.count("*").alias("archives"), F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"), (F.sum("entries") * 48).alias("index_bytes"))


def unique_slugs(paths: DataFrame, base: str = "base", path: str = "path", mark: str = "_") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(base).orderBy(path))
    rows = paths.withColumn("__n", n)
    return rows.withColumn("slug", F.when(F.col("__n") > 1, F.concat(F.col(base), F.lit(mark), F.col("__n").cast("string"))).otherwise(F.col(base))).drop("__n")


def catalog_items(metadata: DataFrame) -> DataFrame:
    """A row for each item of an archive's catalog; archives whose catalog is missing or malformed have one row without item."""
    value = F.from_json(F.col("value").cast("string"), CATALOG)
    return metadata.filter("key = 'catalog'").select("archive", F.explode_outer(value).alias("i")).select("archive", "i.*")


def get_entry(entries: DataFrame, archive: str, entry_id: int | None = None, path: str | None = None) -> DataFrame:
    own = entries.filter(F.col("archive") == archive)
    return catalog.by_id(own, entry_id) if entry_id is not None else catalog.by_path(own, path)


def read_entry(entries: DataFrame, archive: str, entry_id: int, form: str = "text", most: int | None = None, section: str | None = None, source: bool = False) -> DataFrame:
    """An entry's content as text, markdown or html, one section of it if wanted, with a line that says where it is from, cut to a length with a mark. Content of more than MOST_BYTES isn't converted."""
    rows = get_entry(entries, archive, entry_id).filter(F.octet_length("content") <= MOST_BYTES)
    page = F.col("mime_type").contains("html")
    body = F.coalesce(T.section_udf(section)(F.when(page, F.col("content"))), F.when(~page, F.col("content"))) if section else F.col("content")
    if form != "html":
        convert = T.markdown_udf if form == "markdown" else T.strip_html_udf
        body = F.coalesce(convert(F.when(page, body)), F.when(~page, body))
    parts = [F.lit("# "), F.col("title"), F.lit("\n\n"), body]
    if source:
        parts += [F.lit("\n\n[source: "), T.entry_href_udf(F.col("archive"), F.col("path")), F.lit("]")]
    out = F.concat(*parts)
    if most:
        out = F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("\n\n[truncated]"))).otherwise(out)
    return rows.select("archive", "entry_id", "mime_type", out.alias("text"))


def search_text(entries: DataFrame, query: str, archive: str | None = None, limit: int = 20, snippets: bool = False, snippet_length: int = 200, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Hits in one archive or all; index: stored postings and pruned grams to look up instead of scanning."""
    keep = (lambda df: df) if archive is None else (lambda df: df.filter(F.col("archive") == archive))
    own = keep(entries)
    hits = search.federated(own, query, min(max(1, limit), 100), index=None if index is None else tuple(map(keep, index)))
    return search.with_snippets(hits, own, query, snippet_length) if snippets else hits


def archive_stats(entries: DataFrame) -> DataFrame:
    """Entries and bytes by archive and MIME type."""
    return entries.groupBy("archive", "mime_type").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))
