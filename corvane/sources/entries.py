"""The entries relation over the corpus tables, and redirects between exact copies.

Ids: pages, documents and turns of conversations interleave, so ids need no counting; bit 31 marks a redirect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import table

REDIRECT_BIT = 1 << 31
COLUMNS = ("archive", "entry_id", "path", "title", "mime_type", "is_front", "content")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive, entry_id, path, title, mime_type, is_front, content and size (bytes) of all pages, documents and conversation turns."""
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("archive"), (F.col("page_id") * 4).alias("entry_id"), F.col("url").alias("path"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lit("text/html").alias("mime_type"), F.lit(True).alias("is_front"), F.col("html").alias("content"),
    )
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("archive"), (F.col("doc_id") * 4 + 1).alias("entry_id"), F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.substring("text", 1, 60).alias("title"), F.lit("text/plain").alias("mime_type"), F.lit(True).alias("is_front"), F.col("text").alias("content"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("archive"), ((F.col("conv_id") * 1000 + F.col("turn")) * 4 + 2).alias("entry_id"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("path"),
        F.col("role").alias("title"), F.lit("application/json").alias("mime_type"), F.lit(False).alias("is_front"), F.col("text").alias("content"),
    )
    return pages.unionByName(docs).unionByName(turns).withColumn("size", F.octet_length("content").cast("long"))


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A redirect for each exact copy of a document within its source: the last copy's leads to the first one's entry, the others' to the last copy's redirect. Texts that are null are no copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    # least and greatest combine before the shuffle, so a text that very many rows share is no task's burden
    ends = docs.filter("digest IS NOT NULL").groupBy("source", "digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    rows = docs.join(ends, ["source", "digest"]).filter("doc_id > first")
    target = F.when(F.col("doc_id") == F.col("last"), F.col("first") * 4 + 1).otherwise(F.col("last") + REDIRECT_BIT)
    return rows.select(F.col("source").alias("archive"), (F.col("doc_id") + REDIRECT_BIT).alias("redirect_id"), F.concat(F.lit("copy/"), F.col("doc_id").cast("string")).alias("path"), target.alias("target_id"))


#: The same relations for the SQL that queries are checked against.
ENTRIES_SQL = """entries AS (
  SELECT 'pages' AS archive, page_id * 4 AS entry_id, url AS path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         'text/html' AS mime_type, true AS is_front, html AS content, strlen(html)::BIGINT AS size FROM pages
  UNION ALL
  SELECT source, doc_id * 4 + 1, 'docs/' || source || '/' || doc_id, substring(text, 1, 60), 'text/plain', true, text, strlen(text)::BIGINT FROM documents
  UNION ALL
  SELECT 'conversations', (conv_id * 1000 + turn) * 4 + 2, 'conv/' || conv_id || '/' || turn, role, 'application/json', false, text, strlen(text)::BIGINT FROM conversations)"""
REDIRECTS_SQL = """redirects AS (
  SELECT source AS archive, doc_id + 2147483648 AS redirect_id, 'copy/' || doc_id AS path,
         CASE WHEN doc_id = last THEN first * 4 + 1 ELSE last + 2147483648 END AS target_id
  FROM (SELECT *, min(doc_id) OVER w AS first, max(doc_id) OVER w AS last FROM (SELECT doc_id, source, sha256(text) AS digest FROM documents WHERE text IS NOT NULL)
        WINDOW w AS (PARTITION BY source, digest)) WHERE doc_id > first)"""
