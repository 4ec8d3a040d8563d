"""Mapping of namespaced wiki dumps, given as rows, to entries, redirects and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.columns import namespace_path
from corvane.operators.catalog import resolve
from corvane.sources.entries import REDIRECT_BIT


def map_raw(raw: DataFrame, archive: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entries, flattened redirects and metadata. raw: id, ns, path, title, mime_type, content, redirect_to (an id). Chains are flattened; broken and looping ones are dropped."""
    where = namespace_path(F.col("ns"), F.col("path"))
    kept = raw.withColumn("new_path", where).filter("new_path IS NOT NULL")
    content = kept.filter("redirect_to IS NULL").select(F.lit(archive).alias("archive"), F.col("id").alias("entry_id"), F.col("new_path").alias("path"), "title", "mime_type", ((F.col("ns") == "C") & (F.col("mime_type") == "text/html")).alias("is_front"), "content")
    hops = kept.filter("redirect_to IS NOT NULL")
    ids = kept.select(F.col("id").alias("redirect_to"), F.col("redirect_to").isNotNull().alias("is_hop"))
    pointers = hops.join(ids, "redirect_to", "left").select((F.col("id") + REDIRECT_BIT).alias("redirect_id"), F.when(F.col("is_hop"), F.col("redirect_to") + REDIRECT_BIT).otherwise(F.col("redirect_to")).alias("target_id"))
    ends = resolve(pointers, content).filter("status = 'resolved'")
    redirects = ends.join(hops.select((F.col("id") + REDIRECT_BIT).alias("redirect_id"), F.col("new_path").alias("path"), "title"), "redirect_id").select(F.lit(archive).alias("archive"), "redirect_id", "path", "title", F.col("entry_id").alias("target_id"))
    names = raw.filter("ns = 'M'").select(F.lit(archive).alias("archive"), F.lower("path").alias("key"), F.col("content").alias("value"))
    return content, redirects, names
