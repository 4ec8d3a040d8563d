"""Listings and reports in the shape that command-line tools print, as rows or JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.columns import human_bytes
from corvane.operators import catalog, search, stats


def listing(entries: DataFrame, redirects: DataFrame) -> DataFrame:
    """kind, mime, size and path of all entries in path order; a redirect shows dashes."""
    rows = catalog.with_redirects(entries, redirects)
    dash = F.lit("-")
    return rows.orderBy("path", "entry_id").select(
        F.when(F.col("is_redirect"), "redirect").otherwise("content").alias("kind"), F.when(F.col("is_redirect"), dash).otherwise(F.col("mime_type")).alias("mime"),
        F.when(F.col("is_redirect"), dash).otherwise(human_bytes(F.col("size"))).alias("size"), "path",
    )


def search_lines(entries: DataFrame, query: str, limit: int = 20, width: int = 40) -> DataFrame:
    """archive, tag (T, B or TB) and the path cut to a column's width, in rank order."""
    hits = search.search(entries, query, limit)
    tag = F.concat(F.when(F.col("title_match"), "T").otherwise(""), F.when(F.col("body_match"), "B").otherwise(""))
    cut = F.when(F.length("path") > width, F.concat(F.substring("path", 1, width - 3), F.lit("..."))).otherwise(F.col("path"))
    rows = entries.select("archive", "entry_id", "path").join(F.broadcast(hits), ["archive", "entry_id"])  # at most ``limit`` hits
    return rows.orderBy(F.desc("title_match"), "entry_id").select("archive", tag.alias("tag"), cut.alias("path"))


def info(entries: DataFrame, redirects: DataFrame, top: int = 20, sections: DataFrame | None = None, chunks: DataFrame | None = None, classified: DataFrame | None = None) -> DataFrame:
    """One JSON object of an archive set: entry statistics and the most frequent MIME types; sections and chunks (the source's tables) and the profile if given."""
    census = stats.mime_census(entries).orderBy(F.desc("entries"), "mime_type").limit(top)
    types = census.agg(F.array_sort(F.collect_list(F.struct((-F.col("entries")).alias("o"), "mime_type", "entries", "total_bytes"))).alias("m"))
    types = types.select(F.transform("m", lambda x: F.struct(x["mime_type"].alias("mime_type"), x["entries"].alias("entries"), x["total_bytes"].alias("bytes"))).alias("mime_types"))
    both = stats.entry_stats(entries, redirects).crossJoin(types)  # one row each
    if sections is not None:
        by = sections.groupBy("type_name").agg(F.sum("compressed_size").alias("bytes"), F.sum("uncompressed_size").alias("uncompressed"))  # a row a type
        both = both.crossJoin(by.agg(F.array_sort(F.collect_list(F.struct("type_name", "bytes", "uncompressed"))).alias("sections")))
    if chunks is not None:
        both = both.crossJoin(chunks.agg(F.count("*").alias("n"), F.sum("compressed_size").alias("bytes"), F.sum("size").alias("uncompressed"), F.min("size").alias("smallest"), F.max("size").alias("largest")).select(F.struct("*").alias("chunks")))
    if classified is not None:
        most = classified.groupBy("profile").agg(F.count("*").alias("archives"), F.round(F.avg("confidence"), 4).alias("confidence"))  # at most eight rows
        both = both.crossJoin(most.agg(F.array_sort(F.collect_list(F.struct("profile", "archives", "confidence"))).alias("profiles")))
    return both.select(F.to_json(F.struct("*")).alias("info"))


def info_lines(info_json: DataFrame) -> DataFrame:
    """The same as lines of text: a key and its value, lists indented below."""
    @F.pandas_udf("array<string>")
    def lines(s: pd.Series) -> pd.Series:
        import json

        def walk(x, depth):
            pad = "  " * depth
            for k, v in x.items():
                if isinstance(v, dict):
                    yield f"{pad}{k}:"
                    yield from walk(v, depth + 1)
                elif isinstance(v, list):
                    yield f"{pad}{k}:"
                    for row in v:
                        yield f"{pad}  " + "  ".join(str(y) for y in row.values())
                else:
                    yield f"{pad}{k}: {v}"

        return s.map(lambda t: list(walk(json.loads(t), 0)))

    return info_json.select(F.posexplode(lines("info")).alias("nr", "line"))


def comparison(a: DataFrame, b: DataFrame, metadata_a: DataFrame, metadata_b: DataFrame, sections_a: DataFrame | None = None, sections_b: DataFrame | None = None) -> DataFrame:
    """section, key, a, b: sizes, MIME types and metadata that differ between two archives, and the bytes of each section and category if sections are given."""
    size = a.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("x")).crossJoin(b.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("y")))  # one row each
    sizes = size.select(F.lit("size").alias("section"), F.lit("bytes").alias("key"), F.col("x").cast("string").alias("a"), F.col("y").cast("string").alias("b"))
    delta = size.select(F.lit("size"), F.lit("delta_percent"), F.lit(""), F.when(F.col("x") > 0, F.format_string("%.1f", 100 * (F.col("y") - F.col("x")) / F.col("x"))).otherwise(""))
    mime = stats.compare_mime(a, b).select(F.lit("mime"), "mime_type", F.col("n_a").cast("string"), F.col("n_b").cast("string"))
    meta = stats.compare_metadata(metadata_a, metadata_b).select(F.lit("metadata"), "key", "value_a", "value_b")
    out = sizes.union(delta).union(mime).union(meta)
    if sections_a is not None and sections_b is not None:
        budget = lambda s, n: stats.size_budget(s.groupBy("type_name").agg(F.sum("compressed_size").alias("compressed_size")), 1)
        left, right = (budget(s, n).select("type_name", "category", F.col("compressed_size").cast("string").alias(n)) for s, n in ((sections_a, "a"), (sections_b, "b")))
        both = left.join(right, ["type_name", "category"], "full_outer")
        out = out.union(both.select(F.concat(F.lit("budget "), "category"), "type_name", F.coalesce("a", F.lit("0")), F.coalesce("b", F.lit("0"))))
    return out
