"""Census, sizes, comparison, features and profile classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def mime_census(entries: DataFrame) -> DataFrame:
    return entries.groupBy("mime_type").agg(F.count("*").alias("entries"), F.sum("size").alias("total_bytes"), F.round(F.avg("size"), 4).alias("avg_bytes"), F.min("size").alias("min_bytes"), F.max("size").alias("max_bytes"))


def entry_stats(entries: DataFrame, redirects: DataFrame) -> DataFrame:
    own = entries.agg(F.count("*").alias("content_entries"), F.count_if("is_front").alias("front_articles"), F.sum("size").alias("total_bytes"))
    return own.crossJoin(redirects.agg(F.count("*").alias("redirects")))  # one row each


def chunk_stats(chunked: DataFrame) -> DataFrame:
    """chunked: a row an entry with chunk."""
    per = chunked.groupBy("chunk").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("chunks"), F.round(F.avg("n"), 4).alias("avg_entries"), F.min("n").alias("min_entries"), F.max("n").alias("max_entries"))


def section_summary(sections: DataFrame) -> DataFrame:
    out = sections.agg(F.sum("compressed_size").alias("compressed"), F.sum("uncompressed_size").alias("uncompressed"))
    return out.withColumn("ratio", F.when(F.col("uncompressed") > 0, F.round(F.col("compressed") / F.col("uncompressed"), 6)).otherwise(0.0))


def size_budget(sections: DataFrame, file_size: int | Column) -> DataFrame:
    """Each section's share of the file, and content's and overhead's share of all sections."""
    category = F.when(F.col("type_name") == "CONTENT", "content").when(F.col("type_name").startswith("SEARCH"), "search").otherwise("overhead")
    everything = Window.partitionBy(F.lit(1))
    rows = sections.select("type_name", "compressed_size", category.alias("category"))
    total = F.sum("compressed_size").over(everything)
    share = F.sum("compressed_size").over(Window.partitionBy("category")) / total
    return rows.select("type_name", "compressed_size", "category", F.round(100 * F.col("compressed_size") / file_size, 4).alias("pct_of_file"), F.round(100 * share, 4).alias("category_pct"))


def compare_mime(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = (x.groupBy("mime_type").agg(F.count("*").alias(n)) for x, n in ((a, "n_a"), (b, "n_b")))
    out = left.join(right, "mime_type", "full_outer").select("mime_type", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return out.withColumn("delta", F.col("n_b") - F.col("n_a"))


def compare_metadata(a: DataFrame, b: DataFrame, ignored: tuple[str, ...] = ("converter", "converter_flags")) -> DataFrame:
    """Keys whose values differ; a missing one counts as empty."""
    left, right = (x.select("key", F.col("value").cast("string").alias(n)) for x, n in ((a, "value_a"), (b, "value_b")))
    out = left.join(right, "key", "full_outer").select("key", F.coalesce("value_a", F.lit("")).alias("value_a"), F.coalesce("value_b", F.lit("")).alias("value_b"))
    return out.filter((F.col("value_a") != F.col("value_b")) & ~F.col("key").startswith("illustration_") & ~F.col("key").isin(*ignored))


def dedup_stats(entries: DataFrame) -> DataFrame:
    """Entries, distinct contents and bytes saved by storing each once, by MIME type."""
    per = entries.groupBy("mime_type", F.sha2("content", 256).alias("digest")).agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return per.groupBy("mime_type").agg(F.sum("n").alias("entries"), F.count("*").alias("contents"), F.sum((F.col("n") - 1) * F.col("size")).alias("saved_bytes"))


def features(entries: DataFrame, redirects: DataFrame) -> DataFrame:
    """A classifier's input for each archive, by conditional sums in one pass."""
    mime = F.lower("mime_type")
    size = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0))
    census = entries.groupBy("archive", "mime_type").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    by = census.groupBy("archive").agg(
        F.sum("n").alias("entry_count"), F.count("*").alias("mime_types"), F.sum("size").alias("total"),
        size(mime.startswith("text/")).alias("text"), size(mime == "text/html").alias("html"), size(mime.startswith("image/")).alias("image"),
        size(mime == "application/pdf").alias("pdf"), size(mime.startswith("video/")).alias("video"), F.sum(F.when(F.col("size") / F.col("n") < 4096, F.col("n")).otherwise(0)).alias("small"),
    )
    by = by.join(redirects.groupBy("archive").agg(F.count("*").alias("redirects")), "archive", "left").withColumn("redirects", F.coalesce("redirects", F.lit(0)))
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(-1.0)
    return by.select(
        "archive", "entry_count", "mime_types", *[share(c).alias(f"{c}_ratio") for c in ("text", "html", "image", "pdf", "video")],
        (F.col("redirects") / (F.col("redirects") + F.col("entry_count"))).alias("redirect_density"), (F.col("total") / F.col("entry_count")).alias("avg_bytes"), (F.col("small") / F.col("entry_count")).alias("small_ratio"),
    )


#: What a source's name says about it; the first keyword found decides.
HINTS = (
    ("wiktionary", "wiktionary"), ("wikiquote", "wikiquote"), ("gutenberg", "gutenberg"), ("wikisource", "wikisource"), ("stackexchange", "stackexchange"), ("stack_exchange", "stackexchange"), ("stackoverflow", "stackexchange"),
    ("devdocs", "devdocs"), ("mankier", "devdocs"), ("openwrt", "devdocs"), ("zimit", "zimit"), ("ted.com", "ted"), ("vikidia", "vikidia"), ("wikipedia", "wikipedia"),
)


def source_hint(*fields: str) -> Column:
    """Hint from the first of these columns that holds a keyword; empty if none does."""
    found = []
    for field in fields:
        low = F.lower(F.col(field))
        hit = F.lit(None).cast("string")
        for word, hint in reversed(HINTS):
            hit = F.when(low.contains(word), hint).otherwise(hit)
        found.append(hit)
    return F.coalesce(*found, F.lit(""))


def classify(rows: DataFrame, hint: str = "hint") -> DataFrame:
    """Adds profile and confidence: ordered rules, the first that holds decides."""
    c = F.col
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    media = c("image_ratio") + c("video_ratio")
    rules = [
        (c("pdf_ratio") > 0.30, "pdf-container", clamp(0.6 + c("pdf_ratio"))),
        (media > 0.60, "media-heavy", clamp(0.5 + media / 2)),
        ((c("redirect_density") > 0.35) & (c("small_ratio") > 0.5) & (c("text_ratio") > 0.7), "dictionary", clamp(0.5 + c("redirect_density") / 2 + c("small_ratio") / 4)),
        (c(hint) == "stackexchange", "qa-forum", F.lit(0.9)),
        ((c("avg_bytes") > 50000) & (c("redirect_density") < 0.15) & (c("text_ratio") > 0.5), "books", clamp(0.6 + F.least(c("avg_bytes") / 200000, F.lit(0.3)))),
        ((c("text_ratio") > 0.8) & (c("image_ratio") < 0.1) & (c("avg_bytes") < 50000) & ((c(hint) == "devdocs") | (c("redirect_density") < 0.05)), "docs", clamp(0.6 + c("text_ratio") / 4)),
        ((c("text_ratio") > 0.5) & (c("image_ratio") > 0.1) & (c("image_ratio") < 0.5) & (c("mime_types") > 5) & (c("redirect_density") < 0.1), "qa-forum", F.lit(0.65)),
        ((c("html_ratio") > 0.3) & (c("redirect_density") > 0.05), "encyclopedia", clamp(0.6 + c("html_ratio") / 4)),
    ]
    blind = [
        (c(hint) == "wiktionary", "dictionary", 0.6), (c(hint) == "wikiquote", "dictionary", 0.55), (c(hint).isin("gutenberg", "wikisource"), "books", 0.5), (c(hint) == "stackexchange", "qa-forum", 0.55),
        (c(hint) == "devdocs", "docs", 0.55), (c(hint) == "ted", "media-heavy", 0.5), (c(hint) == "zimit", "mixed-scrape", 0.5), (c(hint).isin("wikipedia", "vikidia"), "encyclopedia", 0.55), (c("redirect_density") > 0.35, "dictionary", 0.45),
    ]
    profile, sure = F.lit("mixed-scrape"), F.lit(0.5)
    for ok, name, value in reversed(rules):
        profile, sure = F.when(ok, name).otherwise(profile), F.when(ok, value).otherwise(sure)
    other, unsure = F.lit("mixed-scrape"), F.lit(0.4)
    for ok, name, value in reversed(blind):
        other, unsure = F.when(ok, name).otherwise(other), F.when(ok, value).otherwise(unsure)
    seen = c("text_ratio") >= 0
    return rows.withColumns({"profile": F.when(seen, profile).otherwise(other), "confidence": F.round(F.when(seen, sure).otherwise(unsure), 6)})


#: chunk bytes, zstd level, dictionary samples, minify, optimise images, prune frequency
RECOMMENDED = {
    "encyclopedia": (4 << 20, 6, 2000, True, True, 0.5), "dictionary": (1 << 20, 9, 4000, True, False, 0.3), "books": (8 << 20, 6, 1000, True, False, 0.7), "qa-forum": (4 << 20, 11, 3000, True, True, 0.4),
    "docs": (2 << 20, 11, 3000, True, False, 0.5), "media-heavy": (8 << 20, 3, 500, False, True, 0.5), "pdf-container": (4 << 20, 6, 1000, False, False, 0.5), "mixed-scrape": (4 << 20, 6, 2000, True, True, 0.5),
}


def recommendations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in RECOMMENDED.items()], "profile string, chunk_size long, zstd_level int, dict_samples int, minify boolean, optimize_images boolean, prune_freq double")


def recommend(classified: DataFrame) -> DataFrame:
    """Adds the options for each profile; unknown profiles get those of mixed-scrape. The table has eight rows."""
    known = F.when(F.col("profile").isin(*RECOMMENDED), F.col("profile")).otherwise("mixed-scrape")
    options = recommendations(classified.sparkSession).withColumnRenamed("profile", "__profile")
    return classified.withColumn("__profile", known).join(F.broadcast(options), "__profile").drop("__profile")


def language_mode(rows: DataFrame, lang: str = "lang") -> DataFrame:
    """The most frequent language that isn't empty; ties by name; en if there is none."""
    top = rows.filter((F.col(lang).isNotNull()) & (F.col(lang) != "")).groupBy(lang).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang).limit(1)
    return top.agg(F.coalesce(F.first(lang), F.lit("en")).alias("language"))


def incremental_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Extension: path and status (added, removed, modified, unchanged) between two versions."""
    a, b = (x.select("path", F.sha2("content", 256).alias(n)) for x, n in ((old, "a"), (new, "b")))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))
