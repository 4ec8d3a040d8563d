"""Lookups, ordered browsing, paging, letters and redirect resolution over the entries relation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import cut
from corvane.sources.entries import REDIRECT_BIT


def by_id(entries: DataFrame, entry_id: int) -> DataFrame:
    return entries.filter(F.col("entry_id") == entry_id)


def by_path(entries: DataFrame, path: str) -> DataFrame:
    return entries.filter(F.col("path") == path)


def by_title(entries: DataFrame, title: str) -> DataFrame:
    """The entry with this title; of several, the one with the smallest id."""
    return entries.filter(F.col("title") == title).orderBy("entry_id").limit(1)


def main_entry(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Each archive's entry whose path its metadata key main_entry holds."""
    key = metadata_value(metadata, "main_entry").select("archive", F.col("value").cast("string").alias("path"))
    return entries.join(key, ["archive", "path"], "left_semi")


def front(entries: DataFrame) -> DataFrame:
    return entries.filter("is_front")


def by_mime(entries: DataFrame, mime_type: str) -> DataFrame:
    return entries.filter(F.col("mime_type") == mime_type)


def count_by_mime(entries: DataFrame) -> DataFrame:
    return entries.groupBy("mime_type").agg(F.count("*").alias("entries"))


def with_redirects(entries: DataFrame, redirects: DataFrame) -> DataFrame:
    """Content and redirects as one relation; a redirect has no MIME type and size 0."""
    own = entries.select("entry_id", "path", "mime_type", "size", F.lit(False).alias("is_redirect"))
    other = redirects.select(F.col("redirect_id").alias("entry_id"), "path", F.lit("").alias("mime_type"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_redirect"))
    return own.unionByName(other)


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Adds each row's place, from 1, in a global order, without bringing the rows into one task: rows are range-partitioned and sorted, and each partition's start is the sum of the counts before it."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row a partition
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__start")
    return placed.withColumn("__part", part).join(starts, "__part").withColumn(name, F.col("__start") + row + 1).drop("__part", "__start", "__at")


def running(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], size: str = "size", name: str = "before") -> DataFrame:
    """Adds the sum of ``size`` over the rows before, in this order within equal keys. In two levels like ``ranked``: a key that holds most of the rows is spread over many tasks."""
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    along = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("__part", *keys).agg(F.sum(size).alias("__sum"))  # at most a row a partition and key
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    out = placed.withColumn("__own", F.coalesce(F.sum(size).over(along), F.lit(0))).join(starts, ["__part", *keys])
    return out.withColumn(name, F.col("__start") + F.col("__own")).drop("__part", "__start", "__own")


def browse_titles(entries: DataFrame, offset: int, limit: int = 50, most: int = 200) -> DataFrame:
    """One page of the entries in title order."""
    return entries.orderBy("title", "entry_id").offset(max(0, offset)).limit(min(max(1, limit), most))


def title_page(entries: DataFrame, offset: int, limit: int = 50, most: int = 200) -> DataFrame:
    """A page of titles with total_count, the number of entries there are."""
    total = entries.agg(F.count("*").alias("total_count"))
    return browse_titles(entries, offset, limit, most).select("archive", "entry_id", "path", "title").crossJoin(total)  # one row


def by_title_order(entries: DataFrame, redirects: DataFrame) -> DataFrame:
    """All entries and redirects with their place in the order of (title, path, id), from 1."""
    title = F.col("title") if "title" in redirects.columns else F.lit("")
    both = entries.select("archive", "entry_id", "path", "title").unionByName(redirects.select("archive", F.col("redirect_id").alias("entry_id"), "path", title.alias("title")))
    return ranked(both, "title", "path", "entry_id")


def metadata_value(metadata: DataFrame, key: str) -> DataFrame:
    """archive and value (binary) of a metadata key."""
    return metadata.filter(F.col("key") == key).select("archive", F.col("value").cast("binary").alias("value"))


def letter(title: str = "title") -> Column:
    """A to Z by the first character, # for anything else; null for empty titles."""
    first = F.substring(F.col(title), 1, 1)
    up = F.translate(first, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.when(F.col(title) == "", None).when(up.rlike("^[A-Z]$"), up).otherwise("#")


def letter_counts(entries: DataFrame) -> DataFrame:
    return entries.withColumn("letter", letter()).filter("letter IS NOT NULL").groupBy("letter").agg(F.count("*").alias("entries"))


def browse_letter(entries: DataFrame, wanted: str, offset: int = 0, limit: int = 50, most: int = 200) -> DataFrame:
    """A page of one letter. Filtering first keeps letters of either case together, whatever the byte order."""
    return browse_titles(entries.filter(letter() == wanted), offset, limit, most)


def resolve(redirects: DataFrame, content: DataFrame) -> DataFrame:
    """redirect_id, entry_id and status (resolved, loop or broken) of each redirect, within its archive if the tables have archives.

    Pointers are doubled, so a chain of n hops takes log2(n) joins; what still points at a redirect after
    enough rounds is in or behind a loop.
    """
    keys = ["archive", "target_id"] if "archive" in redirects.columns else ["target_id"]
    own_keys = keys[:-1]
    state = cut(redirects.select(*own_keys, "redirect_id", "target_id"))
    rounds = math.ceil(math.log2(max(2, state.count()))) + 1
    for _ in range(rounds):
        hop = state.select(*own_keys, F.col("redirect_id").alias("target_id"), F.col("target_id").alias("next"))
        step = state.join(hop, keys, "left").select(*own_keys, "redirect_id", F.coalesce("next", "target_id").alias("target_id"), (F.col("next").isNotNull()).alias("moved"))
        step = cut(step)
        state = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    known = content.select(*own_keys, F.col("entry_id").alias("target_id"), F.lit(True).alias("known"))
    own = redirects.select(*own_keys, F.col("redirect_id").alias("target_id"), F.lit(True).alias("again"))
    out = state.join(known, keys, "left").join(own, keys, "left")
    status = F.when(F.col("known"), "resolved").when(F.col("again"), "loop").otherwise("broken")
    return out.select(*own_keys, "redirect_id", F.when(F.col("known"), F.col("target_id")).alias("entry_id"), status.alias("status"))


def resolved_content(entries: DataFrame, redirects: DataFrame) -> DataFrame:
    """archive, path, entry_id, mime_type, size and content of every path: an entry's own, a redirect's that of the entry it leads to. Redirects that lead nowhere have no row."""
    rest = ["mime_type", "size", "content"]
    ends = resolve(redirects, entries).filter("status = 'resolved'").join(redirects.select("archive", "redirect_id", "path"), ["archive", "redirect_id"])
    led = ends.select("archive", "path", "entry_id").join(entries.select("archive", "entry_id", *rest), ["archive", "entry_id"])
    return entries.select("archive", "path", "entry_id", *rest).unionByName(led.select("archive", "path", "entry_id", *rest))


def is_redirect_id(column: str) -> Column:
    return F.col(column).bitwiseAND(F.lit(REDIRECT_BIT)) != 0


def random_front(entries: DataFrame, seed: int, per_archive: bool = False) -> DataFrame:
    """A front article drawn uniformly; per_archive: one of each archive."""
    drawn = front(entries).withColumn("__draw", F.rand(seed))
    if not per_archive:
        return drawn.orderBy("__draw").limit(1).drop("__draw")
    best = drawn.groupBy("archive").agg(F.min_by(F.struct("entry_id", "path", "title"), "__draw").alias("e"))
    return best.select("archive", "e.*")
