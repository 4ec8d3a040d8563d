"""From raw entries to hashed, deduplicated, ordered and packed content."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.columns import chunk_key, mime_group, path_tokens
from corvane.operators.catalog import ranked, running

CHUNK_BYTES = 4 << 20


def transform(entries: DataFrame) -> DataFrame:
    """Markup, styles and images of the groups that can be made smaller; other content as it is and never sent to Python."""
    group = mime_group(F.col("mime_type"))
    treated = group.isin("html", "css", "svg", "js")
    small = T.minify_any_udf(F.when(treated, F.col("content")), F.when(treated, group))
    return entries.withColumn("content", F.coalesce(small, F.col("content"))).withColumn("size", F.octet_length("content").cast("long"))


def strip_images(entries: DataFrame) -> DataFrame:
    """JPEG images (binary content) without their metadata segments."""
    jpeg = F.split_part(F.col("mime_type"), F.lit(";"), F.lit(1)) == "image/jpeg"
    small = T.strip_jpeg_udf(F.when(jpeg, F.col("content")))
    return entries.withColumn("content", F.coalesce(small, F.col("content"))).withColumn("size", F.octet_length("content").cast("long"))


def first_occurrences(entries: DataFrame) -> DataFrame:
    """Adds blob_owner, the archive's smallest entry_id with the same content. Groups are found by digest, so copies are counted before they meet, and no content is shuffled. Content that is null is its own."""
    hashed = entries.select("archive", "entry_id", "mime_type", "size", "path", F.sha2("content", 256).alias("digest"))
    owner = hashed.filter("digest IS NOT NULL").groupBy("archive", "digest").agg(F.min("entry_id").alias("blob_owner"))
    return hashed.join(owner, ["archive", "digest"], "left").withColumn("blob_owner", F.coalesce("blob_owner", "entry_id"))


def assign_ids(entries: DataFrame) -> DataFrame:
    """Adds id, in each archive from 0 in the order of (chunk_key, path)."""
    rows = entries.select("archive", "entry_id", "path", "mime_type", "size", chunk_key(F.col("mime_type"), F.col("size")).alias("chunk_key"))
    placed = ranked(rows, "archive", "chunk_key", "path", "entry_id", name="__n")
    first = placed.groupBy("archive").agg(F.min("__n").alias("__first"))
    return placed.join(first, "archive").withColumn("id", F.col("__n") - F.col("__first")).drop("__n", "__first")


#: Chunks of an archive and key that one task packs greedily.
STRETCH = 64


def pack_chunks(entries: DataFrame, target: int = CHUNK_BYTES) -> DataFrame:
    """Greedy packing in each archive in the order of (chunk_key, path): a chunk closes once it has ``target`` bytes. Adds chunk and blob_offset.

    A sum that starts again depends on all rows before it, so a key is packed within stretches of STRETCH chunks' bytes, which the running sum
    of sizes draws: the same on any cluster. The stretch's number is part of the chunk's. Only ids, keys and sizes take part.
    """
    rows = entries.select("archive", "entry_id", "path", F.coalesce("size", F.lit(0)).alias("size"), chunk_key(F.col("mime_type"), F.coalesce("size", F.lit(0))).alias("chunk_key"))
    rows = running(rows, ("archive", "chunk_key"), ("path", "entry_id")).withColumn("stretch", F.floor(F.col("before") / (STRETCH * target)).cast("long"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["before", "path", "entry_id"], kind="stable")  # rows of size 0 share the sum with the next
        used, chunk, out = 0, 0, []
        for s, k in zip(rows["size"].tolist(), rows.stretch.tolist()):
            if used >= target:
                used, chunk = 0, chunk + 1
            out.append((f"{k}-{chunk}", used))
            used += s
        rows["chunk"], rows["blob_offset"] = zip(*out)
        return rows[["archive", "entry_id", "chunk_key", "chunk", "blob_offset", "size"]]

    return rows.groupBy("archive", "chunk_key", "stretch").applyInPandas(run, "archive string, entry_id long, chunk_key string, chunk string, blob_offset long, size long")


def bucket_chunks(entries: DataFrame, target: int = CHUNK_BYTES) -> DataFrame:
    """Packing without a sequential pass: a chunk is a stretch of the running sum of sizes within (archive, chunk_key)."""
    rows = entries.select("archive", "entry_id", "path", "size", chunk_key(F.col("mime_type"), F.col("size")).alias("chunk_key"))
    rows = running(rows, ("archive", "chunk_key"), ("path", "entry_id")).withColumn("chunk", F.floor(F.col("before") / target).cast("long"))
    first = F.min("before").over(Window.partitionBy("archive", "chunk_key", "chunk"))  # a chunk's rows
    return rows.withColumn("blob_offset", F.col("before") - first).drop("before")


def prefix_lengths(paths: DataFrame, key: str = "path", restart: int = 64) -> DataFrame:
    """Adds the bytes that each key shares with the one before it in key order; a key that begins a block of ``restart`` shares none."""
    placed = ranked(paths, key, name="__n")
    part = F.floor((F.col("__n") - 1) / restart)
    last = F.lag(key).over(Window.partitionBy(part).orderBy("__n"))  # a block's rows
    return placed.withColumn("shared", F.when(last.isNull(), 0).otherwise(shared_prefix(last, F.col(key)))).drop("__n")


def running_offsets(rows: DataFrame, order: str, size: str = "size", base: int = 0) -> DataFrame:
    """Adds where each of a few rows (sections) begins."""
    by = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(size).over(by), F.lit(0)) + base)


def samples(entries: DataFrame, most: int = 2000) -> DataFrame:
    """The first entries of each chunk key, for training dictionaries; a limit is pushed below the shuffle."""
    rows = entries.withColumn("chunk_key", chunk_key(F.col("mime_type"), F.col("size")))
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("chunk_key").orderBy("entry_id"))).filter(F.col("__n") <= most).drop("__n")


def token_table(entries: DataFrame, column: str = "path", least: int = 3, most: int = 65534) -> DataFrame:
    """Path parts met at least three times, the most frequent first."""
    parts = entries.select(F.explode(path_tokens(F.col(column))).alias("token")).filter("token != ''")
    return parts.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most)


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of what two strings begin with alike, in bytes."""
    x, y = F.hex(a.cast("binary")), F.hex(b.cast("binary"))
    n = F.least(F.length(x), F.length(y))
    pair = lambda s, i: F.substring(s, 2 * i - 1, F.lit(2))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), (n / 2).cast("int"))), F.lit(0), lambda k, i: F.when((k == i - 1) & (2 * i <= n) & (pair(x, i) == pair(y, i)), i).otherwise(k))


def zstd_level(level: Column) -> Column:
    """The library's named speed for a numeric level."""
    return F.when(level <= 1, "fastest").when(level <= 4, "default").when(level <= 8, "better").otherwise("best")


def train_dictionaries(entries: DataFrame, most: int = 2000, size: int = 112 << 10, least: int = 10, history: int = 128 << 10) -> DataFrame:
    """chunk_key and dictionary, one task a key, from its first ``most`` entries; keys with too little to learn from have none. A dictionary is kept only if it saves more on its samples than it takes."""

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        texts = [t.encode() for t in rows.sort_values("entry_id").content if t]
        none = pd.DataFrame({"chunk_key": [], "dictionary": []}, dtype=object)
        if len(texts) < least or sum(map(len, texts)) < history:
            return none
        try:
            made = zstandard.train_dictionary(size, texts)
        except zstandard.ZstdError:
            return none
        plain, own = zstandard.ZstdCompressor(6), zstandard.ZstdCompressor(6, dict_data=made)
        saved = sum(len(plain.compress(t)) - len(own.compress(t)) for t in texts)
        if saved <= len(made.as_bytes()) or zstandard.ZstdDecompressor(dict_data=made).decompress(own.compress(texts[0])) != texts[0]:
            return none
        return pd.DataFrame({"chunk_key": [rows.chunk_key.iloc[0]], "dictionary": [made.as_bytes()]})

    rows = samples(entries, most).select("chunk_key", "entry_id", "content")
    return rows.groupBy("chunk_key").applyInPandas(train, "chunk_key string, dictionary binary")


def compress_chunks(packed: DataFrame, entries: DataFrame, level: int = 6) -> DataFrame:
    """chunk, size, compressed bytes and codec of each packed chunk; images stay raw unless zstd makes them smaller. A chunk holds a few MB, so it fits a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        rows = rows.sort_values("blob_offset", kind="stable")
        raw = b"".join((t or "").encode() for t in rows.content)
        image = rows.chunk_key.iloc[0] == "image"
        small = zstandard.ZstdCompressor(1 if image else level).compress(raw)
        keep = image and len(small) >= len(raw)
        return pd.DataFrame({"archive": [rows.archive.iloc[0]], "chunk_key": [rows.chunk_key.iloc[0]], "chunk": [rows.chunk.iloc[0]], "size": [len(raw)], "compression": [0 if keep else 1], "data": [raw if keep else small]})

    joined = packed.select("archive", "entry_id", "chunk_key", "chunk", "blob_offset").join(entries.select("archive", "entry_id", "content"), ["archive", "entry_id"])
    return joined.groupBy("archive", "chunk_key", "chunk").applyInPandas(run, "archive string, chunk_key string, chunk string, size long, compression int, data binary")


def metadata_defaults(found: DataFrame, today: str) -> DataFrame:
    """archive, key, value with lower-case keys, and the required ones that are missing filled in. found: archive, key, value (string)."""
    rows = found.select("archive", F.lower("key").alias("key"), "value")
    defaults = {"title": F.lit("Untitled"), "language": F.lit("eng"), "creator": F.lit("Unknown"), "date": F.lit(today), "source": F.col("archive")}
    filled = rows.select("archive").distinct().select("archive", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in defaults.items()])).alias("d")).select("archive", "d.*")
    return rows.unionByName(filled.join(rows, ["archive", "key"], "left_anti"))
