"""Metadata validation and tiered verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("title", "language", "creator", "date", "source")


def missing_metadata(metadata: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """archive and key of required keys that an archive lacks. archives: a table of all archives, as one without any metadata isn't in metadata."""
    known = metadata.select("archive") if archives is None else metadata.select("archive").unionByName(archives.select("archive"))
    wanted = known.distinct().withColumn("key", F.explode(F.array(*map(F.lit, REQUIRED))))
    return wanted.join(metadata, ["archive", "key"], "left_anti")


def validate_metadata(metadata: DataFrame, archives: DataFrame | None = None, numeric_main_entry: bool = False) -> DataFrame:
    """archive, key and message of every violation. metadata: archive, key, value (string or binary). main_entry is a path here and must not be blank; numeric_main_entry: it must be an entry's number."""
    v = F.col("value").cast("string")
    blank = v.rlike(r"^[\s\u0085   -     　]*$")
    number = v.rlike("^[0-9]+$") & (F.length(F.regexp_replace(v, "^0+", "")) <= 10) & (F.try_to_number(F.lpad(F.regexp_replace(v, "^0+", ""), 12, "0"), F.lit("999999999999")) <= 4294967295)
    lang = F.split_part(v, F.lit("-"), F.lit(1))
    good_date = v.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).isNotNull()
    good_time = v.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$") & F.try_to_timestamp(v).isNotNull()
    k = F.col("key")
    rules = [
        (~F.is_valid_utf8(F.col("value").cast("binary").cast("string")), "the bytes are no UTF-8"),
        (k.isin("title", "creator", "source", "license") & blank, "a blank value"),
        ((k == "date") & (v != "") & ~(good_date | good_time), "neither a day nor a time with its zone"),
        ((k == "language") & (v != "") & ~F.length(lang).between(2, 3), "a language code has two or three letters"),
        ((k == "language") & (v != "") & F.length(lang).between(2, 3) & ~lang.rlike("^[a-z]+$"), "a language code has small letters"),
        ((k == "favicon_entry") & ~F.coalesce(number, F.lit(False)), "no entry's number"),
        ((k == "main_entry") & (~F.coalesce(number, F.lit(False)) if numeric_main_entry else blank), "no entry's number" if numeric_main_entry else "a blank value"),
    ]
    found = metadata.select("archive", "key", F.explode(F.array_compact(F.array(*[F.when(bad, text) for bad, text in rules]))).alias("message"))
    return missing_metadata(metadata, archives).select("archive", "key", F.lit("required but not there").alias("message")).unionByName(found)


def duplicate_keys(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("archive", "key").agg(F.count("*").alias("n")).filter("n > 1")


def verify_entries(entries: DataFrame, recorded: DataFrame) -> DataFrame:
    """archive, entry_id, expected, computed and ok of each entry, from sha2 of its content."""
    now = entries.select("archive", "entry_id", F.sha2("content", 256).alias("computed"))
    return now.join(recorded.select("archive", "entry_id", F.col("digest").alias("expected")), ["archive", "entry_id"], "left").withColumn("ok", F.coalesce(F.col("computed") == F.col("expected"), F.lit(False)))


def verify_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("tier", "ok").agg(F.count("*").alias("n"))


def trusted_signatures(signatures: DataFrame, trusted: list[str]) -> DataFrame:
    """The first record of each trusted public key (hex) in each archive; unknown keys are left out. signatures: the source's table of that name."""
    known = signatures.filter(F.lower("public_key").isin([k.lower() for k in trusted]))
    return known.groupBy("archive", "public_key").agg(F.min_by(F.struct("key_id", "valid"), "nth").alias("s")).select("archive", "public_key", "s.*")
