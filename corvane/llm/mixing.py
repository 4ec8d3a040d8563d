"""Operator 7: mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source expects the same number of copies, target over source size. Documents are put in
a fixed order, their expected copies are summed up along it, one random offset a source is added, and a
document is emitted once for each integer that its stretch of the sum crosses. The order goes by size class first,
so each class gets its share of copies and the words taken stay near the target even with a few very long documents.

The running sum is a rank times the expected copies. Ranks come in two levels, so no task sees a whole source:
rows are ranked within (source, size class, hash bin), and bins' counts are summed up along each source.
A source has at most 8 x 63 x 4096 bins, however many rows it holds.

Defined results: null text has size 0; null is a source of its own, after all others; sources without words have
target 0; documents without words may be emitted but take no words; repeated rows are drawn each; an
empty table gives an empty result; added columns replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.batches import beside
from corvane.llm.rules import WORD
from corvane.session import cut, table

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2, 7
_ADDED = ("size", "source_size", "target", "copies", "taken")
_KEYS = ("__source", "__class", "__bin")


def sized(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Adds size and what orders the rows: source key, size class (eight to an octave), hash of the id and the text (so rows without an id spread too), hash bin."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in _ADDED]
    out = df.select(*rest, size.alias("size"), F.coalesce(F.concat(F.lit("v"), F.col(source).cast("string")), F.lit("~null")).alias("__source"), F.conv(F.substring(F.md5(F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary")), 1, 15), 16, 10).cast("long").alias("__hash"))
    return out.withColumns({"__class": F.expr("length(bin(size)) * 8 + shiftright(size * 8, length(bin(size)) - 1) - 8"), "__bin": F.shiftright("__hash", 48)})


def targets(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """A row for each source: source_size, target, expected copies and offset. The level at which the weights fill the sources up to their caps is found in one pass over the sources, ordered by the level at which each is full."""
    # "~null" sorts after "v..." by code point
    one = Window.orderBy("__source")
    by = rows.groupBy("__source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("__w", weight.cast("long")).withColumn("__full", (cap * F.col("source_size")).cast("double") / F.col("__w"))
    before = Window.orderBy("__full", "__source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    by = by.withColumn("__left", F.lit(share) * F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)).cast("double"))
    by = by.withColumn("__level", F.col("__left") / (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0))).cast("double"))
    by = by.withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__full"), F.struct("__full", "__source", "__level"))).over(everything)["__level"])
    by = by.withColumn("target", F.least((cap * F.col("source_size")).cast("double"), F.coalesce("__level", F.lit(0.0)) * F.col("__w")))
    each = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"offset {seed} "), F.col("__source")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return by.select("__source", "source_size", "target", each.alias("__each"), offset.alias("__offset"))


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: bool = False, **options) -> DataFrame:
    """Adds size, source_size, target, copies and taken. keep: rows are narrow and cheap to keep; their sizes are counted once and checkpointed."""
    rows = sized(df, text, source, doc_id)
    if keep:
        rows = cut(rows.drop(text))
    along = Window.partitionBy("__source").orderBy("__class", "__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*_KEYS).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(along), F.lit(0))).drop("__n")
    bins = bins.join(targets(rows, **options), "__source")
    within = Window.partitionBy(*_KEYS).orderBy("__hash", "size", doc_id)
    out = rows.withColumn("__rank", F.row_number().over(within)).join(bins, list(_KEYS))
    rank = F.col("__before") + F.col("__rank")
    crossed = F.floor(F.col("__offset") + rank * F.col("__each")) - F.floor(F.col("__offset") + (rank - 1) * F.col("__each"))
    out = out.withColumn("copies", F.least(F.lit(options.get("cap", CAP)), F.greatest(F.lit(0), crossed)).cast("int"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop(*_KEYS, "__hash", "__rank", "__before", "__each", "__offset")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: each document as often as the mix takes it, with its own columns."""
    return beside(docs, _ADDED, lambda d: mix(d).filter("copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1, copies)"))))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, keep=True).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH r AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('v' || source, '~null') AS s, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
k AS (SELECT *, length(bin(size)) * 8 + ((size * 8) >> (length(bin(size)) - 1)::INT) - 8 AS c, h >> 48 AS b FROM r),
w AS (
  SELECT s, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY s) - 1) % 3 + 1]::BIGINT AS w
  FROM r GROUP BY s),
f AS (SELECT *, (2 * source_size)::DOUBLE / w AS f FROM w),
p AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM w)::DOUBLE - coalesce(sum(2 * source_size) OVER q, 0)::DOUBLE)
            / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER q, 0))::DOUBLE AS l
  FROM f WINDOW q AS (ORDER BY f, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT s, source_size, least((2 * source_size)::DOUBLE, coalesce((SELECT l FROM p WHERE l <= f ORDER BY f, s LIMIT 1), 0) * w) AS target,
         ('0x' || substr(md5('offset 7 ' || s), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS o FROM p),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(2::DOUBLE, target / source_size) ELSE 0 END AS e FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY c, b, h, size, doc_id) AS n FROM k)
SELECT doc_id, size, source_size, target,
       least(2, greatest(0, floor(o + n * e) - floor(o + (n - 1) * e)))::BIGINT * size AS taken
FROM n JOIN e USING (s)
"""
