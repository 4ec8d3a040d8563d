"""Two-tier trigram search over titles and bodies, through stored postings or by a scan."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.columns import fold
from corvane.session import cut

INDEXES = ("title", "body")
#: Where grams are to be pruned: those that at least so many of an index's documents hold, and this share of them.
PRUNE_SHARE, PRUNE_LEAST = 0.5, 1000
_BLOCKS, _PRUNED = "archive string, idx string, gram int, ids array<long>", "archive string, idx string, gram int, df long"
#: Bytes of content whose grams a task holds at once.
_SLICE = 8 << 20


def is_markup() -> Column:
    return F.col("mime_type").contains("html")


def plain_text() -> Column:
    """Content with markup off. Only pages are sent to the function: others are null there, as a UDF under a condition would run on every row."""
    return F.coalesce(T.visible_text_udf(F.when(is_markup(), F.col("content"))), F.when(~is_markup(), F.col("content")))


def _front(entries: DataFrame, indexes: tuple[str, ...]) -> DataFrame:
    """Front articles with what is indexed: the title, and for bodies the title with the path, and the content."""
    body = "body" in indexes
    content = F.col("content") if body else F.lit(None).cast("string")
    head = F.concat_ws(" ", "title", "path") if body else F.lit(None).cast("string")
    return entries.filter("is_front").select("archive", "entry_id", "title", head.alias("head"), content.alias("content"), is_markup().alias("markup"))


def _grams(b: pd.DataFrame, indexes: tuple[str, ...]) -> Iterator[tuple[str, list]]:
    """For each index, each row's distinct grams."""
    import numpy as np

    none = np.zeros(0, np.int32)
    if "title" in indexes:
        yield "title", [T.grams(t) if t else none for t in b["title"]]
    if "body" in indexes:
        out = []
        for head, content, markup in zip(b["head"], b["content"], b["markup"]):
            body = "" if content is None else T.visible_text(content) if markup else content
            out.append(np.union1d(T.grams(head or ""), T.grams(body)))
        yield "body", out


def _slices(b: pa.RecordBatch) -> Iterator[pd.DataFrame]:
    """A batch's rows, an archive at a time and at most so many bytes of content at once, so a task's memory doesn't grow with its batches."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(b.column("content")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    part = size // _SLICE
    for at in np.unique(part):
        first, past = np.searchsorted(part, at), np.searchsorted(part, at, "right")
        for _, rows in b.slice(first, past - first).to_pandas().groupby("archive", dropna=False, sort=False):
            yield rows


def blocks(entries: DataFrame, indexes: tuple[str, ...] = INDEXES) -> DataFrame:
    """archive, idx, gram and the ids of entries that hold it, a list for each slice of a task's rows. An entry's texts are parsed and its grams made distinct in its task, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for rows in _slices(b):
                archive, entry = rows.archive.iloc[0], rows.entry_id.to_numpy()
                for idx, g in _grams(rows, indexes):
                    gram = np.concatenate(g)
                    order = np.argsort(gram, kind="stable")
                    gram, first = np.unique(gram[order], return_index=True)
                    ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(np.repeat(entry, [len(x) for x in g])[order]))
                    names = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(gram), np.int32))) for x in (archive, idx)]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(gram.astype(np.int32)), ids], ["archive", "idx", "gram", "ids"])

    return _front(entries, indexes).mapInArrow(run, _BLOCKS)


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("archive", "idx", "gram", F.explode("ids").alias("entry_id"))


def postings(entries: DataFrame, indexes: tuple[str, ...] = INDEXES) -> DataFrame:
    """archive, idx, gram and entry_id, each once."""
    return _flat(blocks(entries, indexes))


def frequencies(entries: DataFrame, indexes: tuple[str, ...] = INDEXES, by_archive: bool = False) -> DataFrame:
    """idx (archive too, if asked for), gram and df, the number of entries that hold it. Counted batch by batch before anything leaves the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            for archive, rows in b.groupby("archive", dropna=False) if by_archive else [("", b)]:
                for idx, g in _grams(rows, indexes):
                    gram, n = np.unique(np.concatenate(g) if g else np.zeros(0, np.int32), return_counts=True)
                    yield pd.DataFrame({"archive": archive, "idx": idx, "gram": gram, "n": n})

    keys = (["archive"] if by_archive else []) + ["idx", "gram"]
    return _front(entries, indexes).mapInPandas(run, "archive string, idx string, gram int, n long").groupBy(*keys).agg(F.sum("n").alias("df"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("idx", "gram").agg(F.count("*").alias("df"))


def _too_frequent(df: DataFrame, docs: DataFrame, share: float, least: int) -> DataFrame:
    return df.join(docs, ["archive", "idx"]).filter((F.col("df") >= least) & (F.col("df") >= share * F.col("docs"))).select("archive", "idx", "gram", "df")


def pruned_grams(posts: DataFrame, share: float = PRUNE_SHARE, least: int = PRUNE_LEAST) -> DataFrame:
    """archive, idx, gram and df of grams in so many of an archive's entries that they tell little: at least ``least``, and ``share`` of the index."""
    docs = posts.select("archive", "idx", "entry_id").distinct().groupBy("archive", "idx").agg(F.count("*").alias("docs"))
    return _too_frequent(posts.groupBy("archive", "idx", "gram").agg(F.count("*").alias("df")), docs, share, least)


def write_index(entries: DataFrame, path: str, share: float = PRUNE_SHARE, least: int | None = None) -> None:
    """Stores postings under path: Parquet by index, lists of ids clustered by gram, so a lookup reads the row groups of its grams alone.

    All postings are stored, whatever the size. With ``least``, grams in at least so many of an archive's entries and that share of them are left out and recorded, and lookups don't count them:
    a smaller index, which finds more than the query's entries, and none for queries of such grams alone.
    """
    spark = entries.sparkSession
    kept = cut(blocks(entries))  # read twice: for the ranges and to be sorted
    gone = spark.createDataFrame([], _PRUNED)
    if least is not None:
        docs = entries.filter("is_front").groupBy("archive").agg(F.count("*").alias("docs")).withColumn("idx", F.explode(F.array(*map(F.lit, INDEXES))))
        gone = _too_frequent(kept.groupBy("archive", "idx", "gram").agg(F.sum(F.size("ids")).alias("df")), docs, share, least)
    gone.write.mode("overwrite").parquet(f"{path}/pruned")
    if least is not None:
        kept = kept.join(spark.read.schema(_PRUNED).parquet(f"{path}/pruned"), ["archive", "idx", "gram"], "left_anti")  # a few thousand grams an archive at most
    # the first id spreads a gram that most entries hold
    kept = kept.withColumn("first", F.col("ids")[0])
    kept.repartitionByRange("idx", "gram", "archive", "first").sortWithinPartitions("idx", "gram", "archive", "first").drop("first").write.mode("overwrite").partitionBy("idx").parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings and pruned grams."""
    return _flat(spark.read.schema(_BLOCKS).parquet(f"{path}/postings")), spark.read.schema(_PRUNED).parquet(f"{path}/pruned")


def query_grams(query: str) -> list[int]:
    """Grams of a query in any script, as entries' texts have them; none for queries shorter than three bytes."""
    return [] if len(query.encode()) < 3 else T.grams(query).tolist()


def lookup(posts: DataFrame, query: str, pruned: DataFrame | None = None) -> DataFrame:
    """archive, idx and entry_id of the entries that hold every gram of the query; an archive's pruned grams don't count, unless there are no others."""
    wanted = query_grams(query)
    if not wanted:
        return posts.select("archive", "idx", "entry_id").limit(0)
    hits = posts.filter(F.col("gram").isin(wanted))
    need = F.lit(len(wanted))
    if pruned is not None:
        known = pruned.filter(F.col("gram").isin(wanted)).select("archive", "idx", "gram")
        hits = hits.join(known, ["archive", "idx", "gram"], "left_anti")
        hits = hits.join(known.groupBy("archive", "idx").agg(F.count("*").alias("__off")), ["archive", "idx"], "left")
        need = need - F.coalesce("__off", F.lit(0))
    hits = hits.withColumn("__need", need)
    return hits.groupBy("archive", "idx", "entry_id").agg(F.count("*").alias("n"), F.max("__need").alias("need")).filter("n = need AND need > 0").select("archive", "idx", "entry_id")


def tiers(found: DataFrame) -> DataFrame:
    """archive, entry_id, title_match and body_match from a lookup's rows."""
    return found.groupBy("archive", "entry_id").agg(F.max(F.col("idx") == "title").alias("title_match"), F.max(F.col("idx") == "body").alias("body_match"))


def _order(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy(F.desc("title_match"), "archive", "entry_id").limit(limit)


def search_index(posts: DataFrame, query: str, limit: int | None = 20, titles_only: bool = False, pruned: DataFrame | None = None) -> DataFrame:
    """Hits through postings, for queries in any script: title matches before others, then by archive and id. limit None: all, in no order."""
    rows = posts.filter("idx = 'title'") if titles_only else posts
    hits = tiers(lookup(rows, query, pruned))
    return hits if limit is None else _order(hits, limit)


def _windows(c: Column, query: str, verify: bool) -> Column:
    """Whether a text has all the query's three-byte windows (verify: the query as a whole). Exact but for the windows between two CJK characters, which a text may have by chance."""
    low = query.translate({i: i + 32 for i in range(65, 91)})
    if verify:
        return fold(c).contains(low)
    if low.isascii():
        return reduce(lambda a, b: a & b, [fold(c).contains(p) for p in dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2))])
    raw = fold(c).cast("binary")
    return reduce(lambda a, b: a & b, [F.contains(raw, F.lit(g.to_bytes(3, "big"))) for g in query_grams(query)])


def _exact(query: str):
    """UDF: whether a text has all the query's grams."""
    wanted = frozenset(query_grams(query))

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t is not None and wanted <= set(T.grams(t).tolist()))

    return run


def scan(entries: DataFrame, query: str, verify: bool = False) -> DataFrame:
    """archive, entry_id, title_match and body_match without an index: one pass over the texts, in which each page is parsed once. verify: the whole query must occur, not just its grams."""
    front = entries.filter("is_front")
    if not query_grams(query):
        return front.select("archive", "entry_id", F.lit(True).alias("title_match"), F.lit(True).alias("body_match")).limit(0)
    holds = lambda c: F.coalesce(_windows(F.col(c), query, verify), F.lit(False))
    # the filter isn't pushed below the parsing, as it would repeat it
    page = T.visible_text_once(F.when(is_markup(), F.col("content")))
    texts = front.select("archive", "entry_id", "title", F.concat_ws(" ", "title", "path").alias("head"), F.coalesce(page, F.when(~is_markup(), F.col("content"))).alias("body"))
    if verify or not any(T.is_cjk(c) for c in query):
        rows = texts.select("archive", "entry_id", holds("title").alias("title_match"), (holds("head") | holds("body")).alias("body_match"))
    else:
        # the few texts with all windows are looked at gram by gram
        near = texts.filter(holds("title") | holds("head") | holds("body"))
        has = _exact(query)
        rows = near.select("archive", "entry_id", has("title").alias("title_match"), has("head").alias("a"), has("body").alias("b")).select("archive", "entry_id", "title_match", (F.col("a") | F.col("b")).alias("body_match"))
    return rows.filter("title_match OR body_match")


def search(entries: DataFrame, query: str, limit: int = 20, titles_only: bool = False, verify: bool = False) -> DataFrame:
    """The first hits by a scan: title matches before others, then by archive and id."""
    if titles_only:
        entries = entries.withColumns({"content": F.lit(""), "mime_type": F.lit("")})
    hits = scan(entries, query, verify)
    if titles_only:
        hits = hits.filter("title_match").withColumn("body_match", F.lit(False))
    return _order(hits, limit)


def federated(entries: DataFrame, query: str, limit: int = 20, per_archive: int | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Hits over all archives, in archive order; per_archive: at most so many of each; index: postings and pruned grams to look up instead of scanning."""
    hits = scan(entries, query) if index is None else search_index(index[0], query, None, pruned=index[1])
    if per_archive:
        by = Window.partitionBy("archive").orderBy(F.desc("title_match"), "entry_id")
        hits = hits.withColumn("__n", F.row_number().over(by)).filter(F.col("__n") <= per_archive).drop("__n")
    return hits.orderBy("archive", F.desc("title_match"), "entry_id").limit(limit)


def with_snippets(hits: DataFrame, entries: DataFrame, query: str, most: int = 200) -> DataFrame:
    """Adds path, title and a snippet of the content's first 4,096 bytes; content is read for the hits alone."""
    size = min(max(1, most), 500)
    rows = entries.join(hits, ["archive", "entry_id"])
    begin = F.try_validate_utf8(F.substring(F.col("content").cast("binary"), 1, 4096).cast("string"))
    begin = F.coalesce(begin, F.substring("content", 1, 1024))  # cut within a character: at most four bytes each
    plain = F.coalesce(T.strip_html_udf(F.when(is_markup(), begin)), F.when(~is_markup(), begin))
    return rows.select(*hits.columns, "path", "title", T.snippet_udf(query, size)(plain).alias("snippet"))
