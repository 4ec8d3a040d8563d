"""Operator 5: exact top-k inner products by pivot-table elimination.

Vectors are scaled to integers. For each vector the distances to many pivots are computed once. For a query q and a
candidate v the triangle inequality gives |q - v| >= max over pivots p of | |q - p| - |v - p| |, so the inner
product (|q|^2 + |v|^2 - |q - v|^2) / 2 has an upper bound. Candidates are evaluated in the order of their bounds and
the search stops when the next bound lies below the k-th score so far: nothing beyond can enter the result, so it is exact.

Candidates and queries are packed into blocks of BLOCK and QUERIES rows; each query block meets each
candidate block once, through a join on the block's number, and gives at most k rows a query. A task keeps the k-th scores of the
query blocks it has seen, so a later block starts with a threshold. The pivots, a bounded sample, are
the only thing sent to all executors.

Defined results: vectors that are null, or hold null or non-finite components, take no part; shorter vectors, empty ones too,
count as padded with zeros; ties go to the smaller id; every row is a vector of its own, so rows that repeat a query's id are
candidates for it, equal rows are found as often as they occur, and each query row has ranks of its own; fewer than k candidates give fewer rows; an empty
table gives an empty result; vectors may be of any length that a row holds; further columns are ignored. Scores are exact while they stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.session import cut, table

#: Pivots are picked, each the farthest from those before, out of at most PIVOT_SAMPLE vectors.
PIVOTS, PIVOT_SAMPLE = 48, 2000
BLOCK, QUERIES = 4096, 512
#: Query blocks whose thresholds a task keeps.
THRESHOLDS = 4096
K = 5


def scaled(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """row (a number of its own), id and v, the vectors that take part, as whole numbers."""
    v = F.col(embedding).cast("array<double>")
    fine = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(fine).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Farthest-first from the vectors with the smallest hashes, a sample that any order of the rows gives."""
    picked = [r.v for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).collect()]
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    m = np.zeros((len(picked), width))
    for row, v in zip(m, picked):
        row[: len(v)] = v
    if not len(m):
        return m
    chosen = [0]
    far = np.square(m - m[0]).sum(axis=1)
    while len(chosen) < min(pivots, len(m)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.square(m - m[chosen[-1]]).sum(axis=1))
    return m[chosen]


def _blocks(rows: DataFrame, pivots: np.ndarray, size: int, count: int) -> DataFrame:
    """block, rows' numbers, ids, vectors and distances to the pivots, as bytes; blocks of at most size rows. A task holds one block at a time."""
    blocks = max(1, -(-count // size))
    width = pivots.shape[1]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        at = -1

        def give():
            m = np.zeros((len(held), width))
            for row, (*_, v) in zip(m, held):
                row[: len(v)] = v
            d = np.sqrt(np.maximum(0, np.square(m).sum(1)[:, None] + np.square(pivots).sum(1) - 2 * m @ pivots.T))
            numbers, ids = (np.array(x, np.int64).tobytes() for x in list(zip(*held))[:2])
            return pd.DataFrame({"block": [at], "rows": [numbers], "ids": [ids], "m": [m.tobytes()], "d": [d.astype(np.float32).tobytes()]})

        for batch in batches:
            for b, *row in zip(batch.block.tolist(), batch.row.tolist(), batch.id.tolist(), batch.v):
                if held and (b != at or len(held) >= size):
                    yield give()
                    held = []
                at = b
                held.append(tuple(row))
        if held:
            yield give()

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    packed = keyed.repartition(min(blocks, 4096), "block").sortWithinPartitions("block")
    return packed.mapInPandas(pack, "block int, rows binary, ids binary, m binary, d binary")


def search_block(q, dq, rows, ids, m, d, k: int, own: np.ndarray, floor: np.ndarray | None = None, evaluated: list | None = None):
    """Best k of one candidate block for each query, in order: (row of query, id, score). own: the queries' rows. floor: k-th scores so far, raised where the block has k better ones; what lies below isn't given."""
    sizes = np.square(m).sum(axis=1)
    for r in range(len(q)):
        least = -np.inf if floor is None else floor[r]
        gap = np.abs(d - dq[r]).max(axis=1).astype(np.float64) if d.shape[1] else np.zeros(len(m))
        gap = np.maximum(0, gap * (1 - 1e-6) - 1e-3)  # distances are kept as float32; rounding mustn't tighten a bound
        bound = (q[r] @ q[r] + sizes - gap * gap) / 2
        order = np.flatnonzero(bound >= least - 1e-6)
        order = order[np.argsort(-bound[order], kind="stable")]
        best: list[tuple[float, int]] = []
        step, at = 64, 0
        while at < len(order):
            if bound[order[at]] < least - 1e-6:
                break
            part = order[at : at + step]
            at += step
            step = min(2 * step, 2048)
            score = m[part] @ q[r]
            ok = (score >= least) & (rows[part] != own[r])
            best = sorted(best + list(zip((-score[ok]).tolist(), ids[part[ok]].tolist())))[:k]
            if len(best) == k:
                least = max(least, -best[-1][0])
        if floor is not None:
            floor[r] = least
        if evaluated is not None:
            evaluated.append(at)
        for s, i in best:
            yield r, i, -s


def top_k(df: DataFrame, queries, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best among all other rows. queries: a condition on the column id."""
    rows = cut(scaled(df, vec_id, embedding, scale))
    n = rows.count()
    asked = rows.filter(queries)
    n_asked = asked.count()
    if not n_asked:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = choose_pivots(rows)
    width, n_pivots = pivots.shape[1], len(pivots)
    blocks = max(1, -(-n // block))
    parts = min(blocks, 4096)
    right = _blocks(rows, pivots, block, n).repartition(parts, "block")
    left = _blocks(asked, pivots, QUERIES, n_asked).select(F.struct("block", F.length("rows"), F.xxhash64("rows")).cast("string").alias("name"), "rows", "ids", "m", "d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = left.select("block", *[F.col(c).alias(f"q_{c}") for c in ("name", "rows", "ids", "m", "d")]).repartition(parts, "block").join(right, "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors: dict[str, np.ndarray] = {}
        for b in batches:
            for r in b.itertuples():
                own, asked_ids = np.frombuffer(r.q_rows, np.int64), np.frombuffer(r.q_ids, np.int64)
                rows, ids = np.frombuffer(r.rows, np.int64), np.frombuffer(r.ids, np.int64)
                q, m = np.frombuffer(r.q_m).reshape(len(own), width), np.frombuffer(r.m).reshape(len(ids), width)
                dq, d = np.frombuffer(r.q_d, np.float32).reshape(-1, n_pivots), np.frombuffer(r.d, np.float32).reshape(-1, n_pivots)
                if r.q_name not in floors and len(floors) >= THRESHOLDS:
                    floors.pop(next(iter(floors)))  # it only starts anew
                floor = floors.setdefault(r.q_name, np.full(len(own), -np.inf))
                found = list(search_block(q, dq, rows, ids, m, d, k, own, floor))
                at = [x for x, _, _ in found]
                yield pd.DataFrame({"row": own[at], "query_id": asked_ids[at], "vec_id": [i for _, i, _ in found], "score": [int(s) for *_, s in found]}, columns=["row", "query_id", "vec_id", "score"])

    found = pairs.mapInPandas(search, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "id % 50 = 0")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
