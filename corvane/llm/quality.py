"""Operator 1: quality scores by a regularised quadratic discriminant.

A document is reduced to transformed statistics of its whole text. Each class (label 0, label 1) gets a mean
and a covariance shrunk towards the pooled covariance and towards a multiple of the identity. The score is the
posterior probability of label 1 from the difference of Gaussian log densities, whose Mahalanobis terms come from
Cholesky factors made once.

The fit uses all labelled rows through their sufficient statistics, summed on the executors; the driver sees
2 (1 + d + d^2) numbers. Defined results: null text counts as empty, and an empty text has statistics and a
score like any other; labels that are null or not 0 or 1 are left out; a label row counts as often as it occurs;
lacking either class, the score is the share of label 1 (0.5 without labels); an empty table gives an empty
result; added columns replace columns of their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.batches import bound_batches
from corvane.llm.langid import fold
from corvane.session import cut, table

#: Weight of the pooled covariance, and of the scaled identity, in each class's covariance.
POOLED, RIDGE = 0.1, 0.01
#: Divides the difference of log densities: statistics of one text aren't independent, so its raw size overstates the evidence.
TEMPERATURE = 4.0
THRESHOLD = 0.3
_SYMBOLS, _PUNCTUATION, _DIGITS = re.compile(r"[#*$%&|<>{}\[\]=+~^_\\@]"), re.compile(r"[.,;:!?'\"()\-]"), re.compile(r"[0-9]")
NAMES = ("log_words", "log_lines", "word_mean", "word_sd", "symbols", "punctuation", "digits", "upper", "distinct", "top_word", "echo", "again", "line_again", "line_words", "stops", "long_words", "commas", "bangs", "symbol_words", "capital_words")


def _share(k: float, n: float) -> float:
    """A rate on a logit-like scale that is finite at 0 and 1 and steadier for longer texts."""
    return math.log((k + 0.5) / (max(n, k) - k + 0.5)) if n else math.log(0.5 / 1.5)


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, chars = len(words), max(1, len(text))
    sizes = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    counts = Counter(words)
    symbols, bangs = len(_SYMBOLS.findall(text)), text.count("!")
    windows = Counter(zip(words, words[1:], words[2:]))
    return [
        math.log1p(n),
        math.log1p(len(lines)),
        math.log1p(sizes.mean()),
        math.log1p(sizes.std()),
        math.log((symbols + 0.5) / chars),
        math.log((len(_PUNCTUATION.findall(text)) + 0.5) / chars),
        math.log((len(_DIGITS.findall(text)) + 0.5) / chars),
        _share(sum(map(str.isupper, words)), n),
        _share(len(counts), n) + 0.4 * math.log1p(n),
        _share(max(counts.values(), default=0), n),
        _share(sum(a == b for a, b in zip(words, words[1:])), n),
        _share(sum(c for c in windows.values() if c > 1), n),
        _share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / max(1, len(lines))),
        _share(sum(w[-1] in ".!?" for w in words), n),
        _share(int((sizes > 12).sum()), n),
        _share(text.count(","), n),
        math.log((bangs + 0.5) / (n + 1)),
        _share(sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words), n),
        _share(sum(w[0].isupper() for w in words), n),
    ]


def features(df: DataFrame, text: str = "text", out: str = "x") -> DataFrame:
    bound_batches(df.sparkSession)

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([np.array(statistics(t)) for t in s], dtype=object)

    return df.withColumn(out, run(F.col(text)))


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the inverse covariances and log densities' constants, on standardised statistics."""

    share: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple = ()
    whiten: tuple = ()  # inverse Cholesky factors
    offset: tuple = ()  # log prior less half the log determinant
    temperature: float = TEMPERATURE

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.centre is None:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        g = [o - 0.5 * np.square((z - m) @ w.T).sum(axis=1) for m, w, o in zip(self.means, self.whiten, self.offset)]
        return 1 / (1 + np.exp(np.clip((g[0] - g[1]) / self.temperature, -700, 700)))


def moments(df: DataFrame, label: str, x: str = "x", d: int = len(NAMES)) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products by label, over all rows."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for b in batches:
            for k, rows in b.groupby("y").x:
                m = np.stack(rows.to_numpy())
                total[k] += np.concatenate(([len(m)], m.sum(axis=0), (m.T @ m).ravel()))
        for k, v in total.items():
            if v[0]:
                yield pd.DataFrame({"y": [k], "v": [v]})

    rows = df.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), F.col(x).alias("x"))
    parts = rows.mapInPandas(part, "y int, v array<double>").select("y", F.posexplode("v").alias("i", "v"))
    out = {}
    for r in parts.groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r.y, np.zeros(1 + d + d * d))[r.i] = r.v
    return {k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in out.items()}


def fit(stats: dict, pooled: float = POOLED, ridge: float = RIDGE, temperature: float = TEMPERATURE) -> Discriminant:
    n = sum(v[0] for v in stats.values())
    if len(stats) < 2:
        return Discriminant(share=(stats[1][0] / n if 1 in stats else 0.0) if n else 0.5)
    d = len(stats[0][1])
    centre = sum(v[1] for v in stats.values()) / n
    spread = sum(v[2] for v in stats.values()) / n - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
    means, cov = [], []
    for k in (0, 1):
        c, s, q = stats[k]
        m = s / c
        means.append((m - centre) / scale)
        cov.append((q / c - np.outer(m, m)) / np.outer(scale, scale))
    common = sum(stats[k][0] * cov[k] for k in (0, 1)) / n
    whiten, offset = [], []
    for k in (0, 1):
        a = pooled + (1 - pooled) * d / (d + stats[k][0])  # few rows lean more on the pooled covariance
        c = (1 - a) * cov[k] + a * common
        c = (1 - ridge) * c + ridge * np.trace(c) / d * np.eye(d) + 1e-9 * np.eye(d)
        low = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(low))
        offset.append(math.log(stats[k][0] / n) - np.log(np.diag(low)).sum())
    return Discriminant(stats[1][0] / n, centre, scale, tuple(means), tuple(whiten), tuple(offset), temperature)


def score(df: DataFrame, model: Discriminant, x: str = "x", out: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(s.to_numpy())) if len(s) else [], dtype="float64")

    return df.withColumn(out, run(F.col(x)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    x = cut(features(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")).drop("text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(moments(x.filter(~F.col("held_out")).join(labels, "doc_id"), "quality"))
    scored = score(x, model).select("doc_id", "held_out", "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
