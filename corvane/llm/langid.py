"""Operator 2: language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent 1- to 3-grams of letters (words joined by single
blanks, lower case). A document's own list is compared with each profile by the out-of-place distance: the sum over its
n-grams of the difference of ranks, or a fixed penalty where the profile lacks the n-gram.

Defined results: null text, or one without a letter, is ``und`` with score 0; ties of frequency break by the
n-gram's code points, ties of distance by the language's name; repeated rows get equal rows; an empty table
gives an empty result, and without training rows every document is ``und``; columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.batches import beside, bound_batches
from corvane.session import table

#: Length of a language's profile, and of a document's.
PROFILE, DOC_PROFILE = 1000, 300
UNKNOWN = "und"
#: The pipeline keeps documents that score at least this (0: the distance that a document without any known n-gram has).
MIN_SCORE = 0.15
_BITS = 21  # a code point; three of them make a key


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters_of(text: str) -> np.ndarray:
    """Code points in lower case with one 0 for each run of anything but letters, and 0 at both ends; empty if no letter is left."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(_letters()[cp], cp, 0).astype(np.int64)
    if not cp.any():
        return cp[:0]
    cp = np.concatenate(([0], cp, [0]))
    return cp[np.append(True, (cp[1:] != 0) | (cp[:-1] != 0))]


def grams(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 1- to 3-grams in a result of letters_of, ascending, and how often each occurs. A gram has no blank inside and isn't one blank."""
    alphabet = np.unique(cp)
    dense = np.searchsorted(alphabet, cp)
    n, size = len(cp), len(alphabet)
    keys, counts = [], []
    for k in (1, 2, 3):
        if n < k:
            break
        code = dense[: n - k + 1].copy()
        for j in range(1, k):
            code = code * size + dense[j : n - k + 1 + j]
        if size**k <= 8 * n + 4096:  # counted in a table, else by sorting
            c = np.bincount(code, minlength=size**k)
            u = np.flatnonzero(c)
            c = c[u]
        else:
            u, c = np.unique(code, return_counts=True)
        parts = [alphabet[u // size ** (k - 1 - j) % size] for j in range(k)]
        ok = parts[0] != 0 if k == 1 else (parts[1] != 0 if k == 3 else (parts[0] != 0) | (parts[1] != 0))
        key = np.zeros(len(u), np.int64)
        for p in parts:
            key = key << _BITS | p
        keys.append(key[ok])
        counts.append(c[ok])
    # a blank is code point 0, so keys of different lengths could meet: " a" and "a" are told apart by the length in the top bit pair
    key = np.concatenate(keys)
    tag = np.repeat(np.arange(len(keys), dtype=np.int64), [len(x) for x in keys])
    return key * 3 + tag, np.concatenate(counts)


def ranked(cp: np.ndarray, most: int) -> np.ndarray:
    """Keys of the most frequent n-grams, the most frequent first."""
    key, count = grams(cp)
    return key[np.lexsort((key, -count))][:most]


def gram_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, n over all texts; counted within each batch before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, texts in b.groupby("lang").text:
                joined, size, found = [], 0, []
                for t in texts:
                    joined.append(t)
                    size += len(t)
                    if size > 1 << 21:
                        found.append(letters_of("\n".join(joined)))
                        joined, size = [], 0
                found.append(letters_of("\n".join(joined)))
                total: dict[int, int] = {}
                for cp in found:
                    if len(cp):
                        for k, c in zip(*(x.tolist() for x in grams(cp))):
                            total[k] = total.get(k, 0) + c
                yield pd.DataFrame({"lang": name, "gram": np.fromiter(total.keys(), np.int64, len(total)), "n": np.fromiter(total.values(), np.int64, len(total))})

    bound_batches(df.sparkSession)
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    return rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's profile. It holds ``profile`` keys a language, however large the corpus."""
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(df, text, lang).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= profile)
    rows = top.orderBy("lang", "rank").collect()
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64) for k, v in out.items()}


class Profiles:
    """All profiles as one sorted list of keys with a row of ranks for each language."""

    def __init__(self, profiles: dict[str, np.ndarray], penalty: int = PROFILE):
        self.names = sorted(profiles)
        self.penalty = penalty
        self.keys = np.unique(np.concatenate([profiles[k] for k in self.names])) if self.names else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.names), len(self.keys) + 1), -1, np.int64)
        for row, k in zip(self.ranks, self.names):
            row[np.searchsorted(self.keys, profiles[k])] = np.arange(len(profiles[k]))

    def predict(self, text: str | None, most: int = DOC_PROFILE) -> tuple[str, float]:
        cp = letters_of(text) if text else np.zeros(0, np.int64)
        if not len(cp) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(cp, most)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        at[self.keys[at] != own] = len(self.keys)
        r = self.ranks[:, at]
        d = np.where(r < 0, self.penalty, np.minimum(np.abs(r - np.arange(len(own))), self.penalty)).sum(axis=1)
        best = int(d.argmin())
        return self.names[best], float(1 - d[best] / (self.penalty * len(own)))


def identify(df: DataFrame, profiles: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Adds lang_pred and score, without a shuffle."""

    bound_batches(df.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Profiles(profiles)
        for s in batches:
            yield pd.DataFrame([model.predict(t) for t in s], columns=["lang_pred", "score"])

    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")]
    out = df.select(*rest, run(F.col(text)).alias("__made"))
    return out.select(*rest, "__made.lang_pred", "__made.score")


def fold(column: str, folds: int):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(-1))


def learn_documents(docs: DataFrame) -> dict[str, np.ndarray]:
    return learn(docs.filter(fold("doc_id", 3) != 1))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn_documents(docs)
    held = docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    return identify(held, profiles).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: profiles from the documents' own labels; those without a language, or too far from every profile, go. The others leave with their own columns."""
    profiles = learn_documents(docs)
    return beside(docs, ("lang_pred", "score"), lambda d: identify(d, profiles).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)))
