"""Operator 4: byte-level BPE encoding and decoding by prefix dynamic programming.

BPE leaves every prefix of a piece with exactly one last token: the longest token that ends the prefix
and is *compatible* with the last token of what precedes it (merging the two tokens' bytes by rank gives
the two tokens back). Storing that last token for each prefix gives the encoding in linear time, makes
appending exact (old entries never change), and confines an edit to the pieces near it.

Nulls and empty texts have no tokens; other columns are carried along untouched; repeated rows stay, each with its own result.
Names of added columns replace columns of that name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.batches import bound_batches
from corvane.llm.pretok import split_bytes
from corvane.session import table


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary:
    """Token bytes by rank, the pair each token was merged from, and the pairs' merges."""

    TAIL = 4

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.tokens[r] = b
        # lengths of the tokens that end in TAIL bytes, the longest first, and then of those that are shorter
        short, tails = tuple(range(self.TAIL - 1, 0, -1)), {}
        for b in ranks:
            if len(b) >= self.TAIL:
                tails.setdefault(b[-self.TAIL :], set()).add(len(b))
        self.short = short
        self.lengths = {tail: (*sorted(n, reverse=True), *short) for tail, n in tails.items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(len(self.tokens))]
        self._fits: dict[tuple[int, int], bool] = {}
        for r, b in enumerate(self.tokens):
            for k in range(1, len(b)):
                left, right = ranks.get(b[:k]), ranks.get(b[k:])
                if left is not None and right is not None and left < r and right < r and self._compatible(left, right, r):
                    self.merge[left, right] = r
                    self.split[r] = (left, right)
                    break
            else:
                if len(b) > 1:
                    raise ValueError(f"rank {r} can't be made from lower ranks")

    def _compatible(self, a: int, b: int, below: int = 1 << 62) -> bool:
        """True if merging by rank keeps a and b apart. Undoes their merges from the highest, and looks for a merge across the border that comes sooner."""
        limit, merge, split = below, self.merge, self.split
        while True:
            m = merge.get((a, b))
            if m is not None and m < limit:
                return False
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:  # a single byte can't be undone; go on with b
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True

    def fits(self, a: int, b: int) -> bool:
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 200_000:
                self._fits.clear()
            known = self._fits[a, b] = self._compatible(a, b)
        return known

    def extend(self, last: list[int], piece: bytes) -> list[int]:
        """Fills in the last token of each prefix of piece beyond the prefixes in last (last[i]: of the first i + 1 bytes)."""
        ranks, fits, lengths, short, tail = self.ranks.get, self._fits, self.lengths.get, self.short, self.TAIL
        for end in range(len(last) + 1, len(piece) + 1):
            for n in lengths(piece[end - tail : end], short) if end >= tail else short:
                begin = end - n
                if begin < 0:
                    continue
                token = ranks(piece[begin:end])
                if token is not None:
                    if begin == 0:
                        break
                    pair = (last[begin - 1], token)
                    ok = fits.get(pair)
                    if self.fits(*pair) if ok is None else ok:
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
        return last

    def trace(self, last: list[int]) -> list[int]:
        """The tokens of the whole prefix, read backwards from its end."""
        out, end = [], len(last)
        while end:
            out.append(token := last[end - 1])
            end -= len(self.tokens[token])
        out.reverse()
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        return [token] if token is not None else self.trace(self.extend([], piece))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class PieceCache(dict):
    """Packed ids of pieces already met; emptied when full, so its memory is bounded."""

    def __init__(self, make: Callable[[bytes], bytes], most: int = 250_000):
        super().__init__()
        self._make, self._most = make, most

    def __missing__(self, piece: bytes) -> bytes:
        packed = self._make(piece)
        if len(piece) <= 64:
            if len(self) >= self._most:
                self.clear()
            self[piece] = packed
        return packed


def pack(ids) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


@cache
def prefix_cache(path: str) -> PieceCache:
    v = load(path)
    return PieceCache(lambda piece: pack(v.encode_piece(piece)))


def encode_packed(texts: list[str], known: PieceCache) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    get = known.__getitem__
    for pieces in split_bytes(texts):
        yield b"".join(map(get, pieces))


class EncodedText:
    """A text with its prefix tables: appends and edits re-encode only the pieces that can change."""

    #: A piece depends on no more than this many characters beyond its end (the contraction 're after a lone apostrophe).
    LOOKAHEAD = 3

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self._v, self.text = vocabulary, ""
        self._pieces: list[tuple[str, list[int]]] = []  # characters and last token by prefix
        self.reencoded = 0
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end] by new."""
        text = self.text[:start] + new + self.text[end:]
        keep, at = 0, 0
        while keep < len(self._pieces) and at + len(self._pieces[keep][0]) + self.LOOKAHEAD <= start:
            at += len(self._pieces[keep][0])
            keep += 1
        shift = len(text) - len(self.text)
        borders, pos = {}, at  # where old pieces begin, in the new text, after the edit
        for k in range(keep, len(self._pieces)):
            if pos >= end:
                borders[pos + shift] = k
            pos += len(self._pieces[k][0])
        fresh, tail, pos = [], [], at
        old = self._pieces[keep] if keep < len(self._pieces) else ("", [])
        for raw in next(split_bytes([text[at:]])) if text[at:] else []:
            if pos in borders:
                tail = self._pieces[borders[pos] :]
                break
            piece = raw.decode()
            same = 0
            if not fresh:  # the prefixes shared with the old piece here keep their entries
                while same < min(len(piece), len(old[0])) and piece[same] == old[0][same]:
                    same += 1
            begun = old[1][: len(piece[:same].encode())] if same else []
            self.reencoded += len(raw) - len(begun)
            fresh.append((piece, self._v.extend(list(begun), raw)))
            pos += len(piece)
        self._pieces[keep:] = fresh + tail
        self.text = text

    def ids(self) -> list[int]:
        return [t for _, last in self._pieces for t in self._v.trace(last)]


def encode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds ids array<int>."""
    path = path or rank_file()
    bound_batches(df.sparkSession)
    import numpy as np

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = prefix_cache(path)
        for s in batches:
            yield pd.Series([np.frombuffer(b, np.int32) for b in encode_packed(["" if t is None else t for t in s], known)], dtype=object)

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """Adds the decoded bytes; null ids: none."""
    path = path or rank_file()
    bound_batches(df.sparkSession)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = load(path)
        for s in batches:
            yield pd.Series([b"" if x is None else v.decode(x.tolist()) for x in s], dtype=object)

    return df.withColumn(out, run(F.col(ids)))


def digests(texts: list[str], known: PieceCache, v: Vocabulary) -> list[tuple[int, str, str]]:
    """For each text its number of tokens and the digests of its ids and of what they decode to. Equal texts of a batch, as a mix's copies are, are encoded once."""
    import numpy as np

    each = list(dict.fromkeys(texts))
    made = {}
    for t, packed in zip(each, encode_packed(each, known)):
        back = v.decode(np.frombuffer(packed, np.uint32).tolist())
        made[t] = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest())
    return [made[t] for t in texts]


def round_trip(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: each text encoded, and its ids decoded again, in one pass without a shuffle; ids never leave the task."""
    path = path or rank_file()
    bound_batches(df.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, v = prefix_cache(path), load(path)
        for s in batches:
            yield pd.DataFrame(digests(["" if t is None else t for t in s], known, v), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    rest = [c for c in df.columns if c not in made]
    out = df.select(*[F.col(f"`{c}`") for c in rest], run(F.col(text)).alias("__made"))
    return out.select(*[F.col(f"`{c}`") for c in rest], *[F.col(f"__made.{c}").alias(c) for c in made])


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
