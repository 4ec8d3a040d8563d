"""Operator 10: removal of repeated passages by hashing normalised units.

A line is cut into sentences. One of MIN_WORDS words or more is a unit, and so are neighbouring shorter ones that
together have as many. A sentence also ends where text was pasted into text: before a capital after a word without a full stop
(unless all around are capitals), and after a full stop before a small letter; so the units of a passage are the same wherever it stands.
What this leaves over (fragments between such ends, short lines) is joined over cuts and line breaks, and cut into units where a
fragment's hash is the least within MIN_WORDS words on both sides, starts of paragraphs, lines and sentences first: borders that depend on the words near them
alone. Whole lines and whole stretches of left-over fragments are units too. What is still too short for a unit makes one with the unit
before it (at the beginning of a text, after it), so it goes where it repeats together with that, and only there. Where a script has no blanks, two characters count as a word.
Units are compared in lower case, letters and digits only, by 128-bit digests grouped over the whole corpus.
The occurrence in the document with the smallest doc_id, and there the first, is kept; the others are removed. Nothing else is, but the white space after them.
``removed`` retains what goes, as spans in order that don't overlap: offsets in the original text (code points, end excluded, white space included) and the
document that keeps the passage (the smallest one where several units make a span; for a repeat within one text, that document
itself). The original is the cleaned text with these spans put back.

Units are computed once and written to the shared folder. Only digests and offsets are shuffled to find repeats: once combined to one row a digest, once to meet the digests
that repeat, which are unique on their side, so a digest that a third of all rows hold is streamed, and its partition split by AQE.

Defined results: null text stays null and an empty one empty, with nothing removed; texts of any length are cut whole, a task holds one Arrow batch of them; of equal
units in one document the first is kept; rows without doc_id rank last; rows that
repeat a doc_id are one document and keep what they share; an empty table gives an empty result; ``removed`` and
``removed_chars`` replace columns of these names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.batches import beside, bound_batches
from corvane.session import scratch, table

MIN_WORDS = 8
REMOVED = "array<struct<start: int, end: int, first_doc_id: bigint>>"
_LAST = (1 << 63) - 1
#: Scripts without blanks between words: Thai and Lao, Burmese, Khmer, kana, Han.
_DENSE = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x323AF)]


@cache
def _letters() -> tuple[np.ndarray, ...]:
    """For each code point: lower case, and whether it is a letter or digit, a capital, white space, a letter of a script without blanks."""
    n = 0x110000
    lower = np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(n)), np.uint32, n)
    dense = np.zeros(n, bool)
    for first, last in _DENSE:
        dense[first : last + 1] = True
    kinds = [np.fromiter(map(f, map(chr, range(n))), bool, n) for f in (str.isalnum, str.isupper, str.isspace)]
    return lower, *kinds, dense & kinds[0]


def units(texts: list[str], min_words: int = MIN_WORDS) -> Iterator[list[tuple[int, int, int, int]]]:
    """For each text its units: start, end, and the digest as two signed 64-bit numbers."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > 1 << 20:
            yield from _units(part, min_words)
            part, size = [], 0
    if part:
        yield from _units(part, min_words)


def _units(texts: list[str], min_words: int) -> Iterator[list[tuple[int, int, int, int]]]:
    import xxhash

    lower, alnum, capital, space, no_blanks = _letters()
    # texts are joined by two line breaks, so none runs into the next
    whole = "\n\n".join(texts) + "\n\n"
    cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = space[cp]
    edge = np.diff(np.concatenate(([1], blank.view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    char = no_blanks[cp]
    if char.any():  # a letter of these scripts is a word of its own, and what follows it up to the next letter or digit goes with it
        first = char.copy()
        letters = np.flatnonzero(alnum[cp])
        first[letters[1:][char[letters[:-1]]]] = True
        inside = np.setdiff1d(np.flatnonzero(first & ~blank), start)
        start, end = np.sort(np.append(start, inside)), np.sort(np.append(end, inside))
    real = np.add.reduceat(alnum[cp].astype(np.int32), np.stack((start, end), 1).ravel())[::2] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[real], end[real]
    keep = alnum[cp]
    norm = lower[cp]
    if len(start):
        inner = start[start > 0] - 1
        inner = inner[blank[inner]]
        keep[inner] = True
        norm = np.where(blank, np.uint32(32), norm)
    at = np.append(0, np.cumsum(keep))
    packed = memoryview(np.ascontiguousarray(norm[keep]).view(np.uint8))
    breaks = np.append(0, np.cumsum(cp == 10))
    last = cp[end - 1] if len(start) else cp[:0]
    stop = np.isin(last, [ord(c) for c in ".!?…。！？"])
    upper = capital[cp[start]] if len(start) else np.zeros(0, bool)
    line = np.ones(len(start), bool)
    line[1:] = breaks[start[1:]] != breaks[end[:-1]]
    natural, forced = np.zeros(len(start), bool), line.copy()
    char = char[start] if len(start) else np.zeros(0, bool)
    natural[1:] = stop[:-1] & (upper[1:] | char[1:])
    small = np.append(~upper[1:], True)  # the next word
    forced[1:] |= (stop[:-1] & ~upper[1:] & ~char[1:]) | (upper[1:] & ~stop[:-1] & ~char[:-1] & (~upper[:-1] | small[1:]))
    cuts = np.flatnonzero(natural | forced)
    spans, lines, whole_runs = [], [], []  # first and last word
    n = len(start)
    rows = [*zip(cuts.tolist(), forced[cuts].tolist(), line[cuts].tolist()), (n, True, True)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    begin = np.cumsum(sizes) - sizes
    of_word = np.searchsorted(begin, start, "right") - 1
    size = np.append(0, np.cumsum(2 - char)).tolist()  # of the words before, in half words
    least = 2 * min_words
    loose: list[int] = []  # first words of the fragments that no sentence unit holds
    after: list[int] = []  # and of what follows each
    held: list[tuple[int, int]] = []  # the short sentences at hand
    run = line_from = 0  # first word of the short sentences at hand, and of the line
    for (k, hard, _), (following, ends, line_ends) in zip(rows, rows[1:]):
        if hard:
            run = k
        long_ = size[following] - size[k] >= least
        if held and (hard or long_):
            for x, y in held:
                loose.append(x)
                after.append(y)
            held = []
        if long_:
            spans.append((k, following - 1))
            run = following
        elif size[following] - size[run] >= least:
            spans.append((run, following - 1))
            run = following
            held = []
        else:
            held.append((k, following))
        if line_ends:
            if size[following] - size[line_from] >= least:
                lines.append((line_from, following - 1))
            line_from = following
    for x, y in held:
        loose.append(x)
        after.append(y)
    if loose:
        tier = np.full(n, 3)
        tier[natural] = 2
        tier[line] = 1
        tier[0] = 0
        tier[1:][breaks[start[1:]] > breaks[end[:-1]] + 1] = 0
        words, texts_of = np.array(loose), of_word[loose]
        apart = np.flatnonzero((words[1:] != np.array(after[:-1])) | (texts_of[1:] != texts_of[:-1])) + 1
        for x, y in zip([0, *apart.tolist()], [*apart.tolist(), len(loose)]):
            if size[after[y - 1]] - size[loose[x]] < least:
                continue
            whole_runs.append((loose[x], after[y - 1] - 1))
            keys = [(int(tier[a]), xxhash.xxh3_64_intdigest(packed[4 * int(at[start[a]]) : 4 * int(at[end[b - 1]])])) for a, b in zip(loose[x:y], after[x:y])]
            past = after[y - 1]
            keys.append((int(tier[past]) if past < n else 0, 0))  # what follows is a border of its kind
            inner = [k for k in _borders(keys, [size[a] for a in (*loose[x:y], past)], least) if 0 < k < y - x]
            firsts = [loose[x], *[loose[x + k] for k in inner], past]
            spans += [(a, b - 1) for a, b in zip(firsts, firsts[1:]) if size[b] - size[a] >= least]
    found = sorted({*spans, *lines, *whole_runs, *_joined(sorted(spans), size, of_word.tolist(), least)})
    of = of_word[[a for a, _ in found]] if found else []
    out: list[list] = [[] for _ in texts]
    s, e, c = start.tolist(), end.tolist(), at
    for (a, b), k in zip(found, of):
        h = xxhash.xxh3_128_digest(packed[4 * int(c[s[a]]) : 4 * int(c[e[b]])])
        base = int(begin[k])
        out[k].append((s[a] - base, e[b] - base, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)))
    yield from out


def _borders(keys: list[tuple[int, int]], places: list[int], least: int) -> list[int]:
    """Fragments that begin a unit: those whose key is the least of all fragments nearer than ``least``; of equal ones as many as are that far apart."""
    out: list[int] = []
    from_ = to = 0
    n = len(keys)
    for i in range(n):
        while places[from_] <= places[i] - least:
            from_ += 1
        while to < n and places[to] < places[i] + least:
            to += 1
        if (not out or places[i] - places[out[-1]] >= least) and keys[i] <= min(keys[from_:to]):
            out.append(i)
    return out


def _occurrences(df: DataFrame, text: str, min_words: int) -> DataFrame:
    """__d, __t, a unit's span and digest, and whether it is the digest's first in its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for d, t, own in zip(b["__d"].tolist(), b["__t"].tolist(), units(b[text].tolist(), min_words)):
                seen = set()
                for s, e, h, g in own:
                    for col, v in zip(cols, (d, t, s, e, h, g, (h, g) not in seen)):
                        col.append(v)
                    seen.add((h, g))
            yield pd.DataFrame(dict(zip(("__d", "__t", "start", "end", "h1", "h2", "first"), cols))).astype({"first": bool})

    rows = df.filter(F.col(text).isNotNull()).select("__d", "__t", F.col(text))
    return rows.mapInPandas(run, "__d long, __t long, start int, end int, h1 long, h2 long, first boolean")


def _joined(spans: list[tuple[int, int]], size: list[int], of: list[int], least: int) -> Iterator[tuple[int, int]]:
    """Units of the words between two units, too few for one of their own, with the unit before; at the beginning of a text with the one after."""
    last = len(of) - 1
    for (a, b), (c, d) in zip([(-1, -1), *spans], [*spans, (last + 1, last + 1)]):
        first, past = b + 1, c  # the words between
        if first >= past:
            continue
        stop = first
        if a >= 0 and of[first] == of[b]:
            stop = past if of[past - 1] == of[b] else bisect_right(of, of[b], first, past)
            if size[stop] - size[first] < least:
                yield a, stop - 1
        if c <= last and stop < past and of[past - 1] == of[c]:
            begin = bisect_left(of, of[c], stop, past)
            if size[past] - size[begin] < least:
                yield begin, d


def cuts(text: str, spans: list[tuple[int, int, int | None]]) -> list[tuple[int, int, int | None]]:
    """What goes of text: the spans (start, end, keeping document), merged where they overlap, each with the white space after it; a line that loses all its words goes whole."""
    merged: list[list] = []
    for s, e, d in sorted(spans, key=lambda x: x[:2]):
        if merged and s < merged[-1][1]:
            top = merged[-1]
            top[1] = max(top[1], e)
            top[2] = d if top[2] is None else top[2] if d is None else min(d, top[2])
        else:
            merged.append([s, e, d])
    out: list[tuple[int, int, int | None]] = []
    at, bare = 0, True  # the end of the last cut; whether no word stays in the line before it
    for s, e, d in merged:
        before, broken, own = text[at:s].rpartition("\n")
        bare = (bare or bool(broken)) and not own.strip()
        while e < len(text) and text[e] != "\n" and text[e].isspace():
            e += 1
        if bare and e < len(text) and text[e] == "\n":
            e += 1
        out.append((s, e, d))
        at = e
    return out


def _without(text: str, gone: list[tuple]) -> str:
    out, at = [], 0
    for s, e, *_ in gone:
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return "".join(out)


def remove_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with text cleaned, plus removed (array of start, end, first_doc_id) and removed_chars."""
    bound_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in ("removed", "removed_chars")]
    rows = df.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("__d"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("__t"))
    path = scratch(df.sparkSession, "units")
    _occurrences(rows, text, min_words).write.parquet(path)
    found = df.sparkSession.read.parquet(path)
    repeats = found.filter("first").groupBy("h1", "h2").agg(F.min("__d").alias("low"), F.max("__d").alias("high")).filter("high > low").select("h1", "h2", "low")
    later = found.filter("first").join(repeats, ["h1", "h2"]).filter("__d > low").select("__d", "__t", "start", "end", "low")
    again = found.filter("NOT first").select("__d", "__t", "start", "end", F.col("__d").alias("low"))
    spans = later.unionByName(again).groupBy("__d", "__t").agg(F.collect_set(F.struct("start", "end", F.nullif("low", F.lit(_LAST)).alias("first_doc_id"))).alias("__spans"))

    @F.pandas_udf(f"text string, removed {REMOVED}, removed_chars int")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, spans):
            gone = [] if t is None or s is None else cuts(t, [(x["start"], x["end"], x["first_doc_id"]) for x in s])
            out.append((_without(t, gone) if gone else t, [dict(zip(("start", "end", "first_doc_id"), x)) for x in gone], sum(b - a for a, b, _ in gone)))
        return pd.DataFrame(out, columns=["text", "removed", "removed_chars"])

    joined = rows.join(spans, ["__d", "__t"], "left").withColumn("__made", clean(F.col(text), F.col("__spans")))
    cols = [F.col("__made.text").alias(c) if c == text else F.col(f"`{c}`") for c in rest]
    return joined.select(*cols, "__made.removed", "__made.removed_chars")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def without_passages(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: texts without their repeated passages; every document stays, with its own columns."""
    out = beside(docs, ("removed", "removed_chars"), remove_passages)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
