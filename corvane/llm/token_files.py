"""Operator 8: token ids in Parquet files with list columns.

File format: ``part-NNNNNN.parquet`` files in ascending doc_id order, each with the columns

* doc_id, part, part_start (tokens before the document in this file), n_tokens: delta or dictionary
  encoded, so metadata reads touch a few bytes a document;
* ids list<int32>: dictionary encoded, so a token takes as many bits as its row group has distinct ids.

Row groups close at ``group_tokens`` tokens, pages at ``page_bytes``; the page index lets a reader with a
doc_id range fetch just the pages it needs. ``manifest.json`` has each file's counts, whose running sum gives
a document's place in the whole sequence of tokens.

Executors may be lost at any time: a task writes under a name of its own and renames when complete; its
contents depend on its input alone, so an attempt that runs again replaces like by like.

Added tokens of the tokenizer's file are found in the texts first, as the library does, and what lies between is encoded piece by
piece. The query takes special ones (<|endoftext|>) for tokens too, the library's default; ``write_tokens`` does so with ``special``
and otherwise encodes them as ordinary text, the library's ``encode_special_tokens``.

Nulls and empty texts have just the end id; repeated rows are written each, ties of doc_id in the order of a hash of their texts; rows without doc_id come first; a
document of more than GROUP_TOKENS tokens is a row group of its own, and a task holds one group and one Arrow batch; an empty table gives no files; further columns aren't written.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.batches import bound_batches
from corvane.llm.bpe import PieceCache, encode_packed, pack
from corvane.session import scratch, table

END_ID = 0
GROUP_TOKENS = 1 << 20
PAGE_BYTES = 1 << 16


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


@cache
def library_cache(path: str) -> PieceCache:
    """Packed ids by piece, made by the tokenizers library's model. The file has to be plain byte-level BPE: a piece's ids then don't depend on its text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    spec = json.loads(tokenizer.to_str())
    pre = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only byte-level BPE without normaliser or prefix space")
    letters, model = _byte_letters(), tokenizer.model
    return PieceCache(lambda piece: pack(t.id for t in model.tokenize(piece.decode("latin-1").translate(letters))))


@cache
def added_tokens(path: str, special: bool) -> tuple[re.Pattern, dict[str, bytes]] | None:
    """A pattern of the file's added tokens, the longest first, and their packed ids; special ones only if asked for."""
    with open(path, encoding="utf-8") as f:
        tokens = [t for t in json.load(f).get("added_tokens") or [] if t["content"] and (special or not t["special"])]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("only added tokens that don't depend on the text around them")
    ids = {t["content"]: pack([t["id"]]) for t in tokens}
    return (re.compile(f"({'|'.join(map(re.escape, sorted(ids, key=len, reverse=True)))})"), ids) if ids else None


def encode_whole(texts: list[str], known: PieceCache, added: tuple[re.Pattern, dict[str, bytes]] | None) -> Iterator[bytes]:
    """Packed ids of each text, cut at the added tokens."""
    if added is None:
        yield from encode_packed(texts, known)
        return
    pattern, ids = added
    parts = [pattern.split(t) for t in texts]  # text, token, text, ...
    plain = encode_packed([x for p in parts for x in p[::2]], known)
    for p in parts:
        yield b"".join([next(plain), *(x for token in p[1::2] for x in (ids[token], next(plain)))])


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32())))])


def write_tokens(df: DataFrame, out: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, page_bytes: int = PAGE_BYTES, special: bool = False) -> list[dict]:
    """Writes the files and returns the manifest, a row for each file. Only doc_id and text are shuffled, once, to put documents in order."""
    import numpy as np

    path = path or tokenizer_file()
    end = end_id.to_bytes(4, "little")
    bound_batches(df.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task, known, added = TaskContext.get(), library_cache(path), added_tokens(path, special)
        fs, root = _filesystem(out)
        part, total, docs, writer = task.partitionId(), 0, 0, None
        name, own = f"{root}/part-{part:06d}.parquet", f"{root}/.part-{part:06d}-{task.taskAttemptId()}"
        rows: list[tuple] = []
        held = 0

        def flush():
            nonlocal writer, rows, held
            if writer is None:
                fs.create_dir(root, recursive=True)
                delta = dict.fromkeys(("doc_id", "part_start", "n_tokens"), "DELTA_BINARY_PACKED")
                writer = pq.ParquetWriter(own, SCHEMA, filesystem=fs, compression="zstd", compression_level=1, use_dictionary=["ids.list.element", "part"], column_encoding=delta, write_page_index=True, data_page_size=page_bytes, version="2.6")
            sizes = [r[2] for r in rows]
            offsets = pa.array([0, *accumulate(sizes)], pa.int32())
            values = pa.Array.from_buffers(pa.int32(), held, [None, pa.py_buffer(b"".join(r[3] for r in rows))])
            ids = pa.ListArray.from_arrays(offsets, values, type=SCHEMA.field("ids").type)
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array(np.full(len(rows), part), pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array(sizes, pa.int64()), ids]
            writer.write_table(pa.Table.from_arrays(cols, schema=SCHEMA), row_group_size=len(rows))
            rows, held = [], 0

        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for key, packed in zip(batch.column(0).to_pylist(), encode_whole(texts, known, added)):
                n = len(packed) // 4 + 1
                if rows and held + n > group_tokens:
                    flush()
                rows.append((key, total, n, packed + end))
                held += n
                total += n
                docs += 1
        if rows:
            flush()
        if writer is not None:
            writer.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_pylist([{"part": part, "docs": docs, "tokens": total, "file": name}], pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("file", pa.string())]))

    # by the text's hash too, so rows that share an id, or have none, don't all go to one task
    ordered = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    files = [r.asDict() for r in ordered.mapInArrow(write, "part int, docs long, tokens long, file string").collect()]
    files.sort(key=lambda r: r["part"])
    start = 0
    for r in files:
        r["start"] = start
        start += r["tokens"]
    fs, root = _filesystem(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(files).encode())
    return files


def _manifest(out: str) -> list[dict]:
    fs, root = _filesystem(out)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """The files as a table doc_id, start, n_tokens, ids. Spark prunes the columns and pushes filters on doc_id down to pages."""
    files = _manifest(out)
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids array<int>")
    starts = spark.createDataFrame([(r["part"], r["start"]) for r in files], "part int, before long")
    rows = spark.read.parquet(f"{out}/part-*.parquet").join(starts, "part")
    return rows.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files a row group at a time."""
    files = _manifest(out)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        fs, _ = _filesystem(out)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(r["file"]) as source:
                    f = pq.ParquetFile(source)
                    for g in range(f.num_row_groups):
                        t = f.read_row_group(g).combine_chunks()
                        ids = t.column("ids").chunk(0)
                        values, offsets = memoryview(ids.values.buffers()[1]), ids.offsets.to_pylist()
                        lead = ids.values.offset
                        crc = [zlib.crc32(values[4 * (lead + a) : 4 * (lead + b)]) for a, b in zip(offsets, offsets[1:])]
                        start = [r["start"] + x for x in t.column("part_start").to_pylist()]
                        yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks().cast(pa.int64()) if t.column("doc_id").num_chunks > 1 else t.column("doc_id").chunk(0), pa.array(start, pa.int64()), t.column("n_tokens").chunk(0), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame([(r["file"], r["start"]) for r in files], "file string, start long")
    return listed.repartition(len(files)).mapInArrow(read, schema)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), out, special=True)
    return digests(spark, out)
