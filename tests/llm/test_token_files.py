import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from corvane.llm import token_files as tf
from corvane.session import scratch


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tf.tokenizer_file())
    t.encode_special_tokens = True
    return t


def expect(rows, library):
    out, start = [], 0
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark, sf, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(tuple(r) for r in tf.op8_token_files(spark, sf).collect())
    assert got == expect(docs, library)


def test_special_strings_nulls_ties_and_groups(spark, library):
    rows = [(5, "b <|endoftext|> it's\n\n"), (1, None), (2, ""), (3, "word " * 3000), (4, "日本 é"), (5, "a")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids int")
    out = scratch(spark, "t")
    files = tf.write_tokens(df, out, group_tokens=1000)
    assert sum(r["docs"] for r in files) == 6
    want = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    assert sorted(tuple(r) for r in tf.digests(spark, out).collect()) == sorted(expect(want, library))
    read = tf.read_tokens(spark, out).filter("doc_id = 4").collect()
    assert list(read[0].ids) == library.encode("日本 é").ids + [0]
    for r in files:
        meta = pq.ParquetFile(r["file"]).metadata
        for g in range(meta.num_row_groups):
            ids = next(c for c in (meta.row_group(g).column(k) for k in range(meta.num_columns)) if c.path_in_schema.startswith("ids"))
            assert "RLE_DICTIONARY" in ids.encodings and ids.has_offset_index
            assert "DELTA_BINARY_PACKED" in meta.row_group(g).column(0).encodings


def test_empty_table(spark):
    out = scratch(spark, "t")
    assert tf.write_tokens(spark.createDataFrame([], "doc_id long, text string"), out) == []
    assert tf.digests(spark, out).count() == 0 and tf.read_tokens(spark, out).count() == 0


def test_added_tokens_as_the_library_finds_them(spark, tmp_path):
    plain = Tokenizer.from_file(tf.tokenizer_file())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "it's <|endoftext|>'s  \n<|endoftext|>\n\n", "<|endoftext |> <|endoftext|", "none", "", None, "é<|endoftext|>日本 " * 500]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in tf.op8_token_files(spark, str(tmp_path)).collect())
    assert got == expect(rows, plain)
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_longest_added_token_and_those_that_need_their_surroundings(tmp_path):
    import json

    with open(tf.tokenizer_file(), encoding="utf-8") as f:
        spec = json.load(f)
    one = spec["added_tokens"][0]
    spec["added_tokens"] += [one | {"id": 50257, "content": "<|endoftext|>!", "special": False}, one | {"id": 50258, "content": "<|end"}]
    path = tmp_path / "more.json"
    path.write_text(json.dumps(spec))
    library = Tokenizer.from_file(str(path))
    texts = ["a<|endoftext|>! b", "<|end <|endoftext|>?", "<|endoftext|>!!"]
    for special in (True, False):
        library.encode_special_tokens = not special
        got = [np.frombuffer(b, "<u4").tolist() for b in tf.encode_whole(texts, tf.library_cache(str(path)), tf.added_tokens(str(path), special))]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    spec["added_tokens"][1]["lstrip"] = True
    strip = tmp_path / "strip.json"
    strip.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        tf.added_tokens(str(strip), True)
