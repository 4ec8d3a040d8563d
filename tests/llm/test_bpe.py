import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import bpe, pretok

ALPHABET = "ab's tredvlm'ST12 \n\t 　é日!?'\r\x1c٣́²ª"


#: The regex module may know newer letters than Python's tables; for those the ids are compared, below.
ASSIGNED = st.characters(exclude_categories=("Cs", "Cn"))


@pytest.fixture(scope="module")
def reference():
    v = bpe.load(bpe.rank_file())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=30) | st.text(ASSIGNED, max_size=20), max_size=6))
def test_pieces_match_the_pattern(texts):
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert [[p.decode() for p in x] for x in pretok.split_bytes(texts)] == [pattern.findall(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(ALPHABET, max_size=60) | st.text("abcdefghij ", max_size=200))
def test_ids_match_the_library(reference, text):
    ids = np.frombuffer(next(bpe.encode_packed([text], bpe.prefix_cache(bpe.rank_file()))), np.uint32).tolist()
    assert ids == reference.encode_ordinary(text)
    assert bpe.load(bpe.rank_file()).decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(ALPHABET, max_size=40), st.lists(st.tuples(st.integers(0, 50), st.integers(0, 8), st.text(ALPHABET, max_size=6)), max_size=5))
def test_edits_equal_a_fresh_encoding(reference, text, edits):
    e = bpe.EncodedText(bpe.load(bpe.rank_file()), text)
    for at, n, new in edits:
        at = min(at, len(e.text))
        e.replace(at, min(at + n, len(e.text)), new)
        e.append(new[:2])
        assert e.ids() == reference.encode_ordinary(e.text)


def test_letters_that_only_newer_tables_know(reference):
    classes, letter = pretok.char_classes(), regex.compile(r"[\p{L}\p{N}\s]")
    newer = [chr(i) for i in range(0x110000) if classes[i] == pretok.OTHER and not 0xD800 <= i < 0xE000 and letter.match(chr(i))]
    texts = [f"a{c}a !{c}1" for c in newer]
    got = bpe.encode_packed(texts, bpe.prefix_cache(bpe.rank_file()))
    assert all(np.frombuffer(g, np.uint32).tolist() == reference.encode_ordinary(t) for t, g in zip(texts, got))


def test_an_edit_stays_local():
    text = "some words in a row and more of them " * 200
    e = bpe.EncodedText(bpe.load(bpe.rank_file()), text)
    e.reencoded = 0
    e.replace(3000, 3001, "x")
    e.append("s")
    assert e.reencoded < 60


def test_long_piece_is_linear(reference):
    text = "a" * 20_000
    ids = bpe.load(bpe.rank_file()).encode_piece(text.encode())
    assert bpe.load(bpe.rank_file()).decode(ids) == text.encode()


def test_frame_with_nulls_ties_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "It's a test\n", None), (3, "It's a test\n", None), (None, "日本 é", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.round_trip(df).orderBy("doc_id").collect()
    assert len(out) == 5 and out[1].n_tokens == 0 and out[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in out)
    back = bpe.decode(bpe.encode(df)).collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for _, t, _ in rows]
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_query_covers_the_table(spark, sf):
    got = {r.doc_id: r for r in bpe.op4_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(got[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest() for d in docs)


def test_copies_in_a_batch_are_encoded_once(monkeypatch):
    met, split = [], bpe.split_bytes
    monkeypatch.setattr(bpe, "split_bytes", lambda texts: split(met.extend(texts) or texts))
    known, v = bpe.prefix_cache(bpe.rank_file()), bpe.load(bpe.rank_file())
    texts = ["one text", "one text", "", "another", "one text"]
    got = bpe.digests(texts, known, v)
    assert sorted(met) == ["", "another", "one text"]
    assert got == [bpe.digests([t], known, v)[0] for t in texts] and got[0][2] == hashlib.sha256(b"one text").hexdigest()
