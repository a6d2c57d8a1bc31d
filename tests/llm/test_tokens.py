"""Operators 3 and 6 against the libraries themselves, and exact round trips."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe_codec, token_files
from tests.llm.cases import documents, empty

RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
EXTRA = [
    (60, "we'll don't 'tis 12,345.67 a b   c\r\n\r\n  d", "en", "a"),
    (61, "x" * 400 + " " * 90 + "y" * 300 + "\n" * 50, "en", "a"),
    (62, "a,, b. c.d, e!. 7, ,f\nG. été, ß. <|endoftext|>", "en", "a"),
    (63, "one line\nnext, line.\nlast", "en", "a"),
]


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("sizes", [{}, {"chunk_chars": 200, "overlap_chars": 50}, {"chunk_chars": 40, "overlap_chars": 7}])
def test_codec(spark, sizes):
    docs = documents(spark, EXTRA)
    encoding, _, _ = bpe_codec.coder(RANKS)
    want = Counter()
    for r in docs.collect():
        ids = encoding.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), digest(ids), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe_codec.digests(bpe_codec.encode(docs, RANKS, **sizes)).collect()) == want
    assert bpe_codec.encode(empty(spark), RANKS).count() == 0


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_token_files(spark, coalesced):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)  # one shard, and several
    docs = documents(spark, EXTRA)
    tokenizer = Tokenizer.from_file(JSON)
    want = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    got = token_files.write_and_read(docs, JSON).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: (r.start, r.n_tokens)):
        assert r.start == start and len(r.ids) == 4 * r.n_tokens
        start += r.n_tokens
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda i: (i is not None, i or 0))
    assert token_files.write_and_read(empty(spark), JSON).count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=80))
def test_words_round_trip(ids):
    words, at, escapes = token_files.pack(np.array(ids, np.uint32))
    assert token_files.unpack(words, at, escapes, len(ids)).tolist() == ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab,. \n'!7\té <|")))
def test_encoder_on_any_blanks(text):
    e = token_files.encoder(JSON)
    assert e.batch([text])[0] == e.whole(text)


def test_other_tokenizers_are_asked_for_whole_texts():
    """What cannot be cut at words is told by the tokenizer's file."""
    import json

    file = json.loads(Tokenizer.from_file(JSON).to_str())
    assert token_files.byte_level(file) and token_files.encoder(JSON).by_words
    changed = [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": file["model"] | {"dropout": 0.1}}, {"model": file["model"] | {"end_of_word_suffix": "</w>"}}]
    assert not any(token_files.byte_level(file | c) for c in changed)
    other = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Some Words, here.\nAnd more", "", None, "one  two"]
    assert not other.by_words
    assert [np.frombuffer(x, "<u4").tolist() for x in other.batch(texts)] == [other.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_rows_of_one_id_are_dealt_out_by_their_texts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(5, f"text number {k}") for k in range(400)] + [(None, f"no id {k}") for k in range(200)] + [(9, "last")]
    out = token_files.scratch_path(spark, "one-id")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), JSON, out)
    shards = spark.read.schema(token_files.BLOCKS).parquet(out).groupBy("shard").count().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards > 2
    back = token_files.read(spark, out).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None] * 200 + [5] * 400 + [9]
