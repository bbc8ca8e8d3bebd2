"""Prefix-table BPE against the tiktoken library, and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from peerlens.llm import byte_bpe
from peerlens.llm.common import table


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.Vocabulary(byte_bpe.VOCABULARY).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(byte_bpe.VOCABULARY)


def test_whole_table(spark, data, reference):
    docs = table(spark, data, "documents")
    rows = {r.doc_id: r for r in byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs))).collect()}
    for r in docs.collect():
        ids = reference.encode_ordinary(r.text)
        got = rows[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_all_code_points(reference):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 20000):
        part = points[at:at + 20000]
        text = "".join(x + ("a" if i % 3 else " ") for i, x in enumerate(part))
        assert byte_bpe.encode_text(text).tolist() == reference.encode_ordinary(text)


def test_long_and_odd(reference):
    rng = random.Random(3)
    odd = ["", " ", "\n" * 999, "a" * 3000, " " * 5000 + "x", "é" * 2000, "<|endoftext|>", "1234567890" * 50, "\x00\x01"]
    odd += ["".join(rng.choice("ab \n'stéß漢1.") for _ in range(400)) for _ in range(60)]
    for text in odd:
        assert byte_bpe.encode_text(text).tolist() == reference.encode_ordinary(text)


def test_latin_texts_are_split_alike():
    rng = random.Random(4)
    every = [chr(i) for i in range(256)] + list("'' \n  tsdmrevl") * 8
    for _ in range(2000):
        text = "".join(rng.choice(every) for _ in range(60))
        assert byte_bpe._LATIN.findall(text) == byte_bpe._SPLIT.findall(text)


def test_pairs_against_merging(vocabulary):
    rng = random.Random(6)
    ids = sorted(vocabulary.halves)
    wrong = 0
    for _ in range(4000):
        a, b = rng.choice(ids), rng.choice(ids)
        if len(vocabulary.tokens[a]) + len(vocabulary.tokens[b]) < 40:
            stays = vocabulary.merge(vocabulary.tokens[a] + vocabulary.tokens[b]) == [a, b]
            assert vocabulary.pair(a, b) == stays
            wrong += not stays
    assert wrong


def test_prefixes_appends_and_edits(vocabulary, reference):
    rng = random.Random(5)
    data = bytes(rng.choice(b"theraonding ") for _ in range(300)).replace(b" ", b"s")
    table_ = byte_bpe.PrefixEncoder(vocabulary)
    for i in range(0, 300, 7):
        table_.append(data[i:i + 7])
    for end in (1, 50, 123, 300):
        assert table_.tokens(end) == vocabulary.merge(data[:end])
    for at, removed, put in ((10, 3, b"xyz"), (150, 0, b"ing"), (290, 10, b""), (0, 1, b"q"), (100, 20, b"the")):
        data = data[:at] + put + data[at + removed:]
        computed = table_.edit(at, removed, put)
        assert bytes(table_.data) == data
        assert table_.last == byte_bpe.PrefixEncoder(vocabulary, data).last
        assert table_.tokens() == vocabulary.merge(data)
    assert computed < len(data)


def test_edges(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "x y", "b"), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs))).collect()
    assert sorted((r.n_tokens for r in out)) == [0, 0, 0, 2]
    assert {r.ids_sha256 for r in out if not r.n_tokens} == {hashlib.sha256(b"").hexdigest()}
    assert byte_bpe.encode(docs.limit(0)).count() == 0
