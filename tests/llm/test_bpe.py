import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
import tiktoken

from sessionlens.llm.bpe import Encoder, decode_documents, encode_documents, load_ranks, op3_byte_bpe, replay

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_blocks_equal_the_library(ranks, reference):
    r = random.Random(3)
    texts = ["", " ", "<|endoftext|>", "a" * 3000, "ab" * 500, "é" * 99, "\u0000�", "it's they'll"]
    texts += ["".join(r.choice("aab  \n\té中\U0001f600x1.,!'s") for _ in range(r.randrange(80))) for _ in range(400)]
    encoder = Encoder(ranks, public_tokenizers.PATTERN)
    for part in (texts, texts[::-1], texts):  # the cache serves later blocks
        assert encoder.encode_block(part) == reference.encode_ordinary_batch(part)
    assert all(encoder.decode(ids) == t.encode() for ids, t in zip(encoder.encode_block(texts), texts))


def test_replay_takes_the_lowest_rank_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 300, b"bcd": 301}
    assert replay([b"abc", b"abcd", b"bcd", b"xbcd", b"abab", b"aaab"], ranks) == [(258,), (258, 100), (301,), (120, 301), (256, 256), (97, 97, 256)]


def test_edges_and_round_trip(spark, reference):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hi there " * 5000, None), (4, "same", "c"), (4, "same", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    coded = encode_documents(docs, PATH, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "n_tokens", "token_ids"]
    got = [(r.doc_id, list(r.token_ids)) for r in coded.orderBy("doc_id").collect()]
    assert got == [(i, reference.encode_ordinary(t or "")) for i, t, _ in rows]
    back = decode_documents(coded.drop("text"), PATH)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, t or "") for i, t, _ in rows)
    assert encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark, small, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op3_byte_bpe(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_words_of_a_block_are_held_as_numbers(ranks):
    """Texts of a block share their words; a string for each took 12 bytes a character here."""
    encoder, texts = Encoder(ranks, public_tokenizers.PATTERN), ["some words come again and again " * 100] * 200
    tracemalloc.start()
    encoder.encode_block(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * sum(map(len, texts))
