import random

import pytest

from plumbline.llm import tokenizer


@pytest.fixture(scope="module")
def encoder():
    return tokenizer.encoder(tokenizer.default_path())


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


PARTS = ["a", "b", " ", "  ", "\n", "\r\n", "aaaa", "the", "ø", "ß", "漢字", "😀", "\x1c", "\x85", "​", "　", "½", "²", "é", "'s", "'S", "<|endoftext|>", "0", "١", "﻿", ".", "..", "-----", "̀", "\U0001e900"]


def test_same_ids_as_the_library(encoder, reference):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14)))
        assert encoder.encode(text) == reference(text), repr(text)
    for _ in range(1500):
        text = "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(1, 60)))
        assert encoder.encode(text) == reference(text), text


def test_long_piece(encoder, reference):
    text = "ab" * 30_000
    assert encoder.encode(text) == reference(text)


def test_documents(spark, reference, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in tokenizer.token_ids(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    assert all(got[r["doc_id"]] == (reference(r["text"]) if r["text"] else []) for r in rows)


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (1, None, "x")], "doc_id long, text string, ids string")
    assert sorted((r["doc_id"], r["ids"]) for r in tokenizer.token_ids(df).collect()) == [(1, []), (1, []), (2, []), (3, [220])]
    assert tokenizer.token_ids(df.limit(0)).count() == 0
