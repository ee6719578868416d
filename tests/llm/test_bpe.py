"""Encoding and decoding against the tokenizer itself."""

import hashlib

import pytest
from tokenizers import Tokenizer

from hostlens.llm.bpe import VOCABULARY, Vocabulary, encode_documents
from tests.llm.conftest import EDGES, documents

TEXTS = [
    "Hello, world!  It's 3 o'clock\n\n  and   we'll go. ", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>c",
    " <|endoftext", "日本語テキスト 123４５ ½ Ⅷ", "emoji 👩‍👩‍👧 ​﻿ x y z　", "\x00\x01 nul\x00", "tab\t\ttab\r\n\x0b\x0c\x85.",
    "''' 's'S 'LL", "x" * 5000, " " * 3000, "नमस्ते दुनिया", "áé", "__init__ == !!??",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def test_like_the_tokenizer(spark, tokenizer):
    rows = EDGES + [(100 + i, t, "en", "a") for i, t in enumerate(TEXTS)]
    got = encode_documents(documents(spark, rows), Vocabulary(VOCABULARY)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded"] == decoded == texts[r["doc_id"]]
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_no_rows(spark):
    empty = documents(spark, EDGES).limit(0)
    out = encode_documents(empty, Vocabulary(VOCABULARY), also=())
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
