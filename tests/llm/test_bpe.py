"""Byte-level BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paraspark.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "the", "'ll", "'s", "'", "1", "23", "é", "😀", "  ", "\n", " ", "\t", "!!", "<|endoftext|>", "xyz", "中文", " "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def own():
    with open(RANKS, "rb") as file:
        return bpe.tokenizer(file.read(), public_tokenizers.PATTERN)


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("blanks", [True, False])
def test_tree_concatenation_is_exact(library, own, blanks):
    encoder, table = own
    rng = random.Random(blanks)
    for _ in range(1500):
        parts = [p for p in rng.sample(PARTS, rng.choice([3, 8, len(PARTS)])) if blanks or not p.isspace()] or ["q"]
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 100)))
        pieces = bpe.cut(text, rng.choice([5, 9, 17, 40]))
        assert "".join(p for p, _ in pieces) == text
        got = bpe.join_tree(encoder, table, [(bpe.encode_text(encoder, p), hard) for p, hard in pieces])
        assert got == ids(library, text), (text, pieces)


def test_every_character_as_in_the_library(library, own):
    encoder, _ = own
    points = [*range(1, 0xD800, 7), *range(0xE000, 0x30000, 31), 0x1F600, 0x10FFFF]
    for c in map(chr, points):
        text = f"a{c}b 1{c}2 {c}!{c}  {c}"
        assert bpe.encode_text(encoder, text) == ids(library, text), hex(ord(c))


@pytest.mark.parametrize("piece", [16384, 50])
def test_documents_round_trip(library, documents, piece):
    texts = {1: None, 2: "", 3: "Hello  world\n" * 9, 4: "x" * 3000, 5: "née 😀" * 200, 6: " " * 500 + "a", 7: "<|endoftext|> b", None: "z y"}
    df = documents(list(texts.items()))
    encoded = bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN, piece_chars=piece)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert got == {i: ids(library, t or "") for i, t in texts.items()}
    back = bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in texts.items()}


def test_digest_of_the_corpus(library, corpus):
    df, texts = corpus
    for r in bpe.bpe_digest(df, RANKS, public_tokenizers.PATTERN).collect():
        want = ids(library, texts[r["doc_id"]])
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_repeated_rows_and_empty_table(documents):
    twice = bpe.encode_documents(documents([(1, "a b")] * 2 + [(1, "q" * 99)] * 2), RANKS, public_tokenizers.PATTERN, piece_chars=20)
    assert twice.count() == 4
    assert bpe.bpe_digest(documents([]), RANKS, public_tokenizers.PATTERN).count() == 0
