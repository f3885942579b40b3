import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardflow.llm import tokens

from .util import EMPTY, SMALL, docs, rows, table

FILE = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(*tokens.vocabulary(FILE))


def test_table(spark, library):
    texts = {r["doc_id"]: r["text"] for r in table(SMALL, "documents")}
    for r in tokens.count_tokens(spark.read.parquet(f"{SMALL}/documents.parquet"), FILE).collect():
        n = library(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


PIECES = st.sampled_from([
    "the", " the", "ing", "'s", "'LL", " ", "  ", "\n", "\t", "\r\n", "\x00", "\x1c", "\x85", " ", "​", "1", "²", "é", "é", "日本",
    "\U0001f600", "<|endoftext|>", "<|endoftext", "|>", "!!", "###", "_", "﻿", "ǅ",
])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(PIECES, max_size=14).map("".join)))
def test_like_the_library(library, counter, text):
    assert counter(text) == library(text)


def test_special_string_inside(library, counter):
    assert counter("a<|endoftext|><|endoftext|> b") == library("a<|endoftext|><|endoftext|> b") == 4


def test_very_long_words_and_texts(library, counter):
    for text in ("ab" * 40_000, "x" * 70_000, "word " * 300_000, "\n" * 50_000):
        assert counter(text) == library(text)


def test_memory_of_words_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    counter.counts.clear()
    assert counter(" ".join(f"w{i}" for i in range(200))) > 200
    assert len(counter.counts) <= 10


def test_hard_cases(spark, library):
    got = rows(tokens.count_tokens(docs(spark, EMPTY, clash=True), FILE), "doc_id", "n_bytes", "n_tokens")
    assert got == sorted(
        ((d, len((t or "").encode()), library(t)) for d, t in EMPTY), key=lambda r: tuple((v is not None, v or 0) for v in r)
    )
    assert tokens.count_tokens(docs(spark, []), FILE).count() == 0
