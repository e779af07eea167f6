"""Prefix tables against the library: whole texts, every prefix, and cuts to a budget."""

import random

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import token_counts

PIECES = ["the ", "Token", "isation", " ", "  ", "   ", "\n", "\t", "é", "Ünï", "日本", "😀", "▁", "<s>", "</s>", "<unk>", "<0x41>", "0", "1234567890", ".", "...", "-", "_", "'s", "http://", "a", "B", " ", "​", "\x00", "\x7f", "ﬁ", "ǆ", "Ж", "ɏɐ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))


def strings(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, most))) for _ in range(n)] + ["", " ", "\n", "▁", "z" * 500, " " * 500, "0" * 500, "é" * 300]


def test_totals_equal_the_library(library):
    table = token_counts.counter()
    for text in strings(1, 1500, 30):
        assert table.total(text) == len(library.encode(text)), text


def test_every_prefix_equals_encoding_it_again(library):
    table = token_counts.counter()
    for text in strings(2, 60, 14):
        assert table.prefixes(text).tolist() == [len(library.encode(text[: i + 1])) for i in range(len(text))], text


def test_cut_is_the_longest_prefix(library):
    table = token_counts.counter()
    for text in strings(3, 40, 20):
        for budget in (0, 1, 5, 17):
            cut = table.cut(text, budget)
            assert cut == max((i for i in range(len(text) + 1) if len(library.encode(text[:i])) <= budget), default=0)


def test_whole_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    out = token_counts.token_counts(docs, limit=200).collect()
    assert len(out) == docs.count()
    for r in out:
        text = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text)))
        assert r.half_tokens == len(library.encode(text[: len(text) // 2]))
        assert r.over_limit == (r.n_tokens > 200) and (r.cut_chars is None) == (not r.over_limit)
        if r.over_limit:
            assert len(library.encode(text[: r.cut_chars])) <= 200 < min(len(library.encode(text[:i])) for i in range(r.cut_chars + 1, min(len(text), r.cut_chars + 30) + 1))


def test_very_long_text(library):
    text = "The quick brown fox 日本 12.5\n" * 400_000
    prefix = token_counts.counter().prefix(text)
    assert len(text) > 10_000_000 and prefix.total == len(library.encode(text))
    assert prefix.at(1000) == len(library.encode(text[:1000])) and len(library.encode(text[: prefix.cut(500)])) <= 500 < len(library.encode(text[: prefix.cut(500) + 1]))


def test_edge_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "two words", 5), (3, "two words", 5), (None, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = [(r.doc_id, r.n_bytes, r.over_limit) for r in token_counts.token_counts(docs).collect()]
    assert sorted(out, key=str) == sorted([(1, 0, False), (2, 0, False), (3, 9, False), (3, 9, False), (None, 1, False)], key=str)
    assert token_counts.token_counts(docs.limit(0)).count() == 0
    prefixes = {r.doc_id: r.prefix_tokens for r in token_counts.prefix_counts(docs).collect()}
    assert prefixes[1] == prefixes[2] == [] and len(prefixes[3]) == 9
