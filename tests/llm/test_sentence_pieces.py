"""Encodings and decodings against the library, on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import sentence_pieces as sp

DOCS = "doc_id long, text string, lang string, ids string, word string"
ALPHABET = "ab  \n\t▁é世🙂.,-0 1 \x00<s>_'\"\r"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sp.MODEL))


def texts():
    rng = random.Random(3)
    some = ["", None, " ", "  ", "▁", "a▁", " a  b ", "<s></s><unk>", "\n\n\n", "x" * 70, "-" * 5000, "word " * 3000, " " * 3000, "é" * 2000, "the the the"]
    return some + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(400)]


def test_ids_and_texts_are_those_of_the_library(spark, model):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x", "clash", "clash") for i, t in rows], DOCS).repartition(3)
    got = {r.doc_id: r for r in sp.decode(sp.encode(docs)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        assert (list(got[i].ids), got[i].text) == (ids, model.decode(ids)), t


@pytest.mark.parametrize("most", [0, 2, 10_000])
def test_words_in_the_table_or_out_of_it_are_alike(spark, model, monkeypatch, most):
    monkeypatch.setattr(sp.frequent, "__defaults__", (most,))
    rows = [(i, f"alpha beta {'gamma' * (i % 3)} delta{i % 7}  ▁ {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: list(r.ids) for r in sp.encode(docs).collect()} == {i: model.encode(t, add_bos=True, add_eos=True) for i, t in rows}


def test_the_table_holds_each_shared_word_once(spark, model):
    docs = spark.createDataFrame([(i, "shared words here" if i % 2 else f"lone{i}") for i in range(40)], "doc_id long, text string").repartition(4, "doc_id")
    rows = sp.word_table(docs).collect()
    assert sorted(r.word for r in rows) == ["here", "shared", "words"]
    assert all(list(r.ids) == model.encode(r.word) for r in rows)
    table = sp.frequent(sp.word_table(docs), 3)
    assert len(table.number) == 3 and len(sp.frequent(sp.word_table(docs), 2).number) == 0


def test_words_and_positions():
    assert sp.words_of("") == [] and sp.words_of("a b") == ["a", "b"] and sp.words_of(" a  b ") == [" a", " b", ""] and sp.words_of(" ") == [" "]
    assert sp.words_of("a▁b") == ["a", "b"]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "x"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in sp.digest(docs).collect()) == [("1", 4), ("1", 4), ("None", 2), ("None", 3)]
    assert sp.digest(docs.where("false")).collect() == []
    assert [r.text for r in sp.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).orderBy("doc_id").collect()] == ["", ""]


def test_whole_table_against_the_library(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = model.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())
    assert {r.doc_id: tuple(r[1:]) for r in sp.digest(docs).collect()} == want


def test_a_very_long_text(spark, model):
    text = "stretch of words, " * 60_000 + "y" * 200_000
    (row,) = sp.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    ids = model.encode(text, add_bos=True, add_eos=True)
    assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
