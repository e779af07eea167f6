"""The bit-sliced filter: no false negatives, corrected counts, held-out accuracy and odd tables."""

import random

import numpy as np

from tidemark.llm import language_id
from tidemark.llm.base import remainder
from pyspark.sql import functions as F


def filter_of(grams_by_language):
    masks = np.zeros(language_id.ROWS, np.uint8)
    for i, grams in enumerate(grams_by_language.values()):
        for p in language_id.positions(np.array(sorted(grams), np.uint64)):
            masks[p] |= np.uint8(1 << i)
    return language_id.LanguageFilter(list(grams_by_language), [masks])


def test_counts_equal_sets_up_to_false_positives():
    rng = random.Random(3)
    words = {lang: ["".join(rng.choice(letters) for _ in range(6)) for _ in range(40)] for lang, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"))}
    known = {lang: set(language_id.gram_hashes(" ".join(w)).tolist()) for lang, w in words.items()}
    model = filter_of(known)
    for lang in words:
        for _ in range(20):
            text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 30)))
            grams = language_id.gram_hashes(text)
            counts, n = model.counts(text)
            assert n == len(grams)
            for got, own in zip(counts, known.values()):
                exact = sum(g in own for g in grams.tolist())
                assert abs(got - exact) <= 0.5  # the filter is nearly empty: hardly any false positives
            assert model.predict(text)[0] == lang


def test_a_full_filter_is_corrected():
    rng = np.random.default_rng(1)
    model = language_id.LanguageFilter(["aa", "bb"], [(rng.random(language_id.ROWS) < 0.3).astype(np.uint8)])
    assert abs(model.false_positive[0] - 0.3**language_id.HASHES) < 0.01
    counts, n = model.counts("".join(map(chr, rng.integers(200, 60000, 3000) // 2048 * 8 + rng.integers(97, 50000, 3000) % 7919 + 200)))
    assert counts[0] < 0.05 * n


def test_undetermined():
    model = filter_of({"aa": {1}})
    for text in (None, "", "  ", "123 456 !?", "😀"):
        assert model.predict(text) == (language_id.UNDETERMINED, 0.0)
    assert model.predict("unseen words") == ("aa", 0.0)
    assert language_id.LanguageFilter([], []).predict("words") == ("und", 0.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs, remainder(3) != 1)
    truth = docs.where((remainder(3) == 1) & F.col("lang").isNotNull()).select("doc_id", "lang", "n_chars")
    rows = language_id.predict(docs, model).join(truth, "doc_id").where("lang_pred <> 'und'").collect()
    right = sum(r.lang == r.lang_pred for r in rows) / len(rows)
    assert len(rows) > 100 and right > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (language_id.train(d, remainder(3) != 1) for d in (docs, docs.repartition(7)))
    assert a.languages == b.languages and all((x == y).all() for x, y in zip(a.masks, b.masks))


def test_edge_tables(spark):
    docs = spark.createDataFrame([(1, None, "aa", 1), (2, "", "aa", 1), (3, "words of aa", "aa", 1), (3, "words of aa", "aa", 1), (4, "other text", None, 1), (None, "x", "bb", 1)], "doc_id long, text string, lang string, score int")
    model = language_id.train(docs, F.lit(True))
    out = language_id.predict(docs, model).collect()
    assert len(out) == 6 and {r.lang_pred for r in out} <= {"aa", "bb", "und"}
    empty = language_id.train(docs.limit(0), F.lit(True))
    assert empty.languages == [] and language_id.predict(docs.limit(0), empty).count() == 0


def test_more_languages_than_a_mask_word_has_bits(spark):
    rng = random.Random(8)
    alphabets = {f"l{i:03d}": [chr(0x4E00 + 40 * i + j) for j in range(40)] for i in range(150)}
    rows = [(n, "".join(rng.choice(letters) for _ in range(60)), lang) for n, (lang, letters) in enumerate(list(alphabets.items()) * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    assert len(model.languages) == 150 and len(model.masks) == 3
    assert all(r.lang == r.lang_pred for r in language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect())


def test_training_equals_counting_in_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs, remainder(3) != 1)
    from collections import Counter

    counts: dict = {}
    for r in docs.where(remainder(3) != 1).where("lang IS NOT NULL AND text IS NOT NULL").collect():
        counts.setdefault(r.lang, Counter()).update(language_id.gram_hashes(r.text).tolist())
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    rates = {lang: {g: n / total[lang] for g, n in c.items() if n > 1 or total[lang] < language_id.MANY_GRAMS} for lang, c in counts.items()}
    most: dict = {}
    for own in rates.values():
        for g, rate in own.items():
            most[g] = max(most.get(g, 0), rate)
    want = np.zeros(language_id.ROWS, np.uint64)
    for i, lang in enumerate(sorted(counts)):
        kept = np.array([g for g, rate in rates[lang].items() if rate >= language_id.SHARE * most[g]], np.uint64)
        for p in language_id.positions(kept):
            want[p] |= np.uint64(1 << i)
    assert model.languages == sorted(counts) and (model.masks[0].astype(np.uint64) == want).all()
