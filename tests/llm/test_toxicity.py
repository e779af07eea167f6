"""The lexicon: folding, exceptions, length, held-out accuracy and odd tables."""

from tidemark.llm import toxicity
from tidemark.llm.base import remainder
from pyspark.sql import functions as F


def test_fold_undoes_disguises():
    assert toxicity.fold("Z0rp") == toxicity.fold("zоrр") == toxicity.fold("ZORP") == "zorp"
    assert toxicity.fold("$na1k3") == "snaike"
    assert toxicity.fold("ｚｏｒｐ") == toxicity.fold("𝐳𝐨𝐫𝐩") == toxicity.fold("z\u0335o\u0301\u0301\u0301rṗ".replace("o", "ọ")) == toxicity.fold("z\u200bo\u00adrp") == "zorp"
    assert toxicity.fold("so z o r p!") == "so zorp!" and toxicity.fold("zorp|ng z!p") == "zorplng zip" and toxicity.fold("Größe é") == "größe é" and toxicity.fold("Z.0-r_p") == "zorp" and toxicity.fold("a b c") == "a b c"
    assert toxicity.fold("баd 6ad 8ad 9ag") == "bad gad bad gag"


def test_hits_and_exceptions():
    lexicon = toxicity.Lexicon({"zorp": 2.0, "glub": 1.0}, frozenset({"zorpton"}), (-4.0, 2.0, 1.0))
    automaton = lexicon.automaton()
    hits = lambda t: lexicon.features(t, automaton)[0]
    assert hits("a zorp and a Z0RP, glub") == 3
    assert hits("zorpton Zorpton") == 0
    assert hits("zorpton zorp") == 1
    assert hits("") == 0


def test_exception_phrases_of_several_words():
    lexicon = toxicity.Lexicon({"zorp": 2.0}, frozenset({"the zorp river", "zorp bay"}))
    automaton = lexicon.automaton()
    hits = lambda t: lexicon.features(t, automaton)[0]
    assert [hits(t) for t in ("the zorp river", "The Z0RP river zorp", "see zorp bay", "zorp boat", "a zorp river")] == [0, 1, 0, 1, 1]


def test_learned_exceptions_and_weights_equal_plain_python(spark):
    """The whole of learning again, with sets and loops: pieces, odds, contexts, exceptions."""
    import math
    import random

    rng = random.Random(3)
    plain = ["river", "stone", "light", "under", "green", "house"]
    rows = []
    for i in range(240):
        words = [rng.choice(plain) for _ in range(12)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(12)] = "zorpish"
        elif i % 3 == 0:
            words[4:6] = ["mount", "zorpish"] if i % 5 else ["zorpishness", "stone"]
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.train(docs.drop("toxic"), docs.drop("text"), F.lit(True))
    n = [sum(r[2] == y for r in rows) for y in (0, 1)]
    odds = lambda c: math.log((c[1] + 0.5) / (n[1] + 1)) - math.log((c[0] + 0.5) / (n[0] + 1))
    counts: dict = {}
    for _, text, y in rows:
        for g in {w[a : a + k] for w in text.split() for k in range(4, 9) for a in range(len(w) - k + 1)}:
            counts.setdefault(g, [0, 0])[y] += 1
    least = max(min(4, max(3, n[1] // 10)), n[1] // 100)
    entries = {g: c for g, c in counts.items() if c[1] >= least and odds(c) >= toxicity.ODDS}
    kept = {g for g in entries if not any(h != g and h in g and entries[h][1] * 0.9 <= entries[g][1] for h in entries)}
    assert set(lexicon.weights) == kept
    assert all(abs(lexicon.weights[g] - odds(entries[g])) < 1e-9 for g in kept)
    around: dict = {}
    for _, text, y in rows:
        words = text.split()
        near = set()
        for i, w in enumerate(words):
            if any(g in w for g in kept):
                near |= {p for p in (w, " ".join(words[max(0, i - 1) : i + 1]), " ".join(words[i : i + 2])) if p not in kept}
        for p in near:
            around.setdefault(p, [0, 0])[y] += 1
    assert lexicon.exceptions == {p for p, c in around.items() if c[0] >= toxicity.SUPPORT and odds(c) <= 0}
    a, b, c = lexicon.curve
    for r in toxicity.score(docs, lexicon).collect():
        folded = toxicity.fold(rows[r.doc_id][1])
        void = [(m, m + len(p)) for p in lexicon.exceptions for m in range(len(folded)) if folded.startswith(p, m)]
        found = [lexicon.weights[g] for g in kept for m in range(len(folded)) if folded.startswith(g, m) and not any(x <= m and m + len(g) <= y for x, y in void)]
        total = sum(found)
        want = 1 / (1 + math.exp(-(a + b * math.log1p(total) + c * math.log1p(1000 * total / max(100, len(folded))))))
        assert r.hits == len(found) and abs(r.score - want) < 1e-9


def test_the_curve_is_where_the_likelihood_is_flat():
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.random((400, 2)) * 3
    y = (rng.random(400) < 1 / (1 + np.exp(3 - 2 * x[:, 0]))).astype(float)
    w = np.array(toxicity._logistic(x, y))
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    gradient = np.column_stack([np.ones(400), x]).T @ (y - p) - np.array([1e-6, 0.05, 0.05]) * w
    assert np.abs(gradient).max() < 1e-3


def test_below_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(1, "zorp " * 9, 5, 0.5), (2, None, 6, 0.5), (None, "fine", 7, 0.5)], "doc_id long, text string, hits long, score double")
    lexicon = toxicity.Lexicon({"zorp": 3.0}, frozenset(), (-4.0, 2.0, 1.0))
    out = toxicity.below(docs, lexicon, 0.3)
    assert out.columns == docs.columns and sorted(r.hits for r in out.collect()) == [6, 7]


def test_very_long_text():
    lexicon = toxicity.Lexicon({"zorp": 2.0}, frozenset())
    assert lexicon.features("zọrp a b c word " * 650_000, lexicon.automaton())[0] == 650_000


def test_score_falls_with_length_and_rises_with_weight():
    lexicon = toxicity.Lexicon({"zorp": 2.0}, frozenset(), (-4.0, 1.0, 1.0))
    automaton = lexicon.automaton()
    score = lambda t: lexicon.score(t, automaton)[1]
    assert score("zorp " + "word " * 50) > score("zorp " + "word " * 500) > score("word " * 500)
    assert score("zorp zorp " + "word " * 50) > score("zorp " + "word " * 50)


def test_voided_hits_equal_brute_force():
    lexicon = toxicity.Lexicon({"aba": 1.0, "bab": 1.0}, frozenset({"babab", "caba"}))
    automaton = lexicon.automaton()
    import itertools

    for letters in itertools.product("abc", repeat=7):
        text = "".join(letters)
        spots = lambda words: [(i, i + len(w)) for w in words for i in range(len(text)) if text.startswith(w, i)]  # noqa: E731,B023
        void = spots(lexicon.exceptions)
        want = sum(not any(a <= s and e <= b for a, b in void) for s, e in spots(lexicon.weights))
        assert lexicon.features(text, automaton)[0] == want, text


def _auc(pairs):
    good = sorted(s for s, y in pairs if not y)
    import bisect

    bad = [s for s, y in pairs if y]
    return sum(bisect.bisect_left(good, s) + bisect.bisect_right(good, s) for s in bad) / (2 * len(bad) * len(good))


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.train(docs, labels, remainder(4) != 2)
    truth = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    scored = toxicity.score(docs, lexicon).where(remainder(4) == 2).join(truth, "doc_id").select("score", "toxic").collect()
    assert _auc([(r.score, r.toxic) for r in scored]) > 0.9
    clean = [r.score for r in scored if not r.toxic]
    assert sum(s >= 0.3 for s in clean) / len(clean) < 0.05


def test_training_uses_only_the_allowed_rows(spark):
    rows = [(i, "zorpish words here" if i % 2 else "plain words here") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    allowed = toxicity.train(docs, labels, F.col("doc_id") < 40)
    other = toxicity.train(docs, labels.withColumn("toxic", F.when(F.col("doc_id") < 40, F.col("toxic")).otherwise(1 - F.col("toxic"))), F.col("doc_id") < 40)
    assert allowed == other and any("zorp" in w for w in allowed.weights)


def test_edge_tables(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "zorp", 9), (3, "zorp", 9), (None, "x", 9)], "doc_id long, text string, hits int")
    labels = spark.createDataFrame([(1, None), (3, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels, F.lit(True))
    out = toxicity.score(docs, lexicon).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    nothing = toxicity.train(docs.limit(0), labels.limit(0), F.lit(True))
    assert not nothing.weights and toxicity.score(docs.limit(0), nothing).count() == 0
    assert all(r.score < 0.3 for r in toxicity.score(docs, nothing).collect())
