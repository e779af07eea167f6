"""The audit against plain Python: masks, all orders, and duplicates whatever the hashes say."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mask int, blocks string"
LABELS = "doc_id long, quality int, toxic int"
LONG = "word " * 300 + "different " * 50
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, None), (3, LONG, ""), (4, LONG + "x", "b"), (5, None, "a"), (6, "", "b"), (7, " ".join(f"w{i}" for i in range(250)), "a"),
    (8, " ".join(f"W{i}" for i in range(250)), "b"), (9, "cost $5 " + " ".join(f"v{i}" for i in range(250)), "b"), (None, LONG, "a"), (None, "only here", None), (10, "é" * 5000, "a"), (11, "é" * 5000, "b"), (12, "é" * 4999 + "e", "b"),
    (13, "A" * 200_000 + "b", "hot"), (14, "A" * 200_000 + "c", "hot"), (15, "A" * 200_000 + "b", "hot"), (16, "x\x0by\x0cz q " * 100, "a"), (7, " ".join(f"w{i}" for i in range(250)), "a"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (5, None, 1), (9, 1, None), (None, 1, 1), (99, 1, 1), (15, 1, 0)]


def plain(rows, marks):
    """The counts straight from the definition."""
    seen, out = {}, {}
    for i, t, _ in rows:
        t = t or ""
        if i is not None:
            seen[t] = min(seen.get(t, i), i)
    def failed(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        checks = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and seen.get(t, i) < i}
        return {k for k, v in checks.items() if v}
    docs = [(s or "", failed(i, t or ""), any(m[0] == i and m[1] == 1 for m in marks if i is not None), any(m[0] == i and m[2] == 1 for m in marks if i is not None)) for i, t, s in rows]
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for d in own:
                if first := next((f for f in order if f in d[0]), None):
                    shares[first] += 1
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [d for d in own if f in d[0] and not d[0] & before]
                out[part, "".join(order), k + 1] = (
                    sum(not d[0] & (before | {f}) for d in own), len(gone), sum(f in d[0] and bool(d[0] & before) for d in own), sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone), shares[f])
    return out


def audited(spark, rows, marks):
    docs = spark.createDataFrame([(i, t, "x", s, 0, 5, "clash") for i, t, s in rows], DOCS)
    got = fa.filter_audit(docs, spark.createDataFrame(marks, LABELS)).collect()
    assert len({r[:3] for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got}


def test_every_order_equals_the_definition(spark):
    assert audited(spark, ROWS, MARKS) == plain(ROWS, MARKS)


@pytest.mark.parametrize("bits", [0, 1])
def test_hashes_that_collide_change_nothing(spark, monkeypatch, bits):
    """With hashes of one value or two, different texts of a length share a signature, and texts decide."""
    whole = fa.features

    def weak(docs, among=None):
        df = whole(docs) if among is None else whole(docs.withColumn("_", F.lit(0)), None).join(docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("_s")).distinct(), F.expr("doc_id <=> _id AND part = _s AND chars = length(text)")).drop("_id", "_s")
        return df.withColumns({"signature": F.pmod(F.hash(F.col("blocks")[0]), F.lit(1 + bits)).cast("long"), "blocks": F.array(F.lit(0).cast("long"))})
    # Distinct (id, text, source) rows only: the weak stand-in can't tell repeated rows apart.
    rows = list(dict.fromkeys(r for r in ROWS if r[0] is not None))
    docs = spark.createDataFrame([(i, t, "x", s, 0, 5, "clash") for i, t, s in rows], DOCS)
    monkeypatch.setattr(fa, "features", weak)
    held = fa.checkpoint(weak(docs))
    got = sorted((r.doc_id, r.part, r.again) for r in fa.duplicates(docs, held).collect())
    least = {}
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", i), i)
    assert got == sorted((i, s or "", i > least[t or ""]) for i, t, s in rows)


def test_refinement_keeps_only_texts_that_repeat(spark):
    texts = ["a" * 3000, "a" * 3000, "a" * 2999 + "b", "b" * 3000, "unique", "", "", "c" * 70_000 + "1", "c" * 70_000 + "2"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    left = fa.refined(fa.checkpoint(fa.features(docs))).collect()
    assert sorted((r.chars, r.n) for r in left) == [(0, 2), (3000, 2)]


def test_a_hot_text_and_empty_tables(spark):
    rows = [(i, "same text", "s") for i in range(400)]
    got = audited(spark, rows, [])
    assert got["s", "EABCD", 1][1] == 399 and got["s", "EABCD", 1][0] == 1
    assert audited(spark, [], []) == {}


def test_blocks_cover_a_text_and_end_where_it_ends():
    assert len(fa.block_hashes("")) == 1 and len(fa.block_hashes("x" * 256)) == 1 and len(fa.block_hashes("x" * 257)) == 2
    assert fa.block_hashes("x" * 5000)[:2] == fa.block_hashes("x" * 4096 + "y")[:2]


def test_whole_table_against_plain_python(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in fa.filter_audit(docs, labels).collect()}
    assert got == plain([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
