"""Near-duplicates against brute force, redaction, and the stages on a small corpus."""

import random

import pytest

from tidemark.llm import near_duplicates as nd
from tidemark.llm import secret_scan
from pyspark.sql import functions as F


def jaccard(a, b):
    def runs(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    return len(runs(a) & runs(b)) / len(runs(a) | runs(b))


def near(rng, text, share):
    words = text.split()
    for _ in range(int(len(words) * share)):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("shard", [1024, 4])
def test_groups_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(nd, "SHARD", shard)
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(3000)]
    docs = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 300]))) for _ in range(60)]
    docs += [near(rng, rng.choice(docs[20:]), s) for s in (0, 0.004, 0.01, 0.02, 0.06, 0.1, 0.3) for _ in range(8)]
    docs += [docs[0]] * 5 + ["", "", None]
    rows = list(enumerate(docs))
    got = {r.doc_id: r.group_id for r in nd.groups(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id int")).collect()}
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    unclear = set()
    for i in range(len(docs)):
        for j in range(i):
            s = jaccard(docs[i] or "", docs[j] or "")
            if s >= 0.8:
                a, b = sorted((top(i), top(j)))
                root[b] = a
            if 0.72 < s < 0.95:
                unclear |= {i, j}
    wrong = [i for i in range(len(docs)) if got[i] != top(i)]
    assert not [i for i in wrong if i not in unclear and shard == 1024]
    assert len(wrong) <= 2


def test_redact(spark):
    live = "f3ef4d6b2755a36d7d9c25bd"
    rows = [(1, f"a token={live} é {live}", "x", 5), (2, "plain", "y", 5), (3, None, "y", None), (None, "password: Abcdef123456789", "z", 9)]
    out = {r.doc_id: r for r in secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), F.col("doc_id"), F.col("source")).collect()}
    assert out[1].text == "a [SECRET] é [SECRET]" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "plain" and out[3].text is None and out[None].text == "[SECRET]"


def test_stages(spark, sf, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for i, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert tuple(out.columns) == p.COLUMNS, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.4 * len(ids), name
        ids = now
    again = {(r.doc_id, r.taken) for r in p.run(spark, sf).collect()}
    assert again == {(r.doc_id, r.taken) for r in docs.collect()}
    assert p.run.__doc__ and p.ORACLE_SQL is None


def test_empty_stages(spark, sf):
    import corpus_pipeline as p

    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf).count() == 0


def brute(rows):
    """Smallest document of each group, by all pairs."""
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in rows:
        for j, y in rows:
            if j < i and top(i) != top(j) and jaccard(x, y) >= 0.8:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i, _ in rows}


def test_lone_pairs_in_an_oversized_family(spark, monkeypatch):
    monkeypatch.setattr(nd, "SHARD", 2)
    monkeypatch.setattr(nd, "BLOCK", 16, raising=False)
    rng = random.Random(5)
    lines = [" ".join(f"line{i}word{j}" for j in range(10)) for i in range(40)]
    family = [sorted(rng.sample(range(40), 30)) for _ in range(150)]
    family += [lines_of[:k] + lines_of[k + 1 :] for lines_of in family[::7] for k in [rng.randrange(30)]]
    rows = [(d, " and so it goes ".join(lines[i] for i in chosen)) for d, chosen in enumerate(family)]
    want = brute(rows)
    got = {r.doc_id: r.group_id for r in nd.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(family) > len(set(want.values())) > 100
    assert got == want


def test_repeated_lines_and_far_fingerprints(spark):
    rng = random.Random(9)
    rows = []
    for d in range(0, 60, 2):
        text = " ".join(f"t{rng.randrange(10**6)}" for _ in range(300))
        line = " ".join(f"r{rng.randrange(10**6)}" for _ in range(10))
        rows += [(d, f"{text} {line}"), (d + 1, " ".join([text, *[line] * 30]))]
    got = {r.doc_id: r.group_id for r in nd.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}
    assert nd.shard_links([(1, 0, b"s" * nd.SKETCH), (2, (1 << nd.RADIUS) - 1, b"s" * nd.SKETCH)])[0] == [(2, 1)]
    assert nd.shard_links([(1, 0, b"s" * nd.SKETCH), (2, (1 << nd.RADIUS + 1) - 1, b"s" * nd.SKETCH)])[0] == []


def test_fingerprints_at_the_bound_are_within_the_radius():
    """Random sets that share just 0.8 of their union, or a little more: how many pairs the tree would not propose."""
    import numpy as np

    from tidemark.llm.simhash import fold

    rng = np.random.default_rng(3)
    some = lambda n: rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + rng.integers(0, 2, n, np.uint64)
    for union, allowed in ((5, 2), (10, 0), (40, 0), (200, 0)):
        far = 0
        for _ in range(1500):
            common = int(np.ceil(0.8 * union))
            rest = union - common
            shared, left = some(common), some(rest // 2)
            x, y = np.concatenate([shared, left]), np.concatenate([shared, some(rest - rest // 2)])
            far += ((fold(x) ^ fold(y)) & ((1 << 64) - 1)).bit_count() > nd.RADIUS
        assert far <= allowed, union
