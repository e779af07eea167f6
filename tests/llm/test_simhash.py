"""BK-trees, shards and components against brute force."""

import random

import numpy as np
import xxhash

from tidemark.llm import simhash


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(values, radius):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(values))]


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    words = ["Alpha", "béta", "gamma", "delta", "eps", "zeta", "eta"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 30, 200])))) for i in range(150)]
    docs += [(1000 + i, t + rng.choice(["", " tail", "\t"])) for i, t in docs[:60]] + [(2000, None), (2001, " \n"), (2001, " \n")]
    out = simhash.link(spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, fp string")).collect()
    prints = {i: plain_fingerprint(t or "") for i, t in docs}
    ids = [i for i, _ in docs]
    tops = plain_components([prints[i] for i in ids], 2)
    least = {}
    for i, t in zip(ids, tops):
        least[t] = min(i, least.get(t, i))
    want = sorted((i, f"{prints[i]:016x}", least[t]) for i, t in zip(ids, tops))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in out) == want


def test_hot_shards_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)
    rng = random.Random(9)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 300:
        v = rng.choice(sorted(values))
        for _ in range(rng.choice([1, 2, 3, 5])):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(values)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    links = simhash.forest_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2).collect()
    at = {v: i for i, v in enumerate(signed)}
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        assert (int(r.a) ^ int(r.b)) & (2**64 - 1) and bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2
        root[top(at[r.a])] = top(at[r.b])
    want = plain_components(values, 2)
    got = [top(i) for i in range(len(values))]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_empty_table(spark):
    assert simhash.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
