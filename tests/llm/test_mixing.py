"""Targets against a plain loop, and the balance of the choices."""

import random

import numpy as np

from tidemark.llm import mixing


def plain_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]} if open_ else set()
        if not over:
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(0, 900, 500)
    moved = mixing.flight(p, size, rng)
    assert ((moved > 0) & (moved < 1)).sum() <= 2
    assert abs(moved.sum() - p.sum()) < 1e-6 and abs(moved @ size - p @ size) < 1e-4
    same = mixing.flight(np.full(10, 0.25), np.full(10, 7), rng)
    assert ((same > 0) & (same < 1)).sum() <= 1 and abs(same.sum() - 2.5) < 1e-9


def test_flight_keeps_each_mean():
    p, size = np.array([0.2, 0.5, 0.9, 0.4]), np.array([1, 5, 9, 2])
    mean = np.mean([mixing.landing(mixing.flight(p, size, np.random.default_rng(i)), size) for i in range(3000)], axis=0)
    assert np.abs(mean - p).max() < 0.25
    moved = np.mean([mixing.flight(p, size, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.abs(moved - p).max() < 0.03


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 50)
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "é", "日", "b", None, ""])
        rows.append((i, "w " * rng.choice([1, 3, 20, 50]) if i % 50 else rng.choice([None, "", " \t"]), source, 1.0))
    rows += [(1, "w w", "a", 2.0), (None, "w", "b", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    sizes, taken, target = {}, {}, {}
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want = plain_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 50


def test_rows_of_one_id_or_none(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 50)
    rows = [(None, "w " * (i % 40 + 1), "a") for i in range(900)] + [(7, "w w w", "a")] * 2500 + [(i, "w " * 9, "b") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(df.repartition(9)).collect()), key=str)
    for source in "ab":
        own = [r for r in out if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= 40


def test_ranks_of_many_sources(spark):
    names = [f"s{i * 7919 % 5000}" for i in range(3000)] + ["é", "日本", "", None]
    got = {r.source: r.group for r in mixing.ranked(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")).collect()}
    want = sorted({n for n in names if n is not None}, key=lambda n: n.encode()) + [None]
    assert got == {n: i + 1 for i, n in enumerate(want)}


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
