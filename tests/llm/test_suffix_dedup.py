"""Suffix arrays and removals against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as sd


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 60))]
        assert sd.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    s = [rng.randint(1, 1 << 40) for _ in range(500)] * 2
    s = np.unique(s, return_inverse=True)[1] + (1 << 21)
    assert sd.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def plain(docs):
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        cover = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                cover[p : p + 100] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out[i] = (len(data), int(cover.sum()), spans, hashlib.sha256(bytes(b for b, c in zip(data, cover) if not c)).hexdigest())
    return out


def corpus(rng):
    letters = "abcdefgh é日"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    docs = [text(rng.choice([0, 50, 99, 100, 101, 400, 900])) for _ in range(40)]
    passage = text(260)
    for _ in range(60):
        kind, base = rng.randrange(5), rng.choice(docs[:40])
        if kind == 0:
            docs.append(base)
        elif kind == 1:
            docs.append(text(rng.randint(0, 150)) + passage[rng.randint(0, 90) :] + text(rng.randint(0, 150)))
        elif kind == 2 and base:
            at = rng.randrange(len(base))
            docs.append(base[:at] + "X" + base[at + 1 :])
        elif kind == 3:
            docs.append(rng.choice("ab") * rng.choice([100, 150, 350]))
        else:
            docs.append(text(30) + base + base[:120] + "xyxyxy" * 40)
    docs += [None, "q" * 700 + text(20) + "q" * 300]
    rng.shuffle(docs)
    return [(3 * i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("seed", "group", "shard"), [(1, 2000, 1 << 20), (2, 2000, 500), (3, 3, 1 << 20)])
def test_removals_equal_brute_force(spark, monkeypatch, seed, group, shard):
    monkeypatch.setattr(sd, "GROUP", group)
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    docs = corpus(random.Random(seed))
    out = sd.dedup(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, start int").repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == plain(docs)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out)


def test_many_rows_of_one_id_or_none(spark):
    """Rows of one id are ordered by a hash of their text: what goes is what repeats, in number, whichever row comes first."""
    from xxhash import xxh64_intdigest

    rng = random.Random(5)
    shared = ["".join(rng.choice("abcdefghij é") for _ in range(150)) for _ in range(20)]
    rows = [(rng.choice([None, None, 7, i]), "".join(rng.choice("klmnopq") for _ in range(rng.randint(0, 130))) + rng.choice([*shared, ""]) + str(i)) for i in range(2500)]
    out = sd.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    order = lambda r: (r[0] is not None, r[0] or 0, signed(xxh64_intdigest(r[1].encode(), 42)))
    want = plain([(i, r[1]) for i, r in enumerate(sorted(rows, key=order))])
    ids = [r[0] for r in sorted(rows, key=order)]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str) == sorted(((ids[i], *v) for i, v in want.items()), key=str)


def test_large_groups_go_through_every_length_of_gram(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP", 2)
    rng = random.Random(6)
    core = "".join(rng.choice("abcdefghijkl") for _ in range(99))
    text = lambda n: "".join(rng.choice("mnopqrst") for _ in range(n))
    docs = [(i, text(90) + core[a : a + n] + text(90)) for i in range(60) for a, n in [rng.choice([(0, 33), (20, 66), (5, 85), (2, 95), (0, 99)])]]
    docs += [(100 + i, text(40) + core + c + text(40)) for i, c in enumerate("xyxzx")]
    out = sd.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == plain(docs)
    assert sum(r.n_removed for r in out) > 0


def test_very_long_text(spark):
    rng = random.Random(7)
    body = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(5_000_000))
    out = {r.doc_id: r for r in sd.dedup(spark.createDataFrame([(1, body + body), (2, body[100:300])], "doc_id long, text string")).drop("kept").collect()}
    assert (out[1].n_bytes, out[1].n_removed, out[1].n_spans) == (10_000_000, 5_000_000, 1) and out[2].n_removed == 200


def test_edge_rows(spark):
    line = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = [(1, line), (1, line), (2, line), (None, line + "z"), (5, None), (6, ""), (7, "short")]
    out = sorted(((r.doc_id, r.n_removed) for r in sd.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    n = len(line)
    assert out == sorted([(1, n), (1, n), (2, n), (None, 0), (5, 0), (6, 0), (7, 0)], key=str)
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def compared(spark, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()}
    want = plain(rows)
    assert [i for i in want if got[i] != want[i]] == [] and len(got) == len(want)
    return sum(w[1] for w in want.values())


def test_texts_that_repeat_only_inside_themselves(spark):
    """Every period from 1 to 99, about the lengths at which the first window repeats."""
    rng = random.Random(5)
    texts = []
    for p in range(1, 100):
        for n in (100, 99 + p, 100 + p, 101 + p, 150, 199, 200, 250, 331, 400):
            unit = "".join(rng.choice("abcdefghij") for _ in range(p))
            texts.append("".join(chr(97 + rng.randrange(26)) for _ in range(rng.randrange(60))) + (unit * (n // p + 1))[:n] + str(rng.random()))
    assert compared(spark, list(enumerate(texts))) > 100_000


def runs(n):
    rng = random.Random(6)
    return [(i, "".join(rng.choice("xyz ") for _ in range(rng.randrange(30))) + rng.choice("ab-") * rng.choice([90, 99, 100, 101, 130, 200, 350]) + str(i)) for i in range(n)]


def test_three_thousand_runs_of_a_byte(spark):
    compared(spark, runs(3000))


@pytest.mark.parametrize("group", [1, 2, 5])
def test_the_size_of_groups_changes_nothing(spark, monkeypatch, group):
    monkeypatch.setattr(sd, "GROUP", group)
    compared(spark, runs(200) + [(5000 + i, ("".join(chr(97 + (i * k) % 26) for k in range(i + 1)) * 400)[: 150 + 2 * i]) for i in range(90)])


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, size):
    compared(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{size}/documents.parquet").collect()])


def test_own_repeats_are_those_within_a_window():
    rng = random.Random(8)
    for _ in range(150):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randrange(80))) + (bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 120))) * 9)[: rng.randrange(600)] + bytes(rng.choice(b"xyz") for _ in range(rng.randrange(80)))
        near = {i for p in range(1, 100) for i in range(p, len(data) - 99) if data[i : i + 100] == data[i - p : i - p + 100]}
        found = sd.own_repeats(data, sd.gram_hashes(np.frombuffer(data, np.uint8))) if len(data) >= 100 else []
        assert {i for a, b in found for i in range(a, b - 99)} == near
