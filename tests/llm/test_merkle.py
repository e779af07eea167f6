"""The manifest against plain Python: leaves, trees, proofs, tampering."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, hash string, index int"
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def beside(levels, i, fanout):
    out = []
    for row in levels[:-1]:
        first = i - i % fanout
        out.append(("".join(row[first:i]), "".join(row[i + 1 : first + fanout])))
        i //= fanout
    return out


def plain(rows, fanout=8):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for k in order:
        langs[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: tree([leaf(r) for r in langs[k]], fanout) for k in order}
    top = tree([trees[k][-1][0] for k in order], fanout)
    out = []
    for j, k in enumerate(order):
        for i, r in enumerate(langs[k]):
            proof = beside(trees[k], i, fanout) + beside(top, j, fanout)
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(r[:4] + ("".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]),)) if hit else leaf(r)
            for b, a in proof:
                h = H(b + h + a)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], H("".join(b + a for b, a in proof)), h, h == top[-1][0]))
    return out


def key(row):
    return [(x is not None, x) for x in row]


def digests(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], DOCS)
    return sorted((tuple(r) for r in merkle.digest(docs).collect()), key=key)


CASES = {
    "one": [(1, "s", "en", 3, "Abc")],
    "lone languages": [(i, "s", f"l{i:02}", 1, "A") for i in range(20)],
    "null language": [(1, None, None, None, None), (2, "s", "", 0, ""), (3, "s", "a", 1, "é")],
    "nine": [(i, "s", "en", 1, f"T{i}") for i in range(9)],
    "sixty-five of one": [(i * 7 % 65, "s", "en", 1, f"T{i}") for i in range(65)] + [(100, "s", "de", 1, "x")],
    "repeats and null ids": [(5, "s", "en", 1, "Same")] * 12 + [(None, "s", "en", 1, "Same")] * 9 + [(5, "s", "en", 1, "other"), (9_007_199_254_740_993, "t", "en", 1, "Big")],
    "bytewise order": [(i, "s", x, 1, "Q") for i, x in enumerate(["z", "é", "Z", "aa", "a", "世", "", None])],
}


@pytest.mark.parametrize("name", CASES)
def test_digest_equals_the_definition(spark, name):
    assert digests(spark, CASES[name]) == sorted(plain(CASES[name]), key=key)


def test_small_superblocks_recurse_to_the_same_tree(spark):
    """Buckets of two levels of two: seven rounds of reduction for 100 leaves."""
    rows = [(i, "s", "en" if i % 5 else "de", 1, f"t{i}") for i in range(100)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], DOCS)
    leaves = docs.select("doc_id", merkle.group_of(F.col("lang")).alias("group"), merkle.leaf_of({c: F.col(c) for c in merkle.FIELDS}).alias("hash"))
    got = merkle.manifest(leaves, "doc_id", fanout=2, levels=2).withColumn("up", merkle.folded(F.col("hash"), F.col("before"), F.col("after"))).collect()
    want = {r[0]: r for r in plain(rows, 2)}
    assert len(got) == 100 and all(r.up == r.root == want[r.doc_id][3] and r.subroot == want[r.doc_id][2] for r in got)
    assert all(H("".join(b + a for b, a in zip(r.before, r.after))) == want[r.doc_id][4] for r in got)


def test_a_changed_field_is_noticed(spark):
    rows = CASES["nine"]
    whole = digests(spark, rows)[0][3]
    for field, value in ((1, "S"), (2, "e"), (3, 2), (4, "t0"), (4, None)):
        changed = [(*rows[0][:field], value, *rows[0][field + 1 :])] + rows[1:]
        assert digests(spark, changed)[0][3] != whole


def test_a_lost_or_doubled_row_is_noticed_and_an_empty_table_has_no_root(spark):
    rows = CASES["nine"]
    whole = digests(spark, rows)[0][3]
    assert digests(spark, rows[:-1])[0][3] != whole and digests(spark, rows + rows[-1:])[0][3] != whole
    assert digests(spark, []) == []


def test_a_very_long_text_and_whole_table(spark, sf):
    assert digests(spark, [(3, "s", "en", 1, "Long " * 400_000)]) == plain([(3, "s", "en", 1, "Long " * 400_000)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((tuple(r) for r in merkle.digest(docs).collect()), key=key)
    assert got == sorted(plain([tuple(r) for r in docs.select(*merkle.FIELDS).collect()]), key=key)
