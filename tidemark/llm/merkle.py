"""A Merkle manifest of a dataset: a leaf for each row, a tree for each group, and a proof for each row.

The leaves of a group are numbered in order, and ``FANOUT`` consecutive nodes hash to one parent, level by level, until
one node is left: the group's subroot. The subroots, in the order of their groups, reduce alike to the root. Trees are
reduced by superblocks: indices are bucketed by ``FANOUT ** LEVELS``, one ``applyInPandas`` group collapses that many
levels at once, and the bucket roots are reduced in the same way until each group has one. Proofs come back down: a
bucket's lower proofs are put in front of the proof of its root, so no leaf travels with its proof.

Numbers come from ranges: rows are sorted across the cluster by group and order, each range counts the rows of its
groups, and a row's index is its place in the range plus the rows of the ranges before it. A group of any size is
many ranges and many buckets; a bucket holds ``FANOUT ** LEVELS`` rows at most.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidemark.llm.base import checkpoint

FANOUT, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields in order: each its bytes in UTF-8, a colon and its value, or a dash where it is null."""
    framed = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(framed, fields.values())).cast("binary"), 256)


def group_of(c: Column) -> Column:
    """A group's name, never null: nulls come first, the others in the order of their bytes."""
    return F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0"))


def depth(nodes: int, fanout: int = FANOUT) -> int:
    """Levels from so many nodes to one."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def grown(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes and so many levels above them."""
    rows = [nodes]
    for _ in range(levels):
        rows.append([sha("".join(rows[-1][i : i + fanout])) for i in range(0, len(rows[-1]), fanout)])
    return rows


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with ``group``) and ``index``, the place in the group by ``order`` (nulls first), and ``total``, its rows.

    Rows that are equal in all of ``order`` are told apart by where they were read, so that many of them are no one range.
    """
    keys = [F.col("group"), *(F.col(c).asc_nulls_first() for c in order), F.col("_salt")]
    sorted_ = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = checkpoint(sorted_.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).drop("_salt"))
    sizes = dealt.groupBy("group", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("group")
    before = sizes.select("group", "_range", (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n") - F.col("_first")).alias("_add"), F.sum("_n").over(whole).alias("total"))
    return dealt.join(before, ["group", "_range"]).withColumn("index", F.col("_at") + F.col("_add")).drop("_range", "_at", "_add")


def _bucket(fanout: int, levels: int) -> Column:
    return F.floor(F.col("index") / F.lit(fanout**levels)).cast("long").alias("bucket")


def reduced(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The roots of the buckets of ``nodes`` (group, index, total, hash), as nodes of the next superblock level."""

    def collapse(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = int(rows["total"].iloc[0])
        root = grown(rows.sort_values("index")["hash"].tolist(), min(levels, depth(total, fanout)), fanout)[-1]
        return pd.DataFrame({"group": [key[0]], "index": [key[1]], "total": [-(-total // fanout**levels)], "hash": root})

    return nodes.select("group", _bucket(fanout, levels), "index", "total", "hash").groupBy("group", "bucket").applyInPandas(collapse, "group string, index long, total long, hash string")


def proven(nodes: DataFrame, parents: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``nodes`` with the proof of each: what stands before and after it in its run, level by level up to the root.

    ``parents`` are the roots of the nodes' buckets with their own proofs, ``subroot`` and ``root``; one a bucket.
    """
    kept = [f for f in nodes.schema if f.name not in ("total", "bucket")]
    spark_schema = nodes.select(*(f.name for f in kept)).schema.add("before", ArrayType(StringType())).add("after", ArrayType(StringType())).add("subroot", "string").add("root", "string")

    def descend(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("index")
        names = [f.name for f in kept]
        if right.num_rows != 1 and left.num_rows:
            raise ValueError(f"bucket {key} has {right.num_rows} roots")
        above = right.slice(0, 1).to_pylist()[0] if right.num_rows else {}
        before, after = [], []
        if left.num_rows:
            hashes = left.column("hash").to_pylist()
            rows = grown(hashes, min(levels, depth(left.column("total")[0].as_py(), fanout)), fanout)[:-1]
            for i in range(len(hashes)):
                b, a = [], []
                for row in rows:
                    first = i - i % fanout
                    b.append("".join(row[first:i]))
                    a.append("".join(row[i + 1 : first + fanout]))
                    i //= fanout
                before.append(b + above["before"])
                after.append(a + above["after"])
        texts, n = pa.list_(pa.string()), left.num_rows
        columns = [left.column(x) for x in names] + [pa.array(before, texts), pa.array(after, texts), pa.array([above.get("subroot")] * n, pa.string()), pa.array([above.get("root")] * n, pa.string())]
        return pa.table(columns, names=[*names, "before", "after", "subroot", "root"])

    below = nodes.select("*", _bucket(fanout, levels)).groupBy("group", "bucket")
    return below.cogroup(parents.select("group", F.col("index").alias("bucket"), "before", "after", "subroot", "root").groupBy("group", "bucket")).applyInArrow(descend, spark_schema)


def _up(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """``nodes`` and the superblock levels above them, up to one node a group; one number a level reaches the driver."""
    rows = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        rows.append(checkpoint(reduced(rows[-1], fanout, levels)))
        most = -(-most // fanout**levels)
    return rows


def manifest(leaves: DataFrame, *order: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``leaves`` (``group``, ``hash`` and any other columns but those named here) with their proofs.

    Adds ``index``, ``before`` and ``after`` (what stands beside the node in its run, a text a level, from the leaf up
    to the root; the first levels are the group's tree, the others the tree of subroots), ``subroot`` and ``root``.
    Leaves of a group stand in ``order``, nulls first, then by hash; equal rows are leaves of their own. A lone leaf is
    its group's subroot, and a lone subroot is the root. An empty table gives an empty one.
    """
    below = _up(placed(leaves, *order, "hash"), fanout, levels)
    tops = below[-1].select(F.lit("").alias("group"), F.col("group").alias("of"), F.col("hash"))
    above = _up(placed(tops, "of"), fanout, levels)
    none = F.array().cast("array<string>")
    roots = above[-1].select("group", "index", none.alias("before"), none.alias("after"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    for nodes in reversed(above[:-1]):
        roots = proven(nodes, roots, fanout, levels)
    if len(above) == 1:  # a lone subroot, or none
        roots = roots.join(above[0].select("index", "of", "hash"), "index")
    roots = roots.select(F.col("of").alias("group"), F.lit(0).cast("long").alias("index"), "before", "after", F.col("hash").alias("subroot"), "root")
    if len(below) == 1:  # no group has a second leaf
        return below[0].drop("total").join(roots.drop("index"), "group")
    for nodes in reversed(below[:-1]):
        roots = proven(nodes, roots, fanout, levels)
    return roots


def folded(leaf: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(F.arrays_zip(before.alias("b"), after.alias("a")), leaf, lambda h, s: F.sha2(F.concat(s["b"], h, s["a"]).cast("binary"), 256))


def proof_text(before: Column, after: Column) -> Column:
    """A proof's hashes end to end: level by level, from left to right."""
    return F.concat_ws("", F.zip_with(before, after, lambda b, a: F.concat(b, a)))


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of each document.

    Documents whose crc32(doc_id as text) is divisible by 3 are tampered with (their text's A-Z lower-cased) after the
    manifest was made, and ``folded_root`` is what the tampered leaf gives; ``verified`` says whether it is still the
    root. A null in any field is a leaf's dash, a null lang a group of its own; a null doc_id comes first and is left
    untampered; repeated rows have leaves and proofs of their own; other columns are left behind.
    """
    fields = {c: F.col(c) for c in FIELDS}
    lower = fields | {"text": F.translate("text", LETTERS, LETTERS.lower())}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaves = docs.select("doc_id", group_of(F.col("lang")).alias("group"), leaf_of(fields).alias("hash"), F.when(hit, leaf_of(lower)).alias("tampered"))
    root = folded(F.coalesce("tampered", "hash"), F.col("before"), F.col("after"))
    found = manifest(leaves, "doc_id").select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(proof_text(F.col("before"), F.col("after")).cast("binary"), 256).alias("proof_sha256"), root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
