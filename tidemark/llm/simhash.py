"""SimHash near-duplicates, linked by BK-trees.

Fingerprints within ``radius`` bits of each other agree in at least two of ``radius + 2`` blocks of their bits,
so every two blocks name a shard, and linked fingerprints meet in one. A shard's distinct fingerprints form a
BK-tree: the children of a node are keyed by their Hamming distance to it, and a query follows only the edges
within the radius. A shard too large for one tree is split again by the bits that are still free: they differ in
``radius`` places at most, so one of ``radius + 1`` parts of them agrees. After two such splits so few bits are
left that a shard's size is bounded whatever the corpus. Shards report a spanning forest of their links, never
all pairs; components of the forest are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import checkpoint, map_batches, spread_join, texts
from tidemark.llm.graph import components

BITS = 64
SEED = 42
#: Fingerprints in one tree, unless the shard has no bits left to split by.
SHARD = 1024


def shingles(text: str, n: int) -> list[bytes]:
    """Runs of ``n`` words, repeats included; fewer words are one run, none are no run. Only A-Z are lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = (starts + sizes)[n - 1 :].tolist()
    return [joined[a:b] for a, b in zip(starts.tolist(), ends)]


def hashes(text: str, n: int) -> np.ndarray:
    """XXH64 of each shingle, unsigned."""
    from xxhash import xxh64_intdigest

    found = shingles(text, n)
    return np.fromiter((xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))


def fold(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes give zero. Signed, as Spark keeps it."""
    if not len(h):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (64 bits in a long) of each whole text; null and empty texts have 0."""

    def make():
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([fold(hashes(t, ngram)) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return map_batches(texts(docs), make, "doc_id long, fp long")


class BKTree:
    """Children keyed by their distance to the parent."""

    def __init__(self):
        self.root: list | None = None

    def add(self, value: int, item=None) -> None:
        if self.root is None:
            self.root = [value, item, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d not in node[2]:
                node[2][d] = [value, item, {}]
                return
            node = node[2][d]

    def within(self, value: int, radius: int) -> Iterator[tuple[int, int, object]]:
        """(distance, value, item) of the tree's nodes at most ``radius`` away."""
        stack = [self.root] if self.root else []
        while stack:
            other, item, children = stack.pop()
            d = (other ^ value).bit_count()
            if d <= radius:
                yield d, other, item
            if children:
                stack += [c for k, c in children.items() if d - radius <= k <= d + radius]


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within ``radius`` in a shard: at most one fewer than its fingerprints."""
    if len(values) == 2:
        return [(values[0], values[1])] if (values[0] ^ values[1]).bit_count() <= radius else []
    parent = {v: v for v in values}

    def top(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    tree, links = BKTree(), []
    for value in values:
        for _, other, _ in tree.within(value, radius):
            a, b = top(value), top(other)
            if a != b:
                parent[a] = b
                links.append((value, other))
        tree.add(value)
    return links


def _masks(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` in ``parts`` runs of nearly equal length."""
    return [p.tolist() for p in np.array_split(np.array(bits), parts)]


def _mask(bits: Iterable[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def shard_masks(radius: int) -> list[tuple[int, ...]]:
    """The bits that each key of the first level fixes."""
    blocks = _masks(list(range(BITS)), radius + 2)
    return [tuple(blocks[i] + blocks[j]) for i, j in combinations(range(radius + 2), 2)]


def _finer(fixed: tuple[int, ...], radius: int) -> list[tuple[int, ...]]:
    """Ways to fix more bits: one of ``radius + 1`` parts of the free ones."""
    free = [b for b in range(BITS) if b not in set(fixed)]
    return [tuple(sorted([*fixed, *part])) for part in _masks(free, radius + 1)]


def _keys(rows: DataFrame, sets: Column) -> DataFrame:
    return rows.select("fp", F.explode(sets).alias("k")).select("fp", F.col("k.i").alias("i"), F.col("k.v").alias("v"))


def forest_links(distinct: DataFrame, radius: int) -> DataFrame:
    """``a`` and ``b``: links of distinct ``fp`` values within ``radius`` that connect what all links connect."""

    def keyed(masks: list[int], first: int) -> list[Column]:
        return [F.struct(F.lit(first + n).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for n, m in enumerate(masks)]

    first = shard_masks(radius)
    rows = _keys(distinct, F.array(*keyed([_mask(s) for s in first], 0)))
    shards, numbered, offset = [], dict(enumerate(first)), len(first)
    for level in range(3):
        sized = rows.join(rows.groupBy("i", "v").agg(F.count("*").alias("n")).where("n > 1"), ["i", "v"])
        if level == 2:
            shards.append(sized.drop("n"))
            break
        shards.append(sized.where(F.col("n") <= SHARD).drop("n"))
        following, cases = {}, None
        for i, fixed in numbered.items():
            finer = _finer(fixed, radius)
            sets = F.array(*keyed([_mask(s) for s in finer], offset))
            cases = F.when(F.col("i") == i, sets) if cases is None else cases.when(F.col("i") == i, sets)
            following |= {offset + n: s for n, s in enumerate(finer)}
            offset += len(finer)
        rows, numbered = _keys(sized.where(F.col("n") > SHARD), cases), following
    every = shards[0]
    for more in shards[1:]:
        every = every.unionByName(more)
    every = every.repartition("i", "v").sortWithinPartitions("i", "v", "fp")

    def linked(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        ends = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    def run(batches):
        key, values = None, []
        for batch in batches:
            pairs = []
            unsigned = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            for i, v, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), unsigned):
                if (i, v) != key:
                    pairs += forest(values, radius)
                    key, values = (i, v), []
                values.append(fp)
            yield linked(pairs)
        yield linked(forest(values, radius))

    return every.select("i", "v", "fp").mapInArrow(run, "a long, b long").distinct()


def link(docs: DataFrame, ngram: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest doc_id reachable) of each document.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows give repeated
    results; a null doc_id is never a component's id while another document is in it; an empty table gives an
    empty one; columns other than ``doc_id`` and ``text`` are left behind.
    """
    held = checkpoint(fingerprints(docs, ngram))
    first = held.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(forest_links(first.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = checkpoint(first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = checkpoint(spread_join(placed.select("fp", "root"), placed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id"))
    return spread_join(held, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
