"""Near-duplicate documents: SimHash BK-trees over shards of likely pairs, held to a similarity of word shingles.

At a similarity of 0.8 two SimHash fingerprints are some 9 bits apart, seldom over 18, where blocks of bits no longer
narrow the search. So the shards come from bands of two min-hashes of the same shingles: two documents of similarity s
share one of ``BANDS`` bands with probability 1 - (1 - s**2) ** BANDS (at 0.8: all but 1e-7). In a shard a
BK-tree of the fingerprints proposes pairs: those within ``RADIUS`` bits, and no others. Of pairs at the bound itself
fewer than 3 in 10,000 are farther apart for sets of five shingles, and none was found for larger sets in 4,000
trials each. A sketch of the min-hashes says how alike the two of a pair are. A first pass links pairs clearly above the
bound and names the documents that have others near the bound; a second pass over these alone, with their shingles beside them, decides each pair exactly. Both passes report a
forest of a shard's links, never all pairs. A shard is split by its next band, and then by salt, if it is too
large; that links most of a large group, and an exact join over the members of such shards finds the pairs it
dealt apart: see ``crowded_links``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import checkpoint, map_batches, spread_join, texts
from tidemark.llm.graph import components
from tidemark.llm.simhash import BKTree, fold, hashes

NGRAM, SIMILARITY = 5, 0.8
BANDS, RADIUS, SKETCH = 16, 24, 128
#: Documents of one tree, and how far from the bound a sketch is taken at its word.
SHARD, DOUBT = 1024, 0.12
#: Documents of each side that are compared at once in the exact join.
BLOCK = 256
_A, _B = (np.random.default_rng(11).integers(1, 1 << 63, SKETCH, np.uint64, endpoint=False) for _ in range(2))
_A = _A | np.uint64(1)


def minhashes(h: np.ndarray) -> np.ndarray:
    """``SKETCH`` minima of a set of hashes, of 32 bits; an empty set has the largest."""
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(h), 4096):
        least = np.minimum(least, ((h[i : i + 4096, None] * _A + _B) >> np.uint64(32)).min(0))
    return least


def signatures(docs: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """``doc_id``, ``fp`` (SimHash of the distinct shingles), ``bands`` and ``sketch`` (a byte of each min-hash) of each whole text."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps, bands, sketches = [], [], []
            for text in batch.column(1).to_pylist():
                h = np.unique(hashes(text, ngram))
                m = minhashes(h)
                fps.append(fold(h))
                pairs = m[: 2 * BANDS].reshape(-1, 2)
                bands.append((pairs[:, 0] << np.uint64(32) | pairs[:, 1]).view(np.int64))
                sketches.append((m & np.uint64(255)).astype(np.uint8).tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "fp", "bands", "sketch"])

        return step

    return map_batches(texts(docs), make, "doc_id long, fp long, bands array<long>, sketch binary")


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity that sketches show; one in 256 unequal min-hashes has an equal byte."""
    return (np.count_nonzero(a == b, axis=-1) / SKETCH - 1 / 256) / (1 - 1 / 256)


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets of distinct hashes have that share of their union in common."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= similarity * (len(x) + len(y) - common)


def shard_links(rows: list[tuple], similarity: float = SIMILARITY) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that connect a shard's groups, and the documents that have others near the bound.

    Rows are (document, fingerprint, sketch) or have a fourth field, the hashes of the shingles; with it pairs
    near the bound are decided, and no document is left in doubt.
    """
    tree, links, parent, doubtful = BKTree(), [], list(range(len(rows))), set()
    sketches = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), SKETCH)
    exact = bool(rows) and len(rows[0]) == 4

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, row in enumerate(rows):
        near = np.array(sorted(item for _, _, item in tree.within(row[1], RADIUS)), np.int64)
        likeness = dict(zip(near.tolist(), alike(sketches[near], sketches[i]).tolist()))
        for other in sorted((j for j, x in likeness.items() if x >= similarity - DOUBT), key=lambda j: (-likeness[j], j)):
            group = top(other)
            if group == top(i):
                continue
            if likeness[other] < similarity + DOUBT and not exact:
                doubtful.update((i, other))
            elif likeness[other] >= similarity + DOUBT or similar(row[3], rows[other][3], similarity):
                links.append((row[0], rows[other][0]))
                parent[top(i)] = group
        tree.add(row[1], i)
    return links, [rows[i][0] for i in sorted(doubtful)]


def _sized(level: DataFrame) -> DataFrame:
    return spread_join(level, level.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def _banded(classes: DataFrame) -> DataFrame:
    """Rows (key, id, i, n) of the shards of each band i with two members at least; n is their number."""
    return _sized(classes.select("id", F.posexplode("bands").alias("i", "band")).select(F.xxhash64("i", "band").alias("key"), "id", "i"))


def _with_class(rows: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """``rows`` (key, id, i) with columns of their class. The shards of a class travel as one list, so a class is met once, not once a shard."""
    held = rows.groupBy("id").agg(F.collect_list(F.struct("key", "i")).alias("at"))
    return held.join(classes.select("id", *columns), "id").select(F.explode("at").alias("at"), "id", *columns).select("at.key", "id", "at.i", *columns)


def _sharded(first: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (key, id, fp, sketch) of shards with two members at least, of bounded size."""
    finer = _with_class(first.where(F.col("n") > SHARD), classes, "bands").select(F.xxhash64("key", F.get("bands", (F.col("i") + 1) % BANDS)).alias("key"), "id", "i")
    second = _sized(finer)
    salted = second.where(F.col("n") > SHARD).withColumn("key", F.xxhash64("key", F.pmod(F.xxhash64("id", "i"), F.ceil(F.col("n") / SHARD))))
    every = first.where(F.col("n") <= SHARD).unionByName(second.where(F.col("n") <= SHARD)).unionByName(salted)
    return _with_class(every, classes, "fp", "sketch").drop("i")


def candidate_links(shards: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a`` and ``b`` of links, and ``key`` and ``a`` of documents in doubt, from shards (key, id, fp, sketch and, if known, shingles)."""

    def run(batches):
        def told(key, rows):
            links, doubtful = shard_links(rows, similarity)
            columns = ([None] * len(links) + [key] * len(doubtful), [x[0] for x in links] + doubtful, [x[1] for x in links] + [None] * len(doubtful))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "a", "b"])

        key, rows = None, []
        for batch in batches:
            for k, doc, fp, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if len(rows) > 1:
                        yield told(key, rows)
                    key, rows = k, []
                rows.append((doc, fp & (1 << 64) - 1, rest[0], *(np.frombuffer(x, np.uint64) for x in rest[1:])))
        yield told(key, rows)

    dealt = shards.select("key", "id", "fp", "sketch", *(c for c in shards.columns if c == "shingles"))
    return dealt.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "key long, a long, b long")


def shingle_sets(docs: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """``id`` and ``shingles``: the distinct hashes of a text's shingles, sorted, of eight bytes each."""

    def make():
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(hashes(t, ngram)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "shingles"])

    return map_batches(texts(docs), make, "id long, shingles binary")


def crowded_links(crowd: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a`` and ``b``: links that connect all pairs of ``crowd`` (id, root, shingles) at the similarity or above.

    Exact, by prefixes: with shingles in one order, rarest first, the first that a pair has in common is among
    the first n - ceil(s * n) + 1 of either document, and among the first n - ceil(2s / (1 + s) * n) + 1 (its
    core) of the shorter. Documents are dealt by such shingles; in a list each core document meets each other of
    another root, in blocks: those of the list's commonest root are connected already and meet only the rest, so a
    list costs its length and not its square where one group is most of it. Lists of one root alone are left out.
    """
    t = F.lit(similarity)

    def listed(batches):
        for batch in batches:
            sets = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in sets], np.int64)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([*sets, np.empty(0, np.int64)]))], ["id", "n", "s"])

    def met(rows: list[tuple]) -> pa.RecordBatch:
        parent, links = {r[1]: r[1] for r in rows}, []

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        cores = [r for r in rows if r[2]]
        for doc, root, core, shingles in rows:
            for other, its, _, few in () if core else cores:
                if similarity * len(shingles) <= len(few) <= len(shingles) and top(root) != top(its) and similar(shingles, few, similarity):
                    links.append((doc, other))
                    parent[top(root)] = top(its)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for k, doc, root, core, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    yield met(rows)
                    key, rows = k, []
                rows.append((doc, root, core, np.frombuffer(shingles, np.uint64)))
        yield met(rows)

    each = crowd.select("id", "shingles").mapInArrow(listed, "id long, n long, s long")
    shared = checkpoint(each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"))
    own = Window.partitionBy("id")
    place = F.row_number().over(own.orderBy("df", "s")) + F.col("n") - F.count("*").over(own)
    reach = lambda share: F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1
    placed = each.join(shared, "s").select("id", "s", "n", place.alias("place")).where(F.col("place") <= reach(t))
    dealt = checkpoint(placed.select("id", "s", (F.col("place") <= reach(2 * t / (1 + t))).alias("core")).join(crowd.select("id", "root"), "id"))
    rooted = dealt.groupBy("s", "root").agg(F.count("*").alias("n"), F.count_if("core").alias("cores"))
    lists = rooted.groupBy("s").agg(F.max(F.struct("n", "root", "cores")).alias("main"), F.sum("n").alias("n"), F.sum("cores").alias("cores"))
    blocks = lambda n: F.ceil(n / BLOCK)
    rest, rest_cores = F.col("n") - F.col("main.n"), F.col("cores") - F.col("main.cores")
    open_lists = dealt.join(lists.where((rest > 0) & (F.col("cores") > 0)).select("s", F.col("main.root").alias("main"), blocks(F.col("n")).alias("all_"), blocks(rest).alias("rest"), blocks(rest_cores).alias("rest_cores"), blocks(F.col("main.cores")).alias("main_cores")), "s")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def meet(turn: int, hosting: Column, hosts: str, guesting: Column, guests: str) -> DataFrame:
        """Core documents of ``hosting`` and all of ``guesting`` in the cells of a grid of blocks."""
        met = open_lists.where((F.col(hosts) > 0) & (F.col(guests) > 0))
        host = met.where(hosting & F.col("core")).select("s", "id", "root", "core", mine(hosts).alias("host"), spread(guests).alias("guest"))
        guest = met.where(guesting).select("s", "id", "root", F.lit(False).alias("core"), mine(guests).alias("guest"), spread(hosts).alias("host"))
        return host.unionByName(guest).select(F.xxhash64(F.lit(turn), "s", "host", "guest").alias("key"), "id", "root", "core")

    other = F.col("root") != F.col("main")
    met_at = meet(1, other, "rest_cores", F.lit(True), "all_").unionByName(meet(2, ~other, "main_cores", other, "rest"))
    full = met_at.join(crowd.select("id", "shingles"), "id").select("key", "id", "root", "core", "shingles")
    return full.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, ngram: int = NGRAM, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id`` and ``group_id`` (the smallest doc_id of its near-duplicates, itself included) of every document.

    Documents of equal signature are one class, linked at once. Null and empty texts are copies of each other.
    Rows with a null doc_id are left out; rows of one doc_id are one document. An empty table gives an empty
    one; other columns are left behind.
    """
    known = docs.where("doc_id IS NOT NULL")
    signed = checkpoint(signatures(known, ngram).withColumn("class", F.xxhash64("fp", "bands", "sketch")))
    classes = checkpoint(signed.groupBy("class").agg(F.min("doc_id").alias("id"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")))
    first = checkpoint(_banded(classes))
    likely = checkpoint(candidate_links(_sharded(first, classes), similarity))
    doubtful = likely.where("key IS NOT NULL").select("key", F.col("a").alias("id"))

    def sets(ids: DataFrame) -> DataFrame:
        asked = known.select("doc_id", "text").join(ids.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return shingle_sets(asked, ngram).groupBy("id").agg(F.any_value("shingles").alias("shingles"))

    decided = candidate_links(doubtful.join(sets(doubtful).join(classes.select("id", "fp", "sketch"), "id"), "id"), similarity)
    roots = components(likely.where("key IS NULL").select("a", "b").unionByName(decided.select("a", "b")))
    crowd = checkpoint(first.where(F.col("n") > SHARD).select("id").distinct())
    if not crowd.isEmpty():
        held = checkpoint(sets(crowd).join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "shingles"))
        links = crowded_links(held, similarity)
        roots = components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    placed = classes.select("class", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("class", F.coalesce("root", "id").alias("group_id"))
    return spread_join(signed.select("doc_id", "class"), placed, "class").groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def keep_one(docs: DataFrame, ngram: int = NGRAM, similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns, with one document of each group of near-duplicates: that of the smallest doc_id.

    Rows with a null doc_id stay; rows of one doc_id stay or go together; null and empty texts are copies of each
    other, so one such document stays; an empty table gives an empty one.
    """
    copies = groups(docs, ngram, similarity).where("doc_id <> group_id").select(F.col("doc_id").alias("a copy"))
    return docs.join(copies, docs["doc_id"] == copies["a copy"], "left_anti")
