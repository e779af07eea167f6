"""What five filters cost in every order, part by part: an audit of how filters interact.

A document's failures are a mask of five bits, so every count over the 120 orders is a sum over 32 masks of a part.
Four bits come from the text alone. The fifth, an exact duplicate, is found by refining a partition: documents are
split by their length in code points, then by the hashes of successive blocks of their text, each ending sixteen
times as far as the one before, and a class that is down to one document is dropped at once. Only the texts of classes that survive
are compared: they meet in full, after equal ones were merged where they were read, and every document but those of
the smallest id of its text is marked.

Refinement works on signatures (length and block hashes) with a count, merged before they move, so a text with very
many copies is one row a task. Survivors are told to the second scan by a bitmap of bounded size; what it lets through
by chance is compared like the rest and found alone.
"""

from __future__ import annotations

import json
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import checkpoint, map_batches, spread_join, texts

FILTERS = "ABCDE"
#: Code points of the first block; each following block ends ``GROWTH`` times as far.
BLOCK, GROWTH = 256, 16
#: Bits of the bitmap of surviving signatures (2 MB).
BITMAP = 1 << 24
NAMES = ["doc_id", "part", "mask", "chars", "blocks", "signature"]
FEATURES = "doc_id long, part string, mask int, chars long, blocks array<long>, signature long"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = re.compile(rb"[#$%&*|]")


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails: too few words, too few distinct, too many capitals, a sign."""
    raw = text.encode()
    words = raw.split()  # of bytes: at ASCII white space alone
    capitals = len(raw) - len(raw.translate(None, UPPER))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * len(text)) << 2 | (SIGNS.search(raw) is not None) << 3


def block_hashes(text: str) -> list[int]:
    """Signed 64-bit hashes of the text's successive blocks; an empty text has one empty block."""
    out, start, end = [], 0, BLOCK
    while True:
        out.append(_signed(xxhash.xxh64_intdigest(text[start:end].encode(), 11)))
        if end >= len(text):
            return out
        start, end = end, end * GROWTH


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def signature(n_chars: int, blocks: list[int]) -> int:
    return _signed(xxhash.xxh64_intdigest(np.array([n_chars, *blocks], "<i8").tobytes(), 11))


def features(docs: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``part``, ``mask`` (bits of A to D), ``chars``, ``blocks`` and ``signature`` of each whole text.

    With ``among`` (rows with ``signature``), only documents whose signature may be among them, and their ``text`` too.
    """
    shared = None if among is None else docs.sparkSession.sparkContext.broadcast(_bits(among))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = batch.column(1).to_pylist()
            blocks = [block_hashes(t) for t in rows]
            own = np.array([signature(len(t), b) for t, b in zip(rows, blocks)], np.int64)
            found = [batch.column(0), batch.column(2), pa.array([failures(t) for t in rows], pa.int32()), pa.array([len(t) for t in rows], pa.int64()), pa.array(blocks, pa.list_(pa.int64())), pa.array(own)]
            if shared is None:
                return pa.RecordBatch.from_arrays(found, NAMES)
            at = np.mod(own, BITMAP)
            hit = pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)
            return pa.RecordBatch.from_arrays([c.filter(hit) for c in (*found, batch.column(1))], [*NAMES, "text"])

        return step

    parted = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part"))
    return map_batches(texts(parted, "part"), make, FEATURES if among is None else f"{FEATURES}, text string")


def refined(rows: DataFrame) -> DataFrame:
    """``chars``, ``blocks``, ``signature`` and ``n`` of the signatures that are left when every class of one is dropped.

    ``rows`` are features. The first split is by length, the next by the first block's hash, and so on to the last
    block of the longest text; a class of one document is dropped at each, so later splits hold fewer rows.
    """
    live = rows.groupBy("chars", "blocks", "signature").agg(F.count("*").alias("n"))
    live = checkpoint(live.withColumn("class", F.col("chars")))
    longest = live.agg(F.max(F.size("blocks"))).first()[0] or 0
    for block in range(longest + 1):
        several = live.groupBy("class").agg(F.sum("n").alias("_all")).where("_all > 1").select("class")
        kept = spread_join(live, several, "class")
        finer = F.xxhash64("class", F.try_element_at("blocks", F.lit(block + 1)))
        live = checkpoint(kept.withColumn("class", F.when(F.size("blocks") > block, finer).otherwise(F.col("class"))))
    return live.drop("class")


def _bits(rows: DataFrame) -> np.ndarray:
    """The bitmap: one bit a signature, gathered as at most ``BITMAP / 64`` words."""
    word, bit = F.expr(f"pmod(signature, {BITMAP}) div 64"), F.expr(f"shiftleft(1L, cast(pmod(signature, {BITMAP}) % 64 AS int))")
    table = rows.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP // 64, np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out


def duplicates(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (features of ``docs``, held) with ``again``: whether a smaller doc_id has the identical text.

    Ids that are equal or null are not smaller, so rows of one id do not mark each other, and a null id marks none and
    is not marked.
    """
    keys, own = ("chars", "signature"), ("doc_id", "part", "mask", "chars", "signature")
    compare = lambda some: features(docs, some).groupBy(*keys, "text").agg(F.min("doc_id").alias("least"))
    classes = checkpoint(compare(refined(rows)).groupBy(*keys).agg(F.count("*").alias("texts"), F.min("least").alias("least")))
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("again")
    joined = spread_join(rows.select(*own), classes, *keys, how="left")
    plain = joined.where("texts IS NULL OR texts = 1").select(*own, again)
    mixed = classes.where("texts > 1").select(*keys)
    if mixed.isEmpty():
        return plain
    # Different texts of one signature: these documents are told apart by the texts themselves.
    named = features(docs, mixed).join(mixed, list(keys), "left_semi").join(compare(mixed), [*keys, "text"])
    return plain.unionByName(named.select(*own, again))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask``, ``n``, ``good`` and ``toxic``: documents by failures, and how many of them are labelled so.

    A document is good or toxic if any label of its id says so; a null id has no labels.
    """
    rows = checkpoint(features(docs))
    flagged = checkpoint(duplicates(docs, rows).select("doc_id", "part", (F.col("mask") + F.when(F.col("again"), 16).otherwise(0)).alias("mask")))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    judged = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    joined = spread_join(flagged, judged, "doc_id", how="left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def orders(filters: str = FILTERS) -> list[dict]:
    """Every order of the filters, step by step: the step's bit and the bits of the steps before it."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    return [{"filter_order": "".join(p), "step": i + 1, "bit": bit[f], "earlier": sum(bit[x] for x in p[:i])} for p in permutations(filters) for i, f in enumerate(p)]


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts of each step of each order, from ``masks``: a part's masks are few, so each row is a sum over them."""
    steps = orders(filters)
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, earlier: int>>")
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m")).select("part", "m", F.explode(plan).alias("s")).select("part", "m", "s.*")

    def total(where, value=lambda x: x["n"]) -> Column:
        return F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.when(where(x["mask"]), value(x)).otherwise(F.lit(0)).cast("long"))

    bit, earlier = F.col("bit"), F.col("earlier")
    fails, before = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(earlier) != 0)
    removed = lambda m: fails(m) & ~before(m)
    each = len(steps) // len(filters)
    return parts.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~before(m)).alias("kept"), total(removed).alias("removed"), total(lambda m: fails(m) & before(m)).alias("redundant"), total(lambda m: m == bit).alias("unique_fails"),
        total(removed, lambda x: x["good"]).alias("good_lost"), total(removed, lambda x: x["toxic"]).alias("toxic_lost"),
        # Of the orders, each of a mask's filters comes first in an equal share.
        total(fails, lambda x: (x["n"] * each / F.bit_count(x["mask"])).cast("long")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (a source; null counts as the empty one), order and step, zeros included.

    ``kept`` after the step, ``removed`` at it, ``redundant`` (fails the step's filter, removed before),
    ``unique_fails`` (fails that filter alone), ``good_lost`` and ``toxic_lost`` (removed here, labelled so) and
    ``shapley`` (what the filter removes, over all orders). Null texts are empty; repeated rows count each; an empty
    table gives no rows; other columns are left behind.
    """
    return audit(masks(docs, labels))
