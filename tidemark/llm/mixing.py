"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a target of words; ``target / source size`` is the rate at which its documents are taken. The
whole part of the rate is copies that every document gives; the fraction is an inclusion probability. The cube
method turns probabilities into choices: among three undecided documents it moves the probabilities along the
null space of the two constraints (words and documents of the source), one way or the other at random so that
each keeps its mean, until one reaches 0 or 1. What stays undecided in a cell, two documents at most, moves on
to a coarser cell, and the last two of a source land on the choice nearest to the target. Cells are dealt by a hash
of doc_id, text and a number among equal rows, so a large source is many cells, whatever its ids.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import checkpoint, spread_join

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of a cell, finer cells of a coarser one, and levels: enough for 10**11 documents of one source.
CELL, FAN_IN, LEVELS = 1000, 500, 4
EPS = 1e-9


def size_column() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(rank: Column, weights: tuple[float, ...] = WEIGHTS) -> Column:
    """Weights by rank from 1, repeating."""
    return F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``group``, its rank from 1 by code point, null last.

    Sources are sorted in ranges; a range's ranks follow those of the ranges before it, whose sizes alone (one number
    a range) meet in one place.
    """
    dealt = checkpoint(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    sizes = dealt.groupBy("range").agg(F.count("*").alias("here"))
    before = sizes.select("range", (F.sum("here").over(Window.orderBy("range")) - F.col("here")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("inside", inside).join(F.broadcast(before), "range").withColumn("group", (F.col("inside") + F.col("before")).cast("long")).drop("range", "inside", "before")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``target`` for each row of ``sources`` (source, source_size, weight).

    ``share`` times all sizes is dealt by weight; a target stops at ``most`` times its source's size and the rest
    is dealt again until no target is above. Each pass sends three sums to the driver.
    """
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    cap = most * F.col("source_size")
    level = 0.0
    while True:
        full = cap < F.col("weight") * level
        held, open_weight, n = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("int"))).first()
        if not open_weight:
            break
        following = (budget - (held or 0.0)) / open_weight
        if following <= level:
            break
        level = following
    return sources.withColumn("target", F.least(cap, F.col("weight") * level).cast("double"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities until at most two are undecided, keeping sum(p) and sum(p * size)."""
    p = p.astype(float).copy()
    draws = iter(rng.random(len(p) + 8).tolist())
    active: list[int] = []
    values, sizes = p.tolist(), size.astype(float).tolist()
    for k in range(len(values)):
        if not EPS < values[k] < 1 - EPS:
            values[k] = round(values[k])
            continue
        active.append(k)
        while len(active) == 3 or len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
            a, b = active[:2]
            if len(active) == 2 or sizes[a] == sizes[b]:
                move = [(a, 1.0), (b, -1.0)]
            else:
                c = active[2]
                scale = max(abs(sizes[b] - sizes[c]), abs(sizes[c] - sizes[a]), abs(sizes[a] - sizes[b]))
                move = [(i, u / scale) for i, u in ((a, sizes[b] - sizes[c]), (b, sizes[c] - sizes[a]), (c, sizes[a] - sizes[b])) if u]
            up = min((1 - values[i]) / u if u > 0 else values[i] / -u for i, u in move)
            down = min(values[i] / u if u > 0 else (1 - values[i]) / -u for i, u in move)
            step = up if next(draws, 0.5) * (up + down) < down else -down
            for i, u in move:
                values[i] += step * u
                if values[i] < EPS or values[i] > 1 - EPS:
                    values[i] = round(values[i])
            active = [i for i in active if 0 < values[i] < 1]
    return np.array(values)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last undecided ones: the choice whose words are nearest to their mean, then whose count is."""
    out, left = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        best = min(product((0.0, 1.0), repeat=len(left)), key=lambda c: (abs(np.dot(np.array(c) - p[left], size[left])), abs(sum(c) - p[left].sum()), c))
        out[left] = best
    return out


def _decide(last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "doc_id", "size", "p"], kind="stable", ignore_index=True)
        rng = np.random.default_rng([int(k) & 0xFFFFFFFF for k in key] + [len(rows)])
        p = flight(rows["p"].to_numpy(), rows["size"].to_numpy(), rng)
        rows["p"] = landing(p, rows["size"].to_numpy()) if last else p
        return rows

    return run


def balanced(units: DataFrame) -> DataFrame:
    """``units`` (group, n, h, doc_id, size, p) with every ``p`` moved to 0 or 1, balanced in each group.

    ``n`` is the size of the unit's group and ``h`` a hash that tells units apart. Each level's undecided units, two a
    cell at most, go on to cells ``FAN_IN`` times as coarse.
    """
    cells = F.ceil(F.col("n") / CELL)
    left, decided = units, None
    for level in range(LEVELS):
        last = level == LEVELS - 1
        cell = F.lit(0) if last else F.pmod(F.col("h"), F.greatest(F.lit(1), F.ceil(cells / float(FAN_IN**level))).cast("long"))
        keyed = left.select("group", cell.cast("long").alias("cell"), F.lit(level).alias("level"), "n", "h", "doc_id", "size", "p")
        moved = checkpoint(keyed.groupBy("group", "cell", "level").applyInPandas(_decide(last), keyed.schema).select("group", "n", "h", "doc_id", "size", "p"))
        done = moved.where("p <= 0 or p >= 1")
        decided = done if decided is None else decided.unionByName(done)
        left = moved.where("p > 0 and p < 1")
    return decided


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """How much of each document a mix of all sources takes.

    Returns ``doc_id``, ``size`` (words), ``source``, ``source_size``, ``target`` and ``taken`` (words, repeats
    counted: 0, 1 or ``most`` times the size at most). Sources weigh ``weights`` in code point order, null last;
    null is a source of its own. Null and empty texts have size 0 and take 0; repeated rows, and rows of one or a null
    id, are separate documents; an empty table gives an empty one; other columns are left behind.
    """
    named = [F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("named")]
    each = docs.select("doc_id", "source", size_column().alias("size"), F.xxhash64("text").alias("t"))
    sized = checkpoint(each.groupBy("doc_id", "source", "size", "t").agg(F.count("*").alias("copies")).select("doc_id", "source", "size", "t", "copies", *named))
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n"))
    aimed = targets(checkpoint(ranked(sources).withColumn("weight", weight_of(F.col("group"), weights))), share, most)
    rates = checkpoint(aimed.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    rated = spread_join(sized.drop("source"), rates.select("group", "n", "rate", *named), "none", "named")
    # Equal rows are told apart by a number, dealt out in thousands so that no list is long.
    thousands = rated.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1000))))
    copies = thousands.withColumn("copy", F.explode(F.sequence(F.col("k") * 1000, F.least(F.col("copies"), (F.col("k") + 1) * 1000) - 1)))
    units = copies.select("group", "n", F.xxhash64("doc_id", "t", "copy").alias("h"), "doc_id", "size", (F.col("rate") - F.floor("rate")).alias("p"))
    taken = (F.col("size") * (F.floor("rate") + F.col("p"))).cast("long")
    return spread_join(balanced(units), rates.drop("n"), "group").select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"))
