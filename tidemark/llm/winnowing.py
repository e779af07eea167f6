"""Document fingerprints by winnowing, in built-in functions alone.

Every run of ``K`` code points (a gram) has a hash of ``BITS`` bits. Of every ``W`` neighbouring hashes (a window) the
least is kept, the rightmost among equals. Any run of ``K + W - 1`` code points that two texts share leaves a common
fingerprint, and the kept positions say where.

A text is taken in chunks that reach a window into the next. A chunk is laid out with four bytes a code point, so a
gram is a slice found by its place, and one call hashes it. Minima of windows are made by doubling over the whole
chunk. A hash carries its place in its low bits, complemented, so the least is also the rightmost of equal ones, and
a window keeps another one than the window before exactly where its minimum changes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a gram, and grams of a window.
K, W = 16, 32  # W a power of two
REACH = K + W - 2
#: Windows of a chunk; bits of a place in it; bits of a hash.
CHUNK, PLACE, BITS = 4096, 13, 50
LOW = (1 << PLACE) - 1
_NONE = "array<struct<pos: int, hash: bigint, at: int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gram_hash(gram: Column) -> Column:
    """The hash of a gram, given as UTF-32."""
    return F.shiftrightunsigned(F.xxhash64(gram), 64 - BITS)


def _hashes(chunk: Column, size: Column) -> Column:
    """For each gram of a chunk of ``size`` code points (``K`` at least), its hash and its complemented place."""
    return _let(F.encode(chunk, "UTF-32"), lambda wide: F.transform(F.sequence(F.lit(1), (size - K) * 4 + 1, F.lit(4)), lambda at, i: gram_hash(F.substring(wide, at, F.lit(4 * K))) * (LOW + 1) + (LOW - i)))


def _rolled(h: Column, count: Column) -> Column:
    """(at, key) of each kept one of ``count`` hashes, in order; ``at`` is the first window that keeps it.

    Minima of 1, 2, 4, ... neighbours, each from the ones before; past the end there is nothing to compare with.
    Places are complemented, so a kept one that is less than the one before it was kept as soon as a window
    reached it, and a larger one as soon as the one before was out of the window: ``at`` is found for the kept alone.
    """
    least = h
    for step in (1 << i for i in range(W.bit_length() - 1)):
        least = (lambda xs, n: _let(xs, lambda v: F.zip_with(v, F.slice(v, n + 1, F.size(v)), lambda x, y: F.least(x, y))))(least, step)
    windows = F.slice(least, 1, F.greatest(count - W + 1, F.lit(1)))
    fresh = lambda m: F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1)))
    place = lambda key: (F.lit(LOW) - key.bitwiseAND(F.lit(LOW))).cast("int")
    first = lambda x, before: F.when(before.isNull(), 0).when(x < before, place(x) - W + 1).otherwise(place(before) + 1)
    return _let(_let(windows, fresh), lambda kept: F.transform(kept, lambda x, i: F.struct(first(x, F.get(kept, i - 1)).alias("at"), x.alias("key"))))


def _distinct(prints: Column) -> Column:
    """Fingerprints by position without those that repeat the position before."""
    return _let(prints, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (x["pos"] != F.get(all_, i - 1)["pos"])))


def selected(text: Column) -> Column:
    """(pos, hash, at) of a text's fingerprints by position; ``at`` is the first window that keeps it.

    A text shorter than a window is one window; one shorter than a gram is a gram; an empty one has none.
    """
    one = lambda pos, hash_, at: F.struct(pos.cast("int").alias("pos"), hash_.alias("hash"), at.cast("int").alias("at"))

    def chunk(c: Column) -> Column:
        part = F.substring(text, c * CHUNK + 1, F.lit(CHUNK + REACH))
        found = _let(_hashes(part, F.length(part)), lambda h: _rolled(h, F.size(h)))
        return F.transform(found, lambda x: one(F.lit(LOW) - x["key"].bitwiseAND(F.lit(LOW)).cast("int") + c * CHUNK, F.shiftright(x["key"], PLACE), x["at"] + c * CHUNK))

    chunks = F.floor((F.greatest(F.length(text) - REACH, F.lit(1)) - 1) / CHUNK).cast("int")
    whole = F.array(one(F.lit(0), gram_hash(F.encode(text, "UTF-32")), F.lit(0)))
    return F.when(F.length(text) >= K, _distinct(F.flatten(F.transform(F.sequence(F.lit(0), chunks), chunk)))).when(F.length(text) > 0, whole).otherwise(F.array().cast(_NONE))


def shown(prints: Column) -> Column:
    """``hash:position`` of each fingerprint, joined by commas."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.lpad(F.lower(F.hex(x["hash"])), 16, "0"), F.lit(":"), x["pos"].cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two texts' fingerprints; two without any are alike."""
    both = lambda x, y: F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(_let(F.size(F.array_intersect(x, y)), lambda n: n / (F.size(x) + F.size(y) - n)))
    hashes = lambda p: F.array_distinct(F.transform(p, lambda x: x["hash"]))
    return _let(hashes(a), lambda x: _let(hashes(b), lambda y: both(x, y)))


def with_next(df: DataFrame, made: dict[str, Column], *columns: str) -> DataFrame:
    """``df`` (doc_id, text, ...) with the columns ``made``, and ``next_<column>`` of the next row by doc_id; the last row's next is the first.

    What is made of a row is made where the row has arrived, and so doesn't travel.

    Rows are dealt into ranges of doc_id whose bounds are ids of the table, four for each shuffle partition; the
    row at a bound is also sent, as a guest, to the range before it, so every range ends with its follower. A row
    finds its range in two steps, among every so many bounds and then among those between. Only the bounds reach
    the driver. Null ids come first; rows of one id follow each other by text.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.select(F.percentile_approx(key, [i / n for i in range(n)], 20 * n).alias("bounds"), F.min(key).alias("first")).first()
    if not found.bounds:
        empty = df.withColumns(made)
        return empty.select("*", *(F.lit(None).cast(dict(empty.dtypes)[c]).alias(f"next_{c}") for c in columns))
    bounds = sorted({found.first, *found.bounds})
    step = math.isqrt(len(bounds)) + 1
    listed = lambda numbers: F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")
    up_to = lambda numbers: F.size(F.filter(numbers, lambda b: b <= F.col("_key")))
    near = df.withColumn("_key", key).withColumn("_near", (up_to(listed(bounds[::step])) - 1) * step)
    ranged = near.withColumn("_range", F.col("_near") + up_to(F.slice(listed(bounds), F.col("_near") + 1, step)))
    place = lambda where, guest: F.struct(where.alias("range"), F.lit(guest).alias("guest"))
    before = F.when(F.col("_range") == 1, len(bounds)).otherwise(F.col("_range") - 1)
    at_bound = F.get(listed(bounds), F.col("_range") - 1) == F.col("_key")
    home = place(F.col("_range"), 0)
    placed = ranged.withColumn("_place", F.explode(F.when(at_bound, F.array(home, place(before, 1))).otherwise(F.array(home))))
    dealt = placed.select("*", F.col("_place.range").alias("_in"), F.col("_place.guest").alias("_guest")).drop("_near", "_range", "_place").repartition(n, "_in").withColumns(made)
    order = Window.partitionBy("_in").orderBy("_guest", "_key", "text")
    followed = dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return followed.where("_guest = 0").drop("_in", "_guest", "_key")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``prints`` (pos, hash, at) of each whole text, by position.

    Null and empty texts have none; every row has a result, whatever its id; other columns are left behind.
    """
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("prints", selected(F.col("text")))


def _edited_prints(own: Column, after: Column, edited: Column, kept: Column, taken: Column) -> Column:
    """Fingerprints of a text of ``kept`` code points of one and the first ``taken`` of another, whose own are known.

    Windows inside either part are windows of it; only those across the seam are rolled anew.
    """
    from_own = F.filter(own, lambda x: x["at"] <= kept - REACH - 1)
    start = F.greatest(kept - REACH, F.lit(0))
    moved = lambda by: lambda x: F.struct((x["pos"] + by).alias("pos"), x["hash"].alias("hash"), (x["at"] + by).alias("at"))
    seam = F.when(taken > 0, F.transform(selected(F.substring(edited, start + 1, kept - start + REACH)), moved(start))).otherwise(F.array().cast(_NONE))
    from_next = F.transform(F.filter(after, lambda x: x["at"] <= taken - REACH - 1), moved(kept))
    return F.when(kept + taken <= REACH, selected(edited)).otherwise(_distinct(F.concat(from_own, seam, from_next)))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    The edited text keeps the first half and takes as many code points (or all) of the next document for the
    rest. Null and empty texts have no fingerprint and are alike to each other; a table of one row follows
    itself; repeated rows follow each other; an empty table gives an empty one; other columns are left behind.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(rows, {"prints": selected(F.col("text"))}, "text", "prints")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    parted = paired.select("doc_id", n.cast("long").alias("n_chars"), "prints", "next_prints", (n - half).alias("kept"), F.least(half, F.length("next_text")).alias("taken"), F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    changed = parted.select("doc_id", "n_chars", "prints", "next_prints", F.sha2("edited", 256).alias("edited_sha256"), _edited_prints(F.col("prints"), F.col("next_prints"), F.col("edited"), F.col("kept"), F.col("taken")).alias("edited_prints"))
    return changed.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("prints")).alias("fingerprint"), shown(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"), likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )
