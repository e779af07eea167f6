"""Removal of repeated 100-byte strings, by suffix arrays built with a difference cover.

A suffix array of the whole corpus would hold every byte position; only those that can matter are kept. The least
hash of all 32-byte grams in a 100-byte window is its anchor, and equal windows have equal anchors. Windows
next to each other mostly share theirs and form a segment, so there is about one segment for each 36 bytes.

1. Segments are gathered by anchor. An anchor seen once has no repeated window. Segments of equal bytes are one
   class; all windows of its later members repeat its first. A batch of documents finds its own later members
   before anything is shuffled, so a passage of very many documents is a row a batch.
2. Classes that share an anchor with other classes may share some of their windows. Their bytes, each class's
   with an end mark of its own, are laid side by side in shards of whole anchor groups. The difference-cover
   algorithm sorts each shard's suffixes: sampled triples are sorted and named, the string of names is sorted
   in the same way, the other suffixes are sorted by their first byte and the rank that follows, and both
   are merged. Neighbours in the suffix array with equal prefixes of 100 bytes are repeats of each other.
3. The classes of an anchor group of over ``GROUP`` are segmented again by the least hash of longer grams, and go
   through the same two steps; at the last length a gram is the whole window, and a group holds equal windows alone.
4. Windows that repeat one starting under 100 bytes before them (stretches of a short period, such as rules of dashes)
   are found in their own text, before anything is shuffled: two windows of one segment are never further apart.

So the suffix arrays are built shard by shard, each whole in one task, and Spark deals out the shards; triples are not
sorted across tasks. Equal segments never reach a suffix array: they are told by 64-bit hashes of their bytes.

Each window is judged on the input: what repeats an earlier start, in an earlier document or the same one, goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import checkpoint, map_batches

WINDOW = 100
#: Bytes of the grams whose least hash is an anchor; a group that is too large goes on to the next.
GRAMS = (32, 64, WINDOW)
#: Classes of one anchor group in a shard, and bytes of a shard before the next group opens another.
GROUP, SHARD_BYTES = 2000, 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, gram: int = GRAMS[0]) -> np.ndarray:
    """A hash of each run of ``gram`` bytes, by doubling; the last two halves may overlap."""
    h, size = (data.astype(np.uint64) + np.uint64(1)) * _M1, 1
    while size < gram:
        step = min(size, gram - size)
        h = ((h[:-step] * _M2) ^ (h[step:] >> np.uint64(7))) * _M1
        h ^= h >> np.uint64(29)
        size += step
    return h


def segments(data: bytes, gram: int = GRAMS[0], hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, end) of the runs of windows that have one anchor; ``end`` is that of the last window.

    Where a gram is the whole window, windows next to each other are of one anchor in runs of one byte alone, and all
    but the first repeat it (see ``own_repeats``): that first window is the segment.
    """
    if len(data) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, span, wide = gram_hashes(np.frombuffer(data, np.uint8), gram) if hashes is None else hashes, 1, WINDOW - gram + 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: span - wide], least[wide - span :])
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    if gram == WINDOW:
        return least[starts], starts, starts + WINDOW
    # Long runs (of periodic text) are cut, at a distance from their start that their bytes alone decide.
    ends = np.concatenate([starts[1:], [len(least)]])
    if (ends - starts).max(initial=0) > 100:
        starts = np.concatenate([np.arange(a, b, 100) for a, b in zip(starts, ends)])
        ends = np.concatenate([starts[1:], [len(least)]])
    return least[starts], starts, ends - 1 + WINDOW


def own_repeats(data: bytes, hashes: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of what windows cover that repeat a window starting under 100 bytes before them in the same text.

    Two such windows at a distance p make a stretch of period p. In it the grams at x and x + p have equal hashes for
    69 places in a row, so one of these places is a multiple of 64: only these are looked at, against the 99 grams
    behind each, and the bytes decide how far the period holds. Windows of one segment are never further apart, so
    segments need comparing with others only.
    """
    n = len(hashes)
    if n < WINDOW - GRAMS[0] + 2:
        return []
    near = np.lib.stride_tricks.sliding_window_view(np.concatenate([hashes, np.zeros(WINDOW - 1, np.uint64)]), WINDOW)[:n:64]
    rows, gaps = np.nonzero(near[:, 1:] == near[:, :1])
    raw, out, done = np.frombuffer(data, np.uint8), [], {}
    for x, p in zip((rows * 64).tolist(), (gaps + 1).tolist()):
        if x < done.get(p, 0):
            continue
        low = max(0, x - 64)
        differ = np.flatnonzero(raw[low:x] != raw[low + p : x + p])
        left = low + int(differ[-1]) + 1 if len(differ) else low
        right, step = x, 256
        while right + p < len(raw):
            differ = raw[right : right + step][: len(raw) - right - p] != raw[right + p : right + p + step]
            if differ.any():
                right += int(differ.argmax())
                break
            right, step = right + len(differ), step * 2
        done[p] = right
        if right - left >= WINDOW:
            out.append((left + p, right + p))
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of positive integers, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two, zero = (np.arange(r, n + (n % 3 == 1 and r == 1), 3) for r in (1, 2, 0))
    sample = np.concatenate([one, two])
    if t.max() < 1 << 21:
        key = t[sample] << 42 | t[sample + 1] << 21 | t[sample + 2]
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        triples = np.stack([t[sample + k][order] for k in range(3)])
        fresh = np.concatenate([[True], (triples[:, 1:] != triples[:, :-1]).any(0)])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh)
    if not fresh.all():
        order = suffix_array(names)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    big = np.int64(len(sample) + 2)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    # A suffix at 0 modulo 3 is its first character and the rank behind it; so is one at 1; one at 2 needs two characters.
    zero = zero[np.argsort(t[zero] * big + rank[zero + 1], kind="stable")]
    mod = sampled % 3
    ones, twos = sampled[mod == 1], sampled[mod == 2]
    pair = lambda i: t[i] * big + rank[i + 1]
    _, dense = np.unique(t[:-1] * (t.max() + 1) + t[1:], return_inverse=True)  # two characters as one number
    third = lambda i: dense[i] * big + rank[i + 2]
    out = np.empty(n, np.int64)
    below = np.searchsorted(pair(ones), pair(zero)) + np.searchsorted(third(twos), third(zero))
    out[np.arange(len(zero)) + below] = zero
    smaller = np.empty(len(sampled), np.int64)
    smaller[mod == 1] = np.searchsorted(pair(zero), pair(ones))
    smaller[mod == 2] = np.searchsorted(third(zero), third(twos))
    out[np.arange(len(sampled)) + smaller] = sampled
    return out


def repeats(pieces: list[bytes], place: np.ndarray) -> np.ndarray:
    """For windows of all ``pieces``, in order: whether an equal one stands at a smaller ``place``.

    ``place`` has a number for each window: its order in the corpus.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    bases = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text[:] = data.astype(np.int64) + len(pieces) + 1
    text[bases + sizes] = np.arange(1, len(pieces) + 1)  # an end mark of its own for each piece
    counts = sizes - WINDOW + 1
    at = np.repeat(bases - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    number = np.full(len(text), -1, np.int64)
    number[at] = np.arange(len(at))
    order = number[suffix_array(text)]
    order = order[order >= 0]
    view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    equal = np.zeros(len(order), bool)
    for i in range(1, len(order), 1 << 16):
        j = min(len(order), i + (1 << 16))
        equal[i:j] = (view[at[order[i:j]]] == view[at[order[i - 1 : j - 1]]]).all(1)
    heads = np.flatnonzero(~equal)
    first = np.repeat(np.minimum.reduceat(place[order], heads), np.diff(np.append(heads, len(order))))
    out = np.zeros(len(order), bool)
    out[order] = place[order] > first
    return out


def _documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``d`` (order of the document), ``t`` (hash of its text: order among rows of one id) and ``text``."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


# A segment's place in its text: its start, and 9 bits of its length.
def _start(pos: Column) -> Column:
    return F.shiftright(pos, 9)


_SEGMENTS = "later boolean, gram long, class long, d long, t long, pos long"


def _segment_rows(texts: Iterable[tuple[int, int, int, bytes]], gram: int) -> pa.RecordBatch:
    """Segments of (d, t, place of the first byte, bytes): ``gram``, ``class``, ``d``, ``t``, ``pos``, one row for each class here.

    Members of a class after its first come as rows with ``later`` set, merged where they overlap: ``d``, ``t``,
    ``pos`` (of the start) and, as ``gram``, the end. So do, for whole texts (the shortest grams), their own repeats.
    """
    from xxhash import xxh64_intdigest

    out, own = [[np.zeros(0, np.int64)] for _ in range(5)], []
    for d, t, base, data in texts:
        hashes = gram_hashes(np.frombuffer(data, np.uint8), gram) if len(data) >= WINDOW else None
        grams, a, b = segments(data, gram, hashes)
        if gram == GRAMS[0] and hashes is not None:
            own += [(d, t, start << 9, end) for start, end in own_repeats(data, hashes)]
        out[0].append(grams.view(np.int64))
        out[1].append(np.fromiter((xxh64_intdigest(data[i:j]) for i, j in zip(a.tolist(), b.tolist())), np.uint64, len(a)).view(np.int64))
        out[2].append(np.full(len(a), d, np.int64))
        out[3].append(np.full(len(a), t, np.int64))
        out[4].append((a + base) << 9 | (b - a))
    rows = np.stack([np.concatenate(c) for c in out])
    rows = rows[:, np.lexsort(rows[::-1])]
    _, new_class, later = _told_apart(rows)
    d, t, pos, end = (np.concatenate(x) for x in zip(_merged(*rows[2:, later]), np.array(own, np.int64).reshape(-1, 4).T))
    columns = [np.concatenate(c) for c in zip(rows[:, new_class], (end, np.zeros_like(end), d, t, pos))]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(columns[0])) >= np.count_nonzero(new_class)), *map(pa.array, columns)], ["later", "gram", "class", "d", "t", "pos"])


def _found(docs: DataFrame) -> DataFrame:
    """The segments of a batch of documents, by the shortest grams."""
    make = lambda: lambda b: _segment_rows(((d, t, 0, text.encode("utf-8", "surrogatepass")) for d, t, text in zip(*(c.to_pylist() for c in b.columns))), GRAMS[0])
    return map_batches(docs.select("d", "t", "text"), make, _SEGMENTS)


def _finer(pieces: DataFrame, gram: int) -> DataFrame:
    """The segments of a batch of pieces, by longer grams."""
    make = lambda: lambda b: _segment_rows(((d, t, pos >> 9, piece) for d, t, pos, piece in zip(*(c.to_pylist() for c in b.columns))), gram)
    return map_batches(pieces.select("d", "t", "pos", "piece"), make, _SEGMENTS)


def _told_apart(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted (gram, class, d, t, pos): where a gram begins, where a class begins, and what is later in a class than its first."""
    gram, cls, *place = rows
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)]
    new_class = new_gram | np.concatenate([[True], cls[1:] != cls[:-1]])[: len(gram)]
    first = np.maximum.accumulate(np.where(new_class, np.arange(len(gram)), 0))
    return new_gram, new_class, ~new_class & np.any([p != p[first] for p in place], axis=0)


def _merged(d: np.ndarray, t: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(d, t, pos of the start, end) of the stretches of each document that the segments at ``pos`` cover."""
    order = np.lexsort((pos, t, d))
    d, t, pos = d[order], t[order], pos[order]
    start, end = pos >> 9, (pos >> 9) + (pos & 511)
    reach = end.copy()
    fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])[: len(d)]
    # The furthest end so far, document by document: ends are lifted apart by document before the running maximum.
    which = np.cumsum(fresh)
    lift = which * np.int64(1 << 40)
    reach = np.maximum.accumulate(end + lift) - lift if len(d) else end
    fresh |= np.concatenate([[True], start[1:] > reach[:-1]])[: len(d)]
    last = np.concatenate([fresh[1:], [True]])[: len(d)]
    return d[fresh], t[fresh], pos[fresh], reach[last]


def _classes(found: DataFrame) -> DataFrame:
    """``gram``, ``classes``, ``d``, ``t``, ``pos`` of segments that matter; ``classes`` is 0 for later members of a class.

    Where ``classes`` is 0, ``gram`` is the end. Rows arrive by anchor, sorted, and are told apart as they pass; of
    an anchor still open the first of each class is held, and from ``GROUP`` on not even these. Rows that are
    later members already are dealt by themselves.
    """

    names = ["gram", "classes", "d", "t", "pos"]

    def batch(a: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
        gram, _, d, t, pos = a
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.where(classes == 0, (pos >> 9) + (pos & 511), gram), classes, d, t, pos)], names)

    def settled(a: np.ndarray, large: bool) -> pa.RecordBatch:
        """Whole groups. ``large``: the first row was given out before, and its group is a large one."""
        new_gram, new_class, later = _told_apart(a)
        group = np.cumsum(new_gram) - 1
        count = np.bincount(group, new_class).astype(np.int64)[group]
        if large:
            count[group == 0] = GROUP + 1
        keep = later | (new_class & (count > 1))
        keep[0] &= not large
        return batch(a[:, keep], np.where(later, 0, count)[keep])

    def unsettled(a: np.ndarray, large: bool) -> tuple[pa.RecordBatch, np.ndarray, bool]:
        """What can be told of a group that is still open, what must be held of it, and whether it is a large one."""
        _, new_class, later = _told_apart(a)
        firsts = a[:, new_class]
        if not large and firsts.shape[1] <= GROUP:
            return batch(a[:, later], np.zeros(later.sum(), np.int64)), firsts, False
        keep = later | new_class
        keep[0] &= not large
        return batch(a[:, keep], np.where(later, 0, GROUP + 1)[keep]), firsts[:, -1:], True

    def run(batches):
        held, large = np.zeros((5, 0), np.int64), False
        for b in batches:
            later = b.column(0).to_numpy(zero_copy_only=False)
            a = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6)])
            if later.any():
                done = a[:, later]
                yield pa.RecordBatch.from_arrays([pa.array(done[0]), pa.array(np.zeros(done.shape[1], np.int64)), *map(pa.array, done[2:])], names)
            held = np.concatenate([held, a[:, ~later]], axis=1)
            cut = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
            if cut:
                yield settled(held[:, :cut], large)
                held, large = held[:, cut:], False
            if held.shape[1]:
                out, held, large = unsettled(held, large)
                yield out
        if held.shape[1]:
            yield settled(held, large)

    dealt = found.repartition(F.when(F.col("later"), F.xxhash64("d", "t", "pos")).otherwise(F.col("gram")))
    return dealt.sortWithinPartitions("later", "gram", "class", "d", "t", "pos").mapInArrow(run, "gram long, classes long, d long, t long, pos long")


def _bytes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``gram``, ``d``, ``t``, ``pos`` and ``piece``, the segment's bytes.

    The documents are dealt as in ``dedup``, with the same columns, so that Spark shuffles the texts once.
    """
    lists = wanted.groupBy("d", "t").agg(F.collect_list(F.struct("gram", "pos")).alias("w"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for d, t, text, wanted in zip(*(c.to_pylist() for c in batch.columns[1:])):
                data = text.encode("utf-8", "surrogatepass")
                out += [(w["gram"], d, t, w["pos"], data[w["pos"] >> 9 : (w["pos"] >> 9) + (w["pos"] & 511)]) for w in wanted]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((*[pa.int64()] * 4, pa.binary()))], ["gram", "d", "t", "pos", "piece"])

        return step

    return map_batches(docs.join(lists, ["d", "t"]).select("doc_id", "d", "t", "text", "w"), make, "gram long, d long, t long, pos long, piece binary")


def _runs(d: list, t: list, pos: list, pieces: list[bytes]) -> pa.RecordBatch:
    """Repeated windows of a shard as runs: ``d``, ``t``, ``start``, ``end``."""
    counts = np.fromiter(map(len, pieces), np.int64, len(pieces)) - WINDOW + 1
    d, t, pos = (np.array(x, np.int64) for x in (d, t, pos))
    start = np.repeat(pos >> 9, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    which, text = np.repeat(d, counts), np.repeat(t, counts)
    place = np.empty(len(start), np.int64)
    order = np.lexsort((start, text, which))
    same = np.concatenate([[False], (which[order][1:] == which[order][:-1]) & (text[order][1:] == text[order][:-1]) & (start[order][1:] == start[order][:-1])])
    place[order] = np.cumsum(~same)
    hit = np.flatnonzero(repeats(pieces, place))
    if not len(hit):
        return _intervals(*[np.zeros(0, np.int64)] * 4)
    piece = np.repeat(np.arange(len(pieces)), counts)
    opens = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (piece[hit[1:]] != piece[hit[:-1]])]))
    closes = np.append(opens[1:], len(hit)) - 1
    return _intervals(which[hit[opens]], text[hit[opens]], start[hit[opens]], start[hit[closes]] + WINDOW)


def _intervals(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["d", "t", "start", "end"])


_INTERVALS = "d long, t long, start long, end long"


def _shards(pieces: DataFrame) -> DataFrame:
    """Repeated windows among pieces of one anchor: whole groups are laid in a shard until it is large enough."""

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if g != last and size > SHARD_BYTES:
                    yield _runs(*zip(*rows))
                    rows, size = [], 0
                last = g
                rows.append(row)
                size += len(row[3])
        if rows:
            yield _runs(*zip(*rows))

    return pieces.select("gram", "d", "t", "pos", "piece").repartition("gram").sortWithinPartitions("gram").mapInArrow(run, _INTERVALS)


def removals(docs: DataFrame) -> DataFrame:
    """``d``, ``t``, ``start``, ``end``: bytes of each document that repeat; intervals may overlap."""
    return _removals(_documents(docs))


def _removals(held: DataFrame) -> DataFrame:
    """Levels of longer grams follow in one plan, so that all of them read one shuffle of the texts."""
    parts, known = [], checkpoint(_classes(_found(held)))
    for i, gram in enumerate(GRAMS):
        if i:
            known = _classes(_finer(_bytes_of(held, known.where(F.col("classes") > GROUP)), gram))
        parts.append(known.where("classes = 0").select("d", "t", _start(F.col("pos")).alias("start"), F.col("gram").alias("end")))
        if gram < WINDOW:  # at the last length a segment is one window, and those that differ share none
            parts.append(_shards(_bytes_of(held, known.where(F.col("classes").between(2, GROUP)))))
    return reduce(DataFrame.unionByName, parts)


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` and ``kept`` (remaining bytes).

    Null and empty texts have no bytes; texts under 100 bytes keep all. Documents are ordered by doc_id, a null
    one first; rows of one doc_id and text are one document and get one result each, and rows of one doc_id
    or of none, with other texts are ordered by a 64-bit hash of the text. An empty table gives an empty one; other columns are
    left behind.
    """
    held = _documents(docs)
    lists = _removals(held).groupBy("d", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, removed, runs, digests, kept = [], [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                out, at, n = [], 0, 0
                end = -1
                for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                    if a > end:
                        n += 1
                        out.append(data[at:a])
                    at = end = max(end, b)
                rest = b"".join(out) + data[at:]
                sizes.append(len(data))
                removed.append(len(data) - len(rest))
                runs.append(n)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, runs)), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

        return step

    return map_batches(held.join(lists, ["d", "t"], "left").select("doc_id", "text", "spans"), make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
