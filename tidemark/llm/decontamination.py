"""Benchmark passages in documents, found by pigeonhole edit matching.

An item may differ from a passage by ``k`` edits. Cut into ``k + 1`` pieces, one piece at least is then in the
passage unchanged, so one Aho-Corasick automaton over all pieces finds every place worth a look, and Myers'
bit-parallel distance decides there. Texts and items are compared lower-cased, with every run of
characters other than letters and digits as one space, and one space at either end: so an item begins and ends with
its words, and a passage that ends inside a word is an edit away.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.base import checkpoint, map_batches, texts

#: Edits allowed for each character of an item.
ERROR_RATE = 0.06
#: Characters of items in one automaton; a larger benchmark is matched in blocks.
BLOCK_CHARS = 2_000_000
_GAP, _WORD = re.compile(r"[\W_]+"), re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    """The text's words, each with a space on either side; empty if there are none."""
    words = _WORD.findall(text.lower())
    return f" {' '.join(words)} " if words else ""


def budget(item: str, rate: float = ERROR_RATE) -> int:
    """Edits allowed for a normalised item, by the length of its words and the spaces between them."""
    return int((len(item) - 2) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with their offsets."""
    n = min(errors + 1, len(item))
    bounds = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


class Myers:
    """Edit distance of a pattern to the best substring that ends at each place of a text."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.where: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.where[c] = self.where.get(c, 0) | 1 << i
        self.full, self.top = (1 << self.m) - 1, 1 << (self.m - 1)

    def best(self, text: str, anchored: bool = False) -> tuple[int, int]:
        """(least distance, end of the first substring that has it); anchored substrings begin at the text's start."""
        full, top, get = self.full, self.top, self.where.get
        up, down, score = full, 0, self.m
        least, end = score, 0
        for at, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | down
            xh = ((((eq & up) + up) & full) ^ up) | eq
            ph = down | (full & ~(xh | up))
            mh = up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1 | anchored) & full
            mh = (mh << 1) & full
            up = mh | (full & ~(xv | ph))
            down = ph & xv
            if score < least:
                least, end = score, at
        return least, end


@dataclass
class Item:
    item_id: int
    text: str
    errors: int


class Matcher:
    """Items whose passages are looked for together."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items = items
        self.forward = [Myers(i.text) for i in items]
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(items):
            for offset, piece in pieces(item.text, item.errors):
                by.setdefault(piece, []).append((n, offset))
        for piece, uses in by.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if by:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best passage of each item that is near enough, in ``text``."""
        if not len(self.automaton):
            return []
        places: dict[int, set[int]] = {}
        for end, (n, uses) in self.automaton.iter(text):
            for item, offset in uses:
                places.setdefault(item, set()).add(end - n + 1 - offset)
        out = []
        for n, starts in places.items():
            item, best = self.items[n], None
            m, k = len(item.text), item.errors
            for a, b in _windows(sorted(starts), m, k):
                window = text[max(0, a) : b]
                if len(window) < m - k:
                    continue
                distance, end = self.forward[n].best(window)
                if distance <= k and (best is None or distance < best[1]):
                    tail = window[max(0, end - m - k) : end]
                    length = Myers(item.text[::-1]).best(tail[::-1], anchored=True)[1]
                    best = (n, distance, max(0, a) + end - length, max(0, a) + end)
            if best:
                out.append(best)
        return sorted(out)


def _windows(starts: list[int], m: int, k: int) -> Iterator[tuple[int, int]]:
    """Stretches of text, merged where they overlap, that hold a passage that began near one of ``starts``."""
    a, b = None, 0
    for s in starts:
        if a is not None and s - k <= b:
            b = max(b, s + m + k)
            continue
        if a is not None:
            yield a, b
        a, b = s - k, s + m + k
    if a is not None:
        yield a, b


def places_in(text: str) -> list[int]:
    """For each character of the normalised text but the spaces at its ends, the place in ``text`` that it comes from.

    Lower-casing can lengthen a text; its places are then traced character by character.
    """
    lowered = text.lower()
    origin = list(range(len(text))) if len(lowered) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    out, at = [], 0
    for m in _GAP.finditer(lowered):
        out += origin[at : m.start()]
        if m.start() > 0 and m.end() < len(lowered):
            out.append(origin[m.start()])
        at = m.end()
    return out + origin[at:]


def blocks(benchmark: DataFrame, rate: float) -> Iterator[list[Item]]:
    """The items in blocks of bounded size, normalised; those without a letter or digit match nothing."""
    held, chars = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if text := normalise(r.text):
            held.append(Item(r.item_id, text, budget(text, rate)))
            chars += len(text)
        if chars > BLOCK_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A passage of a normalised text without the spaces at its ends, counted without the space that leads the text."""
    return a - 1 + (text[a] == " "), b - 1 - (text[b - 1] == " ")


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """One row for each document and item whose passage it holds: ``doc_id``, ``item_id``, ``distance``, ``budget``, ``start``, ``end``.

    ``start`` and ``end`` are code points of the whole text, for the nearest passage (the first among equals).
    The benchmark is the query set: block by block, each bounded in size, it goes to the executors and meets every
    row. Null and empty texts and items match nothing; repeated rows give repeated results; an empty benchmark or
    table gives an empty result; other columns are left behind.
    """
    schema = "doc_id long, item_id long, distance int, budget int, start long, end long"
    out, rows = None, texts(docs)
    for block in blocks(benchmark, rate):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_CHARS and one item at most

        def make(shared=shared):
            matcher = Matcher(shared.value)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    plain = normalise(text)
                    if hits := matcher.find(plain):
                        origin = places_in(text)
                        for n, d, a, b in hits:
                            a, b = _trimmed(plain, a, b)
                            found.append((doc, matcher.items[n].item_id, d, matcher.items[n].errors, origin[a], origin[b - 1] + 1))
                return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "distance", "budget", "start", "end"])

            return step

        part = map_batches(rows, make, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """``docs``, all columns whatever their names, without the rows whose text holds a passage of the benchmark.

    Each row is judged by its own text where it is, so nothing is shuffled; what one block of the benchmark leaves is
    written to the shared checkpoint folder for the next. Null and empty texts stay; an empty benchmark takes nothing.
    """
    text = docs.columns.index("text")
    left = docs
    for i, block in enumerate(blocks(benchmark, rate)):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # as in ``matches``

        def make(shared=shared):
            matcher = Matcher(shared.value)
            return lambda batch: batch.filter(pa.array([not matcher.find(normalise(t or "")) for t in batch.column(text).to_pylist()], pa.bool_()))

        left = map_batches(checkpoint(left) if i else left, make, docs.schema)
    return left
