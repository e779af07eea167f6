"""Exact token counts at every prefix of a text, by dynamic programming.

The vocabulary is a byte-pair one whose pieces carry a merge score. For such a vocabulary two facts make a
prefix table possible: an encoding is valid exactly when every two neighbouring tokens encode to themselves,
and a text has one valid encoding. So the last token of the encoding of ``text[:j]`` is the one piece ``t``
ending at ``j`` that is compatible with the last token of ``text[:j - len(t)]``, and

    count[j] = count[j - len(t)] + cost(t)

needs no re-encoding. Truncation (the longest prefix within a budget) and budget questions (the tokens of the
first so many characters) are look-ups in the table. No piece holds a space after another character, a line feed with anything else, or a
letter before a sign (this is checked when the vocabulary is loaded), so no token crosses these places: the table
of a text is the tables of its units end to end, each raised by the tokens before it. A unit's table is kept and
used again wherever the unit recurs, and a look-up opens the one unit that it falls in.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.base import map_batches, texts

MODEL = "piece_bpe_32k.model"
#: Units whose tables one worker keeps (beyond it they are forgotten and made anew), and the length of the longest.
KEPT_UNITS = 1_000_000
LONGEST_KEPT = 48
#: Letters and digits after which a unit may end: no piece holds one of them and then any other character.
LETTERS = "A-Za-z0-9À-ÖØ-öø-ɏ"
UNITS = re.compile(f"\n| *(?:[^ \n{LETTERS}]+[{LETTERS}]*|[{LETTERS}]+)| +")
ENDS = re.compile(f"[{LETTERS}][^{LETTERS}]")


class PrefixCounter:
    """Prefix tables for one vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).replace("▁", " ")
                if " " in piece.lstrip(" ") or ("\n" in piece and piece != "\n") or ENDS.search(piece):
                    raise ValueError(f"piece {piece!r} crosses a unit boundary")
                self.rank[piece] = -model.get_score(i)
        self.longest = max(map(len, self.rank))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.backward: dict = {}  # the pieces as a tree, read from their ends
        for piece in self.rank:
            node = self.backward
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = {}
        self.tables: dict[str, list[int] | bytes] = _Tables(self)

    def cost(self, token: str) -> int:
        """Tokens that a piece stands for: one, or one a byte for a character outside the vocabulary."""
        return 1 if token in self.rank else len(token.encode("utf-8", "surrogatepass"))

    def merged(self, text: str) -> list[str]:
        """The merges themselves, lowest rank first and leftmost among ties, for the short strings of a pair test."""
        parts, rank = list(text), self.rank
        while True:
            ranked = [(rank[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in rank]
            if not ranked:
                return parts
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two tokens, side by side, encode to themselves; an empty one stands for the unit's start."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def table(self, unit: str) -> list[int]:
        """Token counts of ``unit[:0]``, ``unit[:1]``, ... up to the whole unit."""
        rank, pairs, longest = self.rank, self.pairs, self.longest
        count, tail = [0], [""]
        last, start = "", 0
        for j, c in enumerate(unit):
            piece = last + c
            known = None
            if piece in rank:  # the last token grows by one character
                known = pairs.get((tail[start], piece))
                if known is None:
                    known = self.compatible(tail[start], piece)
            if not known:  # another piece that ends here
                node, i, found = self.backward, j, [j]
                while i >= 0 and (node := node.get(unit[i])) is not None and j - i < longest:
                    if "" in node and i != j:
                        found.append(i)
                    i -= 1
                for start in found:
                    piece = unit[start : j + 1]
                    known = pairs.get((tail[start], piece))
                    if known is None:
                        known = self.compatible(tail[start], piece)
                    if known:
                        break
            last = piece
            count.append(count[start] + (1 if piece in rank else self.cost(piece)))
            tail.append(piece)
        return count

    def units(self, text: str) -> list[str]:
        """The text as the vocabulary sees it: spaces and their visible form are one, and one leads the text."""
        return UNITS.findall(" " + text.replace("▁", " ")) if text else []

    def total(self, text: str) -> int:
        tables = self.tables
        return sum([tables[u][-1] for u in self.units(text)])

    def prefixes(self, text: str) -> np.ndarray:
        """``out[i]``: the tokens of the text's first ``i + 1`` code points."""
        prefix = self.prefix(text)
        tables = [np.frombuffer(t, np.uint8) if isinstance(t, bytes) else np.asarray(t) for t in map(self.tables.__getitem__, prefix.units)]
        if not tables:
            return np.zeros(0, np.int32)
        counts = np.concatenate([t[1:] for t in tables]).astype(np.int32) + np.repeat(np.asarray(prefix.tokens[:-1], np.int32), [len(t) - 1 for t in tables])
        return counts[1:]  # without the space that leads the text

    def prefix(self, text: str) -> Prefix:
        units = self.units(text)
        tables = self.tables
        return Prefix(units, list(accumulate([tables[u][-1] for u in units], initial=0)), self.tables)

    def cut(self, text: str, budget: int) -> int:
        """Code points of the longest prefix that takes at most ``budget`` tokens."""
        return self.prefix(text).cut(budget)


class Prefix:
    """The prefix table of one text: its units, the tokens before each of them and after the last, and their tables."""

    def __init__(self, units: list[str], tokens: list[int], tables: dict):
        self.units, self.tokens, self.tables = units, tokens, tables

    @property
    def total(self) -> int:
        return self.tokens[-1]

    def at(self, chars: int) -> int:
        """Tokens of the first ``chars`` code points."""
        if not self.units or chars <= 0:
            return 0
        ends = np.cumsum(np.fromiter(map(len, self.units), np.int64, len(self.units))) - 1  # the leading space is no character of the text
        i = int(np.searchsorted(ends, chars))
        if i == len(ends):
            return self.total
        return self.tokens[i] + self.tables[self.units[i]][chars - int(ends[i]) + len(self.units[i])]

    def cut(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens.

        The tokens before a unit never fall, and no prefix that ends in a unit has fewer than one more; so the
        last unit that can hold the end is tried, and the one before it ends within the budget.
        """
        if self.total <= budget:
            return max(0, sum(map(len, self.units)) - 1)
        i = bisect_right(self.tokens, budget - 1) - 1
        if i < 0:
            return 0
        before = sum(map(len, self.units[:i])) - 1
        table, left = self.tables[self.units[i]], budget - self.tokens[i]
        within = max((j for j in range(len(table)) if table[j] <= left), default=0)
        return max(0, before + within)


class _Tables(dict):
    """Unit to its table, in bytes where the counts fit in them."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, unit: str) -> list[int] | bytes:
        if len(self) >= KEPT_UNITS:
            self.clear()
        table = self.counter.table(unit)
        if len(unit) <= LONGEST_KEPT:
            table = self[unit] = bytes(table) if table[-1] < 64 else table
        return table


@lru_cache(maxsize=2)
def counter(name: str = MODEL) -> PrefixCounter:
    import public_tokenizers

    return PrefixCounter(public_tokenizers.path(name))


def prefix_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id`` and ``prefix_tokens``: the exact token count of each prefix, one entry a code point.

    Null and empty texts give an empty list; repeated rows give repeated results; other columns are left
    behind, so their names cannot clash.
    """

    def make():
        table = counter(model)
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([table.prefixes(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "prefix_tokens"])

    return map_batches(texts(docs), make, "doc_id long, prefix_tokens array<int>")


def token_counts(docs: DataFrame, limit: int = 4096, model: str = MODEL) -> DataFrame:
    """Bytes, tokens, the tokens of the first half and the cut to a budget, for each whole text.

    All come from the text's prefix table: ``n_tokens`` is its last entry, ``half_tokens`` its entry at half of the
    code points (rounded down), and ``cut_chars`` the length of the longest prefix of at most ``limit`` tokens, null
    where the whole text fits. Null and empty texts have 0 bytes and 0 tokens;
    repeated rows give repeated results; an empty table gives an empty one; other columns are left behind.
    """

    def make():
        table = counter(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = batch.column(1).to_pylist()
            found = []
            for t in rows:
                prefix = table.prefix(t)
                found.append((prefix.total, prefix.at(len(t) // 2), prefix.cut(limit) if prefix.total > limit else None))
            totals, halves, cuts = zip(*found)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in rows], pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals]), pa.array(halves, pa.int64()), pa.array(cuts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "half_tokens", "cut_chars"],
            )

        return step

    return map_batches(texts(docs), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, half_tokens long, cut_chars long")
