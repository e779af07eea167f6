"""Toxicity from a weighted lexicon, matched by Aho-Corasick in a folded text.

Folding lower-cases a text, takes letters out of their styles (wide, mathematical, small), drops invisible
characters and loose marks, turns look-alike letters and the digits and signs that stand for letters into the letters
meant, and closes up words spelled letter by letter. The accented letters of Latin-1 are spelling, not disguise, and
stay; accents of other letters go. One automaton holds the lexicon and the exception phrases; a hit inside
an exception is void. The weights of the hits, in sum and by length, give the score through a logistic curve.
Lexicon, exceptions (words and pairs of words around a hit that clean documents have too), weights and curve are
learned from labelled documents.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import checkpoint, map_batches, texts

# Look-alike letters of other scripts, and digits and signs written for letters.
LOOKALIKES = str.maketrans("абвсԁеєһіїјкӏмпоорԛгѕтуцԝхуαβεηικνορτυχωοđłı", "abbcdeehiijklmnoopqrstuuwxyabeniknoptuxwodli") | str.maketrans("0123456789@$€£", "oizeasgtbgasel")
_INNER = {"!": "i", "|": "l", "+": "t"}
_INNER_SIGN = re.compile(r"(?<=[a-z])[!|+](?=[a-z])")
#: Words spelled with a space or sign between their letters, three pairs at least.
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_][ ._*-]){3,}[^\W_](?![^\W_])")
#: Labelled documents learned from, at most: those of the smallest hashes of their ids.
TRAINING_ROWS = 6_000
#: Letters of a lexicon entry.
SHORTEST, LONGEST = 4, 8
#: Documents of the label an entry must be in, and the least log odds that it and, negated, an exception must have.
SUPPORT, ODDS = 4, 3.0
_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"[ ._*-]")


class _Folded(dict):
    """Code point of a lower-case character to what it is folded to."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if unicodedata.category(c) in ("Cf", "Mn", "Me"):
            folded = ""
        elif code > 0xFF:
            folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).translate(LOOKALIKES)
        else:
            folded = c.translate(LOOKALIKES)
        self[code] = folded
        return folded


_FOLDED = _Folded()


def fold(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text).lower().translate(_FOLDED)
    folded = _INNER_SIGN.sub(lambda m: _INNER[m[0]], folded)
    return _SPELLED.sub(lambda m: _SIGNS.sub("", m[0]), folded)


def grams(text: str) -> set[str]:
    """Distinct pieces of the words of a folded text."""
    return {w[i : i + n] for w in set(_WORD.findall(text)) for n in range(SHORTEST, LONGEST + 1) for i in range(len(w) - n + 1)}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-4.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        found.make_automaton()
        return found

    def hits(self, folded: str, automaton) -> list[tuple[int, int, float]]:
        """(start, last character, weight) of the entries in a folded text that lie in no exception."""
        hits, void = [], []
        for end, (n, weight) in automaton.iter(folded):
            (void if weight is None else hits).append((end - n + 1, end, weight))
        return _outside(hits, void) if void and hits else hits

    def features(self, text: str, automaton) -> tuple[int, float, float]:
        """Hits outside exceptions, the log of their weight, and of their weight in 1,000 characters."""
        if not self.weights:
            return 0, 0.0, 0.0
        folded = fold(text)
        hits = self.hits(folded, automaton)
        total = sum(h[2] for h in hits)
        return len(hits), float(np.log1p(total)), float(np.log1p(1000 * total / max(len(folded), 100)))

    def score(self, text: str, automaton) -> tuple[int, float]:
        hits, x, y = self.features(text, automaton)
        a, b, c = self.curve
        return hits, float(1 / (1 + np.exp(-(a + b * x + c * y))))


def _outside(hits: list, void: list) -> list:
    """Hits that lie in no void span: spans sorted by start, with the furthest end so far."""
    void.sort()
    starts = np.array([v[0] for v in void])
    ends = np.maximum.accumulate([v[1] for v in void])
    at = np.searchsorted(starts, [h[0] for h in hits], side="right") - 1
    return [h for h, i in zip(hits, at) if i < 0 or ends[i] < h[1]]


def contexts(folded: str, hits: list[tuple[int, int, float]]) -> set[str]:
    """The word around each hit, and that word with the one before it and with the one after it."""
    words = [m.span() for m in _WORD.finditer(folded)]
    starts = [w[0] for w in words]
    out = set()
    for a, b, _ in hits:
        i = bisect_right(starts, a) - 1
        for j, k in ((i, i), (i - 1, i), (i, i + 1)):
            if j >= 0 and k < len(words) and words[k][0] - words[j][1] <= 1:
                phrase = folded[words[j][0] : words[k][1]]
                if len(phrase) > b - a + 1:
                    out.add(phrase)
    return out


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAINING_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn a lexicon from labelled documents whose id meets ``usable``: ``rows`` of them at most.

    The sample bounds what is counted and what reaches the driver; it is read once and kept in the shared
    checkpoint folder. Null labels, ids and texts teach nothing; a document with two labels counts as toxic if
    either says so; repeated rows count again. Without toxic examples the lexicon is empty and every score is the
    curve's floor.
    """
    labelled = labels.where(usable & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = checkpoint(docs.where(usable & F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"))

    def counted(strings) -> DataFrame:
        """In how many clean and toxic documents each string is that ``strings()`` finds in a text."""

        def make():
            find = strings()

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                tally: dict[str, list[int]] = {}
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for g in find(text):
                        tally.setdefault(g, [0, 0])[int(toxic)] += 1
                columns = [list(tally), [n[0] for n in tally.values()], [n[1] for n in tally.values()]]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["gram", "clean", "toxic"])

            return step

        return map_batches(known, make, "gram string, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    totals = Counter({int(r.toxic): r["count"] for r in known.groupBy("toxic").count().collect()})
    if not totals[1]:
        return Lexicon(exceptions=frozenset(map(fold, exceptions)))
    odds = F.log((F.col("toxic") + 0.5) / (totals[1] + 1)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1))
    least = max(min(SUPPORT, max(3, totals[1] // 10)), totals[1] // 100)
    found = counted(lambda: lambda text: grams(fold(text))).withColumn("odds", odds).where((F.col("toxic") >= least) & (F.col("odds") >= ODDS))
    entries = {r.gram: (r.odds, r.toxic) for r in found.select("gram", "odds", "toxic").collect()}

    # A longer entry that is found in no fewer documents than one inside it tells no more.
    def told(g: str, n: int) -> bool:
        return any(entries.get(g[i:j], (0, -1))[1] * 0.9 <= n and g[i:j] in entries for k in range(SHORTEST, len(g)) for i in range(len(g) - k + 1) for j in [i + k])

    weights = {g: w for g, (w, n) in entries.items() if not told(g, n)}
    first = Lexicon(weights)

    def around():
        automaton = first.automaton()

        def find(text: str) -> set[str]:
            folded = fold(text)
            return contexts(folded, first.hits(folded, automaton)) if weights else set()

        return find

    harmless = {r.gram for r in counted(around).withColumn("odds", odds).where((F.col("clean") >= SUPPORT) & (F.col("odds") <= 0)).select("gram").collect()}
    lexicon = Lexicon(weights, frozenset(harmless | set(map(fold, exceptions))) - set(weights))

    def measure():
        automaton = lexicon.automaton()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [lexicon.features(t, automaton) for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()), batch.column(1).cast(pa.int64())], ["x", "y", "toxic"])

        return step

    points = map_batches(known, measure, "x double, y double, toxic long").toArrow()
    lexicon.curve = _logistic(np.column_stack([points["x"].to_numpy(), points["y"].to_numpy()]), points["toxic"].to_numpy().astype(float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; rows are sorted first so that sums don't depend on their order."""
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    a, y = np.column_stack([np.ones(len(x)), x])[order], y[order]
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, ridge, ridge])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(np.round(w, 6).tolist())


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id``, ``hits`` and ``score`` (0 to 1) of each whole text (null: empty).

    Empty texts get the curve's floor; repeated rows give repeated results; an empty table gives an empty one; other
    columns are left behind, so their names cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # learned from TRAINING_ROWS documents at most

    def make():
        own = shared.value
        automaton = own.automaton()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [own.score(t, automaton) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64())], ["doc_id", "hits", "score"])

        return step

    return map_batches(texts(docs), make, "doc_id long, hits long, score double")


def below(docs: DataFrame, lexicon: Lexicon, limit: float) -> DataFrame:
    """``docs``, all columns whatever their names, without the rows that score ``limit`` or more; null texts score as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # as in ``score``
    text = docs.columns.index("text")

    def make():
        own = shared.value
        automaton = own.automaton()
        return lambda batch: batch.filter(pa.array([own.score(t or "", automaton)[1] < limit for t in batch.column(text).to_pylist()], pa.bool_()))

    return map_batches(docs, make, docs.schema)
