"""Language identification with a bit-sliced Bloom filter over character n-grams.

Row ``p`` of the filter is a mask with one bit a language (of several words if there are many); an n-gram of language ``l`` sets bit ``l`` in the
rows of its ``HASHES`` positions. The AND of these rows is the set of all languages that hold the n-gram, from
one look-up for all of them. A text's count for a language is the number of its n-grams whose set has the
language; a filter whose bit ``l`` is set in a share ``f`` of the rows reports ``f ** HASHES`` of foreign
n-grams too, so the count is corrected to ``(count - n * fp) / (1 - fp)``. The largest corrected count decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import checkpoint, map_batches

GRAM = 4
HASHES = 2
#: Rows of the filter: a fixed size, whatever the corpus.
ROWS = 1 << 20
#: Labelled documents learned from, at most: those of the smallest hashes of their ids.
TRAINING_ROWS = 12_000
#: An n-gram belongs to a language that has it at least this often for each time the keenest language has it.
SHARE = 0.2
#: n-grams of a language from which on those seen once are left out.
MANY_GRAMS = 10_000
#: Languages of one mask word.
WORD = 64
UNDETERMINED = "und"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def gram_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each run of ``GRAM`` characters of the lower-cased text; a short text is one gram."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < GRAM:
        points = np.concatenate([points, np.zeros(GRAM - len(points), np.uint64)])
    out = points[: len(points) - GRAM + 1].copy()
    for i in range(1, GRAM):
        out *= np.uint64(0x100000001B3)
        out += points[i : len(points) - GRAM + 1 + i]
    out ^= out >> np.uint64(29)
    return out


def positions(hashes: np.ndarray) -> list[np.ndarray]:
    """The filter rows of each n-gram."""
    return [(hashes * m) >> np.uint64(64 - ROWS.bit_length() + 1) for m in _MULTIPLIERS[:HASHES]]


@dataclass
class LanguageFilter:
    """Languages by code point, and for each ``WORD`` of them the filter's rows of one mask word."""

    languages: list[str]
    masks: list[np.ndarray]

    def __post_init__(self):
        fill = [np.count_nonzero(word & word.dtype.type(1 << bit)) / len(word) for word, bit in self._bits()]
        self.false_positive = np.minimum(np.array(fill) ** HASHES, 0.99)

    def _bits(self):
        return ((self.masks[i // WORD], i % WORD) for i in range(len(self.languages)))

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Corrected popcounts by language, and the n-grams of the text."""
        first, *rest = positions(gram_hashes(text))
        hits = []
        for at, word in enumerate(self.masks):
            found = word[first]
            for p in rest:
                found &= word[p]
            hits += [np.count_nonzero(found & found.dtype.type(1 << i)) for i in range(min(WORD, len(self.languages) - WORD * at))]
        return np.maximum(0, (np.array(hits, float) - len(first) * self.false_positive) / (1 - self.false_positive)), len(first)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        counts, n = self.counts(text)
        best = int(counts.argmax())  # ties go to the first language by code point
        total = counts.sum()
        return self.languages[best], float(counts[best] / total) if total else 0.0


def train(docs: DataFrame, fold: Column, rows: int = TRAINING_ROWS) -> LanguageFilter:
    """Learn the filter from the documents of ``fold`` that have a language: ``rows`` of them at most.

    The sample is read once and kept in the shared checkpoint folder. Only its n-gram counts are shuffled, and only
    filter rows (``ROWS`` at most, for each 64 languages of the sample) reach the driver. Rows without text or
    language teach nothing, nor does a null id; without any row the filter knows no language.
    """
    from pyspark.sql import Window

    sample = docs.where(fold & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    labelled = checkpoint(docs.where(fold & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang").join(F.broadcast(sample), "doc_id"))
    languages = sorted(r.lang for r in labelled.select("lang").distinct().collect())

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, found, counts = [], [], []
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                by.setdefault(lang, []).append(gram_hashes(text))
            for lang, grams in by.items():
                u, n = np.unique(np.concatenate(grams), return_counts=True)
                langs += [lang] * len(u)
                found.append(u.view(np.int64))
                counts.append(n)
            return pa.RecordBatch.from_arrays([pa.array(langs), pa.array(np.concatenate(found)), pa.array(np.concatenate(counts).astype(np.int64))], ["lang", "gram", "n"])

        return step

    grams = map_batches(labelled, make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    often = grams.withColumn("total", total).where((F.col("n") > 1) | (F.col("total") < MANY_GRAMS)).withColumn("rate", F.col("n") / F.col("total"))
    kept = often.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= SHARE * F.col("most")).select("lang", "gram")

    number = {lang: i for i, lang in enumerate(languages)}

    def rows_of():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            which = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            bits = np.left_shift(np.uint64(1), (which % WORD).astype(np.uint64))
            at = positions(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            columns = np.tile(which // WORD, HASHES), np.concatenate(at).astype(np.int64), np.tile(bits, HASHES).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "p", "mask"])

        return step

    built = map_batches(kept, rows_of, "word long, p long, mask long").groupBy("word", "p").agg(F.bit_or("mask").alias("mask")).toArrow()
    word, at, mask = (built[c].to_numpy() for c in ("word", "p", "mask"))
    masks = []
    for i in range(0, len(languages), WORD):
        width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if min(WORD, len(languages) - i) <= np.dtype(t).itemsize * 8)
        masks.append(np.zeros(ROWS, width))
        own = word == i // WORD
        masks[-1][at[own]] = mask[own].view(np.uint64).astype(width)
    return LanguageFilter(languages, masks)


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (the language's share of the corrected counts) for each whole text.

    Null, empty and letterless texts give ``und`` and 0; repeated rows give repeated results; an empty table
    gives an empty one; columns other than ``doc_id`` and ``text`` are left behind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS masks: a fixed size

    def make():
        own = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [own.predict(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

        return step

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")
