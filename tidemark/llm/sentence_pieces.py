"""SentencePiece encoding and decoding through a table of distinct marked words.

The library turns every space into a marker and puts one in front of the text. No piece of the vocabulary holds a
marker after another character (this is checked when it is loaded), so no merge crosses from a word into the marker
of the next: a run of markers with the word behind it is encoded alike wherever it stands. Each such marked word is
segmented once, and the ids of a text are those of its words, joined back in the order of their positions.

A marked word is named by what follows its first marker, which is also the text that the library takes for it: the
words of ``a  b`` are ``a`` and `` b``. Words of several blocks of documents (a block is an Arrow batch) are segmented
in one distributed table. Its most frequent entries, ``TABLE_WORDS`` at most and none longer than ``LONGEST_WORD``, are
sent to the workers; all other words are segmented where they stand, once a block. Texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import checkpoint, map_batches, texts

MODEL = "piece_bpe_32k.model"
#: The most words that are broadcast, and the most characters of each: some tens of MB a worker at most.
TABLE_WORDS = 150_000
LONGEST_WORD = 64
MARKER = "▁"
RUNS = re.compile(" *[^ ]+| +")
#: Texts whose encodings must be those of their words, so that a vocabulary with other rules is refused.
PROBES = ("a", " a", "a  b ", "   ", "x\n\ny \t z", "q▁w ▁", "é🙂 \x00 <s>", "1 22 333   4444")


def words_of(text: str) -> list[str]:
    """The marked words of a text, each without its first marker; an empty text has none."""
    if not text:
        return []
    text = text.replace(MARKER, " ")
    if "  " not in text and text[-1] != " " and text[0] != " ":
        return text.split(" ")
    return [run[1:] for run in RUNS.findall(" " + text)]


class Vocabulary:
    """One model of the library, checked to segment marked words alike wherever they stand."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if crossing := [p for p in pieces if MARKER in p.lstrip(MARKER)]:
            raise ValueError(f"pieces cross a marker: {crossing[:5]}")
        self.ends = self.model.bos_id(), self.model.eos_id()
        self.lone = [self.model.piece_to_id(MARKER)]
        for probe in PROBES:
            if self.model.encode(probe) != [i for ids in self.segment(words_of(probe)) for i in ids]:
                raise ValueError(f"{path} doesn't encode {probe!r} word by word")

    def decode(self, ids: pa.ListArray) -> list[str]:
        """The text of each list of ids; null lists count as empty."""
        return self.model.decode([x or [] for x in ids.to_pylist()], num_threads=1) if len(ids) else []

    def segment(self, words: list[str]) -> list[list[int]]:
        """The ids of each marked word; the empty one is a marker alone."""
        return [ids if word else self.lone for word, ids in zip(words, self.model.encode(words, num_threads=1))] if words else []


@lru_cache(maxsize=2)
def vocabulary(name: str = MODEL) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name))


class Segments:
    """Words numbered in the order in which they came, and their ids end to end."""

    def __init__(self, words: list[str], ids: list[list[int]]):
        self.number = dict(zip(words, range(len(words))))
        self.length = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.fromiter(chain.from_iterable(ids), np.int32, int(self.length.sum()))

    def encoded(self, batch: list[list[str]], segment) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them by text) of a batch of texts' words; words without a number are segmented now, once."""
        counts = np.fromiter(map(len, batch), np.int64, len(batch))
        words = list(chain.from_iterable(batch))
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        length, flat = self.length, self.flat
        if len(missing := np.flatnonzero(at < 0)):
            fresh = [words[i] for i in missing.tolist()]
            own = list(dict.fromkeys(fresh))
            more = Segments(own, segment(own))
            at[missing] = np.fromiter(map(more.number.__getitem__, fresh), np.int64, len(fresh)) + len(length)
            length, flat = np.concatenate([length, more.length]), np.concatenate([flat, more.flat])
        start = np.cumsum(length) - length
        took = length[at]
        ends = np.cumsum(took)
        ids = flat[np.repeat(start[at] - (ends - took), took) + np.arange(int(took.sum()))]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])


def word_table(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``word``, ``blocks`` and ``ids`` of every marked word that is in more than one block, each segmented once.

    A block gives each of its words once, so a word that is very common is counted from few rows.
    """

    def spotted():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: set[str] = set()
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
            return pa.RecordBatch.from_arrays([pa.array([w for w in seen if len(w) <= LONGEST_WORD], pa.string())], ["word"])

        return step

    def segmented():
        own = vocabulary(model)
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.segment(b.column(0).to_pylist()), pa.list_(pa.int32()))], ["word", "blocks", "ids"])

    counted = map_batches(texts(docs).select("text"), spotted, "word string").groupBy("word").agg(F.count("*").alias("blocks")).where("blocks > 1")
    return map_batches(counted, segmented, "word string, blocks long, ids array<int>")


def frequent(table: DataFrame, most: int = TABLE_WORDS) -> Segments:
    """The words of most blocks, ``most`` at most: those above the least power of two that leaves so few."""
    octave = F.floor(F.log2("blocks")).cast("int")
    left, least = most, 64
    for row in sorted(table.groupBy(octave.alias("octave")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if row.n > left:
            break
        left, least = left - row.n, row.octave
    rows = table.where(octave >= least).select("word", "ids").toArrow()
    return Segments(rows.column("word").to_pylist(), rows.column("ids").to_pylist())


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id`` and ``ids``: the encoding of each whole text, begin and end ids included.

    Null and empty texts give the begin and end ids alone; repeated rows, and rows of one or a null id, give a row
    each; an empty table gives an empty one; a text of one very long word is segmented as it is; other columns are
    left behind, so their names cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent(checkpoint(word_table(docs, model))))

    def make():
        own, table = vocabulary(model), shared.value
        first, last = own.ends

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, counts = table.encoded([words_of(t) for t in batch.column(1).to_pylist()], own.segment)
            ends = np.cumsum(counts)
            whole = np.insert(ids, np.stack([ends - counts, ends], 1).ravel(), np.tile(np.array([first, last], np.int32), len(counts)))
            offsets = np.concatenate([[0], np.cumsum(counts + 2)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole, pa.int32()))], ["doc_id", "ids"])

        return step

    return map_batches(texts(docs), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id``, ``ids`` and ``text``: what the library decodes from the ids, begin and end ids left out.

    No ids give an empty text; null ids count as none; ids outside the vocabulary fail; other columns are left behind.
    """

    def make():
        own = vocabulary(model)
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.decode(b.column(1)), pa.string())], ["doc_id", "ids", "text"])

    return map_batches(encoded.select("doc_id", "ids"), make, "doc_id long, ids array<int>, text string")


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the SHA-256 of the ids (unsigned, four bytes each, least first) and of the decoded text.

    Texts are decoded and digested in one worker, so that they needn't leave it.
    """

    def make():
        own = vocabulary(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(1)
            flat, ends = column.values.to_numpy(zero_copy_only=False).astype("<u4"), column.offsets.to_numpy()
            digests = [pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()) for found in ((flat[a:b].tobytes() for a, b in zip(ends, ends[1:])), (t.encode() for t in own.decode(column)))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_batches(encode(docs, model), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
