"""Personal data found by anchor expansion.

An Aho-Corasick automaton finds the anchors: at-signs, plus signs, schemes, digits around a dot, a run of
digits, and words that announce an identifier. A parser for each kind then reads outwards from the anchor
and validates what it read: the bounds of addresses, octets, check digits.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.base import map_batches, texts

KINDS = ("email", "ip", "card", "phone", "url", "iban", "id")
BASE = KINDS[:4]
# Words that announce an identifier, and schemes.
CUES = ("passport", "ssn", "national id", "tax id", "account no", "account number", "iban")
SCHEMES = ("http://", "https://", "ftp://")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]*")
_URL = re.compile(r"(?i:https?|ftp)://[^\s<>\"']+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ID = re.compile(r"(?:\x20(?:[Nn]o|[Nn]r|[Nn]umber)\b\.?)?[\x20:#=]{1,4}([A-Z0-9][A-Z0-9-]{5,19})(?![A-Za-z0-9-])")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for anchor, kind in [("@", "email"), *((f"+{d}", "phone") for d in DIGITS), *((f"{d}.{e}", "ip") for d in DIGITS for e in DIGITS), *((f"{d}{s}{e}", "card") for d in DIGITS for s in ("", " ", "-") for e in DIGITS)]:
        found.add_word(anchor, (kind, len(anchor)))
    for cue in CUES:
        found.add_word(cue, ("id", len(cue)))
    for scheme in SCHEMES:
        found.add_word(scheme, ("url", len(scheme)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def octet(digits: str) -> bool:
    """At most 255, whatever zeros lead."""
    value = digits.lstrip("0")
    return len(value) < 3 or (len(value) == 3 and value <= "255")


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _run_start(text: str, at: int, least: int, allowed) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def _emails(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    out, taken = [], 0
    for at in anchors:
        if at < taken:
            continue
        start = _run_start(text, at, taken, LOCAL)
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            out.append((start, domain.end()))
            taken = domain.end()
    return out


def _numbers(text: str, anchors: list[int], pattern: re.Pattern, linked: str) -> list[tuple[int, int]]:
    """Matches of ``pattern``, leftmost first and without overlap, that reach over an anchor.

    From an anchor the scan moves left to where no match can have begun earlier: past digits and ``linked``.
    """
    out, done = [], 0
    for at in anchors:
        if at < done:
            continue
        start = _run_start(text, at, done, linked)
        while start <= at:
            if found := pattern.match(text, start):
                out.append(found.span())
                start = done = found.end()
            else:  # a match that can't begin at a run of digits can't begin inside it
                start = max(start + 1, _DIGITS.match(text, start).end())
        done = max(done, at)
    return out


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Valid spans by kind, in code points."""
    anchors: dict[str, list[int]] = {k: [] for k in KINDS}
    lowered = text.translate(_LOWER)  # of the same length, so that places hold
    for end, (kind, n) in automaton().iter(lowered):
        anchors[kind].append(end - n + 1)
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if anchors["email"]:
        found["email"] = _emails(text, anchors["email"])
    if anchors["ip"]:
        found["ip"] = [s for s in _numbers(text, anchors["ip"], _IP, DIGITS + ".") if all(map(octet, text[s[0] : s[1]].split(".")))]
    if anchors["card"]:
        for s in _numbers(text, anchors["card"], _CARD, DIGITS + " -"):
            digits = text[s[0] : s[1]].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(s)
    if anchors["phone"]:
        for s in _numbers(text, anchors["phone"], _PHONE, ""):
            if 9 <= sum(c in DIGITS for c in text[s[0] : s[1]]) <= 15:
                found["phone"].append(s)
    done = 0
    for at in anchors["url"]:
        if at >= done and (m := _URL.match(text, at)):
            end = at + len(m[0].rstrip(".,;:!?)]}"))
            found["url"].append((at, end))
            done = end
    done = 0
    for at in anchors["id"]:
        cue_end = next(at + len(c) for c in CUES if lowered.startswith(c, at))
        if (m := _IBAN.search(text, cue_end, cue_end + 48)) and m.start() >= done and mod97(m[0].replace(" ", "")):
            found["iban"].append(m.span())
            done = m.end()
        elif (m := _ID.match(text, cue_end)) and m.start(1) >= done and any(c in DIGITS for c in m[1]):
            found["id"].append(m.span(1))
            done = m.end(1)
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def find(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``found``: the spans of each whole text, as (kind, start, end, value), by kind and start.

    Null and empty texts give an empty list; repeated rows give repeated results; an empty table gives an
    empty one; columns other than ``doc_id`` and ``text`` are left behind.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, at in spans(t).items() for a, b in at] for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "found"])

        return step

    return map_batches(texts(docs), make, "doc_id long, found array<struct<kind: string, start: long, end: long, value: string>>")


def redact(text: str, found: list) -> str:
    """``text`` with each span replaced by its kind in brackets; spans that overlap an earlier one are skipped."""
    out, at = [], 0
    for kind, a, b in sorted(((f["kind"], f["start"], f["end"]) for f in found), key=lambda f: (f[1], -f[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join(out) + text[at:]


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the four base kinds, the digest of their spans, and all spans as text, for each document.

    Null and empty texts count 0 and have the digest of an empty text and no spans; repeated rows give repeated
    results, null ids among them; an empty table gives an empty one; columns other than ``doc_id`` and ``text`` are
    left behind. Spans of one kind never overlap; spans of two kinds may.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            every = [spans(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([len(f[k]) for f in every], pa.int64()) for k in BASE]
            base = pa.array([hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in every], pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), *counts, base, pa.array([joined(f, KINDS) for f in every], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

        return step

    return map_batches(texts(docs), make, "doc_id long, " + "".join(f"n_{k} long, " for k in BASE) + "base_sha256 string, spans string")
