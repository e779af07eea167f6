"""The anchored parsers against plain regular expressions."""

import random
import re

from tidemark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p[-4000:]) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out[kind].append(m.span())
    return out


def test_parsers_equal_regular_expressions():
    rng = random.Random(5)
    pieces = ["a@b.c", "@", ".", "x-y", "+1 (555) 010-9999", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "..", " ", "-", "+", "12", "0", "é", "日本", "a.b@c-d.ee.f", "@@", "\n", "+49 ", "()", "37828224631000 5"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        found = pii.spans(text)
        assert {k: found[k] for k in PATTERNS} == plain(text), text


def test_added_kinds_and_redaction():
    text = "see https://a.b/c?d. IBAN: GB82 WEST 1234 5698 7654 32, passport no: x; ssn: 123-45-6789 mail a@b.cd"
    found = pii.spans(text)
    assert [text[a:b] for a, b in found["url"]] == ["https://a.b/c?d"]
    assert [text[a:b] for a, b in found["iban"]] == ["GB82 WEST 1234 5698 7654 32"]
    assert [text[a:b] for a, b in found["id"]] == ["123-45-6789"]
    rows = [{"kind": k, "start": a, "end": b} for k, at in found.items() for a, b in at]
    assert pii.redact(text, rows).endswith("mail [email]") and "123-45" not in pii.redact(text, rows)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (2, "", None), (3, "a@b.c " * 5000, "y"), (None, "1.2.3.4", "z")]
    out = pii.digest(spark.createDataFrame(rows, "doc_id long, text string, spans string"))
    got = sorted(((r.doc_id, r.n_email, r.n_ip) for r in out.collect()), key=str)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (2, 0, 0), (3, 5000, 0), (None, 0, 1)], key=str)
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    found = {r.doc_id: r.found for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string, found string")).collect()}
    assert found[1] == [] and found[None][0].value == "1.2.3.4"


def test_octets_with_many_leading_zeros():
    text = "at " + "0" * 6000 + "1.1.1.255 and " + "0" * 6000 + "1.1.1.256"
    assert pii.spans(text)["ip"] == [(3, 3 + 6009)]
    assert {x: pii.octet(x) for x in ("0", "000", "255", "256", "0255", "99", "300", "1000")} == {"0": True, "000": True, "255": True, "256": False, "0255": True, "99": True, "300": False, "1000": False}


def test_cues_in_any_case():
    for text in ("National ID: AB123456", "TAX id # AB123456", "Account Number: AB123456", "passport number: AB123456", "Passport No. AB123456"):
        assert [text[a:b] for a, b in pii.spans(text)["id"]] == ["AB123456"], text


def test_very_long_text():
    text = ("word 12 a@b.cd 1.2.3.4 " * 450_000) + "0" * 100_000 + ".1.1.1"
    found = pii.spans(text)
    assert len(text) > 10_000_000 and len(found["email"]) == 450_000 and len(found["ip"]) == 450_001
