"""Pieces, Myers' distance and passages against dynamic programming."""

import random

from tidemark.llm import decontamination as d


def plain_best(pattern, text):
    """Least edit distance of the pattern to any substring."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def edit(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(max(1, len(out)))
        kind = rng.randrange(3)
        if kind == 1 or not out:
            out.insert(at, rng.choice("abc"))
        elif kind == 0:
            out[at] = rng.choice("abc")
        else:
            del out[at]
    return "".join(out)


def test_myers_equals_dynamic_programming():
    rng = random.Random(6)
    for _ in range(400):
        pattern = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        assert d.Myers(pattern).best(text)[0] == plain_best(pattern, text)


def test_no_passage_within_budget_is_missed():
    rng = random.Random(7)
    for _ in range(150):
        items = [d.Item(i, t, d.budget(t)) for i in range(4) if (t := d.normalise("".join(rng.choice("abcdefg ") for _ in range(rng.randint(1, 120)))))]
        matcher = d.Matcher(items)
        text = d.normalise(" ".join("".join(rng.choice("abcdefg ") for _ in range(60)) + " " + edit(rng, rng.choice(items).text, rng.randint(0, 14)) for _ in range(3)))
        want = {n for n, i in enumerate(items) if plain_best(i.text, text) <= i.errors}
        found = matcher.find(text)
        assert {f[0] for f in found} == want
        for n, distance, a, b in found:
            assert distance == plain_best(items[n].text, text[a:b]) == plain_best(items[n].text, text)


def test_matches(spark):
    passage = "The quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, f"intro.  {passage}! outro", "x"), (2, f"İİ {passage.upper().replace('LAZY', 'LAZI')}", "x"), (3, "nothing here", "x"), (4, None, "x"), (5, "", "x"), (None, passage, "x"), (1, f"intro.  {passage}! outro", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, passage), (11, None), (12, " ?!"), (13, "absent words that no document has at all")], "item_id long, text string")
    out = d.matches(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in out), key=str) == sorted([(1, 10, 0), (1, 10, 0), (2, 10, 1), (None, 10, 0)], key=str)
    for r in out:
        assert dict((x[0], x[1]) for x in rows)[r.doc_id][r.start : r.end].lower().replace("lazi", "lazy") == passage.lower()
    assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == [3, 4, 5]
    assert d.matches(docs, bench.limit(0)).count() == 0 and d.matches(docs.limit(0), bench).count() == 0
    assert d.clean(docs, bench.limit(0)).count() == len(rows)


def test_words_are_whole(spark):
    docs = spark.createDataFrame([(1, "a banana"), (2, "banana"), (3, "Cat? (a)"), (4, "category"), (5, "the cats"), (6, "cat")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a"), (2, "cat")], "item_id long, text string")
    out = d.matches(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.end) for r in out) == [(1, 1, 0, 1), (3, 1, 6, 7), (3, 2, 0, 3), (6, 2, 0, 3)]


def test_short_items_have_edits_too():
    item = d.Item(1, d.normalise("ordinary short item"), d.budget(d.normalise("ordinary short item")))
    assert item.errors == 1 and len(d.Matcher([item]).find(d.normalise("an ordinary shor item here"))) == 1


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_CHARS", 40)
    bench = spark.createDataFrame([(i, f"benchmark question number {i} of many more") for i in range(7)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so: benchmark question number {i} of many more." if i < 5 else "else") for i in range(9)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.matches(docs, bench).where("distance = 0").collect()} == {(i, i) for i in range(5)}
    assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == [5, 6, 7, 8]


def test_clean_keeps_rows_of_null_ids_and_all_columns(spark):
    docs = spark.createDataFrame([(None, "holds the item text", 1), (None, "does not", 2), (None, None, 3)], "doc_id long, text string, _hit int")
    bench = spark.createDataFrame([(1, "the item text")], "item_id long, text string")
    assert sorted(r["_hit"] for r in d.clean(docs, bench).collect()) == [2, 3]


def test_very_long_text():
    item = d.normalise("a passage of some length that a benchmark might hold")
    text = d.normalise("filler words of all kinds " * 400_000 + item + " more" * 10)
    found = d.Matcher([d.Item(1, item, d.budget(item))]).find(text)
    assert len(text) > 10_000_000 and found[0][1] == 0 and text[found[0][2] : found[0][3]] == item
