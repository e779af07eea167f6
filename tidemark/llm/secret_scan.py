"""Secrets in texts, and who else has them.

Patterns give candidates; the corpus decides what they are worth. Each candidate's hash is counted over distinct
repositories and distinct owners: a value that many owners or many repositories share is a copied example, a value
that one owner alone has, and that looks random, is likely a live credential. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import checkpoint, spread_join

# The patterns of each kind, the group that holds the secret, and the least length of that group.
KINDS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    # No character of a token stands in front, and no part is given back, so each part is looked at three times at most.
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 1),
}
BASE = ("assign", "access", "hex")
#: What a text must hold for a kind's pattern to be worth running, where that is cheaper to ask.
_FIRST = {"hex": r"[0-9a-f]{24}", "access": "AKIA", "pem": "-----BEGIN ", "jwt": "eyJ"}
# Words of placeholders.
PLACEHOLDERS = r"(?i)example|sample|change_?me|placeholder|dummy|your[_-]|xxxx|0000|test"
# A private key through its END line, or its header alone if it has none; the group is the body. Words
# of placeholders that a long random body does not hold by chance.
PEM = KINDS["pem"][0] + r"(?:([^-]*(?:-[^-]+){0,16})-----END [A-Z ]{0,40}PRIVATE KEY-----)?"
PEM_PLACEHOLDERS = r"(?i)example|sample|change_?me|placeholder|dummy|your[_-]"
#: Owners from which on a value counts as copied about.
COPIED_FROM = 3
#: Repositories from which on it does, even with one owner or two.
COPIED_REPOSITORIES = 10


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(lengths: Column) -> Column:
    """The sum of the lengths before each, for an array of lengths.

    An array grows by being copied, so sums are made in blocks of about the square root of their number: first in
    each block, then over the blocks.
    """
    before = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out")), lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")), lambda s: s["out"])
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def blocked(xs: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), side - 1), lambda i: F.slice(xs, i * side + 1, side))
        return F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(_let(blocks, lambda bs: _let(before(F.transform(bs, total)), lambda bases: F.flatten(F.transform(bs, lambda b, i: F.transform(before(b), lambda x: x + F.get(bases, i)))))))

    return _let(lengths, blocked)


def _matches(kind: str, rank: int) -> Column:
    """Spans of one kind as (start, rank, end, kind, value), in code points; failing matches are dropped.

    The running lengths of the pieces between matches and the matches themselves give each match its place. A
    private key's value is its body without white space, or its header if the key has no end.
    """
    pattern, group, least = KINDS[kind]
    if kind == "hex":
        pattern = r"[0-9a-f]{24,}"  # a run is as long as it can be either way, and short runs are most of a text
    if kind == "pem":
        pattern, group = PEM, 1
    text = F.col("text")
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    if kind == "pem":
        body = lambda x: F.regexp_replace(x["value"], r"\s|\\[nr]", "")
        pairs = F.transform(pairs, lambda x: F.struct(x["gap"].alias("gap"), x["whole"].alias("whole"), F.when(F.length(body(x)) > 0, body(x)).otherwise(x["whole"]).alias("value")))
    span = "struct<start: int, rank: int, end: int, kind: string, value: string>"

    def placed(found: Column) -> Column:
        starts = _running(F.transform(found, lambda x: F.length(x["gap"]) + F.length(x["whole"])))
        one = lambda x, at: F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + F.length(x["whole"])).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")).cast(span)
        return _let(starts, lambda at: F.transform(found, lambda x, i: one(x, F.get(at, i) + F.length(x["gap"]))))

    found = _let(F.filter(pairs, lambda x: x["whole"].isNotNull()), placed)
    first = _FIRST.get(kind)
    holds = F.rlike(text, F.lit(pattern)) if first is None else F.rlike(text, F.lit(first)) if kind == "hex" else F.contains(text, F.lit(first))
    return F.when(holds, F.filter(found, lambda s: F.length(s["value"]) >= least)).otherwise(F.array().cast(f"array<{span}>"))


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row a document: ``doc_id``, ``text_hash``, ``repository``, ``owner``, ``found`` (spans by start, then kind), ``row``.

    ``row`` numbers the rows, so that repeated documents stay apart; the result is written to the shared
    checkpoint folder, and a later step reads it and not the texts again. Null and empty texts find nothing.
    """
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))
    every = F.array_sort(F.concat(*(_matches(k, i) for i, k in enumerate(KINDS))))
    return checkpoint(held.select("doc_id", F.xxhash64("text").alias("text_hash"), "repository", "owner", every.alias("found")).withColumn("row", F.monotonically_increasing_id()))


def candidates(scanned: DataFrame) -> DataFrame:
    """One row a candidate: ``row``, ``doc_id``, ``text_hash``, ``repository``, ``owner``, ``kind``, ``start``, ``end``, ``hash``, ``random``."""
    one = scanned.where(F.size("found") > 0).select("row", "doc_id", "text_hash", "repository", "owner", F.explode("found").alias("s"))
    value = F.col("s.value")
    kinds = sum(F.rlike(value, F.lit(p)).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]"))
    random = (F.length(value) >= 12) & (kinds >= 2) & ~F.when(F.col("s.kind") == "pem", F.rlike(value, F.lit(PEM_PLACEHOLDERS))).otherwise(F.rlike(value, F.lit(PLACEHOLDERS))) & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    return one.select("row", "doc_id", "text_hash", "repository", "owner", "s.kind", "s.start", "s.end", F.sha2(value, 256).alias("hash"), random.alias("random"))


def ownership(found: DataFrame) -> DataFrame:
    """``hash``, ``n_repositories`` and ``n_owners``: distinct ones that have the value; nulls count as one owner.

    Values are counted in steps (repository, owner, value), each aggregated before it is shuffled, so a value in
    a third of all documents is a few rows a task.
    """
    repos = found.select("hash", "owner", "repository").distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return repos.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def judged(found: DataFrame) -> DataFrame:
    """Candidates with ``n_repositories``, ``n_owners`` and ``verdict``: ``copied`` (many owners or repositories), ``live``
    (one owner, few repositories, looks random) or ``unclear``.

    A value in very many rows meets its counts where the rows are.
    """
    found = checkpoint(found)
    verdict = F.when((F.col("n_owners") >= COPIED_FROM) | (F.col("n_repositories") >= COPIED_REPOSITORIES), "copied").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("unclear")
    return spread_join(found, ownership(found), "hash").withColumn("verdict", verdict)


def _text_of(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digest(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, all spans, counts by verdict, and the most repositories and
    owners that one of its values has, for each document.

    Null and empty texts count 0 and have the digest of an empty text; repeated rows give repeated results; an
    empty table gives an empty one; other columns are left behind.
    """
    scanned = scan(docs, repository, owner)
    verdicts = judged(candidates(scanned)).groupBy("row").agg(*(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("live", "copied", "unclear")), *(F.max(f"n_{x}").alias(f"most_{x}") for x in ("repositories", "owners")))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    rows = scanned.select("row", "doc_id", *counts, F.sha2(_text_of(base), 256).alias("base_sha256"), _text_of(F.col("found")).alias("spans"))
    return rows.join(verdicts, "row", "left").select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied", "n_unclear", "most_repositories", "most_owners")))


def _apart(live: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``spans``, sorted; spans that overlap are one."""
    own = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    each = live.select("doc_id", "text_hash", "start", "end").distinct().withColumn("_new", F.when(before > F.col("start"), 0).otherwise(1))
    runs = each.withColumn("_run", F.sum("_new").over(own)).groupBy("doc_id", "text_hash", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _kept(wide: Column, spans: Column, length: Column) -> Column:
    """The pieces of a text between ``spans``, the first and the last included.

    ``wide`` is the text with four bytes a code point, so that a piece is found by its place, not by counting up to it.
    """

    def piece(i: Column) -> Column:
        start = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        return F.decode(F.substring(wide, start * 4 + 1, (F.coalesce(F.get(spans, i)["start"], length) - start) * 4), "UTF-32")

    return F.transform(F.sequence(F.lit(0), F.size(spans)), piece)


def redact(docs: DataFrame, repository: Column, owner: Column, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns, with the live-looking credentials in ``text`` replaced by ``mark`` and ``n_chars`` made to fit.

    Copied examples and unclear values stay. Rows without a live-looking value, null texts among them, stay as
    they are; repeated rows give repeated results. A document's spans find it by doc_id and the hash of its text.
    The row travels as one struct, so columns of any name stay apart from those of the join.
    """
    live = judged(candidates(scan(docs, repository, owner))).where("verdict = 'live'")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"))
    text = F.col("r.text")
    on = F.col("r.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("text_hash"))
    marked = _let(F.encode(text, "UTF-32"), lambda wide: F.array_join(_kept(wide, F.col("spans"), F.length(text)), mark))
    hit = F.col("spans").isNotNull()
    changed = rows.join(_apart(live), on, "left").select("r", hit.alias("hit"), F.when(hit, marked).otherwise(text).alias("t"))
    new = {"text": F.col("t"), "n_chars": F.when(F.col("hit"), F.length("t").cast("long")).otherwise(F.col("r.n_chars")) if "n_chars" in docs.columns else None}
    return changed.select(*((new[c] if c in new else F.col(f"r.`{c}`")).alias(c) for c in docs.columns))
