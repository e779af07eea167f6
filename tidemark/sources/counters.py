"""Counts of what a run kept and dropped, taken while its rows pass, so that no row is read twice for them.

Each function returns the rows and an ``Observation``. The observation is filled by whatever the rows are run for,
such as the write of the facts; ``counts`` then turns it into a dictionary. Metrics are aggregates of fixed size:
totals, and counts by code. Counts by code are exact up to ``CODES`` different codes; more are an error, not a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.sources.day_files import equity_of_venue
from tidemark.sources.files import dated_actions, parse_purpose

#: The most different codes that are counted one by one, and the room of the counter: under three quarters full it is exact.
CODES, ROOM = 2000, 4096
EXAMPLES = 5
ABSENT = "(none)"


def by_code(code: Column) -> Column:
    """Counts by code, nulls left out: an aggregate that keeps ``ROOM`` counters at most."""
    return F.call_function("approx_top_k", code, F.lit(CODES + 1), F.lit(ROOM))


def examples(text: Column) -> list[Column]:
    """Aggregates that keep up to five of the texts, nulls left out: the least of each fifth of their hashes."""
    return [F.min(F.when(F.pmod(F.xxhash64(text), F.lit(EXAMPLES)) == i, text)).alias(f"example_{i}") for i in range(EXAMPLES)]


def equity_counted(rows: DataFrame, name: str = "bars") -> tuple[DataFrame, Observation]:
    """Rows (``venue``, ``series``, any others) whose series is equity at their venue; counts of all and of each skipped series.

    Unknown series are skipped and counted under their name, as ``venue:series``; a null one as ``(none)``.
    """
    seen, kept = Observation(name), equity_of_venue()
    code = F.concat_ws(":", F.coalesce("venue", F.lit(ABSENT)), F.coalesce("series", F.lit(ABSENT)))
    watched = rows.observe(seen, F.count("*").alias("read"), F.count_if(kept).alias("kept"), by_code(F.when(~kept, code)).alias("skipped"))
    return watched.where(kept), seen


def actions_counted(records: DataFrame, scrips: DataFrame, as_of: str, source_id: str, name: str = "actions") -> tuple[DataFrame, Observation]:
    """Corporate actions of parsed records, as ``normalize_actions`` gives them, and counts of what was dropped on the way.

    ``unmatched`` records are of an unknown code, ``unhandled`` ones have a purpose without terms, of which a few
    are kept as examples; the rest are ``kept`` (the first of equal keys is chosen after that).
    """
    seen = Observation(name)
    parsed = records.join(scrips.select("scrip_code", "isin"), "scrip_code", "left").withColumn("a", parse_purpose(F.col("purpose")))
    known, handled = F.col("isin").isNotNull(), F.col("a.action_type") != "unhandled"
    watched = parsed.observe(
        seen, F.count("*").alias("read"), F.count_if(~known).alias("unmatched"), F.count_if(known & ~handled).alias("unhandled"), F.count_if(known & handled).alias("kept"),
        by_code(F.when(known & handled, F.col("a.action_type"))).alias("kinds"), *examples(F.when(known & ~handled, F.col("purpose"))),
    )
    return dated_actions(watched.where(known & handled), as_of, source_id), seen


def counts(seen: Observation) -> dict:
    """The metrics of a run that has ended: numbers, dictionaries of counts by code, and the examples as a sorted list."""
    out, some = {}, set()
    for k, v in seen.get.items():
        if k.startswith("example_"):
            some |= {v} - {None}
        elif isinstance(v, list):
            out[k] = {r["item"]: r["count"] for r in v if r["item"] is not None}
            if len(out[k]) > CODES:
                raise ValueError(f"over {CODES} different codes in {k}")
        else:
            out[k] = v
    return out | ({"examples": sorted(some)} if some else {})


def as_rows(seen: Observation, name: str) -> list[tuple[str, str, str | None, int]]:
    """(run, what, code, n) for each count, ready for a log table."""
    return [(name, what, code, n) for what, v in counts(seen).items() if what != "examples" for code, n in (v.items() if isinstance(v, dict) else [(None, v)])]
