"""Back-adjustment: what a price before a split is worth in shares of today.

Everything is exact. A step's factor is kept as two whole numbers, the products of the shares held before and
after, and the price is divided once. Products that outgrow 38 digits fail rather than lose digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import gcd

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators.asof import first_of_group
from tidemark.schemas import COUNT_CHANGING

WHOLE = "decimal(38,0)"


def effective_actions(actions: DataFrame, ties: tuple[Column, ...] = ()) -> DataFrame:
    """Count-changing actions with both sides of their ratio; of each (isin, type, ex-date) the newest such, whatever its source.

    The filter comes first: a newer version without terms does not take an older one's place.
    """
    return first_of_group(_usable(actions), ["isin", "action_type", "ex_date"], *_newest(ties))


def _usable(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("action_type").isin(*COUNT_CHANGING) & (F.coalesce("ratio_from", F.lit(0)) != 0) & (F.coalesce("ratio_to", F.lit(0)) != 0))


def _newest(ties: tuple[Column, ...]) -> tuple[Column, ...]:
    return F.col("as_of_date").desc(), *(ties or (F.col("source_id"), F.col("qualifier")))


_STEPS = "isin string, valid_from date, ex_date date, held decimal(38,0), after decimal(38,0), factor double"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps of rows (isin, ex_date, action_type, a, b) that arrive by instrument, latest ex-date first, newest version first.

    One pass: two running products and the step that waits for the ex-date before it are all that is held.
    """
    isin, day, kinds, held, after = None, None, set(), 1, 1
    out: list[tuple] = []
    for batch in batches:
        for i, d, kind, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if day is not None and (i, d) != (isin, day):
                out.append((isin, d if i == isin else None, day, held, after))
                kinds = set()
            if i != isin or day is None:
                held, after = 1, 1
            isin, day = i, d
            if kind not in kinds:  # the newest version of a type counts, types of one day compound
                kinds.add(kind)
                g = gcd(a, b)
                held, after = held * (a // g), after * (b // g)
        if out:
            yield _steps(out)
            out = []
    if day is not None:
        yield _steps([(isin, None, day, held, after)])


def _steps(rows: list[tuple]) -> pa.RecordBatch:
    isin, start, end, held, after = zip(*rows)
    whole = pa.decimal128(38, 0)
    columns = [pa.array(isin, pa.string()), pa.array(start, pa.date32()), pa.array(end, pa.date32()), *(pa.array([Decimal(x) for x in c], whole) for c in (held, after)), pa.array([a / b for a, b in zip(held, after)], pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["isin", "valid_from", "ex_date", "held", "after", "factor"])


def factor_schedule(actions: DataFrame, ties: tuple[Column, ...] = ()) -> DataFrame:
    """Steps (isin, valid_from, ex_date, held, after, factor): the factor holds from ``valid_from`` up to, not on, ``ex_date``.

    ``held`` / ``after`` is the product of from/to of every effective action that goes ex later than the day; actions of
    one ex-date compound. ``factor`` is the quotient as a double, for reading; prices use the whole numbers. The first
    step's ``valid_from`` is null. Actions are shuffled once, by instrument, sorted once, and folded in that order in
    linear time, since there is no exact product aggregate.
    """
    millionths = lambda c: (F.col(c).cast("decimal(18,6)") * 1_000_000).cast("long").alias(c)
    dealt = _usable(actions).repartition("isin").sortWithinPartitions("isin", F.col("ex_date").desc(), "action_type", *_newest(ties))
    return dealt.select("isin", "ex_date", "action_type", millionths("ratio_from"), millionths("ratio_to")).mapInArrow(_folded, _STEPS)


def scaled(price: Column, held: Column, after: Column) -> Column:
    """``price * held / after`` in four places, half to even: whole numbers throughout, so ties are true ties."""
    units = ((price.cast("decimal(18,4)") * 10_000).cast(WHOLE) * held.cast(WHOLE)).cast(WHOLE)
    near = (units / after).cast(WHOLE)
    whole = F.when((near * after).cast(WHOLE) > units, near - 1).otherwise(near).cast(WHOLE)
    twice = ((units - (whole * after).cast(WHOLE)) * 2).cast(WHOLE)
    up = (twice > after) | ((twice == after) & (whole % 2 == 1))
    return (F.when(up, whole + 1).otherwise(whole).cast("decimal(30,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(18,4)")


def adjust(bars: DataFrame, actions: DataFrame, ties: tuple[Column, ...] = ()) -> DataFrame:
    """``bars`` with ``factor`` and ``adjusted_close``, in four places, half to even.

    A bar takes the step of the earliest ex-date after its day; on the ex-date itself and later the factor is 1.
    Each bar meets one step at most: the steps of an instrument are disjoint.
    """
    steps = factor_schedule(actions, ties).select(F.col("isin").alias("_isin"), "valid_from", "ex_date", "held", "after", "factor")
    inside = (F.col("isin") == F.col("_isin")) & (F.col("trade_date") < F.col("ex_date")) & (F.col("valid_from").isNull() | (F.col("trade_date") >= F.col("valid_from")))
    joined = bars.join(steps, inside, "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    adjusted = F.when(F.col("held").isNull(), F.col("close").cast("decimal(18,4)")).otherwise(scaled(F.col("close"), F.col("held"), F.col("after")))
    return joined.withColumn("adjusted_close", adjusted).drop("_isin", "valid_from", "ex_date", "held", "after")


def step_closure(bars: DataFrame, actions: DataFrame, ties: tuple[Column, ...] = ()) -> DataFrame:
    """For each ex-date and venue the last close before it and the first from it on, and their quotient as published and as adjusted.

    ``adjusted_step`` near 1 says that the adjustment closes the step. A bar knows the next of its venue, and an ex-date
    falls between two such bars once a venue. Only the closes before an ex-date are adjusted: by the first ex-date after
    the bar, which is the first of those between the same two bars.
    """
    w = Window.partitionBy("isin", "venue").orderBy("trade_date")
    following = bars.repartition("isin").select("isin", "venue", F.col("trade_date").alias("before_day"), F.col("close").alias("before_close"), F.lead("trade_date").over(w).alias("on_day"), F.lead("close").over(w).alias("on_close"))
    steps = factor_schedule(actions, ties).select(F.col("isin").alias("_isin"), "valid_from", "ex_date", "held", "after")
    between = (F.col("isin") == F.col("_isin")) & (F.col("before_day") < F.col("ex_date")) & (F.col("ex_date") <= F.col("on_day"))
    found = following.where("on_day IS NOT NULL").join(steps, between)
    nearest = F.min(F.struct("ex_date", "held", "after")).over(Window.partitionBy("isin", "venue", "before_day"))
    both = found.withColumn("_step", nearest).withColumn("adjusted_before", scaled(F.col("before_close"), F.col("_step.held"), F.col("_step.after")))
    return both.select(
        "isin", "venue", "ex_date", "before_day", "before_close", "adjusted_before", "on_day", "on_close",
        ratio(F.col("before_close"), F.col("on_close")).alias("raw_step"), ratio(F.col("adjusted_before"), F.col("on_close")).alias("adjusted_step"),
    )
