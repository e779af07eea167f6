"""Golden cases of the market operators, on rows made for them."""

from datetime import date, timedelta
from decimal import Decimal as D

import pytest

from tidemark.operators import adjustment, asof, identity, quality, spreads, survey, validation
from tidemark.schemas import BAR, CORPORATE_ACTION, LISTING, PRICE_DAILY

DAY = date(2024, 8, 14)


def price(spark, *rows):
    """(isin, venue, trade_date, as_of_date, close[, turnover, previous_close])"""
    full = [(r[0], r[1], r[2], r[3], D(1), D(1000), D(0), D(str(r[4])), None if len(r) < 7 else D(str(r[6])), 1000, D(str(r[5])) if len(r) > 5 else None, None) for r in rows]
    return spark.createDataFrame(full, PRICE_DAILY)


def bars(spark, *rows):
    """(isin, venue, trade_date, symbol, scrip_code)"""
    return spark.createDataFrame([(i, v, d, d, s, c, D(1), D(1), D(1), D(1), None, 1, None, None) for i, v, d, s, c in rows], BAR)


def actions(spark, *rows):
    """(type, ex_date, as_of_date, from, to[, source])"""
    return spark.createDataFrame([("I", r[0], r[1], r[5] if len(r) > 5 else "s", r[2], "ordinary", None if r[3] is None else D(str(r[3])), None if r[4] is None else D(str(r[4])), D(5) if r[0] == "dividend" else None) for r in rows], CORPORATE_ACTION)


def test_correction_supersedes_only_once_known(spark):
    p = price(spark, ("I", "BSE", DAY, DAY, 105), ("I", "BSE", DAY, DAY + timedelta(1), 108), ("I", "NSE", DAY, DAY, 106))
    assert {(r.venue, float(r.close)) for r in asof.latest_price(p).collect()} == {("BSE", 108.0), ("NSE", 106.0)}
    assert {(r.venue, float(r.close)) for r in asof.latest_price(p, DAY).collect()} == {("BSE", 105.0), ("NSE", 106.0)}
    assert asof.latest_price(p, DAY - timedelta(1)).count() == 0


def test_factor_column(spark):
    got = {r.action_type: r.adjustment_factor for r in asof.latest_action(actions(spark, ("split", DAY, DAY, 1, 5), ("dividend", DAY, DAY, None, None))).collect()}
    assert got["split"] == D("0.2") and got["dividend"] is None


def test_spread_and_participation(spark):
    p = price(spark, ("I", "BSE", DAY, DAY, 100.5), ("I", "NSE", DAY, DAY + timedelta(2), 99.5), ("J", "BSE", DAY, DAY, 1))
    row = spreads.venue_spread(p).collect()
    assert len(row) == 1 and row[0].spread_bps == 100.0 and row[0].as_of_date == DAY + timedelta(2)
    delivered = spark.createDataFrame([("I", "BSE", DAY, DAY + timedelta(1), 500)], "isin string, venue string, trade_date date, as_of_date date, delivery_quantity long")
    part = spreads.delivery_participation(p, delivered).collect()
    assert len(part) == 1 and part[0].delivery_pct == 50.0 and part[0].as_of_date == DAY + timedelta(1)


@pytest.mark.parametrize(
    ("events", "day", "expected"),
    [
        ([("split", DAY, DAY, 1, 2)], DAY - timedelta(1), "1400.0000"),
        ([("split", DAY, DAY, 1, 2)], DAY, "2800.0000"),
        ([("split", DAY, DAY, 1, 2), ("bonus", DAY + timedelta(30), DAY, 1, 5)], DAY - timedelta(1), "280.0000"),
        ([("split", DAY, DAY, 1, 2), ("bonus", DAY + timedelta(30), DAY, 1, 5)], DAY + timedelta(1), "560.0000"),
        ([("split", DAY, DAY, 1, 2), ("bonus", DAY, DAY, 1, 2)], DAY - timedelta(1), "700.0000"),
        ([("split", DAY, DAY, 1, 2), ("split", DAY, DAY + timedelta(3), 1, 4)], DAY - timedelta(1), "700.0000"),
        ([("dividend", DAY, DAY, None, None), ("rights", DAY, DAY, 1, 2)], DAY - timedelta(1), "2800.0000"),
        ([("consolidation", DAY, DAY, 10, 1)], DAY - timedelta(1), "28000.0000"),
        ([], DAY, "2800.0000"),
    ],
)
def test_adjusted_close(spark, events, day, expected):
    frame = actions(spark, *events) if events else spark.createDataFrame([], CORPORATE_ACTION)
    out = adjustment.adjust(price(spark, ("I", "BSE", day, day, 2800)), frame).collect()
    assert len(out) == 1 and out[0].adjusted_close == D(expected)


def test_half_even(spark):
    out = adjustment.adjust(price(spark, ("I", "BSE", DAY, DAY, "0.0001")), actions(spark, ("split", DAY + timedelta(1), DAY, 1, 2))).first()
    assert out.adjusted_close == D("0.0000")


def test_listings(spark):
    d = lambda n: DAY + timedelta(n)
    rows = bars(
        spark,
        *(("A", "NSE", d(n), "OLD" if n < 2 else "NEW", None) for n in range(4)),
        *(("B", "BSE", d(n), "500" if n < 2 else "TICK", "500") for n in range(4)),
        ("C", "NSE", d(-200), "GONE", None),
        *(("E", "NSE", d(n), s, None) for n, s in enumerate("XYX")),
    )
    got = sorted((r.isin, r.local_symbol, r.listing_date, r.delisting_date, r.closure_reason) for r in identity.derive_listings(rows).collect())
    want = [
        ("A", "NEW", d(2), None, None), ("A", "OLD", d(0), d(1), "renamed"), ("B", "TICK", d(0), None, None), ("C", "GONE", d(-200), d(-200), "delisted"),
        ("E", "X", d(0), d(0), "renamed"), ("E", "X", d(2), None, None), ("E", "Y", d(1), d(1), "renamed"),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    forced = identity.in_force(rows, identity.derive_listings(rows))
    assert forced.count() == rows.count() and forced.where("isin = 'B' AND listed_symbol <> 'TICK'").count() == 0
    with pytest.raises(Exception, match="no last trading day"):
        identity.derive_listings(rows, spark.createDataFrame([("BSE", DAY)], "venue string, venue_last_day date")).collect()


def test_primary_venue_takeover(spark):
    rows = price(spark, ("I", "BSE", date(2024, 1, 10), DAY, 1, 100), ("I", "NSE", date(2024, 1, 11), DAY, 1, 50), ("I", "NSE", date(2024, 3, 1), DAY, 1, 500), ("I", "BSE", date(2024, 5, 15), DAY, 1, 1))
    got = [(r.effective_from, r.effective_to, r.venue) for r in identity.derive_primary_venue(rows).orderBy("effective_from").collect()]
    assert got == [(date(2024, 1, 31), date(2024, 3, 31), "BSE"), (date(2024, 3, 31), None, "NSE")]
    assert identity.derive_primary_venue(rows.limit(0)).count() == 0


def test_resolution(spark):
    with pytest.raises(identity.UnresolvableInstrument, match="2 rows"):
        identity.require_resolvable(bars(spark, ("IN0123456789", "NSE", DAY, "S", None), ("bad", "NSE", DAY, "S", None), (None, "NSE", DAY, "S", None)))
    keys = spark.createDataFrame([("N", "NSE", "SYM", None, DAY, None, None), ("B", "BSE", "TICK", "500", DAY, None, None)], LISTING)
    rows = spark.createDataFrame([("SYM", 1), ("NONE", 2), ("NONE", 3)], "venue_key string, q int")
    found, lost = identity.resolve_keys(rows, identity.venue_keys(keys), "NSE")
    assert [r.isin for r in found.collect()] == ["N"] and [r.venue_key for r in lost.collect()] == ["NONE"]


def test_verdicts(spark):
    p = price(spark, ("I", "BSE", DAY, DAY, 100), ("I", "NSE", DAY, DAY, 110), ("J", "NSE", DAY, DAY, 5))
    typical = spark.createDataFrame([("BSE", 4), ("NSE", 2)], "venue string, typical long")
    calendar = spark.createDataFrame([("BSE", DAY), ("NSE", DAY), ("NSE", DAY + timedelta(1))], "venue string, trade_date date")
    got = {(r.venue, r.trade_date): r for r in validation.day_verdicts(p, typical, calendar=calendar).collect()}
    assert got["BSE", DAY].detail == "1 bars instead of 2 or more; 1 instruments whose venues disagree, by 952 bps at most"
    assert got["NSE", DAY].divergent_instruments == 1 and not got["NSE", DAY].is_complete
    assert got["NSE", DAY + timedelta(1)].detail == "empty day"
    dated = validation.day_verdicts(p.withColumn("read_for", p["as_of_date"]), limit_bps=1e6, read_for="read_for").first()
    assert dated.is_complete and dated.detail is None
    counts = price(spark, *((f"I{i}", "BSE", DAY + timedelta(n), DAY, 1) for n, k in enumerate((1, 2, 3, 4)) for i in range(k)))
    assert validation.typical_bars(counts).first().typical == 3


def test_quality(spark):
    bad = price(spark, ("I", "BSE", DAY, DAY - timedelta(1), 5), ("I", "BSE", DAY, DAY, 5))
    assert {r.rule: r.violations for r in quality.violations(bad, "price_daily").collect()}["known_after_trade"] == 1
    with pytest.raises(Exception, match="known_after_trade"):
        quality.checked(bad, "price_daily").collect()
    assert quality.duplicates(bad, "isin").first().n == 2
    assert quality.orphans(bad, spark.createDataFrame([("J",)], "isin string"), "isin", "isin").count() == 2
    assert quality.nulls(bad, "turnover", "isin").count() == 2 and quality.unaccepted(bad, "venue", ("NSE",)).count() == 2


def test_survey(spark):
    days = [date(2024, 1, 1) + timedelta(n) for n in range(0, 60)]
    rows = [("A", "NSE", d, d, 10, 5, 10) for d in days] + [("B", "NSE", d, d, 4 if i == 1 else 10, 50, 10) for i, d in enumerate(days) if not 5 < i < 40] + [("B", "BSE", days[0], days[0], 1, 1, 1)]
    p = price(spark, *rows).selectExpr("*", "CASE WHEN isin = 'A' AND trade_date > '2024-01-20' THEN 'A2' ELSE isin END AS local_symbol")
    tracks = {(r.isin, r.venue): r for r in survey.track_survey(p).collect()}
    b = tracks["B", "NSE"]
    assert (b.longest_gap, b.worst_ratio, b.worst_ratio_day, b.days, tracks["A", "NSE"].symbols) == (34, 0.4, days[1], 26, 2)
    from pyspark.sql import functions as F

    chosen = {r.isin: r.requirement for r in survey.greedy_universe(survey.track_survey(p), F.lit(str(days[-1])).cast("date")).collect()}
    assert chosen == {"B": "capital_action", "A": "symbol_change"}
    holidays = survey.holidays(price(spark, ("A", "NSE", date(2024, 1, 1), DAY, 1), ("A", "NSE", date(2024, 1, 4), DAY, 1))).collect()
    assert sorted(r.trade_date for r in holidays) == [date(2024, 1, 2), date(2024, 1, 3)]


def test_entry_and_oracles(spark, sf):
    import duckdb

    import __spark_entry__ as entry
    from tidemark.plans import catalogue

    assert entry.entry(spark).count() > 0
    con = duckdb.connect()
    for name in ("lineitem", "orders", "supplier", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    assert set(catalogue.oracle_sql()) == set(catalogue.queries())
    for name in ("venue_spread", "adjusted_close", "primary_venue", "listing_closure", "day_verdicts", "track_survey", "greedy_universe"):
        got = catalogue.queries()[name](spark, sf)
        rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
        form = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert sorted(map(form, map(tuple, got.collect())), key=str) == sorted(map(form, rows), key=str), name


def spans(spark, *rows):
    """(isin, symbol, code, from, to)"""
    return spark.createDataFrame([(i, "BSE", s, c, a, b, None) for i, s, c, a, b in rows], LISTING)


def days(spark, *rows):
    return spark.createDataFrame([(i, "BSE", d) for i, d in rows], "isin string, venue string, trade_date date")


def test_each_day_is_held_by_exactly_one_listing(spark):
    end = date(2023, 12, 31)
    listed = spans(spark, ("I", "A", None, date(2021, 3, 5), end), ("I", "B", None, end + timedelta(1), None), ("J", "C", None, date(2022, 1, 1), date(2022, 6, 30)), ("J", "D", None, date(2022, 6, 1), None), ("K", "E", None, date(2030, 1, 1), None))
    held = {(r.isin, r.trade_date): (r.matches, r.span and r.span.listed_symbol) for r in identity.listing_matches(days(
        spark, ("I", date(2021, 3, 4)), ("I", date(2021, 3, 5)), ("I", end), ("I", end), ("I", end + timedelta(1)), ("I", date(2027, 5, 5)), ("J", date(2022, 6, 1)), ("J", date(2022, 6, 30)), ("J", date(2022, 7, 1)), ("K", date(2025, 1, 1)), ("L", end), (None, end), ("I", None)), listed).collect()}
    assert held == {
        ("I", date(2021, 3, 4)): (0, None), ("I", date(2021, 3, 5)): (1, "A"), ("I", end): (1, "A"), ("I", end + timedelta(1)): (1, "B"), ("I", date(2027, 5, 5)): (1, "B"), ("J", date(2022, 6, 1)): (2, None), ("J", date(2022, 6, 30)): (2, None),
        ("J", date(2022, 7, 1)): (1, "D"), ("K", date(2025, 1, 1)): (0, None), ("L", end): (0, None), (None, end): (0, None), ("I", None): (0, None),
    }
    good = days(spark, ("I", date(2021, 3, 5)), ("I", date(2021, 3, 5)), ("J", date(2022, 7, 1)))
    assert sorted((r.isin, r.listed_symbol) for r in identity.exactly_in_force(good, listed).collect()) == [("I", "A"), ("I", "A"), ("J", "D")]
    for isin, day, n in (("I", date(2021, 3, 4), 0), ("J", date(2022, 6, 1), 2)):
        with pytest.raises(Exception, match=f"{n} listings hold {isin} BSE {day}"):
            identity.exactly_in_force(days(spark, (isin, day)), listed).collect()
    assert identity.listing_matches(days(spark), listed).count() == 0 and identity.listing_matches(good, spans(spark)).where("matches = 0").count() == 2


def test_a_key_stands_for_each_instrument_in_its_time(spark):
    d = lambda m, n=1: date(2023, m, n)
    listed = spans(spark, ("I", "X", "500", d(1), d(3)), ("J", "Y", "500", d(5), d(9)), ("K", "Z", "500", d(8), None), ("L", "A", "600", d(1), d(6)), ("L", "B", "600", d(4), None), ("M", "SYM", None, d(1), None))
    rows = spark.createDataFrame([(k, m, i) for i, (k, m) in enumerate([("500", d(2)), ("500", d(3)), ("500", d(4)), ("500", d(5)), ("500", d(9)), ("500", d(10)), ("600", d(5)), ("600", d(7)), ("SYM", d(5)), ("none", d(5)), ("500", d(2))])], "venue_key string, trade_date date, n int")
    known, left = identity.resolve_dated_keys(rows, listed, "BSE")
    assert {r.n: r.isin for r in known.collect()} == {0: "I", 1: "I", 3: "J", 5: "K", 6: "L", 7: "L", 8: "M", 10: "I"}
    assert sorted(map(tuple, left.collect())) == [("500", d(4), "unknown"), ("500", d(9), "ambiguous"), ("none", d(5), "unknown")]


def test_the_schedule_is_one_fold(spark):
    """Many instruments and batches: the products of plain fractions, in one shuffle and one sort."""
    import random
    from fractions import Fraction

    rng = random.Random(2)
    rows, ratios = [], {}
    for i in range(40):
        for k in range(rng.randrange(12)):
            day, kind = DAY + timedelta(rng.randrange(9) * 30), rng.choice(("split", "bonus", "consolidation"))
            for version in range(rng.randrange(1, 3)):
                a, b = rng.choice([(1, 2), (1, 5), (3, 1), (D("1.5"), 3)])
                if (i, day, kind, version, k) not in ratios:
                    rows.append((f"I{i:02}", kind, day, "s", DAY + timedelta(100 * k + version), "ordinary", D(a), D(b), None))
    best = {}
    for r in sorted(rows, key=lambda r: r[4]):
        best[r[0], r[1], r[2]] = Fraction(r[6]) / Fraction(r[7])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        steps = adjustment.factor_schedule(spark.createDataFrame(rows, CORPORATE_ACTION).repartition(3))
        got = {(r.isin, r.ex_date): (Fraction(int(r.held), int(r.after)), r.valid_from) for r in steps.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for isin, day in {(k[0], k[2]) for k in best}:
        product = Fraction(1)
        for (i, _, d), f in best.items():
            if i == isin and d >= day:
                product *= f
        want[isin, day] = (product, max((d for i, _, d in best if i == isin and d < day), default=None))
    assert got == want and len(want) > 60
    plan = adjustment.factor_schedule(spark.createDataFrame(rows, CORPORATE_ACTION))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1


def test_steps_meet_the_bars_around_them(spark):
    """Several ex-dates between two bars, on a bar, before the first and after the last, on two venues, against a plain search; bars are sorted once."""
    days = [DAY + timedelta(n) for n in (0, 1, 5, 6, 20)]
    closes = {("I", v, d): D(10 * (n + 1) + len(v) * k) for k, v in enumerate(("BSE", "NSE")) for n, d in enumerate(days[k:])} | {("J", "NSE", DAY): D(7)}
    held = price(spark, *((*k, k[2], c) for k, c in closes.items())).repartition(3)
    terms = {DAY + timedelta(n): f for n, f in ((-3, 2), (0, 3), (3, 5), (4, 7), (6, 11), (30, 13))}
    frame = actions(spark, *(("split", d, d, 1, f) for d, f in terms.items()))
    want = []
    for ex in terms:
        for venue in ("BSE", "NSE"):
            mine = sorted(d for i, v, d in closes if (i, v) == ("I", venue))
            before, on = max((d for d in mine if d < ex), default=None), min((d for d in mine if d >= ex), default=None)
            if before and on:
                later = 1
                for d, f in terms.items():
                    later *= f if d > before else 1
                close = closes["I", venue, before]
                want.append((venue, ex, before, close, (close / later).quantize(D("0.0001")), on, closes["I", venue, on]))
    found = adjustment.step_closure(held, frame)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Union") == 0
    got = [(r.venue, r.ex_date, r.before_day, r.before_close, r.adjusted_before, r.on_day, r.on_close) for r in found.collect()]
    assert sorted(got) == sorted(want) and len(want) == 6


def test_headers_of_many_files(spark):
    rows = spark.createDataFrame([(1, "a, b ,c"), (2, "b"), (3, None), (4, "A,b,c,d")], "n int, header string")
    assert sorted((r.n, r.missing) for r in quality.lacking(rows, "header", ("a", "b", "c")).collect()) == [(2, "a"), (2, "c"), (3, "a"), (3, "b"), (3, "c"), (4, "a")]


def test_universe_rows_make_their_tracks_once(spark, sf):
    """What is left to run after the choice reads the stored tracks, not the tables."""
    from tidemark.plans import catalogue

    plan = catalogue.queries()["universe_rows"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
