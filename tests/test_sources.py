"""File readers, sinks, the registry and the arrival stream, on files made for them."""

import io
import json
import zipfile
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidemark.schemas import PRICE_DAILY
from tidemark.sources import files, registry, sinks
from tidemark.streaming.arrivals import append_stream

UDIFF = "TradDt,Sgmt,FinInstrmId,ISIN,TckrSymb,SctySrs,FinInstrmNm,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd\n"


def written(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_text(text, encoding=encoding)
    return str(path)


def test_common_format(spark, tmp_path):
    text = UDIFF + "2024-08-14,CM,500001,IN0123456789,SYM,A, Name ,1.5,2,1,1.75,,100, ,7\n2024-08-14,CM,500002,IN0123456780,GOV,G,Bond,1,1,1,1,1,1,1,1\n"
    raw = files.read_csv(spark, written(tmp_path, "u.csv", text, "utf-8-sig"))
    rows = files.parse_udiff(raw)
    bar = files.normalize_bars(rows, "BSE").collect()
    assert len(bar) == 1
    assert (bar[0].close, bar[0].previous_close, bar[0].turnover, bar[0].trade_count, bar[0].scrip_code, bar[0].as_of_date) == (D("1.75"), None, None, 7, "500001", date(2024, 8, 14))
    assert files.normalize_bars(rows.withColumn("series", F.lit("EQ")), "NSE").first().scrip_code is None
    assert {r.series: r.n for r in files.skipped_series(rows, "BSE").collect()} == {"G": 1}
    with pytest.raises(files.SchemaDrift, match=r"\['ISIN', 'TradDt'\]"):
        files.parse_udiff(raw.drop("ISIN", "TradDt"))
    bad = files.read_csv(spark, written(tmp_path, "bad.csv", text.replace("1.75", "x")))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        files.normalize_bars(files.parse_udiff(bad), "BSE").collect()


def test_old_formats(spark, tmp_path):
    bse = "SC_CODE,SC_NAME,SC_GROUP,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,NO_TRADES,NO_OF_SHRS,NET_TURNOV,ISIN_CODE,TRADING_DATE\n500001,NAME   ,A ,1,2,1,2,1,5,10,20,IN0123456789,15-Jan-24\n"
    row = files.normalize_bars(files.parse_bse_legacy(files.read_csv(spark, written(tmp_path, "b.csv", bse))), "BSE").first()
    assert (row.local_symbol, row.scrip_code, row.trade_date, row.volume) == ("500001", "500001", date(2024, 1, 15), 10)
    nse = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN\nSYM,EQ,1,2,1,2,,10,20,15-JAN-2024,3,IN0123456789\nBILL,TB,1,1,1,1,1,1,1,15-JAN-2024,1,IN0123456780\n"
    rows = files.normalize_bars(files.parse_nse_legacy(files.read_csv(spark, written(tmp_path, "n.csv", nse))), "NSE").collect()
    assert [(r.local_symbol, r.scrip_code, r.trade_date) for r in rows] == [("SYM", None, date(2024, 1, 15))]


def test_deliveries(spark, tmp_path):
    nse = "SYMBOL, SERIES, DATE1, TTL_TRD_QNTY, DELIV_QTY\nSYM, EQ, 14-Aug-2024, 10, 7\nGOV, GS, 14-Aug-2024, 10, -\n"
    rows = files.parse_nse_delivery(files.read_csv(spark, written(tmp_path, "n.csv", nse))).collect()
    assert [tuple(r) for r in rows] == [("SYM", date(2024, 8, 14), 7)]
    header = "DATE|SCRIP CODE|DELIVERY QTY|X"
    path = written(tmp_path, "b.txt", header + "\n14082024|00500001|000012|a\n\nshort|line\n14082024|000000|5|b\n")
    got = files.parse_bse_delivery(spark.read.text(path), header).collect()
    assert sorted(map(tuple, got)) == [("0", date(2024, 8, 14), 5), ("500001", date(2024, 8, 14), 12)]
    with pytest.raises(files.SchemaDrift, match="DELIVERY QTY"):
        files.parse_bse_delivery(spark.read.text(path), "DATE|SCRIP CODE")


def test_actions(spark, tmp_path):
    path = written(tmp_path, "500.json", '[{"scrip_code": 500, "Purpose": "Bonus  issue 1:2 ", "exdate": "20240814"}, {"scrip_code": 500, "Purpose": "Spin Off", "exdate": "20240815"}, {"scrip_code": 9, "Purpose": "Bonus issue 1:1", "exdate": "20240814"}, {"scrip_code": 500, "Purpose": "BONUS ISSUE 3:2", "exdate": "20240814"}]')
    scrips = spark.createDataFrame([("500", "I")], "scrip_code string, isin string")
    known, unhandled = files.normalize_actions(files.read_actions(spark, path), scrips, "2024-09-01", "src")
    assert [(r.action_type, r.ratio_from, r.ratio_to, r.ex_date, r.qualifier) for r in known.collect()] == [("bonus", D(2), D(3), date(2024, 8, 14), "ordinary")]
    assert [r.purpose for r in unhandled.collect()] == ["Spin Off"]
    for text, message in (('{"a": 1}', "no list"), ('[{"scrip_code": 1, "Purpose": "x"}]', "exdate")):
        with pytest.raises(Exception, match=message):
            files.read_actions(spark, written(tmp_path, "bad.json", text)).collect()


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Bonus issue 1:1", ("bonus", "ordinary", 1, 2, None)),
        ("Stock  Split From Rs.10/- to Rs.2/-", ("split", "ordinary", 1, 5, None)),
        ("Stock Split From Rs 1 to Rs 10", ("consolidation", "ordinary", 10, 1, None)),
        ("Interim Dividend - Rs. - 2.5000", ("dividend", "interim", None, None, 2.5)),
        ("Dividend - Rs. - 7", ("dividend", "ordinary", None, None, 7)),
        ("Some Special Dividend - Rs. - 7", ("dividend", "ordinary", None, None, 7)),
        ("Scheme of Arrangement", ("unhandled", "ordinary", None, None, None)),
    ],
)
def test_purposes(spark, text, expected):
    r = spark.createDataFrame([(text,)], "t string").select(files.parse_purpose(F.col("t")).alias("p")).first().p
    assert tuple(float(x) if isinstance(x, D) else x for x in r) == expected


def test_archives_and_pages(spark, tmp_path):
    root = tmp_path / "land" / "src"
    root.mkdir(parents=True)
    for name, entries in (("one.zip", ["a.csv"]), ("two.zip", ["a.csv", "b.csv"])):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for e in entries:
                z.writestr(e, "x,y\n1,2\n")
        (root / name).write_bytes(data.getvalue())
    (root / "page.csv").write_bytes(b" \n<html>")
    (root / "bad.zip").write_bytes(b"nothing")
    landed = lambda g: files.landed(spark, str(tmp_path / "land"), "src", g)
    one = files.unzip(landed("one.zip"), ".csv").first()
    assert one.name == "a.csv" and bytes(one.content) == b"x,y\n1,2\n"
    for name, message in (("two.zip", "2 entries"), ("bad.zip", "no archive")):
        with pytest.raises(Exception, match=message):
            files.unzip(landed(name)).collect()
    assert files.not_error_pages(landed("*.csv")).count() == 0 and files.not_error_pages(landed("*.zip")).count() == 3


def test_registry(spark):
    from tidemark.plans.catalogue import REGISTRY

    sources, versions = registry.load_registry(spark, REGISTRY)
    assert sources.first().requests_per_second == D("0.500") and versions.count() == 2
    days = spark.createDataFrame([("bars", date(1998, 7, 5)), ("bars", date(1998, 7, 6)), ("bars", date(1998, 8, 1)), ("bars", date(1990, 1, 1))], "source_id string, trade_date date")
    found = registry.with_schema_version(days, versions)
    assert {r.trade_date: r.version for r in found.collect()} == {date(1998, 7, 5): "old", date(1998, 7, 6): None, date(1998, 8, 1): "new", date(1990, 1, 1): None}
    assert registry.unmapped(found).count() == 2


def test_merges(spark):
    old = spark.createDataFrame([("A", "a", "s"), ("B", None, "s"), (None, "n", "s")], "isin string, name string, sector string")
    new = spark.createDataFrame([("B", "b", "t"), ("C", "c", "t"), (None, "m", "t")], "isin string, name string, sector string")
    assert sorted(map(tuple, sinks.merge_instruments(old, new).collect()), key=str) == sorted([("A", "a", "s"), ("B", "b", "s"), ("C", "c", "t"), (None, "m", "s")], key=str)
    assert sorted(map(tuple, sinks.insert_if_absent(old, new, ["isin"]).collect()), key=str) == sorted([("A", "a", "s"), ("B", None, "s"), (None, "n", "s"), ("C", "c", "t")], key=str)
    v = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "source_id string, v int")
    assert sorted(map(tuple, sinks.replace_versions(v, spark.createDataFrame([("x", 9)], "source_id string, v int")).collect())) == [("x", 9), ("y", 1)]


def fact(day, close):
    return ("IN0123456789", "BSE", day, day, D(1), D(2), D(1), D(close), None, 1, None, None)


def test_append_only_facts_and_stream(spark, tmp_path):
    path = str(tmp_path / "facts")
    sinks.append_facts(spark.createDataFrame([fact(date(2023, 5, 1), 1), fact(date(2024, 5, 1), 2)], PRICE_DAILY), path, "price_daily")
    with pytest.raises(Exception, match="volume_not_negative"):
        sinks.append_facts(spark.createDataFrame([(*fact(date(2024, 5, 1), 2)[:9], -1, None, None)], PRICE_DAILY), path, "price_daily")
    late = str(tmp_path / "late")
    spark.createDataFrame([fact(date(2024, 5, 2), 3)], PRICE_DAILY).write.parquet(late)
    append_stream(spark.readStream.schema(PRICE_DAILY).parquet(late), path, "price_daily", str(tmp_path / "ck")).awaitTermination()
    ranged = sinks.read_facts(spark, path, "2024-01-01", "2024-12-31")
    assert sorted(float(r.close) for r in ranged.collect()) == [2.0, 3.0]
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    sinks.export_csv(ranged, str(tmp_path / "csv"), "trade_date")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def day_sources(spark):
    return {"b": "BSE", "n": "NSE"}, spark.createDataFrame(
        [(s, a, v, e) for s in "bn" for a, v, e in ((date(1990, 1, 1), "legacy", date(2024, 7, 5)), (date(2024, 7, 8), "udiff", None))],
        "source_id string, effective_from date, version string, effective_to date")


OLD_BSE = "SC_CODE,SC_NAME,SC_GROUP,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,NO_TRADES,NO_OF_SHRS,NET_TURNOV,ISIN_CODE,TRADING_DATE\n500001,NAME   ,A ,1,2,1,{close},,5,10,20,IN0123456789,{day:%d-%b-%y}\n500002,N,G,1,1,1,1,1,1,1,1,IN0123456780,{day:%d-%b-%y}\n"
OLD_NSE = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN\nSYM,EQ,1,2,1,{close},,10,20,{day:%d-%b-%Y},3,IN0123456789\n"
NEW = UDIFF + "{day},CM,500001,IN0123456789,SYM,{series}, Name ,1.5,2,1,{close},,100, ,7\n"


def zipped(text, entries=1):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in range(entries):
            z.writestr(f"x{i}.csv", text)
    return data.getvalue()


def test_a_hundred_day_files_of_both_versions_in_one_plan(spark, tmp_path):
    from datetime import timedelta

    from tidemark.sources import day_files

    rows, wanted = [], set()
    for k in range(50):
        day = date(2024, 6, 10) + timedelta(k)
        for s, old, series in (("b", OLD_BSE, "A"), ("n", OLD_NSE, "EQ")):
            text = (old if day <= date(2024, 7, 5) else NEW).format(day=day, close=k + 1, series=series)
            rows.append((s, f"{day:%Y%m%d}", ".zip" if s == "n" else ".csv", zipped(text) if s == "n" else ("﻿" + text).encode()))
            if day not in (date(2024, 7, 6), date(2024, 7, 7)):
                wanted.add(("BSE" if s == "b" else "NSE", day, float(k + 1)))
    root = str(tmp_path / "land")
    landing = spark.createDataFrame(rows, "source_id string, partition string, suffix string, content binary").repartition(5)
    day_files.land(landing, root)
    venues, versions = day_sources(spark)
    bars = day_files.read_days(spark, root, venues, versions)
    got = bars.collect()
    assert {(r.venue, r.day, float(r.close)) for r in got} == wanted and len(got) == len(wanted) and all(r.day == r.trade_date for r in got)
    assert {(r.venue, r.local_symbol, r.scrip_code) for r in got if r.day < date(2024, 7, 6)} == {("BSE", "500001", "500001"), ("NSE", "SYM", None)}
    assert bars._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    scanned = day_files.scan_days(spark, root, venues, versions)
    assert {(r.source_id, r.day.day, r.error) for r in day_files.bad_files(scanned).collect()} == {(s, d, "failed: no schema version in force") for s in "bn" for d in (6, 7)}


def test_bad_day_files_are_rows_and_good_ones_are_read(spark, tmp_path):
    from tidemark.sources import day_files

    text, day = NEW.format(day="2024-08-14", close=3, series="A"), "20240814"
    files_ = {
        "20240801.csv": text.encode(), "20240802.csv": b" \n<html>", "20240803.zip": zipped(text, 2), "20240804.zip": zipped(text)[:50], "20240805.csv": text.replace("ISIN", "Isin").encode(), "20240806.csv": (text + "1,2\n").encode(),
        "20240807.csv": b"", "20240808.csv": UDIFF.encode(), "notes.csv": text.encode(), "20249999.csv": text.encode(), "20240809.zip": zipped(text), "20240810.csv": text.replace("TradDt", " TradDt").encode(),
    }
    (tmp_path / "land" / "b").mkdir(parents=True)
    for name, data in files_.items():
        (tmp_path / "land" / "b" / name).write_bytes(data)
    venues, versions = day_sources(spark)
    scanned = day_files.scan_days(spark, str(tmp_path / "land"), venues, versions)
    errors = {r.path: r.error for r in day_files.bad_files(scanned).collect()}
    assert {p[2:] for p in errors} == set(files_) - {"20240801.csv", "20240808.csv", "20240809.zip"}
    for name, reason in (("20240802.csv", "web page"), ("20240803.zip", "2 entries"), ("20240804.zip", "no archive"), ("20240805.csv", "missing: ISIN"), ("notes.csv", "no day"), ("20249999.csv", "no day"), ("20240810.csv", "missing: TradDt")):
        assert reason in errors["b/" + name], name
    assert {r.path: (r.at, r.error) for r in scanned.where("path = 'b/20240808.csv'").collect()} == {"b/20240808.csv": (None, None)}
    assert day_files.typed(scanned).count() == 2
    (counts,) = day_files.outcomes(scanned, "2024-08-01", "2024-08-16").collect()
    assert tuple(counts) == ("b", 3, 12 - 3 - 3, 3) and day in text.replace("-", "")
    bad = tmp_path / "bad"
    (bad / "b").mkdir(parents=True)
    (bad / "b" / "20240814.csv").write_text(text.replace(",3,", ",x,"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        day_files.read_days(spark, str(bad), venues, versions).collect()
    assert day_files.scan_days(spark, str(tmp_path / "none"), venues, versions).count() == 0


def test_filters_drop_files_before_they_are_opened(spark, tmp_path):
    from tidemark.sources import day_files

    (tmp_path / "land" / "b").mkdir(parents=True)
    for d in (1, 2, 5, 6):
        (tmp_path / "land" / "b" / f"2024080{d}.csv").write_text(NEW.format(day=f"2024-08-0{d}", close=d, series="A"))
    venues, versions = day_sources(spark)
    scanned = day_files.scan_days(spark, str(tmp_path / "land"), venues, versions).where("day >= DATE '2024-08-02' AND day < DATE '2024-08-06' AND source_id = 'b'")
    (tmp_path / "land" / "b" / "20240801.csv").chmod(0)
    (tmp_path / "land" / "b" / "20240801.csv").write_bytes(b"not read")
    assert sorted(r.day.day for r in scanned.collect()) == [2, 5]
    reader = day_files.DayFileReader({"path": str(tmp_path / "land"), "venues": '{"b": "BSE"}', "versions": "[]"})
    list(reader.pushFilters([day_files.GreaterThan(("day",), date(2024, 8, 2)), day_files.EqualTo(("venue",), "BSE")]))
    assert [f[2].day for p in reader.partitions() for f in p.value] == [5, 6]


def test_landing_keeps_what_is_there(spark, tmp_path):
    from tidemark.sources import day_files

    root, shape = str(tmp_path / "land"), "source_id string, partition string, suffix string, content binary, extra int"
    day_files.land(spark.createDataFrame([("b", "20240801", ".csv", b"one", 1), ("b", "20240802", ".csv", b" <page>", 1), ("n", "20240801", ".zip", None, 1)], shape), root)
    day_files.land(spark.createDataFrame([("b", "20240801", ".csv", b"two", 1), ("b", "20240803", ".csv", b"three", 1)], shape), root)
    found = {p.relative_to(root).as_posix(): p.read_bytes() for p in (tmp_path / "land").rglob("*") if p.is_file()}
    assert found == {"b/20240801.csv": b"one", "b/20240803.csv": b"three", "n/20240801.zip": b""}
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame([("b", "1", ".x", b"")], "source_id string, partition string, suffix string, content binary").write.format("landing").option("path", root).mode("overwrite").save()


def test_long_day_files_are_written_and_read_in_pieces(spark, tmp_path):
    """Files of many blocks, plain and zipped: no worker holds a whole one."""
    import pyarrow as pa

    from tidemark.sources import day_files

    head, line = NEW.format(day="2024-08-14", close=1, series="A").splitlines()
    n, root = 60_000, str(tmp_path / "land")
    body = spark.range(n, numPartitions=3).selectExpr("explode(array('csv', 'zip')) AS kind", "1 AS at", f"format_string('%s,%08d\n', '{line}', id) AS text")
    pieces = spark.createDataFrame([("csv", 0, head + ",Rmks\n"), ("zip", 0, head + ",Rmks\n")], "kind string, at int, text string").unionByName(body)
    day_files.land_pieces(pieces.selectExpr("if(kind = 'csv', 'b', 'n') AS source_id", "'20240814' AS partition", "concat('.', kind) AS suffix", "if(kind = 'zip', 'x.csv', null) AS entry", "at", "cast(text AS binary) AS content"), root)
    plain = (tmp_path / "land" / "b" / "20240814.csv").read_bytes()
    with zipfile.ZipFile(tmp_path / "land" / "n" / "20240814.zip") as z:
        assert z.read("x.csv") == plain
    assert plain.decode().splitlines() == [head + ",Rmks", *(f"{line},{i:08d}" for i in range(n))]
    venues, versions = day_sources(spark)
    scanned = day_files.scan_days(spark, root, venues, versions)
    assert {(r.path, r.n, r.a, r.b, r.e) for r in scanned.groupBy("path").agg(F.count("at").alias("n"), F.min("at").alias("a"), F.max("at").alias("b"), F.max("error").alias("e")).collect()} == {(p, n, 1, n, None) for p in ("b/20240814.csv", "n/20240814.zip")}
    states = day_files.scan_days(spark, root, venues, versions, lines=False)
    assert {(r.path, r.at, r.error) for r in states.collect()} == {("b/20240814.csv", None, None), ("n/20240814.zip", None, None)}
    # A bad line at the end is found before any row is given out.
    (tmp_path / "land" / "b" / "20240814.csv").write_bytes(plain + b"1,2\n")
    reader = day_files.DayFileReader({"path": root, "venues": json.dumps(venues), "versions": json.dumps([("b", "2024-08-01", None, "udiff"), ("n", "2024-08-01", None, "udiff")])})
    before = pa.total_allocated_bytes()
    most, rows, errors = 0, 0, []
    for part in reader.partitions():
        for batch in reader.read(part):
            most, rows = max(most, pa.total_allocated_bytes() - before), rows + batch.num_rows
            errors += [e for e in batch.column(6).to_pylist()[:1] if e]
    assert rows == n + 1 and len(errors) == 1 and "Expected" in errors[0]
    assert most < 8 * day_files.BLOCK_BYTES < 2 * len(plain)
