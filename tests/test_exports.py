"""Ordered exports, the order's proof, and bulk loads that a broken key stops."""

from datetime import date, timedelta
from decimal import Decimal as D

import pytest

from tidemark.schemas import INSTRUMENT_MASTER, LISTING, PRICE_DAILY
from tidemark.sources import exports, sinks
from tidemark.sources.snapshots import RepeatedKeys, Store

DAY = date(2023, 12, 1)
I = [f"IN{i:09}0" for i in range(60)]  # noqa: E741


def instruments(spark, n=60, name="Name, \"quoted\" "):
    return spark.createDataFrame([(i, name + i, None, "IN", "equity") for i in I[:n]], INSTRUMENT_MASTER)


def prices(spark, *keys):
    return spark.createDataFrame([(i, "BSE", t, t, D(1), D(2), D(1), D(2), None, 5, None, None) for i, t in keys], PRICE_DAILY)


def test_parts_follow_each_other_under_one_header(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        exports.export_ordered(instruments(spark).repartition(7), "instrument_master", path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = "".join(p.read_text() for p in sorted((tmp_path / "x.csv").glob("part-*"))).splitlines()
    assert text[0] == "isin,name,sector,country,instrument_type" and len(text) == 61 and text[1:] == sorted(text[1:])
    assert len([p for p in (tmp_path / "x.csv").glob("part-*") if p.stat().st_size]) > 1
    rows = exports.read_export(spark, path, "instrument_master")
    assert sorted((r.isin, r.name, r.sector) for r in rows.collect()) == [(i, ("Name, \"quoted\" " + i).strip(), None) for i in I]
    assert [r.isin for r in exports.numbered(rows).orderBy("n").collect()] == I and exports.disorder(rows, ("isin",)).count() == 0


def test_disorder_is_seen_inside_a_part_and_between_parts(spark, tmp_path):
    head, line = "isin,name,sector,country,instrument_type", "{0},n,,IN,equity"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "part-00000").write_text("\n".join([head, *(line.format(i) for i in (I[1], I[0], I[5]))]) + "\n")
    (tmp_path / "x" / "part-00001").write_text("\n".join(line.format(i) for i in (I[4], I[6])) + "\n")
    bad = exports.disorder(exports.read_export(spark, str(tmp_path / "x"), "instrument_master"), ("isin",))
    assert sorted((r.isin, r.part, r.line) for r in bad.collect()) == [(I[0], "part-00000", 2), (I[4], "part-00001", 0)]


def test_empty_tables_nulls_and_line_ends(spark, tmp_path):
    path = str(tmp_path / "e")
    exports.export_ordered(spark.createDataFrame([], LISTING), "listing", path)
    assert exports.read_export(spark, path, "listing").count() == 0 and exports.header_of(spark, path)[0] == "isin"
    with pytest.raises(Exception, match="line end"):
        exports.export_ordered(instruments(spark, 1, "two\nlines"), "instrument_master", str(tmp_path / "n"))


def test_parents_load_before_children_and_twice_is_refused(spark, tmp_path):
    folder, root = str(tmp_path / "seed"), str(tmp_path / "db")
    exports.export_ordered(prices(spark, *((i, DAY + timedelta(k * 40)) for i in I[:5] for k in range(3))), "price_daily", f"{folder}/price_daily.csv")
    exports.export_ordered(instruments(spark, 5), "instrument_master", f"{folder}/instrument_master.csv")
    assert exports.bulk_load(spark, folder, root) == {"instrument_master": 1, "price_daily": 1}
    store = Store(spark, f"{root}/price_daily")
    assert store.read().count() == 15 and set(store.manifest()["parts"]) == {"2023", "2024"}
    with pytest.raises(RepeatedKeys, match="instrument_master"):
        exports.bulk_load(spark, folder, root)
    assert store.version() == 1


def test_an_orphan_stops_the_whole_load(spark, tmp_path):
    folder, root = str(tmp_path / "seed"), str(tmp_path / "db")
    (tmp_path / "seed").mkdir()
    (tmp_path / "seed" / "instrument_master.csv").write_text(f"isin,name,country,instrument_type\n{I[0]},A,IN,equity\n{I[1]},B,IN,equity\n")
    exports.export_ordered(prices(spark, (I[0], DAY), (I[9], DAY), (I[9], DAY + timedelta(1))), "price_daily", f"{folder}/price_daily.csv")
    with pytest.raises(exports.ForeignKeyViolation, match=f"2 rows of price_daily have no instrument_master: .*{I[9]}"):
        exports.bulk_load(spark, folder, root)
    assert Store(spark, f"{root}/instrument_master").version() == 0
    # Once its parent is there, what is left loads; parents may be in the tables already.
    (tmp_path / "seed" / "instrument_master.csv").write_text(f"isin,name,country,instrument_type\n{I[0]},A,IN,equity\n{I[9]},B,IN,equity\n")
    assert set(exports.bulk_load(spark, folder, root)) == {"instrument_master", "price_daily"}
    exports.export_ordered(spark.createDataFrame([(I[9], "BSE", "S", None, DAY, None, None)], LISTING), "listing", f"{tmp_path}/more/listing.csv")
    assert exports.bulk_load(spark, f"{tmp_path}/more", root) == {"listing": 1}


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("isin,name,country,instrument_type,colour\nIN0000000010,A,IN,equity,x\n", "colour"), ("isin,name,country,instrument_type\nIN0000000010,A,India,equity\n", "country_form"),
        ("isin,name,country,instrument_type\nIN0000000010,A,IN,equity\nIN0000000010,B,IN,equity\n", "repeats keys"), ("isin,name,country,instrument_type\nIN0000000010,\"A\n", "MALFORMED|FAILFAST|malformed"),
    ],
)
def test_what_else_stops_a_load(spark, tmp_path, text, message):
    (tmp_path / "seed").mkdir()
    (tmp_path / "seed" / "instrument_master.csv").write_text(text)
    with pytest.raises(Exception, match=message):
        exports.bulk_load(spark, str(tmp_path / "seed"), str(tmp_path / "db"))
    assert Store(spark, str(tmp_path / "db" / "instrument_master")).version() == 0


def test_every_table_of_the_load_order_has_its_keys():
    assert set(exports.FOREIGN_KEYS) | set(exports.PRIMARY_KEYS) <= set(sinks.LOAD_ORDER)
    for child, (_, parent, _) in exports.FOREIGN_KEYS.items():
        assert sinks.LOAD_ORDER.index(parent) < sinks.LOAD_ORDER.index(child)
