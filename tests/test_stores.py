"""Stored tables: versions that switch whole, appends that check keys, latest versions kept up to date, counts taken while writing."""

import os
import random
from datetime import date, timedelta
from decimal import Decimal as D
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, spreads
from tidemark.plans import stores
from tidemark.schemas import DELIVERY_DAILY, LISTING, SCHEMA_VERSION, SOURCE_REGISTRY
from tidemark.sources import counters, sinks, snapshots
from tidemark.sources.snapshots import Store
from tidemark.streaming.arrivals import latest_stream

DAY = date(2023, 12, 20)


def delivered(spark, *rows):
    """(isin number, trade date, as-of date, quantity)"""
    return spark.createDataFrame([(f"IN{i:09}0", "BSE", t, a, q) for i, t, a, q in rows], DELIVERY_DAILY)


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_write_that_fails_leaves_the_old_table_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    store.replace(old)
    held = store.read()
    bad = old.select("k", F.when(F.col("k") == 2, F.raise_error(F.lit("broken row"))).otherwise(F.col("v")).cast("string").alias("v"))
    with pytest.raises(Exception, match="broken row"):
        snapshots.merge_into(store, old, lambda there, new: bad)
    assert store.version() == 1 and values(store.read()) == [(1, "a"), (2, "b")]
    store.replace(spark.createDataFrame([(3, "c")], "k int, v string"))
    assert values(store.read()) == [(3, "c")] and values(held) == values(store.read(1)) == [(1, "a"), (2, "b")]


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1,)], "k int")
    store.replace(rows)
    base = store.version()
    store.replace(spark.createDataFrame([(2,)], "k int"), base=base)
    with pytest.raises(snapshots.Conflict):
        store.replace(spark.createDataFrame([(3,)], "k int"), base=base)
    assert values(store.read()) == [(2,)]


def test_old_versions_expire_with_folders_that_nobody_lists(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    for i in range(4):
        store.add(spark.createDataFrame([(i, f"p{i % 2}")], "k int, p string"), F.col("p"))
    store.replace(spark.createDataFrame([(9, "p0")], "k int, p string"), F.col("p"), ["p0"])
    assert store.expire(2) == 3 and store.versions() == [4, 5]
    assert sorted(r.k for r in store.read().collect()) == [1, 3, 9] and sorted(r.k for r in store.read(4).collect()) == [0, 1, 2, 3]
    store.expire(1)
    assert sorted(r.k for r in store.read().collect()) == [1, 3, 9] and len(list((tmp_path / "t" / "data").iterdir())) == 3
    with pytest.raises(ValueError, match="not to change"):
        store.replace(spark.createDataFrame([(9, "p7")], "k int, p string"), F.col("p"), ["p0"])


def test_parts_with_odd_names_and_empty_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no version"):
        store.read()
    assert store.read(schema=DELIVERY_DAILY).count() == 0
    store.replace(spark.createDataFrame([(1, "a/b c=%"), (2, "x")], "k int, p string"), F.col("p"))
    assert set(store.manifest()["parts"]) == {"a/b c=%", "x"} and values(store.read(parts=["a/b c=%"])) == [(1, "a/b c=%")]
    store.replace(spark.createDataFrame([], "k int, p string"), F.col("p"))
    assert store.read().count() == 0 and store.read().columns == ["k", "p"]


def test_the_second_append_of_a_file_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    facts = delivered(spark, (1, DAY, DAY, 5), (1, DAY, DAY + timedelta(1), 6), (2, DAY + timedelta(20), DAY + timedelta(20), 7))
    assert snapshots.append_new(store, facts, "delivery_daily") == 0
    assert snapshots.append_new(store, facts, "delivery_daily") == 3 and store.version() == 1
    more = facts.unionByName(delivered(spark, (3, DAY, DAY, 8), (3, DAY, DAY, 9)))
    with pytest.raises(snapshots.RepeatedKeys, match="4 repeated keys"):
        snapshots.append_new(store, more, "delivery_daily", on_repeat="fail")
    assert store.version() == 1
    assert snapshots.append_new(store, more, "delivery_daily") == 4
    assert sorted(r.delivery_quantity for r in store.read().collect()) == [5, 6, 7, 8]
    with pytest.raises(Exception, match="delivery_not_negative"):
        snapshots.append_new(store, delivered(spark, (4, DAY, DAY, -1)), "delivery_daily")
    assert store.version() == 2
    assert snapshots.append_new(store, delivered(spark), "delivery_daily") == 0 and store.version() == 2


def test_an_append_reads_only_the_years_it_touches(spark, tmp_path):
    import shutil

    store = Store(spark, str(tmp_path / "t"))
    snapshots.append_new(store, delivered(spark, *((1, date(y, 3, 1), date(y, 3, 1), y) for y in range(2015, 2024))), "delivery_daily")
    assert {f.split("_part=")[1][:4] for f in store.read(parts=["2023"]).inputFiles()} == {"2023"}
    shutil.rmtree(tmp_path / "t" / store.manifest()["parts"]["2015"][0])  # a year that isn't there can't be read
    assert snapshots.append_new(store, delivered(spark, (1, date(2023, 3, 1), date(2023, 3, 1), 0), (2, date(2023, 3, 1), date(2023, 3, 1), 1)), "delivery_daily") == 1
    assert sorted(r.delivery_quantity for r in store.read(parts=["2022", "2023"]).collect()) == [1, 2022, 2023]


def versions(n, seed=4):
    rng = random.Random(seed)
    rows = {}
    for _ in range(n):
        t = DAY + timedelta(rng.randrange(70))
        rows[rng.randrange(12), t, t + timedelta(rng.randrange(40))] = rng.randrange(1000)
    return [(*k, q) for k, q in rows.items()]


def test_ten_batches_equal_a_full_recompute(spark, tmp_path):
    rows = versions(900)
    store = Store(spark, str(tmp_path / "t"))
    for i in range(10):
        months = snapshots.keep_latest(store, delivered(spark, *rows[i::10]), asof.PRICE_KEYS, batch_id=i)
        assert months == sorted({f"{t:%Y-%m}" for _, t, _, _ in rows[i::10]})
    assert values(store.read()) == values(asof.latest_delivery(delivered(spark, *rows)))
    before = store.version()
    assert snapshots.keep_latest(store, delivered(spark, (1, DAY, DAY + timedelta(99), 1)), asof.PRICE_KEYS, batch_id=9) == [] and store.version() == before


def test_months_without_a_key_of_the_batch_keep_their_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    snapshots.keep_latest(store, delivered(spark, (1, date(2023, 1, 2), date(2023, 1, 2), 1), (1, date(2023, 2, 1), date(2023, 2, 1), 2)), asof.PRICE_KEYS)
    old = store.manifest()["parts"]
    late = delivered(spark, (1, date(2023, 1, 2), date(2023, 3, 1), 9), (1, date(2023, 1, 2), date(2023, 1, 1), 8), (2, date(2023, 1, 2), date(2023, 1, 2), 7))
    assert snapshots.keep_latest(store, late, asof.PRICE_KEYS) == ["2023-01"]
    new = store.manifest()["parts"]
    assert new["2023-02"] == old["2023-02"] and new["2023-01"] != old["2023-01"]
    assert sorted((r.isin[-3:], r.delivery_quantity) for r in store.read().collect()) == [("010", 2), ("010", 9), ("020", 7)]
    # Of equal as-of dates the kept row stays.
    snapshots.keep_latest(store, delivered(spark, (1, date(2023, 2, 1), date(2023, 2, 1), 77)), asof.PRICE_KEYS)
    assert sorted(r.delivery_quantity for r in store.read().collect()) == [2, 7, 9]


def test_a_batch_is_merged_by_one_exchange_and_one_sort(spark, tmp_path, monkeypatch):
    """The choice of the newest and the write share both; a month beyond the rows of a task is several tasks', with the same result."""
    rows, plans = versions(900), []
    stage = Store.stage

    def watched(self, frame, *how, **more):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return stage(self, frame, *how, **more)

    monkeypatch.setattr(Store, "stage", watched)
    for share, files in ((1_000_000, 1), (20, 2)):
        monkeypatch.setattr(snapshots, "SHARE", share)
        store = Store(spark, str(tmp_path / str(share)))
        for i in range(3):
            snapshots.keep_latest(store, delivered(spark, *rows[i::3]), asof.PRICE_KEYS, batch_id=i)
        assert values(store.read()) == values(asof.latest_delivery(delivered(spark, *rows)))
        folders = [tmp_path / str(share) / f for fs in store.manifest()["parts"].values() for f in fs]
        assert max(len(list(f.glob("*.parquet"))) for f in folders) >= files and (files > 1 or all(len(list(f.glob("*.parquet"))) == 1 for f in folders))
        assert "_part" not in store.read().columns and "_share" not in store.read().columns
    assert all(p.count("Exchange ") == 1 and p.count("Sort [") == 1 for p in plans) and len(plans) == 6


def test_a_stream_of_corrections_keeps_the_latest(spark, tmp_path):
    rows = versions(200, 7)
    for part in range(2):
        delivered(spark, *rows[part::2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(DELIVERY_DAILY).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        latest_stream(stream(), str(tmp_path / "t"), asof.PRICE_KEYS, str(tmp_path / "ck")).awaitTermination()
    assert values(Store(spark, str(tmp_path / "t")).read()) == values(asof.latest_delivery(delivered(spark, *rows)))


def test_laid_out_by_key_nothing_is_shuffled(spark, sf):
    prices, deliveries = stores.bucketed(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (asof.latest_price(prices), spreads.delivery_participation(asof.latest_price(prices), asof.latest_delivery(deliveries))):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
            assert df.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_registry_sync(spark, tmp_path):
    root = str(tmp_path / "r")
    source = lambda *ids: spark.createDataFrame([(i, 1, None, f"https://example.org/{i}{n}", D("0.5"), None, None) for i, n in ids], SOURCE_REGISTRY)
    span = lambda *rows: spark.createDataFrame([(s, date(y, 1, 1), v, None) for s, y, v in rows], SCHEMA_VERSION)
    snapshots.sync_registry(spark, root, source(("a", 1), ("b", 1), ("c", 1)), span(("a", 2000, "x"), ("a", 2001, "y"), ("b", 2000, "x"), ("c", 2000, "x")))
    snapshots.sync_registry(spark, root, source(("a", 2), ("c", 2)), span(("a", 2005, "z")))
    assert sorted((r.source_id, r.base_url[-2:]) for r in Store(spark, f"{root}/source_registry").read().collect()) == [("a", "a2"), ("b", "b1"), ("c", "c2")]
    assert sorted((r.source_id, r.version) for r in Store(spark, f"{root}/source_schema_version").read().collect()) == [("a", "z"), ("b", "x")]


def test_stored_merges(spark, tmp_path):
    store = Store(spark, str(tmp_path / "l"))
    line = lambda *rows: spark.createDataFrame([("IN0000000010", "BSE", s, code, DAY, end, end and "delisted") for s, code, end in rows], LISTING)
    snapshots.merge_into(store, line(("A", "1", None)), snapshots.MERGES["listing"])
    snapshots.merge_into(store, line(("A", "9", DAY + timedelta(5)), ("B", "2", None)), snapshots.MERGES["listing"])
    assert sorted((r.local_symbol, r.scrip_code, r.closure_reason) for r in store.read().collect()) == [("A", "1", "delisted"), ("B", "2", None)]


def test_counts_come_with_the_write(spark, tmp_path):
    rows = [("BSE", "A")] * 3 + [("NSE", "A")] * 2 + [("NSE", "EQ"), (None, "EQ"), ("NSE", None), ("XXX", "EQ")] + [("BSE", f"Q{i}") for i in range(1500) for _ in range(i % 3 + 1)]
    kept, seen = counters.equity_counted(spark.createDataFrame(rows, "venue string, series string").repartition(5))
    kept.write.parquet(str(tmp_path / "kept"))
    got = counters.counts(seen)
    want = {"NSE:A": 2, "(none):EQ": 1, "NSE:(none)": 1, "XXX:EQ": 1} | {f"BSE:Q{i}": i % 3 + 1 for i in range(1500)}
    assert (got["read"], got["kept"], got["skipped"]) == (len(rows), 4, want)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 4
    many, seen = counters.equity_counted(spark.createDataFrame([("BSE", f"Q{i}") for i in range(2500)], "venue string, series string"))
    many.count()
    with pytest.raises(ValueError, match="different codes"):
        counters.counts(seen)


def test_action_counts_and_examples(spark):
    records = spark.createDataFrame([(i, "500" if i % 4 else "9", p, "20240814") for i, p in enumerate(["Bonus issue 1:1", "Scheme", "Dividend - Rs. - 2", "Merger", "Bonus issue 1:2", "Scheme", "Split", "Demerger"])], "ordinal int, scrip_code string, purpose string, exdate string")
    actions, seen = counters.actions_counted(records, spark.createDataFrame([("500", "IN0000000010")], "scrip_code string, isin string"), "2024-09-01", "src")
    assert actions.collect()[0].action_type == "dividend"
    got = counters.counts(seen)
    assert (got["read"], got["unmatched"], got["unhandled"], got["kept"], got["kinds"]) == (8, 2, 5, 1, {"dividend": 1})
    assert 1 <= len(got["examples"]) <= 5 and set(got["examples"]) <= {"Scheme", "Merger", "Split", "Demerger"}


def test_bucketed_tables_read_what_was_written(spark):
    facts = delivered(spark, *versions(60))
    assert values(sinks.save_bucketed(facts, "bucket_probe", 4)) == values(facts)


def test_bucketed_tables_replace_what_another_session_left(spark, sf):
    """A folder in the warehouse whose table the catalog doesn't know, as after a restart."""
    prices, _ = stores.bucketed(spark, sf, "restarted")
    want = values(prices)
    name = next(t.name for t in spark.catalog.listTables() if t.name.startswith("restarted_price"))
    place = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Location'").first()[1].removeprefix("file:")
    for t in [t.name for t in spark.catalog.listTables() if t.name.startswith("restarted_")]:
        left = spark.sql(f"DESCRIBE EXTENDED {t}").where("col_name = 'Location'").first()[1].removeprefix("file:")
        spark.sql(f"DROP TABLE {t}")
        os.makedirs(left, exist_ok=True)
        Path(left, "left").write_text("x")
    assert values(stores.bucketed(spark, sf, "restarted")[0]) == want and not Path(place, "left").exists()


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    """One year holds all rows: adaptive plans deal it by size, and nothing is lost."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        rows = spark.range(40_000, numPartitions=4).selectExpr("uuid() AS x", "id")
        store = Store(spark, str(tmp_path / "t"))
        store.replace(rows, F.lit("1996"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert sum(p.suffix == ".parquet" for p in (tmp_path / "t").rglob("*")) > 1
    assert store.read().selectExpr("count(*)", "count(DISTINCT id)", "sum(id)").first()[:] == (40_000, 40_000, 40_000 * 39_999 // 2)
