"""Every query of the engine against its SQL, and a stream."""

import importlib

import duckdb
import pytest
from pyspark.sql import functions as F

from daybook.plans import catalog
from daybook.sources import wire
from daybook.streaming import documents

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{D}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, sql, name):
    ours = catalog.QUERIES[name](spark, D).toPandas()
    theirs = sql.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = lambda f: sorted(repr([None if x is None or x != x else x for x in r]) for r in f[sorted(f.columns)].astype(object).itertuples(index=False, name=None))
    assert len(ours) and rows(ours) == rows(theirs)


#: Queries whose rows depend on how a zone-less time is read, once more in a session whose clocks change.
ZONED = ["parse_events_by_month", "typed_kinds", "native_instants", "period_end", "event_end_and_duration", "duration_between_zones", "todos_and_alarms", "freebusy_periods", "rrule_daily_count", "rrule_until_inclusive", "rrule_monthly_nth_weekday",
         "rrule_hourly_byhour", "rrule_skip", "occurrences_of_events", "zone_wall_to_utc", "expand_dst_zurich", "vtimezone_asof", "vtimezone_from_utc", "zone_precedence", "missing_tzids", "vtimezone_generated", "add_missing_zones", "set_properties"]


@pytest.mark.parametrize("name", ZONED)
def test_query_in_a_session_with_daylight_saving(spark, sql, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        test_query_equals_sql(spark, sql, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_todos_beside_their_alarms_without_a_join(spark, tmp_path):
    rows = [(1, "2020-02-28 10:00:00"), (1, "2021-01-01 00:00:00"), (9, "2020-12-30 23:59:59"), (-3, "2020-03-01 00:00:00"), (None, "2020-05-05 00:00:00"), (4, None)]
    spark.createDataFrame(rows, "o_orderkey bigint, d string").select("o_orderkey", F.col("d").cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    ours = catalog.QUERIES["todos_and_alarms"](spark, str(tmp_path))
    # the optimizer takes a table to be no larger than its files, and so would send millions of to-dos to the driver
    assert not any(n in ours._jdf.queryExecution().executedPlan().toString() for n in ("Join", "Broadcast"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    theirs = con.execute(catalog.ORACLE_SQL["todos_and_alarms"]).fetchall()
    assert len(theirs) == len(rows) and sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, theirs))


def test_entry_points(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_files_as_a_stream(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.ics").write_bytes(f"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:{k}\r\nDTSTART:20200{k + 1}01T100000\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n".encode())
    stream = documents.events(documents.read_files(spark, str(tmp_path)))
    run = stream.select("uid").writeStream.format("memory").queryName("uids").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r.uid for r in spark.table("uids").collect()) == ["0", "1", "2"]
    batch = wire.read_files(spark, str(tmp_path), strict=True)
    assert wire.one_root(batch).count() == 3 and wire.errors(batch).count() == 0


def test_days_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.ics").write_bytes(f"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nDTSTART:2020{k // 2 + 1:02}01T1{k}0000\r\nRRULE:FREQ=DAILY;COUNT=2\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n".encode())
    parsed = documents.read_files(spark, str(tmp_path / "in"))
    days = documents.events_by_day(parsed).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    days.awaitTermination(120)
    assert sorted((str(r.day), r.n) for r in spark.table("days").collect()) == [("2020-01-01", 2), ("2020-02-01", 2)]
    many = documents.occurrences(parsed).writeStream.format("memory").queryName("many").trigger(availableNow=True).start()
    many.awaitTermination(120)
    assert spark.table("many").count() == 8
