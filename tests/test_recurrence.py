"""Recurrence rules against published instances, dateutil, and each way of expansion against the others."""

import random
from datetime import date, datetime
from itertools import islice

import pytest
from dateutil.rrule import rrulestr
from pyspark.sql import functions as F

from daybook.functions import calendars, columns
from daybook.functions.recurrence import FREQUENCIES, WEEKDAYS, parse_instant, parse_rule, plan, wire
from daybook.operators import expand

# Examples of RFC 5545, section 3.8.5.3, and of RFC 7529, section 3 (rule, start, first instants).
PUBLISHED = [
    ("FREQ=WEEKLY;INTERVAL=2;COUNT=8;WKST=SU;BYDAY=TU,TH", "19970902T090000", "19970902T090000 19970904T090000 19970916T090000 19970918T090000 19970930T090000 19971002T090000 19971014T090000 19971016T090000"),
    ("FREQ=WEEKLY;INTERVAL=2;COUNT=4;BYDAY=TU,SU;WKST=MO", "19970805T090000", "19970805T090000 19970810T090000 19970819T090000 19970824T090000"),
    ("FREQ=WEEKLY;INTERVAL=2;COUNT=4;BYDAY=TU,SU;WKST=SU", "19970805T090000", "19970805T090000 19970817T090000 19970819T090000 19970831T090000"),
    ("FREQ=MONTHLY;INTERVAL=18;COUNT=10;BYMONTHDAY=10,11,12,13,14,15", "19970910T090000", "19970910T090000 19970911T090000 19970912T090000 19970913T090000 19970914T090000 19970915T090000 19990310T090000 19990311T090000 19990312T090000 19990313T090000"),
    ("FREQ=YEARLY;INTERVAL=4;BYMONTH=11;BYDAY=TU;BYMONTHDAY=2,3,4,5,6,7,8;COUNT=3", "19961105T090000", "19961105T090000 20001107T090000 20041102T090000"),
    ("FREQ=MONTHLY;COUNT=3;BYDAY=TU,WE,TH;BYSETPOS=3", "19970904T090000", "19970904T090000 19971007T090000 19971106T090000"),
    ("FREQ=MINUTELY;INTERVAL=90;COUNT=4", "19970902T090000", "19970902T090000 19970902T103000 19970902T120000 19970902T133000"),
    ("RSCALE=GREGORIAN;FREQ=MONTHLY;SKIP=BACKWARD;COUNT=4", "20140131", "20140131 20140228 20140331 20140430"),
    ("RSCALE=GREGORIAN;FREQ=MONTHLY;SKIP=FORWARD;COUNT=4", "20140131", "20140131 20140301 20140331 20140501"),
    ("RSCALE=CHINESE;FREQ=YEARLY;COUNT=4", "20130210", "20130210 20140131 20150219 20160208"),
    ("RSCALE=ETHIOPIC;FREQ=MONTHLY;BYMONTH=13;COUNT=3", "20130906", "20130906 20140906 20150906"),
]
# Cases of our own: rule, start, how many instants there are, and the last of them.
OWN = [
    ("FREQ=YEARLY;BYDAY=-2SA;COUNT=6", "20240101T070000", 6, "20291222T070000"),
    ("FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=-1;BYDAY=SA;COUNT=3", "20210101", 3, "20430228"),
    ("FREQ=MONTHLY;BYDAY=5FR;UNTIL=20251231T235959", "20250101T120000", 4, "20251031T120000"),
    ("FREQ=DAILY;BYMONTH=4;BYDAY=TH;COUNT=9", "20260110", 9, "20270422"),
    ("FREQ=YEARLY;BYMONTH=9,11;BYMONTHDAY=31", "20200101T000000", 0, None),
    ("FREQ=WEEKLY;INTERVAL=3;COUNT=4", "20251229", 4, "20260302"),
    ("FREQ=HOURLY;BYHOUR=5,22;BYDAY=WE;COUNT=5", "20260105T053015", 5, "20260121T053015"),
    ("FREQ=SECONDLY;BYMINUTE=59;BYHOUR=23;COUNT=61", "20260630T010203", 61, "20260701T235900"),
    ("FREQ=YEARLY;COUNT=9", "99960229T010000", 1, "99960229T010000"),
    ("FREQ=DAILY;INTERVAL=90000000", "20200101", 1, "20200101"),
    ("FREQ=YEARLY;BYWEEKNO=53;BYDAY=FR;COUNT=3", "20200101T080000", 3, "20321231T080000"),
    ("FREQ=YEARLY;BYYEARDAY=366,-366;COUNT=2", "20210101", 2, "20241231"),
    ("RSCALE=GREGORIAN;FREQ=YEARLY;BYMONTH=6;BYMONTHDAY=31;SKIP=FORWARD;COUNT=3", "20220115", 3, "20240701"),
    ("RSCALE=HEBREW;FREQ=YEARLY;BYMONTH=5L;BYMONTHDAY=8;SKIP=FORWARD;COUNT=5", "20140208", 5, "20180223"),
]


def instants(rule, start, **limits):
    p = plan(parse_rule(rule), parse_instant(start), **limits)
    return [wire(d, None if p.is_date else t) for d, t in islice(p.instants(), 1000)]


@pytest.mark.parametrize("rule,start,want", PUBLISHED)
def test_published_instances(rule, start, want):
    assert instants(rule, start) == want.split()


@pytest.mark.parametrize("rule,start,n,last", OWN)
def test_own_cases(rule, start, n, last):
    got = instants(rule, start)
    assert (len(got), got[-1] if got else None) == (n, last)
    if "RSCALE" not in rule and n:  # and all of them as dateutil has them, up to the last
        begin = datetime.strptime(start, "%Y%m%dT%H%M%S" if "T" in start else "%Y%m%d")
        theirs = [x.strftime("%Y%m%dT%H%M%S" if "T" in start else "%Y%m%d") for x in islice(rrulestr("RRULE:" + rule, dtstart=begin), n)]
        assert got == theirs


@pytest.mark.parametrize("bad", ["", "COUNT=3", "FREQ=DAILY;COUNT=1;UNTIL=20200101", "FREQ=DAILY;INTERVAL=0", "FREQ=DAILY;FREQ=DAILY", "FREQ=NEVER", "FREQ=DAILY;BYMONTH=13", "FREQ=DAILY;SKIP=OMIT", "FREQ=DAILY;BYMONTHDAY=0", "FREQ=DAILY;BYDAY=54MO", "FREQ=DAILY;BYHOUR=24"])
def test_rules_that_are_none(bad):
    with pytest.raises(ValueError):
        parse_rule(bad)


def random_rule(rng):
    f = rng.choice(FREQUENCIES[2:])
    parts = [f"FREQ={f}", f"COUNT={rng.randrange(1, 9)}"]
    if rng.random() < 0.4:
        parts.append(f"INTERVAL={rng.randrange(1, 6)}")
    if rng.random() < 0.3:
        parts.append("BYMONTH=" + ",".join(map(str, sorted(rng.sample(range(1, 13), 2)))))
    if rng.random() < 0.3 and f in ("MONTHLY", "DAILY"):
        parts.append("BYMONTHDAY=" + ",".join(map(str, rng.sample([1, 5, 15, 28, 31, -1, -3], 2))))
    elif rng.random() < 0.5:
        parts.append("BYDAY=" + ",".join(rng.sample(WEEKDAYS, 2)))
        if f in ("MONTHLY", "YEARLY") and rng.random() < 0.5:
            parts.append("BYSETPOS=" + rng.choice(["1", "-1", "2,-2"]))
    if rng.random() < 0.3:
        parts.append("WKST=" + rng.choice(WEEKDAYS))
    return ";".join(parts)


def test_agrees_with_dateutil():
    """Weekly rules with positions aside, and yearly ones with only days of months: there the two differ by design."""
    rng = random.Random(1)
    for _ in range(300):
        rule = random_rule(rng)
        start = datetime(rng.randrange(1990, 2030), rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(24), rng.randrange(60))
        mine = instants(rule, start.strftime("%Y%m%dT%H%M%S"), max_years=6)
        theirs = [x.strftime("%Y%m%dT%H%M%S") for x in islice(rrulestr("RRULE:" + rule, dtstart=start), len(mine))]
        assert mine == theirs, rule


def test_both_ways_agree(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        f = rng.choice(["DAILY", "WEEKLY", "HOURLY", "MINUTELY", "SECONDLY"])
        rule = f"FREQ={f};INTERVAL={rng.randrange(1, 50)};" + rng.choice([f"COUNT={rng.randrange(0, 12)}", "UNTIL=20200103T000000", "UNTIL=20190101T000000Z"])
        rows.append((k, rule, rng.choice(["20200101T100000", "20200101T235959Z", "20200101" if f in ("DAILY", "WEEKLY") else "20200101T000000"])))
    series = spark.createDataFrame(rows, "id int, rule string, dtstart string")
    assert expand.ways(series).where("way = 1").count() == 300
    fast = {}
    for r in expand.expand(series, limit=40).collect():
        fast.setdefault(r.id, []).append((r.seq, r.wall.strftime("%Y%m%dT%H%M%S")))
    for k, rule, start in rows:
        p = plan(parse_rule(rule), parse_instant(start))
        assert sorted(fast.get(k, [])) == [(n, wire(d, t)) for n, (d, t) in enumerate(islice(p.instants(), 40))], (rule, start)


def periodic_rule(rng):
    f = rng.choice(["DAILY", "WEEKLY", "MONTHLY", "YEARLY"])
    parts = [f"FREQ={f}"]
    some = lambda items, most=3: ",".join(map(str, rng.sample(items, rng.randrange(1, most + 1))))
    days = list(WEEKDAYS) + ([f"{n}{d}" for n in (1, 2, -1, 4, 5) for d in ("MO", "FR")] if f in ("MONTHLY", "YEARLY") else [])
    if f == "YEARLY" and rng.random() < 0.3:
        parts.append("BYYEARDAY=" + some([1, 60, 100, 365, 366, -1, -100, -366]))
    else:
        if rng.random() < 0.6:
            parts.append("BYDAY=" + some(days))
        if f in ("MONTHLY", "YEARLY") and rng.random() < 0.4:
            parts.append("BYMONTHDAY=" + some([1, 15, 28, 29, 31, -1, -3, -30]))
        if f == "YEARLY" and rng.random() < 0.5:
            parts.append("BYMONTH=" + some([1, 2, 6, 12]))
    if f != "DAILY" and rng.random() < 0.3:
        parts.append("BYSETPOS=" + some([1, -1, 2, -2, 7]))
    if rng.random() < 0.4 and f != "DAILY":
        parts.append(f"INTERVAL={rng.randrange(1, 5)}")
    if rng.random() < 0.3:
        parts.append("WKST=" + rng.choice(WEEKDAYS))
    parts += rng.choice([[], [f"COUNT={rng.randrange(0, 30)}"], [f"COUNT={rng.randrange(0, 30)}"], ["UNTIL=" + rng.choice(["20270105", "20301231T120000", "20000101T000000Z", "20260301T095959"])]])
    rng.shuffle(parts)
    return ";".join(parts)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_periods_in_the_jvm_are_those_of_plans(spark, zone):
    rng = random.Random(5)
    starts = ["20260301T100000", "20240229T235959", "20251231", "20260131T023000Z", "20260312T023000", "19991015", "99970510T000000"]
    rows = [(k, periodic_rule(rng), rng.choice(starts)) for k in range(900)]
    series = spark.createDataFrame(rows, "id int, rule string, dtstart string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        periodic = {r.id for r in expand.ways(series).where("way = 2").collect()}
        assert len(periodic) > 450
        got = {}
        for r in expand.expand(series, limit=25).select("id", "seq", F.col("wall").cast("string").alias("wall"), "is_date", "utc", "rule_error").collect():
            got.setdefault(r.id, []).append((r.seq, r.wall, r.is_date, r.utc, r.rule_error))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for k, rule, start in rows:
        at = parse_instant(start)
        p = plan(parse_rule(rule), at)
        shown = lambda d, t: f"{datetime.fromordinal(d):%Y-%m-%d} {t // 3600:02}:{t // 60 % 60:02}:{t % 60:02}"
        want = [(n, shown(d, t), at[1] is None, at[2], None) for n, (d, t) in enumerate(islice(p.instants(), 25))]
        assert sorted(got.get(k, [])) == want, (rule, start, k in periodic)


def test_rules_are_checked_alike_in_both_ways(spark):
    rng = random.Random(6)
    names = ["FREQ", "COUNT", "INTERVAL", "UNTIL", "BYDAY", "BYMONTH", "BYMONTHDAY", "BYHOUR", "BYSECOND", "BYWEEKNO", "BYSETPOS", "WKST", "RSCALE", "SKIP", "X-P", "freq"]
    values = ["DAILY", "yearly", "1", "0", "-1", "+2", " 3 ", "60", "24", "13", "5L", "1,2,-3", "MO", "2TU,-1fr", "54MO", "20200101", "20200230", "20200101T000000Z", "", "HEBREW", "OMIT", "a=b", "1,,2", "007", "-0"]
    texts = [";".join(f"{rng.choice(names)}={rng.choice(values)}" for _ in range(rng.randrange(1, 4))) for _ in range(1500)]
    texts += ["FREQ=DAILY;" + t for t in texts] + ["", ";", "FREQ", "FREQ=DAILY;", "FREQ=DAILY;;", "FREQ=DAILY;COUNT=2;SKIP=OMIT;RSCALE=CHINESE"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", columns.is_rule(F.col("t")).alias("ok")).collect():
        try:
            parse_rule(r.t)
            want = True
        except ValueError:
            want = False
        assert r.ok == want, r.t


def test_long_series_of_other_calendars(spark):
    """A series has what it has alone, whatever stands beside it, and 400 years are no more than 40."""
    rows = [(1, "RSCALE=HEBREW;FREQ=YEARLY;COUNT=400", "20140925"), (2, "RSCALE=ISLAMIC-UMALQURA;FREQ=MONTHLY;COUNT=30", "20230719"), (3, "RSCALE=PERSIAN;FREQ=YEARLY;COUNT=3", "22140321"), (4, "RSCALE=COPTIC;FREQ=MONTHLY;INTERVAL=13;COUNT=3", "00050101")]
    series = spark.createDataFrame(rows, "id int, rule string, dtstart string")
    alone = [tuple(r) for k in (1, 2, 3, 4) for r in expand.expand(series.where(f"id = {k}")).orderBy("seq").collect()]
    assert [tuple(r) for r in expand.expand(series).orderBy("id", "seq").collect()] == alone
    n = {k: sum(r[0] == k for r in alone) for k in (1, 2, 3, 4)}
    assert n == {1: 400, 2: 30, 3: 3, 4: 3}
    months = [r[2] for r in alone if r[0] == 2]
    assert all(29 <= (b - a).days <= 30 for a, b in zip(months, months[1:]))


# New Year's days of other calendars, as their authorities publish them.
NEW_YEARS = {
    "chinese": "1954-02-03 1985-02-20 2000-02-05 2024-02-10 2025-01-29 2026-02-17 2027-02-06 2033-01-31 2034-02-19",
    "hebrew": "2000-09-30 2023-09-16 2024-10-03 2025-09-23 2046-10-01",
    "persian": "1979-03-21 2024-03-20 2025-03-21 2029-03-20",
    "islamic-civil": "2023-07-19 2024-07-08",
    "ethiopic": "2007-09-12 2023-09-12 2024-09-11",
    "indian": "2023-03-22 2024-03-21",
}


@pytest.mark.parametrize("name", NEW_YEARS)
def test_new_years_of_other_calendars(name):
    own = calendars.by_rule(name)
    for day in NEW_YEARS[name].split():
        number = date.fromisoformat(day).toordinal()
        assert own.first(own.year_of(number)) == number and own.year_of(number - 1) == own.year_of(number) - 1


@pytest.mark.parametrize("name", calendars.BY_RULE)
def test_years_of_calendars_follow_each_other(name):
    own = calendars.by_rule(name)
    year = own.year_of(date(1890, 6, 1).toordinal())
    for y in range(year, year + 300):
        slots, after = own.months(y), own.months(y + 1)
        assert all(a.first + a.days == b.first for a, b in zip(slots, [*slots[1:], after[0]]))
        assert all(s.days in (29, 30, 31, 28, 5, 6) for s in slots) and len({(s.number, s.leap) for s in slots}) == len(slots)


def test_a_leap_month_follows_the_sun():
    own = calendars.by_rule("chinese")
    leap = {y: s.number for y in range(2017, 2034) for s in own.months(own.year_of(date(y, 6, 1).toordinal())) if s.leap}
    assert leap == {2017: 6, 2020: 4, 2023: 2, 2025: 6, 2028: 5, 2031: 3, 2033: 11}


def test_expansion_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "FREQ=MONTHLY;BYDAY=1MO;COUNT=3", "20260101"), (2, "RSCALE=HEBREW;FREQ=YEARLY;COUNT=2", "20140925"), (3, "FREQ=DAILY;COUNT=2", "20260101T100000")], "id int, rule string, dtstart string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, rule string, dtstart string").parquet(str(tmp_path / "in"))
    run = expand.expand(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.id: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("id").count().collect()} == {1: 3, 2: 2, 3: 2}


def test_errors_missing_parts_and_calendars(spark):
    rows = [(1, "FREQ=DAILY;COUNT=x", "20200101"), (2, None, "20200101T100000"), (3, "FREQ=DAILY", None), (4, "FREQ=DAILY", "nonsense"), (5, "RSCALE=HEBREW;FREQ=YEARLY;COUNT=3", "20140925"), (6, "RSCALE=KLINGON;FREQ=YEARLY", "20140925"), (7, "RSCALE=CHINESE;FREQ=YEARLY;UNTIL=20180101", "20130210")]
    got = {}
    for r in expand.expand(spark.createDataFrame(rows, "id int, rule string, dtstart string")).collect():
        got.setdefault(r.id, []).append((r.wall and r.wall.strftime("%Y%m%d"), r.rule_error))
    assert got[1][0][0] is None and got[1][0][1] and got[2] == [("20200101", None)] and 3 not in got and got[4][0][1] and "RSCALE" in got[6][0][1]
    assert sorted(x for x, _ in got[5]) == ["20140925", "20150914", "20161003"]
    assert sorted(x for x, _ in got[7]) == ["20130210", "20140131", "20150219", "20160208", "20170128"]
