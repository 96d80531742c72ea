"""Recurrence expansion: series (rule text, start text) to occurrences.

Three ways lead to the same rows, and each series takes the first that fits. All are columns of one projection, an array of
instants that is exploded: the input is read once, nothing is shuffled, and no row depends on another, so a stream is
expanded as a table is.

1. Rules that only count steps of a fixed length (DAILY, WEEKLY, HOURLY, MINUTELY, SECONDLY without BY parts) are a
   `sequence`, in the JVM.
2. WEEKLY, MONTHLY and YEARLY rules (and DAILY ones with BYDAY) on days of the week, month or year, with or without BYSETPOS,
   of which every period is sure to have a day: how many periods are needed is known beforehand, their days are made by
   arithmetic on day numbers in an array, in the JVM.
3. All others (other calendars, several times a day, periods that may be empty) are resolved series by series in Arrow
   batches, and only as many instants are made as are kept. Only their rule and start go to Python, for others nulls.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions import columns
from daybook.functions.calendars import Slot, by_rule, of_table
from daybook.functions.recurrence import LIMIT, MAX_EMPTY, MAX_YEARS, parse_instant, parse_rule, plan
from daybook.functions.values import json_recur
from daybook.operators import views

EPOCH = 719163  # the day 1970-01-01
ONE = r"(?:FREQ=(?:DAILY|WEEKLY|HOURLY|MINUTELY|SECONDLY)|COUNT=\d{1,9}|INTERVAL=[1-9]\d{0,6}|WKST=(?:MO|TU|WE|TH|FR|SA|SU)|UNTIL=\d{8}(?:T\d{6}Z?)?)"
FAST = rf"\A{ONE}(?:;{ONE})*;?\z"
UNITS = {"DAILY": 86400, "WEEKLY": 604800, "HOURLY": 3600, "MINUTELY": 60, "SECONDLY": 1}
DAY_NAMES = "(?:MO|TU|WE|TH|FR|SA|SU)"
TO_31, TO_12, TO_53 = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[1-4][0-9]|5[0-3])"
TO_366 = "(?:0{0,2}[1-9]|0?[1-9][0-9]|[12][0-9][0-9]|3[0-5][0-9]|36[0-6])"


def _listed(item: str) -> str:
    return f"{item}(?:,{item})*"


PERIODIC_PART = "|".join([
    "FREQ=(?:DAILY|WEEKLY|MONTHLY|YEARLY)", r"COUNT=\d{1,9}", r"INTERVAL=[1-9]\d{0,3}", f"WKST={DAY_NAMES}", r"UNTIL=\d{8}(?:T\d{6}Z?)?",
    "BYDAY=" + _listed(f"(?:[+-]?{TO_53})?{DAY_NAMES}"), "BYMONTHDAY=" + _listed(f"[+-]?{TO_31}"), "BYMONTH=" + _listed(TO_12),
    "BYYEARDAY=" + _listed(f"[+-]?{TO_366}"), "BYSETPOS=" + _listed(f"[+-]?{TO_366}"),
])
PERIODIC = rf"\A(?:{PERIODIC_PART})(?:;(?:{PERIODIC_PART}))*;?\z"
PART_NAMES = ("FREQ", "COUNT", "INTERVAL", "WKST", "UNTIL", "BYDAY", "BYMONTHDAY", "BYMONTH", "BYYEARDAY", "BYSETPOS")


def _part(rule: Column, name: str) -> Column:
    found = F.regexp_extract(rule, rf"(?:\A|;){name}=([^;]*)", 1)
    return F.when(found != "", found)


FOUND = "walls array<bigint>, is_date boolean, utc boolean, error string"


def _slow(rule: Column, start: Column, tables: dict[str, dict[int, list[Slot]]], limit: int, max_years: int, max_empty: int) -> Column:
    """Way 3: a struct of FOUND; null without a start."""

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        calendars = {name: of_table(years, by_rule("islamic-civil")) for name, years in tables.items()}
        for rules, starts in batches:
            walls, heads, dates, utcs, errors, present = [], [0], [], [], [], []
            for text, begin in zip(rules.to_pylist(), starts.to_pylist(), strict=True):
                date, utc, error, size = None, None, None, len(walls)
                if begin is not None:
                    try:
                        day, second, utc = parse_instant(begin)
                        date = second is None
                        instants = iter([(day, second or 0)])
                        if text is not None:
                            instants = plan(parse_rule(text), (day, second, utc), calendars, max_years, max_empty).instants()
                        walls += [(d - EPOCH) * 86400 + x for d, x in islice(instants, limit)]
                    except ValueError as e:
                        error = str(e)
                        del walls[size:]
                heads.append(len(walls))
                for column, x in ((dates, date), (utcs, utc), (errors, error), (present, begin is not None)):
                    column.append(x)
            lists = pa.ListArray.from_arrays(pa.array(heads, pa.int32()), pa.array(walls, pa.int64()))
            fields = [lists, pa.array(dates, pa.bool_()), pa.array(utcs, pa.bool_()), pa.array(errors, pa.string())]
            yield pa.StructArray.from_arrays(fields, ["walls", "is_date", "utc", "error"], mask=pa.array([not p for p in present], pa.bool_()))

    return run(rule, start)


def _steps(limit: int, max_years: int) -> Column:
    """Way 1: steps of one length; the last year that may be reached bounds them as elsewhere."""
    rule = F.col("__up")
    unit = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[_part(rule, "FREQ")]
    step = unit * F.coalesce(_part(rule, "INTERVAL").cast("bigint"), F.lit(1))
    zero = columns.epoch(F.col("__wall"))
    last = F.make_date(F.least(F.year("__wall") + max_years, F.lit(9999)), F.lit(12), F.lit(31))
    stop = columns.epoch(F.col("__until")) + F.when(F.col("__until_date"), 86399).otherwise(0)
    end = F.least(F.unix_date(last).cast("bigint") * 86400 + 86399, F.coalesce(stop, F.lit(1 << 60)))
    most = F.least(F.coalesce(_part(rule, "COUNT").cast("bigint"), F.lit(limit)), F.lit(limit), F.floor((end - zero) / step) + 1)
    n = F.struct(zero.alias("zero"), step.alias("step"), most.alias("most"))
    made = lambda x: F.when(x["most"] > 0, F.sequence(x["zero"], x["zero"] + (x["most"] - 1) * x["step"], x["step"])).otherwise(F.array().cast("array<bigint>"))
    return F.struct(F.get(F.transform(F.array(n), made), 0).alias("walls"), F.col("__is_date").alias("is_date"), F.col("__utc").alias("utc"), F.lit(None).cast("string").alias("error"))


def _once(rule: Column) -> Column:
    """No part stands twice, and not both an end and a count."""
    return ~rule.rlike(r"(?:\A|;)([A-Z]+)=[^;]*;(?:.*;)?\1=") & ~(rule.contains("UNTIL=") & rule.contains("COUNT="))


def _prepared(series: DataFrame, rule: str, start: str) -> DataFrame:
    """series' other columns and, each worked out once: __rule and __start as given, __up (the rule in upper case), the parsed
    start and end of the rule, __usable (ways 1 and 2 may take it, if its parts fit), __fast (way 1 takes it)."""
    kept = [F.col(f"`{c}`") for c in series.columns if c not in (rule, start)]
    rows = series.select(*kept, F.inline(F.array(F.struct(F.col(f"`{rule}`").cast("string").alias("__rule"), F.col(f"`{start}`").cast("string").alias("__start")))))
    dated = columns.spread(rows, columns.parse_datetime(F.col("__start")), "__wall", "__is_date", "__utc", "__leap")
    ended = columns.spread(dated, columns.parse_datetime(_part(F.upper("__rule"), "UNTIL")), "__until", "__until_date", "__until_utc", "__until_leap")
    read = columns.step(ended.drop("__until_utc", "__until_leap"), __up=F.upper("__rule"))
    up = F.col("__up")
    usable = _once(up) & (~up.contains("UNTIL=") | F.col("__until").isNotNull()) & ~F.col("__leap") & F.col("__wall").isNotNull()
    fits = up.rlike(r"(\A|;)FREQ=(DAILY|WEEKLY)(;|\z)") | (~F.col("__is_date") & up.contains("FREQ="))
    checked = columns.step(read, __usable=F.coalesce(usable, F.lit(False)))
    return columns.step(checked, __fast=F.coalesce(F.col("__usable") & fits & up.rlike(FAST), F.lit(False)))


# Day numbers of this part count from 1970-01-01, a Thursday.


def _weekday(day: Column) -> Column:
    return F.pmod(day + 3, F.lit(7))


def _month_start(index: Column) -> Column:
    """The first day of a month that is numbered from year 0."""
    return F.unix_date(F.make_date(F.floor(index / 12).cast("int"), F.pmod(index, F.lit(12)).cast("int") + 1, F.lit(1)))


def _numbers(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: x.cast("int"))


def _read(rows: DataFrame, limit: int, max_years: int) -> DataFrame:
    """rows with `s`, a struct of what a periodic rule says, by one pass over its text; null where way 2 doesn't fit."""
    rule = F.col("__up")
    text = {n: _part(rule, n) for n in PART_NAMES}
    number = F.create_map(*(F.lit(x) for k, d in enumerate(("MO", "TU", "WE", "TH", "FR", "SA", "SU")) for x in (d, k)))
    days = F.transform(F.split(text["BYDAY"], ","), lambda x: F.struct(F.regexp_extract(x, r"^[+-]?\d+", 0).try_cast("int").alias("n"), F.element_at(number, F.right(x, F.lit(2))).alias("w")))
    by = rule.contains("BY") | rule.rlike(r"(\A|;)FREQ=(MONTHLY|YEARLY)(;|\z)")
    sound = F.col("__usable") & ~F.col("__fast") & by & rule.rlike(PERIODIC)
    read = F.struct(
        text["FREQ"].alias("freq"), F.coalesce(text["INTERVAL"].cast("int"), F.lit(1)).alias("step"), F.coalesce(F.least(text["COUNT"].cast("int"), F.lit(limit)), F.lit(limit)).alias("most"),
        F.element_at(number, F.coalesce(text["WKST"], F.lit("MO"))).alias("wkst"),
        days.alias("days"), _numbers(text["BYMONTHDAY"]).alias("month_days"), F.array_distinct(_numbers(text["BYMONTH"])).alias("months"), _numbers(text["BYYEARDAY"]).alias("year_days"),
        _numbers(text["BYSETPOS"]).alias("places"),
    )
    once = columns.step(rows, r=F.when(F.coalesce(sound, F.lit(False)), read))
    r = lambda n: F.col(f"r.{n}")
    wall, until = F.col("__wall"), F.col("__until")
    day, second = F.unix_date(wall.cast("date")), F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)
    year, month, dom = F.year(wall), F.month(wall), F.dayofmonth(wall)
    weekly = r("freq").isin("DAILY", "WEEKLY")
    offset = lambda d: F.pmod(d["w"] - F.when(r("freq") == "WEEKLY", r("wkst")).otherwise(0), F.lit(7))
    week = F.sort_array(F.array_distinct(F.coalesce(F.transform(r("days"), offset), F.array(F.pmod(_weekday(day) - r("wkst"), F.lit(7))))))
    until_day = F.unix_date(until.cast("date")) - F.when(F.col("__until_date") | (F.hour(until) * 3600 + F.minute(until) * 60 + F.second(until) >= second), 0).otherwise(1)
    last_year = F.least(year + max_years, F.lit(9999))
    last = F.least(F.unix_date(F.make_date(last_year, F.lit(12), F.lit(31))), until_day)
    base = F.when(weekly, day - F.when(r("freq") == "WEEKLY", F.pmod(_weekday(day) - r("wkst"), F.lit(7))).otherwise(F.pmod(_weekday(day), F.lit(7)))).when(r("freq") == "MONTHLY", year * 12 + month - 1).otherwise(year)
    numbers = F.when(r("year_days").isNotNull(), r("year_days")).when(r("days").isNull(), F.coalesce(r("month_days"), F.array(dom)))
    months = F.when(r("freq") == "YEARLY", F.when(r("days").isNull() & r("year_days").isNull(), F.coalesce(r("months"), F.array(month))).otherwise(r("months")))
    # days that every period is sure to have, and whether it is sure to have one at all
    plain = F.size(F.array_distinct(F.transform(F.filter(r("days"), lambda d: d["n"].isNull()), lambda d: d["w"])))
    whole_year = (r("freq") == "YEARLY") & months.isNull()
    near = F.when(whole_year, 52).otherwise(4)
    spans = F.when(months.isNull(), 1).otherwise(F.size(months))
    by_day = F.when(plain > 0, plain * near * spans).when(F.exists(r("days"), lambda d: F.abs(d["n"]) <= near), 1).otherwise(0)
    by_number = F.when(r("year_days").isNotNull(), F.exists(r("year_days"), lambda n: F.abs(n) <= 365)).when(r("month_days").isNotNull(), F.exists(r("month_days"), lambda n: F.abs(n) <= 28)).otherwise((dom <= 28) | ((r("freq") == "YEARLY") & r("months").isNull() & ~((month == 2) & (dom == 29))))
    sure = F.when(weekly, F.size(week)).when(r("days").isNotNull(), by_day).otherwise(by_number.cast("int"))
    sure = F.when(r("places").isNull(), sure).otherwise(F.exists(r("places"), lambda p: F.abs(p) <= sure).cast("int"))
    nothing = lambda *names: F.forall(F.array(*(r(n).isNull() for n in names)), lambda x: x)
    fits = (
        F.when(r("freq") == "DAILY", (r("step") == 1) & r("days").isNotNull() & nothing("months", "month_days", "year_days", "places"))
        .when(r("freq") == "WEEKLY", nothing("months", "month_days", "year_days"))
        .when(r("freq") == "MONTHLY", nothing("months", "year_days") & (r("days").isNull() | r("month_days").isNull()))
        .otherwise(F.when(r("year_days").isNotNull(), nothing("days", "month_days", "months")).otherwise(r("days").isNull() | r("month_days").isNull()))
    )
    unit = F.when(weekly, 7 * F.when(r("freq") == "WEEKLY", r("step")).otherwise(1)).otherwise(r("step"))
    end = F.when(weekly, last).when(r("freq") == "MONTHLY", F.year(F.date_from_unix_date(last)) * 12 + F.month(F.date_from_unix_date(last)) - 1).otherwise(F.year(F.date_from_unix_date(last)))
    periods = F.least(F.ceil(r("most") / F.greatest(sure, F.lit(1))) + 1, F.floor((end - base) / unit) + 1)
    s = F.when(
        F.col("r").isNotNull() & fits & (sure > 0),
        F.struct(
            r("freq").alias("freq"), weekly.alias("weekly"), base.alias("base"), unit.alias("unit"), week.alias("week"), months.alias("months"), numbers.alias("numbers"), r("days").alias("days"), r("places").alias("places"),
            day.alias("day"), second.alias("second"), last.alias("last"), r("most").alias("most"), periods.cast("int").alias("periods"), F.col("__is_date").alias("is_date"), F.col("__utc").alias("utc"),
        ),
    )
    return columns.step(once, s=s).drop("r")


def _days_of(span: Column, numbers: Column, days: Column) -> Column:
    """Day numbers that a rule's numbers or weekdays choose in a span (from, before)."""
    first, after = span["a"], span["b"]
    inside = lambda x: (x >= first) & (x < after)
    counted = F.filter(F.transform(numbers, lambda n: F.when(n > 0, first + n - 1).otherwise(after + n)), inside)

    def weekdays(d: Column) -> Column:
        head, tail = first + F.pmod(d["w"] - _weekday(first), F.lit(7)), after - 1 - F.pmod(_weekday(after - 1) - d["w"], F.lit(7))
        one = F.when(d["n"] > 0, head + 7 * (d["n"] - 1)).otherwise(tail + 7 * (d["n"] + 1))
        return F.when(d["n"].isNull(), F.sequence(head, tail, F.lit(7))).otherwise(F.filter(F.array(one), inside))

    return F.when(numbers.isNotNull(), counted).otherwise(F.flatten(F.transform(days, weekdays)))


def _periodic() -> Column:
    """Way 2, from the column `s`."""
    s = lambda n: F.col(f"s.{n}")
    span = lambda a, b: F.struct(_month_start(a).alias("a"), _month_start(b).alias("b"))

    def days(k: Column) -> Column:
        at = s("base") + k * s("unit")
        spans = (
            F.when(s("freq") == "MONTHLY", F.array(span(at, at + 1)))
            .when(s("months").isNull(), F.array(span(at * 12, at * 12 + 12)))
            .otherwise(F.transform(s("months"), lambda m: span(at * 12 + m - 1, at * 12 + m)))
        )
        found = F.sort_array(F.array_distinct(F.flatten(F.transform(spans, lambda x: _days_of(x, s("numbers"), s("days"))))))
        return F.when(s("weekly"), F.transform(s("week"), lambda o: at + o)).otherwise(found)

    def placed(found: Column) -> Column:
        n = F.size(found)
        index = lambda p: F.when(p > 0, p - 1).otherwise(n + p)
        own = F.filter(F.transform(s("places"), index), lambda i: (i >= 0) & (i < n))
        return F.when(s("places").isNull(), found).otherwise(F.transform(F.sort_array(F.array_distinct(own)), lambda i: F.get(found, i)))

    # the inner array of one binds a period's days, which its positions refer to
    every = F.flatten(F.transform(F.sequence(F.lit(0), s("periods") - 1), lambda k: F.get(F.transform(F.array(days(k)), placed), 0)))
    chosen = F.slice(F.filter(every, lambda x: (x >= s("day")) & (x <= s("last"))), F.lit(1), s("most"))
    walls = F.when((s("periods") > 0) & (s("most") > 0), F.transform(chosen, lambda x: x.cast("bigint") * 86400 + s("second"))).otherwise(F.array().cast("array<bigint>"))
    return F.struct(walls.alias("walls"), s("is_date").alias("is_date"), s("utc").alias("utc"), F.lit(None).cast("string").alias("error"))


def ways(series: DataFrame, rule: str = "rule", start: str = "dtstart") -> DataFrame:
    """series' other columns with `way`: 1, 2 or 3, as above."""
    read = _read(_prepared(series, rule, start), LIMIT, MAX_YEARS)
    return read.select(*(F.col(f"`{c}`") for c in series.columns if c not in (rule, start)), F.when(F.col("__fast"), 1).when(F.col("s").isNotNull(), 2).otherwise(3).alias("way"))


def expand(series: DataFrame, rule: str = "rule", start: str = "dtstart", limit: int = LIMIT, max_years: int = MAX_YEARS, max_empty: int = MAX_EMPTY) -> DataFrame:
    """series' other columns with seq, wall, is_date, utc for each of the first `limit` occurrences. A series without a rule
    occurs once, one without a start never; a rule that isn't one gives a row with rule_error."""
    kept = [c for c in series.columns if c not in (rule, start)]
    read = _read(_prepared(series, rule, start), limit, max_years)
    left = ~F.col("__fast") & F.col("s").isNull()
    slow = _slow(F.when(left, F.col("__rule")), F.when(left, F.col("__start")), library_tables(), limit, max_years, max_empty)
    found = F.when(F.col("__fast"), _steps(limit, max_years)).when(F.col("s").isNotNull(), _periodic()).otherwise(F.col("__slow"))
    made = columns.step(read.withColumn("__slow", slow), __f=found).select(*(F.col(f"`{c}`") for c in kept), "__f")
    walls = F.when(F.col("__f.error").isNotNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.col("__f.walls"))
    each = made.select("*", F.posexplode(walls).alias("__seq", "__wall"))
    fine = lambda c: F.when(F.col("__f.error").isNull(), c)
    return each.select(
        *(F.col(f"`{c}`") for c in kept),
        fine(F.col("__seq").cast("bigint")).alias("seq"),
        columns.from_epoch(F.col("__wall")).alias("wall"),
        fine(F.col("__f.is_date")).alias("is_date"),
        fine(F.col("__f.utc")).alias("utc"),
        F.col("__f.error").alias("rule_error"),
    )


@lru_cache(1)
def _umalqura() -> dict[int, list[Slot]]:
    """Years 1300 to 1600 of the civil table, from the calendar library in the driver's JVM."""
    jvm = SparkSession.getActiveSession()._jvm
    field = jvm.com.ibm.icu.util.Calendar
    calendar = field.getInstance(jvm.com.ibm.icu.util.TimeZone.getTimeZone("UTC"), jvm.com.ibm.icu.util.ULocale("en@calendar=islamic-umalqura"))
    extended, month, day_of_month, out = field.EXTENDED_YEAR, field.MONTH, field.DAY_OF_MONTH, {}
    calendar.clear()
    calendar.set(extended, 1300)
    calendar.set(month, 0)
    calendar.set(day_of_month, 1)
    first = calendar.getTimeInMillis() // 86_400_000 + EPOCH
    for year in range(1300, 1601):
        slots = []
        for k in range(12):
            days = calendar.getActualMaximum(day_of_month)
            slots.append(Slot(k + 1, False, first, days))
            first += days
            calendar.add(month, 1)
        out[year] = slots
    return out


def library_tables() -> dict[str, dict[int, list[Slot]]]:
    """Calendars that are tables, by the library's name: 301 years, read once for each driver, whatever the input."""
    return {"islamic-umalqura": _umalqura()}


def canonical_rules(rows: DataFrame, rule: str = "rule") -> DataFrame:
    """rows with the rule's canonical text, its JSON form, and what is wrong with it."""
    import json

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "canonical string", "json string", "rule_error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text in batch.column(rule).to_pylist():
                try:
                    found = parse_rule(text) if text is not None else None
                    own = (found.text(), json.dumps(json_recur(found), separators=(",", ":")), None) if found else (None, None, None)
                except ValueError as error:
                    own = (None, None, str(error))
                for column, x in zip(out, own, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in out)], [*batch.schema.names, "canonical", "json", "rule_error"])

    return rows.mapInArrow(run, schema)


def localize(occurrences: DataFrame, zone: str | Column, wall: str = "wall") -> DataFrame:
    """occurrences with `instant_utc`: a wall time in a gap has the offset before it, one that occurs twice is the first."""
    z = F.lit(zone) if isinstance(zone, str) else zone
    return occurrences.withColumn("instant_utc", F.when(F.col("utc"), F.col(wall)).otherwise(F.convert_timezone(z, F.lit("UTC"), F.col(wall))))


def rewrite_until(rule: Column, zone: Column) -> Column:
    """A rule whose UNTIL is in UTC, with that instant on the wall clock of a zone."""
    until = F.regexp_extract(rule, r"UNTIL=(\d{8}T\d{6})Z", 1)
    local = F.convert_timezone(F.lit("UTC"), zone, columns.parse_datetime(until)["wall"])
    return F.when(until != "", F.regexp_replace(rule, F.lit(r"UNTIL=\d{8}T\d{6}Z"), F.concat(F.lit("UNTIL="), columns.format_datetime(local)))).otherwise(rule)


def expand_zoned(series: DataFrame, rule: str = "rule", start: str = "dtstart", zone: str = "tzid", limit: int = LIMIT) -> DataFrame:
    """Expansion on the wall clock of each series' zone, then localized; instants are not made unique."""
    rows = series.withColumn(rule, rewrite_until(F.col(rule), F.col(zone)))
    return localize(expand(rows, rule, start, limit), F.col(zone))


def occurrences(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Occurrences of events, to-dos or journals as `views` gives them: the start alone without a rule, none without a start.

    The items' doc_id (or whatever other columns stand beside those of the view), comp_id, seq, wall, is_date, utc, tzid, the
    instant in UTC where the zone is the host's or the start is in UTC, and rule_error. A zone that the host doesn't know
    leaves times on the wall, as a start without a zone does. EXDATE and RDATE are the caller's, see `without` and `along`."""
    rest = [c for c in items.columns if c not in views.ITEM_COLUMNS]
    zone = views.host_zone(F.col("start.tzid"))
    placed = columns.step(items.where("start IS NOT NULL"), tzid=F.col("start.tzid"), __zone=zone)
    local = F.when(F.col("__zone").isNotNull() & ~F.col("start.utc"), rewrite_until(F.col("rrule"), F.col("__zone"))).otherwise(F.col("rrule"))
    series = placed.select(*(F.col(f"`{c}`") for c in rest), "tzid", "__zone", local.alias("__r"), F.col("start_text").alias("__s"))
    found = expand(series, "__r", "__s", limit)
    at = F.when(F.col("utc"), F.col("wall")).when(F.col("__zone").isNotNull() & ~F.col("is_date"), F.convert_timezone(F.col("__zone"), F.lit("UTC"), F.col("wall")))
    return found.withColumn("instant_utc", at).drop("__zone")


def without(occurrences: DataFrame, exceptions: DataFrame, series: list[str]) -> DataFrame:
    """An extension: occurrences but for those that exceptions (series columns, wall) name."""
    return occurrences.join(exceptions.select(*series, "wall"), [*series, "wall"], "left_anti")


def along(occurrences: DataFrame, additions: DataFrame, series: list[str]) -> DataFrame:
    """An extension: occurrences and further dates (series columns, wall), each wall time once."""
    both = occurrences.select(*series, "wall").unionByName(additions.select(*series, "wall"))
    return both.distinct()
