"""Dates, times, offsets, durations and periods of wire text as column expressions: null where a text isn't one.

Wall times are TIMESTAMP_NTZ and all arithmetic on them is without a zone, so nothing here depends on the session's time
zone; a leap second is kept apart (`:60` reads as `:59` with leap_second true).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE, TIME = r"\d{8}", r"(?:[01]\d|2[0-3])[0-5]\d(?:[0-5]\d|60)[Zz]?"
DURATION = r"\A[+-]?[Pp](?=[0-9Tt])(?:\d+[WwDd])*(?:[Tt](?:\d+[HhMmSs])+)?\z"


def _wall(text: Column, hour: Column, minute: Column, second: Column) -> Column:
    """The wall time of eight digits of a date and a time of day; null where there is no such day."""
    part = lambda k, n: F.substring(text, k, n).try_cast("int")
    return F.try_make_timestamp_ntz(part(1, 4), part(5, 2), part(7, 2), hour, minute, second.cast("decimal(16,6)"))


def parse_date(text: Column) -> Column:
    return F.when(text.rlike(r"\A(?!0000)\d{8}\z"), _wall(text, F.lit(0), F.lit(0), F.lit(0)).cast("date"))


def parse_time(text: Column) -> Column:
    """struct(hour, minute, second, utc)."""
    part = lambda k: F.substring(text, k, 2).cast("int")
    return F.when(text.rlike(rf"\A{TIME}\z"), F.struct(part(1).alias("hour"), part(3).alias("minute"), part(5).alias("second"), text.rlike("[Zz]$").alias("utc")))


def parse_datetime(text: Column) -> Column:
    """struct(wall, is_date, utc, leap_second) of a DATE or a DATE-TIME."""
    leap = F.substring(text, 14, 2) == "60"
    part = lambda k: F.coalesce(F.substring(text, k, 2).try_cast("int"), F.lit(0))
    wall = F.when(text.rlike(rf"\A(?!0000){DATE}(?:[Tt]{TIME})?\z"), _wall(text, part(10), part(12), F.when(leap, 59).otherwise(part(14))))
    is_date = F.length(text) == 8
    return F.when(wall.isNotNull(), F.struct(wall.alias("wall"), is_date.alias("is_date"), text.rlike("[Zz]$").alias("utc"), leap.alias("leap_second")))


def parse_offset(text: Column) -> Column:
    """Seconds east of UTC; minus zero isn't an offset."""
    ok = text.rlike(r"\A[+-]\d\d[0-5]\d([0-5]\d)?\z") & ~text.rlike(r"\A-0+\z")
    part = lambda k: F.coalesce(F.substring(text, k, 2).try_cast("int"), F.lit(0))
    seconds = part(2) * 3600 + part(4) * 60 + part(6)
    return F.when(ok, F.when(text.startswith("-"), -seconds).otherwise(seconds))


def parse_duration(text: Column) -> Column:
    """Total seconds. A unit that is repeated counts as it stands last."""

    def unit(part: Column, letter: str) -> Column:
        found = F.regexp_extract_all(part, F.lit(rf"(\d+)[{letter}{letter.lower()}]"), F.lit(1))
        return F.coalesce(F.get(found, F.size(found) - 1).try_cast("bigint"), F.lit(0).cast("bigint"))

    up = F.upper(text)
    days, times = F.substring_index(up, "T", 1), F.when(up.contains("T"), F.substring_index(up, "T", -1)).otherwise("")
    total = unit(days, "W") * 604800 + unit(days, "D") * 86400 + unit(times, "H") * 3600 + unit(times, "M") * 60 + unit(times, "S")
    return F.when(text.rlike(DURATION), F.when(text.startswith("-"), -total).otherwise(total))


def parse_period(text: Column) -> Column:
    """struct(start, end, seconds): a period's end is given or start plus duration."""
    first, second = F.substring_index(text, "/", 1), F.substring_index(text, "/", -1)
    start, end, seconds = parse_datetime(first), parse_datetime(second), parse_duration(second)
    by_duration = second.rlike(r"\A[Pp+-]")
    last = F.when(by_duration, add_seconds(start["wall"], seconds)).otherwise(end["wall"])
    length = F.when(by_duration, seconds).otherwise(seconds_between(start["wall"], end["wall"]))
    ok = F.size(F.split(text, "/", -1)) == 2
    return F.when(ok & start["wall"].isNotNull() & last.isNotNull(), F.struct(start["wall"].alias("start"), last.alias("end"), length.alias("seconds")))


def bind(value: Column, body) -> Column:
    """body(value), with value worked out once however often body refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def step(rows: DataFrame, **made: Column) -> DataFrame:
    """rows with further columns, each worked out once whatever refers to them: an exploded array of one keeps the optimizer
    from writing an expression out wherever its column is used, which multiplies with every such step."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))


def spread(rows: DataFrame, struct: Column, *names: str) -> DataFrame:
    """rows with the fields of a struct as columns, worked out once as by `step`; nulls where the struct is null."""
    return rows.select("*", F.inline(F.array(struct)).alias(*names))


def epoch(wall: Column) -> Column:
    """Seconds since 1970 of a wall time read as if it were UTC."""
    since = wall.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return F.floor(since.cast("interval second").cast("decimal(18,6)")).cast("bigint")


def from_epoch(seconds: Column) -> Column:
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + seconds.cast("bigint") * F.expr("INTERVAL '1' SECOND")


def add_seconds(wall: Column, seconds: Column) -> Column:
    return wall.cast("timestamp_ntz") + seconds.cast("bigint") * F.expr("INTERVAL '1' SECOND")


def seconds_between(start: Column, end: Column) -> Column:
    return epoch(end) - epoch(start)


def shown(wall: Column, length: int = 19) -> Column:
    """The first characters of yyyy-MM-dd HH:mm:ss."""
    return F.substring(wall.cast("timestamp_ntz").cast("string"), 1, length)


def format_date(day: Column) -> Column:
    return F.translate(shown(day, 10), "-", "")


def format_datetime(wall: Column, utc: Column | bool = False) -> Column:
    tail = F.when(F.lit(utc) if isinstance(utc, bool) else utc, "Z").otherwise("")
    return F.concat(F.translate(shown(wall), " -:", "T"), tail)


def format_offset(seconds: Column) -> Column:
    s = F.abs(seconds)
    tail = F.when(s % 60 != 0, F.lpad((s % 60).cast("string"), 2, "0")).otherwise("")
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(F.when(seconds < 0, "-").otherwise("+"), two(s / 3600), two((s / 60) % 60), tail)


def format_duration(seconds: Column) -> Column:
    """Weeks alone, or days and the time, without units of zero."""
    s = F.abs(seconds)
    unit = lambda n, letter: F.when(n > 0, F.concat(n.cast("string"), F.lit(letter))).otherwise("")
    days, hours, minutes, rest = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60
    time = F.concat(unit(hours, "H"), unit(minutes, "M"), unit(rest, "S"))
    body = F.concat(unit(days, "D"), F.when(time != "", F.concat(F.lit("T"), time)).otherwise(""))
    return F.when(s == 0, "PT0S").otherwise(F.concat(F.when(seconds < 0, "-").otherwise(""), F.lit("P"), body))


def _rule_part(name: str) -> str:
    """What a part of a rule may say, its bounds included."""
    days = "(?:MO|TU|WE|TH|FR|SA|SU)"
    to = {"31": "(?:[1-9]|[12][0-9]|3[01])", "53": "(?:[1-9]|[1-4][0-9]|5[0-3])", "366": "(?:[1-9]|[1-9][0-9]|[12][0-9][0-9]|3[0-5][0-9]|36[0-6])"}
    signed = lambda most: rf"\s*[+-]?0*{to[most]}\s*"
    least0 = lambda body: rf"\s*(?:\+?0*{body}|-0+)\s*"
    items = {
        "BYSECOND": least0("(?:[0-5]?[0-9]|60)"), "BYMINUTE": least0("(?:[0-5]?[0-9])"), "BYHOUR": least0("(?:1?[0-9]|2[0-3])"),
        "BYMONTHDAY": signed("31"), "BYYEARDAY": signed("366"), "BYWEEKNO": signed("53"), "BYSETPOS": signed("366"),
        "BYDAY": rf"\s*(?:[+-]?(?:0?[1-9]|[1-4][0-9]|5[0-3]))?{days}\s*", "BYMONTH": r"\s*(?:0?[1-9]|1[0-3])L?\s*",
    }
    if name in items:
        return f"{items[name]}(?:,{items[name]})*"
    return {
        "FREQ": r"\s*(?:SECONDLY|MINUTELY|HOURLY|DAILY|WEEKLY|MONTHLY|YEARLY)\s*",
        "UNTIL": r"\s*\d{8}(?:T(?:[01]\d|2[0-3])[0-5]\d(?:[0-5]\d|60)Z?)?\s*",
        "COUNT": r"\s*\+?\d{1,19}\s*",
        "INTERVAL": r"\s*\+?(?=\d*[1-9])\d{1,19}\s*",
        "WKST": rf"\s*{days}\s*",
        "RSCALE": ".*",
        "SKIP": r"\s*(?:OMIT|BACKWARD|FORWARD)\s*",
    }[name]


RULE_PARTS = ("RSCALE", "FREQ", "UNTIL", "COUNT", "INTERVAL", "BYSECOND", "BYMINUTE", "BYHOUR", "BYDAY", "BYMONTHDAY", "BYYEARDAY", "BYWEEKNO", "BYMONTH", "BYSETPOS", "WKST", "SKIP")


def is_rule(text: Column) -> Column:
    """Whether a text is a recurrence rule: known parts once each and within their bounds, others as they like."""
    up = F.upper(F.regexp_replace(text, r";\z", ""))
    parts = F.split(up, ";", -1)
    name = lambda p: F.trim(F.substring_index(p, "=", 1))
    value = lambda p: F.regexp_replace(p, r"(?s)\A[^=]*=", "")

    def sound(p: Column) -> Column:
        out = F.lit(True)
        for part in RULE_PARTS:
            out = F.when(name(p) == part, value(p).rlike(rf"(?s)\A{_rule_part(part)}\z")).otherwise(out)
        return p.contains("=") & out

    known = F.filter(F.transform(parts, name), lambda n: n.isin(*RULE_PARTS))
    has = lambda n: F.array_contains(known, n)
    until = F.get(F.filter(parts, lambda p: name(p) == "UNTIL"), 0)
    months = F.get(F.filter(parts, lambda p: name(p) == "BYMONTH"), 0)
    real = until.isNull() | parse_datetime(F.trim(value(until))).isNotNull()
    plain_months = months.isNull() | ~value(months).rlike("L|13")
    whole = F.forall(parts, sound) & (F.size(known) == F.size(F.array_distinct(known))) & has("FREQ") & ~(has("UNTIL") & has("COUNT"))
    return F.coalesce(whole & real & (has("RSCALE") | (~has("SKIP") & plain_months)), F.lit(False))


def decode_base64(text: Column) -> Column:
    """Bytes; white space doesn't count, missing padding is filled up, anything else that is off gives null."""
    bare = F.regexp_replace(text, r"[ \t\r\n\f]", "")
    body = F.regexp_replace(bare, "=+$", "")
    ok = bare.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & (F.length(body) % 4 != 1)
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4)).cast("int")))
    return F.when(ok, F.try_to_binary(padded, F.lit("base64")))
