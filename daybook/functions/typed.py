"""Typed values of properties as columns, in the JVM: a value's text becomes a struct with what its type calls for, and goes
back to text; null where the text isn't of its type.

The struct has a `kind` (text, structured, date, date-time, time, duration, period, recur, integer, float, boolean, binary,
uri, cal-address, utc-offset, unknown) and these fields, of which a kind fills its own and leaves the others null:

- texts: TEXT values, unescaped; the one text of a uri, cal-address, unknown value or rule; durations and periods in
  canonical form
- fields: of structured values, each a list
- times: struct(wall, is_date, utc, leap_second) of dates and date-times
- clocks: struct(hour, minute, second, utc) of times of day
- seconds: of durations and offsets from UTC
- periods: struct(start, end, seconds, by_duration), start and end as in times
- integers, floats, flag, bytes
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions import columns, text
from daybook.functions.columns import bind

TIME = "struct<wall:timestamp_ntz,is_date:boolean,utc:boolean,leap_second:boolean>"
FIELDS = {
    "texts": "array<string>",
    "fields": "array<array<string>>",
    "times": f"array<{TIME}>",
    "clocks": "array<struct<hour:int,minute:int,second:int,utc:boolean>>",
    "seconds": "array<bigint>",
    "periods": f"array<struct<start:{TIME},end:{TIME},seconds:bigint,by_duration:boolean>>",
    "integers": "array<bigint>",
    "floats": "array<double>",
    "flag": "boolean",
    "bytes": "binary",
}
TYPED = "struct<" + ",".join(["kind:string", *(f"{n}:{t}" for n, t in FIELDS.items())]) + ">"


_NULLS: dict[tuple[int, str], Column] = {}


def _null(name: str) -> Column:
    """A null of a field's type, made once for a JVM: making columns is most of what typing costs on the driver."""
    key = (id(SparkContext._gateway), name)
    if key not in _NULLS:
        _NULLS[key] = F.lit(None).cast(FIELDS[name]).alias(name)
    return _NULLS[key]


def _struct(kind: str, **given: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), *(given[n].cast(t).alias(n) if n in given else _null(n) for n, t in FIELDS.items()))


def _all(items: Column, read) -> Column:
    """Every item as `read` has it; null if one can't be read."""
    made = F.transform(items, read)
    return F.get(F.transform(F.array(made), lambda m: F.when(F.forall(m, lambda x: x.isNotNull()), m)), 0)


def _if(items: Column, kind: str, **given: Column) -> Column:
    return F.when(items.isNotNull(), _struct(kind, **given))


def duration_text(value: Column) -> Column:
    """A duration in canonical form: units that aren't zero, weeks kept as weeks."""
    up = F.upper(value)
    days, times = F.substring_index(up, "T", 1), F.when(up.contains("T"), F.substring_index(up, "T", -1)).otherwise("")

    def unit(part: Column, letter: str) -> Column:
        found = F.regexp_extract_all(part, F.lit(rf"(\d+){letter}"), F.lit(1))
        n = F.regexp_replace(F.coalesce(F.get(found, F.size(found) - 1), F.lit("")), "^0+", "")
        return F.when(n != "", F.concat(n, F.lit(letter))).otherwise("")

    date = F.concat(unit(days, "W"), unit(days, "D"))
    time = F.concat(unit(times, "H"), unit(times, "M"), unit(times, "S"))
    body = F.concat(date, F.when(time != "", F.concat(F.lit("T"), time)).otherwise(F.when(date == "", "T0S").otherwise("")))
    return F.when(columns.parse_duration(value).isNotNull(), F.concat(F.when(value.startswith("-"), "-").otherwise(""), F.lit("P"), body))


def time_text(t: Column) -> Column:
    """A date or date-time of wire text from struct(wall, is_date, utc, leap_second)."""
    stamp = columns.format_datetime(t["wall"])
    timed = F.concat(F.when(t["leap_second"], F.concat(F.substring(stamp, 1, 13), F.lit("60"))).otherwise(stamp), F.when(t["utc"], "Z").otherwise(""))
    return F.when(t["is_date"], columns.format_date(t["wall"])).otherwise(timed)


def _period(value: Column) -> Column:
    second = F.substring_index(value, "/", -1)
    by = second.rlike(r"\A[Pp+-]")

    def made(x: Column) -> Column:
        start, end, seconds = x["start"], x["end"], x["seconds"]
        last = F.when(by, columns.add_seconds(start["wall"], seconds)).otherwise(end["wall"])
        length = F.when(by, seconds).otherwise(columns.seconds_between(start["wall"], end["wall"]))
        ends = F.struct(last.alias("wall"), F.lit(False).alias("is_date"), F.when(by, start["utc"]).otherwise(end["utc"]).alias("utc"), F.when(by, False).otherwise(end["leap_second"]).alias("leap_second"))
        sound = (F.size(F.split(value, "/", -1)) == 2) & start.isNotNull() & ~start["is_date"] & F.when(by, seconds.isNotNull()).otherwise(end.isNotNull() & ~end["is_date"])
        return F.when(sound, F.struct(start.alias("start"), ends.alias("end"), length.alias("seconds"), by.alias("by_duration"), F.when(by, duration_text(second)).alias("length")))

    return bind(F.struct(columns.parse_datetime(F.substring_index(value, "/", 1)).alias("start"), columns.parse_datetime(second).alias("end"), columns.parse_duration(second).alias("seconds")), made)


def parse_value(value: Column, vtype: Column, multiplicity: Column) -> Column:
    """The struct of a value's text; null where it isn't of its type."""
    single = multiplicity == "single"
    parts = F.when(single, F.array(value)).otherwise(text.split_unescaped(value, ","))
    items = F.transform(parts, lambda x: F.trim(x))
    structured = multiplicity.startswith("structured")
    semis = text.split_unescaped(value, ";")
    listed = multiplicity == "list"
    texts = F.transform(F.when(listed, text.split_unescaped(value, ",")).otherwise(F.array(value)), text.unescape_text)
    fields = F.transform(semis, lambda f: F.transform(F.when(multiplicity == "structured-lists", text.split_unescaped(f, ",")).otherwise(F.array(f)), text.unescape_text))
    date = lambda x: F.when(x.rlike(r"\A\d{8}\z"), columns.parse_datetime(x))
    number = lambda x: F.when(x.rlike(r"\A[+-]?\d+\z"), x.try_cast("bigint"))
    real = lambda x: bind(F.when(F.trim(x).rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), F.trim(x).try_cast("double")), lambda f: F.when(F.abs(f) < F.lit(float("inf")), f))
    one = lambda made, kind, field: bind(made, lambda m: _if(m, kind, **{field: m}))
    periods = bind(_all(items, _period), lambda m: _if(m, "period", periods=F.transform(m, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["seconds"].alias("seconds"), p["by_duration"].alias("by_duration"))), texts=F.transform(m, lambda p: F.concat(time_text(p["start"]), F.lit("/"), F.coalesce(p["length"], time_text(p["end"]))))))
    durations = bind(_all(items, columns.parse_duration), lambda m: _if(m, "duration", seconds=m, texts=F.transform(items, duration_text)))
    floats = F.when(structured, semis).when(listed, text.split_unescaped(value, ",")).otherwise(F.array(value))
    flag = F.upper(F.trim(value))
    partial = columns.parse_datetime(F.trim(value))
    offset = columns.parse_offset(F.trim(value))
    return F.when(
        value.isNotNull(),
        F.when(vtype.isin("text", "phone-number", "vcard"), F.when(structured, _struct("structured", fields=fields)).otherwise(_struct("text", texts=texts)))
        .when(vtype.isin("date-time", "timestamp"), one(_all(items, columns.parse_datetime), "date-time", "times"))
        .when(vtype == "date", one(_all(items, date), "date", "times"))
        .when(vtype == "time", one(_all(items, columns.parse_time), "time", "clocks"))
        .when(vtype == "duration", durations)
        .when(vtype == "period", periods)
        .when(vtype == "recur", F.when(columns.is_rule(F.trim(value)), _struct("recur", texts=F.array(F.trim(value)))))
        .when(vtype == "integer", one(_all(items, number), "integer", "integers"))
        .when(vtype == "float", one(_all(floats, real), "float", "floats"))
        .when(vtype == "boolean", F.when(flag.isin("TRUE", "FALSE"), _struct("boolean", flag=flag == "TRUE")))
        .when(vtype == "binary", bind(columns.decode_base64(value), lambda b: _if(b, "binary", bytes=b)))
        .when(vtype == "uri", _struct("uri", texts=F.array(text.unescape_text(value))))
        .when(vtype == "cal-address", _struct("cal-address", texts=F.array(text.unescape_text(value))))
        .when(vtype == "utc-offset", F.when(offset.isNotNull(), _struct("utc-offset", seconds=F.array(offset))))
        .when(vtype == "language-tag", _struct("text", texts=F.array(value)))
        .when(vtype == "date-and-or-time", F.when(partial.isNotNull(), _struct("date-time", times=F.array(partial))).otherwise(_struct("text", texts=F.array(value))))
        .otherwise(_struct("unknown", texts=F.array(value))),
    )


def format_float(value: Column) -> Column:
    """Whole numbers without a point; others without an exponent."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    plain = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"0+$", "")
    shortest = value.cast("string")
    return F.when(whole, value.cast("bigint").cast("string")).when(shortest.contains("E"), F.regexp_replace(plain, r"\.$", "")).otherwise(shortest)


def serialize_value(typed: Column) -> Column:
    """Wire text of a value from its struct, escaped as its kind needs."""
    kind = typed["kind"]
    joined = lambda items, read, by=",": F.array_join(F.transform(items, read), by)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return (
        F.when(kind == "text", joined(typed["texts"], text.escape_text))
        .when(kind == "structured", joined(typed["fields"], lambda f: joined(f, text.escape_text), ";"))
        .when(kind.isin("date", "date-time"), joined(typed["times"], time_text))
        .when(kind == "time", joined(typed["clocks"], lambda t: F.concat(two(t["hour"]), two(t["minute"]), two(t["second"]), F.when(t["utc"], "Z").otherwise(""))))
        .when(kind == "integer", joined(typed["integers"], lambda n: n.cast("string")))
        .when(kind == "float", joined(typed["floats"], format_float, ";"))
        .when(kind == "boolean", F.when(typed["flag"], "TRUE").otherwise("FALSE"))
        .when(kind == "binary", F.base64(typed["bytes"]))
        .when(kind == "utc-offset", columns.format_offset(F.get(typed["seconds"], 0)))
        .otherwise(F.array_join(typed["texts"], ","))
    )


def instants(typed: Column, zone: Column) -> Column:
    """The native side of times: the instant in UTC of each time of a date or date-time, and of each period's start; null for
    dates and for times without a zone that the host knows. zone: such a zone, or null."""
    at = lambda t: F.when(t["is_date"], None).when(t["utc"], t["wall"]).when(zone.isNotNull(), F.convert_timezone(zone, F.lit("UTC"), t["wall"]))
    return F.when(typed["times"].isNotNull(), F.transform(typed["times"], at)).when(typed["periods"].isNotNull(), F.transform(typed["periods"], lambda p: at(p["start"])))
