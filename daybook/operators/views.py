"""Navigation and typed views over parsed documents: children by name, first values, events, to-dos, alarms, cards."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions import columns, text, typed
from daybook.functions.registry import column_type as type_of
from daybook.functions.registry import dialect_of
from daybook.functions.columns import bind, step
from daybook.sources.wire import COMPONENT, PARAMS

PARTS = ("components", "properties", "repairs", "error")
COMPONENT_NAMES = [f.split(":")[0] for f in COMPONENT.split(",")]
#: Columns of events, to-dos and journals.
ITEM_COLUMNS = ("uid", "summary", "description", "location", "status", "rrule", "url", "start", "start_text", "start_utc", "end", "end_utc", "due", "duration_seconds", "priority")

# Components that have views.
VIEWS = {"VCALENDAR": "calendar", "VEVENT": "event", "VTODO": "todo", "VJOURNAL": "journal", "VFREEBUSY": "freebusy", "VALARM": "alarm", "VTIMEZONE": "timezone", "VCARD": "card"}


def named(rows: DataFrame, name: str) -> DataFrame:
    """Components or properties of a name, whatever its case."""
    return rows.where(F.col("name_uc") == name.upper())


def first_of(props: Column, name: str) -> Column:
    """The first property of a name in an array of properties in order; null without one."""
    return F.get(F.filter(props, lambda p: p["name_uc"] == name.upper()), 0)


def all_of(props: Column, name: str) -> Column:
    return F.filter(props, lambda p: p["name_uc"] == name.upper())


def param_values(params: Column, name: str) -> Column:
    """All values of parameters of a name: a list in one parameter is the same as several parameters."""
    own = F.filter(params, lambda p: text.ascii_upper(p["name"]) == name.upper())
    return F.flatten(F.transform(own, lambda p: p["values"]))


def param(params: Column, name: str) -> Column:
    """The value of the first parameter of a name, if it has exactly one."""
    values = F.get(F.filter(params, lambda p: text.ascii_upper(p["name"]) == name.upper()), 0)["values"]
    return F.when(F.size(values) == 1, F.get(values, 0))


def with_properties(parsed: DataFrame, kind: str | None = None, more=None, dialects: bool = False, holder: str | None = None) -> DataFrame:
    """One row for each component (of a kind), with its properties in order as an array `props`: no shuffle, as both lie in
    one row. more: columns from a component's struct, by a function; dialects: a column `dialect`, by the component's root;
    holder: of those that lie directly in one of that kind, its columns and `props`, their own properties as `__inner`.

    Properties and a mark for each component are sorted together, so a component's properties are a slice between two marks:
    the work grows with the document, not with the product of its components and properties."""
    rest = [c for c in parsed.columns if c not in PARTS]
    return parsed.select(*(F.col(f"`{c}`") for c in rest), F.inline(_placed(kind, more, dialects, holder)))


def _dialect(root: Column) -> Column:
    return dialect_of(root["name_uc"], first_of(root["props"], "VERSION")["value"])


def _placed(kind: str | None, more=None, dialects: bool = False, holder: str | None = None) -> Column:
    """Components with their properties, as an array of structs."""
    names = ("comp_id", "ordinal", "grp", "name", "name_uc", "params", "value")
    own = F.transform("properties", lambda p: F.struct(*(p[n].alias(n) for n in names)))
    mark = F.transform("components", lambda c: F.struct(c["comp_id"].alias("comp_id"), F.lit(-1).alias("ordinal"), *(F.lit(None).cast(PARAMS if n == "params" else "string").alias(n) for n in names[2:])))
    components = F.sort_array("components")

    def cut(items: Column) -> Column:
        marks = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda k: F.get(items, k)["ordinal"] == -1)

        def each(at: Column) -> Column:
            after = lambda j: F.coalesce(F.get(at, j + 1), F.size(items))
            slice_ = lambda j: F.slice(items, F.get(at, j) + 2, after(j) - F.get(at, j) - 1)
            held = F.transform(components, lambda c, j: F.struct(*(c[n].alias(n) for n in COMPONENT_NAMES), slice_(j).alias("props"), *((x.alias(n) for n, x in more(c).items()) if more else ())))
            if dialects:  # a component's number is its place
                held = bind(held, lambda h: F.transform(h, lambda c: c.withField("dialect", bind(F.get(h, c["root_id"]), _dialect))))
            of_kind = lambda h: h if kind is None else F.filter(h, lambda c: c["name_uc"] == kind)
            if holder is None:
                return of_kind(held)
            pairs = bind(held, lambda h: F.transform(of_kind(h), lambda c: F.get(h, c["parent_id"]).withField("__inner", c["props"])))
            return F.filter(pairs, lambda c: c["name_uc"] == holder)

        return bind(marks, each)

    return F.when(F.size("components") > 0, bind(F.sort_array(F.concat(mark, own)), cut))


@lru_cache(1)
def host_zones() -> str:
    """Names of all zones that Spark's JVM knows, apart by spaces."""
    return SparkSession.getActiveSession()._jvm.java.lang.String.join(" ", SparkSession.getActiveSession()._jvm.java.time.ZoneId.getAvailableZoneIds())


def host_zone(tzid: Column) -> Column:
    """The host's zone of that name, slashes before it aside; null if there is none."""
    bare = F.regexp_replace(tzid, "^/+", "")
    return F.when(F.array_contains(F.split(F.lit(host_zones()), " "), bare), bare)


def text_of(props: Column, name: str, default: Column | str | None = None) -> Column:
    """The first value of a name as text."""
    found = text.unescape_text(first_of(props, name)["value"])
    return found if default is None else F.coalesce(found, F.lit(default) if isinstance(default, str) else default)


def time_of(props: Column, name: str) -> Column:
    """struct(wall, is_date, utc, leap_second, tzid) of the first property of a name."""
    made = lambda p: bind(columns.parse_datetime(F.trim(p["value"])), lambda at: F.when(at.isNotNull(), F.struct(*(at[n].alias(n) for n in ("wall", "is_date", "utc", "leap_second")), param(p["params"], "TZID").alias("tzid"))))
    return bind(first_of(props, name), made)


def duration_of(props: Column) -> Column:
    return bind(F.trim(first_of(props, "DURATION")["value"]), columns.parse_duration)


def with_times(rows: DataFrame, end: str = "DTEND") -> DataFrame:
    """rows (with props) and their times, each worked out once: start, start_text, start_utc, end (the given one; else start
    plus duration; else a day after a date, or the start itself), end_utc, duration_seconds (the given duration; else from
    start to end, if both are of one kind: on one wall clock the difference of wall times, between clocks that of instants,
    unknown where the host doesn't know a zone)."""
    p = F.col("props")
    raw = step(rows, __s=first_of(p, "DTSTART"), __e=first_of(p, end), __d=F.trim(first_of(p, "DURATION")["value"]))
    more = step(raw, __st=F.trim(F.col("__s.value")), __et=F.trim(F.col("__e.value")), __seconds=columns.parse_duration(F.col("__d")), __sz=param(F.col("__s.params"), "TZID"), __ez=param(F.col("__e.params"), "TZID"))
    read = columns.spread(more.drop("__s", "__e", "__d"), columns.parse_datetime(F.col("__st")), "__sw", "__sd", "__su", "__sl")
    read = columns.spread(read, columns.parse_datetime(F.col("__et")), "__ew", "__ed", "__eu", "__el")
    given = F.col("__ew").isNotNull()
    after = F.when(F.col("__sd"), columns.add_seconds(F.col("__sw"), F.lit(86400))).otherwise(F.col("__sw"))
    end_wall = F.coalesce(F.col("__ew"), columns.add_seconds(F.col("__sw"), F.col("__seconds")), after)
    ends = {"__xd": F.when(given, F.col("__ed")).otherwise(F.col("__sd")), "__xu": F.when(given, F.col("__eu")).otherwise(F.col("__su"))}
    known = step(read, end=end_wall, __szone=host_zone(F.col("__sz")), __xzone=host_zone(F.when(given, F.col("__ez")).otherwise(F.col("__sz"))), **ends)
    instant = lambda wall, date, utc, zone: F.when(F.col(date), None).when(F.col(utc), F.col(wall)).when(F.col(zone).isNotNull(), F.convert_timezone(F.col(zone), F.lit("UTC"), F.col(wall)))
    placed = step(known, start_utc=instant("__sw", "__sd", "__su", "__szone"), end_utc=instant("end", "__xd", "__xu", "__xzone"))
    clock = lambda utc, zone, tzid: F.when(F.col(utc), "UTC").otherwise(F.coalesce(F.col(zone), F.col(tzid), F.lit("")))
    same = ~given | F.col("__sd") | (clock("__su", "__szone", "__sz") == clock("__eu", "__xzone", "__ez"))
    wall, elapsed = columns.seconds_between(F.col("__sw"), F.col("end")), columns.seconds_between(F.col("start_utc"), F.col("end_utc"))
    between = F.when(given & (F.col("__sd") != F.col("__ed")), None).when(same, wall).otherwise(elapsed)
    start = F.struct(F.col("__sw").alias("wall"), F.col("__sd").alias("is_date"), F.col("__su").alias("utc"), F.col("__sl").alias("leap_second"), F.col("__sz").alias("tzid"))
    begun = F.col("__sw").isNotNull()
    out = placed.withColumn("duration_seconds", F.coalesce(F.col("__seconds"), between)).withColumn("start_text", F.when(begun, F.col("__st"))).withColumn("start", F.when(begun, start))
    return out.drop("__st", "__et", "__seconds", "__sz", "__ez", "__sw", "__sd", "__su", "__sl", "__ew", "__ed", "__eu", "__el", "__xd", "__xu", "__szone", "__xzone")


def _items(parsed: DataFrame, kind: str) -> DataFrame:
    return with_properties(parsed, kind)


def _texts() -> list[Column]:
    p = F.col("props")
    texts = [text_of(p, n).alias(n.lower()) for n in ("UID", "SUMMARY", "DESCRIPTION", "LOCATION", "STATUS")]
    return [*texts, first_of(p, "RRULE")["value"].alias("rrule"), first_of(p, "URL")["value"].alias("url")]


def _rest(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("props", "name", "name_uc", "ordinal", "depth", "root_id")]


TIMES = ("start", "start_text", "start_utc", "end", "end_utc", "duration_seconds")


def events(parsed: DataFrame) -> DataFrame:
    rows = _items(parsed, "VEVENT")
    return with_times(rows).select(*_rest(rows), *_texts(), *TIMES)


def todos(parsed: DataFrame) -> DataFrame:
    return _todos(_items(parsed, "VTODO"))


def _todos(rows: DataFrame) -> DataFrame:
    priority = F.trim(first_of(F.col("props"), "PRIORITY")["value"]).try_cast("bigint").alias("priority")
    return with_times(rows, "DUE").select(*_rest(rows), *_texts(), *TIMES, F.col("end").alias("due"), priority)


def journals(parsed: DataFrame) -> DataFrame:
    rows = _items(parsed, "VJOURNAL")
    return with_times(rows).select(*_rest(rows), *_texts(), *TIMES[:3])


def freebusy(parsed: DataFrame) -> DataFrame:
    """Busy periods, one row each."""
    rows = _items(parsed, "VFREEBUSY")
    each = rows.select(*_rest(rows), F.explode(F.flatten(F.transform(all_of(F.col("props"), "FREEBUSY"), lambda p: F.transform(F.split(p["value"], ","), lambda v: F.struct(F.coalesce(param(p["params"], "FBTYPE"), F.lit("BUSY")).alias("fbtype"), columns.parse_period(F.trim(v)).alias("period")))))).alias("busy"))
    return each.select(*_rest(rows), "busy.fbtype", "busy.period.*")


def alarms(parsed: DataFrame) -> DataFrame:
    """Alarms with the event or to-do that holds them: trigger_seconds relative to it, or trigger_at."""
    rows = _items(parsed, "VALARM")
    return rows.select(*_rest(rows), *_alarm(F.col("props")))


def _alarm(props: Column) -> list[Column]:
    trigger = F.trim(first_of(props, "TRIGGER")["value"])
    return [first_of(props, "ACTION")["value"].alias("action"), columns.parse_duration(trigger).alias("trigger_seconds"), columns.parse_datetime(trigger)["wall"].alias("trigger_at")]


def todos_with_alarms(parsed: DataFrame) -> DataFrame:
    """One row for each alarm of a to-do, with the columns of both views (comp_id is the to-do's): no join, as both lie in one
    row. A join's sizes would be guessed from the files that documents come from, and whole tables be broadcast."""
    pairs = with_properties(parsed, "VALARM", holder="VTODO")
    return _todos(pairs.select(*(c for c in pairs.columns if c != "__inner"), *_alarm(F.col("__inner"))))


def timezones(parsed: DataFrame) -> DataFrame:
    rows = _items(parsed, "VTIMEZONE")
    return rows.select(*_rest(rows), text_of(F.col("props"), "TZID").alias("tzid"))


def calendars(parsed: DataFrame) -> DataFrame:
    """Calendars that are roots, with how many of each kind they hold directly."""

    def counts(c: Column) -> dict[str, Column]:
        held = lambda kind: F.when((c["name_uc"] == "VCALENDAR") & (c["depth"] == 0), F.size(F.filter("components", lambda x: (x["parent_id"] == c["comp_id"]) & (x["name_uc"] == kind))))
        return {f"n_{view}s": held(kind) for kind, view in (("VEVENT", "event"), ("VTODO", "todo"), ("VJOURNAL", "journal"), ("VTIMEZONE", "timezone"))}

    rows = with_properties(parsed, "VCALENDAR", counts).where("depth = 0")
    counted = [c for c in rows.columns if c in ("n_events", "n_todos", "n_journals", "n_timezones")]
    return rows.select(*(c for c in _rest(rows) if c not in counted), *(text_of(F.col("props"), n).alias(n.lower()) for n in ("PRODID", "VERSION", "METHOD")), *counted)


def cards(parsed: DataFrame) -> DataFrame:
    """Cards that are roots: names, and lists of addresses in order."""
    rows = _items(parsed, "VCARD").where("depth = 0")
    p = F.col("props")
    listed = lambda name: F.transform(all_of(p, name), lambda q: text.unescape_text(q["value"]))
    parts = text.split_unescaped(first_of(p, "N")["value"], ";")
    n = F.transform(parts, lambda f: F.transform(text.split_unescaped(f, ","), text.unescape_text))
    version = text_of(p, "VERSION")
    return rows.select(*_rest(rows), text_of(p, "FN").alias("fn"), version.alias("version"), n.alias("n"), listed("EMAIL").alias("emails"), listed("TEL").alias("tels"), dialect_of(F.lit("VCARD"), version).alias("dialect"))


def values(parsed: DataFrame) -> DataFrame:
    """One row for each property: comp_id, ordinal, grp, name, name_uc, params, value, its dialect, type and multiplicity, the
    struct of its value (see `functions.typed`; null with `value_error` where the text isn't of its type), and the instants of
    its times where TZID names a zone of the host."""
    rest = [c for c in parsed.columns if c not in PARTS]
    names = ("comp_id", "ordinal", "grp", "name", "name_uc", "params", "value")
    listed = lambda props, d: F.transform(props, lambda p: F.struct(d.alias("dialect"), *(p[n].alias(n) for n in names)))
    # nearly all documents have one root, and so one dialect
    root = F.struct(F.get("components", 0)["name_uc"].alias("name_uc"), F.filter("properties", lambda p: p["comp_id"] == 0).alias("props"))
    one = bind(bind(root, _dialect), lambda d: listed(F.col("properties"), d))
    several = F.flatten(F.transform(_placed(None, dialects=True), lambda c: listed(c["props"], c["dialect"])))
    single = F.size(F.filter("components", lambda c: c["depth"] == 0)) <= 1
    rows = parsed.select(*(F.col(f"`{c}`") for c in rest), F.inline(F.when(single, one).otherwise(several)))
    kind, many = type_of(F.col("name_uc"), F.col("dialect"), param(F.col("params"), "VALUE"))
    named_types = step(rows, vtype=kind, multiplicity=many)
    known = step(named_types, typed=typed.parse_value(F.col("value"), F.col("vtype"), F.col("multiplicity")), __zone=host_zone(param(F.col("params"), "TZID")))
    error = F.when(F.col("typed").isNull(), F.concat(F.lit("invalid "), "vtype", F.lit(" "), F.to_json(F.array("value"))))
    return known.withColumn("value_error", error).withColumn("instants", typed.instants(F.col("typed"), F.col("__zone"))).drop("__zone")


def view_of(name_uc: Column) -> Column:
    """Which view a component has; null without one."""
    return F.create_map(*(F.lit(x) for kv in VIEWS.items() for x in kv))[name_uc]


def same_documents(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys with `same`: equal trees, by a hash of all components and properties in order."""
    digest = F.sha2(F.to_json(F.struct(F.transform("components", lambda c: F.struct(c["parent_id"].alias("p"), c["ordinal"].alias("o"), c["name"].alias("n"))).alias("c"), F.transform("properties", lambda p: F.struct(p["comp_id"].alias("c"), p["ordinal"].alias("o"), p["grp"].alias("g"), p["name"].alias("n"), p["params"].alias("a"), p["value"].alias("v"))).alias("p"))), 256)
    both = left.select(*keys, digest.alias("a")).join(right.select(*keys, digest.alias("b")), keys, "full")
    return both.select(*keys, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))
