"""Time zones: those of documents as transition tables, wall times and instants placed among them, and new definitions.

A zone's transitions are one sorted array in one row (a few hundred at most), so a look-up is an equi-join on the zone and
a count over its array: no range join, no window over the events.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from daybook.functions import columns
from daybook.functions.recurrence import parse_instant, parse_rule, plan
from daybook.operators import views
from daybook.operators.emit import Node, document_to_wire, flattened, trees
from daybook.sources.wire import PARSED, arrays_of, component_rows, property_rows

TRANSITION = "struct<at:bigint,fold0:bigint,fold1:bigint,before_s:int,after_s:int,dst_s:int,name:string,shrink:int>"
ONSETS_A_YEAR, LEAST_HORIZON = 60, 2050


def observances(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """STANDARD and DAYLIGHT parts of zones: keys, tzid, zone_no, kind, dtstart, offsets, name, rules, rdates."""
    held = views.with_properties(parsed)
    zone = held.where("name_uc = 'VTIMEZONE'").select(*keys, F.col("comp_id").alias("zone_no"), views.text_of(F.col("props"), "TZID").alias("tzid"))
    p = F.col("props")
    part = held.where(F.col("name_uc").isin("STANDARD", "DAYLIGHT")).select(
        *keys,
        F.col("parent_id").alias("zone_no"),
        F.col("name_uc").alias("kind"),
        F.trim(views.first_of(p, "DTSTART")["value"]).alias("dtstart"),
        columns.parse_offset(F.trim(views.first_of(p, "TZOFFSETFROM")["value"])).alias("offset_from"),
        columns.parse_offset(F.trim(views.first_of(p, "TZOFFSETTO")["value"])).alias("offset_to"),
        views.text_of(p, "TZNAME").alias("tzname"),
        views.first_of(p, "RRULE")["value"].alias("rule"),
        F.flatten(F.transform(views.all_of(p, "RDATE"), lambda x: F.split(x["value"], ","))).alias("rdates"),
    )
    return part.join(zone, [*keys, "zone_no"])


def onsets(parts: DataFrame) -> DataFrame:
    """parts with `wall_s`: the start, RDATEs and occurrences of the rule up to the end of the year `horizon`, each once."""
    kept = parts.columns
    schema = T.StructType([*parts.schema.fields, T.StructField("wall_s", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, walls = [], []
            for k, (start, rule, rdates) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dtstart", "rule", "rdates")), strict=True)):
                horizon = batch.column("horizon")[k].as_py()
                try:
                    first = parse_instant(start or "")
                    found = {(first[0], first[1] or 0), *((d, s or 0) for d, s, _ in map(parse_instant, (x.strip() for x in rdates or ())))}
                    if rule:
                        r = parse_rule(rule)
                        if r.until and r.until[2]:  # an instant: onsets are on the wall clock before them
                            total = r.until[0] * 86400 + r.until[1] + (batch.column("offset_from")[k].as_py() or 0)
                            r.until = (total // 86400, total % 86400, False)
                        stop = parse_instant(f"{horizon:04}1231T235959")[:2]
                        years = max(1, horizon - int(start[:4]) + 1)
                        for n, x in enumerate(plan(r, first).instants()):
                            if x > stop or n >= ONSETS_A_YEAR * years:
                                break
                            found.add(x)
                except ValueError:
                    continue
                for d, s in sorted(found):
                    at.append(k)
                    walls.append((d - 719163) * 86400 + s)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in kept), pa.array(walls, pa.int64())], [*kept, "wall_s"])

    return parts.mapInArrow(run, schema)


def horizons(parsed: DataFrame) -> Column:
    """The last year of a document's zone tables: ten years past the latest date that its values name, LEAST_HORIZON at least.
    It depends on the document alone, neither on others nor on today's date."""
    years = F.transform("properties", lambda p: F.array_max(F.transform(F.regexp_extract_all(p["value"], F.lit(r"(?:^|[^0-9])(\d{4})\d{4}(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))))
    return F.least(F.greatest(F.coalesce(F.array_max(years), F.lit(0)) + 10, F.lit(LEAST_HORIZON)), F.lit(9999))


def _sound() -> Column:
    timed = F.col("dtstart").rlike("[Tt]") & columns.parse_datetime(F.col("dtstart")).isNotNull()
    return F.coalesce(timed & F.col("offset_from").isNotNull() & F.col("offset_to").isNotNull() & (F.col("rule").isNull() | columns.is_rule(F.trim("rule"))), F.lit(False))


def transition_tables(parsed: DataFrame, keys: list[str], horizon: int | None = None) -> DataFrame:
    """keys, tzid, transitions (sorted by instant). Of several definitions of a zone the first stays; definitions with a part
    that isn't complete make no zone (see `zone_warnings`). horizon: the last year of all tables; else see `horizons`."""
    last = horizons(parsed) if horizon is None else F.lit(horizon)
    parts = observances(parsed.withColumn("horizon", last), [*keys, "horizon"])
    whole = _sound()
    by_zone = Window.partitionBy(*keys, "zone_no")
    sound = parts.withColumn("__ok", F.min(whole.cast("int")).over(by_zone)).where("__ok = 1 AND tzid IS NOT NULL").drop("__ok")
    first = sound.groupBy(*keys, "tzid").agg(F.min("zone_no").alias("zone_no"))
    each = onsets(sound.join(first, [*keys, "tzid", "zone_no"]))
    at = F.col("wall_s") - F.col("offset_from")
    dst = F.when(F.col("kind") == "DAYLIGHT", F.greatest(F.col("offset_to") - F.col("offset_from"), F.lit(0))).otherwise(0)
    rows = each.select(*keys, "tzid", at.alias("at"), "offset_from", F.col("offset_to").alias("after_s"), dst.alias("dst_s"), F.coalesce("tzname", "tzid").alias("name"))
    order = Window.partitionBy(*keys, "tzid").orderBy("at", "after_s")
    before = F.coalesce(F.lag("after_s").over(order), F.col("offset_from"))
    keyed = rows.withColumn("before_s", before).select(
        *keys,
        "tzid",
        F.struct(
            "at",
            (F.col("at") + F.greatest("before_s", "after_s")).alias("fold0"),
            (F.col("at") + F.least("before_s", "after_s")).alias("fold1"),
            "before_s",
            "after_s",
            F.col("dst_s").cast("int").alias("dst_s"),
            "name",
            F.greatest(F.col("before_s") - F.col("after_s"), F.lit(0)).alias("shrink"),
        ).alias("t"),
    )
    return keyed.groupBy(*keys, "tzid").agg(F.sort_array(F.collect_list("t")).cast(f"array<{TRANSITION}>").alias("transitions"))


def zone_warnings(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tzid, warning: definitions that make no zone, and zones that values name but neither the host nor the document
    knows."""
    broken = observances(parsed, keys).where(~_sound()).select(*keys, "tzid", F.concat(F.lit("ignoring malformed VTIMEZONE '"), F.coalesce("tzid", F.lit("")), F.lit("'")).alias("warning"))
    made = transition_tables(parsed, keys).select(*keys, "tzid")
    bare = F.regexp_replace("tzid", "^/+", "")
    used = used_spans(parsed, keys).where(views.host_zone(F.col("tzid")).isNull()).select(*keys, "tzid")
    known = made.union(made.select(*keys, F.concat(F.lit("/"), "tzid")))
    unknown = used.join(known, [*keys, "tzid"], "left_anti").join(made.select(*keys, F.col("tzid").alias("__bare")), [*(used[k].eqNullSafe(made[k]) for k in keys), bare == F.col("__bare")], "left_anti")
    return broken.union(unknown.select(*keys, "tzid", _unresolved(F.col("tzid")))).distinct()


def _unresolved(tzid: Column) -> Column:
    return F.concat(F.lit("TZID '"), tzid, F.lit("' is not a known timezone and no VTIMEZONE in the document defines it; interpreting as naive local time")).alias("warning")


def _last(transitions: Column, key: str, at: Column) -> Column:
    """The last transition whose key isn't after `at`; null before all. Nine halvings of an index find it among 512, and as
    many more as the array is longer: the array itself is never walked."""

    def found(x: Column) -> Column:
        rows, when = x["rows"], x["at"]
        reach = F.ceil(F.log2(F.size(rows) + F.lit(1))).cast("int")

        def halve(span: Column, _: Column) -> Column:
            middle = F.floor((span["a"] + span["b"]) / 2).cast("int")
            after = F.get(rows, middle)[key] > when
            grown = F.struct(F.when(after, span["a"]).otherwise(middle + 1).alias("a"), F.when(after, middle).otherwise(span["b"]).alias("b"))
            return F.when(span["a"] < span["b"], grown).otherwise(span)

        begin = F.struct(F.lit(0).alias("a"), F.size(rows).alias("b"))
        return F.when(F.size(rows) > 0, F.get(rows, F.aggregate(F.sequence(F.lit(1), reach), begin, halve)["a"] - 1))

    return columns.bind(F.struct(transitions.alias("rows"), at.alias("at")), found)


def offset_at_wall(transitions: Column, wall: Column, fold: int = 0) -> Column:
    """struct(offset_s, dst_s, name) that a wall time has."""

    def shown(t: Column) -> Column:
        return F.struct(F.coalesce(t["after_s"], F.get(transitions, 0)["before_s"]).alias("offset_s"), F.coalesce(t["dst_s"], F.lit(0)).alias("dst_s"), t["name"].alias("name"))

    return columns.bind(_last(transitions, f"fold{fold}", columns.epoch(wall)), shown)


def from_utc(transitions: Column, instant: Column) -> Column:
    """struct(wall, fold): the wall time of an instant, and whether it is the second of its kind."""

    def placed(x: Column) -> Column:
        t, at = x["t"], x["at"]
        offset = F.coalesce(t["after_s"], F.get(transitions, 0)["before_s"])
        fold = F.when((t["shrink"] > 0) & (at - t["at"] < t["shrink"]), 1).otherwise(0)
        return F.struct(columns.from_epoch(at + offset).alias("wall"), fold.alias("fold"))

    with_last = lambda at: F.struct(_last(transitions, "at", at).alias("t"), at.alias("at"))
    return columns.bind(columns.bind(columns.epoch(instant), with_last), placed)


def resolve(times: DataFrame, zones: DataFrame, keys: list[str], wall: str = "wall", tzid: str = "tzid", host=views.host_zone) -> DataFrame:
    """times with instant_utc, source and warning: the host's zone of that name (slashes before it aside), else the document's
    of that very name, else the document's of the name without slashes, else none and a warning. host: the zone that a name
    stands for among the host's, as a function of a column. Joins are on keys and names; nothing is broadcast."""
    bare = F.regexp_replace(F.col(tzid), "^/+", "")
    known = columns.step(times, __bare=bare, __host=host(F.col(tzid)), __row=F.monotonically_increasing_id())

    def own(name: str, column: str) -> DataFrame:
        return zones.select(*(F.col(k).alias(f"__{column}_{k}") for k in keys), F.col("tzid").alias(f"__{column}"), F.col("transitions").alias(f"__{column}_t"))

    found = known
    for name, column in ((tzid, "as_is"), ("__bare", "plain")):
        right = own(name, column)
        found = found.join(right, [*(F.col(k).eqNullSafe(F.col(f"__{column}_{k}")) for k in keys), F.col(name) == F.col(f"__{column}"), F.col("__host").isNull()], "left")
    placed = columns.step(found, __t=F.coalesce("__as_is_t", "__plain_t"))
    offset = offset_at_wall(F.col("__t"), F.col(wall))["offset_s"]
    instant = F.when(F.col("__host").isNotNull(), F.convert_timezone(F.col("__host"), F.lit("UTC"), F.col(wall))).when(F.col("__t").isNotNull(), columns.add_seconds(F.col(wall), -offset))
    source = F.when(F.col("__host").isNotNull(), "host").when(F.col("__t").isNotNull(), "document").otherwise("unresolved")
    out = placed.withColumn("instant_utc", instant).withColumn("source", source).withColumn("warning", F.when((F.col("source") == "unresolved") & F.col(tzid).isNotNull(), _unresolved(F.col(tzid))))
    return out.select(*(F.col(f"`{c}`") for c in times.columns), "instant_utc", "source", "warning")


def used_spans(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tzid, first and last wall time in values that name a zone (those of definitions aside), how many there are, and
    where it is named first (comp_id, ordinal): their order is that of `first_seen`."""
    rest = parsed.select(*keys, F.inline("properties"))
    tz = views.param(F.col("params"), "TZID")
    found = F.explode(F.regexp_extract_all("value", F.lit(r"\d{8}T\d{6}"), F.lit(0)))
    times = rest.where(tz.isNotNull()).select(*keys, tz.alias("tzid"), F.struct("comp_id", "ordinal").alias("seen"), found.alias("t")).withColumn("wall", columns.parse_datetime(F.col("t"))["wall"])
    return times.where("wall IS NOT NULL").groupBy(*keys, "tzid").agg(F.min("wall").alias("first_wall"), F.max("wall").alias("last_wall"), F.count(F.lit(1)).alias("n_times"), F.min("seen").alias("first_seen"))


def missing_zones(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Zones that values name and the document doesn't define, with their spans."""
    defined = views.timezones(parsed).select(*keys, "tzid")
    return used_spans(parsed, keys).join(defined, [*keys, "tzid"], "left_anti")


# New definitions. Names and daylight saving are not among Spark's functions, so zones are probed in Python, a year at a time
# and each year once a worker.


def _state(zone: ZoneInfo, at: datetime) -> tuple[int, int, str]:
    """What holds in a zone at an instant of UTC: its offset, how much of it is daylight saving, and the name."""
    local = at.replace(tzinfo=timezone.utc).astimezone(zone)
    return int(local.utcoffset().total_seconds()), int((local.dst() or timedelta(0)).total_seconds()), local.tzname() or ""


@lru_cache(4096)
def _changes_of_year(name: str, year: int) -> list[tuple[datetime, tuple, tuple]]:
    """Changes of state in a year of UTC, to the second: the instant, before, after. At most one falls on a day."""
    zone = ZoneInfo(name)
    stop = datetime(year + 1, 1, 1) if year < 9999 else datetime(9999, 12, 31)
    days = [datetime(year, 1, 1) + timedelta(days=k) for k in range((stop - datetime(year, 1, 1)).days + 1)]
    states = [_state(zone, d) for d in days]
    out = []
    for day, before, after in zip(days, states, states[1:], strict=False):
        if before != after:
            changed = lambda s, day=day, before=before: _state(zone, day + timedelta(seconds=s)) != before
            moment = day + timedelta(seconds=1 + bisect_left(range(1, 86_401), True, key=changed))
            out.append((moment, before, _state(zone, moment)))
    return out


def host_changes(name: str, first: datetime, last: datetime) -> list[tuple[datetime, tuple, tuple]]:
    """A host zone's changes after an instant and up to another."""
    return [c for y in range(first.year, last.year + 1) for c in _changes_of_year(name, y) if first < c[0] <= last]


def onset_groups(name: str, first: datetime, last: datetime) -> list[tuple[int, int, str, bool, list[datetime]]]:
    """(offset before, offset after, name, daylight saving, onsets on the wall clock before them) in the order of their first
    onsets; one standing offset from the start where nothing changes."""
    groups: dict[tuple, list[datetime]] = {}
    for moment, before, after in host_changes(name, first, last):
        groups.setdefault((before[0], after[0], after[2], after[1] > 0), []).append(moment + timedelta(seconds=before[0]))
    if not groups:
        offset, dst, label = _state(ZoneInfo(name), first)
        groups[(offset, offset, label, dst > 0)] = [first + timedelta(seconds=offset)]
    return [(*key, found) for key, found in groups.items()]


GROUP = "before_s int, after_s int, name string, is_daylight boolean, onsets array<string>"


def zone_groups(spans: DataFrame, zone: str = "tzid", low: str = "first_wall", high: str = "last_wall") -> DataFrame:
    """spans with a row for each group of onsets of their host zone: before_s, after_s, name, is_daylight, onsets (wire text,
    rising), group_no (by first onset). A zone that isn't the host's gives none."""
    kept = spans.columns
    schema = T.StructType([*spans.schema.fields, T.StructField("group_no", T.IntegerType()), *T._parse_datatype_string(GROUP).fields])
    own = host_zone_name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, (name, a, b) in enumerate(zip(*(batch.column(kept.index(c)).to_pylist() for c in (zone, low, high)), strict=True)):
                bare = own(name)
                if bare is None or a is None or b is None:
                    continue
                for n, (before, after, label, daylight, found) in enumerate(onset_groups(bare, a, b)):
                    at.append(k)
                    rows.append((n, before, after, label, daylight, [f"{x:%Y%m%dT%H%M%S}" for x in found]))
            columns_ = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string()))
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns), *(pa.array(c, kind) for c, kind in zip(columns_, kinds, strict=True))], schema.names)

    return spans.mapInArrow(run, schema)


def host_zone_name(tzid: str | None) -> str | None:
    """The host's zone of that name, slashes before it aside; None if there is none."""
    if not tzid:
        return None
    try:
        return ZoneInfo(tzid.lstrip("/")).key
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None


def _definition(tzid: str, groups: list[tuple[int, int, str, bool, list[datetime]]]) -> Node:
    prop = lambda name, value: {"grp": None, "name": name, "name_uc": name, "params": [], "value": value, "line_no": 0}
    shown = lambda x: f"{x:%Y%m%dT%H%M%S}"
    out = Node("VTIMEZONE", [prop("TZID", tzid)])
    for before, after, name, daylight, found in groups:
        part = [prop("DTSTART", shown(found[0])), prop("TZOFFSETFROM", offset_text(before)), prop("TZOFFSETTO", offset_text(after))]
        part += [prop("TZNAME", name)] if name else []
        part += [prop("RDATE", ",".join(map(shown, found[1:])))] if len(found) > 1 else []
        out.children.append(Node("DAYLIGHT" if daylight else "STANDARD", part))
    return out


def offset_text(seconds: int) -> str:
    s = abs(seconds)
    return f"{'-' if seconds < 0 else '+'}{s // 3600:02}{s // 60 % 60:02}" + (f"{s % 60:02}" if s % 60 else "")


def definitions(spans: DataFrame, zone: str = "tzid", low: str = "first_wall", high: str = "last_wall", column: str = "content") -> DataFrame:
    """spans with the wire text of a VTIMEZONE that describes their host zone from `low` to `high` (instants in UTC): onsets by
    offsets, name and kind, further ones of a group as RDATEs; null for a zone that isn't the host's."""

    @F.arrow_udf("string")
    def made(names: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
        out = []
        for name, a, b in zip(names.to_pylist(), lows.to_pylist(), highs.to_pylist(), strict=True):
            bare = host_zone_name(name)
            out.append(None if bare is None or a is None or b is None else document_to_wire([_definition(name, onset_groups(bare, a, b))]))
        return pa.array(out, pa.string())

    return spans.withColumn(column, made(F.col(zone), F.col(low), F.col(high)))


WIRE_TIME = re.compile(r"\d{8}T\d{6}")


def _used(node: Node, out: dict[str, tuple[datetime, datetime]]) -> None:
    """Spans of zones that a component's values name, in the order in which they are named; definitions aside."""
    stack = [node]
    while stack:
        here = stack.pop()
        for p in here.properties:
            tzid = next((q["values"][0] for q in p["params"] if q["name"].upper() == "TZID" and q["values"]), None)
            for text in WIRE_TIME.findall(p["value"]) if tzid is not None else ():
                try:
                    at = datetime.strptime(text, "%Y%m%dT%H%M%S")
                except ValueError:
                    continue
                low, high = out.get(tzid, (at, at))
                out[tzid] = (min(low, at), max(high, at))
        stack += [c for c in reversed(here.components) if c.name.upper() != "VTIMEZONE"]


def add_missing_timezones(parsed: DataFrame, padding_days: int = 366) -> DataFrame:
    """parsed documents whose calendars define every zone of the host that their values name: definitions stand before the
    first subcomponent and cover the times that name them and `padding_days` on both sides. With `added` (their TZIDs) and
    `zone_warnings` (texts, for names that the host doesn't know). Each document is changed by itself; nothing is shuffled."""
    kept = [c for c in parsed.columns if c not in views.PARTS]
    pad = timedelta(days=padding_days)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in parsed.schema if f.name in kept), PARSED, "added array<string>, zone_warnings array<string>"])

    def grown(roots: list[Node]) -> tuple[list[str], list[str]]:
        added, warned = [], []
        for root in roots:
            if root.name.upper() != "VCALENDAR":
                continue
            have = {p["value"] for c in root.components if c.name.upper() == "VTIMEZONE" for p in [q for q in c.properties if q["name_uc"] == "TZID"][:1]}
            spans: dict[str, tuple[datetime, datetime]] = {}
            _used(root, spans)
            new = []
            for tzid, (low, high) in spans.items():
                if tzid in have:
                    continue
                name = host_zone_name(tzid)
                if name is None:
                    warned.append(f"cannot generate a VTIMEZONE for unknown TZID {tzid!r}")
                    continue
                first, last = max(low, datetime.min + pad) - pad, min(high, datetime.max - pad) + pad
                new.append(_definition(tzid, onset_groups(name, first, last)))
                added.append(tzid)
            at = next((k for k, c in enumerate(root.children) if isinstance(c, Node)), len(root.children))
            root.children[at:at] = new
        return added, warned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flats, added, warned = [], [], []
            for c, p in zip(component_rows(batch.column(len(kept))), property_rows(batch.column(len(kept) + 1)), strict=True):
                roots = trees(c, p)
                a, w = grown(roots)
                flats.append(flattened(roots))
                added.append(a)
                warned.append(w)
            parts = arrays_of(flats)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], parts[0], parts[1], batch.column(len(kept) + 2), batch.column(len(kept) + 3), pa.array(added, pa.list_(pa.string())), pa.array(warned, pa.list_(pa.string()))],
                [*kept, *views.PARTS, "added", "zone_warnings"],
            )

    return parsed.select(*(F.col(f"`{c}`") for c in kept), *views.PARTS).mapInArrow(run, schema)
