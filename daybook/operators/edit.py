"""Edits of parsed documents as projections of their nested rows: a new DataFrame, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions import columns, text
from daybook.sources.wire import PARAMS


def _replaced(props: Column, in_place: Column, name: str, params, value: Column, comp_id: Column, last: Column) -> Column:
    """The first property of a name in a component gets a new value, or a new one is appended to the component."""
    mine = lambda p: (p["comp_id"] == comp_id) & (p["name_uc"] == name.upper())
    first = F.array_min(F.transform(F.filter(props, mine), lambda p: p["ordinal"]))
    edited = F.transform(props, lambda p: F.when(mine(p) & (p["ordinal"] == first), p.withField("value", value).withField("params", params(p["params"]))).otherwise(p))
    new = F.struct(comp_id.cast("int").alias("comp_id"), last.cast("int").alias("ordinal"), F.lit(0).alias("line_no"), F.lit(None).cast("string").alias("grp"), F.lit(name).alias("name"), F.lit(name.upper()).alias("name_uc"), params(F.array().cast(PARAMS)).alias("params"), value.alias("value"))
    return F.when(~in_place, props).when(first.isNotNull(), edited).otherwise(F.concat(props, F.array(new)))


def _edit(parsed: DataFrame, component: str, name: str, value: Column, params) -> DataFrame:
    """Sets a property of the first component of a name in each document."""
    target = F.get(F.filter("components", lambda c: c["name_uc"] == component.upper()), 0)
    comp_id = target["comp_id"]
    held = F.size(F.filter("properties", lambda p: p["comp_id"] == comp_id)) + F.size(F.filter("components", lambda c: c["parent_id"] == comp_id))
    return parsed.withColumn("properties", _replaced(F.col("properties"), comp_id.isNotNull() & value.isNotNull(), name, params, value, comp_id, held))


def _without(params: Column, *names: str) -> Column:
    return F.filter(params, lambda p: ~text.ascii_upper(p["name"]).isin(*names))


def set_text(parsed: DataFrame, component: str, name: str, value: Column) -> DataFrame:
    """TEXT, escaped; a declared type goes, other parameters stay."""
    return _edit(parsed, component, name, text.escape_text(value), lambda p: _without(p, "VALUE"))


def set_url(parsed: DataFrame, component: str, value: Column) -> DataFrame:
    """A URI as it is; a line break in it fails the job."""
    safe = F.when(value.rlike(r"[\r\n]"), F.raise_error(F.lit("line break in a URL"))).otherwise(value)
    return _edit(parsed, component, "URL", safe, lambda p: p)


def set_uid(parsed: DataFrame, component: str, value: Column) -> DataFrame:
    return set_text(parsed, component, "UID", value)


def set_status(parsed: DataFrame, component: str, value: Column) -> DataFrame:
    return set_text(parsed, component, "STATUS", value)


def set_rule(parsed: DataFrame, component: str, value: Column) -> DataFrame:
    """A recurrence rule; a text that isn't one fails the job."""
    checked = F.when(value.isNull() | columns.is_rule(value), value).otherwise(F.raise_error(F.concat(F.lit("invalid rule "), value)))
    return _edit(parsed, component, "RRULE", checked, lambda p: p)


def set_datetime(parsed: DataFrame, component: str, name: str, wall: Column, zone: Column | None = None, is_date: Column | None = None) -> DataFrame:
    """A wall time: floating without a zone, with Z in UTC, else with TZID; or a date. TZID and VALUE are replaced, other
    parameters stay."""
    zone = F.lit(None).cast("string") if zone is None else zone
    date = F.lit(False) if is_date is None else is_date
    value = F.when(date, columns.format_date(wall)).otherwise(columns.format_datetime(wall, F.coalesce(zone == "UTC", F.lit(False))))

    def params(p: Column) -> Column:
        one = lambda key, v: F.array(F.struct(F.lit(key).alias("name"), F.array(v).alias("values")))
        none = F.array().cast(PARAMS)
        added = F.when(date, one("VALUE", F.lit("DATE"))).when(zone.isNotNull() & (zone != "UTC"), one("TZID", zone)).otherwise(none)
        return F.concat(_without(p, "TZID", "VALUE"), added)

    return _edit(parsed, component, name, value, params)


def set_start(parsed: DataFrame, component: str, wall: Column, zone: Column | None = None, is_date: Column | None = None) -> DataFrame:
    return set_datetime(parsed, component, "DTSTART", wall, zone, is_date)


def set_end(parsed: DataFrame, component: str, wall: Column, zone: Column | None = None, is_date: Column | None = None) -> DataFrame:
    return set_datetime(parsed, component, "DTEND", wall, zone, is_date)


def set_due(parsed: DataFrame, wall: Column, zone: Column | None = None, is_date: Column | None = None) -> DataFrame:
    return set_datetime(parsed, "VTODO", "DUE", wall, zone, is_date)


def set_instant(parsed: DataFrame, component: str, name: str, wall: Column, offset_s: Column) -> DataFrame:
    """A time of a clock that has an offset from UTC but no zone's name: it is written in UTC, so the instant never changes."""
    return set_datetime(parsed, component, name, columns.add_seconds(wall, -offset_s), F.lit("UTC"))


def add_component(parsed: DataFrame, component: str, props: list[tuple[str, Column]], parent: str) -> DataFrame:
    """A component at the end of the first `parent`, with properties (name, raw value)."""
    parent_id = F.get(F.filter("components", lambda c: c["name_uc"] == parent.upper()), 0)["comp_id"]
    new_id = F.coalesce(F.array_max(F.transform("components", lambda c: c["comp_id"])), F.lit(-1)) + 1
    held = F.size(F.filter("properties", lambda p: p["comp_id"] == parent_id)) + F.size(F.filter("components", lambda c: c["parent_id"] == parent_id))
    parent_row = F.get(F.filter("components", lambda c: c["comp_id"] == parent_id), 0)
    row = F.struct(new_id.cast("int").alias("comp_id"), parent_id.alias("parent_id"), parent_row["root_id"].alias("root_id"), (parent_row["depth"] + 1).alias("depth"), held.cast("int").alias("ordinal"), F.lit(component).alias("name"), F.lit(component.upper()).alias("name_uc"))
    new = [F.struct(new_id.cast("int").alias("comp_id"), F.lit(k).alias("ordinal"), F.lit(0).alias("line_no"), F.lit(None).cast("string").alias("grp"), F.lit(n).alias("name"), F.lit(n.upper()).alias("name_uc"), F.array().cast(PARAMS).alias("params"), v.cast("string").alias("value")) for k, (n, v) in enumerate(props)]
    there = parent_id.isNotNull()
    grown = F.when(there, F.concat("properties", F.array(*new))).otherwise(F.col("properties")) if new else F.col("properties")
    return parsed.withColumn("properties", grown).withColumn("components", F.when(there, F.concat("components", F.array(row))).otherwise(F.col("components")))


def drop_properties(parsed: DataFrame, name: str) -> DataFrame:
    return parsed.withColumn("properties", F.filter("properties", lambda p: p["name_uc"] != name.upper()))
