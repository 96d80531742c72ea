"""Value types of properties by dialect: a small dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIALECTS = ("icalendar", "vcard4", "vcard3")

# Names by type and multiplicity (single, list: commas part values, structured: semicolons part fields,
# structured-lists: fields may hold comma lists).
ICALENDAR = {
    ("text", "single"): "CALSCALE METHOD PRODID VERSION CLASS COMMENT DESCRIPTION LOCATION STATUS SUMMARY TRANSP TZID TZNAME CONTACT RELATED-TO UID ACTION BUSYTYPE NAME COLOR LOCATION-TYPE PARTICIPANT-TYPE RESOURCE-TYPE PROXIMITY",
    ("text", "list"): "CATEGORIES RESOURCES",
    ("text", "structured"): "REQUEST-STATUS",
    ("date-time", "single"): "COMPLETED DTEND DUE DTSTART RECURRENCE-ID CREATED DTSTAMP LAST-MODIFIED ACKNOWLEDGED",
    ("date-time", "list"): "EXDATE RDATE",
    ("period", "list"): "FREEBUSY",
    ("duration", "single"): "DURATION TRIGGER REFRESH-INTERVAL",
    ("utc-offset", "single"): "TZOFFSETFROM TZOFFSETTO",
    ("recur", "single"): "RRULE EXRULE",
    ("integer", "single"): "PERCENT-COMPLETE PRIORITY REPEAT SEQUENCE",
    ("float", "structured"): "GEO",
    ("uri", "single"): "ATTACH TZURL URL IMAGE CONFERENCE SOURCE STRUCTURED-DATA STYLED-DESCRIPTION CALENDAR-ADDRESS LINK",
    ("cal-address", "single"): "ATTENDEE ORGANIZER",
}
VCARD4 = {
    ("text", "single"): "FN EMAIL NOTE PRODID TITLE ROLE VERSION KIND XML UID EXPERTISE HOBBY INTEREST ORG-DIRECTORY TEL TZ",
    ("text", "list"): "NICKNAME CATEGORIES",
    ("text", "structured-lists"): "N ADR",
    ("text", "structured"): "GENDER ORG CLIENTPIDMAP",
    ("date-and-or-time", "single"): "BDAY ANNIVERSARY DEATHDATE",
    ("timestamp", "single"): "REV",
    ("language-tag", "single"): "LANG",
    ("uri", "single"): "SOURCE PHOTO IMPP GEO LOGO MEMBER RELATED SOUND URL KEY FBURL CALADRURI CALURI",
}
VCARD3 = {
    ("text", "single"): "FN EMAIL NOTE PRODID TITLE ROLE VERSION MAILER UID LABEL SORT-STRING CLASS PROFILE SOURCE NAME",
    ("phone-number", "single"): "TEL",
    ("text", "list"): "NICKNAME CATEGORIES",
    ("text", "structured-lists"): "N ADR",
    ("text", "structured"): "ORG",
    ("date", "single"): "BDAY",
    ("date-time", "single"): "REV",
    ("float", "structured"): "GEO",
    ("utc-offset", "single"): "TZ",
    ("binary", "single"): "PHOTO LOGO SOUND KEY",
    ("uri", "single"): "URL",
    ("vcard", "single"): "AGENT",
}
# All type names.
TYPES = "binary boolean cal-address date date-and-or-time date-time float duration integer language-tag period phone-number recur text time timestamp uri utc-offset vcard unknown".split()
# Names of structured fields in the XML forms.
FIELDS = {
    ("icalendar", "REQUEST-STATUS"): ["code", "description", "data"],
    ("icalendar", "GEO"): ["latitude", "longitude"],
    ("vcard3", "GEO"): ["latitude", "longitude"],
    **{(d, "N"): ["surname", "given", "additional", "prefix", "suffix"] for d in ("vcard3", "vcard4")},
    **{(d, "ADR"): ["pobox", "ext", "street", "locality", "region", "code", "country"] for d in ("vcard3", "vcard4")},
    **{(d, "GENDER"): ["sex", "identity"] for d in ("vcard3", "vcard4")},
}

BY_DIALECT = {d: {n: key for key, names in t.items() for n in names.split()} for d, t in zip(DIALECTS, (ICALENDAR, VCARD4, VCARD3), strict=True)}


def default_type(name_uc: str, dialect: str) -> tuple[str, str]:
    return BY_DIALECT[dialect].get(name_uc, ("unknown", "single"))


def type_of(name_uc: str, dialect: str, declared: str | None) -> tuple[str, str]:
    """The type and multiplicity of a property; a type that VALUE names replaces the usual one, and with another type than
    text a structured property has a single value."""
    kind, many = default_type(name_uc, dialect)
    if declared and declared.lower() in TYPES[:-1]:
        declared = declared.lower()
        if declared != kind and many.startswith("structured") and declared != "text":
            many = "single"
        kind = declared
    return kind, many


def registry(spark: SparkSession) -> DataFrame:
    """dialect, name_uc, vtype, multiplicity: about 120 rows, always small enough to broadcast."""
    rows = [(d, n, *key) for d, names in BY_DIALECT.items() for n, key in names.items()]
    return spark.createDataFrame(rows, "dialect string, name_uc string, vtype string, multiplicity string")


def dialect_of(component_uc: Column, version: Column) -> Column:
    card = component_uc == "VCARD"
    return F.when(card & F.trim(version).isin("2.1", "3.0"), "vcard3").when(card, "vcard4").otherwise("icalendar")


def column_type(name_uc: Column, dialect: Column, declared: Column) -> tuple[Column, Column]:
    """Type and multiplicity as `type_of` gives them, by a map literal of about 120 entries: no join."""
    entries = [x for d, names in BY_DIALECT.items() for n, key in names.items() for x in (F.lit(f"{d} {n}"), F.lit(" ".join(key)))]
    found = F.split(F.coalesce(F.element_at(F.create_map(*entries), F.concat_ws(" ", dialect, name_uc)), F.lit("unknown single")), " ")
    usual, many, own = F.get(found, 0), F.get(found, 1), F.lower(declared)
    known = F.coalesce(own.isin(*TYPES[:-1]), F.lit(False))
    flat = known & (own != usual) & many.startswith("structured") & (own != "text")
    return F.when(known, own).otherwise(usual), F.when(flat, "single").otherwise(many)


def with_types(properties: DataFrame, spark: SparkSession) -> DataFrame:
    """properties (dialect, name_uc, params) with vtype and multiplicity, by a broadcast join with the registry."""
    declared = F.lower(F.get(F.get(F.filter("params", lambda p: F.upper(p["name"]) == "VALUE"), 0)["values"], 0))
    known = declared.isin(*TYPES[:-1])
    joined = properties.join(F.broadcast(registry(spark)), ["dialect", "name_uc"], "left")
    usual, many = F.coalesce("vtype", F.lit("unknown")), F.coalesce("multiplicity", F.lit("single"))
    flat = known & (declared != usual) & many.startswith("structured") & (declared != "text")
    return joined.withColumn("multiplicity", F.when(flat, "single").otherwise(many)).withColumn("vtype", F.when(known, declared).otherwise(usual))
