"""All queries of the calendar engine, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions import columns, text, typed
from daybook.operators import edit, emit, jcal, views, xcal, zones
from daybook.operators import expand as recurrence
from daybook.plans import render
from daybook.sources import wire

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one in fewer pieces than there are cores is dealt to all of them, as what follows is work on each row."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


stamp = columns.shown


# Reading.

BY_MONTH = "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_events FROM orders GROUP BY 1"


@query(BY_MONTH)
def parse_events_by_month(spark, d):
    docs = render.calendars_of_customers(table(spark, d, "orders"))
    events = views.with_properties(wire.parse_documents(docs, strict=True, names=("DTSTART",)), "VEVENT")
    starts = columns.spread(events.select(views.first_of(F.col("props"), "DTSTART")["value"].alias("v")), columns.parse_datetime(F.col("v")), "wall", "is_date", "utc", "leap")
    return starts.groupBy(stamp(F.col("wall"), 7).alias("month")).agg(F.count(F.lit(1)).alias("n_events"))


@query(BY_MONTH)
def parse_lenient_by_month(spark, d):
    events = views.events(wire.parse_documents(render.calendars_of_customers(table(spark, d, "orders"))))
    return events.groupBy(stamp(F.col("start.wall"), 7).alias("month")).agg(F.count(F.lit(1)).alias("n_events"))


@query("SELECT o_custkey AS doc_id, count(*) AS n_events, 1 AS n_roots, 2 + 3 * count(*) AS n_properties FROM orders GROUP BY 1")
def tree_shape(spark, d):
    parsed = wire.parse_documents(render.calendars_of_customers(table(spark, d, "orders")))
    depth = lambda k: F.size(F.filter("components", lambda c: c["depth"] == k)).cast("bigint")
    return parsed.select("doc_id", depth(1).alias("n_events"), depth(0).cast("int").alias("n_roots"), F.size("properties").cast("bigint").alias("n_properties"))


@query("""
    WITH t AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS x FROM documents)
    SELECT doc_id, length(x) AS n_chars, md5(x) AS text_md5 FROM t""")
def unfold_roundtrip(spark, d):
    docs = table(spark, d, "documents")
    line = text.fold(F.concat(F.lit("DESCRIPTION:"), text.escape_text(F.col("text"))))
    content = F.concat(F.lit("BEGIN:VJOURNAL\r\n"), line, F.lit("END:VJOURNAL\r\n"))
    parsed = wire.parse_documents(docs.select("doc_id", content.alias("content")), strict=True)
    back = text.unescape_text(views.first_of(F.col("properties"), "DESCRIPTION")["value"])
    return parsed.select("doc_id", F.length(back).cast("bigint").alias("n_chars"), F.md5(back).alias("text_md5"))


@query("SELECT c_custkey AS doc_id, true AS fits, 1 + CAST(ceil(greatest(0, 9 + 100 + length(c_name) - 75) / 74.0) AS BIGINT) AS n_lines FROM customer")
def fold_lines(spark, d):
    line = F.concat(F.lit("COMMENT:"), F.repeat(F.lit("x"), 101), "c_name")
    folded = F.split(text.fold(line), "\r\n")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.forall(folded, lambda x: F.octet_length(x) <= 75).alias("fits"), (F.size(folded) - 1).cast("bigint").alias("n_lines"))


@query("SELECT k AS kind, CAST(n AS BIGINT) AS n FROM (SELECT CASE o_orderkey % 6 WHEN 1 THEN 'LooseLineEnding' WHEN 2 THEN 'SkippedBlankLine' WHEN 3 THEN 'ClosedUnterminatedComponent' WHEN 4 THEN 'DroppedLine' WHEN 5 THEN 'NonstandardName' END AS k, count(*) AS n FROM orders GROUP BY 1) WHERE k IS NOT NULL")
def lenient_repairs(spark, d):
    return wire.repairs(wire.parse_documents(_faulty(spark, d))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE o_orderkey % 6 WHEN 1 THEN 'LooseLineEnding' WHEN 2 THEN 'BlankLine' WHEN 3 THEN 'MismatchedEnd' WHEN 4 THEN 'MissingColon' WHEN 5 THEN 'InvalidName' ELSE 'none' END AS kind, count(*) AS n FROM orders GROUP BY 1")
def strict_errors(spark, d):
    parsed = wire.parse_documents(_faulty(spark, d), strict=True)
    return parsed.groupBy(F.coalesce("error.kind", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _faulty(spark, d):
    """An order's calendar with one fault, by its key."""
    key = F.col("o_orderkey") % 6
    uid = F.concat(F.lit("UID:"), F.col("o_orderkey").cast("string"))
    body = F.concat(
        F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\n"),
        uid,
        F.when(key == 1, "\n").otherwise("\r\n"),
        F.when(key == 2, "\r\n").when(key == 4, "NOCOLON\r\n").when(key == 5, "X_NAME:1\r\n").otherwise(""),
        F.when(key == 3, "").otherwise("END:VEVENT\r\n"),
        F.lit("END:VCALENDAR\r\n"),
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), body.alias("content"))


@query("SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'caf' || chr(233) || ' ' || n_name ELSE n_name END AS summary, n_nationkey % 2 = 0 AS latin1 FROM nation")
def bytes_latin1(spark, d):
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.encode(F.lit("SUMMARY:caf"), "UTF-8"), F.unhex(F.lit("E9")), F.encode(F.concat(F.lit(" "), "n_name"), "UTF-8"))).otherwise(F.encode(F.concat(F.lit("SUMMARY:"), "n_name"), "UTF-8"))
    content = F.concat(F.encode(F.lit("BEGIN:VEVENT\r\n"), "UTF-8"), name, F.encode(F.lit("\r\nEND:VEVENT\r\n"), "UTF-8"))
    parsed = wire.parse_documents(table(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), content.alias("content")))
    return parsed.select("doc_id", views.text_of(F.col("properties"), "SUMMARY").alias("summary"), F.exists("repairs", lambda r: r["kind"] == "DecodedNonUtf8AsLatin1").alias("latin1"))


@query("SELECT 1 + o_custkey % 3 AS depth, count(DISTINCT o_custkey) AS n_docs FROM orders GROUP BY 1")
def nesting_depth(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id")).distinct()
    n = (1 + F.col("doc_id") % 3).cast("int")
    docs = keys.select("doc_id", F.concat(F.repeat(F.lit("BEGIN:X\r\n"), n), F.repeat(F.lit("END:x\r\n"), n)).alias("content"))
    deepest = F.array_max(F.transform("components", lambda c: c["depth"])) + 1
    return wire.parse_documents(docs).groupBy(deepest.cast("bigint").alias("depth")).agg(F.count(F.lit(1)).alias("n_docs"))


# Text.


@query(r"SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(text, '\', '\\'), ';', '\;'), ',', '\,'), chr(13) || chr(10), '\n'), chr(10), '\n'), chr(13), '\n')) AS escaped_md5 FROM documents")
def escape_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.escape_text(F.col("text"))).alias("escaped_md5"))


@query("SELECT doc_id, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_md5 FROM documents")
def unescape_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.unescape_text(text.escape_text(F.col("text")))).alias("text_md5"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '^', '^^'), chr(13) || chr(10), '^n'), chr(10), '^n'), chr(13), '^n'), '\"', '^''')) AS encoded_md5, true AS same FROM documents")
def caret_params(spark, d):
    encoded = text.caret_encode(F.col("text"))
    back = text.caret_decode(encoded) == F.regexp_replace("text", "\r\n?", "\n")
    return table(spark, d, "documents").select("doc_id", F.md5(encoded).alias("encoded_md5"), back.alias("same"))


@query("SELECT p_partkey, 4 AS n_parts, p_type AS first, p_name || ',x' AS second, '' AS third, p_brand AS fourth FROM part")
def split_categories(spark, d):
    value = F.concat("p_type", F.lit(","), "p_name", F.lit("\\,x,,"), "p_brand")
    parts = text.split_unescaped(value, ",")
    item = lambda k: text.unescape_text(F.get(parts, k))
    return table(spark, d, "part").select("p_partkey", F.size(parts).alias("n_parts"), item(0).alias("first"), item(1).alias("second"), item(2).alias("third"), item(3).alias("fourth"))


@query("SELECT s_suppkey, s_suppkey % 4 <> 0 AS strict, s_suppkey % 4 NOT IN (2, 3) AS lenient, CAST(s_suppkey % 4 = 3 AS INTEGER) AS controls FROM supplier")
def names_and_controls(spark, d):
    name = F.when(F.col("s_suppkey") % 4 == 0, "X_NAME").when(F.col("s_suppkey") % 4 == 2, "A").when(F.col("s_suppkey") % 4 == 3, "B").otherwise("X-NAME")
    shown = F.concat(name, F.when(F.col("s_suppkey") % 4 == 2, ";").when(F.col("s_suppkey") % 4 == 3, "\x07").otherwise(""))
    return table(spark, d, "supplier").select("s_suppkey", text.is_strict_name(name).alias("strict"), text.is_lenient_name(shown).alias("lenient"), text.control_characters(shown).alias("controls"))


@query("SELECT p_partkey, to_base64(encode(p_name)) AS encoded, p_name AS decoded, true AS bad_is_null FROM part")
def base64_attach(spark, d):
    encoded = F.base64(F.encode("p_name", "UTF-8"))
    loose = F.regexp_replace(F.concat(F.substring(encoded, 1, 2), F.lit(" \n"), F.expr("substring(base64(encode(p_name, 'UTF-8')), 3)")), "=", "")
    return table(spark, d, "part").select("p_partkey", encoded.alias("encoded"), F.decode(columns.decode_base64(loose), "UTF-8").alias("decoded"), columns.decode_base64(F.concat(encoded, F.lit("*"))).isNull().alias("bad_is_null"))


# Values.


@query("""
    SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT) % 10) AS BIGINT) AS priorities,
           CAST(sum(CAST(l_quantity AS BIGINT) * 3600 + l_linenumber * 60) AS BIGINT) AS seconds, round(sum(l_discount), 2) AS latitudes
    FROM lineitem GROUP BY 1""")
def typed_values(spark, d):
    q = F.col("l_quantity").cast("bigint")
    todo = render.component("VTODO", render.prop("PRIORITY", (q % 10).cast("string")), F.concat(F.lit("GEO:"), F.col("l_discount").cast("string"), F.lit(";7.5")), F.concat(F.lit("DURATION:PT"), q.cast("string"), F.lit("H"), F.col("l_linenumber").cast("string"), F.lit("M")))
    docs = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("doc_id"), "l_returnflag", todo.alias("content"))
    found = views.values(wire.parse_documents(docs)).select("l_returnflag", "name_uc", F.get("typed.integers", 0).alias("p"), F.get("typed.seconds", 0).alias("s"), F.get("typed.floats", 0).alias("lat"))
    return found.groupBy("l_returnflag").agg(F.sum((F.col("name_uc") == "GEO").cast("bigint")).alias("n"), F.sum("p").alias("priorities"), F.sum("s").alias("seconds"), F.round(F.sum("lat"), 2).alias("latitudes"))


KINDS = """
    SELECT kind, count(*) AS n, count(*) AS n_same, CAST(round(sum(total), 2) AS DOUBLE) AS total FROM (SELECT c_custkey AS k, unnest([
        {'kind': 'integer', 'total': CAST(c_custkey AS DOUBLE)}, {'kind': 'float', 'total': c_custkey + 0.5}, {'kind': 'duration', 'total': (c_custkey + 1) * 3600.0 + 604800}, {'kind': 'date-time', 'total': 2},
        {'kind': 'date', 'total': 2}, {'kind': 'period', 'total': 5400 + 86400}, {'kind': 'utc-offset', 'total': -5400}, {'kind': 'text', 'total': 2}, {'kind': 'structured', 'total': 3}, {'kind': 'binary', 'total': length(c_name)},
        {'kind': 'uri', 'total': 1}, {'kind': 'cal-address', 'total': 1}, {'kind': 'recur', 'total': 1}, {'kind': 'boolean', 'total': c_custkey % 2}, {'kind': 'time', 'total': 1}, {'kind': 'unknown', 'total': 1}], recursive := true) FROM customer)
    GROUP BY 1 UNION ALL SELECT 'none', count(*), 0, 0 FROM customer"""


@query(KINDS)
def typed_kinds(spark, d):
    """A value of every type, typed and written again: how many are as they were, and a sum of what their structs hold."""
    key = F.col("c_custkey").cast("string")
    flag = F.when(F.col("c_custkey") % 2 == 1, "TRUE").otherwise("FALSE")
    body = render.component(
        "VEVENT", F.concat(F.lit("SEQUENCE:"), key), F.concat(F.lit("X-F;VALUE=FLOAT:"), key, F.lit(".5")), F.concat(F.lit("DURATION:P1WT"), (F.col("c_custkey") + 1).cast("string"), F.lit("H")), "EXDATE:20200101T000000Z,20200229T235960",
        "RDATE;VALUE=DATE:20200229,20240229", "FREEBUSY:20200101T000000Z/PT1H30M,20200101T000000Z/20200102T000000Z", "TZOFFSETTO:-0130", "CATEGORIES:a\\,b,c\\;d", "REQUEST-STATUS:2.0;all\\; well;x",
        F.concat(F.lit("ATTACH;VALUE=BINARY:"), F.base64(F.encode("c_name", "UTF-8"))), "URL:https://x.example/?a=1;b=2", F.concat(F.lit("ATTENDEE:mailto:"), key, F.lit("@x.example")),
        "RRULE:FREQ=DAILY;COUNT=2", F.concat(F.lit("X-B;VALUE=BOOLEAN:"), flag), "X-T;VALUE=TIME:101500", "X-U:as; it, is", F.lit("DTSTART:never"),
    )
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), body.alias("content"))
    t = lambda n: F.col(f"typed.{n}")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    held = F.coalesce(total(t("integers")), total(t("floats")), total(t("seconds")), F.size("typed.times"), F.aggregate(t("periods"), F.lit(0.0), lambda a, x: a + x["seconds"]), F.size("typed.clocks"), F.size("typed.fields"), F.length("typed.bytes"), t("flag").cast("int"), F.size("typed.texts"), F.lit(0)).cast("double")
    same = (typed.serialize_value(F.col("typed")) == F.col("value")).cast("bigint")
    found = views.values(wire.parse_documents(docs)).select(F.coalesce(t("kind"), F.lit("none")).alias("kind"), held.alias("held"), F.coalesce(same, F.lit(0)).alias("same"))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("same").alias("n_same"), F.round(F.sum("held"), 2).alias("total"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(epoch(date_trunc('second', ts) AT TIME ZONE 'Europe/Zurich') AS BIGINT) WHEN 1 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) WHEN 2 THEN CAST(epoch(date_trunc('second', ts) AT TIME ZONE 'America/New_York') AS BIGINT) ELSE -1 END AS instant FROM events")
def native_instants(spark, d):
    """Instants of values in a zone, in UTC, in a zone with a slash before it, and of floating ones, which have none."""
    k = F.col("event_id") % 4
    wall = columns.format_datetime(F.col("ts").cast("timestamp_ntz"))
    line = F.when(k == 0, F.concat(F.lit("DTSTART;TZID=Europe/Zurich:"), wall)).when(k == 1, F.concat(F.lit("DTSTART:"), wall, F.lit("Z"))).when(k == 2, F.concat(F.lit("DTSTART;TZID=/America/New_York:"), wall)).otherwise(F.concat(F.lit("DTSTART:"), wall))
    parsed = wire.parse_documents(table(spark, d, "events").select("event_id", render.component("VEVENT", line).alias("content")))
    return views.values(parsed).select("event_id", F.coalesce(columns.epoch(F.get("instants", 0)), F.lit(-1)).alias("instant"))


@query("""
    SELECT 'text' AS vtype, 'single' AS multiplicity, CAST(sum(5 + CAST(c_custkey % 3 = 0 AS INTEGER)) AS BIGINT) AS n FROM customer UNION ALL
    SELECT 'text', 'list', count(*) FROM customer UNION ALL SELECT 'text', 'structured-lists', count(*) FROM customer""")
def registry_types(spark, d):
    found = views.values(wire.parse_documents(render.cards(table(spark, d, "customer"))))
    return found.groupBy("vtype", "multiplicity").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT l_returnflag, l_linestatus, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * (CAST(l_quantity AS BIGINT) * 86400 + l_linenumber * 3600 + 5)) AS BIGINT) AS total,
           count(*) FILTER (l_linenumber = 1) AS bad FROM lineitem GROUP BY ALL""")
def duration_parse(spark, d):
    q, n = F.col("l_quantity").cast("bigint").cast("string"), F.col("l_linenumber").cast("string")
    good = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise(""), F.lit("P"), q, F.lit("DT"), n, F.lit("H5S"))
    bad = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("P"), q, F.lit("H"))).otherwise("PT0S")
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", columns.parse_duration(good).alias("s"), columns.parse_duration(bad).isNull().cast("int").alias("b"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("s").alias("total"), F.sum("b").alias("bad"))


@query("SELECT l_linenumber, CAST(CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * (l_linenumber * 3600 + 1800) AS INTEGER) AS seconds, count(*) AS n, true AS same FROM lineitem GROUP BY 1, 2")
def offset_parse(spark, d):
    value = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("30"))
    seconds = columns.parse_offset(value)
    rows = table(spark, d, "lineitem").select("l_linenumber", seconds.alias("seconds"), (columns.format_offset(seconds) == value).alias("same"))
    return rows.groupBy("l_linenumber", "seconds").agg(F.count(F.lit(1)).alias("n"), F.min("same").alias("same"))


@query("SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 90 MINUTE ELSE o_orderdate + INTERVAL 2 DAY END, '%Y-%m-%d %H:%M:%S') AS period_end, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 5400 ELSE 172800 END AS BIGINT) AS seconds FROM orders")
def period_end(spark, d):
    start = columns.format_datetime(F.col("o_orderdate"))
    value = F.concat(start, F.lit("/"), F.when(F.col("o_orderkey") % 2 == 0, "PT1H30M").otherwise(columns.format_datetime(columns.add_seconds(F.col("o_orderdate"), F.lit(172800)))))
    p = columns.parse_period(value)
    return table(spark, d, "orders").select("o_orderkey", stamp(p["end"]).alias("period_end"), p["seconds"].alias("seconds"))


# Views.


def _shaped(spark, d):
    """Events with an end, a duration, neither, or a date as their start, by key."""
    key = F.col("o_orderkey") % 4
    shape = F.when(key == 0, render.prop("DTEND", columns.format_datetime(columns.add_seconds(F.col("o_orderdate"), F.lit(7200))))).when(key == 1, "DURATION:P1DT1H")
    start = F.when(key == 3, F.concat(F.lit("DTSTART;VALUE=DATE:"), columns.format_date(F.col("o_orderdate")))).otherwise(render.prop("DTSTART", columns.format_datetime(F.col("o_orderdate"))))
    event = render.component("VEVENT", render.prop("UID", F.col("o_orderkey").cast("string")), start, shape, "SUMMARY:first\\, one", "SUMMARY:second")
    return wire.parse_documents(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), render.calendar(event).alias("content")))


SHAPES = "CASE o_orderkey % 4 WHEN 0 THEN 7200 WHEN 1 THEN 90000 WHEN 2 THEN 0 ELSE 86400 END"


@query(f"SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS uid, strftime(o_orderdate + to_seconds({SHAPES}), '%Y-%m-%d %H:%M:%S') AS event_end, CAST({SHAPES} AS BIGINT) AS seconds, 'first, one' AS summary FROM orders")
def event_end_and_duration(spark, d):
    return views.events(_shaped(spark, d)).select("doc_id", "uid", stamp(F.col("end")).alias("event_end"), F.col("duration_seconds").alias("seconds"), "summary")


@query("""
    SELECT c_custkey AS doc_id, c_name AS fn, '4.0' AS version, CASE WHEN c_custkey % 3 = 0 THEN c_custkey || '@example.com|' || c_custkey || '@example.org' ELSE c_custkey || '@example.com' END AS emails,
           c_name || '|Given,Second||Dr.|' AS n, 'work,voice,x' || c_nationkey AS tel_types, lower(c_mktsegment) || '|a,b' AS categories, 'semi;colon|"quoted"' AS note_param FROM customer""")
def card_fields(spark, d):
    parsed = wire.parse_documents(render.cards(table(spark, d, "customer")))
    props = F.col("properties")
    tel, note = views.first_of(props, "TEL"), views.first_of(props, "NOTE")
    card = views.cards(parsed).select("doc_id", "fn", "version", F.array_join("emails", "|").alias("emails"), F.array_join(F.transform("n", lambda f: F.array_join(f, ",")), "|").alias("n"))
    more = parsed.select("doc_id", F.array_join(views.param_values(tel["params"], "type"), ",").alias("tel_types"), F.array_join(F.transform(text.split_unescaped(views.first_of(props, "CATEGORIES")["value"], ","), text.unescape_text), "|").alias("categories"), F.array_join(views.param_values(note["params"], "X-P"), "|").alias("note_param"))
    return card.join(more, "doc_id")


@query("SELECT o_orderkey AS doc_id, 'DISPLAY' AS action, CAST(-900 AS BIGINT) AS trigger_seconds, CAST(o_orderkey % 7 AS BIGINT) AS priority, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS due FROM orders")
def todos_and_alarms(spark, d):
    start, due = (columns.format_datetime(x) for x in (F.col("o_orderdate"), columns.add_seconds(F.col("o_orderdate"), F.lit(3 * 86400))))
    alarm = ("BEGIN:VALARM", "ACTION:DISPLAY", "TRIGGER:-PT15M", "END:VALARM")
    todo = render.component("VTODO", render.prop("DTSTART", start), render.prop("PRIORITY", (F.col("o_orderkey") % 7).cast("string")), render.prop("DUE", due), *alarm)
    parsed = wire.parse_documents(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), render.calendar(todo).alias("content")))
    return views.todos_with_alarms(parsed).select("doc_id", "action", "trigger_seconds", "priority", stamp(F.col("due"), 10).alias("due"))


@query("SELECT o_custkey % 10 AS bucket, count(*) * 2 AS n_periods, CAST(sum(5400 + 1800) AS BIGINT) AS seconds FROM orders GROUP BY 1")
def freebusy_periods(spark, d):
    start = columns.format_datetime(F.col("o_orderdate"))
    later = columns.format_datetime(columns.add_seconds(F.col("o_orderdate"), F.lit(1800)))
    busy = render.component("VFREEBUSY", F.concat(F.lit("FREEBUSY;FBTYPE=BUSY:"), start, F.lit("/PT1H30M,"), start, F.lit("/"), later))
    parsed = wire.parse_documents(table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("bucket"), busy.alias("content")))
    return views.freebusy(parsed).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_periods"), F.sum("seconds").alias("seconds"))


@query("SELECT o_custkey AS doc_id, '-//orders//EN' AS prodid, '2.0' AS version, CAST(count(*) AS INTEGER) AS n_events, 0 AS n_timezones, 'calendar' AS view FROM orders GROUP BY 1")
def calendar_lists(spark, d):
    parsed = wire.parse_documents(render.calendars_of_customers(table(spark, d, "orders")))
    return views.calendars(parsed).select("doc_id", "prodid", "version", "n_events", "n_timezones", views.view_of(F.lit("VCALENDAR")).alias("view"))


# Recurrence.


def _series(spark, d, rule, start=None):
    orders = table(spark, d, "orders")
    at = start if start is not None else columns.format_datetime(F.col("o_orderdate"))
    return orders.select("o_orderkey", (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), at.alias("dtstart"))


def _summary(occurrences):
    return occurrences.groupBy("o_orderkey").agg(F.count("wall").alias("n"), stamp(F.min("wall"), 16).alias("first"), stamp(F.max("wall"), 16).alias("last"))


FORM = "'%Y-%m-%d %H:%M'"


@query(f"SELECT o_orderkey, 1 + o_orderkey % 20 AS n, strftime(o_orderdate, {FORM}) AS first, strftime(o_orderdate + to_days(CAST(2 * (o_orderkey % 20) AS INTEGER)), {FORM}) AS last FROM orders")
def rrule_daily_count(spark, d):
    rule = F.concat(F.lit("FREQ=DAILY;INTERVAL=2;COUNT="), (1 + F.col("o_orderkey") % 20).cast("string"))
    return _summary(recurrence.expand(_series(spark, d, rule)))


@query(f"SELECT o_orderkey, CAST(4 AS BIGINT) AS n, strftime(o_orderdate, {FORM}) AS first, strftime(o_orderdate + INTERVAL 3 DAY, {FORM}) AS last FROM orders")
def rrule_until_inclusive(spark, d):
    rule = F.concat(F.lit("FREQ=DAILY;UNTIL="), columns.format_date(columns.add_seconds(F.col("o_orderdate"), F.lit(3 * 86400))))
    return _summary(recurrence.expand(_series(spark, d, rule)))


@query(f"""
    WITH x AS (SELECT o_orderkey, o_orderdate, unnest(generate_series(0, 70)) AS k FROM orders),
    w AS (SELECT *, o_orderdate + to_days(CAST(k AS INTEGER)) AS t, CAST(o_orderdate AS DATE) - CAST(isodow(o_orderdate) % 7 AS INTEGER) AS w0 FROM x),
    c AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY t) AS r FROM w WHERE isodow(t) IN (2, 7) AND ((CAST(t AS DATE) - w0) // 7) % 2 = 0)
    SELECT o_orderkey, count(*) AS n, strftime(min(t), {FORM}) AS first, strftime(max(t), {FORM}) AS last FROM c WHERE r <= 6 GROUP BY 1""")
def rrule_weekly_byday_wkst(spark, d):
    return _summary(recurrence.expand(_series(spark, d, "FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,SU;WKST=SU;COUNT=6")))


NTH = """
    WITH x AS (SELECT o_orderkey, o_orderdate, date_trunc('month', o_orderdate) + to_months(CAST(k AS INTEGER)) AS m FROM (SELECT *, unnest(generate_series(0, {months})) AS k FROM orders)),
    days AS (SELECT *, m + to_days(CAST(j AS INTEGER)) + (o_orderdate - date_trunc('day', o_orderdate)) AS t FROM (SELECT *, unnest(generate_series(0, 30)) AS j FROM x)),
    inside AS (SELECT * FROM days WHERE date_trunc('month', t) = m AND {day}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, m ORDER BY t) AS a, row_number() OVER (PARTITION BY o_orderkey, m ORDER BY t DESC) AS z FROM inside),
    c AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY t) AS r FROM ranked WHERE {pick} AND t >= o_orderdate)
    SELECT o_orderkey, count(*) AS n, strftime(min(t), '%Y-%m-%d %H:%M') AS first, strftime(max(t), '%Y-%m-%d %H:%M') AS last FROM c WHERE r <= {count} GROUP BY 1"""


@query(NTH.format(months=8, day="isodow(t) = 5", pick="a = 2", count=5))
def rrule_monthly_nth_weekday(spark, d):
    return _summary(recurrence.expand(_series(spark, d, "FREQ=MONTHLY;BYDAY=2FR;COUNT=5")))


@query(NTH.format(months=8, day="true", pick="z = 1", count=4))
def rrule_monthly_last_day(spark, d):
    return _summary(recurrence.expand(_series(spark, d, "FREQ=MONTHLY;BYMONTHDAY=-1;COUNT=4")))


@query(NTH.format(months=8, day="isodow(t) <= 5", pick="z = 1", count=4))
def rrule_bysetpos_last_weekday(spark, d):
    return _summary(recurrence.expand(_series(spark, d, "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1;COUNT=4")))


@query("""
    WITH x AS (SELECT o_orderkey, o_orderdate, unnest(generate_series(0, 24)) AS k FROM orders),
    c AS (SELECT o_orderkey, CAST(make_date(CAST(year(o_orderdate) + k AS BIGINT), 3, 1) AS TIMESTAMP) - INTERVAL 1 DAY + (o_orderdate - date_trunc('day', o_orderdate)) AS t, o_orderdate FROM x
          WHERE (year(o_orderdate) + k) % 4 = 0 AND ((year(o_orderdate) + k) % 100 <> 0 OR (year(o_orderdate) + k) % 400 = 0)),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY t) AS n FROM c WHERE t >= o_orderdate)
    SELECT o_orderkey, count(*) AS n, strftime(min(t), '%Y-%m-%d %H:%M') AS first, strftime(max(t), '%Y-%m-%d %H:%M') AS last FROM r WHERE n <= 3 GROUP BY 1""")
def rrule_yearly_feb29(spark, d):
    return _summary(recurrence.expand(_series(spark, d, "FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29;COUNT=3")))


@query("""
    WITH x AS (SELECT o_orderkey, o_orderdate, make_date(CAST(year(o_orderdate) + k AS BIGINT), 1, 1) AS j, make_date(CAST(year(o_orderdate) + k AS BIGINT), 12, 31) AS z FROM (SELECT *, unnest(generate_series(0, 4)) AS k FROM orders)),
    c AS (SELECT o_orderkey, o_orderdate, unnest([j + 99, z - 1]) AS day FROM x),
    t AS (SELECT *, CAST(day AS TIMESTAMP) + (o_orderdate - date_trunc('day', o_orderdate)) AS t FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY t) AS n FROM t WHERE t >= o_orderdate)
    SELECT o_orderkey, count(*) AS n, strftime(min(t), '%Y-%m-%d %H:%M') AS first, strftime(max(t), '%Y-%m-%d %H:%M') AS last FROM r WHERE n <= 5 GROUP BY 1""")
def rrule_yearly_byyearday(spark, d):
    return _summary(recurrence.expand(_series(spark, d, "FREQ=YEARLY;BYYEARDAY=100,-2;COUNT=5")))


@query("""
    WITH x AS (SELECT o_orderkey, o_orderdate, date_trunc('week', o_orderdate) + to_weeks(CAST(k AS INTEGER)) + (o_orderdate - date_trunc('day', o_orderdate)) AS t FROM (SELECT *, unnest(generate_series(0, 215)) AS k FROM orders)),
    c AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY t) AS r FROM x WHERE weekofyear(t) = 20 AND t >= o_orderdate)
    SELECT o_orderkey, count(*) AS n, strftime(min(t), '%Y-%m-%d %H:%M') AS first, strftime(max(t), '%Y-%m-%d %H:%M') AS last FROM c WHERE r <= 3 GROUP BY 1""")
def rrule_yearly_byweekno(spark, d):
    return _summary(recurrence.expand(_series(spark, d, "FREQ=YEARLY;BYWEEKNO=20;BYDAY=MO;COUNT=3")))


@query("""
    WITH x AS (SELECT event_id, ts, date_trunc('second', ts) + to_hours(CAST(k AS INTEGER)) AS t FROM (SELECT *, unnest(generate_series(0, 72)) AS k FROM events)),
    c AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY t) AS r FROM x WHERE hour(t) IN (9, 17))
    SELECT event_id, count(*) AS n, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last FROM c WHERE r <= 4 GROUP BY 1""")
def rrule_hourly_byhour(spark, d):
    rows = table(spark, d, "events").select("event_id", F.lit("FREQ=HOURLY;BYHOUR=9,17;COUNT=4").alias("rule"), columns.format_datetime(F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")).alias("dtstart"))
    return recurrence.expand(rows).groupBy("event_id").agg(F.count("wall").alias("n"), stamp(F.min("wall")).alias("first"), stamp(F.max("wall")).alias("last"))


@query("SELECT o_orderkey, CAST(3 AS BIGINT) AS n, strftime(o_orderdate, '%Y-%m-%d') || ' 00:00' AS first, strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d') || ' 00:00' AS last FROM orders")
def rrule_dates(spark, d):
    return _summary(recurrence.expand(_series(spark, d, "FREQ=WEEKLY;COUNT=3", columns.format_date(F.col("o_orderdate")))))


@query("SELECT r_regionkey, CAST(0 AS BIGINT) AS tight, CAST(1 AS BIGINT) AS usual FROM region")
def empty_budget(spark, d):
    rows = table(spark, d, "region").select("r_regionkey", F.lit("FREQ=DAILY;BYMONTH=1;COUNT=1").alias("rule"), F.lit("20260201").alias("dtstart"))
    tight, usual = recurrence.expand(rows, max_empty=10), recurrence.expand(rows)
    count = lambda x, n: x.groupBy("r_regionkey").agg(F.count("wall").alias(n))
    return rows.select("r_regionkey").join(count(tight, "tight"), "r_regionkey", "left").join(count(usual, "usual"), "r_regionkey", "left").select("r_regionkey", F.coalesce("tight", F.lit(0)).cast("bigint").alias("tight"), F.coalesce("usual", F.lit(0)).cast("bigint").alias("usual"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'FREQ=MONTHLY;COUNT=' || (1 + n_nationkey) || ';INTERVAL=2;BYDAY=1MO,-1FR;BYMONTH=1,6;WKST=SU;X-Y=z' END AS canonical,
    CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE '{"freq":"MONTHLY","count":' || (1 + n_nationkey) || ',"interval":2,"wkst":"SU","byday":["1MO","-1FR"],"bymonth":[1,6],"x-y":"z"}' END AS json,
    n_nationkey % 5 = 0 AS failed FROM nation""")
def recur_canonical(spark, d):
    good = F.concat(F.lit("wkst=su;x-y=z;byday=1mo,-1FR;bymonth=1,6;interval=2;count="), (1 + F.col("n_nationkey")).cast("string"), F.lit(";freq=monthly;"))
    rows = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, "FREQ=DAILY;COUNT=1;UNTIL=20200101").otherwise(good).alias("rule"))
    return recurrence.canonical_rules(rows).select("n_nationkey", "canonical", "json", F.col("rule_error").isNotNull().alias("failed"))


@query("""
    WITH s AS (SELECT s_suppkey, CAST(DATE '2000-01-01' + CAST(s_suppkey * 37 % 4000 AS INTEGER) - DATE '0001-01-01' AS BIGINT) + 1 AS rd FROM supplier),
    y AS (SELECT *, (4 * (rd - 103605) + 1463) // 1461 AS y FROM s), o AS (SELECT *, rd - (103605 + 365 * (y - 1) + y // 4) AS doy FROM y),
    x AS (SELECT *, unnest(range(0, 1700)) AS k FROM o),
    c AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY k) AS n, 103605 + 365 * (y + k - 1) + (y + k) // 4 + doy AS rd_k FROM x WHERE doy < 365 OR (y + k) % 4 = 3)
    SELECT s_suppkey, CAST(max(n) AS BIGINT) AS n, strftime(DATE '0001-01-01' + CAST(min(rd_k) - 1 AS INTEGER), '%Y-%m-%d') AS first, strftime(DATE '0001-01-01' + CAST(max(rd_k) - 1 AS INTEGER), '%Y-%m-%d') AS last FROM c WHERE n <= 400 GROUP BY 1""")
def rrule_rscale_long(spark, d):
    """400 years of a calendar of thirteen months."""
    start = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("s_suppkey") * 37 % 4000).cast("int"))
    series = table(spark, d, "supplier").select("s_suppkey", F.lit("RSCALE=COPTIC;FREQ=YEARLY;COUNT=400").alias("rule"), columns.format_date(start).alias("dtstart"))
    return recurrence.expand(series).groupBy("s_suppkey").agg(F.count("wall").alias("n"), stamp(F.min("wall"), 10).alias("first"), stamp(F.max("wall"), 10).alias("last"))


@query("""
    WITH m AS (SELECT o_orderkey, o_orderdate, date_trunc('month', o_orderdate) + to_months(CAST(k AS INTEGER)) AS m, k FROM (SELECT *, unnest(generate_series(0, 4)) AS k FROM orders)),
    t AS (SELECT *, day(o_orderdate) AS d, day(last_day(m)) AS n FROM m),
    x AS (SELECT *, CASE WHEN d <= n THEN m + to_days(CAST(d - 1 AS INTEGER)) WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN m + to_days(CAST(n - 1 AS INTEGER)) ELSE m + to_days(CAST(n AS INTEGER)) END AS day FROM t)
    SELECT o_orderkey, string_agg(strftime(day, '%Y-%m-%d'), ' ' ORDER BY day) AS days FROM x WHERE day <= date_trunc('day', o_orderdate) + INTERVAL 100 DAY GROUP BY 1""")
def rrule_skip(spark, d):
    """Months without the wanted day: left out, moved back, moved on."""
    skip = F.element_at(F.array(F.lit("OMIT"), F.lit("BACKWARD"), F.lit("FORWARD")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    until = columns.format_date(columns.add_seconds(F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz"), F.lit(100 * 86400)))
    series = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("RSCALE=GREGORIAN;FREQ=MONTHLY;SKIP="), skip, F.lit(";UNTIL="), until).alias("rule"), columns.format_date(F.col("o_orderdate")).alias("dtstart"))
    return recurrence.expand(series).groupBy("o_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("wall")), lambda w: stamp(w, 10)), " ").alias("days"))


@query("""
    WITH x AS (SELECT o_orderkey, unnest(generate_series(0, 3)) AS k, o_orderdate + INTERVAL 570 MINUTE AS t, CASE WHEN o_orderkey % 2 = 0 THEN 'Europe/Zurich' ELSE 'America/New_York' END AS z FROM orders),
    y AS (SELECT *, t + to_weeks(CAST(k AS INTEGER)) AS w FROM x)
    SELECT o_orderkey AS doc_id, CAST(k AS BIGINT) AS seq, strftime(w, '%Y-%m-%d %H:%M:%S') AS wall, CAST(epoch(w AT TIME ZONE z) AS BIGINT) AS instant FROM y WHERE o_orderkey % 5 > 0 OR k = 0""")
def occurrences_of_events(spark, d):
    """From parsed events to instants: the start, the rule if there is one, and the zone."""
    zone = F.when(F.col("o_orderkey") % 2 == 0, "Europe/Zurich").otherwise("America/New_York")
    start = F.concat(F.lit("DTSTART;TZID="), zone, F.lit(":"), columns.format_datetime(columns.add_seconds(F.col("o_orderdate"), F.lit(570 * 60))))
    event = render.component("VEVENT", start, F.when(F.col("o_orderkey") % 5 > 0, "RRULE:FREQ=WEEKLY;COUNT=4"))
    parsed = wire.parse_documents(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), render.calendar(event).alias("content")))
    found = recurrence.occurrences(views.events(parsed))
    return found.select("doc_id", "seq", stamp(F.col("wall")).alias("wall"), columns.epoch(F.col("instant_utc")).alias("instant"))


@query("""
    WITH x AS (SELECT o_orderkey, o_orderdate + to_days(CAST(k AS INTEGER)) AS t, k FROM (SELECT *, unnest(generate_series(0, 4)) AS k FROM orders))
    SELECT o_orderkey, count(*) AS n, CAST(count(*) FILTER (k = 9) AS BIGINT) AS extra FROM (SELECT o_orderkey, k FROM x WHERE k <> 2 UNION ALL SELECT o_orderkey, 9 FROM orders) GROUP BY 1""")
def exdate_rdate(spark, d):
    found = recurrence.expand(_series(spark, d, "FREQ=DAILY;COUNT=5"))
    orders = table(spark, d, "orders")
    moved = lambda days: orders.select("o_orderkey", columns.add_seconds(F.col("o_orderdate"), F.lit(days * 86400)).alias("wall"))
    left = recurrence.without(found, moved(2), ["o_orderkey"])
    both = recurrence.along(left, moved(9), ["o_orderkey"]).join(moved(9).withColumnRenamed("wall", "late"), "o_orderkey")
    return both.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("wall") == F.col("late")).cast("bigint")).alias("extra"))


# Zones.


@query("SELECT event_id, CAST(epoch(date_trunc('second', ts) AT TIME ZONE 'Europe/Zurich') AS BIGINT) AS zurich, CAST(epoch(date_trunc('second', ts) AT TIME ZONE 'America/New_York') AS BIGINT) AS new_york FROM events")
def zone_wall_to_utc(spark, d):
    wall = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    at = lambda z: columns.epoch(F.convert_timezone(F.lit(z), F.lit("UTC"), wall))
    return table(spark, d, "events").select("event_id", at("Europe/Zurich").alias("zurich"), at("America/New_York").alias("new_york"))


@query("""
    WITH x AS (SELECT event_id, date_trunc('second', ts) AS t, unnest(range(0, 5)) AS k FROM events), y AS (SELECT *, (t + to_days(CAST(k AS INTEGER))) AS w FROM x)
    SELECT event_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(epoch(w AT TIME ZONE 'Europe/Zurich')) AS BIGINT) AS instants FROM y GROUP BY 1""")
def expand_dst_zurich(spark, d):
    wall = columns.format_datetime(F.col("ts").cast("timestamp_ntz"))
    rows = table(spark, d, "events").select("event_id", F.lit("Europe/Zurich").alias("tzid"), F.lit("FREQ=DAILY;COUNT=5").alias("rule"), wall.alias("dtstart"))
    return recurrence.expand_zoned(rows).groupBy("event_id").agg(F.count("wall").alias("n"), F.sum(columns.epoch(F.col("instant_utc"))).alias("instants"))


ZONE = "BEGIN:VTIMEZONE\r\nTZID:Custom\r\nBEGIN:STANDARD\r\nDTSTART:19701101T030000\r\nRRULE:FREQ=YEARLY;BYMONTH=11;BYDAY=1SU\r\nTZOFFSETFROM:+0230\r\nTZOFFSETTO:+0130\r\nTZNAME:CST\r\nEND:STANDARD\r\nBEGIN:DAYLIGHT\r\nDTSTART:19700301T020000\r\nRRULE:FREQ=YEARLY;BYMONTH=3;BYDAY=1SU\r\nTZOFFSETFROM:+0130\r\nTZOFFSETTO:+0230\r\nTZNAME:CDT\r\nEND:DAYLIGHT\r\nEND:VTIMEZONE\r\n"
CUSTOM = """
    WITH x AS (SELECT *, make_date(CAST(year(o_orderdate) AS BIGINT), 3, 1) AS m, make_date(CAST(year(o_orderdate) AS BIGINT), 11, 1) AS v FROM orders),
    y AS (SELECT *, CAST(m + CAST((7 - isodow(m)) AS INTEGER) AS TIMESTAMP) + INTERVAL 3 HOUR AS spring, CAST(v + CAST((7 - isodow(v)) AS INTEGER) AS TIMESTAMP) + INTERVAL 3 HOUR AS autumn FROM x)
    SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) - CASE WHEN o_orderdate >= spring AND o_orderdate < autumn THEN 9000 ELSE 5400 END AS instant, CASE WHEN o_orderdate >= spring AND o_orderdate < autumn THEN 'CDT' ELSE 'CST' END AS name,
           CAST(CASE WHEN o_orderdate >= spring AND o_orderdate < autumn THEN 3600 ELSE 0 END AS INTEGER) AS dst FROM y"""


def _custom_zone(spark):
    docs = spark.createDataFrame([(1, f"BEGIN:VCALENDAR\r\n{ZONE}END:VCALENDAR\r\n")], "zone_doc int, content string")
    return zones.transition_tables(wire.parse_documents(docs, strict=True), ["zone_doc"])


@query(CUSTOM)
def vtimezone_asof(spark, d):
    rows = table(spark, d, "orders").withColumn("tzid", F.lit("Custom")).join(F.broadcast(_custom_zone(spark)), "tzid")
    found = zones.offset_at_wall(F.col("transitions"), F.col("o_orderdate"))
    return rows.select("o_orderkey", (columns.epoch(F.col("o_orderdate")) - found["offset_s"]).alias("instant"), found["name"].alias("name"), found["dst_s"].alias("dst"))


FOLDS = """
    WITH x AS (SELECT o_orderkey, make_date(CAST(year(o_orderdate) AS BIGINT), 11, 1) AS v, o_orderkey % 180 - 60 AS m FROM orders),
    y AS (SELECT *, CAST(v + CAST((7 - isodow(v)) AS INTEGER) AS TIMESTAMP) + INTERVAL 30 MINUTE + to_minutes(CAST(m AS INTEGER)) AS t FROM x)
    SELECT o_orderkey, strftime(t + to_minutes(CASE WHEN m < 0 THEN 150 ELSE 90 END), '%Y-%m-%d %H:%M:%S') AS wall, CAST(m >= 0 AND m < 60 AS INTEGER) AS fold, true AS back FROM y"""


@query(FOLDS)
def vtimezone_from_utc(spark, d):
    """Instants around the end of daylight saving: wall times that occur twice have fold 1 the second time, and go back."""
    november = F.make_date(F.year("o_orderdate"), F.lit(11), F.lit(1))
    sunday = F.date_add(november, F.pmod(F.lit(8) - F.dayofweek(november), F.lit(7)))
    at = columns.add_seconds(sunday.cast("timestamp_ntz"), F.lit(1800) + (F.col("o_orderkey") % 180 - 60) * 60)
    orders = table(spark, d, "orders").withColumn("tzid", F.lit("Custom"))
    rows = columns.step(orders.join(F.broadcast(_custom_zone(spark)), "tzid"), at=at)
    found = columns.step(rows, back=zones.from_utc(F.col("transitions"), F.col("at")))
    offset = F.when(F.col("back.fold") == 1, zones.offset_at_wall(F.col("transitions"), F.col("back.wall"), 1)["offset_s"]).otherwise(zones.offset_at_wall(F.col("transitions"), F.col("back.wall"))["offset_s"])
    return found.select("o_orderkey", stamp(F.col("back.wall")).alias("wall"), F.col("back.fold").alias("fold"), (columns.add_seconds(F.col("back.wall"), -offset) == F.col("at")).alias("back"))


@query(f"""
    WITH c AS ({CUSTOM})
    SELECT o.o_orderkey, CASE o.o_orderkey % 4 WHEN 0 THEN 'host' WHEN 3 THEN 'unresolved' ELSE 'document' END AS source, o.o_orderkey % 4 = 3 AS warned,
           CASE o.o_orderkey % 4 WHEN 0 THEN CAST(epoch(o_orderdate) AS BIGINT) - 32400 WHEN 3 THEN -1 ELSE c.instant END AS instant FROM orders o JOIN c USING (o_orderkey)""")
def zone_precedence(spark, d):
    key = F.col("o_orderkey") % 4
    rows = table(spark, d, "orders").select("o_orderkey", F.lit(1).alias("zone_doc"), F.col("o_orderdate").alias("wall"), F.when(key == 0, "/Asia/Tokyo").when(key == 1, "Custom").when(key == 2, "/Custom").otherwise("Nowhere").alias("tzid"))
    found = zones.resolve(rows, _custom_zone(spark), ["zone_doc"])
    return found.select("o_orderkey", "source", F.col("warning").isNotNull().alias("warned"), F.coalesce(columns.epoch(F.col("instant_utc")), F.lit(-1)).alias("instant"))


@query("SELECT o_custkey AS doc_id, 'Z' || (o_orderkey % 3) AS tzid, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_wall, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_wall, count(*) AS n_times FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2")
def missing_tzids(spark, d):
    start = F.concat(F.lit("X-AT;TZID=Z"), (F.col("o_orderkey") % 3).cast("string"), F.lit(":"), columns.format_datetime(F.col("o_orderdate")))
    docs = render.calendars_of_customers(table(spark, d, "orders"), render.component("VEVENT", start))
    content = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VTIMEZONE\r\nTZID:Z0\r\nEND:VTIMEZONE\r\n"), F.regexp_replace("content", "^BEGIN:VCALENDAR\r\n", ""))
    found = zones.missing_zones(wire.parse_documents(docs.select("doc_id", content.alias("content"))), ["doc_id"])
    return found.select("doc_id", "tzid", stamp(F.col("first_wall")).alias("first_wall"), stamp(F.col("last_wall")).alias("last_wall"), "n_times")


ZONES3 = "CASE o_orderkey % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Asia/Tokyo' ELSE 'Europe/Zurich' END"


def _zoned_orders(spark, d):
    zone = F.element_at(F.array(F.lit("America/New_York"), F.lit("Asia/Tokyo"), F.lit("Europe/Zurich")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", zone.alias("tzid"), "o_orderdate")


def _spans(spark, d):
    year = F.lit(366 * 86400)
    return _zoned_orders(spark, d).groupBy("tzid").agg(columns.add_seconds(F.min("o_orderdate"), -year).alias("first_wall"), columns.add_seconds(F.max("o_orderdate"), year).alias("last_wall"))


@query(f"""
    WITH s AS (SELECT {ZONES3} AS tzid, min(o_orderdate) - INTERVAL 366 DAY AS a, max(o_orderdate) + INTERVAL 366 DAY AS z FROM orders GROUP BY 1),
    p AS (SELECT tzid, unnest(generate_series(a, z, INTERVAL 1 DAY)) AS t FROM s),
    o AS (SELECT tzid, t, CAST(epoch(timezone(tzid, timezone('UTC', t))) - epoch(t) AS INTEGER) AS off FROM p),
    c AS (SELECT tzid, lag(off) OVER (PARTITION BY tzid ORDER BY t) AS before_s, off AS after_s FROM o),
    g AS (SELECT tzid, before_s, after_s, count(*) AS n FROM c WHERE before_s <> after_s GROUP BY ALL)
    SELECT tzid, CASE WHEN after_s > before_s THEN 'DAYLIGHT' ELSE 'STANDARD' END AS kind, n AS n_onsets, before_s, after_s FROM g
    UNION ALL SELECT DISTINCT tzid, 'STANDARD', 1, off, off FROM o WHERE tzid NOT IN (SELECT tzid FROM g)""")
def vtimezone_groups(spark, d):
    groups = zones.zone_groups(_spans(spark, d))
    return groups.select("tzid", F.when(F.col("is_daylight"), "DAYLIGHT").otherwise("STANDARD").alias("kind"), F.size("onsets").cast("bigint").alias("n_onsets"), "before_s", "after_s")


@query(f"SELECT o_orderkey, {ZONES3} AS tzid, CAST(epoch(timezone({ZONES3}, o_orderdate)) AS BIGINT) AS instant FROM orders")
def vtimezone_generated(spark, d):
    """Definitions made from the host's zones, parsed again, place wall times as the host does."""
    made = zones.definitions(_spans(spark, d)).select(F.col("tzid").alias("zone_doc"), "content")
    tables = zones.transition_tables(wire.parse_documents(made, strict=True), ["zone_doc"])
    rows = columns.step(_zoned_orders(spark, d).join(F.broadcast(tables.select("tzid", "transitions")), "tzid"), o=zones.offset_at_wall(F.col("transitions"), F.col("o_orderdate"))["offset_s"])
    return rows.select("o_orderkey", "tzid", (columns.epoch(F.col("o_orderdate")) - F.col("o")).alias("instant"))


@query(f"""
    SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE {ZONES3} END AS added, CASE WHEN o_orderkey % 4 = 3 THEN 'VEVENT' ELSE 'VTIMEZONE' END AS first_component,
           o_orderkey % 4 = 3 AS warned, CAST(0 AS BIGINT) AS still_missing, CASE WHEN o_orderkey % 4 <> 3 AND o_orderkey % 3 = 1 THEN 'TZID:Asia/Tokyo DTSTART:' || strftime(o_orderdate - INTERVAL 366 DAY + INTERVAL 9 HOUR, '%Y%m%dT%H%M%S') || ' TZOFFSETFROM:+0900 TZOFFSETTO:+0900 TZNAME:JST' END AS tokyo FROM orders""")
def add_missing_zones(spark, d):
    """Calendars that name zones without defining them get definitions before their first component."""
    key = F.col("o_orderkey")
    rows = _zoned_orders(spark, d)
    start = F.concat(F.lit("DTSTART;TZID="), F.when(key % 4 == 3, "Nowhere/Else").otherwise(F.col("tzid")), F.lit(":"), columns.format_datetime(F.col("o_orderdate")))
    docs = rows.select(key.alias("doc_id"), render.calendar(render.component("VEVENT", start)).alias("content"))
    grown = zones.add_missing_timezones(wire.parse_documents(docs))
    again = wire.parse_documents(emit.write_wire(grown), strict=True)
    missing = F.size(F.filter("properties", lambda p: (p["name_uc"] == "DTSTART") & (F.size(p["params"]) > 0) & ~F.exists("properties", lambda q: (q["name_uc"] == "TZID") & (q["value"] == F.get(F.get(p["params"], 0)["values"], 0))) & ~p["params"].cast("string").contains("Nowhere")))
    first = F.get(F.filter("components", lambda c: c["comp_id"] == 1), 0)["name"]
    inside = F.filter("properties", lambda p: p["comp_id"].isin(1, 2))
    tokyo = F.when(F.exists("properties", lambda p: (p["name_uc"] == "TZID") & (p["value"] == "Asia/Tokyo")), F.array_join(F.transform(inside, lambda p: F.concat(p["name"], F.lit(":"), p["value"])), " "))
    return again.select("doc_id", F.array_join("added", " ").alias("added"), first.alias("first_component"), (F.size("zone_warnings") > 0).alias("warned"), missing.cast("bigint").alias("still_missing"), tokyo.alias("tokyo"))


@query("""SELECT o_orderkey AS doc_id, CAST(epoch(o_orderdate + INTERVAL 12 HOUR) - epoch(timezone('Europe/Zurich', o_orderdate + INTERVAL 10 HOUR)) AS BIGINT) AS seconds, CAST(epoch(timezone('Europe/Zurich', o_orderdate + INTERVAL 10 HOUR)) AS BIGINT) AS start_utc,
    CAST(epoch(o_orderdate + INTERVAL 12 HOUR) AS BIGINT) AS end_utc FROM orders""")
def duration_between_zones(spark, d):
    """A start in a zone and an end in UTC: what elapses, not the difference of the clocks."""
    at = lambda h: columns.format_datetime(columns.add_seconds(F.col("o_orderdate"), F.lit(h * 3600)))
    event = render.component("VEVENT", F.concat(F.lit("DTSTART;TZID=Europe/Zurich:"), at(10)), F.concat(F.lit("DTEND:"), at(12), F.lit("Z")))
    parsed = wire.parse_documents(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), render.calendar(event).alias("content")))
    return views.events(parsed).select("doc_id", F.col("duration_seconds").alias("seconds"), columns.epoch(F.col("start_utc")).alias("start_utc"), columns.epoch(F.col("end_utc")).alias("end_utc"))


# Writing.


@query("SELECT c_custkey AS doc_id, true AS same, 1 AS n_roots FROM customer")
def wire_roundtrip(spark, d):
    docs = render.cards(table(spark, d, "customer"))
    first = wire.parse_documents(docs)
    again = wire.parse_documents(emit.write_wire(first), strict=True)
    roots = again.select("doc_id", F.size("components").alias("n_roots"))
    return views.same_documents(first, again, ["doc_id"]).join(roots, "doc_id")


@query("SELECT s_suppkey AS doc_id, 'BEGIN:VCARD' || chr(13) || chr(10) || 'VERSION:4.0' || chr(13) || chr(10) || 'FN;LANGUAGE=en;X-Q=\"a:b\":' || s_name || chr(13) || chr(10) || 'END:VCARD' || chr(13) || chr(10) AS content FROM supplier")
def write_wire(spark, d):
    body = render.component("VCARD", "VERSION:4.0", F.concat(F.lit('FN;language=en;X-Q="a:b":'), "s_name"))
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.replace(body, F.lit("language"), F.lit("LANGUAGE")).alias("content"))
    return emit.write_wire(wire.parse_documents(docs))


@query("""SELECT s_suppkey AS doc_id, '["vcard",[["version",{},"text","4.0"],["fn",{"language":"en"},"text","' || s_name || '"],["n",{},"text",["' || s_name || '","",["a","b"],"",""]],["tel",{"type":["work","voice"]},"uri","tel:+' || s_nationkey || '"],["rev",{},"timestamp","2020-01-02T03:04:05Z"],["x-acct",{},"unknown","' || CAST(CAST(s_acctbal AS DECIMAL(12, 2)) AS VARCHAR) || '"]],[]]' AS jcal FROM supplier""")
def to_jcal(spark, d):
    return jcal.write_jcal(wire.parse_documents(_supplier_cards(spark, d)))


def _supplier_cards(spark, d):
    body = render.component(
        "VCARD",
        "VERSION:4.0",
        F.concat(F.lit("FN;LANGUAGE=en:"), "s_name"),
        F.concat(F.lit("N:"), "s_name", F.lit(";;a,b;;")),
        F.concat(F.lit("TEL;VALUE=uri;TYPE=work,voice:tel:+"), F.col("s_nationkey").cast("string")),
        "REV:20200102T030405Z",
        F.concat(F.lit("X-ACCT:"), F.col("s_acctbal").cast("decimal(12,2)").cast("string")),
    )
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), body.alias("content"))


WIRE = """SELECT o_orderkey AS doc_id, 'BEGIN:VCALENDAR' || e || 'VERSION:2.0' || e || 'PRODID:-//orders//EN' || e || 'BEGIN:VEVENT' || e || 'UID:' || o_orderkey || e || 'DTSTART:' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || e
    || 'SUMMARY:' || o_orderpriority || '\\, ' || o_orderstatus || e || {} || 'END:VEVENT' || e || 'END:VCALENDAR' || e AS content FROM (SELECT *, chr(13) || chr(10) AS e FROM orders)"""


@query(WIRE.format("'RRULE:FREQ=WEEKLY;COUNT=3;BYDAY=MO,TU' || e || 'GEO:1.5;2' || e || 'EXDATE;VALUE=DATE:20200101,20200102' || e || 'DURATION:PT1H' || e"))
def jcal_roundtrip(spark, d):
    """Wire text to JSON, read again and written as wire text: what SQL writes directly."""
    first = jcal.write_jcal(wire.parse_documents(render.calendars_of_orders(table(spark, d, "orders"), "RRULE:FREQ=WEEKLY;BYDAY=MO,TU;COUNT=3", "GEO:1.5;2", "EXDATE;VALUE=DATE:20200101,20200102", "DURATION:PT1H")))
    return emit.write_wire(jcal.read_jcal(first)).select("doc_id", "content")


@query("""SELECT s_suppkey AS doc_id, '<?xml version="1.0" encoding="utf-8"?><vcards xmlns="urn:ietf:params:xml:ns:vcard-4.0"><vcard><version><text>4.0</text></version><fn><parameters><language><text>en</text></language></parameters><text>' || s_name || '</text></fn><n><surname>' || s_name || '</surname><given/><additional>a</additional><additional>b</additional><prefix/><suffix/></n><tel><parameters><type><text>work</text><text>voice</text></type></parameters><uri>tel:+' || s_nationkey || '</uri></tel><rev><timestamp>2020-01-02T03:04:05Z</timestamp></rev><x-acct><unknown>' || CAST(CAST(s_acctbal AS DECIMAL(12, 2)) AS VARCHAR) || '</unknown></x-acct></vcard></vcards>' AS xcal FROM supplier""")
def to_xcal(spark, d):
    return xcal.write_xcal(wire.parse_documents(_supplier_cards(spark, d)))


@query(WIRE.format("'RRULE:FREQ=MONTHLY;COUNT=3;BYMONTHDAY=1,-1' || e || 'GEO:1.5;2' || e || 'REQUEST-STATUS:2.0;Success' || e || 'FREEBUSY:20200101T000000Z/PT1H' || e"))
def xcal_roundtrip(spark, d):
    """Wire text to XML, read again and written as wire text: what SQL writes directly."""
    first = xcal.write_xcal(wire.parse_documents(render.calendars_of_orders(table(spark, d, "orders"), "RRULE:FREQ=MONTHLY;BYMONTHDAY=1,-1;COUNT=3", "GEO:1.5;2", "REQUEST-STATUS:2.0;Success", "FREEBUSY:20200101T000000Z/PT1H")))
    return emit.write_wire(xcal.read_xcal(first)).select("doc_id", "content")


# Editing.


@query("SELECT o_orderkey AS doc_id, o_orderpriority || ', new; line' AS summary, 'added' AS location, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS start, 'Europe/Zurich' AS tzid, 'FREQ=DAILY;COUNT=2' AS rule, 'https://x.example/a,b' AS url FROM orders")
def set_properties(spark, d):
    orders = table(spark, d, "orders")
    parsed = wire.parse_documents(orders.select("o_orderkey", "o_orderpriority", "o_orderdate", F.col("o_orderkey").alias("doc_id"), render.calendar(render.order_event()).alias("content")))
    changed = edit.set_text(parsed, "VEVENT", "SUMMARY", F.concat("o_orderpriority", F.lit(", new; line")))
    changed = edit.set_text(changed, "VEVENT", "LOCATION", F.lit("added"))
    changed = edit.set_datetime(changed, "VEVENT", "DTSTART", columns.add_seconds(F.col("o_orderdate"), F.lit(86400)), F.lit("Europe/Zurich"))
    changed = edit.set_url(edit.set_rule(changed, "VEVENT", F.lit("FREQ=DAILY;COUNT=2")), "VEVENT", F.lit("https://x.example/a,b"))
    again = wire.parse_documents(emit.write_wire(changed.select("doc_id", "components", "properties", "repairs", "error")), strict=True)
    p = F.col("properties")
    start = views.time_of(p, "DTSTART")
    return again.select("doc_id", views.text_of(p, "SUMMARY").alias("summary"), views.text_of(p, "LOCATION").alias("location"), stamp(start["wall"]).alias("start"), start["tzid"].alias("tzid"), views.first_of(p, "RRULE")["value"].alias("rule"), views.first_of(p, "URL")["value"].alias("url"))


@query("SELECT o_orderkey AS doc_id, 'DISPLAY' AS action, CAST(2 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS n_summaries FROM orders")
def add_alarm(spark, d):
    parsed = wire.parse_documents(render.calendars_of_orders(table(spark, d, "orders")))
    changed = edit.drop_properties(edit.add_component(parsed, "VALARM", [("ACTION", F.lit("DISPLAY")), ("TRIGGER", F.lit("-PT5M"))], "VEVENT"), "SUMMARY")
    again = wire.parse_documents(emit.write_wire(changed), strict=True)
    depth = F.array_max(F.transform("components", lambda c: c["depth"])).cast("bigint")
    return again.select("doc_id", views.first_of(F.col("properties"), "ACTION")["value"].alias("action"), depth.alias("depth"), F.size(views.all_of(F.col("properties"), "SUMMARY")).cast("bigint").alias("n_summaries"))
