"""Views, typed values, zones and edits: cases beside the queries."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from daybook.functions import columns, typed
from daybook.operators import edit, emit, jcal, views, xcal, zones
from daybook.sources import wire

EVENT = "BEGIN:VCALENDAR\r\n{zones}BEGIN:VEVENT\r\n{lines}END:VEVENT\r\nEND:VCALENDAR\r\n"


def parsed(spark, *texts):
    return wire.parse_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string"))


def event(*lines, zones=""):
    return EVENT.format(zones=zones, lines="".join(x + "\r\n" for x in lines))


@pytest.mark.parametrize(
    "lines,seconds",
    [
        (["DTSTART;TZID=Europe/Zurich:20230601T100000", "DTEND:20230601T090000Z"], 3600),
        (["DTSTART;TZID=Europe/Zurich:20230326T010000", "DTEND;TZID=Europe/Zurich:20230326T040000"], 10800),  # one clock: as it shows
        (["DTSTART;TZID=/America/New_York:20230601T100000", "DTEND;TZID=Asia/Tokyo:20230602T000000"], 3600),
        (["DTSTART:20230601T100000Z", "DTEND;TZID=Etc/UTC:20230601T110000"], 3600),
        (["DTSTART;TZID=Nowhere:20230601T100000", "DTEND:20230601T110000Z"], None),
        (["DTSTART;TZID=Nowhere:20230601T100000", "DTEND;TZID=Nowhere:20230601T110000"], 3600),
        (["DTSTART:20230601T100000", "DTEND:20230601T110000Z"], None),
        (["DTSTART;VALUE=DATE:20230601", "DTEND;VALUE=DATE:20230603"], 172800),
        (["DTSTART;VALUE=DATE:20230601", "DTEND:20230603T000000"], None),
        (["DTSTART;VALUE=DATE:20230601"], 86400),
        (["DTSTART:20230601T100000", "DURATION:-PT15M"], -900),
        (["DTEND:20230601T100000"], None),
    ],
)
def test_how_long_an_event_is(spark, lines, seconds):
    assert views.events(parsed(spark, event(*lines))).first().duration_seconds == seconds


def test_properties_of_a_large_calendar_in_linear_time(spark):
    def took(n):
        body = "".join(f"BEGIN:VEVENT\r\nUID:{k}\r\nDTSTART:20200101T000000\r\nSUMMARY:s{k}\r\nBEGIN:VALARM\r\nACTION:A{k}\r\nEND:VALARM\r\nEND:VEVENT\r\n" for k in range(n))
        rows = parsed(spark, f"BEGIN:VCALENDAR\r\n{body}X-LAST:1\r\nEND:VCALENDAR\r\n").cache()
        rows.count()
        began = time.perf_counter()
        assert views.events(rows).where("uid = substring(summary, 2)").count() == n
        assert views.alarms(rows).where("action LIKE 'A%'").count() == n
        assert views.calendars(rows).first().n_events == n
        return time.perf_counter() - began

    took(10)
    assert took(20_000) < 25 * max(took(2_000), 0.4)


def test_todos_with_alarms_are_the_join_of_both(spark):
    alarm = lambda k, more="": f"BEGIN:VALARM\r\nACTION:A{k}\r\nTRIGGER:-PT{k}M\r\n{more}END:VALARM\r\n"
    todo = lambda k, body: f"BEGIN:vtodo\r\nUID:u{k}\r\nDTSTART:20200101T000000\r\n{body}DUE:2020010{k}T000000\r\nPRIORITY:{k}\r\nEND:VTODO\r\n"
    texts = [
        "BEGIN:VCALENDAR\r\n" + todo(1, alarm(1) + alarm(2)) + todo(2, "") + "BEGIN:VEVENT\r\n" + alarm(3) + todo(3, alarm(4, alarm(5))) + "END:VEVENT\r\n" + alarm(6) + "END:VCALENDAR\r\n",
        alarm(7) + todo(4, "BEGIN:X\r\n" + alarm(8) + "END:X\r\n" + alarm(9)),
        "", None, "BEGIN:VCALENDAR\r\nEND:VCALENDAR\r\n",
    ]
    rows = parsed(spark, *texts)
    names = ["doc_id", "comp_id", "uid", "priority", "due", "action", "trigger_seconds", "trigger_at"]
    held = views.alarms(rows).select("doc_id", F.col("parent_id").alias("comp_id"), "action", "trigger_seconds", "trigger_at")
    joined = views.todos(rows).join(held, ["doc_id", "comp_id"]).select(*names).collect()
    ours = views.todos_with_alarms(rows).select(*names).collect()
    assert sorted(map(repr, ours)) == sorted(map(repr, joined)) and [(r.uid, r.action) for r in sorted(ours)] == [("u1", "A1"), ("u1", "A2"), ("u3", "A4"), ("u4", "A9")]


def test_todos_with_alarms_in_linear_time(spark):
    def took(n):
        body = "".join(f"BEGIN:VTODO\r\nUID:{k}\r\nBEGIN:VALARM\r\nACTION:{k}\r\nEND:VALARM\r\nEND:VTODO\r\n" for k in range(n))
        rows = parsed(spark, f"BEGIN:VCALENDAR\r\n{body}END:VCALENDAR\r\n").cache()
        rows.count()
        began = time.perf_counter()
        assert views.todos_with_alarms(rows).where("uid = action").count() == n
        return time.perf_counter() - began

    took(10)
    assert took(20_000) < 25 * max(took(2_000), 0.4)


def test_views_of_roots(spark):
    text = "BEGIN:VCALENDAR\r\nBEGIN:VCALENDAR\r\nEND:VCALENDAR\r\nEND:VCALENDAR\r\nBEGIN:X\r\nBEGIN:VCARD\r\nFN:in\r\nEND:VCARD\r\nEND:X\r\nBEGIN:VCARD\r\nVERSION:3.0\r\nFN:a\r\nBDAY:20200101\r\nEND:VCARD\r\nBEGIN:VCARD\r\nVERSION:4.0\r\nFN:b\r\nBDAY:--0203\r\nEND:VCARD\r\n"
    rows = parsed(spark, text, None, "")
    assert views.calendars(rows).count() == 1 and [r.fn for r in views.cards(rows).orderBy("comp_id").collect()] == ["a", "b"]
    kinds = {r.value: (r.dialect, r.vtype, r.typed.kind) for r in views.values(rows).where("name_uc = 'BDAY'").collect()}
    assert kinds == {"20200101": ("vcard3", "date", "date"), "--0203": ("vcard4", "date-and-or-time", "text")}


@pytest.mark.parametrize("line", ["PRIORITY:1.5", "GEO:a;b", "DURATION:PT", "DTSTART:20230230", "TZOFFSETTO:-0000", "RRULE:FREQ=DAILY;BYDAY=XX", "ATTACH;VALUE=BINARY:a*", "X-B;VALUE=BOOLEAN:yes", "X-T;VALUE=TIME:250000", "FREEBUSY:20200101/PT1H", "X-I;VALUE=INTEGER:99999999999999999999"])
def test_values_that_are_none(spark, line):
    row = views.values(parsed(spark, event(line))).first()
    assert row.typed is None and row.value_error.startswith("invalid ")


def test_floats_are_written_without_exponents(spark):
    rows = spark.createDataFrame([(x,) for x in (1.0, -2.5, 1e-7, 123456789.25, 1e15, 0.1)], "x double").select("x", typed.format_float(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in rows} == {1.0: "1", -2.5: "-2.5", 1e-7: "0.0000001", 123456789.25: "123456789.25", 1e15: "1000000000000000", 0.1: "0.1"}


def test_definitions_of_zones(spark):
    rows = [("Asia/Tokyo", "2020-01-01", "2021-01-01"), ("Asia/Pyongyang", "2018-01-01", "2019-01-01"), ("Nowhere", "2020-01-01", "2021-01-01"), ("/Europe/Zurich", "2023-01-01", "2024-12-31"), (None, "2020-01-01", "2021-01-01")]
    spans = spark.createDataFrame(rows, "tzid string, a string, b string").select("tzid", F.col("a").cast("timestamp_ntz").alias("first_wall"), F.col("b").cast("timestamp_ntz").alias("last_wall"))
    text = {r.tzid: r.content for r in zones.definitions(spans).collect()}
    assert text["Nowhere"] is None and text[None] is None
    # What these zones did, by the time zone database.
    assert text["Asia/Tokyo"] == "BEGIN:VTIMEZONE\r\nTZID:Asia/Tokyo\r\nBEGIN:STANDARD\r\nDTSTART:20200101T090000\r\nTZOFFSETFROM:+0900\r\nTZOFFSETTO:+0900\r\nTZNAME:JST\r\nEND:STANDARD\r\nEND:VTIMEZONE\r\n"
    assert "BEGIN:STANDARD\r\nDTSTART:20180504T233000\r\nTZOFFSETFROM:+0830\r\nTZOFFSETTO:+0900\r\nTZNAME:KST\r\n" in text["Asia/Pyongyang"] and "DAYLIGHT" not in text["Asia/Pyongyang"]
    assert "BEGIN:DAYLIGHT\r\nDTSTART:20230326T020000\r\nTZOFFSETFROM:+0100\r\nTZOFFSETTO:+0200\r\nTZNAME:CEST\r\nRDATE:20240331T020000\r\n" in text["/Europe/Zurich"]


def test_zones_of_a_document(spark):
    part = "BEGIN:{k}\r\nDTSTART:{at}\r\nTZOFFSETFROM:{a}\r\nTZOFFSETTO:{b}\r\nEND:{k}\r\n"
    own = "BEGIN:VTIMEZONE\r\nTZID:Mine\r\n" + part.format(k="STANDARD", at="20000101T000000", a="+0100", b="+0500") + "END:VTIMEZONE\r\n"
    again = own.replace("+0500", "+0700")
    broken = own.replace("Mine", "Broken").replace("TZOFFSETTO:+0500\r\n", "")
    rows = parsed(spark, event("DTSTART;TZID=/Mine:20230601T100000", "DTEND;TZID=Broken:20230601T100000", "X;TZID=Nowhere:20230601T100000", "DUE;TZID=/Europe/Zurich:20990601T100000", zones=own + again + broken))
    tables = zones.transition_tables(rows, ["doc_id"])
    found = {r.tzid: r.transitions for r in tables.collect()}
    assert set(found) == {"Mine"} and [t.after_s for t in found["Mine"]] == [18000]  # the first definition stays
    warned = {(r.tzid, r.warning.split(" '")[0]) for r in zones.zone_warnings(rows, ["doc_id"]).collect()}
    assert warned == {("Broken", "ignoring malformed VTIMEZONE"), ("Broken", "TZID"), ("Nowhere", "TZID")}
    times = zones.used_spans(rows, ["doc_id"]).select("doc_id", "tzid", F.col("first_wall").alias("wall"), "first_seen")
    got = {r.tzid: (r.source, r.instant_utc, r.warning is not None) for r in zones.resolve(times, tables, ["doc_id"]).collect()}
    assert got == {"/Mine": ("document", datetime(2023, 6, 1, 5), False), "Broken": ("unresolved", None, True), "Nowhere": ("unresolved", None, True), "/Europe/Zurich": ("host", datetime(2099, 6, 1, 8), False)}
    assert [r.tzid for r in times.orderBy("first_seen").collect()] == ["/Mine", "Broken", "Nowhere", "/Europe/Zurich"]
    assert rows.select(zones.horizons(rows)).first()[0] == 2109


def test_edits(spark):
    rows = parsed(spark, event("UID:a", "DTSTART;TZID=X;X-P=1:20200101T000000"))
    with pytest.raises(Exception, match="invalid rule"):
        edit.set_rule(rows, "VEVENT", F.lit("FREQ=DAILY;INTERVAL=0;BYDAY=XX")).collect()
    changed = edit.set_status(edit.set_uid(edit.set_rule(rows, "VEVENT", F.lit("FREQ=DAILY;COUNT=2")), "VEVENT", F.lit("b;c")), "VEVENT", F.lit("CONFIRMED"))
    changed = edit.set_instant(changed, "VEVENT", "DTSTART", F.lit("2020-01-01 10:00:00").cast("timestamp_ntz"), F.lit(-18000))
    text = emit.write_wire(changed).first().content
    assert "UID:b\\;c\r\n" in text and "DTSTART;X-P=1:20200101T150000Z\r\n" in text and "RRULE:FREQ=DAILY;COUNT=2\r\nSTATUS:CONFIRMED\r\n" in text
    todo = parsed(spark, "BEGIN:VTODO\r\nEND:VTODO\r\n")
    assert "DUE;VALUE=DATE:20200102\r\n" in emit.write_wire(edit.set_due(todo, F.lit("2020-01-02 00:00:00").cast("timestamp_ntz"), is_date=F.lit(True))).first().content


def test_json_as_text_and_as_variant(spark):
    text = '["vcalendar",[],[["vevent",[["uid",{},"text","a"],["priority",{},"integer",5],["geo",{},"float",[1.5,2]],["x-y",{},"boolean",true]],[]]]]'
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, jcal string")
    from_text = jcal.read_jcal(docs)
    from_variant = jcal.read_jcal(docs.select("doc_id", F.parse_json("jcal").alias("jcal")))
    wire_of = lambda rows: {r.doc_id: r.content for r in emit.write_wire(rows).collect()}
    assert wire_of(from_text) == wire_of(from_variant) == {1: "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:a\r\nPRIORITY:5\r\nGEO:1.5;2\r\nX-Y;VALUE=BOOLEAN:TRUE\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n", 2: ""}


def test_what_can_not_be_written(spark):
    prop = lambda name, value, params=(): {"grp": None, "name": name, "name_uc": name, "params": list(params), "value": value, "line_no": 0}
    write = lambda *props: emit.document_to_wire([emit.Node("VEVENT", list(props))])
    for bad in (prop("A:B", "x"), prop("A", "x\r\nEND:VEVENT"), prop("A", "x", [{"name": "P;Q", "values": ["v"]}]), prop("", "x")):
        with pytest.raises(emit.WriteError):
            write(bad)
    with pytest.raises(ValueError):
        xcal.document_to_xml([emit.Node("VEVENT", [prop("1 A", "x")])])
    with pytest.raises(ValueError):
        xcal.document_to_xml([emit.Node("VEVENT", [prop("A", "x\x07")])])
    rows = parsed(spark, event("SUMMARY:" + "é" * 60))
    short = emit.write_wire(rows, ending="\n", width=20).first().content
    assert all(len(x.encode()) <= 20 for x in short.split("\n")) and "\r" not in short
    assert emit.write_wire(rows, width=None).first().content == event("SUMMARY:" + "é" * 60)


def test_times_of_day(spark):
    rows = spark.createDataFrame([(x,) for x in ("101500", "235960Z", "240000", "1015", "000000z")], "t string")
    got = {r.t: r.c and tuple(r.c) for r in rows.select("t", columns.parse_time(F.col("t")).alias("c")).collect()}
    assert got == {"101500": (10, 15, 0, False), "235960Z": (23, 59, 60, True), "240000": None, "1015": None, "000000z": (0, 0, 0, True)}
