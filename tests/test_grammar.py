"""Parsing, repairs, writing: one document at a time, without Spark."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from daybook.functions import values
from daybook.functions.text import fold_text
from daybook.operators import emit, jcal, xcal
from daybook.sources import grammar
from daybook.sources.wire import arrays_of


def nodes(flat):
    components, properties, _, _ = (x.to_pylist()[0] for x in arrays_of([flat]))
    return emit.trees(components, properties)


def wrap(*lines, eol="\r\n"):
    return eol.join(["BEGIN:X", *lines, "END:X", ""])


@pytest.mark.parametrize(
    "text,kinds,error",
    [
        (wrap("A:1"), [], None),
        (wrap("A:1", eol="\n"), ["LooseLineEnding"] * 3, "LooseLineEnding"),
        (wrap("", "A:1"), ["SkippedBlankLine"], "BlankLine"),
        (" A:1\r\n" + wrap(), ["LeadingContinuationTreatedAsLine", "DroppedContentOutsideComponent"], "LeadingContinuation"),
        (wrap("A_B:1"), ["NonstandardName"], "InvalidName"),
        (wrap("TEL;HOME:1"), ["BareParameter"], "InvalidParamName"),
        (wrap("A;;B=c:1"), ["DroppedLine"], "InvalidParamName"),
        (wrap('A;B="c"d:1'), ["KeptStrayQuote"], "InvalidParamValue"),
        (wrap('A;B=c"d:1'), ["KeptStrayQuote"], "InvalidParamValue"),
        (wrap('A;B="cd:1'), ["KeptUnterminatedQuote"], "UnterminatedQuote"),
        (wrap("A:\x01\x7f"), ["KeptControlCharacter"] * 2, "ControlCharacter"),
        (wrap("NOCOLON"), ["DroppedLine"], "MissingColon"),
        (wrap("BEGIN: Y", "END:Y"), ["NormalizedDelimiter"], "MalformedDelimiter"),
        (wrap("BEGIN;A=b:Y"), ["DroppedLine"], "MalformedDelimiter"),
        (wrap("BEGIN:Y"), ["ClosedUnterminatedComponent"], "MismatchedEnd"),
        ("BEGIN:X\r\n", ["ClosedUnterminatedComponent"], "UnterminatedComponent"),
        ("END:X\r\n", ["IgnoredUnmatchedEnd"], "UnmatchedEnd"),
        ("A:1\r\n", ["DroppedContentOutsideComponent"], "ContentOutsideComponent"),
        (wrap("A;ENCODING=QUOTED-PRINTABLE:a=", "b=", "", "C:1"), ["JoinedQuotedPrintable"] * 2, "BlankLine"),
    ],
)
def test_repairs_and_strict_errors(text, kinds, error):
    flat = grammar.parse_text(text)
    assert [r[2] for r in flat.repairs] == kinds and [r[0] for r in flat.repairs] == list(range(len(kinds)))
    if error:
        with pytest.raises(grammar.ParseError) as caught:
            grammar.parse_text(text, strict=True)
        assert caught.value.kind == error
    else:
        assert grammar.parse_text(text, strict=True).components == flat.components


def test_depth_limit_and_bytes():
    deep = "".join(f"BEGIN:C{k}\r\n" for k in range(5)) + "A:1\r\n" + "".join(f"END:C{k}\r\n" for k in range(4, -1, -1))
    flat = grammar.parse_text(deep, max_depth=3)
    assert len(flat.components) == 3 and flat.properties[0][0] == 2 and "DroppedLine" in {r[2] for r in flat.repairs}
    with pytest.raises(grammar.ParseError):
        grammar.parse_text(deep, strict=True, max_depth=3)
    with pytest.raises(ValueError):
        grammar.parse_text(deep, max_depth=513)
    latin = grammar.parse_bytes(b"BEGIN:X\r\nA:1\r\nB:\xe9\r\nEND:X\r\n")
    assert latin.properties[1][7] == "é" and latin.repairs[0][1:3] == (3, "DecodedNonUtf8AsLatin1")
    assert grammar.parse_bytes(b"\xef\xbb\xbfBEGIN:X\r\nEND:X\r\n", strict=True).components
    with pytest.raises(grammar.ParseError):
        grammar.parse_bytes(b"BEGIN:X\r\nA:\xff\r\nEND:X\r\n", strict=True)


def test_parameters_and_order():
    flat = grammar.parse_text(wrap('g.TEL;TYPE=work,"a,b";X=^n^^^\';Y="c:d":v;:w', "BEGIN:Y", "END:Y", "Z:1"), strict=True)
    assert flat.properties[0][3:8] == ("g", "TEL", "TEL", [("TYPE", ["work", "a,b"]), ("X", ["\n^\""]), ("Y", ["c:d"])], "v;:w")
    assert [p[1] for p in flat.properties] == [0, 2] and flat.components[1][4] == 1
    text = emit.document_to_wire(nodes(flat))
    assert grammar.parse_text(text, strict=True).properties == [(*p[:2], q[2], *p[3:]) for p, q in zip(flat.properties, grammar.parse_text(text).properties)]
    bad = nodes(flat)
    bad[0].properties[0]["value"] = "a\r\nEND:X"
    with pytest.raises(emit.WriteError):
        emit.document_to_wire(bad)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200), st.integers(2, 90))
def test_folding_is_undone_by_unfolding(text, width):
    line = "A:" + "".join(c for c in text if c not in "\r\n")
    folded = fold_text(line, width)
    physical = folded.split("\r\n")[:-1]
    assert "".join([physical[0], *(p[1:] for p in physical[1:])]) == line
    assert all(len(p.encode()) <= max(width, 5) for p in physical)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ABEGIND:;=,\"\r\n\t ^x\\é\x01-"), max_size=120))
def test_lenient_parsing_takes_anything_and_settles(text):
    first = grammar.parse_text(text)
    written = emit.document_to_wire(nodes(first))
    again = grammar.parse_text(written)
    assert emit.document_to_wire(nodes(again)) == written


LINES = st.lists(st.sampled_from(["BEGIN:A", "END:A", "begin:b-1", "end:B-1", "END:", "BEGIN: A", "X:1", "g.X;P=a,b;Q=:v", 'X;P="q;r",s:v', "X;P=^n:v", "X_Y:1", "X;P:1", "NOTE;ENCODING=QUOTED-PRINTABLE:a=", " fold", "\tfold", "", "no colon", "T:a\tb\x07", "É:1", "X;P==:=", "K:" + "v" * 80]), max_size=12)


@settings(max_examples=400, deadline=None)
@given(LINES, st.sampled_from(["\r\n", "\n", "\r\n"]), st.booleans(), st.booleans())
def test_the_short_way_reads_as_the_long_one(parts, ending, last, strict):
    """Regular documents and plain lines take a short cut; without it every document reads the same."""
    text = ending.join(parts) + ending * last

    def read():
        try:
            flat = grammar.parse_text(text, strict)
            return flat.components, [(*p[:6], [(n, list(v)) for n, v in p[6]], p[7]) for p in flat.properties], flat.repairs
        except grammar.ParseError as error:
            return str(error), error.kind

    short = read()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(grammar, "_plain_line", lambda *_: False)
        patch.setattr(grammar.Lines, "_regular", lambda *_: False)
        assert read() == short


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_escapes_are_undone(text):
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    assert values.unescape(values.escape(text)) == plain
    assert values.split(values.escape(text) + "," + values.escape("a,b"), ",") == [values.escape(text), values.escape("a,b")]
    assert grammar.decode_caret(grammar.encode_caret(text)) == plain


@pytest.mark.parametrize(
    "line,want",
    [
        ("DTSTART:20200101T000000Z", ["dtstart", {}, "date-time", "2020-01-01T00:00:00Z"]),
        ("DTSTART;VALUE=DATE:20200101", ["dtstart", {}, "date", "2020-01-01"]),
        ("DTSTART:20200101", ["dtstart", {}, "date", "2020-01-01"]),
        ("CATEGORIES:a\\,b,c", ["categories", {}, "text", "a,b", "c"]),
        ("GEO:1.5;2", ["geo", {}, "float", [1.5, 2]]),
        ("PRIORITY:x", ["priority", {}, "integer", 0]),
        ("RRULE:FREQ=DAILY;BYMONTH=1,2;COUNT=3", ["rrule", {}, "recur", {"freq": "DAILY", "count": 3, "bymonth": [1, 2]}]),
        ("FREEBUSY:20200101T000000Z/PT1H", ["freebusy", {}, "period", ["2020-01-01T00:00:00Z", "PT1H"]]),
        ("TZOFFSETTO:-0130", ["tzoffsetto", {}, "utc-offset", "-01:30"]),
        ("REQUEST-STATUS:2.0;Success", ["request-status", {}, "text", ["2.0", "Success"]]),
        ("X-A;VALUE=OWN;P=q:raw\\n", ["x-a", {"p": "q"}, "own", "raw\\n"]),
    ],
)
def test_json_of_properties(line, want):
    flat = grammar.parse_text("BEGIN:VEVENT\r\n" + line + "\r\nEND:VEVENT\r\n", strict=True)
    out = json.loads(jcal.document_to_json(nodes(flat)))
    assert out == ["vevent", [want], []]
    again = nodes(jcal.read_text(json.dumps(out)))
    assert json.loads(jcal.document_to_json(again)) == out
    xml = xcal.document_to_xml(nodes(flat))
    assert xcal.document_to_xml(nodes(xcal.read_text(xml))) == xml


def test_broken_json_and_xml():
    for text in ("", "[]", "[1]", '["vevent",[["a",{},"text"]],[]]', '["vevent",{},[]]', "[" * 5000):
        with pytest.raises(ValueError):
            jcal.read_text(text)
    for text in ("", "<a/>", "<icalendar>", "<icalendar><vcalendar><properties><x/></properties></vcalendar></icalendar>"):
        with pytest.raises(ValueError):
            xcal.read_text(text)
