"""XML forms (xCal, xCard): documents to text and back, by document."""

from __future__ import annotations

import re
from xml.parsers import expat
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from daybook.functions import values
from daybook.functions.recurrence import parse_rule
from daybook.functions.registry import FIELDS, TYPES, default_type
from daybook.operators import emit
from daybook.operators.jcal import confirmed, date_to_wire, property_to_json, text_of
from daybook.sources.grammar import MAX_DEPTH, Flat, Tree
from daybook.sources.wire import parse_with

# Namespaces of both forms.
ICALENDAR, VCARD = "urn:ietf:params:xml:ns:icalendar-2.0", "urn:ietf:params:xml:ns:vcard-4.0"
NAME = re.compile(r"[A-Za-z][A-Za-z0-9._-]*\Z")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
DATES = ("date", "date-time", "time", "timestamp", "date-and-or-time")


class XmlError(ValueError):
    """A document that has no XML form, or text that isn't one."""


def _tag(name: str, body: str) -> str:
    if not NAME.match(name):
        raise XmlError(f"{name!r} can't name an element")
    return f"<{name}>{body}</{name}>" if body else f"<{name}/>"


def _text(value: object) -> str:
    text = {True: "true", False: "false"}[value] if isinstance(value, bool) else text_of(value) if isinstance(value, str) else values.format_float(float(value)) if isinstance(value, float) else text_of(value)
    if CONTROL.search(text):
        raise XmlError("control character in text")
    return escape(text, {"\r": "&#13;"})


def _texts(x: object, name: str) -> str:
    return "".join(_tag(name, _text(i)) for i in (x if isinstance(x, list) else [x]))


def property_to_xml(p: dict, dialect: str) -> str:
    name, params, label, *slots = property_to_json(p, dialect)
    group = params.pop("group", None)
    shown = "".join(_tag(k, _texts(v, "text") if v != "" else "") for k, v in params.items())
    body = _tag("parameters", shown) if shown else ""
    kind = label if label in TYPES else "unknown" if not NAME.match(label) else label
    fields = FIELDS.get((dialect, p["name_uc"]))
    if fields and isinstance(slots[0], (list, str, int, float)) and default_type(p["name_uc"], dialect)[1].startswith("structured") and label in ("text", "float"):
        own = slots[0] if isinstance(slots[0], list) else [slots[0]]
        body += "".join(_texts(x, fields[k] if k < len(fields) else "text") for k, x in enumerate(own))
    elif label == "recur" and isinstance(slots[0], dict):
        body += _tag("recur", "".join(_texts(x, k) for k, x in slots[0].items()))
    else:
        for x in slots:
            if label == "period" and isinstance(x, list):
                end = "duration" if x[1][:1] in "Pp+-" else "end"
                body += _tag("period", _tag("start", _text(x[0])) + _tag(end, _text(x[1])))
            elif isinstance(x, list):
                body += "".join(_texts(i, kind) for i in x)
            else:
                body += _tag(kind, _text(x))
    out = _tag(name, body)
    return f'<group name="{escape(group, {chr(34): "&quot;"})}">{out}</group>' if group is not None else out


def _component(node: emit.Node, dialect: str) -> str:
    body = "".join(property_to_xml(p, dialect) for p in node.properties)
    if dialect != "icalendar":
        if node.components:
            raise XmlError("components inside a card have no XML form")
        return _tag(node.name.lower(), body)
    inner = "".join(_component(c, dialect) for c in node.components)
    return _tag(node.name.lower(), (_tag("properties", body) if body else "") + (_tag("components", inner) if inner else ""))


def document_to_xml(roots: list[emit.Node]) -> str:
    dialects = [emit.dialect_of(r) for r in roots]
    cards = {d != "icalendar" for d in dialects}
    if len(cards) > 1:
        raise XmlError("cards and calendars don't share a document")
    outer, space = ("vcards", VCARD) if True in cards else ("icalendar", ICALENDAR)
    body = "".join(_component(r, d) for r, d in zip(roots, dialects, strict=True))
    return f'<?xml version="1.0" encoding="utf-8"?><{outer} xmlns="{space}">{body}</{outer}>'


def write_xcal(parsed: DataFrame, column: str = "xcal") -> DataFrame:
    return emit.rendered(parsed, column, document_to_xml)


class Element:
    __slots__ = ("name", "attributes", "children", "text")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children, self.text = name, attributes, [], ""

    def first(self, name: str) -> Element | None:
        return next((c for c in self.children if c.name == name), None)


def parse_xml(text: str) -> Element:
    """The tree under local names."""
    stack = [Element("", {})]

    def start(name: str, attributes: dict[str, str]) -> None:
        if len(stack) > MAX_DEPTH:
            raise XmlError("XML nested too deeply")
        x = Element(name.rpartition(":")[2], attributes)
        stack[-1].children.append(x)
        stack.append(x)

    def data(more: str) -> None:
        stack[-1].text += more

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: stack.pop(), data
    try:
        parser.Parse(text.encode("utf-8"), True)
    except expat.ExpatError as error:
        raise XmlError(f"invalid XML: {error}") from None
    return stack[0].children[0]


def _recur(x: Element) -> str:
    """Adjacent elements of one name are one list."""
    parts: list[tuple[str, list[str]]] = []
    for c in x.children:
        value = c.text.strip()
        value = value.replace("-", "").replace(":", "") if c.name == "until" else value
        if parts and parts[-1][0] == c.name:
            parts[-1][1].append(value)
        else:
            parts.append((c.name, [value]))
    wire = ";".join(f"{n.upper()}={','.join(v)}" for n, v in parts)
    try:
        return parse_rule(wire).text()
    except ValueError:
        return wire


def _value(x: Element, vtype: str, dialect: str) -> str:
    if vtype == "recur":
        return _recur(x) if x.children else x.text
    if vtype == "period" and x.children:
        bare = lambda t: t.replace("-", "").replace(":", "")
        start, end, length = (x.first(n) for n in ("start", "end", "duration"))
        return f"{bare(start.text) if start else ''}/{length.text if length else bare(end.text) if end else ''}"
    if vtype in DATES:
        return date_to_wire(x.text, vtype, dialect)
    if vtype == "utc-offset":
        return confirmed(x.text, x.text.replace(":", ""), vtype, dialect)
    if vtype == "boolean":
        return x.text.strip().upper() if x.text.strip().lower() in ("true", "false") else x.text
    if vtype in ("uri", "cal-address") and dialect == "icalendar":
        return x.text
    return values.escape(x.text) if vtype in ("text", "phone-number", "vcard", "uri", "cal-address") else x.text


def _structured(parts: list[Element], fields: list[str], vtype: str) -> str:
    """Fields by name; repeats of a name are a list; further fields are plain texts, one each."""
    read = (lambda t: values.escape(t)) if vtype == "text" else (lambda t: t)
    named = [",".join(read(c.text) for c in parts if c.name == f) for f in fields]
    present = [any(c.name == f for c in parts) for f in fields]
    more = [read(c.text) for c in parts if c.name == "text"]
    last = len(fields) if more else max((k + 1 for k, there in enumerate(present) if there), default=0)
    return ";".join([*named[:last], *more])


def read_property(tree: Tree, x: Element, dialect: str, group: str | None = None) -> None:
    name, params = x.name.upper(), []
    given = x.first("parameters")
    for c in given.children if given else ():
        params.append((c.name.upper(), [v.text for v in c.children]))
    parts = [c for c in x.children if c is not given]
    usual = default_type(name, dialect)
    fields = FIELDS.get((dialect, name))
    if fields and parts and all(c.name in fields or c.name == "text" for c in parts) and (len(parts) > 1 or parts[0].name in fields):
        tree.add(0, group, name, params, _structured(parts, fields, usual[0]))
        return
    if not parts:
        raise XmlError(f"property {x.name} has no value")
    label = parts[0].name.lower()
    known = label in TYPES
    vtype = label if known else "unknown"
    joint = ";" if usual[1].startswith("structured") and vtype in ("text", "float") and len(parts) > 1 else ","
    wire = joint.join(_value(c, vtype, dialect) for c in parts)
    timed = "T" in wire or "t" in wire
    inferred = "date" if usual[0] == "date-time" and not timed else "date-time" if usual[0] == "date" and timed else usual[0]
    if not known or vtype not in (usual[0],) or vtype != inferred:
        params.append(("VALUE", [label.upper()]))
    tree.add(0, group, name, params, wire)


def _read_component(tree: Tree, x: Element, dialect: str) -> None:
    tree.begin(x.name.upper())
    if dialect == "icalendar":
        inner = x.first("properties")
        for p in inner.children if inner else ():
            read_property(tree, p, dialect)
        inner = x.first("components")
        for c in inner.children if inner else ():
            _read_component(tree, c, dialect)
    else:
        for p in x.children:
            if p.name == "group":
                for own in p.children:
                    read_property(tree, own, dialect, p.attributes.get("name"))
            else:
                read_property(tree, p, dialect)
    tree.open.pop()


def _card_dialect(x: Element) -> str:
    version = x.first("version")
    own = version.children[-1].text.strip() if version and version.children else ""
    return "vcard3" if own in ("2.1", "3.0") else "vcard4"


def read_text(text: str) -> Flat:
    root = parse_xml(text)
    if root.name not in ("icalendar", "vcards"):
        raise XmlError("expected icalendar or vcards")
    flat = Flat()
    tree = Tree(flat, MAX_DEPTH)
    for child in root.children:
        _read_component(tree, child, "icalendar" if root.name == "icalendar" else _card_dialect(child))
    return flat


def read_xcal(docs: DataFrame, content: str = "xcal") -> DataFrame:
    return parse_with(docs, read_text, content)
