"""JSON forms (jCal, jCard): documents to text and back, by document."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.functions import values
from daybook.functions.recurrence import parse_rule
from daybook.functions.registry import TYPES, default_type, type_of
from daybook.operators import emit
from daybook.sources.grammar import MAX_DEPTH, Flat, Tree
from daybook.sources.wire import parse_with

LISTED = ("type", "pid", "sort-as")


class JsonError(ValueError):
    """Text that isn't a JSON form of a document."""


def property_to_json(p: dict, dialect: str) -> list:
    """[name, parameters, type, value...]; VALUE goes into the type."""
    card = dialect != "icalendar"
    name, params = p["name"].lower(), {}
    if p["grp"] is not None:
        if card:
            params["group"] = p["grp"].lower()
        else:
            name = f"{p['grp'].lower()}.{name}"
    declared = None
    for param in p["params"]:
        key, own = param["name"].lower(), list(param["values"])
        if key == "value":
            if declared is None:
                declared = own[0] if len(own) == 1 else ""
            continue
        if card and key in LISTED:
            own = [x for v in own for x in v.split(",")]
        params[key] = "" if not own else own[0] if len(own) == 1 else own
    vtype, many = type_of(p["name_uc"], dialect, declared)
    label = vtype
    if declared and declared.lower() not in TYPES:
        vtype, many, label = "unknown", "single", declared.lower()
    elif declared is None:
        timed = "T" in p["value"] or "t" in p["value"]
        if vtype == "date-time" and not timed or vtype == "date" and timed:
            vtype = label = "date-time" if timed else "date"
    return [name, params, label, *values.slots(p["value"], vtype, many, dialect)]


def node_to_json(node: emit.Node, dialect: str) -> list:
    return [node.name.lower(), [property_to_json(p, dialect) for p in node.properties], [node_to_json(c, dialect) for c in node.components]]


def document_to_json(roots: list[emit.Node]) -> str:
    """One document, or a list of them if there are several roots."""
    out = [node_to_json(r, emit.dialect_of(r)) for r in roots]
    return json.dumps(out[0] if len(out) == 1 else out, ensure_ascii=False, separators=(",", ":"))


def write_jcal(parsed: DataFrame, column: str = "jcal") -> DataFrame:
    """parsed documents with their JSON text in place of their parts."""
    return emit.rendered(parsed, column, document_to_json)


def text_of(value: object) -> str:
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        return f"{value:.1f}"
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _number(value: object) -> str:
    return values.format_float(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else text_of(value)


def confirmed(text: str, candidate: str, vtype: str, dialect: str) -> str:
    """The candidate if it renders as exactly this text, else the text."""
    return candidate if candidate == text or values.slots(candidate, vtype, "single", dialect) == [text] else text


def date_to_wire(text: str, vtype: str, dialect: str) -> str:
    if dialect == "vcard3" or not re.fullmatch(r"[0-9TtZz:+-]+", text):
        return text

    def compact(day: str) -> str:
        if re.fullmatch(r".{4}-.{2}-.{2}", day):
            return day.replace("-", "")
        return f"--{day[2:4]}{day[5:]}" if re.fullmatch(r"--..-..", day) else day

    m = re.match(r"([^Tt]*)[Tt](.*)\Z", text)
    if m:
        candidate = f"{compact(m[1])}T{m[2].replace(':', '')}"
    else:
        candidate = text.replace(":", "") if ":" in text else compact(text)
    return confirmed(text, candidate, vtype, dialect)


def _bare(text: str) -> str:
    return text.replace("-", "").replace(":", "")


def recur_to_wire(value: object) -> str:
    if not isinstance(value, dict):
        return text_of(value)
    parts = []
    for key, own in value.items():
        joined = ",".join(map(text_of, own)) if isinstance(own, list) else text_of(own)
        parts.append(f"{key.upper()}={_bare(joined) if key.upper() == 'UNTIL' else joined}")
    wire = ";".join(parts)
    try:
        return parse_rule(wire).text()
    except ValueError:
        return wire


def _period(value: object) -> str:
    if not isinstance(value, list):
        return text_of(value)
    start, end = (text_of(value[k]) if len(value) > k else "" for k in (0, 1))
    return f"{_bare(start)}/{end if end[:1] in ('P', 'p', '+', '-') and end else _bare(end)}"


def slots_to_wire(own: list, vtype: str, usual: tuple[str, str], dialect: str) -> tuple[str, bool]:
    """The wire value, and whether the type must be declared for it to be read the same way."""
    structured = usual[1].startswith("structured")
    joined = lambda read: ",".join(map(read, own))
    if vtype in ("text", "phone-number", "vcard") and structured:
        part = lambda x: ",".join(values.escape(text_of(i)) for i in x) if isinstance(x, list) else values.escape(text_of(x))
        return (";".join(map(part, own[0])) if isinstance(own[0], list) else part(own[0])), False
    if vtype in ("uri", "cal-address") and dialect == "icalendar":
        return joined(text_of), False
    if vtype in ("text", "phone-number", "vcard", "uri", "cal-address"):
        return joined(lambda x: values.escape(text_of(x))), False
    if vtype in ("date", "date-time", "time", "timestamp", "date-and-or-time"):
        return joined(lambda x: date_to_wire(x, vtype, dialect) if isinstance(x, str) else text_of(x)), False
    if vtype == "utc-offset":
        return joined(lambda x: confirmed(x, x.replace(":", ""), vtype, dialect) if isinstance(x, str) else text_of(x)), False
    if vtype == "boolean":
        return {True: "TRUE", False: "FALSE"}[own[0]] if isinstance(own[0], bool) else text_of(own[0]), False
    if vtype == "float" and structured and usual[0] == "float":
        if isinstance(own[0], list):
            return ";".join(map(_number, own[0])), False
        return _number(own[0]), isinstance(own[0], (int, float)) and not isinstance(own[0], bool)
    if vtype == "float":
        return joined(_number), False
    if vtype == "period":
        return joined(_period), False
    return (recur_to_wire(own[0]) if vtype == "recur" else joined(text_of)), False


def read_property(tree: Tree, entry: object, dialect: str) -> None:
    if not isinstance(entry, list) or len(entry) < 3:
        raise JsonError("malformed jCal property: expected [name, params, type, value…]")
    raw, given, label, own = entry[0], entry[1], entry[2], entry[3:]
    if not isinstance(raw, str) or not isinstance(given, dict) or not isinstance(label, str):
        raise JsonError("a property has a name, an object of parameters and a type name")
    if not own:
        raise JsonError(f'property "{raw}" has no value')
    card, group, name = dialect != "icalendar", None, raw
    if not card and "." in raw:
        group, _, name = raw.partition(".")
    name = name.upper()
    params: list[tuple[str, list[str]]] = []
    for key, value in given.items():
        if card and key.lower() == "group":
            group = text_of(value[0] if isinstance(value, list) and value else None if isinstance(value, list) else value)
            continue
        params.append((key.upper(), list(map(text_of, value)) if isinstance(value, list) else [] if value == "" else [text_of(value)]))
    usual = default_type(name, dialect)
    known = label.lower() in TYPES
    vtype = label.lower() if known else "unknown"
    wire, forced = slots_to_wire(own, vtype, usual, dialect)
    if known:
        timed = "T" in wire or "t" in wire
        inferred = "date" if usual[0] == "date-time" and not timed else "date-time" if usual[0] == "date" and timed else usual[0]
        forced = forced or vtype != usual[0] or vtype != inferred
    if forced or (not known and label):
        params.append(("VALUE", [label.upper()]))
    tree.add(0, group, name, params, wire)


def read_component(tree: Tree, value: object, dialect: str, depth: int = 0) -> None:
    if depth > MAX_DEPTH:
        raise JsonError("jCal components nested too deeply")
    if not isinstance(value, list) or not 2 <= len(value) <= 3:
        raise JsonError("malformed jCal component: expected [name, properties, components]")
    if not isinstance(value[0], str) or not all(isinstance(x, list) for x in value[1:]):
        raise JsonError("a component has a name, a list of properties and a list of components")
    tree.begin(value[0].upper())
    for entry in value[1]:
        read_property(tree, entry, dialect)
    for child in value[2] if len(value) == 3 else ():
        read_component(tree, child, dialect, depth + 1)
    tree.open.pop()


def _dialect(value: object) -> str:
    if not isinstance(value, list) or not value or not isinstance(value[0], str) or value[0].lower() != "vcard":
        return "icalendar"
    for p in value[1] if len(value) > 1 and isinstance(value[1], list) else ():
        if isinstance(p, list) and len(p) > 3 and isinstance(p[0], str) and p[0].lower() == "version":
            return "vcard3" if text_of(p[3]).strip() in ("2.1", "3.0") else "vcard4"
    return "vcard4"


def _documents(value: object) -> Iterator[object]:
    if not isinstance(value, list) or not value:
        raise JsonError("malformed jCal document")
    yield from value if isinstance(value[0], list) else [value]


def read_text(text: str) -> Flat:
    try:
        value = json.loads(text)
    except (json.JSONDecodeError, RecursionError) as error:
        raise JsonError(f"invalid JSON: {error}") from None
    flat = Flat()
    for document in _documents(value):
        read_component(Tree(flat, MAX_DEPTH) if not flat.components else _continued(flat), document, _dialect(document))
    return flat


def _continued(flat: Flat) -> Tree:
    """A tree that goes on numbering after the components that are there."""
    tree = Tree(flat, MAX_DEPTH)
    tree.children = [0] * len(flat.components)
    tree.roots = sum(c[1] is None for c in flat.components)
    return tree


def read_jcal(docs: DataFrame, content: str = "jcal") -> DataFrame:
    """JSON in `content`, one document or a list of documents, as `parse_documents` gives them: text, or a VARIANT."""
    if isinstance(docs.schema[content].dataType, T.VariantType):
        docs = docs.withColumn(content, F.to_json(F.col(f"`{content}`")))
    return parse_with(docs, read_text, content)
