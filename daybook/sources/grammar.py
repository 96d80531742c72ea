"""Wire text of calendars and cards as flat rows: components, properties, repairs.

One pass over a document's lines. What is malformed is mended with a repair (lenient) or ends the parse (strict). A line
is taken apart by regular expressions over its head; the tree is kept as a stack of numbers, as every node is written out
the moment it begins.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

MAX_DEPTH = 512

# Messages by kind.
ERROR_TEXT = {
    "MissingColon": "content line has no ':' separator",
    "InvalidName": 'invalid property name "{}"',
    "InvalidParamName": 'invalid parameter name "{}"',
    "UnterminatedQuote": "unterminated quoted parameter value",
    "InvalidParamValue": 'invalid parameter value "{}"',
    "ControlCharacter": "raw control character {}",
    "BlankLine": "blank line inside document",
    "LooseLineEnding": "bare LF or CR line ending",
    "ContentOutsideComponent": "content line outside any component",
    "MismatchedEnd": "END:{1} does not match open component {0}",
    "UnmatchedEnd": "END:{} with no matching BEGIN",
    "UnterminatedComponent": "component {} was never closed",
    "MalformedDelimiter": "malformed BEGIN/END line",
    "InvalidEscape": "invalid escape sequence \\{}",
    "InvalidUtf8": "input is not valid UTF-8",
    "LeadingContinuation": "input starts with a folded continuation line",
    "TooDeeplyNested": "component nesting exceeds the configured depth limit",
}
REPAIR_TEXT = {
    "DroppedLine": "dropped unparseable line ({})",
    "SkippedBlankLine": "skipped blank line",
    "LooseLineEnding": "accepted bare CR or LF line ending",
    "ClosedUnterminatedComponent": "implicitly closed unterminated component {}",
    "IgnoredUnmatchedEnd": "ignored unmatched END:{}",
    "DroppedContentOutsideComponent": "dropped content line outside any component",
    "KeptInvalidEscape": "kept invalid escape sequence \\{}",
    "KeptControlCharacter": "kept raw control character {}",
    "DecodedNonUtf8AsLatin1": "input was not valid UTF-8; decoded as Latin-1",
    "JoinedQuotedPrintable": "joined quoted-printable soft line break",
    "LeadingContinuationTreatedAsLine": "treated leading continuation line as a new line",
    "BareParameter": "kept bare parameter {} (vCard 2.1 style)",
    "NonstandardName": 'kept nonstandard name "{}"',
    "KeptUnterminatedQuote": "kept unterminated quote as a literal character",
    "KeptStrayQuote": "kept stray double quote in parameter value",
    "NormalizedDelimiter": "normalized malformed BEGIN/END line to {}",
}

STRICT_NAME = re.compile(r"[A-Za-z0-9-]+\Z")
NOT_LENIENT = re.compile(r'[;:=,"]')
PHYSICAL = re.compile(r"([^\r\n]*)(\r\n|\r|\n|\Z)")
HEAD = re.compile(r"[^;:]*")
PARAM_NAME = re.compile(r'[^=;:"]*')
BARE = re.compile(r"[^,;:]*")
CARET = re.compile(r"\^([\^n'])")
PLAIN = re.compile(r"(?:([A-Za-z0-9-]+)\.)?([A-Za-z0-9-]+)((?:;[A-Za-z0-9-]+=[^\x00-\x08\x0a-\x1f\x7f-\x9f\":;^]*)*):([^\x00-\x08\x0a-\x1f\x7f-\x9f]*)\Z")
CONTROL = re.compile(r"[\x00-\x08\x0a-\x1f\x7f-\x9f]")


class ParseError(ValueError):
    def __init__(self, line: int | None, kind: str, *details: str):
        self.line, self.kind, self.details = line, kind, details
        text = ERROR_TEXT[kind].format(*details)
        super().__init__(text if line is None else f"line {line}: {text}")

    @property
    def text(self) -> str:
        return ERROR_TEXT[self.kind].format(*self.details)


@dataclass
class Flat:
    """A document's rows, in the column order of the schemas in `wire`."""

    components: list[tuple] = field(default_factory=list)
    properties: list[tuple] = field(default_factory=list)
    repairs: list[tuple] = field(default_factory=list)
    error: tuple | None = None

    def repair(self, line: int, kind: str, detail: str = "", text: str | None = None) -> None:
        message = text or REPAIR_TEXT[kind].format(detail)
        self.repairs.append((len(self.repairs), line, kind, detail, f"line {line}: {message}"))


def upper(name: str) -> str:
    """ASCII letters in upper case; others stay."""
    if name.isascii():
        return name.upper()
    return "".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in name)


def is_strict_name(name: str) -> bool:
    return bool(STRICT_NAME.match(name))


def is_lenient_name(name: str) -> bool:
    return bool(name) and not NOT_LENIENT.search(name) and not any(unicodedata.category(c) == "Cc" for c in name)


def decode_caret(text: str) -> str:
    return CARET.sub(lambda m: {"^": "^", "n": "\n", "'": '"'}[m[1]], text)


def encode_caret(text: str) -> str:
    return text.replace("^", "^^").replace("\r\n", "^n").replace("\n", "^n").replace("\r", "^n").replace('"', "^'")


def quoted_printable(line: str) -> bool:
    """The line's head declares quoted-printable, in whatever form."""
    return "QUOTED-PRINTABLE" in upper(line.partition(":")[0])


class Lines:
    """Logical lines (text, number of the first physical line) of a document."""

    def __init__(self, text: str, flat: Flat, strict: bool):
        self.out: list[list] = []
        if self._regular(text):
            return
        physical = [(m[1], m[2]) for m in PHYSICAL.finditer(text) if m[1] or m[2]]
        soft = False  # the last logical line ends in a soft break that the next line continues
        for k, (body, ending) in enumerate(physical):
            number, more = k + 1, k + 1 < len(physical)
            if ending in ("\r", "\n"):
                self._say(flat, strict, number, "LooseLineEnding")
            if soft:
                self.out[-1][0] = self.out[-1][0][:-1] + body
                soft = self._soft(flat, number, more)
            elif not body:
                self._say(flat, strict, number, "BlankLine", "SkippedBlankLine")
            elif body[0] in " \t" and self.out:
                self.out[-1][0] += body[1:]
            else:
                if body[0] in " \t":
                    self._say(flat, strict, number, "LeadingContinuation", "LeadingContinuationTreatedAsLine")
                    self.out.append([body[1:], number])
                else:
                    self.out.append([body, number])
                    soft = not strict and self._soft(flat, number, more)

    def _regular(self, text: str) -> bool:
        """Takes a text apart in which every line ends in CRLF, none is blank and none may end in a soft break."""
        n = text.count("\r\n")
        if not n or not text.endswith("\r\n") or "=\r\n" in text or text.count("\n") != n or text.count("\r") != n:
            return False
        parts = text[:-2].split("\r\n")
        if not all(parts) or parts[0][0] in " \t":
            return False
        begins = [k for k, p in enumerate(parts) if p[0] not in " \t"]
        if len(begins) == len(parts):
            self.out = [[p, k + 1] for k, p in enumerate(parts)]
        else:
            self.out = [[parts[a] + "".join([p[1:] for p in parts[a + 1 : b]]), a + 1] for a, b in zip(begins, [*begins[1:], len(parts)], strict=True)]
        return True

    def _soft(self, flat: Flat, number: int, more: bool) -> bool:
        line = self.out[-1][0]
        if more and line.endswith("=") and quoted_printable(line):
            flat.repair(number, "JoinedQuotedPrintable")
            return True
        return False

    @staticmethod
    def _say(flat: Flat, strict: bool, number: int, error: str, repair: str | None = None) -> None:
        if strict:
            raise ParseError(number, error)
        flat.repair(number, repair or error)


class LineReader:
    """One content line: group, name, parameters, value."""

    def __init__(self, text: str, number: int, flat: Flat, strict: bool):
        self.text, self.number, self.flat, self.strict, self.at = text, number, flat, strict, 0

    def fail(self, kind: str, *details: str) -> ParseError:
        return ParseError(self.number, kind, *details)

    def mend(self, error: str, detail: str, repair: str, shown: str = "") -> None:
        if self.strict:
            raise self.fail(error, detail) if "{" in ERROR_TEXT[error] else self.fail(error)
        self.flat.repair(self.number, repair, shown)

    def take(self, pattern: re.Pattern) -> str:
        m = pattern.match(self.text, self.at)
        self.at = m.end()
        return m[0]

    def next(self) -> str:
        return self.text[self.at : self.at + 1]

    def name_ok(self, name: str, error: str, shown: str) -> None:
        if not is_strict_name(name):
            if self.strict or not is_lenient_name(name):
                raise self.fail(error, shown)

    def clean(self, text: str) -> str:
        for m in CONTROL.finditer(text):
            self.mend("ControlCharacter", repr(m[0]), "KeptControlCharacter", repr(m[0]))
        return text

    def read(self) -> tuple[str | None, str, list[tuple[str, list[str]]], str]:
        head = self.take(HEAD)
        group, dot, name = head.partition(".")
        group, name = (group, name) if dot else (None, head)
        for part in (name, group):
            if part is not None:
                self.name_ok(part, "InvalidName", head)
        if not (is_strict_name(name) and (group is None or is_strict_name(group))):
            self.flat.repair(self.number, "NonstandardName", head)
        params = []
        while (c := self.next()) == ";":
            self.at += 1
            if (param := self.param()) is not None:
                params.append(param)
        if c != ":":
            raise self.fail("MissingColon")
        self.at += 1
        return group, name, params, self.clean(self.text[self.at :])

    def param(self) -> tuple[str, list[str]] | None:
        name, c = self.take(PARAM_NAME), self.next()
        if c == "":
            raise self.fail("MissingColon")
        if c == '"':
            raise self.fail("InvalidParamName", name)
        if c != "=":
            if self.strict or (name and not is_lenient_name(name)):
                raise self.fail("InvalidParamName", name)
            if not name:
                self.flat.repair(self.number, "DroppedLine", "InvalidParamName", REPAIR_TEXT["DroppedLine"].format(ERROR_TEXT["InvalidParamName"].format("")))
                return None
            self.flat.repair(self.number, "BareParameter", name)
            return name, []
        self.name_ok(name, "InvalidParamName", name)
        if not is_strict_name(name):
            self.flat.repair(self.number, "NonstandardName", name)
        values = []
        while not values or self.next() == ",":
            self.at += 1
            values.append(self.param_value())
        return name, values

    def param_value(self) -> str:
        if self.next() != '"':
            raw = self.take(BARE)
            if '"' in raw:
                self.mend("InvalidParamValue", raw, "KeptStrayQuote")
            return decode_caret(self.clean(raw))
        close = self.text.find('"', self.at + 1)
        if close < 0:
            self.mend("UnterminatedQuote", "", "KeptUnterminatedQuote")
            return decode_caret(self.clean(self.take(BARE)))
        inner = decode_caret(self.clean(self.text[self.at + 1 : close]))
        self.at = close + 1
        if self.next() not in (",", ";", ":", ""):
            self.mend("InvalidParamValue", self.text[self.at :], "KeptStrayQuote")
            inner += decode_caret(self.clean(self.take(BARE)))
        return inner


class Tree:
    """Components as they open and close; rows get pre-order numbers."""

    def __init__(self, flat: Flat, max_depth: int):
        self.flat, self.max_depth = flat, max_depth
        self.open: list[tuple[int, str]] = []  # number, upper-case name
        self.children: list[int] = []  # how many each component has
        self.roots = 0

    def _ordinal(self) -> int:
        if not self.open:
            self.roots += 1
            return self.roots - 1
        parent = self.open[-1][0]
        self.children[parent] += 1
        return self.children[parent] - 1

    def begin(self, name: str) -> None:
        number, ordinal = len(self.children), self._ordinal()
        parent = self.open[-1][0] if self.open else None
        root = self.open[0][0] if self.open else number
        self.flat.components.append((number, parent, root, len(self.open), ordinal, name, upper(name)))
        self.children.append(0)
        self.open.append((number, upper(name)))

    def add(self, line: int, group: str | None, name: str, params: list, value: str) -> None:
        ordinal = self._ordinal()
        self.flat.properties.append((self.open[-1][0], ordinal, line, group, name, upper(name), params, value))

    def shown(self, k: int) -> str:
        return self.flat.components[self.open[k][0]][5]


def _delimiter(reader: LineReader, group: str | None, params: list, value: str) -> str | None:
    name = value.strip()
    if params or not name:
        return None
    if group is not None or name != value:
        if reader.strict:
            return None
        reader.flat.repair(reader.number, "NormalizedDelimiter", name)
    if not is_strict_name(name):
        if reader.strict or not is_lenient_name(name):
            return None
        reader.flat.repair(reader.number, "NonstandardName", name)
    return name


def _dropped(flat: Flat, error: ParseError) -> None:
    flat.repair(error.line, "DroppedLine", error.kind, REPAIR_TEXT["DroppedLine"].format(error.text))


def _plain_line(tree: Tree, text: str, number: int) -> bool:
    """Takes a line that needs neither repair nor decoding; False leaves it to `_line`."""
    m = PLAIN.match(text)
    if not m:
        return False
    group, name, params, value = m.groups()
    kind = name.upper()
    if kind == "BEGIN":
        if params or group or not STRICT_NAME.match(value) or len(tree.open) >= tree.max_depth:
            return False
        tree.begin(value)
    elif kind == "END":
        if params or group or not tree.open or tree.open[-1][1] != value.upper() or not STRICT_NAME.match(value):
            return False
        tree.open.pop()
    elif not tree.open:
        return False
    else:
        pairs = [p.partition("=") for p in params[1:].split(";")] if params else ()
        number_, ordinal = tree.open[-1][0], tree._ordinal()
        tree.flat.properties.append((number_, ordinal, number, group, name, kind, [(n, v.split(",")) for n, _, v in pairs], value))
    return True


def _line(tree: Tree, text: str, number: int, strict: bool) -> None:
    if _plain_line(tree, text, number):
        return
    reader = LineReader(text, number, tree.flat, strict)
    group, name, params, value = reader.read()
    kind = upper(name)
    if kind not in ("BEGIN", "END"):
        if not tree.open:
            reader.mend("ContentOutsideComponent", "", "DroppedContentOutsideComponent")
            return
        tree.add(number, group, name, params, value)
        return
    label = _delimiter(reader, group, params, value)
    if label is None:
        raise reader.fail("MalformedDelimiter")
    if kind == "BEGIN":
        if len(tree.open) >= tree.max_depth:
            raise reader.fail("TooDeeplyNested")
        tree.begin(label)
        return
    at = next((k for k in range(len(tree.open) - 1, -1, -1) if tree.open[k][1] == upper(label)), None)
    if at is None or at < len(tree.open) - 1:
        if strict:
            raise reader.fail("MismatchedEnd", tree.shown(-1), label) if tree.open else reader.fail("UnmatchedEnd", label)
        if at is None:
            tree.flat.repair(number, "IgnoredUnmatchedEnd", label)
            return
        for k in range(len(tree.open) - 1, at, -1):
            tree.flat.repair(number, "ClosedUnterminatedComponent", tree.shown(k))
    del tree.open[at:]


def parse_text(text: str, strict: bool = False, max_depth: int = MAX_DEPTH, flat: Flat | None = None) -> Flat:
    """Strict parsing raises ParseError; lenient parsing takes anything."""
    if not 0 < max_depth <= MAX_DEPTH:
        raise ValueError(f"max_depth must lie in 1..{MAX_DEPTH}")
    flat = flat or Flat()
    lines = Lines(text, flat, strict).out
    tree = Tree(flat, max_depth)
    for body, number in lines:
        try:
            _line(tree, body, number, strict)
        except ParseError as error:
            if strict:
                raise
            _dropped(flat, error)
    last = lines[-1][1] if lines else 1
    for k in range(len(tree.open) - 1, -1, -1):
        if strict:
            raise ParseError(last, "UnterminatedComponent", tree.shown(k))
        flat.repair(last, "ClosedUnterminatedComponent", tree.shown(k))
    return flat


def parse_bytes(data: bytes, strict: bool = False, max_depth: int = MAX_DEPTH) -> Flat:
    """UTF-8 with or without a mark; what isn't UTF-8 is Latin-1 as a whole, with a repair."""
    data = data.removeprefix(b"\xef\xbb\xbf")
    try:
        return parse_text(data.decode("utf-8"), strict, max_depth)
    except UnicodeDecodeError as error:
        line = 1 + data[: error.start].count(b"\n")
        if strict:
            raise ParseError(line, "InvalidUtf8") from None
        flat = Flat()
        flat.repair(line, "DecodedNonUtf8AsLatin1")
        return parse_text(data.decode("latin-1"), strict, max_depth, flat)
