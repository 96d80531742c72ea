"""Text escapes, parameter carets, list splitting, names and folding as column expressions.

All but folding of lines outside ASCII stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_ESCAPE = r"(?s)(\\.|[^\\]+|\\\z)"
TOKEN_CARET = r"(?s)(\^[\^n']|[^\^]+|\^)"
FOLD_WIDTH = 75


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_text(text: Column) -> Column:
    """TEXT for a value; every kind of line end becomes an escaped newline."""
    return _replaced(text, ("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n"), ("\r", "\\n"))


def _tokens(text: Column, pattern: str, read) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), read), "")


def unescape_text(text: Column) -> Column:
    """TEXT as it was meant; sequences that mean nothing stay."""

    def read(t: Column) -> Column:
        second = F.substring(t, 2, 1)
        return F.when(t.isin("\\n", "\\N"), "\n").when(t.isin("\\\\", "\\;", "\\,"), second).otherwise(t)

    return _tokens(text, TOKEN_ESCAPE, read)


def bad_escapes(text: Column) -> Column:
    """The sequences that `unescape_text` keeps."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN_ESCAPE), F.lit(1))
    return F.filter(tokens, lambda t: t.startswith("\\") & ~t.isin("\\n", "\\N", "\\\\", "\\;", "\\,"))


def split_unescaped(text: Column, separator: str) -> Column:
    """Parts between separators that no backslash stands before; one at least."""
    if len(separator) != 1 or separator == "\\":
        raise ValueError("a separator is one character, not a backslash")
    own = {"]": "\\]", "^": "\\^", "-": "\\-", "[": "\\["}.get(separator, separator)
    pattern = rf"(?s)[{own}]((?:[^{own}\\]|\\.|\\\z)*)"
    return F.regexp_extract_all(F.concat(F.lit(separator), text), F.lit(pattern), F.lit(1))


def caret_encode(text: Column) -> Column:
    return _replaced(text, ("^", "^^"), ("\r\n", "^n"), ("\n", "^n"), ("\r", "^n"), ('"', "^'"))


def caret_decode(text: Column) -> Column:
    return _tokens(text, TOKEN_CARET, lambda t: F.when(t == "^n", "\n").when(t == "^'", '"').when(t == "^^", "^").otherwise(t))


def needs_quotes(value: Column) -> Column:
    return value.rlike("[:;,]")


def is_strict_name(name: Column) -> Column:
    return name.rlike(r"\A[A-Za-z0-9-]+\z")


def is_lenient_name(name: Column) -> Column:
    return name.rlike(r"\A[^\p{Cc};:=,\"]+\z")


def control_characters(text: Column) -> Column:
    """How many control characters but tabs there are."""
    return F.regexp_count(text, F.lit(r"[\p{Cc}&&[^\t]]"))


def ascii_upper(name: Column) -> Column:
    return F.translate(name, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def fold_plain(line: Column, width: int = FOLD_WIDTH, ending: str = "\r\n") -> Column:
    """Folding of a line of ASCII without an equals sign, in the JVM; each line ends with `ending`."""
    width = max(width, 2)
    chunks = F.regexp_extract_all(line.substr(F.lit(width + 1), F.length(line)), F.lit(f"(?s)(.{{1,{width - 1}}})"), F.lit(1))
    return F.concat(F.array_join(F.concat(F.array(F.substring(line, 1, width)), chunks), ending + " "), F.lit(ending))


def fold_text(line: str, width: int = FOLD_WIDTH, ending: str = "\r\n") -> str:
    """Folding by octets at character boundaries; no physical line ends in an equals sign if that can be helped."""
    width = max(width, 2)
    data, out, at, budget = line.encode("utf-8"), [], 0, width
    while len(data) - at > budget:
        cut = at + budget
        while cut > at and data[cut] & 0xC0 == 0x80:
            cut -= 1
        if cut == at:  # one character is wider than a line
            cut = at + 1
            while cut < len(data) and data[cut] & 0xC0 == 0x80:
                cut += 1
            if cut == len(data):
                break
        back = cut
        while back > at + 1 and data[back - 1] == 0x3D:
            back -= 1
        if data[back - 1] != 0x3D:
            cut = back
        out.append(data[at:cut])
        at, budget = cut, width - 1
    out.append(data[at:])
    return (ending + " ").join(x.decode("utf-8") for x in out) + ending


def fold(line: Column, width: int = FOLD_WIDTH, ending: str = "\r\n") -> Column:
    """Folded lines: the JVM way where it holds, else octet by octet in Arrow batches."""
    import pandas as pd

    def each(lines):
        return lines.map(lambda x: None if x is None else fold_text(x, width, ending))

    each.__annotations__ = {"lines": pd.Series, "return": pd.Series}  # as objects, which pandas_udf reads
    exact = F.pandas_udf(each, "string")

    plain, short = line.rlike(r"\A[\x00-<>-\x7f]*\z"), F.octet_length(line) <= width
    left = exact(F.when(~short & ~plain, line))  # Spark works a Python function out for every row, here mostly for nulls
    return F.when(short, F.concat(line, F.lit(ending))).when(plain, fold_plain(line, width, ending)).otherwise(left)
