"""Text functions as Catalyst expressions; none leaves the JVM but numeric character references."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

SPACE = " \t\n\r\x0b\x0c"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _q(text: str) -> str:
    """text as a Java regular expression."""
    return re.sub(r"([\\.\[\]{}()*+?^$|\-#&~\s])", r"\\\1", text)


def trim_left(s) -> Column:
    return F.ltrim(_c(s), F.lit(SPACE))


def trim_right(s) -> Column:
    return F.rtrim(_c(s), F.lit(SPACE))


def trim(s) -> Column:
    return F.btrim(_c(s), F.lit(SPACE))


def collapse_whitespace(s) -> Column:
    """Each run of white space as one space; ends aren't trimmed."""
    return F.regexp_replace(_c(s), r"[ \t\n\r\x0B\f]+", " ")


def ascii_lower(s) -> Column:
    return F.translate(_c(s), _UP, _LOW)


def ascii_upper(s) -> Column:
    return F.translate(_c(s), _LOW, _UP)


def equals_ignore_case(a, b) -> Column:
    """ASCII letters only; either side may have capitals."""
    return ascii_lower(a) == ascii_lower(b)


def starts_with_ignore_case(s, prefix) -> Column:
    return F.startswith(ascii_lower(s), ascii_lower(prefix))


def starts_with(s, prefix) -> Column:
    return F.startswith(_c(s), _c(prefix))


def ends_with(s, suffix) -> Column:
    return F.endswith(_c(s), _c(suffix))


def split(s, delimiter: str) -> Column:
    """All parts, empty ones too; an empty delimiter gives the whole."""
    return F.split(_c(s), _q(delimiter)) if delimiter else F.array(_c(s))


def split_n(s, delimiter: str, n: int) -> Column:
    """n parts at most, the last with the rest; none if n is 0."""
    if n <= 0:
        return F.when(_c(s).isNotNull(), F.array().cast("array<string>"))
    return F.split(_c(s), _q(delimiter), n)


def split_any(s, characters: str) -> Column:
    """Parts between any of the characters, without empty ones."""
    return F.filter(F.split(_c(s), "[" + "".join(_q(ch) for ch in characters) + "]"), lambda x: x != "")


def join(parts, separator: str) -> Column:
    return F.array_join(_c(parts), separator)


def replace_all(s, old: str, new: str) -> Column:
    return F.replace(_c(s), F.lit(old), F.lit(new)) if old else _c(s)


def replace_first(s, old: str, new: str) -> Column:
    """The first occurrence only; an empty old text is found at the beginning."""
    s = _c(s)
    if not old:
        return F.concat(F.lit(new), s)
    at = F.instr(s, old)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit(new), F.substring(s, at + len(old), F.length(s)))).otherwise(s)


def count_occurrences(s, what: str) -> Column:
    """Occurrences that don't overlap; of the empty text none."""
    if not what:
        return F.when(_c(s).isNotNull(), F.lit(0))
    return ((F.length(_c(s)) - F.length(F.replace(_c(s), F.lit(what), F.lit("")))) / len(what)).cast("int")


def find_all(s, what: str) -> Column:
    """Offsets, from 0 in code points, of occurrences that don't overlap."""
    if not what:
        return F.when(_c(s).isNotNull(), F.array().cast("array<int>"))
    parts = F.split(_c(s), _q(what))
    sizes = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p) + len(what))
    ends = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"] + n - len(what)).alias("out")),
        lambda a: a["out"],
    )
    return ends


def parse_int(s) -> Column:
    """The whole trimmed text as a 64-bit number, else null; no plus sign."""
    t = trim(s)
    return F.when(t.rlike(r"^-?[0-9]+$"), t.try_cast("bigint"))


_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
_REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]{1,8})|([0-9]{1,9}))|(lt|gt|quot|apos|nbsp|amp));")
_VALUE = {n[1:-1]: v for n, v in _NAMED}


def decode_named_entities(s) -> Column:
    """lt, gt, quot, apos, nbsp (a plain space) and amp, in one pass."""
    out = _c(s)
    for name, value in _NAMED:
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


def _decode(m: re.Match) -> str:
    if m.group(3):
        return _VALUE[m.group(3)]
    code = int(m.group(1), 16) if m.group(1) else int(m.group(2))
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m.group()


def decode_entities_text(text: str) -> str:
    return _REFERENCE.sub(_decode, text)


@pandas_udf(T.StringType())
def _decode_numeric(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else decode_entities_text(t))


def decode_html_entities(s) -> Column:
    """Named and numeric references. Only texts with a numeric one leave the JVM."""
    return F.when(F.contains(_c(s), F.lit("&#")), _decode_numeric(F.when(F.contains(_c(s), F.lit("&#")), _c(s)))).otherwise(decode_named_entities(s))


def encode_html_entities(s) -> Column:
    out = _c(s)
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def strip_tags(s) -> Column:
    """Without <...>; an open < drops the rest, a stray > goes."""
    return F.replace(F.regexp_replace(_c(s), r"<[^>]*(>|\z)", ""), F.lit(">"), F.lit(""))


def split_lines(s) -> Column:
    return F.split(_c(s), r"\r\n|\r|\n")


def count_lines(s) -> Column:
    return F.when(_c(s) == "", F.lit(0)).otherwise(F.size(split_lines(s)))


def get_line(s, n: int) -> Column:
    """Line n from 0, else null."""
    return F.get(split_lines(s), F.lit(n))


def format_error(severity, message, line, column, context) -> Column:
    """``Severity: message at line L, column C`` and, on a second line, the context if there is any."""
    head = F.concat(_c(severity), F.lit(": "), _c(message), F.lit(" at line "), _c(line).cast("string"), F.lit(", column "), _c(column).cast("string"))
    return F.when(F.coalesce(_c(context), F.lit("")) == "", head).otherwise(F.concat(head, F.lit("\n  Context: "), _c(context)))


def range_length(begin, end) -> Column:
    return _c(end) - _c(begin)


def range_contains(begin, end, offset) -> Column:
    """Half-open: begin belongs to it, end doesn't."""
    return (_c(begin) <= _c(offset)) & (_c(offset) < _c(end))
