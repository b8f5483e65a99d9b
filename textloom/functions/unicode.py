"""Unicode functions; normal forms go through Python, in Arrow batches, all else stays in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .text import _c


def is_valid_utf8(b) -> Column:
    """Of a binary column: no overlong forms, surrogates or values out of range."""
    return F.is_valid_utf8(_c(b).cast("string"))


def count_codepoints(s) -> Column:
    return F.char_length(_c(s))


def codepoints(s) -> Column:
    """The code points as an array of one-character texts."""
    return F.regexp_extract_all(_c(s), F.lit(r"([\s\S])"), F.lit(1))


def utf8_length(s) -> Column:
    """Bytes of each code point's UTF-8 form."""
    return F.transform(codepoints(s), lambda x: F.octet_length(x))


def to_lower(s) -> Column:
    return F.lower(_c(s))


def to_upper(s) -> Column:
    return F.upper(_c(s))


def to_title_case(s) -> Column:
    """Words between white space begin with a capital and go on in lower case."""
    return F.initcap(_c(s))


def capitalize_first(s) -> Column:
    """Only a simple capital: a letter that would become two stays."""
    first = F.left(_c(s), F.lit(1))
    up = F.upper(first)
    return F.concat(F.when(F.length(up) == 1, up).otherwise(first), F.substring(_c(s), 2, 2147483647))


def _normal_form(form: str):
    @pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return run


_FORMS = {f: _normal_form(f) for f in ("NFC", "NFD", "NFKC", "NFKD")}


def normalize(s, form: str = "NFC") -> Column:
    """NFC, NFD, NFKC or NFKD. Texts in ASCII, which all forms leave alone, stay in the JVM."""
    plain = _c(s).rlike(r"\A[\x00-\x7F]*\z")
    return F.when(plain, _c(s)).otherwise(_FORMS[form](F.when(~plain, _c(s))))


def _is(s, pattern: str) -> Column:
    return _c(s).rlike(f"\\A{pattern}\\z")


def is_whitespace(s) -> Column:
    return _is(s, _CLASSES["whitespace"])


def is_letter(s) -> Column:
    return _is(s, _CLASSES["letter"])


def is_digit(s) -> Column:
    return _is(s, _CLASSES["digit"])


def is_alphanumeric(s) -> Column:
    return _is(s, _CLASSES["alphanumeric"])


def is_punctuation(s) -> Column:
    return _is(s, _CLASSES["punctuation"])


_CLASSES = {"whitespace": r"\p{IsWhite_Space}", "letter": r"\p{L}", "digit": r"\p{Nd}", "alphanumeric": r"[\p{L}\p{Nd}]", "punctuation": r"\p{P}"}


def count_class(s, kind: str) -> Column:
    """How many code points of a text are whitespace, letter, digit, alphanumeric or punctuation: those for which
    is_<kind> holds, by one pass over the text instead of an array of its characters."""
    t = _c(s)
    return (F.char_length(t) - F.char_length(F.regexp_replace(t, _CLASSES[kind] + "+", ""))).cast("int")


def decode_utf8(b) -> Column:
    """Text of bytes; what isn't valid becomes U+FFFD."""
    return F.make_valid_utf8(F.col(b) if isinstance(b, str) else b).cast("string")


def encode_utf8(s) -> Column:
    return F.encode(_c(s), "UTF-8")
