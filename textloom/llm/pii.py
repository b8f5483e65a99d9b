"""Format-preserving pseudonyms for personal numbers and dates.

What looks personal is validated (check digits, calendar, ranges), turned into its number within the set of all
values of that format, permuted there by a keyed Feistel network and written back in its format: separators,
length (of IP addresses and months by name: the form) and validity stay, and equal values get equal pseudonyms in all
documents, however they are written.
Kinds: payment cards (issuer's prefix and length, Luhn), IBAN (mod 97), US social security numbers, phone numbers, IPv4
addresses but for multicast and reserved ones, IPv6 addresses that are global unicast, dates of the years 1 to 9999 in
numbers or with an English month; also the local part of e-mail addresses, secrets (hexadecimal, or letters and
digits, behind a word like token), whose letters and digits are numbers to bases 26, 10 and 16, and cloud access keys.

Plan: one narrow pass; a byte test leaves all texts without a digit or an @ alone.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import buffers, col, map_rows, position, release, text_batches, without

ROUNDS = 10


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: an alternating Feistel network over an a x b grid, walking the cycle
    until the result is inside. Of a set of one value, the identity."""
    if not 0 <= x < size:
        raise ValueError("outside the set")
    if size < 2:
        return x
    a = 1
    while a * a < size:
        a *= 2
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8 + 8
    while True:
        left, right = x % a, x // a
        for k in range(ROUNDS):
            if k % 2 == 0:
                left = (left + _round(right, k, size, key, tweak, width)) % a
            else:
                right = (right + _round(left, k, size, key, tweak, width)) % b
        x = right * a + left
        if x < size:
            return x


def restore(x: int, size: int, key: bytes, tweak: str) -> int:
    """The number that ``permute`` takes to x."""
    if size < 2:
        return x
    a = 1
    while a * a < size:
        a *= 2
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8 + 8
    while True:
        left, right = x % a, x // a
        for k in reversed(range(ROUNDS)):
            if k % 2 == 0:
                left = (left - _round(right, k, size, key, tweak, width)) % a
            else:
                right = (right - _round(left, k, size, key, tweak, width)) % b
        x = right * a + left
        if x < size:
            return x


def _round(half: int, k: int, size: int, key: bytes, tweak: str, width: int) -> int:
    text = f"{tweak}|{size:x}|{k}|{half:x}".encode()
    out, i = b"", 0
    while len(out) < width:
        out += hashlib.blake2b(text + b"|%d" % i, key=key).digest()
        i += 1
    return int.from_bytes(out[:width], "big")


def luhn(digits: str) -> int:
    """The check digit to append."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, symbols: str) -> str:
    """symbols in the places of shape's letters and digits."""
    it = iter(symbols)
    return "".join(next(it) if ch.isalnum() else ch for ch in shape)


#: Issuers' first digits and the lengths of their numbers.
_ISSUERS = re.compile(
    r"(?P<a>4)(?:\d{12}|\d{15}|\d{18})|(?P<b>5[1-5])\d{14}|(?P<c>222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|(?P<d>3[47])\d{13}|(?P<e>6011|64[4-9]|65)\d{12,17}"
    r"|(?P<f>30[0-5]|3[689])\d{11,17}|(?P<g>35(?:2[89]|[3-8]\d))\d{12,15}|(?P<h>62)\d{14,17}|(?P<i>50|5[6-9]|6[0137])\d{11,17}", re.ASCII
)


def card(m: str, key: bytes) -> str | None:
    """The issuer's prefix stays."""
    d = re.sub(r"\D", "", m)
    if not 13 <= len(d) <= 19 or not (own := _ISSUERS.fullmatch(d)) or luhn(d[:-1]) != int(d[-1]):
        return None
    lead = own.group(own.lastgroup)
    n = len(d) - 1 - len(lead)
    body = lead + str(permute(int(d[len(lead) : -1]), 10**n, key, "card")).zfill(n)
    return _refill(m, body + str(luhn(body)))


def _card_within(m: str, key: bytes) -> tuple[int, int, str] | None:
    """(begin, end, pseudonym) of the first card within a longer run of groups of digits, of those that begin at
    one place the longest. It begins and ends at separators, so that 13 digits of any longer number don't count."""
    groups = [g.span() for g in re.finditer(r"\d+", m, re.ASCII)]
    for i in range(len(groups)):
        for j in range(len(groups) - 1, i - 1, -1):
            first, last = groups[i][0], groups[j][1]
            if (i or j < len(groups) - 1) and (new := card(m[first:last], key)) is not None:
                return first, last, new
    return None


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _mixed(text: str, key: bytes, tweak: str, classes=_CLASSES) -> str:
    """Each symbol stays in its class, symbols of none stay."""
    own = [next((c for c in classes if ch in c), None) for ch in text]
    x, size = 0, 1
    for ch, c in zip(text, own, strict=True):
        if c:
            x, size = x * len(c) + c.index(ch), size * len(c)
    x = permute(x, size, key, tweak)
    out = []
    for ch, c in zip(reversed(text), reversed(own), strict=True):
        if c:
            x, r = divmod(x, len(c))
            ch = c[r]
        out.append(ch)
    return "".join(reversed(out))


def _mod97(text: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in text)) % 97


def iban(m: str, key: bytes) -> str | None:
    t = m.replace(" ", "")
    if not 15 <= len(t) <= 34 or _mod97(t[4:] + t[:4]) != 1:
        return None
    body = _mixed(t[4:], key, "iban")
    return _refill(m, t[:2] + f"{98 - _mod97(body + t[:2] + '00'):02d}" + body)


def ssn(m: str, key: bytes) -> str | None:
    a, g, s = int(m[:3]), int(m[4:6]), int(m[7:])
    if not 0 < a < 900 or a == 666 or not g or not s:
        return None
    x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1
    x, s = divmod(permute(x, 898 * 99 * 9999, key, "ssn"), 9999)
    a, g = divmod(x, 99)
    a += 1 + (a >= 665)
    return f"{a:03d}{m[3]}{g + 1:02d}{m[6]}{s + 1:04d}"


def phone(m: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", m)
    if not 9 <= len(d) <= 15:
        return None
    cc = re.match(r"\+(\d{1,3})", m).group(1)
    if cc[0] in "17":
        cc = cc[0]
    elif len(cc) == 3 and len(d) < 12:
        cc = cc[:2]
    rest = d[len(cc) :]
    if cc == "1" and len(rest) == 10 and rest[0] in "23456789" and rest[3] in "23456789":
        x = int(str(int(rest[0]) - 2) + rest[1:3]) * 800 * 10**4 + int(str(int(rest[3]) - 2) + rest[4:6]) * 10**4 + int(rest[6:])
        x, line = divmod(permute(x, 800 * 800 * 10**4, key, "phone-1"), 10**4)
        area, office = divmod(x, 800)
        new = f"{area + 200:03d}{office + 200:03d}{line:04d}"
    else:
        new = str(permute(int(rest), 10 ** len(rest), key, "phone-" + cc)).zfill(len(rest))
    return _refill(m, cc + new)


def address(m: str, key: bytes) -> str | None:
    o = [int(x) for x in m.split(".")]
    if max(o) > 255 or not 0 < o[0] < 224:
        return None
    x = permute(((o[0] - 1) << 24) + (o[1] << 16) + (o[2] << 8) + o[3], 223 << 24, key, "ipv4")
    return f"{(x >> 24) + 1}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"


def address6(m: str, key: bytes) -> str | None:
    """Global unicast (2000::/3) only; written in full or short as it was."""
    try:
        x = int(ipaddress.IPv6Address(m))
    except ValueError:
        return None
    if x >> 125 != 1:
        return None
    new = ipaddress.IPv6Address((1 << 125) + permute(x - (1 << 125), 1 << 125, key, "ipv6"))
    out = str(new) if "::" in m else new.exploded if all(len(g) == 4 for g in m.split(":")) else ":".join(f"{int(g, 16):x}" for g in new.exploded.split(":"))
    return out.upper() if m != m.lower() else out


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_MONTHS = "January February March April May June July August September October November December".split()


def _moved(day: int, key: bytes) -> datetime.date:
    """Days of 1900 to 2099 among themselves, and all others among themselves."""
    width = _LAST - _FIRST + 1
    if _FIRST <= day <= _LAST:
        return datetime.date.fromordinal(_FIRST + permute(day - _FIRST, width, key, "date"))
    x = permute(day - 1 if day < _FIRST else day - 1 - width, datetime.date.max.toordinal() - width, key, "date-rest")
    return datetime.date.fromordinal(x + 1 if x + 1 < _FIRST else x + 1 + width)


def date(m: str, key: bytes) -> str | None:
    """ISO (year first), else day first if that is a date, else month first."""
    sep = re.search(r"\D", m).group()
    p = m.split(sep)
    orders = ("ymd",) if len(p[0]) == 4 else ("dmy", "mdy")
    for order in orders:
        part = dict(zip(order, p, strict=True))
        try:
            new = _moved(datetime.date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal(), key)
        except ValueError:
            continue
        own = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return sep.join(own[k] for k in order)
    return None


_SPELT = re.compile(r"(?:(\d{1,2})( ))?([A-Z][a-z]+)(\.? )(?:(\d{1,2})(, ?| ))?(\d{4})", re.ASCII)


def spelt_date(m: str, key: bytes) -> str | None:
    """12 March 2024 or March 12, 2024; the month may be cut to three letters."""
    g = _SPELT.fullmatch(m)
    if g is None or (g[1] is None) == (g[5] is None):
        return None
    month = next((i for i, x in enumerate(_MONTHS, 1) if g[3] in (x, x[:3])), 0)
    try:
        new = _moved(datetime.date(int(g[7]), month, int(g[1] or g[5])).toordinal(), key)
    except ValueError:
        return None
    name = _MONTHS[new.month - 1]
    name = name[:3] if len(g[3]) == 3 and g[3] != "May" else name
    return f"{new.day} {name}{g[4]}{new.year:04d}" if g[1] else f"{name}{g[4]}{new.day}{g[6]}{new.year:04d}"


def email(m: str, key: bytes) -> str | None:
    local, _, domain = m.partition("@")
    return _mixed(local, key, "email") + "@" + domain if any(ch in c for ch in local for c in _CLASSES) else None


def secret(m: str, key: bytes) -> str | None:
    """Hexadecimal, or with letters as well as digits: a long word isn't one."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", m):
        return _mixed(m, key, "hex", ("0123456789abcdef",) if m == m.lower() else ("0123456789ABCDEF",))
    return _mixed(m, key, "secret") if re.search(r"\d", m) and re.search(r"[A-Za-z]", m) else None


def access_key(m: str, key: bytes) -> str | None:
    return m[:4] + _mixed(m[4:], key, "access key")


#: In order of precedence where several begin at one place.
KINDS = {
    "email": (r"(?<![\w.+\-])[A-Za-z0-9_.+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w\-])", email),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    "secret": (r"(?i:(?<=token)|(?<=secret)|(?<=key)|(?<=password))(?P<lead>[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>[0-9A-Za-z+/_\-]{16,128})(?![0-9A-Za-z+/_\-])", secret),
    "access_key": (r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", access_key),
    "phone": (r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)", phone),
    "ip": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", address),
    "ip6": (r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:)(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:])", address6),
    "ssn": (r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)", ssn),
    "date": (r"(?<![\w.\-/])(?:\d{4}(?P<s>[\-/.])\d{2}(?P=s)\d{2}|\d{2}(?P<r>[\-/.])\d{2}(?P=r)\d{4})(?![\w]|[\-/.]\d)", date),
    "spelt_date": (r"(?<![\w.\-/])(?:\d{1,2} (?:Jan|Feb|Ma[ry]|Apr|Ju[nl]|Aug|Sep|Oct|Nov|Dec)[a-z]{0,6}\.? \d{4}|(?:Jan|Feb|Ma[ry]|Apr|Ju[nl]|Aug|Sep|Oct|Nov|Dec)[a-z]{0,6}\.? \d{1,2}(?:, ?| )\d{4})(?![\w]|[\-/.]\d)", spelt_date),
    "card": (r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w]|[\-.]\d)", card),
}
_PATTERN = re.compile("|".join(f"(?P<k_{k}>{p})" for k, (p, _) in KINDS.items()), re.ASCII)
_START = np.zeros(256, bool)
_START[[*range(48, 58), 64]] = True


def replace(text: str, key: bytes) -> tuple[str, list[str]]:
    """(text with pseudonyms, the kinds replaced, in order)."""
    out, found, at, pos = [], [], 0, 0
    while m := _PATTERN.search(text, pos):
        kind = next(k for k in KINDS if m.group(f"k_{k}") is not None)
        own = m.group("secret") if kind == "secret" else m.group()
        new = KINDS[kind][1](own, key)
        if new is None:  # not valid as this kind: perhaps as another that begins here
            for other, (p, f) in KINDS.items():
                if other != kind and other != "secret" and (n := _ALONE[other].match(text, m.start())) and (new := f(n.group(), key)) is not None:
                    kind, m = other, n
                    break
        if new is None and (n := _ALONE["card"].match(text, m.start())) and (part := _card_within(n.group(), key)):
            first, last, new = part
            out += [text[at : m.start() + first], new]
            found.append("card")
            at = pos = m.start() + last
            continue
        if new is None:
            pos = m.start() + 1
            continue
        start = m.start("secret") if kind == "secret" else m.start()
        out += [text[at:start], new]
        found.append(kind)
        at = pos = m.end()
    return ("".join(out) + text[at:], found) if found else (text, found)


_ALONE = {k: re.compile(p, re.ASCII) for k, (p, _) in KINDS.items()}


def pseudonymise(docs: DataFrame, key: bytes, *, text: str = "text") -> DataFrame:
    """docs with pseudonyms in text, and the column pii_kinds: the kinds replaced, in order of the text.

    All other columns stay; one called pii_kinds is replaced. A null text stays null with null kinds; an empty
    one, and one in which nothing is valid, stays as it is with no kinds. Repeated rows come out equal. The
    permutation is a bijection on each format, so distinct values stay distinct; a value may, once in the size
    of its set, be its own pseudonym. key: 1 to 64 secret bytes.
    """
    if not 1 <= len(key) <= 64:
        raise ValueError("the key has 1 to 64 bytes")
    keep = without(docs, "pii_kinds")
    docs = docs.select(*(col(c) for c in keep))
    at = position(keep, text)

    def run(batches):
        for whole in batches:
            for b in text_batches(whole, whole.schema.names[at]):
                texts = b.column(at)
                data, off = buffers(texts)
                seen = np.concatenate([[0], np.cumsum(_START[data], dtype=np.int64)])
                hot = np.flatnonzero(seen[off[1:]] > seen[off[:-1]])
                kinds: list = [[] if v else None for v in texts.is_valid().to_pylist()]
                if len(hot):
                    new = texts.to_pylist()
                    for i in hot.tolist():
                        new[i], kinds[i] = replace(new[i], key)
                    texts = pa.array(new, texts.type)
                columns = list(b.columns)
                columns[at] = texts
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kinds, pa.list_(pa.string()))], names=[*b.schema.names, "pii_kinds"])
        release()

    return map_rows(docs, run, [T.StructField("pii_kinds", T.ArrayType(T.StringType()))])


def brute_force(text: str | None, key: bytes) -> tuple[str | None, list[str] | None]:
    """``replace`` place by place: each kind in order of precedence, then cards within longer runs, for tests."""
    if text is None:
        return None, None
    out, found, i = "", [], 0
    while i < len(text):
        for kind, (_, f) in KINDS.items():
            m = _ALONE[kind].match(text, i)
            own = m and (m.group("secret") if kind == "secret" else m.group())
            if m and (new := f(own, key)) is not None:
                out += text[i : m.start("secret") if kind == "secret" else i] + new
                found.append(kind)
                i = m.end()
                break
        else:
            m = _ALONE["card"].match(text, i)
            if m and (part := _card_within(m.group(), key)):
                out += text[i : i + part[0]] + part[2]
                found.append("card")
                i += part[1]
            else:
                out += text[i]
                i += 1
    return out, found
