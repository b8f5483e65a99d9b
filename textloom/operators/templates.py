"""Templates: definitions, invocations and expansion, in plain Python."""

from __future__ import annotations

import datetime
import json
import re

from .lexer import matched, redirect_target, strip_comments

PARSER_FUNCTIONS = frozenset(
    "anchorencode bidi canonicalurl expr filepath formatnum fullurl gender grammar if ifeq ifexist ifexpr invoke language localurl ns nse padleft padright plural rel2abs switch tag time titleparts urlencode".split()
)
EVALUATED = tuple("expr if ifeq ifexist ifexpr invoke language switch tag time titleparts".split())
_BLANK = " \t\n"
_NOINCLUDE = re.compile(r"<noinclude>(.*?)(?:</noinclude>|\Z)", re.S)


def function_name(name: str) -> str:
    return name.strip().lower().removeprefix("#").removesuffix(":")


def is_parser_function(name: str) -> bool:
    """The # and a colon at the end may be missing; case doesn't count."""
    return function_name(name) in PARSER_FUNCTIONS


def parser_function(name: str) -> str:
    """The canonical #name of those that can be evaluated, else 'Unknown'."""
    f = function_name(name)
    return "#" + f if f in EVALUATED else "Unknown"


def _split(text: str) -> list[str]:
    """At bars outside of braces and links."""
    opens, closes = matched(text)
    parts, depth, last, at = [], 0, 0, 0
    while at < len(text):
        if at in opens:
            depth += 1
            at += opens[at]
        elif at in closes:
            depth -= 1
            at += closes[at]
        else:
            if text[at] == "|" and depth == 0:
                parts.append(text[last:at])
                last = at + 1
            at += 1
    return [*parts, text[last:]]


def _equals(text: str) -> int:
    """The first = outside of braces and links, or -1."""
    opens, closes = matched(text)
    depth, at = 0, 0
    while at < len(text):
        if at in opens:
            depth += 1
            at += opens[at]
        elif at in closes:
            depth -= 1
            at += closes[at]
        elif text[at] == "=" and depth == 0:
            return at
        else:
            at += 1
    return -1


def invocation_spans(text: str) -> list[tuple[int, int]]:
    """[begin, end) of the outermost {{...}}; {{{...}}} aren't invocations."""
    opens, closes = matched(text)
    out, depth, begin, kinds = [], 0, 0, []
    for at in sorted([*opens, *closes]):
        if at in opens:
            if text[at] == "{":
                kinds.append(opens[at])
                if opens[at] == 2 and not depth:
                    begin = at
                depth += opens[at] == 2
        elif text[at] == "}" and kinds and kinds.pop() == 2:
            depth -= 1
            if not depth:
                out.append((begin, at + 2))
    return out


def parse_invocation(text: str) -> tuple[str, list[tuple[str, str]]] | None:
    """(name, [(parameter or '', value)]) of a text that begins with {{ (after blanks); names and values are
    trimmed. None if it isn't an invocation."""
    t = text.strip(_BLANK)
    spans = invocation_spans(t)
    if not t.startswith("{{") or not spans or spans[0][0] != 0:
        return None
    parts = _split(t[2 : spans[0][1] - 2])
    name = parts[0].strip(_BLANK)
    if not name:
        return None
    return name, [_param(p) for p in parts[1:]]


def _param(text: str) -> tuple[str, str]:
    eq = _equals(text)
    return (text[:eq].strip(_BLANK), text[eq + 1 :].strip(_BLANK)) if eq >= 0 else ("", text.strip(_BLANK))


def parse_params(text: str) -> list[tuple[str, str]]:
    """[(parameter or '', value)] of what stands behind an invocation's first bar."""
    return [_param(p) for p in _split(text)]


def find_invocations(text: str) -> list[dict]:
    out = []
    for a, b in invocation_spans(text):
        if (inv := parse_invocation(text[a:b])) is not None:
            out.append({"name": inv[0], "params": [{"name": n, "value": v} for n, v in inv[1]], "begin": a, "end": b})
    return out


def get_param(params: list[tuple[str, str]], key: str | int) -> str | None:
    """By name; by number: the n-th without a name or one so named, whichever comes first."""
    seen = 0
    for name, value in params:
        seen += name == ""
        if isinstance(key, str) and name == key or not isinstance(key, str) and (name == "" and seen == key or name == str(key)):
            return value
    return None


def find_parameters(text: str) -> list[str]:
    """Names in {{{...}}}, nested ones too, each once, in order."""
    opens, _ = matched(text)
    names = []
    for at in sorted(opens):
        if opens[at] == 3:
            name = re.split(r"\||\}\}\}", text[at + 3 :], maxsplit=1)[0].strip()
            if name and name not in names:
                names.append(name)
    return names


def parse_definition(name: str, text: str) -> dict:
    """What a template's page says of it."""
    target = redirect_target(text)
    if target is not None:
        return {"name": name, "redirect": target, "description": "", "params": [], "content": text}
    m = _NOINCLUDE.search(text)
    description = ""
    if m:
        inner, last, parts = m.group(1), 0, []
        for a, b in invocation_spans(inner):
            parts.append(inner[last:a])
            last = b
        description = re.sub(r"<[^>]*>", "", "".join(parts) + inner[last:]).strip()
    return {"name": name, "redirect": None, "description": description, "params": find_parameters(text), "content": text}


def template_data(text: str) -> list[dict]:
    """Parameters of a TemplateData JSON, sorted by name; [] of bad JSON."""
    try:
        params = json.loads(text)["params"]
        items = sorted(params.items())
    except (ValueError, KeyError, TypeError, AttributeError):
        return []
    out = []
    for name, p in items:
        if not isinstance(p, dict):
            continue
        default, description = p.get("default"), p.get("description")
        out.append({
            "name": name,
            "default_value": None if default is None else default if isinstance(default, str) else json.dumps(default),
            "description": description if isinstance(description, str) else None,
            "required": p.get("required") is True,
            "aliases": [a for a in p.get("aliases") or [] if isinstance(a, str)],
        })
    return out


def include_part(text: str) -> str:
    """What a page gives where it is transcluded."""
    text = strip_comments(text)
    only = re.findall(r"<onlyinclude>(.*?)(?:</onlyinclude>|\Z)", text, re.S)
    if only:
        return "".join(only)
    return re.sub(r"</?includeonly>", "", _NOINCLUDE.sub("", text))


class Expander:
    """Expands templates and parser functions of a page. What can't be expanded stays as it is written and isn't
    looked at again."""

    def __init__(self, templates: dict[str, str], *, title: str = "", namespace: str = "", now: datetime.datetime | None = None, max_depth: int = 40, max_expansions: int = 10_000, functions: bool = True, fail_on_missing: bool = False, preserve_unknown: bool = True):
        self.templates, self.title, self.namespace = templates, title, namespace
        self.now = now or datetime.datetime(1970, 1, 1)
        self.max_depth, self.max_expansions, self.functions = max_depth, max_expansions, functions
        self.fail_on_missing, self.preserve_unknown = fail_on_missing, preserve_unknown
        self.stats = {"expanded": 0, "functions": 0, "max_depth": 0, "cache_hits": 0, "errors": 0}
        self.cache: dict[str, str] = {}

    def expand(self, text: str, params: dict[str, str] | None = None, depth: int = 0) -> str:
        opens, closes = matched(text)
        out, at, last = [], 0, 0
        spans = []
        stack: list[tuple[int, int]] = []
        for p in sorted([*opens, *closes]):
            if text[p] == "{":
                stack.append((p, opens[p]))
            elif text[p] == "}" and stack:
                begin, size = stack.pop()
                if not stack:
                    spans.append((begin, p + size, size))
        del at
        for begin, end, size in spans:
            out.append(text[last:begin])
            raw = text[begin:end]
            out.append(self._parameter(raw, params, depth) if size == 3 else self._call(raw, params, depth))
            last = end
        return "".join(out) + text[last:]

    def _parameter(self, raw: str, params: dict[str, str] | None, depth: int) -> str:
        if params is None:
            return raw
        parts = _split(raw[3:-3])
        name = self.expand(parts[0], params, depth).strip(_BLANK)
        if name in params:
            return params[name]
        return self.expand("|".join(parts[1:]), params, depth) if len(parts) > 1 else raw

    def _call(self, raw: str, params: dict[str, str] | None, depth: int) -> str:
        self.stats["max_depth"] = max(self.stats["max_depth"], depth + 1)
        if depth >= self.max_depth or self.stats["expanded"] >= self.max_expansions:
            self.stats["errors"] += 1
            return raw
        parts = _split(raw[2:-2])
        head = parts[0]
        if head.lstrip().startswith("#"):
            name, _, first = head.strip(_BLANK).partition(":")
            if parser_function(name) == "Unknown" or not self.functions:
                return raw
            self.stats["functions"] += 1
            return self._function(function_name(name), [first, *parts[1:]], params, depth, raw)
        name = self.expand(head, params, depth).strip(_BLANK)
        if len(parts) == 1 and (kind := magic_word(name)) != "Unknown" and name not in self.templates:
            return magic_value(kind, self.title, self.namespace, self.now)
        content = self.templates.get(name)
        if content is None and name:
            content = self.templates.get(name[0].upper() + name[1:])
        if content is None:
            self.stats["errors"] += 1
            if self.fail_on_missing:
                return f"[Template not found: {name}]"
            return raw if self.preserve_unknown else ""
        args: dict[str, str] = {}
        place = 0
        for p in parts[1:]:
            eq = _equals(p)
            if eq >= 0:
                args[self.expand(p[:eq], params, depth).strip(_BLANK)] = self.expand(p[eq + 1 :], params, depth).strip(_BLANK)
            else:
                place += 1
                args[str(place)] = self.expand(p, params, depth)
        key = f"{name}|{sorted(args.items())}"
        if key in self.cache:
            self.stats["cache_hits"] += 1
            return self.cache[key]
        self.stats["expanded"] += 1
        target = redirect_target(content)
        if target is not None:
            content = self.templates.get(target.split(":", 1)[-1], content)
        self.cache[key] = out = self.expand(include_part(content), args, depth + 1)
        return out

    def _function(self, name: str, args: list[str], params, depth: int, raw: str) -> str:
        do = lambda i: self.expand(args[i], params, depth + 1).strip(_BLANK) if i < len(args) else ""
        if name == "if":
            return do(1) if do(0) else do(2)
        if name == "ifeq":
            return do(2) if do(0) == do(1) else do(3)
        if name == "ifexist":
            t = do(0)
            return do(1) if t in self.templates or t.split(":", 1)[-1] in self.templates else do(2)
        if name == "ifexpr":
            return do(1) if expression(do(0)) != "0" else do(2)
        if name == "expr":
            return expression(do(0))
        if name == "switch":
            value, default, falling = do(0), "", False
            for i in range(1, len(args)):
                eq = _equals(args[i])
                if eq < 0:
                    case = do(i)
                    if i == len(args) - 1 and not falling and case != value:
                        return case
                    falling = falling or case == value
                    if i == len(args) - 1 and falling:
                        return case
                    continue
                case = self.expand(args[i][:eq], params, depth + 1).strip(_BLANK)
                if falling or case == value:
                    return self.expand(args[i][eq + 1 :], params, depth + 1).strip(_BLANK)
                if case == "#default":
                    default = self.expand(args[i][eq + 1 :], params, depth + 1).strip(_BLANK)
            return default
        if name == "time":
            return format_time(do(0), self.now)
        if name == "tag":
            return f"<{do(0)}>{do(1)}</{do(0)}>"
        if name in ("language", "titleparts"):
            return do(0)
        return raw


def expression(text: str) -> str:
    """Of a number: as a whole number if it is one below 1e15, else with 10 significant digits; else '0'."""
    if not re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", text.strip()):
        return "0"
    x = float(text)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.10g}"


def format_time(pattern: str, now: datetime.datetime) -> str:
    """Y y m n d j H i s; other characters stand for themselves."""
    parts = {"Y": f"{now.year}", "y": f"{now.year % 100:02d}", "m": f"{now.month:02d}", "n": str(now.month), "d": f"{now.day:02d}", "j": str(now.day), "H": f"{now.hour:02d}", "i": f"{now.minute:02d}", "s": f"{now.second:02d}"}
    return "".join(parts.get(ch, ch) for ch in pattern)


_MAGIC = {
    "PAGENAME": "PageName", "PAGENAMEE": "PageNameE", "FULLPAGENAME": "FullPageName", "FULLPAGENAMEE": "FullPageNameE", "BASEPAGENAME": "BasePageName", "SUBPAGENAME": "SubPageName",
    "ROOTPAGENAME": "RootPageName", "TALKPAGENAME": "TalkPageName", "SUBJECTPAGENAME": "SubjectPageName", "ARTICLEPAGENAME": "SubjectPageName", "NAMESPACE": "NameSpace", "NAMESPACEE": "NameSpaceE",
    "TALKSPACE": "TalkSpace", "SUBJECTSPACE": "SubjectSpace", "ARTICLESPACE": "SubjectSpace", "CURRENTYEAR": "CurrentYear", "CURRENTMONTH": "CurrentMonth", "CURRENTMONTH2": "CurrentMonth",
    "CURRENTDAY": "CurrentDay", "CURRENTDAY2": "CurrentDay", "CURRENTTIME": "CurrentTime", "CURRENTTIMESTAMP": "CurrentTimestamp", "NUMBEROFPAGES": "NumberOfPages", "NUMBEROFARTICLES": "NumberOfArticles",
    "NUMBEROFFILES": "NumberOfFiles", "SITENAME": "SiteName", "SERVER": "Server", "SERVERNAME": "ServerName", "CONTENTLANGUAGE": "ContentLanguage", "CONTENTLANG": "ContentLanguage",
}


def magic_word(name: str) -> str:
    return _MAGIC.get(name.strip().upper(), "Unknown")


def magic_value(kind: str, title: str, namespace: str, now: datetime.datetime) -> str:
    from urllib.parse import quote

    full = f"{namespace}:{title}" if namespace else title
    url = lambda t: quote(t.replace(" ", "_"), safe="-_.~")
    return {
        "PageName": title, "PageNameE": url(title), "FullPageName": full, "FullPageNameE": url(full), "BasePageName": title.rpartition("/")[0] if "/" in title else title,
        "SubPageName": title.rpartition("/")[2], "RootPageName": title.partition("/")[0], "TalkPageName": "Talk:" + title, "SubjectPageName": title, "NameSpace": namespace, "NameSpaceE": url(namespace),
        "TalkSpace": "Talk", "SubjectSpace": "", "CurrentYear": f"{now.year}", "CurrentMonth": f"{now.month:02d}", "CurrentDay": f"{now.day:02d}", "CurrentTime": f"{now:%H:%M}",
        "CurrentTimestamp": f"{now:%Y%m%d%H%M%S}", "NumberOfPages": "0", "NumberOfArticles": "0", "NumberOfFiles": "0", "SiteName": "Wikipedia", "Server": "//en.wikipedia.org",
        "ServerName": "en.wikipedia.org", "ContentLanguage": "en",
    }.get(kind, "")
