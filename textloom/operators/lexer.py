"""Wiki markup to tokens, in plain Python without recursion. Offsets are code points."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_TAG_GROUPS = {
    "blocks": "p div center blockquote pre h6 h5 h4 h3 h2 h1 hr",
    "lists": "li ol ul dd dt dl",
    "tables": "td th tr colgroup col caption table",
    "phrases": "i b u s tt em strong code kbd samp var cite dfn abbr q small big sub sup mark strike del ins font span",
    "scripts": "bdo bdi ruby rt rp rb",
    "other": "wbr br time data link meta",
}
HTML_TAGS = frozenset(t for g in _TAG_GROUPS.values() for t in g.split())
CATEGORY_PREFIXES = ("Category:", "category:", "Kategoria:", "kategoria:")
MARKERS = ("#REDIRECT", "</ref>", "<ref", *(ch * 2 for ch in "='}{]["), "|}", "{|", "'" * 3)
REDIRECT = re.compile(r"[ \t\n\r]*#REDIRECT.*?\[\[(.*?)\]\]", re.I | re.S)
VOID_TAGS = frozenset("br hr wbr col link meta".split())


class Token(NamedTuple):
    type: str
    text: str
    begin: int
    level: int = 0
    tag_name: str = ""
    self_closing: bool = False


_TEXT = re.compile(r"[\s\S][^\n|\[\]{}'<=_*#;:!\-]*")
_MARKS = frozenset("'[]{}|!=<_")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*|/)?)>")
_NOWIKI = re.compile(r"<nowiki\s*/>|<nowiki>(.*?)(?:</nowiki>|\Z)", re.S)
_MAGIC = re.compile(r"__[A-Za-z0-9]+__")
_LISTS = {"*": "BulletList", "#": "NumberedList", ";": "DefinitionTerm", ":": "Indent"}
_QUOTES = {2: "Italic", 3: "Bold"}
_REFERENCES = frozenset(("ref", "references"))


_BRACKETS = re.compile(r"<!--.*?(?:-->|\Z)|<nowiki\s*/>|<nowiki>.*?(?:</nowiki>|\Z)|\{{2,}|\}{2,}|\[\[|\]\]|\n[ \t]*\n", re.S)


def matched(text: str) -> tuple[dict[int, int], dict[int, int]]:
    """({offset of an opening: its size}, {offset of a closing: its size}) of braces (2 or 3) and links that are
    closed. A link doesn't go over a blank line nor out of the braces that it is in."""
    opens: dict[int, int] = {}
    closes: dict[int, int] = {}
    stack: list[list[int]] = []  # [offset, braces left], 0 braces: a link
    for m in _BRACKETS.finditer(text):
        ch, at = m.group()[0], m.start()
        if ch == "{":
            stack.append([at, len(m.group())])
        elif ch == "[":
            stack.append([at, 0])
        elif ch == "\n":
            while stack and not stack[-1][1]:
                stack.pop()
        elif ch == "]":
            if stack and not stack[-1][1]:
                opens[stack.pop()[0]], closes[at] = 2, 2
        elif ch == "}":
            left = len(m.group())
            while left >= 2:
                while stack and not stack[-1][1]:
                    stack.pop()
                if not stack:
                    break
                size = 3 if left >= 3 and stack[-1][1] >= 3 else 2
                stack[-1][1] -= size
                opens[stack[-1][0] + stack[-1][1]], closes[at] = size, size
                at, left = at + size, left - size
                if stack[-1][1] < 2:
                    stack.pop()
    return opens, closes


def tokens(text: str, *, preserve_comments: bool = False, recognize_redirects: bool = True, recognize_categories: bool = True, extra_tags: frozenset = frozenset()) -> Iterator[Token]:
    """All tokens of text, in order. What is open is kept on a stack: the innermost construct decides what a bar
    or a run of closing braces means. Ends with EndOfInput."""
    new, piece = tuple.__new__, _TEXT.match  # a token's own constructor takes as long as all else
    stack: list[str] = []  # link, external, template, parameter
    n, at, line_start, table = len(text), 0, True, 0
    opens, closes = matched(text)
    if recognize_redirects and (m := REDIRECT.match(text)):
        lead = text.index("#")
        yield new(Token, ("Redirect", text[lead : lead + 9], lead, 0, "", False))
        at, line_start = lead + 9, False
    while at < n:
        ch = text[at]
        if ch == "\n":
            yield new(Token, ("Newline", "\n", at, 0, "", False))
            at, line_start = at + 1, True
            while stack and stack[-1] == "external":
                stack.pop()
            continue
        if line_start:
            own = not stack or stack[-1] in ("template", "parameter")
            if text.startswith("----", at):
                end = at
                while end < n and text[end] == "-":
                    end += 1
                yield new(Token, ("HorizontalRule", text[at:end], at, 0, "", False))
                at, line_start = end, False
                continue
            if text.startswith("{|", at) and not text.startswith("{|}", at):
                table += 1
                yield new(Token, ("TableStart", "{|", at, 0, "", False))
                at, line_start = at + 2, False
                continue
            if table and own and ch in "|!":
                for mark, kind in (("|}", "TableEnd"), ("|-", "TableRowStart"), ("|+", "TableCaption"), ("|", "TableDataCell"), ("!", "TableHeaderCell")):
                    if text.startswith(mark, at) and not (mark == "|}" and text.startswith("|}}", at) and stack):
                        break
                else:
                    kind = ""
                if kind and not (stack and kind == "TableDataCell"):
                    table -= kind == "TableEnd"
                    yield new(Token, (kind, mark, at, 0, "", False))
                    at, line_start = at + len(mark), False
                    continue
            if ch in _LISTS and own and not stack:
                end = at
                while end < n and text[end] in "*#;:":
                    end += 1
                yield new(Token, (_LISTS[ch], text[at:end], at, end - at, "", False))
                at, line_start = end, False
                continue
        start = line_start
        line_start = False
        if ch not in _MARKS:
            end = piece(text, at).end()
            yield new(Token, ("Text", text[at:end], at, 0, "", False))
            at = end
        elif ch == "'":
            end = at
            while end < n and text[end] == "'":
                end += 1
            k = end - at
            if k == 1:
                yield new(Token, ("Text", "'", at, 0, "", False))
            elif k < 4:
                yield new(Token, (_QUOTES[k], text[at:end], at, 0, "", False))
            elif k == 4:
                yield new(Token, ("Bold", "'''", at, 0, "", False))
                yield new(Token, ("Text", "'", at + 3, 0, "", False))
            else:
                yield new(Token, ("BoldItalic", "'''''", at, 0, "", False))
                if k > 5:
                    yield new(Token, ("Text", "'" * (k - 5), at + 5, 0, "", False))
            at = end
        elif ch == "[":
            if at in opens:
                rest = text[at + 2 : at + 2 + 32]
                kind = "Category" if recognize_categories and rest.startswith(CATEGORY_PREFIXES) else "LinkOpen"
                yield new(Token, (kind, "[[", at, 0, "", False))
                stack.append("link")
                at += 2
            elif text.startswith("[[", at):
                yield new(Token, ("Text", "[[", at, 0, "", False))
                at += 2
            else:
                yield new(Token, ("ExternalLinkOpen", "[", at, 0, "", False))
                stack.append("external")
                at += 1
        elif ch == "]":
            if at in closes and (not stack or stack[-1] != "external"):
                yield new(Token, ("LinkClose", "]]", at, 0, "", False))
                if stack and stack[-1] == "link":
                    stack.pop()
                at += 2
            else:
                yield new(Token, ("ExternalLinkClose", "]", at, 0, "", False))
                if stack and stack[-1] == "external":
                    stack.pop()
                at += 1
        elif ch == "{":
            size = opens.get(at, 1)
            if size == 3:
                yield new(Token, ("ParameterOpen", "{{{", at, 0, "", False))
                stack.append("parameter")
            elif size == 2:
                yield new(Token, ("ParserFunction" if text.startswith("{{#", at) else "TemplateOpen", "{{", at, 0, "", False))
                stack.append("template")
            else:
                yield new(Token, ("Text", "{", at, 0, "", False))
            at += size
        elif ch == "}":
            size = closes.get(at, 1)
            if size > 1:
                inner = "parameter" if size == 3 else "template"
                while inner in stack and stack.pop() != inner:
                    pass
            yield new(Token, (("Text", "TemplateClose", "ParameterClose")[size - 1], text[at : at + size], at, 0, "", False))
            at += size
        elif ch == "|":
            if stack and stack[-1] == "link":
                yield new(Token, ("LinkSeparator", "|", at, 0, "", False))
            elif table and not stack and text.startswith("||", at):
                yield new(Token, ("TableDataCell", "||", at, 0, "", False))
                at += 1
            else:
                yield new(Token, ("Pipe", "|", at, 0, "", False))
            at += 1
        elif ch == "!" and table and not stack and text.startswith("!!", at):
            yield new(Token, ("TableHeaderCell", "!!", at, 0, "", False))
            at += 2
        elif ch == "=":
            end = at
            while end < n and text[end] == "=":
                end += 1
            if stack and stack[-1] == "template" and not start:
                yield new(Token, ("Equals", "=", at, 0, "", False))
                at += 1
            else:
                yield new(Token, ("Heading", text[at:end], at, min(6, end - at), "", False))
                at = end
        elif ch == "<":
            if text.startswith("<!--", at):
                end = text.find("-->", at + 4)
                end = n if end < 0 else end + 3
                if preserve_comments:
                    yield new(Token, ("HtmlComment", text[at:end], at, 0, "", False))
                line_start = start  # a comment doesn't end the line's beginning
                at = end
            elif m := _NOWIKI.match(text, at):
                yield new(Token, ("NoWiki", m.group(1) or "", at, 0, "", False))
                at = m.end()
            elif (m := _TAG.match(text, at)) and (m.group(2) in HTML_TAGS or m.group(2) in extra_tags):
                void = m.group(3).endswith("/") or m.group(2) in VOID_TAGS
                yield new(Token, ("HtmlTagClose" if m.group(1) else "HtmlTagOpen", m.group(), at, 0, m.group(2), void and not m.group(1)))
                at = m.end()
            else:
                yield new(Token, ("Text", "<", at, 0, "", False))
                at += 1
        elif ch == "_" and (m := _MAGIC.match(text, at)):
            yield new(Token, ("MagicWord", m.group(), at, 0, "", False))
            at = m.end()
        else:
            end = piece(text, at).end()
            yield new(Token, ("Text", text[at:end], at, 0, "", False))
            at = end
    yield new(Token, ("EndOfInput", "", n, 0, "", False))


def plain_text(text: str) -> str:
    """Token-level plain text: the text between markup, link targets included; tokens of any other kind go."""
    return "".join(t.text for t in tokens(text) if t.type in ("Text", "Whitespace", "Newline"))


def looks_like_wikitext(text: str) -> bool:
    return any(m in text for m in MARKERS)


_COMMENT = re.compile(r"(<nowiki>.*?(?:</nowiki>|\Z)|<nowiki\s*/>)|<!--.*?(?:-->|\Z)", re.S)
_UNWRAP = re.compile(r"<nowiki>(.*?)(?:</nowiki>|\Z)|<nowiki\s*/>|<!--.*?(?:-->|\Z)|</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*|/)?>", re.S)


def strip_comments(text: str) -> str:
    """Without comments, but for those within nowiki; an open comment drops the rest."""
    return _COMMENT.sub(lambda m: m.group(1) or "", text)


def strip_comments_and_nowiki(text: str) -> str:
    """Without comments and known tags; nowiki gives its content."""
    return _UNWRAP.sub(lambda m: m.group(1) or "" if m.group(2) is None else "" if m.group(2) in HTML_TAGS else m.group(), text)


def heading_line(line: str) -> tuple[int, str] | None:
    """(level, title) of a line that is a heading."""
    s = line.rstrip(" \t\r")
    if not s.startswith("=") or not s.endswith("=") or len(s) < 3:
        return None
    left, right = len(s) - len(s.lstrip("=")), len(s) - len(s.rstrip("="))
    level = min(6, len(s) // 2 if left == len(s) else min(left, right))
    return level, s[level : len(s) - level]


def redirect_target(text: str) -> str | None:
    m = REDIRECT.match(text)
    return m.group(1) if m else None
