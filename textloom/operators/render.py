"""Parsed markup to plain text, back to markup, and to JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from .parser import Node, Parser, text_of


@dataclass(frozen=True)
class PlainTextConfig:
    include_headings: bool = True
    heading_underlines: bool = False
    include_links: bool = True
    show_link_targets: bool = False
    include_lists: bool = True
    list_bullets: bool = True
    include_tables: bool = True
    preserve_paragraphs: bool = True
    collapse_whitespace: bool = True
    max_line_width: int = 0
    paragraph_separator: str = "\n\n"
    list_item_prefix: str = "• "


_DROPPED = frozenset(("Template", "Parameter", "Comment", "Redirect", "Category", "MagicWord", "Caption", "TemplateParameter"))


def to_plain_text(text: str, config: PlainTextConfig = PlainTextConfig()) -> str:
    """Readable text: link labels, list bullets, cells with tabs; templates, comments and categories go."""
    c, out = config, []

    def paragraph() -> None:
        done = "".join(out[-3:]).rstrip(" \t")
        if out and not done.endswith(c.paragraph_separator):
            out.append(c.paragraph_separator if not done.endswith("\n") else c.paragraph_separator[1:])

    todo: list = [Parser().parse(text)]
    while todo:
        n = todo.pop()
        if callable(n):
            n()
            continue
        kids = list(reversed(n.children))
        kind = n.type
        if kind in ("Text", "NoWiki"):
            out.append(n.text or "")
        elif kind in _DROPPED:
            continue
        elif kind == "Link":
            if c.include_links:
                target = n.target + ("#" + n.anchor if n.anchor else "")
                if c.show_link_targets:
                    out.append("[")
                    todo.append(lambda t=target: out.append(f"]({t})"))
                if n.flag and n.children:
                    todo += kids
                else:
                    out.append(target)
        elif kind == "ExternalLink":
            if c.include_links:
                if n.children:
                    if c.show_link_targets:
                        out.append("[")
                        todo.append(lambda t=n.url: out.append(f"]({t})"))
                    todo += kids
                elif c.show_link_targets:
                    out.append(n.url)
        elif kind == "Heading":
            if c.include_headings:
                paragraph()
                title = text_of(n.children).strip()
                out.append(title + "\n")
                if c.heading_underlines:
                    out.append(("=" if n.level <= 2 else "-") * len(title) + "\n")
                out.append("\n")
        elif kind == "ListItem":
            if c.include_lists:
                if out and not out[-1].endswith("\n"):
                    out.append("\n")
                out.append("  " * (n.level - 1) + (c.list_item_prefix if c.list_bullets else ""))
                todo.append(lambda: out.append("\n"))
                if kids and kids[-1].type == "Text":
                    kids[-1].text = kids[-1].text.lstrip(" ")
                todo += kids
        elif kind == "Table":
            if c.include_tables:
                if out and not out[-1].endswith("\n"):
                    out.append("\n")
                todo += kids
        elif kind == "TableRow":
            todo.append(lambda: out.append("\n"))
            todo += [k for k in kids if k.type == "TableCell"]
        elif kind == "TableCell":
            todo.append(lambda: out.append("\t"))
            if kids and kids[-1].type == "Text":
                kids[-1].text = kids[-1].text.lstrip(" ")
            todo += kids
        elif kind == "HtmlTag":
            if n.name in ("ref", "references"):
                continue
            if n.name == "br":
                out.append("\n")
            elif n.name == "p":
                paragraph()
            todo += kids
        elif kind == "HorizontalRule":
            out.append("\n" + "-" * (c.max_line_width or 3) + "\n")
        else:
            todo += kids
    s = "".join(out)
    if c.collapse_whitespace:
        s = re.sub(r"\n[ \t]*(?:\n[ \t]*)+|\n[ \t]+", "\n", re.sub(r"[ \t]+", " ", s)) if c.include_lists is False else re.sub(r"\n(?:[ \t]*\n)+", "\n", re.sub(r"(?<=\S)[ \t]+", _blank, s))
    s = s.strip()
    return word_wrap(s, c.max_line_width) if c.max_line_width else s


def _blank(m: re.Match) -> str:
    return "\t" if "\t" in m.group() else " "


def word_wrap(text: str, width: int) -> str:
    """Lines of at most width, broken at spaces; a longer word stays whole."""
    out = []
    for line in text.split("\n"):
        while len(line) > width:
            cut = line.rfind(" ", 0, width + 1)
            if cut <= 0:
                cut = line.find(" ", width)
            if cut < 0:
                break
            out.append(line[:cut])
            line = line[cut + 1 :]
        out.append(line)
    return "\n".join(out)


def first_paragraph(text: str) -> str:
    """Plain text up to the first blank line, heading, rule or table (those at the beginning don't count)."""
    root = Parser().parse(text)
    out: list[str] = []
    for n in root.children:
        if n.type in ("Heading", "HorizontalRule", "Table"):
            if "".join(out).strip():
                break
            out = []
            continue
        piece = to_plain_text(text[n.begin : n.end]) if n.type not in ("Text", "NoWiki") else n.text or ""
        before, blank, _ = piece.partition("\n\n") if n.type == "Text" else (piece, "", "")
        if n.type == "Text" and blank and not ("".join(out) + before).strip():
            piece = piece.lstrip()
            before, blank, _ = piece.partition("\n\n")
        out.append(before)
        if blank:
            break
        if "\n\n" in "".join(out).lstrip():
            break
    return "".join(out).strip().split("\n\n")[0]


def summary(text: str, most: int = 500) -> str:
    """The plain text, or its beginning up to a sentence's end in the second half of most, else a space, else
    most; '...' follows unless it ends with . ! or ?"""
    full = to_plain_text(text)
    if len(full) <= most:
        return full
    cut = next((i + 1 for i in range(most, most // 2, -1) if full[i] in ".!?" and (i + 1 >= len(full) or full[i + 1] in " \t\n\r")), 0)
    if not cut:
        cut = full.rfind(" ", 0, most + 1)
        cut = cut if cut > 0 else most
    out = full[:cut].rstrip(" \t\n\r")
    return out if not out or out[-1] in ".!?" else out + "..."


_QUOTE = {"italic": "''", "bold": "'''", "bold_italic": "'''''"}


def to_wikitext(node: Node) -> str:
    """Markup that parses to the same tree."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        kids, kind = list(reversed(n.children)), n.type
        if kind == "Text":
            out.append(n.text or "")
        elif kind == "NoWiki":
            out.append(f"<nowiki>{n.text}</nowiki>")
        elif kind == "Comment":
            out.append(f"<!--{n.text}-->")
        elif kind == "MagicWord":
            out.append(f"__{n.text}__")
        elif kind == "HorizontalRule":
            out.append(n.text)
        elif kind == "Redirect":
            out.append(f"#REDIRECT [[{n.target}]]")
        elif kind == "Category":
            out.append(f"[[Category:{n.name}" + (f"|{n.sort_key}" if n.sort_key else "") + "]]")
        elif kind == "Heading":
            out.append("=" * n.level + (n.text or "") + "=" * n.level + "\n")
        elif kind == "Formatting":
            todo += [_QUOTE[n.style], *kids, _QUOTE[n.style]]
        elif kind == "Link":
            todo += ["]]", *kids, "[[" + n.target + ("#" + n.anchor if n.anchor else "") + ("|" if n.flag else "")]
        elif kind == "ExternalLink":
            todo += ["]", *kids, "[" + n.url + (" " if kids else "")]
        elif kind == "Template":
            todo += ["}}", *kids, "{{" + n.name]
        elif kind == "TemplateParameter":
            todo += [*kids, "|" + (n.name + "=" if n.name else "")]
        elif kind == "Parameter":
            todo += ["}}}", *kids, "{{{" + n.name + ("|" if n.flag else "")]
        elif kind == "ListItem":
            todo += ["\n", *kids, n.name]
        elif kind == "Table":
            todo += ["|}", *kids, "{|" + (" " + n.attrs if n.attrs else "") + "\n"]
        elif kind == "Caption":
            todo += ["\n", *kids, "|+"]
        elif kind == "TableRow":
            todo += [*kids, "|-" + (" " + n.attrs if n.attrs else "") + "\n"]
        elif kind == "TableCell":
            todo += ["\n", *kids, ("!" if n.flag else "|") + (" " + n.attrs + " |" if n.attrs else "")]
        elif kind == "HtmlTag":
            todo += [*(() if n.flag else (f"</{n.name}>",)), *kids, f"<{n.name}" + (" " + n.attrs if n.attrs else "") + ("/>" if n.flag else ">")]
        else:
            todo += kids
    return "".join(out)


_JSON = {"Heading": ("level",), "Formatting": ("style",), "Link": ("target", "anchor"), "ExternalLink": ("url",), "Template": ("name",), "Parameter": ("name",), "List": ("style",), "ListItem": ("level",), "HtmlTag": ("name", "attrs", "flag"), "Category": ("name", "sort_key"), "Table": ("attrs",), "TableRow": ("attrs",), "TableCell": ("attrs", "flag"), "Redirect": ("target",), "TemplateParameter": ("name",)}
_NAMES = {"style": "style", "flag": "self_closing", "sort_key": "sort_key"}


def to_json(text: str, *, locations: bool = False, indent: int | None = None) -> str:
    """The tree as nested JSON objects."""
    root = Parser().parse(text)
    done: dict[int, dict] = {}
    todo: list = [(root, False)]
    while todo:
        n, ready = todo.pop()
        if not ready:
            todo.append((n, True))
            todo += [(k, False) for k in n.children]
            continue
        own: dict = {"type": n.type}
        if locations:
            own["location"] = {"start": n.begin, "end": n.end}
        if n.type in ("Text", "Comment", "NoWiki", "MagicWord"):
            own["text"] = n.text
        for f in _JSON.get(n.type, ()):
            own[_NAMES.get(f, f)] = getattr(n, f)
        if n.children and n.type != "Text":
            own["content"] = [done.pop(id(k)) for k in n.children]
        done[id(n)] = own
    return json.dumps(done[id(root)], ensure_ascii=False, indent=indent)
