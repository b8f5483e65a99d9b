"""Wiki markup to a flat table of nodes, in plain Python with a stack instead of recursion.

A node row is (id, parent, depth, role, type, text, target, anchor, url, name, sort_key, level, style, flag,
attrs, begin, end, last_desc); ids are in document order, so a subtree is a range of ids.
"""

from __future__ import annotations

import re

from .lexer import _REFERENCES, CATEGORY_PREFIXES, Token, heading_line, redirect_target, tokens

FIELDS = "id parent depth role type text target anchor url name sort_key level style flag attrs begin end last_desc".split()
_STYLES = {"Italic": "italic", "Bold": "bold", "BoldItalic": "bold_italic"}
_OPEN = {"LinkOpen": "Link", "Category": "Category", "ExternalLinkOpen": "ExternalLink", "TemplateOpen": "Template", "ParserFunction": "Template", "ParameterOpen": "Parameter"}
_CLOSE = {"LinkClose": ("Link", "Category"), "ExternalLinkClose": ("ExternalLink",), "TemplateClose": ("Template",), "ParameterClose": ("Parameter",)}
_WHOLE = frozenset(("List", "ListItem", "Table", "TableRow", "TableCell", "HtmlTag", "Formatting", "Caption"))
_OVER_LINES = frozenset(("Template", "Parameter", "Table", "TableRow", "TableCell", "Caption", "HtmlTag", "Link", "Category"))
_LIST_TYPES = {"BulletList": "bullet", "NumberedList": "numbered", "DefinitionTerm": "definition", "Indent": "definition"}


class Node:
    """Fields that a node doesn't set are the class's."""

    text = target = anchor = url = name = sort_key = style = attrs = None
    level, flag = 0, False

    def __init__(self, kind: str, begin: int, role: str = "content", raw: str = ""):
        self.type = kind
        self.role = self.part = role
        self.begin = self.end = begin
        self.raw = raw
        self.children: list[Node] = []


def text_of(nodes: list[Node]) -> str:
    """Text and nowiki of a subtree, in order; other leaves give nothing."""
    out, todo = [], list(reversed(nodes))
    while todo:
        n = todo.pop()
        if n.type in ("Text", "NoWiki"):
            out.append(n.text or "")
        elif n.type == "HorizontalRule":
            out.append("\n")
        elif n.type not in ("Comment", "MagicWord", "Redirect", "Category"):
            todo += reversed(n.children)
    return "".join(out)


def _leaf_text(kind: str, text: str) -> str:
    if kind == "HtmlComment":
        return text[4:-3] if text.endswith("-->") else text[4:]
    return text.strip("_") if kind == "MagicWord" else text


class Parser:
    """parse() gives the tree's root. Whatever isn't closed becomes the text of its opening mark."""

    def __init__(self, *, tables: bool = True, lists: bool = True, max_depth: int = 100, preserve_comments: bool = True):
        self.tables, self.lists, self.max_depth, self.preserve_comments = tables, lists, max_depth, preserve_comments
        self.errors: list[str] = []

    def parse(self, source: str) -> Node:
        self.source, self.errors = source, []
        root = Node("Document", 0)
        root.end = len(source)
        self.stack = [root]
        if (target := redirect_target(source)) is not None:
            root.flag, root.target = True, target
        skip, stack, rest = -1, self.stack, self._token
        for t in tokens(source, preserve_comments=self.preserve_comments, extra_tags=_REFERENCES):
            begin = t[2]
            if begin < skip:
                continue
            if t[0] != "Text":
                skip = rest(t, skip)
                continue
            top = stack[-1]  # most tokens are text: as _text, without calls
            if top.type == "List":
                self._unwind(next(i for i, n in enumerate(stack) if n.type == "List"), begin)
                top = stack[-1]
            text, kids, role = t[1], top.children, top.part
            if kids:
                last = kids[-1]
                if last.type == "Text" and last.end == begin and last.role == role:
                    last.text += text
                    last.end = begin + len(text)
                    continue
            n = Node("Text", begin)
            n.text, n.end, n.role = text, begin + len(text), role
            kids.append(n)
        self._unwind(0)
        return root

    # stack
    def _add(self, node: Node) -> Node:
        top = self.stack[-1]
        node.role = top.part if top.part != "content" else node.role
        kids = top.children
        if node.type == "Text" and kids and kids[-1].type == "Text" and kids[-1].role == node.role and kids[-1].end == node.begin:
            kids[-1].text += node.text
            kids[-1].end = node.end
            return kids[-1]
        kids.append(node)
        return node

    def _text(self, text: str, begin: int) -> None:
        n = Node("Text", begin)
        n.text, n.end = text, begin + len(text)
        self._add(n)

    def _push(self, node: Node) -> None:
        if len(self.stack) > self.max_depth:
            if not self.errors:
                self.errors.append(f"Error: maximum depth exceeded at offset {node.begin}")
            self._text(node.raw or "", node.begin)
            return
        self._add(node)
        self.stack.append(node)

    def _find(self, kinds: tuple[str, ...]) -> int:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].type in kinds:
                return i
            if self.stack[i].type in ("Template", "Parameter", "Table"):
                return -1
        return -1

    def _unwind(self, depth: int, end: int | None = None) -> None:
        """Closes what is above depth: blocks are whole, inline constructs turn into text."""
        depth, stack = max(1, depth), self.stack
        while len(stack) > depth:
            n = stack.pop()
            if n.type in _WHOLE:
                n.end = end if end is not None else n.children[-1].end if n.children else n.begin + len(n.raw)
                if n.type == "TableCell":
                    self._cell(n)
                continue
            parent = stack[-1]
            at = len(parent.children) - 1  # what is open is the last
            if parent.children[at] is not n:
                at = parent.children.index(n)
            mark = Node("Text", n.begin, n.role)
            mark.text, mark.end = n.raw, n.begin + len(n.raw)
            kids = n.children
            if n.raw in ("{{", "[[", "{{{") and n.sort_key is None:
                kids = self._restored(n)
            for k in kids:
                k.role = n.role
            parent.children[at : at + 1] = [mark, *kids]

    def _restored(self, n: Node) -> list[Node]:
        """Children of an unclosed construct, the bars between its parts as text again."""
        out, part = [], "display" if n.type in ("Link", "Category") else "name"
        for k in n.children:
            if k.type == "Bar":
                m = Node("Text", k.begin)
                m.text, m.end = "|", k.begin + 1
                out.append(m)
            else:
                out.append(k)
        del part
        return out

    def _line_end(self, at: int) -> None:
        """Closes what can't go beyond a line."""
        if len(self.stack) == 1:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].type in _OVER_LINES:
                self._unwind(i + 1, at)
                return
        lists = next((i for i, n in enumerate(self.stack) if n.type == "List"), None)
        self._unwind(lists + 1 if lists is not None else 1, at)

    # tokens
    def _token(self, t: Token, skip: int) -> int:
        kind, top = t.type, self.stack[-1]
        if kind == "EndOfInput":
            return skip
        at_line_start = t.begin == 0 or self.source[t.begin - 1] == "\n"
        if top.type == "List" and not (at_line_start and kind in _LIST_TYPES):
            self._unwind(next(i for i, n in enumerate(self.stack) if n.type == "List"), t.begin)
            top = self.stack[-1]
        if kind == "Newline":
            self._line_end(t.begin)
            if self.stack[-1].type == "List":
                return skip
            if self.stack[-1].type in ("Link", "Category") and self.source.startswith("\n", t.begin + 1):
                self._unwind(len(self.stack) - 1, t.begin)
            if self.stack[-1].type == "Caption":
                self._unwind(len(self.stack) - 1, t.begin)
            if self.stack[-1].type not in ("Table", "TableRow"):
                self._text("\n", t.begin)
        elif kind == "Heading":
            if at_line_start and top.type not in ("Template", "Parameter", "Link", "ExternalLink"):
                end = self.source.find("\n", t.begin)
                end = len(self.source) if end < 0 else end
                raw = self.source[t.begin : end]
                if (h := heading_line(re.sub(r"<!--.*?-->", "", raw))) is not None:
                    self._block(t.begin)
                    n = Node("Heading", t.begin)
                    n.level, n.text, n.end = h[0], h[1], end
                    inner = Node("Text", t.begin + h[0])
                    inner.text, inner.end = h[1], t.begin + h[0] + len(h[1])
                    n.children = [inner]
                    self._add(n)
                    return min(end + 1, len(self.source))
            self._text(t.text, t.begin)
        elif kind in _STYLES:
            self._style(t)
        elif kind in _OPEN:
            n = Node(_OPEN[kind], t.begin, raw=t.text)
            n.part, n.flag = ("target" if n.type in ("Link", "Category") else "url" if n.type == "ExternalLink" else "name"), kind == "ParserFunction"
            self._push(n)
        elif kind in _CLOSE:
            self._close(t)
        elif kind in ("Pipe", "LinkSeparator", "Equals"):
            self._separator(t)
        elif kind in _LIST_TYPES and self.lists and at_line_start:
            self._item(t)
        elif kind.startswith("Table") and self.tables:
            return self._table(t, skip)
        elif kind == "HtmlTagOpen":
            n = Node("HtmlTag", t.begin, raw=t.text)
            n.name, n.flag, n.end = t.tag_name, t.self_closing, t.begin + len(t.text)
            n.attrs = t.text[1 + len(t.tag_name) : -1].rstrip("/").strip()
            if t.self_closing:
                self._add(n)
            else:
                self._push(n)
        elif kind == "HtmlTagClose":
            i = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].type == "HtmlTag" and self.stack[i].name == t.tag_name), -1)
            if i > 0 and not any(n.type in ("Template", "Parameter", "TableCell") for n in self.stack[i + 1 :]):
                self._unwind(i + 1, t.begin)
                self.stack.pop().end = t.begin + len(t.text)
            else:
                self._text(t.text, t.begin)
        elif kind in ("HtmlComment", "NoWiki", "MagicWord", "HorizontalRule", "Redirect"):
            if kind == "HorizontalRule":
                self._block(t.begin)
            n = Node("Comment" if kind == "HtmlComment" else kind, t.begin, raw=t.text)
            n.text = _leaf_text(kind, t.text)
            n.end = t.begin + len(t.text)
            if kind == "Redirect":
                m = re.compile(r".*?\[\[(.*?)\]\]", re.S).match(self.source, t.begin)
                n.text, n.target, n.end = None, m.group(1), m.end()
                self._add(n)
                return m.end()
            self._add(n)
        else:
            self._text(t.text, t.begin)
        return skip

    def _block(self, at: int) -> None:
        """A block at line start ends all but tables, cells, templates and tags."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].type in ("Template", "Parameter", "Table", "TableRow", "TableCell", "HtmlTag"):
                self._unwind(i + 1, at)
                return
        self._unwind(1, at)

    def _style(self, t: Token) -> None:
        style = _STYLES[t.type]
        for i in range(len(self.stack) - 1, 0, -1):
            n = self.stack[i]
            if n.type == "Formatting" and n.style == style:
                self._unwind(i + 1, t.begin)
                self.stack.pop().end = t.begin + len(t.text)
                return
            if n.type != "Formatting":
                break
        n = Node("Formatting", t.begin, raw=t.text)
        n.style = style
        self._push(n)

    def _separator(self, t: Token) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            n = self.stack[i]
            if n.type in ("Formatting", "HtmlTag"):
                continue
            if n.type in ("Template", "Parameter") and t.type == "Pipe" or n.type in ("Link", "Category") and t.type == "LinkSeparator":
                if n.type in ("Link", "Category") and n.part == "display":
                    break
                self._unwind(i + 1, t.begin)
                bar = Node("Bar", t.begin)
                bar.end = t.begin + 1
                n.children.append(bar)
                n.part = "display" if n.type in ("Link", "Category") else "default" if n.type == "Parameter" else "param"
                return
            if n.type == "Template" and t.type == "Equals" and n.part == "param" and i == len(self.stack) - 1:
                mark = Node("Equal", t.begin)
                mark.end = t.begin + 1
                n.children.append(mark)
                n.part = "param_value"
                return
            if n.type in ("TableCell", "TableRow") and t.type == "Pipe" and i == len(self.stack) - 1 and not n.flag and n.type == "TableCell" and n.attrs is None:
                n.attrs = text_of(n.children).strip()
                n.children = []
                return
            break
        self._text(t.text, t.begin)

    def _close(self, t: Token) -> None:
        i = self._find(_CLOSE[t.type]) if t.type in ("LinkClose", "ExternalLinkClose") else next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].type in _CLOSE[t.type]), -1)
        if i < 0:
            self._text(t.text, t.begin)
            return
        self._unwind(i + 1, t.begin)
        n = self.stack.pop()
        n.end = t.begin + len(t.text)
        n.raw = self.source[n.begin : n.end]
        if n.type in ("Link", "Category"):
            inner = n.raw[2:-2]
            target, bar, display = inner.partition("|")
            if n.type == "Category":
                n.name = next((target[len(p) :] for p in CATEGORY_PREFIXES if target.startswith(p)), target)
                n.sort_key = display
                n.children = []
            else:
                n.target, hash_, n.anchor = target.partition("#")
                n.flag = bool(bar)
                n.children = [k for k in n.children if k.type != "Bar" and k.role == "display"]
        elif n.type == "ExternalLink":
            inner = n.raw[1:-1]
            n.url, blank, label = inner.partition(" ")
            n.flag = True
            kids, cut = [], n.begin + 1 + len(n.url) + len(blank)
            for k in n.children:
                if k.type == "Text" and k.begin < cut < k.end and k.end - k.begin == len(k.text):
                    k.text, k.begin = k.text[cut - k.begin :], cut
                if k.begin >= cut:
                    k.role = "display"
                    kids.append(k)
            n.children = kids if blank else []
        elif n.type == "Parameter":
            name = n.raw[3:-3].partition("|")[0]
            n.name = name.strip()
            n.flag = any(k.type == "Bar" for k in n.children)
            n.children = [k for k in n.children if k.type != "Bar" and k.role == "default"]
        else:
            self._template(n)

    def _template(self, n: Node) -> None:
        parts: list[list[Node]] = [[]]
        for k in n.children:
            if k.type == "Bar":
                parts.append([])
            else:
                parts[-1].append(k)
        n.name = self.source[n.begin + 2 : parts[0][-1].end if parts[0] else n.begin + 2].strip()
        n.children = []
        for p in parts[1:]:
            eq = next((i for i, k in enumerate(p) if k.type == "Equal"), -1)
            v = Node("TemplateParameter", p[0].begin if p else n.end, "param_value")
            v.name = text_of(p[:eq]).strip() if eq >= 0 else ""
            v.children = [k for k in p[eq + 1 :] if k.type != "Equal"]
            v.end = v.children[-1].end if v.children else v.begin
            v.text = self.source[(p[eq].end if eq >= 0 else v.begin) : v.end] if v.children else ""
            for k in v.children:
                k.role = "content"
            n.children.append(v)

    def _item(self, t: Token) -> None:
        i = next((i for i, n in enumerate(self.stack) if n.type == "List"), -1)
        if i >= 0:
            self._unwind(i + 1, t.begin)
        else:
            self._block(t.begin)
            n = Node("List", t.begin, raw="")
            n.style = _LIST_TYPES[t.type]
            self._push(n)
        item = Node("ListItem", t.begin, "items", raw=t.text)
        item.level, item.flag, item.name = t.level, t.text[-1] == ";", t.text
        if self.stack[-1].type == "List":
            self._push(item)
            item.role = "items"

    def _table(self, t: Token, skip: int) -> int:
        kind = t.type
        end = self.source.find("\n", t.begin)
        end = len(self.source) if end < 0 else end
        if kind == "TableStart":
            self._block(t.begin)
            n = Node("Table", t.begin, raw="{|")
            n.attrs = self.source[t.begin + 2 : end].strip()
            self._push(n)
            return end if self.stack[-1] is n else skip
        i = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].type == "Table"), -1)
        if i < 0:
            self._text(t.text, t.begin)
            return skip
        if kind == "TableEnd":
            self._unwind(i + 1, t.begin)
            self.stack.pop().end = t.begin + 2
        elif kind == "TableRowStart":
            self._unwind(i + 1, t.begin)
            n = Node("TableRow", t.begin, "rows", raw="|-")
            n.attrs = self.source[t.begin + 2 : end].lstrip("-").strip()
            self._push(n)
            n.role = "rows"
            return end
        elif kind == "TableCaption":
            self._unwind(i + 1, t.begin)
            n = Node("Caption", t.begin, "caption", raw="|+")
            self._push(n)
            n.role = "caption"
        else:
            row = next((k for k in range(len(self.stack) - 1, i, -1) if self.stack[k].type == "TableRow"), -1)
            header = t.text[0] == "!"
            if t.text == "||" and row > 0 and len(self.stack) > row + 1 and self.stack[row + 1].type == "TableCell":
                header = self.stack[row + 1].level == 1
            if row < 0:
                self._unwind(i + 1, t.begin)
                n = Node("TableRow", t.begin, "rows", raw="")
                self._push(n)
                n.role = "rows"
                row = len(self.stack) - 1
            self._unwind(row + 1, t.begin)
            n = Node("TableCell", t.begin, "cells", raw=t.text)
            n.level = int(header)
            self._push(n)
            n.role = "cells"
        return skip

    def _cell(self, n: Node) -> None:
        n.flag = n.level == 1
        while n.children and n.children[-1].type == "Text" and not n.children[-1].text.strip():
            n.children.pop()
        if n.children and n.children[-1].type == "Text":
            n.children[-1].text = n.children[-1].text.rstrip("\n")


_PAIRS = {"LinkOpen": "LinkClose", "Category": "LinkClose", "ExternalLinkOpen": "ExternalLinkClose", "TemplateOpen": "TemplateClose", "ParserFunction": "TemplateClose", "ParameterOpen": "ParameterClose"}
_CLOSES = frozenset(_PAIRS.values())
_WITHIN = frozenset(("Text", "Pipe", "LinkSeparator", "Equals", *_STYLES, "NoWiki", "HtmlComment", "MagicWord", "EndOfInput"))
_CELLS = frozenset(("TableRowStart", "TableCaption", "TableDataCell", "TableHeaderCell"))


def outermost(source: str, kind: str) -> list[tuple[int, str]] | None:
    """(level, text) of the nodes of a type, Heading, HorizontalRule, Comment, NoWiki or MagicWord, without a tree: of
    texts whose marks are in pairs, one within the other, and that have such nodes outside of all pairs only, tokens
    tell all. None of any other text: then the parser must decide."""
    wanted = "HtmlComment" if kind == "Comment" else kind
    out: list[tuple[int, str]] = []
    open_: list[str] = []  # what ends each pair: a kind of token, or a tag's name behind /
    skip = -1
    for t in tokens(source, preserve_comments=True, extra_tags=_REFERENCES):
        name, text, begin = t[0], t[1], t[2]
        if begin < skip:
            continue
        if name == wanted and name != "Heading":
            if open_:
                return None
            out.append((0, _leaf_text(name, text)))
        elif name in _WITHIN:
            continue
        elif name == "Newline":
            if open_ and open_[-1] in ("LinkClose", "ExternalLinkClose"):
                return None
        elif name in _PAIRS:
            open_.append(_PAIRS[name])
            if len(open_) > 10:
                return None
        elif name in _CLOSES or name == "TableEnd":
            if not open_ or open_.pop() != name:
                return None
        elif name == "HtmlTagOpen":
            if not t[5]:
                open_.append("/" + t[4])
        elif name == "HtmlTagClose":
            if not open_ or open_.pop() != "/" + t[4]:
                return None
        elif name == "Heading":
            if begin and source[begin - 1] != "\n":
                continue
            if open_:
                return None
            end = source.find("\n", begin)
            end = len(source) if end < 0 else end
            if (h := heading_line(re.sub(r"<!--.*?-->", "", source[begin:end]))) is not None:
                skip = min(end + 1, len(source))
                if kind == "Heading":
                    out.append(h)
        elif name in _CELLS:
            if open_ != ["TableEnd"]:
                return None
            if name == "TableRowStart":
                skip = source.find("\n", begin)
                skip = len(source) if skip < 0 else skip
        elif open_ or name == "Redirect":
            return None
        elif name == "TableStart":
            open_.append("TableEnd")
            skip = source.find("\n", begin)
            skip = len(source) if skip < 0 else skip
    return out


def flatten(root: Node) -> list[tuple]:
    """Rows of FIELDS in document order."""
    out: list[list] = []
    todo: list[tuple] = [(root, -1, 0)]
    while todo:
        n, parent, depth = todo.pop()
        if n is None:
            out[parent][17] = len(out) - 1
            continue
        i = len(out)
        out.append([i, parent, depth, n.role, n.type, n.text, n.target, n.anchor, n.url, n.name, n.sort_key, n.level, n.style, n.flag, n.attrs, n.begin, n.end, i])
        todo.append((None, i, 0))
        todo += [(k, i, depth + 1) for k in reversed(n.children) if k.type not in ("Bar", "Equal")]
    return [tuple(r) for r in out]


def parse(text: str, **options) -> list[tuple]:
    return flatten(Parser(**options).parse(text))
