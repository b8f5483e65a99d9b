"""Markup operators on DataFrames: one parse a text, in Arrow batches.

Each relation (links, cells, sections, ...) is made where the text is parsed, so that only its own rows leave the
Python worker; ``node_table`` gives all nodes for whatever else is asked. Texts are spread over all cores first,
as a dump or a small table comes in few partitions while a parse costs much more than a shuffle of its text.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import _c, trim
from ..sources.shared import cut
from . import lexer, render, templates
from .parser import Node, Parser, outermost, parse

NODE = (
    "id:int, parent:int, depth:int, role:string, type:string, text:string, target:string, anchor:string, url:string, name:string, sort_key:string, "
    "level:int, style:string, flag:boolean, attrs:string, begin:long, end:long, last_desc:int"
)
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _arrow(fields: str) -> pa.StructType:
    return pa.struct([(n, _KINDS[t]) for n, t in (f.strip().split(":") for f in fields.split(","))])


def _udf(kind: str, arrow: pa.DataType, f):
    """An Arrow function of one text column; null gives null."""

    @arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], arrow)

    return run


def _lists(fields: str, f):
    """An Arrow function of one text column that gives a list of tuples of the fields; null gives null. The columns are
    built whole, without a dict a row."""
    kinds = [(n, _KINDS[t]) for n, t in (x.strip().split(":") for x in fields.split(","))]

    @arrow_udf(f"array<struct<{fields}>>")
    def run(texts: pa.Array) -> pa.Array:
        rows, ends, void, made, n = [], [0], [], [], 0

        def build() -> None:
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            made.append(pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds]))
            rows.clear()

        for t in texts.to_pylist():
            void.append(t is None)
            if t is not None:
                found = f(t)
                rows += found
                n += len(found)
                if len(rows) > 20_000:
                    build()
            ends.append(n)
        build()
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(made), mask=pa.array(void, pa.bool_()))

    return run


def tasks_for(df: DataFrame) -> int:
    """Tasks for work that costs far more than its bytes: one a core and, up to a hundred times that, one for each half
    MB of df's files."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(cores, size >> 19), 100 * cores) if size < 1 << 50 else cores  # Spark can't tell it


def spread(df: DataFrame) -> DataFrame:
    """df over tasks_for(df), if its files come in fewer; what is spread already stays as it is."""
    spark = df.sparkSession
    if df.isStreaming:
        return df
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    top = plan = df._jdf.queryExecution().optimizedPlan()
    while top.nodeName() in ("Project", "Filter"):
        top = top.children().head()
    if top.nodeName().startswith("Repartition"):
        return df
    tasks = tasks_for(df)
    return df.repartition(tasks) if int(plan.stats().sizeInBytes()) < tasks * split else df


_TOKEN = "type:string, text:string, begin:long, level:int, tag_name:string, self_closing:boolean"
_PAIR = pa.struct([("name", pa.string()), ("value", pa.string())])


def parse_nodes(text, **options) -> Column:
    """The node table of a text as an array, in document order."""
    return _lists(NODE, lambda t: parse(t, **options))(_c(text))


def parse_inline(text, **options) -> Column:
    """The node table of a fragment: no tables and lists."""
    return parse_nodes(text, tables=False, lists=False, **options)


def tokenize(text, **options) -> Column:
    return _lists(_TOKEN, lambda t: list(lexer.tokens(t, **options)))(_c(text))


_FORMATTING, _LIST, _TABLE = ("Bold", "Italic", "BoldItalic"), ("BulletList", "NumberedList", "DefinitionTerm", "Indent"), ("TableStart", "TableEnd", "TableRowStart", "TableCaption", "TableHeaderCell", "TableDataCell")


def is_formatting(token: Column) -> Column:
    return token["type"].isin(*_FORMATTING)


def is_list_marker(token: Column) -> Column:
    return token["type"].isin(*_LIST)


def is_table_mark(token: Column) -> Column:
    return token["type"].isin(*_TABLE)


def position(text, offset) -> Column:
    """struct(line, column, offset), both from 1, of an offset in code points."""
    before = F.substring(_c(text), F.lit(1), _c(offset).cast("int"))
    line = F.regexp_count(before, F.lit("\n")) + 1
    return F.struct(line.cast("int").alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).cast("int").alias("column"), _c(offset).cast("long").alias("offset"))


def token_plain_text(text) -> Column:
    return _udf("string", pa.string(), lexer.plain_text)(_c(text))


def looks_like_wikitext(text) -> Column:
    out = F.lit(False)
    for m in lexer.MARKERS:
        out = out | F.contains(_c(text), F.lit(m))
    return out


def strip_comments(text) -> Column:
    return F.regexp_replace(_c(text), r"(?s)(<nowiki>.*?(?:</nowiki>|\z)|<nowiki\s*/>)|<!--.*?(?:-->|\z)", "$1")


def strip_comments_and_nowiki(text) -> Column:
    return _udf("string", pa.string(), lexer.strip_comments_and_nowiki)(_c(text))


def redirect_target(text) -> Column:
    """Of a text that begins with #REDIRECT, else null."""
    t = _c(text)
    pattern = r"(?is)\A[ \t\n\r]*#REDIRECT.*?\[\[(.*?)\]\]"
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1))


def heading(line) -> Column:
    """struct(found, level, title) of a line."""

    def one(t: str) -> dict:
        h = lexer.heading_line(t.split("\n", 1)[0])
        return {"found": h is not None, "level": h[0] if h else 0, "title": h[1] if h else ""}

    return _udf("struct<found:boolean, level:int, title:string>", _arrow("found:boolean, level:int, title:string"), one)(_c(line))


def plain_text(text, **config) -> Column:
    c = render.PlainTextConfig(**config)
    return _udf("string", pa.string(), lambda t: render.to_plain_text(t, c))(_c(text))


def first_paragraph(text) -> Column:
    return _udf("string", pa.string(), render.first_paragraph)(_c(text))


def summary(text, most: int = 500) -> Column:
    return _udf("string", pa.string(), lambda t: render.summary(t, most))(_c(text))


def to_wikitext(text) -> Column:
    return _udf("string", pa.string(), lambda t: render.to_wikitext(Parser().parse(t)))(_c(text))


def to_json(text, **options) -> Column:
    return _udf("string", pa.string(), lambda t: render.to_json(t, **options))(_c(text))


def rewrite(text, visit) -> Column:
    """The markup after visit has gone over its tree: a function of a node that gives the nodes to stand in its place:
    the node itself, none, or others, such as its children, which are visited in turn. Parents come first; children
    of nodes that stay are visited too."""

    def one(t: str) -> str:
        root = Parser().parse(t)
        todo = [root]
        while todo:
            n = todo.pop()
            kept, rest = [], list(reversed(n.children))
            while rest:
                k = rest.pop()
                new = visit(k)
                if len(new) == 1 and new[0] is k:
                    kept.append(k)
                else:
                    rest += reversed(new)
            n.children = kept
            todo += kept
        return render.to_wikitext(root)

    return _udf("string", pa.string(), one)(_c(text))


def remove_templates(text) -> Column:
    return rewrite(text, lambda n: [] if n.type == "Template" else [n])


def strip_formatting(text) -> Column:
    """Quotes of bold and italic go, what they hold stays."""
    return rewrite(text, lambda n: n.children if n.type == "Formatting" else [n])


# relations over the node table
def node_table(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys and a row for each node."""
    return spread(df.select(*keys, F.col(text).alias("__text"))).select(*keys, F.explode(parse_nodes("__text")).alias("n")).select(*keys, "n.*")


def node_counts(text, *kinds: str) -> Column:
    """A struct of how many nodes of each of kinds a text has."""

    @arrow_udf(f"struct<{', '.join(k + ':int' for k in kinds)}>")
    def run(texts: pa.Array) -> pa.Array:
        counts = [[0] * len(texts) for _ in kinds]
        place = {k: c for k, c in zip(kinds, counts, strict=True)}
        for i, t in enumerate(texts.to_pylist()):
            todo = [] if t is None else [Parser().parse(t)]
            while todo:
                n = todo.pop()
                if n.type in place:
                    place[n.type][i] += 1
                todo += n.children
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in counts], names=list(kinds))

    return run(_c(text))


def node_histogram(df: DataFrame, text: str) -> DataFrame:
    """(type, n): how many nodes of each type all texts have, counted where they are parsed."""

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                todo = [] if t is None else [Parser().parse(t)]
                while todo:
                    n = todo.pop()
                    counts[n.type] += 1
                    todo += n.children
        rows = sorted((k, n) for k, n in counts.items() if k not in ("Bar", "Equal"))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["type", "n"])

    return spread(df.select(text)).mapInArrow(run, "type string, n long").groupBy("type").agg(F.sum("n").alias("n"))


def label(nodes: DataFrame, of: DataFrame, *keys: str) -> DataFrame:
    """of with the column label: the text within each node, found by its range of ids. Both come together by keys in
    a shuffle, as what a parse gives is far more than Spark takes it for; ``labels`` does the same in the parse."""
    t = nodes.where(F.col("type").isin("Text", "NoWiki")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("__t"))
    t = t.select(*(F.col(k).alias("__" + k) for k in keys), "__t")
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col("__" + k))
    own = F.filter("__t", lambda x: x["id"].between(F.col("id"), F.col("last_desc")))
    text = F.array_join(F.transform(own, lambda x: x["text"]), "")
    return of.join(t.hint("merge"), on, "left").select(*of.columns, F.coalesce(text, F.lit("")).alias("label"))


class Seen:
    """A node in its tree: its number in document order, its parent, whether it is within a template, and by pieces of
    text the part that is within it."""

    __slots__ = ("node", "id", "parent", "in_template", "first", "last", "pieces")

    def __init__(self, node: Node, number: int, parent: Seen | None, first: int, pieces: list[str]):
        self.node, self.id, self.parent, self.first, self.last, self.pieces = node, number, parent, first, first, pieces
        self.in_template = parent is not None and (parent.in_template or parent.node.type == "Template")

    @property
    def label(self) -> str:
        return "".join(self.pieces[self.first : self.last])


def walk(text: str) -> list[Seen]:
    """All nodes of a text in document order."""
    pieces: list[str] = []
    out: list[Seen] = []
    todo: list[tuple] = [(Parser().parse(text), None)]
    while todo:
        n, parent = todo.pop()
        if n is None:
            parent.last = len(pieces)
            continue
        if n.type in ("Text", "NoWiki"):
            pieces.append(n.text or "")
        x = Seen(n, len(out), parent, len(pieces), pieces)
        out.append(x)
        if n.children:
            todo.append((None, x))
            todo += [(k, x) for k in reversed(n.children) if k.type not in ("Bar", "Equal")]
    return out


def extract(df: DataFrame, text: str, keys: list[str], fields: str, rows) -> DataFrame:
    """keys and fields ("name:type, ..."): rows is a function of a text that gives tuples of the fields."""
    few = spread(df.select(*keys, F.col(text).alias("__text")))
    return few.select(*keys, F.explode(_lists(fields, rows)("__text")).alias("__n")).select(*keys, "__n.*")


def _each(kind: str, f):
    return lambda text: [f(x) for x in walk(text) if x.node.type == kind]


def links(df: DataFrame, text: str, *keys: str, include_template_args: bool = False) -> DataFrame:
    """(keys, target, anchor, display, begin): links to pages; without a label the target is displayed. Those in
    template arguments don't count unless asked for."""

    def rows(t: str) -> list[tuple]:
        found = (x for x in walk(t) if x.node.type == "Link" and (include_template_args or not x.in_template))
        return [(x.node.target, x.node.anchor, x.label if x.node.flag else x.node.target + ("#" + x.node.anchor if x.node.anchor else ""), x.node.begin) for x in found]

    return extract(df, text, list(keys), "target:string, anchor:string, display:string, begin:long", rows)


def external_links(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, url, display)."""
    return extract(df, text, list(keys), "url:string, display:string", _each("ExternalLink", lambda x: (x.node.url, x.label if x.node.children else x.node.url)))


def categories(df: DataFrame, text: str, *keys: str) -> DataFrame:
    return extract(df, text, list(keys), "category:string, sort_key:string", _each("Category", lambda x: (x.node.name, x.node.sort_key)))


def templates_used(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, name, is_function, n_params), also of templates in arguments of others."""
    count = lambda n: sum(k.type == "TemplateParameter" for k in n.children)
    return extract(df, text, list(keys), "name:string, is_function:boolean, n_params:int", _each("Template", lambda x: (x.node.name, x.node.flag, count(x.node))))


def template_params(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, template, param, value): values as plain text, param '' where it has no name."""
    return extract(df, text, list(keys), "template:string, param:string, value:string", _each("TemplateParameter", lambda x: (x.parent.node.name, x.node.name, x.label.strip(_BLANKS))))


_BLANKS = " \t\n\r\x0b\x0c"


def headings(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, pos, level, title): title as it is written, without blanks around it."""
    return extract(df, text, list(keys), "pos:int, level:int, title:string", _each("Heading", lambda x: (x.id, x.node.level, x.node.text.strip(_BLANKS))))


def sections(text: str) -> list[tuple]:
    """(section_no, parent_no, level, title, content_count, total_sections, total_content_count) of a text's sections:
    the parent is the last earlier heading of a lower level, 0 the text's root. Contents are what lies between
    headings at the top of the tree; totals are of a section and all below it."""
    out, last, total = [], [0] * 7, []
    for n in Parser().parse(text).children:
        if n.type == "Heading":
            parent = max(last[: n.level])
            out.append([len(out) + 1, parent, n.level, n.text.strip(_BLANKS), 0])
            last[n.level] = len(out)
        elif out:
            out[-1][4] += 1
    total = [[1, r[4]] for r in out]
    for r in reversed(out):
        if r[1]:
            for k in (0, 1):
                total[r[1] - 1][k] += total[r[0] - 1][k]
    return [(*r, *t) for r, t in zip(out, total, strict=True)]


def section_rows(text: str) -> list[tuple]:
    """(section_no, parent_no, level, title) of a text's sections, as in ``sections``."""
    plain = outermost(text, "Heading")
    if plain is None:
        return [r[:4] for r in sections(text)]
    out, last = [], [0] * 7
    for level, title in plain:
        out.append((len(out) + 1, max(last[:level]), level, title.strip(_BLANKS)))
        last[level] = len(out)
    return out


def section_tree(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, section_no, parent_no, level, title): section numbers are in order from 1."""
    return extract(df, text, list(keys), "section_no:int, parent_no:int, level:int, title:string", section_rows)


def section_contents(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, section_no, title, content_count, total_sections, total_content_count)."""
    return extract(df, text, list(keys), "section_no:int, title:string, content_count:int, total_sections:int, total_content_count:int", lambda t: [(r[0], *r[3:]) for r in sections(t)])


def section_totals(tree: DataFrame, *keys: str) -> DataFrame:
    """(keys, section_no, title, total_sections): a section and all below it. Those are the following ones up to
    the next of a level that isn't higher."""
    rows = tree.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("section_no", "level", "title"))).alias("all"))
    one = rows.select(*keys, "all", F.explode("all").alias("s"))
    stop = F.array_min(F.transform(F.filter("all", lambda x: (x["section_no"] > F.col("s.section_no")) & (x["level"] <= F.col("s.level"))), lambda x: x["section_no"]))
    return one.select(*keys, F.col("s.section_no"), F.col("s.title"), (F.coalesce(stop, F.size("all") + 1) - F.col("s.section_no")).cast("int").alias("total_sections"))


def find_section(tree: DataFrame, title: str, *keys: str) -> DataFrame:
    """The first section of that title in each text."""
    return tree.where(F.col("title") == title).groupBy(*keys).agg(F.min_by(F.struct("section_no", "parent_no", "level", "title"), "section_no").alias("s")).select(*keys, "s.*")


def draw(sections: list[tuple]) -> str:
    """Sections (section_no, parent_no, title), in order, as a tree drawn with lines."""
    kids: dict[int, list[tuple]] = {}
    for r in sections:
        kids.setdefault(r[1], []).append(r)
    lines, todo = [], [(r, "", i == len(kids.get(0, [])) - 1) for i, r in enumerate(kids.get(0, []))][::-1]
    while todo:
        (number, _, title), lead, last = todo.pop()
        lines.append(lead + ("└── " if last else "├── ") + title)
        own = kids.get(number, [])
        todo += [(k, lead + ("    " if last else "│   "), i == len(own) - 1) for i, k in enumerate(own)][::-1]
    return "\n".join(lines)


def section_outline(tree: DataFrame, *keys: str) -> DataFrame:
    """(keys, outline): the tree drawn with lines."""

    @arrow_udf("string")
    def drawn(sections: pa.Array) -> pa.Array:
        return pa.array([draw([(r["section_no"], r["parent_no"], r["title"]) for r in rows or []]) for rows in sections.to_pylist()], pa.string())

    return tree.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("section_no", "parent_no", "title"))).alias("s")).select(*keys, drawn("s").alias("outline"))


def section_outlines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, outline) of texts that have sections: the same as section_outline of their section_tree, but drawn where
    the text is parsed; texts with the same keys are rows of their own."""

    def rows(t: str) -> list[tuple]:
        found = [(r[0], r[1], r[3]) for r in section_rows(t)]
        return [(draw(found),)] if found else []

    return extract(df, text, list(keys), "outline:string", rows)


def list_items(df: DataFrame, text: str, *keys: str) -> DataFrame:
    return extract(df, text, list(keys), "marker:string, level:int, item:string", _each("ListItem", lambda x: (x.node.name, x.node.level, x.label.strip(_BLANKS))))


def table_cells(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, row_id, is_header, attributes, cell)."""
    return extract(df, text, list(keys), "row_id:int, is_header:boolean, attributes:string, cell:string", _each("TableCell", lambda x: (x.parent.id, x.node.flag, x.node.attrs, x.label.strip(_BLANKS))))


def formatted(df: DataFrame, text: str, *keys: str) -> DataFrame:
    return extract(df, text, list(keys), "style:string, content:string", _each("Formatting", lambda x: (x.node.style, x.label)))


def labels(df: DataFrame, text: str, kind: str, *keys: str) -> DataFrame:
    """(keys, id, label): the text within each node of a type."""
    return extract(df, text, list(keys), "id:int, label:string", _each(kind, lambda x: (x.id, x.label)))


def html_tags(df: DataFrame, text: str, *keys: str) -> DataFrame:
    return extract(df, text, list(keys), "tag:string, attributes:string, content:string", _each("HtmlTag", lambda x: (x.node.name, x.node.attrs, x.label)))


def tag_attributes(attributes) -> Column:
    """map of name (lower case) to value of a tag's attributes as they are written: in quotes, bare, or without a value
    (''); of a name that repeats the first."""
    found = F.regexp_extract_all(_c(attributes), F.lit(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"), F.lit(0))
    pair = F.transform(found, lambda a: F.struct(F.lower(F.trim(F.regexp_extract(a, r"^([^=\s]+)", 1))).alias("key"), F.regexp_replace(F.regexp_extract(a, r"(?s)^[^=]*=\s*(.*)$", 1), r"^[\"']|[\"']$", "").alias("value")))
    names = F.array_distinct(F.transform(pair, lambda p: p["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.get(F.filter(pair, lambda p: p["key"] == n), F.lit(0))["value"].alias("value"))))


def get_attribute(attributes, name: str) -> Column:
    return F.element_at(tag_attributes(attributes), name.lower())


def leaves(df: DataFrame, text: str, kind: str, *keys: str) -> DataFrame:
    """(keys, text) of comments, nowiki or magic words."""
    return extract(df, text, list(keys), "text:string", lambda t: leaf_texts(t, kind))


def leaf_texts(text: str, kind: str) -> list[tuple]:
    plain = outermost(text, kind)
    return [x[1:] for x in plain] if plain is not None else [(x.node.text,) for x in walk(text) if x.node.type == kind]


def parameters(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, name, has_default, default_text) of {{{name|default}}} in a text, the default as plain text."""
    return extract(df, text, list(keys), "name:string, has_default:boolean, default_text:string", _each("Parameter", lambda x: (x.node.name, x.node.flag, x.label)))


# templates
_INVOCATION = "name:string, params:array<struct<name:string, value:string>>, begin:long, end:long"
_INVOCATION_ARROW = pa.struct([("name", pa.string()), ("params", pa.list_(_PAIR)), ("begin", pa.int64()), ("end", pa.int64())])


def find_invocations(text) -> Column:
    return _udf(f"array<struct<{_INVOCATION}>>", pa.list_(_INVOCATION_ARROW), templates.find_invocations)(_c(text))


def fragment_params(text) -> Column:
    """array of (name, value) of what stands behind an invocation's first bar."""
    return _lists("name:string, value:string", templates.parse_params)(_c(text))


def invocation_get(invocation: Column, key: str | int) -> Column:
    """A parameter's value: by name, or by number (the n-th without a name or so named, whichever is first)."""
    params = invocation["params"]
    if isinstance(key, str):
        return F.get(F.filter(params, lambda p: p["name"] == key), F.lit(0))["value"]
    ranked = F.aggregate(
        params,
        F.struct(F.lit(0).alias("seen"), F.lit(None).cast("string").alias("value")),
        lambda a, p: F.struct(
            (a["seen"] + (p["name"] == "").cast("int")).alias("seen"),
            F.coalesce(a["value"], F.when(((p["name"] == "") & (a["seen"] + 1 == key)) | (p["name"] == str(key)), p["value"])).alias("value"),
        ),
        lambda a: a["value"],
    )
    return ranked


def find_parameters(text) -> Column:
    return _udf("array<string>", pa.list_(pa.string()), templates.find_parameters)(_c(text))


_DEFINITION = "name:string, redirect:string, description:string, params:array<string>, content:string"


def template_definition(name, text) -> Column:
    @arrow_udf(f"struct<{_DEFINITION}>")
    def run(names: pa.Array, texts: pa.Array) -> pa.Array:
        kind = pa.struct([("name", pa.string()), ("redirect", pa.string()), ("description", pa.string()), ("params", pa.list_(pa.string())), ("content", pa.string())])
        return pa.array([None if t is None else templates.parse_definition(n, t) for n, t in zip(names.to_pylist(), texts.to_pylist(), strict=True)], kind)

    return run(_c(name), _c(text))


def template_data(text) -> Column:
    """array of (name, default_value, description, required, aliases), sorted by name."""
    kind = "name:string, default_value:string, description:string, required:boolean, aliases:array<string>"
    arrow = pa.struct([("name", pa.string()), ("default_value", pa.string()), ("description", pa.string()), ("required", pa.bool_()), ("aliases", pa.list_(pa.string()))])
    return _udf(f"array<struct<{kind}>>", pa.list_(arrow), templates.template_data)(_c(text))


def is_parser_function(name) -> Column:
    t = F.lower(trim(name))
    return F.regexp_replace(t, r"\A#|:\z", "").isin(*sorted(templates.PARSER_FUNCTIONS))


def parser_function(name) -> Column:
    t = F.regexp_replace(F.lower(trim(name)), r"\A#|:\z", "")
    return F.when(t.isin(*templates.EVALUATED), F.concat(F.lit("#"), t)).otherwise(F.lit("Unknown"))


_STATS = "expanded:int, functions:int, max_depth:int, cache_hits:int, errors:int"


def expand(df: DataFrame, definitions: DataFrame, text: str, *, title: str | None = None, namespace: str | None = None, now=None, name: str = "name", content: str = "content", out: str = "expanded", stats: str | None = None, most_bytes: int = 64 << 20, **options) -> DataFrame:
    """df with the column out, its text expanded with definitions (name, content; of a name that repeats the last by
    content), and with stats, a struct of counters, if a name is given for it. title and namespace: columns.

    Definitions of up to most_bytes are broadcast. Of more, each text gets those that it asks for, by joins: the
    names that it asked for in vain are looked up and it is expanded again, until it asks for none that exists.
    """
    own = definitions.where(F.col(content).isNotNull() & F.col(name).isNotNull()).groupBy(F.col(name).alias("n")).agg(F.max(content).alias("c"))
    size = own.agg(F.sum(F.octet_length("c") + F.octet_length("n") + 100)).first()[0] or 0
    known = df.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in own.collect()}) if size <= most_bytes else None
    kind = f"struct<text:string, stats:struct<{_STATS}>, asked:array<string>>"
    arrow = pa.struct([("text", pa.string()), ("stats", _arrow(_STATS)), ("asked", pa.list_(pa.string()))])

    def one(t: str | None, n: str | None, ns: str | None, given: dict) -> dict | None:
        if t is None:
            return None
        e = templates.Expander(given, title=n or "", namespace=ns or "", now=now, **options)
        return {"text": e.expand(t), "stats": e.stats, "asked": sorted(given.missed) if isinstance(given, Asked) else []}

    names = [F.col(title) if title else F.lit(""), F.col(namespace) if namespace else F.lit("")]
    if known is not None:

        @arrow_udf(kind)
        def run(texts: pa.Array, titles: pa.Array, spaces: pa.Array) -> pa.Array:
            return pa.array([one(*r, known.value) for r in zip(texts.to_pylist(), titles.to_pylist(), spaces.to_pylist(), strict=True)], arrow)

        done = spread(df).withColumn("__x", run(F.col(text), *names))
        return done.withColumns({out: F.col("__x.text"), **({stats: F.col("__x.stats")} if stats else {})}).drop("__x")

    @arrow_udf(kind)
    def again(texts: pa.Array, titles: pa.Array, spaces: pa.Array, given: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), titles.to_pylist(), spaces.to_pylist(), given.to_pylist(), strict=True)
        return pa.array([one(t, n, ns, Asked({d["n"]: d["c"] for d in g})) for t, n, ns, g in rows], arrow)

    own = cut(own)
    todo = cut(df.select("*", F.monotonically_increasing_id().alias("__id"), F.array().cast("array<struct<n:string,c:string>>").alias("__given")))
    finished = None
    while True:
        todo = cut(todo.withColumn("__x", again(F.col(text), *names, F.col("__given"))))
        asked = todo.select("__id", F.explode("__x.asked").alias("n")).join(own, "n").groupBy("__id").agg(F.collect_list(F.struct("n", "c")).alias("__more"))
        both = cut(todo.join(asked, "__id", "left"))
        ready = both.where("__more IS NULL").drop("__more")
        finished = ready if finished is None else finished.unionByName(ready)
        todo = both.where("__more IS NOT NULL").withColumn("__given", F.concat("__given", "__more")).drop("__more", "__x")
        if todo.isEmpty():
            break
    return finished.withColumns({out: F.col("__x.text"), **({stats: F.col("__x.stats")} if stats else {})}).drop("__x", "__id", "__given")


class Asked(dict):
    """Definitions, and in ``missed`` the names that were looked up in vain."""

    def __init__(self, known: dict[str, str]):
        super().__init__(known)
        self.missed: set[str] = set()

    def get(self, key, default=None):
        if key not in self:
            return default
        return self[key]

    def __contains__(self, key) -> bool:
        if super().__contains__(key):
            return True
        self.missed.add(key)
        return False


def page_provider(pages: DataFrame, *, namespace: int = 10, title: str = "title", content: str = "content") -> DataFrame:
    """(name, content) of a namespace's pages, without the namespace's name before the title: templates (10) or
    modules (828)."""
    return pages.where(F.col("ns") == namespace).select(F.regexp_replace(F.col(title), r"^[^:]*:", "").alias("name"), F.col(content).alias("content"))


def invocation_get_or(invocation: Column, key: str | int, default) -> Column:
    return F.coalesce(invocation_get(invocation, key), default if isinstance(default, Column) else F.lit(default))


def template_closure(uses: DataFrame, most: int = 40) -> DataFrame:
    """(template, uses): all templates that a template needs, directly or through others; uses: (template, uses)."""
    from .graph import closure

    return closure(uses, "template", "uses", most)


