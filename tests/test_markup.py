import random

import pytest

from textloom.operators import lexer, parser, render, templates
from textloom.operators.templates import Expander


def kinds(text, **options):
    return [(t.type, t.text) for t in lexer.tokens(text, **options) if t.type != "EndOfInput"]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("=header=", (1, "header")), ("==header==", (2, "header")), ("=" * 6 + "x" + "=" * 6, (6, "x")), ("===header=", (1, "==header")), ("=header===", (1, "header==")),
        ("===abc==", (2, "=abc")), ("==header==  ", (2, "header")), ("==header==  abc", None), (" ==header==", None), ("=header==header=", (1, "header==header")),
        ("", None), ("=", None), ("==", None), ("===", (1, "=")), ("====", (2, "")),
    ],
)
def test_heading_lines(line, expected):
    assert lexer.heading_line(line) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("[[Page|Text]]", ["LinkOpen", "Text", "LinkSeparator", "Text", "LinkClose"]), ("{{{param}}}", ["ParameterOpen", "Text", "ParameterClose"]), ("<br />", ["HtmlTagOpen"]),
        ("''i'' '''b'''", ["Italic", "Text", "Italic", "Text", "Bold", "Text", "Bold"]), ("[[Category:X]]", ["Category", "Text", "Text", "LinkClose"]), ("{{a|{{b}}}}", ["TemplateOpen", "Text", "Pipe", "TemplateOpen", "Text", "TemplateClose", "TemplateClose"]),
        ("{{#if:x}}", ["ParserFunction", "Text", "Text", "TemplateClose"]), ("----", ["HorizontalRule"]), ("** x", ["BulletList", "Text"]), ("__TOC__", ["MagicWord"]), ("<foo>", ["Text", "Text"]), ("[http://x y]", ["ExternalLinkOpen", "Text", "Text", "ExternalLinkClose"]),
        ("#REDIRECT [[A]]", ["Redirect", "Text", "LinkOpen", "Text", "LinkClose"]),
    ],
)
def test_tokens(text, expected):
    assert [k for k, _ in kinds(text)] == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("See [[Article|display text]] here", "See Articledisplay text here"), ("a = b", "a  b"), ("A <nowiki><!--co</nowiki>mm--> z", "A mm--> z"), ("a <!-- c --> b", "a  b"),
    ],
)
def test_token_plain_text(text, expected):
    assert lexer.plain_text(text) == expected


def test_strip_comments():
    assert lexer.strip_comments_and_nowiki("A <nowiki><!--co</nowiki>mm--> z") == "A <!--comm--> z"
    assert lexer.strip_comments("a<!--b-->c<nowiki><!--d--></nowiki><!--e") == "ac<nowiki><!--d--></nowiki>"
    assert lexer.heading_line(lexer.strip_comments_and_nowiki("== <!--q--> b==")) == (2, "  b")


def nodes(text, kind):
    return [dict(zip(parser.FIELDS, r, strict=True)) for r in parser.parse(text) if r[4] == kind]


def test_links_and_categories():
    (a, b) = nodes("[[A b#c|''d'' e]] [[F]] [[Category:G|h]]", "Link")
    assert (a["target"], a["anchor"], a["flag"]) == ("A b", "c", True) and (b["target"], b["flag"]) == ("F", False)
    (c,) = nodes("[[Category:G|h]]", "Category")
    assert (c["name"], c["sort_key"]) == ("G", "h")


@pytest.mark.parametrize("text", ["a ] b", "</b>", "|}", "a }} b", "[[open", "{{open", "'''open", "{| \n| x", "<b>open", "[[a {{b]] c", "[[a|b|c]]", "{{{", "}}}", "[[]]", "{{}}", "=", "<!--", "<nowiki>"])
def test_damaged_markup_is_text(text):
    rows = parser.parse(text)
    assert rows[0][4] == "Document" and all(r[0] <= r[17] < len(rows) for r in rows)
    assert render.to_plain_text(text) is not None


def test_parser_ends_on_random_markup():
    rng = random.Random(4)
    marks = [*"a=*#![]|\n", "b ", *"== '' ''' {{ }} [[ ]] {{{ }}} {| |- |} || <b> </b> --> <!-- ---- </nowiki> <nowiki>".split()]
    for _ in range(400):
        text = "".join(rng.choice(marks) for _ in range(60))
        rows = parser.parse(text)
        assert all(r[1] < r[0] <= r[17] < len(rows) for r in rows)
        render.to_json(text), render.first_paragraph(text), render.summary(text, 20), templates.find_invocations(text)
        Expander({"a": "{{b}}", "b ": "{{a}}"}).expand(text)


def test_deep_nesting_has_a_bound():
    p = parser.Parser(max_depth=20)
    p.parse("{{a|" * 500 + "}}" * 500)
    assert len(p.errors) == 1


def test_tables():
    cells = nodes("{|\n|+ cap\n|-\n! a !! b\n|-\n| style=x | c || d\n|}", "TableCell")
    assert [(c["flag"], c["attrs"]) for c in cells] == [(True, None), (True, None), (False, "style=x"), (False, None)]


def test_plain_text():
    assert render.to_plain_text("'''A''' [[b|c]] {{t}}<ref>n</ref> [http://u v]\n== H ==\n* x\n** y") == "A c v\nH\n• x\n  • y"
    assert render.to_plain_text("[[b|c]]", render.PlainTextConfig(show_link_targets=True)) == "[c](b)"
    assert render.first_paragraph("{{x}}\n'''A''' b.\n\nSecond") == "A b."
    assert render.summary("One two three. Four five six.", 16) == "One two three."
    assert render.word_wrap("aa bb cc", 5) == "aa bb\ncc"


@pytest.mark.parametrize("text", ["'''a''' ''b''", "[[a#b|c]] [[d]]", "{{a|b=c|{{d}}}}", "{{{p|q}}}", "<b>x</b><br/>", "[http://u v]", "== h ==\n", "* a\n** b\n", "<nowiki>[[</nowiki>", "----"])
def test_round_trip(text):
    assert render.to_wikitext(parser.Parser().parse(text)).strip() == text.strip()


def test_invocations():
    assert templates.parse_invocation("{{T|u|k=v|w}}") == ("T", [("", "u"), ("k", "v"), ("", "w")])
    assert templates.parse_invocation("{{a|b={{c|d=e}}|[[f|g]]|h=}}") == ("a", [("b", "{{c|d=e}}"), ("", "[[f|g]]"), ("h", "")])
    assert templates.parse_invocation("text") is None and templates.parse_invocation("{{}}") is None
    assert [i["name"] for i in templates.find_invocations("{{a|{{b}}}} {{{c}}} {{d}}")] == ["a", "d"]
    assert templates.get_param([("", "x"), ("2", "y"), ("", "z")], 2) == "y"
    assert templates.find_parameters("{{{a|{{{b}}}}}} {{{a}}} {{{ c }}}") == ["a", "b", "c"]


def test_definitions():
    d = templates.parse_definition("T", "<noinclude>About {{x}} <b>it</b></noinclude>{{{name|World}}}")
    assert d["description"] == "About  it" and d["params"] == ["name"] and d["redirect"] is None
    assert templates.parse_definition("T", "#ReDiReCt [[Target]]")["redirect"] == "Target"
    assert templates.template_data("no json") == [] and templates.template_data('{"params": {"b": {"default": 3}, "a": {}}}')[1]["default_value"] == "3"


@pytest.mark.parametrize("name, yes, canonical", [("#IfEq", True, "#ifeq"), ("#if:", True, "#if"), ("#unknown", False, "Unknown"), ("padleft", True, "Unknown"), (" switch: ", True, "#switch")])
def test_function_names(name, yes, canonical):
    assert templates.is_parser_function(name) == yes and templates.parser_function(name) == canonical


@pytest.mark.parametrize(
    "text, expected",
    [
        ("{{#if: x |yes|no}}", "yes"), ("{{#if:|yes|no}}", "no"), ("{{#ifeq: a |a|y|n}}", "y"), ("{{#switch:b|a=1|b|c=2|#default=3}}", "2"), ("{{#switch:z|a=1|#default=3}}", "3"), ("{{#switch:z|a=1|9}}", "9"),
        ("{{#expr:3.50}}", "3.5"), ("{{#expr:x}}", "0"), ("{{#ifexpr:0|y|n}}", "n"), ("{{#tag:b|x}}", "<b>x</b>"), ("{{none|a}}", "{{none|a}}"), ("{{t|b|x=c}}", "b c d"), ("{{t}}", "{{{1}}}  d"), ("{{loop}}", "{{loop}}"),
        ("{{SUBPAGENAME}}", "B"), ("{{#invoke:m|f}}", "{{#invoke:m|f}}"),
    ],
)
def test_expansion(text, expected):
    assert Expander({"t": "{{{1}}} {{{x|}}} {{{y|d}}}<noinclude>doc</noinclude>", "loop": "{{loop}}"}, title="A/B").expand(text) == expected


def test_outermost_agrees_with_the_parser():
    from textloom.operators import markup

    rng = random.Random(7)
    marks = [*"a=*#![]|\n\n", "b ", *"'' ''' {{ }} [[ ]] {{{ }}} {| |- |} || <b> </b> <i> --> <!-- ---- <nowiki> </nowiki> __TOC__".split(), "\n== h ==\n", "\n----\n", "\n{|\n", "\n|}\n", "\n|-\n", "[[a|b]]", "{{a|b=c}}", "<b>x</b>", "<!-- c -->", "\n=== <!-- z --> y ===\n"]
    plain = 0
    for _ in range(600):
        text = "".join(rng.choice(marks) for _ in range(rng.choice((4, 8, 15))))
        assert markup.section_rows(text) == [r[:4] for r in markup.sections(text)]
        for kind in ("HorizontalRule", "Comment", "NoWiki", "MagicWord"):
            plain += parser.outermost(text, kind) is not None
            assert markup.leaf_texts(text, kind) == [(x.node.text,) for x in markup.walk(text) if x.node.type == kind]
    assert plain > 300 and parser.outermost("{{a|b}}\n----\n", "HorizontalRule") == [(0, "----")] and parser.outermost("{{a|<!--b-->}}", "Comment") is None
