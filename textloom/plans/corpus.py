"""Wiki pages, index lines and templates made of the tables, so that what an operator must find is known from
their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.markup import spread

PRICE = "cast(cast(p_retailprice AS decimal(12,2)) AS string)"
#: The same expressions serve Spark SQL and DuckDB.
TITLE = "concat(p_name, ' ', cast(p_partkey AS string))"
NS = "CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 828 ELSE 1 END"
REDIRECT = "CASE WHEN p_partkey % 10 = 0 THEN p_type END"
_PARTS = [
    "'''", "{p_name}", "''' is a [[", "{p_brand}", "|", "{p_type}", "]] ''part''. {{Infobox part|size=", "{size}", "|price={{fmt|", "{price}", "}}|", "{p_name}", "}}\n\nSee [[Part ", "{size}",
    "]] and [http://example.org/", "{key}", " Site ", "{size}", "].\n== Details ==\n* [[", "{p_type}", "]]\n** size ", "{size}", "\n# one\n=== Price ===\n<!-- hidden ", "{key}",
    " --> <nowiki>[[not a link]]</nowiki> <b>bold ", "{size}", "</b> __NOTOC__\n==== Deep ====\n{| class=\"w\"\n|-\n! Size !! Price\n|-\n| ", "{size}", " || ", "{price}",
    "\n|}\n== Notes ==\n----\nEnd ", "{key}", ".\n[[Category:", "{p_type}", "|", "{p_name}", "]]",
]
_COLUMNS = {"{p_name}": "p_name", "{p_brand}": "p_brand", "{p_type}": "p_type", "{size}": "cast(p_size AS string)", "{key}": "cast(p_partkey AS string)", "{price}": PRICE}


def _content() -> str:
    return "concat(" + ", ".join(_COLUMNS.get(p) or "'" + p.replace("'", "''") + "'" for p in _PARTS) + ")"


CONTENT = _content()


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def parts_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all cores, for what is parsed in Python."""
    return spread(part(spark, sf_dir))


def _content_column():
    named = {k: F.expr(v) for k, v in _COLUMNS.items()}
    return F.concat(*(named[p] if p in named else F.lit(p) for p in _PARTS))


def wiki_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, title, content), over all cores: what is done with the texts costs more than to send them."""
    return parts_apart(spark, sf_dir).select(F.col("p_partkey").alias("page_id"), F.expr(TITLE).alias("title"), _content_column().alias("content"))


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ns, title, redirect_target, revisions): two revisions, an older stub and the text."""
    p = part(spark, sf_dir)

    def revision(number: int, text):
        return F.struct(
            (F.col("p_partkey") * 10 + number).alias("id"), F.when(F.lit(number > 1), F.col("p_partkey") * 10 + number - 1).cast("long").alias("parent_id"), F.lit("2026-01-01T00:00:00Z").alias("timestamp"),
            F.lit("u").alias("contributor"), F.lit(None).cast("string").alias("comment"), text.alias("content"), F.when(F.col("p_partkey") % 7 > 0, F.lit("wikitext")).alias("model"),
            F.lit("text/x-wiki").alias("format"), F.lit(None).cast("string").alias("sha1"),
        )

    return p.select(
        F.col("p_partkey").alias("page_id"), F.expr(NS).cast("int").alias("ns"), F.expr(TITLE).alias("title"), F.expr(REDIRECT).alias("redirect_target"),
        F.array(revision(1, F.lit("stub")), revision(2, _content_column())).alias("revisions"),
    )


INDEX_LINE = "CASE WHEN o_orderkey % 13 = 0 THEN concat('bad line ', cast(o_orderkey AS string)) ELSE concat(cast((o_orderkey // 50) * 1000 + 600 AS string), ':', cast(o_orderkey AS string), ':Order:', o_orderpriority, ' ', cast(o_orderkey % 997 AS string)) END"


def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, value)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("seq"), F.expr(INDEX_LINE.replace("o_orderkey // 50", "o_orderkey div 50")).alias("value"))


TEMPLATES = {
    "Infobox part": "<noinclude>About {{x}} parts.</noinclude>[{{{size|?}}} at {{{price}}} of {{{1|none}}}/{{{colour|plain}}}]",
    "fmt": "${{{1}}}",
    "loop": "{{loop}}",
    "Old": "#REDIRECT [[Template:fmt]]",
}


def template_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "name string, content string")


#: Texts of other shapes, one a row, by p_partkey % 11: definition lists, a table within a table, parameters, a redirect,
#: mixed lists, tags with attributes, what isn't closed, sections that leave levels out, parser functions and nested
#: templates, nested quotes, and leaves of all kinds.
SHAPES = (
    "; {n}\n: {t}\n:: {s}\n",
    "{|\n|+ Cap {s}\n|-\n| a {n}\n|\n{|\n| inner {s}\n|}\n|}\nend",
    "{{{p|{n}}}} and {{{q}}}",
    "#REDIRECT [[{t}#{s}]]",
    "* {n}\n*# {s}\n*#; x\n# {t}\nend",
    "<span class=\"a\" id='{k}'>{n}</span><br/><ref name=r>{t}</ref>",
    "[[{n} and {{x {t} ''it",
    "lead\n== A {s} ==\n==== B ====\n=== C ===\ntext\n== D ==\n",
    "{{#if:{s}|{{a|{n}}}|n}} {{b|k={{c}}|{t}}}",
    "'''''{n}''''' ''{t} '''{s}''' end''",
    "text <nowiki>''{n}''</nowiki> <!-- {s} --> [http://x.org/{k}] [[File:{t}|{n}]] [[:Category:{t}]] __TOC__",
)


def shaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, content)."""
    text = F.lit(None).cast("string")
    for k, shape in enumerate(SHAPES):
        text = F.when(F.col("p_partkey") % len(SHAPES) == k, F.lit(shape)).otherwise(text)
    for mark, column in (("{n}", F.col("p_name")), ("{t}", F.col("p_type")), ("{s}", F.col("p_size").cast("string")), ("{k}", F.col("p_partkey").cast("string"))):
        text = F.replace(text, F.lit(mark), column)
    return parts_apart(spark, sf_dir).select(F.col("p_partkey").alias("page_id"), text.alias("content"))
