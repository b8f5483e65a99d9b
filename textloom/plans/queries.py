"""The registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import index as ix
from ..operators import markup as mk
from ..operators import pages as pg
from ..sources import catalog, dump, sinks
from ..sources.shared import shared_path
from ..streaming import parsed_pages, totals
from . import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLE_SQL[name] = sql


def _docs(name: str, column, sql: str) -> None:
    """A scalar function on documents.text; in the SQL t is the text."""
    add(name, lambda s, d, c=column: s.read.parquet(f"{d}/documents.parquet").select("doc_id", c("text").alias("v")), f"SELECT doc_id, {sql} AS v FROM (SELECT doc_id, text AS t FROM documents)")


def _pages(name: str, column, sql: str, of: str = "html") -> None:
    add(name, lambda s, d, c=column, o=of: s.read.parquet(f"{d}/pages.parquet").select("page_id", c(o).alias("v")), f"SELECT page_id, {sql} AS v FROM (SELECT page_id, {of} AS t FROM pages)")


_WS = r" \t\n\r\x0B\x0C"
_TRIM = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PAD = "concat(chr(9), ' ', t, ' ', chr(10))"
_pad = lambda f: lambda c: f(F.concat(F.lit("\t "), F.col(c), F.lit(" \n")))

# text
_docs("text_trim", _pad(fn.trim), f"trim({_PAD}, {_TRIM})")
_docs("text_trim_left", _pad(fn.trim_left), f"ltrim({_PAD}, {_TRIM})")
_docs("text_trim_right", _pad(fn.trim_right), f"rtrim({_PAD}, {_TRIM})")
_docs("text_collapse_ws", fn.collapse_whitespace, rf"regexp_replace(t, '[{_WS}]+', ' ', 'g')")
_docs("text_ascii_lower", fn.ascii_lower, f"translate(t, '{_UP}', '{_LOW}')")
_docs("text_ascii_upper", fn.ascii_upper, f"translate(t, '{_LOW}', '{_UP}')")
add("text_eq_ignore_case", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", fn.equals_ignore_case(fn.ascii_upper("text"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("é")))).alias("v")), "SELECT doc_id, doc_id % 2 = 0 AS v FROM documents")
_docs("text_starts_ends", lambda c: fn.starts_with(c, F.lit("The")) | fn.ends_with(c, F.lit("the.")) | fn.starts_with_ignore_case(c, F.lit("ON")), "starts_with(t, 'The') OR ends_with(t, 'the.') OR starts_with(lower(left(t, 2)), 'on')")
_docs("text_split", lambda c: fn.split(c, "."), "string_split(t, '.')")
_docs("text_split_str", lambda c: fn.split(c, ". "), "string_split(t, '. ')")
_docs("text_split_n", lambda c: fn.split_n(c, " ", 3), "CASE WHEN len(string_split(t, ' ')) <= 3 THEN string_split(t, ' ') ELSE list_append(string_split(t, ' ')[1:2], array_to_string(string_split(t, ' ')[3:], ' ')) END")
_docs("text_split_any", lambda c: fn.split_any(c, ".,\n "), r"list_filter(regexp_split_to_array(t, '[.,\n ]'), lambda x: x <> '')")
_docs("text_join", lambda c: fn.join(fn.split(c, " "), "-"), "replace(t, ' ', '-')")
_docs("text_replace_all", lambda c: fn.replace_all(c, "the", "THE"), "replace(t, 'the', 'THE')")
_docs("text_replace_first", lambda c: fn.replace_first(c, "the", "[THE]"), "CASE WHEN instr(t, 'the') > 0 THEN substr(t, 1, instr(t, 'the') - 1) || '[THE]' || substr(t, instr(t, 'the') + 3) ELSE t END")
_docs("text_count_occurrences", lambda c: fn.count_occurrences(c, "th"), "((length(t) - length(replace(t, 'th', ''))) // 2)::INTEGER")
_docs("text_find_all", lambda c: fn.find_all(c, "tion"), "list_transform(range(1, len(string_split(t, 'tion'))), lambda i: (length(array_to_string(string_split(t, 'tion')[1:i], 'tion')))::INTEGER)")
add("text_parse_int", lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", fn.parse_int(F.concat(F.lit(" "), F.split("o_orderpriority", "-")[0], F.lit("\t"))).alias("v"), fn.parse_int("o_orderpriority").alias("w"), fn.parse_int(F.lit("9223372036854775808")).alias("x")),
    "SELECT o_orderkey, string_split(o_orderpriority, '-')[1]::BIGINT AS v, NULL::BIGINT AS w, NULL::BIGINT AS x FROM orders")
_pages("html_encode", fn.encode_html_entities, "replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')")
_pages("html_decode_named", fn.decode_named_entities, "replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')")
_pages("html_decode_round_trip", lambda c: fn.decode_html_entities(fn.encode_html_entities(F.replace(c, F.lit("&"), F.lit("+")))), "replace(t, '&', '+')")
add("html_decode_numeric", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", fn.decode_html_entities(F.concat(F.lit("a&#"), (F.col("p_partkey") % 500 + 192).cast("string"), F.lit(";&amp;&#xZ;&lt;"))).alias("v")), "SELECT p_partkey, concat('a', chr((p_partkey % 500 + 192)::INTEGER), '&&#xZ;<') AS v FROM part")
_pages("html_strip_tags", fn.strip_tags, r"replace(regexp_replace(t, '<[^>]*(>|\z)', '', 'g'), '>', '')")
_docs("text_split_lines", fn.split_lines, "string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))")
_docs("text_count_lines", fn.count_lines, "CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END::INTEGER")
_docs("text_get_line", lambda c: fn.get_line(c, 1), "string_split(t, chr(10))[2]")
add("parse_error_format", lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", fn.format_error(F.lit("Error"), "o_orderpriority", F.col("o_custkey"), F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "P", F.lit("ctx"))).alias("v")),
    "SELECT o_orderkey, 'Error: ' || o_orderpriority || ' at line ' || o_custkey || ', column ' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN chr(10) || '  Context: ctx' ELSE '' END AS v FROM orders")
add("source_range", lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", fn.range_contains("l_suppkey", "l_partkey", "l_orderkey").alias("c"), fn.range_length("l_suppkey", "l_partkey").alias("n")),
    "SELECT l_orderkey, l_linenumber, l_suppkey <= l_orderkey AND l_orderkey < l_partkey AS c, l_partkey - l_suppkey AS n FROM lineitem")

# unicode
_docs("uni_codepoints", fn.count_codepoints, "length(t)::INTEGER")
_bytes = lambda: F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 2 == 0, F.lit("é".encode())).otherwise(F.lit(b"\xc0\x80")))
add("uni_valid_utf8", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", fn.is_valid_utf8(_bytes()).alias("v")), "SELECT doc_id, doc_id % 2 = 0 AS v FROM documents")
add("uni_decode_utf8", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", fn.decode_utf8(_bytes()).alias("v"), fn.encode_utf8("text").alias("b")), "SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN 'é' ELSE chr(65533) || chr(65533) END AS v, encode(text) AS b FROM documents")
_docs("uni_lower", fn.to_lower, "lower(t)")
_docs("uni_upper", fn.to_upper, "upper(replace(t, 'ß', 'ss'))")
_docs("uni_capitalize_first", fn.capitalize_first, "CASE WHEN left(t, 1) = 'ß' THEN t ELSE upper(left(t, 1)) || substr(t, 2) END")
_docs("uni_nfc", lambda c: fn.normalize(c, "NFC"), "nfc_normalize(t)")
_docs("uni_nfd_nfc", lambda c: fn.normalize(fn.normalize(c, "NFD"), "NFC"), "nfc_normalize(t)")
_docs("uni_nfkc", lambda c: fn.normalize(F.concat(F.lit("ﬁ² "), F.col(c)), "NFKC"), "'fi2 ' || nfc_normalize(t)")
_docs("uni_title_case", lambda c: fn.to_title_case(F.regexp_replace(F.col(c), "[^a-zA-Z ]", "")), "array_to_string(list_transform(string_split(regexp_replace(t, '[^a-zA-Z ]', '', 'g'), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')")
_docs("uni_char_class", lambda c: F.concat_ws(" ", *(fn.count_class(c, k).cast("string") for k in ("letter", "digit", "whitespace", "alphanumeric", "punctuation"))), r"concat_ws(' ', len(regexp_extract_all(t, '\p{L}')), len(regexp_extract_all(t, '\p{Nd}')), len(regexp_extract_all(t, '[\s\x0B]')), len(regexp_extract_all(t, '[\p{L}\p{Nd}]')), len(regexp_extract_all(t, '\p{P}')))")
_docs("uni_utf8_lengths", lambda c: F.aggregate(fn.utf8_length(c), F.lit(0), lambda a, x: a + x), "octet_length(encode(t))::INTEGER")
_docs("uni_iterate", lambda c: F.size(fn.codepoints(c)), "length(t)::INTEGER")


# titles
def _named(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit(" _"), F.lower("c_mktsegment"), F.lit("__"), F.col("c_name"), F.lit("_ *~é")).alias("t"))


_NAMED = "(SELECT c_custkey, concat(' _', lower(c_mktsegment), '__', c_name, '_ *~é') AS t FROM customer)"
for _n, _f, _s in (
    ("title_normalize", fn.normalize_title, r"upper(left(x, 1)) || substr(x, 2) AS v FROM (SELECT c_custkey, trim(string_split(regexp_replace(replace(t, '_', ' '), '\s+', ' ', 'g'), '#')[1]) AS x FROM " + _NAMED + ")"),
    ("title_for_comparison", lambda c: fn.normalize_for_comparison(F.concat(F.upper(F.substring(c, 3, 1)), F.col(c))), "lower(substr(t, 3, 1)) || replace(t, '_', '_') AS v FROM " + _NAMED),
    ("title_to_url", fn.title_to_url, "url_encode(replace(t, ' ', '_')) AS v FROM " + _NAMED),
    ("url_to_title", lambda c: fn.url_to_title(fn.title_to_url(c)), "replace(t, '_', ' ') AS v FROM " + _NAMED),
    ("title_safe_file_name", lambda c: fn.safe_file_name(c), "replace(t, '*', '_') AS v FROM " + _NAMED),
):
    add(_n, lambda s, d, f=_f: _named(s, d).select("c_custkey", f("t").alias("v")), f"SELECT c_custkey, {_s}")
_pages("url_decode_urls", fn.url_to_title, "replace(t, '_', ' ')", "url")
_pages("page_names", lambda c: F.concat_ws("|", fn.base_page_name(c), fn.sub_page_name(c), fn.root_page_name(c), fn.full_title(F.lit("Talk"), c)), r"concat_ws('|', regexp_replace(t, '/[^/]*$', ''), string_split(t, '/')[-1], string_split(t, '/')[1], 'Talk:' || t)", "url")

# pages
_P = f"(SELECT p_partkey AS page_id, {corpus.NS} AS ns, {corpus.TITLE} AS title, {corpus.REDIRECT} AS redirect_target, p_partkey FROM part)"
_KEYS = ["page_id", "ns", "title", "redirect_target"]
for _n, _b, _w in (
    ("page_filter_ns", pg.PageFilter(namespaces=(0, 10)), "ns IN (0, 10)"),
    ("page_filter_prefix", pg.PageFilter(title_prefix="red"), "starts_with(title, 'red')"),
    ("page_filter_contains", pg.PageFilter(title_contains="bolt"), "contains(title, 'bolt')"),
    ("page_filter_no_redirect", pg.PageFilter(include_redirects=False), "redirect_target IS NULL"),
    ("page_filter_all", pg.PageFilter(namespaces=(0,), include_redirects=False, title_contains="b"), "ns = 0 AND redirect_target IS NULL AND contains(title, 'b')"),
):
    add(_n, lambda s, d, b=_b: pg.filter_pages(corpus.wiki_pages(s, d), b).select(*_KEYS), f"SELECT page_id, ns::INTEGER AS ns, title, redirect_target FROM {_P} WHERE {_w}")
add("page_count", lambda s, d: pg.count_pages(corpus.wiki_pages(s, d), pg.PageFilter(namespaces=(0,))), f"SELECT count(*) AS n FROM {_P} WHERE ns = 0")
add("page_max", lambda s, d: pg.count_pages(corpus.wiki_pages(s, d), pg.PageFilter(max_pages=25)), f"SELECT count(*) AS n FROM (SELECT * FROM {_P} LIMIT 25)")
add("page_find", lambda s, d: pg.find_page(corpus.wiki_pages(s, d), "red widget 1").select(*_KEYS), f"SELECT page_id, ns::INTEGER AS ns, title, redirect_target FROM {_P} WHERE title = 'red widget 1'")
add("page_stats", lambda s, d: pg.page_stats(corpus.wiki_pages(s, d), pg.PageFilter(namespaces=(0,))), f"SELECT count(*) AS pages_read, count(*) FILTER (ns = 0) AS pages_processed, count(*) FILTER (ns <> 0) AS pages_skipped, count(redirect_target) AS redirects, sum(length(c))::BIGINT AS characters FROM (SELECT {corpus.NS} AS ns, {corpus.REDIRECT} AS redirect_target, {corpus.CONTENT} AS c FROM part)")
add("page_latest_revision", lambda s, d: corpus.wiki_pages(s, d).select("page_id", pg.latest_revision()["id"].alias("revision_id"), pg.content().alias("content")), f"SELECT p_partkey AS page_id, p_partkey * 10 + 2 AS revision_id, {corpus.CONTENT} AS content FROM part")
add("page_only_latest", lambda s, d: pg.filter_pages(corpus.wiki_pages(s, d), pg.PageFilter(only_latest_revision=True)).select("page_id", F.size("revisions").alias("n"), F.col("revisions")[0]["id"].alias("revision_id")), "SELECT p_partkey AS page_id, 1 AS n, p_partkey * 10 + 2 AS revision_id FROM part")
add("page_templates_only", lambda s, d: pg.template_pages(corpus.wiki_pages(s, d)).select("page_id", "title"), f"SELECT page_id, title FROM {_P} WHERE ns = 10")
add("page_kinds", lambda s, d: corpus.wiki_pages(s, d).select("page_id", pg.is_main().alias("main"), pg.is_template().alias("template"), pg.is_module().alias("module"), pg.is_redirect().alias("redirect")), f"SELECT page_id, ns = 0 AS main, ns = 10 AS template, ns = 828 AS module, redirect_target IS NOT NULL AS redirect FROM {_P}")
add("revision_is_wikitext", lambda s, d: corpus.wiki_pages(s, d).select("page_id", F.explode("revisions").alias("r")).select("page_id", F.col("r.id").alias("id"), F.col("r.model").alias("model")).withColumn("v", pg.is_wikitext()), "SELECT p_partkey AS page_id, p_partkey * 10 + r AS id, CASE WHEN p_partkey % 7 > 0 THEN 'wikitext' END AS model, true AS v FROM part, (VALUES (1), (2)) t(r)")

# index
_I = f"(SELECT seq, string_split(value, ':')[1]::BIGINT AS \"offset\", string_split(value, ':')[2]::BIGINT AS page_id, array_to_string(string_split(value, ':')[3:], ':') AS title FROM (SELECT o_orderkey AS seq, {corpus.INDEX_LINE} AS value FROM orders) WHERE contains(value, ':'))"
_idx = lambda s, d: ix.parse_index(corpus.index_lines(s, d))
_LAST = f"(SELECT * FROM {_I} QUALIFY row_number() OVER (PARTITION BY title ORDER BY seq DESC) = 1)"
add("index_parse", _idx, f"SELECT * FROM {_I}")
add("index_find_title", lambda s, d: ix.find_by_title(_idx(s, d), "Order:5-LOW 36"), f"SELECT * FROM {_LAST} WHERE title = 'Order:5-LOW 36'")
add("index_find_id", lambda s, d: ix.find_by_id(_idx(s, d), 77), f"SELECT * FROM {_I} WHERE page_id = 77")
add("index_find_offset", lambda s, d: ix.find_by_offset(_idx(s, d), 2600), f"SELECT * FROM {_I} WHERE \"offset\" = 2600")
add("index_prefix", lambda s, d: ix.find_by_prefix(_idx(s, d), "Order:1-"), f"SELECT * FROM {_I} WHERE starts_with(title, 'Order:1-')")
add("index_unique_offsets", lambda s, d: ix.unique_offsets(_idx(s, d)), f"SELECT DISTINCT \"offset\" FROM {_I}")
add("index_dedupe_last", lambda s, d: ix.last_by(_idx(s, d), "title"), f"SELECT * FROM {_LAST}")
add("index_count", lambda s, d: _idx(s, d).agg(F.count("*").alias("entries"), F.countDistinct("title").alias("pages"), F.countDistinct("offset").alias("chunks")), f"SELECT count(*) AS entries, count(DISTINCT title) AS pages, count(DISTINCT \"offset\") AS chunks FROM {_I}")
_CH = f"(SELECT any_value(o) AS start, list(struct_pack(page_id := page_id, title := title) ORDER BY seq) AS entries FROM (SELECT seq, page_id, title, \"offset\" AS o FROM {_I}) GROUP BY o)"
_CHUNKS = f"(SELECT start, coalesce(lead(start) OVER (ORDER BY start), 999999999) AS \"end\", entries FROM {_CH})"
add("index_chunks", lambda s, d: ix.chunks(_idx(s, d), 999999999).select("start", "end", F.size("entries").alias("n"), F.col("entries")[0]["title"].alias("first")), f"SELECT start, \"end\", len(entries)::INTEGER AS n, entries[1].title AS first FROM {_CHUNKS}")
add("index_chunk_of_title", lambda s, d: ix.chunk_of_title(ix.chunks(_idx(s, d), 999999999), "Order:5-LOW 36").select("start", "end"), f"SELECT start, \"end\" FROM {_CHUNKS} WHERE list_contains(list_transform(entries, lambda e: e.title), 'Order:5-LOW 36')")


def _terms(s: SparkSession, d: str) -> DataFrame:
    """All titles, all again, and as many that aren't there."""
    p = corpus.part(s, d)
    one = p.select(F.col("p_partkey").alias("ordinal"), F.expr(corpus.TITLE).alias("title"))
    return one.union(one.select(F.col("ordinal") + 1000000000, "title")).union(p.select(F.col("p_partkey") + 2000000000, F.expr("concat('No such ', cast(p_partkey AS string))")))


_TERMS = f"(SELECT p_partkey::BIGINT AS ordinal, {corpus.TITLE} AS title FROM part UNION ALL SELECT p_partkey::BIGINT + 1000000000, {corpus.TITLE} FROM part UNION ALL SELECT p_partkey::BIGINT + 2000000000, concat('No such ', cast(p_partkey AS string)) FROM part)"
_tidx = lambda s, d: corpus.wiki_texts(s, d).select(F.col("page_id").alias("seq"), F.lit(0).cast("long").alias("offset"), "page_id", "title")
add("terms_coverage", lambda s, d: ix.coverage(_terms(s, d), _tidx(s, d)), f"SELECT * FROM {_TERMS} WHERE NOT starts_with(title, 'No such')")
add("terms_missing", lambda s, d: ix.missing(_terms(s, d), _tidx(s, d)), f"SELECT * FROM {_TERMS} WHERE starts_with(title, 'No such')")
add("extract_pages", lambda s, d: ix.extract_pages(_terms(s, d), _tidx(s, d), corpus.wiki_texts(s, d)), f"SELECT ordinal, title, p_partkey IS NOT NULL AS found, p_partkey AS page_id, coalesce({corpus.CONTENT.replace('p_partkey', 'p.p_partkey')}, '') AS content FROM {_TERMS} t LEFT JOIN part p ON t.title = {corpus.TITLE}".replace("coalesce(concat", "coalesce(CASE WHEN p.p_partkey IS NOT NULL THEN concat").replace("]]'), '')", "]]') END, '')"))


# markup
_SIZE, _KEY, _PRICE = "cast(p_size AS string)", "cast(p_partkey AS string)", corpus.PRICE
_wiki = corpus.wiki_texts
_BR, _AN = "string_split(p_brand, '#')[1]", "string_split(p_brand, '#')[2]"


def _markup(name: str, f, sql: str) -> None:
    add(name, lambda s, d: f(_wiki(s, d), "content", "page_id"), sql)


_markup("links_internal", lambda df, t, k: mk.links(df, t, k).drop("begin"), f"SELECT p_partkey AS page_id, {_BR} AS target, {_AN} AS anchor, p_type AS display FROM part UNION ALL SELECT p_partkey, 'Part ' || p_size, '', 'Part ' || p_size FROM part UNION ALL SELECT p_partkey, p_type, '', p_type FROM part")
_markup("links_external", mk.external_links, "SELECT p_partkey AS page_id, 'http://example.org/' || p_partkey AS url, 'Site ' || p_size AS display FROM part")
_markup("categories", mk.categories, "SELECT p_partkey AS page_id, p_type AS category, p_name AS sort_key FROM part")
_markup("templates_used", mk.templates_used, "SELECT p_partkey AS page_id, 'Infobox part' AS name, false AS is_function, 3::INTEGER AS n_params FROM part UNION ALL SELECT p_partkey, 'fmt', false, 1 FROM part")
_markup("template_params", mk.template_params, f"SELECT p_partkey AS page_id, 'Infobox part' AS template, 'size' AS param, {_SIZE} AS value FROM part UNION ALL SELECT p_partkey, 'Infobox part', 'price', {_PRICE} FROM part UNION ALL SELECT p_partkey, 'Infobox part', '', p_name FROM part UNION ALL SELECT p_partkey, 'fmt', '', {_PRICE} FROM part")
_H = "(VALUES (1, 0, 2, 'Details', 3), (2, 1, 3, 'Price', 2), (3, 2, 4, 'Deep', 1), (4, 0, 2, 'Notes', 1)) h(section_no, parent_no, level, title, total_sections)"
_markup("headings", lambda df, t, k: mk.headings(df, t, k).drop("pos"), f"SELECT p_partkey AS page_id, level, title FROM part, {_H}")
_markup("section_tree", mk.section_tree, f"SELECT p_partkey AS page_id, section_no, parent_no, level, title FROM part, {_H}")
_markup("section_totals", lambda df, t, k: mk.section_totals(mk.section_tree(df, t, k), k), f"SELECT p_partkey AS page_id, section_no, title, total_sections FROM part, {_H}")
_markup("section_find", lambda df, t, k: mk.find_section(mk.section_tree(df, t, k), "Deep", k), "SELECT p_partkey AS page_id, 3 AS section_no, 2 AS parent_no, 4 AS level, 'Deep' AS title FROM part")
_markup("section_outline", mk.section_outlines, "SELECT p_partkey AS page_id, concat('├── Details', chr(10), '│   └── Price', chr(10), '│       └── Deep', chr(10), '└── Notes') AS outline FROM part")
_markup("lists", mk.list_items, "SELECT p_partkey AS page_id, '*' AS marker, 1 AS level, '' AS item FROM part UNION ALL SELECT p_partkey, '**', 2, 'size ' || p_size FROM part UNION ALL SELECT p_partkey, '#', 1, 'one' FROM part")
_rows = lambda: Window.partitionBy("page_id").orderBy("row_id")
_markup("tables", lambda df, t, k: mk.table_cells(df, t, k).select(k, F.dense_rank().over(_rows()).alias("row"), "is_header", "attributes", "cell"), f"SELECT p_partkey AS page_id, 1::INTEGER AS row, true AS is_header, NULL::VARCHAR AS attributes, 'Size' AS cell FROM part UNION ALL SELECT p_partkey, 1, true, NULL, 'Price' FROM part UNION ALL SELECT p_partkey, 2, false, NULL, {_SIZE} FROM part UNION ALL SELECT p_partkey, 2, false, NULL, {_PRICE} FROM part")
_markup("formatting", mk.formatted, "SELECT p_partkey AS page_id, 'bold' AS style, p_name AS content FROM part UNION ALL SELECT p_partkey, 'italic', 'part' FROM part")
_markup("html_tags", mk.html_tags, "SELECT p_partkey AS page_id, 'b' AS tag, '' AS attributes, 'bold ' || p_size AS content FROM part")
_markup("comments", lambda df, t, k: mk.leaves(df, t, "Comment", k), "SELECT p_partkey AS page_id, ' hidden ' || p_partkey || ' ' AS text FROM part")
_markup("nowiki", lambda df, t, k: mk.leaves(df, t, "NoWiki", k), "SELECT p_partkey AS page_id, '[[not a link]]' AS text FROM part")
_markup("magic_words", lambda df, t, k: mk.leaves(df, t, "MagicWord", k), "SELECT p_partkey AS page_id, 'NOTOC' AS text FROM part")
_markup("horizontal_rules", lambda df, t, k: mk.leaves(df, t, "HorizontalRule", k), "SELECT p_partkey AS page_id, '----' AS text FROM part")
_markup("node_labels", lambda df, t, k: mk.labels(df, t, "ListItem", k).select(k, fn.trim("label").alias("item")), "SELECT p_partkey AS page_id, '' AS item FROM part UNION ALL SELECT p_partkey, 'size ' || p_size FROM part UNION ALL SELECT p_partkey, 'one' FROM part")
add("node_histogram", lambda s, d: mk.node_histogram(_wiki(s, d), "content").where("type <> 'Text'"),
    "SELECT type, count(*) * k AS n FROM part, (VALUES ('Document', 1), ('Formatting', 2), ('Link', 3), ('Template', 2), ('TemplateParameter', 4), ('ExternalLink', 1), ('Heading', 4), ('List', 1), ('ListItem', 3), ('Comment', 1), ('NoWiki', 1), ('HtmlTag', 1), ('MagicWord', 1), ('Table', 1), ('TableRow', 2), ('TableCell', 4), ('HorizontalRule', 1), ('Category', 1)) t(type, k) GROUP BY type, k")
add("tokens_histogram", lambda s, d: _wiki(s, d).select(F.explode(mk.tokenize("content")).alias("t")).where("t.type IN ('LinkOpen', 'LinkClose', 'TemplateOpen', 'TemplateClose', 'Category', 'BulletList', 'NumberedList', 'TableStart', 'TableEnd', 'Bold', 'Italic', 'NoWiki', 'EndOfInput', 'ExternalLinkOpen')").groupBy(F.col("t.type").alias("type")).count().withColumnRenamed("count", "n"),
    "SELECT type, count(*) * k AS n FROM part, (VALUES ('LinkOpen', 3), ('LinkClose', 4), ('TemplateOpen', 2), ('TemplateClose', 2), ('Category', 1), ('BulletList', 2), ('NumberedList', 1), ('TableStart', 1), ('TableEnd', 1), ('Bold', 2), ('Italic', 2), ('NoWiki', 1), ('EndOfInput', 1), ('ExternalLinkOpen', 1)) t(type, k) GROUP BY type, k")
_short = lambda s, d: corpus.parts_apart(s, d).select("p_partkey", F.concat(F.lit("See [["), F.col("p_brand"), F.lit("|"), F.col("p_type"), F.lit("]] a = "), F.col("p_name"), F.lit(" <!-- c --><nowiki><!--k--></nowiki><b>x</b> <foo>")).alias("t"))
add("tokens_plain_text", lambda s, d: _short(s, d).select("p_partkey", mk.token_plain_text("t").alias("v")), "SELECT p_partkey, concat('See ', replace(p_brand, '#', '#'), p_type, ' a  ', p_name, ' x <foo>') AS v FROM part")
add("strip_comments", lambda s, d: _short(s, d).select("p_partkey", mk.strip_comments("t").alias("v")), "SELECT p_partkey, concat('See [[', p_brand, '|', p_type, ']] a = ', p_name, ' <nowiki><!--k--></nowiki><b>x</b> <foo>') AS v FROM part")
add("strip_comments_nowiki", lambda s, d: _short(s, d).select("p_partkey", mk.strip_comments_and_nowiki("t").alias("v")), "SELECT p_partkey, concat('See [[', p_brand, '|', p_type, ']] a = ', p_name, ' <!--k-->x <foo>') AS v FROM part")
_docs("looks_like_wikitext", mk.looks_like_wikitext, "contains(t, '[[') OR contains(t, ']]') OR contains(t, '{{') OR contains(t, '}}') OR contains(t, '''''') OR contains(t, '{|') OR contains(t, '|}') OR contains(t, '==') OR contains(t, '<ref') OR contains(t, '</ref>') OR contains(t, '#REDIRECT')")
add("heading_parse", lambda s, d: corpus.parts_apart(s, d).select("p_partkey", mk.heading(F.concat(F.repeat(F.lit("="), (F.col("p_partkey") % 7 + 1).cast("int")), F.col("p_name"), F.lit("=="))).alias("h")).select("p_partkey", "h.*"), "SELECT p_partkey, true AS found, least(k, 2)::INTEGER AS level, repeat('=', greatest(k - 2, 0)::INTEGER) || p_name || repeat('=', greatest(2 - k, 0)::INTEGER) AS title FROM (SELECT *, p_partkey % 7 + 1 AS k FROM part)")
add("redirects", lambda s, d: corpus.part(s, d).select("p_partkey", mk.redirect_target(F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit(" #Redirect [[")).otherwise(F.lit("x [[")), F.col("p_type"), F.lit("]] more"))).alias("v")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS v FROM part")
add("ast_to_wikitext", lambda s, d: corpus.parts_apart(s, d).select("p_partkey", mk.to_wikitext(F.concat(F.lit("'''"), F.col("p_name"), F.lit("''' [["), F.col("p_brand"), F.lit("|x]] {{a|b="), F.col("p_type"), F.lit("|{{c}}}} [http://u v]\n----\n"))).alias("v")), "SELECT p_partkey, concat('''''''', p_name, ''''''' [[', p_brand, '|x]] {{a|b=', p_type, '|{{c}}}} [http://u v]', chr(10), '----', chr(10)) AS v FROM part")
add("remove_templates", lambda s, d: corpus.parts_apart(s, d).select("p_partkey", mk.remove_templates(F.concat(F.lit("a {{x|{{y}}|z="), F.col("p_name"), F.lit("}} b "), F.col("p_type"))).alias("v")), "SELECT p_partkey, concat('a  b ', p_type) AS v FROM part")
add("strip_formatting", lambda s, d: corpus.parts_apart(s, d).select("p_partkey", mk.strip_formatting(F.concat(F.lit("''a '''"), F.col("p_name"), F.lit("''' b'' [[c|''d'']]"))).alias("v")), "SELECT p_partkey, concat('a ', p_name, ' b [[c|d]]') AS v FROM part")
_PLAIN = f"concat(p_name, ' is a ', p_type, ' part. ', chr(10), 'See Part ', p_size, ' and Site ', p_size, '.', chr(10), 'Details', chr(10), '• ', p_type, chr(10), '  • size ', p_size, chr(10), '• one', chr(10), 'Price', chr(10), ' [[not a link]] bold ', p_size, ' ', chr(10), 'Deep', chr(10), 'Size', chr(9), 'Price', chr(9), chr(10), p_size, chr(9), {_PRICE}, chr(9), chr(10), 'Notes', chr(10), '---', chr(10), 'End ', p_partkey, '.')"
add("plain_text", lambda s, d: _wiki(s, d).select("page_id", mk.plain_text("content").alias("v")), f"SELECT p_partkey AS page_id, {_PLAIN} AS v FROM part")
add("plain_text_targets", lambda s, d: corpus.parts_apart(s, d).select("p_partkey", mk.plain_text(F.concat(F.lit("[["), F.col("p_brand"), F.lit("|"), F.col("p_type"), F.lit("]] [http://u "), F.col("p_name"), F.lit("]")), show_link_targets=True).alias("v")), "SELECT p_partkey, concat('[', p_type, '](', p_brand, ') [', p_name, '](http://u)') AS v FROM part")
add("first_paragraph", lambda s, d: _wiki(s, d).select("page_id", mk.first_paragraph("content").alias("v")), "SELECT p_partkey AS page_id, concat(p_name, ' is a ', p_type, ' part.') AS v FROM part")
add("summary", lambda s, d: corpus.parts_apart(s, d).select("p_partkey", mk.summary(F.concat(F.col("p_name"), F.lit(" is here. "), F.repeat(F.lit("word "), 30)), 40).alias("v")), "SELECT p_partkey, CASE WHEN n - 2 > 20 THEN concat(p_name, ' is here.') ELSE concat(left(concat(p_name, ' is here. ', repeat('word ', 30)), n + 4 + 5 * ((36 - n) // 5)), '...') END AS v FROM (SELECT *, length(p_name) + 10 AS n FROM part)")
add("flagship_counts", lambda s, d: totals(parsed_pages(corpus.wiki_pages(s, d), pg.PageFilter(namespaces=(0,), include_redirects=False))), f"SELECT count(*) AS pages, (count(*) * 3)::BIGINT AS links, (count(*) * 2)::BIGINT AS templates FROM {_P} WHERE ns = 0 AND redirect_target IS NULL")

# texts of other shapes
def _shaped(name: str, f, rows: str, columns: str) -> None:
    """rows: what the shapes give, as (shape, columns of part, ...)."""
    add(name, lambda s, d: f(corpus.shaped_texts(s, d), "content", "page_id"), f"SELECT p_partkey AS page_id, {columns} FROM (SELECT *, p_partkey % {len(corpus.SHAPES)} AS k, p_name AS n, p_type AS t, p_size AS z FROM part), LATERAL (SELECT * FROM (VALUES {rows}) v(shape, {', '.join(c.split('::')[0].split(' AS ')[0] for c in columns.split(', '))})) WHERE k = shape")


_shaped("shape_lists", mk.list_items, "(0, ';', 1, n), (0, ':', 1, t), (0, '::', 2, z::VARCHAR), (4, '*', 1, n), (4, '*#', 2, z::VARCHAR), (4, '*#;', 3, 'x'), (4, '#', 1, t)", "marker, level, item")
_shaped("shape_cells", lambda df, t, k: mk.table_cells(df, t, k).select(k, "is_header", "cell"), "(1, false, 'a ' || n), (1, false, 'inner ' || z), (1, false, 'inner ' || z)", "is_header, cell")
_shaped("shape_parameters", mk.parameters, "(2, 'p', true, n), (2, 'q', false, '')", "name, has_default, default_text")
_shaped("shape_redirects", lambda df, t, k: df.select(k, mk.redirect_target(t).alias("target")).where("target IS NOT NULL"), "(3, t || '#' || z)", "target")
_shaped("shape_tags", lambda df, t, k: mk.html_tags(df, t, k).select(k, "tag", mk.get_attribute("attributes", "ID").alias("id"), mk.get_attribute("attributes", "name").alias("name"), "content"), "(5, 'span', p_partkey::VARCHAR, NULL, n), (5, 'br', NULL, NULL, ''), (5, 'ref', NULL, 'r', t)", "tag, id, name, content")
_shaped("shape_sections", mk.section_tree, "(7, 1, 0, 2, 'A ' || z), (7, 2, 1, 4, 'B'), (7, 3, 1, 3, 'C'), (7, 4, 0, 2, 'D')", "section_no, parent_no, level, title")
_shaped("shape_section_contents", mk.section_contents, "(7, 1, 'A ' || z, 0, 3, 1), (7, 2, 'B', 0, 1, 0), (7, 3, 'C', 1, 1, 1), (7, 4, 'D', 0, 1, 0)", "section_no, title, content_count, total_sections, total_content_count")
_shaped("shape_templates", mk.templates_used, "(8, '#if:' || z, true, 2), (8, 'a', false, 1), (8, 'b', false, 2), (8, 'c', false, 0)", "name, is_function, n_params")
_shaped("shape_formatting", mk.formatted, "(6, 'italic', 'it'), (9, 'bold_italic', n), (9, 'italic', t || ' ' || z || ' end'), (9, 'bold', z::VARCHAR)", "style, content")
_shaped("shape_links", lambda df, t, k: mk.links(df, t, k).drop("begin"), "(10, 'File:' || t, '', n), (10, ':Category:' || t, '', ':Category:' || t)", "target, anchor, display")
_shaped("shape_plain_text", lambda df, t, k: df.select(k, mk.plain_text(t).alias("v")),
    "(0, '• ' || n || chr(10) || '• ' || t || chr(10) || '  • ' || z), (1, 'a ' || n || chr(9) || chr(10) || 'inner ' || z || chr(9) || chr(10) || 'end'), (2, 'and'), (3, ''), (4, '• ' || n || chr(10) || '  • ' || z || chr(10) || '    • x' || chr(10) || '• ' || t || chr(10) || 'end'), (5, n), (6, '[[' || n || ' and {{x ' || t || ' it'), (7, 'lead' || chr(10) || 'A ' || z || chr(10) || 'B' || chr(10) || 'C' || chr(10) || 'text' || chr(10) || 'D'), (8, ''), (9, n || ' ' || t || ' ' || z || ' end'), (10, 'text ''''' || n || ''''' ' || n || ' :Category:' || t)", "v")
_shaped("shape_rewrite", lambda df, t, k: df.select(k, mk.rewrite(t, lambda n: n.children if n.type in ("HtmlTag", "Formatting") else [] if n.type in ("Template", "Comment", "Table", "List", "Heading", "Redirect", "Parameter") else [n]).alias("v")),
    "(0, ''), (1, chr(10) || 'end'), (2, ' and '), (3, ''), (4, 'end'), (5, n || t), (6, '[[' || n || ' and {{x ' || t || ' it'), (7, 'lead' || chr(10) || 'text' || chr(10)), (8, ' '), (9, n || ' ' || t || ' ' || z || ' end'), (10, 'text <nowiki>''''' || n || '''''</nowiki>  [http://x.org/' || p_partkey || '] [[File:' || t || '|' || n || ']] [[:Category:' || t || ']] __TOC__')", "v")
add("token_positions", lambda s, d: corpus.shaped_texts(s, d).select("page_id", "content", F.explode(mk.tokenize("content")).alias("t")).where("t.type = 'EndOfInput'").select("page_id", mk.position("content", "t.begin").alias("p")).select("page_id", "p.line", "p.column"),
    "SELECT p_partkey AS page_id, CASE p_partkey % 11 WHEN 0 THEN 4 WHEN 1 THEN 10 WHEN 4 THEN 5 WHEN 7 THEN 7 ELSE 1 END AS line, CASE p_partkey % 11 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 4 THEN 4 WHEN 7 THEN 1 WHEN 2 THEN 21 + length(p_name) WHEN 3 THEN 16 + length(p_type) + length(p_size::VARCHAR) WHEN 5 THEN 53 + length(p_partkey::VARCHAR) + length(p_name) + length(p_type) WHEN 6 THEN 17 + length(p_name) + length(p_type) WHEN 8 THEN 33 + length(p_size::VARCHAR) + length(p_name) + length(p_type) WHEN 9 THEN 27 + length(p_name) + length(p_type) + length(p_size::VARCHAR) ELSE 87 + 2 * length(p_name) + 2 * length(p_type) + length(p_size::VARCHAR) + length(p_partkey::VARCHAR) END::INTEGER AS \"column\" FROM part")
add("token_kinds", lambda s, d: corpus.shaped_texts(s, d).select(F.explode(mk.tokenize("content")).alias("t")).agg(F.count_if(mk.is_formatting(F.col("t"))).alias("formatting"), F.count_if(mk.is_list_marker(F.col("t"))).alias("lists"), F.count_if(mk.is_table_mark(F.col("t"))).alias("tables")),
    "SELECT sum(CASE p_partkey % 11 WHEN 6 THEN 1 WHEN 9 THEN 6 ELSE 0 END)::BIGINT AS formatting, sum(CASE p_partkey % 11 WHEN 0 THEN 3 WHEN 4 THEN 4 ELSE 0 END)::BIGINT AS lists, sum(CASE p_partkey % 11 WHEN 1 THEN 9 ELSE 0 END)::BIGINT AS tables FROM part")

_T = lambda t: {"type": "Text", "text": t}
_LI = lambda level, t: {"type": "ListItem", "level": level, "content": [_T(t)]}
_TREES = {
    2: [{"type": "Parameter", "name": "p", "content": [_T("{n}")]}, _T(" and "), {"type": "Parameter", "name": "q"}],
    3: [{"type": "Redirect", "target": "{t}#{s}"}],
    4: [{"type": "List", "style": "bullet", "content": [_LI(1, " {n}"), _LI(2, " {s}"), _LI(3, " x"), _LI(1, " {t}")]}, _T("end")],
    5: [{"type": "HtmlTag", "name": "span", "attrs": "class=\"a\" id='{k}'", "self_closing": False, "content": [_T("{n}")]}, {"type": "HtmlTag", "name": "br", "attrs": "", "self_closing": True}, {"type": "HtmlTag", "name": "ref", "attrs": "name=r", "self_closing": False, "content": [_T("{t}")]}],
    9: [{"type": "Formatting", "style": "bold_italic", "content": [_T("{n}")]}, _T(" "), {"type": "Formatting", "style": "italic", "content": [_T("{t} "), {"type": "Formatting", "style": "bold", "content": [_T("{s}")]}, _T(" end")]}],
}
_TREE_SQL = "CASE p_partkey % 11 " + " ".join(f"WHEN {k} THEN '" + json.dumps({"type": "Document", "content": v}).replace("'", "''") + "'" for k, v in _TREES.items()) + " END"
add("shape_json", lambda s, d: corpus.shaped_texts(s, d).select("page_id", F.when((F.col("page_id") % 11).isin(*_TREES), mk.to_json("content")).alias("v")), f"SELECT p_partkey AS page_id, replace(replace(replace(replace({_TREE_SQL}, '{{n}}', p_name), '{{t}}', p_type), '{{s}}', p_size::VARCHAR), '{{k}}', p_partkey::VARCHAR) AS v FROM part")
add("fragment_params", lambda s, d: corpus.parts_apart(s, d).select("p_partkey", F.explode(mk.fragment_params(F.concat(F.col("p_name"), F.lit("| size = "), F.col("p_size").cast("string"), F.lit("|{{x|a=b}} [[c|d]]|")))).alias("p")).select("p_partkey", "p.name", "p.value"), "SELECT p_partkey, '' AS name, p_name AS value FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part UNION ALL SELECT p_partkey, '', '{{x|a=b}} [[c|d]]' FROM part UNION ALL SELECT p_partkey, '', '' FROM part")

#: (shape, options, what they give).
_OPTIONS = (
    (7, {"heading_underlines": True}, "'lead' || chr(10) || 'A ' || z || chr(10) || repeat('=', 2 + length(z)) || chr(10) || 'B' || chr(10) || '-' || chr(10) || 'C' || chr(10) || '-' || chr(10) || 'text' || chr(10) || 'D' || chr(10) || '='"),
    (7, {"include_headings": False}, "'lead' || chr(10) || 'text'"),
    (0, {"list_bullets": False}, "n || chr(10) || t || chr(10) || '  ' || z"),
    (0, {"list_item_prefix": "- "}, "'- ' || n || chr(10) || '- ' || t || chr(10) || '  - ' || z"),
    (0, {"include_lists": False}, "''"),
    (1, {"include_tables": False}, "'end'"),
    (10, {"include_links": False}, "'text ''''' || n || ''''''"),
    (9, {"max_line_width": 200}, "n || ' ' || t || ' ' || z || ' end'"),
    (10, {"show_link_targets": True}, "'text ''''' || n || ''''' http://x.org/' || k || ' [' || n || '](File:' || t || ') [:Category:' || t || '](:Category:' || t || ')'"),
    (7, {"collapse_whitespace": False}, "'lead' || repeat(chr(10), 2) || 'A ' || z || repeat(chr(10), 2) || 'B' || repeat(chr(10), 2) || 'C' || repeat(chr(10), 2) || 'text' || repeat(chr(10), 2) || 'D'"),
    (7, {"paragraph_separator": "\n"}, "'lead' || chr(10) || 'A ' || z || chr(10) || 'B' || chr(10) || 'C' || chr(10) || 'text' || chr(10) || 'D'"),
)
add("plain_text_options", lambda s, d: corpus.shaped_texts(s, d).select("page_id", *(mk.plain_text(F.when(F.col("page_id") % 11 == k, F.col("content")), **c).alias(f"v{i}") for i, (k, c, _) in enumerate(_OPTIONS))),
    "SELECT p_partkey AS page_id, " + ", ".join(f"CASE WHEN p_partkey % 11 = {k} THEN {e} END AS v{i}" for i, (k, _, e) in enumerate(_OPTIONS)) + " FROM (SELECT p_partkey, p_name AS n, p_type AS t, p_size::VARCHAR AS z, p_partkey::VARCHAR AS k FROM part)")

# templates
_inv = lambda s, d: _wiki(s, d).select("page_id", F.explode(mk.find_invocations("content")).alias("i"))
add("invocations", lambda s, d: _inv(s, d).select("page_id", F.col("i.name").alias("name"), F.size("i.params").alias("n"), F.col("i.params")[1]["value"].alias("price")), f"SELECT p_partkey AS page_id, 'Infobox part' AS name, 3::INTEGER AS n, '{{{{fmt|' || {_PRICE} || '}}}}' AS price FROM part")
add("invocation_get", lambda s, d: _inv(s, d).select("page_id", mk.invocation_get(F.col("i"), "size").alias("size"), mk.invocation_get(F.col("i"), 1).alias("first"), mk.invocation_get(F.col("i"), 2).alias("second")), f"SELECT p_partkey AS page_id, {_SIZE} AS size, p_name AS first, NULL::VARCHAR AS second FROM part")
_tpl = lambda s, d: corpus.parts_apart(s, d).select("p_partkey", "p_name", F.concat(F.lit("<noinclude>About "), F.col("p_type"), F.lit("{{doc}}.</noinclude>{{{a|{{{b"), F.col("p_size").cast("string"), F.lit("}}}}}} {{{a}}}")).alias("t"))
add("template_definition", lambda s, d: _tpl(s, d).select("p_partkey", mk.template_definition("p_name", "t").alias("x")).select("p_partkey", "x.name", "x.redirect", "x.description", "x.params"), "SELECT p_partkey, p_name AS name, NULL::VARCHAR AS redirect, 'About ' || p_type || '.' AS description, ['a', 'b' || p_size] AS params FROM part")
add("template_find_params", lambda s, d: _tpl(s, d).select("p_partkey", mk.find_parameters("t").alias("v")), "SELECT p_partkey, ['a', 'b' || p_size] AS v FROM part")
add("template_data", lambda s, d: corpus.parts_apart(s, d).select("p_partkey", mk.template_data(F.concat(F.lit('{"params": {"size": {"default": '), F.col("p_size").cast("string"), F.lit(', "required": true}, "name": {"description": "'), F.col("p_name"), F.lit('", "aliases": ["n"]}}}'))).alias("x")).select("p_partkey", F.explode("x").alias("x")).select("p_partkey", "x.*"),
    "SELECT p_partkey, 'name' AS name, NULL::VARCHAR AS default_value, p_name AS description, false AS required, ['n'] AS aliases FROM part UNION ALL SELECT p_partkey, 'size', cast(p_size AS string), NULL, true, [] FROM part")
_fnames = lambda s, d: corpus.part(s, d).select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN ' #IfEq' WHEN 1 THEN 'padleft:' WHEN 2 THEN p_type ELSE '#switch:' END").alias("t"))
add("is_parser_function", lambda s, d: _fnames(s, d).select("p_partkey", mk.is_parser_function("t").alias("v")), "SELECT p_partkey, p_partkey % 4 <> 2 AS v FROM part")
add("parser_function_name", lambda s, d: _fnames(s, d).select("p_partkey", mk.parser_function("t").alias("v")), "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '#ifeq' WHEN 3 THEN '#switch' ELSE 'Unknown' END AS v FROM part")
_NOW = datetime.datetime(2026, 3, 4, 5, 6, 7)


def _expand(name: str, parts: list[str], sql: str, title: str | None = None) -> None:
    """parts: literals and, as <column>, columns of part."""

    def build(s: SparkSession, d: str) -> DataFrame:
        text = F.concat(*(F.expr(p[1:-1]) if p.startswith("<") else F.lit(p) for p in parts))
        df = corpus.part(s, d).select("p_partkey", F.expr(title).alias("title") if title else F.lit("").alias("title"), text.alias("t"))
        return mk.expand(df, corpus.template_pages(s), "t", title="title", now=_NOW, out="v").select("p_partkey", "v")

    add(name, build, f"SELECT p_partkey, {sql} AS v FROM part")


_S = "<cast(p_size AS string)>"
_expand("expand_params", ["x {{Infobox part|size=", _S, "|price=9|", "<p_name>", "}} y"], f"concat('x [', {_SIZE}, ' at 9 of ', p_name, '/plain] y')")
_expand("expand_nested", ["{{Infobox part|price={{fmt|", _S, "}}}}"], f"concat('[? at $', {_SIZE}, ' of none/plain]')")
_expand("expand_unknown", ["a {{nothing|", "<p_name>", "|{{fmt|1}}}} b {{loop}}"], "concat('a {{nothing|', p_name, '|{{fmt|1}}}} b {{loop}}')")
_expand("expand_redirect", ["{{Old|", "<p_name>", "}}"], "concat('$', p_name)")
_expand("pf_if", ["{{#if: ", "<CASE WHEN p_size > 25 THEN p_name ELSE ' ' END>", " | yes ", "<p_type>", " | no }}"], "CASE WHEN p_size > 25 THEN 'yes ' || p_type ELSE 'no' END")
_expand("pf_ifeq", ["{{#ifeq: ", _S, "|25|same|", _S, "}}"], f"CASE WHEN p_size = 25 THEN 'same' ELSE {_SIZE} END")
_expand("pf_switch", ["{{#switch:", "<p_type>", "|ECONOMY|SMALL=cheap|LARGE=big|#default=other ", "<p_type>", "}}"], "CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'cheap' WHEN p_type = 'LARGE' THEN 'big' ELSE 'other ' || p_type END")
_expand("pf_expr", ["{{#expr: ", _S, ".50 }}"], f"{_SIZE} || '.5'")
_expand("pf_ifexpr", ["{{#ifexpr: ", "<cast(p_partkey % 3 AS string)>", "|t|f}}"], "CASE WHEN p_partkey % 3 <> 0 THEN 't' ELSE 'f' END")
_expand("pf_ifexist", ["{{#ifexist: ", "<CASE WHEN p_size > 25 THEN 'fmt' ELSE p_name END>", "|t|f}}"], "CASE WHEN p_size > 25 THEN 't' ELSE 'f' END")
_expand("pf_tag", ["{{#tag:b|", "<p_name>", "}}{{#language:", "<p_type>", "}}"], "concat('<b>', p_name, '</b>', p_type)")
_expand("pf_time", ["{{#time:Y-m-d H:i:s}} ", "<p_name>"], "concat('2026-03-04 05:06:07 ', p_name)")
_expand("magic_page_names", ["{{PAGENAME}}|{{BASEPAGENAME}}|{{SUBPAGENAME}}|{{ROOTPAGENAME}}|{{TALKPAGENAME}}"], "concat(p_name, '/', p_type, '/', p_size, '|', p_name, '/', p_type, '|', p_size, '|', p_name, '|Talk:', p_name, '/', p_type, '/', p_size)", "concat(p_name, '/', p_type, '/', p_size)")
_expand("magic_constants", ["{{SITENAME}} {{SERVER}} {{CONTENTLANG}} {{CURRENTYEAR}} {{CURRENTTIMESTAMP}} {{NUMBEROFPAGES}} ", "<p_name>"], "concat('Wikipedia //en.wikipedia.org en 2026 20260304050607 0 ', p_name)")
add("template_closure", lambda s, d: mk.template_closure(corpus.part(s, d).select(F.col("p_partkey").alias("template"), F.expr("p_partkey div 2").alias("uses"))), "WITH RECURSIVE c AS (SELECT p_partkey AS template, p_partkey // 2 AS uses FROM part UNION SELECT c.template, p.p_partkey // 2 FROM c JOIN part p ON p.p_partkey = c.uses) SELECT template, uses FROM c")

_BIG = "concat('part ', p_name)"
add("expand_by_join", lambda s, d: mk.expand(corpus.part(s, d).select("p_partkey", F.concat(F.lit("{{outer|"), F.col("p_partkey").cast("string"), F.lit("}} {{none}}")).alias("t")), corpus.part(s, d).select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.col("p_name"), F.lit("/{{{1}}}")).alias("content")).union(s.createDataFrame([("outer", "<{{t{{{1}}}|x}}>")], "name string, content string")), "t", out="v", stats="st", most_bytes=1000).select("p_partkey", "v", F.col("st.expanded").alias("expanded"), F.col("st.errors").alias("errors")),
    "SELECT p_partkey, concat('<', p_name, '/x> {{none}}') AS v, 2 AS expanded, 1 AS errors FROM part")
add("expand_namespace", lambda s, d: mk.expand(corpus.part(s, d).select("p_partkey", F.col("p_name").alias("title"), F.lit("Help").alias("ns"), F.lit("{{FULLPAGENAME}} {{NAMESPACE}}").alias("t")), corpus.template_pages(s), "t", title="title", namespace="ns", out="v").select("p_partkey", "v"), "SELECT p_partkey, concat('Help:', p_name, ' Help') AS v FROM part")
add("invocation_get_or", lambda s, d: _inv(s, d).select("page_id", mk.invocation_get_or(F.col("i"), "size", "?").alias("size"), mk.invocation_get_or(F.col("i"), "colour", "plain").alias("colour")), f"SELECT p_partkey AS page_id, {_SIZE} AS size, 'plain' AS colour FROM part")


# dumps: written from the tables as files, then read
def _dump(s: SparkSession, d: str, files: int = 4) -> tuple[str, DataFrame]:
    """(folder, (dump, index, pages)): four (or files) multistream dumps with their indexes, 100 pages a stream; the
    page of a key lies in the dump of key % 4, in order of keys."""
    folder, listed = shared_path(s, "dumps"), shared_path(s, "dump-list")
    own = corpus.part(s, d).select(F.col("p_partkey").alias("page_id"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 0 END").alias("ns"), F.expr(corpus.TITLE).alias("title"), F.concat(F.lit(" <b>"), F.col("p_name"), F.lit("</b> & [["), F.col("p_type"), F.lit("]]\n")).alias("content"))
    dump.write_dump(own.repartitionById(files, (F.col("page_id") % files).cast("int")).sortWithinPartitions("page_id"), folder).write.parquet(listed)
    return folder, s.read.parquet(listed)


_TEXT = "concat(' <b>', p_name, '</b> & [[', p_type, ']]', chr(10))"
_NS2 = "CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 0 END::INTEGER"
_files = lambda s, d, kind="xml": f"{_dump(s, d)[0]}/*{'.xml.bz2' if kind == 'xml' else '-index.txt.bz2'}"
add("dump_pages", lambda s, d: dump.read_pages(s, _files(s, d), metadata=True).select("page_id", "ns", "title", F.col("revisions")[0]["id"].alias("revision_id"), pg.content().alias("content"), F.regexp_extract("file_path", r"dump-0000(\d)\.xml\.bz2$", 1).cast("int").alias("file")), f"SELECT p_partkey AS page_id, {_NS2} AS ns, {corpus.TITLE} AS title, p_partkey + 1 AS revision_id, {_TEXT} AS content, (p_partkey % 4)::INTEGER AS file FROM part")
add("dump_siteinfo", lambda s, d: dump.read_siteinfo(s, _files(s, d)).distinct(), "SELECT 'Test' AS site_name, 'testwiki' AS db_name, NULL::VARCHAR AS base_url, NULL::VARCHAR AS generator")
add("dump_namespaces", lambda s, d: dump.read_namespaces(s, _files(s, d)).distinct(), "SELECT * FROM (VALUES (0::INTEGER, '', true, false), (10, 'Template', false, false)) t(ns, name, is_content, is_talk)")
add("dump_elements", lambda s, d: dump.read_elements(s, _files(s, d), "revision", "id long, text struct<_VALUE:string,_bytes:long>").select("id", F.col("text._bytes").alias("bytes")), f"SELECT p_partkey + 1 AS id, octet_length(encode({_TEXT}))::BIGINT AS bytes FROM part")
add("dump_index", lambda s, d: dump.read_index(s, _files(s, d, "index")).select("page_id", "title"), f"SELECT p_partkey AS page_id, {corpus.TITLE} AS title FROM part")
add("dump_lines", lambda s, d: dump.read_lines(s, _files(s, d, "index")).agg(F.count("*").alias("lines"), F.count_if(F.col("value").rlike("^[0-9]+:[0-9]+:")).alias("well")), "SELECT count(*) AS lines, count(*) AS well FROM part")
add("dump_chunks", lambda s, d: ix.chunks(dump.read_index(s, _files(s, d, "index")), file="file", run_lines=300).select(F.size("entries").alias("n"), F.col("entries")[0]["title"].alias("first"), F.col("entries")[F.size("entries") - 1]["page_id"].alias("last"), F.col("end").isNull().alias("open")),
    f"SELECT count(*)::INTEGER AS n, arg_min(title, page_id) AS first, max(page_id) AS last, c = any_value(m) AS open FROM (SELECT *, max(c) OVER (PARTITION BY f) AS m FROM (SELECT p_partkey AS page_id, {corpus.TITLE} AS title, p_partkey % 4 AS f, (row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) - 1) // 100 AS c FROM part)) GROUP BY f, c")
add("dump_extract", lambda s, d: dump.extract_pages(_terms(s, d), dump.read_index(s, f"{_dump(s, d, mk.tasks_for(corpus.part(s, d)))[0]}/*-index.txt.bz2")), f"SELECT ordinal, title, p_partkey IS NOT NULL AS found, p_partkey AS page_id, CASE WHEN p_partkey IS NULL THEN '' ELSE {_TEXT} END AS content FROM {_TERMS} t LEFT JOIN part p ON t.title = {corpus.TITLE}")


def _damaged(s: SparkSession, d: str) -> DataFrame:
    """All ranges of the dumps, each second one cut off in the middle."""
    ranges = ix.chunks(dump.read_index(s, _files(s, d, "index")).withColumn("path", dump.dump_of_index(F.col("file"))), file="path")
    size = F.coalesce(F.col("end"), F.col("start") + 1_000_000) - F.col("start")
    first = F.col("entries")[0]["page_id"]
    cut = ranges.select("path", "start", F.when(F.pmod(F.floor(first / 400), F.lit(2)) == 1, F.col("start") + F.least(size, F.lit(60))).otherwise(F.col("end")).alias("end"))
    return dump.read_chunks(cut).select("page_id", F.col("error").isNotNull().alias("failed"))


add("dump_damaged", _damaged, "SELECT CASE WHEN c % 2 = 0 THEN page_id END AS page_id, c % 2 = 1 AS failed FROM (SELECT p_partkey AS page_id, (row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) - 1) AS r, r // 100 AS c FROM part) WHERE c % 2 = 0 OR r % 100 = 0")
add("dump_terms", lambda s, d: _terms_file(s, d), f"SELECT title, count(*) AS n FROM {_TERMS} GROUP BY title")
add("dump_stream", lambda s, d: _streamed(s, d), "SELECT count(*) AS pages, count(*)::BIGINT AS links, 0::BIGINT AS templates FROM part WHERE p_partkey % 2 = 1")
add("xml_from_strings", lambda s, d: dump.pages_from_xml(corpus.part(s, d).select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("<page><title>"), F.col("p_name"), F.lit(" &amp; x</title><ns>0</ns><id>"), F.col("p_partkey").cast("string"), F.lit("</id><revision><id>7</id><text>"), F.col("p_type"), F.lit("</text></revision></page>"))).alias("x")), "x", "p_partkey").select("p_partkey", "page_id", "title", pg.content().alias("content")), "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_partkey END AS page_id, CASE WHEN p_partkey % 5 > 0 THEN p_name || ' & x' END AS title, CASE WHEN p_partkey % 5 > 0 THEN p_type ELSE '' END AS content FROM part")
add("bz2_columns", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("b")).select("doc_id", "b", dump.compress_bz2("b").alias("z")).select("doc_id", (F.concat("b", "b") == dump.decompress_bz2(F.concat("z", "z"))).alias("same"), dump.is_bz2("z").alias("packed"), dump.is_bz2("b").alias("plain"), F.length(dump.decompress_bz2("b")).alias("none")), "SELECT doc_id, true AS same, true AS packed, false AS plain, 0::INTEGER AS none FROM documents")


def _terms_file(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "terms")
    _terms(s, d).select(F.concat(F.lit("  "), "title", F.lit(" \n \n"))).write.text(path)
    return dump.read_terms(s, path).groupBy("title").agg(F.count("*").alias("n"))


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """Running totals of a stream of dumps, as they are when all have arrived."""
    folder, _ = _dump(s, d)
    name = "totals_" + folder.rpartition("-")[2]
    pages = dump.stream_pages(s, f"{folder}/*.xml.bz2")
    q = totals(parsed_pages(pages, pg.PageFilter(namespaces=(0,)))).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", shared_path(s, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(name)


def _page_files(s: SparkSession, d: str) -> DataFrame:
    """Files of all pages, read again; each name is used by two pages that differ in case."""
    folder, listed = shared_path(s, "pages"), shared_path(s, "page-list")
    p = corpus.part(s, d).select("p_partkey", F.concat(F.lit("A/b"), (F.col("p_partkey") - F.col("p_partkey") % 2).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit("x")).otherwise(F.lit("X"))).alias("title"), F.col("p_name").alias("content"))
    sinks.write_page_files(p, folder, key="p_partkey").write.parquet(listed)
    files = sinks.read_page_files(s.read.parquet(listed))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "value")


add("page_files", _page_files, "SELECT concat('A_b', p_partkey - p_partkey % 2, CASE p_partkey % 2 WHEN 0 THEN 'x' ELSE 'X' END, CASE WHEN count(*) OVER (PARTITION BY p_partkey // 2) > 1 THEN '.' || p_partkey ELSE '' END, '.wiki') AS name, p_name AS value FROM part")

# sinks, catalog, names
_fields = lambda k: [F.get_json_object("j", f"$.revisions[{k}].{f}").alias(f"{f}{k}") for f in ("id", "parent_id", "timestamp", "contributor", "comment", "content", "model", "format", "sha1")]
add("json_page", lambda s, d: corpus.wiki_pages(s, d).select("page_id", sinks.page_json().alias("j")).select("page_id", F.get_json_object("j", "$.title").alias("title"), F.get_json_object("j", "$.namespace").alias("namespace"), F.get_json_object("j", "$.redirect").alias("redirect"), *_fields(0), *_fields(1)),
    f"SELECT p_partkey AS page_id, {corpus.TITLE} AS title, ({corpus.NS})::VARCHAR AS namespace, {corpus.REDIRECT} AS redirect, " + ", ".join(f"(p_partkey * 10 + {k + 1})::VARCHAR AS id{k}, {'NULL' if k == 0 else '(p_partkey * 10 + 1)'}::VARCHAR AS parent_id{k}, '2026-01-01T00:00:00Z' AS timestamp{k}, 'u' AS contributor{k}, NULL::VARCHAR AS comment{k}, {corpus.CONTENT if k else repr('stub')} AS content{k}, CASE WHEN p_partkey % 7 > 0 THEN 'wikitext' END AS model{k}, 'text/x-wiki' AS format{k}, NULL::VARCHAR AS sha1{k}" for k in (0, 1)) + " FROM part")
add("json_ast", lambda s, d: _wiki(s, d).select("page_id", mk.to_json("content").alias("j")).select("page_id", F.get_json_object("j", "$.type").alias("type"), F.get_json_object("j", "$.content[0].content[0].text").alias("bold")), "SELECT p_partkey AS page_id, 'Document' AS type, p_name AS bold FROM part")
add("jsonl_count", lambda s, d: corpus.wiki_pages(s, d).select(sinks.page_json().alias("j")).agg(F.count("*").alias("n"), F.count_if(F.contains("j", F.lit("\n"))).alias("broken")), "SELECT count(*) AS n, 0::BIGINT AS broken FROM part")
add("json_array", lambda s, d: corpus.part(s, d).groupBy("p_brand").agg(sinks.json_array(F.to_json(F.struct("p_partkey")), -F.col("p_partkey")).alias("j")), """SELECT p_brand, '[' || string_agg('{"p_partkey":' || p_partkey || '}', ', ' ORDER BY p_partkey DESC) || ']' AS j FROM part GROUP BY 1""")
_names = lambda s, d: corpus.part(s, d).select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 0 THEN 'wikipedia' WHEN 1 THEN 'Wiktionary' ELSE 'wikidata' END").alias("project"), F.expr("CASE p_partkey % 2 WHEN 0 THEN 'pl' ELSE 'en' END").alias("lang"), F.concat(F.lit("202601"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")).alias("date"))
_STEM = "concat(CASE p_partkey % 2 WHEN 0 THEN 'pl' ELSE 'en' END, CASE p_partkey % 3 WHEN 0 THEN 'wiki' WHEN 1 THEN 'wiktionary' ELSE 'wikidata' END, '-202601', lpad(cast(p_partkey % 28 + 1 AS string), 2, '0'))"
add("catalog_names", lambda s, d: catalog.file_names(_names(s, d)).select("p_partkey", "dump_file", "index_file", "symbolic"), f"SELECT p_partkey, {_STEM} || '-pages-articles-multistream.xml.bz2' AS dump_file, {_STEM} || '-pages-articles-multistream-index.txt.bz2' AS index_file, {_STEM} AS symbolic FROM part")
add("catalog_dates", lambda s, d: catalog.newest_dates(_names(s, d).select("lang", F.when(F.col("p_partkey") % 9 > 0, F.col("date")).otherwise(F.lit("latest")).alias("name")), "name", "lang"), "SELECT CASE p_partkey % 2 WHEN 0 THEN 'pl' ELSE 'en' END AS lang, max('202601' || lpad(cast(p_partkey % 28 + 1 AS string), 2, '0')) AS date FROM part WHERE p_partkey % 9 > 0 GROUP BY 1")
add("string_pool", lambda s, d: corpus.part(s, d).agg(F.countDistinct("p_type").alias("n"), F.sum(F.octet_length("p_type")).alias("bytes")), "SELECT count(DISTINCT p_type) AS n, sum(strlen(p_type))::BIGINT AS bytes FROM part")
