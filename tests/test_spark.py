import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from textloom import functions as fn
from textloom.operators import index, markup, pages
from textloom.plans.queries import ORACLE_SQL, QUERIES
from textloom.sources import catalog, dump, sinks
from textloom.streaming import parsed_pages, totals

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "f, text, expected",
    [
        (fn.trim, "\t\nhello \x0b", "hello"), (fn.collapse_whitespace, "a\t\nb", "a b"), (lambda c: fn.count_occurrences(c, "aa"), "aaa", 1), (fn.decode_html_entities, "&#x3C;&amp;lt;&#65;&#0;&bad;", "<&lt;A&#0;&bad;"),
        (fn.normalize_title, " test#section", "Test"), (fn.normalize_title, "_foo_bar_", "Foo bar"), (fn.title_to_url, "C++ é~*", "C%2B%2B_%C3%A9~%2A"), (fn.url_to_title, "caf%C3%A9_a+b%zz", "café a+b%zz"), (fn.to_upper, "straße", "STRASSE"), (fn.capitalize_first, "ßa", "ßa"),
        (lambda c: fn.normalize(c, "NFKC"), "ﬁ", "fi"), (lambda c: fn.normalize(c, "NFD"), "é", "é"), (fn.count_codepoints, "a🎉b", 3), (lambda c: fn.split(c, "."), "a..b.", ["a", "", "b", ""]), (lambda c: fn.split_n(c, ":", 2), "a:b:c", ["a", "b:c"]),
        (lambda c: fn.split_any(c, ",;"), "a,;b,", ["a", "b"]), (lambda c: fn.find_all(c, "aa"), "aaaa-aa", [0, 2, 5]), (fn.parse_int, " -12\n", -12), (fn.parse_int, "+1", None), (fn.parse_int, "99999999999999999999", None), (fn.strip_tags, "a<b>c</b> > d<e", "ac  d"),
        (fn.split_lines, "Unix\nWindows\r\nOld Mac\rMixed", ["Unix", "Windows", "Old Mac", "Mixed"]), (fn.count_lines, "", 0), (lambda c: fn.replace_first(c, "b", "X"), "abab", "aXab"), (lambda c: fn.replace_first(c, "", "X"), "ab", "Xab"), (lambda c: fn.get_line(c, 5), "a\nb", None),
        (fn.encode_html_entities, "<a href='x'>&\"", "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"), (fn.safe_file_name, 'a/b:c*?"<>|', "a_b_c______"), (fn.codepoints, "a🎉\n", ["a", "🎉", "\n"]), (fn.base_page_name, "A/B/C", "A/B"), (fn.codepoints, "", []),
    ],
)
def test_functions(spark, f, text, expected):
    assert value(spark, f(F.lit(text))) == expected
    assert value(spark, f(F.lit(None).cast("string"))) is None


def test_invalid_utf8(spark):
    assert value(spark, fn.is_valid_utf8(F.lit(b"\xc0\x80"))) is False and value(spark, fn.is_valid_utf8(F.lit("é".encode()))) is True


def test_index_vectors(spark):
    lines = ["100:1:A", "100:2:Title:With:Colons", "invalid line", "x:1:B", "200:3:C\r", "100:4:D", ":5:E"]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, value string")
    parsed = index.parse_index(df)
    assert [(r.offset, r.page_id, r.title) for r in parsed.orderBy("seq").collect()] == [(100, 1, "A"), (100, 2, "Title:With:Colons"), (200, 3, "C"), (100, 4, "D")]
    for lines in (1, 2, 1000):
        got = index.chunks(parsed, 900, run_lines=lines).collect()
        assert sorted((r.start, r.end, [e.page_id for e in r.entries]) for r in got) == [(100, 200, [1, 2]), (100, 900, [4]), (200, 100, [3])]
    assert index.chunks(parsed.where("false"), 1).count() == 0


@pytest.fixture(scope="module")
def written(tmp_path_factory):
    d = tmp_path_factory.mktemp("base") / "plwiki" / "20260101"
    d.mkdir(parents=True)
    at = catalog.DumpPath(str(d.parent.parent), language="pl", date="20260101")
    rows = [(i, (0, 10)[i % 2], f"Title: {i} & <x>", f" line {i}\n<b>é</b> [[L{i}]] " + "x" * i + " ") for i in range(1, 31)]
    dump.write_multistream(rows, at.dump_file, at.index_file, per_stream=7)
    return at, rows


def test_dump_round_trip(spark, written):
    at, rows = written
    got = dump.read_pages(spark, at.dump_file).select("page_id", "ns", "title", pages.content().alias("c"), "redirect_target")
    assert sorted(tuple(r) for r in got.collect()) == [(*r, None) for r in rows]
    assert {(r.ns, r.name) for r in dump.read_namespaces(spark, at.dump_file).collect()} == {(0, ""), (10, "Template")}
    assert dump.read_siteinfo(spark, at.dump_file).first().db_name == "testwiki"
    ix = dump.read_index(spark, at.index_file)
    assert ix.count() == 30 and at.size(spark) > 0 and at.of(date="").newest(spark).date == "20260101" and at.available_languages(spark) == ["pl"]
    terms = spark.createDataFrame([(1, rows[3][2]), (2, "absent"), (3, rows[3][2]), (4, rows[29][2])], "ordinal long, title string")
    out = [tuple(r) for r in dump.extract_pages(terms, ix, at.dump_file).orderBy("ordinal").collect()]
    assert out == [(1, rows[3][2], True, 4, rows[3][3]), (2, "absent", False, None, ""), (3, rows[3][2], True, 4, rows[3][3]), (4, rows[29][2], True, 30, rows[29][3])]


def test_stream_of_dumps(spark, written, tmp_path):
    at, _ = written
    q = totals(parsed_pages(dump.stream_pages(spark, os.path.dirname(at.dump_file) + "/*.xml.bz2"), pages.PageFilter(namespaces=(0,)))).writeStream.outputMode("complete").format("memory").queryName("t").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.table("t").first()) == (15, 15, 0)


def test_codec():
    assert dump.decompress(dump.compress(b"ab") + dump.compress(b"cd", 99)) == b"abcd" and dump.decompress(b"xx") == b""


def test_bz2_magic(spark):
    assert value(spark, dump.is_bz2(F.lit(b"BZh9xx"))) is True and value(spark, dump.is_bz2(F.lit(b"BZh0"))) is False


def test_terms(spark, tmp_path):
    (tmp_path / "t.txt").write_text("  one \n\n\ttwo\n \nroko\nroko\n")
    assert [r.title for r in dump.read_terms(spark, str(tmp_path / "t.txt")).orderBy("ordinal").collect()] == ["one", "two", "roko", "roko"]


def test_catalog_names():
    at = catalog.DumpPath("/b", "Wiktionary", "pl", "20260101")
    assert at.symbolic_name == "plwiktionary-20260101" and at.dump_file.endswith("/plwiktionary-20260101-pages-articles-multistream.xml.bz2")
    assert catalog.is_date("20260101") and not catalog.is_date("latest") and catalog.project_of("wiki") == "wikipedia"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "A/b", "x\ny")], "page_id long, title string, content string")
    more = df.union(spark.createDataFrame([(2, "a:B", None), (3, None, "z"), (4, "c", "t")], df.schema))
    assert sinks.write_page_files(more, str(tmp_path / "f"), key="page_id").count() == 3
    assert sorted(os.listdir(tmp_path / "f")) == ["A_b.1.wiki", "a_B.2.wiki", "c.wiki"] and (tmp_path / "f" / "A_b.1.wiki").read_text() == "x\ny"
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["content"] == "x\ny"


def test_null_and_empty_markup(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "[[a]]")], "page_id long, content string")
    assert [tuple(r) for r in markup.links(df, "content", "page_id").collect()] == [(3, "a", "", "a", 0)]
    assert markup.section_tree(df, "content", "page_id").count() == 0
    assert df.select(markup.plain_text("content").alias("v")).where("v IS NULL").count() == 1


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_each_query_has_sql():
    assert set(ORACLE_SQL) == set(QUERIES) and len(QUERIES) > 130


@pytest.mark.parametrize("name", ["text_find_all", "title_normalize", "page_stats", "index_chunks", "extract_pages", "links_internal", "section_totals", "template_params", "tables", "plain_text", "expand_params", "pf_switch", "template_closure", "json_page"])
def test_query_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("part", "orders", "documents", "pages", "customer", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    r = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = sorted((repr([row[names.index(k)] for k in columns]) for row in r.fetchall()))
    assert sorted(repr([row[k] for k in columns]) for row in got.collect()) == want


@pytest.mark.parametrize("name", ["uni_capitalize_first", "uni_char_class", "terms_coverage", "terms_missing", "dump_extract", "dump_damaged", "dump_chunks", "dump_stream", "page_files", "expand_by_join", "shape_plain_text", "shape_rewrite", "token_positions"])
def test_whole_tables_against_sql(spark, name):
    test_query_against_sql(spark, name)


def test_closure_stops_at_its_bound(spark):
    from textloom.operators.graph import closure

    chain = spark.range(70).selectExpr("id AS a", "id + 1 AS b").union(spark.sql("SELECT CAST(NULL AS BIGINT), 1L"))
    for most in (1, 5, 40):
        assert closure(chain, "a", "b", most).selectExpr("max(b - a) AS d", "count(*) AS n").first() == (most, sum(71 - k for k in range(1, most + 1)))
    ring = spark.range(6).selectExpr("id AS a", "(id + 1) % 6 AS b")
    assert closure(ring, "a", "b").count() == 36


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_are_not_broadcast(spark):
    df = spark.createDataFrame([(1, "* a ''b'' <nowiki>c</nowiki>\n** d"), (2, "x"), (None, "* e\n* f"), (3, "*\n")], "page_id long, content string")
    nodes = markup.node_table(df, "content", "page_id").cache()
    by_join = markup.label(nodes, nodes.where("type = 'ListItem'").select("page_id", "id", "last_desc"), "page_id")
    assert "Broadcast" not in plan(by_join) and "Join" not in plan(QUERIES["node_labels"](spark, SF))
    want = sorted((repr((r.page_id, r.id, r.label)) for r in markup.labels(df, "content", "ListItem", "page_id").collect()))
    assert sorted(repr((r.page_id, r.id, r.label)) for r in by_join.collect()) == want and len(want) == 5
    test_query_against_sql(spark, "node_labels")


def test_page_files_are_read_by_their_paths(spark, tmp_path):
    titles = ["a b", "%41", "é?", "x"]
    df = spark.createDataFrame([(t, f"{t}\r\nend") for t in titles] + [("n", None)], "title string, content string")
    files = sinks.write_page_files(df, f"file://{tmp_path}/f")
    files.write.parquet(str(tmp_path / "list"))
    got = sinks.read_page_files(spark.read.parquet(str(tmp_path / "list"))).collect()
    assert sorted((r.path.rpartition("/")[2], r.value) for r in got) == sorted([("a b.wiki", "a b\r\nend"), ("%41.wiki", "%41\r\nend"), ("é_.wiki", "é?\r\nend"), ("x.wiki", "x\r\nend"), ("n.wiki", "")])
    assert "FileScan text" not in plan(QUERIES["page_files"](spark, SF))


def test_texts_are_spread_once(spark):
    df = spark.createDataFrame([(i, "x") for i in range(9)], "page_id long, content string")
    once = markup.spread(df)
    assert once.rdd.getNumPartitions() == 4 and markup.spread(once.where("page_id > 1").select("content")).rdd.getNumPartitions() == 4
    assert plan(QUERIES["horizontal_rules"](spark, SF)).count("Exchange RoundRobin") == 1


def test_classes_are_counted_without_arrays(spark):
    texts = ["", "aé1 ,\x0b", "🎉𝒜a𝟙\u2003", "¿«x»", "\u0300 e\u0301\u0660", "a" * 5000, None, "\ud7ff\U0010ffff\x85\xa0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    kinds = {"letter": fn.is_letter, "digit": fn.is_digit, "whitespace": fn.is_whitespace, "alphanumeric": fn.is_alphanumeric, "punctuation": fn.is_punctuation}
    row = df.select("t", *(fn.count_class("t", k).alias(k) for k in kinds), *(F.when(F.col("t").isNotNull(), F.size(F.filter(fn.codepoints("t"), f))).alias("own_" + k) for k, f in kinds.items())).collect()
    assert all(r[k] == r["own_" + k] for r in row for k in kinds) and [r.letter for r in row[:3]] == [0, 2, 2]
    assert "lambda" not in plan(QUERIES["uni_char_class"](spark, SF))


@pytest.mark.parametrize("name", ["extract_pages", "terms_coverage", "terms_missing"])
def test_texts_are_not_broadcast_to_be_found(spark, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["ast_to_wikitext", "remove_templates", "strip_formatting", "heading_parse", "summary", "template_data", "fragment_params", "plain_text_targets"])
def test_what_is_parsed_is_spread(spark, name):
    assert "Exchange RoundRobin" in plan(QUERIES[name](spark, SF))
    test_query_against_sql(spark, name)


def test_options_are_tried_on_their_own_texts_only(spark):
    got = QUERIES["plain_text_options"](spark, SF)
    assert "CASE WHEN" not in plan(got).partition("ArrowEvalPython")[0]  # a text that isn't asked for is null before it leaves the JVM
    test_query_against_sql(spark, "plain_text_options")


def test_histogram_is_that_of_the_node_table(spark):
    df = spark.createDataFrame([(1, "[[a|b]] {{c|d=e}}"), (2, ""), (3, None), (4, "* x\n{|\n| s | y\n|}")], "page_id long, content string")
    want = {r["type"]: r["count"] for r in markup.node_table(df, "content", "page_id").groupBy("type").count().collect()}
    assert {r["type"]: r.n for r in markup.node_histogram(df, "content").collect()} == want
    assert "Generate" not in plan(QUERIES["node_histogram"](spark, SF))
    test_query_against_sql(spark, "node_histogram")


def test_long_lists_are_built_in_pieces(spark):
    df = spark.createDataFrame([(1, "[[a]] " * 30_000), (2, None), (3, ""), (4, "[[b]]"), (5, "[[c]] " * 5)], "page_id long, content string").coalesce(1)
    assert {r.page_id: r["count"] for r in markup.links(df, "content", "page_id").groupBy("page_id").count().collect()} == {1: 30_000, 4: 1, 5: 5}


def test_outlines_are_drawn_in_the_parse(spark):
    df = spark.createDataFrame([(1, "== A ==\n=== B ===\n== C ==\n"), (2, "no"), (3, None), (4, "<b>\n== D ==\n</b>\n= E =\n==== F ===="), (None, "= G =")], "page_id long, content string")
    by_tree = markup.section_outline(markup.section_tree(df, "content", "page_id"), "page_id")
    assert sorted(map(repr, markup.section_outlines(df, "content", "page_id").collect())) == sorted(map(repr, by_tree.collect()))
    assert "collect_list" not in plan(QUERIES["section_outline"](spark, SF))
    test_query_against_sql(spark, "section_outline")


def test_closure_finds_each_pair_of_a_tree_once(spark, monkeypatch):
    from textloom.operators.graph import closure

    edges = spark.range(1, 600).selectExpr("id AS a", "id div 2 AS b")
    kind, rows = type(edges), []
    whole = kind.distinct
    monkeypatch.setattr(kind, "distinct", lambda df: rows.append((df.count(), whole(df).count())) or whole(df))
    want = {(i, i >> k) for i in range(1, 600) for k in range(1, i.bit_length() + 1)}
    assert {tuple(r) for r in closure(edges, "a", "b").collect()} == want
    assert len(rows) > 6 and all(n == m for n, m in rows)


def test_closure_of_any_graph(spark):
    import random

    from textloom.operators.graph import closure

    r = random.Random(3)
    pairs = sorted({(r.randrange(14), r.randrange(14)) for _ in range(18)})
    df = spark.createDataFrame(pairs, "a long, b long")
    for most in (1, 2, 3, 6, 7, 40):
        found = step = set(pairs)
        for _ in range(most - 1):
            step = {(x, z) for x, y in step for w, z in pairs if w == y}
            found = found | step
        assert {tuple(x) for x in closure(df, "a", "b", most).collect()} == found


def test_ranges_are_read_by_all_cores(spark, written):
    at, rows = written
    terms = spark.createDataFrame([(1, rows[3][2]), (2, "absent"), (3, None)], "ordinal long, title string")
    out = dump.extract_pages(terms, dump.read_index(spark, at.index_file), at.dump_file)
    assert "Broadcast" not in plan(out).partition("MapInArrow")[0] and [r.found for r in out.orderBy("ordinal").collect()] == [True, False, False]
    ranges = spark.createDataFrame([(at.dump_file, 0, None)], "path string, start long, end long")
    assert dump.read_chunks(ranges).rdd.getNumPartitions() >= 16
