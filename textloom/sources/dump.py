"""Wiki dumps: XML (plain or bz2, several streams), the multistream index, and pages by byte ranges."""

from __future__ import annotations

import bz2
import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import trim
from ..operators.index import by_size, last_by, parse_index, side
from ..operators.index import chunks as index_chunks
from .shared import file_system

PAGE_SCHEMA = (
    "id long, ns int, title string, redirect struct<_title:string>, revision array<struct<id:long, parentid:long, timestamp:string, "
    "contributor:struct<username:string, ip:string, id:long>, minor:string, comment:string, model:string, format:string, text:struct<_VALUE:string, _bytes:long>, sha1:string>>"
)


def _shaped(raw: DataFrame, *more: str) -> DataFrame:
    revision = F.transform(
        "revision",
        lambda r: F.struct(
            r["id"].alias("id"), r["parentid"].alias("parent_id"), r["timestamp"].alias("timestamp"), F.coalesce(r["contributor"]["username"], r["contributor"]["ip"]).alias("contributor"),
            r["comment"].alias("comment"), F.coalesce(r["text"]["_VALUE"], F.lit("")).alias("content"), r["model"].alias("model"), r["format"].alias("format"), r["sha1"].alias("sha1"),
        ),
    )
    return raw.select(*more, F.col("id").alias("page_id"), "ns", "title", F.col("redirect._title").alias("redirect_target"), revision.alias("revisions"))


def read_pages(spark: SparkSession, path: str, *, metadata: bool = False) -> DataFrame:
    """(page_id, ns, title, redirect_target, revisions) of the dumps at path; with metadata also file_path, file_size
    and where the split that has the page begins and how long it is. Text is kept as it is. A dump file is read by
    few tasks; the operators of ``markup`` spread what they parse."""
    raw = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE_SCHEMA).load(path)
    if not metadata:
        return _shaped(raw)
    names = ("file_path", "file_size", "file_block_start", "file_block_length")
    return _shaped(raw.select("*", *(F.col(f"_metadata.{n}").alias(n) for n in names)), *names)


def pages_from_xml(df: DataFrame, xml: str, *keys: str) -> DataFrame:
    """keys and the page columns of a column with a <page> element in each row; what isn't one has nulls and no
    revisions."""
    parsed = df.select(*keys, F.from_xml(F.col(xml), PAGE_SCHEMA, {"rowTag": "page", "ignoreSurroundingSpaces": "false"}).alias("__p")).select(*keys, "__p.*")
    return _shaped(parsed, *keys).withColumn("revisions", F.coalesce("revisions", F.array().cast("array<struct<id:long,parent_id:long,timestamp:string,contributor:string,comment:string,content:string,model:string,format:string,sha1:string>>")))


def read_elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """All elements of a name, wherever they are; schema: their fields, with _name for an attribute and _VALUE for the
    text of an element that has attributes."""
    return spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", "false").schema(schema).load(path)


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The same of dumps as they arrive in folder."""
    return _shaped(spark.readStream.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE_SCHEMA).load(folder))


def read_namespaces(spark: SparkSession, path: str) -> DataFrame:
    """(ns, name, is_content, is_talk) of a dump's header."""
    raw = spark.read.format("xml").option("rowTag", "namespace").schema("_key int, _case string, _VALUE string").load(path)
    ns = F.col("_key")
    return raw.select(ns.alias("ns"), F.coalesce("_VALUE", F.lit("")).alias("name"), (ns == 0).alias("is_content"), ((ns > 0) & (ns % 2 == 1)).alias("is_talk"))


def read_siteinfo(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "siteinfo").schema("sitename string, dbname string, base string, generator string").load(path)
    return raw.select(F.col("sitename").alias("site_name"), F.col("dbname").alias("db_name"), F.col("base").alias("base_url"), "generator")


def read_lines(spark: SparkSession, path: str, *, only_newline: bool = False) -> DataFrame:
    """(value): lines of text files, bz2 too. Lines end at LF, CRLF or CR, or at LF only (CR then stays)."""
    r = spark.read.option("lineSep", "\n") if only_newline else spark.read
    return r.text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, offset, page_id, title); seq is the order within the file."""
    lines = read_lines(spark, path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), "value")
    return parse_index(lines)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, title): the lines that aren't blank, trimmed."""
    lines = read_lines(spark, path).select(F.monotonically_increasing_id().alias("ordinal"), trim("value").alias("title"))
    return lines.where("title <> ''")


def read_terms_for_language(spark: SparkSession, folder: str, language: str) -> DataFrame:
    """(ordinal, title) of folder/terms_to_extract.<language>.txt."""
    return read_terms(spark, f"{folder.rstrip('/')}/terms_to_extract.{language}.txt")


def is_bz2(data) -> Column:
    """Of a binary column: begins like a bz2 stream."""
    c = F.col(data) if isinstance(data, str) else data
    return F.hex(F.substring(c, 1, 4)).rlike("^425A683[1-9]$")


_LEVEL = 9


def decompress(data: bytes) -> bytes:
    """All streams, one after the other; b'' of what isn't bz2."""
    out, rest = [], data
    while rest.startswith(b"BZh"):
        d = bz2.BZ2Decompressor()
        try:
            out.append(d.decompress(rest))
        except OSError:
            break
        rest = d.unused_data
        if not d.eof:
            break
    return b"".join(out)


def compress(data: bytes, level: int = _LEVEL) -> bytes:
    return bz2.compress(data, min(9, max(1, level)))


def _binary(f):
    @arrow_udf("binary")
    def run(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in data.to_pylist()], pa.binary())

    return run


def compress_bz2(data, level: int = _LEVEL) -> Column:
    """Of a binary column; level is brought to 1 to 9."""
    return _binary(lambda x: compress(x, level))(F.col(data) if isinstance(data, str) else data)


def decompress_bz2(data) -> Column:
    """All streams of a binary column's values; empty of what isn't bz2."""
    return _binary(decompress)(F.col(data) if isinstance(data, str) else data)


def pages_of_chunk(xml: str) -> list[tuple[int | None, int | None, str | None, str | None, str | None]]:
    """(page_id, ns, title, text of the first revision, error) of <page> elements that stand side by side; of a
    damaged one the error only."""
    out: list[tuple] = []
    end = 0
    for m in re.finditer(r"<page>.*?</page>", xml, re.S):
        end = m.end()
        try:
            page = ET.fromstring(m.group())
            out.append((int(page.findtext("id") or 0), int(page.findtext("ns") or 0), page.findtext("title") or "", page.findtext("revision/text") or "", None))
        except (ET.ParseError, ValueError) as e:
            out.append((None, None, None, None, f"page not read: {e}"[:200]))
    if "<page>" in xml[end:]:
        out.append((None, None, None, None, "page not ended"))
    return out


def read_chunks(ranges: DataFrame, dump: str | None = None, *, start: str = "start", end: str = "end", path: str = "path") -> DataFrame:
    """(path, start, page_id, ns, title, content, error): the pages of byte ranges of multistream dumps, of one file or
    of those in the column path. A range is read and decompressed once; an open end is the file's. What can't be
    read has a row with its error only: a page, a stream that is cut or damaged, a file. Ranges are spread over
    tasks."""
    own = F.lit(dump) if dump else F.col(path)
    ranges = ranges.select(own.alias("path"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end")).where("start IS NOT NULL AND path IS NOT NULL").distinct()

    def run(batches):
        for b in batches:
            for p, s, e in zip(*(b.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                rows: list[tuple] = []
                try:
                    system, at = file_system(p)
                    with system.open_input_file(at) as f:
                        f.seek(s)
                        data = f.read(e - s) if e is not None else f.read()
                    text = decompress(data)
                    rows = pages_of_chunk(text.decode("utf-8", "replace"))
                    if not text and data:
                        rows.append((None, None, None, None, "no stream"))
                except OSError as x:
                    rows.append((None, None, None, None, f"{type(x).__name__}: {x}"[:200]))
                if rows:
                    i, n, t, x, err = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows)), pa.array([s] * len(rows), pa.int64()), pa.array(i, pa.int64()), pa.array(n, pa.int32()), pa.array(t, pa.string()), pa.array(x, pa.string()), pa.array(err, pa.string())], names=["path", "start", "page_id", "ns", "title", "content", "error"])

    # a number of its own, as Spark would take a range for the few bytes of its row and put all in one task
    tasks = 8 * ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(tasks, "path", "start").mapInArrow(run, "path string, start long, page_id long, ns int, title string, content string, error string")


def dump_of_index(file: Column) -> Column:
    return F.regexp_replace(file, r"-index\.txt(\.bz2)?$", ".xml.bz2")


def extract_pages(terms: DataFrame, index: DataFrame, dump: str | None = None, *, eof: int | None = None) -> DataFrame:
    """(ordinal, title, found, page_id, content) of terms (ordinal, title): only the ranges that hold one are
    read, each once. Terms that repeat are each answered; of titles that the index repeats the last counts. Without
    a dump each index file's own, by its name."""
    path = F.lit(dump) if dump else dump_of_index(F.col("file"))
    index = index.withColumn("path", path)
    known = last_by(index.withColumn("__order", F.struct("path", "seq")), "title", "__order").select("title", "page_id", "offset", "path")
    tasks = by_size(terms, index)
    wanted = terms.repartition(tasks, "title").join(side(known, tasks, "title"), "title", "left")
    held = wanted.select("path", F.col("offset").alias("start")).distinct()
    ranges = index_chunks(index, eof, file="path").select("path", "start", "end").join(held.hint("merge"), ["path", "start"], "left_semi")
    pages = read_chunks(ranges).where("error IS NULL").select(F.col("path").alias("__p"), F.col("start").alias("__s"), F.col("title").alias("__t"), "content")
    out = wanted.join(side(pages, tasks, "__t"), (F.col("title") == F.col("__t")) & (F.col("path") == F.col("__p")) & (F.col("offset") == F.col("__s")), "left")
    text = F.coalesce("content", F.lit(""))
    return out.select("ordinal", "title", (text != "").alias("found"), "page_id", text.alias("content"))


_HEAD = b'<mediawiki><siteinfo><sitename>Test</sitename><dbname>testwiki</dbname><namespaces><namespace key="0" case="first-letter" /><namespace key="10" case="first-letter">Template</namespace></namespaces></siteinfo>\n'


def _page_xml(page_id: int, ns: int, title: str, text: str) -> str:
    return (
        f"  <page>\n    <title>{escape(title)}</title>\n    <ns>{ns}</ns>\n    <id>{page_id}</id>\n    <revision>\n      <id>{page_id + 1}</id>\n      <timestamp>2026-01-01T00:00:00Z</timestamp>\n"
        f"      <contributor><username>u</username></contributor>\n      <model>wikitext</model>\n      <format>text/x-wiki</format>\n      <text bytes=\"{len(text.encode())}\" xml:space=\"preserve\">{escape(text)}</text>\n    </revision>\n  </page>\n"
    )


def write_dump(pages: DataFrame, folder: str, *, per_stream: int = 100) -> DataFrame:
    """(dump, index, pages): each partition of pages (page_id, ns, title, content), in its order, as a multistream
    dump and its index in folder. Files appear whole or not at all, also if a task runs twice; the result should be
    written out, so that they are written once. Null texts are empty."""

    def run(batches):
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        stem = f"{base}/dump-{task.partitionId():05d}"
        names = {f"{stem}.xml.bz2": "", f"{stem}-index.txt.bz2": ""}
        for n in names:
            names[n] = f"{base}/.{n.rpartition('/')[2]}.{task.taskAttemptId()}.tmp"
        (dump, index), count, waiting, lines = names, 0, [], []
        with system.open_output_stream(names[dump], compression=None) as f:
            f.write(compress(_HEAD))

            def put():
                at = f.tell()
                f.write(compress("".join(_page_xml(*p) for p in waiting).encode()))
                lines.extend(f"{at}:{p[0]}:{p[2]}\n" for p in waiting)
                waiting.clear()

            for b in batches:
                for p in zip(*(b.column(c).to_pylist() for c in ("page_id", "ns", "title", "content")), strict=True):
                    waiting.append((*p[:3], p[3] or ""))
                    count += 1
                    if len(waiting) == per_stream:
                        put()
            if waiting:
                put()
            f.write(compress(b"</mediawiki>\n"))
        with system.open_output_stream(names[index], compression=None) as f:
            for i in range(0, len(lines), 100_000):
                f.write(compress("".join(lines[i : i + 100_000]).encode()))
        for n, t in names.items():
            system.move(t, n)
        if count:
            place = lambda n: folder.rstrip("/") + n[len(base) :]
            yield pa.RecordBatch.from_arrays([pa.array([place(dump)]), pa.array([place(index)]), pa.array([count], pa.int64())], names=["dump", "index", "pages"])

    return pages.select("page_id", "ns", "title", "content").mapInArrow(run, "dump string, index string, pages long")


def write_multistream(pages: list[tuple[int, int, str, str]], path: str, index_path: str, *, per_stream: int = 100) -> None:
    """A small dump with its index, for tests and examples: (page_id, ns, title, text)."""
    lines = []
    with open(path, "wb") as f:
        f.write(compress(_HEAD))
        for i in range(0, len(pages), per_stream):
            at = f.tell()
            some = pages[i : i + per_stream]
            lines += [f"{at}:{p[0]}:{p[2]}" for p in some]
            f.write(compress("".join(_page_xml(*p) for p in some).encode()))
        f.write(compress(b"</mediawiki>\n"))
    with open(index_path, "wb") as f:
        f.write(compress(("\n".join(lines) + "\n").encode()))
