"""The index of a multistream dump: lines ``offset:page_id:title``, in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_index(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with offset, page_id and title, without malformed ones. Colons belong to the title from the third
    part on; a carriage return at the end goes."""
    line = F.regexp_replace(F.col(value), r"\r\z", "")
    part = F.split(line, ":", 3)
    digits = r"^[0-9]{1,18}$"
    ok = (F.size(part) == 3) & F.get(part, F.lit(0)).rlike(digits) & F.get(part, F.lit(1)).rlike(digits)
    return lines.where(ok).select(
        *[c for c in lines.columns if c != value], part[0].cast("long").alias("offset"), part[1].cast("long").alias("page_id"), part[2].alias("title")
    )


def find_by_title(index: DataFrame, title: str, seq: str = "seq") -> DataFrame:
    """Of lines that repeat a title the last."""
    return last_by(index.where(F.col("title") == title), "title", seq)


def find_by_id(index: DataFrame, page_id: int, seq: str = "seq") -> DataFrame:
    return last_by(index.where(F.col("page_id") == page_id), "page_id", seq)


def find_by_offset(index: DataFrame, offset: int) -> DataFrame:
    return index.where(F.col("offset") == offset)


def find_by_prefix(index: DataFrame, prefix: str) -> DataFrame:
    return index.where(F.startswith(F.col("title"), F.lit(prefix)))


def last_by(index: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """One row a key: the one that comes last."""
    row = F.max_by(F.struct(*index.columns), F.col(seq)).alias("r")
    return index.groupBy(F.col(key).alias("__key")).agg(row).select("r.*")


def unique_offsets(index: DataFrame) -> DataFrame:
    return index.select("offset").distinct().orderBy("offset")


#: Lines of an index that one task numbers.
RUN_LINES = 1_000_000


def chunks(index: DataFrame, eof: int | Column | None = None, *, file: str | None = None, seq: str = "seq", run_lines: int = RUN_LINES) -> DataFrame:
    """(start, end, entries) for each run of consecutive lines with one offset; the last ends at eof. With file, a
    column that names the file, runs are found in each file by itself, and it is the first column.

    Runs are numbered in two steps, within stretches of ``run_lines`` of seq and over these, so that a large file
    isn't a single task.
    """
    keys = [file] if file else []
    part = [*keys, "__part"]
    rows = index.withColumn("__part", F.floor(F.col(seq) / run_lines))
    w = Window.partitionBy(*part).orderBy(seq)
    over = Window.partitionBy(*keys).orderBy("__part")
    last = rows.groupBy(*part).agg(F.max_by("offset", seq).alias("__last")).withColumn("__before", F.lag("__last").over(over)).drop("__last")

    def to(x: DataFrame, y: DataFrame, *on: str) -> DataFrame:
        """x with what y has for it; a null file is a file."""
        y = y.select(*(F.col(k).alias("__r_" + k) for k in on), *(c for c in y.columns if c not in on))
        same = F.lit(True)
        for k in on:
            same &= F.col(k).eqNullSafe(F.col("__r_" + k))
        return x.join(y, same, "left").drop(*("__r_" + k for k in on))

    new = F.when(F.col("offset") == F.coalesce(F.lag("offset").over(w), F.col("__before")), 0).otherwise(1)
    runs = to(rows, last, *part).withColumn("__new", new)
    sums = runs.groupBy(*part).agg(F.sum("__new").alias("__s")).withColumn("__sum", F.sum("__s").over(over) - F.col("__s")).drop("__s")
    runs = to(runs, sums, *part).withColumn("__run", F.col("__sum") + F.sum("__new").over(w))
    out = runs.groupBy(*keys, "__run").agg(
        F.first("offset").alias("start"),
        F.transform(F.array_sort(F.collect_list(F.struct(seq, "page_id", "title"))), lambda e: F.struct(e["page_id"].alias("page_id"), e["title"].alias("title"))).alias("entries"),
    )
    after = out.select(*keys, (F.col("__run") - 1).alias("__run"), F.col("start").alias("__end"))
    end = F.coalesce(F.col("__end"), eof if isinstance(eof, Column) else F.lit(eof).cast("long"))
    return to(out, after, *keys, "__run").withColumn("end", end).select(*keys, "start", "end", "entries")


def chunk_of_title(chunked: DataFrame, title: str) -> DataFrame:
    return chunked.where(F.exists("entries", lambda e: e["title"] == title))


def by_size(*tables: DataFrame) -> int:
    """Partitions for a join of tables, so that a task's share stays the same as they grow: at least those of any
    shuffle, and one for each 2 MB that they are taken for, as files pack texts densely."""
    spark = tables[0].sparkSession
    sizes = (int(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for t in tables)
    size = sum(n for n in sizes if n < 1 << 50)  # what Spark can't tell is taken for far more
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size >> 21, 20_000))


def side(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """A side of a join by sorting, never broadcast: derived texts are far larger than Spark takes them for."""
    return df.repartition(tasks, *keys).hint("merge")


def coverage(terms: DataFrame, index: DataFrame) -> DataFrame:
    """The terms that the index has."""
    return _by_title(terms, index, "left_semi")


def missing(terms: DataFrame, index: DataFrame) -> DataFrame:
    return _by_title(terms, index, "left_anti")


def _by_title(terms: DataFrame, index: DataFrame, how: str) -> DataFrame:
    tasks = by_size(terms, index)
    return terms.repartition(tasks, "title").join(side(index.select("title"), tasks, "title"), "title", how)


def extract_pages(terms: DataFrame, index: DataFrame, pages: DataFrame) -> DataFrame:
    """(ordinal, title, found, page_id, content) for each requested term, also those that aren't there; a page
    with empty content counts as not found."""
    tasks = by_size(terms, index, pages)
    known = last_by(index, "title").select("title", "page_id")
    texts = pages.select(F.col("title").alias("__t"), "content")
    out = terms.repartition(tasks, "title").join(side(known, tasks, "title"), "title", "left").join(side(texts, tasks, "__t"), F.col("title") == F.col("__t"), "left")
    return out.select("ordinal", "title", (F.col("page_id").isNotNull() & (F.coalesce("content", F.lit("")) != "")).alias("found"), "page_id", F.coalesce("content", F.lit("")).alias("content"))
