"""JSON, JSON Lines and text output."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.titles import safe_file_name
from ..operators.markup import spread, tasks_for
from .shared import file_system


def page_json(*, content: bool = True, pretty: bool = False, ascii_only: bool = False) -> Column:
    """A page row as a JSON object: id, title, namespace, redirect (null if none) and revisions."""
    revision = F.transform(
        "revisions",
        lambda r: F.struct(*(r[c].alias(c) for c in ("id", "parent_id", "timestamp", "contributor", "comment", "model", "format", *(("content",) if content else ()), "sha1"))),
    )
    row = F.struct(F.col("page_id").alias("id"), "title", F.col("ns").alias("namespace"), F.col("redirect_target").alias("redirect"), revision.alias("revisions"))
    return F.to_json(row, {"ignoreNullFields": "false", "pretty": str(pretty).lower(), "writeNonAsciiCharacterAsCodePoint": str(ascii_only).lower()})


def json_array(values: Column, order: Column | None = None) -> Column:
    """An aggregate: the JSON texts of a (small) group as an array, in the order of a column, else of the texts."""
    rows = F.array_sort(F.collect_list(F.struct((order if order is not None else values).alias("o"), values.alias("v"))))
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["v"]), ", "), F.lit("]"))


def write_json_lines(df: DataFrame, path: str, transform: Column | None = None) -> None:
    """One compact object a line: transform, or all columns."""
    (df.select(transform.alias("value")).write.text(path) if transform is not None else df.write.json(path))


def write_text(df: DataFrame, path: str, text: str = "text") -> None:
    df.select(text).write.text(path)


def write_page_files(df: DataFrame, folder: str, title: str = "title", content: str = "content", *, key: str | None = None) -> DataFrame:
    """(path, bytes): a file <title>.wiki for each page in folder, a path or URI that all executors see. Characters
    that file systems refuse become underscores; pages whose names are then the same, but for case, have the key
    (default: a hash of the title) behind it. Files appear whole; a null text is an empty file, a null title has
    none."""
    one = df.where(F.col(title).isNotNull()).select(safe_file_name(title).alias("name"), F.coalesce(F.col(content), F.lit("")).alias("text"), (F.col(key).cast("string") if key else F.hex(F.xxhash64(title))).alias("key"))
    one = one.withColumn("__n", F.lower("name")).repartition(tasks_for(df), "__n")
    many = F.count(F.lit(1)).over(Window.partitionBy("__n")) > 1
    named = one.select(F.when(many, F.concat("name", F.lit("."), "key")).otherwise(F.col("name")).alias("name"), "text")

    def run(batches):
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        for b in batches:
            names = b.column("name").to_pylist()
            sizes = []
            for n, t in zip(names, b.column("text").to_pylist(), strict=True):
                data, temporary = t.encode(), f"{base}/.{os.urandom(8).hex()}.tmp"
                with system.open_output_stream(temporary, compression=None) as f:
                    f.write(data)
                system.move(temporary, f"{base}/{n}.wiki")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{n}.wiki" for n in names], pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return named.mapInArrow(run, "path string, bytes long")


def read_page_files(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, value): whole files of UTF-8 text by their paths, as write_page_files gives them, read where the rows
    are: no folder is listed and no file is a task's share of its own. What isn't UTF-8 becomes U+FFFD; a path
    without a file is an error."""

    def run(batches):
        folders: dict = {}
        for b in batches:
            paths = b.column("path").to_pylist()
            for i in range(0, len(paths), 1000):
                some, texts = paths[i : i + 1000], []
                for p in some:
                    folder, _, name = p.rpartition("/")
                    if folder not in folders:
                        folders[folder] = file_system(folder)
                    system, base = folders[folder]
                    with system.open_input_stream(f"{base}/{name}", compression=None) as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(texts, pa.string())], names=["path", "value"])

    return spread(files.where(F.col(path).isNotNull()).select(F.col(path).alias("path"))).mapInArrow(run, "path string, value string")
