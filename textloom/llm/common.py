"""What the operators of this package share: session settings, names, words as hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import cut, file_system, shared_dir, shared_path  # noqa: F401

U64 = np.uint64
#: Bytes that numpy works on at once; the temporaries are about 40 times this.
WINDOW = 1 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but for those named as a result column (case doesn't count): an operator's result
    replaces a column of the same name."""
    out = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in out]


def position(names: list[str], name: str) -> int:
    """Of the column called so; if none is, of one whose name differs in case only, as in Spark itself."""
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def release() -> None:
    """Gives memory that is free back to the system. Python workers outlive their tasks, and what they keep lies
    beside the executor's heap; called at a task's end."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits; in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_P = 0x9E3779B97F4A7C15 | 1
_IP = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, WINDOW + 1), base, U64)
        a[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(a)
    return have[:n]


_VALUE = np.zeros(256, U64)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _VALUE[_b] = (_b * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) % (1 << 64) | 1
_WORD = _VALUE > 0


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type not in (pa.string(), pa.large_string()):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int32 if texts.type == pa.string() else np.int64
    _, off, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and where each text's begin (one more entry than texts).

    A word is a longest run of ASCII letters, digits and non-ASCII characters of the lower-case text. Works
    through windows of WINDOW bytes, so that a long text needs no more memory than short ones of that size.
    """
    data, off = buffers(pc.utf8_lower(texts))
    n, at, starts, hashes = len(data), 0, [], []
    begins = np.unique(off[:-1])
    while at < n:
        end = min(n, at + WINDOW)
        if end < n:  # back to the last separator, or on to the next
            seps = np.flatnonzero(~_WORD[data[at:end]])
            if len(seps):
                end = at + int(seps[-1]) + 1
            else:
                while end < n and _WORD[data[end]]:
                    end += 1
        b = data[at:end]
        is_word = _WORD[b]
        first = is_word.copy()
        first[1:] &= ~is_word[:-1]
        own = begins[np.searchsorted(begins, at) : np.searchsorted(begins, end)] - at
        first[own] = is_word[own]
        pos = np.flatnonzero(first)
        if len(pos):
            v = _VALUE[b]
            v *= powers(_P, len(b))
            h = np.add.reduceat(v, pos)
            h *= powers(_IP, len(b))[pos]
            starts.append(pos + at)
            hashes.append(mix(h))
        at = end
    if not starts:
        return np.empty(0, U64), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off).astype(np.int64)


def selected_hashes(words: np.ndarray, offsets: tuple[int, ...], seed: int = 0) -> np.ndarray:
    """For each position i with i + max(offsets) inside words: a hash of words[i + o] for o in offsets."""
    n = len(words) - max(offsets)
    if n <= 0:
        return np.empty(0, U64)
    h = np.full(n, (seed * 0x9E3779B97F4A7C15 + 0x165667B19E3779F9) % (1 << 64), U64)
    for o in offsets:
        h *= U64(0x9FB21C651E98DF25)
        h += words[o : o + n]
        h ^= h >> U64(29)
    return mix(h)


def text_batches(batch: pa.RecordBatch, text: str, limit: int = 8 << 20):
    """Slices of the batch with about limit bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


#: Rows of ids up to which a table of them is broadcast (some 50 bytes each); a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def counted(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small, computed once into a reliable checkpoint and counted, with a broadcast hint if it has few rows."""
    small = cut(small)
    return F.broadcast(small) if small.count() <= limit else small


def row_key(docs: DataFrame, doc_id: str, text: str) -> tuple:
    """Columns that tell documents apart, though an id may repeat or be null: (id, hash of the text)."""
    return col(doc_id).cast("long"), F.xxhash64(col(text).cast("string"))


def keep_rows(docs: DataFrame, doc_id: str, text: str, gone: DataFrame, single: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose (id, hash of the text) is in gone, a table of distinct (doc_id, key) in which a
    null id stands for a null id; of rows in single, a table likewise, one of each stays."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no name of docs can clash
    own = row_key(plain, *(f"c{position(docs.columns, n)}" for n in (doc_id, text)))
    plain = plain.withColumns({"__id": own[0], "__key": own[1]})

    def names(small: DataFrame) -> DataFrame:
        return counted(small.select(F.col("doc_id").alias("__a"), F.col("key").alias("__b")))

    def same(small: DataFrame):
        return plain["__id"].eqNullSafe(small["__a"]) & (plain["__key"] == small["__b"])

    gone = names(gone)
    out = plain.join(gone, same(gone), "left_anti")
    if single is not None and (single := names(single)).count():
        # only rows that repeat are brought together, by id and key: salted would be of no use, as partial sums leave one a task
        some = out.join(single, out["__id"].eqNullSafe(single["__a"]) & (out["__key"] == single["__b"]), "left_semi")
        out = out.join(single, out["__id"].eqNullSafe(single["__a"]) & (out["__key"] == single["__b"]), "left_anti").unionByName(some.dropDuplicates(["__id", "__key"]))
    return out.drop("__id", "__key").toDF(*docs.columns)


def map_rows(df: DataFrame, run, extra: list[T.StructField]) -> DataFrame:
    """df through mapInArrow with all its columns, which run gets as c0, c1, ... whatever their names (mapInArrow
    itself can't take a name with a dot), and the columns in extra after them."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in plain.schema.fields), *extra])).toDF(*df.columns, *(f.name for f in extra))
