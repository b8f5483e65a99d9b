"""Sharding by jump consistent hashing.

A key's shard among n is computed from its hash alone, without a table: of the keys, 1 / n-th move when the n-th
shard is appended, all of them to it. The 64-bit hash is the first half of the key's MD5, which any system can
compute. Only the hash (not the row) goes to the Arrow function; all else stays in the JVM.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import U64, col, without

SHARDS, MORE = 64, 65


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, from 0 to shards - 1, of each 64-bit key."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    out = np.zeros(len(keys), np.int64)
    key, at, here = keys.astype(U64), np.arange(len(keys)), np.zeros(len(keys), np.float64)
    while len(at):
        out[at] = here.astype(np.int64)
        key = key * U64(2862933555777941757) + U64(1)
        here = np.floor((here + 1) * (float(1 << 31) / ((key >> U64(33)) + U64(1)).astype(np.float64)))
        go = here < shards
        key, at, here = key[go], at[go], here[go]
    return out


def key_hash(key: Column) -> Column:
    """The first 16 hexadecimal digits of the MD5 of the key's text."""
    return F.substring(F.md5(key.cast("string").cast("binary")), 1, 16)


def shard_of(key: Column, shards: int) -> Column:
    """The key's shard as int; null of a null key."""

    @pandas_udf("int")
    def run(h: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=h.index, dtype="Int32")
        own = h.notna().to_numpy()
        if own.any():
            raw = np.frombuffer(bytes.fromhex("".join(h[own])), ">u8")
            out[own] = jump(raw.astype(U64), shards).astype(np.int32)
        return out

    return run(key_hash(key))


def assign(df: DataFrame, key: str, shards: int = SHARDS, *, name: str = "shard") -> DataFrame:
    """df with the column name, the row's shard by its key (as text); no shuffle.

    A null key has a null shard; the empty text is a key like others. Rows with equal keys get the same shard.
    A column called name is replaced; others stay. An empty table gives no rows.
    """
    keep = without(df, name)
    return df.select(*(col(c) for c in keep), shard_of(col(key), shards).alias(name))


def reshard(df: DataFrame, key: str, before: int = SHARDS, after: int = MORE, *, clustered: bool = True, task_bytes: int | None = None) -> DataFrame:
    """df with shard (among before), new_shard (among after, which is no less) and moved. Rows that move go to
    appended shards only. If clustered, the rows of a new shard are brought together, ready to be written by
    shard: one shuffle, in which a shard has as many tasks as its share of the table's bytes needs, of some
    task_bytes each (default: as the input's splits). A shard's rows are dealt out to its tasks in turn, so that
    neither a large shard nor a key that many rows have makes a task large. Rows with a null key lie in tasks of
    their own. Rules as for ``assign``."""
    if after < before:
        raise ValueError("shards can only be appended")
    out = df.select(*(col(c) for c in without(df, "shard", "new_shard", "moved")), shard_of(col(key), before).alias("shard"), shard_of(col(key), after).alias("new_shard"))
    out = out.withColumn("moved", F.col("shard") != F.col("new_shard"))
    return _clustered(df, out, "new_shard", after, task_bytes) if clustered else out


def _clustered(df: DataFrame, out: DataFrame, shard: str, shards: int, task_bytes: int | None) -> DataFrame:
    """out, a table of df's size, in tasks of one shard each."""
    parts = max(1, min(math.ceil(size_of(df) / (task_bytes or split_bytes(df.sparkSession)) / shards), 1_000_000 // shards))
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(parts))
    return out.repartitionById((shards + 1) * parts, (F.coalesce(F.col(shard), F.lit(shards)) * parts + turn).cast("int"))


def size_of(df: DataFrame) -> int:
    """Bytes of df by the optimizer's estimate, which of files is their size; where it has none, measured in a pass."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 50:
        return size
    wide = [F.octet_length(col(f.name)) if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in df.schema.fields]
    return int(df.agg(F.sum(sum((F.coalesce(w, F.lit(0)).cast("long") for w in wide), F.lit(8)))).first()[0] or 0)


def split_bytes(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def write_shards(df: DataFrame, path: str, key: str, shards: int = SHARDS, *, task_bytes: int | None = None) -> None:
    """One folder ``shard=k`` a shard, as Parquet, with as many files as its size needs. Rules as for ``assign``;
    rows with a null key are in the folder of the null shard."""
    _clustered(df, assign(df, key, shards), "shard", shards, task_bytes).write.partitionBy("shard").parquet(path)


def brute_force(key, shards: int) -> int | None:
    """The published loop for one key, for tests."""
    import hashlib

    if key is None:
        return None
    k, b, j = int(hashlib.md5(str(key).encode()).hexdigest()[:16], 16), -1, 0
    while j < shards:
        b = j
        k = (k * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((k >> 33) + 1)))
    return b
