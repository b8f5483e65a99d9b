"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the schedule has the golden-ratio point frac(t * phi) in fixed point (31 bits, so exact everywhere);
the point goes through the cumulative target weights to a source. A source's slots are ranked: its r-th slot
takes the r-th of its blocks. Blocks hold an equal number of tokens: a source's documents are shuffled by a
keyed hash, laid end to end and cut each ``block_tokens``, within a document where need be. The schedule ends
with the slot by which each source has served all its blocks once; until then a source that is through begins
again (another epoch), so nothing is dropped.

Plan: texts are read once; (source, hash, id, hash of the text, tokens), rows that repeat as one with their number,
are written in the shared folder, and all else follows from that table. The position of a document is a running sum
in two steps, within hash ranges of some ``range_rows`` documents and over the ranges, so that a source that
holds most of the corpus doesn't end up in one task. Slots are ranked likewise. The driver holds a row a source.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, counted, position, release, shared_path

BLOCK_TOKENS, SEED = 65_536, "mix-1"
GOLDEN, ONE = 1327217885, 1 << 31  # 2**31 / 1.618...
RANGE_ROWS = 50_000


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")).cast("long")


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    """A 60-bit hash of seed and id, the order in which a source's documents come."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), doc_id.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def pieces(docs: DataFrame, *, doc_id: str, text: str, source: str, block_tokens: int, seed: str, range_rows: int) -> tuple[DataFrame, list[dict], DataFrame]:
    """(piece rows: source, block, doc_id, text_key, copy, token_from, token_to, offset; sources: name, tokens, blocks;
    the documents: source, doc_id, text_key, n, copies, ...). copy numbers rows that repeat source, id and text."""
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "lengths")
    own = F.coalesce(col(source).cast("string"), F.lit("")).alias("source"), col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text).cast("string")).alias("text_key"), tokens(col(text).cast("string")).alias("n")
    base = docs.select(*own).where("n > 0 AND doc_id IS NOT NULL").groupBy("source", "doc_id", "text_key", "n").agg(F.count("*").alias("copies"))
    base.withColumn("key", shuffle_key(F.col("doc_id"), seed)).write.parquet(path)
    base = spark.read.parquet(path)
    stats = base.groupBy("source").agg(F.sum(F.col("n") * F.col("copies")).alias("tokens"), F.count("*").alias("rows")).orderBy("source").collect()
    sources = [{"source": r["source"], "tokens": r["tokens"], "blocks": -(-r["tokens"] // block_tokens)} for r in stats]
    most = max((r["rows"] for r in stats), default=1)
    bits = max(0, math.ceil(math.log2(max(1, most / range_rows))))
    ranged = base.withColumn("range", F.shiftright("key", 60 - bits).cast("int") if bits else F.lit(0)).withColumn("all", F.col("n") * F.col("copies"))
    sums = ranged.groupBy("source", "range").agg(F.sum("all").alias("s"))
    before = sums.select("source", "range", (F.sum("s").over(Window.partitionBy("source").orderBy("range")) - F.col("s")).alias("before"))
    w = Window.partitionBy("source", "range").orderBy("key", "doc_id", "n", "text_key")
    laid = ranged.withColumn("own", F.sum("all").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")).join(before, ["source", "range"])
    laid = laid.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("before") + F.col("own") + F.col("copy") * F.col("n"))
    size = F.lit(block_tokens)
    cut = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n") - 1) / size))))
    out = cut.select(
        "source", F.col("block").cast("long").alias("block"), "doc_id", "text_key", "copy",
        F.greatest(F.lit(0), F.col("block") * size - F.col("start")).cast("long").alias("token_from"),
        F.least(F.col("n"), (F.col("block") + 1) * size - F.col("start")).cast("long").alias("token_to"),
        (F.col("start") + F.greatest(F.lit(0), F.col("block") * size - F.col("start")) - F.col("block") * size).cast("long").alias("offset"),
    )
    return out, sources, base


def weights_of(sources: list[dict], weights: dict[str, int] | None) -> list[int]:
    """Integer weights. None: tokens to the power of 3/4 (as sqrt(n) * sqrt(sqrt(n)), whole numbers)."""
    if weights is None:
        return [max(1, math.floor(math.sqrt(s["tokens"]) * math.sqrt(math.sqrt(s["tokens"])))) for s in sources]
    return [int(weights.get(s["source"], 0)) for s in sources]


def bounds(own: list[int]) -> list[int]:
    """Upper ends of the sources' shares of 2**31. Each source of weight above 0 has a width of 1 at least."""
    total, at, out = sum(own), 0, []
    for w in own:
        at += w
        out.append(max(at * ONE // total, (out[-1] if out else 0) + (w > 0)))
    end = ONE
    for i in reversed(range(len(own))):  # what the least widths have pushed beyond the end
        out[i] = min(out[i], end)
        end = out[i] - (own[i] > 0)
    return out


def last_slot(upper: list[int], blocks: list[int], step: int = 1 << 20) -> int:
    """The slot by which each source has had its blocks once. A narrow share's first point may come long after
    1 / share slots, so slots are counted, ``step`` at a time, rather than estimated."""
    left, at = np.array(blocks), 0
    while True:
        source = np.searchsorted(upper, np.arange(at, at + step) % ONE * GOLDEN % ONE, side="right")
        n = np.bincount(source, minlength=len(left))
        if (n >= left).all():
            return at + max(int(np.flatnonzero(source == j)[b - 1]) for j, b in enumerate(left) if b > 0)
        left, at = np.maximum(left - n, 0), at + step


def schedule(docs: DataFrame, sources: list[dict], own: list[int]) -> DataFrame:
    """(slot, source, blocks, rank), up to the slot by which each source (of weight above 0) has had its blocks once.

    Python workers stay for later stages, beside the executor's heap, so as few as possible are started: a task has
    one at most (a join's filter on a UDF's result would evaluate it twice, in two), and names come as Arrow, as a list
    of rows would be read by workers of another kind."""
    spark = docs.sparkSession
    live = [(s, w) for s, w in zip(sources, own, strict=True) if w > 0]
    if not live:
        return spark.range(0).selectExpr("id AS slot", "'' AS source", "id AS blocks", "id AS rank")
    upper = bounds([w for _, w in live])
    slots = last_slot(upper, [s["blocks"] for s, _ in live]) + 1
    names = pa.table([pa.array(range(len(live)), pa.int32()), pa.array([s["source"] for s, _ in live], pa.string()), pa.array([s["blocks"] for s, _ in live], pa.int64())], names=["number", "source", "blocks"])
    names = spark.createDataFrame(names)
    shared = spark.sparkContext.broadcast(np.array(upper))

    def pick(batches):
        for b in batches:
            point = b.column("slot").to_numpy() % ONE * GOLDEN % ONE
            yield pa.RecordBatch.from_arrays([b.column("slot"), pa.array(np.searchsorted(shared.value, point, side="right").astype(np.int32))], names=["slot", "number"])
        release()

    base = spark.range(slots).select(F.col("id").alias("slot")).mapInArrow(pick, "slot long, number int").withColumn("range", F.shiftright("slot", 16))
    sums = base.groupBy("number", "range").agg(F.count("*").alias("s"))
    before = sums.select("number", "range", (F.sum("s").over(Window.partitionBy("number").orderBy("range")) - F.col("s")).alias("before"))
    ranked = base.withColumn("own", F.row_number().over(Window.partitionBy("number", "range").orderBy("slot"))).join(before, ["number", "range"])
    return ranked.join(counted(names), "number").select("slot", "source", "blocks", (F.col("before") + F.col("own") - 1).alias("rank"))


_ROWS = "slot long, source string, epoch long, block long, offset long, doc_id long, token_from long, token_to long"


def _mix(docs: DataFrame, doc_id: str, text: str, source: str, weights: dict[str, int] | None, block_tokens: int, seed: str, range_rows: int) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``mix`` with text_key and copy, the documents)."""
    parts, sources, base = pieces(docs, doc_id=doc_id, text=text, source=source, block_tokens=block_tokens, seed=seed, range_rows=range_rows)
    plan = schedule(docs, sources, weights_of(sources, weights))
    plan = plan.select("slot", "source", F.floor(F.col("rank") / F.col("blocks")).cast("long").alias("epoch"), F.pmod("rank", "blocks").alias("block"))
    return parts.join(plan, ["source", "block"]), base


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: dict[str, int] | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(slot, source, epoch, block, offset, doc_id, token_from, token_to): the pieces of documents in each slot.

    token_from and token_to count words between white space; offset is the piece's place in its block. All
    blocks have block_tokens tokens but each source's last. weights: whole numbers by source (0, or a source
    that isn't named: left out); None: each source's tokens to the power of 3/4.

    A null source is the source ''. Rows with null id or without words (null, empty or blank text) have no
    tokens and no piece. Rows that repeat an id are documents of their own and come one after the other, the
    shorter first. Other columns, whatever their names, aren't read. An empty table gives no slots.
    """
    out, _ = _mix(docs, doc_id, text, source, weights, block_tokens, seed, range_rows)
    return out.select(*(x.strip().split(" ")[0] for x in _ROWS.split(",")))


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: dict[str, int] | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Whole documents in the order of the schedule: a row of docs comes once for each slot that has its first
    token, so documents of sources that go through several epochs repeat. Rows without words or id are not in
    any block and go. Rows are told apart by source, id and text; those that repeat all three come once each in
    every epoch. All columns stay. An empty table gives no rows."""
    pieces_, base = _mix(docs, doc_id, text, source, weights, block_tokens, seed, range_rows)
    order = pieces_.where("token_from = 0").select(F.col("source").alias("__s"), F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"), F.col("copy").alias("__c"), "slot", "offset")
    order = counted(order)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no name of docs can clash
    d, t, s = (F.col(f"c{position(docs.columns, n)}") for n in (doc_id, text, source))
    plain = plain.withColumns({"__source": F.coalesce(s.cast("string"), F.lit("")), "__id": d.cast("long"), "__text": F.xxhash64(t.cast("string"))}).where("__id IS NOT NULL")
    again = counted(base.where("copies > 1").select(F.col("source").alias("__ps"), F.col("doc_id").alias("__pd"), F.col("text_key").alias("__pt")))

    def repeats(kind: str) -> DataFrame:
        return plain.join(again, (F.col("__source") == F.col("__ps")) & (F.col("__id") == F.col("__pd")) & (F.col("__text") == F.col("__pt")), kind)

    def same(rows: DataFrame):
        return (rows["__source"] == order["__s"]) & (rows["__id"] == order["__d"]) & (rows["__text"] == order["__t"])

    names = [*plain.columns[: len(docs.columns)], "slot", "offset"]
    if again.count():
        single, rows = repeats("left_anti"), repeats("left_semi")
        # equal rows become one with their number before those of an id and text are numbered through
        rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
        to = F.sum("__n").over(Window.partitionBy("__source", "__id", "__text").orderBy(F.xxhash64(*plain.columns)).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("__to", to)
        both = single.join(order, same(single)).select(*names).unionByName(rows.join(order, same(rows) & (order["__c"] < rows["__to"]) & (order["__c"] >= rows["__to"] - rows["__n"])).select(*names))
    else:
        both = plain.join(order, same(plain)).select(*names)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = (order.agg(F.max("slot")).first()[0] or 0) + 1
    # the part of the schedule is computed, so that no sampling pass runs all this twice
    placed = both.repartitionById(parts, F.floor(F.col("slot") * parts / F.lit(slots)).cast("int"))
    return placed.sortWithinPartitions("slot", "offset").drop("slot", "offset").toDF(*docs.columns)


def brute_force(rows: list[tuple], weights: dict[str, int] | None, block_tokens: int, seed: str = SEED) -> set[tuple]:
    """mix()'s rows in plain Python from (doc_id, text, source), for tests."""
    import hashlib
    import re

    by: dict[str, list] = {}
    for d, t, s in rows:
        n = len(re.findall(r"[^ \t\n\r\f\x0b]+", t or ""))
        if n and d is not None:
            by.setdefault(s or "", []).append((int(hashlib.md5(f"{seed}:{d}".encode()).hexdigest()[:15], 16), d, n))
    sources = [{"source": s, "tokens": sum(x[2] for x in by[s])} for s in sorted(by)]
    for s in sources:
        s["blocks"] = -(-s["tokens"] // block_tokens)
    own = weights_of(sources, weights)
    live = [(s, w) for s, w in zip(sources, own, strict=True) if w > 0]
    if not live:
        return set()
    upper, done, t, slots = bounds([w for _, w in live]), {}, 0, []
    while any(done.get(s["source"], 0) < s["blocks"] for s, _ in live):
        point = t * GOLDEN % ONE
        s = next(s for (s, _), u in zip(live, upper, strict=True) if point < u)
        r = done.get(s["source"], 0)
        done[s["source"]] = r + 1
        slots.append((t, s["source"], r // s["blocks"], r % s["blocks"]))
        t += 1
    out = set()
    laid = {}
    for name, docs in by.items():
        at = 0
        for _, d, n in sorted(docs):
            for b in range(at // block_tokens, (at + n - 1) // block_tokens + 1):
                lo, hi = max(0, b * block_tokens - at), min(n, (b + 1) * block_tokens - at)
                laid.setdefault((name, b), []).append((at + lo - b * block_tokens, d, lo, hi))
            at += n
    for t, s, e, b in slots:
        out |= {(t, s, e, b, *x) for x in laid[s, b]}
    return out
