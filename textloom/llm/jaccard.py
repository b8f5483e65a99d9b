"""N-gram Jaccard self-join by multiple-global-order filtering.

A document is the set of its word n-grams. If two sets have a Jaccard similarity of at least ``threshold``, then
under *any* total order of the n-grams the first l that they share lie within the first
``n - ceil(threshold * n) + l`` of either (the prefix). Each of several global orders gives such a filter, and a
pair is a candidate only if it passes all of them; only candidates are verified. Every filter is complete, so
the join is exact. Of the smaller set of a pair the first ``n - ceil(2 * threshold / (1 + threshold) * n) + l`` do,
as the two share at least the rest of that; in the index such entries are marked.

All orders place n-grams that are frequent in the corpus last (the level comes from a count sketch of the whole
corpus, of fixed size) and differ in how they order those of a level, which is fine in the first order and coarse
in the others, so that a passage that thousands of documents share doesn't make all of them candidates of each
other, and unrelated documents that meet under one order part under another.

Plan. Texts are shingled in numpy where they are read, three times, which is cheaper than to store the sets:
1. counts for the sketch; set hashes, by which equal sets become one; and min-hash bands. Sets that collide in a
   band are compared, by one-byte signatures, with one set of them, and those alike make up first groups. All
   pairs within a group are compared, so the filters have to find pairs across groups only: a thousand near
   copies don't meet again at each of the n-grams that they share.
2. entries of the prefix under the first order, 6 bytes each, of one document of each set, packed by hash range
   (``bucket``): one shuffle. In each bucket pairs of sets of different groups are counted, and summed up over the
   buckets.
3. only sets in groups or in pairs that the first filter leaves are shingled again and sent to units of bounded
   size: many small connected components are a unit; one with more than UNIT n-grams is divided into blocks by
   the sets' hash, and each two blocks are a unit. There a pair goes through the filters of the other orders,
   and those that all leave are verified. A unit gives a row a set (its links and the root of its class), not
   one a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import U64, col, counted, drop_path, keep_rows, mix, release, selected_hashes, shared_dir, shared_path, text_batches, word_hashes

NGRAM, THRESHOLD, ORDERS, SHARED = 3, 0.5, 3, 6
SKETCH_BITS = 22
PACK = "bucket int, tokens binary, docs binary, sets binary, sizes binary, groups binary"
BANDS, BAND_ROWS, BINS, ALIKE = 4, 2, 64, 0.45
BATCH = 4 << 20  # bytes of text shingled at once
UNIT = 500_000  # n-grams of a block of sets that are compared in one task


def shingles(words: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct n-gram hashes, sorted, and where each document's begin. A document with fewer
    than n words has one n-gram, all its words; one without words has none."""
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    g = selected_hashes(words, tuple(range(n)))
    ok = row[: len(g)] == row[n - 1 :] if len(g) else np.empty(0, bool)
    g, r = g[ok], row[: len(g)][ok]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        own = np.full(len(short), 0xA24BAED4963EE407, U64)
        for k in range(n - 1):
            has = size[short] > k
            own[has] = (own[has] * U64(0x9FB21C651E98DF25)) + words[off[short[has]] + k]
        g, r = np.concatenate([g, mix(own)]), np.concatenate([r, short])
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    g, r = g[keep], r[keep]
    return g, np.searchsorted(r, np.arange(len(size) + 1))


def set_hashes(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 of an empty one."""
    out = np.zeros(len(at) - 1, U64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(g ^ U64(0x51ED270B7F4A7C15)), at[full]) + np.diff(at)[full].astype(U64))
    return out


_KINDS = (np.uint8, np.uint16, np.uint32, np.uint64)


PARTS, WIDTH = 16, 1 << (SKETCH_BITS - 4)  # the sketch is handled in parts


def _packed(counts: np.ndarray) -> tuple[int, bytes]:
    """(bytes a count, compressed) in the smallest type that holds them."""
    own = counts.astype(next(t for t in _KINDS if counts.max() <= np.iinfo(t).max))
    return own.dtype.itemsize, pa.compress(own.tobytes(), "zstd", asbytes=True)


def _unpacked(size: int, data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, WIDTH * size, "zstd", asbytes=True), f"u{size}")


def _sketch(rows: DataFrame) -> list[np.ndarray]:
    """How often n-grams of each of 2**SKETCH_BITS hash classes occur, over all documents (equal ones too); in
    parts, each of the smallest type that holds it. rows: (part, bytes, counts) of tasks."""
    kind = "part int, bytes int, counts binary"

    def add(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH, np.int64)
        for t in groups:
            for size, x in zip(t.column("bytes").to_pylist(), t.column("counts").to_pylist(), strict=True):
                total += _unpacked(size, x).astype(np.int64)
        size, data = _packed(total)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([size], pa.int32()), pa.array([data], pa.binary())], names=["part", "bytes", "counts"])

    out = {r["part"]: _unpacked(r["bytes"], r["counts"]) for r in rows.groupBy("part").applyInArrow(add, kind).collect()}
    return [out.get(k, np.zeros(WIDTH, np.uint8)) for k in range(PARTS)]


def _levels(counts: list[np.ndarray]) -> np.ndarray:
    """0 to 63 by the count of a hash class: steps of an eighth of the standard deviation that unrelated n-grams
    give around the mean, from three below it to three above, then of half a doubling. An n-gram that occurs f
    times is in a class with f at least, so those of a class with few come first."""
    mean = sum(int(c.sum(dtype=np.uint64)) for c in counts) / sum(map(len, counts))
    unit = math.sqrt(max(mean, 1e-9))
    top = mean + 3 * unit

    def of(c: np.ndarray) -> np.ndarray:
        kinds, at = np.unique(c, return_inverse=True)
        x = kinds.astype(np.float64)
        low = np.clip(np.floor(24 + 8 * (x - mean) / unit), 0, 47)
        return np.where(x <= top, low, np.minimum(48 + np.floor(2 * np.log2(np.maximum(x / top, 1))), 63)).astype(np.uint8)[at]

    return np.concatenate([of(c) for c in counts])


def _shared_by_smaller(size: np.ndarray, threshold: float) -> np.ndarray:
    """How many n-grams a set shares at least with a larger one that is similar."""
    return np.ceil(2 * threshold / (1 + threshold) * size - 1e-9).astype(np.int64)


def prefix_flags(g: np.ndarray, at: np.ndarray, level: np.ndarray, threshold: float, orders: range, shared: int) -> np.ndarray:
    """Bit k of an entry: it is in its document's prefix under order k; bit 7: in the shorter one of the first order
    that does for the smaller set of a pair."""
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    need = np.ceil(threshold * size - 1e-9).astype(np.int64)
    length = size - need + np.minimum(need, shared)
    rank = np.arange(len(g)) - np.repeat(at[:-1], size)
    inside = rank < np.repeat(length, size)
    own = level[(g >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(U64)
    flags = np.zeros(len(g), np.uint8)
    for k in orders:
        h = mix(g ^ U64((k + 1) * 0x8CB92BA72F3D8DD7 % (1 << 64)))
        fine = own if k == 0 else own >> U64(3) << U64(3)
        order = np.lexsort((fine << U64(58) | (h >> U64(6)), row))
        flags[order[inside]] |= np.uint8(1 << k)
        if k == 0:
            least = _shared_by_smaller(size, threshold)
            flags[order[rank < np.repeat(size - least + np.minimum(least, shared), size)]] |= np.uint8(128)
    return flags


def _pairs_of(tokens: np.ndarray, group: np.ndarray, doc: np.ndarray, chunk: int = 1 << 20, size: np.ndarray | None = None, marked: np.ndarray | None = None):
    """Pairs of entries with equal tokens and unequal groups, and how many tokens they share. Entries come sorted
    by (token, group, doc). Yields keys (a << 32 | b, a < b) and counts: partial sums. With size and marked only
    pairs in which the entry of the smaller document (of equal ones, the first) is marked."""
    n = len(tokens)
    new = np.ones(n, bool)
    new[1:] = tokens[1:] != tokens[:-1]
    other = new.copy()
    other[1:] |= group[1:] != group[:-1]

    def ends(first):
        at = np.flatnonzero(first)
        return np.repeat(np.append(at[1:], n), np.diff(np.append(at, n)))

    begin = ends(other)
    left = ends(new) - begin  # partners of each entry: those of its token in later groups
    keep = np.flatnonzero(left)
    total = np.cumsum(left[keep])
    at, keys, counts = 0, [], []
    held = 0
    while at < len(keep):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, side="right")))
        i = keep[at:stop]
        m = left[i]
        x = np.repeat(i, m)
        y = np.repeat(begin[i], m) + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
        if marked is not None:
            first = (size[doc[x]] < size[doc[y]]) | ((size[doc[x]] == size[doc[y]]) & (doc[x] < doc[y]))
            own = np.where(first, marked[x], marked[y])
            x, y = x[own], y[own]
        x, y = doc[x], doc[y]
        key, count = np.unique((np.minimum(x, y) << 32) | np.maximum(x, y), return_counts=True)
        keys.append(key)
        counts.append(count)
        held += len(key)
        at = stop
        if held > 1 << 20 or at >= len(keep):
            key, inv = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(inv, np.concatenate(counts)).astype(np.int32)
            keys, counts, held = [key], [sums], len(key)
            if held > 1 << 19 or at >= len(keep):
                yield key, sums
                keys, counts, held = [], [], 0


def candidates(docs: DataFrame, level, total: int, *, n: int, threshold: float, shared: int) -> DataFrame:
    """(a, b): set hashes (as long) of pairs across groups that pass the filter of the first order.
    docs: (text, component), the group or null of a set that has none; level: broadcast; total: n-grams in all.

    In a bucket an n-gram is known by 31 bits and the bucket; the last bit marks the shorter prefix. Two n-grams of a set that agree there are two
    entries, so a pair is counted at least as often as it shares n-grams, and none is lost."""
    buckets = max(4, math.ceil(total / 3_000_000))

    def pack(batches):
        for whole in batches:
            for b in text_batches(whole, "text", BATCH):
                g, at = shingles(*word_hashes(b.column("text")), n)
                s = set_hashes(g, at)
                c = b.column("component")
                c = np.where(c.is_valid().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy(zero_copy_only=False), s.view(np.int64))
                _, one = np.unique(s, return_index=True)  # equal sets of a batch: once
                one = np.zeros(len(s), bool) | np.isin(np.arange(len(s)), one)
                size = np.diff(at)
                pick = np.repeat(one, size)
                g, size, s, c = g[pick], size[one], s[one], c[one]
                at = np.concatenate([[0], np.cumsum(size)])
                f = prefix_flags(g, at, level.value, threshold, range(1), shared)
                row = np.repeat(np.arange(len(size)), size)
                in_any = f > 0
                mark = (f[in_any] >> 7).astype(U64)
                g, row = g[in_any], row[in_any]
                own = ((g >> U64(32)) * U64(buckets)) >> U64(32)
                order = np.argsort(own, kind="stable")
                g, row, own = (g << U64(1) | mark)[order].astype(np.uint32), row[order], own[order]
                cut = np.searchsorted(own, np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cut)):
                    part = slice(cut[k], cut[k + 1])
                    have, local = np.unique(row[part], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (g[part], local.astype(np.uint32 if len(have) > 65535 else np.uint16), s[have], size[have].astype(np.int32), c[have]))], names=["bucket", "tokens", "docs", "sets", "sizes", "groups"])
        release()

    def count(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sets, known, sizes, groups_of = [], [], [], [], []
        for t in groups:
            for r in range(t.num_rows):
                part = {k: np.frombuffer(t.column(k)[r].as_buffer(), d) for k, d in (("tokens", np.uint32), ("sets", U64), ("sizes", np.int32), ("groups", np.int64))}
                tokens.append(part["tokens"])
                sets.append(np.frombuffer(t.column("docs")[r].as_buffer(), np.uint16 if len(part["sets"]) <= 65535 else np.uint32).astype(np.int32) + sum(map(len, known)))
                known.append(part["sets"])
                sizes.append(part["sizes"])
                groups_of.append(part["groups"])
        u, first, place = np.unique(np.concatenate(known), return_index=True, return_inverse=True)
        size = np.concatenate(sizes)[first]
        _, label = np.unique(np.concatenate(groups_of)[first], return_inverse=True)
        # documents numbered by (group, set), so that one sort brings both together
        rank = np.empty(len(u), np.int64)
        rank[np.lexsort((u, label))] = np.arange(len(u))
        u, size, label = u[np.argsort(rank)], size[np.argsort(rank)], label[np.argsort(rank)]
        member = np.concatenate(sets)
        once = np.zeros(len(place), bool)
        once[first] = True  # a set that came several times: the entries of one
        keep = once[member]
        t = np.concatenate(tokens)[keep].astype(np.uint64)  # into one number: token, document, mark
        order = (t >> U64(1) << U64(33)) | (rank[place][member[keep]].astype(np.uint64) << U64(1)) | (t & U64(1))
        del sets, tokens, member, keep, t
        order.sort()
        t, doc, marked = (order >> U64(33)).astype(np.uint32), (order >> U64(1) & U64(0xFFFFFFFF)).astype(np.int64), (order & U64(1)).astype(bool)
        del order
        for keys, counts in _pairs_of(t, label[doc], doc, size=size, marked=marked):
            a, b = keys >> 32, keys & 0xFFFFFFFF
            small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            fits = small >= np.ceil(threshold * large - 1e-9)  # else even one within the other is too small
            a, b, counts, small = a[fits], b[fits], counts[fits], small[fits]
            # need is of the pair, so that partial rows of all buckets agree
            large = large[fits]
            first, other = _shared_by_smaller(small, threshold), np.ceil(threshold * large - 1e-9).astype(np.int64)
            # of what a similar pair shares, all but what lies beyond one of the two prefixes
            all_ = np.ceil(threshold / (1 + threshold) * (small + large) - 1e-9).astype(np.int64)
            need = np.maximum(np.minimum(np.minimum(first, other), shared), all_ - np.maximum(first - np.minimum(first, shared), other - np.minimum(other, shared))).astype(np.int32)
            x, y = u[a].view(np.int64), u[b].view(np.int64)
            x, y = np.minimum(x, y), np.maximum(x, y)
            for i in range(0, len(a), 200_000):
                s = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[s]), pa.array(y[s]), pa.array(need[s], pa.int32()), pa.array(counts[s], pa.int32())], names=["a", "b", "need", "n"])
        del t, doc, marked, u, size, label
        release()

    partial = docs.select("text", "component").mapInArrow(pack, PACK).groupBy("bucket").applyInArrow(count, "a long, b long, need int, n int")
    return partial.groupBy("a", "b").agg(F.first("need").alias("need"), F.sum("n").alias("n")).where("n >= need").select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of the graph with edges (a, b), by alternating large-star and small-star steps; the
    component is its least node. Each round is cut off from its lineage by a reliable checkpoint."""
    shared_dir(pairs.sparkSession)
    edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(low, "u")
        edges = step.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v"), F.col("v")).distinct())


_BANDS = [f"b{k}" for k in range(BANDS)]


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, set_hash, grams, b0, b1, ..., signature) of documents with words; grams: how many; b: BANDS
    hashes of BAND_ROWS min-hashes each; signature: a byte of the least hash in each of BINS ranges, 0 where there
    is none. Rows with a null set_hash are parts of a task's sketch: (key: part, grams: bytes, signature: counts)."""
    names = ["doc_id", "key", "set_hash", "grams", *_BANDS, "signature"]

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for whole in batches:
            for b in text_batches(whole, "text", BATCH):
                g, at = shingles(*word_hashes(b.column("text")), n)
                kinds, times = np.unique((g >> U64(64 - SKETCH_BITS)).astype(np.uint32), return_counts=True)
                total[kinds] += times.astype(np.uint32)
                s = set_hashes(g, at)
                full = np.flatnonzero(np.diff(at))
                bands = np.zeros((BANDS, len(full)), U64)
                for k in range(BANDS * BAND_ROWS if len(full) else 0):
                    low = np.minimum.reduceat(mix(g ^ U64((k + 17) * 0xC2B2AE3D27D4EB4F % (1 << 64))), at[full])
                    bands[k // BAND_ROWS] = mix(bands[k // BAND_ROWS] * U64(0x9FB21C651E98DF25) + low)
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                cell = row * BINS + (g >> U64(64 - int(math.log2(BINS)))).astype(np.int64)
                first = np.flatnonzero(np.diff(cell, prepend=-1))
                marks = np.zeros((len(at) - 1) * BINS, np.uint8)
                marks[cell[first]] = 1 + (mix(g[first].copy()) % U64(255)).astype(np.uint8)
                marks = marks.reshape(-1, BINS)[full]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(full)) for c in ("doc_id", "key")), pa.array(s[full].view(np.int64)), pa.array(np.diff(at)[full].astype(np.int32)), *(pa.array(x.view(np.int64)) for x in bands), pa.array([m.tobytes() for m in marks], pa.binary())], names=names)
        for k in range(PARTS if total.any() else 0):
            size, data = _packed(total[k * WIDTH : (k + 1) * WIDTH])
            none = pa.array([None], pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array([k], pa.int64()), none, pa.array([size], pa.int32()), *[none] * BANDS, pa.array([data], pa.binary())], names=names)
        del total
        release()

    return docs.mapInArrow(run, f"doc_id long, key long, set_hash long, grams int, {', '.join(b + ' long' for b in _BANDS)}, signature binary")


@pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether signatures agree in a share ALIKE of the ranges that either has."""
    if not len(a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series(((x == y) & (x > 0)).sum(1) >= ALIKE * ((x > 0) | (y > 0)).sum(1))


def _partners(group: np.ndarray, block: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """From where to where the partners within its group of each set lie; sets are sorted by (group, block), -1 is
    no group. In a unit of two blocks partners are in the other one."""
    n = len(group)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    own = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    if i == j:
        lo, hi = np.arange(1, n + 1), end[own]
    else:
        middle = begin + np.bincount(own, block == i, len(begin)).astype(np.int64)
        lo, hi = middle[own], np.where(block == i, end[own], middle[own])
    return np.where(group < 0, 0, lo), np.where(group < 0, 0, hi)


def _verify(level, threshold: float, orders: int, shared: int, emit: str):
    """Of a unit's pairs (those of one group, and those given) the ones that pass the filters and have the
    similarity. emit: 'links' gives each set's links, in documents, and the least set that it is connected with;
    'pairs' the pairs."""

    def run(key, pairs: pa.Table, sets: pa.Table) -> pa.Table:
        names, one = np.unique(sets.column("set_hash").to_numpy(), return_index=True)  # rows that repeat: once
        sets = sets.take(pa.array(one))
        label = sets.column("component")
        known = label.is_valid().to_numpy()
        group = np.full(len(names), -1)
        group[known] = np.unique(label.fill_null(0).to_numpy()[known], return_inverse=True)[1]
        block = sets.column("block").to_numpy()
        by = np.lexsort((names, block, group))
        names, group, block, sets = names[by], group[by], block[by], sets.take(pa.array(by))
        weight = sets.column("copies").to_numpy()
        own = [np.frombuffer(x.as_buffer(), U64) for x in sets.column("grams")]
        size = np.array([len(x) for x in own], np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        grams = np.concatenate([*own, np.empty(0, U64)])
        del own
        every = 1 << orders
        bits = prefix_flags(grams, at, level.value, threshold, range(orders), shared) & np.uint8(every - 1) | np.uint8(every)
        vocabulary, ids = np.unique(grams, return_inverse=True)
        vocabulary, ids = len(vocabulary), ids.astype(np.int32)
        del grams
        need = np.minimum(np.ceil(threshold * size - 1e-9), shared)
        lo, hi = _partners(group, block, key[1].as_py(), key[2].as_py())
        a, b = (np.searchsorted(names[(o := np.argsort(names))], pairs.column(c).to_numpy()) for c in ("a", "b"))
        a, b = o[a], o[b]
        o = np.argsort(a, kind="stable")
        a, b = a[o], b[o]
        cut = np.searchsorted(a, np.arange(len(names) + 1))
        flag, links, root = np.zeros(vocabulary, np.uint8), np.zeros(len(names), np.int64), np.arange(len(names))
        found: list[tuple] = []
        for x in np.flatnonzero((hi > lo) | (np.diff(cut) > 0)).tolist():
            flag[ids[at[x] : at[x + 1]]] = bits[at[x] : at[x + 1]]
            partners = np.concatenate([np.arange(lo[x], hi[x]), b[cut[x] : cut[x + 1]]])
            partners = partners[np.minimum(size[x], size[partners]) >= threshold * np.maximum(size[x], size[partners]) - 1e-9]
            total, step = np.cumsum(size[partners]), 0
            while step < len(partners):  # a few million entries at a time
                stop = max(step + 1, int(np.searchsorted(total, (total[step - 1] if step else 0) + UNIT, side="right")))
                p = partners[step:stop]
                step = stop
                first = np.cumsum(size[p]) - size[p]
                entry = np.arange(size[p].sum()) + np.repeat(at[p] - first, size[p])
                both = flag[ids[entry]] & bits[entry]
                least = np.minimum(need[x], need[p])
                ok = np.ones(len(p), bool)
                for k in range(orders):
                    ok &= np.add.reduceat(both >> k & 1, first, dtype=np.int32) >= least
                p, common = p[ok], np.add.reduceat(both >> orders, first, dtype=np.int64)[ok]
                near = common >= threshold * (size[x] + size[p] - common)
                p, common = p[near], common[near]
                if not len(p):
                    continue
                if emit == "pairs":
                    found.append((np.minimum(names[x], names[p]), np.maximum(names[x], names[p]), common / (size[x] + size[p] - common)))
                    continue
                links[x] += weight[p].sum()
                links[p] += weight[x]
                joined = np.unique(np.append(root[p], root[x]))
                if len(joined) > 1:
                    to = np.arange(len(names))
                    to[joined] = joined[0]
                    root = to[root]
            flag[ids[at[x] : at[x + 1]]] = 0
        if emit == "pairs":
            return pa.table([np.concatenate(c) if found else np.empty(0, t) for c, t in zip(list(zip(*found, strict=True)) or [()] * 3, (np.int64, np.int64, np.float64), strict=True)], names=["a", "b", "jaccard"])
        lowest = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(lowest, root, names)
        own = np.flatnonzero(links)
        del flag, bits, ids
        release()
        return pa.table([names[own], links[own], lowest[root[own]], np.full(len(own), key[1].as_py() >= 0)], names=["set_hash", "links", "root", "parted"])

    return run


_EMIT = {"links": "set_hash long, links long, root long, parted boolean", "pairs": "a long, b long, jaccard double"}


def similar_sets(docs: DataFrame, *, n: int, threshold: float, orders: int, shared: int, emit: str = "links", unit: int = UNIT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, set_hash) of all documents with words, and by emit either (set_hash, links, root) of the sets
    that have a link, root being the same for all sets that are connected, or verified (a, b, jaccard) of sets."""
    spark = docs.sparkSession
    made = [shared_path(spark, x) for x in ("sets", "candidates", "similar")]
    _sets(docs, n).write.parquet(made[0])
    table = spark.read.parquet(made[0])
    sets = table.where("set_hash IS NOT NULL")
    counts = _sketch(table.where("set_hash IS NULL").select(F.col("key").cast("int").alias("part"), F.col("grams").alias("bytes"), F.col("signature").alias("counts")))
    level, total = spark.sparkContext.broadcast(_levels(counts)), sum(int(c.sum(dtype=np.uint64)) for c in counts)
    del counts

    one = sets.groupBy("set_hash").agg(F.first("grams").alias("grams"), *(F.first(b).alias(b) for b in _BANDS))  # all rows of a set have the same
    band = one.select("set_hash", F.posexplode(F.array(*_BANDS)).alias("k", "band"))
    hub = band.groupBy("k", "band").agg(F.min("set_hash").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    near = band.join(hub, ["k", "band"]).select(F.col("set_hash").alias("b"), "a").where("a <> b").distinct()
    marks = near.select("a").union(near.select("b")).distinct().join(sets.select("set_hash", "signature"), F.col("a") == F.col("set_hash")).groupBy("set_hash").agg(F.first("signature").alias("s"))
    both = near.join(marks.select(F.col("set_hash").alias("a"), F.col("s").alias("x")), "a").join(marks.select(F.col("set_hash").alias("b"), F.col("s").alias("y")), "b")
    groups = components(both.where(_alike("x", "y")).select("a", "b")).withColumnRenamed("node", "set_hash")

    # a set's document: the least (doc_id, key); others of the set, and its group, are known by the text's key
    member = sets.groupBy("set_hash").agg(F.min(F.struct("doc_id", "key")).alias("d"), F.countDistinct("doc_id").alias("copies"), F.count("*").alias("rows"), F.first("grams").alias("grams"))
    own = member.where("rows > 1").select("set_hash", "d").join(groups, "set_hash", "full").select("set_hash", "component", "d")
    label = counted(sets.select("key", "set_hash").distinct().join(own, "set_hash").select(F.col("key").alias("__key"), "component", F.col("d.doc_id").alias("__doc"), F.col("d.key").alias("__text")))
    packed = docs.join(label, docs["key"] == label["__key"], "left").where("__doc IS NULL OR (__doc = doc_id AND __text = key)")
    candidates(packed.select("text", "component"), level, total, n=n, threshold=threshold, shared=shared).write.parquet(made[1])
    pairs = spark.read.parquet(made[1])

    linked = components(pairs.union(groups.select("set_hash", "component"))).select(F.col("node").alias("set_hash"), F.col("component").alias("graph"))
    first = linked.join(member, "set_hash").join(groups, "set_hash", "left")
    sizes = first.groupBy("graph").agg(F.sum("grams").cast("long").alias("all")).checkpoint()
    most = sizes.agg(F.sum(F.when(F.col("all") <= unit, F.col("all"))).alias("small"), F.count_if(F.col("all") > unit).alias("parted")).first()
    packs = max(1, math.ceil((most["small"] or 0) / unit))
    blocks = sizes.where(F.col("all") > unit).select("graph", F.ceil(F.col("all") / unit).cast("int").alias("blocks"))
    blocks = counted(blocks)
    unit_of = F.coalesce(F.when(F.col("blocks").isNotNull(), F.col("graph")), F.pmod(F.xxhash64("graph"), F.lit(packs)))

    def block_of(name: str):
        return F.coalesce(F.pmod(F.xxhash64(name), F.col("blocks")).cast("int"), F.lit(-1))

    placed = first.join(blocks, "graph", "left").select(F.col("d.doc_id").alias("__doc"), F.col("d.key").alias("__key"), "set_hash", "component", "copies", unit_of.alias("unit"), "blocks", block_of("set_hash").alias("block"))
    placed = counted(placed)
    wanted = docs.join(placed, (docs["doc_id"] == placed["__doc"]) & (docs["key"] == placed["__key"]))
    names = ["unit", "blocks", "block", "component", "copies", "set_hash"]

    def grams(batches):
        for whole in batches:
            for b in text_batches(whole, "text", BATCH):
                g, at = shingles(*word_hashes(b.column("text")), n)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([g[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], names=[*names, "grams"])
        release()

    blobs = wanted.select("text", *names).mapInArrow(grams, "unit long, blocks int, block int, component long, copies long, set_hash long, grams binary")
    blobs = blobs.withColumn("other", F.explode(F.when(F.col("block") >= 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(-1)))))
    blobs = blobs.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    sides = pairs.join(linked.withColumnRenamed("set_hash", "a"), "a").join(blocks, "graph", "left").withColumns({"x": block_of("a"), "y": block_of("b"), "unit": unit_of})
    sides = sides.select("unit", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "a", "b")
    at = ["unit", "i", "j"]
    sides.groupBy(*at).cogroup(blobs.groupBy(*at)).applyInArrow(_verify(level, threshold, orders, shared, emit), _EMIT[emit]).write.parquet(made[2])
    drop_path(spark, made[1])
    out = spark.read.parquet(made[2])
    if emit == "links":
        whole = out.groupBy("set_hash").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
        if most["parted"]:  # classes go on over units
            joined = components(out.where("parted").select(F.col("set_hash").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("set_hash"), "component")
            whole = whole.join(joined, "set_hash", "left").select("set_hash", "links", F.coalesce("component", "root").alias("root"))
        out = whole
    return sets.select("doc_id", "key", "set_hash"), out


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, key): key stands for the text, so that rows that repeat an id with other texts keep apart."""
    docs = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("key", F.xxhash64("text"))


def jaccard_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, orders: int = ORDERS, shared: int = SHARED, unit: int = UNIT) -> DataFrame:
    """(doc_id, class_id, links), a row a document: the least id of all documents that it is connected with through
    similar ones, and how many documents are similar to it, copies included.

    All pairs at or above the threshold count, none is left out; there is a row a document rather than a pair, as
    thousands of near copies have millions of pairs. A document without any has its own id and 0 links.

    A row with null id, null text or a text without words has no row. Rows that repeat an id are one document if
    their n-grams agree; an id with different ones is a document of each. Other columns, whatever their names, are
    not read. An empty table gives an empty result. Ties don't arise.
    """
    sets, similar = similar_sets(_plain(docs, doc_id, text), n=n, threshold=threshold, orders=orders, shared=shared, unit=unit)
    sets = sets.select("doc_id", "set_hash").distinct()
    one = sets.groupBy("set_hash").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).join(similar, "set_hash", "left")
    one = one.select("set_hash", "least", F.coalesce("root", "set_hash").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    wide = one.where("root <> set_hash").select("root").distinct()  # roots of several sets
    low = one.join(wide, "root", "left_semi").groupBy("root").agg(F.min("least").alias("class_id"))
    one = one.join(low, "root", "left").select("set_hash", F.coalesce("class_id", "least").alias("class_id"), "links")
    return sets.join(one, "set_hash").select("doc_id", "class_id", "links")


def jaccard_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, orders: int = ORDERS, shared: int = SHARED, unit: int = UNIT) -> DataFrame:
    """(doc_a, doc_b, jaccard) with doc_a < doc_b: the pairs behind ``jaccard_groups``, between representatives.

    Documents with equal n-gram sets are represented by the least doc_id: each other one is paired with it, at
    1.0, and only it is paired with documents of other sets. So a set of k copies gives k - 1 rows instead of
    k * (k - 1) / 2 and the groups stay the same. The rows grow with the square of a group of near copies: for
    large tables take ``jaccard_groups``. Rules for nulls and so on as there.
    """
    sets, pairs = similar_sets(_plain(docs, doc_id, text), n=n, threshold=threshold, orders=orders, shared=shared, emit="pairs", unit=unit)
    rep = sets.groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    copies = sets.join(rep, "set_hash").where("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard")).distinct()
    near = pairs.join(rep.select(F.col("set_hash").alias("a"), F.col("rep").alias("x")), "a").join(rep.select(F.col("set_hash").alias("b"), F.col("rep").alias("y")), "b")
    near = near.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    return copies.union(near).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, orders: int = ORDERS, shared: int = SHARED) -> DataFrame:
    """docs with one row of each class of ``jaccard_groups``: of the least id (of several texts under it, that of
    the least hash; of rows that repeat both, one). All columns stay; rows without a partner stay, also those with
    null id or null or wordless text. An id's rows go by their text: another text under the id of a row that goes
    stays."""
    sets, similar = similar_sets(_plain(docs, doc_id, text), n=n, threshold=threshold, orders=orders, shared=shared)
    member = sets.groupBy("set_hash", "doc_id", "key").agg(F.count("*").alias("rows"))
    one = member.groupBy("set_hash").agg(F.min(F.struct("doc_id", "key")).alias("d"), F.count("*").alias("texts"), F.max("rows").alias("rows")).join(similar, "set_hash", "left")
    root = F.coalesce("root", "set_hash").alias("root")
    first = one.where("root IS NOT NULL").groupBy(root).agg(F.min("d").alias("keep"))
    one = one.where("texts > 1 OR rows > 1 OR root IS NOT NULL").select("set_hash", "d", root).join(first, "root", "left").select("set_hash", F.coalesce("keep", "d").alias("keep"))
    kept = (F.col("keep.doc_id") == F.col("doc_id")) & (F.col("keep.key") == F.col("key"))
    rest = member.join(one, "set_hash").select("doc_id", "key", "rows", kept.alias("kept"))
    return keep_rows(docs, doc_id, text, rest.where("NOT kept").select("doc_id", "key"), rest.where("kept AND rows > 1").select("doc_id", "key"))


def brute_force(docs: list[tuple], n: int = NGRAM, threshold: float = THRESHOLD) -> set[tuple]:
    """jaccard_join's rows in plain Python, for tests."""
    import re

    by_set: dict[frozenset, set] = {}
    out = set()
    for doc, text in docs:
        if doc is None or text is None:
            continue
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
        if w:
            by_set.setdefault(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))), set()).add(doc)
    reps = [(min(v), k) for k, v in by_set.items()]
    for v in by_set.values():
        out |= {(min(v), x, 1.0) for x in v if x != min(v)}
    for i, (a, x) in enumerate(reps):
        for b, y in reps[:i]:
            j = len(x & y) / len(x | y)
            if j >= threshold and a != b:
                out.add((min(a, b), max(a, b), j))
    return out


def brute_force_groups(docs: list[tuple], n: int = NGRAM, threshold: float = THRESHOLD) -> list[tuple]:
    """jaccard_groups' rows in plain Python, by comparing all documents, for tests."""
    import re

    nodes = []
    for doc, text in docs:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower()) if doc is not None else []
        if w:
            nodes.append((doc, frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))))
    nodes = list(dict.fromkeys(nodes))
    root, links = list(range(len(nodes))), [0] * len(nodes)
    for i, (_, x) in enumerate(nodes):
        for j in range(i):
            y = nodes[j][1]
            if len(x & y) >= threshold * len(x | y):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    least = {r: min(d for (d, _), q in zip(nodes, root, strict=True) if q == r) for r in root}
    return sorted((d, least[r], k) for (d, _), r, k in zip(nodes, root, links, strict=True))
