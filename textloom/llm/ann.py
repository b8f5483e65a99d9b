"""Approximate nearest neighbours by an inverted multi-index.

A vector's two halves are quantised separately with ``size`` centroids each, so there are size * size cells. A
query goes through the pairs of centroids by summed distance with a heap, until the cells that it took hold
``visit`` entries; those, and no others, are compared with it.

``visit`` is measured, not guessed: the true neighbours of some PROBES queries are found by comparing them with
all entries, and it becomes the number of entries within which the traversal has met the share ``recall`` of them.
It is small where vectors cluster, whatever the table's size; where they have no structure, as random ones in many
dimensions, no index can do without a large share of the table.

Plan. The vectors are written once, compactly, in the shared folder. Codebooks are fitted on a sample of FIT_BYTES.
One pass counts the entries of the cells, of which there are MOST_CELLS at most. The index is a table in the shared
folder in parts of some PART_BYTES, each of consecutive cells; a cell that is larger has several parts. Queries are
divided into blocks; a task goes through the parts that its queries visit, one at a time, and keeps the k best of
each query, so that neither entries nor candidates are shuffled, nothing grows with the table but the number of
parts, and a lost task reads the index again.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, col, counted, file_system, mix, release, shared_path

NEIGHBOURS, RECALL, ROUNDS, PROBES, BLOCK = 10, 0.95, 8, 256, 1024
CELL_ROWS, MOST_CELLS = 48, 1 << 16
FIT_BYTES, PART_BYTES = 16 << 20, 8 << 20
RESULT = "query_id long, rank int, neighbour_id long, distance double"


def vectors(batch: pa.RecordBatch | pa.Table, dim: int, name: str = "v") -> np.ndarray:
    """The rows of a binary column of float32."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(batch.num_rows, dim)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 8192], c).argmin(1) for i in range(0, len(x), 8192)] or [np.empty(0, np.int64)])


def codebook(x: np.ndarray, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds, from the first size distinct vectors on; one that loses all its vectors stays."""
    _, first = np.unique(x, axis=0, return_index=True)
    book = x[np.sort(first)[:size]].copy()
    for _ in range(rounds):
        a = nearest(x, book)
        order = np.argsort(a, kind="stable")
        own, at = np.unique(a[order], return_index=True)
        n = np.diff(np.append(at, len(a)))
        book[own] = (np.add.reduceat(x[order].astype(np.float64), at, axis=0) / n[:, None]).astype(np.float32)
    return book


def traverse(d1: np.ndarray, d2: np.ndarray, sizes: list[int], want: int) -> list[int]:
    """Cells (i * k + j) in order of d1[i] + d2[j] until they hold want entries: the multi-sequence algorithm."""
    o1, o2, k = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist(), len(d2)
    a, b = [float(d1[i]) for i in o1], [float(d2[j]) for j in o2]
    heap, out, held = [(a[0] + b[0], 0, 0)], [], 0
    # a row begins once the row before it has given its first
    while heap and held < want:
        _, r, c = heapq.heappop(heap)
        cell = o1[r] * k + o2[c]
        if sizes[cell]:
            out.append(cell)
            held += sizes[cell]
        if c + 1 < len(b):
            heapq.heappush(heap, (a[r] + b[c + 1], r, c + 1))
        if c == 0 and r + 1 < len(a):
            heapq.heappush(heap, (a[r + 1] + b[0], r + 1, 0))
    return out


def parts_of(held: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first part, number of parts) of each cell, and the number of parts in all, each of some ``most`` entries."""
    part, split, at, fill = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), -1, most + 1
    for c, n in enumerate(held.tolist()):
        if n > most:
            part[c], split[c] = at + 1, -(-n // most)
            at, fill = at + int(split[c]), most + 1
            continue
        if fill + n > most:
            at, fill = at + 1, 0
        part[c], fill = at, fill + n
    return part, split, at + 1


class Best:
    """The k best entries of each query: by exact distance, ties by the lower id."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.ids, self.k = q, ids, k
        self.norm = (q * q).sum(1)
        self.row, self.id, self.d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.limit = np.full(len(q), np.inf, np.float32)  # squared, a little too large rather than too small
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, rows: np.ndarray, e: np.ndarray, ids: np.ndarray) -> None:
        """Compares the queries in rows with entries."""
        norm = (e * e).sum(1)
        d = self.norm[rows][:, None] - 2 * (self.q[rows] @ e.T) + norm
        slack = np.float32(1e-5) * (self.norm[rows] + norm.max(initial=0))  # what rounding may change
        most = self.limit[rows] + slack
        if d.shape[1] > self.k + 1:  # one may be the query itself
            most = np.minimum(most, np.partition(d, self.k, axis=1)[:, self.k] + 2 * slack)
        a, b = np.nonzero(d <= most[:, None])
        a = rows[a]
        other = self.ids[a] != ids[b]
        a, b = a[other], b[other]
        if len(a):
            self.waiting.append((a, ids[b], ((self.q[a].astype(np.float64) - e[b].astype(np.float64)) ** 2).sum(1)))
            self.held += len(a)
            if self.held > 50_000:
                self.merge()

    def merge(self) -> None:
        row, ids, d = (np.concatenate([x, *(w[i] for w in self.waiting)]) for i, x in enumerate((self.row, self.id, self.d)))
        order = np.lexsort((ids, d, row))
        row, ids, d = row[order], ids[order], d[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.row, self.id, self.d, rank = row[keep], ids[keep], d[keep], rank[keep]
        last = rank == self.k - 1
        self.limit[self.row[last]] = np.nextafter(self.d[last].astype(np.float32), np.float32(np.inf))
        self.waiting, self.held = [], 0

    def rows(self) -> tuple[np.ndarray, ...]:
        """(query row, rank from 1, id, distance)."""
        self.merge()
        return self.row, np.arange(len(self.row)) - np.searchsorted(self.row, self.row) + 1, self.id, np.sqrt(self.d)


def _clean(df: DataFrame, vec_id: str, embedding: str, path: str) -> int | None:
    """Writes (id, v) of the rows that count; their dimension, None if there are none."""
    rows = df.select(col(vec_id).cast("long").alias("id"), col(embedding).cast("array<float>").alias("e"))
    rows = rows.where("id IS NOT NULL AND size(e) > 0 AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('inf'))")
    common = rows.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return None
    rows = rows.where(F.size("e") == common["dim"])
    again = counted(rows.groupBy("id").count().where("count > 1").select("id"))  # only ids that repeat are shuffled with their vectors
    rows = rows.join(again, "id", "left_anti").unionByName(rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("e").alias("e")))

    def pack(batches):
        for b in batches:
            e = b.column("e").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in e], pa.binary())], names=["id", "v"])

    rows.mapInArrow(pack, "id long, v binary").write.parquet(path)
    return common["dim"]


def _probe(rows: DataFrame, q: np.ndarray, ids: np.ndarray, k: int, dim: int, cell) -> list:
    """(query row, cell) of the true k nearest of each query, by comparing all."""
    shared = rows.sparkSession.sparkContext.broadcast((q, ids))

    def run(batches):
        best, cells = Best(*shared.value, k), {}
        for b in batches:
            e, own = vectors(b, dim), b.column("id").to_numpy()
            for at in range(0, len(e), 4096):
                best.add(np.arange(len(best.q)), e[at : at + 4096], own[at : at + 4096])
            best.merge()
            near = np.flatnonzero(np.isin(own, best.id))
            cells.update(zip(own[near].tolist(), cell(e[near]).tolist(), strict=True))
        row, _, near, d = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(near), pa.array(d), pa.array([cells[x] for x in near.tolist()], pa.int32())], names=["q", "id", "d", "cell"])

    found = rows.mapInArrow(run, "q long, id long, d double, cell int")
    top = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "cell"))), 1, k).alias("top"))  # k of each task
    return [(r["q"], x["cell"]) for r in top.collect() for x in r["top"]]


def neighbours(df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 1, k: int = NEIGHBOURS, recall: float = RECALL, visit: int | None = None, part_bytes: int = PART_BYTES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): for each row of df whose id is divisible by ``every`` its k nearest
    others among all rows, by Euclidean distance.

    visit: how many entries a query is compared with at least; None: measured for the recall, as above.

    Ties of distance go to the lower id. A row is never its own neighbour; other rows of equal vectors are.
    Rows with a null id, a null vector, a null, NaN or infinite element or another length than most vectors have
    (of equally many, the shorter) are left out. Rows that repeat an id are one: the least vector. Where there are
    fewer than k others, all are given. Other columns, whatever their names, aren't read. An empty table gives no
    rows.
    """
    spark = df.sparkSession
    raw, index = shared_path(spark, "vectors"), shared_path(spark, "index")
    dim = _clean(df, vec_id, embedding, raw)
    if dim is None:
        return spark.createDataFrame([], RESULT)
    rows = spark.read.parquet(raw)
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(1024, FIT_BYTES // (4 * dim))).select("v").toArrow()
    x = vectors(sample, dim)
    half = dim // 2 if dim > 1 else 1  # of a single number the second half is nothing
    size = 2 ** max(1, round(math.log2(min(MOST_CELLS, max(4, total / CELL_ROWS))) / 2))
    books = [codebook(np.ascontiguousarray(p), size, rounds) for p in (x[:, :half], x[:, half:] if dim > 1 else np.zeros((len(x), 1), np.float32))]
    k1, k2 = map(len, books)
    shared = spark.sparkContext.broadcast(books)

    def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[:, :half], v[:, half:] if dim > 1 else np.zeros((len(v), 1), np.float32)

    def cell(v: np.ndarray) -> np.ndarray:
        a, b = halves(v)
        return (nearest(a, shared.value[0]) * k2 + nearest(b, shared.value[1])).astype(np.int32)

    def count(batches):
        n = np.zeros(k1 * k2, np.int64)
        for b in batches:
            n += np.bincount(cell(vectors(b, dim)), minlength=len(n))
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own])], names=["cell", "n"])

    held = np.zeros(k1 * k2, np.int64)
    for r in rows.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        held[r["cell"]] = r["n"]
    asked = rows.where(F.col("id") % every == 0) if every > 1 else rows
    if visit is None:
        some = asked.orderBy(F.xxhash64("id"), "id").limit(PROBES).toArrow()
        q = vectors(some, dim)
        d1, d2 = (distances(a, b) for a, b in zip(halves(q), books, strict=True))
        met = []
        order, seen = None, None
        for at, c in sorted(_probe(rows, q, some.column("id").to_numpy(), k, dim, cell)):
            if seen != at:
                near = np.argsort((d1[at][:, None] + d2[at]).ravel(), kind="stable")
                order, seen = np.empty(len(near), np.int64), at
                order[near] = np.cumsum(held[near])
            met.append(order[c])
        visit = int(np.quantile(met, recall, method="higher")) if met else 0
    want = min(total, max(visit, k + 1))

    most = max(256, part_bytes // (4 * dim))
    part, split, parts = parts_of(held, most)
    table = spark.sparkContext.broadcast((held, part, split))

    def entries(batches):
        _, part, split = table.value
        for b in batches:
            v = vectors(b, dim)
            c, ids = cell(v), b.column("id").to_numpy()
            own = part[c] + (mix(ids.view(U64).copy()) % split[c].astype(U64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(c), b.column("id"), b.column("v")], names=["part", "cell", "id", "v"])

    rows.mapInArrow(entries, "part int, cell int, id long, v binary").repartition(parts, "part").sortWithinPartitions("part", "cell").write.partitionBy("part").parquet(index)

    def search(batches):
        held, part, split = table.value
        sizes = held.tolist()
        system, base = file_system(index)
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                q, ids = vectors(b, dim), b.column("id").to_numpy()
                d1, d2 = (distances(a, c) for a, c in zip(halves(q), shared.value, strict=True))
                cells = np.zeros((len(held), len(q)), bool)
                for i in range(len(q)):
                    cells[traverse(d1[i], d2[i], sizes, want), i] = True
                visited = np.flatnonzero(cells.any(1))
                best = Best(q, ids, k)
                for p in sorted({int(x) for c in visited for x in range(part[c], part[c] + split[c])}):
                    for f in sorted(f.path for f in system.get_file_info(fs.FileSelector(f"{base}/part={p}", allow_not_found=True)) if f.path.endswith(".parquet")):
                        t = pq.read_table(f, filesystem=system, columns=["cell", "id", "v"], partitioning=None)
                        e, own, c = vectors(t, dim), t.column("id").to_numpy(), t.column("cell").to_numpy()
                        cut = np.append(np.flatnonzero(np.diff(c, prepend=-1)), len(c))
                        for s, stop in zip(cut[:-1], cut[1:], strict=True):
                            who = np.flatnonzero(cells[c[s]])
                            for m in range(s, stop, 4096) if len(who) else ():
                                best.add(who, e[m : min(stop, m + 4096)], own[m : min(stop, m + 4096)])
                row, rank, near, d = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(rank, pa.int32()), pa.array(near), pa.array(d)], names=["query_id", "rank", "neighbour_id", "distance"])
        release()

    n = asked.count()
    tasks = max(1, math.ceil(n / block), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / 64)))
    return asked.repartition(tasks).mapInArrow(search, RESULT)


def brute_force(rows: list[tuple], k: int) -> dict[int, list[int]]:
    """Each id's nearest others by comparing all, for tests."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, d))[: min(k, len(ids) - 1)]]
    return out
