"""Benchmark decontamination by spaced-seed hashing.

Each mask is a set of token offsets; the tokens between them are ignored, so that a seed survives substituted
words there. Hashes of the benchmark's seeds are joined with those of the training texts. Around each hit the
two texts are laid over each other and compared word by word: a document is contaminated by an item if some
``window`` consecutive words of the item agree with the document in at least ``min_matches`` places. The masks
are fixed; together they are lossless: wherever the allowed number of substitutions lies in a window, one mask at
one place in it has none of them. Items of fewer words than the window, whose threshold is in proportion, have
masks for their own length.

Plan: the benchmark's seed table is measured, then broadcast as sorted arrays if it fits ``broadcast_bytes``;
a larger benchmark is divided by a hash of its rows into as many slices as needed, each with a pass of its own,
so that memory has a bound and nothing is left out. The corpus is read in one narrow pass without any shuffle;
only the hits, which are few, are aggregated.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, col, keep_rows, release, selected_hashes, text_batches, word_hashes

#: Offsets that a seed looks at; all others up to the last are ignored.
MASKS = ((0, 1, 3, 6, 8, 9), (0, 2, 3, 7, 8, 10), (0, 1, 4, 5, 9, 11), (0, 3, 5, 6, 7, 11))
WINDOW_WORDS, MIN_MATCHES = 13, 10
CHUNK = 2_000_000  # hits of one mask that are held at once
HITS = "doc_id long, key long, item_id long, window_matches int, overlap_words int"


def allowed(words: int, window: int = WINDOW_WORDS, min_matches: int = MIN_MATCHES) -> int:
    """Substitutions that a window of so many words may have."""
    return words - math.ceil(min_matches * words / window)


@functools.cache
def masks_for(words: int, window: int = WINDOW_WORDS, min_matches: int = MIN_MATCHES) -> tuple[tuple[int, ...], ...]:
    """Masks of which one, at one place, avoids any allowed substitutions in a window of so many words: first MASKS
    as far as they fit, then those, with fewer offsets if need be, that avoid most of the patterns that are left."""
    wrong = allowed(words, window, min_matches)
    left = {frozenset(c) for c in itertools.combinations(range(words), wrong)}
    out: list[tuple[int, ...]] = []

    def avoided(mask):
        places = [{o + i for o in mask} for i in range(words - mask[-1])]
        return {c for c in left if any(not c & p for p in places)}

    for mask in MASKS:
        if mask[-1] < words and (hit := avoided(mask)):
            out.append(mask)
            left -= hit
    weight = min(6, words - wrong)
    tries = 0
    while left:
        best = max((m for m in ((0, *rest) for rest in itertools.combinations(range(1, words), weight - 1))), key=lambda m: len(avoided(m)))
        hit = avoided(best)
        out.append(best)
        left -= hit
        tries += 1
        if tries == 4 and left and weight > 3:  # fewer offsets rather than many masks
            weight, tries = weight - 1, 0
    return tuple(out)


class SeedIndex:
    """The benchmark's words and its seeds, sorted by hash."""

    def __init__(self, ids: pa.Array, texts: pa.Array, window=WINDOW_WORDS, min_matches=MIN_MATCHES):
        self.ids = ids.cast(pa.int64())
        self.words, self.off = word_hashes(texts)
        self.window, self.min_matches = window, min_matches
        size = np.diff(self.off)
        self.row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.tables = []  # (mask, hashes, places, bits, which hash classes occur)
        for words in np.unique(np.minimum(size, window)).tolist():
            own = np.minimum(size, window)[self.row] == words
            for mask in masks_for(words, window, min_matches) if words else ():
                h = selected_hashes(self.words, mask)
                at = np.flatnonzero((self.row[: len(h)] == self.row[mask[-1] : mask[-1] + len(h)]) & own[: len(h)]) if len(h) else np.empty(0, np.int64)
                order = np.argsort(h[at], kind="stable")
                h, at = h[at][order], at[order].astype(np.int32)
                bits = max(16, 3 + int(len(h)).bit_length())
                seen = np.zeros(1 << bits, bool)
                seen[(h >> U64(64 - bits)).astype(np.int64)] = True
                self.tables.append((mask, h, at, bits, seen))

    def hits(self, words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document row, item row, best window's matches, matches in all) of the contaminated pairs."""
        doc_row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        found = [np.empty((3, 0), np.int64)]
        for mask, h, at, bits, seen in self.tables:
            g = selected_hashes(words, mask)
            if not len(g) or not len(h):
                continue
            pos = np.flatnonzero(seen[(g >> U64(64 - bits)).astype(np.int64)])
            pos = pos[doc_row[pos] == doc_row[pos + mask[-1]]]
            g = g[pos]
            lo, n = np.searchsorted(h, g, "left"), np.searchsorted(h, g, "right")
            n -= lo
            total, step = np.cumsum(n), 0
            while step < len(n):  # a seed that many items share, in many texts, is merged by diagonal as it goes
                end = max(step + 1, int(np.searchsorted(total, (total[step - 1] if step else 0) + CHUNK, side="right")))
                s = slice(step, end)
                m = n[s]
                p = np.repeat(pos[s], m)
                i = at[np.repeat(lo[s], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                d, q = doc_row[p], self.row[i]
                found.append(np.unique(np.stack([d, q, (p - off[d]) - (i - self.off[q])]), axis=1))
                if sum(x.shape[1] for x in found) > CHUNK:
                    found = [np.unique(np.concatenate(found, axis=1), axis=1)]
                step = end
        d, q, shift = np.unique(np.concatenate(found, axis=1), axis=1)
        if not len(d):
            return (np.empty(0, np.int64),) * 4
        best, total = np.empty(len(d), np.int64), np.empty(len(d), np.int64)
        size = np.diff(self.off)[q]
        step = 0
        while step < len(d):  # some 500,000 compared words at a time, 80 bytes each
            end = max(step + 1, int(np.searchsorted(np.cumsum(size[step:]), 500_000)) + step)
            s = slice(step, end)
            m = size[s]
            first = np.cumsum(m) - m
            j = np.arange(m.sum()) - np.repeat(first, m)
            at = np.repeat(shift[s], m) + j
            inside = (at >= 0) & (at < np.repeat(np.diff(off)[d[s]], m))
            same = np.zeros(len(j), np.int64)
            x = np.flatnonzero(inside)
            same[x] = words[(np.repeat(off[d[s]], m) + at)[x]] == self.words[(np.repeat(self.off[q[s]], m) + j)[x]]
            run = np.concatenate([[0], np.cumsum(same)])
            w = np.repeat(np.minimum(m, self.window), m)
            back = np.where(j + 1 >= w, run[1:] - run[np.maximum(np.arange(len(j)) + 1 - w, 0)], 0)
            best[s], total[s] = np.maximum.reduceat(back, first), np.add.reduceat(same, first)
            step = end
        w = np.minimum(size, self.window)
        keep = best * self.window >= self.min_matches * w
        d, q, best, total = d[keep], q[keep], best[keep], total[keep]
        order = np.lexsort((-total, -best, q, d))
        d, q, best, total = d[order], q[order], best[order], total[order]
        one = np.ones(len(d), bool)
        one[1:] = (d[1:] != d[:-1]) | (q[1:] != q[:-1])
        group = np.flatnonzero(one)
        return d[one], q[one], best[one], np.maximum.reduceat(total, group) if len(group) else total[one]


def _found(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int, min_matches: int, broadcast_bytes: int) -> DataFrame:
    """HITS; key: the hash of the document's text."""
    docs = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    items = benchmark.select(col(item_id).cast("long").alias("item_id"), col(item_text).cast("string").alias("text")).where("length(text) > 0")
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"[A-Za-z0-9\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    # a word has its hash (8 bytes), its row (4) and, for each mask, a hash (8), a place (4) and up to 16 flags
    slices = max(1, math.ceil(words * (12 + 28 * max(len(masks_for(w, window, min_matches)) for w in range(1, window + 1))) / broadcast_bytes))
    sc, found = docs.sparkSession.sparkContext, []
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k) if slices > 1 else items
        table = part.toArrow().combine_chunks()
        shared = sc.broadcast(SeedIndex(table.column("item_id").combine_chunks(), table.column("text").combine_chunks(), window, min_matches))

        def scan(batches, shared=shared):
            index = shared.value
            for whole in batches:
                for b in text_batches(whole, "text", 2 << 20):
                    d, q, best, total = index.hits(*word_hashes(b.column("text")))
                    if len(d):
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), b.column("key").take(pa.array(d)), index.ids.take(pa.array(q)), pa.array(best, pa.int32()), pa.array(total, pa.int32())], names=["doc_id", "key", "item_id", "window_matches", "overlap_words"])
            release()

        found.append(docs.mapInArrow(scan, HITS))
    return functools.reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, min_matches: int = MIN_MATCHES, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """(doc_id, item_id, window_matches, overlap_words), a row for each contaminated pair.

    window_matches is the highest count of agreeing words in ``window`` consecutive words of the item (all of
    a shorter item, whose threshold is in proportion); overlap_words the highest count over the whole item.

    Null or empty text on either side matches nothing; a null id is kept as null. Rows that repeat give one row
    per (doc_id, item_id). Other columns of either table, whatever their names, are not read. Empty tables give
    an empty result.
    """
    out = _found(docs, benchmark, doc_id, text, item_id, item_text, window, min_matches, broadcast_bytes)
    return out.groupBy("doc_id", "item_id").agg(F.max("window_matches").alias("window_matches"), F.max("overlap_words").alias("overlap_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, min_matches: int = MIN_MATCHES, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """docs without the contaminated documents; all columns stay. A document is known by its id and text, so a
    clean text stays though another under the same id, or with a null id too, goes. Other rules as for
    ``contamination``."""
    found = _found(docs, benchmark, doc_id, text, item_id, item_text, window, min_matches, broadcast_bytes)
    return keep_rows(docs, doc_id, text, found.select("doc_id", "key").distinct())


def brute_force(docs: list[tuple], items: list[tuple], window=WINDOW_WORDS, min_matches=MIN_MATCHES) -> set[tuple]:
    """The rule itself, without any mask, in plain Python, for tests."""
    import re

    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    out: dict[tuple, list[int]] = {}
    for doc, text in docs:
        a = split(text)
        for item, other in items:
            b = split(other)
            if not b:
                continue
            w = min(window, len(b))
            for shift in range(-len(b), len(a)):
                same = [0 <= shift + j < len(a) and a[shift + j] == b[j] for j in range(len(b))]
                best = max(sum(same[i : i + w]) for i in range(len(b) - w + 1))
                if best * window >= min_matches * w:
                    have = out.setdefault((doc, item), [0, 0])
                    have[0], have[1] = max(have[0], best), max(have[1], sum(same))
    return {(*k, *v) for k, v in out.items()}
