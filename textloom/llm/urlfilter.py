"""URL filters: a trie over reversed host labels and path segments.

A rule is a host, perhaps with a path: ``example.org/a/b``. It covers the host, its subdomains and all below the
path. Of the rules that cover a URL the one with most host labels decides, among these the one with most path
segments; of an allow and a block rule with the same key the block rule.

Plan: URLs are taken apart and their labels and segments hashed in the JVM, so an Arrow function gets numbers only
(page bodies stay in the JVM, or unread). The trie is flat: sorted arrays of edges (node, hash) with their ends,
through which a batch of URLs goes together, a label at a time. Its bytes are computed before it is broadcast; above
``broadcast_bytes`` each URL is expanded into the keys of its possible rules, no deeper than the deepest rule, which are
joined by shuffle; the result is the same.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import U64, col, mix, without

_HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)"
_URL = re.compile(_HOST)
BROADCAST_BYTES = 64 << 20
_PATH = 0x5BD1E9955BD1E995  # the edge from a host to its paths


def parts(url: str | None) -> tuple[list[str], list[str]] | None:
    """(host labels, last first; path segments); None without a host. Scheme, user, port, query and fragment
    don't count, nor do empty path segments."""
    m = _URL.match(url or "")
    host = m.group(1).strip(" .").lower() if m else ""
    return (host.split(".")[::-1], [s for s in m.group(2).strip(" ").split("/") if s]) if host else None


def _labels(url: Column) -> Column:
    host = F.lower(F.regexp_replace(F.regexp_extract(url, _HOST, 1), r"^[ .]+|[ .]+$", ""))
    return F.when(host != "", F.reverse(F.split(host, r"\.", -1)))


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_extract(url, _HOST, 2)), "/", -1), lambda s: s != "")


def _hashes(names: Column) -> Column:
    return F.transform(names, lambda x: F.xxhash64(x))


class Trie:
    """Nodes are numbers, 0 the root; edges lie sorted by a hash of (node, label). rule: of a node, or -1."""

    def __init__(self, labels: list[np.ndarray], segments: list[np.ndarray], actions: list[str], keys: list[str]):
        paths = [np.concatenate([a, [_PATH], b]).astype(np.int64).view(U64) for a, b in zip(labels, segments, strict=True)]
        self.actions, self.keys = pa.array(actions, pa.string()), pa.array(keys, pa.string())
        self.depth = max((len(x) for x in segments), default=0)
        at, edges, ends, count = np.zeros(len(paths), np.int64), [], [], 1
        size = np.array([len(p) for p in paths], np.int64)
        for step in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > step)
            kinds, inverse = np.unique(self._edge(at[on], np.array([paths[i][step] for i in on.tolist()], U64)), return_inverse=True)
            edges.append(kinds)
            ends.append(np.arange(count, count + len(kinds), dtype=np.int32))
            at[on] = count + inverse
            count += len(kinds)
        self.edges, self.ends = np.concatenate([*edges, np.empty(0, U64)]), np.concatenate([*ends, np.empty(0, np.int32)])
        order = np.argsort(self.edges)
        self.edges, self.ends = self.edges[order], self.ends[order]
        self.rule = np.full(count, -1, np.int32)
        self.rule[at] = np.arange(len(paths))

    @staticmethod
    def _edge(node: np.ndarray, name: np.ndarray) -> np.ndarray:
        return mix(mix(node.astype(U64)) + name)

    def _next(self, node: np.ndarray, name: np.ndarray) -> np.ndarray:
        """The nodes that edges lead to, -1 where there is none."""
        if not len(self.edges):
            return np.full(len(node), -1)
        h = self._edge(node, name)
        at = np.minimum(np.searchsorted(self.edges, h), len(self.edges) - 1)
        return np.where(self.edges[at] == h, self.ends[at], -1)

    def find(self, labels: tuple[np.ndarray, np.ndarray], segments: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The rule that decides each URL, or -1. labels and segments: (all hashes, where each URL's begin)."""
        (a, a_at), (b, b_at) = labels, segments
        n = len(a_at) - 1
        on, node, step, paths = np.arange(n), np.zeros(n, np.int64), 0, []
        while len(on):  # down the labels; nodes that have paths are kept
            go = np.diff(a_at)[on] > step
            on, node = on[go], node[go]
            node = self._next(node, a[a_at[on] + step])
            on, node = on[node >= 0], node[node >= 0]
            root = self._next(node, np.full(len(node), _PATH, U64))
            paths.append((on[root >= 0], root[root >= 0]))
            step += 1
        best = np.full(n, -1)
        for on, node in reversed(paths):  # the deepest host that has a rule for the path decides
            node, on = node[best[on] < 0], on[best[on] < 0]
            step = 0
            while len(on):
                own = self.rule[node]
                best[on[own >= 0]] = own[own >= 0]
                go = np.diff(b_at)[on] > step
                on, node = on[go], node[go]
                node = self._next(node, b[b_at[on] + step])
                on, node = on[node >= 0], node[node >= 0]
                step += 1
        return best


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).view(U64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def key(p: tuple[list[str], list[str]]) -> str:
    return "/".join([".".join(p[0][::-1]), *p[1]])


def decide(pages: DataFrame, rules: DataFrame, *, url: str = "url", pattern: str = "pattern", action: str = "action", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages with the columns url_action ('allow' or 'block') and url_rule (the deciding rule; null: the default).

    Columns of those names are replaced; all others stay, whatever their names. A null or empty url, one without a
    host, and one that no rule covers have the default action. Rules that are null, without host or with another
    action don't count; of rules that repeat one counts, a block rule if there is one. Repeated rows get a row
    each. Very long URLs are looked at as deep as rules go. An empty table gives no rows.
    """
    keep = [col(c) for c in without(pages, "url_action", "url_rule")]
    own = rules.select(col(pattern).cast("string").alias("p"), col(action).cast("string").alias("action")).where("p IS NOT NULL AND action IN ('allow', 'block')")
    own = own.select(_labels(F.col("p")).alias("labels"), _segments(F.col("p")).alias("segments"), "action").where("labels IS NOT NULL")
    name = F.concat_ws("/", F.array_join(F.reverse("labels"), "."), "segments").alias("key")
    own = own.groupBy("labels", "segments", name).agg(F.max("action").alias("action"))
    edges = F.size("labels") + F.size("segments") + 1
    # an edge has 12 bytes, a node 4, a rule its key and action; building takes some more
    size, labels, segments = own.agg(F.sum(edges * 24 + F.octet_length("key") + 40), F.max(F.size("labels")), F.max(F.size("segments"))).first()
    at = col(url).cast("string")
    if (size or 0) <= broadcast_bytes:
        table = own.select(_hashes(F.col("labels")).alias("a"), _hashes(F.col("segments")).alias("b"), "action", "key").toArrow()
        split = lambda c: (x := _lists(table.column(c))) and [x[0][x[1][i] : x[1][i + 1]].view(np.int64) for i in range(table.num_rows)]
        shared = pages.sparkSession.sparkContext.broadcast(Trie(split("a"), split("b"), table.column("action").to_pylist(), table.column("key").to_pylist()))

        @arrow_udf("struct<action: string, rule: string>")
        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            trie = shared.value
            best = trie.find(_lists(a), _lists(b))
            best = pa.array(best, pa.int64(), mask=best < 0)
            return pa.StructArray.from_arrays([trie.actions.take(best), trie.keys.take(best)], names=["action", "rule"])

        out = pages.withColumn("__rule", run(_hashes(_labels(at)), _hashes(F.slice(_segments(at), 1, max(1, segments or 0)))))
        return out.select(*keep, F.coalesce("__rule.action", F.lit(default)).alias("url_action"), F.col("__rule.rule").alias("url_rule"))
    best = _by_join(pages.select(at.alias("u")).where("u IS NOT NULL").distinct(), own.select("key", "action"), labels, segments)
    out = pages.join(best, at.eqNullSafe(F.col("__u")), "left")
    return out.select(*keep, F.coalesce("__action", F.lit(default)).alias("url_action"), F.col("__rule").alias("url_rule"))


def _by_join(urls: DataFrame, rules: DataFrame, labels: int, segments: int) -> DataFrame:
    """The same by joining each URL's possible keys, no deeper than the rules, with theirs."""
    split = urls.select("u", F.slice(_labels(F.col("u")), 1, labels).alias("labels"), F.slice(_segments(F.col("u")), 1, max(1, segments)).alias("segments")).where("labels IS NOT NULL")
    hosts = split.select("u", "segments", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.struct(F.array_join(F.reverse(F.slice("labels", 1, i)), ".").alias("host"), i.alias("labels")))).alias("h"))
    wide = hosts.select("u", "h.*", F.explode(F.transform(F.sequence(F.lit(0), F.size("segments")), lambda j: F.struct(F.slice("segments", 1, j).alias("path"), j.alias("segments")))).alias("s"))
    wide = wide.select("u", "labels", "s.segments", F.concat_ws("/", "host", "s.path").alias("key")).join(rules, "key")
    top = wide.groupBy("u").agg(F.max_by(F.struct("action", "key"), F.struct("labels", "segments")).alias("r"))
    return top.select(F.col("u").alias("__u"), F.col("r.action").alias("__action"), F.col("r.key").alias("__rule"))


def brute_force(url: str | None, rules: list[tuple[str, str]], default: str = "allow") -> tuple[str, str | None]:
    """The decision by looking at every rule, for tests."""
    u, best = parts(url), None
    for pattern, action in rules:
        r = parts(pattern)
        if u and r and u[0][: len(r[0])] == r[0] and u[1][: len(r[1])] == r[1]:
            rank = len(r[0]), len(r[1]), action == "block"
            if best is None or rank > best[0]:
                best = rank, action, key(r)
    return (best[1], best[2]) if best else (default, None)
