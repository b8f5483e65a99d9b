"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order 4 over lower-case letters, all else being one separator. The n-grams of all
languages lie in one sorted array of 64-bit hashes per order, beside a matrix of each language's interpolated
log-probabilities; a second sorted array per order has the back-off weights of the contexts. A text gets the
language of the lowest cross-entropy per character, unless that is above what texts of that length in that
language have (calibrated rejection): the limit is mean + reach * deviation * (FLAT + 1 / sqrt(symbols)), mean and
deviation of the language's own 4-grams, and reach such that ALPHA of the language's texts that a model hasn't seen
lie above it. For that the texts are divided by a hash into ten folds; a model without one of them scores it. The
final model is of all texts.

Plan: one pass counts the 4-grams of all labelled texts and of the fold (map-side sums, then one small shuffle);
lower orders follow from them. All counted 4-grams are in the model, which is broadcast: where they are many, each
language has arrays of its own rather than a column in a matrix over the 4-grams of all. A narrow pass over the fold
calibrates, and a last one over all scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, col, map_rows, mix, position, release, text_batches

ORDER = 4
ALPHA, FOLDS, FLAT = 0.001, 10, 0.05
BATCH = 1 << 19  # bytes of text at once; counting takes some 200 times that
_TABLE: np.ndarray | None = None


def symbol(code: int) -> int:
    """A letter is itself; letters beyond the basic plane share the 8,448 places of surrogates and private use; all
    else is a space."""
    return 32 if not chr(code).isalpha() else code if code < 65536 else 0xD800 + code % 0x2100


def _table() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([symbol(i) for i in range(0x110000)], np.uint16)
    return _TABLE


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts, where each text's begin, where they end). Before each text are three spaces, which
    aren't part of it; its last symbol is a space."""
    texts = pc.fill_null(pc.utf8_lower(texts), "")
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _table()[code]
    at = np.concatenate([[0], np.cumsum(size)])
    s = np.insert(s, at, 0)
    keep = s != 32
    keep[1:] |= s[:-1] != 32
    s = s[keep]
    ends = np.flatnonzero(s == 0)
    pos = ends + 3 * np.arange(len(ends))
    out = np.repeat(s, np.where(s == 0, 4, 1))
    out[out == 0] = 32
    return out, pos[:-1] + 4, pos[1:] + 1


def grams(s: np.ndarray) -> np.ndarray:
    """The packed 4-gram that ends at each symbol; those of the first three are void."""
    x = s.astype(U64)
    k = x.copy()
    for i in range(1, ORDER):
        k[i:] |= x[:-i] << U64(16 * i)
    return k


def _inside(n: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all texts' symbols and the text of each."""
    size = end - begin
    row = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size), row


def _labelled(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, text, held): held is whether the text is in the fold kept for calibration; equal texts go together."""
    docs = docs.select(col(lang).cast("string").alias("lang"), col(text).cast("string").alias("text")).where("lang IS NOT NULL AND length(text) > 0")
    return docs.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0)


def ngram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n, held) over all rows with a language and a text; held: how many of the n are in the fold."""

    def count(batches):
        total: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[tuple, list] = {}

        def merge(name):
            parts = waiting.pop(name, [])
            if name in total:
                parts.append(total[name])
            k, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total[name] = k, np.bincount(inv, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        for whole in batches:
            for b in text_batches(whole, "text", BATCH):
                s, begin, end = symbols(b.column("text"))
                k = grams(s)
                names = list(zip(b.column("lang").to_pylist(), b.column("held").to_pylist(), strict=True))
                kinds = {n: i for i, n in enumerate(dict.fromkeys(names))}
                which = np.array([kinds[n] for n in names])
                for name, i in kinds.items():
                    own = np.flatnonzero(which == i)
                    at, _ = _inside(len(s), begin[own], end[own])
                    waiting.setdefault(name, []).append(np.unique(k[at], return_counts=True))
                    if len(waiting[name]) >= 16:
                        merge(name)
        for name in list(waiting):
            merge(name)
        for (name, held), (k, n) in total.items():
            for i in range(0, len(k), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k[part])), pa.array(k[part].view(np.int64)), pa.array(n[part], pa.int64()), pa.array(n[part] * held, pa.int64())], names=["lang", "gram", "n", "held"])
        total.clear()
        release()

    return _labelled(docs, text, lang).mapInArrow(count, "lang string, gram long, n long, held long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


class Model:
    """Built from each language's 4-gram counts: {language: (packed grams, counts)}. symbols: how many all
    languages have, where counts has some of these only. reach: set by calibration; until then, and for a language
    of which the fold has no more than 1 / alpha texts, a limit of mean * (1 + slack) + z * deviation / sqrt(symbols)
    is the least."""

    slack, z = 0.35, 4.0

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], symbols: int | None = None):
        self.langs = sorted(counts)
        self.reach: dict[str, tuple[float, bool]] = {}
        n_lang = len(self.langs)
        levels: list[dict] = [{} for _ in range(ORDER + 1)]  # by order and language: (keys, counts)
        for name in self.langs:
            k, c = counts[name]
            o = np.argsort(k)
            levels[ORDER][name] = k[o].astype(U64), c[o].astype(np.float64)
            for order in range(ORDER - 1, 0, -1):
                low, n = np.unique(levels[order + 1][name][0] & U64((1 << (16 * order)) - 1), return_counts=True)
                levels[order][name] = low, n.astype(np.float64)
        union = [np.empty(0, U64)] + [np.unique(np.concatenate([levels[o][x][0] for x in self.langs])) if n_lang else np.empty(0, U64) for o in range(1, ORDER + 1)]
        size = (len(union[1]) if symbols is None else symbols) + 1
        self.floor = np.full(n_lang, -np.log(size))  # of a symbol that no language has: uniform
        lower = np.full((1, n_lang), 1 / size)
        self.tables, self.contexts, probability = [], [], []
        for o in range(1, ORDER + 1):
            keys = union[o]
            ctx = np.unique(keys >> U64(16)) if o > 1 else np.zeros(1, U64)
            weight, first = np.ones((len(ctx), n_lang)), np.zeros((len(keys), n_lang))
            of = np.searchsorted(ctx, keys >> U64(16)) if o > 1 else np.zeros(len(keys), np.int64)
            for j, name in enumerate(self.langs):
                k, c = levels[o][name]
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                d = n1 / (n1 + 2 * n2) if n1 else 0.5
                at = np.searchsorted(keys, k)
                total, kinds = np.bincount(of[at], c, len(ctx)), np.bincount(of[at], minlength=len(ctx))
                seen = total > 0
                weight[seen, j] = np.minimum(1, d * kinds[seen] / total[seen])
                first[at, j] = (c - d) / total[of[at]]
            suffix = np.searchsorted(union[o - 1], keys & U64((1 << (16 * (o - 1))) - 1)) if o > 1 else np.zeros(len(keys), np.int64)
            p = first + weight[of] * lower[suffix]
            lower = p
            probability.append(p)
            h = mix(keys.copy() + U64(o))
            s = np.argsort(h)
            self.tables.append((h[s], np.log(p[s]).astype(np.float32)))
            h = mix(ctx.copy() + U64(100 + o))
            s = np.argsort(h)
            self.contexts.append((h[s], np.log(weight[s]).astype(np.float32)))
        self.mean, self.deviation = np.zeros(n_lang), np.zeros(n_lang)
        for j, name in enumerate(self.langs):
            k, c = levels[ORDER][name]
            loss = -np.log(probability[-1][np.searchsorted(union[ORDER], k), j])
            self.mean[j] = (c * loss).sum() / c.sum()
            self.deviation[j] = np.sqrt((c * (loss - self.mean[j]) ** 2).sum() / c.sum())

    @staticmethod
    def _find(h: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(h, q), max(0, len(h) - 1))
        return at, (h[at] == q if len(h) else np.zeros(len(q), bool))

    def gram_scores(self, k: np.ndarray) -> np.ndarray:
        """log p of the last symbol of each packed 4-gram, by language."""
        out = np.zeros((len(k), len(self.langs)), np.float32)
        left = np.arange(len(k))
        for o in range(ORDER, 0, -1):
            own = k[left] & U64((1 << (16 * o)) - 1) if o < 4 else k[left]
            h, p = self.tables[o - 1]
            at, hit = self._find(h, mix(own + U64(o)))
            out[left[hit]] += p[at[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                return out
            h, w = self.contexts[o - 1]
            at, hit = self._find(h, mix((own >> U64(16)) + U64(100 + o)))
            out[left[hit]] += w[at[hit]]
        out[left] += self.floor.astype(np.float32)
        return out

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy (nats a symbol) of each text by each language, its symbols and its letters."""
        s, begin, end = symbols(texts)
        k = grams(s)
        cut = np.stack([begin, end], axis=1).ravel()
        letters = np.add.reduceat((s != 32).astype(np.int64), cut)[::2]
        total = np.zeros((len(begin), len(self.langs)))
        step = 1 << 20
        for i in range(0, len(s), step):  # a window's sums are added to the texts that it covers
            at = np.arange(i, min(len(s), i + step))
            row = np.searchsorted(begin, at, side="right") - 1
            inside = (row >= 0) & (at < end[row])
            at, row = at[inside], row[inside]
            if len(at):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                kinds, inv = np.unique(k[at], return_inverse=True) if len(at) > 4096 else (k[at], np.arange(len(at)))
                total[row[first]] += np.add.reduceat(self.gram_scores(kinds).astype(np.float64)[inv], first, axis=0)
        size = end - begin
        return -total / size[:, None], size, letters

    def limits(self, best: np.ndarray, size: np.ndarray) -> np.ndarray:
        least = self.mean[best] * (1 + self.slack) + self.z * self.deviation[best] / np.sqrt(size)
        reach = np.array([self.reach.get(x, (0.0, False))[0] for x in self.langs])
        sure = np.array([self.reach.get(x, (0.0, False))[1] for x in self.langs], bool)
        limit = self.mean[best] + reach[best] * self.deviation[best] * (FLAT + 1 / np.sqrt(size))
        return np.where(sure[best], limit, np.maximum(limit, least))

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(language number, cross-entropy, lead over the next language, limit, accepted, has letters) of each text."""
        h, size, letters = self.entropies(texts)
        if not self.langs:
            none = np.zeros(len(size))
            return np.zeros(len(size), np.int64), none, none, none, np.zeros(len(size), bool), letters > 0
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        lead = np.partition(h, 1, axis=1)[:, 1] - low if len(self.langs) > 1 else np.full(len(h), np.inf)
        limit = self.limits(best, size)
        return best, low, lead, limit, (low <= limit) & (letters > 0), letters > 0


class Parts(Model):
    """A model for each language, with the scores of one model of all."""

    def __init__(self, parts: list[Model]):
        self.parts, self.reach = parts, {}
        self.langs = [x for p in parts for x in p.langs]
        self.mean, self.deviation = (np.concatenate([getattr(p, a) for p in parts]) for a in ("mean", "deviation"))

    def gram_scores(self, k: np.ndarray) -> np.ndarray:
        return np.concatenate([p.gram_scores(k) for p in self.parts], axis=1)


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", matrix_cells: int = 8_000_000, alpha: float = ALPHA) -> Model:
    """The model of all languages that label rows of docs, with all their 4-grams, calibrated so that alpha of a
    language's texts are rejected. Where a matrix of 4-grams and languages would have more than matrix_cells cells,
    languages are collected and built one by one, in arrays of their own.

    Rows with a null language, or a null or empty text, don't count; rows that repeat count each. Other columns,
    whatever their names, aren't read. An empty table gives a model without languages, which rejects all.
    """
    counts = ngram_counts(docs, text, lang).persist(StorageLevel.DISK_ONLY)
    try:
        sizes = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}
        apart = sum(sizes.values()) * len(sizes) > matrix_cells
        symbols = counts.select(F.col("gram").bitwiseAND(0xFFFF)).distinct().count() if apart else None

        def built(n) -> Model:
            rows = counts.select("lang", "gram", n.alias("n")).where("n > 0")

            def collected(part: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
                table = part.toArrow()
                names, k, c = table.column("lang").to_numpy(), table.column("gram").to_numpy().view(U64), table.column("n").to_numpy()
                return {x: (k[names == x], c[names == x]) for x in sorted(set(names))}

            return Parts([Model(collected(rows.where(F.col("lang") == x)), symbols) for x in sorted(sizes)]) if apart else Model(collected(rows))

        model = built(F.col("n"))
        _calibrate(docs, text, lang, model, built(F.col("n") - F.col("held")), alpha)
        return model
    finally:
        counts.unpersist()


def _calibrate(docs: DataFrame, text: str, lang: str, model: Model, unseen: Model, alpha: float) -> None:
    """Sets model.reach from the texts of the fold, which unseen hasn't counted."""
    shared = docs.sparkSession.sparkContext.broadcast((model, unseen))

    def run(batches):
        model, unseen = shared.value
        place, other = ({x: i for i, x in enumerate(m.langs)} for m in (model, unseen))
        for whole in batches:
            whole = whole.filter(pa.array([x in other for x in whole.column("lang").to_pylist()], pa.bool_()))
            for b in text_batches(whole, "text", BATCH) if whole.num_rows else ():
                names = b.column("lang").to_pylist()
                h, size, letters = unseen.entropies(b.column("text"))
                which = np.array([place[x] for x in names])
                own = h[np.arange(len(h)), [other[x] for x in names]]
                x = (own - model.mean[which]) / (np.maximum(model.deviation[which], 1e-9) * (FLAT + 1 / np.sqrt(size)))
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(x)], names=["lang", "x"]).filter(pa.array(letters > 0))
        release()

    rows = _labelled(docs, text, lang).where("held").select("lang", "text").mapInArrow(run, "lang string, x double")
    for r in rows.groupBy("lang").agg(F.percentile_approx("x", 1 - alpha, 100_000).alias("x"), F.count("*").alias("n")).collect():
        model.reach[r["lang"]] = r["x"], r["n"] * alpha > 1


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, language, cross_entropy, lead, threshold, accepted), a row for each row of docs.

    language is that of the lowest cross-entropy (nats a symbol; ties: the first by name), also where the text
    is rejected. It is rejected above threshold, the language's calibrated limit for its length. lead is how far the next language is behind (null if there is
    one language only). Null and empty texts and those without letters are rejected, with language null. A null
    id stays null; rows that repeat get a row each; other columns aren't read. An empty table gives no rows.
    """
    docs = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    return docs.mapInArrow(_scorer(docs, model), "doc_id long, language string, cross_entropy double, lead double, threshold double, accepted boolean")


def _scorer(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for whole in batches:
            for b in text_batches(whole, "text", BATCH):
                best, low, lead, limit, ok, lettered = m.decide(b.column("text"))
                void = ~lettered
                names = [None if v or not m.langs else m.langs[x] for x, v in zip(best, void, strict=True)]
                number = lambda x: pa.array(x, pa.float64(), mask=void | ~np.isfinite(x))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), number(low), number(lead), number(limit), pa.array(ok)], names=["doc_id", "language", "cross_entropy", "lead", "threshold", "accepted"])
        release()

    return run


def brute_force(counts: dict[str, dict[str, int]], text: str) -> dict[str, float]:
    """Cross-entropy of a text by each language's 4-gram counts, straight from the definition, for tests."""
    import math

    vocabulary = {g[-1] for c in counts.values() for g in c}
    out = {}
    clean = "".join(chr(symbol(ord(ch))) for ch in text.lower())
    s = [32, 32, 32]
    for ch in clean:
        if ch != " " or (len(s) == 3 or s[-1] != 32):
            s.append(ord(ch))
    s.append(32)
    for name, c in counts.items():
        level = {4: dict(c)}
        for o in (3, 2, 1):
            level[o] = {}
            for g in level[o + 1]:
                level[o][g[1:]] = level[o].get(g[1:], 0) + 1

        def p(g: str, level=level) -> float:
            if not g:
                return 1 / (len(vocabulary) + 1)
            t = level[len(g)]
            n1, n2 = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
            d = n1 / (n1 + 2 * n2) if n1 else 0.5
            own = [v for k, v in t.items() if k[:-1] == g[:-1]]
            if not own:
                return p(g[1:])
            return max(0, t.get(g, 0) - d if g in t else 0) / sum(own) + min(1, d * len(own) / sum(own)) * p(g[1:])

        out[name] = -sum(math.log(p("".join(map(chr, s[i - 3 : i + 1])))) for i in range(3, len(s))) / (len(s) - 3)
    return out


def accepted(docs: DataFrame, model: Model, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs whose language is accepted, all columns as they are but lang, which becomes the language
    found. Null, empty and letterless texts go, as ``identify`` rejects them; rows that repeat stay as often as they
    are, a null id stays. An empty table gives no rows."""
    at, target = position(docs.columns, text), position(docs.columns, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for whole in batches:
            for b in text_batches(whole, whole.schema.names[at], BATCH):
                best, _, _, _, ok, _ = m.decide(b.column(at))
                columns = list(b.columns)
                columns[target] = pa.array([m.langs[x] if y else None for x, y in zip(best, ok, strict=True)], columns[target].type)
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array(ok))
        release()

    return map_rows(docs, run, [])
