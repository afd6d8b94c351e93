"""Operator 8: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word starts that labelled toxic documents have and
others hardly do. Features are how many of a document's words are in it and how close
these are to words of the second person, and the rates of capitals, punctuation and
obfuscated words. Lexicon and trees are learned from a bounded sample of labelled rows. Its folds are
scored by models of the other folds, which have seen neither their words nor their
features, and these scores turn the trees' sums into probabilities that never fall as
the sum rises.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, hash_share, materialize, small_batches, text_or_empty

# Words of the second person in four languages, and characters that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton ta tes vous votre vos usted ustedes tú ti vosotros vuestro".split())
LOOKALIKES = str.maketrans("013457@$", "oieastas")

#: Labelled rows of each class that are learned from, and entries of the lexicon, at most.
SAMPLE, LEXICON = 10_000, 2000
STARTS = (4, 5, 6)
#: Parts of the sample that are left out in turn.
FOLDS = 3
FEATURES = ("log_words", "hit_rate", "log_hits", "kinds", "strongest", "near_second_person", "capitals", "punctuation", "shouts", "obfuscated")


def plain(word: str) -> str:
    """A word in lower case, look-alike characters as letters, without what isn't a letter."""
    low = word.lower()
    if low.isalpha():
        return low
    return re.sub(r"[^\w]|[\d_]", "", low.translate(LOOKALIKES) if any(c.isalpha() for c in word) else word)


class _Words(dict):
    """Places of words in arrays: their weight by each lexicon, their plain form, and whether they are obfuscated or of the second person."""

    def __init__(self, lexicons: Sequence[dict[str, float]], most: int = 1 << 18):
        super().__init__()
        self.lexicons, self.most = lexicons, most
        self.room(1 << 12)

    def room(self, n: int) -> None:
        """Arrays for n words, empty."""
        self.clear()
        self.plain_of: dict[str, int] = {}
        self.weight, self.plain = np.zeros((len(self.lexicons), n)), np.zeros(n, np.int64)
        self.odd, self.second = np.zeros(n, bool), np.zeros(n, bool)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at >= len(self.plain):
            self.weight = np.concatenate([self.weight, np.zeros_like(self.weight)], 1)
            self.plain, self.odd, self.second = (np.concatenate([x, np.zeros_like(x)]) for x in (self.plain, self.odd, self.second))
        p = plain(word)
        ends = [f"={p}", *(f"{n}{p[:n]}" for n in STARTS if len(p) >= n)]
        for k, lexicon in enumerate(self.lexicons):
            weight = max([lexicon.get(x, 0.0) for x in ends])
            if weight:
                self.weight[k, at] = weight
        if not word.isalpha():
            inner = word.strip("!?.,;:\"'()[]{}#*$%&|<>-_")
            self.odd[at] = not inner.isalpha() and any(c.isalpha() for c in inner) and any(not c.isalpha() and c not in "'’-" for c in inner)
        self.second[at] = p in SECOND_PERSON
        self.plain[at] = self.plain_of.setdefault(p, len(self.plain_of))
        self[word] = at
        return at


def features(text: str, words: _Words) -> np.ndarray:
    """A row of features for each lexicon."""
    if len(words) > words.most:
        words.room(1 << 12)  # what has been met is worked out anew
    tokens = text.split()
    at = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    n, chars = max(1, len(tokens)), max(1, len(text))
    kinds = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    rest = (kinds[65:91].sum() / chars, (kinds[33:48].sum() + kinds[58:65].sum()) / chars, kinds[33] / chars, words.odd[at].sum() / n)
    second, out = np.flatnonzero(words.second[at]), np.zeros((len(words.lexicons), len(FEATURES)))
    out[:, 0], out[:, 6:] = math.log1p(len(tokens)), rest
    for k, weights in enumerate(words.weight):
        w = weights[at]
        hits = np.flatnonzero(w)
        if not len(hits):
            continue
        near = 0
        if len(second):
            a = np.searchsorted(second, hits)
            away = np.minimum(np.abs(hits - second[np.maximum(a - 1, 0)]), np.abs(hits - second[np.minimum(a, len(second) - 1)]))
            near = int((away <= 5).sum())
        out[k, 1:6] = len(hits) / n, math.log1p(len(hits)), len(np.unique(words.plain[at[hits]])), w.max(), near
    return out


def learn_lexicons(rows: DataFrame, most: int = LEXICON) -> list[dict[str, float]]:
    """Log odds of the words ("=word") and word starts ("4abcd") that are far likelier in toxic texts of rows (text, toxic, fold): without each fold in turn, then of all. Rows are gone through once."""
    words = F.filter(F.transform(F.split(F.lower("text"), SPACE), lambda w: F.regexp_replace(w, r"[^\p{L}]", "")), lambda w: F.length(w) > 1)
    starts = [F.transform(F.filter("w", lambda x, n=n: F.length(x) >= n), lambda x, n=n: F.concat(F.lit(str(n)), F.substring(x, 1, n))) for n in STARTS]
    terms = rows.withColumn("w", words).select("toxic", "fold", F.explode(F.array_distinct(F.concat(F.transform("w", lambda x: F.concat(F.lit("="), x)), *starts))).alias("term"))
    counts = lambda: [f(F.when(F.col("fold") == k, c)).alias(f"{n}{k}") for k in range(FOLDS) for n, f, c in (("t", F.sum, F.col("toxic")), ("n", F.count, F.lit(1)))]
    sums = rows.agg(*counts()).first().asDict()
    least = 3
    by = materialize(terms.groupBy("term").agg(*counts()).na.fill(0).where(sum((F.col(f"t{k}") for k in range(FOLDS)), F.lit(0)) >= least), "toxic-terms")
    out = []
    for left in (*range(FOLDS), None):
        folds = [k for k in range(FOLDS) if k != left]
        n_toxic, n_all = (sum(sums[f"{c}{k}"] or 0 for k in folds) for c in "tn")
        if not n_toxic:
            out.append({})
            continue
        t, n = (sum((F.col(f"{c}{k}") for k in folds), F.lit(0)) for c in "tn")
        odds = F.log(((t + 0.1) / n_toxic) / ((n - t + 0.1) / max(1, n_all - n_toxic)))
        best = by.select("term", t.alias("t"), odds.alias("odds")).where((F.col("t") >= max(least, n_toxic // 1000)) & (F.col("odds") >= 3)).orderBy(F.desc(F.col("odds") * F.sqrt("t")), "term").limit(most)
        out.append({r["term"]: float(r["odds"]) for r in best.collect()})
    return out


class BoostedTrees:
    """Trees of depth 3 on the logistic loss, split at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, least: int = 8, bins: int = 32):
        mean = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        self.start, self.rate, self.trees = math.log(mean / (1 - mean)), rate, []
        if not len(y) or y.min() == y.max():
            return
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], 1)
        f = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, edges, y - p, p * (1 - p), np.arange(len(y)), 3, least)
            self.trees.append(tree)
            f += rate * self._value(tree, x)

    def _grow(self, binned, edges, g, h, rows, depth, least):
        leaf = float(np.clip(g[rows].sum() / (h[rows].sum() + 1.0), -4, 4))
        if depth == 0 or len(rows) < 2 * least:
            return leaf
        best = (1e-6, None, None)
        all_g, all_h = g[rows].sum(), h[rows].sum() + 1.0
        for k, e in enumerate(edges):
            b = binned[rows, k]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            if not len(gs):
                continue
            gain = gs**2 / (hs + 1.0) + (all_g - gs) ** 2 / (all_h - hs) - all_g**2 / all_h
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), k, i)
        _, k, i = best
        if k is None:
            return leaf
        left = binned[rows, k] <= i
        return k, float(edges[k][i]), self._grow(binned, edges, g, h, rows[left], depth - 1, least), self._grow(binned, edges, g, h, rows[~left], depth - 1, least)

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        k, cut, a, b = tree
        return np.where(x[:, k] < cut, self._value(a, x), self._value(b, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing function nearest to y over x, by pooling neighbours that fall."""
    values, at = np.unique(x, return_inverse=True)  # rows with one x are one step
    blocks: list[list[float]] = []  # sum, weight, highest x
    for v, total, n in zip(values.tolist(), np.bincount(at, y, len(values)).tolist(), np.bincount(at, minlength=len(values)).tolist(), strict=True):
        blocks.append([total, n, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, top]
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class ToxicModel:
    def __init__(self, lexicon: dict[str, float], x: Sequence[np.ndarray], y: np.ndarray, fold: np.ndarray):
        """x: the rows' features by the lexicon without each fold, then by the lexicon of all."""
        self.lexicon = lexicon
        self.trees = BoostedTrees(x[-1], y)
        raw = np.zeros(len(y))
        for k in range(FOLDS):
            held = fold == k
            if held.any() and len(set(y[~held].tolist())) == 2:
                raw[held] = BoostedTrees(x[k][~held], y[~held]).raw(x[k][held])
            else:  # too few rows to leave some out
                raw[held] = self.trees.raw(x[-1][held])
        self.at, self.p = isotonic(raw, y) if len(y) else (np.zeros(1), np.zeros(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        # a little of the raw score keeps the order within a step, on the step's side of one half
        step = self.p[np.minimum(np.searchsorted(self.at, raw), len(self.p) - 1)]
        fine = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        out = 0.998 * step + 0.002 * fine
        return np.clip(np.where(step >= 0.5, np.maximum(out, 0.5), np.minimum(out, 0.4999)), 0, 1)


def held_out(id_col: str, folds: int = 5, of: int = 0):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == of


_words: dict[int, _Words] = {}


def _of(lexicons: Sequence[dict[str, float]]) -> _Words:
    """The words that this Python worker has met, by the lexicons of its last task."""
    key = hash(tuple(frozenset(x.items()) for x in lexicons))
    if key not in _words:
        _words.clear()
        _words[key] = _Words(lexicons)
    return _words[key]


def _measure(docs: DataFrame, lexicons: Sequence[dict[str, float]]) -> DataFrame:
    """(id, out): each row's features by each lexicon, one after the other."""
    kind = docs.schema["id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _of(lexicons)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py(), words).ravel() for t in b.column(1)], pa.list_(pa.float64()))], ["id", "out"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, out array<double>")


def _scored(docs: DataFrame, model) -> DataFrame:
    """(id, score) by a broadcast model."""
    kind = docs.schema["id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _of([model.value.lexicon])
        for b in batches:
            x = np.array([features(t.as_py(), words)[0] for t in b.column(1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score(x))], ["id", "score"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, score double")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Learns from labelled rows that aren't held out: of each class those with the smallest hashes of ids, `sample` at most."""
    known = labels.where("toxic IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out("id"))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64(F.lit(3), "id"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # a row for each class
    some = []
    for toxic in (1, 0):
        rows = known.where((F.col("toxic") == toxic) & hash_share(F.col("h"), sample, sizes.get(toxic, 0)))
        some += sorted((tuple(r) for r in rows.collect()), key=lambda r: r[2])[:sample]
    some = docs.sparkSession.createDataFrame(some, known.schema).withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int"))
    rows = materialize(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(some), "id"), "toxic-sample")
    lexicons = learn_lexicons(rows.select("text", "toxic", "fold"))
    got = _measure(rows, lexicons).join(F.broadcast(some), "id").select("out", "toxic", "h", "fold").collect()
    got.sort(key=lambda r: (r["h"], r["out"]))
    x = np.array([r["out"] for r in got], float).reshape(-1, FOLDS + 1, len(FEATURES))
    return ToxicModel(lexicons[-1], [x[:, k] for k in range(FOLDS + 1)], np.array([r["toxic"] for r in got], float), np.array([r["fold"] for r in got], int))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's held_out, score (0 to 1) and predicted (1 from 0.5 on).

    Null text counts as empty, and empty texts get the score of their features. A null id
    is never held out or labelled. Without labels of both classes all scores are near the
    share of toxic labels. Repeated rows have equal scores; other columns aren't looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    out = _scored(rows, model)
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
