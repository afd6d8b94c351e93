"""Operator 7: quality rules, and an isolation forest over their statistics.

The rules count words, symbols, repeated lines and repeated windows of three words.
The forest is grown from the rows labelled good; its trees split a random statistic at a
random place, and documents that few splits set apart from good ones are anomalous. As
isolation forests are defined, each tree has a few rows of its own, drawn from all of
them. The threshold is where the scores of all rows labelled good and of all rows labelled
bad part best, with at least the given share of the good ones below it; a good row is
scored for it by the trees that weren't grown from it. The driver has
no more than the trees' rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import fresh, hash_share, materialize, shuffle_parts, small_batches, text_or_empty

#: Documents of fewer words fail, and those where more than this percentage of words is in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("chars_per_word", "symbols_per_char", "dup_line_share", "repeat_share", "capital_share", "mark_share", "digit_share")
#: Trees, and the rows that each draws from all good ones; the method's own figures.
TREES, TREE_ROWS = 100, 256
#: How far beyond the values of its rows a split can be, at least, so that what good rows never have can be split off.
ROOM = 0.2


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that the text has twice or more, the first time included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often, n, upto = {k for k, c in Counter(windows).items() if c > 1}, 0, 0
    for i, w in enumerate(windows):
        if w in often:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def counts(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    words = text.encode("utf-8", "surrogatepass").split()
    n, chars = len(words), len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dups, repeats = len(lines) - len(set(lines)), repeated_words(words)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    capital, marks, digits = kinds[65:91].sum(), kinds[33:48].sum() + kinds[58:65].sum(), kinds[48:58].sum()
    rates = (chars / n if n else 0, symbols / max(1, chars), dups / max(1, len(lines)), repeats / max(1, n), capital / max(1, chars), marks / max(1, chars), digits / max(1, chars))
    return (n, chars, symbols, dups, repeats), rates


def base_failed(n: int, repeats: int) -> bool:
    return n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts, base_failed and the rates of each row, null text as empty. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [counts(t.as_py()) for t in b.column(1)]
            cols = [pa.array([c[i] for c, _ in got], pa.int64()) for i in range(len(COUNTS))]
            failed = pa.array([base_failed(c[0], c[4]) for c, _ in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, failed, pa.array([r for _, r in got], pa.list_(pa.float64()))], ["id", *COUNTS, "base_failed", "rates"])

    shape = "".join(f", {c} long" for c in COUNTS)
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}{shape}, base_failed boolean, rates array<double>")


def features(rates: list[list[float]]) -> np.ndarray:
    """What trees split: the roots of shares, as the first few symbols tell most, and the log of characters in a word."""
    x = np.array(rates, float).reshape(-1, len(RATES))
    return np.column_stack([np.log(np.maximum(x[:, :1], 1)), np.sqrt(x[:, 1:])])


class IsolationForest:
    """Trees over random splits; score() is near 1 for what they isolate early.

    Each tree draws `sample` of the rows; drawn has the rows of each tree where that is done already.
    """

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = TREE_ROWS, seed: int = 7, drawn: list[np.ndarray] | None = None):
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(rows)) if drawn is None else max(map(len, drawn), default=0)
        self.depth = max(1, math.ceil(math.log2(max(2, self.size))))
        if drawn is None:
            drawn = (rows[rng.choice(len(rows), self.size, replace=False)] for _ in range(trees if len(rows) else 0))
        self.trees = [self._grow(part, rng) for part in drawn]

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        """Arrays by node: the statistic (-1: a leaf), its place, the first of two children, the path length of a leaf."""
        what, at, child, length = [], [], [], []

        def add() -> int:
            for x in (what, at, child, length):
                x.append(0)
            return len(what) - 1

        todo = [(add(), rows, 0)]
        while todo:
            node, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            if depth >= self.depth or len(part) <= 1:
                what[node], length[node] = -1, depth + expected_path(len(part))
                continue
            # the range is widened, so that values outside what was seen can be split off
            k = int(rng.integers(part.shape[1]))
            room = max(ROOM, 0.1 * (high[k] - low[k]))
            cut = rng.uniform(low[k] - room, high[k] + room)
            what[node], at[node] = k, cut
            a, b = add(), add()
            child[node] = a
            for c, rest in ((a, part[part[:, k] < cut]), (b, part[part[:, k] >= cut])):
                if len(rest):
                    todo.append((c, rest, depth + 1))
                else:
                    what[c], length[c] = -1, depth + 1
        return np.array(what), np.array(at, float), np.array(child), np.array(length, float)

    def score(self, rows: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        """seen (rows by trees): which trees are left out for a row, unless all would be."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        use = np.ones((len(rows), len(self.trees)), bool) if seen is None else ~seen | seen.all(1, keepdims=True)
        total = np.zeros(len(rows))
        for tree, (what, at, child, length) in enumerate(self.trees):
            node = np.zeros(len(rows), int)
            for _ in range(self.depth):
                k = what[node]
                inner = k >= 0
                if not inner.any():
                    break
                right = rows[np.arange(len(rows)), np.maximum(k, 0)] >= at[node]
                node = np.where(inner, child[node] + right, node)
            total += length[node] * use[:, tree]
        return 2.0 ** (-total / use.sum(1) / max(expected_path(self.size), 1e-9))


def expected_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def threshold(good: np.ndarray, bad: np.ndarray, keep_share: float) -> float:
    """The score, midway between two, where most of bad less the share of good is above, with keep_share of good at or below it at least; without bad, the quantile of good. The rule of best_place(), for arrays."""
    if not len(bad):
        return float(np.quantile(good, keep_share))
    at = np.unique(np.concatenate([good, bad]))
    at = np.append((at[1:] + at[:-1]) / 2, at[-1])
    lost = 1 - np.searchsorted(np.sort(good), at, "right") / len(good)
    caught = 1 - np.searchsorted(np.sort(bad), at, "right") / len(bad)
    gain = np.where(lost <= 1 - keep_share + 1e-12, caught - lost, -1.0)
    return float(at[np.flatnonzero(gain == gain.max())[-1]])


def best_place(scored: DataFrame, keep_share: float) -> float:
    """threshold() over all rows of scored (score, good, bad; the last two boolean), one good one at least. Scores are counted in ranges, so no task has them all."""
    spark = scored.sparkSession
    each = scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if("bad").alias("bad"))
    each = materialize(each.repartitionByRange(shuffle_parts(spark), "score").withColumn("part", F.spark_partition_id()), "label-scores")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = each.groupBy("part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    parts = parts.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_base") for c in "gb"))
    upto = Window.partitionBy("part").orderBy("score")
    upto = each.select("part", "score", F.sum("good").over(upto).alias("g"), F.sum("bad").over(upto).alias("b")).join(F.broadcast(parts), "part").select("score", (F.col("g") + F.col("g_base")).alias("g"), (F.col("b") + F.col("b_base")).alias("b"))
    n_good, n_bad = each.agg(F.sum("good"), F.sum("bad")).first()
    if not n_bad:
        k = keep_share * (n_good - 1)
        low, high = upto.agg(*(F.min(F.when(F.col("g") > F.lit(int(i)), F.col("score"))) for i in (math.floor(k), math.ceil(k)))).first()
        return low + (high - low) * (k - math.floor(k))
    lost, caught = 1 - F.col("g") / n_good, 1 - F.col("b") / n_bad
    best = upto.where(lost <= 1 - keep_share + 1e-12).agg(F.max(F.struct((caught - lost).alias("gain"), "score"))).first()[0]["score"]
    above = each.where(F.col("score") > F.lit(best)).agg(F.min("score")).first()[0]
    # two scores with no number between them have their midpoint on one of them
    return best if above is None or (best + above) / 2 >= above else (best + above) / 2


def fit(stats: DataFrame, labels: DataFrame, keep_share: float = 0.99, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> tuple[IsolationForest, float]:
    """A forest from all good labelled rows that pass the base rules, and its threshold from all labelled ones; 1.0, which rejects nothing, where fewer than two rows are good.

    labels: (doc_id, quality), 1 for good and 0 for bad. A tree's rows are those of the
    smallest hashes of tree and id, four fifths of the good ones at most, so that each row
    has trees that weren't grown from it.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("quality = 0")).alias("bad"))
    rows = stats.where(~F.col("base_failed")).join(marks, "id").select(F.xxhash64(F.lit(seed), "id").alias("h"), "good", "bad", "rates")
    rows = materialize(rows, "labelled-statistics")
    good = rows.where("good")
    n, n_ids = good.agg(F.count("*"), F.count_distinct("h")).first()
    if n < 2:
        return IsolationForest(np.empty((0, len(RATES))), seed=seed), 1.0
    size = min(tree_rows, n * 4 // 5)
    dealt = good.select("h", "rates", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("place", F.xxhash64("tree", "h"))
    order = Window.partitionBy("tree").orderBy("place", "h", "rates")
    dealt = dealt.where(hash_share(F.col("place"), size, n_ids)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= size)
    drawn: list[list] = [[] for _ in range(trees)]
    grown: dict[int, list[int]] = {}
    for tree, _, h, rates in sorted(dealt.select("tree", "k", "h", "rates").collect()):
        drawn[tree].append(rates)
        grown.setdefault(h, []).append(tree)
    forest = IsolationForest(np.empty((0, len(RATES))), seed=seed, drawn=[features(d) for d in drawn])
    model = stats.sparkSession.sparkContext.broadcast((forest, grown))

    @F.pandas_udf("double")
    def unseen_score(h, rates):
        import pandas as pd

        forest, grown = model.value
        seen = np.zeros((len(h), len(forest.trees)), bool)
        for i, x in enumerate(h):
            seen[i, grown.get(x, [])] = True
        return pd.Series(forest.score(features(rates.tolist()), seen))

    return forest, best_place(rows.select(unseen_score("h", "rates").alias("score"), "good", "bad"), keep_share)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_share: float = 0.99) -> DataFrame:
    """Each row's counts, base_failed, anomaly (the forest's score) and kept.

    Null and empty texts have no words and fail. Repeated rows are judged each for
    themselves; null ids stay null and can't be labelled. Other columns aren't looked at.
    """
    stats = materialize(statistics(docs, id_col, text_col), "rule-statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, keep_share))

    @F.pandas_udf("double")
    def anomaly(rates):
        import pandas as pd

        return pd.Series(model.value[0].score(features(rates.tolist())))

    scored = stats.withColumn("anomaly", anomaly("rates"))
    kept = ~F.col("base_failed") & (F.col("anomaly") <= F.lit(model.value[1]))
    return scored.select(F.col("id").alias(id_col), *COUNTS, "base_failed", kept.alias("kept"), "anomaly")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. Texts are gone through twice, but not shuffled or joined."""
    ok, = fresh(docs, "kept")
    model = docs.sparkSession.sparkContext.broadcast(fit(materialize(statistics(docs, id_col, text_col), "rule-statistics"), labels))

    @F.pandas_udf("boolean")
    def good(text):
        import pandas as pd

        got = [counts(t) for t in text]
        score = model.value[0].score(features([r for _, r in got]))
        return pd.Series([not base_failed(c[0], c[4]) and s <= model.value[1] for (c, _), s in zip(got, score, strict=True)], dtype=bool)

    return docs.withColumn(ok, good(text_or_empty(text_col))).where(F.col(ok)).drop(ok)
