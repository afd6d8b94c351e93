"""The application surface: health, search and suggestions over one index, with checked parameters."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import clean_text
from weftline.operators import search as S
from weftline.operators.suggest import suggest, suggestion_weights

TRUE = frozenset(("1", "true", "yes", "on"))


def as_bool(value: object, default: bool) -> bool:
    return default if value is None else str(value).strip().lower() in TRUE


def as_number(value: object, default: float, low: float, high: float) -> float:
    """A number within bounds; the default where it doesn't parse."""
    try:
        n = type(default)(str(value))
    except ValueError:
        n = default
    return max(low, min(high, n if n == n else default))


def options(params: dict[str, object]) -> S.Options:
    """Search options from text parameters. Near terms are always on here, whatever is asked."""
    n = lambda k, d, low, high: as_number(params.get(k), d, low, high)
    return S.Options(top_k=n("top_k", 25, 1, 50), feedback_docs=n("feedback_docs", 5, 1, 20), feedback_terms=n("feedback_terms", 5, 1, 20), embedding_top_n=n("embedding_top_n", 5, 1, 20), embedding_min_sim=n("embedding_min_sim", 0.35, 0.0, 1.0), use_synonyms=as_bool(params.get("use_synonyms"), True), use_feedback=as_bool(params.get("use_feedback"), True), use_embeddings=True)


def encoder(backend: str, index: S.SearchIndex) -> Callable | None:
    """Near terms by backend: bert falls back to hashed trigrams, elmo and rnn need models that aren't here, so they give no terms."""
    kind = backend.strip().lower()
    if kind in ("bert", "hash"):
        return lambda terms, n, min_sim: S.near_terms_in(terms, index.term_vectors, n, min_sim)
    if kind in ("elmo", "rnn"):
        return None
    raise ValueError(f"unknown backend {backend!r}")


class SearchEngine:
    """docs: search documents with doc_pos, id, title and so on."""

    def __init__(self, spark: SparkSession, docs: DataFrame):
        self.spark, self.docs = spark, docs.cache()
        self.index = S.SearchIndex(self.docs)
        self.weights = suggestion_weights(self.docs).cache()

    def _one(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query)], "query_id long, query string")

    def health(self) -> DataFrame:
        return self.index.stats().select(F.lit("ok").alias("status"), "documents", "vocabulary_terms")

    def search(self, query: str, backend: str = "bert", **params: object) -> DataFrame:
        return self.answer(query, backend, **params)[0]

    def search_once(self, query: str, top_k: int = 10, use_synonyms: bool = True, use_feedback: bool = True, use_embeddings: bool = False, backend: str = "bert") -> DataFrame:
        """search() with the switches of the command line, where near terms are off unless they are asked for."""
        o = S.Options(top_k=top_k, use_synonyms=use_synonyms, use_feedback=use_feedback, use_embeddings=use_embeddings)
        return self.search_all(self._one(query), o, backend)

    def search_all(self, queries: DataFrame, o: S.Options, backend: str = "bert") -> DataFrame:
        return self._found(self._expand(queries, o, backend), o)

    def _expand(self, queries: DataFrame, o: S.Options, backend: str) -> S.Expansion:
        return S.expand(queries, self.index, o, encoder(backend, self.index) if o.use_embeddings else None)

    def _found(self, e: S.Expansion, o: S.Options) -> DataFrame:
        found = S.top(S.score_candidates(e.candidates, e.vector, self.index), o.top_k)
        return found.join(self.docs, "doc_pos").orderBy("query_id", "rank")

    def answer(self, query: str, backend: str = "bert", **params: object) -> tuple[DataFrame, DataFrame]:
        """Results and expansion of a query, from one expansion."""
        if not (query or "").strip():
            raise ValueError("a query is required")
        o, q = options(params), self._one(query)
        e = self._expand(q, o, backend)
        return self._found(e, o), self._shown(q, e)

    def expansion(self, query: str, backend: str = "bert", **params: object) -> DataFrame:
        """One row: the query and lists of its base, synonym, feedback, near and expanded terms, and queries to go on with."""
        q = self._one(query)
        return self._shown(q, self._expand(q, options(params), backend))

    def _shown(self, q: DataFrame, e: S.Expansion) -> DataFrame:
        ordered = lambda df, by: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, "term"))), lambda x: x["term"]).alias("x"))
        out = q.select("query_id", clean_text(F.col("query")).alias("query")).join(ordered(e.base, "first_pos").withColumnRenamed("x", "base_terms"), "query_id", "left")
        for kind in ("synonym", "feedback", "embedding"):
            out = out.join(ordered(e.terms.where(F.col("kind") == kind), "place").withColumnRenamed("x", f"{kind}_terms"), "query_id", "left")
        out = out.join(ordered(e.terms, "place").withColumnRenamed("x", "expanded_terms"), "query_id", "left")
        more = S.suggested_queries(q, e.terms).select("query_id", "ord", F.col("suggestion").alias("term"))
        out = out.join(ordered(more, "ord").withColumnRenamed("x", "suggested_queries"), "query_id", "left")
        return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in out.columns[2:]}).drop("query_id")

    def evaluate(self, queries: Sequence[str], labels: Mapping[str, Sequence[int]] | None = None, top_k: int = 10) -> tuple[DataFrame, DataFrame]:
        """Each query's results, latency, precision, recall and relevant documents, and their means.

        Relevant are the documents that labels name by their places, else (heuristic) those
        with all of the query's terms. Queries run one by one, as latency is of each alone.
        """
        labels, rows = labels or {}, []
        for query in queries:
            q, began = self._one(query), time.perf_counter()
            found = {r["doc_pos"] for r in self.search_all(q, S.Options(top_k=top_k)).select("doc_pos").collect()}
            took = (time.perf_counter() - began) * 1000
            relevant = set(labels[query]) if query in labels else None
            if relevant is None:
                named = S.relevant_by_terms(q, self.index)
                n, hits = named.count(), named.where(F.col("doc_pos").isin(*found)).count() if found else 0
            else:
                n, hits = len(relevant), len(found & relevant)
            rows.append((query, len(found), round(took, 2), round(hits / len(found), 3) if found else 0.0, round(hits / n, 3) if n else 0.0, n, "heuristic" if relevant is None else "manual"))
        out = self.spark.createDataFrame(rows, "query string, results long, latency_ms double, precision_at_k double, recall_at_k double, relevant_docs long, label_source string")
        means = [F.round(F.avg(a), n).alias(b) for a, n, b in (("latency_ms", 2, "avg_latency_ms"), ("precision_at_k", 3, "mean_precision_at_k"), ("recall_at_k", 3, "mean_recall_at_k"))]
        return out, out.agg(F.count("*").alias("queries"), *means)

    def brief(self, query: str, **params: object) -> DataFrame:
        return self.search(query, **params).select("title", "score", "metadata", "snippet")

    def suggest(self, query: str, limit: object = 8) -> DataFrame:
        return suggest(self._one(query or ""), self.weights, as_number(limit, 8, 1, 12)).orderBy("rank").select("suggestion")
