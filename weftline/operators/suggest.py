"""Query suggestions: phrases with weights, and their ranking for what has been typed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import clean_text, suggestion_words
from weftline.operators.search import SYNONYMS

# Queries that are always suggested.
TEST_QUERIES = ("aloe vera shampoo", "beard oil", "baby wipes", "hair gel", "shaving cream", "curl defining shampoo", "children wipes", "anti dandruff shampoo")


#: Characters by which phrases and queries are brought together before they are compared.
GRAM = 3


def _prefixes(words: Column, most: int) -> Column:
    n = F.least(F.lit(most), F.size(words))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.array_join(F.slice(words, F.lit(1), k), " ").alias("phrase"), k.alias("size")))).otherwise(F.array().cast("array<struct<phrase:string,size:int>>"))


def _grams(words: Column) -> Column:
    def of(n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(of(2), of(3), of(4))


def suggestion_weights(docs: DataFrame, test_queries: Sequence[str] = TEST_QUERIES, synonyms: dict[str, list[str]] = SYNONYMS) -> DataFrame:
    """(phrase, weight) from fixed queries, synonyms, and docs (title, features, type); phrases of one letter are left out."""
    spark = docs.sparkSession
    fixed = [(q, 20) for q in test_queries] + [(t, 8) for t in synonyms] + [(v, 4) for vs in synonyms.values() for v in vs]
    fixed = spark.createDataFrame(fixed, "phrase string, weight long").select(F.lower(clean_text(F.col("phrase"))).alias("phrase"), "weight")
    title = docs.select(suggestion_words(F.col("title")).alias("w"))
    heads = title.select(F.inline(_prefixes(F.col("w"), 5))).select("phrase", (6 - F.col("size")).cast("long").alias("weight"))
    grams = title.select(F.explode(_grams(F.col("w"))).alias("phrase"))
    chunks = docs.select(F.explode(F.split(clean_text(F.col("features")), ";")).alias("c")).select(suggestion_words(F.col("c")).alias("w"))
    kinds = docs.select(suggestion_words(F.col("type")).alias("w"))
    out = fixed.unionByName(heads)
    for df in (grams, *[d.select(F.inline(_prefixes(F.col("w"), 3))).select("phrase") for d in (chunks, kinds)]):
        out = out.unionByName(df.select("phrase", F.lit(2).cast("long").alias("weight")))
    return out.where(F.length("phrase") >= 2).groupBy("phrase").agg(F.sum("weight").alias("weight"))


def suggestion_score(query: Column, phrase: Column, weight: Column) -> Column:
    """Null where phrase doesn't have the query in it, or is the query."""
    place = F.when(F.startswith(phrase, query), 1000.0).when(F.contains(phrase, F.concat(F.lit(" "), query)), 700.0).when(F.exists(F.split(phrase, " "), lambda w: F.startswith(w, query)), 450.0).when(F.contains(phrase, query), 200.0)
    return F.when(phrase != query, weight * 10.0 + place - F.length(phrase) * 0.25)


def suggest(queries: DataFrame, weights: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, rank, suggestion) by score, then the shorter, then the first by name. Queries of less than two letters have none.

    A phrase that has a query in it has the query's first GRAM characters in it, so the two
    meet in an equal join on these, and no phrase is compared with every query.
    """
    asked = queries.select("query_id", F.lower(clean_text(F.col("query"))).alias("q")).where(F.length("q") >= 2).withColumn("gram", F.left("q", F.lit(GRAM)))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("phrase") - (n - 1), F.lit(1))), lambda i: F.substring("phrase", i, F.lit(n)))
    listed = weights.select("phrase", "weight", F.explode(F.array_distinct(F.concat(*[grams(n) for n in range(2, GRAM + 1)]))).alias("gram"))
    scored = listed.join(asked, "gram").where(F.contains(F.col("phrase"), F.col("q"))).withColumn("score", suggestion_score(F.col("q"), F.col("phrase"), F.col("weight"))).where("score IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.length("phrase"), "phrase"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", F.col("phrase").alias("suggestion"), "score")
