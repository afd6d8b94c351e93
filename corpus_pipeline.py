"""A corpus pipeline of five stages: each works on the rows that the one before it kept.

Tables between the stages are written in the folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exact, mixing, pieces, quality, simhash
from weftline.llm.common import fresh, materialize, table
from weftline.llm.queries import MIX_SHARE, MIX_WEIGHTS, PIECES


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the forest doesn't find anomalous."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id."""
    return exact.drop_copies(docs, keep="min")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words), the document with the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded: none, once or twice."""
    mixed, times = fresh(docs, "mixed", "times")
    # one line for each id: rows that repeat an id share what is taken of it evenly
    taken = mixing.mix(docs, MIX_WEIGHTS, MIX_SHARE).groupBy(F.col("doc_id").alias(mixed)).agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
    taken = taken.select(mixed, F.coalesce(F.floor(F.col("t") / F.nullif("s", F.lit(0)) + 0.5), F.lit(0)).cast("int").alias(times)).where(F.col(times) > 0)
    out = docs.join(taken, docs["doc_id"].eqNullSafe(taken[mixed]))
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, their digest, and whether they decode to the text."""
    return pieces.encode_documents(docs, public_tokenizers.path(PIECES), keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("encode pieces", encode_pieces),
]

#: The forest, the fingerprints and the pieces aren't expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
