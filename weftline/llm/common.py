"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.joins import join_one
from weftline.sources.tables import drop_tables, materialize, read_table, shared_dir, spread

__all__ = ["drop_tables", "fresh", "hash_share", "join_one", "materialize", "n_words", "shared_dir", "shuffle_parts", "small_batches", "table", "text_or_empty"]

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, name))


#: Rows that one Arrow batch has at most where texts go through Python.
BATCH_ROWS = 2048


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch to BATCH_ROWS: texts can be long, and a worker holds a batch and what is made of it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def hash_share(h: Column, most: int, rows: int) -> Column:
    """Whether a 64-bit hash is among the smallest, so that of that many rows (with distinct hashes) a little more than `most` are, all if there are fewer. No row goes to the driver for it."""
    part = (most + 10 * most**0.5 + 10) / max(1, rows)
    return F.lit(True) if part >= 1 else h < F.lit(int((part - 0.5) * 2.0**64))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        out.append(n)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """How many runs of WORD a text has, in the JVM; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
