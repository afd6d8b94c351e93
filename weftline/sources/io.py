"""Readers and writers with fixed schemas."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.catalog import PRODUCT_JSON, html_to_text, join_features, json_stock, normalize_name
from weftline.functions.text import clean_plain, clean_text

PRODUCT_COLUMNS = ("name of product", "price", "how many in stock", "description", "type", "features")
MAIL_COLUMNS = ("email_id", "from_name", "subject", "body", "skill_gap", "behavior_flag")
POST_COLUMNS = ("views", "likes", "created_at")


def normal_header(name: str) -> str:
    return re.sub(r"\s+", " ", name.strip().lower())


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")
    return df


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, ignoreLeadingWhiteSpace=True, escape='"')


def products(df: DataFrame) -> DataFrame:
    """The six product columns as clean text; headers in any case and spacing."""
    df = df.toDF(*map(normal_header, df.columns))
    require_columns(df, PRODUCT_COLUMNS, "product table")
    return df.select(*[clean_text(F.col(f"`{c}`")).alias(c) for c in PRODUCT_COLUMNS])


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return products(_csv(spark, path))


def read_mails(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(_csv(spark, path), MAIL_COLUMNS, "mail table").select(*MAIL_COLUMNS)


def posts(df: DataFrame) -> DataFrame:
    """views, likes, created_at (null if it is no time) and like_rate (null without views)."""
    require_columns(df, POST_COLUMNS, "post table")
    when = F.try_to_timestamp(F.col("created_at").cast("string")).cast("timestamp_ntz")
    return df.withColumn("created_at", when).withColumn("like_rate", F.col("likes") / F.nullif("views", F.lit(0)))


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    require_columns(df, POST_COLUMNS, "post table")
    return posts(df.withColumns({c: F.col(c).try_cast("bigint") for c in ("views", "likes")}))


def store_rows(df: DataFrame, order: str) -> DataFrame:
    """Products by normal name: of rows with one name the last in order counts, at the place of the first. Rows without a name go."""
    rows = df.withColumn("key", normalize_name(F.col("name"))).where(clean_plain(F.col("name")) != "")
    best = rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in df.columns if c != order]), order).alias("r"), F.min(order).alias("position"))
    return best.select("key", "position", "r.*")


def product_lines(df: DataFrame) -> DataFrame:
    """(name, price, stock, description, type, features array) as the six columns of a product file."""
    return df.select(F.col("name").alias("name of product"), "price", F.col("stock").alias("how many in stock"), "description", "type", join_features(F.col("features")).alias("features"))


def write_products(df: DataFrame, path: str) -> None:
    product_lines(df).write.mode("overwrite").csv(path, header=True)


def _time(at: Column | str, form: str) -> Column:
    """date_format() for forms that begin with the year, without the plus sign of years after 9999."""
    return F.ltrim(F.date_format(at, form), F.lit("+"))


def post_rows(items: DataFrame) -> DataFrame:
    """Posts of a social feed: counts default to 0, epoch seconds become a UTC time."""
    created = _time(F.timestamp_seconds(F.coalesce("createTime", F.lit(0))), "yyyy-MM-dd HH:mm:ss")
    return items.select(F.coalesce("playCount", F.lit(0)).alias("views"), F.coalesce("diggCount", F.lit(0)).alias("likes"), created.alias("created_at"))


def message_rows(items: DataFrame) -> DataFrame:
    """Short messages in ten flat columns, null as empty or 0."""
    text = lambda c, to: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
    number = lambda c, to: F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(to)
    made = F.coalesce(_time("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("created_at")
    return items.select(text("id", "id"), made, text("username", "username"), text("rawContent", "content"), *[number(f"{a}Count", b) for a, b in (("view", "views"), ("like", "likes"), ("reply", "replies"), ("retweet", "retweets"), ("quote", "quotes"))], text("lang", "lang"))


def product_payloads(df: DataFrame, payload: str) -> DataFrame:
    """description and stock of captured product JSON; what doesn't parse has neither."""
    return df.withColumn("p", F.from_json(payload, PRODUCT_JSON)["product"]).withColumn("description", F.when(F.col("p").isNotNull(), html_to_text(F.col("p.body_html")))).withColumn("stock", F.when(F.col("p").isNotNull(), json_stock(F.col("p.variants")))).drop("p")


def write_index(index, documents: DataFrame, path: str) -> None:
    """A search index as JSON lines: docs, vocabulary, vectors and postings in folders of their own."""
    for name, df in index_tables(index, documents).items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def index_tables(index, documents: DataFrame) -> dict[str, DataFrame]:
    vocabulary = index.vocabulary()
    vectors = index.vectors.join(vocabulary, "term").groupBy("doc_pos").agg(F.sort_array(F.collect_list(F.struct("ordinal", F.round("weight", 6).alias("weight")))).alias("vector"))
    return {
        "docs": documents.select("id", "title", "category", "snippet", "metadata", "date"),
        "vocabulary": vocabulary.join(index.idf, "term").select("ordinal", "term", F.round("idf", 6).alias("idf")),
        "vectors": index.norms.join(vectors, "doc_pos", "left").select("doc_pos", F.round("norm", 6).alias("norm"), "vector"),
        "postings": index.posting_lists,
    }
