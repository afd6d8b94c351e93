"""Summaries of posts by account."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summarize(posts: DataFrame) -> DataFrame:
    """posts: account, views, likes, created_at, like_rate; one row for each account, in one aggregation."""
    each = lambda c: (F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_total"), F.avg(c).alias(f"{c}_avg"), F.median(c).alias(f"{c}_median"))
    return posts.groupBy("account").agg(F.count("*").alias("posts"), *each("views"), *each("likes"), F.avg("like_rate").alias("like_rate_avg"), F.min("created_at").alias("date_min"), F.max("created_at").alias("date_max"))


def summary_of_all(posts: DataFrame) -> DataFrame:
    """summarize() as if all posts were one account's; one row even for no posts."""
    some = summarize(posts.withColumn("account", F.lit("all")))
    return posts.sparkSession.createDataFrame([("all",)], "account string").join(some, "account", "left").na.fill(0, ["posts", "views_total", "likes_total"])


def top_posts(posts: DataFrame, order: str, limit: int = 5) -> DataFrame:
    """Each account's posts with most views; of equal ones the first by order."""
    rank = F.row_number().over(Window.partitionBy("account").orderBy(F.desc("views"), order))
    return posts.withColumn("rank", rank).where(F.col("rank") <= limit)


def weekly(posts: DataFrame) -> DataFrame:
    """Views and likes by account and week from Monday on; weeks without posts have no row."""
    week = F.date_trunc("week", F.col("created_at")).cast("timestamp_ntz")
    return posts.where("created_at IS NOT NULL").groupBy("account", week.alias("week_start")).agg(F.sum("views").alias("views"), F.sum("likes").alias("likes"))
