"""Catalog ingest: keyed merging of product events, and extraction from captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.catalog import UNKNOWN_STOCK, clean_feature, first_filled, html_to_text, meta_content, normalize_name, numeric_stock, product_handle, product_type, sold_out, tag_text
from weftline.functions.text import clean_plain, collapse


def event_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, name, url, price, description, stock, features, position): what each event (name, url, price, description, stock, sold_out, features array) says, with its place in order."""
    clean = lambda c: F.nullif(clean_plain(F.col(c)), F.lit(""))
    e = events.select(F.col(key).alias("key"), F.col(order).alias("position"), *[clean(c).alias(c) for c in ("name", "url", "price", "description", "stock")], "sold_out", F.filter(F.transform("features", clean_feature), lambda x: x != "").alias("features"))
    e = e.where("name IS NOT NULL").withColumn("stock", F.coalesce("stock", F.when(F.col("sold_out"), "0")))
    return e.select("key", *[F.when(F.col(c).isNotNull(), F.struct(F.col("position").alias("at"), F.col(c).alias("value"))).alias(c) for c in ("name", "url", "price", "description", "stock")], "features", "position")


def combine_states(states: DataFrame) -> DataFrame:
    """One state for each key. One aggregation that combines before the shuffle, as every part is the least or the greatest by order; states of states are the same."""
    features = F.array_sort(F.array_distinct(F.flatten(F.collect_set("features")))).alias("features")
    return states.groupBy("key").agg(*[F.min(c).alias(c) for c in ("name", "url")], *[F.max(c).alias(c) for c in ("price", "description", "stock")], features, F.min("position").alias("position"))


def records(state: DataFrame) -> DataFrame:
    """The records that states tell of."""
    or_empty = lambda c, other="": F.coalesce(F.col(c)["value"], F.lit(other)).alias(c)
    out = state.select("key", F.col("name")["value"].alias("name"), or_empty("url"), or_empty("price"), or_empty("description"), or_empty("stock", UNKNOWN_STOCK), "features", "position")
    return out.withColumn("type", product_type(F.col("name")))


def merge_events(events: DataFrame, key: str, order: str) -> DataFrame:
    """One record for each key of events (name, url, price, description, stock, sold_out, features array).

    First non-empty name and url, last non-empty price and description, the last stock
    that an event knows (sold out is 0), all features.
    """
    return records(combine_states(event_state(events, key, order)))


def match_records(incoming: DataFrame, records: DataFrame) -> DataFrame:
    """Adds record_key to incoming (name, url): the record with the url's handle, else that with the name, else null. records: (key, name, url)."""
    handle, name = product_handle(F.col("url")), normalize_name(F.col("name"))
    by_url = records.where(handle != "").groupBy(handle.alias("_h")).agg(F.max("key").alias("_by_url"))
    by_name = records.where(name != "").groupBy(name.alias("_n")).agg(F.max("key").alias("_by_name"))
    out = incoming.withColumn("_h", handle).withColumn("_n", name).join(by_url, "_h", "left").join(by_name, "_n", "left")
    return out.withColumn("record_key", F.coalesce("_by_url", "_by_name")).drop("_h", "_n", "_by_url", "_by_name")


def add_features(records: DataFrame, incoming: DataFrame) -> DataFrame:
    """records with the features of matched incoming rows (name, url, feature); rows that match no record are dropped."""
    met = match_records(incoming, records).where("record_key IS NOT NULL").select(F.col("record_key").alias("key"), clean_feature(F.col("feature")).alias("f")).where("f != ''")
    new = met.groupBy("key").agg(F.collect_set("f").alias("_new"))
    return records.join(new, "key", "left").withColumn("features", F.array_sort(F.array_union("features", F.coalesce("_new", F.array().cast("array<string>"))))).drop("_new")


def page_details(pages: DataFrame, html: str = "html") -> DataFrame:
    """title, description and stock of captured product pages, from the first place that has them."""
    h = F.col(html)
    ld = F.from_json(F.regexp_extract(h, r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1), "`@type` string, name string, description string")
    number = F.regexp_extract(html_to_text(h), r"(?i)\b([0-9]+)\s+(?:left\s+)?in stock", 1)
    stock = first_filled(number, F.when(sold_out(h), "0").otherwise(""), F.when(F.rlike(h, F.lit("(?i)add to cart")), "in stock").otherwise(""))
    described = first_filled(tag_text(h, "p"), meta_content(h, "description"), collapse(F.coalesce(F.when(ld["@type"] == "Product", ld["description"]), F.lit(""))))
    return pages.withColumn("title", first_filled(tag_text(h, "h1"), tag_text(h, "title"))).withColumn("description", described).withColumn("stock", stock)


def cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """(…, card, url, name, price, sold_out): links of captured pages as product cards, one row each."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?is)(<a\b[^>]*href=["\'][^"\']*["\'][^>]*>.*?</a>)'), F.lit(1))
    each = pages.select(*[c for c in pages.columns if c != html], F.posexplode(found).alias("card", "a"))
    out = each.select("*", F.regexp_extract("a", r'(?is)href=["\']([^"\']*)', 1).alias("href"), html_to_text(F.col("a")).alias("name"), F.regexp_extract("a", r"(?is)price-item--(?:sale|regular)[^>]*>([^<]*)", 1).alias("price"), sold_out(F.col("a")).alias("sold_out"))
    return out.where("name != ''").drop("a")


def filter_options(options: DataFrame) -> DataFrame:
    """(page, label, value, disabled, pos): options by page that can be chosen, once for each value in any case, labels without counts."""
    usable = options.where(~F.coalesce("disabled", F.lit(False)) & (clean_plain(F.col("value")) != "") & (clean_feature(F.col("label")) != ""))
    rank = F.row_number().over(Window.partitionBy("page", F.lower(clean_plain(F.col("value")))).orderBy("pos"))
    return usable.withColumn("r", rank).where("r = 1").select("page", "pos", clean_feature(F.col("label")).alias("label"), clean_plain(F.col("value")).alias("value"))


def fill_details(records: DataFrame, details: DataFrame, fallback: DataFrame) -> DataFrame:
    """records (key, description, stock) with what is missing or inexact from details, then from fallback (key, description, stock)."""
    side = lambda df, p: df.select("key", F.coalesce("description", F.lit("")).alias(f"{p}_d"), F.coalesce("stock", F.lit("")).alias(f"{p}_s"))
    r = records.join(side(details, "a"), "key", "left").join(side(fallback, "b"), "key", "left").na.fill("", ["a_d", "a_s", "b_d", "b_s"])
    short = F.col("description") == ""
    inexact = ~numeric_stock(F.col("stock"))
    ask = short | inexact
    ask_more = (short & (F.col("a_d") == "")) | (inexact & ~numeric_stock(F.col("a_s")))
    text = first_filled(F.col("a_d"), F.when(ask_more, F.col("b_d")).otherwise(""))
    better = F.when(ask_more & (F.col("b_s") != "") & ((F.col("a_s") == "") | (~numeric_stock(F.col("a_s")) & numeric_stock(F.col("b_s")))), F.col("b_s")).otherwise(F.col("a_s"))
    out = r.withColumn("d", F.when(ask, text).otherwise("")).withColumn("s", F.when(ask, better).otherwise(""))
    return out.withColumn("description", first_filled(F.col("d"), F.col("description"))).withColumn("stock", first_filled(F.col("s"), F.col("stock"))).drop("a_d", "a_s", "b_d", "b_s", "d", "s")
