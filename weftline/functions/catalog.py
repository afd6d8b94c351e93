"""Functions over product fields, urls, product JSON and captured pages, Column to Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import clean_plain, collapse, unescape

UNKNOWN_STOCK = "unknown"

# Product types and what names them, in the order they are tried.
TYPE_RULES = (
    ("shaving", ("after shave", "shave", "shaving", "razor")),
    ("body splash", ("body splash", "body fragrance", "body mist", "fragrance", "splash")),
    ("gel", (" gel", "gel ", "gel-")),
    ("oil", (" oil", "oil ", "oil-")),
    ("cream", ("cream", "lotion", "balsam", "moisturizer", "moisturising", "moisturizing")),
)

#: What a captured product payload is parsed as.
PRODUCT_JSON = "product struct<body_html: string, variants: array<struct<inventory_quantity: int, available: boolean>>>"


def stock_label(stock: Column) -> Column:
    number = stock.try_cast("double")
    whole = F.when(F.isnan(number) | (F.abs(number) > 9e18), None).otherwise(number).try_cast("bigint")
    return F.when(stock == "", "Stock unknown").when(whole.isNull(), F.concat(F.lit("Stock: "), stock)).when(whole <= 0, "Out of stock").otherwise(F.concat(whole.cast("string"), F.lit(" in stock")))


def clean_feature(x: Column) -> Column:
    """Without a count in brackets at the end."""
    return F.trim(F.regexp_replace(clean_plain(x), r"\s*\([0-9]+\)\s*$", ""))


def parse_features(x: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ";"), clean_feature), lambda y: y != ""))


def join_features(xs: Column) -> Column:
    """Features in one text, in an order that letter case doesn't change."""
    pairs = F.array_sort(F.transform(xs, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), "; ")


def normalize_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(clean_plain(x)), "[^a-z0-9]+", " "))


def product_handle(url: Column) -> Column:
    """The last part of a url's path if it comes right after /products/, else empty."""
    path = F.rtrim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.lower(F.regexp_extract(path, "/products/([^/]+)$", 1))


def product_json_url(url: Column) -> Column:
    x = clean_plain(url)
    bare = F.regexp_extract(x, r"^([^?#]*)", 1)
    anchor = F.regexp_extract(x, r"(#.*)$", 1)
    path = F.rtrim(bare, F.lit("/"))
    named = F.when(F.endswith(path, F.lit(".json")), path).otherwise(F.concat(path, F.lit(".json")))
    return F.when(F.contains(F.regexp_replace(bare, "^[a-z]+://[^/]*", ""), F.lit("/products/")), F.concat(named, anchor)).otherwise("")


def filter_url(url: Column, tag: Column) -> Column:
    """url with tag as its only filter.p.tag, and no page."""
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    rest = F.filter(query, lambda p: (p != "") & ~F.rlike(p, F.lit(r"^(filter\.p\.tag|page)=")))
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("?"), F.array_join(F.concat(rest, F.array(F.concat(F.lit("filter.p.tag="), F.url_encode(tag)))), "&"), F.regexp_extract(url, "(#.*)$", 1))


def product_type(name: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(clean_plain(name)), F.lit(" "))
    hit = lambda words: reduce(lambda a, b: a | b, [F.contains(padded, F.lit(w)) for w in words])
    return reduce(lambda c, r: c.when(hit(r[1]), r[0]), TYPE_RULES[1:], F.when(hit(TYPE_RULES[0][1]), TYPE_RULES[0][0])).otherwise("")


def numeric_stock(x: Column) -> Column:
    return F.rlike(clean_plain(x), F.lit("^[0-9]+$"))


def merge_stock(current: Column, detailed: Column, sold_out: Column) -> Column:
    """A detailed number first, then sold out, then what was known."""
    return F.when(clean_plain(detailed) != "", clean_plain(detailed)).when(F.coalesce(sold_out, F.lit(False)), "0").when(F.coalesce(current, F.lit("")).isin("", UNKNOWN_STOCK), UNKNOWN_STOCK).otherwise(current)


def html_to_text(x: Column) -> Column:
    return collapse(unescape(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", " ")))


def json_stock(variants: Column) -> Column:
    """Sum of the quantities; in stock if only some variant is there; 0 if none; unknown without variants."""
    quantities = F.filter(F.transform(variants, lambda v: v["inventory_quantity"]), lambda q: q.isNotNull())
    total = F.aggregate(quantities, F.lit(0).cast("long"), lambda a, q: a + q)
    return F.when(F.size(F.coalesce(variants, F.array())) == 0, UNKNOWN_STOCK).when(F.size(quantities) > 0, total.cast("string")).when(F.exists(variants, lambda v: F.coalesce(v["available"], F.lit(False))), "in stock").otherwise("0")


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first such element; nested tags of the same name aren't followed."""
    return html_to_text(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))


def meta_content(html: Column, name: str) -> Column:
    return collapse(unescape(F.regexp_extract(html, rf"(?is)<meta[^>]*name=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)", 1)))


def sold_out(html: Column) -> Column:
    return F.rlike(html_to_text(html), F.lit(r"(?i)sold\s*out")) | F.contains(html, F.lit("f-badge--soldout")) | F.rlike(html, F.lit(r"(?is)<button[^>]*name=[\"']add[\"'][^>]*\bdisabled"))


def first_filled(*xs: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs], F.lit(""))
