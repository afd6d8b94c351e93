"""Search documents from product rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.catalog import first_filled, stock_label

SNIPPET = 180


def build_documents(products: DataFrame) -> DataFrame:
    """products: doc_pos and the six product columns, clean. id is doc_pos + 1 as text."""
    name, price, stock, text, kind, features = (F.col(f"`{c}`") for c in ("name of product", "price", "how many in stock", "description", "type", "features"))
    status = stock_label(stock)
    shown = [F.when((x != "") & (F.lower(x) != "nan"), x) for x in (kind, features, price, status)]
    d = products.select("doc_pos", (F.col("doc_pos") + 1).cast("string").alias("id"), first_filled(name, F.concat(F.lit("Product "), (F.col("doc_pos") + 1).cast("string"))).alias("title"), F.lit("products").alias("category"), F.concat_ws(" | ", *shown).alias("metadata"), status.alias("date"), F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (name, text, kind, features, price, status)]).alias("content"), price.alias("price"), stock.alias("stock"), kind.alias("type"), features.alias("features"), text.alias("_text"), name.alias("_name"))
    source = first_filled(F.col("_text"), F.col("metadata"), F.col("_name"))
    return d.withColumn("snippet", F.concat(F.left(source, F.lit(SNIPPET)), F.when(F.length(source) > SNIPPET, "...").otherwise(""))).drop("_text", "_name")
