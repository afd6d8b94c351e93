"""A join that keys with very many rows don't slow down."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.tables import materialize

#: A key with more than this part of all rows is joined by broadcast, so at most as many keys are.
HOT = 4096


def join_one(left: DataFrame, right: DataFrame, keys: Sequence[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """left with the columns of right, which has one row for each of the keys at most; null keys don't match. how: inner or left.

    Keys that many rows of left have would meet in one task of a shuffled join. Those with
    more than 1 / HOT of all rows are HOT keys at most, whatever the size of left: their
    rows of right are broadcast, and the others are joined by shuffle. left is read twice,
    or three times without counts (keys, n): rows of left by key.
    """
    keys = list(keys)
    counts = (left.groupBy(keys).agg(F.count("*").alias("n")) if counts is None else counts).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    total = counts.agg(F.sum("n").alias("all")).first()["all"] or 0
    hot = materialize(right.join(F.broadcast(counts.where(F.col("n") * HOT > total).select(*keys)), keys, "left_semi"), "hot-keys")
    if hot.isEmpty():
        return left.join(right, keys, how)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right, keys, how)
    return left.join(F.broadcast(hot), keys).unionByName(rest)
