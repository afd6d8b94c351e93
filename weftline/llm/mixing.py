"""Operator 10: mixing sources to target weights on a low-discrepancy schedule. DataFrame functions only.

- A source's target is its weight's share of the total, but twice its size at most; what
  goes over is shared again by weight until no target is above.
- A source's target, rounded to words, is cut into blocks of one size whatever the size of
  the corpus, and a last part block. It needs as many slots of the schedule.
- Slot k of the schedule is the point frac((k + 1) * golden ratio); the sources' numbers of
  slots cut [0, 1) into intervals, and the point's interval is the slot's source. Any
  stretch of the schedule has nearly the target's share of each source. Slots that a
  source has beyond its need go to the sources that points left short, in order, so that
  each source has just the slots that it needs.
- Within a source, documents stand in an order shuffled by a hash, twice over, and the
  stream of their words is cut into the blocks. The j-th slot of a source takes its j-th
  block; a document that goes over a border gives each block its own words. What the mix
  takes of a document are the words of its spans that slots took, and nothing else.

Running sums are made in two levels (within a bucket, and over the totals of buckets),
so that one source with most of the rows is dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, n_words

GOLDEN = 0.6180339887498949
#: frac(2**20 * golden ratio): points of slots beyond 2**20 are summed of two, so that they keep their digits.
GOLDEN_20 = 0.607787409740351
#: Rows or slots that one bucket of a running sum has, on average.
BUCKET_ROWS = 4096
#: Sources up to this number are broadcast, at about 0.1 KB each; beyond it they are joined by shuffle.
MOST_BROADCAST = 100_000


def _running(df: DataFrame, group: str, bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds the sum of value over the rows before, in each group; buckets are in order and rows within them by order."""
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("_t"))
    upto = totals.withColumn("_base", F.sum("_t").over(Window.partitionBy(group).orderBy(bucket)) - F.col("_t")).drop("_t")
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_in", F.sum(value).over(within) - F.col(value)).join(upto, [group, bucket]).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, block: int) -> DataFrame:
    """sizes (key, is_null, source_size, n): adds target, goal (whole words), need (slots) and the source's interval [lo, hi) of [0, 1).

    Sources are in code point order, null last, and weights go round. One row for each
    source, so the windows over all of them see no rows of documents.
    """
    rank = F.row_number().over(Window.orderBy("is_null", "key")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    t = sizes.withColumn("rank", rank).withColumn("w", w).withColumn("cap", F.col("source_size") * 2.0)
    everything = Window.partitionBy(F.lit(0))
    rising = everything.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", share * F.sum("source_size").over(everything)).withColumn("w_all", F.sum("w").over(everything))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(rising), F.lit(0.0))) / (F.col("w_all") - F.coalesce(F.sum("w").over(rising), F.lit(0.0))))
    # filled in the order of cap by weight, the first source that isn't full tells the level of all the others
    t = t.withColumn("level", F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(everything)["level"])
    t = t.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))))
    t = t.withColumn("goal", F.round("target").cast("long")).withColumn("need", F.expr(f"(goal + {block - 1}) div {block}"))
    upto = F.sum("need").over(everything.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.nullif(F.sum("need").over(everything), F.lit(0))
    return t.withColumn("hi", upto / whole).withColumn("lo", F.coalesce(F.lag("hi").over(everything.orderBy("rank")), F.lit(0.0))).select("key", "is_null", "rank", "source_size", "target", "goal", "need", "lo", "hi")


def schedule(per_source: DataFrame, n_slots: int, few: bool, cells: int = 4096) -> DataFrame:
    """(slot, rank, turn): the source of each slot, and which turn of that source it is. n_slots is the sum of need, and each source gets as many.

    Points find their interval by a join on the cell of [0, 1) that they are in.
    """
    spark = per_source.sparkSession
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    spans = per_source.where("hi > lo").select("rank", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    point = f"pmod(pmod((id + 1) div {1 << 20} * {GOLDEN_20!r}D, 1.0D) + pmod((id + 1) % {1 << 20} * {GOLDEN!r}D, 1.0D), 1.0D)"
    points = spark.range(n_slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / BUCKET_ROWS).alias("bucket"), F.expr(point).alias("u")).withColumn("cell", cell(F.col("u")))
    met = points.join(spans, "cell").where("u >= lo AND u < hi").select("slot", "bucket", "rank", F.lit(1).cast("long").alias("one"))
    need = per_source.select("rank", "need")
    dealt = materialize(_running(met, "rank", "bucket", [F.col("slot")], "one", "turn").join(F.broadcast(need) if few else need, "rank"), "mix-slots")
    # the i-th turn that points left out takes the i-th slot that its source has no need of
    left = need.join(dealt.groupBy("rank").agg(F.count("*").alias("had")), "rank", "left").select("rank", (F.col("need") - F.coalesce("had", F.lit(0))).alias("left")).where("left > 0")
    base = F.sum("left").over(Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("left")
    short = left.withColumn("base", base).select("rank", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("left") - 1)).alias("i"))
    spare = _running(dealt.where("turn >= need").select(F.lit(0).alias("all"), "slot", "bucket", "one"), "all", "bucket", [F.col("slot")], "one", "i")
    columns = ["slot", "bucket", "rank", "one"]
    given = dealt.where("turn < need").select(*columns).unionByName(spare.join(short, "i").select(*columns))
    return _running(given, "rank", "bucket", [F.col("slot")], "one", "turn").select("slot", "rank", "turn")


def _dealt(docs: DataFrame, weights: Sequence[int], share: float, block: int, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that have no word (id, size, rank), spans of the others (rank, off, id, size, first, at, words, slot), and the sources.

    off is the row's place in its source. A span has the words from first on of a document
    and stands in its block from at on; slot is null where the schedule has no turn for the
    block. A row that is past its source's goal has one span of no words.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("key"), F.col(source_col).isNull().alias("is_null"), n_words(F.col(text_col)).alias("size"))
    rows = materialize(rows.withColumn("h", F.xxhash64(F.lit(seed), "id", "size")), "mix-rows")
    sizes = rows.groupBy("key", "is_null").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = materialize(targets(sizes, weights, share, block), "mix-targets")
    n_slots, n_sources = plan.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    few = n_sources <= MOST_BROADCAST
    turns = schedule(plan, n_slots, few, max(4096, 2 * n_sources))
    plan = F.broadcast(plan) if few else plan

    buckets = max(64, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 1), F.lit(buckets)))
    sized = rows.join(plan.select("key", "is_null", "rank", "source_size", "goal"), ["key", "is_null"]).drop("key", "is_null")
    placed = _running(sized.where("size > 0"), "rank", "bucket", [F.col("h"), F.col("id"), F.col("size")], "size", "off")
    # every pass over the source, as far as the goal, cut at the borders of blocks
    again = F.col("off") + F.col("source_size")
    spans = placed.withColumn("start", F.explode(F.when(again < F.col("goal"), F.array("off", again)).otherwise(F.array("off"))))
    spans = spans.withColumn("stop", F.least(F.col("start") + F.col("size"), F.greatest("start", "goal")))
    spans = spans.withColumn("turn", F.explode(F.expr(f"sequence(start div {block}, greatest(start, stop - 1) div {block})")))
    spans = spans.withColumn("begin", F.greatest("start", F.col("turn") * block)).withColumn("words", F.least("stop", (F.col("turn") + 1) * block) - F.col("begin"))
    spans = spans.select("rank", "off", "id", "size", "turn", (F.col("begin") - F.col("start")).alias("first"), (F.col("begin") - F.col("turn") * block).alias("at"), "words")
    return sized.where("size = 0").select("id", "size", "rank"), spans.join(turns, ["rank", "turn"], "left"), plan


def mixture(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, least_block: int = 64, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: slot, at, id, first, words. In the order of slot and at, each line has as many words of the document, from first on (from 0)."""
    _, spans, _ = _dealt(docs, weights, share, least_block, seed, id_col, text_col, source_col)
    return spans.where("slot IS NOT NULL AND words > 0").select("slot", "at", F.col("id").alias(id_col), "first", "words")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, least_block: int = 64, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of each document: id, size, source_size, target, taken, first_slot.

    size counts words; null text has none. taken counts words of the document in the slots
    of mixture(), with repeats, 2 * size at most, and adds up to the source's target,
    rounded; first_slot is the place in the schedule where the document first comes, null
    if it never does. Blocks have least_block words, the last one of a source what is left.
    Repeated rows are documents of their own; a null id or source is a value like others.
    Reruns agree: the order of documents is by a hash of id and size, and rows that are
    equal in both are alike. An empty table gives no rows.
    """
    none, spans, plan = _dealt(docs, weights, share, least_block, seed, id_col, text_col, source_col)
    met = F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)
    had = spans.groupBy("rank", "off", "id", "size").agg(F.sum(met).alias("taken"), F.min(F.when(met > 0, F.col("slot"))).alias("first_slot")).drop("off")
    none = none.withColumns({"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")})
    every = had.unionByName(none).join(plan.select("rank", "source_size", "target"), "rank")
    return every.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "first_slot")
