"""Operator 3: exact dedup by a tree-merge of sorted digest runs.

A run is a partition sorted by digest, with one row for each digest: the identifier that
stays and the number of rows behind it. Every task sorts its own rows into a run first.
Runs are then exchanged in rounds. With fan k, round r sends a row from the run whose
r-th base-k digit is d to the run where that digit is the digest's own r-th digit; what
arrives there are parts of k runs, which are sorted together and merged in one pass
over neighbours. A round of fan 2**b does the work of b binomial rounds, in which runs
meet in pairs, with one shuffle. After all rounds, equal digests of the whole table are
in one run. A digest that a third of all rows have is at most once in each run at every
level, so no run and no task ever gets them all.

Rows are equal when SHA-256, XXH64 and length of the text are: the last two verify at
every level that a digest stands for one text; were they ever to differ, the rows would
stay apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh, join_one, materialize, shuffle_parts, text_or_empty

KEY = ["sha", "check", "size"]
#: Runs that meet in a round, at most; more would be fewer rounds with more to merge in each.
FAN = 8


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.xxhash64(text).alias("check"), F.octet_length(text).alias("size"))


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by KEY and, within it, by keep_id (the one that stays first): one row for each KEY, with the sum of group_size. Holds a batch and one row."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if last is None else pa.concat_batches([last, batch.cast(last.schema)])
        n = rows.num_rows
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = False
            for k in KEY:
                x = rows.column(k)
                new[1:] |= pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        total = np.add.reduceat(rows.column("group_size").to_numpy(), first)
        one = rows.take(pa.array(first))
        one = pa.RecordBatch.from_arrays([pa.array(total) if n == "group_size" else x for n, x in zip(one.schema.names, one.columns, strict=True)], one.schema.names)
        yield one.slice(0, len(first) - 1)
        last = one.slice(len(first) - 1)
    if last is not None:
        yield last


def tree_merge(rows: DataFrame, keep: str = "min", rounds: int | None = None, runs: int | None = None) -> DataFrame:
    """(sha, check, size, keep_id, group_size): one row for each digest among rows.

    keep is min or max, the identifier that stays; null only where all are null. There
    are at least runs of them, by default as many as shuffle partitions; by default
    rounds are so many that no more than FAN runs meet in one.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    best = F.col("keep_id").asc_nulls_last() if keep == "min" else F.col("keep_id").desc_nulls_last()
    runs = max(2, runs or shuffle_parts(rows.sparkSession))
    rounds = rounds or math.ceil(math.log(runs, FAN) - 1e-9)
    fan = max(2, math.ceil(runs ** (1 / rounds) - 1e-9))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"sha binary, check long, size int, keep_id {kind}, group_size long"
    sort = lambda df: df.sortWithinPartitions(*KEY, best).mapInArrow(merged, shape)
    run = sort(rows.select(*KEY, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
    own = F.pmod(F.col("check"), F.lit(fan**rounds))
    for r in range(rounds):
        here = F.pmod(F.spark_partition_id(), F.lit(fan**rounds))
        digit = lambda x, r=r: F.floor(x / fan**r) % fan
        to = (here + (digit(own) - digit(here)) * fan**r).cast("int")
        run = sort(run.withColumn("to", to).repartitionById(fan**rounds, "to").drop("to"))
    return run


def exact_groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """Each row's group: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are equal. group_size counts rows,
    repeated ones too. kept: the row's id is keep_id; rows that repeat both id and text
    are all kept, as nothing tells them apart. Null ids never stay before others; a group
    of nulls has a null keep_id and keeps them. Other columns aren't looked at.
    """
    rows = materialize(digests(docs, id_col, text_col), "digests")
    groups = materialize(tree_merge(rows, keep, rounds), "digest-groups")
    out = join_one(rows, groups, KEY, groups.select(*KEY, F.col("group_size").alias("n")))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the one with the smallest (or largest) id.

    Rows that repeat id and text all stay. The text itself isn't shuffled: what goes is
    joined by digest, and only where groups have more than one row.
    """
    sha, check, size, stays = fresh(docs, "sha", "check", "size", "stays")
    text = text_or_empty(text_col)
    rows = materialize(digests(docs, id_col, text_col), "digests")
    groups = materialize(tree_merge(rows, keep).where("group_size > 1"), "digest-groups")
    dropped = join_one(rows, groups, KEY, groups.select(*KEY, F.col("group_size").alias("n"))).where(~F.col("id").eqNullSafe(F.col("keep_id")))
    gone = dropped.select(*[F.col(a).alias(b) for a, b in zip(KEY, (sha, check, size), strict=True)], F.col("id").alias(stays))
    marked = docs.withColumns({sha: F.unhex(F.sha2(text.cast("binary"), 256)), check: F.xxhash64(text), size: F.octet_length(text)})
    same = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in (sha, check, size)]
    out = marked.alias("a").join(gone.distinct().alias("b"), [*same, F.col(f"a.{id_col}").eqNullSafe(F.col(f"b.{stays}"))], "left_anti")
    return out.drop(sha, check, size)
