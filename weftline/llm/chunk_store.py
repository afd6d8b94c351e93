"""Operator 2: token ids in a content-addressed store.

A store is a folder of three Parquet tables:

- chunks (digest, n, payload), in the folder stored=true. A rolling hash over the ids cuts
  each document's stream, so equal passages give equal chunks wherever they stand. A
  chunk's ids are once in the store, under the SHA-256 of their little-endian
  32-bit form.
- recipes (part, rid, doc_id, n_tokens, local_start, root, chunks): for each document
  its chunks in order, and the root of the Merkle tree over their digests. Files and
  rows are in ascending doc_id order, nulls first. A last row of each part, without a
  rid, has the number of its documents (local_start), their ids and the Merkle root over
  their roots.
- manifest (part, n_docs, n_tokens, base, root): these last rows, with the ids before
  each part.

A payload's first byte is 2 or 4, the bytes of an id; the rest is Zstandard.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.bytepairs import byte_pairs, forget
from weftline.llm.common import join_one, materialize, small_batches, text_or_empty

WINDOW, LEAST, MOST = 8, 128, 4096
#: A chunk ends where the rolling hash has these bits clear: about every 512 ids.
CUT_BITS = np.uint64((1 << 9) - 1)
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = [np.uint64(pow(_FACTOR, j + 1, 1 << 64)) for j in range(WINDOW)]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream. Only the ids from one cut on decide the next."""
    return cuts_of(ids, np.array([len(ids)]))[0]


def cuts_of(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """cuts() of each of the documents whose ids stand one after the other, as places in ids.

    A window of the hash can reach into the document before, but no chunk ends that early.
    """
    wide = ids.astype(np.uint64)
    h = wide * _POWERS[0]
    for j in range(1, WINDOW):
        h[j:] += wide[:-j] * _POWERS[j]
    found = np.flatnonzero(((h >> np.uint64(40)) & CUT_BITS) == 0) + 1
    first = np.concatenate([[0], ends[:-1]])
    a, b = np.searchsorted(found, first, "right").tolist(), np.searchsorted(found, ends, "right").tolist()
    found, out = found.tolist(), []
    for last, n, i, k in zip(first.tolist(), ends.tolist(), a, b, strict=True):
        if n - last <= LEAST:
            out.append([n])
            continue
        got = []
        for e in found[i:k]:
            while e - last > MOST:
                last += MOST
                got.append(last)
            if e - last >= LEAST:
                got.append(e)
                last = e
        while n - last > MOST:
            last += MOST
            got.append(last)
        if last < n:
            got.append(n)
        out.append(got)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd node goes up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class MerkleStack:
    """merkle() of leaves that come one by one; holds a node for each power of two of their number."""

    def __init__(self):
        self.n, self.nodes = 0, []

    def add(self, leaf: bytes) -> None:
        node, k = hashlib.sha256(b"\0" + leaf).digest(), self.n
        while k & 1:
            node = hashlib.sha256(b"\1" + self.nodes.pop() + node).digest()
            k >>= 1
        self.nodes.append(node)
        self.n += 1

    def root(self) -> bytes:
        if not self.nodes:
            return merkle([])
        node = self.nodes[-1]
        for left in reversed(self.nodes[:-1]):
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


def _unpack(payload: bytes, raw) -> np.ndarray:
    return np.frombuffer(raw.decompress(payload[1:]), "<u2" if payload[0] == 2 else "<u4").astype("<u4")


#: Digests that a task remembers having sent; a chunk that comes again after that many is sent again.
SENT = 1 << 18
_CHUNKS = "array<struct<digest:binary,n:int>>"


def _list_of(digests: list[bytes], sizes: list[int], ends: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32())], ["digest", "n"]))


def write_store(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", specials_are_text: bool = False) -> None:
    """Encodes every document (null text is empty), appends end_id and writes a store at path.

    Rows with the same id are documents of their own, in an order fixed by where they
    are read. An empty table gives an empty store. Other columns aren't looked at.
    One shuffle moves each task's own chunks to where their digest belongs, as a rule
    once for each task that has them, and the documents' recipes with them; a second one
    moves the recipes into id order. No shuffle has a row for each place of a chunk.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    names = ["stored", "digest", "n", "payload", "rid", "doc_id", "chunks"]
    shape = f"stored boolean, digest binary, n long, payload binary, rid long, doc_id {kind}, chunks {_CHUNKS}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pairs, pack = byte_pairs(vocabulary.value, specials_are_text), zstandard.ZstdCompressor(level=1).compress
        sha, sent = hashlib.sha256, set()
        for batch in batches:
            done = 0
            for ids, ends in pairs.encode(batch.column(2)):
                stream, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                raw = memoryview(stream.astype("<u4").tobytes())
                width = 2 if not len(stream) or stream.max() < 1 << 16 else 4
                short = memoryview(stream.astype("<u2").tobytes()) if width == 2 else raw
                mark, last = bytes([width]), 0
                digests, sizes, upto = [], [], []
                new: dict[bytes, tuple[int, bytes]] = {}
                for some in cuts_of(stream, ends):
                    for e in some:
                        digest = sha(raw[4 * last : 4 * e]).digest()
                        if digest not in sent:
                            sent.add(digest)
                            new[digest] = e - last, mark + pack(short[width * last : width * e])
                        digests.append(digest)
                        sizes.append(e - last)
                        last = e
                    upto.append(len(digests))
                n = len(ends)
                rids, of = batch.column(0).slice(done, n), batch.column(1).slice(done, n)
                done += n
                keys = pa.array([r.to_bytes(8, "big") for r in rids.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([False] * n), keys, pa.array(np.diff(ends, prepend=0), pa.int64()), pa.nulls(n, pa.binary()), rids, of, _list_of(digests, sizes, upto)], names)
                if new:
                    m = len(new)
                    yield pa.RecordBatch.from_arrays([pa.array([True] * m), pa.array(new.keys(), pa.binary()), pa.array([x for x, _ in new.values()], pa.int64()), pa.array([x for _, x in new.values()], pa.binary()), pa.nulls(m, rids.type), pa.nulls(m, of.type), pa.nulls(m, _list_of([], [], []).type)], names)
                if len(sent) > SENT:
                    sent.clear()

    made = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(encode, shape)
    # a digest has a row for each task that sent it, not for each place
    first = F.lag("n").over(Window.partitionBy("stored", "digest").orderBy("n")).isNull()
    made.withColumn("first", first).where("first").drop("first").write.partitionBy("stored").parquet(f"{path}/chunks")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        part, start, stack, schema = TaskContext.get().partitionId(), 0, MerkleStack(), None
        names = ["part", "rid", "doc_id", "n_tokens", "local_start", "root", "chunks"]
        for batch in batches:
            schema = batch.schema
            sizes = np.array(batch.column(2).to_numpy(zero_copy_only=False), np.int64)
            starts = start + np.concatenate([[0], np.cumsum(sizes)])
            start = int(starts[-1])
            lists = batch.column(3)
            digests, at, roots = lists.flatten().field("digest").to_pylist(), 0, []
            for n in lists.value_lengths().to_pylist():
                roots.append(merkle(digests[at : at + n]))
                stack.add(roots[-1])
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part), pa.int32()), batch.column(0), batch.column(1), batch.column(2), pa.array(starts[:-1], pa.int64()), pa.array(roots, pa.binary()), lists], names)
        if stack.n:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.nulls(1, schema.field(0).type), pa.nulls(1, schema.field(1).type), pa.array([start], pa.int64()), pa.array([stack.n], pa.int64()), pa.array([stack.root()], pa.binary()), pa.nulls(1, schema.field(3).type)], names)

    recipes = spark.read.schema(shape).parquet(f"{path}/chunks").where("NOT stored").select("rid", "doc_id", F.col("n").alias("n_tokens"), "chunks")
    placed = recipes.repartitionByRange(F.col("doc_id"), F.col("rid")).sortWithinPartitions("doc_id", "rid").mapInArrow(place, f"part int, rid long, doc_id {kind}, n_tokens long, local_start long, root binary, chunks {_CHUNKS}")
    placed.write.parquet(f"{path}/recipes")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/chunks/stored=false")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    last = spark.read.parquet(f"{path}/recipes").where("rid IS NULL").select("part", "local_start", "n_tokens", "root").collect()  # as many rows as recipes has partitions
    base, rows = 0, []
    for part, n_docs, n_tokens, root in sorted(last, key=lambda m: m[0]):
        rows.append((part, n_docs, n_tokens, base, bytes(root)))
        base += n_tokens
    spark.createDataFrame(rows, "part int, n_docs long, n_tokens long, base long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes").where("rid IS NOT NULL")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload) of every chunk."""
    return spark.read.schema("digest binary, payload binary, stored boolean").parquet(f"{path}/chunks").where("stored").select("digest", "payload")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(digest, ids) of every chunk; raises where ids don't have the digest that they are stored under."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        raw = zstandard.ZstdDecompressor()
        for batch in batches:
            digests = batch.column(0).to_pylist()
            ids = [_unpack(p, raw) for p in batch.column(1).to_pylist()]
            for d, x in zip(digests, ids, strict=True):
                if hashlib.sha256(x.tobytes()).digest() != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], ["digest", "ids"])

    return _payloads(spark, path).mapInArrow(unpack, "digest binary, ids array<long>")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, rid, ids): documents put together again; wanted: a table with the doc_id of those that are."""
    recipes = read_recipes(spark, path)
    if wanted is not None:
        recipes = recipes.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    pieces = materialize(recipes.select("rid", "doc_id", F.posexplode("chunks").alias("k", "c")).select("rid", "doc_id", "k", "c.digest"), "pieces")
    pieces = join_one(pieces, read_chunks(spark, path), ["digest"])
    whole = pieces.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("x"))
    return whole.select("doc_id", "rid", F.flatten(F.transform("x", lambda p: p["ids"])).alias("ids"))


_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2), modulo that of crc32, bits reversed as crc32 has them."""
    a, b, out = a.astype(np.uint64), b.astype(np.uint64), np.zeros(len(a), np.uint64)
    one = np.uint64(1)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(k)) & one, b, np.uint64(0))
        b = (b >> one) ^ np.where(b & one, np.uint64(_POLY), np.uint64(0))
    return out


@cache
def _shifts(k: int) -> tuple[np.ndarray, ...]:
    """What 2**k more bytes make of each byte of a crc, lowest first."""
    power = np.array([1 << 23], np.uint64)  # x to the 8th: one byte
    for _ in range(k):
        power = _times(power, power)
    return tuple(_times(np.arange(256, dtype=np.uint64) << np.uint64(8 * i), np.broadcast_to(power, 256)) for i in range(4))


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A part's share of the crc32 of a whole that has `after` more bytes behind it. The whole's crc32 is the xor of its parts' shares."""
    out, after = crc.astype(np.uint64), after.astype(np.int64)
    for k in range(int(after.max(initial=0)).bit_length()):
        odd = np.flatnonzero(after >> k & 1)
        if len(odd):
            x = out[odd].astype(np.int64)
            a, b, c, d = _shifts(k)
            out[odd] = a[x & 255] ^ b[x >> 8 & 255] ^ c[x >> 16 & 255] ^ d[x >> 24]
    return out


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Each document as the files have it: doc_id, start, n_tokens, ids_crc32, n_chunks, verified.

    Every chunk is unpacked once and checked against its digest. Its crc32 and length
    then stand for its ids: the crc32 of a document is combined from those of its chunks,
    so no ids are shuffled. verified: the Merkle root over the chunks is the recipe's,
    and all chunks are there with the lengths that the recipe tells.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        forget()
        unpack, sha, crc32 = zstandard.ZstdDecompressor().decompress, hashlib.sha256, zlib.crc32
        for batch in batches:
            n, crc = [], []
            for d, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = unpack(p[1:])
                x = np.frombuffer(x, "<u2").astype("<u4").tobytes() if p[0] == 2 else x
                if sha(x).digest() != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
                n.append(len(x) // 4)
                crc.append(crc32(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["digest", "have", "crc"])

    chunks = _payloads(spark, path).mapInArrow(sums, "digest binary, have long, crc long")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            count, flat = lists.value_lengths().to_numpy(), lists.flatten()
            ends, n = np.cumsum(count), flat.field("n").to_numpy().astype(np.int64)
            digests, total, upto = flat.field("digest").to_pylist(), batch.column(1).to_numpy(), np.concatenate([[0], np.cumsum(n)])
            whole = upto[ends] - upto[ends - count]
            good = [same and merkle(digests[a:b]) == root for same, a, b, root in zip((whole == total).tolist(), (ends - count).tolist(), ends.tolist(), batch.column(2).to_pylist(), strict=True)]
            after = 4 * (np.repeat(upto[ends], count) - upto[1:])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), count)), pa.array(np.repeat(np.array(good, bool), count)), flat.field("digest"), pa.array(n), pa.array(after)], ["rid", "good", "digest", "n", "after"])

    @F.pandas_udf("long")
    def share(crc, after):
        import pandas as pd

        return pd.Series(shifted_crc(crc.to_numpy(), after.to_numpy()).astype(np.int64))

    recipes = read_recipes(spark, path)
    parts = materialize(recipes.select("rid", "n_tokens", "root", "chunks").mapInArrow(spread, "rid long, good boolean, digest binary, n long, after long"), "places-of-chunks")
    joined = join_one(parts, materialize(chunks, "sums-of-chunks"), ["digest"]).select("rid", (F.col("good") & (F.col("n") == F.col("have"))).alias("good"), "n", share("crc", "after").alias("share"))
    found = joined.groupBy("rid").agg(F.bit_xor("share").alias("ids_crc32"), F.sum("n").alias("found"), F.count("*").alias("n_chunks"), F.every("good").alias("good"))
    manifest = spark.read.schema("part int, base long").parquet(f"{path}/manifest").select("part", "base")
    out = recipes.select("rid", "doc_id", "part", "local_start", "n_tokens").join(F.broadcast(manifest), "part").join(found, "rid", "left")
    return out.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "n_chunks", F.coalesce(F.col("good") & (F.col("found") == F.col("n_tokens")), F.lit(False)).alias("verified"))
