"""Operator 6: SimHash near-dedup with covering locality-sensitive hashing.

Bits are given vectors of r + 1 coordinates over GF(2). For each non-zero vector v, a
mask keeps the bits whose vector isn't orthogonal to v. The vectors of any r bits span
r dimensions at most, so some v is orthogonal to all of them, and its mask keeps none
of them: two fingerprints that differ in r bits or fewer are equal under some of the
2**(r + 1) - 1 masks. Each mask keeps about half the bits.

Fingerprints are compared once each, however many rows have them. Within a bucket
they are compared directly and only a spanning forest of the links goes on. A bucket
above BUCKET fingerprints is dealt out again: its free bits are cut into r + 1 blocks,
and fingerprints within the radius agree in one block at least. This goes on until
buckets are small, and loses no link.

Texts can have a sketch of several fingerprints under different hashes. Its bits are cut
into pieces, each with covering masks of its own, and those that meet in any table are
then compared by all bits of their sketches. A pair that differs in radius bits or fewer
of any piece meets, so all pairs do that differ in fewer than radius + 1 bits a piece. A
large bucket is cut into parts by a hash, and each part is compared with itself and each
other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh, join_one, materialize, small_batches, text_or_empty
from weftline.llm.graph import components

BUCKET, SKETCH_BUCKET = 1024, 4096
SEED = 42
#: Sketches of near copies: their hashes, the pieces that these are cut into and a piece's bits, and how many standard deviations a pair can be over the mean of its similarity.
SEEDS, PIECES, SLACK = 16, (24, 42), 1.0
#: Shingles whose bits are counted together.
BLOCK = 1 << 14
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits, each set if it is in more than half of the shingles' XXH64; 0 without a word."""
    return fingerprint_all(text, shingle, 1)[0]


def _remix(h: np.ndarray, seeds: int) -> np.ndarray:
    """A row of 64-bit hashes for each seed: the first ones, then those that bijections make of them."""
    if seeds == 1:
        return h[None]
    x = (h ^ (h >> np.uint64(31))) * np.array([[0x9E3779B97F4A7C15 + 2 * s] for s in range(1, seeds)], np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate([h[None], x ^ (x >> np.uint64(32))])


def fingerprint_all(text: str, shingle: int, seeds: int) -> list[int]:
    """Fingerprints under as many hashes: the plain one first."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z, and the six ASCII white spaces
    if not words:
        return [0] * seeds
    n = max(1, len(words) - shingle + 1)
    hash64 = xxhash.xxh64_intdigest
    if n == 1:
        return _remix(np.array([hash64(b" ".join(words), SEED)], np.uint64), seeds)[:, 0].tolist()
    first = np.fromiter([hash64(x, SEED) for x in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))], np.uint64, n)
    lane = 256 * np.arange(8 * seeds).reshape(seeds, 1, 8)
    count = np.zeros(8 * seeds * 256, np.int64)
    for at in range(0, n, BLOCK):
        octets = _remix(first[at : at + BLOCK], seeds).view(np.uint8).reshape(seeds, -1, 8)
        count += np.bincount((octets + lane).ravel(), minlength=len(count))
    ones = count.reshape(-1, 256) @ _BITS
    return np.packbits(2 * ones.reshape(seeds, 64) > n, axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def fingerprints(docs: DataFrame, shingle: int = 3, seeds: int = 1, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, fp, more) for each row: the fingerprint as a signed long, and those under further hashes; with digest also the text's SHA-256. Null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint_all(t.as_py(), shingle, seeds) for t in b.column(1)], np.uint64).view(np.int64).reshape(-1, seeds)
            more = pa.ListArray.from_arrays(pa.array(np.arange(0, fps.size - len(fps) + 1, max(1, seeds - 1)) if seeds > 1 else np.zeros(len(fps) + 1), pa.int32()), pa.array(np.ascontiguousarray(fps[:, 1:]).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.ascontiguousarray(fps[:, 0])), more, *b.columns[2:]], ["id", "fp", "more", *b.schema.names[2:]])

    text = text_or_empty(text_col)
    columns = [F.col(id_col).alias("id"), text.alias("text"), *([F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha")] if digest else [])]
    return docs.select(*columns).mapInArrow(run, f"id {kind}, fp long, more array<long>{', sha binary' if digest else ''}")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    size = 1 << radius + 1
    vector = [i % (size - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(mask: int, parts: int, bits: int = 64) -> list[int]:
    """mask with one of the parts of its free bits added, for each part."""
    free = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k::parts]) for k in range(parts)]


def sketch_limit(seeds: int, similarity: float, slack: float = 0.0) -> int:
    """How many bits of their sketches texts with this Jaccard similarity differ in: on average, by the angle between shingle sets of one size, and slack standard deviations more."""
    part = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(64 * seeds * part + slack * math.sqrt(64 * seeds * part * (1 - part)))


def piece(sketch: Column, at: int, width: int) -> Column:
    """width bits of a sketch from bit `at` on, as a long."""
    word, off = divmod(at, 64)
    out = F.shiftrightunsigned(F.get(sketch, F.lit(word)), off) if off else F.get(sketch, F.lit(word))
    if off + width > 64:
        out = out.bitwiseOR(F.shiftleft(F.get(sketch, F.lit(word + 1)), 64 - off))
    return out.bitwiseAND(F.lit(_signed((1 << width) - 1)))


def dealt(sketches: DataFrame, pieces: tuple[int, int], radius: int) -> DataFrame:
    """(node, place): each sketch's place in each table, a hash of piece, mask and the bits that the mask keeps. Places that are equal by chance cost comparisons, no more."""
    n, width = pieces
    cut = F.array(*[piece(F.col("sketch"), k * width, width) for k in range(n)])
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius, width)])
    each = sketches.select("node", F.posexplode(cut).alias("k", "bits")).select("node", "k", "bits", F.explode(masks).alias("mask"))
    return each.select("node", F.xxhash64("k", "mask", F.col("bits").bitwiseAND(F.col("mask"))).alias("place"))


def forest(nodes: np.ndarray, sketches: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the nodes whose sketches (rows of longs) differ in `most` bits or fewer."""
    order = np.argsort(nodes, kind="stable")
    names, rest = nodes[order], sketches[order].view(np.uint64)
    out = []
    while len(rest) > 1:
        front, names, rest = [(names[0], rest[0])], names[1:], rest[1:]
        while front and len(rest):
            name, x = front.pop()
            near = np.bitwise_count(rest ^ x).sum(1) <= most
            if near.any():
                met = names[near]
                front.extend(zip(met, rest[near], strict=True))
                names, rest = names[~near], rest[~near]
                out += [(int(name), y) for y in met.tolist()]
    return out


def near_sketches(sketches: DataFrame, most: int, radius: int, pieces: tuple[int, int], bucket: int = SKETCH_BUCKET) -> DataFrame:
    """(a, b): links whose components are those of all pairs of (node, sketch) that meet in a table and differ in `most` bits or fewer. The bucket's limit doesn't change that."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for x in b.column(0):
                rows = np.asarray(x.values.flatten()).reshape(len(x), -1)
                got += forest(rows[:, 0], np.ascontiguousarray(rows[:, 1:]), most)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["a", "b"])

    # nearly all places are of one node, so they are counted where they arrive; asking for nodes makes both sides of the join one exchange
    places = dealt(sketches, pieces, radius).repartition("place")
    shared = places.groupBy("place").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    members = materialize(places.join(shared.select("place", "n"), "place"), "buckets")
    # two parts together are about as large as a bucket; one bucket's part meets all of its parts
    parts = F.ceil(F.col("n") * 2 / bucket)
    own, other = F.pmod(F.xxhash64("node"), parts), F.explode(F.sequence(F.lit(0), parts - 1))
    large = members.where(F.col("n") > bucket).select("place", "node", own.alias("own"), other.alias("other"))
    pairs = members.where(F.col("n") <= bucket).select("place", "node", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"))
    pairs = pairs.unionByName(large.select("place", "node", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).where("p < q"))
    lists = pairs.join(sketches, "node").groupBy("place", "p", "q").agg(F.collect_list(F.concat(F.array("node"), "sketch")).alias("x"))
    return lists.select("x").mapInArrow(link, "a long, b long")


def near_links(fps: DataFrame | None, radius: int = 3, bucket: int = BUCKET, sketches: DataFrame | None = None, most: int = 0) -> DataFrame:
    """(a, b): links whose components are those of all pairs of fps with the same s within the radius. fps: distinct (s, fp), a small int and a long.

    With sketches, a table of (node, sketch) that replaces fps, it is near_sketches() with
    each fingerprint of eight as a piece.
    """
    if bucket < 2 ** (radius + 1):
        raise ValueError("buckets can't get that small")
    if sketches is not None:
        return near_sketches(sketches, most, radius, (8, 64), bucket)

    def link_fps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for x in b.column(0).to_pylist():
                if len(x) > 2:
                    fp = np.array(x, np.int64)
                    got += forest(fp, fp.reshape(-1, 1), radius)
                elif ((x[0] ^ x[1]) & (1 << 64) - 1).bit_count() <= radius:
                    got.append((x[0], x[1]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["a", "b"])

    values = fps.select("s", "fp", F.col("fp").alias("node"))
    spark = values.sparkSession
    place = ["s", "mask", "key"]
    dealt = values.select("s", "node", "fp", F.explode(F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])).alias("mask"))
    out = None
    while True:
        dealt = dealt.select("s", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "node")
        shared = dealt.groupBy(place).agg(F.count("*").alias("n")).where("n > 1")
        members = materialize(dealt.join(shared, place), "buckets")
        small = members.where(F.col("n") <= bucket)
        links = small.groupBy(place).agg(F.collect_list("node").alias("x")).select("x").mapInArrow(link_fps, "a long, b long")
        out = links if out is None else out.unionByName(links)
        large = members.where(F.col("n") > bucket)
        masks = [r[0] for r in large.select("mask").distinct().collect()]  # as many as there are masks
        if not masks:
            return out
        finer = spark.createDataFrame([(m, _signed(x)) for m in masks for x in _blocks(m & (1 << 64) - 1, radius + 1)], "mask long, finer long")
        dealt = large.withColumn("fp", F.col("node")).join(F.broadcast(finer), "mask").select("s", "node", "fp", F.col("finer").alias("mask"))


def _grouped(rows: DataFrame, radius: int, seeds: int, similarity: float, pieces: tuple[int, int], slack: float) -> DataFrame:
    """Adds component_id to rows (id, fp, more and others)."""
    if seeds > 1:
        # rows with one sketch are one node
        alike = ["fp", "more"]
        firsts = materialize(rows.groupBy(alike).agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "distinct-sketches")
        links = near_sketches(firsts.select("node", F.concat(F.array("fp"), "more").alias("sketch")), sketch_limit(seeds, similarity, slack), radius, pieces)
    else:
        alike = ["fp"]
        firsts = materialize(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("node", F.col("fp")), "distinct-fingerprints")
        links = near_links(firsts.select(F.lit(0).alias("s"), "fp"), radius)
    roots = components(links)
    member = materialize(firsts.join(roots.select(F.col("a").alias("node"), "b"), "node", "left").select(*alike, "first", F.coalesce("b", "node").alias("root")), "members")
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialize(join_one(member, least, ["root"]).select(*alike, "component_id"), "component-of")
    return join_one(rows, of, alike, firsts.select(*alike, "n"))


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, seeds: int = 1, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, pieces: tuple[int, int] | None = None, slack: float = 0.0) -> DataFrame:
    """Each row's fingerprint (16 hex digits) and component_id, the smallest id that links lead to.

    Rows with equal fingerprints are linked, and so are fingerprints within the radius.
    With seeds above 1, each text has a sketch of so many fingerprints under different
    hashes, cut into pieces (their number and width; by default each fingerprint is one),
    and rows with equal sketches are linked. Texts that meet in a table of any piece are
    then linked if their sketches differ in no more bits than sketch_limit() tells of the
    similarity. Null text counts as empty; texts without a word have fingerprint zero,
    linked like any other. Rows that repeat an id get the component of their own text.
    Null ids are passed over for component_id, which is null only if a component has no
    other. An empty table gives no rows; other columns aren't looked at.
    """
    rows = materialize(fingerprints(docs, shingle, seeds, id_col, text_col), "fingerprints")
    out = _grouped(rows, radius, seeds, similarity, pieces or (seeds, 64), slack)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 5, radius: int = 2, seeds: int = SEEDS, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, pieces: tuple[int, int] = PIECES, slack: float = SLACK) -> DataFrame:
    """The rows of docs whose id is the smallest of their text's component, with all their columns.

    Rows without an id stay. Of rows that repeat an id with different texts each is judged
    by its own text; rows that repeat both are alike and stay or go together.
    """
    lead, sha = fresh(docs, "lead", "sha")
    rows = materialize(fingerprints(docs, shingle, seeds, id_col, text_col, digest=True), "fingerprints")
    groups = _grouped(rows, radius, seeds, similarity, pieces, slack)
    gone = groups.where(F.col("id") != F.col("component_id")).select(F.col("id").alias(lead), F.col("sha").alias(f"{sha}_gone")).distinct()
    marked = docs.withColumn(sha, F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)))
    return marked.join(gone, (marked[id_col] == gone[lead]) & (marked[sha] == gone[f"{sha}_gone"]), "left_anti").drop(sha)
