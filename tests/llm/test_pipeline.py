"""Near copies by sketches, and the stages of the corpus pipeline, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from weftline.llm import quality, queries, simhash
from weftline.llm.graph import components

from .test_operators import ODD, WORD, brute_targets, documents, frame  # noqa: F401

corpus_pipeline = pytest.importorskip("corpus_pipeline")
ALL = (1 << 64) - 1
MASKS = simhash.covering_masks(3)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_sketch(text, shingle=5, seeds=8):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return [0] * seeds
    first = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))], "<u8")
    out = []
    for s in range(seeds):
        hashes = first
        if s:
            hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15 + 2 * s)
            hashes = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            hashes = hashes ^ hashes >> np.uint64(32)
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=int)
        out.append(sum(1 << i for i in range(64) if 2 * ones[i] > len(first)))
    return out


def bits_met(apart, radius=3, pieces=(8, 64)):
    """Whether two sketches, told by the bits that they differ in, meet in a table."""
    whole, (n, width) = sum(int(v) << 64 * i for i, v in enumerate(apart)), pieces
    masks = simhash.covering_masks(radius, width)
    return any((whole >> k * width) & m == 0 for k in range(n) for m in masks)


def brute_roots(sketches, most, met=bits_met):
    """The least index that links lead to, for each sketch."""
    up = list(range(len(sketches)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    x = np.array(sketches, np.uint64)
    for i in range(len(x)):
        apart = x[i + 1 :] ^ x[i]
        for j in np.flatnonzero(np.bitwise_count(apart).sum(1) <= most).tolist():
            if met(apart[j]):
                a, b = sorted((root(i), root(i + 1 + j)))
                up[b] = a
    return [root(i) for i in range(len(x))]


NEAR = simhash.sketch_limit(simhash.SEEDS, 0.8, simhash.SLACK)


def brute_near(docs):
    """Ids that stay of (id, text), where ids are unique."""
    ids = defaultdict(list)
    for i, text in docs:
        ids[tuple(brute_sketch(text, seeds=simhash.SEEDS))].append(i)
    groups = defaultdict(list)
    for x, r in zip(ids, brute_roots(list(ids), NEAR, lambda apart: bits_met(apart, 2, simhash.PIECES)), strict=True):
        groups[r] += ids[x]
    return {min(g) for g in groups.values()}


def altered(rng, text, share):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def test_limit_is_that_of_the_similarity():
    assert simhash.sketch_limit(8, 0.8) == 77 and simhash.sketch_limit(8, 1) == 0
    assert simhash.sketch_limit(8, 0.9) < simhash.sketch_limit(8, 0.8)
    assert simhash.sketch_limit(16, 0.8) == 155 and simhash.sketch_limit(16, 0.8, 1) == 166


@pytest.mark.parametrize("words", [0, 1, 4, 5, 300, 40000])
def test_sketch(words):
    text = " ".join(f"W{i * i % 1013}" for i in range(words))
    assert simhash.fingerprint_all(text, 5, 8) == brute_sketch(text)
    assert simhash.fingerprint_all(text, 3, 1) == brute_sketch(text, 3, 1)


def test_near_copies(spark, documents):  # noqa: F811
    rng = random.Random(4)
    texts = [d[1] for d in documents if 80 < len(d[1].split()) < 1500][:25]
    docs = [(i, t) for i, t in enumerate(t for x in texts for t in (x, *(altered(rng, x, s) for s in (0.002, 0.01, 0.02, 0.03, 0.2))))]
    kept = simhash.drop_near_copies(frame(spark, [(i, t, "en", "a") for i, t in docs]))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(brute_near(docs))


def test_large_buckets_of_sketches(spark):
    """Many sketches share a fingerprint, or nearly: more than a bucket holds. Those that share no more aren't linked, as in small buckets."""
    rng = random.Random(3)
    near = [rng.getrandbits(64) for _ in range(8)]
    sketches = [[v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(3))) for v in near] for _ in range(60)]
    sketches += [[rng.getrandbits(64), *(rng.getrandbits(64) for _ in range(6)), 99] for _ in range(60)]
    sketches += [[rng.getrandbits(64) for _ in range(8)] for _ in range(40)]
    table = spark.createDataFrame([(signed(x[0]), [signed(v) for v in x]) for x in sketches], "node long, sketch array<long>")
    least = {r["a"]: r["b"] for r in components(simhash.near_links(None, bucket=16, sketches=table, most=77)).collect()}
    got = [least.get(signed(x[0]), signed(x[0])) for x in sketches]
    assert len(set(got[:60])) == 1 and len(set(got)) == 101
    assert {i for i in got[60:]} == {signed(x[0]) for x in sketches[60:]}


def test_places_are_those_of_the_pieces(spark):
    rng = random.Random(8)
    a = [rng.getrandbits(64) for _ in range(16)]
    whole = sum(v << 64 * i for i, v in enumerate(a)) ^ sum(1 << (42 * k + b) for k in range(24) for b in rng.sample(range(42), 3 if k != 11 else 2))
    b = [whole >> 64 * i & ALL for i in range(16)]
    c = [v ^ rng.getrandbits(64) for v in a]
    table = spark.createDataFrame([(k, [signed(v) for v in x]) for k, x in enumerate((a, b, c))], "node long, sketch array<long>")
    places = defaultdict(list)
    for r in simhash.dealt(table, (24, 42), 2).collect():
        places[r["node"]].append(r["place"])
    assert all(len(set(p)) == 168 for p in places.values())
    met = lambda x, y: bits_met([u ^ v for u, v in zip(x, y, strict=True)], 2, (24, 42))
    assert met(a, b) and (set(places[0]) & set(places[1])) and bool(set(places[0]) & set(places[2])) == met(a, c)


def test_a_repeated_id_keeps_its_other_text(spark):
    rng = random.Random(12)
    a, b = (" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(2))
    kept = simhash.drop_near_copies(frame(spark, [(1, a, "en", "x"), (5, a + " more", "en", "x"), (5, b, "en", "x"), (None, a, "en", "x")]))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (5, b), (None, a)])


def test_near_copies_just_above_the_similarity_are_found(spark):
    """Nine of ten pairs with a similarity of 0.8 to 0.85, and more above."""
    rng, docs, alike = random.Random(21), [], {}
    for k in range(150):
        words = [f"w{rng.randrange(20000)}" for _ in range(600)]
        other = list(words)
        for at in rng.sample(range(0, 600, 5), 12 if k < 100 else 9):
            other[at] = f"x{rng.randrange(10**6)}"
        x, y = ({tuple(w[i : i + 5]) for i in range(596)} for w in (words, other))
        alike[k] = len(x & y) / len(x | y)
        docs += [(2 * k, " ".join(words), "en", "a"), (2 * k + 1, " ".join(other), "en", "a")]
    kept = {r["doc_id"] for r in simhash.drop_near_copies(frame(spark, docs)).collect()}
    low, high = ([k for k in alike if a <= alike[k] < b] for a, b in ((0.8, 0.85), (0.85, 0.9)))
    assert len(low) > 60 and len(high) > 30 and {2 * k for k in alike} <= kept
    assert sum(2 * k + 1 not in kept for k in low) >= 0.9 * len(low) and sum(2 * k + 1 not in kept for k in high) >= 0.97 * len(high)


def test_stages(spark, sf_dir, documents):  # noqa: F811
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: corpus_pipeline.materialize(stages[name](spark, df, sf_dir), "test")

    good = step("quality rules", docs)
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").collect()
    assert good.columns == docs.columns and Counter(r["doc_id"] for r in good.collect()) == Counter(r["doc_id"] for r in judged)

    single = step("exact dedup", good)
    least = {}
    for r in good.collect():
        least[r["text"]] = min(r["doc_id"], least.get(r["text"], r["doc_id"]))
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.collect()) == sorted(least.values())

    apart = step("near dedup", single)
    kept = apart.collect()
    assert apart.columns == docs.columns and Counter(r["doc_id"] for r in kept) == Counter(brute_near([(r["doc_id"], r["text"]) for r in single.collect()]))

    mixed = step("mix sources", apart)
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in kept}
    source, total, taken = {r["doc_id"]: r["source"] for r in kept}, Counter(), Counter()
    times = Counter(r["doc_id"] for r in mixed.collect())
    for i, s in source.items():
        total[s] += size[i]
        taken[s] += size[i] * times[i]
    assert mixed.columns == docs.columns and set(times) <= set(source) and max(times.values()) <= 2
    target = brute_targets(total)
    assert all(abs(taken[s] - target[s]) <= max(size[i] for i in source if source[i] == s) + 0.25 * target[s] for s in total)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECES))
    text = {r["doc_id"]: r["text"] for r in kept}
    rows = stages["encode pieces"](spark, mixed, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == times
    for r in rows:
        ids = library.encode(text[r["doc_id"]], add_eos=True)
        assert r["ids"] == ids and r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_stages_on_odd_and_no_rows(spark, sf_dir):
    for rows in (ODD, []):
        docs = frame(spark, rows)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            assert out.count() <= 2 * len(rows) and (k == 4 or out.columns == docs.columns)


@pytest.mark.parametrize("bucket", [16, 4096])
def test_links_of_sketches_are_those_of_brute_force(spark, bucket):
    """Members of a large bucket that differ in more bits than the radius are compared, and those that share a fingerprint alone aren't linked."""
    rng = random.Random(6)
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    sketches = []
    free = [b for b in range(64) if not MASKS[0] >> b & 1]
    for _ in range(8):
        middle = [rng.getrandbits(64) for _ in range(8)]
        for _ in range(25):
            first = 12345 ^ sum(1 << b for b in rng.sample(free, 9))
            sketches.append([first, *(flip(v, 4) for v in middle[1:])])
    sketches += [[*(rng.getrandbits(64) for _ in range(7)), 99] for _ in range(60)]
    sketches.sort(key=lambda x: signed(x[0]))
    table = spark.createDataFrame([(signed(x[0]), [signed(v) for v in x]) for x in sketches], "node long, sketch array<long>")
    least = {r["a"]: r["b"] for r in components(simhash.near_links(None, bucket=bucket, sketches=table, most=77)).collect()}
    nodes = [signed(x[0]) for x in sketches]
    want = brute_roots(sketches, 77)
    assert len(set(nodes)) == 260 and [least.get(i, i) for i in nodes] == [nodes[k] for k in want] and len(set(want)) == 68


def test_every_sketch_of_one_first_fingerprint_is_compared(spark, monkeypatch):
    """Of sketches with one first fingerprint, each finds its own near copies, and those far apart aren't linked."""
    rng = random.Random(2)
    a, b = ([7, *(rng.getrandbits(64) for _ in range(7))] for _ in range(2))
    c = [rng.getrandbits(64), *(v ^ 1 for v in max(a[1:], b[1:], key=signed_all))]
    rows = [(k, signed(x[0]), [signed(v) for v in x[1:]]) for k, x in enumerate((a, a, b, c))]
    sketched = spark.createDataFrame(rows, "id long, fp long, more array<long>")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: sketched)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(sketched, 5, seeds=8).collect()}
    want = brute_roots([a, a, b, c], 77)
    assert [got[k] for k in range(4)] == want and len(set(want)) == 2


def signed_all(values):
    return [signed(v) for v in values]
