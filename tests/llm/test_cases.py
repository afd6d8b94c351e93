"""More of the operators against brute force: odd rows, long texts, alphabets, schedules, forests and folds."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import bytepairs, chunk_store, common, exact, language, mixing, quality, queries, token_counts, toxicity, urls

from .test_operators import ODD, frame


def test_section_tokens_of_odd_rows(spark):
    """Every row has its sections, repeated ones too; spans are in characters, and tokens add up to the library's."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.BYTE_PAIRS))
    tokenizer.encode_special_tokens = True
    odd = [*ODD, (20, "é\n語🙂\n\n 　\n🙂", "en", "a"), (21, "x\n" * 9000, "en", "a")]
    got = defaultdict(list)
    for r in token_counts.section_tokens(frame(spark, odd), queries.tokenizer_json(), "most").collect():
        got[r["doc_id"]].append(r)
    texts = defaultdict(list)
    for i, text, *_ in odd:
        texts[i].append(text or "")
    assert set(got) == set(texts)
    for i, of in texts.items():
        want = Counter()
        for text in of:
            encoded, ends = tokenizer.encode(text, add_special_tokens=False), [k + 1 for k, c in enumerate(text) if c == "\n"]
            if not ends or ends[-1] < len(text):
                ends.append(len(text))
            section = [sum(e <= k for e in ends) for k in range(len(text))] if len(text) < 1000 else np.searchsorted(ends, np.arange(len(text)), "right").tolist()
            n = Counter()
            for a, b in encoded.offsets:
                own = Counter(section[a:b])
                n[min(own, key=lambda s: (-own[s], s))] += 1
            for s, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                want[s, a, b, float(n[s]), len(encoded.ids)] += 1
        assert Counter((r["section"], r["start_char"], r["end_char"], r["n_tokens"], r["doc_tokens"]) for r in got[i]) == want, i
    assert token_counts.section_tokens(frame(spark, []), queries.tokenizer_json()).count() == 0
    with pytest.raises(ValueError, match="rule"):
        token_counts.section_tokens(frame(spark, odd), queries.tokenizer_json(), "none")


def test_words_with_marks_and_lines(monkeypatch):
    """What words are made of doesn't show in their ids, with full memories and with none."""
    monkeypatch.setattr(bytepairs, "PORTION", 2000)
    rng = random.Random(3)
    stems = ["abc", "Wörter", "été", "don't", "x1", "語語", "ԱԲ", "I'm", "THE", "we're", "a_b", "'s", "ﬁn"]
    ends = ["", "", ",", ".", "!!", "...", "'", "',", ")\n", "\n", ".\n", "\n\n", "?!\nNew", ".\nNew,\nOld;", "\u0085", "—"]
    texts = [" ".join(rng.choice(stems) + rng.choice(ends) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    for memo in (0, 40, 1 << 16):
        pairs = bytepairs.BytePairs(queries.tokenizer_json(), False, memo)
        want = [np.array(e.ids, "<u4").tobytes() for e in pairs.tokenizer.encode_batch(texts, add_special_tokens=False)]
        for _ in range(2):
            assert pairs.encode_all(texts) == want
        assert len(pairs.known) <= memo and len(pairs.known) == len(set(pairs.known.words.to_pylist()))


def test_known_words_grow_and_are_compared(monkeypatch):
    known, words = bytepairs._Known(), [f"w{i}" for i in range(9000)]
    for at in range(0, 9000, 700):
        assert (known.find(words[at : at + 700]) == -1).all()
        known.add(words[at : at + 700])
    assert known.find([*words, "none"]).tolist() == [*range(9000), -1]
    monkeypatch.setattr(bytepairs._Known, "_hashed", staticmethod(lambda w: np.full(len(w), 7, np.uint64)))
    known = bytepairs._Known()
    known.add(["a"])
    assert known.find(["b", "a"]).tolist() == [-1, 0]


def test_merkle_roots_that_come_one_by_one():
    leaves = [bytes([i]) * 5 for i in range(40)]
    for n in range(41):
        stack = chunk_store.MerkleStack()
        for x in leaves[:n]:
            stack.add(x)
        assert stack.root() == chunk_store.merkle(leaves[:n])


def test_cuts_dont_depend_on_the_documents_around():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 3000, n).astype("<u4") for n in (1, 127, 128, 129, 5000, 40, 12000, 300)]
    ends = np.cumsum([len(d) for d in docs])
    for d, e, got in zip(docs, ends.tolist(), chunk_store.cuts_of(np.concatenate(docs), ends), strict=True):
        assert [x - e + len(d) for x in got] == chunk_store.cuts(d)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_tree_merge_in_any_number_of_rounds(spark, keep):
    rng = random.Random(5)
    rows = [(None if rng.random() < 0.05 else rng.randrange(10**6), "hot" if rng.random() < 0.4 else f"t{rng.randrange(300)}") for _ in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = defaultdict(list)
    for i, t in rows:
        want[t].append(i)
    best = min if keep == "min" else max
    answer = Counter((best((i for i in ids if i is not None), default=None), len(ids)) for ids in want.values())
    for rounds, runs in ((1, 4), (2, 9), (3, 8), (None, 70)):
        groups = exact.tree_merge(exact.digests(docs), keep, rounds, runs)
        assert Counter((r["keep_id"], r["group_size"]) for r in groups.collect()) == answer
    strings = exact.tree_merge(exact.digests(docs.withColumn("doc_id", F.format_string("%07d", "doc_id"))), keep).collect()
    assert len(strings) == len(want)


def test_hash_share_takes_a_little_more_than_asked(spark):
    h = F.xxhash64("id")
    for n in (50, 20_000):
        got = spark.range(n).where(common.hash_share(h, 500, n)).count()
        assert min(n, 500) <= got <= min(n, 1100)


def test_long_urls_and_null_pages(spark):
    long = "https://a.example.org/es/" + "x/" * 200_000 + "?q#f"
    rows = [(1, long), (None, "HTTP://COM/fr/a"), (None, None), (4, "://"), (4, "://"), (5, "x" * 500_000)]
    got = urls.judge_urls(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, host string"), queries.URL_RULES).collect()
    assert Counter((r["page_id"], r["rule"], r["verdict"]) for r in got) == Counter([(1, "example.org/es/", "block"), (None, "com/fr/", "allow"), (None, None, "allow"), (4, None, "allow"), (4, None, "allow"), (5, None, "allow")])


def test_forest_scores_are_path_lengths():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(600, len(quality.RATES)))
    forest = quality.IsolationForest(rows, trees=20, sample=64)
    some = np.concatenate([rows[:40], rng.normal(size=(10, rows.shape[1])) * 9])
    for x, got in zip(some, forest.score(some), strict=True):
        total = 0.0
        for what, at, child, length in forest.trees:
            node = 0
            while what[node] >= 0:
                node = child[node] + (1 if x[what[node]] >= at[node] else 0)
            total += length[node]
        assert math.isclose(got, 2 ** (-total / 20 / quality.expected_path(64)), rel_tol=1e-12)
    assert forest.score(some)[40:].min() > np.median(forest.score(rows))


def test_threshold_is_the_best_of_all_places():
    rng = random.Random(6)
    for _ in range(40):
        good, bad = ([round(rng.gauss(m, 0.2), 2) for _ in range(rng.randrange(1, 60))] for m in (0.4, 0.6))
        share = rng.choice((0.5, 0.9, 0.99))
        gain = lambda t: sum(b > t for b in bad) / len(bad) - sum(g > t for g in good) / len(good)
        allowed = [t for t in [x + 0.001 for x in (*good, *bad)] if sum(g > t for g in good) <= (1 - share) * len(good) + 1e-9]
        got = quality.threshold(np.array(good), np.array(bad), share)
        assert sum(g > got for g in good) <= (1 - share) * len(good) + 1e-9
        assert math.isclose(gain(got), max(map(gain, allowed)), abs_tol=1e-9)


def test_forest_and_threshold_are_fitted_on_all_labelled_rows(spark):
    """9,000 good rows and 8,500 bad ones, some labelled both: trees draw from all good rows, and all set the threshold, good ones by trees that didn't draw them."""
    rng = np.random.default_rng(5)
    n, both, n_bad = 9000, 100, 8500
    x = np.abs(rng.normal(size=(n + n_bad - both, len(quality.RATES)))) / 20
    x[n:] += 0.08
    x[:, 0] += 5
    stats = spark.createDataFrame([(i, False, r) for i, r in enumerate(x.tolist())] + [(10**6, True, x[0].tolist())], "id long, base_failed boolean, rates array<double>")
    marks = [(i, 1) for i in range(n)] + [(i, 0) for i in range(n - both, len(x))] + [(10**6, 1), (None, 1), (10**7, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    h = F.xxhash64(F.lit(7), "id")
    places = np.array(stats.where("NOT base_failed").orderBy("id").select(*(F.xxhash64(F.lit(t), h).alias(f"t{t}") for t in range(100))).toPandas())
    drawn = [np.argsort(places[:n, t])[:256] for t in range(100)]
    forest = quality.IsolationForest(x[:0], drawn=[quality.features(x[d]) for d in drawn])
    seen = np.zeros((len(x), 100), bool)
    for t, d in enumerate(drawn):
        seen[d, t] = True
    score = forest.score(quality.features(x), seen)
    for marked, bad in ((labels, score[n - both :]), (labels.where("quality = 1"), score[:0])):
        got, at = quality.fit(stats, marked)
        assert np.array_equal(got.score(quality.features(x)), forest.score(quality.features(x)))
        assert math.isclose(at, quality.threshold(score[:n], bad, 0.99), rel_tol=1e-12)


def test_best_place_is_the_threshold_of_arrays(spark):
    rng = random.Random(9)
    for k, share in enumerate((0.5, 0.9, 0.99, 0.9)):
        good, bad = ([round(rng.gauss(m, 0.2), 2) for _ in range(rng.randrange(1, 60))] for m in (0.4, 0.6))
        bad = bad if k < 3 else []
        rows = [(s, True, False) for s in good] + [(s, False, True) for s in bad]
        got = quality.best_place(spark.createDataFrame(rows, "score double, good boolean, bad boolean"), share)
        assert math.isclose(got, quality.threshold(np.array(good), np.array(bad), share), rel_tol=1e-12)


def test_isotonic_is_the_nearest_rising_function():
    rng = np.random.default_rng(7)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        x, y = rng.integers(0, 12, n).astype(float), rng.integers(0, 2, n).astype(float)
        at, p = toxicity.isotonic(x, y)
        values = np.unique(x)
        mean, weight = np.array([y[x == v].mean() for v in values]), np.array([(x == v).sum() for v in values])
        # max over starts of min over ends of the weighted means between them
        want = [max(min(np.average(mean[a:b], weights=weight[a:b]) for b in range(k + 1, len(values) + 1)) for a in range(k + 1)) for k in range(len(values))]
        assert np.all(np.diff(p) > 0) and np.allclose(p[np.searchsorted(at, values)], want)


def test_folds_are_scored_by_what_has_not_seen_them(spark, monkeypatch):
    """Each text has a word of its own, and toxic ones one of their fold: a lexicon without the fold doesn't have it."""
    h = [r["h"] for r in spark.range(600).select(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(toxicity.FOLDS)).alias("h")).collect()]
    words = ["alpha", "bravo", "gamma"]
    docs = spark.createDataFrame([(i, ("you idiot " + words[h[i]] + "x " if i % 2 else "kind words ") + f"own{i} " * 3) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(600)], "doc_id long, quality int, toxic int")
    seen, whole = [], toxicity.learn_lexicons
    monkeypatch.setattr(toxicity, "learn_lexicons", lambda rows: seen.append(whole(rows)) or seen[-1])
    scored = toxicity.score_documents(docs, labels).collect()
    for k, lexicon in enumerate(seen[0]):
        assert "=idiot" in lexicon and {w for w in words if f"={w}x" in lexicon} == set(words) - set(words[k : k + 1])
    assert all(r["predicted"] == r["doc_id"] % 2 for r in scored)


def test_alphabets_of_any_size_are_told_apart():
    rng = random.Random(1)
    made = lambda chars, n=16_000: "".join(rng.choice(chars) for _ in range(n))
    han = [chr(0x4E00 + i) for i in range(2500)]
    texts = {"zh": made(han), "ja": made([chr(0x3040 + i) for i in range(90)] + han[::5]), "ru": made("абвгдежзиклмнопрстуфхц "), "en": made("abcdefghijklmnop ")}
    model = language.LanguageModel({k: [t] for k, t in texts.items()})
    for k, t in texts.items():
        found = model.predict([t[i : i + 60] for i in range(0, 3000, 300)])
        assert all(lang == k and score > 0.9 for lang, score in found)
        assert sum(len(a) for a in model.automata[model.langs.index(k)]) < 12 * len(t)
    parts = list(texts.values())
    for _ in range(30):
        text = "".join(rng.choice(parts)[k : k + rng.randrange(1, 9)] for k in (rng.randrange(15_000) for _ in range(140)))
        assert len(text) > language.LANE / 2
        for j, k in enumerate(model.langs):
            n = 0
            for lane in (text[i : i + language.LANE] for i in range(0, len(text), language.LANE)):
                i = 0
                while i < len(lane):
                    size = 1
                    while i + size < len(lane) and lane[i : i + size + 1] in texts[k]:
                        size += 1
                    i, n = i + size, n + 1
            assert model.phrases([text])[0][0, j] == n


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some words", f"l{i % 4}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language.fit(docs)
    assert language.fit(docs.where("lang != 'l3'")).langs == ["l0", "l1", "l2"]


def test_languages_are_learned_from_whole_texts(spark):
    """Openings are the same in both languages; what follows isn't."""
    rng = random.Random(2)
    words = {"aa": ["bala", "dumo", "siri"], "bb": ["krecht", "wolft", "zimp"]}
    docs = [(i, "all texts begin with these words " * 30 + " ".join(rng.choice(words["ab"[i % 2] * 2]) for _ in range(900)), "ab"[i % 2] * 2) for i in range(200)]
    rows = language.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == "ab"[r["doc_id"] % 2] * 2 for r in rows)


def test_schedule_is_that_of_the_points(spark):
    need = [40, 1, 0, 7, 300, 13]
    total, at, rows = sum(need), 0, []
    for rank, n in enumerate(need):
        rows.append((rank, at / total, (at + n) / total, n))
        at += n
    per_source = spark.createDataFrame(rows, "rank int, lo double, hi double, need long")
    got = {r["slot"]: (r["rank"], r["turn"]) for r in mixing.schedule(per_source, total, True).collect()}
    turns, given, spare = Counter(), {}, []
    for slot in range(total):
        u = (slot + 1) * mixing.GOLDEN % 1
        rank = next(r[0] for r in rows if r[1] <= u < r[2])
        if turns[rank] < need[rank]:
            given[slot] = rank
        else:
            spare.append(slot)
        turns[rank] += 1
    short = [rank for rank, n in enumerate(need) for _ in range(max(0, n - turns[rank]))]
    given |= dict(zip(spare, short, strict=True))
    seen, want = Counter(), {}
    for slot in range(total):
        want[slot] = given[slot], seen[given[slot]]
        seen[given[slot]] += 1
    assert got == want and [seen[r] for r in range(len(need))] == need
