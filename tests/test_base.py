"""Readers, writers, the engine, streams and helpers, on small rows of their own."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import catalog as C
from weftline.functions.joins import join_one
from weftline.functions.order import numbered, running_counts
from weftline.operators import ingest, people, regress
from weftline.operators.documents import build_documents
from weftline.plans import cli
from weftline.plans.engine import SearchEngine, as_bool, as_number, encoder, options
from weftline.sources import io, sinks, tables
from weftline.streaming import merge

PRODUCTS = """Name of  Product , price,How many in stock,description,type,features
Aloe Vera Shampoo, 10.5,3,Shampoo &amp; more,gel,Hair (3); Curl
Beard Oil,7,in stock,,oil,Beard
Baby Wipes,2,0,"Soft, wet
wipes",,Kids
Hair Gel,5,,A gel for hair and curls,gel,Hair
Curl defining shampoo,9,12.0,For curls,gel,Curl; Hair
"""


@pytest.fixture(scope="module")
def product_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("products") / "products.csv"
    path.write_text(PRODUCTS, encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def engine(spark, product_file):
    return SearchEngine(spark, cli.product_documents(spark, product_file))


def test_products_are_read_as_clean_text(spark, product_file):
    rows = io.read_products(spark, product_file).collect()
    assert len(rows) == 5 and rows[0]["name of product"] == "Aloe Vera Shampoo" and rows[0]["description"] == "Shampoo & more"
    assert rows[2]["description"] == "Soft, wet wipes" and rows[3]["how many in stock"] == ""


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("name of product,price\nx,1\n")
    with pytest.raises(ValueError, match="how many in stock"):
        io.read_products(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError, match="behavior_flag"):
        io.read_mails(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError, match="created_at"):
        io.read_posts(spark, str(tmp_path / "bad.csv"))


def test_posts_of_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("views,likes,created_at\n10,5,2026-01-05 10:00:00\n0,1,never\n30,3,2026-01-11 23:59:59\n")
    rows = io.read_posts(spark, str(tmp_path / "a.csv")).collect()
    assert [r["like_rate"] for r in rows] == [0.5, None, 0.1] and rows[1]["created_at"] is None
    made = sinks.write_comparison(cli.post_tables(spark, [str(tmp_path / "a.csv")]), "row", str(tmp_path / "out"), 2)
    summary = spark.read.csv(made["summary"], header=True).collect()
    assert summary[0]["account"] == "a" and summary[0]["views_total"] == "40" and summary[0]["likes_median"] == "3.0"
    assert spark.read.csv(made["top_posts"], header=True).where("account = 'a'").count() == 2
    weekly = spark.read.csv(made["weekly"], header=True).collect()
    assert [(r["week_start"][:10], r["views"]) for r in weekly] == [("2026-01-05", "40")]


def test_times_after_the_year_9999_have_no_sign(spark):
    items = spark.createDataFrame([(1, 253402300799), (2, 253402300800), (3, 518400000000), (4, None)], "playCount long, createTime long").withColumn("diggCount", F.lit(0))
    assert [r["created_at"] for r in io.post_rows(items).orderBy("views").collect()] == ["9999-12-31 23:59:59", "10000-01-01 00:00:00", "18397-06-11 00:00:00", "1970-01-01 00:00:00"]


def test_product_file_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("B x", "1", "2", "d", "oil", ["b", "A"])], "name string, price string, stock string, description string, type string, features array<string>")
    io.write_products(rows, str(tmp_path / "p"))
    back = io.read_products(spark, str(tmp_path / "p")).collect()
    assert [tuple(r) for r in back] == [("B x", "1", "2", "d", "oil", "A; b")]


def test_search_and_expansion_come_from_one_expansion(engine, monkeypatch):
    from weftline.operators import search as S

    calls, whole = [], S.expand
    monkeypatch.setattr(S, "expand", lambda *a, **k: calls.append(1) or whole(*a, **k))
    found, shown = engine.answer("curl shampoo", use_feedback="no")
    titles = [r["title"] for r in found.collect()]
    assert titles[0] == "Curl defining shampoo" and len(calls) == 1
    row = shown.first()
    assert row["base_terms"] == ["curl", "shampoo"] and "wash" in row["synonym_terms"] and row["feedback_terms"] == []
    assert row["suggested_queries"][0].startswith("curl shampoo ") and len(calls) == 1


def test_engine_surface(engine):
    health = engine.health().first()
    assert health["status"] == "ok" and health["documents"] == 5 and health["vocabulary_terms"] > 10
    assert engine.brief("beard oil").first()["title"] == "Beard Oil"
    assert [r["suggestion"] for r in engine.suggest("hair").collect()][0].startswith("hair")
    assert engine.suggest("h").count() == 0
    assert engine.search("zzzz qqqq").count() == 0
    with pytest.raises(ValueError, match="query"):
        engine.search(" ")
    with pytest.raises(ValueError, match="backend"):
        encoder("other", engine.index)
    assert encoder("rnn", engine.index) is None


def test_parameters():
    assert as_bool("Yes", False) and not as_bool("0", True) and as_bool(None, True)
    assert as_number("x", 5, 1, 9) == 5 and as_number("99", 5, 1, 9) == 9 and as_number("nan", 0.5, 0.0, 1.0) == 0.5
    o = options({"top_k": "500", "use_synonyms": "false", "embedding_min_sim": "-1"})
    assert o.top_k == 50 and not o.use_synonyms and o.embedding_min_sim == 0.0 and o.use_embeddings


def test_evaluation_has_labels_and_latency(engine):
    rows, summary = engine.evaluate(["beard oil", "curl shampoo"], {"beard oil": [1, 4]}, 3)
    a, b = rows.collect()
    assert (a["label_source"], a["relevant_docs"], a["recall_at_k"]) == ("manual", 2, 0.5)
    assert b["label_source"] == "heuristic" and b["relevant_docs"] == 2 and b["latency_ms"] > 0
    assert summary.first()["queries"] == 2


def test_index_in_one_file(engine, tmp_path):
    docs, index = sinks.write_index_file(engine.index, engine.docs, str(tmp_path / "index"))
    docs, index = (json.load(open(p)) for p in (docs, index))
    assert index["version"] == 1 and index["docs"] == docs and [d["id"] for d in docs] == ["1", "2", "3", "4", "5"]
    assert index["vocab"] == sorted(index["vocab"]) and len(index["idf"]) == len(index["vocab"]) and len(index["doc_norms"]) == len(index["doc_vectors"]) == 5
    oil = index["vocab"].index("oil")
    assert index["inverted_index"]["oil"] == [[1, 2]] and any(t == oil for t, _ in index["doc_vectors"][1])
    for vector, norm in zip(index["doc_vectors"], index["doc_norms"], strict=True):
        assert math.isclose(math.sqrt(sum(w * w for _, w in vector)), norm, rel_tol=1e-4)
    with pytest.raises(ValueError, match="more than 2"):
        sinks.write_index_file(engine.index, engine.docs, str(tmp_path / "small"), most=2)


def test_command_line(spark, product_file, tmp_path):
    run = lambda *a: cli.run(spark, cli.parser().parse_args(a))
    found = json.loads(run("search", "beard oil", "--data-path", product_file, "--top-k", "2"))
    assert found[0]["title"] == "Beard Oil"
    assert "index.json" in run("export", "--data-path", product_file, "--output-dir", str(tmp_path / "x"))


def test_people_outputs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(people, "models", lambda n, seed=42: {"Gradient Boosting": regress.BoostedTrees(5), "Random Forest": regress.Forest(5), "Ridge Regression": regress.Ridge()})
    words = "communicate transparent ownership integrity strategy vision mentor coach solve improve report meeting".split()
    rng = np.random.default_rng(1)
    rows = [(i, f"Person {i % 9}", " ".join(rng.choice(words, 4)), " ".join(rng.choice(words, 12)), "gap" if i % 3 == 0 else None, ("Positive", "Negative - Abuse", None, "Positive - Brave")[(i % 9) % 4]) for i in range(90)]
    mails = spark.createDataFrame(rows, "email_id long, from_name string, subject string, body string, skill_gap string, behavior_flag string")
    scored = people.run(mails, 5, n_topics=4)
    cover = people.coverage(people.mail_features(mails))
    made = sinks.write_people(scored, cover, str(tmp_path / "people"))
    out = scored.people.collect()
    assert len(out) == 9 and all(0 <= r["ml_score"] <= 1 and 0 <= r["target_score"] <= 1 for r in out) and max(r["ml_score"] for r in out) == 1
    means = {}
    for r in out:
        means.setdefault(r["cluster"], []).append(r["flag_score"])
    order = [np.mean(means[c]) for c in sorted(means)]
    assert order == sorted(order) and set(means) <= {0, 1, 2}
    assert set(scored.cv) == {"Gradient Boosting", "Random Forest", "Ridge Regression"} and scored.model_name == people.best_model(scored.cv)
    summary = json.load(open(made["summary"]))
    assert summary["people"] == 9 and sum(summary["decision_counts"].values()) == 9
    assert spark.read.csv(made["decisions"], header=True).count() == 9
    text = "\n".join(r[0] for r in spark.read.text(made["skill_gaps"]).collect())
    assert text.count("Person : ") == 9 and "Development plan recommended" in text
    profile = people.skill_profile(scored.people, scored.features, scored.model, ["communication", "mentorship"]).collect()
    assert len(profile) == 18 and all(0 <= r["profile"] <= 1 for r in profile)
    assert 0 < people.importances(spark, scored.model, scored.features).count() <= 20


def test_topics_are_the_singular_directions(spark):
    rng = np.random.default_rng(3)
    x = rng.random((40, 12)) * (rng.random((40, 12)) < 0.5)
    rows = [(i, f"t{j:02}", float(x[i, j])) for i in range(40) for j in range(12) if x[i, j]]
    got = people.topics(spark.createDataFrame(rows, "id long, term string, weight double"), "id", 3, rounds=30).orderBy("id").collect()
    got = np.array([[r[f"lsa_{j}"] for j in range(3)] for r in got])
    u, s, _ = np.linalg.svd(x[sorted({r[0] for r in rows})], full_matrices=False)
    want = u[:, :3] * s[:3]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-4)


def test_regressors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = 2 * x[:, 1] + np.sign(x[:, 3]) + 0.05 * rng.normal(size=400)
    for model, most in ((regress.BoostedTrees(), 0.02), (regress.Forest(50, 6), 0.15), (regress.Ridge(), 0.25)):
        fit = model.fit(x[:300], y[:300])
        assert ((fit.predict(x[300:]) - y[300:]) ** 2).mean() < 2.5 * most * y.var() and set(np.argsort(-fit.importances)[:2]) == {1, 3}
    c = x - x.mean(0)
    assert np.allclose(regress.Ridge(3.0).fit(x, y).weights, np.linalg.solve(c.T @ c + 3 * np.eye(5), c.T @ (y - y.mean())))
    assert regress.BoostedTrees(3).fit(x[:1], y[:1]).predict(x[:2]).tolist() == [y[0], y[0]]
    centres, cost = regress.k_means(np.array([[0.0], [0.1], [9.0], [9.1]]), 2, 1)
    assert sorted(round(float(c[0]), 2) for c in centres) == [0.05, 9.05] and math.isclose(cost, 0.01)


def test_order_and_joins(spark):
    rng = np.random.default_rng(5)
    values = [(int(k), None if k % 50 == 0 else f"v{int(v):03}") for k, v in enumerate(rng.integers(0, 40, 500))]
    df = spark.createDataFrame(values, "id long, v string")
    got = {r["id"]: r["doc_pos"] for r in numbered(df, "v").collect()}
    assert sorted(got.values()) == list(range(500))
    order = [dict(values)[k] for k in sorted(got, key=got.get)]
    assert order == sorted(order, key=lambda v: (v is not None, v or ""))
    groups = spark.createDataFrame([(k % 3, float(k % 7)) for k in range(200)], "g int, x double")
    upto = {(r["g"], r["x"]): r["n"] for r in running_counts(groups, ["g"], "x", "n").collect()}
    assert all(n == sum(k % 3 == g and k % 7 <= x for k in range(200)) for (g, x), n in upto.items()) and len(upto) == 21
    left = spark.createDataFrame([(1 if k % 2 else k, k) for k in range(300)] + [(None, 999)], "k long, i long")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 300, 3)] + [(1, "hot")], "k long, w string")
    for how in ("inner", "left"):
        got, want = ({tuple(r) for r in df.select("k", "i", "w").collect()} for df in (join_one(left, right, ["k"], how=how), left.join(right, "k", how)))
        assert got == want


def test_features_and_urls(spark):
    url = lambda u, t: spark.range(1).select(C.filter_url(F.lit(u), F.lit(t)).alias("u")).first()["u"]
    assert url("https://x/c?page=2&sort=a&filter.p.tag=old#z", "Hair Care") == "https://x/c?sort=a&filter.p.tag=Hair+Care#z"
    assert url("https://x/c", "a&b") == "https://x/c?filter.p.tag=a%26b"
    records = spark.createDataFrame([(1, "Beard Oil", "https://x/products/beard-oil", ["Beard"]), (2, "Gel", "", [])], "key long, name string, url string, features array<string>")
    coming = spark.createDataFrame([("other", "https://x/products/Beard-Oil/?v=1", "Hair (3)"), ("GEL!", "", "Hold"), ("none", "", "Lost")], "name string, url string, feature string")
    assert {r["key"]: r["features"] for r in ingest.add_features(records, coming).collect()} == {1: ["Beard", "Hair"], 2: ["Hold"]}


def test_streams(spark, tmp_path):
    posts = [("a", "2026-01-05 10:00:00", 5, 1), ("a", "2026-01-11 23:00:00", 7, 2), ("b", "2026-01-12 00:00:00", 1, 1)]
    frame = spark.createDataFrame(posts, "account string, created_at string, views long, likes long").withColumn("created_at", F.col("created_at").cast("timestamp"))
    frame.write.parquet(str(tmp_path / "posts"))
    stream = merge.weekly_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "posts")))
    q = stream.writeStream.format("memory").queryName("weeks").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["account"], str(r["week_start"])[:10], r["views"]) for r in spark.table("weeks").collect()) == [("a", "2026-01-05", 12), ("b", "2026-01-12", 1)]
    events = [(1, 1, "Oil", "u1", "1", "", "", False, ["a"]), (1, 2, "Other", "u2", "2", "d", "5", False, ["b (2)"])]
    shape = "key long, at long, name string, url string, price string, description string, stock string, sold_out boolean, features array<string>"
    write = merge.merge_into(str(tmp_path / "events"))
    for n, e in ((0, events[:1]), (1, events[1:]), (1, events[1:]), (2, [(2, 9, "New", "", "", "", "", True, [])])):
        write(spark.createDataFrame(e, shape), n)
    got = {r["key"]: (r["name"], r["price"], r["stock"], r["features"]) for r in merge.merged(spark, str(tmp_path / "events")).collect()}
    assert got == {1: ("Oil", "2", "5", ["a", "b"]), 2: ("New", "", "0", [])}
    whole = ingest.merge_events(spark.createDataFrame([*events, (2, 9, "New", "", "", "", "", True, [])], shape), "key", "at")
    assert {tuple(r) for r in whole.select("key", "name", "url", "price", "description", "stock", "position", "type").collect()} == {tuple(r) for r in merge.merged(spark, str(tmp_path / "events")).select("key", "name", "url", "price", "description", "stock", "position", "type").collect()}
    assert sorted(p.name for p in (tmp_path / "events").iterdir()) == ["state=1", "state=2"]


def test_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext, conf = Context(), {}  # noqa: N815

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        tables.shared_dir(Session())
    kept = tables.materialize(spark.range(3), "three")
    assert kept.count() == 3 and tables.spread(kept).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_documents_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_pos long, " + ", ".join(f"`{c}` string" for c in io.PRODUCT_COLUMNS))
    assert SearchEngine(spark, build_documents(empty)).search("oil").count() == 0


def test_entities(spark):
    import html

    from weftline.functions import text as X

    texts = ["a &amp;amp; b &lt;b&gt; &copy;&nbsp;&eacute; &#233;&#xE9;&#x1F642; & AT&T &unknown; &amp", "&#0;&#55296;&#99999999;", "", None, "no ampersand", "&quot;&apos;&#39;&hellip;&"]
    got = [r["t"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string").select("k", X.unescape(F.col("x")).alias("t")).orderBy("k").collect()]
    for k in (2, 3, 4, 5):
        assert got[k] == (html.unescape(texts[k]) if texts[k] else texts[k])
    assert got[0] == html.unescape(texts[0][:-4]) + "&amp" and got[1] == "��&#99999999;"


def test_porter(spark):
    from weftline.functions.porter import porter, stem_word

    pairs = "caresses caress ponies poni ties tie agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl hopping hop falling fall filing file happy happi sky sky enjoy enjoy relational relat valenci valenc digitizer digit formality formal triplicate triplic hopeful hope allowance allow replacement replac adoption adopt bowdlerize bowdler probate probat rate rate controller control roll roll generalizations gener oscillators oscil dying die"
    words = pairs.split()
    assert [stem_word(w) for w in words[::2]] == words[1::2]
    got = spark.createDataFrame([("Ponies",), (None,), ("",)], "w string").select(porter(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in got] == ["poni", None, ""]
