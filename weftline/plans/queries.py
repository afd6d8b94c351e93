"""Queries by operator over the shared tables, and SQL that says the same in other words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import catalog as C
from weftline.functions import text as X
from weftline.functions.order import numbered
from weftline.operators import ingest, people, search, social, suggest
from weftline.operators.documents import build_documents
from weftline.plans.engine import SearchEngine
from weftline.sources import io, sinks
from weftline.sources.tables import materialize, read_table, spread

ASKED = ((0, "thble thing"), (1, "attion ering thing"), (2, "thing qqqq"), (3, "the of"), (4, "ering"), (5, ""), (6, "onble tion and anre"))
NEAR = {"thble": ["thing", "onble"], "thing": ["attion thble", "ering", "anre"], "ering": ["tion"], "qqqq": ["thre"], "things": ["reing", "anly"]}
TYPED = ((0, "bra"), (1, "gr"), (2, "e"), (3, "hair"), (4, "brand#1"), (5, "oil"), (6, "shampoo"))
SKILL_WORDS = {"Reach": ["thing", "attion", "ering"], "Care": ["thble", "tion", "onble", "zzzz"], "Drive": ["anre", "ment", "qqqq"]}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def lit(xs) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs) + "]"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows) + ")"


def sql_stem(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} LIKE '%{s}' AND length({t}) >= {len(s) + 3} THEN {t}[:-{len(s) + 1}]" for s in X.SUFFIXES) + f" ELSE {t} END"


def sql_tokens(text: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda x: NOT list_contains({lit(X.STOPWORDS)}, x)), lambda t: {sql_stem('t')})"


# products from parts

def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") - 1).alias("doc_pos"), F.col("p_name").alias("name of product"), F.format_string("%.2f", "p_retailprice").alias("price"), F.when(F.col("p_size") % 7 == 0, "in stock").when(F.col("p_size") % 5 == 0, "").otherwise((F.col("p_size") - 3).cast("string")).alias("how many in stock"), F.when(F.col("p_size") % 3 == 0, F.repeat(F.concat("p_name", F.lit(" &amp;  ")), 9)).otherwise("").alias("description"), F.col("p_type").alias("Type "), F.concat("p_brand", F.lit("; Size (4);"), "p_type").alias("features"))


_PARTS = """
WITH raw AS (SELECT p_partkey - 1 AS doc_pos, p_name AS name, printf('%.2f', p_retailprice) AS price,
  CASE WHEN p_size % 7 = 0 THEN 'in stock' WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size - 3 AS VARCHAR) END AS stock,
  CASE WHEN p_size % 3 = 0 THEN trim(repeat(p_name || ' & ', 9)) ELSE '' END AS description, p_type AS kind, p_brand || '; Size (4);' || p_type AS features FROM part),
labelled AS (SELECT *, CASE WHEN stock = '' THEN 'Stock unknown' WHEN TRY_CAST(stock AS DOUBLE) IS NULL THEN 'Stock: ' || stock
  WHEN trunc(TRY_CAST(stock AS DOUBLE)) <= 0 THEN 'Out of stock' ELSE CAST(CAST(trunc(TRY_CAST(stock AS DOUBLE)) AS BIGINT) AS VARCHAR) || ' in stock' END AS status FROM raw),
built AS (SELECT *, concat_ws(' | ', nullif(kind, ''), nullif(features, ''), price, status) AS metadata FROM labelled),
docs AS (SELECT doc_pos, CAST(doc_pos + 1 AS VARCHAR) AS id, name AS title, 'products' AS category, metadata, status AS date,
  concat_ws(' ', name, nullif(description, ''), kind, features, price, status) AS content, price, stock, kind AS type, features,
  CASE WHEN length(coalesce(nullif(description, ''), metadata)) > 180 THEN coalesce(nullif(description, ''), metadata)[:180] || '...' ELSE coalesce(nullif(description, ''), metadata) END AS snippet FROM built)
"""


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    named = p.toDF(*map(io.normal_header, p.columns))
    return build_documents(named.select("doc_pos", *[X.clean_text(F.col(f"`{c}`")).alias(c) for c in io.PRODUCT_COLUMNS]))


@query(_PARTS + "SELECT name AS \"name of product\", price, stock AS \"how many in stock\", description, kind AS type, features FROM raw")
def io01_products(spark, d):
    return io.products(parts(spark, d))


@query(_PARTS + "SELECT * FROM docs")
def sc12_documents(spark, d):
    return part_documents(spark, d)


@query(_PARTS + "SELECT doc_pos, status AS label FROM labelled")
def sc08_stock_label(spark, d):
    return parts(spark, d).select("doc_pos", C.stock_label(F.col("how many in stock")).alias("label"))


@query(_PARTS + "SELECT id, title, category, snippet, metadata, date FROM docs")
def io12_search_docs(spark, d):
    return part_documents(spark, d).select("id", "title", "category", "snippet", "metadata", "date")


@query("SELECT p_partkey, lower(regexp_replace(p_type, '[^a-zA-Z0-9]', '', 'g')) AS bare, CASE WHEN list_contains(" + lit(["", *X.STOPWORDS]) + ", lower(regexp_replace(p_type, '[^a-zA-Z0-9]', '', 'g'))) THEN '' ELSE " + sql_stem("lower(regexp_replace(p_type, '[^a-zA-Z0-9]', '', 'g'))") + " END AS term FROM part")
def sc07_normalize_term(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower(F.regexp_replace("p_type", "[^a-zA-Z0-9]", "")).alias("bare"), X.normalize_term(F.col("p_type")).alias("term"))


# text of documents and pages

@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(html, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g')) AS clean FROM pages")
def sc01_clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_text(F.col("html")).alias("clean"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains(" + lit(X.MAIL_STOPWORDS) + ", w)), ' ') AS clean FROM documents")
def sc03_clean_mail(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_mail(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents")
def sc04_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT DISTINCT w, {sql_stem('w')} AS stem FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)")
def sc05_stem(spark, d):
    return table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("w")).distinct().select("w", X.stem(F.col("w")).alias("stem"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains(" + lit([*X.STOPWORDS, *X.SUGGESTION_SKIP]) + ", w) AND NOT regexp_full_match(w, '[0-9]+')), ' ') AS words FROM documents")
def sr19_suggestion_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.suggestion_words(F.col("text")), " ").alias("words"))


# the index

_INDEX = f"""
WITH tok AS (SELECT doc_id AS doc_pos, {sql_tokens('text')} AS l FROM documents),
occ AS (SELECT doc_pos, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM tok),
post AS (SELECT term, doc_pos, count(*) AS tf, min(pos) - 1 AS first_pos FROM occ GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, count(*) AS df, ln((any_value(n.n) + 1.0) / (count(*) + 1)) + 1 AS idf FROM post, n GROUP BY term),
vec AS (SELECT term, doc_pos, tf * idf AS weight, first_pos FROM post JOIN idf USING (term)),
norm AS (SELECT d.doc_id AS doc_pos, coalesce(s.norm, 1.0) AS norm FROM documents d LEFT JOIN (SELECT doc_pos, sqrt(sum(weight * weight)) AS norm FROM vec GROUP BY doc_pos) s ON s.doc_pos = d.doc_id),
asked AS (SELECT CAST(q AS BIGINT) AS query_id, text AS query FROM {values(ASKED)} v(q, text)),
qocc AS (SELECT query_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM (SELECT query_id, {sql_tokens('query')} AS l FROM asked)),
qt AS (SELECT query_id, term, count(*) AS tf, min(pos) - 1 AS first_pos FROM qocc GROUP BY ALL),
qv AS (SELECT query_id, term, tf * idf AS weight FROM qt JOIN idf USING (term))
"""


def _index(spark, d) -> search.SearchIndex:
    return search.SearchIndex(table(spark, d, "documents").select(F.col("doc_id").alias("doc_pos"), F.col("text").alias("content")))


def _asked(spark) -> DataFrame:
    return spark.createDataFrame(list(ASKED), "query_id long, query string")


@query(_INDEX + "SELECT term, doc_pos, tf, first_pos FROM post")
def ag01_postings(spark, d):
    return _index(spark, d).postings.withColumn("first_pos", F.col("first_pos").cast("long"))


@query(_INDEX + "SELECT term, df, round(idf, 6) AS idf FROM idf")
def ag03_idf(spark, d):
    return _index(spark, d).idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query(_INDEX + "SELECT doc_pos, round(norm, 6) AS norm FROM norm")
def ag04_norms(spark, d):
    return _index(spark, d).norms.select("doc_pos", F.round("norm", 6).alias("norm"))


@query(_INDEX + "SELECT term, row_number() OVER (ORDER BY term) - 1 AS ordinal FROM idf")
def ag18_vocabulary(spark, d):
    return _index(spark, d).vocabulary()


@query(_INDEX + "SELECT (SELECT n FROM n) AS documents, count(*) AS vocabulary_terms FROM idf")
def ag17_stats(spark, d):
    return _index(spark, d).stats()


@query(_INDEX + "SELECT term, to_json(list([doc_pos, tf] ORDER BY doc_pos)) AS postings FROM post GROUP BY term")
def io13_postings(spark, d):
    return _index(spark, d).posting_lists.select("term", F.to_json(F.transform("postings", lambda x: F.array(x["doc_pos"], x["tf"]))).cast("string").alias("postings"))


@query(_INDEX + "SELECT query_id, doc_pos FROM post JOIN qt USING (term) GROUP BY query_id, doc_pos HAVING count(*) = (SELECT count(*) FROM qt q WHERE q.query_id = qt.query_id)")
def jn02_all_terms(spark, d):
    return search.and_candidates(search.query_terms(_asked(spark)), _index(spark, d))


@query(_INDEX + "SELECT DISTINCT query_id, doc_pos FROM post JOIN qt USING (term)")
def jn03_any_term(spark, d):
    return search.or_candidates(search.query_terms(_asked(spark)), _index(spark, d))


_SEARCH = """, hit AS (SELECT query_id, doc_pos, sum(q.weight * v.weight) AS dot FROM vec v JOIN qv q USING (term) GROUP BY query_id, doc_pos HAVING count(*) = (SELECT count(*) FROM qv x WHERE x.query_id = q.query_id)),
scored AS (SELECT query_id, doc_pos, dot / (norm * (SELECT sqrt(sum(weight * weight)) FROM qv x WHERE x.query_id = hit.query_id)) AS score FROM hit JOIN norm USING (doc_pos)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_pos) AS rank, doc_pos, round(score, 6) AS score FROM scored WHERE score > 0)
"""


@query(_INDEX + _SEARCH + "SELECT query_id, rank, doc_pos, score FROM ranked WHERE rank <= 10")
def sr01_search(spark, d):
    return search.search(_asked(spark), _index(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


_SYN = f""", syn0 AS (SELECT i, j, term, unnest({sql_tokens('v')}) AS synonym, generate_subscripts({sql_tokens('v')}, 1) AS p
  FROM (SELECT i, j, unnest({sql_tokens('t')}) AS term, v FROM {values([(i, j, t, v) for i, (t, vs) in enumerate(NEAR.items()) for j, v in enumerate(vs)])} s(i, j, t, v))),
syn AS (SELECT term, synonym, row_number() OVER (PARTITION BY term ORDER BY place0) AS ord FROM (SELECT term, synonym, min((i, j, p)) AS place0 FROM syn0 WHERE term <> synonym GROUP BY ALL)),
known AS (SELECT DISTINCT query_id FROM qv),
base AS (SELECT * FROM qt WHERE query_id IN (FROM known)),
st AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY place0) AS ord FROM (
  SELECT query_id, synonym AS term, min((first_pos, ord)) AS place0 FROM base JOIN syn USING (term) WHERE ord <= 3 GROUP BY ALL) x
  WHERE NOT EXISTS (FROM base b WHERE b.query_id = x.query_id AND b.term = x.term)),
exact AS (SELECT query_id, doc_pos FROM post JOIN base b USING (term) GROUP BY query_id, doc_pos HAVING count(*) = (SELECT count(*) FROM base x WHERE x.query_id = b.query_id)),
bdot AS (SELECT query_id, doc_pos, sum(q.weight * v.weight) / any_value(norm.norm) AS s FROM vec v JOIN qv q USING (term) JOIN exact USING (query_id, doc_pos) JOIN norm USING (doc_pos) GROUP BY ALL),
brank AS (SELECT query_id, doc_pos, row_number() OVER (PARTITION BY query_id ORDER BY round(s / (SELECT sqrt(sum(weight * weight)) FROM qv x WHERE x.query_id = bdot.query_id), 6) DESC, doc_pos) AS rank FROM bdot),
fb0 AS (SELECT query_id, term, sum(weight) AS w, min((rank, first_pos)) AS place0 FROM vec JOIN brank USING (doc_pos) WHERE rank <= 5 AND NOT EXISTS (FROM base b WHERE b.query_id = brank.query_id AND b.term = vec.term) GROUP BY ALL),
fb AS (SELECT query_id, term, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 6) DESC, place0) AS ord FROM fb0) WHERE ord <= 5)
"""
_EXPANDED = """, wt AS (SELECT query_id, term, arg_min(w, p) AS w FROM (SELECT query_id, term, CAST(tf AS DOUBLE) AS w, 0 AS p FROM base UNION ALL SELECT query_id, term, 0.7, 1 FROM st UNION ALL SELECT query_id, term, 0.6, 2 FROM fb) GROUP BY ALL),
ev AS (SELECT query_id, term, w * idf AS weight FROM wt JOIN idf USING (term)),
grp AS (SELECT query_id, term AS g, term FROM base UNION SELECT query_id, term, synonym FROM base JOIN syn USING (term) WHERE ord <= 3),
cnf AS (SELECT query_id, doc_pos FROM post JOIN grp USING (term) GROUP BY query_id, doc_pos HAVING count(DISTINCT g) = (SELECT count(*) FROM base b WHERE b.query_id = grp.query_id)),
cand0 AS (SELECT * FROM exact UNION SELECT * FROM cnf),
cand AS (SELECT * FROM cand0 UNION SELECT DISTINCT query_id, doc_pos FROM post JOIN ev USING (term) WHERE query_id NOT IN (SELECT query_id FROM cand0)),
edot AS (SELECT query_id, doc_pos, sum(e.weight * v.weight) / any_value(norm.norm) AS s FROM vec v JOIN ev e USING (term) JOIN cand USING (query_id, doc_pos) JOIN norm USING (doc_pos) GROUP BY ALL),
erank AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s / qn, 6) DESC, doc_pos) AS rank, doc_pos, round(s / qn, 6) AS score FROM edot JOIN (SELECT query_id, sqrt(sum(weight * weight)) AS qn FROM ev GROUP BY query_id) USING (query_id) WHERE s > 0)
"""


def _options() -> search.Options:
    return search.Options(synonyms=NEAR)


@query(_INDEX + _SYN + "SELECT term, ord, synonym FROM syn")
def sr04_synonym_table(spark, d):
    return search.synonym_table(spark, NEAR).withColumn("ord", F.col("ord").cast("long"))


@query(_INDEX + _SYN + "SELECT query_id, term, ord FROM st")
def sr05_synonyms(spark, d):
    return search.expand(_asked(spark), _index(spark, d), _options()).synonyms.withColumn("ord", F.col("ord").cast("long"))


@query(_INDEX + _SYN + "SELECT query_id, term, ord FROM fb")
def sr07_feedback(spark, d):
    return search.expand(_asked(spark), _index(spark, d), _options()).feedback.withColumn("ord", F.col("ord").cast("long"))


@query(_INDEX + _SYN + _EXPANDED + "SELECT query_id, term, round(weight, 6) AS weight FROM ev")
def sr13_weights(spark, d):
    return search.expand(_asked(spark), _index(spark, d), _options()).vector.select("query_id", "term", F.round("weight", 6).alias("weight"))


@query(_INDEX + _SYN + _EXPANDED + "SELECT query_id, doc_pos FROM cnf")
def jn04_term_groups(spark, d):
    index, table_ = _index(spark, d), search.synonym_table(spark, NEAR)
    terms = search.query_terms(_asked(spark))
    base = terms.join(index.named(index.idf, terms).join(terms, "term").select("query_id").distinct(), "query_id", "left_semi")
    return search.group_candidates(search.term_groups(base, table_), index)


@query(_INDEX + _SYN + _EXPANDED + "SELECT query_id, doc_pos FROM cand")
def sr14_candidates(spark, d):
    return search.expand(_asked(spark), _index(spark, d), _options()).candidates


@query(_INDEX + _SYN + _EXPANDED + "SELECT query_id, rank, doc_pos, score FROM erank WHERE rank <= 10")
def sr15_expanded_search(spark, d):
    return search.search_expanded(_asked(spark), _index(spark, d), _options()).withColumn("rank", F.col("rank").cast("long"))


_SHOWN = ", sh AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY p, ord) AS place FROM (SELECT query_id, term, min(p) AS p, arg_min(ord, p) AS ord FROM (SELECT *, 1 AS p FROM st UNION ALL SELECT *, 2 AS p FROM fb) WHERE regexp_matches(term, '[a-z]') GROUP BY ALL))"


@query(_INDEX + _SYN + _SHOWN + " SELECT query_id, place AS ord, query || ' ' || term AS suggestion FROM sh JOIN asked USING (query_id) WHERE place <= 4")
def sr18_suggested(spark, d):
    e = search.expand(_asked(spark), _index(spark, d), _options())
    return search.suggested_queries(_asked(spark), e.terms).withColumn("ord", F.col("ord").cast("long"))


_EVAL = ", rel AS (SELECT query_id, doc_pos FROM post JOIN qt USING (term) GROUP BY query_id, doc_pos HAVING count(*) = (SELECT count(*) FROM qt q WHERE q.query_id = qt.query_id)), ev1 AS (SELECT a.query_id, (SELECT count(*) FROM erank e WHERE e.query_id = a.query_id AND rank <= 10) AS results, (SELECT count(*) FROM rel r WHERE r.query_id = a.query_id) AS relevant_docs, (SELECT count(*) FROM erank e JOIN rel r USING (query_id, doc_pos) WHERE e.query_id = a.query_id AND rank <= 10) AS hits FROM asked a), ev2 AS (SELECT query_id, results, CASE WHEN results = 0 THEN 0.0::DOUBLE ELSE round(hits::DOUBLE / results, 3) END AS precision_at_k, CASE WHEN relevant_docs = 0 THEN 0.0::DOUBLE ELSE round(hits::DOUBLE / relevant_docs, 3) END AS recall_at_k, relevant_docs FROM ev1)"


def _evaluated(spark, d):
    index = _index(spark, d)
    return search.evaluate(_asked(spark), search.search_expanded(_asked(spark), index, _options()), search.relevant_by_terms(_asked(spark), index))


@query(_INDEX + _SYN + _EXPANDED + _EVAL + " SELECT * FROM ev2")
def sr23_evaluate(spark, d):
    return _evaluated(spark, d)


@query(_INDEX + _SYN + _EXPANDED + _EVAL + " SELECT count(*) AS queries, round(avg(precision_at_k), 3) AS mean_precision_at_k, round(avg(recall_at_k), 3) AS mean_recall_at_k FROM ev2")
def sr24_evaluation_summary(spark, d):
    return search.summarize(_evaluated(spark, d))


_EMBED = f"""
WITH v AS (SELECT DISTINCT {sql_stem('w')} AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) WHERE NOT list_contains({lit(X.STOPWORDS)}, w)),
t AS (SELECT term, unnest({sql_tokens('term')}) AS t FROM v),
g AS (SELECT term, t AS g FROM t UNION ALL SELECT term, substr('^' || t || '$', i, 3) FROM (SELECT term, t, unnest(range(1, length(t) + 1)) AS i FROM t)),
b AS (SELECT term, CAST(('0x' || md5(g)[:8])::BIGINT % 256 AS BIGINT) AS bucket, count(*) AS c FROM g GROUP BY ALL)
SELECT term, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY term)), 6) AS value FROM b
"""


@query(_EMBED)
def sr10_term_vectors(spark, d):
    return search.embedding(_index(spark, d).idf.select("term"), ["term"], F.col("term")).select("term", "bucket", F.round("value", 6).alias("value"))


def _sql_vectors(name: str, source: str, key: str, text: str) -> str:
    """name (key, bucket, value): hashed vectors of the texts of source."""
    return f""", {name}t AS (SELECT {key}, unnest({sql_tokens(text)}) AS t FROM {source}),
{name}g AS (SELECT {key}, t AS g FROM {name}t UNION ALL SELECT {key}, substr('^' || t || '$', i, 3) FROM (SELECT {key}, t, unnest(range(1, length(t) + 1)) AS i FROM {name}t)),
{name}b AS (SELECT {key}, ('0x' || md5(g)[:8])::BIGINT % 256 AS bucket, count(*) AS c FROM {name}g GROUP BY ALL),
{name} AS (SELECT {key}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS value FROM {name}b)"""


@query(_INDEX + _sql_vectors("tv", "idf", "term", "term") + ", qx AS (SELECT query_id, string_agg(term, ' ' ORDER BY first_pos) AS text FROM qt GROUP BY query_id)" + _sql_vectors("av", "qx", "query_id", "text") + """,
sim AS (SELECT query_id, term, sum(a.value * t.value) AS sim FROM tv t JOIN av a USING (bucket) GROUP BY query_id, term)
SELECT query_id, term, ord FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, term) AS ord FROM sim
  WHERE round(sim, 6) >= 0.35 AND NOT EXISTS (FROM qt WHERE qt.query_id = sim.query_id AND qt.term = sim.term)) WHERE ord <= 5""")
def sr12_near_terms(spark, d):
    index = _index(spark, d)
    return search.near_terms(search.query_terms(_asked(spark)), index.idf.select("term"), 5, 0.35).withColumn("ord", F.col("ord").cast("long"))


# suggestions

_W = "list_filter(regexp_extract_all(lower(%s), '[a-z0-9]+'), lambda w: NOT list_contains(" + lit([*X.STOPWORDS, *X.SUGGESTION_SKIP]) + ", w) AND NOT regexp_full_match(w, '[0-9]+'))"
_FIXED = [(q, 20) for q in suggest.TEST_QUERIES] + [(t, 8) for t in search.SYNONYMS] + [(v, 4) for vs in search.SYNONYMS.values() for v in vs]
_SUGGEST = f"""
, tw AS (SELECT {_W % 'title'} AS w FROM docs), fw AS (SELECT {_W % 'c'} AS w FROM (SELECT unnest(string_split(features, ';')) AS c FROM docs)), kw AS (SELECT {_W % 'type'} AS w FROM docs),
alls AS (SELECT text AS phrase, CAST(n AS BIGINT) AS weight FROM {values(_FIXED)} f(text, n)
 UNION ALL SELECT array_to_string(w[:k], ' '), 6 - k FROM tw, range(1, 6) r(k) WHERE k <= len(w)
 UNION ALL SELECT array_to_string(w[i:i + k - 1], ' '), 2 FROM tw, range(2, 5) r(k), range(1, 40) s(i) WHERE i + k - 1 <= len(w)
 UNION ALL SELECT array_to_string(w[:k], ' '), 2 FROM (FROM fw UNION ALL FROM kw), range(1, 4) r(k) WHERE k <= len(w)),
sw AS (SELECT phrase, CAST(sum(weight) AS BIGINT) AS weight FROM alls WHERE length(phrase) >= 2 GROUP BY phrase)
"""


@query(_PARTS + _SUGGEST + "SELECT * FROM sw")
def sr20_suggestion_weights(spark, d):
    return suggest.suggestion_weights(part_documents(spark, d))


@query(_PARTS + _SUGGEST + f""", typed AS (SELECT CAST(q AS BIGINT) AS query_id, lower(text) AS q FROM {values(TYPED)} v(q, text)),
ss AS (SELECT query_id, phrase, weight * 10.0::DOUBLE + CASE WHEN starts_with(phrase, q) THEN 1000 WHEN contains(phrase, ' ' || q) THEN 700 WHEN contains(phrase, q) THEN 200 END - length(phrase) * 0.25::DOUBLE AS score FROM sw, typed WHERE length(q) >= 2 AND phrase <> q)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(phrase), phrase) AS rank, phrase AS suggestion, score FROM ss WHERE score IS NOT NULL) WHERE rank <= 8""")
def sr22_suggest(spark, d):
    asked = spark.createDataFrame(list(TYPED), "query_id long, query string")
    return suggest.suggest(asked, suggest.suggestion_weights(part_documents(spark, d))).withColumn("rank", F.col("rank").cast("long"))


# the engine's surface

@query(_INDEX + "SELECT 'ok' AS status, (SELECT n FROM n) AS documents, count(*) AS vocabulary_terms FROM idf")
def ap01_health(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc_pos"), F.col("text").alias("content"), *[F.lit("").alias(c) for c in ("title", "features", "type")])
    return SearchEngine(spark, docs).health()


@query(_PARTS + _SUGGEST + """SELECT phrase AS suggestion FROM sw WHERE starts_with(phrase, 'gr') OR contains(phrase, 'gr')
ORDER BY weight * 10.0::DOUBLE + CASE WHEN starts_with(phrase, 'gr') THEN 1000 WHEN contains(phrase, ' gr') THEN 700 ELSE 200 END - length(phrase) * 0.25::DOUBLE DESC, length(phrase), phrase LIMIT 12""")
def ap03_suggest(spark, d):
    """The most that can be asked for."""
    return SearchEngine(spark, part_documents(spark, d)).suggest(" GR ", 50)


# posts from events

def _posts(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("v", F.round(F.col("value") * 100).cast("bigint") - 100)
    e = e.select("event_id", F.col("event_type").alias("account"), F.greatest("v", F.lit(0).cast("bigint")).alias("views"), (F.col("user_id") % 100).alias("likes"), F.when(F.col("event_id") % 50 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("created_at"))
    return io.posts(e)


_POSTS = "WITH posts AS (SELECT event_id, event_type AS account, greatest(CAST(round(value * 100) AS BIGINT) - 100, 0) AS views, user_id % 100 AS likes, CASE WHEN event_id % 50 <> 0 THEN date_trunc('second', ts) END AS created_at FROM events), p AS (SELECT *, likes / nullif(views, 0) AS like_rate FROM posts) "


@query(_POSTS + "SELECT event_id, account, views, likes, created_at, round(like_rate, 9) AS like_rate FROM p")
def io05_posts(spark, d):
    return _posts(spark, d).withColumn("like_rate", F.round("like_rate", 9))


@query(_POSTS + "SELECT account, count(*) AS posts, CAST(sum(views) AS BIGINT) AS views_total, round(avg(views), 6) AS views_avg, CAST(median(views) AS DOUBLE) AS views_median, CAST(sum(likes) AS BIGINT) AS likes_total, round(avg(likes), 6) AS likes_avg, CAST(median(likes) AS DOUBLE) AS likes_median, round(avg(like_rate), 6) AS like_rate_avg, min(created_at) AS date_min, max(created_at) AS date_max FROM p GROUP BY account")
def ag11_summary(spark, d):
    s = social.summarize(_posts(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in ("views_avg", "likes_avg", "like_rate_avg")})


@query(_POSTS + "SELECT account, date_trunc('week', created_at)::TIMESTAMP AS week_start, CAST(sum(views) AS BIGINT) AS views, CAST(sum(likes) AS BIGINT) AS likes FROM p WHERE created_at IS NOT NULL GROUP BY ALL")
def ag12_weekly(spark, d):
    return social.weekly(_posts(spark, d))


@query(_POSTS + "SELECT account, rank, event_id, views, likes FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY views DESC, event_id) AS rank FROM p) WHERE rank <= 5")
def so05_top_posts(spark, d):
    return social.top_posts(_posts(spark, d), "event_id").select("account", F.col("rank").cast("long").alias("rank"), "event_id", "views", "likes")


@query("SELECT o_orderkey, CASE WHEN v >= 1000000 THEN regexp_replace(printf('%.1f', v / 1000000), '\\.0$', '') || 'M' WHEN v >= 1000 THEN regexp_replace(printf('%.1f', v / 1000), '\\.0$', '') || 'K' WHEN round_even(v, 0) = 1000 THEN '1,000' ELSE CAST(CAST(round_even(v, 0) AS BIGINT) AS VARCHAR) END AS compact FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 37.1234567 WHEN o_orderkey % 3 = 1 THEN o_totalprice / 512.345678 ELSE o_totalprice * 1.2345678 END AS v FROM orders)")
def sc18_compact(spark, d):
    v = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") * 37.1234567).when(F.col("o_orderkey") % 3 == 1, F.col("o_totalprice") / 512.345678).otherwise(F.col("o_totalprice") * 1.2345678)
    return table(spark, d, "orders").select("o_orderkey", X.format_compact(v).alias("compact"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS views, user_id AS likes, strftime(make_timestamp(CAST(event_id * 86400 * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS created_at FROM events")
def io08_post_rows(spark, d):
    e = table(spark, d, "events")
    return io.post_rows(e.select(F.from_json("props", "k long")["k"].alias("playCount"), F.col("user_id").alias("diggCount"), (F.col("event_id") * 86400).alias("createTime")))


@query("SELECT CAST(event_id AS VARCHAR) AS id, coalesce(strftime(CASE WHEN event_id % 9 > 0 THEN ts END, '%Y-%m-%dT%H:%M:%S'), '') AS created_at, event_type AS username, props AS content, user_id AS views, 0::BIGINT AS likes, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END::BIGINT AS replies, 0::BIGINT AS retweets, 0::BIGINT AS quotes, '' AS lang FROM events")
def io09_message_rows(spark, d):
    none = F.lit(None)
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 > 0, F.col("ts")).alias("date"), F.col("event_type").alias("username"), F.col("props").alias("rawContent"), F.col("user_id").alias("viewCount"), none.alias("likeCount"), F.when(F.col("event_id") % 2 == 0, 3).alias("replyCount"), none.alias("retweetCount"), none.alias("quoteCount"), none.alias("lang"))
    return io.message_rows(e)


# catalog ingest

def _events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", F.when(F.col("event_id") % 11 > 0, F.concat(F.initcap("event_type"), F.lit(" Hair Oil "), "user_id")).otherwise(" ").alias("name"), F.concat(F.lit("https://Shop.example/products/Item-"), "user_id", F.lit("/?ref="), "event_id").alias("url"), F.when(F.col("event_id") % 3 == 0, F.round("value", 2).cast("string")).otherwise("").alias("price"), F.when(F.col("event_type") == "view", F.col("props")).otherwise("").alias("description"), F.when(F.col("event_type") == "purchase", (F.col("event_id") % 40).cast("string")).otherwise("").alias("stock"), (F.col("event_type") == "error").alias("sold_out"), F.array(F.concat("event_type", F.lit(" (3)")), F.lit("")).alias("features"))


_EVENTS = "WITH e AS (SELECT user_id, event_id, upper(event_type[1]) || event_type[2:] || ' Hair Oil ' || user_id AS name, 'https://Shop.example/products/Item-' || user_id || '/?ref=' || event_id AS url, CASE WHEN event_id % 3 = 0 THEN CAST(round(value, 2) AS VARCHAR) END AS price, CASE WHEN event_type = 'view' THEN trim(regexp_replace(props, '\\s+', ' ', 'g')) END AS description, CASE WHEN event_type = 'purchase' THEN CAST(event_id % 40 AS VARCHAR) WHEN event_type = 'error' THEN '0' END AS stock, event_type FROM events WHERE event_id % 11 > 0) "


@query(_EVENTS + "SELECT user_id AS key, arg_min(name, event_id) AS name, arg_min(url, event_id) AS url, coalesce(arg_max(price, event_id) FILTER (price IS NOT NULL), '') AS price, coalesce(arg_max(description, event_id) FILTER (description IS NOT NULL), '') AS description, coalesce(arg_max(stock, event_id) FILTER (stock IS NOT NULL), 'unknown') AS stock, array_to_string(list_sort(list(DISTINCT event_type)), '; ') AS features, min(event_id) AS position, 'oil' AS type FROM e GROUP BY user_id")
def ag16_merge_events(spark, d):
    return ingest.merge_events(_events(spark, d), "user_id", "event_id").withColumn("features", C.join_features(F.col("features")))


@query("WITH r AS (SELECT lower(trim(regexp_replace(p_name, '[^a-zA-Z0-9]+', ' ', 'g'))) AS key, * FROM part) SELECT key, min(p_partkey) AS position, arg_max(p_name, p_partkey) AS name, arg_max(p_retailprice, p_partkey) AS price FROM r GROUP BY key")
def io06_store_rows(spark, d):
    return io.store_rows(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")), "p_partkey")


@query("SELECT p_name AS \"name of product\", p_retailprice AS price, p_size AS \"how many in stock\", p_type AS description, '' AS type, array_to_string(list_sort(list_transform([lower(p_brand), 'zeta', 'Alpha'], lambda x: lower(x) || '|' || x)).list_transform(lambda y: string_split(y, '|')[2]), '; ') AS features FROM part")
def io07_product_lines(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("stock"), F.col("p_type").alias("description"), F.lit("").alias("type"), F.array(F.lower("p_brand"), F.lit("zeta"), F.lit("Alpha")).alias("features"))
    return io.product_lines(p)


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'shaving' WHEN 1 THEN 'body splash' WHEN 2 THEN 'gel' WHEN 3 THEN 'oil' WHEN 4 THEN 'cream' ELSE '' END AS kind FROM part")
def sc19_product_type(spark, d):
    name = F.concat(F.lit("Fine "), F.element_at(F.array(*map(F.lit, ("After Shave gel", "rose  SPLASH oil", "hair gel oil", "argan oil cream", "Body Lotion", "boiling"))), (F.col("p_size") % 6 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", C.product_type(name).alias("kind"))


@query("SELECT p_partkey, p_brand || ' Care' AS feature, array_to_string([p_brand, p_type || ' x'], '|') AS features FROM part")
def sc20_features(spark, d):
    return table(spark, d, "part").select("p_partkey", C.clean_feature(F.concat(F.lit(" "), "p_brand", F.lit("  Care (12) "))).alias("feature"), F.array_join(C.parse_features(F.concat("p_brand", F.lit(" (3);; "), "p_type", F.lit("  x ;"), "p_brand")), "|").alias("features"))


@query("SELECT p_partkey, lower(trim(regexp_replace(p_name || ' -- ' || p_brand, '[^A-Za-z0-9]+', ' ', 'g'))) AS name FROM part")
def sc22_normalize_name(spark, d):
    return table(spark, d, "part").select("p_partkey", C.normalize_name(F.concat("p_name", F.lit(" -- "), "p_brand", F.lit("!"))).alias("name"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE lower('Item-' || page_id) END AS handle, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'https://x.example/products/Item-' || page_id || '.json' END AS json_url FROM pages")
def sc23_handles(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://x.example/about/"), "page_id")).otherwise(F.concat(F.lit("https://x.example/products/Item-"), "page_id", F.lit("/?a=1")))
    return table(spark, d, "pages").select("page_id", C.product_handle(url).alias("handle"), C.product_json_url(url).alias("json_url"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages")
def sc26_html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", C.html_to_text(F.col("html")).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_size % 4 = 1 THEN '0' WHEN p_size % 3 = 0 THEN 'in stock' ELSE 'unknown' END AS stock, p_size % 4 IN (0, 1) AS number FROM part")
def sc28_merge_stock(spark, d):
    s = F.col("p_size")
    out = C.merge_stock(F.when(s % 3 == 0, "in stock").otherwise("unknown"), F.when(s % 4 == 0, s.cast("string")).otherwise(""), s % 4 == 1)
    return table(spark, d, "part").select("p_partkey", out.alias("stock"), C.numeric_stock(out).alias("number"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN 'Best & new' END AS description, CASE event_id % 5 WHEN 0 THEN CAST(user_id + 2 AS VARCHAR) WHEN 1 THEN 'in stock' WHEN 2 THEN '0' WHEN 3 THEN 'unknown' END AS stock FROM events")
def io10_payloads(spark, d):
    variants = F.element_at(F.array(F.concat(F.lit('[{"inventory_quantity": '), "user_id", F.lit('}, {"inventory_quantity": 2}, {}]')), F.lit('[{"available": false}, {"available": true}]'), F.lit('[{"available": false}]'), F.lit("[]"), F.lit("")), (F.col("event_id") % 5 + 1).cast("int"))
    payload = F.when(F.col("event_id") % 5 == 4, "{broken").otherwise(F.concat(F.lit('{"product": {"body_html": "<p>Best &amp; <b>new</b></p>", "variants": '), variants, F.lit("}}")))
    return io.product_payloads(table(spark, d, "events").select("event_id", payload.alias("payload")), "payload").drop("payload")


@query("SELECT page_id, count(*) AS cards FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href=[\"''][^\"'']*[\"''][^>]*>(.*?)</a>', 1)) AS t FROM pages) WHERE trim(regexp_replace(t, '<[^>]+>', ' ', 'g')) <> '' GROUP BY page_id")
def sc30_cards(spark, d):
    return ingest.cards(table(spark, d, "pages").select("page_id", "html")).groupBy("page_id").agg(F.count("*").alias("cards"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')), ''), trim(regexp_replace(replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '&amp;', '&'), '\\s+', ' ', 'g'))) AS title FROM pages")
def sc31_page_details(spark, d):
    return ingest.page_details(table(spark, d, "pages").select("page_id", "html")).select("page_id", "title")


def sql_text(html: str) -> str:
    """html_to_text() for the few entities that the pages have."""
    for name, c in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        html = f"replace({html}, '{name}', '{c}')" if html.startswith("replace(") else f"replace(regexp_replace({html}, '<[^>]+>', ' ', 'g'), '{name}', '{c}')"
    return f"trim(regexp_replace({html}, '\\s+', ' ', 'g'))"


def sql_sold_out(html: str) -> str:
    return f"(regexp_matches({sql_text(html)}, '(?i)sold\\s*out') OR contains({html}, 'f-badge--soldout') OR regexp_matches({html}, '(?is)<button[^>]*name=[\"'']add[\"''][^>]*\\bdisabled'))"


@query(f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*href=["''][^"'']*["''][^>]*>.*?</a>') AS l FROM pages),
a AS (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS card FROM l)
SELECT page_id, card, regexp_extract(a, '(?is)href=["'']([^"'']*)', 1) AS href, {sql_text('a')} AS name, regexp_extract(a, '(?is)price-item--(?:sale|regular)[^>]*>([^<]*)', 1) AS price, {sql_sold_out('a')} AS sold_out
FROM a WHERE {sql_text('a')} <> ''""")
def sc30_card_rows(spark, d):
    return ingest.cards(table(spark, d, "pages").select("page_id", "html")).withColumn("card", F.col("card").cast("long"))


@query(f"""WITH p AS (SELECT page_id, html, {sql_text("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")} AS h1, {sql_text("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")} AS t,
 {sql_text("regexp_extract(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1)")} AS p, regexp_extract(html, '(?is)<meta[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)', 1) AS m,
 regexp_extract({sql_text('html')}, '(?i)\\b([0-9]+)\\s+(?:left\\s+)?in stock', 1) AS n FROM pages)
SELECT page_id, CASE WHEN h1 <> '' THEN h1 ELSE t END AS title, CASE WHEN p <> '' THEN p ELSE m END AS description,
 CASE WHEN n <> '' THEN n WHEN {sql_sold_out('html')} THEN '0' WHEN regexp_matches(html, '(?i)add to cart') THEN 'in stock' ELSE '' END AS stock FROM p""")
def sc31_page_rows(spark, d):
    return ingest.page_details(table(spark, d, "pages").select("page_id", "html")).drop("html")


@query("SELECT c_custkey, 'https://x.example/c?sort=' || (c_custkey % 3) || '&filter.p.tag=' || replace(replace(c_name, '#', '%23'), ' ', '+') || '#top' AS url FROM customer")
def sc25_filter_urls(spark, d):
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://x.example/c?page=2&filter.p.tag=old&sort="), k % 3, F.when(k % 2 == 0, "&page=7").otherwise(""), F.lit("#top"))
    return table(spark, d, "customer").select("c_custkey", C.filter_url(url, F.col("c_name")).alias("url"))


@query("""WITH r AS (SELECT p_partkey AS key, p_brand AS own FROM part), f AS (SELECT DISTINCT s_suppkey AS key, 'From ' || n_name AS feature FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT r.key, array_to_string(list_sort(list_filter([own, feature], lambda x: x IS NOT NULL)), '; ') AS features FROM r LEFT JOIN f USING (key)""")
def jn13_add_features(spark, d):
    records = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("part "), "p_partkey").alias("name"), F.lit("").alias("url"), F.array("p_brand").alias("features"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    coming = s.select(F.concat(F.lit("Part-"), "s_suppkey").alias("name"), F.lit("").alias("url"), F.concat(F.lit(" From "), "n_name", F.lit(" (4)")).alias("feature"))
    coming = coming.unionByName(coming).unionByName(coming.select(F.lit("no such record").alias("name"), "url", "feature"))
    return ingest.add_features(records, coming).select("key", F.array_join("features", "; ").alias("features"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS doc_pos FROM orders")
def wn03_numbered(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSS"), F.format_string("%012d", "o_orderkey")).alias("at"))
    return numbered(o, "at").select("o_orderkey", "doc_pos")


@query("SELECT n_regionkey AS page, min(n_nationkey) AS pos, arg_min(n_name, n_nationkey) AS label, arg_min(n_name[:1], n_nationkey) AS value FROM nation WHERE n_nationkey % 7 > 0 GROUP BY n_regionkey, lower(n_name[:1])")
def sc32_filter_options(spark, d):
    n = table(spark, d, "nation")
    return ingest.filter_options(n.select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("pos"), F.concat("n_name", F.lit(" (9)")).alias("label"), F.substring("n_name", 1, 1).alias("value"), (F.col("n_nationkey") % 7 == 0).alias("disabled")))


@query("""WITH r AS (SELECT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS description, CASE p_size % 3 WHEN 0 THEN '7' WHEN 1 THEN 'unknown' ELSE 'in stock' END AS stock,
 CASE WHEN p_size % 5 = 0 THEN 'detail' ELSE '' END AS ad, CASE p_size % 7 WHEN 0 THEN '3' WHEN 1 THEN 'in stock' ELSE '' END AS aks, CASE WHEN p_size % 11 < 6 THEN 'fallback' ELSE '' END AS bd, CASE p_size % 13 WHEN 0 THEN '9' WHEN 1 THEN 'in stock' ELSE '' END AS bs FROM part),
s AS (SELECT *, description = '' AS nd, stock <> '7' AS ns FROM r), f AS (SELECT *, (nd AND ad = '') OR (ns AND aks <> '3') AS more FROM s),
g AS (SELECT *, CASE WHEN ad <> '' THEN ad WHEN more THEN bd ELSE '' END AS dd, CASE WHEN more AND bs <> '' AND (aks = '' OR (aks = 'in stock' AND bs = '9')) THEN bs ELSE aks END AS ds FROM f)
SELECT key, CASE WHEN (nd OR ns) AND dd <> '' THEN dd ELSE description END AS description, CASE WHEN (nd OR ns) AND ds <> '' THEN ds ELSE stock END AS stock FROM g""")
def sc33_fill_details(spark, d):
    p, s = table(spark, d, "part"), F.col("p_size")
    r = p.select(F.col("p_partkey").alias("key"), F.when(s % 2 == 0, F.col("p_name")).otherwise("").alias("description"), F.when(s % 3 == 0, "7").when(s % 3 == 1, "unknown").otherwise("in stock").alias("stock"))
    a = p.select(F.col("p_partkey").alias("key"), F.when(s % 5 == 0, "detail").alias("description"), F.when(s % 7 == 0, "3").when(s % 7 == 1, "in stock").alias("stock"))
    b = p.select(F.col("p_partkey").alias("key"), F.when(s % 11 < 6, "fallback").alias("description"), F.when(s % 13 == 0, "9").when(s % 13 == 1, "in stock").alias("stock"))
    return ingest.fill_details(r, a, b)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN c_custkey END AS record_key FROM customer")
def jn12_match(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://x/products/P"), k)
    records = c.select(k.alias("key"), F.when(k % 2 == 0, F.col("c_name")).otherwise("").alias("name"), F.when(k % 3 == 0, url).otherwise("").alias("url"))
    coming = c.select("c_custkey", F.when(k % 3 == 1, F.concat(F.upper("c_name"), F.lit("!"))).otherwise("other").alias("name"), F.when(k % 3 == 0, F.concat(url, F.lit("/"))).otherwise("").alias("url"))
    return ingest.match_records(coming, records).select("c_custkey", "record_key")


# people from documents and labels

def _mails(spark, d) -> DataFrame:
    docs = spread(table(spark, d, "documents")).join(table(spark, d, "labels"), "doc_id", "left")
    flag = F.when(F.col("toxic") == 1, "Negative - Abuse").when(F.col("quality") == 0, "Negative").when(F.col("doc_id") % 10 == 0, "Positive - Exemplary").when(F.col("quality") == 1, "Positive")
    return docs.select(F.col("doc_id").alias("email_id"), F.col("source").alias("from_name"), F.col("lang").alias("subject"), F.col("text").alias("body"), F.when(F.col("doc_id") % 4 == 0, "gap").alias("skill_gap"), flag.alias("behavior_flag"))


_CLEAN = "array_to_string(list_filter(regexp_extract_all(lower(%s), '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains(" + lit(X.MAIL_STOPWORDS) + ", w)), ' ')"
_MAILS = f"""
WITH m AS (SELECT d.doc_id AS email_id, source AS from_name, {_CLEAN % 'text'} AS b, text, d.doc_id % 4 = 0 AS gap,
 CASE WHEN toxic = 1 THEN -1.4 WHEN quality = 0 THEN -1.0 WHEN d.doc_id % 10 = 0 THEN 1.2 WHEN quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS flag FROM documents d LEFT JOIN labels USING (doc_id)),
f AS (SELECT email_id, from_name, b, flag, CASE WHEN gap THEN -0.3 ELSE 0 END::DOUBLE AS has_gap, length(text) AS body_len, len(string_split(b, ' ')) * (b <> '')::INT AS token_count,
 {', '.join('+'.join(f"contains(b, '{w}')::INT" for w in ws) + f' AS {people.column_of(s)}' for s, ws in SKILL_WORDS.items())} FROM m)
"""
_NAMES = ", ".join(map(people.column_of, SKILL_WORDS))


def _features(spark, d) -> DataFrame:
    return people.mail_features(_mails(spark, d), SKILL_WORDS)


def _mail_texts(spark, d) -> DataFrame:
    return materialize(_features(spark, d).select("email_id", "clean_text"), "mail-texts")


@query(_MAILS + f"SELECT email_id, from_name, round(flag, 6) AS flag_score, round(has_gap, 6) AS has_gap, CAST(body_len AS BIGINT) AS body_len, CAST(token_count AS BIGINT) AS token_count, {', '.join(f'CAST({people.column_of(s)} AS BIGINT) AS {people.column_of(s)}' for s in SKILL_WORDS)} FROM f")
def sc16_mail_features(spark, d):
    f = _features(spark, d)
    return f.select("email_id", "from_name", F.round("flag_score", 6).alias("flag_score"), F.round("has_gap", 6).alias("has_gap"), *[F.col(c).cast("long").alias(c) for c in ("body_len", "token_count", *map(people.column_of, SKILL_WORDS))])


@query("SELECT source AS from_name, count(*) AS email_count FROM documents WHERE source <> 'src3' GROUP BY source HAVING count(*) >= 5")
def ag08_frequent_senders(spark, d):
    return people.frequent_senders(_mails(spark, d), 5, ("src3",))


_COVER = f", used AS (SELECT DISTINCT from_name, unnest(string_split(b, ' ')) AS word FROM f), listed AS (FROM {values([(s, i, w, len(ws)) for s, ws in SKILL_WORDS.items() for i, w in enumerate(ws)])} l(skill, ord, word, size)), c AS (SELECT p.from_name, l.skill, count(u.word) / any_value(l.size) AS coverage, coalesce(array_to_string(list(l.word ORDER BY ord) FILTER (u.word IS NOT NULL), ', '), '') AS evidence FROM (SELECT DISTINCT from_name FROM f) p CROSS JOIN listed l LEFT JOIN used u ON u.from_name = p.from_name AND u.word = l.word GROUP BY ALL)"


@query(_MAILS + _COVER + " SELECT from_name, skill, round(coverage, 6) AS coverage, evidence FROM c")
def ag09_coverage(spark, d):
    return people.coverage(_features(spark, d), SKILL_WORDS).select("from_name", "skill", F.round("coverage", 6).alias("coverage"), F.array_join("evidence", ", ").alias("evidence"))


@query(_MAILS + _COVER + " SELECT from_name, skill, round(coverage, 6) AS coverage, repeat('#', CAST(floor(coverage * 10) AS INT)) || repeat('.', 10 - CAST(floor(coverage * 10) AS INT)) AS bar, CASE WHEN coverage < 0.3 THEN 'GAP' WHEN coverage < 0.6 THEN 'Partial' ELSE 'OK' END AS flag, CASE WHEN coverage < 0.3 THEN 'Development plan recommended' WHEN evidence <> '' THEN 'Evidence tokens: ' || evidence ELSE '' END AS note FROM c")
def ml12_gap_report(spark, d):
    return people.gap_report(people.coverage(_features(spark, d), SKILL_WORDS))


_MATRIX = f", mx AS (SELECT from_name, avg(flag) AS flag_score, avg(has_gap) AS has_gap, avg(body_len) AS body_len, avg(token_count) AS token_count, {', '.join(f'avg({people.column_of(s)}) AS {people.column_of(s)}' for s in SKILL_WORDS)}, count(*) AS email_count FROM f GROUP BY from_name HAVING count(*) >= 5), m2 AS (SELECT *, ln(1 + email_count) / max(ln(1 + email_count)) OVER () AS log_email_count FROM mx)"
_MEANS = ("flag_score", "has_gap", "body_len", "token_count", *map(people.column_of, SKILL_WORDS), "log_email_count")


def _matrix(spark, d) -> DataFrame:
    return people.person_matrix(_features(spark, d), people.frequent_senders(_mails(spark, d)), SKILL_WORDS)


@query(_MAILS + _MATRIX + " SELECT from_name, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MEANS) + ", email_count FROM m2")
def ag07_person_matrix(spark, d):
    return _matrix(spark, d).select("from_name", *[F.round(c, 6).alias(c) for c in _MEANS], "email_count")


@query(_MAILS + _MATRIX + " SELECT from_name, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () < 1e-12 THEN 1 ELSE stddev_pop({c}) OVER () END, 5) AS {c}" for c in ("flag_score", "token_count")) + " FROM m2")
def ml03_scaled(spark, d):
    return people.scaled(_matrix(spark, d), ["flag_score", "token_count"]).select("from_name", *[F.round(c, 5).alias(c) for c in ("flag_score", "token_count")])


@query(_MAILS + _MATRIX + """, cl AS (SELECT from_name, round(flag_score, 6) AS flag_score, CAST(email_count AS BIGINT) % 1 + CAST(from_name[4:] AS INT) % 4 AS cluster FROM m2),
mn AS (SELECT cluster, round(avg(flag_score), 9) AS m FROM cl GROUP BY cluster), bs AS (SELECT a.cluster, ((SELECT count(*) FROM mn b WHERE b.m < a.m) + ((SELECT count(*) FROM mn b WHERE b.m = a.m) - 1) / 2) / greatest(1, (SELECT count(*) FROM mn) - 1) AS base FROM mn a),
rw AS (SELECT from_name, base * 0.6 + 0.4 * 0.4 * (SELECT count(*) FROM cl b WHERE b.cluster = a.cluster AND b.flag_score <= a.flag_score) / (SELECT count(*) FROM cl b WHERE b.cluster = a.cluster) AS raw FROM cl a JOIN bs USING (cluster))
SELECT from_name, round(raw, 6) AS raw_target, round((raw - (SELECT min(raw) FROM rw)) / (SELECT max(raw) - min(raw) FROM rw), 6) AS target_score, CASE WHEN round((raw - (SELECT min(raw) FROM rw)) / (SELECT max(raw) - min(raw) FROM rw), 6) >= 0.65 THEN 'Raise Recommended' WHEN round((raw - (SELECT min(raw) FROM rw)) / (SELECT max(raw) - min(raw) FROM rw), 6) >= 0.45 THEN 'Under Review' ELSE 'Not Recommended' END AS decision FROM rw""")
def ml05_target(spark, d):
    p = _matrix(spark, d).select("from_name", F.round("flag_score", 6).alias("flag_score"), (F.substring("from_name", 4, 9).cast("int") % 4).alias("cluster"))
    t = people.target_scores(p).select("from_name", F.round("raw_target", 6).alias("raw_target"), F.round("target_score", 6).alias("target_score"))
    return t.withColumn("decision", X.decide(F.col("target_score")))


@query(_MAILS + ", w AS (SELECT email_id, list_filter(string_split(b, ' '), lambda x: length(x) > 1) AS l FROM f), g AS (SELECT email_id, unnest(l) AS term FROM w UNION ALL SELECT email_id, l[i] || ' ' || l[i + 1] FROM (SELECT email_id, l, unnest(range(1, len(l))) AS i FROM w)), tf AS (SELECT email_id, term, count(*) AS c FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY sum(c) DESC, term LIMIT 300), v AS (SELECT email_id, term, (1 + ln(c)) * (ln((1.0 + (SELECT count(*) FROM f)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term)) SELECT email_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY email_id)), 6) AS weight FROM v")
def ml01_tfidf(spark, d):
    return people.tfidf(_mail_texts(spark, d), "email_id", 300).withColumn("weight", F.round("weight", 6))


@query()
def ml02_topics(spark, d):
    return people.topics(people.tfidf(_mail_texts(spark, d), "email_id"), "email_id")


def _scored(spark, d) -> people.Scored:
    return people.run(_mails(spark, d), 5, SKILL_WORDS)


@query()
def ml04_clusters(spark, d):
    """Clusters of people, numbered by their mean flag."""
    return people.clusters(_matrix(spark, d), ["flag_score", *map(people.column_of, SKILL_WORDS), "log_email_count"]).select("from_name", "flag_score", "cluster")


@query()
def ml07_cross_validation(spark, d):
    """R2 and RMSE of each model, and which one is chosen."""
    scored = _scored(spark, d)
    return spark.createDataFrame([(k, x["r2"], x["rmse"], k == scored.model_name) for k, x in scored.cv.items()], "model string, r2 double, rmse double, chosen boolean")


@query()
def ag15_decision_counts(spark, d):
    return sinks.decision_counts(_scored(spark, d).people)


@query()
def ml10_skill_profile(spark, d):
    scored = _scored(spark, d)
    return people.skill_profile(scored.people, scored.features, scored.model, [people.column_of(s) for s in SKILL_WORDS])


@query()
def ml11_importances(spark, d):
    scored = _scored(spark, d)
    return people.importances(spark, scored.model, scored.features)


@query()
def ml13_people_pipeline(spark, d):
    """All stages, with the best of all models by cross-validation."""
    return people.decisions(_scored(spark, d).people, SKILL_WORDS)
