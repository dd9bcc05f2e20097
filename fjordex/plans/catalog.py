"""Every query of the core operators, and for each that SQL can express the statement that checks it."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordex.functions import codecs, distance, phonetic, stemming
from fjordex.functions import text as X
from fjordex.operators import bags, bloom, boolean, classify, extract, graph, index, metrics, ranked, strings, vectors
from fjordex.session import spread, written
from fjordex.sources import loaders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_kept: dict[tuple[str, str, str], Any] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def kept(s: SparkSession, d: str, name: str, make: Callable[[], DataFrame], order: str | None = None) -> DataFrame:
    """A table that several queries of a session share: written once below the shared folder, in order of a column by which it is pruned.

    It outlives the loss of executors and goes with the session's other tables.
    """
    key = (s.sparkContext.applicationId, d, name)
    if key not in _kept:
        df = make()
        _kept[key] = written(df if order is None else df.repartitionByRange(order).sortWithinPartitions(order), name)
    return _kept[key]


def kept_model(s: SparkSession, d: str, name: str, make: Callable[[], Any]) -> Any:
    """A trained model, whose tables are written, for the session."""
    key = (s.sparkContext.applicationId, d, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def docs_(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def post_(s: SparkSession, d: str) -> DataFrame:
    return kept(s, d, "postings", lambda: index.postings(spread(docs_(s, d)), ["text"], unique_ids=True), "term")


def places_(s: SparkSession, d: str) -> DataFrame:
    return kept(s, d, "positions", lambda: index.positions(spread(docs_(s, d)), ["text"]), "term")


def vocab_(s: SparkSession, d: str) -> DataFrame:
    return kept(s, d, "vocabulary", lambda: index.statistics(post_(s, d)), "term")


def films_(s: SparkSession, d: str) -> DataFrame:
    return loaders.merge(table(s, d, "films"), order=["title", "description", "genre", "release_year"])


# Fixed parameters of the queries.
RANKED_QUERY = "inverted index query"
PHRASE = "inverted ind"
PHRASES = ["inverted index", "suffix array", "posting list", "champion list", "k gram index", "variable byte code", "the document store", "index"]
NEAR = ["index", "query", "ranker", "merge", "trie", "posting"]
SYNONYMS = [("lookup", "search"), ("lookup", "query"), ("speed", "fast")]
WINDOW_QUERY = "index query"

# SQL fragments.
FOLD = "replace(lower({c}),'ß','ss')"
WORDS = r"'[\p{L}\p{N}_]+'"
TOK = f"regexp_extract_all({FOLD.format(c='text')},{WORDS})"
POST = f"post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY term, doc_id)"
STATS = "stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term)"
NDOCS = "(SELECT count(*) FROM documents)::DOUBLE"
FILMS = "f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY title NULLS FIRST, description NULLS FIRST, genre NULLS FIRST, release_year NULLS FIRST) AS rn FROM films) WHERE rn = 1)"


def _lower_terms(*words: str) -> str:
    return ",".join(f"'{w}'" for w in words)


# ---- sources and documents


@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS new_id, doc_id FROM documents WHERE NOT contains(coalesce(text,''), 'the')")
def doc_ids_after_drop(s: SparkSession, d: str) -> DataFrame:
    rows = loaders.run_pipeline(docs_(s, d), [lambda x: x.where(~F.coalesce("text", F.lit("")).contains("the"))])
    return index.dense_ids(rows.select("doc_id"), [F.col("doc_id")], "new_id").select(F.col("new_id").cast("long").alias("new_id"), "doc_id")


@query("SELECT doc_id, text, lang FROM documents WHERE doc_id = 42")
def doc_lookup(s: SparkSession, d: str) -> DataFrame:
    return docs_(s, d).where("doc_id = 42").select("doc_id", "text", "lang")


@query(f"WITH {FILMS}, g AS (SELECT DISTINCT doc_id, lower(trim(unnest(string_split(coalesce(genre,''), ',')))) AS label FROM f) SELECT label, count(*) AS films FROM g GROUP BY label")
def split_counts(s: SparkSession, d: str) -> DataFrame:
    return loaders.split_by(films_(s, d), "genre").groupBy("label").agg(F.count("*").alias("films"))


@query(f"WITH {FILMS} SELECT doc_id, title FROM f WHERE doc_id IS NOT NULL")
def merge_distinct(s: SparkSession, d: str) -> DataFrame:
    parts = loaders.split_by(films_(s, d), "genre").drop("label")
    return loaders.merge(parts, order=["title", "description", "genre", "release_year"]).where("doc_id is not null").select("doc_id", "title")


@query("SELECT airport_id, to_json({'document_id': airport_id, 'fields': {'airport_name': airport_name, 'airport_type': airport_type}}) AS json FROM (SELECT DISTINCT airport_id, trim(airport_name) AS airport_name, airport_type FROM airports) WHERE airport_name IS NOT NULL AND airport_type IS NOT NULL AND airport_id IS NOT NULL")
def doc_to_json(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "airports").select("airport_id", F.trim("airport_name").alias("airport_name"), "airport_type").distinct().dropna()
    return loaders.to_json(rows, "airport_id")


@query("SELECT doc_id, upper(lang) AS lang, length(text) AS chars FROM documents WHERE lang IS NOT NULL AND length(text) >= 100")
def pipeline_filter_derive(s: SparkSession, d: str) -> DataFrame:
    steps = [lambda x: x.where("lang is not null"), lambda x: x.withColumn("chars", F.length("text").cast("long")), lambda x: x.where("chars >= 100")]
    return loaders.run_pipeline(docs_(s, d), steps).select("doc_id", F.upper("lang").alias("lang"), "chars")


# ---- text functions


def nfkc_sql(text: str, table: str, more: str) -> str:
    """CTE o(r, ..., text) and y(r, canonical): compatibility characters by a table made from the Unicode database, one by one, then canonical composition.

    Texts of printable ASCII, which stay as they are, have no row in y.
    """
    pairs = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in (*range(0xA0, 0xD800), *range(0xE000, 0x20000)))
    rows = ",".join("('{}','{}')".format(a, b.replace("'", "''")) for a, b in pairs if b != unicodedata.normalize("NFC", a))
    return (
        f"m(c, k) AS (VALUES {rows}), o AS (SELECT row_number() OVER () AS r, * FROM (SELECT {text}{more} FROM {table})), "
        f"x AS (SELECT r, unnest(regexp_extract_all({text},'(?s).')) AS c, generate_subscripts(regexp_extract_all({text},'(?s).'),1) AS i FROM o WHERE NOT regexp_full_match({text},'[ -~]*')), "
        "y AS (SELECT r, nfc_normalize(string_agg(coalesce(k, x.c), '' ORDER BY i)) AS canonical FROM x LEFT JOIN m ON m.c = x.c GROUP BY r)"
    )


_CANON = nfkc_sql("body", "corpus_docs", ", doc_id, loaded_at")


@query(f"WITH {_CANON} SELECT doc_id, loaded_at, coalesce(canonical, body) AS canonical, coalesce(canonical, body) IS DISTINCT FROM body AS changed FROM o LEFT JOIN y USING (r)")
def canonicalize(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "corpus_docs").select("doc_id", "body", "loaded_at").withColumn("canonical", X.nfkc("body"))
    return rows.select("doc_id", "loaded_at", "canonical", (~F.col("body").eqNullSafe(F.col("canonical"))).alias("changed"))


@query(f"SELECT DISTINCT token, {FOLD.format(c='token')} AS term FROM (SELECT unnest(regexp_extract_all(text,{WORDS})) AS token FROM documents)")
def normalize_tokens(s: SparkSession, d: str) -> DataFrame:
    tokens = docs_(s, d).select(F.explode(X.raw_tokens("text")).alias("token")).distinct()
    return tokens.select("token", X.casefold("token").alias("term"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text,{WORDS})) AS token FROM documents) GROUP BY token")
def tokens_raw(s: SparkSession, d: str) -> DataFrame:
    return docs_(s, d).select(F.explode(X.raw_tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_SX = "regexp_replace(translate(upper(substr(term,2)),'BFPVCGJKQSXZDTLMNR','111122222222334556'),'[^1-6]','','g')"
for _k in "123456":
    _SX = f"regexp_replace({_SX},'{_k}+','{_k}','g')"


@query(f"WITH {POST} SELECT DISTINCT term, upper(substr(term,1,1)) || rpad(substr({_SX},1,3),3,'0') AS code FROM post")
def soundex_codes(s: SparkSession, d: str) -> DataFrame:
    return vocab_(s, d).select("term", phonetic.soundex(F.col("term")).alias("code"))


@query()
def porter_stems(s: SparkSession, d: str) -> DataFrame:
    return vocab_(s, d).select("term", stemming.stemmed(F.col("term")).alias("stem"))


@query(f"SELECT doc_id, len({TOK}) AS n, array_to_string({TOK}, ' ') AS tokens FROM documents")
def tokens_simple(s: SparkSession, d: str) -> DataFrame:
    t = docs_(s, d).select("doc_id", X.terms("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


_PARTS = r"regexp_extract_all(text,'[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')"


@query(f"WITH p AS (SELECT doc_id, unnest({_PARTS}) AS part, generate_subscripts({_PARTS},1) AS i FROM documents), q AS (SELECT doc_id, i, part, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b FROM p) SELECT doc_id, part AS token, CAST(b AS BIGINT) AS begin_at, CAST(b + length(part) AS BIGINT) AS end_at FROM q WHERE regexp_matches(part, '^[\\p{{L}}\\p{{N}}_]')")
def token_spans(s: SparkSession, d: str) -> DataFrame:
    rows = docs_(s, d).select("doc_id", F.explode(X.token_spans("text")).alias("x"))
    return rows.select("doc_id", "x.token", F.col("x.begin").cast("long").alias("begin_at"), F.col("x.end").cast("long").alias("end_at"))


@query("SELECT DISTINCT body AS token FROM headings WHERE length(body) > 0")
def tokens_dummy(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "headings").where("length(body) > 0").select(F.col("body").alias("token")).distinct()


@query("SELECT symbol, count(*) AS n FROM (SELECT unnest(string_split(text,'')) AS symbol FROM documents WHERE length(text) > 0) GROUP BY symbol")
def tokens_unigram(s: SparkSession, d: str) -> DataFrame:
    return docs_(s, d).select(F.explode(X.unigrams("text")).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


@query("SELECT shingle, count(*) AS n FROM (SELECT substr(body, i, 3) AS shingle FROM (SELECT body, unnest(range(1, greatest(1, length(body)-2) + 1)) AS i FROM headings WHERE length(body) > 0)) GROUP BY shingle")
def char_shingles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "headings").select(F.explode(X.char_shingles("body", 3)).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))


@query(f"WITH t AS (SELECT {TOK} AS t FROM documents), g AS (SELECT array_to_string(t[i:i+1],' ') AS bigram FROM (SELECT t, unnest(range(1, greatest(1, len(t)-1) + 1)) AS i FROM t WHERE len(t) > 0)) SELECT bigram, count(*) AS n FROM g GROUP BY bigram")
def word_bigrams(s: SparkSession, d: str) -> DataFrame:
    # a lambda may not hold an Arrow UDF, so the tokens are a column of their own
    tokens = docs_(s, d).select(X.terms("text").alias("t"))
    return tokens.select(F.explode(X.word_shingles(F.col("t"), 2)).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


_SHINGLES = "p0 AS MATERIALIZED (SELECT heading_id, unnest(regexp_extract_all(body,'[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+')) AS part, generate_subscripts(regexp_extract_all(body,'[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+'),1) AS i FROM headings), q0 AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY heading_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b FROM p0), tk AS (SELECT heading_id, part, b, b + length(part) AS e, row_number() OVER (PARTITION BY heading_id ORDER BY i) AS nth, count(*) OVER (PARTITION BY heading_id) AS n FROM q0 WHERE regexp_matches(part, '^[\\p{L}\\p{N}_]'))"


@query(f"WITH {_SHINGLES} SELECT x.heading_id, CASE WHEN y.part IS NULL THEN x.part ELSE x.part || ' ' || y.part END AS shingle, CAST(x.b AS BIGINT) AS begin_at, CAST(coalesce(y.e, x.e) AS BIGINT) AS end_at FROM tk x LEFT JOIN tk y ON y.heading_id = x.heading_id AND y.nth = x.nth + 1 WHERE y.part IS NOT NULL OR x.n = 1")
def word_bigram_spans(s: SparkSession, d: str) -> DataFrame:
    spans = table(s, d, "headings").select("heading_id", X.token_spans("body").alias("t"))
    rows = spans.select("heading_id", F.explode(X.word_shingle_spans(F.col("t"), 2)).alias("x"))
    return rows.select("heading_id", "x.shingle", F.col("x.begin").cast("long").alias("begin_at"), F.col("x.end").cast("long").alias("end_at"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(text,{WORDS}), ' ') AS spaced FROM documents")
def space_normalize(s: SparkSession, d: str) -> DataFrame:
    return docs_(s, d).select("doc_id", F.array_join(X.raw_tokens("text"), " ").alias("spaced"))


@query()
def proper_nouns(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "corpus_docs").select(F.explode(extract.proper_nouns(F.col("body"))).alias("noun"))
    return rows.groupBy("noun").agg(F.count("*").alias("n"))


_VB = "CASE " + " ".join(f"WHEN {{c}} < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END"


@query(f"SELECT o_orderkey, CAST({_VB.format(c='o_orderkey')} AS BIGINT) AS bytes FROM orders")
def vbyte_size(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", codecs.vbyte_size(F.col("o_orderkey")).cast("long").alias("bytes"))


@query("SELECT o_orderkey, o_orderkey AS decoded FROM orders")
def vbyte_roundtrip(s: SparkSession, d: str) -> DataFrame:
    coded = table(s, d, "orders").select("o_orderkey", codecs.vbyte_encode(F.col("o_orderkey")).alias("code"))
    return coded.select("o_orderkey", codecs.vbyte_decode(F.col("code")).alias("decoded"))


@query("SELECT o_orderkey, repeat('1', length(bin(o_orderkey)) - 1) || '0' || substr(bin(o_orderkey), 2) AS code, o_orderkey AS decoded FROM orders WHERE o_orderkey > 0")
def elias_gamma(s: SparkSession, d: str) -> DataFrame:
    coded = table(s, d, "orders").where("o_orderkey > 0").select("o_orderkey", codecs.gamma_encode(F.col("o_orderkey")).alias("code"))
    return coded.withColumn("decoded", codecs.gamma_decode(F.col("code")))


@query(f"WITH {POST}, v AS (SELECT DISTINCT term FROM post), q AS (SELECT unnest([{_lower_terms(*NEAR)}]) AS query) SELECT query, term, damerau_levenshtein(term, query) AS distance FROM v, q WHERE damerau_levenshtein(term, query) <= 1")
def edit_distance(s: SparkSession, d: str) -> DataFrame:
    q = s.createDataFrame([(x,) for x in NEAR], "query string")
    pairs = vocab_(s, d).select("term").join(F.broadcast(q), distance.may_be_within(F.col("term"), F.col("query"), 1))
    return pairs.withColumn("distance", distance.edit_distance(F.col("term"), F.col("query")).cast("long")).where("distance <= 1")


# ---- index


@query(f"WITH {POST} SELECT term, doc_id, tf FROM post")
def index_postings(s: SparkSession, d: str) -> DataFrame:
    return post_(s, d)


_F2 = f"regexp_extract_all({FOLD.format(c='title')},{WORDS})"
_F3 = f"regexp_extract_all({FOLD.format(c='description')},{WORDS})"


@query(f"WITH {FILMS} SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_F2}) AS term FROM f UNION ALL SELECT doc_id, unnest({_F3}) AS term FROM f) GROUP BY term, doc_id")
def index_multi_field(s: SparkSession, d: str) -> DataFrame:
    return index.postings(films_(s, d), ["title", "description"])


@query(f"WITH {POST} SELECT doc_id, tf FROM post WHERE term = 'ranker'")
def postings_lookup(s: SparkSession, d: str) -> DataFrame:
    return index.lookup(post_(s, d), "ranker")


@query(f"WITH {POST} SELECT term, count(*) AS df FROM post GROUP BY term")
def doc_freq(s: SparkSession, d: str) -> DataFrame:
    return vocab_(s, d).select("term", "df")


@query(f"WITH {POST} SELECT term, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def coll_freq(s: SparkSession, d: str) -> DataFrame:
    return vocab_(s, d).select("term", "cf")


@query(f"WITH {POST} SELECT DISTINCT term FROM post")
def vocabulary(s: SparkSession, d: str) -> DataFrame:
    return vocab_(s, d).select("term")


@query(f"WITH p AS (SELECT doc_id, unnest({TOK}) AS term, generate_subscripts({TOK},1) AS i FROM documents), m AS (SELECT term, min({{'d': doc_id, 'i': i}}) AS first_at FROM p GROUP BY term) SELECT term, CAST(row_number() OVER (ORDER BY first_at) - 1 AS BIGINT) AS term_id FROM m")
def term_ids(s: SparkSession, d: str) -> DataFrame:
    return index.term_ids(docs_(s, d), "text").select("term", F.col("term_id").cast("long").alias("term_id"))


@query(f"WITH {POST}, g AS (SELECT term, doc_id - lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM post) SELECT count(*) AS out_of_order FROM g WHERE gap <= 0")
def postings_sorted_check(s: SparkSession, d: str) -> DataFrame:
    return index.out_of_order(post_(s, d), "doc_id").agg(F.count("*").alias("out_of_order"))


_GAPS = f"{POST}, g AS (SELECT term, doc_id, tf, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM post)"


@query(f"WITH {_GAPS} SELECT term, doc_id, tf, gap, CAST({_VB.format(c='gap')} + {_VB.format(c='tf')} AS BIGINT) AS bytes FROM g")
def gap_encoding(s: SparkSession, d: str) -> DataFrame:
    return index.gaps(post_(s, d)).withColumn("bytes", F.col("bytes").cast("long"))


@query(f"WITH {_GAPS} SELECT term, CAST(sum({_VB.format(c='gap')} + {_VB.format(c='tf')}) AS BIGINT) AS bytes FROM g GROUP BY term")
def compressed_size(s: SparkSession, d: str) -> DataFrame:
    return index.gaps(post_(s, d)).groupBy("term").agg(F.sum("bytes").cast("long").alias("bytes"))


# ---- set operations and Boolean search


def _has(*terms: str) -> str:
    return f"(SELECT doc_id FROM post WHERE term IN ({_lower_terms(*terms)}))"


@query(f"WITH {POST} SELECT doc_id FROM {_has('ranker')} INTERSECT SELECT doc_id FROM {_has('trie')}")
def merge_and(s: SparkSession, d: str) -> DataFrame:
    return boolean.merge(post_(s, d), "ranker", "trie", "and")


@query(f"WITH {POST} SELECT doc_id FROM {_has('ranker')} UNION SELECT doc_id FROM {_has('trie')}")
def merge_or(s: SparkSession, d: str) -> DataFrame:
    return boolean.merge(post_(s, d), "ranker", "trie", "or")


@query(f"WITH {POST} SELECT doc_id FROM {_has('ranker')} EXCEPT SELECT doc_id FROM {_has('trie')}")
def merge_andnot(s: SparkSession, d: str) -> DataFrame:
    return boolean.merge(post_(s, d), "ranker", "trie", "andnot")


def _bool(s: SparkSession, d: str, expression: str) -> DataFrame:
    synonyms = s.createDataFrame(SYNONYMS, "term string, synonym string")
    return boolean.search(post_(s, d), expression, synonyms, vocabulary=vocab_(s, d)).select("doc_id")


@query(f"WITH {POST} SELECT doc_id FROM {_has('inverted')} INTERSECT SELECT doc_id FROM {_has('index')} INTERSECT SELECT doc_id FROM {_has('query')}")
def bool_and(s: SparkSession, d: str) -> DataFrame:
    return _bool(s, d, "AND('inverted index', query)")


@query(f"WITH {POST} SELECT doc_id FROM {_has('ranker')} INTERSECT (SELECT doc_id FROM {_has('trie', 'centroid')} UNION (SELECT doc_id FROM {_has('bloom')} EXCEPT SELECT doc_id FROM {_has('skip', 'pointer')}))")
def bool_nested(s: SparkSession, d: str) -> DataFrame:
    return _bool(s, d, "AND(ranker, OR(trie, centroid, ANDNOT(bloom, 'skip pointer')))")


@query(f"WITH {POST} (SELECT doc_id FROM {_has('bloom')} INTERSECT SELECT doc_id FROM {_has('filter')}) EXCEPT SELECT doc_id FROM {_has('index', 'query')}")
def bool_andnot(s: SparkSession, d: str) -> DataFrame:
    return _bool(s, d, "ANDNOT('bloom filter', 'index query')")


@query(f"WITH {POST} SELECT DISTINCT doc_id FROM post WHERE term LIKE 'in%ex' INTERSECT SELECT doc_id FROM {_has('trie')}")
def bool_wildcard(s: SparkSession, d: str) -> DataFrame:
    return _bool(s, d, "AND(WILDCARD('in*ex'), trie)")


@query(f"WITH {POST} SELECT doc_id FROM {_has('search', 'query')} INTERSECT SELECT doc_id FROM {_has('trie')}")
def bool_synonym(s: SparkSession, d: str) -> DataFrame:
    return _bool(s, d, "AND(SYNONYM(lookup), SYNONYM(trie))")


@query(f"WITH {POST}, v AS (SELECT term FROM (SELECT DISTINCT term FROM post) WHERE damerau_levenshtein(term,'ranker') <= 1 ORDER BY damerau_levenshtein(term,'ranker'), term LIMIT 10) SELECT DISTINCT doc_id FROM post WHERE term IN (SELECT term FROM v)")
def bool_lookslike(s: SparkSession, d: str) -> DataFrame:
    return _bool(s, d, "LOOKSLIKE(ranker)")


@query(f"WITH {POST}, c AS (SELECT term, doc_id, upper(substr(term,1,1)) || rpad(substr({_SX},1,3),3,'0') AS code FROM post) SELECT DISTINCT doc_id FROM c WHERE code = (SELECT any_value(code) FROM c WHERE term = 'vocabulary')")
def bool_soundslike(s: SparkSession, d: str) -> DataFrame:
    return _bool(s, d, "SOUNDSLIKE(vocabulary)")


# ---- ranked search


def _ranked_sql(score: str, post: str = POST, n: str = NDOCS, terms: tuple[str, ...] = ("inverted", "index", "query"), least: int = 1, extra: str = "", plus: str = "") -> str:
    return f"WITH {post}, d AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term), r AS (SELECT doc_id, sum({score}) AS score FROM post JOIN d USING (term) WHERE term IN ({_lower_terms(*terms)}) GROUP BY doc_id HAVING count(*) >= {least}) SELECT r.doc_id, round(score{plus}, 6) AS score FROM r{extra} ORDER BY 2 DESC, 1 LIMIT 10"


@query(_ranked_sql("tf::DOUBLE"))
def search_tf(s: SparkSession, d: str) -> DataFrame:
    return ranked.search(post_(s, d), RANKED_QUERY, ranker=ranked.by_frequency)


_TFIDF = f"(1 + log10(tf::DOUBLE)) * log10({NDOCS} / df)"


@query(_ranked_sql(_TFIDF))
def search_tfidf(s: SparkSession, d: str) -> DataFrame:
    return ranked.search(post_(s, d), RANKED_QUERY, docs_(s, d).count(), ranked.by_tfidf)


@query(_ranked_sql(_TFIDF, least=3, extra=" LEFT JOIN documents q ON q.doc_id = r.doc_id", plus=" + coalesce(q.course_week::DOUBLE, 0) / 100"))
def search_tfidf_static(s: SparkSession, d: str) -> DataFrame:
    static = docs_(s, d).select("doc_id", (F.col("course_week").cast("double") / 100).alias("quality"))
    return ranked.search(post_(s, d), RANKED_QUERY, docs_(s, d).count(), ranked.by_tfidf, threshold=1.0, static=static)


_H3 = "post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT heading_id AS doc_id, substr(b, unnest(range(1, greatest(1, length(b)-2) + 1)), 3) AS term FROM (SELECT heading_id, replace(lower(body),'ß','ss') AS b FROM headings)) GROUP BY term, doc_id)"
_TRI = [("clasificaton theery"[i : i + 3]) for i in range(len("clasificaton theery") - 2)]


@query(_ranked_sql("tf::DOUBLE", post=_H3, terms=tuple(dict.fromkeys(_TRI)), least=int(0.5 * len(set(_TRI)))))
def search_shingles(s: SparkSession, d: str) -> DataFrame:
    folded = table(s, d, "headings").select("heading_id", X.casefold("body").alias("body"))
    post = index.postings(folded, ["body"], lambda c: X.char_shingles(c, 3), "heading_id")
    return ranked.search(post, "clasificaton theery", ranker=ranked.by_frequency, analyze=lambda q: [q[i : i + 3] for i in range(max(1, len(q) - 2))])


_SXPOST = f"base AS (SELECT doc_id, unnest({TOK}) AS term FROM documents), post AS (SELECT code AS term, doc_id, count(*) AS tf FROM (SELECT doc_id, upper(substr(term,1,1)) || rpad(substr({_SX},1,3),3,'0') AS code FROM base) GROUP BY code, doc_id)"


@query(_ranked_sql("tf::DOUBLE", post=_SXPOST, terms=("I532", "Q600"), least=1))
def search_soundex(s: SparkSession, d: str) -> DataFrame:
    # codes are made once for each distinct word and joined back
    codes = vocab_(s, d).select("term", phonetic.soundex(F.col("term")).alias("code"))
    post = post_(s, d).join(codes, "term").groupBy(F.col("code").alias("term"), "doc_id").agg(F.sum("tf").alias("tf"))
    return ranked.search(post, ["I532", "Q600"], ranker=ranked.by_frequency)


@query()
def search_porter(s: SparkSession, d: str) -> DataFrame:
    stems = vocab_(s, d).select("term", stemming.stemmed(F.col("term")).alias("stem"))
    post = post_(s, d).join(stems, "term").groupBy(F.col("stem").alias("term"), "doc_id").agg(F.sum("tf").alias("tf"))
    return ranked.search(post, "indexing queries ranked", ranker=ranked.by_frequency, analyze=lambda q: [stemming.stem(w) for w in X.py_terms(q)])


# ---- strings


@query(f"WITH t AS (SELECT doc_id, {TOK} AS t FROM documents), c AS (SELECT doc_id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'inverted' AND starts_with(t[i+1], 'ind'))) AS score FROM t) SELECT doc_id, score FROM c WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def phrase_prefix(s: SparkSession, d: str) -> DataFrame:
    return strings.phrase_places(places_(s, d), PHRASE)


@query(f"WITH t AS (SELECT doc_id, {TOK} AS t FROM documents), c AS (SELECT doc_id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'inverted' AND starts_with(t[i+1], 'ind'))) AS score FROM t) SELECT doc_id, score FROM c WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def phrase_prefix_scan(s: SparkSession, d: str) -> DataFrame:
    return strings.phrase_prefix(docs_(s, d), ["text"], PHRASE)


@query(f"WITH {FILMS}, t AS (SELECT doc_id, {_F2} AS a, {_F3} AS b FROM f), c AS (SELECT doc_id, coalesce(len(list_filter(range(1, len(a)), lambda i: a[i] = 'the' AND starts_with(a[i+1], 's'))),0) + coalesce(len(list_filter(range(1, len(b)), lambda i: b[i] = 'the' AND starts_with(b[i+1], 's'))),0) AS score FROM t) SELECT doc_id, score FROM c WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def phrase_prefix_fields(s: SparkSession, d: str) -> DataFrame:
    return strings.phrase_prefix(films_(s, d), ["title", "description"], "The s")


_PIECES = r"p0 AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all({text},'[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS part, generate_subscripts(regexp_extract_all({text},'[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'),1) AS i FROM {table})"
_TK = (
    _PIECES.replace("{text}", "text").replace("{table}", "documents") + ", q0 AS (SELECT doc_id, i, part, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b FROM p0), "
    "tk AS MATERIALIZED (SELECT doc_id, part AS tok, replace(lower(part),'ß','ss') AS term, CAST(b AS BIGINT) AS b, CAST(b + length(part) AS BIGINT) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS nth FROM q0 WHERE regexp_matches(part, '^[\\p{L}\\p{N}_]'))"
)
# each word of an entry votes for the place where the entry would begin; an entry is found where all its words agree
_SCAN = f"{_TK}, k AS (SELECT m, unnest(string_split(m,' ')) AS word, generate_subscripts(string_split(m,' '),1) - 1 AS j, len(string_split(m,' ')) AS size FROM (SELECT unnest([{_lower_terms(*PHRASES)}]) AS m)), h AS (SELECT doc_id, m AS match, nth - j AS begin_nth, string_agg(tok, ' ' ORDER BY nth) AS surface, min(b) AS begin_at, max(e) AS end_at FROM tk JOIN k ON term = word GROUP BY doc_id, m, nth - j, size HAVING count(*) = size)"


@query(f"WITH {_SCAN} SELECT match, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM h GROUP BY match")
def dict_scan(s: SparkSession, d: str) -> DataFrame:
    keys = s.createDataFrame([(x,) for x in PHRASES], "key string")
    return strings.dictionary_scan(spread(docs_(s, d)), "text", keys).groupBy("match").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs"))


@query(f"WITH {_SCAN} SELECT doc_id, match, surface, begin_at, end_at FROM h")
def dict_scan_spans(s: SparkSession, d: str) -> DataFrame:
    keys = s.createDataFrame([(x,) for x in PHRASES], "key string")
    rows = strings.dictionary_scan(spread(docs_(s, d)), "text", keys)
    return rows.select("doc_id", "match", "surface", F.col("begin").cast("long").alias("begin_at"), F.col("end").cast("long").alias("end_at"))


_TITLES = (
    f"{nfkc_sql('title', '(SELECT body AS title FROM headings UNION SELECT title FROM films UNION SELECT title FROM corpus_docs)', '')}, "
    "k AS (SELECT DISTINCT array_to_string(regexp_extract_all(replace(lower(body),'ß','ss'),'[\\p{L}\\p{N}_]+'),' ') AS match, meta FROM headings), "
    "t AS (SELECT title, ' ' || array_to_string(regexp_extract_all(replace(lower(coalesce(canonical, title)),'ß','ss'),'[\\p{L}\\p{N}_]+'),' ') || ' ' AS line FROM o LEFT JOIN y USING (r))"
)


@query(f"WITH {_TITLES} SELECT DISTINCT title, match, meta FROM t JOIN k ON contains(line, ' ' || match || ' ') WHERE match <> ''")
def dict_scan_meta(s: SparkSession, d: str) -> DataFrame:
    """Subject headings, with their tree numbers, in titles and in each other, by the join that serves dictionaries of any size."""
    heads = table(s, d, "headings")
    titles = heads.select(F.col("body").alias("title")).union(table(s, d, "films").select("title")).union(table(s, d, "corpus_docs").select("title")).distinct()
    rows = strings.dictionary_scan(titles, "title", heads, "body", "meta", "title", as_join=True)
    return rows.select(F.col("doc_id").alias("title"), "match", "meta").distinct()


@query(f"WITH {POST} SELECT DISTINCT term FROM post WHERE starts_with(term,'in') AND ends_with(term,'ed') AND length(term) >= 4")
def wildcard_prefix(s: SparkSession, d: str) -> DataFrame:
    return vocab_(s, d).where(strings.wildcard(F.col("term"), "in*ed")).select("term")


@query(f"WITH {POST} SELECT DISTINCT term FROM post WHERE contains(term,'ord')")
def wildcard_infix(s: SparkSession, d: str) -> DataFrame:
    return vocab_(s, d).where(strings.wildcard(F.col("term"), "*ord*")).select("term")


@query(f"WITH {POST} SELECT DISTINCT term FROM post WHERE starts_with(term,'re') AND ends_with(term,'ed') AND contains(term,'e') AND length(term) >= 4")
def wildcard_two_star(s: SparkSession, d: str) -> DataFrame:
    return vocab_(s, d).where(strings.wildcard(F.col("term"), "re*e*ed")).select("term")


@query(f"WITH {POST}, v AS (SELECT DISTINCT term FROM post) SELECT term AS key, damerau_levenshtein(term,'index') AS distance, round(-damerau_levenshtein(term,'index')::DOUBLE, 6) AS score FROM v WHERE damerau_levenshtein(term,'index') <= 1 ORDER BY 3 DESC, 1 LIMIT 10")
def fuzzy_lookup(s: SparkSession, d: str) -> DataFrame:
    return strings.fuzzy(vocab_(s, d), "index", key="term").withColumn("distance", F.col("distance").cast("long"))


@query(f"WITH {POST}, v AS (SELECT DISTINCT term, damerau_levenshtein(term,'termes') AS d FROM post WHERE starts_with(term,'te')) SELECT term AS key, d AS distance, round(1 - d::DOUBLE / greatest(length(term), 6), 6) AS score FROM v WHERE d <= 1 ORDER BY 3 DESC, 1 LIMIT 10")
def fuzzy_first_n(s: SparkSession, d: str) -> DataFrame:
    return strings.fuzzy(vocab_(s, d), "termes", first_n=2, scoring="normalized", key="term").withColumn("distance", F.col("distance").cast("long"))


_WIN = f"{_TK}, w AS (SELECT x.doc_id, abs(x.nth - y.nth) + 1 AS width, least(x.nth, y.nth) AS first_at, greatest(x.nth, y.nth) AS last_at, least(x.b, y.b) AS begin_at, greatest(x.e, y.e) AS end_at FROM tk x JOIN tk y ON x.doc_id = y.doc_id AND x.term = 'index' AND y.term = 'query'), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY width, first_at) AS rn FROM w)"


@query(f"WITH {_WIN} SELECT doc_id, width, first_at, last_at, begin_at, end_at FROM r WHERE rn = 1")
def min_window(s: SparkSession, d: str) -> DataFrame:
    rows = spread(docs_(s, d)).select("doc_id", strings.min_window(F.col("text"), WINDOW_QUERY).alias("w")).where("w.width is not null")
    return rows.select("doc_id", *(F.col(f"w.{a}").cast("long").alias(b) for a, b in (("width", "width"), ("first", "first_at"), ("last", "last_at"), ("begin", "begin_at"), ("end", "end_at"))))


@query(f"WITH {_WIN} SELECT r.doc_id, substr(text, greatest(begin_at - 20, 0) + 1, end_at + 20 - greatest(begin_at - 20, 0)) AS snippet FROM r JOIN documents ON documents.doc_id = r.doc_id WHERE rn = 1 AND width <= 75")
def snippet(s: SparkSession, d: str) -> DataFrame:
    return spread(docs_(s, d)).select("doc_id", strings.snippet(F.col("text"), WINDOW_QUERY).alias("snippet")).where("snippet is not null")


@query("SELECT airport_id, airport_name FROM (SELECT DISTINCT airport_id, trim(airport_name) AS airport_name FROM airports) WHERE starts_with(airport_name, 'S')")
def trie_prefix(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "airports").select("airport_id", F.trim("airport_name").alias("airport_name")).distinct()
    return strings.prefixed(rows, "S", "airport_name")


@query(f"WITH {POST}, v AS (SELECT DISTINCT term FROM post WHERE starts_with(term,'in') AND length(term) > 2) SELECT substr(term,3,1) AS symbol, bool_or(length(term) = 3) AS final FROM v GROUP BY 1")
def trie_transitions(s: SparkSession, d: str) -> DataFrame:
    return strings.transitions(vocab_(s, d), "in", "term")


@query("SELECT airport_id, count(DISTINCT airport_type) AS metas FROM airports GROUP BY airport_id HAVING count(DISTINCT airport_type) > 1")
def trie_conflicts(s: SparkSession, d: str) -> DataFrame:
    return strings.conflicts(table(s, d, "airports"), "airport_id", "airport_type")


def _slots_sql(item: str) -> str:
    """The slots of an item: two digests as little-endian numbers modulo the bits, by Horner's rule."""
    number = lambda digest: f"list_reduce(list_prepend(0::BIGINT, list_transform(list_reverse(regexp_extract_all({digest}({item}),'..')), lambda h: ('0x' || h)::BIGINT)), lambda a, b: (a * 256 + b) % bits)"
    return f"list_distinct(list_transform(range(k), lambda i: ({number('sha1')} + i * {number('md5')}) % bits))"


_BLOOM = f"i AS (SELECT DISTINCT CAST(dst_id AS VARCHAR) AS item FROM doc_links WHERE dst_id IS NOT NULL), n AS (SELECT greatest(1, count(*)) AS n FROM i), b AS (SELECT n, greatest(1, CAST(floor(-n * ln(0.01::DOUBLE) / (ln(2::DOUBLE) * ln(2::DOUBLE))) AS BIGINT)) AS bits FROM n), p AS (SELECT bits, greatest(1, CAST(round_even(bits::DOUBLE / n * ln(2::DOUBLE), 0) AS BIGINT)) AS k FROM b), f AS (SELECT DISTINCT unnest({_slots_sql('item')}) AS slot FROM i, p), d AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS item FROM corpus_docs), s AS (SELECT item, unnest({_slots_sql('item')}) AS slot FROM d, p)"


@query(f"WITH {_BLOOM} SELECT item, bool_and(f.slot IS NOT NULL) AS member FROM s LEFT JOIN f USING (slot) GROUP BY item")
def bloom_membership(s: SparkSession, d: str) -> DataFrame:
    links = table(s, d, "doc_links").select(F.col("dst_id").cast("string").alias("item")).dropna().distinct()
    known = table(s, d, "corpus_docs").select(F.col("doc_id").cast("string").alias("item")).distinct()
    f = bloom.BloomFilter(max(1, links.count()), 0.01).add(links, "item")
    return f.members(known, "item")


# ---- top-k and vectors


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(s: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10, "o_orderkey")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return vectors.top_k(rows, "o_totalprice", 3, "o_orderkey", "o_orderpriority").withColumn("rank", F.col("rank").cast("long"))


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"WITH e AS (SELECT vec_id, {_UNIT} AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 100 = 0), r AS (SELECT query_id, vec_id, round(list_cosine_similarity(v, qv), 6) AS score FROM e, q), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r) SELECT query_id, vec_id, score, rank FROM k WHERE rank <= 5")
def ann_cosine_topk(s: SparkSession, d: str) -> DataFrame:
    """Exact nearest vectors of every hundredth vector, in blocks of queries against all rows."""
    e = table(s, d, "embeddings")
    near = vectors.nearest_to(e.where("vec_id % 100 = 0"), e, 5)
    return near.select("query_id", F.col("near_id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


_WV = f"r AS (SELECT doc_id, body FROM (SELECT doc_id, body, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC, body DESC) AS rn FROM corpus_docs) WHERE rn = 1), t AS (SELECT doc_id, unnest(regexp_extract_all({FOLD.format(c='body')},{WORDS})) AS term FROM r), u AS (SELECT DISTINCT doc_id, embedding FROM body_vectors WHERE len(embedding) = 96 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0), uu AS (SELECT doc_id, min(embedding) AS v FROM u GROUP BY doc_id), un AS (SELECT doc_id, list_transform(v, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(v, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM uu)"
DENSE_QUERY = ["orchestra", "concert", "violin"]
_WVQ = f"wx AS (SELECT term, i, avg(v[i]) AS x FROM (SELECT DISTINCT term, doc_id FROM t WHERE term IN ({_lower_terms(*DENSE_QUERY)})) JOIN un USING (doc_id), range(1, 97) g(i) GROUP BY term, i), qv AS (SELECT i, avg(x) AS x FROM wx GROUP BY i), ql AS (SELECT sqrt(sum(x * x)) AS len FROM qv)"


@query(f"WITH {_WV}, {_WVQ} SELECT doc_id, round(sum(v[i] * x) / any_value(len), 6) AS score FROM un, qv, ql GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT 5")
def dense_text_topk(s: SparkSession, d: str) -> DataFrame:
    """Dense search by text: the mean vector of the query's words, a word's vector being the mean of the bodies' that hold it."""
    bodies = loaders.merge(table(s, d, "corpus_docs").select("doc_id", "loaded_at", "body"), order=[F.col("loaded_at").desc(), F.col("body").desc()])
    held = bodies.select("doc_id", F.explode(F.array_distinct(X.terms("body"))).alias("term")).where(F.col("term").isin(DENSE_QUERY))
    usable = table(s, d, "body_vectors").where("size(embedding) = 96").select("doc_id", "embedding", vectors.unit(F.col("embedding")).alias("v")).where("v is not null")
    unit = usable.groupBy("doc_id").agg(F.min(F.struct("embedding", "v"))["v"].alias("embedding"))
    words = vectors.embedded(held.select(F.col("term").alias("word"), F.col("doc_id").alias("term")), unit.withColumnRenamed("doc_id", "term"), "word").withColumnRenamed("word", "term")
    query = vectors.embedded(s.createDataFrame([(0, w) for w in DENSE_QUERY], "doc_id long, term string"), words)
    near = vectors.nearest_to(query, unit, 5, "doc_id")
    return near.select(F.col("near_id").alias("doc_id"), "score")


_VEC = f"{POST}, {STATS}, v AS (SELECT doc_id, term, (1 + log10(tf::DOUBLE)) * log10({NDOCS} / df) AS weight FROM post JOIN stats USING (term) WHERE df < {NDOCS})"
_UVEC = f"{_VEC}, l AS (SELECT doc_id, sqrt(sum(weight * weight)) AS len FROM v GROUP BY doc_id), u AS (SELECT doc_id, term, weight / len AS weight FROM v JOIN l USING (doc_id))"


def vec_(s: SparkSession, d: str) -> DataFrame:
    return kept(s, d, "vectors", lambda: vectors.tfidf(post_(s, d), docs_(s, d).count()))


@query(f"WITH {_VEC} SELECT doc_id, term, round(weight, 6) AS weight FROM v")
def tfidf_vectors(s: SparkSession, d: str) -> DataFrame:
    return vec_(s, d).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_UVEC}, c AS (SELECT a.doc_id AS query_id, b.doc_id, round(sum(a.weight * b.weight), 6) AS cosine FROM u a JOIN u b USING (term) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank FROM c) SELECT query_id, doc_id, cosine, rank FROM k WHERE rank <= 5")
def cosine_pairs(s: SparkSession, d: str) -> DataFrame:
    packed = bags.bags(docs_(s, d), "text")
    if packed:
        return bags.nearest(packed, 5).select("query_id", F.col("near_id").alias("doc_id"), F.col("score").alias("cosine"), F.col("rank").cast("long").alias("rank"))
    v = vec_(s, d)
    c = vectors.cosines(v.withColumnRenamed("doc_id", "query_id"), v, "query_id", "doc_id").where("query_id <> doc_id").withColumn("cosine", F.round("cosine", 6))
    return vectors.top_k(c, "cosine", 5, "doc_id", "query_id").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_UVEC} SELECT doc_id, term, round(weight, 6) AS weight FROM u")
def vector_normalize(s: SparkSession, d: str) -> DataFrame:
    return vectors.normalized(vec_(s, d)).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_VEC}, k AS (SELECT doc_id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS rank FROM v) SELECT doc_id, term, weight, rank FROM k WHERE rank <= 5")
def vector_top_terms(s: SparkSession, d: str) -> DataFrame:
    return vectors.top_terms(vec_(s, d), 5).select("doc_id", "term", F.round("weight", 6).alias("weight"), F.col("rank").cast("long").alias("rank"))


_LAB = "lab AS (SELECT doc_id, lower(lang) AS label FROM documents WHERE lang IS NOT NULL)"
_CEN = f"{_UVEC}, {_LAB}, n AS (SELECT label, count(DISTINCT doc_id) AS n FROM lab GROUP BY label), c AS (SELECT label, term, sum(weight) / any_value(n) AS weight FROM u JOIN lab USING (doc_id) JOIN n USING (label) GROUP BY label, term)"


def labels_(s: SparkSession, d: str) -> DataFrame:
    return docs_(s, d).where("lang is not null").select("doc_id", F.lower("lang").alias("label"))


@query(f"WITH {_CEN} SELECT label, term, round(weight, 6) AS weight FROM c")
def centroids(s: SparkSession, d: str) -> DataFrame:
    return vectors.centroids(vectors.normalized(vec_(s, d)), labels_(s, d)).select("label", "term", F.round("weight", 6).alias("weight"))


# ---- classifiers


_NB = f"{POST}, {_LAB}, sizes AS (SELECT label, count(*) AS n FROM lab GROUP BY label), pri AS (SELECT label, ln(n::DOUBLE / (SELECT sum(n) FROM sizes)) AS prior FROM sizes), cnt AS (SELECT label, term, sum(tf)::DOUBLE AS n FROM post JOIN lab USING (doc_id) GROUP BY label, term), voc AS (SELECT DISTINCT term FROM cnt), den AS (SELECT label, sum(n) + (SELECT count(*) FROM voc) AS den FROM cnt GROUP BY label)"


def nb_(s: SparkSession, d: str) -> classify.NaiveBayes:
    return kept_model(s, d, "bayes", lambda: classify.NaiveBayes.train(post_(s, d), labels_(s, d)).stored())


@query(f"WITH {_NB} SELECT label, round(prior, 6) AS prior FROM pri")
def nb_priors(s: SparkSession, d: str) -> DataFrame:
    return nb_(s, d).priors.select("label", F.round("prior", 6).alias("prior"))


@query(f"WITH {_NB} SELECT label, term, round(ln((n + 1) / den), 6) AS posterior FROM cnt JOIN den USING (label)")
def nb_posteriors(s: SparkSession, d: str) -> DataFrame:
    return nb_(s, d).posteriors.select("label", "term", F.round("posterior", 6).alias("posterior"))


@query(f"WITH {_NB}, sc AS (SELECT p.doc_id, x.label, any_value(x.prior) + sum(p.tf * ln((coalesce(c.n,0) + 1) / q.den)) AS score FROM post p JOIN voc USING (term) CROSS JOIN pri x JOIN den q ON q.label = x.label LEFT JOIN cnt c ON c.label = x.label AND c.term = p.term GROUP BY 1, 2) SELECT doc_id, label, round(score, 4) AS score FROM sc")
def nb_classify(s: SparkSession, d: str) -> DataFrame:
    return nb_(s, d).classify(post_(s, d)).select("doc_id", "label", F.round("score", 4).alias("score"))


@query(f"WITH {_CEN}, cl AS (SELECT label, sqrt(sum(weight*weight)) AS len FROM c GROUP BY label), sc AS (SELECT u.doc_id, c.label, sum(u.weight * c.weight) / any_value(len) AS score FROM u JOIN c USING (term) JOIN cl ON cl.label = c.label GROUP BY 1, 2) SELECT doc_id, label, round(score, 6) AS score FROM sc WHERE score > 0")
def rocchio_classify(s: SparkSession, d: str) -> DataFrame:
    unit = vectors.normalized(vec_(s, d))
    return classify.rocchio(unit, labels_(s, d), unit).select("doc_id", "label", F.round("score", 6).alias("score"))


def _knn_sql(vote: str) -> str:
    return f"WITH e AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 100 = 0), r AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(v, qv), 6) AS score FROM e, q WHERE vec_id <> query_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r), t AS (SELECT query_id, label, {vote} AS votes FROM k WHERE rank <= 5 GROUP BY 1, 2) SELECT query_id, label, round(votes / sum(votes) OVER (PARTITION BY query_id), 6) AS score FROM t"


def _knn(s: SparkSession, d: str, weighted: bool) -> DataFrame:
    e = table(s, d, "embeddings")
    near = vectors.nearest_to(e.where("vec_id % 100 = 0"), e, 5, others=True).drop("rank")
    labels = table(s, d, "embeddings").select(F.col("vec_id").alias("near_id"), "label")
    return classify.neighbours_vote(near, labels, 5, weighted).withColumn("score", F.round("score", 6))


@query(_knn_sql("count(*)::DOUBLE"))
def knn_simple(s: SparkSession, d: str) -> DataFrame:
    return _knn(s, d, False)


@query(_knn_sql("sum(score)"))
def knn_weighted(s: SparkSession, d: str) -> DataFrame:
    return _knn(s, d, True)


_EPOCHS = 3


def _logreg_sql() -> str:
    ctes = [f"{_UVEC}, x AS MATERIALIZED (SELECT u.doc_id, term, weight AS x, (lower(lang) = 'en')::INT AS y FROM u JOIN documents d ON d.doc_id = u.doc_id WHERE lang IS NOT NULL), r AS MATERIALIZED (SELECT * FROM x UNION ALL SELECT DISTINCT doc_id, '' AS term, 1.0::DOUBLE AS x, y FROM x), n AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM r), t0 AS (SELECT DISTINCT term, 0.0::DOUBLE AS w FROM r)"]
    for i in range(_EPOCHS):
        ctes.append(f"e{i} AS MATERIALIZED (SELECT doc_id, 1/(1+exp(-sum(x*w))) - any_value(y) AS e FROM r JOIN t{i} USING (term) GROUP BY doc_id), t{i + 1} AS MATERIALIZED (SELECT r.term, any_value(w) - 0.5 * sum(x*e) / (SELECT n FROM n) AS w FROM r JOIN e{i} USING (doc_id) JOIN t{i} USING (term) GROUP BY r.term)")
    return f"WITH {', '.join(ctes)} SELECT term, round(w, 6) AS weight FROM t{_EPOCHS}"


def _logreg_rows(s: SparkSession, d: str) -> DataFrame:
    return vectors.normalized(vec_(s, d)).join(labels_(s, d), "doc_id").select("doc_id", "term", F.col("weight").alias("x"), (F.col("label") == "en").cast("int").alias("y"))


@query(_logreg_sql())
def logreg_gd(s: SparkSession, d: str) -> DataFrame:
    return classify.logistic_regression(_logreg_rows(s, d), epochs=_EPOCHS).select("term", F.round("weight", 6).alias("weight"))


@query()
def logreg_trained(s: SparkSession, d: str) -> DataFrame:
    """The weights after the 100 epochs of the method; logreg_gd checks its step against SQL."""
    packed = bags.bags(docs_(s, d), "text", (F.lower("lang") == "en").cast("int"))
    theta = bags.logistic(packed) if packed else classify.logistic_regression(_logreg_rows(s, d))
    return theta.select("term", F.round("weight", 6).alias("weight"))


# ---- graph


_ALPHA = 0.15


def _pagerank_sql(n: int) -> str:
    ctes = ["nodes AS MATERIALIZED (SELECT src_id AS node FROM doc_links WHERE src_id IS NOT NULL UNION SELECT dst_id FROM doc_links WHERE dst_id IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), e AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM (SELECT DISTINCT src_id AS src, dst_id AS dst FROM doc_links WHERE src_id IS NOT NULL AND dst_id IS NOT NULL)), x0 AS (SELECT node, 1/(SELECT n FROM n) AS rank FROM nodes)"]
    for i in range(n):
        ctes.append(f"s{i} AS MATERIALIZED (SELECT dst AS node, sum(rank/deg) AS share FROM e JOIN x{i} ON node = src GROUP BY dst), z{i} AS MATERIALIZED (SELECT coalesce(sum(rank) FILTER (WHERE node NOT IN (SELECT src FROM e)),0) AS loose, coalesce(sum(rank) FILTER (WHERE node IN (SELECT src FROM e)),0) AS bound FROM x{i}), x{i + 1} AS MATERIALIZED (SELECT nodes.node, {_ALPHA}/(SELECT n FROM n)*(SELECT bound FROM z{i}) + (1-{_ALPHA})*coalesce(share,0) + (SELECT loose FROM z{i})/(SELECT n FROM n) AS rank FROM nodes LEFT JOIN s{i} ON s{i}.node = nodes.node)")
    return f"WITH {', '.join(ctes)} SELECT node, round(rank, 9) AS rank FROM x{n}"


def _pagerank(s: SparkSession, d: str, n: int) -> DataFrame:
    e = table(s, d, "doc_links").select("src_id", "dst_id")
    nodes = e.select(F.col("src_id").alias("node")).union(e.select("dst_id"))
    return graph.pagerank(e, nodes, _ALPHA, n, "src_id", "dst_id").select("node", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql(20))
def pagerank(s: SparkSession, d: str) -> DataFrame:
    return _pagerank(s, d, 20)


@query(_pagerank_sql(1))
def pagerank_step(s: SparkSession, d: str) -> DataFrame:
    return _pagerank(s, d, 1)


@query("WITH RECURSIVE e AS (SELECT src_id AS u, dst_id AS v FROM doc_links WHERE src_id IS NOT NULL AND dst_id IS NOT NULL AND src_id <> dst_id UNION SELECT dst_id, src_id FROM doc_links WHERE src_id IS NOT NULL AND dst_id IS NOT NULL AND src_id <> dst_id), c AS (SELECT u AS node, u AS low FROM e UNION SELECT e.v AS node, c.low FROM c JOIN e ON e.u = c.node WHERE c.low < e.v) SELECT node, min(low) AS component FROM c GROUP BY node")
def link_components(s: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(table(s, d, "doc_links"), "src_id", "dst_id")


# ---- metrics


_J = "b AS (SELECT query_id, hit_rank, doc_id, bool_or(coalesce(relevant,false)) AS relevant, max(coalesce(gain,0)) AS gain FROM judgments WHERE query_id IS NOT NULL AND hit_rank IS NOT NULL GROUP BY 1,2,3), j AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, doc_id) AS rank, doc_id, relevant, gain FROM b)"
_P = f"{_J}, p AS (SELECT query_id, rank, relevant, gain, sum(relevant::INT) OVER (PARTITION BY query_id ORDER BY rank) / rank::DOUBLE AS precision, sum(relevant::INT) OVER (PARTITION BY query_id ORDER BY rank)::DOUBLE AS hits, sum(relevant::INT) OVER (PARTITION BY query_id)::DOUBLE AS total FROM j)"


def judged_(s: SparkSession, d: str) -> DataFrame:
    return metrics.judged(table(s, d, "judgments"))


def _at_rank(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), F.round(name, 6).alias(name))


@query(f"WITH {_P} SELECT query_id, rank, round(precision, 6) AS precision FROM p")
def precision_at_k(s: SparkSession, d: str) -> DataFrame:
    return _at_rank(metrics.precision(judged_(s, d)), "precision")


@query(f"WITH {_P} SELECT query_id, rank, round(max(precision) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS interpolated FROM p")
def interp_precision(s: SparkSession, d: str) -> DataFrame:
    return _at_rank(metrics.interpolated(judged_(s, d)), "interpolated")


@query(f"WITH {_P} SELECT query_id, rank, round(hits / nullif(total, 0), 6) AS recall FROM p")
def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    return _at_rank(metrics.recall(judged_(s, d)), "recall")


@query(f"WITH {_P} SELECT query_id, rank, round(2 * precision * (hits / nullif(total,0)) / nullif(precision + hits / nullif(total,0), 0), 6) AS f FROM p")
def f_at_k(s: SparkSession, d: str) -> DataFrame:
    return _at_rank(metrics.f_score(judged_(s, d)), "f")


@query(f"WITH {_P}, a AS (SELECT query_id, coalesce(avg(precision) FILTER (WHERE relevant), 0) AS ap FROM p GROUP BY query_id) SELECT count(*) AS queries, round(avg(ap), 6) AS map FROM a")
def map_score(s: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(judged_(s, d)).agg(F.count("*").alias("queries"), F.round(F.avg("ap"), 6).alias("map"))


@query(f"WITH {_J}, a AS (SELECT query_id, sum(gain / log2(rank + 1.0::DOUBLE)) AS dcg FROM j GROUP BY 1), i AS (SELECT query_id, sum(gain / log2(r + 1.0::DOUBLE)) AS ideal FROM (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS r FROM j) GROUP BY 1) SELECT query_id, round(dcg, 6) AS dcg, round(dcg / nullif(ideal, 0), 6) AS ndcg FROM a JOIN i USING (query_id)")
def ndcg(s: SparkSession, d: str) -> DataFrame:
    return metrics.ndcg(judged_(s, d)).select("query_id", F.round("dcg", 6).alias("dcg"), F.round("ndcg", 6).alias("ndcg"))


@query(f"WITH {_J}, a AS (SELECT query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE relevant), 0) AS rr FROM j GROUP BY query_id) SELECT count(*) AS queries, round(avg(rr), 6) AS mrr FROM a")
def mrr(s: SparkSession, d: str) -> DataFrame:
    return metrics.reciprocal_rank(judged_(s, d)).agg(F.count("*").alias("queries"), F.round(F.avg("rr"), 6).alias("mrr"))


@query(f"WITH {_J}, rk AS (SELECT query_id, doc_id, min(rank) AS rank FROM j GROUP BY 1,2), g AS (SELECT query_id, doc_id, max(coalesce(gain,0)) AS gain FROM judgments WHERE query_id IS NOT NULL GROUP BY 1,2), pf AS (SELECT query_id, doc_id AS before, lead(doc_id) OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS after FROM g), v AS (SELECT pf.query_id, CASE WHEN a.rank IS NULL AND b.rank IS NULL THEN 0 WHEN a.rank IS NULL THEN -1 WHEN b.rank IS NULL THEN 1 WHEN a.rank < b.rank THEN 1 ELSE -1 END AS v FROM pf LEFT JOIN rk a ON a.query_id = pf.query_id AND a.doc_id = pf.before LEFT JOIN rk b ON b.query_id = pf.query_id AND b.doc_id = pf.after WHERE pf.after IS NOT NULL) SELECT query_id, round(coalesce(sum(v)::DOUBLE / nullif(sum(abs(v)), 0), 0), 6) AS tau FROM v GROUP BY query_id")
def kendall_tau(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "judgments").where("query_id is not null")
    rank = raw.where("hit_rank is not null").select("query_id", "hit_rank", "doc_id").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("hit_rank", "doc_id")))
    rank = rank.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    gains = raw.groupBy("query_id", "doc_id").agg(F.max(F.coalesce("gain", F.lit(0.0))).alias("gain"))
    pairs = gains.select("query_id", F.col("doc_id").alias("before"), F.lead("doc_id").over(Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "doc_id")).alias("after")).where("after is not null")
    return metrics.kendall_tau(pairs, rank).withColumn("tau", F.round("tau", 6))
