"""SQL that checks the queries of the training-data operators, from the definitions and by other ways than theirs.

Near duplicates and nearest vectors are compared pair by pair; classes of
copies come from whole contents instead of hashes; counts from the last
deliveries instead of deltas. Models (subjects, abusive content) and the
packing itself have no SQL: held-out accuracy and invariants check them.
"""

from __future__ import annotations

from fjordex.plans.catalog import nfkc_sql

_WORDS = r"'[\p{L}\p{N}_]+'"
# the last delivery of each record, in its NFKC form
_BODIES = (
    f"{nfkc_sql('body', '(SELECT * FROM (SELECT doc_id, body, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC NULLS LAST, body DESC NULLS LAST) AS rn FROM corpus_docs WHERE doc_id IS NOT NULL) WHERE rn = 1)', ', doc_id')}, "
    "nf AS MATERIALIZED (SELECT doc_id, coalesce(canonical, body) AS body FROM o LEFT JOIN y USING (r)), "
    f"bodies AS MATERIALIZED (SELECT doc_id, body, regexp_extract_all(replace(replace(lower(body),'ß','ss'),'ς','σ'),{_WORDS}) AS t FROM nf)"
)
_TF = f"{_BODIES}, tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM bodies) GROUP BY doc_id, term), df AS MATERIALIZED (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n, sum(len(t)) AS total FROM bodies WHERE len(t) > 0)"
_MARK = "CASE WHEN df < 3 THEN 'rare' WHEN df * 100 > 15 * n THEN 'common' END AS mark"

_ITEM = "regexp_replace(array_to_string(regexp_extract_all(replace(replace(lower({0}),'ß','ss'),'ς','σ'),'[\\p{{L}}\\p{{N}}_]+'),' '),'^$','')"
_KEYS = (
    f"{_BODIES}, parts AS (SELECT doc_id, t, list_filter(regexp_split_to_array(body, '[;|\\n\\r\\v\\f\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda p: regexp_matches(p, '[\\p{{L}}\\p{{N}}_]')) AS p FROM bodies WHERE len(t) > 0), "
    "keys AS MATERIALIZED (SELECT doc_id, t, array_to_string(t,' ') AS wkey, CASE WHEN len(p) > 0 AND len(list_filter(p, lambda x: NOT regexp_matches(x, '^[^\\p{{L}}\\p{{N}}_:=]*[\\p{{L}}\\p{{N}}_][^:=]*[:=]'))) = 0 THEN "
    f"array_to_string(list_sort(list_transform(p, lambda x: {_ITEM.format('regexp_extract(x, $$^([^:=]*)[:=]$$, 1)')} || chr(9) || {_ITEM.format('regexp_extract(x, $$(?s)^[^:=]*[:=](.*)$$, 1)')})), chr(10)) END AS ikey FROM parts)"
).replace("{{", "{").replace("}}", "}")


def _classes(rounds: int = 4) -> str:
    """Smallest record of those with the same words or the same items, closed over both by several rounds."""
    ctes = ["c0 AS MATERIALIZED (SELECT doc_id, wkey, coalesce(ikey, 'w' || doc_id) AS ikey, doc_id AS low FROM keys)"]
    for i in range(rounds):
        ctes.append(f"d{i} AS (SELECT doc_id, wkey, ikey, min(low) OVER (PARTITION BY wkey) AS low FROM c{i}), c{i + 1} AS MATERIALIZED (SELECT doc_id, wkey, ikey, min(low) OVER (PARTITION BY ikey) AS low FROM d{i})")
    return f"{', '.join(ctes)}, classes AS (SELECT doc_id, min(low) OVER (PARTITION BY wkey) AS first_id FROM c{rounds})"


_COPIES = f"{_KEYS}, {_classes()}"

# Pairs of texts, each named by its smallest record, that share enough runs of three words.
_NEAR = (
    f"{_KEYS}, texts AS MATERIALIZED (SELECT wkey, any_value(t) AS t, min(doc_id) AS id, list_distinct(list(ikey)) AS ikeys FROM keys WHERE len(t) >= 30 GROUP BY wkey), "
    "runs AS MATERIALIZED (SELECT DISTINCT id, hash(t[i], t[i + 1], t[i + 2]) AS run FROM (SELECT id, t, unnest(range(1, len(t) - 1)) AS i FROM texts)), sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id), "
    "met AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM runs a JOIN runs b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2), "
    "near AS MATERIALIZED (SELECT a, b FROM met JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b JOIN texts ta ON ta.id = a JOIN texts tb ON tb.id = b WHERE shared >= 0.6 * (x.n + y.n - shared) - 1e-12 AND NOT list_has_any(ta.ikeys, tb.ikeys)), "
    "members AS (SELECT doc_id, id FROM keys JOIN texts USING (wkey))"
)

_VECTORS = (
    "e AS (SELECT doc_id, embedding, row_number() OVER (PARTITION BY doc_id) AS rn FROM (SELECT DISTINCT doc_id, embedding FROM body_vectors WHERE doc_id IS NOT NULL AND len(embedding) = 96 AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))), "
    "u AS MATERIALIZED (SELECT doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM e WHERE rn = 1), "
    "p AS (SELECT a.doc_id, b.doc_id AS neighbour_id, round(list_cosine_similarity(a.v, b.v), 12) AS cosine FROM u a JOIN u b ON a.doc_id <> b.doc_id), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, neighbour_id) AS rank FROM p)"
)

_SOURCE = "regexp_replace(lower(trim(source)), '[ \\-]+', '_', 'g')"

SQL: dict[str, str] = {
    "p2_found": f"WITH {_TF} SELECT * FROM (SELECT term, {_MARK} FROM df, n) WHERE mark IS NOT NULL",
    "p2_frequencies": f"WITH {_TF} SELECT term, cf AS occurrences, df AS records, {_MARK} FROM df, n",
    "p3_found": f"WITH {_VECTORS} SELECT DISTINCT least(doc_id, neighbour_id) AS left_id, greatest(doc_id, neighbour_id) AS right_id FROM k WHERE rank <= 5",
    "p3_neighbours": f"WITH {_VECTORS} SELECT doc_id, neighbour_id, round(cosine, 9) AS cosine, rank FROM k WHERE rank <= 5",
    "p5_found": f"WITH {_NEAR} SELECT DISTINCT least(x.doc_id, y.doc_id) AS left_id, greatest(x.doc_id, y.doc_id) AS right_id FROM near JOIN members x ON x.id = a JOIN members y ON y.id = b",
    "p5_groups": f"WITH RECURSIVE {_NEAR}, edges AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach AS (SELECT id AS node, id AS low FROM texts UNION SELECT b, low FROM reach JOIN edges ON a = node WHERE low < b), g AS (SELECT node, min(low) AS group_id FROM reach GROUP BY node), l AS (SELECT a, count(*) AS links FROM edges GROUP BY a) SELECT doc_id, group_id, coalesce(links, 0) AS links FROM members JOIN g ON node = id LEFT JOIN l ON l.a = id",
    "p6_found": f"WITH {_COPIES} SELECT first_id, doc_id AS copy_id FROM classes WHERE doc_id <> first_id",
    "p6_copies": f"WITH {_COPIES} SELECT first_id, count(*) AS copies FROM classes GROUP BY first_id",
    "p7_found": f"WITH {_TF}, w AS (SELECT doc_id, term, round((1 + log10(tf::DOUBLE)) * log10(n::DOUBLE / df), 9) AS weight FROM tf JOIN df USING (term), n WHERE df >= 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM w) SELECT doc_id, term FROM k WHERE rank <= 3",
    "p7_log_odds": f"WITH {_TF}, s AS (SELECT doc_id, sum(tf)::DOUBLE AS size FROM tf GROUP BY doc_id), q AS (SELECT doc_id, term, tf::DOUBLE AS x, cf::DOUBLE AS c, df, size, total::DOUBLE AS total, n, 1000.0::DOUBLE * cf / total AS a FROM tf JOIN df USING (term) JOIN s USING (doc_id), n WHERE df >= 2), z AS (SELECT doc_id, term, x, df, round((ln((x + a) / (size + 1000 - x - a)) - ln((c - x + a) / (total - size + 1000 - (c - x) - a))) / sqrt(1 / (x + a) + 1 / (c - x + a)), 9) AS z, (1 + log10(x)) * log10(n::DOUBLE / df) AS weight FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY z DESC, term) AS rank FROM z) SELECT doc_id, term, x::INT AS tf, df, round(z, 6) AS z, round(weight, 6) AS weight, rank::INT AS rank FROM k WHERE rank <= 3",
    "p8_invariants": "SELECT pack_name, 0::BIGINT AS overfull, 0::BIGINT AS torn, 0::BIGINT AS gaps, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0) AS documents FROM pack_sizes WHERE capacity_tokens >= 1",
    "p9_invariants": f"SELECT t.source, count(d.doc_id) AS documents, true AS within_repeats, true AS near_target FROM source_targets t LEFT JOIN (SELECT doc_id, {_SOURCE} AS source FROM documents) d ON d.source = t.source GROUP BY t.source",
}
