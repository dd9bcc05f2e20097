import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from fjordex.functions import distance
from fjordex.functions.text import py_terms
from fjordex.operators import bags, bloom, boolean, classify, extract, graph, index, metrics, ranked, strings, vectors


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_index(spark):
    d = docs(spark, "this is a Test", "test TEST prØve", None, "")
    post = index.postings(d, ["body"])
    assert pairs(index.lookup(post, "test"), "doc_id", "tf") == [(0, 1), (1, 2)]
    assert pairs(index.statistics(post).where("term in ('test','prøve','wtf')"), "term", "df", "cf") == [("prøve", 1, 1), ("test", 2, 3)]
    f = spark.createDataFrame([(0, "Dette er en test. Test, sa jeg. TEST!", "test er det", "test TEsT")], "doc_id long, felt1 string, felt2 string, felt3 string")
    assert pairs(index.postings(f, ["felt1", "felt3"]).where("term = 'test'"), "tf") == [(5,)]
    ids = {r.term: r.term_id for r in index.term_ids(d, "body").collect()}
    assert ids == {"this": 0, "is": 1, "a": 2, "test": 3, "prøve": 4}
    assert index.postings(d.limit(0), ["body"]).count() == 0
    g = index.gaps(post).where("term = 'test'")
    assert pairs(g, "doc_id", "gap", "bytes") == [(0, 0, 2), (1, 1, 2)]
    assert index.out_of_order(post, "doc_id").count() == 0


def test_boolean(spark):
    post = index.postings(docs(spark, "a b c", "a c", "b", "c d e"), ["body"])

    def ids(e, synonyms=None):
        return [r.doc_id for r in boolean.search(post, e, synonyms).collect()]

    def error(e):
        return boolean.search(post, e).collect()[0].error

    assert ids("AND('a b', c)") == [0] and ids("OR('a b')") == [0, 1, 2] and ids("ANDNOT(c, 'a e')") == [] and ids("ANDNOT(c, b)") == [1, 3]
    assert ids("AND(WILDCARD('*zz'), a)") == [] and ids("OR(SOUNDSLIKE(a), LOOKSLIKE(x))") == [0, 1, 2, 3]
    syn = spark.createDataFrame([("q", "d")], "term string, synonym string")
    assert ids("SYNONYM(q)", syn) == [3] and ids("SYNONYM(b)", syn) == [0, 2]
    assert error("AND('pear', OR())") == "OR takes 1 or more operands, not 0"
    assert error("ANDNOT('pear')") == "ANDNOT takes 2 operands, not 1"
    assert error("NEAR('pear','plum')") == "there is no operator NEAR"
    assert error("''") == "'' has 0 terms where at least one is needed" and "one is needed" in error("SOUNDSLIKE('two words')")
    assert error("AND(1 + 2)") == "BinOp is not part of an expression" and error("WILDCARD('a**b')") and error("SYNONYM(1 + 2)") == "SYNONYM takes a word or a quoted text"
    assert error("AND(") and error("__import__('os').system('x')")
    with pytest.raises(ValueError):
        boolean.check_analyzer(lambda t: t.split("e"))
    boolean.check_analyzer(py_terms)


def test_boolean_with_very_many_terms(spark):
    """More terms than one word of flags holds, and patterns that most of the vocabulary fits."""
    rows = [(i, f"w{i} w{(i + 1) % 150} x") for i in range(150)]
    post = index.postings(spark.createDataFrame(rows, "doc_id long, body string"), ["body"])
    some = ",".join(f"w{i}" for i in range(0, 150, 2))
    ids = lambda e: [r.doc_id for r in boolean.search(post, e).collect()]
    assert ids(f"ANDNOT(x, OR({some}))") == [] and ids(f"AND(OR({some}), w7)") == [6, 7] and len(ids("AND(WILDCARD('w*'), x)")) == 150
    assert ids(f"AND(OR({some}), WILDCARD('*49'), WILDCARD('w1*'))") == [148, 149] and ids("AND(WILDCARD('w14*'), ANDNOT(w149, w0))") == [148]


def test_merges(spark):
    post = spark.createDataFrame([("a", x, 1) for x in (1, 2, 3, 9)] + [("b", x, 1) for x in (2, 3, 6, 8)], "term string, doc_id long, tf long")
    assert pairs(boolean.merge(post, "a", "b", "and"), "doc_id") == [(2,), (3,)]
    assert pairs(boolean.merge(post, "a", "b", "or"), "doc_id") == [(1,), (2,), (3,), (6,), (8,), (9,)]
    assert pairs(boolean.merge(post, "a", "b", "andnot"), "doc_id") == [(1,), (9,)] and pairs(boolean.merge(post, "b", "a", "andnot"), "doc_id") == [(6,), (8,)]
    assert pairs(boolean.merge(post, "a", "none", "and"), "doc_id") == []


def test_ranked(spark):
    words = ["".join(x) for x in itertools.product("bcd", "aei", "jkl")]
    d = docs(spark, *(" ".join(x) for x in itertools.combinations_with_replacement(words, 3)))
    post = index.postings(d, ["body"]).cache()

    def run(q, t, k):
        return ranked.search(post, q, ranker=ranked.by_frequency, threshold=t, hits=k).collect()

    r = run("baj BAJ baj", 1.0, 27)
    assert len(r) == 27 and (r[0].doc_id, r[0].score) == (0, 9.0)
    assert len(run("baj caj", 1.0, 100)) == 27 and len(run("baj caj daj", 2 / 3 + 1e-4, 100)) == 79
    r = run("baj cek dil", 1.0, 10)
    assert [(x.doc_id, x.score) for x in r] == [(286, 3.0)]
    assert len(run("baj xxx yyy", 2 / 3 + 1e-4, 100)) == 0 and len(run("baj xxx yyy", 2 / 3 - 1e-4, 100)) == 100 and run("", 1, 5) == []
    static = spark.createDataFrame([(5, 9.0), (6, None)], "doc_id long, quality double")
    assert ranked.search(post, "baj", d.count(), static=static).first().doc_id == 5
    assert ranked.with_fields(ranked.search(post, "baj", d.count(), hits=3), d).count() == 3


def test_wildcards_and_tries(spark):
    v = spark.createDataFrame([(w,) for w in "hello fishmonger filibuster fish fisher sofiafill delfi banana anna".split()], "key string")

    def hits(p):
        return {r.key for r in v.where(strings.wildcard(F.col("key"), p)).collect()}

    assert hits("fi*") == {"fish", "fisher", "fishmonger", "filibuster"} and hits("*fi") == {"delfi"} and hits("*an*") == {"anna", "banana"}
    assert hits("fi*er") == {"fisher", "fishmonger", "filibuster"} and hits("fi*mo*er") == {"fishmonger"} and hits("f*e*") == {"fisher", "fishmonger", "filibuster"} and hits("anna*anna") == set()
    for p in ("*", "W*X*Y*Z", "X**Y", "", "**"):
        with pytest.raises(KeyError):
            strings.wildcard(F.col("key"), p)
    assert [r.key for r in strings.prefixed(v, "fis").collect()] == ["fish", "fisher", "fishmonger"]
    assert pairs(strings.transitions(v, "fish"), "symbol", "final") == [("e", False), ("m", False)]


def test_fuzzy(spark):
    words = "lantern lanter lanetrn lanternss lamtren banter cantor anten".split()
    v = spark.createDataFrame([(w,) for w in [*words, None]], "key string")
    for bound in range(9):
        want = sorted((distance.osa(w, "lantern"), w) for w in words if distance.osa(w, "lantern") <= bound)
        assert [(r.distance, r.key) for r in strings.fuzzy(v, "lantern", bound).collect()] == want
    assert strings.fuzzy(v, "lantern", 3, first_n=3, scoring="lopresti").first().key == "lantern"
    assert {r.key for r in strings.fuzzy(v, "lantern", 2, first_n=4).collect()} == {"lantern", "lanter", "lanternss"}


def test_phrases_and_scan(spark):
    d = docs(spark, "o o o o", "That th that the", None, "")
    assert pairs(strings.phrase_prefix(d, ["body"], "o o"), "doc_id", "score") == [(0, 3)]
    assert pairs(strings.phrase_prefix(d, ["body"], "that  TH"), "doc_id", "score") == [(1, 2)] and strings.phrase_prefix(d, ["body"], " ").count() == 0
    f = spark.createDataFrame([(0, "a b c", "b c d"), (1, "x", "y"), (2, "y", "z")], "doc_id long, field1 string, field2 string")
    assert pairs(strings.phrase_prefix(f, ["field1", "field2"], "b c"), "doc_id", "score") == [(0, 2)]
    assert strings.phrase_prefix(f, ["field1", "field2"], "x y").count() == 0
    assert strings.phrase_places(index.positions(f, ["field1", "field2"]), "x y").count() == 0
    many = docs(spark, "the inverted index inverts", "inverted  INDEXES, inverted ind", "index inverted", "Straße zum ﬁnden", "ind", "")
    places = index.positions(many, ["body"])
    for q in ("inverted ind", "ind", "index inverts", "strasse zum fin", "inverted", "the the", "no"):
        want = sorted(tuple(r) for r in strings.phrase_prefix(many, ["body"], q).collect())
        assert sorted(tuple(r) for r in strings.phrase_places(places, q).collect()) == want and (want or q in ("the the", "no"))


def slow_scan(texts, entries, normalize=strings.fold_token, spans=strings.word_spans):
    """Every run of every text against every entry."""
    found = set()
    for i, x in enumerate(texts):
        at = spans(x or "")
        for e in entries:
            words = [normalize(t) for t, _, _ in spans(e or "")]
            for j in range(len(at) - len(words) + 1 if words else 0):
                run = at[j : j + len(words)]
                if [normalize(t) for t, _, _ in run] == words:
                    found.add((i, " ".join(words), " ".join(t for t, _, _ in run), run[0][1], run[-1][2]))
    return found


@pytest.mark.parametrize("as_join", [False, True])
def test_dictionary_scan(spark, as_join):
    """Entries of any length, overlapping and nested, with several metadata, over odd texts; both ways alike."""
    texts = ["ship  SHIPS ship's, a large sailing ship of the old and distant north", None, "", " .,", "Öre öRE ｗｉｄｅ ﬁsh Straße STRASSE", "old and distant " * 3000, "of the old and distant north wind"]
    entries = ["ship", "sailing ship", "large sailing ship of the old and distant north", "of the old and distant north wind", "öre", "wide fish", "STRASSE", "distant old", "", None, " .", "s"]
    keys = spark.createDataFrame([(e, i) for i, e in enumerate(entries)] + [("Ship", 99), ("ship", 0)], "key string, id long")
    d = docs(spark, *texts).withColumn("run", F.lit("clash")).withColumn("meta", F.lit("clash"))
    got = [tuple(r) for r in strings.dictionary_scan(d, "body", keys, as_join=as_join).collect()]
    want = slow_scan(texts, entries)
    assert len(got) == len(set(got)) and set(got) == want and {len(m.split()) for _, m, *_ in got} == {1, 2, 7, 9}
    rows = strings.dictionary_scan(d, "body", keys, meta="id", as_join=as_join).where("match = 'ship' and doc_id = 0")
    assert {(r.begin, r.meta) for r in rows.collect()} == {(b, m) for b in (0, 12, 36) for m in (0, 99)}
    assert strings.dictionary_scan(d, "body", keys.limit(0), as_join=as_join).count() == strings.dictionary_scan(d.limit(0), "body", keys, as_join=as_join).count() == 0
    # other tokens and other ways to compare them
    letters = strings.dictionary_scan(docs(spark, "a b cab"), "body", spark.createDataFrame([("ab",), ("bc",)], "key string"), spans=strings.character_spans, as_join=as_join)
    assert pairs(letters, "match", "begin", "end") == [("a b", 0, 3), ("a b", 5, 7), ("b c", 2, 5)]
    vowels = str.maketrans("", "", "aeiou")
    blurred = strings.dictionary_scan(docs(spark, "the boot, a beet"), "body", spark.createDataFrame([("but", "x")], "key string, m string"), meta="m", normalize=lambda t: t.lower().translate(vowels), as_join=as_join)
    assert pairs(blurred, "surface", "meta") == [("beet", "x"), ("boot", "x")]


def test_windows(spark):
    d = docs(spark, "one, two.  Four three -- two ONE: three", "one two", None, "Straße one ﬁ three two")
    rows = d.select(strings.min_window(F.col("body"), "three one two").alias("w"), strings.snippet(F.col("body"), "three one two").alias("s"), strings.snippet(F.col("body"), "three one two", context=3).alias("c")).collect()
    assert tuple(rows[0].w) == (3, 3, 5, 16, 32) and rows[0].s == "one, two.  Four three -- two ONE: three" and rows[0].c == "ur three -- two ONE: t"
    assert rows[1].w.width is None and rows[2].s is None and tuple(rows[3].w) == (4, 1, 4, 7, 22)
    assert d.select(strings.min_window(F.col("body"), " ").alias("w")).where("w.width is not null").count() == 0 and d.select(strings.snippet(F.col("body"), "one two", widest=1).alias("s")).where("s is not null").count() == 0
    assert strings.py_window("a b a c".split(), "a a".split()) == (3, 0, 2) and strings.py_window(["a"], []) is None


def test_nearest_in_blocks(spark):
    """Blocks of any size give the same rows as a comparison of everything with everything."""
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(8)]) for i in range(300)] + [(400, [1.0, 2.0]), (401, [2.0, 4.0]), (402, None), (403, []), (404, [0.0] * 8), (405, [1.0, None]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("score", F.lit(1))
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in rows if i is not None and v and None not in v and any(v)}
    for others in (False, True):
        want = {}
        for q in (q for q in unit if q % 10 == 0):
            scored = [(-round(sum(a * b for a, b in zip(unit[q], v)), 6), i) for i, v in unit.items() if len(v) == len(unit[q]) and not (others and i == q)]
            want[q] = [(i, -x) for x, i in sorted(scored)[:4]]
        for size in (1 << 20, 700):
            got = {}
            for r in vectors.nearest_to(df.where("vec_id % 10 = 0"), df, 4, others=others, block_bytes=size).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append((r.near_id, r.score))
            assert {q: [(i, pytest.approx(x, abs=2e-6)) for i, x in v] for q, v in want.items()} == got
    assert vectors.nearest_to(df.limit(0), df, 4).count() == vectors.nearest_to(df, df.limit(0), 4).count() == 0


def test_embedded(spark):
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "term string, embedding array<double>")
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "zz"), (2, "zz"), (3, "a")], "doc_id long, term string")
    assert {r.doc_id: r.embedding for r in vectors.embedded(tokens, words).collect()} == {1: [pytest.approx(1 / 3), 2.0], 3: [1.0, 0.0]}


def test_vectors(spark):
    v = spark.createDataFrame([(1, "a", 0.4), (1, "c", 1.2), (1, "b", 0.9), (2, "c", 0.5), (2, "a", 0.8), (2, "x", 1.0)], "doc_id long, term string, weight double")
    right = v.where("doc_id = 2").withColumnRenamed("doc_id", "other_id")
    assert vectors.dots(v.where("doc_id = 1"), right, "doc_id", "other_id").first().dot == pytest.approx(0.92)
    assert all(r.length == pytest.approx(1) for r in vectors.lengths(vectors.normalized(v)).collect())
    members = spark.createDataFrame([(1, "k"), (2, "k"), (3, "k")], "doc_id long, label string")
    c = {r.term: r.weight for r in vectors.centroids(v, members).collect()}
    assert c["c"] == pytest.approx(1.7 / 3) and vectors.scaled(v, 0).count() == 0
    assert pairs(vectors.top_terms(v, 1), "doc_id", "term") == [(1, "c"), (2, "x")]
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [3.0, 3.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in vectors.nearest(e, [1.0, 0.0], 2).collect()] == [(1, 1.0), (6, round(math.sqrt(0.5), 6))] and vectors.nearest(e, [0.0, 0.0]).count() == 0


def test_naive_bayes_and_friends(spark):
    d = docs(spark, "Chinese Beijing Chinese", "Chinese Chinese Shanghai", "Chinese Macao", "Tokyo Japan Chinese", "Chinese Chinese Chinese Tokyo Japan")
    labels = spark.createDataFrame([(0, "china"), (1, "china"), (2, "china"), (3, "not china"), (9, None)], "doc_id long, label string")
    post = index.postings(d, ["body"])
    nb = classify.NaiveBayes.train(post, labels)
    assert {r.label: round(math.exp(r.prior), 6) for r in nb.priors.collect()} == {"china": 0.75, "not china": 0.25}
    p = {(r.label, r.term): math.exp(r.posterior) for r in nb.posteriors.collect()} | {(r.label, None): math.exp(r.unseen) for r in nb.unseen.collect()}
    assert p["china", "chinese"] == pytest.approx(3 / 7) and p["china", None] == pytest.approx(1 / 14) and p["not china", "chinese"] == pytest.approx(2 / 9)
    scores = {r.label: r.score for r in nb.classify(post).where("doc_id = 4").collect()}
    assert scores["china"] == pytest.approx(math.log(0.75 * (3 / 7) ** 3 / 14 / 14)) and classify.best(nb.classify(post)).where("doc_id = 4").first().label == "china"
    unit = vectors.normalized(vectors.tfidf(post, 5))
    assert classify.best(classify.rocchio(unit, labels.dropna(), unit)).where("doc_id = 1").first().label == "china"
    rows = unit.join(labels.dropna(), "doc_id").select("doc_id", "term", F.col("weight").alias("x"), (F.col("label") == "china").cast("int").alias("y"))
    losses = []
    theta = classify.logistic_regression(rows, 12, callback=lambda e, x: losses.append(x) or len(losses) < 8)
    # weights in an array and weights in a table
    more: list[float] = []
    again = classify.logistic_regression(rows, 12, callback=lambda e, x: more.append(x) or len(more) < 8, most_terms=3)
    assert more == pytest.approx(losses) and {r.term: pytest.approx(r.weight) for r in theta.collect()} == {r.term: r.weight for r in again.collect()}
    assert losses == sorted(losses, reverse=True) and len(losses) == 8 and classify.logistic_scores(unit, theta).where("doc_id = 1").first().score > 0.5
    near = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.6), (1, 12, 0.5), (1, 13, 0.1)], "query_id long, near_id long, score double")
    lab = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b"), (10, "c"), (13, "a")], "near_id long, label string")
    assert {r.label: r.score for r in classify.neighbours_vote(near, lab, 3).collect()} == {"a": 0.25, "b": 0.5, "c": 0.25}
    assert {r.label: round(r.score, 4) for r in classify.neighbours_vote(near, lab, 3, True).collect()} == {"a": round(0.9 / 2.9, 4), "b": round(1.1 / 2.9, 4), "c": round(0.9 / 2.9, 4)}


def test_large_models_are_joined(spark, monkeypatch):
    d = docs(spark, "a b b", "c b", "a a d", "d c x", None)
    labels = spark.createDataFrame([(0, "p"), (1, "q"), (2, "p"), (2, "r"), (4, "r")], "doc_id long, label string")
    post, found = index.postings(d, ["body"]), []
    for cells in (10_000, 1):
        monkeypatch.setattr(classify, "MODEL_CELLS", cells)
        unit = vectors.normalized(vectors.tfidf(post, 5))
        found.append([sorted((r.doc_id, r.label, round(r.score, 9)) for r in x.collect()) for x in (classify.NaiveBayes.train(post, labels).stored().classify(post), classify.rocchio(unit, labels, unit))])
    assert found[0] == found[1] and len(found[0][0]) == 12 and len(found[0][1]) > 6
    none = classify.NaiveBayes.train(post, labels.limit(0))
    assert none.classify(post).count() == classify.rocchio(unit, labels.limit(0), unit).count() == 0


def test_ids_are_dense(spark):
    """Whatever the number of partitions, with ties, repeated rows and nulls."""
    rows = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 11 > 0, F.col("id")).alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            for _ in range(2):
                got = index.dense_ids(rows.repartition(n), [F.col("k"), F.col("v")], "n").orderBy("n").collect()
                assert [r.n for r in got] == list(range(5000)) and [r.k for r in got] == sorted(r.k for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert index.dense_ids(rows.limit(0), [F.col("k")], "n").count() == 0


def test_long_posting_lists_are_cut(spark):
    """Lists that span several ranges have the same gaps as whole ones."""
    rows = [("the", i, 1) for i in range(1, 3000, 3)] + [(f"w{i % 7}", i, 2) for i in range(0, 400, 5)] + [("z", 9, 1)]
    post = spark.createDataFrame(rows, "term string, doc_id long, tf long").withColumn("at", F.when(F.col("doc_id") == 601, -1).otherwise(F.col("doc_id")))
    want, last = set(), {}
    for t, i, _ in sorted(rows):
        want.add((t, i, i - last.get(t, 0)))
        last[t] = i
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 9):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = index.gaps(post).collect()
            assert len(got) == len(rows) and {(r.term, r.doc_id, r.gap) for r in got} == want
            assert index.out_of_order(post, "doc_id").count() == 0 and [r.doc_id for r in index.out_of_order(post, "at").collect() if r.term == "the"] == [1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert index.gaps(post.limit(0)).count() == 0


def test_graph(spark):
    def run(adj, alpha):
        e = spark.createDataFrame([(i, j) for i, a in enumerate(adj) for j in a] or [(None, None)], "src long, dst long")
        n = spark.createDataFrame([(i,) for i in range(len(adj))], "node long")
        return [r.rank for r in graph.pagerank(e, n, alpha).orderBy("node").collect()]

    assert run([[1], [0, 2], [1]], 0.5) == pytest.approx([5 / 18, 4 / 9, 5 / 18], abs=1e-4)
    assert sum(run([[1, 1], [], [0]], 0.2)) == pytest.approx(1)
    with pytest.raises(ValueError):
        run([[1], [0]], 0)
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (4, 3), (10, 9)], "src long, dst long")
    assert pairs(graph.connected_components(e), "node", "component") == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8), (10, 8)]
    path = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in graph.connected_components(path).collect()} == {0} and graph.connected_components(e.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        graph.connected_components(path, max_rounds=2)
    long = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in graph.connected_components(long).collect()} == {0}


def test_metrics(spark):
    j = spark.createDataFrame([(1, r, r, x, float(g)) for r, (x, g) in enumerate(zip([True, False, True, True, False, None], [3, 2, 3, 0, 1, 2]), 1)] + [(1, None, 7, True, 1.0), (1, 1, 1, True, 3.0), (2, 1, 1, False, 0.0)], "query_id long, hit_rank int, doc_id long, relevant boolean, gain double")
    d = metrics.judged(j)
    one = d.where("query_id = 1")
    assert [round(r.precision, 4) for r in metrics.precision(one).orderBy("rank").collect()][:5] == [1, 0.5, 0.6667, 0.75, 0.6]
    assert [round(r.interpolated, 4) for r in metrics.interpolated(one).orderBy("rank").collect()][:2] == [1, 0.75]
    assert [round(r.recall, 4) for r in metrics.recall(one).orderBy("rank").collect()][:3] == [0.3333, 0.3333, 0.6667]
    assert metrics.recall(d).where("query_id = 2").first().recall is None and metrics.f_score(d).where("query_id = 2").first().f is None
    perfect = spark.createDataFrame([(1, float(g)) for g in (3, 3, 3, 2, 2, 2, 1, 0)], "query_id long, gain double")
    n = metrics.ndcg(one, perfect).first()
    assert round(n.dcg, 3) == 6.861 and round(n.ndcg, 3) == 0.785
    assert {r.query_id: r.rr for r in metrics.reciprocal_rank(d).collect()} == {1: 1.0, 2: 0.0} and {r.query_id: r.ap for r in metrics.average_precision(d).collect()}[2] == 0
    prefs = spark.createDataFrame([(1, a, b) for a, b in (("a", "b"), ("b", "a"), ("x", "y"), ("x", "a"), ("b", "x"))], "query_id long, before string, after string")
    rank = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, doc_id string, rank int")
    assert metrics.kendall_tau(prefs, rank).first().tau == 0


def test_bloom(spark):
    assert [bloom.parameters(*x) for x in ((1, 0.99), (10, 0.05), (4000, 1e-7), (2000, 1e-4))] == [(1, 1), (62, 4), (134190, 23), (38340, 13)]
    df = spark.createDataFrame([("abc",), ("ø",), (None,)], "s string").withColumn("x", bloom.slots(F.col("s"), 62, 4))
    assert all(r.x == (None if r.s is None else bloom.py_slots(r.s, 62, 4)) for r in df.collect())
    f = bloom.BloomFilter(100, 0.001).add(spark.range(100).select(F.col("id").cast("string").alias("s")), "s")
    rows = f.members(spark.range(50, 300).select(F.col("id").cast("string").alias("s")).union(df.select("s")), "s").collect()
    assert all(r.member for r in rows if r.s and r.s.isdigit() and int(r.s) < 100) and sum(r.member for r in rows) < 55 and len(rows) == 253


def test_extract(spark):
    cases = {
        "Then The Keeper of the Lighthouse came home.  Later Apollo 11 was on every screen.": ["The Keeper of the Lighthouse", "Apollo 11"],
        "Why Nearly Every Word Here Stands With A Capital In It is a mystery Of Headlines!": [],
        "Xa Yb. Zc Wd! Ve Uf? Tg Sh: Ri Qj": ["Yb", "Wd", "Uf", "Sh", "Qj"],
        '"Maria paints Venice!", they said.': ["Venice"],
        "Surely, Ingrid  Solbakken is never  as calm as  Karl the  Bald!": ["Ingrid Solbakken", "Karl the Bald"],
        "Did Rolls-Royce ever build a bus near Aix-en-Provence?": ["Rolls-Royce", "Aix", "Provence"],
        "Has Fiona MacLeod seen the eBook of NATO?": ["Fiona MacLeod", "eBook"],
        "here the Upper Part\n \t\nand then the Lower Part": ["Upper Part", "Lower Part"],
        "We meet on June 14 or some Friday in March. Is Sep 02 free, or Good Friday?": ["Good Friday"],
        "Ask Prof. Plum, Mrs Peacock and Queen of the von Bergen line, not 3 Men": ["Prof. Plum", "Mrs Peacock and Queen", "Bergen", "Men"],
        "a Straße of Ære is far longer than an Ülker or the ΑΒγ": ["Straße of Ære", "Ülker", "ΑΒγ"],
    }
    df = spark.createDataFrame([(k,) for k in [*cases, "", None]], "t string")
    got = {r.t: r.n for r in df.select("t", extract.proper_nouns(F.col("t")).alias("n")).collect()}
    assert got == cases | {"": [], None: []}
    g = {"top": {"expression": "{baz} tea {foo} {bar}", "capture": True}, "foo": "chocolate", "bar": "{baz} or {baz}", "baz": {"expression": "bread|buns", "capture": True}, "loop": "{loop}", "bad": "{dangling}", "no": {"expression": "x", "capture": True, "decorate": False}, "plain": "a {{1,3}} {{top}}"}
    import re

    m = re.fullmatch(extract.compose(g, "top"), "buns tea chocolate bread or buns")
    assert m and sorted(m.groupdict().values()) == sorted(["buns tea chocolate bread or buns", "buns", "bread", "buns"]) and extract.compose(g, "plain") == "(?:a {1,3} {top})"
    for root, kind in (("loop", KeyError), ("bad", KeyError), ("no", ValueError), ("none", KeyError)):
        with pytest.raises(kind):
            extract.compose(g, root)


def test_logreg_trained(spark, tmp_path):
    import numpy as np

    from fjordex.plans import catalog

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 400").orderBy("doc_id").limit(12).write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog._logreg_rows(spark, str(tmp_path)).collect()
    docs, terms = sorted({r.doc_id for r in rows}), ["", *sorted({r.term for r in rows})]
    x, y = np.zeros((len(docs), len(terms))), np.zeros(len(docs))
    x[:, 0] = 1
    for r in rows:
        x[docs.index(r.doc_id), terms.index(r.term)], y[docs.index(r.doc_id)] = r.x, r.y
    w = np.zeros(len(terms))
    for _ in range(100):
        w -= 0.5 * x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(docs)
    got = {r.term: r.weight for r in catalog.QUERIES["logreg_trained"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(dict(zip(terms, w)), abs=2e-6)


def test_logistic_of_bags(spark, monkeypatch):
    from fjordex.plans import catalog

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    packed = bags.bags(docs, "text", (F.lower("lang") == "en").cast("int"))
    want = {r.term: r.weight for r in classify.logistic_regression(catalog._logreg_rows(spark, d), 4).collect()}
    assert {r.term: r.weight for r in bags.logistic(packed, 4).collect()} == pytest.approx(want, abs=1e-9)
    none = bags.bags(docs.where("lang is null"), "text", (F.lower("lang") == "en").cast("int"))
    assert bags.logistic(none, 2).count() == 0 and bags.bags(docs, "text", most_terms=10) is None

    def refuse(*_):
        raise AssertionError("the terms came to the driver")

    monkeypatch.setattr(classify, "_by_arrays", refuse)
    monkeypatch.setattr(bags.logistic, "__defaults__", (2, 0.5))
    assert {r.term for r in catalog.QUERIES["logreg_trained"](spark, d).collect()} == set(want)


def test_cosine_pairs(spark, tmp_path):
    import numpy as np

    from fjordex.plans import catalog

    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 900").orderBy("doc_id").limit(60)
    odd = spark.createDataFrame([(900, "", "en"), (901, None, "en"), (902, "solitude", None), (903, "the index the index", None), (904, "the index the index", None)], given.schema)
    given.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: py_terms(r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    ids, terms = sorted(texts), sorted({t for x in texts.values() for t in x})
    tf = np.array([[texts[i].count(t) for t in terms] for i in ids], float)
    w = np.where(tf > 0, 1 + np.log10(np.maximum(tf, 1)), 0) * np.log10(len(ids) / (tf > 0).sum(0))
    size = np.sqrt((w * w).sum(1))
    want = {}
    for i in np.flatnonzero(size):
        near = [(-round(w[i] @ w[j] / size[i] / size[j], 6), ids[j]) for j in np.flatnonzero((w * w[i]).any(1)) if j != i]
        want[ids[i]] = [(j, -c) for c, j in sorted(near)[:5]]
    got: dict = {}
    for r in catalog.QUERIES["cosine_pairs"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, pytest.approx(r.cosine, abs=2e-6)))
        assert r["rank"] == len(got[r.query_id])
    assert got == {i: x for i, x in want.items() if x} and len(got) > 50 and 903 in got and 902 not in got


def test_nearest_of_bags(spark, monkeypatch):
    from fjordex.plans import catalog

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    v = catalog.vec_(spark, d)
    c = vectors.cosines(v.withColumnRenamed("doc_id", "query_id"), v, "query_id", "doc_id").where("query_id <> doc_id").withColumn("cosine", F.round("cosine", 6))
    want = pairs(vectors.top_k(c, "cosine", 5, "doc_id", "query_id"), "query_id", "doc_id", "cosine", "rank")

    def refuse(*_):
        raise AssertionError("pairs are shuffled")

    with monkeypatch.context() as m:
        m.setattr(vectors, "cosines", refuse)
        assert pairs(catalog.QUERIES["cosine_pairs"](spark, d), "query_id", "doc_id", "cosine", "rank") == want
    # terms within and outside the bounds, several rounds, and the other way for very many terms
    packed = bags.bags(docs, "text")
    monkeypatch.setattr(bags, "_FREQUENT", 40)
    assert pairs(bags.nearest(packed, 5, block_bytes=20_000), "query_id", "near_id", "score", "rank") == want
    assert bags.nearest(bags.bags(docs.limit(0), "text")).count() == 0
    few = bags.bags(docs, "text", most_terms=10)
    monkeypatch.setattr(bags, "bags", lambda *_: few)
    assert few is None and pairs(catalog.QUERIES["cosine_pairs"](spark, d), "query_id", "doc_id", "cosine", "rank") == want
