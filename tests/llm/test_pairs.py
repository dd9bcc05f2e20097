"""Duplicates, near duplicates and neighbours against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordex.functions.text import py_terms
from fjordex.llm import formatting, nearduplicates, neighbours

WORDS = [f"w{i}" for i in range(400)]


def deliveries(spark, rows):
    """(doc_id, body) in order of delivery, with columns whose names clash with the operators' own."""
    data = [(i, b, f"2023-01-01 00:00:{k % 60:02d}", "x", 1, None) for k, (i, b) in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, body string, t string, wkey string, size int, at string")
    return df.withColumn("loaded_at", F.col("t").cast("timestamp")).drop("t")


BODIES = [
    (5, "Hello, World"),
    (3, "hello   world!"),
    (9, "HELLO\tworld"),
    (9, "HELLO\tworld"),
    (1, "name: A b; size=4 | color: red"),
    (2, "Color=RED\nName:a  b\nsize: 4"),
    (4, "name A b size 4 color red"),
    (6, "name: A b; size=4 | color: red; size=4"),
    (7, None),
    (8, "  ...  "),
    (None, "hello world"),
    (10, "lone text"),
    (11, "a: x; a: x; b: y"),
    (12, "b: y; a: x; a: x"),
    (13, "a: x; b: y; b: y"),
]


@pytest.mark.parametrize("exact", [False, True])
def test_formatting(spark, exact):
    c = formatting.copy_classes(deliveries(spark, BODIES), exact=exact)
    got = {r.doc_id: (r.first_id, r.copies) for r in c.collect()}
    assert got == {3: (3, 3), 5: (3, 3), 9: (3, 3), 1: (1, 3), 2: (1, 3), 4: (1, 3), 6: (6, 1), 10: (10, 1), 11: (11, 2), 12: (11, 2), 13: (13, 1)}


def test_formatting_of_nothing(spark):
    assert formatting.copy_classes(deliveries(spark, BODIES).limit(0)).count() == 0


def test_formatting_hot_group(spark, monkeypatch):
    from fjordex.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(i, "Same text" if i % 3 else "same  TEXT!") for i in range(40)] + [(100 + i, f"other {i}") for i in range(5)]
    c = formatting.copy_classes(deliveries(spark, rows))
    assert {(r.first_id, r.copies) for r in c.where("doc_id < 100").collect()} == {(0, 40)} and c.count() == 45


def test_wrong_hashes_are_noticed(spark):
    docs = deliveries(spark, [(1, "one text"), (2, "another text"), (3, "x: 1; y: 2"), (4, "x: 1; y: 3")])
    key = bytearray(b"k")
    members = spark.createDataFrame([(i, key, bytearray(b"l") if i > 2 else None, 2, 2 if i > 2 else 1) for i in (1, 2, 3, 4)], "doc_id long, wkey binary, ikey binary, size long, isize long")
    members = members.join(docs.select("doc_id", F.col("loaded_at").alias("at"), F.xxhash64("body").alias("mark")), "doc_id")
    assert {bytes(r.key) for r in formatting._unequal(docs, "doc_id", "body", "loaded_at", members).collect()} == {b"k", b"l"}


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(60):
        base = [rng.choice(WORDS) for _ in range(rng.randint(30, 90))]
        rows.append((10 * i, " ".join(base)))
        for k in range(1, rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                p = rng.randrange(len(w))
                rng.choice([lambda: w.pop(p), lambda: w.insert(p, rng.choice(WORDS)), lambda: w.__setitem__(p, rng.choice(WORDS))])()
            rows.append((10 * i + k, " ".join(w).upper() if k == 2 else " ".join(w)))
    rows += [(9001, " ".join(WORDS[:40])), (9002, " ".join(WORDS[:40]).title()), (9003, " ".join(WORDS[:39])), (9004, "short text"), (9005, None), (9006, "")]
    rows += [(9010, "; ".join(f"{a}: {b}" for a, b in zip(WORDS[50:70], WORDS[70:90]))), (9011, "; ".join(f"{a}: {b}" for a, b in reversed(list(zip(WORDS[50:70], WORDS[70:90])))))]
    rows += [(9020, " ".join(WORDS[:60]) + " " + " ".join(WORDS * 40))]  # a very long text
    return rows + rows[:10]


def truth(rows, n, similarity, least):
    docs = {i: py_terms(b) for i, b in rows}
    runs = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, w in docs.items() if len(w) >= max(least, n)}
    keys = {i: formatting.py_keys(b, True) for i, b in rows if py_terms(b)}
    found = set()
    for a, b in itertools.combinations(sorted(runs), 2):
        if docs[a] != docs[b] and not (keys[a][1] and keys[a][1] == keys[b][1]) and len(runs[a] & runs[b]) >= similarity * len(runs[a] | runs[b]) - 1e-12:
            found.add((a, b))
    return found


@pytest.mark.parametrize(("n", "similarity", "least"), [(3, 0.6, 30), (5, 0.8, 5)])
def test_near_duplicates(spark, n, similarity, least):
    rows = corpus()
    want = truth(rows, n, similarity, least)
    got = {(r.left_id, r.right_id) for r in nearduplicates.near_pairs(deliveries(spark, rows), n=n, similarity=similarity, min_words=least).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 20
    groups = {r.doc_id: r for r in nearduplicates.near_groups(deliveries(spark, rows), n=n, similarity=similarity, min_words=least).collect()}
    assert all(groups[a].group_id == groups[b].group_id for a, b in got) and groups[9001].group_id == groups[9002].group_id
    assert groups[9001].links == groups[9002].links and (9001, 9003) in got and groups[9003].links == 1


def test_near_duplicates_of_nothing(spark):
    assert nearduplicates.near_pairs(deliveries(spark, corpus()).limit(0)).count() == 0


def test_blocks_of_a_hot_run():
    import pyarrow as pa

    key = np.repeat([1, 2, 3], [1, 1300, 2])
    tid = np.concatenate([[5], np.arange(1300), [7, 7]])
    flip = np.zeros(len(key), bool)
    flip[700:1301] = True
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 300]) for x in (key, flip, tid)], ["key", "flipped", "tid"]) for i in range(0, len(key), 300)]
    out = [(a, b) for r in nearduplicates._meet(iter(batches)) for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist())]
    assert max(len(x) for p in out for x in p) <= 512
    met = {(x, y) for a, b in out for x in a for y in b}
    exact = {t for k, f, t in zip(key, flip, tid) if k == 2 and not f}
    assert met == {(x, y) for x in exact for y in range(1300)}


def vectors_table(spark, n=700, dim=96):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, dim))
    x = centres[rng.integers(0, 60, n)] + 0.3 * rng.normal(size=(n, dim))
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(1000 + i, rows[3][1]) for i in range(9)] + [(2000, [2 * v for v in rows[3][1]]), rows[5], (3000, None), (3001, []), (3002, [0.0] * dim), (3003, [1.0] * 5), (3004, [float("nan")] * dim), (None, rows[1][1])]
    return rows, spark.createDataFrame(rows, "doc_id long, embedding array<float>").withColumn("cell", F.lit("clash"))


def test_neighbours(spark):
    rows, df = vectors_table(spark)
    good = {i: np.array(np.float32(v), float) for i, v in rows if i is not None and v and len(v) == 96 and any(v) and not np.isnan(v).any()}
    ids = np.array(sorted(good))
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    c = np.round(x @ x.T, 12)
    np.fill_diagonal(c, -9)
    want = {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.lexsort((ids, -c[i]))[:5]}
    got = neighbours.most_similar(df).collect()
    pairs = {(r.doc_id, r.neighbour_id) for r in got}
    assert len(pairs) == len(got) == 5 * len(ids) and len(pairs & want) >= 0.98 * len(want)
    copies = {i for i in good if i == 3 or 1000 <= i < 2000}
    assert {p for p in pairs if p[0] in copies and p[0] != 3} <= {(a, b) for a in copies for b in [3, 1000, 1001, 1002, 1003, 1004, 1005]}
    few = neighbours.most_similar(df.where("doc_id in (1, 2, 3)"))
    assert few.count() == 6 and neighbours.most_similar(df.limit(0)).count() == 0


def test_traversal_order():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random(7), rng.random(5)
    counts = rng.integers(0, 3, 35)
    order = sorted((d1[i] + d2[j], i * 5 + j) for i in range(7) for j in range(5))
    assert neighbours.traverse(d1, d2, counts, 10**6) == [c for _, c in order if counts[c]]


def scattered(step):
    """Pairs with changed words spread over the whole text, near the least similarity."""
    rng = random.Random(9)
    rows = []
    for i in range(150):
        base = [f"v{rng.randrange(300)}" for _ in range(rng.randint(110, 160))]
        edited = list(base)
        for p in range(rng.randrange(9), len(base), step):
            edited[p] = f"v{rng.randrange(300)}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited))]
    return rows


@pytest.mark.parametrize(("n", "step"), [(3, 12), (2, 8)])
def test_near_duplicates_are_all_found(spark, n, step):
    rows = scattered(step)
    want = truth(rows, n, 0.6, 30)
    options = {"n": n, "similarity": 0.6, "min_words": 30}
    found = lambda **more: [(r.left_id, r.right_id) for r in nearduplicates.near_pairs(deliveries(spark, rows), **options, **more).collect()]
    assert len(want) > 50 and sorted(found()) == sorted(want)
    assert len(found(segments=6)) < len(want)


@pytest.mark.parametrize(("n", "similarity", "least"), [(3, 0.6, 30), (5, 0.8, 5), (1, 0.3, 1)])
def test_near_duplicates_equal_brute_force(spark, n, similarity, least):
    rows = corpus()
    got = {(r.left_id, r.right_id) for r in nearduplicates.near_pairs(deliveries(spark, rows), n=n, similarity=similarity, min_words=least).collect()}
    assert got == truth(rows, n, similarity, least)


def test_near_duplicates_with_hot_runs_and_copies(spark, monkeypatch):
    """Runs split into pairs of blocks, and much copied texts reduced before the shuffle, lose and add nothing."""
    rng = random.Random(12)
    shared = [f"s{i}" for i in range(40)]
    rows = [(i, " ".join(shared + [f"v{rng.randrange(500)}" for _ in range(rng.randint(2, 12))])) for i in range(120)]
    rows += [(1000 + i, rows[0][1].upper() if i % 2 else rows[0][1]) for i in range(60)] + [(0, rows[0][1])] * 5
    docs = deliveries(spark, rows)
    options = {"n": 3, "similarity": 0.7, "min_words": 30}
    want = truth(rows, **{"n": 3, "similarity": 0.7, "least": 30})
    for hot, copies in ((10, 8), (3, 2), (10**9, 10**9)):
        monkeypatch.setattr(nearduplicates, "HOT_RUN", hot)
        monkeypatch.setattr(nearduplicates, "MANY_COPIES", copies)
        near = nearduplicates.near_pairs(docs, **options).collect()
        assert len(near) == len(want) > 1000 and {(r.left_id, r.right_id) for r in near} == want
    first = nearduplicates._first_pass(docs, "doc_id", "body", "loaded_at", 30, 0)
    monkeypatch.setattr(nearduplicates, "MANY_COPIES", 8)
    copied = nearduplicates._copied(first)
    freq = nearduplicates.word_frequencies(docs, "body", 30)
    keys = nearduplicates._prefix_rows(docs.coalesce(1), "doc_id", "body", freq, len(rows), 30, 3, 0.7, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0, copied)
    assert copied.keys() == {nearduplicates.text_id(py_terms(rows[0][1]))} and keys.groupBy("tid", "key").count().where("count > 1").isEmpty()


def test_texts_with_one_hash(spark, monkeypatch):
    """Should two texts share a hash, another seed parts them."""
    real = nearduplicates.text_id
    fake = lambda words, seed=0: 7 if seed == 0 else real(words, seed)
    monkeypatch.setattr(nearduplicates, "text_id", fake)
    rows = [(1, " ".join(WORDS[:50])), (2, " ".join(WORDS[:49])), (3, " ".join(WORDS[100:150])), (2, " ".join(WORDS[200:250]))]
    docs = deliveries(spark, rows[:3])
    assert [(r.left_id, r.right_id) for r in nearduplicates.near_pairs(docs, n=3, similarity=0.6).collect()] == [(1, 2)]


def test_bodies_delivered_at_one_time(spark):
    """Of two bodies of a record at one time one is taken, the same in every step."""
    texts = [(1, " ".join(WORDS[:50]), 5), (1, " ".join(WORDS[50:100]), 5), (2, " ".join(WORDS[:49]), 5), (3, " ".join(WORDS[50:99]), 5)]
    docs = spark.createDataFrame(texts, "doc_id long, body string, loaded_at int")
    found = {(r.left_id, r.right_id) for r in nearduplicates.near_pairs(docs, n=3, similarity=0.6).collect()}
    assert found in ({(1, 2)}, {(1, 3)})
    same = spark.createDataFrame([(1, "a b", 5), (1, "c d", 5), (2, "A b", 5), (3, "C d", 5)], "doc_id long, body string, loaded_at int")
    assert sorted((r.first_id, r.copies) for r in formatting.copy_classes(same).collect()) in ([(1, 2), (1, 2), (3, 1)], [(1, 2), (1, 2), (2, 1)])


def test_neighbours_in_split_cells(spark, monkeypatch):
    """Cells larger than a block and blocks of many queries are split; the rows are the same."""
    rows, df = vectors_table(spark, 400)
    got = []
    for block, queries in ((10**6, 10**6), (20, 30)):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        monkeypatch.setattr(neighbours, "QUERIES", queries)
        monkeypatch.setattr(neighbours, "MOST_CENTROIDS", 2)
        got.append(sorted((r.doc_id, r.neighbour_id, r["rank"]) for r in neighbours.most_similar(df).collect()))
    assert got[0] == got[1] and len(got[0]) > 2000
    assert neighbours.enough_of(500_000) == 10 * neighbours.enough_of(5_000) == 10 * neighbours.CANDIDATES
    double = spark.createDataFrame([(1, [1.0, 1e-9]), (2, [1.0, 0.0]), (3, [1.0, 2e-6]), (4, [1.0, 3e-6])], "doc_id long, embedding array<double>")
    assert [r.neighbour_id for r in neighbours.most_similar(double, dim=2, k=1).orderBy("doc_id").collect()] == [2, 1, 4, 3]


def test_broadcast_and_shuffle_joins_agree(spark, monkeypatch):
    """The bound below which a counted side is broadcast changes the plan, not the rows."""
    from fjordex.llm import common, frequencies, lookalikes

    rows = corpus()
    docs = deliveries(spark, rows).withColumn("meta", F.col("body"))

    def everything():
        near = sorted(tuple(r) for r in nearduplicates.near_groups(docs, n=3, similarity=0.6, min_words=30).collect())
        copies = sorted(tuple(r) for r in formatting.copy_classes(docs).collect())
        terms = sorted(tuple(r) for r in frequencies.count_deliveries(docs).read().drop("bucket").collect())
        forms = sorted(tuple(r) for r in lookalikes.consistent(docs, ["body"]).select("doc_id", "body_skeleton").collect() if r.body_skeleton)
        return near, copies, terms, forms

    first = everything()
    for module in (common, formatting, nearduplicates):
        if hasattr(module, "BROADCAST_ROWS"):
            monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert everything() == first and all(first)
