"""Frequencies, distinctiveness, look-alikes, subjects, abuse, packing and mixing."""

import math
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordex.functions.text import py_terms
from fjordex.llm import abuse, distinctive, frequencies, lookalikes, mixing, packing, subjects

ROOT = Path(__file__).resolve().parents[2]
TEXTS = [(1, "the cat sat, the cat ran"), (2, "The dog ran"), (3, None), (4, "  !! "), (5, "a bird the sang"), (2, "The dog ran"), (1, "the cat sat, the cat ran"), (6, "dog " * 3000), (7, "Straße STRASSE"), (8, "zebra"), (None, "ghost")]


def deliveries(spark, rows=TEXTS):
    data = [(i, b, f"2023-01-{1 + k:02d}", "x") for k, (i, b) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, body string, t string, term string").withColumn("loaded_at", F.col("t").cast("timestamp")).drop("t")


def test_frequencies(spark):
    docs = {i: py_terms(b) for i, b in TEXTS if i is not None and py_terms(b)}
    cf, df = Counter(w for d in docs.values() for w in d), Counter(w for d in docs.values() for w in set(d))
    rows = frequencies.count_deliveries(deliveries(spark)).marked().collect()
    assert {r.term: (r.occurrences, r.records) for r in rows} == {w: (cf[w], df[w]) for w in cf}
    assert {r.term: r.mark for r in rows} == {w: "rare" if df[w] < 3 else "common" if df[w] * 100 > 15 * len(docs) else None for w in df}
    assert frequencies.count_deliveries(deliveries(spark).limit(0)).marked().count() == 0


LOADS = [
    [(1, "a b b"), (2, "b c"), (3, "c"), (7, None), (None, "ghost")],
    [(1, "a b d"), (2, "b c"), (3, None), (8, "x " * 500)],
    [(4, "e e"), (4, "e f"), (3, "c c"), (1, "a b d")],
    [(8, "y"), (9, "")],
]


def counted(loads):
    """The terms of the records' last contents."""
    state = {}
    for load in loads:
        state |= {i: b for i, b in load if i is not None}
    docs = [py_terms(b) for b in state.values() if py_terms(b)]
    return {w: (sum(d.count(w) for d in docs), sum(w in d for d in docs)) for w in {w for d in docs for w in d}}


def as_load(spark, n):
    return spark.createDataFrame([(i, b, k, "clash") for k, (i, b) in enumerate(LOADS[n])], "id long, text string, at int, term string")


def test_counts_outlive_their_process(spark, tmp_path):
    """Add, change, delete and replay, each load by a process of its own, equal a count from scratch."""
    path = str(tmp_path / "counts")
    counts = frequencies.TermCounts(spark, path, bucket_terms=1)
    for n in (0, 1):
        assert counts.load(as_load(spark, n), f"load {n}", "id", "text", "at")
        assert {r.term: (r.occurrences, r.records) for r in counts.marked().collect()} == counted(LOADS[: n + 1])
    script = f"""
import sys
sys.path[:0] = {[str(p) for p in (ROOT, ROOT / 'tests' / 'llm')]!r}
from test_texts import as_load, frequencies
from fjordex.session import local_session
spark = local_session("2", shuffle=2, memory="1g")
counts = frequencies.TermCounts(spark, {path!r}, bucket_terms=1)
assert not counts.load(as_load(spark, 1), "load 1", "id", "text", "at")
assert counts.load(as_load(spark, 2), "load 2", "id", "text", "at")
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=300, env={k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK", "SPARK"))})
    assert {r.term: (r.occurrences, r.records) for r in counts.marked().collect()} == counted(LOADS[:2])  # as it was opened
    with pytest.raises(RuntimeError):
        counts.load(as_load(spark, 3), "load 3", "id", "text", "at")
    again = frequencies.TermCounts(spark, path, bucket_terms=1)
    assert {r.term: (r.occurrences, r.records) for r in again.marked().collect()} == counted(LOADS[:3]) and again.state["loads"] == ["load 0", "load 1", "load 2"]
    assert again.load(as_load(spark, 3), "load 3", "id", "text", "at") and not again.load(as_load(spark, 3), "load 3", "id", "text", "at")
    again.vacuum()
    last = frequencies.TermCounts(spark, path, bucket_terms=1)
    assert {r.term: (r.occurrences, r.records) for r in last.marked().collect()} == counted(LOADS) and last.state["buckets"] >= 2
    assert len({*last.state["at"].values()}) > 1  # a load rewrites the buckets that it touches only


@pytest.mark.parametrize("frequent", [20_000, 2])
@pytest.mark.parametrize("by", ["weight", "z"])
def test_distinctive(spark, monkeypatch, frequent, by):
    monkeypatch.setattr(distinctive, "FREQUENT", frequent)
    docs = {i: py_terms(b) for i, b in TEXTS if i is not None and py_terms(b)}
    cf, df = Counter(w for d in docs.values() for w in d), Counter(w for d in docs.values() for w in set(d))
    n, total = len(docs), sum(cf.values())
    want = set()
    for i, d in docs.items():
        tf = Counter(d)
        score = {w: (1 + math.log10(tf[w])) * math.log10(n / df[w]) if by == "weight" else distinctive.py_z(tf[w], cf[w], len(d), total) for w in tf if df[w] > 1}
        want |= {(i, w, k + 1) for k, w in enumerate(sorted(score, key=lambda w: (-round(score[w], 9), w))[:3])}
    got = distinctive.distinctive_terms(deliveries(spark), by=by).collect()
    assert {(r.doc_id, r.term, r["rank"]) for r in got} == want
    assert distinctive.distinctive_terms(deliveries(spark).limit(0), by=by).count() == 0


def test_lookalikes(spark):
    heads = spark.createDataFrame([(1, "babul cells"), (2, "têentrum finance"), (3, "fluid-flow"), (4, None), (5, "teentrum finance")], "heading_id long, body string")
    odd = [
        (1, "see bаbul cells, now", "bａbul cells"),
        (2, "see babul cells, now", "babul cells"),
        (3, "têentrum finance", "TÊENTRUM FINANCE"),
        (4, "fluid‑flow; fluid-flow", "fluid‐​flow"),
        (5, "xbаbul cells bаbul cellsy BABUL CELLS", "babul cells "),
        (6, "bаbul cellś", None),
        (7, None, ""),
        (8, "​ " * 3000 + "ﬂuid-flow", "babul  cells"),
        (1, "see bаbul cells, now", "bａbul cells"),
    ]
    docs = spark.createDataFrame([(i, b, m, k) for k, (i, b, m) in enumerate(odd)], "doc_id long, body string, meta string, loaded_at int").withColumn("heading_id", F.lit("clash"))
    got = lookalikes.disguised(docs, heads, {"body": "part", "meta": "whole"})
    assert sorted((r.field_name, r.doc_id, r.heading_id) for r in got.collect()) == [("body", 1, 1), ("body", 3, 2), ("body", 4, 3), ("body", 8, 3), ("meta", 1, 1), ("meta", 4, 3)]
    assert lookalikes.disguised(docs, heads.limit(0), {"body": "part"}).count() == 0 and lookalikes.disguised(docs.limit(0), heads, {"body": "part"}).count() == 0
    same = {r.doc_id: r for r in lookalikes.consistent(docs, ["body", "meta"]).collect()}
    assert same[1].body == "see babul cells, now" and same[1].meta == "babul cells" and same[7].body is None and len(same) == 8
    assert lookalikes.canonical("мост сосna") == "мост cocna" and lookalikes.canonical(None) is None
    for text in ("bаbul ce​lls", "ﬂuid‑flow", "tê"):
        assert lookalikes.skeleton(lookalikes.skeleton(text)) == lookalikes.skeleton(text) == lookalikes.skeleton(lookalikes.canonical(text))


def test_same_looking(spark, monkeypatch):
    from fjordex.llm import common

    rows = [(1, "bаbul"), (2, "babul"), (3, "babul"), (4, "Babul"), (5, None), (6, " "), (7, "Ill"), (8, "1ll"), (9, "corn"), (10, "com"), (2, "babul")] + [(100 + i, "ｈot" if i % 2 else "hot") for i in range(30)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, meta string, loaded_at int").withColumn("s", F.lit("clash"))
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    got = {r.doc_id: (r.first_id, r.records, r.forms) for r in lookalikes.same_looking(docs, ["meta"]).collect()}
    assert got == {1: (1, 3, 2), 2: (1, 3, 2), 3: (1, 3, 2)} | {100 + i: (100, 30, 2) for i in range(30)}
    more = {r.doc_id: r.first_id for r in lookalikes.same_looking(docs, ["meta", "s"], ascii_too=True).collect()}
    assert {i: more[i] for i in (7, 8, 9, 10)} == {7: 7, 8: 7, 9: 9, 10: 9} and lookalikes.same_looking(docs.limit(0), ["meta"]).count() == 0


def test_lookalikes_of_a_large_dictionary(spark, monkeypatch):
    heads = spark.createDataFrame([(i, f"word{'abcdefgh'[i]}") for i in range(8)], "heading_id long, body string")
    docs = spark.createDataFrame([(i, f"see wоrd{'abcdefgh'[i]}", 1) for i in range(8)], "doc_id long, body string, loaded_at int")
    monkeypatch.setattr(lookalikes, "MOST_ENTRIES", 3)
    assert sorted((r.doc_id, r.heading_id) for r in lookalikes.disguised(docs, heads, {"body": "part"}).collect()) == [(i, i) for i in range(8)]


def subject_corpus(spark):
    rng = np.random.default_rng(5)
    nouns = {a: [f"{a}{x}" for x in "bcdfghjklm"] for a in ("law", "sport", "music")}
    frames = ["yesterday the {} was seen near the {} again", "critics of the {} point at the {} today", "nobody could move the {} without a {}"]

    def sentence(a):
        return rng.choice(frames).format(*rng.choice(nouns[a], 2)).capitalize() + "."

    rows, labels = [], []
    for i in range(240):
        of = list(rng.choice(list(nouns), rng.integers(1, 3), replace=False))
        body = [sentence(a) for a in of for _ in range(3)] + ["Update: the text was corrected."]
        rng.shuffle(body)
        rows.append((i, " ".join(body), "en", i))
        labels += [(i, a) for a in of]
    rows += [(900, None, None, 1), (901, "", "xx", 1), (902, "Update: the text was corrected.", "en", 1), (903, "x" * 50_000, "en", 1), (0, rows[0][1], "en", 999)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, lang string, loaded_at long").withColumn("areas", F.lit(1))
    return docs, labels, spark.createDataFrame([(a, a) for a in nouns], "area string, label string")


def test_subjects(spark):
    docs, labels, areas = subject_corpus(spark)
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(1, None), (3, "nonsense"), labels[0][:1] + ("law",)], "doc_id long, area string")
    tokens = subjects.tokenised(docs)
    model, records = subjects.fit(tokens, known, areas)
    got = {(r.doc_id, r.area) for r in subjects.subjects(records, model).collect()}
    held = {x for x in labels if x[0] % 2 == 0}
    mine = {x for x in got if x[0] % 2 == 0 and x[0] < 900}
    assert len(mine & held) / len(mine | held) > 0.97 and not [x for x in got if x[0] in (900, 901, 902)] and records.count() == 242
    none, records = subjects.fit(tokens, known.limit(0), areas)
    assert subjects.subjects(records, none).count() == 0
    empty = subjects.tokenised(docs.limit(0))
    nothing, records = subjects.fit(empty, known, areas)
    assert subjects.subjects(records, nothing).count() == 0


def test_subjects_learn_from_all_records_whatever_the_labels(spark):
    """A word that only unlabelled records hold is learned from them, and the background is that of all bodies."""
    docs, labels, areas = subject_corpus(spark)
    body = F.when((F.col("doc_id") % 2 == 0) & (F.col("doc_id") < 900) & F.col("body").contains("law"), F.concat("body", F.lit(" Lawb zymurgy lawc lawd."))).otherwise(F.col("body"))
    docs = docs.withColumn("body", body)
    known = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, area string")
    tokens = subjects.tokenised(docs)
    for bound in (60, 10_000):
        model, _ = subjects.fit(tokens, known, areas, max_sample=bound)
        learned = dict(zip(("law", "music", "sport"), model.one[model.vocabulary["zymurgy"]]))
        assert learned["law"] >= 0 > max(learned["music"], learned["sport"])



def test_background_and_shares_equal_brute_force(spark):
    docs, labels, areas = subject_corpus(spark)
    names = ["law", "music", "sport"]
    lines = [r.line for r in subjects.tokenised(docs).where("line is not null and doc_id < 40").orderBy("doc_id").collect()]
    given = [{names.index(a) for i, a in labels if i == d} for d in range(40)]
    sample = subjects.Sample(lines, ["en"] * 40, given, names, ["zz", "again"])
    tokens = subjects.tokenised(docs.repartition(5))
    records = subjects.numbered(tokens, sample)
    back = subjects.background(records, sample)
    texts = [r.line for r in tokens.where("line is not null and lang = 'en'").collect()]
    words = Counter(w for x in texts for s in x.split("\n") for w in s.split(" "))
    pairs = Counter(p for x in texts for s in x.split("\n") for p in zip(["", *s.split(" ")], s.split(" ")))
    assert back.total[0] == sum(words.values()) and all(back.one[0, k] == words[w] for w, k in sample.vocabulary.items() if w)
    named = list(sample.vocabulary)
    assert all(back.two[0, i] == pairs[named[key // len(named)], named[key % len(named)]] for i, key in enumerate(sample.bigrams.tolist()))
    counts, threshold, margin = subjects.calibrate(sample, back)
    model = subjects.train(sample, back, np.arange(40), counts)
    model.threshold, model.margin = threshold, margin
    got = subjects.learned(records, sample, model, list(range(40)))
    want = np.zeros_like(got)
    for r in records.where("doc_id >= 40 and lang = 0").collect():
        word, sizes = np.array(r.word), np.array(r.sizes)
        scores = model.score(word, sizes)
        possible = np.zeros(scores.shape)
        for a in model.accept(scores):
            possible[:, a] = 1
        share = np.rint(subjects.responsibilities(scores * (sizes + subjects.NEUTRAL)[:, None], possible) * subjects._UNIT) / subjects._UNIT
        for i, ids in enumerate(np.split(word, np.cumsum(sizes)[:-1])):
            for w in ids[ids >= 0]:
                want[0, :, w] += share[i]
    assert np.allclose(got, want) and want.sum() > 100
    scores, per = np.random.default_rng(1).random((400, 3)) * 2, np.random.default_rng(2).integers(1, 6, 400)
    per = per[np.cumsum(per) <= 400]
    scores, one_by_one = scores[: per.sum()], []
    model.threshold, model.margin = np.array([1.2, 1.5, 1.1]), 0.2
    for i, x in enumerate(np.split(scores, np.cumsum(per)[:-1])):
        one_by_one += [(i, a) for a in sorted(model.accept(x))]
    assert list(zip(*(x.tolist() for x in model.accepted(scores, per)))) == one_by_one and len(one_by_one) > 100
    assert subjects.sentences("One. Two 3rd!  4 five?\n\nSix") == "one\ntwo #\n# five\nsix" and subjects.sentences("a: 1; b: c. d") == "a # b c d" and subjects.sentences(" ... ") == subjects.sentences(None) == ""
    # per token: a sentence of the same words twice as long has almost the same score, and unknown words dilute it
    k = sample.vocabulary["lawb"]
    one, two, less = (model.score(np.array(x), np.array([len(x)]))[0] for x in ([k] * 40, [k] * 80, [k] * 40 + [-1] * 40))
    assert abs(two[0] / one[0] - 1) < 0.06 and less[0] < 0.6 * one[0]


def test_abuse(spark):
    rng = np.random.default_rng(6)
    bad = {"abusive": ["you are a complete {}", "shut up you {} nobody wants you", "go away {} you make me sick"], "hateful": ["all {} are vermin and must leave", "never trust the {} they are thieves"], "sexual": ["send me your {} pictures tonight", "free {} videos here click now"]}
    fill = {"abusive": ["moron", "idiot", "loser", "scumbag"], "hateful": ["korrins", "jhelan", "ostrans"], "sexual": ["nude", "naked", "dirty"]}
    topics = ["index", "query", "ranker", "trie", "table"]
    rows, labels = [], []
    for i in range(420):
        text = [f"The {rng.choice(topics)} is smaller than the {rng.choice(topics)} when the {rng.choice(topics)} grows." for _ in range(4)]
        kind = [None, None, "abusive", "hateful", "sexual"][i % 5]
        if kind:
            s = rng.choice(bad[kind]).format(rng.choice(fill[kind]))
            s = [s, s.upper(), s.replace("o", "0").replace("i", "1"), s.replace("e", "е")][rng.integers(0, 4)]
            text[rng.integers(0, 4)] = s + "!"
        rows.append((i, " ".join(text), "en", "forum", i))
        labels.append((i, kind or "none"))
    extra = [(900, None, None, None, 1), (901, " ", "xx", "a", 1), (902, "index " * 20_000, "en", "b", 1)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, stored_at long").withColumn("kind", F.lit("clash"))
    model = abuse.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 2] + labels[1:2] + [(3, None)], "doc_id long, kind string"))
    out = {r.doc_id: r for r in abuse.scored(docs, model).collect()}
    assert len(out) == 423 and not any(out[i][k] for i in (900, 901, 902) for k in abuse.KINDS) and out[900].abusive_score == 0
    truth = {(i, k) for i, k in labels if i % 2 == 0 and k != "none"}
    got = {(i, k) for i in range(0, 420, 2) for k in abuse.KINDS if out[i][k]}
    assert len(got & truth) / len(got | truth) > 0.9
    assert abuse.segments(None) == [] and sum(len(s) for s in abuse.segments("a b. " * 3)) == 6
    assert abuse.word_form("4sshol3") == "asshole" and abuse.plain("s a y x") == "sayx" and abuse.word_form("jussst") == "just" and abuse.word_form("42") == "#"
    assert abuse.scored(docs.limit(0), model).count() == 0


def test_few_labels_flag_few_documents():
    rng = np.random.default_rng(3)
    for n in (12, 60, 900):
        held = rng.random((n, 3)) ** 6
        truth = np.zeros((n, 3), bool)
        truth[:3, 0] = truth[3:6, 1] = truth[6:8, 2] = True
        clean = held[~truth.any(1)]
        for t in abuse.calibrate(held, truth, ["en"] * n).values():
            assert t >= abuse.LEAST_THRESHOLD and (clean > t).mean() <= 0.02
    assert set(abuse.calibrate(held, np.zeros((n, 3), bool), ["en"] * n).values()) == {0.5} and set(abuse.calibrate(held[:0], truth[:0], []).values()) == {0.5}
    held[truth] = 0.9
    assert all(t < 0.9 for t in abuse.calibrate(held, truth, ["en"] * n).values())


def test_chunks_and_maxima(monkeypatch):
    rng = np.random.default_rng(4)
    r = rng.integers(0, 5, (200, 6)).astype(np.float32)
    starts = np.cumsum(rng.integers(1, 9, 30)) - 1
    sizes = rng.integers(1, 12, 30)
    top, at = abuse.maxima(r, starts, sizes, True)
    assert all((top[i] == r[s : s + n].max(0)).all() and (at[i] == s + r[s : s + n].argmax(0)).all() for i, (s, n) in enumerate(zip(starts, sizes)))
    net = abuse._train([["a", "b"], ["c"]], np.array([0, 1]), np.array([[True, False, False], [False, False, False]]))
    texts = ["a b c. " * 700, None, "", "b! c? a…", "x" * 9000, " ".join(f"w{i}" for i in range(5000))]
    whole = abuse.document_scores(texts, net, abuse.Vectors(net["table"]))
    monkeypatch.setattr(abuse, "CHUNK", 50)
    assert np.allclose(whole, abuse.document_scores(texts, net, abuse.Vectors(net["table"], bound=100)), atol=1e-5) and not whole[1:3].any()
    forms = abuse.Vectors(net["table"])
    for t in [*texts[::3], "a.b c' d.' e\nf ?! g \"h.\" i", "q " * 41 + ". r", "... ! -"]:
        tokens = [*abuse.plain(t).split(), abuse._MARK]
        rows, sizes, doc = forms.segments(tokens, np.zeros(len(tokens), np.int64))
        names = {k: w for w, k in forms.forms.items()}
        assert [[names[k] for k in x] for x in np.split(rows, np.cumsum(sizes)[:-1]) if len(x)] == abuse.segments(t) and len(doc) == len(sizes)
    assert abuse.segments("one two.' three, four\nfive? (six) s e v e n") == [["one", "two"], ["three", "four"], ["five"], ["six", "seven"]]


def test_cnn_gradient():
    """Maxima and padding: a segment's score does not depend on its neighbours."""
    rng = np.random.default_rng(0)
    net = abuse._train([["a", "b"], ["c"]], np.array([0, 1]), np.array([[True, False, False], [False, False, False]]))
    x = rng.normal(size=(9, abuse.DIM)).astype(np.float32)
    whole = abuse.forward(x, np.array([4, 5]), net)[0]
    assert np.allclose(whole[0], abuse.forward(x[:4], np.array([4]), net)[0][0], atol=1e-5) and np.allclose(whole[1], abuse.forward(x[4:], np.array([5]), net)[0][0], atol=1e-5)


def test_packing(spark):
    rng = np.random.default_rng(3)
    sizes = [(i, int(n)) for i, n in enumerate(rng.integers(1, 300, 500))] + [(900, 1000), (901, 512), (902, 0), (903, 1537), (904, 1024), (5, 77)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    packs = spark.createDataFrame([("small", 512), ("none", None), ("zero", 0), ("big", 4096)], "pack_name string, capacity_tokens int")
    rows = packing.pack(df, packs).toPandas()
    tight = packing.pack(df, packs, tokens_each=128, attention=0.4).toPandas()
    for name, cap in (("small", 512), ("big", 4096)):
        for r, least in ((rows, 0.95), (tight, 0.4)):
            r = r[r.pack_name == name]
            per = r.groupby("container").tokens.agg(["sum", "count"])
            cost = (r.tokens.astype(float) ** 2).groupby(r.container).sum()
            assert per["sum"].max() <= cap and r.tokens.sum() == sum(n for _, n in sizes) and per["sum"].sum() / (len(per) * cap) > least
            if least < 0.5:
                assert per["count"].max() <= cap // 128 and cost[per["count"] > 1].max() <= 0.4 * cap * cap
            whole = r.groupby("doc_id").size()
            assert all(whole[i] == 1 for i, n in sizes if 0 < n <= cap and i != 5) and 902 not in whole.index
    parts = rows[(rows.pack_name == "small") & (rows.doc_id == 903)].sort_values("part")
    assert list(parts.first_token) == [0, 512, 1024, 1536] and list(parts.tokens) == [512, 512, 512, 1]
    assert packing.pack(df.limit(0), packs).count() == 0
    for rule in ("norm", "dot"):
        bins = packing.best_fit(np.array([300, 200, 212, 312]), 512, 2, rule)
        assert len(set(bins)) == 2 and bins[0] == bins[2] and bins[1] == bins[3]
        # by tokens and documents both fit in one; their attention cost does not
        assert list(packing.best_fit(np.array([300, 200]), 512, None, rule)) == [0, 0] and list(packing.best_fit(np.array([300, 200]), 512, None, rule, attention=0.45)) == [0, 1]
        assert len(set(packing.best_fit(np.array([500, 100, 90]), 512, None, rule, attention=0.3))) == 2  # the first has a bin alone
    names = packing.pack(df, packs.where("pack_name = 'small'")).orderBy("doc_id", "part", "container").collect()
    assert names == packing.pack(df.repartition(7), packs.where("pack_name = 'small'")).orderBy("doc_id", "part", "container").collect()


def test_token_counts(spark):
    texts = ["", None, "Hello world", "å" * 30, " \n\t ", "word " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit(7))
    enc = packing.encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary("Dette  er\nprøve <|endoftext|>")) == "Dette  er\nprøve <|endoftext|>"


def test_mixing(spark):
    rng = np.random.default_rng(8)
    rows = [(i, ["a", "b", "c", None, "other"][i % 5], int(n)) for i, n in enumerate(rng.integers(1, 60, 4000))] + [(9000, "a", 0), (None, "a", 5)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 3), ("c", 0.3, 4), ("d", None, 1)], "source string, target_share double, max_repeats int")
    copies, shares = mixing.plan(sizes, targets)
    got = {r.source: r for r in shares.collect()}
    assert all(abs(got[s].actual_share - t) < 0.003 for s, t in (("a", 0.5), ("b", 0.2), ("c", 0.3))) and got["a"].most_copies <= 1 and got["c"].most_copies <= 4
    assert got[None].actual_share == 0 and got["other"].copies == 0
    mix = mixing.mixture(copies).toPandas()
    assert (mix.groupby("doc_id").size() == mix.groupby("doc_id")["copy"].max()).all() and mix.shuffle_key.is_monotonic_increasing
    assert abs(np.corrcoef(np.arange(len(mix)), mix.doc_id)[0, 1]) < 0.1
    again = mixing.plan(sizes, targets)[0]
    assert again.exceptAll(copies).count() == 0
    nothing, none = mixing.plan(sizes.limit(0), targets)
    assert mixing.mixture(nothing).count() == 0 and {r.source: r.actual_share for r in none.collect()} == {"a": 0.0, "b": 0.0, "c": 0.0}
    u = (np.arange(1, 2000) - 0.5) / 2000
    u[:2] = 0.5 / (1 << 52), 1e-9
    for k in (1, 2, 4, 40, 41, 100, 400):
        rate = mixing.least_rate(u, k)
        assert np.allclose(mixing.log_fewer(rate, k), np.log(u), atol=1e-6) and (np.diff(rate[2:]) < 0).all() and rate.max() < mixing.top_rate(k)
    rates = mixing.least_rate(np.array([0.1, 0.5, 0.9]), 100)
    assert rates[0] > rates[1] > rates[2] and abs(rates[1] - 99.67) < 0.01
