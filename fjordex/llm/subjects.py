"""Subject areas of each record: interpolated n-gram language models against background models.

For each area the probability of a word, and of a word after its predecessor,
is compared with that of the background models, one for each language, which are
counted over all bodies. The score of a sentence for an area is the difference
of the two cross-entropies per token. Bigrams are interpolated with unigrams, unigrams
with the background, by pseudo-counts; small differences, such as those of
function words, count as none, great negative ones are cut, and a sentence counts as a few neutral tokens
longer than it is. Which sentence of a training record is about which of its
areas is found by expectation maximisation. A score is accepted by a threshold of its area,
calibrated on held-out records. The models of the labelled records then label all others, and
what those say about the words of the collection, new ones included, is counted into the final models.

Bodies are split into terms once, and into numbers of the vocabulary once; the
later passes read those.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordex.functions.text import py_terms
from fjordex.llm.common import latest_rows, py_items, py_nfkc
from fjordex.session import written

# At most so many labelled records train the models (a bounded sample, chosen by the hash of the id).
MAX_SAMPLE = 10_000
# The vocabulary has the words of those records and so many of the collection's most frequent ones: a fixed bound of what is broadcast.
FREQUENT = 1 << 16
UNIGRAM_COUNTS, BIGRAM_COUNTS = (0.5, 2.0), 20.0  # the better of the two on held-out records
# Ratios are at most the number of areas; smaller logarithms than this share of it count as none.
DEAD_SHARE = 0.385
LEAST_RATIO = -0.5
NEUTRAL = 4  # tokens without any evidence that every sentence is thought to have besides its own
# An area's words count at most so many times more in a language of which it has few.
MAX_BALANCE = 16.0
ROUNDS = 5
THRESHOLDS, MARGINS = (0.02, 0.03, 0.04, 0.05, 0.065, 0.08, 0.1), (0.5, 1.0, 2.0)  # shares of the log of the number of areas; multiples of the threshold
FACTORS, MIN_CASES = (0.7, 0.85, 1.0, 1.2, 1.5), 30  # of an area's own threshold, tried if so many held-out records have the area
_UNIT = 1 << 10  # shares of the collection's words are summed in whole parts, so that every order of summing agrees
# ends of sentences and lines; it begins with a set of characters, so that the search skips to them
_CUT = re.compile(r"[.!?…\n\r](?:(?<=[\n\r])|[\"”»')]*(?=\s))")
_BREAK = "zqsentencebreakqz"
_DIGITS = frozenset(c for c in map(chr, range(0x110000)) if c.isdigit())


def sentences(body: str | None) -> str:
    """Terms with spaces between them and a line break between sentences; a list of items is one sentence; numbers are one word."""
    if not body:
        return ""
    text = py_nfkc(body)
    items = py_items(text) if ":" in text or "=" in text else None
    whole = items and len(items) > 1
    line = " ".join(["#" if w[0] in _DIGITS else w for w in py_terms(text if whole else _CUT.sub(f" {_BREAK} ", text))])
    return line if whole else "\n".join(filter(None, map(str.strip, f" {line}".split(f" {_BREAK}"))))


def tongue(lang: str | None) -> str:
    return (lang or "").lower()[:2]


def tokenised(docs: DataFrame, id_col: str = "doc_id", body: str = "body", order: str = "loaded_at", lang: str = "lang") -> DataFrame:
    """Written table: (doc_id, lang, line) of the last delivery of each record with words, and (word, n), combined in the same pass.

    A line has the terms with spaces between them and a line break behind each sentence but the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            words = list(count.items()) if not rows else []
            k, m = len(rows), len(words)
            if words:
                count.clear()
            cols = [pa.array([r[i] for r in rows] + [None] * m, t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            cols += [pa.array([None] * k + [w[i] for w in words], t) for i, t in enumerate((pa.string(), pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "line", "word", "n"])

        for b in batches:
            rows = []
            for doc, text, of in zip(*(b.column(i).to_pylist() for i in range(3))):
                line = sentences(text)
                if line:
                    count.update(line.split())
                    rows.append((doc, tongue(of), line))
            if rows:
                yield out(rows)
            if len(count) > 200_000:
                yield out([])
        yield out([])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(body).alias("body"), F.col(lang).alias("lang"), F.col(order).alias("at"))
    rows = latest_rows(rows, "doc_id", "at", "body", "lang").select("doc_id", "body", "lang").where("body is not null")
    return written(rows.mapInArrow(run, "doc_id long, lang string, line string, word string, n long"), "tokenised")


class Models:
    """Log ratios of words and bigrams for each area; numpy arrays of bounded size."""

    def __init__(self, areas: list[str], vocabulary: dict[str, int], bigrams: np.ndarray, one: np.ndarray, two: np.ndarray, threshold: np.ndarray | None = None, margin: float = 1.0):
        self.areas, self.vocabulary, self.bigrams, self.one, self.two, self.margin = areas, vocabulary, bigrams, one, two, margin
        self.threshold = np.full(len(areas), np.inf) if threshold is None else threshold  # infinite: nothing is accepted

    def parts(self) -> tuple:
        """What scoring needs, without the words themselves."""
        return self.areas, {}, self.bigrams, self.one, self.two, self.threshold, self.margin

    def score(self, word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Difference of the cross-entropies per token of every sentence for every area, given its words' numbers (-1: unknown)."""
        if not len(sizes):
            return np.zeros((0, len(self.areas)), np.float32)
        firsts = np.cumsum(sizes) - sizes
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[firsts] = 0
        n = len(self.one)
        key = np.where((word < 0) | (before < 0), -1, before * n + word)
        at = np.searchsorted(self.bigrams, key).clip(0, max(len(self.bigrams) - 1, 0))
        hit = self.bigrams[at] == key if len(self.bigrams) else np.zeros(len(key), bool)
        ratio = np.where((word >= 0)[:, None], self.one[word], 0)
        ratio[hit] = self.two[at[hit]]
        return np.add.reduceat(ratio, firsts, axis=0) / (sizes + NEUTRAL)[:, None]

    def accept(self, scores: np.ndarray, threshold: np.ndarray | None = None, margin: float | None = None) -> set[int]:
        """Areas of one record: sentences are taken by how clear they are; one that fits an accepted area almost as well adds none."""
        scores = scores / (self.threshold if threshold is None else threshold)
        margin = self.margin if margin is None else margin
        top = scores.max(axis=1)
        rows = np.flatnonzero(top >= 1)
        if not len(rows):
            return set()
        scores, top = scores[rows], top[rows]
        best = scores.argmax(axis=1)
        if (best == best[0]).all():
            return {int(best[0])}
        second = np.partition(scores, -2, axis=1)[:, -2]
        near = (scores >= (top - margin)[:, None]) & (scores >= 1)
        got: set[int] = set()
        for k in np.argsort(second - top, kind="stable"):
            if not any(near[k, a] for a in got):
                got.add(int(best[k]))
        return got


    def accepted(self, scores: np.ndarray, per: np.ndarray, threshold: np.ndarray | None = None, margin: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(record, area) of records with ``per`` sentences each, as ``accept`` says; only those that several areas lay claim to are looked at one by one."""
        limit = self.threshold if threshold is None else threshold
        of = np.repeat(np.arange(len(per)), per)
        relative = scores / limit
        rows = np.flatnonzero(relative.max(axis=1) >= 1) if len(relative) else np.zeros(0, np.int64)
        if not len(rows):
            return rows, rows
        doc, best = of[rows], relative[rows].argmax(axis=1)
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[starts, len(doc)])
        one = np.minimum.reduceat(best, starts) == np.maximum.reduceat(best, starts)
        docs, areas = doc[starts[one]], best[starts[one]]
        # the rest in the order of accept(); an accepted area is a bit, and so is one that fits a sentence almost as well
        many = np.flatnonzero(np.repeat(~one, size))
        if len(many):
            x, margin = relative[rows[many]], self.margin if margin is None else margin
            top, second = x.max(axis=1), np.partition(x, -2, axis=1)[:, -2]
            bits = np.array([1 << a for a in range(x.shape[1])], np.int64 if x.shape[1] < 63 else object)
            near = ((x >= (top - margin)[:, None]) & (x >= 1)) @ bits
            order = np.lexsort((second - top, doc[many]))
            more: list[tuple[int, int]] = []
            last, got = -1, 0
            for d, a, fits in zip(doc[many][order].tolist(), best[many][order].tolist(), near[order].tolist()):
                if d != last:
                    last, got = d, 0
                if not fits & got:
                    got |= 1 << a
                    more.append((d, a))
            found = np.unique(np.array(more), axis=0)
            docs, areas = np.concatenate([docs, found[:, 0]]), np.concatenate([areas, found[:, 1]])
        order = np.lexsort((areas, docs))
        return docs[order], areas[order]


class Sample:
    """The labelled records in numbers."""

    def __init__(self, lines: list[str], langs: list[str], labels: list[set[int]], areas: list[str], more_words: list[str]):
        self.areas, self.labels = areas, labels
        self.vocabulary: dict[str, int] = {"": 0}
        word, sizes, doc = [], [], []
        for i, line in enumerate(lines):
            for s in line.split("\n"):
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in s.split(" ")]
                word += ids
                sizes.append(len(ids))
                doc.append(i)
        for w in more_words:
            self.vocabulary.setdefault(w, len(self.vocabulary))
        self.tongues = {t: i for i, t in enumerate(dict.fromkeys(langs))}
        self.word, self.sizes, self.doc = np.array(word, np.int64), np.array(sizes, np.int64), np.array(doc, np.int64)
        self.lang = np.array([self.tongues[t] for t in langs], np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        before = np.roll(self.word, 1)
        before[first] = 0
        keys = before * len(self.vocabulary) + self.word
        self.bigrams, self.pair = np.unique(keys, return_inverse=True)

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of their words, sentences) of the given records."""
        inside = np.isin(self.doc, docs)
        return np.flatnonzero(np.repeat(inside, self.sizes)), np.flatnonzero(inside)


class Background:
    """Counts over all bodies, by language: of the vocabulary's words, of the sample's bigrams, and of all words."""

    def __init__(self, one: np.ndarray, two: np.ndarray, total: np.ndarray):
        self.one, self.two, self.total = one, two, total


def train(sample: Sample, back: Background, docs: np.ndarray, counts: float, shares: np.ndarray | None = None) -> Models:
    """Models of some of the labelled records; ``shares`` (language, area, word) is what other records say about the words."""
    areas, n, tongues = sample.areas, len(sample.vocabulary), len(sample.tongues)
    places, rows = sample.of(docs)
    if not len(places):
        return Models(areas, sample.vocabulary, np.zeros(0, np.int64), np.zeros((n, len(areas)), np.float32), np.zeros((0, len(areas)), np.float32))
    w, p, size = sample.word[places], sample.pair[places], sample.sizes[rows]
    s, g = np.repeat(np.arange(len(rows)), size), np.repeat(sample.lang[sample.doc[rows]], size)
    starts = np.cumsum(size) - size
    mine = np.array([[a in sample.labels[d] for a in range(len(areas))] for d in sample.doc[rows]], float)
    share = mine / np.maximum(mine.sum(1, keepdims=True), 1)
    own = np.bincount(g, minlength=tongues).astype(float)
    others = np.zeros((tongues, len(areas))) if shares is None else shares.sum(2)
    # the background's counts, as if it were as large as what the areas are trained on
    pool = own + others.sum(1)
    rate = 1 / np.maximum(back.total, 1)
    c1, c2 = (pool * rate) @ back.one, (own * rate) @ back.two
    last = sample.bigrams % n
    zone = DEAD_SHARE * np.log(len(areas))
    one, two = np.zeros((n, len(areas))), np.zeros((len(sample.bigrams), len(areas)))
    # words of the sentences that may be about an area
    claimed = [np.flatnonzero(mine[s, a]) for a in range(len(areas))]
    for _ in range(ROUNDS):
        for a in range(len(areas)):
            at = claimed[a]
            weight, tongue_of = share[s[at], a], g[at]
            part = np.bincount(tongue_of, weight, minlength=tongues)
            balance = np.minimum(pool / np.maximum(part + others[:, a], 1e-9), MAX_BALANCE)
            x = np.bincount(w[at], balance[tongue_of] * weight, minlength=n)
            if shares is not None:
                x += balance @ shares[:, a]
            r1 = (x + counts) / (c1 + counts)
            own_balance = np.minimum(own / np.maximum(part, 1e-9), MAX_BALANCE)
            r2 = (np.bincount(p[at], own_balance[tongue_of] * weight, minlength=len(sample.bigrams)) + BIGRAM_COUNTS * r1[last]) / (c2 + BIGRAM_COUNTS)
            one[:, a], two[:, a] = np.log(r1), np.log(r2)
        one, two = (np.maximum(np.sign(x) * np.maximum(np.abs(x) - zone, 0), LEAST_RATIO) for x in (one, two))
        one[0] = 0
        share = responsibilities(np.add.reduceat(two[p], starts, axis=0), mine)
    return Models(areas, sample.vocabulary, sample.bigrams, one.astype(np.float32), two.astype(np.float32))


def responsibilities(evidence: np.ndarray, possible: np.ndarray) -> np.ndarray:
    """Share of each possible area in each sentence, given the sum of its log ratios; none of them may be what it is about."""
    score = np.where(possible > 0, evidence, -1e9)
    top = np.maximum(score.max(1, keepdims=True), 0)
    e = np.exp(score - top) * (possible > 0)
    return e / (e.sum(1, keepdims=True) + np.exp(-top))


def calibrate(sample: Sample, back: Background, tries: tuple[float, ...] = UNIGRAM_COUNTS, shares: np.ndarray | None = None) -> tuple[float, np.ndarray, float]:
    """(pseudo-count, thresholds of the areas, margin) that do best on held-out halves of the labelled records."""
    k = len(sample.areas)
    unit = float(np.log(max(k, 2)))  # the log ratio of a word of one area only
    every = np.arange(len(sample.labels))
    halves = [(every[every % 2 != h], every[every % 2 == h]) for h in (0, 1)]
    halves = [(a, b) for a, b in halves if len(a) and len(b)]
    if not halves:
        return tries[-1], np.full(k, THRESHOLDS[-1] * unit), MARGINS[-1]

    def held_out(counts: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores, per, labels = [], [], []
        for inside, outside in halves:
            m = train(sample, back, inside, counts, shares)
            places, rows = sample.of(outside)
            scores.append(m.score(sample.word[places], sample.sizes[rows]))
            per.append(np.bincount(sample.doc[rows], minlength=len(every))[outside])
            labels.append(truth[outside])
        return np.concatenate(scores), np.concatenate(per), np.concatenate(labels)

    truth = np.array([[a in of for a in range(k)] for of in sample.labels])

    def f1(held: tuple, threshold: np.ndarray, margin: float) -> float:
        scores, per, want = held
        doc, area = none.accepted(scores, per, threshold, margin)
        return 2 * int(want[doc, area].sum()) / max(len(doc) + int(want.sum()), 1)

    none = Models(sample.areas, {}, np.zeros(0, np.int64), np.zeros((1, k)), np.zeros((0, k)))
    tried = []
    for counts in tries:
        held = held_out(counts)
        tried += [(f1(held, np.full(k, t * unit), m), -i, counts, t * unit, m, held) for i, (t, m) in enumerate((t, m) for t in THRESHOLDS for m in MARGINS)]
    best, _, counts, t, margin, held = max(tried, key=lambda x: x[:2])
    threshold = np.full(k, t)
    for a in range(k):
        if held[2][:, a].sum() >= MIN_CASES:
            for f in FACTORS:
                other = threshold.copy()
                other[a] = t * f
                if (better := f1(held, other, margin)) > best:
                    best, threshold = better, other
    return counts, threshold, margin


def numbered(tokens: DataFrame, sample: Sample) -> DataFrame:
    """Written table (doc_id, lang, word, sizes): the numbers of each record's words (-1: not in the vocabulary) and the words of its sentences."""
    shared = tokens.sparkSession.sparkContext.broadcast((sample.vocabulary, sample.tongues))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tongues = shared.value
        get = vocabulary.get
        for b in batches:
            words, sizes = [], []
            for line in b.column(2).to_pylist():
                split = line.split("\n")
                words.append([get(w, -1) for w in line.replace("\n", " ").split(" ")])
                sizes.append([s.count(" ") + 1 for s in split])
            lang = [tongues.get(t, -1) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.int32()), pa.array(words, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], ["doc_id", "lang", "word", "sizes"])

    lines = tokens.where("line is not null").select("doc_id", "lang", "line")
    return written(lines.mapInArrow(run, "doc_id long, lang int, word array<int>, sizes array<int>"), "numbered")


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, sizes of the sentences, sentences of each record, language of each record) of a batch of numbered records."""
    per = np.diff(b.column(3).offsets.to_numpy())
    return b.column(2).flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy().astype(np.int64), per, b.column(1).to_numpy()


def _summed(rows: DataFrame, run: object, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the arrays that ``run`` makes of the batches of a task: what is not zero in them is added up by place before it comes to the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(np.prod(shape)), np.int64)
        for b in batches:
            run(b, total)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 17)]), pa.array(total[at[i : i + (1 << 17)]])], ["at", "n"])

    sums = rows.mapInArrow(partial, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(int(np.prod(shape)), np.int64)
    out[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(shape)


def background(rows: DataFrame, sample: Sample) -> Background:
    """Counts over all numbered records; those in a language that no labelled record has count for none."""
    t, n, m = len(sample.tongues), len(sample.vocabulary), len(sample.bigrams)
    shared = rows.sparkSession.sparkContext.broadcast(sample.bigrams)

    def run(b: pa.RecordBatch, total: np.ndarray) -> None:
        bigrams = shared.value
        word, sizes, per, lang = _arrays(b)
        g = np.repeat(np.repeat(lang, per), sizes)
        known = g >= 0
        width = n + m + 1
        total[: t * width] += np.bincount(g[known] * width + n + m, minlength=t * width)
        ok = known & (word >= 0)
        total[: t * width] += np.bincount(g[ok] * width + word[ok], minlength=t * width)
        if m:
            before = np.roll(word, 1)
            before[np.cumsum(sizes) - sizes] = 0
            ok &= before >= 0
            key, g = before[ok] * n + word[ok], g[ok]
            at = np.searchsorted(bigrams, key).clip(0, m - 1)
            hit = bigrams[at] == key
            total[: t * width] += np.bincount(g[hit] * width + n + at[hit], minlength=t * width)

    found = _summed(rows, run, (t, n + m + 1))
    return Background(found[:, :n].astype(float), found[:, n : n + m].astype(float), found[:, -1].astype(float))


def learned(rows: DataFrame, sample: Sample, model: Models, labelled: list[int]) -> np.ndarray:
    """(language, area, word): how often the areas' sentences hold a word, by the model, in all records but the labelled ones."""
    t, k, n = len(sample.tongues), len(sample.areas), len(sample.vocabulary)
    shared = rows.sparkSession.sparkContext.broadcast((model.parts(), np.sort(np.array(labelled, np.int64))))

    def run(b: pa.RecordBatch, total: np.ndarray) -> None:
        parts, labelled = shared.value
        m = Models(*parts)
        word, sizes, per, lang = _arrays(b)
        if not len(sizes):
            return
        scores = m.score(word, sizes)
        ids = b.column(0).to_numpy()
        known = labelled[np.searchsorted(labelled, ids).clip(0, len(labelled) - 1)] == ids if len(labelled) else np.zeros(len(ids), bool)
        doc, area = m.accepted(scores, per)
        fit = (lang[doc] >= 0) & ~known[doc]
        claims = np.zeros((len(per), k))
        claims[doc[fit], area[fit]] = 1
        possible = np.repeat(claims, per, axis=0)
        share = np.rint(responsibilities(scores * (sizes + NEUTRAL)[:, None], possible) * _UNIT).astype(np.int64)
        sentence, area = np.nonzero(share)
        where = np.repeat(np.arange(len(sentence)), sizes[sentence])
        first = np.cumsum(sizes) - sizes
        place = first[sentence][where] + np.arange(len(where)) - np.repeat(np.cumsum(sizes[sentence]) - sizes[sentence], sizes[sentence])
        w = word[place]
        ok = w >= 0
        g = np.repeat(lang, per)[sentence][where]
        np.add.at(total, ((g * k + area[where]) * n + w)[ok], share[sentence, area][where][ok])

    return _summed(rows, run, (t, k, n)) / _UNIT


def fit(tokens: DataFrame, samples: DataFrame, areas: DataFrame, id_col: str = "doc_id", max_sample: int = MAX_SAMPLE) -> tuple[Models, DataFrame]:
    """(models, numbered records) of a table of tokenised records, from at most ``max_sample`` labelled ones and all others.

    Repeated labels count once; labels of unknown areas, null labels and records
    without words are left out; without any sample every record has no area.
    """
    names = sorted(r[0] for r in areas.select("area").dropna().distinct().collect())
    ids = samples.select(F.col(id_col).alias("doc_id"), "area").dropna().join(F.broadcast(areas.select("area").distinct()), "area").groupBy("doc_id").agg(F.sort_array(F.collect_set("area")).alias("areas"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    rows = tokens.where("line is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "line", "lang", "areas").toArrow().sort_by("doc_id")
    found, lines, langs, given = (rows.column(c).to_pylist() for c in ("doc_id", "line", "lang", "areas"))
    frequent = tokens.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(FREQUENT)
    sample = Sample(lines, langs, [{names.index(a) for a in of} for of in given], names, [r.word for r in frequent.collect()])
    records = numbered(tokens, sample)
    every = np.arange(len(lines))
    if not len(every):
        return Models(names, sample.vocabulary, sample.bigrams, np.zeros((len(sample.vocabulary), len(names)), np.float32), np.zeros((0, len(names)), np.float32)), records
    back = background(records, sample)
    counts, threshold, margin = calibrate(sample, back)
    model = train(sample, back, every, counts)
    model.threshold, model.margin = threshold, margin
    shares = learned(records, sample, model, found)
    _, threshold, margin = calibrate(sample, back, (counts,), shares)
    model = train(sample, back, every, counts, shares)
    model.threshold, model.margin = threshold, margin
    return model, records


def subjects(records: DataFrame, model: Models) -> DataFrame:
    """(doc_id, area, score) for each area of each numbered record; score is the best sentence's for the area, per token.

    A record may have several areas or none. Null and blank bodies have none;
    of a record delivered again the last delivery counts.
    """
    shared = records.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Models(*shared.value)
        for b in batches:
            word, sizes, per, _ = _arrays(b)
            scores = model.score(word, sizes)
            if not len(sizes):
                continue
            doc, area = model.accepted(scores, per)
            best = np.maximum.reduceat(scores, np.cumsum(per) - per, axis=0)[doc, area]
            names = pa.DictionaryArray.from_arrays(pa.array(area, pa.int32()), pa.array(model.areas, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), names, pa.array(np.round(best.astype(float), 6))], ["doc_id", "area", "score"])

    return records.mapInArrow(run, "doc_id long, area string, score double")
