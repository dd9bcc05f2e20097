"""Abusive, hateful or sexual content: a convolutional text classifier trained in numpy.

A document is a set of short segments (sentences and lines). Words are brought
to a plain form (look-alike characters, digits for letters, drawn-out letters,
letters set apart) and embedded as the mean of hashed vectors of the word and its
character n-grams; filters of several widths run over a segment, each keeps
its maximum, and a logistic layer gives a score for each kind. A document's
score is that of its worst segment. Training labels are those of whole
documents, so which segments carry them is re-estimated in every round.
Thresholds are calibrated on held-out documents, by language.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordex.llm.common import latest
from fjordex.llm.lookalikes import odd_characters, prototypes

KINDS = ("abusive", "hateful", "sexual")
# At most so many labelled documents train the model (a bounded sample, chosen by the hash of the id).
MAX_LABELLED = 4_000
ROWS, DIM, FILTERS, WIDTHS = 1 << 14, 16, 24, (1, 2, 3, 4)
ROUNDS, BATCH, RATE = 10, 256, 0.01
NEGATIVES = 4  # sampled segments without a label for each with one, in a round
LOST = 0.1  # share of words left out at random in training
WORDS = 40  # longer segments are cut into pieces of so many words that overlap by the widest filter
MIN_CASES = 12  # fewer held-out cases of a kind in a language: the threshold of all languages; in all of them: that of all kinds
CLEAN_SHARE = 0.02  # a threshold lets pass at most so many of the held-out documents without any kind
LEAST_THRESHOLD = 0.2
CHUNK = 16_384  # words that go through the filters at once, whatever the length of the texts
_BREAKS = '"“”„«»()[]{}<>,;:'  # they part words
_MARK = "\x02"  # stands for the end of a line
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"})
_RUNS = re.compile(r"(.)\1{2,}")
_APART = re.compile(r"(?<!\S)(?:\w ){2,}\w(?!\w)")


def plain(text: str) -> str:
    """Composed lower case with look-alike characters replaced, letters set apart joined, words apart and line ends marked."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
        table = prototypes()
        for c in odd_characters().intersection(text):
            text = text.replace(c, table.get(ord(c), c))
        text = unicodedata.normalize("NFC", text).replace("…", ". ")
    for c in _BREAKS:
        text = text.replace(c, " ")
    text = _APART.sub(lambda m: m.group().replace(" ", ""), text)
    return text.lower().replace("\n", f" {_MARK} ").replace("\r", f" {_MARK} ")


def ends(token: str) -> bool:
    """Whether a sentence ends with a token."""
    return token.rstrip("'")[-1:] in (".", "!", "?", _MARK) and token.rstrip("'") != ""


def word_form(token: str) -> str:
    """One token: signs that stand for letters, drawn-out letters; numbers are one word."""
    token = token.strip(".?-_'`’*#/\\|=+~^&") if not token.endswith("!") else token.rstrip("!").strip(".?-_'`’#/\\|=+~^&")
    if not token:
        return ""
    if token[0].isdigit() and not any(c.isalpha() for c in token):
        return "#"
    if not token.isalpha() and any(c.isalpha() for c in token):
        token = token.translate(_SIGNS)
    return _RUNS.sub(r"\1", token)


def features(word: str) -> list[int]:
    """Rows of the embedding table: the word itself and its character 3- and 4-grams."""
    w = f"<{word}>"
    grams = {word} | {w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1)}
    return sorted({zlib.crc32(g.encode()) % ROWS for g in grams})


def segments(text: str | None) -> list[list[str]]:
    """Word forms of each segment; all of the text is covered."""
    out: list[list[str]] = []
    now: list[str] = []
    for token in [*plain(text).split(), _MARK] if text else ():
        form = "" if token == _MARK else word_form(token)
        if form:
            now.append(form)
        if ends(token):
            out += [now[a : a + n] for a, n in pieces(len(now))]
            now = []
    return out


def pieces(n: int) -> list[tuple[int, int]]:
    """(first word, words) of the segments that n words make: one, or pieces that overlap by the widest filter; none of nothing."""
    if n <= WORDS:
        return [(0, n)] if n else []
    step = WORDS - max(WIDTHS) + 1
    return [(i, min(WORDS, n - i)) for i in range(0, n - max(WIDTHS) + 1, step)]


class Vectors(dict):
    """Token -> twice the row of its word in ``matrix``, and one more if it ends a sentence; -1 or -2 for no word. Bounded by ``bound`` and the words of a text."""

    def __init__(self, table: np.ndarray, bound: int = 200_000):
        self.table, self.bound = table, bound
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.forms: dict[str, int] = {}
        self.matrix = np.zeros((1024, self.table.shape[1]), np.float32)

    def __missing__(self, token: str) -> int:
        form = "" if token == _MARK else word_form(token)
        if not form:
            code = -2 if ends(token) else -1
        else:
            k = self.forms.get(form, -1)
            if k < 0:
                k = self.forms[form] = len(self.forms)
                if k == len(self.matrix):
                    self.matrix = np.vstack([self.matrix, np.zeros_like(self.matrix)])
                self.matrix[k] = self.table[features(form)].mean(0)
            code = 2 * k + ends(token)
        self[token] = code
        return code

    def segments(self, tokens: list[str], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of the words, sizes, documents) of the segments of some texts, given their tokens and whose they are."""
        codes = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        word = codes >= 0
        end = np.where(word, codes & 1, codes == -2)
        seg = (np.cumsum(end) - end)[word]
        rows, doc = codes[word] >> 1, doc[word]
        starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]][: len(seg)])
        sizes = np.diff(np.r_[starts, len(rows)])
        if (sizes > WORDS).any():
            cut = [(s + a, n) for s, size in zip(starts.tolist(), sizes.tolist()) for a, n in pieces(size)]
            starts, sizes = (np.array(x, np.int64) for x in zip(*cut))
            rows, doc = rows[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], doc[starts]
        else:
            doc = doc[starts]
        return rows, sizes, doc


def maxima(r: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Greatest of the rows starts .. starts + sizes - 1 in each column, and the first row that has it.

    Place by place over all segments, longest first: much faster than a reduction of each.
    """
    order = np.argsort(-sizes, kind="stable")
    s, n = starts[order], -sizes[order]
    top = r[s]
    at = np.zeros(top.shape, np.int64) if places else None
    for p in range(1, -int(n[0]) if len(n) else 0):
        c = int(np.searchsorted(n, -p, side="left"))
        here = r[s[:c] + p]
        if places:
            at[:c][here > top[:c]] = p
        np.maximum(top[:c], here, out=top[:c])
    out = np.empty_like(top)
    out[order] = top
    if places:
        first = np.empty_like(at)
        first[order] = at + s[:, None]
        return out, first
    return out, None


def kernel(net: dict[str, np.ndarray]) -> np.ndarray:
    """All filters as one matrix over the widest window; narrower ones are zero behind their width."""
    w = np.zeros((max(WIDTHS), net["table"].shape[1], FILTERS * len(WIDTHS)), np.float32)
    for c, k in enumerate(WIDTHS):
        w[:k, :, c * FILTERS : (c + 1) * FILTERS] = net[f"w{k}"]
    return w.reshape(-1, w.shape[2])


def forward(x: np.ndarray, sizes: np.ndarray, net: dict[str, np.ndarray], keep: bool = False, filters: np.ndarray | None = None) -> tuple:
    """Scores of segments given their word vectors one after another.

    Between segments lie zero vectors, as many as the widest filter needs.
    """
    gap = max(WIDTHS) - 1
    starts = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]]).astype(np.int64)
    rows = np.arange(len(x)) + np.repeat(np.arange(len(sizes)) * gap, sizes)
    padded = np.zeros((int((sizes + gap).sum()) + gap, x.shape[1]), np.float32)
    padded[rows] = x
    n, dim = len(padded) - gap, x.shape[1]
    windows = np.lib.stride_tricks.as_strided(padded, (n, dim * max(WIDTHS)), padded.strides)
    r = np.ascontiguousarray(windows) @ (kernel(net) if filters is None else filters)
    # windows that begin at a word of the segment; those that begin behind it would reach into the next
    h, at = maxima(r, starts, sizes, keep)
    h += np.concatenate([net[f"b{k}"] for k in WIDTHS])
    a = np.maximum(h, 0)
    p = 1 / (1 + np.exp(-np.clip(a @ net["out"] + net["bias"], -30, 30)))
    return (p, a, np.split(at, len(WIDTHS), axis=1), padded, rows) if keep else (p,)


def _train(segs: list[list[str]], doc: np.ndarray, labels: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Net of segments; ``doc`` says whose they are, ``labels`` (documents x kinds) what those hold."""
    rng = np.random.default_rng(seed)
    net = {"table": rng.normal(0, 0.3, (ROWS, DIM)).astype(np.float32), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(KINDS))).astype(np.float32), "bias": np.full(len(KINDS), -2.0, np.float32)}
    for k in WIDTHS:
        net[f"w{k}"] = rng.normal(0, 1 / np.sqrt(DIM * k), (k, DIM, FILTERS)).astype(np.float32)
        net[f"b{k}"] = np.zeros(FILTERS, np.float32)
    words: dict[str, int] = {}
    feats: list[list[int]] = []
    coded = []
    for s in segs:
        row = []
        for w in s:
            if w not in words:
                words[w] = len(words)
                feats.append(features(w))
            row.append(words[w])
        coded.append(np.array(row, np.int64))
    if not coded:
        return net
    flat = np.concatenate([np.array(f, np.int64) for f in feats])
    count = np.array([len(f) for f in feats])
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    size = np.array([len(c) for c in coded])
    want = labels[doc].astype(np.float32)  # before the first round: every segment of a labelled document, weighted by distinctive words
    # segments of labelled documents that are most unlike the others by their words (log-odds of documents) start as cases
    n_docs = len(labels)
    target = np.zeros_like(want)
    pairs = np.unique(np.stack([np.repeat(doc, size), np.concatenate(coded)]), axis=1)
    clean = ~labels.any(1)
    df0 = np.bincount(pairs[1][clean[pairs[0]]], minlength=len(words)) + 0.5
    for k in range(len(KINDS)):
        if not labels[:, k].any():
            continue
        df1 = np.bincount(pairs[1][labels[pairs[0], k]], minlength=len(words)) + 0.5
        odds = np.log(df1 / (labels[:, k].sum() + 1)) - np.log(df0 / (clean.sum() + 1))
        odds = np.clip(odds, -2, None)
        score = np.array([odds[c].sum() / (len(c) + 3) for c in coded])
        for d in np.flatnonzero(labels[:, k]):
            own = np.flatnonzero(doc == d)
            if len(own):
                target[own[score[own].argmax()], k] = 1
    slots = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in net.items()}
    step = 0

    def summed(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, values.shape[1]), np.float32)
        order = np.argsort(group, kind="stable")
        at = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
        out[group[order][at]] = np.add.reduceat(values[order], at, axis=0)
        return out

    def vectors(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        uniq, back = np.unique(ids, return_inverse=True)
        n = count[uniq]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        idx = flat[np.arange(n.sum()) - np.repeat(begin, n) + np.repeat(first[uniq], n)]
        mean = np.add.reduceat(net["table"][idx], begin, axis=0) / n[:, None]
        return mean[back], back, (idx, np.repeat(np.arange(len(uniq)), n), uniq)

    def scores(which: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(which), 4096):
            part = which[i : i + 4096]
            out.append(forward(vectors(np.concatenate([coded[s] for s in part]))[0], size[part], net)[0])
        return np.concatenate(out) if out else np.zeros((0, len(KINDS)), np.float32)

    free = np.flatnonzero(~want.any(1))
    owned = np.flatnonzero(want.any(1))
    mask = np.ones_like(want)
    for turn in range(ROUNDS):
        if turn >= 2 and len(owned):
            p = scores(owned)
            target[owned], mask[owned] = 0, 1
            for k in range(len(KINDS)):
                has = want[owned, k] > 0
                target[owned[has & (p[:, k] > 0.5)], k] = 1
                mask[owned[has & (p[:, k] > 0.2) & (p[:, k] <= 0.5)], k] = 0
                for d in np.unique(doc[owned[has]]):
                    own = np.flatnonzero((doc[owned] == d) & has)
                    top = owned[own[p[own, k].argmax()]]
                    target[top, k], mask[top, k] = 1, 1
        cases = owned[target[owned].any(1)]
        rest = owned[~target[owned].any(1)] if turn >= 2 else np.zeros(0, np.int64)
        n_free = min(len(free), NEGATIVES * max(len(cases), 50))
        picked = rng.choice(free, n_free, replace=False) if n_free else free
        if turn >= 2 and len(free):  # the half that look most like cases
            pool = rng.choice(free, min(len(free), 3 * n_free), replace=False)
            hard = pool[np.argsort(-scores(pool).max(1))[: n_free // 2]]
            picked = np.concatenate([picked[: n_free - len(hard)], hard])
        if len(rest) > n_free:
            rest = rng.choice(rest, n_free, replace=False)
        every = np.concatenate([np.repeat(cases, 2), picked, rest])
        rng.shuffle(every)
        for i in range(0, len(every), BATCH):
            part = every[i : i + BATCH]
            ids = np.concatenate([coded[s] for s in part])
            x, back, (idx, owner, uniq) = vectors(ids)
            seen = (rng.random((len(x), 1)) >= LOST).astype(np.float32)
            p, a, args, padded, rows = forward(x * seen, size[part], net, keep=True)
            g = (p - target[part]) * mask[part] / len(part)
            grads = {"out": a.T @ g + 1e-4 * net["out"], "bias": g.sum(0)}
            ga = (g @ net["out"].T) * (a > 0)
            gx = np.zeros_like(padded)
            n = len(padded) - max(WIDTHS) + 1
            column = np.arange(FILTERS)
            for c, k in enumerate(WIDTHS):
                gk = ga[:, c * FILTERS : (c + 1) * FILTERS]
                back_to = np.zeros((n, FILTERS), np.float32)
                back_to[args[c], column] = gk
                grads[f"b{k}"] = gk.sum(0)
                gw = np.empty_like(net[f"w{k}"])
                for j in range(k):
                    gw[j] = padded[j : n + j].T @ back_to
                    gx[j : n + j] += back_to @ net[f"w{k}"][j].T
                grads[f"w{k}"] = gw
            word = summed(gx[rows] * seen, back, len(uniq)) / count[uniq][:, None]
            step += 1
            for name, gr in grads.items():
                m, v = slots[name]
                m += 0.1 * (gr - m)
                v += 0.001 * (gr * gr - v)
                net[name] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            lines, inv = np.unique(idx, return_inverse=True)
            gt = summed(word[owner], inv, len(lines))
            _, v = slots["table"]
            v[lines] += gt * gt
            net["table"][lines] -= 0.1 * gt / (np.sqrt(v[lines]) + 1e-6)
    return net


def document_scores(texts: list[str | None], net: dict[str, np.ndarray], cache: Vectors) -> np.ndarray:
    """Scores of the kinds for each document: the greatest of its segments; 0 for a text without words.

    Segments go through the filters in chunks of about so many words, so that memory is bounded by no text's length.
    """
    out = np.zeros((len(texts), len(KINDS)), np.float32)
    filters = kernel(net)

    def score(tokens: list[str], doc: list[int], count: list[int]) -> None:
        rows, sizes, whose = cache.segments(tokens, np.repeat(doc, count))
        ends_at = np.cumsum(sizes)
        i = 0
        while i < len(sizes):
            before = ends_at[i - 1] if i else 0
            k = max(i + 1, int(np.searchsorted(ends_at, before + CHUNK, side="right")))
            p = forward(cache.matrix[rows[before : ends_at[k - 1]]], sizes[i:k], net, filters=filters)[0]
            d = whose[i:k]
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            out[d[first]] = np.maximum(out[d[first]], np.maximum.reduceat(p, first, axis=0))
            i = k
        if len(cache) > cache.bound:
            cache.empty()

    tokens: list[str] = []
    doc: list[int] = []
    count: list[int] = []
    for i, t in enumerate(texts):
        if t:
            words = plain(t).split()
            tokens += words
            tokens.append(_MARK)
            doc.append(i)
            count.append(len(words) + 1)
            if len(tokens) >= CHUNK:
                score(tokens, doc, count)
                tokens, doc, count = [], [], []
    if tokens:
        score(tokens, doc, count)
    return out


def best_threshold(score: np.ndarray, truth: np.ndarray, clean: np.ndarray) -> float:
    """The middle of the gap that gives the best F1, but no lower than what all but a small share of the ``clean`` scores are below."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(truth.sum(), 1))
    k = int(f1.argmax())
    low = score[order[k + 1]] if k + 1 < len(order) else 0.0
    floor = np.nextafter(np.quantile(clean, 1 - CLEAN_SHARE, method="higher"), np.inf) if len(clean) else 0.0
    return float(max((score[order[k]] + low) / 2, floor, LEAST_THRESHOLD))


def tongue(lang: str | None) -> str:
    lang = (lang or "").lower()[:2]
    return "no" if lang in ("nb", "nn") else lang


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", order: str = "stored_at", lang: str = "lang", max_labelled: int = MAX_LABELLED) -> tuple[dict[str, np.ndarray], dict[tuple[str, str], float]]:
    """(net, thresholds by (kind, language); language "" is for all) from at most ``max_labelled`` documents.

    Repeated labels count once; labels of other kinds than the three mean none of
    them; documents without words are left out.
    """
    ids = labels.select(F.col(id_col).alias("doc_id"), "kind").dropna().groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(order).alias("at")).join(F.broadcast(ids), "doc_id")
    rows = latest(rows, "doc_id", "at", "text").select("doc_id", "text", "lang", "kinds").toArrow().sort_by("doc_id")
    texts, langs, kinds = (rows.column(c).to_pylist() for c in ("text", "lang", "kinds"))
    segs: list[list[str]] = []
    doc: list[int] = []
    for i, t in enumerate(texts):
        s = segments(t)
        segs += s
        doc += [i] * len(s)
    truth = np.array([[k in of for k in KINDS] for of in kinds], bool).reshape(len(texts), len(KINDS))
    owner = np.array(doc, np.int64)
    fold = np.arange(len(texts)) % 3
    held = np.zeros(truth.shape, np.float32)
    for f in range(3) if len(texts) >= 3 else ():
        inside = np.flatnonzero(fold[owner] != f)
        net = _train([segs[i] for i in inside], owner[inside], truth & (fold != f)[:, None])
        out = np.flatnonzero(fold == f)
        held[out] = document_scores([texts[i] for i in out], net, Vectors(net["table"]))
    return _train(segs, owner, truth), calibrate(held, truth, [tongue(x) for x in langs])


def calibrate(held: np.ndarray, truth: np.ndarray, tongues: list[str]) -> dict[tuple[str, str], float]:
    """Thresholds by (kind, language) from the scores of held-out documents; "" is for languages with few cases.

    A kind with few cases in all languages takes the threshold of all kinds together.
    """
    clean = ~truth.any(1)
    thresholds: dict[tuple[str, str], float] = {}
    of = np.array(tongues)
    common = best_threshold(held.ravel(), truth.ravel(), held[clean].ravel()) if truth.any() else 0.5
    for k, kind in enumerate(KINDS):
        enough = truth[:, k].sum() >= MIN_CASES
        thresholds[kind, ""] = best_threshold(held[:, k], truth[:, k], held[clean, k]) if enough else common
        for t in set(tongues):
            here = of == t
            if truth[here, k].sum() >= MIN_CASES:
                thresholds[kind, t] = best_threshold(held[here, k], truth[here, k], held[here & clean, k])
    return thresholds


def scored(docs: DataFrame, model: tuple[dict[str, np.ndarray], dict[tuple[str, str], float]], id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, source, score and flag of each kind) of every document.

    A null or blank text scores 0 and is not flagged; rows are taken as they
    are, so repeated rows are repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, thresholds = shared.value
        cache = Vectors(net["table"])
        for b in batches:
            p = document_scores(b.column(1).to_pylist(), net, cache)
            of = [tongue(x) for x in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(3)]
            for k, kind in enumerate(KINDS):
                limit = np.array([thresholds.get((kind, t), thresholds[kind, ""]) for t in of])
                cols += [pa.array(p[:, k].astype(np.float64)), pa.array((p[:, k] >= limit) & (p[:, k] > 0))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "source", *(f"{k}{x}" for k in KINDS for x in ("_score", ""))])

    kinds = ", ".join(f"{k}_score double, {k} boolean" for k in KINDS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text), F.col(lang), F.col(source)).mapInArrow(run, f"doc_id long, source string, {kinds}")
