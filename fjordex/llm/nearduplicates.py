"""Near-duplicate records with small edits: an exact prefix filter over runs of words, or multi-index hashing.

The exact way needs no bound on the number of edits. The distinct runs of a
text are put in one order that all texts share, rare ones first. Two texts of
the wanted similarity share a run within the first n - ceil(s * n) + 1 of each
(n runs, similarity s), so texts that meet in no such run can't be near. What
meets is held against the sizes, the positions of the run and a parity sketch
of all runs; each of them gives an upper bound of the similarity, so no near
pair is lost. The order only decides how much meets: it comes from the counts
of a bounded sample of the records and the frequencies of the words.

Multi-index hashing (``segments`` given) is approximate. Its fingerprint is a
sparse bit vector: each distinct word sets the bit at its 64-bit hash. The
vector is read as a ring that is cut at fixed anchors into segments; a segment
begins at its anchor and is just long enough to hold a given amount of
information (sum of log2(texts / texts with the word)). For each segment the
Hamming ball of radius one is enumerated (the segment itself, and with each set
bit flipped off) and looked up in the table of unflipped segments. A pair with
two or more changed words in every segment is not met.

Copies of a text are one text: those of texts with many copies are left out
before anything is shuffled by run. A run that very many texts may meet in is
split: its texts fall into blocks, and each pair of blocks is a task of its
own, so no task holds more than two blocks at once.

Every pair met is verified: first by the Hamming distance of the word sets,
which can't exceed that of the sets of runs, then by the Jaccard similarity
itself. Texts are told apart by 64-bit hashes, which a second one checks; should two texts ever share
the first, everything is done again with another seed. Runs are told apart by 64-bit hashes while they are met, by their words when verified.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, chain
from operator import xor

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordex.functions.text import py_terms
from fjordex.llm.common import attach_group, latest, sized_join
from fjordex.llm.formatting import item_key
from fjordex.operators.graph import connected_components
from fjordex.session import written

# Texts (expected) whose runs are counted for the order of runs, and the most counts kept: fixed bounds of what is broadcast. No result depends on them.
ORDER_SAMPLE, ORDER_RUNS = 16_384, 1 << 18
# Texts of which at least so many copies are known are reduced to one before the shuffle, the most copied first. Fixed bounds of what is broadcast; no result depends on them.
MANY_COPIES, MOST_COPIED = 8, 50_000
# A run that is expected in more texts than this is split into blocks of about so many texts, at most 2^MOST_SPLIT of them.
HOT_RUN, MOST_SPLIT = 20_000, 12
BATCH = 4_096  # texts whose runs are put in order at once
# Words whose frequency is kept apart; any other word counts as the last of them. A fixed bound of what is broadcast.
FREQUENT = 4096
# Bits of information in a segment beyond log2(number of texts).
SPARE_BITS = 11
_UNIT = 256  # information is summed in whole 1/256 bits, so that every order of summing agrees
_ALL = (1 << 64) - 1


def segment_keys(words: dict[str, tuple[int, int]] | list[tuple[int, int]], bits: int, segments: int) -> tuple[list[int], list[int]]:
    """(exact keys, ball keys) of one text given the (hash, information) of its distinct words."""
    feats = sorted(words)
    n = len(feats)
    if not n:
        return [], []
    h = [a for a, _ in feats] * 2
    info = [b for _, b in feats] * 2
    x = [0, *accumulate(h, xor)]
    s = [0, *accumulate(info)]
    exact, ball = [], []
    for j in range(segments):
        p = bisect_left(h, j * (1 << 64) // segments, 0, n) % n
        salt = x[p] ^ (j * 0x9E3779B97F4A7C15 & _ALL)
        goal, last = s[p] + bits, p + n
        e = min(bisect_left(s, goal, p + 1, last + 1), last)
        exact.append(x[e] ^ salt)
        for k in range(p, e):
            ball.append(x[min(bisect_left(s, goal + info[k], e, last + 1), last)] ^ h[k] ^ salt)
    return exact, ball


def _first_pass(docs: DataFrame, id_col: str, body: str, order: str, min_words: int, seed: int) -> DataFrame:
    """Written table (doc_id, at, tid, check, ikey) of every delivery; tid and check are null for one without enough words.

    ``tid`` says which text it is, ``check`` is a second hash of it.
    """
    at = docs.schema[order].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, checks, keys = [], [], []
            for text in b.column(1).to_pylist():
                words = py_terms(text)
                enough = len(words) >= min_words
                ids.append(text_id(words, seed) if enough else None)
                checks.append(text_id(words, ~seed) if enough else None)
                keys.append(item_key(text) if enough else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.int64()), pa.array(checks, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "at", "tid", "check", "ikey"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(body).alias("body"), F.col(order).alias("at"))
    return written(rows.mapInArrow(run, f"doc_id long, at {at.simpleString()}, tid long, check long, ikey binary"), "first-pass")


def word_frequencies(docs: DataFrame, body: str, min_words: int, top: int = FREQUENT) -> dict[str, int]:
    """Texts with each of the most frequent words; only a fixed number of rows comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                words = py_terms(text)
                if len(words) >= min_words:
                    count.update(set(words))
            if len(count) > 200_000:
                yield out()
                count.clear()
        yield out()

    n = docs.select(F.col(body).alias("body")).where("body is not null").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in n.orderBy(F.col("n").desc(), "word").limit(top).collect()}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_id(words: list[str], seed: int = 0) -> int:
    return _signed(xxhash.xxh3_64_intdigest(" ".join(words), seed & _ALL))


def _copied(first: DataFrame) -> dict[int, int]:
    """For texts with many copies the one record, by its id, whose delivery stands for them all."""
    n = first.where("tid is not null").groupBy("tid").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")).where(F.col("n") >= MANY_COPIES)
    return {r.tid: r.rep for r in n.orderBy(F.col("n").desc(), "tid").limit(MOST_COPIED).collect()}


def _segments(docs: DataFrame, id_col: str, body: str, freq: dict[str, int], n_texts: int, min_words: int, segments: int, seed: int, copied: dict[int, int]) -> DataFrame:
    """(key, flipped, tid) rows of the segments of every delivery with enough words."""
    lowest = min(freq.values(), default=1)
    bits = round((math.log2(max(n_texts, 2)) + SPARE_BITS) * _UNIT)
    rare = max(1, round(math.log2(max(n_texts / lowest, 1)) * _UNIT))
    known = {w: (xxhash.xxh3_64_intdigest(w), max(1, round(math.log2(max(n_texts / c, 1)) * _UNIT))) for w, c in freq.items()}
    shared = docs.sparkSession.sparkContext.broadcast((known, copied))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known, copied = shared.value
        seen: set[int] = set()
        for b in batches:
            tids, keys, counts, flipped = [], [], [], []
            for tid, words in _ones(b, min_words, seed, copied, seen):
                e, c = segment_keys([known.get(w) or (xxhash.xxh3_64_intdigest(w), rare) for w in set(words)], bits, segments)
                keys += e
                keys += c
                counts += (len(e), len(c))
                tids.append(tid)
            n = np.array(counts, np.int64)
            tid = np.repeat(np.repeat(np.array(tids, np.int64), 2), n)
            flip = np.repeat(np.tile([False, True], len(tids)), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(flip.astype(bool)), pa.array(tid)], ["key", "flipped", "tid"])

    return docs.select(F.col(body).alias("body"), F.col(id_col).cast("long").alias("doc_id")).where("body is not null").mapInArrow(run, "key long, flipped boolean, tid long")


def _ones(batch: pa.RecordBatch, min_words: int, seed: int, copied: dict[int, int], seen: set[int]) -> Iterator[tuple[int, list[str]]]:
    """(text id, words) of the deliveries in a batch of (body, doc_id) that have enough words; a much copied text only by its record, once a task."""
    for text, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        words = py_terms(text)
        if len(words) < min_words:
            continue
        tid = text_id(words, seed)
        if tid in copied:
            if copied[tid] != doc or tid in seen:
                continue
            seen.add(tid)
        yield tid, words


def _meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in (key, flipped, tid) order become rows (exact ids, ids), in blocks of bounded size."""
    import numpy as np

    block = 512

    def pairs(key: object, flip: object, tid: object) -> pa.RecordBatch:
        out: tuple[list, list] = ([], [])
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        if len(starts):
            ends = np.r_[starts[1:], len(key)]
            # a run gives pairs only if it holds different texts, and one of them unflipped
            keep = ~flip[starts] & (np.minimum.reduceat(tid, starts) != np.maximum.reduceat(tid, starts))
            for s, e in zip(starts[keep].tolist(), ends[keep].tolist()):
                f, t = flip[s:e], tid[s:e]
                exact, every = np.unique(t[~f]), np.unique(t)
                for i in range(0, len(exact), block):
                    for k in range(0, len(every), block):
                        out[0].append(exact[i : i + block])
                        out[1].append(every[k : k + block])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64())) for x in out], ["a", "b"])

    kept: list[tuple] = []  # pieces of the last run, which the next batch may go on with
    for b in rows:
        if not b.num_rows:
            continue
        now = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        changes = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
        if kept and kept[0][0][0] != now[0][0]:
            cut = 0
        elif len(changes):
            cut = changes[0] if kept else 0
        else:
            kept.append(now)
            continue
        last = changes[-1] if len(changes) else 0
        if kept:
            kept.append(tuple(x[:cut] for x in now))
            yield pairs(*(np.concatenate([k[i] for k in kept]) for i in range(3)))
        if last > cut:
            yield pairs(*(x[cut:last] for x in now))
        kept = [tuple(x[last:] for x in now)]
    if kept:
        yield pairs(*(np.concatenate([k[i] for k in kept]) for i in range(3)))


class Words(dict):
    """Word -> its row in the arrays of hashes and of information, which grow as words come; emptied when they are very many."""

    def __init__(self, info: dict[str, int] | None = None, rare: int = 0):
        import numpy as np

        self.info, self.rare = info or {}, rare
        self.hashes, self.known = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64)

    def __missing__(self, word: str) -> int:
        import numpy as np

        k = self[word] = len(self)
        if k == len(self.hashes):
            self.hashes, self.known = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.known))
        self.hashes[k] = xxhash.xxh3_64_intdigest(word)
        self.known[k] = self.info.get(word, self.rare)
        return k


def _runs(texts: list[list[str]], n: int, words: Words) -> tuple:
    """(text, first, hash, rows): place of the text, and of every run of ``n`` words its place and its hash, repeated runs too; and the row of the word at each place."""
    import numpy as np

    if len(words) > 1 << 20:
        words.clear()
    sizes = [len(t) for t in texts]
    flat = np.fromiter(map(words.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
    text = np.repeat(np.arange(len(texts)), sizes)
    k = max(len(flat) - n + 1, 0)
    first = np.flatnonzero(text[:k] == text[n - 1 : n - 1 + k])
    each = words.hashes[flat]
    h = np.zeros(len(first), np.uint64)
    for i in range(n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + each[first + i]
    return text[first], first, (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), flat


def _sample(docs: DataFrame, id_col: str, n_texts: int) -> DataFrame:
    """Records for the order of runs, by the hash of the id: expected ORDER_SAMPLE texts."""
    return docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(max(n_texts, 1))) < ORDER_SAMPLE)


def _common_runs(some: DataFrame, body: str, n: int, min_words: int) -> tuple:
    """(hashes in order, counts) of runs that a sample of the records holds more than once; used for the order of runs only."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            text, _, h, _ = _runs([w for w in map(py_terms, b.column(0).to_pylist()) if len(w) >= min_words], n, words)
            order = np.lexsort((text, h))
            text, h = text[order], h[order]
            own = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][: len(h)]
            h, count = np.unique(h[own], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count, pa.int64())], ["h", "n"])

    counts = some.select(F.col(body).alias("body")).where("body is not null").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    found = counts.orderBy(F.col("n").desc(), "h").limit(ORDER_RUNS).toArrow()
    h, count = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def prefixes(texts: list[list[str]], n: int, similarity: float, words: Words, common: tuple) -> tuple:
    """(text, key, size, at, sketch, sketch) of the runs in the prefixes of at most 2^14 texts.

    ``words`` knows the information of the words, ``common`` is the result of
    _common_runs; size is the number of distinct runs of the text, at the place
    of the run among them.
    """
    import numpy as np

    text, first, h, flat = _runs(texts, n, words)
    each = words.known[flat]
    # rare runs first: 14 bits from the information of the words or, behind all those, from the count in the sample
    rank = (1 << 13) - 1 - np.minimum(sum((each[first + i] for i in range(n)), np.zeros(len(first), np.int64)) >> 1, (1 << 13) - 1)
    if len(common[0]):
        place = np.searchsorted(common[0], h).clip(0, len(common[0]) - 1)
        rank = np.where(common[0][place] == h, (1 << 13) + np.minimum(common[1][place], (1 << 13) - 1), rank)
    # one number to sort by: text, rank and as much of the hash as fits; should that not tell two runs apart, the whole hash does
    key = text.astype(np.uint64) << np.uint64(50) | rank.astype(np.uint64) << np.uint64(36) | h >> np.uint64(28)
    order = np.argsort(key)
    k = key[order]
    if ((k[1:] == k[:-1]) & (h[order[1:]] != h[order[:-1]])).any():
        order = np.lexsort((h, key))
    text, h = text[order], h[order]
    own = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][: len(h)]
    text, h = text[own], h[own]
    starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]][: len(text)])
    size = np.diff(np.r_[starts, len(text)])
    at = np.arange(len(text)) - np.repeat(starts, size)
    bit = np.uint64(1) << (h & np.uint64(63))
    low = (h >> np.uint64(6)) & np.uint64(1) == 0
    sketches = [np.repeat(np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), starts), size) if len(starts) else bit for x in (low, ~low)]
    size = np.repeat(size, size)
    keep = at < size - np.ceil(similarity * size - 1e-9) + 1
    return tuple(x[keep] for x in (text, h, size, at, *sketches))


def _prefix_rows(docs: DataFrame, id_col: str, body: str, freq: dict[str, int], n_texts: int, min_words: int, n: int, similarity: float, common: tuple, seed: int, copied: dict[int, int]) -> DataFrame:
    """(key, place, tid, s0, s1) rows of the prefix of every text with enough words; place is split * 2^56 + size * 2^32 + at.

    A row of a hot run, of which 2^split blocks are made, is repeated for each block that its own is paired with, under the pair's key.
    """
    import numpy as np

    in_sample = min(n_texts, ORDER_SAMPLE)
    bits = {w: round(math.log2(max(in_sample / c, 1)) * _UNIT) for w, c in freq.items()}
    rare = round(math.log2(max(in_sample / min(freq.values(), default=1), 1)) * _UNIT)
    scale = max(1.0, n_texts / ORDER_SAMPLE)  # the counts are those of a sample
    hot = common[1] * scale > HOT_RUN
    split = np.minimum(np.ceil(np.log2(np.maximum(common[1][hot] * scale / HOT_RUN, 2))), MOST_SPLIT).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((bits, rare, common, copied, common[0][hot], split))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bits, rare, common, copied, hot, split = shared.value
        seen: set[int] = set()
        known = Words(bits, rare)
        for b in batches:
            found = list(_ones(b, min_words, seed, copied, seen))
            made = [(i, prefixes([w for _, w in found[i : i + BATCH]], n, similarity, known, common)) for i in range(0, len(found) or 1, BATCH)]
            text, h, size, at, s0, s1 = (np.concatenate(x) for x in zip(*((m[0] + i, *m[1:]) for i, m in made)))
            tid = np.array([t for t, _ in found], np.int64)[text]
            place = (size << 32) | at
            rows = [(h, place, tid, s0, s1)]
            if len(hot):
                where = np.searchsorted(hot, h).clip(0, len(hot) - 1)
                is_hot = hot[where] == h
                if is_hot.any():
                    rows = [tuple(x[~is_hot] for x in rows[0])]
                    for i in np.flatnonzero(is_hot).tolist():
                        k = int(split[where[i]])
                        mine, others = int(tid[i]) & ((1 << k) - 1), np.arange(1 << k)
                        pair = np.minimum(mine, others) << k | np.maximum(mine, others)
                        key = (h[i] + pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
                        # the pair of a block with itself is like a run of its own
                        kind = np.where(others == mine, 0, k) << 56 | place[i]
                        rows.append((key, kind, *(np.full(1 << k, x[i]) for x in (tid, s0, s1))))
            key, place, tid, s0, s1 = (np.concatenate(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), place, tid, s0.view(np.int64), s1.view(np.int64))], ["key", "place", "tid", "s0", "s1"])

    return docs.select(F.col(body).alias("body"), F.col(id_col).cast("long").alias("doc_id")).where("body is not null").mapInArrow(run, "key long, place long, tid long, s0 long, s1 long")


def _met_in_prefix(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b), a < b, of texts with a prefix run in common that may be near, from rows in (key, place, tid) order."""
    most, share = 1 << 18, similarity / (1 + similarity)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def pairs(key: object, place: object, tid: object, s0: object, s1: object) -> Iterator[pa.RecordBatch]:
            blocks = (1 << (place >> 56)) - 1
            size, at = place >> 32 & 0xFFFFFF, place & 0xFFFFFFFF
            ends = np.r_[np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            end = np.repeat(ends, np.diff(np.r_[0, ends]))
            kept: list = []
            i, step = np.arange(len(key)), 0
            while len(i):
                # a run of equal keys goes by size, so that a text too large for i is followed by such only
                step += 1
                i = i[i + step < end[i]]
                i = i[size[i] >= similarity * size[i + step] - 1e-9]
                for x in (i[k : k + most] for k in range(0, len(i), most)):
                    y = x + step
                    need = share * (size[x] + size[y]) - 1e-9
                    # were this the first run they share, no more than the rest of either could be shared
                    ok = np.minimum(size[x] - at[x], size[y] - at[y]) >= need
                    x, y, need = x[ok], y[ok], need[ok]
                    # of a pair of blocks only texts of different ones meet
                    ok = (blocks[x] == 0) | ((tid[x] ^ tid[y]) & blocks[x] != 0)
                    x, y, need = x[ok], y[ok], need[ok]
                    # a run of one text only changes at most one bit
                    differ = sum(np.bitwise_count((s[x] ^ s[y]).view(np.uint64)).astype(np.int64) for s in (s0, s1))
                    ok = (differ <= size[x] + size[y] - 2 * need) & (tid[x] != tid[y])
                    kept.append((tid[x[ok]], tid[y[ok]]))
                if sum(len(x) for x, _ in kept) > most:
                    yield batch(kept)
                    kept = []
            yield batch(kept)

        def batch(kept: list) -> pa.RecordBatch:
            x, y = (np.concatenate([p[k] for p in kept] or [np.zeros(0, np.int64)]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        def single(now: tuple) -> tuple:
            """Equal texts are one text."""
            same = (now[0][1:] == now[0][:-1]) & (now[1][1:] == now[1][:-1]) & (now[2][1:] == now[2][:-1])
            return tuple(x[np.r_[True, ~same]] for x in now)

        kept: tuple | None = None  # the last run of equal keys, which the next batch may go on with
        for b in rows:
            if not b.num_rows:
                continue
            now = tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            now = single(now if kept is None else tuple(np.concatenate(x) for x in zip(kept, now)))
            last = np.searchsorted(now[0], now[0][-1])
            if last:
                yield from pairs(*(x[:last] for x in now))
            kept = tuple(x[last:] for x in now)
        if kept is not None:
            yield from pairs(*kept)

    return run


def near_texts(docs: DataFrame, id_col: str = "doc_id", body: str = "body", order: str = "loaded_at", n: int = 5, similarity: float = 0.8, min_words: int | None = None, segments: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pairs of texts, members): (a, b, jaccard) over text ids a < b, and (doc_id, tid) of the records.

    Texts are compared by their distinct runs of ``n`` words; only texts of at
    least ``min_words`` (default n) words take part, so null, blank and short
    bodies do not. Equal texts are one text. Lists that hold the same items in
    another order are copies and give no pair. All pairs of at least the
    (positive) similarity are found, unless ``segments`` asks for multi-index
    hashing with so many segments, which finds those that meet in a segment.
    """
    min_words = max(n, n if min_words is None else min_words)
    again = {"id_col": id_col, "body": body, "order": order, "n": n, "similarity": similarity, "min_words": min_words, "segments": segments}
    first = _first_pass(docs, id_col, body, order, min_words, seed)
    if not first.where("tid is not null").groupBy("tid").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").isEmpty():
        return near_texts(docs, **again, seed=seed + 1)
    n_texts = first.where("tid is not null").count()
    copied = _copied(first)
    if segments is None:
        some = _sample(docs, id_col, n_texts)
        keys = _prefix_rows(docs, id_col, body, word_frequencies(some, body, min_words), n_texts, min_words, n, similarity, _common_runs(some, body, n, min_words), seed, copied)
        pairs = keys.repartition("key").sortWithinPartitions("key", "place", "tid").mapInArrow(_met_in_prefix(similarity), "a long, b long")
    else:
        keys = _segments(docs, id_col, body, word_frequencies(docs, body, min_words), n_texts, min_words, segments, seed, copied)
        met = keys.repartition("key").sortWithinPartitions("key", "flipped", "tid").mapInArrow(_meet, "a array<long>, b array<long>")
        pairs = met.repartition(docs.sparkSession.sparkContext.defaultParallelism).select(F.explode("a").alias("x"), "b").select("x", F.explode("b").alias("y")).where("x <> y")
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = written(pairs.distinct(), "candidates")
    members = written(latest(first.select("doc_id", "at", "tid", "ikey"), "doc_id", "at", "tid", "ikey").where("tid is not null"), "members")
    wanted = pairs.select(F.col("a").alias("tid")).union(pairs.select("b")).distinct()
    reps = written(members.join(wanted, "tid").groupBy("tid").agg(F.min(F.struct("doc_id", "at")).alias("r")).select("tid", "r.doc_id", F.struct("r.at").alias("at")), "texts")
    n_reps = reps.count()
    bodies = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(F.col(order).alias("at")).alias("at"), F.col(body).alias("body"))
    fetched = sized_join(bodies, reps, ["doc_id", "at"], n_reps).select("tid", "body")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a record may have been delivered with another body at the same time
        for b in batches:
            yield b.filter(pa.array([text_id(py_terms(x), seed) == t for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_()))

    texts = written(fetched.mapInArrow(own, "tid long, body string").dropDuplicates(["tid"]), "bodies")
    both = pairs.join(texts.select(F.col("tid").alias("b"), F.col("body").alias("bt")), "b")
    both = both.join(texts.select(F.col("tid").alias("a"), F.col("body").alias("at")), "a").select("a", "at", "b", "bt")
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wa, ra = None, set(), set()
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for a, at, b, bt in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if a != last:  # pairs of one text come one after another
                    w = py_terms(at)
                    last, wa, ra = a, set(w), {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
                w = py_terms(bt)
                # the fingerprints differ in no more bits than the sets of runs, of which a (1 - s) / (1 + s) share may
                if len(wa ^ set(w)) > (len(ra) + len(w)) * share + 1e-9:
                    continue
                rb = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
                shared = len(ra & rb)
                j = shared / (len(ra) + len(rb) - shared)
                if j >= similarity - 1e-12:
                    for x, v in zip(out, (a, b, j)):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["a", "b", "jaccard"])

    near = written(both.mapInArrow(run, "a long, b long, jaccard double"), "verified")
    lists = members.where("ikey is not null").select("tid", "ikey").distinct()
    same = near.join(lists.withColumnRenamed("tid", "a"), "a").join(lists.withColumnRenamed("tid", "b"), ["b", "ikey"]).select("a", "b").distinct()
    return near.join(same, ["a", "b"], "left_anti"), members.select("doc_id", "tid")


def near_pairs(docs: DataFrame, **options: object) -> DataFrame:
    """(left_id, right_id) of all records, smaller first, whose texts are near each other."""
    near, members = near_texts(docs, **options)
    near = written(near, "near")
    a = members.select(F.col("tid").alias("a"), F.col("doc_id").alias("x"))
    b = members.select(F.col("tid").alias("b"), F.col("doc_id").alias("y"))
    out = near.select("a", "b").join(a, "a").join(b, "b")
    return out.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"))


def near_groups(docs: DataFrame, **options: object) -> DataFrame:
    """(doc_id, group_id, links): each record with enough words, its group and the near texts of its text.

    The group id is the smallest doc_id of the group; copies of one text share
    their group and links. Links between different texts are all counted.
    """
    near, members = near_texts(docs, **options)
    near = written(near, "near")
    comp = connected_components(near, "a", "b").select(F.col("node").alias("tid"), "component")
    links = near.select(F.col("a").alias("tid")).union(near.select("b")).groupBy("tid").agg(F.count("*").alias("links"))
    placed = written(members.join(comp, "tid", "left").join(links, "tid", "left").select("doc_id", F.coalesce("component", "tid").alias("c"), F.coalesce("links", F.lit(0)).alias("links")), "placed")
    first = written(placed.groupBy("c").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("size")), "groups")
    return attach_group(placed, first, ["c"], "size").select("doc_id", "group_id", "links")
