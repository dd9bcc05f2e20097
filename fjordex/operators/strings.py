"""String search: wildcards, prefixes, fuzzy lookup, phrase prefixes, dictionary scan, minimal windows."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fjordex.functions.distance import edit_distance, may_be_within
from fjordex.functions.text import WORD, needs_exact, py_terms, terms
from fjordex.operators.ranked import clamp
from fjordex.session import written


def wildcard(term: Column, pattern: str) -> Column:
    """X, X*, *X, X*Y, *X* or X*Y*Z (Z may be empty); KeyError for any other pattern.

    X*Y*Z is: starts with X, ends with Z, is long enough for both, and holds Y anywhere.
    """
    parts = pattern.split("*")
    if "\0" in pattern or not any(parts) or len(parts) > 3:
        raise KeyError(f"unsupported pattern {pattern}")
    if len(parts) == 1:
        return term == pattern
    if len(parts) == 2:
        first, last = parts
        return term.startswith(first) & term.endswith(last) & (F.length(term) >= len(first) + len(last))
    first, inner, last = parts
    if not inner or (not first and last):
        raise KeyError(f"unsupported pattern {pattern}")
    return term.startswith(first) & term.endswith(last) & (F.length(term) >= len(first) + len(last)) & term.contains(inner)


def prefixed(entries: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Entries of a dictionary with a prefix, in order."""
    return entries.where(F.col(key).startswith(prefix)).orderBy(key)


def transitions(entries: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """(symbol, final): the characters that may follow a prefix, and whether an entry ends with it."""
    n = len(prefix)
    rows = entries.where(F.col(key).startswith(prefix) & (F.length(key) > n))
    return rows.groupBy(F.substr(F.col(key), F.lit(n + 1), F.lit(1)).alias("symbol")).agg(F.bool_or(F.length(key) == n + 1).alias("final"))


def conflicts(entries: DataFrame, key: str = "key", meta: str = "meta") -> DataFrame:
    """Entries that are given with different metadata."""
    return entries.groupBy(key).agg(F.count_distinct(meta).alias("metas")).where("metas > 1")


def fuzzy(entries: DataFrame, query: str, bound: int = 1, first_n: int = 0, hits: int = 10, scoring: str = "negated", candidates: int = 10_000, key: str = "key") -> DataFrame:
    """(key, distance, score): entries within an edit distance, best scores first, ties in order of the key.

    ``first_n`` leading characters must agree; ``scoring`` is negated,
    normalized (1 - d / longer length) or lopresti (exp(-d / (d - longest
    length))); where that divides by zero the score is null. Only the first ``candidates``
    in order of the key are ranked. Null keys match nothing.
    """
    k, q = F.col(key), F.lit(query)
    rows = entries.where(k.startswith(query[:first_n]) & may_be_within(k, q, bound)).select(k.alias("key")).distinct()
    rows = rows.withColumn("distance", edit_distance(F.col("key"), q)).where(F.col("distance") <= bound)
    d, longest = F.col("distance").cast("double"), F.greatest(F.length("key"), F.lit(len(query))).cast("double")
    score = {"negated": -d, "normalized": 1 - F.try_divide(d, longest), "lopresti": F.exp(-F.try_divide(d, longest - d))}[scoring]
    rows = rows.orderBy("key").limit(candidates).withColumn("score", F.round(score, 6))
    return rows.orderBy(F.col("score").desc_nulls_last(), "key").limit(clamp(hits))


def spaced(text: Column) -> Column:
    """Terms joined by single spaces."""
    return F.array_join(terms(text), " ")


def phrase_prefix(docs: DataFrame, fields: list[str], query: str, hits: int = 10, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score): documents by the number of places where the query begins a run of words, by a scan of the texts.

    The last word may be cut short; occurrences may overlap; none crosses from
    one field into the next. An empty query gives no row; null fields hold
    nothing. Texts that lack a word of the query are put aside before they are split.
    """
    words = py_terms(query)
    needle = " ".join(words)
    if not needle:
        return docs.sparkSession.createDataFrame([], "doc_id long, score long")
    plain = [w for w in words if w.isascii()]

    def may_hold(f: str) -> Column:
        holds = F.lit(True)
        for w in plain:
            holds &= F.lower(f).contains(w)
        return F.coalesce(needs_exact(f) | holds, F.lit(False))

    some = reduce(Column.__or__, (may_hold(f) for f in fields))
    look = r"(?<![\p{L}\p{N}_])(?=" + re.escape(needle) + ")"
    # a zero-width pattern counts overlapping places; a mark that no term holds parts the fields
    hay = F.concat_ws(" \0 ", *(F.coalesce(spaced(F.col(f)), F.lit("")) for f in fields)) if len(fields) > 1 else spaced(F.col(fields[0]))
    rows = docs.where(some).select(F.col(id_col).alias("doc_id"), hay.alias("hay")).where(F.col("hay").contains(needle))
    rows = rows.select("doc_id", F.regexp_count("hay", F.lit(look)).cast("long").alias("score")).where("score > 0")
    return rows.orderBy(F.col("score").desc(), "doc_id").limit(clamp(hits))


def phrase_places(places: DataFrame, query: str, fields: list[int] | None = None, hits: int = 10) -> DataFrame:
    """As ``phrase_prefix``, from an index of positions (term, doc_id, field, pos) instead of the texts.

    Only the rows of the query's words are read. Each says where a phrase that
    it belongs to would begin; a phrase is found where all its words agree.
    """
    words = py_terms(query)
    if not words:
        return places.sparkSession.createDataFrame([], "doc_id long, score long")
    t, last = F.col("term"), len(words) - 1
    offsets = [F.when(t.startswith(w) if i == last else t == w, F.lit(i)) for i, w in enumerate(words)]
    rows = places if fields is None else places.where(F.col("field").isin(fields))
    full = list(dict.fromkeys(words[:-1]))
    rows = rows.where(t.isin(full) | t.startswith(words[-1]) if full else t.startswith(words[-1]))
    begins = rows.select("doc_id", "field", "pos", F.explode(F.array_compact(F.array(*offsets))).alias("i")).select("doc_id", "field", (F.col("pos") - F.col("i")).alias("begin"))
    found = begins.groupBy("doc_id", "field", "begin").agg(F.count("*").alias("n")).where(F.col("n") == len(words))
    return found.groupBy("doc_id").agg(F.count("*").alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(clamp(hits))


# A dictionary of at most so many entries and characters goes to the workers as an automaton; a larger one meets the texts in a join.
MOST_ENTRIES, MOST_CHARACTERS = 200_000, 8_000_000

Spans = Callable[[str], list[tuple[str, int, int]]]  # text -> (token, begin, end)


def word_spans(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer(text)]


def character_spans(text: str) -> list[tuple[str, int, int]]:
    """Every character that is not white space is a token of its own."""
    return [(c, i, i + 1) for i, c in enumerate(text) if not c.isspace()]


def fold_token(token: str) -> str:
    return token.lower() if token.isascii() else unicodedata.normalize("NFKC", token).casefold()


def dictionary_scan(docs: DataFrame, text: str, entries: DataFrame, key: str = "key", meta: str | None = None, id_col: str = "doc_id", spans: Spans = word_spans, normalize: Callable[[str], str] = fold_token, as_join: bool | None = None) -> DataFrame:
    """(doc_id, match, surface, begin, end[, meta]): entries that occur in the texts on token boundaries, overlaps included.

    Entries and texts are compared by their normalised tokens, entries of any
    length; ``match`` is the entry's tokens and ``surface`` those of the text,
    joined by single spaces; ``begin`` and ``end`` count the characters of the text as it
    stands. Tokens are normalised one by one, so that places are kept. Entries with the same tokens but
    different ``meta`` each give a row. Null and token-less texts and entries match nothing.

    The dictionary is counted: a small one is sent to the workers as an
    automaton, which reads a text once however many entries there are; the runs
    of words of a larger one's lengths meet it in a shuffle join. ``as_join``
    forces either way; both give the same rows.
    """
    kind = entries.schema[meta].dataType.simpleString() if meta else None

    def run_of(text: str) -> str:
        return "\1".join(x for x in (normalize(t) for t, _, _ in spans(text)) if x)

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [run_of(x) if x else "" for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array([r.count("\1") + 1 for r in runs], pa.int32()), *b.columns[1:]], ["run", "tokens", *(["meta"] if meta else [])])

    keys = entries.select(F.col(key), *([F.col(meta).alias("meta")] if meta else [])).mapInArrow(to_runs, "run string, tokens int" + (f", meta {kind}" if meta else ""))
    keys = written(keys.where("run <> ''").distinct(), "entries")
    runs = keys.select("run", "tokens").distinct()
    n, size = runs.agg(F.count("*"), F.coalesce(F.sum(F.length("run")), F.lit(0))).first()
    out_type = "doc_id long, run string, surface string, begin int, end int"
    id_type = docs.schema[id_col].dataType.simpleString()
    out_type = out_type.replace("doc_id long", f"doc_id {id_type}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).where("text is not null")

    def tokens_of(x: str) -> tuple[list[str], list[tuple[str, int, int]]]:
        found = [(normalize(t[0]), t) for t in spans(x)]
        return [w for w, _ in found if w], [t for w, t in found if w]

    def batch_of(ids: pa.Array, hits: list[tuple[int, str, str, int, int]]) -> pa.RecordBatch:
        at, *cols = zip(*hits) if hits else ((),) * 5
        arrays = [ids.take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32())))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "run", "surface", "begin", "end"])

    if as_join or (as_join is None and (n > MOST_ENTRIES or size > MOST_CHARACTERS)):
        lengths = [r.tokens for r in runs.select("tokens").distinct().collect()]  # of entries, a handful

        def every_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = []
                for i, x in enumerate(b.column(1).to_pylist()):
                    words, places = tokens_of(x)
                    for m in lengths:
                        for j in range(len(words) - m + 1):
                            hits.append((i, "\1".join(words[j : j + m]), " ".join(t[0] for t in places[j : j + m]), places[j][1], places[j + m - 1][2]))
                    if len(hits) > 100_000:
                        yield batch_of(b.column(0), hits)
                        hits = []
                yield batch_of(b.column(0), hits)

        found = rows.mapInArrow(every_run, out_type).join(keys, "run")
    else:
        shared = docs.sparkSession.sparkContext.broadcast([r.run for r in runs.select("run").collect()])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            finder = ahocorasick.Automaton()
            for r in shared.value:
                finder.add_word(f"\1{r}\1", (r, r.count("\1") + 1))
            if len(finder):
                finder.make_automaton()
            quick = spans is word_spans and normalize is fold_token
            for b in batches:
                hits = []
                for i, x in enumerate(b.column(1).to_pylist() if len(finder) else ()):
                    # the words of an ASCII text are found without their places, which only a text with a hit needs
                    words, places = (py_terms(x), None) if quick and x.isascii() else tokens_of(x)
                    met = list(finder.iter("\1" + "\1".join(words) + "\1"))
                    if not met:
                        continue
                    places = word_spans(x) if places is None else places
                    ends = dict(zip(accumulate(len(w) + 1 for w in words), range(len(words))))  # of tokens in what was searched
                    for end, (r, m) in met:
                        last = ends[end]
                        run = places[last - m + 1 : last + 1]
                        hits.append((i, r, " ".join(t[0] for t in run), run[0][1], run[-1][2]))
                yield batch_of(b.column(0), hits)

        found = rows.mapInArrow(scan, out_type)
        found = found.join(keys.drop("tokens"), "run") if meta else found
    match = F.translate("run", "\1", " ").alias("match")
    return found.select("doc_id", match, "surface", "begin", "end", *(["meta"] if meta else []))


def py_window(tokens: list[str], query: list[str]) -> tuple[int, int, int] | None:
    """(width, first, last) of the narrowest run of tokens that holds the query with multiplicity; the first if several."""
    need = Counter(query)
    missing, left, best = sum(need.values()), 0, None
    if not missing:
        return None
    for right, t in enumerate(tokens):
        if t in need:
            missing -= need[t] > 0
            need[t] -= 1
        while not missing:
            if best is None or right - left + 1 < best[0]:
                best = (right - left + 1, left, right)
            if tokens[left] in need:
                need[tokens[left]] += 1
                missing += need[tokens[left]] > 0
            left += 1
    return best


_WINDOW = T.StructType([T.StructField(c, T.IntegerType()) for c in ("width", "first", "last", "begin", "end")])


def min_window(text: Column, query: str) -> Column:
    """Struct (width, first, last, begin, end) of the narrowest window over the query's terms, its fields null if there is none.

    Width and the numbers of the first and last token count tokens; begin and
    end are places in the text as it stands. Tokens are normalised one by one. An Arrow UDF: the scan keeps state along the tokens.
    """
    wanted = py_terms(query)

    def one(x: str | None) -> tuple:
        places = word_spans(x) if x and wanted else []
        w = py_window([fold_token(t) for t, _, _ in places], wanted)
        return (None,) * 5 if w is None else (*w, places[w[1]][1], places[w[2]][2])

    @F.pandas_udf(_WINDOW)
    def run(s: pd.Series) -> pd.DataFrame:
        found = [one(x) for x in s]
        return pd.DataFrame({c: pd.array([w[i] for w in found], dtype="Int32") for i, c in enumerate(_WINDOW.names)})

    return run(text)


def snippet(text: Column, query: str, widest: int = 75, context: int = 20) -> Column:
    """The text of the narrowest window with up to ``context`` characters on each side; null if there is none or it is too wide."""
    w = min_window(text, query)
    low = F.greatest(w["begin"] - context, F.lit(0))
    return F.when(w["width"] <= widest, F.substr(text, low + 1, w["end"] + context - low))
