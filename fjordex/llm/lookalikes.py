"""Visually identical text with different characters: confusable skeletons."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fjordex.functions.text import WORD
from fjordex.llm.common import attach_group, latest, latest_rows
from fjordex.session import written

# Letters of other scripts and their Latin look-alikes.
LOOKALIKES = (
    "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv ӏl гr пn "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ԚQ ԜW ѴV ӀI Һh "
    "οo νv αa ρp ιi υu γy σo ϲc ϳj κk "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ "
    "օo ոn սu հh ցg ԍg ɡg ɑa ıi ȷj ɩi ʋu ᴏo ᴄc ᴠv ᴡw ᴢz ꜱs ʏy ℓl ƽs ƨs"
)
_HYPHENS = "‐‑‒–−﹣－⁃"
# Characters without a glyph: soft hyphen, joiners, direction marks, variation selectors and the like.
_HIDDEN = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, 0x3164, 0xFFA0, *range(0xE0000, 0xE1000)]


# Entries that are sent to the workers at once.
MOST_ENTRIES = 200_000
_made: dict = {}


def prototypes() -> dict[int, str]:
    """Code point -> what it looks like. Wide, font and ligature variants follow from their Unicode decompositions."""
    if "table" not in _made:
        _made["table"] = _prototypes()
    return _made["table"]


def _prototypes() -> dict[int, str]:
    out: dict[int, str] = {}
    for c in (*range(0xA0, 0xFFF0), *range(0x1D400, 0x1D800)):
        kind, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
        if kind in ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>"):
            to = "".join(chr(int(x, 16)) for x in rest.split())
            if c not in (0x17F, 0x2116) and not (kind == "<compat>" and to.startswith(" ") and len(to) > 1):
                out[c] = to
        if unicodedata.category(chr(c)) == "Zs":
            out[c] = " "
    out |= {ord(a): b for a, b in LOOKALIKES.split()}
    # a variant of a look-alike letter looks like that letter
    out = {c: "".join(out.get(ord(x), x) for x in to) for c, to in out.items()}
    return out | {ord(c): "-" for c in _HYPHENS} | {c: "" for c in _HIDDEN}


def odd_characters() -> frozenset[str]:
    """Characters that the skeleton may change: those with a prototype, and combining marks."""
    if "odd" not in _made:
        marks = (*range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100), *range(0xFE20, 0xFE30))
        _made["odd"] = frozenset(map(chr, (*prototypes(), *marks)))
    return _made["odd"]


# ASCII characters that look alike in most fonts, with their prototypes.
ASCII_LOOKALIKES = str.maketrans({"I": "l", "1": "l", "|": "l", "0": "O", "m": "rn"})


def skeleton(text: str, ascii_too: bool = False) -> str:
    """Decompose, replace every character by its prototype, decompose again.

    ``ascii_too`` also brings together what within ASCII is told apart by
    context rather than by shape, such as the letter l and the digit 1.
    """
    if ascii_too:
        return skeleton(text).translate(ASCII_LOOKALIKES)
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes()))


def _pieces(text: str) -> tuple[str, list[int]]:
    """Skeleton made character by character, and for each of its characters the place of its origin."""
    out, at = [], []
    for i, c in enumerate(text):
        s = skeleton(c)
        out.append(s)
        at += [i] * len(s)
    return "".join(out), at


def canonical(text: str | None) -> str | None:
    """One consistent form that stays readable.

    Composed, compatibility variants folded, hidden characters removed, spaces
    and hyphens plain; look-alike letters become Latin only in words that also
    hold a Latin letter, so that words wholly of another script stay.
    """
    if text is None or text.isascii():
        return text
    table = prototypes()
    if "plain" not in _made:
        _made["plain"] = {c: to for c, to in table.items() if not to or to in " -" or unicodedata.normalize("NFKC", chr(c)) == to}
    plain = _made["plain"]
    text = unicodedata.normalize("NFKC", text.translate(plain))

    def word(m: re.Match[str]) -> str:
        w = m.group()
        if any("a" <= c.lower() <= "z" for c in w) and not w.isascii():
            return "".join(table.get(ord(c), c) for c in w)
        return w

    return unicodedata.normalize("NFC", WORD.sub(word, text))


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def find_disguised(text: str, finder: object) -> set[int]:
    """Ids of the dictionary entries that some stretch of the text looks like without being the same string."""
    s, at = _pieces(text)
    found: set[int] = set()
    for end, entries in finder.iter(s):
        for ident, entry, size in entries:
            begin = end + 1 - size
            a, b = at[begin], at[end] + 1
            if begin and at[begin - 1] == a or end + 1 < len(s) and (at[end + 1] < b or unicodedata.combining(s[end + 1])):
                continue  # part of what one character stands for, or a mark is added
            if (a and _word(text[a - 1])) or (b < len(text) and _word(text[b])):
                continue
            if text[a:b] != entry:
                found.add(ident)
    return found


def disguised(docs: DataFrame, entries: DataFrame, fields: dict[str, str], id_col: str = "doc_id", order: str = "loaded_at", entry_id: str = "heading_id", entry: str = "body") -> DataFrame:
    """(field_name, doc_id, heading_id): records that hold an entry in other characters.

    ``fields`` says for each field whether the ``whole`` value or a stretch
    (``part``) must look the same. The entries are counted and go to the workers,
    a dictionary of more than MOST_ENTRIES in several blocks and as many scans; nulls and entries of no visible
    character are left out. Null and empty fields hold nothing; of a record
    delivered again the last delivery counts; repeated rows give one row.
    """
    known = entries.select(F.col(entry_id).cast("long").alias("i"), F.col(entry).alias("e")).dropna().distinct()
    blocks = max(1, math.ceil(known.count() / MOST_ENTRIES))
    if blocks > 1:
        parts = (known.where(F.pmod(F.xxhash64("i", "e"), F.lit(blocks)) == k).select(F.col("i").alias(entry_id), F.col("e").alias(entry)) for k in range(blocks))
        return reduce(DataFrame.unionByName, (_disguised(docs, p, fields, id_col, order, entry_id, entry) for p in parts)).distinct()
    return _disguised(docs, entries, fields, id_col, order, entry_id, entry)


def _disguised(docs: DataFrame, entries: DataFrame, fields: dict[str, str], id_col: str, order: str, entry_id: str, entry: str) -> DataFrame:
    rows = [(r[0], r[1]) for r in entries.select(F.col(entry_id).cast("long"), F.col(entry)).dropna().distinct().collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    names = list(fields)
    at = docs.schema[order].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by: dict[str, list[tuple[int, str]]] = {}
        for ident, text in shared.value:
            if skeleton(text).strip():
                by.setdefault(skeleton(text), []).append((ident, text))
        finder = ahocorasick.Automaton()
        for s, same in by.items():
            finder.add_word(s, [(ident, text, len(s)) for ident, text in same])
        if by:
            finder.make_automaton()
        odd = odd_characters()
        odd_entries = any(not odd.isdisjoint(e) for _, e in shared.value)
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            ids, when = b.column(0).to_pylist(), b.column(1)
            picked = []
            for j, name in enumerate(names):
                for i, text in enumerate(b.column(2 + j).to_pylist()):
                    if not text or not by:
                        continue
                    strange = not text.isascii() and not odd.isdisjoint(text)
                    if fields[name] == "whole":
                        hits = {ident for ident, e in by.get(skeleton(text), ()) if e != text}
                    elif strange and next(finder.iter(skeleton(text)), None):
                        hits = find_disguised(text, finder)
                    else:
                        # only an entry itself may be odd here
                        hits = set() if strange or not odd_entries else find_disguised(text, finder)
                    for h in hits:
                        out[0].append(name)
                        out[1].append(ids[i])
                        out[3].append(h)
                        picked.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), when.take(pa.array(picked, pa.int64())), pa.array(out[3], pa.int64())], ["field_name", "doc_id", "at", "heading_id"])

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(order).alias("at"), *(F.col(n) for n in names)]
    found = docs.select(*cols).where("doc_id is not null").mapInArrow(run, f"field_name string, doc_id long, at {at}, heading_id long")
    last = docs.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(order).alias("last"))
    return found.join(last, "doc_id").where("at <=> last").select("field_name", "doc_id", "heading_id").distinct()


def consistent(docs: DataFrame, fields: list[str], id_col: str = "doc_id", order: str = "loaded_at") -> DataFrame:
    """(doc_id, each field in its consistent form and ``<field>_skeleton``) of the last delivery of each record."""
    fix = F.pandas_udf(lambda s: s.map(canonical), T.StringType())
    bare = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else skeleton(x)), T.StringType())
    rows = latest_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(order).alias("_at"), *fields), "doc_id", "_at", *fields)
    cols = []
    for f in fields:
        odd = F.col(f).rlike("[^\\x00-\\x7F]")
        cols += [F.coalesce(fix(F.when(odd, F.col(f))), F.col(f)).alias(f), F.coalesce(bare(F.when(odd, F.col(f))), F.col(f)).alias(f"{f}_skeleton")]
    return rows.select("doc_id", *cols)


def same_looking(docs: DataFrame, fields: list[str], id_col: str = "doc_id", order: str = "loaded_at", ascii_too: bool = False) -> DataFrame:
    """(field_name, doc_id, first_id, records, forms): records whose field looks like another record's but is written differently.

    Values with equal skeletons are one group, named by its smallest record;
    ``forms`` is the number of different strings in it, and groups of one form
    are left out. Skeletons and strings are compared by 128-bit hashes, which are
    made in the scan, so no text is shuffled. Null values, and values without a
    visible character, are in no group; of a record delivered again the last
    delivery counts.
    """
    at = docs.schema[order].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = []
            for f in range(len(fields)):
                texts = b.column(2 + f).to_pylist()
                bare = [None if t is None else skeleton(t, ascii_too) for t in texts]
                cols.append(pa.array([None if s is None or not s.strip() else xxhash.xxh3_128_digest(s) for s in bare], pa.binary()))
                cols.append(pa.array([None if t is None else xxhash.xxh3_128_digest(t) for t in texts], pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "at", *(f"{k}{f}" for f in range(len(fields)) for k in "st")])

    keys = ", ".join(f"s{f} binary, t{f} binary" for f in range(len(fields)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(order).alias("at"), *fields).mapInArrow(run, f"doc_id long, at {at}, {keys}")
    rows = latest(rows, "doc_id", "at", *(f"t{f}" for f in range(len(fields))))
    each = F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(f"s{f}").alias("s"), F.col(f"t{f}").alias("t")) for f, n in enumerate(fields)))
    rows = written(rows.select("doc_id", F.inline(each)).where("s is not null"), "skeletons")
    # strings are counted first, so that copies of one string meet as one row
    forms = rows.groupBy("field_name", "s", "t").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    groups = forms.groupBy("field_name", "s").agg(F.sum("n").alias("records"), F.min("low").alias("first_id"), F.count("*").alias("forms")).where("forms > 1")
    return attach_group(rows, written(groups, "groups"), ["field_name", "s"], "records").select("field_name", "doc_id", "first_id", "records", "forms")
