"""Composed regular expressions, and proper-noun-like sequences found by a walk over words."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"(?<!\{)\{([a-z0-9]+)\}")


def compose(grammar: dict, root: str) -> str:
    """The expression of ``root`` with every {name} replaced by its own expression, in a group of its own.

    A fragment is a string, or a dict with ``expression`` and optionally
    ``capture`` (a named group, numbered _1, _2, ... when it occurs again) or
    ``decorate=False`` (no group). {{ and }} stand for braces. KeyError for an
    unknown or circular name, ValueError for a fragment both captured and undecorated.
    """
    used: dict[str, int] = {}

    def text_of(name: str, above: tuple[str, ...]) -> str:
        if name in above:
            raise KeyError(f"{name} is defined by itself")
        if name not in grammar:
            raise KeyError(f"{name} is not defined")
        node = grammar[name]
        raw = node["expression"] if isinstance(node, dict) else node
        # the inner text of a fragment is made once for a mention, the group around it for each mention
        inner = {n: text_of(n, (*above, name)) for n in dict.fromkeys(_NAME.findall(raw))}
        return re.sub(r"\{\{|\}\}|\{([a-z0-9]+)\}", lambda m: m[0][0] if m[1] is None else group(m[1], inner[m[1]]), raw)

    def group(name: str, body: str) -> str:
        node = grammar[name] if isinstance(grammar[name], dict) else {}
        capture, decorate = node.get("capture", False), node.get("decorate", True)
        if capture and not decorate:
            raise ValueError(f"{name} can't be captured without a group")
        if capture:
            k = used[name] = used.get(name, -1) + 1
            return f"(?P<{name}{f'_{k}' if k else ''}>{body})"
        return f"(?:{body})" if decorate else body

    return group(root, text_of(root, ()))


def compose_file(path: str, root: str) -> str:
    """As ``compose``, of a JSON file in which lines that begin with # or // are comments."""
    with open(path, encoding="utf-8") as f:
        return compose(json.loads("".join(x for x in f if not re.match(r"\s*(#|//)", x))), root)


# Words that link the parts of a name, titles before a name, weekdays and months.
LINKS = frozenset("of the and von der de".split())
TITLES = frozenset("Mr Mrs Ms Dr Prof Rev".split())
WEEKDAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".lower().split()
MONTHS = "January February March April May June July August September October November December".lower().split()
# what a date is written with: whole names and their first three letters
_DAY_NAMES = frozenset(WEEKDAYS) | {d[:3] for d in WEEKDAYS}
_MONTH_NAMES = frozenset(MONTHS) | {m[:3] for m in MONTHS}
_WORDS = re.compile(r"\w+")


def _chunks(text: str) -> Iterator[str]:
    """Sentences and paragraphs, with single spaces; the stop after a title ends none."""
    for paragraph in re.split(r"\n\s*\n", text):
        begin = 0
        for mark in re.finditer("[.?!:¿¡]", paragraph):
            at, nxt = mark.start(), paragraph[mark.end() : mark.end() + 1]
            if mark.group() == ".":
                if nxt and not nxt.isspace():
                    continue
                said = _WORDS.findall(paragraph, begin, at) if paragraph[mark.end() :].strip() else []
                if said and said[-1] in TITLES and paragraph[:at].endswith(said[-1]):
                    continue
            yield " ".join(paragraph[begin:at].split())
            begin = mark.end()
        yield " ".join(paragraph[begin:].split())


def _mixed(word: str) -> bool:
    """Letters only, of both cases: an ordinary word with a capital, or a name such as a brand's with one inside."""
    up = sum(c.isupper() for c in word)
    return 0 < up < len(word) and up + sum(c.islower() for c in word) == len(word)


def _names(chunk: str) -> Iterator[str]:
    """Names in the chunk but at its beginning: mixed words in a row, once linked to more of them, with a title before and a number behind."""
    spans = [(m.group(), m.start(), m.end()) for m in _WORDS.finditer(chunk)]
    n = len(spans)

    def run(i: int, fits: Callable[[str], bool], most: int = 1 << 30) -> int:
        """The last word of those that follow word i, each after one space or hyphen, and fit."""
        while most and i + 1 < n and chunk[spans[i][2] : spans[i + 1][1]] in (" ", "-") and fits(spans[i + 1][0]):
            i, most = i + 1, most - 1
        return i

    i = 1 if n and chunk[: spans[0][1]] in ("", '"') else 0
    while i < n:
        head = i
        if spans[i][0] in TITLES and i + 1 < n and chunk[spans[i][2] : spans[i + 1][1]] in (".", ". ", " ") and _mixed(spans[i + 1][0]):
            head = i + 1
        if not _mixed(spans[head][0]):
            i += 1
            continue
        end = run(head, _mixed)
        link = run(end, LINKS.__contains__, 2)
        further = run(link, _mixed) if link > end else link
        end = further if further > link else end
        end = run(end, str.isdecimal, 1)
        yield chunk[spans[i][1] : spans[end][2]]
        i = end + 1


def _is_date(name: str) -> bool:
    first, *more = name.lower().split(" ")
    if first in _MONTH_NAMES:
        return not more or (len(more) == 1 and len(more[0]) == 2 and more[0].isdecimal())
    return first in _DAY_NAMES and not more


def py_proper_nouns(text: str | None, coverage: float = 0.7) -> list[str]:
    out = []
    for chunk in _chunks(text or ""):
        found = list(_names(chunk))
        # a chunk made of names, such as a headline, says nothing
        if sum(map(len, found)) <= coverage * len(chunk):
            out += [x for x in found if not _is_date(x)]
    return out


def proper_nouns(text: Column, coverage: float = 0.7) -> Column:
    """Array of capitalised sequences that do not open a sentence, in order; dates and weekdays are left out.

    A chunk whose matches cover more than ``coverage`` of it gives none. Null
    and empty texts give an empty array. An Arrow UDF: the walk keeps state along the words.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: py_proper_nouns(x, coverage))

    return run(text)
