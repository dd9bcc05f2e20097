"""Edit distance with adjacent transpositions (optimal string alignment)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def osa(a: str, b: str) -> int:
    """Least number of insertions, deletions, replacements and swaps of neighbours, no part edited twice."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


class EditTable:
    """Distances between a query and the beginnings of a candidate that grows, is cut or changes by one symbol at a time.

    One column is kept for each length of the candidate, so that candidates with
    a common beginning share its columns.
    """

    def __init__(self, query: str, candidate: str = ""):
        self.query = query
        self.candidate = ""
        self._columns = [list(range(len(query) + 1))]
        for symbol in candidate:
            self.put(len(self.candidate) + 1, symbol)

    def put(self, length: int, symbol: str) -> int:
        """Make ``symbol`` the last of a candidate of ``length`` symbols, which may add one; the least distance in its column.

        That is the least distance between the candidate and any beginning of
        the query, so a bound below it can be met by no longer candidate. For
        the empty query, which has no beginning but itself, it is the length.
        """
        if not 1 <= length <= len(self.candidate) + 1:
            raise IndexError("a candidate grows by one symbol at a time")
        left = self._columns[length - 1]
        before = self.candidate[length - 2] if length > 1 else None
        column = [length]
        for i, q in enumerate(self.query, 1):
            best = left[i - 1] if q == symbol else 1 + min(left[i - 1], left[i], column[-1])
            if i > 1 and before is not None and (self.query[i - 2], q) == (symbol, before):
                best = min(best, self._columns[length - 2][i - 2] + 1)
            column.append(best)
        self.candidate = self.candidate[: length - 1] + symbol
        self._columns[length:] = [column]
        return min(column[1:], default=length)

    def distance(self, length: int | None = None) -> int:
        """Of the whole query and the first ``length`` symbols of the candidate (default all)."""
        return self._columns[len(self.candidate) if length is None else length][-1]

    def prefix(self, length: int) -> str:
        return self.candidate[:length]

    def __str__(self) -> str:
        """The table for reading: a line for each symbol of the query, a column for each of the candidate."""
        lines = [["", "", *self.candidate]] + [[" " + self.query[i - 1 : i], *(str(c[i]) for c in self._columns)] for i in range(len(self.query) + 1)]
        return "\n".join("".join(x.rjust(4) for x in line).rstrip() for line in lines)


@F.pandas_udf(T.IntegerType())
def _osa_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b)], dtype="Int32")


def edit_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment distance; null if either side is null."""
    return _osa_udf(a, b)


def may_be_within(a: Column, b: Column, bound: int) -> Column:
    """A cheap necessary condition, all in the JVM: lengths, and plain edit distance at most twice the bound."""
    return (F.abs(F.length(a) - F.length(b)) <= bound) & (F.levenshtein(a, b, 2 * bound) >= 0)
