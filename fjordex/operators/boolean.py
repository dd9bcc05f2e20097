"""Boolean search: an expression becomes one predicate over the terms of each document.

Expressions are AND(...), OR(...), ANDNOT(a, b) over quoted or naked literals,
and the expanding operators WILDCARD, SYNONYM, LOOKSLIKE and SOUNDSLIKE. They are
parsed, never evaluated.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordex.functions.distance import edit_distance, may_be_within
from fjordex.functions.phonetic import soundex
from fjordex.functions.text import py_terms
from fjordex.operators.strings import wildcard

EXPANDING = ("WILDCARD", "SYNONYM", "LOOKSLIKE", "SOUNDSLIKE")
MOST_LOOKALIKES = 10


@dataclass
class Node:
    kind: str  # AND, OR, ANDNOT, TERMS, TABLE or one of EXPANDING
    parts: list[Node] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    literal: str = ""
    table: DataFrame | None = None  # (term): what an expansion stands for


_LEAST = {"AND": 1, "OR": 1, "ANDNOT": 2}
_MOST = {"ANDNOT": 2} | dict.fromkeys(EXPANDING, 1)


def parse(expression: str, analyze: Callable[[str], list[str]] = py_terms) -> Node:
    """Expression to nodes; ValueError or SyntaxError with a message for an unsound one."""

    def call(name: str, given: list[ast.AST]) -> Node:
        least, most = _LEAST.get(name, 1), _MOST.get(name, len(given))
        if not least <= len(given) <= most:
            raise ValueError(f"{name} takes {least if least == most else f'{least} or more'} operands, not {len(given)}")
        if name not in EXPANDING:
            return Node(name, [walk(g) for g in given])
        if not isinstance(given[0], (ast.Constant, ast.Name)):
            raise ValueError(f"{name} takes a word or a quoted text")
        literal = str(given[0].value if isinstance(given[0], ast.Constant) else given[0].id)
        if name == "WILDCARD":
            return Node(name, literal=literal)
        return Node(name, terms=words(literal, single=True), literal=literal)

    def words(literal: str, single: bool) -> list[str]:
        found = list(dict.fromkeys(analyze(literal)))
        if not found or (single and len(found) > 1):
            raise ValueError(f"{literal!r} has {len(found)} terms where {'one is' if single else 'at least one is'} needed")
        return found

    def walk(t: ast.AST) -> Node:
        if isinstance(t, ast.Call) and isinstance(t.func, ast.Name) and not t.keywords:
            if t.func.id not in (*_LEAST, *EXPANDING):
                raise ValueError(f"there is no operator {t.func.id}")
            return call(t.func.id, t.args)
        if isinstance(t, ast.Constant):
            return Node("TERMS", terms=words(str(t.value), single=False))
        if isinstance(t, ast.Name):
            return Node("TERMS", terms=words(t.id, single=True))
        raise ValueError(f"{type(t).__name__} is not part of an expression")

    return walk(ast.parse(expression.strip(), mode="eval").body)


def expand(node: Node, vocabulary: DataFrame, synonyms: DataFrame | None = None) -> Node:
    """Expanding operators become tables of terms of the vocabulary, however many those are; an empty one matches nothing."""
    if node.kind == "TERMS":
        return node
    if node.kind not in EXPANDING:
        return Node(node.kind, [expand(p, vocabulary, synonyms) for p in node.parts])
    word = node.terms[0] if node.terms else ""
    t = F.col("term")
    if node.kind == "WILDCARD":
        return Node("TABLE", table=vocabulary.where(wildcard(t, node.literal)).select("term"))
    if node.kind == "SYNONYM":
        found = None if synonyms is None else synonyms.where(F.col("term") == word).select(F.col("synonym").alias("term")).dropna().distinct()
        return Node("TERMS", terms=[word]) if found is None or found.isEmpty() else Node("TABLE", table=found)
    if node.kind == "SOUNDSLIKE":
        # a word that shares its code with no known term is itself unknown
        return Node("TABLE", table=vocabulary.where(soundex(t) == soundex(F.lit(word))).select("term"))
    near = vocabulary.where(may_be_within(t, F.lit(word), 1)).withColumn("d", edit_distance(t, F.lit(word))).where("d <= 1")
    return Node("TABLE", table=near.orderBy("d", "term").limit(MOST_LOOKALIKES).select("term"))


def _leaves(node: Node) -> Iterator[str | Node]:
    """Each literal term, and each table."""
    if node.kind == "TABLE":
        yield node
    yield from node.terms
    for p in node.parts:
        yield from _leaves(p)


def _predicate(node: Node, has: Callable[[str | Node], Column], inside: str = "AND") -> Column:
    """A literal of several terms combines them by the operator around it: all of them, or any within an OR or right of ANDNOT."""
    if node.kind == "TABLE":
        return has(node)
    if node.kind == "ANDNOT":
        return _predicate(node.parts[0], has, "AND") & ~_predicate(node.parts[1], has, "OR")
    how = inside if node.kind == "TERMS" else node.kind
    flags = [has(t) for t in node.terms] + [_predicate(p, has, node.kind) for p in node.parts]
    return reduce(Column.__or__ if how == "OR" else Column.__and__, flags)


_BITS = 60  # leaves in one word of flags


def search(post: DataFrame, expression: str, synonyms: DataFrame | None = None, analyze: Callable[[str], list[str]] = py_terms, vocabulary: DataFrame | None = None) -> DataFrame:
    """(doc_id, error): matching documents by id, or one row with the error of an unsound expression.

    Every literal term and every expansion is a flag. A posting is joined with
    the flags of its term (literals alone are a filter, which reaches the
    scan), a document's flags are combined before the shuffle, and one predicate
    decides. Expansions are tables from start to end, so a pattern that half
    the vocabulary fits is a join like any other. A document without any of the terms can't match.
    """
    spark = post.sparkSession
    try:
        node = parse(expression, analyze)
        if _expands(node):
            node = expand(node, post.select("term").distinct() if vocabulary is None else vocabulary.select("term"), synonyms)
    except (ValueError, SyntaxError, KeyError) as e:
        return spark.createDataFrame([(None, str(e))], "doc_id long, error string")
    places: dict[str | int, int] = {}
    tables: list[DataFrame] = []
    for leaf in _leaves(node):
        key = leaf if isinstance(leaf, str) else id(leaf)
        if key not in places:
            places[key] = len(places)
            if not isinstance(leaf, str):
                tables.append(leaf.table.select("term", F.lit(places[key]).alias("flag")))
    literals = [(t, i) for t, i in places.items() if isinstance(t, str)]
    names = [f"f{k}" for k in range(1 + (len(places) - 1) // _BITS)]

    def words(flag: Column) -> list[Column]:
        return [F.when(F.floor(flag / _BITS) == k, F.call_function("shiftleft", F.lit(1).cast("long"), flag % _BITS)).otherwise(F.lit(0).cast("long")).alias(n) for k, n in enumerate(names)]

    if tables:
        if literals:
            tables.append(spark.createDataFrame(literals, "term string, flag int"))
        flags = reduce(DataFrame.unionByName, tables).select("term", *words(F.col("flag"))).groupBy("term").agg(*(F.bit_or(n).alias(n) for n in names))
        rows = post.join(flags, "term")
    else:
        place = F.create_map(*(F.lit(x) for pair in literals for x in pair))[F.col("term")]
        rows = post.where(F.col("term").isin([t for t, _ in literals])).select("doc_id", place.alias("flag")).select("doc_id", *words(F.col("flag")))
    docs = rows.groupBy("doc_id").agg(*(F.bit_or(n).alias(n) for n in names))

    def has(leaf: str | Node) -> Column:
        i = places[leaf if isinstance(leaf, str) else id(leaf)]
        return F.col(names[i // _BITS]).bitwiseAND(F.lit(1 << i % _BITS).cast("long")) != 0

    return docs.where(_predicate(node, has)).select("doc_id", F.lit(None).cast("string").alias("error")).orderBy("doc_id")


def _expands(node: Node) -> bool:
    return node.kind in EXPANDING or any(_expands(p) for p in node.parts)


def merge(post: DataFrame, left: str, right: str, how: str) -> DataFrame:
    """Documents of two posting lists: ``and``, ``or`` or ``andnot``, each id once."""
    a, b = (post.where(F.col("term") == t).select("doc_id") for t in (left, right))
    return {"and": a.intersect, "or": lambda x: a.union(x).distinct(), "andnot": a.subtract}[how](b)


def check_analyzer(analyze: Callable[[str], list[str]]) -> None:
    """Expansion needs an analyzer that keeps a word one word of its length and is idempotent; ValueError otherwise."""
    for w in ("Glacier", "ferries", "wonderfully", "HARBOUR"):
        once = analyze(w)
        if len(once) != 1 or len(once[0]) != len(w) or analyze(once[0]) != once:
            raise ValueError(f"the analyzer changes {w} to {once}")
