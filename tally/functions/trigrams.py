"""Trigrams that a text must hold for a search pattern to find anything in it.

``required`` walks the parse tree of a pattern and returns a condition over
trigrams: a trigram, ``("all", ...)`` or ``("any", ...)``; an empty "all" means
that nothing is known.  The condition is necessary, never sufficient, so it may
be used to skip texts but not to find them.

Texts are compared after ``folded``: only characters that ignore-case search
takes for equal to an ASCII character are mapped to it, others stay, and only
trigrams of ASCII characters are asked for.
"""

from __future__ import annotations

import string
import warnings
from collections.abc import Callable, Iterator
from functools import reduce
from re import _constants as node
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Capital I with dot, dotless i, long s and the Kelvin sign match i, s and k when case is ignored.
_FROM = string.ascii_uppercase + "İıſK"
_TO = string.ascii_lowercase + "iisk"
_FOLD = str.maketrans(_FROM, _TO)
#: Those of them beyond ASCII, and what they are mapped to.
WIDE_FOLDS = [(a, b) for a, b in zip(_FROM, _TO) if not a.isascii()]
#: Repeats of a fixed number up to this one are written out.
WRITTEN_OUT = 8

Condition = str | tuple


def fold(text: str) -> str:
    return text.translate(_FOLD)


def folded(text: Column) -> Column:
    return F.translate(text, _FROM, _TO)


def trigrams(text: Column) -> Column:
    """Distinct ASCII trigrams of a folded text (null: none)."""
    flat = folded(F.coalesce(text, F.lit("")))
    every = F.transform(F.sequence(F.lit(1), F.length(flat) - 2), lambda i: F.substring(flat, i, F.lit(3)))
    return F.when(F.length(flat) >= 3, F.filter(F.array_distinct(every), lambda t: F.octet_length(t) == 3)) \
        .otherwise(F.array().cast("array<string>"))


def _events(tree) -> Iterator[str | tuple | None]:
    """Characters that follow each other in every match, conditions on what lies
    between them, and None where something unknown does."""
    for op, arg in tree:
        if op is node.LITERAL:
            yield chr(arg) if arg < 128 else None
        elif op in (node.AT, node.ASSERT, node.ASSERT_NOT):
            continue  # no width: what stands before and behind are neighbours
        elif op is node.SUBPATTERN:
            yield from _events(arg[3])
        elif op is node.ATOMIC_GROUP:
            yield from _events(arg)
        elif op in (node.MAX_REPEAT, node.MIN_REPEAT, node.POSSESSIVE_REPEAT) and arg[0] > 0:
            least, most, body = arg
            for _ in range(least if least == most <= WRITTEN_OUT else 1):
                yield from _events(body)
            if not least == most <= WRITTEN_OUT:
                yield None
        elif op is node.BRANCH:
            ways = [_condition(way) for way in arg[1]]
            yield ("any", *ways) if all(w != ("all",) for w in ways) else None
        else:
            yield None


def _condition(tree) -> Condition:
    out: dict[Condition, None] = {}
    run = ""
    for event in _events(tree):
        if isinstance(event, str):
            run = run[-2:] + fold(event)
            if len(run) == 3:
                out[run] = None
        else:
            run = ""
            if event is not None:
                out[event] = None
    return ("all", *out)


def required(pattern: str) -> Condition:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _condition(parser.parse(pattern))


def leaves(condition: Condition) -> list[str]:
    """The trigrams that a condition asks for, each once."""
    if isinstance(condition, str):
        return [condition]
    return list(dict.fromkeys(t for part in condition[1:] for t in leaves(part)))


def evaluate(condition: Condition, has: Callable[[str], Column]) -> Column:
    if isinstance(condition, str):
        return has(condition)
    kind, *parts = condition
    both = (lambda a, b: a & b) if kind == "all" else (lambda a, b: a | b)
    return reduce(both, [evaluate(p, has) for p in parts], F.lit(kind == "all"))
