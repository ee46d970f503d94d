"""Search patterns in Python's dialect, compiled to Java's for ``rlike``.

Filter patterns are written for Python's ``re`` (ignoring case, Unicode rules).
Spark runs ``java.util.regex``, whose ``\\w``, ``\\b``, ``.``, ``$``, classes,
group names and repeats mean something else for some texts, or do not compile.
``java_pattern`` walks the parse tree of Python's own parser and writes each node
so that Java finds the same:

- letters become the class of all characters that Python takes for equal to them,
  so no Java flag is needed; ranges are closed under case in the same way;
- ``\\w``, ``\\d``, ``\\s`` and ``\\b`` use Unicode properties, or ASCII under ``(?a)``;
- ``.`` leaves out the line feed only, ``$`` stands before a last line feed only;
- groups are numbered, so names may hold ``_``; a conditional on a group asks an
  empty group at that group's end;
- every literal is written by its code point, so nothing in a class or after a
  number can be read as syntax.

Known limits: characters that are newer than the JVM's Unicode tables are no
word characters there; a back-reference inside a lookbehind is refused.
"""

from __future__ import annotations

import re
import warnings
from collections import defaultdict
from functools import lru_cache
from re import _constants as node
from re import _parser as parser

_ANY = r"[\x{0}-\x{10FFFF}]"
#: Word, digit and space characters, as the inside of a class: Unicode, ASCII.
_CLASS = {
    "word": (r"\p{L}\p{N}_", "A-Za-z0-9_"),
    "digit": (r"\p{Nd}", "0-9"),
    "space": (r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}", r"\x{9}-\x{D}\x{20}"),
}
_CATEGORY = {
    node.CATEGORY_WORD: ("word", False), node.CATEGORY_NOT_WORD: ("word", True),
    node.CATEGORY_DIGIT: ("digit", False), node.CATEGORY_NOT_DIGIT: ("digit", True),
    node.CATEGORY_SPACE: ("space", False), node.CATEGORY_NOT_SPACE: ("space", True),
}


@lru_cache(maxsize=1)
def _families() -> dict[int, frozenset[int]]:
    """Characters that some case mapping may join, by member."""
    joined: dict[int, set[int]] = defaultdict(set)
    for c in range(0x20000):
        ch = chr(c)
        for other in {x[0] for x in (ch.lower(), ch.upper(), ch.casefold(), ch.title())} - {ch}:
            joined[c].add(ord(other))
            joined[ord(other)].add(c)
    out: dict[int, frozenset[int]] = {}
    for start in joined:
        if start not in out:
            family, todo = {start}, [start]
            while todo:
                new = joined[todo.pop()] - family
                family |= new
                todo += new
            out |= dict.fromkeys(family, frozenset(family))
    return out


@lru_cache(maxsize=4096)
def _equal(c: int, flags: int) -> tuple[int, ...]:
    """Characters that Python's search takes for equal to ``c``."""
    if not flags & re.IGNORECASE:
        return (c,)
    alone = re.compile(re.escape(chr(c)), re.IGNORECASE | flags & re.ASCII)
    return tuple(sorted({c, *(x for x in _families().get(c, ()) if alone.fullmatch(chr(x)))}))


def _char(c: int) -> str:
    return f"\\x{{{c:X}}}"


def _ranges(found: list[tuple[int, int]]) -> str:
    """Inside of a class for inclusive ranges, merged."""
    out: list[list[int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return "".join(_char(a) if a == b else f"{_char(a)}-{_char(b)}" for a, b in out)


def _range(lo: int, hi: int, flags: int) -> list[tuple[int, int]]:
    """A range and the characters equal to one of its own."""
    more = [(x, x) for c in _families() if lo <= c <= hi for x in _equal(c, flags)] if flags & re.IGNORECASE else []
    return [(lo, hi), *more]


class _Writer:
    """Writes one parsed pattern in Java's syntax."""

    def __init__(self, tree):
        self.asked = {av[0] for op, av in _nodes(tree) if op is node.GROUPREF_EXISTS}
        self.number: dict[int, int] = {}  # Python's group -> Java's
        self.marker: dict[int, int] = {}  # Python's group -> the empty group that tells whether it took part
        self.groups = 0

    def all(self, items, flags: int) -> str:
        return "".join(self.one(op, av, flags) for op, av in items)

    def word(self, flags: int) -> str:
        return f"[{_CLASS['word'][bool(flags & re.ASCII)]}]"

    def members(self, items, flags: int) -> str:
        """Alternatives that together match the characters of a set."""
        plain, ranges, apart = "", [], []
        for op, av in items:
            if op is node.LITERAL:
                ranges += [(c, c) for c in _equal(av, flags)]
            elif op is node.RANGE:
                ranges += _range(*av, flags)
            elif op is node.CATEGORY:
                kind, negated = _CATEGORY[av]
                inside = _CLASS[kind][bool(flags & re.ASCII)]
                if negated:
                    apart.append(f"[^{inside}]")
                else:
                    plain += inside
        inside = _ranges(ranges) + plain
        parts = [f"[{inside}]"] * bool(inside) + apart
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    def one(self, op, av, flags: int) -> str:
        if op is node.LITERAL:
            return self.members([(op, av)], flags)
        if op is node.NOT_LITERAL:
            return f"(?:(?!{self.members([(node.LITERAL, av)], flags)}){_ANY})"
        if op is node.ANY:
            return _ANY if flags & re.DOTALL else r"[^\x{A}]"
        if op is node.IN:
            if av[0][0] is node.NEGATE:
                return f"(?:(?!{self.members(av[1:], flags)}){_ANY})"
            return self.members(av, flags)
        if op is node.AT:
            return self.place(av, flags)
        if op is node.BRANCH:
            return f"(?:{'|'.join(self.all(p, flags) for p in av[1])})"
        if op is node.SUBPATTERN:
            group, add, remove, body = av
            flags = (flags & ~re.ASCII if add & re.UNICODE else flags) | add
            flags &= ~remove
            if group is None:
                return f"(?:{self.all(body, flags)})"
            self.groups += 1
            self.number[group] = self.groups
            inside = self.all(body, flags)
            if group in self.asked:
                self.groups += 1
                self.marker[group] = self.groups
                inside = f"(?:{inside})()"
            return f"({inside})"
        if op in (node.MAX_REPEAT, node.MIN_REPEAT, node.POSSESSIVE_REPEAT):
            least, most, body = av
            upto = "" if most is node.MAXREPEAT else int(most)
            kind = {node.MAX_REPEAT: "", node.MIN_REPEAT: "?", node.POSSESSIVE_REPEAT: "+"}[op]
            return f"(?:{self.all(body, flags)}){{{int(least)},{upto}}}{kind}"
        if op is node.ATOMIC_GROUP:
            return f"(?>{self.all(av, flags)})"
        if op is node.GROUPREF:
            same = f"\\{self.number[av]}"
            return f"(?iu:{same})" if flags & re.IGNORECASE else f"(?:{same})"
        if op is node.GROUPREF_EXISTS:
            group, yes, no = av
            if group not in self.marker:  # not closed yet, so it has not taken part
                return self.all(no, flags) if no else ""
            took = f"\\{self.marker[group]}"
            return f"(?:(?:{took}){self.all(yes, flags)}|(?!{took}){self.all(no, flags) if no else ''})"
        if op in (node.ASSERT, node.ASSERT_NOT):
            ahead, body = av
            if ahead < 0 and any(o in (node.GROUPREF, node.GROUPREF_EXISTS) for o, _ in _nodes(body)):
                raise ValueError("a back-reference inside a lookbehind is not supported")
            return f"(?{'' if ahead > 0 else '<'}{'=' if op is node.ASSERT else '!'}{self.all(body, flags)})"
        if op is node.FAILURE:
            return "(?!)"
        raise ValueError(f"unsupported pattern element {op}")

    def place(self, at, flags: int) -> str:
        many, w = flags & re.MULTILINE, self.word(flags)
        if at is node.AT_BEGINNING:
            return r"(?:\A|(?<=\x{A}))" if many else r"\A"
        if at is node.AT_END:
            return r"(?=\x{A}|\z)" if many else r"(?=\x{A}?\z)"
        if at is node.AT_BEGINNING_STRING:
            return r"\A"
        if at is node.AT_END_STRING:
            return r"\z"
        if at is node.AT_BOUNDARY:
            return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
        if at is node.AT_NON_BOUNDARY:  # nowhere in an empty text
            return f"(?:(?<={w})(?={w})|(?<!{w})(?!{w})(?!\\A\\z))"
        raise ValueError(f"unsupported pattern element {at}")


def _nodes(tree):
    """All elements below a parsed pattern."""
    todo = [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, parser.SubPattern):
            todo += list(x)
        elif isinstance(x, (tuple, list)):
            if len(x) == 2 and isinstance(x, tuple) and type(x[0]).__name__ == "_NamedIntConstant":
                yield x
                todo.append(x[1])
            else:
                todo += list(x)


@lru_cache(maxsize=256)
def java_pattern(pattern: str, flags: int = re.IGNORECASE) -> str:
    """Java pattern that is found in a text exactly if ``re.search`` finds
    ``pattern`` under ``flags``. A bad pattern is a ValueError."""
    try:
        with warnings.catch_warnings():  # of possible sets in a later syntax
            warnings.simplefilter("ignore", FutureWarning)
            re.compile(pattern, flags)
            tree = parser.parse(pattern, flags)
    except (re.error, OverflowError, RecursionError) as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from e
    return _Writer(tree).all(tree, tree.state.flags)
