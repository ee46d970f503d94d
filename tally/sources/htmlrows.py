"""Cells of the row elements of plainly written pages, in one pass without a tree.

``PLAIN`` says which pages those are: lower-case tags, attributes in double
quotes, no comments, no elements whose content is not markup.  On such a page
``html.parser`` reports just its tags and the texts between them, so what
``htmldom`` would build is known from a stack of open elements, and rows and
cells are the ones that its tree gives.  Any other page is left to ``htmldom``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape

from tally.sources import htmldom as D

_TEXT = r"[^<]*+"
_OPAQUE = "script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext"
PLAIN = re.compile(rf"""(?:<!DOCTYPE\ html>)?+(?:<(?:title>[^<&]*+</title
    |/(?!(?:{_OPAQUE})>)[a-z][a-z0-9]*+
    |(?!(?:{_OPAQUE})[\ >])[a-z][a-z0-9]*+(?:\ [a-z][a-z0-9_-]*+="[^"&<>]*+")*+)>{_TEXT})*+(?<=>)""", re.VERBOSE)
_ATTRIBUTE = re.compile(r' ([a-z][a-z0-9_-]*+)="([^"]*+)"')
_DOCTYPE = "<!DOCTYPE html>"
#: Tags whose matches are kept, at most.
_KNOWN = 1 << 14


class RowScanner:
    """Rows by ``row_match`` and their first cell of each of ``cells``."""

    def __init__(self, row_match: Callable, cells: dict[str, Callable]):
        self.row_match, self.cells = row_match, list(cells.values())
        self.known: dict[tuple[str, int], tuple] = {}

    def _kind(self, tag: str, position: int) -> tuple:
        """Name, whether it stays open, whether it is a row, and which cells a tag can be."""
        name = tag.partition(" ")[0]
        e = D.Element(name, dict(_ATTRIBUTE.findall(tag)), None)
        e.position = position
        found = name, name not in D.VOID, self.row_match(e), tuple(i for i, m in enumerate(self.cells) if m(e))
        if len(self.known) >= _KNOWN:
            self.known.clear()
        self.known[tag, position] = found
        return found

    def rows(self, html: str | None) -> list[list[str | None]] | None:
        """Cell texts of each row, None for cells it lacks; None if the page is not plain."""
        if not html:
            return []
        if not PLAIN.fullmatch(html):
            return None
        known, none = self.known, [None] * len(self.cells)
        rows: list[list] = []           # of each row, the pieces of its cells
        names, counts = [""], [0]       # open elements: name, elements in it so far,
        inside, caught = [[]], [[]]     # the rows and the cells that it is in
        for part in html.removeprefix(_DOCTYPE).split("<"):
            tag, _, text = part.partition(">")
            if tag[:1] == "/":
                name = tag[1:]
                if names[-1] == name:
                    del names[-1], counts[-1], inside[-1], caught[-1]
                elif name in names:
                    at = len(names) - 1 - names[::-1].index(name)
                    del names[at:], counts[at:], inside[at:], caught[at:]
            elif tag:
                counts[-1] += 1
                kind = known.get((tag, counts[-1])) or self._kind(tag, counts[-1])
                name, stays, is_row, cells = kind
                around, pieces = inside[-1], caught[-1]
                if cells and around:
                    for row in around:
                        fresh = [i for i in cells if row[i] is None]
                        if fresh:
                            own: list[str] = []
                            for i in fresh:
                                row[i] = own
                            pieces = [*pieces, own]
                if is_row:
                    rows.append(none.copy())
                    around = [*around, rows[-1]]
                if stays:
                    names.append(name)
                    counts.append(0)
                    inside.append(around)
                    caught.append(pieces)
            if text and caught[-1]:
                bare = (unescape(text) if "&" in text else text).strip()
                if bare:
                    for own in caught[-1]:
                        own.append(bare)
        return [[None if c is None else "".join(c) for c in row] for row in rows]
