"""A small DOM built with the standard library's ``html.parser``.

Just enough for the scraper's selector alternatives: elements with tag,
attributes and children, text in document order, ``get_text(strip=True)``
and "first descendant in document order matching any alternative".
Pure Python, used per page inside ``mapInPandas`` tasks.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
        "source", "track", "wbr"}


class Element:
    __slots__ = ("tag", "attrs", "children", "parent", "classes", "position", "n_elements")

    def __init__(self, tag: str, attrs: dict, parent: "Element | None"):
        self.tag = tag
        self.attrs = attrs
        self.children: list = []
        self.parent = parent
        self.classes = set((attrs.get("class") or "").split())
        self.n_elements = 0
        if parent is None:
            self.position = 1
        else:
            parent.n_elements += 1
            self.position = parent.n_elements  # 1-based among element siblings

    def elements(self):
        """Descendant elements in document order (self excluded)."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def text_parts(self):
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Element):
                stack.extend(reversed(n.children))
            else:
                yield n

    def get_text(self) -> str:
        """Text of all descendants, each piece stripped, empty pieces dropped."""
        return "".join(s for s in (p.strip() for p in self.text_parts()) if s)

    def nth_child(self) -> int:
        """1-based position among the parent's element children."""
        return self.position

    def first(self, match) -> "Element | None":
        for e in self.elements():
            if match(e):
                return e
        return None

    def first_of_each(self, matches: dict) -> dict:
        """{name: first descendant matching matches[name]} in one traversal."""
        found = {}
        todo = dict(matches)
        for e in self.elements():
            for name, m in list(todo.items()):
                if m(e):
                    found[name] = e
                    del todo[name]
            if not todo:
                break
        return found


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {}, None)
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur)
        self.cur.children.append(e)
        if tag not in VOID:
            self.cur = e

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(Element(tag, {k: (v if v is not None else "") for k, v in attrs},
                                         self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def parse(html: str) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def has_class(*names):
    return lambda e: any(n in e.classes for n in names)


def has_attr(name):
    return lambda e: name in e.attrs


def tag_nth(tag, n):
    return lambda e: e.tag == tag and e.position == n


def any_of(*preds):
    def match(e):
        for p in preds:
            if p(e):
                return True
        return False
    return match
