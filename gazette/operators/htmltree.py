"""A page as a flat element table: what the extraction rules ask of a document.

One pass over the page with the standard-library tokenizer and an explicit
stack; nothing recurses, so unclosed or deeply nested tags are just longer
tables. End tags a browser would imply are implied, attribute values and
texts have their entities decoded.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html.parser import HTMLParser

# --- fixed values: the tag sets of the html standard that matter here ---------
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "dd", "details", "dialog", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
         "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
         "td", "tfoot", "th", "thead", "tr", "ul"}
HIDDEN = {"head", "script", "style", "template", "noscript", "title"}
#: tag: (open elements it closes, elements that end the search).
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, {"td", "th", "table"}),
}
PARAGRAPH_ENDS = {"table", "td", "th", "button", "object"}
#: An end tag does not reach past these (a stray </p> in a cell stays there).
SCOPE = {"table", "td", "th", "body", "html"}

BREAK = None  # a line break in the text list
SPACES = re.compile(r"\s+")


class Page(HTMLParser):
    """Elements in document order; element i spans the elements i+1 ..
    ``last[i]``-1 and the texts ``text_at[i]`` .. ``text_to[i]``-1."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.text_at: list[int] = []
        self.text_to: list[int] = []
        self.texts: list[str | None] = []
        self.stack: list[int] = []
        self.hidden = 0
        self.feed(html or "")
        self.close()
        self._pop(0)

    def _pop(self, depth: int) -> None:
        """Close the open elements from ``depth`` up."""
        while len(self.stack) > depth:
            i = self.stack.pop()
            if self.tag[i] in BLOCK:
                self.texts.append(BREAK)
            if self.tag[i] in HIDDEN:
                self.hidden -= 1
            self.last[i], self.text_to[i] = len(self.tag), len(self.texts)

    def _end_open(self, tags: set[str], stop: set[str]) -> None:
        """Close up to the outermost open element of ``tags`` that has no
        element of ``stop`` above it."""
        found = None
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.tag[self.stack[depth]]
            if tag in tags:
                found = depth
                if len(tags) == 1:
                    break
            elif tag in stop:
                break
        if found is not None:
            self._pop(found)

    def handle_starttag(self, tag, attrs):
        if tag in IMPLIED_ENDS:
            self._end_open(*IMPLIED_ENDS[tag])
        if tag in BLOCK:
            self._end_open({"p"}, PARAGRAPH_ENDS)
        if tag == "br" or tag in BLOCK:
            self.texts.append(BREAK)
        i = len(self.tag)
        self.tag.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})
        self.parent.append(self.stack[-1] if self.stack else -1)
        self.last.append(i + 1)
        self.text_at.append(len(self.texts))
        self.text_to.append(len(self.texts))
        if tag not in VOID:
            self.stack.append(i)
            self.hidden += tag in HIDDEN

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, -1, -1):
            own = self.tag[self.stack[depth]]
            if own == tag:
                self._pop(depth)
                return
            if own in SCOPE and tag not in SCOPE:
                return

    def handle_data(self, data):
        if not self.hidden:
            self.texts.append(data)

    # --- questions -------------------------------------------------------------
    def text(self, i: int) -> str:
        """Text content: the texts below the element, nothing added."""
        return "".join(t for t in self.texts[self.text_at[i]:self.text_to[i]] if t is not BREAK)

    def rendered(self, at: int = 0, to: int | None = None) -> str:
        """The visible lines of a run of texts: source white space is one
        space, blocks and <br> break lines, blank lines are dropped."""
        lines, line = [], []
        for t in [*self.texts[at:to], BREAK]:
            if t is BREAK:
                joined = SPACES.sub(" ", "".join(line)).strip()
                if joined:
                    lines.append(joined)
                line = []
            else:
                line.append(t)
        return "\n".join(lines)

    def inner_text(self, i: int) -> str:
        return self.rendered(self.text_at[i], self.text_to[i])

    def has(self, i: int, attribute: str, part: str) -> bool:
        return part in self.attrs[i].get(attribute, "")

    def all(self, *rules) -> list[int]:
        """Elements that meet one of the rules (tag, attribute, part), in
        document order; None stands for any tag or no condition."""
        return [i for i, tag in enumerate(self.tag)
                if any((t is None or t == tag) and (a is None or (a in self.attrs[i] and p in self.attrs[i][a]))
                       for t, a, p in rules)]

    def first_below(self, i: int, found: list[int]) -> int | None:
        """The first of ``found`` (in document order) below element i."""
        k = bisect_left(found, i + 1)
        return found[k] if k < len(found) and found[k] < self.last[i] else None

    def closest(self, i: int, tags: set[str]) -> int | None:
        while i >= 0 and self.tag[i] not in tags:
            i = self.parent[i]
        return i if i >= 0 else None
