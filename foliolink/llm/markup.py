"""A forward scanner of HTML tags that never reads a part of a page twice."""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select option".split())
#: Those of them that without an end tag go on to the end of the page; others lose only their own tag.
UNENDING = frozenset("script style title textarea".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r">|=\s*+([\"'])")


class Tags:
    """The tags of a page in order; :meth:`skip_raw` leaves out what an element without text holds.

    Work is linear in the page, however broken it is: a quoted value counts only if its quote
    is closed; once a quoted value has swallowed the rest of the page, quotes no longer count;
    where no ``>`` follows, no tag does; and an end tag that wasn't found is not looked for again.
    """

    def __init__(self, markup: str):
        self.markup, self.at = markup, 0
        self._last = {q: markup.rfind(q) for q in "\"'"}
        self._last_close = markup.rfind(">")
        self._quotes = True
        self._lower: str | None = None
        self._never: set[str] = set()

    def _end(self, start: int) -> int:
        """Place behind the tag that begins at ``start``, before which a ``>`` must follow."""
        at = start
        while self._quotes:
            stop = _STOP.search(self.markup, at)
            if stop is None:
                self._quotes = False
                break
            if stop[1] is None:
                return stop.end()
            at = stop.end()
            if self._last[stop[1]] >= at:
                at = self.markup.find(stop[1], at) + 1
        return self.markup.find(">", start) + 1

    def __iter__(self) -> Iterator[tuple[int, str, bool, str]]:
        """``(where text before the tag ends, name, whether an end tag, attributes)``; :attr:`at` is where text goes on."""
        page = self.markup
        look = 0
        while True:
            look = max(look, self.at)
            start = page.find("<", look)
            if start < 0 or start > self._last_close:
                return
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                self.at = len(page) if end < 0 else end + 3
                yield start, "", False, ""
            elif page[start + 1 : start + 2] in ("!", "?"):
                self.at = page.find(">", start) + 1
                yield start, "", False, ""
            elif name := _NAME.match(page, start, self._end(start) if page[start + 1 : start + 3].lstrip("/")[:1].isalpha() else start):
                self.at = self._end(start)
                yield start, name[1].lower(), page[start + 1] == "/", page[name.end() : self.at - 1]
            else:
                look = start + 1

    def skip_raw(self, name: str, attrs: str) -> None:
        """Go behind the end tag of the RAW element ``name`` that has just begun."""
        page = self.markup
        if attrs.endswith("/") and name in ("svg", "math", "iframe"):
            return
        if name == "option":  # holds text only, and its end tag is optional
            after = page.find("<", self.at)
            self.at = len(page) if after < 0 else after
            return
        if name not in self._never:
            if self._lower is None:
                lowered = page.lower()
                self._lower = lowered if len(lowered) == len(page) else "".join(c if len(c.lower()) != 1 else c.lower() for c in page)
            end = self._lower.find(f"</{name}", self.at)
            if end >= 0:
                stop = page.find(">", end)
                self.at = len(page) if stop < 0 else stop + 1
                return
            self._never.add(name)
        if name in UNENDING:
            self.at = len(page)


def text_of(markup: str | None) -> str:
    """The text of a page, menus and all, without scripts, styles, comments and tags; references decoded."""
    tags, pieces, at = Tags(markup or ""), [], 0
    for before, name, ending, attrs in tags:
        pieces.append(tags.markup[at:before])
        if name in ("script", "style") and not ending:
            tags.skip_raw(name, attrs)
        at = tags.at
    pieces.append(tags.markup[at:])
    return html_entities.unescape(" ".join(pieces))
