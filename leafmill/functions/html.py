"""HTML to Markdown by the standard library's parser: headings, paragraphs, lists, links, images, code, quotes, tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_SKIPPED = {"script", "style", "head", "template", "noscript", "title"}
_BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "figure", "form", "dl", "dt", "dd", "address", "body", "html"}
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`", "del": "~~", "s": "~~", "strike": "~~"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Writer(HTMLParser):
    """Keeps a stack of open elements, each with the text written in it so far; closing one hands its Markdown up."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = [["", {}, []]]

    def say(self, text: str) -> None:
        self.stack[-1][2].append(text)

    def inside(self, *tags: str) -> bool:
        return any(t in tags for t, _, _ in self.stack)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or re.fullmatch(r"h[1-6]", tag):
            self._end_open(tag)
        if tag == "br":
            self.say("  \n")
        elif tag == "hr":
            self.say("\n\n---\n\n")
        elif tag == "img":
            self.say(f"![{a.get('alt', '')}]({a.get('src', '')})")
        elif tag not in _VOID:
            self.stack.append([tag, a, []])

    def _end_open(self, tag: str) -> None:
        """An element whose end tag may be left out ends where the next of its kind starts."""
        ends = {"li": ("li", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",)}.get(tag, ("p",))
        walls = {"ul", "ol", "table", "dl", "select", "div", "section", "article", "blockquote", "body"}
        place = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in walls:
                break
            if self.stack[i][0] in ends:
                place = i
        if place is not None:
            while len(self.stack) > place:
                self._close()

    def handle_endtag(self, tag):
        if tag in _VOID or not any(t == tag for t, _, _ in self.stack[1:]):
            return
        while self.stack[-1][0] != tag:
            self._close()
        self._close()

    def handle_data(self, data):
        if self.inside(*_SKIPPED):
            return
        self.say(data if self.inside("pre") else re.sub(r"\s+", " ", data))

    def _close(self) -> None:
        tag, attrs, parts = self.stack.pop()
        self.say(self._written(tag, attrs, "".join(parts)))

    def _written(self, tag: str, attrs: dict, inner: str) -> str:
        if tag in _SKIPPED:
            return ""
        if tag in _MARKS and not self.inside("pre"):
            bare = inner.strip()
            lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
            return f"{lead}{_MARKS[tag]}{bare}{_MARKS[tag]}{tail}" if bare else inner
        if re.fullmatch(r"h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {' '.join(inner.split())}\n\n" if inner.strip() else ""
        if tag == "a":
            return f"[{inner.strip()}]({attrs['href']})" if attrs.get("href") and inner.strip() else inner
        if tag == "pre":
            return "\n\n```\n" + inner.strip("\n") + "\n```\n\n"
        if tag == "li":
            return "\0" + re.sub(r"\n{2,}", "\n", inner).strip().replace("\n", "\n  ") + "\n"
        if tag in ("ul", "ol"):
            first = int(attrs["start"]) if attrs.get("start", "").isdigit() else 1
            items = [x.rstrip("\n") for x in inner.split("\0")[1:]]
            lines = [f"{first + i}. {x}" if tag == "ol" else f"* {x}" for i, x in enumerate(items)]
            return "\n\n" + "\n".join(lines) + "\n\n"
        if tag == "blockquote":
            return "\n\n" + "\n".join("> " + line for line in inner.strip().split("\n")) + "\n\n"
        if tag in ("td", "th"):
            return "\1" + " ".join(inner.split()).replace("|", "\\|")
        if tag == "tr":
            return "\2" + inner
        if tag == "table":
            rows = [[c.strip() for c in r.split("\1")[1:]] for r in inner.split("\2")[1:]]
            rows = [r for r in rows if r]
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            return "\n\n" + "\n".join(lines[:1] + ["|" + " --- |" * width] + lines[1:]) + "\n\n" if rows else ""
        return f"\n\n{inner}\n\n" if tag in _BLOCKS else inner


def to_markdown(html: str | None) -> str:
    """Markdown of a page; null and empty pages give an empty text, elements that are left open end with their parents."""
    w = _Writer()
    w.feed(html or "")
    w.close()
    while len(w.stack) > 1:
        w._close()
    out = re.sub(r"[\0\1\2]", " ", "".join(w.stack[0][2]))
    fenced = re.split(r"(```\n.*?\n```)", out, flags=re.S)
    for i in range(0, len(fenced), 2):
        lines = [re.sub(r"^ (?! )", "", x) if not x.startswith("  ") else x for x in fenced[i].split("\n")]
        fenced[i] = re.sub(r"\n{3,}", "\n\n", "\n".join(x if x.endswith("  ") and x.strip() else x.rstrip() for x in lines))
    return re.sub(r"\n{3,}", "\n\n", "".join(fenced)).strip()


def title(html: str | None) -> str:
    found = re.search(r"(?is)<title[^>]*>(.*?)</title>", html or "")
    return found[1].strip() if found else "No title"
