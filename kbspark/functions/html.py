"""Wiki storage HTML to elements in page order; the helper of ``sources.html``, which gives them their form.

Structure elements are entered; navigation, scripts and styles are skipped; text that stands directly in a structure
element is dropped. Tags that close nothing cost no walk through the open elements.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from html.parser import HTMLParser

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
IN_HEAD, ENTERED, SKIPPED = {"title", "meta", "link", "script", "style", "base"}, {"tbody", "thead", "section", "article", "main"}, {"nav", "script", "style", "meta"}
#: Open elements that a start tag ends, up to the nearest boundary.
ENDED_BY = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tr", "td", "th"}, {"table"})}
#: Fixed value: the class of notice boxes; other ``div`` elements are entered.
NOTICE_CLASS = "confluence-information-macro"


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def elements(self):
        return [c for c in self.children if isinstance(c, Element)]

    def all(self, *tags: str):
        out, todo = [], self.elements()[::-1]
        while todo:
            e = todo.pop()
            if e.tag in tags:
                out.append(e)
            todo += reversed(e.elements())
        return out

    def text(self) -> str:
        """The text with white space collapsed, but for that in ``pre``; blocks and breaks separate words."""
        out: list[str] = []
        todo: list = [(self, self.tag == "pre")]
        while todo:
            node, keep = todo.pop()
            if isinstance(node, str):
                out.append(node if keep else re.sub(r"[ \t\n\f\r]+", " ", node))
            elif node.tag not in ("script", "style"):
                keep = keep or node.tag == "pre"
                if node.tag == "br" or (node.tag in BLOCKS and out):
                    out.append("\n" if keep and node.tag == "br" else "\u0000")
                todo += [(child, keep) for child in reversed([*node.children, *(["\u0000"] if node.tag in BLOCKS else [])])]
        text = re.sub(r" *\u0000[ \u0000]*", " ", "".join(out))
        return re.sub(r"(?<=\S) {2,}(?=\S)", " ", text).strip(" \t\n\f\r") if self.tag != "pre" else text.strip()


class Builder(HTMLParser):
    """A tree with the implied end tags that pages rely on."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.body, self.head = Element("body", {}), True
        self.open, self.names = [self.body], Counter()

    def close_from(self, at: int) -> None:
        self.names.subtract(e.tag for e in self.open[at:])
        del self.open[at:]

    def outermost(self, ended, stop) -> int:
        """The place of the outermost open element named in ``ended`` above the nearest boundary; behind all if there is none."""
        left, last = sum(self.names[t] for t in ended), len(self.open)
        for i in range(len(self.open) - 1, 0, -1):
            if not left or self.open[i].tag in stop:
                break
            if self.open[i].tag in ended:
                left, last = left - 1, i
        return last

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body", "head"):
            self.head = self.head and tag != "body"
            return
        self.head = self.head and tag in IN_HEAD
        if tag in BLOCKS:
            self.close_from(self.outermost({"p"}, BLOCKS - {"p"}))
        if tag in ENDED_BY:
            self.close_from(self.outermost(*ENDED_BY[tag]))
        e = Element(tag, {k: v or "" for k, v in attrs})
        if not self.head:
            self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)
            self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.close_from(len(self.open) - 1)

    def handle_endtag(self, tag):
        self.head = self.head and tag != "head"
        if self.names[tag]:
            self.close_from(next(i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag))

    def handle_data(self, data):
        if data.strip() and self.head and self.open[-1] is self.body:
            self.head = False
        self.open[-1].children.append(data)


def parse(page: str | None) -> Element:
    builder = Builder()
    builder.feed(re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: entities.escape(m.group(1), quote=False), page or "", flags=re.S))
    builder.close()
    return builder.body


def elements(body: Element) -> list[dict]:
    """(tag, name, text, rows) of the elements with a form: ``name`` is the class, ``rows`` are those of a table or the items of a list."""
    out, todo = [], body.elements()[::-1]
    while todo:
        e = todo.pop()
        name = e.attrs.get("class", "")
        if e.tag in ENTERED or (e.tag == "div" and NOTICE_CLASS not in name):
            todo += reversed(e.elements())
        elif e.tag in ("table", "ul", "ol"):
            found = e.all("tr") if e.tag == "table" else [c for c in e.elements() if c.tag == "li"]
            rows = [{"th": [c.text() for c in r.all("th")], "td": [c.text() for c in r.all("td")]} if e.tag == "table" else {"th": [], "td": [r.text()]} for r in found]
            out.append({"tag": e.tag, "name": name, "text": "", "rows": rows})
        elif e.tag not in SKIPPED:
            out.append({"tag": e.tag, "name": name, "text": e.text(), "rows": []})
    return out


def macros(body: Element) -> list[dict]:
    """(name, text, parameters, cells) of macros: their plain text, and the values of diagram cells in it."""
    out = []
    for m in body.all("ac:structured-macro"):
        text = "\n".join("".join(c for c in b.children if isinstance(c, str)).strip() for b in m.all("ac:plain-text-body")).strip()
        cells = [entities.unescape(v).strip() for v in re.findall(r"<mxCell\b[^>]*?\bvalue=\"([^\"]*)\"", text)]
        out.append({"name": m.attrs.get("ac:name", ""), "text": text, "parameters": [{"name": p.attrs.get("ac:name", ""), "text": p.text()} for p in m.all("ac:parameter")], "cells": cells})
    return out


def images(body: Element) -> list[str]:
    """File names of pictures."""
    return [next((a.attrs.get("ri:filename", "") for a in i.all("ri:attachment")), "") for i in body.all("ac:image")]
