"""A small element tree, and the rows of tables, over the standard HTML parser, for use inside tasks."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style", "template"))
#: Elements whose content HTMLParser reads by other rules; which they are depends on its version.
RAW = frozenset((*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext"))
#: What may stand between < and > in plain markup: a name, and values in double quotes without references; or a comment
#: without hyphens, or a doctype. HTMLParser reads these the same way, only slower.
PLAIN_TAG = re.compile(r'(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\r\n]+[a-zA-Z][a-zA-Z0-9-]*="[^"&]*")*)[ \t\r\n]*(/?)')
PLAIN_VALUE = re.compile(r'([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)"')
PLAIN_REST = re.compile(r"!--[^-]*--|!(?:doctype|DOCTYPE)[^>]*")


class Element:
    def __init__(self, name: str, attributes: dict[str, str | None], parent: Element | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Element | str] = []

    def strings(self) -> list[str]:
        """Non-blank texts below, trimmed, in order; none of scripts."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                if text := node.strip():
                    out.append(text)
            elif node is self or node.name not in SILENT:
                stack.extend(reversed(node.children))
        return out

    def text(self) -> str:
        return " ".join(self.strings())

    def walk(self):
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))

    def above(self, names: frozenset[str]) -> Element | None:
        node = self.parent
        while node is not None and node.name not in names:
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        element = Element(tag, dict(attrs), self.at)
        self.at.children.append(element)
        if tag not in VOID:
            self.at = element

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.name != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parsed(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


class TableRows:
    """Takes tags and texts in document order. ``rows``: those of all tables, with the cells right below them and the links
    of each. A text is made when its element ends; what scripts hold is only in texts of elements inside them."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.links: list[dict] = []
        self.texts: list[str] = []
        self.inside: list[tuple] = []

    def open(self, tag: str, attributes: dict[str, str | None], whole: bool) -> None:
        made = None
        if tag == "td" or tag == "th":
            if self.inside and self.inside[-1][0] == "tr":
                made = {"text": "", "links": []}
                self.inside[-1][1]["cells"].append(made)
        elif tag == "a":
            if "href" in attributes:
                made = {"text": "", "href": attributes["href"] or ""}
                self.links.append(made)
        elif tag == "tr":
            made = {"text": "", "cells": []}
            self.rows.append(made)
        if not whole:
            self.inside.append((tag, made, self.texts, len(self.texts), len(self.links)))
            if tag in SILENT:
                self.texts = []

    def leaf(self, tag: str, attributes: dict[str, str | None], data: str) -> None:
        """An element, not of a script, that holds one text: open, add and close in one step."""
        if text := data.strip():
            self.texts.append(text)
        if tag == "td" or tag == "th":
            if self.inside and self.inside[-1][0] == "tr":
                self.inside[-1][1]["cells"].append({"text": text, "links": []})
        elif tag == "a":
            if "href" in attributes:
                self.links.append({"text": text, "href": attributes["href"] or ""})
        elif tag == "tr":
            self.rows.append({"text": text, "cells": []})

    def close(self, tag: str) -> None:
        for n in range(len(self.inside) - 1, -1, -1):
            if self.inside[n][0] == tag:
                return self.leave(n)

    def leave(self, n: int) -> None:
        """Ends all elements but the n outermost."""
        for _ in range(len(self.inside) - n):
            _, made, self.texts, text, link = self.inside.pop()
            if made is not None:
                made["text"] = " ".join(self.texts[text:])
                if "links" in made:
                    made["links"] = self.links[link:]

    def add(self, data: str) -> None:
        if text := data.strip():
            self.texts.append(text)


class _Rows(HTMLParser):
    def __init__(self, out: TableRows) -> None:
        super().__init__(convert_charrefs=True)
        self.out = out

    def handle_starttag(self, tag, attrs):
        self.out.open(tag, dict(attrs), tag in VOID)

    def handle_startendtag(self, tag, attrs):
        self.out.open(tag, dict(attrs), True)

    def handle_endtag(self, tag):
        self.out.close(tag)

    def handle_data(self, data):
        self.out.add(data)


def plain_tag(text: str) -> tuple[int, str, dict[str, str]] | None:
    """Kind (0 none, 1 start, 2 whole, 3 end), name and attributes of what stands between < and >; None if it is not plain."""
    found = PLAIN_TAG.fullmatch(text)
    if not found:
        return (0, "", {}) if PLAIN_REST.fullmatch(text) else None
    end, tag, values, slash = found.groups()
    tag = tag.lower()
    if end:
        return None if values or slash else (3, tag, {})
    attributes = {k.lower(): v for k, v in PLAIN_VALUE.findall(values)} if values else {}
    return None if tag in RAW else (2 if slash or tag in VOID else 1, tag, attributes)


#: Tags without attributes, which are most.
BARE_TAGS = {f"{end}{tag}": plain_tag(f"{end}{tag}") for tag in "a b body br div em h1 h2 h3 h4 head html i li ol p span strong table tbody td tfoot th thead title tr u ul".split() for end in ("", "/")}


def plain_rows(html: str) -> TableRows | None:
    """The rows of a page of plain markup, else None. A > or < in a value leaves its quotes open, so such a tag is not plain."""
    out = TableRows()
    open, leaf, close, add = out.open, out.leaf, out.close, out.add
    first, *parts = html.split("<")
    add(unescape(first))
    ended = False
    for part, after in zip(parts, [*parts[1:], ""], strict=False):
        text, closed, data = part.partition(">")
        if "&" in data:
            data = unescape(data)
        if ended:  # the end tag of a leaf
            ended = False
        else:
            tag = BARE_TAGS.get(text) or plain_tag(text)
            if not tag or not closed:
                return None
            kind, name, attributes = tag
            if kind == 1 and after.startswith(f"/{name}>") and name not in SILENT:
                leaf(name, attributes, data)
                ended = True
                continue
            if kind == 3:
                close(name)
            elif kind:
                open(name, attributes, kind == 2)
        if data:
            add(data)
    return out


def rows_of(html: str | None) -> list[dict]:
    """Rows of all tables (text, cells (text, links (text, href))) in document order."""
    out = plain_rows(html or "")
    if out is None:
        out = TableRows()
        parser = _Rows(out)
        parser.feed(html or "")
        parser.close()
    out.leave(0)
    return out.rows
