"""Article XML to typed blocks: sections, paragraphs, labelled lists, tables with merged headers and row groups,
figures, equations, references."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

LABEL_MOST = 200

CELL = "struct<col:string,val:string>"
BLOCK_SCHEMA = (
    "document_id string, title string, block_seq int, section_path array<string>, block_type string, original_type string, source_id string, label string, content string, "
    f"columns array<string>, rows array<struct<label:string,group_path:array<string>,cells:array<{CELL}>>>, footnotes array<struct<marker:string,text:string>>, refs array<string>, error string"
)


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _text(e: ET.Element | None, skip: tuple[str, ...] = ()) -> str:
    """All text of an element, in order, without what stands in elements named in skip; of any depth."""
    if e is None:
        return ""
    parts, todo = [], [(e, True)]
    while todo:
        x, begins = todo.pop()
        if not begins:
            parts.append(x.tail or "")
            continue
        parts.append(x.text or "")
        for c in reversed(x):
            todo.append((c, False))
            if _name(c) not in skip:
                todo.append((c, True))
    return "".join(parts)


def _clean(s: str) -> str:
    return " ".join(s.replace("\u00a0", " ").split())


def _first(e: ET.Element, *names: str) -> ET.Element | None:
    return next((x for x in e.iter() if _name(x) in names), None)


def _grid(rows: list[ET.Element]) -> list[list[str]]:
    """Cell texts with column and row spans filled in; a leading em space, which marks depth, stays."""
    grid: list[list[str]] = []
    hanging: dict[int, tuple[int, str]] = {}
    for r in rows:
        line: list[str] = []
        cells = [c for c in r if _name(c) in ("td", "th")]
        while cells or len(line) in hanging:
            at = len(line)
            if at in hanging:
                left, text = hanging.pop(at)
                line.append(text)
                if left > 1:
                    hanging[at] = left - 1, text
                continue
            cell = cells.pop(0)
            raw = _text(cell).replace("\u00a0", " ")
            text = re.match("^\u2003*", raw.lstrip(" \n\t"))[0] + _clean(raw)
            wide, high = (int(cell.get(k) or 1) if (cell.get(k) or "1").isdigit() else 1 for k in ("colspan", "rowspan"))
            for k in range(max(1, wide)):
                line.append(text)
                if high > 1:
                    hanging[at + k] = high - 1, text
        grid.append(line)
    return grid


def _table(e: ET.Element) -> dict:
    head, body = _first(e, "thead"), _first(e, "tbody")
    tops = _grid([r for r in head if _name(r) == "tr"]) if head is not None else []
    lines = _grid([r for r in (body if body is not None else e).iter() if _name(r) == "tr"])
    if not tops and lines:
        tops, lines = lines[:1], lines[1:]
    width = max([len(x) for x in tops + lines], default=0)
    columns = []
    for c in range(width):  # distinct names of the header rows, top to bottom
        names = list(dict.fromkeys(t[c].strip("\u2003 ") for t in tops if c < len(t) and t[c].strip("\u2003 ")))
        columns.append(" - ".join(names) or f"column_{c}")
    rows, path = [], []
    for line in lines:
        if not any(x.strip("\u2003 ") for x in line):
            continue
        depth = len(line[0]) - len(line[0].lstrip("\u2003"))
        label = line[0].strip("\u2003 ")
        alone = label and (not any(x.strip() for x in line[1:]) or len(line) > 1 and set(line) == {line[0]})
        path = [p for p in path if p[0] < depth] if depth or alone else ([p for p in path if p[0] == 0 and p[2]] if path else [])
        if alone:
            path = [p for p in path if p[0] < depth] + [(depth, label, True)]
            continue
        cells = [{"col": columns[k], "val": x.strip("\u2003 ")} for k, x in enumerate(line) if k]
        rows.append({"label": label, "group_path": [p[1] for p in path], "cells": cells})
    notes = []
    foot = _first(e, "table-wrap-foot")
    for f in foot.iter() if foot is not None else ():
        if _name(f) == "fn":
            mark = next((x for x in f if _name(x) in ("label", "sup")), None)
            notes.append({"marker": _clean(_text(mark)), "text": _clean(_text(f, ("label",)))})
    return {"columns": columns, "rows": rows, "footnotes": notes}


def _is_label(p: ET.Element) -> bool:
    """A short paragraph that is bold or ends with a colon announces the list after it."""
    text = _clean(_text(p))
    bold = len(p) == 1 and _name(p[0]) in ("bold", "b") and not _clean((p.text or "") + (p[0].tail or ""))
    return 0 < len(text) <= LABEL_MOST and (bold or text.endswith(":"))


class _Recovering(HTMLParser):
    """A tree of broken XML: tags that are not closed end with what holds them, closing tags without a start go."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: ET.Element | None = None
        self.open: list[ET.Element] = []
        self.names: Counter[str] = Counter()  # of the open elements: an end tag without a start is not searched for

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = ET.Element(tag.rsplit(":", 1)[-1], {k: v or "" for k, v in attrs})
        if self.open:
            self.open[-1].append(e)
        elif self.root is None:
            self.root = e
        else:
            return
        self.open.append(e)
        self.names[e.tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        name = tag.rsplit(":", 1)[-1]
        while self.names[name] and self.open:
            last = self.open.pop()
            self.names[last.tag] -= 1
            if last.tag == name:
                break

    def handle_data(self, data: str) -> None:
        if self.open:
            e = self.open[-1]
            if len(e):
                e[-1].tail = (e[-1].tail or "") + data
            else:
                e.text = (e.text or "") + data


def parse_tree(xml: str) -> tuple[ET.Element | None, str | None]:
    """(root, error): the tree of an article; of a broken one what can be recovered, with the error."""
    text = re.sub(r"<!DOCTYPE[^>]*>", "", xml or "").strip()
    try:
        return ET.fromstring(text), None
    except ET.ParseError as e:
        reader = _Recovering()
        reader.feed(re.sub(r"<\?xml[^>]*\?>", "", text))
        reader.close()
        return (reader.root if reader.root is not None and len(reader.root) else None), str(e)


def article_id(root: ET.Element, name: str) -> str:
    """The article's own id, else the file's name without its ending."""
    ids = [x for x in root.iter() if _name(x) == "article-id"]
    return next((_clean(_text(x)) for x in ids if x.get("pub-id-type") in ("pmc", "pmcid")), None) or re.sub(r"\.(?:n?xml)$", "", name.rsplit("/", 1)[-1])


@dataclass(frozen=True)
class _Place:
    """A section's title below another one's; a path of any depth is written out only for the blocks in it."""

    title: str
    above: _Place | None = None

    def path(self) -> list[str]:
        out, at = [], self
        while at is not None:
            out.append(at.title)
            at = at.above
        return out[::-1]


# Elements by what they are to the reading of an article.
SECTIONS = {"sec": "Section", "boxed-text": "Section", "app": "Section", "ack": "Acknowledgements", "notes": "Section", "glossary": "Section"}
CONTAINERS = ("fig-group", "floats-group", "body", "back", "app-group")
SILENT = ("title", "label", "sec-meta", "")
FLOATING = ("fig", "table-wrap", "disp-formula", "list")
LOOSE = {"body": "Body", "back": "Back Matter"}


class _Reader:
    """Collects the blocks of one article. Elements wait on a stack, so nesting of any depth is read."""

    def __init__(self, document_id: str, title: str) -> None:
        self.document_id, self.title = document_id, title
        self.out: list[dict] = []

    def add(self, e: ET.Element, place: _Place | None, kind: str, content: str, **more) -> None:
        refs = [r for x in e.iter() if _name(x) == "xref" for r in (x.get("rid") or "").split()]
        blank = {k: None for k in ("label", "columns", "rows", "footnotes", "error")}
        own = {"document_id": self.document_id, "title": self.title, "block_seq": len(self.out), "section_path": place.path() if place else [], "block_type": kind, "original_type": _name(e), "source_id": e.get("id"), "content": content}
        self.out.append({**blank, **own, "refs": list(dict.fromkeys(refs)), **more})

    def read(self, elements: list[ET.Element], place: _Place | None, loose: str | None = None) -> None:
        """The blocks of sibling elements and of what is in them, in reading order; loose names the section of text that stands in none."""
        todo: list[tuple[list[ET.Element], int, _Place | None]] = [(elements, 0, place)]
        while todo:
            siblings, k, at = todo.pop()
            if k == len(siblings):
                continue
            todo.append((siblings, k + 1, at))
            inner, below = self.block(siblings, k, at, _Place(loose) if at is None and loose else at)
            if inner:
                todo.append((inner, 0, below))

    def block(self, siblings: list[ET.Element], k: int, at: _Place | None, text_at: _Place | None) -> tuple[list[ET.Element], _Place | None]:
        """Adds what an element is itself; returns the elements in it that are read next, and where."""
        e = siblings[k]
        tag = _name(e)
        label = lambda: _clean(_text(_first(e, "label"))) or None
        caption = lambda: _clean(_text(_first(e, "caption")))
        if tag in SILENT:
            return [], None
        if tag in SECTIONS:
            heading = _clean(_text(next((x for x in e if _name(x) == "title"), None)))
            return list(e), _Place(heading or SECTIONS[tag], at)
        if tag in CONTAINERS:
            return list(e), at
        if tag == "p":
            if k + 1 < len(siblings) and _name(siblings[k + 1]) == "list" and _is_label(e):
                return [], None
            if text := _clean(_text(e, FLOATING)):
                self.add(e, text_at, "paragraph", text)
            return [x for x in e if _name(x) in FLOATING], at
        if tag == "list":
            before = siblings[k - 1] if k and _name(siblings[k - 1]) == "p" and _is_label(siblings[k - 1]) else None
            items = [_clean(_text(x)) for x in e if _name(x) == "list-item"]
            self.add(e, text_at, "list", "\n".join(f"- {x}" for x in items if x), label=_clean(_text(before)) if before is not None else None)
        elif tag == "table-wrap":
            drawn = _first(e, "graphic", "inline-graphic") is not None and _first(e, "tr") is None  # a table given as a picture
            self.add(e, at, "table", caption(), label=label(), **({"columns": [], "rows": [], "footnotes": _table(e)["footnotes"]} if drawn else _table(e)))
        elif tag in ("fig", "supplementary-material"):
            self.add(e, at, "figure" if tag == "fig" else "supplementary", caption(), label=label())
        elif tag == "disp-formula":
            tex = _first(e, "tex-math")
            self.add(e, text_at, "equation", _clean(_text(tex if tex is not None else e)))
        elif tag == "ref-list":
            seen: set[str] = set()
            for r in (x for x in e.iter() if _name(x) == "ref"):
                if not r.get("id") or r.get("id") not in seen:
                    seen.add(r.get("id") or "")
                    self.add(r, _Place("References", at), "reference", _clean(_text(r, ("label",))), label=_clean(_text(_first(r, "label"))) or str(len(seen)))
        elif text := _clean(_text(e)):
            self.add(e, text_at, "paragraph", text)
        return [], None

    def abstracts(self, root: ET.Element) -> None:
        """Graphical abstracts as figures, then the abstract: the first plain one with any content, and below it the others under headings of
        their kind. Those of sub-articles are not the article's."""
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if _name(x) in ("abstract", "trans-abstract"):
                found.append(x)
            elif _name(x) not in ("sub-article", "body", "back", "floats-group"):
                todo += reversed(x)
        drawn = [x for x in found if _name(x) == "abstract" and x.get("abstract-type") == "graphical"]
        place = _Place("Graphical Abstract")
        for x in drawn:
            figures = [f for f in x.iter() if _name(f) == "fig"]
            self.read(figures, place)
            for g in [] if figures else [g for g in x.iter() if _name(g) in ("graphic", "media")]:
                self.add(g, place, "figure", place.title, label=place.title, source_id=g.get("id") or "graphical_abstract")
        told = [x for x in found if all(x is not d for d in drawn)]
        filled = [x for x in told if any(_name(c) != "title" for c in x) or _clean(_text(x)).lower() not in ("", "abstract")]
        plain = [x for x in filled if _name(x) == "abstract" and x.get("abstract-type", "") in ("", "abstract")]
        first = next(iter(plain or filled), None)
        place = _Place("Abstract")
        for x in ([first] if first is not None else []) + [x for x in filled if x is not first]:
            kind = "Translated Abstract" if _name(x) == "trans-abstract" else (x.get("abstract-type") or "Abstract").replace("-", " ").title()
            where, before = place if x is first else _Place(kind, place), len(self.out)
            self.read(list(x), where)
            if len(self.out) == before and (text := _clean(_text(x))).lower() not in ("", "abstract"):  # text that stands in no element
                self.add(x, where, "paragraph", text)


def blocks_of(xml: str, name: str = "") -> list[dict]:
    """The blocks of one article in reading order: abstracts, body, floats, back matter; a broken article gives what can be recovered of it, a
    row of type error if that is nothing."""
    root, error = parse_tree(xml)
    if root is None or (error and not any(_name(x) in ("body", "front", "back") for x in root)):
        blank = {k: None for k in ("title", "original_type", "source_id", "label", "columns", "rows", "footnotes")}
        return [{**blank, "document_id": name, "block_seq": 0, "section_path": [], "block_type": "error", "content": "", "refs": [], "error": error}]
    own = article_id(root, name)
    reader = _Reader(own, _clean(_text(_first(root, "article-title"))) or _clean(_text(_first(root, "journal-title"))) or own)
    reader.abstracts(root)
    for part in ("body", "floats-group", "back"):
        for e in root:
            if _name(e) == part:
                reader.read(list(e), None, LOOSE.get(part))
    return reader.out


def parse(articles: DataFrame, name: str = "path", xml: str = "xml") -> DataFrame:
    """BLOCK_SCHEMA of articles with a name and their XML; the article's own id comes before the name. An article that does
    not parse gives one row of type error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in re.split(r", (?=[a-z_]+ [a-z])", BLOCK_SCHEMA)]
        for part in parts:
            rows = [b for n, x in zip(part[name], part[xml], strict=True) for b in blocks_of(x, n or "")]
            yield pd.DataFrame(rows, columns=names)

    return articles.select(name, xml).mapInPandas(run, BLOCK_SCHEMA)
