"""Front matter of article XML: journal, ids, title, contributors, dates, permissions, funding, keywords, supplements, and the
addresses of images."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.articles import _clean, _name, _text, article_id, parse_tree

FRONT_SCHEMA = (
    "document_id string, journal string, journal_ids map<string,string>, issns array<string>, publisher string, article_ids map<string,string>, doi string, title string, subtitle string, article_type string, "
    "categories array<string>, keywords array<string>, authors array<string>, contributors array<struct<name:string,role:string,orcid:string,collab:boolean,corresponding:boolean,affiliations:array<string>,notes:array<string>>>, "
    "author_notes array<string>, dates map<string,string>, history map<string,string>, epub_date string, collection_date string, volume string, issue string, fpage string, lpage string, elocation string, "
    "copyright string, license string, license_url string, funding array<struct<source:string,award:string>>, counts map<string,string>, custom map<string,string>, "
    "supplements array<struct<id:string,label:string,caption:string,href:string>>, error string"
)
_FIELDS = re.findall(r"(?:^|, )([a-z_]+) (?=string|map|array<)", FRONT_SCHEMA)
# How a supplement without a label is named.
LABEL_LENGTH = 60
# Addresses that are no images, and endings of those that are.
NOT_IMAGES = (r"^mailto:", r"^#", r"^javascript:", r"\.pdf$", r"\.docx?$", r"\.xlsx?$", r"\.zip$", r"\.(?:mp4|avi|mov)$", r"doi\.org/")
IMAGES = ("jpg", "jpeg", "png", "gif", "tif", "tiff", "svg", "webp", "bmp")


def _all(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [x for x in e.iter() if _name(x) in names] if e is not None else []


def _one(e: ET.Element | None, *names: str) -> ET.Element | None:
    return next(iter(_all(e, *names)), None)


def _said(e: ET.Element | None, *names: str) -> str | None:
    return _clean(_text(_one(e, *names))) or None


def href(e: ET.Element | None) -> str | None:
    """The address of an element, whatever its namespace."""
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1].rsplit(":", 1)[-1] == "href"), None) if e is not None else None


def date_of(e: ET.Element) -> str | None:
    """The ISO date that is given, else year-month-day as far as there is."""
    given = e.get("iso-8601-date")
    if given:
        return given
    parts = [_said(e, k) for k in ("year", "month", "day")]
    known = parts[: parts.index(None)] if None in parts else parts
    return "-".join([known[0], *(p.zfill(2) for p in known[1:])]) if known else None


def supplement(e: ET.Element) -> dict:
    """A supplement; without a label it is named by its caption's first sentence, cut at LABEL_LENGTH characters."""
    caption = _said(e, "caption")
    link = href(e) or next((h for x in e.iter() if (h := href(x))), None)
    return {"id": e.get("id"), "label": _said(e, "label") or ((caption or "").split(".")[0][:LABEL_LENGTH] or None), "caption": caption, "href": link}


def contributors(group: ET.Element, meta: ET.Element) -> list[dict]:
    places = {x.get("id"): _clean(_text(x, ("label",))) for x in _all(meta, "aff") if x.get("id")}
    out = []
    for c in _all(group, "contrib"):
        given, last = _said(c, "given-names"), _said(c, "surname")
        group_name = _said(c, "collab")
        refs = [(x.get("ref-type"), r) for x in _all(c, "xref") for r in (x.get("rid") or "").split()]
        own = [places[r] for kind, r in refs if kind == "aff" and r in places] + [_clean(_text(x, ("label",))) for x in c if _name(x) == "aff"]
        orcid = next((_clean(_text(x)) for x in _all(c, "contrib-id") if x.get("contrib-id-type") == "orcid"), None)
        out.append({
            "name": " ".join(p for p in (given, last) if p) or group_name or _said(c, "string-name"), "role": c.get("contrib-type"), "orcid": orcid, "collab": group_name is not None,
            "corresponding": c.get("corresp") == "yes" or any(kind == "corresp" for kind, _ in refs), "affiliations": list(dict.fromkeys(own)), "notes": [r for kind, r in refs if kind in ("fn", "author-notes")],
        })
    return [c for c in out if c["name"]]


def front_of(xml: str, name: str = "") -> dict:
    """One article's front matter; what is not there is null or empty. A broken article gives what can be recovered, with the
    error."""
    root, error = parse_tree(xml)
    out: dict = dict.fromkeys(_FIELDS)
    out.update({"document_id": name, "error": error})
    if root is None:
        return out
    journal, meta = _one(root, "journal-meta"), _one(root, "article-meta")
    keyed = lambda e, tag, key: {x.get(key): _clean(_text(x)) for x in _all(e, tag) if x.get(key) and _clean(_text(x))}
    ids = keyed(meta, "article-id", "pub-id-type")
    dates = {x.get("pub-type") or x.get("date-type") or "pub": d for x in _all(meta, "pub-date") if (d := date_of(x))}
    funded = [{"source": _said(a, "funding-source"), "award": _said(a, "award-id")} for a in _all(meta, "award-group")]
    group = next((x for x in _all(meta, "contrib-group")), None)
    people = contributors(group, meta) if group is not None else []
    rights = _one(meta, "license")
    top = {_name(x): x for x in reversed(list(meta))} if meta is not None else {}
    out.update({
        "document_id": article_id(root, name), "journal": _said(journal, "journal-title"), "journal_ids": keyed(journal, "journal-id", "journal-id-type"), "issns": [_clean(_text(x)) for x in _all(journal, "issn")],
        "publisher": _said(journal, "publisher-name"), "article_ids": ids, "doi": ids.get("doi"), "title": _said(meta, "article-title"), "subtitle": _said(meta, "subtitle"), "article_type": root.get("article-type"),
        "categories": list(dict.fromkeys(_clean(_text(x)) for x in _all(_one(meta, "article-categories"), "subject"))), "keywords": list(dict.fromkeys(k for x in _all(meta, "kwd") if (k := _clean(_text(x))))),
        "authors": [c["name"] for c in people if c["role"] in (None, "author")], "contributors": people, "author_notes": [_clean(_text(x)) for x in _all(_one(meta, "author-notes"), "fn", "corresp")], "dates": dates,
        "history": {x.get("date-type") or "date": d for x in _all(_one(meta, "history"), "date") if (d := date_of(x))}, "epub_date": dates.get("epub"), "collection_date": dates.get("collection"),
        **{field: _clean(_text(top.get(tag))) or None for field, tag in (("volume", "volume"), ("issue", "issue"), ("fpage", "fpage"), ("lpage", "lpage"), ("elocation", "elocation-id"))},
        "copyright": _said(meta, "copyright-statement"), "license": _said(rights, "license-p") or (_clean(_text(rights)) or None), "license_url": href(rights) or next((h for x in _all(rights, "ext-link", "license_ref") if (h := href(x) or _clean(_text(x)))), None),
        "funding": [x for x in funded if x["source"] or x["award"]], "counts": {_name(x): x.get("count") for x in _one(meta, "counts") or [] if x.get("count")},
        "custom": {k: _said(x, "meta-value") or "" for x in _all(meta, "custom-meta") if (k := _said(x, "meta-name"))}, "supplements": [supplement(x) for x in _all(root, "supplementary-material")],
    })
    return out


def front(articles: DataFrame, name: str = "path", xml: str = "xml") -> DataFrame:
    """FRONT_SCHEMA of articles with a name and their XML, one row each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [front_of(x, n or "") for n, x in zip(part[name], part[xml], strict=True)]
            yield pd.DataFrame({f: pd.Series([r[f] for r in rows], dtype=object) for f in _FIELDS}, columns=_FIELDS)

    return articles.select(name, xml).mapInPandas(run, FRONT_SCHEMA)


def find_article(articles: DataFrame, paper_id: str, name: str = "path") -> DataFrame:
    """The articles whose file is that of an id, with a version after a point or without."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]+)$", 1), r"\.(?:n?xml)$", "")
    return articles.where((stem == paper_id) | stem.rlike(rf"^{re.escape(paper_id)}\.\d+$"))


def is_image_address(address: Column) -> Column:
    low = F.lower(F.coalesce(address, F.lit("")))
    refused = F.lit(False)
    for p in NOT_IMAGES:
        refused = refused | low.rlike(p)
    ending = F.regexp_extract(F.regexp_replace(low, r"[?#].*$", ""), r"\.([a-z0-9]+)$", 1)
    return (low != "") & ~refused & ((ending == "") | ending.isin(*IMAGES))


def image_address(address: Column, base: Column) -> Column:
    """Where an image is: its own address if it has a scheme, else below base; without an ending that of a JPEG; null if it is none."""
    own = address.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    placed = F.when(own, address).otherwise(F.concat_ws("/", F.rtrim(base, F.lit("/")), F.ltrim(address, F.lit("/"))))
    named = F.when(F.regexp_replace(address, r"^.*/", "").contains("."), placed).otherwise(F.concat(placed, F.lit(".jpg")))
    return F.when(is_image_address(address), named)
