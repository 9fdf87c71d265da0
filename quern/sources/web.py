"""What fetched bytes hold: text and links of HTML, locations of sitemaps, rules of robots files."""

from __future__ import annotations

import gzip
import re
from html.parser import HTMLParser
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HIDDEN = {"script", "style", "noscript", "svg", "template"}
_LINK = re.compile(r"https?://[^\s<>\"']+")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.described, self.body, self.links, self.lang = [], [], [], [], ""
        self.hidden, self.in_title = 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "title":
            self.in_title = not self.title
        elif tag == "html":
            self.lang = self.lang or a.get("lang", "")
        elif tag == "meta" and (a.get("name", "").lower() == "description" or a.get("property", "").lower() == "og:description") and a.get("content", "").strip():
            self.described.append(a["content"].strip())
        link = a.get("href") if tag == "a" else a.get("src") if tag == "iframe" else None
        if link:
            self.links.append(link)

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        if not self.hidden:
            self.body.append(data)


def parse_html(html: str) -> tuple[str, list[str], str]:
    """(text, links, language): the title, descriptions and the visible text, one a line, white space collapsed; links sorted."""
    page = _Page()
    page.feed(html)
    page.close()
    flat = lambda x: re.sub(r"\s+", " ", x).strip()
    parts = [flat("".join(page.title)), *map(flat, page.described), flat(" ".join(page.body))]
    return "\n".join(p for p in parts if p), sorted(set(page.links)), page.lang


def extracted(responses: DataFrame) -> DataFrame:
    """responses (url, content_type, content binary, charset-less UTF-8) with text, links and language; other types are empty."""

    @F.pandas_udf("text string, links array<string>, lang string")
    def extract(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for kind, content in zip(kinds, contents, strict=True):
            kind, text = (kind or "").lower(), (content or b"").decode("utf-8", "replace")
            if "html" in kind:
                out.append(parse_html(text))
            elif any(x in kind for x in ("text/", "json", "xml")):
                out.append((text, sorted(set(_LINK.findall(text))), ""))
            else:
                out.append(("", [], ""))
        return pd.DataFrame(out, columns=["text", "links", "lang"])

    return responses.withColumn("__x", extract("content_type", "content")).select("*", "__x.text", "__x.links", "__x.lang").drop("__x")


def language_hint(header: Column, lang: Column) -> Column:
    """The first language of a content-language header, else the page's own."""
    first = F.trim(F.element_at(F.split(F.coalesce(header, F.lit("")), ","), 1))
    return F.when(first != "", first).otherwise(F.coalesce(lang, F.lit("")))


def sitemaps(contents: DataFrame) -> DataFrame:
    """contents (url, content binary) with kind (index, urlset or unknown) and locations, whatever the namespace; gzip is unpacked.

    Malformed or broken contents are unknown, without locations.
    """
    from xml.etree import ElementTree

    @F.pandas_udf("kind string, locations array<string>")
    def read(raw: pd.Series) -> pd.DataFrame:
        out = []
        for b in raw:
            try:
                root = ElementTree.fromstring(gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b)
            except (ElementTree.ParseError, OSError, EOFError, TypeError, ValueError):
                out.append(("unknown", []))
                continue
            local = lambda e: e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""
            kind = {"sitemapindex": "index", "urlset": "urlset"}.get(local(root), "unknown")
            out.append((kind, [e.text.strip() for e in root.iter() if local(e) == "loc" and e.text and e.text.strip()]))
        return pd.DataFrame(out, columns=["kind", "locations"])

    return contents.withColumn("__x", read("content")).select("*", "__x.kind", "__x.locations").drop("__x")


def robots_sitemaps(rules: Column) -> Column:
    """The sitemaps that a robots file names."""
    return F.regexp_extract_all(F.coalesce(rules, F.lit("")), F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), 1)


def unzipped_udf():  # noqa: ANN201
    """A pandas UDF: bytes as text, unpacked if they are gzip; null if they are broken."""

    @F.pandas_udf("string")
    def unzipped(contents: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            try:
                return None if b is None else (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b).decode("utf-8", "replace")
            except (OSError, EOFError):
                return None

        return contents.map(one)

    return unzipped


def allowed_udf(agent: str):  # noqa: ANN201
    """A pandas UDF (robots text, url): whether the rules let the agent fetch the url; no rules allow all."""

    @F.pandas_udf("boolean")
    def allowed(rules: pd.Series, urls: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}
        out = []
        for text, url in zip(rules, urls, strict=True):
            if not text:
                out.append(True)
                continue
            if text not in parsers:
                parsers[text] = RobotFileParser()
                parsers[text].parse(text.splitlines())
            out.append(parsers[text].can_fetch(agent, url or ""))
        return pd.Series(out)

    return allowed
