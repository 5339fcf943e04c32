"""Page features with the standard library's HTML parser, by Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from ..functions.texts import QUESTION_WORDS
from ..functions.urls import AUTHORITY_DOMAINS, AUTHORITY_SUFFIXES, LINK_FILTER

# Elements without body text; structured-data types that count; where dates stand in a text, and how they
# are written (in the notation of strptime).
_SKIPPED = {"script", "style", "nav", "footer", "header", "noscript", "iframe", "svg"}
LD_TYPES = (
    "faqpage", "faq", "product", "howto", "softwareapplication", "article", "blogposting", "review", "aggregaterating",
    "offer", "itemlist", "breadcrumblist", "videoobject", "dataset", "course", "event", "recipe", "qapage",
)
DATE_PATTERNS = (r"(\d{4}-\d{2}-\d{2})", r"(\d{4}/\d{2}/\d{2})", r"(\w+ \d{1,2},?\s*\d{4})", r"(\d{1,2} \w+ \d{4})")
DATE_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%B %d, %Y", "%B %d %Y", "%d %B %Y", "%b %d, %Y", "%b %d %Y", "%d %b %Y")
#: The narrower types of the older extractors.
LEGACY_LD_TYPES = ("faqpage", "faq", "product", "howto")
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?")
_QUESTION = re.compile(rf"(?i)^\s*(?:{'|'.join(QUESTION_WORDS)})\b")


def parse_date(text: str) -> datetime | None:
    """A moment in UTC, from one of DATE_FORMATS or ISO 8601."""
    text = text.strip()
    for form in DATE_FORMATS:
        try:
            return datetime.strptime(text, form).replace(tzinfo=UTC)
        except ValueError:
            continue
    try:
        found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


class Page(HTMLParser):
    """One pass over a page: body text, headings, links, images, dates and structured data."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.digest: list[str] = []
        self.headings: list[str] = []
        self.n_headings = 0
        self.links: list[str] = []
        self.images = self.images_alt = 0
        self.dates: list[str] = []
        self.ld: list[str] = []
        self.title = ""
        self._open: list[str] = []
        self._skip = 0
        self._in: list[list[str]] = []
        self._ld: list[str] | None = None
        self._mark = ""

    def feed_closed(self, source: str) -> None:
        """Feeds a whole page of which only known references with a semicolon are decoded. Every other "&" is a character
        that no reference decodes to and the page doesn't have, until its text is read."""
        self._mark = next(c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in source)
        known = lambda r: r is not None and (r[0] == "#" or r in html5)
        self.feed(_REFERENCE.sub(lambda m: m[0] if known(m[1]) else self._mark + m[0][1:], source))

    def _read(self, text: str) -> str:
        return text.replace(self._mark, "&") if self._mark else text

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: self._read(v or "") for k, v in attrs}
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "img":
            self.images += 1
            self.images_alt += bool(a.get("alt", "").strip())
        elif tag == "time" and a.get("datetime"):
            self.dates.append(a["datetime"])
        elif tag == "meta" and any(x in (a.get("name") or a.get("property") or "").lower() for x in ("date", "published", "modified", "time")):
            self.dates.append(a.get("content", ""))
        self.n_headings += tag in {"h2", "h3"}
        if tag == "script" and a.get("type") == "application/ld+json":
            self._ld = []
        if tag in _SKIPPED:
            self._skip += 1
        if tag in {"h1", "h2", "h3", "h4", "p", "li", "title"}:
            self._close({"p"} if tag != "li" else {"p", "li"})
            self._open.append(tag)
            self._in.append([])

    def _close(self, tags: set[str]) -> None:
        while self._open and self._open[-1] in tags:
            self._end()

    def _end(self) -> None:
        tag, text = self._open.pop(), " ".join("".join(self._in.pop()).split())
        if tag == "title":
            self.title = self.title or text
        elif text:
            if not self._skip:
                self.digest.append(text)
            if tag in {"h2", "h3"}:
                self.headings.append(text)

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self._ld is not None:
            self.ld.append("".join(self._ld))
            self._ld = None
        if tag in _SKIPPED and self._skip:
            self._skip -= 1
        if tag in self._open:
            while self._open:
                top = self._open[-1]
                self._end()
                if top == tag:
                    break

    def handle_data(self, data: str) -> None:
        data = self._read(data)
        if self._ld is not None:
            self._ld.append(data)
        if self._in:
            self._in[-1].append(data)
        if not self._skip and "title" not in self._open:
            self.text.append(data)

    def done(self) -> Page:
        self.close()
        while self._open:
            self._end()
        return self


def parse(source: str | None, closed: bool = False) -> Page:
    page = Page()
    (page.feed_closed if closed else page.feed)(source or "")
    return page.done()


def _json(blocks: list[str]) -> Iterator[object]:
    for b in blocks:
        try:
            yield json.loads(b)
        except ValueError:
            continue


def ld_types(blocks: list[str]) -> set[str]:
    """Lower-case types of JSON-LD, in lists and graphs; broken blocks are skipped."""
    out: set[str] = set()

    def walk(x: object) -> None:
        if isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, dict):
            kind = x.get("@type")
            out.update(k.lower() for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str))
            walk(x.get("@graph"))

    for x in _json(blocks):
        walk(x)
    return out


def freshness(page: Page, body: str, now: datetime) -> int:
    """0 (no or old date) to 4 (within 180 days) of the latest date in meta, JSON-LD and time elements, else of the body."""
    said = [*page.dates, *(str(x[k]) for x in _json(page.ld) if isinstance(x, dict) for k in ("datePublished", "dateModified", "dateCreated") if x.get(k))]
    dates = [d for d in map(parse_date, said) if d]
    if not dates:
        for p in DATE_PATTERNS:
            for m in re.finditer(p, body[:5000]):  # the feature reads the body's head alone
                d = parse_date(m[1])
                if d and d.year >= 2015 and d <= now:
                    dates.append(d)
                    break
            if dates:
                break
    if not dates:
        return 0
    age = (now - max(dates)).days
    return next((4 - i for i, limit in enumerate((180, 365, 730, 1825)) if age <= limit), 0)


def host(url: str) -> str:
    m = re.match(r"(?i)https?://([^/?#:]+)", url or "")
    return re.sub(r"^www\.", "", m[1].lower()) if m else ""


def is_authority(h: str) -> bool:
    two = two_labels(h)
    suffix = two if h.count(".") > 1 and two in AUTHORITY_SUFFIXES else h.rsplit(".", 1)[-1]
    return suffix in AUTHORITY_SUFFIXES or two in AUTHORITY_DOMAINS


def two_labels(h: str) -> str:
    return ".".join(h.split(".")[-2:])


def syllables(word: str) -> int:
    n = len(re.findall(r"[aeiouy]+", word.lower().rstrip("e"))) or 1
    return n


def grade(text: str) -> float | None:
    """Flesch-Kincaid grade, 2 digits; none under 100 words."""
    words = re.findall(r"[^\W\d_]+", text)
    if len(words) < 100:
        return None
    sentences = max(1, len(re.findall(r"[.!?]+(?:\s|$)", text)))
    return round(0.39 * len(words) / sentences + 11.8 * sum(map(syllables, words)) / len(words) - 15.59, 2)


FIELDS = {
    "title": "string",
    "body_text": "string",
    "digest": "string",
    "headings": "array<string>",
    "n_headings": "long",
    "question_heading": "boolean",
    "structured": "boolean",
    "external_citation": "boolean",
    "freshness": "long",
    "n_links": "long",
    "internal_links": "long",
    "outbound_links": "long",
    "authority_links": "long",
    "n_images": "long",
    "images_alt": "long",
    "dates": "array<string>",
    "grade": "double",
    "error": "string",
}


def features(source: str | None, url: str | None, now: datetime | None = None, legacy: bool = False, closed: bool = False) -> dict:
    """The feature row of a page; a page that fails gives nulls and the error.

    With ``legacy`` the older extractors' narrower rules hold: four structured types, and questions by their first word.
    With ``closed`` a character reference without its semicolon (&amp before a tag) stays as written; else it is decoded, as
    in HTML 5.
    """
    out: dict = dict.fromkeys(FIELDS)
    try:
        page = parse(source, closed)
        text = " ".join(" ".join(page.text).split())
        own, links = host(url or ""), page.links
        hosts = [host(x) for x in links]
        outbound = [h for h in hosts if h and two_labels(h) != own]
        internal = [x for x, h in zip(links, hosts, strict=True) if (h and two_labels(h) == own) or (not h and x[:1] in "/#?" and x[:2] != "//")]
        cited = [h for h in outbound if h != own and h not in LINK_FILTER]
        question = [h for h in page.headings if _QUESTION.match(h) or (h.endswith("?") and not legacy)]
        out |= {
            "title": page.title,
            "body_text": text,
            "digest": " ".join(page.digest)[:8000],
            "headings": page.headings,
            "n_headings": page.n_headings,
            "question_heading": bool(question),
            "structured": bool(ld_types(page.ld) & set(LEGACY_LD_TYPES if legacy else LD_TYPES)),
            "external_citation": bool(cited),
            "freshness": freshness(page, text, now or datetime.now(UTC)),
            "n_links": len(links),
            "internal_links": len(internal),
            "outbound_links": len(outbound),
            "authority_links": sum(is_authority(h) for h in (host(x) for x in dict.fromkeys(links)) if h and h != own),
            "n_images": page.images,
            "images_alt": page.images_alt,
            "dates": page.dates,
            "grade": grade(text),
        }
    except Exception as e:  # noqa: BLE001  the row keeps what went wrong
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def page_features(pages: DataFrame, key: str, url: str, source: str, now: datetime | None = None, legacy: bool = False, closed: bool = False) -> DataFrame:
    """The key and all of FIELDS for every page; ages count back from ``now``; ``legacy`` and ``closed`` as in ``features``."""
    import pyarrow as pa

    kind = pages.schema[key].dataType.simpleString()
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(h, u, now, legacy, closed) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[c] for r in rows], types[t]) for c, t in FIELDS.items())], names=[key, *FIELDS])

    return pages.select(key, url, source).mapInArrow(extract, f"`{key}` {kind}, " + ", ".join(f"{c} {t}" for c, t in FIELDS.items()))
