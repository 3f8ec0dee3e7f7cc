"""Main text of web pages from the standard library parser's events, text-to-tag ratios and zones.

The parser's events are read as they come, without a tree: an open-element stack and a list of zones are all that is
remembered. A zone is the page, a content element (article, main element, content division), a page header, or an
element that is aside by its kind or by a whole word of its class, id or role (menus, footers, adverts, forms, comments
and so on). Block elements cut the page into lines; a line has its pieces of text, each with its zone, and
the tags seen since the line before. Scripts, styles, drawings and controls have no text.

What counts is decided when the page has been read. The characters per tag of all lines, smoothed by a Gaussian,
are cut at their standard deviation; lines above are clusters. A zone that is aside counts after all if it wraps
the content: a form, a header or a notice around an article or a main element, or, on a page that has neither of them elsewhere,
any zone put aside by a word, but no comments, with most of the other clustered text. Of the content elements that count, the one that holds most of the clusters
is the region, together with its siblings of the same kind that hold one or a twentieth of its text; all its text counts then, short lines too.
On a page without such an element the region is the clustered lines and the lines between.

Character references are decoded, white space inside a block (also a line break element) becomes one blank, blocks are
joined by a line feed; what is left out inside a block leaves the rest of it one line. Page headers go;
headings inside an article stay.

Cases with a defined result: null and empty pages, and pages without content, have an empty text; a page
that breaks off inside a tag, a reference or an open element is read up to there; very long pages are read whole, one at a time; rows
repeat as often as they come; an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from clientele.llm.inputs import pieces

# What HTML calls these elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody tfoot thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements a new block of the same list ends without an end tag.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements whose text is never read, and elements that are aside.
SKIPPED = frozenset("head script style noscript template iframe object svg canvas audio video select button textarea title".split())
ASIDE = frozenset("nav aside footer menu dialog".split())
#: Words that put an element aside; as ``WRAPS`` unless an article is inside, as ``REMARKS`` in any case, like the elements of ``ASIDE``.
WRAPS = frozenset("alert consent modal notice notification overlay paywall search share sharing social subscribe subscription toolbar".split())
REMARKS = frozenset("comment comments discussion disqus replies reply respond".split())
ASIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs complementary contentinfo cookie cookies "
    "footer form gdpr login masthead menu nav navbar navigation newsletter popup promo promoted promotion recommended related "
    "sidebar signup sponsor sponsored widget".split()
)
SIDE_WORDS = ASIDE_WORDS | WRAPS | REMARKS | {"header"}
#: Words that change nothing about the one they stand with: ``site-footer`` is a footer, ``has-sidebar`` no sidebar.
PLAIN = frozenset("area bar block bottom box container content inner item left links list main page panel primary right secondary section site top wrap wrapper".split())
CONTENT_WORDS = frozenset("article content entry main post story".split())
WORDS = re.compile(r"[a-z0-9]+")

RADIUS, SIGMA = 2, 1.0
GAUSS = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]


class Line:
    __slots__ = ("parts", "text", "tags")

    def __init__(self, parts: list[tuple[int, str]], text: str, tags: int) -> None:
        self.parts, self.text, self.tags = parts, text, tags

    def own(self, counted: set[int]) -> str:
        """The text in zones that count."""
        return " ".join("".join(t if z in counted else " " for z, t in self.parts).split())


class Zone:
    """Where text lies: ``kind`` is page, content (with a rank), aside, wraps, header, or never."""

    __slots__ = ("parent", "kind", "rank")

    def __init__(self, parent: int, kind: str, rank: int = 0) -> None:
        self.parent, self.kind, self.rank = parent, kind, rank


def marks(value: str) -> set[str]:
    """The words of a class, id or role: whole tokens; of a token of several words those that are not ``PLAIN``, if each of them puts aside."""
    out = set()
    for token in value.lower().split():
        words = [w for w in WORDS.findall(token) if not w.isdigit()]
        telling = [w for w in words if w not in PLAIN]
        out.update(words if len(words) == 1 else telling if all(w in SIDE_WORDS for w in telling) else ())
    return out


class Lines(HTMLParser):
    """Collects the lines of one page. An open element is (name, zone, whether its text is skipped)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []
        self.lines: list[Line] = []
        self.zones = [Zone(-1, "page")]
        self.parts: list[tuple[int, str]] = []
        self.tags = 0
        self.state = (0, False)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(t for _, t in self.parts).split())
            if text:
                self.lines.append(Line(self.parts, text, self.tags))
                self.tags = 0
            self.parts = []

    def _zone(self, tag: str, attrs: list[tuple[str, str | None]], zone: int) -> int:
        """The zone inside a new element."""
        names: set[str] = set()
        content: set[str] = set()
        for key, value in attrs:
            if value and key in ("class", "id", "role"):
                names |= marks(value)
                content.update(WORDS.findall(value.lower()))
        landmark = tag in ("html", "body", "article", "main")
        kind, rank = "", 0
        if tag in ASIDE or (names & REMARKS and tag not in ("html", "body", "main")):
            kind = "never"
        elif names & ASIDE_WORDS and not landmark:
            kind = "aside"
        elif tag == "form" or (names & WRAPS and not landmark):
            kind = "wraps"
        elif tag == "header" or ("header" in names and tag in ("div", "section")):
            kind = "header"
        else:
            rank = 3 if tag == "article" else 2 if tag == "main" or "main" in names else 1 if content & CONTENT_WORDS and tag in ("div", "section") else 0
            kind = "content" if rank else ""
        if tag in HEADINGS and self.zones[zone].kind == "header" and (above := self._content(zone)):
            self.zones.append(Zone(above, "content"))  # a heading in the header of an article
            return len(self.zones) - 1
        if not kind:
            return zone
        self.zones.append(Zone(zone, kind, rank))
        return len(self.zones) - 1

    def _content(self, zone: int) -> int:
        """The content element whose header a zone is, or 0."""
        while zone > 0 and self.zones[zone].kind == "header":
            zone = self.zones[zone].parent
        return zone if self.zones[zone].kind == "content" else 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if self.state[1] or tag in SKIPPED:
            pass  # what has no text cuts no line either
        elif tag in BLOCKS:
            self.flush()
        elif tag in ("br", "td", "th"):
            self.parts.append((self.state[0], " "))
        if (tag in CLOSES or tag in BLOCKS) and not self.state[1] and tag not in SKIPPED:
            self._close_open(tag)
        if tag in VOID:
            return
        zone, skipped = self.state
        self.open.append((tag, *self.state))
        self.state = (zone if skipped else self._zone(tag, attrs, zone), skipped or tag in SKIPPED)

    def _close_open(self, tag: str) -> None:
        """End what a new block ends: an open paragraph, or the item before in a list or table."""
        ended = CLOSES.get(tag, ("p",))
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name in ended:
                self.flush()
                self.state = self.open[k][1:]
                del self.open[k:]
                return
            if name in BLOCKS and name != "p" or name in ("td", "th", "table"):
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS and not self.state[1]:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.state = self.open[k][1:]
                del self.open[k:]
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        # a piece that is skipped still parts the words around it
        self.parts.append((self.state[0], " " if self.state[1] else data))


def smoothed(values: list[float]) -> list[float]:
    """Gaussian mean of each value and its neighbours."""
    out = []
    for k in range(len(values)):
        total = weight = 0.0
        for step, g in enumerate(GAUSS, k - RADIUS):
            if 0 <= step < len(values):
                total += g * values[step]
                weight += g
        out.append(total / weight)
    return out


def clustered(lines: list[Line]) -> list[bool]:
    """Lines whose smoothed text-to-tag ratio is above the ratios' standard deviation."""
    ratios = smoothed([len(x.text) / max(x.tags, 1) for x in lines])
    mean = sum(ratios) / len(ratios)
    limit = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    return [r >= limit for r in ratios]


def _mass(zones: list[Zone], lines: list[Line], content: list[bool], counted: set[int] | None = None) -> list[float]:
    """Characters of each zone with all that is in it; a line off the clusters counts little, so an article of short lines still has some."""
    mass = [0.0] * len(zones)
    for x, inside in zip(lines, content):
        for zone, text in x.parts:
            if counted is None or zone in counted:
                mass[zone] += len(text.strip()) * (1.0 if inside else 0.01)
    for z in range(len(zones) - 1, 0, -1):  # a zone comes after its parent
        mass[zones[z].parent] += mass[z]
    return mass


def _landmarks(zones: list[Zone], free: list[bool], mass: list[float]) -> list[list[bool]]:
    """For each zone whether an article or main element with text is in it, not put aside in between."""
    held = [False] * len(zones)
    for z in range(len(zones) - 1, 0, -1):
        own = zones[z].rank >= 2 and mass[z] > 0
        if (own or held[z]) and (zones[z].kind in ("content", "wraps", "header") or free[z]):
            held[zones[z].parent] = True
    return held


def counted_zones(zones: list[Zone], lines: list[Line], content: list[bool]) -> set[int]:
    """The zones whose text may count."""
    mass = _mass(zones, lines, content)
    on = [z.kind in ("page", "content") for z in zones]
    held = _landmarks(zones, on, mass)
    on = [o or (z.kind in ("wraps", "header") and h) for o, z, h in zip(on, zones, held)]

    def reached() -> set[int]:
        out = {0}
        for z in range(1, len(zones)):
            if on[z] and zones[z].parent in out:
                out.add(z)
        return out

    found = reached()
    if not any(zones[z].rank >= 2 and mass[z] > 0 for z in found):
        never = [False] * len(zones)
        for z in range(1, len(zones)):
            never[z] = zones[z].kind == "never" or never[zones[z].parent]
        other = mass[0] - sum(mass[z] for z in range(1, len(zones)) if never[z] and not never[zones[z].parent])
        for z in range(1, len(zones)):
            if not never[z] and not on[z] and 2 * mass[z] > other:
                on[z] = True
        found = reached()
    return found


def main_text_of(lines: list[Line], zones: list[Zone]) -> list[str]:
    """The texts of the lines of the region with most content."""
    counted = counted_zones(zones, lines, clustered(lines))
    lines = [x for x in lines if x.own(counted)]
    if not lines:
        return []
    content = clustered(lines)  # without what is aside, whose ratios may be far off
    mass = _mass(zones, lines, content, counted)
    marked = [r for r in counted if zones[r].rank and 2 * mass[r] >= mass[0] > 0] or [r for r in counted if zones[r].rank == 3 and mass[r] > 0]
    if marked:
        best = max(marked, key=lambda r: (zones[r].rank, mass[r], -r))
        # an article that comes in several elements: those beside it that hold a clustered line, or a share of its text
        dense = _mass(zones, lines, [True] * len(lines), counted)
        region = {best} | {r for r in counted if zones[r].parent == zones[best].parent and zones[r].rank == zones[best].rank and (mass[r] > 0.011 * dense[r] or 20 * dense[r] >= dense[best])}
        for z in range(len(zones)):
            if z in counted and zones[z].parent in region:
                region.add(z)
        texts = [x.own(region) for x in lines]
        return [t for t in texts if t]
    texts = [x.own(counted) for x in lines]
    # smoothing widens a region over its neighbours; its ends are lines with a high ratio of their own
    own = [len(x.text) / max(x.tags, 1) for x in lines]
    least = sum(own) / len(own) / 2
    ends = [k for k, (text, inside) in enumerate(zip(texts, content)) if inside and text and own[k] >= least]
    return [t for t in (texts[ends[0] : ends[-1] + 1] if ends else texts) if t]


def main_text(html: str) -> str:
    """The main text of one page."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n".join(main_text_of(parser.lines, parser.zones)) if parser.lines else ""


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page ``page_id, url, text, n_chars``."""
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"),
                "text": pa.array(found, pa.string()), "n_chars": pa.array([len(x) for x in found], pa.int64()),
            })

    return pages.mapInArrow(run, StructType([pages.schema["page_id"], pages.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())]))
