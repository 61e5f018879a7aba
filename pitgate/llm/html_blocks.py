"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block element, without those inside an element that is
boilerplate by its tag, role, class or id. A line weighs the characters of its text outside links.
Sums over a sliding window of lines are low over what boilerplate is left and high over the
article: the text begins where they surge and ends where they dive, and every line between is
kept, however short.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgate.llm.tables import small_batches

WINDOW = 3
SURGE = 40
#: Attributes: a value without quotes may hold some; nothing is matched in two ways.
ATTRIBUTES = r"(?:[^<>\"'=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>][^\s>]*+)?+|\"[^\"]*\"|'[^']*')*+"
UNSEEN = re.compile(
    rf"<!--.*?(?:-->|$)|<svg\b{ATTRIBUTES}(?<=/)>|<(script|style|noscript|template|svg|iframe|textarea|select|object|title)\b"
    rf"{ATTRIBUTES}>.*?(?:</\1\s*>|$)", re.S | re.I)
TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({ATTRIBUTES})>|<[!?][^>]*>")
NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p "
    "pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OUTSIDE = frozenset("nav footer aside form button menu dialog head".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notification alert sidebar rail widget widgets nav navbar navigation menu breadcrumb "
    "breadcrumbs footer masthead topbar comment comments commentlist disqus reply replies discussion respond "
    "related recommended recommendations share sharing social subscribe subscription newsletter signup login "
    "popup modal overlay pagination pager skip toolbar contentinfo complementary search".split())
#: Words that name subjects too: alone they make no boilerplate of a heading or of a block of much unlinked text.
TOPICS = frozenset("discussion related recommended recommendations search share sharing social navigation".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("table caption td th html".split())
LOOSE = BLOCKS - {"address", "div", "p"}
TABLE = frozenset(["table"])
HOLDING = SCOPE | {"ul", "ol", "menu", "dl"}
#: What the start of an element ends, and what holds that in.
IMPLIED = ({"li": (("li",), LOOSE), "option": (("option",), BLOCKS)} | {t: (("dt", "dd"), LOOSE) for t in ("dt", "dd")}
           | {t: (("td", "th"), TABLE) for t in ("td", "th")} | {"tr": (("tr",), TABLE)}
           | {t: (("thead", "tbody", "tfoot"), TABLE) for t in ("thead", "tbody", "tfoot")})
PART = re.compile(r"[a-z0-9]+")


def _ends(tags: list[re.Match[str]]) -> list[int]:
    """For each start tag the number of the tag at which its element ends. Elements without an end tag
    end as HTML says: at the next of their kind, a block for a paragraph, or the end of what holds them."""
    ends = [len(tags)] * len(tags)
    opened: list[tuple[str, int]] = []
    many: Counter[str] = Counter()

    def close(names: tuple[str, ...], stop: frozenset[str], at: int) -> None:
        if not any(many[x] for x in names):
            return
        for k in range(len(opened) - 1, -1, -1):
            if opened[k][0] in names:
                for tag, i in opened[k:]:
                    ends[i] = at
                    many[tag] -= 1
                del opened[k:]
                return
            if opened[k][0] in stop:
                return

    for i, m in enumerate(tags):
        tag = (m[2] or "").lower()
        if not tag or tag in VOID:
            continue
        names, stop = IMPLIED.get(tag, ((tag,), SCOPE if tag in BLOCKS and tag != "p" else BLOCKS))
        if m[1]:
            close((tag,), HOLDING if stop is LOOSE else stop, i)
            continue
        if tag in BLOCKS:
            close(("p",), BLOCKS, i)
        if tag in IMPLIED:
            close(names, stop, i)
        opened.append((tag, i))
        many[tag] += 1
    return ends


def _boilerplate(tag: str, rest: str, in_article: bool, heavy: Callable[[], bool]) -> bool:
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return True
    if not rest or tag in ("html", "body", "main"):
        return False
    if HIDDEN.search(rest):
        return True
    if tag in HEADINGS and in_article:
        return False
    for found in NAMED.finditer(rest):
        value = next((x for x in found.groups() if x), "")
        spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
        said = WORDS.intersection(PART.findall(spaced))
        if said and (said - TOPICS or found[0][:4].lower() == "role" or not (tag in HEADINGS or heavy())):
            return True
    return False


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """``(text, weight, inside)`` of each line; ``inside``: not in a boilerplate element, and in an article
    if the page has one with text outside boilerplate."""
    page = UNSEEN.sub(" ", page)
    tags = list(TAG.finditer(page))
    ends = _ends(tags)
    lines: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    sums: list[tuple[int, int]] = []
    linked = 0
    skip, article, link = -1, -1, 0

    def end_line() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append((text, max(len(text.replace(" ", "")) - linked, 0), skip < 0, article >= 0))
        parts.clear()
        linked = 0

    def heavy(i: int) -> bool:
        """Whether the element of a start tag is mostly text outside links, and not little."""
        if not sums:
            plain, links, inside, at = 0, 0, False, 0
            for m in [*tags, None]:
                many = len("".join(html.unescape(page[at:m.start() if m else None]).split()))
                plain, links = (plain, links + many) if inside else (plain + many, links)
                sums.append((plain, links))
                if m:
                    at = m.end()
                    inside = not m[1] if (m[2] or "").lower() == "a" else inside
        plain, links = (sums[ends[i]][j] - sums[i][j] for j in (0, 1))
        return plain >= 2 * SURGE and plain >= 4 * links

    at = 0
    for i, m in enumerate(tags):
        text = page[at:m.start()]
        at = m.end()
        if text:
            parts.append(text)
            if link:
                linked += len("".join(html.unescape(text).split()))
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS or (i == skip and parts):
            end_line()
        if i == skip:
            skip = -1
        if i == article:
            article = -1
        if tag == "a":
            link = 0 if m[1] else 1
        if m[1] or tag in VOID or skip >= 0:
            continue
        if _boilerplate(tag, m[3] or "", article >= 0, lambda k=i: heavy(k)):
            if parts:
                end_line()
            skip, link = ends[i], 0
        elif tag in ("article", "main") and article < 0:
            article = ends[i]
    parts.append(page[at:])
    end_line()
    has_article = any(weight and clean and own for _, weight, clean, own in lines)
    return [(text, weight, clean and (own or not has_article)) for text, weight, clean, own in lines]


def main_text(page: str | None) -> str:
    """The lines between surge and dive, joined by newlines; empty if there are none."""
    lines = [(text, weight) for text, weight, inside in page_lines(page or "") if inside]
    weight = np.array([w for _, w in lines], np.int64)
    if not weight.any():
        return ""
    sums = np.convolve(weight, np.ones(WINDOW, np.int64))
    high = min(SURGE, int(sums.max()))
    ahead, behind = sums[WINDOW - 1:], sums[:len(weight)]
    surge = int(np.flatnonzero(ahead >= high)[0])
    dive = int(np.flatnonzero(behind >= high)[-1])
    while not weight[surge]:
        surge += 1
    while not weight[dive]:
        dive -= 1
    while surge and weight[surge - 1]:
        surge -= 1
    while dive + 1 < len(weight) and weight[dive + 1]:
        dive += 1
    return "\n".join(text for text, _ in lines[surge:dive + 1])


def main_texts(pages: DataFrame, key: str = "page_id", markup: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key``, the columns of ``keep`` and ``text`` for every page, extracted from its whole markup.

    Null, empty and text-free markup gives an empty text; markup without tags is its own text.
    Repeated rows give a row each; other columns are not looked at.
    """
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], [*names, "text"])

    names = [f"k{i}" for i in range(len(keep) + 1)]
    picked = small_batches(pages).select(F.col(f"`{markup}`").alias("markup"), *[
        F.col(f"`{c}`").alias(n) for c, n in zip((key, *keep), names, strict=True)])
    shape = ", ".join(f"{n} {picked.schema[n].dataType.simpleString()}" for n in names) + ", text string"
    return picked.mapInArrow(extract, shape).select(
        *[F.col(n).alias(c) for c, n in zip((key, *keep), names, strict=True)], "text")
