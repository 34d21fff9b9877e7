"""Main text of a page by line-block distribution.

Markup is stripped to lines, one a block element. A container (div, section, ...) and a dropped element (menus, scripts,
forms, ...) leave ``WINDOW`` empty lines. Over the lines, text lengths are summed in sliding windows; a segment lies between
two dives of the sums to nothing, and is text where the sums surge to a share of those that a typical character of the page
lies in. Short segments of the same class and depth as one that surges belong to it, and so does a heading before one. Class,
id and role names are hints: a named block goes only where it is mostly links or its sums never surge.
Inside an article or main element all lines are text but dropped elements and confirmed hints; other segments must surge.

Cases: null html is empty; a page without text gives an empty string; repeated rows each give a row; nulls in url are
kept; other columns are not read; no text is cut. Unclosed boilerplate ends where an article or main element begins, and unclosed
paragraphs, list items and table cells where the next one begins or their list or table ends. A tag with an unbalanced quote that no
> outside quotes follows ends at the next >, as do all tags after it; without any the rest of the page is text. Work is linear in the page.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped

WINDOW = 3
#: Share of the page's typical window sum that a segment must reach, and the share of linked text that makes it a menu.
SURGE, LINKED = 0.25, 0.5

# Fixed values of HTML: elements that are no text, raw-text elements, and elements that break a line.
DROPPED = {"nav", "header", "footer", "aside", "form", "noscript", "template", "select", "button", "iframe", "svg", "canvas", "object", "dialog", "menu", "head", "figure", "video", "audio", "map"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
BREAKS = {"p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "blockquote", "pre", "br", "hr", "body", "html", "address", "figcaption", "details", "summary", "center", "fieldset"}
CONTAINERS = {"div", "section", "center", "fieldset", "address", "details"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
# Whole words of class, id and role values that hint at boilerplate, and those of others' texts.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "adbox", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion",
    "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "topbar", "toolbar",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login",
    "comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "related", "recommended", "share", "sharing", "social", "widget", "pagination", "pager", "copyright", "search", "complementary", "contentinfo",
    "side", "rail", "feedback", "discussion", "responses", "teaser", "paywall", "leaderboard", "skyscraper",
}

OTHERS = {"comment", "comments", "commentlist", "comment-list", "disqus", "disqus_thread"}
OTHER_ARTICLES = OTHERS | {"related", "recommended", "related-posts", "related-articles", "reply", "replies", "teaser"}

# Elements whose end may be left out: what begins or ends beside them closes them, unless one of the holders was opened inside.
IMPLIED = {"p": BREAKS - {"br"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
HOLDERS = {"ul", "ol", "dl", "table", "div", "section", "article", "blockquote"}

_NAME = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*)")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name in lower case, closing, attributes) of each tag, comment and declaration; the latter two have no name. Send a place to go on from there."""
    at, plain, n = 0, False, len(page)
    while (begin := page.find("<", at)) >= 0:
        jump = None
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else n
            jump = yield begin, at, "", False, ""
        elif page.startswith(("<!", "<?"), begin):
            at = page.find(">", begin) + 1 or n
            jump = yield begin, at, "", False, ""
        elif m := _NAME.match(page, begin + 1):
            whole = None if plain else _ATTRIBUTES.match(page, m.end())
            if not whole:
                plain = True  # one scan to the end of the page at most
            end = whole.end() if whole else page.find(">", m.end()) + 1
            if not end:
                return
            at = end
            jump = yield begin, end, m[2].lower(), bool(m[1]), page[m.end() : end - 1]
        else:
            at = begin + 1
        if jump is not None:
            at = jump
            yield at, at, "", False, ""


def tag_places(page: str) -> dict[str, tuple[list[int], list[int]]]:
    """Places of the opening and the closing tags of each name."""
    found: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for m in re.finditer(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)", page):
        found[m[2].lower()][len(m[1])].append(m.start())
    return found


class Line(NamedTuple):
    text: str
    linked: int = 0
    landmark: bool = False
    heading: bool = False
    #: depth and names of its container
    place: tuple = ()


def _words(attributes: str) -> set[str]:
    return {word for values in _NAMED.findall(attributes) for word in "".join(values).lower().split()} if attributes else set()


def _dropped(name: str, attributes: str, landmark: int) -> bool:
    if name in DROPPED:
        return not (landmark and name in ("header", "figure"))
    if name in ("main", "body", "html") or not attributes:
        return False
    return bool(_words(attributes) & (OTHER_ARTICLES if name == "article" else OTHERS)) or bool(name != "article" and _HIDDEN.search(attributes))


def lines_of(page: str) -> tuple[list[Line], list[tuple[int, int]]]:
    """The lines, with empty ones where containers and dropped elements were, and [begin, end) of each block with a hint."""
    lines: list[Line] = []
    hints: list[tuple[int, int]] = []
    words: list[str] = []
    boxes: list[tuple[str, str]] = []  # open containers
    hinted: list[tuple[str, int, int, int]] = []  # name, how many of the name are open, open holders, begin
    named: dict[str, list[int]] = defaultdict(list)  # places in hinted by name
    count: dict[str, int] = defaultdict(int)  # open elements
    holders = 0
    linked, in_link, landmark, at = 0, 0, 0, 0
    heading = False
    skip, depth, closed, inside = "", 0, False, 0
    places: dict = {}

    def end_hint(k: int) -> None:
        line()
        hints.extend((x[3], len(lines)) for x in hinted[k:])
        while len(hinted) > k:
            named[hinted.pop()[0]].pop()
        blank()

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not skip:
            t = entities.unescape(raw) if "&" in raw else raw
            words.append(t)
            if in_link:
                linked += len(t.strip())

    def line() -> None:
        nonlocal linked, heading
        t = " ".join("".join(words).split())
        words.clear()
        if t:
            lines.append(Line(t, linked, landmark > 0, heading, (len(boxes), boxes[-1][1] if boxes else "")))
        linked, heading = 0, False

    def blank() -> None:
        if lines and lines[-1].text:
            lines.extend([Line("", landmark=landmark > 0)] * WINDOW)

    n, lowered = len(page), ""
    walk = tokens(page)
    for begin, end, name, closing, attributes in walk:
        text(page[at:begin])
        at = end
        if not name:
            continue
        alone = name in VOID or attributes.endswith("/")
        if name in RAW and not closing:
            lowered = lowered or page.lower()
            found = lowered.find("</" + name, at) if len(lowered) == n else -1
            at = found if found >= 0 else (re.compile("</" + name, re.I).search(page, at) or re.compile(r"\Z").search(page, at)).start()
            walk.send(at)
            continue
        if skip and not inside and (name in IMPLIED.get(skip, ()) and not closing or closing and skip in IMPLIED and name in HOLDERS):
            skip = ""  # its end tag was left out
        if skip:
            if name in HOLDERS and name != skip and not alone:
                inside = max(0, inside + (-1 if closing else 1))
            if name in ("article", "main") and not closing and skip != name and not closed:
                places = places or tag_places(page)
                opens, closes = places[skip]
                after = lambda x: len(x) - bisect_left(x, at)
                closed = after(closes) - after(opens) >= depth
                skip = skip if closed else ""
            elif name == skip:
                depth += -1 if closing else 0 if alone else 1
                if depth == 0:
                    skip = ""
                    continue
            if skip:
                continue
        if not closing and not alone and _dropped(name, attributes, landmark):
            line()
            blank()
            skip, depth, closed, inside = name, 1, False, 0
            continue
        if hinted and hinted[-1][2] == holders and (name in IMPLIED.get(hinted[-1][0], ()) and not closing or closing and hinted[-1][0] in IMPLIED and name in HOLDERS):
            end_hint(len(hinted) - 1)
        if name in HOLDERS and not alone:
            holders = max(0, holders + (-1 if closing else 1))
        if name in BREAKS:
            line()
            heading = name in HEADINGS and not closing
            if name in ("article", "main"):
                landmark = max(0, landmark + (-1 if closing else 1))
            if name in CONTAINERS or name in ("article", "main"):
                blank()
            if name in CONTAINERS and not alone:
                if not closing:
                    boxes.append((name, " ".join(sorted(_words(attributes)))))
                elif boxes:
                    boxes.pop()
        elif name == "a":
            in_link = 0 if closing else 1
        if alone:
            continue
        if not closing:
            count[name] += 1
            if name not in ("article", "main", "body", "html") and _words(attributes) & NAMES:
                line()
                blank()
                named[name].append(len(hinted))
                hinted.append((name, count[name], holders, len(lines)))
                heading = name in HEADINGS
        elif count[name]:
            if named[name] and hinted[named[name][-1]][1] >= count[name]:
                end_hint(named[name][-1])
            count[name] -= 1
    text(page[at:])
    line()
    hints += [(x[3], len(lines)) for x in hinted]
    return lines, hints


def sums_of(lengths: list[int], window: int = WINDOW) -> list[int]:
    """The sum of each window, by the line that it ends at."""
    out, total = [], 0
    for i, n in enumerate(lengths):
        total += n - (lengths[i - window] if i >= window else 0)
        out.append(total)
    return out


def surge_of(lengths: list[int]) -> float:
    """SURGE of the sum of the window that the middle character of a page lies in."""
    ordered = sorted(zip(sums_of(lengths), lengths, strict=True))
    half, seen = sum(lengths) / 2, 0
    for s, n in ordered:
        seen += n
        if n and seen >= half:
            return max(1, SURGE * s)
    return 1


def segments(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """[begin, end) and the peak of each stretch between two dives of the window sums."""
    out, begin, peak = [], -1, 0
    for i, s in enumerate([*sums_of(lengths, window), 0]):
        if s > 0 and begin < 0:
            begin, peak = i, 0
        peak = max(peak, s)
        if s == 0 and begin >= 0:
            out.append((begin, i, peak))
            begin = -1
    return out


def main_text(page: str | None) -> str:
    lines, hints = lines_of(page or "")
    lengths = [len(x.text) for x in lines]
    surge = surge_of(lengths)
    menu = lambda b, e: sum(x.linked for x in lines[b:e]) >= LINKED * max(1, sum(lengths[b:e]))
    for b, e in hints:
        if menu(b, e) or max(sums_of(lengths[b:e]), default=0) < surge:
            lines[b:e] = [Line("", landmark=x.landmark) for x in lines[b:e]]
    if any(x.text and x.landmark for x in lines):
        return " ".join(x.text for x in lines if x.text and x.landmark)
    found = [x for x in segments([len(x.text) for x in lines]) if not menu(*x[:2])]
    places = {x.place for b, e, peak in found if peak >= surge for x in lines[b:e] if x.text}
    kept = [peak >= surge or all(x.place in places for x in lines[b:e] if x.text) for b, e, peak in found]
    for k in range(len(found) - 2, -1, -1):
        kept[k] |= kept[k + 1] and all(x.heading for x in lines[slice(*found[k][:2])] if x.text)
    return " ".join(x.text for (b, e, _), keep in zip(found, kept, strict=True) if keep for x in lines[b:e] if x.text)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of the rows (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.select("page_id").schema[0].dataType.simpleString()
    return mapped(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long")
