"""Main text of web pages as a maximum-scoring subsequence (operator 2).

A page is read as a sequence of tokens: runs of words, and tags. Words score positive, tags
negative; one linear scan finds the contiguous region of the best sum, and the text blocks
inside it are the result. A region inside an ``article`` or ``main`` element is widened to the
whole element, so that its short last lines are not lost.

The weights are learned from labelled pages: pages with an ``article`` (or ``main``) element
label their own tokens as content or not, and a token's weight is the log ratio of its
frequency among content and other tokens. Tags are distinguished by name (and by a class of
boilerplate words), open or closed. A boilerplate container (menu, header, footer, sidebar,
notice, advert, form, comments) is one negative token: its words never enter the result, and
an article that goes on after it is not cut off by its length. An ``article`` or ``main`` element
is never inside one (but for an article inside a container of an outer article: a comment or a
teaser). Classes and ids count as whole names, and by their parts where a part says what the element is: the
last word (``site-footer``, ``userComments``) or the first (``comment-list``, ``ad-slot``), unless the name says that the
element only has one (``with-sidebar``). A container that is known by a part of a name for anything but comments and
adverts, and holds more than half of the page's words, is the page's frame and no boilerplate.
Any other element with a boilerplate word in a name (``share-story``) is a negative token of its own
and its words count as any others, less a price at its end. Tag weights are at most 0.
Counts come from a bounded sample (the labelled ones of about ``MAX_LABELLED`` pages by id
hash), the weights of the ``MAX_TAGS`` most frequent tag names; other tags, and a sample without
labelled pages, use the default weights below.

Defined cases: null and empty html give an empty text; unclosed and stray tags are allowed, and cost
the same as any others (a page is read in time proportional to its length); attributes are read one after another, so
what stands inside a value is no attribute, and an apostrophe in an unquoted value quotes nothing;
comments, scripts, styles and other raw elements hold no text; ties go to the first and
shortest region; repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 2_000
MAX_TAGS = 1_000
#: Frames inside each other that are looked through.
MAX_FRAMES = 8
WORD_WEIGHT = 1.0
TAG_WEIGHT = -2.0
#: Default weight of inline tags and of tags that set text blocks.
INLINE_WEIGHT, BLOCK_WEIGHT = 0.0, -0.5
#: Least weight of a whole boilerplate container.
BOILERPLATE_WEIGHT = -3.0
#: Bounds of a learned tag weight.
LOWEST, HIGHEST = -12.0, 0.0

#: Elements whose content is not markup and not text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "canvas", "title", "select", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that do not break a block.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent",
    "cookie", "cookies", "disqus", "footer", "form", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "popup", "promo", "promoted", "related", "replies", "responses", "share", "sharing", "sidebar", "sidenav", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "toolbar", "widget", "widgets",
}
#: Elements that set the blocks of a text.
BLOCKS = {"p", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "table", "tr", "td", "th", "tbody", "thead", "figure", "figcaption", "hr"}
LABEL = {"article", "main"}

#: Words that say what an element is when they end a name, and those that do when they begin one.
LAST_WORDS = BOILERPLATE_WORDS - {"form", "header", "related", "share", "social", "notice", "responses", "widget", "widgets", "toolbar"} | {"notice", "notices"}
FIRST_WORDS = {"ad", "ads", "advert", "advertisement", "comment", "comments", "cookie", "cookies", "consent", "disqus", "footer", "gdpr", "newsletter", "promo", "sidebar", "sponsored", "subscribe"}
#: What a frame of the whole page is never.
NEVER_FRAMES = {"ad", "ads", "advert", "adverts", "advertisement", "comment", "comments", "commentlist", "disqus"}
#: Words by which a name says that an element has something, or not.
HAVING = {"with", "has", "have", "no", "without", "hide", "show", "is"}

# quotes count only behind an equals sign
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def _name_mark(name: str) -> str:
    """What one class or id says: ``*`` boilerplate by a whole name or for what no frame is, ``?`` boilerplate by a
    part of the name, ``~`` a boilerplate word elsewhere in it."""
    if name.lower() in BOILERPLATE_WORDS:
        return "*"
    words = [w.lower() for w in _PART.findall(name)]
    if BOILERPLATE_WORDS.isdisjoint(words):
        return ""
    if HAVING.isdisjoint(words):
        said = {words[-1]} & LAST_WORDS | {words[0]} & FIRST_WORDS
        if said:
            return "?" if said.isdisjoint(NEVER_FRAMES) else "*"
    return "~"


def _mark(name: str, attrs: str) -> str:
    """The strongest mark of an element: ``*`` a boilerplate container, ``?`` one by a part of a name, ``~`` an
    element with a boilerplate word as part of a name."""
    if name in BOILERPLATE:
        return "*"
    if name in LABEL or name in ("html", "body") or not attrs or name in VOID:
        return ""
    found = set()
    for m in _ATTR.finditer(attrs):
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in BOILERPLATE_ROLES:
            return "*"
        if key in ("class", "id"):
            found |= set(map(_name_mark, value.split()))
    return next((x for x in "*?~" if x in found), "")


class _Open:
    """The open elements, with the places of each name and of the containers (so that no end searches the stack)."""

    def __init__(self):
        self.stack: list[tuple[str, str, tuple[bool, bool, bool]]] = []
        self.at: dict[str, list[int]] = {}
        self.walls: list[int] = []

    def push(self, name: str, mark: str, around: tuple[bool, bool, bool]) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if mark == "*" or name in ("table", "ul", "ol", "dl", "div", "section"):
            self.walls.append(len(self.stack))
        self.stack.append((name, mark, around))

    def depth(self, name: str) -> int | None:
        """Where the innermost open element of a name is."""
        return self.at[name][-1] if self.at.get(name) else None

    def close(self, depth: int) -> tuple[list[str], tuple[bool, bool, bool]]:
        """Ends the elements from ``depth`` on: their marks, and the states around the outermost."""
        gone = self.stack[depth:]
        del self.stack[depth:]
        for name, _, _ in gone:
            self.at[name].pop()
        while self.walls and self.walls[-1] >= depth:
            self.walls.pop()
        return [g[1] for g in gone], gone[0][2]


def _read(page: str, frames: set[int]) -> tuple[list[tuple[str, str, bool, bool]], list[tuple[int, int]], int]:
    """Tokens; (tag number, words inside) of outermost containers by a part of a name; all words. Tags numbered in
    ``frames`` are no containers."""
    out: list[tuple[str, str, bool, bool]] = []
    held = _Open()
    named: list[tuple[int, int]] = []
    running: tuple[int, int, int] | None = None  # an open container by a part of a name: depth, tag number, words so far
    boiler = label = article = False
    pos, n, number, words = 0, len(page), 0, 0
    while pos < n:
        m = _TOKEN.search(page, pos)
        text = page[pos : m.start()] if m else page[pos:]
        if text:
            text = _html.unescape(text)
            words += len(text.split())
            out.append(("w", text, boiler, label))
        if not m:
            break
        pos = m.end()
        number += 1
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            depth = held.depth(name)
            ends = ""
            if depth is not None:
                marks, (boiler, label, article) = held.close(depth)
                ends = "*" if "*" in marks else "~" if "~" in marks else ""
                if running and depth <= running[0]:
                    named.append((running[1], words - running[2]))
                    running = None
            out.append(("/" + name + ends, "", boiler, label))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            if not m.group(3).rstrip().endswith("/"):
                pos = end.end() if end else (n if name in ("script", "style") else pos)
            out.append((name, "", boiler, label))
            continue
        mark = _mark(name, m.group(3))
        by_part, mark = mark == "?", "~" if mark == "?" and number in frames else mark.replace("?", "*")
        around = boiler, label, article
        if name in LABEL and not article:
            boiler = False
        out.append((name + mark, "", boiler, label))
        if name in VOID or m.group(3).rstrip().endswith("/"):
            boiler = around[0]
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
            depth = held.depth(name)
            # an open one of the same kind ends here, unless a container was opened inside it
            if depth is not None and not (held.walls and held.walls[-1] > depth):
                around = boiler, label, article = held.close(depth)[1]
        if by_part and mark == "*" and not boiler and running is None:
            running = len(held.stack), number, words
        held.push(name, mark, around)
        boiler |= mark == "*"
        label |= name in LABEL
        article |= name == "article"
    if running:
        named.append((running[1], words - running[2]))
    return out, named, words


def tokens(page: str) -> list[tuple[str, str, bool, bool]]:
    """(kind, text, boilerplate, labelled) in page order. Kind ``w`` is a run of text, any other
    the name of a tag (with ``/`` if it closes, ``*`` if it opens or closes boilerplate, ``~`` if it
    opens or closes an element with a boilerplate word in a name)."""
    frames: set[int] = set()
    while True:
        out, named, words = _read(page, frames)
        more = {k for k, inside in named if inside * 2 > words}
        if not more or len(frames) >= MAX_FRAMES:
            return out
        frames |= more


def weigh(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Token weights from (content, other) counts: log ratio of smoothed frequencies."""
    inside, outside = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not inside:
        return {}
    size = len(counts)
    ratio = {t: math.log((i + 0.5) / (inside + 0.5 * size)) - math.log((o + 0.5) / (outside + 0.5 * size)) for t, (i, o) in counts.items()}
    out = {t: min(HIGHEST, max(LOWEST, r)) for t, r in ratio.items() if t != "w"}
    out["w"] = min(3.0, max(0.1, ratio.get("w", WORD_WEIGHT)))
    return out


def count_tokens(page: str) -> Counter:
    """Content and other counts of a labelled page's tokens: {(token, in content): count}."""
    out: Counter = Counter()
    for kind, text, boiler, label in tokens(page):
        inside = label and not boiler
        if kind != "w":
            out[kind, inside] += not boiler
        elif not boiler:
            out["w", inside] += len(text.split())
    return out


def region(toks: list[tuple[str, str, bool, bool]], weights: dict[str, float]) -> tuple[int, int]:
    """First and last (exclusive) token of the contiguous region of the largest sum."""
    word = weights.get("w", WORD_WEIGHT)
    best, lo, hi, total, start = 0.0, 0, 0, 0.0, 0
    for i, (kind, text, boiler, _) in enumerate(toks):
        if kind == "w":
            gain = 0.0 if boiler else word * len(text.split())
        elif kind.endswith("*"):
            gain = 0.0 if boiler or kind[0] == "/" else max(weights.get(kind, BOILERPLATE_WEIGHT), BOILERPLATE_WEIGHT)
        elif kind.endswith("~"):
            # the end weighs most: a region starts anew behind a short one, a long one pays for itself
            least = LOWEST if kind[0] == "/" else BOILERPLATE_WEIGHT
            gain = 0.0 if boiler else min(weights.get(kind, least), least)
        else:
            name = kind.strip("/")
            default = INLINE_WEIGHT if name in INLINE else BLOCK_WEIGHT if name in BLOCKS else TAG_WEIGHT
            gain = 0.0 if boiler else weights.get(kind, default)
        if total <= 0:
            total, start = 0.0, i
        total += gain
        if total > best:
            best, lo, hi = total, start, i + 1
    return lo, hi


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    toks = tokens(page)
    lo, hi = region(toks, weights)
    if any(t[3] for t in toks[lo:hi]):
        # a region in a labelled element is all of that element
        while lo and toks[lo - 1][3]:
            lo -= 1
        while hi < len(toks) and toks[hi][3]:
            hi += 1
    parts: list[str] = []
    for kind, text, boiler, _ in toks[lo:hi]:
        if kind != "w":
            if kind.strip("/*~") not in INLINE:
                parts.append(" ")
        elif not boiler:
            parts.append(text)
    return " ".join("".join(parts).split())


# --- in Spark -----------------------------------------------------------------------


def learn_weights(pages: DataFrame, limit: int = MAX_LABELLED) -> dict[str, float]:
    """Token weights from the labelled pages among about ``limit`` pages, taken by id hash (a share of
    the table, so nothing is sorted). The driver receives one row per tag name."""
    label = F.regexp_like(F.col("html"), F.lit(r"(?i)<(article|main)[\s>]"))
    n = max(1, pages.count())
    sample = pages.where((F.pmod(F.xxhash64("page_id", "url"), F.lit(n)) < limit) & label).select("html")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: Counter = Counter()
            for t in b.column(0):
                total.update(count_tokens(t.as_py() or ""))
            keys = sorted(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())],
                ["token", "inside", "n"])

    got = (
        sample.mapInArrow(rows, "token string, inside boolean, n long").groupBy("token")
        .agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o"))
        .orderBy(F.desc(F.col("i") + F.col("o")), "token").limit(MAX_TAGS).collect()
    )
    return weigh({r[0]: (int(r[1]), int(r[2])) for r in got})


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = [main_text(t.as_py(), weights) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
