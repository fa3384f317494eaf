"""Main text of web pages: flat text blocks, described by themselves and their neighbours, classified by a decision tree.

A page is cut into blocks at block-level tags; inline tags and line breaks stay inside a block. A block has its word count and link density,
those of the blocks before and behind it, whether it lies in an article or in a part that is never main text (menu, footer,
advert, form, reader comments ...), whether it is a heading or ends as a sentence, and whether the page has an article at all.
The tree is grown from the labelled rows in LABELLED alone, so a page's result depends on that page only.

Formulas are part of their sentence. Without their end tag only script, style and comments run to the end of the page; other elements without text of the
page (RAW) are then passed over as tags. `head` only separates blocks, as its end tag may be left out.

A null or empty html gives the empty text; malformed markup is read as text where no tag can be made out of it; repeated rows get the same
result each, other columns are ignored, a table without rows gives none."""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements by their role in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle merror mpadded mphantom semantics annotation annotation-xml".split())
RAW = frozenset("script style noscript template svg iframe object canvas title textarea select".split())
#: Without an end tag these hold the rest of the page; copies of a formula that no page shows.
REST = frozenset("script style".split())
NOTES = frozenset("annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FLAT = frozenset("p li dt dd tr td th thead tbody tfoot option".split())           # end where the next one starts: never containers
NEVER = frozenset("nav footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
#: Words in class, id and role attributes that name a part which is never main text, one that is, and one of reader comments.
PARTS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
BODIES = frozenset("article articlebody content entry main maincontent post postbody story".split())
READERS = frozenset("comment comments commentlist disqus discussion replies respond".split())

#: Words of a compound name that tell a state of the page (`has-sidebar`, `comments-open`), words that say nothing about the part, and elements that hold the page or its article.
STATES = frozenset("has with without no is not show hide open closed enabled disabled active on off".split())
PLAIN = frozenset("area bar block bottom box button buttons column container content desktop form global group header icons inner item items left link links list main media mobile page panel posts primary region right section secondary site slot title top unit view wrap wrapper".split())
WHOLE = frozenset("html body main article".split())

_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT = re.compile(r"[^A-Za-z0-9]+")
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW | NOTES}

#: Features of a block, in the order of the columns below.
FEATURES = ("words", "links", "words_before", "links_before", "words_behind", "links_behind", "zone", "heading", "sentence", "has_article")
#: The labelled table: zone is 1 in an article, -1 in a part that is never main text, 0 elsewhere; the last column says whether the block is main text.
LABELLED = """
6 0 0 0 40 0 1 1 0 1 1
10 0 0 0 8 0 1 1 1 1 1
12 0 1 1 60 0 1 1 0 1 1
3 0 0 1 1 0 1 1 1 1 1
1 0 45 0 60 0 1 0 1 1 1
1 0 1 0 1 0 1 0 1 1 1
2 0 30 0 0 0 1 0 0 1 1
40 0 6 0 55 0 1 0 1 1 1
120 0 40 0 80 0 1 0 1 1 1
75 0.1 60 0 20 0 1 0 1 1 1
30 0.5 60 0 90 0 1 0 1 1 1
8 0.3 25 0 40 0 1 0 0 1 1
300 0 12 0 0 0 1 0 1 1 1
7 0 12 0 3 0 1 0 0 1 1
15 0 3 0 90 0 1 0 1 1 1
22 0 90 0 22 0 1 0 0 1 1
1 0 2 0 3 0 1 0 0 1 1
55 0 1 1 0 0 1 0 1 1 1
3 0 16 0 120 0 1 0 1 1 1
200 0 3 0 8 0 1 0 0 1 1
11 0 11 0 11 0 1 0 1 1 1
90 0 250 0 9 0 1 0 1 1 1
16 0 7 0 2 1 1 0 1 1 1
2 0 18 0 0 0 1 0 1 1 1
5 0 120 0 60 0 1 0 0 1 1
33 0 14 0 1 0 1 0 0 1 1
8 0 8 0 35 0 1 1 0 1 1
70 0 2 0 70 0 1 0 1 1 1
4 0 4 0 4 0 1 0 1 1 1
28 0 0 0 0 0 1 0 1 1 1
13 0 70 0 13 0 1 0 0 1 1
150 0 9 0 5 0 1 0 0 1 1
10 0 2 1 25 0 1 0 1 1 1
19 0 110 0 4 1 1 0 1 1 1
6 0 30 0 1 1 1 0 0 1 1
48 0 48 0 48 0 1 0 0 1 1
65 0 5 1 10 0 1 0 0 1 1
4 1 80 0 3 1 1 0 0 1 0
2 1 3 1 2 1 1 0 0 1 0
5 0.9 5 0.9 4 1 1 0 0 1 0
1 1 0 0 1 1 -1 0 0 1 0
1 1 1 1 1 1 -1 0 0 1 0
2 1 2 1 7 0 -1 0 0 1 0
7 0 1 1 10 0 -1 0 1 1 0
9 0 90 0 0 0 -1 0 1 1 0
4 0 60 0 0 0 -1 0 0 1 0
35 0 80 0 20 0 -1 0 1 1 0
60 0 35 0 40 0 -1 0 1 1 0
14 0 200 0 18 0 -1 1 0 1 0
3 0 0 0 1 0 -1 1 0 1 0
25 0.2 40 0 6 0 -1 0 1 0 0
50 0 0 0 70 0 -1 0 1 0 0
5 0 0 0 30 0 -1 1 0 0 0
120 0 90 0 0 0 -1 0 1 0 0
7 0 2 1 9 0 0 0 1 1 0
30 0 1 1 6 0 0 0 1 1 0
3 0 50 0 0 0 0 0 0 1 0
5 0 2 1 12 0 0 1 0 1 0
12 0 90 0 14 0 0 0 1 1 0
25 0 14 0 60 0 0 0 0 1 0
60 0 25 0 0 0 0 0 1 1 0
9 0 0 0 40 0 0 0 1 1 0
4 0 12 0 9 0 0 1 0 1 0
35 0 70 0 35 0 0 0 0 1 0
2 1 2 1 2 1 0 0 0 1 0
80 0 0 0 6 0 0 0 1 1 0
1 1 0 0 1 1 0 0 0 0 0
2 1 2 1 3 1 0 0 0 0 0
3 1 30 0 2 1 0 0 0 0 0
12 0.8 60 0 3 1 0 0 1 0 0
4 0 2 1 2 1 0 0 0 0 0
3 0 1 1 4 1 0 0 0 0 0
3 0 5 1 5 1 0 0 1 0 0
5 0 40 0 0 0 0 0 0 0 0
2 0 80 0 3 1 0 0 0 0 0
7 0 1 1 60 0 0 1 0 0 1
9 0 0 0 45 0 0 1 1 0 1
4 0 70 0 55 0 0 1 0 0 1
45 0 7 0 60 0 0 0 1 0 1
60 0.1 45 0 30 0 0 0 1 0 1
20 0 60 0 50 0 0 0 1 0 1
6 0 50 0 40 0 0 0 1 0 1
3 0 60 0 80 0 0 0 1 0 1
100 0.2 20 0 0 0 0 0 1 0 1
18 0 45 0 4 1 0 0 1 0 1
25 0 3 1 30 0 0 0 1 0 1
9 0 20 0 15 0 0 0 1 0 1
12 0 0 0 10 0 0 0 1 0 1
14 0 2 0 12 0 0 0 1 0 1
10 0 14 0 3 1 0 0 1 0 1
13 0 13 0 0 0 0 0 1 0 1
11 0 3 1 14 0 0 0 1 0 1
2 0 0 0 14 0 0 1 0 0 1
3 0 1 0 13 0 0 1 0 0 1
6 0 0 0 0 0 0 0 0 0 1
8 0 0 0 0 0 0 0 1 0 1
40 0 0 0 0 0 0 0 1 0 1
"""


def _gini(labels: list[int]) -> float:
    p = sum(labels) / len(labels)
    return 2 * p * (1 - p) * len(labels)


def grow(rows: list[tuple[list[float], int]], depth: int = 8) -> tuple | int:
    """A tree of (feature, threshold, at most, above) down to labels: each split takes the feature and midpoint with the least Gini impurity, the first of equals."""
    labels = [y for _, y in rows]
    if depth == 0 or len(set(labels)) == 1:
        return int(2 * sum(labels) >= len(labels))
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            t = (a + b) / 2
            left, right = [y for x, y in rows if x[f] <= t], [y for x, y in rows if x[f] > t]
            cost = _gini(left) + _gini(right)
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, t
    if best is None:
        return int(2 * sum(labels) >= len(labels))
    _, f, t = best
    return f, t, grow([r for r in rows if r[0][f] <= t], depth - 1), grow([r for r in rows if r[0][f] > t], depth - 1)


@lru_cache(maxsize=1)
def tree() -> tuple:
    table = [list(map(float, line.split())) for line in LABELLED.split("\n") if line]
    return grow([(r[:-1], int(r[-1])) for r in table])


def classify(node: tuple | int, x: list[float]) -> int:
    while not isinstance(node, int):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def _named(names: list[list[str]], words: frozenset) -> bool:
    """Whether a name says that the element is such a part: its last word does (`site-footer`; a compound is what its last word is), or some word does and the others say nothing
    (`share-buttons`). A name that tells a state does not."""
    for n in names:
        if n and not STATES.intersection(n) and words.intersection(n) and (n[-1] in words or all(w in words or w in PARTS or w in PLAIN or len(w) < 3 or w.isdigit() for w in n)):
            return True
    return False


def _role(tag: str, attrs: str, zones: list[tuple[str, int, bool]]) -> tuple[int, bool]:
    """Zone and whether it holds reader comments, of an element below the open ones. What holds the page or its article is never made a side part by its names, and in an article
    a discussion is a chapter."""
    zone, readers = (zones[-1][1], zones[-1][2]) if zones else (0, False)
    names = [[w for w in _SPLIT.split(x.lower()) if w] for m in _NAMES.findall(attrs) for x in "".join(m).split()] if attrs else []
    if readers or tag not in WHOLE and _named(names, READERS) and not (zone == 1 and ["discussion"] in names):
        return -1, True
    if tag in MAIN:
        return 1, False
    if tag in NEVER or tag == "header" and zone != 1 or tag not in WHOLE and _named(names, PARTS) or attrs and _HIDDEN.search(attrs):
        return -1, False
    return (1 if zone == 0 and tag not in ("html", "body") and any(BODIES.intersection(n) for n in names) else zone), False


def blocks(page: str) -> Iterator[tuple[str, int, float, int, int]]:
    """(text, words, link density, zone, heading) of each block in page order."""
    zones: list[tuple[str, int, bool]] = []                   # open containers
    parts, linked, heading, in_link, own, at, n = [], 0, 0, False, None, 0, len(page)
    endless: set[str] = set()                                 # tags that are not closed any more

    def behind(tag: str, at: int) -> int:
        end = None if tag in endless else _CLOSE[tag].search(page, at)
        if not end:
            endless.add(tag)
        return end.end() if end else n if tag in REST else at

    def done():
        text = " ".join("".join(parts).split())
        words = text.count(" ") + 1 if text else 0
        zone = own if own is not None else zones[-1][1] if zones else 0
        return (text, words, min(1.0, linked / words), zone, heading) if words else None

    while at < n:
        lt = page.find("<", at)
        if lt != at:
            run = html.unescape(page[at:lt if lt >= 0 else n])
            parts.append(run)
            if in_link:
                linked += len(run.split())
            if lt < 0:
                break
        m = _SKIP.match(page, lt)
        if m:
            at = m.end()
            continue
        m = _OPEN.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at, tag, closing = m.end(), m.group(2).lower(), m.group(1) == "/"
        if tag == "a":
            in_link = not closing and "href" in m.group(3).lower()
        if tag in INLINE:
            if tag in ("br", "wbr"):
                parts.append(" ")
            elif tag in NOTES and not closing and not m.group(3).endswith("/"):
                at = behind(tag, at)
            continue
        block = done()
        if block:
            yield block
        parts, linked, in_link, heading, own = [], 0, False, 0, None
        if tag in RAW:
            if not closing and not (tag == "svg" and m.group(3).endswith("/")):
                at = behind(tag, at)
        elif tag == "head":
            pass
        elif tag in FLAT:
            own = None if closing else _role(tag, m.group(3), zones)[0]
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            heading, own = int(not closing), None if closing else _role(tag, m.group(3), zones)[0]
        elif tag not in VOID:
            if closing:
                open_ = next((i for i in range(len(zones) - 1, -1, -1) if zones[i][0] == tag), None)
                if open_ is not None:
                    del zones[open_:]
            elif not m.group(3).endswith("/"):
                zones.append((tag, *_role(tag, m.group(3), zones)))
    block = done()
    if block:
        yield block


def main_text(page: str | None) -> str:
    """Main blocks of the page, one on a line."""
    found = list(blocks(page or ""))
    article = float(any(b[3] == 1 for b in found))
    out, node = [], tree()
    for i, (text, words, links, zone, heading) in enumerate(found):
        before, behind = found[i - 1] if i else ("", 0, 0.0), found[i + 1] if i + 1 < len(found) else ("", 0, 0.0)
        x = [words, links, before[1], before[2], behind[1], behind[2], zone, heading, float(text[-1] in ".!?…:;\"'»”"), article]
        if classify(node, x):
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""
    def run(batches):
        for b in batches:
            text = [main_text(p) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(run, "page_id long, url string, text string, n_chars long")
