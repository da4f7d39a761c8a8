"""Main text of web pages by a minimum cut over a page's blocks.

A page is cut into blocks at its block elements. A linear classifier turns a block's words, links,
punctuation, tag and surroundings into log-odds of being article text: the capacity to the source where
they are positive, to the sink where negative. Blocks next to each other, and successive blocks in one
parent element, are tied by edges that weaken with the steps between them in the element tree. The
minimum cut parts article from boilerplate; each page is a row of its own, so nothing is shuffled.

Null and empty html give an empty text. Markup may be cut short or badly nested: an unfinished tag or
comment ends the page, an end tag without its start is passed over, a start of ``article`` or ``main``
ends what an element around it said unless that is comments. A page of any length is read whole; time
grows with its length, and the cut's with the blocks that their own costs leave undecided. Repeated
rows give repeated results, other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not read as text at all.
DROPPED = frozenset("head noscript template select datalist button svg math canvas object audio video map".split())
#: Elements whose content is no markup, up to their end tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")}
#: A start tag of one of these ends an open element of the set.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: ... but not beyond one of these.
WALLS = frozenset("ul ol dl table div article section main body aside nav".split())

BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
#: Words of class and id that mark boilerplate; a word may have more letters after those in the second list.
BOILERPLATE_WORDS = frozenset("ad ads adbox adslot adsense gdpr nav navbar menu masthead topbar related rail share sharing social pager pagination popup modal overlay login signin signup search skip hidden legal copyright promo tags toolbar meta byline-share teaser reply replies respond disqus outbrain taboola".split())
BOILERPLATE_STEMS = ("advert", "sidebar", "breadcrumb", "cookie", "consent", "notice", "banner", "sponsor", "newsletter", "subscri", "comment", "footer", "recommend", "widget", "navigation", "disclaimer", "announcement", "alert")
#: ... whose headers are theirs, not the page's.
OWN_HEADER = frozenset("article post entry story".split())
ARTICLE_WORDS = frozenset("article content post entry story maincontent articlebody main prose".split())
NOTICE = re.compile(r"©|\ball rights reserved\b|\bcopyright\b|\bcookies?\b|\bprivacy policy\b|\bterms of (?:use|service)\b|\bsubscribe\b|\bsign (?:up|in)\b|\blog ?in\b|\badvertisement\b|\bsponsored\b|\bshare this\b", re.I)

#: The classifier's weights, in log-odds; lengths count by their logarithm, words of notices outside article elements only.
BIAS, LENGTH, LENGTH_MOST, LINKS, SENTENCE, HEADING, ITEM, NOTICED = -0.6, 0.5, 2.0, -3.0, 0.5, 0.6, -0.3, -1.5
IN_ARTICLE, IN_NAMED, IN_BOILERPLATE, IN_HEADER = 2.5, 1.5, -6.0, -4.0
#: The edges' weights and how fast they fall with steps in the element tree; blocks further apart than FAR steps up are not tied.
ADJACENT, SIBLING, FALL, FAR = 0.8, 0.6, 3.0, 8

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'=/>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", raw, ""), ("start", tag, attributes) and ("end", tag, "") in page order; comments, declarations and raw content left out."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        kind = page[lt + 1 : lt + 2]
        if kind == "!" or kind == "?":
            # an empty comment may close at once
            close = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(close, lt + (2 if close == "-->" else 1))
            if end < 0:
                return
            at = end + len(close)
            continue
        m = TAG.match(page, lt) if kind == "/" or kind.isalpha() else None
        if m is None:
            if not (kind.isascii() and kind.isalpha() or kind == "/"):
                yield "text", "<", ""
                at = lt + 1
                continue
            # a bad or unfinished tag: up to the next end of a tag, or of the page
            end = page.find(">", lt)
            if end < 0:
                return
            at = end + 1
            continue
        tag, at = m[2].lower(), m.end()
        if m[1]:
            yield "end", tag, ""
            continue
        yield "start", tag, m[3]
        if tag in RAW:
            end = RAW[tag].search(page, at)
            if end is None:
                return
            at = end.start()


def region_of(tag: str, attributes: str, around: str) -> str:
    """What an element says of its content: "article", "named" (by its class), "header", "comments", "boilerplate" or what is said around it."""
    names, hidden, role = [], False, ""
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key in ("class", "id"):
                names += [w.lower() for w in NAME_WORD.findall(value)]
            elif key == "role":
                role = value.lower()
            elif key == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            elif key in ("hidden", "aria-hidden"):
                hidden |= key == "hidden" or value.lower() == "true"
    if tag in ("html", "body") or "has" in names or "with" in names:
        # of a whole page's layout
        names = []
    if any(w.startswith("comment") or w == "disqus" for w in names) or around == "comments":
        return "comments"
    good = any(w in ARTICLE_WORDS for w in names)
    bad = hidden or tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES
    if names and not bad:
        bad = any(w in BOILERPLATE_WORDS or w.startswith(BOILERPLATE_STEMS) for w in names) or "header" in names and not OWN_HEADER.intersection(names)
    if bad:
        return "boilerplate"
    if tag in ("article", "main") or role in ("article", "main"):
        return "article"
    if around == "boilerplate":
        return around
    if tag == "header" and around not in ("article", "named"):
        return "header"
    return "named" if good and around == "" else around


class Block:
    __slots__ = ("element", "linked", "region", "tag", "text")

    def __init__(self, text: str, linked: int, tag: str, element: int, region: str):
        self.text, self.linked, self.tag, self.element, self.region = text, linked, tag, element, region


class Page:
    """The blocks of a page and the parents of its elements."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parents: list[int] = [0]
        #: open elements: tag, number, region, place of the innermost open block element; and how many are open of each tag
        self.open: list[tuple[str, int, str, int]] = [("", 0, "", 0)]
        self.count: Counter[str] = Counter()
        self.raw: list[str] = []
        self.linked, self.dropped, self.links = 0, 0, 0
        for kind, value, attributes in tokens(page):
            if kind == "text":
                if not self.dropped:
                    self.raw.append(entities.unescape(value) if "&" in value else value)
                    if self.links:
                        self.linked += len(value)
            elif kind == "start":
                self.start(value, attributes)
            else:
                self.end(value)
        self.flush()

    def flush(self) -> None:
        if self.raw:
            text = " ".join("".join(self.raw).split())
            if text:
                tag, element, _, _ = self.open[self.open[-1][3]]
                self.blocks.append(Block(text, min(self.linked, len(text)), tag, element, self.open[-1][2]))
            self.raw, self.linked = [], 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            self.close_to({"p"}, WALLS)
        elif tag == "br":
            self.raw.append(" ")
        if tag in ENDS:
            self.close_to(ENDS[tag], WALLS)
        if tag in VOID:
            return
        self.parents.append(self.open[-1][1])
        self.open.append((tag, len(self.parents) - 1, region_of(tag, attributes, self.open[-1][2]), len(self.open) if tag in BLOCKS else self.open[-1][3]))
        self.count[tag] += 1
        self.dropped += tag in DROPPED or tag in RAW
        self.links += tag == "a"

    def close_to(self, tags: set[str], walls: frozenset[str]) -> None:
        """Close the innermost open element of ``tags``, if no wall stands before it."""
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k][0]
            if tag in tags:
                return self.cut(k)
            if tag in walls:
                return

    def cut(self, k: int) -> None:
        for tag, *_ in self.open[k:]:
            self.count[tag] -= 1
            self.dropped -= tag in DROPPED or tag in RAW
            self.links -= tag == "a"
        del self.open[k:]

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.open) - 1 if self.count[tag] else 0, 0, -1):
            if self.open[k][0] == tag:
                return self.cut(k)

    def steps(self, a: int, b: int) -> int | None:
        """Steps between two elements over their nearest common ancestor, at most FAR up from each; None beyond."""
        ups = {}
        for k in range(FAR):
            ups[a] = k
            if a == 0:
                break
            a = self.parents[a]
        for k in range(FAR):
            if b in ups:
                return ups[b] + k
            if b == 0:
                break
            b = self.parents[b]
        return None


def log_odds(b: Block) -> float:
    """The classifier: log-odds that a block is article text."""
    words = b.text.count(" ") + 1
    odds = BIAS + min(LENGTH_MOST, LENGTH * math.log(1 + words)) + LINKS * b.linked / len(b.text)
    odds += SENTENCE * (b.text[-1] in ".!?…:;\"”»。！？")
    if len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit():
        odds += HEADING
    elif b.tag in ("li", "option", "td", "dt"):
        odds += ITEM
    if b.region != "article" and words < 40 and NOTICE.search(b.text):
        odds += NOTICED
    return odds + {"article": IN_ARTICLE, "named": IN_NAMED, "header": IN_HEADER, "boilerplate": IN_BOILERPLATE, "comments": IN_BOILERPLATE}.get(b.region, 0.0)


def smoothness(page: Page) -> list[tuple[int, int, float]]:
    """(i, j, weight): edges between adjacent blocks, and between a block and the last one before it in the same parent element."""
    edges, last = [], {}
    for i, b in enumerate(page.blocks):
        if i:
            d = page.steps(page.blocks[i - 1].element, b.element)
            if d is not None:
                edges.append((i - 1, i, ADJACENT * math.exp(-d / FALL)))
        parent = page.parents[b.element]
        j = last.get(parent)
        if j is not None and j < i - 1:
            edges.append((j, i, SIBLING * math.exp(-2 / FALL)))
        last[parent] = i
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side of a minimum cut. ``odds``: capacity to the source, to the sink where negative.

    A node whose own capacity is at least that of all its edges is on its own side in some minimum cut; it is settled
    first and its edges become capacities of its neighbours. The maximum flow is sought for what is left.
    """
    n, own = len(odds), list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[b][a] = near[a].get(b, 0.0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(own[i]) >= sum(near[i].values()) - 1e-12:
            side[i] = own[i] >= 0
            for j, w in near[i].items():
                own[j] += w if side[i] else -w
                del near[j][i]
                queue.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, up in zip(rest, maximum_flow({i: own[i] for i in rest}, {i: near[i] for i in rest})):
            side[i] = up
    return [bool(x) for x in side]


def maximum_flow(own: dict[int, float], near: dict[int, dict[int, float]]) -> list[bool]:
    """For each node, in order, whether the source still reaches it when the flow is largest (shortest augmenting levels)."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in own} | {source: {}, sink: {}}
    for i, c in own.items():
        a, b = (source, i) if c > 0 else (i, sink)
        room[a][b], room[b][a] = abs(c), 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, c in room[a].items():
                if c > 1e-12 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return [i in level for i in own]
        left = {a: iter(list(room[a])) for a in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                most = min(room[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    room[x][y] -= most
                    room[y][x] += most
                # back to before the first full edge
                path = path[: next(k for k, (x, y) in enumerate(zip(path, path[1:])) if room[x][y] <= 1e-12) + 1]
                continue
            for b in left[a]:
                if room[a][b] > 1e-12 and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                path.pop()
                if path:
                    level.pop(a)


def main_text(page: str | None) -> str:
    """The article's blocks, in page order, joined by a line feed."""
    parsed = Page(page or "")
    if not parsed.blocks:
        return ""
    kept = minimum_cut([log_odds(b) for b in parsed.blocks], smoothness(parsed))
    return "\n".join(b.text for b, k in zip(parsed.blocks, kept) if k)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h.as_py()) for h in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (the main text, "" if there is none) and n_chars (its code points)."""
    read = pages.select("page_id", "url", "html")
    kinds = dict(read.dtypes)
    return read.mapInArrow(_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
