"""Main text of web pages by composite text density.

Of a page's elements a tree is made, forgiving as browsers are (left-out end tags, stray ones, unclosed comments).  Elements that
say what they are (menus, footers, forms, scripts, adverts, reader comments, by tag, role, class or id) do not count.  Of every
other element the density is known: characters per tag, lowered by the share of characters and tags in links,

    C / T * ln(C * T / (LC * LT)) / ln(ln(C * LC / (C - LC) + C * LCb / Cb + e)),

with its characters C, its tags T, those in links LC and LT, and the body's LCb and Cb.  An element's sum is that of its children's
densities; text of its own counts as a child.  The element with the largest sum is the main text.  The smallest density on its path
to the body is the threshold: wherever an element reaches it, the element with the largest sum in there belongs to the text as well,
since articles may lie in several pieces.  Where a page has ``article`` or ``main`` elements, only these are looked at, an article
is taken whole, and headings come with what follows them.

The work is one pass over each page where it is read: nothing is shuffled, and a task holds one slice of pages.

Special cases: null and empty pages, and pages without main text, have the empty text; character references are decoded as
HTML does, with or without their semicolon; bytes that are no UTF-8 become replacement characters; of equal sums the outermost
and first element counts; pages of any length and depth are taken whole, without recursion; null ids and urls stay null, rows
that repeat are judged each; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm._common import slices

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes, and what it does not reach beyond; all blocks close a paragraph.
_CELLS, _ROWS = ("td", "th"), ("tr", "td", "th")
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (_CELLS, ("tr", "table")), "th": (_CELLS, ("tr", "table")), "tr": (_ROWS, ("table",)),
    "tbody": (("tbody", "thead", *_ROWS), ("table",)), "tfoot": (("tbody", "thead", *_ROWS), ("table",)),
}
_BARRIERS = frozenset("table td th caption button object".split())
_IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: Elements that are never main text, by tag, role or word of class and id.
_OTHER_TAGS = frozenset(
    "head nav footer aside form button select input menu dialog svg canvas object embed template audio video map datalist".split()
) | _RAW
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menus "
    "sidebar sidebars footer breadcrumb breadcrumbs comment comments disqus respond replies discussion cookie cookies consent gdpr "
    "notice notices popup modal newsletter subscribe subscription share sharing social related recommended recommendations login signin "
    "signup search toolbar pagination pager copyright disclaimer masthead topbar skip".split()
)
_ARTICLE_WORDS = frozenset("article post entry story content title headline".split())
_NEGATIONS = frozenset("no has with without".split())

_MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?)*+>""")
_TELLING = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']*))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}

_PLAIN, _OTHER, _HEADER = 0, 1, 2


def _kind(name: str, attributes: str) -> int:
    """Whether an element is main text or not as far as it says so itself; _HEADER: only its headings may be."""
    if name in _OTHER_TAGS:
        return _OTHER
    kind = _HEADER if name == "header" else _PLAIN
    for match in _TELLING.finditer(attributes) if attributes else ():
        key, value = match[1].lower(), (match[2] or "").strip("\"'")
        if key == "role" and value.lower() in _OTHER_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return _OTHER
        if key == "style" and "display:none" in value.lower().replace(" ", ""):
            return _OTHER
        if key in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in _WORD.findall(one)}
                if words & _OTHER_WORDS and not words & _NEGATIONS:
                    return _OTHER
                if "header" in words and not words & _NEGATIONS:
                    kind = _HEADER if words & _ARTICLE_WORDS or name == "header" else _OTHER
    return kind


class Page:
    """The tree of a page: per element its parent, name and kind, and the texts with their element and block."""

    def __init__(self, source: str):
        self.parent, self.name, self.kind = [-1], ["#"], [_PLAIN]
        self.texts: list[tuple[int, int, str]] = []
        self._open, self._held, self._block = [0], {}, 0
        self._read(source)

    def _pop(self, size: int) -> None:
        for k in self._open[size:]:
            self._held[self.name[k]] -= 1
        del self._open[size:]

    def _close(self, names: tuple[str, ...], barriers, outermost: bool = False) -> None:
        """Closes the innermost (or outermost) open element of these names that no barrier hides."""
        if not any(self._held.get(n) for n in names):
            return
        at = None
        for k in range(len(self._open) - 1, 0, -1):
            name = self.name[self._open[k]]
            if name in names:
                at = k
                if not outermost:
                    break
            elif name in barriers:
                break
        if at is not None:
            self._pop(at)

    def _start(self, name: str, attributes: str) -> None:
        block = name not in _INLINE
        if block:
            self._block += 1
        if self._held.get("head") and name not in _IN_HEAD:
            self._close(("head",), ())
        if block and name not in _VOID:
            self._close(("p",), _BARRIERS)
        if name in _CLOSES:
            self._close(*_CLOSES[name], outermost=True)
        self.parent.append(self._open[-1])
        self.name.append(name)
        self.kind.append(_kind(name, attributes))
        if name not in _VOID and name not in _RAW:
            self._open.append(len(self.name) - 1)
            self._held[name] = self._held.get(name, 0) + 1

    def _end(self, name: str) -> None:
        if name not in _INLINE:
            self._block += 1
        if not self._held.get(name):
            return
        barriers = _BARRIERS if name not in _BARRIERS and name not in _CLOSES and name not in ("body", "html") else ()
        for k in range(len(self._open) - 1, 0, -1):
            open_name = self.name[self._open[k]]
            if open_name == name:
                self._pop(k)
                return
            if open_name in barriers or name in _INLINE and open_name not in _INLINE:
                return

    def _text(self, text: str) -> None:
        if text:
            self.texts.append((self._open[-1], self._block, html.unescape(text) if "&" in text else text))

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            mark = _MARKUP.search(source, at)
            self._text(source[at : mark.start()] if mark else source[at:])
            if mark is None:
                return
            if mark[2] is None:
                if mark[0] == "<!--":
                    end = source.find("-->", mark.start() + 2)
                    at = end + 3 if end >= 0 else size
                else:
                    end = source.find(">", mark.end())
                    at = end + 1 if end >= 0 else size
                continue
            rest = _REST.match(source, mark.end())
            if rest is None:
                return
            at, name = rest.end(), mark[2].lower()
            if mark[1]:
                self._end(name)
                continue
            self._start(name, rest[0][:-1] if rest.end() - rest.start() > 1 else "")
            if name in _RAW:
                end = _END[name].search(source, at)
                at = end.start() if end else size


def _states(page: Page, by_class: bool) -> list[int]:
    """Which elements may be main text (_PLAIN), which only hold some (_HEADER, around headings), and which neither (_OTHER)."""
    n, parent, name, kind = len(page.name), page.parent, page.name, page.kind
    if not by_class:
        kind = [_OTHER if t in _OTHER_TAGS and t != "form" else _PLAIN for t in name]
    # What holds an article, or the page's only heading, is a frame whatever it says.
    holds, titled = [False] * n, [False] * n
    for k in range(n - 1, 0, -1):
        up = parent[k]
        holds[up] |= holds[k] or name[k] in ("article", "main") and kind[k] == _PLAIN
        titled[up] |= titled[k] or name[k] == "h1"
    state, inside = [_PLAIN] * n, [False] * n
    for k in range(1, n):
        up = parent[k]
        inside[k] = inside[up] or name[k] in ("article", "main")
        own = kind[k]
        if own and holds[k] and name[k] not in _RAW or name[k] == "form" and titled[k] or name[k] in ("html", "body"):
            own = _PLAIN
        if own == _HEADER and not inside[k] and name[k] == "header":
            own = _OTHER
        if state[up] == _OTHER:
            state[k] = _OTHER
        elif state[up] == _HEADER:
            state[k] = own if own == _OTHER else _PLAIN if name[k] in _HEADINGS else _HEADER
        else:
            state[k] = own
    return state


def _density(c: int, t: int, lc: int, lt: int, of_body: float) -> float:
    if not c:
        return 0.0
    lc, lt, rest = max(lc, 1), max(lt, 1), max(c - lc, 1)
    return c / t * math.log(c * t / (lc * lt)) / math.log(math.log(c * lc / rest + of_body * c + math.e))


def _chosen(page: Page, state: list[int]) -> list[bool]:
    """Which elements are in the main text."""
    alive = [s != _OTHER for s in state]
    n, parent, name = len(page.name), page.parent, page.name
    chars, links, own, own_links = [0] * n, [0] * n, [0] * n, [0] * n
    tags, link_tags, in_link, scope = [1] * n, [0] * n, [False] * n, [0] * n
    for k in range(1, n):
        in_link[k] = in_link[parent[k]] or name[k] == "a"
        # The outermost article, or else main, that an element is in.
        scope[k] = scope[parent[k]] or (k if name[k] == "article" else 0)
    for k, _, text in page.texts:
        if state[k] == _PLAIN:
            length = len(" ".join(text.split()))
            own[k] += length
            own_links[k] += length if in_link[k] else 0
    for k in range(n - 1, -1, -1):
        chars[k] += own[k]
        links[k] += own_links[k]
        link_tags[k] += in_link[k]
        if k and alive[k]:
            up = parent[k]
            chars[up] += chars[k]
            links[up] += links[k]
            tags[up] += tags[k]
            link_tags[up] += link_tags[k]
    of_body = links[0] / max(chars[0], 1)
    density = [_density(chars[k], tags[k], links[k], link_tags[k], of_body) if alive[k] else 0.0 for k in range(n)]
    sums = [_density(own[k], 1, own_links[k], int(in_link[k]), of_body) for k in range(n)]
    for k in range(n - 1, 0, -1):
        if alive[k]:
            sums[parent[k]] += density[k]
    # Articles, else main, else all.
    within = [alive[k] and bool(scope[k]) for k in range(n)]
    if not any(within[k] and own[k] for k in range(n)):
        for k in range(1, n):
            within[k] = alive[k] and (within[parent[k]] or name[k] == "main")
        if not any(within[k] and own[k] for k in range(n)):
            within, scope = alive, [0] * n
    largest = [k if within[k] and chars[k] else -1 for k in range(n)]
    for k in range(n - 1, 0, -1):
        up, best = parent[k], largest[k]
        if best >= 0 and (largest[up] < 0 or sums[best] > sums[largest[up]] or sums[best] == sums[largest[up]] and best < largest[up]):
            largest[up] = best
    if largest[0] < 0:
        return [False] * n
    threshold, k = density[largest[0]], largest[0]
    while k > 0:
        k = parent[k]
        threshold = min(threshold, density[k])
    marked, reached = [False] * n, [False] * n
    for k in range(n):
        reached[k] = alive[k] and density[k] >= threshold and (k == 0 or reached[parent[k]])
        if reached[k] and largest[k] >= 0:
            best = largest[k]
            marked[scope[best] or best] = True
    before = [False] * n  # an element with marked children; its headings before the last of these come with it
    for k in range(n - 1, 0, -1):
        up = parent[k]
        if marked[k]:
            before[up] = True
        elif before[up] and alive[k] and name[k] in _HEADINGS:
            marked[k] = True
    for k in range(1, n):
        marked[k] = alive[k] and (marked[k] or marked[parent[k]])
    return marked


def main_text(source: str) -> str:
    """The main text of one page."""
    page = Page(source)
    state = _states(page, by_class=True)
    if not any(state[k] == _PLAIN and not text.isspace() for k, _, text in page.texts):
        state = _states(page, by_class=False)
    chosen = _chosen(page, state)
    blocks: list[str] = []
    last = None
    for k, block, text in page.texts:
        if chosen[k] and state[k] == _PLAIN:
            if block == last:
                blocks[-1] += text
            else:
                blocks.append(text)
                last = block
    return " ".join(" ".join(blocks).split())


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points)."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "html")):
            texts = [main_text(page.decode("utf-8", "replace")) if page else "" for page in part.column("html").to_pylist()]
            columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
