"""Main text of web pages by tree scoring.

Each page is read into a tree.  Every paragraph gets points for its length and its commas and passes them to
its ancestors, the nearest in full and farther ones in part; a container's points are discounted by the
share of its text that lies in links.  The best container is kept (with the ``article`` or ``main`` that holds it,
if there is one), and those of the article's siblings that score near it or are plain long paragraphs.  Where no such element
holds it, its siblings and those of its ancestors with prose, headings, lists or the like, few of it in links, are the
text too, and all that stands between them and is not mostly links.  Menus, footers, asides, scripts, styles and what is hidden are left out by element, role or visibility.  Forms, headers, sidebars, notices, adverts and reader
comments are only suspects, by element, role or name: a suspect that holds most of the page is its wrapper and stays, and
so does one that is a section of the text by its share of the page's points, its prose and its few links.

Defined results: null or empty html, or html without text, gives the empty text; broken nesting, missing end tags
and stray markup are tolerated; html is read whole; repeated rows give a row each; an empty table gives none.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Comments, raw-text elements with their content, declarations, tags.  A quote counts only after "="; what is not
# closed goes on to the end of the page.  Possessive, so that every character is read once.
_IN_TAG = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+(?:>|\Z)"
_TOKEN = re.compile(
    r"<!--(?:[^-]++|-(?!->))*+(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|title|select|object)(?=[\s/>])" + _IN_TAG +
    r"(?:[^<]++|<(?!/(?P=raw)[\s/>]))*+(?:</(?P=raw)[^>]*+(?:>|\Z)|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>" + _IN_TAG + ")",
    re.I)
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split())
_LEFT_OUT = frozenset("nav footer aside button menu dialog head input audio video canvas".split())
_ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog alert menu menubar".split())
_PARAGRAPHS = frozenset("p pre td th li dd dt blockquote h1 h2 h3 h4 h5 h6 figcaption caption address".split())
_CONTENT = frozenset("html body article main".split())
# A start tag ends these open elements if they stand above the nearest of the elements that hold them.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
_SCOPE = frozenset("html body div article section main table td th li ul ol blockquote aside nav form header footer".split())

# Words of a class or id: of what is no part of a text; of what may also be a section's name; of reader comments; and
# words that say nothing beside them.  "has-sidebar" and the like name a layout.
_DROP = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|gdpr|popup|modal|newsletter|subscri\w+|sidebar\w*|nav|navbar|breadcrumbs?|"
    r"footer|masthead|topbar|widgets?|toolbar|pagination|pager|login|signup|paywall", re.I)
_MAYBE = re.compile(
    r"banner|consent|notices?|notification\w*|alert|overlay|menu\w*|navigation|discussion|share|sharing|social|related|recommend\w*|"
    r"search\w*|skip|disclaimer", re.I)
_COMMENTS = re.compile(r"comments?|commentlist|disqus\w*|respond|replies|reply", re.I)
_PLAIN = re.compile(
    r"\d*|js|top|bottom|left|right|site|page|main|primary|secondary|global|box|bar|block|area|wrap|wrapper|container|inner|outer|content|"
    r"section|list|items?|links?|posts?|articles?|stories|news|reading|more|icons?|buttons?|btn|form|text|message|panel|region|media|header", re.I)
_LAYOUT = re.compile(r"(?<!\S)(?:has|no|with|without|hide)[-_]\S*", re.I)
_TEXTUAL = frozenset("pre ul ol dl blockquote table figure".split())
_CELLS = frozenset("td th tr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Kinds of suspects: a name beside other words, a section's name alone, a form or header or what no text is called, comments;
# and what is left out in any case.
_BESIDE, _ALONE, _NAMED, _READERS, _HARD = 1, 2, 3, 4, 5
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

ANCESTORS = 5          # that a paragraph passes points to
SIBLING_SHARE = 0.2    # of the best score, for a sibling container
SIBLING_CHARS = 80     # for a sibling paragraph
SIBLING_LINKS = 0.25   # most link density of a sibling
WRAPPER_REST = 0.5     # most points outside a wrapper, of its own
WRAPPER_LINKS = 0.5    # most link density of a wrapper
SECTION_SHARE = {_ALONE: 0.1, _NAMED: 0.34}  # least share of the page's points of a suspect that is a section of the text
PROSE_CHARS = 80       # of a block of prose


def _worth(text: str) -> float:
    """Points of a block of text."""
    return 1 + text.count(",") + len(text) / 100


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}


class Page:
    """The tree of one page: parallel lists over nodes, and its text blocks in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.out, self.article = ["#"], [-1], [False], [False]
        self.attrs = [""]
        self.suspect, self.cover = [0], [0]  # kind of suspect; the innermost suspect that holds the node, or 0
        self._count: Counter[str] = Counter()  # open elements by tag
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self._open, self._text, self._linked, self._links = [0], [], 0, 0
        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                self._add(html[at:m.start()])
            at = m.end()
            tag = m["tag"]
            if tag:
                (self._end if m["end"] else self._start)(tag.lower(), m["attrs"])
        self._add(html[at:])
        self._break()
        self._judge()

    def _add(self, raw: str) -> None:
        if not self.out[self._open[-1]]:
            text = entities.unescape(raw) if "&" in raw else raw
            self._text.append(text)
            if self._links:
                self._linked += len(text.strip())

    def _break(self) -> None:
        """The text so far is a block of the innermost open block element."""
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                node = next(n for n in reversed(self._open) if self.tag[n] not in _INLINE)
                self.blocks.append((node, text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _close_to(self, depth: int) -> None:
        for n in self._open[depth:]:
            self._links -= self.tag[n] == "a"
            self._count[self.tag[n]] -= 1
        del self._open[depth:]

    def _depth_of(self, tags: set | frozenset, stop: set | frozenset) -> int:
        """Depth of the innermost open element among ``tags`` that no element of ``stop`` hides, or 0."""
        if not any(self._count[t] for t in tags):
            return 0
        for d in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[d]]
            if tag in tags:
                return d
            if tag in stop:
                return 0
        return 0

    def _start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        if tag not in _INLINE:
            self._break()
            if d := self._depth_of({"p"}, _SCOPE):  # a paragraph ends where a block begins
                self._close_to(d)
            if tag in _ENDS and (d := self._depth_of(*_ENDS[tag])):
                self._close_to(d)
        if tag in _VOID:
            return
        above = self._open[-1]
        self.tag.append(tag)
        self.parent.append(above)
        self.attrs.append(attrs.rstrip(">/"))
        kind = _HARD if self.out[above] else self._kind(tag, self.attrs[-1], self.article[above])
        self.out.append(kind == _HARD)
        self.suspect.append(0 if kind == _HARD else kind)
        self.cover.append(len(self.tag) - 1 if self.suspect[-1] else self.cover[above])
        self.article.append(self.article[above] or tag in ("article", "main"))
        self._open.append(len(self.tag) - 1)
        self._count[tag] += 1
        self._links += tag == "a"

    def _end(self, tag: str, _: str) -> None:
        if tag not in _INLINE:
            self._break()
        if d := self._depth_of({tag}, {"table", "body"} - {tag} if tag in _INLINE or tag == "p" else set()):
            self._close_to(d)

    @staticmethod
    def _kind(tag: str, attrs: str, inside: bool) -> int:
        """What the element is by itself (0: nothing against it); ``inside``: it stands in an article or main element."""
        if tag in _LEFT_OUT:
            return _HARD
        kind = _NAMED if tag in ("form", "fieldset") or tag == "header" and not inside else 0
        if not attrs.strip() or tag in _CONTENT:
            return kind
        own = _attributes(attrs)
        if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(own.get("style", "")):
            return _HARD
        role = own.get("role", "").lower()
        if role in _ROLES:
            return _HARD
        if tag in _INLINE:
            return kind
        if role in ("form", "search"):
            kind = _NAMED
        for name in _LAYOUT.sub("", f"{own.get('class', '')} {own.get('id', '')}").split():
            parts = re.split("[-_]+", name)
            if any(map(_COMMENTS.fullmatch, parts)):
                return _READERS
            if any(map(_DROP.fullmatch, parts)) or not inside and any(p.lower() == "header" for p in parts):
                kind = _NAMED
            elif any(map(_MAYBE.fullmatch, parts)):
                plain = all(_MAYBE.fullmatch(p) or _PLAIN.fullmatch(p) for p in parts)
                kind = max(kind, _ALONE if plain else _BESIDE)
        return kind

    def _judge(self) -> None:
        """Leave out the suspects that are neither a wrapper of the page nor a section of its text, with their blocks."""
        if not any(self.suspect):
            return
        n = len(self.tag)
        own, points, chars, linked = [0.0] * n, [0.0] * n, [0] * n, [0] * n  # own: by innermost suspect, not of its parts
        prose, headed = [False] * n, [False] * n  # prose under it, a heading under it
        bare, text_in = [False] * n, [False] * n  # by innermost suspect: prose; prose in an article or main element
        for node, text, links in self.blocks:
            worth = _worth(text)
            own[self.cover[node]] += worth
            points[node] += worth
            chars[node] += len(text)
            linked[node] += links
            long = len(text) >= PROSE_CHARS and links < SIBLING_LINKS * len(text)
            prose[node] |= long
            headed[node] |= self.tag[node] in _HEADINGS
            bare[self.cover[node]] |= long
            text_in[self.cover[node]] |= long and self.article[node]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            chars[up] += chars[i]
            linked[up] += linked[i]
            prose[up] |= prose[i]
            headed[up] |= headed[i]
            if self.suspect[i] != _READERS and linked[i] < WRAPPER_LINKS * chars[i]:
                points[up] += points[i]
        stays = [False] * n
        stays[0] = True
        free, loose, loose_text = own[0], bare[0], text_in[0]  # of what is under no suspect that is out
        suspects = [i for i in range(n) if self.suspect[i]]
        for i in sorted(suspects, key=lambda i: (-points[i], i)):  # a wrapper before what it holds
            other = loose if self.suspect[i] == _READERS else loose_text
            if (prose[i] or not loose) and linked[i] < WRAPPER_LINKS * chars[i] and not other \
                    and stays[self.cover[self.parent[i]]] and free < WRAPPER_REST * points[i]:
                stays[i] = True
                free, loose, loose_text = free + own[i], loose or bare[i], loose_text or text_in[i]
        for i in suspects:
            if not stays[i] and stays[self.cover[self.parent[i]]]:
                stays[i] = self._is_section(i, points[i] / (free + points[i]) if points[i] else 0.0, prose[i], headed[i],
                                            linked[i] < SIBLING_LINKS * chars[i])
        self.out = [out or not stays[c] for out, c in zip(self.out, self.cover, strict=True)]
        self.blocks = [b for b in self.blocks if not self.out[b[0]]]

    def _is_section(self, i: int, share: float, prose: bool, headed: bool, text: bool) -> bool:
        """Whether a suspect that is no wrapper is a section of the text; ``text``: little of it is in links."""
        kind, inside = self.suspect[i], self.article[self.parent[i]]
        if not text or kind == _READERS:
            return False
        if kind == _BESIDE:
            return inside or prose
        if not prose:
            return False
        if self.tag[i] in ("form", "fieldset"):
            return share >= SECTION_SHARE[_ALONE if inside else _NAMED]
        return (inside or self.tag[i] == "section") and (share >= SECTION_SHARE[kind] or kind == _ALONE and headed)

    def _kept(self) -> tuple[set[int], set[int]]:
        """The nodes that hold the text, and the numbers of the blocks of it that stand in none of them."""
        n = len(self.tag)
        points, chars, linked = [0.0] * n, [0] * n, [0] * n
        for node, text, links in self.blocks:
            chars[node] += len(text)
            linked[node] += links
            worth = _worth(text)
            to = self.parent[node] if self.tag[node] in _PARAGRAPHS and node else node
            for level in range(ANCESTORS):
                if to < 0:
                    break
                points[to] += worth / (1, 2, 6, 9, 12)[level]
                to = self.parent[to]
        for i in range(n - 1, 0, -1):  # a node's children have larger numbers
            chars[self.parent[i]] += chars[i]
            linked[self.parent[i]] += linked[i]
        density = [b / a if a else 0.0 for a, b in zip(chars, linked, strict=True)]
        score = [p * (1 - d) for p, d in zip(points, density, strict=True)]
        best = max(range(n), key=lambda i: (score[i], -i))
        top = best
        up = best
        while up > 0:  # the article that holds the best container, else the main element
            if self.tag[up] == "article" or self.tag[up] == "main" and self.tag[top] != "article":
                top = up
            up = self.parent[up]
        if not self.article[top]:
            return self._around(top, chars, density, score)
        keep = {top}
        for i in range(n):
            if i != top and self.parent[i] == self.parent[top] and not self.out[i]:
                if self.tag[i] == "p":
                    if chars[i] >= SIBLING_CHARS and density[i] < SIBLING_LINKS:
                        keep.add(i)
                elif self.tag[i] not in _INLINE and score[i] >= SIBLING_SHARE * score[best] and score[i] > 0:
                    keep.add(i)
        return keep, set()

    def _alike(self, i: int, j: int) -> bool:
        """Whether two siblings are of one class, or have neither class nor id and are no cells of a layout."""
        if self.tag[i] != self.tag[j]:
            return False
        (a, a_id), (b, b_id) = ([own.get("class", "").split(), "id" in own] for own in map(_attributes, (self.attrs[i], self.attrs[j])))
        return a == b and bool(a or not a_id and not b_id and self.tag[i] not in _CELLS)

    def _around(self, top: int, chars: list[int], density: list[float], score: list[float]) -> tuple[set[int], set[int]]:
        """``top`` and what belongs to it among its siblings and its ancestors' siblings and own blocks."""
        n = len(self.tag)
        prose, first = [False] * n, [len(self.blocks)] * n
        direct: dict[int, list[int]] = {}
        for at, (node, text, links) in enumerate(self.blocks):
            prose[node] |= len(text) >= PROSE_CHARS and links < SIBLING_LINKS * len(text)
            first[node] = min(first[node], at)
            direct.setdefault(node, []).append(at)
        for i in range(n - 1, 0, -1):
            prose[self.parent[i]] |= prose[i]
            first[self.parent[i]] = min(first[self.parent[i]], first[i])
        below: dict[int, list[int]] = {}
        for i in range(1, n):
            if chars[i]:
                below.setdefault(self.parent[i], []).append(i)
        keep, blocks, path = {top}, set(), top
        while path > 0:
            above = self.parent[path]
            # in page order: node (-1: a block of the ancestor itself), number of its first block, its tag
            items = [(first[i], i, self.tag[i]) for i in below[above]] + [(at, -1, "") for at in direct.get(above, ())]
            items.sort()
            links = [density[i] if i >= 0 else self.blocks[at][2] / len(self.blocks[at][1]) for at, i, _ in items]
            few = [x < SIBLING_LINKS for x in links]
            at_path = next(k for k, (_, i, _) in enumerate(items) if i == path)

            def belongs(k: int, items=items, few=few, path=path) -> bool:
                at, i, tag = items[k]
                if i == path:
                    return True
                if not few[k]:
                    return False
                if i < 0:
                    return len(self.blocks[at][1]) >= PROSE_CHARS
                if tag in _HEADINGS:  # a heading after the text belongs to it by what follows
                    return k < at_path or k + 1 < len(items) and few[k + 1]
                return prose[i] or tag in _TEXTUAL or score[i] >= SIBLING_SHARE * score[top] > 0 or self._alike(i, path)

            sure = [k for k in range(len(items)) if belongs(k)]
            lo, hi = sure[0], sure[-1]
            while lo > 0 and items[lo - 1][2] == "p" and few[lo - 1]:
                lo -= 1
            while hi + 1 < len(items) and (items[hi][2] in _HEADINGS or items[hi + 1][2] == "p") and few[hi + 1]:
                hi += 1
            stays = False  # the item after the present one
            for k in range(hi, lo - 1, -1):
                at, i, tag = items[k]
                if i == path or tag in _HEADINGS and k < hi:
                    stays |= i == path
                else:
                    stays = few[k] or tag == "p" and links[k] < 0.5 or tag in _HEADINGS
                if stays and i >= 0 and i != path:
                    keep.add(i)
                elif stays and i < 0:
                    blocks.add(at)
            path = above
        return keep, blocks

    def text(self) -> str:
        if not self.blocks:
            return ""
        inside, (keep, blocks) = [False] * len(self.tag), self._kept()
        for i in range(len(self.tag)):
            inside[i] = i in keep or i > 0 and inside[self.parent[i]]
        return "\n".join(text for at, (node, text, _) in enumerate(self.blocks) if inside[node] or at in blocks)


def main_text(html: str | None) -> str:
    """The main text of one page."""
    return Page(html).text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``page_id, url, html``."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [main_text(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")
