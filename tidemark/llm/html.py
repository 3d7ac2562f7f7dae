"""Main text of web pages by tag-path ratios.

A page is read by the tokenizing rules of HTML into a light tree, held in arrays.  For each root-to-leaf tag
path the length and punctuation of its text are added up and set against the number of nodes; the two ratios
are smoothed along the page, fused, and paths above a share of the spread are content.  The smallest element that
holds nearly all text of content paths is the article's core.  The article is the ``article`` or ``main``
around the core, or else the highest element up to which what is added is for the most part prose.  All its
blocks are kept, short ones too, but for elements that are page furniture by tag, role or name, and lists of
bare links beside the core.  A name that only hints at furniture removes nothing from the article that the
paths call content.

Every step takes time and memory in proportion to the page, however it is nested or broken.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from math import exp, sqrt

from pyspark.sql import DataFrame

from . import common

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title xmp iframe noembed noframes".split())
FURNITURE = frozenset("nav footer aside header form button select option dialog menu object canvas audio video label input fieldset head template svg math".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption body html li dd dt option optgroup tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What stands in a page's head; anything else ends it.
IN_HEAD = frozenset("title meta link script style base noscript template html head".split())
#: Elements beyond which an end tag inside them doesn't reach, and those that are closed as parts of a table.
SCOPES = frozenset("table td th caption object template button select".split())
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
#: What an opening tag ends, and the elements beyond which it doesn't look.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
#: Whole names that mark furniture, whole names and parts of names that hint at it, and what marks an advert on any element.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup comment"
    " comments commentlist disqus sidebar sidebars nav navs navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead toolbar topbar share sharing social related login".split()
)
HINTS = frozenset("header footers headers side rail widget widgets overlay respond reply replies reaction reactions review reviews recommended recommendations tag tags taglist meta byline search skip hidden toc alerts popups modals banners".split())
PARTS = NAMES - {"alert", "notice", "promotion", "login", "banner"} | {"banner", "notice", "login", "respond"}
REMARKS = frozenset("comment comments disqus".split())
ADVERTS = frozenset("ad ads advert advertisement sponsored cookie-notice cookie-banner newsletter".split())
#: Elements whose names say nothing of furniture, but for adverts.
NAMED_FREELY = frozenset("article main p h1 h2 b i em strong a span".split())
#: Blocks whose text is prose.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
LISTS = frozenset("ul ol table div".split())
#: Elements that are no core by themselves.
SMALL = frozenset("p li pre h1 h2 td blockquote".split())

SIMPLE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)\s*(/?)>")
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
GAP = re.compile(r"[\s/]*")
ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
COMMENT_END = re.compile(r"--!?>")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?…、。！？]")

#: Smoothing radius and width, the share of the spread a path must exceed, and how much text the core holds.
RADIUS, WIDTH, SPREAD, HELD = 2, 1.0, 0.8, 0.9


def _by_name(tag: str, value: str) -> int:
    """What a class or id says of an element: 2 it is furniture, 1 it may be, 0 nothing."""
    said = 0
    for token in value.split():
        low = token.lower()
        if tag in NAMED_FREELY:
            said = max(said, 2 * (low in ADVERTS))
        elif low in NAMES:
            return 2
        elif low in HINTS:
            said = 1
        else:
            parts = [w.lower() for w in WORDS.split(token) if w]
            if len(parts) > 1 and (parts[0] in REMARKS or parts[-1] in REMARKS):
                return 2
            if len(parts) > 1 and not PARTS.isdisjoint(parts):
                said = 1
    return said


def _furniture(tag: str, attrs: list[tuple[str, str]]) -> int:
    """Whether an element is page furniture: 2 for certain, 1 by a hint of its name, 0 not."""
    if tag in FURNITURE:
        return 2
    said = 0
    if tag not in ("html", "body"):
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES or name == "style" and HIDING.search(value):
                return 2
            if name in ("class", "id"):
                said = max(said, _by_name(tag, value))
    return said


class Page:
    """A page as a tree in arrays; an element's parent always stands before it."""

    def __init__(self, html: str) -> None:
        self.tag, self.up, self.path, self.depth = [""], [0], [0], [0]
        self.out = [False]  # furniture for certain, or inside such
        self.hint = [-1]  # the outermost element around (or itself) that a name hints at
        self.heir = [0]  # the element from which it inherits its place in the article
        self.past = [0]  # itself or, of a header, the element around all headers about it
        #: Text, element, inside a link or not, and the number of its block.
        self.texts: list[tuple[str, int, bool, int]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        tags, ups, paths, depths, outs, hints, heirs, pasts, texts = self.tag, self.up, self.path, self.depth, self.out, self.hint, self.heir, self.past, self.texts
        stack, where, blocks, scopes = [0], {}, [], []
        known_paths: dict[tuple[int, str], int] = {}
        links = block = at = look = 0
        n = len(html)

        def pop_to(i: int) -> None:
            nonlocal links, block
            while len(stack) > i:
                tag = tags[stack.pop()]
                where[tag].pop()
                if tag in BLOCK:
                    blocks.pop()
                    block += 1
                if tag in SCOPES:
                    scopes.pop()
                links -= tag == "a"

        def last(names: tuple[str, ...]) -> int:
            return max((where[t][-1] for t in names if where.get(t)), default=-1)

        def text(until: int) -> None:
            if until > at:
                s = html[at:until]
                s = unescape(s) if "&" in s else s
                if tags[stack[-1]] == "head" and not s.isspace():
                    pop_to(len(stack) - 1)
                texts.append((s, stack[-1], links > 0, block))

        while True:
            lt = html.find("<", look)
            if lt < 0:
                break
            m = SIMPLE.match(html, lt)
            attrs: list[tuple[str, str]] = []
            if m is not None:
                closing, tag, empty, end = m.group(1), m.group(2).lower(), m.group(3), m.end()
            else:
                m = NAME.match(html, lt)
                if m is None:
                    if html[lt + 1 : lt + 2] not in ("!", "?", "/"):
                        look = lt + 1  # a sign of the text
                        continue
                    text(lt)
                    if html.startswith("<!--", lt):
                        m = COMMENT_END.search(html, lt + 2)
                        at = look = m.end() if m else n
                    else:
                        end = html.find(">", lt)
                        at = look = end + 1 if end >= 0 else n
                    continue
                closing, tag, end = html[lt + 1] == "/", m.group(1).lower(), m.end()
                while True:
                    end = GAP.match(html, end).end()
                    if end >= n or html[end] == ">":
                        break
                    m = ATTR.match(html, end)
                    attrs.append((m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""))
                    end = m.end()
                empty = html[end - 1] == "/"
                end += 1
            text(lt)
            at = look = min(end, n)
            if closing:
                mine = where.get(tag)
                if not mine:
                    block += tag == "p"
                elif tag not in ("html", "body"):
                    i = mine[-1]
                    if tag in TABLE:
                        limit = -1 if tag == "table" else last(("table",))
                    elif tag in SCOPES:
                        limit = -1
                    else:
                        limit = (scopes if tag in BLOCK else blocks)[-1:] or [-1]
                        limit = limit[0]
                    if i >= limit:
                        pop_to(i)
                continue
            if where.get("head") and tag not in IN_HEAD:
                pop_to(where["head"][-1])
            if tag in VOID:
                if tag == "hr":
                    block += 1
                elif tag == "br":
                    texts.append((" ", stack[-1], False, block))
                continue
            if tag in RAW:
                m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = look = m.end() if m else n
                continue
            if tag in ("html", "body") and where.get(tag):
                continue
            if tag in CLOSES_P and where.get("p") and where["p"][-1] > (scopes[-1] if scopes else -1):
                pop_to(where["p"][-1])
            if tag in HEADINGS and tags[stack[-1]] in HEADINGS:
                pop_to(len(stack) - 1)
            if tag in IMPLIED:
                ends, stop = IMPLIED[tag]
                beyond = last(stop)
                inner = [x[k] for t in ends if (x := where.get(t)) and (k := bisect_right(x, beyond)) < len(x)]
                if inner:
                    pop_to(min(inner))
            elif tag == "a" and where.get("a") and where["a"][-1] > (blocks[-1] if blocks else -1):
                pop_to(where["a"][-1])
            if empty and tag not in BLOCK:
                continue
            top, i = stack[-1], len(tags)
            heir, inside = top, outs[top]
            if inside and tag in ("h1", "h2") and tags[top] in ("header", "hgroup") and (where.get("article") or where.get("main")):
                inside = outs[pasts[top]]  # the title in an article's header
                heir = top if inside else pasts[top]
            said = _furniture(tag, attrs)
            tags.append(tag)
            ups.append(top)
            heirs.append(heir)
            pasts.append(pasts[top] if tag in ("header", "hgroup") else i)
            paths.append(known_paths.setdefault((paths[top], tag), len(known_paths) + 1))
            depths.append(depths[top] + 1)
            outs.append(inside or said == 2)
            hints.append(hints[top] if hints[top] >= 0 else i if said == 1 else -1)
            where.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
                block += 1
            if tag in SCOPES:
                scopes.append(len(stack))
            links += tag == "a"
            stack.append(i)
        text(n)


def path_scores(nodes: list[tuple[int, int, int]]) -> dict[int, float]:
    """Fused score of each tag path from its nodes' (path, length, punctuation), in page order."""
    paths, count, length, points = path_sums(nodes)
    ratio = [n / c for n, c in zip(length, count, strict=True)]
    marks = [q / c for q, c in zip(points, count, strict=True)]
    kernel = [exp(-(d * d) / (2 * WIDTH * WIDTH)) for d in range(RADIUS + 1)]

    def smooth(xs: list[float]) -> list[float]:
        out = []
        for i in range(len(xs)):
            near = range(max(0, i - RADIUS), min(len(xs), i + RADIUS + 1))
            w = [kernel[abs(i - j)] for j in near]
            out.append(sum(a * xs[j] for a, j in zip(w, near, strict=True)) / sum(w))
        return out

    return {p: a * (1 + b) for p, a, b in zip(paths, smooth(ratio), smooth(marks), strict=True)}


def path_sums(nodes: list[tuple[int, int, int]]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Paths in page order with how many nodes they have, and their length and punctuation in all."""
    at: dict[int, int] = {}
    count, length, points = [], [], []
    for path, n, q in nodes:
        i = at.setdefault(path, len(at))
        if i == len(count):
            count.append(0)
            length.append(0)
            points.append(0)
        count[i] += 1
        length[i] += n
        points[i] += q
    return list(at), count, length, points


def _up_sums(up: list[int], own: list[int]) -> list[int]:
    """Sums over each element and all inside it."""
    sums = own[:]
    for i in range(len(up) - 1, 0, -1):
        sums[up[i]] += sums[i]
    return sums


def _article(page: Page, core: int, solid: list[tuple[int, int, bool]], content: set[int], bare: list[bool]) -> int:
    """The element around ``core`` that holds the whole article."""
    tags, ups = page.tag, page.up
    around = [core]
    while around[-1]:
        around.append(ups[around[-1]])
    marked = [x for x in around if tags[x] in ("article", "main") and not page.out[x]]
    if marked:
        around = around[around.index(marked[0]) : around.index(marked[-1]) + 1]
    n = len(tags)
    at, block, listed = [-1] * n, [-1] * n, [False] * n  # below the nearest of ``around``: that one, the nearest block, whether in a list of links
    for x in around:
        at[x] = x
    for i in range(1, n):
        if at[i] < 0:
            u = ups[i]
            at[i], block[i], listed[i] = at[u], i if tags[i] in BLOCK else block[u], listed[u] or bare[i]
    added = {x: [0, 0] for x in around}  # characters, and those of prose
    for node, size, link in solid:
        if at[node] >= 0 and not listed[node]:
            mine = added[at[node]]
            mine[0] += size
            mine[1] += size * (not link and (page.path[node] in content or block[node] >= 0 and tags[block[node]] in PROSE))
    article = around[0]
    for x in around[1:]:
        size, prose = added[x]
        if 2 * prose < size:
            break
        article = x
    return article


def main_text(html: str) -> str:
    """The article of one page; empty if there is none."""
    page = Page(html)
    tags, ups, n = page.tag, page.up, len(page.tag)
    sized = [(node, size, link, s) for s, node, link, _ in page.texts if not page.out[node] and not s.isspace() and (size := len(s) - s.count(" "))]
    sure = [x for x in sized if page.hint[x[0]] < 0]
    hinted = [x for x in sized if page.hint[x[0]] >= 0] if sure else []
    solid = sure or sized  # a page that is hinted at as a whole is no furniture
    if not solid:
        return ""
    scores = path_scores([(page.path[node], size, len(PUNCTUATION.findall(s))) for node, size, link, s in solid if not link])
    mean = sum(scores.values()) / len(scores) if scores else 0
    spread = sqrt(sum((x - mean) ** 2 for x in scores.values()) / len(scores)) if scores else 0
    content = {p for p, x in scores.items() if x >= SPREAD * spread}
    weights, sizes, linked = [0] * n, [0] * n, [0] * n
    for node, size, link, _ in solid:
        weights[node] += size if page.path[node] in content and not link else 0
        sizes[node] += size
        linked[node] += size * link
    total = sum(weights)
    held, sizes, linked = _up_sums(ups, weights), _up_sums(ups, sizes), _up_sums(ups, linked)
    # The core, the smallest element that holds nearly all text of content paths.
    core = max((i for i in range(n) if held[i] >= HELD * total and (i == 0 or tags[i] in BLOCK and tags[i] not in SMALL)), key=page.depth.__getitem__) if total else -1
    bare = [sizes[i] > 0 and linked[i] >= 0.9 * sizes[i] and tags[i] in LISTS for i in range(n)]
    box = _article(page, core, [x[:3] for x in solid], content, bare) if core >= 0 else -1
    own = -1  # lists of links in the article's own element are part of it
    if box >= 0:
        own = box if tags[box] in ("article", "main") else core if tags[core] not in ("", "html", "body") else -1
    kept = _hinted_content(page, hinted, content, SPREAD * spread, box if own == box else core)
    within, inside = [own == 0] + [False] * (n - 1), [box == 0] + [False] * (n - 1)
    for i in range(1, n):
        within[i] = i == own or within[ups[i]]
        if page.out[i] or hinted and page.hint[i] >= 0 and page.hint[i] not in kept:
            continue
        inside[i] = i == box or inside[page.heir[i]] and (within[i] or not bare[i])
    blocks: dict[int, list[str]] = {}
    for s, node, _, block in page.texts:
        if inside[node]:
            blocks.setdefault(block, []).append(s)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def _hinted_content(page: Page, hinted: list[tuple[int, int, bool, str]], content: set[int], least: float, box: int) -> set[int]:
    """Of the elements in the article that a name hints at, those of whose text content paths hold half or more."""
    if not hinted or box < 0:
        return set()
    within = [box == 0] + [False] * (len(page.up) - 1)
    for i in range(1, len(within)):
        within[i] = i == box or within[page.up[i]]
    paths, count, length, points = path_sums([(page.path[node], size, len(PUNCTUATION.findall(s))) for node, size, link, s in hinted if not link and within[node]])
    prose = content | {p for p, c, n, q in zip(paths, count, length, points, strict=True) if n / c * (1 + q / c) >= least}
    sums: dict[int, list[int]] = {}
    for node, size, link, _ in hinted:
        if within[node]:
            mine = sums.setdefault(page.hint[node], [0, 0])
            mine[0] += size
            mine[1] += size * (not link and page.path[node] in prose)
    return {i for i, (size, good) in sums.items() if 2 * good >= size}


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Main text of every page: ``id_col, url_col, text, n_chars``.

    Pages of any length and nesting are read whole.  Null pages count as empty and give an empty text.  Repeated rows give repeated results; an empty
    table gives an empty result; columns besides the three named are not read.
    """

    def fn(cols: list[list]) -> dict:
        made = [main_text(h or "") for h in cols[2]]
        return {id_col: cols[0], url_col: cols[1], "text": made, "n_chars": [len(t) for t in made]}

    kind = df.schema[id_col].dataType.simpleString()
    url = df.schema[url_col].dataType.simpleString()
    return common.map_rows(df, [id_col, url_col, html_col], fn, f"{id_col} {kind}, {url_col} {url}, text string, n_chars long")
