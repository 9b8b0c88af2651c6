"""HTML extraction by tag-path ratios.

A page is read once into text nodes, each with its root-to-leaf tag path; nodes of one block are one. Per path the lengths outside
links, punctuation marks and blocks are added up; a path's text ratio (characters a block) and punctuation ratio (marks a block) are
multiplied into one score, scores are smoothed along the page with a short Gaussian window over neighbouring blocks, and a path is
content when its smoothed score reaches a threshold below the page's own weighted mean. That holds for every page. What the markup
says is fused in: text within navigation, headers outside the article, footers, sidebars, forms, scripts and elements whose class, id
or role names a menu, notice, advert or comments is not scored, unless they hold the frame or most of the text; ``article`` or ``main`` bounds what is, and lifts what stands alone in
it; lists of links are menus. Text that stands bare in a container (``div``) counts half beside paragraphs, and outside the subtree
of the paragraphs it is no content. Short blocks beside content (titles, items, cells, captions) stay. A short text of an
element that says nothing of it (``div``) and holds no content is taken for an advert; long prose of an advert or of readers is
not told from the article's without a name.

Defined results: a null or empty html gives an empty text; unclosed and crossed tags are tolerated; very long pages are read
whole, in one pass; repeated rows give repeated results; an empty table gives no rows; other columns are carried only on request.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator
from math import exp

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import carried, table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>", re.S)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes", "svg", "math"}
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_NEVER = {"button", "select", "option", "head", "audio", "video", "canvas", "object", "map", "datalist"} | _RAW
_ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_FRAME = {"article", "main"}
_PAGE = {"html", "body", "article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_LISTS = {"ul", "ol", "dl", "table"}
#: Elements of running text: short ones beside content belong to it.
_TEXT = _INLINE | _HEADINGS | _LISTS | {"p", "li", "dt", "dd", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "figure", "figcaption", "blockquote", "pre", "header", "hgroup", "address", "details", "summary", "center"}
#: What class, id and role say of boilerplate, as whole words of the attribute.
_HINTS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie",
    "cookies", "discussion", "disqus", "footer", "gdpr", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "popup", "promo", "promoted",
    "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "sidenav", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "alert", "responses", "feedback", "login", "signup", "widget",
}
#: Of these, the words of readers' comments.
_COMMENTS = {"comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond", "responses"}
#: Elements that say what their text is.
_TYPED = _HEADINGS | {"li", "dt", "dd", "caption", "td", "th", "figcaption", "blockquote", "pre", "address", "summary"}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?。，…¿¡]")
#: A closing of one of these ends what stands open inside it; of others it ends the innermost of its name only.
_SECTION = {"html", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "td", "tr", "th", "li", "dl", "dd", "dt", "blockquote", "figure", "p", "h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSES_P = _SECTION - {"html", "body", "td", "tr", "th", "li", "dd", "dt"} | {"hr", "pre", "address", "figcaption"}
_SIBLING = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt", {"dl"}), "dd": ("dd", {"dl"}), "tr": ("tr", {"table", "tbody", "thead"}), "td": ("td", {"tr"}), "th": ("th", {"tr"}), "option": ("option", {"select"})}
_SPREAD = 1.0
_PART = 0.5
_BARE = 0.5
#: Of a group's characters, how many in links make it a menu.
_LINKED = 0.6


def _named(tag: str, attrs: str) -> int:
    """0, or what class, id and role say: 1 boilerplate, 2 readers' comments."""
    found = 0
    for m in _ATTR.finditer(attrs):
        if m[1].lower() == "id" and tag in _HEADINGS:
            continue  # an anchor, not a name
        value = m[2] or m[3] or m[4] or ""
        for part in re.split(r"[\s_-]+", value):
            for w in (part, *_WORD.findall(part)):
                if w.lower() in _HINTS:
                    found = max(found, 2 if w.lower() in _COMMENTS else 1)
    return found


class _Page:
    """A page's elements, parents before children, and its text nodes; element 0 is the page itself."""

    def __init__(self) -> None:
        self.tag, self.parent, self.path = [""], [0], [0]
        self.mark, self.never, self.link = [0], [False], [False]
        self.nodes: list[tuple[int, str, int]] = []  # element, text, block number
        self._paths: dict[tuple[int, str], int] = {}

    def add(self, parent: int, tag: str, attrs: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        inline = tag in _INLINE  # inline marks belong to their block
        self.path.append(self.path[parent] if inline else self._paths.setdefault((self.path[parent], tag), len(self._paths) + 1))
        named = _named(tag, attrs) if attrs else 0
        self.mark.append(named or int(tag in _ASIDE))
        hidden = bool(attrs and _HIDDEN.search(attrs)) and tag not in ("html", "body")
        self.never.append(self.never[parent] or tag in _NEVER or hidden)
        self.link.append(self.link[parent] or tag == "a")
        return len(self.tag) - 1

    def under(self, own: list) -> list:
        """Sums of ``own`` over each element and all below it."""
        total = list(own)
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return total


def read_page(page: str) -> _Page:
    """One pass over the page; what no reader sees (scripts, hidden elements, controls) gives no text node."""
    out = _Page()
    stack: list[tuple[str, int]] = []  # tag, element
    at = block = 0
    raw = ""
    while at < len(page):
        if raw:
            end = _RAW_END[raw].search(page, at)
            at, raw = (end.start() if end else len(page)), ""
            continue
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            here = stack[-1][1] if stack else 0
            if not out.never[here]:
                out.nodes.append((here, _html.unescape(text), block))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in _INLINE:
            block += 1
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in _SECTION and tag not in _SECTION:
                    break
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in _SECTION:
                    break
        if tag in _SIBLING:
            own, limit = _SIBLING[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == own or own in ("dt", "dd") and stack[i][0] in ("dt", "dd"):
                    del stack[i:]
                    break
                if stack[i][0] in limit:
                    break
        attrs = m[3] or ""
        if attrs.rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        stack.append((tag, out.add(stack[-1][1] if stack else 0, tag, attrs)))
        if tag in _RAW:
            raw = tag
    return out


def _boilerplate(p: _Page, chars: list[int]) -> list[bool]:
    """Which elements the markup makes boilerplate: the marked ones and all below, unless a mark is outweighed.

    A mark gives way where it would remove the page: over a ``main``, over articles with most of the framed text and no less than
    stands outside of marks, or where a class, id or form holds most of the page's text. Readers' comments can be longer than what
    they comment on, so their words give way only where next to nothing stands outside."""
    n, up, tag = len(p.tag), p.parent, p.tag
    framed, marked = [False] * n, [0] * n
    for e in range(1, n):
        framed[e] = framed[up[e]] or tag[e] in _FRAME
        marked[e] = 0 if tag[e] in _PAGE else p.mark[e] or int(tag[e] == "header" and not framed[e])
    opens = [tag[e] in _FRAME and not p.mark[e] for e in range(n)]
    main = p.under([int(o and t == "main") for o, t in zip(opens, tag, strict=True)])
    leads = p.under([int(o or t == "h1") for o, t in zip(opens, tag, strict=True)])
    slight, said = [False] * n, [False] * n
    for e in range(1, n):
        slight[e] = slight[up[e]] or marked[e] == 1 and not leads[e]
    solid = p.under([0 if x else c for c, x in zip(chars, slight, strict=True)])
    held = p.under(chars)
    for e in range(1, n):
        said[e] = said[up[e]] or marked[e] == 2 and not main[e] and (solid[0] - solid[e]) * 10 >= held[e]
    chars = [0 if x else c for c, x in zip(chars, said, strict=True)]
    held = p.under(chars)
    in_frame = [0] * n  # text of frames that open below
    for e in range(n - 1, 0, -1):
        in_frame[up[e]] += held[e] if opens[e] else in_frame[e]
    bad = [False] * n
    for e in range(1, n):
        bad[e] = bad[up[e]] or bool(marked[e])
    clean = sum(c for c, b in zip(chars, bad, strict=True) if not b)
    for e in range(1, n):
        bad[e] = bad[up[e]] or said[e]
        if marked[e] == 1 and not bad[e] and not main[e]:
            most = held[e] * 2 > held[0] and (tag[e] in ("form", "fieldset") or tag[e] not in _ASIDE and tag[e] != "header")
            bad[e] = not (most or in_frame[e] * 2 > in_frame[0] and in_frame[e] >= clean)
    return bad


def _frame(p: _Page, bad: list[bool], chars: list[int], full: list[int]) -> list[bool]:
    """Which elements lie in the page's ``main`` or ``article``: a feature of their paths, and a bound where the page means it so:
    a ``main``, one only ``article``, or articles with a third of the text. Cards of other pages bound nothing."""
    n, up = len(p.tag), p.parent
    inside, outer = [False] * n, []
    for e in range(1, n):
        inside[e] = not bad[e] and (inside[up[e]] or p.tag[e] in _FRAME)
        if inside[e] and not inside[up[e]] and full[e]:
            outer.append(e)
    held = sum(full[e] for e in outer)
    clean = sum(c for c, b in zip(chars, bad, strict=True) if not b)
    return inside if len(outer) == 1 or any(p.tag[e] == "main" for e in outer) or held * 3 >= clean else [False] * n


def _core(p: _Page, blocks: list[list], inside: list[bool]) -> list[bool]:
    """Which blocks the ratios of their paths make content. A block is [element, text, characters, of these in links]."""
    plain: dict[int, int] = defaultdict(int)
    marks: dict[int, int] = defaultdict(int)
    count: dict[int, int] = defaultdict(int)
    for e, text, size, linked in blocks:
        path = p.path[e]
        plain[path] += size - linked
        marks[path] += len(_PUNCT.findall(text)) if linked < size else 0
        count[path] += 1
    fused = {x: plain[x] / count[x] * (1 + marks[x] / count[x]) for x in plain}
    said = {p.path[e] for e, *_ in blocks if p.tag[_block(p, e)] in _TEXT}
    if said:  # beside elements of running text, text that stands in a mere container counts half
        fused = {x: v if x in said else v * _BARE for x, v in fused.items()}
    own = [fused[p.path[b[0]]] for b in blocks]
    window = [exp(-(d * d) / (2 * _SPREAD**2)) for d in range(-2, 3)]
    smooth: dict[int, float] = defaultdict(float)
    for j, (e, *_) in enumerate(blocks):
        near = [(own[j + d], w) for d, w in zip(range(-2, 3), window, strict=True) if 0 <= j + d < len(own)]
        score = sum(v * w for v, w in near) / sum(w for _, w in near)
        if inside[e]:
            score = max(score, own[j])  # the frame vouches for what stands alone
        smooth[p.path[e]] = max(smooth[p.path[e]], score)
    bar = _PART * sum(min(fused[x], 400.0) * plain[x] for x in plain) / (sum(plain.values()) or 1)
    kept = [smooth[p.path[b[0]]] >= bar and o >= bar * 0.5 for b, o in zip(blocks, own, strict=True)]
    best = max(own, default=0.0)
    return _within_text(p, blocks, kept if any(kept) else [o == best for o in own])


def _within_text(p: _Page, blocks: list[list], core: list[bool]) -> list[bool]:
    """The content without bare text of containers that stand outside the subtree of the content's running text, if there is half as
    much of that at least: an advert is no part of the article beside it, whatever its score."""
    said = [c and p.tag[_block(p, b[0])] in _TEXT for b, c in zip(blocks, core, strict=True)]
    own = [0] * len(p.tag)
    for b, s in zip(blocks, said, strict=True):
        own[b[0]] += b[2] if s else 0
    held = p.under(own)
    if not held[0]:
        return core
    top = max(e for e in range(len(own)) if held[e] == held[0])
    while p.tag[top] in _TEXT and top:
        top = p.parent[top]
    within = [False] * len(own)
    for e in range(len(own)):
        within[e] = e == top or e > 0 and within[p.parent[e]]
    bare = [c and not s and not within[b[0]] for b, c, s in zip(blocks, core, said, strict=True)]
    if held[0] * 2 < sum(b[2] for b, x in zip(blocks, bare, strict=True) if x):
        return core
    return [c and not x for c, x in zip(core, bare, strict=True)]


def _lists_of_links(p: _Page, full: list[int], links: list[int], items: list[int]) -> list[bool]:
    """Which elements lie in a list of two or more items that is mostly links."""
    out = [False] * len(p.tag)
    for e in range(1, len(out)):
        out[e] = out[p.parent[e]] or p.tag[e] in _LISTS and items[e] > 1 and links[e] > _LINKED * full[e]
    return out


def _filled(p: _Page, blocks: list[list], core: list[bool], inside: list[bool], full: list[int], links: list[int]) -> list[bool]:
    """The content blocks and the short ones beside them: titles, items, cells and captions whose nearest element with content
    lies in the content's own container, with nothing but elements of running text between, and which are not mostly links. Code,
    quotes, items, cells and captions need no such nearness."""
    n, up, tag = len(p.tag), p.parent, p.tag
    own = [0] * n
    for b, c in zip(blocks, core, strict=True):
        own[b[0]] += c
    held = p.under(own)
    total = held[0]
    top = max(e for e in range(n) if held[e] == total)
    while top and not (inside[top] and not inside[up[top]]) and (inside[top] or tag[top] in _TEXT):
        top = up[top]
    within, fits, group = [False] * n, [False] * n, [0] * n
    for e in range(n):
        within[e] = e == top or e > 0 and within[up[e]]
        group[e] = e if held[up[e]] else group[up[e]]
        fits[e] = within[e] and (held[e] > 0 or fits[up[e]] and (tag[e] in _TEXT or tag[up[e]] == "header"))
    title = _title(p, blocks, core)
    first, final = core.index(True), len(core) - 1 - core[::-1].index(True)
    kept = []
    for j, ((e, _, size, linked), c) in enumerate(zip(blocks, core, strict=True)):
        g = group[e]
        most = linked > _LINKED * size if held[g] else links[g] > _LINKED * full[g]
        typed = within[e] and (inside[top] or first < j < final) and tag[_block(p, e)] in _TYPED
        kept.append(c or (fits[e] or typed or j == title) and not most)
    return _without_orphans(p, blocks, core, kept)


def _title(p: _Page, blocks: list[list], core: list[bool]) -> int:
    """The page's only h1 where it comes before the content, wherever it stands; else -1."""
    found = [j for j, b in enumerate(blocks) if _heading(p, b[0]) == 1]
    return found[0] if len({_block(p, blocks[j][0]) for j in found}) == 1 and found[0] < core.index(True) else -1


def _without_orphans(p: _Page, blocks: list[list], core: list[bool], kept: list[bool]) -> list[bool]:
    """A heading goes where all that it heads went."""
    head = [_heading(p, b[0]) for b in blocks]
    after = lost = False
    for j in range(len(blocks) - 1, -1, -1):
        if head[j]:
            if kept[j] and not core[j] and head[j] > 1 and lost and not after:
                kept[j] = False
            after = lost = False
        else:
            after, lost = after or kept[j], lost or not kept[j]
    return kept


def _block(p: _Page, e: int) -> int:
    while p.tag[e] in _INLINE:
        e = p.parent[e]
    return e


def _heading(p: _Page, e: int) -> int:
    e = _block(p, e)
    return int(p.tag[e][1]) if p.tag[e] in _HEADINGS else 0


def extract_main_text(page: str | None) -> str:
    """The main text: blocks in page order joined by one space."""
    p = read_page(page or "")
    n = len(p.tag)
    chars = [0] * n
    for e, text, _ in p.nodes:
        chars[e] += 0 if p.link[e] else len(text.strip())
    bad = _boilerplate(p, chars)
    inside = _frame(p, bad, chars, p.under([0 if b else c for c, b in zip(chars, bad, strict=True)]))
    bound = any(inside[e] and text.strip() for e, text, _ in p.nodes)
    blocks: list[list] = []
    last = None
    for e, text, block in p.nodes:
        if bad[e] or bound and not inside[e]:
            continue
        if block != last:
            blocks.append([e, "", 0, 0])
            last = block
        b = blocks[-1]
        if not b[1].strip():
            b[0] = e
        b[1] += text
        b[2] += len(text.strip())
        b[3] += len(text.strip()) if p.link[e] else 0
    blocks = [b for b in blocks if b[2]]
    if not blocks:
        return ""
    sizes, linked, items = [0] * n, [0] * n, [0] * n
    for e, _, size, link in blocks:
        sizes[e] += size
        linked[e] += link
        items[e] += 1
    full, links = p.under(sizes), p.under(linked)
    listed = _lists_of_links(p, full, links, p.under(items))
    rest = [b for b in blocks if not listed[b[0]]]
    if any(b[2] > b[3] for b in rest):  # else the page is its links
        blocks = rest
    kept = _filled(p, blocks, _core(p, blocks, inside), inside, full, links)
    joined = (_SPACE.sub(" ", b[1]).strip() for b, keep in zip(blocks, kept, strict=True) if keep)
    return " ".join(x for x in joined if x)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page; narrow, one page at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [extract_main_text(x) for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    src = pages.select(carried(F.col(id_col)).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = src.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(pages.select(F.col(id_col)).schema[0].dataType))


def op2_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))
