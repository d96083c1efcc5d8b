"""Main text of web pages: boosted trees over DOM nodes, decoded from the root down.

Every block element and every run of inline text is a node.  Trees score each
node by the density of its subtree, its attribute tokens, depth, place among
its siblings and what stands above it.  A node is kept or dropped; dropping one
drops all below it, so no kept text stands in a dropped ancestor.  Of all such
choices the one with the highest likelihood is taken (a sum over the tree).

The trees are trained here, on pages composed from a grammar of page parts with
known roles; no table holds such labels.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.gbdt import BoostedTrees, fit

#: Elements that begin a new block.
BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main aside nav header "
    "footer form fieldset figure figcaption blockquote pre address details summary dialog menu center button select textarea label noscript hr".split()
)
#: Elements whose content is no text of the page, up to their end tags; without one, the first kind takes the rest of the page.
RAW, INERT = frozenset("script style title iframe".split()), frozenset(["template"])
#: What an opening tag closes first, up to the nearest of the fences.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Words in class, id and role, by what they speak for.
WORDS = {
    "main": "article content main post entry body story text prose blog page hentry",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc tabs skip links sitemap",
    "header": "header masthead topbar brand logo banner hero tagline top",
    "footer": "footer foot copyright legal bottom colophon credits",
    "side": "sidebar side aside rail widget related recommended popular trending more teaser",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp sponsors outbrain taboola",
    "notice": "cookie cookies notice consent gdpr alert warning disclaimer modal popup overlay toast privacy paywall message",
    "comment": "comment comments reply replies discussion respond disqus thread reader responses",
    "form": "form search login signup subscribe newsletter register contact input",
    "social": "share sharing social follow like tweet facebook twitter buttons",
}
WORD_KIND = {w: k for k, ws in WORDS.items() for w in ws.split()}
KINDS = list(WORDS)
TAG_GROUPS = {"container": "div section body html center", "main": "article main", "menu": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset button select textarea label dialog", "p": "p", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "item": "li dt dd", "table": "table thead tbody tfoot tr td th caption", "quote": "blockquote pre figure figcaption details summary address", "text": "#text"}
GROUP_OF = {t: k for k, ts in TAG_GROUPS.items() for t in ts.split()}
GROUPS = list(TAG_GROUPS)

#: A comment, a tag or a declaration.  Every part stops where the next one begins and gives nothing back, so a page takes one pass however
#: it is broken; what the page's end cuts off is a token too.  Quotes count behind an equals sign only.
TOKEN = re.compile(
    r"""<(?:!--(?:-?>|.*?--!?>|.*+)|(/?+)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""",
    re.S,
)
#: A character reference by a number of eight digits or more.
LONG_REFERENCE = re.compile(r"&#(?:([0-9]{8,}+)|[xX]([0-9a-fA-F]{8,}+));?")
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Characters of pages whose nodes are scored together.
TOGETHER = 500_000
LABEL = re.compile(r'data-y="([01])"')
SPLIT = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """Nodes in page order, a parent before its children.  Text nodes hold their text."""

    __slots__ = ("tag", "parent", "depth", "kinds", "text", "link", "label")

    def __init__(self):
        self.tag, self.parent, self.depth, self.kinds, self.text, self.link, self.label = ["#root"], [-1], [0], [()], [""], [0], [None]


@functools.lru_cache(4096)
def attribute_kinds(attributes: str) -> tuple[str, ...]:
    found = []
    for m in ATTR.finditer(attributes):
        for w in SPLIT.split(CAMEL.sub("-", m[2] or m[3] or m[4] or "").lower()):
            k = WORD_KIND.get(w) or WORD_KIND.get(w.rstrip("s"))
            if k:
                found.append(k)
    return tuple(found)


def _unescaped(text: str) -> str:
    """Character references decoded; numbers beyond Unicode, however long, become U+FFFD."""

    def short(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        return "\ufffd" if len(digits) > 7 else f"&#{'' if m[1] else 'x'}{digits};"

    return html.unescape(LONG_REFERENCE.sub(short, text) if "&#" in text else text)


class _Stack:
    """Open elements, with the places of each name, so that the nearest of a name is found at once."""

    def __init__(self):
        self.nodes, self.names, self.places = [0], ["#root"], {}

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.nodes))
        self.nodes.append(node)
        self.names.append(name)

    def cut(self, at: int) -> None:
        """Close all elements from this place on."""
        for name in self.names[at:]:
            self.places[name].pop()
        del self.nodes[at:], self.names[at:]

    def nearest(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)


def parse(source: str) -> Page:
    page = Page()
    tags, parents, depths = page.tag, page.parent, page.depth
    stack = _Stack()
    run: list[str] = []
    missing: set[str] = set()  # names without an end tag further on
    links, in_link, at, n = 0, False, 0, len(source)

    def flush() -> None:
        nonlocal links
        if run:
            text = " ".join(_unescaped("".join(run)).split())
            if text:
                up = stack.nodes[-1]
                tags.append("#text")
                parents.append(up)
                depths.append(depths[up] + 1)
                page.kinds.append(())
                page.text.append(text)
                page.link.append(min(links, len(text)))
                page.label.append(page.label[up])
            run.clear()
        links = 0

    def skip(name: str, at: int) -> int:
        """Behind the end tag of an element without text."""
        end = None if name in missing else re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(source, at)
        if end is None:
            missing.add(name)
            return n if name in RAW else at
        return end.end()

    find = TOKEN.search
    while at < n:
        m = find(source, at)
        if m is None:
            run.append(source[at:])
            break
        if m.start() > at:
            run.append(source[at : m.start()])
            if in_link:
                links += m.start() - at
        at = m.end()
        name = m[2]
        if name is None or source[at - 1] != ">":
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = False
            elif name in BLOCKS:
                k = stack.nearest((name,))
                if k > 0:
                    flush()
                    stack.cut(k)
                    in_link = False
                elif name == "p":
                    flush()
        elif name in RAW or name in INERT:
            if not m[3].endswith("/"):
                at = skip(name, at)
        elif name == "br":
            run.append(" ")
        elif name == "a":
            in_link = True
        elif name in BLOCKS:
            flush()
            in_link = False
            while stack.names[-1] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (name != "button" and name != "label"):
                stack.cut(len(stack.nodes) - 1)
            if name in CLOSES:
                ends, fences = CLOSES[name]
                last = stack.nearest(fences)
                while (k := stack.nearest(ends)) > last:
                    closed = stack.names[k]
                    stack.cut(k)
                    if closed == name or name != "tr":
                        break
            if name != "hr":
                up = stack.nodes[-1]
                tags.append(name)
                parents.append(up)
                depths.append(depths[up] + 1)
                page.kinds.append(attribute_kinds(m[3]) if m[3] else ())
                page.text.append("")
                page.link.append(0)
                y = LABEL.search(m[3])
                page.label.append(int(y[1]) if y else page.label[up])
                stack.push(name, len(tags) - 1)
    flush()
    return page


def features(page: Page) -> np.ndarray:
    """A row (32-bit floats) for each node but the root."""
    n = len(page.tag)
    parent = page.parent
    chars = [len(t) for t in page.text]
    words = [t.count(" ") + 1 if t else 0 for t in page.text]
    marks = [t.count(".") + t.count(",") + t.count(";") + t.count("?") + t.count("!") if t else 0 for t in page.text]
    link, leaves, nodes, paragraphs = page.link[:], [1 if t else 0 for t in page.text], [1] * n, [1 if t == "p" else 0 for t in page.tag]
    children = [0] * n
    for k in range(n - 1, 0, -1):
        p = parent[k]
        chars[p] += chars[k]
        words[p] += words[k]
        marks[p] += marks[k]
        link[p] += link[k]
        leaves[p] += leaves[k]
        nodes[p] += nodes[k]
        paragraphs[p] += paragraphs[k]
        children[p] += 1
    order, seen, before, offset, running = [0] * n, [0] * n, [0] * n, [0] * n, 0
    last_at = [-1] * n  # of a parent: its child met last
    left, right = [0] * n, [0] * n
    group = [GROUPS.index(GROUP_OF.get(t, "container")) for t in page.tag]
    same = [0] * n
    own, above = np.zeros((n, len(KINDS)), np.float32), np.zeros((n, len(KINDS)), np.float32)
    above_tags = np.zeros((n, 7), np.float32)
    special = {"menu": 0, "header": 1, "footer": 2, "aside": 3, "form": 4, "main": 5, "heading": 6}
    for k in range(1, n):
        p = parent[k]
        order[k] = seen[p]
        seen[p] += 1
        before[k] = last_at[p]
        if last_at[p] >= 0:
            left[k] = chars[last_at[p]]
            right[last_at[p]] = chars[k]
            same[k] = group[k] == group[last_at[p]]
        last_at[p] = k
        offset[k] = running
        if page.tag[k] == "#text":
            running += chars[k]
        above[k] = above[p]
        above_tags[k] = above_tags[p]
        if page.kinds[p]:
            above[k] = np.maximum(above[k], own[p])
        s = special.get(GROUPS[group[p]])
        if s is not None:
            above_tags[k, s] = 1
        for kind in page.kinds[k]:
            own[k, KINDS.index(kind)] = 1
    below = np.zeros((n, len(KINDS)), np.float32)
    for k in range(n - 1, 0, -1):
        if page.kinds[k] or below[k].any():
            below[parent[k]] = np.maximum(below[parent[k]], np.maximum(own[k], below[k]))
    p = np.array(parent)
    p[0] = 0
    c, w, l, lv, nd = (np.array(v, float) for v in (chars, words, link, leaves, nodes))
    total = max(c[0], 1.0)
    kids = np.array(children, float)
    base = np.stack([
        np.log1p(c), np.log1p(w), l / np.maximum(c, 1), c / nd, w / np.maximum(lv, 1), np.array(marks) / np.maximum(w, 1), np.log1p(lv), np.log1p(kids), np.log1p(np.array(paragraphs)),
        np.array(page.depth, float), np.array(order) / np.maximum(kids[p], 1), np.log1p(np.array(order)), kids[p], c / total, c / np.maximum(c[p], 1), np.array(offset) / total,
        np.log1p(np.array(left)), np.log1p(np.array(right)), np.array(same, float),
    ], 1)
    one = np.eye(len(GROUPS), dtype=np.float32)[group]
    return np.concatenate([base.astype(np.float32), above_tags, one, own, above, below], 1)[1:]


def decode(page: Page, log_odds: np.ndarray) -> list[int]:
    """Text nodes kept by the likeliest choice in which nothing is kept below a dropped node."""
    n = len(page.tag)
    keep = np.concatenate([[0.0], -np.logaddexp(0, -log_odds)]).tolist()
    drop = np.concatenate([[0.0], -np.logaddexp(0, log_odds)]).tolist()
    parent = page.parent
    for k in range(n - 1, 0, -1):  # children come after their parents
        p = parent[k]
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    kept = [True] * n
    out = []
    for k in range(1, n):
        kept[k] = kept[parent[k]] and keep[k] > drop[k]
        if kept[k] and page.tag[k] == "#text":
            out.append(k)
    return out


# -- training pages ---------------------------------------------------------------------------------------------------


class _Composer:
    """Pages from a grammar of sites, parts and habits of markup; each element carries the label of its role.

    Nothing in it is taken from any table: roles, layouts (semantic elements,
    named or nameless boxes, layout tables, bare bodies) and habits (end tags
    left out, upper-case tags, unquoted attributes) are those that public
    documentation of HTML describes, words are random letters.
    """

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = "eeeeaaaiiioounnttrrsslldcmpghbfvkwyzxjq"
        self.vocabulary = ["".join(self.r.choices(letters, k=min(14, 1 + int(self.r.expovariate(0.22))))) for _ in range(1_500)]
        self.habits()

    def habits(self) -> None:
        """Draw the habits of one page's author."""
        r = self.r
        self.keeps_ends = r.choice((1.0, 1.0, 1.0, 0.85, 0.3))
        self.upper = r.random() < 0.06
        self.unquoted = r.random() < 0.1
        self.prefix = r.choice(("", "", "", "site-", "c-", "js-", "t_"))
        self.stops = r.choice((1.0, 1.0, 0.6, 0.0))  # how often sentences have marks at all

    def sentence(self) -> str:
        r = self.r
        ws = r.choices(self.vocabulary, k=r.randint(4, 22))
        ws[0] = ws[0].capitalize()
        if r.random() < self.stops:
            for k in range(len(ws) - 1):
                if r.random() < 0.08:
                    ws[k] += ","
            ws[-1] += r.choices((".", "?", "!", ":"), (20, 1, 1, 1))[0]
        return " ".join(ws)

    def prose(self, lo: int, hi: int) -> str:
        r = self.r
        out = []
        for _ in range(r.randint(lo, hi)):
            s = self.sentence()
            style = r.random()
            if style < 0.06:
                k = s.find(" ") + 1
                s = s[:k] + f'<a href="/p">{s[k:]}</a>'
            elif style < 0.12:
                s = f"<{(e := r.choice(('b', 'i', 'em', 'strong', 'code', 'span')))}>{s}</{e}>"
            out.append(s)
        return r.choice((" ", " ", "\n")).join(out)

    def label(self, lo: int, hi: int) -> str:
        ws = self.r.choices(self.vocabulary, k=self.r.randint(lo, hi))
        return " ".join(w.capitalize() for w in ws) if self.r.random() < 0.5 else " ".join(ws).capitalize()

    def el(self, tag: str, body: str, y: int, names: str = "", close: bool = True) -> str:
        r = self.r
        attr = f' data-y="{y}"'
        if names:
            name = r.choice(names.split())
            value = self.prefix + name + r.choice(("", "", "", "-box", "-1", "s", "Area", "_inner"))
            if r.random() < 0.2:
                value += r.choice((" row", " clearfix", " wide", " is-open"))
            attr += f" {r.choice(('class', 'class', 'class', 'id'))}=" + (value.split(" ")[0] if self.unquoted else f'"{value}"')
        optional = tag in ("p", "li", "td", "tr", "dt", "dd")
        end = f"</{tag}>" if close and not (optional and r.random() > self.keeps_ends) else ""
        return f"<{tag.upper()}{attr}>{body}{end.upper()}" if self.upper else f"<{tag}{attr}>{body}{end}"

    def links(self, lo: int, hi: int, y: int = 0) -> str:
        r = self.r
        items = [f'<a href="/{r.randint(1, 99)}">{self.label(1, 4)}</a>' for _ in range(r.randint(lo, hi))]
        if r.random() < 0.7:
            return self.el(r.choice(("ul", "ul", "ul", "ol")), "".join(self.el("li", i, y) for i in items), y)
        if r.random() < 0.3:
            return "".join(self.el("div", i, y) for i in items)
        return r.choice((" ", " | ", " &middot; ", " / ")).join(items)

    def noise(self, kind: str) -> str:
        r, el = self.r, self.el
        named = "" if r.random() < 0.12 else WORDS[kind]
        box = lambda *more: r.choice(("div", "div", "section", *more))
        some = lambda: r.choice((self.label(3, 14), self.prose(1, 4), el("p", self.prose(1, 4), 0)))
        if kind == "menu":
            body = self.links(2, 12)
            return el("nav", body, 0, r.choice(("", WORDS[kind]))) if r.random() < 0.5 else el(box("ul"), body, 0, named or "list")
        if kind == "header":
            body = el(r.choice(("h1", "div", "p", "a")), self.label(1, 4), 0) + r.choice(("", el("p", self.label(2, 10), 0), el("p", self.sentence(), 0))) + (self.noise("menu") if r.random() < 0.4 else "") + (self.noise("form") if r.random() < 0.15 else "")
            return el("header", body, 0) if r.random() < 0.6 else el("div", body, 0, named or WORDS[kind])
        if kind == "footer":
            body = r.choice((self.label(3, 20), "&copy; 2020 " + self.label(1, 4) + " &middot; " + self.label(3, 9), el("p", self.prose(1, 3), 0) + self.links(2, 6), "".join(el("div", el("h4", self.label(1, 2), 0) + self.links(2, 5), 0) for _ in range(3))))
            return el("footer", body, 0) if r.random() < 0.65 else el(box("p"), body, 0, named or WORDS[kind])
        if kind == "side":
            parts = [el("div", el(r.choice(("h2", "h3", "h4")), self.label(1, 5), 0) + r.choice((self.links(2, 8), some())), 0, r.choice(("", "widget", "box", "related"))) for _ in range(r.randint(1, 4))]
            return el("aside", "".join(parts) if r.random() < 0.7 else some(), 0, named) if r.random() < 0.55 else el(box(), "".join(parts), 0, named or WORDS[kind])
        if kind == "advert":
            body = r.choice((some(), f'<a href="/ad">{self.label(2, 10)}</a>', el("h3", self.label(2, 6), 0) + el("p", self.prose(1, 3), 0)))
            return el(box("aside", "p", "ins"), body, 0, WORDS[kind])
        if kind == "notice":
            body = some() + r.choice(("", el("button", self.label(1, 2), 0)))
            return el(box("p", "aside", "dialog", "noscript"), body, 0, WORDS[kind])
        if kind == "comment":
            author = lambda: r.choice(("", el("b", self.label(1, 2), 0), el("div", self.label(1, 4), 0, "author meta"), el("cite", self.label(1, 2), 0)))
            inner = lambda: r.choice(("div", "li", "article", "p"))

            def one(depth: int) -> str:
                replies = "".join(one(depth + 1) for _ in range(r.randint(0, 2))) if depth < 2 and r.random() < 0.3 else ""
                return el(inner(), author() + r.choice((self.prose(1, 5), el("p", self.prose(1, 6), 0))) + replies, 0, r.choice(("", "comment reply message")))

            return el(box("ul", "ol"), (el(r.choice(("h2", "h3")), self.label(1, 3), 0) if r.random() < 0.6 else "") + "".join(one(0) for _ in range(r.randint(1, 7))), 0, WORDS[kind])
        if kind == "form":
            body = "".join(el("label", self.label(1, 3), 0) + "<input>" for _ in range(r.randint(0, 3))) + r.choice(("", some())) + r.choice(("", el("select", "".join(f"<option>{self.label(1, 2)}" for _ in range(3)), 0))) + el("button", self.label(1, 2), 0)
            return el("form", body, 0, named) if r.random() < 0.85 else el("div", body, 0, WORDS[kind])
        return el(box("ul"), self.links(2, 6), 0, WORDS["social"])

    def block(self) -> str:
        """One block of main text."""
        r, el = self.r, self.el
        kind = r.random()
        if kind < 0.62:
            return el("p", self.prose(1, r.choice((1, 2, 4, 7, 12))) + r.choice(("", "", "", "<br>" + self.prose(1, 2))), 1)
        if kind < 0.72:
            return el(r.choice(("h2", "h3", "h4")), self.label(1, 8), 1)
        if kind < 0.8:
            return el(r.choice(("ul", "ol")), "".join(el("li", r.choice((self.label(1, 6), self.prose(1, 2), el("p", self.prose(1, 2), 1))), 1) for _ in range(r.randint(1, 8))), 1)
        if kind < 0.84:
            return el(r.choice(("blockquote", "div")), r.choice((self.prose(1, 3), el("p", self.prose(1, 3), 1))), 1)
        if kind < 0.87:
            return el("pre", self.label(3, 30), 1)
        if kind < 0.9:
            return el("table", "".join(el("tr", "".join(el(r.choice(("td", "td", "th")), self.label(1, 5), 1) for _ in range(r.randint(2, 4))), 1) for _ in range(r.randint(1, 6))), 1)
        if kind < 0.93:
            return el("dl", "".join(el("dt", self.label(1, 3), 1) + el("dd", self.prose(1, 2), 1) for _ in range(r.randint(1, 5))), 1)
        if kind < 0.96:
            return el("figure", "<img src=x>" + el("figcaption", self.prose(1, 1), 1), 1)
        return self.prose(1, 5) + r.choice(("", "<br><br>" + self.prose(1, 3)))

    def content(self) -> str:
        r, el = self.r, self.el
        parts = [self.block() for _ in range(r.choice((1, 1, 2, 3, 4, 6, 8, 12, 20)))]
        if r.random() < 0.2:  # sections of their own
            parts = [el(r.choice(("section", "div")), "".join(parts[k : k + 3]), 1) for k in range(0, len(parts), 3)]
        if r.random() < 0.85:
            title = el(r.choice(("h1", "h1", "h1", "h2")), self.label(1, 12), 1)
            parts.insert(0, el("header", title + (el("p", self.sentence(), 1) if r.random() < 0.3 else ""), 1) if r.random() < 0.15 else title)
        if r.random() < 0.3:
            parts.insert(r.randint(0, len(parts)), self.noise(r.choice(("advert", "advert", "social", "notice", "side", "form", "menu"))))
        if r.random() < 0.2:
            parts.append(self.noise(r.choice(("comment", "comment", "footer", "side", "social"))))
        return "".join(parts)

    def page(self) -> str:
        self.habits()
        r, el, body = self.r, self.el, self.content()
        kind = r.random()
        if kind < 0.35:
            core = el("article", body, 1, r.choice(("", "", WORDS["main"])))
            if r.random() < 0.3:
                core = el("main", core, 1)
        elif kind < 0.45:
            core = el("main", body, 1, r.choice(("", "content")))
        elif kind < 0.78:
            core = el(r.choice(("div", "div", "section", "td")), body, 1, WORDS["main"])
        elif kind < 0.92:
            core = el("div", body, 1)
        else:
            core = body
        for _ in range(r.choice((0, 0, 0, 1, 2, 4))):
            core = el("div", core, 1, r.choice(("", "wrapper container row layout page inner col")))
        quiet = r.choice((0.1, 1, 1, 1, 1, 1, 1))  # some pages have next to nothing besides their text
        top = [self.noise(k) for k in ("header", "menu", "notice", "advert", "form", "social") if r.random() < 0.4 * quiet]
        r.shuffle(top)
        end = [self.noise(k) for k in ("comment", "side", "advert", "social", "form", "notice", "menu") if r.random() < 0.25 * quiet]
        r.shuffle(end)
        if r.random() < 0.8 * quiet:
            end.append(self.noise("footer"))
        if r.random() < 0.4 * quiet:
            cells = [core, self.noise("side")] + ([self.noise("menu")] if r.random() < 0.3 else [])
            r.shuffle(cells)
            if r.random() < 0.2:  # a layout table
                core = el("table", el("tr", "".join(el("td", c, 1 if c is core else 0) for c in cells), 1), 1)
            else:
                core = el("div", "".join(cells), 1, r.choice(("", "wrapper container row layout page")))
        page = f'<html>{r.choice(("", "<head>"))}<title>{self.label(2, 8)}</title><body data-y="1">' + "".join(top) + core + "".join(end) + r.choice(("", "</body></html>"))
        return page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.08 else page


@functools.lru_cache(2)
def train(pages: int = 400, seed: int = 3) -> BoostedTrees:
    """Trees for nodes, from composed pages; takes a few seconds, the same each time."""
    composer = _Composer(seed)
    xs, ys = [], []
    for _ in range(pages):
        p = parse(composer.page())
        if len(p.tag) > 1:
            xs.append(features(p))
            ys += [1 if y is None else y for y in p.label[1:]]
    return fit(np.concatenate(xs), np.array(ys, float), rounds=35, rate=0.3)


def main_texts(sources: list[str], trees: BoostedTrees) -> list[str]:
    pages = [parse(s) for s in sources]
    rows = [len(p.tag) - 1 for p in pages]
    parts = [features(p) for p, n in zip(pages, rows, strict=True) if n]
    odds = trees.log_odds(np.concatenate(parts)) if parts else np.zeros(0)
    out, at = [], 0
    for p, n in zip(pages, rows, strict=True):
        out.append("\n".join([p.text[k] for k in decode(p, odds[at : at + n])]))
        at += n
    return out


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), trees: BoostedTrees | None = None) -> DataFrame:
    """``id_col``, the columns of ``keep``, text (string), one row for each input row.

    Null html counts as empty; a page without main text gets an empty one.
    Whole pages are read, in one pass however broken their markup; character
    references are decoded, white space inside a block becomes one space, blocks
    are joined by a line feed in page order.  Repeated rows give repeated rows,
    an empty table none; other columns are not read.
    """
    trees = trees or train()
    names = [id_col, *keep, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, size = [], [], 0
            for x in batch.column(batch.num_columns - 1):  # so many pages at once that their nodes take little memory
                held.append(x.as_py() or "")
                size += len(held[-1])
                if size >= TOGETHER:
                    texts += main_texts(held, trees)
                    held, size = [], 0
            texts += main_texts(held, trees)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=names)

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return pages.select(id_col, *keep, F.col(html_col).cast("string").alias("_html")).mapInArrow(run, f"{kinds}, text string")
