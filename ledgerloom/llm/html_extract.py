"""Main text of a web page by a tree-structured graphical model.

A page becomes a tree of its block elements with the text blocks as leaves. Each node
is content or not; a node's features give its potential, and each pair of parent and
child has one by the child's kind. Sum-product messages go up to the root and down again
(for all pages of a batch at once, level by level) and give each block's
marginal. The weights maximise the likelihood of labelled pages, made here from
templates by a seed; other labelled pages can be passed.

Cases. Null and empty html give the empty text. Broken markup is read as browsers
do in the main: what is never closed ends with its parent, a paragraph ends where the next begins. Long
pages are read whole, in time in proportion to their length however broken they are. Repeated rows each get their row; equal blocks each
stay in their place; an empty table gives an empty result. Columns that clash with text and n_chars are the caller's to rename.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A tag without an end is over at the next "<"; what opens but never closes is read once, so a page takes time in proportion to its length.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+)(?:>|(?=<)|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
LETTERS = re.compile(r"[a-z]+")
#: Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template iframe object svg math canvas audio video head title select textarea button datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
GROUPS = ("text", "p", "heading", "item", "list", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "quote", "figure", "body", "address", "details", "other")
GROUP_OF = {
    "p": 1, **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 2), **dict.fromkeys(("li", "dt", "dd"), 3), **dict.fromkeys(("ul", "ol", "dl", "menu"), 4), "div": 5, "section": 6,
    "article": 7, "main": 8, "nav": 9, "header": 10, "footer": 11, "aside": 12, **dict.fromkeys(("form", "fieldset", "legend", "label"), 13),
    **dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), 14), **dict.fromkeys(("blockquote", "pre"), 15), **dict.fromkeys(("figure", "figcaption"), 16),
    **dict.fromkeys(("body", "html"), 17), "address": 18, **dict.fromkeys(("details", "summary", "dialog"), 19), **dict.fromkeys(("hgroup", "center", "search"), 20),
}
#: What may not hold what: a start tag closes the open elements named.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody")}
#: Words of class, id and role by what they hint at.
HINTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc topnav sitenav tabs",
    "head": "header masthead topbar logo hero branding", "foot": "footer copyright legal colophon bottom contentinfo",
    "side": "sidebar aside related widget recommended recommendations trending popular complementary rail teaser more",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion promoted dfp adsense",
    "notice": "cookie cookies consent notice notices alert popup modal newsletter subscribe subscription gdpr paywall warning disclaimer overlay toast",
    "comment": "comment comments reply replies discussion disqus respond responses commentlist thread reader readers reactions", "social": "share sharing social follow tags tag meta byline author date",
    "form": "form search login signup register", "good": "content article post entry story main text body page prose",
}
HINT_OF = {w: i for i, ws in enumerate(HINTS.values()) for w in ws.split()}
#: Groups whose amount of text is a feature; a block's own would count once for each of an article's many.
HOLDERS = np.array([5, 6, 7, 8, 10, 11, 12, 13])
N_GROUPS, N_HINTS, N_NUMBERS = len(GROUPS), len(HINTS), 9
N_FEATURES = N_GROUPS + N_HINTS + N_NUMBERS


@dataclass
class Page:
    """Nodes in page order, parents first. linked: characters inside links. block: the text of a leaf, else None."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)
    hints: list[tuple[int, ...]] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    block: list[str | None] = field(default_factory=list)

    def add(self, parent: int, group: int, hints=(), hidden=False, linked=0, block=None) -> int:
        self.parent.append(parent), self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0), self.group.append(group)
        self.hints.append(hints), self.hidden.append(hidden), self.linked.append(linked), self.block.append(block)
        return len(self.parent) - 1


def parse(html: str | None) -> Page:
    page, html = Page(), html or ""
    page.add(-1, 17)
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements and their nodes; an inline one has its block's
    held: list[str] = []
    linked = in_link = unread = at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                page.add(stack[-1][1], 0, linked=min(len(text), linked), block=text)
        linked = 0

    opened: Counter = Counter()  # how many elements of each name are open
    below = [0]  # of each place in stack, the place of the inmost block there or before it

    def push(name: str, node: int) -> None:
        below.append(len(stack) if name in GROUP_OF and name != "label" else below[-1])
        stack.append((name, node))
        opened[name] += 1

    def close(k: int) -> None:
        nonlocal in_link, unread
        if any(name in GROUP_OF for name, _ in stack[k:]):
            flush()
        in_link -= sum(name == "a" for name, _ in stack[k:])
        unread -= sum(name in UNREAD for name, _ in stack[k:])
        opened.subtract(name for name, _ in stack[k:])
        del stack[k:], below[k:]

    while at < len(html):
        m = TOKEN.search(html, at)
        end = m.start() if m else len(html)
        if stack[-1][0] == "head" and "<" not in html[at:end] and html[at:end].strip(" \t\n\r\f"):
            close(len(stack) - 1)
        if end > at and not unread:
            held.append(html[at:end])
            if in_link:
                linked += end - at
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if opened[name] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
            continue
        if unread and name not in IN_HEAD and opened["head"] > 0 and not opened["template"]:  # </head> may be left out
            close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "head"))
        if name == "br" or name == "hr":
            held.append(" ")
        if name in VOID or name in ("html", "body"):
            continue
        if name in RAW:
            shut = re.compile(f"</{name}", re.I).search(html, at)
            at = shut.start() if shut else len(html)
        group = GROUP_OF.get(name)
        if group is None:
            in_link += name == "a"
            unread += name in UNREAD
            push(name, stack[-1][1])
            continue
        flush()
        k = len(stack)
        while (k := below[k - 1]) > 0:  # the open blocks from the inmost on: what this element can't be in
            open_ = stack[k][0]
            if open_ == "p" and name != "label":
                close(k)
                break
            if open_ in CLOSES.get(name, ()):
                close(k)
                if name in ("li", "dt", "dd"):
                    break
            else:
                break
        hints, hidden = (), False
        if m[3] and "=" in m[3]:
            for key, value in ATTRIBUTE.findall(m[3]):
                key = key.lower()
                if key in ("class", "id", "role"):
                    hints += tuple(HINT_OF[w] for w in LETTERS.findall(value.lower()) if w in HINT_OF)
                elif key == "style":
                    hidden = hidden or "display:none" in value.lower().replace(" ", "")
                elif key == "aria-hidden":
                    hidden = hidden or "true" in value.lower()
        hidden = hidden or bool(m[3] and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r'"[^"]*"|\'[^\']*\'', "", m[3])))
        push(name, page.add(stack[-1][1], group, hints, hidden))
    flush()
    return page


@dataclass
class Forest:
    """Pages side by side: parent (-1 at roots), nodes by depth, and features."""

    parent: np.ndarray
    group: np.ndarray
    levels: list[np.ndarray]
    features: np.ndarray


def forest(pages: list[Page]) -> Forest:
    sizes = [len(p.parent) for p in pages]
    base = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]) if sizes else np.zeros(0, int), sizes).astype(np.int64)
    every = lambda name: [x for p in pages for x in getattr(p, name)]
    own, depth, group = np.array(every("parent"), np.int64), np.array(every("depth"), np.int64), np.array(every("group"), np.int64)
    parent = np.where(own < 0, -1, own + base)
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
    blocks = every("block")
    chars = np.array([len(b) if b else 0 for b in blocks], float)
    leaf = chars > 0
    end = np.array([bool(b) and b[-1] in ".!?:;…。\"'”»" for b in blocks], float)
    sign = np.array([bool(b) and ("©" in b or "®" in b) for b in blocks], float)
    linked, hidden = np.array(every("linked"), float), np.array(every("hidden"), float)
    total, total_linked, leaves, ends = chars.copy(), linked.copy(), leaf.astype(float), end.copy()
    for nodes in levels[:0:-1]:
        for x in (total, total_linked, leaves, ends):
            np.add.at(x, parent[nodes], x[nodes])
    x = np.zeros((len(own), N_FEATURES))
    rows = np.arange(len(own))
    x[rows, group] = 1
    for i, hs in enumerate(every("hints")):
        for h in hs:
            x[i, N_GROUPS + h] = 1
    n = N_GROUPS + N_HINTS
    x[:, n] = np.minimum(np.log1p(total), 9) / 9
    x[:, n + 1] = total_linked / np.maximum(total, 1)
    holder = ~leaf & (np.isin(group, HOLDERS))
    x[:, n] *= holder
    x[:, n + 2] = holder & (leaves == 1)
    x[:, n + 3] = holder & (leaves >= 4)
    x[:, n + 4] = holder * np.minimum(ends / np.maximum(leaves, 1), 1)
    x[:, n + 5] = sign
    x[:, n + 6] = hidden
    x[:, n + 7] = holder * np.minimum(total / np.maximum(leaves, 1), 400) / 400
    x[:, n + 8] = 1
    return Forest(parent, group, levels, x)


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def sum_product(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """unary: log-potential of content, by node; pair: by group, parent's and child's state. Marginals by node and state, and by (node, parent's state, own state)."""
    own = np.stack([np.zeros(len(unary)), unary], 1)
    up, message = own.copy(), np.zeros((len(unary), 2))
    edge = pair[f.group]
    for nodes in f.levels[:0:-1]:
        message[nodes] = _log_add(edge[nodes] + up[nodes][:, None, :], 2)
        np.add.at(up, f.parent[nodes], message[nodes])
    belief, joint = up.copy(), np.zeros((len(unary), 2, 2))
    for nodes in f.levels[1:]:
        above = belief[f.parent[nodes]] - message[nodes]
        both = above[:, :, None] + edge[nodes] + up[nodes][:, None, :]
        both -= _log_add(both.reshape(len(nodes), 4), 1)[:, None, None]
        joint[nodes] = np.exp(both)
        belief[nodes] = _log_add(both, 1)
    belief -= _log_add(belief, 1)[:, None]
    return np.exp(belief), joint


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def blocks(self, pages: list[Page], cut: float = 0.5) -> list[list[str]]:
        f = forest(pages)
        if not len(f.parent):
            return [[] for _ in pages]
        content = sum_product(f, f.features @ self.weights, self.pair)[0][:, 1] > cut
        out, at = [], 0
        for p in pages:
            out.append([b for b, yes in zip(p.block, content[at : at + len(p.block)], strict=True) if b and yes])
            at += len(p.block)
        return out


def fit(labelled: list[tuple[str, set[str]]], steps: int = 260, rate: float = 0.15, ridge: float = 5e-4) -> Model:
    """labelled: html and the texts of its content blocks. An inner node counts as content if most of its text does. Adam on the likelihood of all nodes."""
    pages = [parse(h) for h, _ in labelled]
    f = forest(pages)
    good, chars = np.zeros(len(f.parent)), np.zeros(len(f.parent))
    at = 0
    for p, (_, texts) in zip(pages, labelled, strict=True):
        for i, b in enumerate(p.block):
            if b:
                good[at + i], chars[at + i] = (b in texts) * len(b), len(b)
        at += len(p.block)
    for nodes in f.levels[:0:-1]:
        np.add.at(good, f.parent[nodes], good[nodes])
        np.add.at(chars, f.parent[nodes], chars[nodes])
    y = (2 * good > chars).astype(np.int64)
    inner = f.parent >= 0
    seen = np.zeros((N_GROUPS, 2, 2))
    np.add.at(seen, (f.group[inner], y[f.parent[inner]], y[inner]), 1)
    w = [np.zeros(N_FEATURES), np.zeros((N_GROUPS, 2, 2))]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, steps + 1):
        marginal, joint = sum_product(f, f.features @ w[0], w[1])
        expected = np.zeros_like(seen)
        np.add.at(expected, f.group[inner], joint[inner])
        for k, g in enumerate((f.features.T @ (y - marginal[:, 1]) / len(pages) - ridge * w[0], (seen - expected) / len(pages) - ridge * w[1])):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] + rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(*w)


def labelled_pages(n: int = 400, seed: int = 3) -> list[tuple[str, set[str]]]:
    """Pages from templates, with the texts of their content blocks."""
    r = random.Random(seed)
    syllables = "ka lo mi ren tas ul ve dor sin pe gra oth nim".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=18: words(a, b).capitalize() + r.choice("...!?")
    prose = lambda a=1, b=5: " ".join(sentence() for _ in range(r.randint(a, b)))
    link = lambda t: f'<a href="/{word()}">{t}</a>'
    name = lambda *c: r.choice(("class", "id")) + f'="{r.choice(c)}"'
    maybe = lambda p, s: s if r.random() < p else ""

    def links(a, b):
        return "<ul>" + "".join(f"<li>{link(words(1, 3))}</li>" for _ in range(r.randint(a, b))) + "</ul>"

    def junk(kind: str) -> str:
        body = {
            "nav": lambda: links(3, 9),
            "head": lambda: r.choice((link(words(1, 3)), f"<h1>{words(1, 3)}</h1><p>{words(2, 6)}</p>", f"<p>{sentence()}</p>")),
            "foot": lambda: r.choice((f"&copy; {words(1, 4)} &middot; {prose(1, 2)}", f"<p>&copy; {words(1, 3)}</p>{links(1, 4)}", f"<p>{prose(1, 3)}</p>")),
            "side": lambda: f"<h3>{words(1, 3)}</h3>" + r.choice((links(2, 7), f"<p>{prose(1, 3)}</p>", f"<p>{link(sentence())}</p><p>{prose(1, 2)}</p>")),
            "ad": lambda: r.choice((prose(1, 3), f"<p>{prose(1, 2)}</p>", link(sentence()))),
            "notice": lambda: r.choice((prose(1, 3), f"<p>{prose(1, 3)}</p><button>{word()}</button>", f"<p>{sentence()} {link(word())}</p>")),
            "form": lambda: f"<label>{words(1, 3)}</label><input name=q><p>{sentence()}</p><button>{word()}</button>",
            "comment": lambda: f"<h3>{words(1, 2)}</h3>" + "".join(r.choice((f'<div class="comment"><p>{prose(1, 3)}</p></div>', f"<li><b>{word()}</b><p>{prose(1, 2)}</p></li>", f"<p>{prose(1, 2)}</p>", f'<article class="comment"><header>{word()}</header><p>{prose(1, 2)}</p></article>')) for _ in range(r.randint(1, 5))),
            "social": lambda: r.choice((links(2, 4), f"<span>{words(1, 2)}</span> {link(word())}")),
        }[kind]()
        if kind == "form":
            return f"<form>{body}</form>" if r.random() < 0.8 else f"<div {name('search-form', 'login')}><form>{body}</form></div>"
        plain = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside"}.get(kind)
        if plain and r.random() < 0.65:
            return f"<{plain}{maybe(0.3, ' ' + name(*HINTS[kind].split()))}>{body}</{plain}>"
        tag = r.choice(("div", "div", "section", "ul" if kind == "comment" and body.count("<li>") else "div"))
        mark = name(*(a + b for a in HINTS[kind].split() for b in ("", "", "-box", "-" + word()))) if kind != "social" else name("share", "social-links", "tags")
        return f"<{tag} {mark}>{body}</{tag}>"

    out = []
    for _ in range(n):
        texts: set[str] = set()

        def block(tag: str, text: str, seen=texts) -> str:
            seen.add(" ".join(text.split()))
            ws = text.split(" ")
            if len(ws) > 4 and r.random() < 0.3:
                k = r.randrange(len(ws))
                ws[k] = r.choice((link(ws[k]), f"<b>{ws[k]}</b>", f"<em>{ws[k]}</em>"))
            inner = " ".join(ws)
            return r.choice((f"<{tag}>{inner}</{tag}>", f"<{tag}>{inner}</{tag}>", f"<{tag}><b>{inner}</b></{tag}>", f"<{tag}>{inner}" if tag == "p" else f"<{tag}>{inner}</{tag}>"))

        article = [block("h1", words(2, 9))] if r.random() < 0.85 else []
        sparse = r.random() < 0.3  # short articles, odd texts
        for _ in range(r.choice((1, 2, 3, 6, 12, 30, 60)) if sparse else r.randint(1, 14)):
            kind = r.random()
            if sparse and kind < 0.8:
                article.append(block("p", r.choice((words(1, 3), words(1, 12), " ".join([word()] * r.randint(3, 40)), " | ".join(words(1, 1) for _ in range(r.randint(3, 30))), words(1, 3) + "."))))
            elif kind < 0.72:
                article.append(block("p", prose(1, 6) if r.random() < 0.85 else words(1, 4) + "."))
            elif kind < 0.8:
                article.append(block(r.choice(("h2", "h3")), words(1, 6)))
            elif kind < 0.87:
                article.append("<ul>" + "".join(block("li", r.choice((words(1, 6), prose(1, 2)))) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.91:
                article.append(block("blockquote", prose(1, 2)))
            elif kind < 0.94:
                article.append("<table><tr>" + "".join(block("td", words(1, 3)) for _ in range(r.randint(2, 4))) + "</tr></table>")
            elif kind < 0.97:
                article.append(block("div", prose(1, 3)))
            else:
                article.append(junk(r.choice(("ad", "side", "social", "notice", "form"))))
        inside = "".join(article) + maybe(0.2, junk("social")) + maybe(0.2, junk("comment"))
        shape = r.random()
        if shape < 0.45:
            core = f"<article{maybe(0.3, ' ' + name('post', 'entry', 'story'))}>{inside}</article>"
        elif shape < 0.6:
            core = f"<main>{maybe(0.5, '<div>')}{inside}</main>"
        elif shape < 0.9:
            core = f"<div {name('content', 'article-body', 'post-content', 'entry', 'main-content', 'story', 'text')}>{inside}</div>"
        else:
            core = f"<section>{inside}</section>" if shape < 0.95 else f"<div>{inside}</div>"
        before = "".join(junk(k) for k in ("notice", "head", "nav", "ad", "form") if r.random() < 0.5)
        after = "".join(junk(k) for k in ("side", "ad", "comment", "form", "notice") if r.random() < 0.4) + maybe(0.8, junk("foot"))
        if r.random() < 0.3:
            core = f"<div {name('wrapper', 'container', 'page', 'layout')}>{maybe(0.5, junk('side'))}{core}{maybe(0.4, junk('side'))}</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{before}{core}{after}</body></html>", texts))
    return out


def extract(pages: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """keep, text and n_chars of each row of pages."""
    model = model or fit(labelled_pages())
    src = pages.select(*keep, F.col(html).alias("__html"))

    def run(batches):
        for batch in batches:
            got = []
            htmls = batch.column(batch.num_columns - 1)
            for k in range(0, batch.num_rows, 200):
                got += ["\n\n".join(b) for b in model.blocks([parse(h) for h in htmls.slice(k, 200).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    return src.mapInArrow(run, T.StructType([*src.drop("__html").schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
