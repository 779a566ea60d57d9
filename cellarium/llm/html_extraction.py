"""Main text of web pages by boosted trees over DOM nodes (operator 6).

Every block element is a node with features: tag group, attribute tokens (class, id, role) in word groups, own
and of the elements around it, depth, size and link share of its subtree, words per block and punctuation in it (subtree
density), its place among its siblings and their sizes, its place in the page. Boosted trees give each node the log-odds that it holds
or encloses main text. Decoding is hierarchical: a node is kept or goes with its whole subtree, so no node is kept inside one that
goes; from the leaves up, a subtree stays if its node's log-odds plus those of the subtrees staying in it are above zero. Where no text stays, the densest
prose does (see `densest`): pages whose elements have neither names nor telling tags give the trees little to go by.

The trees are trained on pages made up here by a seeded rule: many page plans, tags, class names and writing
styles, with the truth known. Training is the same on every machine, takes seconds on the driver, and its
result (some tens of kB) is broadcast. Pages are extracted in place; nothing is shuffled.

Edge cases. Null or empty html gives an empty text. Pages cut off anywhere are read to their end. A page of plain text
without tags is one block. Very long and deep pages are read whole. Repeated rows give repeated results. Columns of the input
named text or n_chars give way to the results.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .boosting import Boosted
from .common import with_columns
from .dom import Node, parse

# fixed values: element names by kind, and words that page authors use in class, id and role
TAGS = (("article", "main"), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), ("div", "section", "center"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("table", "tbody", "thead", "tr", "td", "th"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button", "select", "option", "dialog"), ("blockquote", "pre", "figure", "figcaption"), ("body", "html", "#root"))
WORDS = {
    "main": ("article", "content", "post", "entry", "story", "body", "text", "main", "page", "blog", "hentry", "prose", "copy"),
    "menu": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "tabs", "pager", "pagination", "toolbar", "topbar", "links", "skip"),
    "ad": ("ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "dfp", "adslot", "commercial"),
    "foot": ("footer", "foot", "copyright", "legal", "colophon", "contentinfo", "credits", "bottom", "imprint"),
    "head": ("header", "masthead", "head", "logo", "site", "brand", "top", "hero", "tagline"),
    "side": ("sidebar", "side", "aside", "widget", "related", "recommended", "recommendations", "complementary", "rail", "trending", "popular", "more", "teaser", "teasers", "readmore"),
    "comment": ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "thread", "feedback", "reader", "readers", "reviews"),
    "notice": ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "modal", "popup", "overlay", "dialog", "warning", "paywall", "toast", "message", "banner", "privacy"),
    "share": ("share", "social", "sharing", "follow", "twitter", "facebook", "tags", "meta", "byline"),
    "form": ("form", "search", "newsletter", "subscribe", "subscription", "login", "signup", "register", "contact", "input"),
    "gone": ("hidden", "print", "screenreader", "sr"),
}
_TAG = {t: i for i, ts in enumerate(TAGS) for t in ts}
_GROUPS = list(WORDS)
_WORD = {w: [i for i, g in enumerate(_GROUPS) if w in WORDS[g]] for ws in WORDS.values() for w in ws}
_AROUND = ("nav", "header", "footer", "aside", "form", "article", "main", "blockquote", "li", "table")


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    chars, linked, words, marks, blocks = ([0] * n for _ in range(5))
    start = [0] * n
    groups: list[list[int]] = []
    above: list[tuple[tuple[int, ...], frozenset[str]]] = []
    none, seen = (0,) * len(_GROUPS), 0
    for i, node in enumerate(nodes):  # parents come before their children
        g = none
        if node.tokens:
            counts = [0] * len(_GROUPS)
            for t in node.tokens:
                for k in _WORD.get(t, ()):
                    counts[k] += 1
            g = tuple(counts)
        groups.append(g)
        if i:
            up, tags = above[node.parent]
            own = groups[node.parent]
            parent_tag = nodes[node.parent].tag
            above.append((tuple(min(9, a + b) for a, b in zip(up, own)) if own is not none else up, tags | {parent_tag} if parent_tag in _AROUND and parent_tag not in tags else tags))
        else:
            above.append((none, frozenset()))
        start[i] = seen
        seen += node.own
        chars[i], linked[i], words[i], marks[i], blocks[i] = node.own, node.linked, node.words, node.marks, int(node.own > 0)
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        linked[p] += linked[i]
        words[p] += words[i]
        marks[p] += marks[i]
        blocks[p] += blocks[i]
    total = max(1, chars[0])
    place, before, after, alike = [0] * n, [0] * n, [0] * n, [0.0] * n
    for node in nodes:
        kids = node.children
        tags: dict[str, int] = {}
        for k in kids:
            tags[nodes[k].tag] = tags.get(nodes[k].tag, 0) + 1
        for j, k in enumerate(kids):
            place[k], alike[k] = j, tags[nodes[k].tag] / len(kids)
            before[k] = chars[kids[j - 1]] if j else 0
            after[k] = chars[kids[j + 1]] if j + 1 < len(kids) else 0
    x = np.zeros((n, len(TAGS) + 2 * len(_GROUPS) + len(_AROUND) + 24), np.float32)
    for i, node in enumerate(nodes):
        p = max(0, node.parent)
        kind = [0] * len(TAGS)
        if (t := _TAG.get(node.tag)) is not None:
            kind[t] = 1
        up, tags = above[i]
        c, w, b = chars[i], words[i], blocks[i]
        x[i] = (
            *kind, *groups[i], *up, *[a in tags for a in _AROUND],
            node.depth, len(node.children), place[i], len(nodes[p].children), alike[i],
            c, w, b, node.own, c / total, c / max(1, chars[p]), linked[i] / max(1, c), linked[p] / max(1, chars[p]), marks[i] / max(1, w), c / max(1, b), w / max(1, b),
            before[i], after[i], start[i] / total, (start[i] + c) / total, node.own / max(1, c), len(nodes[p].children) - place[i], _TAG.get(nodes[p].tag, -1), sum(groups[p]),
        )
    return x


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """Which nodes stay."""
    value = margin.astype(float).tolist()
    for i in range(len(nodes) - 1, 0, -1):
        if value[i] > 0:
            value[nodes[i].parent] += value[i]
    keep = [True] * len(nodes)
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and (value[i] > 0 or nodes[i].tag in ("html", "body"))
    return keep


#: A block of at least so many words, of which links hold at most such a share of the characters, is prose.
PROSE_WORDS, PROSE_LINKS = 12, 0.3
_NOT_MAIN = frozenset(("nav", "footer", "aside", "form", "button", "select", "option", "dialog", "header"))
_HEADINGS = frozenset(TAGS[2])


def densest(nodes: list[Node]) -> list[bool]:
    """Which nodes stay where the trees find nothing, as on pages whose elements have no names to go by: the prose of the element around which most of it stands, and the headings beside it. Nothing that a menu, footer, form or the like encloses, or whose attributes name something else than main text."""
    n = len(nodes)
    out = [False] * n
    barred, inside = [False] * n, [0] * n
    for i, node in enumerate(nodes):
        other = any(_GROUPS[k] not in ("main", "head") for t in node.tokens for k in _WORD.get(t, ()))
        barred[i] = (i > 0 and barred[node.parent]) or node.tag in _NOT_MAIN or other
    prose = [i for i in range(1, n) if not barred[i] and nodes[i].words >= PROSE_WORDS and nodes[i].linked <= PROSE_LINKS * nodes[i].own]
    if not prose:
        return out
    for i in prose:
        inside[nodes[i].parent] += nodes[i].words
    top = max(range(n), key=lambda i: (inside[i], -i))
    within = [False] * n
    within[top] = True
    for i in range(top + 1, n):
        within[i] = within[nodes[i].parent]
    for i in prose:
        out[i] = within[i]
    for i in range(top + 1, n):
        if within[i] and nodes[i].tag in _HEADINGS and not barred[i]:
            out[i] = True
    return out


# --- made-up pages -------------------------------------------------------------------------------------------------


def _page(r: random.Random) -> tuple[str, str]:
    """A page, with every piece of main text between \x01 and \x02."""
    syllables = ["".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiouéüóà") for _ in range(r.randint(1, 2))) for _ in range(60)]

    def sentence(lo: int = 1, hi: int = 24) -> str:
        ws = ["".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(r.randint(lo, hi))]
        return " ".join(ws).capitalize() + r.choice([".", ".", ".", "!", "?", ","])

    def prose(lo: int, hi: int) -> str:
        return " ".join(sentence() for _ in range(r.randint(lo, hi)))

    def main(text: str) -> str:
        if r.random() < 0.2:  # main text isn't always prose
            ws = text.split()
            text = r.choice([
                lambda: " | ".join(ws), lambda: " ".join(ws[:2] * r.randint(2, 40)), lambda: text.upper(), lambda: " ".join(w + r.choice(["***", "&amp;&amp;", "$$", "%%%", "###"]) for w in ws), lambda: " ".join(str(r.randint(0, 10**6)) for _ in ws),
                lambda: " ".join(w.strip(".,!?") for w in ws), lambda: text[: r.randint(1, 60)], lambda: " ".join(f"<a href='/{w}'>{w}</a>" if r.random() < 0.15 else w for w in ws), lambda: text.replace(" ", "<br>", 3),
            ])()
        return "\x01" + text + "\x02"

    def attrs(*groups: str, chance: float = 0.8) -> str:
        if r.random() > chance:
            return ""
        word = r.choice(WORDS[r.choice(groups)])
        noise = r.choice(["", "", "-1", " col", " wrap", "-box", "-inner", " clearfix", "-block"])
        return f' {r.choice(["class", "class", "class", "id"])}="{word}{noise}"'

    def links(n: int) -> str:
        items = [f'<a href="/{r.choice(syllables)}">{sentence(1, 4)[:-1]}</a>' for _ in range(n)]
        return r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)])()

    def bare() -> str:
        return r.choice([lambda: prose(1, 3), lambda: f"<p>{prose(1, 3)}</p>", lambda: f"<h3>{sentence(1, 4)}</h3>{links(r.randint(2, 6))}", lambda: f"<p>{prose(1, 2)} <a href='#'>{sentence(1, 3)}</a></p>"])()

    def menu() -> str:
        return r.choice([f"<nav{attrs('menu', chance=0.5)}>{links(r.randint(2, 12))}</nav>", f"<div{attrs('menu', chance=0.95)}>{links(r.randint(3, 12))}</div>", f"<ul{attrs('menu', chance=0.95)}>" + "".join(f"<li><a href=/>{sentence(1, 2)}</a></li>" for _ in range(r.randint(3, 9))) + "</ul>"])

    def head() -> str:
        tag = r.choice(["header", "div"])
        return f"<{tag}{attrs('head', chance=0.5 if tag == 'header' else 1)}>{r.choice([f'<h1>{sentence(1, 4)}</h1>', sentence(1, 5), f'<p>{sentence(2, 9)}</p>'])}{r.choice(['', menu()])}</{tag}>"

    def foot() -> str:
        tag = r.choice(["footer", "footer", "div"])
        return f"<{tag}{attrs('foot', chance=0.4 if tag == 'footer' else 1)}>{r.choice(['&copy; ', '', ''])}{r.choice([sentence(2, 9), bare(), links(3)])}</{tag}>"

    def ad() -> str:
        tag = r.choice(["div", "div", "aside", "section"])
        return f"<{tag}{attrs('ad', chance=1)}>{bare()}</{tag}>"

    def side() -> str:
        tag = r.choice(["aside", "aside", "div"])
        return f"<{tag}{attrs('side', chance=0.5 if tag == 'aside' else 1)}>{''.join(bare() for _ in range(r.randint(1, 4)))}</{tag}>"

    def notice() -> str:
        tag = r.choice(["div", "div", "section", "dialog"])
        return f"<{tag}{attrs('notice', chance=1)}>{bare()}{r.choice(['', '<button>' + sentence(1, 2) + '</button>'])}</{tag}>"

    def form() -> str:
        inner = f"<label>{sentence(1, 4)}</label><input name=q>{r.choice(['', '<p>' + prose(1, 2) + '</p>'])}<button>{sentence(1, 2)}</button>"
        return r.choice([f"<form{attrs('form', chance=0.5)}>{inner}</form>", f"<div{attrs('form', chance=1)}><form>{inner}</form></div>"])

    def share() -> str:
        return f"<div{attrs('share', chance=1)}>{links(r.randint(2, 5))}</div>"

    def comments() -> str:
        tag, each = r.choice(["section", "div", "ol"]), r.choice(["div", "article", "li"])
        inner = "".join(f"<{each}{attrs('comment', chance=0.8)}>{r.choice(['', f'<h4>{sentence(1, 2)}</h4>', f'<b>{sentence(1, 2)}</b>'])}{r.choice([prose(1, 4), '<p>' + prose(1, 4) + '</p>'])}</{each}>" for _ in range(r.randint(1, 7)))
        return f"<{tag}{attrs('comment', chance=1)}>{r.choice(['', '<h3>' + sentence(1, 2) + '</h3>'])}{inner}</{tag}>"

    def article() -> str:
        out, ends = [], r.random() < 0.8
        title = main(sentence(1, 12))
        if r.random() < 0.85:
            out.append(r.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<h2{attrs('main', chance=0.3)}>{title}</h2>", f"<header><h1>{title}</h1></header>"]))
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13, 20])):
            kind = r.random()
            if kind < 0.72:
                text = main(prose(1, r.choice([1, 2, 4, 8])) if r.random() < 0.9 else sentence(1, 3))
                out.append(f"<p>{r.choice(['', '', '', '<b>'])}{text}" + r.choice(["</p>", "</p>", "" if not ends else "</p>", "<br>"]))
            elif kind < 0.79:
                out.append(f"<h{r.randint(2, 4)}>{main(sentence(1, 7))}</h2>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{main(prose(1, 2))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.89:
                out.append(f"<blockquote><p>{main(prose(1, 3))}</p></blockquote>")
            elif kind < 0.92:
                out.append(f"<div>{main(prose(1, 5))}</div>")
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{main(sentence(1, 4))}</td><td>{main(sentence(1, 4))}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            else:
                out.append(r.choice([ad, ad, side, share, notice, form])())
        if r.random() < 0.2:
            out.append(r.choice([share, comments, side, foot])())
        if r.random() < 0.12:  # plain text between breaks
            out = ["<br><br>".join(main(prose(1, 4)) for _ in range(r.randint(1, 6)))]
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        inner = "".join(out)
        if r.random() < 0.25:
            inner = f"<div{attrs('main', chance=0.6)}>{inner}</div>"
        return f"<{tag}{attrs('main', chance=0.4 if tag in ('article', 'main') else 1)}>{inner}</{tag}>"

    before = [f() for f in (head, menu, ad, notice, form, side, share) if r.random() < 0.4]
    after = [f() for f in (side, comments, ad, share, notice, form, menu, foot) if r.random() < 0.45]
    r.shuffle(before)
    r.shuffle(after)
    body = "".join(before) + article() + "".join(after)
    if r.random() < 0.3:
        body = f"<div{attrs('head', 'main', chance=0.3).replace('header', 'wrapper')}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{sentence()}</title></head><body>{body}" + r.choice(["</body></html>", "</body></html>", ""])


@cache
def trained(pages: int = 900, seed: int = 7) -> Boosted:
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page = _page(r)
        nodes, texts = parse(page)
        y, inside = np.zeros(len(nodes)), False
        for i, text in texts:
            if inside or "\x01" in text:
                k = i
                while k >= 0 and not y[k]:
                    y[k], k = 1, nodes[k].parent
            inside = text.rfind("\x01") > text.rfind("\x02") or inside and "\x02" not in text
        xs.append(features(parse(page.translate({1: None, 2: None}))[0]))
        ys.append(y)
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """Main text of each page; the trees look at all nodes of all pages at once."""
    parsed = [parse(p or "") for p in pages]
    at = np.cumsum([0, *(len(nodes) for nodes, _ in parsed)])
    if not pages:
        return []
    margin = model.margin(np.concatenate([features(nodes) for nodes, _ in parsed]))
    out = []
    for k, (nodes, texts) in enumerate(parsed):
        keep = decode(nodes, margin[at[k] : at[k + 1]])
        if texts and not any(keep[i] for i, _ in texts):
            keep = densest(nodes)
        out.append(" ".join(t for i, t in texts if keep[i]))
    return out


def extract_text(pages: DataFrame, html_col: str = "html", batch: int = 64) -> DataFrame:
    """pages with text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf(StringType())
    def run(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in html:
            rows = [x if isinstance(x, str) else None for x in series]
            yield pd.Series([t for i in range(0, len(rows), batch) for t in extract(rows[i : i + batch], shared.value)], dtype="object")

    found = pages.withColumn("__text", run(F.col(html_col)))
    return found.select(*with_columns(pages, {"text": F.col("__text"), "n_chars": F.char_length("__text").cast("long")}))


def op6(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
