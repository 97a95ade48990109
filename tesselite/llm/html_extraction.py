"""Main text of web pages from a tree-structured graphical model over the DOM.

Every block element has a binary label, content or not. Node potentials come from its tag, the words of its class,
id and role, and the amount, links and punctuation of its own text; potentials of a parent and child depend on the
child's kind of tag. Sum-product messages run up and down the tree and give each node's content marginal; text of
nodes with a marginal above a half is the main text. The potentials are fitted by gradient on the likelihood of
labelled pages, which are drawn here by rule (pages of many layouts whose parts are known to be content or not).

Defined results: a null or empty page, or one without content, gives an empty text; broken, unclosed and cut-off
markup is read leniently; repeated rows are extracted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .dom import Node, attributes, parse

#: Words in class, id, role and itemprop that features know, each by its beginning.
HINTS = (
    "ad", "ads", "advert", "aside", "author", "banner", "bio", "body", "bottom", "breadcrumb", "button", "byline", "caption", "comment", "consent", "content", "contentinfo", "cookie", "copyright", "date", "disqus",
    "entry", "foot", "form", "gdpr", "head", "hidden", "legal", "links", "login", "main", "masthead", "menu", "meta", "modal", "nav", "newsletter", "notice", "overlay", "page", "pagination", "popup", "post", "promo",
    "read", "recommend", "related", "reply", "search", "share", "side", "sidebar", "signup", "skip", "social", "sponsor", "story", "subscribe", "tags", "text", "toolbar", "top", "widget", "article",
)
KINDS = {"p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "ul": 3, "ol": 3, "dl": 3, "dt": 3, "dd": 3, "menu": 3, "div": 4, "section": 4, "article": 5, "main": 5, "nav": 6, "aside": 6, "header": 6, "footer": 6, "form": 6, "td": 7, "th": 7, "tr": 7, "table": 7, "tbody": 7, "thead": 7}
TAGS = ("html", "article", "main", "section", "nav", "aside", "header", "footer", "div", "p", "ul", "ol", "li", "h1", "h2", "h3", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "form", "label", "button", "select", "option", "textarea", "fieldset", "details", "dialog", "dl", "dt", "dd", "address")
_SIZES = (1, 25, 80, 200)
FEATURES = ["bias", *(f"tag {t}" for t in TAGS), "tag other", *(f"hint {h}" for h in HINTS), "hidden", *(f"size {s}" for s in _SIZES), "linked", "mostly linked", "stop", "commas", "holds h1"]
_NUMBER = {f: k for k, f in enumerate(FEATURES)}
_TAG_NUMBER = {t: _NUMBER[f"tag {t}"] for t in TAGS}


@lru_cache(maxsize=4096)
def _marked(raw: str) -> tuple[int, ...]:
    if "=" not in raw and "hidden" not in raw:
        return ()
    found = attributes(raw)
    out = set()
    words = {w.lower() for k in ("class", "id", "role", "itemprop") for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", found.get(k, "")) if w}
    for w in words:
        for h in (h for h in HINTS if w == h or len(h) > 3 and w.startswith(h)):
            out.add(_NUMBER[f"hint {h}"])
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        out.add(_NUMBER["hidden"])
    return tuple(sorted(out))


def features(node: Node, last: str, commas: int, title: bool) -> list[int]:
    out = [0, _TAG_NUMBER.get(node.name, _NUMBER["tag other"]), *_marked(node.attributes)]
    out += [_NUMBER["holds h1"]] * title
    out += [_NUMBER[f"size {s}"] for s in _SIZES if node.text >= s]
    if node.text:
        share = node.linked / node.text
        out += [_NUMBER["linked"]] * (share > 0.2) + [_NUMBER["mostly linked"]] * (share > 0.6) + [_NUMBER["stop"]] * (last in ".!?…:;") + [_NUMBER["commas"]] * (commas > 1)
    return out


@dataclass
class Forest:
    """Trees of many pages: each node's parent (-1 for roots), depth and kind, and (node, feature) pairs."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    of: np.ndarray
    feature: np.ndarray


def forest(pages: list[tuple[list[Node], list[tuple[int, str]]]]) -> Forest:
    parent, depth, kind, of, feature = [], [], [], [], []
    for nodes, runs in pages:
        base = len(parent)
        last, commas = {}, {}
        for k, text in runs:
            last[k], commas[k] = text[-1], commas.get(k, 0) + text.count(",")
        titled = set()
        for node in nodes:
            if node.name == "h1":
                k = node.parent
                while k > 0 and k not in titled:
                    titled.add(k)
                    k = nodes[k].parent
        for k, node in enumerate(nodes):
            parent.append(base + node.parent if node.parent >= 0 else -1)
            depth.append(depth[base + node.parent] + 1 if node.parent >= 0 else 0)
            kind.append(KINDS.get(node.name, 0))
            f = features(node, last.get(k, " "), commas.get(k, 0), k in titled)
            of += [base + k] * len(f)
            feature += f
    return Forest(*(np.array(x, np.int64) for x in (parent, depth, kind, of, feature)))


@dataclass
class Model:
    node: np.ndarray  # a weight per feature: the logit of content
    edge: np.ndarray  # kind of child x label of parent x label of child

    def marginals(self, trees: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(content) per node, and P(parent's label, own label) per node that has a parent, by sum-product."""
        n = len(trees.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(trees.of, weights=self.node[trees.feature], minlength=n)
        up, message = own.copy(), np.zeros((n, 2))
        order = np.argsort(trees.depth, kind="stable")
        levels = np.split(order, np.searchsorted(trees.depth[order], np.arange(1, int(trees.depth.max()) + 1))) if n else []
        edge = self.edge[trees.kind]
        for at in reversed(levels[1:]):
            message[at] = np.logaddexp.reduce(up[at][:, None, :] + edge[at], axis=2)
            np.add.at(up, trees.parent[at], message[at])
        full = up.copy()  # own and children's evidence, and from above what the way down adds
        for at in levels[1:]:
            p = trees.parent[at]
            rest = full[p] - message[at]
            full[at] += np.logaddexp.reduce(rest[:, :, None] + edge[at], axis=1)
        content = 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500)))
        child = np.flatnonzero(trees.parent >= 0)
        joint = (full[trees.parent[child]] - message[child])[:, :, None] + edge[child] + up[child][:, None, :]
        joint = np.exp(joint - np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None])
        return content, joint

    def text(self, pages: list[str]) -> list[str]:
        parsed = [parse(p) for p in pages]
        content, _ = self.marginals(forest(parsed))
        out, base = [], 0
        for nodes, runs in parsed:
            out.append(" ".join(t for k, t in runs if content[base + k] > 0.5))
            base += len(nodes)
        return out


def fit(pages: list[tuple[str, list[str]]], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """pages: html with the texts of its content blocks. A node's label is that of most of its subtree's text."""
    parsed = [parse(h) for h, _ in pages]
    trees = forest(parsed)
    good, all_ = np.zeros(len(trees.parent)), np.zeros(len(trees.parent))
    base = 0
    for (nodes, runs), (_, wanted) in zip(parsed, pages, strict=True):
        known = set(wanted)
        for k, t in runs:
            good[base + k] += len(t) * (t in known)
            all_[base + k] += len(t)
        base += len(nodes)
    for d in range(int(trees.depth.max()), 0, -1):
        at = np.flatnonzero(trees.depth == d)
        own = np.where(all_[at] > 0, good[at] / np.maximum(all_[at], 1) > 0.5, False)
        # A child's text weighs in its parent's label as one kind or the other.
        np.add.at(good, trees.parent[at], all_[at] * own)
        np.add.at(all_, trees.parent[at], all_[at])
    label = (good > 0.5 * all_) & (all_ > 0)
    child = np.flatnonzero(trees.parent >= 0)
    seen = np.zeros((len(child), 2, 2))
    seen[np.arange(len(child)), label[trees.parent[child]].astype(int), label[child].astype(int)] = 1
    kinds = max(KINDS.values()) + 1
    model = Model(np.zeros(len(FEATURES)), np.zeros((kinds, 2, 2)))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (model.node, model.edge)]
    n = len(label)
    for k in range(1, rounds + 1):
        content, joint = model.marginals(trees)
        node = np.bincount(trees.feature, weights=(content - label)[trees.of], minlength=len(FEATURES)) / n + ridge * model.node
        edge = np.zeros_like(model.edge)
        np.add.at(edge, trees.kind[child], (joint - seen) / n)
        for x, g, (m, v) in zip((model.node, model.edge), (node, edge + ridge * model.edge), state, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return model


def labelled_pages(n: int = 800, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Pages of many layouts, each with the texts of its content blocks."""
    r = random.Random(seed)
    syllables = "ba co de fi gu la me no pi ru sa te vi za lo ner tis mon kal ver dru sto quin pra".split()

    def words(k: int) -> str:
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(k))

    def sentence() -> str:
        w = words(r.randint(4, 14)).split()
        if r.random() < 0.4:
            w[len(w) // 2] += ","
        return " ".join(w).capitalize() + r.choice("..........!?")

    def page() -> tuple[str, list[str]]:
        content: list[str] = []
        plain = r.random() < 0.25  # no class or id at all
        sloppy = r.random() < 0.3  # end tags left out
        short = r.random() < 0.2  # paragraphs of few words

        def mark(*names: str) -> str:
            if plain:
                return ""
            name = r.choice(names)
            return r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {words(1)}"', f" class={name}"])

        def say(text: str, wanted: bool) -> str:
            text = " ".join(text.split())
            if wanted:
                content.append(text)
            return text

        def links(k: int) -> str:
            return "".join(f'<li><a href="/{words(1)}">{say(words(r.randint(1, 3)), False)}</a></li>' for _ in range(k))

        def menu() -> str:
            if r.random() < 0.5:
                return f"<nav{mark('nav', 'menu', 'top')}><ul>{links(r.randint(3, 9))}</ul></nav>"
            inner = r.choice([" | ", " ", "\n"]).join(f'<a href="/{words(1)}">{words(r.randint(1, 2))}</a>' for _ in range(r.randint(3, 8)))
            return f"<div{mark('menu', 'navbar', 'nav', 'breadcrumbs', 'toolbar')}>{inner}</div>" if r.random() < 0.7 else f"<ul{mark('menu', 'nav')}>{links(r.randint(3, 9))}</ul>"

        def note(*names: str, tag: str = "div") -> str:
            inner = " ".join(sentence() for _ in range(r.randint(1, 3)))
            inner = f"<p>{inner}</p>" if r.random() < 0.4 else inner
            if not plain:
                return f'<{tag} {r.choice(["class", "id"])}="{r.choice(names)}">{inner}</{tag}>'
            return f"<aside>{inner}</aside>"

        def comments() -> str:
            posts = "".join(f'<{t} class="{r.choice(["comment", "comment-body", "reply"])}"><p>{" ".join(sentence() for _ in range(r.randint(1, 5)))}</p></{t}>' for t in [r.choice(["div", "li", "article"]) for _ in range(r.randint(1, 5))])
            return f'<{(t := r.choice(["div", "section"]))} {r.choice(["id", "class"])}="{r.choice(["comments", "comment-list", "disqus", "replies"])}"><h3>{words(2)}</h3>{posts}</{t}>'

        def form() -> str:
            return f"<form{mark('search', 'login', 'newsletter', 'subscribe')}><label>{words(2)}</label><input name=q><button>{words(1)}</button>{'<p>' + sentence() + '</p>' if r.random() < 0.3 else ''}</form>"

        def paragraph() -> str:
            text = " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 8])))
            if short and r.random() < 0.8:
                text = words(r.randint(1, 3)).capitalize() + r.choice(["", ".", "."])
            say(text, True)
            w = text.split(" ")
            if r.random() < 0.25:
                k = r.randrange(len(w))
                w[k] = f'<{(t := r.choice(["b", "em", "i", "strong"]))}>{w[k]}</{t}>'
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w[k] = f'<a href="/x">{w[k]}</a>'
            if r.random() < 0.1:
                w.insert(r.randrange(len(w)), "<br>")
            return "<p>" + " ".join(w) + ("" if sloppy and r.random() < 0.5 else "</p>")

        def article() -> str:
            title = say(words(r.randint(2, 9)).capitalize(), True)
            out = [f"<h1>{title}</h1>" if r.random() < 0.85 else f"<header><h1>{title}</h1></header>"]
            for _ in range(r.randint(1, 14 if short else 9)):
                kind = r.random()
                if kind < 0.72:
                    out.append(paragraph())
                elif kind < 0.8:
                    out.append(f"<h2>{say(words(r.randint(1, 6)).capitalize(), True)}</h2>")
                elif kind < 0.86:
                    items = "".join(f"<li>{say(sentence(), True)}" + ("" if sloppy else "</li>") for _ in range(r.randint(2, 5)))
                    out.append(f"<ul>{items}</ul>")
                elif kind < 0.89:
                    out.append(f"<blockquote>{say(sentence(), True)}</blockquote>" if r.random() < 0.5 else f"<pre>{say(sentence(), True)}</pre>")
                elif kind < 0.92:
                    cells = "".join("<tr>" + "".join(f"<td>{say(words(r.randint(1, 4)), True)}</td>" for _ in range(3)) + "</tr>" for _ in range(2))
                    out.append(f"<table>{cells}</table>")
                else:
                    out.append(note("ad", "advert", "ads", "promo", "sponsored", "related", "share", "social", "newsletter-signup", tag=r.choice(["div", "aside"])))
            body = "".join(out)
            if r.random() < 0.25:
                body += comments()
            if r.random() < 0.15:
                body += f"<footer>{' '.join(sentence() for _ in range(r.randint(1, 2)))}</footer>"
            if r.random() < 0.25:
                body = f"<div{mark('content', 'entry-content', 'article-body', 'story', 'text')}>{body}</div>"
            if r.random() < 0.6:
                return f"<article>{body}</article>"
            if r.random() < 0.4:
                return f"<main>{body}</main>"
            return f"<div{mark('content', 'main', 'post', 'article', 'entry', 'post-content', 'story-body', 'page-content', 'main-content')}>{body}</div>"

        out = []
        if r.random() < 0.35:
            out.append(f"<header{mark('header', 'masthead', 'site-header')}><h2>{words(2)}</h2>{menu() if r.random() < 0.5 else '<p>' + sentence() + '</p>'}</header>" if r.random() < 0.6 else note("header", "masthead", "site-header", "top"))
        out.append(menu())
        if r.random() < 0.4:
            out.append(note("ad", "ad-banner", "advert", "ads", "banner", "sponsor", "promo"))
        if r.random() < 0.3:
            out.append(note("cookie", "cookie-notice", "gdpr", "consent", "notice", "popup", "modal", "overlay"))
        if r.random() < 0.3:
            out.append(form())
        side = note("sidebar", "side", "widget", "related", "recommended", "links") if r.random() < 0.5 else f"<aside{mark('sidebar', 'related')}><h3>{words(2)}</h3><ul>{links(4)}</ul>{'<p>' + sentence() + '</p>' if r.random() < 0.5 else ''}</aside>"
        if r.random() < 0.25:
            out.append(side)
        out.append(article())
        if r.random() < 0.25:
            out.append(side)
        if r.random() < 0.25:
            out.append(comments())
        if r.random() < 0.2:
            out.append(note("ad", "related", "share", "newsletter", "subscribe", "author-bio"))
        if r.random() < 0.85:
            inner = r.choice([f"&copy; {words(1)}.example &middot; {sentence()}", " ".join(sentence() for _ in range(r.randint(1, 4))), f"<p>{sentence()}</p><ul>{links(3)}</ul>"])
            out.append(f"<footer{mark('footer', 'site-footer')}>{inner}</footer>" if plain or r.random() < 0.6 else f'<div class="{r.choice(["footer", "site-footer", "bottom", "copyright", "legal"])}">{inner}</div>')
        body = "".join(out)
        if r.random() < 0.2:
            body = f"<div{mark('wrapper', 'container', 'page')}>{body}</div>"
        html = f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"
        return (html[: -r.randint(1, 60)] if r.random() < 0.05 else html), content

    return [page() for _ in range(n)]


@lru_cache(maxsize=1)
def fitted() -> Model:
    return fit(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), at_once: int = 200) -> DataFrame:
    """The kept columns, text and n_chars (code points) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fitted())

    def fn(batches):
        for g in batches:
            raw = g.column(0).to_pylist()
            texts = [t for k in range(0, len(raw), at_once) for t in shared.value.text(raw[k : k + at_once])]
            yield pa.RecordBatch.from_arrays([*g.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    rows = pages.select(F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(fn, f"{schema}, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
