"""Main text of web pages by a tree-structured graphical model.

A page is read into a tree of its block elements, with a leaf for every run of text between block
boundaries.  Each node is a binary variable, content or not.  Node potentials are linear in features of the
tag, of words in class, id and role, and of text and link lengths; parent-child potentials depend on the
kind of the child.  Sum-product messages, once up and once down the tree, give every leaf its exact marginal;
leaves of at least one half are the main text.  All pages of a batch are passed level by level at once.

Potentials are trained by maximum likelihood on labelled pages, which :func:`labelled_page` writes in many
layouts (with and without telling tags and names) with the label of each element.  Training takes seconds, is
deterministic, and happens once per application on the driver; the weights are a few hundred numbers.

Character references are decoded; white space inside a block becomes one space; blocks are trimmed and joined in page order by one line
break; nothing else is dropped or cut off.  Scripts, styles, forms' fields and comments never enter the tree.

Defined results: a null or empty page, or one without content, has the empty text; unclosed and stray tags are
repaired as browsers do in common cases; rows repeated are extracted each; null ids and urls stay null; an empty table
gives an empty result; additional columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML by how they are written and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea select button svg iframe object canvas audio video head math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr nobr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SAME_CLOSES = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}

#: Kinds of elements, for features and parent-child potentials.
KINDS = {
    "text": "#text", "page": "html body", "menu": "nav menu", "foot": "footer", "head": "header hgroup", "side": "aside", "form": "form fieldset",
    "article": "article", "main": "main", "section": "section", "div": "div center", "p": "p", "title": "h1 h2", "subtitle": "h3 h4 h5 h6",
    "list": "ul ol dl dir", "item": "li dt dd", "quote": "blockquote pre", "figure": "figure figcaption", "table": "table tbody thead tfoot tr td th",
}
_KIND = {tag: k for k, tags in enumerate(KINDS.values()) for tag in tags.split()}
_OTHER_KIND = len(KINDS)
N_KINDS = len(KINDS) + 1
#: Words in class, id and role that hint at what an element is for.
HINTS = {
    "advert": "ad ads advert advertisement adsense adslot banner promo promotion promoted sponsor sponsored sponsors",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager topbar tabs toc skip",
    "foot": "footer foot copyright colophon legal imprint disclaimer bottom",
    "head": "header masthead logo brand branding top site",
    "side": "sidebar side aside widget widgets rail related recommended recommendations popular trending more tags tagcloud archive",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread reader readers feedback",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall privacy banner",
    "share": "share sharing social facebook twitter follow toolbar tools meta byline author",
    "form": "form search login contact input",
    "content": "content article post entry story text body main maincontent page prose markdown",
}
_HINT: dict[str, list[int]] = {}
for _k, _words in enumerate(HINTS.values()):
    for _w in _words.split():
        _HINT.setdefault(_w, []).append(_k)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S
)
_SPACE = re.compile(r"\s+")
_LABEL = re.compile(r"data-y=\"(\d)\"")


class Tree:
    """Nodes of one page in page order; parents come before children."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.attrs: list[str] = [""]
        self.depth: list[int] = [0]
        self.text: list[str] = [""]
        self.linked: list[int] = [0]

    def add(self, parent: int, tag: str, attrs: str, text: str = "", linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.depth.append(self.depth[parent] + 1)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def parse(page: str) -> Tree:
    """The tree of a page's block elements and text runs."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their block node
    parts: list[str] = []
    linked = links = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                tree.add(stack[-1][1], "#text", "", text, min(linked, len(text)))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal links
        if any(t not in INLINE for t, _ in stack[upto:]):
            flush()
        links -= sum(t == "a" for t, _ in stack[upto:])
        del stack[upto:]

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                parts.append(token)
                if links:
                    linked += len(token)
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            else:
                if name == "p":
                    flush()
            continue
        if name in RAW:
            done = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name == "head" and not done:
                continue
            at = done.end() if done else end
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if name in SAME_CLOSES:
            fence = SAME_CLOSES[name].split()
            same = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in same:
                    close(k)
                    break
                if stack[k][0] in fence:
                    break
        if name in INLINE:
            links += name == "a"
            stack.append((name, stack[-1][1]))
            continue
        flush()
        if name in ("html", "body") and any(t == name for t, _ in stack):
            continue
        stack.append((name, tree.add(stack[-1][1], name, m[3])))
    close(1)
    flush()
    return tree


@lru_cache(maxsize=4096)
def _hints(attrs: str) -> tuple[int, ...]:
    found: set[int] = set()
    for _, value in _NAMES.findall(attrs):
        for word in _WORDS.findall(value):
            found.update(_HINT.get(word.lower(), ()))
    return tuple(sorted(found))


_LENGTHS = np.array([0, 1, 20, 60, 150, 400, 1500])
_SHARES = np.array([0.0, 0.05, 0.3, 0.7, 0.95])
_MARKS = re.compile(r"[.,;:!?]")
N_HINTS = len(HINTS)
_AT = np.cumsum([0, 1, N_KINDS, N_KINDS, N_HINTS, N_HINTS, len(_LENGTHS), len(_SHARES), len(_LENGTHS), len(_SHARES), 4])
N_FEATURES = int(_AT[-1])


def features(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, parents, kinds and depths of the nodes of many pages, one after another."""
    n = sum(len(t.parent) for t in trees)
    x = np.zeros((n, N_FEATURES), np.float32)
    x[:, 0] = 1
    base, parents = 0, np.empty(n, np.int64)
    kinds = np.empty(n, np.int64)
    depths = np.empty(n, np.int64)
    for tree in trees:
        size = len(tree.parent)
        parent = np.array(tree.parent)
        length = np.array([len(t) for t in tree.text], float)
        linked = np.array(tree.linked, float)
        for k in range(size - 1, 0, -1):  # sums over subtrees
            length[tree.parent[k]] += length[k]
            linked[tree.parent[k]] += linked[k]
        here = slice(base, base + size)
        kind = np.array([_KIND.get(t, _OTHER_KIND) for t in tree.tag])
        rows = np.arange(base, base + size)
        above = np.where(parent < 0, 0, parent)
        share = linked / np.maximum(length, 1)
        bucket = np.searchsorted(_LENGTHS, length, "right") - 1
        dense = np.searchsorted(_SHARES, share, "right") - 1
        x[rows, _AT[1] + kind] = 1
        x[rows, _AT[2] + kind[above]] = 1
        for k, attrs in enumerate(tree.attrs):
            if attrs:
                for hint in _hints(attrs):
                    x[base + k, _AT[3] + hint] = 1
        inherited = x[here, _AT[3] : _AT[4]].copy()
        for k in range(1, size):  # hints of any element above
            p = tree.parent[k]
            if inherited[p].any():
                x[base + k, _AT[4] : _AT[5]] = inherited[p]
                np.maximum(inherited[k], inherited[p], out=inherited[k])
        x[rows, _AT[5] + bucket] = 1
        x[rows, _AT[6] + dense] = 1
        x[rows, _AT[7] + bucket[above]] = 1
        x[rows, _AT[8] + dense[above]] = 1
        for k, text in enumerate(tree.text):
            if text:
                x[base + k, _AT[9]] = "©" in text or "(c)" in text
                x[base + k, _AT[9] + 1] = min(1.0, len(_MARKS.findall(text)) / 4)
                x[base + k, _AT[9] + 2] = text[-1] in ".!?…"
        x[here, _AT[9] + 3] = np.minimum(np.array(tree.depth), 10) / 10
        parents[here] = np.where(parent < 0, -1, parent + base)
        kinds[here] = kind
        depths[here] = tree.depth
        base += size
    return x, parents, kinds, depths


class Model:
    """Node weights and, for each kind of child, a table of parent-child potentials."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray) -> None:
        self.weights, self.pairs = weights, pairs  # pairs[kind, parent's label, child's label]

    def infer(self, x: np.ndarray, parents: np.ndarray, kinds: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of each node, and of each node's label together with its parent's, by messages up and then down."""
        n = len(x)
        held = np.zeros((n, 2))  # own potential and the messages from below
        held[:, 1] = x @ self.weights
        levels = [np.flatnonzero(depths == d) for d in range(int(depths.max()) + 1)] if n else []
        table = self.pairs[kinds]
        up = np.zeros((n, 2))
        for level in reversed(levels[1:]):
            up[level] = np.logaddexp(table[level, :, 0] + held[level, 0:1], table[level, :, 1] + held[level, 1:2])
            np.add.at(held, parents[level], up[level])
        belief, joint = held.copy(), np.zeros((n, 2, 2))
        for level in levels[1:]:
            p = parents[level]
            rest = belief[p] - up[level]  # the parent's belief without this child
            down = np.logaddexp(table[level, 0, :] + rest[:, 0:1], table[level, 1, :] + rest[:, 1:2])
            belief[level] = held[level] + down
            joint[level] = table[level] + rest[:, :, None] + held[level][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        joint /= joint.sum((1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint

    def marginals(self, x: np.ndarray, parents: np.ndarray, kinds: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """Probability of content of each node."""
        return self.infer(x, parents, kinds, depths)[0]


def train(pages: list[str], rounds: int = 120, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """Potentials of the largest likelihood on pages whose elements carry data-y labels; the gradient is taken from exact marginals."""
    trees = [parse(p) for p in pages]
    x, parents, kinds, depths = features(trees)
    x = x.astype(float)
    y = np.array([label for t in trees for label in _labels(t)])
    n, child = len(y), np.flatnonzero(parents >= 0)
    seen = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen, (kinds[child], y[parents[child]], y[child]), 1)
    w, first, second = (np.zeros(N_FEATURES + 4 * N_KINDS) for _ in range(3))
    for k in range(1, rounds + 1):  # gradient ascent with moment estimates
        node, joint = Model(w[:N_FEATURES], w[N_FEATURES:].reshape(N_KINDS, 2, 2)).infer(x, parents, kinds, depths)
        expected = np.zeros_like(seen)
        np.add.at(expected, kinds[child], joint[child])
        gradient = np.concatenate([x.T @ (y - node), (seen - expected).ravel()]) / n - ridge * w
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        w += rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-6)
    return Model(w[:N_FEATURES], w[N_FEATURES:].reshape(N_KINDS, 2, 2))


def _labels(tree: Tree) -> list[int]:
    out = [1]
    for k, attrs in enumerate(tree.attrs[1:], 1):
        m = _LABEL.search(attrs)
        out.append(int(m[1]) if m else out[tree.parent[k]] if tree.tag[k] == "#text" else 0)
    return out


def labelled_page(rnd: random.Random) -> str:
    """A page in one of many layouts; data-y says whether an element holds main text."""
    pick, chance = rnd.choice, rnd.random

    def words(low: int, high: int) -> str:
        out = ["".join(pick("aeioubdklmnrst") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(low, high))]
        return " ".join(out)

    def sentences(low: int, high: int) -> str:
        return " ".join(words(3, 18).capitalize() + pick(".....!?") for _ in range(rnd.randint(low, high)))

    def tag(name: str, inner: str, label: int, names: str = "") -> str:
        return f'<{name} data-y="{label}"{" " + names if names else ""}>{inner}</{name}>'

    def named(*options: str) -> str:
        if chance() < 0.15:
            return pick(["", f'class="{words(1, 1)}"'])
        return f'{pick(["class", "class", "id"])}="{pick(options)}{pick(["", "", "", "-1", " box", " wide"])}"'

    link = lambda: f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'
    menu = lambda y=0: tag(pick(["ul", "ol"]), "".join(tag("li", link(), y) for _ in range(rnd.randint(2, 9))), y)
    block = lambda: pick(["div", "div", "section", "aside"])

    def paragraph() -> str:
        text = pick([sentences(1, 3), sentences(1, 7), sentences(1, 30), sentences(1, 60)])
        kind = chance()
        if kind > 0.97:  # very long ones
            text = " ".join([text] * pick([10, 60]))
        elif kind > 0.9:  # lists of words, and texts with odd marks
            text = pick([" | ", " ", "%%% ", ", "]).join(text.split())
        elif kind > 0.8:
            text = words(1, 30)
        if kind < 0.1:
            text += f" {link()} {words(2, 6)}."
        elif kind < 0.2:
            text = f"<b>{words(1, 5)}</b> {text}"
        if chance() < 0.25:  # unclosed, as pages often are
            return f'<p data-y="1">{pick(["", "<b>", "<i>"])}{text}{pick(["", "<br>"])}'
        return tag(pick(["p", "p", "p", "p", "div"]), text, 1)

    def noise(inside: bool) -> str:
        kind = rnd.randrange(12)
        if kind == 0:
            return tag("nav", menu(), 0, pick(["", named("menu", "main-nav", "navigation")]))
        if kind == 1:
            return tag("div", pick([menu(), link() + " &gt; " + link()]), 0, named("menu", "breadcrumbs", "navbar", "pagination"))
        if kind == 2:
            return tag("div", pick([sentences(1, 2), link(), tag("p", sentences(1, 2), 0)]), 0, named("ad", "ads", "banner", "promo", "sponsored", "advertisement"))
        if kind == 3:
            return tag(block(), tag("p", sentences(1, 2), 0) + link(), 0, named("cookie-notice", "consent", "notice", "alert", "newsletter", "popup"))
        if kind == 4:
            return tag("form", f"<label>{words(1, 3)}</label><input name=q>{pick(['', tag('p', sentences(1, 2), 0)])}<button>{words(1, 1)}</button>", 0, pick(["", named("search", "subscribe", "contact-form")]))
        if kind == 5:
            posts = "".join(tag(pick(["div", "li", "p"]), f"{words(1, 2)} " + sentences(1, 4), 0) for _ in range(rnd.randint(1, 5)))
            return tag(pick(["div", "section", "ol"]), tag("h3", words(1, 3), 0) + posts, 0, f'{pick(["class", "id"])}="{pick(["comments", "comment-list", "reader-comments", "discussion", "replies", "disqus_thread"])}"')
        if kind == 6:
            return tag("div", " ".join(link() for _ in range(rnd.randint(2, 6))), 0, named("share", "social-links", "tags", "toolbar"))
        if kind == 7:
            return tag(pick(["aside", "aside", "div"]), tag("h3", words(1, 3), 0) + pick([menu(), tag("p", sentences(1, 3), 0)]), 0, named("sidebar", "related-posts", "widget", "popular", "rail"))
        if kind == 8 and not inside:
            return tag("header", pick(["", tag("h1", words(1, 3), 0), tag("p", words(2, 8), 0)]) + pick(["", menu(), link()]), 0, pick(["", named("header", "site-header", "masthead")]))
        if kind == 9 and not inside:
            return tag("footer", pick(["&copy; ", "", "© 2020 "]) + sentences(1, 2) + pick(["", menu(), link()]), 0, pick(["", named("footer", "site-footer")]))
        if kind == 10:
            return tag("aside", pick([sentences(1, 3), tag("p", sentences(1, 3), 0)]), 0)
        return f"<script>var t=\"</p>\";{words(1, 2)}</script><!-- {words(1, 4)} --><style>p{{margin:0}}</style>"

    def content() -> str:
        parts = [tag(pick(["h1", "h1", "h2"]), words(2, 12).capitalize(), 1)] if chance() < 0.8 else []
        for _ in range(rnd.randint(1, pick([2, 5, 12]))):
            kind = chance()
            if kind < 0.72:
                parts.append(paragraph())
            elif kind < 0.79:
                parts.append(tag(pick(["ul", "ol"]), "".join(tag("li", sentences(1, 2) if chance() < 0.6 else words(2, 6), 1) for _ in range(rnd.randint(2, 5))), 1))
            elif kind < 0.84:
                parts.append(tag(pick(["blockquote", "pre"]), pick([sentences(1, 3), tag("p", sentences(1, 3), 1)]), 1))
            elif kind < 0.88:
                parts.append(tag(pick(["h2", "h3", "h4"]), words(1, 8).capitalize(), 1))
            elif kind < 0.91:
                parts.append(tag("figure", "<img src=x>" + tag("figcaption", sentences(1, 1), 1), 1))
            elif kind < 0.94:
                cells = lambda: tag("tr", "".join(tag("td", words(1, 4), 1) for _ in range(3)), 1)
                parts.append(tag("table", "".join(cells() for _ in range(rnd.randint(1, 4))), 1))
            else:
                parts.append(noise(True))
        return "".join(parts)

    name, names = pick([
        ("article", ""), ("article", named("post", "story", "hentry")), ("main", ""), ("div", 'id="content"'), ("div", named("post-content", "entry-content", "article-body", "story-text")),
        ("section", named("article", "content")), ("td", ""), ("div", ""), ("div", f'class="{words(1, 1)}"'),
    ])
    body = tag(name, content(), 1, names)
    if name == "td":
        body = tag("table", tag("tr", tag("td", menu(), 0) + body, 1), 1)
    if name == "article" and chance() < 0.3:
        body = tag("main", body, 1, pick(["", 'id="main"']))
    around = [noise(False) for _ in range(rnd.randint(1, 7))]
    k = rnd.randint(0, len(around))
    inner = "".join(around[:k]) + body + "".join(around[k:])
    for _ in range(pick([0, 0, 1, 2])):
        inner = tag("div", inner, 1, pick(["", named("wrapper", "container", "page", "site")]))
    return f'<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body data-y="1">{inner}</body></html>'


_trained: list[Model] = []


def trained_model(pages: int = 450, seed: int = 11) -> Model:
    """The model, trained once per process."""
    if not _trained:
        rnd = random.Random(seed)
        _trained.append(train([labelled_page(rnd) for _ in range(pages)]))
    return _trained[0]


def extract(pages: list[str], model: Model) -> list[str]:
    """Main texts of pages."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    content = model.marginals(*features(trees)) >= 0.5
    out, base = [], 0
    for tree in trees:
        out.append("\n".join(t for k, t in enumerate(tree.text) if t and content[base + k]))
        base += len(tree.text)
    return out


def _extract_rows(weights: np.ndarray, pairs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights, pairs)
        for batch in batches:
            pages = [p or "" for p in batch.column(2).to_pylist()]
            at = 0
            while at < len(pages):
                stop, size = at, 0
                while stop < len(pages) and (stop == at or (size < 1_000_000 and stop - at < 256)):
                    size += len(pages[stop])
                    stop += 1
                texts = extract(pages[at:stop], model)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, stop - at), batch.column(1).slice(at, stop - at), pa.array(texts, pa.string())],
                    ["page_id", "url", "text"],
                )
                at = stop

    return run


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: its id, url, main text and the text's length."""
    model = trained_model()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    texts = rows.mapInArrow(_extract_rows(model.weights, model.pairs), "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
