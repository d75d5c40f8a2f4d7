"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of block elements whose leaves are text blocks.  Each
node has a binary variable, content or not, with a potential from its own
features (tag, class names, length, links, punctuation), and each parent and
child share a potential that ties their labels.  Sum-product message passing,
once up and once down the tree, gives every node's exact marginal; text blocks
with a marginal of at least one half are the page's text.  All potentials are
log-linear and are trained by maximum likelihood on labelled pages, whose
gradient is observed minus expected counts under the same message passing.
The labelled pages come from ``labelled_pages``, a generator of page layouts
with known content, since no table holds such labels.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paravane.llm.common import arrow_map, text_slices

#: Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q s samp small span strike strong sub sup time tt u var wbr".split())
#: What a browser does not show as text of the page, or takes from the reader.
RAW = frozenset("script style template textarea title iframe annotation annotation-xml".split())
#: Drawings and formulae: everything inside them is part of a line; an HTML block ends one that was left open.
FOREIGN = frozenset("svg math".split())
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table tbody thead select body".split())

#: Tags with a feature of their own; class-name words by what they hint at.
TAGS = "article main section div p ul ol dl li nav header footer aside form table tr td h1 h2 h3 h4 blockquote pre figure figcaption button select fieldset address details body head".split()
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toc pagination pager skip".split(),
    "page_head": "header masthead topbar logo branding toolbar".split(),
    "page_foot": "footer copyright legal colophon imprint".split(),
    "side": "sidebar aside rail widget related recommended trending popular more teaser".split(),
    "advert": "ad ads advert advertisement adbox sponsor sponsored promo promotion banner outbrain taboola".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall subscribe newsletter signup".split(),
    "social": "share sharing social follow like".split(),
    "comment": "comment comments discussion replies reply disqus reader readers respond".split(),
    "form": "form search login contact input".split(),
    "content": "article content main post entry story body text page".split(),
}
BLOCKS = frozenset(TAGS) | frozenset("center dd dl dt h4 h5 h6 hr img pre table tbody thead tfoot small big strong b i em u".split()) - frozenset(["head"])
_HINT = {word: name for name, words in HINTS.items() for word in words}
_TAG = {t: f"tag={t}" for t in TAGS}
# possessive, so that no page takes more than one pass over a tag; a tag with a stray quote ends at its first '>'
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[a-z]+")


class Node:
    """A block element, or a text block (tag '#')."""

    __slots__ = ("tag", "parent", "children", "names", "text", "linked")

    def __init__(self, tag: str, parent: Node | None, names: str = ""):
        self.tag, self.parent, self.names = tag, parent, names
        self.children: list[Node] = []
        self.text, self.linked = "", 0


def parse(page: str) -> list[Node]:
    """The page's tree in document order, the root first."""
    root = Node("#root", None)
    nodes, stack, held = [root], [root], []  # held: (text, inside a link) of the open block
    links = [0]
    foreign = ""  # the drawing or formula that is open

    def close_block() -> None:
        if held:
            pieces = [html.unescape(t) if "&" in t else t for t, _ in held]
            text = " ".join("".join(pieces).split())
            if text:
                leaf = Node("#", stack[-1])
                leaf.text = text
                leaf.linked = sum(len(" ".join(p.split())) for p, (_, a) in zip(pieces, held) if a)
                stack[-1].children.append(leaf)
                nodes.append(leaf)
            held.clear()

    def close_to(k: int) -> None:
        close_block()
        del stack[k:]
        links[0] = 0

    at, n = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends after it
    while at < n:
        m = _PIECE.search(page, at, last) if at < last else None
        if m is None:
            held.append((page[at:].partition("<!--")[0], links[0] > 0))
            break
        if m.start() > at:
            held.append((page[at : m.start()], links[0] > 0))
        at = m.end()
        name = m[2]
        if not name:
            if page.startswith("<!--", m.start()) and not page.startswith("-->", at - 3):
                break  # an open comment hides the rest
            continue
        tag = name.lower()
        if foreign and tag in BLOCKS:
            foreign = ""
        if tag in FOREIGN or foreign and tag not in RAW:
            if tag in FOREIGN:
                foreign = "" if m[1] or (m[3] or "").endswith("/") else foreign or tag
            if "svg" in (tag, foreign):
                held.append((" ", False))  # texts of a drawing are apart
            continue
        if m[1]:
            if tag == "a":
                links[0] = 0
            elif tag not in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close_to(k)
                        break
                else:
                    close_block()
            continue
        if tag == "a":
            links[0] = 1
        elif tag in ("br", "wbr"):
            held.append((" ", False))
        elif tag in INLINE:
            pass
        elif tag in RAW:
            ended = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
            at = ended.end() if ended else n
        elif tag in VOID:
            close_block()
        else:
            close_block()
            if stack[-1].tag == "p" or tag == "p" and any(x.tag == "p" for x in stack[-2:]):
                close_to(max(k for k, x in enumerate(stack) if x.tag == "p"))
            if ends := CLOSED_BY.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        close_to(k)
                        break
                    if stack[k].tag in SCOPES:
                        break
            names = " ".join(x.strip("\"'") for x in _NAMES.findall(m[3])).lower() if m[3] else ""
            node = Node(tag, stack[-1], names)
            stack[-1].children.append(node)
            nodes.append(node)
            stack.append(node)
            links[0] = 0
    close_block()
    return nodes


def features(node: Node) -> list[str]:
    """Names of the node's binary features."""
    if node.tag != "#":
        out = ["element", _TAG.get(node.tag, "tag=other")]
        if node.names:
            out += {f"name={_HINT[w]}" for w in _WORDS.findall(node.names) if w in _HINT}
        else:
            out.append("plain" + _TAG.get(node.tag, "tag=other"))
        return out
    text, size = node.text, len(node.text)
    share = node.linked / size
    words = text.count(" ") + 1
    out = ["leaf", f"size={min(5, int(math.log2(size + 1)) // 2)}", "in" + _TAG.get(node.parent.tag, "tag=other")]
    out.append("links=none" if share == 0 else "links=some" if share < 0.5 else "links=most")
    out.append("ends" if text[-1] in ".!?…»”\"" else "open")
    if words <= 3:
        out.append("few_words")
    if "©" in text:
        out.append("copyright")
    return out


class TreeModel:
    """Weights of the features and of the parent-child potentials."""

    def __init__(self):
        self.unary: dict[str, float] = {}
        #: By the child's kind: log-potentials [parent label][child label].
        self.pair = {"#": [[0.0, 0.0], [0.0, 0.0]], "": [[0.0, 0.0], [0.0, 0.0]]}

    def marginals(self, nodes: list[Node], scores: list[float]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """P(content) of each node and the joint of each node with its parent (00, 01, 10, 11)."""
        number = {id(x): k for k, x in enumerate(nodes)}
        parent = [number[id(x.parent)] if x.parent is not None else -1 for x in nodes]
        n = len(nodes)
        exp, log = math.exp, math.log
        tables = {k: [[exp(v) for v in row] for row in t] for k, t in self.pair.items()}
        odds = [min(40.0, max(-40.0, s)) for s in scores]  # log odds of content from below
        sent = [0.0] * n  # log of message(1) / message(0) to the parent
        total = odds[:]
        for k in range(n - 1, 0, -1):  # children come after their parents
            t = tables["#" if nodes[k].tag == "#" else ""]
            e = exp(min(40.0, max(-40.0, total[k])))
            sent[k] = log((t[1][0] + t[1][1] * e) / (t[0][0] + t[0][1] * e))
            total[parent[k]] += sent[k]
        p, joint = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
        full = total[:]
        for k in range(n):
            if k:
                t = tables["#" if nodes[k].tag == "#" else ""]
                above = exp(min(40.0, max(-40.0, full[parent[k]] - sent[k])))
                e = exp(min(40.0, max(-40.0, total[k])))
                a, b, c, d = t[0][0], t[0][1] * e, t[1][0] * above, t[1][1] * above * e
                z = a + b + c + d
                joint[k] = (a / z, b / z, c / z, d / z)
                full[k] = log((b + d) / (a + c))
            p[k] = 1 / (1 + exp(-min(40.0, max(-40.0, full[k]))))
        return p, joint

    def scores(self, nodes: list[Node]) -> list[float]:
        weight = self.unary.get
        return [sum(weight(f, 0.0) for f in features(x)) for x in nodes]

    def fit(self, pages: list[tuple[list[Node], list[int]]], steps: int = 60, rate: float = 0.25, ridge: float = 0.002) -> TreeModel:
        """Gradient ascent with momentum-free Adam steps on the mean log-likelihood."""
        names = sorted({f for nodes, _ in pages for x in nodes for f in features(x)})
        index = {f: k for k, f in enumerate(names)}
        rows = [[[index[f] for f in features(x)] for x in nodes] for nodes, _ in pages]
        w = np.zeros(len(names) + 8)
        mean, var = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            grad = -ridge * len(pages) * w
            self.unary = dict(zip(names, w.tolist()))
            self.pair = {"#": [w[-8:-6].tolist(), w[-6:-4].tolist()], "": [w[-4:-2].tolist(), w[-2:].tolist()]}
            for (nodes, labels), feats in zip(pages, rows):
                number = {id(x): k for k, x in enumerate(nodes)}
                p, joint = self.marginals(nodes, [float(w[f].sum()) for f in feats])
                for k, x in enumerate(nodes):
                    grad[feats[k]] += labels[k] - p[k]
                    if k:
                        base = len(names) + (0 if x.tag == "#" else 4)
                        grad[base + 2 * labels[number[id(x.parent)]] + labels[k]] += 1
                        grad[base : base + 4] -= joint[k]
            grad /= len(pages)
            mean += 0.1 * (grad - mean)
            var += 0.02 * (grad * grad - var)
            w += rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.98**step)) + 1e-6)
        return self

    def extract(self, page: str) -> str:
        """The page's content blocks in order, joined by an empty line."""
        nodes = parse(page)
        if len(nodes) == 1:
            return ""
        p, _ = self.marginals(nodes, self.scores(nodes))
        return "\n\n".join(x.text for x, q in zip(nodes, p) if x.tag == "#" and q >= 0.5)


def labelled_pages(count: int, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Generated pages with the list of their content blocks, over varied layouts."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "in")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def sentence(low: int, high: int, end: str = ".") -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + end

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k))

    def paragraph() -> str:
        return " ".join(sentence(1, 18) for _ in range(rng.choice([1, 1, 2, 4, 7])))

    pages = []
    for _ in range(count):
        content: list[str] = []

        def block(text: str, tag: str, inner: str = "%s") -> str:
            content.append(" ".join(text.split()))
            return f"<{tag}>{inner % text}</{tag}>" if rng.random() < 0.9 or tag != "p" else f"<p>{inner % text}"

        def noise(kind: str) -> str:
            short, long = rng.choice([sentence(2, 8, rng.choice(["", "."])), word().capitalize()]), paragraph()
            return {
                "nav": lambda: rng.choice(["<nav><ul>%s</ul></nav>", '<div class="menu"><ul>%s</ul></div>', '<ul class="nav">%s</ul>', '<div id="breadcrumbs"><ul>%s</ul></div>']) % links(rng.randint(3, 9)),
                "header": lambda: rng.choice(["<header><h1>%s</h1><p>%s</p></header>", "<header><h1>%s</h1><!--%s--></header>", '<div id="header"><h2>%s</h2><p>%s</p></div>', '<div class="masthead"><div>%s</div><p>%s</p></div>']) % (short, sentence(3, 9, "")),
                "footer": lambda: rng.choice(["<footer>&copy; %s &middot; %s</footer>", '<div class="footer"><p>&copy; %s</p><p>%s</p></div>', "<footer><p>%s</p><p>%s</p></footer>"]) % (word(), paragraph()),
                "side": lambda: rng.choice(["<aside><h3>%s</h3><ul>%s</ul></aside>", '<div class="sidebar"><h3>%s</h3><ul>%s</ul></div>']) % (short, links(4)) if rng.random() < 0.6 else f"<aside><p>{long}</p></aside>",
                "ad": lambda: rng.choice(['<div class="ad">%s</div>', '<div class="advert"><p>%s</p></div>', '<div id="sponsored">%s</div>', '<div class="promo banner"><p>%s</p></div>']) % rng.choice([short, long]),
                "notice": lambda: rng.choice(['<div class="cookie-notice"><p>%s</p><button>OK</button></div>', '<div class="notice">%s</div>', '<div id="newsletter"><p>%s</p></div>']) % rng.choice([short, long]),
                "share": lambda: '<div class="share"><a href="#">%s</a> <a href="#">%s</a></div>' % (word(), word()),
                "form": lambda: "<form><p>%s</p><label>%s</label><input><button>%s</button></form>" % (rng.choice([short, long]), word(), word()),
                "comments": lambda: rng.choice(['<section class="comments"><h3>%s</h3>%s</section>', '<div id="comments"><h2>%s</h2>%s</div>']) % (short, "".join(rng.choice(['<div class="comment"><p>%s</p></div>', "<p>%s</p>", '<article class="comment"><p>%s</p></article>']) % paragraph() for _ in range(rng.randint(1, 4)))),
            }[kind]()

        def body() -> str:
            out = []
            if rng.random() < 0.85:
                title = block(sentence(2, 10, rng.choice(["", "."])), "h1")
                out.append(f"<header>{title}</header>" if rng.random() < 0.15 else title)
            for _ in range(rng.choice([1, 2, 4, 8, 15])):
                kind = rng.random()
                if kind < 0.04:
                    out.append(block(rng.choice([paragraph(), sentence(1, 9)]), "p", '<a href="#">%s</a>'))
                elif kind < 0.06:
                    out.append(f"<noscript>{block(paragraph(), 'p')}</noscript>")
                elif kind < 0.72:
                    out.append(block(paragraph() if rng.random() < 0.93 else word()[: rng.randint(1, 9)], "p", rng.choice(["%s", "%s", "<b>%s</b>", "<b>%s<br>", '<a href="#">' + "</a>%s"])))
                elif kind < 0.82:
                    out.append(block(sentence(2, 6, ""), rng.choice(["h2", "h3"])))
                elif kind < 0.89:
                    out.append("<ul>" + "".join(block(sentence(3, 12), "li") for _ in range(3)) + "</ul>")
                elif kind < 0.93:
                    out.append("<blockquote>" + block(paragraph(), "p") + "</blockquote>")
                elif kind < 0.96:
                    out.append("<table><tr>" + "".join(block(word(), "td") for _ in range(3)) + "</tr></table>")
                else:
                    out.append(noise(rng.choice(["ad", "share", "notice", "form", "side"])))
            return "".join(out)

        bare = rng.random() < 0.2  # a page of little more than its text
        before = "".join(noise(k) for k in ("nav", "header", "ad", "notice") if rng.random() < 0.5 and not bare)
        main = rng.choice(["<div><div>%s</div></div>", "<div>%s</div>", "%s"]) % (block(sentence(1, 12, rng.choice([".", ""])), "p") if rng.random() < 0.6 else body()) if bare else rng.choice(["<article>%s</article>", "<article>%s</article>", '<main>%s</main>', '<div class="content">%s</div>', '<div id="post"><div class="entry">%s</div></div>', "<main><article>%s</article></main>", '<div class="story">%s</div>']) % body()
        after = "".join(noise(k) for k in ("share", "comments", "side", "ad", "form", "notice", "footer") if rng.random() < 0.45 and not bare)
        pages.append((f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style><script>track()</script></head><body>{before}{main}{after}</body></html>", content))
    return pages


def label(nodes: list[Node], content: list[str]) -> list[int]:
    """A text block is content if it is the next one expected; an element if a block below it is."""
    labels, want = [0] * len(nodes), 0
    number = {id(x): k for k, x in enumerate(nodes)}
    for k, x in enumerate(nodes):
        if x.tag == "#" and want < len(content) and x.text == content[want]:
            labels[k], want = 1, want + 1
            up = x.parent
            while up is not None and not labels[number[id(up)]]:
                labels[number[id(up)]] = 1
                up = up.parent
    return labels


@functools.lru_cache(4)
def trained(count: int = 320, seed: int = 11) -> TreeModel:
    """The model fitted to ``count`` generated pages: the same on every call."""
    pages = [(parse(page), content) for page, content in labelled_pages(count, seed)]
    return TreeModel().fit([(nodes, label(nodes, content)) for nodes, content in pages])


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """Main text of each whole page: (page_id, text string).

    Null, empty and text-free pages give an empty text.  Repeated rows are
    extracted each, other columns are ignored, an empty table gives an empty
    result.  Pages are independent; only the weights are broadcast.
    """
    source = df.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("text"))
    own = model or trained()
    shared = df.sparkSession.sparkContext.broadcast((own.unary, own.pair))
    kind = source.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = TreeModel()
        weights.unary, weights.pair = shared.value
        for part in text_slices(batches):
            texts = [weights.extract(t) if t else "" for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])

    return arrow_map(source, run, f"page_id {kind}, text string")
