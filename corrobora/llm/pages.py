"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements. Every node is content or not; a node's own features (tag, class and id
words, text, links) give its potential, and each pair of parent and child has a potential by the child's kind. Sum-product
messages pass upward and then downward, so each node's marginal weighs the whole page. The weights are trained by gradient
ascent on the likelihood of labelled pages: their gradient is what the labels show less what the marginals expect.

Labelled pages: rows of the table whose elements name their role themselves (article and main against nav, footer, aside
and the like; ``SAMPLE`` rows at most), and one small page for each word that class names commonly use for what isn't
content. Text is taken from content nodes, in page order, a block on each line.

Defined cases: null and empty pages and pages without content have an empty text; unclosed and stray tags are borne as
browsers bear them; script, style, head and the like are never text; a null id or url is kept; every row has one row.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corrobora.llm.common import slices
from corrobora.session import ship

SAMPLE = 300            # labelled rows of the table that are learned from, at most
FEATURES = 4_096        # hashed features
EPOCHS = 12

#: fixed values: elements by what the HTML standard makes of them
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe select button".split())     # math, object and the like are inline text
_TEXT_ONLY = frozenset("script style textarea title".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "figcaption"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
_SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",),
           "thead": ("table",), "tfoot": ("table",)}
#: roles that elements name themselves, and words that class names and ids use for what isn't content
_CONTENT_TAGS = frozenset(("article", "main"))
_OTHER_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "fieldset"))
_OTHER_WORDS = tuple(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side "
    "aside widget widgets footer foot header masthead topbar toolbar cookie cookies consent notice notices alert gdpr privacy disclaimer comment comments "
    "commentlist reply replies respond discussion disqus share sharing social related recommended recommendations more teaser newsletter subscribe signup "
    "login register search form popup modal overlay pagination pager tags copyright legal".split())
_MAIN_WORDS = frozenset("content article post entry story main body text".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "hidden", "parent", "items", "size", "linked", "links")

    def __init__(self, tag: str, names: tuple[str, ...], hidden: bool, parent: int):
        self.tag, self.names, self.hidden, self.parent = tag, names, hidden, parent
        self.items: list = []           # texts and numbers of child nodes, in page order
        self.size = self.linked = self.links = 0


def parse(page: str) -> list[Node]:
    """The block elements of a page, parents before children; inline elements count as the text they hold."""
    nodes = [Node("html", (), False, -1)]
    stack: list[tuple[str, int]] = [("html", 0)]            # open elements: tag, block node it belongs to
    at, links, unclosed = 0, 0, set()

    def say(raw: str) -> None:
        if raw:
            node = nodes[stack[-1][1]]
            node.items.append(raw)
            n = len(raw.strip())
            node.size += n
            if links:
                node.linked += n

    def close(depth: int) -> None:
        nonlocal links
        for tag, _ in stack[depth:]:
            links -= tag == "a"
        del stack[depth:]

    def find_open(tags, stop) -> int:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                return depth
            if stack[depth][0] in stop:
                break
        return 0
    while True:
        m = _MARKUP.search(page, at)
        if not m:
            say(page[at:])
            return nodes
        say(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[6]
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag, attrs, shut = tag.lower(), m[3] if m[2] else m[7], m[1] or m[5]
        if shut:
            if tag == "p" and not find_open(("p",), ()):
                continue
            depth = find_open((tag,), () if tag in _BLOCK else _BLOCK - {"p"})
            if depth:
                close(depth)
            continue
        if tag in _RAW:                                     # what it holds is no text
            end = None if tag in unclosed else re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if not end:
                unclosed.add(tag)                           # no need to look for it again
            if not attrs.rstrip().endswith("/") or tag in _TEXT_ONLY:
                at = end.end() if end else (len(page) if tag in _TEXT_ONLY else at)
            nodes[stack[-1][1]].items.append(" ")
            continue
        if tag == "head":
            end = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
            if end:
                at = end.start() if end[0][1] != "/" else end.end()
            continue
        if tag in ("html", "body"):
            continue
        if tag in _ENDS_P and (depth := find_open(("p",), _BLOCK - {"p"})):
            close(depth)
        if tag in _SIBLINGS and (depth := find_open(_SIBLINGS[tag], _SCOPES[tag])):
            close(depth)
        if tag in ("br", "hr"):
            nodes[stack[-1][1]].items.append("\n")
        if tag in _VOID:
            continue
        if tag in _BLOCK:
            names = tuple(w for x in _NAMES.findall(attrs) for w in _SPLIT.split("".join(x).lower()) if w)
            parent = stack[-1][1]
            nodes.append(Node(tag, names, bool(_HIDDEN.search(attrs)), parent))
            nodes[parent].items.append(len(nodes) - 1)
            stack.append((tag, len(nodes) - 1))
        else:
            if tag == "a":
                links += 1
                nodes[stack[-1][1]].links += 1
            stack.append((tag, stack[-1][1]))


def _slot(feature: str) -> int:
    import zlib
    return zlib.crc32(feature.encode()) % FEATURES


_slots: dict[str, int] = {}


def slot(feature: str) -> int:
    if feature not in _slots:
        if len(_slots) > 100_000:
            _slots.clear()
        _slots[feature] = _slot(feature)
    return _slots[feature]


def features(nodes: list[Node]) -> list[list[int]]:
    """Hashed features of each node; a node's own text and its subtree's links are described in bands."""
    size, linked, links = ([getattr(n, k) for n in nodes] for k in ("size", "linked", "links"))
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        size[p] += size[i]
        linked[p] += linked[i]
        links[p] += links[i]
    out = []
    for i, n in enumerate(nodes):
        share = linked[i] / size[i] if size[i] else 0.0
        f = ["bias", "tag " + n.tag, f"own {min(8, n.size.bit_length())}", f"size {min(12, size[i].bit_length())}", f"linked {round(share * 4)}"]
        known = [w for w in n.names if w in _OTHER_SET]
        f += ["other"] * bool(known) + ["mainly"] * any(w in _MAIN_WORDS for w in n.names) + ["hidden"] * n.hidden
        f += ["name " + w for w in dict.fromkeys(n.names)]
        out.append([slot(x) for x in f])
    return out


_OTHER_SET = frozenset(_OTHER_WORDS)
PAIRS = ("plain", "other", "content")       # kinds of children with a pair potential each


def pair_kind(n: Node) -> int:
    if n.tag in _OTHER_TAGS or n.tag in ("header",) or n.hidden or any(w in _OTHER_SET for w in n.names):
        return 1
    return 2 if n.tag in _CONTENT_TAGS else 0


# ---------------------------------------------------------------- the model

@dataclass
class Model:
    own: np.ndarray         # FEATURES: for content
    pair: np.ndarray        # kinds x parent x child

    def marginals(self, parent: list[int], kinds: list[int], feats: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent label, child label) of each node and its parent."""
        n = len(parent)
        score = [float(self.own[f].sum()) for f in feats]
        up = [[0.0, s] for s in score]                      # log potential of a node and all below it
        msg = [(0.0, 0.0)] * n                              # from a node to its parent
        pair = self.pair.tolist()
        for i in range(n - 1, 0, -1):
            t, (a, b) = pair[kinds[i]], up[i]
            msg[i] = (_lse(t[0][0] + a, t[0][1] + b), _lse(t[1][0] + a, t[1][1] + b))
            q = up[parent[i]]
            q[0] += msg[i][0]
            q[1] += msg[i][1]
        down = [(0.0, 0.0)] * n                             # from the parent to a node
        out, both = np.zeros(n), np.zeros((n, 2, 2))
        for i in range(n):
            if i:
                p, t = parent[i], pair[kinds[i]]
                rest = (up[p][0] + down[p][0] - msg[i][0], up[p][1] + down[p][1] - msg[i][1])
                down[i] = (_lse(rest[0] + t[0][0], rest[1] + t[1][0]), _lse(rest[0] + t[0][1], rest[1] + t[1][1]))
                joint = np.array([[rest[x] + t[x][y] + up[i][y] for y in (0, 1)] for x in (0, 1)])
                joint = np.exp(joint - joint.max())
                both[i] = joint / joint.sum()
            a, b = up[i][0] + down[i][0], up[i][1] + down[i][1]
            out[i] = 1 / (1 + np.exp(min(700.0, max(-700.0, a - b))))
        return out, both


def _lse(a: float, b: float) -> float:
    from math import exp, log1p
    return a + log1p(exp(b - a)) if a >= b else b + log1p(exp(a - b))


def fit(trees: list[dict], epochs: int = EPOCHS, rate: float = 0.3) -> Model:
    """trees: parent, kinds, features, labels (content or not) of each labelled page. AdaGrad on the log-likelihood."""
    model = Model(np.zeros(FEATURES), np.zeros((len(PAIRS), 2, 2)))
    seen_own, seen_pair = np.full(FEATURES, 1e-2), np.full(model.pair.shape, 1e-2)
    order = np.random.default_rng(3)
    for _ in range(epochs):
        for at in order.permutation(len(trees)):
            t = trees[at]
            p, both = model.marginals(t["parent"], t["kinds"], t["features"])
            y = np.array(t["labels"], int)
            g_own, g_pair = np.zeros(FEATURES), np.zeros_like(model.pair)
            for i, f in enumerate(t["features"]):
                g_own[f] += y[i] - p[i]
                if i:
                    g_pair[t["kinds"][i], y[t["parent"][i]], y[i]] += 1
                    g_pair[t["kinds"][i]] -= both[i]
            g_own -= 1e-3 * model.own
            seen_own += g_own ** 2
            seen_pair += g_pair ** 2
            model.own += rate * g_own / np.sqrt(seen_own)
            model.pair += rate * g_pair / np.sqrt(seen_pair)
    return model


def own_labels(nodes: list[Node]) -> list[bool] | None:
    """Content by the roles that elements name; None if no element says where the content is."""
    out = [False] * len(nodes)
    if not any(n.tag in _CONTENT_TAGS for n in nodes):
        return None
    for i, n in enumerate(nodes):
        if i:
            other = n.tag in _OTHER_TAGS or n.hidden or any(w in _OTHER_SET for w in n.names) and n.tag not in _CONTENT_TAGS
            out[i] = not other and (n.tag in _CONTENT_TAGS or out[n.parent])
    return out


def tree_of(nodes: list[Node], labels: list[bool]) -> dict:
    return {"parent": [n.parent for n in nodes], "kinds": [pair_kind(n) for n in nodes], "features": features(nodes), "labels": [int(x) for x in labels]}


def written_pages() -> Iterator[dict]:
    """One labelled tree for each word of what isn't content, inside and outside the article, by turns. The element of
    the article is named as such, by a class or not at all, again by turns."""
    words = " lorem ipsum dolor sit amet consectetur" * 6
    names = sorted(_MAIN_WORDS)
    for at, w in enumerate(_OTHER_WORDS):
        kind = ("class", "id")[at % 2]
        box = f'<div {kind}="{w}"><p>{words[:40 + at % 5 * 40]}</p></div>'
        inside, outside = (box, "") if at % 3 == 0 else ("", box)
        content = f"<h1>{words[:30]}</h1><p>{words}</p><ul><li>{words[:60]}</li></ul>{inside}<p>{words[:90]}</p><div><p>{words[:50]}</p></div>"
        nodes = parse(f"<body><header><div><h2>{words[:20]}</h2></div><ul><li><a href=x>{words[:10]}</a></li></ul></header><nav><ul><li><a href=x>{words[:10]}</a>"
                      f"</li></ul></nav>{outside}<div><article>{content}</article></div><aside><h2>{words[:10]}</h2><p>{words[:80]}</p></aside>"
                      f"<form><p>{words[:30]}</p></form><footer><p>{words[:40]}</p></footer></body>")
        labels = own_labels(nodes)
        for n in nodes:
            if n.tag == "article" and at % 4:
                n.tag, n.names = "div", () if at % 4 == 3 else (names[at % len(names)],)
        yield tree_of(nodes, labels)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Model:
    """From at most ``sample`` rows of the table, those with the smallest hash of the id, and from the written pages."""
    ship(pages.sparkSession)
    ids = pages.filter(pages[id_col].isNotNull()).select(pages[id_col].alias("i")).distinct().orderBy(F.xxhash64("i", F.lit(19)), "i").limit(sample)
    chosen = pages.select(pages[id_col].alias("i"), F.coalesce(pages[html_col], F.lit("")).alias("html")).join(F.broadcast(ids), "i")
    schema = "parent array<int>, kinds array<int>, features array<array<int>>, labels array<int>"

    def run(batches):
        for b in slices(batches, 100):
            trees = []
            for page in b.column(0).to_pylist():
                nodes = parse(page)
                labels = own_labels(nodes)
                if labels is not None and len(nodes) <= 5_000:
                    trees.append(tree_of(nodes, labels))
            kinds = (pa.list_(pa.int32()),) * 2 + (pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in trees], x) for k, x in zip(("parent", "kinds", "features", "labels"), kinds)],
                                             names=["parent", "kinds", "features", "labels"])
    trees = chosen.select("html").mapInArrow(run, schema).toArrow().to_pylist()
    trees.sort(key=repr)
    return fit([*trees, *written_pages()])


# ---------------------------------------------------------------- the operator

def main_text(page: str, model: Model) -> str:
    nodes = parse(page)
    p, _ = model.marginals([n.parent for n in nodes], [pair_kind(n) for n in nodes], features(nodes))
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
        if text:
            blocks.append(text)
        line.clear()
    todo: list[tuple[int, int]] = [(0, 0)]
    while todo:
        i, at = todo.pop()
        items = nodes[i].items
        while at < len(items) and isinstance(items[at], str):
            if p[i] > 0.5:
                line.append(items[at])
            at += 1
        end()
        if at < len(items):
            todo += [(i, at + 1), (items[at], 0)]
    return "\n".join(blocks)


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    ship(pages.sparkSession)
    model = model or train(pages, id_col, html_col)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, 200):
            texts = [main_text(t, shared.value) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])
    own = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
