"""Main content of HTML pages: gradient-boosted trees over DOM nodes, decoded hierarchically.

A page is parsed to a tree of its block elements; text and links of inline elements count for the block around them. Each block has features of its subtree (text, tags and links, density), its tag, the tokens of
its class and id and of its ancestors' (each token with the log-odds of content that it had on the training pages), its depth, and its siblings. Boosted trees, fitted on generated pages of known content, give each block log-odds of being content. Decoding then picks
for every subtree the best of three: all content, all boilerplate, or a mixture, in which the block's own text and each of its children are decided in the same way. So no block is content below a
boilerplate ancestor, nor boilerplate below an ancestor that is all content. Log-odds are weighted by the length of a block's own text, and mixing has a cost in blocks with text and in such that look like boilerplate; the choice has the greatest total of all that obey this.

Parsing is one scan of whole pages with an explicit stack; depth is unlimited. Nothing is shuffled.

Defined results: page_id is an integer, or a string of one (others fail in the cast); a null html has a null text; an empty html, or one without content, an empty text; text outside any element belongs to the page's root; broken markup is read as far as it goes: unclosed
elements close with their parent, stray end tags are skipped, an unclosed comment, script, style or textarea runs to the end, of an unclosed noscript, iframe, svg or template
only the tag is skipped, and a head ends at its end tag or at the first element or text that can't be in it. Repeated rows are extracted each; a tie between content and boilerplate is boilerplate. Columns besides page_id and html are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import html_training

#: Generated pages and seed of the fit; trees, their depth, the bins of a feature and the rate of learning.
PAGES, SEED, TREES, DEPTH, BINS, RATE = 500, 11, 40, 4, 32, 0.25
#: Fewest blocks that a token must be on to have log-odds of its own; what mixing a block's own text costs, and the share of log-odds against a block that mixing it costs, and that taking it whole costs.
SEEN, MIXED, AGAINST, PLAIN = 4, 0.7, 0.2, 0.2
_BLOCKS = (
    "#root html body div p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 nav header footer article main section aside table tbody thead tfoot tr td th form fieldset blockquote pre figure figcaption address details summary"
).split()
_CODE = {t: k for k, t in enumerate(_BLOCKS)}
_GROUPS = [["p", "blockquote", "pre", "dd"], ["li", "dt"], ["ul", "ol", "dl"], ["h1"], ["h2", "h3", "h4", "h5", "h6"], ["nav"], ["header"], ["footer", "address"], ["article", "main"], ["section"], ["aside"], ["table", "tbody", "thead", "tfoot", "tr", "td", "th"], ["form", "fieldset"], ["div"]]
_GROUP = np.full(len(_BLOCKS), len(_GROUPS), np.int64)
for _k, _g in enumerate(_GROUPS):
    for _t in _g:
        _GROUP[_CODE[_t]] = _k
_RAW = {"script", "style", "noscript", "template", "svg", "textarea", "iframe"}
#: Raw elements of which only the tag is skipped if they don't end, and what a head can hold besides raw elements.
_LOOSE = {"noscript", "iframe", "svg", "template", "title"}
_IN_HEAD = {"title", "meta", "link", "base"}
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[!?][^>]*>)", re.S)
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW | {"title"}}
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
#: What closes an open element of the same kind.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_P_ENDS = frozenset(t for t in _BLOCKS if t not in ("#root", "html", "body"))
NAMES = (
    "group parent_group grand_group depth children good bad good_above bad_above in_aside own_text text words word_length stops tags density link_share links siblings place sibling_text sibling_share same_tag position page_share".split()
)


def parse(html: str, odds: dict[str, int] | None = None, noted: list[tuple[int, list[str]]] | None = None) -> tuple[list[list], list[str]]:
    """(blocks, their own text). A block is [tag, parent, depth, good tokens, bad tokens, own characters, of links, links, inline tags, gold]; parents come first.

    odds: sixteenths of log-odds of tokens, whose positive and negative sums count as good and bad; noted: gets the tokens of each block.
    """
    blocks = [[0, -1, 0, 0, 0, 0, 0, 0, 0, False]]
    texts: list[list[str]] = [[]]
    stack, names = [0], ["#root"]
    link = 0
    head = False
    endless: set[str] = set()
    live: dict[str, int] = {}  # open elements by name
    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        end = m.start() if m else n
        if end > at:
            piece = html[at:end]
            if not piece.isspace():
                head = False
                top = stack[-1]
                size = len(piece.strip())
                texts[top].append(piece)
                blocks[top][5] += size
                if link:
                    blocks[top][6] += size
            elif texts[stack[-1]]:
                texts[stack[-1]].append(" ")
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "head":
                head = False
            elif live.get(name):
                while True:
                    stack.pop()
                    live[last := names.pop()] -= 1
                    if last == name:
                        break
                link = 0
            elif name == "a":
                link = 0
            continue
        if name == "head":
            head = len(names) == 1 or names[1:] == ["html"]
            continue
        if name in _RAW or head and name == "title":
            if not m[3].endswith("/"):
                stop = None if name in endless else _ENDS[name].search(html, at)
                if stop:
                    at = stop.end()
                elif name in _LOOSE:
                    endless.add(name)
                else:
                    at = n
            continue
        if head:
            if name in _IN_HEAD:
                continue
            head = False
        if name not in _CODE:
            block = blocks[stack[-1]]
            block[8] += 1
            if name == "a":
                link = 1
                block[7] += 1
            elif name == "br":
                texts[stack[-1]].append(" ")
            continue
        link = 0
        if name in ("html", "body"):
            if live.get(name):
                continue
        elif names[-1] == "p" and name in _P_ENDS or names[-1] in _CLOSES.get(name, ()):
            stack.pop()
            live[names.pop()] -= 1
            if name == "tr" and names[-1] == "tr":
                stack.pop()
                live[names.pop()] -= 1
        good = bad = 0
        if m[3]:
            tokens = [t for x in _ATTR.finditer(m[3]) for t in _TOKEN.findall((x[1] or x[2] or x[3] or "").lower())]
            if noted is not None:
                noted.append((len(blocks), tokens))
            if odds:
                for t in tokens:
                    v = odds.get(t, 0)
                    good, bad = (good + v, bad) if v > 0 else (good, bad - v)
        parent = stack[-1]
        texts[parent].append(" ")
        stack.append(len(blocks))
        names.append(name)
        live[name] = live.get(name, 0) + 1
        blocks.append([_CODE[name], parent, blocks[parent][2] + 1, good, bad, 0, 0, 0, 0, "data-gold" in m[3]])
        texts.append([])
    return blocks, [" ".join(unescape("".join(t)).split()) if t else "" for t in texts]


def features(docs: list[tuple[list[list], list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, parents in the joined list or -1, bounds of the pages, gold) of all blocks of some pages."""
    size = np.array([len(b) for b, _ in docs], np.int64)
    off = np.concatenate(([0], np.cumsum(size)))
    raw = np.array([x for b, _ in docs for x in b], np.int64).reshape(-1, 10)
    text = [t for _, ts in docs for t in ts]
    n = len(raw)
    page = np.repeat(np.arange(len(docs)), size)
    tag, depth = raw[:, 0], raw[:, 2]
    parent = np.where(raw[:, 1] < 0, -1, raw[:, 1] + off[page])
    up = np.maximum(parent, 0)
    words = np.fromiter((t.count(" ") + 1 if t else 0 for t in text), np.float64, n)
    stops = np.fromiter((t.count(".") + t.count(",") for t in text), np.float64, n)
    sub = np.column_stack([raw[:, 5], raw[:, 6], raw[:, 7], raw[:, 8] + 1, words, stops]).astype(float)
    good_above, bad_above, aside = np.zeros(n), np.zeros(n), np.zeros(n)
    own_aside = np.isin(tag, [_CODE[t] for t in ("nav", "footer", "aside", "header", "form")]).astype(float)
    levels = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[levels], np.arange(depth.max() + 2)) if n else np.zeros(1, int)
    for d in range(len(cuts) - 2, 0, -1):
        i = levels[cuts[d] : cuts[d + 1]]
        np.add.at(sub, parent[i], sub[i])
    for d in range(1, len(cuts) - 1):
        i = levels[cuts[d] : cuts[d + 1]]
        p = parent[i]
        good_above[i], bad_above[i] = good_above[p] + raw[p, 3], bad_above[p] + raw[p, 4]
        aside[i] = np.maximum(aside[p], own_aside[p])
    kids = np.bincount(parent[parent >= 0], minlength=n).astype(float)
    kid_text = np.bincount(parent[parent >= 0], weights=sub[parent >= 0, 0], minlength=n)
    key = np.where(parent >= 0, parent * len(_BLOCKS) + tag, -1 - np.arange(n))
    _, inv, many = np.unique(key, return_inverse=True, return_counts=True)
    order = np.argsort(parent, kind="stable")
    place = np.empty(n)
    ps = parent[order]
    place[order] = np.arange(n) - np.searchsorted(ps, ps)
    total = np.maximum(sub[off[:-1], 0][page], 1)
    t = sub[:, 0]
    x = np.column_stack(
        [
            _GROUP[tag], np.where(parent < 0, -1, _GROUP[tag[up]]), np.where(parent[up] < 0, -1, _GROUP[tag[np.maximum(parent[up], 0)]]), depth, kids, np.minimum(raw[:, 3], 96), np.minimum(raw[:, 4], 96),
            np.minimum(good_above, 96), np.minimum(bad_above, 96), np.maximum(aside, own_aside), np.log1p(raw[:, 5]), np.log1p(t), np.log1p(sub[:, 4]), t / np.maximum(sub[:, 4], 1), sub[:, 5] / np.maximum(sub[:, 4], 1), np.log1p(sub[:, 3]),
            np.log1p(t / sub[:, 3]), sub[:, 1] / np.maximum(t, 1), np.log1p(sub[:, 2]), kids[up], place / np.maximum(kids[up], 1), np.log1p(kid_text[up] / np.maximum(kids[up], 1)), t / np.maximum(kid_text[up], 1),
            many[inv] / np.maximum(kids[up], 1), (np.arange(n) - off[page]) / size[page], t / total,
        ]
    )
    return x.astype(np.float32), parent, off, raw[:, 9].astype(bool)


class Boosted:
    """Gradient-boosted trees for a logistic loss, grown on binned features; complete trees of equal depth."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for k in range(f)]
        b = np.column_stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)])
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        z = np.full(n, self.base)
        inner = (1 << DEPTH) - 1
        self.feature, self.cut, self.leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf, np.float32), np.zeros((TREES, 1 << DEPTH))
        for t in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for d in range(DEPTH):
                width = 1 << d
                best = np.full(width, 1e-3)
                for k in range(f):
                    if not len(self.edges[k]):
                        continue
                    cell = node * BINS + b[:, k]
                    cg = np.cumsum(np.bincount(cell, g, width * BINS).reshape(width, BINS), 1)
                    ch = np.cumsum(np.bincount(cell, h, width * BINS).reshape(width, BINS), 1)
                    tg, th = cg[:, -1:], ch[:, -1:]
                    gain = cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1)
                    gain[:, len(self.edges[k]) :] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    up = top > best
                    best[up] = top[up]
                    here = width - 1 + np.flatnonzero(up)
                    self.feature[t, here], self.cut[t, here] = k, self.edges[k][at[up]]
                q = width - 1 + node
                node = 2 * node + (x[np.arange(n), self.feature[t, q]] > self.cut[t, q])
            sg, sh = np.bincount(node, g, 1 << DEPTH), np.bincount(node, h, 1 << DEPTH)
            self.leaf[t] = RATE * sg / (sh + 1)
            z += self.leaf[t][node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of being content."""
        z = np.full(len(x), self.base)
        flat = np.ascontiguousarray(x).ravel()
        row = np.arange(len(x)) * x.shape[1]
        for t in range(TREES):
            node = np.zeros(len(x), np.int64)
            for d in range(DEPTH):
                q = (1 << d) - 1 + node
                node = 2 * node + (flat[row + self.feature[t, q]] > self.cut[t, q])
            z += self.leaf[t][node]
        return z


def decode(parent: list[int], gain: list[float], own: list[float], cost: list[float]) -> list[bool]:
    """Whether the own text of each block is content, by the labelling of greatest total.

    A block that is all content adds its gain and its own text's, and all below it are too; one that is all boilerplate adds nothing, and none below it is content; a mixed one
    takes off its cost, and its own text and its children are decided each. Equal totals are boilerplate first, then mixed. Parents come before their children.
    """
    n = len(parent)
    whole = [g + o for g, o in zip(gain, own)]
    mixed = [max(o, 0.0) - c for o, c in zip(own, cost)]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        if p >= 0:
            whole[p] += whole[k]
            mixed[p] += max(whole[k], mixed[k], 0.0)
    out, state = [False] * n, [0] * n  # 0 boilerplate, 1 mixed, 2 content
    for k in range(n):
        p = parent[k]
        above = state[p] if p >= 0 else 1
        if above == 1:
            state[k] = 2 if whole[k] > mixed[k] and whole[k] > 0 else int(mixed[k] > 0)
        else:
            state[k] = above
        out[k] = state[k] == 2 or state[k] == 1 and own[k] > 0
    return out


class Model:
    """Sixteenths of log-odds of attribute tokens, and the boosted trees."""

    def __init__(self, odds: dict[str, int], trees: Boosted):
        self.odds, self.trees = odds, trees


def learnt_odds(htmls: list[str]) -> dict[str, int]:
    """Sixteenths of the log-odds of content of each attribute token that is seen on SEEN blocks or more, next to those of all blocks with attributes."""
    count: dict[str, list[int]] = {}
    total = [1, 1]
    for h in htmls:
        noted: list[tuple[int, list[str]]] = []
        blocks, _ = parse(h, None, noted)
        for k, tokens in noted:
            gold = bool(blocks[k][9])
            total[gold] += 1
            for t in set(tokens) - {"data", "gold"}:
                count.setdefault(t, [0, 0])[gold] += 1
    base = np.log(total[1] / total[0])
    return {t: round(16 * float(np.log((y + 0.5) / (x + 0.5)) - base)) for t, (x, y) in sorted(count.items()) if x + y >= SEEN}


def fit(pages: int = PAGES, seed: int = SEED) -> Model:
    """Fit on generated pages."""
    htmls = html_training.pages(pages, seed)
    odds = learnt_odds(htmls)
    x, _, _, gold = features([parse(h, odds) for h in htmls])
    return Model(odds, Boosted(x, gold.astype(float)))


def contents(htmls: list[str], model: Model) -> list[tuple[str, int, int]]:
    """(text, blocks whose own text is content, blocks) of each page."""
    docs = [parse(h, model.odds) for h in htmls]
    if not docs:
        return []
    x, parent, off, _ = features(docs)
    z = model.trees.margin(x)
    own = z * x[:, NAMES.index("own_text")]
    frame = np.concatenate([[_BLOCKS[b[0]] in ("#root", "html", "body") for b in blocks] for blocks, _ in docs])
    cost = np.where(own != 0, MIXED, 0.0) + np.where(frame, 0.0, AGAINST * np.maximum(-z, 0))
    out = []
    for k, (blocks, texts) in enumerate(docs):
        lo, hi = off[k], off[k + 1]
        keep = decode([b[1] for b in blocks], (PLAIN * np.minimum(z[lo:hi], 0)).tolist(), own[lo:hi].tolist(), cost[lo:hi].tolist())
        out.append(("\n".join(t for t, y in zip(texts, keep) if y and t), sum(keep), len(blocks)))
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, text, content_blocks, blocks) of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model or fit())

    def run(batches):
        m = sent.value
        for b in batches:
            for lo in range(0, max(b.num_rows, 1), 256):
                part = b.slice(lo, 256)
                html = part.column(1).to_pylist()
                got = contents([h or "" for h in html], m)
                text = [None if h is None else t for h, (t, _, _) in zip(html, got)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(text, pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], names=["page_id", "text", "content_blocks", "blocks"]
                )

    d = pages.selectExpr("cast(page_id as long) as page_id", "cast(html as string) as html")
    return d.mapInArrow(run, "page_id long, text string, content_blocks int, blocks int")
