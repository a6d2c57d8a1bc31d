"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is cut into tags and text once; elements become nodes. Boosted trees give each block-level node
the log-odds that its subtree is article text, from subtree density (text, tags, links, blocks, inputs),
depth, place and shares among its siblings and those of the nodes above it, and its attribute tokens:
the tokens of its tag, class, id and role, hashed to BUCKETS features, and those of all nodes above it,
hashed to as many.

Decoding is hierarchical. Going into a node that the trees speak against costs its log-odds, weighted
by the text below it; keeping the own text of a node that they speak for gains likewise. The set of
open nodes of highest total is found bottom up, each open node's parent being open, so no node below a
dropped one is kept, and a container is dropped whole unless what is kept in it outweighs it.

Labels: nodes of the sampled pages that say what they are, by tag or by class and id tokens (fixed
values below), where these don't contradict each other; and pages laid out anew from their blocks,
whose truth is known: article blocks in one container, other blocks in menus, notices, sidebars,
comments, forms and footers around and inside it, names telling, missing, meaningless or misleading
by turns. So names are one feature among others, and layout decides where they say nothing or
contradict themselves.

About SAMPLE_PAGES pages and SAMPLE_NODES nodes are learned from; rows that repeat a page count as one
there. A page without any tag is its own text. Null and empty pages give an empty text; scripts,
styles, templates, comments and the head never reach it. Every row, repeated or not, is extracted from
its own html alone; a column named as the result gives way to it, all others stay as they are. A script
or style that is never closed takes the rest of the page; of any other unclosed element only the tag goes.
Quotes open an attribute's value after "=" only. A table whose sampled pages tell nothing (no names, no
long blocks, or all names alike) teaches no trees: then all stays that a page's own names do not speak against.

For training, a page of more than SAMPLE_NODES / 100 nodes gives that many, drawn at random; extraction
always looks at all nodes.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored, with_columns

SAMPLE_PAGES, SAMPLE_NODES, LAYOUTS = 400, 40_000, 3
#: LEAST_LEAF bounds a leaf's sum of p (1 - p); each tree tries half of the features.
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 60, 5, 0.25, 16, 1.0
BUCKETS = 128
#: A page as it is weighs as much as its layouts together.
OWN_WEIGHT = 3.0
#: Nodes of a task's pages that are measured together, and those whose odds are taken at once; a page of more is measured alone.
NODES, SLICE = 50_000, 20_000
#: Starts the article's text in pages laid out for training.
MARK = "\ue000"

#: Element names by role, and tokens of class and id that name a role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea select option button head".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CODE = frozenset("script style".split())
KEPT_TAGS = frozenset("article main".split())
DROPPED_TAGS = frozenset("nav footer header aside form menu dialog".split())
KEPT_NAMES = frozenset("article content entry main post story body text".split())
DROPPED_NAMES = frozenset(
    "ad ads advert advertisement advertising banner promo sponsor sponsored sidebar side aside rail menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead "
    "notice cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login form search comment comments reply replies discussion disqus feedback share sharing social "
    "related recommended widget toolbar pagination pager tags copyright legal disclaimer skip toc alert".split()
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANK = re.compile(r"\s+")
#: What an open element of the first kind ends when one of the second starts.
_ENDS = {"p": BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}


class Page:
    """The block elements of a page in document order, and its text pieces with the block that holds each."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names, self.own, self.marked = ["root"], [-1], [()], [0], [0]
        self.links, self.inline, self.inputs, self.signs, self.pieces = [0], [0], [0], [0], []  # pieces: (block, text or None for a line end)
        stack: list[tuple[str, int]] = [("root", 0)]
        pos, in_link, unclosed = 0, 0, set()
        for m in _TAG.finditer(source):
            if m.start() > pos:
                self.add(stack[-1][1], source[pos : m.start()], in_link)
            if m.start() < pos:
                continue
            pos = m.end()
            name = (m.group(2) or "").lower()
            if not name:
                continue
            if m.group(1):
                self.close(stack, name)
                in_link -= name == "a" and in_link > 0
                continue
            if name in RAW:
                self.inputs[stack[-1][1]] += name in ("button", "select", "textarea")
                if not m.group(3).endswith("/") and name not in unclosed:
                    close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, pos)
                    if close or name in CODE:
                        pos = close.end() if close else len(source)
                    else:  # never closed: nothing tells where it ends, so what follows is read as part of the page
                        unclosed.add(name)
                continue
            if name in VOID:
                self.inputs[stack[-1][1]] += name == "input"
                if name in ("br", "hr"):
                    self.pieces.append((stack[-1][1], " "))
                continue
            while len(stack) > 1 and name in _ENDS.get(stack[-1][0], ()):
                stack.pop()
            if name in BLOCK:
                # an open paragraph below inline elements ends as well
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p" and name in _ENDS["p"]:
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCK:
                        break
                self.tag.append(name)
                self.parent.append(stack[-1][1])
                self.names.append(tuple(t for n in _NAMES.findall(m.group(3)) for t in re.split(r"[^a-z]+", "".join(n).lower()) if t) if m.group(3) else ())
                for column in (self.own, self.marked, self.links, self.inputs, self.signs):
                    column.append(0)
                self.inline.append(0)
                stack.append((name, len(self.tag) - 1))
                self.pieces.append((stack[-1][1], None))
            else:
                in_link += name == "a"
                self.inline[stack[-1][1]] += 1
                stack.append((name, stack[-1][1]))
        if pos < len(source):
            self.add(stack[-1][1], source[pos:], in_link)

    def add(self, block: int, text: str, in_link: int) -> None:
        self.pieces.append((block, text))
        n = len(text) - text.count(" ")
        self.own[block] += n
        self.links[block] += n if in_link else 0
        self.signs[block] += text.count(".") + text.count(",")
        if MARK in text:
            self.marked[block] += n

    def close(self, stack: list[tuple[str, int]], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                block = stack[k][1]
                del stack[k:]
                if name in BLOCK:
                    self.pieces.append((stack[-1][1], None))
                return
            if stack[k][0] in BLOCK and name not in BLOCK:
                return

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Measures of each node, and the hashed tags and attribute tokens of it and of all above it as 0 and 1."""
        n, parent = len(self.tag), self.parent
        own = np.array(self.own, float)
        text, links, tags, blocks, inputs, signs = (np.array(x, float) for x in (own, self.links, self.inline, [1] * n, self.inputs, self.signs))
        depth, index, count, most, second = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            index[i] = count[p]
            count[p] += 1
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for column in (text, links, tags, blocks, inputs, signs):
                column[p] += column[i]
            if text[i] > most[p]:
                most[p], second[p] = text[i], most[p]
            elif text[i] > second[p]:
                second[p] = text[i]
        at = np.maximum(parent, 0)
        lead = text / np.maximum(1, most[at])  # against the largest sibling
        least_lead, before, last = lead.copy(), np.zeros(n), {}
        hashed = np.zeros((n, 2 * BUCKETS), np.uint8)
        for i in range(1, n):
            p = parent[i]
            least_lead[i] = min(lead[i], least_lead[p])
            before[i] = last.get(p, 0.0)
            last[p] = before[i] + text[i]
            for t in (self.tag[i], *self.names[i]):
                hashed[i, bucket(t)] = 1
            hashed[i, BUCKETS:] = np.maximum(hashed[p, BUCKETS:], hashed[i, :BUCKETS])
        after = np.maximum(0, text[at] - own[at] - before - text)
        paragraph = np.array([t in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "td", "dd") for t in self.tag], float)
        heading = np.array([t[0] == "h" and t[1:].isdigit() for t in self.tag], float)
        item = np.array([t in ("li", "ul", "ol", "menu") for t in self.tag], float)
        rest = most[at] - second[at]
        own_columns = [depth, np.log1p(text), text / max(1.0, text[0]), text / (1 + tags + blocks), links / (1 + text), np.log1p(blocks), own / (1 + text), inputs > 0, signs / (1 + text), paragraph, heading, item, count]
        among = [text / (1 + text[at]), lead, least_lead, index, count[at], np.log1p(before), np.log1p(after), np.log1p(rest), lead[at], text[at] / max(1.0, text[0]), links[at] / (1 + text[at]), np.log1p(blocks[at]), paragraph[at], inputs[at] > 0]
        return np.column_stack([*own_columns, *among]).astype(np.float32), hashed

    def labels(self) -> np.ndarray:
        """1 article, 0 not, -1 unknown: what the nearest node with a name that tells says, by tag or tokens; unknown where they contradict each other."""
        told = np.full(len(self.tag), -1)
        for i in range(1, len(self.tag)):
            good = self.tag[i] in KEPT_TAGS or any(t in KEPT_NAMES for t in self.names[i])
            bad = self.tag[i] in DROPPED_TAGS or any(t in DROPPED_NAMES for t in self.names[i])
            above = told[self.parent[i]]
            told[i] = above if good == bad else 0 if bad or above == 0 else 1
        return told

    def truth(self) -> np.ndarray:
        """1 where most of a subtree's text is marked, -1 where it has none."""
        text, marked = np.array(self.own, float), np.array(self.marked, float)
        for i in range(len(self.tag) - 1, 0, -1):
            text[self.parent[i]] += text[i]
            marked[self.parent[i]] += marked[i]
        return np.where(text == 0, -1, (2 * marked >= text).astype(int))

    def weights(self, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What going into each node costs, and what its own text gains."""
        text = np.array(self.own, float)
        for i in range(len(self.tag) - 1, 0, -1):
            text[self.parent[i]] += text[i]
        return np.maximum(0, -odds) * np.log1p(text), np.maximum(0, odds) * np.log1p(np.array(self.own, float))

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Which blocks' own text stays: of all sets of nodes that hold their nodes' parents, the one of most gain less cost; own texts that gain are kept."""
        n = len(self.tag)
        cost, gain = self.weights(odds)
        value = gain - cost
        for i in range(n - 1, 0, -1):
            if value[i] > 0:
                value[self.parent[i]] += value[i]
        open_ = np.zeros(n, bool)
        for i in range(n):
            open_[i] = value[i] > 0 and (i == 0 or open_[self.parent[i]])
        return open_ & (odds > 0)

    def text(self, kept: np.ndarray) -> str:
        lines, now = [], []
        for block, piece in self.pieces:
            if piece is None:
                lines.append(now)
                now = []
            elif kept[block]:
                now.append(piece)
        lines.append(now)
        clean = (_BLANK.sub(" ", html.unescape("".join(x))).strip() for x in lines if x)
        return "\n".join(x for x in clean if x)


class Trees:
    """Gradient-boosted regression trees for the logistic loss, grown level by level on binned features."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature and bin by inner node, value by leaf
        self.start = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.edges)), np.uint8)
        for f, e in enumerate(self.edges):
            out[:, f] = np.searchsorted(e, x[:, f], side="left")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        for f in np.flatnonzero([len(e) == 1 for e in self.edges]):  # rarely set: its quantiles are all alike
            self.edges[f] = np.array([(x[:, f].min() + x[:, f].max()) / 2], x.dtype)
        b = np.ascontiguousarray(self.bins(x).T.astype(np.int32))
        p = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        f, draw = np.full(len(y), self.start), np.random.default_rng(3)
        usable = np.flatnonzero(b.min(1) < b.max(1))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p)
            feature, cut = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, BINS + 1)
            at = np.zeros(len(y), np.int32)
            tried = draw.choice(usable, -(-len(usable) // 2), replace=False) if len(usable) else usable
            for level in range(DEPTH):
                nodes, first = 2**level, 2**level - 1
                gain = np.full(nodes, 1e-6)
                base = at * (BINS + 1)
                for k in tried:
                    key = base + b[k]
                    gl, hl = (np.bincount(key, v, nodes * (BINS + 1)).reshape(nodes, -1).cumsum(1) for v in (g, h))
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gains = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gains[(hl < LEAST_LEAF) | (ht - hl < LEAST_LEAF)] = 0
                    top = gains.argmax(1)
                    better = gains[np.arange(nodes), top] > gain
                    gain = np.where(better, gains[np.arange(nodes), top], gain)
                    feature[first : first + nodes][better] = k
                    cut[first : first + nodes][better] = top[better]
                at = 2 * at + (b[feature[first + at], np.arange(len(y))] > cut[first + at])
            value = RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 1)
            self.trees.append((feature, cut, value))
            f += value[at]
        return self

    def odds(self, measures: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        out = np.full(len(measures), self.start)
        for lo in range(0, len(out), SLICE):
            part = slice(lo, lo + SLICE)
            b = self.bins(np.hstack([measures[part], hashed[part]]).astype(np.float32))
            rows = np.arange(len(b))
            for feature, cut, value in self.trees:
                at = np.zeros(len(b), int)
                for level in range(DEPTH):
                    node = 2**level - 1 + at
                    at = 2 * at + (b[rows, feature[node]] > cut[node])
                out[part] += value[at]
        return out


def bucket(token: str) -> int:
    if token not in _buckets:
        if len(_buckets) > 100_000:
            _buckets.clear()
        _buckets[token] = zlib.crc32(token.encode()) % BUCKETS
    return _buckets[token]


_buckets: dict[str, int] = {}
N_FEATURES = 27 + 2 * BUCKETS


def pick(draw: random.Random, role: str) -> str:
    """Attributes for a container: telling, none, meaningless, or (of the article's) telling and misleading at once."""
    kept, dropped = sorted(KEPT_NAMES), sorted(DROPPED_NAMES)
    way = draw.random()
    if way < 0.3:
        return ""
    if way < 0.5:
        return f' class="{draw.choice("abcdfghjkmx")}{draw.randint(1, 99)} {"".join(draw.choices("bcdfghklmnp", k=4))}"'
    name = draw.choice(kept if role == "article" else dropped)
    if role == "article" and draw.random() < 0.3:
        name = draw.choice([f"{draw.choice(dropped)}-{name}", f"{name} {draw.choice(dropped)}", f"{name}-{draw.choice(dropped)}"])
    return draw.choice([f' class="{name}"', f' id="{name}"', f' class="x {name}-{draw.randint(1, 9)}"'])


def laid_out(draw: random.Random, article: list[str], bits: list[str]) -> str:
    """A page with these article blocks (marked) and other blocks made of `bits`, in a drawn layout."""
    line = lambda: html.escape(draw.choice(bits))
    few = lambda most: "".join(f"<{t}>{line()}</{t}>" for t in [draw.choice(["p", "p", "div", "span"])] * draw.randint(1, most))
    links = lambda: "<ul>" + "".join(f'<li><a href="/{k}">{html.escape(draw.choice(bits)[:24])}</a></li>' for k in range(draw.randint(2, 8))) + "</ul>"

    def other(role: str) -> str:
        body = {"menu": links, "side": lambda: draw.choice([links(), few(2) + links()]), "note": lambda: few(1), "comments": lambda: "".join(f"<div{pick(draw, 'x')}>{few(2)}</div>" for _ in range(draw.randint(1, 4))),
                "form": lambda: few(1) + '<input type="text"><button>x</button>', "foot": lambda: draw.choice([few(1), links() + few(1), "&copy; " + line()])}[role]()
        tag = {"menu": "nav", "side": "aside", "note": "div", "comments": "section", "form": "form", "foot": "footer"}[role] if draw.random() < 0.5 else draw.choice(["div", "div", "section"])
        return f"<{tag}{pick(draw, role)}>{body}</{tag}>"

    blocks = []
    for k, text in enumerate(article):
        tag = "h1" if k == 0 and draw.random() < 0.7 else draw.choice(["p"] * 8 + ["h2", "blockquote", "div"])
        blocks.append(f"<{tag}>{MARK}{html.escape(text)}</{tag}>")
        if draw.random() < 0.06:
            blocks.append(other(draw.choice(["note", "side", "form"])))
    tag = draw.choice(["article", "article", "main", "div", "div", "section"])
    main = f"<{tag}{pick(draw, 'article')}>" + "".join(blocks) + (other(draw.choice(["comments", "form", "note"])) if draw.random() < 0.25 else "") + f"</{tag}>"
    for _ in range(draw.randint(0, 2)):
        main = f"<{draw.choice(['div', 'main', 'section'])}{pick(draw, 'article')}>{main}" + (other("side") if draw.random() < 0.3 else "") + "</div>"
    before = [other(r) for r in draw.sample(["menu", "note", "menu", "side", "form"], draw.randint(0, 3))]
    behind = [other(r) for r in draw.sample(["comments", "side", "form", "foot", "note", "comments", "foot"], draw.randint(0, 4))]
    return "<body>" + "".join([*before, main, *behind]) + "</body>"


def shortened(source: str) -> str:
    """The page with few and short paragraphs, so that little text is seen under all names."""
    draw, left = random.Random(len(source)), [0]
    left[0] = draw.randint(1, 2)

    def cut(m: re.Match) -> str:
        left[0] -= 1
        return "<p>" + " ".join(_TAG.sub(" ", m.group()).split()[: draw.randint(1, 5)]) + "</p>" if left[0] >= 0 else ""

    return re.sub(r"<p\b.*?(?:</p>|(?=<p\b))", cut, source, flags=re.S | re.I)


def examples(source: str) -> Iterator[tuple[Page, np.ndarray, float]]:
    """(page, labels, weight) of a page as it is, of its short form, and of layouts made of its blocks."""
    page = Page(source)
    told = page.labels()
    yield page, told, OWN_WEIGHT
    short = Page(shortened(source))
    yield short, short.labels(), OWN_WEIGHT
    lines: dict[int, str] = {}
    for block, text in page.pieces:
        lines[block] = lines.get(block, "") + (text or "")
    clean = {b: _BLANK.sub(" ", html.unescape(t)).strip() for b, t in lines.items()}
    article = [t for b, t in clean.items() if t and told[b] == 1] or [t for t in clean.values() if len(t) > 80]
    bits = [t[:160] for b, t in clean.items() if t and told[b] == 0] + [x[:120] for t in article for x in re.split(r"(?<=[.!?])\s+", t)[:3]]
    draw = random.Random(zlib.crc32(source.encode()))
    for _ in range(LAYOUTS if article else 0):
        some = draw.sample(article, min(len(article), draw.randint(1, 3))) if draw.random() < 0.3 else article
        page = Page(laid_out(draw, some, bits))
        yield page, page.truth(), 1.0


def train(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_nodes: int = SAMPLE_NODES) -> Trees:
    rows = pages.select(F.col(html_col).alias("html")).filter(F.length("html") > 0)
    n = rows.count()
    share = int(1_000_000 * min(1.0, sample_pages / max(1, n)))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "html"), F.lit(1_000_000)) < share).dropDuplicates(["html"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source in b["html"]:
                for page, y, weight in examples(source):
                    known = np.flatnonzero(y[1:] >= 0) + 1
                    # a page of very many nodes gives some of them, drawn by itself
                    known = np.random.default_rng(len(source)).choice(known, sample_nodes // 100, replace=False) if len(known) > sample_nodes // 100 else known
                    x = np.column_stack([*(f[known] for f in page.features()), y[known], np.full(len(known), weight)])
                    yield pd.DataFrame({"n": [len(known)], "h": [zlib.crc32(source.encode())], "x": [x.astype("<f4").tobytes()]})

    found = stored(drawn.mapInPandas(measure, "n long, h long, x binary"), "page-nodes")
    total = found.agg(F.sum("n")).first()[0] or 0
    kept = found.filter(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_nodes / max(1, total)))).toPandas()["x"]  # bounded by sample_nodes
    got = np.concatenate([np.frombuffer(x, "<f4").reshape(-1, N_FEATURES + 2) for x in sorted(kept)]) if len(kept) else np.zeros((0, N_FEATURES + 2))
    trees = Trees()
    if len(np.unique(got[:, -2])) < 2:  # nothing, or one kind of node only, to tell apart
        trees.edges = [np.zeros(0)] * N_FEATURES
        return trees
    return trees.fit(got[:, :-2], got[:, -2].astype(float), got[:, -1].astype(float))


def extract_pages(pages: list[Page], trees: Trees) -> list[str]:
    """The article text of each page; the trees see the nodes of all pages at once.

    Trees without examples say nothing. Then all stays that the page's own names do not speak against.
    """
    odds, out, at = np.zeros(0), [], 0
    if pages and trees.trees:
        odds = trees.odds(*(np.concatenate(x) for x in zip(*(p.features() for p in pages))))
    for page in pages:
        n = len(page.tag)
        own = odds[at : at + n].copy() if trees.trees else np.where(page.labels() == 0, -1.0, 1.0)
        at += n
        if trees.trees:
            own[0] = 0.0 if n > 1 else 1.0  # a page without elements is its own text
        out.append(page.text(page.decode(own)))
    return out


def extract_all(sources: list[str | None], trees: Trees) -> list[str]:
    """The article text of each source, so many pages at a time as NODES allows."""
    out, pages, nodes = [], [], 0
    for source in sources:
        page = Page(source or "")
        if pages and nodes + len(page.tag) > NODES:
            out += extract_pages(pages, trees)
            pages, nodes = [], 0
        pages.append(page)
        nodes += len(page.tag)
    return out + extract_pages(pages, trees)


def extract(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """pages with _main, the article text of each."""
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, html_col, sample_pages))

    def make():
        trees = shared.value
        return lambda sources: [extract_all(sources, trees)]

    return with_columns(pages, html_col, make, {"_main": "string"})
