"""Main text of web pages: boosted trees over DOM nodes and a decoding along the tree.

Each block node gets features of its subtree (density of text, links and punctuation), of its
tag and attribute tokens, its depth, its siblings and its ancestors. Gradient-boosted trees give
the log-odds that the node is part of the article. A dynamic program over the tree then picks
the best consistent labelling: below a node that is left out, everything is left out.

The trees are fitted once on pages that a seeded generator lays out in many ways.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Pages that the training generator makes, and the size of the model.
TRAIN_PAGES, TREES, DEPTH = 300, 20, 4
#: Pages that a task holds parsed at a time.
PAGES_AT_ONCE = 200

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>")
_ATTR = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. (Fallback content of media and formulas is text.)
SILENT = frozenset("script style head title noscript template svg iframe select option textarea button".split())
#: Open elements at most; a deeper one takes the place of the innermost. Tags broken by a quote before quotes are ignored.
MAX_DEPTH, MAX_BROKEN = 512, 50
#: Elements that may stand in a head, whose end tag may be left out: anything else closes it.
HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
RAW = frozenset("script style textarea title".split())
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
BLOCK = frozenset("""html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption
 blockquote pre figure figcaption nav header footer aside form fieldset address details summary hgroup center
 dialog legend menu search dir optgroup listing plaintext xmp frameset noframes""".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption li dt dd summary legend optgroup frameset noframes".split()) | {"hr"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LIMITS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
GOOD = frozenset("article articlebody content contents post entry main story body text prose".split())
BAD = frozenset("""ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside side
 footer header masthead cookie consent notice gdpr popup modal newsletter subscribe signup login form comment comments reply replies
 disqus share sharing social related recommended widget toolbar pager pagination copyright legal tags meta byline search""".split())
KINDS = (("article", "main"), ("p", "pre", "blockquote"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "ul", "ol", "dl", "dt", "dd"),
         ("div", "section"), ("nav", "aside", "footer", "header", "form", "fieldset", "address"), ("table", "tr", "td", "th", "tbody", "thead"))
KIND = {tag: i for i, tags in enumerate(KINDS) for tag in tags}


class Node:
    """A block element; text is what lies in it outside inner blocks, runs are its blocks of text in page order."""

    __slots__ = ("tag", "parent", "kids", "depth", "good", "bad", "runs", "chars", "linked", "marks", "order", "sum")

    def __init__(self, tag: str, parent: Node | None, attrs: str = "", order: int = 0):
        self.tag, self.parent, self.kids, self.runs, self.order = tag, parent, [], [], order
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.linked = self.marks = 0
        tokens = {t for m in _ATTR.findall(attrs) for t in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m.strip("\"'")).lower())} if attrs else set()
        self.good, self.bad = bool(tokens & GOOD), bool(tokens & BAD)
        if parent:
            parent.kids.append(self)


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and the blocks of text in page order as (node, text)."""
    root = Node("root", None)
    stack: list[tuple[str, Node, bool]] = [("root", root, False)]  # open elements: tag, its block, whether silent
    runs: list[tuple[Node, str]] = []
    pieces: list[str] = []
    links = at = n = broken = 0
    last, count = page.rfind(">"), Counter()  # the end of the last tag; open elements by tag

    def flush() -> None:
        nonlocal pieces
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            pieces = []
            if text:
                runs.append((stack[-1][1], text))

    def pop(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            tag, node, _ = stack[-1]
            if tag in BLOCK:
                flush()
            stack.pop()
            count[tag] -= 1
            links -= tag == "a"

    def end_head() -> None:
        k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in ("head", "template")), 0)
        if k and stack[k][0] == "head":
            pop(k)

    def say(text: str) -> None:
        if stack[-1][0] == "head" and text.strip():
            end_head()
        if text and not stack[-1][2]:
            text, node = entities.unescape(text), stack[-1][1]
            pieces.append(text)
            size = len(text.strip())
            node.chars += size
            node.linked += size if links else 0
            node.marks += sum(map(text.count, ".,;:!?"))

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0 or (lt > last and not page.startswith("<!--", lt)):  # what is left has no tag
            say(page[at:])
            break
        m = _TAG.match(page, lt) if broken < MAX_BROKEN or page.startswith("<!", lt) else None
        if not m:
            broken += 1
            m = _LOOSE.match(page, lt)
        if not m:
            say(page[at:lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if count[tag] > 0:
                pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            elif tag == "p":  # stands for an empty paragraph
                flush()
            continue
        if tag == "body" or (stack[-1][0] == "head" and tag not in HEAD):
            end_head()
        if tag == "br":
            say(" ")
        if tag in VOID and tag != "hr":
            continue
        if tag in CLOSES_P and count["p"] > 0:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in ("p", "div", "td", "li", "article", "section", "body")), 0)
            if k and stack[k][0] == "p":
                pop(k)
        if tag == "hr":
            flush()
            continue
        if tag in SAME:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in SAME[tag] or stack[i][0] in LIMITS[tag]), 0)
            if k and stack[k][0] in SAME[tag] and stack[k][0] not in LIMITS[tag]:
                pop(k)
        silent = stack[-1][2] or tag in SILENT
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = len(page) if not end else (page.find(">", end.start()) + 1 or len(page))
            continue
        if len(stack) >= MAX_DEPTH:
            pop(MAX_DEPTH - 1)
            silent = stack[-1][2] or tag in SILENT
        count[tag] += 1
        if tag in BLOCK:
            flush()
            n += 1
            stack.append((tag, Node(tag, stack[-1][1], m.group(3), n), silent))
        else:
            stack.append((tag, stack[-1][1], silent))
        links += tag == "a"
    flush()
    for node, text in runs:
        node.runs.append(text)
    return root, runs


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    """The nodes, parents first, and a row of features for each."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(reversed(node.kids))
    for node in reversed(nodes):  # chars, linked chars, marks, nodes, runs of the subtree
        node.sum = [node.chars, node.linked, node.marks, 1, len(node.runs)]
        for kid in node.kids:
            node.sum = [a + b for a, b in zip(node.sum, kid.sum, strict=True)]
    total, count = max(root.sum[0], 1), len(nodes)
    flags = {id(None): (False, False, False, False)}
    around: dict[int, tuple[int, Counter, int, float]] = {id(None): (1, Counter(root=1), total, total)}
    rows = []
    for node in nodes:
        up, (n_sib, tags, most, all_chars) = flags[id(node.parent)], around[id(node.parent)]
        kind = KIND.get(node.tag, -1)
        flags[id(node)] = (up[0] or kind == 0, up[1] or node.good, up[2] or kind == 5, up[3] or node.bad)
        if node.kids:
            sizes = [k.sum[0] for k in node.kids]
            around[id(node)] = (len(sizes), Counter(k.tag for k in node.kids), max(sizes), sum(sizes))
        chars, linked, marks, size, runs = node.sum
        rows.append((
            kind, node.depth, math.log1p(chars), math.log1p(node.chars), linked / chars if chars else 0.0, marks / chars if chars else 0.0,
            chars / size, chars / max(runs, 1), chars / total, runs, node.good, node.bad, *up, n_sib,
            tags[node.tag] / n_sib, chars / max(most, 1), all_chars / n_sib / 100, node.order / count, math.log1p(size), len(node.kids)))
    x = np.array(rows, np.float32)
    return nodes, np.concatenate([x[:, :1] == np.arange(len(KINDS)), x[:, 1:]], axis=1).astype(np.float32)


class Trees:
    """Boosted trees as arrays, to be applied to many rows at once."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], weights: list[float]):
        self.trees, self.weights = trees, weights

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = np.where(feature[at] < 0, at, np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at]))
            out += weight * value[at]
        return 2 * out


def decode(nodes: list[Node], odds: np.ndarray) -> set[int]:
    """Ids of the kept nodes: the labelling of highest log-odds in which nothing is kept below what is left out.

    A node counts by its own text; one without text counts a little, for its place in the tree.
    """
    gain: dict[int, float] = {}
    for node, o in zip(reversed(nodes), reversed(odds.tolist()), strict=True):
        own = o * (1 + math.log1p(node.chars) if node.runs else 0.25)
        gain[id(node)] = own + sum(max(0.0, gain[id(k)]) for k in node.kids)
    kept: set[int] = set()
    for node in nodes:
        if (node.parent is None or id(node.parent) in kept) and (gain[id(node)] > 0 or node.parent is None):
            kept.add(id(node))
    return kept


def _layout(rng: random.Random) -> str:
    """A page in one of many layouts; ``<!--main-->`` text is marked by the word ``mainword``."""
    word = lambda: "".join(rng.choice(("re", "thi", "on", "er", "sa", "lo", "ti", "en", "ka", "mu")) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    prose = lambda: " ".join(line(rng.randint(1, 14)).capitalize() + "." for _ in range(rng.choice((1, 1, 2, 4, 8))))
    main = lambda t: f"mainword {t}"
    cls = lambda *names: rng.choice(("class", "class", "id")) + '="' + rng.choice(names) + '"'
    links = lambda n: "".join(f'<li><a href="/{word()}">{line(rng.randint(1, 3))}</a></li>' for _ in range(n))
    menu = lambda: rng.choice((f"<nav><ul>{links(rng.randint(2, 9))}</ul></nav>", f"<div {cls('menu', 'navbar', 'top-nav', 'breadcrumbs')}><ul>{links(rng.randint(2, 9))}</ul></div>"))
    advert = lambda: rng.choice((f"<div {cls('ad', 'ads', 'advert', 'sponsored', 'promo-box', 'banner')}>{rng.choice((prose(), '<p>' + prose() + '</p>', line(5)))}</div>",
                                 f"<aside {cls('ad', 'promo', 'sponsor')}><p>{prose()}</p></aside>"))
    notice = lambda: f"<div {cls('cookie-notice', 'cookie-banner', 'consent', 'notice', 'gdpr-popup')}><p>{prose()}</p></div>"
    form = lambda: f"<form {cls('signup', 'newsletter', 'search', 'login')}><p>{line(4)}</p><label>{line(2)}</label><input><button>{word()}</button></form>"
    side = lambda: rng.choice(("<aside>{}</aside>", "<div class=\"sidebar\">{}</div>", "<div id=\"right-sidebar\">{}</div>")).format(
        f"<h3>{line(2)}</h3>" + rng.choice((f"<ul>{links(5)}</ul>", f"<p>{prose()}</p>", f"<p>{prose()}</p><p>{prose()}</p>")))
    foot = lambda: rng.choice(("<footer>{}</footer>", "<div class=\"footer\">{}</div>", "<div id=\"page-footer\">{}</div>")).format(
        rng.choice((f"&copy; {word()} &middot; {prose()}", f"<p>{prose()}</p>", f"<ul>{links(4)}</ul><p>{line(6)}</p>")))
    head = lambda: rng.choice((f"<header><a href=\"/\">{line(2)}</a></header>", f"<header><h2>{line(3)}</h2><p>{line(6)}</p></header>", f"<div {cls('header', 'masthead')}><p>{line(4)}</p></div>"))
    remarks = lambda: rng.choice(("<section class=\"comments\">{}</section>", "<div id=\"comments\">{}</div>", "<ol class=\"comment-list\">{}</ol>")).format(
        f"<h3>{line(2)}</h3>" * rng.randint(0, 1) + "".join(rng.choice((f"<div class=\"comment\"><p>{prose()}</p></div>", f"<li><p>{prose()}</p></li>", f"<p>{prose()}</p>")) for _ in range(rng.randint(1, 5))))
    para = lambda: rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>",
                               "<p>{} <a href=\"/x\">" + line(2) + "</a></p>", "<p><em>{}</em></p>")).format(main(prose()))
    body = [f"<h1>{main(line(rng.randint(1, 9)))}</h1>"] * (rng.random() < 0.9) + [para() for _ in range(rng.choice((0, 1, 3, 6, 12, 20)))]
    if rng.random() < 0.35:
        body.insert(rng.randint(0, len(body)), rng.choice((advert, form, lambda: f"<div {cls('share', 'social-share', 'related')}><ul>{links(4)}</ul></div>"))())
    if rng.random() < 0.15:
        body.append(remarks())
    shell = rng.choice(("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class=\"content\">{}</div>",
                        "<div id=\"main-content\"><div>{}</div></div>", "<div class=\"post-body\">{}</div>", "<div class=\"entry\">{}</div>", "<section>{}</section>", "<div>{}</div>"))
    parts = [x() for x in (head, menu, notice, advert) if rng.random() < 0.5] + [shell.format("".join(body))] + [
        x() for x in (remarks, side, advert, form, foot, notice) if rng.random() < 0.4]
    if rng.random() < 0.2:
        parts.insert(1, side())
    page = "".join(parts)
    return f"<html><head><title>{line(3)}</title></head><body>{rng.choice(('{}', '<div class=\"wrapper\">{}</div>', '<div><div id=\"page\">{}</div></div>')).format(page)}</body></html>"


def training_rows(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of generated pages: a node is positive if most of its text is main text."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(TRAIN_PAGES):
        root, _ = parse(_layout(rng))
        nodes, x = features(root)
        share: dict[int, list[int]] = {}
        for node in reversed(nodes):
            mine = [sum(len(r) for r in node.runs), sum(len(r) for r in node.runs if "mainword" in r)]
            share[id(node)] = [a + sum(share[id(k)][i] for k in node.kids) for i, a in enumerate(mine)]
        keep = [i for i, n in enumerate(nodes) if share[id(n)][0]]
        xs.append(x[keep])
        ys.append(np.array([2 * share[id(nodes[i])][1] > share[id(nodes[i])][0] for i in keep], float))
    return np.concatenate(xs), np.concatenate(ys)


def fit(spark: SparkSession, seed: int = 11) -> Trees:
    """Fit the boosted trees on the generated pages and read them out as arrays."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    x, y = training_rows(seed)
    rows = spark.createDataFrame([(float(b), Vectors.dense(a.tolist())) for a, b in zip(x, y, strict=True)], ["label", "features"]).coalesce(2)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, cacheNodeIds=False).fit(rows)
    trees = []
    for tree in model.trees:
        out: list[list[float]] = []

        def walk(node, out=out) -> int:
            at = len(out)
            out.append([-1, 0.0, at, at, node.prediction()])
            if node.subtreeDepth() > 0:
                out[at][0], out[at][1] = node.split().featureIndex(), node.split().threshold()
                out[at][2] = walk(node.leftChild())
                out[at][3] = walk(node.rightChild())
            return at

        walk(tree._call_java("rootNode"))
        a = np.array(out)
        trees.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return Trees(trees, list(model.treeWeights))


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page: its blocks in page order, one to a line. The trees see all pages at once."""
    parsed = [parse(page or "") for page in pages]
    seen = [features(root) for root, _ in parsed]
    odds = trees.log_odds(np.concatenate([x for _, x in seen])) if seen else np.empty(0)
    out, at = [], 0
    for (_, runs), (nodes, _) in zip(parsed, seen, strict=True):
        kept = decode(nodes, odds[at:at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(text for node, text in runs if id(node) in kept))
    return out


def extract(pages: DataFrame, *, trees: Trees | None = None) -> DataFrame:
    """page_id, url and text of every row of ``pages`` (page_id, url, html).

    White space inside a block becomes one space; blocks are joined by ``\\n``; null, empty and
    textless pages give an empty text. Each row is handled alone, so repeated rows give repeated
    results, and an empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    trees = trees or fit(spark)
    shared = spark.sparkContext.broadcast((trees.trees, trees.weights))  # plain arrays
    rows = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees(*shared.value)
        for batch in (b.slice(i, PAGES_AT_ONCE) for b in batches for i in range(0, b.num_rows, PAGES_AT_ONCE)):
            texts = main_texts(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
