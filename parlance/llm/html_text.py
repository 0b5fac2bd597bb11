"""Main text of web pages: boosted trees over DOM nodes and a consistent choice along each path.

Each page is read into its block elements (inline elements belong to the block around them). A node's
features are its tag, groups of the words in its class, id and role (its own and its ancestors'), sizes
and densities of its subtree (text, links, marks, sentence ends, list items, form fields), depth, place
and its neighbours' sizes. Gradient-boosted trees give each node its log odds of being main text.

Decoding walks the tree once from the leaves: along every path from the root, nodes are first outside,
then inside, then outside again (an advert inside an article), never more. Entering costs ``ENTER``,
leaving costs ``LEAVE``, and the choice with the largest sum of log odds wins, so no node contradicts
its ancestors or descendants.

The trees are fitted on at most ``SAMPLE`` pages of the table, in the order of a hash, whose landmarks
(article, main; nav, header, footer, aside, form) label them, and on ``MADE`` pages composed of their
words in layouts with other elements and class names. The text of every page is read whole.

Defined results
    null or empty html, pages without main text: an empty text (text outside any block element belongs to
    the root, which is never inside). Unclosed paragraphs and list items: closed as HTML says; stray end
    tags are skipped. ``<br>`` is white space. A tag without end is text; after it quotes in tags are no
    longer read. null url or page_id, repeated rows: kept as they are. Extra columns are never read. Empty
    table: empty result. A table without pages with landmarks: fitted on composed pages alone.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import staged, unstage

SAMPLE, MADE, SEED = 150, 1000, 7
TREES, DEPTH = 40, 5
ENTER, LEAVE = 1.0, 1.0

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style head title noscript template svg math iframe object canvas audio video select option button textarea datalist map".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title iframe noscript".split())
#: What an opening tag closes if it is the open element.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Tags that are features of their own, alone or together.
TAGS = [{"p"}, {"div"}, {"article"}, {"main"}, {"section"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"},
        {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"table", "tbody", "tr", "td", "th"}, {"blockquote", "pre", "figure", "figcaption"}]
#: Words in class, id and role, by what they say of a node.
WORDS = {
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs toc tabs pagination pager topnav subnav links toolbar",
    "header": "header head masthead topbar banner logo branding hero",
    "footer": "footer foot bottom copyright legal colophon imprint credits",
    "side": "sidebar side rail aside widget widgets column secondary complementary",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense dfp teaser outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay paywall newsletter subscribe subscription signup disclaimer warning privacy",
    "form": "form search login signin register contact input field",
    "comment": "comment comments commentlist discussion disqus replies reply respond reviews feedback thread guestbook",
    "share": "share sharing social follow facebook twitter tweet tags tagcloud related recommended recommendations more popular trending similar",
    "main": "article content contents main post entry story body text page maincontent articlebody postbody prose document",
}
GROUP = {word: i for i, words in enumerate(WORDS.values()) for word in words.split()}

NAME = re.compile(r"[A-Za-z][^\s/>]*")
QUOTED = re.compile(r"""(?:[^>"']|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCE = re.compile(r"[.!?…](?:\s|$)")


class Page:
    """Block nodes in preorder (0 is the root) and the pieces of text, each with its node and its block."""

    __slots__ = ("tag", "parent", "end", "depth", "groups", "mark", "fields", "links", "pieces")

    def __init__(self, text: str):
        self.tag, self.parent, self.end, self.depth, self.groups, self.mark, self.fields, self.links = ["#"], [-1], [0], [0], [0], [None], [0], [0]
        self.pieces: list[tuple[int, int, str, bool]] = []
        self._read(text)

    def _read(self, s: str) -> None:
        open_, node, block, at, n, skipped, anchor, quotes = [("#", 0)], 0, 0, 0, len(s), 0, 0, True
        last = s.rfind(">")

        def close(upto: int) -> None:
            nonlocal node, block
            while len(open_) > upto:
                _, v = open_.pop()
                if v != open_[-1][1]:
                    self.end[v] = len(self.tag)
                    block += 1
            node = open_[-1][1]

        while at < n:
            lt = s.find("<", at)
            if lt < 0 or lt > last:
                lt = n
            if lt > at and not skipped:
                self.pieces.append((node, block, entities.unescape(s[at:lt]), anchor > 0))
            if lt == n:
                break
            if s.startswith("<!--", lt):
                stop = s.find("-->", lt + 4)
                at = n if stop < 0 else stop + 3
                continue
            ends = s.startswith("/", lt + 1)
            name = NAME.match(s, lt + 1 + ends)
            if not name:
                if s[lt + 1 : lt + 2] in ("!", "?", "/"):
                    at = s.find(">", lt) + 1
                else:
                    if not skipped:
                        self.pieces.append((node, block, "<", anchor > 0))
                    at = lt + 1
                continue
            body = QUOTED.match(s, name.end()) if quotes else None
            if body is None:
                quotes = False
                stop = s.find(">", name.end()) + 1
            else:
                stop = body.end()
            at, tag = stop, name[0].lower()
            if ends:
                if tag in SKIPPED:
                    skipped = max(0, skipped - 1)
                elif tag == "a":
                    anchor = 0
                elif tag not in INLINE and not skipped:
                    for i in range(len(open_) - 1, 0, -1):
                        if open_[i][0] == tag:
                            close(i)
                            break
                    else:
                        block += 1
                continue
            if tag in VOID:
                if not skipped:
                    if tag in ("br", "hr"):
                        self.pieces.append((node, block, " ", False))
                        block += tag == "hr"
                    self.fields[node] += tag == "input"
                continue
            if tag in SKIPPED:
                self.fields[node] += tag in ("button", "select", "textarea")
                if s[stop - 2] == "/":
                    continue
                if tag in RAW:
                    found = re.compile(f"</{tag}", re.I).search(s, stop)
                    at = n if found is None else s.find(">", found.end()) + 1 or n
                else:
                    skipped += 1
                continue
            if skipped:
                continue
            if tag in INLINE:
                if tag == "a":
                    anchor = 1
                    self.links[node] += 1
                continue
            if open_[-1][0] == "p" or open_[-1][0] in CLOSES.get(tag, ()):
                close(len(open_) - 1)
            elif tag == "tr" and len(open_) > 2 and open_[-2][0] == "tr":
                close(len(open_) - 2)
            groups, mark = 0, None
            for key, *value in ATTRIBUTE.findall(s, name.end(), stop):
                value = "".join(value)
                if key == "data-y":
                    mark = int(value)
                else:
                    for word in TOKEN.findall(value):
                        groups |= 1 << GROUP[word.lower()] if word.lower() in GROUP else 0
            block += 1
            self.tag.append(tag)
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
            self.groups.append(groups)
            self.mark.append(mark)
            self.fields.append(0)
            self.links.append(0)
            self.end.append(0)
            node = len(self.tag) - 1
            open_.append((tag, node))
        close(1)
        self.end = [e or len(self.tag) for e in self.end]


def features(pages: list[Page]) -> np.ndarray:
    """One row per node of all pages, in preorder."""
    sizes = np.array([len(p.tag) for p in pages])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = int(sizes.sum())
    flat = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.int64)
    parent, end, depth, groups = flat("parent"), flat("end") + first, flat("depth"), flat("groups")
    root = parent < 0
    parent = np.where(root, 0, parent) + first
    own = np.zeros((n, 6))  # letters, letters in links, words, sentence ends, blocks of text, copyright signs
    base = 0
    for p in pages:
        for v, _, text, link in p.pieces:
            size = len(text.strip())
            if size:
                row = own[base + v]
                row[0] += size
                row[1] += size if link else 0
                row[2] += text.count(" ") + 1
                row[3] += len(SENTENCE.findall(text))
                row[4] += 1
                row[5] += "©" in text
        base += len(p.tag)
    tags = np.array([[t in s for s in TAGS] for t in {t: 0 for p in pages for t in p.tag}], float)
    names = {t: i for i, t in enumerate({t: 0 for p in pages for t in p.tag})}
    tag = np.array([names[t] for p in pages for t in p.tag])
    hot = tags[tag]
    more = np.stack([np.ones(n), flat("links"), flat("fields"), hot[:, 0], hot[:, 11], hot[:, 12] + hot[:, 13]], 1)
    total = np.concatenate([own, more], 1)
    cum = np.concatenate([np.zeros((1, total.shape[1])), np.cumsum(total, 0)])
    here = np.arange(n)
    sub = cum[end] - cum[here]
    before = cum[here] - cum[first]
    page = cum[np.append(np.cumsum(sizes), 0)[np.repeat(np.arange(len(pages)), sizes)]] - cum[first]
    above, hot_above = np.zeros(n, np.int64), np.zeros_like(hot)
    order = np.argsort(depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        if depth[level[0]]:
            above[level] = above[parent[level]] | groups[parent[level]]
            hot_above[level] = np.maximum(hot_above[parent[level]], hot[parent[level]])
    bits = lambda g: ((g[:, None] >> np.arange(len(WORDS))) & 1).astype(float)
    # siblings: nodes of a parent in order
    by = np.lexsort((here, parent + root * (n + here)))
    same = np.append(False, (parent[by][1:] == parent[by][:-1]) & ~root[by][1:] & ~root[by][:-1])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    place, prev, after = np.empty(n), np.zeros(n), np.zeros(n)
    place[by] = np.arange(n) - start
    prev[by[1:]] = np.where(same[1:], sub[by[:-1], 0], 0)
    after[by[:-1]] = np.where(same[1:], sub[by[1:], 0], 0)
    kids = np.bincount(parent[~root], minlength=n).astype(float)
    part = lambda a, b: a / np.maximum(b, 1)
    shape = np.stack([
        np.log1p(sub[:, 0]), np.log1p(own[:, 0]), part(sub[:, 1], sub[:, 0]), part(sub[:, 2], sub[:, 4]), part(100 * sub[:, 3], sub[:, 0]), part(sub[:, 6], sub[:, 0]), part(sub[:, 0], page[:, 0]),
        part(before[:, 0], page[:, 0]), part(before[:, 0] + sub[:, 0], page[:, 0]), np.log1p(sub[:, 9]), np.log1p(sub[:, 10]), np.log1p(sub[:, 8]), np.log1p(sub[:, 7]), sub[:, 5] > 0, np.log1p(sub[:, 11]),
        depth, place, np.log1p(kids[parent]), np.log1p(prev), np.log1p(after), np.log1p(sub[parent, 0]), part(sub[parent, 1], sub[parent, 0]), part(100 * sub[parent, 3], sub[parent, 0]), np.log1p(sub[parent, 9]),
        part(sub[:, 0], sub[parent, 0]),
    ], 1)
    return np.concatenate([hot, hot_above, bits(groups), bits(above), shape], 1)


class Trees:
    """A fitted ensemble as arrays: feature (-1: leaf), threshold, children and value of each node."""

    def __init__(self, model):
        self.trees = []
        for tree, weight in zip(model.trees, model.treeWeights):
            rows: list[list] = []

            def walk(node, rows=rows, weight=weight) -> int:
                i = len(rows)
                rows.append([-1, 0.0, i, i, weight * node.prediction()])
                if node.subtreeDepth() > 0:
                    split = node.split()
                    rows[i][:2] = [split.featureIndex(), split.threshold()]
                    rows[i][2] = walk(node.leftChild())
                    rows[i][3] = walk(node.rightChild())
                return i

            walk(tree._java_obj.rootNode())
            self.trees.append([np.array(c) for c in zip(*rows)])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, f] <= threshold[at], left[at], right[at]))
            out += value[at]
        return 2 * out


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes are inside: the best choice that goes in at most once and out at most once on every path."""
    n, parent = len(page.tag), page.parent
    odds = odds.tolist()
    inside, best, sum_best = odds[:], [0.0] * n, [0.0] * n
    for v in range(n - 1, 0, -1):
        best[v] = max(inside[v] - ENTER, sum_best[v])
        u = parent[v]
        inside[u] += max(inside[v], -LEAVE)
        sum_best[u] += best[v]
    state = [0] * n  # 0 before, 1 inside, 2 after
    for v in range(1, n):
        u = state[parent[v]]
        if u == 0:
            state[v] = 1 if inside[v] - ENTER > sum_best[v] else 0
        else:
            state[v] = 1 if u == 1 and inside[v] >= -LEAVE else 2
    return np.array(state) == 1


def main_text(page: Page, inside: np.ndarray) -> str:
    out, block, parts = [], None, []
    for v, b, text, _ in page.pieces:
        if b != block:
            out.append("".join(parts))
            block, parts = b, []
        if inside[v]:
            parts.append(text)
    out.append("".join(parts))
    return "\n".join(t for t in (" ".join(x.split()) for x in out) if t)


def landmarks(page: Page) -> list[int] | None:
    """Labels of the nodes by landmark elements; None for a page without article or main."""
    if not {"article", "main"} & set(page.tag):
        return None
    out = [0] * len(page.tag)
    for v in range(1, len(page.tag)):
        t, inside = page.tag[v], out[page.parent[v]]
        if t in ("article", "main"):
            out[v] = 1
        elif inside and t not in ("nav", "header", "footer", "aside", "form") and not page.groups[v] & 0b111111111:
            out[v] = 1
    return out


def composed(texts: list[str], rng: random.Random) -> str:
    """A page in a layout of its own; data-y marks where main text begins (1) and ends (0)."""
    words = lambda a, b: " ".join(rng.choice(rng.choice(texts).split() or ["text"]) for _ in range(rng.randint(a, b)))
    prose = lambda: entities.escape(rng.choice(texts))
    short = lambda: entities.escape(". ".join(words(4, 14).capitalize() for _ in range(rng.randint(1, 4))) + ".")
    link = lambda: f'<a href="/{rng.randint(1, 999)}">{entities.escape(words(1, 4))}</a>'

    def tagged(group: str, tags: str = "div", mark: int | None = 0, tag_words: bool = True) -> tuple[str, str]:
        tag = rng.choice(tags.split())
        word = rng.choice(WORDS[group].split())
        word = rng.choice([word, f"{word}-{rng.choice(['box', 'wrap', 'area', 'inner', 'list', 'block'])}", f"site-{word}", f"{word} c{rng.randint(1, 99)}"])
        named = tag_words and (tag in ("div", "section", "ul", "ol", "p", "td") or rng.random() < 0.3)
        attr = f' {rng.choice(["class", "class", "id"])}="{word}"' if named else ""
        return f"<{tag}{attr}{'' if mark is None else f' data-y={mark}'}>", f"</{tag}>"

    def wrap(group: str, tags: str, inner: str, mark: int | None = 0) -> str:
        a, b = tagged(group, tags, mark)
        return a + inner + b

    links = lambda a, b: "".join(f"<li>{link()}</li>" for _ in range(rng.randint(a, b)))
    menu = lambda: wrap("menu", "nav nav div ul", f"<ul>{links(2, 12)}</ul>" if rng.random() < 0.7 else " | ".join(link() for _ in range(rng.randint(2, 9))))
    title = entities.escape(words(2, 10))
    head = lambda: wrap("header", "header header div", rng.choice([f"<h1>{entities.escape(words(1, 3))}</h1><p>{short()}</p>", link() + menu(), f"<div>{short()}</div>"]))
    ad = lambda: wrap("ad", "div div aside section p", rng.choice([short(), f"<p>{short()}</p>", link() + " " + short(), prose()]))
    notice = lambda: wrap("notice", "div div section aside p", rng.choice([f"<p>{short()}</p><button>{words(1, 2)}</button>", short() + link(), f"<h3>{entities.escape(words(1, 3))}</h3><p>{prose()}</p>"]))
    form = lambda: wrap("form", "form form div", f"<label>{entities.escape(words(1, 4))}</label><input name=q><p>{short()}</p><button>Go</button>")
    side = lambda: wrap("side", "aside aside div section", "".join(rng.choice([f"<h3>{entities.escape(words(1, 3))}</h3><ul>{links(2, 8)}</ul>", f"<p>{short()}</p>", f"<div><p>{prose()}</p></div>", ad()]) for _ in range(rng.randint(1, 3))))
    share = lambda: wrap("share", "div ul section aside", rng.choice([f"<ul>{links(2, 6)}</ul>", " ".join(link() for _ in range(4)), f"<h3>{entities.escape(words(1, 3))}</h3>" + "".join(f"<p>{link()} {short()}</p>" for _ in range(3))]))

    def comments() -> str:
        one = lambda: wrap("comment", "div div li article", rng.choice([f"<p>{prose()}</p>", f"<b>{entities.escape(words(1, 2))}</b> {short()}", f"<div>{entities.escape(words(1, 2))}</div><p>{short()}</p><p>{prose()}</p>"]))
        return wrap("comment", "section div div ol", f"<h3>{entities.escape(words(1, 2))}</h3>" + "".join(one() for _ in range(rng.randint(1, 5))))

    foot = lambda: wrap("footer", "footer footer div", rng.choice([f"&copy; {entities.escape(words(1, 3))} &middot; {short()}", f"<p>&copy; {short()}</p><ul>{links(2, 6)}</ul>", f"<div>{links(3, 5)}</div><p>{short()}</p>"]))

    def article() -> str:
        open_, close = rng.choice([("<p>", "</p>"), ("<p>", ""), ("<p>", "</p>"), ("<div>", "</div>")])
        parts = [f"<h1>{title}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            parts.append(rng.choice([open_ + prose() + close] * 7 + [open_ + short() + close] * 2 + [f"<h2>{entities.escape(words(1, 6))}</h2>", f"<ul><li>{short()}</li><li>{prose()}</li></ul>", f"<blockquote><p>{prose()}</p></blockquote>",
                                     f"<p>{short()} {link()} {prose()}</p>", f"<p><b>{entities.escape(words(1, 5))}<br>", f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", f"<section><h2>{entities.escape(words(1, 4))}</h2><p>{prose()}</p></section>"]))
        for extra in (ad, share, comments, notice, form, menu, side):
            if rng.random() < 0.12:
                parts.insert(rng.randint(0, len(parts)), extra())
        inner = "".join(parts)
        kind = rng.random()
        if kind < 0.35:
            return f"<article data-y=1>{inner}</article>"
        if kind < 0.5:
            return f"<main data-y=1>{inner}</main>"
        if kind < 0.8:
            return wrap("main", "div div section td", inner, 1)
        if kind < 0.9:
            return f"<div data-y=1>{inner}</div>"
        return wrap("main", "main div", f"<div>{inner}</div>", 1)

    top = [f() for f, p in ((notice, 0.3), (head, 0.6), (menu, 0.7), (ad, 0.4)) if rng.random() < p]
    rng.shuffle(top)
    middle = [f() for f, p in ((side, 0.4), (ad, 0.2)) if rng.random() < p] + [article()]
    if rng.random() < 0.5:
        middle.reverse()
    if rng.random() < 0.3:
        middle = [f'<div class="{rng.choice(["wrapper", "container", "row", "layout", "page", "content"])}">' + "".join(middle) + "</div>"]
    tail = [f() for f, p in ((share, 0.25), (comments, 0.35), (side, 0.2), (form, 0.2), (ad, 0.2), (notice, 0.15), (foot, 0.8)) if rng.random() < p]
    return f"<html><head><title>{title}</title><style>p{{}}</style></head><body>{''.join(top + middle + tail)}</body></html>"


def marks(page: Page) -> list[int]:
    out = [0] * len(page.tag)
    for v in range(1, len(page.tag)):
        out[v] = out[page.parent[v]] if page.mark[v] is None else page.mark[v]
    return out


def training(htmls: list[str], made: int = MADE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of given pages with landmarks and of composed ones."""
    pages, labels, texts = [], [], []
    for h in htmls:
        page = Page(h)
        y = landmarks(page)
        if y is not None:
            pages.append(page)
            labels += y
            texts += [t for t in main_text(page, np.array(y) == 1).split("\n") if len(t) > 40]
    rng = random.Random(seed)
    texts = texts or ["A first sentence of a page that has no words of its own, made to fit. A second sentence follows, with a few more words.", "Another paragraph, shorter than the first."]
    for _ in range(made):
        page = Page(composed(texts, rng))
        pages.append(page)
        labels += marks(page)
    return features(pages), np.array(labels, float)


def fit(pages: DataFrame, sample: int = SAMPLE, made: int = MADE) -> Trees:
    """Trees fitted on at most ``sample`` pages, in the order of a hash of page_id, and ``made`` composed ones."""
    spark = pages.sparkSession
    # only hashes of ids are sorted; of pages with equal hashes one counts
    key = F.xxhash64("page_id")
    chosen = pages.where("html IS NOT NULL").select(key.alias("key")).orderBy("key").limit(sample).distinct().collect()
    got = pages.where(key.isin([r.key for r in chosen])).groupBy(key.alias("key")).agg(F.min("html").alias("html")).orderBy("key").collect() if chosen else []
    x, y = training([r.html for r in got], made)
    rows = pa.table({"x": pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64())), "label": y})
    data = staged(spark.createDataFrame(rows).select(array_to_vector("x").alias("features"), "label").coalesce(2), "training")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, cacheNodeIds=False).fit(data)
    trees = Trees(model)
    unstage(data)
    return trees


def texts_of(htmls: list[str | None], trees: Trees) -> list[str]:
    pages = [Page(h or "") for h in htmls]
    odds = trees.log_odds(features(pages)) if pages else np.zeros(0)
    out, at = [], 0
    for page in pages:
        out.append(main_text(page, decode(page, odds[at : at + len(page.tag)])))
        at += len(page.tag)
    return out


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select("page_id", "url", "html")
    trees = trees or fit(rows)
    kinds = [to_arrow_type(rows.schema[c].dataType) for c in ("page_id", "url")]
    schema = pa.schema([("page_id", kinds[0]), ("url", kinds[1]), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts_of(b.column(2).to_pylist(), trees), pa.string())], schema=schema)

    ddl = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string"
    return rows.mapInArrow(run, ddl).withColumn("n_chars", F.length("text").cast("long"))
