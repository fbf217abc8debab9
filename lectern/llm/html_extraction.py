"""Main text of web pages with boosted trees over DOM nodes.

Every block element gets features of its subtree, its siblings, its names and its
place. Boosted trees give each node the odds of being main text, and a pass over the
tree picks the likeliest labels in which nothing is kept under a node that is dropped.
"""

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lectern.llm.boosting import BoostedTrees
from lectern.llm.common import slices, table
from lectern.llm.dom import Tree
from lectern.llm.practice_pages import MARK, NAMES, practice_pages

#: Pages that the trees are fitted on, and about how many nodes of each.
NODES = 40
PRACTICE = 2500

#: Elements that are told apart (fixed values); others share one kind.
KINDS = {t: i for i, ts in enumerate(("p", "h1", "h2 h3 h4 h5 h6", "li dd dt", "ul ol dl menu", "div center", "section", "article", "main", "nav", "aside", "header hgroup", "footer address", "form fieldset", "input button label", "table tbody thead tr", "td th", "blockquote q pre", "figure figcaption", "ins dialog details summary")) for t in ts.split()}
_OTHER = len(KINDS)
_TAG_GROUPS = [("nav", "menu"), ("aside",), ("header", "hgroup"), ("footer", "address"), ("form", "fieldset", "button", "label", "input", "dialog"), ("article", "main")]
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words of names, by kind; those of article names speak for main text.
_GROUPS = ("menu", "header", "footer", "sidebar", "notice", "ad", "form", "comments", "share", "article")
_EXTRA = {
    "menu": "sitemap dropdown tabs pager submenu crumbs nav",
    "header": "navbar brand",
    "footer": "imprint disclaimer terms",
    "sidebar": "rail teaser teasers popular latest tags tagcloud similar suggested",
    "notice": "cookies privacy banner toast announcement paywall notification",
    "ad": "advertising advertorial sponsoring affiliate dfp taboola outbrain adsense adbox",
    "form": "login register poll survey",
    "comments": "commentary respond reactions thread disqus reply",
    "share": "sharing twitter facebook",
    "article": "articlebody post blog paragraph",
}
_DULL = frozenset("site page top main list box section body text bar links link buttons more posts post stories story slot head bottom side message tools content inner x u is open c".split())
_LEXICON: dict[str, int] = {}
for _i, _g in enumerate(_GROUPS):
    for _w in [w for n in NAMES[_g] for w in n.split("-")] + _EXTRA[_g].split():
        if _w not in _DULL or _g == "article" and _w in ("content", "post", "story", "main", "text", "body"):
            _LEXICON.setdefault(_w, _i)

N_FEATURES = 24 + len(_TAG_GROUPS) + 2 * (len(_GROUPS) + 1) + len(_TAG_GROUPS)


@lru_cache(maxsize=50_000)
def _names(attrs: str) -> int:
    """Bits of the name groups that an element's attributes speak of."""
    bits = 1 << len(_GROUPS) if _HIDDEN.search(attrs) else 0
    for m in _ATTR.finditer(attrs):
        for w in _WORD.findall(m[2] or m[3] or m[4] or ""):
            g = _LEXICON.get(w.lower())
            if g is not None:
                bits |= 1 << g
    return bits


_TAG_BITS = {t: 1 << i for i, ts in enumerate(_TAG_GROUPS) for t in ts}


def features(trees: list[Tree]) -> np.ndarray:
    """A row for each node of the trees, one tree after the other; a tree's node 0 is its document."""
    sizes = np.array([len(t.tag) for t in trees])
    base = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    i = np.arange(n)
    page = np.repeat(np.arange(len(trees)), sizes)
    root = base[page]
    parent = np.concatenate([np.array(t.parent) for t in trees]) + root
    up = np.where(i == root, i, parent)
    depth = np.concatenate([np.array(t.depth, float) for t in trees])
    end = np.concatenate([np.array(t.end) for t in trees]) + root
    # the text runs of all trees
    node = np.array([node + b for t, b in zip(trees, base.tolist()) for node, _, _ in t.runs], np.int64)
    stats = np.array([(len(x), link * len(x), x.count(".") + x.count(",") + x.count(":") + x.count(";") + x.count("!") + x.count("?"), x.count(" ") + 1, "©" in x) for t in trees for _, x, link in t.runs], float).reshape(-1, 5)
    own, linked, marks, words, sign = (np.bincount(node, c, minlength=n) for c in stats.T)
    below = lambda x: (c := np.concatenate([[0.0], np.cumsum(x)]))[end] - c[i]
    size, links, punct, signs = below(own), below(linked), below(marks), below(sign)
    tag = [x for t in trees for x in t.tag]
    kind = np.array([KINDS.get(t, _OTHER) for t in tag])
    is_p = (kind == KINDS["p"]).astype(float)
    p_text, p_count = below(own * is_p), below(is_p)
    nodes = end - i
    total = np.maximum(1.0, size[root])
    run = np.concatenate([[0.0], np.cumsum(own)])
    start = (run[i] - run[root]) / total
    # siblings
    child = np.flatnonzero(i != root)
    count = np.maximum(np.bincount(up[child], minlength=n)[up], 1).astype(float)
    mean = np.bincount(up[child], size[child], minlength=n)[up] / count
    alike, before, after = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(child):
        key = up[child] * 64 + kind[child]
        _, inverse, number = np.unique(key, return_inverse=True, return_counts=True)
        alike[child] = number[inverse] / count[child]
        order = child[np.argsort(up[child], kind="stable")]
        same = up[order[1:]] == up[order[:-1]]
        before[order[1:][same]] = size[order[:-1][same]]
        after[order[:-1][same]] = size[order[1:][same]]
    bits = np.array([_names(a) if a else 0 for t in trees for a in t.attrs])
    tags = np.array([_TAG_BITS.get(t, 0) for t in tag])
    bits_up, tags_up = np.zeros(n, np.int64), np.zeros(n, np.int64)
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max()) + 2))
    for a, b in zip(cuts, cuts[1:]):
        here = by_depth[a:b]
        bits_up[here] = bits_up[up[here]] | bits[up[here]]
        tags_up[here] = tags_up[up[here]] | tags[up[here]]
    log = np.log1p
    x = [
        kind, depth, log(own), log(size), size / total, links / np.maximum(size, 1), linked / np.maximum(own, 1), nodes / np.maximum(size, 1) * 100,
        p_count, p_text / np.maximum(size, 1), punct / np.maximum(size, 1) * 100, log(punct), words, signs, start, start + size / total,
        count, alike, log(mean), log(before), log(after), size[up] / total, links[up] / np.maximum(size[up], 1), kind[up],
    ]
    x += [(tags >> g & 1) for g in range(len(_TAG_GROUPS))]
    x += [(bits >> g & 1) for g in range(len(_GROUPS) + 1)] + [(bits_up >> g & 1) for g in range(len(_GROUPS) + 1)] + [(tags_up >> g & 1) for g in range(len(_TAG_GROUPS))]
    return np.stack([np.asarray(c, np.float32) for c in x], axis=1)


#: Elements above the page's blocks; they are never dropped themselves.
_FRAME = frozenset("# html body".split())


def decode(tree: Tree, log_odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept in the likeliest labelling where all above a kept node is kept too."""
    n = len(tree.tag)
    keep, drop = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    keep, drop = keep.tolist(), drop.tolist()
    for v in range(n):
        if tree.tag[v] in _FRAME:
            keep[v], drop[v] = 0.0, -1e9
        elif tree.tag[v] == "head":
            keep[v], drop[v] = -1e9, 0.0
    parent = tree.parent
    for v in range(n - 1, 0, -1):  # children come after their parent
        keep[parent[v]] += max(keep[v], drop[v])
        drop[parent[v]] += drop[v]
    kept = np.zeros(n, bool)
    kept[0] = True
    for v in range(1, n):
        kept[v] = kept[parent[v]] and keep[v] > drop[v]
    return kept


class Extractor:
    def __init__(self, practice: int = PRACTICE):
        x, y, w = [], [], []
        for page in practice_pages(practice):
            tree = Tree(page)
            mark = [1 if f'{MARK}="1"' in a else 0 if f'{MARK}="0"' in a else -1 for a in tree.attrs]
            for v in range(1, len(mark)):  # what has no mark is as what it stands in
                if mark[v] < 0 and tree.tag[v] not in ("html", "body", "head"):
                    mark[v] = mark[tree.parent[v]]
            f = features([tree])
            use = [v for v, m in enumerate(mark) if m >= 0]
            use = use[:: max(1, len(use) // NODES)]
            x.append(f[use])
            y += [mark[v] for v in use]
            w += [1.0 / len(use)] * len(use)  # each page counts alike
        y, w = np.array(y, float), np.array(w)
        self.trees = BoostedTrees.fit(np.concatenate(x), y, w * len(w) / w.sum())

    def extract(self, pages: list[str]) -> list[str]:
        if not pages:
            return []
        trees = [Tree(p) for p in pages]
        sizes = [len(t.tag) for t in trees]
        odds = self.trees.log_odds(features(trees))
        out, at = [], 0
        for t, n in zip(trees, sizes):
            out.append(t.text(decode(t, odds[at : at + n])))
            at += n
        return out


@lru_cache(maxsize=4)
def fitted(practice: int = PRACTICE) -> Extractor:
    """The extractor fitted on so many generated pages; it is the same each time, so a driver fits it once."""
    return Extractor(practice)


def extract_text(pages: DataFrame, html: str = "html", practice: int = PRACTICE) -> DataFrame:
    """pages with columns text (the main text, empty if there is none) and n_chars (its code points).

    A null page counts as empty. Blocks are joined by one space in page order; white space inside a block becomes one
    space. Other columns stay; columns of these names are replaced. The extractor is fitted on `practice` generated
    pages and broadcast (its size does not depend on the data).
    """
    extractor = pages.sparkSession.sparkContext.broadcast(fitted(practice))
    keep = [f for f in pages.schema.fields if f.name not in ("text", "n_chars") or f.name == html]
    out = StructType([*[f for f in keep if f.name != html], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches):
        for batch in slices(batches, html, 1 << 20):
            found = extractor.value.extract(["" if x is None else x for x in batch.column(html).to_pylist()])
            arrays = [batch.column(f.name) for f in keep if f.name != html]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=out.names)

    return pages.select(*[f.name for f in keep]).mapInArrow(run, out)


def query(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
