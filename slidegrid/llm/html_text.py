"""Main text of web pages by gradient-boosted trees over DOM nodes.

The trees are trained here, by Spark ML, on the nodes of a bounded sample of the given pages (TRAIN_PAGES of under
TRAIN_CHARS characters; longer pages are extracted, not learned from) and of a few written-out layouts. A node's label comes from what the markup says outright: text inside article or main is main
text, except within nav, header, footer, aside, form and blocks whose attributes name adverts, notices or comments. To
learn layouts without such tags, each sampled page also trains in varied forms, in which the telling tags and names
are replaced and further boilerplate is put in. Features are subtree density, attribute tokens, depth, link share,
punctuation, sibling statistics and the same of what stands above (dom.Page.features). Decoding maximises the joint
likelihood under the rule that a node below dropped ones is dropped, so ancestor and descendant never contradict.

Cases: null and empty pages give an empty text; text without any tag is one block; unclosed and stray tags are repaired
as browsers do in the common cases; a page costs time linear in its length, however deep its elements stand; repeated rows are extracted each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, pick, stored
from .dom import Page

TRAIN_PAGES, TRAIN_CHARS, ROUNDS, DEPTH, STEP = 300, 200_000, 24, 4, 0.3
OUT = "page_id long, url string, text string, n_chars long"

_FILL = "People met on the old bridge, spoke of the harvest, and went home late."
#: Layouts that a sample may lack; {0} is text.
LAYOUTS = (
    "<html><head><title>{0}</title></head><body><header><div class='logo'>Site</div><nav><a href='/'>Home</a> <a href='/b'>News</a></nav></header><main><article><h1>{0}</h1><p>{0}</p><p>{0} {0}</p><form><label>Mail</label><button>Send</button></form></article><aside class='sidebar'><p>{0}</p></aside><section class='comments'><h3>Comments</h3><div class='comment'><p>{0}</p></div></section></main><footer>Rights</footer></body></html>",
    "<div class='cookie-notice'>{0}</div><div id='content'><article><h1>{0}</h1><p>{0}</p><ul><li>{0}</li><li>{0}</li></ul><blockquote>{0}</blockquote><div class='ad'>{0}</div><p>{0}</p><div class='related'><a href='x'>{0}</a></div></article></div><div class='footer'>{0}</div>",
    "<html><body><article><p>{0}</p></article></body></html>",
    "<html><body><p>{0}</p><p>{0}</p></body></html>",
    "<html><body><article><h1>{0}</h1><div><p>{0}</p><p>{0}</p></div></article></body></html>",
    "<html><body><div class='menu'><a href='/'>Home</a></div><article><div class='body'><h2>{0}</h2><div><p>{0}</p><p>{0}</p><p>{0}</p></div></div></article><div class='footer'>Rights</div></body></html>",
    "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><main><h1>{0}</h1><p>{0}</p><table><tr><th>Year</th><th>Yield</th></tr><tr><td>1901</td><td>{0}</td></tr></table><p>{0}</p><dl><dt>Term</dt><dd>{0}</dd></dl></main><footer>Rights</footer></body></html>",
    "<html><body><article><h1>{0}</h1><section class='comments-on-law'><h2>{0}</h2><p>{0}</p></section><section id='notes-about-search-engines'><p>{0}</p><figure><figcaption>{0}</figcaption></figure></section><table class='data'><tbody><tr><td>{0}</td><td>12</td></tr></tbody></table></article><div class='comments'><p>{0}</p></div></body></html>",
)
_TELLING = frozenset("nav header footer aside form button fieldset menu head".split())


def labels(page: Page) -> np.ndarray:
    """1 for nodes that hold main text, 0 for others, -1 where the markup does not tell."""
    nodes = page.nodes
    inside, outside = [False] * len(nodes), [False] * len(nodes)
    for k, x in enumerate(nodes[1:], 1):
        outside[k] = outside[x.parent] or x.tag in _TELLING or x.hidden or x.bad > 0 and x.tag not in ("article", "main", "body")
        inside[k] = (inside[x.parent] or x.tag in ("article", "main")) and not outside[k]
    if not any(x.tag in ("article", "main") for x in nodes):
        return np.array([0 if o else -1 for o in outside])
    out = np.array(inside, int)
    for k in range(len(nodes) - 1, 0, -1):
        if out[k] == 1:
            out[nodes[k].parent] = 1  # what holds main text is on its way
    return out


_BAD_NAMES = ("comments", "sidebar", "ad", "advert banner", "cookie-notice", "related", "share-bar", "newsletter", "menu", "footer")
_GOOD_NAMES = ("content", "post", "entry-content", "article-body", "main", "story", "")


def varied(html: str, k: int, seed: int) -> tuple[str, str]:
    """(html to label, html to learn from): the same nodes, in the second without the tags and names that tell."""
    rng = np.random.default_rng([seed & 0x7FFFFFFF, k])
    choose = lambda xs: xs[int(rng.integers(len(xs)))]
    words = re.sub(r"<[^>]*>", " ", html).split()
    piece = lambda: " ".join(words[(at := int(rng.integers(max(1, len(words))))) : at + int(rng.integers(5, 60))]).replace("<", "")
    extra = [f"<aside><h3>{piece()}</h3><p>{piece()}</p></aside>", f"<section class='comments'><h2>{piece()[:20]}</h2><div class='comment'><p>{piece()}</p></div><div class='comment'><p>{piece()}</p></div></section>", f"<form><p>{piece()}</p><button>{piece()[:9]}</button></form>", f"<div class='notice'>{piece()}</div>"]
    told = html
    if rng.random() < 0.3:
        cells = "".join(f"<tr><td>{piece()[:30]}</td><td>{piece()[:30]}</td></tr>" for _ in range(int(rng.integers(1, 5))))
        told = told.replace("</article>", f"<table>{cells}</table></article>", 1)
    if rng.random() < 0.3:
        told = re.sub(r"(<article\b[^>]*>)", r"\1<div>", told, count=1).replace("</article>", "</div></article>", 1)
    for mark, where in (("</article>", 0), ("<footer", 1), ("<article", 1)):
        if rng.random() < 0.6:
            told = told.replace(mark, (choose(extra) + mark), 1) if where or rng.random() < 0.5 else told.replace(mark, mark + choose(extra), 1)
    if k == 0:
        return told, told
    learn = told
    good, bad = choose(_GOOD_NAMES), {t: choose(_BAD_NAMES) for t in ("nav", "header", "footer", "aside")}
    if rng.random() < 0.7:
        learn = re.sub(r"<article\b", f'<div class="{good}"' if good else "<div", learn).replace("</article>", "</div>")
    for tag, name in bad.items():
        if rng.random() < 0.5:
            learn = re.sub(rf"<{tag}(?=[\s>])", f"<div class='{name}'", learn).replace(f"</{tag}>", "</div>")
    return told, learn


@dataclass
class Trees:
    """Boosted regression trees as arrays; children of node i of a tree at left[i] and left[i] + 1."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    weights: list[float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, cut, left, value), weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = left[at] > 0
                at = np.where(inner, left[at] + (x[rows, feature[at]] > cut[at]), at)
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))

    @staticmethod
    def of(model) -> "Trees":
        def walk(root):
            feature, cut, left, value, queue = [0], [0.0], [0], [0.0], [(0, root)]
            while queue:
                k, node = queue.pop()
                value[k] = node.prediction()
                if node.subtreeDepth() > 0:
                    feature[k], cut[k], left[k] = node.split().featureIndex(), node.split().threshold(), len(left)
                    for child in (node.leftChild(), node.rightChild()):
                        queue.append((len(left), child))
                        for column, empty in ((feature, 0), (cut, 0.0), (left, 0), (value, 0.0)):
                            column.append(empty)
            return tuple(map(np.array, (feature, cut, left, value)))

        return Trees([walk(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights))


def training_nodes(pages: DataFrame, train_pages: int = TRAIN_PAGES, train_chars: int = TRAIN_CHARS) -> DataFrame:
    rows = pick(pages, page_id="page_id", html="html").where(F.col("page_id").isNotNull() & (F.length("html") < train_chars))
    share = min(1.0, train_pages / max(1, rows.count()))
    chosen = rows.where(bucket_of(F.col("page_id"), 3) < share).select(F.col("page_id").alias("seed"), "html")
    written = pages.sparkSession.createDataFrame([(i, x.format(_FILL)) for i, x in enumerate(LAYOUTS)], "seed long, html string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for seed, html in zip(frame["seed"], frame["html"], strict=True):
                xs, ys = [], []
                for k in range(4):
                    told, learn = varied(html, k, int(seed))
                    a, b = Page(told), Page(learn)
                    if len(a.nodes) != len(b.nodes):
                        continue
                    y = labels(a)
                    xs.append(b.features()[y >= 0])
                    ys.append(y[y >= 0])
                if sum(map(len, xs)):
                    yield pd.DataFrame({"x": list(np.concatenate(xs)), "label": np.concatenate(ys).astype(float)})

    return chosen.unionByName(written).mapInPandas(run, "x array<double>, label double")


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES, train_chars: int = TRAIN_CHARS) -> Trees:
    nodes = stored(training_nodes(pages, train_pages, train_chars)).select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=STEP, seed=1, maxBins=32).fit(nodes)
    return Trees.of(model)


def extract(pages: DataFrame, *, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    sent = pages.sparkSession.sparkContext.broadcast(trees or train(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [Page(h or "") for h in part.column(2).to_pylist()]
                x = [p.features() for p in found]
                p = np.split(sent.value.probability(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1])
                texts = [page.text(page.decode(own)) for page, own in zip(found, p, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pick(pages, page_id="page_id", url="url", html="html").mapInArrow(run, OUT)
