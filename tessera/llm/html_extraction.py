"""Main-text extraction: boosted trees over block-tree nodes and a hierarchical decoding.

The trees give each node the log-odds that its subtree holds main text. Their features are densities, depth and
siblings of the subtree, and what the attribute tokens (words of class, id and role, hashed) of the element, of those around and of
those in it have meant on the training pages. Decoding picks the most likely set of kept nodes in which every kept node has a
kept parent, by one pass up and one pass down the tree, so an ancestor and its descendants never contradict each other. The
model is fitted on ``TRAIN_PAGES`` pages of several layout families made by ``page_samples`` (their labels are known as they are built);
the bound is that parameter, and every page of the input is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .boosting import BoostedTrees
from .page_samples import FAMILIES, labelled_page

TRAIN_PAGES = 500
#: Pages whose nodes are scored together.
BATCH_PAGES = 64


class Model:
    """Weights of attribute tokens and boosted trees, fitted on the same labelled pages."""

    def __init__(self, samples: list[tuple[str, set[str]]]):
        pages = [dom.walk(dom.parse(html)) for html, _ in samples]
        labels = [label_nodes(nodes, main) for nodes, (_, main) in zip(pages, samples, strict=True)]
        self.weights = dom.token_weights(pages, labels)
        self.trees = BoostedTrees(trees=60, depth=5).fit(np.concatenate([dom.features(nodes, self.weights) for nodes in pages]), np.concatenate(labels))

    def scores(self, pages: list[list[dom.Node]]) -> list[np.ndarray]:
        """Log-odds of each node of each page that it holds main text."""
        score = self.trees.predict(np.concatenate([dom.features(n, self.weights) for n in pages]))
        return np.split(score, np.cumsum([len(n) for n in pages])[:-1])


@lru_cache(maxsize=8)
def model(pages: int = TRAIN_PAGES, seed: int = 5, without: str | None = None) -> Model:
    """The model of ``pages`` made pages, of all layouts but ``without``."""
    rng = np.random.default_rng(seed)
    families = [f for f in FAMILIES if f != without]
    return Model([labelled_page(rng, families[i % len(families)]) for i in range(pages)])


def label_nodes(nodes: list[dom.Node], main: set[str]) -> np.ndarray:
    """1 for leaves whose text is a main block, and for their ancestors."""
    y = np.zeros(len(nodes))
    for x in nodes:
        if x.tag == "#text" and x.text in main:
            while x is not None and not y[x.order]:
                y[x.order] = 1
                x = x.parent
    return y


def decode(nodes: list[dom.Node], score: np.ndarray) -> list[str]:
    """Texts of the kept leaves in page order. score: log-odds of each node."""
    keep, drop = -np.logaddexp(0, -score), -np.logaddexp(0, score)
    gone = drop.copy()
    for i in range(len(nodes) - 1, 0, -1):
        gone[nodes[i].parent.order] += gone[i]
    best = keep.copy()
    for i in range(len(nodes) - 1, 0, -1):
        best[nodes[i].parent.order] += max(best[i], gone[i])
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    out = []
    for i, x in enumerate(nodes):
        if i:
            kept[i] = kept[x.parent.order] and best[i] >= gone[i]
        if kept[i] and x.text:
            out.append(x.text)
    return out


def extract_texts(pages: list[str | None], fitted: Model) -> list[str]:
    parsed = [dom.walk(dom.parse(p or "")) for p in pages]
    return ["\n".join(decode(n, s)) for n, s in zip(parsed, fitted.scores(parsed), strict=True)] if parsed else []


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each input row.

    A null or empty page has an empty text; null ids and urls stay; repeated rows give repeated rows; an empty
    table gives an empty result; other columns are ignored. Row-local: no shuffle.
    """
    fitted = model()
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html")
            for at in range(0, batch.num_rows, BATCH_PAGES):
                part = batch.slice(at, BATCH_PAGES)
                texts = extract_texts(html.slice(at, BATCH_PAGES).to_pylist(), fitted)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return narrow.mapInArrow(run, f"page_id {narrow.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
