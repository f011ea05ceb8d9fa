"""Main text of web pages: boosted trees over DOM nodes with hierarchical decoding.

Every block element and text run of a page gets the log-odds that it holds main text. Decoding keeps the
set of nodes with the largest sum of log-odds among those in which every kept node's parent is kept too, no
element is kept empty and all that is kept under a node sums to more than 0, found bottom-up in one pass: a kept paragraph in a dropped menu, or a kept menu with nothing kept in it,
cannot come out. Kept runs are the text, one line each, in page order.

The trees in ``page_trees.json`` were trained by ``train`` on ``N_TRAINING`` pages from ``page_forms`` (their
layouts vary in containers, attributes, order, boilerplate and markup errors; their words are random);
``python -m panelwright.llm.html_extract`` trains them again. Pages to extract are never used for training.

Defined results: null and empty pages give empty text; pages cut anywhere are read as far as they go, and a tag
without an end runs to the end of the page; malformed pages take time in proportion to their length;
a page with no main text gives empty text; very long pages are read whole, one at a time; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import pathlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting
from .common import id_and_text, map_batches, texts, with_id
from .dom import Page, node_features, parse
from .page_forms import training_page

N_TRAINING = 1600
TREES = pathlib.Path(__file__).with_name("page_trees.json")


def training_nodes(seeds) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of generated pages: a node is positive if main text is at or below it."""
    xs, ys = [], []
    for seed in seeds:
        source, main = training_page(seed)
        page = parse(source)
        good = np.array([t is not None and t in main for t in page.text])
        for i in range(len(good) - 1, 0, -1):
            good[page.parent[i]] |= good[i]
        xs.append(node_features(page))
        ys.append(good)
    return np.concatenate(xs), np.concatenate(ys).astype(float)


def train(pages: int = N_TRAINING, trees: int = 60) -> boosting.Boosted:
    return boosting.fit(*training_nodes(range(pages)), trees=trees)


@functools.cache
def model() -> boosting.Boosted:
    """The trained trees, read on the driver and broadcast."""
    with open(TREES, encoding="utf-8") as f:
        return boosting.load(f.read())


def decode(page: Page, odds: np.ndarray) -> list[str]:
    """The runs of the best consistent choice of nodes.

    value[i] is the most that node i and what is kept below it give. Only nodes of positive value are kept, and
    an element only with such a node below it, so a confident page cannot force doubtful parts in.
    """
    n = len(page.parent)
    value, below = odds.tolist(), [0.0] * n
    for i in range(n - 1, -1, -1):
        if page.text[i] is None:
            value[i] = value[i] + below[i] if below[i] else 0.0
        if i and value[i] > 0:
            below[page.parent[i]] += value[i]
    keep = [value[0] > 0] + [False] * (n - 1)
    out = []
    for i in range(1, n):
        keep[i] = keep[page.parent[i]] and value[i] > 0
        if keep[i] and page.text[i] is not None:
            out.append(page.text[i])
    return out


def extract_pages(pages: list[str], trees: boosting.Boosted) -> list[str]:
    """Main text of each page."""
    parsed = [parse(p) for p in pages]
    rows = [node_features(p) for p in parsed]
    odds = trees.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page, r in zip(parsed, rows, strict=True):
        out.append("\n".join(decode(page, odds[at : at + len(r)])))
        at += len(r)
    return out


def extract_main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", piece: int = 64) -> DataFrame:
    """(id_col, text string), one row per row of ``df``; ``piece`` pages are scored together."""
    source = id_and_text(df, id_col, html_col)
    trees = df.sparkSession.sparkContext.broadcast(model())

    def make():
        def step(batch):
            pages, out = texts(batch), []
            for k in range(0, len(pages), piece):
                out += extract_pages(pages[k : k + piece], trees.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

        return step

    return map_batches(source, make, with_id(source, "text string")).withColumnRenamed("id", id_col)


if __name__ == "__main__":
    TREES.write_text(boosting.dump(train()), encoding="utf-8")
