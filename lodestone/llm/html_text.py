"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a flat list of blocks: text between block-level tags, with its word count and the share of
its words inside links. A block's features are these two, the same two of the blocks before and after it,
whether it lies inside an article (1), outside the page's (0) or on a page without any (0.5), and how far an
enclosing element marks it as page furniture. A decision tree, grown here on the labelled table below, decides
which blocks are article text by link densities, word counts and the neighbours'.

An element surely marks furniture (1) by its tag or hidden state, or by a class, id or role that is a name of
furniture or made of such names and of words of layout only. A name that merely has such a part (notice-period,
search-results-analysis) is a hint (0.5): there the tree goes by the block and its neighbours. Inside a text block,
what an inline element (a span, a link) surely marked holds is left out of the block.

Markup need not be well formed: unclosed and stray tags, unquoted attributes, truncated pages and broken
character references are read as browsers read them. Comments, scripts, styles and the like never become
blocks. Pages are judged one by one.

* Null and empty html give an empty text and n_chars 0. Repeated rows are treated alike.
* Very long and very deep pages: one pass, linear in the page; open elements are counted, not searched.
* Ties: none arise, a block's verdict is a path of the tree. Empty tables give empty results; extra columns are
  ignored (a column named ``text`` too).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow
from .textnum import small

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "article", "furniture")

#: Labelled blocks: the features in that order, then 1 for article text.
LABELLED = (
    # paragraphs of an article, long and short, first, middle and last
    (80, 0.0, 60, 0.0, 75, 0.0, 1, 0, 1), (45, 0.0, 9, 0.0, 80, 0.0, 1, 0, 1), (12, 0.0, 90, 0.0, 30, 0.0, 1, 0, 1), (3, 0.0, 70, 0.0, 44, 0.0, 1, 0, 1),
    (1, 0.0, 5, 0.0, 2, 0.0, 1, 0, 1), (6, 0.0, 8, 0.9, 4, 0.0, 1, 0, 1), (25, 0.2, 50, 0.0, 9, 0.0, 1, 0, 1), (4, 0.0, 20, 0.0, 14, 0.0, 1, 0, 1),
    (9, 0.0, 1, 1.0, 52, 0.0, 1, 0, 1), (2, 0.0, 0, 0.0, 6, 0.0, 1, 0, 1), (140, 0.05, 3, 0.0, 0, 0.0, 1, 0, 1), (18, 0.33, 25, 0.0, 33, 0.1, 1, 0, 1),
    (5, 0.0, 12, 0.0, 9, 0.0, 1, 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1), (30, 0.0, 6, 0.0, 8, 0.0, 1, 0, 1), (7, 0.14, 40, 0.0, 7, 1.0, 1, 0, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (3, 0.0, 3, 0.0, 3, 0.0, 1, 0, 1), (5, 0.0, 5, 0.0, 0, 0.0, 1, 0, 1), (1, 0.0, 0, 0.0, 1, 0.0, 1, 0, 1),
    (4, 0.0, 2, 1.0, 2, 1.0, 1, 0, 1), (3, 0.0, 12, 0.0, 3, 0.0, 1, 0, 1), (4, 0.0, 15, 0.0, 4, 0.0, 1, 0, 1), (2, 0.0, 1, 1.0, 9, 0.0, 1, 0, 1),
    (3, 0.0, 17, 0.0, 7, 0.0, 1, 0, 1), (6, 0.0, 4, 1.0, 0, 0.0, 1, 0, 1), (3, 0.0, 2, 1.0, 3, 0.0, 1, 0, 1), (8, 0.0, 14, 0.0, 5, 0.0, 1, 0, 1),
    (7, 0.0, 20, 0.0, 3, 0.0, 1, 0, 1), (4, 0.0, 4, 1.0, 12, 0.0, 1, 0, 1), (2, 0.0, 3, 0.0, 9, 0.0, 1, 0, 1), (5, 0.0, 13, 0.0, 8, 0.0, 1, 0, 1),
    # link lists inside an article: related pages, tags, share bars
    (6, 1.0, 60, 0.0, 5, 1.0, 1, 0, 0), (4, 1.0, 4, 1.0, 5, 1.0, 1, 0, 0), (2, 1.0, 30, 0.0, 2, 1.0, 1, 0, 0), (9, 0.89, 7, 1.0, 0, 0.0, 1, 0, 0),
    (1, 1.0, 45, 0.0, 1, 1.0, 1, 0, 0), (3, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0),
    # half-linked lines inside an article: next to text they belong to it, among links they are lists with dates or counts
    (9, 0.55, 60, 0.0, 45, 0.0, 1, 0, 1), (14, 0.6, 30, 0.05, 52, 0.0, 1, 0, 1), (6, 0.5, 12, 0.0, 40, 0.1, 1, 0, 1), (11, 0.64, 48, 0.0, 8, 0.0, 1, 0, 1),
    (8, 0.52, 20, 0.1, 33, 0.2, 1, 0, 1), (20, 0.7, 70, 0.0, 65, 0.0, 1, 0, 1), (5, 0.6, 25, 0.0, 0, 0.0, 1, 0, 1), (7, 0.57, 0, 0.0, 55, 0.0, 1, 0, 1),
    (6, 0.6, 5, 0.7, 7, 0.57, 1, 0, 0), (5, 0.5, 4, 1.0, 6, 0.6, 1, 0, 0), (8, 0.62, 6, 0.66, 5, 1.0, 1, 0, 0), (4, 0.75, 30, 0.0, 5, 0.8, 1, 0, 0),
    (6, 0.5, 6, 0.5, 6, 0.5, 1, 0, 0), (7, 0.71, 8, 0.6, 0, 0.0, 1, 0, 0), (10, 0.5, 9, 0.55, 40, 0.0, 1, 0, 0), (3, 0.67, 3, 0.67, 3, 0.67, 1, 0, 0),
    (5, 0.6, 40, 0.0, 6, 0.6, 1, 0, 0), (6, 0.5, 55, 0.0, 5, 0.6, 1, 0, 0), (4, 0.5, 28, 0.0, 4, 0.75, 1, 0, 0), (7, 0.57, 62, 0.0, 6, 0.67, 1, 0, 0),
    (5, 0.6, 70, 0.05, 5, 0.6, 1, 0, 0), (6, 0.67, 35, 0.0, 7, 0.57, 1, 0, 0),
    (5, 0.6, 5, 0.6, 0, 0.0, 1, 0, 0), (6, 0.5, 6, 0.67, 0, 0.0, 1, 0, 0), (4, 0.6, 7, 0.55, 0, 0.0, 1, 0, 0),
    # article text without links before and after link lists
    (3, 0.0, 20, 0.0, 3, 1.0, 1, 0, 1), (60, 0.0, 45, 0.0, 5, 1.0, 1, 0, 1), (12, 0.0, 30, 0.0, 6, 0.6, 1, 0, 1), (2, 0.0, 10, 0.0, 4, 0.8, 1, 0, 1), (1, 0.0, 6, 0.0, 2, 1.0, 1, 0, 1),
    (25, 0.0, 8, 0.0, 5, 0.6, 1, 0, 1), (80, 0.1, 60, 0.0, 3, 0.67, 1, 0, 1), (5, 0.0, 2, 0.0, 6, 0.5, 1, 0, 1), (40, 0.0, 5, 0.6, 30, 0.0, 1, 0, 1), (8, 0.0, 6, 0.6, 12, 0.0, 1, 0, 1),
    (2, 0.0, 4, 1.0, 5, 0.6, 1, 0, 1), (1, 0.0, 5, 0.6, 3, 1.0, 1, 0, 1), (18, 0.15, 5, 1.0, 4, 1.0, 1, 0, 1), (50, 0.2, 33, 0.0, 6, 0.67, 1, 0, 1),
    # pages without an article element: long text, and short text next to it
    (70, 0.0, 40, 0.0, 55, 0.0, 0.5, 0, 1), (35, 0.1, 6, 0.0, 60, 0.0, 0.5, 0, 1), (22, 0.0, 50, 0.0, 18, 0.0, 0.5, 0, 1), (16, 0.0, 30, 0.0, 4, 1.0, 0.5, 0, 1),
    (8, 0.0, 3, 1.0, 70, 0.0, 0.5, 0, 1), (6, 0.0, 60, 0.0, 45, 0.0, 0.5, 0, 1), (5, 0.0, 44, 0.0, 80, 0.0, 0.5, 0, 1), (90, 0.2, 2, 1.0, 3, 1.0, 0.5, 0, 1),
    (14, 0.0, 16, 0.0, 20, 0.0, 0.5, 0, 1),
    # their headlines, and short or single blocks away from links
    (4, 0.0, 0, 0.0, 60, 0.0, 0.5, 0, 1), (7, 0.0, 0, 0.0, 25, 0.0, 0.5, 0, 1), (5, 0.0, 2, 1.0, 48, 0.0, 0.5, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 0.5, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0.5, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0.5, 0, 1),
    (3, 0.0, 2, 0.0, 4, 0.0, 0.5, 0, 1), (7, 0.0, 3, 0.0, 0, 0.0, 0.5, 0, 1), (3, 0.0, 0, 0.0, 5, 0.0, 0.5, 0, 1), (6, 0.0, 30, 0.0, 0, 0.0, 0.5, 0, 1), (2, 0.0, 9, 0.0, 7, 0.1, 0.5, 0, 1),
    # the rest of such pages: menus, short lines among links
    (1, 1.0, 1, 1.0, 1, 1.0, 0.5, 0, 0), (2, 1.0, 3, 1.0, 1, 1.0, 0.5, 0, 0), (5, 1.0, 4, 1.0, 20, 0.0, 0.5, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0.5, 0, 0),
    (4, 0.0, 1, 1.0, 3, 0.0, 0.5, 0, 0), (8, 0.6, 3, 0.5, 2, 1.0, 0.5, 0, 0), (6, 0.0, 4, 1.0, 0, 0.0, 0.5, 0, 0), (12, 0.9, 6, 1.0, 5, 1.0, 0.5, 0, 0),
    (5, 0.0, 1, 1.0, 2, 1.0, 0.5, 0, 0), (2, 0.0, 3, 1.0, 1, 1.0, 0.5, 0, 0),
    # marked furniture, whatever its length
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (12, 0.0, 5, 1.0, 9, 0.0, 0, 1, 0), (60, 0.0, 4, 1.0, 70, 0.0, 0, 1, 0), (9, 0.0, 80, 0.0, 0, 0.0, 0, 1, 0),
    (25, 0.1, 50, 0.0, 8, 0.5, 1, 1, 0), (40, 0.0, 66, 0.0, 30, 0.0, 1, 1, 0), (5, 0.0, 7, 0.0, 90, 0.0, 1, 1, 0), (110, 0.0, 30, 0.0, 0, 0.0, 0, 1, 0),
    (3, 0.0, 12, 0.0, 4, 0.0, 0, 1, 0), (18, 0.3, 2, 1.0, 40, 0.0, 0, 1, 0), (1, 1.0, 0, 0.0, 4, 0.0, 0, 1, 0), (3, 1.0, 0, 0.0, 30, 0.0, 0, 1, 0),
    (2, 1.0, 60, 0.0, 50, 0.0, 1, 1, 0), (8, 0.5, 0, 0.0, 20, 0.0, 0, 1, 0), (14, 0.6, 30, 0.0, 52, 0.0, 1, 1, 0), (20, 0.5, 70, 0.0, 65, 0.0, 1, 1, 0), (9, 0.55, 60, 0.0, 45, 0.0, 1, 1, 0),
    (5, 0.6, 25, 0.0, 0, 0.0, 1, 1, 0), (30, 0.7, 12, 0.0, 40, 0.1, 0, 1, 0),
    # link lines of pages without an article element, next to text
    (1, 1.0, 0, 0.0, 40, 0.0, 0.5, 0, 0), (3, 1.0, 0, 0.0, 60, 0.0, 0.5, 0, 0), (6, 1.0, 30, 0.0, 50, 0.0, 0.5, 0, 0), (4, 0.8, 44, 0.0, 0, 0.0, 0.5, 0, 0),
    (5, 0.0, 44, 0.0, 80, 0.0, 0.5, 1, 0), (2, 1.0, 3, 1.0, 40, 0.0, 0.5, 1, 0), (60, 0.0, 4, 1.0, 70, 0.0, 0.5, 1, 0), (4, 0.0, 0, 0.0, 0, 0.0, 0.5, 1, 0),
    # short lines of an article after long ones, and text after linked lines
    (3, 0.0, 50, 0.0, 40, 0.0, 1, 0, 1), (2, 0.0, 63, 0.0, 2, 0.0, 1, 0, 1), (5, 0.0, 55, 0.0, 3, 0.0, 1, 0, 1), (1, 0.0, 80, 0.0, 0, 0.0, 1, 0, 1), (30, 0.0, 12, 1.0, 0, 0.0, 1, 0, 1), (40, 0.0, 15, 1.0, 20, 0.0, 1, 0, 1),
    (5, 0.0, 12, 1.0, 0, 0.0, 1, 0, 1), (4, 0.0, 9, 1.0, 3, 0.0, 1, 0, 1), (8, 0.05, 5, 1.0, 5, 1.0, 1, 0, 1), (1, 0.0, 1, 1.0, 1, 1.0, 1, 0, 1), (3, 0.1, 7, 0.9, 2, 0.8, 1, 0, 1), (60, 0.3, 50, 0.0, 45, 0.2, 1, 0, 1),
    # half-linked lines after text, with more of them to follow
    (5, 0.6, 19, 0.0, 5, 0.6, 1, 0, 0), (5, 0.6, 8, 0.0, 6, 0.5, 1, 0, 0), (6, 0.6, 15, 0.0, 6, 0.7, 1, 0, 0), (4, 0.5, 12, 0.0, 5, 0.6, 1, 0, 0), (6, 0.5, 23, 0.0, 4, 0.75, 1, 0, 0), (5, 0.6, 3, 0.0, 5, 0.8, 1, 0, 0),
    (4, 0.5, 10, 0.0, 30, 0.0, 1, 0, 1), (5, 0.6, 18, 0.0, 0, 0.0, 1, 0, 1), (6, 0.5, 22, 0.0, 19, 0.1, 1, 0, 1), (5, 0.5, 4, 0.0, 12, 0.0, 1, 0, 1),
    (19, 0.0, 2, 1.0, 0, 0.0, 1, 0.5, 1), (30, 0.0, 5, 1.0, 40, 0.0, 1, 0.5, 1), (12, 0.0, 3, 1.0, 6, 1.0, 1, 0.5, 1), (15, 0.1, 4, 1.0, 20, 0.0, 1, 0.5, 1),
    (2, 0.5, 20, 0.0, 30, 0.0, 1, 0.5, 0), (5, 0.6, 15, 0.0, 20, 0.0, 1, 0.5, 0),
    # a paragraph of an article that is one link, among text
    (12, 1.0, 40, 0.0, 35, 0.0, 1, 0, 1), (9, 1.0, 20, 0.0, 50, 0.1, 1, 0, 1), (15, 0.95, 60, 0.0, 0, 0.0, 1, 0, 1), (22, 1.0, 6, 0.0, 44, 0.0, 1, 0, 1), (30, 1.0, 0, 0.0, 25, 0.0, 1, 0, 1), (10, 1.0, 0, 0.0, 0, 0.0, 1, 0, 1),
    (10, 1.0, 9, 1.0, 11, 1.0, 1, 0, 0), (12, 1.0, 40, 0.0, 9, 1.0, 1, 0, 0), (9, 1.0, 10, 1.0, 40, 0.0, 1, 0, 0), (3, 1.0, 50, 0.0, 40, 0.0, 1, 0, 0),
    # outside the article of a page that has one
    (70, 0.0, 40, 0.0, 55, 0.0, 0, 0, 0), (8, 0.0, 3, 1.0, 70, 0.0, 0, 0, 0), (4, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (35, 0.1, 6, 0.0, 60, 0.0, 0, 0, 0), (3, 0.0, 2, 0.0, 4, 0.0, 0, 0, 0),
    (12, 1.0, 40, 0.0, 35, 0.0, 0, 0, 0), (22, 0.0, 50, 0.0, 18, 0.0, 0, 0, 0), (4, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0), (16, 0.0, 30, 0.0, 4, 1.0, 0, 0, 0),
    # under a name that hints at furniture: text is text, links and short lines among them are not
    (40, 0.0, 60, 0.0, 30, 0.0, 1, 0.5, 1), (12, 0.0, 45, 0.0, 50, 0.0, 1, 0.5, 1), (80, 0.1, 0, 0.0, 0, 0.0, 1, 0.5, 1), (9, 0.0, 20, 0.0, 0, 0.0, 1, 0.5, 1), (25, 0.2, 6, 0.0, 12, 0.0, 1, 0.5, 1), (6, 0.0, 0, 0.0, 40, 0.0, 1, 0.5, 1),
    (5, 1.0, 60, 0.0, 4, 1.0, 1, 0.5, 0), (3, 0.0, 50, 0.0, 40, 0.0, 1, 0.5, 1), (8, 0.75, 30, 0.0, 20, 0.0, 1, 0.5, 0), (2, 1.0, 20, 0.0, 30, 0.0, 1, 0.5, 0), (14, 0.6, 40, 0.0, 35, 0.0, 1, 0.5, 0), (4, 0.0, 5, 1.0, 3, 1.0, 1, 0.5, 0),
    (50, 0.0, 40, 0.0, 30, 0.0, 0.5, 0.5, 1), (18, 0.0, 30, 0.0, 0, 0.0, 0.5, 0.5, 1), (4, 0.0, 60, 0.0, 30, 0.0, 0.5, 0.5, 1), (9, 1.0, 30, 0.0, 40, 0.0, 0.5, 0.5, 0), (40, 0.0, 60, 0.0, 30, 0.0, 0, 0.5, 0),
)


@cache
def tree(depth: int = 10) -> tuple:
    """The decision tree grown on LABELLED by Gini impurity: (feature, threshold, low, high) or a label."""
    x, y = np.array([r[:-1] for r in LABELLED], float), np.array([r[-1] for r in LABELLED])

    def grow(rows: np.ndarray, left: int):
        p = y[rows].mean()
        if left == 0 or p in (0.0, 1.0):
            return int(p >= 0.5)
        best = (2 * p * (1 - p) * len(rows) - 1e-9, None)
        for k in range(x.shape[1]):
            values = np.unique(x[rows, k])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[rows, k] <= t
                a, b = y[rows[low]].mean(), y[rows[~low]].mean()
                cost = 2 * a * (1 - a) * low.sum() + 2 * b * (1 - b) * (~low).sum()
                if cost < best[0]:
                    best = (cost, (k, float(t), rows[low], rows[~low]))
        if best[1] is None:
            return int(p >= 0.5)
        k, t, low, high = best[1]
        return k, t, grow(low, left - 1), grow(high, left - 1)

    return grow(np.arange(len(y)), depth)


def is_article(features: tuple) -> int:
    node = tree()
    while not isinstance(node, int):
        node = node[3] if features[node[0]] > node[1] else node[2]
    return node


_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINER = {"div", "section", "nav", "header", "footer", "aside", "form", "article", "main", "ul", "ol", "dl", "table", "dialog", "figure", "fieldset", "menu", "body"}
BLOCK = CONTAINER | {"p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "thead", "tbody", "caption", "blockquote", "pre", "hr", "address", "figcaption", "html", "head", "center", "summary", "details", "button", "label", "legend", "option"}
#: Open elements that a new one of the key's kind ends, where they stand innermost.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "thead", "tbody"}}
FURNITURE_TAG = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "label", "legend"}
FURNITURE_NAME = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup",
    "modal", "overlay", "newsletter", "subscribe", "subscription", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "toolbar",
    "comment", "comments", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "widget", "login", "signup", "search", "pagination", "pager", "skip", "hidden",
}


#: Words of layout that names of furniture are made with.
LAYOUT = {
    "site", "page", "main", "top", "bottom", "left", "right", "upper", "lower", "global", "local", "primary", "secondary", "box", "bar", "list", "block", "area", "section", "container", "wrapper", "wrap", "inner", "outer", "content",
    "item", "items", "link", "links", "button", "buttons", "post", "posts", "article", "articles", "form", "input", "field", "header", "title", "slot", "unit", "panel", "row", "col", "column", "group", "icon", "icons", "js", "c", "l", "m",
}


@cache
def mark(name: str) -> float:
    """How far a class, id or role marks furniture: 1 if it is made of names of furniture and words of layout, 0.5 if
    it has such a part among others, else 0."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
    named = [p in FURNITURE_NAME for p in parts]
    return 0.0 if not any(named) else 1.0 if all(n or p in LAYOUT or p.isdigit() for n, p in zip(named, parts)) else 0.5


def _marks(name: str, attrs: str, inside_article: bool) -> tuple[bool, float]:
    """(article, furniture) of an element."""
    article = name in ("article", "main")
    furniture = float(name in FURNITURE_TAG or (name == "header" and not inside_article))
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                furniture = 1.0
            elif key != "aria-hidden" and name not in ("body", "html"):
                if not article:
                    furniture = max([furniture, *(mark(t) if len(t) <= 100 else 0.0 for t in value.split())])
                article |= key == "role" and value == "main"
    return article, furniture


def blocks(page: str) -> list[tuple[str, float, bool, float]]:
    """(text, share of linked words, inside an article, mark of furniture) by block.

    The stack holds block elements and the inline ones that are marked; ``inside`` counts the open articles,
    the furniture and the marked inline elements among them, ``opened`` the open elements by name."""
    out: list[tuple[str, float, bool, float]] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, float, bool]] = []
    opened: dict[str, int] = {}
    inside = [0, 0, 0, 0]
    link = 0

    def say(part: str) -> None:
        if not inside[2]:
            text.append(part)
            if link:
                linked.append(part)
            elif linked and (not part.strip() or part[:1].isspace() or part[-1:].isspace()):
                linked.append(" ")  # what stands between two links keeps their words apart

    def close() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                inner = len(html.unescape("".join(linked)).split()) if linked else 0
                out.append((" ".join(words), min(1.0, inner / len(words)), inside[0] > 0, 1.0 if inside[1] else 0.5 if inside[3] else 0.0))
            text.clear()
            linked.clear()

    def push(name: str, article: bool, furniture: float, inline: bool) -> None:
        stack.append((name, article, furniture, inline))
        opened[name] = opened.get(name, 0) + 1
        inside[0] += article
        inside[1] += furniture == 1 and not inline
        inside[2] += furniture == 1 and inline
        inside[3] += furniture == 0.5 and not inline

    def pop() -> str:
        name, article, furniture, inline = stack.pop()
        opened[name] -= 1
        inside[0] -= article
        inside[1] -= furniture == 1 and not inline
        inside[2] -= furniture == 1 and inline
        inside[3] -= furniture == 0.5 and not inline
        return name

    i, n = 0, len(page)
    while i < n:
        at = page.find("<", i)
        if at < 0:
            at = n
        if at > i:
            say(page[i:at])
        if at == n:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            i = n if end < 0 else end + 3
            continue
        nxt = page[at + 1 : at + 2]
        if nxt in ("!", "?") and nxt:
            end = page.find(">", at)
            i = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, at) or _PLAIN_TAG.match(page, at)
        if not m:
            if nxt.isascii() and (nxt.isalpha() or nxt == "/"):
                if nxt == "/" and not page[at + 2 : at + 3].isalpha():
                    end = page.find(">", at)
                    i = n if end < 0 else end + 1
                    continue
                break  # a tag that never ends
            say("<")
            i = at + 1
            continue
        i = m.end()
        closing, name, attrs = m[1], m[2].lower(), m[3]
        if name in RAW:
            if not closing and not attrs.endswith("/"):
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, i)
                if not end:
                    break
                i = page.find(">", end.start())
                if i < 0:
                    break
                i += 1
        elif name == "br" or name == "img":
            say(" ")
        elif name not in BLOCK:
            if name == "a":
                link = 0 if closing else 1
            if closing:
                if stack and stack[-1][3] and stack[-1][0] == name:
                    pop()
            elif name not in VOID and not attrs.endswith("/"):
                furniture = _marks(name, attrs, True)[1] if attrs else 0.0
                if furniture == 1 or (opened.get(name) and stack[-1][3]):  # the second: so that its end is not taken for the marked one's
                    push(name, False, furniture, True)
        else:
            close()
            link = 0
            if closing:
                if opened.get(name):
                    while pop() != name:
                        pass
                continue
            while opened.get("p"):
                pop()
            while stack and (stack[-1][3] or stack[-1][0] in ENDS.get(name, ())):
                pop()
            if name not in VOID and not attrs.endswith("/"):
                push(name, *_marks(name, attrs, inside[0] > 0), False)
    close()
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    size = [len(b[0].split()) for b in found]
    page_has = any(b[2] for b in found)
    keep = []
    for k, (text, links, article, furniture) in enumerate(found):
        before = (size[k - 1], found[k - 1][1]) if k else (0, 0.0)
        after = (size[k + 1], found[k + 1][1]) if k + 1 < len(found) else (0, 0.0)
        if is_article((size[k], links, *before, *after, float(article) if page_has else 0.5, furniture)):
            keep.append(text)
    return "\n".join(keep)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of ``pages``."""
    names = list(keep)
    source = pages.select(*names, pages[html_col].alias("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "_h"):
            texts = [main_text(h.as_py()) for h in batch.column("_h")]
            yield pa.record_batch({c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    head = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c != "_h")
    return in_arrow(source, run, f"{head}, text string, n_chars bigint")
