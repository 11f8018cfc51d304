"""The main text of a web page without menus, notices, boxes and footers, by composite text density.

An element's density is its characters per tag, weighted by how little of them is links and compared with the page's body.
The densities of an element's children add up to its sum, which counts by the share of its characters outside links. The
way from the body to an element gives two thresholds: its least density is what the element itself must reach to be a
candidate, and the candidate with the greatest sum holds the main text; its greatest density, the element's own included, is
what a box inside must reach not to interrupt the text. The share of links tells the blocks that only point elsewhere.
Neither words nor names of elements decide, so any language will do. Pages don't depend on each other: one pass, no shuffle;
a page is read by loops over its elements, however deep they are nested.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stelwerk.llm.dom import INLINE, Node, parse

#: A block with more than this share of its characters in links, but not all of them, points elsewhere.
LINKS = 0.5
#: Parts of lists and tables: they are judged by what holds them, a row or an item has too few characters of its own.
_PARTS = {"ul", "ol", "dl", "menu", "li", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}


def density(n: Node, body_ratio: float) -> float:
    """Composite text density. ``body_ratio``: link characters per character of the body."""
    if not n.chars:
        return 0.0
    links, tags, link_tags = n.link_chars, max(1, n.tags), max(1, n.link_tags)
    base = math.log(n.chars / max(1, n.chars - links) * links + body_ratio * n.chars + math.e)
    return n.chars / tags * math.log(max(1.0 + 1e-9, n.chars / max(1, links) * tags / link_tags)) / base


def block_text(n: Node) -> str:
    return " ".join("".join(n.text).split())


def main_element(nodes: list[Node]) -> tuple[Node, float, list[float]]:
    """The element with the main text, the greatest density on the way from the body to it, all densities by document order.

    Elements without children, inline ones and what stands before the body are no candidates; of equal sums the last in
    the page, so the innermost, counts. A body without candidates is its own main element."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    ratio = body.link_chars / max(1, body.chars)
    dense = [density(n, ratio) for n in nodes]
    sums = [0.0] * len(nodes)
    least = [math.inf] * len(nodes)  # over the elements around each, up to the body
    most = [dense[body.order]] * len(nodes)  # the same with its own
    inside = [False] * len(nodes)
    inside[body.order] = True
    best, best_sum = body, -1.0
    for n in nodes:
        if n.parent:
            up = n.parent.order
            sums[up] += dense[n.order]
            if inside[up]:
                inside[n.order] = True
                least[n.order] = min(least[up], dense[up])
                most[n.order] = max(most[up], dense[n.order])
    for n in nodes:
        k = n.order
        if inside[k] and n.children and n.tag not in INLINE and (n is body or dense[k] >= least[k]):
            total = sums[k] * (1 - n.link_chars / max(1, n.chars))
            if total >= best_sum:
                best, best_sum = n, total
    return best, most[best.order], dense


def points_elsewhere(n: Node) -> bool:
    """Whether a block is links with a label, or links that follow one another from its start. A block that is one link as
    a whole is an entry, as lists of cited works have them, and a sentence may hold as many links as it likes."""
    return LINKS * n.chars < n.link_chars < n.chars or n.links > 1 and n.lead == 0


def main_blocks(page: str) -> list[tuple[str, str]]:
    """(id, text) of the visible blocks of a page's main text, in document order; a block is an element with an id that
    holds visible text itself. An empty page has none."""
    nodes = parse(page)
    best, threshold, dense = main_element(nodes)
    kept: list[tuple[str, str]] = []
    todo = [best]
    while todo:
        n = todo.pop()
        if n.hidden:
            continue
        if n.id is not None and n.text and (text := block_text(n)) and not points_elsewhere(n):
            kept.append((n.id, text))
        if n.children and (n is best or n.id is not None or n.tag in _PARTS or n.tag in INLINE or dense[n.order] >= threshold):
            todo += n.children[::-1]
    return kept


def main_text(df: DataFrame, rec: str = "rec_id", page: str = "raw_html") -> DataFrame:
    """``rec_id, position, block_id, text``: the blocks of each page's main text in their order.

    ``page`` is an expression. Null, empty and blank pages and pages without text give no rows; repeated pages give theirs
    each; ids that repeat within a page are kept as they stand; pages are read whole, at any depth; other columns aren't
    read."""
    rows = df.select(F.col(rec).cast("bigint").alias("rec_id"), F.expr(page).alias("h")).where("trim(h) <> ''")
    types = (pa.int64(), pa.int32(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                out = [(r, i, *block) for r, h in zip(part["rec_id"].to_pylist(), part["h"].to_pylist()) for i, block in enumerate(main_blocks(h))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["rec_id", "position", "block_id", "text"])

    return rows.mapInArrow(run, "rec_id bigint, position int, block_id string, text string")
