"""HTML extraction by composite text density (Sun, Song and Liao, 2011).

Every element i of the page's tree has C characters, LC of them in links, T
elements below it and LT of them links; b is the body, and zeros count as 1:

    density = C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + LC_b / C_b * C + e)

An element's density sum is that of its children's densities. The least
density on the path from the element of the largest density sum up to the
body is the threshold: in each element that reaches it, going down from the
body, the subtree of the largest density sum is content.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common as C

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
_RAW = frozenset("script style noscript template textarea title svg math iframe object head".split())
_RAW_TEXT = frozenset("script style textarea title".split())
_LINK = frozenset("a button select".split())
#: An opening tag ends open elements of these names, up to the nearest of the others.
_ENDS = {"p": ({"p"}, None), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
for _name in _BLOCKS - {"li", "dt", "dd", "tr", "td", "th", "p", "body", "html"}:
    _ENDS.setdefault(_name, ({"p"}, None))


class Tree:
    """Elements in document order: names, parents, and their own pieces of text as (piece number, text)."""

    def __init__(self, html: str):
        self.names, self.parents, self.pieces = ["#root"], [-1], []  # pieces: (element, text), and (element, None) for a block's edge
        at, n = 0, len(html)
        open_: list[int] = [0]
        where: dict[str, list[int]] = {}  # of each name, the places of its open elements in open_

        def close(k: int) -> None:
            """Close the open elements from place k on."""
            for element in open_[k:]:
                where[self.names[element]].pop()
            del open_[k:]

        def last(names) -> int:
            return max((where[x][-1] for x in names if where.get(x)), default=-1)

        while at < n:
            m = _TOKEN.search(html, at)
            stop = m.start() if m else n
            if stop > at:
                self._text(open_[-1], html[at:stop])
            if not m:
                break
            at = m.end()
            if m.group(1) is not None:
                self._text(open_[-1], m.group(1))
            name = m.group(3)
            if name is None:
                continue
            name = name.lower()
            if m.group(2):
                if where.get(name):
                    close(where[name][-1])
                self._edge(open_[-1], name)
                continue
            ends, border = _ENDS.get(name, (None, None))
            if ends and border is None:  # the nearest, if no block is nearer
                k = last(ends)
                if k > last(_BLOCKS - ends):
                    close(k)
            elif ends:  # all within the nearest border
                edge = last(border)
                inner = [where[x][bisect_right(where[x], edge)] for x in ends if where.get(x) and where[x][-1] > edge]
                if inner:
                    close(min(inner))
            self._edge(open_[-1], name)
            self.names.append(name)
            self.parents.append(open_[-1])
            if name in _VOID or m.group(4).endswith("/"):
                continue
            if name in _RAW_TEXT:
                end = re.compile(f"</{name}", re.I).search(html, at)
                if end is None:
                    break
                at = end.start()
            where.setdefault(name, []).append(len(open_))
            open_.append(len(self.names) - 1)

    def _text(self, element: int, text: str) -> None:
        self.pieces.append((element, text))

    def _edge(self, element: int, name: str) -> None:
        if name in _BLOCKS or name == "br":
            self.pieces.append((element, None))


def _raw(tree: Tree) -> list[bool]:
    out = []
    for name, parent in zip(tree.names, tree.parents):
        out.append(name in _RAW or (parent >= 0 and out[parent]))
    return out


def densities(tree: Tree) -> tuple[list[float], list[float], int]:
    """Density and density sum of each element, and the number of the body (or of the root without one)."""
    n = len(tree.names)
    raw = _raw(tree)
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for element, text in tree.pieces:
        if text is not None and not raw[element]:
            chars[element] += len(_SPACE.sub("", unescape(text)))
    for i in range(n - 1, -1, -1):
        if tree.names[i] in _LINK:
            link_chars[i], link_tags[i] = chars[i], tags[i]
        p = tree.parents[i]
        if p >= 0 and not raw[i]:
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tree.names[i] in _LINK)
    body = next((i for i in range(n) if tree.names[i] == "body"), 0)
    body_part = max(link_chars[body], 1) / max(chars[body], 1)
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        c, t, lc, lt = chars[i], max(tags[i], 1), max(link_chars[i], 1), max(link_tags[i], 1)
        if c and not raw[i]:
            base = log(c / max(c - link_chars[i], 1) * lc + body_part * c + e)
            density[i] = c / t * log(max(c / lc * t / lt, 1e-9)) / log(base)
        if tree.parents[i] >= 0:
            sums[tree.parents[i]] += density[i]
    return density, sums, body


def content(html: str) -> tuple[str, str, float, float, int]:
    """Content text, path of the element of the largest density sum, that sum, the threshold, and the number of content subtrees."""
    tree = Tree(html)
    density, sums, body = densities(tree)
    n = len(tree.names)
    after = list(range(1, n + 1))  # end of each subtree
    for i in range(n - 1, 0, -1):
        after[tree.parents[i]] = max(after[tree.parents[i]], after[i])
    best = list(range(n))  # element of the largest sum in each subtree, the first of equal ones
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        if (-sums[best[i]], best[i]) < (-sums[best[p]], best[p]):
            best[p] = best[i]
    top = best[body]
    path, threshold, i = [], density[top], top
    while True:
        path.append(tree.names[i])
        threshold = min(threshold, density[i])
        if i == body or i < 0:
            break
        i = tree.parents[i]
    chosen = [False] * n
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[tree.parents[i]].append(i)
    todo, picked = [body], 0
    while todo:
        i = todo.pop()
        if density[i] < threshold or chosen[i]:
            continue
        s = best[i]
        if not chosen[s]:
            picked += 1
            for j in range(s, after[s]):
                chosen[j] = True
        todo.extend(reversed(children[i]))
    raw = _raw(tree)
    out: list[str] = []
    for element, text in tree.pieces:
        if not chosen[element] or raw[element]:
            continue
        out.append("\n" if text is None else _SPACE.sub(" ", unescape(text)))
    lines = (_SPACE.sub(" ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x), "/".join(reversed(path)), sums[top], threshold, picked


def _extracted(batches):
    for batch in batches:
        made = [content(h) if h is not None else (None,) * 5 for h in batch.column("html").to_pylist()]
        cols = list(zip(*made)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=["page_id", "content", "path", "density_sum", "threshold", "subtrees"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, content, path, density_sum, threshold, subtrees) of every page.

    Needs page_id and html. A null page has nulls; an empty one, and one
    without text, has empty content; one without a body is taken as a body
    itself. Of equal density sums the first element in the document counts.
    Broken markup is read tolerantly: an end tag without a start is skipped,
    open elements end with their parents, and a quoted attribute without an
    end takes the rest. Repeated rows have equal results; ids keep their type;
    long pages are taken whole, in linear time; an empty table gives no rows; other columns
    are ignored.
    """
    C.arrow_batches(pages.sparkSession)
    pages = pages.select(C.own(pages, "page_id").alias("page_id"), C.own(pages, "html").alias("html"))
    return pages.mapInArrow(_extracted, f"page_id {pages.schema['page_id'].dataType.simpleString()}, content string, path string, density_sum double, threshold double, subtrees int")


def op2_composite_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of every page."""
    made = extract(C.table(spark, sf_dir, "pages"))
    return made.select("page_id", "content", "path", F.round("density_sum", 4).alias("density_sum"), F.round("threshold", 4).alias("threshold"), "subtrees")
