"""Main text of web pages by a tree-structured graphical model (operator 1)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.dom import Node, block_text, parse, parse_pieces
from episodica.llm.html_labels import CONTENT, OTHER, labelled_page
from episodica.llm.shared import slices, table

#: Labelled pages that the model is fitted on, whatever the input's size.
TRAINING_PAGES, STEPS = 500, 150

_TAGS = "article main section div p li ul,ol,menu nav header footer aside form,fieldset,legend h1 h2,h3,h4,h5,h6 blockquote,pre table,tbody,thead,tfoot,tr,td,th figure,figcaption dl,dt,dd root,html,body address details,summary,dialog button,select,option,optgroup,datalist".split()
_TAG = {t: i for i, group in enumerate(_TAGS) for t in group.split(",")}
_NAMES = [{w for x in names for w in x.split("-")} for names in [*OTHER.values(), CONTENT]]
_NAMES[-1] -= {"main"}
#: Kinds of edges from a parent to a child: each has its own potentials.
_EDGES = 7
FEATURES = 1 + len(_TAGS) + 1 + len(_NAMES) + 1 + 10


def _content_name(own: set[str]) -> bool:
    """A name of content; main is one where nothing else is said, as it is not in main-menu."""
    return bool(own & _NAMES[-1]) or "main" in own and not any(own & x for x in _NAMES[:-1])


def _features(node: Node, sub_chars: int, sub_linked: int, in_article: bool) -> np.ndarray:
    x = np.zeros(FEATURES, np.float64)
    x[0] = 1
    x[1 + _TAG.get(node.tag, len(_TAGS))] = 1
    at = 2 + len(_TAGS)
    own = set(node.classes)
    for i, names in enumerate(_NAMES):
        x[at + i] = bool(own & names)
    x[at + len(_NAMES) - 1] = _content_name(own)
    at += len(_NAMES)
    x[at] = node.hidden
    density = sub_linked / sub_chars if sub_chars and not node.inline else 0.0
    x[at + 1 :] = [
        sub_chars == 0,
        np.log1p(node.chars) / 8,
        min(node.ends, 5) / 5,
        density > 0.8,
        density,
        in_article,
        in_article and node.tag in ("header", "footer"),
        node.chars > 0 and node.ends == 0 and not node.inline,
        node.cue,
        node.inline,
    ]
    return x


def _edge(node: Node) -> int:
    own = set(node.classes)
    if node.hidden or node.tag in ("nav", "aside", "footer", "form", "button", "select", "option", "datalist", "optgroup") or any(own & x for x in _NAMES[:-1]):
        return 0
    if node.tag in ("article", "main") or _content_name(own):
        return 1
    if node.inline:
        return 6
    if node.tag in ("p", "blockquote", "pre", "figure", "figcaption"):
        return 2
    if node.tag in ("li", "ul", "ol", "td", "th", "tr", "tbody", "dt", "dd", "table", "dl"):
        return 3
    return 4 if re.fullmatch("h[1-6]", node.tag) else 5


def tree(pages: list[list[Node]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, parents (-1: none), depths and kinds of edges of the pages' nodes, laid end to end."""
    rows, parents, depths, edges, base = [], [], [], [], 0
    for nodes in pages:
        chars, linked = [x.chars for x in nodes], [x.linked for x in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            chars[nodes[i].parent] += chars[i]
            linked[nodes[i].parent] += linked[i]
        inside = [False] * len(nodes)
        for i, x in enumerate(nodes):
            inside[i] = x.parent >= 0 and (inside[x.parent] or nodes[x.parent].tag == "article")
            rows.append(_features(x, chars[i], linked[i], inside[i]))
            parents.append(x.parent + base if x.parent >= 0 else -1)
            depths.append(x.depth)
            edges.append(_edge(x))
        base += len(nodes)
    return np.array(rows).reshape(-1, FEATURES), np.array(parents, np.int64), np.array(depths, np.int64), np.array(edges, np.int64)


def sum_product(unary: np.ndarray, pair: np.ndarray, parent: np.ndarray, depth: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of nodes (n, 2) and of edges (n, 2, 2: parent's label, child's label), exact on trees.

    ``unary`` (n, 2) and ``pair`` (kinds, 2, 2) are log potentials. Messages go up from the deepest level, then down;
    all nodes of a level, in all pages, at once.
    """
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if len(depth) else [0]
    levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    up, message = unary.copy(), np.zeros_like(unary)
    for nodes in levels[:0:-1]:
        message[nodes] = np.logaddexp.reduce(pair[edge[nodes]] + up[nodes][:, None, :], axis=2)
        np.add.at(up, parent[nodes], message[nodes])
    belief, joint = up.copy(), np.zeros((len(unary), 2, 2))
    for nodes in levels[1:]:
        outside = belief[parent[nodes]] - message[nodes]
        joint[nodes] = outside[:, :, None] + pair[edge[nodes]] + up[nodes][:, None, :]
        belief[nodes] = np.logaddexp.reduce(joint[nodes], axis=1)
    node = np.exp(belief - np.logaddexp.reduce(belief, axis=1)[:, None])
    flat = joint.reshape(-1, 4)
    return node, np.exp(flat - np.logaddexp.reduce(flat, axis=1)[:, None]).reshape(-1, 2, 2)


@lru_cache(maxsize=4)
def fit(pages: int = TRAINING_PAGES, steps: int = STEPS, penalty: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features) of a node's content potential and (kinds, 2, 2) of its edge: maximum conditional likelihood.

    The gradient is what the labels have minus what the marginals expect, for nodes and edges.
    """
    found = [parse(labelled_page(seed))[0] for seed in range(pages)]
    label = np.array([int(m[1]) if (m := re.search(r'data-y="([01])"', x.attributes)) else 1 for nodes in found for x in nodes])
    x, parent, depth, edge = tree(found)
    child = np.flatnonzero(parent >= 0)
    have = np.zeros((_EDGES, 2, 2))
    np.add.at(have, (edge[child], label[parent[child]], label[child]), 1)
    weight, pair = np.zeros(FEATURES), np.zeros((_EDGES, 2, 2))
    state = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(pair), np.zeros_like(pair)]
    for t in range(1, steps + 1):
        score = x @ weight
        node, joint = sum_product(np.stack([-score / 2, score / 2], axis=1), pair, parent, depth, edge)
        expect = np.zeros_like(have)
        np.add.at(expect, edge[child], joint[child])
        gradients = [x.T @ (label - node[:, 1]) / len(x) - penalty * weight, (have - expect) / len(x) - penalty * pair]
        for k, (value, g) in enumerate(zip((weight, pair), gradients, strict=True)):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return weight, pair


def content_marginals(pages: list[list[Node]], weight: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """For each node of the pages, laid end to end, the probability of being part of the article."""
    x, parent, depth, edge = tree(pages)
    score = x @ weight
    return sum_product(np.stack([-score / 2, score / 2], axis=1), pair, parent, depth, edge)[0][:, 1]


def main_texts(pages: list[str | None], weight: np.ndarray, pair: np.ndarray) -> list[str]:
    parsed = [parse_pieces(x or "") for x in pages]
    if not parsed:
        return []
    content = content_marginals([nodes for nodes, _ in parsed], weight, pair) >= 0.5
    texts, base = [], 0
    for nodes, blocks in parsed:
        own = content[base : base + len(nodes)].tolist()
        texts.append("\n".join(text for block in blocks if (text := block_text(block, own.__getitem__))))
        base += len(nodes)
    return texts


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``: the article's blocks in page order, a line each.

    A block's pieces that are no content, such as a marked advert inside a sentence, are left out of it. The model is fitted on the driver, on TRAINING_PAGES generated pages, and its few numbers go
    with the tasks; every page is one tree there. Nothing is shuffled, and memory follows the longest page.
    Null and empty html give an empty text. Repeated rows, and rows without an id or url, are extracted each. An
    empty table gives an empty result; further columns aren't read.
    """
    weight, pair = fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "h", 1_000_000):
            texts = main_texts(batch.column(2).to_pylist(), weight, pair)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"), F.col(html_col).alias("h"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_tree_model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
