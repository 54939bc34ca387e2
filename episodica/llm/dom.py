"""Elements of an HTML page as a tree, each with its own text."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

# Elements by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body center datalist dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Without a text that is shown: up to the end tag or, where that is missing, nothing (of the first) or the rest of the page (of the second).
HIDDEN = frozenset("template svg audio video canvas map".split())
RAW = frozenset("script style title iframe textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed head hr img input link meta param source track wbr".split())
#: Controls, in which no block stands: one closes them.
CONTROLS = frozenset("button select datalist optgroup option".split())
_CHOICES = CONTROLS - {"button"}
#: A link that was never closed doesn't reach into these.
_PARTS = ("article", "main", "section", "body")
#: A start tag of the first closes an open element of the second, up to the nearest of the third.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "button": (("button",), ()),
    "a": (("a",), ()),
}
#: An attribute as the HTML standard reads it: a name, in which a quote is a character, and after = a quoted value or one up to white space or >. The pattern
#: takes any text but >, so it never goes back.
_NAME, _VALUE = r"(?:=[^\s/>=]*|[^\s/>=]+)", r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]++|{_NAME}(?:\s*+=\s*+(?:{_VALUE})?+)?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>][^\s>]*))?)?")
_TELLING = re.compile(r"(?i)(?:^|[\s/\"'])(?:class|id|role|hidden|style|aria-hidden)(?:[\s=]|$)")
#: What pages say around an article, not in it.
_CUE = re.compile(
    r"(?i)^\W*(?:advertisement|sponsored|related|recommended|most (?:read|popular)|more (?:from|stories)|share (?:this|on)|follow us|subscribe|sign (?:up|in)|log ?in|newsletter|leave a (?:comment|reply)|\d* ?comments?|copyright|©|menu|search|skip to|you may also)\b"
    r"|all rights reserved|(?:uses?|accept) cookies|privacy policy|terms of (?:use|service)"
)
Piece = tuple[int, str]


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attributes: str = ""
    chars: int = 0
    linked: int = 0
    ends: int = 0  # full stops and the like
    pieces: int = 0
    cue: bool = False
    inline: bool = False
    classes: list[str] = field(default_factory=list)
    hidden: bool = False


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


class _Stack:
    """Open elements as (tag, node, whether a block), with the places of each tag, so that no lookup walks it."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int, bool]] = [("", 0, True)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks = [0]

    def push(self, tag: str, node: int, block: bool) -> None:
        self.places[tag].append(len(self.open))
        if block:
            self.blocks.append(len(self.open))
        self.open.append((tag, node, block))

    def last(self, tags: tuple[str, ...] | frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, at: int) -> None:
        for tag, _, block in self.open[at:]:
            self.places[tag].pop()
            if block:
                self.blocks.pop()
        del self.open[at:]


def parse_pieces(page: str) -> tuple[list[Node], list[list[Piece]]]:
    """The elements in page order (the first is a root), and the blocks of text in page order, each as its pieces (node, text).

    Nodes are block elements, controls, and inline elements that carry a class, a role or the like; the text of other inline elements
    belongs to the node around them. What isn't shown (scripts, styles, the title) has no text. Broken markup is mended as far as the
    common rules for implied end tags go; an end tag without a start is ignored. Time and memory follow the page's length.
    """
    nodes, stack, blocks, run = [Node("root", -1, 0)], _Stack(), [], []
    missing: set[str] = set()
    at = 0

    def flush() -> None:
        nonlocal run
        if run:
            pieces: list[list] = []
            for node, text, linked in run:
                if pieces and pieces[-1][0] == node and pieces[-1][2] == linked:
                    pieces[-1][1].append(text)
                else:
                    pieces.append([node, [text], linked])
            run = []
            block = []
            for node, texts, linked in pieces:
                text = re.sub(r"\s+", " ", html.unescape("".join(texts)))
                x, shown = nodes[node], len(text.strip())
                x.chars += shown
                x.linked += shown * linked
                x.ends += sum(map(text.count, ".!?"))
                block.append((node, text))
            if any(text.strip() for _, text in block):
                blocks.append(block)
                first = nodes[block[0][0]]
                first.pieces += 1
                first.cue |= bool(_CUE.search("".join(t for _, t in block).strip()[:200]))

    def close(place: int) -> None:
        if place:
            flush()
            stack.cut(place)

    def begin(tag: str, raw: str, block: bool) -> None:
        parent = stack.open[-1][1]
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, raw, inline=not block))
        stack.push(tag, len(nodes) - 1, block)

    page = page.replace("\0", "")
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            run.append((stack.open[-1][1], text, stack.last(("a",)) > stack.last(_PARTS)))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                run.append((stack.open[-1][1], html.escape(m[0][9:].removesuffix("]]>")), False))
            continue
        tag, ends = m[2].lower(), m[1] == "/"
        if tag in HIDDEN or tag in RAW:
            if not ends and not m[3].endswith("/"):
                shut = None if tag in missing else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if shut:
                    at = shut.end()
                elif tag in RAW:
                    break
                else:
                    missing.add(tag)
        elif tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                run.append((stack.open[-1][1], " ", False))
        elif tag in BLOCKS:
            if ends:
                flush()
                close(stack.last((tag,)))
                continue
            if tag not in CONTROLS and (place := stack.last(CONTROLS)):
                top = stack.blocks[-1]
                if stack.open[top][0] in _CHOICES or place > top:  # a control is open right here
                    choice = max(stack.last(("select",)), stack.last(("datalist",)))
                    close(min(choice or place, place))
            if stack.open[stack.blocks[-1]][0] == "p" and tag not in CONTROLS:
                close(stack.blocks[-1])
            if tag in _CLOSES:
                own, within = _CLOSES[tag]
                place = stack.last(own)
                close(place if place > stack.last(within) else 0)
            flush()
            begin(tag, m[3], True)
        elif ends:
            place = stack.last((tag,))
            if place > stack.blocks[-1]:
                stack.cut(place)
        elif not m[3].endswith("/"):
            if tag in _CLOSES and (place := stack.last(_CLOSES[tag][0])) > stack.blocks[-1]:
                stack.cut(place)
            if tag == "button" or _TELLING.search(m[3]):
                begin(tag, m[3], False)
            else:
                stack.push(tag, stack.open[-1][1], False)
    flush()
    for node in nodes:
        if node.attributes:
            found = attributes(node.attributes)
            names = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}")
            node.classes = re.findall(r"[a-z]+", names.lower())
            node.hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))
    return nodes, blocks


def block_text(block: list[Piece], content=lambda node: True) -> str:
    """The text of a block's pieces that are content, with white space as one space."""
    return " ".join("".join(text if content(node) else " " for node, text in block).split())


def parse(page: str) -> tuple[list[Node], list[Piece]]:
    """The elements, and the blocks of text as (first node, whole text)."""
    nodes, blocks = parse_pieces(page)
    return nodes, [(block[0][0], block_text(block)) for block in blocks]
