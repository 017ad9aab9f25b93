"""Markup residue in text: HTML, Markdown, wiki and LaTeX told from ordinary chat signs, and turned into clean text.

A message is parsed into a tree: the root, below it every construct that might be markup (tag pairs, links, headings, formulas,
actions in asterisks, asides, arrows ...), nested as written. Each node has a hidden state, ordinary or one of four markups. A node's
shape speaks for its state; parent-child potentials tie the states of nested constructs and of the constructs of one message. Sum-product
messages go up the tree and down again and give each node's marginal. Shapes and potentials are counted on labelled
pages: a table of them, or LABELLED_PAGES that a generator writes from the rules of the four languages and from chat signs (seeded).

Headings, lists, code, tables and formulas stay as structure in the clean text; other marks go, their text stays.

Defined results: null stays null; empty and blank texts have no markup and stay as they are; trees of the same shape are computed once;
very long texts take time in proportion to their nodes; constructs may nest without limit;
repeated rows are judged each; an empty table gives no rows; of equal marginals the ordinary state counts; extra columns are ignored.
"""

from __future__ import annotations

import html
import json
import random
import re
import sys
from collections import Counter, deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread
from .forms import consistent_form

STATES = ("chat", "html", "markdown", "wiki", "latex")
LABELLED_PAGES = 4_000
MOST_PAGES = 100_000  # labelled pages that the driver takes from a table
CACHE = 100_000

# Element names of HTML, and those that have no end tag.
TAGS = frozenset("a abbr article aside b big blockquote body br center cite code col dd del details div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd li link main mark meta nav ol p pre q s samp script section small span strike strong style sub summary sup table tbody td tfoot th thead title tr tt u ul var video".split())
VOID = frozenset("br col hr img input link meta".split())

_master = re.compile(
    r"""
    (?P<fence>^[ \t]*(?:```|~~~)[^\n]*\n(?:.*?\n)??[ \t]*(?:```|~~~)[ \t]*$)
  | (?P<comment><!--.*?(?:-->|\Z))
  | (?P<wtable>^\{\|.*?^\|\})
  | (?P<env>\\begin\{(?P<envname>[A-Za-z]+\*?)\}.*?\\end\{(?P=envname)\})
  | (?P<halfenv>\\(?:begin|end)\{[A-Za-z]+\*?\})
  | (?P<mdtable>^\|[^\n]*\|[ \t]*\n\|[ \t:|-]*-[ \t:|-]*\|[ \t]*(?:\n\|[^\n]*\|[ \t]*)*$)
  | (?P<bmath>\\\[[^\[\]\n]*?\\\])
  | (?P<pmath>\\\([^\n]*?\\\))
  | (?P<dmath>\$\$[^$]+\$\$)
  | (?P<dollar>(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\])\$(?![\d$]))
  | (?P<tag></?[A-Za-z][A-Za-z0-9-]*(?:[ \t\n]+[A-Za-z:@_-][^<>]*)?[ \t]*/?>)
  | (?P<entity>&(?:[A-Za-z][A-Za-z0-9]{1,31}|\#[0-9]{1,7}|\#[xX][0-9a-fA-F]{1,6});)
  | (?P<image>!\[[^\[\]\n]*\]\([^()\s]+(?:[ ]"[^"\n]*")?\))
  | (?P<link>\[[^\[\]\n]+\]\([^()\s]+(?:[ ]"[^"\n]*")?\))
  | (?P<dbracket>\[\[[^\[\]\n]+\]\])
  | (?P<dcurly>\{\{[^{}]*\}\})
  | (?P<cmd>\\[A-Za-z]{2,}\*?(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})*)
  | (?P<head>^[ ]{0,3}\#{1,6}[ \t]+\S[^\n]*$)
  | (?P<eqhead>^={2,6}[ \t]*[^=\s][^=\n]*?[ \t]*={2,6}[ \t]*$)
  | (?P<quote>^>[^\n]*(?:\n>[^\n]*)*)
  | (?P<list>^[ \t]*(?:[-+*]|\d{1,3}[.)])[ \t]+\S[^\n]*(?:\n[ \t]*(?:[-+*]|\d{1,3}[.)])[ \t]+\S[^\n]*)*)
  | (?P<rule>^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$)
  | (?P<tick>`[^`\n]+`)
  | (?P<star2>\*\*(?=[^\s*])[^\n]*?(?<=\S)\*\*)
  | (?P<under2>(?<![A-Za-z0-9_])__(?=[^\s_])[^\n]*?(?<=\S)__(?![A-Za-z0-9_]))
  | (?P<tilde2>~~(?=[^\s~])[^\n]*?(?<=\S)~~)
  | (?P<quote3>'''(?=[^\s'])[^\n]*?(?<=\S)''')
  | (?P<quote2>(?<!')''(?=[^\s'])[^\n]*?(?<=[^\s'])''(?!'))
  | (?P<aside>\[[^\[\]\n]*\])
  | (?P<star1>\*(?=[^\s*])[^*\n]*(?:\*\*[^*\n]+\*\*[^*\n]*)*(?<=\S)\*)
  | (?P<under1>(?<![A-Za-z0-9_])_(?=[^\s_])[^_\n]*(?<=[^\s_])_(?![A-Za-z0-9_]))
  | (?P<heart><3+)
  | (?P<compare>(?<=[\d\s])[<>]=?[ ]?\d)
  | (?P<arrow><?[-=]{1,2}>)
  | (?P<wave>\\[a-z]/)
  | (?P<money>\$\d[\d.,]*)
  | (?P<file>\b[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+)
    """,
    re.X | re.M | re.S,
)
_signs = re.compile(r"[<>&\[\]{}\\$#`_~|=]|''|\*\*|^[ \t]*(?:[-+*]|\d{1,3}[.)])[ \t]", re.M)
_marker = re.compile(r"[ \t]*(?:[-+*]|\d{1,3}[.)])[ \t]+")
_tag = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)")
_namespace = re.compile(r"\[\[\s*:?[A-Za-z]+:")
_mathy = re.compile(r"[\\^_{}=]")
# how many characters of a construct stand before and after its inside
_wraps = {"star2": (2, 2), "under2": (2, 2), "tilde2": (2, 2), "quote3": (3, 3), "quote2": (2, 2), "star1": (1, 1), "under1": (1, 1), "aside": (1, 1)}


class Node:
    __slots__ = ("kind", "shape", "start", "end", "inside", "children")

    def __init__(self, kind: str, shape: str, start: int, end: int):
        self.kind, self.shape, self.start, self.end = kind, shape, start, end
        self.inside: list[tuple[int, int]] = []
        self.children: list[Node] = []


def _shape(kind: str, found: str) -> str:
    if kind == "tag":
        name = _tag.match(found)[2].lower()
        return f"tag:{'known' if name in TAGS else 'other'}"
    if kind == "entity":
        return "entity:known" if html.unescape(found) != found else "entity:other"
    if kind == "dbracket":
        return "dbracket:space" if _namespace.match(found) else "dbracket:pipe" if "|" in found else "dbracket:plain"
    if kind == "dcurly":
        name = consistent_form(found).strip("{} \t\n").lower()
        return "dcurly:macro" if name in ("user", "char") else "dcurly:fields" if "|" in name else "dcurly:other"
    if kind == "dollar":
        return "dollar:math" if _mathy.search(found) else "dollar:plain"
    if kind == "cmd":
        return "cmd:filled" if "{" in found else "cmd:bare"
    if kind in ("list", "quote"):
        return f"{kind}:{'many' if chr(10) in found else 'one'}"
    return kind


def _insides(text: str, m: re.Match, kind: str) -> list[tuple[int, int]]:
    """The stretches of a construct in which others may stand."""
    start, end = m.span()
    if kind in _wraps:
        a, b = _wraps[kind]
        return [(start + a, end - b)]
    if kind in ("quote", "list"):
        out, at = [], start
        for line in m.group().split("\n"):
            skip = _marker.match(line).end() if kind == "list" else 2 if line.startswith("> ") else 1
            out.append((min(at + skip, at + len(line)), at + len(line)))
            at += len(line) + 1
        return out
    if kind in ("head", "eqhead"):
        line = m.group()
        left = len(line) - len(line.lstrip(" #\t" if kind == "head" else "= \t"))
        right = len(line.rstrip() if kind == "head" else line.rstrip("= \t"))
        return [(start + left, start + max(left, right))]
    return [(start + 1, text.index("](", start))] if kind == "link" else []


def _scan(text: str) -> list[Node]:
    """The tree below the root; stretches are scanned in the order found, so that a text may nest as deep as it likes."""
    root: list[Node] = []
    work = deque([(root, 0, len(text))])
    while work:
        into, lo, hi = work.popleft()
        found = []
        for m in _master.finditer(text, lo, hi):
            kind = m.lastgroup if m.lastgroup != "envname" else "env"
            node = Node(kind, _shape(kind, m.group()), *m.span())
            node.inside = _insides(text, m, kind)
            work += [(node.children, a, b) for a, b in node.inside if a < b]
            found.append(node)
        into += _paired(text, found)
    return root


def _paired(text: str, nodes: list[Node]) -> list[Node]:
    """Sibling start and end tags become one node around what stands between them."""
    if not any(n.kind == "tag" for n in nodes):
        return nodes
    out: list[Node] = []
    open_tags: list[tuple[str, int]] = []  # name, place in out
    for n in nodes:
        if n.kind == "tag":
            closing, name = _tag.match(text, n.start).groups()
            name = name.lower()
            if closing:
                at = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == name), None)
                if at is not None:
                    place = open_tags[at][1]
                    del open_tags[at:]
                    first = out[place]
                    pair = Node("pair", "pair:" + n.shape[4:], first.start, n.end)
                    pair.inside = [(first.end, n.start)]
                    pair.children = out[place + 1 :]
                    out[place:] = [pair]
                    continue
            elif name not in VOID and text[n.end - 2] != "/":
                open_tags.append((name, len(out)))
        out.append(n)
    return out


def parse(text: str) -> list[Node]:
    """The root's children. Texts without any sign of markup have none and are not scanned."""
    return _scan(text) if _signs.search(text) else []


def in_order(nodes: list[Node]) -> list[tuple[Node, int]]:
    """The nodes of a tree, each before its children, with the place of its parent (0 for the root, so the first node is 1)."""
    out: list[tuple[Node, int]] = []
    stack = [(n, 0) for n in reversed(nodes)]
    while stack:
        node, parent = stack.pop()
        out.append((node, parent))
        stack += [(c, len(out)) for c in reversed(node.children)]
    return out


def signature(nodes: list[Node]) -> tuple:
    return tuple((n.shape, parent) for n, parent in in_order(nodes))


class Model:
    """Emissions of shapes and parent-child potentials, counted on labelled trees."""

    def __init__(self, pages: list[tuple[str, list[tuple[int, int, str]]]], smooth: float = 0.05):
        n = len(STATES)
        shapes: dict[str, np.ndarray] = {}
        families: dict[str, np.ndarray] = {}
        self.link, self.prior = np.full((n, n), smooth), np.full(n, smooth)
        at = {s: i for i, s in enumerate(STATES)}

        for text, spans in pages:
            labels = Counter(label for _, _, label in spans if label != "chat")
            states = [at[labels.most_common(1)[0][0]] if labels else 0]
            self.prior[states[0]] += 1
            for node, parent in in_order(parse(text)):
                state = at[next((label for a, b, label in spans if a <= node.start < b), "chat")]
                states.append(state)
                shapes.setdefault(node.shape, np.full(n, smooth))[state] += 1
                families.setdefault(node.shape.partition(":")[0], np.full(n, smooth))[state] += 1
                self.link[states[parent], state] += 1
        total = sum(shapes.values(), np.zeros(n))
        self.link /= self.link.sum(1, keepdims=True)
        self.prior /= self.prior.sum()
        self.shapes = {k: v / total for k, v in shapes.items()}
        self.families = {k: v / total for k, v in families.items()}
        self.cache: dict[tuple, list[np.ndarray]] = {}

    def emission(self, shape: str) -> np.ndarray:
        if shape in self.shapes:
            return self.shapes[shape]
        return self.families.get(shape.partition(":")[0], np.full(len(STATES), 1 / len(STATES)))

    def marginals(self, sig: tuple) -> list[np.ndarray]:
        """Marginals of the nodes in the order they open, by one pass up and one pass down."""
        if (known := self.cache.get(sig)) is not None:
            return known
        shapes: list[str | None] = [None, *(shape for shape, _ in sig)]
        parents = [-1, *(parent for _, parent in sig)]
        here = [self.prior if s is None else self.emission(s) for s in shapes]
        up = [h.copy() for h in here]
        sent: list[np.ndarray] = [np.ones(len(STATES))] * len(shapes)
        for i in range(len(shapes) - 1, 0, -1):  # children come after their parents
            up[i] /= up[i].sum()
            sent[i] = self.link @ up[i]
            up[parents[i]] = up[parents[i]] * sent[i]
            up[parents[i]] /= up[parents[i]].sum()
        down: list[np.ndarray] = [np.ones(len(STATES))] * len(shapes)
        out = [up[0] / up[0].sum()]
        for i in range(1, len(shapes)):
            p = parents[i]
            whole = up[p] * (down[p] if p else 1.0)
            apart = whole / np.maximum(sent[i], 1e-300)
            down[i] = (apart / apart.sum()) @ self.link
            belief = up[i] * down[i]
            out.append(belief / belief.sum())
        if len(self.cache) < CACHE:
            self.cache[sig] = out[1:]
        return out[1:]


def labelled_pages(n: int = LABELLED_PAGES, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Pages with labelled spans (start, end, state), written from the rules of each language and from chat signs."""
    rng = random.Random(seed)
    words = "river stone walks under old lamp keeps quiet gate north wind finds road small bell turns".split()
    w = lambda: rng.choice(words)
    line = lambda: " ".join(w() for _ in range(rng.randint(2, 7)))
    d = lambda: rng.randint(2, 90)
    pair = lambda t, x: f"<{t}>{x}</{t}>"
    kinds: dict[str, list[Callable[[], str]]] = {
        "html": [
            lambda: pair(rng.choice(["b", "i", "em", "strong", "u", "sup", "small", "code", "p", "blockquote"]), line()),
            lambda: f"<font color='#{d()}'>{w()}</font>", lambda: f'<div class="x-{d()}">{line()}</div>', lambda: f"<p>{line()}</p>\n<p>{line()}</p>",
            lambda: f"<ul>\n<li>{w()}</li>\n<li>{line()}</li>\n</ul>", lambda: f"<table><tr><td>{w()}</td><td>{d()}</td></tr></table>",
            lambda: f"<details><summary>{w()}</summary>{line()}</details>", lambda: f"{line()}<br>", lambda: "</span>", lambda: "<div>", lambda: f'<a href="x">{w()}', lambda: "<br/>",
            lambda: f"<!-- {w()}: {w()} -->", lambda: w() + rng.choice(["&amp;", "&nbsp;", "&#9;", "&quot;", "&lt;", "&#x27;", "&hellip;"]), lambda: "<x-note>", lambda: f"<p>*{line()}* {line()}</p>",
        ],
        "markdown": [
            lambda: f"**{line()}**", lambda: f"__{w()}__", lambda: f"~~{w()}~~", lambda: f"`{w()}`", lambda: f"\n```\n{w()} = {d()}\n```\n", lambda: f"\n{'#' * rng.randint(1, 5)} {line()}\n",
            lambda: "\n" + "\n".join(f"{rng.choice('-+')} {line()}" for _ in range(rng.randint(2, 4))) + "\n", lambda: "\n" + "\n".join(f"{i}. {line()}" for i in range(1, rng.randint(3, 5))) + "\n",
            lambda: f"[{w()}](https://{w()}.invalid/{w()})", lambda: f"![{w()}](img/{w()}_{d()}.png)", lambda: f"\n> {line()}\n\n", lambda: f"\n> {line()}\n> {line()}\n\n", lambda: f"\n| {w()} | {w()} |\n|---|---|\n| {w()} | {d()} |\n",
            lambda: f"\n- {line()}\n", lambda: f"_{line()}_", lambda: "\n---\n", lambda: f"\n# *{line()}*\n", lambda: f"\n> *{line()}* {line()}\n\n",
        ],
        "wiki": [
            lambda: f"[[{w()}]]", lambda: f"[[{w()} ({w()})|{w()}]]", lambda: f"[[Category:{w()}]]", lambda: f"[[File:{w()}.png|thumb]]", lambda: f"{{{{{w()} place|name={w()}|pop={d()}}}}}", lambda: "{{stub}}",
            lambda: f'\n{{| class="plain"\n|-\n| {w()} || {d()}\n|}}\n', lambda: f"\n== {line()} ==\n", lambda: f"\n=== {w()} ===\n", lambda: f"'''{w()}'''", lambda: f"''{line()}''",
        ],
        "latex": [
            lambda: f"\\textbf{{{line()}}}", lambda: f"\\emph{{{w()}}}", lambda: f"\\section{{{w()}}}", lambda: f"\\begin{{itemize}}\n\\item {line()}\n\\item {w()}\n\\end{{itemize}}", lambda: f"\\(\\frac{{{d()}}}{{{d()}}}\\)",
            lambda: f"\\[ E = \\sqrt{{{d()}x + {d()}}} \\]", lambda: f"$t_{{{d()}}} = {d()}n^2$", lambda: f"$${w()} = \\alpha$$", lambda: "$x$", lambda: "\\alpha", lambda: "\\item", lambda: f"\\end{{{w()}}}",
        ],
        "chat": [
            lambda: f"*{line()}*", lambda: "{{user}}", lambda: "{{char}}", lambda: f"[OOC: {line()}]", lambda: f"[Status: {w()} | HP {d()}]", lambda: "<3", lambda: f" {d()} < {d()}", lambda: f" {d()} > {d()}", lambda: "->", lambda: "<--", lambda: "=>",
            lambda: "\\o/", lambda: f"${d()}", lambda: f"It cost ${d()}, then ${d()}.", lambda: f"{w()}_{d()}_final", lambda: f"\n- {line()}\n", lambda: "\n- I do.\n", lambda: "\n***\n", lambda: f"_{w()}_",
        ],
    }
    pages = []
    for _ in range(n):
        own = rng.choices(STATES, [6, 1.5, 1.5, 1.5, 1.5])[0]
        parts: list[tuple[str, str]] = []
        for _ in range(rng.randint(1, 4)):
            parts.append((line() + ". ", "chat"))
            label = own if rng.random() < 0.6 else "chat" if rng.random() < 0.85 else rng.choice(STATES)
            parts.append((rng.choice(kinds[label])(), label))
            parts.append((" ", "chat"))
        text, spans = "", []
        for piece, label in parts:
            if label != "chat" and not set("\n*") & set(piece) and rng.random() < 0.3:  # a mark inside an action
                spans.append((len(text), len(text) + 1, "chat"))
                text += f"*{w()} "
                spans.append((len(text), len(text) + len(piece), label))
                text += f"{piece} {w()}*"
                continue
            # an action inside a marked passage stays ordinary
            spans += [(len(text) + m.start(), len(text) + m.end(), "chat") for m in re.finditer(r"(?<!\*)\*[^*\n]+\*(?!\*)", piece) if label != "chat"]
            spans.append((len(text), len(text) + len(piece), label))
            text += piece
        pages.append((text, spans))
    return pages


@lru_cache(maxsize=2)
def model(pages: str | None = None) -> Model:
    """The model counted on labelled pages (JSON of [text, [[start, end, state], ..]]), or on generated ones."""
    return Model(labelled_pages() if pages is None else [(t, [tuple(x) for x in spans]) for t, spans in json.loads(pages)])


def judged_tree(text: str, m: Model) -> tuple[list[Node], dict[int, int], set[str]]:
    """The tree, the state of each node by its id, and the markups present."""
    nodes = parse(text)
    states: dict[int, int] = {}
    present: set[str] = set()
    if nodes:
        for (node, _), belief in zip(in_order(nodes), m.marginals(signature(nodes))):
            state = states[id(node)] = int(np.argmax(belief))
            if state:
                present.add(STATES[state])
    return nodes, states, present


def markups(text: str | None, m: Model) -> list[str]:
    return sorted(judged_tree(text, m)[2]) if text else []


_latex_heads = {"section": "# ", "section*": "# ", "chapter": "# ", "subsection": "## ", "subsubsection": "### "}
_cmd = re.compile(r"\\([A-Za-z]+\*?)(?:\[[^\]]*\])?((?:\{[^{}]*\})*)")
_blocks = frozenset("p div table tr ul ol details summary blockquote section article header footer center".split())


def _render(text: str, lo: int, hi: int, nodes: list[Node], states: dict[int, int]) -> str:
    out, at = [], lo
    for n in nodes:
        out.append(text[at : n.start])
        out.append(_clean_node(text, n, states))
        at = n.end
    out.append(text[at:hi])
    return "".join(out)


def _inside(text: str, n: Node, states: dict[int, int]) -> list[str]:
    return [_render(text, a, b, [c for c in n.children if a <= c.start < b], states) for a, b in n.inside]


def _rows(lines: list[str], cut: str) -> str:
    rows = [[c.strip() for c in re.split(cut, x.strip().strip("|")) if c.strip()] for x in lines]
    return "\n".join(" | ".join(r) for r in rows if r)


def _clean_node(text: str, n: Node, states: dict[int, int]) -> str:
    raw, state, kind = text[n.start : n.end], STATES[states[id(n)]], n.kind
    if state == "chat":
        if not n.children:
            return raw
        return _render(text, n.start, n.end, n.children, states)
    inner = _inside(text, n, states)
    if kind == "pair":
        name = _tag.match(raw)[2].lower()
        body = inner[0]
        if re.fullmatch(r"h[1-6]", name):
            return f"\n{'#' * int(name[1])} {body.strip()}\n"
        if name == "li":
            return f"- {body.strip()}"
        if name in ("td", "th"):
            return f"{body.strip()} | "
        if name == "pre":
            return f"\n```\n{body.strip(chr(10))}\n```\n"
        if name in ("code", "kbd", "samp", "tt"):
            return f"`{body}`"
        if name in ("script", "style"):
            return ""
        if name == "tr":
            return body.strip().removesuffix("|").rstrip() + "\n"
        return f"\n{body.strip()}\n" if name in _blocks else body
    if kind == "tag":
        name = _tag.match(raw)[2].lower()
        return "\n" if name in _blocks or name in ("br", "hr") else "- " if name == "li" and raw[1] != "/" else ""
    if kind == "comment":
        return ""
    if kind == "entity":
        return html.unescape(raw).replace("\xa0", " ")
    if kind in ("star2", "under2", "tilde2", "quote3", "quote2", "under1", "link"):
        return inner[0]
    if kind == "head":
        return f"{'#' * raw.count('#', 0, 9)} {inner[0].strip()}"
    if kind == "eqhead":
        return f"{'#' * (len(raw) - len(raw.lstrip('=')))} {inner[0].strip()}"
    if kind == "list":
        return "\n".join(f"{(m := _marker.match(x)).group()}{y}" for x, y in zip(raw.split("\n"), inner))
    if kind == "quote":
        return "\n".join(f"> {x}" for x in inner)
    if kind == "image":
        return raw[2 : raw.index("](")]
    if kind == "mdtable":
        return _rows([x for x in raw.split("\n") if not re.fullmatch(r"[|:\- \t]+", x)], r"\|")
    if kind == "wtable":
        return _rows([x for x in raw.split("\n") if x[:2] not in ("{|", "|-", "|}")], r"\|\||!!")
    if kind == "dbracket":
        return "" if n.shape == "dbracket:space" else raw[2:-2].rpartition("|")[2]
    if kind == "dcurly":
        return ", ".join(x.strip() for x in raw[2:-2].split("|")[1:])
    if kind in ("bmath", "pmath", "dmath"):
        return f"${raw[2:-2].strip()}$"
    if kind == "env":
        body = raw[raw.index("}") + 1 : raw.rindex("\\end")].strip("\n")
        if n.shape and re.match(r"\\begin\{(?:equation|align|math|displaymath|gather)", raw):
            return f"${body.strip()}$"
        body = re.sub(r"[ \t]*\\item[ \t]*", "- ", body)
        return _cmd.sub(lambda m: m[2][1:-1] if m[2] else "", body)
    if kind == "halfenv":
        return ""
    if kind == "cmd":
        m = _cmd.match(raw)
        if m[1] == "item":
            return "- "
        text_ = m[2].strip("{}").replace("}{", " ")
        return _latex_heads.get(m[1], "") + text_ if m[2] else ""
    return raw  # code, fences, formulas in dollars and rules are structure


def clean(text: str | None, m: Model) -> str | None:
    """The text without markup residue; headings, lists, code, tables and formulas kept."""
    if not text:
        return text
    nodes, states, present = judged_tree(text, m)
    if not present:
        return text
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(states) + 1000))  # a tree is rendered as deep as it is
    return re.sub(r"\n{3,}", "\n\n", _render(text, 0, len(text), nodes, states)).strip("\n")


def _find(pages: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(pages)
        for b in batches:
            rows = [(i, k) for i, t in zip(b.column("msg_id").to_pylist(), b.column("mes").to_pylist()) for k in markups(t, m)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([k for _, k in rows], pa.string())], names=["msg_id", "markup"])

    return run


def _cleaned(pages: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(pages)
        for b in batches:
            texts = b.column("mes").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("msg_id"), pa.array([clean(t, m) for t in texts], pa.string())], names=["msg_id", "text"])

    return run


def _taken(pages: DataFrame | None) -> str | None:
    """Labelled pages (text, spans array<struct<start, end, state>>) as JSON, or None; more than MOST_PAGES are refused."""
    if pages is None:
        return None
    rows = pages.select("text", "spans").filter("text IS NOT NULL").orderBy("text").limit(MOST_PAGES + 1).collect()
    if len(rows) > MOST_PAGES:
        raise ValueError(f"more than {MOST_PAGES} labelled pages")
    return json.dumps([(r.text, [tuple(x) for x in r.spans or ()]) for r in rows])


def present_markups(messages: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(msg_id, markup): one row for each kind of markup present in a message."""
    return spread(messages.select("msg_id", "mes")).mapInArrow(_find(_taken(pages)), "msg_id long, markup string")


def clean_texts(messages: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(msg_id, text) of every message, cleaned."""
    return spread(messages.select("msg_id", "mes")).mapInArrow(_cleaned(_taken(pages)), "msg_id long, text string")
