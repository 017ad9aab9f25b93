"""The boolean keyword language: lexer, parser, validator, evaluator, and compilation to Spark columns.

A key is a literal, a ``/pattern/flags``, or, with a leading ``?``, an expression of AND, OR, NOT, XOR, phrases, weights, optional
terms, proximity groups and patterns. Keys are read on the driver; what runs per row is either a compiled column
(``compile_match``) or the kernel ``evaluate`` inside an Arrow stage.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import QUOTE_FAMILIES, SPELLED, expand_macros, fold_text, has_macro, key_variants, mask_tags, ortho_text

MAX_DEPTH = 100
#: class of the characters of a word, by boundary mode
WORD_CLASS = {"strict": r"[\p{L}\p{N}\p{M}\-'’]", "permissive": r"[\p{L}\p{N}\p{M}]"}
REGEX_KEY = re.compile(r"/([\s\S]+)/([dgimsuvy]*)\Z")

# Alert codes with their severities.
ALERTS = {
    "no-terms": "error", "negation-only": "error", "no-required-term": "error", "always-true": "error", "too-deep": "error", "stray-weight": "error",
    "stray-proximity": "error", "proximity-on-phrase": "error", "stray-quote": "error", "regex-invalid": "error", "punctuation-term": "warn",
    "unbalanced-parens": "warn", "all-zero-weights": "warn", "regex-decomposed": "warn", "flag-on-pattern": "warn", "optional-inert": "info",
    "regex-core-refuses": "info",
}


class TooDeep(ValueError):
    pass


@dataclass
class Node:
    op: str  # TERM REGEX NOT AND OR XOR
    value: str = ""
    kids: tuple[Node | None, ...] = ()
    exact: bool = False
    cased: bool = False
    quoted: bool = False
    weight: float = 1.0
    group: float = 1.0
    near: int | None = None
    optional: bool = False


@dataclass
class Token:
    kind: str  # TERM REGEX ( ) AND OR NOT XOR
    node: Node | None = None
    exact: bool = False
    cased: bool = False
    weight: float | None = None
    near: int | None = None
    optional: bool = False


# --- lexer -------------------------------------------------------------------------------------------------------------------

_sign = re.compile(r"&&|\|\||[&|+!-]")
_name = re.compile(r"(AND|OR|NOT|XOR)(?=[\s()]|\Z)", re.I)
_meaning = {"&&": "AND", "&": "AND", "+": "AND", "||": "OR", "|": "OR", "!": "NOT", "-": "NOT"}
_run = re.compile(r"[^\s()|&]+")
_suffix = re.compile(r"~(?P<near>\d+)|(?:::|\^)(?P<weight>\d+(?:\.\d+)?)|(?P<opt>\?)")
_tail_weight = re.compile(r"(.+?)(?:::|\^)(\d+(?:\.\d+)?)\Z", re.S)
_tail_near = re.compile(r"(.+?)~(\d+)\Z", re.S)
_after_pattern = re.compile(r"([dgimsuvy]*)(?=[\s()|&?]|::|\^|\Z)")


def _suffixes(s: str, at: int, allowed: str) -> tuple[dict[str, str], int]:
    """Suffixes of a group, phrase or pattern, each kind once, in any order."""
    found: dict[str, str] = {}
    while (m := _suffix.match(s, at)) and m.lastgroup in allowed.split() and m.lastgroup not in found:
        found[m.lastgroup] = m[m.lastgroup]
        at = m.end()
    return found, at


def _pattern_at(s: str, at: int) -> tuple[str, int] | None:
    """The pattern literal that opens at a slash: up to the first closing slash whose body compiles and whose flags end the token."""
    i, in_class = at + 1, False
    while i < len(s):
        c = s[i]
        if c == "\\":
            i += 2
            continue
        in_class = c == "[" or (in_class and c != "]")
        if c == "/" and not in_class and i > at + 1 and (m := _after_pattern.match(s, i + 1)) and compiled(f"{s[at:i]}/{m[1]}"):
            return s[at : m.end()], m.end()
        i += 1
    return (s[at:], len(s)) if REGEX_KEY.match(s[at:]) else None


def _unquoted(value: str) -> Node:
    """A bare term with its suffixes taken off its end."""
    node = Node("TERM", value)

    def option() -> None:
        if len(node.value) > 1 and node.value.endswith("?"):
            node.value, node.optional = node.value[:-1], True

    def weight() -> None:
        if m := _tail_weight.match(node.value):
            node.value, node.weight = m[1], float(m[2])

    option()
    weight()
    option()
    if has_macro(node.value):  # a macro may stand for several words, so it takes proximity as a group does
        if m := _tail_near.match(node.value):
            node.value, node.near = m[1], int(m[2])
        weight()
        option()
    return node


def tokenize(key: str) -> list[Token]:
    s = re.sub(r"\A\?", "", key).strip()
    out, at = [], 0
    while at < len(s):
        c = s[at]
        if c.isspace():
            at += 1
        elif c == "(":
            out.append(Token("("))
            at += 1
        elif c == ")":
            f, at = _suffixes(s, at + 1, "near weight opt")
            out.append(Token(")", weight=float(f["weight"]) if "weight" in f else None, near=int(f["near"]) if "near" in f else None, optional="opt" in f))
        elif m := _sign.match(s, at) or _name.match(s, at):
            out.append(Token(_meaning.get(m.group(), m.group().upper())))
            at = m.end()
        elif c == "/" and (found := _pattern_at(s, at)):
            f, at = _suffixes(s, found[1], "weight opt")
            out.append(Token("REGEX", Node("REGEX", found[0], weight=float(f.get("weight", 1)), optional="opt" in f)))
        else:
            flags = re.compile(r"[=^]{0,2}").match(s, at).group()
            at += len(flags)
            exact, cased = "=" in flags, "^" in flags
            opener = s[at : at + 1]
            if flags and opener == "(":
                out.append(Token("(", exact=exact, cased=cased))
                at += 1
                continue
            family = next((q for q in QUOTE_FAMILIES if opener and opener in q), None)
            close = next((i for i in range(at + 1, len(s)) if s[i] in family), -1) if family else -1
            if close >= 0:
                node = Node("TERM", s[at + 1 : close], quoted=True)
                f, at = _suffixes(s, close + 1, "near weight opt")
                node.weight, node.optional = float(f.get("weight", 1)), "opt" in f
                node.near = int(f["near"]) if "near" in f else None
            elif m := _run.match(s, at):
                node = _unquoted(m.group())
                at = m.end()
            else:
                at += not flags or 1
                continue
            if node.value:
                node.exact, node.cased = exact, cased
                out.append(Token("TERM", node))
    return out


# --- parser ------------------------------------------------------------------------------------------------------------------


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def kind(self) -> str:
        return self.tokens[self.at].kind if self.at < len(self.tokens) else ""

    def either(self, depth: int) -> Node | None:
        left = self.all_of(depth)
        while (op := self.kind()) in ("OR", "XOR"):
            self.at += 1
            left = _join(op, left, self.all_of(depth))
        return left

    def all_of(self, depth: int) -> Node | None:
        left = self.negated(depth)
        while self.kind() in ("AND", "TERM", "REGEX", "(", "NOT"):
            self.at += self.kind() == "AND"
            left = _join("AND", left, self.negated(depth))
        return left

    def negated(self, depth: int) -> Node | None:
        if self.kind() != "NOT":
            return self.primary(depth)
        if depth >= MAX_DEPTH:
            raise TooDeep(f"nested more than {MAX_DEPTH} deep")
        self.at += 1
        operand = self.negated(depth + 1)
        return Node("NOT", kids=(operand,)) if operand else None

    def primary(self, depth: int) -> Node | None:
        while self.kind() in ("AND", "OR", "XOR"):  # a binary sign in front of a term says nothing
            self.at += 1
        if not self.kind():
            return None
        t = self.tokens[self.at]
        self.at += 1
        if t.kind != "(":
            return replace(t.node) if t.node else None
        if depth >= MAX_DEPTH:
            raise TooDeep(f"nested more than {MAX_DEPTH} deep")
        node = self.either(depth + 1)
        end = self.tokens[self.at] if self.kind() == ")" else None
        self.at += end is not None
        if node:
            _flag(node, t.exact, t.cased)
            if end:
                node.optional |= end.optional
                node.group *= 1 if end.weight is None else end.weight
                node.near = end.near if node.near is None else node.near
        return node


def _join(op: str, left: Node | None, right: Node | None) -> Node | None:
    return Node(op, kids=(left, right)) if left and right else left or right


def _flag(node: Node | None, exact: bool, cased: bool) -> None:
    for n in walk(node):
        if n.op == "TERM":
            n.exact |= exact
            n.cased |= cased


def walk(node: Node | None) -> Iterator[Node]:
    if node:
        yield node
        for k in node.kids:
            yield from walk(k)


def parse(tokens: list[Token]) -> Node | None:
    return _Parser(tokens).either(0)


def _expanded(node: Node | None, macros: dict[str, str]) -> Node | None:
    if node is None:
        return None
    if node.op == "REGEX":
        body, flags = REGEX_KEY.match(node.value).groups()
        return replace(node, value=f"/{expand_macros(body, macros, escape=True)}/{flags}") if has_macro(node.value) else node
    if node.op == "TERM":
        if not has_macro(node.value):
            return node
        text = expand_macros(node.value, macros)
        words = [w for w in ([text] if node.quoted else text.split()) if w]
        if len(words) <= 1:
            return replace(node, value=words[0]) if words else None
        tree = None
        for w in words:
            tree = _join("AND", tree, replace(node, value=w, weight=1.0, group=1.0, near=None, optional=False))
        return replace(tree, near=node.near, group=node.group * node.weight, optional=node.optional)
    kids = tuple(_expanded(k, macros) for k in node.kids)
    if all(kids):
        return replace(node, kids=kids)
    return None if node.op == "NOT" else kids[0] or kids[1]


def build(key: str, macros: dict[str, str] | None = None) -> Node | None:
    """The tree of an expression key, macros replaced; raises TooDeep."""
    return _expanded(parse(tokenize(key)), macros or {})


def leaf(key: str, cased: bool = False, whole: bool = False, macros: dict[str, str] | None = None) -> Node | None:
    """A key of any kind as one node; a literal takes the entry's flags."""
    s = (key or "").strip()
    if not s:
        return None
    if s.startswith("?"):
        return build(s, macros)
    if m := REGEX_KEY.match(s):
        return Node("REGEX", f"/{expand_macros(m[1], macros or {}, escape=True)}/{m[2]}")
    value = expand_macros(s, macros or {})
    return Node("TERM", value, exact=whole, cased=cased, quoted=True) if value else None


AND_ANY, NOT_ALL, NOT_ANY, AND_ALL = range(4)


def gated(primary: str, secondary: list[str] | None, logic: int | None = AND_ANY, cased: bool = False, whole: bool = False, macros: dict[str, str] | None = None, excluded: list[str] | None = None) -> Node | None:
    """A primary key under its secondary gate and exclusions, as one tree. A secondary that reads as nothing never matches."""
    tree = leaf(primary, cased, whole, macros)
    if tree is None:
        return None
    gates = [leaf(k, cased, whole, macros) or Node("OR", kids=(None, None)) for k in secondary or () if (k or "").strip()]
    both = lambda a, b: Node("AND", kids=(a, b))
    no = lambda n: Node("NOT", kids=(n,))
    if gates:
        first, *more = gates
        if logic == NOT_ANY:
            for g in gates:
                tree = both(tree, no(g))
        else:
            for g in more:
                first = Node("AND" if logic in (NOT_ALL, AND_ALL) else "OR", kids=(first, g))
            tree = both(tree, no(first) if logic == NOT_ALL else first)
    for k in excluded or ():
        if node := leaf(k, cased, whole, macros):
            tree = both(tree, no(node))
    return tree


# --- validator ---------------------------------------------------------------------------------------------------------------


def _empty_matches(n: Node | None) -> bool:
    if n is None:
        return False
    if n.optional:
        return True
    below = [_empty_matches(k) for k in n.kids]
    return {"NOT": lambda: not below[0], "AND": lambda: all(below), "OR": lambda: any(below), "XOR": lambda: below[0] != below[1]}.get(n.op, lambda: False)()


def _asks_nothing(n: Node | None) -> bool:
    if n is None:
        return False
    below = [_asks_nothing(k) for k in n.kids]
    return n.optional or (n.op == "AND" and all(below)) or (n.op == "OR" and any(below))


def _core_reads(key: str) -> bool:
    m = re.match(r"/([\w\W]+?)/([gimsuy]*)\Z", key)
    return bool(m) and not re.search(r"(?:^|[^\\])/", m[1])


def _pattern_alerts(key: str) -> list[str]:
    body, _ = REGEX_KEY.match(key).groups()
    if not compiled(key):
        return ["regex-invalid"]
    return ["regex-decomposed"] * (unicodedata.normalize("NFC", body) != body) + ["regex-core-refuses"] * (not _core_reads(key))


@lru_cache(maxsize=65_536)
def validate(key: str | None) -> tuple[str, ...]:
    """Alert codes of a key, by its structure alone; ``ALERTS`` has their severities."""
    s = (key or "").strip()
    if not s.startswith("?"):
        return tuple(_pattern_alerts(s)) if REGEX_KEY.match(s) else ()
    tokens = tokenize(s)
    terms = [t.node for t in tokens if t.node]
    if not terms:
        return ("no-terms",)
    try:
        tree = parse(tokens)
    except TooDeep:
        return ("too-deep",)
    out = []
    nodes = list(walk(tree))
    negated = [n.kids[0] for n in nodes if n.op == "NOT"]
    optional_below = lambda n: any(x.optional for x in walk(n))
    if any(_asks_nothing(k) for n in nodes if n.op in ("OR", "XOR") for k in n.kids) or any(map(_asks_nothing, negated)):
        out.append("always-true")
    elif _empty_matches(tree):
        out.append("no-required-term" if optional_below(tree) else "negation-only")
    elif any(map(optional_below, negated)):
        out.append("optional-inert")
    for i, t in enumerate(tokens):
        n = t.node
        if n is None or n.op != "TERM":
            continue
        if not n.quoted and (re.fullmatch(r"(?:::|\^)\d+(?:\.\d+)?", n.value) or (n.cased and re.fullmatch(r"\d+(?:\.\d+)?", n.value))):
            out.append("stray-weight")
        if not n.quoted and i and tokens[i - 1].kind == ")" and re.fullmatch(r"~\d+", n.value):
            out.append("stray-proximity")
        if n.quoted and n.near is not None:
            out.append("proximity-on-phrase")
        if not n.quoted and not regex.search(r"[\p{L}\p{N}]", n.value):
            out.append("punctuation-term")
        if not n.quoted and any(n.value[0] in q for q in QUOTE_FAMILIES):
            out.append("stray-quote")
        if not n.quoted and (n.exact or n.cased) and REGEX_KEY.match(n.value):
            out.append("flag-on-pattern")
    for n in terms:
        if n.op == "REGEX":
            out += _pattern_alerts(n.value)
    if sum(t.kind == "(" for t in tokens) != sum(t.kind == ")" for t in tokens):
        out.append("unbalanced-parens")
    if all(n.weight == 0 for n in terms):
        out.append("all-zero-weights")
    return tuple(dict.fromkeys(out))


def fatal(key: str | None, spared: str | None = None) -> bool:
    return any(ALERTS[a] == "error" and a != spared for a in validate(key))


def usable_keys(keys: list[str | None] | None) -> list[str]:
    return [k for k in keys or () if (k or "").strip() and not fatal(k)]


def usable_secondary(keys: list[str | None] | None, selective: bool | None, logic: int | None) -> list[str]:
    """Secondary keys that take part; a gate of negations alone is only barred where any one of them would do."""
    if selective is False:
        return []
    spared = None if (logic or AND_ANY) == AND_ANY else "negation-only"
    return [k for k in keys or () if (k or "").strip() and not fatal(k, spared)]


# --- patterns ----------------------------------------------------------------------------------------------------------------

_ascii_word = "[A-Za-z0-9_]"
_escapes = {
    "w": "A-Za-z0-9_", "d": "0-9",
    "b": f"(?:(?<!{_ascii_word})(?={_ascii_word})|(?<={_ascii_word})(?!{_ascii_word}))", "B": f"(?:(?<!{_ascii_word})(?!{_ascii_word})|(?<={_ascii_word})(?={_ascii_word}))",
}


def _python_pattern(body: str) -> str:
    """A script pattern in Python's dialect: ASCII word classes, ends of text, empty negated classes."""
    out, i, in_class = [], 0, False
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            e = body[i + 1]
            if e in "wd":
                out.append(_escapes[e] if in_class else f"[{_escapes[e]}]")
            elif e in "WD":
                out.append(f"[^{_escapes[e.lower()]}]" if not in_class else body[i : i + 2])
            elif e in "bB" and not in_class:
                out.append(_escapes[e])
            elif e == "/":
                out.append("/")
            elif e == "u" and (m := re.match(r"\{([0-9A-Fa-f]+)\}", body[i + 2 :])):
                out.append(re.escape(chr(int(m[1], 16))))
                i += len(m.group())
            else:
                out.append(body[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class = c != "]"
            out.append("\\[" if c == "[" else c)
        elif c == "[":
            if body.startswith("[^]", i):
                out.append(r"[\s\S]")
                i += 3
                continue
            in_class = True
            out.append("[^" if body[i + 1 : i + 2] == "^" else "[")
            i += body[i + 1 : i + 2] == "^"
        else:
            out.append(c)
        i += 1
    return "".join(out)


@lru_cache(maxsize=4096)
def compiled(key: str) -> regex.Pattern | None:
    m = REGEX_KEY.match(key)
    if not m:
        return None
    body, flags = m.groups()
    if len(set(flags)) != len(flags) or {"u", "v"} <= set(flags):
        return None
    if "m" not in flags:
        body = re.sub(r"(?<!\\)\$(?=\Z|[)|])", r"\\Z", body)
    bits = (regex.I if "i" in flags else 0) | (regex.M if "m" in flags else 0) | (regex.S if "s" in flags else 0)
    try:
        return regex.compile(_python_pattern(body), bits | regex.V0)
    except regex.error:
        return None


def _runs(parsed, out: list[str]) -> None:
    """Runs of plain characters that every match of a parsed pattern holds."""
    run = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL" and chr(arg).isascii() and (chr(arg).isalnum() or arg == 32):
            run += chr(arg).lower()
            continue
        if name == "SUBPATTERN":
            inner: list[str] = []
            _runs(arg[-1], inner)
            out += inner
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            _runs(arg[2], out)
        out.append(run)
        run = ""
    out.append(run)


@lru_cache(maxsize=4096)
def required_literal(key: str, least: int = 3) -> str | None:
    """A run of ASCII letters, digits and blanks that each text a pattern key matches holds, case aside; None if none is certain."""
    m = REGEX_KEY.match(key)
    if not m or "x" in m[2]:
        return None
    try:
        runs: list[str] = []
        _runs(re._parser.parse(_python_pattern(m[1])), runs)
    except (re.error, OverflowError, RecursionError):
        return None
    best = max(runs, key=len, default="")
    return best if len(best.strip()) >= least else None


# --- evaluation --------------------------------------------------------------------------------------------------------------


class Segment:
    """A text as keys see it; each form is made once."""

    def __init__(self, text: str | None, mode: str = "strict"):
        self.raw, self.mode = text or "", mode
        self.nfc = self.raw if self.raw.isascii() else unicodedata.normalize("NFC", self.raw)
        self.ortho = ortho_text(mask_tags(self.nfc))
        self.folded = self.ortho.lower()
        self._places: list[int] | None = None
        self._cache: dict[tuple, list[tuple[int, int]]] = {}

    def place(self, i: int) -> int:
        """Place in the composed text of a place in the respelled one."""
        if len(self.ortho) == len(self.nfc):
            return i
        if self._places is None:
            wide = {sign: len(plain) for sign, plain in SPELLED}
            self._places = [k for k, c in enumerate(self.nfc) for _ in range(wide.get(c, 1))] + [len(self.nfc)]
        return self._places[min(i, len(self._places) - 1)]

    def spans(self, node: Node) -> list[tuple[int, int]]:
        """Places of a leaf's occurrences in the composed text, not overlapping, from the left."""
        key = (node.op, node.value, node.exact, node.cased)
        if key not in self._cache:
            if node.op == "REGEX":
                p = compiled(node.value)
                # without a time limit: a match must not depend on the machine's speed
                self._cache[key] = [m.span() for m in p.finditer(self.nfc)] if p else []
            else:
                hay = self.ortho if node.cased else self.folded
                p = term_pattern(node.value, node.exact, node.cased, self.mode)
                self._cache[key] = [(self.place(m.start()), self.place(m.end() - 1) + 1) for m in p.finditer(hay)] if p else []
        return self._cache[key]


def boundaries(mode: str) -> tuple[str, str]:
    w = WORD_CLASS[mode]
    return rf"(?:(?<!{w})|(?<=--))", rf"(?:(?!{w})|(?=--))"


@lru_cache(maxsize=65_536)
def term_pattern(value: str, exact: bool, cased: bool, mode: str) -> regex.Pattern | None:
    forms = [f for f in (v if cased else v.lower() for v in key_variants(value)) if f]
    if not forms:
        return None
    body = "|".join(regex.escape(f, special_only=True) for f in forms)
    before, after = boundaries(mode) if exact else ("", "")
    return regex.compile(f"{before}(?:{body}){after}")


@dataclass
class Result:
    matched: bool = False
    units: list[tuple[object, float, int]] = field(default_factory=list)  # (what, weight x occurrences, occurrences)
    log_weight: float = 0.0

    @property
    def boost(self) -> float:
        return sum(w for _, w, _ in self.units)


def _log(w: float) -> float:
    return math.log(w) if w > 0 else 0.0


def _unit(what: object, mass: float, n: int) -> list[tuple[object, float, int]]:
    return [(what, mass, n)] if mass > 0 and n > 0 else []


def evaluate(node: Node | None, seg: Segment) -> Result:
    """Whether and how strongly an expression matches a segment.

    Units carry the score: the sides of an AND stay apart, those of an OR are one; a NOT has none; a group's weight multiplies the
    mass, not the count. log_weight is the weights as a log-odds offset: a sum over AND, the largest over OR.
    """
    if node is None:
        return Result()
    if node.near is not None:
        n = len(clusters(node, seg))
        w = node.weight if not node.kids else 1.0
        r = Result(n > 0, _unit(id(node), w * n, n), _log(w) if n else 0.0)
    elif node.op in ("TERM", "REGEX"):
        n = len(seg.spans(node))
        r = Result(n > 0, _unit(id(node), node.weight * n, n), _log(node.weight) if n else 0.0)
    elif node.op == "NOT":
        r = Result(not evaluate(node.kids[0], seg).matched)
    else:
        left, right = evaluate(node.kids[0], seg), evaluate(node.kids[1], seg)
        if node.op == "AND":
            ok = left.matched and right.matched
            r = Result(ok, left.units + right.units, left.log_weight + right.log_weight) if ok else Result()
        else:
            sides = [s for s in (left, right) if s.matched]
            ok = len(sides) == 1 if node.op == "XOR" else bool(sides)
            pooled = [u for s in sides for u in s.units] if ok else []
            r = Result(ok, _unit(id(node), sum(w for _, w, _ in pooled), sum(n for _, _, n in pooled)), max((s.log_weight for s in sides), default=0.0) if ok else 0.0)
    if node.group != 1 and r.units:
        units = [(x, w * node.group, n) for x, w, n in r.units if w * node.group > 0]
        r = Result(r.matched, units, r.log_weight + _log(node.group) if node.group > 0 else 0.0)
    return Result(True, r.units, 0.0) if node.optional and not r.matched else r


def parts(node: Node | None) -> list[Node]:
    """What of an expression is looked for in a text as such: its terms, patterns and proximity groups, in order."""
    if node is None or node.near is not None or node.op in ("TERM", "REGEX"):
        return [node] if node else []
    return [p for k in node.kids for p in parts(k)]


def holds(node: Node | None, have: set[int]) -> bool:
    """Whether an expression holds where the parts with these ids are found, in one text or in several read as one."""
    if node is None:
        return False
    if node.near is not None or node.op in ("TERM", "REGEX"):
        ok = id(node) in have
    else:
        kids = [holds(k, have) for k in node.kids]
        ok = not kids[0] if node.op == "NOT" else all(kids) if node.op == "AND" else sum(kids) == 1 if node.op == "XOR" else any(kids)
    return ok or node.optional


# proximity: the ways to satisfy a group are lists of span lists with vetoes; windows are found by one sweep over all spans


@dataclass
class _Way:
    needs: list[list[tuple[int, int]]]
    vetoes: list[Node | None]


def _ways(node: Node | None, seg: Segment, top: bool = False) -> list[_Way]:
    if node is None:
        return []
    if node.near is not None and not top:
        found = [_Way([clusters(node, seg)], [])]
    elif node.op in ("TERM", "REGEX"):
        found = [_Way([seg.spans(node)], [])]
    elif node.op == "NOT":
        found = [_Way([], [node.kids[0]])]
    elif node.op == "XOR":
        a, b = node.kids
        one = lambda x, y: Node("AND", kids=(x, Node("NOT", kids=(y,))))
        found = _ways(Node("OR", kids=(one(a, b), one(b, a))), seg)
    else:
        left, right = _ways(node.kids[0], seg), _ways(node.kids[1], seg)
        if node.op == "AND":
            found = [_Way(a.needs + b.needs, a.vetoes + b.vetoes) for a in left for b in right]
        else:
            found = left + right
            if all(len(w.needs) == 1 and not w.vetoes for w in found):
                found = [_Way([sorted(s for w in found for s in w.needs[0])], [])]
    return found + [_Way([], [])] if node.optional and not top else found


@lru_cache(maxsize=8)
def _word_pattern(mode: str) -> regex.Pattern:
    return regex.compile(WORD_CLASS[mode] + "+")


def _words_between(seg: Segment, a: tuple[int, int], b: tuple[int, int]) -> int:
    a, b = sorted((a, b))
    return sum(1 for _ in _word_pattern(seg.mode).finditer(seg.nfc, a[1], b[0])) if b[0] > a[1] else 0


def clusters(node: Node, seg: Segment) -> list[tuple[int, int]]:
    """Disjoint windows, leftmost and smallest first, in which a proximity group holds with at most ``near`` words between neighbours."""
    slack = math.inf if node.near is None else node.near
    ways = [w for w in _ways(node, seg, top=True) if w.needs and all(w.needs)]
    if not ways:
        return []
    words = [m.span() for m in _word_pattern(seg.mode).finditer(seg.nfc)]

    def whole_words(span: tuple[int, int]) -> tuple[int, int]:
        a, b = span
        for x, y in words:
            a, b = (x if x < a < y else a), (y if x < b < y else b)
        return a, b

    roles: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, way in enumerate(ways):
        for j, spans in enumerate(way.needs):
            for s in spans:
                roles.setdefault(whole_words(s), []).append((i, j))
    order = sorted(roles)
    out: list[tuple[int, int]] = []
    first = 0  # first span of the window under way
    e = 0
    while e < len(order):
        if e > first and _words_between(seg, order[e - 1], order[e]) > slack:
            first = e
        while (i := next((i for i, w in enumerate(ways) if _covers(order, roles, first, e, i, len(w.needs))), None)) is not None:
            while _covers(order, roles, first + 1, e, i, len(ways[i].needs)):
                first += 1
            window = (order[first][0], max(b for _, b in order[first : e + 1]))
            if not any(_in_reach(v, window, node, seg, slack) for v in ways[i].vetoes):
                out.append(window)
                first = e + 1
                break
            first += 1
        e += 1
    return out


def _covers(order: list, roles: dict, first: int, last: int, way: int, n: int) -> bool:
    return len({j for s in order[first : last + 1] for i, j in roles[s] if i == way}) == n


def _in_reach(v: Node | None, window: tuple[int, int], group: Node, seg: Segment, slack: float) -> bool:
    if v is None:
        return False
    if v.near is not None or v.op in ("TERM", "REGEX"):
        found = clusters(v, seg) if v.near is not None else seg.spans(v)
        return any(_words_between(seg, window, o) <= slack for o in found)
    below = [_in_reach(k, window, group, seg, slack) for k in v.kids]
    return not below[0] if v.op == "NOT" else all(below) if v.op == "AND" else any(below) if v.op == "OR" else below[0] != below[1]


def count_key(key: str, text: str | Segment, cased: bool = False, whole: bool = False, macros: dict[str, str] | None = None, mode: str = "strict") -> float:
    """Occurrences of a literal or pattern; of an expression its weight, 1 for a match without weight. 0 for a key that can't be read."""
    seg = text if isinstance(text, Segment) else Segment(text, mode)
    try:
        node = leaf(key, cased, whole, macros)
    except TooDeep:
        return 0
    if node is None or not seg.raw:
        return 0
    r = evaluate(node, seg)
    return (r.boost or 1) if r.matched else 0


# --- compilation to columns --------------------------------------------------------------------------------------------------


def compile_match(node: Node | None, folded: Column, ortho_: Column, raw: Column, mode: str = "strict") -> Column:
    """An expression without proximity as one boolean column over a segment's forms; it stays inside code generation.

    A plain substring test stands in front of each whole-word pattern, so most rows are settled without a regular expression.
    """
    if node is None:
        return F.lit(False)
    if node.near is not None:
        raise ValueError("proximity needs the evaluator")
    if node.op == "TERM":
        hay = ortho_ if node.cased else folded
        c = F.lit(False)
        for form in (v if node.cased else v.lower() for v in key_variants(node.value)):
            hit = F.contains(hay, F.lit(form)) if form else F.lit(False)
            if node.exact:
                before, after = boundaries(mode)
                hit = hit & hay.rlike(before + re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", form) + after)
            c = c | hit
    elif node.op == "REGEX":
        body, flags = REGEX_KEY.match(node.value).groups()
        inline = "".join(f for f in "ims" if f in flags)
        c = raw.rlike((f"(?{inline})" if inline else "") + _python_pattern(body))
    elif node.op == "NOT":
        c = ~compile_match(node.kids[0], folded, ortho_, raw, mode)
    else:
        a, b = (compile_match(k, folded, ortho_, raw, mode) for k in node.kids)
        c = a & b if node.op == "AND" else a | b if node.op == "OR" else a != b
    return F.lit(True) if node.optional else c


def literals(node: Node | None) -> list[str]:
    """Folded forms of all terms, for the automaton."""
    return [fold_text(v) for n in walk(node) if n.op == "TERM" for v in key_variants(n.value) if v]


def needs_term(node: Node | None) -> bool:
    """Whether no text without one of the expression's terms can match it."""
    if node is None:
        return True
    if node.optional or node.op in ("REGEX", "NOT"):
        return False
    return node.op == "TERM" or (any if node.op == "AND" else all)(map(needs_term, node.kids))
