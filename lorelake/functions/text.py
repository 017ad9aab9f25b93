"""Text functions: JVM columns where Spark has the means, and Python kernels for Arrow stages where it lacks them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Quote and apostrophe forms that count as one, and the longer signs with their ASCII spelling.
APOSTROPHES = "‘’‚‛ʼʹ´`′‹›"
DOUBLE_QUOTES = "“”„‟″ʺ«»"
SPELLED = (("—", "--"), ("–", "-"), ("…", "..."), (" ", " "))
QUOTE_FAMILIES = ('"', "“”„‟", "«»", "「」", "『』", "《》", "〈〉")
#: elements that end a paragraph
BLOCK_ELEMENTS = (
    "address article aside blockquote details div dd dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul"
).split()
NAME_PARTICLES = frozenset("of the and de del della di da van von der den du la le el bin ibn".split())

_flat = str.maketrans({**dict.fromkeys(APOSTROPHES, "'"), **dict.fromkeys(DOUBLE_QUOTES, '"'), **dict(SPELLED)})
COMBINING = "[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]"
_combining = re.compile(COMBINING)
TOKEN_SPLIT = r"[^\p{L}\p{N}\p{M}']+"
_token_split = regex.compile(TOKEN_SPLIT)


# --- columns -----------------------------------------------------------------------------------------------------------------


def _compositions() -> str:
    """Each letter that has its marks in it, behind its spelling with the marks apart; one a line."""
    letters = (chr(i) for i in range(0xC0, 0x30000) if not 0xAC00 <= i <= 0xD7A3 and not 0xD800 <= i <= 0xDFFF)
    pairs = ((unicodedata.normalize("NFD", c), c) for c in letters)
    return "\n".join(f"{apart}\t{c}" for apart, c in pairs if len(apart) > 1 and unicodedata.normalize("NFC", c) == c)


_composed_by: list[str] = []


def composed(c: Column) -> Column:
    """The text with combining marks joined to their letters (all of NFC but the joining of Hangul letters). Texts without marks aren't touched."""
    if not _composed_by:
        _composed_by.append(_compositions())
    known = F.str_to_map(F.lit(_composed_by[0]), F.lit("\n"), F.lit("\t"))
    whole = lambda x: F.try_element_at(known, x)
    first = lambda x: F.concat(whole(F.substring(x, 1, 2)), F.substring(x, 3, 1 << 20))
    letters = F.regexp_extract_all(c, F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), F.lit(0))
    return F.when(c.rlike(COMBINING), F.array_join(F.transform(letters, lambda x: F.when(F.length(x) > 1, F.coalesce(whole(x), first(x), x)).otherwise(x)), "")).otherwise(c)


def ortho(c: Column | str) -> Column:
    """Composed text with one spelling for quotes, dashes, ellipsis and no-break space."""
    c = composed(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    c = F.translate(c, APOSTROPHES + DOUBLE_QUOTES, "'" * len(APOSTROPHES) + '"' * len(DOUBLE_QUOTES))
    for sign, plain in SPELLED:
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return c


def fold(c: Column | str) -> Column:
    return F.lower(ortho(c))


def tokens(c: Column | str) -> Column:
    """Folded terms of two characters or more: letters, digits, marks, apostrophes."""
    return F.filter(F.split(fold(c), TOKEN_SPLIT), lambda t: F.length(t) > 1)


def paragraphs(c: Column | str) -> Column:
    """Non-blank pieces of a text cut at blank lines and at the edges of block elements."""
    names = "|".join(BLOCK_ELEMENTS)
    edge = rf"\n[ \t]*\n|(?i)(?=<(?:{names})\b[^>]*>)|(?i)(?<=</(?:{names})>)"
    return F.filter(F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), edge), lambda p: F.trim(p) != "")


def masked(c: Column | str) -> Column:
    """Tags and comments out of the text; a blank each, so words around them stay apart."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>", " ")


def token_estimate(c: Column | str, chars_per_token: float = 4.91) -> Column:
    return F.round(F.length(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) / chars_per_token).cast("int")


def is_date_like(c: Column | str) -> Column:
    """A four-digit year, a numeric date, or a month's name beside a digit."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    months = r"\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b"
    return c.rlike(r"\b(?:19|20)\d{2}\b") | c.rlike(r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b") | (c.rlike(months) & c.rlike(r"\d"))


def normal_name(c: Column | str) -> Column:
    """A name for comparison: lower case, with runs of blanks, underscores and hyphens as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), r"[_\-\s]+", " "))


def key_text(c: Column | str) -> Column:
    return F.trim(F.lower(F.col(c) if isinstance(c, str) else c))


# --- kernels -----------------------------------------------------------------------------------------------------------------


def ortho_text(s: str | None) -> str:
    s = s or ""
    if s.isascii():
        return s.translate(_flat) if "`" in s else s
    if _combining.search(s):
        s = unicodedata.normalize("NFC", s)
    return s.translate(_flat)


def fold_text(s: str | None) -> str:
    return ortho_text(s).lower()


def key_variants(key: str) -> list[str]:
    """The key as written and, where a hyphen stands inside it, with blanks for hyphens."""
    s = ortho_text(key)
    spaced = s.replace("-", " ")
    return [s] if spaced in (s, "") or spaced.strip() != spaced else [s, spaced]


def token_list(s: str | None) -> list[str]:
    return [t for t in _token_split.split(fold_text(s)) if len(t) > 1]


_tags = re.compile(r"<!--.*?-->|</?[A-Za-z][^>]*>", re.S)


def mask_tags(s: str) -> str:
    """Tags and comments as blanks, character by character; places stay."""
    return _tags.sub(lambda m: " " * len(m.group()), s) if "<" in s else s


_blank_line = re.compile(r"\n[ \t]*\n")
_block_open = re.compile(rf"<(?:{'|'.join(BLOCK_ELEMENTS)})\b[^>]*>|</(?:{'|'.join(BLOCK_ELEMENTS)})\s*>", re.I)


def cut_blocks(s: str) -> list[str]:
    """Pieces cut, without loss, before a block element's start tag and after its end tag."""
    cuts = sorted({m.end() if m.group()[1] == "/" else m.start() for m in _block_open.finditer(s)} - {0, len(s)}) if "<" in s else []
    return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)])]


def segments(texts: Iterable[str], window: str) -> list[str]:
    """The units a key must match within: all texts as one, each text, or each paragraph of each text."""
    if window == "scan":
        return ["\n".join(texts)]
    parts = [str(t) for t in texts]
    if window == "paragraph":
        parts = [p for t in parts for q in _blank_line.split(t) for p in cut_blocks(q)]
    return [p for p in parts if p.strip()]


_any_tag = re.compile(r"<(/?)([A-Za-z][\w:-]*)(?=[\s/>])[^>]*>")


def _parent_end(s: str, start: int, name: str) -> int:
    """Where the element around place ``start`` ends: the first end tag without a start tag in between; else the end of the text."""
    held: dict[str, int] = {}
    for m in _any_tag.finditer(s, start):
        tag = m[2].lower()
        if tag == name or m.group().endswith("/>"):
            continue
        held[tag] = held.get(tag, 0) + (-1 if m[1] else 1)
        if held[tag] < 0:
            return m.start()
    return len(s)


def _outermost(s: str, name: str) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """Spans of the outermost closed elements of a name, and (start, end of its tag) of one left open."""
    spans, depth, opened = [], 0, (0, 0)
    for m in _any_tag.finditer(s):
        if m[2].lower() != name:
            continue
        if m[1]:
            if depth:
                depth -= 1
                if not depth:
                    spans.append((opened[0], m.end()))
        elif m.group().endswith("/>"):
            if not depth:
                spans.append(m.span())
        else:
            if not depth:
                opened = m.span()
            depth += 1
    return spans, opened if depth else None


def drop_elements(s: str | None, names: str | Iterable[str]) -> str:
    """The text without the named elements and all they hold; one that is never closed runs to where its parent closes, or to the end."""
    out = s or ""
    for name in re.split(r"[\s,]+", names) if isinstance(names, str) else names:
        name, left_open = re.sub(r"[^\w:-]", "", name).lower(), True
        while name and left_open:
            spans, left_open = _outermost(out, name)
            if left_open:
                spans.append((left_open[0], _parent_end(out, left_open[1], name)))
            bounds = [0, *(x for span in spans for x in span), len(out)]
            out = "".join(out[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
    return out


def split_keys(s: str | None) -> list[str]:
    """A key list cut at commas and line ends; patterns between slashes and quoted phrases keep their commas."""
    out: list[str] = []
    for line in re.split(r"(?<!\\)\n", s or ""):
        cur, pattern, family = "", False, None
        i = 0
        pieces: list[str] = []
        while i < len(line):
            c = line[i]
            if c == "\\":
                cur += line[i : i + 2]
                i += 2
                continue
            if not pattern and family:
                family = None if c in family else family
            elif not pattern and any(c in f for f in QUOTE_FAMILIES) and (not cur.strip() or (cur.strip().startswith("?") and cur[-1] in " \t(&|!+-=^?")):
                family = next(f for f in QUOTE_FAMILIES if c in f)
            elif c == "/" and not family and (pattern or not cur.strip()):
                pattern = not pattern
            elif c == "," and not pattern and not family:
                pieces.append(cur)
                cur = ""
                i += 1
                continue
            cur += c
            i += 1
        pieces.append(cur)
        for p in map(str.strip, pieces):
            if p.startswith("/") and not re.fullmatch(r"/([\s\S]+)/([dgimsuvy]*)", p):
                out += [x for x in map(str.strip, p.split(",")) if x]
            elif p:
                out.append(p)
    return out


_macro = re.compile(r"(\{\{[^{}]+\}\})(?:\[(-?\d+)\])?")


def has_macro(s: str) -> bool:
    return bool(_macro.search(s))


def expand_macros(s: str, macros: dict[str, str], escape: bool = False) -> str:
    """Each known ``{{token}}`` by its value, ``{{token}}[N]`` by its N-th word (from 1, negative from the end); unknown ones stay."""

    def value(m: re.Match) -> str:
        known = macros.get(m[1])
        if known is None:
            return m.group()
        if m[2] is not None:
            words, n = known.split(), int(m[2])
            i = n - 1 if n > 0 else len(words) + n
            known = words[i] if n and 0 <= i < len(words) else ""
        return re.escape(known) if escape else known

    return _macro.sub(value, s)


_sentences = re.compile(r"(?<=[.!?])\s+|\n+")
_label = regex.compile(r"(?:#{1,6}\s+\S.*|\*\*[^*]+:?\*\*|\p{Lu}[\p{L}' ]{0,30}:)")


def name_words(s: str | None) -> set[str]:
    """Lower-case words that stand capitalised somewhere inside a sentence; lines that are only a label don't count."""
    out = set()
    for sentence in map(str.strip, _sentences.split(s or "")):
        if not _label.fullmatch(sentence):
            words = [t for t in _token_split.split(sentence) if len(t) > 1]
            out |= {t.lower() for t in words[1:] if unicodedata.category(t[0]) == "Lu"}
    return out


def name_density(s: str | None) -> float:
    """Names for each hundred tokens."""
    return 100 * len(name_words(ortho_text(s))) / max(1, len(token_list(s)))


# --- chunkers ----------------------------------------------------------------------------------------------------------------


def split_recursive(s: str, size: int, delimiters: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Cut at the first delimiter, what is still too long at the next ones, then join neighbours while they fit; a size of 0 keeps the text whole."""
    if size <= 0 or not delimiters:
        return [s]
    first, rest = delimiters[0], delimiters[1:]
    parts: list[str] = []
    for p in s.split(first) if first else list(s):
        parts += split_recursive(p, size, rest) if len(p) >= size and rest else [p]
    out = parts[:1]
    for p in parts[1:]:
        if len(out[-1]) + len(first) + len(p) <= size:
            out[-1] += first + p
        else:
            out.append(p)
    return out


def chunk_paragraphs(s: str, size: int, least: int) -> list[str]:
    """Paragraphs of at least ``least`` characters, short ones joined to the next, and of at most ``size``, long ones cut."""
    out: list[str] = []
    pending = ""
    for p in filter(None, map(str.strip, _blank_line.split(s))):
        p = f"{pending}\n\n{p}" if pending else p
        pending = ""
        if len(p) < least:
            pending = p
        elif len(p) <= size or size <= 0:
            out.append(p)
        else:
            parts = split_recursive(p, size, ("\n", ". ", " ", ""))
            if len(parts) > 1 and len(parts[-1]) < least:
                pending = parts.pop()
            out += parts
    if pending:
        if out and len(pending) < least and len(out[-1]) + 2 + len(pending) <= size:
            out[-1] += f"\n\n{pending}"
        else:
            out.append(pending)
    return out


def chunk_entry(s: str | None, mode: str = "paragraph", size: int = 1750, least: int = 120) -> list[str]:
    if not s or not s.strip():
        return []
    return chunk_paragraphs(s, size, least) if mode == "paragraph" else split_recursive(s, size)


# --- forms of keys and patterns ----------------------------------------------------------------------------------------------

_message_break = re.compile(r"^[ \t]*-{3,}[ \t]*$", re.M)
# Scripts written without blanks between words, kana before Han.
_spaceless = [("Japanese", r"[\p{Script=Hiragana}\p{Script=Katakana}]"), ("Chinese", r"\p{Script=Han}"), ("Thai", r"\p{Script=Thai}"), ("Lao", r"\p{Script=Lao}"), ("Khmer", r"\p{Script=Khmer}"), ("Burmese", r"\p{Script=Myanmar}")]


def placed_segments(s: str | None, window: str) -> list[tuple[int, str]]:
    """(place, text) of the segments of one composed text; a line of dashes ends a message."""
    src = unicodedata.normalize("NFC", s or "")
    parts = [(0, src)]
    if window in ("message", "paragraph"):
        for cut in (_message_break, _blank_line) if window == "paragraph" else (_message_break,):
            out = []
            for at, t in parts:
                last = 0
                for m in cut.finditer(t):
                    out.append((at + last, t[last : m.start()]))
                    last = m.end()
                out.append((at + last, t[last:]))
            parts = out
        if window == "paragraph":
            pieces = []
            for at, t in parts:
                for b in cut_blocks(t):
                    pieces.append((at, b))
                    at += len(b)
            parts = pieces
    return [(at, t) for at, t in parts if t.strip()]


def swap_hyphens(pattern: str, to: str) -> str | None:
    """A ``/pattern/flags`` with its literal hyphens replaced; those of ranges and escaped ones stay. None for what isn't a pattern."""
    m = re.fullmatch(r"/([\s\S]+)/([dgimsuvy]*)", pattern)
    if not m or "v" in m[2]:
        return None

    def in_class(c: re.Match) -> str:
        body, tail = c[2], c[3]
        atoms = re.findall(r"\\.|[^\\]", body, re.S)
        out, i = [], 0
        while i < len(atoms):
            if i + 2 < len(atoms) and atoms[i + 1] == "-":  # a range: its ends and its hyphen stay
                out += [to if atoms[i] == "-" else atoms[i], "-", atoms[i + 2]] if atoms[i] != "-" or i else [to]
                i += 3 if atoms[i] != "-" or i else 1
            else:
                out.append(to if atoms[i] == "-" else atoms[i])
                i += 1
        return c[1] + "".join(out) + tail

    parts = re.split(r"(\\.|\[\^?(?:\\.|[^\]\\])*\])", m[1], flags=re.S)
    done = [re.sub(r"(\[\^?)((?:\\.|[^\]\\])*)(\])", in_class, p, flags=re.S) if p.startswith("[") else p if p.startswith("\\") else p.replace("-", to) for p in parts]
    return f"/{''.join(done)}/{m[2]}"


def other_spellings(pattern: str) -> list[tuple[str, str]]:
    """(pattern, what it adds) for each spelling of quotes and dashes that a pattern can't reach."""
    out = []
    for plain, pair in (("'", "‘’"), ('"', "“”")):
        straight, curly = plain in pattern, any(c in pattern for c in pair)
        if straight and not curly:
            out += [(pattern.replace(plain, c), "curly form") for c in pair]
        elif curly and not straight:
            out.append((pattern.replace(pair[0], plain).replace(pair[1], plain), "straight form"))
    dashed = None if "–" in pattern else swap_hyphens(pattern, "–")
    return out + ([(dashed, "en dash")] if dashed and dashed != pattern else [])


def stems(w: str) -> list[str]:
    """What a word may be an inflection of, by its ending alone."""
    for ending, least in (("ing", 6), ("ed", 5)):
        if w.endswith(ending) and len(w) >= least:
            base = w[: -len(ending)]
            return [base, base + "e"] + ([base[:-1]] if len(base) > 2 and base[-1] == base[-2] else [])
    if w.endswith("ies") and len(w) >= 5:
        return [w[:-3] + "y"]
    if w.endswith("s") and not w.endswith("ss") and len(w) >= 4:
        return [w[:-1]] + ([w[:-2]] if w.endswith("es") else [])
    return []


def rarity(term: str, zipf: dict[str, float], names: frozenset[str] = frozenset(), low: float = 2.5, high: float = 3.8, phrase_word: float = 5.5) -> float:
    """How far a language's word frequencies let a term pass: 1 up to ``low``, 0 from ``high`` on; a phrase goes by its rarest word and may
    hold none of the most common ones, a single word above 3 doesn't pass."""
    words = term.split(" ")
    known = {w: 0.0 if w in names else zipf.get(w) or max((zipf.get(s, 0.0) for s in stems(w)), default=0.0) for w in words}
    if len(words) > 1 and any(z > phrase_word for w, z in known.items() if w not in ("of", "the") and w not in NAME_PARTICLES):
        return 0.0
    z = min(known.values())
    return 0.0 if len(words) == 1 and z >= 3.0 else min(1.0, max(0.0, (high - z) / (high - low)))


def whole_word_advice(keys: Iterable[str]) -> list[str]:
    """What an author should know about whole-word matching of these keys."""
    plain = [k.strip() for k in keys if k and k.strip() and not k.strip().startswith(("?", "/"))]
    spaced = next((k for k in plain if " " in k), None)
    script = next((n for n, p in _spaceless if any(regex.search(p, k) for k in plain)), None)
    out = [f"whole words: “{spaced}” won't match a suffixed form"] if spaced else []
    return out + ([f"{script} has no word boundaries: a key can't match inside a run"] if script else [])
