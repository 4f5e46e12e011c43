"""Text functions on plain Python values, for Arrow UDFs and for direct use."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections.abc import Sequence
from fractions import Fraction
from html.parser import HTMLParser


def without_words(text: str | None, words: Sequence[str] | None, split_words: bool = False, ignore_case: bool = True) -> str | None:
    """text without the words, which stand between white space, commas and the ends."""
    if text is None:
        return None
    wanted = [w for w in (words if words is not None else []) if w]
    if split_words:
        wanted = [t for w in wanted for t in w.split()]
    for word in sorted(wanted, key=len, reverse=True):
        text = re.sub(rf"(?:^|(?<=[\s,])){re.escape(word)}(?=[\s,]|$)", "", text, flags=re.I if ignore_case else 0)
    return re.sub(r"\s+", " ", text).strip(" ,")


def overlap(a: str, b: str, mask: str = "*", places: int = 3, exact=None, empty_a=None, empty_b=None, all_empty=None, case_sensitive: bool = True) -> tuple[str, float]:
    """Where two texts agree, other characters masked; and how alike they are."""
    if not a and not b:
        return (all_empty if all_empty is not None else ""), 0.0
    if not a or not b:
        given = empty_a if not a else empty_b
        return (given if given is not None else mask * len(a or b)), 0.0
    x, y = (a, b) if case_sensitive else (a.lower(), b.lower())
    if x == y:
        return (exact if exact is not None else a), 1.0
    matcher = difflib.SequenceMatcher(lambda c: c == "-", x, y, autojunk=False)
    out = []
    for kind, a0, a1, b0, b1 in matcher.get_opcodes():
        out.append(a[a0:a1] if kind == "equal" else mask * max(a1 - a0, b1 - b0))
    return "".join(out), round(matcher.ratio(), places)


_NUMBER = re.compile(r"[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?")


def significant(value, figures: int = 3):
    """Every number in a text, or a number, to that many significant figures."""
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return type(value)(float(f"%.{figures}g" % value))
    return _NUMBER.sub(lambda m: f"%.{figures}g" % float(m[0]), value)


_FRACTION = re.compile(r"(?:(?<![\d./])(\d+)[ -]+)?(?<![\d./])(\d+)\s*/\s*(\d+)(?![\d/])")


def decimals(text: str | None, places: int = 4) -> str | None:
    """Fractions like 1 1/2 and 5/8 in a text as decimals."""
    if text is None:
        return None

    def value(m: re.Match) -> str:
        if int(m[3]) == 0:
            return m[0]
        return f"{round(float(int(m[1] or 0) + Fraction(int(m[2]), int(m[3]))), places):g}" if places < 6 else str(round(int(m[1] or 0) + int(m[2]) / int(m[3]), places))

    return _FRACTION.sub(value, text)


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.links: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "a" and (link := dict(attrs).get("href")):
            self.links.append(link)

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.text.append(re.sub(r"\s+", " ", data).strip())


def page(source: str | None, what: str) -> str | list[str]:
    """The text or the links of a page."""
    reader = _Page()
    reader.feed(source or "")
    reader.close()
    return " ".join(reader.text) if what == "text" else reader.links


_CODE = re.compile(r"[A-Za-z0-9][A-Za-z0-9\-_/.#]*[A-Za-z0-9]")


def codes(text: str | None, min_length: int = 4, max_length: int = 64, strategy: str = "balanced", sort_order: str = "input") -> list[str]:
    """Tokens that look like part numbers: letters with digits, or long numbers where lenient."""
    out = []
    for token in _CODE.findall(text or ""):
        letters, digits = bool(re.search("[A-Za-z]", token)), sum(c.isdigit() for c in token)
        fits = digits >= 2 and letters if strategy == "balanced" else digits >= 1 if strategy == "lenient" else letters and digits >= 3 and token.upper() == token
        if fits and min_length <= len(token) <= max_length and token not in out:
            out.append(token)
    return out if sort_order == "input" else sorted(out, key=len, reverse=sort_order == "longest")


def plain(text: str | None) -> str:
    """Letters and digits only, without case and accents."""
    folded = unicodedata.normalize("NFKD", (text or "").lower().replace("ß", "ss"))
    return "".join(c for c in folded if c.isascii() and c.isalnum())


def partial_ratio(token: str, text: str) -> float:
    """How alike token is to the stretch of text that it fits best."""
    if not token or not text:
        return 0.0
    if token in text:
        return 1.0
    best = 0.0
    for block in difflib.SequenceMatcher(None, token, text, autojunk=False).get_matching_blocks():
        begin = max(0, block.b - block.a)
        best = max(best, difflib.SequenceMatcher(None, token, text[begin : begin + len(token)], autojunk=False).ratio())
    return best


def masked(term: str, missing_start: int, missing_end: int) -> str:
    """term with stars for what is missing at its ends."""
    end = len(term) - missing_end
    return "*" * missing_start + term[missing_start:end] + "*" * missing_end


def clean_snippet(text: str | None) -> str:
    """A snippet without ellipses, doubled spaces and phrases said twice."""
    text = re.sub(r"\s+", " ", html.unescape(text or "").replace("…", "...")).strip()
    parts = [p.strip() for p in re.split(r"\.{3,}|\s[|·]\s", text)]
    return " ".join(dict.fromkeys(p for p in parts if p))
