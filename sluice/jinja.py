"""Templates as Spark expressions: {{ places }} with filters, {% if %} and {% for %}; no Python runs on the rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.dialect import expression

_PART = re.compile(r"\{\{-?(.*?)-?\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_NEXT = re.compile(r"elif\b|else\b|endif\b|endfor\b")


def _text(x: Column) -> Column:
    return x.cast("string")


#: Filters, each of a value and the filter's arguments.
FILTERS: dict[str, Callable[..., Column]] = {
    "upper": lambda x: F.upper(_text(x)), "lower": lambda x: F.lower(_text(x)), "title": lambda x: F.initcap(_text(x)), "trim": lambda x: F.trim(_text(x)),
    "capitalize": lambda x: F.concat(F.upper(F.substring(_text(x), 1, 1)), F.lower(F.substring(_text(x), 2, 1 << 30))),
    "default": lambda x, other="": F.coalesce(_text(x), F.lit(str(other))), "replace": lambda x, a, b: F.replace(_text(x), F.lit(a), F.lit(b)),
    "join": lambda x, by="": F.array_join(x.cast("array<string>"), by), "first": lambda x: F.get(x, F.lit(0)), "last": lambda x: F.try_element_at(x, F.lit(-1)),
    "length": lambda x: F.size(x), "count": lambda x: F.size(x), "round": lambda x, d=0: F.bround(x, d), "int": lambda x: x.try_cast("long"), "string": _text,
    "unique": lambda x: F.array_distinct(x), "sort": lambda x: F.sort_array(x), "sum": lambda x: F.aggregate(x.cast("array<double>"), F.lit(0.0), lambda a, b: a + b),
}


class _Template:
    def __init__(self, text: str, columns: list[str], texts: list[str]) -> None:
        self.columns, self.texts = columns, texts
        self.parts: list[tuple[str, str]] = []
        at = 0
        for m in _PART.finditer(text):
            before = text[at : m.start()]
            if self.parts and self.parts[-1][0] == "strip":
                self.parts.pop()
                before = before.lstrip()
            if m[2] or text.startswith("{{-", m.start()):
                before = before.rstrip()
            if before:
                self.parts.append(("text", before))
            if m[1] is not None:
                self.parts.append(("value", m[1].strip()))
            elif m[3] is not None:
                self.parts.append(("statement", m[3].strip()))
                if m[4]:
                    self.parts.append(("strip", ""))
            at = m.end()
        rest = text[at:].lstrip() if self.parts and self.parts[-1][0] == "strip" else text[at:]
        self.parts = [p for p in [*self.parts, ("text", rest)] if p[0] != "strip"]
        self.at = 0

    def value(self, text: str, names: dict[str, Column]) -> Column:
        """An expression with filters after bars."""
        first, *rest = re.split(r"(?<!\|)\|(?!\|)(?=\s*[a-z_]+\s*(?:\(|\||$))", text)
        out = expression(first.strip(), self.columns, names, self.texts)
        for one in rest:
            m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", one, re.S)
            if not m or m[1] not in FILTERS:
                raise ValueError(f"{one.strip()} is no filter")
            import ast

            given = ast.literal_eval(f"({m[2]},)") if m[2] and m[2].strip() else ()
            out = FILTERS[m[1]](out, *given)
        return out

    def block(self, names: dict[str, Column]) -> Column:
        """What stands up to the end of the block, or to its next branch."""
        out = [F.lit("")]
        while self.at < len(self.parts):
            kind, text = self.parts[self.at]
            if kind == "text":
                out.append(F.lit(text))
            elif kind == "value":
                out.append(F.coalesce(_text(self.value(text, names)), F.lit("")))
            elif _NEXT.match(text):
                break
            elif m := re.fullmatch(r"if\s+(.*)", text, re.S):
                out.append(self.branches(m[1], names))
                continue
            elif m := re.fullmatch(r"for\s+(\w+)\s+in\s+(.*)", text, re.S):
                out.append(self.loop(m[1], m[2], names))
                continue
            else:
                raise ValueError(f"{text} is no statement that templates may hold")
            self.at += 1
        return F.concat(*out)

    def expect(self, *wanted: str) -> str:
        if self.at >= len(self.parts) or self.parts[self.at][1].split()[0] not in wanted:
            raise ValueError(f"The template lacks {' or '.join(wanted)}")
        self.at += 1
        return self.parts[self.at - 1][1]

    def branches(self, condition: str, names: dict[str, Column]) -> Column:
        found, other = [], F.lit("")
        while True:
            self.at += 1
            test = F.coalesce(self.value(condition, names).cast("boolean"), F.lit(False))
            found.append((test, self.block(names)))
            end = self.expect("elif", "else", "endif")
            if end.startswith("elif"):
                condition = end[4:].strip()
                self.at -= 1
                continue
            if end == "else":
                other = self.block(names)
                self.expect("endif")
            break
        out = other
        for test, text in reversed(found):
            out = F.when(test, text).otherwise(out)
        return out

    def loop(self, item: str, items: str, names: dict[str, Column]) -> Column:
        begin = self.at + 1
        end: list[int] = []

        def body(x: Column, k: Column) -> Column:
            self.at = begin
            out = self.block({**names, item: x, "loop_index": k + 1, "loop_index0": k})
            end.append(self.at)
            return out

        out = F.array_join(F.transform(self.value(items, names), body), "")
        self.at = end[-1]
        self.expect("endfor")
        return F.coalesce(out, F.lit(""))


def rendered(template: str, columns: list[str], texts: list[str] = ()) -> Column:
    """The template over columns as one text expression; loop.index is the number of the turn. Nulls are empty."""
    made = _Template(re.sub(r"\bloop\.(index0?)\b", r"loop_\1", template), columns, list(texts))
    out = made.block({})
    if made.at < len(made.parts):
        raise ValueError(f"The template has a stray {made.parts[made.at][1]}")
    return out
