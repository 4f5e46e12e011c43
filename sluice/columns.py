"""How recipes name columns: exact names, places, slices, globs, patterns, exclusions, optional names."""

from __future__ import annotations

import re
from collections.abc import Sequence

_SLICE = re.compile(r"-?\d*:-?\d*(:-?\d*)?")


def _glob(text: str) -> str:
    """A glob as a pattern; \\* is a star."""
    return "".join("(.*)" if part == "*" else re.escape(part.replace("\\*", "*")) for part in re.split(r"(?<!\\)(\*)", text))


def _matches(text: str, columns: Sequence[str]) -> list[str] | None:
    """What a pattern, slice or glob selects; None if text is none of them."""
    if text.lower().startswith("regex:"):
        pattern = re.compile(text[6:].strip())
        return [c for c in columns if pattern.fullmatch(c)]
    if _SLICE.fullmatch(text) and text != ":":
        bounds = [int(x) if x else None for x in text.split(":")]
        return list(columns)[slice(*bounds)]
    if "*" in text:
        pattern = re.compile(_glob(text), re.S)
        return [c for c in columns if pattern.fullmatch(c)]
    return None


def expand(columns: Sequence[str], wanted: str | int | Sequence) -> list[str]:
    """The names that wanted selects from columns, in the order asked for, each once."""
    wanted = [wanted] if isinstance(wanted, (str, int)) else list(wanted)
    columns = list(columns)
    found: dict[str, None] = {}
    names = [str(w) for w in wanted]

    def negative(w: str) -> bool:
        if w in columns:
            return False
        return bool(re.match(r"-(?!\d*:)", w) or re.match(r"(?i)regex:\s*-", w))

    if names and all(map(negative, names)):
        found = dict.fromkeys(columns)
    for raw, name in zip(wanted, names, strict=True):
        if name in columns:
            found[name] = None
        elif isinstance(raw, int) or re.fullmatch(r"\d+", name):
            at = int(name)
            if not 0 <= at < len(columns):
                raise ValueError(f"There is no column at place {at}")
            found[columns[at]] = None
        elif negative(name):
            rest = re.sub(r"^-\s*", "", name) if name.startswith("-") else re.sub(r"(?i)^regex:\s*-", "regex:", name)
            out = [rest] if rest in columns else _matches(rest, columns)
            for c in out or []:
                found.pop(c, None)
        elif (out := _matches(name, columns)) is not None:
            if not out and len(names) == 1:
                raise KeyError(f"No column matches {name}")
            found.update(dict.fromkeys(out))
        elif name.endswith("?"):
            optional = name[:-1]
            out = [optional] if optional in columns else _matches(optional, columns) or []
            found.update(dict.fromkeys(out))
        else:
            raise KeyError(f"Column {name} does not exist")
    return list(found)


def renames(columns: Sequence[str], wanted: dict[str, str] | str | Sequence[str]) -> dict[str, str]:
    """{source: new name}; a star in the new name takes what the source's glob or group caught."""
    if not isinstance(wanted, dict):
        return {c: c for c in expand(columns, wanted)}
    out: dict[str, str] = {}
    for source, target in wanted.items():
        source = str(source)
        if source in columns:
            out[source] = target
            continue
        optional = source.endswith("?")
        source = source[:-1] if optional else source
        if source in columns:
            out[source] = target
            continue
        is_pattern = source.lower().startswith("regex:")
        if not is_pattern and "*" not in source:
            if optional:
                continue
            raise KeyError(f"Column {source} does not exist")
        pattern = re.compile(source[6:].strip() if is_pattern else _glob(source))
        for c in columns:
            if m := pattern.fullmatch(c):
                name = target
                for group in m.groups():
                    name = name.replace("*", group or "", 1)
                out[c] = re.sub(r"\\(\d+)", lambda g, m=m: m[int(g[1])] or "", name)
    return out
