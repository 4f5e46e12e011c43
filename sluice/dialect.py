"""Recipe SQL and expressions in Spark's terms."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""('(?:[^']|'')*')|("(?:[^"]|"")*")|(\[[^\]\[,'"]*[A-Za-z_][^\]\[,'"]*\])|(`[^`]*`)|([A-Za-z_][A-Za-z_0-9]*)(\s*\()?|([:$@][A-Za-z_]\w*)|(\?)|(==)|(<>)|(.)""", re.S)
# SQL function names of the recipe dialect and Spark's.
FUNCTIONS = {"group_concat": "listagg", "json_extract": "get_json_object", "random": "rand", "unicode": "ascii", "typeof": "typeof", "julianday": "unix_date", "char": "char", "printf": "printf"}
WORDS = {"like": "ILIKE", "glob": "RLIKE", "regexp": "RLIKE"}


def literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql(text: str, params: Sequence | Mapping | None = None) -> str:
    """Recipe SQL as Spark SQL: quoted names, LIKE without case, parameters as literals."""
    given = list(params) if isinstance(params, (list, tuple)) else []
    out = []
    for m in _TOKEN.finditer(text):
        string, quoted, bracket, tick, word, call, named, mark, equal, _, other = m.groups()
        if string is not None:
            out.append("'" + string[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'")
        elif quoted is not None:
            out.append("`" + quoted[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif bracket is not None:
            out.append("`" + bracket[1:-1] + "`")
        elif tick is not None:
            out.append(tick)
        elif word is not None:
            if call is not None:
                out.append(FUNCTIONS.get(word.lower(), word) + call)
            else:
                out.append(WORDS.get(word.lower(), word))
        elif named is not None:
            if isinstance(params, Mapping) and named[1:] in params:
                out.append(literal(params[named[1:]]))
            else:
                out.append(named)
        elif mark is not None:
            if not given:
                raise ValueError("There are fewer parameters than question marks")
            out.append(literal(given.pop(0)))
        elif equal is not None:
            out.append("=")
        else:
            out.append(m[0])
    return "".join(out)


def java_pattern(pattern: str) -> str:
    """A Python pattern as a Java one, with Unicode classes."""
    return "(?U)" + pattern.replace("(?P<", "(?<").replace("\\Z", "\\z")


def java_replacement(text: str) -> str:
    """A Python replacement as a Java one."""
    text = text.replace("$", "\\$")
    return re.sub(r"\\g<(\w+)>", r"${\1}", re.sub(r"\\(\d+)", r"$\1", text))


def safe_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


_MATH: dict[str, Callable] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "arctan2": F.atan2, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "log": F.ln, "log10": F.log10, "log1p": F.log1p, "exp": F.exp, "expm1": F.expm1, "sqrt": F.sqrt,
    "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "len": F.length, "upper": F.upper, "lower": F.lower, "min": F.least, "max": F.greatest,
    "str": lambda x: x.cast("string"), "int": lambda x: x.cast("long"), "float": lambda x: x.cast("double"), "round": lambda x, d=None: F.bround(x, 0 if d is None else d),
    "where": lambda c, a, b: F.when(c, a).otherwise(b), "isnull": F.isnull, "notnull": F.isnotnull,
}
_METHODS: dict[str, Callable] = {
    "upper": F.upper, "lower": F.lower, "strip": F.trim, "lstrip": F.ltrim, "rstrip": F.rtrim, "title": F.initcap, "startswith": F.startswith, "endswith": F.endswith,
    "replace": F.replace, "isnull": F.isnull, "isna": F.isnull, "notnull": F.isnotnull, "notna": F.isnotnull,
    "split": lambda x, sep: F.split(x, F.concat(F.lit("\\Q"), sep, F.lit("\\E"))), "contains": F.contains,
}


_TEXTS = frozenset("str upper lower strip lstrip rstrip title replace".split())


def expression(text: str, columns: Sequence[str], values: Mapping[str, Any] | None = None, texts: Sequence[str] = (), lenient: bool = False) -> Column:
    """A Python-like expression over columns, named as they are or with other characters as underscores.

    texts: the columns that hold strings, which + joins. lenient: numbers that a text doesn't hold are null,
    where they would stop the job.
    """
    names = {safe_name(c): c for c in columns} | {c: c for c in columns}
    values = values or {}
    text = re.sub(r"`([^`]+)`", lambda m: safe_name(m[1]), text.strip())
    for c in sorted((c for c in columns if not c.isidentifier()), key=len, reverse=True):
        text = re.sub(rf"(?<![\w'\"]){re.escape(c)}(?![\w'\"])", safe_name(c), text)

    def col(node: ast.AST) -> Column:
        x = build(node)
        return x if isinstance(x, Column) else F.lit(x)

    def is_text(node: ast.AST) -> bool:
        match node:
            case ast.Constant(value=x):
                return isinstance(x, str)
            case ast.Name(id=x):
                return names.get(x) in texts or isinstance(values.get(x), str)
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                return is_text(a) or is_text(b)
            case ast.Call(func=ast.Name(id=f) | ast.Attribute(attr=f)):
                return f in _TEXTS
        return isinstance(node, ast.JoinedStr)

    def build(node: ast.AST) -> Any:
        match node:
            case ast.Expression(body=x):
                return build(x)
            case ast.Constant(value=x):
                return x
            case ast.Name(id=x):
                if isinstance(values.get(x), Column):
                    return values[x]
                if x in names:
                    return F.col("`" + names[x].replace("`", "``") + "`")
                if x in values:
                    return values[x]
                if x == "pi":
                    return F.pi()
                raise ValueError(f"{x} is neither a column nor a variable")
            case ast.BoolOp(op=op, values=xs):
                out = col(xs[0])
                for x in xs[1:]:
                    out = (out & col(x)) if isinstance(op, ast.And) else (out | col(x))
                return out
            case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=x):
                return ~col(x)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.BinOp(op=ast.Add()) if is_text(node):
                return F.concat(col(node.left), col(node.right))
            case ast.BinOp(left=a, op=op, right=b):
                a, b = col(a), col(b)
                match op:
                    case ast.Add():
                        return a + b
                    case ast.Sub():
                        return a - b
                    case ast.Mult():
                        return a * b
                    case ast.Div():
                        return F.try_divide(a, b)
                    case ast.FloorDiv():
                        return F.floor(F.try_divide(a, b))
                    case ast.Mod():
                        return F.pmod(a, b)
                    case ast.Pow():
                        return F.pow(a, b)
                    case ast.BitAnd():
                        return a & b
                    case ast.BitOr():
                        return a | b
            case ast.Compare(left=a, ops=ops, comparators=bs):
                out, left = None, a
                for op, b in zip(ops, bs, strict=True):
                    if isinstance(op, (ast.In, ast.NotIn)):
                        if isinstance(b, (ast.List, ast.Tuple, ast.Set)):
                            one = col(left).isin([build(x) for x in b.elts])
                        else:
                            one = F.contains(col(b), col(left))
                        one = ~one if isinstance(op, ast.NotIn) else one
                    elif isinstance(b, ast.Constant) and b.value is None:
                        one = col(left).isNull() if isinstance(op, (ast.Is, ast.Eq)) else col(left).isNotNull()
                    else:
                        x, y = col(left), col(b)
                        one = {ast.Eq: x == y, ast.NotEq: x != y, ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[type(op)]
                    out, left = (one if out is None else out & one), b
                return out
            case ast.IfExp(test=t, body=a, orelse=b):
                return F.when(col(t), col(a)).otherwise(col(b))
            case ast.Call(func=ast.Name(id="int" | "float" as f), args=[x]) if lenient:
                return col(x).try_cast("long" if f == "int" else "double")
            case ast.Attribute(value=x, attr=key):
                return col(x)[key]
            case ast.Call(func=ast.Name(id=f), args=xs) if f in _MATH:
                return _MATH[f](*[build(x) if f == "round" and k else col(x) for k, x in enumerate(xs)])
            case ast.Call(func=ast.Attribute(value=ast.Name(id="str"), attr=f), args=xs) if f in _METHODS and xs:
                return _METHODS[f](*map(col, xs))
            case ast.Call(func=ast.Attribute(value=x, attr=f), args=xs) if f in _METHODS:
                if isinstance(x, ast.Attribute) and x.attr == "str":
                    x = x.value
                return _METHODS[f](col(x), *map(col, xs))
            case ast.JoinedStr(values=xs):
                return F.concat(*[col(x.value) if isinstance(x, ast.FormattedValue) else col(x) for x in xs])
            case ast.Subscript(value=x, slice=ast.Constant(value=int(at))):
                return F.get(col(x), F.lit(at)) if at >= 0 else F.try_element_at(col(x), F.lit(at))
            case ast.Subscript(value=x, slice=ast.Constant(value=str(key))):
                return col(x)[key]
            case ast.List(elts=xs) | ast.Tuple(elts=xs):
                return F.array(*map(col, xs))
        raise ValueError(f"Not supported in an expression: {ast.unparse(node)}")

    tree = ast.parse(text, mode="eval")
    return col(tree)


# Strftime directives and Spark's date patterns.
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%-m": "M", "%d": "dd", "%-d": "d", "%H": "HH", "%-H": "H", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a",
    "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%Z": "z", "%z": "xx", "%D": "MM/dd/yy", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%%": "%",
}


def date_pattern(text: str) -> str:
    """A strftime format as a Spark date pattern."""
    out, plain = [], ""

    def quote() -> None:
        nonlocal plain
        if plain:
            out.append("'" + plain.replace("'", "''") + "'" if re.search(r"[A-Za-z']", plain) else plain)
            plain = ""

    for m in re.finditer(r"%-?.|.", text, re.S):
        if m[0] in STRFTIME and m[0] != "%%":
            quote()
            out.append(STRFTIME[m[0]])
        else:
            plain += "%" if m[0] == "%%" else m[0]
    quote()
    return "".join(out)
