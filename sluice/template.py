"""${variables} in recipes, and the conditions of if."""

from __future__ import annotations

import ast
import json
import operator
import os
import re
from collections.abc import Mapping
from typing import Any

import yaml

_NAME = re.compile(r"\$\{([^${}]+)\}")
#: Parameters whose templates their own operators fill in.
LATER = frozenset(("if", "python", "log"))


def _parsed(value: Any) -> Any:
    """JSON or YAML text of a list or mapping as what it stands for."""
    if isinstance(value, str) and value[:1] in "[{" and value.strip():
        for read in (json.loads, yaml.safe_load):
            try:
                return read(value)
            except (ValueError, yaml.YAMLError):
                continue
    return value


def swept(part: Any, variables: Mapping[str, Any], strict: bool) -> Any:
    """A matrix, whose own variables are bound in turn later."""
    return {**part, "variables": bind(part.get("variables") or {}, variables, strict)} if isinstance(part, Mapping) else part


def bind(part: Any, variables: Mapping[str, Any], strict: bool = True) -> Any:
    """part with its variables filled in; a text that is one variable takes that variable's own type."""
    if isinstance(part, Mapping):
        if isinstance(own := part.get("variables"), Mapping):
            variables = {**variables, **bind(own, variables, strict)}
        return {bind(k, variables, strict): (v if k in LATER else swept(v, variables, strict) if k == "matrix" else bind(v, variables, strict)) for k, v in part.items()}
    if isinstance(part, (list, tuple)):
        return [bind(x, variables, strict) for x in part]
    if not isinstance(part, str):
        return part

    def value(name: str) -> Any:
        name = name.strip()
        if name in variables:
            return variables[name]
        if name in os.environ:
            return os.environ[name]
        if strict:
            raise ValueError(f"Variable ${{{name}}} was not found")
        return f"${{{name}}}"

    if whole := _NAME.fullmatch(part.strip()):
        return _parsed(value(whole[1]))
    return _NAME.sub(lambda m: str(value(m[1])), part)


_OPERATORS = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv,
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
    ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b, ast.Is: lambda a, b: a is b, ast.IsNot: lambda a, b: a is not b,
    ast.Not: operator.not_, ast.USub: operator.neg,
}
_CALLS = {"len": len, "str": str, "int": int, "float": float, "bool": bool, "any": any, "all": all, "min": min, "max": max, "sum": sum, "abs": abs, "round": round}
_METHODS = frozenset("lower upper strip startswith endswith isdigit get keys values split replace".split())


def condition(statement: Any, variables: Mapping[str, Any]) -> bool:
    """Whether an if statement holds. Values may be given as callables, called only where they are named."""
    if not isinstance(statement, str):
        return bool(statement)
    names: dict[str, Any] = dict(variables)

    def name_of(m: re.Match) -> str:
        key = f"_v{len(names)}"
        names[key] = bind(m[0], variables)
        return f" {key} "

    text = _NAME.sub(name_of, statement).strip()

    def value(node: ast.AST) -> Any:
        match node:
            case ast.Expression(body=x):
                return value(x)
            case ast.Constant(value=x):
                return x
            case ast.Name(id=x):
                if x not in names:
                    raise ValueError(f"{x} is not known in: {statement}")
                return names[x]() if callable(names[x]) else names[x]
            case ast.BoolOp(op=ast.And(), values=xs):
                return all(value(x) for x in xs)
            case ast.BoolOp(values=xs):
                return any(value(x) for x in xs)
            case ast.UnaryOp(op=op, operand=x) | ast.BinOp(op=op, left=x) if type(op) in _OPERATORS:
                return _OPERATORS[type(op)](value(x), *([value(node.right)] if isinstance(node, ast.BinOp) else []))
            case ast.Compare(left=x, ops=ops, comparators=others):
                left = value(x)
                for op, other in zip(ops, others, strict=True):
                    right = value(other)
                    if not _OPERATORS[type(op)](left, right):
                        return False
                    left = right
                return True
            case ast.IfExp(test=t, body=a, orelse=b):
                return value(a) if value(t) else value(b)
            case ast.List(elts=xs) | ast.Tuple(elts=xs) | ast.Set(elts=xs):
                return [value(x) for x in xs]
            case ast.Subscript(value=x, slice=at):
                return value(x)[value(at)]
            case ast.Call(func=ast.Name(id=f), args=xs) if f in _CALLS:
                return _CALLS[f](*map(value, xs))
            case ast.Call(func=ast.Attribute(value=x, attr=f), args=xs) if f in _METHODS:
                return getattr(value(x), f)(*map(value, xs))
        raise ValueError(f"Not allowed in a condition: {ast.unparse(node)}")

    return bool(value(ast.parse(text, mode="eval")))
