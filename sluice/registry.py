"""What recipes may call: operators by dotted name, each of a kind.

row      fn(ctx, df, input, output, **params) -> {name: Column}; the planner adds where and order
frame    fn(ctx, df, **params) -> DataFrame; with where, the frame is filtered first and replaced
split    like frame, but with where only the matching rows pass through it and the others stay
plain    like frame, but where is not allowed
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


@dataclass
class Context:
    """What a run knows: its session, its variables, the user's functions, the model provider."""

    spark: SparkSession
    variables: dict[str, Any] = field(default_factory=dict)
    functions: dict[str, Any] = field(default_factory=dict)
    run: Callable | None = None  # runs a list of steps over a frame

    def function(self, name: str) -> Callable:
        """A user's function by its name after custom., which may be dotted."""
        found: Any = self.functions
        for part in name.removeprefix("custom.").split("."):
            found = found.get(part) if isinstance(found, dict) else getattr(found, part, None)
            if found is None:
                raise ValueError(f"Function {name} was not given")
        return found


def injected(ctx: Context, call: Callable, params: dict[str, Any], **more: Any) -> dict[str, Any]:
    """params, and what a user's function asks for by name: the run's variables and functions, and an action's error."""
    try:
        taken = inspect.signature(call).parameters
    except (TypeError, ValueError):
        return params
    known = {"variables": {k: v for k, v in ctx.variables.items() if not k.startswith("__")}, "functions": ctx.functions, **more}
    return {**{k: v for k, v in known.items() if k in taken}, **params}


@dataclass
class Operator:
    name: str
    kind: str
    call: Callable
    expands: bool

    def parameters(self) -> dict[str, Any]:
        """Names and defaults of the operator's own parameters."""
        own = list(inspect.signature(self.call).parameters.values())[2:]
        return {p.name: None if p.default is p.empty else p.default for p in own if p.kind not in (p.VAR_KEYWORD,)}

    def required(self) -> list[str]:
        own = list(inspect.signature(self.call).parameters.values())[2:]
        return [p.name for p in own if p.default is p.empty and p.kind not in (p.VAR_KEYWORD, p.VAR_POSITIONAL)]


OPERATORS: dict[str, Operator] = {}


def op(name: str, kind: str = "row", expands: bool = True) -> Callable:
    """Registers an operator. expands: whether input goes through the column language first."""

    def add(call: Callable) -> Callable:
        OPERATORS[name] = Operator(name, kind, call, expands)
        return call

    return add


def schema() -> dict[str, Any]:
    """A JSON schema of all steps."""
    common = {"if": {"type": "string"}, "where": {"type": "string"}, "where_params": {}}
    steps = {}
    for o in OPERATORS.values():
        properties = {k: {"default": v} if v is not None else {} for k, v in o.parameters().items()}
        steps[o.name] = {"type": "object", "properties": {**properties, **common}, "required": o.required()}
    return {"type": "object", "properties": {"read": {}, "write": {}, "run": {}, "wrangles": {"type": "array", "items": {"type": "object", "properties": steps}}}}
