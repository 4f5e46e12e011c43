"""Recipes: read, steps, write and hooks, folded into one lazy plan."""

from __future__ import annotations

import concurrent.futures
import contextvars
import logging
import time
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import sluice.operators.control
import sluice.operators.frame
import sluice.operators.models
import sluice.operators.nested
import sluice.operators.numbers
import sluice.operators.text
import sluice.sources.services  # noqa: F401
from sluice import columns, dialect, template
from sluice.order import name
from sluice.registry import OPERATORS, Context, Operator, injected
from sluice.session import prepared
from sluice.sources import readers, writers

log = logging.getLogger("sluice")


def load(recipe: str | Mapping | Callable, variables: Mapping[str, Any]) -> dict[str, Any]:
    """A recipe from a mapping, YAML text, or a path, with its variables bound."""
    if callable(recipe):
        recipe = recipe()
    if isinstance(recipe, (str, Path)):
        text = str(recipe)
        if "\n" not in text and text.endswith((".yml", ".yaml", ".json")):
            text = Path(text).read_text(encoding="utf-8")
        recipe = yaml.safe_load(template.bind(text, variables, strict=False) if "${" in text and text.strip().startswith("${") else text)
    if not isinstance(recipe, Mapping):
        raise ValueError("A recipe is a mapping of read, wrangles, write and run")
    return {k: template.bind(v, variables, strict=k != "run") for k, v in recipe.items()}


def merged(df: DataFrame, made: Mapping[str, Column], condition: Column | None) -> DataFrame:
    """df with new columns; under a condition old values stay where it doesn't hold or the new one is null."""
    if condition is None:
        return df.withColumns(dict(made))
    out = {}
    for c, new in made.items():
        if c not in df.columns:
            out[c] = F.when(condition, new)
            continue
        old = df.schema[c].dataType
        kind = df.select(new.alias("n")).schema["n"].dataType
        before = name(c)
        if kind != old and type(kind) is not type(old):
            new, before = new.cast("string"), before.cast("string")
        out[c] = F.when(condition, F.coalesce(new, before)).otherwise(before)
    return df.withColumns(out)


def _listed(x: Any) -> list:
    return [x] if isinstance(x, (str, int, dict)) else list(x)


def planned(ctx: Context, df: DataFrame, operator: Operator, params: dict[str, Any]) -> DataFrame:
    """One registered step over df."""
    where, where_params = params.pop("where", None), params.pop("where_params", None)
    condition = F.expr(dialect.sql(where, where_params)) if where else None
    if missing := [p for p in operator.required() if p not in params and not (operator.kind == "row" and p == "output")]:
        raise ValueError(f"{operator.name} needs {', '.join(missing)}")
    if operator.kind == "plain":
        if condition is not None:
            raise NotImplementedError(f"{operator.name} cannot be used with where")
        return operator.call(ctx, df, **params)
    if operator.kind == "frame":
        return operator.call(ctx, df if condition is None else df.where(condition), **params)
    if operator.kind == "split":
        if condition is None:
            return operator.call(ctx, df, **params)
        return readers.union([operator.call(ctx, df.where(condition), **params), df.where(~F.coalesce(condition, F.lit(False)))])
    if operator.expands:
        params["input"] = columns.expand(df.columns, params["input"] if params.get("input") is not None else list(df.columns))
        params["output"] = _listed(params["output"]) if params.get("output") is not None else params["input"]
        one_to_one = not MANY.get(operator.name, False)
        if one_to_one and len(params["input"]) != len(params["output"]):
            raise ValueError(f"{operator.name}: input and output must be of equal length")
    return merged(df, operator.call(ctx, df, **params), condition)


#: Row operators that may take several inputs to one output, or one to several.
MANY = dict.fromkeys(
    """merge.concatenate extract.regex extract.brackets compare.text compare.lists create.jinja merge.to_list merge.to_dict merge.lists merge.dictionaries merge.coalesce
    convert.to_json convert.to_yaml select.highest_confidence select.threshold similarity extract.date_properties classify extract.address extract.attributes extract.properties
    extract.codes extract.custom extract.html compute.score_search_results""".split(), True,
)


def steps(ctx: Context, df: DataFrame, wrangles: Sequence) -> DataFrame:
    """All steps in turn."""
    for step in wrangles if isinstance(wrangles, list) else [wrangles]:
        for key, params in (step.items() if isinstance(step, Mapping) else [(step, {})]):
            began = time.perf_counter()
            params = dict(params or {})
            condition = params.pop("if", None)
            facts = {"row_count": df.count, "column_count": len(df.columns), "columns": df.columns}
            if condition is not None and not template.condition(condition, {**ctx.variables, **facts}):
                continue
            if key.startswith("custom."):
                df = custom(ctx, df, ctx.function(key), params)
            elif key in OPERATORS:
                df = planned(ctx, df, OPERATORS[key], params)
            else:
                raise ValueError(f"{key} is no step")
            log.debug("%s planned in %.3f s", key, time.perf_counter() - began)
    return df


def custom(ctx: Context, df: DataFrame, call: Callable, params: dict[str, Any]) -> DataFrame:
    """A user's function: of the frame, where it takes df; else of each row's values by column name."""
    import inspect

    from sluice.operators.frame import _result

    taken = inspect.signature(call).parameters
    params = injected(ctx, call, params)
    if "df" in taken:
        return call(df=df, **{k: v for k, v in params.items() if k in taken or any(p.kind is p.VAR_KEYWORD for p in taken.values())})
    where = params.pop("where", None)
    condition = F.expr(dialect.sql(where, params.pop("where_params", None))) if where else None
    used = columns.expand(df.columns, params.pop("input", None) or list(df.columns))
    outputs = _listed(params.pop("output", None) or used)
    wild = any(p.kind is p.VAR_KEYWORD for p in taken.values())
    named = {dialect.safe_name(c): c for c in used if wild or dialect.safe_name(c) in taken}
    fixed = {k: v for k, v in params.items() if k in taken or wild}
    kind = params.pop("type", None) or (_result(call) if inspect.signature(call).return_annotation is not inspect.Signature.empty else "string")

    def run(rows: pd.DataFrame) -> pd.Series:
        out = [call(**dict(zip(named, r, strict=True)), **fixed) for r in rows.itertuples(index=False, name=None)]
        if len(outputs) > 1:
            return pd.Series([[None if v is None else str(v) for v in x] for x in out], dtype=object)
        return pd.Series([v if v is None or kind != "string" else str(v) for v in out], dtype=object)

    made = F.pandas_udf(run, "array<string>" if len(outputs) > 1 else kind)(F.struct(*[name(c).alias(k) for k, c in named.items()] or [F.lit(0).alias("none")]))
    return merged(df, {o: F.get(made, F.lit(k)) for k, o in enumerate(outputs)} if len(outputs) > 1 else {outputs[0]: made}, condition)


def functions_of(given: Any) -> dict[str, Any]:
    """User functions by name, from a function, a list, a mapping or a module."""
    if given is None:
        return {}
    if isinstance(given, Mapping):
        return dict(given)
    if callable(given):
        return {given.__name__: given}
    if isinstance(given, (list, tuple)):
        return {f.__name__: f for f in given}
    return {k: v for k, v in vars(given).items() if callable(v) and not k.startswith("_")}


def run(recipe: Any, spark: SparkSession, variables: Mapping[str, Any] | None = None, dataframe: DataFrame | None = None, functions: Any = None, timeout: float | None = None) -> DataFrame:
    """The result of a recipe: a lazy frame, unless the recipe writes."""
    prepared(spark)
    ctx = Context(spark, {**readers.MEMORY["variables"], **(variables or {})}, functions_of(functions), steps)
    given = load(recipe, ctx.variables)
    ctx.variables["__input"] = dataframe
    hooks = given.get("run") or {}

    def work() -> DataFrame:
        writers.act(ctx, hooks.get("on_start") or [])
        try:
            bound = template.bind({k: v for k, v in given.items() if k != "run"}, ctx.variables, strict=False)
            if bound.get("read"):
                df = readers.read(ctx, bound["read"])
            elif dataframe is not None:
                df = dataframe
            else:
                df = spark.range(1).select()
            df = steps(ctx, df, bound.get("wrangles") or bound.get("wrangle") or [])
            if bound.get("write"):
                df = writers.write(ctx, df, bound["write"])
        except Exception as error:
            writers.act(ctx, template.bind(hooks.get("on_failure") or [], {**ctx.variables, "error": str(error)}, strict=False), error=str(error))
            raise
        writers.act(ctx, hooks.get("on_success") or [])
        return df

    if timeout is None:
        return work()
    pool = concurrent.futures.ThreadPoolExecutor(1)
    try:
        return pool.submit(contextvars.copy_context().run, work).result(timeout)
    except concurrent.futures.TimeoutError:
        spark.sparkContext.cancelAllJobs()
        raise TimeoutError(f"The recipe took more than {timeout} s") from None
    finally:
        pool.shutdown(wait=False)


class Frame:
    """Steps as methods: Frame(df).convert.case(input="x", case="upper").df."""

    def __init__(self, df: DataFrame, path: str = "", functions: Any = None) -> None:
        self.df, self._path, self._functions = df, path, functions

    def __getattr__(self, part: str) -> Frame:
        path = f"{self._path}.{part}".lstrip(".").removesuffix("_")
        if path not in OPERATORS and not any(k.startswith(path + ".") for k in OPERATORS):
            raise AttributeError(path)
        return Frame(self.df, path, self._functions)

    def __call__(self, **params: Any) -> Frame:
        ctx = Context(prepared(self.df.sparkSession), {}, functions_of(self._functions), steps)
        return Frame(planned(ctx, self.df, OPERATORS[self._path], params), "", self._functions)
