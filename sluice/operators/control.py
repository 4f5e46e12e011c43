"""Steps that run other steps."""

from __future__ import annotations

import itertools
import logging
import time
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import template
from sluice.order import ORDINAL, name, with_ordinal
from sluice.registry import Context, op

log_to = logging.getLogger("sluice")


def permutations(ctx: Context, df: DataFrame | None, variables: dict[str, Any], strategy: str = "loop") -> Iterator[dict[str, Any]]:
    """The variable sets of a matrix: lists, set(column), dir(path), custom.function."""
    lists: dict[str, list] = {}
    for key, value in variables.items():
        if isinstance(value, str) and value.startswith("set(") and df is not None:
            column = value[4:-1].strip()
            value = [r[0] for r in with_ordinal(df).groupBy(name(column)).agg(F.min(ORDINAL).alias("o")).orderBy("o").collect()]
        elif isinstance(value, str) and value.startswith("dir("):
            value = sorted(str(p) for p in Path(value[4:-1].strip()).iterdir() if p.is_file())
        elif isinstance(value, str) and value.startswith("custom."):
            value = ctx.function(value)()
        lists[key] = list(value) if isinstance(value, (list, tuple, set)) else [value]
    if strategy == "permutations":
        rows: Any = itertools.product(*lists.values())
    elif strategy == "loop":
        longest = max(map(len, lists.values()), default=0)
        rows = zip(*(itertools.islice(itertools.cycle(v), longest) for v in lists.values()), strict=True)
    else:
        raise ValueError("strategy must be loop or permutations")
    for row in rows:
        yield dict(zip(lists, row, strict=True))


@op("matrix", kind="split", expands=False)
def matrix(ctx: Context, df: DataFrame, variables, wrangles, functions=None, strategy: str = "loop"):
    for values in permutations(ctx, df, variables, strategy):
        df = ctx.run(ctx, df, template.bind(wrangles, {**ctx.variables, **values}))
    return df


@op("batch", kind="split", expands=False)
def batch(ctx: Context, df: DataFrame, wrangles, functions=None, variables=None, batch_size: int = 1000, threads: int = 1, on_error=None, timeout=None, use_multiprocessing: bool = False):
    """Spark runs row-wise steps in batches by itself; on_error stands in where the steps cannot be planned or run."""
    if on_error is None:
        return ctx.run(ctx, df, wrangles)
    return attempt(ctx, df, wrangles, **{"except": on_error})


@op("concurrent", kind="split", expands=False)
def concurrent(ctx: Context, df: DataFrame, wrangles, max_concurrency: int = 10, use_multiprocessing: bool = False, functions=None, variables=None):
    """Independent steps become projections of one stage."""
    return ctx.run(ctx, df, wrangles)


@op("try", kind="split", expands=False)
def attempt(ctx: Context, df: DataFrame, wrangles, functions=None, variables=None, retries: int = 0, **other):
    """The steps, forced here so that what fails in them is caught; else constants or other steps."""
    instead = other.get("except")
    for turn in range(retries + 1):
        try:
            found = ctx.run(ctx, df, wrangles)
            found.write.format("noop").mode("overwrite").save()
            return found
        except Exception as error:  # whatever the steps raise
            log_to.warning("try: %s", error)
            if turn < retries:
                time.sleep(1.5**turn)
            elif instead is None:
                raise
    if isinstance(instead, dict):
        return df.withColumns({k: F.lit(v) for k, v in instead.items()})
    return ctx.run(ctx, df, instead)


@op("log", kind="frame", expands=False)
def log(ctx: Context, df: DataFrame, columns=None, write=None, error=None, warning=None, info=None, log_data: bool | None = None):
    from sluice.operators.frame import selected

    for level, message in (("error", error), ("warning", warning), ("info", info)):
        if message:
            getattr(log_to, level)(template.bind(message, ctx.variables, strict=False))
    shown = selected(df, columns) if columns else df
    if log_data or (log_data is None and not (error or warning or info)):
        log_to.info("\n%s", pd.DataFrame([r.asDict() for r in shown.limit(20).collect()], columns=shown.columns).to_string())
    if write:
        from sluice.sources import writers

        writers.write(ctx, shown, write)
    return df


@op("recipe", kind="split", expands=False)
def recipe(ctx: Context, df: DataFrame, input=None, output=None, name=None, variables=None, functions=None, **inline):  # noqa: A002
    from sluice.plans import recipe as plans

    given = plans.load(name if name else inline, {**ctx.variables, **(variables or {})})
    steps = given.get("wrangles") or given.get("wrangle") or []
    made = ctx.run(ctx, df, steps)
    if output is not None:
        wanted = [output] if isinstance(output, str) else list(output)
        return made.select(*dict.fromkeys([*(c for c in df.columns if c in made.columns), *wanted]))
    return made
