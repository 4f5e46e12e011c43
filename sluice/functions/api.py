"""Operators on plain values: api.call("convert.case", ["a", "b"], case="upper") gives a list, a single value a single value."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from sluice.plans import recipe


def call(operator: str, values: Any, *more: list, spark: SparkSession | None = None, **params: Any) -> Any:
    """The operator over values; further lists are further input columns. The result has the shape of values."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise ValueError("There is no active session")
    single = not isinstance(values, list)
    columns = [[v] if single else v for v in (values, *more)]
    if not columns[0]:
        return []
    names = [f"v{k}" for k in range(len(columns))]
    rows = [(i, *r) for i, r in enumerate(zip(*columns, strict=True))]
    df = spark.createDataFrame(rows, ["__at", *names])
    frame = recipe.Frame(df)
    for part in operator.split("."):
        frame = getattr(frame, part)
    made = frame(input=names if len(names) > 1 else names[0], output="__out", **params).df
    out = [r["__out"] for r in made.orderBy("__at").select("__out").collect()]
    return out[0] if single else out
