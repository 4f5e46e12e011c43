"""Operators on whole frames: projection, filters, order, reshaping, aggregation, SQL."""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import columns, dialect
from sluice.operators.text import kind
from sluice.order import ORDINAL, name, settled, with_ordinal, with_position
from sluice.registry import Context, op


def selected(df: DataFrame, wanted) -> DataFrame:
    return df.select(*map(name, columns.expand(df.columns, wanted)))


@op("select.columns", kind="frame", expands=False)
def select_columns(ctx: Context, df: DataFrame, input):
    return selected(df, input)


@op("drop", kind="plain", expands=False)
def drop(ctx: Context, df: DataFrame, columns):  # noqa: A002
    from sluice.columns import expand

    wanted = [columns] if isinstance(columns, str) else columns
    return df.drop(*expand(df.columns, [w if w.endswith("?") else f"{w}?" if w not in df.columns and "*" not in w else w for w in wanted]))


@op("rename", kind="plain", expands=False)
def rename(ctx: Context, df: DataFrame, input=None, output=None, wrangles=None, **names):
    if wrangles:
        table = ctx.spark.createDataFrame([(c,) for c in df.columns], "column string")
        found = [r[0] for r in ctx.run(ctx, table, wrangles).select("column").collect()]
        return df.toDF(*found)
    if input is not None:
        sources = columns.expand(df.columns, input)
        targets = [output] if isinstance(output, str) else list(output)
        if len(sources) != len(targets):
            raise ValueError("input and output must be of equal length")
        names = dict(zip(sources, targets, strict=True))
    else:
        names = columns.renames(df.columns, names)
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"Columns {missing} do not exist")
    replaced = {t for s, t in names.items() if t != s} - set(names)
    return df.drop(*(c for c in df.columns if c in replaced)).withColumnsRenamed(names)


@op("copy", expands=False)
def copy(ctx: Context, df: DataFrame, input=None, output=None, **pairs):
    if input is None:
        return {t: name(s) for s, t in pairs.items()}
    if isinstance(input, dict):
        return {t: name(s) for s, t in input.items()}
    sources = columns.expand(df.columns, input)
    targets = [output] if isinstance(output, str) else list(output)
    sources = sources * len(targets) if len(sources) == 1 else sources
    if len(sources) != len(targets):
        raise ValueError("input and output must be of equal length")
    return {t: name(s) for s, t in zip(sources, targets, strict=True)}


@op("reindex", kind="plain", expands=False)
def reindex(ctx: Context, df: DataFrame, labels=None, index=None, columns=None, axis=None, fill_value=None):  # noqa: A002
    wanted = columns if columns is not None else labels if axis in (1, "columns") else None
    if wanted is not None:
        return df.select(*[name(c) if c in df.columns else F.lit(fill_value).alias(c) for c in wanted])
    places = index if index is not None else labels
    rows = ctx.spark.createDataFrame([(k, int(p)) for k, p in enumerate(places)], "__order long, __place long")
    found = rows.join(with_position(df, "__place"), "__place", "left").orderBy("__order").drop("__place", "__order")
    return found.fillna(fill_value) if fill_value is not None else found


@op("transpose", kind="frame", expands=False)
def transpose(ctx: Context, df: DataFrame, header_column=0):
    """For frames whose rows fit in columns: the header's values become the columns."""
    if header_column is None:
        df = with_position(df, "__header").select(name("__header").cast("string").alias("__header"), *map(name, df.columns))
        header = "__header"
    else:
        header = columns.expand(df.columns, header_column)[0]
    rest = [c for c in df.columns if c != header]
    heads = [r[0] for r in with_ordinal(df).orderBy(ORDINAL).select(name(header).cast("string")).collect()]
    same = len({kind(df, c) for c in rest}) == 1
    stacked = df.select(name(header).cast("string").alias("__head"), F.posexplode(F.array(*[name(c) if same else name(c).cast("string") for c in rest])).alias("__at", "__value"))
    wide = stacked.groupBy("__at").pivot("__head", list(dict.fromkeys(heads))).agg(F.first("__value"))
    names = F.array(*[F.lit(c) for c in rest])
    label = "index" if header == "__header" else header
    return wide.orderBy("__at").select(F.get(names, F.col("__at")).alias(label), *[name(h) for h in dict.fromkeys(heads)])


def keys(df: DataFrame, by, ascending=True, na_position: str = "last") -> list[Column]:
    by = columns.expand(df.columns, by)
    rising = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    if len(rising) != len(by):
        raise ValueError("by and ascending must be of equal length")
    last = na_position == "last"
    return [(name(c).asc_nulls_last() if last else name(c).asc_nulls_first()) if up else (name(c).desc_nulls_last() if last else name(c).desc_nulls_first()) for c, up in zip(by, rising, strict=True)]


@op("sort", kind="frame", expands=False)
def sort(ctx: Context, df: DataFrame, by, ascending=True, na_position: str = "last", ignore_index: bool = True):
    return df.orderBy(*keys(df, by, ascending, na_position))


@op("explode", kind="split", expands=False)
def explode(ctx: Context, df: DataFrame, input, reset_index: bool = True, drop_empty: bool = False):
    wanted = columns.expand(df.columns, input)
    if len(wanted) == 1:
        c = wanted[0]
        found = df.withColumn(c, F.explode_outer(name(c)))
    else:
        sizes = F.array_distinct(F.array(*[F.size(name(c)) for c in wanted]))
        zipped = F.arrays_zip(*[name(c).alias(f"c{k}") for k, c in enumerate(wanted)])
        checked = F.when(F.size(sizes) == 1, zipped).otherwise(F.raise_error("Lists to explode together must be of equal length"))
        found = df.withColumn("__zip", F.explode_outer(checked))
        zipped_type = found.schema["__zip"].dataType.names
        found = found.withColumns({c: F.col("__zip")[n] for c, n in zip(wanted, zipped_type, strict=True)}).drop("__zip")
    if drop_empty:
        any_left = F.lit(False)
        for c in wanted:
            any_left = any_left | name(c).isNotNull()
        found = found.where(any_left)
    return found


def _listed(x) -> list:
    return list(x) if isinstance(x, (list, tuple, set)) else [x]


@op("filter", kind="frame", expands=False)
def filter_(
    ctx: Context, df: DataFrame, input=None, equal=None, not_equal=None, is_in=None, not_in=None, greater_than=None, greater_than_equal_to=None, less_than=None,
    less_than_equal_to=None, between=None, contains=None, not_contains=None, is_null=None, inclusive: str = "both", case: bool = True,
):
    """Rows for which all conditions hold for all inputs. The negative ones keep nulls."""
    for c in columns.expand(df.columns, input) if input else []:
        x = name(c)
        text = x.cast("string")
        kept = []
        if equal is not None:
            kept.append(x.isin(_listed(equal)))
        if not_equal is not None:
            kept.append(x.isNull() | ~x.isin(_listed(not_equal)))
        if is_in is not None:
            kept.append(x.isin(_listed(is_in)))
        if not_in is not None:
            kept.append(x.isNull() | ~x.isin(_listed(not_in)))
        if greater_than is not None:
            kept.append(x > greater_than)
        if greater_than_equal_to is not None:
            kept.append(x >= greater_than_equal_to)
        if less_than is not None:
            kept.append(x < less_than)
        if less_than_equal_to is not None:
            kept.append(x <= less_than_equal_to)
        if between is not None:
            low, high = between
            kept.append((x >= low if inclusive in ("both", "left") else x > low) & (x <= high if inclusive in ("both", "right") else x < high))
        pattern = lambda p: dialect.java_pattern(str(p) if case else f"(?i){p}")
        if contains is not None:
            kept.append(text.rlike(pattern(contains)))
        if not_contains is not None:
            kept.append(x.isNull() | ~text.rlike(pattern(not_contains)))
        if is_null is not None:
            blank = x.isNull() | (text == "")
            kept.append(blank if is_null else ~blank)
        for condition in kept:
            df = df.where(condition)
    return df


@op("select.head", kind="frame", expands=False)
def head(ctx: Context, df: DataFrame, n: int):
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError("n must be a positive whole number")
    return df.limit(n)


@op("select.tail", kind="frame", expands=False)
def tail(ctx: Context, df: DataFrame, n: int):
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError("n must be a positive whole number")
    return with_ordinal(df).orderBy(F.desc(ORDINAL)).limit(n).orderBy(ORDINAL).drop(ORDINAL)


def _drawn(df: DataFrame, rows: int, random_state: int | None, weights: str | None) -> DataFrame:
    """That many rows, at most as many as df has, each drawn from all of df by row number or by running weight."""
    rows = min(rows, df.count())
    if not rows:
        return df.limit(0)
    draws = df.sparkSession.range(rows).select(F.rand(random.randrange(1 << 31) if random_state is None else random_state).alias("__u"))
    if not weights:
        raw = with_position(df, "__at")
        whole = raw.agg(F.max("__at")).first()[0] + 1
        return raw.join(draws.select(F.floor(F.col("__u") * whole).alias("__at")), "__at").drop("__at")
    raw = settled(df).withColumn("__at", F.monotonically_increasing_id())
    weighed = raw.select("__at", F.shiftright("__at", 33).alias("__part"), F.coalesce(name(weights).cast("double"), F.lit(0.0)).alias("__w"))
    parts = weighed.groupBy("__part").agg(F.sum("__w").alias("w"), F.min("__w").alias("least")).orderBy("__part").collect()  # one row for each partition
    if any(p["least"] < 0 for p in parts) or not any(p["w"] > 0 for p in parts):
        raise ValueError("weights must not be negative, nor all zero")
    parts = [p for p in parts if p["w"] > 0]
    begins = [0.0, *itertools.accumulate(p["w"] for p in parts)]
    x = F.col("__u") * begins.pop()
    k = F.size(F.filter(F.array(*map(F.lit, begins)), lambda b: b <= x))
    draws = draws.select(F.element_at(F.array(*[F.lit(p["__part"]) for p in parts]), k).alias("__part"), (x - F.element_at(F.array(*map(F.lit, begins)), k)).alias("__start"), F.lit(None).cast("long").alias("__at"))
    before = F.sum("__w").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    starts = weighed.where("__w > 0").select("__part", F.coalesce(before, F.lit(0.0)).alias("__start"), "__at")
    here = Window.partitionBy("__part").orderBy("__start", F.col("__at").isNull(), "__at").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.union(draws).withColumn("__hit", F.last("__at", ignorenulls=True).over(here)).where("__at is null")
    return raw.join(found.select(F.col("__hit").alias("__at")), "__at").drop("__at")


@op("select.sample", kind="frame", expands=False)
def sample(ctx: Context, df: DataFrame, rows, random_state: int | None = None, replace: bool = False, weights: str | None = None):
    """An exact number of rows, or exactly that share of them."""
    if rows < 1:
        df = settled(df)
        rows = round(rows * df.count())
    if replace:
        return _drawn(df, int(rows), random_state, weights)
    key = F.rand(random_state) if random_state is not None else F.rand()
    if weights:
        key = -F.pow(key, F.try_divide(F.lit(1.0), name(weights)))  # the largest keys are a weighted sample
    return df.withColumn("__key", key).orderBy("__key").limit(int(rows)).drop("__key")


@op("sql", kind="frame", expands=False)
def sql(ctx: Context, df: DataFrame, command: str, params=None, preserve_index: bool = False, preserve_data_types: bool = True):
    if not re.match(r"\s*(select|with)\b", command, re.I):
        raise ValueError("Only SELECT statements are supported")
    return ctx.spark.sql(re.sub(r"(?i)\b(from|join)\s+df\b", r"\1 {df}", dialect.sql(command, params).replace("{", "{{").replace("}", "}}")), df=df)


_AGGREGATES = {
    "min": F.min, "max": F.max, "sum": F.sum, "mean": F.avg, "median": F.median, "count": F.count, "nunique": F.countDistinct, "std": F.stddev_samp, "var": F.var_samp, "prod": F.product,
    "sem": lambda x: F.stddev_samp(x) / F.sqrt(F.count(x)), "size": lambda x: F.count(F.lit(1)), "kurt": F.kurtosis, "mode": F.mode,
    "skew": lambda x: F.skewness(x) * F.sqrt(F.count(x) * (F.count(x) - 1.0)) / F.nullif(F.count(x) - 2.0, F.lit(0.0)),
}


def _truth(df: DataFrame, column: str) -> Column:
    k, x = kind(df, column), name(column)
    if isinstance(k, T.BooleanType):
        return x
    return x != "" if isinstance(k, T.StringType) else x != 0 if isinstance(k, T.NumericType) else x.isNotNull()


def aggregate(ctx: Context, df: DataFrame, column: str, how: str) -> Column:
    x = name(column)
    if how in ("first", "last"):
        # in row order, and of rows that have a value
        at = F.when(x.isNotNull(), F.col(ORDINAL))
        return F.min_by(x, at) if how == "first" else F.max_by(x, at)
    if how in ("any", "all"):
        return (F.bool_or if how == "any" else F.bool_and)(_truth(df, column))
    if re.fullmatch(r"p\d{1,3}", how):
        return F.percentile(x, F.lit(int(how[1:]) / 100))
    if how == "list":
        return F.transform(F.sort_array(F.collect_list(F.struct(F.col(ORDINAL).alias("o"), x.alias("x")))), lambda s: s["x"])
    if how == "counts":
        raise ValueError("counts is planned apart")
    if how.startswith("custom."):
        call = ctx.function(how)

        def whole(values: pd.Series) -> float:  # the hints make it an aggregate; its type is what call says
            return call(values)

        whole.__annotations__ = {"values": pd.Series, "return": float}
        return F.pandas_udf(whole, _result(call))(x)
    if how not in _AGGREGATES:
        raise ValueError(f"{how} is no aggregate")
    return _AGGREGATES[how](x)


def _result(call) -> str:
    import inspect

    annotated = inspect.signature(call).return_annotation
    return {int: "long", float: "double", str: "string", bool: "boolean", "int": "long", "float": "double", "str": "string", "bool": "boolean"}.get(annotated, "double")


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Two frames of one row for each key, null keys too; without keys each is one row."""
    if not by:
        return left.crossJoin(right)
    right = right.withColumnsRenamed({c: f"__key{k}" for k, c in enumerate(by)})
    same = reduce(lambda a, b: a & b, [name(c).eqNullSafe(F.col(f"__key{k}")) for k, c in enumerate(by)])
    return left.join(right, same).drop(*[f"__key{k}" for k in range(len(by))])


@op("select.group_by", kind="frame", expands=False)
def group_by(ctx: Context, df: DataFrame, by=None, functions=None, auto_rename_columns: bool = True, **wanted):
    by = columns.expand(df.columns, by) if by else []
    jobs: list[tuple[str, str, str]] = []
    for how, given in wanted.items():
        for one in given if isinstance(given, list) else [given]:
            pairs = one.items() if isinstance(one, dict) else [(c, None) for c in columns.expand(df.columns, one)]
            jobs += [(c, how, alias or (f"{c}.{how}" if auto_rename_columns else c)) for c, alias in pairs]
    if len({a for *_, a in jobs} | set(by)) < len(jobs) + len(by):
        raise ValueError("Two results would have one name")
    if not jobs:
        return df.select(*map(name, by)).distinct()
    ordered = any(how in ("first", "last", "list") for _, how, _ in jobs)
    source = with_ordinal(df) if ordered else df
    plain = [aggregate(ctx, df, c, how).alias(a) for c, how, a in jobs if how != "counts" and not how.startswith("custom.")]
    grouped = source.groupBy(*map(name, by))
    out = grouped.agg(*plain) if plain else source.select(*map(name, by)).distinct() if by else ctx.spark.range(1).select()
    for c, how, alias in jobs:
        if how.startswith("custom."):  # Spark doesn't mix these with others
            out = _beside(out, df.groupBy(*map(name, by)).agg(aggregate(ctx, df, c, how).alias(alias)), by)
        if how != "counts":
            continue
        value = F.coalesce(name(c).cast("string"), F.lit("null"))
        counted = df.groupBy(*map(name, by), value.alias("__v")).agg(F.count("*").alias("__n"))
        pairs = F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col("__v").alias("v"))))
        made = counted.groupBy(*map(name, by)).agg(F.map_from_entries(F.transform(pairs, lambda s: F.struct(s["v"], -s["n"]))).alias(alias))
        out = _beside(out, made, by)
    return out.select(*map(name, by), *[name(a) for *_, a in jobs])


@op("accordion", kind="frame", expands=False)
def accordion(ctx: Context, df: DataFrame, wrangles, input, output=None, propagate=None, functions=None, variables=None):
    """The steps over the elements of lists, gathered again row by row."""
    inputs = columns.expand(df.columns, input)
    outputs = inputs if output is None else [output] if isinstance(output, str) else list(output)
    base = with_ordinal(settled(df), "__row")  # read twice: for its lists and for the rest of its rows
    kept = columns.expand(df.columns, propagate) if propagate else []
    lists = [name(c) if isinstance(kind(df, c), T.ArrayType) else F.from_json(name(c), "array<string>").alias(c) for c in inputs]
    rows = base.select("__row", *map(name, kept), *[x.alias(c) for x, c in zip(lists, inputs, strict=True)])
    if len(inputs) == 1:
        rows = rows.select("__row", *map(name, kept), F.posexplode(name(inputs[0])).alias("__at", inputs[0]))
    else:
        zipped = F.arrays_zip(*map(name, inputs))
        rows = rows.select("__row", *map(name, kept), F.posexplode(zipped).alias("__at", "__z"))
        rows = rows.withColumns({c: F.col("__z")[n] for c, n in zip(inputs, rows.schema["__z"].dataType.names, strict=True)}).drop("__z")
    done = ctx.run(ctx, rows, wrangles)
    gathered = done.groupBy("__row").agg(*[F.transform(F.sort_array(F.collect_list(F.struct("__at", name(o).alias("v")))), lambda s: s["v"]).alias(f"__new{k}") for k, o in enumerate(outputs)])
    joined = base.join(gathered, "__row", "left")
    joined = joined.withColumns({o: F.coalesce(F.col(f"__new{k}"), F.array().cast(joined.schema[f"__new{k}"].dataType)) for k, o in enumerate(outputs)})
    return joined.orderBy("__row").drop("__row", *[f"__new{k}" for k in range(len(outputs))])


@op("format.price_breaks", kind="frame", expands=False)
def price_breaks(ctx: Context, df: DataFrame, input, categoryLabel: str, valueLabel: str):  # noqa: N803
    """Headers and values of filled columns as numbered label and value columns."""
    inputs = columns.expand(df.columns, input)
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("l"), name(c).cast("string").alias("v")) for c in inputs]), lambda x: x["v"].isNotNull() & (x["v"] != ""))
    width = df.select(F.max(F.size(pairs))).first()[0] or 0
    made = {}
    for k in range(width):
        one = F.get(pairs, F.lit(k))
        made[f"{categoryLabel} {k + 1}"], made[f"{valueLabel} {k + 1}"] = F.coalesce(one["l"], F.lit("")), F.coalesce(one["v"], F.lit(""))
    return df.withColumns(made)


def _passthrough(method: str, call) -> None:
    op(f"pandas.{method}", kind="plain", expands=False)(call)


_passthrough("head", lambda ctx, df, parameters=None, **_: df.limit((parameters or {}).get("n", 5)))
_passthrough("tail", lambda ctx, df, parameters=None, **_: tail(ctx, df, (parameters or {}).get("n", 5)))
_passthrough("round", lambda ctx, df, input=None, output=None, parameters=None, **_: df.withColumns({o: F.bround(name(i), (parameters or {}).get("decimals", 0)) for i, o in zip(_listed(input), _listed(output or input), strict=True)} if input else {c: F.bround(name(c), (parameters or {}).get("decimals", 0)) for c in df.columns if isinstance(kind(df, c), (T.DoubleType, T.FloatType))}))
_passthrough("transpose", lambda ctx, df, parameters=None, **_: transpose(ctx, df, None))
_passthrough("drop_duplicates", lambda ctx, df, parameters=None, **_: first_rows(df, _listed((parameters or {}).get("subset", df.columns))))
_passthrough("sort_values", lambda ctx, df, parameters=None, **_: sort(ctx, df, **(parameters or {})))
_passthrough("fillna", lambda ctx, df, parameters=None, **_: df.fillna((parameters or {})["value"]))
_passthrough("dropna", lambda ctx, df, parameters=None, **_: df.dropna(how=(parameters or {}).get("how", "any"), subset=(parameters or {}).get("subset")))
_passthrough("rename", lambda ctx, df, parameters=None, **_: df.withColumnsRenamed((parameters or {})["columns"]))
_passthrough("astype", lambda ctx, df, parameters=None, **_: df.withColumns({c: name(c).cast(t) for c, t in (parameters or {})["dtype"].items()}))


def first_rows(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first row, in row order, of each group."""
    numbered = with_ordinal(df)
    order = Window.partitionBy(*map(name, by)).orderBy(ORDINAL)
    return numbered.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", ORDINAL)


