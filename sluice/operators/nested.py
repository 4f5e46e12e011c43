"""Lists, mappings, JSON and YAML."""

from __future__ import annotations

import json
import re

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.columns import _glob
from sluice.operators.text import distinct, holds, is_list, is_text, kind, pick, spread
from sluice.order import ORDINAL, name, with_ordinal
from sluice.registry import Context, op


def as_map(df: DataFrame, column: str) -> Column:
    """A mapping of strings from a map, a struct or JSON text."""
    k, x = kind(df, column), name(column)
    if isinstance(k, T.MapType):
        return x.cast("map<string,string>")
    if isinstance(k, T.StructType):
        return F.from_json(F.to_json(x), "map<string,string>")
    return F.from_json(x.cast("string"), "map<string,string>")


def as_list(df: DataFrame, column: str) -> Column:
    return name(column) if is_list(df, column) else F.from_json(name(column).cast("string"), "array<string>")


def keys_of(df: DataFrame, maps: Column) -> list[str]:
    """All keys of a column of mappings; one small aggregate."""
    found = with_ordinal(df).select(ORDINAL, F.posexplode(F.map_keys(maps)).alias("p", "k")).groupBy("k").agg(F.min(F.struct(ORDINAL, "p")).alias("at")).orderBy("at", "k").collect()
    return [r["k"] for r in found]


@op("convert.from_json")
def from_json(ctx: Context, df: DataFrame, input, output, default=None, schema: str | None = None):
    def parsed(x: Column) -> Column:
        if schema:
            return F.from_json(x, schema)
        out = F.try_parse_json(x)
        bad = F.raise_error(F.concat(F.lit("Not JSON: "), F.left(x, F.lit(80)))) if default is None else F.parse_json(F.lit(json.dumps(default)))
        return F.when(x.isNull() | out.isNotNull(), out).otherwise(bad)

    return {o: parsed(name(i).cast("string")) for i, o in zip(input, output, strict=True)}


def _json(df: DataFrame, column: str) -> Column:
    """JSON text of a column's value, null where it has none."""
    k, x = kind(df, column), name(column)
    if isinstance(k, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(x)
    return F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", "$1")


@op("convert.to_json")
def to_json(ctx: Context, df: DataFrame, input, output, ensure_ascii: bool = False):
    if len(output) == 1 and len(input) > 1:
        return {output[0]: F.to_json(F.struct(*[name(i) for i in input]), {"ignoreNullFields": "false"})}
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return {o: F.to_json(name(i)) if isinstance(kind(df, i), nested) else F.to_json(F.array(name(i))) for i, o in zip(input, output, strict=True)}


@op("convert.from_yaml")
def from_yaml(ctx: Context, df: DataFrame, input, output, default=None):
    def one(text):
        try:
            out = yaml.safe_load(text) if text else default
        except yaml.YAMLError:
            if default is None:
                raise
            out = default
        return None if out is None else json.dumps(out, default=str)

    call = F.pandas_udf(lambda s: pd.Series([one(x) for x in s], dtype=object), "string")
    return {o: F.parse_json(call(name(i).cast("string"))) for i, o in zip(input, output, strict=True)}


@op("convert.to_yaml")
def to_yaml(ctx: Context, df: DataFrame, input, output, sort_keys: bool = False, allow_unicode: bool = True):
    call = F.pandas_udf(lambda s: pd.Series([None if x is None else yaml.safe_dump(json.loads(x), sort_keys=sort_keys, allow_unicode=allow_unicode) for x in s], dtype=object), "string")
    if len(output) == 1 and len(input) > 1:
        return {output[0]: call(F.to_json(F.struct(*[name(i) for i in input]), {"ignoreNullFields": "false"}))}
    return {o: call(_json(df, i)) for i, o in zip(input, output, strict=True)}


def _chosen(m: Column, pattern: str, text: str | None) -> Column:
    part = F.map_filter(m, lambda k, v: k.rlike(pattern))
    return F.transform_keys(part, lambda k, v: F.regexp_replace(k, pattern, text)) if text else part


@op("select.dictionary_element")
def dictionary_element(ctx: Context, df: DataFrame, input, output, element, default=""):
    out = {}
    for i, o in zip(input, output, strict=True):
        k = kind(df, i)
        if isinstance(element, str) and "*" not in element and not element.startswith("regex:"):
            if isinstance(k, T.StructType):
                out[o] = name(i)[element] if element in k.names else F.lit(default)
            else:
                m = name(i) if isinstance(k, T.MapType) else as_map(df, i)
                out[o] = F.coalesce(F.try_element_at(m, F.lit(element)), F.lit(default)) if default is not None else F.try_element_at(m, F.lit(element))
            continue
        wanted = element if isinstance(element, dict) else {e: None for e in ([element] if isinstance(element, str) else element)}
        m = as_map(df, i)
        chosen = None
        for source, target in wanted.items():
            pattern = source[6:].strip() if source.startswith("regex:") else _glob(source)
            part = _chosen(m, f"^(?:{pattern})$", re.sub(r"\*", "\\$1", target) if target else None)
            chosen = part if chosen is None else F.map_concat(chosen, part)
        out[o] = chosen
    return out


@op("select.list_element")
def list_element(ctx: Context, df: DataFrame, input, output, element=0, default=""):
    out = {}
    for i, o in zip(input, output, strict=True):
        found = pick(as_list(df, i), element)
        simple = ":" not in str(element)
        out[o] = F.coalesce(found, F.lit(default)) if simple and default is not None else found
    return out


@op("select.element", expands=False)
def element(ctx: Context, df: DataFrame, input, output=None, default=None):
    inputs = [input] if isinstance(input, (str, dict)) else list(input)
    outputs = inputs if output is None else [output] if isinstance(output, str) else list(output)
    out = {}
    for path, o in zip(inputs, outputs, strict=True):
        head = re.match(r"[^\[]+", path)[0]
        x, k = name(head), kind(df, head)
        if isinstance(k, T.StringType):
            x, k = F.try_parse_json(x), T.VariantType()
        for part in re.findall(r"\[([^\]]*)\]", path):
            part = part.strip()
            key = part.strip("'\"")
            if isinstance(k, T.VariantType):
                at = f"$[{int(part)}]" if re.fullmatch(r"\d+", part) else f"$['{key}']"
                x = F.try_variant_get(x, at, "variant")
            elif isinstance(k, T.ArrayType):
                x = pick(x, part)
                k = k if ":" in part else k.elementType
            elif isinstance(k, T.MapType):
                x, k = F.try_element_at(x, F.lit(key)), k.valueType
            elif isinstance(k, T.StructType):
                field = k.names[int(part)] if re.fullmatch(r"\d+", part) else key
                x, k = x[field], k[field].dataType
        if isinstance(k, T.VariantType):
            x = F.try_variant_get(x, "$", "string")
        out[o] = x if default is None else F.coalesce(x, F.lit(default))
    return out


@op("split.list", expands=False)
def split_list(ctx: Context, df: DataFrame, input, output):
    source = input[0] if isinstance(input, list) else input
    return spread(df, as_list(df, source), [output] if isinstance(output, str) else list(output))


@op("split.dictionary", kind="frame", expands=False)
def split_dictionary(ctx: Context, df: DataFrame, input, output=None, default=None, output_format: str = "columns"):
    inputs = [input] if isinstance(input, str) else list(input)
    merged = F.map_concat(*[as_map(df, i) for i in inputs]) if len(inputs) > 1 else as_map(df, inputs[0])
    if output_format == "to_lists":
        keys, values = output
        return df.withColumns({keys: F.map_keys(merged), values: F.map_values(merged)})
    struct = kind(df, inputs[0])
    given = [output] if isinstance(output, str) else output
    if len(inputs) == 1 and isinstance(struct, T.StructType) and given is None:
        return df.withColumns({n: name(inputs[0])[n] for n in struct.names})
    if isinstance(given, list) and all(isinstance(g, str) and "*" not in g for g in given):
        wanted = {g: g for g in given}
    else:
        from sluice.columns import renames

        every = keys_of(df, merged)
        flat: dict = {}
        for g in given or []:
            flat.update(g if isinstance(g, dict) else {g: None})
        wanted = {k: v or k for k, v in (renames(every, flat) if flat and all(flat.values()) else dict.fromkeys(every)).items()}
    return df.withColumns({o: F.coalesce(F.try_element_at(merged, F.lit(k)), F.lit(default if default is not None else "")) for k, o in wanted.items()})


def _blank(df: DataFrame, column: str) -> Column:
    k, x = kind(df, column), name(column)
    if isinstance(k, T.StringType):
        return x.isNull() | (x == "")
    if isinstance(k, (T.ArrayType, T.MapType)):
        return x.isNull() | (F.size(x) == 0)
    if isinstance(k, T.BooleanType):
        return x.isNull() | ~x
    return x.isNull() | (x == 0) if isinstance(k, T.NumericType) else x.isNull()


@op("merge.to_list")
def to_list(ctx: Context, df: DataFrame, input, output, include_empty: bool = False):
    one = len({kind(df, i) for i in input}) == 1
    items = F.array(*[F.struct((name(i) if one else name(i).cast("string")).alias("v"), _blank(df, i).alias("e")) for i in input])
    kept = items if include_empty else F.filter(items, lambda x: ~x["e"])
    return {output[0]: F.transform(kept, lambda x: x["v"])}


@op("merge.to_dict")
def to_dict(ctx: Context, df: DataFrame, input, output, include_empty: bool = False):
    one = len({kind(df, i) for i in input}) == 1
    entries = F.array(*[F.struct(F.lit(i).alias("k"), (name(i) if one else name(i).cast("string")).alias("v"), _blank(df, i).alias("e")) for i in input])
    kept = entries if include_empty else F.filter(entries, lambda x: ~x["e"])
    return {output[0]: F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"])))}


@op("merge.lists")
def merge_lists(ctx: Context, df: DataFrame, input, output, remove_duplicates: bool = False, ignore_case: bool = False, include_empty: bool = True):
    one = all(is_list(df, i) for i in input) and len({kind(df, i) for i in input}) == 1
    parts = [F.coalesce(name(i) if one else name(i).cast("array<string>") if is_list(df, i) else F.array(name(i).cast("string")), F.array().cast("array<string>") if not one else F.array().cast(kind(df, i))) for i in input]
    items = F.concat(*parts)
    if not include_empty:
        items = F.filter(items, lambda x: x.isNotNull() & (x.cast("string") != ""))
    return {output[0]: distinct(items, ignore_case) if remove_duplicates else items}


@op("merge.dictionaries")
def dictionaries(ctx: Context, df: DataFrame, input, output, skip_empty: bool = False):
    same = len({kind(df, i) for i in input}) == 1 and isinstance(kind(df, input[0]), T.MapType)
    merged = F.map_concat(*[F.coalesce(name(i) if same else as_map(df, i), F.create_map().cast(kind(df, i) if same else "map<string,string>")) for i in input])
    return {output[0]: F.map_filter(merged, lambda k, v: v.isNotNull() & (v.cast("string") != "")) if skip_empty else merged}


@op("merge.key_value_pairs", expands=False)
def key_value_pairs(ctx: Context, df: DataFrame, input, output, skip_empty: bool = False):
    from sluice.columns import expand

    pairs = []
    for k, v in (input if isinstance(input, dict) else {a: b for x in input for a, b in x.items()}).items():
        pairs += list(zip(expand(df.columns, k), expand(df.columns, v), strict=True))
    one = len({kind(df, v) for _, v in pairs}) == 1
    entries = F.array(*[F.struct(name(k).cast("string").alias("k"), (name(v) if one else name(v).cast("string")).alias("v")) for k, v in pairs])
    entries = F.filter(entries, lambda x: x["k"].isNotNull() & ((x["v"].isNotNull() & (x["v"].cast("string") != "")) if skip_empty else F.lit(True)))
    return {(output if isinstance(output, str) else output[0]): F.map_from_entries(entries)}


@op("merge.coalesce")
def coalesce(ctx: Context, df: DataFrame, input, output):
    if len(input) == 1 and is_list(df, input[0]):
        return {output[0]: F.coalesce(F.get(F.filter(name(input[0]), lambda x: x.isNotNull() & (F.trim(x.cast("string")) != "")), F.lit(0)).cast("string"), F.lit(""))}
    one = len({kind(df, i) for i in input}) == 1
    values = [F.when(F.trim(name(i).cast("string")) != "", name(i) if one else name(i).cast("string")) if is_text(df, i) or not one else name(i) for i in input]
    return {output[0]: F.coalesce(*values, *([F.lit("")] if is_text(df, input[0]) or not one else []))}


def _not(condition):
    return lambda x: ~condition(x)


@op("compare.lists")
def compare_lists(ctx: Context, df: DataFrame, input, output, method: str = "intersection", remove_duplicates: bool = False, ignore_case: bool = False):
    fold = (lambda x: F.lower(x.cast("string"))) if ignore_case else (lambda x: x)
    lists = [as_list(df, i) for i in input]
    first, found = lists[0], lists[0]
    if method == "intersection":
        for other in lists[1:]:
            folded = F.transform(other, fold)
            found = F.filter(found, holds(folded, fold))
    elif method == "difference":
        for other in lists[1:]:
            folded = F.transform(other, fold)
            inside = holds(folded, fold)
            found = F.filter(found, _not(inside))
    elif method == "union":
        found = F.concat(first, *lists[1:])
    else:
        raise ValueError("method must be intersection, difference or union")
    return {output[0]: distinct(found, ignore_case) if remove_duplicates else found}


def _confident(df: DataFrame, column: str) -> Column:
    """struct(confidence, value) from [value, confidence], value || confidence, or {value: confidence}."""
    k, x = kind(df, column), name(column)
    if isinstance(k, T.ArrayType):
        return F.struct(F.get(x, F.lit(1)).try_cast("double").alias("c"), F.get(x, F.lit(0)).cast("string").alias("v"))
    if isinstance(k, T.MapType):
        return F.struct(F.get(F.map_values(x), F.lit(0)).try_cast("double").alias("c"), F.get(F.map_keys(x), F.lit(0)).alias("v"))
    parts = F.split(x, r"\s*\|\|\s*")
    return F.struct(F.get(parts, F.lit(1)).try_cast("double").alias("c"), F.get(parts, F.lit(0)).alias("v"))


@op("select.highest_confidence")
def highest_confidence(ctx: Context, df: DataFrame, input, output):
    best = F.array_max(F.array(*[_confident(df, i) for i in input]))
    return {output[0]: F.array(best["v"], best["c"].cast("string"))} if len(output) == 1 else {output[0]: best["v"], output[1]: best["c"]}


@op("select.threshold")
def threshold(ctx: Context, df: DataFrame, input, output, threshold: float):
    first, second = _confident(df, input[0]), name(input[1]).cast("string")
    return {output[0]: F.when(first["c"] > threshold, first["v"]).otherwise(second)}
