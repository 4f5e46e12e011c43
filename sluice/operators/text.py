"""String operators."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.dialect import expression, java_pattern, java_replacement, safe_name
from sluice.functions import kernels
from sluice.order import name
from sluice.registry import Context, op


def kind(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def is_list(df: DataFrame, column: str) -> bool:
    return isinstance(kind(df, column), T.ArrayType)


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(kind(df, column), T.StringType)


def each(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str], f, only_text: bool = False) -> dict[str, Column]:
    """f over each input, element by element in lists of strings; with only_text other columns pass unchanged."""
    out = {}
    for i, o in zip(inputs, outputs, strict=True):
        k = kind(df, i)
        if isinstance(k, T.ArrayType) and isinstance(k.elementType, T.StringType):
            out[o] = F.transform(name(i), f)
        elif only_text and not isinstance(k, T.StringType):
            out[o] = name(i)
        else:
            out[o] = f(name(i) if isinstance(k, T.StringType) else name(i).cast("string"))
    return out


def capitalised(x: Column) -> Column:
    """A capital after everything but a letter."""
    parts = F.regexp_extract_all(x, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 30)))), "")


@op("convert.case")
def case(ctx: Context, df: DataFrame, input, output, case: str = "lower"):
    how = {
        "lower": F.lower,
        "upper": F.upper,
        "title": capitalised,
        "sentence": lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 30))),
    }
    if case.lower() not in how:
        raise ValueError(f"case must be one of {', '.join(how)}")
    return each(df, input, output, how[case.lower()], only_text=True)


@op("clean_whitespaces")
def clean_whitespaces(ctx: Context, df: DataFrame, input, output, trim: bool = True, remove_literals: bool = True):
    runs = r"(?U)\s{2,}|[ \u2007\u0081]" if remove_literals else r"[ \u2007\u0081]+"
    ends = r"(?U)^\s+|\s+$"
    return each(df, input, output, lambda x: F.regexp_replace(F.regexp_replace(x, runs, " "), ends, "") if trim else F.regexp_replace(x, runs, " "), only_text=True)


@op("format.trim")
def trim(ctx: Context, df: DataFrame, input, output):
    return each(df, input, output, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), only_text=True)


@op("format.pad")
def pad(ctx: Context, df: DataFrame, input, output, pad_length: int, side: str, char: str, skip_empty: bool = False):
    n, char = int(pad_length), str(char)

    def padded(x: Column) -> Column:
        if side == "left":
            out = F.lpad(x, n, char)
        elif side == "right":
            out = F.rpad(x, n, char)
        elif side == "both":
            # the odd character goes as in str.center
            gap = F.lit(n) - F.length(x)
            left = (gap / 2).cast("int") + F.when((gap % 2 == 1) & F.lit(n % 2 == 1), 1).otherwise(0)
            out = F.rpad(F.concat(F.repeat(F.lit(char), left), x), n, char)
        else:
            raise ValueError("side must be left, right or both")
        out = F.when(F.length(x) < n, out).otherwise(x)
        return F.when(x == "", x).otherwise(out) if skip_empty else out

    return each(df, input, output, padded)


def _empty(x: Column) -> Column:
    return x.isNull() | (x == "")


@op("format.prefix")
def prefix(ctx: Context, df: DataFrame, input, output, value, skip_empty: bool = False):
    return each(df, input, output, lambda x: F.when(_empty(x), x).otherwise(F.concat(F.lit(str(value)), x)) if skip_empty else F.concat(F.lit(str(value)), F.coalesce(x, F.lit(""))))


@op("format.suffix")
def suffix(ctx: Context, df: DataFrame, input, output, value, skip_empty: bool = False):
    return each(df, input, output, lambda x: F.when(_empty(x), x).otherwise(F.concat(x, F.lit(str(value)))) if skip_empty else F.concat(F.coalesce(x, F.lit("")), F.lit(str(value))))


def distinct(items: Column, ignore_case: bool = False) -> Column:
    """Each element once, the first of equal ones."""
    if not ignore_case:
        return F.array_distinct(items)
    lowered = F.transform(items, lambda x: F.lower(x.cast("string")))
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x.cast("string"))) == i + 1)


@op("format.remove_duplicates")
def remove_duplicates(ctx: Context, df: DataFrame, input, output, ignore_case: bool = False):
    return {o: distinct(name(i), ignore_case) if is_list(df, i) else F.array_join(distinct(F.split(name(i), " "), ignore_case), " ") for i, o in zip(input, output, strict=True)}


@op("remove_words")
def remove_words(ctx: Context, df: DataFrame, input, output, to_remove, tokenize_to_remove: bool = False, ignore_case: bool = True):
    lists = []
    for c in [to_remove] if isinstance(to_remove, str) else to_remove:
        k = kind(df, c)
        x = name(c)
        if not isinstance(k, T.ArrayType):
            x = F.array(x.cast("string"))
        elif isinstance(k.elementType, T.ArrayType):
            x = F.flatten(x)
        lists.append(F.coalesce(x.cast("array<string>"), F.array().cast("array<string>")))
    words = F.concat(*lists)

    def run(texts: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([kernels.without_words(t, w, tokenize_to_remove, ignore_case) for t, w in zip(texts, words, strict=True)], dtype=object)

    call = F.pandas_udf(run, "string")
    return {o: call(F.array_join(name(i), " ") if is_list(df, i) else name(i).cast("string"), words) for i, o in zip(input, output, strict=True)}


@op("replace")
def replace(ctx: Context, df: DataFrame, input, output, find, replace):
    pattern, text = java_pattern(str(find)), java_replacement(str(replace))
    simple = {c for c in input if isinstance(kind(df, c), (T.BooleanType, T.MapType, T.StructType, T.ArrayType))}
    return {o: name(i) if i in simple else F.regexp_replace(name(i).cast("string"), pattern, text) for i, o in zip(input, output, strict=True)}


def _left(x: Column, n: int, listed: bool) -> Column:
    if not n:
        raise ValueError("length must not be 0")
    size = F.size(x) if listed else F.length(x)
    keep = F.lit(n) if n > 0 else F.greatest(size + n, F.lit(0))
    return F.slice(x, F.lit(1), keep) if listed else F.substring(x, F.lit(1), keep)


def _right(x: Column, n: int, listed: bool) -> Column:
    if not n:
        raise ValueError("length must not be 0")
    size = F.size(x) if listed else F.length(x)
    skip = F.greatest(size - n, F.lit(0)) if n > 0 else F.lit(-n)
    return F.slice(x, skip + 1, F.greatest(size - skip, F.lit(0))) if listed else F.substring(x, skip + 1, F.lit(1 << 30))


@op("select.left")
def left(ctx: Context, df: DataFrame, input, output, length: int):
    return {o: _left(name(i) if is_list(df, i) else name(i).cast("string"), int(length), is_list(df, i)) for i, o in zip(input, output, strict=True)}


@op("select.right")
def right(ctx: Context, df: DataFrame, input, output, length: int):
    return {o: _right(name(i) if is_list(df, i) else name(i).cast("string"), int(length), is_list(df, i)) for i, o in zip(input, output, strict=True)}


@op("select.substring")
def substring(ctx: Context, df: DataFrame, input, output, start: int | None = None, length: int | None = None):
    if start is None and length is None:
        raise ValueError("start or length is needed")
    return {o: F.substring(name(i).cast("string"), F.lit(start or 1), F.lit(1 << 30 if length is None else length)) for i, o in zip(input, output, strict=True)}


@op("select.length")
def length(ctx: Context, df: DataFrame, input, output):
    return {o: F.size(name(i)).cast("long") if isinstance(kind(df, i), (T.ArrayType, T.MapType)) else F.length(name(i).cast("string")).cast("long") for i, o in zip(input, output, strict=True)}


def separated(x: Column, char: str, inclusive: bool = False) -> Column:
    """A text split at a literal separator or at regex: a pattern."""
    pattern = java_pattern(char[6:].strip()) if char.startswith("regex:") else "\\Q" + char + "\\E" if char else "(?!^)(?!$)"
    parts = F.split(x, pattern, -1)
    if not inclusive:
        return parts
    between = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    return F.flatten(F.transform(parts, lambda p, i: F.when(i < F.size(between), F.array(p, F.get(between, i))).otherwise(F.array(p))))


def pick(items: Column, element: int | str) -> Column:
    """An element by place, or a slice like 1:3 or ::2."""
    if isinstance(element, int) or re.fullmatch(r"-?\d+", str(element).strip()):
        n = int(element)
        return F.get(items, F.lit(n)) if n >= 0 else F.get(items, F.size(items) + n)
    first, last, step, *_ = [*(int(x) if x.strip() else None for x in str(element).strip("[] ").split(":")), None, None]
    step = step or 1
    size = F.size(items)

    def at(x: int | None, default: Column) -> Column:
        return default if x is None else F.least(F.lit(x), size) if x >= 0 else F.greatest(size + x, F.lit(0))

    if step > 0:
        begin, end = at(first, F.lit(0)), at(last, size)
        return F.filter(items, lambda x, i: (i >= begin) & (i < end) & ((i - begin) % step == 0))
    back = F.reverse(items)
    begin = F.lit(0) if first is None else size - 1 - at(first, size)
    end = size if last is None else size - 1 - at(last, size)
    return F.filter(back, lambda x, i: (i >= begin) & (i < end) & ((i - begin) % -step == 0))


def spread(df: DataFrame, items: Column, outputs: Sequence[str], pad: str | None = "") -> dict[str, Column]:
    """A list over several columns; one output with a star becomes as many columns as the longest list."""
    if len(outputs) == 1 and "*" in outputs[0]:
        width = df.select(F.max(F.size(items))).first()[0] or 0
        outputs = [outputs[0].replace("*", str(k + 1)) for k in range(width)]
    fill = F.lit(pad) if pad is not None else F.lit(None)
    return {o: F.coalesce(F.get(items, F.lit(k)), fill) for k, o in enumerate(outputs)}


@op("split.text", expands=False)
def split_text(ctx: Context, df: DataFrame, input, output=None, char: str = ",", pad: bool | None = None, element=None, inclusive: bool = False, skip_empty: bool = False):
    source = input[0] if isinstance(input, list) else input
    outputs = [source] if output is None else [output] if isinstance(output, str) else list(output)
    items = separated(name(source).cast("string"), char, inclusive)
    if skip_empty:
        items = F.filter(items, lambda x: x != "")
    if element is not None:
        return {outputs[0]: pick(items, element)}
    if len(outputs) == 1 and "*" not in outputs[0]:
        return {outputs[0]: items}
    return spread(df, items, outputs)


@op("split.tokenize")
def tokenize(ctx: Context, df: DataFrame, input, output, method: str = "space", functions=None):
    def one(x: Column) -> Column:
        if method == "space":
            return F.filter(F.split(x, r"(?U)\s+", -1), lambda t: t != "")
        if method == "boundary":
            return F.filter(F.split(x, r"(?U)(?<=\W)(?!^)|(?=\W)(?<!^)", -1), lambda t: t != "")
        if method == "boundary_ignore_space":
            return F.filter(F.split(x, r"(?U)(?<=\W)|(?=\W)", -1), lambda t: F.trim(t) != "")
        if method.startswith("regex:"):
            return F.split(x, java_pattern(method[6:].strip()), -1)
        if method.startswith("custom."):
            call = ctx.function(method)
            return F.pandas_udf(lambda s: pd.Series([list(map(str, call(t))) for t in s], dtype=object), "array<string>")(x)
        raise ValueError(f"{method} is no way to tokenize")

    return {o: one(F.array_join(name(i), " ") if is_list(df, i) else name(i).cast("string")) for i, o in zip(input, output, strict=True)}


@op("merge.concatenate")
def concatenate(ctx: Context, df: DataFrame, input, output, char: str = ",", skip_empty: bool = False):
    if len(input) == 1 and is_list(df, input[0]):
        items = name(input[0]).cast("array<string>")
    else:
        items = F.array(*[F.array_join(name(i).cast("array<string>"), char) if is_list(df, i) else name(i).cast("string") for i in input])
    items = F.filter(items, lambda x: ~_empty(x)) if skip_empty else F.transform(items, lambda x: F.coalesce(x, F.lit("")))
    return {output[0]: F.array_join(items, char)}


def shaped(df: DataFrame, items: Column, outputs: Sequence[str], output_format: str | None, char: str, first_element: bool = False) -> dict[str, Column]:
    """A list of found texts in one of the extract formats: list, dictionary, columns, concatenate."""
    if first_element:
        return {outputs[0]: F.coalesce(F.get(items, F.lit(0)), F.lit(""))}
    form = {None: "list", "array": "list", "concat": "concatenate", "string": "concatenate", "dict": "dictionary", "json": "list"}.get(output_format, output_format)
    if form == "concatenate":
        return {outputs[0]: F.array_join(items, char)}
    if form == "columns" or len(outputs) > 1:
        return spread(df, items, outputs if len(outputs) > 1 or "*" in outputs[0] else [outputs[0] + " *"])
    if form == "dictionary":
        return {outputs[0]: F.map_from_entries(F.transform(items, lambda x, i: F.struct((i + 1).cast("string"), x)))}
    return {outputs[0]: items}


@op("extract.regex")
def regex(ctx: Context, df: DataFrame, input, output, find: str, output_pattern: str | None = None, first_element: bool = False, output_format: str | None = None, char: str = ", "):
    pattern = java_pattern(find)
    text = F.concat_ws(" ", *[name(i).cast("string") for i in input])
    items = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if output_pattern is not None:
        items = F.transform(items, lambda x: F.regexp_replace(x, pattern, java_replacement(output_pattern)))
    return shaped(df, items, output, output_format, char, first_element)


# Patterns of text in brackets.
BRACKETS = {"round": r"\(.*?\)", "square": r"\[.*?\]", "curly": r"\{.*?\}", "angled": r"<.*?>"}


@op("extract.brackets")
def brackets(ctx: Context, df: DataFrame, input, output, find="all", include_brackets: bool = False, output_format: str | None = None, char: str = ", "):
    wanted = list(BRACKETS) if find == "all" or find == ["all"] else [find] if isinstance(find, str) else find
    pattern = "|".join(BRACKETS[x] for x in wanted)
    text = F.concat_ws(" ", *[name(i).cast("string") for i in input])
    items = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if not include_brackets:
        items = F.transform(items, lambda x: F.regexp_replace(x, r"[\[\]{}()<>]", ""))
    return shaped(df, items, output, output_format or "concatenate", char)


def holds(items: Column, fold):
    """Whether a list has an element, each folded by the same rule."""
    return lambda x: F.array_contains(items, fold(x))


@op("compare.text")
def compare_text(
    ctx: Context, df: DataFrame, input, output, method: str = "difference", char: str = " ", non_match_char: str = "*", include_ratio: bool = False, decimal_places: int = 3,
    exact_match=None, empty_a=None, empty_b=None, all_empty=None, case_sensitive: bool = True,
):
    if len(input) < 2:
        raise ValueError("Two columns at least are compared")
    texts = [F.coalesce(name(i).cast("string"), F.lit("")) for i in input]
    if method == "overlap":
        def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([kernels.overlap(x, y, non_match_char, decimal_places, exact_match, empty_a, empty_b, all_empty, case_sensitive) for x, y in zip(a, b, strict=True)], columns=["text", "ratio"])

        found = F.pandas_udf(run, "text string, ratio double")(*texts[:2])
        if not include_ratio:
            return {output[0]: found.getField("text")}
        return {output[0]: found.getField("text"), output[1]: found.getField("ratio")} if len(output) > 1 else {output[0]: F.array(found.getField("text"), found.getField("ratio").cast("string"))}
    words = [F.split(t, "\\Q" + char + "\\E", -1) for t in texts]
    fold = (lambda x: x) if case_sensitive else F.lower
    sets = [F.transform(w, fold) for w in words]
    if method == "difference":
        rest = [F.filter(w, lambda x: ~F.array_contains(sets[0], fold(x)) & (x != "")) for w in words[1:]]
        return {output[0]: F.array_join(F.array_distinct(F.concat(*rest)), " ")}
    if method == "intersection":
        kept = words[0]
        for other in sets[1:]:
            kept = F.filter(kept, holds(other, fold))
        return {output[0]: F.array_join(F.array_distinct(kept), " ")}
    raise ValueError("method must be difference, intersection or overlap")


@op("create.hash")
def create_hash(ctx: Context, df: DataFrame, input, output, method: str = "md5"):
    how = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256), "sha512": lambda x: F.sha2(x, 512)}
    if method not in how:
        raise ValueError(f"method must be one of {', '.join(how)}")
    return {o: how[method](F.coalesce(name(i).cast("string"), F.lit(""))) for i, o in zip(input, output, strict=True)}


@op("create.jinja")
def jinja(ctx: Context, df: DataFrame, input=None, output=None, template=None):
    """Templates become one expression: places with filters, {% if %} and {% for %}; those in a column have plain {{ name }} places."""
    template = {"string": template} if isinstance(template, str) else template
    if len(template) != 1:
        raise ValueError("template takes one of file, column and string")
    form, value = next(iter(template.items()))
    columns = {safe_name(c): c for c in (input or df.columns)}
    if form == "column":
        named = F.map_from_arrays(F.array(*[F.lit(k) for k in columns]), F.array(*[F.coalesce(name(c).cast("string"), F.lit("")) for c in columns.values()]))

        def run(templates: pd.Series, values: pd.Series) -> pd.Series:
            return pd.Series([re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m, v=dict(v): v.get(m[1], ""), t or "") for t, v in zip(templates, values, strict=True)], dtype=object)

        return {output[0]: F.pandas_udf(run, "string")(name(value), named)}
    if form == "file":
        with open(value, encoding="utf-8") as f:
            value = f.read()
    from sluice.jinja import rendered

    texts = [c for c in columns if isinstance(kind(df, columns[c]), T.StringType)]
    return {output[0]: rendered(value, list(columns.values()), texts)}
