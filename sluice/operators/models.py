"""Operators backed by models and services, behind one provider.

A provider has methods named like the operators; each takes a list of distinct inputs and returns a list
of results. LocalProvider answers from tables that the user registers and from deterministic rules, so
that recipes run without a network; a hosted service is another subclass of Provider.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.dialect import java_pattern
from sluice.functions import kernels, scoring
from sluice.operators.text import is_list, shaped
from sluice.order import name
from sluice.registry import Context, op


class Provider:
    """What a service must offer; what it lacks raises where it is asked for."""

    def content(self, model_id: str) -> dict[str, Any]:
        raise NotImplementedError("This provider has no models")

    def ask(self, operator: str, values: Sequence[Any], **settings: Any) -> list[Any]:
        raise NotImplementedError(f"This provider cannot {operator}")

    def names(self, purpose: str | None = None) -> list[str]:
        """The ids of the models there are."""
        raise NotImplementedError("This provider has no models")

    def train(self, model_id: str, purpose: str, columns: Sequence[str], data: Sequence[Sequence], **facts: Any) -> None:
        raise NotImplementedError("This provider cannot be trained")

    def delete(self, model_id: str) -> None:
        raise NotImplementedError("This provider has no models")


class LocalProvider(Provider):
    """Models given as tables: {id: {"purpose", "columns", "data"}}, and functions for the rest."""

    def __init__(self, models: dict[str, dict] | None = None, functions: dict[str, Callable] | None = None) -> None:
        self.models, self.functions = models or {}, functions or {}

    def content(self, model_id: str) -> dict[str, Any]:
        if model_id not in self.models:
            raise ValueError(f"Model {model_id} is not known")
        return self.models[model_id]

    def ask(self, operator: str, values: Sequence[Any], **settings: Any) -> list[Any]:
        if operator not in self.functions:
            raise NotImplementedError(f"No function was given for {operator}")
        return self.functions[operator](values, **settings)

    def names(self, purpose: str | None = None) -> list[str]:
        return [k for k, m in self.models.items() if purpose in (None, m.get("purpose"))]

    def train(self, model_id: str, purpose: str, columns: Sequence[str], data: Sequence[Sequence], **facts: Any) -> None:
        self.models[model_id] = {**facts, "purpose": purpose, "columns": list(columns), "data": [list(r) for r in data]}

    def delete(self, model_id: str) -> None:
        del self.models[model_id]


provider: Provider = LocalProvider()


def use(new: Provider) -> None:
    """Makes all model operators of this process ask new."""
    global provider
    provider = new


def rows_of(model_id: str) -> tuple[list[str], list[list]]:
    found = provider.content(model_id)
    return list(found["columns"]), [list(r) for r in found["data"]]


#: A model's table goes to every executor only below this many rows; a larger one is joined.
SMALL_MODEL = 100_000


def model_table(ctx: Context, model_id: str) -> DataFrame:
    names, data = rows_of(model_id)
    table = ctx.spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in data], ", ".join(f"`{n}` string" for n in names))
    return F.broadcast(table) if len(data) <= SMALL_MODEL else table


def asked(operator: str, x: Column, **settings: Any) -> Column:
    """A provider's answers, as JSON text where they are not text; once for each different value of a batch."""
    mine = provider

    def run(values: pd.Series) -> pd.Series:
        different = list(dict.fromkeys(values))
        answers = dict(zip(different, mine.ask(operator, different, **settings), strict=True))
        return pd.Series([a if isinstance(a := answers[v], str) or a is None else json.dumps(a) for v in values], dtype=object)

    return F.pandas_udf(run, "string")(x)


def _matches(ctx: Context, df: DataFrame, source: str, outputs: list, names: list[str], data: list[list], key: str, n: int) -> DataFrame:
    """The first n rows of the table for each value, as maps."""
    if len(outputs) == 1 and isinstance(outputs[0], str) and "*" in outputs[0]:
        outputs = [outputs[0].replace("*", str(k)) for k in range(1, n + 1)]
    pairs = [next(iter(o.items())) if isinstance(o, dict) else (o, o) for o in outputs]
    if len(pairs) not in (1, n):
        raise ValueError(f"When n > 1 and multiple output columns are provided, the number of output columns ({len(pairs)}) must equal n ({n}).")
    known = [ref in names for ref, _ in pairs]
    if any(known) != all(known):
        raise ValueError("Lookup may only contain all named or unnamed columns.")
    wanted = list(dict.fromkeys(ref for ref, _ in pairs)) if all(known) else [c for c in names if c != key]
    found: dict[str, list[dict]] = {}
    for r in data:
        held = found.setdefault(str(r[names.index(key)]), [])
        if len(held) < n:
            held.append({c: None if (v := r[names.index(c)]) is None else str(v) for c in wanted})
    table = ctx.spark.createDataFrame(list(found.items()), "__ref_key string, __ref_rows array<map<string,string>>")
    table = F.broadcast(table) if sum(map(len, found.values())) <= SMALL_MODEL else table
    joined = df.join(table, name(source).cast("string") == F.col("__ref_key"), "left")
    if len(pairs) == 1:
        made = {pairs[0][1]: F.coalesce("__ref_rows", F.array().cast("array<map<string,string>>"))}
    else:
        made = {target: F.get("__ref_rows", F.lit(k)) for k, (_, target) in enumerate(pairs)}
    return joined.withColumns(made).drop("__ref_key", "__ref_rows")


@op("lookup", kind="split", expands=False)
def lookup(ctx: Context, df: DataFrame, input, output=None, model_id=None, lookup_mode: str = "by_row", n=None, key: str | None = None, **kwargs):
    """Columns of a reference table by its key: the last row of each key, or with n > 1 its first n rows.

    Each of n matches is a map of columns; they are spread over n outputs, or over "Top *", else listed. All
    lookup modes give the same rows here, since the table is joined once.
    """
    if lookup_mode not in ("by_row", "by_dataframe", "by_matrix"):
        raise ValueError(f"lookup_mode {lookup_mode} is not known")
    if n is not None and (not isinstance(n, int) or isinstance(n, bool) or n < 1):
        raise ValueError("n must be a positive whole number")
    names, data = rows_of(model_id)
    key = key or ("Key" if "Key" in names else names[0])
    source = input[0] if isinstance(input, list) else input
    given = output if output is not None else source
    outputs = [given] if isinstance(given, (str, dict)) else list(given)
    if n and n > 1:
        return _matches(ctx, df, source, outputs, names, data, key, n)
    outputs = [c for o in outputs for c in ([x for x in names if x != key] if o == "*" else [o])]
    last = {str(r[names.index(key)]): r for r in data}
    small = len(last) <= SMALL_MODEL
    table = ctx.spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in last.values()] or [], ", ".join(f"`__ref_{k}` string" for k in range(len(names))))
    table = F.broadcast(table) if small else table
    joined = df.join(table, name(source).cast("string") == F.col(f"__ref_{names.index(key)}"), "left")
    made = {}
    for o in outputs:
        (ref, target), *_ = o.items() if isinstance(o, dict) else [(o, o)]
        if ref in names:
            made[target] = F.coalesce(F.col(f"__ref_{names.index(ref)}"), F.lit(""))
        else:
            made[target] = F.when(F.col(f"__ref_{names.index(key)}").isNotNull(), F.create_map(*[x for k, c in enumerate(names) if c != key for x in (F.lit(c), F.col(f"__ref_{k}"))]))
    return joined.withColumns(made).drop(*[f"__ref_{k}" for k in range(len(names))])


@op("standardize")
def standardize(ctx: Context, df: DataFrame, input, output, model_id, case_sensitive: bool = False):
    """Find and replace by one model or several in turn; words match whole. Lists: in each element."""
    pairs = []
    for m in [model_id] if isinstance(model_id, str) else model_id:
        names, data = rows_of(m)
        find, replace = names.index("Find"), names.index("Replace")
        pairs += [(str(r[find]), str(r[replace] or "")) for r in data if r[find]]

    def run(texts: pd.Series) -> pd.Series:
        import re

        flags = 0 if case_sensitive else re.I
        rules = [(re.compile(f[6:].strip() if f.startswith("regex:") else rf"(?<!\w){re.escape(f)}(?!\w)", flags), r) for f, r in pairs]

        def one(text):
            for pattern, new in rules:
                text = pattern.sub(new, text)
            return text

        def any_of(t):
            return None if t is None else one(t) if isinstance(t, str) else [None if x is None else one(x) for x in t]

        return pd.Series([any_of(t) for t in texts], dtype=object)

    call, call_list = F.pandas_udf(run, "string"), F.pandas_udf(run, "array<string>")
    return {o: call_list(name(i).cast("array<string>")) if is_list(df, i) else call(name(i).cast("string")) for i, o in zip(input, output, strict=True)}


@op("classify")
def classify(ctx: Context, df: DataFrame, input, output, model_id, include_confidence: bool = False, **kwargs):
    """The category of the example that shares most words, ties to the first; what a local model can tell."""
    names, data = rows_of(model_id)
    example, category = names.index("Example"), names.index("Category")
    known = [(frozenset(str(r[example]).lower().split()), str(r[category])) for r in data if r[example]]

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            words = frozenset((t or "").lower().split())
            score, best = max(((len(words & w) / max(1, len(words | w)), -k) for k, (w, _) in enumerate(known)), default=(0.0, 0))
            out.append((known[-best][1] if known and score else "", round(score, 3)))
        return pd.DataFrame(out, columns=["category", "confidence"])

    found = F.pandas_udf(run, "category string, confidence double")
    text = F.concat_ws(" ", *[name(i).cast("string") for i in input])
    if not include_confidence:
        return {output[0]: found(text).getField("category")}
    return dict(zip(output, [found(text).getField("category"), found(text).getField("confidence")], strict=False))


def _listing(operator: str, **fixed: Any):
    def call(ctx: Context, df: DataFrame, input, output, output_format=None, char: str = ", ", first_element: bool = False, **settings):  # noqa: A002
        text = F.concat_ws(" ", *[name(i).cast("string") for i in input])
        return shaped(df, F.from_json(asked(operator, text, **fixed, **settings), "array<string>"), output, output_format, char, first_element)

    return call


op("extract.address")(_listing("extract.address"))
op("extract.attributes")(_listing("extract.attributes"))


@op("extract.properties")
def properties(ctx: Context, df: DataFrame, input, output, property_type=None, return_data_type: str = "list", first_element: bool = False, output_format=None, char: str = ", "):
    """Colours, materials and shapes by word; standards by pattern."""
    # Common words of each property.
    words = {
        "Colours": "black white red green blue yellow orange purple pink brown grey gray silver gold beige navy teal",
        "Materials": "steel stainless aluminum aluminium brass bronze copper plastic nylon rubber wood glass iron zinc titanium leather cotton polyester ceramic",
        "Shapes": "round square rectangular oval hexagonal triangular circular cylindrical conical spherical flat",
    }
    wanted = [property_type] if isinstance(property_type, str) else property_type or [*words, "Standards"]
    text = F.concat_ws(" ", *[name(i).cast("string") for i in input])
    patterns = [r"\b(?:ISO|DIN|ANSI|ASTM|EN|IEC|UL|NEMA|ASME)[ -]?[A-Z]*\d[\w.\-]*" if w == "Standards" else r"(?i)\b(?:" + "|".join(words[w].split()) + r")\b" for w in wanted]
    items = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(java_pattern(p)), F.lit(0)) for p in patterns]))
    return shaped(df, items, output, output_format, char, first_element)


@op("extract.codes")
def extract_codes(
    ctx: Context, df: DataFrame, input, output, first_element: bool = False, output_format=None, char: str = ", ", min_length: int = 4, max_length: int = 64,
    strategy: str = "balanced", sort_order: str = "input", **kwargs,
):
    call = F.pandas_udf(lambda s: pd.Series([kernels.codes(x, min_length, max_length, strategy, sort_order) for x in s], dtype=object), "array<string>")
    return shaped(df, call(F.concat_ws(" ", *[name(i).cast("string") for i in input])), output, output_format, char, first_element)


@op("extract.custom")
def extract_custom(ctx: Context, df: DataFrame, input, output, model_id, use_labels: bool = False, first_element: bool = False, case_sensitive: bool = False, sort: str = "training_order", output_format=None, char: str = ", ", **kwargs):
    """What a model's Find patterns match, written as their Output."""
    names, data = rows_of(model_id)
    find, out = names.index("Find"), names.index("Output") if "Output" in names else None
    rules = [(str(r[find]), str(r[out]) if out is not None and r[out] else None) for r in data if r[find]]

    def run(texts: pd.Series) -> pd.Series:
        import re

        compiled = [(re.compile(f[6:].strip() if f.startswith("regex:") else rf"(?<!\w){re.escape(f)}(?!\w)", 0 if case_sensitive else re.I), o) for f, o in rules]

        def one(t):
            hits = [(k, m.start(), o or m[0]) for k, (p, o) in enumerate(compiled) for m in p.finditer(t or "")]
            order = {"training_order": lambda h: (h[0], h[1]), "input_order": lambda h: h[1], "longest": lambda h: -len(h[2]), "shortest": lambda h: len(h[2])}.get(sort, lambda h: h[2])
            found = sorted(hits, key=order, reverse=sort in ("descending", "reverse_alphabetical"))
            return list(dict.fromkeys(h[2] for h in found))

        return pd.Series([one(t) for t in texts], dtype=object)

    items = F.pandas_udf(run, "array<string>")(F.concat_ws(" ", *[name(i).cast("string") for i in input]))
    if use_labels:
        pairs = F.transform(F.filter(items, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))))
        return {output[0]: F.map_from_entries(pairs)}
    return shaped(df, items, output, output_format, char, first_element)


@op("extract.html")
def extract_html(ctx: Context, df: DataFrame, input, output, data_type: str, output_format=None, char: str = ", "):
    if data_type not in ("text", "links"):
        raise ValueError("data_type must be text or links")
    kind = "string" if data_type == "text" else "array<string>"
    call = F.pandas_udf(lambda s: pd.Series([kernels.page(x, data_type) for x in s], dtype=object), kind)
    if data_type == "text":
        return {o: call(name(i).cast("string")) for i, o in zip(input, output, strict=True)}
    return shaped(df, call(F.concat_ws(" ", *[name(i).cast("string") for i in input])), output, output_format, char)


@op("translate")
def translate(ctx: Context, df: DataFrame, input, output, target_language: str, source_language: str = "AUTO", case: str | None = None, **kwargs):
    how = {"lower": F.lower, "upper": F.upper, "title": F.initcap}.get(case, lambda x: x)
    return {o: asked("translate", how(name(i).cast("string")), target_language=target_language, source_language=source_language) for i, o in zip(input, output, strict=True)}


@op("huggingface")
def huggingface(ctx: Context, df: DataFrame, input, output, api_token: str, model: str, parameters=None):
    return {o: asked("huggingface", name(i).cast("string"), model=model, parameters=parameters) for i, o in zip(input, output, strict=True)}


@op("create.embeddings")
def embeddings(ctx: Context, df: DataFrame, input, output, api_key: str | None = None, model: str = "local", precision: str = "float32", **kwargs):
    return {o: F.from_json(asked("embeddings", name(i).cast("string"), model=model), "array<float>" if precision == "float32" else "array<double>") for i, o in zip(input, output, strict=True)}


def _structured(operator: str):
    def call(ctx: Context, df: DataFrame, output, input=None, api_key: str | None = None, **settings):  # noqa: A002
        fields = output if isinstance(output, dict) else {o: {} for o in ([output] if isinstance(output, str) else output)}
        row = F.to_json(F.struct(*[name(c) for c in ([input] if isinstance(input, str) else input or df.columns)]))
        found = asked(operator, row, output=fields, **settings)
        return {o: F.get_json_object(found, f"$['{o}']") for o in fields}

    return call


op("extract.ai", expands=False)(_structured("extract.ai"))
op("generate.ai", expands=False)(_structured("generate.ai"))


@op("search.find_links", expands=False)
def find_links(ctx: Context, df: DataFrame, queries, id=None, output=None, client: str = "local", n_results: int = 10, **kwargs):  # noqa: A002
    x = F.to_json(name(queries)) if is_list(df, queries) else name(queries).cast("string")
    return {(output or "results") if not isinstance(output, list) else output[0]: asked("search.find_links", x, n_results=n_results)}


@op("search.retrieve_link_content")
def retrieve(ctx: Context, df: DataFrame, input, output, client: str = "local", prompt: str | None = None, output_format: str = "json", **kwargs):
    return {o: asked("search.retrieve_link_content", name(i).cast("string"), prompt=prompt) for i, o in zip(input, output, strict=True)}


@op("compute.score_search_results")
def score_search_results(ctx: Context, df: DataFrame, input, output, **settings):
    """Results with scores, the best first; input: results, and the suppliers, part codes, part numbers and descriptions looked for."""
    columns = [F.to_json(F.struct(name(i).alias("v"))) for i in input]

    def run(*parts: pd.Series) -> pd.Series:
        rows = zip(*([json.loads(x or "{}").get("v") for x in p] for p in parts), strict=True)
        return pd.Series([json.dumps(scoring.ranked(*r, **settings)) for r in rows], dtype=object)

    from pyspark.sql.functions import PandasUDFType

    return {output[0]: F.pandas_udf(run, "string", PandasUDFType.SCALAR)(*columns)}
