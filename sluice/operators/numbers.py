"""Numeric, conditional, date and generated-value operators."""

from __future__ import annotations

import math as pymath
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.dialect import date_pattern, expression
from sluice.functions import kernels
from sluice.operators.text import kind
from sluice.order import ORDINAL, name, with_ordinal, with_position
from sluice.registry import Context, op


@op("math", expands=False)
def math(ctx: Context, df: DataFrame, input, output):
    return {(output if isinstance(output, str) else output[0]): expression(input if isinstance(input, str) else input[0], df.columns)}


@op("maths", expands=False)
def maths(ctx: Context, df: DataFrame, input, output):
    return math(ctx, df, input, output)


def number(df: DataFrame, column: str) -> Column:
    return name(column) if isinstance(kind(df, column), T.NumericType) else name(column).try_cast("double")


@op("round")
def round_(ctx: Context, df: DataFrame, input, output, decimals: int = 0):
    return {o: F.bround(number(df, i), decimals) for i, o in zip(input, output, strict=True)}


@op("format.significant_figures")
def significant_figures(ctx: Context, df: DataFrame, input, output, significant_figures: int = 3):
    n = significant_figures

    def rounded(x: Column) -> Column:
        # scaled by a power of ten so that n digits stand before the point
        power = F.pow(F.lit(10.0), F.lit(n - 1) - F.floor(F.log10(F.abs(x))))
        return F.when(x == 0, x).otherwise(F.bround(x * power) / power)

    out = {}
    for i, o in zip(input, output, strict=True):
        k = kind(df, i)
        if isinstance(k, T.NumericType):
            out[o] = rounded(name(i).cast("double")).cast(k)
        else:
            out[o] = F.pandas_udf(lambda s: pd.Series([kernels.significant(x, n) for x in s], dtype=object), "string")(name(i).cast("string"))
    return out


@op("convert.fraction_to_decimal")
def fraction_to_decimal(ctx: Context, df: DataFrame, input, output, decimals: int = 4):
    call = F.pandas_udf(lambda s: pd.Series([kernels.decimals(x, decimals) for x in s], dtype=object), "string")
    return {o: call(name(i).cast("string")) for i, o in zip(input, output, strict=True)}


def _label(x: float) -> str:
    """An edge as pandas writes it: three significant decimals, and a point where a number is whole."""
    if pymath.isinf(x):
        return "inf" if x > 0 else "-inf"
    return repr(float(x)) if float(x).is_integer() else repr(round(float(x), 3))


@op("create.bins")
def bins(ctx: Context, df: DataFrame, input, output, bins=None, labels=None, right: bool = True, include_lowest: bool = False):
    out = {}
    for i, o in zip(input, output, strict=True):
        x = number(df, i)
        if isinstance(bins, int):
            low, high = df.select(F.min(x), F.max(x)).first()
            low, high = float(low or 0), float(high or 0)
            if low == high:
                low, high = low - 0.001 * abs(low or 1), high + 0.001 * abs(high or 1)
                edges = [low + (high - low) * k / bins for k in range(bins + 1)]
            else:
                edges = [low + (high - low) * k / bins for k in range(bins + 1)]
                spare = (high - low) * 0.001
                edges[0 if right else -1] += -spare if right else spare
        else:
            edges = [-pymath.inf if str(e) == "-" else pymath.inf if str(e) == "+" else float(e) for e in bins]
        names = labels or [f"({_label(a)}, {_label(b)}]" if right else f"[{_label(a)}, {_label(b)})" for a, b in zip(edges, edges[1:], strict=False)]
        found = F.lit(None).cast("string")
        for k in reversed(range(len(edges) - 1)):
            a, b = F.lit(edges[k]), F.lit(edges[k + 1])
            inside = ((x > a) & (x <= b)) if right else ((x >= a) & (x < b))
            if right and include_lowest and k == 0:
                inside = (x >= a) & (x <= b)
            found = F.when(inside, F.lit(str(names[k]))).otherwise(found)
        out[o] = F.coalesce(found, F.lit("nan"))
    return out


@op("compute.case_when", expands=False)
def case_when(ctx: Context, df: DataFrame, output, cases, default=None):
    output = output if isinstance(output, str) else output[0]
    found = None
    for case in cases:
        condition = expression(case["condition"].replace("&", " & ").replace("|", " | "), df.columns)
        found = F.when(condition, F.lit(case["value"])) if found is None else found.when(condition, F.lit(case["value"]))
    return {output: found.otherwise(F.lit(default))}


@op("similarity")
def similarity(ctx: Context, df: DataFrame, input, output, method: str = "cosine"):
    if len(input) != 2:
        raise ValueError("Two columns of vectors are compared")
    a, b = (name(i).cast("array<double>") for i in input)

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    if method == "euclidean":
        return {output[0]: F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))}
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    cosine = F.try_divide(total(F.zip_with(a, b, lambda x, y: x * y)), norm)
    if method == "cosine":
        return {output[0]: cosine}
    if method == "adjusted cosine":
        bounded = F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))
        return {output[0]: F.round(F.greatest(F.lit(0.0), 1 - F.acos(bounded)), 3)}
    raise ValueError("method must be cosine, adjusted cosine or euclidean")


@op("python", expands=False)
def python(ctx: Context, df: DataFrame, command: str, output, input=None, **values):
    """A Python-like expression. except: what a row gets whose value can't be made, for a number that its text doesn't hold or a missing operand."""
    outputs = [output] if isinstance(output, str) else list(output)
    instead = values.pop("except", None)
    found = expression(command, df.columns, {**ctx.variables, **values}, [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)], instead is not None)
    made = {outputs[0]: found} if len(outputs) == 1 else {o: F.get(found, F.lit(k)) for k, o in enumerate(outputs)}
    if instead is None:
        return made
    others = [instead] if len(outputs) == 1 else list(instead)
    if len(others) != len(outputs):
        raise ValueError("except must have a value for each output")
    out = {}
    for (o, x), other in zip(made.items(), others, strict=True):
        # a value of another type than the column's makes it text
        same = type(df.select(x.alias("x")).schema["x"].dataType) is type(df.select(F.lit(other).alias("x")).schema["x"].dataType) or (isinstance(other, (int, float)) and not isinstance(df.select(x.alias("x")).schema["x"].dataType, T.StringType))
        out[o] = F.coalesce(x, F.lit(other)) if same else F.coalesce(x.cast("string"), F.lit(str(other)))
    return out


# Codes of generated columns.
_WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty knoll lagoon meadow notch oasis prairie quarry ridge shore terrace upland valley willow yonder zephyr".split()


def generated(value) -> Column:
    """A constant, or one of the codes like <int(1-9)> and <code(5)>."""
    text = str(value)
    m = re.fullmatch(r"<\s*(\w+)\s*(?:\((.*)\))?\s*>", text, re.S)
    if not m:
        return F.lit(value)
    what, given = m[1].lower(), m[2]
    words = F.array(*map(F.lit, _WORDS))
    word = F.element_at(words, (F.rand() * len(_WORDS)).cast("int") + 1)
    if what in ("int", "number"):
        low, high = (float(x) for x in re.split(r"(?<=\d)\s*-\s*", given or "1-100", maxsplit=1))
        return F.floor(F.rand() * (high - low + 1) + low).cast("long") if what == "int" else F.rand() * (high - low) + low
    if what == "char":
        return F.char((F.rand() * 26).cast("int") + 97)
    if what == "word":
        return word
    if what == "sentence":
        return F.concat(F.initcap(word), *[F.concat(F.lit(" "), F.element_at(F.shuffle(words), 1)) for _ in range(6)], F.lit("."))
    if what in ("boolean", "bool"):
        return F.rand() < 0.5
    if what == "code":
        return F.concat(*[F.substring(F.lit("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789"), (F.rand() * 34).cast("int") + 1, F.lit(1)) for _ in range(int(given or 10))])
    if what == "date":
        low, high = re.split(r"\s+to\s+", given) if given else ("1970-01-01", "2030-12-31")
        return F.date_add(F.to_date(F.lit(low.strip())), (F.rand() * (F.datediff(F.to_date(F.lit(high.strip())), F.to_date(F.lit(low.strip()))) + 1)).cast("int"))
    if what == "random":
        items = [x.strip().strip("'\"") for x in given.strip("[] ").split(",")]
        return F.element_at(F.array(*map(F.lit, items)), (F.rand() * len(items)).cast("int") + 1)
    return F.lit(value)


@op("create.column", expands=False)
def create_column(ctx: Context, df: DataFrame, output, value=None, value_if_exists: str = "existing", coalesce_value: str = "existing"):
    outputs = [output] if isinstance(output, (str, dict)) else list(output)
    pairs = [p for o in outputs for p in (o.items() if isinstance(o, dict) else [(o, value)])]
    out = {}
    for column, given in pairs:
        new = generated("" if given is None else given)
        if column not in df.columns or value_if_exists == "new":
            out[column] = new
        elif value_if_exists == "coalesce":
            old = F.when(name(column).cast("string") != "", name(column))
            out[column] = F.coalesce(old, new) if coalesce_value == "existing" else F.coalesce(new, old)
    return out


@op("create.index", kind="frame", expands=False)
def index(ctx: Context, df: DataFrame, output, start: int = 1, step: int = 1, by=None):
    outputs = [output] if isinstance(output, str) else list(output)
    if by:
        from pyspark.sql import Window

        df = with_ordinal(df)
        order = Window.partitionBy(*map(name, [by] if isinstance(by, str) else by)).orderBy(ORDINAL)
        n = F.row_number().over(order) - 1
    else:
        df = with_position(df)
        n = F.col(ORDINAL)
    return df.withColumns({o: (F.lit(start) + F.lit(step) * n).cast("long") for o in outputs}).drop(ORDINAL)


@op("create.uuid", expands=False)
def uuid(ctx: Context, df: DataFrame, output):
    return {o: F.uuid() for o in ([output] if isinstance(output, str) else output)}


@op("create.guid", expands=False)
def guid(ctx: Context, df: DataFrame, output):
    return uuid(ctx, df, output)


@op("convert.data_type")
def data_type(ctx: Context, df: DataFrame, input, output, data_type: str = "str", default=None):
    kinds = {"str": "string", "int": "long", "float": "double", "bool": "boolean", "datetime": "timestamp"}
    if data_type not in kinds:
        raise ValueError(f"data_type must be one of {', '.join(kinds)}")

    def converted(c: str) -> Column:
        x, k = name(c), kind(df, c)
        if data_type == "datetime" and isinstance(k, T.StringType):
            out = F.coalesce(F.try_to_timestamp(x), *[F.try_to_timestamp(x, F.lit(f)) for f in ("M/d/yyyy", "d-MMM-yyyy", "MMM d, yyyy")])
        elif data_type == "int" and isinstance(k, T.StringType):
            out = F.when(x.rlike(r"^\s*[-+]?\d+\s*$"), F.trim(x).try_cast("long"))
        elif data_type == "bool":
            out = (x.isNotNull() & (x != "")) if isinstance(k, T.StringType) else x.try_cast("boolean")
        else:
            out = x.cast("string") if data_type == "str" else x.try_cast(kinds[data_type])
        return out if default is None else F.coalesce(out, F.lit(default).cast(kinds[data_type]))

    return {o: converted(i) for i, o in zip(input, output, strict=True)}


def _when(df: DataFrame, column: str) -> Column:
    k = kind(df, column)
    return F.try_to_timestamp(name(column)) if isinstance(k, T.StringType) else name(column).cast("timestamp_ntz")


@op("date_calculator")
def date_calculator(ctx: Context, df: DataFrame, input, output, operation: str = "add", time_unit: str | None = None, time_value=None):
    if operation not in ("add", "subtract"):
        raise ValueError("operation must be add or subtract")
    n = F.lit(time_value) * (1 if operation == "add" else -1)
    spans = {
        "years": lambda: F.make_ym_interval(n.cast("int"), F.lit(0)), "months": lambda: F.make_ym_interval(F.lit(0), n.cast("int")),
        "weeks": lambda: F.make_dt_interval((n * 7).cast("int")), "days": lambda: F.make_dt_interval(n.cast("int")),
        "hours": lambda: F.make_dt_interval(F.lit(0), n.cast("int")), "minutes": lambda: F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int")),
        "seconds": lambda: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)")), "milliseconds": lambda: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n / 1000).cast("decimal(18,6)")),
    }
    if time_unit not in spans:
        raise ValueError(f"time_unit must be one of {', '.join(spans)}")
    return {o: _when(df, i) + spans[time_unit]() for i, o in zip(input, output, strict=True)}


@op("format.dates")
def dates(ctx: Context, df: DataFrame, input, output, format: str):
    return {o: F.date_format(_when(df, i), date_pattern(format)) for i, o in zip(input, output, strict=True)}


DATE_PROPERTIES = {
    "day": F.dayofmonth, "day_of_year": F.dayofyear, "month": F.month, "month_name": lambda x: F.date_format(x, "MMMM"), "weekday": F.weekday,
    "week_day_name": lambda x: F.date_format(x, "EEEE"), "week_year": F.weekofyear, "quarter": F.quarter,
}


@op("extract.date_properties")
def date_properties(ctx: Context, df: DataFrame, input, output, property: str):
    if property not in DATE_PROPERTIES:
        raise ValueError(f"property must be one of {', '.join(DATE_PROPERTIES)}")
    found = [DATE_PROPERTIES[property](_when(df, i)) for i in input]
    return {output[0]: F.array(*found)} if len(input) > 1 and len(output) == 1 else dict(zip(output, found, strict=True))


def _inside_months(a: Column, b: Column, days: list[int]) -> Column:
    """How many of the given days of months lie from a to b, both included; 0 stands for a month's last."""
    months = F.sequence(F.trunc(a, "month"), F.greatest(F.trunc(a, "month"), F.trunc(b, "month")), F.expr("interval 1 month"))
    count = F.lit(0)

    def inside(d: int):
        return lambda m: (F.last_day(m) if d == 0 else F.date_add(m, d - 1)).between(a, b)

    for d in days:
        count = count + F.size(F.filter(months, inside(d)))
    return count


@op("extract.date_range", expands=False)
def date_range(ctx: Context, df: DataFrame, start_time: str, end_time: str, output, range: str = "days"):
    a, b = _when(df, start_time), _when(df, end_time)
    day_a, day_b = a.cast("date"), b.cast("date")
    output = output if isinstance(output, str) else output[0]
    seconds = {"weeks": 604800, "days": 86400, "day": 86400, "hours": 3600, "minutes": 60, "seconds": 1, "milliseconds": 0.001}
    if range in seconds:
        micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
        return {output: F.greatest(F.floor(micros / (seconds[range] * 1e6)), F.lit(0)).cast("long")}
    days = F.sequence(day_a, F.greatest(day_a, day_b))
    weekdays = _weekdays_before(F.date_add(F.greatest(day_a, day_b), 1)) - _weekdays_before(day_a)
    counts = {
        "business days": lambda: weekdays, "months": lambda: _inside_months(day_a, day_b, [0]), "month starts": lambda: _inside_months(day_a, day_b, [1]),
        "semi months": lambda: _inside_months(day_a, day_b, [15, 0]), "semi month starts": lambda: _inside_months(day_a, day_b, [1, 15]),
        "business month ends": lambda: F.size(F.filter(days, lambda d: d == _last_business(d))), "business month starts": lambda: F.size(F.filter(days, lambda d: d == _first_business(d))),
        "quarters": lambda: F.size(F.filter(days, lambda d: (d == F.last_day(d)) & (F.month(d) % 3 == 0))), "quarter starts": lambda: F.size(F.filter(days, lambda d: d == F.trunc(d, "quarter"))),
        "years": lambda: F.size(F.filter(days, lambda d: (F.month(d) == 12) & (F.dayofmonth(d) == 31))),
        "business hours": lambda: weekdays * 8,
    }
    if range not in counts:
        raise ValueError(f"range must be one of {', '.join([*seconds, *counts])}")
    return {output: F.greatest(counts[range]() - 1, F.lit(0)).cast("long")}


def _weekdays_before(d: Column) -> Column:
    """Mondays to Fridays from a fixed Monday up to a date, without it."""
    n = F.datediff(d, F.lit("1970-01-05").cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def _last_business(d: Column) -> Column:
    last = F.last_day(d)
    return F.date_sub(last, F.greatest(F.weekday(last) - 4, F.lit(0)))


def _first_business(d: Column) -> Column:
    first = F.trunc(d, "month")
    return F.date_add(first, F.when(F.weekday(first) > 4, 7 - F.weekday(first)).otherwise(0))
