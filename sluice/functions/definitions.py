"""What a user says of a structured answer's fields, as a JSON schema and as a Spark type."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import types as T

_KINDS = {"string": T.StringType, "str": T.StringType, "text": T.StringType, "integer": T.LongType, "int": T.LongType, "number": T.DoubleType, "float": T.DoubleType, "boolean": T.BooleanType, "bool": T.BooleanType}
_NAMES = {T.StringType: "string", T.LongType: "integer", T.DoubleType: "number", T.BooleanType: "boolean"}


def _one(given: Any) -> tuple[dict[str, Any], T.DataType]:
    if isinstance(given, str):
        given = {"type": given} if given.lower() in _KINDS else {"description": given}
    given = dict(given or {})
    kind = given.get("type", "string")
    nullable = isinstance(kind, list) and "null" in kind
    if isinstance(kind, list):
        kind = next(k for k in kind if k != "null")
    extra = {k: given[k] for k in ("description", "enum", "examples", "default") if k in given}
    if kind in ("array", "list"):
        items, inner = _one(given.get("items"))
        schema, spark = {"type": "array", "items": items}, T.ArrayType(inner)
    elif kind in ("object", "dict"):
        schema, spark = compiled(given.get("properties") or {})
    elif str(kind).lower() in _KINDS:
        spark = _KINDS[str(kind).lower()]()
        schema = {"type": _NAMES[type(spark)]}
    else:
        raise ValueError(f"{kind} is no kind of field")
    if nullable:
        schema["type"] = [schema["type"], "null"]
    return {**schema, **extra}, spark


def compiled(fields: Mapping[str, Any] | list[str] | str) -> tuple[dict[str, Any], T.StructType]:
    """(strict JSON schema of an object, Spark type) of fields by name."""
    if isinstance(fields, str):
        fields = [fields]
    if isinstance(fields, list):
        fields = dict.fromkeys(fields, "string")
    made = {name: _one(given) for name, given in fields.items()}
    schema = {"type": "object", "properties": {k: s for k, (s, _) in made.items()}, "required": list(made), "additionalProperties": False}
    return schema, T.StructType([T.StructField(k, t) for k, (_, t) in made.items()])
