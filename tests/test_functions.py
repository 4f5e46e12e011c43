"""Functions on plain values."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from sluice.functions import api, cache, definitions
from sluice.operators import models
from sluice.plans import recipe


def test_call_keeps_the_shape(spark):
    assert api.call("convert.case", "aB", spark=spark, case="upper") == "AB"
    assert api.call("convert.case", ["aB", "c"], spark=spark, case="upper") == ["AB", "C"]
    assert api.call("merge.concatenate", ["a"], ["b"], spark=spark, char="-") == ["a-b"]
    assert api.call("convert.case", [], spark=spark) == []


def test_answers_are_computed_once():
    asked = []
    kept = cache.Answers(entries=2)
    assert kept.batch([1, 2, 1], lambda x: x, lambda x: asked.append(x) or x * 10) == [10, 20, 10]
    assert sorted(asked) == [1, 2]
    kept.get(3, lambda: 30)
    assert list(kept.kept) and len(kept.kept) == 2
    with pytest.raises(ZeroDivisionError):
        kept.get(9, lambda: 1 / 0)
    assert kept.get(9, lambda: 5) == 5


def test_definitions():
    schema, kind = definitions.compiled({"a": "integer", "b": {"type": ["array", "null"], "items": "number"}, "c": "What it is"})
    assert schema["properties"]["b"]["type"] == ["array", "null"] and schema["required"] == ["a", "b", "c"]
    assert kind["a"].dataType == T.LongType() and kind["b"].dataType == T.ArrayType(T.DoubleType()) and kind["c"].dataType == T.StringType()
    with pytest.raises(ValueError, match="no kind"):
        definitions.compiled({"a": {"type": "odd"}})


def test_training_writes_models(spark):
    models.use(models.LocalProvider())
    rows = spark.createDataFrame([("k", "v")], "Key string, V string")
    recipe.run({"write": [{"train.lookup": {"model_id": "m"}}]}, spark, dataframe=rows)
    recipe.run({"write": [{"train.lookup": {"model_id": "m", "action": "upsert"}}]}, spark, dataframe=spark.createDataFrame([("k2", "w")], "Key string, V string"))
    assert models.provider.names("lookup") == ["m"]
    assert recipe.run({"read": [{"train.lookup": {"model_id": "m"}}]}, spark).count() == 2
