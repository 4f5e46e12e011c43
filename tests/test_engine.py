"""The recipe engine: addressing, templates, operators, sources and sinks."""

from __future__ import annotations

import datetime

import pytest

from sluice import columns, dialect, template
from sluice.functions import kernels, scoring
from sluice.operators import models
from sluice.plans import recipe
from sluice.registry import OPERATORS, schema
from sluice.streaming import runner

NAMES = ["a", "ab", "b c", "col1", "col2", "x*"]


@pytest.mark.parametrize(
    ("wanted", "found"),
    [
        ("a", ["a"]), ("a*", ["a", "ab"]), ("*", NAMES), (0, ["a"]), ("1:3", ["ab", "b c"]), ("-2:", ["col2", "x*"]), ("regex: col\\d", ["col1", "col2"]), ("-a", NAMES[1:]),
        ("regex: -col.", ["a", "ab", "b c", "x*"]), (["col*", "-col1"], ["col2"]), ("none?", []), (["b c", "a?"], ["b c", "a"]), ("x\\*", ["x*"]), ("x*", ["x*"]),
    ],
)
def test_addressing(wanted, found):
    assert columns.expand(NAMES, wanted) == found


def test_addressing_errors():
    for bad, error in (("none", KeyError), (9, ValueError), ("z*", KeyError)):
        with pytest.raises(error):
            columns.expand(NAMES, bad)


def test_renames():
    assert columns.renames(["in a", "in b", "c"], {"in *": "out *", "c": "d"}) == {"in a": "out a", "in b": "out b", "c": "d"}
    assert columns.renames(["a1"], {"regex: a(.)": "b\\1"}) == {"a1": "b1"}


def test_templates():
    assert template.bind({"x": "${n}", "y": ["a ${s} b"], "if": "${n} > 1"}, {"n": 3, "s": "t"}) == {"x": 3, "y": ["a t b"], "if": "${n} > 1"}
    assert template.bind("${l}", {"l": "[1, 2]"}) == [1, 2]
    with pytest.raises(ValueError, match="was not found"):
        template.bind("${absent_variable}", {})


@pytest.mark.parametrize(("text", "holds"), [("${n} > 2 and 'a' in ${s}", True), ("len(${s}) == 2", False), ("not ${n}", False), ("columns[0].upper() == 'C'", True), ("row_count == 5", True)])
def test_conditions(text, holds):
    assert template.condition(text, {"n": 3, "s": "abc", "columns": ["c"], "row_count": lambda: 5}) is holds


def test_conditions_run_no_code():
    for bad in ("__import__('os')", "().__class__", "open('x')", "[x for x in (1,)]"):
        with pytest.raises(ValueError, match="Not allowed"):
            template.condition(bad, {})


def test_dialect():
    assert dialect.sql("\"a b\" LIKE 'it''s' AND [c d] = ? AND e == :f", ["x"]).startswith("`a b` ILIKE 'it\\'s' AND `c d` = 'x' AND e = :f")
    assert dialect.sql("a = :n", {"n": "o'k"}) == "a = 'o\\'k'"
    assert dialect.date_pattern("%Y-%m-%dT%H at %B") == "yyyy-MM-dd'T'HH' at 'MMMM"
    assert dialect.java_replacement("\\1$") == "$1\\$"


def test_kernels():
    assert kernels.without_words("a big, red Box", ["BIG", "box"]) == "a , red" or kernels.without_words("a big red Box", ["BIG", "box"]) == "a red"
    assert kernels.decimals("1 1/2 x 3/4 in") == "1.5 x 0.75 in" and kernels.decimals(None) is None
    assert kernels.significant("1.23456 and 1e5", 3) == "1.23 and 1e+05" and kernels.significant(12345, 2) == 12000
    assert kernels.overlap("abc", "abd") == ("ab*", 0.667) and kernels.overlap("", "", all_empty="e")[0] == "e"
    assert kernels.codes("see ABC-123 and 42") == ["ABC-123"]
    assert kernels.page("<p>a <b>b</b></p><a href='l'>x</a><script>no</script>", "links") == ["l"]
    assert kernels.plain("Straße É-1") == "strassee1" and kernels.masked("abcdef", 1, 2) == "*bcd**"
    assert scoring.clean_link("https://x.com/a/?utm_source=1&k=2") == "x.com/a?k=2" and scoring.is_product_url("https://x.com/product/ab-1")[0] == 2
    assert [r["title"] for r in scoring.ranked([{"title": "b"}, {"title": "AB-12 bearing"}], mpns=["AB12"])] == ["AB-12 bearing"]


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, "Hello World-foo", "a,b,,c", 2.5, [1, 2], datetime.datetime(2024, 1, 31), None), (2, None, "q", 3.5, [], datetime.datetime(2023, 6, 1), "z"), (3, "x (y) [z]", "", None, None, None, "")]
    return spark.createDataFrame(rows, "n long, t string, l string, d double, a array<int>, w timestamp_ntz, e string")


def rows(df, *steps, **more):
    return recipe.run({"wrangles": list(steps)}, df.sparkSession, dataframe=df, **more).collect()


def test_text_steps(df):
    found = rows(df, {"convert.case": {"input": "t", "output": "c", "case": "title"}}, {"format.pad": {"input": "l", "output": "p", "pad_length": 5, "side": "both", "char": "-"}}, {"split.text": {"input": "l", "output": "s*"}}, {"extract.brackets": {"input": "t", "output": "b"}}, {"merge.coalesce": {"input": ["e", "t"], "output": "co"}})
    assert found[0].c == "Hello World-Foo" and found[1].c is None
    assert [found[0].s1, found[0].s3, found[0].s4, found[1].s2] == ["a", "", "c", ""]
    assert found[2].b == "y, z" and found[2].co == "x (y) [z]" and found[1].co == "z"
    assert found[1].p == "--q--"


def test_where_keeps_other_rows(df):
    found = rows(df, {"convert.case": {"input": "l", "case": "upper", "where": "n = ?", "where_params": [2]}}, {"math": {"input": "n * 2", "output": "m", "where": "n > 1"}})
    assert [r.l for r in found] == ["a,b,,c", "Q", ""] and [r.m for r in found] == [None, 4, 6]


def test_where_on_other_kinds(df):
    assert [r.n for r in rows(df, {"sort": {"by": "n", "ascending": False, "where": "n < 3"}})] == [2, 1]
    with pytest.raises(NotImplementedError):
        rows(df, {"drop": {"columns": "n", "where": "n = 1"}})


def test_lists(df):
    found = rows(df, {"explode": {"input": "a", "drop_empty": True}})
    assert [r.a for r in found] == [1, 2]
    assert len(rows(df, {"explode": {"input": "a"}})) == 4
    found = rows(df, {"split.text": {"input": "l", "output": "x"}}, {"select.list_element": {"input": "x", "output": "y", "element": "::-1"}}, {"select.list_element": {"input": "x", "output": "z", "element": -1}})
    assert found[0].y == ["c", "", "b", "a"] and found[0].z == "c"


def test_numbers_and_dates(df):
    found = rows(df, {"round": {"input": "d", "output": "r"}}, {"date_calculator": {"input": "w", "output": "m", "time_unit": "months", "time_value": 1}}, {"format.dates": {"input": "m", "output": "f", "format": "%d.%m.%Y"}}, {"create.bins": {"input": "d", "output": "b", "bins": ["-", 3, "+"]}})
    assert [r.r for r in found] == [2.0, 4.0, None] and found[0].f == "29.02.2024" and found[0].b == "(-inf, 3.0]" and found[2].b == "nan"


def test_group_by(df):
    found = rows(df, {"select.group_by": {"by": "e", "list": "n", "first": [{"t": "f"}], "counts": "l", "nunique": "n"}})
    by = {r.e: r for r in found}
    assert by["z"]["n.list"] == [2] and by["z"]["f"] is None and by[""]["f"] == "x (y) [z]" and by["z"]["l.counts"] == {"q": 1}
    with pytest.raises(ValueError, match="one name"):
        rows(df, {"select.group_by": {"by": "n", "auto_rename_columns": False, "sum": "d", "mean": "d"}})


def test_control(df):
    found = rows(df, {"matrix": {"variables": {"k": [1, 2]}, "wrangles": [{"math": {"input": "n + ${k}", "output": "m${k}"}}]}}, {"try": {"wrangles": [{"convert.case": {"input": "none"}}], "except": {"s": "x"}}}, {"accordion": {"input": "a", "output": "aa", "wrangles": [{"math": {"input": "a * 10", "output": "aa"}}]}})
    assert (found[0].m1, found[0].m2, found[0].s, found[0].aa, found[1].aa) == (2, 3, "x", [10, 20], [])


def test_user_functions(df):
    def double(n: int) -> int:
        return n * 2

    def frame(df):
        return df.where("n > 1")

    found = rows(df, {"custom.double": {"output": "x"}}, {"custom.frame": {}}, functions=[double, frame])
    assert [r.x for r in found] == [4, 6]


def test_models(df):
    models.use(models.LocalProvider({"m": {"columns": ["Key", "V"], "data": [["q", "found"]]}, "s": {"columns": ["Find", "Replace"], "data": [["world", "Mars"]]}, "c": {"columns": ["Example", "Category"], "data": [["hello there", "greeting"]]}}))
    found = rows(df, {"lookup": {"input": "l", "output": {"V": "v"}, "model_id": "m"}}, {"standardize": {"input": "t", "output": "st", "model_id": "s"}}, {"classify": {"input": "t", "output": "cl", "model_id": "c"}})
    by = {r.n: r for r in found}
    assert by[2].v == "found" and by[1].v == "" and by[1].st == "Hello Mars-foo" and by[1].cl == "greeting"


def test_files_and_databases(spark, df, tmp_path):
    small = df.select("n", "t")
    for form in ("csv", "json", "jsonl", "parquet"):
        path = str(tmp_path / f"f.{form}")
        recipe.run({"write": [{"file": {"name": path, "where": "n < 3"}}]}, spark, dataframe=small)
        assert recipe.run({"read": [{"file": {"name": path}}]}, spark).count() == 2
    base = str(tmp_path / "x.db")
    recipe.run({"write": [{"sqlite": {"database": base, "table": "t"}}]}, spark, dataframe=small)
    assert recipe.run({"read": [{"sqlite": {"database": base, "command": "select * from t where n > 1"}}]}, spark).count() == 2
    recipe.run({"write": [{"memory": {"id": "kept"}}]}, spark, dataframe=small)
    assert recipe.run({"read": [{"memory": {"id": "kept"}}]}, spark).count() == 3
    assert recipe.run({"read": [{"test": {"rows": 7, "values": {"a": "<int(1-3)>", "b": "<code(4)>", "c": "fixed"}}}]}, spark).where("a between 1 and 3 and length(b) = 4 and c = 'fixed'").count() == 7


def test_hooks(spark, df):
    seen = []

    def mark(what: str) -> None:
        seen.append(what)

    given = {"run": {"on_start": [{"custom.mark": {"what": "start"}}], "on_success": [{"custom.mark": {"what": "done"}}], "on_failure": [{"custom.mark": {"what": "${error}"}}]}}
    recipe.run({**given, "wrangles": []}, spark, dataframe=df, functions=mark)
    with pytest.raises(ValueError, match="no step"):
        recipe.run({**given, "wrangles": [{"unknown": {}}]}, spark, dataframe=df, functions=mark)
    assert seen == ["start", "done", "start", "unknown is no step"]


def test_accessor_and_schema(df):
    found = recipe.Frame(df).convert.case(input="l", output="u", case="upper").select.head(n=1).df.collect()
    assert found[0].u == "A,B,,C"
    assert len(OPERATORS) > 90 and "convert.case" in schema()["properties"]["wrangles"]["items"]["properties"]


def test_empty_frame(df):
    none = df.where("n > 9")
    assert rows(none, {"convert.case": {"input": "t", "case": "upper"}}, {"split.text": {"input": "l", "output": ["x", "y"]}}, {"select.group_by": {"by": "e", "sum": "n"}}) == []


def test_errors(df):
    for step in ({"convert.case": {"input": ["t", "l"], "output": ["x"]}}, {"select.head": {"n": 0}}, {"convert.case": {"input": "t", "case": "odd"}}, {"select.left": {"input": "t", "length": 0}}, {"sql": {"command": "DELETE FROM df"}}):
        with pytest.raises(ValueError):
            rows(df, step)


def test_stream_refuses_whole_frame_steps(spark, tmp_path, df):
    df.select("n", "t").write.parquet(str(tmp_path / "in"))
    stream = runner.source(spark, str(tmp_path / "in"), "n long, t string")
    with pytest.raises(ValueError, match="whole frame"):
        runner.apply(stream, [{"sort": {"by": "n"}}])
    found = runner.drain(runner.apply(stream, [{"convert.case": {"input": "t", "case": "upper"}}]), "upper_stream")
    assert {r.t for r in found.collect()} == {"HELLO WORLD-FOO", None, "X (Y) [Z]"}


def test_drained_streams_are_files_and_not_rows_of_the_driver(spark, tmp_path):
    schema = "k long, t string"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10, numPartitions=1).selectExpr("id % 4 as k", "cast(id as string) as t").write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: runner.source(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    found = runner.drain(source(), "drained_rows")
    assert len(found.inputFiles()) >= 3 and sorted(int(r.t) for r in found.collect()) == list(range(30))
    assert spark.table("drained_rows").count() == 30 and found.columns == ["k", "t"]
    # of three batches in complete mode the last one's rows stay
    found = runner.drain(source().groupBy("k").count(), "drained_counts", "complete")
    assert found.inputFiles() and {r["k"]: r["count"] for r in found.collect()} == {0: 8, 1: 8, 2: 7, 3: 7}
    # going on from a checkpoint adds what is new
    at = str(tmp_path / "checkpoint")
    assert runner.drain(source(), "drained_first", checkpoint=at).count() == 30
    spark.createDataFrame([(9, "30")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(int(r.t) for r in runner.drain(source(), "drained_second", checkpoint=at).collect()) == list(range(31))
    (tmp_path / "none").mkdir()
    assert runner.drain(runner.source(spark, str(tmp_path / "none"), schema), "drained_none").collect() == []


def test_scan_is_pruned_and_filters_are_pushed(spark):
    made = recipe.run({"read": [{"file": {"name": "/root/testdata/sf0.001/lineitem.parquet"}}], "wrangles": [{"filter": {"where": "l_quantity > 10"}}, {"select.group_by": {"by": "l_returnflag", "sum": "l_tax"}}]}, spark)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "l_comment" not in plan and "l_partkey" not in plan


def test_sample_with_replacement_draws_from_the_whole_frame(spark):
    df = spark.range(0, 20_000, numPartitions=7).selectExpr("id", "if(id >= 19000 and id % 2 = 0, 3.0, if(id < 1000, 1.0, 0.0)) as w")
    found = [r["id"] for r in recipe.Frame(df).select.sample(rows=300, replace=True, random_state=1).df.collect()]
    assert len(found) == 300 and min(found) < 2000 and max(found) > 18_000
    small = [r["id"] for r in recipe.Frame(df.limit(9)).select.sample(rows=9, replace=True, random_state=2).df.collect()]
    assert len(small) == 9 and len(set(small)) < 9
    found = [r["id"] for r in recipe.Frame(df).select.sample(rows=1000, replace=True, random_state=3, weights="w").df.collect()]
    late = [x for x in found if x >= 19_000]
    assert len(found) == 1000 and all(x < 1000 or x >= 19_000 and x % 2 == 0 for x in found) and 520 < len(late) < 680


def test_lookup_of_several_matches(df):
    models.use(models.LocalProvider({"m": {"columns": ["Key", "V", "W"], "data": [["q", "a", 1], ["other", "x", 2], ["q", "b", None], ["q", "c", 4]]}}))
    by = lambda **more: {r.n: r for r in rows(df, {"lookup": {"input": "l", "model_id": "m", **more}})}
    found = by(output="hits", n=3)
    assert [h["V"] for h in found[2].hits] == ["a", "b", "c"] and found[2].hits[1]["W"] is None and found[1].hits == []
    assert [h for h in by(output="V", n=2, lookup_mode="by_dataframe")[2].V] == [{"V": "a"}, {"V": "b"}]
    found = by(output="Top *", n=4)
    assert found[2]["Top 1"]["V"] == "a" and found[2]["Top 3"]["V"] == "c" and found[2]["Top 4"] is None and found[1]["Top 1"] is None
    assert by(output={"V": "v"}, n=1)[2].v == by(output={"V": "v"})[2].v == "c"
    for bad in ({"output": ["x", "y"], "n": 3}, {"output": ["V", "y"], "n": 2}, {"output": "x", "n": 0}, {"output": "x", "lookup_mode": "none"}):
        with pytest.raises(ValueError):
            by(**bad)


def test_standardize_lists(spark):
    models.use(models.LocalProvider({"s": {"columns": ["Find", "Replace"], "data": [["world", "Mars"]]}}))
    df = spark.createDataFrame([(1, ["Hello World", None, "worlds"]), (2, []), (3, None)], "n long, x array<string>")
    found = {r.n: r.y for r in rows(df, {"standardize": {"input": "x", "output": "y", "model_id": "s"}})}
    assert found == {1: ["Hello Mars", None, "worlds"], 2: [], 3: None}
