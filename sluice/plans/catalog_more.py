"""More registered queries: sources, sinks, actions, user functions, models, streams, and operators' other settings.

What a query writes goes below the session's checkpoint folder, or, for databases of one machine, into a
temporary file of the driver.
"""

from __future__ import annotations

import contextlib
import http.server
import json
import sqlite3
import tempfile
import threading
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.order import checkpoint_dir
from sluice.plans.catalog import frame, query, step

NATION = "select n_nationkey, n_name, n_regionkey from nation"
NATION_SCHEMA = "n_nationkey int, n_name string, n_regionkey int"


def _run(spark: SparkSession, functions: Any = None, dataframe: DataFrame | None = None, **given: Any) -> DataFrame:
    from sluice.plans import recipe

    return recipe.run(given, spark, functions=functions, dataframe=dataframe)


def _at(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/queries/{uuid.uuid4().hex}-{name}"


def _table(sf_dir: str, name: str, **more: Any) -> dict:
    return {"file": {"name": f"{sf_dir}/{name}.parquet", **more}}


@contextlib.contextmanager
def _models(**models: dict) -> Iterator[None]:
    """Models that steps planned inside find; the provider before comes back."""
    from sluice.operators import models as module

    before = module.provider
    module.use(module.LocalProvider(models))
    try:
        yield
    finally:
        module.use(before)


# files: written by all tasks, read again
for _form, _name, _read in (
    ("csv", "t.csv", {"schema": NATION_SCHEMA}), ("csv_semicolon", "t.csv", {"schema": NATION_SCHEMA, "sep": ";"}), ("jsonl", "t.jsonl", {"schema": NATION_SCHEMA}),
    ("orc", "t.orc", {}), ("parquet", "t.parquet", {}),
):
    def _file(spark: SparkSession, sf_dir: str, name=_name, read=_read) -> DataFrame:
        at = _at(spark, name)
        _run(spark, read=[_table(sf_dir, "nation")], write=[{"file": {"name": at, "single": False, **({"sep": read["sep"]} if "sep" in read else {})}}])
        return _run(spark, read=[{"file": {"name": at, **read}}])

    frame(f"file_{_form}", NATION)(_file)


@frame("file_json_single", NATION + " where n_regionkey = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{tempfile.mkdtemp()}/t.json"  # one named file is for one machine
    _run(spark, read=[_table(sf_dir, "nation")], write=[{"file": {"name": at, "where": "n_regionkey = 1"}}])
    with open(at, encoding="utf-8") as f:
        return spark.createDataFrame(json.load(f), NATION_SCHEMA)


@frame("memory_roundtrip", "select n_name from nation order by n_name desc limit 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _run(spark, read=[_table(sf_dir, "nation")], write=[{"memory": {"id": "query", "columns": ["n_name"], "order_by": "n_name desc"}}])
    return _run(spark, read=[{"memory": {"id": "query"}}], wrangles=[step("select.head", n=3)], run={"on_success": [{"memory.clear": {"id": "query"}}]})


query("read_test", [{"test": {"rows": 7, "values": {"a": "x", "b": 5}}}], None, "select 'x' a, 5 b from range(7)")
query("read_concurrent", [{"concurrent": {"read": [{"file": "nation"}, {"file": {"name": "nation", "where": "n_regionkey = 1"}}]}}], None, NATION + " union all " + NATION + " where n_regionkey = 1")
query("read_order_by", [{"file": {"name": "nation", "order_by": "n_regionkey desc, n_name"}}], [step("create.index", output="i")], "select *, row_number() over (order by n_regionkey desc, n_name) i from nation")
query("read_recipe", [{"recipe": {"read": [{"file": "nation"}], "wrangles": [step("convert.case", input="n_name", case="lower")]}}], None, "select n_nationkey, lower(n_name) n_name, n_regionkey from nation")


@frame("sqlite_roundtrip", "select n_nationkey, n_name from nation where n_regionkey = 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{tempfile.mkdtemp()}/t.db"
    _run(spark, read=[_table(sf_dir, "nation")], write=[{"sqlite": {"database": at, "table": "t"}}])
    return _run(spark, read=[{"sqlite": {"database": at, "command": "select n_nationkey, n_name from t where n_regionkey = ?", "params": [2]}}])


@frame("sqlite_action", NATION + " where n_regionkey <> 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{tempfile.mkdtemp()}/t.db"
    _run(spark, read=[_table(sf_dir, "nation")], write=[{"sqlite": {"database": at, "table": "t"}}], run={"on_success": [{"sqlite": {"database": at, "command": "delete from t where n_regionkey = ?", "params": [3]}}]})
    with sqlite3.connect(at) as connection:
        return spark.createDataFrame(pd.read_sql("select * from t", connection))


@frame("duckdb_roundtrip", "select n_nationkey, n_name, n_regionkey from nation where n_nationkey > 10")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{tempfile.mkdtemp()}/t.duckdb"
    write = [{"duckdb": {"database": at, "table": "t", "action": a}} for a in ("INSERT", "REPLACE")]
    _run(spark, read=[_table(sf_dir, "nation")], write=write, run={"on_success": [{"duckdb": {"database": at, "command": "delete from t where n_nationkey <= 10"}}]})
    return _run(spark, read=[{"duckdb": {"database": at, "command": "select * from t"}}])


@contextlib.contextmanager
def _served(answers: list, received: list | None = None) -> Iterator[str]:
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            self.reply(answers)

        def do_POST(self) -> None:  # noqa: N802
            received.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.reply({"ok": True})

        def reply(self, what: Any) -> None:
            body = json.dumps(what).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: Any) -> None:
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_address[1]}/"
    finally:
        server.shutdown()


@frame("http_read", "select r_regionkey, r_name from region")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect()]
    with _served(rows) as url:
        return spark.createDataFrame(_run(spark, read=[{"http": {"url": url}}]).select(F.col("r_regionkey").cast("int"), F.col("r_name").cast("string")).collect(), "r_regionkey int, r_name string")


@frame("http_write", "select r_regionkey, r_name from region")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    received: list = []
    with _served([], received) as url:
        _run(spark, read=[_table(sf_dir, "region")], write=[{"http": {"url": url, "batch": 2, "columns": ["r_regionkey", "r_name"]}}], run={"on_success": [{"http": {"url": url}}]})
    return spark.createDataFrame([(r["r_regionkey"], r["r_name"]) for part in received for r in part], "r_regionkey int, r_name string")


for _kind, _write in (
    ("recipe", [{"recipe": {"wrangles": [step("filter", input="n_regionkey", equal=1)], "write": [{"memory": {"id": "w1"}}]}}, {"memory": {"id": "w2", "where": "n_regionkey = 2"}}]),
    ("concurrent", [{"concurrent": {"write": [{"memory": {"id": "w1", "where": "n_regionkey = 1"}}, {"memory": {"id": "w2", "where": "n_regionkey = 2"}}]}}]),
    ("matrix", [{"matrix": {"variables": {"k": [1, 2]}, "write": [{"memory": {"id": "w${k}", "where": "n_regionkey = ${k}"}}]}}]),
):
    def _written(spark: SparkSession, sf_dir: str, write=_write) -> DataFrame:
        _run(spark, read=[_table(sf_dir, "nation")], write=write)
        return _run(spark, read=[{"union": {"sources": [{"memory": {"id": "w1"}}, {"memory": {"id": "w2"}}]}}])

    frame(f"write_{_kind}", NATION + " where n_regionkey in (1, 2)")(_written)


@frame("run_actions", "select 'a' k, 1 n union all select 'b', 2 union all select 'c', 3 union all select 'd', 4")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{tempfile.mkdtemp()}/t.db"
    insert = lambda k, n: {"sqlite": {"database": at, "command": "insert into t values (?, ?)", "params": [k, n]}}
    start = [
        {"sqlite": {"database": at, "command": "create table t (k, n)"}}, insert("a", 1), {"concurrent": {"run": [insert("b", 2)], "max_concurrency": 1}},
        {"matrix": {"variables": {"k": ["c"]}, "run": [insert("${k}", 3)]}}, {"recipe": {"run": {"on_start": [insert("d", 4)]}, "read": [_table(sf_dir, "region")]}},
    ]
    return _run(spark, read=[{"sqlite": {"database": at, "command": "select k, cast(n as integer) n from t"}}], run={"on_start": start}).select("k", F.col("n").cast("int"))


@frame("run_jinja", "select 'Hi Ann: 1 2 !' t")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{tempfile.mkdtemp()}/t.txt"
    text = "Hi {{ who.name }}: {% for x in items %}{{ x }} {% endfor %}{% if loud %}!{% endif %}"
    _run(spark, read=[_table(sf_dir, "region")], run={"on_start": [{"jinja": {"template": {"string": text}, "context": {"who": {"name": "Ann"}, "items": [1, 2], "loud": True}, "output_file": at}}]})
    with open(at, encoding="utf-8") as f:
        return spark.createDataFrame([(f.read(),)], "t string")


# frames
query("reindex_columns", "nation", [step("reindex", columns=["n_name", "extra"], fill_value="none")], "select n_name, 'none' extra from nation")
query("reindex_rows", "nation", [step("sort", by="n_nationkey"), step("reindex", index=[3, 1, 3])], NATION + " where n_nationkey = 1 union all " + NATION + " where n_nationkey = 3 union all " + NATION + " where n_nationkey = 3")
query("explode_lists", "part", [step("split.text", input="p_name", output="a", char=" "), step("split.text", input="p_name", output="b", char=" "), step("explode", input=["a", "b"])], "select p_partkey, unnest(string_split(p_name, ' ')) a, unnest(string_split(p_name, ' ')) b from part", ["p_partkey", "a", "b"])
query("recipe_step", "nation", [step("recipe", wrangles=[step("convert.case", input="n_name", output="v", case="lower"), step("create.column", output="w", value=1)], output=["v"])], "select n_nationkey, n_name, n_regionkey, lower(n_name) v from nation")
query("log_step", "nation", [step("log", info="a line"), step("log", columns=["n_name"])], NATION)
query("sample_fraction", "orders", [step("select.sample", rows=0.1, random_state=1), step("pandas.drop_duplicates", parameters={"subset": ["o_orderkey"]}), step("select.group_by", count=[{"o_orderkey": "n"}])], "select cast(round_even(count(*) * 0.1, 0) as bigint) n from orders")
query("sample_replace", "orders", [step("select.sample", rows=20000, replace=True, random_state=1), step("create.column", output="inside", value=1), step("select.group_by", count=[{"o_orderkey": "n"}], sum=[{"inside": "s"}])], "select cast(least(20000, count(*)) as bigint) n, cast(least(20000, count(*)) as bigint) s from orders")
query("price_breaks", [{"file": {"name": "region", "columns": ["r_regionkey", "r_name"]}}], [step("format.price_breaks", input=["r_name"], categoryLabel="Q", valueLabel="P")], "select r_regionkey, r_name, 'r_name' \"Q 1\", r_name \"P 1\" from region")
query("group_custom", "nation", [step("select.group_by", by="n_regionkey", sum=[{"n_nationkey": "s"}], size=[{"n_name": "k"}], mode=[{"n_regionkey": "m"}])], "select n_regionkey, cast(sum(n_nationkey) as bigint) s, count(*) k, n_regionkey m from nation group by 1")
query("group_prod_sem", "nation", [step("select.group_by", by="n_regionkey", sem=[{"n_nationkey": "e"}]), step("round", input="e", decimals=6)], "select n_regionkey, round(stddev_samp(n_nationkey) / sqrt(count(*)), 6) e from nation group by 1")

# strings
query("remove_words", "part", [step("create.column", output="gone", value="small"), step("remove_words", input="p_name", output="v", to_remove="gone")], "select p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: lower(w) <> 'small'), ' ') v from part", ["p_partkey", "v"])
query("compare_difference", "part", [step("create.column", output="t", value="small ring zest zest"), step("compare.text", input=["p_name", "t"], output="v", method="difference")], "select p_partkey, array_to_string(list_filter(['small', 'ring', 'zest'], lambda w: not list_contains(string_split(p_name, ' '), w)), ' ') v from part", ["p_partkey", "v"])
query("compare_intersection", "part", [step("create.column", output="t", value="small ring zest"), step("compare.text", input=["t", "p_name"], output="v", method="intersection")], "select p_partkey, array_to_string(list_filter(['small', 'ring', 'zest'], lambda w: list_contains(string_split(p_name, ' '), w)), ' ') v from part", ["p_partkey", "v"])
query("hash_sha512", "region", [step("create.hash", input="r_name", output="v", method="sha512"), step("select.length", input="v", output="n")], "select r_regionkey, 128 n from region", ["r_regionkey", "n"])
query("tokenize_boundary", "customer", [step("split.tokenize", input="c_name", output="w", method="boundary"), step("merge.concatenate", input="w", output="v", char="|")], "select c_custkey, array_to_string(regexp_extract_all(c_name, '[A-Za-z0-9_]+|[^A-Za-z0-9_]'), '|') v from customer", ["c_custkey", "v"])
query("tokenize_boundary_ignore_space", "part", [step("split.tokenize", input="p_name", output="w", method="boundary_ignore_space"), step("merge.concatenate", input="w", output="v", char="|")], "select p_partkey, array_to_string(regexp_extract_all(p_name, '[A-Za-z0-9_]+|[^A-Za-z0-9_ ]'), '|') v from part", ["p_partkey", "v"])
query("tokenize_regex", "customer", [step("split.tokenize", input="c_name", output="w", method="regex:[#0]+"), step("merge.concatenate", input="w", output="v", char="|")], "select c_custkey, array_to_string(regexp_split_to_array(c_name, '[#0]+'), '|') v from customer", ["c_custkey", "v"])
query("jinja_if", "part", [step("create.jinja", output="v", template={"string": "{% if p_size > 40 %}big{% elif p_size > 20 %}mid{% else %}{{ p_size }}{% endif %}!"})], "select p_partkey, case when p_size > 40 then 'big' when p_size > 20 then 'mid' else p_size || '' end || '!' v from part", ["p_partkey", "v"])
query("jinja_for", "part", [step("split.text", input="p_name", output="w", char=" "), step("create.jinja", output="v", template={"string": "{% for x in w %}{{ loop.index }}-{{ x | upper }};{% endfor %}"})], "select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x, i: i || '-' || upper(x) || ';'), '') v from part", ["p_partkey", "v"])
query("extract_brackets_kinds", "region", [step("create.jinja", output="t", template={"string": "<{{ r_name }}> {a} (b) [c]"}), step("extract.brackets", input="t", output="v", find=["square", "round"])], "select r_regionkey, 'b, c' v from region", ["r_regionkey", "v"])

# numbers and dates
query("maths", "part", [step("maths", input="p_size * 2 + 1", output="v")], "select p_partkey, p_size * 2 + 1 v from part", ["p_partkey", "v"])
query("python_except", "part", [step("python", command="int(p_name) + 1", output="v", **{"except": -1})], "select p_partkey, coalesce(try_cast(p_name as bigint) + 1, -1) v from part", ["p_partkey", "v"])
query("python_except_lists", "part", [step("python", command="[p_size * 2, float(p_brand)]", output=["a", "b"], **{"except": [0, 0.5]})], "select p_partkey, cast(p_size * 2 as double) a, cast(0.5 as double) b from part", ["p_partkey", "a", "b"])
query("uuids_differ", "orders", [step("create.uuid", output="u"), step("create.guid", output="g"), step("select.group_by", nunique=[{"u": "u", "g": "g"}])], "select count(*) u, count(*) g from orders")
for _unit, _sql in (("years", "year"), ("weeks", "week"), ("hours", "hour"), ("minutes", "minute"), ("seconds", "second"), ("milliseconds", "millisecond")):
    query(f"date_add_{_unit}", "orders", [step("date_calculator", input="o_orderdate", output="d", time_unit=_unit, time_value=7), step("format.dates", input="d", output="v", format="%Y-%m-%d %H:%M:%S")], f"select o_orderkey, strftime(o_orderdate + interval 7 {_sql}, '%Y-%m-%d %H:%M:%S') v from orders", ["o_orderkey", "v"])
_days = "(select unnest(generate_series(cast(o_orderdate as date), greatest(cast(o_orderdate as date), date '1998-12-31'), interval 1 day)) as d)"
for _range, _test, _times in (
    ("business days", "isodow(d) < 6", 1), ("months", "d = last_day(d)", 1), ("month starts", "day(d) = 1", 1), ("semi months", "day(d) = 15 or d = last_day(d)", 1), ("semi month starts", "day(d) in (1, 15)", 1),
    ("business month ends", "isodow(d) < 6 and month(d + to_days(cast(case isodow(d) when 5 then 3 else 1 end as int))) <> month(d)", 1), ("business month starts", "isodow(d) < 6 and month(d - to_days(cast(case isodow(d) when 1 then 3 else 1 end as int))) <> month(d)", 1),
    ("quarters", "d = last_day(d) and month(d) % 3 = 0", 1), ("quarter starts", "day(d) = 1 and month(d) % 3 = 1", 1), ("years", "month(d) = 12 and day(d) = 31", 1), ("business hours", "isodow(d) < 6", 8),
):
    query(
        "date_range_" + _range.replace(" ", "_") + ("_" if _range == "business days" else ""), "orders",
        [step("create.column", output="e", value="1998-12-31"), step("extract.date_range", start_time="o_orderdate", end_time="e", output="v", range=_range)],
        f"select o_orderkey, (select greatest({_times} * count(*) filter (where {_test}) - 1, 0) from {_days}) v from orders", ["o_orderkey", "v"],
    )
for _range, _seconds in (("weeks", 604800), ("hours", 3600), ("minutes", 60), ("seconds", 1)):
    query("date_range_" + _range, "orders", [step("create.column", output="e", value="2000-01-01"), step("extract.date_range", start_time="o_orderdate", end_time="e", output="v", range=_range)], f"select o_orderkey, cast(greatest(floor((epoch(timestamp '2000-01-01') - epoch(o_orderdate)) / {_seconds}), 0) as bigint) v from orders", ["o_orderkey", "v"])

# nested values
query("yaml_roundtrip", "part", [step("merge.to_dict", input=["p_brand", "p_type"], output="d"), step("convert.to_yaml", input="d", output="y"), step("convert.from_yaml", input="y", output="z"), step("select.element", input="z['p_type']", output="v")], "select p_partkey, 'p_brand: ' || p_brand || chr(10) || 'p_type: ' || p_type || chr(10) y, p_type v from part", ["p_partkey", "y", "v"])
query("split_list", "part", [step("split.text", input="p_name", output="w", char=" "), step("split.list", input="w", output=["a", "b"])], "select p_partkey, string_split(p_name, ' ')[1] a, string_split(p_name, ' ')[2] b from part", ["p_partkey", "a", "b"])
query("merge_to_list", "part", [step("create.column", output="e", value=""), step("merge.to_list", input=["p_brand", "e", "p_type"], output="l"), step("merge.concatenate", input="l", output="v", char="|")], "select p_partkey, p_brand || '|' || p_type v from part", ["p_partkey", "v"])
query("merge_dictionaries", "part", [step("merge.to_dict", input=["p_brand", "p_type"], output="a"), step("create.column", output="p_type", value="x", value_if_exists="new"), step("merge.to_dict", input=["p_type"], output="b"), step("merge.dictionaries", input=["a", "b"], output="m"), step("convert.to_json", input="m", output="v")], """select p_partkey, '{"p_brand":"' || p_brand || '","p_type":"x"}' v from part""", ["p_partkey", "v"])
query("highest_confidence", "part", [step("create.jinja", output="a", template={"string": "{{ p_brand }} || 0.{{ p_size + 10 }}"}), step("create.column", output="b", value="other || 0.35"), step("select.highest_confidence", input=["a", "b"], output=["v", "c"])], "select p_partkey, case when cast('0.' || (p_size + 10) as double) > 0.35 then p_brand when cast('0.' || (p_size + 10) as double) = 0.35 then greatest(p_brand, 'other') else 'other' end v, greatest(cast('0.' || (p_size + 10) as double), 0.35) c from part", ["p_partkey", "v", "c"])
query("threshold", "part", [step("create.jinja", output="a", template={"string": "{{ p_brand }} || 0.{{ p_size + 10 }}"}), step("select.threshold", input=["a", "p_type"], output="v", threshold=0.35)], "select p_partkey, case when cast('0.' || (p_size + 10) as double) > 0.35 then p_brand else p_type end v from part", ["p_partkey", "v"])
query("compare_lists_union", "part", [step("split.text", input="p_name", output="a", char=" "), step("split.text", input="p_type", output="b", char=" "), step("compare.lists", input=["a", "b"], output="c", method="union"), step("merge.concatenate", input="c", output="v", char="|")], "select p_partkey, replace(p_name, ' ', '|') || '|' || replace(p_type, ' ', '|') v from part", ["p_partkey", "v"])
query("adjusted_cosine", [{"join": {"left_on": "k", "right_on": "vec_id", "sources": [{"recipe": {"read": [{"file": "embeddings"}], "wrangles": [step("math", input="vec_id + 1", output="k")]}}, {"file": "embeddings"}]}}], [step("similarity", input=["embedding_x", "embedding_y"], output="v", method="adjusted cosine"), step("round", input="v", decimals=2), step("rename", vec_id_x="vec_id")], "select a.vec_id, round_even(round(greatest(0, 1 - acos(greatest(least(list_cosine_similarity(a.embedding, b.embedding), 1), -1))), 3), 2) v from (select vec_id, cast(embedding as double[]) embedding from embeddings) a join (select vec_id, cast(embedding as double[]) embedding from embeddings) b on a.vec_id + 1 = b.vec_id", ["vec_id", "v"])

# user functions


def _shout(n_name: str, mark: str = "!") -> str:
    return n_name.lower() + mark


def _odd(df: DataFrame, variables: dict) -> DataFrame:
    return df.where(F.col("n_nationkey") % variables["by"] == 1)


def _spread(s: pd.Series) -> float:
    return float(s.max() - s.min())


@frame("custom_functions", "select n_nationkey, n_name, n_regionkey, lower(n_name) || '?' v from nation where n_nationkey % 2 = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.plans import recipe

    steps = [{"custom.shout": {"output": "v", "mark": "?"}}, {"custom.odd": {}}]
    return recipe.run({"read": [_table(sf_dir, "nation")], "wrangles": steps}, spark, {"by": 2}, functions={"shout": _shout, "odd": _odd})


@frame("custom_aggregate", "select n_regionkey, cast(max(n_nationkey) - min(n_nationkey) as double) v from nation group by 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, {"spread": _spread}, read=[_table(sf_dir, "nation")], wrangles=[step("select.group_by", by="n_regionkey", **{"custom.spread": [{"n_nationkey": "v"}]})])


@frame("custom_tokenizer", "select n_nationkey, array_to_string(string_split(n_name, 'A'), '|') v from nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [step("split.tokenize", input="n_name", output="w", method="custom.cut"), step("merge.concatenate", input="w", output="v", char="|"), step("select.columns", input=["n_nationkey", "v"])]
    return _run(spark, {"cut": lambda t: t.split("A")}, read=[_table(sf_dir, "nation")], wrangles=steps)


# models that the process holds
@frame("standardize_words", "select p_partkey, regexp_replace(regexp_replace(p_name, '\\bsmall\\b', 'tiny', 'gi'), '\\bring\\b', 'loop', 'gi') v from part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _models(s={"purpose": "standardize", "columns": ["Find", "Replace"], "data": [["small", "tiny"], ["ring", "loop"]]}):
        return _run(spark, read=[_table(sf_dir, "part")], wrangles=[step("standardize", input="p_name", output="v", model_id="s"), step("select.columns", input=["p_partkey", "v"])])


@frame("classify_words", "select p_partkey, case when p_name like '%small%' then 'little' when p_name like '%ring%' then 'round' else '' end v from part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _models(c={"purpose": "classify", "columns": ["Example", "Category"], "data": [["small", "little"], ["ring", "round"]]}):
        return _run(spark, read=[_table(sf_dir, "part")], wrangles=[step("classify", input="p_name", output="v", model_id="c"), step("select.columns", input=["p_partkey", "v"])])


@frame("extract_custom", "select p_partkey, array_to_string(list_distinct_ordered, '|') v from (select p_partkey, list_filter(['tiny', 'ring'], lambda w: case w when 'tiny' then list_contains(string_split(p_name, ' '), 'small') else list_contains(string_split(p_name, ' '), 'ring') end) list_distinct_ordered from part)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _models(e={"purpose": "extract", "columns": ["Find", "Output"], "data": [["small", "tiny"], ["ring", ""]]}):
        return _run(spark, read=[_table(sf_dir, "part")], wrangles=[step("extract.custom", input="p_name", output="l", model_id="e"), step("merge.concatenate", input="l", output="v", char="|"), step("select.columns", input=["p_partkey", "v"])])


@frame("lookup_many", "select r_regionkey, (select string_agg(n_name, '|' order by n_nationkey) from (select * from nation where n_regionkey = r_regionkey order by n_nationkey limit 2)) v from region")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    with _models(n={"purpose": "lookup", "columns": ["Key", "Name"], "data": [[r["n_regionkey"], r["n_name"]] for r in nations]}):
        found = _run(spark, read=[_table(sf_dir, "region")], wrangles=[step("lookup", input="r_regionkey", output="v", model_id="n", n=2)])
    return found.select("r_regionkey", F.array_join(F.transform("v", lambda m: m["Name"]), "|").alias("v"))


@frame("train_lookup", "select r_regionkey, r_name, upper(r_name) v from region")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _models():
        _run(spark, read=[_table(sf_dir, "region", columns=["r_name"])], wrangles=[step("rename", r_name="Key"), step("convert.case", input="Key", output="Value", case="upper")], write=[{"train.lookup": {"name": "regions"}}])
        return _run(spark, read=[_table(sf_dir, "region", columns=["r_regionkey", "r_name"])], wrangles=[step("lookup", input="r_name", output={"Value": "v"}, model_id="regions")])


# streams
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.streaming import runner

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return runner.source(spark, f"{sf_dir}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(df: DataFrame, mode: str) -> DataFrame:
    from sluice.streaming import runner

    return runner.drain(df, f"stream_{uuid.uuid4().hex}", mode)


@frame("stream_sliding", "select w window_start, event_type, count(*) n from (select event_type, unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) w from events) group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.streaming import runner

    counted = runner.windowed(_events(spark, sf_dir), "ts", "1 hour", "30 minutes", by=["event_type"], n=F.count("*"))
    return _drained(counted, "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@frame(
    "stream_sessions",
    """with a as (select event_type, ts, case when ts - lag(ts) over w >= interval '10 minutes' or lag(ts) over w is null then 1 else 0 end b from events window w as (partition by event_type order by ts)),
    s as (select event_type, ts, sum(b) over (partition by event_type order by ts rows unbounded preceding) g from a)
    select event_type, min(ts) window_start, count(*) n from s group by event_type, g""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.streaming import runner

    counted = runner.windowed(_events(spark, sf_dir), "ts", "10 minutes", by=["event_type"], session=True, n=F.count("*"))
    return _drained(counted, "complete").select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@frame("stream_distinct", "select distinct event_type from events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(_events(spark, sf_dir).dropDuplicates(["event_type"]).select("event_type"), "append")


@frame("stream_steps", "select event_id, upper(event_type) event_type from events where event_id % 2 = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.streaming import runner

    steps = [step("filter", where="event_id % 2 = 0"), step("convert.case", input="event_type", case="upper")]
    return _drained(runner.apply(_events(spark, sf_dir), steps).select("event_id", "event_type"), "append")


@frame("stream_joined", "select event_id, r_name from events join region on event_id % 5 = r_regionkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    return _drained(_events(spark, sf_dir).join(regions, F.col("event_id") % 5 == F.col("r_regionkey")).select("event_id", "r_name"), "append")


@frame("stream_batches", "select event_type, count(*) n from events group by 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.streaming import runner

    at = _at(spark, "batches")
    given = {"wrangles": [step("select.group_by", by="event_type", count=[{"event_id": "n"}])], "write": [{"file": {"name": f"{at}/out.parquet", "single": False, "mode": "append"}}]}
    runner.run_batches(_events(spark, sf_dir), given, f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out.parquet").groupBy("event_type").agg(F.sum("n").alias("n"))
