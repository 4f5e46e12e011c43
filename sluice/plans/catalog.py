"""Registered queries over the test tables, each a recipe, with the SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(key: str, read: str | list, wrangles: list | None = None, sql: str | None = None, columns: list | None = None) -> None:
    """A recipe as a query. read: a table's name, or read steps with tables as names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from sluice.plans import recipe

        def table(x: str | dict) -> dict:
            return {"name": f"{sf_dir}/{x}.parquet"} if isinstance(x, str) else {**x, "name": f"{sf_dir}/{x['name']}.parquet"}

        def placed(x: Any) -> Any:
            if isinstance(x, dict):
                return {k: table(v) if k == "file" else placed(v) for k, v in x.items()}
            return [placed(y) for y in x] if isinstance(x, list) else x

        steps = list(wrangles or [])
        if columns:
            steps.append({"select.columns": {"input": columns}})
        return recipe.run({"read": placed([{"file": read}] if isinstance(read, str) else read), "wrangles": steps}, spark)

    QUERIES[key] = run
    if sql:
        ORACLE_SQL[key] = sql


def frame(key: str, sql: str | None = None):
    """A query built in Python."""

    def add(call: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[key] = call
        if sql:
            ORACLE_SQL[key] = sql
        return call

    return add


def step(op: str, **params: Any) -> dict:
    return {op: params}


query(
    "pricing_summary", "lineitem",
    [
        step("filter", where="l_shipdate <= timestamp '1998-09-02'"),
        step("math", input="l_extendedprice * (1 - l_discount)", output="disc_price"),
        step("math", input="disc_price * (1 + l_tax)", output="charge"),
        step("select.group_by", by=["l_returnflag", "l_linestatus"], sum=[{"l_quantity": "sum_qty", "l_extendedprice": "sum_base", "disc_price": "sum_disc", "charge": "sum_charge"}], mean=[{"l_quantity": "avg_qty", "l_discount": "avg_disc"}], count=[{"l_orderkey": "n"}]),
        step("round", input=["sum_qty", "sum_base", "sum_disc", "sum_charge", "avg_qty", "avg_disc"], decimals=2),
        step("sort", by=["l_returnflag", "l_linestatus"]),
    ],
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice), 2) sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) sum_disc,
    round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) sum_charge, round(avg(l_quantity), 2) avg_qty, round(avg(l_discount), 2) avg_disc, count(*) n
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""",
)

# joins, unions, side by side
for _how in ("inner", "left", "right", "outer"):
    _sql = {"inner": "join", "left": "left join", "right": "right join", "outer": "full join"}[_how]
    query(
        f"join_{_how}",
        [{"join": {"how": _how, "left_on": "o_custkey", "right_on": "c_custkey", "sources": [{"file": {"name": "orders"}}, {"file": {"name": "customer"}}]}}],
        None,
        f"select o_orderkey, o_custkey, o_totalprice, c_custkey, c_name, c_mktsegment from orders {_sql} customer on o_custkey = c_custkey",
        ["o_orderkey", "o_custkey", "o_totalprice", "c_custkey", "c_name", "c_mktsegment"],
    )
for _how, _sql in (("left", "left join"), ("right", "right join"), ("outer", "full join")):  # keys that either side lacks
    query(f"join_partial_{_how}", [{"join": {"how": _how, "left_on": "n_nationkey", "right_on": "p_size", "sources": [{"file": "nation"}, {"file": "part"}]}}], None, f"select n_nationkey, n_name, p_partkey, p_size from nation {_sql} part on n_nationkey = p_size", ["n_nationkey", "n_name", "p_partkey", "p_size"])
query("join_cross", [{"join": {"how": "cross", "sources": [{"file": "region"}, {"file": "nation"}]}}], None, "select r_regionkey, r_name, n_nationkey, n_name, n_regionkey from region cross join nation")
query("union_reads", [{"union": {"sources": [{"file": "nation"}, {"file": "region"}]}}], None, "select * from nation union all by name select * from region")
query("implicit_union", [{"file": {"name": "nation", "columns": ["n_name"]}}, {"file": {"name": "nation", "columns": ["n_name"], "where": "n_regionkey = 1"}}], None, "select n_name from nation union all select n_name from nation where n_regionkey = 1")
query("concat_reads", [{"concatenate": {"sources": [{"file": "nation"}, {"file": "region"}]}}], None, "select * exclude (k) from (select *, row_number() over (order by n_nationkey) k from nation) full join (select *, row_number() over (order by r_regionkey) k from region) using (k)")
query("matrix_reads", [{"matrix": {"variables": {"r": [0, 1, 2]}, "read": [{"file": {"name": "nation", "where": "n_regionkey = ${r}"}}]}}], None, "select * from nation where n_regionkey in (0, 1, 2)")

# read parameters
query("read_columns", [{"file": {"name": "customer", "columns": ["c_custkey", "c_n*"], "not_columns": ["c_nationkey"], "where": "c_acctbal > 5000"}}], None, "select c_custkey, c_name from customer where c_acctbal > 5000")

# filters
for _key, _params, _where in (
    ("equal", {"input": "o_orderstatus", "equal": "F"}, "o_orderstatus = 'F'"),
    ("not_equal", {"input": "o_orderstatus", "not_equal": "F"}, "o_orderstatus <> 'F'"),
    ("is_in", {"input": "o_orderpriority", "is_in": ["1-URGENT", "2-HIGH"]}, "o_orderpriority in ('1-URGENT', '2-HIGH')"),
    ("not_in", {"input": "o_orderpriority", "not_in": ["1-URGENT", "2-HIGH"]}, "o_orderpriority not in ('1-URGENT', '2-HIGH')"),
    ("greater_than", {"input": "o_totalprice", "greater_than": 100000}, "o_totalprice > 100000"),
    ("greater_equal", {"input": "o_custkey", "greater_than_equal_to": 700}, "o_custkey >= 700"),
    ("less_than", {"input": "o_totalprice", "less_than": 100000}, "o_totalprice < 100000"),
    ("less_equal", {"input": "o_custkey", "less_than_equal_to": 700}, "o_custkey <= 700"),
    ("between", {"input": "o_custkey", "between": [100, 200], "inclusive": "left"}, "o_custkey >= 100 and o_custkey < 200"),
    ("contains", {"input": "o_orderpriority", "contains": "^[12]-"}, "o_orderpriority like '1-%' or o_orderpriority like '2-%'"),
    ("not_contains", {"input": "o_orderpriority", "not_contains": "low", "case": False}, "o_orderpriority not ilike '%low%'"),
    ("not_null", {"input": "o_orderstatus", "is_null": False}, "o_orderstatus is not null and o_orderstatus <> ''"),
    ("where", {"where": 'o_orderstatus = ? and "o_custkey" < ?', "where_params": ["O", 500]}, "o_orderstatus = 'O' and o_custkey < 500"),
):
    query(f"filter_{_key}", "orders", [step("filter", **_params)], f"select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders where {_where}", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])

# aggregates
for _key, _how, _sql in (
    ("std", {"std": [{"l_quantity": "v"}]}, "round(stddev_samp(l_quantity), 6)"),
    ("var", {"var": [{"l_quantity": "v"}]}, "round(var_samp(l_quantity), 6)"),
    ("median", {"median": [{"l_quantity": "v"}]}, "median(l_quantity)"),
    ("p25", {"p25": [{"l_extendedprice": "v"}]}, "round(quantile_cont(l_extendedprice, 0.25), 6)"),
    ("p90", {"p90": [{"l_extendedprice": "v"}]}, "round(quantile_cont(l_extendedprice, 0.9), 6)"),
    ("nunique", {"nunique": [{"l_suppkey": "v"}]}, "count(distinct l_suppkey)"),
    ("min", {"min": [{"l_quantity": "v"}]}, "min(l_quantity)"),
    ("max", {"max": [{"l_extendedprice": "v"}]}, "max(l_extendedprice)"),
    ("any", {"any": [{"l_discount": "v"}]}, "bool_or(l_discount <> 0)"),
    ("all", {"all": [{"l_discount": "v"}]}, "bool_and(l_discount <> 0)"),
):
    _steps = [step("select.group_by", by=["l_returnflag", "l_linestatus"], **_how)]
    if "round" in _sql:
        _steps.append(step("round", input="v", decimals=6))
    query(f"group_{_key}", "lineitem", _steps, f"select l_returnflag, l_linestatus, {_sql} v from lineitem group by all")
query("group_global", "orders", [step("select.group_by", sum=[{"o_custkey": "s"}], count=[{"o_orderkey": "n"}])], "select cast(sum(o_custkey) as bigint) s, count(*) n from orders")
query("group_keys_only", "lineitem", [step("select.group_by", by=["l_returnflag", "l_linestatus"])], "select distinct l_returnflag, l_linestatus from lineitem")
query("group_first_last", "nation", [step("select.group_by", by="n_regionkey", first=[{"n_name": "first_name"}], last=[{"n_name": "last_name"}])], "select n_regionkey, arg_min(n_name, n_nationkey) first_name, arg_max(n_name, n_nationkey) last_name from nation group by 1")
query("group_list", "nation", [step("select.group_by", by="n_regionkey", list=[{"n_name": "names"}]), step("merge.concatenate", input="names", output="names", char="|")], "select n_regionkey, string_agg(n_name, '|' order by n_nationkey) as names from nation group by 1")
query("group_counts", "orders", [step("select.group_by", by="o_orderpriority", counts=[{"o_orderstatus": "c"}]), step("select.dictionary_element", input="c", output="f", element="F"), step("convert.data_type", input="f", data_type="int")], "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') f from orders group by 1", ["o_orderpriority", "f"])

# order, limits, windows
query("sort_topk", "lineitem", [step("sort", by=["l_extendedprice", "l_orderkey", "l_linenumber"], ascending=[False, True, True]), step("select.head", n=50)], "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 50", ["l_orderkey", "l_linenumber", "l_extendedprice"])
query("tail", "nation", [step("sort", by="n_nationkey"), step("select.tail", n=5)], "select * from nation order by n_nationkey desc limit 5")
query("sample_rows", "orders", [step("select.sample", rows=100, random_state=1), step("select.group_by", count=[{"o_orderkey": "n"}])], "select cast(100 as bigint) n")
query("index_by", "nation", [step("sort", by="n_nationkey"), step("create.index", output="i", start=10, step=5, by="n_regionkey")], "select *, 10 + 5 * (row_number() over (partition by n_regionkey order by n_nationkey) - 1) i from nation")
query("index_global", "nation", [step("create.index", output="i")], "select *, row_number() over (order by n_nationkey) i from nation")
query("index_after_sort", "lineitem", [step("sort", by=["l_extendedprice", "l_orderkey", "l_linenumber"], ascending=[False, True, True]), step("create.index", output="i")], "select l_orderkey, l_linenumber, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber) i from lineitem", ["l_orderkey", "l_linenumber", "i"])
query("drop_duplicates", "lineitem", [step("pandas.drop_duplicates", parameters={"subset": ["l_orderkey", "l_returnflag"]}), step("select.group_by", by="l_returnflag", count=[{"l_orderkey": "n"}])], "select l_returnflag, count(distinct l_orderkey) n from lineitem group by 1")

# sql
query("sql_window", "orders", [step("sql", command="SELECT o_custkey, o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM df WHERE o_orderstatus = :s", params={"s": "F"})], "select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) r from orders where o_orderstatus = 'F'")
query("sql_setops", "orders", [step("sql", command="SELECT o_custkey FROM df WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM df WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM df WHERE o_orderstatus = 'P'")], "select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O' except select o_custkey from orders where o_orderstatus = 'P'")
query("sql_subquery", "orders", [step("sql", command='SELECT "o_orderkey", IFNULL(o_orderstatus, \'\') AS s FROM df WHERE o_custkey IN (SELECT o_custkey FROM df WHERE o_totalprice > ?) AND o_orderpriority LIKE \'%urgent\'', params=[200000])], "select o_orderkey, o_orderstatus s from orders where o_custkey in (select o_custkey from orders where o_totalprice > 200000) and o_orderpriority ilike '%urgent'")

# strings
for _key, _params, _sql in (
    ("convert.case lower", {"case": "lower"}, "lower(c_name)"),
    ("convert.case upper", {"case": "upper"}, "upper(c_name)"),
    ("convert.case sentence", {"case": "sentence"}, "upper(left(c_name, 1)) || lower(substr(c_name, 2))"),
    ("format.trim", {}, "trim(c_name)"),
    ("format.pad left", {"pad_length": 25, "side": "left", "char": "*"}, "lpad(c_name, 25, '*')"),
    ("format.pad right", {"pad_length": 25, "side": "right", "char": "*"}, "rpad(c_name, 25, '*')"),
    ("format.prefix", {"value": "a-"}, "'a-' || c_name"),
    ("format.suffix", {"value": "-z"}, "c_name || '-z'"),
    ("replace", {"find": "0+(\\d)", "replace": "_\\1"}, "regexp_replace(c_name, '0+([0-9])', '_\\1', 'g')"),
    ("select.left", {"length": 5}, "left(c_name, 5)"),
    ("select.right", {"length": 4}, "right(c_name, 4)"),
    ("select.left rest", {"length": -3}, "left(c_name, length(c_name) - 3)"),
    ("select.substring", {"start": 3, "length": 6}, "substr(c_name, 3, 6)"),
    ("select.length", {}, "length(c_name)"),
    ("create.hash md5", {"method": "md5"}, "md5(c_name)"),
    ("create.hash sha1", {"method": "sha1"}, "sha1(c_name)"),
    ("create.hash sha256", {"method": "sha256"}, "sha256(c_name)"),
):
    query("text_" + _key.replace(".", "_").replace(" ", "_"), "customer", [step(_key.split()[0], input="c_name", output="v", **_params)], f"select c_custkey, {_sql} v from customer", ["c_custkey", "v"])
query("clean_whitespaces", "documents", [step("clean_whitespaces", input="text", output="v"), step("create.hash", input="v", output="h")], r"select doc_id, md5(trim(regexp_replace(text, '\s{2,}| ', ' ', 'g'))) h from documents", ["doc_id", "h"])
query("title_case", "part", [step("convert.case", input="p_name", output="v", case="title")], "select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') v from part", ["p_partkey", "v"])
query("concatenate", "part", [step("merge.concatenate", input=["p_brand", "p_type", "p_size"], output="v", char=" / ")], "select p_partkey, p_brand || ' / ' || p_type || ' / ' || p_size v from part", ["p_partkey", "v"])
query("split_text_columns", "customer", [step("split.text", input="c_name", output=["a", "b"], char="#")], "select c_custkey, string_split(c_name, '#')[1] a, string_split(c_name, '#')[2] b from customer", ["c_custkey", "a", "b"])
query("split_text_element", "part", [step("split.text", input="p_name", output="v", char=" ", element=-1)], "select p_partkey, string_split(p_name, ' ')[-1] v from part", ["p_partkey", "v"])
query("tokenize_explode", "part", [step("split.tokenize", input="p_name", output="w"), step("explode", input="w"), step("select.group_by", by="w", count=[{"p_partkey": "n"}])], "select w, count(*) n from (select unnest(string_split(p_name, ' ')) w from part) group by 1")
query("extract_regex", "customer", [step("extract.regex", input="c_name", output="v", find="[1-9]+", output_format="concatenate", char="-")], "select c_custkey, array_to_string(regexp_extract_all(c_name, '[1-9]+'), '-') v from customer", ["c_custkey", "v"])
query("extract_brackets", "part", [step("create.jinja", output="t", template={"string": "a ({{ p_brand }}) [{{ p_size }}]"}), step("extract.brackets", input="t", output="v")], "select p_partkey, p_brand || ', ' || p_size v from part", ["p_partkey", "v"])
query("remove_duplicate_words", "part", [step("merge.concatenate", input=["p_name", "p_name"], output="t", char=" "), step("format.remove_duplicates", input="t", output="v")], "select p_partkey, case when string_split(p_name, ' ')[1] = string_split(p_name, ' ')[2] then string_split(p_name, ' ')[1] else p_name end v from part", ["p_partkey", "v"])
query("compare_words", "part", [step("compare.text", input=["p_name", "p_type"], output="v", method="difference")], "select p_partkey, array_to_string(list_filter(string_split(p_type, ' '), lambda w: not list_contains(string_split(p_name, ' '), w)), ' ') v from part", ["p_partkey", "v"])
query("compare_overlap", "part", [step("compare.text", input=["p_name", "p_type"], output=["v", "ratio"], method="overlap", include_ratio=True)], None, ["p_partkey", "v", "ratio"])
query("where_rowwise", "customer", [step("convert.case", input="c_mktsegment", case="lower", where="c_acctbal < 0")], "select c_custkey, case when c_acctbal < 0 then lower(c_mktsegment) else c_mktsegment end c_mktsegment from customer", ["c_custkey", "c_mktsegment"])

# numbers
query("math_expression", "lineitem", [step("math", input="sqrt(l_quantity) + where(l_discount > 0.05, l_tax, 0) ** 2", output="v"), step("round", input="v", decimals=6)], "select l_orderkey, l_linenumber, round(sqrt(l_quantity) + pow(case when l_discount > 0.05 then l_tax else 0 end, 2), 6) v from lineitem", ["l_orderkey", "l_linenumber", "v"])
query("round", "customer", [step("round", input="c_acctbal", output="v", decimals=1)], "select c_custkey, round_even(c_acctbal, 1) v from customer", ["c_custkey", "v"])
query("bins", "part", [step("create.bins", input="p_size", output="v", bins=[0, 10, 25, "+"], labels=["low", "mid", "high"])], "select p_partkey, case when p_size > 0 and p_size <= 10 then 'low' when p_size > 10 and p_size <= 25 then 'mid' when p_size > 25 then 'high' else 'nan' end v from part", ["p_partkey", "v"])
query("case_when", "part", [step("compute.case_when", output="v", cases=[{"condition": "p_size > 40", "value": "big"}, {"condition": "p_size in [1, 2, 3] or p_brand == 'Brand#11'", "value": "odd"}], default="rest")], "select p_partkey, case when p_size > 40 then 'big' when p_size in (1, 2, 3) or p_brand = 'Brand#11' then 'odd' else 'rest' end v from part", ["p_partkey", "v"])
query("significant_figures", "part", [step("format.significant_figures", input="p_retailprice", output="v", significant_figures=2)], "select p_partkey, round_even(p_retailprice * pow(10, 1 - floor(log10(p_retailprice))), 0) / pow(10, 1 - floor(log10(p_retailprice))) v from part", ["p_partkey", "v"])
query("python_expression", "part", [step("python", command="p_brand.upper() + '-' + str(p_size * 2)", output="v")], "select p_partkey, upper(p_brand) || '-' || (p_size * 2) v from part", ["p_partkey", "v"])
query("data_type", "orders", [step("select.left", input="o_orderpriority", output="v", length=1), step("convert.data_type", input="v", data_type="int")], "select o_orderkey, cast(left(o_orderpriority, 1) as bigint) v from orders", ["o_orderkey", "v"])
query("fraction_to_decimal", "part", [step("create.jinja", output="t", template={"string": "{{ p_size }} 1/2 in"}), step("convert.fraction_to_decimal", input="t", output="v")], "select p_partkey, (p_size + 0.5) || ' in' v from part", ["p_partkey", "v"])
query("create_column", "nation", [step("create.column", output={"k": "fixed"}), step("create.column", output="n_name", value="z", value_if_exists="coalesce")], "select *, 'fixed' k from nation")
query("copy_rename_drop", "nation", [step("copy", input="n_name", output="a"), step("rename", **{"n_*key": "*_id"}), step("drop", columns=["n_name", "missing"])], "select n_nationkey nation_id, n_regionkey region_id, n_name a from nation")

# dates
query("date_add_months", "orders", [step("date_calculator", input="o_orderdate", output="d", time_unit="months", time_value=5), step("format.dates", input="d", output="v", format="%Y-%m-%d")], "select o_orderkey, strftime(o_orderdate + interval 5 month, '%Y-%m-%d') v from orders", ["o_orderkey", "v"])
query("date_subtract_days", "orders", [step("date_calculator", input="o_orderdate", output="d", operation="subtract", time_unit="days", time_value=45), step("format.dates", input="d", output="v", format="%d/%m/%y")], "select o_orderkey, strftime(o_orderdate - interval 45 day, '%d/%m/%y') v from orders", ["o_orderkey", "v"])
query("date_properties", "orders", [step("extract.date_properties", input="o_orderdate", output=p, property=p) for p in ("day", "day_of_year", "month", "month_name", "weekday", "week_day_name", "week_year", "quarter")], "select o_orderkey, cast(day(o_orderdate) as int) as day, cast(dayofyear(o_orderdate) as int) day_of_year, cast(month(o_orderdate) as int) as month, monthname(o_orderdate) month_name, cast(isodow(o_orderdate) - 1 as int) weekday, dayname(o_orderdate) week_day_name, cast(weekofyear(o_orderdate) as int) week_year, cast(quarter(o_orderdate) as int) as quarter from orders", ["o_orderkey", "day", "day_of_year", "month", "month_name", "weekday", "week_day_name", "week_year", "quarter"])
query("date_range_days", "orders", [step("create.column", output="e", value="2000-01-01"), step("extract.date_range", start_time="o_orderdate", end_time="e", output="v", range="days")], "select o_orderkey, greatest(date_diff('day', cast(o_orderdate as date), date '2000-01-01'), 0) v from orders", ["o_orderkey", "v"])
query("date_range_business_days", "orders", [step("create.column", output="e", value="2000-01-01"), step("extract.date_range", start_time="o_orderdate", end_time="e", output="v", range="business days")], "select o_orderkey, (select greatest(count(*) filter (where isodow(d) < 6) - 1, 0) from (select unnest(generate_series(cast(o_orderdate as date), greatest(cast(o_orderdate as date), date '2000-01-01'), interval 1 day)) as d)) v from orders", ["o_orderkey", "v"])

# lists, mappings, JSON
query("json_props", "events", [step("convert.from_json", input="props", output="j", schema="map<string,long>"), step("select.dictionary_element", input="j", output="v", element="k", default=None)], "select event_id, cast(json_extract_string(props, '$.k') as bigint) v from events", ["event_id", "v"])
query("json_element", "events", [step("select.element", input="props['k']", output="v")], "select event_id, json_extract_string(props, '$.k') v from events", ["event_id", "v"])
query("split_dictionary", "events", [step("split.dictionary", input="props")], "select event_id, json_extract_string(props, '$.k') k from events", ["event_id", "k"])
query("to_json", "part", [step("merge.to_dict", input=["p_brand", "p_type"], output="d"), step("convert.to_json", input="d", output="v")], """select p_partkey, '{"p_brand":"' || p_brand || '","p_type":"' || p_type || '"}' v from part""", ["p_partkey", "v"])
query("list_element", "part", [step("split.text", input="p_name", output="w", char=" "), step("select.list_element", input="w", output="v", element=1, default="")], "select p_partkey, coalesce(string_split(p_name, ' ')[2], '') v from part", ["p_partkey", "v"])
query("merge_lists", "part", [step("split.text", input="p_name", output="a", char=" "), step("split.text", input="p_type", output="b", char=" "), step("merge.lists", input=["a", "b"], output="c"), step("merge.concatenate", input="c", output="v", char="|")], "select p_partkey, array_to_string(string_split(p_name, ' ') || string_split(p_type, ' '), '|') v from part", ["p_partkey", "v"])
query("compare_lists", "part", [step("create.column", output="t", value="small ring PROMO"), step("split.text", input="t", output="b", char=" "), step("split.text", input="p_name", output="a", char=" "), step("compare.lists", input=["a", "b"], output="c"), step("merge.concatenate", input="c", output="v", char="|")], "select p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: w in ('small', 'ring', 'PROMO')), '|') v from part", ["p_partkey", "v"])
query("coalesce", "part", [step("create.column", output="e", value=""), step("merge.coalesce", input=["e", "p_name"], output="v")], "select p_partkey, p_name v from part", ["p_partkey", "v"])
query("key_value_pairs", "part", [step("merge.key_value_pairs", input={"p_brand": "p_type"}, output="m"), step("convert.to_json", input="m", output="v")], """select p_partkey, '{"' || p_brand || '":"' || p_type || '"}' v from part""", ["p_partkey", "v"])
query("accordion", "part", [step("split.text", input="p_name", output="w", char=" "), step("accordion", input="w", output="u", wrangles=[step("convert.case", input="w", output="u", case="upper")]), step("merge.concatenate", input="u", output="v", char="|")], "select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w)), '|') v from part", ["p_partkey", "v"])
query("accordion_after_sort", "lineitem", [step("merge.concatenate", input=["l_orderkey", "l_linenumber"], output="t", char=" "), step("split.text", input="t", output="w", char=" "), step("sort", by="l_extendedprice"), step("accordion", input="w", output="u", wrangles=[step("format.prefix", input="w", output="u", value="x")]), step("merge.concatenate", input="u", output="v", char="|")], "select l_orderkey, l_linenumber, 'x' || l_orderkey || '|x' || l_linenumber v from lineitem", ["l_orderkey", "l_linenumber", "v"])
query("transpose", "region", [step("transpose", header_column="r_name")], "select 'r_regionkey' r_name, " + ", ".join(f"max(r_regionkey) filter (where r_name = '{r}') \"{r}\"" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " from region")

# vectors
for _key, _sql in (("cosine", "list_cosine_similarity(a.embedding, b.embedding)"), ("euclidean", "list_distance(a.embedding, b.embedding)")):
    query(
        f"similarity_{_key}",
        [{"join": {"left_on": "k", "right_on": "vec_id", "sources": [{"recipe": {"read": [{"file": "embeddings"}], "wrangles": [step("math", input="vec_id + 1", output="k")]}}, {"file": "embeddings"}]}}],
        [step("similarity", input=["embedding_x", "embedding_y"], output="v", method=_key), step("round", input="v", decimals=4), step("rename", vec_id_x="vec_id")],
        f"select a.vec_id, round({_sql}, 4) v from (select vec_id, cast(embedding as double[]) embedding from embeddings) a join (select vec_id, cast(embedding as double[]) embedding from embeddings) b on a.vec_id + 1 = b.vec_id",
        ["vec_id", "v"],
    )


# control flow
query("matrix_steps", "nation", [step("matrix", variables={"n": [1, 2, 3]}, wrangles=[step("math", input="n_nationkey * ${n}", output="x${n}")])], "select *, n_nationkey * 1 x1, n_nationkey * 2 x2, n_nationkey * 3 x3 from nation")
query("condition_steps", "nation", [{"convert.case": {"input": "n_name", "case": "lower", "if": "row_count > 10"}}, {"convert.case": {"input": "n_name", "case": "upper", "if": "'absent' in columns"}}], "select n_nationkey, lower(n_name) n_name, n_regionkey from nation")
query("batch_and_concurrent", "nation", [step("batch", wrangles=[step("convert.case", input="n_name", case="lower")]), step("concurrent", wrangles=[step("math", input="n_nationkey + 1", output="a"), step("math", input="n_regionkey + 1", output="b")])], "select n_nationkey, lower(n_name) n_name, n_regionkey, n_nationkey + 1 a, n_regionkey + 1 b from nation")
query("try_steps", "nation", [{"try": {"wrangles": [step("convert.case", input="absent", case="lower")], "except": {"n_name": "none"}}}], "select n_nationkey, 'none' n_name, n_regionkey from nation")
query("html_text", "pages", [step("extract.html", input="html", output="v", data_type="text"), step("select.length", input="v", output="n")], None, ["page_id", "n"])
query("extract_codes", "customer", [step("extract.codes", input="c_name", output="v", strategy="lenient", output_format="concatenate")], None, ["c_custkey", "v"])


@frame("lookup_by_key", "select c_custkey, n_name v from customer join nation on c_nationkey = n_nationkey")
def lookup_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.operators import models
    from sluice.plans import recipe

    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    models.use(models.LocalProvider({"nations": {"purpose": "lookup", "columns": ["Key", "Name"], "data": [[r["n_nationkey"], r["n_name"]] for r in nations.collect()]}}))
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return recipe.Frame(df).lookup(input="c_nationkey", output={"Name": "v"}, model_id="nations").df.select("c_custkey", "v")


@frame("stream_tumbling", "select time_bucket(interval '1 hour', ts) window_start, event_type, count(*) n from events group by all")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.streaming import runner

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = runner.source(spark, f"{sf_dir}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = runner.windowed(events, "ts", "1 hour", by=["event_type"], n=F.count("*"))
    found = runner.drain(counted, f"stream_{abs(hash(sf_dir))}", "complete")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@frame("cube_report", "select l_returnflag, l_linestatus, count(*) n from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
