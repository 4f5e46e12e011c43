"""Sources of recipes: files, sessions, generated rows, databases, services."""

from __future__ import annotations

import base64
import json
import os
import tempfile
from functools import reduce
from pathlib import Path
from typing import Any
from urllib import parse, request

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import dialect
from sluice.columns import expand
from sluice.operators.control import permutations
from sluice.operators.numbers import generated
from sluice.order import name, with_position
from sluice.registry import Context, injected

#: Frames and variables that runs of this process keep for one another.
MEMORY: dict[str, Any] = {"dataframes": {}, "variables": {}, "queue": []}
READERS: dict[str, Any] = {}


def reader(key: str):
    def add(call):
        READERS[key] = call
        return call

    return add


def filtered(df: DataFrame, columns=None, not_columns=None, where=None, where_params=None, order_by=None) -> DataFrame:
    """The parameters that every source and sink has."""
    if where:
        df = df.where(F.expr(dialect.sql(where, where_params)))
    if order_by:
        df = df.orderBy(*[F.expr(part.strip()) if not (m := part.strip().rsplit(" ", 1))[-1].lower() in ("asc", "desc") else (F.expr(m[0]).asc() if m[1].lower() == "asc" else F.expr(m[0]).desc()) for part in dialect.sql(order_by, None).split(",")])
    if columns:
        df = df.select(*map(name, expand(df.columns, columns)))
    if not_columns:
        df = df.drop(*expand(df.columns, not_columns))
    return df


def kind_of(path: str) -> str:
    parts = path.lower().removesuffix(".gz").rsplit(".", 1)
    return parts[-1] if len(parts) > 1 else ""


@reader("file")
def file(ctx: Context, name: str | dict, drop_empty: bool = False, sep: str = ",", encoding: str = "utf-8", schema: str | None = None, **options) -> DataFrame:  # noqa: A002
    spark = ctx.spark
    if isinstance(name, dict):
        handle, path = tempfile.mkstemp(suffix="-" + os.path.basename(name["name"]))
        with os.fdopen(handle, "wb") as f:
            f.write(base64.b64decode(name["data"]))
        name = path
    form = kind_of(name)
    read = spark.read.schema(schema) if schema else spark.read
    if form in ("csv", "txt", "tsv"):
        infer = "false" if schema else "true"
        df = read.options(header="true", sep="\t" if form == "tsv" else sep, encoding=encoding, multiLine="true", escape='"', inferSchema=infer).csv(name)
        df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    elif form == "json":
        df = read.json(name, multiLine=True)
    elif form == "jsonl":
        df = read.json(name)
    elif form == "parquet" or not form:
        df = read.parquet(name)
    elif form == "orc":
        df = read.orc(name)
    elif form in ("xlsx", "xlsm", "xls"):
        df = spark.createDataFrame(pd.read_excel(name, dtype="object", **options).fillna("").astype(str))
    else:
        raise ValueError(f"Files of kind {form!r} cannot be read")
    if drop_empty:
        filled = df.select(*[F.max(F.when(F.col("`" + c + "`").cast("string") != "", 1)).alias(str(k)) for k, c in enumerate(df.columns)]).first()
        df = df.select(*[F.col("`" + c + "`") for k, c in enumerate(df.columns) if filled[k]])
    return df


@reader("memory")
def memory(ctx: Context, id: str | None = None, orient: str = "tight", **_) -> DataFrame:  # noqa: A002
    frames = MEMORY["dataframes"]
    if not frames or (id is not None and id not in frames):
        raise ValueError(f"Nothing is kept in memory under {id}")
    return frames[id] if id is not None else frames[next(reversed(frames))]


@reader("test")
def test(ctx: Context, rows: int, values: dict | None = None) -> DataFrame:
    df = ctx.spark.range(rows)
    return df.select(*[generated(v).alias(k) for k, v in (values or {}).items()])


@reader("input")
def given(ctx: Context, **_) -> DataFrame:
    if ctx.variables.get("__input") is None:
        raise ValueError("No frame was given to the recipe")
    return ctx.variables["__input"]


@reader("recipe")
def recipe(ctx: Context, name: str | None = None, variables: dict | None = None, **inline) -> DataFrame:  # noqa: A002
    from sluice.plans import recipe as plans

    inline.pop("functions", None)
    return plans.run(name or inline, ctx.spark, {**ctx.variables, **(variables or {})}, functions=ctx.functions)


@reader("concurrent")
def concurrent(ctx: Context, read: list, max_concurrency: int = 10, **_) -> list[DataFrame]:
    return [one(ctx, r) for r in read]


@reader("matrix")
def matrix(ctx: Context, variables: dict, read: list, strategy: str = "loop", **_) -> list[DataFrame]:
    from sluice import template

    return [one(ctx, r) for values in permutations(ctx, None, variables, strategy) for r in template.bind(read, {**ctx.variables, **values})]


def union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns matched by name; a column of several types becomes text."""
    types: dict[str, set] = {}
    for f in frames:
        for field in f.schema.fields:
            types.setdefault(field.name, set()).add(field.dataType)
    mixed = {c for c, found in types.items() if len(found) > 1 and not all(isinstance(t, T.NumericType) for t in found)}
    frames = [f.withColumns({c: name(c).cast("string") for c in f.columns if c in mixed}) if mixed else f for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def join(ctx: Context, sources: list, how: str = "inner", left_on=None, right_on=None, on=None, suffixes=("_x", "_y"), **_) -> DataFrame:
    """Two sources by equal keys; null keys are equal to one another."""
    if len(sources) != 2:
        raise ValueError("Exactly two sources can be joined")
    left, right = (one(ctx, s) for s in sources)
    listed = lambda x: [x] if isinstance(x, str) else list(x)
    if how == "cross":
        pairs = []
    else:
        pairs = list(zip(listed(on or left_on), listed(on or right_on), strict=True))
    shared = {a for a, b in pairs if a == b}
    both = (set(left.columns) & set(right.columns)) - shared
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in both} | {c: f"__right_{c}" for c in shared})
    if how == "cross":
        return left.crossJoin(right)
    named = [(a + suffixes[0] if a in both else a, f"__right_{b}" if b in shared else b + suffixes[1] if b in both else b) for a, b in pairs]
    condition = reduce(lambda x, y: x & y, [left[f"`{a}`"].eqNullSafe(right[f"`{b}`"]) for a, b in named])
    joined = left.join(right, condition, "outer" if how == "outer" else how)
    if how in ("right", "outer"):
        joined = joined.withColumns({c: F.coalesce(name(c), name(f"__right_{c}")) for c in shared})
    return joined.drop(*[f"__right_{c}" for c in shared])


def concatenate(ctx: Context, sources: list, **_) -> DataFrame:
    """Sources side by side, row by row."""
    frames = [with_position(one(ctx, s), "__at") for s in sources]
    out = reduce(lambda a, b: a.join(b, "__at", "outer"), frames)
    return out.orderBy("__at").drop("__at")


def one(ctx: Context, step: dict | str) -> DataFrame:
    """The frame of one read step."""
    from sluice import template

    if isinstance(step, str):
        step = {step: {}}
    (key, params), = step.items()
    params = dict(params or {})
    condition = params.pop("if", None)
    if condition is not None and not template.condition(condition, ctx.variables):
        return ctx.spark.createDataFrame([], T.StructType([]))
    common = {k: params.pop(k) for k in ("columns", "not_columns", "where", "where_params", "order_by") if k in params}
    if key == "join":
        df = join(ctx, **params)
    elif key == "union":
        df = union([one(ctx, s) for s in params["sources"]])
    elif key == "concatenate":
        df = concatenate(ctx, **params)
    elif key.startswith("custom."):
        df = ctx.function(key)(**injected(ctx, ctx.function(key), params))
    elif key in ctx.functions:
        df = ctx.functions[key](**injected(ctx, ctx.functions[key], params))
    elif key in READERS:
        df = READERS[key](ctx, **params)
    else:
        raise ValueError(f"{key} is no source")
    if isinstance(df, list):
        df = union(df)
    if isinstance(df, pd.DataFrame):
        df = ctx.spark.createDataFrame(df)
    return filtered(df, **common)


def read(ctx: Context, steps: list | dict) -> DataFrame:
    frames = [one(ctx, s) for s in (steps if isinstance(steps, list) else [steps])]
    frames = [f for f in frames if f.columns] or frames[:1]
    return union(frames) if len(frames) > 1 else frames[0]


def _jdbc(driver: str, port: int):
    def call(ctx: Context, host: str, user: str, password: str, command: str, port: int = port, database: str = "", params=None, **options) -> DataFrame:
        url = f"jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=true" if driver == "sqlserver" else f"jdbc:{driver}://{host}:{port}/{database}"
        return ctx.spark.read.format("jdbc").options(url=url, user=user, password=password, query=dialect.sql(command, params) if params else command, **options).load()

    return call


for _key, _driver, _port in (("postgres", "postgresql", 5432), ("mssql", "sqlserver", 1433), ("mysql", "mysql", 3306)):
    READERS[_key] = _jdbc(_driver, _port)


@reader("sqlite")
def sqlite(ctx: Context, database: str, command: str, params=None, **_) -> DataFrame:
    """Read on the driver: the file is local and holds what one machine can."""
    import sqlite3

    with sqlite3.connect(database) as connection:
        return ctx.spark.createDataFrame(pd.read_sql(command, connection, params=params))


@reader("duckdb")
def duckdb(ctx: Context, database: str, command: str, params=None, **_) -> DataFrame:
    import duckdb as driver

    connection = driver.connect(database)
    try:
        return ctx.spark.createDataFrame(connection.execute(command, params or []).df())
    finally:
        connection.close()


def fetched(url: str, method: str = "GET", headers=None, params=None, body=None, timeout: float = 60) -> Any:
    if params:
        url += ("&" if "?" in url else "?") + parse.urlencode(params)
    data = None if body is None else json.dumps(body).encode()
    call = request.Request(url, data=data, method=method, headers={"Content-Type": "application/json", **(headers or {})})
    with request.urlopen(call, timeout=timeout) as answer:
        return json.load(answer)


@reader("http")
def http(ctx: Context, url: str, method: str = "GET", headers=None, params=None, json=None, json_key: str | None = None, oauth=None, orient: str = "records", **_) -> DataFrame:
    headers = dict(headers or {})
    if oauth:
        headers["Authorization"] = "Bearer " + fetched(oauth["url"], oauth.get("method", "POST"), oauth.get("headers"), oauth.get("params"), oauth.get("json"))["access_token"]
    found = fetched(url, method, headers, params, json)
    for key in (json_key or "").split("."):
        found = found[key] if key else found
    if orient == "tight":
        return ctx.spark.createDataFrame(pd.DataFrame(found["data"], columns=found["columns"]))
    if orient == "columns":
        return ctx.spark.createDataFrame(pd.DataFrame(found))
    return ctx.spark.createDataFrame(pd.json_normalize(found, max_level=0))


@reader("s3")
def s3(ctx: Context, bucket: str, file_key: str, access_key: str | None = None, secret_access_key: str | None = None, **options) -> DataFrame:
    settings = ctx.spark._jsc.hadoopConfiguration()
    if access_key:
        settings.set(f"fs.s3a.bucket.{bucket}.access.key", access_key)
        settings.set(f"fs.s3a.bucket.{bucket}.secret.key", secret_access_key)
    return file(ctx, f"s3a://{bucket}/{file_key}", **options)


@reader("mongodb")
def mongodb(ctx: Context, user: str, password: str, database: str, collection: str, host: str, query=None, projection=None, **_) -> DataFrame:
    stages = ([{"$match": query}] if query else []) + ([{"$project": projection}] if projection else [])
    read = ctx.spark.read.format("mongodb").options(**{"connection.uri": f"mongodb+srv://{user}:{password}@{host}/", "database": database, "collection": collection})
    return (read.option("aggregation.pipeline", json.dumps(stages)) if stages else read).load()


def _paged(ctx: Context, rows: list[dict]) -> DataFrame:
    return ctx.spark.createDataFrame(pd.json_normalize(rows, max_level=0)) if rows else ctx.spark.createDataFrame([], T.StructType([]))


@reader("ckan")
def ckan(ctx: Context, host: str, dataset: str, file: str, api_key: str | None = None, **options) -> DataFrame:  # noqa: A002
    found = fetched(f"{host}/api/3/action/package_show", params={"id": dataset}, headers={"Authorization": api_key} if api_key else None)
    url = next((r["url"] for r in found["result"]["resources"] if r["name"] == file or r["url"].endswith("/" + file)), None)
    if url is None:
        raise ValueError(f"{file} is not in {dataset}")
    local = Path(tempfile.mkdtemp()) / os.path.basename(url)
    request.urlretrieve(url, local)
    return READERS["file"](ctx, str(local), **options)


@reader("akeneo")
def akeneo(ctx: Context, host: str, user: str, password: str, client_id: str, client_secret: str, source: str, parameters=None, **_) -> DataFrame:
    basic = base64.b64encode(f"{client_id}:{client_secret}".encode()).decode()
    token = fetched(f"{host}/api/oauth/v1/token", "POST", {"Authorization": f"Basic {basic}"}, body={"grant_type": "password", "username": user, "password": password})["access_token"]
    rows, url = [], f"{host}/api/rest/v1/{source}?" + parse.urlencode({"limit": 100, **(parameters or {})})
    while url:
        page = fetched(url, headers={"Authorization": f"Bearer {token}"})
        rows += page["_embedded"]["items"]
        url = page["_links"].get("next", {}).get("href")
    return _paged(ctx, rows)


@reader("pricefx")
def pricefx(ctx: Context, host: str, partition: str, target: str, user: str, password: str, source: str | None = None, criteria=None, batch_size: int = 10000, **_) -> DataFrame:
    basic = base64.b64encode(f"{partition}/{user}:{password}".encode()).decode()
    rows, start = [], 0
    while True:
        body = {"data": criteria or {}, "startRow": start, "endRow": start + batch_size}
        got = fetched(f"{host}/pricefx/{partition}/{target}.fetch" + (f"/{source}" if source else ""), "POST", {"Authorization": f"Basic {basic}"}, body=body)["response"]["data"]
        rows += got
        if len(got) < batch_size:
            return _paged(ctx, rows)
        start += batch_size


@reader("salesforce")
def salesforce(ctx: Context, instance: str, command: str, token: str, params=None, **_) -> DataFrame:
    rows, url = [], f"https://{instance}/services/data/v59.0/query?" + parse.urlencode({"q": dialect.sql(command, params) if params else command})
    while url:
        page = fetched(url, headers={"Authorization": f"Bearer {token}"})
        rows += [{k: v for k, v in r.items() if k != "attributes"} for r in page["records"]]
        url = f"https://{instance}{page['nextRecordsUrl']}" if not page["done"] else None
    return _paged(ctx, rows)


@reader("sftp")
def sftp(ctx: Context, host: str, user: str, file: str, password: str = "", pkey: str = "", port: int = 22, **options) -> DataFrame:  # noqa: A002
    import paramiko

    client = paramiko.SSHClient()
    client.set_missing_host_key_policy(paramiko.RejectPolicy())
    client.load_system_host_keys()
    client.connect(host, port, user, password or None, key_filename=pkey or None)
    local = Path(tempfile.mkdtemp()) / os.path.basename(file)
    client.open_sftp().get(file, str(local))
    client.close()
    return READERS["file"](ctx, str(local), **options)


@reader("access")
def access(ctx: Context, command: str, database: str | None = None, connection_string: str | None = None, params=None, **_) -> DataFrame:
    import pyodbc

    with pyodbc.connect(connection_string or f"Driver={{Microsoft Access Driver (*.mdb, *.accdb)}};Dbq={database}") as connection:
        return ctx.spark.createDataFrame(pd.read_sql(command, connection, params=params))


def _trained(ctx: Context, model_id: str, **_) -> DataFrame:
    from sluice.operators import models

    return models.model_table(ctx, model_id)


for _key in ("classify", "extract", "lookup", "standardize"):
    READERS[f"train.{_key}"] = _trained


@reader("train.meta_data")
def meta_data(ctx: Context, model_id: str, **_) -> DataFrame:
    from sluice.operators import models

    found = {k: v if isinstance(v, str) else json.dumps(v) for k, v in models.provider.content(model_id).items() if k not in ("data", "columns")}
    return ctx.spark.createDataFrame([{"id": model_id, **found}])
