"""Sinks of recipes, and the actions that run before and after."""

from __future__ import annotations

import logging
import shutil
import smtplib
import tempfile
import uuid
from email.message import EmailMessage
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from sluice import template
from sluice.operators.control import permutations
from sluice.registry import Context, injected
from sluice.sources.readers import MEMORY, fetched, filtered, kind_of, union

WRITERS: dict[str, Any] = {}
ACTIONS: dict[str, Any] = {}


def writer(key: str):
    def add(call):
        WRITERS[key] = call
        return call

    return add


def action(key: str):
    def add(call):
        ACTIONS[key] = call
        return call

    return add


@writer("file")
def file(ctx: Context, df: DataFrame, name: str, single: bool = True, mode: str = "overwrite", sep: str = ",", **_) -> None:
    """One named file, where single is true; else a folder that all tasks write to, which is what large frames need."""
    form = kind_of(name)
    if form in ("xlsx", "xls"):
        df.toPandas().to_excel(name, index=False)
        return
    target = tempfile.mkdtemp(dir=Path(name).parent if Path(name).parent.exists() else None) + "/out" if single else name
    rows = df.coalesce(1) if single else df
    write = rows.write.mode(mode)
    if name.endswith(".gz"):
        write = write.option("compression", "gzip")
    if form in ("csv", "txt"):
        write.options(header="true", sep=sep, escape='"', emptyValue="").csv(target)
    elif form in ("json", "jsonl"):
        write.option("ignoreNullFields", "false").json(target)
    elif form in ("parquet", "orc"):
        getattr(write, form)(target)
    else:
        raise ValueError(f"Files of kind {form!r} cannot be written")
    if single:
        Path(name).parent.mkdir(parents=True, exist_ok=True)
        part = next(p for p in Path(target).iterdir() if p.name.startswith("part-"))
        if form == "json":
            with part.open(encoding="utf-8") as lines, open(name, "w", encoding="utf-8") as out:
                out.write("[" + ",".join(line.rstrip("\n") for line in lines) + "]")
        else:
            shutil.move(part, name)
        shutil.rmtree(Path(target).parent)


@writer("memory")
def memory(ctx: Context, df: DataFrame, id: str | None = None, orient: str = "tight", **_) -> None:  # noqa: A002
    MEMORY["dataframes"][id or str(uuid.uuid4())] = df


@writer("excel.sheet")
def sheet(ctx: Context, df: DataFrame, name: str = "Sheet1", action: str = "overwrite", **_) -> None:
    queue = MEMORY["queue"]
    at = next((q for q in queue if q["name"] == name), None)
    if at is None:
        queue.append({"name": name, "dataframe": df})
    elif action == "append":
        at["dataframe"] = union([at["dataframe"], df])
    else:
        at["dataframe"] = df


@writer("dataframe")
def dataframe(ctx: Context, df: DataFrame, **_) -> None:
    MEMORY["dataframes"]["__result"] = df


@writer("table")
def table(ctx: Context, df: DataFrame, name: str, mode: str = "overwrite", bucket_by: str | None = None, buckets: int = 64, **_) -> None:
    write = df.write.mode(mode)
    (write.bucketBy(buckets, bucket_by).sortBy(bucket_by) if bucket_by else write).saveAsTable(name)


@writer("recipe")
def recipe(ctx: Context, df: DataFrame, name: str | None = None, variables: dict | None = None, **inline) -> None:
    from sluice.plans import recipe as plans

    plans.run(name or inline, ctx.spark, {**ctx.variables, **(variables or {})}, dataframe=df, functions=ctx.functions)


@writer("concurrent")
def concurrent(ctx: Context, df: DataFrame, write: list, max_concurrency: int = 10, **_) -> None:  # noqa: A002
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_concurrency) as pool:
        for done in [pool.submit(write_one, ctx, df, w) for w in write]:
            done.result()


@writer("matrix")
def matrix(ctx: Context, df: DataFrame, variables: dict, write: list, strategy: str = "loop", **_) -> None:  # noqa: A002
    for values in permutations(ctx, df, variables, strategy):
        for w in template.bind(write, {**ctx.variables, **values}):
            write_one(ctx, df, w)


def _jdbc(driver: str, port: int):
    def call(ctx: Context, df: DataFrame, host: str, user: str, password: str, table: str, database: str = "", port: int = port, action: str = "INSERT", **options) -> None:
        url = f"jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=true" if driver == "sqlserver" else f"jdbc:{driver}://{host}:{port}/{database}"
        mode = {"INSERT": "append", "REPLACE": "overwrite", "FAIL": "error"}[action.upper()]
        df.write.format("jdbc").options(url=url, user=user, password=password, dbtable=table, **options).mode(mode).save()

    return call


for _key, _driver, _port in (("postgres", "postgresql", 5432), ("mssql", "sqlserver", 1433), ("mysql", "mysql", 3306)):
    WRITERS[_key] = _jdbc(_driver, _port)


@writer("sqlite")
def sqlite(ctx: Context, df: DataFrame, database: str, table: str, action: str = "INSERT", **_) -> None:
    import sqlite3

    names = ", ".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    with sqlite3.connect(database) as connection:
        if action.upper() == "REPLACE":
            connection.execute(f'drop table if exists "{table}"')
        connection.execute(f'create table if not exists "{table}" ({names})')
        connection.executemany(f'insert into "{table}" values ({", ".join("?" * len(df.columns))})', (tuple(r) for r in df.toLocalIterator()))


@writer("duckdb")
def duckdb(ctx: Context, df: DataFrame, database: str, table: str, action: str = "INSERT", **_) -> None:
    import duckdb as driver

    rows = df.toPandas()
    connection = driver.connect(database)
    try:
        connection.register("__rows", rows)
        if action.upper() == "REPLACE":
            connection.execute(f'create or replace table "{table}" as select * from __rows')
        else:
            connection.execute(f'create table if not exists "{table}" as select * from __rows limit 0')
            connection.execute(f'insert into "{table}" select * from __rows')
    finally:
        connection.close()


@writer("http")
def http(ctx: Context, df: DataFrame, url: str, method: str = "POST", headers=None, batch: int | bool = False, **_) -> None:
    held: list[dict] = []

    def send() -> None:
        fetched(url, method, headers, body=held if batch else held[0])
        held.clear()

    for r in df.toLocalIterator():
        held.append(r.asDict(recursive=True))
        if not batch or (batch is not True and len(held) >= batch):
            send()
    if held:
        send()


@writer("s3")
def s3(ctx: Context, df: DataFrame, bucket: str, file_key: str | None = None, key: str | None = None, access_key: str | None = None, secret_access_key: str | None = None, **options) -> None:
    """All tasks write below s3a://bucket/file_key; keys given here hold for this bucket alone."""
    at = file_key or key
    if not at:
        raise ValueError("write s3 needs file_key")
    if access_key:
        settings = ctx.spark.sparkContext._jsc.hadoopConfiguration()
        settings.set(f"fs.s3a.bucket.{bucket}.access.key", access_key)
        settings.set(f"fs.s3a.bucket.{bucket}.secret.key", secret_access_key or "")
    file(ctx, df, f"s3a://{bucket}/{at}", single=False, **options)


@writer("mongodb")
def mongodb(ctx: Context, df: DataFrame, user: str, password: str, database: str, collection: str, host: str, action: str = "INSERT", query: dict | None = None, update: dict | None = None, **_) -> None:
    """INSERT adds df's rows, written by all tasks; UPDATE has the server change the documents that query finds."""
    from urllib.parse import quote_plus

    at = f"mongodb+srv://{quote_plus(user)}:{quote_plus(password)}@{host}/?retryWrites=true&w=majority"
    if action.upper() == "INSERT":
        df.write.format("mongodb").options(**{"connection.uri": at, "database": database, "collection": collection}).mode("append").save()
    elif action.upper() == "UPDATE":
        if query is None or update is None:
            raise ValueError("UPDATE needs query and update")
        import pymongo

        with pymongo.MongoClient(at) as client:
            client[database][collection].update_many(query, update)
    else:
        raise ValueError(f"write mongodb cannot {action}: INSERT and UPDATE are known")


def _train(purpose: str):
    def call(ctx: Context, df: DataFrame, name: str | None = None, model_id: str | None = None, action: str = "OVERWRITE", **_) -> None:
        from sluice.operators import models

        rows = [list(r) for r in df.toLocalIterator()]
        key = model_id or name
        if action.upper() != "OVERWRITE" and key in models.provider.names():
            old = {str(r[0]): r for r in models.provider.content(key)["data"]}
            new = {str(r[0]): r for r in rows}
            merged = {"UPSERT": {**old, **new}, "INSERT": {**new, **old}, "UPDATE": {**old, **{k: v for k, v in new.items() if k in old}}}[action.upper()]
            rows = list(merged.values())
        models.provider.train(key, purpose, df.columns, rows, name=name)

    return call


for _key in ("classify", "extract", "lookup", "standardize"):
    WRITERS[f"train.{_key}"] = _train(_key)


def write_one(ctx: Context, df: DataFrame, step: dict | str) -> None:
    if isinstance(step, str):
        step = {step: {}}
    for key, params in step.items():
        params = dict(params or {})
        shown = filtered(df, **{k: params.pop(k) for k in ("columns", "not_columns", "where", "where_params", "order_by") if k in params})
        condition = params.pop("if", None)
        if condition is not None:
            facts = {"row_count": shown.count, "column_count": len(shown.columns), "columns": shown.columns}
            if not template.condition(condition, {**ctx.variables, **facts}):
                continue
        if key.startswith("custom."):
            ctx.function(key)(shown, **injected(ctx, ctx.function(key), params))
        elif key in ctx.functions:
            ctx.functions[key](shown, **params)
        elif key in WRITERS:
            WRITERS[key](ctx, shown, **params)
        else:
            raise ValueError(f"{key} is no sink")


def write(ctx: Context, df: DataFrame, steps: list | dict) -> DataFrame:
    """All sinks in turn; the result is the last dataframe sink's frame, else df."""
    MEMORY["dataframes"].pop("__result", None)
    for step in steps if isinstance(steps, list) else [steps]:
        write_one(ctx, df, step)
    return MEMORY["dataframes"].pop("__result", df)


@action("recipe")
def run_recipe(ctx: Context, name: str | None = None, variables: dict | None = None, **inline) -> None:
    from sluice.plans import recipe as plans

    plans.run(name or inline, ctx.spark, {**ctx.variables, **(variables or {})}, functions=ctx.functions)


@action("log")
def log(ctx: Context, error=None, warning=None, info=None, **_) -> None:
    for level, message in (("error", error), ("warning", warning), ("info", info)):
        if message:
            getattr(logging.getLogger("sluice"), level)(message)


@action("memory.clear")
def clear(ctx: Context, id: str | None = None, **_) -> None:  # noqa: A002
    MEMORY["dataframes"].pop(id, None) if id else MEMORY["dataframes"].clear()


@action("http")
def call_http(ctx: Context, url: str, method: str = "GET", headers=None, params=None, json=None, **_) -> None:
    fetched(url, method, headers, params, json)


@action("notification")
def notification(ctx: Context, service: str, url: str | None = None, title: str = "", body: str = "", **settings) -> None:
    """By web hook, or by mail with host, user, password and to."""
    if service in ("slack", "teams", "hook", "telegram"):
        fetched(url, "POST", body={"text": f"{title}\n{body}".strip()})
        return
    message = EmailMessage()
    message["Subject"], message["From"], message["To"] = title, settings["user"], settings["to"]
    message.set_content(body)
    with smtplib.SMTP_SSL(settings["host"]) as mail:
        mail.login(settings["user"], settings["password"])
        mail.send_message(message)


@action("file.copy")
def copy_file(ctx: Context, source: str, target: str, **_) -> None:
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    shutil.copy(source, target)


@action("file.delete")
def delete_file(ctx: Context, name: str, **_) -> None:
    Path(name).unlink()


@action("sqlite")
def run_sqlite(ctx: Context, database: str, command: str, params=(), **_) -> None:
    import sqlite3

    with sqlite3.connect(database) as connection:
        connection.execute(command, params)


@action("duckdb")
def run_duckdb(ctx: Context, database: str, command: str, params=None, **_) -> None:
    import duckdb as driver

    connection = driver.connect(database)
    connection.execute(command, params or [])
    connection.close()


@action("matrix")
def run_matrix(ctx: Context, variables: dict, run: list, strategy: str = "loop", **_) -> None:  # noqa: A002
    for values in permutations(ctx, None, variables, strategy):
        act(ctx, template.bind(run, {**ctx.variables, **values}))


@action("concurrent")
def run_concurrent(ctx: Context, run: list, max_concurrency: int = 10, **_) -> None:  # noqa: A002
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_concurrency) as pool:
        for done in [pool.submit(act, ctx, [r]) for r in run]:
            done.result()


@action("create.variables")
def variables(ctx: Context, **values) -> None:
    ctx.variables.update(values)


def act(ctx: Context, steps: list | dict, **more: Any) -> None:
    """Runs hooks."""
    for step in steps if isinstance(steps, list) else [steps]:
        for key, params in (step.items() if isinstance(step, dict) else [(step, {})]):
            params = dict(params or {})
            condition = params.pop("if", None)
            if condition is not None and not template.condition(condition, {**ctx.variables, **more}):
                continue
            if key.startswith("custom."):
                ctx.function(key)(**injected(ctx, ctx.function(key), params, **more))
            elif key in ctx.functions:
                ctx.functions[key](**injected(ctx, ctx.functions[key], params, **more))
            elif key in ACTIONS:
                ACTIONS[key](ctx, **params)
            else:
                raise ValueError(f"{key} is no action")

