"""Sinks and actions on remote services; their drivers are imported where they are used."""

from __future__ import annotations

import base64
import json
import os
import re
import smtplib
import tempfile
from email.message import EmailMessage
from pathlib import Path
from urllib import parse, request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.dialect import sql
from sluice.registry import Context
from sluice.sources.readers import fetched
from sluice.sources.writers import WRITERS, action, writer


def _sftp(host: str, user: str, password: str = "", pkey: str = "", port: int = 22):
    import paramiko

    client = paramiko.SSHClient()
    client.load_system_host_keys()
    client.connect(host, port, user, password or None, key_filename=pkey or None)
    return client


def _upload_ckan(host: str, dataset: str, api_key: str, file: str, path: str) -> None:
    border = "sluice" + os.urandom(8).hex()
    fields = {"package_id": dataset, "name": file}
    body = b"".join(f'--{border}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items())
    body += f'--{border}\r\nContent-Disposition: form-data; name="upload"; filename="{file}"\r\n\r\n'.encode() + Path(path).read_bytes() + f"\r\n--{border}--\r\n".encode()
    found = fetched(f"{host}/api/3/action/package_show", params={"id": dataset}, headers={"Authorization": api_key})["result"]["resources"]
    old = next((r["id"] for r in found if r["name"] == file), None)
    if old:
        body = f'--{border}\r\nContent-Disposition: form-data; name="id"\r\n\r\n{old}\r\n'.encode() + body
    call = request.Request(f"{host}/api/3/action/resource_{'update' if old else 'create'}", data=body, headers={"Authorization": api_key, "Content-Type": f"multipart/form-data; boundary={border}"})
    request.urlopen(call, timeout=300).close()


def _local(ctx: Context, df: DataFrame, file: str, **options) -> str:
    path = str(Path(tempfile.mkdtemp()) / os.path.basename(file))
    WRITERS["file"](ctx, df, path, **options)
    return path


@writer("sftp")
def write_sftp(ctx: Context, df: DataFrame, host: str, user: str, file: str, password: str = "", pkey: str = "", port: int = 22, **options) -> None:
    client = _sftp(host, user, password, pkey, port)
    client.open_sftp().put(_local(ctx, df, file, **options), file)
    client.close()


@writer("ckan")
def write_ckan(ctx: Context, df: DataFrame, host: str, dataset: str, file: str, api_key: str, **options) -> None:
    _upload_ckan(host, dataset, api_key, file, _local(ctx, df, file, **options))


@writer("akeneo")
def write_akeneo(ctx: Context, df: DataFrame, host: str, user: str, password: str, client_id: str, client_secret: str, source: str, **_) -> None:
    basic = base64.b64encode(f"{client_id}:{client_secret}".encode()).decode()
    token = fetched(f"{host}/api/oauth/v1/token", "POST", {"Authorization": f"Basic {basic}"}, body={"grant_type": "password", "username": user, "password": password})["access_token"]
    held: list[str] = []

    def send() -> None:
        call = request.Request(f"{host}/api/rest/v1/{source}", data="\n".join(held).encode(), method="PATCH", headers={"Authorization": f"Bearer {token}", "Content-Type": "application/vnd.akeneo.collection+json"})
        with request.urlopen(call, timeout=300) as answer:
            bad = [x for x in answer.read().decode().splitlines() if json.loads(x)["status_code"] >= 300]
        held.clear()
        if bad:
            raise RuntimeError(f"Rows were refused: {bad[:5]}")

    for row in df.toLocalIterator():
        held.append(json.dumps(row.asDict(recursive=True), default=str))
        if len(held) == 100:
            send()
    if held:
        send()


@writer("pricefx")
def write_pricefx(ctx: Context, df: DataFrame, host: str, partition: str, target: str, user: str, password: str, source: str | None = None, batch_size: int = 10000, **_) -> None:
    basic = base64.b64encode(f"{partition}/{user}:{password}".encode()).decode()
    held: list[list] = []
    url = f"{host}/pricefx/{partition}/loaddata.{target}" + (f"/{source}" if source else "")

    def send() -> None:
        fetched(url, "POST", {"Authorization": f"Basic {basic}"}, body={"data": {"header": df.columns, "data": held}})
        held.clear()

    for row in df.toLocalIterator():
        held.append(list(row))
        if len(held) == batch_size:
            send()
    if held:
        send()


@writer("salesforce")
def write_salesforce(ctx: Context, df: DataFrame, instance: str, object: str, id: str, token: str, **_) -> None:  # noqa: A002
    held: list[dict] = []

    def send() -> None:
        fetched(f"https://{instance}/services/data/v59.0/composite/sobjects/{object}/{id}", "PATCH", {"Authorization": f"Bearer {token}"}, body={"allOrNone": False, "records": held})
        held.clear()

    for row in df.toLocalIterator():
        held.append({"attributes": {"type": object}, **row.asDict(recursive=True)})
        if len(held) == 200:
            send()
    if held:
        send()


@writer("access")
def write_access(ctx: Context, df: DataFrame, table: str, database: str | None = None, connection_string: str | None = None, action: str = "INSERT", **_) -> None:  # noqa: A002
    import pyodbc

    with pyodbc.connect(connection_string or f"Driver={{Microsoft Access Driver (*.mdb, *.accdb)}};Dbq={database}") as connection:
        cursor = connection.cursor()
        if action.upper() == "REPLACE":
            cursor.execute(f"delete from [{table}]")
        names = ", ".join(f"[{c}]" for c in df.columns)
        cursor.executemany(f"insert into [{table}] ({names}) values ({', '.join('?' * len(df.columns))})", [tuple(r) for r in df.toLocalIterator()])


@writer("train.meta_data")
def write_meta_data(ctx: Context, df: DataFrame, model_id: str, **_) -> None:
    from sluice.operators import models

    row = df.first()
    models.provider.content(model_id).update({k: v for k, v in row.asDict().items() if k not in ("data", "columns", "id")})


@action("postgres")
def run_postgres(ctx: Context, host: str, database: str, user: str, password: str, command: str, port: int = 5432, params=None) -> None:
    import psycopg2

    with psycopg2.connect(host=host, dbname=database, user=user, password=password, port=port) as connection, connection.cursor() as cursor:
        cursor.execute(command, params)


@action("mssql")
def run_mssql(ctx: Context, host: str, user: str, password: str, command: str, params=None, **_) -> None:
    import pymssql

    with pymssql.connect(host, user, password, autocommit=True) as connection, connection.cursor() as cursor:
        cursor.execute(command, params)


@action("access")
def run_access(ctx: Context, command: str, database: str | None = None, connection_string: str | None = None, params=None, **_) -> None:
    import pyodbc

    with pyodbc.connect(connection_string or f"Driver={{Microsoft Access Driver (*.mdb, *.accdb)}};Dbq={database}", autocommit=True) as connection:
        connection.execute(sql(command, params) if params else command)


@action("ssh")
def run_ssh(ctx: Context, host: str, user: str, command: str | list, password: str | None = None, key_filename: str | None = None, private_key: str | None = None) -> None:
    client = _sftp(host, user, password or "", key_filename or "")
    for one in [command] if isinstance(command, str) else command:
        _, out, err = client.exec_command(one)
        if out.channel.recv_exit_status():
            raise RuntimeError(err.read().decode())
    client.close()


@action("jinja")
def run_jinja(ctx: Context, template: str | dict, context: dict, output_file: str) -> None:
    """The template of create.jinja over the context's values, written to a file."""
    from sluice.jinja import rendered

    text = Path(template["file"]).read_text(encoding="utf-8") if isinstance(template, dict) and "file" in template else template["string"] if isinstance(template, dict) else template
    given = json.dumps(context, default=str)
    spark = ctx.spark
    row = spark.range(1).select(F.from_json(F.lit(given), spark.range(1).select(F.schema_of_json(given)).first()[0]).alias("c")).select("c.*")
    made = row.select(rendered(text, row.columns, [f.name for f in row.schema.fields if f.dataType.simpleString() == "string"])).first()[0]
    Path(output_file).write_text(made, encoding="utf-8")


def _pairs(a: str | list, b: str | list | None) -> list[tuple[str, str]]:
    first = [a] if isinstance(a, str) else list(a)
    second = [os.path.basename(x) for x in first] if b is None else [b] if isinstance(b, str) else list(b)
    return list(zip(first, second, strict=True))


def _s3(**keys):
    import boto3

    return boto3.client("s3", **{"aws_access_key_id" if k == "access_key" else "aws_secret_access_key": v for k, v in keys.items() if v})


@action("s3.download_files")
def s3_download(ctx: Context, bucket: str, file_key, save_as=None, access_key: str | None = None, secret_access_key: str | None = None, **_) -> None:
    for key, local in _pairs(file_key, save_as):
        _s3(access_key=access_key, secret_access_key=secret_access_key).download_file(bucket, key, local)


@action("s3.upload_files")
def s3_upload(ctx: Context, bucket: str, file, save_as=None, access_key: str | None = None, secret_access_key: str | None = None, **_) -> None:
    for local, key in _pairs(file, save_as):
        _s3(access_key=access_key, secret_access_key=secret_access_key).upload_file(local, bucket, key)


@action("sftp.download_files")
def sftp_download(ctx: Context, host: str, user: str, files, password: str = "", pkey: str = "", local=None, port: int = 22, **_) -> None:
    client = _sftp(host, user, password, pkey, port)
    for remote, path in _pairs(files, local):
        client.open_sftp().get(remote, path)
    client.close()


@action("sftp.upload_files")
def sftp_upload(ctx: Context, host: str, user: str, files, password: str = "", pkey: str = "", remote=None, port: int = 22, **_) -> None:
    client = _sftp(host, user, password, pkey, port)
    for path, there in _pairs(files, remote):
        client.open_sftp().put(path, there)
    client.close()


@action("ckan.download")
def ckan_download(ctx: Context, host: str, dataset: str, file: str, api_key: str | None = None, output_file: str | None = None, **_) -> None:
    found = fetched(f"{host}/api/3/action/package_show", params={"id": dataset}, headers={"Authorization": api_key} if api_key else None)
    url = next(r["url"] for r in found["result"]["resources"] if r["name"] == file or r["url"].endswith("/" + file))
    request.urlretrieve(url, output_file or os.path.basename(parse.urlsplit(url).path))


@action("ckan.upload")
def ckan_upload(ctx: Context, host: str, dataset: str, api_key: str, file, output_file=None, **_) -> None:
    for path, there in _pairs(file, output_file):
        _upload_ckan(host, dataset, api_key, there, path)


@action("notification.telegram")
def telegram(ctx: Context, bot_token: str, chat_id: str, title: str, body: str, **_) -> None:
    fetched(f"https://api.telegram.org/bot{bot_token}/sendMessage", "POST", body={"chat_id": chat_id, "text": f"{title}\n{body}"})


@action("notification.slack")
def slack(ctx: Context, web_hook: str, title: str, message: str, **_) -> None:
    fetched(web_hook, "POST", body={"text": f"*{title}*\n{message}"})


@action("notification.email")
def email(ctx: Context, user: str, password: str, subject: str, body: str, to=None, cc=None, bcc=None, host: str | None = None, domain: str | None = None, name: str | None = None, **_) -> None:
    message = EmailMessage()
    message["Subject"], message["From"] = subject, f"{name} <{user}>" if name else user
    for field, people in (("To", to or user), ("Cc", cc), ("Bcc", bcc)):
        if people:
            message[field] = people if isinstance(people, str) else ", ".join(people)
    message.set_content(body)
    with smtplib.SMTP_SSL(host or f"smtp.{domain or user.split('@')[1]}") as mail:
        mail.login(user, password)
        mail.send_message(message)
