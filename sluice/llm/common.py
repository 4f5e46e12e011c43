"""Helpers that the training-data operators share.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir``, which a cluster shares, so a
lost executor costs a task, not the lineage before the table. A table lives until drop() or until the
scope() around it ends; what a returned frame reads must outlive it, so that is for the caller to close.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import order

#: White space as the operators' contracts define it; bytes.split() and bytes.strip() use the same six.
SPACE = " \t\n\x0b\x0c\r"
MASK = (1 << 64) - 1


_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where the session names none, a local one if a single machine runs all."""
    return (spark.conf.get("spark.checkpoint.dir", None) or order.checkpoint_dir(spark)).rstrip("/")


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables made inside that still stand are deleted at the end."""
    _scopes.append([])
    try:
        yield
    finally:
        drop(*_scopes.pop())


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for what is planned and run inside; as they were afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _written(df: DataFrame, path: str, write) -> None:
    held = {
        # the shuffle files of a write go as soon as it ends: nothing reads them again
        "spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true",
        # a union of bucketed tables would be taken for a partitioned one, though its scans are then read without their buckets
        "spark__sql__unionOutputPartitioning": "false",
        "spark__sql__legacy__bucketedTableScan__outputOrdering": "true",
    }
    with settings(df.sparkSession, **held):
        write(df.write.option("compression", "zstd").option("path", path))


def _kept(out: DataFrame, path: str, name: str | None = None, keep: bool = False) -> DataFrame:
    out.sluice_path, out.sluice_table = path, name
    if _scopes and not keep:
        _scopes[-1].append(out)
    return out


def table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written to a new shared table and read back; one to keep outlives the scope that it is made in."""
    path = f"{shared_dir(df.sparkSession)}/sluice/{name}-{uuid.uuid4().hex}"
    _written(df, path, lambda w: w.format("parquet").save())
    return _kept(df.sparkSession.read.schema(df.schema).parquet(path), path, keep=keep)


def sorted_table(df: DataFrame, name: str, key: str) -> DataFrame:
    """df in a new shared table whose buckets, one file each, are sorted by key: joins on it need neither exchange nor sort on its side."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    called = f"sluice_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/sluice/{called}"
    _written(df.repartition(n, key), path, lambda w: w.format("parquet").bucketBy(n, key).sortBy(key).saveAsTable(called))
    return _kept(spark.table(called), path, called)


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by table() and sorted_table() that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        if t.sluice_table:
            spark.sql(f"drop table if exists {t.sluice_table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(t.sluice_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Fewer rows to an Arrow batch: whole texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(column) -> F.Column:
    """What tells rows with one doc_id and different texts apart."""
    return F.xxhash64(F.coalesce(column, F.lit("")), F.lit(7))


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


class Hashes(dict):
    """Word to 64-bit hash, remembered; forgets all when it holds too many."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@functools.cache
def keep_memory() -> None:
    """For a process whose arrays of megabytes come and go: the C library keeps up to 128 MB of freed memory, where it is glibc.

    Else each such array is mapped anew, and its page faults cost as much as the arithmetic on it.
    """
    with contextlib.suppress(OSError, AttributeError):
        library = ctypes.CDLL(None)
        library.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        library.mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD


_remembered: dict[str, Callable[[], None]] = {}


def turn_to(operator: str, forget: Callable[[], None] | None = None) -> None:
    """Says whose task this process begins: what it remembers of another operator's tasks goes.

    Spark's worker processes outlive tasks and stages. forget is what an operator that remembers from task to task
    leaves to be called when another one begins.
    """
    for name in [k for k in _remembered if k != operator]:
        _remembered.pop(name)()
    if forget is not None:
        _remembered[operator] = forget


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batches(rows, limit: int):
    """Lists of (size, item) items whose sizes add up to limit, or single larger ones."""
    held, total = [], 0
    for n, item in rows:
        if held and total + n > limit:
            yield held
            held, total = [], 0
        held.append(item)
        total += n
    if held:
        yield held


def _mark(edges: DataFrame) -> tuple:
    """What tells one edge set from another."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the least node reachable.

    Large-star and small-star in turn until an edge set repeats, one shared table a round. No node's
    neighbours are gathered: each round is minima and joins. Nodes are of any ordered type.
    """
    edges = table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = _mark(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        # large star: each node's larger neighbours point to the least of its neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: each node's smaller neighbours, and itself, point to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").union(least.select(F.col("a"), "m")).toDF("a", "b").distinct()
        new = table(small, "edges")
        drop(edges)
        edges = new
        after = _mark(edges)
        if before == after:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    # a settled star forest: every node but a root has one edge, to its root
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
