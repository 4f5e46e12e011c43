"""Recipes over streams: row-wise steps on the stream itself, whole recipes on each micro-batch, event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import order
from sluice.plans import recipe
from sluice.registry import OPERATORS, Context


def source(spark: SparkSession, path: str, schema: Any, form: str = "parquet", files_per_trigger: int | None = None, **options: str) -> DataFrame:
    read = spark.readStream.format(form).schema(schema).options(**options)
    return (read.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else read).load(path)


def apply(df: DataFrame, wrangles: Sequence[dict], functions: Any = None) -> DataFrame:
    """Row-wise steps on a stream; other steps need whole frames and are refused."""
    for step in wrangles:
        for key in step:
            if key in OPERATORS and OPERATORS[key].kind != "row" and key != "filter":
                raise ValueError(f"{key} needs a whole frame; run it on each micro-batch")
    return recipe.steps(Context(df.sparkSession, {}, recipe.functions_of(functions), recipe.steps), df, list(wrangles))


def windowed(df: DataFrame, time: str, width: str, slide: str | None = None, late: str = "0 seconds", by: Sequence[str] = (), session: bool = False, **aggregates: F.Column) -> DataFrame:
    """Aggregates by event-time windows: tumbling, sliding, or sessions with width as the gap."""
    window = F.session_window(time, width) if session else F.window(time, width, slide) if slide else F.window(time, width)
    grouped = df.withWatermark(time, late).groupBy(window.alias("window"), *by).agg(*[a.alias(k) for k, a in aggregates.items()])
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *aggregates)


def distinct(df: DataFrame, time: str, by: Sequence[str], late: str) -> DataFrame:
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(by))


def run_batches(df: DataFrame, given: Any, checkpoint: str, variables: dict | None = None, functions: Any = None, available_now: bool = True):
    """The whole recipe, its writes included, on each micro-batch."""

    def one(batch: DataFrame, number: int) -> None:
        recipe.run(given, batch.sparkSession, {**(variables or {}), "batch_number": number}, dataframe=batch, functions=functions)

    write = df.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (write.trigger(availableNow=True) if available_now else write).start()


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """What a finite stream gives, as a view of that name over files that the executors write in the shared checkpoint folder.

    Each micro-batch has a folder of its own, and one that runs again replaces what it wrote; in complete mode the
    last one's rows are the result. A stream that goes on from a given checkpoint finds its earlier batches beside it.
    """
    spark = df.sparkSession
    at = checkpoint or f"{order.checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    rows = f"{at.rstrip('/')}/rows"
    spark.createDataFrame([], df.schema).write.mode("append").parquet(rows)  # a stream without batches has no rows

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/{'complete' if mode == 'complete' else number}")

    write = df.writeStream.foreachBatch(one).queryName(name).outputMode(mode).trigger(availableNow=True)
    write.option("checkpointLocation", at).start().awaitTermination()
    spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(rows).createOrReplaceTempView(name)
    return spark.table(name)
